"""Part of the typed-table engine."""
