"""Typed errors. Every failed operation leaves its inputs as they were."""

from __future__ import annotations


class TabulonError(Exception):
    """Base of all errors; ``details`` holds what the message is made of."""

    text = "{}"

    def __init__(self, **details) -> None:
        self.details = details
        super().__init__(self.text.format(**details))

    def __getattr__(self, name: str):
        if name != "details" and name in self.__dict__.get("details", {}):
            return self.details[name]
        raise AttributeError(name)

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.details == other.details

    __hash__ = Exception.__hash__


def _kinds(base: type, **texts: str) -> None:
    """Adds one subclass for each name, reachable as an attribute of its base."""
    for name, text in texts.items():
        setattr(base, name, type(name, (base,), {"text": text, "__qualname__": f"{base.__name__}.{name}", "__module__": __name__}))


class ValueConversionError(TabulonError):
    """A scalar cannot be converted."""


_kinds(ValueConversionError, TypeMismatch="expected {expected}, found {actual}", OutOfRange="{value} does not fit {target}")


class TableError(TabulonError):
    """A table, schema or cell operation was refused."""


_kinds(
    TableError,
    DuplicateColumn="column name or alias {name!r} is used twice",
    ColumnNotFound="no column {name!r}",
    RowOutOfBounds="row {row} of {rows}",
    ColumnOutOfBounds="column {column} of {columns}",
    RowWidth="row has {actual} values, schema has {expected}",
    NullValue="column {column!r} takes no null",
    TypeMismatch="column {column!r} takes {expected}, found {actual}",
    UnsupportedIndexType="column {column!r} of type {data_type} cannot be indexed",
    SchemaMismatch="schemas differ",
    ExtraConflict="extra {name!r} has the name of a declared column",
)


class ColumnSelectionError(TabulonError):
    """Input and output columns cannot be borrowed together."""


_kinds(ColumnSelectionError, InputOutOfBounds="input column {column} of {columns}", OutputOutOfBounds="output column {column} of {columns}", Overlap="column {column} is both input and output", DuplicateOutput="column {column} is an output twice")


class ColumnSliceError(TabulonError):
    """A typed slice of a column was refused."""


_kinds(ColumnSliceError, TypeMismatch="column is {actual}, asked for {expected}", Nullable="column {column!r} is nullable")


class BinaryError(TabulonError):
    """A binary read, write or conversion failed; the cursor did not move."""


_kinds(BinaryError, InvalidHex="not hexadecimal", OutOfBounds="{size} bytes at {position} of {length}", InvalidUtf8="payload is not UTF-8", LengthRange="length {length} does not fit a u32", Seek="position {position} of {length}")


class TextError(TabulonError):
    """A text conversion failed."""


_kinds(TextError, InvalidUtf8="bytes are not UTF-8", InvalidUtf16="units are not UTF-16", InvalidJson="not a JSON string: {reason}", InvalidPercent="malformed escape at byte {position}")


class FormatError(TabulonError):
    """A value or argument has no place in the output format."""


_kinds(FormatError, UnnamedArgument="argument {position} has no name", DuplicateArgument="argument name {name!r} is used twice", NonFinite="{value} has no JSON number")


class ExpressionError(TabulonError):
    """A formula or script failed."""


_kinds(ExpressionError, Compile="{reason}", Evaluate="{reason}", OutOfRange="variable {name!r} does not fit a signed 64-bit integer", UnsupportedOutput="result of type {kind} has no table value")


class SqlError(TabulonError):
    """A statement, its parameters or its result were refused."""


_kinds(
    SqlError,
    Prepare="{reason}",
    MixedPlaceholders="statement mixes named and positional placeholders",
    MixedArguments="arguments mix named and positional ones",
    ModeMismatch="statement takes {expected} arguments, {actual} were given",
    CountMismatch="statement takes {expected} arguments, {actual} were given",
    DuplicateArgument="argument {name!r} is given twice",
    MissingArgument="no argument for {name!r}",
    UnknownArgument="no placeholder for {name!r}",
    IntegerRange="argument {value} does not fit a signed 64-bit integer",
    ResultWidth="result has {actual} columns, schema has {expected}",
    MixedColumn="column {column!r} mixes {first} and {second}",
    ResultType="column {column!r}: {actual} is no {expected}",
    ResultRange="column {column!r}: {value} does not fit {expected}",
    InvalidUuid="column {column!r}: not a UUID",
    InvalidUtf8="column {column!r}: not UTF-8",
)
