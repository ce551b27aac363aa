"""Declared schemas: names, aliases, exact types, nullability, unknown-field policy."""

from __future__ import annotations

import enum
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import types as T

from tabulon.errors import TableError
from tabulon.types import DataType


class UnknownFields(enum.Enum):
    """What happens to names that are not declared."""

    REJECT = "reject"
    STORE = "store"


@dataclass(frozen=True)
class ColumnSpec:
    """A null column is nullable whatever is asked for."""

    name: str
    data_type: DataType
    alias: str | None = None
    is_nullable: bool = False

    def __post_init__(self) -> None:
        if self.data_type is DataType.NULL:
            object.__setattr__(self, "is_nullable", True)

    def with_alias(self, alias: str) -> ColumnSpec:
        return ColumnSpec(self.name, self.data_type, alias, self.is_nullable)

    def nullable(self, yes: bool = True) -> ColumnSpec:
        return ColumnSpec(self.name, self.data_type, self.alias, yes)

    def field(self) -> T.StructField:
        told = {"logical": self.data_type.label} | ({"alias": self.alias} if self.alias is not None else {})
        return T.StructField(self.name, self.data_type.spark, self.is_nullable, told)


@dataclass(frozen=True)
class Schema:
    """Equal if columns, aliases, types, nullability and policy are. Names and
    aliases share one namespace and are case-sensitive."""

    columns: tuple[ColumnSpec, ...]
    unknown_fields: UnknownFields = UnknownFields.REJECT
    _places: dict = field(default_factory=dict, compare=False, repr=False)

    def __init__(self, columns: Iterable[ColumnSpec], unknown_fields: UnknownFields = UnknownFields.REJECT) -> None:
        object.__setattr__(self, "columns", tuple(columns))
        object.__setattr__(self, "unknown_fields", unknown_fields)
        places: dict[str, int] = {}
        for i, spec in enumerate(self.columns):
            for name in dict.fromkeys((spec.name, spec.alias)):
                if name is not None and places.setdefault(name, i) != i:
                    raise TableError.DuplicateColumn(name=name)
        object.__setattr__(self, "_places", places)

    def with_unknown_fields(self, policy: UnknownFields) -> Schema:
        return Schema(self.columns, policy)

    @property
    def is_open(self) -> bool:
        return self.unknown_fields is UnknownFields.STORE

    def column_index(self, name: str) -> int | None:
        """Position of a name or alias."""
        return self._places.get(name)

    def column(self, position: int) -> ColumnSpec | None:
        return self.columns[position] if 0 <= position < len(self.columns) else None

    def at(self, position: int) -> ColumnSpec:
        if not 0 <= position < len(self.columns):
            raise TableError.ColumnOutOfBounds(column=position, columns=len(self.columns))
        return self.columns[position]

    def named(self, name: str) -> int:
        found = self.column_index(name)
        if found is None:
            raise TableError.ColumnNotFound(name=name)
        return found

    def __len__(self) -> int:
        return len(self.columns)

    def __iter__(self) -> Iterator[ColumnSpec]:
        return iter(self.columns)

    @property
    def is_empty(self) -> bool:
        return not self.columns

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    @staticmethod
    def of_struct(struct: T.StructType, unknown_fields: UnknownFields = UnknownFields.REJECT) -> Schema:
        """The declared schema that a Spark schema carries in its metadata, or
        that its plain types stand for."""
        specs = []
        for f in struct.fields:
            told = f.metadata or {}
            kind = DataType.named(told["logical"]) if "logical" in told else DataType.of_spark(f.dataType)
            if kind is None:
                raise TableError.TypeMismatch(column=f.name, expected="a scalar", actual=f.dataType.simpleString())
            specs.append(ColumnSpec(f.name, kind, told.get("alias"), f.nullable))
        return Schema(specs, unknown_fields)
