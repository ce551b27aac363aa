"""Logical scalar types and how Spark holds them.

Unsigned integers take the next wider Spark type (u64: decimal(20,0)) and a
range guard; the logical name lives in the field's metadata, so schemas compare
and print by it."""

from __future__ import annotations

import enum
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DataType(enum.Enum):
    """name, fixed width in bytes (0: variable), Spark type."""

    NULL = ("null", 0, T.NullType())
    BOOL = ("bool", 1, T.BooleanType())
    I8 = ("i8", 1, T.ByteType())
    I16 = ("i16", 2, T.ShortType())
    I32 = ("i32", 4, T.IntegerType())
    I64 = ("i64", 8, T.LongType())
    U8 = ("u8", 1, T.ShortType())
    U16 = ("u16", 2, T.IntegerType())
    U32 = ("u32", 4, T.LongType())
    U64 = ("u64", 8, T.DecimalType(20, 0))
    F32 = ("f32", 4, T.FloatType())
    F64 = ("f64", 8, T.DoubleType())
    STRING = ("string", 0, T.StringType())
    BYTES = ("bytes", 0, T.BinaryType())
    UUID = ("uuid", 16, T.StringType())

    def __init__(self, label: str, width: int, spark: T.DataType) -> None:
        self.label, self.width, self.spark = label, width, spark

    def __str__(self) -> str:
        return self.label

    @property
    def is_signed(self) -> bool:
        return self in (DataType.I8, DataType.I16, DataType.I32, DataType.I64)

    @property
    def is_unsigned(self) -> bool:
        return self in (DataType.U8, DataType.U16, DataType.U32, DataType.U64)

    @property
    def is_integer(self) -> bool:
        return self.is_signed or self.is_unsigned

    @property
    def is_float(self) -> bool:
        return self in (DataType.F32, DataType.F64)

    @property
    def is_numeric(self) -> bool:
        return self.is_integer or self.is_float

    @property
    def fixed_width(self) -> int | None:
        """Bytes of the payload; None for variable width and null."""
        return self.width or None

    @property
    def bounds(self) -> tuple[int, int]:
        """Least and largest value of an integer type."""
        bits = 8 * self.width
        return (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if self.is_signed else (0, (1 << bits) - 1)

    @staticmethod
    def named(label: str) -> DataType:
        return next(t for t in DataType if t.label == label)

    @staticmethod
    def of_spark(kind: T.DataType) -> DataType | None:
        """The logical type that a plain Spark column has; None if it has none."""
        signed = {T.ByteType: DataType.I8, T.ShortType: DataType.I16, T.IntegerType: DataType.I32, T.LongType: DataType.I64}
        rest = {T.NullType: DataType.NULL, T.BooleanType: DataType.BOOL, T.FloatType: DataType.F32, T.DoubleType: DataType.F64, T.StringType: DataType.STRING, T.BinaryType: DataType.BYTES}
        return (signed | rest).get(type(kind))


UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def guard(value: Column, kind: DataType) -> Column | None:
    """Whether a non-null value lies in its logical type; None where the Spark
    type alone says so."""
    if kind.is_unsigned:
        low, high = kind.bounds
        return (value >= F.lit(low)) & (value <= F.lit(Decimal(high)))
    if kind is DataType.UUID:
        return value.rlike(UUID_PATTERN)
    return None
