"""Dynamically typed scalars: a logical type and a Python payload."""

from __future__ import annotations

import math
import struct
import uuid
from dataclasses import dataclass
from decimal import Decimal

from tabulon.errors import ValueConversionError
from tabulon.types import DataType


@dataclass(frozen=True)
class Value:
    """Equal only if type and payload are; NaN equals nothing."""

    data_type: DataType
    payload: object = None

    def __post_init__(self) -> None:
        t, p = self.data_type, self.payload
        if t.is_integer:
            low, high = t.bounds
            if isinstance(p, bool) or not isinstance(p, int):
                raise ValueConversionError.TypeMismatch(expected=str(t), actual=type(p).__name__)
            if not low <= p <= high:
                raise ValueConversionError.OutOfRange(value=p, target=str(t))
        elif t is DataType.F32:
            object.__setattr__(self, "payload", struct.unpack("<f", struct.pack("<f", p))[0])
        elif t is DataType.F64:
            object.__setattr__(self, "payload", float(p))
        elif t is DataType.UUID:
            object.__setattr__(self, "payload", str(uuid.UUID(str(p))))

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Value) or self.data_type is not other.data_type:
            return False
        if isinstance(self.payload, float) and math.isnan(self.payload):
            return False
        return self.payload == other.payload

    def __hash__(self) -> int:
        return hash((self.data_type, self.payload))

    @staticmethod
    def of(raw: object) -> Value:
        """The value that a plain Python scalar stands for."""
        if isinstance(raw, Value):
            return raw
        if raw is None:
            return NULL
        if isinstance(raw, bool):
            return Value(DataType.BOOL, raw)
        if isinstance(raw, int):
            return Value(DataType.I64 if -(1 << 63) <= raw < 1 << 63 else DataType.U64, raw)
        if isinstance(raw, float):
            return Value(DataType.F64, raw)
        if isinstance(raw, str):
            return Value(DataType.STRING, raw)
        if isinstance(raw, (bytes, bytearray)):
            return Value(DataType.BYTES, bytes(raw))
        if isinstance(raw, uuid.UUID):
            return Value(DataType.UUID, str(raw))
        raise ValueConversionError.TypeMismatch(expected="a scalar", actual=type(raw).__name__)

    @property
    def is_null(self) -> bool:
        return self.data_type is DataType.NULL

    def _only(self, *kinds: DataType) -> object:
        if self.data_type not in kinds:
            raise ValueConversionError.TypeMismatch(expected=" or ".join(map(str, kinds)), actual=str(self.data_type))
        return self.payload

    def to_i64(self) -> int:
        """Any integer; floats, booleans and text are refused."""
        if not self.data_type.is_integer:
            raise ValueConversionError.TypeMismatch(expected="integer", actual=str(self.data_type))
        if self.payload > DataType.I64.bounds[1]:
            raise ValueConversionError.OutOfRange(value=self.payload, target="i64")
        return self.payload

    def to_f64(self) -> float:
        """Any number, rounded if need be."""
        if not self.data_type.is_numeric:
            raise ValueConversionError.TypeMismatch(expected="number", actual=str(self.data_type))
        return float(self.payload)

    def as_str(self) -> str:
        return self._only(DataType.STRING)

    def as_bytes(self) -> bytes:
        return self._only(DataType.BYTES)

    def as_bool(self) -> bool:
        return self._only(DataType.BOOL)

    def spark(self) -> object:
        """The payload as Spark's types hold it."""
        return Decimal(self.payload) if self.data_type is DataType.U64 else self.payload


NULL = Value(DataType.NULL)


def fits(raw: object, kind: DataType) -> bool:
    """Whether a cell value belongs to a column type. A Value must have that very
    type; a plain Python scalar has no width and must lie in the type's range."""
    if isinstance(raw, Value):
        return raw.data_type is kind
    if kind is DataType.NULL:
        return False
    try:
        if kind.is_integer:
            low, high = kind.bounds
            return isinstance(raw, int) and not isinstance(raw, bool) and low <= raw <= high
        if kind.is_float:
            return isinstance(raw, float)
        if kind is DataType.UUID:
            return isinstance(raw, (uuid.UUID, str)) and bool(uuid.UUID(str(raw)))
    except ValueError:
        return False
    return isinstance(raw, {DataType.BOOL: bool, DataType.STRING: str, DataType.BYTES: (bytes, bytearray)}[kind])


def to_spark(raw: object, kind: DataType) -> object:
    """A checked cell value as Spark's column holds it; null stays None."""
    if isinstance(raw, Value):
        return raw.spark()
    return None if raw is None else Value(kind, raw).spark()


def from_spark(raw: object, kind: DataType) -> Value:
    if raw is None:
        return NULL
    if kind is DataType.U64:
        return Value(kind, int(raw))
    return Value(kind, bytes(raw) if kind is DataType.BYTES else raw)
