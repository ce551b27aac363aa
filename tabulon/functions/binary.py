"""Functions on BINARY columns: hex, search, and fixed-layout reads and writes.

A read that reaches past the end fails the query, where Spark's substring would
give fewer bytes. Only float bits need Python: Spark has no cast between bits and
floats, so those go through Arrow in batches."""

from __future__ import annotations

import enum
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.errors import BinaryError
from tabulon.types import DataType


class Endian(enum.Enum):
    BIG = "big"
    LITTLE = "little"
    NATIVE = "little" if np.little_endian else "big"

    @property
    def is_little(self) -> bool:
        return self.value == "little"


def _decimal(value: int) -> Column:
    return F.lit(Decimal(value))


def hex_encode(data: Column) -> Column:
    return F.lower(F.hex(data))


def hex_encode_upper(data: Column) -> Column:
    return F.hex(data)


def hex_decode(text: Column) -> Column:
    """Bytes of an even number of digits of either case; anything else is an error."""
    good = text.rlike(r"^([0-9A-Fa-f]{2})*\z")
    return F.when(text.isNotNull(), F.when(good, F.unhex(text)).otherwise(F.raise_error("not hexadecimal").cast("binary")))


def hex_decode_bytes(text: str) -> bytes:
    if len(text) % 2 or not all(c in "0123456789abcdefABCDEF" for c in text):
        raise BinaryError.InvalidHex()
    return bytes.fromhex(text)


def _latin(data: Column) -> Column:
    """One character for each byte, so that text search counts bytes."""
    return F.decode(data, "ISO-8859-1")


def find(haystack: Column, needle: Column, offset: int | Column = 0) -> Column:
    """Place of the first match at or after offset, null if there is none; an
    empty needle is found at the offset if that is within the bytes."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    at = F.call_function("locate", _latin(needle), _latin(haystack), offset + 1) - 1
    empty = F.when(offset <= F.octet_length(haystack), offset)
    return F.when(F.octet_length(needle) == 0, empty).when(at >= 0, at).cast("long")


def rfind(haystack: Column, needle: Column) -> Column:
    """Place of the last match, null if there is none; an empty needle gives the length."""
    at = F.call_function("locate", F.reverse(_latin(needle)), F.reverse(_latin(haystack)))
    last = F.when(at > 0, F.octet_length(haystack) - at - F.octet_length(needle) + 1)
    return F.when(F.octet_length(needle) == 0, F.octet_length(haystack)).otherwise(last).cast("long")


def read_exact(data: Column, offset: int | Column, size: int | Column) -> Column:
    """That many bytes at a place; past the end is an error."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    size = F.lit(size) if isinstance(size, int) else size
    inside = (offset >= 0) & (size >= 0) & (offset.cast("long") + size.cast("long") <= F.octet_length(data))
    message = F.concat(size.cast("string"), F.lit(" bytes at "), offset.cast("string"), F.lit(" of "), F.octet_length(data).cast("string"))
    return F.when(data.isNotNull(), F.when(inside, F.substring(data, offset + 1, size)).otherwise(F.raise_error(message).cast("binary")))


def swapped(part: Column, width: int) -> Column:
    """Bytes in reverse. Spark's reverse takes bytes for UTF-8 text, so they are
    put together one by one."""
    return F.concat(*[F.substring(part, i, 1) for i in range(width, 0, -1)])


def read_integer(data: Column, offset: int | Column, kind: DataType, endian: Endian = Endian.BIG) -> Column:
    """An integer of any width and sign, in its Spark type."""
    part = read_exact(data, offset, kind.width)
    digits = F.hex(swapped(part, kind.width) if endian.is_little else part)
    if kind is DataType.I64:
        return F.conv(digits, 16, -10).cast("long")
    plain = F.conv(digits, 16, 10).cast("decimal(20,0)")
    if kind.is_signed:
        low, high = kind.bounds
        plain = F.when(plain > F.lit(high), plain - _decimal(1 << (8 * kind.width))).otherwise(plain)
    return plain.cast(kind.spark)


def read_float(data: Column, offset: int | Column, kind: DataType, endian: Endian = Endian.BIG) -> Column:
    """A float of the exact bits."""
    layout = f"{'<' if endian.is_little else '>'}f{kind.width}"

    @F.pandas_udf(kind.spark)
    def bits(parts: pd.Series) -> pd.Series:
        there = parts.notna().to_numpy()
        out = np.full(len(parts), np.nan)
        out[there] = np.frombuffer(b"".join(parts[there]), layout)
        return pd.Series(out).astype("Float64").where(there, pd.NA) if not there.all() else pd.Series(out)

    return bits(read_exact(data, offset, kind.width))


def read_bytes_u32(data: Column, offset: int | Column = 0, endian: Endian = Endian.BIG) -> Column:
    """Payload after a four-byte length."""
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return read_exact(data, offset + 4, read_integer(data, offset, DataType.U32, endian).cast("int"))


def read_str_u32(data: Column, offset: int | Column = 0, endian: Endian = Endian.BIG) -> Column:
    return F.validate_utf8(read_bytes_u32(data, offset, endian).cast("string"))


def write_integer(value: Column, kind: DataType, endian: Endian = Endian.BIG) -> Column:
    """The bytes of an integer; one that is out of range fails the query."""
    low, high = kind.bounds
    wide = value.cast("decimal(20,0)")
    inside = (wide >= _decimal(low)) & (wide <= _decimal(high))
    plain = F.when(wide < 0, wide + _decimal(1 << (8 * kind.width))).otherwise(wide)
    out = F.unhex(F.lpad(F.conv(plain.cast("string"), 10, 16), 2 * kind.width, "0"))
    out = swapped(out, kind.width) if endian.is_little else out
    return F.when(value.isNotNull(), F.when(inside, out).otherwise(F.raise_error(f"value does not fit {kind}").cast("binary")))


def write_float(value: Column, kind: DataType, endian: Endian = Endian.BIG) -> Column:
    layout = f"{'<' if endian.is_little else '>'}f{kind.width}"

    @F.pandas_udf("binary")
    def bits(values: pd.Series) -> pd.Series:
        data = values.to_numpy(dtype=layout, na_value=np.nan).tobytes()
        cells = [data[i : i + kind.width] for i in range(0, len(data), kind.width)]
        return pd.Series([c if there else None for c, there in zip(cells, values.notna(), strict=True)])

    return bits(value)


def write_bytes_u32(payload: Column, endian: Endian = Endian.BIG) -> Column:
    return F.concat(write_integer(F.octet_length(payload), DataType.U32, endian), payload)


def write_str_u32(text: Column, endian: Endian = Endian.BIG) -> Column:
    return write_bytes_u32(F.encode(text, "UTF-8"), endian)
