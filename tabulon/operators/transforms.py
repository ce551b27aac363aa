"""Documented bulk transforms as column expressions inside generated code."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.types import DataType

WIDE = "decimal(38,0)"


def saturated(value: Column, kind: DataType) -> Column:
    """A wide integer held within a type."""
    low, high = kind.bounds
    wide = value.cast(WIDE)
    return F.greatest(F.lit(Decimal(low)), F.least(F.lit(Decimal(high)), wide)).cast(kind.spark)


def saturating_add(a: Column, b: Column, kind: DataType) -> Column:
    return saturated(a.cast("decimal(20,0)") + b.cast("decimal(20,0)"), kind)


def saturating_mul(a: Column, b: Column, kind: DataType) -> Column:
    return saturated(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"), kind)


def scale_bias(arg: Column, scale: Column | int, bias: Column | int, kind: DataType = DataType.U32) -> Column:
    scale = F.lit(scale) if isinstance(scale, int) else scale
    bias = F.lit(bias) if isinstance(bias, int) else bias
    return saturating_add(saturating_mul(arg, scale, kind), bias, kind)


def is_even(value: Column) -> Column:
    return value % 2 == 0


def price_total(qty: Column, price: Column, tax: Column) -> Column:
    """qty * price * (1 + tax / 100), in that order of double operations."""
    return qty.cast("double") * price * (F.lit(1.0) + tax / F.lit(100.0))


def price_plus_tax(qty: Column, price: Column, tax: Column) -> Column:
    return qty.cast("double") * price + tax


def square(arg: Column) -> Column:
    return arg.cast("long") * arg.cast("long")


def fibonacci(arg: Column, most: int = 90) -> Column:
    """The arg-th Fibonacci number (0, 1, 1, 2, ...) from a literal table."""
    row = [0, 1]
    while len(row) <= most:
        row.append(row[-1] + row[-2])
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in row]), arg.cast("int") + 1)
