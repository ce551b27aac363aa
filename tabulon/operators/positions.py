"""Contiguous row positions from 0, in the order of a key, without a global sort.

Bounds are taken from a bounded choice of keys; a row's bucket is the number of
bounds at or under its key, found by halving, so buckets are in key order and fixed
literals decide them, however often a lost executor's rows are computed again. A
row's position is the count of rows in earlier buckets plus its number in its
bucket. There are at most MOST_BUCKETS; of larger tables buckets are larger, and
each is one sort that can spill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS = "_pos"
#: Rows of a bucket, about; and keys looked at for each bound.
BUCKET_ROWS, KEYS_A_BOUND, MOST_BUCKETS = 100_000, 16, 4096


def bounds_under(bounds: list[Column], key: Column) -> Column:
    """How many of the ascending bounds are at or under the key: one comparison for
    each bit of their number."""
    if not bounds:
        return F.lit(0)
    held = F.array(*bounds)
    steps = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)]

    def halve(low: Column, step: Column) -> Column:
        return F.when(F.coalesce(F.get(held, low + step - 1) <= key, F.lit(False)), low + step).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve)


def with_positions(df: DataFrame, order: list[str], bucket_rows: int = BUCKET_ROWS, rows: int | None = None) -> DataFrame:
    """df with _pos. ``order`` should tell all rows apart; rows it does not are
    numbered in no fixed order. ``rows`` is df's count where it is known."""
    rows = df.count() if rows is None else rows
    buckets = min(MOST_BUCKETS, -(-rows // bucket_rows))
    if buckets <= 1:
        return df.withColumn(POS, F.row_number().over(Window.orderBy(*order)).cast("long") - F.lit(1))
    key = F.struct(*order)
    wanted = buckets * KEYS_A_BOUND
    every = max(1, rows // (4 * wanted))
    chosen = [r["k"] for r in df.select(key.alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).limit(8 * wanted).collect()]
    fields = dict(df.select(*order).dtypes)

    def low(k) -> tuple:
        return tuple((v is not None, v) for v in k)

    chosen.sort(key=low)
    picks = [chosen[len(chosen) * i // buckets] for i in range(1, buckets)] if chosen else []
    bounds = [F.struct(*[F.lit(v).cast(fields[c]).alias(c) for c, v in zip(order, p, strict=True)]) for p in dict.fromkeys(map(tuple, picks))]
    placed = df.withColumn("_bucket", bounds_under(bounds, key))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most MOST_BUCKETS rows
    offsets = placed.groupBy("_bucket").count().select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return placed.withColumn("_number", number).join(F.broadcast(offsets), "_bucket").withColumn(POS, F.col("_before") + F.col("_number") - F.lit(1)).drop("_bucket", "_before", "_number")


def by_position(df: DataFrame) -> DataFrame:
    return df.orderBy(POS)


def shifted(df: DataFrame, by: int | Column) -> DataFrame:
    return df.withColumn(POS, F.col(POS) + by)
