"""Sharding by Hilbert curve: native SQL only.

Several metadata dimensions are quantised to ``2**bits`` cells each, every row
gets its cell's index on the Hilbert curve, rows are ranked along the curve and
the ranking is cut into runs of equal length. Rows near each other in all
dimensions share a shard, so min/max statistics of a shard's files prune on
every dimension.

A dimension is a number or a text. Numbers are cut at their quantiles. Of a text
dimension the distinct values are counted, over all rows, and it is cut at whole
values of even weight, compared as strings, however long a prefix they share.

The global rank takes no global sort. Cells are counted (at most
``2**(bits * dims)`` rows, a fixed bound), a cell's rows are dealt over as many
buckets as its count asks for, and a row's rank is the offset of its cell, plus
the offset of its bucket, plus its number in the bucket. A hot cell is many
buckets, and rows that are equal in all columns are dealt by their place in the
written table, so no task holds one key's rows.

Defined results: a null dimension sorts with the lowest values; null text counts
no bytes and has a null checksum; repeated rows each get a slot of their own; an
empty table gives an empty result; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.shared import table, written

#: Rows of one cell that share a bucket, about; and buckets of a cell at most, for
#: their counts are summed in one task.
BUCKET_ROWS, CELL_BUCKETS = 512, 1 << 16
#: Distinct texts of a dimension up to which the driver sums their rows; more are
#: summed in ranges, by the same rule.
BOUND_VALUES = 20_000


def text_bounds(rows: DataFrame, name: str, cells: int) -> list[str]:
    """At most cells - 1 values that cut the rows' texts into parts of even weight."""
    counts = written(rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_n")), "texts").withColumnRenamed(name, "_v")
    if counts.limit(BOUND_VALUES + 1).count() > BOUND_VALUES:
        return many_bounds(counts, cells)
    values = sorted((r["_v"].encode("utf-8", "surrogatepass"), r["_n"]) for r in counts.collect())
    total, seen, out = sum(n for _, n in values), 0, []
    for v, n in values:
        # a value that fills a part or more ends that part
        before, seen = seen * cells // max(1, total), seen + n
        if seen * cells // max(1, total) > before and seen < total:
            out.append(v.decode("utf-8", "surrogatepass"))
    return out


def many_bounds(counts: DataFrame, cells: int) -> list[str]:
    """The same cuts of any number of distinct texts (_v) and their rows (_n): ranges of
    texts are summed, then texts within their range. Spark orders texts by their bytes."""
    parts = max(2, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(counts.repartitionByRange(parts, "_v").withColumn("_range", F.spark_partition_id()), "text-ranges")
    sums = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.sum("_n").alias("n")).collect())
    total = sum(n for _, n in sums)
    starts = [(r, sum(n for _, n in sums[:i])) for i, (r, _) in enumerate(sums)]
    known = F.broadcast(counts.sparkSession.createDataFrame(starts, "_range int, _start long"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = ranged.join(known, "_range").withColumn("_before", F.col("_start") + before).withColumn("_seen", F.col("_before") + F.col("_n"))
    cut = summed.where(F.expr(f"(_seen * {cells}L) div {total}L > (_before * {cells}L) div {total}L and _seen < {total}L"))
    return [r["_v"] for r in cut.select("_v", "_seen").orderBy("_seen").collect()]


def quantised(value: Column, bounds: list) -> Column:
    """How many bounds lie under the value; bounds are at most 2**bits - 1 values."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value))


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of len(coords) dimensions of ``bits`` bits, by
    the transpose form: undo excess work from the high bit down, Gray-encode,
    then interleave. One array is folded, so the expression stays small."""
    dims = len(coords)
    if dims * bits > 62:
        raise ValueError("bits * dimensions must be at most 62")
    start = F.array(*[c.cast("long") for c in coords])
    steps = [(1 << q, i) for q in range(bits - 1, 0, -1) for i in range(dims)]

    def turn(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        low, mine = q - F.lit(1), F.get(x, i)
        swap = F.get(x, F.lit(0)).bitwiseXOR(mine).bitwiseAND(low)
        flip = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        swapped = F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(mine.bitwiseAND(q) != 0, flip).otherwise(swapped)

    def fold(items: list[Column], zero: Column, step) -> Column:
        return F.aggregate(F.array(*items), zero, step) if items else zero

    pairs = [F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in steps]
    turned = fold(pairs, start, turn)
    gray = F.transform(turned, lambda _, j: F.aggregate(F.slice(turned, 1, j + 1), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))
    powers = [F.lit(1 << q).cast("long") for q in range(bits - 1, 0, -1)]

    def finish(x: Column) -> Column:
        last = F.get(x, F.lit(dims - 1))
        mask = fold(powers, F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - F.lit(1))).otherwise(t))
        spots = [F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dims)]
        return fold(spots, F.lit(0).cast("long"), lambda acc, s: F.shiftleft(acc, 1).bitwiseOR(F.call_function("shiftright", F.get(x, s["i"]).bitwiseXOR(mask), s["b"]).bitwiseAND(F.lit(1).cast("long"))))

    return F.get(F.transform(F.array(gray), finish), F.lit(0))


def hilbert_shards(rows: DataFrame, dims: list[str], n_shards: int, bits: int = 5, tie: tuple[str, ...] = ()) -> DataFrame:
    """rows with ``hilbert``, ``shard`` (0 to n_shards - 1) and ``slot`` (gapless
    from 0). ``dims`` are columns of numbers or texts; ``tie`` orders rows within a
    bucket. Shard sizes are at most one row apart. rows is read several times and
    should be a narrow written table."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    cells = 1 << bits
    parts = [i / cells for i in range(1, cells)]
    texts = [d for d in dims if dict(rows.dtypes)[d] == "string"]
    asked = rows.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(d, parts, 10_000).alias(f"b{i}") for i, d in enumerate(dims) if d not in texts]).first()
    n = asked["n"]
    bounds = [text_bounds(rows, d, cells) if d in texts else sorted(set(asked[f"b{i}"] or [])) for i, d in enumerate(dims)]
    # written, for three passes follow and the index is their dearest part
    index = hilbert_index([quantised(F.col(d), b) for d, b in zip(dims, bounds, strict=True)], bits)
    placed = written(rows.withColumn("hilbert", index).withColumn("_place", F.monotonically_increasing_id()), "hilbert")
    counts = placed.groupBy("hilbert").agg(F.count(F.lit(1)).alias("_rows"))
    along = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    buckets = F.ceil(F.col("_rows") / F.greatest(F.lit(BUCKET_ROWS), F.ceil(F.col("_rows") / F.lit(CELL_BUCKETS))))
    cell = counts.select("hilbert", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_cell_from"), buckets.alias("_buckets"))
    # at most 2**(bits * dims) rows of three longs
    if (1 << (bits * len(dims))) * 24 <= 8 << 20:
        cell = F.broadcast(cell)
    dealt = placed.join(cell, "hilbert").withColumn("_bucket", F.pmod(F.xxhash64(*tie, "_place"), F.col("_buckets")))
    within = Window.partitionBy("hilbert").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("hilbert", "_bucket").agg(F.count(F.lit(1)).alias("_n")).select("hilbert", "_bucket", F.coalesce(F.sum("_n").over(within), F.lit(0)).alias("_bucket_from"))
    number = F.row_number().over(Window.partitionBy("hilbert", "_bucket").orderBy(*tie, "_place"))
    ranked = dealt.withColumn("_number", number).join(offsets, ["hilbert", "_bucket"])
    rank = F.col("_cell_from") + F.col("_bucket_from") + F.col("_number") - F.lit(1)
    out = ranked.withColumn("_rank", rank.cast("long")).withColumn("shard", F.expr(f"cast((_rank * {n_shards}L) div {max(n, 1)}L as int)"))
    return out.withColumn("slot", F.expr(f"_rank - ((shard * {n}L + {n_shards - 1}L) div {n_shards}L)")).drop("_cell_from", "_buckets", "_bucket", "_bucket_from", "_number", "_rank", "_place")


def write_shards(rows: DataFrame, shards: DataFrame, key: str, path: str) -> None:
    """rows written as one folder per shard, each in curve order."""
    placed = rows.join(shards.select(key, "shard", "slot"), key)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards along the curve of source, language and size.
    Law: ``rows``."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(16).cast("long")
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
        F.col("source").alias("_source"),
        F.col("lang").alias("_lang"),
    )
    placed = hilbert_shards(written(narrow, "shard-rows"), ["_source", "_lang", "size"], 40, tie=("doc_id", "text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
