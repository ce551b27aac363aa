"""Folds over columns as aggregate expressions: one pass, partial sums first."""

from __future__ import annotations


from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.types import DataType


def total(c: str) -> Column:
    return F.sum(c)


def average(c: str, kind: DataType) -> Column:
    """Integers are summed exactly, whatever their width; floats in double."""
    if kind.is_integer:
        total = F.sum(F.col(c).cast("decimal(38,0)")) if kind is DataType.U64 else _long_total(F.col(c).cast("long"))
        return (total.cast("double") / F.count(c)).cast("double")
    return F.avg(F.col(c).cast("double"))


def _long_total(v: Column) -> Column:
    """The exact sum of longs as a decimal, from sums of three parts of their bits;
    no part's sum overflows before 2**41 rows."""
    wide = lambda x: x.cast("decimal(38,0)")
    mask = F.lit((1 << 22) - 1).cast("long")
    high, middle, low = F.sum(F.shiftright(v, 44)), F.sum(F.shiftright(v, 22).bitwiseAND(mask)), F.sum(v.bitwiseAND(mask))
    return wide(high) * F.lit(1 << 44).cast("decimal(15,0)") + wide(middle) * F.lit(1 << 22).cast("decimal(8,0)") + wide(low)


def maximum(c: str, kind: DataType) -> Column:
    """NaN never wins; null if there is no value."""
    return F.max(F.when(~F.isnan(c), F.col(c))) if kind.is_float else F.max(c)


def minimum(c: str, kind: DataType) -> Column:
    return F.min(F.when(~F.isnan(c), F.col(c))) if kind.is_float else F.min(c)


def seeded_maximum(c: str, kind: DataType) -> Column:
    """The maximum; where there is no value, the least of the type."""
    seed = F.lit(float("-inf")) if kind.is_float else F.lit(kind.bounds[0])
    return F.coalesce(maximum(c, kind), seed.cast(kind.spark))


def median(c: str) -> Column:
    """Exact; of an even number, the mean of the two in the middle."""
    return F.median(c)


def distinct_keys(c: str) -> Column:
    return F.countDistinct(c)


#: Distinct values (estimated) up to which a median is one aggregate, which holds each
#: of them with its count in one task; beyond, the search below is used.
SMALL = 200_000


def medians(frame: DataFrame, columns: list[str], small: int = SMALL) -> dict[str, float | None]:
    """Exact medians of columns of any size.

    Sketches of fixed size bracket the middle ranks, one pass counts what lies at
    and under the bracket's ends, and brackets shrink until few enough values are
    left to sort."""
    return searched(frame, columns, frame.agg(*sizes(columns)).first(), small)


def sizes(columns: list[str]) -> list[Column]:
    """What the choice of a way to the median needs: counts, and estimates of distinct values."""
    return [f for c in columns for f in (F.count(c).alias(f"n_{c}"), F.approx_count_distinct(c).alias(f"d_{c}"))]


def searched(frame: DataFrame, columns: list[str], told, small: int) -> dict[str, float | None]:
    out: dict[str, float | None] = {c: None for c in columns if not told[f"n_{c}"]}
    few = [c for c in columns if told[f"n_{c}"] and told[f"d_{c}"] <= small]
    if few:
        out |= frame.agg(*[F.median(c).alias(c) for c in few]).first().asDict()
    many = [c for c in columns if told[f"n_{c}"] and c not in few]
    sought = [Rank(c, k, told[f"n_{c}"]) for c in many for k in dict.fromkeys(((told[f"n_{c}"] - 1) // 2, told[f"n_{c}"] // 2))]
    select_ranks(frame, sought, small)
    for c in many:
        found = [float(r.value) for r in sought if r.column == c]
        out[c] = sum(found) / len(found)
    return out


@dataclass
class Rank:
    """The search for the rank-th value of a column (from 0): it lies strictly
    between two bounds, with ``under`` values at or below the lower one and
    ``held`` between them."""

    column: str
    rank: int
    held: int
    under: int = 0
    low: object = None
    high: object = None
    value: object = None

    def inside(self) -> Column:
        c = F.col(self.column)
        ok = c.isNotNull()
        if self.low is not None:
            ok = ok & (c > F.lit(self.low))
        return ok & (c < F.lit(self.high)) if self.high is not None else ok

    def narrow(self, a, b, lt_a: int, le_a: int, lt_b: int, le_b: int) -> None:
        """Two values within, and how many within lie under and up to each."""
        at = self.rank - self.under
        if at < lt_a:
            self.high, self.held = a, lt_a
        elif at < le_a:
            self.value = a
        elif at < lt_b:
            self.low, self.high, self.under, self.held = a, b, self.under + le_a, lt_b - le_a
        elif at < le_b:
            self.value = b
        else:
            self.low, self.under, self.held = b, self.under + le_b, self.held - le_b


def select_ranks(frame: DataFrame, sought: list[Rank], small: int) -> None:
    """Finds every rank's value. A round drops its bracket's ends, ties and all,
    so it ends however the values are spread."""
    while open_ := [r for r in sought if r.value is None]:
        few = [r for r in open_ if r.held <= small]
        if few:
            values = [F.element_at(F.sort_array(F.collect_list(F.when(r.inside(), F.col(r.column)))), r.rank - r.under + 1) for r in few]
            for r, v in zip(few, frame.agg(*[v.alias(f"v{i}") for i, v in enumerate(values)]).first(), strict=True):
                r.value = v
        # ranks of one bracket, the two of an even number, share its sketch and counts
        wide: dict[tuple, list[Rank]] = {}
        for r in open_:
            if r.value is None:
                wide.setdefault((r.column, r.low, r.high), []).append(r)
        if not wide:
            return
        asked = []
        for i, group in enumerate(wide.values()):
            r = group[0]
            first, last, gap = min(x.rank for x in group) - r.under, max(x.rank for x in group) - r.under, r.held / 1_000 + 1
            shares = [min(1.0, max(0.0, (first - gap) / r.held)), min(1.0, (last + gap) / r.held)]
            asked.append(F.percentile_approx(F.when(r.inside(), F.col(r.column)), shares, 2_000).alias(f"p{i}"))
        ends = frame.agg(*asked).first()
        counted = []
        for i, group in enumerate(wide.values()):
            r = group[0]
            c = F.col(r.column)
            for name, end in (("a", ends[i][0]), ("b", ends[i][1])):
                counted += [F.count(F.when(r.inside() & (c < F.lit(end)), 1)).alias(f"lt{name}{i}"), F.count(F.when(r.inside() & (c <= F.lit(end)), 1)).alias(f"le{name}{i}")]
        told = frame.agg(*counted).first()
        for i, group in enumerate(wide.values()):
            for r in group:
                r.narrow(ends[i][0], ends[i][1], told[f"lta{i}"], told[f"lea{i}"], told[f"ltb{i}"], told[f"leb{i}"])


def median_frame(frame: DataFrame, names: dict[str, str], small: int = SMALL) -> DataFrame:
    """One row with the exact median of each column under a name."""
    found = medians(frame, list(names), small)
    return frame.sparkSession.range(1).select(*[F.lit(found[c]).cast("double").alias(n) for c, n in names.items()])


def summary(frame: DataFrame, columns: dict[str, DataType], small: int = SMALL) -> DataFrame:
    """average, minimum, maximum and median of each column: one aggregation, one for
    the medians of columns with few distinct values, and the search for the others."""
    told = []
    for c, kind in columns.items():
        told += [average(c, kind).alias(f"{c}_avg"), minimum(c, kind).alias(f"{c}_min"), maximum(c, kind).alias(f"{c}_max")]
    names = list(columns)
    first = frame.agg(*told, *sizes(names)).first()
    found = searched(frame, names, first, small)
    kept = [f.alias(f"{c}_{what}") for c in columns for what, f in (("avg", F.lit(first[f"{c}_avg"]).cast("double")), ("min", F.lit(first[f"{c}_min"]).cast(frame.schema[c].dataType)), ("max", F.lit(first[f"{c}_max"]).cast(frame.schema[c].dataType)), ("median", F.lit(found[c]).cast("double")))]
    return frame.sparkSession.range(1).select(*kept)


def run_between(values, least: int, most: int, low: int, high: int) -> tuple[int, int, int]:
    """The sum of a run of values, and where it leaves two sums that it began at
    ``least`` and ``most``, each held between low and high at every step. Runs that
    touch one end alone are reckoned by running minima, others step by step."""
    import numpy as np

    exact = [int(v) for v in values]
    total = sum(exact)

    def above(start: int, sums) -> int | None:
        """Where a sum goes that is held at 0 from below and may not pass the width."""
        if start + min(0, int(sums.min())) >= 0:
            return start + int(sums[-1]) if start + int(sums.max()) <= high - low else None
        path = sums + start
        path = path - np.minimum.accumulate(np.minimum(path, 0))
        return int(path[-1]) if int(path.max()) <= high - low else None

    up = down = None
    if sum(map(abs, exact)) < 1 << 62:
        sums = np.cumsum(np.array(exact, np.int64))
        up, down = above(least - low, sums), above(high - most, -sums)
    if up is None or down is None:
        for v in exact:
            least, most = max(low, min(high, least + v)), max(low, min(high, most + v))
        return total, least, most
    return total, low + up, high - down


def fold_saturating(frame: DataFrame, c: str, kind: DataType, start: int = 0, order: str = "_pos") -> int:
    """start plus each value in turn, held within the type at every step.

    A run of rows acts on the sum as ``clamp(s + shift, low, high)``; such maps
    compose, so partitions are reduced apart and only one map for each partition
    reaches the driver, however many rows there are."""
    low, high = kind.bounds
    spark_rows = frame.where(F.col(c).isNotNull()).select(F.col(order).alias("o"), F.col(c).cast("decimal(38,0)").alias("v"))
    sums = spark_rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").alias("s")).first()
    if sums["s"] is None:
        return start
    if sums["lo"] >= 0 or sums["hi"] <= 0:  # one sign: steps and end saturate alike
        return int(max(low, min(high, start + int(sums["s"]))))

    def reduce_part(batches):
        import pandas as pd

        shift, least, most, first = 0, low, high, None
        for pdf in batches:
            if len(pdf):
                first = int(pdf["o"].iloc[0]) if first is None else first
                moved, least, most = run_between(pdf["v"].to_numpy(), least, most, low, high)
                shift += moved
        if first is not None:
            yield pd.DataFrame({"first": [first], "shift": [str(shift)], "least": [str(least)], "most": [str(most)]})

    parts = spark_rows.repartitionByRange("o").sortWithinPartitions("o").mapInPandas(reduce_part, "first long, shift string, least string, most string").collect()
    out = start
    for p in sorted(parts, key=lambda r: r["first"]):
        out = max(int(p["least"]), min(int(p["most"]), out + int(p["shift"])))
    return out


