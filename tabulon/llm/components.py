"""Connected components of an edge table, by alternating star steps.

Each round every node points its larger neighbours at its smallest one, then
itself and its smaller ones likewise, until only stars are left; the number of
rounds grows with the logarithm of the longest path. Edges stay in tables
written to the shared folder; nothing is gathered on the driver but a count and
a checksum for each round. Of at most SENT_EDGES edges (counted) a step's least
neighbours are broadcast; of more they are written before they are joined back, so
that both sides of the join come from plain exchanges and the rows of a hub, which
has neighbours without bound, can be split over tasks (adaptive skew join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.shared import written


#: Edges (16 bytes each) up to which a step broadcasts, and the files of such tables.
SENT_EDGES, FEW_FILES = 200_000, 8


def _toward_least(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the component's least node) for every node that has an
    edge. edges has a and b (longs); loops and repeats are allowed."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    few = e.limit(SENT_EDGES + 1).count() <= SENT_EDGES  # no step adds an edge
    meant = lambda least: F.broadcast(least) if few else written(least, "least")
    kept = lambda df, name: written(df.coalesce(FEW_FILES) if few else df, name)
    before = None
    for _ in range(rounds):
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = sym.where("v > u").join(meant(_toward_least(sym)), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = kept(large, "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        least = least if few else written(least, "least")
        small = large.join(F.broadcast(least) if few else least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = kept(small.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
