"""Nearest neighbours from randomly rotated one-bit codes.

A vector is normalised, rotated by a fixed random orthogonal matrix and kept as
one sign bit per dimension, with two correction scalars: its norm and its
agreement with its own code. The inner product with a rotated query is then
estimated from the packed bits as ``norm * <code, query> / agreement``, and the
error of the estimate is at most ``norm * |query| * eps * sqrt((1 - agreement^2)
/ agreement^2) / sqrt(d - 1)`` but for a chance that ``eps`` sets. The SEEDS * k best
estimates are scored exactly, and the k-th best of them is a floor under the k-th
best score; a vector is read again only if its upper bound reaches that floor, and
is then scored exactly, in double precision.

The query set goes against all rows in blocks: vectors are dealt to blocks in
turn, queries to sets by hash of their id, and each meeting of a block with a set
is one task's group of bounded size, which gives at most k rows per query. A
ranking window, cut to k rows before and after its shuffle, merges them. More rows
are more blocks, never larger ones.

A vector travels once for each set of queries, in the precision it is stored in;
its code is worked out where it arrives. Codes alone do not travel in its place:
the vectors at hand do not cluster, bounds of one bit a dimension leave a good
part of all pairs to be scored exactly (README has the figures), and a join by id
would then ship more than the vectors.

Defined results: vectors that are null, zero, of another length than ``dims``
or hold null or non-finite components take no part, neither as queries nor as
candidates; a null id likewise; equal vectors tie and the smaller id is first; a
repeated id is a candidate once for each row, but not for the query of its id;
with fewer than k candidates all are given; an empty table gives no rows; other
columns are passed over.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.shared import table

#: Rows of a block of vectors, and of a set of queries, about. Blocks are smaller,
#: down to LEAST_VECTORS, where they are fewer than two for each core.
BLOCK_VECTORS, LEAST_VECTORS, BLOCK_QUERIES = 32_768, 4_096, 16_384
#: Bound in standard errors of the estimate.
EPS = 3.5
#: Times k, how many of the best estimates give the floor.
SEEDS = 12
#: Share of a block that survives its bounds from which products are one matrix.
MANY = 0.05
SEED = 20260101


@lru_cache(maxsize=8)
def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return np.ascontiguousarray(q * np.sign(np.diag(r)))


def codes(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms, and agreements of the rows of ``vectors``."""
    norms = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norms[:, None]) @ turn
    bits = turned > 0
    agreement = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(bits, axis=1), norms, agreement


@lru_cache(maxsize=1)
def byte_signs() -> np.ndarray:
    """The eight signs of each byte's bits."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return bits.astype(np.float32) * 2 - 1


def estimates(packed: np.ndarray, norms: np.ndarray, agreement: np.ndarray, queries: np.ndarray, turn: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries by vectors) and their error bounds.

    Signs are unpacked for one block only; dims must be a multiple of 8 there,
    padded dimensions have zero in the query."""
    dims = queries.shape[1]
    width = packed.shape[1] * 8
    turned = np.zeros((len(queries), width), np.float32)
    turned[:, :dims] = queries @ turn
    signs = byte_signs()[packed].reshape(len(packed), width)
    scale = (norms / (agreement * np.sqrt(dims))).astype(np.float32)
    error = norms * eps * np.sqrt(np.maximum(1 - agreement**2, 0)) / agreement / np.sqrt(max(dims - 1, 1))
    lengths = np.linalg.norm(queries, axis=1)
    return (turned @ signs.T) * scale[None, :], (lengths[:, None] * error[None, :]).astype(np.float32)


def exact_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed from the first component to the last, so that a pair
    has one score whatever block it is in."""
    return np.add.accumulate(vectors * query, axis=1)[:, -1]


def survivors(high: np.ndarray, floor: float, best: np.ndarray) -> np.ndarray:
    """Places whose upper bound reaches the floor, and those of the best estimates."""
    read = high >= floor - 1e-6 * (1 + abs(floor))
    read[best] = True
    return np.flatnonzero(read)


def block_best(vid: np.ndarray, vectors: np.ndarray, qid: np.ndarray, queries: np.ndarray, k: int, eps: float, step: int = 64) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, vector ids, exact scores) of each query's k best of a block. Where
    many survive, their products are one matrix product for a step's queries."""
    turn = rotation(vectors.shape[1])
    packed, norms, agreement = codes(vectors, turn)
    out, share = [], 0.0
    for at in range(0, len(qid), step):
        few = queries[at : at + step]
        guess, error = estimates(packed, norms, agreement, few, turn, eps)
        guess[vid[None, :] == qid[at : at + step, None]] = -np.inf
        products = few @ vectors.T if share > MANY else None
        read = 0
        for i in range(len(guess)):
            q, high = few[i], guess[i] + error[i]
            dots = (lambda x: products[i][x]) if products is not None else (lambda x: vectors[x] @ q)  # noqa: B023
            others = np.isfinite(guess[i])
            if others.sum() > SEEDS * k:
                best = np.argpartition(-guess[i], SEEDS * k)[: SEEDS * k]
                picked = survivors(high, np.partition(dots(best), -k)[-k], best)
            else:
                picked = np.flatnonzero(others)
            read += len(picked)
            rough = dots(picked)
            if len(picked) > k:  # all that rounding could put among the k
                picked = picked[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * (1 + np.abs(rough).max())]
            scores = exact_products(vectors[picked], q)
            order = np.lexsort((vid[picked], -scores))[:k]
            picked, scores = picked[order], scores[order]
            out.append((np.full(len(picked), qid[at + i]), vid[picked], scores))
        share = read / max(1, guess.size)
    return out


def usable(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """Rows that take part, with the vector as doubles."""
    v = F.col(vector)
    sound = v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(sound)


def nearest(rows: DataFrame, queries: DataFrame, k: int, dims: int, eps: float = EPS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows by inner
    product. rows and queries have vec_id and embedding."""
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["embedding"]
    rows = usable(rows.where(F.col("vec_id").isNotNull()).select("vec_id", "embedding"), "embedding", dims)
    queries = usable(queries.where(F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast(kind).alias("embedding")), "embedding", dims)
    n, m = rows.count(), queries.count()
    cores = spark.sparkContext.defaultParallelism
    blocks, sets = max(1, -(-n // BLOCK_VECTORS), min(-(-n // LEAST_VECTORS), 2 * cores)), max(1, -(-m // BLOCK_QUERIES))
    # each vector meets every set of queries, each query every block: one row per meeting
    left = rows.select(F.lit(True).alias("is_row"), "vec_id", "embedding", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"))
    right = queries.select(F.lit(False).alias("is_row"), "vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(sets)).cast("int").alias("set"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["is_row"].to_numpy()
        v, q = pdf[side], pdf[~side]
        if v.empty or q.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        stacked = lambda df: np.stack(df["embedding"].to_numpy()).astype(np.float64)
        found = block_best(v["vec_id"].to_numpy(), stacked(v), q["vec_id"].to_numpy(), stacked(q), k, eps)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    met = left.unionByName(right).groupBy("block", "set").applyInPandas(meet, "query_id long, vec_id long, score double")
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_one_bit_neighbours(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """The 20 nearest vectors of every 20th, by inner product."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    dims = rows.where(F.col("embedding").isNotNull()).agg(F.mode(F.size("embedding")).alias("d")).first()["d"] or 1
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k, dims)


ORACLE = """
WITH d AS (SELECT mode(len(embedding)) AS n FROM embeddings),
v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings, d
  WHERE vec_id IS NOT NULL AND len(embedding) = n AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
r AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
n AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM r)
SELECT * FROM n WHERE rank <= 20
"""
