"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is over the UTF-8 bytes of lower-case text, of order ``ORDER``. A symbol
is a byte and one bit, whether its word has so far been the word before it over
again; so a context of some bytes also sees the word before, and words said over
and over are as unlikely as they are in trusted text. An n-gram is its symbols
packed into one long, so counts are exact. Counts are taken
over every trusted text (partial sums in each task, then one shuffle). Each
order's table is then sharded by context and joined with its context's totals
and with the next lower order's probabilities; lower orders count distinct
predecessors. Discounts come from each order's counts of counts.

Scoring joins texts with the model. Where the model has at most
``LOOKUP_ROWS`` rows (checked by counting) it is sent to the workers as hash
tables and texts are looked up where they lie. Beyond, the distinct n-grams of
each text, with counts, are joined with the sharded tables, order by order for
those that are missing, and summed for each text. Logarithms are whole multiples
of 1 / UNIT, so sums do not depend on their order and both ways give the very same
perplexities.

A text is kept if its perplexity is at most ``SLACK`` times its language's
``QUANTILE`` quantile over trusted texts. A quarter of the trusted texts, by hash
of the id, is never counted and gives the quantiles, for texts that were counted
look easier than they are; a language without such texts uses all its trusted
ones, and without any the set-aside texts of all languages.

Defined results: null or empty text has a null perplexity and is not kept; a
null language is a language of its own; repeated rows score alike; without
trusted texts every perplexity is that of even symbols and all texts that have one
are kept; an empty table gives an empty result; other columns are passed over,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.shared import bounded_batches, row_of, table, unpacked, written

ORDER = 6
QUANTILE, SLACK = 0.995, 1.2
#: Bits of a symbol: a byte, and whether its word repeats the one before so far.
BITS = 9
SYMBOLS = 1 << BITS
#: Parts of one in a logarithm.
UNIT = 1 << 20
LOOKUP_ROWS = 6_000_000
#: Trusted ids are sent to the readers of texts up to this many; beyond, they are joined.
SENT_IDS = 2_000_000


def repeats(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each byte's word has been, from its start to that byte, the word
    before it in the same text. Words end at white space or at a text's zero byte,
    and that byte tells of the whole word."""
    ends = np.flatnonzero((flat == 0) | (flat == 32) | ((flat >= 9) & (flat <= 13)))
    first = np.concatenate([[0], ends[:-1] + 1])  # where each word starts
    sizes = ends - first + 1
    before = np.concatenate([[0], first[:-1]])
    fresh = np.isin(first, starts, assume_unique=False)  # a text's first word has none before
    plain = flat.copy()
    plain[ends] = 32
    word = np.repeat(np.arange(len(ends)), sizes)
    into = np.arange(len(flat)) - first[word]
    # a place beyond the word before is in the word itself, and is a mismatch already at that word's end
    unlike = (plain[before[word] + into] != plain) | fresh[word]
    run = np.cumsum(unlike)
    return run - (run[first] - unlike[first])[word] == 0


def packed(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The top-order n-gram ending at each byte and at each text's end (a zero
    byte; zeros stand before the start), and the texts' first places."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols = flat.astype(np.uint64) | (repeats(flat, starts[:-1]).astype(np.uint64) << np.uint64(8))
    into = np.arange(len(flat)) - np.repeat(starts[:-1], sizes)
    keys = symbols.copy()
    for back in range(1, order):
        shifted = np.zeros_like(symbols)
        shifted[back:] = symbols[:-back]
        shifted[into < back] = 0
        keys |= shifted << np.uint64(BITS * back)
    return keys, starts


def as_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").replace(b"\0", b" ")


def ngram_counts(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """key and count of every top-order n-gram of the whole texts."""
    bounded_batches(trusted.sparkSession)

    def counted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        for pdf in batches:
            texts = [as_bytes(t) for t in pdf["text"] if t]
            if texts:
                held.append(np.unique(packed(texts, order)[0], return_counts=True))
                if len(held) >= 8:
                    held = [merged()]
                if len(held[0][0]) > 2_000_000:  # what one task holds stays bounded
                    keys, n = merged()
                    yield pd.DataFrame({"key": keys.astype(np.int64), "n": n})
                    held = []
        if held:
            keys, n = merged()
            yield pd.DataFrame({"key": keys.astype(np.int64), "n": n})

    return trusted.select("text").mapInPandas(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """For orders 1 to ``order``: key, p, and the key's discount class summed by
    context: (key, ctx, p, back), where back is the weight of the next lower
    order in that context."""
    tables = [counts]
    for n in range(order - 1, 0, -1):
        low = F.col("key").bitwiseAND(F.lit((1 << (BITS * n)) - 1))
        tables.append(written(tables[-1].groupBy(low.alias("key")).agg(F.count(F.lit(1)).alias("n")), f"lm-counts-{n}"))
    out: list[DataFrame] = []
    for n, own in enumerate(reversed(tables), 1):
        c = {i: v for i, v in enumerate(own.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first())}
        n1, n2, n3, n4 = (max(1, c[i]) for i in range(4))
        y = n1 / (n1 + 2 * n2)
        d1, d2, d3 = (min(float(k), max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        discount = F.when(F.col("n") == 1, F.lit(d1)).when(F.col("n") == 2, F.lit(d2)).otherwise(F.lit(d3))
        ctx = F.call_function("shiftright", F.col("key"), F.lit(BITS))
        told = own.select("key", ctx.alias("ctx"), F.col("n").cast("double").alias("n"), discount.alias("d"))
        classes = [F.count(F.when(F.col("n") == i, 1)) for i in (1.0, 2.0)] + [F.count(F.when(F.col("n") > 2, 1))]
        held = F.lit(d1) * classes[0] + F.lit(d2) * classes[1] + F.lit(d3) * classes[2]
        totals = told.groupBy("ctx").agg(F.sum("n").alias("total"), held.alias("held"))
        joined = told.join(totals, "ctx").withColumn("back", F.col("held") / F.col("total"))
        if n == 1:
            lower: Column = F.lit(1.0 / SYMBOLS)
        else:
            below = out[-1].select(F.col("key").alias("_low"), F.col("p").alias("_p"))
            joined = joined.join(below, F.col("key").bitwiseAND(F.lit((1 << (BITS * (n - 1))) - 1)) == F.col("_low"))
            lower = F.col("_p")
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("back") * lower
        out.append(written(joined.select("key", "ctx", p.alias("p"), "back"), f"lm-order-{n}"))
    return out


@dataclass
class HashTable:
    """Long keys to ints, open addressing, looked up many at a time."""

    keys: np.ndarray
    values: np.ndarray
    shift: int

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> HashTable:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) / 0.7))))
        table_, held = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        made = HashTable(table_, held, 64 - bits)
        at, left = made.home(keys), np.arange(len(keys))
        while len(left):
            free = table_[at] == -1
            spot, first = np.unique(at[free], return_index=True)
            who = left[free][first]
            table_[spot], held[spot] = keys[who], values[who]
            stay = np.ones(len(left), bool)
            stay[np.flatnonzero(free)[first]] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << bits) - 1)
        return made

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are there."""
        at = self.home(keys)
        found = self.keys[at]
        there = found == keys
        out = np.where(there, self.values[at], np.int32(0))
        left = np.flatnonzero(~there & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            now = self.keys[at[left]]
            hit = now == keys[left]
            there[left[hit]] = True
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (now != -1)]
        return out, there


#: For each order, lowest first: keys with log p, and contexts with log back.
Raw = list[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]
Model = list[tuple[HashTable, HashTable]]
_made: list = [None, None]


def made(raw: Raw) -> Model:
    """The hash tables of a model, made once in each worker: the driver holds and
    sends keys and values alone."""
    if _made[0] is not raw:
        _made[:] = raw, [(HashTable.of(*p), HashTable.of(*back)) for p, back in raw]
    return _made[1]


def units(value: str) -> Column:
    """The logarithm of a column in units; at least that of 2**-1000 or so."""
    return F.round(F.log(value) * F.lit(float(UNIT))).cast("int")


EVEN = round(float(np.log(1 / SYMBOLS)) * UNIT)


def lookup_model(orders: list[DataFrame]) -> Raw:
    """log p by key and log back by context, lowest order first."""
    def held(df: DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        rows = df.select(key, units(value).alias("v")).toArrow()  # twelve bytes a row
        return rows[key].to_numpy(), rows["v"].to_numpy()

    return [(held(df, "key", "p"), held(df.groupBy("ctx").agg(F.first("back").alias("back")), "ctx", "back")) for df in orders]


def log_probability(keys: np.ndarray, model: Model) -> np.ndarray:
    """log p of each top-order n-gram, in units; those missing fall back order by order."""
    out = np.zeros(len(keys), np.int64)
    left, now = np.arange(len(keys)), keys.astype(np.int64)
    for n in range(len(model), 0, -1):
        values, there = model[n - 1][0].get(now)
        out[left[there]] += values[there]
        left, now = left[~there], now[~there]
        if not len(left):
            return out
        back, _ = model[n - 1][1].get(now >> BITS)
        out[left] += back  # 0 for a context never seen
        now = now & ((1 << (BITS * (n - 1))) - 1)
    out[left] += EVEN
    return out


def perplexity(total: str, count: str) -> Column:
    return F.exp(-F.col(total) / (F.col(count) * F.lit(float(UNIT))))


def by_lookup(docs: DataFrame, model: Raw) -> DataFrame:
    """docs (with ``_text``) and ``perplexity``, from tables held by the workers."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held, top = spark.sparkContext.broadcast(model), len(model)

    @F.pandas_udf("s long, n long")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            there = np.array([isinstance(t, str) and t != "" for t in texts], bool)
            out = np.zeros((2, len(texts)), np.int64)
            if there.any():
                keys, starts = packed([as_bytes(t) for t in texts[there]], top)
                out[:, there] = np.add.reduceat(log_probability(keys, made(held.value)), starts[:-1]), np.diff(starts)
            yield pd.DataFrame({"s": out[0], "n": out[1]})

    told = docs.withColumn("_sum", scored(F.col("_text")))
    return told.withColumn("perplexity", F.when(F.col("_sum.n") > 0, perplexity("_sum.s", "_sum.n"))).drop("_sum")


def by_joins(docs: DataFrame, orders: list[DataFrame]) -> DataFrame:
    """As ``by_lookup``, from joins of each text's distinct n-grams with the sharded
    tables. Rows with equal doc_id and text share one perplexity."""
    bounded_batches(docs.sparkSession)
    top = len(orders)

    def spread(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text_hash, text in zip(pdf["doc"], pdf["hash"], pdf["_text"], strict=True):
                if text:
                    keys, n = np.unique(packed([as_bytes(text)], top)[0], return_counts=True)
                    yield pd.DataFrame({"doc": doc, "hash": text_hash, "key": keys.astype(np.int64), "n": n.astype(np.int64)})

    # a text is known by two hashes of its id and itself: fewer bytes in every join, and no nulls
    keyed = docs.withColumn("doc", F.xxhash64(F.lit(1), "doc_id", "_text")).withColumn("hash", F.xxhash64(F.lit(2), "doc_id", "_text"))
    left = keyed.select("doc", "hash", "_text").dropDuplicates(["doc", "hash"]).mapInPandas(spread, "doc long, hash long, key long, n long").withColumn("logp", F.lit(0).cast("long"))
    done = None
    for n in range(top, 0, -1):
        own = orders[n - 1]
        # written, for both what is found and what is missing are read from it
        joined = written(left.join(own.select("key", units("p").alias("_p")), "key", "left"), f"lm-met-{n}")
        hits = joined.where(F.col("_p").isNotNull()).select("doc", "hash", (F.col("n") * (F.col("logp") + F.col("_p"))).alias("s"), "n")
        done = hits if done is None else done.unionByName(hits)
        backs = own.groupBy(F.col("ctx").alias("_ctx")).agg(F.first(units("back")).alias("_back"))
        ctx = F.call_function("shiftright", F.col("key"), F.lit(BITS))
        missing = joined.where(F.col("_p").isNull()).join(backs, ctx == F.col("_ctx"), "left")
        left = missing.select("doc", "hash", F.col("key").bitwiseAND(F.lit((1 << (BITS * (n - 1))) - 1)).alias("key"), "n", (F.col("logp") + F.coalesce(F.col("_back"), F.lit(0))).alias("logp"))
    rest = left.select("doc", "hash", (F.col("n") * (F.col("logp") + F.lit(EVEN))).alias("s"), "n")
    sums = done.unionByName(rest).groupBy("doc", "hash").agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))
    told = keyed.join(sums, ["doc", "hash"], "left").withColumn("perplexity", perplexity("_s", "_n"))
    return told.drop("doc", "hash", "_s", "_n")


def with_perplexity(docs: DataFrame, trusted: DataFrame, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """docs (doc_id, text, ...) with the perplexity of each whole text under the
    model of the trusted texts."""
    orders = probabilities(written(ngram_counts(trusted), "lm-counts"))
    rows = docs.select(row_of(docs, "perplexity"), "doc_id", F.col("text").alias("_text"))
    few = sum(df.count() for df in orders) <= lookup_rows
    return unpacked(by_lookup(rows, lookup_model(orders)) if few else by_joins(rows, orders), "perplexity")


def trusted_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of trusted ids; these are sent to the readers of texts where they
    are at most SENT_IDS, so texts are not shuffled."""
    ids = written(ids.select("doc_id").distinct(), "trusted")
    small = ids.count() <= SENT_IDS
    return docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def set_aside(doc_id: Column) -> Column:
    """The trusted texts that give quantiles and are not counted."""
    return F.crc32(F.encode(F.concat(F.lit("lm"), doc_id.cast("string")), "UTF-8")) % 4 == 0


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """lang and its limit: of its set-aside texts, else of its trusted ones, else
    of those of all languages."""
    aside = F.when(F.col("trusted") & set_aside(F.col("doc_id")), F.col("perplexity"))
    sure = F.when(F.col("trusted"), F.col("perplexity"))
    level = lambda of: F.percentile_approx(of, quantile, 10_000) * F.lit(SLACK)
    everywhere = scored.agg(F.coalesce(level(aside), level(sure)).alias("_all"))
    own = scored.groupBy("lang").agg(F.coalesce(level(aside), level(sure)).alias("_own"), F.max("perplexity").alias("_max"))
    # without a trusted text at all there is no limit but the largest
    return own.join(F.broadcast(everywhere)).select("lang", F.coalesce("_own", "_all", "_max").alias("most"))


def judged(docs: DataFrame, ids: DataFrame, quantile: float = QUANTILE, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """doc_id, lang, perplexity, trusted, most and kept for docs (doc_id, text,
    lang)."""
    docs = docs.select("doc_id", "text", "lang")
    scored = with_perplexity(docs, trusted_texts(docs, ids.where(~set_aside(F.col("doc_id")))), lookup_rows).drop("text")
    flags = ids.select(F.col("doc_id").alias("_id")).distinct().withColumn("trusted", F.lit(True))
    narrow = written(scored.join(flags, F.col("doc_id") == F.col("_id"), "left").drop("_id").withColumn("trusted", F.coalesce("trusted", F.lit(False))), "perplexity")
    limits = thresholds(narrow, quantile).withColumnRenamed("lang", "_lang")
    told = narrow.join(limits, narrow["lang"].eqNullSafe(F.col("_lang")), "left").drop("_lang")
    return told.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("most"), F.lit(False)))


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity and verdict; documents labelled of good
    quality are trusted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    ids = table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    return judged(docs, ids).select("doc_id", "lang", "perplexity", F.col("most").alias("threshold"), "trusted", "kept")
