from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import kneser_ney_quality as k


def symbols(text):
    """Bytes, each with whether its word is the word before so far; straight from the definition."""
    out, now, before = [], b"", None
    for b in k.as_bytes(text) + b"\0":
        ends = b in b"\0 \t\n\v\f\r"
        now += b" " if ends else bytes([b])
        out.append((b, before is not None and before.startswith(now)))
        if ends:
            now, before = b"", now
    return tuple(out)


def test_repeated_words_are_seen():
    texts = ["a an an and and an", "der der derb der\tder ", "", " ", "  x x", "é é ê ê", "ab ab\nab"]
    flat = b"\0".join(map(k.as_bytes, texts)) + b"\0"
    starts = np.cumsum([0] + [len(k.as_bytes(t)) + 1 for t in texts])[:-1]
    got = list(k.repeats(np.frombuffer(flat, np.uint8), starts))
    assert got == [r for t in texts for _, r in symbols(t)]


def brute_probability(texts, order):
    """Interpolated modified Kneser-Ney straight from its definition."""
    top = Counter()
    for t in texts:
        data = ((0, False),) * (order - 1) + symbols(t)
        top.update(data[i : i + order] for i in range(len(data) - order + 1))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts, total, held = {}, defaultdict(float), defaultdict(float)
    for n, c in counts.items():
        n1, n2, n3, n4 = (max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        discounts[n] = [min(float(j), max(0.05, j - (j + 1) * y * b / a)) for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        for g, v in c.items():
            total[g[:-1], n] += v
            held[g[:-1], n] += discounts[n][min(v, 3) - 1]

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 512
        ctx = (g[:-1], n)
        if total[ctx] == 0:
            return p(g[1:])
        v = counts[n][g]
        own = max(v - discounts[n][min(v, 3) - 1], 0) if v else 0
        return own / total[ctx] + held[ctx] / total[ctx] * p(g[1:])

    return p


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "Été, naïve: 12 cats"]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "zebra quiz", "the cat"])], "doc_id long, text string")
    p = brute_probability(TEXTS, k.ORDER)
    trusted = docs.where("doc_id < 4")
    both = []
    for rows in (k.LOOKUP_ROWS, 0):
        got = {r["doc_id"]: r["perplexity"] for r in k.with_perplexity(docs, trusted, rows).collect()}
        for i, t in enumerate([*TEXTS, "zebra quiz", "the cat"]):
            data = ((0, False),) * (k.ORDER - 1) + symbols(t)
            logs = [np.log(p(data[j : j + k.ORDER])) for j in range(len(data) - k.ORDER + 1)]
            assert got[i] == pytest.approx(np.exp(-np.mean(logs)), rel=1e-4)
        both.append(got)
    assert both[0] == both[1]  # to the last bit


def test_hash_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**40, 5000))
    t = k.HashTable.of(keys, np.arange(len(keys)).astype(np.int32))
    values, there = t.get(np.concatenate([keys, keys + (1 << 41)]))
    assert there[: len(keys)].all() and not there[len(keys) :].any() and (values[: len(keys)] == np.arange(len(keys))).all()


def test_odd_rows(spark, odd_documents, no_documents):
    docs = odd_documents.select("doc_id", "text", "lang", "hilbert")
    ids = spark.createDataFrame([(1,), (1,), (7,), (99,), (None,)], "doc_id long")
    a = sorted((tuple(r) for r in k.judged(docs, ids).select("doc_id", "lang", "kept").collect()), key=repr)
    b = sorted((tuple(r) for r in k.judged(docs, ids, lookup_rows=0).select("doc_id", "lang", "kept").collect()), key=repr)
    assert a == b and len(a) == 12
    empty = {r["doc_id"]: r for r in k.judged(docs, ids).collect()}
    assert not empty[4]["kept"] and empty[4]["perplexity"] is None and not empty[5]["kept"]
    nothing = k.judged(docs, ids.limit(0)).collect()
    assert all(r["kept"] == (r["perplexity"] is not None) for r in nothing)
    assert k.judged(no_documents.select("doc_id", "text", "lang"), ids).collect() == []


def test_language_without_set_aside_texts_has_a_limit(spark):
    ids = spark.range(200).select("id", k.set_aside(F.col("id")).alias("aside")).collect()
    aside, counted = ([r["id"] for r in ids if r["aside"] == v] for v in (True, False))
    rows = [(i, 10.0, "en", True) for i in aside[:20]] + [(counted[0], 20.0, "de", True), (counted[1], 900.0, "de", False), (counted[2], 11.0, None, False), (counted[3], 900.0, None, False)]
    scored = spark.createDataFrame(rows, "doc_id long, perplexity double, lang string, trusted boolean")
    assert {r["lang"]: r["most"] for r in k.thresholds(scored).collect()} == pytest.approx({"en": 12.0, "de": 24.0, None: 12.0})


def test_query_keeps_good_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = k.op7_kneser_ney_quality(spark, sf_dir).join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["perplexity"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good)
    assert not bad or np.median(bad) > np.median([r["perplexity"] for r in rows if r["quality"] == 1])


def test_clashing_columns(spark, clashing_documents, odd_documents):
    ids = spark.createDataFrame([(1,), (7,)], "doc_id long")
    same = lambda df, **x: sorted((tuple(r) for r in k.judged(df, ids, **x).collect()), key=repr)
    assert same(clashing_documents) == same(odd_documents) == same(clashing_documents, lookup_rows=0)
    out = k.with_perplexity(clashing_documents, clashing_documents.where("doc_id = 1"))
    assert sorted(out.columns) == sorted(clashing_documents.columns)
    assert all(r[n] == "mine" for r in out.collect() for n in clashing_documents.columns[5:] if n != "perplexity")


def test_words_said_over_and_over_go(spark):
    good = [f"word{(i * 7 + j * j) % 31} and other{(i + j) % 17} things{j % 5}" for i in range(120) for j in (0, 3)]
    rows = [(i, t, "en") for i, t in enumerate(" ".join(good[i : i + 30]) for i in range(200))] + [(900, "word3 " * 200, "en"), (901, "%& " * 200, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = {r["doc_id"]: r["kept"] for r in k.judged(docs, docs.where("doc_id < 200").select("doc_id")).collect()}
    assert not told[900] and not told[901] and sum(told.values()) >= 195
