import random
from itertools import combinations

import numpy as np
import pytest

from tabulon.llm import gapped_toxicity as g


def brute_kernel(s, t):
    def features(x):
        out = {}
        for c in combinations(range(len(x)), g.LENGTH):
            k = tuple(x[i] for i in c)
            out[k] = out.get(k, 0.0) + g.DECAY ** (c[-1] - c[0] + 1)
        return out

    a, b = features(s), features(t)
    dot = lambda p, q: sum(v * q.get(k, 0.0) for k, v in p.items())
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))


def test_kernel_equals_brute_force():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(3, 9))) for _ in range(25)]
    got = g.kernel(words, words[:6])
    want = np.array([[brute_kernel(s, t) for t in words[:6]] for s in words])
    assert np.allclose(got, want, atol=1e-4)


def test_folded_machine_is_the_kernel_machine():
    landmarks, alpha = ["^idiot$", "^trash$", "^hello$"], np.array([1.0, 0.5, -2.0])
    words = ["^idxiot$", "^trashy$", "^zzz$", "^hallo$"]
    want = g.kernel(words, landmarks) @ alpha - 0.25
    assert np.allclose(g.fold(landmarks, alpha, -0.25).word_scores(words), want, atol=1e-4)


def corpus(n=240, seed=2):
    rng = random.Random(seed)
    letters = ["ka", "lo", "mi", "ten", "ra", "su", "vel", "or", "pin", "da"]
    clean = ["".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(400)]
    bad = ["blighter", "scoundrel", "nitwit", "dunderhead"]
    rows = []
    for i in range(n):
        w = rng.choices(clean, k=40)
        toxic = i % 3 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_learns_and_tolerates(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    blob = g.fit(docs, labels)
    told = {r["doc_id"]: r["predicted"] for r in g.score_documents(docs, blob).collect()}
    assert sum(told[i] == y for i, _, y in rows) >= 0.98 * len(rows)
    machine = g._ready(blob)
    bent = g.text_scores(["kalo sco.undrel mi", "you dund-erhead", "n i t w i t", "scounxdrel", "kalo mi ten"], machine)
    assert (bent[:4] >= g.THRESHOLD).all() and bent[4] < g.THRESHOLD


def test_long_words_are_scored_whole():
    assert "".join(g.units("a" * 100)).count("a") >= 100
    assert g.units("...") == []


@pytest.mark.parametrize("toxic", [[], [0, 0], [1, 1]])
def test_one_label_learns_nothing(toxic):
    machine = g.train(["some words here"] * len(toxic), toxic)
    assert (g.text_scores(["some words here", None, ""], machine) < g.THRESHOLD).all()


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    blob = g.fit(odd_documents, labels)
    told = g.score_documents(odd_documents, blob).collect()
    assert len(told) == 12 and all(0 <= r["score"] <= 1 for r in told) and told[0]["kept"] == 2
    by = {}
    for r in told:
        by.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by.values())
    assert g.score_documents(no_documents, blob).collect() == []
    assert len(g.score_documents(odd_documents, g.fit(no_documents, labels.limit(0))).collect()) == 12


def test_an_insult_far_into_a_text_is_learned(spark):
    """Every insult stands after 100,000 clean characters, other ones in each text."""
    rows, rng = corpus(150), random.Random(8)
    letters = ["ka", "lo", "mi", "ten", "ra", "su", "vel", "or", "pin", "da"]

    def far():
        own = ["".join(rng.choices(letters, k=rng.randint(2, 4))) for _ in range(300)]
        return " ".join(rng.choices(own, k=16_000))[:100_000].rsplit(" ", 1)[0]

    docs = spark.createDataFrame([(i, f"{far()} {t}") for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    machine = g._ready(g.fit(docs, labels))
    assert (g.text_scores(["kalo scoundrel mi", "nitwit", "dunderhead ten"], machine) >= g.THRESHOLD).all()
    assert (g.text_scores([far(), "kalo mi ten"], machine) < g.THRESHOLD).all()


def test_clashing_columns(clashing_documents):
    out = g.score_documents(clashing_documents, __import__("pickle").dumps(g.nothing_learned()))
    assert sorted(out.columns) == sorted(clashing_documents.columns)
    assert all(r[n] == "mine" for r in out.collect() for n in clashing_documents.columns[5:] if n not in ("score", "predicted"))


def test_query(spark):
    """Held-out documents of a larger table, where there is one."""
    import os

    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    told = g.op6_gapped_toxicity(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    assert told.columns == ["doc_id", "held_out", "score", "predicted"] and told.count() == docs.count()
    rows = told.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    seen = [r for r in rows if not r["held_out"]]
    assert sum(r["predicted"] for r in seen if r["toxic"]) >= 0.7 * sum(r["toxic"] for r in seen)
    held = [r for r in rows if r["held_out"] and not r["toxic"]]
    assert sum(r["predicted"] for r in held) <= 0.1 * len(held)
    again = {r["doc_id"]: r["score"] for r in g.op6_gapped_toxicity(spark, d).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)
    assert told.where(F.col("score").isNull()).isEmpty()
