import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tabulon.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def told(df):
    return {r["doc_id"]: tuple(r)[1:] for r in q.with_statistics(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}


def test_statistics_equal_brute_force(spark):
    rng = random.Random(6)
    texts = ["", None, "a", "a b", "a b c", "a a a a", "a b c a b c", "x\n\nx\n x\nx ", "😀 é # | <> 😀 é # | <>"]
    texts += ["".join(rng.choice(["a", "b", "c ", " ", "\n", "\x0b", "#", "é"]) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert told(df) == {i: brute(t) for i, t in enumerate(texts)}


def test_unequal_windows_of_one_hash(spark, monkeypatch):
    """Where window hashes collide, the windows themselves decide."""
    monkeypatch.setattr(q.F, "xxhash64", lambda *c: F.length(c[0]).cast("long") * F.lit(1 << 40))
    df = spark.createDataFrame([(1, "a b c a d e a b c q"), (2, "a b c d e f g")], "doc_id long, text string")
    assert {k: v[4] for k, v in told(df).items()} == {1: 6, 2: 0}


def test_learning():
    rng = random.Random(1)
    rows = []
    for i in range(600):
        r = {f: rng.random() for f in q.FEATURES}
        r["_label"] = 0 if (r["symbol_share"] > 0.8 and r["mean_word"] <= 0.5) or r["repeat_share"] > 0.95 else 1
        rows.append(r)
    rules = q.learn(rows)
    hit = [any(rule.holds(r) for rule in rules) for r in rows]
    bad = [r["_label"] == 0 for r in rows]
    assert rules and sum(h and b for h, b in zip(hit, bad, strict=True)) >= 0.75 * sum(bad)
    assert sum(h and not b for h, b in zip(hit, bad, strict=True)) <= 0.05 * sum(hit)
    assert q.learn([]) == [] and q.learn([r for r in rows if r["_label"] == 1]) == []


def test_verdict_is_ordered(spark):
    rules = [q.Rule((q.Condition("n_words", True, 5.0),), 0), q.Rule((q.Condition("n_words", True, 2.0), q.Condition("mean_word", False, 3.0)), 0)]
    df = spark.createDataFrame([(10, 1.0), (4, 1.0), (4, 9.0), (1, 1.0)], "n_words long, mean_word double")
    assert [tuple(r) for r in df.select(q.verdict(rules), q.fired(rules)).collect()] == [(0, 1), (0, 2), (1, 0), (1, 0)]
    assert df.select(q.verdict([])).first()[0] == 1


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 0), (1, None), (3, 1), (None, 0), (4, 1), (99, 0)], "doc_id long, quality int")
    rules = q.fit(odd_documents, labels)
    rows = q.judge(odd_documents, rules).select("doc_id", "text", "base_failed", "kept").collect()
    assert len(rows) == 12
    assert all(r["base_failed"] and not r["kept"] for r in rows if not r["text"] or len(r["text"]) < 40)
    assert q.judge(no_documents, rules).collect() == []
    assert q.fit(no_documents, labels) == []


def test_clashing_columns(spark, clashing_documents, odd_documents):
    """Outputs replace columns of their names; all other columns stay."""
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, quality int")
    rules = q.fit(clashing_documents, labels)
    out = q.judge(clashing_documents, rules)
    assert len(out.columns) == len(set(out.columns)) and set(out.columns) >= set(clashing_documents.columns)
    own = {*q.STATISTICS, *q.VERDICTS}
    rows = out.collect()
    assert all(r[n] == "mine" for r in rows for n in clashing_documents.columns[5:] if n not in own)
    narrow = odd_documents.select("doc_id", "text")
    same = lambda df: sorted((tuple(r) for r in df.select("doc_id", *sorted(own)).collect()), key=repr)
    assert same(out) == same(q.judge(narrow, rules))


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = q.op10_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        assert tuple(r)[1:6] == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    plan = q.op10_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
