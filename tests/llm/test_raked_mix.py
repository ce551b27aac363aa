import pytest
from oracle import connection, same
from pyspark.sql import functions as F

from tabulon.llm import raked_mix as m


def test_query_equals_its_oracle(spark, sf_dir):
    same(m.op2_raked_mix(spark, sf_dir), connection(sf_dir), m.ORACLE)


def test_margins_are_met(spark):
    rows = [(s, lang, t, 10 + 7 * i) for i, (s, lang, t) in enumerate((s, lang, t) for s in "abc" for lang in ("x", "y") for t in ("p", "q"))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.2, "b": 0.5, "c": 0.3}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.5, "q": 0.5}}
    out = m.raked_weights(cells, targets).collect()
    total = sum(r["tokens"] * r["weight"] for r in out)
    for d, want in targets.items():
        for k, share in want.items():
            assert sum(r["tokens"] * r["weight"] for r in out if r[d] == k) / total == pytest.approx(share, abs=1e-9)
    assert max(r["probability"] for r in out) == 1.0


def test_too_many_cells_for_one_row_are_refused(spark, monkeypatch):
    monkeypatch.setattr(m, "ONE_ROW_CELLS", 3)
    cells = spark.range(5).selectExpr("string(id) AS source", "'x' AS lang", "'y' AS topic", "1L AS tokens")
    with pytest.raises(ValueError, match="cells"):
        m.raked_weights(cells)


def test_null_is_a_category_of_its_own(spark):
    """A text that looks like a marker of null is a text."""
    rows = [(1, "\0", "en", "a b"), (2, "x", "en", "a b c"), (3, None, "en", "a"), (4, "", None, "a"), (5, "null", "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    narrow = docs.select("doc_id", "source", "lang", m.topic_of(F.col("text")).alias("topic"), m.tokens_of(F.col("text")).alias("tokens"))
    for most in (m.MAX_CELLS, 2):
        with pytest.MonkeyPatch.context() as p:
            p.setattr(m, "MAX_CELLS", most)
            p.setattr(m, "ONE_ROW_CELLS", most)
            told = m.with_probability(narrow, m.fitted_weights(m.cells_of(narrow), rounds=3), {d: d for d in m.MARGINS}).collect()
        assert sorted((r["doc_id"], r["source"]) for r in told) == [(r[0], r[1]) for r in rows]
        assert all(r["_probability"] is not None and r["_probability"] > 0 for r in told)


def test_many_sources(spark):
    """20,500 sources: beyond the fold and beyond the broadcast."""
    docs = spark.range(41_000).selectExpr("id AS doc_id", "concat('s', id % 20500) AS source", "if(id % 3 = 0, 'x', 'y') AS lang", "'t' AS topic", "1 + id % 7 AS tokens")
    weights = m.fitted_weights(m.cells_of(docs), {"lang": {"x": 0.5, "y": 0.5}}, rounds=2)
    told = m.with_probability(docs, weights, {d: d for d in m.MARGINS})
    out = told.agg(F.count("_probability"), F.countDistinct("doc_id"), F.max("_probability")).first()
    assert tuple(out) == (41_000, 41_000, 1.0)


def test_unmet_targets_are_told(spark, monkeypatch):
    cells = spark.createDataFrame([("a", "x", "t", 5), ("b", "y", "t", 5)], "source string, lang string, topic string, tokens long")
    against = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}
    for most in (m.ONE_ROW_CELLS, 1):
        monkeypatch.setattr(m, "ONE_ROW_CELLS", most)
        with pytest.warns(UserWarning, match="not all met"):
            m.fitted_weights(cells, against, rounds=3)


def test_any_number_of_cells_is_fitted(spark, monkeypatch):
    rows = [(i, None if i % 7 == 0 else f"s{i % 7}", "xyz"[i % 3], "pq"[i % 2], 10 + i % 11 if i % 5 else 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")
    names = {d: d for d in m.MARGINS}

    def told():
        weights = m.fitted_weights(m.cells_of(docs), {"lang": {"x": 0.5, "y": 0.5}}, rounds=2)
        return {r["doc_id"]: r["_probability"] for r in m.with_probability(docs, weights, names).collect()}

    few = told()
    monkeypatch.setattr(m, "MAX_CELLS", 5)
    monkeypatch.setattr(m, "ONE_ROW_CELLS", 5)
    many = told()
    assert len(many) == 300 and many == pytest.approx(few, abs=1e-12)


def test_odd_rows(odd_documents, no_documents):
    kept = m.mixed(odd_documents)
    assert kept.columns == odd_documents.columns
    rows = kept.collect()
    assert len(rows) <= 12 and m.mixed(no_documents).collect() == []
    twins = [r for r in rows if r["doc_id"] == 2]
    assert len(twins) in (0, 2)
    assert [r["doc_id"] for r in m.mixed(odd_documents).orderBy("doc_id").collect()] == [r["doc_id"] for r in kept.orderBy("doc_id").collect()]


def test_topics(spark):
    df = spark.createDataFrame([("A License",), ("me@x.org",), ("in 1999",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(m.topic_of(F.col("t"))).collect()] == ["legal", "contact", "figures", "general", "general"]


def test_own_topics(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], "en", "w " * (1 + i % 5), "deep" if i % 2 else "wide") for i in range(200)], "doc_id long, source string, lang string, text string, subject string")
    kept = m.mixed(df, targets={"topic": {"deep": 0.9, "wide": 0.1}}, topic=F.col("subject")).collect()
    assert sum(r["subject"] == "deep" for r in kept) > 4 * sum(r["subject"] == "wide" for r in kept)


def test_clashing_columns_stay(clashing_documents):
    kept = m.mixed(clashing_documents)
    assert kept.columns == clashing_documents.columns
    rows = {repr(tuple(r)) for r in clashing_documents.collect()}
    assert all(repr(tuple(r)) in rows for r in kept.collect())
