import itertools
import zlib

from pyspark.sql import functions as F

from tabulon.llm import hilbert_shards as h


def indexes(spark, dims, bits):
    side = range(1 << bits)
    points = list(itertools.product(side, repeat=dims))
    names = [f"x{i}" for i in range(dims)]
    df = spark.createDataFrame(points, ", ".join(f"{n} long" for n in names))
    return {tuple(r[:dims]): r[dims] for r in df.select(*names, h.hilbert_index([F.col(n) for n in names], bits)).collect()}


def test_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2), (3, 3)):
        found = indexes(spark, dims, bits)
        order = sorted(found, key=found.get)
        assert sorted(found.values()) == list(range(1 << (dims * bits)))
        assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(order))


def check(rows, n_shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(i, ())) for i in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(n_shards))


def test_query_holds_its_law(spark, sf_dir):
    import pyarrow.parquet as pq

    rows = h.op1_hilbert_shards(spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    check(rows, 40)
    assert len(rows) == len(docs)
    assert all(r["size"] == len(docs[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) and r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    firsts = sorted((r["shard"], r["slot"], r["hilbert"]) for r in rows)
    assert [x[2] for x in firsts] == sorted(x[2] for x in firsts)


def test_hot_cell_is_cut(spark, monkeypatch):
    monkeypatch.setattr(h, "BUCKET_ROWS", 16)
    rows = spark.range(1000).selectExpr("id AS doc_id", "if(id < 900, 1L, id) AS a", "id % 3 AS b")
    check(h.hilbert_shards(rows, ["a", "b"], 7, tie=("doc_id",)).collect(), 7)


def test_odd_rows(spark, odd_documents, no_documents):
    for docs, n in ((odd_documents, 12), (no_documents, 0)):
        narrow = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), F.col("source").alias("s"))
        rows = h.hilbert_shards(narrow, ["s", "size"], 5, tie=("doc_id", "size")).collect()
        check(rows, 5)
        assert len(rows) == n


def test_files_prune(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS doc_id", "id % 20 AS a", "id div 20 AS b")
    shards = h.hilbert_shards(rows, ["a", "b"], 4, bits=3, tie=("doc_id",))
    h.write_shards(rows, shards, "doc_id", str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    spans = back.groupBy("shard").agg((F.max("a") - F.min("a")).alias("w"), (F.max("b") - F.min("b")).alias("h")).collect()
    assert back.count() == 400 and len(spans) == 4 and all(r["w"] < 19 or r["h"] < 19 for r in spans)


def test_texts_with_a_common_prefix(spark):
    """A source dimension of addresses: twenty shared bytes, and still files prune."""
    rows = spark.range(640).selectExpr("id AS doc_id", "concat('https://www.example.', char(97 + id % 16)) AS source", "id AS size")
    assert h.text_bounds(rows, "source", 16) == [f"https://www.example.{chr(97 + i)}" for i in range(15)]
    out = h.hilbert_shards(rows, ["source", "size"], 16, bits=4, tie=("doc_id",)).collect()
    check(out, 16)
    held = [{r["source"] for r in out if r["shard"] == i} for i in range(16)]
    assert max(map(len, held)) <= 8


def test_text_bounds(spark, monkeypatch):
    rows = spark.createDataFrame([("a",)] * 50 + [("b",)] * 2 + [("é",)] * 2 + [(None,)] * 9, "s string")
    assert h.text_bounds(rows, "s", 4) == ["a"] and h.text_bounds(rows.limit(0), "s", 4) == []
    monkeypatch.setattr(h, "BOUND_VALUES", 40)
    many = spark.range(5000).selectExpr("concat('v', lpad(id, 5, '0')) AS s")
    cuts = h.text_bounds(many, "s", 4)
    assert len(cuts) == 3 and all(abs(int(c[1:]) - 1250 * i) < 800 for i, c in enumerate(cuts, 1))


def test_equal_rows_are_dealt(spark):
    """100,000 rows equal in all columns: many buckets, none of them large."""
    rows = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0L AS size", "CAST(NULL AS STRING) AS s")
    out = h.hilbert_shards(rows, ["s", "size"], 40, tie=("doc_id", "size"))
    check(out.select("shard", "slot").collect(), 40)
    window = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "pmod(xxhash64(" in x and "_place" in x]
    assert window


def test_query_equals_brute_force(spark, sf_dir):
    """The whole assignment: cells by counting values, the curve from a table that is
    checked to visit neighbours, runs of the order along it."""
    import pyarrow.parquet as pq

    curve = indexes(spark, 3, 5)
    order = sorted(curve, key=curve.get)
    assert sorted(curve.values()) == list(range(1 << 15))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(order))
    docs = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    n = len(docs)

    def text_cuts(values):
        out, seen, total = [], 0, len(values)
        for v in sorted(set(values), key=lambda x: x.encode()):
            before, seen = seen * 32 // total, seen + values.count(v)
            if seen * 32 // total > before and seen < total:
                out.append(v.encode())
        return out

    def number_cuts(values):
        ranked = sorted(values)
        return sorted({ranked[max(0, -(-i * n // 32) - 1)] for i in range(1, 32)})

    sizes = [len(r["text"].encode()) + 16 for r in docs]
    cuts = [text_cuts([r["source"] for r in docs]), text_cuts([r["lang"] for r in docs]), number_cuts(sizes)]
    under = lambda bounds, v: sum(b < v for b in bounds)
    want = {r["doc_id"]: curve[under(cuts[0], r["source"].encode()), under(cuts[1], r["lang"].encode()), under(cuts[2], size)] for r, size in zip(docs, sizes, strict=True)}
    rows = h.op1_hilbert_shards(spark, sf_dir).collect()
    assert {r["doc_id"]: r["hilbert"] for r in rows} == want
    along = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in along] == sorted(want.values())
    assert [r["shard"] for r in along] == [i * 40 // n for i in range(n)]


def test_bounds_of_many_texts_come_from_all_of_them(spark, monkeypatch):
    """More distinct texts than the driver sums: the same bounds, from every row."""
    texts = [f"{i:05d}" for i in range(3000)] + [f"é{i}" for i in range(200)] + ["02222"] * 2500 + ["\U0001f600", "￿", ""]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "v string")
    want = h.text_bounds(rows, "v", 32)
    monkeypatch.setattr(h, "BOUND_VALUES", 100)
    assert h.text_bounds(rows, "v", 32) == want
