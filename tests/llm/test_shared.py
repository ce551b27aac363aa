from pyspark.sql import functions as F

from tabulon.llm import shared


def test_hot_keys_are_dealt_and_nothing_is_lost(spark):
    rows = spark.range(5000).selectExpr("id", "if(id < 4000, 7L, id) AS k").unionByName(spark.createDataFrame([(9999, None)], "id long, k long"))
    keyed = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    got = shared.join_counted(rows, keyed, "k", "n", "id")
    want = rows.join(keyed, "k", "left")
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert "_part" in got._jdf.queryExecution().optimizedPlan().toString()
    assert shared.join_counted(rows.limit(0), keyed.limit(0), "k", "n", "id").collect() == []


def test_words(spark):
    df = spark.createDataFrame([(" a\tb\x0b\x0cc  ",), ("",), (None,), ("d\u00a0e",)], "t string")
    assert [r[0] for r in df.select(shared.words(F.col("t"))).collect()] == [["a", "b", "c"], [], [], ["d\u00a0e"]]


def test_batch_bytes_only_go_down(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    for own, want in ((None, shared.BATCH_BYTES), (shared.BATCH_BYTES * 8, shared.BATCH_BYTES), (1 << 20, 1 << 20)):
        if own is not None:
            spark.conf.set(key, str(own))
        shared.bounded_batches(spark)
        assert int(spark.conf.get(key)) == want
    spark.conf.unset(key)


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        def __init__(self, master):
            self.master = master
            self._jsc = self

        def sc(self):
            return self

        def getCheckpointDir(self):  # noqa: N802
            return self

        def isDefined(self):  # noqa: N802
            return False

        def getConf(self):  # noqa: N802
            return {}

        def setCheckpointDir(self, path):  # noqa: N802
            self.path = path

    class Session:
        conf = {}

        def __init__(self, master):
            self.sparkContext = Context(master)

    import pytest

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared.shared_dir(Session(master))
    assert shared.shared_dir(Session("local[4]")).startswith("file:///")


def test_the_session_names_the_folder(spark):
    assert shared.written(spark.range(3), "t").count() == 3
    assert shared.shared_dir(spark) == shared.shared_dir(spark)


def test_written_tables_can_be_dropped(spark):
    df = shared.written(spark.range(3), "gone")
    assert df.count() == 3 and shared.drop_written(spark)
    spark.catalog.clearCache()
    import pytest

    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(shared.session_dir(spark))
