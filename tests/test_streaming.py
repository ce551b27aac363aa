import pytest

from tabulon.operators.positions import POS
from tabulon.schema import ColumnSpec, Schema
from tabulon.streaming.ingest import append_stream, read_table
from tabulon.types import DataType as D

SCHEMA = Schema([ColumnSpec("id", D.U32), ColumnSpec("name", D.STRING)])


def test_batches_append(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).selectExpr("id", "string(id) AS name").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, name string").parquet(source)
        append_stream(stream, SCHEMA, str(tmp_path / "out"), ["id"], str(tmp_path / "c")).awaitTermination()
    rows = read_table(spark, SCHEMA, str(tmp_path / "out")).frame.orderBy(POS).collect()
    assert [(r[POS], r["id"]) for r in rows] == [(i, i) for i in range(30)]


def test_bad_batch_writes_nothing(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (-5, "b")], "id long, name string").write.parquet(source)
    stream = spark.readStream.schema("id long, name string").parquet(source)
    query = append_stream(stream, SCHEMA, str(tmp_path / "out"), ["id"], str(tmp_path / "c"))
    with pytest.raises(Exception, match="u32"):
        query.awaitTermination()
    assert not (tmp_path / "out").exists()
