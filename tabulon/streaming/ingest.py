"""Validated appends from a stream: many producers, one growing table.

Each micro-batch is checked as a whole before any of its rows is written, so a
bad row leaves the table as it was. Batches are files of their own, named by
batch number; a batch that is run again after a failure overwrites itself, so
rows are written once. Positions follow batch number and then the key; they are
worked out when the table is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabulon.operators.positions import POS
from tabulon.schema import Schema
from tabulon.table import Table

BATCH = "_batch"
#: Batches whose starts are sent to the readers of rows; more are joined.
SENT_BATCHES = 100_000


def append_stream(stream: DataFrame, schema: Schema, path: str, order: list[str], checkpoint: str, **trigger) -> StreamingQuery:
    """Starts writing the stream's rows to ``path``; ``trigger`` is passed on
    (availableNow=True to take what is there and stop)."""

    def publish(batch: DataFrame, number: int) -> None:
        table = Table.from_frame(batch, schema, order)  # raises before anything is written
        table.frame.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_table(spark: SparkSession, schema: Schema, path: str) -> Table:
    """The published rows; a batch's positions begin where the one before ends."""
    rows = spark.read.parquet(path)
    counts = rows.groupBy(BATCH).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy(BATCH).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(BATCH, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    few = counts.limit(SENT_BATCHES + 1).count() <= SENT_BATCHES
    placed = rows.join(F.broadcast(starts) if few else starts, BATCH).withColumn(POS, F.col(POS) + F.col("_start"))
    return Table(placed.select(*schema.names, POS), schema)
