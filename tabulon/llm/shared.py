"""What the operators of this subpackage share: the shared folder and plan cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the checkpoint folder in force, else
    spark.checkpoint.dir as the session names it. Where neither is set, a session
    on one machine (master local) gets a temporary folder; a cluster's session is
    refused, for its executors would each write to a disk of their own."""
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tabulon-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def session_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tabulon-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_written(spark: SparkSession) -> bool:
    """Deletes every table this application has written to the shared folder. Call
    it when results have been consumed: they are read from those tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later passes and lost
    executors reread the files and compute nothing again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(df: DataFrame) -> None:
    """Deletes the table that ``written`` gave, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Each query run meanwhile deletes its shuffle files at its end, rather than
    whenever the driver collects its garbage: for operators that write what they read
    again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def words(text: Column) -> Column:
    """Words of the whole text, in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch sent to Python workers; one figure for all operators, so that
#: none changes the batches of another.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches sent to Python workers are held to BATCH_BYTES, however long the
    texts; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """A name that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_of(df: DataFrame, *replaced: str) -> Column:
    """All columns of df as one, ``_row``, so that what an operator computes beside
    it clashes with none of their names. Columns called ``replaced`` are left
    out, for the operator gives its own."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in replaced]
    return (F.struct(*kept) if kept else F.struct(F.lit(None).alias("_none"))).alias("_row")


def unpacked(df: DataFrame, *own: Column | str) -> DataFrame:
    """The columns in ``_row`` as they were, then the operator's own."""
    return df.select(*([] if df.schema["_row"].dataType.names == ["_none"] else ["_row.*"]), *own)


#: Keys that are dealt over salts are at most so many, whatever the input.
SALTED_KEYS = 100_000


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, spread: str, how: str = "left") -> DataFrame:
    """rows joined with keyed, which has one row for each key and, in ``count``,
    how many rows the key has. Keys of very many rows are dealt by a hash of the
    column ``spread`` over as many parts as they need, so none of them is one
    task's. A key is dealt if it has over one row in SALTED_KEYS (and over 1,024):
    at most SALTED_KEYS keys, whose list is broadcast."""
    total = keyed.agg(F.sum(count).alias("n")).first()["n"] or 0
    part = max(1024, -(-total // SALTED_KEYS))
    hot = keyed.where(F.col(count) > part).select(key, F.ceil(F.col(count) / F.lit(part)).cast("int").alias("_parts"))
    if hot.isEmpty():
        return rows.join(keyed, key, how)
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    parts = F.when(F.col(count) > part, F.ceil(F.col(count) / F.lit(part))).otherwise(F.lit(1)).cast("int")
    right = keyed.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, [key, "_part"], how).drop("_part")
