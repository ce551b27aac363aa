"""WARC archives as a chunked record table.

An archive is a table of rows (``archive``, ``record_id``, ``row_no``,
``chunk_no``, ``n_chunks``, ``data``, ``chunk_digest``): the chunks of one record, in order, are the exact bytes
of a WARC/1.1 record, and an archive's records one after the other are a valid
WARC file (``export_archive`` writes that file). A record's bytes never stand in
one buffer: payloads are cut into chunks of at most ``chunk_bytes`` by SQL,
every payload chunk carries the digest of its own bytes, and the reader feeds chunks one by one to
an incremental SHA-256, keeping the hash state and one header between them.

Equal payloads are found by digest. The first page by id holds the payload; the
others become revisit records that refer to it and carry only HTTP headers, of
which Content-Length is the full payload's. Roles come from a grouped minimum
joined back on narrow rows, large groups over salts; payloads are shuffled at
most once, by page id and digest, and not at all where revisits are few.

Records are spread over as many archives as their payloads fill, of ARCHIVE_BYTES
each, about.

Defined results: null payload is an empty one; null URL is written as
``urn:page:<id>``; a page without an id gets a record all the same, whose URN is
of a kind of its own and is numbered by its place in the table, and comes back
with a null id; it revisits the page with the smallest id of equal payload, if
one has an id; repeated page ids with equal payloads are one record each, and
of those with the smallest id all are responses; an empty table gives no rows;
other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.shared import bounded_batches, fresh_path, join_counted, table, written

CHUNK_BYTES = 256 * 1024
ARCHIVE_BYTES = 1 << 30
MIN_REVISIT_BYTES = 100
#: Revisits are sent to the readers of payloads up to so many (about 20 MB);
#: beyond, payloads are shuffled to them.
SENT_ROLES = 200_000
#: Fixed values of the format.
VERSION, CRLF, END = "WARC/1.1", "\r\n", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
#: Kinds of record URNs: of pages with an id, and of those without.
NAMED, UNNAMED = "4000", "4001"

ROW = "record_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, intact boolean"


def record_urn(page_id: Column, row_no: Column | None = None) -> Column:
    """A record id that can be read back: the page id in the last part of a UUID;
    without one the row's number, in a UUID of another kind."""
    number = page_id if row_no is None else F.coalesce(page_id, row_no)
    digits = F.lpad(F.lower(F.hex(number)), 16, "0")
    kind = F.when(page_id.isNull(), F.lit(UNNAMED)).otherwise(F.lit(NAMED))
    return F.concat(F.lit("<urn:uuid:00000000-0000-"), kind, F.lit("-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 12), F.lit(">"))


def urn_page(urn: str) -> int | None:
    kind, high, low = urn.rstrip(">").rsplit("-", 3)[1:]
    if kind == UNNAMED:
        return None
    value = int(high + low, 16)
    return value - (1 << 64) if value >= 1 << 63 else value


def with_roles(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, payload binary) with payload_bytes, payload_digest,
    record_type and refers_to.

    Groups of equal payloads are found on rows of id and digest; a large group is
    dealt over salts. Payloads meet their roles by page id and digest, which no
    group shares."""
    told = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    narrow = told.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest").distinct()
    firsts = narrow.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    firsts = written(firsts, "firsts")
    roles = join_counted(narrow, firsts, "payload_digest", "_n", "page_id", "inner").where("_first IS NOT NULL AND NOT page_id <=> _first").select("page_id", "payload_digest", "_first")
    roles = written(roles, "roles")
    few = roles.count() <= SENT_ROLES
    roles = roles.withColumnsRenamed({"page_id": "_page", "payload_digest": "_digest"})
    same = told["page_id"].eqNullSafe(F.col("_page")) & (told["payload_digest"] == F.col("_digest"))
    out = told.join(F.broadcast(roles) if few else roles, same, "left").drop("_page", "_digest")
    again = F.col("_first").isNotNull()
    return out.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.col("_first")).drop("_first")


def to_chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, archives: int | None = None) -> DataFrame:
    """The chunked record table of pages (page_id, url, payload binary)."""
    if archives is None:
        archives = 1 + (pages.agg(F.sum(F.octet_length("payload").cast("long"))).first()[0] or 0) // ARCHIVE_BYTES
    lines = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    told = with_roles(pages).withColumn("row_no", F.monotonically_increasing_id())
    revisit = F.col("record_type") == "revisit"
    http = lines("HTTP/1.1 200 OK", CRLF, "Content-Type: text/html; charset=utf-8", CRLF, "Content-Length: ", F.col("payload_bytes").cast("string"), CRLF, CRLF)
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    # a header line must hold no line break
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))), r"[\r\n]", "%0A")
    head = lines(
        VERSION, CRLF, "WARC-Type: ", F.col("record_type"), CRLF, "WARC-Record-ID: ", record_urn(F.col("page_id"), F.col("row_no")), CRLF, f"WARC-Date: {DATE}", CRLF, "WARC-Target-URI: ", uri, CRLF,
        F.when(revisit, lines("WARC-Refers-To: ", record_urn(F.col("refers_to")), CRLF, f"WARC-Profile: {REVISIT_PROFILE}", CRLF)).otherwise(F.lit("")),
        "WARC-Payload-Digest: sha256:", F.col("payload_digest"), CRLF, "Content-Type: application/http; msgtype=response", CRLF, "Content-Length: ", block.cast("string"), CRLF, CRLF, http,
    )
    kept = F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))
    last = F.expr(f"cast(greatest(_kept - 1, 0) div {chunk_bytes} as int)")
    cut = (
        told.withColumn("_head", F.encode(head, "UTF-8"))
        .withColumn("_kept", kept)
        .withColumn("_last", last)
        .select("page_id", "row_no", "payload", "_head", "_kept", "_last", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("chunk_no"))
    )
    part = F.when(F.col("_kept") == 0, F.lit(b"")).otherwise(F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))
    data = F.concat(F.when(F.col("chunk_no") == 0, F.col("_head")).otherwise(F.lit(b"")), part, F.when(F.col("chunk_no") == F.col("_last"), F.lit(END)).otherwise(F.lit(b"")))
    return cut.select(
        F.pmod(F.xxhash64(F.coalesce("page_id", "row_no")), F.lit(archives)).cast("int").alias("archive"),
        F.col("page_id").alias("record_id"),
        "row_no",
        "chunk_no",
        (F.col("_last") + 1).alias("n_chunks"),
        data.alias("data"),
        F.sha2(part, 256).alias("chunk_digest"),
    )


class Reader:
    """Parses one record from its chunks in order; holds the hash state, the
    header fields and counts, never the payload."""

    def __init__(self) -> None:
        self.sha, self.block_left, self.seen, self.ok = hashlib.sha256(), None, 0, True
        self.fields: dict[str, str] = {}
        self.http: dict[str, str] = {}
        self.tail = b""

    def feed(self, data: bytes, digest: str | None) -> None:
        view = memoryview(data)
        if self.block_left is None:
            end = data.find(END)
            stop = data.find(END, end + 4)
            lines = data[:end].decode("utf-8").split(CRLF)
            self.ok &= end > 0 and stop > 0 and lines[0] == VERSION
            self.fields = dict(x.split(": ", 1) for x in lines[1:])
            self.http = dict(x.split(": ", 1) for x in data[end + 4 : stop].decode("utf-8").split(CRLF)[1:])
            self.block_left = int(self.fields["Content-Length"]) - (stop - end)
            view = view[stop + 4 :]
        part = view[: self.block_left]
        self.ok &= digest is None or hashlib.sha256(part).hexdigest() == digest
        self.sha.update(part)
        self.seen += len(part)
        self.block_left -= len(part)
        self.tail += bytes(view[len(part) :])

    def row(self) -> tuple:
        f, kind = self.fields, self.fields.get("WARC-Type")
        said = f.get("WARC-Payload-Digest", "").removeprefix("sha256:")
        whole = self.block_left == 0 and self.tail == END and self.ok
        full = int(self.http.get("Content-Length", -1))
        if kind == "response":
            whole &= self.sha.hexdigest() == said and self.seen == full
            said = self.sha.hexdigest()
        refers = urn_page(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None
        return urn_page(f["WARC-Record-ID"]), kind, refers, f.get("WARC-Target-URI"), full, said, bool(whole)


def _read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in ROW.split(", ")]
    open_: Reader | None = None
    for pdf in batches:
        rows = []
        for no, data, digest in zip(pdf["chunk_no"], pdf["data"], pdf["chunk_digest"], strict=True):
            if no == 0:
                if open_ is not None:
                    rows.append(open_.row())
                open_ = Reader()
            open_.feed(data, digest)
        if rows:
            yield _frame(rows, names)
    if open_ is not None:
        yield _frame([open_.row()], names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names, dtype=object).astype({"payload_bytes": "int64", "intact": bool})
    for name in ("record_id", "refers_to"):
        out[name] = pd.array(out[name].astype(object).where(out[name].notna(), None).tolist(), "Int64")
    return out


def read_chunks(chunks: DataFrame) -> DataFrame:
    """One row (ROW) per record of a chunked record table. Records of one chunk
    are parsed where they lie; those of several are brought together in order by
    a sort that can spill, and streamed."""
    bounded_batches(chunks.sparkSession)
    columns = ["row_no", "chunk_no", "data", "chunk_digest"]
    single = chunks.where("n_chunks = 1").select(*columns)
    several = chunks.where("n_chunks > 1").select(*columns).repartition("row_no").sortWithinPartitions("row_no", "chunk_no")
    return single.mapInPandas(_read, ROW).unionByName(several.mapInPandas(_read, ROW))


def export_archive(chunks: DataFrame, archive: int, out) -> int:
    """Streams one archive's bytes, record by record, to the binary file ``out``:
    a tool for single archives, which are of ARCHIVE_BYTES, about."""
    size = 0
    for row in chunks.where(F.col("archive") == archive).orderBy("record_id", "row_no", "chunk_no").select("data").toLocalIterator():
        size += out.write(row["data"])
    return size


def parse_file(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows as read_chunks gives them, from a WARC byte stream, a chunk at a time."""
    buffer = b""
    while True:
        while (end := buffer.find(END)) < 0 or buffer.find(END, end + 4) < 0:
            more = stream.read(chunk_bytes)
            if not more:
                return
            buffer += more
        fields = dict(x.split(": ", 1) for x in buffer[:end].decode("utf-8").split(CRLF)[1:])
        left = end + 4 + int(fields["Content-Length"]) + 4
        reader = Reader()
        while left:
            if not buffer:
                buffer = stream.read(chunk_bytes)
                if not buffer:
                    break
            part, buffer = buffer[:left], buffer[left:]
            if reader.block_left is None and left > len(part) and part.find(END, part.find(END) + 4) < 0:
                more = stream.read(chunk_bytes)
                buffer = part + more
                continue
            reader.feed(part, None)
            left -= len(part)
        yield reader.row()


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back from the archives."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    path = fresh_path(spark, "warc")
    to_chunks(pages).write.option("parquet.block.size", 32 << 20).parquet(path)
    back = read_chunks(spark.read.parquet(path))
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to,
  TRUE AS intact
FROM f
"""
