"""Rows from many producers, published whole, frozen into a table once.

Python producers append under a lock to one list; positions follow publication.
Producers that are DataFrames (files, partitions, streams' batches) are taken by
``extend_frame``: their rows never pass through the driver."""

from __future__ import annotations

import threading
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.errors import TableError
from tabulon.operators.positions import POS
from tabulon.schema import Schema
from tabulon.table import Table, check_extras, check_row, rows_frame


class ConcurrentTableBuilder:
    def __init__(self, schema: Schema) -> None:
        self.schema, self._lock, self._rows, self._extras, self._frames, self._framed = schema, threading.Lock(), [], [], [], 0

    @property
    def row_count(self) -> int:
        """Rows published so far."""
        return len(self._rows) + self._framed

    @property
    def is_empty(self) -> bool:
        return self.row_count == 0

    def push_row(self, row: Sequence) -> int:
        """Publishes one checked row; its position."""
        return self.push_row_with_extras(row, ())

    push_row_vec = push_row

    def push_row_with_extras(self, row: Sequence, extras: Iterable[tuple[str, object]]) -> int:
        row = tuple(row)
        check_row(self.schema, row)
        own = check_extras(self.schema, extras)
        with self._lock:
            self._rows.append(row)
            self._extras.append(own)
            return len(self._rows) - 1 + self._framed

    def extend_rows(self, rows: Iterable[Sequence]) -> range:
        """Publishes a batch, all rows checked before any is; its positions."""
        batch = [tuple(r) for r in rows]
        for row in batch:
            check_row(self.schema, row)
        with self._lock:
            start = len(self._rows) + self._framed
            self._rows += batch
            self._extras += [{} for _ in batch]
        return range(start, start + len(batch))

    def extend_frame(self, frame: DataFrame, order: list[str]) -> range:
        """Publishes a DataFrame's rows in the order of a key, checked first. Takes
        the rows pushed so far as before it."""
        table = Table.from_frame(frame, self.schema, order)
        n = table.row_count
        with self._lock:
            self._frames.append((len(self._rows), table.frame, n))
            start = len(self._rows) + self._framed
            self._framed += n
        return range(start, start + n)

    def into_table(self, spark: SparkSession) -> Table:
        """The published rows as a table; the builder is used up."""
        with self._lock:
            out, taken, at = None, 0, 0
            for pushed, frame, n in [*self._frames, (len(self._rows), None, 0)]:
                own = rows_frame(spark, self.schema, self._rows[taken:pushed], self._extras[taken:pushed], at)
                out = own if out is None else out.unionByName(own) if pushed > taken else out
                at, taken = at + pushed - taken, pushed
                if frame is not None:
                    out = out.unionByName(frame.withColumn(POS, F.col(POS) + F.lit(at)))
                    at += n
            self._rows, self._extras, self._frames, self._framed = [], [], [], 0
        return Table(out, self.schema)

    def append_to(self, table: Table) -> tuple[Table, range]:
        """table with the published rows behind its own, and their positions;
        schemas must be equal, else nothing is taken."""
        if table.schema != self.schema:
            raise TableError.SchemaMismatch()
        return table.append(self.into_table(table.frame.sparkSession))
