"""Typed tables on DataFrames.

A Table is a DataFrame with the schema's columns, a contiguous ``_pos`` from 0
and, where the schema is open, an ``_extras`` map of row-local fields. Operations
give new tables; nothing is changed in place. Names resolve on the driver, so
Catalyst sees plain columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Row as SparkRow
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import ColumnSelectionError, ColumnSliceError, TableError
from tabulon.operators import aggregates
from tabulon.operators.index import ColumnIndex
from tabulon.operators.ordering import NullOrder, RowOrder, SortDirection
from tabulon.operators.positions import POS, with_positions
from tabulon.schema import ColumnSpec, Schema
from tabulon.types import DataType, guard
from tabulon.values import NULL, Value, fits, from_spark, to_spark

EXTRAS = "_extras"
#: Extras are text of a typed JSON value in the map, so that any scalar goes in
#: and rows stay writable anywhere: {"t": type, "v": value}.
EXTRAS_TYPE = T.MapType(T.StringType(), T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())]))


def check_row(schema: Schema, row: Sequence) -> None:
    """Width, then each column from the left: null, then type."""
    if len(row) != len(schema):
        raise TableError.RowWidth(expected=len(schema), actual=len(row))
    for spec, raw in zip(schema, row, strict=True):
        check_cell(spec, raw)


def check_cell(spec: ColumnSpec, raw: object) -> None:
    if raw is None or (isinstance(raw, Value) and raw.is_null):
        if not spec.is_nullable:
            raise TableError.NullValue(column=spec.name)
    elif not fits(raw, spec.data_type):
        raise TableError.TypeMismatch(column=spec.name, expected=str(spec.data_type), actual=str(Value.of(raw).data_type))


def check_extras(schema: Schema, extras: Iterable[tuple[str, object]]) -> dict[str, Value]:
    """Checked extras; of a repeated name the last one stays. A declared name is
    an error even where the schema is closed."""
    out: dict[str, Value] = {}
    for name, raw in extras:
        if schema.column_index(name) is not None:
            raise TableError.ExtraConflict(name=name)
        if not schema.is_open:
            raise TableError.ColumnNotFound(name=name)
        out[name] = Value.of(raw)
    return out


def extra_struct(value: Value) -> tuple[str, str | None]:
    text = None if value.is_null else value.payload.hex() if value.data_type is DataType.BYTES else str(value.payload)
    return value.data_type.label, text


def extra_value(cell) -> Value:
    kind = DataType.named(cell["type"])
    if kind is DataType.NULL:
        return NULL
    text = cell["text"]
    if kind.is_integer:
        return Value(kind, int(text))
    if kind.is_float:
        return Value(kind, float(text))
    if kind is DataType.BOOL:
        return Value(kind, text == "True")
    return Value(kind, bytes.fromhex(text) if kind is DataType.BYTES else text)


def rows_frame(spark: SparkSession, schema: Schema, rows: Sequence[Sequence], extras: Sequence[dict[str, Value]] | None = None, start: int = 0) -> DataFrame:
    """Checked rows as a DataFrame with positions from ``start``."""
    fields = [T.StructField(c.name, c.data_type.spark, True, c.field().metadata) for c in schema]
    fields.append(T.StructField(POS, T.LongType(), False))
    if schema.is_open:
        fields.append(T.StructField(EXTRAS, EXTRAS_TYPE))
    made = []
    for i, row in enumerate(rows):
        cells = [to_spark(raw, c.data_type) for raw, c in zip(row, schema, strict=True)]
        own = [{k: extra_struct(v) for k, v in (extras[i] if extras else {}).items()}] if schema.is_open else []
        made.append((*cells, start + i, *own))
    return spark.createDataFrame(made, T.StructType(fields))


class Row:
    """One row read to the driver. Iteration and positions see fixed columns
    only; names also find aliases and extras, and give None where there is none."""

    def __init__(self, schema: Schema, raw: SparkRow) -> None:
        self._schema, self._raw = schema, raw

    @property
    def position(self) -> int:
        return self._raw[POS]

    def __len__(self) -> int:
        return len(self._schema)

    @property
    def is_empty(self) -> bool:
        return self._schema.is_empty

    def get(self, column: int) -> Value | None:
        spec = self._schema.column(column)
        return None if spec is None else from_spark(self._raw[spec.name], spec.data_type)

    def get_named(self, name: str) -> Value | None:
        at = self._schema.column_index(name)
        if at is not None:
            return self.get(at)
        if not self._schema.is_open:
            return None
        found = (self._raw[EXTRAS] or {}).get(name)
        return None if found is None else extra_value(found)

    def __iter__(self) -> Iterator[Value]:
        return (self.get(i) for i in range(len(self)))


class ColumnView:
    """A column bound by position, name or alias."""

    def __init__(self, table: Table, spec: ColumnSpec) -> None:
        self.table, self.spec = table, spec

    @property
    def expr(self) -> Column:
        return F.col(self.spec.name)

    def __len__(self) -> int:
        return self.table.row_count

    @property
    def is_empty(self) -> bool:
        return self.table.is_empty

    def values(self) -> DataFrame:
        """The cells with their positions."""
        return self.table.frame.select(POS, self.spec.name)

    def get(self, row: int) -> Value | None:
        found = self.table.frame.where(F.col(POS) == row).select(self.spec.name).first()
        return None if found is None else from_spark(found[0], self.spec.data_type)

    def as_slice(self, kind: DataType) -> DataFrame:
        """The dense cells of a required column of that very type."""
        if kind is not self.spec.data_type:
            raise ColumnSliceError.TypeMismatch(actual=str(self.spec.data_type), expected=str(kind))
        if self.spec.is_nullable:
            raise ColumnSliceError.Nullable(column=self.spec.name)
        return self.table.frame.select(self.spec.name)

    def for_each_value(self, visit: Callable[[Value], None]) -> None:
        """Visits every cell in order; rows stream to the driver a partition at a time."""
        for found in self.table.frame.orderBy(POS).select(self.spec.name).toLocalIterator():
            visit(from_spark(found[0], self.spec.data_type))

    def filter_values(self, predicate: Callable[[Column], Column]) -> DataFrame:
        return self.table.frame.where(predicate(self.expr)).select(POS, self.spec.name)

    def filter_positions(self, predicate: Callable[[Column], Column]) -> DataFrame:
        return self.table.frame.where(predicate(self.expr)).select(POS).orderBy(POS)

    def map_values(self, change: Callable[[Column], Column], name: str = "value") -> DataFrame:
        return self.table.frame.select(POS, change(self.expr).alias(name))

    def fold_saturating(self, start: int = 0) -> int:
        return aggregates.fold_saturating(self.table.frame, self.spec.name, self.spec.data_type, start)

    def replaced(self, change: Callable[[Column], Column]) -> Table:
        """A table with the column's cells changed, held to its declared type."""
        return self.table.with_cells({self.spec.name: change(self.expr)})


class Table:
    """Rows of a declared schema."""

    def __init__(self, frame: DataFrame, schema: Schema, rows: int | None = None) -> None:
        self.frame, self.schema = frame, schema
        if rows is not None:  # known already, so never counted
            self.row_count = rows

    def _like(self, frame: DataFrame) -> Table:
        """Another state of the same rows; a count that is known stays known."""
        return Table(frame, self.schema, self.__dict__.get("row_count"))

    # sources

    @staticmethod
    def empty(spark: SparkSession, schema: Schema) -> Table:
        return Table(rows_frame(spark, schema, []), schema, 0)

    @staticmethod
    def from_rows(spark: SparkSession, schema: Schema, rows: Iterable[Sequence], extras: Sequence[Iterable[tuple[str, object]]] | None = None) -> Table:
        """A table of rows, each checked before any is taken."""
        rows = [tuple(r) for r in rows]
        kept = []
        for i, row in enumerate(rows):
            check_row(schema, row)
            kept.append(check_extras(schema, extras[i]) if extras else {})
        return Table(rows_frame(spark, schema, rows, kept), schema, len(rows))

    @staticmethod
    def from_frame(frame: DataFrame, schema: Schema, order: list[str], validate: bool = True, extras: Mapping[str, tuple[Column, DataType]] | None = None) -> Table:
        """A table of a DataFrame's columns (its own, by name), with positions in
        the order of a key. With ``validate`` nulls and ranges are counted first,
        in one pass; without, a bad cell fails the query that meets it. ``extras``
        are expressions over the frame with their types, set where they are not
        null, in the same pass."""
        extras = dict(extras or {})
        for name in extras:
            check_extras(schema, [(name, None)])
        missing = [c.name for c in schema if c.name not in frame.columns]
        if missing:
            raise TableError.ColumnNotFound(name=missing[0])
        have = {f.name: f.dataType for f in frame.schema.fields}
        for spec in schema:
            if have[spec.name] != spec.data_type.spark and DataType.of_spark(have[spec.name]) is not spec.data_type and not (spec.data_type.is_unsigned and isinstance(have[spec.name], (T.IntegralType, T.DecimalType))):
                raise TableError.TypeMismatch(column=spec.name, expected=str(spec.data_type), actual=have[spec.name].simpleString())
        checks = _violations(schema)
        if validate and checks:
            found = frame.agg(*[F.count(F.when(bad, 1)).alias(f"c{i}") for i, (_, _, bad) in enumerate(checks)]).first()
            for i, (spec, null, _) in enumerate(checks):
                if found[f"c{i}"]:
                    raise TableError.NullValue(column=spec.name) if null else TableError.TypeMismatch(column=spec.name, expected=str(spec.data_type), actual="a value out of range")
        guarded = frame if validate else _guarded(frame, schema)
        rows = frame.count()
        keep = [c for c in order if c not in schema.names]
        own = {f"_extra{i}": text.cast("string") for i, (text, _) in enumerate(extras.values())}
        placed = with_positions(guarded.select(*schema.names, *keep, *[text.alias(c) for c, text in own.items()]), order, rows=rows).drop(*keep)
        cells = [F.col(c.name).cast(c.data_type.spark).alias(c.name, metadata=c.field().metadata) for c in schema]
        if not schema.is_open:
            return Table(placed.select(*cells, POS), schema, rows)
        entries = [F.struct(F.lit(name).alias("key"), F.struct(F.lit(kind.label).alias("type"), F.col(c).alias("text")).alias("value")) for c, (name, (_, kind)) in zip(own, extras.items(), strict=True)]
        made = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"]["text"].isNotNull())) if entries else F.create_map()
        return Table(placed.select(*cells, POS, made.cast(EXTRAS_TYPE).alias(EXTRAS)), schema, rows)

    # meta

    @cached_property
    def row_count(self) -> int:
        return self.frame.count()

    @property
    def column_count(self) -> int:
        return len(self.schema)

    @property
    def is_empty(self) -> bool:
        return self.frame.isEmpty()

    # scans

    def rows(self, descending: bool = False) -> DataFrame:
        return self.frame.orderBy(F.desc(POS) if descending else F.asc(POS))

    def iter_rows(self) -> Iterator[Row]:
        return (Row(self.schema, r) for r in self.rows().toLocalIterator())

    def row(self, position: int) -> Row | None:
        found = self.frame.where(F.col(POS) == position).first()
        return None if found is None else Row(self.schema, found)

    def _row_or_raise(self, position: int) -> Row:
        found = self.row(position)
        if found is None:
            raise TableError.RowOutOfBounds(row=position, rows=self.row_count)
        return found

    def cell(self, row: int, column: int) -> Value:
        """Row bound first, then column bound."""
        found = self._row_or_raise(row)
        self.schema.at(column)
        return found.get(column)

    def cell_named(self, row: int, name: str) -> Value | None:
        """Name or alias, then extras; a closed schema refuses before any row is read."""
        at = self.schema.column_index(name)
        if at is not None:
            return self.cell(row, at)
        if not self.schema.is_open:
            raise TableError.ColumnNotFound(name=name)
        return self._row_or_raise(row).get_named(name)

    def extra(self, name: str, kind: DataType | None = None) -> Column:
        """Text of an extra as a column, null where a row has none; with a type the
        value itself, null where the extra is of another type."""
        cell = F.col(EXTRAS)[name]
        if kind is None:
            return cell["text"]
        text = F.unhex(cell["text"]) if kind is DataType.BYTES else cell["text"]
        return F.when(cell["type"] == kind.label, text.cast(kind.spark))

    def column(self, position: int) -> ColumnView | None:
        spec = self.schema.column(position)
        return None if spec is None else ColumnView(self, spec)

    def column_named(self, name: str) -> ColumnView | None:
        at = self.schema.column_index(name)
        return None if at is None else self.column(at)

    def select_named(self, *names: str) -> DataFrame:
        """Positions and the named columns; names or aliases."""
        return self.frame.select(POS, *[self.schema.columns[self.schema.named(n)].name for n in names])

    # bulk transforms

    def columns_io(self, inputs: Sequence[int], outputs: Sequence[int], change: Callable[..., Sequence[Column]]) -> Table:
        """A table whose output columns are ``change(*inputs)``, all read from the
        old inputs. Inputs may repeat; outputs are distinct and no inputs."""
        width = len(self.schema)
        for c in inputs:
            if not 0 <= c < width:
                raise ColumnSelectionError.InputOutOfBounds(column=c, columns=width)
        seen: set[int] = set()
        for c in outputs:
            if not 0 <= c < width:
                raise ColumnSelectionError.OutputOutOfBounds(column=c, columns=width)
            if c in inputs:
                raise ColumnSelectionError.Overlap(column=c)
            if c in seen:
                raise ColumnSelectionError.DuplicateOutput(column=c)
            seen.add(c)
        made = change(*[F.col(self.schema.at(c).name) for c in inputs])
        return self.with_cells({self.schema.at(c).name: m for c, m in zip(outputs, made, strict=True)})

    def column_pair(self, source: int, target: int, change: Callable[[Column], Column]) -> Table | None:
        """One input, one other output; None where they are one or out of bounds."""
        width = len(self.schema)
        if source == target or not 0 <= source < width or not 0 <= target < width:
            return None
        return self.columns_io([source], [target], lambda x: [change(x)])

    def with_cells(self, changes: Mapping[str, Column]) -> Table:
        """Columns replaced by expressions, held to their declared type: a value
        out of an integer's range fails the query, as does null where required."""
        specs = {c.name: c for c in self.schema}
        made = {}
        for name, expr in changes.items():
            spec = specs[name]
            cell = expr.cast(spec.data_type.spark)
            ok = guard(cell, spec.data_type)
            if ok is not None:
                cell = F.when(ok | cell.isNull(), cell).otherwise(F.raise_error(f"column {name!r} takes {spec.data_type}").cast(spec.data_type.spark))
            if not spec.is_nullable:
                cell = F.when(cell.isNotNull(), cell).otherwise(F.raise_error(f"column {name!r} takes no null").cast(spec.data_type.spark))
            made[name] = cell.alias(name, metadata=spec.field().metadata)
        return self._like(self.frame.select(*[made.get(c, F.col(c)) for c in self.frame.columns]))

    # mutation

    def set_cell(self, row: int, column: int, value: object) -> Table:
        """Bounds, then null, then type."""
        if not 0 <= row < self.row_count:
            raise TableError.RowOutOfBounds(row=row, rows=self.row_count)
        return self._put(row, self.schema.at(column), value)

    def _put(self, row: int, spec: ColumnSpec, value: object) -> Table:
        check_cell(spec, value)
        put = F.lit(to_spark(value, spec.data_type)).cast(spec.data_type.spark)
        cell = F.when(F.col(POS) == row, put).otherwise(F.col(spec.name)).alias(spec.name, metadata=spec.field().metadata)
        return self._like(self.frame.select(*[cell if c == spec.name else F.col(c) for c in self.frame.columns]))

    def set_named(self, row: int, name: str, value: object) -> Table:
        """A declared column, else an extra if the schema is open, replacing."""
        at = self.schema.column_index(name)
        if at is not None:
            return self.set_cell(row, at, value)
        if not self.schema.is_open:
            raise TableError.ColumnNotFound(name=name)
        if not 0 <= row < self.row_count:
            raise TableError.RowOutOfBounds(row=row, rows=self.row_count)
        return self.with_extra(name, F.lit(extra_struct(Value.of(value))[1]), Value.of(value).data_type, F.col(POS) == row)

    def with_extra(self, name: str, text: Column, kind: DataType, rows: Column | None = None) -> Table:
        """An extra set on the rows that meet a condition (all, without one)."""
        if self.schema.column_index(name) is not None:
            raise TableError.ExtraConflict(name=name)
        if not self.schema.is_open:
            raise TableError.ColumnNotFound(name=name)
        one = F.create_map(F.lit(name), F.struct(F.lit(kind.label).alias("type"), text.cast("string").alias("text"))).cast(EXTRAS_TYPE)
        rest = F.map_filter(F.coalesce(F.col(EXTRAS), F.create_map().cast(EXTRAS_TYPE)), lambda k, _: k != name)
        put = F.map_concat(rest, one)
        return self._like(self.frame.withColumn(EXTRAS, put if rows is None else F.when(rows, put).otherwise(F.col(EXTRAS))))

    def pop_row(self) -> tuple[Table, bool]:
        """The table without its last row, and whether there was one."""
        n = self.row_count
        return (Table(self.frame.where(F.col(POS) < n - 1), self.schema, n - 1), True) if n else (self, False)

    def row_mut(self, position: int) -> RowMut | None:
        return RowMut(self, position) if 0 <= position < self.row_count else None

    def rows_mut(self) -> RowsMut:
        return RowsMut(self, 0, self.row_count)

    # order, index, append

    def row_order(self, column: int, direction: SortDirection = SortDirection.ASCENDING, nulls: NullOrder = NullOrder.LAST) -> RowOrder:
        return RowOrder(self, self.schema.at(column), direction, nulls)

    def row_order_named(self, name: str, direction: SortDirection = SortDirection.ASCENDING, nulls: NullOrder = NullOrder.LAST) -> RowOrder:
        return self.row_order(self.schema.named(name), direction, nulls)

    def index(self, column: int) -> ColumnIndex:
        return ColumnIndex(self, column)

    def append(self, other: Table) -> tuple[Table, range]:
        """Both tables' rows, the other's behind; and the new rows' positions.
        Schemas must be equal, policy included."""
        if self.schema != other.schema:
            raise TableError.SchemaMismatch()
        n, more = self.row_count, other.row_count
        behind = other.frame.withColumn(POS, F.col(POS) + F.lit(n))
        return Table(self.frame.unionByName(behind), self.schema, n + more), range(n, n + more)


def _violations(schema: Schema) -> list[tuple[ColumnSpec, bool, Column]]:
    out = []
    for spec in schema:
        if not spec.is_nullable:
            out.append((spec, True, F.col(spec.name).isNull()))
        ok = guard(F.col(spec.name), spec.data_type)
        if ok is not None:
            out.append((spec, False, ~ok))
    return out


def _guarded(frame: DataFrame, schema: Schema) -> DataFrame:
    cells = {c: F.col(c) for c in frame.columns}
    for spec, null, bad in _violations(schema):
        text = f"column {spec.name!r} takes no null" if null else f"column {spec.name!r} takes {spec.data_type}"
        cells[spec.name] = F.when(F.coalesce(~bad, F.lit(not null)), cells[spec.name]).otherwise(F.raise_error(text).cast(frame.schema[spec.name].dataType))
    return frame.select(*[v.alias(k) for k, v in cells.items()])


class RowMut:
    """A row to be changed; every change gives a new table, kept in ``table``."""

    def __init__(self, table: Table, position: int) -> None:
        self.table, self.position = table, position

    def __len__(self) -> int:
        return len(self.table.schema)

    @property
    def is_empty(self) -> bool:
        return self.table.schema.is_empty

    def get(self, column: int) -> Value | None:
        return self.table.row(self.position).get(column)

    def get_named(self, name: str) -> Value | None:
        return self.table.row(self.position).get_named(name)

    def set(self, column: int, value: object) -> Table:
        self.table = self.table._put(self.position, self.table.schema.at(column), value)
        return self.table

    def set_named(self, name: str, value: object) -> Table:
        self.table = self.table.set_named(self.position, name, value)
        return self.table


class RowsMut:
    """A range of rows to be changed by expressions."""

    def __init__(self, table: Table, start: int, end: int) -> None:
        self.table, self.start, self.end = table, start, end

    def __len__(self) -> int:
        return self.end - self.start

    @property
    def is_empty(self) -> bool:
        return self.end == self.start

    @property
    def rows(self) -> Column:
        return (F.col(POS) >= self.start) & (F.col(POS) < self.end)

    def row_mut(self, at: int) -> RowMut | None:
        """The at-th row of the range."""
        return RowMut(self.table, self.start + at) if 0 <= at < len(self) else None

    def split_at(self, mid: int) -> tuple[RowsMut, RowsMut]:
        if not 0 <= mid <= len(self):
            raise IndexError(f"split at {mid} of {len(self)} rows")
        cut = self.start + mid
        return RowsMut(self.table, self.start, cut), RowsMut(self.table, cut, self.end)

    def for_each(self, changes: Mapping[str, Callable[[], Column] | Column]) -> Table:
        """A table with the named columns changed on these rows only; a change of
        an undeclared name on an open schema sets that extra."""
        declared, out = {}, self.table
        for name, change in changes.items():
            expr = change() if callable(change) else change
            at = self.table.schema.column_index(name)
            if at is None:
                out = out.with_extra(name, expr, DataType.STRING, self.rows)
            else:
                own = self.table.schema.at(at).name
                declared[own] = F.when(self.rows, expr).otherwise(F.col(own))
        return out.with_cells(declared) if declared else out

    def par_for_each(self, min_rows: int, changes: Mapping[str, Column]) -> Table:
        """The same with rows dealt to partitions of about ``min_rows`` or more."""
        if min_rows < 1:
            raise ValueError("min_rows must be positive")
        parts = max(1, len(self) // min_rows)
        spread = self.table._like(self.table.frame.repartitionByRange(min(parts, 10_000), POS))
        return RowsMut(spread, self.start, self.end).for_each(changes)


def split_update(table: Table, mid: int, left: Mapping[str, Column], right: Mapping[str, Column]) -> Table:
    """Different changes before and from ``mid``, in one projection."""
    low, high = table.rows_mut().split_at(mid)
    first = low.for_each(left)
    return RowsMut(first, high.start, high.end).for_each(right)


Table.split_update = split_update
