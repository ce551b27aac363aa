"""JSON, CSV, URI and debug text of tables and arguments.

Rows become text on the executors. One string for the whole table is put
together on the driver and is meant for small results; ``json_lines`` and
``csv_lines`` stay distributed for the rest. Aliases and extras are never
written."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.arguments import Arguments
from tabulon.errors import FormatError
from tabulon.functions.text import percent_encode, percent_encode_text
from tabulon.operators.ordering import RowOrder
from tabulon.operators.positions import POS
from tabulon.schema import ColumnSpec, Schema
from tabulon.table import Table
from tabulon.types import DataType
from tabulon.values import Value

NOT_FINITE = ("NaN", "inf", "-inf")


def cell_json(spec: ColumnSpec) -> Column:
    """A cell as to_json should see it: bytes in lower-case hex, wide integers
    plain, and a number JSON does not have as an error."""
    c = F.col(spec.name)
    if spec.data_type is DataType.BYTES:
        return F.lower(F.hex(c))
    if spec.data_type.is_float:
        odd = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
        return F.when(~F.coalesce(odd, F.lit(False)), c).otherwise(F.raise_error(F.concat(c.cast("string"), F.lit(" has no JSON number"))).cast(spec.data_type.spark))
    return c


def row_json(schema: Schema) -> Column:
    """One row as a JSON object, nulls included, in schema order."""
    if schema.is_empty:
        return F.lit("{}")
    return F.to_json(F.struct(*[cell_json(c).alias(c.name) for c in schema]), {"ignoreNullFields": "false"})


def cell_text(spec: ColumnSpec) -> Column:
    """A cell as CSV and URI have it; null stays null."""
    c = F.col(spec.name)
    if spec.data_type is DataType.BYTES:
        return F.lower(F.hex(c))
    if spec.data_type.is_float:
        finite = F.when(F.isnan(c), F.lit(NOT_FINITE[0])).when(c == F.lit(float("inf")), F.lit(NOT_FINITE[1])).when(c == F.lit(float("-inf")), F.lit(NOT_FINITE[2]))
        return F.when(c.isNotNull(), F.coalesce(finite, c.cast("string")))
    return c.cast("string")


def quoted(text: Column) -> Column:
    """A CSV field: quoted if it holds a quote, comma or line break; null is empty."""
    inner = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\r\n]'), inner).otherwise(text), F.lit(""))


def row_csv(schema: Schema) -> Column:
    """One record. A record of one empty field is written as a quoted empty one,
    so that it is not an empty line."""
    fields = F.concat_ws(",", *[quoted(cell_text(c)) for c in schema])
    return F.when(fields == "", F.lit('""')).otherwise(fields) if len(schema) == 1 else fields


def csv_header(schema: Schema) -> str:
    def field(name: str) -> str:
        return '"' + name.replace('"', '""') + '"' if any(c in name for c in '",\r\n') else name

    return ",".join(map(field, schema.names))


def row_uri(schema: Schema) -> Column:
    """One row as name=value pairs, percent-encoded."""
    pairs = [F.concat(F.lit(percent_encode_text(c.name) + "="), F.coalesce(percent_encode(cell_text(c)), F.lit(""))) for c in schema]
    return F.concat_ws("&", *pairs)


def json_lines(table: Table) -> DataFrame:
    return table.frame.select(POS, row_json(table.schema).alias("json"))


def csv_lines(table: Table) -> DataFrame:
    return table.frame.select(POS, row_csv(table.schema).alias("csv"))


def _streamed(ordered: DataFrame) -> Iterator[str]:
    return (r[0] for r in ordered.toLocalIterator())


def table_to_json(table: Table) -> str:
    """The whole table as one JSON array."""
    return "[" + ",".join(_streamed(table.frame.orderBy(POS).select(row_json(table.schema)))) + "]"


def row_order_to_json(order: RowOrder) -> str:
    return "[" + ",".join(_streamed(order.rows().select(row_json(order.table.schema)))) + "]"


def table_to_csv(table: Table, header: bool = True) -> str:
    lines = [csv_header(table.schema)] if header else []
    lines += _streamed(table.frame.orderBy(POS).select(row_csv(table.schema)))
    return "".join(x + "\n" for x in lines)


def write_json(table: Table, path: str) -> None:
    """JSON lines in files, in position order, for tables of any size."""
    table.frame.orderBy(POS).select(row_json(table.schema)).write.text(path)


def write_csv(table: Table, path: str) -> None:
    table.frame.orderBy(POS).select(row_csv(table.schema)).write.text(path)


def value_text(value: Value) -> str:
    p = value.payload
    if value.is_null:
        return ""
    if value.data_type is DataType.BOOL:
        return "true" if p else "false"
    if value.data_type is DataType.BYTES:
        return p.hex()
    if isinstance(p, float) and not math.isfinite(p):
        return NOT_FINITE[0] if math.isnan(p) else NOT_FINITE[1 if p > 0 else 2]
    return str(p)


def arguments_to_json(arguments: Arguments) -> str:
    """One object; an unnamed or repeated name is an error, found in order."""
    out: dict[str, object] = {}
    for i, a in enumerate(arguments):
        if a.name is None:
            raise FormatError.UnnamedArgument(position=i)
        if a.name in out:
            raise FormatError.DuplicateArgument(name=a.name)
        p = a.value.payload
        if isinstance(p, float) and not math.isfinite(p):
            raise FormatError.NonFinite(value=p)
        out[a.name] = p.hex() if isinstance(p, bytes) else p
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def arguments_to_uri(arguments: Arguments) -> str:
    """name=value pairs; order and repeats stay; an unnamed one is an error."""
    parts = []
    for i, a in enumerate(arguments):
        if a.name is None:
            raise FormatError.UnnamedArgument(position=i)
        parts.append(percent_encode_text(a.name) + "=" + percent_encode_text(value_text(a.value)))
    return "&".join(parts)


def debug_row(schema: Schema) -> Column:
    """Cells with ", " between them; null as text, booleans as 0 and 1."""
    cells = []
    for spec in schema:
        text = F.col(spec.name).cast("int").cast("string") if spec.data_type is DataType.BOOL else cell_text(spec)
        cells.append(F.coalesce(text, F.lit("null")))
    return F.concat_ws(", ", *cells)


def debug_lines(table: Table, rows: int | None = None) -> DataFrame:
    """The first rows (all, without a number) as debug text, by position."""
    frame = table.frame if rows is None else table.frame.where(F.col(POS) < max(0, rows))
    return frame.select(POS, debug_row(table.schema).alias("line")).orderBy(POS)


def print_table(table: Table) -> str:
    return "".join(r["line"] + "\n" for r in debug_lines(table).toLocalIterator())


def print_rows(table: Table, rows: int) -> str:
    return "".join(r["line"] + "\n" for r in debug_lines(table, rows).toLocalIterator())


def print_row(table: Table, row: int) -> str:
    found = table.frame.where(F.col(POS) == row).select(debug_row(table.schema)).first()
    return f"Max row is:{table.row_count}\n" if found is None else found[0] + "\n"


def print_column(table: Table) -> str:
    """Position, name, alias, type and width of each column."""
    parts = [f"[({i}) {c.name}{f' ({c.alias})' if c.alias is not None else ''},{c.data_type},{c.data_type.width}]" for i, c in enumerate(table.schema)]
    return " ".join(parts)
