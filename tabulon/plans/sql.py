"""SQL into typed tables, over Spark's views or over a SQLite file.

``query_table`` takes the result's own types, every column nullable;
``query_table_with_schema`` converts into a declared schema: integers are checked
against their range, integers become floats but text never becomes a number,
booleans are 0 or 1, UUIDs are 16 bytes or canonical text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.arguments import Arguments
from tabulon.errors import SqlError
from tabulon.plans.binder import bind, checked, literal, parse
from tabulon.schema import ColumnSpec, Schema
from tabulon.table import Table
from tabulon.types import UUID_PATTERN, DataType


def run(spark: SparkSession, sql: str, arguments: Arguments | None = None) -> DataFrame:
    """One statement with strict parameters."""
    text, literals = bind(sql, arguments or Arguments())
    try:
        return spark.sql(text, args=literals) if literals else spark.sql(text)
    except (AnalysisException, ParseException) as e:
        raise SqlError.Prepare(reason=str(e).splitlines()[0]) from e


def execute_batch(spark: SparkSession, sql: str) -> None:
    """Several statements, without parameters; those before a failing one stay."""
    from tabulon.plans.binder import TOKEN

    parts, now, at = [], [], 0
    for m in TOKEN.finditer(sql):
        if m["skip"] is not None:
            now += [(sql[at : m.start()], True), (m[0], False)]
            at = m.end()
    now.append((sql[at:], True))
    text = []
    for piece, code in now:
        while code and ";" in piece:
            head, piece = piece.split(";", 1)
            text.append(head)
            parts.append("".join(text))
            text = []
        text.append(piece)
    parts.append("".join(text))
    for part in parts:
        if part.strip():
            spark.sql(part)


def inferred(frame: DataFrame) -> tuple[DataFrame, Schema]:
    """The result with its storage classes: bigint, double, text, bytes, null."""
    specs, cells = [], []
    for f in frame.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.NullType):
            kind, cell = DataType.NULL, c
        elif isinstance(t, (T.IntegralType, T.BooleanType)) or (isinstance(t, T.DecimalType) and t.scale == 0):
            kind, cell = DataType.I64, c.cast("long")
        elif isinstance(t, (T.FractionalType,)):
            kind, cell = DataType.F64, c.cast("double")
        elif isinstance(t, T.StringType):
            kind, cell = DataType.STRING, c
        elif isinstance(t, T.BinaryType):
            kind, cell = DataType.BYTES, c
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            kind, cell = DataType.STRING, c.cast("string")
        else:
            raise SqlError.ResultType(column=f.name, actual=t.simpleString(), expected="scalar")
        specs.append(ColumnSpec(f.name, kind, is_nullable=True))
        cells.append(cell.alias(f.name))
    schema = Schema(specs)  # refuses repeated names
    return frame.select(*cells), schema


def query_table(spark: SparkSession, sql: str, arguments: Arguments | None = None, order: list[str] | None = None) -> Table:
    """A result as a table; rows are numbered by ``order`` (all columns, without one)."""
    frame, schema = inferred(run(spark, sql, arguments))
    return Table.from_frame(frame, schema, order or schema.names, validate=False)


def converted(c: Column, kind: T.DataType, spec: ColumnSpec) -> Column:
    """A result column as its declared type; a value that has no place there
    fails the query, and a storage class that has none fails at once."""
    want = spec.data_type
    whole = isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0)
    wrong = SqlError.ResultType(column=spec.name, actual=kind.simpleString(), expected=str(want))

    def stop(text: str) -> Column:
        return F.raise_error(f"column {spec.name!r}: {text}").cast(want.spark)

    if isinstance(kind, T.NullType):
        return c.cast(want.spark)
    if want.is_integer:
        if not (whole or isinstance(kind, T.BooleanType)):
            raise wrong
        low, high = want.bounds
        wide = c.cast("decimal(38,0)")
        return F.when(c.isNull() | ((wide >= F.lit(Decimal(low))) & (wide <= F.lit(Decimal(high)))), wide.cast(want.spark)).otherwise(stop(f"value does not fit {want}"))
    if want.is_float:
        if not (whole or isinstance(kind, T.FractionalType)):
            raise wrong
        return c.cast(want.spark)
    if want is DataType.BOOL:
        if isinstance(kind, T.BooleanType):
            return c
        if not whole:
            raise wrong
        return F.when(c.isNull() | c.isin(0, 1), c == 1).otherwise(stop("a boolean is 0 or 1"))
    if want is DataType.UUID:
        if isinstance(kind, T.BinaryType):
            digits = F.lower(F.hex(c))
            text = F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
            return F.when(c.isNotNull(), F.when(F.octet_length(c) == 16, text).otherwise(stop("not a UUID")))
        if not isinstance(kind, T.StringType):
            raise wrong
        low_text = F.lower(c)
        return F.when(c.isNotNull(), F.when(low_text.rlike(UUID_PATTERN), low_text).otherwise(stop("not a UUID")))
    if type(kind) is not type(want.spark):
        raise wrong
    return c


def query_table_with_schema(spark: SparkSession, sql: str, schema: Schema, arguments: Arguments | None = None, order: list[str] | None = None, validate: bool = False) -> Table:
    """A result converted into a declared schema, column by column in order. The
    width is checked before parameters are."""
    statement = parse(sql)
    values = arguments or Arguments()
    typed_null = {k: F.lit(None) for k in statement.names} | {f"_p{i + 1}": F.lit(None) for i in range(statement.slots)}
    try:
        width = len(spark.sql(statement.sql, args=typed_null).columns) if typed_null else len(spark.sql(statement.sql).columns)
    except (AnalysisException, ParseException):
        width = None  # typing needs the values; the width is checked below
    if width is not None and width != len(schema):
        raise SqlError.ResultWidth(actual=width, expected=len(schema))
    literals = {k: literal(v) for k, v in checked(statement, values).items()}
    try:
        frame = spark.sql(statement.sql, args=literals) if literals else spark.sql(statement.sql)
    except (AnalysisException, ParseException) as e:
        raise SqlError.Prepare(reason=str(e).splitlines()[0]) from e
    if len(frame.columns) != len(schema):
        raise SqlError.ResultWidth(actual=len(frame.columns), expected=len(schema))
    kinds = [f.dataType for f in frame.schema.fields]
    plain = frame.toDF(*[f"_c{i}" for i in range(len(kinds))])
    cells = [converted(F.col(f"_c{i}"), k, spec).alias(spec.name) for i, (k, spec) in enumerate(zip(kinds, schema, strict=True))]
    return Table.from_frame(plain.select(*cells), schema, order or schema.names, validate=validate)
