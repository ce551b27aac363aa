"""Registered queries of the typed-table engine, each with its oracle SQL.

Positions follow a unique key, never file order. Nulls do not occur in the input
tables and are derived alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon import errors
from tabulon.arguments import Arguments, name_positions
from tabulon.functions import binary, formats, text
from tabulon.functions.binary import Endian
from tabulon.functions.cursor import BinaryReader, BinaryWriter
from tabulon.operators import aggregates, transforms
from tabulon.operators.ordering import RANK, NullOrder, SortDirection
from tabulon.operators.positions import POS
from tabulon.plans import sql as plan_sql
from tabulon.plans.expression import ExpressionContext, ExpressionEngine, with_formula
from tabulon.schema import ColumnSpec, Schema, UnknownFields
from tabulon.sources.builder import ConcurrentTableBuilder
from tabulon.sources.sqlite import SqliteDatabase
from tabulon.table import Table, split_update
from tabulon.types import DataType as D
from tabulon.values import Value

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def kept(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return kept


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(*specs: tuple) -> list[ColumnSpec]:
    """(name, type[, alias[, nullable]]) as column specs."""
    return [ColumnSpec(s[0], s[1], s[2] if len(s) > 2 else None, s[3] if len(s) > 3 else False) for s in specs]


REGION = Schema(columns(("r_regionkey", D.I32), ("r_name", D.STRING, "region")))
NATION = Schema(columns(("n_nationkey", D.I32), ("n_name", D.STRING, "nation"), ("n_regionkey", D.I32, None, True)))
ORDERS = Schema(columns(("o_orderkey", D.I64), ("o_custkey", D.I64, None, True), ("o_totalprice", D.F64), ("o_orderpriority", D.STRING, "priority")))
CUSTOMER = Schema(columns(("c_custkey", D.I64), ("c_name", D.STRING), ("c_mktsegment", D.STRING, "segment", True), ("c_acctbal", D.F64)))
EVENTS = Schema(columns(("event_id", D.I64), ("event_type", D.STRING), ("value", D.F64)), UnknownFields.STORE)


def regions(spark: SparkSession, d: str) -> Table:
    return Table.from_frame(read(spark, d, "region"), REGION, ["r_regionkey"])


def nations(spark: SparkSession, d: str) -> Table:
    """Nations with a derived null: region 2 is none."""
    derived = read(spark, d, "nation").withColumn("n_regionkey", F.expr("nullif(n_regionkey, 2)"))
    return Table.from_frame(derived, NATION, ["n_nationkey"])


def orders(spark: SparkSession, d: str) -> Table:
    return Table.from_frame(read(spark, d, "orders").withColumn("o_custkey", F.expr("nullif(o_custkey, 7)")), ORDERS, ["o_orderkey"], validate=False)


def customers(spark: SparkSession, d: str) -> Table:
    return Table.from_frame(read(spark, d, "customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')")), CUSTOMER, ["c_custkey"], validate=False)


def events(spark: SparkSession, d: str) -> Table:
    """Events with an extra taken from their JSON text."""
    k = F.get_json_object("props", "$.k")
    return Table.from_frame(read(spark, d, "events"), EVENTS, ["event_id"], validate=False, extras={"k": (k, D.I64)})


def lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount")


LINES = Schema(columns(("l_orderkey", D.I64), ("l_linenumber", D.I32), ("l_partkey", D.I64), ("l_quantity", D.F64), ("l_extendedprice", D.F64), ("l_returnflag", D.STRING, "flag")))
LINE_ORDER = LINES.names  # order and line numbers repeat; rows that tie in all columns are alike


def line_table(spark: SparkSession, d: str, where: str = "true") -> Table:
    return Table.from_frame(read(spark, d, "lineitem").where(where), LINES, LINE_ORDER, validate=False)


def facts(spark: SparkSession, **values: object) -> DataFrame:
    """Driver-side results as one row of text."""
    return spark.createDataFrame([tuple(str(v) for v in values.values())], ", ".join(f"{k} string" for k in values))


def fact_sql(**values: object) -> str:
    return "SELECT " + ", ".join("'" + str(v).replace("'", "''") + f"' AS {k}" for k, v in values.items())


def refused(call: Callable[[], object]) -> str:
    """The name of the error that a call raises."""
    try:
        call()
    except errors.TabulonError as e:
        return type(e).__name__
    return "none"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price total per line item, ten dearest with a stable tie-break."""
    priced = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", transforms.price_total(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")).alias("price"))
    return priced.orderBy(F.desc("price"), "l_orderkey", "l_linenumber").limit(10)


# sources and scans


@query(fact_sql(rows=0, columns=3, empty=True, names="n_nationkey,n_name,n_regionkey"))
def src_rows(spark, d):
    t = Table.empty(spark, NATION)
    return facts(spark, rows=t.row_count, columns=t.column_count, empty=t.is_empty, names=",".join(t.frame.columns[:3]))


STOCK = Schema(columns(("sku", D.U64), ("label", D.STRING, "shown_as"), ("held", D.I32, None, True)))


@query("SELECT sku::DECIMAL(20,0) AS sku, label, held, pos FROM (VALUES (310, 'bolt', 125, 0::BIGINT), (311, 'washer', NULL, 1), (18446744073709551615, 'rivet', -1, 2)) t(sku, label, held, pos)")
def src_push_row(spark, d):
    t = Table.from_rows(spark, STOCK, [(310, "bolt", 125), (311, "washer", None), (Value(D.U64, 2**64 - 1), "rivet", Value(D.I32, -1))])
    return t.frame.withColumnRenamed(POS, "pos")


@query(fact_sql(positions="0,1", rows=2, width="RowWidth", kind="TypeMismatch", null="NullValue"))
def src_push_row_vec(spark, d):
    b = ConcurrentTableBuilder(STOCK)
    positions = [b.push_row_vec([1, "a", None]), b.push_row_vec([2, "b", 5])]
    bad = [refused(lambda r=r: b.push_row_vec(r)) for r in ([1], [Value(D.I64, 1), "a", None], [1, None, None])]
    return facts(spark, positions=",".join(map(str, positions)), rows=b.into_table(spark).row_count, width=bad[0], kind=bad[1], null=bad[2])


@query(fact_sql(last="2", conflict="ExtraConflict", closed="ColumnNotFound"))
def src_push_extras(spark, d):
    open_ = STOCK.with_unknown_fields(UnknownFields.STORE)
    t = Table.from_rows(spark, open_, [(1, "a", None)], [[("tier", "1"), ("tier", "2")]])
    row = [(1, "a", None)]
    return facts(spark, last=t.cell_named(0, "tier").payload, conflict=refused(lambda: Table.from_rows(spark, STOCK, row, [[("label", "x")]])), closed=refused(lambda: Table.from_rows(spark, STOCK, row, [[("tier", "x")]])))


@query("SELECT count(*) AS rows, sum(CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END)::BIGINT AS nulls, 'NullValue' AS strict FROM nation")
def src_validate(spark, d):
    strict = Schema(columns(("n_nationkey", D.I32), ("n_name", D.STRING), ("n_regionkey", D.I32)))
    derived = read(spark, d, "nation").withColumn("n_regionkey", F.expr("nullif(n_regionkey, 2)"))
    found = refused(lambda: Table.from_frame(derived, strict, ["n_nationkey"]))
    return nations(spark, d).frame.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("n_regionkey").isNull(), 1)).alias("nulls")).withColumn("strict", F.lit(found))


@query("SELECT 5 * count(*)::BIGINT AS rows, 5 * count(*)::BIGINT AS positions, sum(3 * r_regionkey)::BIGINT * 5 AS total FROM region")
def src_concurrent(spark, d):
    """Five producers push every region; positions are gapless."""
    import threading

    schema = Schema(columns(("arg", D.U32), ("result", D.U64)))
    b = ConcurrentTableBuilder(schema)
    keys = [r[0] for r in read(spark, d, "region").select("r_regionkey").collect()]
    threads = [threading.Thread(target=lambda: [b.push_row((k, 3 * k)) for k in keys]) for _ in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return b.into_table(spark).frame.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(POS).alias("positions"), F.sum("result").cast("long").alias("total"))


@query(fact_sql(range="1..3", refused="TypeMismatch", rows=3))
def src_extend(spark, d):
    b = ConcurrentTableBuilder(STOCK)
    b.push_row((1, "a", None))
    r = b.extend_rows([(2, "b", 1), (3, "c", 2)])
    return facts(spark, range=f"{r.start}..{r.stop}", refused=refused(lambda: b.extend_rows([(4, "d", 1), (5, 6, 7)])), rows=b.row_count)


@query("SELECT count(*)::VARCHAR AS rows, 'false' AS empty, count(*)::VARCHAR AS frozen FROM nation")
def src_builder_meta(spark, d):
    b = ConcurrentTableBuilder(NATION)
    b.extend_frame(nations(spark, d).frame.drop(POS), ["n_nationkey"])
    rows, empty = b.row_count, b.is_empty
    return facts(spark, rows=rows, empty=str(empty).lower(), frozen=b.into_table(spark).row_count)


@query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS pos FROM nation")
def src_freeze(spark, d):
    b = ConcurrentTableBuilder(NATION)
    b.extend_frame(nations(spark, d).frame.drop(POS), ["n_nationkey"])
    return b.into_table(spark).frame.select("n_nationkey", "n_name", F.col(POS).alias("pos"))


@query("SELECT o_orderstatus AS status, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1")
def src_sql_infer(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("orders")
    return plan_sql.query_table(spark, "SELECT o_orderstatus AS status, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1", order=["status"]).frame.drop(POS)


@query("SELECT o_orderkey::BIGINT AS id, (o_totalprice > 200000) AS dear, o_totalprice::FLOAT::DOUBLE AS price FROM orders")
def src_sql_schema(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("orders")
    schema = Schema(columns(("id", D.U32), ("dear", D.BOOL), ("price", D.F32)))
    t = plan_sql.query_table_with_schema(spark, "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END, o_totalprice FROM orders", schema, order=["id"])
    return t.frame.select("id", "dear", F.col("price").cast("double").alias("price"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name FROM nation")
def scan_rows(spark, d):
    return nations(spark, d).rows().select(F.col(POS).alias("pos"), "n_name")


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS by_alias, 'None' AS absent, '3' AS width FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 3")
def scan_row_cells(spark, d):
    row = nations(spark, d).row(3)
    return facts(spark, key=list(row)[0].payload, by_alias=row.get_named("nation").payload, absent=row.get_named("none"), width=len(row))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, nullif(n_regionkey, 2) AS n_regionkey FROM nation")
def scan_column(spark, d):
    return nations(spark, d).column(2).values().withColumnRenamed(POS, "pos")


@query("SELECT count(*)::VARCHAR AS cells, sum(CASE WHEN n_regionkey = 2 THEN 1 ELSE 0 END)::VARCHAR AS nulls FROM nation")
def scan_column_visit(spark, d):
    seen = []
    nations(spark, d).column(2).for_each_value(seen.append)
    return facts(spark, cells=len(seen), nulls=sum(v.is_null for v in seen))


@query("SELECT o_totalprice FROM orders")
def scan_slice(spark, d):
    t = orders(spark, d)
    assert refused(lambda: t.column(1).as_slice(D.I64)) == "Nullable" and refused(lambda: t.column(1).as_slice(D.I32)) == "TypeMismatch"
    return t.column_named("o_totalprice").as_slice(D.F64)


@query("SELECT n_name AS cell, 'RowOutOfBounds' AS row_first, 'ColumnOutOfBounds' AS col_next FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 4")
def scan_cell(spark, d):
    t = nations(spark, d)
    return facts(spark, cell=t.cell(4, 1).payload, row_first=refused(lambda: t.cell(99, 99)), col_next=refused(lambda: t.cell(0, 99)))


@query("SELECT n_name AS cell, 'ColumnNotFound' AS closed FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 4")
def scan_cell_named(spark, d):
    t = nations(spark, d)
    return facts(spark, cell=t.cell_named(4, "nation").payload, closed=refused(lambda: t.cell_named(99, "nothing")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def extras_lookup(spark, d):
    t = events(spark, d)
    return t.frame.select("event_id", t.extra("k", D.I64).alias("k"))


@query("SELECT count(*)::VARCHAR AS rows, '3' AS columns, 'false' AS empty FROM nation")
def meta_table(spark, d):
    t = nations(spark, d)
    return facts(spark, rows=t.row_count, columns=t.column_count, empty=str(t.is_empty).lower())


# sinks


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, CAST(to_json({'o_orderkey': o_orderkey, 'o_custkey': nullif(o_custkey, 7), 'o_totalprice': o_totalprice, 'o_orderpriority': o_orderpriority}) AS VARCHAR) AS json FROM orders")
def row_json(spark, d):
    return formats.json_lines(orders(spark, d)).withColumnRenamed(POS, "pos")


@query("SELECT '[' || string_agg(CAST(to_json({'r_regionkey': r_regionkey, 'r_name': r_name}) AS VARCHAR), ',' ORDER BY r_regionkey) || ']' AS json FROM region")
def sink_json(spark, d):
    return facts(spark, json=formats.table_to_json(regions(spark, d)))


@query("SELECT '[' || string_agg(CAST(to_json({'r_regionkey': r_regionkey, 'r_name': r_name}) AS VARCHAR), ',' ORDER BY r_name DESC) || ']' AS json FROM region")
def sink_json_ordered(spark, d):
    return facts(spark, json=formats.row_order_to_json(regions(spark, d).row_order_named("region", SortDirection.DESCENDING)))


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) - 1 AS pos, l_orderkey || ',' || l_linenumber || ',' || l_partkey || ',' || l_quantity || ',' || l_extendedprice || ',' || l_returnflag AS csv FROM lineitem")
def sink_csv(spark, d):
    return formats.csv_lines(line_table(spark, d)).withColumnRenamed(POS, "pos")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\",\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS csv FROM documents")
def sink_csv_quoting(spark, d):
    return read(spark, d, "documents").select("doc_id", formats.quoted(F.col("text")).alias("csv"))


@query(fact_sql(json='{"sort key":"prix à 3/4 & plus","pages":6}', twice="DuplicateArgument", unnamed="UnnamedArgument"))
def sink_args_json(spark, d):
    a = Arguments([("sort key", "prix à 3/4 & plus"), ("pages", 6)])
    b = Arguments([("limit", 1), ("limit", 2)])
    c = Arguments([(None, 1)])
    return facts(spark, json=formats.arguments_to_json(a), twice=refused(lambda: formats.arguments_to_json(b)), unnamed=refused(lambda: formats.arguments_to_json(c)))


@query(fact_sql(uri="sort%20key=prix%20%C3%A0%203%2F4%20%26%20plus&pages=6&pages=8", unnamed="UnnamedArgument"))
def sink_args_uri(spark, d):
    a = Arguments([("sort key", "prix à 3/4 & plus"), ("pages", 6), ("pages", 8)])
    return facts(spark, uri=formats.arguments_to_uri(a), unnamed=refused(lambda: formats.arguments_to_uri(Arguments([*a, *Arguments([(None, 1)])]))))


@query("SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS pos, 'r_regionkey=' || r_regionkey || '&r_name=' || replace(url_encode(r_name), '~', '%7E') AS uri FROM region")
def row_uri(spark, d):
    t = regions(spark, d)
    return t.frame.select(F.col(POS).alias("pos"), formats.row_uri(t.schema).alias("uri"))


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_nationkey || ', ' || n_name || ', ' || coalesce(nullif(n_regionkey, 2)::VARCHAR, 'null') AS line FROM nation")
def sink_debug_all(spark, d):
    return formats.debug_lines(nations(spark, d)).withColumnRenamed(POS, "pos")


@query("SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS pos, r_regionkey || ', ' || r_name AS line FROM region ORDER BY r_regionkey LIMIT 3")
def sink_debug_head(spark, d):
    return formats.debug_lines(regions(spark, d), 3).withColumnRenamed(POS, "pos")


@query("SELECT r_regionkey || ', ' || r_name || chr(10) AS row, 'Max row is:5' || chr(10) AS beyond FROM region ORDER BY r_regionkey LIMIT 1 OFFSET 2")
def sink_debug_row(spark, d):
    t = regions(spark, d)
    return facts(spark, row=formats.print_row(t, 2), beyond=formats.print_row(t, 50))


@query(fact_sql(columns="[(0) sku,u64,8] [(1) label (shown_as),string,0] [(2) held,i32,4]"))
def sink_debug_cols(spark, d):
    return facts(spark, columns=formats.print_column(Table.empty(spark, STOCK)))


# schema


@query(fact_sql(collision="DuplicateColumn", same="none", size=3))
def sch_new(spark, d):
    clash = columns(("key", D.I64), ("other", D.I64, "key"))
    return facts(spark, collision=refused(lambda: Schema(clash)), same=refused(lambda: Schema(columns(("key", D.I64, "key")))), size=len(STOCK))


@query(fact_sql(name="label", alias="shown_as", kind="string", nullable=False, null_column=True))
def sch_col(spark, d):
    c = STOCK.column(1)
    return facts(spark, name=c.name, alias=c.alias, kind=c.data_type, nullable=c.is_nullable, null_column=ColumnSpec("n", D.NULL).is_nullable)


@query(fact_sql(closed="reject", opened="store", equal=False))
def sch_policy(spark, d):
    open_ = STOCK.with_unknown_fields(UnknownFields.STORE)
    return facts(spark, closed=STOCK.unknown_fields.value, opened=open_.unknown_fields.value, equal=STOCK == open_)


@query(fact_sql(name=1, alias=1, other="None", case="None", beyond="None"))
def sch_lookup(spark, d):
    return facts(spark, name=STOCK.column_index("label"), alias=STOCK.column_index("shown_as"), other=STOCK.column_index("x"), case=STOCK.column_index("Label"), beyond=STOCK.column(9))


TYPE_ROWS = [("null", 0, False, False), ("bool", 1, False, False), ("i8", 1, True, True), ("i16", 2, True, True), ("i32", 4, True, True), ("i64", 8, True, True), ("u8", 1, True, True), ("u16", 2, True, True), ("u32", 4, True, True), ("u64", 8, True, True), ("f32", 4, True, False), ("f64", 8, True, False), ("string", 0, False, False), ("bytes", 0, False, False), ("uuid", 16, False, False)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {w}, {a}, {b})" for n, w, a, b in TYPE_ROWS) + ") t(name, width, is_numeric, is_integer)")
def sch_type(spark, d):
    return spark.createDataFrame([(t.label, t.width, t.is_numeric, t.is_integer) for t in D], "name string, width int, is_numeric boolean, is_integer boolean")


# projections, filters, transforms


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name FROM nation")
def prj_column(spark, d):
    return nations(spark, d).select_named("nation").withColumnRenamed(POS, "pos")


PAIR = Schema(columns(("left", D.U32), ("right", D.U32), ("sum", D.U32), ("product", D.U32)))


@query("SELECT l_orderkey AS order_key, l_linenumber AS line, least(l_partkey::HUGEINT * 90000 + l_suppkey, 4294967295)::BIGINT AS sum, least(l_partkey::HUGEINT * 90000 * l_suppkey, 4294967295)::BIGINT AS product FROM lineitem")
def sum_product(spark, d):
    schema = Schema([*columns(("l_orderkey", D.I64), ("l_linenumber", D.I32)), *PAIR])
    frame = lines(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 90000).alias("left"), F.col("l_suppkey").alias("right"), F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("product"))
    t = Table(frame, schema).columns_io([2, 3], [4, 5], lambda a, b: [transforms.saturating_add(a, b, D.U32), transforms.saturating_mul(a, b, D.U32)])
    return t.frame.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), "sum", "product")


@query(fact_sql(overlap="Overlap", twice="DuplicateOutput", input="InputOutOfBounds", output="OutputOutOfBounds"))
def prj_io(spark, d):
    t = Table.empty(spark, PAIR)
    said = [refused(lambda i=i, o=o: t.columns_io(i, o, lambda *_: [F.lit(0)] * len(o))) for i, o in (([0, 1], [1]), ([0], [2, 2]), ([9], [0]), ([0], [9]))]
    return facts(spark, overlap=said[0], twice=said[1], input=said[2], output=said[3])


@query("SELECT n_nationkey, n_nationkey * 10 AS n_regionkey FROM nation")
def prj_pair(spark, d):
    t = nations(spark, d)
    assert t.column_pair(1, 1, lambda x: x) is None and t.column_pair(0, 9, lambda x: x) is None
    return t.column_pair(0, 2, lambda x: x * 10).frame.select("n_nationkey", "n_regionkey")


@query("SELECT o_orderkey, o_totalprice / 2 AS o_totalprice FROM orders")
def prj_mut_slice(spark, d):
    return orders(spark, d).column_named("o_totalprice").replaced(lambda x: x / 2).frame.select("o_orderkey", "o_totalprice")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_totalprice FROM orders QUALIFY o_totalprice > 150000")
def flt_values(spark, d):
    return orders(spark, d).column_named("o_totalprice").filter_values(lambda x: x > 150000).withColumnRenamed(POS, "pos")


@query("SELECT pos FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_totalprice FROM orders) WHERE o_totalprice > 150000")
def flt_positions(spark, d):
    return orders(spark, d).column_named("o_totalprice").filter_positions(lambda x: x > 150000).withColumnRenamed(POS, "pos")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_totalprice * 2 AS value FROM orders")
def map_values(spark, d):
    return orders(spark, d).column_named("o_totalprice").map_values(lambda x: x * 2).withColumnRenamed(POS, "pos")


@query("SELECT least(sum(o_orderkey)::HUGEINT * 900000000000000, 9223372036854775807)::VARCHAR AS clamped, sum(o_orderkey)::VARCHAR AS plain FROM orders")
def fold_saturating(spark, d):
    t = orders(spark, d)
    scaled = Table(t.frame.withColumn("o_orderkey", F.col("o_orderkey") * F.lit(900000000).cast("long") * F.lit(1000)), ORDERS)
    clamped = aggregates.fold_saturating(scaled.frame.withColumn("o_orderkey", F.col("o_orderkey").cast("decimal(38,0)") * 1000), "o_orderkey", D.I64)
    return facts(spark, clamped=clamped, plain=t.column(0).fold_saturating())


@query("SELECT l_orderkey, l_linenumber, l_partkey * 3 + 1 AS result, (l_partkey * 3 + 1) % 2 = 0 AS even FROM lineitem")
def xf_scale_bias(spark, d):
    out = lines(spark, d).withColumn("result", transforms.scale_bias(F.col("l_partkey"), 3, 1))
    return out.select("l_orderkey", "l_linenumber", "result", transforms.is_even(F.col("result")).alias("even"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice * (1.0::DOUBLE + l_tax / 100.0::DOUBLE) AS price FROM lineitem")
def price_total(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", transforms.price_total(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")).alias("price"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice + l_tax AS price FROM lineitem")
def xf_price2(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", transforms.price_plus_tax(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")).alias("price"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey % 23 + 1) * (l_partkey % 23 + 1) AS result FROM lineitem")
def xf_square(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", transforms.square(F.col("l_partkey") % 23 + 1).alias("result"))


@query("SELECT l_orderkey, l_linenumber, ([0,1,1,2,3,5,8,13,21,34,55,89,144,233,377,610,987,1597,2584,4181,6765,10946,17711,28657])[l_partkey % 23 + 2]::BIGINT AS result FROM lineitem")
def xf_fib(spark, d):
    return lines(spark, d).select("l_orderkey", "l_linenumber", transforms.fibonacci(F.col("l_partkey") % 23 + 1).alias("result"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice * (1.0::DOUBLE + l_tax / 100.0::DOUBLE) AS price FROM lineitem ORDER BY price DESC, l_orderkey, l_linenumber LIMIT 10")
def price_top(spark, d):
    return flagship(spark, d)


# mutation


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN 'NOWHERE' ELSE r_name END AS r_name FROM region")
def mut_set_cell(spark, d):
    t = regions(spark, d)
    assert refused(lambda: t.set_cell(0, 1, 5)) == "TypeMismatch" and refused(lambda: t.set_cell(99, 0, 1)) == "RowOutOfBounds" and refused(lambda: t.set_cell(0, 0, None)) == "NullValue"
    return t.set_cell(2, 1, "NOWHERE").frame.drop(POS)


@query("SELECT event_id, CASE WHEN event_id = 3 THEN 99 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def extras_set(spark, d):
    t = events(spark, d)
    first = t.frame.where(F.col("event_id") == 3).select(POS).first()[0]
    changed = t.set_named(first, "k", 99)
    return changed.frame.select("event_id", changed.extra("k").cast("long").alias("k"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'X' WHEN n_nationkey = 2 THEN 'Y' ELSE n_name END AS n_name FROM nation")
def mut_row_set(spark, d):
    t = nations(spark, d)
    t = t.row_mut(1).set(1, "X")
    return t.row_mut(2).set_named("nation", "Y").frame.select("n_nationkey", "n_name")


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey < (SELECT max(r_regionkey) FROM region)")
def pop_row(spark, d):
    t, there = regions(spark, d).pop_row()
    assert there and not Table.empty(spark, REGION).pop_row()[1]
    return t.frame.drop(POS)


@query("SELECT n_nationkey, n_nationkey * CASE WHEN n_nationkey < 10 THEN 2 ELSE 3 END AS n_regionkey FROM nation")
def split_rows(spark, d):
    t = split_update(nations(spark, d), 10, {"n_regionkey": F.col("n_nationkey") * 2}, {"n_regionkey": F.col("n_nationkey") * 3})
    return t.frame.select("n_nationkey", "n_regionkey")


@query("SELECT n_nationkey, n_nationkey + 1 AS n_regionkey FROM nation")
def mut_for_each(spark, d):
    return nations(spark, d).rows_mut().for_each({"n_regionkey": F.col("n_nationkey") + 1}).frame.select("n_nationkey", "n_regionkey")


@query("SELECT o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders")
def mut_par(spark, d):
    return orders(spark, d).rows_mut().par_for_each(4096, {"o_totalprice": F.col("o_totalprice") + 1}).frame.select("o_orderkey", "o_totalprice")


# aggregates


@query("SELECT sum(l_partkey)::BIGINT AS total FROM lineitem")
def agg_sum(spark, d):
    return lines(spark, d).agg(aggregates.total("l_partkey").alias("total"))


@query("SELECT sum(l_partkey)::DOUBLE / count(l_partkey) AS keys, round(avg(l_quantity), 9) AS quantity FROM lineitem")
def agg_avg(spark, d):
    return lines(spark, d).agg(aggregates.average("l_partkey", D.I64).alias("keys"), F.round(aggregates.average("l_quantity", D.F64), 9).alias("quantity"))


@query("SELECT max(l_partkey) AS keys, max(l_extendedprice) AS price, min(l_extendedprice) AS least, '-inf'::DOUBLE AS seeded FROM lineitem")
def agg_max(spark, d):
    none = F.max(F.when(F.lit(False), F.col("l_tax")))
    seeded = F.coalesce(none, F.lit(float("-inf")))
    return lines(spark, d).agg(aggregates.maximum("l_partkey", D.I64).alias("keys"), aggregates.maximum("l_extendedprice", D.F64).alias("price"), aggregates.minimum("l_extendedprice", D.F64).alias("least"), seeded.alias("seeded"))


@query("SELECT median(l_quantity) AS quantity, median(l_partkey)::DOUBLE AS keys FROM lineitem")
def agg_median(spark, d):
    return aggregates.median_frame(lines(spark, d), {"l_quantity": "quantity", "l_partkey": "keys"})


@query("SELECT max(nullif(o_custkey, 1499)) AS most FROM orders")
def nullable_max(spark, d):
    return read(spark, d, "orders").select(F.expr("nullif(o_custkey, 1499)").alias("k")).agg(aggregates.maximum("k", D.I64).alias("most"))


@query(
    "SELECT "
    + ", ".join(f"round(avg({c})::DOUBLE, 6) AS {c}_avg, min({c}) AS {c}_min, max({c}) AS {c}_max, median({c})::DOUBLE AS {c}_median" for c in ("l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_discount"))
    + " FROM lineitem"
)
def mixed_summary(spark, d):
    kinds = {"l_partkey": D.I64, "l_linenumber": D.I32, "l_quantity": D.F64, "l_extendedprice": D.F64, "l_tax": D.F64, "l_discount": D.F64}
    out = aggregates.summary(lines(spark, d), kinds)
    return out.withColumns({f"{c}_avg": F.round(f"{c}_avg", 6) for c in kinds})


@query("SELECT count(DISTINCT nullif(o_custkey, 7)) AS n FROM orders")
def distinct_keys(spark, d):
    return orders(spark, d).frame.agg(aggregates.distinct_keys("o_custkey").alias("n"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer QUALIFY c_mktsegment = 'BUILDING'")
def agg_null_rows(spark, d):
    return customers(spark, d).frame.where(F.col("c_mktsegment").isNull()).select(F.col(POS).alias("pos"))


# order


def _order_sql(way: str, nulls: str) -> str:
    return f"SELECT c_custkey, row_number() OVER (ORDER BY nullif(c_mktsegment, 'BUILDING') {way} NULLS {nulls}, c_custkey) - 1 AS rank FROM customer"


def _ordered(direction: SortDirection, nulls: NullOrder) -> Query:
    return lambda spark, d: customers(spark, d).row_order_named("segment", direction, nulls).ranked().select("c_custkey", F.col(RANK).alias("rank"))


for _way in SortDirection:
    for _nulls in NullOrder:
        _name = f"ord_col_{_way.value}_nulls_{_nulls.value}"
        QUERIES[_name] = _ordered(_way, _nulls)
        ORACLES[_name] = _order_sql(_way.value, _nulls.value)


@query("SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS rank, c_custkey FROM customer ORDER BY 1 LIMIT 25")
def ord_view_head(spark, d):
    top = customers(spark, d).row_order_named("c_acctbal", SortDirection.DESCENDING).top(25)
    return Table.from_frame(top.select("c_custkey", (-F.col("c_acctbal")).alias("_b")), Schema(columns(("c_custkey", D.I64))), ["_b", "c_custkey"]).frame.select(F.col(POS).alias("rank"), "c_custkey")


FLOATS = Schema(columns(("value", D.F64, None, True)))
FLOAT_ROWS = [(float("nan"),), (-0.0,), (0.0,), (None,), (float("-inf"),), (-0.0,), (1.5,)]


@query("SELECT * FROM (VALUES (0::BIGINT, 5::BIGINT), (1, 1), (2, 3), (3, 6), (4, 0), (5, 2), (6, 4)) t(pos, rank)")
def ord_float(spark, d):
    t = Table.from_rows(spark, FLOATS, FLOAT_ROWS)
    return t.row_order(0).ranked().select(F.col(POS).alias("pos"), F.col(RANK).alias("rank"))


@query("SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT), (1, 4), (2, 3), (3, 0), (4, 6), (5, 5), (6, 2)) t(pos, rank)")
def ord_float_desc(spark, d):
    t = Table.from_rows(spark, FLOATS, FLOAT_ROWS)
    return t.row_order(0, SortDirection.DESCENDING, NullOrder.FIRST).ranked().select(F.col(POS).alias("pos"), F.col(RANK).alias("rank"))


# index


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer QUALIFY c_mktsegment = 'MACHINERY'")
def idx_rows(spark, d):
    numbers = nations(spark, d).index(2)
    assert numbers.rows("3").isEmpty() and numbers.rows(Value(D.U32, 3)).isEmpty() and numbers.rows(3).count() == 5
    return customers(spark, d).index(2).rows("MACHINERY").withColumnRenamed(POS, "pos")


@query("SELECT l_returnflag AS key, pos // 4096 AS part, list(pos ORDER BY pos) AS positions FROM (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) - 1 AS pos, l_returnflag FROM lineitem) GROUP BY 1, 2")
def idx_build(spark, d):
    """Three keys over all line items, each key's list in parts."""
    assert refused(lambda: orders(spark, d).index(2)) == "UnsupportedIndexType"
    t = line_table(spark, d)
    return t.index(t.schema.named("flag")).groups(span=4096)


@query("SELECT nullif(o_custkey, 7) AS key, 0::BIGINT AS part, list(pos ORDER BY pos) AS positions FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_custkey FROM orders) WHERE o_custkey <> 7 GROUP BY 1")
def idx_many_keys(spark, d):
    """A key for each customer, nulls apart."""
    return orders(spark, d).index(1).groups()


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer QUALIFY c_mktsegment = 'BUILDING'")
def idx_nulls(spark, d):
    return customers(spark, d).index(2).null_rows().withColumnRenamed(POS, "pos")


@query("SELECT count(DISTINCT o_orderpriority)::VARCHAR AS keys FROM orders")
def idx_meta(spark, d):
    t = orders(spark, d)
    return facts(spark, keys=t.index(t.schema.named("priority")).distinct_key_count())


@query("SELECT row_number() OVER (ORDER BY l_linenumber <> 1, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) - 1 AS pos, l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def app_table(spark, d):
    """The first lines of all orders, then the others behind them."""
    t, more = line_table(spark, d, "l_linenumber = 1"), line_table(spark, d, "l_linenumber <> 1")
    both, new = t.append(more)
    assert new == range(t.row_count, t.row_count + more.row_count) and both.row_count == new.stop
    assert refused(lambda: t.append(nations(spark, d))) == "SchemaMismatch"
    return both.frame.select(F.col(POS).alias("pos"), "l_orderkey", "l_linenumber", "l_extendedprice")



# text


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text")


PCT_SQL = "replace(replace(replace(replace(replace(replace(replace(url_encode(text), '~', '%7E'), '%21', '!'), '%2A', '*'), '%27', ''''), '%28', '('), '%29', ')'), '%60', '`')"


@query("SELECT doc_id, text FROM documents")
def txt_utf8(spark, d):
    return documents(spark, d).select("doc_id", text.utf8(F.encode("text", "UTF-8")).alias("text"))


@query("SELECT doc_id, text FROM documents")
def txt_utf16(spark, d):
    return documents(spark, d).select("doc_id", text.utf16(F.encode("text", "UTF-16BE")).alias("text"))


@query("SELECT doc_id, CAST(to_json(text) AS VARCHAR) AS literal FROM documents")
def txt_json_enc(spark, d):
    return documents(spark, d).select("doc_id", text.json_encode(F.col("text")).alias("literal"))


@query("SELECT doc_id, text FROM documents")
def txt_json_dec(spark, d):
    return documents(spark, d).select("doc_id", text.json_decode(text.json_encode(F.col("text"))).alias("text"))


@query(f"SELECT doc_id, {PCT_SQL} AS uri FROM documents")
def txt_pct_enc(spark, d):
    return documents(spark, d).select("doc_id", text.percent_encode(F.col("text")).alias("uri"))


@query("SELECT doc_id, replace(text, '+', ' ') AS text FROM documents")
def txt_pct_dec(spark, d):
    return documents(spark, d).select("doc_id", text.percent_decode(text.percent_encode(F.replace("text", F.lit("+"), F.lit(" ")))).alias("text"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM pages""")
def txt_xml(spark, d):
    return read(spark, d, "pages").select("page_id", text.xml_escape(F.col("html")).alias("xml"))


@query("SELECT doc_id, list_transform(string_split(replace(text, 'ee', chr(2)), 'e'), lambda x: replace(x, chr(2), 'e')) AS parts FROM documents")
def txt_split(spark, d):
    return documents(spark, d).select("doc_id", text.split_escaped(F.col("text"), "e").alias("parts"))


@query("SELECT doc_id, left(text, 10) AS head FROM documents")
def txt_prefix(spark, d):
    return documents(spark, d).select("doc_id", text.prefix_chars(F.col("text"), 10).alias("head"))


@query("SELECT doc_id, regexp_replace(chr(9) || ' ' || text || chr(10), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS text FROM documents")
def txt_trim(spark, d):
    return documents(spark, d).select("doc_id", text.trim_control(F.concat(F.lit("\t "), F.col("text"), F.lit("\n"))).alias("text"))


# binary


@query("SELECT doc_id, lower(hex(encode(text))) AS low, hex(encode(text)) AS high FROM documents")
def bin_hex_enc(spark, d):
    data = F.encode("text", "UTF-8")
    return documents(spark, d).select("doc_id", binary.hex_encode(data).alias("low"), binary.hex_encode_upper(data).alias("high"))


@query("SELECT doc_id, text FROM documents")
def bin_hex_dec(spark, d):
    return documents(spark, d).select("doc_id", binary.hex_decode(binary.hex_encode(F.encode("text", "UTF-8"))).cast("string").alias("text"))


@query("SELECT doc_id, CASE WHEN instr(text, 'an') > 0 THEN octet_length(encode(left(text, instr(text, 'an') - 1))) END AS place FROM documents")
def bin_find(spark, d):
    return documents(spark, d).select("doc_id", binary.find(F.encode("text", "UTF-8"), F.lit(bytearray(b"an"))).alias("place"))


@query("SELECT doc_id, CASE WHEN instr(reverse(text), 'na') > 0 THEN octet_length(encode(left(text, length(text) - instr(reverse(text), 'na') - 1))) END AS place FROM documents")
def bin_rfind(spark, d):
    return documents(spark, d).select("doc_id", binary.rfind(F.encode("text", "UTF-8"), F.lit(bytearray(b"an"))).alias("place"))


@query("SELECT doc_id, CASE WHEN n >= 4 THEN ('0x' || h[1:8])::BIGINT END AS big, CASE WHEN n >= 4 THEN ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT END AS little, CASE WHEN n >= 1 THEN ('0x' || h[1:2])::INT END AS first FROM (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents)")
def bin_read(spark, d):
    """Null where a text is too short to hold the number."""
    data, n = F.encode("text", "UTF-8"), F.octet_length("text")
    big, little = binary.read_integer(data, 0, D.U32), binary.read_integer(data, 0, D.U32, Endian.LITTLE)
    return documents(spark, d).select("doc_id", F.when(n >= 4, big).alias("big"), F.when(n >= 4, little).alias("little"), F.when(n >= 1, binary.read_integer(data, 0, D.U8).cast("int")).alias("first"))


@query("SELECT o_orderkey, -o_orderkey AS i64, (-(o_orderkey % 100))::INT AS i8, (-(o_orderkey % 30000))::INT AS i16, o_orderkey AS u64 FROM orders")
def bin_write(spark, d):
    """Written and read back, every width and sign, both byte orders."""
    k = F.col("o_orderkey")
    values = {"i64": (-k, D.I64), "i8": (-(k % 100), D.I8), "i16": (-(k % 30000), D.I16), "u64": (k, D.U64)}
    out = read(spark, d, "orders").select("o_orderkey")
    for i, (name, (v, kind)) in enumerate(values.items()):
        e = Endian.LITTLE if i % 2 else Endian.BIG
        out = out.withColumn(name, binary.read_integer(binary.write_integer(v, kind, e), 0, kind, e).cast("int" if kind in (D.I8, D.I16) else "long"))
    return out


@query("SELECT o_orderkey, o_totalprice, o_totalprice::FLOAT::DOUBLE AS single FROM orders")
def bin_floats(spark, d):
    p = F.col("o_totalprice")
    double = binary.read_float(binary.write_float(p, D.F64), 0, D.F64)
    single = binary.read_float(binary.write_float(p.cast("float"), D.F32, Endian.LITTLE), 0, D.F32, Endian.LITTLE)
    return read(spark, d, "orders").select("o_orderkey", double.alias("o_totalprice"), single.cast("double").alias("single"))


@query("SELECT doc_id, text, octet_length(encode(text)) + 4 AS size FROM documents")
def bin_prefixed(spark, d):
    framed = documents(spark, d).withColumn("framed", binary.write_str_u32(F.col("text")))
    return framed.select("doc_id", binary.read_str_u32(F.col("framed")).alias("text"), F.octet_length("framed").cast("long").alias("size"))


@query(fact_sql(written="0000000568656c6c6f", back="hello", short="OutOfBounds", position=0))
def bin_cursor(spark, d):
    w = BinaryWriter(9)
    w.write_str_u32("hello")
    r = BinaryReader(w.written[:-1])
    short = refused(r.read_str_u32)
    return facts(spark, written=w.written.hex(), back=BinaryReader(w.written).read_str_u32(), short=short, position=r.position)


# values and arguments


@query(fact_sql(i64=7, f64="7.0", range="OutOfRange", text="TypeMismatch", flag="TypeMismatch", equal=False, nan=False))
def val_convert(spark, d):
    return facts(spark, i64=Value(D.U8, 7).to_i64(), f64=Value(D.U8, 7).to_f64(), range=refused(Value(D.U64, 2**63).to_i64), text=refused(Value.of("7").to_i64), flag=refused(Value.of(True).to_f64), equal=Value(D.I32, 1) == Value(D.I64, 1), nan=Value.of(float("nan")) == Value.of(float("nan")))


@query("SELECT * FROM (VALUES ('item', 0::BIGINT, [0::BIGINT, 2]), ('other', 0, [3])) t(name, part, positions)")
def arg_index(spark, d):
    a = Arguments([("item", 10), (None, False), ("item", 20), ("other", 30)])
    i = a.index()
    assert len(i) == 4 and i.distinct_names == 2 and i.positions("item") == [0, 2] and i.get("item", 1).payload == 20
    return name_positions(a.frame(spark).withColumn("pos", F.col("pos").cast("long")))


@query(fact_sql(first=10, second=20, absent="None", removed=10, left="20,30", contains=True))
def arg_named(spark, d):
    a = Arguments([("item", 10), ("item", 20), ("other", 30)])
    first, second, absent = a.get_named("item").payload, a.get_named_nth("item", 1).payload, a.get_named("none")
    removed = a.remove_named("item").value.payload
    return facts(spark, first=first, second=second, absent=absent, removed=removed, left=",".join(str(x.value.payload) for x in a), contains=a.contains("item"))


@query(fact_sql(first="4.5", beyond="None", named="blue", replaced=True, outside=False, size=3, cleared=0))
def arg_get(spark, d):
    """Reads and writes by position and by name."""
    a = Arguments([(None, 4.5), ("colour", "red"), ("colour", "grey")])
    first, beyond = a.get(0).value.payload, a.get(3)
    replaced, outside = a.set(1, "blue"), a.set(7, "none")
    named, size = a.get_named("colour").payload, len(a)
    a.clear()
    return facts(spark, first=first, beyond=beyond, named=named, replaced=replaced, outside=outside, size=size, cleared=len(a))


@query(fact_sql(kinds="null,bool,i64,u64,f64,string,bytes,uuid", refused="TypeMismatch", narrow="OutOfRange", single="0.10000000149011612"))
def val_from(spark, d):
    """The type that a plain scalar takes, and what a type takes."""
    import uuid

    raw = [None, True, -5, 2**63, 0.5, "t", b"\x01", uuid.UUID(int=7)]
    return facts(spark, kinds=",".join(Value.of(r).data_type.label for r in raw), refused=refused(lambda: Value.of([1])), narrow=refused(lambda: Value(D.I8, 200)), single=Value(D.F32, 0.1).payload)


@query(fact_sql(text="stone", data="ff00", text_of_bytes="TypeMismatch", bytes_of_text="TypeMismatch", flag=True, null=True, widths="8,0,16"))
def val_as(spark, d):
    """Payloads asked for by type, and types themselves."""
    t, b = Value.of("stone"), Value.of(b"\xff\x00")
    return facts(spark, text=t.as_str(), data=b.as_bytes().hex(), text_of_bytes=refused(b.as_str), bytes_of_text=refused(t.as_bytes), flag=Value.of(True).as_bool(), null=Value.of(None).is_null, widths=",".join(str(k.width) for k in (D.U64, D.STRING, D.UUID)))


# SQL


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_totalprice > 150000 AND o_orderstatus <> ';' GROUP BY 1")
def sql_batch(spark, d):
    """Several statements at once; a semicolon in a literal ends none."""
    read(spark, d, "orders").createOrReplaceTempView("orders")
    plan_sql.execute_batch(spark, "CREATE OR REPLACE TEMP VIEW dear AS SELECT * FROM orders WHERE o_totalprice > 150000 AND o_orderstatus <> ';'; -- one; two\nCREATE OR REPLACE TEMP VIEW told AS SELECT o_orderpriority AS priority, count(*) AS n FROM dear GROUP BY 1;")
    return plan_sql.run(spark, "SELECT priority, n FROM told")


@query("SELECT (SELECT count(*) FROM region)::VARCHAR AS kept, '0' AS undone, 'false,true' AS open_then_closed, (SELECT count(*) FROM region)::VARCHAR AS last_row")
def sql_tx(spark, d):
    """Transactions and state of a SQLite connection, over the regions."""
    db = SqliteDatabase.open_in_memory()
    db.execute_batch("CREATE TABLE kept (id INTEGER, name TEXT); CREATE TABLE undone (id INTEGER)")
    rows = [(r["r_regionkey"], r["r_name"]) for r in read(spark, d, "region").collect()]
    db.execute("BEGIN")
    db.execute("INSERT INTO undone VALUES (?)", Arguments([(None, 1)]))
    opened = db.is_autocommit
    db.execute("ROLLBACK")
    db.execute("BEGIN")
    for key, name in rows:
        db.execute("INSERT INTO kept VALUES (?, ?)", Arguments([(None, key), (None, name)]))
    last = db.last_row_id
    db.execute("COMMIT")
    count = lambda t: db.query_table(spark, f"SELECT count(*) AS n FROM {t}").cell(0, 0).payload
    return facts(spark, kept=count("kept"), undone=count("undone"), open_then_closed=f"{opened},{db.is_autocommit}".lower(), last_row=last)


@query("SELECT r_regionkey::BIGINT AS id, r_name AS name, lower(hex(encode(r_name))) AS data, r_regionkey * 0.5::DOUBLE AS half, NULL::VARCHAR AS none FROM region")
def sql_class(spark, d):
    """Every storage class of SQLite, as the type that a column infers from it."""
    db = SqliteDatabase.open_in_memory()
    db.execute("CREATE TABLE region (id INTEGER, name TEXT, data BLOB, half REAL, none TEXT)")
    for r in read(spark, d, "region").collect():
        db.execute("INSERT INTO region VALUES (:id, :name, :data, :half, :none)", Arguments([("id", r["r_regionkey"]), ("name", r["r_name"]), ("data", r["r_name"].encode()), ("half", r["r_regionkey"] * 0.5), ("none", None)]))
    t = db.query_table(spark, "SELECT * FROM region")
    assert [c.data_type for c in t.schema] == [D.I64, D.STRING, D.BYTES, D.F64, D.NULL]
    return t.frame.select("id", "name", F.lower(F.hex("data")).alias("data"), "half", F.col("none").cast("string").alias("none"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000 AND o_orderstatus = 'O'")
def sql_named(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("orders")
    a = Arguments([("low", 100000), (":high", 150000), ("$status", "O")])
    return plan_sql.run(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN :low AND @high AND o_orderstatus = $status", a)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 120000 AND o_custkey < 500")
def sql_positional(spark, d):
    read(spark, d, "orders").createOrReplaceTempView("orders")
    return plan_sql.run(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > ?1 AND o_custkey < ?2", Arguments([(None, 120000), (None, 500)]))


@query(fact_sql(mixed="MixedPlaceholders", arguments="MixedArguments", mode="ModeMismatch", count="CountMismatch", twice="DuplicateArgument", missing="MissingArgument", unknown="UnknownArgument", range="IntegerRange"))
def sql_bind(spark, d):
    cases = [("SELECT ?, :a", [(None, 1)]), ("SELECT :a", [("a", 1), (None, 1)]), ("SELECT 1", [("a", 1)]), ("SELECT ?, ?", [(None, 1)]), ("SELECT :a", [("a", 1), (":a", 2)]), ("SELECT :a, :b", [("a", 1)]), ("SELECT :a", [("a", 1), ("b", 2)]), ("SELECT ?", [(None, 2**64 - 1)])]
    said = [refused(lambda s=s, a=a: plan_sql.run(spark, s, Arguments(a))) for s, a in cases]
    return facts(spark, **dict(zip(("mixed", "arguments", "mode", "count", "twice", "missing", "unknown", "range"), said, strict=True)))


@query("SELECT n_name AS nation, r_name AS region, rank() OVER (PARTITION BY r_name ORDER BY n_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def sql_delegated(spark, d):
    """Joins and windows are the SQL engine's own."""
    for name in ("nation", "region"):
        read(spark, d, name).createOrReplaceTempView(name)
    sql = "SELECT n_name AS nation, r_name AS region, CAST(rank() OVER (PARTITION BY r_name ORDER BY n_name) AS BIGINT) AS place FROM nation JOIN region ON n_regionkey = r_regionkey"
    return plan_sql.query_table(spark, sql, order=["region", "place"]).frame.drop(POS)


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey END::BIGINT AS region FROM nation")
def sql_sqlite(spark, d):
    db = SqliteDatabase.open_in_memory()
    db.execute("CREATE TABLE nation (id INTEGER, name TEXT, region INTEGER)")
    for r in nations(spark, d).frame.collect():
        db.execute("INSERT INTO nation VALUES (:id, @name, $region)", Arguments([("id", r[0]), ("name", r[1]), ("region", r[2])]))
    return db.query_table(spark, "SELECT * FROM nation").frame.drop(POS)


@query(fact_sql(width="ResultWidth", range="ResultRange", kind="ResultType", mixed="MixedColumn", uuid="12345678-1234-5678-9abc-def012345678", changed=1))
def sql_schema(spark, d):
    db = SqliteDatabase.open_in_memory()
    one = lambda k: Schema(columns(("v", k)))
    q = lambda s, k: db.query_table_with_schema(spark, s, one(k))
    db.execute("CREATE TABLE t (v)")
    found = q("SELECT x'12345678123456789abcdef012345678'", D.UUID).cell(0, 0).payload
    return facts(spark, width=refused(lambda: q("SELECT 1, 2", D.I64)), range=refused(lambda: q("SELECT 256", D.U8)), kind=refused(lambda: q("SELECT x'00'", D.STRING)), mixed=refused(lambda: db.query_table(spark, "SELECT 1 AS v UNION ALL SELECT 'one'")), uuid=found, changed=db.execute("INSERT INTO t VALUES (?)", Arguments([(None, 5)])))


# formulas and scripts


def _formula(name: str, formula: str, oracle: str) -> None:
    def run(spark, d):
        frame = lines(spark, d).select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
        return with_formula(frame, "result", formula).select("l_orderkey", "l_linenumber", "result")

    QUERIES[name] = run
    ORACLES[name] = f"SELECT l_orderkey, l_linenumber, {oracle} AS result FROM lineitem"


_formula("exp_formula_short", "x + y * 2", "l_partkey + l_suppkey * 2")
_formula("exp_formula_function", "abs(x - y) + max(x, y)", "abs(l_partkey - l_suppkey) + greatest(l_partkey, l_suppkey)")
_formula("exp_formula_logical", "x > y && x < 100", "l_partkey > l_suppkey AND l_partkey < 100")


@query("SELECT o_orderkey, o_orderkey * 7 AS total FROM orders")
def exp_script(spark, d):
    engine = ExpressionEngine()
    program = engine.compile_script("let total = 0; for i in 0..7 { total += key; } total")
    run = engine.script_column(program, ["key"], D.I64)
    return read(spark, d, "orders").select("o_orderkey", run(F.col("o_orderkey")).alias("total"))


@query(fact_sql(value=23, script=54, changed=0, compile="Compile", evaluate="Evaluate", range="OutOfRange", output="UnsupportedOutput", bounded="Evaluate", native=17))
def exp_eval(spark, d):
    """A formula, a script that changes its context, errors, and a native function."""
    engine = ExpressionEngine()
    context = ExpressionContext(low=2, high=5)
    script = engine.compile_script("let squares = 0; let k = low; while k <= high { squares += k * k; k += 1; } low = 0; squares")
    small = ExpressionEngine(1000).register("block_distance", lambda x, y: abs(x) + abs(y))
    value = engine.evaluate_expression("a * 3 - b", ExpressionContext(a=9, b=4)).payload
    said = engine.evaluate(script, context).payload
    none = ExpressionContext()
    return facts(spark, value=value, script=said, changed=context.get("low").payload, compile=refused(lambda: engine.compile_expression("2 *")), evaluate=refused(lambda: engine.evaluate_expression("unknown - 1", none)), range=refused(lambda: none.set("v", Value(D.U64, 2**64 - 1))), output=refused(lambda: engine.evaluate_expression("[4, 5]", none)), bounded=refused(lambda: small.evaluate(small.compile_script("while true {}"), none)), native=small.evaluate_expression("block_distance(-12, 5)", none).payload)


@query(fact_sql(formula="expression", script="script", same=True, other=False))
def exp_escape(spark, d):
    """Compiled programs as data: their kind, and trees that compare."""
    engine = ExpressionEngine()
    one, again = engine.compile_expression("a + 1"), engine.compile_expression("a  +  1")
    script = engine.compile_script("let b = a; b + 1")
    return facts(spark, formula=one.kind, script=script.kind, same=one.tree == again.tree, other=one.tree == script.tree)
