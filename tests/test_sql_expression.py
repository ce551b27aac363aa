import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.arguments import Arguments
from tabulon.errors import ExpressionError, SqlError, TableError
from tabulon.plans import sql
from tabulon.plans.binder import parse
from tabulon.plans.expression import ExpressionContext, ExpressionEngine, with_formula
from tabulon.schema import ColumnSpec, Schema
from tabulon.sources.sqlite import SqliteDatabase, SqliteSource
from tabulon.types import DataType as D
from tabulon.values import Value


def test_placeholders():
    s = parse("SELECT ':no', \"@no\", :a /* :no */ -- $no\n, @b, x::int, $a")
    assert s.names == ["a", "b"] and s.mode == "named" and "x::int" in s.sql
    assert parse("SELECT ?, ?2, ?").slots == 3
    with pytest.raises(SqlError.MixedPlaceholders):
        parse("SELECT ?, :a")


def test_spark_sql(spark):
    a = Arguments([(":low", 2), ("name", "x'y")])
    assert [tuple(r) for r in sql.run(spark, "SELECT id, :name AS n FROM range(5) WHERE id > @low", a).collect()] == [(3, "x'y"), (4, "x'y")]
    with pytest.raises(SqlError.Prepare):
        sql.run(spark, "SELEC 1")
    with pytest.raises(SqlError.ResultWidth):
        sql.query_table_with_schema(spark, "SELECT 1, ?", Schema([ColumnSpec("v", D.I64)]), Arguments([("wrong", 1)]))
    with pytest.raises(TableError.DuplicateColumn):
        sql.query_table(spark, "SELECT 1 AS a, 2 AS a")
    schema = Schema([ColumnSpec("b", D.BOOL), ColumnSpec("u", D.U32), ColumnSpec("f", D.F32), ColumnSpec("id", D.UUID)])
    t = sql.query_table_with_schema(spark, "SELECT 1, 42, 1.25D, X'12345678123456789ABCDEF012345678'", schema)
    assert [v.payload for v in t.row(0)] == [True, 42, 1.25, "12345678-1234-5678-9abc-def012345678"]
    with pytest.raises(Exception, match="does not fit u8"):
        sql.query_table_with_schema(spark, "SELECT 256", Schema([ColumnSpec("v", D.U8)])).frame.collect()
    with pytest.raises(SqlError.ResultType):
        sql.query_table_with_schema(spark, "SELECT '5'", Schema([ColumnSpec("v", D.I64)]))
    with pytest.raises(Exception, match="0 or 1"):
        sql.query_table_with_schema(spark, "SELECT 2", Schema([ColumnSpec("v", D.BOOL)])).frame.collect()
    sql.execute_batch(spark, "CREATE OR REPLACE TEMP VIEW v1 AS SELECT ';' AS a; CREATE OR REPLACE TEMP VIEW v2 AS SELECT a FROM v1;")
    assert spark.table("v2").first()[0] == ";"


def test_sqlite(spark, tmp_path):
    db = SqliteDatabase.open_in_memory()
    db.execute_batch("CREATE TABLE item(id INTEGER, name TEXT, payload BLOB, score REAL, note TEXT)")
    assert db.execute("INSERT INTO item VALUES (:id, @name, $p, ?4, :n)".replace("?4", ":s"), Arguments([("id", 7), ("name", "łódź"), ("p", b"\x10\x00\xfe"), ("s", 0.25), ("n", None)])) == 1
    t = db.query_table(spark, "SELECT * FROM item")
    assert [c.data_type for c in t.schema] == [D.I64, D.STRING, D.BYTES, D.F64, D.NULL]
    assert [v.payload for v in t.row(0)] == [7, "łódź", b"\x10\x00\xfe", 0.25, None]
    assert db.last_row_id == 1 and db.is_autocommit
    one = lambda k: Schema([ColumnSpec("v", k)])
    for query, kind, error in (("SELECT 256", D.U8, SqlError.ResultRange), ("SELECT x'00'", D.STRING, SqlError.ResultType), ("SELECT NULL", D.I64, TableError.NullValue), ("SELECT 2", D.BOOL, SqlError.ResultRange), ("SELECT 'x'", D.UUID, SqlError.InvalidUuid)):
        with pytest.raises(error):
            db.query_table_with_schema(spark, query, one(kind))
    with pytest.raises(SqlError.MixedColumn):
        db.query_table(spark, "SELECT 1 UNION ALL SELECT 'one'")
    with pytest.raises(SqlError.IntegerRange):
        db.execute("SELECT ?", Arguments([(None, Value(D.U64, 2**64 - 1))]))
    path = str(tmp_path / "f.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t(a INTEGER, b TEXT)")
        c.executemany("INSERT INTO t VALUES (?, ?)", [(i, str(i)) for i in range(100)])
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite").option("path", path).option("table", "t").option("pages", "3").load()
    assert df.where("a >= 50").count() == 50 and df.count() == 100


def test_formulas():
    e = ExpressionEngine()
    assert e.evaluate_expression("a * 3 - b", ExpressionContext(a=9, b=4)).payload == 23
    assert e.evaluate_expression("-7 / 2", ExpressionContext()).payload == -3
    assert e.evaluate_expression("3 in 1..4 && !(2 in 3..4)", ExpressionContext()).payload is True
    for bad in ("1 +", "let x = 1", "1 2", "(", "[1"):
        with pytest.raises(ExpressionError.Compile):
            e.compile_expression(bad)
    for bad in ("missing + 1", "9223372036854775807 + 1", "1 / 0", "nothing(1)", "1 && true"):
        with pytest.raises(ExpressionError.Evaluate):
            e.evaluate_expression(bad, ExpressionContext())
    with pytest.raises(ExpressionError.UnsupportedOutput):
        e.evaluate_expression("[1, 2, 3]", ExpressionContext())
    with pytest.raises(ExpressionError.OutOfRange):
        ExpressionContext(v=Value(D.U64, 2**64 - 1))
    with pytest.raises(ExpressionError.Compile):
        e.compile_expression("(" * 100 + "1" + ")" * 100)


def test_scripts():
    e = ExpressionEngine(1000)
    c = ExpressionContext(low=2, high=5)
    script = e.compile_script("let squares = 0; let k = low; while k <= high { squares += k * k; k += 1; } low = 0; squares")
    assert e.evaluate(script, c).payload == 54 and c.get("low").payload == 0
    fib = e.compile_script("fn fib(n) { if n < 2 { return n; } fib(n - 1) + fib(n - 2) } fib(8)")
    assert e.evaluate(fib, ExpressionContext()).payload == 21
    loop = e.compile_script("let x = 0; while true { x += 1; if x == 7 { break; } } x")
    assert e.evaluate(loop, ExpressionContext()).payload == 7
    for bad in ("while true {}", "fn f(n) { f(n + 1) } f(0)"):
        with pytest.raises(ExpressionError.Evaluate):
            e.evaluate(e.compile_script(bad), ExpressionContext())
    e.register("block_distance", lambda x, y: abs(x) + abs(y))
    assert e.evaluate_expression("block_distance(-12, 5)", ExpressionContext()).payload == 17


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.5, "a", True), (-7, 0.5, "b", False)], "x long, f double, s string, b boolean")
    for formula, want in (("x + 1", [2, -6]), ("x * f", [2.5, -3.5]), ("x / 2", [0, -3]), ("s + \"!\"", ["a!", "b!"]), ("max(x, 0)", [1, 0]), ("x in -8..0", [False, True]), ("if b { x } else { 0 - x }", [1, 7]), ("!b || f > 1.0", [True, True])):
        assert [r["r"] for r in with_formula(df, "r", formula).collect()] == want
    with pytest.raises(ExpressionError.Compile):
        with_formula(df, "r", "x + s")
    plan = with_formula(df.select("x"), "r", "x * 2 + 1")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    e = ExpressionEngine()
    run = e.script_column(e.compile_script("let t = 0; while t * t < x { t += 1; } t"), ["x"], D.I64)
    assert [r[0] for r in spark.range(1, 20).select(run(F.col("id"))).collect()] == [next(t for t in range(9) if t * t >= x) for x in range(1, 20)]


@given(st.integers(-10**6, 10**6), st.integers(-10**6, 10**6), st.integers(-10**6, 10**6))
@settings(max_examples=50, deadline=None)
def test_formula_equals_host(a, b, c):
    assert ExpressionEngine().evaluate_expression("a + b * c", ExpressionContext(a=a, b=b, c=c)).payload == a + b * c


@given(st.lists(st.text("abc", max_size=3), max_size=40))
@settings(max_examples=50, deadline=None)
def test_argument_index_equals_scan(names):
    a = Arguments([(n, i) for i, n in enumerate(names)])
    for n in {*names, "zz"}:
        assert a.index().positions(n) == [i for i, x in enumerate(names) if x == n]
