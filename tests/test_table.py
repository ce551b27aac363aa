import random

import pytest
from pyspark.sql import functions as F

from tabulon.errors import ColumnSelectionError, ColumnSliceError, TableError
from tabulon.functions import formats
from tabulon.operators.aggregates import fold_saturating
from tabulon.operators.ordering import RANK, NullOrder, SortDirection
from tabulon.operators.positions import POS, with_positions
from tabulon.schema import ColumnSpec, Schema, UnknownFields
from tabulon.sources.builder import ConcurrentTableBuilder
from tabulon.table import Table, split_update
from tabulon.types import DataType as D
from tabulon.values import Value

STOCK = Schema([ColumnSpec("sku", D.U64), ColumnSpec("label", D.STRING).with_alias("shown_as"), ColumnSpec("held", D.I32).nullable()])
COUNT = Schema([ColumnSpec("count", D.I64)])


@pytest.fixture(scope="module")
def stock(spark):
    return Table.from_rows(spark, STOCK, [(310, "bolt", 125), (311, "washer", None)])


def numbers(spark, values, kind=D.I64, nullable=True):
    return Table.from_rows(spark, Schema([ColumnSpec("v", kind).nullable(nullable)]), [(v,) for v in values])


def listed(df):
    return [r[0] for r in df.collect()]


def test_reads(stock):
    assert stock.cell_named(0, "shown_as") == Value.of("bolt")
    assert stock.cell(1, 2).is_null
    assert [v.payload for v in stock.row(0)] == [310, "bolt", 125]
    assert stock.row(5) is None and stock.row(0).get_named("x") is None
    assert [r.position for r in stock.iter_rows()] == [0, 1]
    assert listed(stock.rows(descending=True).select(POS)) == [1, 0]


def test_error_order(spark, stock):
    with pytest.raises(TableError.RowOutOfBounds):
        stock.cell(9, 9)
    with pytest.raises(TableError.ColumnNotFound):
        stock.cell_named(9, "x")
    with pytest.raises(TableError.NullValue):
        stock.set_cell(0, 1, None)
    with pytest.raises(TableError.TypeMismatch):
        stock.set_cell(0, 0, Value(D.I64, 1))
    for row, kind in (((1,), TableError.RowWidth), ((None, 5, 1), TableError.NullValue), ((1, 5, 1), TableError.TypeMismatch)):
        with pytest.raises(kind):
            Table.from_rows(spark, STOCK, [row])
    with pytest.raises(TableError.DuplicateColumn):
        Schema([ColumnSpec("key", D.I64), ColumnSpec("b", D.I64).with_alias("key")])
    null_column = Schema([ColumnSpec("n", D.NULL)])
    with pytest.raises(TableError.TypeMismatch):
        Table.from_rows(spark, null_column, [(1,)])


def test_debug_text(spark, stock):
    assert formats.print_table(stock) == "310, bolt, 125\n311, washer, null\n"
    assert formats.print_rows(stock, 1) == "310, bolt, 125\n"
    assert formats.print_row(stock, 2) == "Max row is:2\n"
    assert formats.print_column(stock) == "[(0) sku,u64,8] [(1) label (shown_as),string,0] [(2) held,i32,4]"
    scalars = Schema([ColumnSpec("flag", D.BOOL), ColumnSpec("ratio", D.F64), ColumnSpec("payload", D.BYTES)])
    assert formats.print_table(Table.from_rows(spark, scalars, [(True, 1.25, b"\x00\xff")])) == "1, 1.25, 00ff\n"


def test_index(spark):
    t = Table.from_rows(spark, STOCK, [(41, "nut", 64), (42, "pin", None), (43, "nut", 9)])
    assert listed(t.index(1).rows("nut")) == [0, 2] and listed(t.index(1).rows("x")) == []
    assert listed(t.index(2).rows(9)) == [2] and listed(t.index(2).null_rows()) == [1]
    assert t.index(2).distinct_key_count() == 2
    assert listed(t.index(0).rows(Value(D.I32, 41))) == [] and listed(t.index(0).rows(Value(D.U8, 41))) == [0]
    with pytest.raises(TableError.UnsupportedIndexType):
        numbers(spark, [1.0], D.F64).index(0)


@pytest.mark.parametrize(("direction", "nulls", "want"), [(SortDirection.ASCENDING, NullOrder.LAST, [0, 3, 2, 1]), (SortDirection.DESCENDING, NullOrder.FIRST, [1, 2, 0, 3])])
def test_order_is_stable(spark, direction, nulls, want):
    t = numbers(spark, [10, None, 20, 10], D.I32)
    order = t.row_order(0, direction, nulls)
    assert listed(order.positions()) == want
    assert [r[POS] for r in order.ranked().orderBy(RANK).collect()] == want


def test_order_of_floats(spark):
    t = numbers(spark, [float("nan"), -0.0, 0.0, None], D.F64)
    assert listed(t.row_order(0).positions()) == [1, 2, 0, 3]


def test_random_order_equals_host_sort(spark):
    rng = random.Random(3)
    values = [rng.choice([None, *range(20)]) for _ in range(300)]
    t = numbers(spark, values)
    want = sorted((i for i, v in enumerate(values) if v is not None), key=lambda i: (values[i], i)) + [i for i, v in enumerate(values) if v is None]
    assert listed(t.row_order(0).positions()) == want


def test_positions_over_buckets(spark):
    df = spark.range(5000).selectExpr("case when id % 7 = 0 then null else id % 50 end as a", "id")
    got = with_positions(df, ["a", "id"], bucket_rows=300).orderBy(POS).collect()
    want = sorted(((r["a"], r["id"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["a"], r["id"]) for r in got] == want and [r[POS] for r in got] == list(range(5000))


def test_columns_io(spark):
    s = Schema([ColumnSpec(n, D.U32) for n in ("left", "right", "sum", "product")])
    t = Table.from_rows(spark, s, [(2, 3, 0, 0), (5, 7, 0, 0)])
    out = t.columns_io([0, 1], [2, 3], lambda a, b: [a + b, a * b]).frame.orderBy(POS).collect()
    assert [(r["sum"], r["product"]) for r in out] == [(5, 6), (12, 35)]
    for i, o, kind in (([0, 2], [2], ColumnSelectionError.Overlap), ([0], [1, 1], ColumnSelectionError.DuplicateOutput), ([7], [9], ColumnSelectionError.InputOutOfBounds), ([0], [9], ColumnSelectionError.OutputOutOfBounds)):
        with pytest.raises(kind):
            t.columns_io(i, o, lambda *c: list(c))
    with pytest.raises(Exception, match="takes u32"):
        t.columns_io([0], [1], lambda a: [a - 10]).frame.collect()
    assert t.column_pair(1, 1, lambda x: x) is None


def test_slices_filters_folds(spark):
    t = Table.from_rows(spark, COUNT, [(1,), (10,), (20,), (5,)])
    c = t.column(0)
    assert listed(c.as_slice(D.I64)) == [1, 10, 20, 5]
    assert [r[1] for r in c.map_values(lambda x: x * 2).orderBy(POS).collect()] == [2, 20, 40, 10]
    assert listed(c.filter_positions(lambda x: x >= 10)) == [1, 2]
    assert c.fold_saturating() == 36
    with pytest.raises(ColumnSliceError.TypeMismatch):
        c.as_slice(D.I32)
    with pytest.raises(ColumnSliceError.Nullable):
        numbers(spark, [1]).column(0).as_slice(D.I64)


def test_fold_saturates_at_every_step(spark):
    for values in ([100, 100, -50], [-100, -100, 30, 127], [120, 7, 1, -300, 5]):
        want = 0
        for v in values:
            want = max(-128, min(127, want + v))
        t = numbers(spark, values, D.I64)
        assert fold_saturating(t.frame.repartition(3), "v", D.I8) == want


def test_mutation(spark, stock):
    changed = stock.set_cell(1, 2, 5).set_named(0, "shown_as", "screw")
    assert [tuple(r)[1:3] for r in changed.frame.orderBy(POS).collect()] == [("screw", 125), ("washer", 5)]
    assert stock.cell(1, 2).is_null
    popped, there = stock.pop_row()
    assert there and popped.row_count == 1 and Table.empty(spark, STOCK).pop_row()[1] is False
    s = Schema([ColumnSpec("arg", D.U32), ColumnSpec("result", D.U32)], UnknownFields.STORE)
    t = Table.from_rows(spark, s, [(i, 0) for i in range(100)])
    out = split_update(t, 40, {"result": F.col("arg") * 2, "partition": F.lit("left")}, {"result": F.col("arg") * 3, "partition": F.lit("right")})
    rows = out.frame.orderBy(POS).select("arg", "result", out.extra("partition")).collect()
    assert all((r[1], r[2]) == ((2 * r[0], "left") if r[0] < 40 else (3 * r[0], "right")) for r in rows)
    with pytest.raises(IndexError):
        t.rows_mut().split_at(101)
    with pytest.raises(ValueError, match="positive"):
        t.rows_mut().par_for_each(0, {})
    assert listed(t.rows_mut().par_for_each(10, {"result": F.lit(1)}).frame.select("result").distinct()) == [1]


def test_extras(spark):
    s = STOCK.with_unknown_fields(UnknownFields.STORE)
    t = Table.from_rows(spark, s, [(1, "a", None), (2, "b", 1)], [[("x", 1), ("x", True)], [("y", b"\x01")]])
    assert t.cell_named(0, "x") == Value.of(True) and t.cell_named(1, "y") == Value.of(b"\x01") and t.cell_named(1, "x") is None
    assert t.set_named(1, "x", 2.5).cell_named(1, "x") == Value.of(2.5)
    with pytest.raises(TableError.ExtraConflict):
        Table.from_rows(spark, STOCK, [(1, "a", None)], [[("shown_as", 1)]])


def test_builder(spark, stock):
    b = ConcurrentTableBuilder(STOCK)
    assert b.is_empty and b.push_row((1, "x", None)) == 0
    with pytest.raises(TableError.TypeMismatch):
        b.extend_rows([(2, "y", 1), (3, 4, 5)])
    assert b.row_count == 1
    assert b.extend_frame(spark.createDataFrame([(5, "z", 1)], "sku long, label string, held int"), ["sku"]) == range(1, 2)
    assert b.push_row((6, "w", 2)) == 2
    other = ConcurrentTableBuilder(STOCK.with_unknown_fields(UnknownFields.STORE))
    with pytest.raises(TableError.SchemaMismatch):
        other.append_to(stock)
    t, new = b.append_to(stock)
    assert new == range(2, 5) and [r["label"] for r in t.rows().collect()] == ["bolt", "washer", "x", "z", "w"]


def test_frame_validation(spark):
    df = spark.createDataFrame([(1, None), (300, "b")], "id int, name string")
    with pytest.raises(TableError.NullValue):
        Table.from_frame(df, Schema([ColumnSpec("name", D.STRING)]), ["id"])
    with pytest.raises(TableError.TypeMismatch):
        Table.from_frame(df, Schema([ColumnSpec("id", D.U8)]), ["id"])
    lazy = Table.from_frame(df, Schema([ColumnSpec("id", D.U8)]), ["id"], validate=False)
    with pytest.raises(Exception, match="takes u8"):
        lazy.frame.collect()
    with pytest.raises(TableError.ColumnNotFound):
        Table.from_frame(df, Schema([ColumnSpec("none", D.U8)]), ["id"])
    assert Table.from_frame(df.limit(0), Schema([ColumnSpec("id", D.I32)]), ["id"]).is_empty


def test_medians_of_many_values(spark):
    import statistics

    from tabulon.operators.aggregates import medians, summary

    df = spark.range(4001).selectExpr("id", "cast((id * 48271) % 4001 as double) / 7 AS r", "if(id % 10 = 0, id, 5L) AS hot", "if(id % 3 = 0, null, id) AS holes", "cast(null as long) AS none", "if(id < 2001, 1L, 2L) AS two")
    rows = df.collect()
    want = {c: statistics.median([r[c] for r in rows if r[c] is not None]) if c != "none" else None for c in df.columns}
    assert medians(df, df.columns, small=50) == want == medians(df, df.columns)
    even = df.where("id < 4000")
    assert medians(even, ["id"], small=10) == {"id": 1999.5}
    assert summary(df, {"id": D.I64, "r": D.F64}, small=100).collect() == summary(df, {"id": D.I64, "r": D.F64}).collect()


def test_index_groups_in_parts(spark):
    t = numbers(spark, [i % 2 for i in range(20)])
    assert sorted(tuple(map(str, r)) for r in t.index(0).groups(span=10).collect()) == sorted((str(k), str(p), str([x for x in range(20) if x % 2 == k and x // 10 == p])) for k in (0, 1) for p in (0, 1))


def test_bounds_are_found_by_halving(spark):
    from tabulon.operators.positions import bounds_under

    for n in (0, 1, 2, 3, 7, 8, 100):
        bounds = [F.struct(F.lit(3 * i).cast("long").alias("a"), F.lit("m").alias("b")) for i in range(n)]
        df = spark.range(-3, 3 * n + 3).withColumn("b", F.when(F.col("id") % 2 == 0, "z"))
        got = [tuple(r) for r in df.select("id", bounds_under(bounds, F.struct("id", "b"))).collect()]
        assert got == [(i, sum((3 * k, "m") <= (i, "z" if i % 2 == 0 else "") for k in range(n))) for i in range(-3, 3 * n + 3)]


def test_average_of_any_long_is_exact(spark):
    from tabulon.operators import aggregates

    rng = random.Random(5)
    values = [rng.randint(-(2**63), 2**63 - 1) for _ in range(400)] + [2**63 - 1] * 50 + [-(2**63)] * 49
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert df.agg(aggregates.average("v", D.I64)).first()[0] == float(sum(values)) / len(values)
    assert df.limit(0).agg(aggregates.average("v", D.I64)).first()[0] is None


def test_medians_of_many_values(spark):
    from tabulon.operators import aggregates

    df = spark.range(5000).selectExpr("(id * 48271) % 5000 AS a", "IF(id % 3 = 0, NULL, id % 7) AS b", "CAST(id AS DOUBLE) / 8 AS c", "CAST(NULL AS LONG) AS d")
    want = df.agg(*[F.median(c).alias(c) for c in "abcd"]).first().asDict()
    for small in (10, 300, 100_000):
        assert aggregates.medians(df, list("abcd"), small) == want


def test_extras_of_a_frame(spark):
    schema = Schema([ColumnSpec("id", D.I64)], UnknownFields.STORE)
    df = spark.createDataFrame([(2, '{"k": 5}', "x"), (1, "{}", None)], "id long, props string, tag string")
    t = Table.from_frame(df, schema, ["id"], extras={"k": (F.get_json_object("props", "$.k"), D.I64), "tag": (F.col("tag"), D.STRING)})
    assert t.cell_named(1, "k") == Value(D.I64, 5) and t.cell_named(0, "k") is None and t.cell_named(1, "tag") == Value.of("x")
    told = t.frame.orderBy(POS).select(t.extra("k", D.I64), t.extra("tag", D.I64), t.extra("tag")).collect()
    assert [tuple(r) for r in told] == [(None, None, None), (5, None, "x")]
    with pytest.raises(TableError.ExtraConflict):
        Table.from_frame(df, schema, ["id"], extras={"id": (F.lit(1), D.I64)})
    with pytest.raises(TableError.ColumnNotFound):
        Table.from_frame(df, Schema([ColumnSpec("id", D.I64)]), ["id"], extras={"k": (F.lit(1), D.I64)})


def test_appends_count_no_row_again(spark):
    t = numbers(spark, [1, 2, 3])
    for _ in range(3):
        t, new = t.append(numbers(spark, [4, 5]))
    assert "row_count" in t.__dict__ and t.row_count == 9 and new == range(7, 9)
    assert t.set_cell(8, 0, 6).__dict__["row_count"] == 9 and t.pop_row()[0].row_count == 8
    assert sorted(listed(t.frame.select(POS))) == list(range(9))


def test_saturating_runs_equal_steps():
    from tabulon.operators.aggregates import run_between

    rng = random.Random(3)
    for low, high in ((-128, 127), (0, 255), (-(2**63), 2**63 - 1), (0, 2**64 - 1)):
        for size in (1, 5, 60):
            for scale in (3, 90, (high - low) // 3):
                values = [rng.randint(-scale, scale) for _ in range(size)]
                least, most = low, high
                got = low, high
                for at in range(0, size, 7):
                    part = values[at : at + 7]
                    moved, *got = run_between(part, *got, low, high)
                    assert moved == sum(part)
                for v in values:
                    least, most = max(low, min(high, least + v)), max(low, min(high, most + v))
                assert tuple(got) == (least, most)
