import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.errors import BinaryError, FormatError, TextError
from tabulon.functions import binary, formats, text
from tabulon.functions.binary import Endian
from tabulon.functions.cursor import BinaryReader, BinaryWriter
from tabulon.schema import ColumnSpec, Schema
from tabulon.table import Table
from tabulon.types import DataType as D


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def fails(spark, column, value, match):
    with pytest.raises(Exception, match=match):
        one(spark, column, value)


TEXTS = ["hello world/é~!", "", "a+b", "'(x)*-._`", "😀 ñ%", "line\n\t\x00"]


def test_percent(spark):
    assert one(spark, text.percent_encode, "hello world/é~!") == ["hello%20world%2F%C3%A9%7E!"]
    assert one(spark, text.percent_encode, *TEXTS) == [text.percent_encode_text(t) for t in TEXTS]
    assert one(spark, text.percent_decode, "a+b", "plain", "%C3%A9%41", None) == ["a b", "plain", "éA", None]
    assert one(spark, text.percent_decode, "a%EF%BF%BDb+%25é", "%F0%9F%98%80+\ufffd") == ["a\ufffdb %é", "😀 \ufffd"]
    fails(spark, text.percent_decode, "x%C3+%41", "UTF8")
    fails(spark, text.percent_decode, "bad%2", "at byte 3")
    fails(spark, text.percent_decode, "é%zz", "at byte 2")
    fails(spark, text.percent_decode, "%FF", "UTF8")
    with pytest.raises(TextError.InvalidPercent) as e:
        text.percent_decode_text("bad%2")
    assert e.value.position == 3
    with pytest.raises(TextError.InvalidUtf8):
        text.percent_decode_text("%FF")


def test_escapes(spark):
    assert one(spark, text.xml_escape, "<tag a='x'>&\"") == ["&lt;tag a=&apos;x&apos;&gt;&amp;&quot;"]
    assert one(spark, lambda c: text.json_decode(text.json_encode(c)), *TEXTS, None) == [*TEXTS, None]
    for bad in ("1", "x", '["a"]', "null"):
        fails(spark, text.json_decode, bad, "not a JSON string")
    assert one(spark, lambda c: text.prefix_chars(c, 3), "A😀éZ") == ["A😀é"]
    assert one(spark, text.trim_control, "\x00\t value \r\n", " value ", "a\n") == ["value", " value ", "a"]


@pytest.mark.parametrize("sep", [",", "|", "\\", "$", "😀", "e", "\u0001", "\u0002"])
def test_split(spark, sep):
    rng = random.Random(5)
    cases = ["", sep, sep * 2, sep * 3, f"one{sep}{sep}two{sep}three{sep}"] + ["".join(rng.choice([sep, "a", "\u0001", "\u0002", "\u0003", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    assert one(spark, lambda c: text.split_escaped(c, sep), *cases) == [text.split_escaped_text(c, sep) for c in cases]


def test_split_examples():
    assert text.split_escaped_text("one,,two,three,", ",") == ["one,two", "three", ""]
    assert text.split_escaped_text("", ",") == [""]


def test_utf(spark):
    df = spark.createDataFrame([(bytearray(b"\x00A\xd8=\xde\x00"),)], "b binary")
    assert df.select(text.utf16(F.col("b"))).first()[0] == "A😀"
    for kind, data in ((text.utf8, b"\xf0\x28\x8c\x28"), (text.utf16, b"\xd8\x00")):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame([(bytearray(data),)], "b binary").select(kind(F.col("b"))).collect()
    with pytest.raises(TextError.InvalidUtf16):
        text.utf16_text([0xD800])


def test_hex(spark):
    assert one(spark, binary.hex_decode, "00a1B2ff", "") == [bytearray(b"\x00\xa1\xb2\xff"), bytearray()]
    for bad in ("abc", "0g", "00\n"):
        fails(spark, binary.hex_decode, bad, "not hexadecimal")
        with pytest.raises(BinaryError.InvalidHex):
            binary.hex_decode_bytes(bad)


def test_find(spark):
    data = bytes([1, 2, 3, 2, 3, 4, 2, 3])
    df = spark.createDataFrame([(bytearray(data), bytearray(b"\x02\x03"), bytearray())], "h binary, n binary, e binary")
    h, n, e = F.col("h"), F.col("n"), F.col("e")
    got = df.select(binary.find(h, n), binary.find(h, n, 2), binary.rfind(h, n), binary.find(h, e, 8), binary.find(h, e, 9), binary.rfind(h, e), binary.find(h, n, 7)).first()
    assert tuple(got) == (1, 3, 6, 8, None, 8, None)


@pytest.mark.parametrize("kind", [D.U8, D.I8, D.U16, D.I16, D.U32, D.I32, D.U64, D.I64])
@pytest.mark.parametrize("endian", [Endian.BIG, Endian.LITTLE])
def test_integers_round_trip(spark, kind, endian):
    from decimal import Decimal

    low, high = kind.bounds
    values = [low, high, 0, 1, (low + high) // 3]
    df = spark.createDataFrame([(Decimal(v),) for v in values], "v decimal(20,0)")
    out = df.select(binary.write_integer(F.col("v"), kind, endian).alias("b")).select("b", binary.read_integer(F.col("b"), 0, kind, endian)).collect()
    assert [int(r[1]) for r in out] == values
    assert [bytes(r[0]) for r in out] == [v.to_bytes(kind.width, endian.value, signed=kind.is_signed) for v in values]
    with pytest.raises(Exception, match="does not fit"):
        df.select(binary.write_integer(F.lit(Decimal(high + 1)), kind, endian)).collect()


def test_floats_keep_bits(spark):
    values = [1.5, -0.0, float("inf"), 1e-300, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(binary.read_float(binary.write_float(F.col("v"), D.F64), 0, D.F64)).collect()]
    assert got == values and struct.pack(">d", got[1]) == struct.pack(">d", -0.0)


def test_prefixed(spark):
    framed = spark.createDataFrame([("hello",)], "t string").select(binary.write_str_u32(F.col("t")).alias("b"))
    assert framed.select(binary.read_str_u32(F.col("b"))).first()[0] == "hello"
    with pytest.raises(Exception, match="5 bytes at 4 of 8"):
        framed.select(binary.read_str_u32(F.substring("b", 1, 8))).collect()


def test_cursor():
    w = BinaryWriter(20)
    w.write(D.U16, 513)
    w.write(D.I64, -2, Endian.LITTLE)
    with pytest.raises(BinaryError.OutOfBounds):
        w.write_bytes_u32(b"x" * 7)
    assert w.position == 10 and w.remaining == 10
    r = BinaryReader(w.written)
    assert r.peek() == 2 and r.read(D.U16) == 513 and r.read(D.I64, Endian.LITTLE) == -2 and r.is_eof
    with pytest.raises(BinaryError.Seek):
        r.seek(11)
    r.seek(0)
    with pytest.raises(BinaryError.OutOfBounds):
        r.skip(11)
    assert r.position == 0


@given(st.binary(max_size=300))
@settings(max_examples=50, deadline=None)
def test_cursor_round_trip(data):
    w = BinaryWriter(len(data) + 4)
    w.write_bytes_u32(data)
    assert BinaryReader(w.written).read_bytes_u32() == data
    assert binary.hex_decode_bytes(data.hex()) == data


@given(st.text(max_size=200))
@settings(max_examples=80, deadline=None)
def test_percent_round_trip(t):
    assert text.percent_decode_text(text.percent_encode_text(t)) == t


FORMAT = Schema([ColumnSpec("id", D.U64), ColumnSpec("name", D.STRING), ColumnSpec("note", D.STRING).nullable()])


def test_csv_and_json(spark):
    t = Table.from_rows(spark, FORMAT, [(2, "A, B", None), (1, 'quote "', "line\n2")])
    assert formats.table_to_csv(t) == 'id,name,note\n2,"A, B",\n1,"quote ""","line\n2"\n'
    assert formats.table_to_json(t) == '[{"id":2,"name":"A, B","note":null},{"id":1,"name":"quote \\"","note":"line\\n2"}]'
    assert formats.row_order_to_json(t.row_order(0)).startswith('[{"id":1')
    with pytest.raises(Exception, match="no JSON number"):
        formats.table_to_json(Table.from_rows(spark, Schema([ColumnSpec("v", D.F64)]), [(float("nan"),)]))
    one_empty = Table.from_rows(spark, Schema([ColumnSpec("s", D.STRING)]), [("",)])
    assert formats.table_to_csv(one_empty, header=False) == '""\n'


def test_files(spark, tmp_path):
    t = Table.from_rows(spark, FORMAT, [(2, "b", None), (1, "a", "x")])
    formats.write_json(t, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    formats.write_csv(t, str(tmp_path / "c"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "c")).collect()) == ["1,a,x", "2,b,"]


def test_argument_formats():
    from tabulon.arguments import Arguments

    a = Arguments([("sort key", "prix à 3/4 & plus"), ("pages", 6)])
    assert formats.arguments_to_uri(a) == "sort%20key=prix%20%C3%A0%203%2F4%20%26%20plus&pages=6"
    a.push_named("pages", 7)
    with pytest.raises(FormatError.DuplicateArgument):
        formats.arguments_to_json(a)
    a.push_positional(1)
    with pytest.raises(FormatError.UnnamedArgument) as e:
        formats.arguments_to_uri(a)
    assert e.value.position == 3
