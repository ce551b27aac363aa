"""Text functions, column to column; a failed conversion fails the query.

Each has a driver-side twin that raises a typed error."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.errors import TextError

#: Fixed value: the marks that stay as they are in percent-encoding, with
#: letters and digits.
UNESCAPED = "!'()*-._`"


def _one(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _checked(ok: Column, result: Column, message: str | Column) -> Column:
    return F.when(ok, result).otherwise(F.raise_error(message).cast("string"))


def utf8(data: Column) -> Column:
    """Text of UTF-8 bytes."""
    return F.validate_utf8(data.cast("string"))


def utf8_text(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        raise TextError.InvalidUtf8() from None


def utf16(data: Column) -> Column:
    """Text of big-endian UTF-16 units; a lone surrogate is an error."""
    return F.decode(data, "UTF-16BE")


def utf16_text(units: list[int]) -> str:
    try:
        return b"".join(u.to_bytes(2, "big") for u in units).decode("utf-16-be")
    except UnicodeDecodeError:
        raise TextError.InvalidUtf16() from None


def json_encode(text: Column) -> Column:
    """The JSON string literal of a text, with its quotes."""
    whole = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def json_encode_text(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def json_decode(literal: Column) -> Column:
    """The text of a JSON string literal; anything else is an error."""

    def told(v: Column) -> Column:
        good = v.isNotNull() & (F.schema_of_variant(v) == "STRING")
        return _checked(good, F.variant_get(v, "$", "string"), "not a JSON string")

    return F.when(literal.isNotNull(), _one(F.try_parse_json(literal), told))


def json_decode_text(literal: str) -> str:
    try:
        found = json.loads(literal)
    except ValueError as e:
        raise TextError.InvalidJson(reason=str(e)) from None
    if not isinstance(found, str):
        raise TextError.InvalidJson(reason=type(found).__name__)
    return found


def percent_encode(text: Column) -> Column:
    """Percent-encoding of UTF-8 bytes; the space is %20 and the tilde %7E."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for mark in UNESCAPED:
        if mark not in "*-._":  # the encoder leaves these alone
            out = F.replace(out, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    return F.replace(out, F.lit("~"), F.lit("%7E"))


def percent_encode_text(text: str) -> str:
    keep = set(UNESCAPED)
    return "".join(chr(b) if b < 128 and (chr(b).isalnum() or chr(b) in keep) else f"%{b:02X}" for b in text.encode("utf-8"))


def percent_decode(text: Column) -> Column:
    """Plus is a space; a malformed escape fails with its byte offset, then bytes
    that are not UTF-8 fail.

    Spark's decoder is right for well-formed text but for putting U+FFFD where
    bytes are not UTF-8; a result that has one is decoded again byte by byte."""
    return _one(text, _percent_decoded)


def _percent_decoded(text: Column) -> Column:
    bad = r"%(?![0-9A-Fa-f]{2})"
    pieces = F.split(F.replace(text, F.lit("+"), F.lit(" ")), "%", -1)
    tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.concat(F.substring(p, 1, 2), F.hex(F.encode(F.substring(p, F.lit(3), F.length(p)), "UTF-8"))))
    digits = F.concat(F.hex(F.encode(F.get(pieces, F.lit(0)), "UTF-8")), F.array_join(tail, ""))
    by_bytes = F.validate_utf8(F.unhex(digits).cast("string"))
    decoded = _one(F.url_decode(text), lambda d: F.when(d.contains("\ufffd"), by_bytes).otherwise(d))
    place = F.octet_length(F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(bad)) - 1))
    return F.when(text.isNotNull(), F.when(~text.rlike("[%+]"), text).otherwise(_checked(~text.rlike(bad), decoded, F.concat(F.lit("malformed escape at byte "), place.cast("string")))))


def percent_decode_text(text: str) -> str:
    data, out, at = text.encode("utf-8"), bytearray(), 0
    while at < len(data):
        if data[at] == 37:
            pair = data[at + 1 : at + 3]
            if len(pair) < 2 or not all(chr(c) in "0123456789abcdefABCDEF" for c in pair):
                raise TextError.InvalidPercent(position=at)
            out.append(int(pair, 16))
            at += 3
        else:
            out.append(32 if data[at] == 43 else data[at])
            at += 1
    return utf8_text(bytes(out))


def xml_escape(text: Column) -> Column:
    """The five XML entities; the ampersand first."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def split_escaped(text: Column, separator: str) -> Column:
    """Parts between single separators; a doubled one stands for itself; a
    trailing single one gives an empty last part.

    A doubled separator is a pair counted from the left of its run, so a run of
    k is k // 2 literal ones, and an odd run ends with a split. Runs are replaced
    by marks that no text holds twice in a row, then the text is split."""
    if len(separator) != 1:
        raise ValueError("separator must be one character")
    quoted = "\\Q" + separator + "\\E"
    # a private mark is escaped first, so any text is safe
    safe = F.replace(text, F.lit("\u0001"), F.lit("\u0001\u0002"))
    if separator in "\u0001\u0002\u0003":
        return F.transform(_split_by_letters(text, separator), lambda p: p)
    paired = F.regexp_replace(safe, f"{quoted}{quoted}", "\u0001\u0003")
    parts = F.split(paired, quoted, -1)
    return F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\u0001\u0003"), F.lit(separator)), F.lit("\u0001\u0002"), F.lit("\u0001")))


def _split_by_letters(text: Column, separator: str) -> Column:
    """The same by folding over letters, for separators that are marks themselves."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(False).alias("pending"))

    def step(s: Column, c: Column) -> Column:
        is_sep = c == F.lit(separator)
        literal = F.struct(s["done"].alias("done"), F.concat(s["now"], F.lit(separator)).alias("now"), F.lit(False).alias("pending"))
        wait = F.struct(s["done"].alias("done"), s["now"].alias("now"), F.lit(True).alias("pending"))
        cut = F.struct(F.array_append(s["done"], s["now"]).alias("done"), c.alias("now"), F.lit(False).alias("pending"))
        grow = F.struct(s["done"].alias("done"), F.concat(s["now"], c).alias("now"), F.lit(False).alias("pending"))
        return F.when(is_sep & s["pending"], literal).when(is_sep, wait).when(s["pending"], cut).otherwise(grow)

    def finish(s: Column) -> Column:
        whole = F.array_append(s["done"], s["now"])
        return F.when(s["pending"], F.array_append(whole, F.lit(""))).otherwise(whole)

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, finish)


def split_escaped_text(text: str, separator: str) -> list[str]:
    parts, now, at = [], [], 0
    while at < len(text):
        if text[at] == separator:
            if text[at + 1 : at + 2] == separator:
                now.append(separator)
                at += 1
            else:
                parts.append("".join(now))
                now = []
        else:
            now.append(text[at])
        at += 1
    return [*parts, "".join(now)]


def prefix_chars(text: Column, count: int) -> Column:
    """The first Unicode scalars."""
    return F.left(text, F.lit(count))


def trim_control(text: Column) -> Column:
    """Without U+0000 to U+0020 at either end; other white space stays."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
