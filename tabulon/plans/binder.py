"""Strict SQL parameters.

Spark ignores arguments that no placeholder takes and knows one spelling of each
kind; here placeholders (?, ?1, :name, @name, $name) are found by a scanner that
skips quotes and comments, every mismatch is an error, and the statement is
rewritten to Spark's spelling with typed literals beside it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.arguments import Arguments
from tabulon.errors import SqlError
from tabulon.types import DataType
from tabulon.values import Value

TOKEN = re.compile(
    r"""(?P<skip>'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?(?:\*/|\Z)|::)
      | \?(?P<number>\d+)? | (?P<mark>[:@$])(?P<name>[A-Za-z_]\w*)""",
    re.X | re.S,
)


@dataclass
class Statement:
    """A statement with Spark's placeholders, and what it takes."""

    sql: str
    mode: str  # none, positional, named
    slots: int
    names: list[str]


def parse(sql: str) -> Statement:
    out, at, order, names, numbers = [], 0, [], [], []
    for m in TOKEN.finditer(sql):
        if m["skip"] is not None:
            continue
        out.append(sql[at : m.start()])
        at = m.end()
        if m["name"] is not None:
            if m["name"] not in names:
                names.append(m["name"])
            out.append(f":{m['name']}")
        else:
            number = int(m["number"]) if m["number"] else (max(numbers, default=0) + 1)
            numbers.append(number)
            order.append(number)
            out.append(f":_p{number}")
    out.append(sql[at:])
    if names and numbers:
        raise SqlError.MixedPlaceholders()
    return Statement("".join(out), "named" if names else "positional" if numbers else "none", max(numbers, default=0), names)


def plain_name(name: str) -> str:
    """Without one leading mark, so that id and :id are one name."""
    return name[1:] if name[:1] in (":", "@", "$") else name


def literal(value: Value) -> Column:
    """A typed literal: integers as bigint, floats as double, UUIDs as 16 bytes."""
    t, p = value.data_type, value.payload
    if t is DataType.NULL:
        return F.lit(None)
    if t.is_integer:
        if p > DataType.I64.bounds[1]:
            raise SqlError.IntegerRange(value=p)
        return F.expr(f"{p}L")
    if t.is_float:
        return F.lit(float(p))
    if t is DataType.BOOL:
        return F.expr(f"{int(p)}L")
    if t is DataType.UUID:
        return F.lit(bytearray.fromhex(p.replace("-", "")))
    return F.lit(bytearray(p)) if t is DataType.BYTES else F.lit(p)


def checked(statement: Statement, arguments: Arguments) -> dict[str, Value]:
    """Values by placeholder name, or the first error in the fixed order: mixed
    arguments, mode, then count or names."""
    named = [a for a in arguments if a.name is not None]
    if named and len(named) != len(arguments):
        raise SqlError.MixedArguments()
    given = "none" if not len(arguments) else "named" if named else "positional"
    if given != statement.mode:
        raise SqlError.ModeMismatch(expected=statement.mode, actual=given)
    if statement.mode == "positional":
        if len(arguments) != statement.slots:
            raise SqlError.CountMismatch(expected=statement.slots, actual=len(arguments))
        return {f"_p{i}": a.value for i, a in enumerate(arguments, 1)}
    out: dict[str, Value] = {}
    for a in named:
        name = plain_name(a.name)
        if name in out:
            raise SqlError.DuplicateArgument(name=name)
        out[name] = a.value
    for name in statement.names:
        if name not in out:
            raise SqlError.MissingArgument(name=name)
        literal(out[name])
    for name in out:
        if name not in statement.names:
            raise SqlError.UnknownArgument(name=name)
    return out


def bind(sql: str, arguments: Arguments) -> tuple[str, dict[str, Column]]:
    """The rewritten statement and its literals for spark.sql(sql, args)."""
    statement = parse(sql)
    return statement.sql, {k: literal(v) for k, v in checked(statement, arguments).items()}
