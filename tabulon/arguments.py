"""Ordered, optionally named arguments; duplicates and unnamed ones are kept."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.index import SPAN, position_lists
from tabulon.values import Value


@dataclass
class Argument:
    """A value that may have a name."""

    value: Value
    name: str | None = None

    @staticmethod
    def named(name: str, value: object) -> Argument:
        return Argument(Value.of(value), name)

    @staticmethod
    def positional(value: object) -> Argument:
        return Argument(Value.of(value))

    def parts(self) -> tuple[str | None, Value]:
        return self.name, self.value


class Arguments:
    """A list of arguments; lookups by name give the first match."""

    def __init__(self, items: Iterable[Argument | tuple[str | None, object]] = ()) -> None:
        self._items: list[Argument] = []
        self.extend(items)

    def push(self, item: Argument | tuple[str | None, object]) -> Arguments:
        self._items.append(item if isinstance(item, Argument) else Argument(Value.of(item[1]), item[0]))
        return self

    def push_named(self, name: str, value: object) -> Arguments:
        return self.push(Argument.named(name, value))

    def push_positional(self, value: object) -> Arguments:
        return self.push(Argument.positional(value))

    def extend(self, items: Iterable[Argument | tuple[str | None, object]]) -> Arguments:
        for item in items:
            self.push(item)
        return self

    def clear(self) -> None:
        self._items.clear()

    def __len__(self) -> int:
        return len(self._items)

    def __iter__(self) -> Iterator[Argument]:
        return iter(self._items)

    @property
    def is_empty(self) -> bool:
        return not self._items

    def get(self, position: int) -> Argument | None:
        return self._items[position] if 0 <= position < len(self._items) else None

    def set(self, position: int, value: object) -> bool:
        """Replaces the value at a position; whether there is one."""
        found = self.get(position)
        if found is not None:
            found.value = Value.of(value)
        return found is not None

    def get_named(self, name: str) -> Value | None:
        return self.get_named_nth(name, 0)

    def get_named_nth(self, name: str, nth: int) -> Value | None:
        """The value of the nth argument of that name, from 0."""
        for a in self._items:
            if a.name == name:
                if nth == 0:
                    return a.value
                nth -= 1
        return None

    def contains(self, name: str) -> bool:
        return any(a.name == name for a in self._items)

    def remove(self, position: int) -> Argument | None:
        return self._items.pop(position) if 0 <= position < len(self._items) else None

    def remove_named(self, name: str) -> Argument | None:
        """Takes out the first of that name; the order of the rest stays."""
        return next((self._items.pop(i) for i, a in enumerate(self._items) if a.name == name), None)

    def index(self) -> ArgumentIndex:
        return ArgumentIndex(self)

    def frame(self, spark: SparkSession) -> DataFrame:
        """pos, name and text of each argument as rows."""
        rows = [(i, a.name, None if a.value.is_null else str(a.value.payload)) for i, a in enumerate(self._items)]
        return spark.createDataFrame(rows, "pos int, name string, value string")


class ArgumentIndex:
    """Positions by name. Unnamed arguments count in len, not in names."""

    def __init__(self, arguments: Arguments) -> None:
        self._arguments, self._places = arguments, {}
        for i, a in enumerate(arguments):
            if a.name is not None:
                self._places.setdefault(a.name, []).append(i)

    def __len__(self) -> int:
        return len(self._arguments)

    @property
    def distinct_names(self) -> int:
        return len(self._places)

    def positions(self, name: str) -> list[int]:
        return list(self._places.get(name, ()))

    def get(self, name: str, nth: int = 0) -> Value | None:
        found = self._places.get(name, ())
        return self._arguments.get(found[nth]).value if nth < len(found) else None

    def contains(self, name: str) -> bool:
        return name in self._places


def name_positions(rows: DataFrame, name: str = "name", pos: str = "pos", span: int = SPAN) -> DataFrame:
    """The same index over argument rows: positions of each name, in order, in
    parts of ``span`` positions."""
    return position_lists(rows.where(F.col(name).isNotNull()), name, pos, span)
