"""Stable order by one column. Nulls stand first or last whatever the direction;
ties keep their positions, descending too; floats follow the IEEE total order
(Spark sees no sign on NaN, so every NaN sorts above infinity)."""

from __future__ import annotations

import enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.positions import POS, with_positions
from tabulon.schema import ColumnSpec
from tabulon.types import DataType

RANK = "_rank"


class SortDirection(enum.Enum):
    ASCENDING = "asc"
    DESCENDING = "desc"


class NullOrder(enum.Enum):
    FIRST = "first"
    LAST = "last"


def sort_keys(spec: ColumnSpec, direction: SortDirection, nulls: NullOrder) -> list[Column]:
    """The sort expressions, position last."""
    if spec.data_type is DataType.NULL:
        return [F.col(POS).asc()]
    value = F.col(spec.name)
    down = direction is SortDirection.DESCENDING

    def way(c: Column) -> Column:
        first = nulls is NullOrder.FIRST
        if down:
            return c.desc_nulls_first() if first else c.desc_nulls_last()
        return c.asc_nulls_first() if first else c.asc_nulls_last()

    keys = [way(value)]
    if spec.data_type.is_float:
        # Spark ties -0.0 with 0.0; text tells them apart
        keys.append(way(F.when(value.isNotNull(), F.when((value == 0) & (value.cast("string") == "-0.0"), 0).otherwise(1))))
    return [*keys, F.col(POS).asc()]


class RowOrder:
    """A permutation of a table's rows; rows are not moved until asked for."""

    def __init__(self, table, spec: ColumnSpec, direction: SortDirection, nulls: NullOrder) -> None:
        self.table, self.spec, self.direction, self.nulls = table, spec, direction, nulls

    @property
    def keys(self) -> list[Column]:
        return sort_keys(self.spec, self.direction, self.nulls)

    def __len__(self) -> int:
        return self.table.row_count

    @property
    def is_empty(self) -> bool:
        return self.table.is_empty

    def rows(self) -> DataFrame:
        """The rows in order, by a range-partitioned sort."""
        return self.table.frame.orderBy(*self.keys)

    def positions(self) -> DataFrame:
        return self.rows().select(POS)

    def ranked(self) -> DataFrame:
        """Rows with their rank in the order, from 0: the order as data. A
        descending order is the ascending one of flipped nulls and ties, read
        from its end, so no direction needs a global sort."""
        frame = self.table.frame
        down = self.direction is SortDirection.DESCENDING and self.spec.data_type is not DataType.NULL
        nulls = self.nulls if not down else NullOrder.LAST if self.nulls is NullOrder.FIRST else NullOrder.FIRST
        keys = {f"_k{i}": key for i, key in enumerate(_comparable(self.spec, nulls))}
        keyed = frame.withColumns(keys | {"_tie": -F.col(POS) if down else F.col(POS)}).withColumnRenamed(POS, "_at")
        ranked = with_positions(keyed, [*keys, "_tie"])
        rank = F.lit(frame.count() - 1) - F.col(POS) if down else F.col(POS)
        return ranked.withColumn(RANK, rank).withColumn(POS, F.col("_at")).select(*frame.columns, RANK)

    def top(self, count: int) -> DataFrame:
        """The first rows of the order: a bounded heap in each task."""
        return self.rows().limit(count)


def _comparable(spec: ColumnSpec, nulls: NullOrder) -> list[Column]:
    """Columns whose plain ascending order, nulls first, is the asked one."""
    if spec.data_type is DataType.NULL:
        return []
    value = F.col(spec.name)
    keys = [F.when(value.isNull(), F.lit(0 if nulls is NullOrder.FIRST else 2)).otherwise(F.lit(1)), value]
    if spec.data_type.is_float:
        keys.append(F.when((value == 0) & (value.cast("string") == "-0.0"), 0).otherwise(1))
    return keys
