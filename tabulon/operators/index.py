"""Equality index on one column: positions by key, nulls, distinct keys."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import TableError
from tabulon.operators.positions import POS
from tabulon.types import DataType
from tabulon.values import Value


#: Positions of a part of an index's list.
SPAN = 1 << 20


def position_lists(rows: DataFrame, key: str, pos: str, span: int = SPAN) -> DataFrame:
    """The sorted positions of each key, cut into parts of ``span`` positions."""
    part = F.floor(F.col(pos) / F.lit(span)).cast("long")
    return rows.groupBy(key, part.alias("part")).agg(F.sort_array(F.collect_list(pos)).alias("positions"))


def family(kind: DataType) -> str:
    """Keys match within one family only: signed and unsigned integers are two."""
    return "signed" if kind.is_signed else "unsigned" if kind.is_unsigned else kind.label


class ColumnIndex:
    """Lookups push the key down as a filter; ``groups`` is the whole index as
    data. Null and float columns cannot be indexed."""

    def __init__(self, table, column: int) -> None:
        self.table, self.spec = table, table.schema.at(column)
        if self.spec.data_type is DataType.NULL or self.spec.data_type.is_float:
            raise TableError.UnsupportedIndexType(column=self.spec.name, data_type=str(self.spec.data_type))
        self.column = column

    def rows(self, key: object) -> DataFrame:
        """Positions of the key, ascending; a miss or a key of another family gives none."""
        frame = self.table.frame
        value = Value.of(key)
        own = self.spec.data_type
        if not isinstance(key, Value) and value.data_type.is_integer and own.is_integer:
            same = own.bounds[0] <= value.payload <= own.bounds[1]
        elif not isinstance(key, Value) and own is DataType.UUID and value.data_type is DataType.STRING:
            same = True
        else:
            same = family(value.data_type) == family(own)
        if not same:
            return frame.where(F.lit(False)).select(POS)
        payload = Decimal(value.payload) if own is DataType.U64 else value.payload
        literal = F.lit(payload) if own.is_integer else F.lit(payload).cast(own.spark)
        return frame.where(F.col(self.spec.name) == literal).select(POS).orderBy(POS)

    def null_rows(self) -> DataFrame:
        return self.table.frame.where(F.col(self.spec.name).isNull()).select(POS).orderBy(POS)

    def groups(self, span: int = SPAN) -> DataFrame:
        """key, part and the key's sorted positions in that part, nulls apart. A
        part is a range of ``span`` positions, so that no key, however common, is
        one list in one task."""
        rows = self.table.frame.where(F.col(self.spec.name).isNotNull()).select(F.col(self.spec.name).alias("key"), F.col(POS))
        return position_lists(rows, "key", POS, span)

    def distinct_key_count(self) -> int:
        return self.table.frame.agg(F.countDistinct(self.spec.name).alias("n")).first()["n"]
