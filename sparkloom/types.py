"""Column types, how they widen, and which can be compared."""

from __future__ import annotations

from enum import Enum
from functools import reduce

from pyspark.sql import types as T


class DataType(Enum):
    """Types: name, width in bytes (``None``: declared), and the Spark type that stands for it."""

    BIGINT = ("BIGINT", 8, T.LongType())
    INT = ("INT", 4, T.IntegerType())
    SMALLINT = ("SMALLINT", 2, T.ShortType())
    TINYINT = ("TINYINT", 1, T.ByteType())
    DOUBLE = ("DOUBLE", 8, T.DoubleType())
    FLOAT = ("FLOAT", 4, T.FloatType())
    DATE = ("DATE", 3, T.DateType())
    TIME = ("TIME", 5, T.StringType())
    DATETIME = ("DATETIME", 8, T.TimestampNTZType())
    CHAR = ("CHAR", None, T.StringType())
    VARCHAR = ("VARCHAR", None, T.StringType())

    @property
    def width(self) -> int | None:
        return self.value[1]

    @property
    def spark(self) -> T.DataType:
        return self.value[2]

    @classmethod
    def parse(cls, text: str) -> DataType:
        """Type of a name such as ``integer`` or ``varchar(25)``, in any case."""
        name = text.split("(")[0].strip().upper()
        return _ALIASES.get(name) or cls[name]

    @classmethod
    def of(cls, spark: T.DataType) -> DataType:
        for kind, found in _FROM_SPARK:
            if isinstance(spark, kind):
                return found
        raise ValueError(f"no type for {spark.simpleString()}")


_ALIASES = {"INTEGER": DataType.INT, "CHARACTER": DataType.CHAR, "CHARACTER VARYING": DataType.VARCHAR, "NUMERIC": DataType.DOUBLE, "TIMESTAMP": DataType.DATETIME, "REAL": DataType.FLOAT, "LONG": DataType.BIGINT, "STRING": DataType.VARCHAR}
_FROM_SPARK = [
    (T.LongType, DataType.BIGINT), (T.IntegerType, DataType.INT), (T.ShortType, DataType.SMALLINT), (T.ByteType, DataType.TINYINT), (T.DoubleType, DataType.DOUBLE),
    (T.FloatType, DataType.FLOAT), (T.DateType, DataType.DATE), (T.TimestampNTZType, DataType.DATETIME), (T.TimestampType, DataType.DATETIME), (T.StringType, DataType.VARCHAR),
]
_INTEGERS = [DataType.TINYINT, DataType.SMALLINT, DataType.INT, DataType.BIGINT]
_FLOATS = [DataType.FLOAT, DataType.DOUBLE]


def numeric(kind: DataType) -> bool:
    return kind in _INTEGERS or kind in _FLOATS


def _common(a: DataType, b: DataType) -> DataType | None:
    if a is b:
        return a
    if not (numeric(a) and numeric(b)):
        return None
    if a in _INTEGERS and b in _INTEGERS:
        return max(a, b, key=_INTEGERS.index)
    if DataType.DOUBLE in (a, b) or DataType.BIGINT in (a, b):
        return DataType.DOUBLE
    return DataType.FLOAT


def common_type(*kinds: DataType) -> DataType | None:
    """Narrowest type that all given ones widen to. Integers of at most 32 bits and FLOAT stay FLOAT,
    which Spark's own coercion would make DOUBLE; dates and strings widen to themselves only."""
    return reduce(lambda a, b: _common(a, b) if a else None, kinds)


def comparable(a: DataType, b: DataType) -> bool:
    """Comparing is wider than widening: all numbers, all strings, dates with date-times."""
    families = ({*_INTEGERS, *_FLOATS}, {DataType.CHAR, DataType.VARCHAR}, {DataType.DATE, DataType.DATETIME}, {DataType.TIME})
    return any(a in f and b in f for f in families)


def aggregate_type(function: str, *inputs: DataType) -> DataType | None:
    """Planner's rule for the type of an aggregate; execution follows SQL."""
    return DataType.BIGINT if function.upper() == "COUNT" else common_type(*inputs)
