"""Output normalisation of registered queries.

Results are compared by value hash against DuckDB, so every registered
query ends with the same presentation rules on both sides: doubles rounded
to a fixed number of places (half even, ``+ 0.0`` turns -0.0 into 0.0), integers as
BIGINT, dates as ``yyyy-MM-dd`` and timestamps as ``yyyy-MM-dd HH:mm:ss``
text (F14).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


def rounded(x, digits: int = DIGITS):
    """rint(x * 10^d) / 10^d for every double: plain IEEE operations without
    a detour through integers, so every engine gives the same result; NaN
    and infinities stay."""
    scale = float(10 ** digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def report(df: DataFrame, digits: int = DIGITS, keep: tuple[str, ...] = ()) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if f.name in keep:
            cols.append(c)
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            cols.append(rounded(c.cast("double"), digits).alias(f.name))
        elif isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            cols.append(c.cast("bigint").alias(f.name))
        elif isinstance(t, T.BooleanType):
            cols.append(c.cast("bigint").alias(f.name))
        elif isinstance(t, T.DateType):
            cols.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)
