"""Column-expression helpers shared by the feature operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.schema import EPS


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def ratio(num: Column, den: Column) -> Column:
    """num / (den + 1e-8), as doubles: zero denominators give huge finite values."""
    return num.cast("double") / (den.cast("double") + F.lit(EPS))


def flag(cond: Column) -> Column:
    return cond.cast("int")


def equal_width_bin(x: Column, lo: Column, hi: Column, bins: int = 5) -> Column:
    """``pd.cut(x, bins, labels=False)`` with edges from the data's min and max:
    right-closed bins, the minimum in bin 0; edge i is ``i * step + lo`` with
    ``step = (hi - lo) / bins`` (numpy linspace). A constant column lands in the
    middle bin."""
    step = (hi - lo) / F.lit(float(bins))
    idx = sum((F.when(x > F.lit(float(i)) * step + lo, 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    return F.when(hi == lo, F.lit(bins // 2)).otherwise(idx).cast("int")


def hour_bin(h: Column) -> Column:
    """``pd.cut(h, [0, 6, 12, 18, 24], labels=False)``: right-closed, so hour 0
    falls outside (null, later 0)."""
    return (
        F.when((h > 0) & (h <= 6), 0)
        .when((h > 6) & (h <= 12), 1)
        .when((h > 12) & (h <= 18), 2)
        .when((h > 18) & (h <= 24), 3)
        .cast("int")
    )


def finite_or_zero(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """+-inf and NaN to null, then null to 0, on every numeric column."""
    out = []
    for f in df.schema.fields:
        col = c(f.name)
        if f.name in keep or not isinstance(f.dataType, T.NumericType):
            out.append(col)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # One comparison: false for NaN (greater than +inf in Spark), for
            # +-inf and for null, so all three become 0.
            out.append(F.when(F.abs(col) < F.lit(float("inf")), col).otherwise(F.lit(0.0)).alias(f.name))
        else:
            out.append(F.coalesce(col, F.lit(0).cast(f.dataType)).alias(f.name))
    return df.select(*out)
