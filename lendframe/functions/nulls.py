"""NULL rules. NULL is the only missing value; NaN is removed when a table is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def null_clean(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (FloatType, DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def flag(cond: Column) -> Column:
    """A condition as 1/0; an unknown condition counts as 0 and stays in every average."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def only_if(cond: Column, value: Column) -> Column:
    return F.when(cond, value)


def clip0(value: Column) -> Column:
    """Negative -> 0; NULL stays NULL, which greatest() would not do."""
    return F.when(value < 0, F.lit(0).cast("double")).otherwise(value.cast("double"))


def sdiv(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def sum0(value: Column) -> Column:
    """Sum that is 0, not NULL, when every value is missing."""
    return F.coalesce(F.sum(value), F.lit(0))


def null_count(cols: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.isnull(F.col(c)).cast("int") for c in cols])


def safe_corr(a: Column, b: Column) -> Column:
    """Aggregate: Pearson correlation over rows with both values, NULL when one is constant.

    corr() raises a division by zero on a constant column under ANSI rules.
    """
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
