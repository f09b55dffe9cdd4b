"""Statistics as aggregate expressions, with the edge cases that the tuner relies on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness; null for fewer than three values or a constant."""
    n = F.count(x).cast("double")
    return F.when(F.count(x) > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def guarded_correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; 0 where either sum is 0, 1 where it is undefined."""
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)) | (F.count(x) < 2)
    return F.when((F.sum(x) == 0) | (F.sum(y) == 0), 0.0).when(constant, 1.0).otherwise(F.try_divide(F.covar_samp(x, y), F.sqrt(F.var_samp(x) * F.var_samp(y))))


def legacy_percentile(x: Column, p: float) -> Column:
    """The value at position p * (n + 1) of the sorted values, between neighbours by distance, held to the ends."""
    return percentile_of(F.sort_array(F.collect_list(x.cast("double"))), p)


def percentile_of(v: Column, p: float) -> Column:
    """The same from a sorted array."""
    n = F.size(v)
    position = F.lit(p) * (n + 1)
    low = F.floor(position).cast("int")
    inner = F.get(v, low - 1) + (position - low) * (F.get(v, low) - F.get(v, low - 1))
    return F.when(position < 1, F.get(v, F.lit(0))).when(position >= n, F.get(v, n - 1)).otherwise(inner)


def max_over_mean(x: Column) -> Column:
    """The other skewness: the maximum over the mean, 1 where the mean is 0."""
    return F.when(F.avg(x) == 0, 1.0).otherwise(F.try_divide(F.max(x).cast("double"), F.avg(x)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
