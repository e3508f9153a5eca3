"""Guarded statistics: Pearson, Spearman, least squares, Wilcoxon signed rank."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pearson(x: Column, y: Column, least: int = 4) -> Column:
    """0 where either side is constant; null under `least` pairs."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(x) >= least, F.coalesce(F.try_divide(F.covar_pop(x, y), F.when(spread > 0, spread)), F.lit(0.0)))


def average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Ranks within groups, ties at their mean. Groups are conversations, or another bounded key."""
    ordered, tied = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(ordered) + (F.count("*").over(tied) - 1) / 2)


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(by..., rho): null under `least` rows or for a constant side."""
    ranked = average_rank(average_rank(df, by, x, "__rx"), by, y, "__ry")
    return ranked.groupBy(*by).agg(rank_correlation("__rx", "__ry", least).alias("rho"))


def rank_correlation(rx: str, ry: str, least: int = 3) -> Column:
    """Spearman's rho over columns of ranks, an aggregate."""
    spread = F.stddev_pop(rx) * F.stddev_pop(ry)
    return F.when(F.count("*") >= least, F.try_divide(F.covar_pop(rx, ry), F.when(spread > 0, spread)))


def slope_intercept(x: Column, y: Column) -> tuple[Column, Column]:
    slope = F.try_divide(F.covar_pop(x, y), F.when(F.var_pop(x) > 0, F.var_pop(x)))
    return slope, F.avg(y) - slope * F.avg(x)


def normal_two_sided(z: Column) -> Column:
    """Two-sided tail of the standard normal by the Abramowitz-Stegun 7.1.26 form of erfc (error under 2e-7)."""
    u = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * u)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-u * u))


def wilcoxon(pairs: DataFrame, by: list[str], a: str, b: str, parts: int = 256) -> DataFrame:
    """(by..., n_used, wilcoxon_stat, p_value): zero differences dropped, normal approximation with tie correction.

    Differences are counted by size first, so ranks are taken over distinct sizes, not rows. These are laid out in sorted ranges;
    a range's first rank follows from the counts of the ranges before it, of which there are at most `parts`. No task orders a whole group.
    """
    diff = F.col(a) - F.col(b)
    tied = pairs.select(*by, diff.alias("__d")).where("__d <> 0").groupBy(*by, F.abs("__d").alias("__abs")).agg(F.count("*").alias("__t"), F.count_if(F.col("__d") > 0).alias("__up"))
    ranged = tied.repartitionByRange(parts, *by, "__abs").withColumn("__part", F.spark_partition_id())
    return _ranked_sums(ranged, by)


def _ranked_sums(ranged: DataFrame, by: list[str]) -> DataFrame:
    inside = Window.partitionBy("__part", *by).orderBy("__abs").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # sums within a range, as if its first rank were 1, and what the ranges before it add to every rank
    t = F.col("__t").cast("double")
    local = ranged.withColumn("__r", F.coalesce(F.sum("__t").over(inside), F.lit(0)) + (t + 1) / 2)
    per = local.groupBy(*by, "__part").agg(F.sum("__t").alias("__n"), F.sum("__up").alias("__n_up"), F.sum(F.col("__r") * F.col("__up")).alias("__w_up"), F.sum(F.col("__r") * (F.col("__t") - F.col("__up"))).alias("__w_down"), F.sum(t * (t * t - 1)).alias("__ties"))
    placed = per.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    sums = placed.groupBy(*by).agg(F.sum("__n").alias("n_used"), F.sum(F.col("__w_up") + F.col("__before") * F.col("__n_up")).alias("__up"), F.sum(F.col("__w_down") + F.col("__before") * (F.col("__n") - F.col("__n_up"))).alias("__down"), F.sum("__ties").alias("__ties"))
    n = F.col("n_used").cast("double")
    w, mean = F.least("__up", "__down"), n * (n + 1) / 4
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("__ties") / 48)
    return sums.select(*by, "n_used", w.alias("wilcoxon_stat"), F.coalesce(normal_two_sided(F.try_divide(w - mean, F.when(sd > 0, sd))), F.lit(1.0)).alias("p_value"))
