"""Conversation-level splits, seeded sampling and task planning (S1-S7, A15, A21, J1, J5, W11, K6, K9, SK2)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.functions import text as T


def seeded(seed: int, *keys: Column | str) -> Column:
    """A permutation key that any engine with MD5 reproduces."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def uniform(seed: int, *keys: Column | str) -> Column:
    """In [0, 1) from 52 bits of the seeded hash."""
    return F.conv(F.substring(seeded(seed, *keys), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def split_conversations(rows: DataFrame, ratio: float = 0.8, seed: int = 42, key: str = "generation_idx", buckets: int = 256) -> DataFrame:
    """rows with split train or val; exactly max(1, floor(n x ratio)) conversations train, none is in both.

    Ids are counted by hash bucket first, so no task orders more than one bucket.
    """
    ids = rows.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__h", seeded(seed, key)).withColumn("__b", F.substring("__h", 1, int(math.log(buckets, 16))))
    sizes = ids.groupBy("__b").agg(F.count("*").alias("n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__total"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) + F.col("__before")
    ranked = ids.join(F.broadcast(offset), "__b").join(F.broadcast(total)).withColumn("split", F.when(place <= F.greatest(F.lit(1), F.floor(F.col("__total") * ratio)), "train").otherwise("val"))
    return rows.join(ranked.select(key, "split"), key)


def ordered_split(rows: DataFrame, seed: int = 42, key: str = "generation_idx", line: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Train rows in seeded order (seed + 1), validation rows as they came."""
    return rows.where("split = 'train'").orderBy(seeded(seed + 1, key, line)), rows.where("split = 'val'").orderBy(key, line)


def split_stats(first: DataFrame) -> DataFrame:
    """Counts of conversations over each dimension: (slice_dim, slice_val, n), by grouping sets."""
    dims = ["dataset_type", "failure_mode", "agent_failure_mode", "goal_completed", "user_caught_error"]
    return slices(first, dims, {"n": F.count("*")})


def slices(df: DataFrame, dims: list[str], measures: dict[str, Column], by: list[str] | None = None, overall: bool = True) -> DataFrame:
    """(by..., slice_dim, slice_val, measures) with one grouping set per dimension and one for all rows."""
    by = by or []
    sets = [[*by, d] for d in dims] + ([by] if overall else [])
    name = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims], F.lit("overall"))
    value = F.coalesce(*[F.when(F.grouping(d) == 0, F.coalesce(F.col(d).cast("string"), F.lit("unknown"))) for d in dims], F.lit("all"))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*by, *dims)]).agg(*[m.alias(k) for k, m in measures.items()], name.alias("slice_dim"), value.alias("slice_val")).select(*by, "slice_dim", "slice_val", *measures)


def plan_tasks(spark: SparkSession, personas: DataFrame, scenarios: DataFrame, n: int, start: int = 0) -> DataFrame:
    """Task i takes combination i modulo (personas x scenarios), persona-major. Both sides are small fixed dimensions with an `ord` column."""
    n_s, n_p = scenarios.count(), personas.count()
    tasks = spark.range(n).select((F.col("id") + start).alias("generation_idx"), F.floor(F.pmod("id", F.lit(n_s * n_p)) / n_s).cast("int").alias("__p"), F.pmod("id", F.lit(n_s)).cast("int").alias("__s"))
    p, s = personas.withColumnRenamed("ord", "__p"), scenarios.withColumnRenamed("ord", "__s")
    return tasks.join(F.broadcast(p) if n_p < 10_000 else p, "__p").join(F.broadcast(s) if n_s < 10_000 else s, "__s").drop("__p", "__s")


def remaining(tasks: DataFrame, done: DataFrame, key: str = "generation_idx") -> DataFrame:
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def sample_amount(seed: int, key: str) -> Column:
    v = F.exp(math.log(3) + uniform(seed, F.lit("amount"), key) * (math.log(3000) - math.log(3)))
    return T.money(F.when(uniform(seed, F.lit("tens"), key) < 0.15, F.round(v / 10) * 10).otherwise(v))


def sample_date(seed: int, key: str, ref: Column, heldout: bool = False) -> Column:
    lo, hi = (181, 365) if heldout else (1, 180)
    d = F.date_sub(ref, F.lit(lo) + F.floor(uniform(seed, F.lit("date"), key) * (hi - lo + 1)).cast("int"))
    return F.concat(F.date_format(d, "MMMM"), F.lit(" "), F.dayofmonth(d).cast("string"))


def triangular(u: Column, lo: float, hi: float, mode: float) -> Column:
    c = (mode - lo) / (hi - lo)
    return F.when(u < c, lo + F.sqrt(u * (hi - lo) * (mode - lo))).otherwise(hi - F.sqrt((1 - u) * (hi - lo) * (hi - mode)))


def sample_target_length(seed: int, key: str, style: Column) -> Column:
    u, v = uniform(seed, F.lit("length"), key), uniform(seed, F.lit("tail"), key)
    whole = lambda x: F.floor(x).cast("int")
    return (
        F.when(style == "terse", F.greatest(F.lit(3), whole(triangular(u, 3, 14, 6)))).when(style == "direct", F.greatest(F.lit(6), whole(triangular(u, 8, 28, 15))))
        .when(style == "indirect", F.greatest(F.lit(12), whole(triangular(u, 18, 60, 30)))).when(style == "verbose", F.when(v < 0.2, whole(triangular(u, 72, 92, 80))).otherwise(whole(triangular(u, 35, 72, 50)))).otherwise(15)
    )


def choose(seed: int, key: str, pool: list[str], tag: str) -> Column:
    return F.get(F.array(*[F.lit(x) for x in pool]), F.floor(uniform(seed, F.lit(tag), key) * len(pool)).cast("int"))
