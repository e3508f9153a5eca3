"""Corpus gate: checks (name, passed, detail) over training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.functions import text as T


def _check(df: DataFrame, name: str, passed, detail) -> DataFrame:
    return df.select(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("string").alias("detail"))


def schema_checks(rows: DataFrame, name: str) -> DataFrame:
    """rows (input, output, has_meta, has_probing_type, dataset_type): keys present, output ends in the end mark, probes name their type."""
    whole = F.col("input").isNotNull() & F.col("output").isNotNull() & F.col("has_meta")
    bad = rows.agg(F.count_if(~whole).alias("a"), F.count_if(whole & ~F.col("output").endswith("<eos>")).alias("b"), F.count_if(whole & F.col("dataset_type").isin("type_a", "type_b") & ~F.col("has_probing_type")).alias("c"))
    parts = [(f"{name}: keys present", "a"), (f"{name}: output ends in mark", "b"), (f"{name}: probing type", "c")]
    return bad.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), (F.col(c) == 0).alias("passed"), F.col(c).cast("string").alias("detail")) for n, c in parts])))


def collisions(rows: DataFrame) -> DataFrame:
    """Indexes that more than one file uses; several rows of one file are no collision."""
    return rows.where("generation_idx IS NOT NULL").groupBy("generation_idx").agg(F.count_distinct("file").alias("files")).where("files > 1")


def first_rows(rows: DataFrame, key: str = "generation_idx", order: str = "line_no") -> DataFrame:
    """The first row of each conversation, without ordering whole groups."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("__r")).select(key, "__r.*")


def diversity(rows: DataFrame, *by: str, merchants: int = 40, amounts: int = 100, days: int = 120) -> DataFrame:
    day = T.day_of_year(F.col("transaction_date"))
    found = rows.groupBy(*by).agg(F.count_distinct("merchant").alias("merchants"), F.count_distinct("amount").alias("amounts"), (F.coalesce(F.max(F.when(day > 0, day)), F.lit(0)) - F.coalesce(F.min(F.when(day > 0, day)), F.lit(0))).alias("date_span"))
    return found.withColumn("passed", (F.col("merchants") >= merchants) & (F.col("amounts") >= amounts) & (F.col("date_span") >= days))


def cooccurrence(rows: DataFrame, key: list[str], value: str, least: int, name: str) -> DataFrame:
    """Every key has at least `least` values; no keys at all fails."""
    per = rows.where(F.col(value).isNotNull()).groupBy(F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in key]).alias("k")).agg(F.count_distinct(value).alias("v"))
    low = per.agg(F.coalesce(F.min("v"), F.lit(0)).alias("low"))
    return _check(low, name, F.col("low") >= least, F.col("low"))


def lengths(rows: DataFrame, *by: str, median: float = 12, p90: float = 35, long_share: float = 0.10, short_share: float = 0.05) -> DataFrame:
    """Word counts of non-final customer outputs."""
    said = rows.where((F.col("output") != "<eos>") & F.col("output").endswith("<eos>")).withColumn("w", T.word_count(F.expr("substring(output, 1, length(output) - 5)")))
    p = F.percentile("w", F.array(F.lit(0.5), F.lit(0.9)))
    found = said.groupBy(*by).agg(F.count("*").alias("n"), T.rounded(F.get(p, F.lit(0)), 1).alias("median"), T.rounded(F.get(p, F.lit(1)), 1).alias("p90"), T.rounded(F.avg((F.col("w") > 30).cast("double")), 4).alias("over_30"), T.rounded(F.avg((F.col("w") <= 1).cast("double")), 4).alias("at_most_1"))
    return found.withColumn("passed", (F.col("median") >= median) & (F.col("p90") >= p90) & (F.col("over_30") >= long_share) & (F.col("at_most_1") < short_share))


def balance(rows: DataFrame, by: str, target: int | None = None, tolerance: float = 0.15) -> DataFrame:
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    mean = counts.select("n", F.lit(1).alias("k")).join(counts.agg(F.avg("n").alias("mean")), F.lit(True), "inner")
    worst = mean.agg(T.rounded(F.coalesce(F.max(F.abs(F.try_divide(F.col("n") - (F.lit(float(target)) if target else F.col("mean")), F.lit(float(target)) if target else F.col("mean")))), F.lit(1e9)), 4).alias("worst"))
    return _check(worst, "balance", F.col("worst") <= tolerance, F.col("worst"))


def disjoint(train: DataFrame, heldout: DataFrame, column: str, name: str = "held-out values disjoint") -> DataFrame:
    shared = train.select(column).intersect(heldout.select(column)).where(F.col(column).isNotNull())
    n = shared.agg(F.count("*").alias("n"))
    return _check(n, name, F.col("n") == 0, F.col("n"))


def gate(*checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All checks, and one row: whether all passed."""
    table = checks[0]
    for c in checks[1:]:
        table = table.unionByName(c)
    return table, table.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"))
