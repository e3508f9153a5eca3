"""Judge scores from pre-computed responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions import stats
from turnmill.functions import text as T

#: dataset type -> dimension -> weight; each sums to 1.
CORPUS_WEIGHTS = {
    "success": {"depth_first": 0.25, "uncertainty": 0.20, "info_drip": 0.15, "pragmatic": 0.25, "persona": 0.15},
    "failure": {"depth_first": 0.15, "uncertainty": 0.15, "info_drip": 0.05, "pragmatic": 0.25, "persona": 0.15, "dropout_authenticity": 0.25},
    "type_a": {"depth_first": 0.20, "uncertainty": 0.20, "info_drip": 0.10, "pragmatic": 0.20, "persona": 0.15, "prior_belief_coherence": 0.15},
    "type_b": {"depth_first": 0.10, "uncertainty": 0.15, "info_drip": 0.10, "pragmatic": 0.20, "persona": 0.15, "error_catch_quality": 0.15, "pushback_naturalness": 0.15},
}
PREDICTION_WEIGHTS = {
    "success": CORPUS_WEIGHTS["success"],
    "type_a": {"depth_first": 0.20, "uncertainty": 0.15, "belief": 0.30, "info_incompleteness": 0.20, "persona": 0.15},
    "type_b": {"error_detection": 0.35, "uncertainty": 0.15, "pushback": 0.25, "pragmatic": 0.10, "persona": 0.15},
    "failure": {"dropout": 0.35, "depth_first": 0.15, "uncertainty": 0.15, "pragmatic": 0.20, "persona": 0.15},
}


def dimensions(weights: dict = CORPUS_WEIGHTS) -> list[str]:
    return list(dict.fromkeys(d for ws in weights.values() for d in ws))


def clamped(scores: Column, key: str) -> Column:
    """A score of the parsed object: 1 if the key is absent, 0 if its value is no number, else held within 1..5."""
    number = F.element_at(scores, F.lit(key)).try_cast("double")
    return F.when(~F.map_contains_key(scores, F.lit(key)), 1.0).when(number.isNull() | F.isnan(number), 0.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(5.0), number)))


def score(responses: DataFrame, weights: dict = CORPUS_WEIGHTS, raw: str = "raw_json", kind: str = "dataset_type", suffix: str = "_score") -> DataFrame:
    """responses with parse_error, one column per dimension (null where the type lacks it or the response is unreadable) and overall_score.

    The response is parsed once and bound, so that later filters on a score do not multiply the expression.
    """
    dims = dimensions(weights)
    type_ = F.when(F.col(kind).isin(*weights), F.col(kind)).otherwise("success")
    uses = lambda d: type_.isin(*[t for t, ws in weights.items() if d in ws])

    def judged(parsed: Column) -> Column:
        bad = parsed.isNull() | F.coalesce(F.map_contains_key(parsed, F.lit("_parse_error")), F.lit(False))
        at = lambda v, d: F.get(v, F.lit(dims.index(d)))
        overall = lambda v: F.coalesce(*[F.when(type_ == t, sum((F.lit(w) * F.coalesce(at(v, d), F.lit(0.0)) for d, w in ws.items()), F.lit(0.0))) for t, ws in weights.items()])
        whole = lambda v: T.let(overall(v), lambda x: F.struct(bad.alias("parse_error"), *[at(v, d).alias(f"{d}{suffix}") for d in dims], F.when(bad, 0.0).otherwise(T.rounded(x, 3)).alias("overall_score")))
        return T.let(F.array(*[F.when(~bad & uses(d), clamped(parsed, f"{d}_score")) for d in dims]), whole)

    parsed = F.from_json(T.strip_fences(F.coalesce(F.col(raw), F.lit(""))), "map<string,string>")
    rows = responses.withColumn("__s", T.let(parsed, judged))
    return rows.select(*[rows[c] for c in responses.columns], "__s.*")


def with_cache(conversations: DataFrame, cache: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """conversations with raw_json and cached; misses (all, if forced) keep null for the caller's hook."""
    if force:
        return conversations.withColumns({"raw_json": F.lit(None).cast("string"), "cached": F.lit(False)})
    return conversations.join(cache.select(*keys, "raw_json"), keys, "left").withColumn("cached", F.col("raw_json").isNotNull())


def cache_key(kind: Column, idx: Column) -> Column:
    return F.format_string("conv_%s_%03d", kind, idx.cast("int"))


def long_scores(scored: DataFrame, *keep: str, suffix: str = "_score") -> DataFrame:
    """(keep..., ord, dim, value) of scores above zero."""
    dims = [c for c in scored.columns if c.endswith(suffix) and c != "overall_score"]
    return scored.where("NOT parse_error").select(*keep, F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(d.removesuffix(suffix)).alias("dim"), F.col(d).alias("value")) for i, d in enumerate(dims)]))).where("value > 0")


def by_attribute(scored: DataFrame, *by: str) -> DataFrame:
    """Mean of each dimension per group, zeros dropped."""
    return long_scores(scored, *by).groupBy(*by, "ord", "dim").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def weakest_strongest(scored: DataFrame, *by: str) -> DataFrame:
    """Ties go to the first dimension."""
    means = by_attribute(scored, *by)
    return means.groupBy(*by).agg(F.min_by("dim", F.struct("mean", "ord")).alias("weakest"), F.max_by("dim", F.struct("mean", -F.col("ord"))).alias("strongest"))


def lowest(scored: DataFrame, k: int, *keys: str) -> DataFrame:
    return scored.where("NOT parse_error AND overall_score > 0").orderBy("overall_score", *keys).limit(k)


def quality_label(x: Column) -> Column:
    return F.when(x >= 3.5, "Good").when(x >= 2.5, "Moderate").otherwise("Needs work")


def correlation_label(r: Column) -> Column:
    size = F.when(F.abs(r) >= 0.5, "Strong").when(F.abs(r) >= 0.3, "Moderate").otherwise("Weak")
    return F.concat(size, F.when(r >= 0, " positive").otherwise(" negative"))


def correlations(rules: DataFrame, scored: DataFrame, keys: list[str], pairs: list[tuple[str, str]], drop_zero: bool = False) -> DataFrame:
    """(pair, n, r, label) of rule measures against scores, joined on the conversation."""
    both = rules.join(scored.where("NOT parse_error"), keys)
    rows = both.select(F.inline(F.array(*[F.struct(F.lit(f"{a} ~ {b}").alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])))
    if drop_zero:
        rows = rows.where("y <> 0")
    r = T.rounded(stats.pearson(F.col("x"), F.col("y")), 3)
    return rows.where("x IS NOT NULL AND y IS NOT NULL").groupBy("pair").agg(F.count("*").alias("n"), r.alias("r")).withColumn("label", correlation_label(F.col("r")))
