"""Rollups, orders and small report frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import text as T
from turnmill.operators.split import seeded

#: Metrics by preference; the last is used when none has a value.
METRICS = (("mean_bertscore_f1", "BERTScore F1"), ("mean_bleurt", "BLEURT"), ("mean_meteor", "METEOR"), ("mean_bleu", "BLEU"))
LEVELS = ("novice", "intermediate", "expert")

# The clauses of an intent summary.
ACTIONS = {"certain_fraud": "report and dispute a fraudulent charge", "uncertain": "investigate a suspicious charge"}
RESOLUTIONS = {
    "refund_and_card": "get a refund and have your card cancelled and replaced",
    "investigation": "have the bank open a formal investigation into the charge",
    "hold": "get your card frozen immediately to prevent further charges",
}
DETAILS = {"full": "of {amount} at {merchant} on {date}", "partial": "of approximately {amount} around {date}", "minimal": "that appeared on your bank statement"}
PRIOR = {
    "first_contact": "",
    "tried_merchant": " You already contacted {merchant} directly but they refused to help.",
    "follow_up": " You already spoke with the bank once and are following up after receiving no update.",
}
INTENT = "You are a user chatting with an assistant language model to {action} {detail} and {resolution}.{prior}"


def lookup(key: Column, values: dict[str, str]) -> Column:
    """The value of a key; null for keys that the table lacks."""
    return F.coalesce(*[F.when(key == k, v) for k, v in values.items()])


def intent_summary(certainty: Column, completeness: Column, resolution: Column, prior: Column, amount: Column, merchant: Column, date: Column) -> Column:
    """One sentence or two from a scenario; null if any part is unknown."""
    filled = lambda t: F.replace(F.replace(F.replace(t, F.lit("{amount}"), amount), F.lit("{merchant}"), merchant), F.lit("{date}"), date)
    out = F.lit(INTENT)
    for name, part in (("action", lookup(certainty, ACTIONS)), ("detail", filled(lookup(completeness, DETAILS))), ("resolution", lookup(resolution, RESOLUTIONS)), ("prior", filled(lookup(prior, PRIOR)))):
        out = F.replace(out, F.lit("{" + name + "}"), part)
    return out


def number(text: Column) -> Column:
    """A metric cell as double: null where it is blank, None, nan or no number."""
    v = F.trim(text).try_cast("double")
    return F.when(~F.isnan(v), v)


def nonzero_mean(x: Column, k: int = 3) -> Column:
    return F.coalesce(T.mean_of(F.when(x != 0, x), k), F.lit(0.0))


def distinct_conversations(rows: DataFrame, key: str = "generation_idx") -> DataFrame:
    return rows.agg(F.count_distinct(key).alias("conversations"))


def tail_stats(rows: DataFrame, mark: str = "<eos>", mode: str = "failure_mode") -> DataFrame:
    """(failure_mode, entries, ended): one row for all entries (null mode), one per mode that is set."""
    counts = [F.count("*").alias("entries"), F.count_if(F.col("output") == mark).alias("ended")]
    named = rows.where(F.coalesce(F.col(mode), F.lit("")) != "").groupBy(mode).agg(*counts)
    return rows.agg(F.lit(None).cast("string").alias(mode), *counts).unionByName(named)


def judgeable(conversations: DataFrame) -> DataFrame:
    """Conversations that have a turn on both sides."""
    return conversations.where((F.size("predicted_turns") > 0) & (F.size("reference_turns") > 0))


def adapted_or_all(rows: DataFrame, flag: str = "is_lora") -> DataFrame:
    """Rows of adapted models; all rows where there is none. The one-row side of the join is an aggregate."""
    some = rows.agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("__some"))
    return rows.join(F.broadcast(some), F.col(flag) | ~F.col("__some")).drop("__some")


def first_k(rows: DataFrame, k: int, *order: str | Column) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def examples(rows: DataFrame, by: str, *order: str, most: int = 20) -> DataFrame:
    """The first `most` rows of each group with how many more the group has. Tasks keep `most` rows a group before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    shown = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    sizes = rows.groupBy(by).agg(F.count("*").alias("__n"))
    return shown.join(sizes, by).withColumn("more", F.greatest(F.col("__n") - most, F.lit(0))).drop("__n")


def ordinal(value: Column, order: Sequence[str]) -> Column:
    """Place in a fixed order; other values after all of them."""
    return F.coalesce(*[F.when(value == v, i) for i, v in enumerate(order)], F.lit(len(order)))


def few_shot_sample(rows: DataFrame, key: str, k: int = 3, seed: int = 42) -> DataFrame:
    """k rows without replacement in seeded order."""
    return rows.orderBy(seeded(seed, key), key).limit(k)


def conversation_metrics(rows: DataFrame, means: Sequence[str], by_type: dict[str, Sequence[str]], confused: str = "n_role_confused_turns") -> DataFrame:
    """Per variant: means over cells with a number and their count, the sum of role-confused turns, and means over one conversation type."""
    kind = F.col("conversation_type")
    out = [F.count("*").alias("n_conversations"), F.sum(F.floor(number(F.col(confused)))).cast("bigint").alias("total_role_confused")]
    for c in means:
        out += [T.mean_of(number(F.col(c)), 3).alias(c), F.count(number(F.col(c))).alias(f"{c}_n")]
    for t, columns in by_type.items():
        for c in columns:
            out += [T.mean_of(F.when(kind == t, number(F.col(c))), 3).alias(c), F.count_if(kind == t).alias(f"{c}_n")]
    return rows.groupBy("model_variant").agg(*out)


def extremes(cells: DataFrame, value: str = "value") -> DataFrame:
    """cells (model_variant, slice_dim, slice_val, value): per dimension the slice with the highest and the lowest mean over variants; ties go to the first name, equal ends are left out."""
    means = cells.where(F.col(value).isNotNull()).groupBy("slice_dim", "slice_val").agg(T.mean_of(F.col(value), 3).alias("m"))
    ends = means.groupBy("slice_dim").agg(F.min_by("slice_val", F.struct(-F.col("m"), "slice_val")).alias("easiest"), F.max("m").alias("easiest_mean"), F.min_by("slice_val", F.struct("m", "slice_val")).alias("hardest"), F.min("m").alias("hardest_mean"))
    return ends.where("easiest <> hardest")


def primary_metric(overall: DataFrame, metrics: Sequence[tuple[str, str]] = METRICS, variant: str = "model_variant") -> DataFrame:
    """(metric, name): the first metric with a value in the first variant's row."""
    pick = lambda i: F.coalesce(*[F.when(F.col("has")[j], F.lit(m[i])) for j, m in enumerate(metrics)], F.lit(metrics[-1][i]))
    has = F.array(*[number(F.col(c)).isNotNull() for c, _ in metrics])
    return overall.agg(F.min_by(has, variant).alias("has")).select(pick(0).alias("metric"), pick(1).alias("name"))


def entity_notes(overall: DataFrame, least: float = 0.05) -> DataFrame:
    """Adapted variants whose precision and recall differ by more than `least`, and what that says."""
    p, r = F.col("mean_entity_precision"), F.col("mean_entity_recall")
    return overall.where(F.col("model_variant").startswith("lora_") & (F.abs(p - r) > least)).withColumn("note", F.when(p < r, "hallucinates entities").otherwise("drops entities"))


def warning_overview(rules: DataFrame) -> DataFrame:
    """(code, conversations, pct): each warning with its share of all conversations."""
    total = rules.agg(F.count("*").alias("__all"))
    counts = rules.select(F.explode("warnings").alias("code")).groupBy("code").agg(F.count("*").alias("conversations"))
    return counts.join(F.broadcast(total)).select("code", "conversations", T.rounded(100.0 * F.col("conversations") / F.col("__all"), 1).alias("pct"))


def score_distribution(long: DataFrame) -> DataFrame:
    """long (dim, value): count, mean, extremes, deviation and quartiles of each dimension."""
    q = F.percentile("value", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    return long.groupBy("dim").agg(
        F.count("*").alias("n"), T.mean_of(F.col("value"), 3).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), T.rounded(F.stddev_pop("value"), 3).alias("std"),
        *[T.rounded(F.get(q, F.lit(i)), 3).alias(n) for i, n in enumerate(("q1", "median", "q3"))],
    )


def action_band(x: Column) -> Column:
    return F.when(x >= 4, "publish").when(x >= 3, "spot-check").when(x >= 2, "review").otherwise("regenerate")


def modes_present(first: DataFrame, column: str = "failure_mode", least: int = 8, name: str = "failure modes present") -> DataFrame:
    """(name, passed, detail): at least `least` different values that are set."""
    n = F.count_distinct(F.when(F.col(column) != "", F.col(column)))
    return first.agg(F.lit(name).alias("name"), (n >= least).alias("passed"), n.cast("string").alias("detail"))


def shown(text: Column, most: int) -> Column:
    """A table cell: cut to `most` characters, bars escaped, line breaks as spaces."""
    return F.replace(F.translate(F.substring(text, 1, most), "\n\r", "  "), F.lit("|"), F.lit("\\|"))


def percent(x: Column) -> Column:
    return F.coalesce(F.concat(F.format_string("%.1f", T.rounded(100 * x, 1)), F.lit("%")), F.lit("N/A"))
