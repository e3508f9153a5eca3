"""Report frames (B1-B24) as DataFrames, and their rendering to Markdown from small collected aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.functions import text as T
from turnmill.operators.rules import numeric_summary, value_counts, warning_frequency


def executive_summary(rules: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    row = rules.agg(F.count("*").alias("conversations"), T.rounded(F.avg("warning_count"), 2).alias("avg_warnings"), F.count_if("is_outlier").alias("outliers"))
    if scored is None:
        return row
    return row.join(scored.where("NOT parse_error").agg(F.count("*").alias("scored"), T.rounded(F.avg("overall_score"), 2).alias("avg_overall")))


def composition(rules: DataFrame) -> DataFrame:
    """Type and persona value counts with their share."""
    total = rules.agg(F.count("*").alias("all"))
    counts = value_counts(rules, "dataset_type", "knowledge_level", "emotional_state", "communication_style", "goal_clarity")
    return counts.join(total).select("attribute", "value", "n", T.rounded(100.0 * F.col("n") / F.col("all"), 1).alias("pct"))


def structural(rules: DataFrame) -> DataFrame:
    return numeric_summary(rules, "words_mean", "words_stddev", "num_customer_turns", "words_p90")


def lexical(rules: DataFrame) -> DataFrame:
    return numeric_summary(rules, "hedge_rate", "certainty_rate", "hedge_minus_certainty")


def info_density(rules: DataFrame) -> DataFrame:
    """Counts of 0..3 facts in the first turn, zero-filled."""
    spark = rules.sparkSession
    counts = rules.groupBy("facts_in_turn1").agg(F.count("*").alias("n"))
    return spark.range(4).select(F.col("id").cast("int").alias("facts_in_turn1")).join(counts, "facts_in_turn1", "left").select("facts_in_turn1", F.coalesce("n", F.lit(0)).alias("n"))


def type_checks(rules: DataFrame, codes: dict[str, str]) -> DataFrame:
    """code -> type it concerns: flagged and eligible conversations."""
    each = [F.struct(F.lit(c).alias("code"), (F.col("dataset_type") == t).cast("int").alias("eligible"), (F.array_contains("warnings", c) & (F.col("dataset_type") == t)).cast("int").alias("flagged")) for c, t in codes.items()]
    return rules.select(F.inline(F.array(*each))).groupBy("code").agg(F.sum("flagged").alias("flagged"), F.sum("eligible").alias("eligible"))


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    return df.groupBy(by).agg(F.count("*").alias("n"), F.min(value).alias("min"), *[T.rounded(F.get(q, F.lit(i)), 2).alias(n) for i, n in enumerate(("q1", "median", "q3"))], F.max(value).alias("max"))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    return df.groupBy((F.floor(F.col(value) / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A table of a report-sized frame; one row more than `most` is asked for so that a cut is said, not silent."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else f"{v:.3f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + [f"More than {most} rows; the rest is in the frame."] * (len(rows) > most))


def render(title: str, sections: Sequence[tuple[str, Callable[[], str | None]]]) -> str:
    """Sections that return None are left out; the others are numbered."""
    parts, n = [f"# {title}"], 0
    for name, make in sections:
        if (body := make()) is not None:
            n += 1
            parts.append(f"## {n}. {name}\n\n{body}")
    return "\n\n".join(parts) + "\n"


def corpus_report(rules: DataFrame, scored: DataFrame | None = None) -> str:
    from turnmill.operators import judge

    sections: list[tuple[str, Callable[[], str | None]]] = [
        ("Summary", lambda: markdown(executive_summary(rules, scored))), ("Composition", lambda: markdown(composition(rules).orderBy("attribute", F.desc("n"), "value"))),
        ("Warnings", lambda: markdown(warning_frequency(rules).orderBy(F.desc("conversations"), "code"))), ("Structure", lambda: markdown(structural(rules))), ("Wording", lambda: markdown(lexical(rules))),
        ("Facts in the first turn", lambda: markdown(info_density(rules).orderBy("facts_in_turn1"))),
        ("Judge scores", lambda: markdown(numeric_summary(scored.where("NOT parse_error"), *[c for c in scored.columns if c.endswith("_score")], skip_zero=True)) if scored is not None else None),
        ("Judge scores by state", lambda: markdown(judge.by_attribute(scored, "emotional_state").orderBy("emotional_state", "ord")) if scored is not None and "emotional_state" in scored.columns else None),
    ]
    return render("Corpus evaluation", sections)
