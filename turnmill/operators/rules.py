"""Rule layer: one wide row of measures and warnings per conversation.

turns: key columns, turn_idx, speaker (Customer/Agent), text. headers: key columns and the persona, scenario and meta columns
of a conversation. One shuffle on the key gathers a conversation's customer turns as an ordered array (bounded by
its length); everything else is expressions on that row. Thresholds see rounded values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions import lexicons as L
from turnmill.functions import text as T


@dataclass(frozen=True)
class Lexicons:
    hedge: tuple = L.HEDGE
    certainty: tuple = L.CERTAINTY
    mild: tuple = L.MILD
    strong: tuple = L.STRONG
    jargon: tuple = L.JARGON
    pushback: tuple = L.RULE_PUSHBACK
    concerns: dict = field(default_factory=lambda: L.CONCERNS)
    dropout: dict = field(default_factory=lambda: L.DROPOUT)


@dataclass(frozen=True)
class Limits:
    long_mean: float = 30
    low_stddev: float = 3.0
    direct_long: float = 25
    indirect_short: float = 6
    outlier: int = 3


HEADER = {
    "knowledge_level": "string", "emotional_state": "string", "communication_style": "string", "goal_clarity": "string", "certainty": "string",
    "information_completeness": "string", "prior_contact": "string", "expected_resolution": "string", "merchant": "string", "amount": "string",
    "transaction_date": "string", "goal_completed": "boolean", "failure_mode": "string", "probing_type": "string", "wrong_prior_belief": "string",
    "agent_failure_mode": "string", "planted_error": "string", "user_caught_error": "boolean",
}


def with_header(df: DataFrame) -> DataFrame:
    """Absent header columns as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in HEADER.items() if c not in df.columns})


def turn_measures(turns: DataFrame, keys: list[str], lex: Lexicons = Lexicons()) -> DataFrame:
    """Per conversation: n, word statistics, phrase sums and the ordered customer turns."""
    lc = turns.select(*keys, "turn_idx", (F.col("speaker") == "Customer").alias("c"), F.lower("text").alias("lc"), T.word_count(F.col("text")).alias("w"))
    each = lc.withColumns({
        "hedge": T.hits(F.col("lc"), lex.hedge), "sure": T.hits(F.col("lc"), lex.certainty), "cats": T.categories(F.col("lc"), lex.concerns),
        **{f"j{i}": F.contains("lc", F.lit(p)) for i, p in enumerate(lex.jargon)},
    })
    mine, w = (lambda x: F.when(F.col("c"), x)), F.when(F.col("c"), F.col("w"))
    # a term is early if a customer says it before the first agent turn that does, or no agent does
    first_agent = {f"a{i}": F.min(F.when(~F.col("c") & F.col(f"j{i}"), F.col("turn_idx"))) for i in range(len(lex.jargon))}
    spoken = {f"s{i}": F.collect_list(F.when(F.col("c") & F.col(f"j{i}"), F.col("turn_idx"))) for i in range(len(lex.jargon))}
    grouped = each.groupBy(*keys).agg(
        F.count_if("c").alias("n"), F.avg(w).alias("w_mean"), F.percentile(w, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("w_p"), F.coalesce(F.stddev_pop(w), F.lit(0.0)).alias("w_std"),
        F.coalesce(F.sum(mine(F.col("hedge"))), F.lit(0)).alias("hedges"), F.coalesce(F.sum(mine(F.col("sure"))), F.lit(0)).alias("sures"),
        F.coalesce(F.max(mine(F.col("cats"))), F.lit(0)).alias("max_cats"), F.count_if(F.col("c") & (F.col("cats") >= 2)).alias("multi_cats"),
        F.transform(F.sort_array(F.collect_list(mine(F.struct("turn_idx", "lc")))), lambda x: x["lc"]).alias("said"),
        *[v.alias(k) for k, v in {**first_agent, **spoken}.items()],
    )
    def early_uses(i: int, term: str) -> Column:
        before = F.filter(F.col(f"s{i}"), lambda x: F.col(f"a{i}").isNull() | (x < F.col(f"a{i}")))
        return F.transform(before, lambda x: F.struct(x.alias("turn_idx"), F.lit(i).alias("i"), F.lit(term).alias("term")))

    early = F.array_sort(F.concat(*[early_uses(i, p) for i, p in enumerate(lex.jargon)])) if lex.jargon else F.array().cast("array<struct<turn_idx:bigint,i:int,term:string>>")
    return grouped.withColumn("early_jargon", F.transform(early, lambda x: x["term"])).drop(*first_agent, *spoken)


def evaluate(turns: DataFrame, headers: DataFrame, keys: list[str], lex: Lexicons = Lexicons(), limits: Limits = Limits()) -> DataFrame:
    """keys, dataset_type, persona columns, measures, warnings (in rule order), warning_count, is_outlier."""
    rows = with_header(headers).join(turn_measures(turns, keys, lex), keys, "left")
    c, n = F.col, F.coalesce(F.col("n"), F.lit(0))
    r1 = lambda x: T.rounded(F.coalesce(x, F.lit(0.0)), 1)
    r3 = lambda x: T.rounded(F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)), 3)
    rows = rows.withColumns({
        "num_customer_turns": n.cast("int"), "words_mean": r1(c("w_mean")), "words_p10": r1(F.get("w_p", F.lit(0))), "words_median": r1(F.get("w_p", F.lit(1))), "words_p90": r1(F.get("w_p", F.lit(2))),
        "words_stddev": r1(c("w_std")), "hedge_rate": r3(c("hedges")), "certainty_rate": r3(c("sures")), "joined": F.array_join(F.coalesce("said", F.array().cast("array<string>")), " "),
        "first_turn": F.get("said", F.lit(0)), "last_turn": F.get("said", F.size("said") - 1), "half": F.floor(n / 2).cast("int"),
    })
    half = lambda a, b: F.array_join(F.slice("said", a, b), " ")
    belief = F.coalesce(T.keywords(c("wrong_prior_belief")), F.array().cast("array<string>"))
    count_in = lambda text: F.size(F.filter("belief", lambda k: F.contains(text, k)))
    rows = rows.withColumns({
        "hedge_minus_certainty": T.rounded(c("hedge_rate") - c("certainty_rate"), 3),
        "facts_in_turn1": F.coalesce(T.facts(c("first_turn"), c("merchant"), c("amount"), c("transaction_date")), F.lit(0)),
        "second_half": half(c("half") + 1, F.greatest(n - c("half"), F.lit(0)).cast("int")), "first_half": half(F.lit(1), c("half")),
        "has_mild": T.has_any(c("joined"), lex.mild), "has_strong": T.has_any(c("joined"), lex.strong), "caught": T.has_any(c("joined"), lex.pushback), "belief": belief,
        "breadth_first_flag": F.coalesce((c("max_cats") >= 3) | (c("multi_cats") >= 2), F.lit(False)), "jargon_before_agent": F.coalesce(F.size("early_jargon") > 0, F.lit(False)),
    })
    failure, type_a, type_b = (c("dataset_type") == t for t in ("failure", "type_a", "type_b"))
    state, style = c("emotional_state"), c("communication_style")
    known_mode = c("failure_mode").isin(*lex.dropout)
    plausible = F.coalesce(*[F.when(c("failure_mode") == m, T.has_any(c("last_turn"), ps)) for m, ps in lex.dropout.items()], F.lit(True))
    has_belief = type_a & (F.coalesce(c("wrong_prior_belief"), F.lit("")) != "")
    rules: list[tuple[str, Column]] = [
        ("HIGH_AVG_TURN_LENGTH", c("words_mean") > limits.long_mean),
        ("LOW_LENGTH_VARIANCE", (c("words_stddev") < limits.low_stddev) & (n >= 3)),
        ("CERTAINTY_EXCEEDS_HEDGING", (state.isin("calm", "mildly_frustrated") | (c("certainty") == "uncertain")) & (c("certainty_rate") > c("hedge_rate"))),
        ("ZERO_HEDGING_FOR_UNCERTAIN_SCENARIO", (c("certainty") == "uncertain") & (c("hedges") == 0)),
        ("INFO_DUMP_TURN1", c("facts_in_turn1") == 3),
        ("BREADTH_FIRST_BUNDLING", c("breadth_first_flag")),
        ("MISSING_FRUSTRATION_MARKERS", (state == "mildly_frustrated") & ~c("has_mild") & ~c("has_strong")),
        ("UNEXPECTED_FRUSTRATION", (state == "calm") & (c("has_mild") | c("has_strong"))),
        ("MISSING_STRONG_FRUSTRATION", state.isin("very_upset", "escalating") & ~c("has_strong")),
        ("NOVICE_JARGON", (c("knowledge_level") == "novice") & c("jargon_before_agent")),
        ("DIRECT_STYLE_BUT_LONG_TURNS", (style == "direct") & (c("words_mean") > limits.direct_long)),
        ("INDIRECT_STYLE_BUT_VERY_SHORT", (style == "indirect") & (c("words_mean") < limits.indirect_short)),
        ("DROPOUT_TOO_EARLY", failure & (n < 3)),
        ("DROPOUT_NOT_PLAUSIBLE", failure & known_mode & ~plausible),
        ("MISSING_ESCALATION_ARC", failure & c("failure_mode").isin("impatience", "escalation_exit") & (n >= 4) & ~T.has_any(c("second_half"), (*lex.mild, *lex.strong))),
        ("PRIOR_BELIEF_ABSENT", has_belief & (count_in(c("joined")) < 2)),
        ("BELIEF_SILENTLY_DROPPED", has_belief & (count_in(c("joined")) >= 2) & (n >= 4) & (count_in(c("first_half")) >= 2) & (count_in(c("second_half")) == 0)),
        ("ERROR_NOT_CAUGHT", type_b & ~c("caught")),
        ("USER_CAUGHT_ERROR_LABEL_MISMATCH", type_b & ((c("user_caught_error").eqNullSafe(True) & ~c("caught")) | (c("user_caught_error").eqNullSafe(False) & c("caught")))),
    ]
    spoke = n > 0
    codes = F.array_compact(F.array(*[F.when(spoke & F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules]))
    rows = rows.withColumn("warnings", F.when(spoke, codes).otherwise(F.array(F.lit("NO_CUSTOMER_TURNS"))))
    return rows.select(
        *keys, *[x for x in ("dataset_type",) if x not in keys], "knowledge_level", "emotional_state", "communication_style", "goal_clarity", "num_customer_turns", "words_mean", "words_median", "words_p10", "words_p90", "words_stddev",
        "hedge_rate", "certainty_rate", "hedge_minus_certainty", "facts_in_turn1", T.rounded(c("facts_in_turn1") / 3, 3).alias("info_density_score"), F.coalesce("max_cats", F.lit(0)).alias("max_categories_per_turn"),
        F.coalesce("multi_cats", F.lit(0)).alias("turns_with_multi_category"), "breadth_first_flag", (c("has_mild") | c("has_strong")).alias("frustration_marker_present"), "jargon_before_agent",
        F.coalesce("early_jargon", F.array().cast("array<string>")).alias("early_jargon"), "warnings", F.size("warnings").alias("warning_count"), (spoke & (F.size("warnings") >= limits.outlier)).alias("is_outlier"),
    )


def warning_frequency(results: DataFrame) -> DataFrame:
    """Conversations per code, once each, and their share of all."""
    return results.select(F.explode(F.array_distinct("warnings")).alias("code")).groupBy("code").agg(F.count("*").alias("conversations"))


def outliers(results: DataFrame, keys: list[str], k: int | None = None) -> DataFrame:
    found = results.where("is_outlier").orderBy(F.desc("warning_count"), *keys)
    return found.limit(k) if k else found


def style_check(results: DataFrame) -> DataFrame:
    """One row: mean of conversation means by style, and whether direct speakers are shorter."""
    by = lambda s: F.avg(F.when(F.col("communication_style") == s, F.col("words_mean")))
    row = results.where("num_customer_turns > 0").agg(T.rounded(by("direct"), 2).alias("direct_mean"), T.rounded(by("indirect"), 2).alias("indirect_mean"))
    return row.withColumn("note", F.when(F.col("direct_mean") >= F.col("indirect_mean"), "POPULATION_STYLE_MISMATCH").when(F.col("direct_mean") < F.col("indirect_mean"), "POPULATION_STYLE_OK"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(attribute, value, n) of several columns in one pass."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).groupBy("x.attribute", "x.value").agg(F.count("*").alias("n"))


def numeric_summary(df: DataFrame, *columns: str, skip_zero: bool = False) -> DataFrame:
    """(metric, mean, min, max, std) per column."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    if skip_zero:
        rows = rows.where("v <> 0")
    return rows.groupBy("metric").agg(T.rounded(F.avg("v"), 3).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), T.rounded(F.coalesce(F.stddev_pop("v"), F.lit(0.0)), 3).alias("std"))
