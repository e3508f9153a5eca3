"""Prediction fidelity (W1, D12-D16, Q1-Q15, A11-A14): predicted against reference conversations per model variant.

rows: one per (variant, example) with predicted and expected text. Both sides become one exploded table
(variant, generation_idx, side, ord, text); one shuffle on the conversation yields both sides' statistics as conditional aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions import lexicons as L
from turnmill.functions import stats
from turnmill.functions import text as T

KEY = ["model_variant", "generation_idx"]
META = ["conversation_type", "failure_mode", "knowledge_level", "emotional_state", "communication_style", "goal_clarity", "merchant", "amount", "transaction_date"]
MERCHANTS = ("adobe", "amazon", "apple", "netflix", "shell", "techhub", "uber")


@dataclass(frozen=True)
class Lexicons:
    hedge: tuple = L.HEDGE
    certainty: tuple = L.CERTAINTY
    promise: tuple = L.PROMISE
    frustration: tuple = (*L.MILD, *L.STRONG)
    jargon: tuple = L.JARGON
    concerns: dict = field(default_factory=lambda: L.CONCERNS)
    role: tuple = L.ROLE_CONFUSION
    pushback: tuple = L.FIDELITY_PUSHBACK
    exits: tuple = L.DROPOUT_EXIT
    belief: dict = field(default_factory=lambda: L.BELIEF_KEYWORDS)
    merchants: tuple = MERCHANTS


def conversation_type(meta: Column, generation_idx: Column, ranges: tuple[tuple[int, str], ...] = ((300_000, "type_b"), (200_000, "type_a"), (100_000, "failure"))) -> Column:
    """From the probing type, then the failure mode, then index ranges (largest start first)."""
    by_range = F.coalesce(*[F.when(generation_idx >= start, name) for start, name in ranges], F.lit("success"))
    mode = meta["failure_mode"]
    return F.when(meta["probing_type"] == "inadvertent", "type_a").when(meta["probing_type"] == "adversarial", "type_b").when(mode.isNotNull() & ~mode.isin("", "None"), "failure").otherwise(by_range)


def variant_size(variant: Column) -> Column:
    return F.get(F.split(variant, "_", 2), F.lit(1))


def is_adapted(variant: Column) -> Column:
    return variant.startswith("lora_")


def unpivot_predictions(records: DataFrame, size: str) -> DataFrame:
    """Two rows per record, base and adapted; records hold expected_output, base_model and lora_model structs."""
    pair = F.inline(F.array(*[F.struct(F.lit(f"{kind}_{size}").alias("model_variant"), F.col(f"{kind}_model.predicted_output").alias("raw")) for kind in ("base", "lora")]))
    rows = records.select("*", pair)
    return rows.withColumns({
        "is_eos_example": F.trim("expected_output") == "<eos>", "expected_output": T.clean_expected(F.col("expected_output")), "predicted_output": T.strip_eos(F.coalesce("raw", F.lit(""))),
        "model_size": variant_size(F.col("model_variant")), "is_lora": is_adapted(F.col("model_variant")),
    }).drop("raw", "base_model", "lora_model")


def sides(rows: DataFrame) -> DataFrame:
    """(key, side, example_idx, text) without end-of-conversation rows; blank turns of either side are skipped."""
    both = F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.trim(F.coalesce(c, F.lit(""))).alias("text")) for s, c in (("pred", F.col("predicted_output")), ("ref", F.col("expected_output")))]))
    return rows.where(~F.col("is_eos_example")).select(*KEY, "example_idx", *[c for c in META if c in rows.columns], both).where("text <> ''")


def reconstruct(rows: DataFrame) -> DataFrame:
    """Conversations as ordered arrays of turns per side."""
    turns = sides(rows)
    side = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("example_idx", "text")))), lambda x: x["text"])
    return turns.groupBy(*KEY).agg(side("pred").alias("predicted_turns"), side("ref").alias("reference_turns")).withColumn("n_turns", F.greatest(F.size("predicted_turns"), F.size("reference_turns")))


def contradiction(turns: DataFrame, keys: list[str], merchants: tuple[str, ...] = MERCHANTS) -> DataFrame:
    """(keys, self_contradiction): over turns, at least two different first amounts, dates or merchants. A turn naming several merchants counts the first by name."""
    found = turns.select(*keys, *[c.alias(n) for n, c in _claims(merchants).items()])
    return found.groupBy(*keys).agg(_clash().alias("self_contradiction"))


def _claims(merchants: tuple[str, ...]) -> dict[str, Column]:
    """A turn's first amount, date and merchant, null where it names none."""
    lc = F.lower("text")
    return {"__amount": F.nullif(T.amount_digits(T.first_amount(F.col("text"))), F.lit("")), "__date": F.nullif(T.first_month_day(lc), F.lit("")), "__merchant": F.get(T.matched(lc, sorted(merchants)), F.lit(0))}


def _clash() -> Column:
    several = lambda c: F.min(c) < F.max(c)
    return (F.count("*") >= 2) & (F.coalesce(several("__amount"), F.lit(False)) | F.coalesce(several("__date"), F.lit(False)) | F.coalesce(several("__merchant"), F.lit(False)))


def turn_stats(turns: DataFrame, keys: list[str], lex: Lexicons = Lexicons(), more: dict[str, Column] | None = None) -> DataFrame:
    """Statistics of each sequence of turns (keys..., example_idx, text and, if there, the META columns). `more` adds aggregates of the turns' columns."""
    meta = [c for c in META if c in turns.columns]
    lc = turns.select("*", F.lower("text").alias("lc"), T.word_count(F.col("text")).alias("w"))
    has = lambda c: F.col(c) if c in meta else F.lit(None).cast("string")
    idx = F.pmod(F.coalesce(F.col("generation_idx").try_cast("bigint"), F.lit(0)), F.lit(8)) if "generation_idx" in keys else F.lit(0)
    belief = F.coalesce(*[F.when(idx == i, T.has_any(F.col("lc"), ps)) for i, ps in lex.belief.items()], F.lit(False))
    each = lc.withColumns({
        "hedge": T.hits(F.col("lc"), lex.hedge), "sure": T.hits(F.col("lc"), lex.certainty), "promise": T.hits(F.col("lc"), lex.promise), "cats": T.categories(F.col("lc"), lex.concerns),
        "push": T.has_any(F.col("lc"), lex.pushback), "belief": belief, "role": T.has_any(F.col("lc"), lex.role) | F.col("lc").rlike(r"^\s*agent:"),
        "facts": F.coalesce(T.facts(F.col("lc"), has("merchant"), has("amount"), has("transaction_date")), F.lit(0)),
    })
    n = F.count("*")
    r2, rate = (lambda x: T.rounded(F.coalesce(x, F.lit(0.0)), 2)), (lambda x: T.rounded(F.sum(x).cast("double") / n, 3))
    p = F.percentile("w", F.array(F.lit(0.1), F.lit(0.9)))
    said = F.transform(F.sort_array(F.collect_list(F.struct("example_idx", "lc", "push"))), lambda x: F.struct(x["lc"].alias("lc"), x["push"].alias("push")))
    out = each.groupBy(*keys).agg(
        n.cast("int").alias("n_turns"), r2(F.avg("w")).alias("words_mean"), r2(F.stddev_pop("w")).alias("words_std"), r2(F.get(p, F.lit(0))).alias("words_p10"), r2(F.get(p, F.lit(1))).alias("words_p90"),
        rate("hedge").alias("hedge_rate"), rate("sure").alias("certainty_rate"), rate("promise").alias("promise_rate"), T.rounded(F.min_by("facts", "example_idx") / 3, 3).alias("info_density"),
        F.max("cats").alias("max_categories"), F.count_if(F.col("cats") >= 2).cast("int").alias("multi_category_turns"), F.count_if("role").cast("int").alias("role_confused_turns"), F.count_if("push").cast("int").alias("pushback_turns"),
        T.rounded(F.count_if("belief").cast("double") / n, 3).alias("prior_belief_rate"), said.alias("said"), *[c.alias(k) for k, c in (more or {}).items()],
    )
    joined = F.array_join(F.transform("said", lambda x: x["lc"]), " ")
    return out.withColumns({
        "hedge_surplus": T.rounded(F.col("hedge_rate") - F.col("certainty_rate"), 3), "breadth_first": (F.col("max_categories") >= 3) | (F.col("multi_category_turns") >= 2),
        "frustration": T.has_any(joined, lex.frustration), "jargon": T.has_any(joined, lex.jargon), "last_turn": F.get("said", F.size("said") - 1)["lc"],
        "first_pushback": F.coalesce(F.array_position(F.transform("said", lambda x: x["push"]), True) - 1, F.lit(-1)).cast("int"), "dropout_idx": (F.col("n_turns") - 1).cast("int"),
    }).drop("said")


def escalation(turns: DataFrame, keys: list[str], lexicon: tuple[str, ...]) -> DataFrame:
    """(keys, rho): rank correlation of turn position with the number of frustration phrases, rounded to 4."""
    rows = turns.select(*keys, "example_idx", T.hits(F.lower("text"), lexicon).alias("marks"))
    return stats.spearman(rows, keys, "example_idx", "marks").withColumn("rho", T.rounded(F.col("rho"), 4))


DELTAS = {"words": "words_mean", "hedge": "hedge_rate", "certainty": "certainty_rate", "promise": "promise_rate", "hedge_surplus": "hedge_surplus", "info_density": "info_density", "words_std": "words_std"}
FLAGS = (
    "length_inflated length_deflated over_certain under_hedge info_front_loaded breadth_first_new role_confused persona_jargon missed_pushback wrong_belief_missing dropout_implausible "
    "turn_count_mismatch escalation_flat self_contradiction"
).split()


def compare(rows: DataFrame, lex: Lexicons = Lexicons()) -> DataFrame:
    """One row per (variant, conversation): pred_* and ref_* statistics, deltas, the 14 flags and their count.

    Turns are dealt by conversation once; ranks, statistics of each side and the row of both sides follow from that one shuffle.
    """
    by = [*KEY, "side"]
    turns = sides(rows).repartition(*KEY).withColumns({"__marks": T.hits(F.lower("text"), lex.frustration), **_claims(lex.merchants)})
    turns = stats.average_rank(stats.average_rank(turns, by, "example_idx", "__rx"), by, "__marks", "__ry")
    known = [c for c in META if c in turns.columns]
    first = F.min_by(F.struct(*known), "example_idx") if known else F.lit(None)
    st = turn_stats(turns, by, lex, {"rho": T.rounded(stats.rank_correlation("__rx", "__ry"), 4), "contradiction": _clash(), "__first": F.min("example_idx"), "__meta": first})
    measures = [c for c in st.columns if c not in by and not c.startswith("__")]
    pick = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}")
    wide = st.groupBy(*KEY).agg(*[pick(s, c) for s in ("pred", "ref") for c in measures], F.min_by("__meta", "__first").alias("__meta"))
    wide = wide.withColumns({c: F.col("__meta")[c] for c in known}).drop("__meta")
    kinds = dict(wide.dtypes)
    zero = {c: (F.coalesce(c, F.lit(False)) if kinds[c] == "boolean" else F.coalesce(c, F.lit(0).cast(kinds[c]))) for c in wide.columns if c.startswith(("pred_", "ref_")) and kinds[c] in ("boolean", "int", "double", "bigint") and not c.endswith(("rho", "first_pushback"))}
    wide = wide.withColumns(zero)
    wide = wide.withColumns({f"delta_{k}": T.rounded(F.col(f"pred_{m}") - F.col(f"ref_{m}"), 3) for k, m in DELTAS.items()} | {"turn_count_delta": F.col("pred_n_turns") - F.col("ref_n_turns")})
    c, kind, col_of = F.col, F.col("conversation_type"), (lambda x: F.col(x) if x in wide.columns else F.lit(None).cast("string"))
    ratio = F.try_divide(c("pred_words_mean"), F.when(c("ref_words_mean") > 0, c("ref_words_mean")))
    flags = [
        ratio > 1.15, ratio < 0.85, (kind != "type_b") & (c("delta_certainty") > 0.10), (kind != "type_b") & (c("delta_hedge") < -0.10), c("pred_info_density") > c("ref_info_density") + 0.15,
        c("pred_breadth_first") & ~c("ref_breadth_first"), c("pred_role_confused_turns") > 0, c("pred_jargon") & ~c("ref_jargon") & col_of("knowledge_level").isin("novice", "intermediate"),
        (kind == "type_b") & (c("ref_pushback_turns") > 0) & (c("pred_pushback_turns") == 0), (kind == "type_a") & (c("ref_prior_belief_rate") > 0) & (c("pred_prior_belief_rate") == 0),
        (kind == "failure") & ~T.has_any(c("pred_last_turn"), lex.exits), F.abs("turn_count_delta") >= 2, (col_of("emotional_state") == "escalating") & (c("pred_rho") < 0.2) & (c("ref_rho") >= 0.2), c("pred_contradiction"),
    ]
    wide = wide.withColumns({f"flag_{name}": F.coalesce(cond, F.lit(False)) for name, cond in zip(FLAGS, flags)})
    return wide.withColumn("fidelity_flag_count", sum((F.col(f"flag_{f}").cast("int") for f in FLAGS), F.lit(0)))


def rates(compared: DataFrame, *by: str) -> DataFrame:
    """Per group: conversations, mean deltas and flag percentages; a flag of one type counts over that type only (null without any)."""
    own = {"missed_pushback": "type_b", "wrong_belief_missing": "type_a", "dropout_implausible": "failure"}
    share = lambda f: F.avg(F.when(F.col("conversation_type") == own[f], F.col(f"flag_{f}").cast("double")) if f in own else F.col(f"flag_{f}").cast("double"))
    return compared.groupBy(*by).agg(F.count("*").alias("n"), *[T.mean_of(F.col(f"delta_{d}"), 3).alias(f"delta_{d}") for d in DELTAS], *[T.rounded(100 * share(f), 1).alias(f"pct_{f}") for f in FLAGS], T.rounded(F.avg("fidelity_flag_count"), 3).alias("mean_flags"))
