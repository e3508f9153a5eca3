"""Facts shared by the driver queries, in Spark and in SQL. The driver's conversations carry no persona or type columns and hardly
any phrase of the domain lists, so both sides derive the former from conv_id and use stand-in lists that occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import text as T
from turnmill.operators import fidelity, rules
from turnmill.sources.scans import parquet

HEDGE = ("whst", "tion", "eux", "keit", "que l")
CERTAINTY = ("ing ", "ment", "ung", "ción", "edble")
PROMISE = ("or", "elle")
MILD = ("eaer", "ververs", "oieau")
STRONG = ("sht", "ßz", "êç", "ñosó")
JARGON = ("thon", "elle", "enst", "stand", "osó")
PUSHBACK = ("whth", "chst", "oiç", "rely", "ist")
EXITS = ("ble", "lich", "eau.")
ROLE = ("than the", "und die", "la de")
CONCERNS = {"a": ("and", "und"), "b": ("of ", "der "), "c": ("erth", "oiç"), "d": ("reth", "ach")}
DROPOUT = {"impatience": ("th", "en "), "loop_exit": ("qu", "sh"), "escalation_exit": ("ß", "ou")}
BELIEF = {i: (p,) for i, p in enumerate(("the ", "und ", "que ", "tion", "er", "est", "re ", "ing"))}
MERCHANTS = ("thand", "ment", "keit", "ción")
RULE_LEX = rules.Lexicons(HEDGE, CERTAINTY, MILD, STRONG, JARGON, PUSHBACK, CONCERNS, DROPOUT)
PAIR_LEX = fidelity.Lexicons(HEDGE, CERTAINTY, PROMISE, (*MILD, *STRONG, "ea", "au"), JARGON, CONCERNS, ROLE, PUSHBACK, EXITS, BELIEF, MERCHANTS)

_CYCLES = {
    "dataset_type": ("success", "failure", "type_a", "type_b"), "knowledge_level": ("novice", "intermediate", "expert"), "emotional_state": ("calm", "mildly_frustrated", "escalating", "calm", "mildly_frustrated"),
    "communication_style": ("direct", "indirect", "terse", "verbose", "direct", "indirect", "terse"), "goal_clarity": ("clear", "vague"), "certainty": ("certain_fraud", "uncertain", "certain_fraud"),
    "failure_mode": ("impatience", "loop_exit", "escalation_exit", "None", "other"), "merchant": ("Than", "Ment", "Ung", "Zu", "of"), "amount": ("$12.00", "$1,003.5", "7"), "transaction_date": ("March 4", "August 14th", "June 31", "may 2", "on 5"),
    "wrong_prior_belief": ("within this tion with thing theer", "and the that ment erth tion", ""),
}


def _cycle(name: str):
    values = _CYCLES[name]
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod("conv_id", F.lit(len(values))).cast("int"))


def _cycle_sql(name: str) -> str:
    values = _CYCLES[name]
    return f"CASE conv_id % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn_idx, speaker, text) of users and assistants."""
    rows = parquet(spark, sf, "conversations").where("role IN ('user', 'assistant')")
    return rows.select("conv_id", F.col("turn").alias("turn_idx"), F.when(F.col("role") == "user", "Customer").otherwise("Agent").alias("speaker"), "text")


def headers(spark: SparkSession, sf: str) -> DataFrame:
    ids = parquet(spark, sf, "conversations").select("conv_id").distinct()
    more = {"goal_completed": F.pmod("conv_id", F.lit(4)) != 1, "user_caught_error": F.when(F.pmod("conv_id", F.lit(3)) < 2, F.pmod("conv_id", F.lit(3)) == 0)}
    return ids.withColumns({c: _cycle(c) for c in _CYCLES} | more)


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return rules.evaluate(turns(spark, sf), headers(spark, sf), ["conv_id"], RULE_LEX)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction rows: the reference is a user turn, the prediction the whole assistant turn after it."""
    rows = parquet(spark, sf, "conversations")
    user = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("expected_output"))
    reply = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("predicted_output"))
    both = user.join(reply, ["conv_id", "turn"], "left").withColumn("predicted_output", F.coalesce("predicted_output", F.lit("")))
    variant = F.get(F.array(*[F.lit(f"{k}_{s}") for s in ("4b", "12b", "27b") for k in ("base", "lora")]), F.pmod("conv_id", F.lit(6)).cast("int"))
    named = both.withColumns({c: _cycle(c) for c in ("dataset_type", "failure_mode", "knowledge_level", "emotional_state", "communication_style", "goal_clarity", "merchant", "amount", "transaction_date")})
    return named.select(variant.alias("model_variant"), F.col("conv_id").alias("generation_idx"), F.col("turn").alias("example_idx"), F.lit(False).alias("is_eos_example"), "expected_output", "predicted_output", F.col("dataset_type").alias("conversation_type"), *[c for c in named.columns if c in ("failure_mode", "knowledge_level", "emotional_state", "communication_style", "goal_clarity", "merchant", "amount", "transaction_date")])


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic responses that reach every branch: absent keys, text, null, numbers out of range, unreadable JSON, error objects."""
    c = lambda k, m: F.pmod(F.col("conv_id") * k, F.lit(m))
    item = lambda d, i: F.when(c(i + 1, 11) == 0, "").when(c(i + 1, 13) == 0, f'"{d}_score": "n/a", ').when(c(i + 1, 17) == 0, f'"{d}_score": null, ').otherwise(F.concat(F.lit(f'"{d}_score": '), (c(i + 2, 8) - 1).cast("string"), F.lit(", ")))
    dims = ("depth_first", "uncertainty", "info_drip", "pragmatic", "persona", "dropout_authenticity", "prior_belief_coherence", "error_catch_quality", "pushback_naturalness")
    body = F.concat(F.lit("{"), *[item(d, i) for i, d in enumerate(dims)], F.lit('"standout_issue": "x"}'))
    raw = F.when(c(1, 19) == 3, "not json").when(c(1, 23) == 5, '{"_parse_error": "x", "_raw": "y"}').when(c(1, 5) == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return parquet(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", *[_cycle(x).alias(x) for x in ("dataset_type", "emotional_state", "communication_style", "knowledge_level")], raw.alias("raw_json"))


# ---- SQL side ----

def r(x: str, k: int) -> str:
    p = f"1e{k}"
    return f"(CASE WHEN ({x}) >= 0 THEN floor(({x}) * {p} + 0.5)::BIGINT / {p} ELSE -(floor(-({x}) * {p} + 0.5)::BIGINT) / {p} END)"


def mean_r(x: str, k: int) -> str:
    """Mean of values that have k decimals, rounded to k: summed as whole units, so no order of rows moves a tie."""
    return "(" + r(f"sum(round(({x}) * 1e{k})::BIGINT)::DOUBLE / count({x})", 0) + f" / 1e{k})"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits(lc: str, phrases) -> str:
    return "(" + " + ".join(f"contains({lc}, {q(p)})::INT" for p in phrases) + ")"


def has(lc: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({lc}, {q(p)})" for p in phrases) + ")"


def cats(lc: str, by=CONCERNS) -> str:
    return "(" + " + ".join(f"{has(lc, p)}::INT" for p in by.values()) + ")"


WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


def facts(lc: str) -> str:
    digits, day, month = "regexp_replace(amount, '[^0-9.]', '', 'g')", r"regexp_extract(transaction_date, '(\d+)', 1)", "lower(regexp_extract(transaction_date, '^([A-Za-z]+)', 1))"
    return f"((merchant <> '' AND contains({lc}, lower(merchant)))::INT + ({digits} <> '' AND contains(replace({lc}, ',', ''), {digits}))::INT + (({day} <> '' AND contains({lc}, {day})) OR ({month} <> '' AND contains({lc}, {month})))::INT)"


HEADER_SQL = "SELECT DISTINCT conv_id, " + ", ".join(f"{_cycle_sql(c)} AS {c}" for c in _CYCLES) + ", conv_id % 4 <> 1 AS goal_completed, CASE WHEN conv_id % 3 < 2 THEN conv_id % 3 = 0 END AS user_caught_error FROM conversations"
TURN_SQL = f"SELECT conv_id, turn AS turn_idx, role = 'user' AS cust, text, lower(text) AS lc, len({WORDS}) AS w FROM conversations WHERE role IN ('user', 'assistant')"
_belief = "list_filter(regexp_extract_all(lower(wrong_prior_belief), '[a-z]+'), lambda k: length(k) > 3 AND NOT list_contains([" + ", ".join(q(s) for s in T.STOPWORDS) + "], k))"


def _early_sql() -> str:
    parts = [f"SELECT conv_id, turn_idx, {i} AS i, {q(p)} AS term FROM t JOIN (SELECT conv_id AS c2, min(turn_idx) FILTER (NOT cust AND contains(lc, {q(p)})) AS a FROM t GROUP BY conv_id) ON conv_id = c2 WHERE cust AND contains(lc, {q(p)}) AND (a IS NULL OR turn_idx < a)" for i, p in enumerate(JARGON)]
    return " UNION ALL ".join(parts)


def _codes_sql() -> str:
    both = (*MILD, *STRONG)
    bc = lambda t: f"len(list_filter(belief, lambda k: contains({t}, k)))"
    has_belief = "(dataset_type = 'type_a' AND coalesce(wrong_prior_belief, '') <> '')"
    modes = " ".join(f"WHEN {q(m)} THEN {has('last_turn', ps)}" for m, ps in DROPOUT.items())
    rules_ = [
        ("HIGH_AVG_TURN_LENGTH", "words_mean > 30"), ("LOW_LENGTH_VARIANCE", "words_stddev < 3.0 AND n >= 3"),
        ("CERTAINTY_EXCEEDS_HEDGING", "(emotional_state IN ('calm', 'mildly_frustrated') OR certainty = 'uncertain') AND certainty_rate > hedge_rate"), ("ZERO_HEDGING_FOR_UNCERTAIN_SCENARIO", "certainty = 'uncertain' AND hedges = 0"),
        ("INFO_DUMP_TURN1", "facts1 = 3"), ("BREADTH_FIRST_BUNDLING", "breadth"), ("MISSING_FRUSTRATION_MARKERS", "emotional_state = 'mildly_frustrated' AND NOT has_mild AND NOT has_strong"),
        ("UNEXPECTED_FRUSTRATION", "emotional_state = 'calm' AND (has_mild OR has_strong)"), ("MISSING_STRONG_FRUSTRATION", "emotional_state IN ('very_upset', 'escalating') AND NOT has_strong"), ("NOVICE_JARGON", "knowledge_level = 'novice' AND len(early) > 0"),
        ("DIRECT_STYLE_BUT_LONG_TURNS", "communication_style = 'direct' AND words_mean > 25"), ("INDIRECT_STYLE_BUT_VERY_SHORT", "communication_style = 'indirect' AND words_mean < 6"), ("DROPOUT_TOO_EARLY", "dataset_type = 'failure' AND n < 3"),
        ("DROPOUT_NOT_PLAUSIBLE", f"dataset_type = 'failure' AND NOT (CASE failure_mode {modes} ELSE TRUE END)"),
        ("MISSING_ESCALATION_ARC", f"dataset_type = 'failure' AND failure_mode IN ('impatience', 'escalation_exit') AND n >= 4 AND NOT {has('second_half', both)}"),
        ("PRIOR_BELIEF_ABSENT", f"{has_belief} AND {bc('joined')} < 2"), ("BELIEF_SILENTLY_DROPPED", f"{has_belief} AND {bc('joined')} >= 2 AND n >= 4 AND {bc('first_half')} >= 2 AND {bc('second_half')} = 0"),
        ("ERROR_NOT_CAUGHT", f"dataset_type = 'type_b' AND NOT {has('joined', PUSHBACK)}"), ("USER_CAUGHT_ERROR_LABEL_MISMATCH", f"dataset_type = 'type_b' AND ((user_caught_error AND NOT {has('joined', PUSHBACK)}) OR (NOT user_caught_error AND {has('joined', PUSHBACK)}))"),
    ]
    items = ", ".join(f"CASE WHEN coalesce({c}, FALSE) THEN {q(n)} END" for n, c in rules_)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


#: A CTE list that ends in e, one row per conversation with every rule-layer column.
EVALUATED_SQL = f"""
h AS ({HEADER_SQL}), t AS ({TURN_SQL}), early AS (SELECT conv_id, list(term ORDER BY turn_idx, i) AS early FROM ({_early_sql()}) GROUP BY conv_id),
a AS (
  SELECT conv_id, count(*) AS n, {r('avg(w)', 1)} AS words_mean, {r('quantile_cont(w, 0.1)', 1)} AS words_p10, {r('quantile_cont(w, 0.5)', 1)} AS words_median, {r('quantile_cont(w, 0.9)', 1)} AS words_p90, {r('stddev_pop(w)', 1)} AS words_stddev,
    sum({hits('lc', HEDGE)}) AS hedges, {r(f"sum({hits('lc', HEDGE)})::DOUBLE / count(*)", 3)} AS hedge_rate, {r(f"sum({hits('lc', CERTAINTY)})::DOUBLE / count(*)", 3)} AS certainty_rate,
    max({cats('lc')}) AS max_cats, count(*) FILTER ({cats('lc')} >= 2) AS multi, list(lc ORDER BY turn_idx) AS said
  FROM t WHERE cust GROUP BY conv_id
), b AS (
  SELECT h.*, coalesce(n, 0) AS n0, a.* EXCLUDE (conv_id), coalesce(early, []) AS early, array_to_string(said, ' ') AS joined, said[1] AS first_turn, said[len(said)] AS last_turn,
    array_to_string(said[1:n // 2], ' ') AS first_half, array_to_string(said[n // 2 + 1:], ' ') AS second_half, max_cats >= 3 OR multi >= 2 AS breadth, {_belief} AS belief
  FROM h LEFT JOIN a USING (conv_id) LEFT JOIN early USING (conv_id)
), c AS (SELECT *, {has('joined', MILD)} AS has_mild, {has('joined', STRONG)} AS has_strong, {facts('first_turn')} AS facts1 FROM b
), e AS (SELECT *, CASE WHEN n0 > 0 THEN {_codes_sql()} ELSE ['NO_CUSTOMER_TURNS'] END AS warnings FROM c)
"""
