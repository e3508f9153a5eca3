"""Driver queries over conversations: rule layer, sequences, training rows, reports. Each has its SQL beside it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnmill.functions import text as T
from turnmill.operators import report, rules, split, training
from turnmill.plans import base as B
from turnmill.plans.base import r
from turnmill.sources.scans import parquet

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


W = B.WORDS


@query(f"SELECT conv_id, turn, len({W}) AS words FROM conversations")
def turn_word_counts(spark, sf):
    return parquet(spark, sf, "conversations").select("conv_id", "turn", T.word_count(F.col("text")).alias("words"))


@query(f"""WITH w AS (SELECT conv_id, len({W}) AS w FROM conversations WHERE role = 'user')
SELECT conv_id, count(*) AS n, {r('avg(w)', 1)} AS words_mean, {r('quantile_cont(w, 0.5)', 1)} AS words_median, {r('quantile_cont(w, 0.1)', 1)} AS words_p10, {r('quantile_cont(w, 0.9)', 1)} AS words_p90, {r('stddev_pop(w)', 1)} AS words_stddev
FROM w GROUP BY conv_id""")
def conv_structural_stats(spark, sf):
    w = parquet(spark, sf, "conversations").where("role = 'user'").select("conv_id", T.word_count(F.col("text")).alias("w"))
    p = F.percentile("w", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    one = lambda x: T.rounded(x, 1)
    return w.groupBy("conv_id").agg(F.count("*").alias("n"), one(F.avg("w")).alias("words_mean"), one(F.get(p, F.lit(1))).alias("words_median"), one(F.get(p, F.lit(0))).alias("words_p10"), one(F.get(p, F.lit(2))).alias("words_p90"), one(F.stddev_pop("w")).alias("words_stddev"))


@query(f"""WITH w AS (SELECT conv_id, len({W}) AS w FROM conversations WHERE role = 'user'), s AS (SELECT conv_id, count(*) AS n, {r('avg(w)', 1)} AS words_mean, {r('stddev_pop(w)', 1)} AS words_stddev FROM w GROUP BY conv_id)
SELECT conv_id, n, words_mean, words_stddev, words_mean > 30 AS long_turns, words_stddev < 3.0 AND n >= 3 AS low_variance FROM s""")
def conv_length_flags(spark, sf):
    s = conv_structural_stats(spark, sf)
    return s.select("conv_id", "n", "words_mean", "words_stddev", (F.col("words_mean") > 30).alias("long_turns"), ((F.col("words_stddev") < 3.0) & (F.col("n") >= 3)).alias("low_variance"))


@query(f"""SELECT conv_id, count(*) AS n, sum({B.hits('lower(text)', B.HEDGE)})::BIGINT AS hedges, sum({B.hits('lower(text)', B.CERTAINTY)})::BIGINT AS certainties,
{r(f"sum({B.hits('lower(text)', B.HEDGE)})::DOUBLE / count(*)", 3)} AS hedge_rate FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def lexicon_rates(spark, sf):
    rows = parquet(spark, sf, "conversations").where("role = 'user'").withColumn("lc", F.lower("text"))
    rows = rows.select("conv_id", T.hits(F.col("lc"), B.HEDGE).alias("h"), T.hits(F.col("lc"), B.CERTAINTY).alias("c"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("h").alias("hedges"), F.sum("c").alias("certainties"), T.rounded(F.sum("h").cast("double") / F.count("*"), 3).alias("hedge_rate"))


@query(f"""WITH j AS (SELECT conv_id, string_agg(lower(text), ' ' ORDER BY turn) AS j FROM conversations WHERE role = 'user' GROUP BY conv_id) SELECT conv_id, {B.has('j', B.MILD)} AS mild, {B.has('j', B.STRONG)} AS strong FROM j""")
def lexicon_any_joined(spark, sf):
    rows = parquet(spark, sf, "conversations").where("role = 'user'")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.lower("text").alias("l")))), lambda x: x["l"]), " ")
    joined = rows.groupBy("conv_id").agg(said.alias("j"))
    return joined.select("conv_id", T.has_any(F.col("j"), B.MILD).alias("mild"), T.has_any(F.col("j"), B.STRONG).alias("strong"))


_LEX_VALUES = ", ".join(f"({B.q(k)}, {B.q(p)})" for k, ps in (("hedge", B.HEDGE), ("certainty", B.CERTAINTY)) for p in ps)


@query(f"SELECT category, phrase, count(*) AS turns FROM conversations JOIN (VALUES {_LEX_VALUES}) AS l(category, phrase) ON contains(lower(text), phrase) GROUP BY category, phrase")
def lexicon_nlj(spark, sf):
    """Turn by phrase as a broadcast nested-loop join: the lexicon is a literal table of fixed size."""
    lex = spark.createDataFrame([(k, p) for k, ps in (("hedge", B.HEDGE), ("certainty", B.CERTAINTY)) for p in ps], "category string, phrase string")
    lc = parquet(spark, sf, "conversations").select(F.lower("text").alias("lc"))
    return lc.join(F.broadcast(lex), F.contains("lc", "phrase")).groupBy("category", "phrase").agg(F.count("*").alias("turns"))


@query(f"SELECT conv_id, max({B.cats('lower(text)')}) AS max_categories, count(*) FILTER ({B.cats('lower(text)')} >= 2) AS multi, max({B.cats('lower(text)')}) >= 3 OR count(*) FILTER ({B.cats('lower(text)')} >= 2) >= 2 AS breadth_first FROM conversations WHERE role = 'user' GROUP BY conv_id")
def concern_bundling(spark, sf):
    c = parquet(spark, sf, "conversations").where("role = 'user'").select("conv_id", T.categories(F.lower("text"), B.CONCERNS).alias("c"))
    return c.groupBy("conv_id").agg(F.max("c").alias("max_categories"), F.count_if(F.col("c") >= 2).alias("multi")).withColumn("breadth_first", (F.col("max_categories") >= 3) | (F.col("multi") >= 2))


_COLS = "conv_id, dataset_type, knowledge_level, emotional_state, communication_style"


@query(f"""WITH {B.EVALUATED_SQL} SELECT {_COLS}, n0::INT AS num_customer_turns, coalesce(words_mean, 0) AS words_mean, coalesce(words_median, 0) AS words_median, coalesce(words_p10, 0) AS words_p10, coalesce(words_p90, 0) AS words_p90, coalesce(words_stddev, 0) AS words_stddev,
coalesce(hedge_rate, 0) AS hedge_rate, coalesce(certainty_rate, 0) AS certainty_rate, {r('coalesce(hedge_rate, 0) - coalesce(certainty_rate, 0)', 3)} AS hedge_minus_certainty, coalesce(facts1, 0) AS facts_in_turn1, {r('coalesce(facts1, 0) / 3', 3)} AS info_density_score,
coalesce(max_cats, 0) AS max_categories_per_turn, coalesce(multi, 0) AS turns_with_multi_category, coalesce(breadth, FALSE) AS breadth_first_flag, coalesce(has_mild OR has_strong, FALSE) AS frustration_marker_present, len(early) > 0 AS jargon_before_agent, early AS early_jargon, goal_clarity,
warnings, len(warnings) AS warning_count, n0 > 0 AND len(warnings) >= 3 AS is_outlier FROM e""")
def rule_layer(spark, sf):
    return B.evaluated(spark, sf)


@query(f"WITH {B.EVALUATED_SQL} SELECT conv_id, array_to_string(warnings, ' | ') AS warnings, len(warnings) AS warning_count FROM e")
def warning_array(spark, sf):
    return B.evaluated(spark, sf).select("conv_id", F.array_join("warnings", " | ").alias("warnings"), "warning_count")


@query(f"WITH {B.EVALUATED_SQL} SELECT code, count(*) AS conversations FROM (SELECT conv_id, unnest(list_distinct(warnings)) AS code FROM e) GROUP BY code")
def warning_frequency(spark, sf):
    return rules.warning_frequency(B.evaluated(spark, sf))


@query(f"WITH {B.EVALUATED_SQL} SELECT conv_id, len(warnings) AS warning_count FROM e WHERE n0 > 0 AND len(warnings) >= 3 ORDER BY len(warnings) DESC, conv_id LIMIT 15")
def outlier_topk(spark, sf):
    return rules.outliers(B.evaluated(spark, sf), ["conv_id"], 15).select("conv_id", "warning_count")


@query(f"WITH {B.EVALUATED_SQL}, s AS (SELECT {r('avg(words_mean) FILTER (communication_style = ' + B.q('direct') + ')', 2)} AS direct_mean, {r('avg(words_mean) FILTER (communication_style = ' + B.q('indirect') + ')', 2)} AS indirect_mean FROM e WHERE n0 > 0) SELECT *, CASE WHEN direct_mean >= indirect_mean THEN 'POPULATION_STYLE_MISMATCH' WHEN direct_mean < indirect_mean THEN 'POPULATION_STYLE_OK' END AS note FROM s")
def population_style_check(spark, sf):
    return rules.style_check(B.evaluated(spark, sf))


@query(f"""WITH {B.EVALUATED_SQL}, s AS (SELECT unnest([{{'m': 'words_mean', 'v': coalesce(words_mean, 0)}}, {{'m': 'words_stddev', 'v': coalesce(words_stddev, 0)}}, {{'m': 'num_customer_turns', 'v': n0::DOUBLE}}, {{'m': 'words_p90', 'v': coalesce(words_p90, 0)}}]) AS x FROM e)
SELECT x.m AS metric, {r('avg(x.v)', 3)} AS mean, min(x.v) AS min, max(x.v) AS max, {r('stddev_pop(x.v)', 3)} AS std FROM s GROUP BY x.m""")
def structural_summary(spark, sf):
    return report.structural(B.evaluated(spark, sf))


@query(f"WITH {B.EVALUATED_SQL} SELECT emotional_state, count(*) AS n, {r('avg(coalesce(hedge_rate, 0))', 3)} AS hedge_mean, count(*) FILTER (coalesce(certainty_rate, 0) > coalesce(hedge_rate, 0)) AS certain_over_hedged FROM e GROUP BY emotional_state")
def lexical_by_state(spark, sf):
    return B.evaluated(spark, sf).groupBy("emotional_state").agg(F.count("*").alias("n"), T.rounded(F.avg("hedge_rate"), 3).alias("hedge_mean"), F.count_if(F.col("certainty_rate") > F.col("hedge_rate")).alias("certain_over_hedged"))


@query(f"WITH {B.EVALUATED_SQL} SELECT k.f::INT AS facts_in_turn1, count(e.conv_id) AS n FROM range(4) AS k(f) LEFT JOIN e ON coalesce(e.facts1, 0) = k.f GROUP BY k.f")
def info_density_counts(spark, sf):
    return report.info_density(B.evaluated(spark, sf))


@query(f"""WITH {B.EVALUATED_SQL} SELECT code, count(*) FILTER (dataset_type = t AND list_contains(warnings, code)) AS flagged, count(*) FILTER (dataset_type = t) AS eligible
FROM e, (VALUES ('DROPOUT_NOT_PLAUSIBLE', 'failure'), ('MISSING_ESCALATION_ARC', 'failure'), ('PRIOR_BELIEF_ABSENT', 'type_a'), ('ERROR_NOT_CAUGHT', 'type_b')) AS k(code, t) GROUP BY code""")
def type_specific_checks(spark, sf):
    return report.type_checks(B.evaluated(spark, sf), {"DROPOUT_NOT_PLAUSIBLE": "failure", "MISSING_ESCALATION_ARC": "failure", "PRIOR_BELIEF_ABSENT": "type_a", "ERROR_NOT_CAUGHT": "type_b"})


@query(f"""WITH {B.EVALUATED_SQL} SELECT communication_style, count(*) AS n, min(coalesce(words_mean, 0)) AS min, {r('quantile_cont(coalesce(words_mean, 0), 0.25)', 2)} AS q1, {r('quantile_cont(coalesce(words_mean, 0), 0.5)', 2)} AS median, {r('quantile_cont(coalesce(words_mean, 0), 0.75)', 2)} AS q3, max(coalesce(words_mean, 0)) AS max FROM e GROUP BY communication_style""")
def style_box_stats(spark, sf):
    return report.box_stats(B.evaluated(spark, sf), "communication_style", "words_mean")


@query(f"WITH {B.EVALUATED_SQL} SELECT floor(coalesce(words_mean, 0) / 5) * 5 AS bin, count(*) AS n FROM e GROUP BY 1")
def length_histogram(spark, sf):
    return report.histogram(B.evaluated(spark, sf), "words_mean", 5.0)


@query(f"""WITH {B.EVALUATED_SQL} SELECT count(*) AS conversations, {r('avg(len(warnings))', 2)} AS avg_warnings, count(*) FILTER (n0 > 0 AND len(warnings) >= 3) AS outliers FROM e""")
def executive_summary(spark, sf):
    return report.executive_summary(B.evaluated(spark, sf))


@query(f"""WITH {B.EVALUATED_SQL}, v AS (SELECT unnest([{{'a': 'dataset_type', 'v': dataset_type}}, {{'a': 'knowledge_level', 'v': knowledge_level}}, {{'a': 'emotional_state', 'v': emotional_state}}, {{'a': 'communication_style', 'v': communication_style}}, {{'a': 'goal_clarity', 'v': goal_clarity}}]) AS x FROM e)
SELECT x.a AS attribute, x.v AS value, count(*) AS n, {r('100.0 * count(*) / (SELECT count(*) FROM e)', 1)} AS pct FROM v GROUP BY x.a, x.v""")
def persona_value_counts(spark, sf):
    return report.composition(B.evaluated(spark, sf))


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT a.conv_id, a.turn, coalesce(string_agg(CASE WHEN b.role = 'user' THEN 'Customer: ' ELSE 'Agent: ' END || b.text, chr(10) ORDER BY b.turn), '') AS history
FROM h a LEFT JOIN h b ON a.conv_id = b.conv_id AND b.k < a.k GROUP BY a.conv_id, a.turn""")
def history_prefix(spark, sf):
    return training.history(parquet(spark, sf, "conversations"), ["conv_id"], "turn", "role", "text").select("conv_id", "turn", "history")


_INTENT = "'ask about ' || conv_id"


@query(rf"""WITH h AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations), p AS (
SELECT a.conv_id, a.turn, a.role, a.text, a.n, a.last, coalesce(string_agg(CASE WHEN b.role = 'user' THEN 'Customer: ' ELSE 'Agent: ' END || b.text, chr(10) ORDER BY b.turn), '') AS history
FROM h a LEFT JOIN h b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN history = '' THEN 'Goal: ' || {_INTENT} || '.' || chr(10) || 'Write the opening message.'
  WHEN conv_id % 4 = 1 THEN 'Goal: ' || {_INTENT} || '. You may give up.' || chr(10) || 'Conversation so far:' || chr(10) || history || chr(10) || chr(10) || 'If your goal cannot be met, answer <eos>; else write the next message.'
  ELSE 'Goal: ' || {_INTENT} || '.' || chr(10) || 'Conversation so far:' || chr(10) || history || chr(10) || chr(10) || 'If your goal is met, answer <eos>; else write the next message.' END AS input,
  CASE WHEN turn = last THEN '<eos>' ELSE text || '<eos>' END AS output FROM p WHERE role = 'user' AND n >= 2""")
def training_rows(spark, sf):
    intent = F.concat(F.lit("ask about "), F.col("conv_id").cast("string"))
    return training.training_rows(parquet(spark, sf, "conversations"), ["conv_id"], intent, F.pmod("conv_id", F.lit(4)) == 1, "turn", "role", "text")


@query("SELECT conv_id, turn, turn = max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS is_last FROM conversations WHERE role = 'user'")
def last_user_flag(spark, sf):
    rows = parquet(spark, sf, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", (F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))).alias("is_last"))


@query(f"SELECT conv_id, coalesce(bool_or(turn >= 4 AND role = 'user' AND {B.has('lower(text)', B.PUSHBACK)}), FALSE) AS user_caught_error FROM conversations GROUP BY conv_id")
def caught_error_label(spark, sf):
    rows = parquet(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return training.caught_error(rows, ["conv_id"], B.PUSHBACK, idx="turn")


@query("SELECT conv_id, string_agg('[' || CASE WHEN role = 'user' THEN 'CUSTOMER' ELSE 'AGENT' END || ']: ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def judge_transcript(spark, sf):
    rows = parquet(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return training.transcript(rows, ["conv_id"], "turn")


@query(f"WITH t AS ({B.TURN_SQL}), u AS (SELECT conv_id, lc, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn_idx) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t WHERE cust) SELECT conv_id, count(*) AS turns, sum(w) FILTER (k <= n // 2)::BIGINT AS first_half_words, sum(w) FILTER (k > n // 2)::BIGINT AS second_half_words, arg_max({B.has('lc', B.EXITS)}, k) AS exit_signal FROM u GROUP BY conv_id")
def halves_and_final_turn(spark, sf):
    w = Window.partitionBy("conv_id")
    u = B.turns(spark, sf).where("speaker = 'Customer'").select("conv_id", "turn_idx", F.lower("text").alias("lc"), T.word_count(F.col("text")).alias("w"))
    u = u.withColumns({"k": F.row_number().over(w.orderBy("turn_idx")), "n": F.count("*").over(w)})
    half = F.floor(F.col("n") / 2)
    return u.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.when(F.col("k") <= half, F.col("w"))).alias("first_half_words"), F.sum(F.when(F.col("k") > half, F.col("w"))).alias("second_half_words"), F.max_by(T.has_any(F.col("lc"), B.EXITS), "k").alias("exit_signal"))


@query("""WITH i AS (SELECT DISTINCT conv_id, md5('42-' || conv_id) AS h FROM conversations), k AS (SELECT *, row_number() OVER (ORDER BY h, conv_id) AS n, count(*) OVER () AS all_n FROM i)
SELECT conv_id, CASE WHEN n <= greatest(1, floor(all_n * 0.8)) THEN 'train' ELSE 'val' END AS split FROM k""")
def conversation_split(spark, sf):
    rows = parquet(spark, sf, "conversations").select("conv_id").distinct()
    return split.split_conversations(rows, key="conv_id").select("conv_id", "split")


_HS = f"WITH h AS ({B.HEADER_SQL})"


@query(f"""{_HS} SELECT CASE WHEN grouping(dataset_type) = 0 THEN 'dataset_type' WHEN grouping(failure_mode) = 0 THEN 'failure_mode' WHEN grouping(goal_completed) = 0 THEN 'goal_completed' WHEN grouping(user_caught_error) = 0 THEN 'user_caught_error' ELSE 'overall' END AS slice_dim,
CASE WHEN grouping(dataset_type) = 0 THEN dataset_type WHEN grouping(failure_mode) = 0 THEN failure_mode WHEN grouping(goal_completed) = 0 THEN goal_completed::VARCHAR WHEN grouping(user_caught_error) = 0 THEN coalesce(user_caught_error::VARCHAR, 'unknown') ELSE 'all' END AS slice_val, count(*) AS n
FROM h GROUP BY GROUPING SETS ((dataset_type), (failure_mode), (goal_completed), (user_caught_error), ())""")
def split_stats(spark, sf):
    return split.slices(B.headers(spark, sf), ["dataset_type", "failure_mode", "goal_completed", "user_caught_error"], {"n": F.count("*")})


@query("""WITH p AS (SELECT * FROM (VALUES (0, 'novice'), (1, 'intermediate'), (2, 'expert')) AS p(po, knowledge_level)), s AS (SELECT * FROM (VALUES (0, 'refund'), (1, 'hold')) AS s(so, resolution))
SELECT g.i AS generation_idx, knowledge_level, resolution FROM range(20) AS g(i) JOIN p ON po = (g.i % 6) // 2 JOIN s ON so = g.i % 2""")
def persona_scenario_cross(spark, sf):
    p = spark.createDataFrame([(0, "novice"), (1, "intermediate"), (2, "expert")], "ord int, knowledge_level string")
    s = spark.createDataFrame([(0, "refund"), (1, "hold")], "ord int, resolution string")
    return split.plan_tasks(spark, p, s, 20)


@query("SELECT DISTINCT conv_id AS generation_idx FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 4)")
def anti_join_resume(spark, sf):
    rows = parquet(spark, sf, "conversations")
    return split.remaining(rows.select(F.col("conv_id").alias("generation_idx")).distinct(), rows.where("turn >= 4").select(F.col("conv_id").alias("generation_idx")))


@query("""SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w))::DOUBLE / len(w) END AS ttr, CASE WHEN len(w) < 3 THEN 1.0 ELSE len(list_distinct(g))::DOUBLE / len(g) END AS trigram_ratio FROM (
SELECT doc_id, w, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS g FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents))""".replace("\\\\", "\\"))
def type_token_ratio(spark, sf):
    d = parquet(spark, sf, "documents")
    return d.select("doc_id", T.type_token_ratio(F.col("text")).alias("ttr"), T.trigram_ratio(F.col("text")).alias("trigram_ratio"))


@query("SELECT l_orderkey % 3 AS half, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 100 + o_orderkey % 3, count(*) FROM orders GROUP BY 1")
def union_heldout(spark, sf):
    a = parquet(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 3).alias("half")).agg(F.count("*").alias("n"))
    b = parquet(spark, sf, "orders").groupBy((100 + F.col("o_orderkey") % 3).alias("half")).agg(F.count("*").alias("n"))
    return training.union_all(a, b)
