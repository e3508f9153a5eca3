"""Driver queries over prediction pairs and judge scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions import stats
from turnmill.functions import text as T
from turnmill.operators import fidelity, judge, metrics, split
from turnmill.plans import base as B
from turnmill.plans.base import mean_r, r
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


_MD = r"(january|february|march|april|may|june|july|august|september|october|november|december)\s+(\d{1,2})|(\d{1,2})\s+(january|february|march|april|may|june|july|august|september|october|november|december)"
_VARIANT = "CASE conv_id % 6 " + " ".join(f"WHEN {i} THEN '{k}_{s}'" for i, (s, k) in enumerate((s, k) for s in ("4b", "12b", "27b") for k in ("base", "lora"))) + " END"
#: rows: prediction pairs; s: one row per variant, conversation and side; w: both sides on one row with deltas and flags.
_ROWS = rf"""
h AS ({B.HEADER_SQL}), rows AS (
  SELECT {_VARIANT.replace('conv_id', 'u.conv_id')} AS model_variant, u.conv_id AS generation_idx, u.turn AS example_idx, trim(u.text) AS ref, coalesce(a.text, '') AS pred
  FROM conversations u LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'
), turns AS (SELECT model_variant, generation_idx, example_idx, side, text, lower(text) AS lc, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS w
  FROM (SELECT model_variant, generation_idx, example_idx, 'pred' AS side, trim(pred) AS text FROM rows UNION ALL SELECT model_variant, generation_idx, example_idx, 'ref', ref FROM rows) WHERE text <> '')
"""
_BELIEF = "CASE generation_idx % 8 " + " ".join(f"WHEN {i} THEN {B.has('lc', p)}" for i, p in B.BELIEF.items()) + " ELSE FALSE END"
_P = B.PAIR_LEX
_STATS = f"""{_ROWS}, s0 AS (
  SELECT t.*, {B.facts('lc')} AS facts FROM turns t JOIN h ON h.conv_id = t.generation_idx
), s AS (
  SELECT model_variant, generation_idx, side, count(*) AS n_turns, {r('avg(w)', 2)} AS words_mean, {r('stddev_pop(w)', 2)} AS words_std, {r('quantile_cont(w, 0.1)', 2)} AS words_p10, {r('quantile_cont(w, 0.9)', 2)} AS words_p90,
    {r(f"sum({B.hits('lc', _P.hedge)})::DOUBLE / count(*)", 3)} AS hedge_rate, {r(f"sum({B.hits('lc', _P.certainty)})::DOUBLE / count(*)", 3)} AS certainty_rate, {r(f"sum({B.hits('lc', _P.promise)})::DOUBLE / count(*)", 3)} AS promise_rate,
    {r('arg_min(facts, example_idx) / 3', 3)} AS info_density, max({B.cats('lc')}) AS max_categories, count(*) FILTER ({B.cats('lc')} >= 2) AS multi, count(*) FILTER ({B.has('lc', _P.role)}) AS role_confused_turns,
    count(*) FILTER ({B.has('lc', _P.pushback)}) AS pushback_turns, {r(f"(count(*) FILTER ({_BELIEF}))::DOUBLE / count(*)", 3)} AS prior_belief_rate, string_agg(lc, ' ' ORDER BY example_idx) AS joined, arg_max(lc, example_idx) AS last_turn
  FROM s0 GROUP BY model_variant, generation_idx, side
), s2 AS (SELECT *, {r('hedge_rate - certainty_rate', 3)} AS hedge_surplus, max_categories >= 3 OR multi >= 2 AS breadth_first, {B.has('joined', _P.frustration)} AS frustration, {B.has('joined', _P.jargon)} AS jargon FROM s)
"""
_RHO = f"""rk AS (
  SELECT *, rank() OVER (PARTITION BY model_variant, generation_idx, side ORDER BY example_idx) AS ra, rank() OVER (PARTITION BY model_variant, generation_idx, side ORDER BY m) + (count(*) OVER (PARTITION BY model_variant, generation_idx, side, m) - 1) / 2 AS rb
  FROM (SELECT *, {B.hits('lc', _P.frustration)} AS m FROM turns)
), rho AS (SELECT model_variant, generation_idx, side, CASE WHEN count(*) >= 3 AND stddev_pop(ra) * stddev_pop(rb) > 0 THEN {r('covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb))', 4)} END AS rho FROM rk GROUP BY model_variant, generation_idx, side)
"""
_MER = "list_filter([" + ", ".join(B.q(m) for m in sorted(B.MERCHANTS)) + "], lambda m: contains(lc, m))[1]"
_CON = rf"""con AS (SELECT model_variant, generation_idx, side, count(*) >= 2 AND (count(DISTINCT nullif(regexp_replace(regexp_extract(text, '\$[\d,]+(?:\.\d{{1,2}})?'), '[^0-9.]', '', 'g'), '')) > 1
  OR count(DISTINCT nullif(regexp_extract(lc, '{_MD}', 1) || regexp_extract(lc, '{_MD}', 2) || regexp_extract(lc, '{_MD}', 3) || regexp_extract(lc, '{_MD}', 4), '')) > 1 OR count(DISTINCT {_MER}) > 1) AS self_contradiction FROM turns GROUP BY model_variant, generation_idx, side)"""


def _wide() -> str:
    st = ["n_turns", *fidelity.DELTAS.values(), "role_confused_turns", "pushback_turns", "prior_belief_rate"]
    num = ", ".join(f"coalesce(max({c}) FILTER (side = '{s}'), 0) AS {s}_{c}" for s in ("pred", "ref") for c in dict.fromkeys(st))
    boo = ", ".join(f"coalesce(bool_or({c}) FILTER (side = '{s}'), FALSE) AS {s}_{c}" for s in ("pred", "ref") for c in ("breadth_first", "jargon"))
    deltas = ", ".join(f"{r(f'pred_{m} - ref_{m}', 3)} AS delta_{k}" for k, m in fidelity.DELTAS.items())
    flags = [
        "ref_words_mean > 0 AND pred_words_mean / ref_words_mean > 1.15", "ref_words_mean > 0 AND pred_words_mean / ref_words_mean < 0.85", "kind <> 'type_b' AND delta_certainty > 0.10", "kind <> 'type_b' AND delta_hedge < -0.10", "pred_info_density > ref_info_density + 0.15",
        "pred_breadth_first AND NOT ref_breadth_first", "pred_role_confused_turns > 0", "pred_jargon AND NOT ref_jargon AND knowledge_level IN ('novice', 'intermediate')", "kind = 'type_b' AND ref_pushback_turns > 0 AND pred_pushback_turns = 0",
        "kind = 'type_a' AND ref_prior_belief_rate > 0 AND pred_prior_belief_rate = 0", f"kind = 'failure' AND NOT {B.has('pred_last', _P.exits)}", "abs(pred_n_turns - ref_n_turns) >= 2", "emotional_state = 'escalating' AND pred_rho < 0.2 AND ref_rho >= 0.2", "pred_con",
    ]
    fl = ", ".join(f"coalesce({c}, FALSE) AS flag_{n}" for n, c in zip(fidelity.FLAGS, flags))
    return f"""WITH {_STATS}, {_RHO}, {_CON}, w0 AS (
  SELECT model_variant, generation_idx, {num}, {boo}, max(last_turn) FILTER (side = 'pred') AS pred_last FROM s2 GROUP BY model_variant, generation_idx
), w1 AS (
  SELECT w0.*, h.dataset_type AS kind, h.knowledge_level, h.emotional_state, p.rho AS pred_rho, q.rho AS ref_rho, c.self_contradiction AS pred_con, pred_n_turns - ref_n_turns AS turn_count_delta, {deltas}
  FROM w0 JOIN h ON h.conv_id = generation_idx LEFT JOIN rho p ON p.model_variant = w0.model_variant AND p.generation_idx = w0.generation_idx AND p.side = 'pred' LEFT JOIN rho q ON q.model_variant = w0.model_variant AND q.generation_idx = w0.generation_idx AND q.side = 'ref'
  LEFT JOIN con c ON c.model_variant = w0.model_variant AND c.generation_idx = w0.generation_idx AND c.side = 'pred'
), w2 AS (SELECT *, {fl} FROM w1), w AS (SELECT *, {' + '.join(f'flag_{f}::INT' for f in fidelity.FLAGS)} AS fidelity_flag_count FROM w2)"""


_W = _wide()


def _compared(spark, sf):
    return fidelity.compare(B.pairs(spark, sf), B.PAIR_LEX)


@query(f"WITH {_ROWS} SELECT model_variant, generation_idx, list(text ORDER BY example_idx) FILTER (side = 'ref') AS reference_turns, coalesce(list(text ORDER BY example_idx) FILTER (side = 'pred'), []) AS predicted_turns, greatest(count(*) FILTER (side = 'ref'), count(*) FILTER (side = 'pred')) AS n_turns FROM turns GROUP BY model_variant, generation_idx")
def reconstruct_conversations(spark, sf):
    return fidelity.reconstruct(B.pairs(spark, sf))


_ST = "words_mean words_std words_p10 words_p90 hedge_rate certainty_rate promise_rate hedge_surplus info_density max_categories role_confused_turns pushback_turns prior_belief_rate breadth_first frustration jargon".split()


@query(f"WITH {_STATS} SELECT model_variant, generation_idx, side, n_turns::INT AS n_turns, {', '.join(_ST)} FROM s2")
def pred_ref_stats(spark, sf):
    turns = fidelity.sides(B.pairs(spark, sf))
    return fidelity.turn_stats(turns, [*fidelity.KEY, "side"], B.PAIR_LEX).select(*fidelity.KEY, "side", "n_turns", *_ST)


@query(f"{_W} SELECT model_variant, generation_idx, turn_count_delta, {', '.join(f'delta_{d}' for d in fidelity.DELTAS)} FROM w")
def pred_ref_deltas(spark, sf):
    return _compared(spark, sf).select(*fidelity.KEY, "turn_count_delta", *[f"delta_{d}" for d in fidelity.DELTAS])


@query(f"{_W} SELECT model_variant, generation_idx, {', '.join(f'flag_{f}' for f in fidelity.FLAGS)}, fidelity_flag_count FROM w")
def fidelity_flags(spark, sf):
    return _compared(spark, sf).select(*fidelity.KEY, *[f"flag_{f}" for f in fidelity.FLAGS], "fidelity_flag_count")


def _rates(by: str) -> str:
    own = {"missed_pushback": "type_b", "wrong_belief_missing": "type_a", "dropout_implausible": "failure"}
    pct = lambda f: r(f"100 * avg(flag_{f}::INT)" + (f" FILTER (kind = '{own[f]}')" if f in own else ""), 1)
    return f"{_W} SELECT {by}, count(*) AS n, {', '.join(f'{mean_r(f'delta_{d}', 3)} AS delta_{d}' for d in fidelity.DELTAS)}, {', '.join(f'{pct(f)} AS pct_{f}' for f in fidelity.FLAGS)}, {r('avg(fidelity_flag_count)', 3)} AS mean_flags FROM w GROUP BY ALL"


@query(_rates("model_variant"))
def variant_flag_rates(spark, sf):
    return fidelity.rates(_compared(spark, sf), "model_variant")


@query(_rates("model_variant, kind AS conversation_type"))
def variant_type_breakdown(spark, sf):
    return fidelity.rates(_compared(spark, sf), "model_variant", "conversation_type")


@query(f"WITH {_ROWS}, {_RHO} SELECT * FROM rho")
def escalation_spearman(spark, sf):
    return fidelity.escalation(fidelity.sides(B.pairs(spark, sf)), [*fidelity.KEY, "side"], B.PAIR_LEX.frustration)


@query(f"WITH {_ROWS}, {_CON} SELECT * FROM con")
def self_contradiction(spark, sf):
    return fidelity.contradiction(fidelity.sides(B.pairs(spark, sf)), [*fidelity.KEY, "side"], B.MERCHANTS)


# ---- judge ----

_DIMS = judge.dimensions()


def _judged_sql() -> str:
    c = lambda k, m: f"(conv_id * {k}) % {m}"
    item = lambda d, i: f"""CASE WHEN {c(i + 1, 11)} = 0 THEN '' WHEN {c(i + 1, 13)} = 0 THEN '"{d}_score": "n/a", ' WHEN {c(i + 1, 17)} = 0 THEN '"{d}_score": null, ' ELSE '"{d}_score": ' || ({c(i + 2, 8)} - 1) || ', ' END"""
    dims = ("depth_first", "uncertainty", "info_drip", "pragmatic", "persona", "dropout_authenticity", "prior_belief_coherence", "error_catch_quality", "pushback_naturalness")
    body = "'{' || " + " || ".join(item(d, i) for i, d in enumerate(dims)) + """ || '"standout_issue": "x"}'"""
    val = lambda d: f"""CASE WHEN err THEN NULL WHEN NOT list_contains(json_keys(j), '{d}_score') THEN 1.0 WHEN try_cast(json_extract_string(j, '$.{d}_score') AS DOUBLE) IS NULL THEN 0.0 ELSE greatest(1.0, least(5.0, try_cast(json_extract_string(j, '$.{d}_score') AS DOUBLE))) END"""
    uses = lambda d: " OR ".join(f"dataset_type = '{t}'" for t, ws in judge.CORPUS_WEIGHTS.items() if d in ws)
    overall = "CASE dataset_type " + " ".join(f"WHEN '{t}' THEN 0.0::DOUBLE + " + " + ".join(f"{w}::DOUBLE * coalesce({d}_score, 0)" for d, w in ws.items()) for t, ws in judge.CORPUS_WEIGHTS.items()) + " END"
    return f"""jh AS (SELECT conv_id, dataset_type, emotional_state, communication_style, knowledge_level FROM ({B.HEADER_SQL})), j0 AS (SELECT *, {body} AS body FROM jh),
j1 AS (SELECT *, CASE WHEN conv_id % 19 = 3 THEN 'not json' WHEN conv_id % 23 = 5 THEN '{{"_parse_error": "x", "_raw": "y"}}' ELSE body END AS txt FROM j0),
j2 AS (SELECT *, CASE WHEN json_valid(txt) THEN txt::JSON END AS j, NOT json_valid(txt) OR (json_valid(txt) AND contains(txt, '_parse_error')) AS err FROM j1),
j3 AS (SELECT conv_id, dataset_type, emotional_state, communication_style, knowledge_level, err AS parse_error, {', '.join(f'CASE WHEN {uses(d)} THEN {val(d)} END::DOUBLE AS {d}_score' for d in _DIMS)} FROM j2),
js AS (SELECT *, CASE WHEN parse_error THEN 0.0 ELSE {r(overall, 3)} END AS overall_score FROM j3)"""


_J = _judged_sql()
_LONG = "jl AS (SELECT emotional_state, unnest([" + ", ".join(f"{{'o': {i}, 'd': '{d}', 'v': {d}_score}}" for i, d in enumerate(_DIMS)) + "]) AS x FROM js WHERE NOT parse_error)"
_BYA = f"{_J}, {_LONG}, jm AS (SELECT emotional_state, x.o AS ord, x.d AS dim, avg(x.v) AS mean, count(*) AS n FROM jl WHERE x.v > 0 GROUP BY ALL)"


def _scored(spark, sf):
    return judge.score(B.judged(spark, sf))


@query(f"WITH {_J} SELECT conv_id, dataset_type, parse_error, {', '.join(f'{d}_score' for d in _DIMS)}, overall_score FROM js")
def judge_scores(spark, sf):
    return _scored(spark, sf).select("conv_id", "dataset_type", "parse_error", *[f"{d}_score" for d in _DIMS], "overall_score")


@query(f"WITH {_BYA} SELECT emotional_state, dim, {r('mean', 3)} AS mean, n FROM jm")
def judge_by_attribute(spark, sf):
    return judge.by_attribute(_scored(spark, sf), "emotional_state").select("emotional_state", "dim", T.rounded(F.col("mean"), 3).alias("mean"), "n")


@query(f"WITH {_BYA}, o AS (SELECT *, row_number() OVER (PARTITION BY emotional_state ORDER BY mean, ord) AS lo, row_number() OVER (PARTITION BY emotional_state ORDER BY mean DESC, ord) AS hi FROM jm) SELECT emotional_state, max(dim) FILTER (lo = 1) AS weakest, max(dim) FILTER (hi = 1) AS strongest FROM o GROUP BY emotional_state")
def weakest_dimension(spark, sf):
    return judge.weakest_strongest(_scored(spark, sf), "emotional_state")


@query(f"WITH {_J} SELECT conv_id, dataset_type, overall_score FROM js WHERE NOT parse_error AND overall_score > 0 ORDER BY overall_score, dataset_type, conv_id LIMIT 10")
def judge_bottom_k(spark, sf):
    return judge.lowest(_scored(spark, sf), 10, "dataset_type", "conv_id").select("conv_id", "dataset_type", "overall_score")


@query(f"WITH {_J} SELECT conv_id, conv_id % 3 <> 0 AS cached, printf('conv_%s_%03d', dataset_type, conv_id) AS cache_key FROM js")
def judge_cache_join(spark, sf):
    cache = B.judged(spark, sf).where("conv_id % 3 <> 0")
    rows = judge.with_cache(B.judged(spark, sf).drop("raw_json"), cache, ["conv_id"])
    return rows.select("conv_id", "cached", judge.cache_key(F.col("dataset_type"), F.col("conv_id")).alias("cache_key"))


@query(f"WITH {_J} SELECT dataset_type, count(*) AS n, {mean_r('overall_score', 3)} AS mean, min(overall_score) AS min, max(overall_score) AS max, {r('stddev_pop(overall_score)', 3)} AS std, CASE WHEN {mean_r('overall_score', 3)} >= 3.5 THEN 'Good' WHEN {mean_r('overall_score', 3)} >= 2.5 THEN 'Moderate' ELSE 'Needs work' END AS label FROM js WHERE NOT parse_error GROUP BY dataset_type")
def judge_overall_by_type(spark, sf):
    s = _scored(spark, sf).where("NOT parse_error").groupBy("dataset_type").agg(F.count("*").alias("n"), T.mean_of(F.col("overall_score"), 3).alias("mean"), F.min("overall_score").alias("min"), F.max("overall_score").alias("max"), T.rounded(F.stddev_pop("overall_score"), 3).alias("std"))
    return s.withColumn("label", judge.quality_label(F.col("mean")))


@query(f"""WITH {B.EVALUATED_SQL}, {_J}, both_ AS (SELECT coalesce(e.hedge_rate, 0) - coalesce(e.certainty_rate, 0) AS x1, coalesce(e.facts1, 0)::DOUBLE AS x2, coalesce(e.breadth, FALSE)::INT::DOUBLE AS x3, js.uncertainty_score AS y1, js.info_drip_score AS y2, js.depth_first_score AS y3 FROM e JOIN js USING (conv_id) WHERE NOT parse_error),
p AS (SELECT unnest([{{'p': 'hedge_minus_certainty ~ uncertainty_score', 'x': {r('x1', 3)}, 'y': y1}}, {{'p': 'info_density_score ~ info_drip_score', 'x': {r('x2 / 3', 3)}, 'y': y2}}, {{'p': 'breadth_first_flag ~ depth_first_score', 'x': x3, 'y': y3}}]) AS z FROM both_),
g AS (SELECT z.p AS pair, count(*) AS n, CASE WHEN count(*) >= 4 THEN {r('CASE WHEN stddev_pop(z.x) * stddev_pop(z.y) > 0 THEN covar_pop(z.x, z.y) / (stddev_pop(z.x) * stddev_pop(z.y)) ELSE 0 END', 3)} END AS r FROM p WHERE z.x IS NOT NULL AND z.y IS NOT NULL GROUP BY z.p)
SELECT *, CASE WHEN abs(r) >= 0.5 THEN 'Strong' WHEN abs(r) >= 0.3 THEN 'Moderate' ELSE 'Weak' END || CASE WHEN r >= 0 THEN ' positive' ELSE ' negative' END AS label FROM g""")
def l1_l2_pearson(spark, sf):
    found = [("hedge_minus_certainty", "uncertainty_score"), ("info_density_score", "info_drip_score"), ("breadth_first_flag", "depth_first_score")]
    rules_ = B.evaluated(spark, sf).withColumn("breadth_first_flag", F.col("breadth_first_flag").cast("int"))
    return judge.correlations(rules_, _scored(spark, sf), ["conv_id"], found)


# ---- metrics ----


@query(f"WITH {_ROWS} SELECT model_variant, count(*) FILTER (generation_idx % 5 = 0) AS n_eos, {r('coalesce(avg((pred = ' + B.q('') + ')::INT::DOUBLE) FILTER (generation_idx % 5 = 0), 0)', 4)} AS eos_recall, {r('coalesce(avg((pred = ' + B.q('') + ')::INT::DOUBLE) FILTER (generation_idx % 5 <> 0), 0)', 4)} AS eos_false_positive FROM rows GROUP BY model_variant")
def eos_metrics(spark, sf):
    rows = B.pairs(spark, sf).select("model_variant", (F.pmod("generation_idx", F.lit(5)) == 0).alias("is_eos"), F.col("predicted_output").alias("predicted"))
    return metrics.eos_metrics(rows, "model_variant")


@query(f"""WITH {_ROWS}, w AS (SELECT model_variant, generation_idx, example_idx, list_distinct(list_filter(regexp_extract_all(lower(pred), '[a-z]+'), lambda x: length(x) > 3)) AS p, list_distinct(list_filter(regexp_extract_all(lower(ref), '[a-z]+'), lambda x: length(x) > 3)) AS q FROM rows),
z AS (SELECT *, len(list_intersect(p, q))::DOUBLE AS b FROM w), y AS (SELECT *, CASE WHEN len(p) = 0 AND len(q) = 0 THEN 1.0 WHEN len(p) = 0 THEN 0.0 ELSE b / len(p) END AS precision, CASE WHEN len(p) = 0 AND len(q) = 0 THEN 1.0 WHEN len(q) = 0 THEN 0.0 ELSE b / len(q) END AS recall FROM z)
SELECT model_variant, generation_idx, example_idx, precision, recall, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM y""")
def entity_prf(spark, sf):
    p = metrics.entity_prf(F.col("p"), F.col("q"))
    rows = B.pairs(spark, sf).select("model_variant", "generation_idx", "example_idx", T.keywords(F.col("predicted_output"), ("",)).alias("p"), T.keywords(F.col("expected_output"), ("",)).alias("q"))
    return rows.select("model_variant", "generation_idx", "example_idx", *[c.alias(n) for c, n in zip(p, ("precision", "recall", "f1"))])


_MODELS = "SELECT o_orderkey AS e, m, ((o_orderkey * (m + 3)) % 7)::DOUBLE AS v FROM orders, (VALUES (0), (1), (2)) AS k(m)"


def _scores(spark, sf):
    return parquet(spark, sf, "orders").select(F.col("o_orderkey").alias("e"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("m")).withColumn("v", F.pmod(F.col("e") * (F.col("m") + 3), F.lit(7)).cast("double")).withColumn("model", F.concat(F.lit("model_"), F.col("m").cast("string")))


@query(f"""WITH s AS ({_MODELS}) SELECT 'model_' || a.m AS model_a, 'model_' || b.m AS model_b, count(*) AS n_examples, {r('count(*) FILTER (a.v > b.v) / count(*)', 4)} AS a_win_rate, {r('count(*) FILTER (a.v < b.v) / count(*)', 4)} AS b_win_rate, {r('count(*) FILTER (a.v = b.v) / count(*)', 4)} AS tie_rate,
count(*) FILTER (a.v > b.v) AS a_wins, count(*) FILTER (a.v < b.v) AS b_wins, count(*) FILTER (a.v = b.v) AS ties, {r('avg(a.v)', 4)} AS mean_a, {r('avg(b.v)', 4)} AS mean_b FROM s a JOIN s b ON a.e = b.e AND a.m < b.m GROUP BY a.m, b.m""")
def pairwise_win_rates(spark, sf):
    return metrics.pairwise(_scores(spark, sf), "model", "e", "v").drop("wilcoxon_stat", "p_value", "significant")


@query(f"""WITH s AS ({_MODELS}), d AS (SELECT a.m AS ma, b.m AS mb, a.v - b.v AS d, abs(a.v - b.v) AS ad FROM s a JOIN s b ON a.e = b.e AND a.m < b.m WHERE a.v <> b.v),
k AS (SELECT *, rank() OVER (PARTITION BY ma, mb ORDER BY ad) + (count(*) OVER (PARTITION BY ma, mb, ad) - 1) / 2 AS rk FROM d)
SELECT 'model_' || ma AS model_a, 'model_' || mb AS model_b, count(*) AS n_used, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS wilcoxon_stat FROM k GROUP BY ma, mb""")
def wilcoxon_statistic(spark, sf):
    s = _scores(spark, sf)
    both = s.select("e", F.col("model").alias("model_a"), F.col("v").alias("va")).join(s.select("e", F.col("model").alias("model_b"), F.col("v").alias("vb")), "e").where("model_a < model_b")
    return stats.wilcoxon(both, ["model_a", "model_b"], "va", "vb").drop("p_value")


@query(f"""WITH {_ROWS}, b AS (SELECT generation_idx % 3 AS size, example_idx, max(length(pred)) FILTER (model_variant LIKE 'base%') AS base_v, max(length(pred)) FILTER (model_variant LIKE 'lora%') AS lora_v FROM rows GROUP BY ALL) SELECT * FROM b""")
def full_outer_pairs(spark, sf):
    rows = B.pairs(spark, sf).select(F.pmod("generation_idx", F.lit(3)).alias("size"), "example_idx", F.substring_index("model_variant", "_", 1).alias("role"), F.length("predicted_output").alias("v"))
    return metrics.side_by_side(rows, "size", "example_idx", "role", "v")


@query("""SELECT doc_id, CASE WHEN contains(text, '<eos>') THEN 0.4 ELSE 0.0 END + CASE WHEN n BETWEEN 20 AND 200 THEN 0.4 WHEN n < 20 THEN 0.1 ELSE 0.0 END + CASE WHEN q >= 0.8 THEN 0.2 WHEN q >= 0.5 THEN 0.1 ELSE 0.0 END AS reward FROM (
SELECT doc_id, text, len(w) AS n, CASE WHEN len(w) < 3 THEN 1.0 ELSE len(list_distinct(g))::DOUBLE / len(g) END AS q FROM (SELECT doc_id, text, w, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) AS g FROM (SELECT doc_id, text, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents)))""".replace("\\\\", "\\"))
def trigram_reward(spark, sf):
    d = parquet(spark, sf, "documents")
    return d.select("doc_id", metrics.rule_reward(F.col("text"), T.word_count(F.col("text"))).alias("reward"))


@query(f"""WITH {_W} SELECT model_variant, CASE WHEN grouping(knowledge_level) = 0 THEN 'knowledge_level' WHEN grouping(kind) = 0 THEN 'conversation_type' ELSE 'overall' END AS slice_dim,
CASE WHEN grouping(knowledge_level) = 0 THEN knowledge_level WHEN grouping(kind) = 0 THEN kind ELSE 'all' END AS slice_val, count(*) AS n, {mean_r('delta_words', 3)} AS delta_words FROM w GROUP BY GROUPING SETS ((model_variant, knowledge_level), (model_variant, kind), (model_variant))""".replace("WITH WITH", "WITH"))
def slice_grouping_sets(spark, sf):
    return split.slices(_compared(spark, sf), ["knowledge_level", "conversation_type"], {"n": F.count("*"), "delta_words": T.mean_of(F.col("delta_words"), 3)}, by=["model_variant"])


@query(f"""WITH {_W}, v AS (SELECT model_variant, {mean_r('delta_words', 3)} AS m FROM w GROUP BY 1) SELECT split_part(a.model_variant, '_', 2) AS model_size, a.m AS base, b.m AS lora, {r('b.m - a.m', 3)} AS delta FROM v a JOIN v b ON a.model_variant LIKE 'base%' AND b.model_variant LIKE 'lora%' AND split_part(a.model_variant, '_', 2) = split_part(b.model_variant, '_', 2)""".replace("WITH WITH", "WITH"))
def size_deltas(spark, sf):
    return metrics.size_delta(_compared(spark, sf).groupBy("model_variant").agg(T.mean_of(F.col("delta_words"), 3).alias("m")), "m")
