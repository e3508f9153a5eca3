"""Driver queries over scans, projections, rollups and report frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions import text as T
from turnmill.operators import fidelity, frames, judge, metrics, rules, training
from turnmill.plans import base as B
from turnmill.plans import fidelity_queries as P
from turnmill.plans.base import mean_r, r
from turnmill.sources import parse, scans, sinks
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


def _mod(k: int, *columns: str):
    return F.pmod(sum((F.col(c) for c in columns[1:]), F.col(columns[0])), F.lit(k))


def _pick(values: list, k):
    return F.get(F.array(*[F.lit(v) for v in values]), k.cast("int"))


def _pick_sql(values: list, k: str) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else B.q(v)}" for i, v in enumerate(values)) + " END"


# ---- scans ----

#: Lines that are whole, blank, cut off or hold a stray backslash.
_LINES = r"""l AS (SELECT *, (conv_id + turn) % 7 AS k FROM conversations), s AS (
SELECT conv_id::VARCHAR AS file, turn AS line_no, CASE WHEN k = 2 THEN 'a\q' || conv_id ELSE text END AS input, CASE WHEN k = 2 THEN 'x' ELSE text || '<eos>' END AS output,
CASE WHEN k <> 2 AND k <> 3 THEN conv_id END AS generation_idx, k <> 2 AND k <> 3 AS has_meta, k = 4 AS has_probing_type FROM l WHERE k > 1)"""


def _scanned(spark, sf):
    k = _mod(7, "conv_id", "turn")
    probing = F.when(k == 4, "inadvertent")
    meta = F.when(k != 3, F.struct(F.col("conv_id").alias("generation_idx"), probing.alias("probing_type")))
    whole = F.to_json(F.struct(F.col("text").alias("input"), F.concat("text", F.lit("<eos>")).alias("output"), meta.alias("_meta")))
    line = F.when(k == 0, "  ").when(k == 1, F.substring(whole, 1, 9)).when(k == 2, F.concat(F.lit('{"input": "a\\q'), F.col("conv_id").cast("string"), F.lit('", "output": "x"}'))).otherwise(whole)
    return scans.training_lines(parquet(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line_no"), line.alias("line")))


@query(f"WITH {_LINES} SELECT * FROM s")
def training_scan(spark, sf):
    return _scanned(spark, sf).drop("_meta")


@query(f"WITH {_LINES} SELECT input AS prompt, coalesce(output, '') AS reference, coalesce(generation_idx, -1) AS generation_idx FROM s WHERE input IS NOT NULL")
def rl_projection(spark, sf):
    return scans.rl_rows(_scanned(spark, sf))


@query(f"WITH {_LINES} SELECT count(DISTINCT generation_idx) AS conversations FROM s")
def distinct_conversations(spark, sf):
    return frames.distinct_conversations(_scanned(spark, sf))


_SHOTS = "s AS (SELECT conv_id, turn, trim(text) AS example FROM conversations WHERE turn % 3 = 1 AND text IS NOT NULL)"


def _shots(spark, sf):
    body = F.concat(F.lit("Intro.\nConversation so far:"), F.col("text"), F.lit("If your goal is met, stop. If your goal is not, go on."))
    rows = parquet(spark, sf, "conversations").select("conv_id", "turn", F.when(_mod(3, "turn") != 0, body).otherwise(F.col("text")).alias("input"), F.when(_mod(3, "turn") != 2, " <eos>").otherwise("x").alias("output"))
    return scans.few_shot_examples(rows)


@query(f"WITH {_SHOTS} SELECT example, count(*) AS n FROM s GROUP BY example")
def few_shot_examples(spark, sf):
    return _shots(spark, sf).groupBy("example").agg(F.count("*").alias("n"))


@query("SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY md5('42-' || conv_id), conv_id LIMIT 3")
def few_shot_sample(spark, sf):
    return frames.few_shot_sample(parquet(spark, sf, "conversations").select("conv_id").distinct(), "conv_id")


_DUMP = ("knowledge_level", "emotional_state", "communication_style", "goal_clarity", "certainty", "merchant", "amount", "transaction_date")


def _dumped(spark, sf):
    heads, turns = B.headers(spark, sf), B.turns(spark, sf)
    text = sinks.dump_text(heads.select("dataset_type", "conv_id", *_DUMP), turns.join(heads.select("conv_id", "dataset_type"), "conv_id"), ["dataset_type", "conv_id"], _DUMP[:4], _DUMP[4:])
    lines = text.select("dataset_type", F.col("conv_id").cast("string").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return parse.parse_dumps(lines)


@query(f"WITH h AS ({B.HEADER_SQL}) SELECT dataset_type, conv_id::INT AS conv_idx, {', '.join(_DUMP)} FROM h WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role IN ('user', 'assistant'))")
def dump_headers(spark, sf):
    return _dumped(spark, sf)[0].select("dataset_type", "conv_idx", *_DUMP)


_RAW_BOOL = ["True", " yes", "1", "false", "", None, "x"]
_RAW_NUMBER = ["12", "3.75", "", "n/a", None, "-2"]


@query(f"""WITH s AS (SELECT doc_id, {_pick_sql(_RAW_NUMBER, 'doc_id % 6')} AS score, {_pick_sql(_RAW_NUMBER, '(doc_id + 2) % 6')} AS turns, {_pick_sql(_RAW_BOOL, 'doc_id % 7')} AS flag FROM documents)
SELECT doc_id, coalesce(try_cast(score AS DOUBLE), 0) AS score, coalesce(trunc(try_cast(turns AS DOUBLE))::INT, 0) AS turns, coalesce(lower(trim(flag)) IN ('true', '1', 'yes'), FALSE) AS flag FROM s""")
def typed_columns(spark, sf):
    k = lambda m, add=0: F.pmod(F.col("doc_id") + add, F.lit(m))
    raw = parquet(spark, sf, "documents").select("doc_id", _pick(_RAW_NUMBER, k(6)).alias("score"), _pick(_RAW_NUMBER, k(6, 2)).alias("turns"), _pick(_RAW_BOOL, k(7)).alias("flag"))
    return scans.typed(raw, doubles=("score",), ints=("turns",), bools=("flag",))


@query(f"""WITH h AS ({B.HEADER_SQL}) SELECT CASE WHEN conv_id % 3 = 1 THEN 'success' ELSE dataset_type END AS dataset_type, conv_id::INT AS conv_idx, conv_id::VARCHAR AS raw_json FROM h WHERE conv_id % 3 <> 2""")
def judge_cache_names(spark, sf):
    key = F.when(_mod(3, "conv_id") == 0, judge.cache_key(F.col("dataset_type"), F.col("conv_id"))).when(_mod(3, "conv_id") == 1, F.format_string("conv_%03d", F.col("conv_id").cast("int"))).otherwise("notes")
    return scans.cache_entries(B.headers(spark, sf).select(F.concat(key, F.lit(".json")).alias("name"), F.col("conv_id").cast("string").alias("raw_json")))


_LINE_KIND = "(conv_id + turn) % 4"


@query(f"""WITH l AS (SELECT conv_id, turn, {_LINE_KIND} AS k, trim(text) AS body FROM conversations), m AS (
SELECT *, CASE k WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN 'assistant' END AS who FROM l), p AS (
SELECT *, lag(who IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM m), o AS (
SELECT *, coalesce(who = 'user' OR who = 'assistant' AND prev IS DISTINCT FROM 'assistant', FALSE) AS opens FROM p), n AS (
SELECT *, sum(opens::INT) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS msg_idx FROM o)
SELECT conv_id, msg_idx::BIGINT AS msg_idx, arg_min(who, turn) AS role, coalesce(string_agg(body, ' ' ORDER BY turn) FILTER (body <> ''), '') AS content FROM n WHERE msg_idx >= 0 GROUP BY conv_id, msg_idx""")
def generated_messages(spark, sf):
    rows = parquet(spark, sf, "conversations")
    lines = rows.select("conv_id", F.col("turn").alias("line_no"), F.concat(_pick(["Customer: ", "Agent:  ", "Agent:", ""], _mod(4, "conv_id", "turn")), "text").alias("line"))
    return training.messages_from_lines(lines, ["conv_id"])


# ---- projections ----

@query("SELECT conv_id, turn, text FROM conversations WHERE role <> 'system'")
def strip_speaker(spark, sf):
    rows = parquet(spark, sf, "conversations").where("role <> 'system'")
    return rows.select("conv_id", "turn", T.strip_speaker(F.concat(_pick(["customer:", "CUSTOMER:", ""], _mod(3, "turn")), "text"), "customer").alias("text"))


_PROBING, _GOAL = ["inadvertent", "adversarial", None, "other", ""], ["true", "false", None]


@query(f"""WITH s AS (SELECT doc_id, {_pick_sql(_PROBING, 'doc_id % 5')} AS p, {_pick_sql(_GOAL, 'doc_id % 3')} AS g FROM documents)
SELECT doc_id, CASE WHEN p = 'inadvertent' THEN 'type_a' WHEN p = 'adversarial' THEN 'type_b' WHEN g = 'false' THEN 'failure' ELSE 'success' END AS dataset_type FROM s""")
def detect_type(spark, sf):
    k = lambda m: F.pmod("doc_id", F.lit(m))
    return parquet(spark, sf, "documents").select("doc_id", training.dataset_type(_pick(_PROBING, k(5)), _pick(_GOAL, k(3)).cast("boolean")).alias("dataset_type"))


_MODES = ["None", None, "impatience", "", "None", "None", "None"]


@query(f"""WITH s AS (SELECT doc_id, {_pick_sql(_MODES, 'doc_id % 7')} AS m, doc_id % 31 * 100 AS g FROM documents)
SELECT doc_id, CASE WHEN m IS NOT NULL AND m NOT IN ('', 'None') THEN 'failure' WHEN g >= 2000 THEN 'type_b' WHEN g >= 1000 THEN 'type_a' ELSE 'success' END AS conversation_type FROM s""")
def prediction_type(spark, sf):
    meta = F.struct(_pick(_MODES, F.pmod("doc_id", F.lit(7))).alias("failure_mode"), F.lit(None).cast("string").alias("probing_type"))
    rows = parquet(spark, sf, "documents").select("doc_id", meta.alias("meta"), (F.pmod("doc_id", F.lit(31)) * 100).alias("g"))
    return rows.select("doc_id", fidelity.conversation_type(F.col("meta"), F.col("g"), ((2000, "type_b"), (1000, "type_a"))).alias("conversation_type"))


@query(f"WITH {P._ROWS} SELECT model_variant, split_part(model_variant, '_', 2) AS model_size, model_variant LIKE 'lora!_%' ESCAPE '!' AS is_lora, count(*) AS n FROM rows GROUP BY model_variant")
def variant_parts(spark, sf):
    v = F.col("model_variant")
    return B.pairs(spark, sf).groupBy(v).agg(F.count("*").alias("n")).select(v, fidelity.variant_size(v).alias("model_size"), fidelity.is_adapted(v).alias("is_lora"), "n")


@query("""SELECT conv_id, turn, turn % 4 = 1 AS is_eos, CASE WHEN turn % 4 = 1 THEN '' ELSE trim(text) END AS expected FROM conversations WHERE text IS NOT NULL""")
def clean_outputs(spark, sf):
    rows = parquet(spark, sf, "conversations").where("text IS NOT NULL")
    out = rows.withColumn("o", F.when(_mod(4, "turn") == 1, " <eos> ").when(_mod(4, "turn") == 2, F.concat("text", F.lit("<eos>"))).when(_mod(4, "turn") == 3, F.concat(F.lit("<eos>"), "text", F.lit(" <eos>"))).otherwise(F.col("text")))
    return out.select("conv_id", "turn", (F.trim("o") == "<eos>").alias("is_eos"), T.clean_expected(F.col("o")).alias("expected"))


_CERTAINTY, _FULL, _WANT, _BEFORE = ["certain_fraud", "uncertain"], ["full", "partial", "minimal"], ["refund_and_card", "investigation", "hold"], ["first_contact", "tried_merchant", "follow_up", "else"]


def _clauses(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {B.q(k)} THEN {B.q(v)}" for k, v in values.items()) + " END"


_FILL = lambda x: f"replace(replace(replace({x}, '{{amount}}', amount), '{{merchant}}', merchant), '{{date}}', transaction_date)"


@query(f"""WITH h AS ({B.HEADER_SQL}), s AS (SELECT conv_id, amount, merchant, transaction_date, certainty, {_pick_sql(_FULL, 'conv_id % 3')} AS i, {_pick_sql(_WANT, '(conv_id + 1) % 3')} AS w, {_pick_sql(_BEFORE, 'conv_id % 4')} AS p FROM h)
SELECT conv_id, 'You are a user chatting with an assistant language model to ' || {_clauses('certainty', frames.ACTIONS)} || ' ' || {_FILL(_clauses('i', frames.DETAILS))} || ' and ' || {_clauses('w', frames.RESOLUTIONS)} || '.' || {_FILL(_clauses('p', frames.PRIOR))} AS intent FROM s""")
def intent_summary(spark, sf):
    c = F.col
    return B.headers(spark, sf).select("conv_id", frames.intent_summary(c("certainty"), _pick(_FULL, _mod(3, "conv_id")), _pick(_WANT, F.pmod(c("conv_id") + 1, F.lit(3))), _pick(_BEFORE, _mod(4, "conv_id")), c("amount"), c("merchant"), c("transaction_date")).alias("intent"))


@query(f"""WITH {P._ROWS}, o AS (SELECT model_variant, generation_idx, side, {B.has('lc', B.PUSHBACK)} AS push, row_number() OVER (PARTITION BY model_variant, generation_idx, side ORDER BY example_idx) - 1 AS i FROM turns)
SELECT model_variant, generation_idx, side, coalesce(min(i) FILTER (push), -1)::INT AS first_pushback, (count(*) - 1)::INT AS dropout_idx FROM o GROUP BY model_variant, generation_idx, side""")
def turn_positions(spark, sf):
    st = fidelity.turn_stats(fidelity.sides(B.pairs(spark, sf)), [*fidelity.KEY, "side"], B.PAIR_LEX)
    return st.select(*fidelity.KEY, "side", "first_pushback", "dropout_idx")


@query(f"""WITH h AS ({B.HEADER_SQL}), t AS ({B.TURN_SQL}), s AS (SELECT conv_id, turn_idx, w, {B.hits('lc', B.HEDGE)} AS hedge FROM t WHERE cust)
SELECT conv_id, turn_idx, CASE WHEN dataset_type = 'type_b' THEN NULL WHEN communication_style = 'terse' THEN w <= 12 WHEN communication_style = 'direct' THEN w <= 20 WHEN communication_style = 'indirect' THEN w >= 8 AND hedge > 0 ELSE TRUE END AS compliant FROM s JOIN h USING (conv_id)""")
def style_compliance(spark, sf):
    turns = B.turns(spark, sf).where("speaker = 'Customer'").withColumns({"communication_style": B._cycle("communication_style"), "dataset_type": B._cycle("dataset_type")})
    return turns.select("conv_id", "turn_idx", metrics.style_compliant(F.col("communication_style"), T.word_count(F.col("text")), T.hits(F.lower("text"), B.HEDGE), F.col("dataset_type")).alias("compliant"))


@query("""SELECT doc_id, p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars, coalesce(printf('%.1f', floor(100 * p * 10 + 0.5) / 10) || '%', 'N/A') AS pct,
replace(translate(left(text, 80), chr(10) || chr(13), '  '), '|', '\\|') AS cell FROM (SELECT doc_id, text, n_chars % 64 / 1024.0::DOUBLE AS p FROM documents)""")
def display_formats(spark, sf):
    p = F.pmod("n_chars", F.lit(64)) / F.lit(1024.0)
    return parquet(spark, sf, "documents").select("doc_id", p.alias("p"), T.stars(p).alias("stars"), frames.percent(p).alias("pct"), frames.shown(F.col("text"), 80).alias("cell"))


# ---- rollups ----

@query(f"""WITH s AS (SELECT {B._cycle_sql('failure_mode')} AS failure_mode, turn % 4 = 1 AS e FROM conversations)
SELECT NULL::VARCHAR AS failure_mode, count(*) AS entries, count(*) FILTER (e) AS ended FROM s UNION ALL SELECT failure_mode, count(*), count(*) FILTER (e) FROM s WHERE failure_mode <> '' GROUP BY failure_mode""")
def tail_stats(spark, sf):
    return frames.tail_stats(parquet(spark, sf, "conversations").select(B._cycle("failure_mode").alias("failure_mode"), F.when(_mod(4, "turn") == 1, "<eos>").otherwise(F.col("text")).alias("output")))


@query(f"WITH {P._ROWS} SELECT model_variant, generation_idx FROM turns GROUP BY model_variant, generation_idx HAVING count(*) FILTER (side = 'pred') > 0 AND count(*) FILTER (side = 'ref') > 0")
def judgeable_conversations(spark, sf):
    return frames.judgeable(fidelity.reconstruct(B.pairs(spark, sf))).select(*fidelity.KEY)


@query(f"WITH {P._ROWS} SELECT model_variant, count(*) AS n FROM rows WHERE model_variant LIKE 'lora%' OR NOT EXISTS (SELECT 1 FROM rows WHERE model_variant LIKE 'lora%') GROUP BY model_variant")
def adapted_or_all(spark, sf):
    rows = B.pairs(spark, sf).select("model_variant").withColumn("is_lora", fidelity.is_adapted(F.col("model_variant")))
    return frames.adapted_or_all(rows).groupBy("model_variant").agg(F.count("*").alias("n"))


@query(f"WITH {P._ROWS} SELECT model_variant, generation_idx, example_idx FROM rows ORDER BY model_variant, generation_idx::VARCHAR, example_idx LIMIT 25")
def first_examples(spark, sf):
    return frames.first_k(B.pairs(spark, sf).select(*fidelity.KEY, "example_idx"), 25, "model_variant", F.col("generation_idx").cast("string"), "example_idx")


@query(f"""WITH h AS ({B.HEADER_SQL}), s AS (SELECT emotional_state, conv_id, row_number() OVER (PARTITION BY emotional_state ORDER BY conv_id)::INT AS place, count(*) OVER (PARTITION BY emotional_state) AS n FROM h)
SELECT emotional_state, conv_id, place, greatest(n - 20, 0) AS more FROM s WHERE place <= 20""")
def capped_examples(spark, sf):
    return frames.examples(B.headers(spark, sf).select("emotional_state", "conv_id"), "emotional_state", "conv_id")


@query(f"WITH h AS ({B.HEADER_SQL}) SELECT knowledge_level, CASE knowledge_level WHEN 'novice' THEN 0 WHEN 'intermediate' THEN 1 WHEN 'expert' THEN 2 ELSE 3 END AS place, count(*) AS n FROM h GROUP BY ALL ORDER BY place")
def ordered_levels(spark, sf):
    counts = B.headers(spark, sf).groupBy("knowledge_level").agg(F.count("*").alias("n"))
    return counts.select("knowledge_level", frames.ordinal(F.col("knowledge_level"), frames.LEVELS).alias("place"), "n").orderBy("place")


_CELLS = ["0.5", "", "None", "0.125", "nan", "n/a", None, "-0.25", "2"]
_MEANS = ("style_compliance_std", "style_compliance_min", "self_bleu", "hedge_rate_correlation", "length_trajectory_correlation", "hedge_rate_delta", "judge_mean")
_BY_TYPE = {"type_b": ("pushback_turns_pred", "pushback_missed"), "type_a": ("prior_belief_turns_pred",)}
_METRIC_COLUMNS = (*_MEANS, *(c for cs in _BY_TYPE.values() for c in cs), "n_role_confused_turns")
_NUM = lambda c: f"CASE WHEN NOT isnan(try_cast({c} AS DOUBLE)) THEN try_cast({c} AS DOUBLE) END"


def _metric_sql() -> str:
    out = [f"{mean_r(_NUM(c), 3)} AS {c}, count({_NUM(c)}) AS {c}_n" for c in _MEANS]
    out += [f"{mean_r(f'CASE WHEN kind = {B.q(t)} THEN {_NUM(c)} END', 3)} AS {c}, count(*) FILTER (kind = {B.q(t)}) AS {c}_n" for t, cs in _BY_TYPE.items() for c in cs]
    cells = ", ".join(f"{_pick_sql(_CELLS, f'(conv_id + {i}) % 9')} AS {c}" for i, c in enumerate(_METRIC_COLUMNS))
    return f"WITH h AS ({B.HEADER_SQL}), s AS (SELECT {P._VARIANT} AS model_variant, dataset_type AS kind, {cells} FROM h) SELECT model_variant, count(*) AS n_conversations, sum(floor({_NUM('n_role_confused_turns')}))::BIGINT AS total_role_confused, {', '.join(out)} FROM s GROUP BY model_variant"


@query(_metric_sql())
def conversation_metrics(spark, sf):
    variant = _pick([f"{k}_{s}" for s in ("4b", "12b", "27b") for k in ("base", "lora")], _mod(6, "conv_id"))
    cells = {c: _pick(_CELLS, F.pmod(F.col("conv_id") + i, F.lit(9))) for i, c in enumerate(_METRIC_COLUMNS)}
    rows = B.headers(spark, sf).select("conv_id", variant.alias("model_variant"), F.col("dataset_type").alias("conversation_type")).withColumns(cells)
    return frames.conversation_metrics(rows, _MEANS, _BY_TYPE)


_SLICED = f"""h AS ({B.HEADER_SQL}), v AS (SELECT h.*, {P._VARIANT} AS model_variant, conv_id * conv_id % 97 / 100 AS value FROM h), cells AS (
{' UNION ALL '.join(f"SELECT model_variant, '{d}' AS slice_dim, {d} AS slice_val, {mean_r('value', 2)} AS value FROM v GROUP BY model_variant, {d}" for d in ('knowledge_level', 'emotional_state', 'goal_clarity'))})"""


@query(f"""WITH {_SLICED}, m AS (SELECT slice_dim, slice_val, {mean_r('value', 3)} AS m FROM cells GROUP BY slice_dim, slice_val), e AS (
SELECT slice_dim, first(slice_val ORDER BY m DESC, slice_val) AS easiest, max(m) AS easiest_mean, first(slice_val ORDER BY m, slice_val) AS hardest, min(m) AS hardest_mean FROM m GROUP BY slice_dim) SELECT * FROM e WHERE easiest <> hardest""")
def slice_extremes(spark, sf):
    dims = ("knowledge_level", "emotional_state", "goal_clarity")
    variant = _pick([f"{k}_{s}" for s in ("4b", "12b", "27b") for k in ("base", "lora")], _mod(6, "conv_id"))
    rows = B.headers(spark, sf).select(variant.alias("model_variant"), (F.pmod(F.col("conv_id") * F.col("conv_id"), F.lit(97)) / 100).alias("value"), F.inline(F.array(*[F.struct(F.lit(d).alias("slice_dim"), F.col(d).alias("slice_val")) for d in dims])))
    return frames.extremes(rows.groupBy("model_variant", "slice_dim", "slice_val").agg(T.mean_of(F.col("value"), 2).alias("value")))


_OVERALL = f"o AS (SELECT {P._VARIANT.replace('conv_id', 'v')} AS model_variant, {_pick_sql(['', 'nan', '0.8'], 'v % 3')} AS mean_bertscore_f1, {_pick_sql(['None', '0.4'], 'v % 2')} AS mean_bleurt, '0.3' AS mean_meteor, '0.2' AS mean_bleu, v * v % 7 / 8 AS mean_entity_precision, v % 4 / 4 AS mean_entity_recall FROM range(6) t(v))"


def _overall(spark):
    v = F.col("id")
    variant = _pick([f"{k}_{s}" for s in ("4b", "12b", "27b") for k in ("base", "lora")], v)
    return spark.range(6).select(
        variant.alias("model_variant"), _pick(["", "nan", "0.8"], v % 3).alias("mean_bertscore_f1"), _pick(["None", "0.4"], v % 2).alias("mean_bleurt"), F.lit("0.3").alias("mean_meteor"), F.lit("0.2").alias("mean_bleu"),
        (v * v % 7 / 8).alias("mean_entity_precision"), (v % 4 / 4).alias("mean_entity_recall"),
    )


@query(f"WITH {_OVERALL}, f AS (SELECT * FROM o ORDER BY model_variant LIMIT 1) SELECT CASE WHEN {_NUM('mean_bertscore_f1')} IS NOT NULL THEN 'mean_bertscore_f1' WHEN {_NUM('mean_bleurt')} IS NOT NULL THEN 'mean_bleurt' ELSE 'mean_meteor' END AS metric, CASE WHEN {_NUM('mean_bertscore_f1')} IS NOT NULL THEN 'BERTScore F1' WHEN {_NUM('mean_bleurt')} IS NOT NULL THEN 'BLEURT' ELSE 'METEOR' END AS name FROM f")
def primary_metric(spark, sf):
    return frames.primary_metric(_overall(spark))


@query(f"WITH {_OVERALL} SELECT model_variant, mean_entity_precision, mean_entity_recall, CASE WHEN mean_entity_precision < mean_entity_recall THEN 'hallucinates entities' ELSE 'drops entities' END AS note FROM o WHERE model_variant LIKE 'lora%' AND abs(mean_entity_precision - mean_entity_recall) > 0.05")
def entity_notes(spark, sf):
    return frames.entity_notes(_overall(spark)).select("model_variant", "mean_entity_precision", "mean_entity_recall", "note")


@query(f"WITH {B.EVALUATED_SQL} SELECT code, count(*) AS conversations, {r('100.0 * count(*) / (SELECT count(*) FROM e)', 1)} AS pct FROM (SELECT unnest(warnings) AS code FROM e) GROUP BY code")
def warning_overview(spark, sf):
    return frames.warning_overview(B.evaluated(spark, sf))


@query(f"WITH {B.EVALUATED_SQL} SELECT goal_clarity, facts1 AS facts_in_turn1, count(*) AS n FROM e WHERE n0 > 0 GROUP BY ALL")
def info_density_by_goal(spark, sf):
    return B.evaluated(spark, sf).where("num_customer_turns > 0").groupBy("goal_clarity", "facts_in_turn1").agg(F.count("*").alias("n"))


@query(f"WITH h AS ({B.HEADER_SQL}) SELECT 'failure modes present' AS name, count(DISTINCT failure_mode) FILTER (failure_mode <> '') >= 5 AS passed, (count(DISTINCT failure_mode) FILTER (failure_mode <> ''))::VARCHAR AS detail FROM h")
def modes_present(spark, sf):
    return frames.modes_present(B.headers(spark, sf), least=5)


@query(f"WITH h AS ({B.HEADER_SQL}), s AS (SELECT emotional_state, (conv_id % 5 - 2) / 8 AS x FROM h) SELECT emotional_state, coalesce({mean_r('CASE WHEN x <> 0 THEN x END', 3)}, 0) AS mean FROM s GROUP BY emotional_state")
def nonzero_means(spark, sf):
    x = (_mod(5, "conv_id") - 2) / 8
    return B.headers(spark, sf).groupBy("emotional_state").agg(frames.nonzero_mean(x).alias("mean"))


# ---- judge frames ----

_BAND = "CASE WHEN overall_score >= 4 THEN 'publish' WHEN overall_score >= 3 THEN 'spot-check' WHEN overall_score >= 2 THEN 'review' ELSE 'regenerate' END"
_CORE = ("depth_first", "uncertainty", "info_drip", "pragmatic", "persona")
_ALL_DIMS = judge.dimensions()


@query(f"WITH {P._J} SELECT conv_id, overall_score, {_BAND} AS band FROM js WHERE NOT parse_error")
def judge_action_bands(spark, sf):
    return P._scored(spark, sf).where("NOT parse_error").select("conv_id", "overall_score", frames.action_band(F.col("overall_score")).alias("band"))


@query(f"""WITH {P._J}, d AS ({' UNION ALL '.join(f"SELECT '{d}' AS dim, {d}_score AS v FROM js WHERE NOT parse_error AND {d}_score > 0" for d in _ALL_DIMS)})
SELECT dim, count(*) AS n, {mean_r('v', 3)} AS mean, min(v) AS min, max(v) AS max, {r('stddev_pop(v)', 3)} AS std, {r('quantile_cont(v, 0.25)', 3)} AS q1, {r('quantile_cont(v, 0.5)', 3)} AS median, {r('quantile_cont(v, 0.75)', 3)} AS q3 FROM d GROUP BY dim""")
def judge_distribution(spark, sf):
    return frames.score_distribution(judge.long_scores(P._scored(spark, sf)))


@query(f"WITH {P._J} SELECT conv_id, {r('CASE WHEN parse_error THEN 0 ELSE (' + ' + '.join(f'coalesce({d}_score, 0)' for d in _CORE) + ') / 14 END', 4)} AS judge_reward, {r('0.7 * CASE WHEN parse_error THEN 0 ELSE (' + ' + '.join(f'coalesce({d}_score, 0)' for d in _CORE) + ') / 14 END + 0.3 * (conv_id % 5 / 5)', 4)} AS reward FROM js")
def composite_reward(spark, sf):
    score = metrics.judge_reward([f"{d}_score" for d in _CORE], failed="parse_error")
    return P._scored(spark, sf).select("conv_id", T.rounded(score, 4).alias("judge_reward"), T.rounded(metrics.composite_reward(score, _mod(5, "conv_id") / 5), 4).alias("reward"))
