"""Rules, parsers, splits and statistics on hand-written cases, and every query against its SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY, against_sql
from turnmill.functions import lexicons as L
from turnmill.functions import stats
from turnmill.functions import text as T
from turnmill.operators import frames, gate, judge, metrics, rules, split, training
from turnmill.plans import base, registry
from turnmill.sources import parse, scans, sinks


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    against_sql(spark, registry.QUERIES[name], registry.SQL[name], TINY)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


#: text, words, hedge, certainty, mild, strong, jargon, concern categories, pushback
PHRASES = [
    ("I'm not sure, maybe it was me", 7, 3, 0, [], [], [], 0, 0), ("I'm not 100% certain", 4, 1, 1, [], [], [], 0, 0), ("Definitely. No doubt about it, absolutely", 6, 0, 3, [], [], [], 0, 0),
    ("there is an issue with my card", 7, 0, 0, [], ["sue"], [], 0, 0), ("I was looking at my statement", 6, 0, 0, ["look"], [], [], 0, 0), ("the mighty store charged me", 5, 1, 0, [], [], [], 0, 0),
    ("cancel the card and refund the fraud charge, how long will it take", 13, 0, 0, [], [], [], 4, 0), ("is that provisional credit or a chargeback", 7, 0, 0, [], [], ["provisional credit", "chargeback"], 1, 0),
    ("Actually, are you sure? I read it is 90 days", 10, 0, 0, [], [], [], 0, 3), ("", 0, 0, 0, [], [], [], 0, 0), ("100%", 1, 0, 1, [], [], [], 0, 0),
]


def test_phrases(spark):
    lc = F.lower("t")
    found = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PHRASES)], "i int, t string").orderBy("i").select(
        "t", T.word_count(F.col("t")), T.hits(lc, L.HEDGE), T.hits(lc, L.CERTAINTY), T.matched(lc, L.MILD), T.matched(lc, L.STRONG), T.matched(lc, L.JARGON), T.categories(lc, L.CONCERNS), T.hits(lc, L.RULE_PUSHBACK)
    )
    assert [tuple(r) for r in found.collect()] == PHRASES


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(T.rounded(F.lit(v), k)) for v, k in ((0.25, 1), (-0.25, 1), (2.5, 0))] == [0.3, -0.3, 3.0]
    assert one(T.day_of_year(F.lit("March 4"))) == 64 and one(T.day_of_year(F.lit("August 14th"))) == 0 and one(T.day_of_year(F.lit("June 31"))) == 180
    assert one(T.amount_in(F.lit("it was 1,249.00"), F.lit("$1,249.00"))) and not one(T.amount_in(F.lit("it was 1249"), F.lit("$1,249.00")))
    assert one(T.facts(F.lit("maybe i paid $14"), F.lit("Amazon"), F.lit("$99"), F.lit("May 14"))) == 1
    assert one(T.strip_eos(F.lit("bye <EOS> "))) == "bye" and one(T.strip_fences(F.lit("```json\n{}\n```"))) == "{}"
    assert one(F.array_join(T.keywords(F.lit("They have the right to refund refund")), " ")) == "right refund refund"


def test_statistics(spark):
    rows = [("a", i, v) for i, v in enumerate([0, 0, 1, 1, 2])] + [("b", i, 1) for i in range(3)] + [("c", i, v) for i, v in enumerate([0, 3, 1, 3, 3, 5])]
    got = {r.g: r.rho for r in stats.spearman(spark.createDataFrame(rows, "g string, x int, y int"), ["g"], "x", "y").collect()}
    assert got["a"] == pytest.approx(0.948683, abs=1e-6) and got["b"] is None and got["c"] == pytest.approx(0.819689, abs=1e-6)
    w = stats.wilcoxon(spark.createDataFrame([("k", float(a), float(b)) for a, b in ((1, 2), (2, 2), (5, 1), (3, 1))], "k string, a double, b double"), ["k"], "a", "b").first()
    assert (w.n_used, w.wilcoxon_stat) == (3, 1.0)


HEADER = "conv_id int, dataset_type string, emotional_state string, certainty string, communication_style string, knowledge_level string, failure_mode string, wrong_prior_belief string, user_caught_error boolean, merchant string, amount string, transaction_date string"


def warnings(spark, turns, **header):
    cols = [c.split()[0] for c in HEADER.split(", ")]
    head = spark.createDataFrame([tuple({"conv_id": 1, "dataset_type": "success", **header}.get(c) for c in cols)], HEADER)
    rows = spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate(turns)], "conv_id int, turn_idx int, speaker string, text string")
    return rules.evaluate(rows, head, ["conv_id"]).first().warnings


C, A = "Customer", "Agent"
CASES = [
    ("NO_CUSTOMER_TURNS", [(A, "hello")], {}), ("HIGH_AVG_TURN_LENGTH", [(C, "w " * 31)], {}), ("LOW_LENGTH_VARIANCE", [(C, "a b"), (C, "a b"), (C, "a b")], {}),
    ("CERTAINTY_EXCEEDS_HEDGING", [(C, "definitely mine")], {"emotional_state": "calm"}), ("ZERO_HEDGING_FOR_UNCERTAIN_SCENARIO", [(C, "it was that")], {"certainty": "uncertain"}),
    ("INFO_DUMP_TURN1", [(C, "amazon took $14.00 on march 4")], {"merchant": "Amazon", "amount": "$14.00", "transaction_date": "March 4"}), ("BREADTH_FIRST_BUNDLING", [(C, "cancel it, refund me, how long, not mine")], {}),
    ("MISSING_FRUSTRATION_MARKERS", [(C, "fine")], {"emotional_state": "mildly_frustrated"}), ("UNEXPECTED_FRUSTRATION", [(C, "ridiculous")], {"emotional_state": "calm"}), ("MISSING_STRONG_FRUSTRATION", [(C, "come on")], {"emotional_state": "escalating"}),
    ("NOVICE_JARGON", [(C, "a chargeback"), (A, "chargeback")], {"knowledge_level": "novice"}), ("DIRECT_STYLE_BUT_LONG_TURNS", [(C, "w " * 26)], {"communication_style": "direct"}), ("INDIRECT_STYLE_BUT_VERY_SHORT", [(C, "a b")], {"communication_style": "indirect"}),
    ("DROPOUT_TOO_EARLY", [(C, "forget it")], {"dataset_type": "failure", "failure_mode": "impatience"}), ("DROPOUT_NOT_PLAUSIBLE", [(C, "forget it"), (C, "x"), (C, "thanks")], {"dataset_type": "failure", "failure_mode": "impatience"}),
    ("MISSING_ESCALATION_ARC", [(C, "ridiculous"), (C, "x"), (C, "y"), (C, "bye")], {"dataset_type": "failure", "failure_mode": "impatience"}),
    ("PRIOR_BELIEF_ABSENT", [(C, "hello there")], {"dataset_type": "type_a", "wrong_prior_belief": "refund arrives instantly"}),
    ("BELIEF_SILENTLY_DROPPED", [(C, "refund instantly"), (C, "a"), (C, "b"), (C, "c")], {"dataset_type": "type_a", "wrong_prior_belief": "refund arrives instantly"}),
    ("ERROR_NOT_CAUGHT", [(C, "ok")], {"dataset_type": "type_b"}), ("USER_CAUGHT_ERROR_LABEL_MISMATCH", [(C, "are you sure")], {"dataset_type": "type_b", "user_caught_error": False}),
]


@pytest.mark.parametrize("code,turns,header", CASES, ids=[c[0] for c in CASES])
def test_warning_fires(spark, code, turns, header):
    assert code in [w.split(":")[0] for w in warnings(spark, turns, **header)]


def test_clean_conversation_has_no_warning(spark):
    assert warnings(spark, [(C, "maybe it was a charge i did not expect"), (A, "a chargeback"), (C, "chargeback then"), (C, "thank you very much for all of that help today, i think we are done now")], emotional_state="calm", knowledge_level="novice") == []


DUMP = "=====\nCONVERSATION 7\n=====\n\nPERSONA:\n  knowledge_level    : novice\n\nSCENARIO:\n  merchant : Amazon\n\nPROBE META:\n  user_caught_error: False\n\n-----\n\nCustomer: hi\nmore\n\nAgent: yes\n"


def test_dump_parser(spark, tmp_path):
    (tmp_path / "conversation_007.txt").write_text(DUMP)
    heads, turns = parse.parse_dumps(scans.dumps(spark, {"type_b": f"{tmp_path}/*.txt"}))
    h = heads.first()
    assert (h.conv_idx, h.knowledge_level, h.merchant, h.user_caught_error) == (7, "novice", "Amazon", False)
    assert [(r.speaker, r.text) for r in turns.orderBy("turn_idx").collect()] == [("Customer", "hi more"), ("Agent", "yes")]
    assert parse.parse_dumps(scans.dumps(spark, {"type_b": f"{tmp_path}/*.txt"}), ("EXTRA META",))[0].first().user_caught_error is None


def test_jsonl_source_and_split_sink(spark, tmp_path):
    rows = [f'{{"input": "i{i}", "output": "o<eos>", "_meta": {{"generation_idx": {i // 2}}}}}' for i in range(20)]
    (tmp_path / "a.jsonl").write_text("\n".join([*rows, "", "not json", '{"input": "cost \\$5", "output": "<eos>", "_meta": {"generation_idx": 99}}']))
    found = scans.training_jsonl(spark, f"{tmp_path}/a.jsonl")
    assert found.count() == 21 and found.where("generation_idx = 99").first().input == "cost \\$5"
    assert scans.rejected(spark, f"{tmp_path}/a.jsonl").count() == 1
    cut = split.split_conversations(found, 0.8)
    ids = {s: {r.generation_idx for r in cut.where(F.col("split") == s).collect()} for s in ("train", "val")}
    assert (len(ids["train"]), len(ids["val"]), ids["train"] & ids["val"]) == (8, 3, set())
    sinks.write_split(cut, f"{tmp_path}/train", f"{tmp_path}/val")
    assert spark.read.json(f"{tmp_path}/train").count() + spark.read.json(f"{tmp_path}/val").count() == 21
    assert gate.collisions(found).count() == 0


def test_training_rows(spark):
    said = [(1, i, r, t) for i, (r, t) in enumerate([("user", "hi"), ("assistant", "yes?"), ("user", "bye")])] + [(2, 0, "user", "alone")]
    rows = training.training_rows(spark.createDataFrame(said, "c int, msg_idx int, role string, content string"), ["c"], F.lit("goal"), F.lit(False)).orderBy("msg_idx").collect()
    assert [r.output for r in rows] == ["hi<eos>", "<eos>"]
    assert "Conversation so far" not in rows[0].input and "Customer: hi\nAgent: yes?" in rows[1].input


def test_judge_clamp(spark):
    body = '{"depth_first_score": 7, "uncertainty_score": "x", "info_drip_score": null, "pragmatic_score": -2}'
    rows = spark.createDataFrame([(1, "success", body), (2, "success", "oops"), (3, "success", '{"_parse_error": "x"}')], "conv_idx int, dataset_type string, raw_json string")
    a, b, c = judge.score(rows).orderBy("conv_idx").collect()
    assert (a.depth_first_score, a.uncertainty_score, a.info_drip_score, a.pragmatic_score, a.persona_score) == (5.0, 0.0, 0.0, 1.0, 1.0)
    assert a.overall_score == pytest.approx(1.65) and b.parse_error and c.parse_error and b.overall_score == 0.0


def test_bleu_and_reward(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(metrics.bleu(F.lit("a b c"), F.lit("a b c"))) == pytest.approx(1.0) and one(metrics.bleu(F.lit("x"), F.lit("a b"))) == 0.0
    assert one(metrics.rule_reward(F.lit("a b <eos>"), F.lit(3))) == pytest.approx(0.7)


def test_predicted_output_is_the_reply(spark):
    rows = spark.read.parquet(f"{TINY}/conversations.parquet").collect()
    replies = {(r.conv_id, r.turn - 1): r.text for r in rows if r.role == "assistant"}
    found = base.pairs(spark, TINY).collect()
    assert any(len(r.predicted_output.split()) > 24 for r in found)
    assert all(r.predicted_output == (replies.get((r.generation_idx, r.example_idx)) or "") for r in found)


def test_judge_store_keeps_other_responses(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda *rows: spark.createDataFrame(rows, "dataset_type string, conv_idx int, raw_json string")
    sinks.write_judge_store(make(("success", 1, "a"), ("success", 2, "b"), ("type_a", 1, "c")), path)
    sinks.write_judge_store(make(("success", 2, "B"), ("success", 3, "d")), path)
    found = spark.read.parquet(path).select("dataset_type", "conv_idx", "raw_json").collect()
    assert sorted(map(tuple, found)) == [("success", 1, "a"), ("success", 2, "B"), ("success", 3, "d"), ("type_a", 1, "c")]


def test_frames(spark):
    rows = spark.createDataFrame([("base_4b", False), ("base_4b", False)], "model_variant string, is_lora boolean")
    assert frames.adapted_or_all(rows).count() == 2
    assert frames.adapted_or_all(rows.unionByName(spark.createDataFrame([("lora_4b", True)], rows.schema))).count() == 1
    shown = {(r.g, r.i, r.more) for r in frames.examples(spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "g string, i int"), "g", "i", most=2).collect()}
    assert shown == {("a", 0, 3), ("a", 1, 3), ("b", 0, 0)}
    cells = spark.createDataFrame([("v", "d", "x", 0.5), ("v", "d", "y", 0.5), ("v", "e", "x", 0.1), ("v", "e", "y", None), ("w", "e", "y", 0.4)], "model_variant string, slice_dim string, slice_val string, value double")
    assert [tuple(r) for r in frames.extremes(cells).collect()] == [("e", "y", 0.4, "x", 0.1)]
    numbers = spark.createDataFrame([(t,) for t in ("", "None", "nan", "x", None, " 1.5")], "t string").select(frames.number(F.col("t"))).collect()
    assert [r[0] for r in numbers] == [None, None, None, None, None, 1.5]
    made = spark.range(1).select(frames.intent_summary(F.lit("uncertain"), F.lit("full"), F.lit("hold"), F.lit("tried_merchant"), F.lit("$5.00"), F.lit("Uber"), F.lit("May 2"))).first()[0]
    assert made == "You are a user chatting with an assistant language model to investigate a suspicious charge of $5.00 at Uber on May 2 and get your card frozen immediately to prevent further charges. You already contacted Uber directly but they refused to help."
    assert [r[0] for r in spark.createDataFrame([(4.0,), (3.99,), (2.0,), (1.9,)], "x double").select(frames.action_band(F.col("x"))).collect()] == ["publish", "spot-check", "review", "regenerate"]
