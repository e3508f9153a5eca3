"""Dump parser (PA1-PA2): lines of transcript files to headers and turns, as window expressions over each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERSONA = ("knowledge_level", "emotional_state", "communication_style", "goal_clarity")
SCENARIO = ("certainty", "information_completeness", "prior_contact", "expected_resolution", "merchant", "amount", "transaction_date")
TEXT_META = ("failure_mode", "probing_type", "wrong_prior_belief", "agent_failure_mode", "planted_error")
FLAG_META = ("goal_completed", "user_caught_error")


def parse_dumps(lines: DataFrame, meta_sections: tuple[str, ...] = ("EXTRA META", "PROBE META")) -> tuple[DataFrame, DataFrame]:
    """(headers, turns) of lines (dataset_type, file, line_no, line).

    Files without a conversation number give nothing. Meta sections by other names are not read.
    """
    key = ["dataset_type", "file"]
    w = Window.partitionBy(*key).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = F.trim(F.translate("line", "\t\r", "  "))
    marks = {"PERSONA:": "persona", "SCENARIO:": "scenario", **{f"{m}:": "meta" for m in meta_sections}}
    marker = F.coalesce(*[F.when(s == m, v) for m, v in marks.items()], F.when(s.rlike("^-{4,}"), "none"))
    pair = F.when(marker.isNull() & F.col("line").rlike(r"^\s+\w+\s*:\s*.+"), F.struct(F.lower(F.regexp_extract("line", r"^\s+(\w+)\s*:\s*(.+)", 1)).alias("k"), F.trim(F.regexp_extract("line", r"^\s+(\w+)\s*:\s*(.+)", 2)).alias("v")))
    plain = marker.isNull() & pair.isNull()
    opens = plain & s.rlike(r"^(Customer|Agent):\s*.+")
    rows = lines.select(*key, "line_no", s.alias("s"), marker.alias("marker"), pair.alias("pair"), opens.alias("opens"), plain.alias("plain"), F.regexp_extract("line", r"CONVERSATION\s+(\d+)", 1).alias("number"))
    # a turn closes any section
    rows = rows.withColumns({"section": F.last(F.when(F.col("opens"), "none").otherwise(F.col("marker")), ignorenulls=True).over(upto), "turn": F.sum(F.col("opens").cast("int")).over(upto) - 1})
    idx = F.min_by("number", F.when(F.col("number") != "", F.col("line_no"))).try_cast("int")
    of = lambda section, k: F.max_by("pair.v", F.when((F.col("section") == section) & (F.col("pair.k") == k), F.col("line_no")))
    flag = lambda k: ~F.lower(of("meta", k)).isin("false", "0", "no")
    headers = rows.groupBy(*key).agg(
        idx.alias("conv_idx"), *[of("persona", k).alias(k) for k in PERSONA], *[of("scenario", k).alias(k) for k in SCENARIO], flag("goal_completed").alias("goal_completed"), *[of("meta", k).alias(k) for k in TEXT_META], flag("user_caught_error").alias("user_caught_error"),
    ).where("conv_idx IS NOT NULL")
    body = F.when(F.col("opens"), F.trim(F.regexp_extract("s", r"^(Customer|Agent):\s*(.+)", 2))).otherwise(F.col("s"))
    said = rows.where(F.col("plain") & (F.col("turn") >= 0) & (F.col("s") != "")).where(F.col("opens") | ~F.col("s").rlike("^(=+|-{4,}|(Customer|Agent):)"))
    turns = said.groupBy(*key, F.col("turn").cast("int").alias("turn_idx")).agg(F.min_by(F.regexp_extract("s", "^(Customer|Agent):", 1), "line_no").alias("speaker"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", body.alias("b")))), lambda x: x["b"]), " ").alias("text"))
    turns = turns.join(headers.select(*key, "conv_idx"), key)
    return headers.drop("file"), turns.select("dataset_type", "conv_idx", "turn_idx", "speaker", "text")
