"""Messages to training rows (PA3, PA7, W2-W3, W10, F6, F12, P1-P5, U1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions import lexicons as L
from turnmill.functions import text as T

FIRST = "Goal: {intent}.\nWrite the opening message."
NEXT = "Goal: {intent}.\nConversation so far:\n{history}\n\nIf your goal is met, answer <eos>; else write the next message."
STOPPED = "Goal: {intent}. You may give up.\nConversation so far:\n{history}\n\nIf your goal cannot be met, answer <eos>; else write the next message."


def dataset_type(probing: Column, goal_completed: Column) -> Column:
    return F.when(probing == "inadvertent", "type_a").when(probing == "adversarial", "type_b").when(goal_completed.eqNullSafe(False), "failure").otherwise("success")


def messages_from_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines (keys, line_no, line) to (keys, msg_idx, role, content): neighbouring agent lines are one message, each customer line its own, other lines continue."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    marked = lines.withColumn("who", F.when(F.col("line").startswith("Customer:"), "user").when(F.col("line").startswith("Agent:"), "assistant"))
    prev = F.last(F.when(F.col("who").isNotNull(), F.col("who")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("who") == "user") | ((F.col("who") == "assistant") & ~prev.eqNullSafe("assistant"))
    numbered = marked.withColumn("opens", F.coalesce(opens, F.lit(False))).withColumn("msg_idx", F.sum(F.col("opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    body = F.trim(F.when(F.col("who").isNotNull(), F.regexp_replace("line", r"^(Customer|Agent):", "")).otherwise(F.col("line")))
    parts = F.transform(F.sort_array(F.collect_list(F.when(body != "", F.struct("line_no", body.alias("b"))))), lambda x: x["b"])
    return numbered.where("msg_idx >= 0").groupBy(*keys, "msg_idx").agg(F.min_by("who", "line_no").alias("role"), F.array_join(parts, " ").alias("content"))


def history(turns: DataFrame, keys: list[str], idx: str = "msg_idx", role: str = "role", content: str = "content") -> DataFrame:
    """turns with the lines spoken before each."""
    said = F.concat(F.when(F.col(role) == "user", "Customer: ").otherwise("Agent: "), F.col(content))
    before = Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("__line", said).withColumn("history", F.array_join(F.collect_list("__line").over(before), "\n")).drop("__line")


def training_rows(turns: DataFrame, keys: list[str], intent: Column, failed: Column, idx: str = "msg_idx", role: str = "role", content: str = "content", templates: tuple[str, str, str] = (FIRST, NEXT, STOPPED)) -> DataFrame:
    """(keys, idx, input, output) per user turn; the last user turn's output is the end mark alone. Conversations of under two messages give none."""
    w = Window.partitionBy(*keys)
    rows = history(turns, keys, idx, role, content).withColumns({"__n": F.count("*").over(w), "__last": F.max(F.when(F.col(role) == "user", F.col(idx))).over(w)})
    rows = rows.where((F.col(role) == "user") & (F.col("__n") >= 2))
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{intent}"), intent), F.lit("{history}"), F.col("history"))
    text = F.when(F.col("history") == "", fill(templates[0])).when(failed, fill(templates[2])).otherwise(fill(templates[1]))
    output = F.when(F.col(idx) == F.col("__last"), "<eos>").otherwise(F.concat(F.col(content), F.lit("<eos>")))
    return rows.select(*keys, idx, text.alias("input"), output.alias("output"))


def caught_error(turns: DataFrame, keys: list[str], lexicon: tuple[str, ...] = L.LABEL_PUSHBACK, skip: int = 4, idx: str = "msg_idx") -> DataFrame:
    """(keys, user_caught_error): a pushback phrase in a user turn after the first `skip` messages."""
    hit = (F.col(idx) >= skip) & (F.col("role") == "user") & T.has_any(F.lower("content"), lexicon)
    return turns.groupBy(*keys).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("user_caught_error"))


def describe(columns: dict[str, dict[str, str]]) -> Column:
    """Prose from enumerated columns: column -> value -> clause; unknown values are left out."""
    return F.concat_ws("; ", *[F.coalesce(*[F.when(F.col(c) == v, text) for v, text in by.items()]) for c, by in columns.items()])


def transcript(turns: DataFrame, keys: list[str], idx: str = "msg_idx") -> DataFrame:
    line = F.concat(F.lit("["), F.when(F.col("role") == "user", "CUSTOMER").otherwise("AGENT"), F.lit("]: "), F.col("content"))
    return turns.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), line.alias("l")))), lambda x: x["l"]), "\n").alias("transcript"))


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
