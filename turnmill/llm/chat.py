"""Operator 5: chat formatting packed as prefix trees.

Each turn becomes a marked segment; control strings inside texts are escaped reversibly. Conversations are ordered by the
hashes of their prefixes, so those that share initial turns lie side by side in depth-first order, and each partition of
that order is packed in one pass: a pack emits the segments of its tree once, depth first, with the position each has in its
own conversation and the intervals of the pack that its tokens may attend to (its ancestors and itself). A pack closes
at PACK code points or MEMBERS conversations; the next one repeats the open ancestors, so a first turn that a third
of all conversations share never gathers them in one task. A token is a code point; `tokens` of a segment may be
replaced by any tokenizer, as positions and intervals only need lengths.

Null text or role is empty. Rows of one conversation are ordered by (turn, role, text), null turns first, and a repeated row is a turn
of its own. A null conv_id is one conversation. Conversations are kept whole, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import table

PACK, MEMBERS = 16_384, 512
#: role: begin and end mark. Any other role is named in its begin mark.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE ", ">>", "<</ROLE>>")
_CONTROL = re.compile(r"\\|<<SYS>>|<</SYS>>|<<ROLE|<</ROLE>>|\[/?INST\]|</?s>")
_ESCAPED = re.compile(r"\\(.)", re.S)
_BEGIN = re.compile(r"<<SYS>>|\[INST\] |<s>|<<ROLE ((?:[^\\>]|\\.)*)>>", re.S)
_ENDS = {begin: end for begin, end in MARKS.values()}
PACK_TYPE = (
    "text string, nodes array<struct<start:bigint,length:bigint,parent:bigint,position:bigint,loss:array<struct<start:bigint,length:bigint>>,"
    "attends:array<struct<start:bigint,end:bigint>>>>, members array<struct<conv_id:{id},node:bigint>>"
)


def escape(text: str) -> str:
    """Puts a backslash after the first character of every control string and doubles backslashes."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A marked turn, and where its text starts and ends."""
    if role in MARKS:
        begin, end = MARKS[role]
    else:
        begin, end = OTHER[0] + escape(role).replace(">", "\\>") + OTHER[1], OTHER[2]
    body = escape(text)
    return begin + body + end, len(begin), len(begin) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    at, turns = 0, []
    by_mark = {begin: role for role, (begin, _) in MARKS.items()}
    while at < len(formatted):
        m = _BEGIN.match(formatted, at)
        begin = m[0]
        end = _ENDS.get(begin, OTHER[2])
        stop = formatted.index(end, m.end())
        turns.append((by_mark[begin] if begin in by_mark else unescape(m[1]), unescape(formatted[m.end() : stop])))
        at = stop + len(end)
    return turns


class _Packer:
    """Conversations in depth-first order to packs."""

    def __init__(self, limit: int, members: int):
        self.limit, self.most = limit, members
        self.reset()

    def reset(self) -> None:
        self.parts, self.size, self.nodes, self.members, self.open = [], 0, [], [], []

    def flush(self) -> dict | None:
        out = {"text": "".join(self.parts), "nodes": self.nodes, "members": self.members} if self.members else None
        self.reset()
        return out

    def add(self, conv_id, turns: list[tuple[str, str]]) -> dict | None:
        segments = [segment(r, t) for r, t in turns]
        shared = self.common(segments)
        grow = sum(len(s[0]) for s in segments[shared:])
        done = None
        if self.members and (self.size + grow > self.limit or len(self.members) >= self.most):
            done, shared = self.flush(), 0
        self.open = self.open[:shared]
        for text, a, b in segments[shared:]:
            parent = self.open[-1][1] if self.open else -1
            up = self.nodes[parent] if self.open else None
            node = {
                "start": self.size, "length": len(text), "parent": parent, "position": up["position"] + up["length"] if up else 0,
                "loss": [{"start": self.size + a, "length": b - a}] if text.startswith("<s>") else [],
                "attends": _merge(up["attends"] if up else [], self.size, self.size + len(text)),
            }
            self.open.append((text, len(self.nodes)))
            self.nodes.append(node)
            self.parts.append(text)
            self.size += len(text)
        self.members.append({"conv_id": conv_id, "node": self.open[-1][1] if self.open else -1})
        return done

    def common(self, segments: list[tuple[str, int, int]]) -> int:
        n = 0
        while n < len(segments) and n < len(self.open) and self.open[n][0] == segments[n][0]:
            n += 1
        return n


def _merge(intervals: list[dict], start: int, end: int) -> list[dict]:
    """Intervals of the pack in order, neighbours joined."""
    if intervals and intervals[-1]["end"] == start:
        return [*intervals[:-1], {"start": intervals[-1]["start"], "end": end}]
    return [*intervals, {"start": start, "end": end}]


def packs(conversations: DataFrame, limit: int = PACK, members: int = MEMBERS) -> DataFrame:
    """(text, nodes, members): packed prefix trees of all conversations (conv_id, turn, role, text)."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    turn = F.struct("turn", empty(F.col("role")).alias("role"), empty(F.col("text")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    # equal prefixes hash alike, so lexicographic order of these lists is depth-first order of the tree; ties spread by conv_id
    keyed = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    ordered = keyed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")
    kind = PACK_TYPE.format(id=dict(conversations.dtypes)["conv_id"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, done = _Packer(limit, members), []
        for batch in batches:
            for row in batch.to_pylist():
                done.append(packer.add(row["conv_id"], [(t["role"], t["text"]) for t in row["turns"]]))
                if len(done) >= 256:
                    yield from emit(done)
                    done = []
        done.append(packer.flush())
        yield from emit(done)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(kind))

    def emit(done: list) -> Iterator[pa.RecordBatch]:
        if rows := [d for d in done if d]:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ordered.mapInArrow(pack, kind)


def unpack(text: str, nodes: list[dict], node: int) -> tuple[str, list[tuple[int, int]]]:
    """One conversation read back from a pack by its attention intervals, with its loss spans at their positions."""
    chain = []
    while node >= 0:
        chain.append(node)
        node = nodes[node]["parent"]
    whole = "".join(text[i["start"] : i["end"]] for i in nodes[chain[0]]["attends"]) if chain else ""
    loss = [(nodes[n]["position"] + s["start"] - nodes[n]["start"], s["length"]) for n in reversed(chain) for s in nodes[n]["loss"]]
    return whole, loss


def digests(packed: DataFrame) -> DataFrame:
    """Per conversation what its packed form holds: turns, loss texts and size."""
    kind = dict(packed.dtypes)["members"].split("conv_id:")[1].split(",")[0]
    out = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                known: dict = {}
                for m in p["members"]:
                    if m["node"] not in known:
                        whole, loss = unpack(p["text"], p["nodes"], m["node"])
                        turns = parse(whole)
                        learned = "".join(unescape(whole[s : s + n]) for s, n in loss)
                        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                        known[m["node"]] = {"n_turns": len(turns), "turns_sha256": digest, "loss_chars": len(learned), "loss_sha256": hashlib.sha256(learned.encode()).hexdigest(), "formatted_chars": len(whole)}
                    rows.append({"conv_id": m["conv_id"]} | known[m["node"]])
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(out))
    return packed.mapInArrow(read, out)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return digests(packs(rows.unionByName(more)))


QUERIES = {"op5_chat_format": op5_chat_format}
_TURN = r"""
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
"""
SQL = {
    "op5_chat_format": rf"""
WITH t AS ({_TURN}), f AS (
  SELECT *, length(text)
    + length(regexp_replace(text, '[^\\]', '', 'g'))
    + len(regexp_extract_all(text, '<<SYS>>|<</SYS>>|<<ROLE|<</ROLE>>|\[/?INST\]|</?s>'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 18 + length(role) END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
""",
}
