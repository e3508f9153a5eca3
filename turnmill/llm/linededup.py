"""Operator 7: line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

The texts are hashed once: a compact table holds (doc_id, h1, h2) for each line that can be dropped, dealt to BATCHES by a hash of
doc_id. The batches are then added one by one. A batch's lines are counted per key (documents and the largest of their ids)
before and after one shuffle, and written in hash buckets, sorted. A merge join against each run, bucket by bucket and without
an exchange, parts the batch: keys that no run holds (anti-join) become its own run at level 0, the others are noted as
increments. So a key stands in one run only, and whenever FANOUT runs share a level, merge joins compact them, again bucket
by bucket, into one of the next level. In the end only increments, the lines met in several batches, are shuffled to the runs.

A line of a third of all documents is one row per task before a shuffle; keys above 1/HEAVY of all repeated lines number HEAVY
at most and are broadcast, the others meet their lines in a shuffle where no key has more than that share.

A document is a row. Null or empty text is one empty line. A row with a null doc_id keeps all its lines and does not count.
Rows that share a doc_id are one document in the count of documents, and are cleaned each. Lines are told by 128 hash bits.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import WHITE, discard, lower_ascii, materialize, scratch_dir, table

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT, HEAVY = 40, 5, 4, 3, 5000
KEY = ["h1", "h2"]


def _keys(text: Column) -> Column:
    return F.transform(F.split(lower_ascii(text), "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)))


def _hash(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS, row: Column | None = None) -> DataFrame:
    """(doc_id, row, h1, h2): each line key of at least min_chars code points once per row. `row` tells rows of one doc_id apart."""
    row = F.lit(0).cast("bigint") if row is None else row
    keys = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", row.alias("row"), F.explode(F.array_distinct(_keys(F.col("text")))).alias("key"))
    h1, h2 = _hash(F.col("key"))
    return keys.where(F.char_length("key") >= min_chars).select("doc_id", "row", h1.alias("h1"), h2.alias("h2"))


def count_lines(lines: DataFrame, ids_repeat: bool = True) -> DataFrame:
    """(h1, h2, n, last): documents that have the line and the largest of their ids."""
    if ids_repeat:
        lines = lines.groupBy("doc_id", *KEY).agg(F.lit(1).alias("one"))
    return lines.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


class LineRuns:
    """The runs of all batches added so far. Runs and batches are tables of the same hash buckets, sorted, so that they meet in merge joins."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.increments = spark, fanout, {}, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _bucketed(self, df: DataFrame, tag: str) -> DataFrame:
        name = f"turnmill_{tag}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{scratch_dir(self.spark)}/{name}").saveAsTable(name)
        out = self.spark.table(name)
        out._turnmill_path, out._turnmill_table = f"{scratch_dir(self.spark)}/{name}", name
        return out

    def _drop(self, df: DataFrame) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {df._turnmill_table}")
        discard(df)

    def runs(self) -> list[DataFrame]:
        return [r for level in sorted(self.levels) for r in self.levels[level]]

    def unseen(self, counted: DataFrame) -> DataFrame:
        """Rows of a bucketed batch whose key no run holds."""
        return reduce(lambda left, run: left.join(run.hint("merge"), KEY, "left_anti"), self.runs(), counted)

    def seen(self, counted: DataFrame) -> list[DataFrame]:
        """Rows of a bucketed batch whose key some run holds. A key stands in one run only."""
        return [counted.join(run.hint("merge"), KEY, "left_semi") for run in self.runs()]

    def add_batch(self, lines: DataFrame, ids_repeat: bool = True) -> None:
        """Lines (doc_id, h1, h2) of a new batch of documents, none of which an earlier batch had."""
        counted = self._bucketed(count_lines(lines, ids_repeat), "batch")
        if self.runs():
            self.increments += [materialize(part, "increments") for part in self.seen(counted)]
            fresh = self._bucketed(self.unseen(counted), "run")
            self._drop(counted)
        else:
            fresh = counted
        self.levels.setdefault(0, []).append(fresh)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self._bucketed(reduce(self._merge, full), "run")
            for old in full:
                self._drop(old)
            level += 1
            self.levels.setdefault(level, []).append(merged)

    @staticmethod
    def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
        """Both runs in one; as no key is in both, a row comes from one of them."""
        b = b.select(*KEY, F.col("n").alias("n_b"), F.col("last").alias("last_b"))
        return a.join(b.hint("merge"), KEY, "full").select(*KEY, F.coalesce("n", "n_b").alias("n"), F.coalesce("last", "last_b").alias("last"))

    def totals(self) -> DataFrame:
        """(h1, h2, n, last) of every line key, over all batches."""
        runs = reduce(DataFrame.unionByName, self.runs())
        if not self.increments:
            return runs
        more = reduce(DataFrame.unionByName, self.increments).groupBy(*KEY).agg(F.sum("n").alias("n_b"), F.max("last").alias("last_b"))
        # lines met in one batch only, by far the most, stay in their buckets
        parts = [run.join(more.hint("merge"), KEY, "left") for run in self.runs()]
        whole = reduce(DataFrame.unionByName, parts)
        return whole.select(*KEY, (F.col("n") + F.coalesce("n_b", F.lit(0))).alias("n"), F.greatest("last", "last_b").alias("last"))

    def drop(self) -> None:
        for run in self.runs():
            self._drop(run)
        for part in self.increments:
            discard(part)


def repeated(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> tuple[DataFrame, Column]:
    """(__id, __row, __drop), the hashes of lines to take from each row that loses any, and the expression of __row over docs."""
    spark = docs.sparkSession
    n, distinct = docs.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    row = F.xxhash64("text") if n > distinct else F.lit(0).cast("bigint")
    hashed = lines_of(docs, min_chars, row).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    lines = materialize(hashed, "lines", "batch")
    runs = LineRuns(spark)
    for b in range(batches):
        runs.add_batch(lines.where(F.col("batch") == b).drop("batch"), n > distinct)
    often = materialize(runs.totals().where(F.col("n") >= min_docs), "repeated-lines")
    runs.drop()
    total = often.agg(F.sum("n")).first()[0] or 0
    heavy = often.where(F.col("n") * HEAVY >= total).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("last").alias("heavy_last"))
    light = often.where(F.col("n") * HEAVY < total).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("last").alias("light_last"))
    lines = lines.drop("batch").join(F.broadcast(heavy), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    # lines settled by the broadcast are dealt by document instead of by their own hash
    lines = lines.withColumn("at", F.when(F.col("heavy_last").isNull(), F.col("h1")).otherwise(F.xxhash64("doc_id", "row", "h1")))
    lines = lines.join(light, (F.col("at") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    hit = lines.where(F.coalesce("heavy_last", "light_last") > F.col("doc_id"))
    return hit.groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set(F.struct(*KEY)).alias("__drop")), row


def drop_repeated(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with __lines, the lines of each text, and __kept, those that stay."""
    drops, row = repeated(docs.select("doc_id", "text"), min_docs, min_chars)
    out = docs.join(drops, (docs["doc_id"] == drops["__id"]) & (row == drops["__row"]), "left")
    text = F.coalesce("text", F.lit(""))
    out = out.withColumn("__lines", F.split(text, "\n", -1))
    key = lambda line: F.btrim(lower_ascii(line), F.lit(WHITE))
    kept = F.filter("__lines", lambda line: ~F.array_contains("__drop", F.struct(*[h.alias(f"h{i}") for i, h in enumerate(_hash(key(line)), 1)])))
    return out.withColumn("__kept", F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(kept))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", F.size("__lines").cast("bigint").alias("n_lines"), (F.size("__lines") - F.size("__kept")).cast("bigint").alias("n_dropped"),
        F.sha2(F.array_join("__kept", "\n"), 256).alias("kept_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the text of each cut to the lines that stay, and n_chars to match."""
    out = drop_repeated(docs).withColumn("text", F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__drop").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("bigint")))
    return out.select(*[out[c] for c in docs.columns])


QUERIES = {"op7_line_dedup": op7_line_dedup}
SQL = {
    "op7_line_dedup": r"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), line AS (
  SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM doc
), keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM line
), often AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.rid, k.doc_id, k.pos, k.line, coalesce(k.doc_id < o.last, FALSE) AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid
""",
}
