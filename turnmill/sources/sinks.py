"""Sinks (SK1-SK9): JSONL, splits, dumps as text, CSV with joined arrays, partitioned judge store, Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.operators.split import ordered_split, remaining


def append_jsonl(rows: DataFrame, path: str, done: DataFrame | None = None, key: str = "generation_idx") -> None:
    """Appends; rows whose key is done already are left out, so a repeated run adds nothing."""
    (rows if done is None else remaining(rows, done, key)).write.mode("append").json(path)


def write_split(rows: DataFrame, train: str, val: str, seed: int = 42, columns: tuple[str, ...] = ("input", "output", "_meta")) -> None:
    a, b = ordered_split(rows, seed)
    a.select(*columns).write.mode("overwrite").json(train)
    b.select(*columns).write.mode("overwrite").json(val)


def dump_text(headers: DataFrame, turns: DataFrame, keys: list[str], persona: tuple[str, ...], scenario: tuple[str, ...], meta: tuple[str, ...] = ()) -> DataFrame:
    """(keys, value): one transcript per conversation in the layout that the dump parser reads."""
    rule, line = "=" * 60, "-" * 60
    field = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"  {c}: "), F.col(c).cast("string")))
    block = lambda name, cols: F.when(F.lit(bool(cols)), F.concat_ws("\n", F.lit(f"{name}:"), *[field(c) for c in cols], F.lit("")))
    said = F.sort_array(F.collect_list(F.struct("turn_idx", F.concat_ws(": ", "speaker", "text").alias("l"))))
    body = turns.groupBy(*keys).agg(F.array_join(F.transform(said, lambda x: x["l"]), "\n\n").alias("__body"))
    number = F.concat(F.lit("CONVERSATION "), F.col(keys[-1]).cast("string"))
    head = F.concat_ws("\n", F.lit(rule), number, F.lit(rule), F.lit(""), block("PERSONA", persona), block("SCENARIO", scenario), block("EXTRA META", meta), F.lit(line), F.lit(""))
    return headers.join(body, keys).select(*keys, F.concat(head, F.lit("\n"), F.col("__body")).alias("value"))


def write_dumps(dumped: DataFrame, path: str, partition: str = "dataset_type") -> None:
    dumped.select(partition, "value").write.mode("overwrite").partitionBy(partition).option("lineSep", "\n\f\n").text(path)


def write_csv(df: DataFrame, path: str, joined: dict[str, str] | None = None) -> None:
    """Arrays as text with the separator given for each, ' | ' by default."""
    arrays = {c: F.array_join(c, (joined or {}).get(c, " | ")) for c, t in df.dtypes if t.startswith("array")}
    df.withColumns(arrays).write.mode("overwrite").csv(path, header=True, escape='"')


def write_judge_store(rows: DataFrame, path: str, keys: tuple[str, ...] = ("dataset_type", "conv_idx")) -> None:
    """Judge responses, errors included, by type. A later response replaces the earlier one of its conversation; all others stay."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        earlier = spark.read.parquet(path).select(*rows.columns)
        types = rows.select("dataset_type").distinct()
        kept = earlier.join(types, "dataset_type", "left_semi").join(rows.select(*keys), list(keys), "left_anti")
        rows = kept.select(*rows.columns).unionByName(rows)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_type").parquet(path)


def write_text(text: str, spark, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
