"""Sources (SC1-SC13): JSONL with provenance, tolerant JSON, nested prediction arrays, dumps, typed CSV, judge cache, Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import text as T

PERSONA = "struct<knowledge_level:string,emotional_state:string,communication_style:string,goal_clarity:string>"
SCENARIO = "struct<certainty:string,information_completeness:string,prior_contact:string,expected_resolution:string,merchant_name:string,amount:string,transaction_date:string,card_type:string,channel:string>"
META = (
    f"struct<synthetic:boolean,generation_idx:bigint,persona:{PERSONA},scenario:{SCENARIO},goal_completed:boolean,failure_mode:string,probing_type:string,"
    "wrong_prior_belief:string,agent_failure_mode:string,planted_error:string,user_caught_error:boolean>"
)
ROW = f"struct<input:string,output:string,_meta:{META}>"
PREDICTION = f"array<struct<expected_output:string,_meta:{META},base_model:struct<predicted_output:string>,lora_model:struct<predicted_output:string>>>"


def mended_json(text: Column) -> Column:
    """Stray backslashes doubled."""
    return F.regexp_replace(text, r'\\(?!["\\/bfnrtu])', r"\\\\")


def tolerant_json(text: Column, schema: str) -> Column:
    """Parsed, else parsed with stray backslashes doubled, else null."""
    ok = lambda t: F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema))
    return F.coalesce(ok(text), ok(mended_json(text)))


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line_no, line) of text files. Files are split, so line_no orders lines within a file but has gaps."""
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def training_lines(rows: DataFrame, keep_raw: bool = False) -> DataFrame:
    """(file, line_no, input, output, _meta, has_meta, has_probing_type, generation_idx) of rows (file, line_no, line); blank and unreadable lines are left out."""
    rows = rows.where(F.trim("line") != "").withColumn("r", tolerant_json(F.col("line"), ROW)).where(F.col("r").isNotNull())
    meta = F.coalesce(F.get_json_object("line", "$._meta"), F.get_json_object(mended_json(F.col("line")), "$._meta"))
    return rows.select("file", "line_no", "r.input", "r.output", "r._meta", meta.isNotNull().alias("has_meta"), F.coalesce(F.array_contains(F.json_object_keys(meta), "probing_type"), F.lit(False)).alias("has_probing_type"), F.col("r._meta.generation_idx").alias("generation_idx"), *(["line"] if keep_raw else []))


def training_jsonl(spark: SparkSession, *paths: str, keep_raw: bool = False) -> DataFrame:
    """training_lines of files; bad lines are told by `rejected`."""
    return training_lines(lines(spark, *paths), keep_raw)


def rejected(spark: SparkSession, *paths: str) -> DataFrame:
    return lines(spark, *paths).where(F.trim("line") != "").where(tolerant_json(F.col("line"), ROW).isNull())


def indexed(rows: DataFrame) -> DataFrame:
    """Rows that carry an index; raises if two files share one."""
    from turnmill.operators.gate import collisions

    shared = collisions(rows).limit(5).collect()
    if shared:
        raise ValueError(f"generation_idx in several files: {[r['generation_idx'] for r in shared]}")
    return rows.where("generation_idx IS NOT NULL")


def done_indexes(spark: SparkSession, *paths: str) -> DataFrame:
    return training_jsonl(spark, *paths).select("generation_idx").where("generation_idx IS NOT NULL").distinct()


def few_shot_examples(rows: DataFrame) -> DataFrame:
    """Histories of rows that end a conversation: between the first 'Conversation so far:' and the next 'If your goal'."""
    cut = F.get(F.split("input", "Conversation so far:", 3), F.lit(1))
    return rows.where(F.trim("output") == "<eos>").where(cut.isNotNull()).select(F.trim(F.substring_index(cut, "If your goal", 1)).alias("example"))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Records of one nested array file with their position."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", PREDICTION).alias("a"))
    rec = whole.select(F.posexplode("a").alias("example_idx", "r")).select("example_idx", "r.*")
    return rec.select("*", F.col("_meta.generation_idx").alias("generation_idx"), F.col("_meta.failure_mode").alias("failure_mode"), "_meta.persona.*", F.col("_meta.scenario.merchant_name").alias("merchant"), F.col("_meta.scenario.amount").alias("amount"), F.col("_meta.scenario.transaction_date").alias("transaction_date"))


def dumps(spark: SparkSession, by_type: dict[str, str]) -> DataFrame:
    """(dataset_type, file, line_no, line): one row per line of dump files; the type comes from the folder."""
    out = None
    for kind, pattern in by_type.items():
        one = spark.read.text(pattern, wholetext=True).select(F.lit(kind).alias("dataset_type"), F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
        out = one if out is None else out.unionByName(one)
    return out


def csv_strings(spark: SparkSession, path: str, missing_ok: bool = True) -> DataFrame | None:
    """All columns as strings; None where the path is missing and that is allowed."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        if missing_ok:
            return None
        raise FileNotFoundError(path)
    return spark.read.csv(path, header=True, escape='"', multiLine=True)


def typed(df: DataFrame, doubles: tuple[str, ...] = (), ints: tuple[str, ...] = (), bools: tuple[str, ...] = ()) -> DataFrame:
    return df.withColumns({c: T.to_double(F.col(c)) for c in doubles} | {c: F.coalesce(F.col(c).try_cast("double").cast("int"), F.lit(0)) for c in ints} | {c: T.to_bool(F.col(c)) for c in bools})


def judge_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset_type, conv_idx, raw_json) from one file per conversation; names without a type mean success."""
    raw = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("raw_json"))
    return cache_entries(raw)


def cache_entries(raw: DataFrame) -> DataFrame:
    """(dataset_type, conv_idx, raw_json) of rows (name, raw_json); other names are left out."""
    kind = F.regexp_extract("name", r"^conv_(?:(\w+)_)?\d+\.json$", 1)
    return raw.select(F.when(kind == "", "success").otherwise(kind).alias("dataset_type"), F.regexp_extract("name", r"^conv_(?:\w+_)?(\d+)\.json$", 1).try_cast("int").alias("conv_idx"), "raw_json").where("conv_idx IS NOT NULL")


def rl_rows(rows: DataFrame) -> DataFrame:
    return rows.where("input IS NOT NULL").select(F.col("input").alias("prompt"), F.coalesce("output", F.lit("")).alias("reference"), F.coalesce("generation_idx", F.lit(-1)).cast("bigint").alias("generation_idx"))


def rl_dataset(spark: SparkSession, *paths: str) -> DataFrame:
    return rl_rows(training_jsonl(spark, *paths))


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
