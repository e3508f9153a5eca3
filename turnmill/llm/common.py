"""Shared helpers: tables, the shared scratch folder, lineage cuts, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code units that separate words: space and TAB..CR.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode with the setting unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_turnmill_scratch", None)
    if made is None:
        made = spark.sparkContext._turnmill_scratch = tempfile.mkdtemp(prefix="turnmill-")
    return made


def materialize(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write df to the shared scratch folder, partitioned by columns if given, and read it back: later plans start from files that outlive an executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._turnmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table written by materialize() that no later plan reads."""
    if path := getattr(df, "_turnmill_path", None):
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def settle(spark: SparkSession) -> None:
    """Let the JVM find the shuffles of finished plans, whose files Spark then deletes."""
    spark._jvm.System.gc()


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only where the counted rows stay within the stated bound; else the join shuffles."""
    return F.broadcast(df) if rows <= most else df


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
