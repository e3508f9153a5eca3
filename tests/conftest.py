"""A small local session and helpers that write fixture tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture
def tables(spark, tmp_path):
    """tables(name=(rows, schema), ...) writes Parquet tables and gives their folder."""

    def write(**found) -> str:
        for name, (rows, schema) in found.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def canonical(rows, columns):
    """Rows as sorted strings; floats to nine places."""
    cell = lambda v: None if v is None else repr(round(float(v), 9)) if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)
    return sorted(str([cell(r[c]) for c in columns]) for r in rows)


def against_sql(spark, query, sql: str, sf_dir: str) -> None:
    """The query and its SQL agree in columns and rows."""
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = [dict(zip(names, r)) for r in con.fetchall()]
    found = query(spark, sf_dir)
    assert sorted(found.columns) == sorted(names)
    assert canonical([r.asDict() for r in found.collect()], sorted(names)) == canonical(want, sorted(names))
