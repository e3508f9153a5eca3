"""Driver queries over corpus gates, provenance and seeded sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions import text as T
from turnmill.operators import gate, split
from turnmill.plans import base as B
from turnmill.plans.base import r
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


_SCHEMA = f"""g AS (SELECT CASE WHEN turn % 7 = 3 THEN NULL ELSE text END AS input, CASE WHEN turn % 5 = 2 THEN text ELSE text || '<eos>' END AS output, conv_id % 9 <> 0 AS has_meta, conv_id % 5 <> 0 AS probing, {B._cycle_sql('dataset_type')} AS kind FROM conversations),
g2 AS (SELECT *, input IS NOT NULL AND output IS NOT NULL AND has_meta AS whole FROM g),
g3 AS (SELECT count(*) FILTER (NOT whole) AS a, count(*) FILTER (whole AND NOT ends_with(output, '<eos>')) AS b, count(*) FILTER (whole AND kind IN ('type_a', 'type_b') AND NOT probing) AS c FROM g2)"""
_SCHEMA_ROWS = "SELECT x.n AS name, x.v = 0 AS passed, x.v::VARCHAR AS detail FROM (SELECT unnest([{'n': 'corpus: keys present', 'v': a}, {'n': 'corpus: output ends in mark', 'v': b}, {'n': 'corpus: probing type', 'v': c}]) AS x FROM g3)"


def _training(spark, sf):
    rows = parquet(spark, sf, "conversations")
    return rows.select(
        F.when(F.pmod("turn", F.lit(7)) != 3, F.col("text")).alias("input"), F.when(F.pmod("turn", F.lit(5)) == 2, F.col("text")).otherwise(F.concat("text", F.lit("<eos>"))).alias("output"),
        (F.pmod("conv_id", F.lit(9)) != 0).alias("has_meta"), (F.pmod("conv_id", F.lit(5)) != 0).alias("has_probing_type"), B._cycle("dataset_type").alias("dataset_type"),
    )


@query(f"WITH {_SCHEMA} {_SCHEMA_ROWS}")
def gate_schema(spark, sf):
    return gate.schema_checks(_training(spark, sf), "corpus")


@query(f"""WITH h AS ({B.HEADER_SQL}), d AS (SELECT *, CASE transaction_date WHEN 'March 4' THEN 64 WHEN 'June 31' THEN 180 ELSE 0 END AS doy FROM h)
SELECT dataset_type, count(DISTINCT merchant) AS merchants, count(DISTINCT amount) AS amounts, coalesce(max(doy) FILTER (doy > 0) - min(doy) FILTER (doy > 0), 0) AS date_span,
count(DISTINCT merchant) >= 5 AND count(DISTINCT amount) >= 3 AND coalesce(max(doy) FILTER (doy > 0) - min(doy) FILTER (doy > 0), 0) >= 100 AS passed FROM d GROUP BY dataset_type""")
def gate_diversity(spark, sf):
    return gate.diversity(B.headers(spark, sf), "dataset_type", merchants=5, amounts=3, days=100)


_COOC = "SELECT 'sizes by language and source' AS name, coalesce(min(v), 0) >= 3 AS passed, coalesce(min(v), 0)::VARCHAR AS detail FROM (SELECT coalesce(lang, 'None') || '/' || coalesce(source, 'None') AS k, count(DISTINCT n_chars) AS v FROM documents WHERE n_chars IS NOT NULL GROUP BY k)"


@query(_COOC)
def gate_cooccurrence(spark, sf):
    return gate.cooccurrence(parquet(spark, sf, "documents").select("lang", "source", "n_chars"), ["lang", "source"], "n_chars", 3, "sizes by language and source")


@query(f"""WITH w AS (SELECT lang, len({B.WORDS}) AS w FROM documents WHERE text IS NOT NULL AND text <> ''), s AS (
SELECT lang, count(*) AS n, {r('quantile_cont(w, 0.5)', 1)} AS median, {r('quantile_cont(w, 0.9)', 1)} AS p90, {r('avg((w > 30)::INT)', 4)} AS over_30, {r('avg((w <= 1)::INT)', 4)} AS at_most_1 FROM w GROUP BY lang)
SELECT *, median >= 12 AND p90 >= 35 AND over_30 >= 0.1 AND at_most_1 < 0.05 AS passed FROM s""")
def gate_length(spark, sf):
    return gate.lengths(parquet(spark, sf, "documents").select("lang", F.concat("text", F.lit("<eos>")).alias("output")), "lang")


_BALANCE = f"SELECT 'balance' AS name, w <= 0.15 AS passed, w AS worst FROM (SELECT {r('max(abs((n - m) / m))', 4)} AS w FROM (SELECT n, avg(n) OVER () AS m FROM (SELECT count(*) AS n FROM documents GROUP BY lang)))"


@query(f"SELECT name, passed, worst::DOUBLE AS worst FROM ({_BALANCE})")
def gate_balance(spark, sf):
    return gate.balance(parquet(spark, sf, "documents"), "lang").select("name", "passed", F.col("detail").cast("double").alias("worst"))


_DISJOINT = "SELECT 'held-out values disjoint' AS name, count(*) = 0 AS passed, count(*)::VARCHAR AS detail FROM (SELECT source FROM documents WHERE doc_id % 5 <> 0 INTERSECT SELECT source FROM documents WHERE doc_id % 5 = 0) WHERE source IS NOT NULL"


@query(_DISJOINT)
def gate_disjoint(spark, sf):
    docs = parquet(spark, sf, "documents").select("doc_id", "source")
    return gate.disjoint(docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0"), "source")


@query(f"WITH {_SCHEMA}, k AS ({_SCHEMA_ROWS} UNION ALL {_COOC} UNION ALL {_DISJOINT}) SELECT coalesce(bool_and(passed), FALSE) AS passed FROM k")
def gate_verdict(spark, sf):
    return gate.gate(gate_schema(spark, sf), gate_cooccurrence(spark, sf), gate_disjoint(spark, sf))[1]


@query("SELECT n_chars % 997 AS generation_idx, count(DISTINCT source) AS files FROM documents WHERE n_chars IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def idx_collisions(spark, sf):
    return gate.collisions(parquet(spark, sf, "documents").select(F.pmod("n_chars", F.lit(997)).alias("generation_idx"), F.col("source").alias("file")))


@query("SELECT n_chars % 997 AS generation_idx, min(doc_id) AS line_no, arg_min(source, doc_id) AS source FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def first_row_per_index(spark, sf):
    rows = parquet(spark, sf, "documents").where("n_chars IS NOT NULL").select(F.pmod("n_chars", F.lit(997)).alias("generation_idx"), F.col("doc_id").alias("line_no"), "source")
    return gate.first_rows(rows)


_U = lambda tag: f"(('0x' || substr(md5('42-{tag}-' || conv_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
_POOL = ["Harbour Books", "Corner Deli", "Lumen Power", "Northline Rail", "Quill & Co"]


@query(f"""WITH u AS (SELECT conv_id, {B._cycle_sql('communication_style')} AS style, {_U('amount')} AS a, {_U('tens')} AS t, {_U('date')} AS d, {_U('pool')} AS p, {_U('length')} AS l, {_U('tail')} AS v FROM (SELECT DISTINCT conv_id FROM conversations)),
x AS (SELECT *, exp(ln(3) + a * (ln(3000) - ln(3))) AS amt, DATE '2024-12-31' - (1 + floor(d * 180))::INT AS day FROM u)
SELECT conv_id, format('${{:,.2f}}', CASE WHEN t < 0.15 THEN round(amt / 10) * 10 ELSE amt END) AS amount, strftime(day, '%B ') || day(day) AS date, [{', '.join(B.q(m) for m in _POOL)}][1 + floor(p * {len(_POOL)})::INT] AS merchant,
CASE style WHEN 'terse' THEN greatest(3, floor(CASE WHEN l < 3 / 11 THEN 3 + sqrt(l * 11 * 3) ELSE 14 - sqrt((1 - l) * 11 * 8) END))::INT WHEN 'direct' THEN greatest(6, floor(CASE WHEN l < 7 / 20 THEN 8 + sqrt(l * 20 * 7) ELSE 28 - sqrt((1 - l) * 20 * 13) END))::INT
WHEN 'indirect' THEN greatest(12, floor(CASE WHEN l < 12 / 42 THEN 18 + sqrt(l * 42 * 12) ELSE 60 - sqrt((1 - l) * 42 * 30) END))::INT
ELSE floor(CASE WHEN v < 0.2 THEN (CASE WHEN l < 8 / 20 THEN 72 + sqrt(l * 20 * 8) ELSE 92 - sqrt((1 - l) * 20 * 12) END) ELSE (CASE WHEN l < 15 / 37 THEN 35 + sqrt(l * 37 * 15) ELSE 72 - sqrt((1 - l) * 37 * 22) END) END)::INT END AS target_length FROM x""")
def content_sample(spark, sf):
    ids = parquet(spark, sf, "conversations").select("conv_id").distinct()
    return ids.select(
        "conv_id", split.sample_amount(42, "conv_id").alias("amount"), split.sample_date(42, "conv_id", F.lit("2024-12-31").cast("date")).alias("date"),
        split.choose(42, "conv_id", _POOL, "pool").alias("merchant"), split.sample_target_length(42, "conv_id", B._cycle("communication_style")).alias("target_length"),
    )


@query(f"WITH k AS (SELECT text FROM documents) SELECT count(*) AS n, sum(len({B.WORDS}))::BIGINT AS words, max(len({B.WORDS}))::INT AS longest FROM k")
def corpus_totals(spark, sf):
    w = parquet(spark, sf, "documents").select(T.word_count(F.col("text")).alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum("w").alias("words"), F.max("w").alias("longest"))
