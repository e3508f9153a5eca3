"""Operator 1: quality rules with risk-controlled cutoffs.

Base measures come from one pass over whole texts. A document is rejected if any of its stratum's rules reaches its cutoff. What is
certified, on all labelled rows, is the whole set of a stratum's cutoffs: the share of good documents that the rules reject
together is under ALPHA. A path is a fixed sequence of such sets from lenient to strict, one path for each subset of the rules; along it
a set is accepted while the exact binomial probability of so few false rejections, were the true rate ALPHA, is at most
DELTA / (strata x paths) - Clopper-Pearson with a Bonferroni correction over strata and paths, fixed-sequence testing
within a path. So with probability 1 - DELTA all accepted sets keep the bound, and any may be chosen: the one that rejects most
labelled junk wins, ties to the most lenient. A stratum with too few labels certifies nothing and so rejects nothing.

Null text counts as empty (no words, so base_failed). Null or unlisted lang falls into stratum "other". Repeated rows
are judged each; repeated labels of a document count once, the best quality. Columns beyond those named are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import materialize, table

STRATA = ("de", "en", "es", "fr")
#: rule: (numerator, denominator) of its score in whole hundredths, and the strictest-last grid of cutoffs.
RULES = {
    "symbols": ("n_symbols", "n_words", tuple(range(300, 9, -5))),
    "dup_lines": ("n_dup_lines", "n_lines", tuple(range(95, 9, -5))),
    "repeats": ("n_repeat_words", "n_words", tuple(range(95, 9, -5))),
}
ALPHA, DELTA = 0.01, 0.05
PATHS = [rules for n in range(1, len(RULES) + 1) for rules in combinations(RULES, n)]
STEPS = max(len(grid) for _, _, grid in RULES.values())

_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_TYPE = "struct<" + ",".join(f"{f}:bigint" for f in _FIELDS) + ">"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\x0b\x0c\r"


def repeat_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows that occur at least twice. Windows are ranked by doubling (2, 4, 8 words), so the count is exact."""
    n = len(words)
    if n <= window:
        return 0
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(index) == n:
        return 0
    rank, distinct, width = np.fromiter(map(index.__getitem__, words), np.int64, n), len(index), 1
    while width < window:
        _, rank, counts = np.unique(rank[:-width] * distinct + rank[width:], return_inverse=True, return_counts=True)
        width, distinct = width * 2, len(counts)
        if distinct == len(rank):
            return 0
    starts = np.flatnonzero(counts[rank] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    spaces = len(text) - len(text.translate(None, _SPACES))
    lines = text.split(b"\n")
    filled = [x for x in lines if x.strip()]
    return (
        len(words),
        len(text.translate(None, _CONTINUATION)) - spaces,
        len(text) - len(text.translate(None, b"#*$%&|<>")),
        len(filled) - len(set(filled)),
        repeat_words(words),
        len(lines),
    )


def _measures(text: pa.Array) -> pa.Array:
    found = [measure(x or b"") for x in text.cast(pa.binary()).to_pylist()]
    columns = zip(*found) if found else [[] for _ in _FIELDS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(_FIELDS))


def measured(docs: DataFrame, as_name: str = "__q") -> DataFrame:
    """docs with one struct column of measures."""
    return docs.withColumn(as_name, F.arrow_udf(_measures, _TYPE)(F.col("text")))


def _stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise("other")


def _score(rule: str, q) -> Column:
    top, bottom, grid = RULES[rule]
    return F.coalesce(F.least(F.try_divide(F.lit(100) * q(top), q(bottom)).cast("bigint"), F.lit(grid[0])), F.lit(0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n at rate p), summed from the largest term down."""
    total = 0.0
    for i in range(k, -1, -1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
        total += term
        if term < total * 1e-17:
            break
    return total


def cutoff_at(rule: str, step: int) -> int:
    """The rule's cutoff at a step of a path; all grids run from lenient to strict over STEPS steps."""
    grid = RULES[rule][2]
    return grid[step * len(grid) // STEPS]


def first_step(rule: str, score: Column) -> Column:
    """The first step whose cutoff the score reaches; STEPS if none does."""
    reached = F.array(*[F.lit(cutoff_at(rule, t)) for t in range(STEPS)])
    return F.size(F.filter(reached, lambda c: c > score))


def certify(counts: dict[tuple[str, int], dict[int, list[int]]], alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """(stratum, rule) -> cutoff. counts: (stratum, path) -> first step that rejects -> [junk rows, good rows]."""
    level, best, chosen = delta / ((len(STRATA) + 1) * len(PATHS)), defaultdict(float), {}
    for (stratum, path), by_step in sorted(counts.items()):
        n, junk_n = sum(x[1] for x in by_step.values()), sum(x[0] for x in by_step.values())
        for step in range(STEPS):
            good = sum(x[1] for s, x in by_step.items() if s <= step)
            junk = sum(x[0] for s, x in by_step.items() if s <= step)
            if not n or good >= alpha * n or binomial_tail(good, n, alpha) > level:
                break
            gain = junk / max(junk_n, 1) - 5 * good / n
            if gain > best[stratum] + 1e-12:
                best[stratum], chosen[stratum] = gain, (path, step)
    return {(stratum, rule): cutoff_at(rule, step) for stratum, (path, step) in chosen.items() for rule in PATHS[path]}


def fit_cutoffs(measures: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """Cutoffs from all labelled rows. Only (strata x paths x steps) counts, a fixed number, reach the driver."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("__label")).agg(F.max("quality").alias("__good"))
    step = {r: first_step(r, _score(r, lambda c: F.col(f"__q.{c}"))) for r in RULES}
    rows = measures.join(known, F.col("doc_id") == F.col("__label")).select(_stratum(F.col("lang")).alias("stratum"), (F.col("__good") > 0).cast("int").alias("good"), *[c.alias(f"__{r}") for r, c in step.items()])
    first = lambda rules: F.least(*[F.col(f"__{r}") for r in rules]) if len(rules) > 1 else F.col(f"__{rules[0]}")
    rows = rows.select("stratum", "good", F.posexplode(F.array(*[first(rules) for rules in PATHS])).alias("path", "step"))
    counts: dict = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for r in rows.groupBy("stratum", "path", "step", "good").count().collect():
        counts[r["stratum"], r["path"]][r["step"]][r["good"]] += r["count"]
    return certify(counts, alpha, delta)


def base_failed(q=lambda c: F.col(f"__q.{c}")) -> Column:
    return (q("n_words") < 20) | (F.lit(100) * q("n_repeat_words") > F.lit(30) * q("n_words"))


def rejected_by(cutoffs: dict[tuple[str, str], int], q=lambda c: F.col(f"__q.{c}")) -> Column:
    """The first rule whose certified cutoff the row reaches, else null."""
    out, lang = F.lit(None).cast("string"), _stratum(F.col("lang"))
    for (stratum, rule), cutoff in sorted(cutoffs.items(), reverse=True):
        out = F.when((lang == stratum) & (_score(rule, q) >= cutoff), rule).otherwise(out)
    return out


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measures = materialize(measured(docs).drop("text"), "quality")
    cutoffs = fit_cutoffs(measures, table(spark, sf_dir, "labels"))
    return measures.withColumn("rejected_by", rejected_by(cutoffs)).select(
        "doc_id", *[F.col(f"__q.{f}").alias(f) for f in _FIELDS[:5]], base_failed().alias("base_failed"),
        (~base_failed() & F.col("rejected_by").isNull()).alias("kept"), "rejected_by",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every certified cutoff, with their own columns only."""
    rows = materialize(measured(docs), "quality-measured")
    cutoffs = fit_cutoffs(rows, table(spark, sf_dir, "labels"))
    return rows.where(~base_failed() & rejected_by(cutoffs).isNull()).drop("__q")


QUERIES = {"op1_quality_rules": op1_quality_rules}
SQL: dict[str, str] = {}
