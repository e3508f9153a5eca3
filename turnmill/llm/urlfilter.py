"""Operator 10: URL filters - suffix rules, then a path-template tree per host, in DataFrame operations only.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?", "#" or the end. A rule
fits its host and all subdomains if the path starts with the rule's; the longest fitting rule wins (then the longer host).

Where no rule fits, the tree decides. Per host, level by level: a segment that is a number, a date or a long hex id becomes a wildcard of its kind;
a branch with at least VARIABLE distinct children of on average under SPARSE urls each is a variable and becomes "*"; of
the remaining children those that carry labels are merged into one "+" branch if their share of blocked pages does not
differ from their siblings' by a two-proportion test. A child of MIN_LABELLED or more pages without labels joins that branch if all its labelled
siblings do and the share of its pages that end here does not differ from theirs, by the same test: so evidence reaches
pages that no rule fits. Segments below DEPTH levels form one tail that is part of the template as "**".
Labels are the pages that a rule settles. A template's purity is its share of allowed labelled pages, smoothed by PRIOR pages
at the overall share; a template is rejected if at least MIN_LABELLED of its pages are labelled and its purity is under
PURITY. Templates without such evidence are allowed.

Null urls, and urls without "://", have an empty host and path, no rule, and are allowed unless their (empty) template is rejected. Repeated
rows are judged alike and count each. Columns beyond page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import UPPER, LOWER, materialize, table

#: (verdict, host/path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DEPTH, VARIABLE, SPARSE, PRIOR, MIN_LABELLED, PURITY, Z = 8, 20, 3, 4.0, 5, 0.35, 1.96


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, "^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest fitting rule, else null. The rules are a short list of the caller's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        at, below = text.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """Path segments with numbers, dates and hex ids as wildcards of their kind; an extension stays."""
    kind = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "^\\d{4}-\\d{2}(-\\d{2})?(?=\\.|$)", "{date}"), "^\\d+(?=\\.|$)", "{n}"), "^(?=[0-9a-f-]*\\d)[0-9a-f-]{8,}(?=\\.|$)", "{id}")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    tail = F.when(F.size(parts) > DEPTH, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(F.slice(parts, 1, DEPTH), kind), tail)


def _alike(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Two-proportion test: a of n does not differ from b of m; null if either is empty."""
    share = F.try_divide(a + b, n + m)
    spread = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), m)))
    return F.abs(F.try_divide(a, n) - F.try_divide(b, m)) <= Z * spread


def templates(urls: DataFrame) -> DataFrame:
    """(host, lex, template) of distinct urls (host, lex, n, labelled, bad), lex an array of segments, one tree level at a time."""
    tree = materialize(urls.select("host", "lex", "n", "labelled", "bad", F.lit("").alias("node")), "tree-0")
    depth = tree.agg(F.max(F.size("lex"))).first()[0] or 0
    for level in range(depth):
        here = tree.withColumn("seg", F.get("lex", F.lit(level)))
        ends = F.sum(F.when(F.size("lex") == level + 1, F.col("n")).otherwise(0)).alias("ends")
        child = here.where("seg IS NOT NULL").groupBy("host", "node", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")], ends)
        child = materialize(child, "children")
        known = lambda c: F.coalesce(F.sum(F.when(F.col("labelled") > 0, F.col(c))), F.lit(0))
        parent = child.groupBy("host", "node").agg(F.count("*").alias("children"), F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), known("n").alias("known_n"), known("ends").alias("known_ends"))
        child = child.join(materialize(parent, "parents"), ["host", "node"])
        variable = (F.col("children") >= VARIABLE) & (F.col("all_n") < F.col("children") * SPARSE)
        rest_n, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        agree = (rest_n == 0) | _alike(F.col("bad"), F.col("labelled"), rest_bad, rest_n)
        child = materialize(child.select("*", variable.alias("variable"), F.when(F.col("labelled") > 0, agree).alias("agree")), "compared")
        whole = materialize(child.groupBy("host", "node").agg(F.coalesce(F.every("agree"), F.lit(False)).alias("all_agree")), "agreeing")
        child = child.join(whole, ["host", "node"])
        same_shape = F.col("all_agree") & (F.col("n") >= MIN_LABELLED) & _alike(F.col("ends"), F.col("n"), F.col("known_ends"), F.col("known_n"))
        alike = F.coalesce(F.when(F.col("labelled") > 0, F.col("agree")).otherwise(same_shape), F.lit(False))
        to = child.select("host", "node", "seg", F.when(F.col("variable"), "*").when(alike, "+").otherwise(F.col("seg")).alias("to"))
        to = materialize(to, "merged")
        tree = materialize(here.join(to, ["host", "node", "seg"], "left").select("host", "lex", "n", "labelled", "bad", F.when(F.col("to").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), "to")).alias("node")), f"tree-{level + 1}")
    return tree.withColumnRenamed("node", "template")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, labelled, purity) for every page."""
    host, path = split_url(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    cut = cut.select("*", rule.alias("rule"), verdict.alias("by_rule"), segments(F.col("path")).alias("lex"))
    flag = lambda c: F.sum(F.when(c, 1).otherwise(0))
    urls = cut.groupBy("host", "lex").agg(F.count("*").alias("n"), flag(F.col("rule").isNotNull()).alias("labelled"), flag(F.col("by_rule") == "block").alias("bad"))
    tree = templates(urls)
    total, bad = tree.agg(F.sum("labelled"), F.sum("bad")).first()
    prior = 1 - bad / total if total else 1.0
    counts = materialize(tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "templates")
    purity = (F.col("labelled") - F.col("bad") + PRIOR * prior) / (F.col("labelled") + PRIOR)
    judged = counts.select("host", "template", "labelled", purity.alias("purity"))
    known = materialize(tree.select("host", "lex", "template").join(judged, ["host", "template"]), "judged-urls")
    rejected = (F.col("labelled") >= MIN_LABELLED) & (F.col("purity") < PURITY)
    return cut.join(known, ["host", "lex"]).select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(rejected, "block").otherwise("allow")).alias("verdict"), "template", F.col("labelled").cast("bigint").alias("labelled"), "purity",
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))


QUERIES = {"op10_url_filters": op10_url_filters}
SQL: dict[str, str] = {}
