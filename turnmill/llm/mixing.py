"""Operator 3: mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). The network runs from supply through
patterns to sources: a pattern can give its words once for nothing, a second and third time at growing cost, a source
takes up to its quota; successive shortest paths route the quotas, so repetition starts only where sources run short. Patterns
that share no source are networks of their own and routed apart. Each pattern's share is then filled with documents in seeded
order: whole copies of all, and one copy more for the first documents in the order of their marks. The place where the share
runs out is found digit by digit of the mark, from counts, until at most EDGE documents of a pattern are left; these are
filled greedily in order by a fold, so that the words taken come near the share. No task orders more than that.

Only pattern totals reach the driver, at most PATTERNS of them (more raise an error rather than being dropped).
Null text has size 0 and is never taken; a null source is a source of its own, sorted last; repeated rows are documents
of their own: rows that agree in id and size are alike, and which of them is taken does not show. Columns beyond doc_id,
text and source are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnmill.llm.common import WHITE, broadcast_if, materialize, table

COSTS, WEIGHTS, SEED, EDGE, PATTERNS = (0, 1, 3), (1, 2, 3), 42, 512, 100_000
_MARK = 30


def targets(sizes: list[int], weights: list[int], most: int = len(COSTS)) -> list[Fraction]:
    """Shares of the summed sizes by weight; what exceeds `most` times a source's size is shared again by weight."""
    out: list[Fraction | None] = [None] * len(sizes)
    left = Fraction(sum(sizes))
    while open_ := [i for i, t in enumerate(out) if t is None]:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] > most * sizes[i] * weight]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in over)
    return out


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], costs: tuple[int, ...] = COSTS) -> dict[tuple[int, int], int]:
    """(pattern, source) -> words. patterns: the sources each belongs to and its words. Successive shortest paths with potentials."""
    n_p, n_s = len(patterns), len(quotas)
    sink, graph = n_p + n_s + 1, [[] for _ in range(n_p + n_s + 2)]

    def edge(a: int, b: int, cap: int, cost: int) -> None:
        graph[a].append([b, cap, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, (members, words) in enumerate(patterns):
        for c in costs:
            edge(0, 1 + p, words, c)
        for m in members:
            edge(1 + p, 1 + n_p + m, words * len(costs), 0)
    for s, q in enumerate(quotas):
        edge(1 + n_p + s, sink, q, 0)
    potential = [0] * len(graph)
    while True:
        dist, via, queue = {0: 0}, {}, [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for i, (b, cap, cost, _) in enumerate(graph[a]):
                if cap and (nd := d + cost + potential[a] - potential[b]) < dist.get(b, nd + 1):
                    dist[b], via[b] = nd, (a, i)
                    heapq.heappush(queue, (nd, b))
        if sink not in dist:
            break
        for a in range(len(graph)):
            potential[a] += dist.get(a, max(dist.values()))
        flow, at = None, sink
        while at:
            a, i = via[at]
            flow, at = graph[a][i][1] if flow is None else min(flow, graph[a][i][1]), a
        at = sink
        while at:
            a, i = via[at]
            graph[a][i][1] -= flow
            graph[at][graph[a][i][3]][1] += flow
            at = a
    return {(p, e[0] - 1 - n_p): graph[e[0]][e[3]][1] for p in range(n_p) for e in graph[1 + p] if n_p < e[0] < sink and graph[e[0]][e[3]][1]}


def route_apart(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], costs: tuple[int, ...] = COSTS) -> dict[tuple[int, int], int]:
    """route() over each set of patterns that sources connect."""
    root = list(range(len(quotas)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for members, _ in patterns:
        for m in members[1:]:
            root[find(m)] = find(members[0])
    parts, out = defaultdict(list), {}
    for p, (members, _) in enumerate(patterns):
        parts[find(members[0])].append(p)
    for chosen in parts.values():
        used = sorted({m for p in chosen for m in patterns[p][0]})
        at = {m: i for i, m in enumerate(used)}
        flow = route([(tuple(at[m] for m in patterns[p][0]), patterns[p][1]) for p in chosen], [quotas[m] for m in used], costs)
        out.update({(chosen[p], used[s]): words for (p, s), words in flow.items()})
    return out


def word_count(text: Column) -> Column:
    """Each word with the white space around it becomes one character; no array of words is built."""
    ones = F.regexp_replace(text, "[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", "x")
    return F.when(F.btrim(text, F.lit(WHITE)) == "", 0).otherwise(F.coalesce(F.length(ones), F.lit(0))).cast("bigint")


def _boundaries(rows: DataFrame, per: DataFrame, n: int) -> DataFrame:
    """(pattern, cut, left): the first digits of the marks among which a pattern's rest runs out, at most EDGE rows, and what is left there."""
    start = per.where("rest > 0").select("pattern", F.lit("").alias("cut"), F.col("rest").alias("left"), "docs")
    done, todo = [start.where(f"docs <= {EDGE}").drop("docs")], start.where(f"docs > {EDGE}").drop("docs")
    for level in range(_MARK if todo.limit(1).count() else 0):
        digit = F.substring("mark", level + 1, 1).alias("digit")
        inside = rows.join(broadcast_if(todo, n, 10_000), "pattern").where(F.substring("mark", 1, level) == F.col("cut"))
        counts = inside.groupBy("pattern", "cut", "left", digit).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        before = Window.partitionBy("pattern").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("below", F.coalesce(F.sum("words").over(before), F.lit(0)))
        at = counts.where("left >= below AND left < below + words")
        at = materialize(at.select("pattern", F.concat("cut", "digit").alias("cut"), (F.col("left") - F.col("below")).alias("left"), "n"), "mix-cut")
        last = level + 1 == _MARK
        done.append(at.where("true" if last else f"n <= {EDGE}").drop("n"))
        todo = at.where(f"n > {EDGE}").drop("n")
        if last or not todo.limit(1).count():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _filled(edge: DataFrame) -> DataFrame:
    """Documents at the boundary in seeded order join the mix while they fit into what is left; then the smallest that brings the sum nearer."""
    order = F.sort_array(F.collect_list(F.struct("mark", "size", "doc_id", "base")))
    each = edge.groupBy("pattern", "left").agg(order.alias("rows"))
    fits = lambda a, x: (x["size"] > 0) & (x["size"] <= a["left"])
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<boolean>").alias("in"))
    fold = F.aggregate("rows", start, lambda a, x: F.struct((a["left"] - F.when(fits(a, x), x["size"]).otherwise(0)).alias("left"), F.concat(a["in"], F.array(fits(a, x))).alias("in")))
    each = each.withColumn("fold", fold)
    near = F.filter(F.zip_with("rows", "fold.in", lambda x, taken: F.when(~taken & (x["size"] > 0) & (x["size"] < 2 * F.col("fold.left")), F.struct(x["size"], x["mark"]))), lambda x: x.isNotNull())
    each = each.select("pattern", F.array_min(near).alias("extra"), F.explode(F.arrays_zip("rows", F.col("fold.in").alias("in"))).alias("x"))
    more = F.coalesce(F.col("x.in") | (F.col("extra.mark") == F.col("x.rows.mark")), F.col("x.in"))
    return each.select("x.rows.doc_id", "x.rows.size", "pattern", (F.col("x.rows.size") * (F.col("x.rows.base") + more.cast("bigint"))).alias("taken"))


def select(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """sized (doc_id, size, pattern, mark) and shares (pattern, words, docs, share) to (doc_id, size, pattern, taken)."""
    n = shares.count()
    words = F.when(F.col("words") > 0, F.col("words"))
    per = shares.select("pattern", "docs", F.coalesce(F.floor(F.try_divide("share", words)), F.lit(0)).alias("base"), F.coalesce(F.col("share") % words, F.lit(0)).alias("rest"))
    cuts = _boundaries(sized, per, n)
    known = materialize(per.drop("docs").join(cuts, "pattern", "left").select("pattern", "base", "cut", "left"), "mix-known")
    rows = sized.join(broadcast_if(known, n, 10_000), "pattern")
    prefix = F.substring(F.col("mark"), F.lit(1), F.length("cut"))
    whole = rows.where(F.col("cut").isNull() | (prefix != F.col("cut")))
    whole = whole.select("doc_id", "size", "pattern", (F.col("size") * (F.col("base") + F.coalesce((prefix < F.col("cut")).cast("bigint"), F.lit(0)))).alias("taken"))
    return whole.unionByName(_filled(rows.where(prefix == F.col("cut"))))


def marked(docs: DataFrame, pattern: Column, seed: int) -> DataFrame:
    """(doc_id, size, pattern, mark): 15 hex digits of a seeded hash of id and size give the order, 15 of the row's number part rows that agree in both."""
    sized = docs.select("doc_id", word_count(F.col("text")).alias("size"), pattern.alias("pattern"), F.monotonically_increasing_id().alias("__row"))
    first = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    second = F.lower(F.lpad(F.hex(F.xxhash64("__row")), 16, "0"))
    return sized.select("doc_id", "size", "pattern", F.concat(F.substring(first, 1, _MARK // 2), F.substring(second, 1, _MARK // 2)).alias("mark"))


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, size, pattern, taken, source_size, target): target is summed over the pattern's sources.

    docs: doc_id, text and source, a string or an array of strings for documents of several sources.
    """
    spark = docs.sparkSession
    many = dict(docs.dtypes)["source"].startswith("array")
    name = lambda s: F.when(s.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), s))
    pattern = F.to_json(F.array_sort(F.array_distinct(F.transform(F.coalesce(F.when(F.size("source") > 0, F.col("source")), F.array(F.lit(None).cast("string"))), name)))) if many else F.to_json(F.array(name(F.col("source"))))
    sized = materialize(marked(docs, pattern, seed), "sized")
    totals = sized.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
    found = totals.withColumn("sources", F.from_json("pattern", "array<string>")).limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns")
    sources = sorted({s for r in found for s in r["sources"]})
    at = {s: i for i, s in enumerate(sources)}
    size = [0] * len(sources)
    for r in found:
        for s in r["sources"]:
            size[at[s]] += r["words"]
    # a document of several sources counts to each; the mix as a whole keeps the size of all documents
    goal = targets(size, [weights[i % len(weights)] for i in range(len(sources))])
    if many and size and sum(size):
        scale = Fraction(sum(r["words"] for r in found), sum(size))
        goal = [g * scale for g in goal]
    patterns = [(tuple(at[s] for s in r["sources"]), r["words"]) for r in found]
    flow = route_apart(patterns, [int(g + Fraction(1, 2)) for g in goal])
    share = [0] * len(found)
    for (p, _), words in flow.items():
        share[p] += words
    rows = [(r["pattern"], r["words"], r["docs"], share[p], sum(size[i] for i in patterns[p][0]), float(sum(goal[i] for i in patterns[p][0]))) for p, r in enumerate(found)]
    shares = spark.createDataFrame(rows, "pattern string, words bigint, docs bigint, share bigint, source_size bigint, target double")
    taken = select(sized, shares)
    return taken.join(broadcast_if(shares.select("pattern", "source_size", "target"), len(rows), 10_000), "pattern")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_mix_sources": op3_mix_sources}
SQL: dict[str, str] = {}
