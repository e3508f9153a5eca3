"""Operator 9: benchmark decontamination with item-sized SimHash windows, in DataFrame operations only.

Texts are A-Z lower-cased and cut into words [^\\x20\\x09-\\x0D]+; shingles are five words (an item of fewer words is one shingle, its
whole sequence), weighted by how often they occur. A window has as many words as an item; its similarity to the item is
sum(min) / sum(max) of the weights, at least 0.8. The best window of each (document, item) is returned.

Which windows get a fingerprint: sliding a window right to its first shingle that the benchmark has never lowers a similarity, so
only windows that begin at such a shingle ("anchors", found by one probe of every document shingle) matter, and only
those that hold at least 0.8 of an item's number of them. Their SimHash is taken over the anchors inside. Items and
windows of one size then meet by multi-index blocks: fingerprints within RADIUS bits agree in one of RADIUS + 1 blocks
whole, so equality joins find them all; the exact weighted similarity verifies. Windows at similarity 0.8 differ from
their item in about 7 of 64 bits (deviation 2.5), so RADIUS 20 leaves 5 deviations.

Null or empty texts and items match nothing; rows with a null id are left out. Rows that repeat a doc_id are searched apart
and the best window of any counts; repeated item rows count as one. Equal similarities keep the first window. Columns
beyond id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import broadcast_if, lower_ascii, materialize, table

SHINGLE, SIMILARITY, RADIUS = 5, (4, 5), 20
MOST_BROADCAST = 1_000_000
_EDGES = [64 * i // (RADIUS + 1) for i in range(RADIUS + 2)]


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(hashed: Column, width: int) -> Column:
    """Hash of each run of `width` elements, by halves: a run of 5 is one of 4 and the next element."""
    if width == 1:
        return hashed
    first = 1 << (width - 1).bit_length() - 1
    after = lambda a, k: F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0)))
    until = lambda a, k: F.slice(a, 1, F.greatest(F.size(a) - k, F.lit(0)))
    rest = width - first
    join = lambda a, b: F.zip_with(until(a, rest), after(b, first), lambda x, y: F.xxhash64(x, y))
    return _let(_runs(hashed, first), lambda a: join(a, a if first == rest else _runs(hashed, rest)))


def _hashes(words: str, width: int) -> Column:
    """Hash of each run of `width` words; each word is hashed once."""
    return F.when(F.size(words) >= width, _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _runs(h, width)))


def _items(items: DataFrame) -> DataFrame:
    """(item_id, width, m, fp, bag): width and number of shingles, fingerprint, and array of (h, c)."""
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().select("item_id", F.xxhash64("text").alias("row"), _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    hs = F.lit(None).cast("array<bigint>")
    for width in range(1, SHINGLE + 1):
        hs = F.when(F.least(F.size("w"), F.lit(SHINGLE)) == width, _hashes("w", width)).otherwise(hs)
    rows = rows.select("item_id", "row", F.least(F.size("w"), F.lit(SHINGLE)).alias("width"), hs.alias("hs"))
    each = rows.select("item_id", "row", F.explode("hs").alias("h")).groupBy("item_id", "row", "h").agg(F.count("*").cast("int").alias("c"))
    bags = each.groupBy("item_id", "row").agg(F.collect_list(F.struct("h", "c")).alias("bag"))
    return rows.select("item_id", "row", "width", F.size("hs").alias("m"), _simhash(F.col("hs")).alias("fp")).join(bags, ["item_id", "row"])


def _simhash(hs: Column) -> Column:
    """Bit b is 1 if set in over half the hashes. One sum holds the counts of four bits, or of two for over 65,535 hashes."""
    def of(lane: int) -> Column:
        n, mask = 64 // lane, sum(1 << lane * i for i in range(64 // lane))
        add = lambda b: lambda s, h: s + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(mask))
        sums = [F.aggregate(hs, F.lit(0).cast("bigint"), add(b)) for b in range(lane)]
        low = (1 << lane) - 1

        def bits(total: Column) -> Column:
            out = F.lit(0).cast("bigint")
            for b in range(lane):
                for i in range(n):
                    count = F.shiftrightunsigned(F.get(total, F.lit(b)), lane * i).bitwiseAND(F.lit(low))
                    out = out.bitwiseOR(F.when(count * 2 > F.size(hs), F.shiftleft(F.lit(1).cast("bigint"), lane * i + b)).otherwise(F.lit(0).cast("bigint")))
            return out

        return _let(F.array(*sums), bits)

    return F.when(F.size(hs) < 1 << 16, of(16)).otherwise(of(32))


def _shared(bag: str, hs: str) -> Column:
    """Sum of the smaller weights. Where one side has no repeats, that is the size of the intersection."""
    hs, bag = (F.col(c) if isinstance(c, str) else c for c in (hs, bag))
    simple = (F.size(F.array_distinct(hs)) == F.size(hs)) | ~F.exists(bag, lambda x: x["c"] > 1)
    weighed = F.aggregate(bag, F.lit(0), lambda n, x: n + F.least(x["c"], F.size(F.filter(hs, lambda h: h == x["h"]))))
    return F.when(simple, F.size(F.array_intersect(hs, F.transform(bag, lambda x: x["h"])))).otherwise(weighed)


def _block(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, _EDGES[i]).bitwiseAND(F.lit((1 << (_EDGES[i + 1] - _EDGES[i])) - 1))


def _blocks(fp: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), _block(fp, i).alias("v")) for i in range(RADIUS + 1)])


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, shared, of, similarity) of the best window of each pair with similarity 0.8 or more."""
    top, bottom = SIMILARITY
    bench = materialize(_items(items).withColumn("item", F.monotonically_increasing_id()), "bench")
    n_items, n_shingles, widths = bench.agg(F.count("*"), F.coalesce(F.sum(F.size("bag")), F.lit(0)), F.collect_set("width")).first()
    # shingle -> the item sizes it can open a window of
    probe = bench.select("width", "m", F.explode("bag.h").alias("h")).groupBy("width", "h").agg(F.collect_set("m").alias("ms"))
    words = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("row"), _words(F.col("text")).alias("w"))
    runs = [F.struct(F.lit(w).alias("width"), _hashes("w", w).alias("hs")) for w in sorted(widths)] or [F.struct(F.lit(SHINGLE).alias("width"), F.array().cast("array<bigint>").alias("hs"))]
    if len(runs) == 1:
        each = words.select("doc_id", "row", F.size("w").alias("n"), runs[0].getField("width").alias("width"), F.posexplode(runs[0].getField("hs")).alias("pos", "h"))
    else:
        each = words.select("doc_id", "row", F.size("w").alias("n"), F.explode(F.array(*runs)).alias("r")).select("doc_id", "row", "n", "r.width", F.posexplode("r.hs").alias("pos", "h"))
    anchors = each.join(broadcast_if(probe, n_shingles, MOST_BROADCAST), ["width", "h"])
    # every window of m shingles lies in two neighbouring stretches of m positions: one short list per stretch
    sized = anchors.select("doc_id", "row", "width", (F.col("n") - F.col("width") + 1).alias("last"), "pos", "h", F.explode("ms").alias("m"))
    at = F.floor(F.col("pos") / F.col("m")).cast("int")
    spread = sized.select("*", F.explode(F.array(at, at - 1)).alias("g")).where("g >= 0")
    # a repeated row finds the same anchors again; the set keeps one
    lists = spread.groupBy("doc_id", "row", "width", "last", "m", "g").agg(F.collect_set(F.struct("pos", "h")).alias("near"))
    lists = lists.where(F.size("near") * bottom >= F.col("m") * top)
    opens = lists.select("*", F.explode(F.filter("near", lambda x: F.floor(x["pos"] / F.col("m")) == F.col("g"))).alias("s"))
    inside = F.transform(F.filter("near", lambda x: (x["pos"] >= F.col("s.pos")) & (x["pos"] < F.col("s.pos") + F.col("m"))), lambda x: x["h"])
    windows = opens.select("doc_id", "row", "width", "m", F.col("s.pos").alias("start"), F.least("m", F.col("last") - F.col("s.pos")).alias("size"), inside.alias("hs"))
    windows = windows.where(F.size("hs") * bottom >= F.col("m") * top)
    windows = materialize(windows.withColumn("fp", _simhash(F.col("hs"))), "windows")
    blocks = windows.select("*", F.explode(_blocks(F.col("fp"))).alias("b"))
    known = bench.select("item", "width", "m", F.col("fp").alias("item_fp")).select("*", F.explode(_blocks(F.col("item_fp"))).alias("b"))
    met = blocks.join(broadcast_if(known, n_items * (RADIUS + 1), MOST_BROADCAST), ["width", "m", "b"])
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*[F.when(_block(differ, i) == 0, F.lit(i)) for i in range(RADIUS + 1)])
    met = met.where((F.bit_count(differ) <= RADIUS) & (first == F.col("b.i")))
    # shingles of items travel once a candidate, not once a block; the broadcast is bounded by them, 12 bytes each
    met = met.select("doc_id", "item", "start", "m", "size", "hs").join(broadcast_if(bench.select("item", "item_id", "bag"), n_shingles, MOST_BROADCAST), "item")
    found = met.select("doc_id", "item_id", "start", _shared("bag", "hs").alias("shared"), "m", "size").withColumn("of", F.col("m") + F.col("size") - F.col("shared"))
    found = found.where(F.col("shared") * bottom >= F.col("of") * top).withColumn("similarity", F.col("shared") / F.col("of"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "shared", "of")).alias("x"))
    long = lambda c: c.cast("bigint")
    return best.select("doc_id", "item_id", long(-F.col("x.back")).alias("start_word"), long(F.col("x.shared")).alias("shared"), long(F.col("x.of")).alias("of"), "x.similarity")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark item."""
    hit = materialize(contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__hit")).distinct(), "leaks")
    return docs.join(hit, docs["doc_id"] == hit["__hit"], "left_anti")


QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
SQL = {
    "op9_benchmark_decontamination": r"""
WITH dw AS (
  SELECT doc_id, hash(text) AS r, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), ish AS (
  SELECT item_id, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS m, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS sh
  FROM iw WHERE len(w) > 0
), bag AS (SELECT item_id, k, m, sh, count(*) AS c FROM ish GROUP BY ALL
), dsh AS (
  SELECT doc_id, r, k, len(w) - k + 1 AS n, unnest(range(0, len(w) - k + 1)) AS pos, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS sh
  FROM dw, (SELECT DISTINCT k FROM bag) WHERE len(w) >= k
), hit AS (SELECT DISTINCT d.doc_id, d.r, d.n, d.pos, d.sh, b.item_id, b.m, b.c FROM dsh d JOIN bag b ON d.k = b.k AND d.sh = b.sh
), win AS (
  SELECT a.doc_id, a.r, a.item_id, a.pos, a.m, least(a.m, a.n - a.pos) AS size, b.sh, least(count(DISTINCT b.pos), any_value(b.c)) AS shared
  FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.r = b.r AND a.item_id = b.item_id AND b.pos >= a.pos AND b.pos < a.pos + a.m
  GROUP BY ALL
), sim AS (
  SELECT doc_id, r, item_id, pos, sum(shared) AS shared, any_value(m + size) - sum(shared) AS of FROM win GROUP BY doc_id, r, item_id, pos
), ok AS (SELECT *, shared / of AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / of DESC, pos, shared DESC, of DESC) AS n FROM sim WHERE 5 * shared >= 4 * of)
SELECT doc_id, item_id, pos AS start_word, shared::BIGINT AS shared, of::BIGINT AS of, similarity FROM ok WHERE n = 1
""",
}
