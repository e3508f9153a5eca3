"""Operator 4: SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. If two fingerprints differ in at most 3 bits, one segment differs in
at most one, so both share that segment whole or with that bit as a wildcard: 2 x 33 keys per distinct fingerprint,
joined by equality and verified on all 64 bits. Copies meet first (one row per distinct fingerprint); a key of two
members is a pair at once; a key of up to HOT members yields a spanning set of verified links, not its pairs; a hotter
key is cut again by the other segment's two halves (one of which differs in at most one bit), and one that is still hot by the
quarters of the half left, after which a key has at most 2^11 fingerprints, however large the table. Links are joined into components by alternating
large-star and small-star rounds on checkpointed edges.

Null text counts as empty; all texts without a word have fingerprint zero and link to each other. A repeated row is its
own copy. Rows with a null doc_id get the component of their group, null if the group has no other id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from turnmill.llm.common import broadcast_if, discard, materialize, settle, table

SHINGLE, RADIUS, SEED, HOT = 3, 3, 42, 2048
#: The pipeline stage, beside RADIUS: words of a shingle, least similarity, MinHash keys and minima of each, sets of a key that are all compared.
NEAR_SHINGLE, SIMILARITY, BANDS, ROWS, CROWD = 5, 0.8, 24, 5, 2
#: Sizes of sets within this factor share a bucket of the prefix join.
_GROWTH = 1.05
_STEP = 1 << 16
_ODD = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, 2 * BANDS * ROWS, np.uint64) | np.uint64(1)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    from_, to = starts[:n].tolist(), ends[width - 1 :].tolist()
    for i in range(0, n, _STEP):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(from_[i : i + _STEP], to[i : i + _STEP])], np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, __fp) of every row."""

    def of(text: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x or b"", shingle) for x in text.cast(pa.binary()).to_pylist()], pa.int64())

    return docs.select("doc_id", F.arrow_udf(of, "bigint")(F.col("text")).alias("__fp"))


def _bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _variants(fp: Column, parts: tuple[int, ...], width: int) -> Column:
    """(key, bit) of each part whole, bit 2, and with each bit cleared, bit whether it was set."""
    out = []
    for p, low in enumerate(parts):
        value = _bits(fp, low, width)
        for w in range(width + 1):
            tag, mask = (p * (width + 1) + w) << width, (1 << width) - 1 - ((1 << w) if w < width else 0)
            bit = _bits(fp, low + w, 1) if w < width else F.lit(2).cast("bigint")
            out.append(F.struct(F.lit(tag).cast("bigint").bitwiseOR(value.bitwiseAND(F.lit(mask))).alias("key"), bit.alias("bit")))
    return F.array(*out)


def _roots(v: np.ndarray) -> np.ndarray:
    """Per fingerprint the index of the first one it reaches by links of at most RADIUS bits. Blocks bound the memory."""
    label, step = np.arange(len(v)), max(1, (1 << 22) // len(v))
    while True:
        low = label.copy()
        for i in range(0, len(v), step):
            near = np.bitwise_count(v[i : i + step, None] ^ v[None, :]) <= RADIUS
            low[i : i + step] = np.where(near, label[None, :], len(v)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _spanning(members: pa.Array) -> pa.Array:
    """Per list of fingerprints: links (a, b) that connect whatever links of at most RADIUS bits connect."""
    out = []
    for group in members.to_pylist():
        v = np.unique(np.array(group, np.int64))
        roots = _roots(v.view(np.uint64))
        out.append([{"a": a, "b": b} for a, b in zip(v[roots].tolist(), v.tolist()) if a != b])
    return pa.array(out, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))


def _keyed_links(keyed: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Links of rows (key, bit, fp) that meet in a key of at most `most` members, and the hotter keys."""
    met = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("bit").alias("ones"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    # whole segments count 2 each; a wildcard only matters where its bit differs, equal bits meet in the whole segment
    met = materialize(met.where("n > 1 AND (ones = 2 * n OR ones > 0 AND ones < n)"), "simhash-keys")
    pairs = met.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    some = met.where("n > 2" + (f" AND n <= {most}" if most else "")).select("key")
    lists = keyed.join(some, "key").groupBy("key").agg(F.collect_list("fp").alias("members"))
    spans = lists.select(F.explode(F.arrow_udf(_spanning, "array<struct<a:bigint,b:bigint>>")(F.col("members"))).alias("l")).select("l.a", "l.b")
    return pairs.union(spans), (met.where(F.col("n") > most).select("key") if most else None)


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column fp that connect all pairs within RADIUS bits."""
    # a fingerprint grows to 66 rows: the few files of a compact table are dealt to all tasks first
    dealt = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keyed = dealt.select("fp", F.explode(_variants(F.col("fp"), (0, 32), 32)).alias("v")).select("fp", "v.key", "v.bit")
    found, hot = _keyed_links(keyed, HOT)
    n_hot = hot.count()
    if n_hot:
        inside = keyed.join(broadcast_if(hot, n_hot, 1 << 20), "key")
        # key < 2^39; the part not in the key is cut into 16-bit halves with 2 x 17 variants
        sub = inside.withColumn("v", F.explode(_variants(_outside(F.col("key")), (0, 16), 16))).select("fp", F.shiftleft("key", 22).bitwiseOR(F.col("v.key")).alias("key"), F.col("v.bit").alias("bit"))
        more, hot = _keyed_links(sub, HOT)
        found, n_hot = found.union(more), hot.count()
    if n_hot:
        inside = sub.join(broadcast_if(hot, n_hot, 1 << 20), "key")
        # the half not in the key, in quarters with 2 x 9 variants: what is left free is a quarter and three wildcards
        half = F.col("key").bitwiseAND(F.lit((1 << 22) - 1))
        other = _outside(F.shiftrightunsigned("key", 22))
        left = F.when(F.shiftright(half, 16) < 17, _bits(other, 16, 16)).otherwise(_bits(other, 0, 16))
        last = inside.withColumn("v", F.explode(_variants(left, (0, 8), 8))).select("fp", F.xxhash64("key", "v.key").alias("key"), F.col("v.bit").alias("bit"))
        found = found.union(_keyed_links(last, None)[0])
    return found.distinct()


def _outside(key: Column) -> Column:
    """The 32-bit segment of fp that a first key does not hold."""
    return F.when(F.shiftright(key, 32) < 33, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit((1 << 32) - 1)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b): root is the smallest node it reaches."""
    seen, now = None, materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = now.union(now.select("v", "u"))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        then = materialize(small, "small")
        for old in (now, low, large):
            discard(old)
        now = then


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, __fp, component_id) for every row of docs."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    first = materialize(prints.groupBy("__fp").agg(F.min("doc_id").alias("id")), "distinct")
    linked = links(first.select(F.col("__fp").alias("fp")))
    a, b = first.select(F.col("__fp").alias("a"), F.col("id").alias("ida")), first.select(F.col("__fp").alias("b"), F.col("id").alias("idb"))
    edges = linked.join(a, "a").join(b, "b").where("ida IS NOT NULL AND idb IS NOT NULL").select(F.col("ida").alias("a"), F.col("idb").alias("b"))
    roots = components(edges)
    named = materialize(first.join(roots, F.col("id") == F.col("node"), "left").select("__fp", F.coalesce("root", "id").alias("component_id")), "components")
    return prints.join(named, "__fp")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes of a text's runs of NEAR_SHINGLE words; of fewer words the whole sequence is one run."""
    words = text.lower().split()
    width = min(NEAR_SHINGLE, len(words))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1 if words else 0)], np.uint64))


def set_fingerprint(shingles: np.ndarray) -> int:
    """A bit is 1 if set in over half of a set's hashes."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(shingles), _STEP):
        votes += np.unpackbits(shingles[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(shingles), bitorder="little").view(np.int64)[0])


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of the shingle sets; 1 if both are empty."""
    x, y = shingle_set(a), shingle_set(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def bands(shingles: np.ndarray) -> list[int]:
    """BANDS keys of ROWS minima each."""
    if not len(shingles):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), _STEP):
        part = shingles[i : i + _STEP]
        for k in range(BANDS * ROWS):
            z = part * _ODD[k]
            low[k] = min(low[k], ((z ^ (z >> np.uint64(29))) * _ODD[-1 - k]).min())
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(low.reshape(BANDS, ROWS))]


def _sketch(text: pa.Array) -> pa.Array:
    out = []
    for x in text.cast(pa.binary()).to_pylist():
        s = shingle_set(x or b"")
        out.append({"set": xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63), "size": len(s), "fp": set_fingerprint(s), "bands": bands(s)})
    return pa.array(out, pa.struct([("set", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))]))


def _shingles(text: pa.Array) -> pa.Array:
    return pa.array([shingle_set(x or b"").view(np.int64) for x in text.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))


def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    both = zip(a.cast(pa.binary()).to_pylist(), b.cast(pa.binary()).to_pylist())
    return pa.array([similarity(x or b"", y or b"") >= SIMILARITY for x, y in both], pa.bool_())


def _asked_texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of docs whose text hash is probably that of an asked row (th), by a broadcast bitmap of at most 8 MB at any size; true rows all stay.

    It keeps the texts of documents without candidates out of the shuffle of the join that follows.
    """
    slot, bit = (lambda h: F.pmod(h, F.lit(2048)).alias("__slot")), (lambda h: F.pmod(F.shiftright(h, 11), F.lit(32768)))
    maps = asked.select(slot(F.col("th")), bit(F.col("th")).alias("p")).groupBy("__slot").agg(F.bitmap_construct_agg("p").alias("__map"))
    at = bit(F.col("text_hash"))
    byte = F.conv(F.hex(F.substring(F.col("__map"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = (slot(F.col("text_hash")) == F.col("__slot")) & (F.call_function("bit_get", byte, F.pmod(at, F.lit(8)).cast("int")) == 1)
    return docs.join(F.broadcast(maps), hit, "left_semi")


def _texts_of(asked: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(set, text) of the asked sets; a set (set, id, th) has the text of the row with that id and text hash. Only their texts are shuffled."""
    asked = materialize(sets.select("set", "id", "th").join(asked, "set", "left_semi"), "candidate-sets")
    from_ = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    texts = asked.join(_asked_texts(from_, asked), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("text_hash"))).select("set", "text").dropDuplicates(["set"])
    texts = materialize(texts, "candidate-texts")
    discard(asked)
    return texts


def _verified(pairs: DataFrame, texts_of) -> DataFrame:
    """The pairs (a, b) of sets whose texts are similar; texts_of gives (set, text) of asked sets."""
    pairs = materialize(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    texts = texts_of(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct())
    a, b = texts.select(F.col("set").alias("a"), F.col("text").alias("ta")), texts.select(F.col("set").alias("b"), F.col("text").alias("tb"))
    found = materialize(pairs.join(a, "a").join(b, "b").where(F.arrow_udf(_similar, "boolean")("ta", "tb")).select("a", "b"), "similar")
    for done in (pairs, texts):
        discard(done)
    return found


def _near_size(a: Column, b: Column) -> Column:
    """Whether sets of so many shingles can be similar at all."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(SIMILARITY) - F.lit(1e-6)


def _bucket(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / F.lit(float(np.log(_GROWTH))) + F.lit(1e-9)).cast("int")


def prefix_pairs(rooted: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets in different components, among them every similar one: (set, root) of each set, (set, text) of each.

    The shingles of all sets have one order, rare ones first. Sets of n <= m shingles that are similar have at least
    o = SIMILARITY / (1 + SIMILARITY) x (n + m) in common, so the first one they share stands among the first n - o + 1 and m - o + 1. Such heads
    are joined by shingle and size, each head entry with only the sizes that its place allows. Edits make rare shingles, which fill
    the heads of a copy that is edited much, so such copies of one text do not meet. Heads of one component do not meet either.
    """
    part = SIMILARITY / (1 + SIMILARITY)
    shingled = materialize(texts.select("set", F.explode(F.arrow_udf(_shingles, "array<bigint>")(F.col("text"))).alias("h")), "shingles")
    often = shingled.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ranked = shingled.join(often, "h", "left").groupBy("set").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "h"))).alias("l"))
    n, at = F.size("l"), F.col("i")
    head = (n - F.ceil(n * F.lit(SIMILARITY) - F.lit(1e-6)) + 1).cast("int")
    ranked = ranked.join(rooted, "set").select("set", "root", n.alias("n"), F.posexplode(F.slice("l", 1, head)).alias("i", "x"))
    heads = materialize(ranked.where("x.df > 1").select(F.col("x.h").alias("h"), "set", "root", "n", "i"), "heads")
    discard(shingled)
    most = F.least(F.col("n").cast("double"), (F.col("n") - at) / F.lit(part) - F.col("n") + F.lit(1e-6))
    least = F.ceil(F.col("n") * F.lit(SIMILARITY) - F.lit(1e-6))
    small = heads.where(at <= F.col("n") - F.col("n") * F.lit(2 * part) + F.lit(1e-6)).select("h", _bucket(F.col("n")).alias("b"), F.col("set").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), at.alias("ia"))
    large = heads.where(most >= least).select("h", F.explode(F.sequence(_bucket(least), _bucket(most))).alias("b"), F.col("set").alias("b_"), F.col("root").alias("rb"), F.col("n").alias("nb"), at.alias("ib"))
    both = small.select("h", "b", F.col("ra").alias("root")).union(large.select("h", "b", F.col("rb").alias("root"))).groupBy("h", "b", "root").count()
    mixed = both.groupBy("h", "b").agg(F.max(F.struct("count", "root")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("h", "b", F.col("m.root").alias("main"))
    mixed = materialize(mixed, "mixed-keys")
    small, large = small.join(mixed, ["h", "b"]), large.join(mixed, ["h", "b"]).drop("main")
    need = (F.col("na") + F.col("nb")) * F.lit(part) - F.lit(1e-6)
    fits = (F.col("ra") != F.col("rb")) & (F.col("na") <= F.col("nb")) & (F.col("na") - F.col("ia") >= need) & (F.col("nb") - F.col("ib") >= need)
    pairs = lambda x, y: x.join(y, ["h", "b"]).where(fits).select("a", F.col("b_").alias("b"))
    main_small, main_large = small.where("ra = main"), large.join(mixed, ["h", "b"]).where("rb <> main").drop("main")
    found = materialize(pairs(small.where("ra <> main"), large).union(pairs(main_small, main_large)), "prefix-pairs")
    for done in (heads, mixed):
        discard(done)
    return found


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of the sets (set, fp) that connect whatever fingerprints within RADIUS bits connect: by the deletion variants of op4."""
    first = materialize(sets.groupBy("fp").agg(F.min("set").alias("first")), "set-fingerprints")
    same = sets.join(first, "fp").where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))
    a, b = first.select(F.col("fp").alias("a"), F.col("first").alias("sa")), first.select(F.col("fp").alias("b"), F.col("first").alias("sb"))
    near = links(first.select("fp")).join(a, "a").join(b, "b").select(F.col("sa").alias("a"), F.col("sb").alias("b"))
    pairs = materialize(same.union(near), "fingerprint-pairs")
    discard(first)
    return pairs


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that no link found so far connects."""
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, set, component) for every row of docs (doc_id, text): texts of similarity SIMILARITY or more are linked.

    Rows of one shingle set meet first. Then come the sets' 64-bit SimHash fingerprints: the deletion variants give links that connect all
    sets within RADIUS bits. At similarity 0.8 fingerprints differ by 7 to 10 bits, more than deletion variants can reach, so MinHash goes on from there: two sets
    of similarity 0.8 share one of the BANDS keys with probability 0.9999, more above. A key of up to CROWD sets gives all its pairs; the sets of a larger key are
    compared with its most central set, the one whose keys hold most sets. Pairs that are connected already are not compared again. The sets of those keys,
    and of those fingerprint groups, that still are in several components go through an exact prefix join, which gives the pairs of different
    components that can be similar. Every link is verified on the whole texts.
    """
    kind = "struct<set:bigint,size:bigint,fp:bigint,bands:array<bigint>>"
    rows = materialize(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.arrow_udf(_sketch, kind)(F.col("text")).alias("s")).select("doc_id", "text_hash", "s.set", "s.size", "s.fp", "s.bands"), "sketches")
    sets = rows.groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("r"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    sets = materialize(sets.select("set", F.col("r.doc_id").alias("id"), F.col("r.text_hash").alias("th"), "size", "fp", "bands"), "sets")
    asked = fingerprint_pairs(sets.select("set", "fp"))
    grouped = components(asked).select(F.col("root").alias("key"), F.col("node").alias("set"))
    near = _verified(asked, lambda some: _texts_of(some, sets, docs))
    roots = components(near)
    settle(docs.sparkSession)
    keyed = sets.select("set", "size", F.explode("bands").alias("key"))
    met = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "band-keys")
    few = keyed.join(met.where(F.col("n") <= CROWD).select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("set", "size"))).alias("m"))
    few = few.select("m").distinct().select("m", F.posexplode("m").alias("i", "a")).select("a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b"))
    few = few.where(_near_size(F.col("a.size"), F.col("b.size"))).select(F.col("a.set").alias("a"), F.col("b.set").alias("b"))
    crowd = materialize(keyed.join(met.where(F.col("n") > CROWD).select("key", "n"), "key"), "crowded")
    central = crowd.groupBy("set", "size").agg(F.sum("n").alias("degree"), F.collect_list("key").alias("keys"))
    central = central.select("set", "size", "degree", F.explode("keys").alias("key")).groupBy("key").agg(F.max(F.struct("degree", "set", "size")).alias("c"))
    star = crowd.join(central, "key").where(_near_size(F.col("size"), F.col("c.size"))).select(F.col("c.set").alias("a"), F.col("set").alias("b"))
    found = near.union(_verified(_apart(few.union(star).distinct(), roots), lambda some: _texts_of(some, sets, docs)))
    roots = components(found)
    settle(docs.sparkSession)
    together = crowd.select("key", "set").union(grouped)
    named = materialize(together.join(roots, F.col("set") == F.col("node"), "left").select("key", "set", F.coalesce("root", "set").alias("root")), "crowd-roots")
    open_ = named.join(named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key"), "key", "left_semi")
    open_ = materialize(open_.select("set", "root").distinct(), "open-sets")
    if open_.limit(1).count():
        texts = _texts_of(open_.select("set"), sets, docs)
        pairs = prefix_pairs(open_, texts)
        found = found.union(_verified(pairs, lambda asked: texts.join(asked, "set", "left_semi")))
        discard(pairs)
        discard(texts)
        roots = components(found)
    for done in (asked, met, crowd, named, sets):
        discard(done)
    settle(docs.sparkSession)
    return rows.join(roots, F.col("set") == F.col("node"), "left").select("doc_id", "text_hash", "set", F.coalesce("root", "set").alias("component"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five words, similarity 0.8 or more, unlike op4.

    The row with the smallest doc_id stays, a null doc_id only where the group has no other; of rows that share it, the one with
    the smallest hash of its text. Rows that share a doc_id but are not similar are groups of their own.
    """
    found = similar_groups(docs.select("doc_id", "text"))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_hash")).alias("r"))
    keep = materialize(first.select(F.col("r.doc_id").alias("__keep"), F.col("r.text_hash").alias("__kept_hash")), "kept")
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    left = hashed.join(keep, hashed["doc_id"].eqNullSafe(keep["__keep"]) & (hashed["__hash"] == keep["__kept_hash"]), "left_semi")
    order = Window.partitionBy("doc_id", "__hash").orderBy("text")
    return left.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__hash")


QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
SQL: dict[str, str] = {}
