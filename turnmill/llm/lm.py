"""Operator 6: language-model scoring with a hierarchical Pitman-Yor bigram model.

Tokens are words [^\\x20\\x09-\\x0D]+ of A-Z lower-cased texts and one end per document. Each previous token is a restaurant, all
share the unigram restaurant as parent, whose base is uniform. Customers are the training bigrams. A Gibbs step removes all
customers of a (restaurant, dish) and seats them anew given everyone else: their number of tables t is drawn from its exact
conditional, proportional to S(c, t) x product over i < t of (strength + discount x (other tables + i)) x parent probability^t, where S are
the generalised Stirling numbers of c customers. Predictions depend on seatings through t alone, so only t is kept and
travels. Other dishes' tables and the parent are those of the last sweep, so rows are sampled in parallel. The parent
reseats the tables it received. After BURN sweeps, the predictive probabilities of SAMPLES sweeps are averaged.

Every training word is a dish and has a restaurant, however rare; a word that training lacks has no restaurant and, as a dish, one share of
the uniform base. Bounded tables are broadcast: the LOOKUP most frequent words, sums of theirs, and bigrams of theirs with at least 1/BIGRAMS of all tokens. All other words and bigrams meet the documents and each other in shuffles by 64-bit hash or key, where
no key is frequent; bigrams travel in compressed blobs, sorted, of one part of the keys each.

Null text is empty (one token, the end). A null doc_id counts as the empty string for the split. Repeated rows are documents of their own. With no training
rows all probabilities are the uniform base. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import discard, materialize, settle, table

#: Words of the lookup table at most; share of all tokens from which a bigram is broadcast.
LOOKUP, BIGRAMS = 300_000, 2_000_000
DISCOUNTS, STRENGTHS, BURN, SAMPLES, SEED = (0.6, 0.8), (1.0, 2.0), 2, 3, 42
#: Customers up to which Stirling numbers are tabulated, 8 MB a discount.
STIRLING = 1024
END = b"\n"
_BATCH, _ROWS = 8 << 20, 1 << 15
#: Training tokens for each part of the bigrams that are counted or read together; parts at least.
COUNTED, READ, PARTS = 2_500_000, 20_000_000, 24
_U = np.uint64


def _uniform(key: np.ndarray, stream: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and stream only: retries and other layouts sample the same."""
    with np.errstate(over="ignore"):
        z = key.astype(_U) * _U(0x9E3779B97F4A7C15) + _U((stream * 0xBF58476D1CE4E5B9 + SEED) & (2**64 - 1))
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        z ^= z >> _U(31)
    return ((z >> _U(11)).astype(np.float64) + 0.5) / 2.0**53


@lru_cache
def _log_stirling(discount: float) -> np.ndarray:
    """log S(c, t) for c, t up to STIRLING: S(c + 1, t) = S(c, t - 1) + (c - discount x t) S(c, t)."""
    t = np.arange(STIRLING + 1)
    out = np.full((STIRLING + 1, STIRLING + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(STIRLING):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def _negative_binomial(key: np.ndarray, stream: int, r: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Draws with weights Gamma(r + x) / x! p^x: by inversion, and by the normal quantile with its skewness term where the variance is 400 or more."""
    u, mean = _uniform(key, stream), r * p / (1 - p)
    var, out = mean / (1 - p), np.zeros(len(r))
    big = var >= 400
    z = np.sqrt(-2 * np.log(u[big])) * np.cos(2 * np.pi * _uniform(key[big], stream + 500_009))
    out[big] = np.maximum(np.rint(mean[big] + np.sqrt(var[big]) * z + (1 + p[big]) / (1 - p[big]) * (z * z - 1) / 6), 0)
    at = np.flatnonzero(~big)
    left, mass, x = u[at], np.exp(r[at] * np.log1p(-p[at])), 0
    while len(at):
        left = left - mass
        out[at] = x
        go = (left > 0) & (x < mean[at] + 12 * np.sqrt(var[at]) + 50)
        at, left, mass = at[go], left[go], mass[go]
        mass = mass * (r[at] + x) / (x + 1) * p[at]
        x += 1
    return out


def _many_tables(c: np.ndarray, r: np.ndarray, p: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of t where tables are many, by the saddle point of the generating function of c, (1 - p + p (1 - x)^d)^-r."""
    low, high = np.full(len(c), -60.0), np.zeros(len(c))
    for _ in range(80):  # y = 1 - x solves x d/dx log = c
        middle = (low + high) / 2
        y = np.exp(middle)
        over = (1 - y) * r * p * d * y ** (d - 1) / (1 - p + p * y**d) > c
        low, high = np.where(over, middle, low), np.where(over, high, middle)
    y = np.exp((low + high) / 2)
    x, h = 1 - y, 1 - y**d
    q = p * h
    mean = r * q / (1 - q)
    var, size = mean / (1 - q), x * d * y ** (d - 1) / h
    spread = x * x * d * (1 - d) * y ** (d - 2) / h + size - size * size
    return mean + 1, np.sqrt(np.maximum(var - (size * var) ** 2 / (mean * spread + size * size * var), 0))


def seat(key: np.ndarray, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, strength: float, stream: int) -> np.ndarray:
    """Tables after seating `customers` of one dish per row anew, beside `others` tables of the restaurant's other dishes.

    Up to STIRLING customers t is drawn from the conditional with exact Stirling numbers. For more, S(c, t) is, but for a
    factor without t, discount^-t / (t - 1)! x (1 + (t - 1) e + ...), e = -Gamma(-d) / (2 Gamma(-2d)) x c^-d: while (t - 1) e is small, t - 1 is negative
    binomial at parent x exp(e). Where it is not, t is large and normal about the saddle point. All three stand for the same
    conditional; a test holds their means to the full recursion within 1 %.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    log_s, u = _log_stirling(discount), _uniform(key, stream * 1_000_003)
    weight = strength + discount * others
    some = np.flatnonzero((customers > 1) & (customers <= STIRLING))
    some = some[np.argsort(customers[some], kind="stable")]
    cuts = np.flatnonzero(np.diff(customers[some])) + 1
    for rows in np.split(some, cuts) if len(some) else []:
        c = int(customers[rows[0]])
        for at in np.array_split(rows, -(-len(rows) * c // (1 << 19))):
            i = np.arange(c)
            log_w = np.cumsum(np.log(weight[at, None] + discount * i) + np.log(parent[at, None]), axis=1) + log_s[c, 1 : c + 1]
            share = np.cumsum(np.exp(log_w - log_w.max(axis=1, keepdims=True)), axis=1)
            tables[at] = 1 + (share < u[at, None] * share[:, -1:]).sum(axis=1)
    at = np.flatnonzero(customers > STIRLING)
    if len(at):
        e = -math.gamma(-discount) / (2 * math.gamma(-2 * discount)) * customers[at].astype(float) ** -discount
        p, r = np.minimum(parent[at] * np.exp(e), 1 - 1e-9), weight[at] / discount
        many = e * (r + 1) * p / (1 - p) >= 0.3
        few, at = at[~many], at[many]
        drawn = 1 + _negative_binomial(key[few], stream * 1_000_003 + 1, r[~many] + 1, p[~many])
        tables[few] = np.minimum(drawn, customers[few])
        mean, sd = _many_tables(customers[at].astype(float), r[many], np.minimum(parent[at], 1 - 1e-9), discount)
        z = np.sqrt(-2 * np.log(u[at])) * np.cos(2 * np.pi * _uniform(key[at], stream * 1_000_003 + 2))
        tables[at] = np.clip(np.rint(mean + sd * z), 1, customers[at])
    return tables.astype(np.int64)


def _release() -> None:
    """Give back what a worker's earlier tasks left allocated, by Arrow and by malloc."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def _texts(batches: Iterator[pa.RecordBatch], most: int = _BATCH) -> Iterator[tuple[list, list[bytes]]]:
    """(first column, texts) in batches balanced by bytes, of at most _ROWS."""
    _release()
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            ids.append(i)
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= most or len(ids) == _ROWS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _split(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The words of all texts in a row, lower-cased, and the number of words of each."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string())))
    words = found.flatten().view(pa.large_binary())
    there = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty one
    before = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))
    return words.filter(there), np.diff(before[found.offsets.to_numpy()])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of training documents, END among the words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches, 2 * _BATCH):
            values, counts = _split(texts)[0].value_counts().flatten()
            yield pa.RecordBatch.from_arrays([values.cast(pa.binary()), counts], names=["word", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([len(ids)], pa.int64())], names=["word", "c"])

    return docs.select("doc_id", "text").mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def cold_id(word: bytes) -> int:
    """A word outside the lookup table: below 0, by its hash. The same in Spark: -(xxhash64(word) >>> 1) - 1."""
    return -(xxhash.xxh64_intdigest(word, SEED) >> 1) - 1


class Vocabulary:
    """Every word has an id: of the lookup table by falling count from 1 on, then the end and the start; others have a cold_id. 0 is no word."""

    def __init__(self, words: list[bytes], counts: list[int], n: int, v: int, end: int, least: int):
        self.words = pa.array(words, pa.large_binary())
        self.counts, self.n, self.v, self.end, self.least, self.width = np.array([0, *counts], np.int64), n, v, end, least, len(words) + 3

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts in a row and the number of words of each."""
        words, lengths = _split(texts)
        ids = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64) + 1
        cold = words.filter(pa.array(ids == 0)).dictionary_encode()
        ids[ids == 0] = np.array([cold_id(w) for w in cold.dictionary.to_pylist()], np.int64)[cold.indices.to_numpy()]
        return ids, lengths

    def pairs(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Previous token, token and document of every place, ends included."""
        n, stops = len(lengths), np.cumsum(lengths + 1) - 1
        seq = np.full(len(ids) + n, self.width - 2, np.int64)
        inner = np.ones(len(seq), bool)
        inner[stops] = False
        seq[inner] = ids
        before = np.empty_like(seq)
        before[1:] = seq[:-1]
        before[stops - lengths] = self.width - 1
        return before, seq, np.repeat(np.arange(n), lengths + 1)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The lookup table has all words from a count on, the lowest that leaves at most LOOKUP of them."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    end = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    found = counts.where(F.col("word") != F.lit(END))
    # few rows: n tokens have at most sqrt(2 n) different counts
    sizes = found.groupBy("c").agg(F.count("*").alias("words")).toArrow().sort_by([("c", "descending")])
    fit = sizes["c"].to_numpy()[np.cumsum(sizes["words"].to_numpy()) <= LOOKUP]
    least = int(fit.min(initial=n + 1))
    top = found.where(F.col("c") >= least).orderBy(F.desc("c"), "word").toArrow()
    return Vocabulary(top["word"].to_pylist(), top["c"].to_pylist(), n, v, end, least)


def cold_words(counts: DataFrame, least: int) -> DataFrame:
    """(id, n) of all words outside the lookup table."""
    cold = counts.where((F.col("c") < least) & (F.col("word") != F.lit(END)))
    return cold.select((-F.shiftrightunsigned(F.xxhash64("word"), 1) - 1).alias("id"), F.col("c").alias("n"))


def _unique(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows, by the first of three columns, and how often each stands; a row may seldom come in several parts."""
    mixed = np.zeros(len(columns[0]), _U)
    with np.errstate(over="ignore"):
        for x in columns[-2:]:
            mixed = (mixed ^ x.astype(_U)) * _U(0x9E3779B97F4A7C15)
            mixed ^= mixed >> _U(29)
    if len(columns) > 2:
        bits = _U(max(int(columns[0].max(initial=0)).bit_length(), 1))
        mixed = (columns[0].astype(_U) << (_U(64) - bits)) | (mixed >> bits)
    order = np.argsort(mixed)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(np.concatenate((first, [len(order)])))


def _key(u, w, width: int):
    """Of a bigram: u x width + w if both stand in the lookup table, else below 0 by their hash."""
    return F.when((u >= 0) & (w >= 0), u * F.lit(width) + w).otherwise(-F.shiftrightunsigned(F.xxhash64(u, w), 1) - 1)


def _mixed(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (u.astype(_U) * _U(0x9E3779B97F4A7C15)) ^ w.astype(_U)
        z = (z ^ (z >> _U(29))) * _U(0xBF58476D1CE4E5B9)
        return z ^ (z >> _U(32))


class Parts:
    """Bigram keys of the lookup table in a mixed order, a bijection of the numbers below 2^bits, cut into parts of about the same size.

    Keys travel as the gaps of a sorted run, in compressed byte planes: 2 to 3 bytes each instead of a row.
    """

    def __init__(self, width: int, count: int):
        self.width, self.count, self.bits = width, count, max((width * width - 1).bit_length(), 1)
        self.mask, self.factor = _U(2**self.bits - 1), 0x9E3779B97F4A7C15 % 2**self.bits | 1
        self.inverse = pow(self.factor, -1, 2**self.bits)
        self.bounds = np.array([-(-i * 2**self.bits // count) for i in range(count + 1)], _U)

    def mix(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(_U) * _U(self.factor)) & self.mask

    def keys(self, mixed: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((mixed * _U(self.inverse)) & self.mask).astype(np.int64)

    def cut(self, mixed: np.ndarray) -> Iterator[tuple[int, slice]]:
        """(part, place) of the parts that a sorted run touches."""
        at = np.searchsorted(mixed, self.bounds)
        yield from ((int(i), slice(at[i], at[i + 1])) for i in np.flatnonzero(np.diff(at)))


def _cut_cold(run: np.ndarray, count: int) -> Iterator[tuple[int, slice]]:
    """The same for a sorted run of cold words, each as -(id + 1), which is a hash below 2^63."""
    at = np.searchsorted(run, np.array([*(-(-i * 2**63 // count) for i in range(count)), 2**63], _U))
    yield from ((int(i), slice(at[i], at[i + 1])) for i in np.flatnonzero(np.diff(at)))


def _pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """xxhash64(u, w) >>> 1 as Spark computes it, which is -(key + 1) of a bigram with a cold word."""
    p1, p2, p3, p4, p5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << _U(n)) | (x >> _U(64 - n))
    z = np.full(len(u), 42, _U)
    with np.errstate(over="ignore"):
        for x in (u, w):
            z = z + p5 + _U(8)
            z = turn(z ^ (turn(x.astype(_U) * p2, 31) * p1), 27) * p1 + p4
            z = (z ^ (z >> _U(33))) * p2
            z = (z ^ (z >> _U(29))) * p3
            z = z ^ (z >> _U(32))
    return z >> _U(1)


def _pack(run: np.ndarray, *columns: np.ndarray) -> bytes:
    """A sorted run and columns beside it as compressed byte planes, for each column after a byte that says how many: high bytes of 0 are left out."""
    gaps = np.diff(run, prepend=run[:1])
    gaps[0] = run[0]
    out = []
    for c in map(np.ascontiguousarray, (gaps, *columns)):
        size = c.itemsize if c.dtype.kind == "f" else -(-int(c.view(f"u{c.itemsize}").max()).bit_length() // 8)
        out += [bytes([size]), c.view(np.uint8).reshape(len(c), c.itemsize)[:, :size].T.tobytes()]
    plain = b"".join(out)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _unpack(blob, n: int, *kinds) -> list[np.ndarray]:
    blob = memoryview(blob)
    flat, at, out = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd"), np.uint8), 0, []
    for k in (np.dtype(k) for k in (_U, *kinds)):
        size = int(flat[at])
        c = np.zeros((n, k.itemsize), np.uint8)
        c[:, :size] = flat[at + 1 : at + 1 + n * size].reshape(size, n).T
        out.append(c.view(k)[:, 0])
        at += 1 + n * size
    return [np.cumsum(out[0], dtype=_U), *out[1:]]


_BLOB_KIND = "part int, kind int, n bigint, row bigint, blob binary"
_BLOBS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("row", pa.int64()), ("blob", pa.binary())])


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _BLOBS)], schema=_BLOBS)


def _gathered(blobs: DataFrame) -> DataFrame:
    """Blobs of a part behind each other, by kind."""
    return blobs.repartition("part").sortWithinPartitions("part", "kind")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(part, (kind, n, row, blob) ...) of gathered blobs."""
    _release()
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() if i < 4 else b.column(i) for i in range(5))))
    for part, own in groupby(rows, lambda r: r[0]):
        yield part, ((kind, n, row, blob.as_buffer()) for _, kind, n, row, blob in own)


def _sums(values: np.ndarray, c: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows the sum of counts of each value, and whether a count is 0: where a value begins, new is true."""
    first = np.flatnonzero(new)
    return (np.add.reduceat(c, first), np.minimum.reduceat(c, first) == 0) if len(first) else (np.zeros(0, np.int64), np.zeros(0, bool))


def _new(*sorted_columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)
    return new


def count_bigrams(docs: DataFrame, vocab) -> DataFrame:
    """(key, c, u, w) of the bigrams of training documents: all seen twice or more, and of the others those that held-out documents ask for or
    that are broadcast. The words u and w stand only where key doesn't hold them.

    Batches send their distinct bigrams to the parts as blobs: kind 0 of the lookup table by mixed key, kind 1 with a cold word, by both words.
    """
    width, n = vocab.value.width, vocab.value.n
    parts = Parts(width, max(PARTS, -(-n // COUNTED)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for doc_ids, texts in _texts(batches):
            of_doc = np.array([_held_out(d) for d in doc_ids], bool)
            before, seq, doc = v.pairs(*v.ids(texts))
            for held in (False, True):
                some = of_doc[doc] == held
                u, w = before[some], seq[some]
                hot = (u >= 0) & (w >= 0)
                run, c = np.unique(parts.mix(u[hot] * width + w[hot]), return_counts=True)
                c = (c * (not held)).astype(np.int64)
                rows = [(part, 0, len(run[at]), 0, _pack(run[at], c[at])) for part, at in parts.cut(run)]
                (u, w), c = _unique(u[~hot], w[~hot])
                c = (c * (not held)).astype(np.int64)
                of = (_mixed(u, w) % _U(parts.count)).astype(np.int64)
                order = np.lexsort((w, u, of))
                u, w, c, of = u[order], w[order], c[order], of[order]
                ends = np.searchsorted(of, np.arange(parts.count + 1))
                for part in np.flatnonzero(np.diff(ends)):
                    at = slice(ends[part], ends[part + 1])
                    # ids below 0 sort as signed numbers; gaps wrap around and back
                    rows.append((int(part), 1, at.stop - at.start, 0, _pack(u[at].view(_U), w[at], c[at])))
                yield _blobs(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(sums, asked):
            return (sums > 1) | (sums == 1) & (asked | (sums * BIGRAMS >= n))

        def out(keys, c, u, w):
            none = pa.nulls(len(c), pa.int64())
            columns = [none if x is None else pa.array(x) for x in (keys, c, u, w)]
            yield from pa.table(columns, names=["key", "c", "u", "w"]).to_batches(max_chunksize=1 << 16)

        for _, blobs in _by_part(batches):
            hot, cold = [], []
            for kind, size, _, blob in blobs:
                (cold if kind else hot).append(_unpack(blob, size, *([np.int64] * (1 + kind))))
            if hot:
                run, c = (np.concatenate(x) for x in zip(*hot))
                hot.clear()
                free = 64 - parts.bits
                if free > 8 and int(c.max()) < 1 << free:  # key and count sort as one number
                    both = np.sort((run << _U(free)) | c.astype(_U))
                    run, c = both >> _U(free), (both & _U((1 << free) - 1)).astype(np.int64)
                else:
                    order = np.argsort(run)
                    run, c = run[order], c[order]
                new = _new(run)
                sums, asked = _sums(run, c, new)
                keep = kept(sums, asked)
                yield from out(parts.keys(run[new][keep]), sums[keep], None, None)
            if cold:
                u, w, c = (np.concatenate(x) for x in zip(*cold))
                cold.clear()
                u = u.view(np.int64)
                order = np.lexsort((w, u))
                u, w, c = u[order], w[order], c[order]
                new = _new(u, w)
                sums, asked = _sums(u, c, new)
                keep = kept(sums, asked)
                yield from out(None, sums[keep], u[new][keep], w[new][keep])

    blobs = docs.select("doc_id", "text").mapInArrow(send, _BLOB_KIND)
    found = _gathered(blobs).mapInArrow(count, "key bigint, c bigint, u bigint, w bigint")
    return found.select(F.coalesce("key", _key(F.col("u"), F.col("w"), width)).alias("key"), "c", "u", "w")


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[pa.Table]:
    """Neighbouring batches as tables of about so many rows."""
    _release()
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


class Model:
    """Averaged backoff: for each sample the weight that a restaurant gives to its parent, and the parent's probabilities.

    The arrays hold the lookup table; `cold` is a table of the other words, (id, n, b0, p0, b1, ...): occurrences, and by sample weight and probability.
    """

    def __init__(self, width: int):
        self.width, self.backoff, self.unigram, self.total, self.cold = width, [], [], np.zeros(width), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cold": None}

    def lower(self, keys: np.ndarray) -> np.ndarray:
        u, w = keys // self.width, keys % self.width
        return sum(b[u] * p[w] for b, p in zip(self.backoff, self.unigram)) / len(self.unigram)


def _by(df: DataFrame, first, second, value, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of value by the ids of the lookup table in two columns, as arrays; ids below 0 don't count. Tasks send theirs as blobs, by places."""
    step = -(-2 * width // 16)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * width, np.int64)
        for batch in _larger(batches):
            x = batch["x"].to_numpy()
            for start, name in ((0, "i"), (width, "j")):
                ids = batch[name].to_numpy()
                at = ids >= 0
                # exact below 2^53
                sums[start : start + width] += np.bincount(ids[at], x[at], width).astype(np.int64)
        there = np.flatnonzero(sums).astype(_U)
        ends = np.searchsorted(there, np.arange(17) * step)
        yield _blobs([(i, 0, b - a, 0, _pack(there[a:b], sums[there[a:b]])) for i, (a, b) in enumerate(zip(ends.tolist(), ends.tolist()[1:])) if a < b])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            sums = np.zeros(step, np.int64)
            for _, n, _, blob in rows:
                there, x = _unpack(blob, n, np.int64)
                sums[there - _U(part * step)] += x
            yield _blobs([(part, 0, step, 0, _pack(np.arange(step, dtype=_U), sums))])

    found = _gathered(df.select(first.alias("i"), second.alias("j"), value.alias("x")).mapInArrow(send, _BLOB_KIND)).mapInArrow(add, _BLOB_KIND).toArrow()
    out = np.zeros(16 * step)
    for part, blob in zip(found["part"].to_pylist(), found["blob"].to_pylist()):
        out[part * step : (part + 1) * step] = _unpack(blob, step, np.int64)[1]
    return out[:width], out[width : 2 * width]


def _meeting(word, other):
    """What a row joins the cold words' table by: a cold word's id; for a word of the lookup table a number that meets nothing and is not frequent."""
    return F.when(word < 0, word).otherwise(F.shiftrightunsigned(F.xxhash64(other), 1))


def _parent(customers, tables, rest: float, every: float):
    """Probability of a dish at the top."""
    return ((customers - DISCOUNTS[0] * tables) + rest) / every


_HOT, _MIXED = "key bigint, c bigint, t bigint, own double", "key bigint, c bigint, u bigint, w bigint, t bigint, own double"


def train(bigrams: DataFrame | tuple[DataFrame, DataFrame, np.ndarray, np.ndarray], width: int, burn: int = BURN, samples: int = SAMPLES) -> tuple[DataFrame, Model]:
    """(key, c, own, u, w) with the averaged own share of each bigram, and the model of what is left to the parent.

    With `bigrams` may come a table (id, n) of the cold words in them and how often each word of the lookup table is a context and a dish. A bigram
    seen once has one table in every sweep, so that only others are reseated, and words' sums come from their occurrences less what others' customers share. Bigrams of the lookup table read
    their neighbours' sums from arrays; bigrams with a cold word meet them in joins by the cold word. own is -1 for a bigram
    seen once that has a cold word: (1 - discount) / (strength + occurrences of its first word).
    """
    (d0, d1), (s0, s1) = DISCOUNTS, STRENGTHS
    context, dish = F.floor(F.col("key") / F.lit(width)).cast("bigint"), F.pmod(F.col("key"), F.lit(width))
    if isinstance(bigrams, tuple):
        seen, cold, total, count = bigrams
        seen = materialize(seen, "bigrams")
    else:
        seen, cold = materialize(bigrams.select("key", "c", *(F.lit(None).cast("bigint").alias(i) for i in "uw")), "bigrams"), None
        total, count = _by(seen, context, dish, F.col("c"), width)
    spark, model, key = seen.sparkSession, Model(width), F.col("key")
    model.total = total
    settle(spark)
    n_cold, n_once = cold.agg(F.count("*"), F.count_if(F.col("n") == 1)).first() if cold is not None else (0, 0)
    shared, dishes, index = F.col("c") - F.col("t"), width - 1 + n_cold, np.arange(width)
    state = seen.where("c > 1").withColumns({"t": F.lit(1).cast("bigint"), "own": F.lit(0.0)})
    hot, mixed, words, file = materialize(state.where("key >= 0").select("key", "c", "t", "own"), "seats-0"), None, None, None
    if n_cold:
        mixed = materialize(state.where("key < 0").select("key", "c", "u", "w", "t", "own"), "cold-seats-0")
        words = file = materialize(cold.where("n > 1").select("id", "n", F.col("n").alias("customers"), F.lit(1).cast("bigint").alias("top"), F.col("n").alias("tables")), "cold-words")

    def sums() -> tuple[np.ndarray, np.ndarray]:
        """Tables of the lookup table's restaurants, and customers of its dishes at the top."""
        both = [hot.select(context.alias("u"), dish.alias("w"), shared.alias("x"))]
        if n_cold:
            both.append(mixed.select("u", "w", shared.alias("x")))
        u, w = _by(reduce(DataFrame.unionByName, both), F.col("u"), F.col("w"), F.col("x"), width)
        return total - u, count - w

    def reseat_cold(tops: float, stream: int) -> tuple[DataFrame, float, float]:
        """The cold words of two occurrences or more with what restaurants now send them, and all cold words' tables and customers at the top."""
        less = mixed.select(F.col("w").alias("id"), shared.alias("w"), F.lit(0).cast("bigint").alias("u")).union(mixed.select("u", F.lit(0).cast("bigint"), shared))
        less = less.where("id < 0").groupBy("id").agg(F.sum("w").alias("w"), F.sum("u").alias("u"))
        now = {"customers": F.col("n") - F.coalesce("w", F.lit(0)), "tables": F.col("n") - F.coalesce("u", F.lit(0))}
        met = words.join(less, "id", "left").withColumns(now).drop("u", "w")

        def reseat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _larger(batches):
                top = batch["top"].to_numpy()
                new = seat(batch["id"].to_numpy(), batch["customers"].to_numpy(), tops - top, np.full(len(top), 1 / dishes), d0, s0, stream)
                yield from batch.set_column(batch.column_names.index("top"), "top", pa.array(new)).to_batches(max_chunksize=1 << 16)

        then = materialize(met.mapInArrow(reseat, met.schema), "cold-words")
        discard(file)
        settle(spark)
        sent = then.agg(F.coalesce(F.sum("top"), F.lit(0)), F.coalesce(F.sum("customers"), F.lit(0))).first()
        return then, float(sent[0] + n_once), float(sent[1] + n_once)

    def reseat_top(stream: int) -> tuple[float, float]:
        """Seat what the restaurants send anew: the probability that all dishes share, and the divisor of both."""
        nonlocal top, cold_top, words, file
        tops, cold_customers = top.sum() + cold_top, 0.0
        if n_cold:
            words, cold_top, cold_customers = reseat_cold(tops, stream)
            file = words
        top = seat(index, customers.astype(np.int64), tops - top, np.full(width, 1 / dishes), d0, s0, stream).astype(float)
        return float((s0 + d0 * (top.sum() + cold_top)) / dishes), float(s0 + customers.sum() + cold_customers)

    tables, customers = sums()
    top, cold_top, tails = np.minimum(customers, 1.0), float(n_cold), []
    for sweep in range(burn + samples):
        rest, every = reseat_top(2 * sweep)
        given = spark.sparkContext.broadcast((_parent(customers, top, rest, every), tables, total))

        def reseat(batches: Iterator[pa.RecordBatch], sweep=sweep, given=given) -> Iterator[pa.RecordBatch]:
            parent, tables, total = given.value
            for batch in _larger(batches):
                keys, c, t, own = (batch[x].to_numpy() for x in ("key", "c", "t", "own"))
                rows = {"key": keys, "c": c}
                if "u" in batch.column_names:
                    rows |= {x: batch[x].to_numpy() for x in "uw"}
                    u, w = np.maximum(rows["u"], 0), np.maximum(rows["w"], 0)
                    look = lambda x, i, a, name: np.where(rows[x] < 0, batch[name].to_numpy(), a[i])
                    n, sits, above = look("u", u, total, "n"), look("u", u, tables, "tables"), look("w", w, parent, "parent")
                else:
                    u, w = keys // width, keys % width
                    n, sits, above = total[u], tables[u], parent[w]
                new = seat(keys, c, sits - t, above, d1, s1, 2 * sweep + 1)
                rows |= {"t": new, "own": own + ((c - d1 * new) / (s1 + n) if sweep >= burn else 0.0)}
                yield from pa.table(rows).to_batches(max_chunksize=1 << 16)

        then = materialize(hot.mapInArrow(reseat, _HOT), "seats")
        discard(hot)
        hot = then
        if n_cold:
            above = words.select(F.col("id").alias("jw"), _parent(F.col("customers"), F.col("top"), rest, every).alias("parent"))
            met = mixed.withColumn("jw", _meeting(F.col("w"), key)).join(above, "jw", "left").drop("jw")
            met = met.withColumn("ju", _meeting(F.col("u"), key)).join(words.select(F.col("id").alias("ju"), "n", "tables"), "ju", "left").drop("ju")
            then = materialize(met.mapInArrow(reseat, _MIXED), "cold-seats")
            discard(mixed)
            mixed = then
        tables, customers = sums()
        if sweep >= burn:
            # the same sample for the parent: it reseats what the restaurants now send
            rest, every = reseat_top(2 * sweep + 999_983)
            model.unigram.append(_parent(customers, top, rest, every))
            model.backoff.append((s1 + d1 * tables) / (s1 + total))
            tails.append((f"b{len(tails)}", f"p{len(tails)}", float((s1 + d1) / (s1 + 1)), float(_parent(1, 1, rest, every))))
            if n_cold:
                b, p = tails[-1][:2]
                words = words.withColumns({b: (F.col("tables") * d1 + s1) / (F.col("n") + s1), p: _parent(F.col("customers"), F.col("top"), rest, every)})
        given.unpersist()
    no_words = [F.lit(None).cast("bigint").alias(i) for i in "uw"]
    own = hot.select("key", "c", (F.col("own") / samples).alias("own"), *no_words)
    known = spark.createDataFrame(pa.table({"i": index, "total": total}))
    once = seen.where("c = 1").select("key", "c", "u", "w", F.when(key >= 0, context).alias("i")).join(F.broadcast(known), "i", "left")
    own = own.union(once.select("key", "c", F.coalesce((1 - d1) / (F.col("total") + s1), F.lit(-1.0)), "u", "w"))
    if n_cold:
        own = own.union(mixed.select("key", "c", F.col("own") / samples, "u", "w"))
    if cold is not None:
        alone = cold.where("n = 1").select("id", "n", *(F.lit(x).alias(i) for b, p, by, pp in tails for i, x in ((b, by), (p, pp))))
        model.cold = materialize(words.select(*alone.columns).union(alone) if n_cold else alone, "cold-model")
    return own, model


_ROW = "row bigint, doc_id {id}, held_out boolean, n_tokens bigint, n_known bigint, base double, lm double, " + _BLOB_KIND.replace("row", "first")


def _read(docs: DataFrame, vocab, model, head, parts: Parts) -> DataFrame:
    """One row per document: sums over what the broadcast tables know. Its other bigrams stand in blobs, on rows that have a part, each for all
    documents of a batch: kind 1 of the lookup table (mixed key, document, times), kind 2 with a cold word (-(id + 1) of the cold word, of the second if both are; the other word, whether the
    cold one is the second, document, times). A document is its place in the batch, twice, and 1 more if held out."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _ROW.format(id=dict(docs.dtypes)["doc_id"])
    schema = to_arrow_schema(_parse_datatype_string(kind))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m, (head_run, head_own) = vocab.value, model.value, head.value
        row = TaskContext.get().partitionId() << 40  # in the result twice that, and 1 more if held out
        log_counts = np.log10(v.counts + 1.0)
        for doc_ids, texts in _texts(batches):
            n = len(texts)
            ids, lengths = v.ids(texts)
            held = np.array([_held_out(d) for d in doc_ids], bool)
            of = np.repeat(np.arange(n), lengths)
            base = np.bincount(of, log_counts[np.maximum(ids, 0)], n) + np.log10(v.end + 1.0)
            known = np.bincount(of, (ids > 0).astype(float), n) + (v.end > 0)
            before, seq, doc = v.pairs(ids, lengths)
            cold = (before < 0) | (seq < 0)
            # bigrams once per document; mixed keys have 37 bits at most and documents 15, of _ROWS
            both, times = np.unique((parts.mix(before[~cold] * v.width + seq[~cold]) << _U(16)) | doc[~cold].astype(_U), return_counts=True)
            run, doc_of = both >> _U(16), (both & _U(0xFFFF)).astype(np.int64)
            hit = np.zeros(len(run), bool)
            at = np.searchsorted(head_run, run)
            inside = at < len(head_run)
            hit[inside] = head_run[at[inside]] == run[inside]
            lm = np.bincount(doc_of[hit], times[hit] * np.log10(head_own[at[hit]] + m.lower(parts.keys(run[hit]))), n)
            columns = [
                pa.array(2 * np.arange(row, row + n) + held), pa.array(doc_ids, schema.field("doc_id").type), pa.array(held, pa.bool_()), pa.array(lengths + 1), pa.array(known.astype(np.int64)),
                pa.array(base), pa.array(lm),
            ]
            columns += [pa.nulls(n, f.type) for f in schema][len(columns) :]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
            place = (2 * np.arange(n) + held).astype(np.uint16)
            run, place_of, times = run[~hit], place[doc_of[~hit]], times[~hit].astype(np.uint32)
            out = [(part, 1, len(run[at]), 2 * row, _pack(run[at], place_of[at], times[at])) for part, at in parts.cut(run)]
            (doc, u, w), times = _unique(doc[cold], before[cold], seq[cold])
            second = w < 0
            run = (-1 - np.where(second, w, u)).astype(_U)
            order = np.argsort(run)
            columns = [x[order] for x in (run, np.where(second, u, w), second, place[doc], times.astype(np.uint32))]
            out += [(part, 2, len(columns[0][at]), 2 * row, _pack(*(x[at] for x in columns))) for part, at in _cut_cold(columns[0], parts.count)]
            blobs = _blobs(out)
            nothing = [pa.nulls(blobs.num_rows, f.type) for f in schema][: -len(_BLOBS)]
            yield pa.RecordBatch.from_arrays([*nothing, *blobs.columns], schema=schema)
            row += n

    return docs.select("doc_id", "text").mapInArrow(read, kind)


def _hot_logs(blobs: DataFrame, own: DataFrame, model, parts: Parts) -> DataFrame:
    """(row, lm) by document and part, from the blobs of _read() and (key, own) of the lookup table's bigrams that are not broadcast."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _larger(batches, 1 << 20):
            run, x = parts.mix(batch["key"].to_numpy()), batch["own"].to_numpy()
            order = np.argsort(run)
            run, x = run[order], x[order]
            yield _blobs([(part, 0, len(run[at]), 0, _pack(run[at], x[at])) for part, at in parts.cut(run)])

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for _, rows in _by_part(batches):
            known, run, x = [], None, None
            for kind, n, first, blob in rows:
                if kind == 0:
                    known.append(_unpack(blob, n, float))
                    continue
                if run is None:
                    run, x = (np.concatenate(c) for c in zip(*known)) if known else (np.zeros(0, _U), np.zeros(0))
                    order = np.argsort(run)
                    run, x, known = run[order], x[order], []
                asked, place, k = _unpack(blob, n, np.uint16, np.uint32)
                own, at = np.zeros(n), np.searchsorted(run, asked)
                hit = np.flatnonzero(at < len(run))
                hit = hit[run[at[hit]] == asked[hit]]
                own[hit] = x[at[hit]]
                keys = parts.keys(asked)
                # what a training document has and the table lacks was seen once, there
                once = place % 2 == 0
                once[hit] = False
                own[once] = (1 - DISCOUNTS[1]) / (STRENGTHS[1] + m.total[keys[once] // m.width])
                sums = np.bincount(place, k * np.log10(own + m.lower(keys)))
                there = np.flatnonzero(np.bincount(place))
                yield pa.RecordBatch.from_arrays([pa.array(first + there), pa.array(sums[there])], names=["row", "lm"])

    blobs = blobs.unionByName(own.select("key", "own").mapInArrow(send, _BLOB_KIND))
    return _gathered(blobs).mapInArrow(logs, "row bigint, lm double")


def _cold_logs(blobs: DataFrame, own: DataFrame, model, words: DataFrame, parts: Parts) -> DataFrame:
    """(row, lm, count_log, known) by document and part, from the blobs of _read(), (key, own, u, w) of bigrams with a cold word, and the model's table of
    cold words. Where both words are cold lm is left out; (row, u, k, own, p) stand on rows of their own, p by sample."""
    samples = len(words.columns) // 2 - 1
    numbers = [f"{x}{s}" for s in range(samples) for x in "bp"]

    def send_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _larger(batches, 1 << 20):
            key, x, u, w = (batch[i].to_numpy() for i in ("key", "own", "u", "w"))
            word, run = (-1 - np.where(w < 0, w, u)).astype(_U), (-1 - key).astype(_U)
            order = np.argsort(word)
            word, run, x, out = word[order], run[order], x[order], []
            for part, at in _cut_cold(word, parts.count):
                order = np.argsort(run[at])
                out.append((part, 0, len(order), 0, _pack(run[at][order], x[at][order])))
            yield _blobs(out)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _larger(batches, 1 << 20):
            run = (-1 - batch["id"].to_numpy()).astype(_U)
            order = np.argsort(run)
            columns = [x[order] for x in (run, *(batch[i].to_numpy() for i in ("n", *numbers)))]
            yield _blobs([(part, 1, len(columns[0][at]), 0, _pack(*(x[at] for x in columns))) for part, at in _cut_cold(columns[0], parts.count)])

    def sorted_runs(runs: list, kinds: tuple) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*runs)] if runs else [np.zeros(0, k) for k in kinds]
        order = np.argsort(columns[0])
        return [c[order] for c in columns]

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        own_kinds, word_kinds = (float,), (np.int64, *[float] * len(numbers))
        for _, rows in _by_part(batches):
            known, words, met = [], [], None
            for kind, n, first, blob in rows:
                if kind < 2:
                    (words if kind else known).append(_unpack(blob, n, *(word_kinds if kind else own_kinds)))
                    continue
                if met is None:
                    met = sorted_runs(known, (_U, *own_kinds)), sorted_runs(words, (_U, *word_kinds))
                    known, words = [], []
                (keys, x), (ids, times, *values) = met
                cold, other, second, place, k = _unpack(blob, n, np.int64, bool, np.uint16, np.uint32)
                word = -1 - cold.astype(np.int64)
                u, w = np.where(second, other, word), np.where(second, word, other)
                own, asked = np.full(n, np.nan), _pair_hash(u, w)
                at = np.searchsorted(keys, asked)
                hit = np.flatnonzero(at < len(keys))
                hit = hit[keys[at[hit]] == asked[hit]]
                own[hit] = x[at[hit]]
                at, there = np.searchsorted(ids, cold), np.zeros(n, bool)
                inside = np.flatnonzero(at < len(ids))
                there[inside] = ids[at[inside]] == cold[inside]
                at = at[there]
                count = np.zeros(n)
                count[there] = times[at]
                one = np.flatnonzero(other >= 0)
                last, hot_word = second[one], other[one]
                low, above = np.zeros(len(one)), []
                for s, (backoff, unigram) in enumerate(zip(m.backoff, m.unigram)):
                    # an unknown word has no restaurant, and as a dish the share of the base
                    b, p = np.ones(n), np.full(n, unigram[0])
                    b[there], p[there] = values[2 * s][at], values[2 * s + 1][at]
                    low += np.where(last, backoff[hot_word], b[one]) * np.where(last, p[one], unigram[hot_word]) / samples
                    above.append(p)
                lm = np.zeros(n)
                lm[one] = k[one] * np.log10(_shares(own[one], place[one] % 2 == 1, np.where(last, m.total[hot_word], count[one])) + low)
                # a cold word's occurrences; those of the lookup table are counted already
                counted = second & there
                sums = [np.bincount(place, lm), np.bincount(place, np.where(counted, k * np.log10(count + 1), 0.0)), np.bincount(place, np.where(counted, k, 0))]
                at = np.flatnonzero(np.bincount(place))
                out = pa.RecordBatch.from_arrays([pa.array(first + at), *(pa.array(x[at]) for x in sums[:2]), pa.array(sums[2][at].astype(np.int64))], names=_SUMS)
                yield _filled(out, schema)
                at = np.flatnonzero(other < 0)
                if len(at):
                    out = [first + place[at].astype(np.int64), u[at], k[at].astype(np.int64), own[at], *(p[at] for p in above)]
                    yield _filled(pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["row", "u", "k", "own", *(f"p{s}" for s in range(samples))]), schema)

    schema = pa.schema([("row", pa.int64()), ("lm", pa.float64()), ("count_log", pa.float64()), ("known", pa.int64()), ("u", pa.int64()), ("k", pa.int64()), ("own", pa.float64()), *((f"p{s}", pa.float64()) for s in range(samples))])
    kind = "row bigint, lm double, count_log double, known bigint, u bigint, k bigint, own double" + "".join(f", p{s} double" for s in range(samples))
    sent = own.select("key", "own", "u", "w").mapInArrow(send_own, _BLOB_KIND).unionByName(words.mapInArrow(send_words, _BLOB_KIND))
    return _gathered(blobs.unionByName(sent)).mapInArrow(logs, kind)


_SUMS = ["row", "lm", "count_log", "known"]


def _filled(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with nulls for the columns that it lacks."""
    there = set(batch.schema.names)
    return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)


def _shares(own: np.ndarray, held: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Own shares where nan says that the table lacks the bigram and -1 that it was seen once; what a training document has and the table lacks was seen once, there."""
    once = (own < 0) | np.isnan(own) & ~held
    return np.where(once, (1 - DISCOUNTS[1]) / (STRENGTHS[1] + n), np.where(np.isnan(own), 0.0, own))


def _both_cold(pairs: DataFrame, samples: int) -> DataFrame:
    """(row, lm, count_log, known) of bigrams of two cold words and what the model's table says of the first, null for unknown words."""

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _larger(batches):
            get = lambda name: np.asarray(batch[name].to_numpy(), float)
            low = np.zeros(batch.num_rows)
            for s in range(samples):
                b = get(f"b{s}")
                low += np.where(np.isnan(b), 1.0, b) * get(f"p{s}") / samples
            k, none = get("k"), np.zeros(batch.num_rows)
            lm = k * np.log10(_shares(get("own"), batch["row"].to_numpy() % 2 == 1, get("n")) + low)
            yield from pa.table({"row": batch["row"], "lm": lm, "count_log": none, "known": none.astype(np.int64)}).to_batches(max_chunksize=1 << 16)

    return pairs.mapInArrow(logs, "row bigint, lm double, count_log double, known bigint")


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row of docs."""
    spark = docs.sparkSession
    training = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2)
    counts = materialize(count_words(training), "word-counts")
    words = vocabulary(counts)
    vocab, n, width = spark.sparkContext.broadcast(words), words.n, words.width
    cold = cold_words(counts, words.least)
    ends = np.array([words.end, 0], float)
    own, model = train((count_bigrams(docs, vocab), cold, np.concatenate((words.counts, ends[::-1])), np.concatenate((words.counts, ends))), width)
    settle(spark)
    in_head = (F.col("key") >= 0) & (F.col("c") * BIGRAMS >= n)
    head = own.where(in_head).select("key", "own").toArrow()
    parts = Parts(width, max(PARTS, -(-n // READ)))
    run, head_own = parts.mix(head["key"].to_numpy()), head["own"].to_numpy()
    order = np.argsort(run)
    given = spark.sparkContext.broadcast(model)
    found = materialize(_read(docs, vocab, given, spark.sparkContext.broadcast((run[order], head_own[order])), parts), "scored")
    rows, blobs = found.where("part IS NULL"), found.where("part IS NOT NULL").select("part", "kind", "n", F.col("first").alias("row"), "blob")
    per_row = lambda df: df.groupBy("row").agg(*(F.sum(c).alias(c) for c in _SUMS[1:]))
    logs = _hot_logs(blobs.where("kind = 1"), own.where((F.col("key") >= 0) & ~in_head), given, parts)
    logs = materialize(logs.groupBy("row").agg(F.sum("lm").alias("lm"), F.lit(0.0).alias("count_log"), F.lit(0).cast("bigint").alias("known")), "hot-logs")
    settle(spark)
    if model.cold is not None:
        samples = len(model.unigram)
        cold_logs = materialize(_cold_logs(blobs.where("kind = 2"), own.where("key < 0"), given, model.cold, parts), "cold-logs")
        settle(spark)
        at = model.cold.select(F.col("id").alias("u"), "n", *(f"b{s}" for s in range(samples)))
        logs = logs.union(cold_logs.where("u IS NULL").select(*_SUMS)).union(_both_cold(cold_logs.where("u IS NOT NULL").join(at, "u", "left"), samples))
    more = per_row(logs).select(F.col("row").alias("__row"), *(F.col(c).alias(f"more_{c}") for c in ("count_log", "known", "lm")))
    out = rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm").join(more, F.col("row") == F.col("__row"), "left").na.fill(0, ["more_count_log", "more_known", "more_lm"])
    base = F.col("base") + F.col("more_count_log") - F.col("n_tokens") * F.lit(float(np.log10(n + words.v + 1)))
    lm = F.col("lm") + F.col("more_lm")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), lm.alias("score"), F.pow(F.lit(10.0), -lm / F.col("n_tokens")).alias("perplexity"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
SQL: dict[str, str] = {}
