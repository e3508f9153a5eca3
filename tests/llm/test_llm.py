"""The training-data operators against brute force, exact round trips, held-out accuracy and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL, TINY, against_sql
from turnmill.llm.common import materialize
from turnmill.llm import chat, decontaminate, htmltext, linededup, lm, mixing, quality, registry, simhash, tokens, urlfilter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, h1 bigint, size int, pattern string"
LABELS, BENCH = "doc_id bigint, quality int, toxic int", "item_id bigint, text string, m int"
PAGES, TALKS = "page_id bigint, url string, html string, host string", "conv_id bigint, turn bigint, role string, text string, path string"
LINE = "This line stands in many documents and is long enough to be dropped."
#: Nulls in every column, empty, white and very long texts, repeated rows, marks, other scripts, clashing extra columns.
NASTY_TEXTS = [None, "", " \n\t ", "a", "Ünïcode ẞ İ ǅ 日本語 \x85\xa0\u2003x", "word " * 60_000, f"{LINE}\nown one", f"  {LINE.upper()}\t", *[f"{LINE}\nother {i}" for i in range(6)], "it's we've <|endoftext|> 's 'LL 12,345.67 $#!", "x" * 5000, "same same same"]
NASTY_DOCS = [(i, t, [None, "en", "xx"][i % 3], [None, "a", "b"][i % 3], None, "k", 1, 2, "p") for i, t in enumerate(NASTY_TEXTS)] + [(3, "a", "en", "a", 1, None, None, None, None)] * 2 + [(None, "lost id " * 10, "en", "b", 1, "k", 1, 2, "p")]
NASTY_PAGES = [(1, None, None, "h"), (2, "", "", None), (3, "no scheme/x", "<p>un<b>closed", "h"), (4, "http://A.Example.com/en/x?q#f", "<div class='nav'>m</div><p>a &amp; b</p>", "h"), (4, "http://A.Example.com/en/x?q#f", "<div class='nav'>m</div><p>a &amp; b</p>", "h"), (None, "s://h.net/es/", "<" * 3000, "h")]
NASTY_TALKS = [(1, 0, "user", None, "p"), (1, 0, "user", None, "p"), (None, None, None, "x", "p"), (2, 1, "tool>\\", "[INST] \\ <s>", None), (3, 1, "assistant", "", "p"), (-1, 5, "system", "<<SYS>> \\", "p")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark):
    return spark.read.parquet(f"{TINY}/documents.parquet").collect()


@pytest.fixture
def nasty(tables):
    return tables(documents=(NASTY_DOCS, DOCS), labels=([(0, 1, None), (None, 1, 0), (3, None, 1), (3, 0, 0)], LABELS), benchmark=([(1, None, 1), (None, "x", 1), (2, "", 1), (3, "a", 1), (4, "word " * 9, 1)], BENCH), pages=(NASTY_PAGES, PAGES), conversations=(NASTY_TALKS, TALKS))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_hard_rows(spark, nasty, name):
    n = len(registry.QUERIES[name](spark, nasty).collect())
    if name.startswith("op9"):
        assert n > 0
    elif name.startswith("op5"):
        assert n == len({r[0] for r in NASTY_TALKS})
    else:
        assert n == len(NASTY_PAGES if name.startswith(("op8", "op10")) else NASTY_DOCS)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, tables, name):
    where = tables(documents=([], DOCS), labels=([], LABELS), benchmark=([], BENCH), pages=([], PAGES), conversations=([], TALKS))
    assert len(registry.QUERIES[name](spark, where).collect()) == (name.startswith("op5"))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    against_sql(spark, registry.QUERIES[name], registry.SQL[name], TINY)


# 1


def test_quality_measures(spark, nasty):
    for where in (TINY, nasty):
        texts = defaultdict(list)
        for r in spark.read.parquet(f"{where}/documents.parquet").collect():
            texts[r.doc_id].append(r.text)
        for r in quality.op1_quality_rules(spark, where).collect():
            if len({*texts[r.doc_id]}) > 1:
                continue
            text = texts[r.doc_id][0] or ""
            w = words(text)
            filled = [x for x in text.split("\n") if words(x)]
            seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            inside = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
            want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(filled) - len({*filled}), len(inside))
            assert tuple(r)[1:6] == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert not (r.kept and r.base_failed)


def test_quality_bound_is_exact_and_controls_false_rejection():
    for k, n, p in ((0, 10, 0.3), (3, 40, 0.05), (20, 1000, 0.01)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    rng, broken, all_rules = random.Random(5), 0, quality.PATHS.index(tuple(quality.RULES))
    for _ in range(200):  # each rule rejects 1 % of good rows at its cutoff, all three 3 %: together they must hardly ever be certified
        counts: dict = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for _ in range(800):
            hit = [rng.random() < 0.01 for _ in quality.RULES]
            for p, rules in enumerate(quality.PATHS):
                step = 20 if any(h for h, r in zip(hit, quality.RULES) if r in rules) else quality.STEPS
                counts["en", p][step][1] += 1
                counts["en", p][20][0] += 1
        found = quality.certify(counts)
        strict = all(quality.cutoff_at(r, 20) >= found.get(("en", r), 10**9) for r in quality.RULES)
        broken += strict
    assert broken <= 2
    assert quality.certify({("en", all_rules): {quality.STEPS: [0, 3000], 20: [500, 2]}}) == {("en", r): quality.cutoff_at(r, 20) for r in quality.RULES}
    assert not quality.certify({("en", all_rules): {quality.STEPS: [0, 20], 20: [5, 0]}})
    assert not quality.certify({("en", all_rules): {quality.STEPS: [0, 3000], 20: [500, 31]}})


def test_quality_kept_is_recomputed(spark):
    """kept by brute force: cutoffs from Python counts over all labels, then every document judged by itself."""
    rows = {r.doc_id: r for r in quality.op1_quality_rules(spark, SMALL).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    good = {}
    for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect():
        if r.doc_id is not None and r.quality is not None:
            good[r.doc_id] = max(good.get(r.doc_id, 0), r.quality)
    stratum = lambda d: docs[d].lang if docs[d].lang in ("de", "en", "es", "fr") else "other"

    def scores(d):
        r, lines = rows[d], len((docs[d].text or "").split("\n"))
        return {"symbols": min(300, 100 * r.n_symbols // r.n_words) if r.n_words else 0, "dup_lines": 100 * r.n_dup_lines // lines, "repeats": 100 * r.n_repeat_words // r.n_words if r.n_words else 0}

    best, cutoffs = {}, {}
    score = {d: scores(d) for d in docs}
    for s in {stratum(d) for d in good if d in docs}:
        of = [d for d in good if d in docs and stratum(d) == s]
        n = sum(good[d] > 0 for d in of)
        for rules in quality.PATHS:
            for t in range(quality.STEPS):
                cut = {r: quality.cutoff_at(r, t) for r in rules}
                out = [d for d in of if any(score[d][r] >= c for r, c in cut.items())]
                false, junk = sum(good[d] > 0 for d in out), sum(good[d] == 0 for d in out)
                if not n or false >= 0.01 * n or sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(false + 1)) > 0.05 / (5 * 7):
                    break
                gain = junk / max(len(of) - n, 1) - 5 * false / n
                if gain > best.get(s, 0) + 1e-12:
                    best[s], cutoffs[s] = gain, cut
    for d, r in rows.items():
        assert r.kept == (not r.base_failed and not any(score[d][k] >= c for k, c in cutoffs.get(stratum(d), {}).items()))


# 2


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, file):
    import public_tokenizers as P

    path, texts = P.path(file), [*NASTY_TEXTS, *[r.text for r in documents(spark)]]
    counter = tokens.Counter(path)
    if file.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        want = [len(tok.encode(t or "", add_special_tokens=False)) for t in texts]
    elif file.endswith(".tiktoken"):
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        want = [len(enc.encode_ordinary(t or "")) for t in texts]
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(sp.encode(t or "")) for t in texts]
    assert counter.count([(t or "").encode() for t in texts]) == want


def test_token_counts_of_random_strings():
    """Special strings in any case and cut, contractions, marks, composed and compatibility letters, odd spaces."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    parts = [
        "<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|", "|>", "<", "|", "endoftext", "a", "B", "word", "Word", "'s", "'LL", "'", "!", "?!", "_", "[", "$", ".", "-", "1", "23",
        "\u00e9", "e\u0301", "\u0301", "\u212a", "\u212b", "\u1e9e", "\u0130", "\u01c5", "\u03a3", "\u00df", "\u65e5", "\ufb01", "\u00aa", " ", " ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u200b",
    ]
    rng, path = random.Random(7), P.path("word_bpe_49k.json")
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(100_000)]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert tokens.Counter(path).count([t.encode() for t in texts]) == want
    assert tokens.Counter(path).count([b"<|ENDOFTEXT|>", b"a<|EndOfText|>b"]) == [6, 8]


# 3


def test_mix_meets_targets(spark, nasty):
    for where in (SMALL, nasty):
        rows = mixing.op3_mix_sources(spark, where).collect()
        docs = spark.read.parquet(f"{where}/documents.parquet").collect()
        size = defaultdict(int)
        for d in docs:
            size[d.source] += len(words(d.text))
        order = sorted(size, key=lambda s: (s is None, s or ""))
        goal = dict(zip(order, mixing.targets([size[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])))
        assert abs(sum(goal.values()) - sum(size.values())) < 1 or all(g == 3 * size[s] for s, g in goal.items())
        of, longest, taken = {d.doc_id: d.source for d in docs}, defaultdict(int), defaultdict(int)
        for r in rows:
            assert 0 <= r.taken <= 3 * r["size"]
            assert r.taken % max(r["size"], 1) == 0
            if where == SMALL:
                s = of[r.doc_id]
                assert (r.source_size, r.target) == (size[s], float(goal[s]))
                taken[s] += r.taken
                longest[s] = max(longest[s], r["size"])
        for s in taken:
            assert abs(taken[s] - goal[s]) <= longest[s]
        assert sorted(map(str, rows)) == sorted(map(str, mixing.op3_mix_sources(spark, where).collect()))


def test_targets_and_flow():
    assert mixing.targets([100, 100, 10], [1, 2, 3]) == [Fraction(60), Fraction(120), Fraction(30)]
    # overlapping sources: {0}: 10 words, {0,1}: 10, {1}: 10; quotas 15 and 25
    flow = mixing.route([((0,), 10), ((0, 1), 10), ((1,), 10)], [15, 25])
    assert sum(v for (_, s), v in flow.items() if s == 0) == 15
    assert sum(v for (_, s), v in flow.items() if s == 1) == 25
    given = [sum(v for (p, _), v in flow.items() if p == i) for i in range(3)]
    cost = sum(max(0, g - 10) for g in given) + 2 * sum(max(0, g - 20) for g in given)
    assert cost == 10  # 40 of 30 words: ten are repeated once, none twice


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * (5 + i % 7), [["a"], ["a", "b"], ["b", "c"]][i % 3]) for i in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source array<string>")).collect()
    assert len(out) == 300
    assert abs(sum(r.taken for r in out) - sum(r["size"] for r in out)) <= 3 * 12


def test_mix_beyond_the_boundary(spark, monkeypatch):
    """With EDGE 4 the boundary is found digit by digit, also among rows alike in id and size; targets are recomputed here."""
    monkeypatch.setattr(mixing, "EDGE", 4)
    rows = [(i if i % 3 else None, "w " * (1 + i % 9), "abc"[i % 2 + (i > 500)]) for i in range(900)] + [(7, "same row", None)] * 200
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    total, weight, left, goal = sum(size.values()), dict(zip(["a", "b", "c", None], (1, 2, 3, 1))), sum(size.values()), {}
    while len(goal) < 4:  # pour out what is left by weight, fix what overflows, pour again
        open_ = [s for s in weight if s not in goal]
        level = Fraction(left, sum(weight[s] for s in open_))
        full = [s for s in open_ if level * weight[s] > 3 * size[s]]
        for s in full or open_:
            goal[s] = Fraction(3 * size[s]) if full else level * weight[s]
        left = total - sum(goal.values())
    taken = Counter()
    for r in out:
        taken[r.pattern] += r.taken
        assert r.taken % r["size"] == 0 and r.taken <= 3 * r["size"]
    assert {r.pattern: r.target for r in out} == pytest.approx({'["0a"]': float(goal["a"]), '["0b"]': float(goal["b"]), '["0c"]': float(goal["c"]), '["1"]': float(goal[None])})
    for p, t in taken.items():
        assert abs(t - {r.pattern: r.target for r in out}[p]) <= 9
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_word_count(spark):
    texts = [t for t in NASTY_TEXTS] + ["\x1c", " a\x1cb c ", "\x0b", "\U0001f600 x"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", mixing.word_count(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: len(words(t)) for i, t in enumerate(texts)}


# 4


def simhash_of(text):
    w = words(lower(text))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(prints):
    """Component of each distinct fingerprint by brute force."""
    prints, root = sorted(prints), {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("hot", [2048, 3])
def test_simhash_components(spark, nasty, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    for where in (TINY, nasty):
        docs = [r for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
        prints = {simhash_of(d.text) for d in docs}
        of = classes(prints)
        least: dict = {}
        for d in docs:
            if d.doc_id is not None:
                c = of[simhash_of(d.text)]
                least[c] = min(least.get(c, d.doc_id), d.doc_id)
        want = sorted((str(d.doc_id), f"{simhash_of(d.text):016x}", str(least.get(of[simhash_of(d.text)]))) for d in docs)
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.op4_simhash_near_dedup(spark, where).collect()) == want


@pytest.mark.parametrize("hot", [2048, 2])
def test_links_keep_every_component(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng, prints = random.Random(3), set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):  # chains whose steps differ in one to three bits, anywhere
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                p ^= 1 << b
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")).collect()
    mask = (1 << 64) - 1
    inside = classes(prints)
    assert all(inside[r.a & mask] == inside[r.b & mask] for r in found)
    root = {p: p for p in prints}
    for _ in range(len(prints)):
        for r in found:
            low = min(root[r.a & mask], root[r.b & mask])
            root[r.a & mask] = root[r.b & mask] = low
    assert len(set(root.values())) == len(set(classes(prints).values()))


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(lower(a)), words(lower(b))))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("crowd", [32, 2])
def test_stage_removes_near_copies_of_similarity_0_8(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng, rows = random.Random(5), []
    for g in range(30):  # a text and copies with words replaced: similar, chained or below 0.8
        base = [f"w{rng.randrange(4000)}" for _ in range(100 + g)]
        for edits in (0, 1, 1, 2, 2, 3, 6):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(copy)))
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    found = {r.doc_id for r in simhash.stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), TINY).collect()}
    assert found == set(root)
    assert 30 < len(found) < len(rows) / 2


def test_stage_links_what_fingerprints_within_3_bits_link(spark, monkeypatch):
    """Without any MinHash key: sets of five-word fingerprints within RADIUS bits that are similar share a component, others do not."""
    real = simhash._sketch

    def no_keys(text):
        found = real(text)
        return pa.array([x | {"bands": []} for x in found.to_pylist()], found.type)

    rng, rows = random.Random(9), [(-1, ""), (-2, " "), (-3, "one two"), (-4, "one two three")]
    for g in range(20):
        base = [f"w{rng.randrange(4000)}" for _ in range(300)]
        for edits in (0, 1, 1, 2, 12):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(copy)))
    prints = [simhash.set_fingerprint(simhash.shingle_set(t.encode())) for _, t in rows]
    root, near = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 3 and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                near += 1
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    monkeypatch.setattr(simhash, "_sketch", no_keys)
    found = {r.doc_id: r.component for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    groups = defaultdict(set)
    for r, (d, _) in zip(root, rows):
        groups[r].add(d)
    assert near > 30
    assert {frozenset(g) for g in groups.values()} == {frozenset(d for d in found if found[d] == c) for c in set(found.values())}


@pytest.mark.parametrize("size", [1, 7, 40, 120])
def test_prefix_join_misses_no_similar_pair(spark, size):
    """Copies of one text without the text itself, of unequal lengths, each a component of its own: all similar pairs are candidates, far ones are not."""
    rng = random.Random(size)
    base = [f"w{rng.randrange(4000)}" for _ in range(size)]
    texts = {}
    for n in range(60):
        copy = base[: rng.randrange(max(1, size * 4 // 5), size + 1)] + [f"t{rng.randrange(30)}" for _ in range(rng.randrange(4))]
        for at in rng.sample(range(len(copy)), min(len(copy), rng.randrange(5))):
            copy[at] = f"x{rng.randrange(200)}"
        texts.setdefault(simhash.shingle_set(" ".join(copy).encode()).tobytes(), (n, " ".join(copy)))
    rows = list(texts.values())
    near = {(a, b) for a, x in rows for b, y in rows if a < b and jaccard(x, y) >= 0.8}
    found = simhash.prefix_pairs(spark.createDataFrame([(n, n) for n, _ in rows], "set bigint, root bigint"), spark.createDataFrame(rows, "set bigint, text string"))
    pairs = {(min(r), max(r)) for r in found.collect()}
    assert near <= pairs
    assert all(jaccard(dict(rows)[a], dict(rows)[b]) > 0 for a, b in pairs)
    one = simhash.prefix_pairs(spark.createDataFrame([(n, 0) for n, _ in rows], "set bigint, root bigint"), spark.createDataFrame(rows, "set bigint, text string"))
    assert one.count() == 0  # one component has nothing left to link


def test_stage_keeps_one_row_of_each_group(spark, nasty):
    rows = spark.read.parquet(f"{nasty}/documents.parquet").collect()
    more = [(None, "lost id " * 10), (None, "another text without an id"), (3, "the same id but another text"), (90, "another text without an id")]
    pairs = [(r.doc_id, r.text) for r in rows] + more
    root = list(range(len(pairs)))
    for i in range(len(pairs)):
        for j in range(i):
            if root[i] != root[j] and jaccard(pairs[i][1], pairs[j][1]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    groups = defaultdict(list)
    for r, (d, _) in zip(root, pairs):
        groups[r].append((d is None, d or 0))
    found = [(r.doc_id is None, r.doc_id or 0) for r in simhash.stage(spark, spark.createDataFrame(pairs, "doc_id bigint, text string"), nasty).collect()]
    assert sorted(found) == sorted(min(g) for g in groups.values())
    assert (True, 0) in found and found.count((False, 3)) == 2


# 5


def test_chat_round_trip_and_sharing(spark):
    rows = [(c, t, r, x, None) for c in range(50) for t, (r, x) in enumerate([("system", "same <<SYS>> \\"), ("user", f"u{c % 5} [INST]"), ("assistant", f"a{c} </s>\\<s>"), ("to>ol", "<<ROLE \n")])]
    packed = chat.packs(spark.createDataFrame(rows, TALKS)).collect()
    got = {}
    for p in packed:
        for m in p.members:
            whole, loss = chat.unpack(p.text, [n.asDict(True) for n in p.nodes], m.node)
            got[m.conv_id] = chat.parse(whole)
            assert [chat.unescape(whole[s : s + n]) for s, n in loss] == [x for r, x in got[m.conv_id] if r == "assistant"]
            for n in p.nodes:  # every token attends to its ancestors and itself, nothing else
                assert sum(i.end - i.start for i in n.attends) == n.position + n.length
    assert got == {c: [(r, x) for k, _, r, x, _ in rows if k == c] for c in range(50)}
    assert sum(len(p.text) for p in packed) < 0.8 * sum(len(chat.segment(r, x)[0]) for _, _, r, x, _ in rows)


# 6


def test_lm_base_scores_and_held_out_gain(spark):
    import zlib

    docs = documents(spark)
    train = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 7 != 2]
    counts = Counter(w for d in train for w in [*words(lower(d.text)), "\n"])
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in lm.op6_lm_scoring(spark, TINY).collect()}
    held = []
    for d in docs:
        seq, r = [*words(lower(d.text)), "\n"], rows[d.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d not in train, len(seq), sum(w in counts for w in seq), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in seq), rel=1e-9)
        if r.held_out:
            held.append((r.score, r.base_score))
    assert sum(s for s, _ in held) > sum(b for _, b in held)  # bigrams predict held-out text better than counts


def test_lm_probabilities_sum_to_one(spark):
    """Over all words and the end, after any word: 10 ** (score of "a x" less what "a" and the end cost) sums to 1."""
    import numpy as np


    bigrams = spark.createDataFrame([(0 * 8 + w, c) for w, c in ((1, 30), (2, 20), (3, 1), (6, 9))] + [(7 * 8 + 1, 5), (1 * 8 + 0, 2)], "key bigint, c bigint")
    own, model = lm.train(bigrams, 8)
    found = {r.key: r.own for r in own.collect()}
    keys = np.arange(0 * 8, 0 * 8 + 7)  # the start symbol is no dish
    total = sum(found.get(int(k), 0.0) for k in keys) + model.lower(keys).sum()
    assert total == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("n,others,parent", [(2, 5, 0.3), (20, 10, 0.02), (60, 300, 0.02), (300, 300, 0.02), (1000, 300, 0.02), (1500, 300, 0.02), (1500, 4000, 0.2), (3000, 1000, 0.2), (3000, 40, 0.001)])
def test_tables_have_their_exact_conditional(n, others, parent):
    """Mean and spread of drawn table counts against the full recursion: weights of t tables of n customers, others fixed. Up to STIRLING within 4 standard errors, above within 1 % more."""
    import numpy as np

    for d, s in zip(lm.DISCOUNTS, lm.STRENGTHS):
        log_s, t = np.full(n + 2, -np.inf), np.arange(n + 2)
        log_s[1] = 0.0
        for c in range(1, n):
            grown = np.logaddexp(np.concatenate(([-np.inf], log_s[:-1])), log_s + np.log(np.maximum(c - d * t, 1e-300)))
            grown[c + 2 :] = -np.inf
            log_s = grown
        w = np.concatenate(([0.0], np.cumsum(np.log(s + d * (others + t[:-1])) + np.log(parent)))) + log_s
        w = np.exp(w[1 : n + 1] - w[1 : n + 1].max())
        mean = (w * t[1 : n + 1]).sum() / w.sum()
        sd = math.sqrt((w * (t[1 : n + 1] - mean) ** 2).sum() / w.sum())
        x = lm.seat(np.arange(4000), np.full(4000, n), np.full(4000, float(others)), np.full(4000, parent), d, s, 7)
        assert abs(x.mean() - mean) < 4 * sd / 4000**0.5 + (0.01 * mean if n > lm.STIRLING else 0)
        assert abs(x.std() - sd) < 0.06 * sd + 0.02
    assert lm.seat(np.arange(2), np.array([0, 1]), np.zeros(2), np.full(2, 0.5), 0.8, 1.0, 1).tolist() == [0, 1]


def test_lm_scores_by_brute_force(spark, monkeypatch):
    """score of every document from the model's own averaged tables: own share plus backoff, the end and the start symbol included."""
    import numpy as np

    kept = {}

    def spy(bigrams, width, burn=lm.BURN, samples=lm.SAMPLES, real=lm.train):
        own, model = real(bigrams, width, burn, samples)
        kept.update(own={r.key: r.own for r in own.collect()}, model=model, width=width)
        return own, model

    monkeypatch.setattr(lm, "train", spy)
    texts = ["the cat sat on the mat", "the cat ate", "a dog sat", None, "", "the dog ate the cat and the mat", "unseen words only", "the the the the"] * 3
    rows = {r.doc_id: r for r in lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    train = [i for i in range(len(texts)) if not rows[i].held_out]
    counts = Counter(w for i in train for w in words(texts[i]))
    order = sorted(counts, key=lambda w: (-counts[w], w))
    index = {w: i for i, w in enumerate(order, 1)}
    end, start, width = len(order) + 1, len(order) + 2, len(order) + 3
    assert kept["width"] == width
    for i, text in enumerate(texts):
        seq, before, total = [index.get(w, 0) for w in words(text)] + [end], start, 0.0
        for w in seq:
            key = before * width + w
            total += math.log10(kept["own"].get(key, 0.0) + float(kept["model"].lower(np.array([key]))[0]))
            before = w
        unknown = seq.count(0)  # a class without training words: one of 0 + 0 + 1
        assert rows[i].score == pytest.approx(total + unknown * math.log10(1 / 1), rel=1e-9)


@pytest.mark.parametrize("lookup", [lm.LOOKUP, 1])
def test_lm_tells_rare_words_apart(spark, monkeypatch, lookup):
    """Words under 1/50,000 of all tokens have restaurants of their own, in the lookup table and outside it."""
    import zlib

    monkeypatch.setattr(lm, "LOOKUP", lookup)
    learn = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = list(zip(learn, ["the " * 500_000, *["zeta eta", "theta iota"] * 8])) + list(zip(held, ["zeta eta", "zeta iota", "theta iota", "theta eta"]))
    found = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for seen, unseen in ((0, 1), (2, 3)):  # words of the same counts, in an order that training has and in one it lacks
        assert found[held[seen]] > found[held[unseen]] + 1


def test_lm_words_outside_the_lookup_table_by_brute_force(spark, monkeypatch):
    """Most words cold: scores from the model's tables, one by one, and probabilities of all dishes after any word that sum to 1."""
    import numpy as np

    kept = {}

    def spy(bigrams, width, burn=lm.BURN, samples=lm.SAMPLES, real=lm.train):
        own, model = real(bigrams, width, burn, samples)
        kept.update(own={r.key: (r.c, r.own) for r in own.collect()}, model=model, cold={r.id: r for r in model.cold.collect()}, width=width)
        return own, model

    for name, value in (("train", spy), ("LOOKUP", 15), ("BIGRAMS", 60)):
        monkeypatch.setattr(lm, name, value)
    draw = random.Random(5)
    texts = [" ".join(f"w{int(draw.paretovariate(0.7)) % 90}" for _ in range(draw.randrange(30))) for _ in range(120)]
    rows = {r.doc_id: r for r in lm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    learn = [i for i in range(len(texts)) if not rows[i].held_out]
    counts = Counter(w for i in learn for w in words(texts[i]))
    n, width, model, cold = sum(counts.values()) + len(learn), kept["width"], kept["model"], kept["cold"]
    least = min(c for c in counts.values() if sum(x >= c for x in counts.values()) <= 15)
    hot = sorted((w for w in counts if counts[w] >= least), key=lambda w: (-counts[w], w))
    index = {w: i for i, w in enumerate(hot, 1)}
    id_of = lambda w: index.get(w) or lm.cold_id(w.encode())
    assert width == len(hot) + 3 and {i: r.n for i, r in cold.items()} == {id_of(w): c for w, c in counts.items() if w not in index}
    assert len(cold) > 20 and any(w not in counts for t in texts for w in words(t))
    end, start = width - 2, width - 1
    dishes = [*range(width - 1), *cold]
    seqs = {i: [start, *map(id_of, words(t)), end] for i, t in enumerate(texts)}
    pairs = sorted({p for s in seqs.values() for p in zip(s, s[1:])} | {(u, w) for u in [*range(width), *cold] for w in dishes})
    keys = {(r.u, r.w): r.key for r in spark.createDataFrame(pairs, "u bigint, w bigint").select("u", "w", lm._key(F.col("u"), F.col("w"), width).alias("key")).collect()}
    samples = range(len(model.unigram))

    def probability(u, w):
        own = kept["own"].get(keys[u, w], (0, -1.0 if seen[u, w] else 0.0))[1]
        if own < 0:
            assert seen[u, w] == 1
            own = (1 - lm.DISCOUNTS[1]) / (lm.STRENGTHS[1] + (cold[u].n if u < 0 else model.total[u]))
        b = [model.backoff[s][u] if u >= 0 else cold[u][f"b{s}"] if u in cold else 1.0 for s in samples]
        p = [model.unigram[s][w] if w >= 0 else cold[w][f"p{s}"] if w in cold else model.unigram[s][0] for s in samples]
        return own + float(np.mean([x * y for x, y in zip(b, p)]))

    seen = Counter(p for i in learn for p in zip(seqs[i], seqs[i][1:]))
    asked = {p for i, s in seqs.items() if i not in learn for p in zip(s, s[1:])}
    assert {keys[p]: c for p, c in seen.items() if c > 1 or p in asked or c * 60 >= n} == {k: c for k, (c, _) in kept["own"].items()}
    for i, s in seqs.items():
        assert rows[i].score == pytest.approx(sum(math.log10(probability(u, w)) for u, w in zip(s, s[1:])), rel=1e-9)
    for u in [1, start, *cold]:
        assert sum(probability(u, w) for w in dishes) == pytest.approx(1.0, abs=1e-9)


def test_lm_bigrams_travel_in_few_bytes(spark):
    """Counting bigrams shuffles some 3 bytes for each, not a row, and counts exactly, with cold words and rare ones that held-out documents ask for."""
    import zlib

    draw = random.Random(8)
    names = [f"w{i}" for i in range(3000)]
    texts = [" ".join(draw.choices(names, k=2000)) for _ in range(100)] + ["w1 w2 zeta w3", "eta zeta", None, "  W1\x0bw2 zeta w3 "] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    counts = Counter(w for t, x in zip(texts, learn) if x for w in words(lower(t or "")))
    hot = sorted((w for w in counts if w in set(names)), key=lambda w: (-counts[w], w))
    vocab = spark.sparkContext.broadcast(lm.Vocabulary([w.encode() for w in hot], [counts[w] for w in hot], sum(counts.values()) + sum(learn), len(counts) + 1, sum(learn), 1))
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    rows = lm.count_bigrams(docs, vocab).collect()
    found = {r.key: r.c for r in rows}
    assert len(rows) == len(found)
    index, end = {w: i for i, w in enumerate(hot, 1)}, len(hot) + 1
    id_of = lambda w: index.get(w) or lm.cold_id(w.encode())
    seqs = [[end + 1, *map(id_of, words(lower(t or ""))), end] for t in texts]
    seen = Counter(p for s, x in zip(seqs, learn) if x for p in zip(s, s[1:]))
    asked = {p for s, x in zip(seqs, learn) if not x for p in zip(s, s[1:])}
    wanted = {p: c for p, c in seen.items() if c > 1 or p in asked or c * lm.BIGRAMS >= vocab.value.n}
    assert {(r.u, r.w): r.c for r in rows if r.key < 0} == {p: c for p, c in wanted.items() if min(p) < 0} != {}
    assert {r.key: r.c for r in rows if r.key >= 0} == {u * vocab.value.width + w: c for (u, w), c in wanted.items() if min(u, w) >= 0}
    assert sum(n for s, n in written().items() if s not in before) < 5 * len(seen)


def test_lm_parts_and_blobs():
    """Mixing is one to one, parts hold each key once, and blobs give back what was packed."""
    import numpy as np

    for width in (4, 1000, lm.LOOKUP + 3):
        parts = lm.Parts(width, 24)
        keys = np.unique(np.random.default_rng(3).integers(0, width * width, 5000))
        run = np.sort(parts.mix(keys))
        assert len(np.unique(run)) == len(keys) and np.array_equal(np.sort(parts.keys(run)), keys)
        cut = list(parts.cut(run))
        assert [i for _, at in cut for i in range(at.start, at.stop)] == list(range(len(run)))
        assert width == 4 or max(at.stop - at.start for _, at in cut) < 2 * len(run) / 24
        again, back = lm._unpack(lm._pack(run, keys.astype(np.uint16)), len(run), np.uint16)
        assert np.array_equal(again, run) and np.array_equal(back, keys.astype(np.uint16))
    cold = np.array([0, 1, 2**62, 2**63 - 1], np.uint64)
    assert [(p, at.start, at.stop) for p, at in lm._cut_cold(cold, 4)] == [(0, 0, 2), (2, 2, 3), (3, 3, 4)]
    texts = [b"", b" ", b"A", b" a\x0bB\x0c\r\tc  d ", b"\xff\xfe A\x00B \xc2\xa0x \x1c q\x1fA", b"\n\n"]
    found, lengths = lm._split(texts)
    assert found.to_pylist() == [w for t in texts for w in t.lower().split()] and lengths.tolist() == [len(t.split()) for t in texts]


# 7


def test_line_dedup_small(spark, nasty):
    docs = [(d[0], d[1]) for d in NASTY_DOCS]
    holders = defaultdict(set)
    key = lambda line: lower(line).strip(" \t\n\x0b\x0c\r")
    for i, t in docs:
        if i is not None:
            for line in (t or "").split("\n"):
                holders[key(line)].add(i)
    want = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and i != max(holders[key(x)]))]
        want.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.op7_line_dedup(spark, nasty).collect())
    assert got == sorted(want)
    assert sum(w[2] for w in want) == 7


def test_line_dedup_counts_documents_not_rows(spark, tables):
    """Two documents of three rows each share a line: two documents have it, so it stays. Five documents lose it but in the last, row by row."""
    rows = [(d, f"{LINE}\nrow {i}", "en", "a", 1, "k", 1, 2, "p") for d in (1, 2) for i in range(3)] + [(d, f"{LINE} x\n{d}", "en", "a", 1, "k", 1, 2, "p") for d in (1, 1, 2, 3, 4, 5, 5)]
    where = tables(documents=(rows, DOCS))
    got = sorted((r.doc_id, r.n_dropped) for r in linededup.op7_line_dedup(spark, where).collect())
    assert got == sorted([(d, 0) for d in (1, 2) for _ in range(3)] + [(d, int(d < 5)) for d in (1, 1, 2, 3, 4, 5, 5)])
    against_sql(spark, linededup.op7_line_dedup, registry.SQL["op7_line_dedup"], where)


def test_line_dedup_sql_on_hard_rows(spark, nasty):
    against_sql(spark, linededup.op7_line_dedup, registry.SQL["op7_line_dedup"], nasty)


def test_line_runs_are_levelled(spark):
    lines = lambda rows: linededup.lines_of(spark.createDataFrame(rows, "doc_id bigint, text string"))
    runs = linededup.LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add_batch(lines([(10 * b + i, f"{LINE} {i % 3} batch {b // 2}") for i in range(6)]))
    assert {level: len(r) for level, r in runs.levels.items() if r} == {0: 1, 2: 1}
    keys = [tuple(r) for run in runs.runs() for r in run.select("h1", "h2").collect()]
    assert len(keys) == len(set(keys)) == 9  # a key stands in one run
    assert sorted((r.n, r["last"]) for r in runs.totals().collect()) == sorted([(4, 10 + i) for i in (3, 4, 5)] + [(4, 30 + i) for i in (3, 4, 5)] + [(2, 40 + i) for i in (3, 4, 5)])
    old = runs._bucketed(linededup.count_lines(lines([(98, f"{LINE} 0 batch 0"), (99, f"{LINE} is new")])), "batch")
    assert [r["last"] for r in runs.unseen(old).collect()] == [99]
    plan = runs.unseen(old)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
    merged = linededup.LineRuns._merge(*runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in merged and "Exchange" not in merged
    runs.drop()


# 8

PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>Home<li>News</ul></nav><div class="notice">We use cookies</div>
<main><article><h1>Title {0}</h1><p>First &amp; best <b>bo</b>ld {0}.</p><p>Read   more:</p><p>Second\n line {0}</p><form>Mail <input></form></article></main><aside>Ads</aside><section id="comments"><p>I disagree {0}</p></section><footer>(c)</footer><script>var x="<p>no</p>"</script></body></html>"""


def test_html_extraction(spark, tables):
    pages = [(i, f"http://h.com/{i}", PAGE.format(i), "x") for i in range(20)] + [(50, "http://other.org/", "<p>Only<p>this", "x"), (51, None, "<div>a<br>b</div>tail", "x")]
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.op8_html_extraction(spark, tables(pages=(pages, PAGES))).collect()}
    for i in range(20):  # what stands in every page of the host is template text
        assert got[i][0] == f"Title {i} First & best bold {i}. Second line {i}"
        assert got[i][1] == len(got[i][0])
    assert got[50][0] == "Only this"
    assert got[51][0] == "a b tail"



def test_html_content_class_is_a_hint():
    teaser = "<div class='post'><p>A short teaser.</p></div>"
    story = "<p>The story stands outside of it and is much longer.</p><p>It goes on.</p>"
    assert htmltext.article(htmltext.blocks(f"<body>{teaser}{story}</body>"), set()) == "A short teaser. The story stands outside of it and is much longer. It goes on."
    assert htmltext.article(htmltext.blocks(f"<body><p>Around.</p><div class='post'>{story}</div></body>"), set()) == "The story stands outside of it and is much longer. It goes on."
    assert htmltext.article([], set()) == ""


def test_html_list_classes_nest(spark, tables):
    """Block texts that stand in every repetition of a list are template text, however often a page repeats it."""
    item = lambda i, k: f"<div class='item'><p>Text {i} of item {k}</p><p class='more'>Read on here</p></div>"
    rows = [(i, f"http://h.com/{i}", f"<html><body><article><h1>Head {i}</h1>{''.join(item(i, k) for k in range(1 + i % 4))}</article></body></html>", "x") for i in range(12)]
    where = tables(pages=(rows, PAGES))
    got = {r.page_id: r.text for r in htmltext.op8_html_extraction(spark, where).collect()}
    assert got == {i: " ".join([f"Head {i}", *(f"Text {i} of item {k}" for k in range(1 + i % 4))]) for i in range(12)}
    found = htmltext.templates(spark.read.parquet(f"{where}/pages.parquet")).collect()
    (listed,) = [r for r in found if not r.root]
    assert listed.tokens == 4 and len(listed.texts) == 1 and listed.parent in {r.vector for r in found if r.root}


def test_html_classes_by_brute_force(spark, tables):
    rng = random.Random(8)
    rows = []
    for host in ("a.com", "b.com", "few.com"):
        for i in range(4 if host == "few.com" else 15):
            body = "".join(rng.choice(("<ul class='a/b'>{}</ul>", "<div>{}</div>")).format("".join(f"<li><b>go</b></li><li>x{rng.randint(0, 3)}</li>" for _ in range(rng.randint(0, 3)))) for _ in range(rng.randint(1, 3)))
            rows.append((len(rows), f"http://{host}/{i}", f"<html><body><h2>Same</h2><p>Own {host} {i // 2}</p>{body}<ol>{'<li><p>Go on</p></li>' * rng.randint(1, 3)}</ol><div class='foot'><p>End</p></div></body></html>", "x"))
    pages = spark.read.parquet(f"{tables(pages=(rows, PAGES))}/pages.parquet")
    want = set()
    for host in ("a.com", "b.com", "few.com"):
        counts, owners = {}, {}
        for _, url, html, _ in rows:
            if host in url:
                blocks = htmltext.blocks(html)
                page = max((b[3] for b in blocks if b[3]), key=len)
                owners |= {(p, t): o for (p, t), o in htmltext._owners(blocks).items()}
                for key, n in Counter((b[0], b[3]) for b in blocks).items():
                    at = counts.setdefault(key, {})
                    at[page] = max(at.get(page, 0), n)
        n_pages = len({p for at in counts.values() for p in at})
        if n_pages < htmltext.LEAST:
            continue
        often = {k: frozenset(at.items()) for k, at in counts.items() if len(at) >= htmltext.LEAST and len(at) >= htmltext.SUPPORT * n_pages}
        element = {htmltext._token(*k): v for k, v in often.items() if not k[1]}
        for v in set(often.values()):
            group = [k for k, w in often.items() if w == v]
            root = all(n == 1 for _, n in v)
            parents = {element.get(owners[k]) for k in group if not k[1] and element.get(owners[k]) != v}
            if len(group) > 1 and any(not t for _, t in group) and (root or len(parents) == 1):
                want.add((host, root, len(group), tuple(sorted(htmltext._token(*k) for k in group if k[1] and (root or element.get(owners[k]) == v)))))
    got = {(r.host, r.root, r.tokens, tuple(sorted(r.texts))) for r in htmltext.templates(pages).collect()}
    assert got == want and any(not r for _, r, *_ in got)


# 9


def bag(w):
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else []


def test_window_fingerprints_and_weights(spark):
    """Fingerprints of short and long lists, and weighted overlaps with and without repeats, against Python."""
    rng = random.Random(2)
    lists = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 64, 300)] + [[5, 5, -9, 5, 7], [rng.getrandbits(64) - (1 << 63)] * 70_000 + [1, 2]]
    bags = [Counter(rng.choices(x, k=1 + len(x) // 2 % 500)) for x in lists]
    rows = [(i, x, [(h, c) for h, c in b.items()]) for i, (x, b) in enumerate(zip(lists, bags))]
    df = spark.createDataFrame(rows, "i int, hs array<bigint>, bag array<struct<h:bigint,c:int>>")
    for r in df.select("i", decontaminate._simhash(F.col("hs")).alias("fp"), decontaminate._shared("bag", "hs").alias("s")).collect():
        x = lists[r.i]
        assert r.fp & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x) > len(x))
        assert r.s == sum((Counter(x) & bags[r.i]).values())


def test_decontamination_against_all_windows(spark, tables):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=n))) for i, n in enumerate((6, 12, 25, 40, 60, 60, 3, 90))]
    docs = []
    for i in range(120):
        w = rng.choices(vocab, k=rng.randint(20, 200))
        item = rng.choice(items)[1].split()
        for _ in range(rng.choice((0, 0, 1, 1, 2))):  # some edits, some of which leave the similarity at 0.8 or more
            item[rng.randrange(len(item))] = "edit"
        at = rng.randint(0, len(w))
        docs.append((i, " ".join(w[:at] + item + w[at:]).upper() if i % 3 else " ".join(w), "en", "a", 1, "k", 1, 2, "p"))
    where = tables(documents=(docs, DOCS), benchmark=([(i, t, 1) for i, t in items], BENCH))
    want = {}
    for i, text, *_ in docs:
        for j, item in items:
            b, k = bag(item.split()), min(5, len(item.split()))
            w = words(lower(text))
            d = [tuple(w[p : p + k]) for p in range(len(w) - k + 1)]
            counts = Counter(b)
            for p in range(len(d)):
                part = Counter(d[p : p + len(b)])
                shared = sum((part & counts).values())
                if 5 * shared >= 4 * (of := sum((part | counts).values())):
                    want[i, j] = max(want.get((i, j), 0), shared / of)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.op9_benchmark_decontamination(spark, where).collect()}
    assert got == pytest.approx(want)
    assert len(want) > 20


# 10


def test_url_rules(spark, tables):
    urls = ["http://www.example.com/en/a", "http://example.com/en/a", "https://x.example.com/en/", "http://EXAMPLE.com/fr/", "http://a.net/es/x", "http://a.net/fr", "ftp://net/fr/?q", "http://b.org/a/b", None, "none", "http://", "http://c.com?x://y/z", "http://notexample.com/en/", "http://u@h.com:80/p#f"]
    urls += [f"http://s.net/es/{i}" for i in range(40)]
    rules = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    got = {r.page_id: r for r in urlfilter.op10_url_filters(spark, tables(pages=([(i, u, "", "h") for i, u in enumerate(urls)], PAGES))).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1]) if u and "://" in u else None
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        if rule:
            assert got[i].verdict == rules[rule]
        else:
            assert got[i].verdict == ("block" if got[i].labelled >= urlfilter.MIN_LABELLED and got[i].purity < urlfilter.PURITY else "allow")


def test_url_tree_decides_where_no_rule_fits(spark, tables):
    """Labelled branches are all blocked: an unruled sibling of the same shape is rejected with them, one of another shape or on a clean host is not."""
    urls = [f"http://bad.net/{x}/{i}" for x in ("es", "fr") for i in range(30)]
    urls += [f"http://bad.net/pt/{i}" for i in range(30)] + ["http://bad.net/about"] * 30 + ["http://bad.net/it/1"]
    urls += [f"http://clean.net/{x}/{i}" for x in ("pt", "it") for i in range(30)]
    urls += [f"http://www.good.com/{x}/{i}" for x in ("es", "fr") for i in range(90)]
    rows = urlfilter.op10_url_filters(spark, tables(pages=([(i, u, "", "h") for i, u in enumerate(urls)], PAGES))).collect()
    got = {urls[r.page_id]: r for r in rows}
    assert all(r.verdict == "block" and r.rule is None and r.template.startswith("/+") for u, r in got.items() if "/pt/" in u and "bad" in u)
    assert {r.verdict for u, r in got.items() if "clean.net" in u or "good.com" in u or "about" in u or u.endswith("it/1")} == {"allow"}


# the pipeline


def leaking(docs, items):
    """Ids of documents (id, text) that hold a window of similarity 0.8 or more to an item, over all windows."""
    out = set()
    for j, item in items:
        iw = words(lower(item))
        k, counts = min(5, len(iw)), Counter(bag(iw))
        m = sum(counts.values())
        for i, text in docs:
            w = words(lower(text))
            d = [tuple(w[p : p + k]) for p in range(len(w) - k + 1)] if k else []
            if i in out or not counts.keys() & set(d):
                continue
            for p in range(len(d)):
                part = Counter(d[p : p + m])
                if 5 * sum((part & counts).values()) >= 4 * sum((part | counts).values()):
                    out.add(i)
                    break
    return out


def check_stages(spark, where, docs):
    """Every stage against brute force on what the stage before it kept."""
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect() if r.item_id is not None and r.text]
    columns, key = docs.columns, lambda line: lower(line).strip(" \t\n\x0b\x0c\r")
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    order = lambda rows: sorted(rows, key=str)
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = materialize(step(spark, docs, where), "stage-test")
        assert docs.columns == columns
        now = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "quality" and {d for d, _ in kept} == {r.doc_id for r in quality.op1_quality_rules(spark, where).collect()}:
            kept_ids = Counter(r.doc_id for r in quality.op1_quality_rules(spark, where).collect() if r.kept)
            assert Counter(d for d, _ in now) == kept_ids and Counter(now) <= Counter(kept)
        elif name == "line_dedup":
            holders = defaultdict(set)
            for d, t in kept:
                for line in (t or "").split("\n"):
                    if d is not None:
                        holders[key(line)].add(d)
            gone = lambda d, x: d is not None and len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and d != max(holders[key(x)])
            assert order(now) == order((d, t if t is None else "\n".join(x for x in t.split("\n") if not gone(d, x))) for d, t in kept)
        elif name == "simhash_near_dedup":
            grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(lower(t)) for _, t in kept)]
            at, root = defaultdict(set), list(range(len(kept)))
            for i, g in enumerate(grams):
                near = {j for x in g for j in at[x] if len(g & grams[j]) * 5 >= 4 * len(g | grams[j])}
                for x in g:
                    at[x].add(i)
                low = min([root[i], *[root[j] for j in near]])
                merged = {root[i], *[root[j] for j in near]}
                root = [low if r in merged else r for r in root]
            first: dict = {}
            for r, (d, _) in zip(root, kept):
                first[r] = min(first.get(r, (True, 0)), (d is None, d or 0))
            assert sorted((d is None, d or 0) for d, _ in now) == sorted(first.values()) and Counter(now) <= Counter(kept)
        elif name == "decontamination":
            out = leaking([x for x in kept if x[0] is not None], bench)
            assert order(now) == order((d, t) for d, t in kept if d not in out)
        kept = now
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, where)
    assert mixed.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted((str(r.doc_id), r["size"]) for r in mixed.collect()) == sorted((str(d), len(words(t))) for d, t in kept)
    return mixed


def test_pipeline_stages(spark):
    rows = check_stages(spark, TINY, spark.read.parquet(f"{TINY}/documents.parquet")).collect()
    taken, goal, longest = Counter(), {}, 0
    of = {r.doc_id: r.source for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()}
    for r in rows:
        taken[of[r.doc_id]] += r.taken
        goal[of[r.doc_id]], longest = r.target, max(longest, r["size"])
    assert all(abs(taken[s] - goal[s]) <= longest for s in goal)
    assert sorted(map(str, corpus_pipeline.run(spark, TINY).collect())) == sorted(map(str, rows))


def test_pipeline_stages_on_hard_rows(spark, nasty):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing columns; each stage begins with rows that pass the one before."""
    long_ = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    more = [(100 + i, f"{long_} {i}\n{LINE}", None, None, None, None, None, None, None) for i in range(6)] + [(None, f"{long_} lost\n{LINE}", "en", "a", 1, "k", 1, 2, "p")] * 2 + [(100, "another " + long_, "en", "a", 1, "k", 1, 2, "p")]
    docs = spark.createDataFrame(NASTY_DOCS + more, DOCS)
    check_stages(spark, nasty, docs)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, nasty).count() <= docs.count()
    assert corpus_pipeline.run(spark, nasty).count() <= len(NASTY_DOCS)


def test_pipeline_on_empty_tables(spark, tables):
    where = tables(documents=([], DOCS), labels=([], LABELS), benchmark=([], BENCH))
    assert corpus_pipeline.run(spark, where).collect() == []
