"""Operator 8: HTML extraction by equivalence-class template deduction.

A page is read into blocks: the texts between block-level tags, each with the path of its elements. Tokens are element
paths and block texts under their path. Over the pages of a host, tokens with the same occurrence vector (how often in
which page) form an equivalence class; vectors are compared by an order-free 64-bit sum of their entries, so they are
counted in partial aggregates and never gathered. Copies of a page count once (the page's longest block stands for it).
A class is valid if it spans at least two tokens, at least one of them an element, in SUPPORT of a host's distinct
pages and at least LEAST of them. Classes that occur once in each of their pages form the template's root. Any other class is a
list, repeated as often as a page likes: it nests in the class that owns the element around its outermost elements, and is
valid if that is one class. Template text is every block text of a root class, and of a list class every block text that stands under
an element of the same class, so once in each repetition. The rest fills slots.

From the slots the article is taken: regions that are menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or reader comments by element, role or class are left out; if the page has an article (else a main) element,
only slots inside it count; else, if elements of a content class hold at least half of what remains, only those; else all. Character references are decoded, white space
inside a block becomes one space, blocks are joined in page order.

Null html is an empty text, null url an empty host. Cut-off pages are read as far as they go. Repeated rows are pages of
their own; columns beyond page_id, url and html are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import UPPER, LOWER, broadcast_if, materialize, table

SUPPORT, LEAST = 0.9, 5
_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTR = re.compile(r"([^\s=/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea iframe xmp noembed noframes".split())
OUT = frozenset("head nav footer aside form button select option dialog menu svg object canvas audio video figure-caption map math".split()) | RAW
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe signup sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond reply replies "
    "share sharing social related recommended toolbar login search pagination pager form copyright".split()
)
CONTENT_WORDS = frozenset("content post entry story article body main text".split())
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",))}


def _role(name: str, attrs: str, inside: int) -> tuple[bool, int, str]:
    """(left out, 3 article / 2 main / 1 content / 0, class label) of an element inside content of that rank."""
    out, rank, label = name in OUT, 3 if name == "article" else 2 if name == "main" else 0, ""
    if name == "header" and inside < 2:
        out = True
    if attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                out |= value.lower() in OUT_ROLES
                rank = max(rank, 2 if value.lower() == "main" else 3 if value.lower() == "article" else 0)
            elif key in ("class", "id"):
                words = {w.lower() for w in _WORD.findall(value)}
                out |= bool(words & OUT_WORDS) and name not in ("html", "body", "article", "main") or name == "article" and bool(words & {"comment", "comments", "ad", "advert", "sponsored", "promo"})
                if "header" in words and inside < 2 and name not in ("html", "body", "article", "main") and not name[1:].isdigit():
                    out = True
                if words & CONTENT_WORDS and name in ("div", "section", "td"):
                    rank = max(rank, 1)
                label += "." + value.replace("/", "|")
            elif key == "itemprop" and value == "articleBody":
                rank = max(rank, 2)
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                out = True
    return out, rank, label


def blocks(page: str) -> list[tuple[str, bool, int, str]]:
    """(path, left out, rank of the content element around, text) of each block in page order; elements have text ""."""
    found: list[tuple[str, bool, int, str]] = []
    stack: list[tuple[str, str, bool, int]] = []  # name, path, left out, rank
    pieces: list[str] = []
    at, n = 0, len(page)

    def state() -> tuple[str, bool, int]:
        return stack[-1][1:] if stack else ("", False, 0)

    def end_block() -> None:
        if pieces:
            if text := _SPACE.sub(" ", "".join(pieces)).strip():
                found.append((*state(), text))
            pieces.clear()

    def pop_to(i: int) -> None:
        end_block()
        del stack[i:]

    while at < n:
        lt = page.find("<", at)
        m = _TAG.match(page, lt) if lt >= 0 else None
        if m is None:
            stop = n if lt < 0 else lt + 1
            pieces.append(_html.unescape(page[at:stop]))
            at = stop
            continue
        if lt > at:
            pieces.append(_html.unescape(page[at:lt]))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name or m[5] and not m[0].endswith(">"):
            continue
        if m[1] or m[4]:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if i >= 0:
                if name in INLINE and not stack[i][2]:
                    if all(x[0] in INLINE for x in stack[i:]):
                        end_block() if any(x[2] for x in stack[i:]) else None
                        del stack[i:]
                else:
                    pop_to(i)
            elif name not in INLINE:
                end_block()
            continue
        attrs = m[3] or m[6] or ""
        if name in VOID:
            pieces.append(" ") if name in ("br", "hr") else None
            if name == "hr":
                end_block()
            continue
        if name not in INLINE:
            end_block()
            if name in _CLOSES:
                same, limits = _CLOSES[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in limits:
                        break
                    if stack[i][0] in same.split():
                        pop_to(i)
                        break
            elif (i := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in INLINE), -1)) >= 0 and stack[i][0] == "p":
                pop_to(i)
        path, out, rank = state()
        own_out, own_rank, label = _role(name, attrs, rank)
        if name in RAW:
            close = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(page, at)
            at = n if close is None else page.find(">", close.start()) + 1 or n
            continue
        if name in INLINE and own_out and not out:
            end_block()
        here = (name, f"{path}/{name}{label}", out or own_out, max(rank, own_rank))
        stack.append(here)
        if name not in INLINE:
            found.append((*here[1:], ""))
    end_block()
    return found


def _token(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}".encode("utf-8", "replace")) - (1 << 63)


def _owners(found: list[tuple[str, bool, int, str]]) -> dict[tuple[str, str], int]:
    """(path, text) -> token of the nearest block element around it; "" stands above all."""
    elements = {path for path, _, _, text in found if not text} | {""}
    owners = {}
    for path, _, _, text in found:
        if (path, text) not in owners:
            above = path if text else path.rpartition("/")[0]
            while above not in elements:
                above = above.rpartition("/")[0]
            owners[path, text] = _token(above, "")
    return owners


def article(found: list[tuple[str, bool, int, str]], template: frozenset | set) -> str:
    kept = [(rank, text) for path, out, rank, text in found if text and not out and not (template and _token(path, text) in template)]
    best = next((r for r in (3, 2, 1) if any(rank >= r for rank, _ in kept)), 0)
    if best == 1 and 2 * sum(len(text) for rank, text in kept if rank) < sum(len(text) for _, text in kept):
        best = 0
    return " ".join(text for rank, text in kept if rank >= best)


def _host(url):
    return F.translate(F.coalesce(F.regexp_extract(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), "^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def tokens(pages: DataFrame) -> DataFrame:
    """(host, content, token, owner, is_text, n): how often each token stands in a page, copies of a page told by `content`."""
    names = ["host", "content", "token", "owner", "is_text", "n"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, cols = batch.slice(i, 256), [[] for _ in names]
                for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = blocks(page or "")
                    owners = _owners(found)
                    texts = [b[3] for b in found if b[3]]
                    content = xxhash.xxh64_intdigest(max(texts, key=len, default="").encode("utf-8", "replace")) - (1 << 63)
                    for (path, text), n in Counter((b[0], b[3]) for b in found).items():
                        for c, v in zip(cols, (host, content, _token(path, text), owners[path, text], text != "", n)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return pages.select(_host(F.col("url")).alias("host"), "html").mapInArrow(read, "host string, content bigint, token bigint, owner bigint, is_text boolean, n bigint")


def templates(pages: DataFrame, support: float = SUPPORT, least: int = LEAST) -> DataFrame:
    """(host, vector, root, parent, tokens, texts): the valid equivalence classes of every host. `parent` is the vector of the class that a list class nests in."""
    seen = materialize(tokens(pages).groupBy("host", "content", "token", "owner", "is_text").agg(F.max("n").alias("n")), "html-tokens")
    size = seen.groupBy("host", "content").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("contents")).where(F.col("contents") >= least)
    vector = seen.groupBy("host", "token", "owner", "is_text").agg(F.count("*").alias("pages"), F.max("n").alias("high"), F.bit_xor(F.xxhash64("content", "n")).alias("vector"))
    often = vector.where(F.col("pages") >= least).join(materialize(size, "html-hosts"), "host").where(F.col("pages") >= support * F.col("contents"))
    often = materialize(often.select("host", "token", "owner", "is_text", "high", "vector"), "html-often")
    around = often.where(~F.col("is_text")).select("host", F.col("token").alias("owner"), F.col("vector").alias("around"))
    inside, once = F.col("around").eqNullSafe(F.col("vector")), F.col("high") == 1
    outer = F.when(~F.col("is_text") & ~inside, F.coalesce("around", F.lit(0)))
    classes = often.join(around, ["host", "owner"], "left").groupBy("host", "vector").agg(
        (F.max("high") == 1).alias("root"), F.count("*").alias("tokens"), F.bool_or(~F.col("is_text")).alias("framed"), F.min(outer).alias("parent"), F.max(outer).alias("__other"),
        F.collect_list(F.when(F.col("is_text") & (once | inside), F.col("token"))).alias("texts"),
    )
    valid = classes.where(F.col("framed") & (F.col("tokens") > 1) & (F.col("root") | (F.col("parent") == F.col("__other"))))
    return valid.select("host", "vector", "root", F.when(~F.col("root"), F.col("parent")).alias("parent"), "tokens", "texts")


def extract(pages: DataFrame, support: float = SUPPORT, least: int = LEAST) -> DataFrame:
    """(page_id, url, text) of every page."""
    texts = materialize(templates(pages, support, least).groupBy(F.col("host").alias("__host")).agg(F.flatten(F.collect_list("texts")).alias("__template")), "templates")
    keyed = pages.select("page_id", "url", "html", _host(F.col("url")).alias("__h"))
    joined = keyed.join(broadcast_if(texts, texts.count(), 20_000), keyed["__h"] == texts["__host"], "left")

    def of(page: pa.Array, template: pa.Array) -> pa.Array:
        return pa.array((article(blocks(p), frozenset(t or ())) if p else "" for p, t in zip(page.to_pylist(), template.to_pylist())), pa.string())

    return joined.select("page_id", "url", F.arrow_udf(of, "string")("html", "__template").alias("text"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


QUERIES = {"op8_html_extraction": op8_html_extraction}
SQL: dict[str, str] = {}
