"""Operator 2: token counts. Texts enter Arrow batches, only lengths leave.

Long texts are cut at boundaries where the tokenizer provably cannot merge: white space that its pre-tokenizer drops
("dropped"), or a single space between ASCII letters or digits, which opens the next piece ("led"). The pieces of a batch
are pooled, each distinct one is encoded once in calls of about BATCH_BYTES bytes, and its length is kept in a cache of at most
CACHE entries. So one long document costs what many short ones of the same size do, and memory stays bounded.

Null text is empty: 0 tokens. Invalid UTF-8 is read with replacement characters. Ties, repeated rows and other columns
do not matter: each row is counted by itself.
"""

from __future__ import annotations

import base64
import json
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import table

CACHE, BATCH_BYTES, LONGEST_CACHED = 900_000, 1 << 20, 64
LIMIT = 2048
_LED = re.compile(rb"(?<=[A-Za-z0-9])(?= [A-Za-z0-9])")
#: A word with marks after it that form one piece of their own, and none that open a contraction or special string.
_PLAIN = re.compile(rb"([A-Za-z\x80-\xff]+)([!#-&(-/:;=@\[-`{}~]*)")
_LATIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
_WORD_LAYOUT = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    None,
)


class Counter:
    """Lengths by the library that owns the file: .json tokenizers, .tiktoken tiktoken, .model sentencepiece."""

    def __init__(self, path: str):
        self.cache: dict[bytes, int] = {}
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.encode = lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            # words and marks apart, white space gone: the one layout where pieces are words
            self.dropped = (spec["normalizer"], spec["pre_tokenizer"], spec["post_processor"]) == _WORD_LAYOUT
            if self.dropped:
                self.model = tok.model
        elif path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode, self.dropped = lambda texts: [len(enc.encode_ordinary(t)) for t in texts], False
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            # a dummy space opens every text, so a piece that begins with its own space gives it up
            self.encode, self.dropped = lambda texts: [len(x) for x in sp.encode([t[1:] if t[:1] == "\0" else t for t in texts], num_threads=1)], False
            self.mark = True

    mark, model = False, None

    def pieces(self, text: bytes) -> list[bytes]:
        if self.dropped:
            # in their own case: the library finds its special strings before it lower-cases
            return text.split()
        found = _LED.split(text) if text else []
        return found[:1] + [b"\0" + x[1:] for x in found[1:]] if self.mark else found

    def _learn(self, new: list[bytes]) -> dict[bytes, int]:
        """Lengths of unseen pieces; what the model may be asked directly skips the library's per-text overhead."""
        learned, call, size = {}, [], 0
        for piece in [*new, None]:
            if piece is not None:
                if self.model is not None and (m := _PLAIN.fullmatch(piece)) and (word := m[1].decode("utf-8", "replace").lower()) and _LATIN.fullmatch(word):
                    learned[piece] = len(self.model.tokenize(word.encode().decode("latin-1").translate(_BYTE_CHARS))) + (m[2] != b"" and self.mark_length(m[2]))
                    continue
                call.append(piece)
                size += len(piece)
            if call and (piece is None or size >= BATCH_BYTES):
                learned.update(zip(call, self.encode([x.decode("utf-8", "replace") for x in call])))
                call, size = [], 0
        return learned

    def mark_length(self, marks: bytes) -> int:
        if marks not in self.cache:
            self.cache[marks] = self.encode([marks.decode()])[0]
        return self.cache[marks]

    def count(self, texts: list[bytes]) -> list[int]:
        out, start, cache = [], 0, self.cache
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= 8 * BATCH_BYTES):
                size += len(texts[end])
                end += 1
            cut = [self.pieces(t) for t in texts[start:end]]
            new = {x for words in cut for x in words if x not in cache}
            cache.update(self._learn(list(new)))
            out.extend(sum(map(cache.__getitem__, words)) for words in cut)
            for long in [x for x in new if len(x) > LONGEST_CACHED]:
                del cache[long]
            if len(cache) > CACHE:
                cache.clear()
            start = end
        return out


_COUNTERS: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text column under the tokenizer file at path (it must exist on every executor)."""

    @F.arrow_udf("bigint")
    def lengths(column: pa.Array) -> pa.Array:
        return pa.array(_counter(path).count([x or b"" for x in column.cast(pa.binary()).to_pylist()]), pa.int64())

    return lengths(text)


def op2_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), token_count(F.col("text"), path or public_tokenizers.path("word_bpe_49k.json")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op2_token_counts": op2_token_counts}
SQL: dict[str, str] = {}
