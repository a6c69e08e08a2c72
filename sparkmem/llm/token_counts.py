"""Operator 3, token counts with overlap resynchronisation.

Texts up to a chunk are counted whole. A longer text is cut into overlapping chunks that are dealt out
to all tasks and encoded with offsets. Two neighbouring chunks are spliced where both begin a
pre-token at one position: the byte-level pre-tokenizer scans from left to right and looks ahead only,
so from a common start on both scans are the same, and what the left chunk saw up to there is what the
whole text gives, if the position keeps the length of a special token away from the left chunk's end.
Where a pair of chunks has no such position, the text is cut anew with chunks and overlaps twice as
wide, until every pair aligns (at last the whole text is one chunk).

Short texts in plain Latin characters are counted pre-token by pre-token: each distinct pre-token is
encoded by the library once and its count reused; all others go through the library whole.

Nulls and odd input: a null text counts as empty (0 bytes, 0 tokens); special strings inside a text are
handled as the library does by default; repeated rows give repeated results; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_conf, written

CHUNK_CHARS = 32768
OVERLAP_CHARS = 1024
KNOWN_WORDS = 400_000      # distinct pre-tokens a worker remembers before it starts anew

# the byte-level pre-tokenizer's public pattern, and the characters on which every Unicode version agrees
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = "[^\t\n\r -~¡-ſ]"

_LOADED: dict[str, tuple] = {}


def _library(path: str):
    """(tokenizer, special strings, pattern or None, finder of odd characters, known words) of a worker."""
    if path not in _LOADED:
        import json
        import re

        import regex
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        spec = json.loads(tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                 and pre.get("use_regex", True) and not pre.get("add_prefix_space", True))
        special = [t["content"] for t in spec.get("added_tokens", [])]
        _LOADED[path] = (tok, special, regex.compile(PATTERN) if plain else None, re.compile(PLAIN), {})
    return _LOADED[path]


def count_texts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, whole."""
    tok, special, pattern, odd, known = _library(path)
    out = [0] * len(texts)
    slow, parts = [], {}
    for i, t in enumerate(texts):
        if pattern is None or odd.search(t) or any(s in t for s in special):
            slow.append(i)
        else:
            parts[i] = pattern.findall(t)
    if len(known) > KNOWN_WORDS:
        known.clear()
    new = list(set().union(*parts.values()) - known.keys())
    for lo in range(0, len(new), 20_000):
        some = new[lo:lo + 20_000]
        known.update(zip(some, map(len, tok.encode_batch_fast(some, add_special_tokens=False))))
    get = known.__getitem__
    for i, p in parts.items():
        out[i] = sum(map(get, p))
    for i in slow:
        out[i] = len(tok.encode_batch_fast([texts[i]], add_special_tokens=False)[0])
    return out


def count_chunk(text: str, start: int, head: int, tail: int, path: str):
    """(tokens, positions and tokens before them in the first ``head`` characters, the same in the last ``tail``).

    Positions are characters of the whole text at which a pre-token begins.
    """
    tok, special = _library(path)[:2]
    e = tok.encode(text, add_special_tokens=False)
    if len(e) == 0:
        return 0, [], [], [], []
    word = np.array([-1 if w is None else w for w in e.word_ids])
    begin = np.array(e.offsets)[:, 0]
    at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    pos = begin[at]
    margin = max([1, *map(len, special)])
    h = pos < head
    t = (pos >= len(text) - tail) & (pos <= len(text) - margin)
    return len(e), pos[h] + start, at[h], pos[t] + start, at[t]


CHUNK_SCHEMA = "key binary, k int, last boolean, start long, head int, tail int, chunk string"
COUNT_SCHEMA = "key binary, k int, last boolean, n long, head_pos array<long>, head_n array<long>, tail_pos array<long>, tail_n array<long>"


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("k", pa.int32()), ("last", pa.bool_()), ("start", pa.int64()),
                            ("head", pa.int32()), ("tail", pa.int32()), ("chunk", pa.string())])
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                rows, at, k = [], 0, 0
                while True:
                    end = min(len(t), at + chunk + overlap)
                    last = end == len(t)
                    rows.append((i, k, last, at, overlap if k else 0, 0 if last else overlap, t[at:end]))
                    if len(rows) >= 64 or last:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                    if last:
                        break
                    at, k = at + chunk, k + 1
    return run


def _encode_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        names = ["key", "k", "last", "n", "head_pos", "head_n", "tail_pos", "tail_n"]
        for b in batches:
            for i in range(0, b.num_rows, 16):
                some = b.slice(i, 16)
                res = [count_chunk(t, s, h, tl, path) for t, s, h, tl in zip(
                    some.column(6).to_pylist(), some.column(3).to_pylist(), some.column(4).to_pylist(), some.column(5).to_pylist())]
                cols = list(zip(*res))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), some.column(2), pa.array(cols[0], pa.int64()),
                     *[pa.array([np.asarray(x, np.int64) for x in c], longs) for c in cols[1:]]], names)
    return run


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count_texts(b.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])
    return run


def _splice(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, n_tokens of aligned texts; keys of texts with a pair of chunks that doesn't align)."""
    right = chunks.select("key", (F.col("k") - 1).alias("k"), F.col("head_pos").alias("r_pos"), F.col("head_n").alias("r_n"))
    joined = chunks.join(right, ["key", "k"], "left").withColumn("common", F.array_intersect("tail_pos", "r_pos"))
    ok = F.col("last") | (F.size("common") > 0)
    p = F.element_at("common", 1)
    left_n = F.element_at("tail_n", F.array_position("tail_pos", p).cast("int"))
    right_n = F.element_at("r_n", F.array_position("r_pos", p).cast("int"))
    part = F.when(F.col("last"), F.col("n")).when(F.size("common") > 0, left_n - right_n)
    docs = joined.groupBy("key").agg(F.sum(part).alias("n_tokens"), F.min(F.coalesce(ok, F.lit(False))).alias("ok"))
    return docs.where("ok").select("key", "n_tokens"), docs.where("not ok").select("key")


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens) of rows (id, text). A long text that stands in several rows is encoded once."""
    spark = docs.sparkSession
    arrow_conf(spark)
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    long_text = F.col("n_bytes") > chunk
    counts = docs.where(~long_text).mapInArrow(_count_batches(path), "id long, n_bytes long, n_tokens long")
    rows = docs.where(long_text).select("id", "n_bytes", F.unhex(F.sha2("text", 256)).alias("key"), "text")
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))
    pending, found = texts, None
    while True:
        pieces = pending.mapInArrow(_cut(chunk, overlap), CHUNK_SCHEMA).repartition(
            int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
        encoded = written(pieces.mapInArrow(_encode_chunks(path), COUNT_SCHEMA), "token-chunks")
        done, left = _splice(encoded)
        found = done if found is None else found.unionByName(done)
        left = written(left, "token-left")
        if left.isEmpty():
            break
        pending = texts.join(left, "key", "left_semi").select("key", "text")
        chunk, overlap = chunk * 2, overlap * 2
    return counts.unionByName(rows.select("id", "n_bytes", "key").join(found, "key").select("id", "n_bytes", "n_tokens"))
