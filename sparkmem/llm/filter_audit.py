"""Operator 12, audit of how filters act on each other, by sorted posting lists.

For every part of the documents and every filter the ids of the failing documents are kept as sorted lists, cut into ranges of ids
(``postings``, one row per part and range). What a filter removes after a set of filters ran before it is its list minus the union of
their lists; unions and differences are galloping merges of the lists of one range, and only their sizes, summed over the
ranges, leave a task. All orders of five filters need just the 80 pairs (filter, set before it); the reports of the orders are sums of those.

A document's id here is a number given where it is scanned (doc_id may be null or repeated). A range holds at most RANGE documents of one
scan task, whatever the size of a part, so no part, however large, gathers in a task.

Filters (fixed rules; words are maximal runs of other bytes than space and 0x09-0x0D, case-sensitive):
A fewer than 100 words; B 100 * distinct words < 80 * words; C 100 * upper-case A-Z > 10 * code points; D holds one of ``#$%&*|``;
E equal to the text of a smaller doc_id, whatever its part.

Nulls and odd input: a null text is empty (and fails A); a null lang is the part ''; a null doc_id is smaller than none and has no smaller one
it could repeat, so it passes E and makes no other fail; rows of one doc_id and one text don't fail E by each other.
Labels: a document is good (toxic) if a label row of its doc_id says quality = 1 (toxic = 1); repeated label rows count once.
An empty table gives no row. Extra columns are ignored. Very long texts are read in slices; their distinct words are counted by classes of
the words' hashes, one class at a time, so that a set holds a bounded share of the text.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_conf, block_numbers, return_freed_memory, utf8, written

FILTERS = "ABCDE"
RANGE = 1 << 16            # documents of one range of ids
SALTS = 32                 # parts that the rows of one text are dealt to where they meet its least doc_id
SLICE = 4 << 20            # bytes of a text whose words are split at once
MARKS = b"#$%&*|"          # fixed value: a text that holds one of them fails D
_UPPER = bytes(range(65, 91))
_LATER = bytes(range(0x80, 0xC0))      # bytes of a code point after its first
_GAPS = b" \t\n\v\f\r"


# --------------------------------------------------------------------------
# Filters of one text
# --------------------------------------------------------------------------
def _slices(text: bytes) -> Iterator[bytes]:
    """The text cut at gaps into slices of about SLICE bytes (a longer word stays whole)."""
    at = 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        while end < len(text) and text[end] not in _GAPS:
            end += 1
        yield text[at:end]
        at = end


def word_counts(text: bytes) -> tuple[int, int]:
    """(words, distinct words) of a text."""
    if len(text) <= SLICE:
        w = text.split()
        return len(w), len(set(w))
    classes = math.ceil(len(text) / SLICE)
    n = distinct = 0
    for k in range(classes):
        seen: set[bytes] = set()
        for part in _slices(text):
            w = part.split()
            n += len(w) if k == 0 else 0
            seen.update(x for x in w if hash(x) % classes == k)
        distinct += len(seen)
    return n, distinct


def failing(text: bytes) -> int:
    """Bits of the filters A to D that a text fails (A is bit 0)."""
    n, distinct = word_counts(text)
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _LATER))
    return ((n < 100) | (100 * distinct < 80 * n) << 1 | (100 * upper > 10 * points) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3)


def _scan(range_rows: int):
    """(row, range, doc_id, part, fails, key): a task's rows are numbered on from its own first number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = next(block_numbers()) << 10       # 2^42 numbers a task, so that a range holds no rows of two tasks
        for b in batches:
            offsets, data = utf8(b.column(1))
            mask, keys = [], []
            for lo, hi in zip(offsets[:-1], offsets[1:]):
                text = data[lo:hi].tobytes()
                mask.append(failing(text))
                keys.append(hashlib.sha256(text).digest())
            row = np.arange(number, number + b.num_rows)
            number += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(row // range_rows), b.column(0), b.column(2), pa.array(mask, pa.int32()),
                                              pa.array(keys, pa.binary())], ["row", "range", "doc_id", "part", "fails", "key"])
        return_freed_memory()
    return run


# --------------------------------------------------------------------------
# Sorted lists
# --------------------------------------------------------------------------
def _gallop(a: np.ndarray, x: int) -> int:
    """Position of the first entry of sorted ``a`` that is at least ``x``: doubling steps, then a binary search between the last two."""
    step = 1
    while step < len(a) and a[step] < x:
        step *= 2
    lo = step // 2
    return lo + int(np.searchsorted(a[lo:step + 1], x))


def _held(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of sorted ``a`` are in sorted ``b``; only the stretch that both share is searched, the shorter list in the longer."""
    hit = np.zeros(len(a), bool)
    if not len(a) or not len(b) or a[-1] < b[0] or b[-1] < a[0]:
        return hit
    lo, first = _gallop(a, b[0]), _gallop(b, a[0])
    hi = lo + int(np.searchsorted(a[lo:], b[-1], side="right"))
    b = b[first:]
    if hi - lo <= len(b):
        at = np.searchsorted(b, a[lo:hi])
        at[at == len(b)] = 0
        hit[lo:hi] = b[at] == a[lo:hi]
    else:
        at = np.searchsorted(a[lo:hi], b)
        ok = at < hi - lo
        ok[ok] = a[lo:hi][at[ok]] == b[ok]
        hit[lo + at[ok]] = True
    return hit


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[~_held(a, b)]


def intersection_size(a: np.ndarray, b: np.ndarray) -> int:
    return int(np.count_nonzero(_held(a, b)))


def union(lists: list[np.ndarray]) -> np.ndarray:
    """k-way merge of sorted lists without repeats: stretches in which one list is alone are copied whole, the rest is merged."""
    lists = [x for x in lists if len(x)]
    out: list[np.ndarray] = []
    while len(lists) > 1:
        lists.sort(key=lambda x: int(x[0]))
        alone = _gallop(lists[0], int(lists[1][0]))
        out.append(lists[0][:alone])
        lists[0] = lists[0][alone:]
        # up to the first end of a list all of them overlap
        end = min(int(x[-1]) for x in lists if len(x))
        cut = [int(np.searchsorted(x, end, side="right")) for x in lists]
        heads = [x[:c] for x, c in zip(lists, cut) if c]
        if heads:
            merged = np.sort(np.concatenate(heads), kind="stable")      # runs in order: a merge of runs
            out.append(merged[np.concatenate([[True], merged[1:] != merged[:-1]])])
        lists = [x[c:] for x, c in zip(lists, cut) if c < len(x)]
    return np.concatenate(out + lists) if out or lists else np.zeros(0, np.int64)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (part, range): per filter and set of filters before it, sizes of their union and of the filter's list without it."""
    names = ["part", "filter", "before", "union_size", "removed", "good", "toxic"]
    for b in batches:
        for r in range(b.num_rows):
            part = b.column(0)[r].as_py()
            lists = [b.column(1 + k)[r].values.to_numpy(zero_copy_only=False) for k in range(len(FILTERS) + 2)]
            *fails, good, toxic = lists
            out = []
            for before in range(1 << len(FILTERS)):
                gone = union([x for k, x in enumerate(fails) if before >> k & 1])
                for k, own in enumerate(fails):
                    if not before >> k & 1:
                        new = difference(own, gone)
                        out.append((part, k, before, len(gone), len(new), intersection_size(new, good), intersection_size(new, toxic)))
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


# --------------------------------------------------------------------------
# Plan
# --------------------------------------------------------------------------
def failing_documents(docs: DataFrame, labels: DataFrame, range_rows: int = RANGE) -> DataFrame:
    """(row, range, part, fails, good, toxic) of all documents; ``fails`` has a bit per filter, E included."""
    arrow_conf(docs.sparkSession)
    scanned = written(docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"))
                      .mapInArrow(_scan(range_rows), "row long, range long, doc_id long, part string, fails int, key binary"), "audit-rows")
    # a text that a third of all rows hold is dealt to SALTS keys
    repeated = (scanned.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
                .select("key", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    salted = scanned.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    return (salted.join(repeated, ["key", "salt"], "left").join(marks, "doc_id", "left")
            .select("row", "range", "part", F.expr("fails + if(doc_id > least, 16, 0)").alias("fails"),
                    (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic")))


def postings(docs: DataFrame) -> DataFrame:
    """One row per part and range of ids: sorted lists of the ids that fail each filter, of the good and of the toxic ones, and the documents in all."""
    def ids(condition):
        return F.sort_array(F.collect_list(F.when(condition, F.col("row"))))

    lost = docs.withColumn("lost", F.col("fails") != 0)
    return lost.groupBy("part", "range").agg(
        *[ids(F.expr(f"(fails & {1 << k}) <> 0")).alias(f) for k, f in enumerate(FILTERS)],
        ids(F.expr("good AND lost")).alias("good"), ids(F.expr("toxic AND lost")).alias("toxic"), F.count("*").alias("documents"))


def order_steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, filter, set before it) of every step of every order."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            out.append(("".join(FILTERS[j] for j in order), step, k, before))
            before |= 1 << k
    return out


def audit(docs: DataFrame, labels: DataFrame, range_rows: int = RANGE) -> DataFrame:
    """What each filter removes at each step of each order, per part of (doc_id, text, lang)."""
    spark = docs.sparkSession
    lists = written(postings(failing_documents(docs, labels, range_rows)), "audit-postings")
    totals = lists.groupBy("part").agg(F.sum("documents").alias("documents"))
    sizes = (lists.select("part", *FILTERS, "good", "toxic")
             .mapInArrow(_sizes, "part string, filter int, before int, union_size long, removed long, good long, toxic long")
             .groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in ("union_size", "removed", "good", "toxic")]))
    # of the 5! orders, |S|! (4 - |S|)! have exactly the set S before a filter
    last = len(FILTERS) - 1
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(last - k)) for k in range(len(FILTERS))]),
                          F.bit_count("before") + 1)
    of_filter = sizes.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.bit_count("before") == last, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weight).alias("shapley"))
    steps = spark.createDataFrame(order_steps(), "filter_order string, step int, filter int, before int")     # 600 fixed rows
    return (sizes.join(of_filter, ["part", "filter"]).join(totals, "part").join(F.broadcast(steps), ["filter", "before"])
            .select("part", "filter_order", "step", (F.col("documents") - F.col("union_size") - F.col("removed")).alias("kept"), "removed",
                    (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"),
                    F.col("toxic").alias("toxic_lost"), "shapley"))
