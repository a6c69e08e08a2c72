"""Postings of trigrams, kept with a snapshot of the memories, for keyword searches that read few texts (F1).

A text that contains a query contains all of the query's trigrams. ``build_text_index`` numbers the lower-cased texts and writes them in chunks,
and next to them, per trigram (three code points in 63 bits, exact) and range of texts, the sorted numbers of the texts that hold it, ranges of
one trigram in several files if need be. ``indexed_search`` takes a query's rarest trigrams, meets their postings, and joins the texts
that hold all of them by (chunk, number): chunks without a candidate are pruned, and ``contains`` decides on what is left. Queries need no words and no
white space for that; a query under three characters has no trigram and is counted in every text (exact, a scan): one pass over a text counts all the short queries of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import TOPK_DEFAULT
from ..functions.text import count_occurrences, py_strip
from ..session import materialize, scratch_path

RANGE = 1 << 16            # texts of one range
PROBES = 3                 # trigrams of a query whose postings are read
SLICE = 1 << 20            # characters of a text that are cut into trigrams at once
SHORT_BLOCK = 256          # distinct queries under three characters that go over the texts together


@dataclass
class TextIndex:
    texts: DataFrame       # chunk, doc, id, seq, lc
    postings: DataFrame    # gram, range, docs (sorted offsets within the range)
    grams: DataFrame       # gram, texts that hold it


def trigrams(text: str) -> np.ndarray:
    """Distinct trigrams of a text, sorted."""
    out = np.zeros(0, np.int64)
    for lo in range(0, max(len(text) - 2, 0), SLICE):
        a = np.frombuffer(text[lo:lo + SLICE + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        out = np.union1d(out, (a[:-2] << 42) | (a[1:-1] << 21) | a[2:])
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    chunk = TaskContext.get().partitionId()
    at = chunk << 32                            # the same again if the task runs again
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + b.num_rows)), *b.columns, pa.array(np.full(b.num_rows, chunk, np.int32))],
                                         ["doc", "id", "seq", "lc", "chunk"])
        at += b.num_rows


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, range, docs) of each batch."""
    for b in batches:
        docs, grams = [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            g = trigrams(text or "")
            grams.append(g)
            docs.append(np.full(len(g), doc, np.int64))
        if not grams or not sum(map(len, grams)):
            continue
        gram, doc = np.concatenate(grams), np.concatenate(docs)
        order = np.lexsort((doc, gram))
        gram, doc = gram[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (doc[1:] // RANGE != doc[:-1] // RANGE)]))
        offsets = pa.array(np.append(new, len(gram)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(gram[new]), pa.array(doc[new] // RANGE),
                                          pa.ListArray.from_arrays(offsets, pa.array((doc % RANGE).astype(np.int32)))], ["gram", "range", "docs"])


def build_text_index(memories: DataFrame, path: str | None = None) -> TextIndex:
    """Write the index of ``memories`` (id, seq, content) to ``path`` (a folder of its own under the shared one if not given)."""
    spark = memories.sparkSession
    path = path or scratch_path(spark, "text-index")
    lc = F.col("content_lc") if "content_lc" in memories.columns else F.lower("content")
    rows = memories.select("id", F.col("seq").cast("long").alias("seq"), lc.alias("lc"))
    id_type = rows.schema["id"].dataType.simpleString()
    (rows.mapInArrow(_number, f"doc long, id {id_type}, seq long, lc string, chunk int")
     .write.partitionBy("chunk").parquet(f"{path}/texts"))
    texts = spark.read.parquet(f"{path}/texts")
    posted = texts.select("doc", "lc").mapInArrow(_post, "gram long, range long, docs array<int>")
    posted.repartition("gram").sortWithinPartitions("gram", "range").write.parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("gram").agg(F.sum(F.size("docs").cast("long")).alias("texts")).write.parquet(f"{path}/grams")
    return open_text_index(spark, path)


def open_text_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("texts", "postings", "grams")))


def _query_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        grams = [trigrams(t) for t in b.column(1).to_pylist()]
        n = np.array([len(g) for g in grams], np.int64)
        at = np.repeat(np.arange(len(grams)), n)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.concatenate([np.zeros(0, np.int64), *grams])), pa.array(n[at])],
                                         ["n", "gram", "needs"])


def candidates(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(n, doc) of the texts that hold the PROBES rarest trigrams of each query (n, ql); a query with a trigram that no text holds has none."""
    grams = queries.select("n", "ql").mapInArrow(_query_grams, "n long, gram long, needs long")
    known = grams.join(index.grams, "gram")
    w = Window.partitionBy("n").orderBy("texts", "gram")
    rare = (known.withColumn("r", F.row_number().over(w)).withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("n")))
            .where((F.col("held") == F.col("needs")) & (F.col("r") <= PROBES)).select("n", "gram", F.least("needs", F.lit(PROBES)).alias("probes")))
    hits = index.postings.join(rare, "gram").select("n", "probes", (F.col("range") * RANGE).alias("base"), F.explode("docs").alias("at"))
    return (hits.groupBy("n", (F.col("base") + F.col("at")).alias("doc")).agg(F.count(F.lit(1)).alias("found"), F.first("probes").alias("probes"))
            .where("found = probes").select("n", "doc"))


def _codes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the texts one after another, number of the text of each)."""
    a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return a, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _occurrences(texts: list, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """(text, query) per non-overlapping occurrence of a query in a text; queries are the sorted code points ``one`` and, after them, pairs ``two``."""
    a, text = _codes(texts)
    found = []
    for asked, code, ok, base in ((one, a, np.ones(len(a), bool), 0), (two, (a[:-1] << 21) | a[1:], text[:-1] == text[1:], len(one))):
        if not len(asked) or not len(code):
            continue
        at = np.minimum(np.searchsorted(asked, code), len(asked) - 1)
        p = np.flatnonzero((asked[at] == code) & ok)
        if asked is two:
            # in a run of one character every other pair counts
            run = a[p] == a[p + 1]
            twin = p[run]
            new = np.ones(len(twin), bool)
            new[1:] = np.diff(twin) != 1
            since = np.arange(len(twin)) - np.maximum.accumulate(np.where(new, np.arange(len(twin)), 0))
            p = np.sort(np.concatenate([p[~run], twin[since % 2 == 0]]))
        found.append(np.stack([text[p], at[p] + base]))
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def _count_short(k: int):
    """(ql, id, seq, score) of the texts of a batch that hold a query of one or two characters; what can't be among a query's best ``k`` is left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {}
        for b in batches:
            numbers = b.column(3).to_numpy(zero_copy_only=False)
            for block in np.unique(numbers):
                rows = np.flatnonzero(numbers == block)
                if block not in blocks:
                    pairs = sorted(((ord(q), q) if len(q) == 1 else ((ord(q[0]) << 21) | ord(q[1]), q) for q in b.column(4)[int(rows[0])].as_py()),
                                   key=lambda x: (len(x[1]), x[0]))
                    blocks[block] = (np.array([c for c, q in pairs if len(q) == 1], np.int64), np.array([c for c, q in pairs if len(q) == 2], np.int64),
                                     pa.array([q for _, q in pairs], pa.string()))
                one, two, words = blocks[block]
                texts = [t or "" for t in b.column(2).take(pa.array(rows)).to_pylist()]
                lo, keys, counts = 0, [], []
                while lo < len(texts):
                    hi, size = lo, 0
                    while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= SLICE):
                        hi, size = hi + 1, size + len(texts[hi])
                    t, q = _occurrences(texts[lo:hi], one, two)
                    key, n = np.unique(q * len(texts) + t + lo, return_counts=True)
                    keys.append(key)
                    counts.append(n)
                    lo = hi
                key, score = np.concatenate(keys), np.concatenate(counts)
                q, t = key // len(texts), key % len(texts)
                order = np.lexsort((-score, q))
                q, t, score = q[order], t[order], score[order]
                last = np.searchsorted(q, q) + k - 1                    # the place of the query's k-th best here; equal scores stay
                kth = np.where((last < len(q)) & (q[np.minimum(last, len(q) - 1)] == q), score[np.minimum(last, len(q) - 1)], 0) if len(q) else score
                keep = score >= kth
                at = pa.array(rows[t[keep]])
                yield pa.RecordBatch.from_arrays([words.take(pa.array(q[keep])), b.column(0).take(at), b.column(1).take(at), pa.array(score[keep])],
                                                 ["ql", "id", "seq", "score"])
    return run


def indexed_search(index: TextIndex, queries: DataFrame, k: int = TOPK_DEFAULT, qid_col: str = "qid", query_col: str = "query") -> DataFrame:
    """F1 for a table of queries over an index: ``qid, id, seq, score, rank``, as ``search.keyword_search_batch``."""
    from .search import _check_k, _rank
    k = _check_k(k)
    q = (queries.where(F.length(py_strip(query_col)) > 0)
         .select(F.col(qid_col).alias("qid"), F.lower(F.col(query_col)).alias("ql")).withColumn("n", F.monotonically_increasing_id()))
    q = materialize(q, "queries")
    long = q.where(F.length("ql") >= 3)
    found = candidates(index, long).withColumn("chunk", F.shiftright("doc", 32).cast("int"))
    by_gram = (index.texts.join(found, ["chunk", "doc"]).join(long, "n").where(F.col("lc").contains(F.col("ql")))
               .select("qid", "ql", "id", "seq", "lc"))
    short = q.where(F.length("ql") < 3)
    scored = by_gram.select("qid", "id", "seq", count_occurrences(F.col("lc"), F.col("ql")).cast("long").alias("score"))
    order = [F.col("score").desc(), F.col("seq").asc(), F.col("id").asc()]
    distinct = short.select("ql").distinct()
    n = distinct.count()
    if n and k:
        blocks = (distinct.groupBy(F.pmod(F.xxhash64("ql"), F.lit(-(-n // SHORT_BLOCK))).cast("int").alias("block"))
                  .agg(F.collect_list("ql").alias("qls")))
        id_type = index.texts.schema["id"].dataType.simpleString()
        met = (index.texts.select("id", "seq", "lc").join(F.broadcast(blocks)).select("id", "seq", "lc", "block", "qls")
               .mapInArrow(_count_short(k), f"ql string, id {id_type}, seq long, score long"))
        best = _rank(met, ["ql"], order, k).drop("rank")
        scored = scored.unionByName(best.join(short, "ql").select("qid", "id", "seq", "score"))
    return _rank(scored, ["qid"], order, k)
