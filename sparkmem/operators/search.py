"""Long-term memory search.

Scale notes.

* Keyword search for a batch of queries is an equi-join on words (see
  ``keyword_search_batch``); only matching pairs are produced, and
  ``row_number() <= k`` per query is planned as a partial WindowGroupLimit
  before the shuffle.
* Vector search runs on stored indexes (``vector_index``): bounds of blocks are
  compared first, and only blocks that can hold a hit are multiplied. A product
  keeps a local top-k per query, so at most ``k`` rows per query and block that
  was read reach the final ranking.
* Per-scope retrieval (each query sees only its scope's memories) is an
  equi-join on the scope; AQE's skew-join handling splits a hot scope, and
  ``salt`` spreads it explicitly when wanted.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import COSINE_EPS, TOPK_DEFAULT
from ..functions.text import count_occurrences, py_strip
from ..functions.vector import has_vector, l2norm
from ..session import materialize
from . import vector_index as V

FIRST_BYTES = 32 << 20     # of memories' matrices that each block of queries meets before bounds decide
LANES = 64                 # blocks of word-less queries, and lanes of texts they meet


def _check_k(k: int) -> int:
    if k < 0:
        raise ValueError("k must be >= 0")
    return int(k)


def _lc(df: DataFrame):
    return F.col("content_lc") if "content_lc" in df.columns else F.lower(F.col("content"))


def _rank(df: DataFrame, part: Sequence[str], order, k: int, rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order) if part else Window.orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w).cast("long")).where(F.col(rank_col) <= k)


# ---------------------------------------------------------------------------
# F1 keyword
# ---------------------------------------------------------------------------
def keyword_search(memories: DataFrame, query: str, k: int = TOPK_DEFAULT,
                   scope_cols: Sequence[str] = ()) -> DataFrame:
    """rows whose lower-cased content contains the lower-cased query,
    scored by the number of non-overlapping occurrences, best ``k`` (per scope).

    A blank query returns no rows; a non-blank query is used unstripped.
    """
    k = _check_k(k)
    lc = _lc(memories)
    if not query.strip() or k == 0:
        return memories.limit(0).withColumn("score", F.lit(0).cast("long")).withColumn("rank", F.lit(0).cast("long"))
    ql = F.lower(F.lit(query))
    hits = memories.where(lc.contains(ql)).withColumn("score", count_occurrences(lc, ql))
    order = [F.col("score").desc(), F.col("seq").asc(), F.col("id").asc()]
    if not scope_cols:
        top = hits.orderBy(*order).limit(k)  # TakeOrderedAndProject
        return _rank(top, [], order, k)
    return _rank(hits, scope_cols, order, k)


def keyword_search_batch(memories: DataFrame, queries: DataFrame, k: int = TOPK_DEFAULT,
                         qid_col: str = "qid", query_col: str = "query") -> DataFrame:
    """F1 for a table of queries: ``qid, id, seq, score, rank`` of the best ``k`` memories per query.

    A text that contains a query contains the query's inner words (those with white space on both sides
    within it) as whole words, so queries meet the texts by an equi-join of their longest inner word with the texts' distinct
    words, and ``contains`` decides on what meets. Queries without an inner word go, in blocks, over all texts.
    Both parts are plain joins without a driver step; adaptive execution broadcasts whichever side it measured as small.
    """
    k = _check_k(k)
    q = (queries.where(F.length(py_strip(query_col)) > 0)
         .select(F.col(qid_col).alias("qid"), F.lower(F.col(query_col)).alias("_ql")))
    words = F.split("_ql", r"\s+")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.length(w) > 0)
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    q = q.withColumn("_word", F.when(F.size(inner) > 0, longest))
    mem = memories.select("id", F.col("seq").cast("long").alias("seq"), _lc(memories).alias("_lc"))
    # by an inner word
    keyed = q.where(F.col("_word").isNotNull())
    seen = mem.select("id", "seq", F.explode(F.array_distinct(F.split("_lc", r"\s+"))).alias("_word"))
    cand = seen.join(keyed, "_word").select("qid", "_ql", "id", "seq")
    by_word = cand.join(mem, ["id", "seq"]).where(F.col("_lc").contains(F.col("_ql")))
    # without one: blocks of queries against lanes of texts
    short = q.where(F.col("_word").isNull())
    blocks = (short.groupBy(F.pmod(F.xxhash64("qid"), F.lit(LANES)).alias("_b"))
              .agg(F.collect_list(F.struct("qid", "_ql")).alias("_qs"))
              .select("_qs", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))).alias("_lane")))
    lanes = mem.withColumn("_lane", F.pmod(F.xxhash64("id", "seq"), F.lit(LANES)).cast("int"))
    met = lanes.join(blocks, "_lane").select(
        "id", "seq", "_lc", F.explode(F.filter("_qs", lambda x: F.col("_lc").contains(x["_ql"]))).alias("_q"))
    rest = met.select(F.col("_q.qid").alias("qid"), F.col("_q._ql").alias("_ql"), "id", "seq", "_lc")
    hits = by_word.select("qid", "_ql", "id", "seq", "_lc").unionByName(rest)
    scored = hits.select("qid", "id", "seq", count_occurrences(F.col("_lc"), F.col("_ql")).cast("long").alias("score"))
    return _rank(scored, ["qid"], [F.col("score").desc(), F.col("seq").asc(), F.col("id").asc()], k)


# ---------------------------------------------------------------------------
# F2 / C3 vector
# ---------------------------------------------------------------------------
def vector_hits(memories: DataFrame, queries: DataFrame, k: int = TOPK_DEFAULT,
                qid_col: str = "qid", qvec_col: str = "embedding", emb_col: str = "embedding",
                key_cols: Sequence[str] = ("id",), first_bytes: int = FIRST_BYTES) -> DataFrame:
    """C3 (shared store): top-``k`` (qid, key, seq, sim, rank) for every query vector
    against every memory of the same dimension (unusable vectors dropped), exact.

    Both sides are stored as vector indexes. Each block of queries first meets its nearest blocks of memories (``first_bytes`` of them), which gives
    every query a k-th cosine it has for certain; after that a block of memories is read only if the bounds of its angles
    allow a cosine that reaches the least of those. Ties go by seq and key.
    """
    k = _check_k(k)
    keys = list(key_cols)
    q = queries.select(F.col(qid_col).alias("qid"), F.col(qvec_col).alias("_qv"))
    mem = memories.select(*keys, F.col("seq").cast("long").alias("seq"), F.col(emb_col).alias("_emb"))
    names = [*keys, "seq"]
    hit_schema = T.StructType([T.StructField("qid", q.schema["qid"].dataType)]
                              + [T.StructField(c, memories.schema[c].dataType) for c in keys]
                              + [T.StructField("seq", T.LongType()), T.StructField("sim", T.DoubleType())])
    if k == 0:
        return memories.sparkSession.createDataFrame([], hit_schema).withColumn("rank", F.lit(0).cast("long"))
    stored = V.build_index(mem, "_emb", names, ["seq", *keys])
    asked = V.build_index(q, "_qv", ["qid"], pivots=stored.pivots)
    schema = T.StructType([*hit_schema.fields, T.StructField("block", T.LongType()), T.StructField("certain", T.DoubleType())])

    def rows(a: V.Block, b: V.Block, r, c, s, certain) -> pa.RecordBatch:
        found = b.keys.take(pa.array(c))
        return pa.RecordBatch.from_arrays(
            [a.keys.column(0).take(pa.array(r)), *[found.column(j) for j in range(len(names))], pa.array(s),
             pa.array(np.full(len(r), a.number)), pa.array(certain)], [*hit_schema.names, "block", "certain"])

    def first(a, blocks, _):
        best, found = V.Best(len(a.x), k), []
        for b in blocks:
            r, c, s = V.best_of(a, b, k, best.certain)
            best.add(r, s)
            found.append((b, r, c, s))
        for b, r, c, s in found:
            keep = s >= best.certain[r]
            r, c, s = r[keep], c[keep], s[keep]
            yield rows(a, b, r, c, s, best.certain[r])

    def rest(a, blocks, floor):
        best = V.Best(len(a.x), k)
        for b in blocks:
            r, c, s = V.best_of(a, b, k, np.maximum(floor, best.certain))
            best.add(r, s)
            yield rows(a, b, r, c, s, s)

    if stored.n_bytes <= first_bytes:                       # the first pass meets all there is
        hits = V.products(asked, stored, V.all_blocks(asked, stored), first, schema, by_left=True)
    else:
        near = materialize(V.nearest_blocks(asked, stored, max(1, first_bytes * stored.n_blocks // stored.n_bytes)), "nearest")
        hits = materialize(V.products(asked, stored, near, first, schema, by_left=True), "first-hits")
        floors = hits.groupBy("block").agg(F.min("certain").alias("floor"))
        more = V.near_blocks(asked, stored, floors=floors).join(near, ["a_block", "b_block"], "left_anti")
        hits = hits.unionByName(V.products(asked, stored, more, rest, schema))
    order = [F.col("sim").desc(), F.col("seq").asc()] + [F.col(c).asc() for c in keys]
    return _rank(hits.drop("block", "certain"), ["qid"], order, k)


def vector_search(memories: DataFrame, query_vec, k: int = TOPK_DEFAULT,
                  key_cols: Sequence[str] = ("id",), emb_col: str = "embedding") -> DataFrame:
    """one query vector -> best ``k`` memories with ``sim`` and ``rank``, payload joined."""
    spark = memories.sparkSession
    q = spark.createDataFrame([(0, [float(x) for x in query_vec])], "qid int, embedding array<double>")
    hits = vector_hits(memories, q, k, key_cols=key_cols, emb_col=emb_col).drop("qid")
    return memories.drop("seq").join(F.broadcast(hits), list(key_cols), "inner")


def knn_join_scoped(memories: DataFrame, queries: DataFrame, k: int,
                    scope_cols: Sequence[str] = ("scope_id",), qid_col: str = "qid",
                    qvec_col: str = "embedding", emb_col: str = "embedding",
                    key_cols: Sequence[str] = ("id",), salt: int = 1) -> DataFrame:
    """C3 per scope: each query against its own scope's memories only.

    Equi-join on the scope (plus an optional salt that splits a hot scope into
    ``salt`` tasks); cosine in Catalyst; top-k per query via WindowGroupLimit.
    """
    from ..functions.vector import dot
    k = _check_k(k)
    scope_cols = list(scope_cols)
    # a compacted snapshot stores ``norm``; otherwise compute it here
    mnorm = F.col("norm") if "norm" in memories.columns else l2norm(emb_col)
    mem = (memories.where(has_vector(emb_col))
           .select(*scope_cols, *key_cols, F.col("seq").cast("long").alias("seq"),
                   F.col(emb_col).alias("_emb"), mnorm.alias("_mn")))
    q = (queries.where(has_vector(qvec_col))
         .select(*scope_cols, F.col(qid_col).alias("qid"), F.col(qvec_col).alias("_qv"),
                 l2norm(qvec_col).alias("_qn")))
    on = scope_cols
    if salt > 1:
        mem = mem.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in key_cols]), F.lit(salt)))
        q = q.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on = scope_cols + ["_salt"]
    pairs = mem.join(q, on, "inner").where(F.size("_emb") == F.size("_qv"))
    pairs = pairs.withColumn("sim", dot("_qv", "_emb") / ((F.col("_qn") + COSINE_EPS) * (F.col("_mn") + COSINE_EPS)))
    order = [F.col("sim").desc(), F.col("seq").asc()] + [F.col(c).asc() for c in key_cols]
    if salt > 1:
        pairs = _rank(pairs, ["qid", "_salt"], order, k).drop("rank")
    out = _rank(pairs, ["qid"], order, k)
    return out.select(*scope_cols, "qid", *key_cols, "seq", "sim", "rank")


def scope_hits(memories: DataFrame, queries: DataFrame, k: int, scope_cols: Sequence[str] = ("scope_id",), qvec_col: str = "embedding",
               emb_col: str = "embedding", keep: Sequence[str] = ("id",)) -> DataFrame:
    """C3 for one query per scope: the ``k`` nearest of the scope's own memories, with the columns ``keep``, in one pass over the memories.

    The ranking is by scope, as the join is, and a partial limit keeps k rows of a scope per partition before anything is shuffled: texts
    travel with these rows and are not read a second time. A store that is bucketed by scope is read without an exchange.
    """
    from ..functions.vector import dot
    k, sc = _check_k(k), list(scope_cols)
    norm = F.col("norm") if "norm" in memories.columns else l2norm(emb_col)
    mem = (memories.where(has_vector(emb_col))
           .select(*sc, *keep, F.col("seq").cast("long").alias("seq"), F.col(emb_col).alias("_emb"), norm.alias("_mn")))
    q = (queries.where(has_vector(qvec_col)).select(*sc, F.col(qvec_col).alias("_qv"), l2norm(qvec_col).alias("_qn")))
    # written as a difference, so that the lengths are no key of the join and the scope's partitioning serves it
    pairs = mem.join(q, sc).where(F.size("_emb") - F.size("_qv") == 0)
    pairs = pairs.withColumn("sim", dot("_qv", "_emb") / ((F.col("_qn") + COSINE_EPS) * (F.col("_mn") + COSINE_EPS)))
    pairs = pairs.select(*sc, *keep, "seq", "sim")
    return _rank(pairs, sc, [F.col("sim").desc(), F.col("seq").asc(), *[F.col(c).asc() for c in keep if c == "id"]], k)


# ---------------------------------------------------------------------------
# G4, F3, B10
# ---------------------------------------------------------------------------
def hybrid_search(memories: DataFrame, queries: DataFrame, k: int = TOPK_DEFAULT,
                  qid_col: str = "qid", query_col: str = "query", embed=None) -> DataFrame:
    """Keyword list and vector list side by side (``channel``), no fusion.

    ``embed(df, text_col, out_col)`` embeds the query texts (default: the
    deterministic hash provider).
    """
    from .providers import embed_table
    embed = embed or (lambda df, c, o: embed_table(df, c, out_col=o))
    q = queries.select(F.col(qid_col).alias("qid"), F.col(query_col).alias("query")) \
        .where(F.length(py_strip("query")) > 0)
    kw = keyword_search_batch(memories, q, k)
    kw = kw.select("qid", F.lit("keyword").alias("channel"), "rank", "id", F.col("score").cast("double").alias("score"))
    qv = embed(q, "query", "embedding")
    vs = vector_hits(memories, qv, k)
    vs = vs.select("qid", F.lit("vector").alias("channel"), "rank", "id", F.col("sim").alias("score"))
    return kw.unionByName(vs)


def list_recent(memories: DataFrame, k: int = TOPK_DEFAULT, scope_cols: Sequence[str] = ()) -> DataFrame:
    """newest ``k`` by ``created_at`` (per scope when given)."""
    k = _check_k(k)
    order = [F.col("created_at").desc(), F.col("seq").desc(), F.col("id").asc()]
    if not scope_cols:
        return _rank(memories.orderBy(*order).limit(k), [], order, k)
    return _rank(memories, scope_cols, order, k)


def filter_memories(memories: DataFrame, type: str | None = None,
                    has_embedding: bool | None = None) -> DataFrame:
    """The two predicates the store pushes down (parquet filters)."""
    df = memories
    if type is not None:
        df = df.where(F.col("type") == type)
    if has_embedding is True:
        df = df.where(F.col("embedding").isNotNull())
    elif has_embedding is False:
        df = df.where(F.col("embedding").isNull())
    return df
