"""Long-term memory queries: log fold, lookups, deletes, searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import log as L
from ..operators import search as S
from ..operators import text_index as X
from ..operators.providers import embed_table
from ..registry import query
from ..sources import fixtures as fx
from ..sql_text import (N_CONV_SQL, T0, cosine_sql, hash_vec_ctes, memories_cte, memory_log_cte,
                        py_strip)


def _mem(spark, sf, embed=True):
    return fx.memories(spark, sf, with_embedding=embed, null_embedding_every=0)


def _benchmark_queries(spark, sf):
    return fx.table(spark, sf, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("qid"), F.col("text").alias("query"))


# --------------------------------------------------------------------------
# log fold and lookups
# --------------------------------------------------------------------------
_LIVE_LOG_SQL = f"""
WITH {memory_log_cte()},
last_del AS (SELECT id, max(seq) AS d FROM mlog WHERE op = 'delete' GROUP BY id),
live AS (SELECT m.* FROM mlog m LEFT JOIN last_del x USING (id)
         WHERE m.op = 'upsert' AND (x.d IS NULL OR m.seq > x.d))
"""


@query("memory_upsert", oracle=_LIVE_LOG_SQL + """
SELECT id, max(seq) AS seq, arg_max(content, seq) AS content,
       round(arg_max(importance, seq), 6) AS importance, round(arg_min(created_at, seq), 6) AS created_at
FROM live GROUP BY id
""")
def memory_upsert(spark, sf):
    t = L.fold_log(fx.memory_log(spark, sf))
    return t.select("id", "seq", "content", F.round("importance", 6).alias("importance"),
                    F.round("created_at", 6).alias("created_at"))


@query("memory_delete_all", oracle=f"""
WITH {memories_cte()},
req AS (SELECT CAST(conv_id AS VARCHAR) AS scope_id, turn AS seq FROM conversations WHERE role = 'system'),
cnt AS (SELECT scope_id, count(*) AS n FROM mem GROUP BY scope_id)
SELECT r.scope_id, r.seq, true AS accepted, CAST(coalesce(c.n, 0) AS BIGINT) AS deleted
FROM req r LEFT JOIN cnt c USING (scope_id)
""")
def memory_delete_all(spark, sf):
    conv = fx.table(spark, sf, "conversations", "conv_id", "turn", "role")
    req = conv.where(F.col("role") == "system").select(
        F.col("conv_id").cast("string").alias("scope_id"), F.col("turn").alias("seq"), F.lit("YES").alias("confirm"))
    _, res = L.delete_all(_mem(spark, sf, embed=False), req)
    return res.select("scope_id", "seq", "accepted", "deleted")


@query("memory_delete_all_fold", oracle=f"""
WITH ev AS (
  SELECT CAST(user_id AS VARCHAR) AS scope_id, event_id AS seq, 'e:' || event_type AS id,
         CASE WHEN event_type = 'signup' THEN 'delete_all'
              WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op,
         props AS content, epoch(ts) AS created_at
  FROM events),
dall AS (SELECT scope_id, max(seq) AS b FROM ev WHERE op = 'delete_all' GROUP BY scope_id),
del AS (SELECT scope_id, id, max(seq) AS b FROM ev WHERE op = 'delete' GROUP BY scope_id, id),
live AS (
  SELECT e.* FROM ev e LEFT JOIN dall a USING (scope_id) LEFT JOIN del d USING (scope_id, id)
  WHERE e.op = 'upsert' AND e.seq > coalesce(greatest(a.b, d.b), -1))
SELECT scope_id, id, max(seq) AS seq, arg_max(content, seq) AS content,
       round(arg_min(created_at, seq), 6) AS created_at
FROM live GROUP BY scope_id, id
""")
def memory_delete_all_fold(spark, sf):
    t = L.fold_log(fx.memory_log_per_user(spark, sf))
    return t.select("scope_id", "id", "seq", "content", F.round("created_at", 6).alias("created_at"))


@query("memory_get", oracle=f"""
WITH {memories_cte()}
SELECT id, type, round(importance, 6) AS importance
FROM mem WHERE id IN (SELECT 'doc:' || doc_id FROM labels)
""")
def memory_get(spark, sf):
    ids = fx.table(spark, sf, "labels", "doc_id").select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("id"))
    got = L.get_memories(_mem(spark, sf, embed=False), ids)
    return got.select("id", "type", F.round("importance", 6).alias("importance"))


@query("memory_delete", oracle=f"""
WITH {memories_cte()}
SELECT 'doc:' || l.doc_id AS id, l.doc_id AS seq,
       EXISTS (SELECT 1 FROM mem m WHERE m.id = 'doc:' || l.doc_id
               AND m.scope_id = CAST(l.doc_id % {N_CONV_SQL} AS VARCHAR)) AS deleted
FROM labels l WHERE l.toxic = 1
""")
def memory_delete(spark, sf):
    n_conv = fx.n_conversations(spark, sf)
    lab = fx.table(spark, sf, "labels", "doc_id", "toxic").where(F.col("toxic") == 1)
    req = lab.select((F.col("doc_id") % n_conv).cast("string").alias("scope_id"),
                     F.concat(F.lit("doc:"), F.col("doc_id")).alias("id"), F.col("doc_id").alias("seq"))
    _, res = L.delete_memories(_mem(spark, sf, embed=False), req)
    return res.select("id", "seq", "deleted")


@query("latest_by_key", oracle="""
SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type,
       arg_max(value, event_id) AS value
FROM events GROUP BY user_id
""")
def latest_by_key(spark, sf):
    e = fx.table(spark, sf, "events", "event_id", "user_id", "event_type", "value").withColumnRenamed("event_id", "seq")
    return L.latest_by_key(e, ["user_id"]).select("user_id", "seq", "event_type", "value")


@query("memory_filter", oracle=f"""
WITH {memories_cte()}
SELECT id, scope_id FROM mem WHERE type = 'episodic'
""")
def memory_filter(spark, sf):
    docs = _mem(spark, sf)
    logged = L.fold_log(fx.memory_log(spark, sf))
    both = docs.unionByName(logged, allowMissingColumns=True)
    return S.filter_memories(both, type="episodic", has_embedding=True).select("id", "scope_id")


# --------------------------------------------------------------------------
# search
# --------------------------------------------------------------------------
@query("keyword_topk", oracle="""
WITH m AS (SELECT doc_id AS seq, 'doc:' || doc_id AS id, lower(text) AS lc FROM documents),
s AS (SELECT id, seq, (length(lc) - length(replace(lc, 'the', ''))) // 3 AS score
      FROM m WHERE contains(lc, 'the'))
SELECT id, CAST(score AS BIGINT) AS score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, seq) AS rank FROM s) WHERE rank <= 5
""")
def keyword_topk(spark, sf):
    return S.keyword_search(_mem(spark, sf, embed=False), "the", k=5).select("id", "score", "rank")


_BATCH_SQL = f"""
WITH m AS (SELECT doc_id AS seq, 'doc:' || doc_id AS id, lower(text) AS lc FROM documents),
q AS (SELECT item_id AS qid, lower(text) AS ql FROM benchmark WHERE length({py_strip('text')}) > 0),
s AS (SELECT qid, id, seq, (length(lc) - length(replace(lc, ql, ''))) // length(ql) AS score
      FROM m JOIN q ON contains(m.lc, q.ql))
SELECT qid, CAST(rank AS BIGINT) AS rank, id, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM s) WHERE rank <= 5
"""


@query("keyword_topk_batch", oracle=_BATCH_SQL)
def keyword_topk_batch(spark, sf):
    hits = S.keyword_search_batch(_mem(spark, sf, embed=False), _benchmark_queries(spark, sf), k=5)
    return hits.select("qid", "rank", "id", "score")


@query("keyword_topk_indexed", oracle=_BATCH_SQL)
def keyword_topk_indexed(spark, sf):
    """The same over postings of trigrams: texts are read for candidates only."""
    index = X.build_text_index(_mem(spark, sf, embed=False))
    return X.indexed_search(index, _benchmark_queries(spark, sf), k=5).select("qid", "rank", "id", "score")


@query("keyword_fragments", oracle="""
WITH m AS (SELECT doc_id AS seq, 'doc:' || doc_id AS id, lower(text) AS lc FROM documents),
q AS (SELECT item_id * 2 AS qid, lower(substr(text, 3, 9)) AS ql FROM benchmark WHERE length(trim(substr(text, 3, 9))) = 9
      UNION ALL SELECT item_id * 2 + 1, lower(substr(text, 2, 2)) FROM benchmark WHERE length(trim(substr(text, 2, 2))) = 2),
s AS (SELECT qid, id, seq, (length(lc) - length(replace(lc, ql, ''))) // length(ql) AS score
      FROM m JOIN q ON contains(m.lc, q.ql))
SELECT qid, CAST(rank AS BIGINT) AS rank, id, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM s) WHERE rank <= 5
""")
def keyword_fragments(spark, sf):
    """Fragments that begin and end within words, and queries of two characters, over the postings of trigrams."""
    b = fx.table(spark, sf, "benchmark", "item_id", "text")
    cut = [b.select((F.col("item_id") * 2 + odd).alias("qid"), F.substring("text", at, n).alias("query")).where(F.length(F.trim("query")) == n)
           for odd, at, n in ((0, 3, 9), (1, 2, 2))]
    index = X.build_text_index(_mem(spark, sf, embed=False))
    return X.indexed_search(index, cut[0].unionByName(cut[1]), k=5).select("qid", "rank", "id", "score")


_VEC_SQL = f"""
WITH bq AS (SELECT item_id, text FROM benchmark WHERE length({py_strip('text')}) > 0),
{hash_vec_ctes('qv', 'bq', 'item_id', 'text')},
dm AS (SELECT doc_id, text FROM documents),
{hash_vec_ctes('mv', 'dm', 'doc_id', 'text')},
p AS (SELECT qv.item_id AS qid, 'doc:' || mv.doc_id AS id, mv.doc_id AS seq,
             {cosine_sql('qv.embedding', 'mv.embedding')} AS sim FROM qv, mv),
vtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, seq) AS rank FROM p)
         WHERE rank <= 5)
"""


@query("vector_topk", oracle=_VEC_SQL + """
SELECT qid, CAST(rank AS BIGINT) AS rank, id, round(sim, 6) AS sim FROM vtop
""")
def vector_topk(spark, sf):
    q = embed_table(_benchmark_queries(spark, sf), "query")
    hits = S.vector_hits(_mem(spark, sf), q, k=5)
    return hits.select("qid", "rank", "id", F.round("sim", 6).alias("sim"))


@query("knn_join", oracle=f"""
WITH p AS (SELECT a.vec_id AS qid, CAST(b.vec_id AS VARCHAR) AS id, b.vec_id AS seq,
                  {cosine_sql('a.embedding', 'b.embedding')} AS sim
           FROM embeddings a JOIN embeddings b ON len(a.embedding) = len(b.embedding))
SELECT qid, CAST(rank AS BIGINT) AS rank, id, round(sim, 6) AS sim FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, seq) AS rank FROM p) WHERE rank <= 5
""")
def knn_join(spark, sf):
    v = fx.vectors(spark, sf)
    q = v.select(F.col("seq").alias("qid"), "embedding")
    hits = S.vector_hits(v, q, k=5)
    return hits.select("qid", "rank", "id", F.round("sim", 6).alias("sim"))


@query("hybrid_search", oracle=_VEC_SQL + f""",
m AS (SELECT doc_id AS seq, 'doc:' || doc_id AS id, lower(text) AS lc FROM documents),
q AS (SELECT item_id AS qid, lower(text) AS ql FROM benchmark WHERE length({py_strip('text')}) > 0),
s AS (SELECT qid, id, seq, (length(lc) - length(replace(lc, ql, ''))) // length(ql) AS score
      FROM m JOIN q ON contains(m.lc, q.ql)),
ktop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS rank FROM s)
         WHERE rank <= 5)
SELECT qid, 'keyword' AS channel, CAST(rank AS BIGINT) AS rank, id, CAST(score AS DOUBLE) AS score FROM ktop
UNION ALL
SELECT qid, 'vector' AS channel, CAST(rank AS BIGINT) AS rank, id, round(sim, 6) AS score FROM vtop
""")
def hybrid_search(spark, sf):
    out = S.hybrid_search(_mem(spark, sf), _benchmark_queries(spark, sf), k=5)
    return out.select("qid", "channel", "rank", "id",
                      F.when(F.col("channel") == "vector", F.round("score", 6)).otherwise(F.col("score")).alias("score"))


@query("list_recent", oracle=f"""
WITH {memories_cte()}
SELECT scope_id, CAST(rank AS BIGINT) AS rank, id, round(created_at, 6) AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC, seq DESC, id) AS rank FROM mem)
WHERE rank <= 5
""")
def list_recent(spark, sf):
    r = S.list_recent(_mem(spark, sf, embed=False), k=5, scope_cols=["scope_id"])
    return r.select("scope_id", "rank", "id", F.round("created_at", 6).alias("created_at"))


@query("memory_compact_scan", oracle=_LIVE_LOG_SQL + """
SELECT id, 'episodic' AS type, round(arg_max(importance, seq), 6) AS importance FROM live GROUP BY id
""")
def memory_compact_scan(spark, sf):
    from ..session import scratch_path
    path = scratch_path(spark, "snapshot")
    L.compact(fx.memory_log(spark, sf), path)
    t = L.scan_memories(spark, path, ["id", "type", "importance"]).where(F.col("type") == "episodic")
    return t.select("id", "type", F.round("importance", 6).alias("importance"))
