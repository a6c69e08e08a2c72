"""Consolidation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consolidate as C
from ..operators.providers import embed_table
from ..registry import query
from ..sources import fixtures as fx
from ..sql_text import T0, cosine_sql

AS_OF = T0 + 86400.0


def _episodic_docs(spark, sf):
    """Documents as episodic memories, one scope per language."""
    d = fx.table(spark, sf, "documents", "doc_id", "text", "lang")
    d = d.select(F.col("lang").alias("scope_id"), F.col("doc_id").alias("seq"),
                 F.concat(F.lit("doc:"), F.col("doc_id")).alias("id"), F.lit("episodic").alias("type"),
                 F.col("text").alias("content"), (F.lit(T0) + F.col("doc_id") * 60.0).alias("created_at"))
    return embed_table(d, "content")


_COPIES_SQL = f"""
WITH d AS (SELECT lang AS scope_id, doc_id AS seq, 'doc:' || doc_id AS id, text,
                  {T0}::DOUBLE + doc_id * 60.0::DOUBLE AS created_at FROM documents),
g AS (SELECT scope_id, count(*) AS n, string_agg(text, chr(10) ORDER BY created_at DESC, seq DESC) AS joined,
             arg_max(id, seq) AS first_member
      FROM d GROUP BY scope_id, text HAVING count(*) >= 2)
SELECT scope_id, CAST(n AS BIGINT) AS n_members,
       'Summary of ' || n || ' events:' || chr(10) || substr(joined, 1, 512) AS content,
       round(least(1.0::DOUBLE, 0.6::DOUBLE + 0.02::DOUBLE * n), 6) AS importance, first_member
FROM g
"""


@query("consolidate_copies", oracle=_COPIES_SQL)
def consolidate_copies(spark, sf):
    """All documents of all languages: no limit on a scope's memories."""
    out = C.consolidate(_episodic_docs(spark, sf), AS_OF, max_items=None, threshold=0.95)
    return out.select("scope_id", "n_members", "content", F.round("importance", 6).alias("importance"), "first_member")


@query("consolidate_newest", oracle=_COPIES_SQL[:_COPIES_SQL.index("\ng AS")] + """
r AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY created_at DESC, seq DESC) AS rn FROM d QUALIFY rn <= 50),
g AS (SELECT scope_id, count(*) AS n, string_agg(text, chr(10) ORDER BY rn) AS joined, string_agg(id, ',' ORDER BY rn) AS member_ids
      FROM r GROUP BY scope_id, text HAVING count(*) >= 2)
SELECT scope_id, CAST(n AS BIGINT) AS n_members,
       'Summary of ' || n || ' events:' || chr(10) || substr(joined, 1, 512) AS content,
       round(least(1.0::DOUBLE, 0.6::DOUBLE + 0.02::DOUBLE * n), 6) AS importance, member_ids
FROM g
""")
def consolidate_newest(spark, sf):
    """The reference's default: the newest 50 memories of each scope."""
    out = C.consolidate(_episodic_docs(spark, sf), AS_OF, threshold=0.95)
    return out.select("scope_id", "n_members", "content", F.round("importance", 6).alias("importance"), "member_ids")


@query("consolidate_members", oracle=_COPIES_SQL[:_COPIES_SQL.index("\ng AS")] + """
g AS (SELECT scope_id, text, arg_max(id, seq) AS first_member FROM d GROUP BY scope_id, text HAVING count(*) >= 2)
SELECT d.scope_id, 'semantic:' || substr(sha256(concat_ws(chr(1), d.scope_id, first_member)), 1, 16) AS semantic_id, d.id AS member
FROM d JOIN g USING (scope_id, text)
""")
def consolidate_members(spark, sf):
    """The members of every cluster of all documents, as rows."""
    _, members = C.consolidate_members(_episodic_docs(spark, sf), AS_OF, threshold=0.95)
    return members.select("scope_id", "semantic_id", "member")


@query("cluster_rollup", oracle=_COPIES_SQL)
def cluster_rollup(spark, sf):
    d = fx.table(spark, sf, "documents", "doc_id", "text", "lang")
    members = d.select(F.col("lang").alias("scope_id"), F.sha2("text", 256).alias("cluster"),
                       (-F.col("doc_id")).alias("member_pos"),
                       F.concat(F.lit("doc:"), F.col("doc_id")).alias("id"), F.col("text").alias("content"))
    out = C.cluster_rollup(members, AS_OF, include_members=False)  # clusters are not bounded here
    return out.select("scope_id", "n_members", "content", F.round("importance", 6).alias("importance"), "first_member")


@query("centroids", oracle="""
SELECT label, CAST(pos AS BIGINT) AS pos, round(avg(CAST(v AS DOUBLE)), 6) AS value FROM (
  SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings
  WHERE embedding IS NOT NULL)
GROUP BY label, pos
""")
def centroids(spark, sf):
    c = C.centroids(fx.table(spark, sf, "embeddings", "label", "embedding"), ["label"])
    return c.select("label", "pos", F.round("value", 6).alias("value"))


@query("near_dup_pairs", oracle=f"""
WITH r AS (SELECT embedding, min(vec_id) AS rep FROM embeddings WHERE embedding IS NOT NULL GROUP BY embedding)
SELECT CAST(a.rep AS VARCHAR) AS id_a, CAST(b.rep AS VARCHAR) AS id_b,
       round({cosine_sql('a.embedding', 'b.embedding')}, 6) AS sim
FROM r a JOIN r b ON a.rep < b.rep AND len(a.embedding) = len(b.embedding)
WHERE {cosine_sql('a.embedding', 'b.embedding')} >= 0.3
UNION ALL
SELECT CAST(r.rep AS VARCHAR), CAST(e.vec_id AS VARCHAR), round({cosine_sql('e.embedding', 'e.embedding')}, 6)
FROM embeddings e JOIN r ON r.embedding = e.embedding AND e.vec_id > r.rep
""")
def near_dup_pairs(spark, sf):
    p = C.near_duplicate_pairs(fx.vectors(spark, sf), 0.3)
    return p.select("id_a", "id_b", F.round("sim", 6).alias("sim"))
