"""Registered queries of the training-data operators, with SQL where SQL can state them.

Each query reads its whole table through the operator with production parameters and derives the
result's digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 24


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes; equal texts stay together."""
    from .sharding import document_rows, shard
    rows = shard(document_rows(read_table(spark, sf_dir, "documents", "doc_id", "text")), n_shards=SHARDS)
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
                       "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document under the byte-level BPE of 50k."""
    from .token_counts import count_tokens
    out = count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


OP4_SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS is_chosen, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), same AS (
  SELECT pair_id, pos, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS common FROM t GROUP BY ALL
), cut AS (
  SELECT pair_id, coalesce(min(CASE WHEN NOT common THEN pos END), max(pos) + 1) AS n FROM same GROUP BY ALL
), f AS (
  SELECT t.*, n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS framed,
         length('<|im_start|>' || role || chr(10)) AS head
  FROM t JOIN cut USING (pair_id)
), o AS (
  SELECT *, coalesce(sum(length(framed)) FILTER (pos >= n) OVER (PARTITION BY pair_id, is_chosen ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM f
)
SELECT pair_id, CAST(any_value(n) AS INTEGER) AS n_prompt_turns,
       coalesce(string_agg(framed, '' ORDER BY pos) FILTER (pos < n AND (is_chosen OR FALSE)), '') AS prompt,
       coalesce(string_agg(framed, '' ORDER BY pos) FILTER (pos >= n AND is_chosen), '') AS chosen,
       coalesce(string_agg(framed, '' ORDER BY pos) FILTER (pos >= n AND NOT is_chosen), '') AS rejected,
       coalesce(string_agg((base + head) || '-' || (base + length(framed) - 1), ',' ORDER BY pos) FILTER (pos >= n AND is_chosen AND role = 'assistant'), '') AS chosen_loss,
       coalesce(string_agg((base + head) || '-' || (base + length(framed) - 1), ',' ORDER BY pos) FILTER (pos >= n AND NOT is_chosen AND role = 'assistant'), '') AS rejected_loss
FROM o GROUP BY pair_id
"""


@query("op4_preference_format", OP4_SQL)
def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as preference pairs; the table marks no preferences."""
    from .chat import format_preferences
    turns = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    pairs = format_preferences(turns.select(
        F.expr("conv_id div 2").alias("pair_id"), (F.col("conv_id") % 2 == 0).alias("chosen"), "turn", "role", "text"))

    def digest(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["from_char"].cast("string"), s["to_char"].cast("string"))), ",")

    return pairs.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected",
                        digest("chosen_spans").alias("chosen_loss"), digest("rejected_spans").alias("rejected_loss"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 3-word shingles, at most 3 differing bits."""
    from .simhash import near_duplicates
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9
), r AS (
  SELECT a AS node, b AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a
), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1), c AS (SELECT node AS vec_id, min(reach) AS low FROM r GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""


@query("op2_embedding_near_dedup", OP2_SQL)
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine >= 0.9 among all vectors and their components."""
    from .vectors import near_duplicates
    out = near_duplicates(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumnRenamed("vec_id", "id"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


QUALITY_FOLDS = 5
QUALITY_THRESHOLD = 0.3


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> bytes | None:
    """Model learned from the labelled rows outside the held-out fold."""
    from .quality import held_out, train
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality").where(~held_out("doc_id", QUALITY_FOLDS))
    return train(docs, labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label")))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a factorisation machine."""
    from .quality import held_out, score
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "n_chars").withColumnRenamed("doc_id", "id")
    out = score(docs, quality_model(spark, docs, sf_dir))
    return out.select(F.col("id").alias("doc_id"), held_out("id", QUALITY_FOLDS).alias("held_out"), "score",
                      (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


@query("op10_pieces")
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole document, and whether they decode to it."""
    from .pieces import encode_checked
    out = encode_checked(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
    return out.select(F.col("id").alias("doc_id"), F.size("piece_ids").alias("n_pieces"), "piece_ids", "decoded_sha256", "round_trip")


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a repeated 100-byte string covers."""
    from .suffix import deduplicate
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return deduplicate(docs, "doc_id", "text").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the item and the evidence."""
    from .decontaminate import find_leaks
    found = find_leaks(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.round("cosine", 4).alias("cosine"), "lcs",
                        F.round("lcs_share", 4).alias("lcs_share"), F.round("answer_share", 4).alias("answer_share"))


LM_FOLDS = 10


@query("op9_language_model")
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every whole document under a hierarchical Pitman-Yor model and under the base."""
    from .language_model import score
    from .quality import held_out
    docs = documents(spark, sf_dir)
    return score(docs.withColumn("held_out", held_out("id", LM_FOLDS))).withColumnRenamed("id", "doc_id")


OP11_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html FROM pages
), f AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS low,
         row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST) = 1 AS is_first
  FROM p
)
SELECT page_id, payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                              1 + (CAST(('0x' || substr(h, 5 * (i // 4) + 1, 5)) AS BIGINT) // CAST(pow(2, 15 - 5 * (i % 4)) AS BIGINT)) % 32, 1)
                       for i in range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN is_first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT is_first THEN low END AS refers_to
FROM f
"""


@query("op11_warc", OP11_SQL)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in archives with a dictionary, and what the archives hold when read back."""
    from ..session import scratch_path
    from .warc import read_archives, resolve_revisits, write_archives
    folder = scratch_path(spark, "warc")
    write_archives(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    records = written(read_archives(spark, folder, with_payload=False), "warc-read")
    return resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m
  FROM d LEFT JOIN marks USING (doc_id)
), g AS (
  SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), o AS (
  SELECT '' AS filter_order, 0 AS step, -1 AS k, 0 AS before
  UNION ALL
  SELECT filter_order || chr(CAST(65 + i AS INTEGER)), step + 1, CAST(i AS INTEGER), before + CASE WHEN k < 0 THEN 0 ELSE 1 << k END
  FROM o, range(5) r(i) WHERE step < 5 AND position(chr(CAST(65 + i AS INTEGER)) IN filter_order) = 0
), s AS (
  SELECT w.filter_order, o.step, o.k, o.before FROM o JOIN o w ON w.step = 5 AND starts_with(w.filter_order, o.filter_order) AND o.step > 0
), x AS (
  SELECT part, filter_order, step, k,
         sum(n) FILTER ((m & before) = 0 AND ((m >> k) & 1) = 0) AS kept, sum(n) FILTER ((m & before) = 0 AND ((m >> k) & 1) = 1) AS removed,
         sum(n) FILTER ((m & before) <> 0 AND ((m >> k) & 1) = 1) AS redundant, sum(n) FILTER (m = (1 << k)) AS unique_fails,
         sum(good) FILTER ((m & before) = 0 AND ((m >> k) & 1) = 1) AS good_lost, sum(toxic) FILTER ((m & before) = 0 AND ((m >> k) & 1) = 1) AS toxic_lost
  FROM g, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, k), 0) AS BIGINT) AS shapley
FROM x
"""


@query("op12_filter_audit", OP12_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all orders, per language."""
    from .filter_audit import audit
    return audit(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading 8 whitened components of all embeddings."""
    from .whitening import whiten
    vectors = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumnRenamed("vec_id", "id")
    return whiten(vectors).withColumnRenamed("id", "vec_id")
