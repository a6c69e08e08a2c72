"""Source/sink, validation and redaction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import log as L
from ..operators.pages import read_pages
from ..operators.validate import redact_pii, validate
from ..registry import query
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import io as IO
from ..sql_text import memories_cte, redact_sql


@query("validate_split", oracle="""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice / 500000.0 <= 1.0 AS ok,
       CASE WHEN o_totalprice / 500000.0 > 1.0 THEN 'uncertainty out of range' ELSE '' END AS reasons
FROM orders
""")
def validate_split(spark, sf):
    t = fx.tasks(spark, sf, clamp_uncertainty=False)
    ok, bad = validate(t, "task")
    return (ok.select("id", F.lit(True).alias("ok"), F.lit("").alias("reasons"))
            .unionByName(bad.select("id", F.lit(False).alias("ok"), F.array_join("reasons", "; ").alias("reasons"))))


@query("pii_redact", oracle=f"""
WITH r AS (SELECT doc_id, {redact_sql('text')} AS red FROM documents)
SELECT doc_id, CAST(length(red) AS BIGINT) AS chars, md5(red) AS red_md5 FROM r
""")
def pii_redact(spark, sf):
    d = redact_pii(fx.table(spark, sf, "documents", "doc_id", "text"), "text", "red")
    return d.select("doc_id", F.length("red").cast("long").alias("chars"), F.md5("red").alias("red_md5"))


def _docs(spark, sf):
    return fx.memories(spark, sf, null_embedding_every=0)


@query("memory_export", oracle=f"""
WITH {memories_cte()}
SELECT id, type, CAST(length(content) AS BIGINT) AS chars, CAST(256 AS BIGINT) AS dim FROM mem
""")
def memory_export(spark, sf):
    path = scratch_path(spark, "export")
    IO.export_jsonl(_docs(spark, sf), path)
    back = spark.read.json(path)
    return back.select("id", "type", F.length("content").cast("long").alias("chars"),
                       F.size("embedding").cast("long").alias("dim"))


@query("memory_import", oracle=f"""
WITH {memories_cte()}
SELECT id, type, CAST(length(content) AS BIGINT) AS chars, round(importance, 6) AS importance FROM mem
""")
def memory_import(spark, sf):
    path = scratch_path(spark, "export")
    IO.export_jsonl(_docs(spark, sf), path)
    log = IO.import_jsonl(spark, path)
    t = L.fold_log(log)
    return t.select("id", "type", F.length("content").cast("long").alias("chars"), F.round("importance", 6).alias("importance"))


@query("encrypted_roundtrip", oracle="SELECT 'doc:' || doc_id AS id, true AS same FROM documents")
def encrypted_roundtrip(spark, sf):
    path = scratch_path(spark, "encrypted")
    docs = _docs(spark, sf).select("id", "content", "metadata_json", "importance")
    IO.write_encrypted(docs, path, "a secret shorter than thirty-two")
    back = IO.read_encrypted(spark, path, "a secret shorter than thirty-two")
    orig = docs.select("id", F.md5("content").alias("m0"))
    return back.select("id", F.md5("content").alias("m1")).join(orig, "id").select(
        "id", (F.col("m0") == F.col("m1")).alias("same"))


@query("memory_import_over", oracle=f"""
WITH {memories_cte()}
SELECT id, md5(content) AS content_md5, seq_after FROM (
  SELECT id, content, true AS seq_after FROM mem)
""")
def memory_import_over(spark, sf):
    """An import onto a store that holds other versions of the same ids and has deleted some: the file wins."""
    path = scratch_path(spark, "export")
    IO.export_jsonl(_docs(spark, sf), path)
    old = _docs(spark, sf).select("id", "seq", "type", "importance", "created_at", "last_access", "metadata_json").withColumns(
        {"scope_id": F.lit("global"), "op": F.lit("upsert"), "content": F.lit("old"), "embedding": F.lit(None).cast("array<float>")})
    gone = old.where(F.col("seq") % 7 == 0).select("scope_id", "id", (F.col("seq") + F.lit(10**9)).alias("seq"), F.lit("delete").alias("op"))
    log = L.append(old, gone)
    base = IO.next_seq(log)
    t = L.fold_log(L.append(log, IO.import_jsonl(spark, path, base_seq=base)))
    return t.select("id", F.md5("content").alias("content_md5"), (F.col("seq") >= base).alias("seq_after"))


@query("page_scan", oracle="SELECT page_id, url, CAST(length(html) AS BIGINT) AS chars FROM pages")
def page_scan(spark, sf):
    return read_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("chars"))


@query("stimuli_load", oracle="""
SELECT source, md5(text) AS content_md5, CAST(count(*) AS BIGINT) AS n, true AS numbered FROM documents GROUP BY source, text
""")
def stimuli_load(spark, sf):
    """Two loads of one table of records join one store: no number and no id is given twice."""
    src = scratch_path(spark, "stimuli")
    fx.table(spark, sf, "documents", "source", F.col("text").alias("content")).write.json(src)
    one = IO.read_stimuli(spark, src, 5.0)
    two = IO.read_stimuli(spark, src, 5.0, base_seq=IO.next_seq(one))
    ids = one.unionByName(two).groupBy("id").agg(F.count(F.lit(1)).alias("same_id"), F.countDistinct("seq").alias("seqs"))
    both = one.join(ids, "id").groupBy("source", F.md5("content").alias("content_md5")).agg(
        F.count(F.lit(1)).alias("n"), (F.max("same_id") == 1).alias("numbered"))
    return both.select("source", "content_md5", "n", "numbered")
