import json
import os

from pyspark.sql import functions as F

from sparkmem.operators import pages as P
from sparkmem.session import scratch_path
from sparkmem.sources import io as IO


def _local(path):
    """The local-filesystem form of a scratch URI (``file:/...`` -> ``/...``)."""
    return path[len("file:"):] if path.startswith("file:") else path


def test_read_stimuli_defaults_source(spark):
    path = scratch_path(spark, "stim")
    os.makedirs(_local(path))
    with open(os.path.join(_local(path), "a.json"), "w") as f:
        f.write(json.dumps({"source": "cli", "content": "hello"}) + "\n")
        f.write(json.dumps({"content": "no source"}) + "\n")
    rows = IO.read_stimuli(spark, path, as_of=5.0).orderBy("content").collect()
    assert [(r.source, r.content, r.ts) for r in rows] == [("cli", "hello", 5.0), ("api", "no source", 5.0)]
    assert rows[0].metadata_json == '{"source":"cli"}' and rows[0].id.startswith("stim:")


def test_read_pages_from_files_and_text(spark):
    path = scratch_path(spark, "pages")
    os.makedirs(_local(path))
    with open(os.path.join(_local(path), "p1.html"), "w") as f:
        f.write("<html><body><p>One</p><a href='file:///x/p2.html'>next</a></body></html>")
    pages = P.read_pages(spark, path, fmt="html")
    r = pages.first()
    assert r.url.startswith("file:") and r.url.endswith("p1.html")
    ex = P.extract_pages(pages).first()
    assert ex.text == "One\nnext" and ex.links == ["file:///x/p2.html"]
    gated = P.gate_pages(pages, "url", [], spark.createDataFrame([], "host string, rule_order int, allow boolean, "
                                                                     "path_prefix string"))
    assert gated.select("allowed").first().allowed is True  # file:// always passes


def test_export_import_roundtrip(spark):
    mem = spark.createDataFrame([
        ("a", "episodic", "x", [0.5, 0.25], 0.4, 1.0, 2.0, '{"k": 1}'),
        ("b", "semantic", "y", None, None, None, None, None)],
        "id string, type string, content string, embedding array<float>, importance double, "
        "created_at double, last_access double, metadata_json string")
    path = scratch_path(spark, "exp")
    assert IO.export_jsonl(mem, path) == 2
    lines = [json.loads(x) for f in os.listdir(_local(path)) if f.endswith(".json")
             for x in open(os.path.join(_local(path), f)) if x.strip()]
    b = [x for x in lines if x["id"] == "b"][0]
    assert b["embedding"] is None and b["importance"] == 0.0 and b["metadata"] == {}
    back = {r.id: r for r in IO.import_jsonl(spark, path).collect()}
    assert back["a"].embedding == [0.5, 0.25] and json.loads(back["a"].metadata_json) == {"k": 1}


def test_encryption_roundtrip_and_ciphertext(spark):
    df = spark.createDataFrame([("a", "secret text", '{"s":1}')], "id string, content string, metadata_json string")
    path = scratch_path(spark, "enc")
    IO.write_encrypted(df, path, "k" * 40)
    raw = spark.read.parquet(path).first()
    assert isinstance(raw.content, (bytes, bytearray)) and b"secret" not in bytes(raw.content)
    back = IO.read_encrypted(spark, path, "k" * 40).first()
    assert back.content == "secret text" and back.metadata_json == '{"s":1}'
    assert len(IO.derive_key("short")) == 32 and IO.derive_key("x" * 40) == b"x" * 32


def test_key_is_in_no_plan(spark):
    df = spark.createDataFrame([("a", "t", "{}")], "id string, content string, metadata_json string")
    key = IO.derive_key("a secret of any length")
    for d in (IO.encrypt_columns(df, key), IO.decrypt_columns(IO.encrypt_columns(df, key), key)):
        plan = d._jdf.queryExecution().toString()
        assert key.hex() not in plan.lower() and "a secret" not in plan


def test_two_loads_share_no_number_and_stream_works(spark):
    from sparkmem.streaming import jobs as J
    src = scratch_path(spark, "records")
    spark.createDataFrame([("cli", "same"), (None, "mail me at a.b@c.org")], "source string, content string").coalesce(1).write.json(src)
    one = IO.read_stimuli(spark, src, 1.0)
    two = IO.read_stimuli(spark, src, 1.0, base_seq=IO.next_seq(one))
    rows = one.unionByName(two).collect()
    assert sorted(r.seq for r in rows) == [0, 1, 2, 3] and len({r.id for r in rows}) == 4
    sink, ckpt = scratch_path(spark, "sink"), scratch_path(spark, "ckpt")
    J.ingest_stream(IO.read_stimuli(spark, src, 1.0, streaming=True), sink, ckpt, 1.0)
    spark.createDataFrame([("cli", "same"), ("x", None)], "source string, content string").coalesce(1).write.mode("append").json(src)
    J.ingest_stream(IO.read_stimuli(spark, src, 1.0, streaming=True), sink, ckpt, 1.0)
    got = {r.seq: r.content for r in spark.read.parquet(f"{sink}/memories").collect()}
    assert got[0] == "same" and got[1] == "mail me at [EMAIL]" and sorted(got.values()) == ["mail me at [EMAIL]", "same", "same"]
    assert spark.read.parquet(f"{sink}/rejected").count() == 1


def test_import_wins_over_old_rows_and_deletes(spark):
    from sparkmem.operators import log as L
    path = scratch_path(spark, "imp")
    mem = spark.createDataFrame([("a", "episodic", "new", 0.4, 1.0, 2.0, "{}"), ("b", "episodic", "new", 0.4, 1.0, 2.0, "{}")],
                                "id string, type string, content string, importance double, created_at double, last_access double, metadata_json string")
    IO.export_jsonl(mem.withColumn("embedding", F.lit(None).cast("array<float>")), path)
    log = spark.createDataFrame([("global", 10, "upsert", "a", "old"), ("global", 12, "delete", "b", None)],
                                "scope_id string, seq long, op string, id string, content string")
    base = IO.next_seq(log)
    t = {r.id: r.content for r in L.fold_log(L.append(log, IO.import_jsonl(spark, path, base_seq=base))).collect()}
    assert base == 13 and t == {"a": "new", "b": "new"}


def test_stimuli_are_staged_by_the_parts_of_the_input(spark):
    """F8: the records are written by as many tasks as read the table, not by three; the numbers of splits are sent to the rows."""
    from sparkmem.queries import io_q
    sf, seen = scratch_path(spark, "sf"), []
    rows = [(i, "web" if i % 2 else None, f"text {i // 2}") for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(8).write.option("parquet.block.size", 1 << 20).parquet(
        f"{sf}/documents.parquet")
    old, keep = io_q.scratch_path, spark.conf.get("spark.sql.files.openCostInBytes")
    io_q.scratch_path = lambda *a: seen.append(old(*a)) or seen[-1]
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        out = io_q.stimuli_load(spark, sf)
        assert out.where("numbered").agg(F.sum("n")).first()[0] == 120
    finally:
        io_q.scratch_path = old
        spark.conf.set("spark.sql.files.openCostInBytes", keep)
    assert len(spark.read.text(seen[0]).inputFiles()) == 8
    plan = IO.read_stimuli(spark, seen[0], 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
