"""Sources and sinks.

* ``read_stimuli``: ``{source, content}`` records (JSON lines or parquet),
  batch or streaming; ``source`` defaults to ``"api"``.
* ``export_jsonl`` / ``import_jsonl``: one JSON object per memory with all
  eight fields; nulls kept for ``embedding``, numbers default to 0.0;
  ``metadata`` written as a JSON object. Import validates and turns each line
  into an upsert in line order; a malformed line fails the job.
* ``write_encrypted`` / ``read_encrypted``: AES-GCM on ``content`` and
  ``metadata_json`` columns (numbers and embeddings stay clear).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.validate import validate

STIMULUS_IN_SCHEMA = T.StructType([T.StructField("source", T.StringType()),
                                   T.StructField("content", T.StringType())])
MEMORY_JSON_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("importance", T.DoubleType()), T.StructField("created_at", T.DoubleType()),
    T.StructField("last_access", T.DoubleType()), T.StructField("metadata", T.VariantType()),
])


def number_by_file(df: DataFrame, base_seq: int = 0, seq_col: str = "seq") -> DataFrame:
    """Number rows from ``base_seq`` in the order of (file, position in the file).

    ``df`` comes straight from a file reader and holds ``_metadata``'s path and block start as ``_file`` and ``_block``.
    Within a split rows keep their order; the splits (a small table) are ordered by file and offset and
    their counts summed, so no global sort of the rows is needed.
    """
    df = df.withColumn("_mid", F.monotonically_increasing_id())
    splits = df.groupBy("_file", "_block").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    w = Window.orderBy("_file", "_block")
    offset = F.sum("_rows").over(w) - F.col("_rows") + F.lit(int(base_seq))
    splits = splits.select("_file", "_block", "_first", offset.alias("_offset"))
    return (df.join(F.broadcast(splits), ["_file", "_block"])
            .withColumn(seq_col, (F.col("_offset") + F.col("_mid") - F.col("_first")).cast("long"))
            .drop("_file", "_block", "_mid", "_first", "_offset"))


def stamp_stimuli(df: DataFrame, base_seq: int = 0) -> DataFrame:
    """Give rows of a stimuli reader their ``seq`` (from ``base_seq`` on) and ``id``; a replay of one batch gives the same."""
    out = number_by_file(df, base_seq)
    key = F.sha2(F.concat_ws("\u0001", F.col("scope_id"), F.col("seq").cast("string"), F.col("source"), F.col("content")), 256)
    return out.select("scope_id", "seq", F.concat(F.lit("stim:"), F.substring(key, 1, 16)).alias("id"),
                      "source", "content", F.to_json(F.struct(F.col("source"))).alias("metadata_json"), "ts")


def read_stimuli(spark: SparkSession, path: str, as_of: float, fmt: str = "json", streaming: bool = False,
                 scope: str = "global", base_seq: int = 0, max_files_per_trigger: int | None = None) -> DataFrame:
    """A1: stimuli with ``scope_id, seq, id, source, content, metadata_json, ts``.

    ``base_seq`` is the first free ``seq`` of the store that the rows join, so that two loads never share one. A
    streaming read has no ``seq`` and ``id`` yet (Spark can't number a stream): it carries ``_file`` and ``_block``, and
    ``stamp_stimuli`` numbers each micro-batch in ``foreachBatch``, as ``ingest_stream`` does.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    df = reader.schema(STIMULUS_IN_SCHEMA).format(fmt).load(path)
    out = df.select(F.lit(scope).alias("scope_id"), F.coalesce(F.col("source"), F.lit("api")).alias("source"), F.col("content"),
                    F.lit(float(as_of)).alias("ts"), F.col("_metadata.file_path").alias("_file"),
                    F.col("_metadata.file_block_start").alias("_block"))
    return out if streaming else stamp_stimuli(out, base_seq)


def export_jsonl(memories: DataFrame, path: str) -> int:
    """Write the memories as JSON lines; returns the number written."""
    obs = Observation("export")
    out = memories.select(
        "id", "type", "content", "embedding",
        F.coalesce(F.col("importance"), F.lit(0.0)).alias("importance"),
        F.coalesce(F.col("created_at"), F.lit(0.0)).alias("created_at"),
        F.coalesce(F.col("last_access"), F.lit(0.0)).alias("last_access"),
        F.parse_json(F.coalesce(F.col("metadata_json"), F.lit("{}"))).alias("metadata"))
    out = out.observe(obs, F.count(F.lit(1)).alias("n"))
    out.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    return int(obs.get["n"])


def import_jsonl(spark: SparkSession, path: str, scope: str = "global", base_seq: int = 0) -> DataFrame:
    """JSON lines -> validated upsert log rows (order of files, then of lines = ``seq``).

    ``base_seq``: the first free ``seq`` of the log they are appended to (its maximum plus one), so
    that an import wins over every older row and every older delete. A line
    that is not valid JSON fails the read (FAILFAST); a record that fails
    validation raises as well, as the reference aborts the import.
    """
    df = spark.read.schema(MEMORY_JSON_SCHEMA).option("mode", "FAILFAST").json(path)
    rows = df.select(F.lit(scope).alias("scope_id"), F.lit("upsert").alias("op"),
                     "id", "type", "content", "embedding",
                     F.coalesce(F.col("importance"), F.lit(0.5)).alias("importance"),
                     "created_at", "last_access", F.to_json(F.col("metadata")).alias("metadata_json"),
                     F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    ok, bad = validate(rows, "memory")
    first_bad = bad.select("id", "reasons").first()
    if first_bad is not None:
        raise ValueError(f"invalid memory record {first_bad['id']!r}: {list(first_bad['reasons'])}")
    return number_by_file(ok, base_seq)


def next_seq(log: DataFrame, seq_col: str = "seq") -> int:
    """First free ``seq`` of a log: its maximum plus one, 0 for an empty log (one aggregate)."""
    top = log.agg(F.max(seq_col)).first()[0]
    return 0 if top is None else int(top) + 1


def derive_key(secret: str | bytes) -> bytes:
    """First 32 bytes of the secret, or SHA-256 of a shorter one."""
    raw = secret.encode("utf-8") if isinstance(secret, str) else secret
    return raw[:32] if len(raw) >= 32 else hashlib.sha256(raw).digest()


ENCRYPTED = ("content", "metadata_json")


def _key_row(spark: SparkSession, key: bytes) -> DataFrame:
    """The key as a one-row table: its value is in no expression, so no plan, log or event shows it."""
    return spark.createDataFrame(spark.sparkContext.parallelize([(key,)], 1), "_key binary")


def encrypt_columns(df: DataFrame, key: bytes, cols=ENCRYPTED) -> DataFrame:
    cols = list(cols)
    d = df.join(F.broadcast(_key_row(df.sparkSession, key)))    # one row
    return d.select(*[F.aes_encrypt(F.col(c), F.col("_key"), F.lit("GCM")).alias(c) if c in cols else F.col(c) for c in df.columns])


def decrypt_columns(df: DataFrame, key: bytes, cols=ENCRYPTED) -> DataFrame:
    cols = list(cols)
    d = df.join(F.broadcast(_key_row(df.sparkSession, key)))
    return d.select(*[F.aes_decrypt(F.col(c), F.col("_key"), F.lit("GCM")).cast("string").alias(c) if c in cols else F.col(c)
                      for c in df.columns])


def write_encrypted(df: DataFrame, path: str, secret: str | bytes) -> None:
    """A9 sink: parquet with encrypted text columns."""
    encrypt_columns(df, derive_key(secret)).write.mode("errorifexists").parquet(path)


def read_encrypted(spark: SparkSession, path: str, secret: str | bytes) -> DataFrame:
    """A9 scan: decrypts on read."""
    return decrypt_columns(spark.read.parquet(path), derive_key(secret))
