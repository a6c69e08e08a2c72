"""How the driver's tables become the library's entities (FIXTURES.md §2).

Each function reads only the columns it needs (column pruning reaches the
parquet scan) and returns a lazily-planned DataFrame. ``T0`` is 2024-01-01 UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import add_hash_embedding
from ..constants import VECTOR_DIM

T0 = 1704067200.0
TASK_AS_OF = 883612800.0  # 1998-01-01 00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str, *columns) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def epoch_seconds(df: DataFrame, c: str) -> F.Column:
    """TIMESTAMP or TIMESTAMP_NTZ column -> DOUBLE Unix seconds (microseconds kept).

    A TIMESTAMP_NTZ wall-clock value is read as UTC whatever the session time zone.
    """
    from pyspark.sql.types import TimestampNTZType
    col = F.col(c)
    if isinstance(df.schema[c].dataType, TimestampNTZType):
        col = F.to_utc_timestamp(col.cast("timestamp"), F.current_timezone())
    return F.unix_micros(col).cast("double") / 1e6


# --------------------------------------------------------------------------
# conversations -> thoughts / stimuli
# --------------------------------------------------------------------------
TAG_PREFIXES = ("#plan ", "#question ", "#insight ", "")


def thoughts(spark: SparkSession, sf_dir: str, tagged: bool = False) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    content = F.col("text")
    if tagged:
        idx = ((F.col("conv_id") + F.col("turn")) % 4).cast("int")
        prefix = F.element_at(F.array(*[F.lit(p) for p in TAG_PREFIXES]), idx + 1)
        content = F.concat(prefix, F.col("text"))
    return c.select(
        F.col("conv_id").cast("string").alias("scope_id"),
        F.col("turn").alias("seq"),
        F.concat(F.lit("t:"), F.col("conv_id"), F.lit(":"), F.col("turn")).alias("id"),
        content.alias("content"),
        F.array(F.col("role")).alias("tags"),
        (F.lit(0.5) + F.lit(0.1) * (F.col("turn") % 5)).alias("importance"),
        F.lit(0.5).alias("uncertainty"),
        (F.lit(T0) + F.col("turn") * 60.0).alias("ts"),
    )


def stimuli_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return c.where(F.col("role") == "user").select(
        F.col("conv_id").cast("string").alias("scope_id"),
        F.col("turn").alias("seq"),
        F.concat(F.lit("s:"), F.col("conv_id"), F.lit(":"), F.col("turn")).alias("id"),
        F.lit("chat").alias("source"),
        F.col("text").alias("content"),
        (F.lit(T0) + F.col("turn") * 60.0).alias("ts"),
    )


def stimuli_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    return e.select(
        F.col("user_id").cast("string").alias("scope_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("e:"), F.col("event_id")).alias("id"),
        F.col("event_type").alias("source"),
        F.col("props").alias("content"),
        epoch_seconds(e, "ts").alias("ts"),
    )


def n_conversations(spark: SparkSession, sf_dir: str) -> int:
    """max(conv_id) + 1 (a one-value aggregate; parquet statistics answer it)."""
    v = table(spark, sf_dir, "conversations", "conv_id").agg(F.max("conv_id")).first()[0]
    return int(v) + 1 if v is not None else 1


# --------------------------------------------------------------------------
# documents (+ labels) -> memories
# --------------------------------------------------------------------------
MEMORY_TYPES_BY_MOD = ("episodic", "semantic", "procedural")


def memories(spark: SparkSession, sf_dir: str, with_embedding: bool = True,
             null_embedding_every: int = 7, dim: int = VECTOR_DIM) -> DataFrame:
    n_conv = n_conversations(spark, sf_dir)
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    lab = table(spark, sf_dir, "labels", "doc_id", "quality")
    df = d.join(lab, "doc_id", "left")
    mtype = F.element_at(F.array(*[F.lit(t) for t in MEMORY_TYPES_BY_MOD]),
                         (F.col("doc_id") % 3).cast("int") + 1)
    created = F.lit(T0) + F.col("doc_id") * 60.0
    cols = [
        (F.col("doc_id") % n_conv).cast("string").alias("scope_id"),
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("id"),
        mtype.alias("type"),
        F.col("text").alias("content"),
    ]
    if with_embedding:
        df = add_hash_embedding(df, "text", "_emb", dim)
        emb = F.col("_emb")
        if null_embedding_every:
            emb = F.when(F.col("doc_id") % null_embedding_every != 0, emb)
        cols.append(emb.alias("embedding"))
    cols += [
        F.coalesce(F.lit(0.3) + F.lit(0.4) * F.col("quality"), F.lit(0.5)).alias("importance"),
        created.alias("created_at"),
        created.alias("last_access"),
        F.to_json(F.struct(F.col("source"), F.col("lang"))).alias("metadata_json"),
    ]
    return df.select(*cols)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(
        F.lit("vectors").alias("scope_id"),
        F.col("vec_id").alias("seq"),
        F.col("vec_id").cast("string").alias("id"),
        F.col("embedding"),
        F.col("label"),
    )


# --------------------------------------------------------------------------
# events -> upsert log, interrupts
# --------------------------------------------------------------------------
def memory_log(spark: SparkSession, sf_dir: str, scope: str = "global") -> DataFrame:
    """Upsert/delete log keyed by user: ``id = "u:" + user_id``."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    is_delete = (F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)
    created = epoch_seconds(e, "ts")
    return e.select(
        F.lit(scope).alias("scope_id"),
        F.col("event_id").alias("seq"),
        F.when(is_delete, F.lit("delete")).otherwise(F.lit("upsert")).alias("op"),
        F.concat(F.lit("u:"), F.col("user_id")).alias("id"),
        F.lit("episodic").alias("type"),
        F.col("props").alias("content"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.least(F.lit(1.0), F.col("value") / 500.0).alias("importance"),
        created.alias("created_at"),
        created.alias("last_access"),
        F.to_json(F.struct(F.col("event_type").alias("source"))).alias("metadata_json"),
    )


def memory_log_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user scopes, one memory per event type; a ``signup`` wipes the scope."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    op = (F.when(F.col("event_type") == "signup", F.lit("delete_all"))
          .when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), F.lit("delete"))
          .otherwise(F.lit("upsert")))
    created = epoch_seconds(e, "ts")
    return e.select(
        F.col("user_id").cast("string").alias("scope_id"),
        F.col("event_id").alias("seq"),
        op.alias("op"),
        F.concat(F.lit("e:"), F.col("event_type")).alias("id"),
        F.lit("episodic").alias("type"),
        F.col("props").alias("content"),
        F.lit(None).cast("array<float>").alias("embedding"),
        F.least(F.lit(1.0), F.col("value") / 500.0).alias("importance"),
        created.alias("created_at"),
        created.alias("last_access"),
        F.to_json(F.struct(F.col("event_type").alias("source"))).alias("metadata_json"),
    )


def interrupt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signup`` events open question ``"q:" + event_id``."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "props")
    return e.where(F.col("event_type") == "signup").select(
        F.lit("global").alias("scope_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("q:"), F.col("event_id")).alias("id"),
        F.concat(F.lit("What does "), F.col("props"), F.lit(" mean?")).alias("question"),
        F.lit("Missing external info").alias("rationale"),
        F.array().cast("array<string>").alias("required_fields"),
        epoch_seconds(e, "ts").alias("created_ts"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``purchase`` events answer ``"q:" + (event_id - event_id % 3)``."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "props")
    return e.where(F.col("event_type") == "purchase").select(
        F.lit("global").alias("scope_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("q:"), F.col("event_id") - F.col("event_id") % 3).alias("qid"),
        F.col("props").alias("answer_text"),
        epoch_seconds(e, "ts").alias("answer_ts"),
    )


# --------------------------------------------------------------------------
# orders -> tasks
# --------------------------------------------------------------------------
def tasks(spark: SparkSession, sf_dir: str, clamp_uncertainty: bool = True) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
              "o_totalprice", "o_orderdate", "o_orderpriority")
    od = epoch_seconds(o, "o_orderdate")
    prio = F.substring(F.col("o_orderpriority"), 1, 1).cast("int")
    importance = F.element_at(F.array(*[F.lit(v) for v in (1.0, 0.8, 0.6, 0.4, 0.2)]), prio)
    unc = F.col("o_totalprice") / 500000.0
    if clamp_uncertainty:
        unc = F.least(F.lit(1.0), unc)
    status = (F.when(F.col("o_orderstatus") == "F", "done")
              .when(F.col("o_orderstatus") == "O", "open")
              .when(F.col("o_orderstatus") == "P", "doing")
              .otherwise(F.col("o_orderstatus")))
    return o.select(
        F.col("o_custkey").cast("string").alias("scope_id"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("title"),
        F.col("o_orderpriority").alias("goal"),
        F.lit("").alias("context"),
        F.when(F.col("o_orderstatus") != "P", od + 7 * 86400.0).alias("deadline_ts"),
        importance.alias("importance"),
        unc.alias("uncertainty"),
        status.alias("status"),
        od.alias("created_ts"),
        od.alias("last_update_ts"),
        F.lit("{}").alias("metadata_json"),
        ((F.col("o_custkey") % 10) / 10.0).alias("goal_fit"),
    )


# --------------------------------------------------------------------------
# pages -> plans, robots rules
# --------------------------------------------------------------------------
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def page_host(c="url") -> F.Column:
    return F.regexp_extract(F.col(c) if isinstance(c, str) else c, HOST_RE, 1)


def registrable_domain(host) -> F.Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def plan_seeds_head(spark: SparkSession, sf_dir: str, global_cap: int) -> DataFrame:
    """Plans in long form (``plan_id, page_id, seed, pos``): one plan per registrable
    domain, seeds by ``page_id``, only positions below ``global_cap`` (the cap
    the crawl applies first). ``row_number() < cap`` is a partial
    WindowGroupLimit, so a hot domain never ships its whole seed list."""
    p = table(spark, sf_dir, "pages", "page_id", "url")
    dom = registrable_domain(page_host("url"))
    from pyspark.sql import Window
    w = Window.partitionBy("plan_id").orderBy("page_id")
    return (p.select(dom.alias("plan_id"), "page_id", F.col("url").alias("seed"))
            .withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
            .where(F.col("pos") < global_cap))


def plan_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seeds of the plans of ``plan_seeds_head``; the position is the ``page_id`` (same order, no window)."""
    p = table(spark, sf_dir, "pages", "page_id", "url")
    return p.select(registrable_domain(page_host("url")).alias("plan_id"), "page_id", F.col("url").alias("seed"),
                    F.col("page_id").alias("pos"))


def allow_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowlist: every host seen in ``pages`` (one row per host)."""
    p = table(spark, sf_dir, "pages", "url")
    return p.select(page_host("url").alias("host")).distinct()


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as eight sites whose pages link to each other (no link of the table itself leads to a page of it): page i is
    ``/en/p/i`` or ``/fr/p/i`` of site i % 8 and links to i + 8, i + 40, i // 16 * 8 + i % 8 (again and again) and to a page of another site; its own HTML
    follows."""
    p = table(spark, sf_dir, "pages", "page_id", "html")
    site = F.expr("page_id % 8")
    host = (F.when(site == 0, F.lit("m.s0.example.com")).when(site == 1, F.lit("blog.s1.example.com")).when(site == 2, F.lit("s2.example.org"))
            .otherwise(F.concat(F.lit("s"), site.cast("string"), F.lit(".example.com"))))

    def path(i: str) -> F.Column:
        return F.concat(F.when(F.expr(f"({i}) % 16 < 8"), F.lit("/en/p/")).otherwise(F.lit("/fr/p/")), F.expr(f"cast({i} as string)"))

    links = [path("page_id + 8"), path("page_id + 40"), path("page_id div 16 * 8 + page_id % 8"), F.concat(F.lit("http://s5.example.com"), path("page_id + 5"))]
    body = F.concat(*[F.concat(F.lit('<a href="'), x, F.lit('">n</a>')) for x in links], F.coalesce("html", F.lit("")))
    return p.select("page_id", F.concat(F.lit("http://"), host, path("page_id")).alias("url"), body.alias("html"))


def robots_rules(spark: SparkSession, sf_dir: str, hosts: DataFrame | None = None) -> DataFrame:
    """Robots rules derived from the host names seen in ``pages`` (or from ``hosts``).

    * ``m.*`` hosts: (1, deny ``/en/``), (2, allow ``/``)
    * ``blog.*`` hosts: (1, deny ``/fr/``)
    * ``*.org`` hosts: no robots file could be read -> absent -> denied
    * every other host: an empty robots file -> known, no rules -> allowed
    Returned columns: host, rule_order (null for an empty file), allow, path_prefix.
    """
    hosts = (allow_hosts(spark, sf_dir) if hosts is None else hosts).where(~F.col("host").endswith(".org"))
    m_rules = F.array(
        F.struct(F.lit(1).alias("rule_order"), F.lit(False).alias("allow"), F.lit("/en/").alias("path_prefix")),
        F.struct(F.lit(2).alias("rule_order"), F.lit(True).alias("allow"), F.lit("/").alias("path_prefix")))
    blog_rules = F.array(
        F.struct(F.lit(1).alias("rule_order"), F.lit(False).alias("allow"), F.lit("/fr/").alias("path_prefix")))
    empty = F.array(F.struct(F.lit(None).cast("int").alias("rule_order"), F.lit(None).cast("boolean").alias("allow"),
                             F.lit(None).cast("string").alias("path_prefix")))
    rules = (F.when(F.col("host").startswith("m."), m_rules)
             .when(F.col("host").startswith("blog."), blog_rules)
             .otherwise(empty))
    return hosts.select("host", F.inline(rules))
