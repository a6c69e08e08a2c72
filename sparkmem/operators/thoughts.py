"""Thought tagging, store routing and question extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MEMORY_TYPES, QUESTION_RATIONALE, THOUGHT_TAGS
from ..functions.text import py_strip


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def classify_thoughts(df: DataFrame, content_col: str = "content") -> DataFrame:
    """B2: tag = first of #plan/#question/#insight the text starts with (default
    #insight); ``tags=[tag]``, importance .6 (.5 for insight), uncertainty .4 for plan."""
    c = F.col(content_col)
    tag = F.lit("#insight")
    for t in reversed(THOUGHT_TAGS):
        tag = F.when(c.startswith(t), F.lit(t)).otherwise(tag)
    return (df.withColumn("tag", F.substring(tag, 2, 100))
            .withColumn("tags", F.array(F.col("tag")))
            .withColumn("importance", F.when(F.col("tag") != "insight", 0.6).otherwise(0.5))
            .withColumn("uncertainty", F.when(F.col("tag") == "plan", 0.4).otherwise(0.5)))


def _truthy(v: Column, path: str) -> Column:
    """Python truthiness of a JSON member; missing or null -> False."""
    var = F.variant_get(v, path, "variant")
    t = F.schema_of_variant(var)
    s = F.try_variant_get(v, path, "string")
    numeric = t.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)")
    return (F.when(var.isNull() | (t == "VOID"), F.lit(False))
            .when(t == "BOOLEAN", s == "true")
            .when(numeric, F.coalesce(s.cast("double") != 0, F.lit(True)))
            .when(t == "STRING", F.length(s) > 0)
            .when(t.startswith("ARRAY"), s != "[]")
            .when(t.startswith("OBJECT"), t != "OBJECT<>")
            .otherwise(F.lit(True)))


def route_store_decisions(df: DataFrame, raw_col: str = "decision_raw",
                          content_col: str = "content") -> DataFrame:
    """Parse the decision reply and decide what is stored.

    Adds ``store`` (bool), ``mem_type``, ``mem_importance``, ``metadata_json``
    (``{"tags": ...}``) and ``route_error`` (why a "store" decision could not
    become a valid memory: non-object reply, bad importance or type).
    Unparsable JSON means "do not store".
    """
    df = df.withColumn("_v", F.try_parse_json(F.col(raw_col)))
    v = F.col("_v")
    top = F.schema_of_variant(v)
    parsed = v.isNotNull()
    is_obj = top.startswith("OBJECT")
    imp_var = F.variant_get(v, "$.importance", "variant")
    typ_var = F.variant_get(v, "$.type", "variant")
    tags_var = F.variant_get(v, "$.tags", "variant")
    df = df.select(
        "*",
        F.when(parsed & is_obj, _truthy(v, "$.should_store")).otherwise(F.lit(False)).alias("_should"),
        (parsed & ~is_obj).alias("_not_obj"),
        F.when(imp_var.isNull(), F.lit(0.5)).otherwise(F.try_variant_get(v, "$.importance", "double"))
        .alias("mem_importance"),
        F.when(typ_var.isNull(), F.lit("episodic")).otherwise(F.try_variant_get(v, "$.type", "string"))
        .alias("mem_type"),
        F.concat(F.lit('{"tags":'), F.when(tags_var.isNull(), F.lit("[]")).otherwise(F.to_json(tags_var)),
                 F.lit("}")).alias("metadata_json"))
    should, imp, typ = F.col("_should"), F.col("mem_importance"), F.col("mem_type")
    err = (F.when(F.col("_not_obj"), F.lit("reply is not an object"))
           .when(should & imp.isNull(), F.lit("importance is not a number"))
           .when(should & ((imp < 0) | (imp > 1)), F.lit("importance out of range"))
           .when(should & ~typ.isin(*MEMORY_TYPES), F.lit("unknown memory type")))
    df = df.withColumn("route_error", err)
    return (df.withColumn("store", should & F.col("route_error").isNull())
            .drop("_v", "_should", "_not_obj"))


def question_column(df: DataFrame, content_col: str = "content", out_col: str = "question") -> DataFrame:
    """B4 as a column: the question a thought asks, null for any other thought."""
    c = F.col(content_col)
    df = df.withColumn("_q", F.when(c.startswith("#question"), py_strip(F.substring(c, len("#question") + 1, 1 << 30))))
    return df.withColumn(out_col, F.when(F.length("_q") > 0, F.col("_q"))).drop("_q")


def extract_questions(df: DataFrame, content_col: str = "content") -> DataFrame:
    """Rows starting with ``#question`` whose stripped remainder is non-empty
    -> ``question`` and ``rationale`` columns."""
    c = F.col(content_col)
    q = py_strip(F.substring(c, len("#question") + 1, 1 << 30))
    return (df.where(c.startswith("#question"))
            .withColumn("question", q)
            .where(F.length("question") > 0)
            .withColumn("rationale", F.lit(QUESTION_RATIONALE))
            .withColumn("required_fields", F.array().cast("array<string>")))
