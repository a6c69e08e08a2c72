"""Record validation (required fields, ranges, enumerations) and B9 PII redaction.

``validate`` returns ``(ok, rejected)``; rejected rows carry ``reasons``, an
array of every rule they break. One boolean expression per rule; no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MEMORY_TYPES, TASK_STATUSES


def _required(*cols: str) -> list[tuple[Column, str]]:
    return [(F.col(c).isNull(), f"{c} is required") for c in cols]


def _unit(c: str, nullable: bool = False) -> list[tuple[Column, str]]:
    bad = (F.col(c) < 0) | (F.col(c) > 1)
    if not nullable:
        bad = F.col(c).isNull() | bad
    return [(F.coalesce(bad, F.lit(False)), f"{c} out of range")]


def _enum(c: str, values) -> list[tuple[Column, str]]:
    return [(F.coalesce(~F.col(c).isin(*values), F.lit(True)), f"{c} not one of {','.join(values)}")]


RULES = {
    "stimulus": lambda: _required("content"),
    "thought": lambda: _required("id", "content", "ts") + _unit("importance") + _unit("uncertainty"),
    "memory": lambda: _required("id", "content", "created_at", "last_access") + _enum("type", MEMORY_TYPES)
    + _unit("importance"),
    "task": lambda: _required("id", "title", "goal", "context", "created_ts", "last_update_ts")
    + _unit("importance") + _unit("uncertainty") + _enum("status", TASK_STATUSES),
    "interrupt": lambda: _required("id", "question", "rationale", "created_ts"),
}


def validate(df: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    rules = RULES[entity]()
    reasons = F.filter(F.array(*[F.when(bad, F.lit(msg)) for bad, msg in rules]), lambda x: x.isNotNull())
    checked = df.withColumn("reasons", reasons)
    return (checked.where(F.size("reasons") == 0).drop("reasons"),
            checked.where(F.size("reasons") > 0))


# ---------------------------------------------------------------------------
# B9
# ---------------------------------------------------------------------------
# FIXED VALUES: redaction patterns and their replacements (applied in this order)
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}"
EMAIL_MASK = "[EMAIL]"
PHONE_MASK = "[PHONE]"


def redact_pii(df: DataFrame, col: str = "content", out_col: str | None = None) -> DataFrame:
    """Mask e-mail addresses, then phone numbers (no digit before or after: a card number
    is none), before a text is stored or embedded."""
    c = F.regexp_replace(F.col(col), EMAIL_PATTERN, EMAIL_MASK)
    c = F.regexp_replace(c, "(?<![0-9])" + PHONE_PATTERN + "(?![0-9])", PHONE_MASK)
    return df.withColumn(out_col or col, c)
