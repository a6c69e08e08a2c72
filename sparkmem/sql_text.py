"""SQL spellings (DuckDB dialect) of the Python string semantics, for oracles."""

from __future__ import annotations

from .functions.text import PY_WHITESPACE

T0 = 1704067200.0


def _chr_concat(chars: str) -> str:
    return "||".join(f"chr({ord(c)})" for c in chars)


PY_WS_CHARS_SQL = "(" + _chr_concat(PY_WHITESPACE) + ")"
# RE2 class of Python whitespace
PY_WS_RE2 = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
             r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def py_strip(expr: str) -> str:
    return f"trim({expr}, {PY_WS_CHARS_SQL})"


def thoughts_cte(tagged: bool = False) -> str:
    content = "text"
    if tagged:
        content = ("(['#plan ', '#question ', '#insight ', ''])[((conv_id + turn) % 4) + 1] || text")
    return f"""thoughts AS (
  SELECT CAST(conv_id AS VARCHAR) AS scope_id, turn AS seq,
         't:' || conv_id || ':' || turn AS id, {content} AS content, role,
         0.5::DOUBLE + 0.1::DOUBLE * (turn % 5) AS importance, 0.5::DOUBLE AS uncertainty,
         {T0}::DOUBLE + turn * 60.0::DOUBLE AS ts
  FROM conversations)"""


def wm_cte(budget: int = 4000, src: str = "thoughts") -> str:
    return f"""wm AS (
  SELECT * FROM (
    SELECT *, SUM(length(content)) OVER (PARTITION BY scope_id ORDER BY seq DESC
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_
    FROM {src}) WHERE run_ <= {budget})"""


def hash_vec_ctes(name: str, src: str, cols: str, text: str, dim: int = 256) -> str:
    """Two CTEs ending in ``name`` = ``cols`` + ``embedding`` (the deterministic vector of ``text``)."""
    reps, rem = divmod(dim, 32)
    extra = f" + list_sum(list_transform(v_[1:{rem}], lambda x: x * x))" if rem else ""
    return f"""{name}_d AS (
  SELECT {cols}, list_transform(range(32), lambda j: ((('0x' || substr(h_, 2 * j + 1, 2))::INTEGER - 128) / 128.0)) AS v_
  FROM (SELECT *, sha256({text}) AS h_ FROM {src} WHERE {text} IS NOT NULL)),
{name} AS (
  SELECT {cols}, list_transform(range({dim}), lambda i: CAST(v_[(i % 32) + 1] / n_ AS FLOAT)) AS embedding
  FROM (SELECT *, sqrt({reps}.0 * list_sum(list_transform(v_, lambda x: x * x)){extra}) + 1e-8 AS n_ FROM {name}_d))"""


def cosine_sql(a: str, b: str) -> str:
    a2, b2 = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return (f"(list_dot_product({a2}, {b2}) / ((sqrt(list_dot_product({a2}, {a2})) + 1e-8) * "
            f"(sqrt(list_dot_product({b2}, {b2})) + 1e-8)))")


def seed900_sql(s: str) -> str:
    h = f"sha256({s})"
    acc = "0::BIGINT"
    for i in range(8):
        chunk = f"(('0x' || substr({h}, {8 * i + 1}, 8))::BIGINT)"
        acc = f"((({acc}) * 796 + {chunk} % 900) % 900)"
    return acc


def sql_lit(s: str) -> str:
    """A SQL string literal (newlines spelled with chr(10))."""
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


N_CONV_SQL = "(SELECT max(conv_id) + 1 FROM conversations)"


def memories_cte(name: str = "mem") -> str:
    return f"""{name} AS (
  SELECT CAST(d.doc_id % {N_CONV_SQL} AS VARCHAR) AS scope_id, d.doc_id AS seq, 'doc:' || d.doc_id AS id,
         (['episodic', 'semantic', 'procedural'])[(d.doc_id % 3) + 1] AS type, d.text AS content,
         coalesce(0.3::DOUBLE + 0.4::DOUBLE * l.quality, 0.5::DOUBLE) AS importance, {T0}::DOUBLE + d.doc_id * 60.0::DOUBLE AS created_at
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


def memory_log_cte(name: str = "mlog") -> str:
    return f"""{name} AS (
  SELECT event_id AS seq, 'u:' || user_id AS id,
         CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'delete' ELSE 'upsert' END AS op,
         props AS content, least(1.0, value / 500.0) AS importance, epoch(ts) AS created_at
  FROM events)"""


def tasks_cte(as_of: float, name: str = "scored") -> str:
    return f"""tk AS (
  SELECT CAST(o_custkey AS VARCHAR) AS scope_id, o_orderkey AS seq, CAST(o_orderkey AS VARCHAR) AS id,
         CASE WHEN o_orderstatus <> 'P' THEN epoch(o_orderdate) + 7 * 86400.0 END AS deadline_ts,
         ([1.0, 0.8, 0.6, 0.4, 0.2])[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS importance,
         least(1.0, o_totalprice / 500000.0) AS uncertainty, epoch(o_orderdate) AS last_update_ts,
         (o_custkey % 10) / 10.0 AS goal_fit
  FROM orders),
{name} AS (
  SELECT *, 0.35 * (CASE WHEN deadline_ts IS NULL OR deadline_ts = 0 THEN 0.0
                         ELSE greatest(0.0, least(1.0, 1.0 - greatest(0.0, deadline_ts - {as_of}) / 86400.0)) END)
          + 0.25 * importance + 0.15 * uncertainty
          + 0.1 * greatest(0.0, least(1.0, 1.0 / (1.0 + greatest(0.0, {as_of} - last_update_ts) / 3600.0)))
          + 0.15 * greatest(0.0, least(1.0, goal_fit)) AS score
  FROM tk)"""


def redact_sql(c: str) -> str:
    """B9 in SQL: mail addresses, then phone numbers that no digit touches (RE2 has no lookaround, so the
    neighbours are captured; two passes cover numbers that share a neighbour)."""
    from .operators.validate import EMAIL_PATTERN, PHONE_PATTERN
    p = f"(^|[^0-9]){PHONE_PATTERN}($|[^0-9])"
    e = f"regexp_replace({c}, '{EMAIL_PATTERN}', '[EMAIL]', 'g')"
    one = f"regexp_replace({e}, '{p}', '\\1[PHONE]\\2', 'g')"
    return f"regexp_replace({one}, '{p}', '\\1[PHONE]\\2', 'g')"
