"""Working-memory queries (E1-E6, B1, D5) over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import working as W
from ..registry import query
from ..sources import fixtures as fx
from ..sql_text import T0, py_strip, thoughts_cte, wm_cte

WM_AS_OF = T0 + 3600.0


def _wm(spark, sf):
    return W.working_memory(fx.thoughts(spark, sf), char_budget=4000)


@query("wm_budget", oracle=f"""
WITH {thoughts_cte()}
SELECT scope_id, seq, CAST(length(content) AS BIGINT) AS wm_len
FROM thoughts t
WHERE (SELECT SUM(length(u.content)) FROM thoughts u
       WHERE u.scope_id = t.scope_id AND u.seq >= t.seq) <= 4000
""")
def wm_budget(spark, sf):
    return _wm(spark, sf).select("scope_id", "seq", "wm_len")


@query("wm_view", oracle=f"""
WITH {thoughts_cte()}, {wm_cte()},
r AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY seq DESC) AS rn FROM wm)
SELECT scope_id, CAST(row_number() OVER (PARTITION BY scope_id ORDER BY seq) AS BIGINT) AS pos, seq, id
FROM r WHERE rn <= 5
""")
def wm_view(spark, sf):
    return W.wm_view(_wm(spark, sf), n=5).select("scope_id", "pos", "seq", "id")


@query("wm_decay", oracle=f"""
WITH {thoughts_cte()}
SELECT scope_id, seq,
       round(importance * power(0.5, greatest(0.0, {WM_AS_OF} - ts) / 900.0), 6) AS score
FROM thoughts
""")
def wm_decay(spark, sf):
    df = W.decay_score(fx.thoughts(spark, sf), WM_AS_OF, 900)
    return df.select("scope_id", "seq", F.round("score", 6).alias("score"))


@query("wm_summary", oracle=f"""
WITH {thoughts_cte()}, {wm_cte()},
sc AS (
  SELECT scope_id, seq, importance * power(0.5, greatest(0.0, {WM_AS_OF} - ts) / 900.0) AS score,
         '- [''' || role || '''] ' || {py_strip('content')} AS line
  FROM wm),
r AS (
  SELECT *, SUM(length(line)) OVER (PARTITION BY scope_id ORDER BY score DESC, seq
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used,
         row_number() OVER (PARTITION BY scope_id ORDER BY score DESC, seq) AS rk
  FROM sc)
SELECT scope_id, CAST(rk AS BIGINT) AS rank, seq, line FROM r WHERE used <= 9830
""")
def wm_summary(spark, sf):
    lines = W.wm_lines(_wm(spark, sf), WM_AS_OF, half_life=900, ctx_tokens=8192)
    return lines.select("scope_id", "rank", "seq", "line")


@query("wm_usage", oracle=f"""
WITH {thoughts_cte()}, {wm_cte()}
SELECT scope_id, CAST(SUM(length(content)) AS BIGINT) AS wm_chars, COUNT(*) AS wm_items
FROM wm GROUP BY scope_id
""")
def wm_usage(spark, sf):
    return W.wm_usage(_wm(spark, sf))


@query("stimuli_pack", oracle=f"""
WITH s AS (
  SELECT CAST(conv_id AS VARCHAR) AS scope_id, turn AS seq, 'chat: ' || {py_strip('text')} AS line
  FROM conversations WHERE role = 'user'),
r AS (
  SELECT *, SUM(length(line)) OVER (PARTITION BY scope_id ORDER BY seq DESC
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
  FROM s)
SELECT scope_id, CAST(row_number() OVER (PARTITION BY scope_id ORDER BY seq) AS BIGINT) AS pos, seq, line
FROM r WHERE used <= 6553
""")
def stimuli_pack(spark, sf):
    lines = W.stimuli_lines(fx.stimuli_chat(spark, sf), ctx_tokens=8192)
    return lines.select("scope_id", "pos", "seq", "line")


@query("recent_thoughts", oracle=f"""
WITH {thoughts_cte()},
r AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY seq DESC) AS rn FROM thoughts)
SELECT scope_id, CAST(row_number() OVER (PARTITION BY scope_id ORDER BY seq) AS BIGINT) AS pos, seq, id
FROM r WHERE rn <= 5
""")
def recent_thoughts(spark, sf):
    return W.recent_thoughts(fx.thoughts(spark, sf), k=5).select("scope_id", "pos", "seq", "id")
