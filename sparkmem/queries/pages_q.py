"""Page queries (A10, B5, B7, B8, G2, G3, K5) over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as P
from ..registry import query
from ..sources import fixtures as fx
from ..sql_text import T0

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def _norm_sql(u: str) -> str:
    return (f"(lower(regexp_extract({u}, '{_SCHEME}', 1)) || '://' || regexp_extract({u}, '{_HOST}', 1) || "
            f"regexp_replace(regexp_extract({u}, '{_PATH}', 1), ';[^/]*$', ''))")


def _host_sql(u: str) -> str:
    return f"regexp_extract({u}, '{_HOST}', 1)"


_ROBOTS_SQL = f"""
hosts AS (SELECT DISTINCT {_host_sql('url')} AS host FROM pages),
known AS (SELECT host FROM hosts WHERE NOT ends_with(host, '.org')),
rules AS (
  SELECT host, 1 AS rule_order, false AS allow, '/en/' AS prefix FROM known WHERE starts_with(host, 'm.')
  UNION ALL SELECT host, 2, true, '/' FROM known WHERE starts_with(host, 'm.')
  UNION ALL SELECT host, 1, false, '/fr/' FROM known WHERE starts_with(host, 'blog.'))
"""


def _gate_sql(src: str, url: str) -> str:
    """CTE ``gated`` over ``src`` adding ``allowed`` for column ``url`` (allowlist = every host seen)."""
    return f"""
gx AS (SELECT s.*, {_host_sql(url)} AS g_host,
              coalesce(nullif(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS g_path
       FROM {src} s),
gated AS (
  SELECT gx.*, CASE
     WHEN starts_with({url}, 'file://') THEN true
     WHEN g_host = '' THEN false
     WHEN g_host NOT IN (SELECT host FROM hosts) THEN false
     WHEN g_host NOT IN (SELECT host FROM known) THEN false
     ELSE coalesce((SELECT arg_min(r.allow, r.rule_order) FROM rules r
                    WHERE r.host = gx.g_host AND starts_with(gx.g_path, r.prefix)), true) END AS allowed
  FROM gx)"""


def _allow(spark, sf):
    return fx.allow_hosts(spark, sf)


@query("url_normalize", oracle=f"SELECT page_id, {_norm_sql('url')} AS url_norm FROM pages")
def url_normalize(spark, sf):
    p = fx.table(spark, sf, "pages", "page_id", "url")
    return p.select("page_id", P.normalize_url("url").alias("url_norm"))


@query("page_gate", oracle=f"""
WITH {_ROBOTS_SQL.strip()},
u AS (SELECT page_id, {_norm_sql('url')} AS url FROM pages),
{_gate_sql('u', 'url').strip()}
SELECT page_id, url, allowed FROM gated
""")
def page_gate(spark, sf):
    p = fx.table(spark, sf, "pages", "page_id", "url").select("page_id", P.normalize_url("url").alias("url"))
    g = P.gate_pages(p, "url", _allow(spark, sf), fx.robots_rules(spark, sf))
    return g.select("page_id", "url", "allowed")


_PLAN_SQL = f"""
s AS (SELECT regexp_extract({_host_sql('url')}, '([^.]+\\.[^.]+)$', 1) AS plan_id, page_id, url FROM pages),
ps AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY page_id) - 1 AS pos FROM s),
pn AS (SELECT plan_id, {_norm_sql('url')} AS url, min(pos) AS pos FROM ps WHERE pos < 5 GROUP BY 1, 2),
plan AS (SELECT plan_id, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY pos) AS BIGINT) AS visit, url FROM pn
         QUALIFY visit <= 5)
"""


@query("page_plan", oracle=f"WITH {_PLAN_SQL.strip()} SELECT plan_id, visit, url FROM plan")
def page_plan(spark, sf):
    v = P.plan_pages(fx.plan_seeds_head(spark, sf, 5), max_pages=5)
    return v.select("plan_id", "visit", "url")


@query("link_frontier", oracle=f"""
WITH {_ROBOTS_SQL.strip()},
l AS (SELECT lower(regexp_extract(url, '{_SCHEME}', 1)) AS ps, {_host_sql('url')} AS src_host,
             trim(unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS href FROM pages),
f AS (SELECT src_host, CASE WHEN starts_with(href, '/') THEN ps || '://' || src_host || href ELSE href END AS link
      FROM l WHERE NOT starts_with(href, '#') AND NOT starts_with(href, 'mailto:')),
n AS (SELECT src_host, {_norm_sql('link')} AS link FROM f),
{_gate_sql('n', 'link').strip()}
SELECT DISTINCT src_host, link AS url FROM gated
WHERE allowed AND g_host = src_host AND link NOT IN (SELECT {_norm_sql('url')} FROM pages)
""")
def link_frontier(spark, sf):
    ex = P.extract_pages(fx.table(spark, sf, "pages", "page_id", "url", "html"))
    visited = fx.table(spark, sf, "pages", "url").select(P.normalize_url("url").alias("url"))
    fr = P.link_frontier(ex, _allow(spark, sf), fx.robots_rules(spark, sf), visited=visited)
    return fr.select("src_host", "url")


@query("seed_urls", oracle=f"""
SELECT page_id, CAST(0 AS INTEGER) AS pos, url AS seed FROM pages WHERE ends_with({_host_sql('url')}, '.example.com')
""")
def seed_urls(spark, sf):
    p = fx.table(spark, sf, "pages", "page_id", "url")
    q = p.select("page_id", F.concat(F.lit("see "), F.col("url")).alias("question"))
    allow = fx.allow_hosts(spark, sf).where(F.col("host").endswith(".example.com"))
    s = P.extract_seed_urls(q, "question", allow, user_available=False)
    return s.select("page_id", "pos", "seed")


@query("pages_to_memories", oracle=f"""
WITH {_ROBOTS_SQL.strip()},
s AS (SELECT regexp_extract({_host_sql('url')}, '([^.]+\\.[^.]+)$', 1) AS plan_id, page_id, {_norm_sql('url')} AS url FROM pages),
pn AS (SELECT plan_id, url, min(page_id) AS page_id FROM s GROUP BY 1, 2),
{_gate_sql('pn', 'url').strip()}
SELECT plan_id, page_id + 1 AS visit, page_id, 'doc:' || substr(sha256(concat_ws(chr(1), plan_id, url)), 1, 16) AS id,
       'semantic' AS type, 0.2::DOUBLE AS importance, '{{"source":"scraper","url":"' || url || '"}}' AS metadata_json
FROM gated WHERE allowed
""")
def pages_to_memories(spark, sf):
    """Every gated page of every plan, whole texts: no limit on seeds, pages or characters."""
    pages = fx.table(spark, sf, "pages", "page_id", "url", "html")
    mem = P.pages_to_memories(fx.plan_seeds(spark, sf), pages, _allow(spark, sf), fx.robots_rules(spark, sf), as_of=T0,
                              max_pages=None, global_cap=None, text_chars=None)
    return mem.select("plan_id", "visit", "page_id", "id", "type", "importance", "metadata_json")


@query("pages_to_memories_head", oracle=f"""
WITH {_ROBOTS_SQL.strip()}, {_PLAN_SQL.strip()},
{_gate_sql('plan', 'url').strip()},
f AS (SELECT {_norm_sql('url')} AS url, min(page_id) AS page_id FROM pages GROUP BY 1)
SELECT g.plan_id, g.visit, f.page_id, 'doc:' || substr(sha256(concat_ws(chr(1), g.plan_id, g.url)), 1, 16) AS id,
       'semantic' AS type, 0.2::DOUBLE AS importance
FROM gated g JOIN f USING (url) WHERE allowed
""")
def pages_to_memories_head(spark, sf):
    """The crawl's own limits: five seeds and five pages per plan, 4,000 characters per page."""
    pages = fx.table(spark, sf, "pages", "page_id", "url", "html")
    mem = P.pages_to_memories(fx.plan_seeds_head(spark, sf, 5), pages, _allow(spark, sf), fx.robots_rules(spark, sf), as_of=T0, max_pages=5)
    return mem.select("plan_id", "visit", "page_id", "id", "type", "importance")


_HOP_SQL = f"""
f AS (SELECT {_norm_sql('url')} AS url, min(page_id) AS page_id FROM pages GROUP BY 1),
raw AS (SELECT page_id, lower(regexp_extract(url, '{_SCHEME}', 1)) AS ps, {_host_sql('url')} AS src_host,
               regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages WHERE page_id IN (SELECT page_id FROM f)),
l AS (SELECT page_id, ps, src_host, trim(unnest(hrefs)) AS href, generate_subscripts(hrefs, 1) AS pos FROM raw),
n AS (SELECT page_id, src_host, pos, {_norm_sql('link')} AS url FROM (
        SELECT *, CASE WHEN starts_with(href, '/') THEN ps || '://' || src_host || href ELSE href END AS link
        FROM l WHERE NOT starts_with(href, '#') AND NOT starts_with(href, 'mailto:'))),
every AS (SELECT DISTINCT url FROM n UNION SELECT url FROM plan),
{_gate_sql('every', 'url').strip()},
ok AS (SELECT url FROM gated WHERE allowed),
out_links AS (SELECT n.page_id, n.pos, n.url FROM n JOIN ok USING (url) WHERE {_host_sql('n.url')} = src_host),
v0 AS (SELECT plan_id, visit, url FROM plan),
h0 AS (SELECT v0.*, f.page_id FROM v0 JOIN ok USING (url) JOIN f USING (url))"""


def _round_sql(k: int, most: int) -> str:
    """CTEs of one more hop: v<k> (all visits taken so far) and h<k> (the pages of hop k)."""
    return f"""
c{k} AS (SELECT plan_id, o.url, min(struct_pack(v := h.visit, p := o.pos)) AS at_
       FROM h{k - 1} h JOIN out_links o USING (page_id) GROUP BY 1, 2),
n{k} AS (SELECT plan_id, top + row_number() OVER (PARTITION BY plan_id ORDER BY at_) AS visit, url
       FROM c{k} JOIN (SELECT plan_id, max(visit) AS top FROM v{k - 1} GROUP BY 1) USING (plan_id)
       WHERE (plan_id, url) NOT IN (SELECT (plan_id, url) FROM v{k - 1})),
m{k} AS (SELECT * FROM n{k} WHERE visit <= {most}),
v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT * FROM m{k}),
h{k} AS (SELECT m{k}.*, f.page_id FROM m{k} JOIN f USING (url))"""


def _site_path_sql(i: str) -> str:
    return f"(CASE WHEN ({i}) % 16 < 8 THEN '/en/p/' ELSE '/fr/p/' END || CAST({i} AS VARCHAR))"


_SITE_SQL = f"""
pages AS (
  SELECT page_id,
         'http://' || CASE page_id % 8 WHEN 0 THEN 'm.s0.example.com' WHEN 1 THEN 'blog.s1.example.com' WHEN 2 THEN 's2.example.org'
                      ELSE 's' || (page_id % 8) || '.example.com' END || {_site_path_sql('page_id')} AS url,
         '<a href="' || {_site_path_sql('page_id + 8')} || '">n</a><a href="' || {_site_path_sql('page_id + 40')}
         || '">n</a><a href="' || {_site_path_sql('page_id // 16 * 8 + page_id % 8')}
         || '">n</a><a href="http://s5.example.com' || {_site_path_sql('page_id + 5')} || '">n</a>' || coalesce(html, '') AS html
  FROM main.pages),
plan AS (SELECT {_host_sql('url')} AS plan_id, row_number() OVER (PARTITION BY {_host_sql('url')} ORDER BY page_id) AS visit, url FROM pages
         QUALIFY visit <= 2)
"""


def _crawl_oracle(most: int) -> str:
    return f"""
WITH {_SITE_SQL.strip()}, {_ROBOTS_SQL.strip()}, {_HOP_SQL.strip()}, {_round_sql(1, most).strip()}, {_round_sql(2, most).strip()}
SELECT plan_id, CAST(visit AS BIGINT) AS visit, 0 AS hop, page_id, url FROM h0
UNION ALL SELECT plan_id, visit, 1, page_id, url FROM h1
UNION ALL SELECT plan_id, visit, 2, page_id, url FROM h2
"""


def _crawl_sites(spark, sf, most):
    pages = fx.site_pages(spark, sf)
    hosts = pages.select(fx.page_host("url").alias("host")).distinct()
    seeds = pages.select(fx.page_host("url").alias("plan_id"), F.col("url").alias("seed"), F.expr("page_id div 8").alias("pos")).where("pos < 2")
    out = P.crawl(seeds, pages, hosts, fx.robots_rules(spark, sf, hosts), max_pages=most, global_cap=2, max_hops=2)
    return out.select("plan_id", "visit", "hop", "page_id", "url")


@query("crawl_hops", oracle=_crawl_oracle(9))
def crawl_hops(spark, sf):
    """Eight sites, two seeds each, links followed for two hops, breadth first, within a budget of nine URLs a site."""
    return _crawl_sites(spark, sf, 9)


@query("crawl_hops_whole", oracle=_crawl_oracle(10 ** 9))
def crawl_hops_whole(spark, sf):
    """The same without a budget."""
    return _crawl_sites(spark, sf, None)
