"""Pages: URL normalisation, allowlist + robots gate, crawl plans, link frontier,
pages -> memories (SURVEY A10, B5, B7, B8, G2, G3, K5).

Pages are an input table (already fetched). HTML text and links come from one
``mapInPandas`` pass with the standard-library HTML parser; everything else
is column expressions and joins. Robots rules are a table
``(host, rule_order, allow, path_prefix)``: a host with rows is known (a row
with null ``rule_order`` marks an empty robots file), the first matching
prefix by ``rule_order`` decides, no match allows, an unknown host is denied.
"""

from __future__ import annotations

from html.parser import HTMLParser
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SCRAPE_TEXT_CHARS, SCRAPED_IMPORTANCE, SCRAPER_MAX_PAGES
from ..functions.text import PY_WS_CLASS

# FIXED VALUES: schemes for which an empty-host URL is still written "scheme://"
USES_NETLOC = ("", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
               "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync",
               "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services")
URL_IN_TEXT = "https?://[^" + PY_WS_CLASS[1:-1] + ")]+"

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _clean(url: Column) -> Column:
    # leading C0 controls/spaces are dropped, tab/CR/LF removed anywhere
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def url_parts(url) -> tuple[Column, Column, Column]:
    """(scheme lower-cased, netloc, path) of a URL."""
    u = _clean(_c(url))
    scheme = F.lower(F.regexp_extract(u, _SPLIT, 1))
    has_netloc = u.rlike(r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//")
    netloc = F.when(has_netloc, F.regexp_extract(u, _SPLIT, 2)).otherwise(F.lit(""))
    path = F.regexp_extract(u, _SPLIT, 3)
    return scheme, netloc, path


def normalize_url(url) -> Column:
    """Drop params (last segment), query and fragment; default scheme http."""
    scheme, netloc, path = url_parts(url)
    path = F.regexp_replace(path, r";[^/]*$", "")
    scheme = F.when(scheme == "", F.lit("http")).otherwise(scheme)
    with_slash = F.when((F.length(path) > 0) & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    netloc_form = (netloc != "") | (scheme.isin(*USES_NETLOC) & ~path.startswith("//"))
    body = F.when(netloc_form, F.concat(F.lit("//"), netloc, with_slash)).otherwise(path)
    return F.when(_c(url).isNull(), F.lit(None)).otherwise(F.concat(scheme, F.lit(":"), body))


def url_host(url) -> Column:
    return url_parts(url)[1]


def normalize_urls(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    return df.withColumn(out_col or col, normalize_url(col))


# ---------------------------------------------------------------------------
# B8 gate
# ---------------------------------------------------------------------------
def host_table(allow: DataFrame | Sequence[str], robots: DataFrame) -> DataFrame:
    """One row per host: listed, known (a robots file was read), and its rules in order as one array."""
    rules = robots.select(F.col("host").alias("_host"), F.lit(False).alias("_l"), F.lit(True).alias("_k"),
                          F.when(F.col("rule_order").isNotNull(), F.struct("rule_order", "path_prefix", "allow")).alias("_rule"))
    if isinstance(allow, DataFrame):
        listed = allow.select(F.col("host").alias("_host"), F.lit(True).alias("_l"), F.lit(False).alias("_k"))
        rules = rules.unionByName(listed, allowMissingColumns=True)
    return rules.groupBy("_host").agg(F.max("_l").alias("_listed"), F.max("_k").alias("_known"),
                                      F.array_sort(F.collect_set("_rule")).alias("_rules"))


def gate_pages(df: DataFrame, url_col: str, allow: DataFrame | Sequence[str], robots: DataFrame,
               out_col: str = "allowed") -> DataFrame:
    """Add ``out_col``. ``allow`` is a host list (``"*"`` = any) or a DataFrame ``host``.

    One left join on the host with one row per host; the first rule (by ``rule_order``) whose prefix the path
    starts with decides. Adaptive execution broadcasts the host table when it measured it as small and splits a
    crowded host otherwise.
    """
    path = url_parts(url_col)[2]
    d = df.withColumn("_host", url_host(url_col)).withColumn("_path", F.when(F.length(path) > 0, path).otherwise(F.lit("/")))
    d = d.join(host_table(allow, robots), "_host", "left")
    first = F.get(F.filter("_rules", lambda r: F.col("_path").startswith(r["path_prefix"])), F.lit(0))
    robots_ok = F.coalesce(F.col("_known"), F.lit(False)) & F.coalesce(first["allow"], F.lit(True))
    if isinstance(allow, DataFrame):
        listed = F.coalesce(F.col("_listed"), F.lit(False))
    else:
        allow = list(allow)
        listed = F.lit(True) if "*" in allow else F.col("_host").isin(*allow) if allow else F.lit(False)
    verdict = (F.when(F.col(url_col).startswith("file://"), F.lit(True))
               .when(F.col("_host") == "", F.lit(False))
               .otherwise(listed & robots_ok))
    return d.withColumn(out_col, verdict).select(*df.columns, out_col)


# ---------------------------------------------------------------------------
# B5 seed URLs in questions
# ---------------------------------------------------------------------------
def extract_seed_urls(df: DataFrame, question_col: str, allow,
                      user_available: bool = False, mode: str = "exact") -> DataFrame:
    """Allow-listed URLs found in a question, only when the user is unavailable.

    ``mode="prefix"`` reproduces the raw-prefix test (``example.com.evil``
    passes ``example.com``; ``*`` matches nothing); ``"exact"`` compares hosts.
    """
    if user_available:
        return df.limit(0).withColumn("pos", F.lit(0)).withColumn("seed", F.lit(None).cast("string"))
    found = df.select("*", F.posexplode(F.regexp_extract_all(F.col(question_col), F.lit(URL_IN_TEXT), 0))
                      .alias("pos", "seed"))
    if isinstance(allow, DataFrame):  # exact hosts, as a table
        hosts = allow.select(F.col("host").alias("_h")).distinct()
        return (found.withColumn("_h", url_host("seed")).join(hosts, "_h", "left_semi").drop("_h"))
    allow = [d for d in allow]
    if mode == "prefix":
        ok = F.lit(False)
        for d in allow:
            ok = ok | F.col("seed").startswith(f"https://{d}") | F.col("seed").startswith(f"http://{d}")
    else:
        ok = F.lit(True) if "*" in allow else url_host("seed").isin(*allow) if allow else F.lit(False)
    return found.where(ok)


# ---------------------------------------------------------------------------
# G2 plans
# ---------------------------------------------------------------------------
def plan_pages(seeds: DataFrame, max_pages: int | str | None = SCRAPER_MAX_PAGES,
               global_cap: int | None = SCRAPER_MAX_PAGES) -> DataFrame:
    """URLs a plan visits, in order (``visit``), before gating.

    ``seeds``: ``plan_id, pos, seed`` (long form) or ``plan_id, seeds`` (array).
    Seeds are cut to ``global_cap`` first, normalised, de-duplicated keeping
    the first, and at most ``max_pages`` (an int or a column name) are kept;
    denied URLs still count, as they do in the crawl loop. ``None`` lifts a
    limit; without ``max_pages`` the visit order is the seed's position, so no
    plan is numbered whole in one task.
    """
    if "seeds" in seeds.columns and "seed" not in seeds.columns:
        seeds = seeds.select("*", F.posexplode("seeds").alias("pos", "seed")).drop("seeds")
    s = seeds if global_cap is None else seeds.where(F.col("pos") < global_cap)
    s = s.withColumn("url", normalize_url("seed"))
    keep = [c for c in ([max_pages] if isinstance(max_pages, str) else [])]
    first = s.groupBy("plan_id", "url", *keep).agg(F.min("pos").alias("pos"))
    if max_pages is None:
        return first.withColumn("visit", (F.col("pos") + 1).cast("long"))
    w = Window.partitionBy("plan_id").orderBy("pos")
    limit = F.col(max_pages) if isinstance(max_pages, str) else F.lit(int(max_pages))
    return first.withColumn("visit", F.row_number().over(w).cast("long")).where(F.col("visit") <= limit)


# ---------------------------------------------------------------------------
# HTML text and links (one Python pass per partition)
# ---------------------------------------------------------------------------
class _PageParser(HTMLParser):
    SKIP = {"script", "style", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.links: list[str] = []
        self._skip = 0
        self._buf: list[str] = []

    def _flush(self):
        if self._buf:
            t = "".join(self._buf).strip()
            if t:
                self.texts.append(t)
            self._buf = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in self.SKIP:
            self._skip += 1
        self._link(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self._flush()
        self._link(tag, attrs)

    def _link(self, tag, attrs):
        href = dict(attrs).get("href") if tag == "a" else None    # of a repeated attribute the last counts
        if href is not None:
            self.links.append(href.strip())

    def handle_endtag(self, tag):
        self._flush()
        if tag in self.SKIP and self._skip:
            self._skip -= 1

    def handle_data(self, data):
        if not self._skip:
            self._buf.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()


def parse_html(html: str | None) -> tuple[str, list[str]]:
    """(text nodes stripped and joined by newlines, hrefs in document order)."""
    if html is None:
        return "", []
    p = _PageParser()
    p.feed(html)
    p.close()
    p._flush()
    return "\n".join(p.texts), p.links


def extract_pages(pages: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url"),
                  partitions: int | None = None) -> DataFrame:
    """Add ``text`` and ``links`` from the HTML (mapInPandas, stdlib parser).

    ``partitions`` spreads the parsing over that many tasks (for an input of few splits).
    """
    keep = list(keep)
    src = pages.select(*keep, html_col)
    if partitions:
        src = src.repartition(partitions)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keep)
    schema = f"{fields}, text string, links array<string>"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            parsed = [parse_html(h) for h in pdf[html_col].tolist()]
            out = pdf[keep].copy()
            out["text"] = [t for t, _ in parsed]
            out["links"] = [ls for _, ls in parsed]
            yield out

    return src.mapInPandas(run, schema)


# ---------------------------------------------------------------------------
# G3 link frontier
# ---------------------------------------------------------------------------
def link_frontier(fetched: DataFrame, allow, robots: DataFrame, visited: DataFrame | None = None,
                  same_domain_only: bool = True) -> DataFrame:
    """Distinct out-links of fetched pages (``url``, ``links``): skip ``#`` and
    ``mailto:``, resolve root-relative links against the page's scheme and
    host, normalise, gate, keep same-host links, drop visited URLs."""
    page_scheme, page_host, _ = url_parts("url")
    ex = fetched.select(F.col("url").alias("src_url"), page_scheme.alias("_ps"), page_host.alias("src_host"),
                        F.explode("links").alias("href"))
    ex = ex.where(~F.col("href").startswith("#") & ~F.col("href").startswith("mailto:"))
    resolved = F.when(F.col("href").startswith("/"),
                      F.concat(F.col("_ps"), F.lit("://"), F.col("src_host"), F.col("href"))).otherwise(F.col("href"))
    # one row per link before the gate: fewer rows to join, and no distinct after it
    if same_domain_only:        # normalising keeps the host, so the link as written decides (a small filter before the join)
        ex = ex.where(F.col("href").startswith("/") | (url_host("href") == F.col("src_host")))
    links = ex.select("src_host", normalize_url(resolved).alias("link"))
    links = gate_pages(links.distinct(), "link", allow, robots).where(F.col("allowed"))
    out = links.select("src_host", F.col("link").alias("url"))
    if visited is not None:
        out = out.join(visited.select(F.col("url")).distinct(), "url", "left_anti")
    return out


def _next_links(fetched: DataFrame, allow, robots: DataFrame) -> DataFrame:
    """(plan_id, url, at) of the gated same-host links of fetched pages; ``at`` = (visit of the page, place in it) of the first."""
    scheme, host, _ = url_parts("url")
    ex = fetched.select("plan_id", "visit", scheme.alias("_ps"), host.alias("_src"), F.posexplode("links").alias("pos", "href"))
    ex = ex.where(~F.col("href").startswith("#") & ~F.col("href").startswith("mailto:"))
    full = F.when(F.col("href").startswith("/"), F.concat("_ps", F.lit("://"), "_src", "href")).otherwise(F.col("href"))
    ex = ex.select("plan_id", "_src", F.struct("visit", "pos").alias("at"), normalize_url(full).alias("url")).where(url_host("url") == F.col("_src"))
    first = ex.groupBy("plan_id", "url").agg(F.min("at").alias("at"))
    return gate_pages(first, "url", allow, robots).where("allowed").drop("allowed")


def _ranked(links: DataFrame, limit: int | str | None) -> DataFrame:
    """``links`` with their rank per plan in the order of ``at`` (and at most ``limit`` of a plan, if it is a number)."""
    if limit is not None:
        w = Window.partitionBy("plan_id").orderBy("at")
        ranked = links.withColumn("rank", F.row_number().over(w).cast("long"))
        return ranked.where(F.col("rank") <= limit) if isinstance(limit, int) else ranked
    # no limit: ranges of (plan, at) are numbered, so no plan is numbered whole in one task
    from ..session import materialize
    from .greedy import number_runs
    rows = materialize(links.withColumn("row", F.monotonically_increasing_id()), "links")
    runs = number_runs(rows.select(F.xxhash64("plan_id").alias("group"), F.col("at").alias("pos"), "row", F.col("row").alias("node")))
    rows = rows.join(runs.select("row", "run"), "row")
    least = rows.groupBy("plan_id").agg(F.min("run").alias("least"))
    return rows.join(least, "plan_id").withColumn("rank", F.col("run") - F.col("least") + 1).drop("row", "run", "least")


# ---------------------------------------------------------------------------
# K5 pages -> memories
# ---------------------------------------------------------------------------
def crawl(seeds: DataFrame, pages: DataFrame, allow, robots: DataFrame, max_pages: int | str | None = SCRAPER_MAX_PAGES,
          global_cap: int | None = SCRAPER_MAX_PAGES, max_hops: int = 0, partitions: int | None = None) -> DataFrame:
    """``plan_id, visit, hop, page_id, url, text, links`` of the pages that plans reach, breadth first, over pages fetched before.

    A plan visits its seeds in order, then the gated links on a page's own host, in the order of (visit of the page, place in
    it), each URL once; ``visit`` is the plan's total order over all hops, and ``max_pages`` is its budget over all hops: every URL taken counts, denied
    seeds and failed fetches too. A hop is a round: the frontier is what was found, less what was seen, cut to what is left of
    the budget. The page of a URL is the lowest ``page_id`` whose normalised URL equals it; a URL without one is a failed fetch. Visits
    find their ``page_id`` without the HTML, which is then read for those pages only.
    """
    from ..session import materialize
    where = pages.select("page_id", normalize_url("url").alias("url")).groupBy("url").agg(F.min("page_id").alias("page_id"))

    def fetch(visits: DataFrame, hop: int) -> DataFrame:
        got = visits.join(where, "url").join(pages.select("page_id", "html"), "page_id")
        return extract_pages(got, keep=("plan_id", "visit", "page_id", "url"), partitions=partitions).withColumn("hop", F.lit(hop))

    planned = plan_pages(seeds, max_pages, global_cap)
    if not max_hops:
        return fetch(gate_pages(planned.select("plan_id", "visit", "url"), "url", allow, robots).where("allowed").drop("allowed"), 0)
    limits = planned.select("plan_id", F.col(max_pages).alias("_most")).distinct() if isinstance(max_pages, str) else None
    taken = materialize(planned.select("plan_id", "visit", "url"), "taken")
    last = materialize(fetch(gate_pages(taken, "url", allow, robots).where("allowed").drop("allowed"), 0), "fetched")
    out = last
    for hop in range(1, max_hops + 1):
        links = _next_links(last, allow, robots).join(taken.select("plan_id", "url"), ["plan_id", "url"], "left_anti")
        top = taken.groupBy("plan_id").agg(F.max("visit").alias("_top"))
        new = _ranked(links, max_pages).join(top, "plan_id").withColumn("visit", F.col("_top") + F.col("rank"))
        if limits is not None:
            new = new.join(limits, "plan_id").where("visit <= _most")
        elif max_pages is not None:
            new = new.where(F.col("visit") <= max_pages)
        new = materialize(new.select("plan_id", "visit", "url"), "frontier")
        last = materialize(fetch(new, hop), "fetched")
        taken = taken.unionByName(new)
        out = out.unionByName(last)
    return out


def pages_to_memories(seeds: DataFrame, pages: DataFrame, allow, robots: DataFrame, as_of: float,
                      max_pages: int | str | None = SCRAPER_MAX_PAGES, embed=None,
                      global_cap: int | None = SCRAPER_MAX_PAGES, text_chars: int | None = SCRAPE_TEXT_CHARS,
                      max_hops: int = 0, partitions: int | None = None) -> DataFrame:
    """K5: crawl plans (``crawl``) over already-fetched pages -> semantic memory rows; ``text_chars=None`` keeps the whole text."""
    from ..operators.providers import embed_table
    ex = crawl(seeds, pages, allow, robots, max_pages, global_cap, max_hops, partitions)
    ex = ex.withColumn("_text", F.col("text") if text_chars is None else F.substring(F.col("text"), 1, text_chars))
    embed = embed or (lambda df, c, o: embed_table(df, c, out_col=o))
    ex = embed(ex, "_text", "embedding")
    key = F.sha2(F.concat_ws("\u0001", F.col("plan_id"), F.col("url")), 256)
    return ex.select(
        "plan_id", "visit", "page_id",
        F.concat(F.lit("doc:"), F.substring(key, 1, 16)).alias("id"),
        F.lit("semantic").alias("type"),
        F.concat(F.lit("[source:"), F.col("url"), F.lit("]\n"), F.col("_text")).alias("content"),
        "embedding",
        F.lit(SCRAPED_IMPORTANCE).alias("importance"),
        F.lit(float(as_of)).alias("created_at"),
        F.lit(float(as_of)).alias("last_access"),
        F.to_json(F.struct(F.lit("scraper").alias("source"), F.col("url").alias("url"))).alias("metadata_json"),
        "url", "links", "hop",
    )


def read_pages(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """A10: pages source: parquet ``(page_id, url, html)``, or a directory of HTML
    files read whole (``url`` = ``file://`` path; numbered in the order of their paths, however they are dealt to tasks)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    from ..sources.io import number_by_file
    df = spark.read.option("wholetext", True).text(path)
    df = df.select(F.input_file_name().alias("url"), F.col("value").alias("html"), F.col("_metadata.file_path").alias("_file"),
                   F.col("_metadata.file_block_start").alias("_block"))
    return number_by_file(df, 0, "page_id").select("page_id", "url", "html")
