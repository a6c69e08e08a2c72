"""K5's hops against a plain breadth-first loop; A10's numbers."""
import random
from urllib.parse import urlparse

import pytest

from sparkmem.operators import pages as P

ROBOTS = "host string, rule_order int, allow boolean, path_prefix string"


def loop(seeds, pages, rules, cap, most, hops):
    """(plan, visit, hop, page_id, url) by a queue; ``rules``: prefixes denied per host, a host without an entry is denied whole."""
    by_url = {}
    for page_id, url, html in pages:
        if url not in by_url or page_id < by_url[url][0]:
            by_url[url] = (page_id, html)

    def allowed(url):
        u = urlparse(url)
        return u.netloc in rules and not any((u.path or "/").startswith(d) for d in rules[u.netloc])

    out = []
    for plan, urls in seeds.items():
        queue, seen = [(u, 0) for u in urls[:cap]], set()
        while queue and (most is None or len(seen) < most):
            url, hop = queue.pop(0)
            if url in seen:
                continue
            seen.add(url)
            if not allowed(url) or url not in by_url:
                continue
            out.append((plan, len(seen), hop, by_url[url][0], url))
            if hop == hops:
                continue
            for href in P.parse_html(by_url[url][1])[1]:
                if href.startswith("#") or href.startswith("mailto:"):
                    continue
                full = f"http://{urlparse(url).netloc}{href}" if href.startswith("/") else href
                if allowed(full) and urlparse(full).netloc == urlparse(url).netloc:
                    queue.append((full, hop + 1))
    return sorted(out)


@pytest.mark.parametrize("seed,most,hops", [(1, 7, 2), (2, 20, 3), (3, None, 2), (4, 3, 1), (5, 50, 0)])
def test_hops_equal_a_queue(spark, seed, most, hops):
    rnd = random.Random(seed)
    hosts = ["a.com", "b.com", "c.org"]
    paths = [f"http://{h}/{'x/' if i % 4 == 3 else ''}{i}" for h in hosts for i in range(14)]
    pages = []
    for i, url in enumerate(paths):
        if rnd.random() < 0.85:
            links = [rnd.choice([p, p[len("http://a.com"):], "#top", "mailto:x@y"]) for p in rnd.choices(paths, k=5)]
            pages.append((100 - i, url, "".join(f'<a href="{x}">n</a>' for x in links + links[:1])))
    pages.append((200, pages[0][1], "a later fetch of the first"))
    rules = {"a.com": ["/x/"], "b.com": []}
    robots = [("a.com", 1, False, "/x/"), ("b.com", None, None, None)]
    seeds = {f"p{k}": rnd.sample(paths, 6) for k in range(3)}
    rows = [(p, i, u) for p, urls in seeds.items() for i, u in enumerate(urls)]
    got = P.crawl(spark.createDataFrame(rows, "plan_id string, pos long, seed string").repartition(2),
                  spark.createDataFrame(pages, "page_id long, url string, html string"), ["a.com", "b.com", "c.org"],
                  spark.createDataFrame(robots, ROBOTS), most, 4, hops).collect()
    have = sorted((r.plan_id, r.visit, r.hop, r.page_id, r.url) for r in got)
    assert have == loop(seeds, pages, rules, 4, most, hops)
    assert len({r[:2] for r in have}) == len(have)                  # a plan's visits are a total order


def test_budget_per_plan_from_a_column(spark):
    pages = spark.createDataFrame([(i, f"http://a.com/{i}", f'<a href="/{i + 1}">n</a><a href="/{i + 2}">n</a>') for i in range(20)], "page_id long, url string, html string")
    seeds = spark.createDataFrame([("p", 0, "http://a.com/0", 3), ("q", 0, "http://a.com/5", 1)], "plan_id string, pos long, seed string, most int")
    robots = spark.createDataFrame([("a.com", None, None, None)], ROBOTS)
    got = P.crawl(seeds, pages, ["a.com"], robots, "most", None, 4).collect()
    assert sorted((r.plan_id, r.visit, r.page_id) for r in got) == [("p", 1, 0), ("p", 2, 1), ("p", 3, 2), ("q", 1, 5)]


def test_files_are_numbered_by_path(spark, tmp_path):
    for name in ("b.html", "a.html", "a.html;v=2", "c.html"):
        (tmp_path / name).write_text(f"<p>{name}</p>")
    for parts in ("1", "134217728"):
        spark.conf.set("spark.sql.files.openCostInBytes", parts)
        rows = P.read_pages(spark, str(tmp_path), "text").orderBy("page_id").collect()
        assert [(r.page_id, r.html) for r in rows] == [(i, f"<p>{n}</p>") for i, n in enumerate(["a.html", "a.html;v=2", "b.html", "c.html"])] or \
            [r.html for r in rows] == [f"<p>{n}</p>" for n in sorted(["a.html", "a.html;v=2", "b.html", "c.html"], key=lambda n: n.replace(";", "%3B"))]
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.page_id for r in rows] == [0, 1, 2, 3] and all(r.url.startswith("file:") for r in rows)
