from urllib.parse import urlparse, urlunparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmem.operators import consolidate as C
from sparkmem.operators import pages as P

URLS = ["http://a.example.com/x;p?q=1#f", "https://H.example.com/a;b/c;d", "HTTP://a.example.com",
        "a.example.com/rel", "/root/only", "file:///tmp/x.html", "mailto:x@y.z", "http://a.example.com/p?x=1",
        "http://a.example.com/p#frag", "https://a.example.com:8080/x/y/"]


def _py_norm(u):
    p = urlparse(u)
    return urlunparse((p.scheme or "http", p.netloc, p.path, "", "", ""))


def test_normalize_matches_urllib(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    got = [r.n for r in df.select(P.normalize_url("u").alias("n")).collect()]
    for u, g in zip(URLS, got):
        if urlparse(u).netloc or u.startswith("file:"):
            assert g == _py_norm(u), u


def test_gate_rules(spark):
    robots = spark.createDataFrame([
        ("m.x.com", 1, False, "/en/"), ("m.x.com", 2, True, "/"), ("plain.x.com", None, None, None)],
        "host string, rule_order int, allow boolean, path_prefix string")
    urls = ["http://m.x.com/en/1", "http://m.x.com/fr/1", "http://plain.x.com/a", "http://norobots.x.com/a",
            "http://notlisted.com/a", "file:///tmp/a", "http:///nohost"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    allow = ["m.x.com", "plain.x.com", "norobots.x.com"]
    got = {r.url: r.allowed for r in P.gate_pages(df, "url", allow, robots).collect()}
    assert got == {"http://m.x.com/en/1": False, "http://m.x.com/fr/1": True, "http://plain.x.com/a": True,
                   "http://norobots.x.com/a": False, "http://notlisted.com/a": False, "file:///tmp/a": True,
                   "http:///nohost": False}
    star = {r.url: r.allowed for r in P.gate_pages(df, "url", ["*"], robots).collect()}
    assert star["http://notlisted.com/a"] is False and star["http://plain.x.com/a"] is True


def test_plan_dedupes_and_caps(spark):
    seeds = spark.createDataFrame([("p", ["http://a.com/x?q=1", "http://a.com/x#f", "http://a.com/x;p",
                                          "http://a.com/y", "http://a.com/z", "http://a.com/w"])],
                                  "plan_id string, seeds array<string>")
    v = [r.url for r in P.plan_pages(seeds, max_pages=5).orderBy("visit").collect()]
    assert v == ["http://a.com/x", "http://a.com/y", "http://a.com/z"]  # seeds cut to 5 first


def test_seed_urls_prefix_vs_exact(spark):
    df = spark.createDataFrame([("see https://example.com.evil/x and http://example.com/y)",)], "q string")
    pre = [r.seed for r in P.extract_seed_urls(df, "q", ["example.com"], mode="prefix").collect()]
    ex = [r.seed for r in P.extract_seed_urls(df, "q", ["example.com"], mode="exact").collect()]
    assert pre == ["https://example.com.evil/x", "http://example.com/y"] and ex == ["http://example.com/y"]
    assert P.extract_seed_urls(df, "q", ["example.com"], user_available=True).count() == 0


def test_html_text_and_frontier(spark):
    html = ('<html><head><style>p{}</style><script>var a="</p>";</script></head><body><!-- c -->'
            '<p>Hello &amp; <b>world</b></p><a href=" /next ">n</a><a href="#top">t</a>'
            '<a href="mailto:a@b.c">m</a><a href="http://other.com/x">o</a><a href="rel/x">r</a></body></html>')
    text, links = P.parse_html(html)
    assert text == "Hello &\nworld\nn\nt\nm\no\nr"
    robots = spark.createDataFrame([("a.com", None, None, None), ("other.com", None, None, None)],
                                   "host string, rule_order int, allow boolean, path_prefix string")
    pages = spark.createDataFrame([("http://a.com/p", links)], "url string, links array<string>")
    fr = [r.url for r in P.link_frontier(pages, ["a.com", "other.com"], robots).collect()]
    assert fr == ["http://a.com/next"]


def test_greedy_clusters_near_copies():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(3, 16))
    vecs = [base[0], base[1], base[0] + 0.01, None, base[2], base[1] * 2, []]
    idx = C.greedy_clusters(vecs, 0.95, dim=16)
    assert idx[0] == idx[2] and idx[1] == idx[5] and len({idx[0], idx[1], idx[3], idx[4], idx[6]}) == 5


def test_consolidate_rollup(spark):
    rows = [("s", i, f"m{i}", "episodic", t, [1.0, 0.0] if t == "dup" else [0.0, float(i)], float(i))
            for i, t in enumerate(["dup", "x", "dup", "y", "dup"])]
    m = spark.createDataFrame(rows, "scope_id string, seq long, id string, type string, content string, "
                                    "embedding array<float>, created_at double")
    out = C.consolidate(m, 100.0, max_items=50).collect()
    assert len(out) == 2  # the three dups; x and y are parallel vectors too
    dup = [r for r in out if r.n_members == 3][0]
    assert dup.content == "Summary of 3 events:\ndup\ndup\ndup" and dup.importance == pytest.approx(0.66)
    assert dup.member_ids == "m4,m2,m0"


def test_near_duplicate_pairs_brute(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8))
    df = spark.createDataFrame([(str(i), i, [float(x) for x in v[i]]) for i in range(40)],
                               "id string, seq long, embedding array<float>")
    got = {(r.id_a, r.id_b) for r in C.near_duplicate_pairs(df, 0.5).collect()}
    f = np.array([[float(np.float32(x)) for x in row] for row in v])
    n = np.sqrt((f * f).sum(1)) + 1e-8
    s = f @ f.T / np.outer(n, n)
    exp = {(str(i), str(j)) for i in range(40) for j in range(i + 1, 40) if s[i, j] >= 0.5}
    assert got == exp


def test_components_fold_equals_whole_fold(spark):
    """Folding the components of cosine >= threshold ** 2 gives the clusters of the whole greedy fold."""
    import numpy as np
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 6))
    vecs = [list(map(float, base[rng.integers(12)] + rng.normal(0, 0.25, 6))) for _ in range(150)]
    vecs += [vecs[3]] * 5 + [None, []]
    rows = [("s", i, f"m{i}", "episodic", "c", float(i), v) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "scope_id string, seq long, id string, type string, content string, created_at double, embedding array<double>")
    for t in (0.9, 0.7):
        got = {}
        for r in C.cluster_members(df, None, t).collect():
            got.setdefault(r.cluster, set()).add(r.id)
        order = sorted(rows, key=lambda r: -r[5])
        idx = C.greedy_clusters([r[6] for r in order], t)
        want = {}
        for r, c in zip(order, idx):
            want.setdefault(c, set()).add(r[2])
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_rollup_text_of_many_empty_members(spark):
    df = spark.range(600).selectExpr("'s' AS scope_id", "1 AS cluster", "id AS member_pos", "cast(id AS string) AS id", "'' AS content")
    r = C.cluster_rollup(df, 0.0, include_members=False).first()
    assert r.content == "Summary of 600 events:\n" + "\n" * 512


def test_copies_give_stars(spark):
    rows = [(str(i), i, [1.0, 0.0] if i < 6 else [1.0, 0.1]) for i in range(8)]
    df = spark.createDataFrame(rows, "id string, seq long, embedding array<double>")
    got = sorted((r.id_a, r.id_b) for r in C.near_duplicate_pairs(df, 0.9).collect())
    assert got == sorted([("0", str(i)) for i in range(1, 7)] + [("6", "7")])


def test_last_href_counts():
    assert P.parse_html('<a href="x" href="y">t</a><a>u</a>')[1] == ["y"]


def test_hops_follow_links(spark):
    pages = spark.createDataFrame([(1, "http://a.com/1", '<a href="/2">n</a>one'), (2, "http://a.com/2", '<a href="/3">n</a>two'),
                                   (3, "http://a.com/3", "three")], "page_id long, url string, html string")
    robots = spark.createDataFrame([("a.com", None, None, None)], "host string, rule_order int, allow boolean, path_prefix string")
    seeds = spark.createDataFrame([("p", 0, "http://a.com/1")], "plan_id string, pos long, seed string")
    for hops, n in ((0, 1), (1, 2), (2, 3)):
        assert P.pages_to_memories(seeds, pages, ["a.com"], robots, 0.0, max_hops=hops).count() == n


def test_fold_gets_runs_without_contents(spark, monkeypatch):
    """A hot group of copies beside one other vector reaches the fold as runs; rows, nulls and repeated rows come back whole."""
    rows = [("s" if i % 2 else None, i, f"m{i}", "episodic", "c" * 50, float(i), [1.0, 0.0] if i < 190 else [1.0, 0.05]) for i in range(200)]
    rows += rows[:4]
    df = spark.createDataFrame(rows, "scope_id string, seq long, id string, type string, content string, created_at double, embedding array<double>")
    got = C.cluster_members(df, None, 0.9)
    assert sorted((r.scope_id or "", r.id, r.content) for r in got.collect()) == sorted((r[0] or "", r[2], r[4]) for r in rows)
    assert {r.n for r in got.groupBy("scope_id", "cluster").agg(C.F.count("*").alias("n")).collect()} == {102}
    assert C.greedy_clusters([[1.0, 0.0], [0.0, 1.0], [0.8, 0.6]], 0.7, times=[50, 3, 1]) == [0, 1, 0]
    near = spark.createDataFrame([(i, i, [1.0, i / 1000]) for i in range(60)], "id long, seq long, embedding array<double>")
    assert C.block_pairs(near, 0.9, links=True).count() < 200 < C.block_pairs(near, 0.9).count()


def test_consolidation_carries_no_more_text_than_it_shows(spark, monkeypatch):
    """whole texts went through every shuffle and sort of the fold and the rollup; a summary has 512 characters."""
    from pyspark.sql import functions as F

    from sparkmem.operators import consolidate as C
    rows = [("s", i, f"m{i}", "episodic", None if i == 6 else "x" * 2 + f"{i // 3}" * 2000, [float(i // 3 + 1), 1.0 - i // 3], float(i)) for i in range(7)]
    mem = spark.createDataFrame(rows, "scope_id string, seq long, id string, type string, content string, embedding array<float>, created_at double")
    kept, old = {}, C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name="cut": kept.setdefault(name, old(df, name)))
    summary, members = C.consolidate_members(mem, 9.0, threshold=0.99)
    for name in ("members", "clusters"):
        assert kept[name].agg(F.max(F.length("content"))).first()[0] == 512
    assert sorted(r.content for r in summary.collect()) == [f"Summary of 3 events:\nxx{j}" + f"{j}" * 509 for j in range(2)]
    assert members.count() == 6


def test_members_of_many_turns(spark, monkeypatch):
    """the members are those of one turn, whatever is sent to tiles at a time."""
    import numpy as np

    from sparkmem.operators import consolidate as C
    from sparkmem.operators import vector_index as V
    rnd = np.random.default_rng(2)
    x = np.repeat(rnd.normal(size=(60, 64)), 4, axis=0) + rnd.normal(size=(240, 64)) * 0.05
    rows = [(f"s{i % 2}" if i % 9 else None, i, f"m{i}", "episodic", f"text {i}", [float(v) for v in e], float(i)) for i, e in enumerate(x)]
    mem = spark.createDataFrame(rows, "scope_id string, seq long, id string, type string, content string, embedding array<float>, created_at double")

    def members():
        return sorted(map(tuple, C.consolidate_members(mem, 9.0, threshold=0.95)[1].select("scope_id", "semantic_id", "member").collect()), key=str)
    whole = members()
    freed = []
    monkeypatch.setattr(V, "free_disk", lambda spark, *folders: freed.append(folders))
    for name, value in (("LEAST_ROWS", 16), ("SORTED_AT_ONCE", 1024), ("SIDE_BYTES", 16 << 10), ("LEAST_SIDE", 4 << 10), ("TURN_BYTES", 1 << 15)):
        monkeypatch.setattr(V, name, value)
    assert members() == whole and len(whole) > 120
    assert sum(not f for f in freed) > 1
