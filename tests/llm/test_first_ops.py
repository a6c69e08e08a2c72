"""Operators 1, 3, 4, 6 against brute force on small fixtures."""
import numpy as np
import pytest
import xxhash

from sparkmem.llm import sharding as S
from sparkmem.llm import simhash as SH
from sparkmem.llm import token_counts as T
from sparkmem.llm.chat import format_preferences
from sparkmem.llm.common import components, span_hash, words
from sparkmem.llm.queries import QUERIES, tokenizer_path

ODD = ["", None, " ", "a", "a", "Ünïcode  wörd\n\n x", "x" * 3000, "the end <|endoftext|> of <|endoftext|>", "12 34'll it's",
       " tab\tnew ", "汉字 and 漢字", "end  ", "A b C d E f"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "id long, text string, chunk string")


def test_best_fit_takes_the_tightest_bin():
    plan, n = S.best_fit_decreasing([(6, 1), (5, 2), (4, 1), (3, 1), (1, 1)], 10)
    room = {}
    for size, a, z, b in plan:
        room[b] = room.get(b, 0) + size * (z - a)
    assert n == 3 and max(room.values()) <= 10 and sum(room.values()) == 24


def test_pack_into_is_even_and_splits_nothing():
    rng = np.random.default_rng(1)
    hist = {}
    for s in rng.integers(8, 900, 4000):
        hist[int(s)] = hist.get(int(s), 0) + 1
    hist[500_000] = 1                                   # a group above the mean
    plan = S.pack_into(list(hist.items()), 24)
    got, load = {}, [0] * 24
    for s, a, z, b in plan:
        got.setdefault(s, []).extend(range(a, z))
        load[b] += s * (z - a)
    assert {s: sorted(r) for s, r in got.items()} == {s: list(range(c)) for s, c in hist.items()}
    rest = sorted(load)[:-1]
    assert max(load) == 500_000 and max(rest) - min(rest) <= 900


def test_shard_contract(spark, odd):
    rows = S.document_rows(odd.withColumnRenamed("id", "doc_id").unionAll(odd.withColumnRenamed("id", "doc_id").limit(3)))
    out = S.shard(rows, n_shards=4).collect()
    assert len(out) == len(ODD) + 3
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.size == 8 + len((ODD[r.id] or "").encode())
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    group = {}
    for r in out:
        group.setdefault(bytes(r.group_key), set()).add(r.shard)
    assert all(len(v) == 1 for v in group.values())
    assert S.shard(rows.limit(0), n_shards=4).count() == 0
    assert {r.shard for r in S.shard(rows, capacity=4000).collect()} == {0}


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(spark, odd):
    lib = library()
    rng = np.random.default_rng(3)
    alphabet = list("ab cde'\n\t 1!é汉") + ["<|endoftext|>", "  ", " the"]
    texts = ODD + ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(50, 4000, 25)] + ["z" * 5000, " " * 5000, "word " * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    twice = spark.createDataFrame([(None, texts[-1]), (7, texts[-1]), (7, texts[-1]), (None, "a")], "id long, text string")
    assert sorted(r.n_tokens for r in T.count_tokens(twice, tokenizer_path("byte_bpe_50k.json"), 100, 24).collect()) == sorted(
        [1, *[len(lib.encode(texts[-1]))] * 3])
    got = {r.id: (r.n_bytes, r.n_tokens) for r in T.count_tokens(df, tokenizer_path("byte_bpe_50k.json"), chunk=100, overlap=24).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False))), (i, t)
    assert T.count_tokens(df.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_plain_characters_agree_with_the_library():
    lib = library()
    plain = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x180)]]
    texts = [a + b + c for a in plain for b in (" ", "a", "1", "!", "  ", "\n") for c in ("a", " b", "'s", "é")]
    assert T.count_texts(texts, tokenizer_path("byte_bpe_50k.json")) == [len(e) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_preferences(spark):
    rows = [(1, True, 0, "user", "hi"), (1, True, 1, "assistant", "yes"), (1, False, 0, "user", "hi"), (1, False, 1, "assistant", "no"),
            (1, False, 2, "user", None), (2, True, 0, None, "solo"), (3, True, 0, "user", "s"), (3, False, 0, "user", "s"),
            (None, True, 0, "user", "x"), (4, False, 1, "assistant", ""), (4, False, 1, "assistant", "")]
    out = {r.pair_id: r for r in format_preferences(spark.createDataFrame(
        rows, "pair_id long, chosen boolean, turn long, role string, text string")).collect()}
    assert set(out) == {1, 2, 3, 4}
    r = out[1]
    assert r.n_prompt_turns == 1 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    (s,) = r.chosen_spans
    assert r.chosen[s.from_char:s.to_char] == "yes<|im_end|>"
    (s,) = r.rejected_spans
    assert r.rejected[s.from_char:s.to_char] == "no<|im_end|>"
    assert out[2].chosen == "<|im_start|>unknown\nsolo<|im_end|>\n" and not out[2].has_rejected
    assert out[3].n_prompt_turns == 1 and out[3].chosen == out[3].rejected == ""
    assert len(out[4].rejected_spans) == 2 and out[4].n_prompt_turns == 0


def brute_fp(text):
    w = (text or "").encode()
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, linked):
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for a, b in linked:
        a, b = root(a), root(b)
        comp[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(spark, odd):
    base = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = ODD + base
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {r.id: (r.fp % (1 << 64), r.component_id) for r in SH.near_duplicates(df).collect()}
    fp = [brute_fp(t) for t in texts]
    n = len(fp)
    comp = brute_components(range(n), [(i, j) for i in range(n) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    assert got == {i: (fp[i], comp[i]) for i in range(n)}
    assert SH.near_duplicates(df.limit(0)).count() == 0


def test_trie_join_finds_every_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False))) for b in base for _ in range(6)]
    x = np.unique(np.array([*base, *near], np.uint64))
    got = {(int(i), int(j)) for a, b in SH.trie_join(x, None, 3) for i, j in zip(a, b)}
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 3}
    assert got == want
    y = np.unique(rng.permutation(near)[:150].astype(np.uint64))
    got = {(int(i), int(j)) for a, b in SH.trie_join(x, y, 3) for i, j in zip(a, b)}
    assert got == {(i, j) for i in range(len(x)) for j in range(len(y)) if int(x[i] ^ y[j]).bit_count() <= 3}


def test_components(spark):
    rng = np.random.default_rng(2)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(e, "u long, v long").repartition(5)).collect()}
    e = [x for x in e if x[0] != x[1]]
    want = brute_components({x for p in e for x in p}, e)
    assert got == want


def test_words_stop_at_row_ends():
    data = np.frombuffer(b"ab cdab  x", np.uint8)
    s, e, r = words(np.array([0, 5, 5, 10]), data)
    assert [(bytes(data[a:b]), int(k)) for a, b, k in zip(s, e, r)] == [(b"ab", 0), (b"cd", 0), (b"ab", 2), (b"x", 2)]
    h = span_hash(data, s, e)
    assert h[0] == h[2] and len(set(h.tolist())) == 3


def test_queries_registered():
    assert {"op1_sharding", "op3_token_counts", "op4_preference_format", "op6_simhash"} <= set(QUERIES)
