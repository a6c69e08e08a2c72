"""Operator 7, benchmark decontamination by projected TF-IDF retrieval.

1. Terms are the benchmark's words; their document frequencies are counted over all passages (windows of
   ``PASSAGE`` words, half overlapping) of the corpus.
2. A randomised SVD of the TF-IDF passages gives the latent space. Benchmark passages enter with a weight
   beyond any corpus direction, so their span is part of the leading subspace whatever the corpus; the
   remaining ``RANK`` directions are the leading ones of the corpus passages with that span deflated, from
   one distributed pass: Y = (I - P) A'A (I - P) G for a Gaussian G, summed term by term over all
   tasks, and the Nystrom form of the randomised SVD on the small sketch. These directions are orthogonal to every
   benchmark passage: they lengthen corpus passages only, so paraphrases in other words are not retrieved.
3. Every corpus passage is folded into the latent space; passages of cosine >= ``COSINE`` to a benchmark passage
   are candidates, and so are passages that hold ``COVERED`` of its distinct words. Every term has a positive weight, and
   the share of covered words knows no weights, so that the copies of an item can't hide it however many they are.
4. A candidate is checked on the words around it: the longest common subsequence with the item (bit
   parallel) and with the item's answer (what follows its last "answer:" mark, or its last sentence).
   An item is found when ``NEAR`` of its words stand there in order, or ``PARAPHRASE`` of them together with
   ``ANSWER`` of its answer, in any of the places; the best of those that pass is reported.
   Of an item longer than a passage, ``NEAR`` of the words of a passage are enough, too: ``lcs_share`` is then the share of
   the passage. Items of fewer than ``LEAST_WORDS`` words, too short for the cosine, are found as exact word sequences.

The benchmark is taken in groups of ``GROUP`` passages, so the matrices a task holds are bounded (at most
GROUP * PASSAGE terms by GROUP + RANK columns); its total size is checked against ``MOST_BENCHMARK`` bytes.

Nulls and odd input: null or empty texts and items match nothing; repeated items are found alike, repeated rows give
repeated results; an empty corpus or benchmark gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_conf, lean, mix64, row_slices, span_hash, utf8, words, written

PASSAGE = 64
STRIDE = PASSAGE // 2
RANK = 48
OVERSAMPLE = 8
GROUP = 256
COSINE = 0.6
NEAR = 0.8
PARAPHRASE = 0.6
ANSWER = 0.8
LEAST_WORDS = 5
COVERED = 0.6              # share of a benchmark passage's distinct words that makes a candidate by itself
MOST_BENCHMARK = 64 << 20

_GAPS = np.zeros(256, bool)
_GAPS[[c for c in range(128) if not chr(c).isalnum()]] = True


def _lowered(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(col if not isinstance(col, pa.ChunkedArray) else col.combine_chunks()))


def _hashed(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text."""
    off, data = _lowered(pa.array(texts, pa.string()))
    s, e, r = words(off, data, _GAPS)
    h = span_hash(data, s, e)
    return np.split(h, np.searchsorted(r, np.arange(1, len(texts)))) if texts else []


def answer_of(text: str | None) -> str:
    """What follows the last answer mark, or else the last sentence with three words or more."""
    text = text or ""
    mark = list(re.finditer(r"\b(?:answer|a)\s*:", text, re.I))
    if mark and text[mark[-1].end():].strip():
        return text[mark[-1].end():]
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text) if len(p.split()) >= 3]
    return parts[-1] if parts else text


def windows(n: int) -> list[tuple[int, int]]:
    """Word ranges of the passages of a text of n words."""
    return [(a, min(n, a + PASSAGE)) for a in range(0, max(1, n - STRIDE), STRIDE)] if n else []


def _passages(count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, one past the last) of all passages of texts with ``count`` words from word ``first`` on."""
    n = np.where(count > 0, np.maximum(1, -(-(count - STRIDE) // STRIDE)), 0)
    text = np.repeat(np.arange(len(count)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    lo = first[text] + k * STRIDE
    return text, lo, np.minimum(lo + PASSAGE, first[text] + count[text])


class Terms:
    """Sorted hashes of the benchmark's words."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def _to_ids(hashes: np.ndarray, kind: str):
    """Texts as term numbers (-1: none), one per word: what the passes below read, so that texts are tokenised once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(hashes)
        for b in batches:
            off, data = _lowered(b.column(0))
            for lo, hi in row_slices(off):
                o, d = off[lo:hi + 1] - off[lo], data[off[lo]:off[hi]]
                s, e, r = words(o, d, _GAPS)
                ids = terms.ids(span_hash(d, s, e)).astype(kind)
                cut = np.searchsorted(r, np.arange(hi - lo + 1)) * ids.itemsize
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).slice(lo, hi - lo), pa.array([raw[x:z] for x, z in zip(cut[:-1], cut[1:])], pa.binary())], ["id", "words"])
    return run


def _slices(col: pa.Array, kind: str, most: int = 1 << 18):
    """(first row, term number of every word, words per text, passages) of slices of a batch of texts."""
    size = np.dtype(kind).itemsize
    raw = col.to_pylist()
    count = np.array([len(x) // size for x in raw], np.int64)
    for lo, hi in row_slices(np.concatenate([[0], np.cumsum(count)]), most):
        ids = np.frombuffer(b"".join(raw[lo:hi]), kind).astype(np.int64)
        n = count[lo:hi]
        yield lo, ids, n, _passages(n, np.cumsum(n) - n)


def _entries(ids: np.ndarray, p_lo: np.ndarray, p_hi: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (passage, term, times) with a known term."""
    hit = np.flatnonzero(ids >= 0)
    a, z = np.searchsorted(hit, p_lo), np.searchsorted(hit, p_hi)
    from .common import clustered_ranges
    at = hit[clustered_ranges(a, z)]
    p = np.repeat(np.arange(len(p_lo)), z - a)
    key, times = np.unique(p * n_terms + ids[at], return_counts=True)
    return key // n_terms, key % n_terms, times


def _count_terms(n: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(n, np.int64), 0
        for b in batches:
            for _, ids, _, (_, lo, hi) in _slices(b.column(0), kind):
                _, t, _ = _entries(ids, lo, hi, n)
                df += np.bincount(t, minlength=n)
                total += len(lo)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n)), pa.array(np.append(total, df))], ["term", "n"])
    return run


def _pieces(p: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of entries of about ``most`` each that hold whole passages (p ascending): small enough for the CPU's cache."""
    cuts, at = [0], 0
    while at < len(p):
        at = min(len(p), at + most)
        if at < len(p):
            at = int(np.searchsorted(p, p[at - 1], side="right"))
        cuts.append(at)
    return list(zip(cuts[:-1], cuts[1:]))


def _sketch(n: int, kind: str, idf: np.ndarray, groups: list[np.ndarray]):
    """Rows (group, term, sums) of A'A G over the passages of a task; groups: (I - P) G of each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # idf is put into the start vectors and the sums, the passage's length into its row: of a passage's entries
        # only those of repeated terms need a factor of their own
        start = [(g * idf[:, None]).astype(np.float32) for g in groups]
        y = [np.zeros((n, g.shape[1])) for g in groups]
        for b in batches:
            for _, ids, _, (_, lo, hi) in _slices(b.column(0), kind):
                p, t, times = _entries(ids, lo, hi, n)
                if not len(p):
                    continue
                tf = (1 + np.log(times)).astype(np.float32)
                w = tf * idf[t]
                norm2 = np.bincount(p, w * w, minlength=len(lo))
                for x, z in _pieces(p, 4096):
                    pp, tt, ff = p[x:z], t[x:z], tf[x:z]
                    new = np.append(True, pp[1:] != pp[:-1])
                    row = np.cumsum(new) - 1
                    at_p = np.flatnonzero(new)
                    inv = (1.0 / norm2[pp[at_p]]).astype(np.float32)[:, None]
                    order = np.argsort(tt, kind="stable")
                    to, ro, fo = tt[order], row[order], ff[order]
                    at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                    more, more_o = np.flatnonzero(ff > 1), np.flatnonzero(fo > 1)
                    for g, acc in zip(start, y):
                        f = g[tt]
                        f[more] *= ff[more, None]
                        f = (np.add.reduceat(f, at_p, axis=0) * inv)[ro]
                        f[more_o] *= fo[more_o, None]
                        acc[to[at]] += np.add.reduceat(f, at, axis=0)
        y = [acc * idf[:, None] for acc in y]
        for k, acc in enumerate(y):
            some = np.flatnonzero(np.abs(acc).sum(axis=1) > 0)
            for lo in range(0, len(some), 4096):
                part = some[lo:lo + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), k, np.int32)), pa.array(part.astype(np.int32)),
                     pa.array([acc[i].astype("<f4").tobytes() for i in part], pa.binary())], ["g", "term", "y"])
    return run


def _add_up(key, pdf):
    import pandas as pd
    y = np.zeros(len(pdf["y"].iloc[0]) // 4)
    for x in pdf["y"]:
        y += np.frombuffer(x, "<f4")
    return pd.DataFrame({"g": [key[0]], "term": [key[1]], "y": [y.astype("<f8").tobytes()]})


def lcs(masks: dict[int, int], n: int, seq: list[int]) -> int:
    """Length of the longest common subsequence of a sequence and a pattern of n given as position masks per symbol."""
    v = full = (1 << n) - 1
    for s in seq:
        m = masks.get(s)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _masks(ids: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, t in enumerate(ids.tolist()):
        out[t] = out.get(t, 0) | 1 << k
    return out


def evidence(ids: np.ndarray, spots: list[tuple], begin: int, end: int, masks: dict[int, int], size: int,
             a_masks: dict[int, int], a_size: int, whole: bool = True) -> tuple[int, float, float] | None:
    """(LCS, its share, the answer's share) of the best place around the spots of a document that holds the item, or None.

    Not ``whole``: masks and size are of a passage of the item, for which the answer is no evidence.
    """
    best = None
    done = -1
    for x, z, *_ in sorted(spots):
        x, z = max(begin, x - size), min(end, z + size)
        if z <= done:
            continue
        # words around the passage, in steps that hold the item whole
        for s in range(x, max(x + 1, z - size), max(1, size // 2)):
            seq = ids[s:min(z, s + 2 * size)]
            seq = seq[seq >= 0].tolist()
            k = lcs(masks, size, seq)
            if k / size < PARAPHRASE:
                continue
            here = (k, k / size, lcs(a_masks, a_size, seq) / max(1, a_size))
            if (here[1] >= NEAR or whole and here[2] >= ANSWER) and (best is None or here > best):
                best = here
        done = z
    return best


def passage_evidence(ids: np.ndarray, spots: list[tuple], begin: int, end: int, item: np.ndarray, a_masks: dict[int, int],
                     a_size: int) -> tuple[int, float, float] | None:
    """The same for the passages of an item; the last of each spot is the first word of the benchmark passage retrieved.

    The stretch that was copied may begin anywhere, so the passages between the retrieved one and its neighbours count, too.
    """
    best = None
    tried = set()
    for spot in spots:
        for a in range(max(0, spot[-1] - STRIDE), min(len(item) - PASSAGE, spot[-1] + STRIDE) + 1, STRIDE // 4):
            if (a, spot[0]) not in tried:
                tried.add((a, spot[0]))
                part = item[a:a + PASSAGE]
                here = evidence(ids, [spot], begin, end, _masks(part), len(part), a_masks, a_size, whole=False)
                if here and (best is None or here > best):
                    best = here
    return best


def _sequence_keys(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    key = np.zeros(len(at), np.uint64)
    for k in range(n):
        key = mix64(key * np.uint64(3) + ids[at + k].astype(np.uint64) + np.uint64(1))
    return key


class Sequences:
    """Items of a few words, looked up as exact sequences of words."""

    def __init__(self, items: list[np.ndarray]):
        self.of: dict[tuple, list[int]] = {}
        for m, w in enumerate(items):
            if 0 < len(w) < LEAST_WORDS:
                self.of.setdefault(tuple(w.tolist()), []).append(m)
        self.keys = {}
        for n in {len(w) for w in self.of}:
            self.keys[n] = np.unique(np.concatenate([_sequence_keys(np.array(w), np.array([0]), n) for w in self.of if len(w) == n]))

    def find(self, ids: np.ndarray, count: np.ndarray):
        """(text, item) of every text that holds an item."""
        last = np.repeat(np.cumsum(count), count)       # one past the last word of each word's text
        text = np.repeat(np.arange(len(count)), count)
        out = set()
        for n, keys in self.keys.items():
            at = np.flatnonzero((np.arange(len(ids)) + n <= last) & (ids >= 0))
            key = _sequence_keys(ids, at, n)
            hit = np.isin(key, keys)
            # one place for each text and key
            _, one = np.unique(np.stack([text[at[hit]].astype(np.uint64), key[hit]]), axis=1, return_index=True)
            for p in at[hit][one].tolist():
                out.update((int(text[p]), m) for m in self.of.get(tuple(ids[p:p + n].tolist()), ()))
        return sorted(out)


def _search(hashes, kind: str, items: list[tuple[int, np.ndarray, np.ndarray]], passages: list[tuple[int, int]], groups):
    """items: (item id, word hashes, answer's word hashes); passages: (item, first word); groups: (weights of terms (terms x r),
    folded benchmark passages (m x r), the number of each, which terms each holds (terms x m))."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(hashes)
        n = len(terms.hashes)
        checks = []
        item_ids = [terms.ids(w) for _, w, _ in items]
        short = Sequences(item_ids)
        for wi, (_, _, a) in zip(item_ids, items):
            ai = terms.ids(a)
            checks.append((_masks(wi), len(wi), _masks(ai), len(ai)))
        out: list[tuple] = []
        used = [weight.any(axis=1) | has.any(axis=1) for weight, _, _, has in groups]
        needs = [np.ceil(COVERED * has.sum(axis=0) - 1e-9) for _, _, _, has in groups]
        for b in batches:
            doc_ids = b.column(1).to_pylist()
            for row0, ids, count, (text, lo, hi) in _slices(b.column(0), kind):
                first = np.cumsum(count) - count
                p, t, times = _entries(ids, lo, hi, n)
                tf = (1 + np.log(times)).astype(np.float32)
                found: dict[tuple[int, int], list] = {}
                for (weight, folded, owner, has), known, need in zip(groups, used, needs):
                    use = np.flatnonzero(known[t])
                    for x, z in _pieces(p[use], 2048):
                        cut = use[x:z]
                        pp = p[cut]
                        at = np.flatnonzero(np.append(True, pp[1:] != pp[:-1]))
                        vec = weight[t[cut]]
                        more = np.flatnonzero(times[cut] > 1)
                        vec[more] *= tf[cut[more], None]
                        vec = np.add.reduceat(vec, at, axis=0)
                        norm = np.sqrt(np.einsum("ij,ij->i", vec, vec))
                        cos = (vec @ folded.T) / np.maximum(norm, 1e-9)[:, None]
                        held = np.add.reduceat(has[t[cut]], at, axis=0, dtype=np.uint8)      # at most PASSAGE words each
                        i, j = np.nonzero((cos >= COSINE) | (held >= need))
                        for q, m, c in zip(pp[at[i]].tolist(), owner[j].tolist(), cos[i, j].tolist()):
                            found.setdefault((int(text[q]), passages[m][0]), []).append((int(lo[q]), int(hi[q]), c, passages[m][1]))
                for (d, m), spots in found.items():
                    masks, size, a_masks, a_size = checks[m]
                    begin, end = int(first[d]), int(first[d] + count[d])
                    best = evidence(ids, spots, begin, end, masks, size, a_masks, a_size)
                    if best is None and size > PASSAGE:
                        best = passage_evidence(ids, spots, begin, end, item_ids[m], a_masks, a_size)
                    if best:
                        out.append((doc_ids[row0 + d], items[m][0], max(c for _, _, c, _ in spots), *best))
                for d, m in short.find(ids, count):
                    out.append((doc_ids[row0 + d], items[m][0], 1.0, checks[m][1], 1.0, float(checks[m][3] > 0)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, ty) for c, ty in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64()))],
                    ["id", "item_id", "cosine", "lcs", "lcs_share", "answer_share"])
                out = []
    return run


RESULT = "id long, item_id long, cosine double, lcs int, lcs_share double, answer_share double"


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Orthonormal basis of the columns (directions of negligible length left out)."""
    if not x.size:
        return x[:, :0]
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, s > 1e-6 * max(s.max(), 1e-12)]


def latent_groups(ids: DataFrame, kind: str, idf: np.ndarray, passages: list[np.ndarray]):
    """Latent space of each group of benchmark passages (term ids of each): what ``_search`` needs."""
    n = len(idf)
    rng = np.random.default_rng(11)
    groups = [passages[i:i + GROUP] for i in range(0, len(passages), GROUP)]
    mats, bases, starts = [], [], []
    for g in groups:
        b = np.zeros((len(g), n))
        for k, t in enumerate(g):
            term, times = np.unique(t, return_counts=True)
            b[k, term] = (1 + np.log(times)) * idf[term]
        b /= np.maximum(np.linalg.norm(b, axis=1), 1e-12)[:, None]
        q = _orthonormal(b.T)
        start = rng.normal(size=(n, RANK + OVERSAMPLE))
        mats.append(b)
        bases.append(q)
        starts.append(start - q @ (q.T @ start))
    rows = (ids.select("words").mapInArrow(lean(_sketch(n, kind, idf, starts)), "g int, term int, y binary")
            .groupBy("g", "term").applyInPandas(_add_up, "g int, term int, y binary"))
    ys = [np.zeros_like(s) for s in starts]
    for r in written(rows, "latent-sketch").collect():      # bounded: terms of the benchmark x columns of the sketch
        ys[r["g"]][r["term"]] = np.frombuffer(bytes(r["y"]), "<f8")
    out = []
    for k, (g, b, q, start, y) in enumerate(zip(groups, mats, bases, starts, ys)):
        y = y - q @ (q.T @ y)
        core = start.T @ y
        core = (core + core.T) / 2
        val, vec = np.linalg.eigh(core)
        good = val > 1e-9 * max(val.max(initial=0.0), 1e-12)
        factor = y @ (vec[:, good] / np.sqrt(val[good]))    # Nystrom: A'A is near factor @ factor.T
        u, s, _ = np.linalg.svd(factor, full_matrices=False) if factor.size else (factor, np.zeros(0), None)
        v = np.concatenate([q, u[:, :RANK][:, s[:RANK] > 1e-9]], axis=1)
        weight = (v * idf[:, None]).astype(np.float32)
        folded = b @ v
        folded /= np.maximum(np.linalg.norm(folded, axis=1), 1e-12)[:, None]
        out.append((weight, folded.astype(np.float32), k * GROUP + np.arange(len(g)), (b.T > 0).astype(np.uint8)))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(id, item_id, cosine, lcs, lcs_share, answer_share) of documents (id, text) that hold benchmark items (item_id, text)."""
    spark = docs.sparkSession
    arrow_conf(spark)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_BENCHMARK:
        raise ValueError(f"the benchmark has {size} bytes, more than {MOST_BENCHMARK}; give it in parts")
    rows = benchmark.where("text is not null").select("item_id", "text").orderBy("item_id", "text").collect()
    hashed = _hashed([r["text"] for r in rows])
    items = [(r["item_id"], h, a) for r, h, a in zip(rows, hashed, _hashed([answer_of(r["text"]) for r in rows])) if len(h)]
    if not items:
        return spark.createDataFrame([], RESULT)
    hashes = np.unique(np.concatenate([h for _, h, _ in items]))
    kind = "<i2" if len(hashes) < 1 << 15 else "<i4"
    ids = written(docs.select("text", "id").mapInArrow(lean(_to_ids(hashes, kind)), "id long, words binary"), "latent-words")
    counts = written(ids.select("words").mapInArrow(lean(_count_terms(len(hashes), kind)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")),
                     "latent-terms").collect()              # bounded: one row per term of the benchmark
    df = np.zeros(len(hashes))
    total = 0
    for r in counts:
        if r["term"] < 0:
            total = r["n"]
        else:
            df[r["term"]] = r["n"]
    idf = np.log((total + 1) / (df + 1)) + 0.01
    passages = [(m, a, z) for m, (_, h, _) in enumerate(items) if len(h) >= LEAST_WORDS for a, z in windows(len(h))]
    groups = latent_groups(ids, kind, idf, [np.searchsorted(hashes, items[m][1][a:z]) for m, a, z in passages])
    return ids.select("words", "id").mapInArrow(lean(_search(hashes, kind, items, [x[:2] for x in passages], groups)), RESULT)
