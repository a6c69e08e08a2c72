"""Operator 9, language-model scoring by a hierarchical Pitman-Yor model.

Restaurants: one per context (the whole previous word, by 64-bit hash), whose parents are the restaurants of its class
(16 bits: a hash of its last two bytes, and 8 bits of its own hash), whose parents are those of the class's high byte alone,
whose parent is the root; the root's base is uniform over the V known words and one unknown. A dish w in a restaurant
with n customers at t tables is served with

    P(w) = (n - d t + (theta + d T) P_parent(w)) / (theta + N)

(N, T: customers and tables of the restaurant), and every table of a restaurant is a customer of its parent. Table counts are
sampled by blocked Gibbs: given the parent's P(w), the number of tables of a dish is drawn from its exact conditional

    p(t | n) ~ S_d(n, t) * prod_{j<t} (theta + d (T + j)) * P_parent(w)^t

(S_d: generalised Stirling numbers, tabulated up to ``EXACT``; customers beyond that are seated after them one by one, in
blocks that grow with n). Probabilities are averaged over the samples after burn-in.

Data flow: texts are counted in blocks; (word, context, count) lists go to buckets by word (all restaurants' data on a word
lie in one bucket, merged in a tree where there are many blocks). Only the restaurants' totals N and T cross buckets, and they
are updated between rounds of sweeps: those of classes are vectors of 65,536 numbers, whatever the corpus; those of whole-word
contexts, which grow with it, are summed in buckets by context, and each bucket of words gets back the totals of the contexts
it holds. For scoring, each block sends its words with context and document to the buckets and gets sums per document back;
a bucket crowded by a frequent word is split by block. A pair of word and context that was not learned goes on to the bucket
of its context, for the weight with which that context hands down to its class. Scoring goes by turns, each with a range of the
buckets: only one turn's models and words are on disk at a time, and a turn leaves one row of sums per block.

Nulls and odd input: a null or empty text is the end token alone; repeated rows get repeated results; an empty table gives an
empty result; without training documents every token has the base's uniform share; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_conf, block_numbers, folder_of, free_disk, lean, lower_ascii, mix64, return_freed_memory, row_slices, span_hash, utf8, words, written

BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
MERGE = 256                # lists merged at once in one task
SPLIT_TOKENS = 8_000_000   # scored tokens of a bucket above which it is split by block
ROUNDS = 2                 # rounds of sweeps after which the restaurants' totals are updated
SWEEPS = 3                 # sweeps in each of them
BURN_IN, SAMPLES = 2, 4    # sweeps of the last round
TURNS = 3                  # ranges of buckets scored one after another
EXACT = 128
THETA = (1.0, 1.0, 1.0, 1.0)   # concentration of root, middle, class and context restaurants
CONTEXTS = 1 << 16         # classes of contexts
SEGMENT = 1 << 13          # numbers of the classes' totals summed in one task
END = np.uint64(0x456E64)  # the end token's hash
START = np.uint64(0x537461)


# --------------------------------------------------------------------------
# Tokens of a block
# --------------------------------------------------------------------------
def tokens(offsets: np.ndarray, data: np.ndarray):
    """(word hash, context, row) of all tokens, each row's end token included."""
    n = len(offsets) - 1
    low = lower_ascii(data)
    s, e, r = words(offsets, low)
    h = span_hash(low, s, e)
    tail = low[np.maximum(e - 1, 0)].astype(np.uint64) if len(e) else np.zeros(0, np.uint64)
    prev = np.where(e - s > 1, low[np.maximum(e - 2, 0)], 0).astype(np.uint64) if len(e) else tail
    # context that a word sets for the next: itself, over its class of 8 bits of its last two bytes and 8 bits of itself
    ctx = (h << np.uint64(16)) | ((mix64(tail * np.uint64(257) + prev) >> np.uint64(56)) << np.uint64(8)) | (h >> np.uint64(56))
    count = np.bincount(r, minlength=n)
    at = np.arange(len(h)) + r                  # an end token stands after each row's words
    size = len(h) + n
    word = np.full(size, END, np.uint64)
    word[at] = h
    row = np.empty(size, np.int64)
    row[at] = r
    ends = np.cumsum(count + 1) - 1
    row[ends] = np.arange(n)
    context = np.full(size, START << np.uint64(16) | START & np.uint64(0xFFFF), np.uint64)
    if len(h):
        context[at + 1] = ctx
    return word, context, row


def _blocks(batches: Iterator[pa.RecordBatch]):
    """(ids with their null flags, held-out flags, word, context, row, tokens per row) of blocks of batches (text, id, held_out)."""
    ids, held, parts, size, base = [], [], [], 0, 0

    def out():
        w, c, r = (np.concatenate(x) for x in zip(*parts))
        return np.concatenate(ids, axis=1), np.concatenate(held), w, c, r, np.bincount(r, minlength=base)

    for b in batches:
        off, data = utf8(b.column(0))
        for lo, hi in row_slices(off):
            w, c, r = tokens(off[lo:hi + 1] - off[lo], data[off[lo]:off[hi]])
            parts.append((w, c, r + base))
            own = b.column(1).slice(lo, hi - lo)            # integers stay integers beside a null
            ids.append(np.stack([pc.fill_null(own, 0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False).astype(np.int64)]))
            held.append(b.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool))
            base += hi - lo
            size += int(off[hi] - off[lo])
            if size >= BLOCK_BYTES:
                yield out()
                ids, held, parts, size, base = [], [], [], 0, 0
    if parts:
        yield out()


def _z(*arrays: np.ndarray) -> bytes:
    import zstandard
    raw = b"".join(len(a).to_bytes(8, "little") + a.dtype.str.encode().ljust(4) + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unz(blob: bytes) -> list[np.ndarray]:
    import zstandard
    raw, out, i = zstandard.ZstdDecompressor().decompress(blob), [], 0
    while i < len(raw):
        n, kind = int.from_bytes(raw[i:i + 8], "little"), raw[i + 8:i + 12].decode().strip()
        a = np.frombuffer(raw, kind, n, i + 12)
        out.append(a)
        i += 12 + a.nbytes
    return out


def _bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(word ^ np.uint64(0x5151)) % np.uint64(buckets)).astype(np.int64)


def _order(x: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers from 0 on: sorted with their positions in the low bits, where the leading bits tell them apart."""
    low = np.uint64((1 << len(x).bit_length()) - 1)
    lead = x.astype(np.uint64) << np.uint64(min(63, 64 - int(x.max(initial=0)).bit_length()))
    packed = (lead & ~low) | np.arange(len(x), dtype=np.uint64)
    packed.sort()
    order = (packed & low).astype(np.int64)
    ordered = x[order]
    return order if (ordered[1:] >= ordered[:-1]).all() else np.argsort(x, kind="stable")


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the number of each value among them."""
    order = _order(x)
    ordered = x[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[:len(x)]
    number = np.empty(len(x), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], number


def _grouped(word, context):
    """Order and cuts of tokens by (word, context): (order, starts of distinct entries)."""
    contexts, c = _ranked(context)
    both = _ranked(word)[1] * max(len(contexts), 1) + c
    order = _order(both)
    both = both[order]
    return order, np.flatnonzero(np.append(True, both[1:] != both[:-1])[:len(both)])


def _counted(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct combinations of whole numbers from 0 on, in order (the first key counts most), and how often each occurs."""
    bits = [int(k.max(initial=0)).bit_length() for k in keys]
    if sum(bits) > 63:
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        first = np.flatnonzero(new)
        return [k[first] for k in keys], np.diff(np.append(first, len(order)))
    packed = np.zeros(len(keys[0]), np.int64)
    for k, b in zip(keys, bits):
        packed = packed << b | k
    packed.sort()
    first = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.zeros(0, np.int64)
    times, packed, out = np.diff(np.append(first, len(packed))), packed[first], []
    for b in bits[::-1]:
        out.append(packed & ((1 << b) - 1))
        packed = packed >> b
    return out[::-1], times


def _dealt(word, context, buckets: int, *more):
    """Tokens counted by (bucket, word, context, *more): (words, contexts, their columns in that order, times, cuts between the buckets)."""
    words, w = _ranked(word)
    contexts, c = _ranked(context)
    to = _bucket(words, buckets)
    by = np.argsort(to, kind="stable")          # by bucket, then by word
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    (w, c, *more), times = _counted(rank[w], c, *more)
    cut = np.searchsorted(to[by][w], np.arange(buckets + 1))
    return words[by][w], contexts[c], more, times, cut


def _class(context: np.ndarray) -> np.ndarray:
    return (context & np.uint64(0xFFFF)).astype(np.int64)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the number of each value among them."""
    uniq, at = _ranked(x.astype("<u8"))
    return uniq, at.astype("<u1" if len(uniq) <= 1 << 8 else "<u2" if len(uniq) <= 1 << 16 else "<u4")


def _pack_pairs(word, context, count) -> bytes:
    """Pairs sorted by (word, context): distinct words, pairs of each, distinct contexts, their numbers, counts."""
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
    per = np.diff(np.append(first, len(word))).astype("<u4")
    return _z(word[first].astype("<u8"), per, *_numbered(context), count.astype("<u4" if count.max(initial=0) < 2**32 else "<u8"))


def _unpack_pairs(blob: bytes):
    w, per, c, at, n = _unz(blob)
    return np.repeat(w, per), c[at], n


def _part(block: int, parts: int) -> int:
    return int(mix64(np.array([block], np.uint64))[0] % np.uint64(parts))


def _send_counts(buckets: int, fan: int):
    """Training counts of each block: rows (bucket, part, pairs)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (_, held, w, c, r, _) in zip(block_numbers(), _blocks(batches)):
            part = _part(number, fan)
            train = ~held[r]
            w, c, _, count, cut = _dealt(w[train], c[train], buckets)
            for k in np.flatnonzero(np.diff(cut)):
                s = slice(cut[k], cut[k + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(k)], pa.int32()), pa.array([part], pa.int32()), pa.array([_pack_pairs(w[s], c[s], count[s])], pa.binary())],
                    ["bucket", "part", "pairs"])
    return run


def _merge(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, c, n = (np.concatenate(x) for x in zip(*map(_unpack_pairs, blobs)))
    order, first = _grouped(w, c)
    total = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return w[order][first], c[order][first], total


def _merge_group(fan: int):
    def run(key, pdf):
        import pandas as pd
        return pd.DataFrame({"bucket": [key[0]], "part": [key[1] % fan], "pairs": [_pack_pairs(*_merge(pdf["pairs"]))]})
    return run


# --------------------------------------------------------------------------
# Restaurants
# --------------------------------------------------------------------------
@functools.lru_cache(maxsize=8)
def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(n, t) for n, t up to ``most``: S(n + 1, t) = (n - d t) S(n, t) + S(n, t - 1)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(most):
            stay = out[n, 1:] + np.log(np.maximum(n - d * t, 0))
            out[n + 1, 1:] = np.logaddexp(stay, out[n, :-1])
    return out


def draw_tables(n: np.ndarray, parent: np.ndarray, big_t: np.ndarray, d: float, theta: float, log_s: np.ndarray, rng) -> np.ndarray:
    """Tables of dishes with n customers each, given the parent's probability and the restaurant's tables of other dishes."""
    t = np.ones(len(n), np.int64)
    some = np.flatnonzero(n > 1)
    if not len(some):
        return t
    m = np.minimum(n[some], EXACT)
    by = np.argsort(m, kind="stable")
    sizes, first = np.unique(m[by], return_index=True)
    for size, group in zip(sizes.tolist(), np.split(some[by], first[1:])):
        for lo in range(0, len(group), max(1, (1 << 20) // size)):
            g = group[lo:lo + max(1, (1 << 20) // size)]
            room = np.log(theta + d * (big_t[g][:, None] + np.arange(size)))
            logit = log_s[size, 1:size + 1] + np.cumsum(room, axis=1) + np.log(parent[g])[:, None] * np.arange(1, size + 1)
            logit -= logit.max(axis=1, keepdims=True)
            p = np.cumsum(np.exp(logit), axis=1)
            t[g] = 1 + (p < (rng.random(len(g)) * p[:, -1])[:, None]).sum(axis=1)
    rest = some[n[some] > EXACT]
    seated = np.full(len(rest), EXACT, np.int64)
    while len(rest):
        block = np.minimum(np.maximum(1, seated // 8), n[rest] - seated)
        new = (theta + d * (big_t[rest] + t[rest])) * parent[rest]
        t[rest] += rng.binomial(block, np.clip(new / (new + seated - d * t[rest]), 0, 1))
        seated += block
        go = seated < n[rest]
        rest, seated = rest[go], seated[go]
    return t


class Totals:
    """What crosses buckets: customers and tables of the restaurants, discounts and sizes."""

    def __init__(self, n2, t2, t1, t0, d, v, n_tokens):
        self.n2, self.t2 = n2, t2               # classes
        self.n1 = t2.reshape(256, 256).sum(axis=1)
        self.t1 = t1                            # high bytes
        self.n0, self.t0 = float(t1.sum()), t0  # root
        self.d, self.v, self.n_tokens = d, v, n_tokens


class Restaurants:
    """The seating of one bucket's words."""

    def __init__(self, word, context, count, totals: Totals, seed: int):
        self.tot, self.rng = totals, np.random.default_rng(seed)
        self.words, self.w = _ranked(word)
        self.k2, self.n2 = context.astype(np.int64), count
        key1 = self.w * 256 + (self.k2 >> 8)
        self.mid, self.to1 = _ranked(key1)
        self.w1, self.k1 = self.mid // 256, self.mid % 256
        self.log_s = [stirling(x) for x in totals.d]
        self.t2 = np.ones(len(count), np.int64)
        self.t1 = np.ones(len(self.mid), np.int64)
        self.t0 = np.ones(len(self.words), np.int64)
        self.n1 = np.bincount(self.to1, self.t2, minlength=len(self.mid)).astype(np.int64)
        self.n0 = np.bincount(self.w1, self.t1, minlength=len(self.words)).astype(np.int64)

    def probabilities(self):
        """(context, middle, root) probabilities of the seated dishes."""
        q, d = self.tot, self.tot.d
        p0 = (self.n0 - d[0] * self.t0 + (THETA[0] + d[0] * q.t0) / (q.v + 1)) / (THETA[0] + q.n0)
        p1 = (self.n1 - d[1] * self.t1 + (THETA[1] + d[1] * q.t1[self.k1]) * p0[self.w1]) / (THETA[1] + q.n1[self.k1])
        p2 = (self.n2 - d[2] * self.t2 + (THETA[2] + d[2] * q.t2[self.k2]) * p1[self.to1]) / (THETA[2] + q.n2[self.k2])
        return p2, p1, p0

    def sweep(self) -> None:
        """Draw all tables anew, from the contexts up to the root, given the parents' present seating."""
        q, d = self.tot, self.tot.d
        p2, p1, p0 = self.probabilities()
        self.t2 = draw_tables(self.n2, p1[self.to1], np.maximum(q.t2[self.k2] - self.t2, 0), d[2], THETA[2], self.log_s[2], self.rng)
        self.n1 = np.bincount(self.to1, self.t2, minlength=len(self.mid)).astype(np.int64)
        self.t1 = draw_tables(self.n1, p0[self.w1], np.maximum(q.t1[self.k1] - self.t1, 0), d[1], THETA[1], self.log_s[1], self.rng)
        self.n0 = np.bincount(self.w1, self.t1, minlength=len(self.words)).astype(np.int64)
        base = np.full(len(self.words), 1.0 / (q.v + 1))
        self.t0 = draw_tables(self.n0, base, np.maximum(q.t0 - self.t0, 0), d[0], THETA[0], self.log_s[0], self.rng)


class Seating:
    """The seating of one bucket's words in whole-word contexts (``n_of``, ``t_of``: customers and tables of each pair's
    context); the tables of a pair are the customers that its class's restaurant has of the word."""

    def __init__(self, word, context, count, n_of, t_of, totals: Totals, seed: int):
        self.n3, self.n_of, self.t_of = count.astype(np.int64), n_of, t_of
        words, w = _ranked(word)
        own, self.to2 = _ranked(w * CONTEXTS + _class(context))
        self.t3 = np.ones(len(count), np.int64)
        self.above = Restaurants(words[own // CONTEXTS], own % CONTEXTS, self._customers(len(own)), totals, seed)
        self.d, self.log_s = totals.d[3], stirling(totals.d[3])

    def _customers(self, n: int) -> np.ndarray:
        return np.bincount(self.to2, self.t3, minlength=n).astype(np.int64)

    def probabilities(self):
        """(context, class, middle, root) probabilities of the seated dishes."""
        p2, p1, p0 = self.above.probabilities()
        p3 = (self.n3 - self.d * self.t3 + (THETA[3] + self.d * self.t_of) * p2[self.to2]) / (THETA[3] + self.n_of)
        return p3, p2, p1, p0

    def sweep(self) -> None:
        p2 = self.above.probabilities()[0]
        self.t3 = draw_tables(self.n3, p2[self.to2], np.maximum(self.t_of - self.t3, 0), self.d, THETA[3], self.log_s, self.above.rng)
        self.above.n2 = self._customers(len(p2))
        self.above.sweep()


TOTALS_SCHEMA = "part int, bucket int, totals binary"


def _state(bucket: int, buckets: int, context, at, count, t3, n2, k2, t2, k1, t1, t0: int, sizes) -> dict:
    """What a bucket has of all totals: rows (part, bucket, totals). Parts from 0 on: the contexts of a bucket of contexts, their
    customers and tables; part -1 - x: segment x of the classes' customers and tables, the middle's and the root's tables, sizes."""
    n3 = np.bincount(at, count, minlength=len(context)).astype(np.int64)
    s3 = np.bincount(at, t3, minlength=len(context)).astype(np.int64)
    to = _bucket(context, buckets)
    by = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[by], np.arange(buckets + 1))
    parts, blobs = [], []
    for k in np.flatnonzero(np.diff(cut)).tolist():
        s = by[cut[k]:cut[k + 1]]
        parts.append(k)
        blobs.append(_z(context[s], *(x[s].astype("<u4" if x.max(initial=0) < 2**32 else "<u8") for x in (n3, s3))))
    vector = np.concatenate([np.bincount(k2, n2, minlength=CONTEXTS), np.bincount(k2, t2, minlength=CONTEXTS),
                             np.bincount(k1, t1, minlength=256), [t0], np.ravel(sizes)]).astype("<i8")
    for x in range(0, len(vector), SEGMENT):
        parts.append(-1 - x // SEGMENT)
        blobs.append(_z(vector[x:x + SEGMENT]))
    return {"part": parts, "bucket": [bucket] * len(parts), "totals": blobs}


def _statistics(buckets: int):
    """The state before any sweep: one table for every dish. Sizes: words and tokens; dishes seen once and twice in
    root, middle, classes, contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w, per, context, at, n = _unz(blob)
                own, n2 = np.unique(np.repeat(np.arange(len(w)), per) * CONTEXTS + _class(context[at]), return_counts=True)
                mid, n1 = np.unique(own >> 8, return_counts=True)
                n0 = np.bincount(mid // 256, minlength=len(w))
                sizes = [[len(w), n.sum()], *([(x == 1).sum(), (x == 2).sum()] for x in (n0, n1, n2, n))]
                rows = _state(bucket, buckets, context, at, n, np.ones(len(n), np.int64), n2, own % CONTEXTS, np.ones(len(own), np.int64),
                              mid % 256, np.ones(len(mid), np.int64), len(w), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["part"], pa.int32()), pa.array(rows["bucket"], pa.int32()), pa.array(rows["totals"], pa.binary())],
                    ["part", "bucket", "totals"])
    return run


def _sum_totals(key, pdf):
    """Sums over the buckets. A part of the contexts: to each bucket the totals of what it sent, and one row (bucket -1) of all
    contexts; a segment: one row (bucket -1)."""
    import pandas as pd
    return_freed_memory()
    if key[0] < 0:
        total = 0
        for x in pdf["totals"]:
            total = total + _unz(x)[0]
        return pd.DataFrame({"part": [key[0]], "bucket": [-1], "totals": [_z(total)]})
    context, n, t = zip(*map(_unz, pdf["totals"]))
    cut = np.cumsum([0, *map(len, context)])
    uniq, inv = _ranked(np.concatenate(context))
    n, t = (np.bincount(inv, np.concatenate(x)).astype(np.int64) for x in (n, t))
    n, t = (x.astype("<u4" if x.max(initial=0) < 2**32 else "<u8") for x in (n, t))
    back = [_z(n[inv[a:z]], t[inv[a:z]]) for a, z in zip(cut[:-1], cut[1:])]
    return pd.DataFrame({"part": key[0], "bucket": [*pdf["bucket"], -1], "totals": [*back, _z(uniq, n, t)]})


def _seated(bucket: int, pairs, replies, buckets: int, totals: Totals, seed: int):
    """(words, pairs of each, contexts, their numbers, counts, seating) of a bucket, given the totals of its contexts."""
    return_freed_memory()
    w, per, context, at, n = _unz(pairs["pairs"].iloc[0])
    to = _bucket(context, buckets)
    n_of, t_of = np.zeros(len(context)), np.zeros(len(context))
    for part, blob in zip(replies["part"], replies["totals"]):
        here = np.flatnonzero(to == part)
        n_of[here], t_of[here] = _unz(blob)
    return w, per, context, at, n, Seating(np.repeat(w, per), context[at], n, n_of[at], t_of[at], totals, seed)


def _rounds(totals: Totals, round_no: int, buckets: int):
    """The state of a bucket after the sweeps of a round."""
    def run(key, pairs, replies):
        import pandas as pd
        _, _, context, at, n, s = _seated(key[0], pairs, replies, buckets, totals, key[0] * 1000 + round_no)
        for _ in range(SWEEPS):
            s.sweep()
        r = s.above
        return pd.DataFrame(_state(key[0], buckets, context, at, n, s.t3, r.n2, r.k2, r.t2, r.k1, r.t1, int(r.t0.sum()), np.zeros((5, 2))))
    return run


def _average(totals: Totals, buckets: int):
    """Averaged predictive probabilities of each bucket (in single precision: 1e-7 of each): rows (bucket, model)."""
    def run(key, pairs, replies):
        import pandas as pd
        w, per, context, at, n, s = _seated(key[0], pairs, replies, buckets, totals, key[0] * 1000 + 999)
        for _ in range(BURN_IN):
            s.sweep()
        sums = [np.zeros(len(p)) for p in s.probabilities()]
        for _ in range(SAMPLES):
            s.sweep()
            for acc, p in zip(sums, s.probabilities()):
                acc += p / SAMPLES
        p3, p2, p1, p0 = (x.astype("<f4") for x in sums)
        c = np.bincount(np.repeat(np.arange(len(w)), per), n, minlength=len(w)).astype("<i8")
        # pairs in the order of (word, context), classes in that of (word, class), middle restaurants of (word, high byte)
        return pd.DataFrame({"bucket": [key[0]], "model": [_z(w, c, p0, per, context, at, p3, p2, p1)]})
    return run


# --------------------------------------------------------------------------
# Scoring
# --------------------------------------------------------------------------
def _send_documents(buckets: int, split: dict[int, int], low: int, high: int):
    """Rows (bucket, part, block, payload): a block's words of one bucket from ``low`` to below ``high``, with context, document
    and times; bucket -1 - x, beside the range from 0: its documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (ids, held, w, c, r, n) in zip(block_numbers(), _blocks(batches)):
            rows = []
            if low == 0:
                rows = [(-1 - block % buckets, 0, _z(ids[0].astype("<i8"), ids[1].astype("<u1"), held.astype("<u1"), n.astype("<i8")))]
            to = _bucket(w, buckets)
            here = (to >= low) & (to < high)
            w, c, (r,), times, cut = _dealt(w[here], c[here], buckets, r[here])
            for k in np.flatnonzero(np.diff(cut)).tolist():
                s = slice(cut[k], cut[k + 1])
                pair = np.flatnonzero(np.append(True, (w[s][1:] != w[s][:-1]) | (c[s][1:] != c[s][:-1])))
                word = np.flatnonzero(np.append(True, w[s][pair][1:] != w[s][pair][:-1]))
                rows.append((k, _part(block, split.get(k, 1)), _z(
                    w[s][pair][word].astype("<u8"), np.diff(np.append(word, len(pair))).astype("<u4"), *_numbered(c[s][pair]),
                    np.diff(np.append(pair, cut[k + 1] - cut[k])).astype("<u4"), r[s].astype("<u4"), times[s].astype("<u4"))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int32()),
                 pa.array([block] * len(rows), pa.int64()), pa.array([x[2] for x in rows], pa.binary())], ["bucket", "part", "block", "payload"])
    return run


SUMS_SCHEMA = "block long, kind int, part int, payload binary"


def _score_bucket(totals: Totals, buckets: int):
    """Rows (block, kind, part, payload). Kind 0: documents; 1: sums per document; 2: contexts of pairs not learned."""
    def run(key, docs, models):
        import pandas as pd
        if not len(docs):
            return pd.DataFrame({"block": np.zeros(0, np.int64), "kind": np.zeros(0, np.int32), "part": np.zeros(0, np.int32), "payload": np.zeros(0, object)})
        if key[0] < 0:
            return pd.DataFrame({"block": docs["block"], "kind": 0, "part": 0, "payload": docs["payload"]})
        return_freed_memory()
        q, d = totals, totals.d
        if len(models):
            known, c_of, p0_of, per, ctx_of, at_of, p3_of, p2_of, p1_of = _unz(models["model"].iloc[0])
        else:
            known, c_of, p0_of, per, ctx_of, at_of, p3_of, p2_of, p1_of = (
                np.zeros(0, t) for t in ("<u8", "<i8", "<f4", "<u4", "<u8", "<u1", "<f4", "<f4", "<f4"))
        owner = np.repeat(np.arange(len(known)), per)
        pairs = owner * len(ctx_of) + at_of
        own = np.unique(owner * CONTEXTS + _class(ctx_of[at_of]))
        mid = np.unique(own >> 8)
        unk = (THETA[0] + d[0] * q.t0) / (q.v + 1) / (THETA[0] + q.n0)
        more1 = (THETA[1] + d[1] * q.t1) / (THETA[1] + q.n1)
        more2 = (THETA[2] + d[2] * q.t2) / (THETA[2] + q.n2)

        def find(keys, x):
            at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
            return at, (keys[at] == x) if len(keys) else np.zeros(len(x), bool)

        out = []
        for block, payload in zip(docs["block"], docs["payload"]):
            w, per_w, ctx, ci, per_p, row, times = _unz(payload)
            at, have = find(known, w)
            c = np.where(have, c_of[at] if len(known) else 0, 0)
            p0 = np.where(have, p0_of[at] if len(known) else 0.0, unk)
            wi = np.repeat(np.arange(len(w)), per_w)
            k2 = _class(ctx)[ci]
            k1 = k2 >> 8
            gid = np.where(have, at, -1)[wi]
            m_at, m_have = find(mid, gid * 256 + k1)
            p1 = np.where(m_have & (gid >= 0), p1_of[m_at] if len(mid) else 0.0, more1[k1] * p0[wi])
            o_at, o_have = find(own, gid * CONTEXTS + k2)
            p2 = np.where(o_have & (gid >= 0), p2_of[o_at] if len(own) else 0.0, more2[k2] * p1)
            c_at, c_have = find(ctx_of, ctx)
            p_at, p_have = find(pairs, gid * len(ctx_of) + c_at[ci])
            learned = p_have & c_have[ci] & (gid >= 0)
            # of a pair not learned, its context's own factor is added by the bucket of the context
            p3 = np.where(learned, p3_of[p_at] if len(pairs) else 0.0, p2)
            base = np.log10((c + 0.1) / (q.n_tokens + 0.1 * (q.v + 1)))
            pi = np.repeat(np.arange(len(wi)), per_p)
            docs_here, ri = np.unique(row, return_inverse=True)
            t = times.astype(np.float64)
            out.append((block, 1, 0, _z(docs_here.astype("<u4"), np.bincount(ri, t * np.log10(p3)[pi]), np.bincount(ri, t * base[wi][pi]),
                                        np.bincount(ri, t * (c > 0)[wi][pi]).astype("<u4"))))
            if q.n_tokens and not learned.all():
                lost = np.flatnonzero(~learned[pi])
                gone, number = _ranked(ci[pi[lost]])
                out.append((block, 2, 0, _z(ctx[gone], number.astype("<u4"), row[lost], times[lost])))
        return pd.DataFrame(out, columns=["block", "kind", "part", "payload"])
    return run


def _hand_down(d: float):
    """What contexts add to the documents' sums for pairs not learned: (theta + d T) / (theta + N) of each, 1 of a context not learned."""
    def run(key, asked, table):
        import pandas as pd
        out = []
        context, n, t = _unz(table["totals"].iloc[0]) if len(table) else (np.zeros(0, x) for x in ("<u8", "<u4", "<u4"))
        more = np.log10((THETA[3] + d * t) / (THETA[3] + n))
        for payload in asked["payload"]:
            ctx, ci, row, times = _unz(payload)
            at = np.minimum(np.searchsorted(context, ctx), max(len(context) - 1, 0))
            add = np.where(context[at] == ctx, more[at], 0.0) if len(context) else np.zeros(len(ctx))
            docs_here, ri = np.unique(row, return_inverse=True)
            zero = np.zeros(len(docs_here))
            out.append(_z(docs_here.astype("<u4"), np.bincount(ri, times * add[ci]), zero, zero.astype("<u4")))
        return pd.DataFrame({"block": asked["block"], "kind": 1, "part": 0, "payload": out})
    return run


def _sum_block(buckets: int):
    """Of a block one row of each kind: its documents, its sums per document, contexts of pairs not learned. With ``buckets`` not 0,
    the last are dealt to the buckets of contexts (part)."""
    def run(key, pdf):
        import pandas as pd
        out = [(key[0], 0, 0, payload) for payload in pdf["payload"][pdf["kind"] == 0]]
        sums, lost = ([_unz(payload) for payload in pdf["payload"][pdf["kind"] == kind]] for kind in (1, 2))
        if sums:
            r, s, b, k = (np.concatenate(x) for x in zip(*sums))
            docs_here, ri = _ranked(r)
            out.append((key[0], 1, 0, _z(docs_here, np.bincount(ri, s), np.bincount(ri, b), np.bincount(ri, k).astype("<i8"))))
        if lost:
            contexts, c = _ranked(np.concatenate([ctx[ci] for ctx, ci, _, _ in lost]))
            row, times = (np.concatenate([x[i] for x in lost]) for i in (2, 3))
            to = _bucket(contexts, buckets) if buckets else np.zeros(len(contexts), np.int64)
            by = np.argsort(to, kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            order, first = _grouped(rank[c], row)
            c, row, times = rank[c][order][first], row[order][first], np.add.reduceat(times[order].astype(np.int64), first)
            cut = np.searchsorted(to[by][c], np.arange(max(buckets, 1) + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                s = slice(cut[k], cut[k + 1])
                here, number = _ranked(c[s])
                out.append((key[0], 2, k, _z(contexts[by][here], number.astype("<u4"), row[s], times[s].astype("<u4" if times[s].max() < 2**32 else "<u8"))))
        return pd.DataFrame(out, columns=["block", "kind", "part", "payload"])
    return run


def _add_up(key, pdf):
    import pandas as pd
    ids, null, held, n = _unz(pdf["payload"][pdf["kind"] == 0].iloc[0])
    score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for payload in pdf["payload"][pdf["kind"] == 1]:
        r, s, b, k = _unz(payload)
        score[r] += s
        base[r] += b
        known[r] += k.astype(np.int64)
    return pd.DataFrame({"id": pd.arrays.IntegerArray(ids.copy(), null.astype(bool)), "held_out": held.astype(bool), "n_tokens": n, "n_known": known, "base_score": base, "score": score})


def score(docs: DataFrame, merge: int = MERGE, split_tokens: int = SPLIT_TOKENS, turns: int = TURNS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of rows (id, text, held_out): log10 probabilities.

    The model learns from the rows that are not held out. Perplexity of a text: 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    arrow_conf(spark)
    docs = docs.select("text", "id", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, math.ceil(n_bytes / BUCKET_BYTES))
    fan = max(1, math.ceil(n_bytes / BLOCK_BYTES / merge))
    schema = "bucket int, part int, pairs binary"
    counts = docs.mapInArrow(lean(_send_counts(buckets, fan)), schema)
    while fan > 1:
        fan = math.ceil(fan / merge)
        counts = counts.repartition(buckets, "bucket", "part").groupBy("bucket", "part").applyInPandas(_merge_group(fan), schema)
    merged = written(counts.repartition(buckets, "bucket").groupBy("bucket", "part").applyInPandas(_merge_group(1), schema)
                     .select("bucket", "pairs"), "lm-counts")
    del counts
    free_disk(spark)

    def summed(state: DataFrame, name: str) -> tuple[DataFrame, np.ndarray]:
        """Totals by part and bucket, and the vector of the classes' (about 131,000 numbers)."""
        sums = written(state.repartition(buckets, "part").groupBy("part").applyInPandas(_sum_totals, TOTALS_SCHEMA), name)
        rows = sums.where("part < 0").orderBy(F.desc("part")).collect()
        size = 2 * CONTEXTS + 256 + 1 + 10
        return sums, np.concatenate([_unz(bytes(r["totals"]))[0] for r in rows]) if rows else np.zeros(size, np.int64)

    def seated(sums: DataFrame, low: int = 0, high: int = buckets, least: int = buckets):
        here = F.col("bucket").between(low, high - 1)
        return (merged.where(here).repartition(least, "bucket").groupBy("bucket")
                .cogroup(sums.where(here & (F.col("part") >= 0)).groupBy("bucket")))

    sums, vector = summed(merged.select("bucket", "pairs").mapInArrow(lean(_statistics(buckets)), TOTALS_SCHEMA), "lm-stats")
    sizes = vector[2 * CONTEXTS + 257:].reshape(5, 2)
    d = [float(np.clip(a / (a + 2 * b), 0.1, 0.95)) if a + b else 0.5 for a, b in sizes[1:]]
    v, n_tokens = int(sizes[0, 0]), int(sizes[0, 1])

    def totals_of(x: np.ndarray) -> Totals:
        x = x.astype(np.float64)
        return Totals(x[:CONTEXTS], x[CONTEXTS:2 * CONTEXTS], x[2 * CONTEXTS:2 * CONTEXTS + 256], float(x[2 * CONTEXTS + 256]), d, v, n_tokens)

    totals = totals_of(vector)
    for k in range(ROUNDS):
        last = folder_of(sums)
        sums, vector = summed(seated(sums).applyInPandas(_rounds(totals, k, buckets), TOTALS_SCHEMA), "lm-round")
        totals = totals_of(vector)
        free_disk(spark, *([last] if last else []))         # a round reads the one before it only
    # buckets crowded by frequent words are split: each holds over split_tokens tokens of the corpus, so they are few
    crowd = written(merged.select("bucket", "pairs").mapInArrow(_bucket_tokens, "bucket int, n long").where(F.col("n") > split_tokens), "lm-crowd")
    split = {r["bucket"]: math.ceil(r["n"] / split_tokens) for r in crowd.collect()}
    turns = min(turns, buckets)
    tasks = min(buckets, max(parts, math.ceil(buckets / turns)))
    of_turns = []
    for low, high in ((buckets * k // turns, buckets * (k + 1) // turns) for k in range(turns)):
        models = written(seated(sums, low, high, tasks).applyInPandas(_average(totals, buckets), "bucket int, model binary"), "lm-models")
        last = folder_of(models)
        free_disk(spark)
        models = (models.join(crowd, "bucket", "left")
                  .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.ceil(F.col("n") / split_tokens), F.lit(1)).cast("int") - 1)))
                  .select("bucket", "part", "model"))
        sent = docs.mapInArrow(lean(_send_documents(buckets, split, low, high)), "bucket int, part int, block long, payload binary")
        scored = (sent.repartition(tasks, "bucket", "part").groupBy("bucket", "part")
                  .cogroup(models.groupBy("bucket", "part")).applyInPandas(_score_bucket(totals, buckets), SUMS_SCHEMA))
        of_turns.append(written(scored.groupBy("block").applyInPandas(_sum_block(0), SUMS_SCHEMA), "lm-turn"))
        del models, sent, scored
        free_disk(spark, *([last] if last else []))
    counted = folder_of(merged)
    del merged, seated
    free_disk(spark, *([counted] if counted else []))
    scored = written(functools.reduce(DataFrame.unionByName, of_turns).groupBy("block").applyInPandas(_sum_block(buckets), SUMS_SCHEMA), "lm-scored")
    free_disk(spark, *filter(None, map(folder_of, of_turns)))
    handed = (scored.where("kind = 2").repartition(buckets, "part").groupBy("part")
              .cogroup(sums.where("part >= 0 and bucket < 0").groupBy("part")).applyInPandas(_hand_down(d[3]), SUMS_SCHEMA))
    out = scored.where("kind < 2").unionByName(handed).groupBy("block").applyInPandas(
        _add_up, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _bucket_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [int(_unpack_pairs(x)[2].sum()) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["bucket", "n"])
