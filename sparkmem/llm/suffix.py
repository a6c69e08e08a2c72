"""Operator 5, suffix-array deduplication by difference-cover blockwise construction.

A byte is removed when a ``LENGTH``-byte string that covers it also starts earlier (smaller id, or the same
document and an earlier start); strings are judged on the input and never cross documents.

1. Documents are packed into blocks (rows of the shared folder). Every ``LENGTH``-byte string has an anchor: the
   leftmost least hashed ``GRAM``-byte gram within it. Equal strings have equal anchors at equal offsets, so strings
   whose anchor occurs once need no sorting. Each block sends its distinct anchors to hash buckets and
   gets back which of them repeat.
2. For a repeated anchor, the run of string starts that share it is one context. Equal contexts of a
   block are reduced to the earliest before anything is sent; the rest go to buckets by anchor.
3. A bucket sorts the suffixes at these starts, one group of anchors at a time, to the depth of
   ``LENGTH`` bytes: by the first ``COVER`` bytes, and where these tie (a long tie) by the rank of the
   sampled suffix that the difference cover offers within the next ``COVER`` bytes. Sample ranks are computed
   first, over the positions of a (31, 6, 1) difference set (19 of 100 positions). In a class of
   equal strings, all but the earliest are marked.
4. Marks go back to their blocks, where the covered bytes are cut.

Memory: a block, a bucket (their number grows with the data) and ``SORT_BYTES`` of contexts at a time. An anchor
whose contexts hold more than ``SORT_BYTES`` in all is spread over the buckets string by string, so no group
gathers in one bucket or is sorted beyond that at once.

Nulls and odd input: a null text counts as empty and stays null in the cleaned text; a null id comes before all others;
rows of one id are ordered by the hash of their text, and equal rows by block and place in the block, the first being
the earliest for every string; an empty table gives an empty result; extra columns are handed on.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_conf, block_numbers, clustered_ranges, lean, lean_groups, mix64, powers, return_freed_memory, row_slices, span_hash, utf8, written

LENGTH = 100               # bytes of a string that counts as repeated
GRAM = 24                  # bytes of an anchor
BLOCK_BYTES = 4 << 20      # text of one block
BUCKET_BYTES = 8 << 20     # text per bucket
SORT_BYTES = 1 << 20       # contexts sorted at a time; an anchor whose contexts hold more is hot
CUT_BYTES = 256 << 10      # text that leaves a block at once
# fixed values: a perfect difference set modulo 31 (every difference occurs once)
COVER = 31
COVER_SET = (1, 5, 11, 24, 25, 27)
_NEXT = np.array([min(d for d in range(COVER) if (p + d) % COVER in COVER_SET) for p in range(COVER)])
_IN_COVER = np.isin(np.arange(COVER), COVER_SET)


# --------------------------------------------------------------------------
# Blocks
# --------------------------------------------------------------------------
BLOCK_SCHEMA = "block long, n_bytes long, ids binary, ties binary, offs binary, data binary, rest binary"


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: text, tie, id, then the columns handed on. Blocks are in the order of (id, tie)."""
    import zstandard

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, ties = t.column("_id").to_numpy(), t.column("_tie").to_numpy()
        t = t.take(pa.array(np.lexsort((ties, ids)))).combine_chunks()
        off, data = utf8(t.column("_text"))
        rest = t.drop_columns(["_text", "_tie", "_id"])
        rest = rest.append_column("_null", pa.compute.is_null(t.column("_text")))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as w:
            w.write_table(rest)
        z = zstandard.ZstdCompressor(level=3).compress
        number = next(numbers)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([int(off[-1])], pa.int64()),
             *(pa.array([x], pa.binary()) for x in (
                 z(t.column("_id").to_numpy().astype("<i8").tobytes()), z(t.column("_tie").to_numpy().astype("<i8").tobytes()),
                 z(off.astype("<i8").tobytes()), z(data.tobytes()), z(sink.getvalue().to_pybytes())))],
            ["block", "n_bytes", "ids", "ties", "offs", "data", "rest"])

    numbers = block_numbers()
    held, size = [], 0
    for b in batches:
        off, _ = utf8(b.column(0))
        for lo, hi in row_slices(off, BLOCK_BYTES):
            held.append(b.slice(lo, hi - lo))
            size += int(off[hi] - off[lo])
            if size >= BLOCK_BYTES:
                yield block(held)
                held, size = [], 0
    if held:
        yield block(held)


def _unz(x: bytes, kind: str) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


# --------------------------------------------------------------------------
# Anchors and contexts
# --------------------------------------------------------------------------
def runs(offsets: np.ndarray, data: np.ndarray):
    """Runs of string starts that share an anchor: (first start, one past the last, anchor position, anchor hash)."""
    n = len(data)
    span = LENGTH - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        s = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n)[:n], out=s[1:])
        gram = mix64((s[GRAM:] - s[:-GRAM]) * powers(n + 1, inverse=True)[:n + 1 - GRAM])
    # 33 bits of the hash over the position: the leftmost of equal grams, whatever the slice a string stands in
    bits = np.uint64(31)
    low = ((gram >> bits) << bits) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width * 2 <= span:                    # least of each window, by doubling
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # starts whose string lies within one document
    inside = np.zeros(n + 1, np.int32)
    long_enough = np.diff(offsets) >= LENGTH
    inside[offsets[:-1][long_enough]] += 1
    np.add.at(inside, offsets[1:][long_enough] - (LENGTH - 1), -1)
    ok = np.cumsum(inside)[:len(anchor)] > 0
    begins = np.zeros(len(anchor) + 1, bool)
    begins[offsets[:-1][offsets[:-1] < len(anchor)]] = True
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~ok[:-1] | begins[1:-1]
    first = np.flatnonzero(ok & new)
    stop = np.ones(len(anchor), bool)
    stop[:-1] = new[1:] | ~ok[1:]
    last = np.flatnonzero(ok & stop) + 1
    return first, last, anchor[first], gram[anchor[first]]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(h ^ np.uint64(0xA5A5A5A5)) % np.uint64(buckets)).astype(np.int64)


def _block_anchors(offs, data, weigh: bool = False):
    """Distinct anchors of a block (sorted); with ``weigh`` also how often each occurs, and the bytes of its different contexts."""
    first, last, anchor = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, hi in row_slices(offs):
        f, e, _, h = runs(offs[lo:hi + 1] - offs[lo], data[offs[lo]:offs[hi]])
        anchor.append(h)
        if weigh:
            first.append(f + offs[lo])
            last.append(e + offs[lo])
    anchor = np.concatenate(anchor)
    if not weigh:
        return np.unique(anchor)
    first, last = np.concatenate(first), np.concatenate(last)
    h, at, n = np.unique(anchor, return_inverse=True, return_counts=True)
    more = np.flatnonzero(n[at] > 1)
    counted = n[at] == 1
    counted[more[np.unique(_context_hash(data, first[more], last[more], anchor[more]), return_index=True)[1]]] = True
    return h, n, np.bincount(at[counted], (last - first + LENGTH - 1)[counted], len(h))


def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, o, d in zip(*(b.column(k).to_pylist() for k in range(3))):
                h, n, size = _block_anchors(_unz(o, "<i8"), _unz(d, "u1"), weigh=True)
                # a byte: whether the anchor repeats in the block, and the contexts' bytes as quarters of a power of two, rounded up
                said = np.minimum(np.ceil(4 * np.log2(np.maximum(size, 1))), 127).astype(np.uint8) | (n > 1).astype(np.uint8) << 7
                to = _bucket(h, buckets)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cut)):
                    some = order[cut[k]:cut[k + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(k)], pa.int32()), pa.array([number], pa.int64()), pa.array([h[some].tobytes()], pa.binary()),
                         pa.array([said[some].tobytes()], pa.binary())], ["bucket", "block", "h", "said"])
                return_freed_memory()
    return run


def _answer_anchors(hot_bytes: int):
    def run(key, pdf):
        """Code of each anchor sent: 0 occurs once, 1 repeats, 2 repeats and its contexts hold more than ``hot_bytes``."""
        import pandas as pd
        hs = [np.frombuffer(x, "<u8") for x in pdf["h"]]
        said = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["said"]])
        uniq, inv, n = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
        rep = n > 1
        rep[inv[said > 127]] = True
        size = np.bincount(inv, 2.0 ** ((said & 127) / 4), len(uniq))
        code = (rep.astype(np.uint8) + (rep & (size > hot_bytes)))[inv]
        cut = np.cumsum([0, *map(len, hs)])
        return pd.DataFrame({"block": pdf["block"], "bucket": key[0],
                             "code": [np.packbits(np.stack([c & 1, c >> 1])).tobytes() if len(c) else b"" for c in
                                      (code[a:z] for a, z in zip(cut[:-1], cut[1:]))]})
    return run


CONTEXT_SCHEMA = "bucket int, block long, n int, entries binary, bytes binary, marks binary"


def _send_contexts(buckets: int):
    """Columns: block, ids, ties, offs, data, codes (array of (bucket, code))."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        for b in batches:
            for number, ids, ties, o, d, codes in zip(*(b.column(k).to_pylist() for k in range(6))):
                z = zstandard.ZstdCompressor(level=1).compress
                ids, ties, o, d = _unz(ids, "<i8"), _unz(ties, "<i8"), _unz(o, "<i8"), _unz(d, "u1")
                return_freed_memory()
                h = _block_anchors(o, d)
                to = _bucket(h, buckets)
                state = np.zeros(len(h), np.uint8)
                for c in codes or []:
                    mine = np.flatnonzero(to == c["bucket"])
                    bits = np.unpackbits(np.frombuffer(c["code"], np.uint8), count=2 * len(mine)).reshape(2, -1)
                    # 1 repeats, 2 hot: a hot code has its low bit clear (0 + 2) or set (1 + 1 = 2)
                    state[mine] = np.where(bits[1] == 1, 2, bits[0])
                first, last, at, ha, doc_base = [], [], [], [], 0
                for lo, hi in row_slices(o):
                    f, e, a, g = runs(o[lo:hi + 1] - o[lo], d[o[lo]:o[hi]])
                    st = state[np.searchsorted(h, g)] if len(g) else np.zeros(0, np.uint8)
                    f, e, a, g, st = (x[st > 0] for x in (f, e, a, g, st))
                    # a hot anchor's context is dealt out string by string
                    if (st == 2).any():
                        k = np.where(st == 2, e - f, 1)
                        i = np.repeat(np.arange(len(f)), k)
                        step = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
                        hot = st[i] == 2
                        f, e, a = np.where(hot, f[i] + step, f[i]), np.where(hot, f[i] + step + 1, e[i]), a[i]
                        g = g[i]
                        loc = d[o[lo]:o[hi]]
                        g = np.where(hot, span_hash(loc, f, f + LENGTH), g)
                    first.append(f + o[lo])
                    last.append(e + o[lo])
                    at.append(a + o[lo])
                    ha.append(g)
                if not first:
                    continue
                first, last, at, ha = map(np.concatenate, (first, last, at, ha))
                ctx = _context_hash(d, first, last, ha)
                # the earliest of equal contexts stays; the starts of the others are marked here
                _, keep = np.unique(ctx, return_index=True)
                again = np.ones(len(first), bool)
                again[keep] = False
                doc = np.searchsorted(o, first, side="right") - 1
                if again.any():
                    yield _rows(-1 - (number % buckets), number, 0, b"", b"", z(_marks(doc[again], first[again] - o[doc[again]], last[again] - o[doc[again]])))
                first, last, at, ha, doc = (x[keep] for x in (first, last, at, ha, doc))
                to = _bucket(ha, buckets)
                order = np.lexsort((first, to))
                cut = np.searchsorted(to[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(cut)):
                    s = order[cut[k]:cut[k + 1]]
                    size = last[s] - first[s] + LENGTH - 1
                    raw = d[clustered_ranges(first[s], first[s] + size)]
                    entries = b"".join(x.tobytes() for x in (
                        ha[s].astype("<u8"), ids[doc[s]].astype("<i8"), ties[doc[s]].astype("<i8"), doc[s].astype("<i4"),
                        (first[s] - o[doc[s]]).astype("<i4"), (last[s] - first[s]).astype("<u1"), (at[s] - first[s]).astype("<u1")))
                    yield _rows(int(k), number, len(s), z(entries), z(raw.tobytes()), b"")
    return run


def _context_hash(d: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Hash of each context's bytes, by slices of the contexts so that the prefix sums stay small."""
    out = np.zeros(len(first), np.uint64)
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + (2 << 20))))
        a, z = int(first[lo]), int((last[lo:hi]).max()) + LENGTH - 1
        out[lo:hi] = span_hash(d[a:z], first[lo:hi] - a, last[lo:hi] + LENGTH - 1 - a)
        lo = hi
    with np.errstate(over="ignore"):
        return mix64(out + anchor * np.uint64(3))


def _rows(bucket, block, n, entries, raw, marks) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), pa.array([n], pa.int32()),
         pa.array([entries], pa.binary()), pa.array([raw], pa.binary()), pa.array([marks], pa.binary())],
        ["bucket", "block", "n", "entries", "bytes", "marks"])


def _marks(doc, first, last) -> bytes:
    return np.stack([doc, first, last]).astype("<i4").tobytes()


# --------------------------------------------------------------------------
# Sorting a bucket
# --------------------------------------------------------------------------
def _word(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position, as a big-endian number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | text[at + k]
    return out


def _names(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank of each) under the keys, first key first; equal keys have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        ks = k[order]
        new[1:] |= ks[1:] != ks[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def _words_over(text: np.ndarray, at: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """Keys that compare the bytes lo..hi-1 behind each position (hi - lo >= 8; the last word may overlap)."""
    return [_word(text, at + min(k, hi - 8)) for k in range(lo, hi, 8)]


def repeated_starts(text: np.ndarray, base: np.ndarray, n: np.ndarray, anchor_at: np.ndarray, group: np.ndarray, age: list[np.ndarray]):
    """(entry, start) of all starts whose LENGTH-byte string also starts earlier.

    ``text``: the contexts' bytes; of each context: where it begins, its number of starts, the anchor's offset, its
    group (equal anchor) and its age (keys of the order: id, tie, block, document, position).
    """
    # ranks of the difference-cover sample: strings of LENGTH - COVER + 1 bytes at positions whose phase
    # (distance from the context's anchor modulo COVER) is in the set
    depth = LENGTH - COVER + 1
    size = n + LENGTH - 1
    where = clustered_ranges(base, base + size)
    owner = np.repeat(np.arange(len(base)), size)
    phase = (where - base[owner] - anchor_at[owner]) % COVER
    take = _IN_COVER[phase] & (where + depth <= base[owner] + size[owner])
    sample = where[take]
    rank = np.full(len(text), -1, np.int64)
    if len(sample):
        rank[sample] = _names(_words_over(text, sample, 0, depth))[1]
    del where, owner, phase, take
    # the suffixes at the starts, by group, offset from the anchor and the first COVER bytes
    entry = np.repeat(np.arange(len(base)), n)
    start = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
    pos = base[entry] + start
    order, name = _names([group[entry] * 256 + anchor_at[entry] - start + 128, *_words_over(text, pos, 0, COVER)])
    times = np.bincount(name)
    long_tie = np.flatnonzero(times[name] > 1)
    entry, start, pos, name = (x[long_tie] for x in (entry, start, pos, name))
    if not len(entry):
        return entry, start
    # long ties: the sampled suffix within reach, then what lies behind its depth
    ph = (start - anchor_at[entry]) % COVER
    keys = [name, rank[pos + _NEXT[ph]], *_words_over(text, pos, depth - 1, LENGTH)]
    _, cls = _names(keys)
    order = np.lexsort([start, *[a[entry] for a in age[::-1]], cls])
    c = cls[order]
    later = order[1:][c[1:] == c[:-1]]
    return entry[later], start[later]


def _sort_bucket(key, pdf):
    import pandas as pd
    import zstandard
    z = zstandard.ZstdCompressor(level=1).compress
    out_block, out_marks = [], []
    return_freed_memory()
    if key[0] < 0:                              # marks made within blocks, on their way back
        return pd.DataFrame({"block": pdf["block"], "marks": pdf["marks"]})
    n_of = pdf["n"].to_numpy()
    total = int(n_of.sum())
    cols = [np.empty(total, t) for t in ("<u8", "<i8", "<i8", "<i4", "<i4", "<u1", "<u1")]
    at = 0
    raws = []
    for n, e, raw in zip(n_of, pdf["entries"], pdf["bytes"]):
        e, i = _unz(e, "u1").tobytes(), 0
        for c in cols:
            c[at:at + n] = np.frombuffer(e, c.dtype, n, i)
            i += n * c.dtype.itemsize
        raws.append(_unz(raw, "u1"))
        at += n
    text = np.concatenate(raws)
    del raws
    anchor, ids, ties, doc, first, n_start, off = cols
    n_start = n_start.astype(np.int64)
    size = n_start + LENGTH - 1
    base = np.cumsum(size) - size
    row = np.repeat(np.arange(len(n_of)), n_of)
    block = pdf["block"].to_numpy()[row]
    uniq, group, times = np.unique(anchor, return_inverse=True, return_counts=True)
    order = np.argsort(group, kind="stable")
    order = order[times[group[order]] > 1]
    weight = np.cumsum(size[order])
    marks: list[tuple] = []
    lo = 0
    while lo < len(order):
        hi = int(np.searchsorted(weight, (weight[lo - 1] if lo else 0) + SORT_BYTES, side="right"))
        hi = min(max(hi, lo + 1), len(order))
        last_group = group[order[hi - 1]]
        hi = int(np.searchsorted(group[order], last_group, side="right"))      # whole groups
        e = order[lo:hi]
        lo = hi
        part = text[clustered_ranges(base[e], base[e] + size[e])]
        b = np.cumsum(size[e]) - size[e]
        # equal contexts: all but the earliest are repeats as a whole
        h = mix64(span_hash(part, b, b + size[e]) + group[e].astype(np.uint64))
        o = np.lexsort((first[e], doc[e], block[e], ties[e], ids[e], h))
        dup = o[1:][h[o][1:] == h[o][:-1]]
        marks.append((e[dup], first[e[dup]], first[e[dup]] + n_start[e[dup]]))
        keep = np.ones(len(e), bool)
        keep[dup] = False
        more = np.bincount(group[e[keep]], minlength=len(uniq))
        keep &= more[group[e]] > 1
        e, b = e[keep], b[keep]
        if not len(e):
            continue
        entry, start = repeated_starts(part, b, n_start[e], off[e].astype(np.int64), group[e], [ids[e], ties[e], block[e], doc[e], first[e]])
        o = np.lexsort((start, entry))
        entry, start = entry[o], start[o]
        if len(entry):
            head = np.ones(len(entry), bool)
            head[1:] = (entry[1:] != entry[:-1]) | (start[1:] != start[:-1] + 1)
            f = np.flatnonzero(head)
            last = np.append(f[1:], len(entry)) - 1
            who = e[entry[f]]
            marks.append((who, first[who] + start[f], first[who] + start[last] + 1))
    if not marks:
        return pd.DataFrame({"block": np.zeros(0, np.int64), "marks": np.zeros(0, object)})
    who, f, last = (np.concatenate(x) for x in zip(*marks))
    blocks = pdf["block"].to_numpy()
    o = np.argsort(row[who], kind="stable")
    who, f, last = who[o], f[o], last[o]
    cut = np.searchsorted(row[who], np.arange(len(blocks) + 1))
    for k in np.flatnonzero(np.diff(cut)):
        s = slice(cut[k], cut[k + 1])
        out_block.append(int(blocks[k]))
        out_marks.append(z(_marks(doc[who[s]], f[s], last[s])))
    return pd.DataFrame({"block": np.array(out_block, np.int64), "marks": out_marks})


# --------------------------------------------------------------------------
# Cutting
# --------------------------------------------------------------------------
def _cut(rest_names: list[str], with_text: bool):
    """Columns: offs, data, rest, marks (array of binary). A block is opened alone and leaves in slices of CUT_BYTES of its text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        for b in batches:
            for i in range(b.num_rows):
                yield from cut(*(b.column(k)[i] for k in range(4)), zstandard.ZstdDecompressor())
                return_freed_memory()

    def cut(o, d, rest, marks, unpack) -> Iterator[pa.RecordBatch]:
        o, d = _unz(o.as_buffer(), "<i8"), _unz(d.as_buffer(), "u1")
        gone = np.zeros(len(d) + 1, np.int32)
        for m in marks.values if marks.is_valid else []:
            doc, f, e = _unz(m.as_buffer(), "<i4").reshape(3, -1).astype(np.int64)
            np.add.at(gone, o[doc] + f, 1)
            np.add.at(gone, o[doc] + e - 1 + LENGTH, -1)
        np.cumsum(gone, out=gone)
        gone = gone[:-1] > 0
        t = pa.ipc.open_stream(unpack.decompress(rest.as_buffer())).read_all().combine_chunks()
        for lo, hi in row_slices(o, CUT_BYTES):
            at = o[lo:hi + 1] - o[lo]
            lost, text = gone[o[lo]:o[hi]], d[o[lo]:o[hi]]
            opens = lost.copy()
            opens[1:] &= ~lost[:-1]
            starts = at[:-1][at[:-1] < len(text)]
            opens[starts] |= lost[starts]
            n_lost = np.concatenate([[0], np.cumsum(lost, dtype=np.int64)])[at]
            n_open = np.concatenate([[0], np.cumsum(opens, dtype=np.int64)])[at]
            kept, to = text[~lost].tobytes(), at - n_lost
            cols = [t.column(c).slice(lo, hi - lo).combine_chunks() for c in rest_names]
            cols += [pa.array(np.diff(at), pa.int64()), pa.array(np.diff(n_lost), pa.int64()), pa.array(np.diff(n_open), pa.int64())]
            parts = (kept[a:z] for a, z in zip(to[:-1], to[1:]))
            if with_text:
                null = t.column("_null").slice(lo, hi - lo).to_pylist()
                cols.append(pa.array([None if x else p.decode("utf-8", "ignore") for x, p in zip(null, parts)], pa.string()))
            else:
                cols.append(pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()))
            yield pa.RecordBatch.from_arrays(
                cols, [*rest_names, "n_bytes", "n_removed", "n_spans", "kept_text" if with_text else "kept_sha256"])
    return run


def deduplicate(docs: DataFrame, id_col: str, text_col: str, with_text: bool = False, hot_bytes: int = SORT_BYTES) -> DataFrame:
    """All columns but the text, with n_bytes, n_removed, n_spans, and kept_sha256 or (``with_text``) kept_text.

    ``kept_text`` leaves out characters that a cut has split.
    """
    spark = docs.sparkSession
    arrow_conf(spark)
    rest = [c for c in docs.columns if c != text_col]
    own = docs.select(F.col(text_col).alias("_text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_tie"),
                      F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("_id"),
                      *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    blocks = written(own.mapInArrow(lean(_pack_blocks), BLOCK_SCHEMA), "suffix-blocks")
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / BUCKET_BYTES))
    sent = blocks.select("block", "offs", "data").mapInArrow(lean(_send_anchors(buckets)), "bucket int, block long, h binary, said binary")
    codes = written(sent.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(
        lean_groups(_answer_anchors(hot_bytes)), "block long, bucket int, code binary"), "suffix-codes")
    of_block = codes.groupBy("block").agg(F.collect_list(F.struct("bucket", "code")).alias("codes"))
    contexts = (blocks.select("block", "ids", "ties", "offs", "data").join(of_block, "block")
                .select("block", "ids", "ties", "offs", "data", "codes").mapInArrow(lean(_send_contexts(buckets)), CONTEXT_SCHEMA))
    marks = written(contexts.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(lean_groups(_sort_bucket), "block long, marks binary"), "suffix-marks")
    back = marks.groupBy("block").agg(F.collect_list("marks").alias("marks"))
    fields = [docs.schema[c] for c in rest]
    names = [f"c{i}" for i in range(len(rest))]
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, fields)),
                        "n_bytes long, n_removed long, n_spans long", "kept_text string" if with_text else "kept_sha256 string"])
    out = (blocks.select("block", "offs", "data", "rest").join(back, "block", "left").select("offs", "data", "rest", "marks")
           .mapInArrow(lean(_cut(names, with_text)), schema))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, rest)], "n_bytes", "n_removed", "n_spans",
                      "kept_text" if with_text else "kept_sha256")
