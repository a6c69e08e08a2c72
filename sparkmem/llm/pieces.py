"""Operator 10, SentencePiece encoding and decoding by batched numpy Viterbi.

Words (a run of spaces and what follows up to the next space) are looked up once per distinct word.
All new words of one length advance together: at every end position, each piece length gives one
substring hash per word (a difference of prefix sums), the hashes probe the sorted piece keys, and the
best candidate's length is kept as backpointer. Two kinds of models are handled:

* unigram: the candidate with the largest sum of scores wins, as in the library;
* BPE: the path ending at a position is the BPE encoding of that prefix, so a candidate counts only if the
  piece before it and the candidate stay apart when their concatenation is merged (a property of the two pieces alone, kept
  per pair), and exactly one candidate remains. Maximising scores would not give a BPE model's ids.

Normalisation is that of the model at hand (identity, one space put before the text, spaces as U+2581);
a character without piece falls back to its bytes (or to the unknown id). Decoding gathers the pieces'
bytes, turns U+2581 into spaces and drops the one put in front; a literal U+2581 in a text reads back
as a space, as in the library.

Nulls and odd input: a null or empty text gives no pieces and decodes to the empty text; repeated rows give
repeated results; an empty table gives an empty result; extra columns are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _BINV, arrow_conf, clustered_ranges, lean, mix64, powers, row_slices, utf8, _M2

SPACE = 0x2581
KNOWN_WORDS = 600_000      # distinct words a worker remembers before it starts anew
PAIR_SLOTS = 1 << 21       # pairs of pieces a worker remembers (direct-mapped)
BATCH_BYTES = 4 << 20


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _finish(poly: np.ndarray, n) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(poly + np.asarray(n, np.uint64) * _M2)


class Model:
    """A vocabulary ready for the search; loaded once per worker."""

    def __init__(self, path: str, kind: str | None = None):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = kind or _model_kind(sp.serialized_model_proto())
        if self.kind not in ("bpe", "unigram"):
            raise ValueError(f"unsupported model kind {self.kind}")
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in normal}
        pts = [_points(text[i]) for i in normal]
        self.unk = sp.unk_id()
        self.byte_id = np.full(256, -1, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(sp.id_to_piece(i)[3:5], 16)] = i
        poly = np.zeros(len(normal), np.uint64)
        with np.errstate(over="ignore"):
            for k, p in enumerate(pts):
                poly[k] = ((p.astype(np.uint64) + np.uint64(1)) * powers(len(p))[:len(p)]).sum(dtype=np.uint64)
        size = np.array([len(p) for p in pts], np.int64)
        key = _finish(poly, size)
        order = np.argsort(key)
        self.keys, self.key_id = key[order], np.array(normal, np.int64)[order]
        self.size = np.zeros(n, np.int64)
        self.size[normal] = size
        self.poly = np.zeros(n, np.uint64)
        self.poly[normal] = poly
        self.score = np.array([sp.get_score(i) for i in range(n)], np.float64)
        self.lengths = np.unique(size)
        self.spaces = {len(text[i]): i for i in normal if set(text[i]) == {chr(SPACE)}}
        inner = [i for i in normal if text[i].lstrip(chr(SPACE)) and (chr(SPACE) in text[i][1:])]
        if inner:
            raise ValueError("pieces with a space inside are not supported")
        # decoding: bytes of every id
        out = []
        for i in range(n):
            if sp.is_byte(i):
                out.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]))
            elif sp.is_control(i):
                out.append(b"")
            elif sp.is_unknown(i):
                out.append(" ⁇ ".encode())
            else:
                out.append(sp.id_to_piece(i).replace(chr(SPACE), " ").encode())
        self.out_len = np.array([len(b) for b in out], np.int64)
        self.out_at = np.concatenate([[0], np.cumsum(self.out_len)])[:-1]
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        # BPE: order of merging, and how each piece splits when its own merging is undone
        self.split_l = np.full(n, -1, np.int64)
        self.split_r = np.full(n, -1, np.int64)
        if self.kind == "bpe":
            self._find_splits(normal, text)
        self.pair_key = np.full(PAIR_SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(PAIR_SLOTS, bool)
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros(0, np.int64)
        self.known_n = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _find_splits(self, normal, text) -> None:
        """The last merge of each piece when it is encoded alone: merge by falling score, leftmost first."""
        by_text = {text[i]: i for i in normal}
        for i in normal:
            parts = [by_text.get(c, -1) for c in text[i]]
            strs = list(text[i])
            while len(strs) > 2:
                best = None
                for k in range(len(strs) - 1):
                    j = by_text.get(strs[k] + strs[k + 1])
                    if j is not None and j != i and (best is None or self.score[j] > self.score[best[1]]):
                        best = (k, j)
                if best is None:
                    break
                k, j = best
                strs[k:k + 2] = [strs[k] + strs[k + 1]]
                parts[k:k + 2] = [j]
            if len(strs) == 2 and min(parts) >= 0:
                self.split_l[i], self.split_r[i] = parts

    def find(self, poly: np.ndarray, size) -> np.ndarray:
        """Piece id of each hashed substring, -1 if none."""
        h = _finish(poly, size)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.key_id[at], -1)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the piece a + b, -1 if it is none."""
        with np.errstate(over="ignore"):
            poly = self.poly[a] + self.poly[b] * powers(64)[self.size[a]]
        return self.find(poly, self.size[a] + self.size[b])

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE keeps the pieces apart when it encodes left + right (remembered per pair)."""
        key = left * (1 << 24) + right
        slot = (mix64(key.astype(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        ok = self.pair_ok[slot]
        miss = np.flatnonzero(self.pair_key[slot] != key)
        if len(miss):
            uniq, inv = np.unique(key[miss], return_inverse=True)
            res = self._apart(uniq >> 24, uniq & ((1 << 24) - 1))
            ok[miss] = res[inv]
            self.pair_key[slot[miss]] = key[miss]
            self.pair_ok[slot[miss]] = res[inv]
        return ok

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Undo the merges inside both pieces from the latest on; at each state the two pieces at the border must not
        merge before the merge undone last. (Merges of the left piece come first among equals.)"""
        n = len(left)
        ok = np.ones(n, bool)
        act = np.arange(n)
        a, b = left.copy(), right.copy()
        limit = np.full(n, -np.inf)             # score of the merge undone last; the border must not score above it
        tie_wins = np.zeros(n, bool)            # whether a border merge of equal score would come before it
        while len(act):
            m = self.merged(a, b)
            s = np.where(m >= 0, self.score[m], -np.inf)
            early = (m >= 0) & ((s > limit) | ((s == limit) & tie_wins))
            ok[act[early]] = False
            sa = np.where(self.split_l[a] >= 0, self.score[a], np.inf)
            sb = np.where(self.split_l[b] >= 0, self.score[b], np.inf)
            go = ~early & ~(np.isinf(sa) & np.isinf(sb))
            act, a, b, sa, sb = act[go], a[go], b[go], sa[go], sb[go]
            undo_b = sb <= sa                   # the latest merge: least score, rightmost among equals
            limit = np.where(undo_b, sb, sa)
            tie_wins = undo_b                   # the border lies left of a merge inside the right piece
            a, b = np.where(undo_b, a, self.split_r[a]), np.where(undo_b, self.split_l[b], b)
        return ok

    def advance(self, pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentation of m words of n characters: (piece ids by end position, backpointer lengths), both (m, n + 1).

        A position whose character has no piece holds id -1 with length 1.
        """
        m, n = pts.shape
        with np.errstate(over="ignore"):
            s = np.zeros((n + 1, m), np.uint64)
            np.cumsum(((pts + np.uint64(1)) * powers(n)[:n]).T, axis=0, out=s[1:])
            inv = powers(n + 1, inverse=True)
            last = np.full((n + 1, m), -2, np.int64)
            back = np.ones((n + 1, m), np.int32)
            best = np.zeros((n + 1, m))
            floor = self.score.min() - 10.0     # an unknown character's score
            for i in range(1, n + 1):
                if self.kind == "unigram":
                    top, arg, ids = best[i - 1] + floor, np.ones(m, np.int32), np.full(m, -1)
                    for z in self.lengths[self.lengths <= i]:
                        t = self.find((s[i] - s[i - z]) * inv[i - z], z)
                        v = np.where(t >= 0, best[i - z] + self.score[t], -np.inf)
                        better = v > top
                        top, arg, ids = np.where(better, v, top), np.where(better, z, arg), np.where(better, t, ids)
                    best[i], back[i], last[i] = top, arg, ids
                    continue
                todo = np.arange(m)
                last[i] = -1
                for z in self.lengths[self.lengths <= i][::-1]:
                    t = self.find((s[i, todo] - s[i - z, todo]) * inv[i - z], z)
                    hit = np.flatnonzero(t >= 0)
                    if not len(hit):
                        continue
                    p = last[i - z, todo[hit]]
                    good = p < 0
                    pair = np.flatnonzero(~good)
                    good[pair] = self.apart(p[pair], t[hit][pair])
                    hit = hit[good]
                    back[i, todo[hit]] = z
                    last[i, todo[hit]] = t[hit]
                    todo = np.delete(todo, hit)
                    if not len(todo):
                        break
        return last.T, back.T

    def encode_words(self, pts: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, count per word) of words given as spans of code points."""
        n = end - start
        counts = np.zeros(len(n), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []   # (word, position, id)
        for size in np.unique(n):
            all_of = np.flatnonzero(n == size)
            step = max(1, (1 << 21) // int(size + 1))
            for lo in range(0, len(all_of), step):
                who = all_of[lo:lo + step]
                mat = pts[start[who][:, None] + np.arange(size)].astype(np.uint64)
                last, back = self.advance(mat)
                at = np.full(len(who), size)
                live = np.arange(len(who))
                while len(live):
                    pos = at[live]
                    found.append((who[live], pos, last[live, pos]))
                    at[live] = pos - back[live, pos]
                    live = live[at[live] > 0]
        if not found:
            return np.zeros(0, np.int32), counts
        w, pos, ids = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((pos, w))
        w, pos, ids = w[order], pos[order], ids[order]
        # unknown characters: their bytes, or one unknown id for a run of them
        bad = np.flatnonzero(ids < 0)
        if len(bad):
            if (self.byte_id >= 0).all():
                cp = pts[start[w[bad]] + pos[bad] - 1]
                per = np.where(cp < 0x80, 1, np.where(cp < 0x800, 2, np.where(cp < 0x10000, 3, 4)))
                raw = np.frombuffer(cp.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
                times = np.ones(len(ids), np.int64)
                times[bad] = per
                w, ids = np.repeat(w, times), np.repeat(ids, times)
                ids[ids < 0] = self.byte_id[raw]
            else:
                run = np.zeros(len(ids), bool)
                run[1:] = (ids[1:] < 0) & (ids[:-1] < 0) & (w[1:] == w[:-1])
                ids[bad] = self.unk
                w, ids = w[~run], ids[~run]
        np.add.at(counts, w, 1)
        return ids.astype(np.int32), counts

    def lookup(self, pts: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(at, count) of each word's ids in ``self.flat``; new distinct words are encoded."""
        from .common import span_hash
        h = span_hash(pts, start, end)
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > KNOWN_WORDS:
            self.known, self.known_at, self.known_n, self.flat = (x[:0] for x in (self.known, self.known_at, self.known_n, self.flat))
        at = np.searchsorted(self.known, uniq)
        have = np.zeros(len(uniq), bool)
        if len(self.known):
            have = self.known[np.minimum(at, len(self.known) - 1)] == uniq
        new = first[~have]
        if len(new):
            ids, n = self.encode_words(pts, start[new], end[new])
            where = len(self.flat) + np.concatenate([[0], np.cumsum(n)])[:-1]
            self.flat = np.concatenate([self.flat, ids])
            known = np.concatenate([self.known, uniq[~have]])
            order = np.argsort(known)
            self.known = known[order]
            self.known_at = np.concatenate([self.known_at, where])[order]
            self.known_n = np.concatenate([self.known_n, n])[order]
            at = np.searchsorted(self.known, uniq)
        return self.known_at[at][inv], self.known_n[at][inv]

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id offsets per text) of UTF-8 texts."""
        n_text = len(offsets) - 1
        lead = (data & 0xC0) != 0x80
        chars = np.concatenate([[0], np.cumsum(lead)])[offsets]           # characters before each text
        filled = np.diff(offsets) > 0
        body = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        # one space is put before every text that isn't empty
        begin = np.concatenate([[0], np.cumsum(np.diff(chars) + filled)])
        pts = np.empty(begin[-1], np.uint32)
        pts[begin[:-1][filled]] = SPACE
        keep = np.ones(len(pts), bool)
        keep[begin[:-1][filled]] = False
        pts[keep] = np.where(body == 32, SPACE, body)
        if not len(pts):
            return np.zeros(0, np.int32), np.zeros(n_text + 1, np.int64)
        # a word begins at the last space of a run; the spaces before it are a word of their own
        space = pts == SPACE
        new_text = np.zeros(len(pts), bool)
        new_text[begin[:-1][filled]] = True
        nxt_space = np.append(space[1:] & ~new_text[1:], False)
        prev_space = np.append(False, space[:-1]) & ~new_text
        word = (space & ~nxt_space) | (space & ~prev_space) | new_text
        start = np.flatnonzero(word)
        end = np.append(start[1:], len(pts))
        at, n = self.lookup(pts, start, end)
        # a run of spaces followed by a word whose own space stays alone is one run
        lone = np.zeros(len(start), bool)
        one = self.spaces.get(1, -1)
        if one >= 0 and len(self.spaces) > 1:
            starts_space = space[start] & (n > 0)
            lone[starts_space] = (self.flat[at[starts_space]] == one) & (end - start > 0)[starts_space]
            multi = np.flatnonzero(lone[1:] & space[start[:-1]] & space[np.maximum(end[:-1] - 1, 0)] & ~new_text[start[1:]]) + 1
        else:
            multi = np.zeros(0, np.int64)
        ids = self.flat[clustered_ranges(at, at + n)]
        if len(multi):
            ids, n = self._join_runs(ids, n, multi, end - start)
        text_of = np.searchsorted(begin, start, side="right") - 1
        per = np.bincount(text_of, weights=n, minlength=n_text).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per)])

    def _join_runs(self, ids, n, multi, size):
        """Spaces before a word that keeps its space apart: encode the whole run of spaces together."""
        at = np.concatenate([[0], np.cumsum(n)])
        out, n, done = [], n.copy(), 0
        for k in multi:
            out.append(ids[done:at[k - 1]])
            run = self.space_run(int(size[k - 1]) + 1)
            out.append(run)
            done = at[k] + 1
            n[k], n[k - 1] = n[k] - 1, len(run)
        out.append(ids[done:])
        return np.concatenate(out), n

    def space_run(self, k: int) -> np.ndarray:
        pts = np.full(k, SPACE, np.uint32)
        return self.encode_words(pts, np.array([0]), np.array([k]))[0]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte offsets, bytes) of the texts of id lists."""
        size = self.out_len[ids]
        data = self.out_bytes[clustered_ranges(self.out_at[ids], self.out_at[ids] + size)]
        off = np.concatenate([[0], np.cumsum(size)])[offsets]
        # drop the space put before each text
        filled = np.flatnonzero(np.diff(off) > 0)
        drop = off[:-1][filled]
        drop = drop[data[drop] == 32]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        return np.concatenate([[0], np.cumsum(keep)])[off], data[keep]


def _model_kind(proto: bytes) -> str:
    """trainer_spec.model_type of a serialized model: 1 unigram (the default), 2 BPE."""
    def fields(buf):
        i = 0
        while i < len(buf):
            key, i = varint(buf, i)
            if key & 7 == 0:
                v, i = varint(buf, i)
            elif key & 7 == 2:
                n, i = varint(buf, i)
                v, i = buf[i:i + n], i + n
            else:
                n = 8 if key & 7 == 1 else 4
                v, i = buf[i:i + n], i + n
            yield key >> 3, v

    def varint(buf, i):
        v = s = 0
        while True:
            v |= (buf[i] & 127) << s
            s, i = s + 7, i + 1
            if buf[i - 1] < 128:
                return v, i

    kind = 1
    for no, v in fields(proto):
        if no == 2:
            kind = next((x for f, x in fields(v) if f == 3), 1)
    return {1: "unigram", 2: "bpe"}.get(kind, str(kind))


_LOADED: dict[str, Model] = {}


def model(path: str, kind: str | None = None) -> Model:
    if path not in _LOADED:
        _LOADED[path] = Model(path, kind)
    return _LOADED[path]


def _encode_batches(path: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            off, data = utf8(b.column(1))
            for lo, hi in row_slices(off, BATCH_BYTES):
                ids, at = m.encode(off[lo:hi + 1] - off[lo], data[off[lo]:off[hi]])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo),
                     pa.LargeListArray.from_arrays(at, pa.array(ids, pa.int32())).cast(pa.list_(pa.int32()))], ["id", "piece_ids"])
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(id, piece_ids array<int>) of rows (id, text), whole texts."""
    arrow_conf(docs.sparkSession)
    return docs.select("id", "text").mapInArrow(_encode_batches(path), "id long, piece_ids array<int>")


def _decode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            col = b.column(1)
            if pa.types.is_list(col.type):
                col = col.cast(pa.large_list(pa.int32()))
            at = np.concatenate([[0], np.cumsum(np.array([0 if x is None else x for x in col.value_lengths().to_pylist()], np.int64))])
            off, data = m.decode(col.flatten().to_numpy(zero_copy_only=False), at)
            text = [data[a:z].tobytes().decode("utf-8", "replace") for a, z in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["id", "text"])
    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(id, text) of rows (id, piece_ids)."""
    arrow_conf(encoded.sparkSession)
    return encoded.select("id", "piece_ids").mapInArrow(_decode_batches(path), "id long, text string")


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """(id, piece_ids, decoded_sha256, round_trip): encode, decode the ids again and compare with the text, in one pass."""
    arrow_conf(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        m = model(path)
        for b in batches:
            off, data = utf8(b.column(1))
            for lo, hi in row_slices(off, BATCH_BYTES):
                o, d = off[lo:hi + 1] - off[lo], data[off[lo]:off[hi]]
                ids, at = m.encode(o, d)
                back_off, back = m.decode(ids, at)
                same, sha = [], []
                for i in range(hi - lo):
                    x = back[back_off[i]:back_off[i + 1]].tobytes()
                    same.append(x == d[o[i]:o[i + 1]].tobytes())
                    sha.append(hashlib.sha256(x).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo),
                     pa.LargeListArray.from_arrays(at, pa.array(ids, pa.int32())).cast(pa.list_(pa.int32())),
                     pa.array(sha), pa.array(same)], ["id", "piece_ids", "decoded_sha256", "round_trip"])

    return docs.select("id", "text").mapInArrow(lean(run), "id long, piece_ids array<int>, decoded_sha256 string, round_trip boolean")
