"""SentencePiece encoding and decoding (byte-pair models with byte fallback) by suffix-array matching.

A batch's texts are cut into units no piece can cross; its new units are joined to one string, whose suffixes are sorted;
every piece is looked up by bisection, which gives its range of occurrences. Occurrences are edges of a lattice; sorted by
position they are relaxed from left to right: an edge extends the encoding of what lies before it if merging leaves the
last piece and the new one apart. Each prefix has one such edge, and the chain of them is the encoding.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, broadcast_value, text_chunks, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units whose encodings a worker keeps.
KEPT_UNITS = 500_000
KEPT_PAIRS = 1_000_000
#: Units, and pairs, that are learned before they are merged into the table of all.
YOUNG_UNITS = 1 << 15
YOUNG_PAIRS = 1 << 13
CHUNK = 256 << 10
#: Bytes of new units whose suffixes are sorted at once.
LEARN_BYTES = 128 << 10


class Vocabulary:
    """Pieces of a model, spaces as themselves: what is sent to the executors (a fixed size)."""

    def __init__(self, model_file: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.digest = hashlib.sha256(sp.serialized_model_proto()).hexdigest()
        n = sp.get_piece_size()
        kinds = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        text = [sp.id_to_piece(i) for i in range(n)]
        self.size = n
        self.byte_ids = {int(t[3:5], 16): i for i, t in enumerate(text) if sp.is_byte(i)}
        self.pieces = {i: t.replace(SPACE, " ") for i, t in enumerate(text) if not kinds[i]}
        self.rank = {t: (-sp.get_score(i), i) for i, t in self.pieces.items()}
        long = [t for t in self.pieces.values() if len(t) > 1]
        inner = {c for t in long for c in t}
        self.free_spaces = all(" " not in t.lstrip(" ") for t in self.pieces.values())
        self.alone = np.zeros(256, bool)  # single bytes that no longer piece holds
        self.alone[[b for b in range(128) if chr(b) not in inner]] = True
        self.bytes = {i: t.encode() for i, t in self.pieces.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}

    def merge(self, text: str) -> list[str]:
        """Byte-pair merges of a short text in the order of ranks, leftmost first."""
        parts, nexts = list(text), list(range(1, len(text) + 1))
        prevs = list(range(-1, len(text) - 1))
        heap = []

        def offer(a):
            b = nexts[a]
            if b < len(parts) and (r := self.rank.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r[0], a, b, parts[a] + parts[b]))

        for a in range(len(parts) - 1):
            offer(a)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if parts[a] is None or b >= len(parts) or parts[b] is None or nexts[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, None
            nexts[a] = nexts[b]
            if nexts[b] < len(parts):
                prevs[nexts[b]] = a
            offer(a)
            if prevs[a] >= 0:
                offer(prevs[a])
        return [p for p in parts if p is not None]


class Encoder:
    """Encodes batches; keeps what it has learned about pairs of pieces and about units."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.ids = np.array(sorted(vocabulary.pieces), np.int64)
        raw = [vocabulary.pieces[i].encode() for i in self.ids.tolist()]
        self.wide = -(-max(map(len, raw)) // 8) * 8
        self.lengths = np.array([len(x) for x in raw])
        self.low = self._keys([x.ljust(self.wide, b"\0") for x in raw])
        self.high = self._keys([x.ljust(self.wide, b"\xff") for x in raw])
        self.length_of = np.zeros(vocabulary.size, np.int64)
        self.length_of[self.ids] = self.lengths
        single = {t for t in vocabulary.pieces.values() if len(t) == 1}
        self.single = single
        self._forget_pairs()
        self._forget()

    def _forget_pairs(self):
        none = (np.zeros(0, np.int64), np.zeros(0, bool))
        self.old_pairs, self.young_pairs = none, none  # key and verdict of each pair; sorted by key

    def _forget(self):
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.old, self.young = none, none  # key, place in flat and length of each unit's ids; sorted by key
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _find(self, uniq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and length of the ids of units, and which units are known."""
        place, length, known = np.zeros(len(uniq), np.int64), np.zeros(len(uniq), np.int64), np.zeros(len(uniq), bool)
        for key, at, size in (self.old, self.young):
            if len(key):
                found = np.minimum(np.searchsorted(key, uniq), len(key) - 1)
                hit = np.flatnonzero(key[found] == uniq)
                place[hit], length[hit], known[hit] = at[found[hit]], size[found[hit]], True
        return place, length, known

    def _keep(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)))
        self.flat[self.used : self.used + len(ids)] = ids
        new = (keys, self.used + np.concatenate(([0], np.cumsum(count)))[:-1], count)
        self.used += len(ids)
        self.young = self._merged(self.young, new)
        if len(self.young[0]) > YOUNG_UNITS:
            self.old, self.young = self._merged(self.old, self.young), tuple(x[:0] for x in self.young)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)

    def _keys(self, padded: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(padded), ">u8").astype(np.uint64).reshape(len(padded), -1).T.copy()

    # units

    def _cut(self, data: np.ndarray, at: np.ndarray):
        """Starts and ends of units: a run of spaces and what follows it; bytes in no longer piece stand alone."""
        first = np.zeros(len(data), bool)
        first[at[:-1][at[:-1] < len(data)]] = True
        if self.v.free_spaces:
            space = data == 32
            first[1:] |= space[1:] & ~space[:-1]
        lone = self.v.alone[data]
        first |= lone
        first[1:] |= lone[:-1]
        starts = np.flatnonzero(first)
        return starts, np.concatenate((starts[1:], [len(data)]))

    def encode_chunk(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk in a row (int32), and where each text's begin."""
        n_docs = len(at) - 1
        data, at = self._prefixed(data, at)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n_docs + 1, np.int64)
        starts, ends = self._cut(data, at)
        keys = Rolling(data).of(starts, ends)
        uniq, one, back = np.unique(keys, return_index=True, return_inverse=True)
        place, length, known = self._find(uniq)
        if not known.all():
            if len(self.old[0]) + len(self.young[0]) + (~known).sum() > KEPT_UNITS:
                self._forget()
                known[:] = False
            new, keys_ = one[~known], uniq[~known]
            upto = np.cumsum(ends[new] - starts[new])
            a = 0
            while a < len(new):  # so many bytes at a time that the edges stay small
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + LEARN_BYTES, "right")))
                self._learn(keys_[a:b], data, starts[new[a:b]], ends[new[a:b]])
                a = b
            place, length, _ = self._find(uniq)
        place, length = place[back], length[back]
        upto = np.concatenate(([0], np.cumsum(length)))
        ids = self.flat[np.arange(upto[-1]) + np.repeat(place - upto[:-1], length)]
        return ids, upto[np.searchsorted(starts, at)]

    def _prefixed(self, data, at):
        """Spaces for U+2581, and one space before each text that isn't empty."""
        hit = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if len(data) > 2 else np.zeros(0, int)
        if len(hit):
            data = data.copy()
            data[hit] = 32
            keep = np.ones(len(data), bool)
            keep[hit + 1] = keep[hit + 2] = False
            at = np.concatenate(([0], np.cumsum(keep)))[at]
            data = data[keep]
        some = (np.diff(at) > 0).astype(np.int64)
        shift = np.concatenate(([0], np.cumsum(some)))
        out = np.full(len(data) + shift[-1], 32, np.uint8)
        out[np.arange(len(data)) + np.repeat(shift[1:], np.diff(at))] = data
        return out, at + shift

    # suffix array, edges, relaxation

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        length = ends - starts
        at = np.concatenate(([0], np.cumsum(length)))
        text = data[np.arange(at[-1]) + np.repeat(starts - at[:-1], length)]
        unit = np.repeat(np.arange(len(starts)), length)
        edge_from, edge_to, edge_id = self._edges(text, at, unit)
        ids, own = self._relax(text, at, unit, edge_from, edge_to, edge_id)
        self._keep(keys, ids.astype(np.int32), np.bincount(own, minlength=len(starts)))

    def suffixes(self, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions at which characters begin, sorted by the bytes that follow, and these bytes as big-endian words."""
        n = len(text)
        padded = np.concatenate((text, np.zeros(self.wide, np.uint8))).astype(np.uint64)
        word = np.zeros(n + self.wide - 8, np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | padded[k : k + len(word)]
        begin = np.flatnonzero((text & 0xC0) != 0x80)
        keys = [word[begin + 8 * k] for k in range(self.wide // 8)]
        order = np.argsort(keys[0], kind="stable")
        for depth in range(1, len(keys)):  # only runs that are still equal are sorted by the next word
            k = np.stack([x[order] for x in keys[:depth]])
            same = (k[:, 1:] == k[:, :-1]).all(0)
            tied = np.zeros(len(order), bool)
            tied[1:] |= same
            tied[:-1] |= same
            where = np.flatnonzero(tied)
            if not len(where):
                break
            run = np.cumsum(np.concatenate(([True], ~same)))[where]
            order[where] = order[where][np.lexsort((keys[depth][order[where]], run))]
        return begin[order], [x[order] for x in keys]

    def _bisect(self, keys: list[np.ndarray], wanted: np.ndarray, after: bool) -> np.ndarray:
        """Where each of wanted (words x pieces) belongs among the sorted suffixes: by the first word, and for pieces that
        are longer by the next words within the suffixes that share it."""
        out = np.searchsorted(keys[0], wanted[0], "right" if after else "left")
        long = np.flatnonzero(self.lengths > 8)
        lo, hi = np.searchsorted(keys[0], wanted[0][long], "left"), np.searchsorted(keys[0], wanted[0][long], "right")
        some = np.flatnonzero(lo < hi)
        out[long] = lo
        long, lo, hi = long[some], lo[some], hi[some]
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            less, equal = np.zeros(len(live), bool), np.ones(len(live), bool)
            for k, w in zip(keys[1:], wanted[1:], strict=True):
                x, y = k[mid], w[long[live]]
                less |= equal & (x < y)
                equal &= x == y
            go = less | equal if after else less
            lo[live[go]] = mid[go] + 1
            hi[live[~go]] = mid[~go]
        out[long] = lo
        return out

    def _edges(self, text, at, unit):
        sa, keys = self.suffixes(text)
        a, b = self._bisect(keys, self.low, False), self._bisect(keys, self.high, True)
        n = np.maximum(0, b - a)
        upto = np.concatenate(([0], np.cumsum(n)))
        start = sa[np.arange(upto[-1]) + np.repeat(a - upto[:-1], n)]
        piece = np.repeat(self.ids, n)
        end = start + np.repeat(self.lengths, n)
        ok = end <= at[unit[start] + 1]
        return start[ok], end[ok], piece[ok]

    def _relax(self, text, at, unit, start, end, piece):
        # characters that are no piece: an edge of their own, numbered after the vocabulary
        begin = np.flatnonzero((text & 0xC0) != 0x80)
        lead = text[begin]
        size = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        covered = np.zeros(len(text), bool)
        wide = np.zeros(len(text), np.int64)
        wide[begin] = size
        covered[start[end - start == wide[start]]] = True
        bare = ~covered[begin]
        chars = np.zeros(bare.sum(), np.int64)
        for k, (i, s) in enumerate(zip(begin[bare].tolist(), size[bare].tolist(), strict=True)):
            chars[k] = ord(text[i : i + s].tobytes().decode())
        start = np.concatenate((start, begin[bare]))
        end = np.concatenate((end, begin[bare] + size[bare]))
        piece = np.concatenate((piece, self.v.size + chars))
        level = end - at[unit[start]]
        order = np.argsort(level, kind="stable")
        start, end, piece, level = start[order], end[order], piece[order], level[order]
        last = np.full(len(text) + 1, -1, np.int64)  # by end: the last piece of what ends there
        origin = np.zeros(len(text) + 1, np.int64)
        cuts = np.flatnonzero(np.concatenate((level[1:] != level[:-1], [True]))) + 1 if len(level) else []
        a = 0
        for b in cuts:
            s, p, e = start[a:b], piece[a:b], end[a:b]
            ok = s == at[unit[s]]
            rest = np.flatnonzero(~ok)
            if len(rest):
                ok[rest] = self._apart(last[s[rest]], p[rest])
            last[e[ok]] = p[ok]
            origin[e[ok]] = s[ok]
            a = b
        # back from the ends of units
        now = at[1:].copy()
        out_id, out_unit, out_from = [], [], []
        live = np.arange(len(now))
        while len(live):
            e = now[live]
            out_id.append(last[e])
            out_unit.append(live)
            out_from.append(origin[e])
            now[live] = origin[e]
            live = live[now[live] > at[live]]
        ids, own, at_ = np.concatenate(out_id), np.concatenate(out_unit), np.concatenate(out_from)
        order = np.argsort(at_, kind="stable")
        ids, own = ids[order], own[order]
        wild = np.flatnonzero(ids >= self.v.size)
        if len(wild):
            parts = [[self.v.byte_ids.get(x, 0) for x in chr(i - self.v.size).encode()] for i in ids[wild].tolist()]
            n = np.ones(len(ids), np.int64)
            n[wild] = [len(p) for p in parts]
            upto = np.cumsum(n) - n
            ids, own = np.repeat(ids, n), np.repeat(own, n)
            for i, p in zip(upto[wild].tolist(), parts, strict=True):
                ids[i : i + len(p)] = p
        return ids, own

    def _name(self, i: int) -> str:
        return self.v.pieces[i] if i < self.v.size else chr(i - self.v.size)

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the two pieces' texts together leaves just these two."""
        key = (left << 32) | right
        uniq, back = np.unique(key, return_inverse=True)
        known, ok = np.zeros(len(uniq), bool), np.zeros(len(uniq), bool)
        for pairs, verdicts in (self.old_pairs, self.young_pairs):
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, uniq), len(pairs) - 1)
                hit = np.flatnonzero(pairs[at] == uniq)
                ok[hit], known[hit] = verdicts[at[hit]], True
        if not known.all():
            new = uniq[~known]
            verdict = np.zeros(len(new), bool)
            for i, k in enumerate(new.tolist()):
                a, b = self._name(k >> 32), self._name(k & 0xFFFFFFFF)
                verdict[i] = self.v.merge(a + b) == [a, b]
            ok[~known] = verdict
            if len(self.old_pairs[0]) + len(self.young_pairs[0]) + len(new) > KEPT_PAIRS:
                self._forget_pairs()
            self.young_pairs = self._merged(self.young_pairs, (new, verdict))
            if len(self.young_pairs[0]) > YOUNG_PAIRS:
                self.old_pairs, self.young_pairs = self._merged(self.old_pairs, self.young_pairs), tuple(x[:0] for x in self.young_pairs)
        return ok[back]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        raw = [vocabulary.bytes.get(i, b"") for i in range(vocabulary.size)]
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def decode_chunk(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of each text in a row, without the space that encoding put first, and where each begins."""
        begin, length = self.at[ids], self.at[ids + 1] - self.at[ids]
        upto = np.concatenate(([0], np.cumsum(length)))
        data = self.flat[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], length)]
        at = upto[at]
        first = at[:-1][(np.diff(at) > 0)]
        first = first[data[first] == 32]
        keep = np.ones(len(data), bool)
        keep[first] = False
        return data[keep], np.concatenate(([0], np.cumsum(keep)))[at]


_MADE: dict[str, tuple[Encoder, Decoder]] = {}


def _tools(shared) -> tuple[Encoder, Decoder]:
    """One encoder for each worker and model (by the digest of its file)."""
    key = shared.value.digest
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = (Encoder(shared.value), Decoder(shared.value))
    return _MADE[key]


def encode(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """doc_id, ids (as the model's own library encodes the text), decoded (what decoding them gives) and round_trip
    (decoded equals the text, U+2581 read as a space).

    A null text gives null ids and decoded, and a true round_trip; an empty one gives no ids. Texts of any length are
    encoded whole. Repeated rows are each encoded; other columns are ignored; an empty table gives an empty result. No
    shuffle. Memory: about 100 bytes a byte of the longest text or of CHUNK, and some 50 MB for units and pairs.
    """
    shared = broadcast_value(docs.sparkSession, Vocabulary(model_file))

    def run(batches):
        encoder, decoder = _tools(shared)
        for batch in batches:
            for own, data, at in text_chunks(batch, most=CHUNK):
                ids, cut = encoder.encode_chunk(data, at)
                plain, plain_at = decoder.decode_chunk(ids, cut)
                null = ~np.array(own.column(1).is_valid())
                mask = pa.array(null)
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()), mask=mask) if null.any() else pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))
                text = pa.StringArray.from_buffers(own.num_rows, pa.py_buffer(plain_at.astype(np.int32).tobytes()), pa.py_buffer(plain.tobytes()))
                same = [null[i] or np.array_equal(plain[plain_at[i] : plain_at[i + 1]], data[at[i] : at[i + 1]]) for i in range(own.num_rows)]
                for i in np.flatnonzero(~np.array(same, bool)):
                    same[i] = plain[plain_at[i] : plain_at[i + 1]].tobytes().decode() == data[at[i] : at[i + 1]].tobytes().decode().replace(SPACE, " ")
                if null.any():
                    text = pa.array([None if x else t for x, t in zip(null, text.to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([own.column(0), lists, text, pa.array(same, pa.bool_())], ["doc_id", "ids", "decoded", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded string, round_trip boolean")
