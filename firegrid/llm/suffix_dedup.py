"""Exact removal of repeated byte strings by a sampled suffix array.

A suffix (cut to the least length) matters only if it repeats. Which may do so is found by anchors: the least hash among
a suffix's 16-byte grams is the same in all its copies. Anchors seen in one text alone are dropped; the suffixes at the
others are range-partitioned by the bytes at their anchor with sampled splitters and sorted in their partition by several
keys in turn: by their first word of 8 bytes, then, as in multikey quicksort, only runs that are still equal by the next
word (numpy's sort stands in for the three-way partition). Runs of equal suffixes give the least document of each. A
partition is worked on in pieces that end where the leading bytes change, so no run crosses a boundary and none has to be
compared across. Leading bytes that the sample shows to be common would be one task's: their suffixes go one by one, each
by a hash of all its bytes. Copies of a whole text are one class from the start.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Rolling, Scratch, broadcast_value, parts_for, stored, text_buffers, text_chunks, tidy

GRAM = 16
#: Bytes of text whose anchors a task gathers before it sends them on.
FLUSH_BYTES = 24 << 20
#: Bytes of one text that are looked at in one step; steps overlap, and every suffix is in one.
STEP_BYTES = 1 << 21
#: Bytes of surroundings whose suffixes are sorted at once.
SORT_BYTES = 2 << 20
#: Surroundings a task remembers, to send equal ones of larger documents no further.
KNOWN = 300_000
#: Texts that are sampled for splitters, and how many bytes at most of each.
SAMPLE_TEXTS, SAMPLE_BYTES = 2000, 1 << 13
#: Leading bytes that this many sampled texts hold (one in 20) are common. What is rarer than that stays one task's.
COMMON = 100
#: Most fingerprints that are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
_LOW = np.uint64((1 << 23) - 1)


def anchors(data: np.ndarray, at: np.ndarray, least: int):
    """Anchors of the suffixes of a chunk: (row, anchor position, first suffix, last suffix, gram hash), positions in the
    chunk. Suffix i is data[i : i + least]; each that lies in one row belongs to one anchor."""
    none = np.zeros(0, np.int64)
    out = []
    if len(data) <= STEP_BYTES:
        steps = [(0, len(data), at, 0)]
    else:  # a chunk this large is one long text
        steps = [(a, min(len(data), a + STEP_BYTES + least - 1), None, a) for r in range(len(at) - 1) for a in range(at[r], max(at[r] + 1, at[r + 1] - least + 1), STEP_BYTES)]
        ends = {int(a): int(at[r + 1]) for r in range(len(at) - 1) for a in range(at[r], max(at[r] + 1, at[r + 1] - least + 1), STEP_BYTES)}
        steps = [(a, min(b, ends[int(a)]), None, a) for a, b, _, _ in steps]
    for a, b, cut, base in steps:
        part = data[a:b]
        n = len(part) - least + 1
        if n <= 0:
            continue
        cut = np.array([0, len(part)]) if cut is None else cut
        index = np.arange(len(part) - GRAM + 1)
        h = Rolling(part, plain=True).of(index, index + GRAM)
        least_of = (h & ~_LOW) | index.astype(np.uint64)
        width, have = least - GRAM + 1, 1
        run = least_of
        while have * 2 <= width:
            run = np.minimum(run[: len(run) - have], run[have:])
            have *= 2
        if have < width:
            run = np.minimum(run[:n], run[width - have : width - have + n])
        ok = np.ones(n, bool)
        for r in np.flatnonzero(np.diff(cut) > 0):
            ok[max(cut[r], cut[r + 1] - least + 1) : min(cut[r + 1], n)] = False
        where = np.flatnonzero(ok)
        if not len(where):
            continue
        pos = (run[where] & _LOW).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (pos[1:] != pos[:-1]) | (where[1:] != where[:-1] + 1))))
        first, last = where[new], where[np.concatenate((new[1:], [len(where)])) - 1]
        pos = pos[new]
        row = np.searchsorted(at, first + base, "right") - 1
        out.append((row, pos + base, first + base, last + base, h[pos]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none, none, np.zeros(0, np.uint64))


def _short(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32 more bits of a gram hash."""
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64), h.astype(np.uint32)


def _repeated_anchors(docs: DataFrame, least: int) -> DataFrame:
    """(f1, marks): for texts (by fingerprint) the short hashes of anchors that other texts hold too. docs: (f1, text)."""
    buckets = max(32, parts_for(docs, 2.0))

    def gather(batches):
        z = zstandard.ZstdCompressor(level=1)
        keys, owners, size, seen = [], [], 0, set()

        def flush():
            h, own = np.concatenate(keys), np.concatenate(owners)
            bucket, short = _short(h, buckets)
            order = np.lexsort((own, short, bucket))
            bucket, short, own = bucket[order], short[order], own[order]
            fresh = np.ones(len(own), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (short[1:] != short[:-1]) | (bucket[1:] != bucket[:-1])
            bucket, short, own = bucket[fresh], short[fresh], own[fresh]
            head = np.ones(len(own), bool)
            head[1:] = (short[1:] != short[:-1]) | (bucket[1:] != bucket[:-1])
            tail = np.concatenate((head[1:], [True]))
            here = ~(head & tail)  # held by several texts of this task: known here, and one of them tells the others
            rows = []
            for k, pick in enumerate((head, here)):
                b, s, o = bucket[pick], short[pick], own[pick]
                if not len(b):
                    continue
                by = np.lexsort((o, b))
                b, s, o = b[by], s[by], o[by]
                cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
                for i, j in zip(cut, [*cut[1:], len(b)], strict=True):
                    rows.append((int(b[i]), bool(k), z.compress(o[i:j].tobytes()), s[i:j].tobytes()))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["bucket", "known", "owners", "marks"])

        for batch in batches:
            for own, data, at in text_chunks(batch):
                f = own.column(0).to_numpy(zero_copy_only=False)
                row, _, _, _, h = anchors(data, at, least)
                once = np.zeros(len(f), bool)
                for i, x in enumerate(f.tolist()):
                    if x not in seen:
                        once[i] = True
                        seen.add(x)
                pick = once[row]
                if pick.any():
                    keys.append(h[pick])
                    owners.append(f[row[pick]])
                size += len(data)
                if size >= FLUSH_BYTES and keys:
                    yield flush()
                    keys, owners, size = [], [], 0
        if keys:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        own, short, known = [], [], []
        for k, o, m in zip(*(table.column(c).to_pylist() for c in ("known", "owners", "marks")), strict=True):
            own.append(np.frombuffer(z.decompress(o), np.int64))
            short.append(np.frombuffer(m, np.uint32))
            known.append(np.full(len(short[-1]), k))
        own, short, known = np.concatenate(own), np.concatenate(short), np.concatenate(known)
        order = np.lexsort((own, short))
        own, short, known = own[order], short[order], known[order]
        start = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
        several = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
        pick = known | np.repeat(several, np.diff(np.concatenate((start, [len(short)]))))
        own, short = own[pick], short[pick]
        by = np.lexsort((short, own))
        own, short = own[by], short[by]
        cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        lists = [short[i:j].tobytes() for i, j in zip(cut, [*cut[1:], len(own)], strict=True)] if len(own) else []
        return pa.table({"f1": pa.array(own[cut], pa.int64()), "marks": pa.array(lists, pa.binary())})

    sent = docs.mapInArrow(tidy(gather), "bucket int, known boolean, owners binary, marks binary")
    # what a task knows already needs no meeting: salted, so that a common string's owners don't pile up
    dealt = sent.withColumn("salt", F.when(F.col("known"), F.pmod(F.xxhash64("owners"), F.lit(buckets))).otherwise(F.lit(0)))
    met = dealt.groupBy("bucket", "salt", "known").applyInArrow(meet, "f1 long, marks binary")
    return met.groupBy("f1").agg(F.collect_list("marks").alias("marks"))


def _splitters(docs: DataFrame, n_docs: int, least: int, parts: int) -> tuple[np.ndarray, frozenset[int]]:
    """Leading keys that cut the anchors of a few sampled texts into equal parts, and keys that COMMON of these texts hold.
    Both decide about balance alone; at most SAMPLE_TEXTS x SAMPLE_BYTES reach the driver."""
    share = min(1.0, 1.5 * SAMPLE_TEXTS / max(1, n_docs))
    sampled = docs if share == 1.0 else docs.sample(False, share, 11)
    texts = [r[0].encode()[:SAMPLE_BYTES] for r in sampled.select(F.substring("text", 1, SAMPLE_BYTES)).limit(SAMPLE_TEXTS).collect()]
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    leads, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in _pieces(at, CHUNK_BYTES):  # arrays of a step are some 60 times its bytes, and the driver has little room
        part = data[at[lo] : at[hi]]
        row, pos, *_ = anchors(part, at[lo : hi + 1] - at[lo], least)
        lead = np.zeros(len(pos), np.uint64)
        for k in range(8):  # an anchor has 16 bytes
            lead = (lead << np.uint64(8)) | part[pos + k]
        leads.append(lead)
        owners.append(row + lo)
    lead, own = np.concatenate(leads), np.concatenate(owners)
    order = np.lexsort((own, lead))
    lead, own = lead[order], own[order]
    once = np.ones(len(lead), bool)
    once[1:] = (lead[1:] != lead[:-1]) | (own[1:] != own[:-1])
    found, count = np.unique(lead[once], return_counts=True)
    common = found[count >= COMMON]
    rest = lead[~np.isin(lead, common)]
    cuts = np.unique(rest[np.linspace(0, len(rest) - 1, parts + 1).astype(int)[1:-1]]) if len(rest) else rest
    return cuts, frozenset(common.tolist())


def _surroundings(texts: DataFrame, least: int, splitters: np.ndarray, common: frozenset[int], parts: int) -> DataFrame:
    """(part, lead, f1, cid, first, around) of each repeated anchor: its suffixes are around[j : j + least]. Where a task
    knows the same surroundings from a smaller document, around is null and lead holds the end of the removed range, for
    nothing has to be compared; such rows go to any part. At common leading bytes each suffix is a row of its own, and
    part and lead are a hash of it. texts: (f1, cid, packed, marks)."""
    shared = broadcast_value(texts.sparkSession, (splitters, common))

    def cut(batches):
        z, known = zstandard.ZstdDecompressor(), {}
        splitters, common = shared.value

        def first_known(around, owner):
            """Whether a smaller document is known to hold this; if not, this one is."""
            before = known.get(around)
            if before is not None and before < owner:
                return True
            if before is None or owner < before:
                if len(known) > KNOWN:
                    known.clear()
                known[around] = owner
            return False

        done: set[int] = set()
        for batch in batches:
            f1, cid, packed, marks = (c.to_pylist() for c in batch.columns)
            for a in range(0, len(f1), 64):
                pick = [k for k in range(a, min(len(f1), a + 64)) if f1[k] not in done]
                done.update(f1[k] for k in pick)
                raw = [z.decompress(packed[k]) for k in pick]
                at = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
                data = np.frombuffer(b"".join(raw), np.uint8)
                for lo, hi in _pieces(at):
                    part, own = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                    row, pos, first, last, h = anchors(part, own, least)
                    short = h.astype(np.uint32)
                    bound = np.searchsorted(row, np.arange(hi - lo + 1))
                    keep = np.zeros(len(row), bool)
                    for r in range(hi - lo):
                        mine = slice(bound[r], bound[r + 1])
                        keep[mine] = np.isin(short[mine], np.frombuffer(b"".join(marks[pick[lo + r]]), np.uint32))
                    row, pos, first, last = row[keep], pos[keep], first[keep], last[keep]
                    text, rows = part.tobytes(), []
                    lead = [int.from_bytes(text[p : p + 8]) for p in pos.tolist()]
                    where = np.searchsorted(splitters, np.array(lead, np.uint64), "right").tolist()
                    for r, i, j, key, to in zip(row.tolist(), first.tolist(), last.tolist(), lead, where, strict=True):
                        k = pick[lo + r]
                        base = int(own[r])
                        if key not in common:
                            around = text[i : j + least]
                            if first_known(around, cid[k]):
                                rows.append((f1[k] % parts, j + least - base, f1[k], cid[k], i - base, None))
                            else:
                                rows.append((to, key - (1 << 63), f1[k], cid[k], i - base, around))
                            continue
                        open_ = None  # where a run of suffixes that are known began
                        for q in range(i, j + 1):
                            suffix = text[q : q + least]
                            if first_known(suffix, cid[k]):
                                open_ = q if open_ is None else open_
                                continue
                            if open_ is not None:
                                rows.append((f1[k] % parts, q - 1 + least - base, f1[k], cid[k], open_ - base, None))
                                open_ = None
                            x = int.from_bytes(hashlib.blake2b(suffix, digest_size=8).digest())
                            rows.append((x % parts, x - (1 << 63), f1[k], cid[k], q - base, suffix))
                        if open_ is not None:
                            rows.append((f1[k] % parts, j + least - base, f1[k], cid[k], open_ - base, None))
                    cols = list(zip(*rows, strict=True)) or [()] * 6
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "lead", "f1", "cid", "first", "around"])

    return texts.select("f1", "cid", "packed", "marks").mapInArrow(tidy(cut), "part int, lead long, f1 long, cid long, first long, around binary")


def _pieces(at: np.ndarray, most: int = STEP_BYTES):
    """Rows in pieces of at most `most` bytes, or one longer row."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def least_owner(data: np.ndarray, at: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, least owner among all rows) of each suffix of each row: a multikey quicksort of the suffixes."""
    count = np.diff(at) - least + 1
    wide = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | wide[k : k + len(words)]
    upto = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(count)), count)
    offset = np.arange(upto[-1]) - upto[row]
    start = at[row] + offset
    depths = [*range(0, least - 7, 8)]
    if depths[-1] + 8 < least:
        depths.append(least - 8)
    w = words[start]
    order = np.argsort(w, kind="stable")
    w = w[order]
    bound = np.ones(len(order), bool)  # where a run of equal suffixes begins
    bound[1:] = w[1:] != w[:-1]
    at_ = None
    for d in depths[1:]:
        inside = ~bound
        inside[:-1] |= ~bound[1:]
        at_ = np.flatnonzero(inside)  # only what is still equal to a neighbour is sorted on
        if not len(at_):
            break
        run = np.cumsum(bound)[at_]
        w = words[start[order[at_]] + d]
        if ((w[1:] != w[:-1]) & (run[1:] == run[:-1])).any():
            by = np.lexsort((w, run))
            order[at_] = order[at_[by]]
            w = w[by]
        bound[at_] |= np.concatenate(([True], (w[1:] != w[:-1]) | (run[1:] != run[:-1])))
    heads = np.flatnonzero(bound)
    best = np.minimum.reduceat(owner[row][order], heads) if len(order) else owner[:0]
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(best, np.diff(np.concatenate((heads, [len(order)]))))
    return row, offset, out


def _spans(around: DataFrame, least: int, parts: int) -> DataFrame:
    """(f1, start, stop): ranges that go, from the sorted suffixes of each range of leading keys."""

    def sort(batches):
        names = ["f1", "start", "stop"]

        def work(table):
            lead = table.column("lead").to_numpy()
            alone = np.ones(len(lead), bool)  # a leading key that no other row has
            alone[1:] &= lead[1:] != lead[:-1]
            alone[:-1] &= lead[:-1] != lead[1:]
            table = table.filter(pa.array(~alone))
            f1, owner, first = (table.column(c).to_numpy() for c in ("f1", "cid", "first"))
            if not len(f1):
                return pa.RecordBatch.from_arrays([pa.array(f1, pa.int64())] * 3, names)
            data, at = text_buffers(table.column("around"))
            row, offset, best = least_owner(data, at, owner, least)
            gone = np.flatnonzero(best < owner[row])
            row, offset = row[gone], offset[gone]
            cut = np.flatnonzero((row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)) if len(row) else np.zeros(0, np.int64)
            a, b = np.concatenate(([0], cut + 1))[: len(row)], np.concatenate((cut, [len(row) - 1]))[: len(cut) + (len(row) > 0)]
            return pa.RecordBatch.from_arrays([pa.array(f1[row[a]]), pa.array(first[row[a]] + offset[a]), pa.array(first[row[b]] + offset[b] + least)], names)

        held, size = [], 0
        for batch in batches:
            whole = batch.column(batch.schema.get_field_index("around")).is_valid()
            ready = batch.filter(pc.invert(whole))
            if ready.num_rows:
                yield pa.RecordBatch.from_arrays([ready.column("f1"), ready.column("first"), ready.column("lead")], names)
            rest = batch.filter(whole)
            if not rest.num_rows:
                continue
            if size >= SORT_BYTES:
                lead = rest.column("lead").to_numpy()
                last = held[-1].column("lead")[-1].as_py()
                new = int(np.searchsorted(lead, last, "right"))  # rows of the key that is open belong to it
                if new < len(lead):
                    yield work(pa.Table.from_batches([*held, rest.slice(0, new)]))
                    rest, held, size = rest.slice(new), [], 0
            held.append(rest)
            size += rest.column("around").nbytes
        if held:
            yield work(pa.Table.from_batches(held))

    ranged = around.repartitionById(parts, F.col("part")).sortWithinPartitions("lead")  # a part is a task: hashes of parts would meet
    return ranged.select("lead", "f1", "cid", "first", "around").mapInArrow(tidy(sort), "f1 long, start long, stop long")


def _fingers(n_bytes: str = "n_bytes") -> dict:
    return {"f1": F.xxhash64(F.lit(1), "text"), "f2": F.xxhash64(F.lit(2), "text"), n_bytes: F.octet_length("text").cast("long")}


def _keys(marks: DataFrame, held: Scratch):
    """A function that adds the column key to a table with (f1, f2, n_bytes): one number for each text.

    That is f1, except where texts that differ in f2 or length share it, as some do among very many texts: there all three
    are hashed anew, until no two texts share a key."""
    added: list[tuple[int, DataFrame]] = []

    def keyed(df: DataFrame) -> DataFrame:
        df = df.withColumn("key", F.col("f1"))
        for seed, shared in added:
            df = df.join(shared, "key", "left").withColumn("key", F.when(F.col("shared__"), F.xxhash64(F.lit(seed), "f1", "f2", "n_bytes")).otherwise(F.col("key"))).drop("shared__")
        return df

    for seed in range(101, 109):
        text = F.struct("f1", "f2", "n_bytes")
        shared = held.stored(keyed(marks.select("f1", "f2", "n_bytes")).groupBy("key").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b").select("key", F.lit(True).alias("shared__")), "shared")
        n = shared.count()
        if not n:
            return keyed
        added.append((seed, F.broadcast(shared) if n <= BROADCAST_KEYS else shared))
    raise RuntimeError("fingerprints of texts stay equal")


def repeated_spans(docs: DataFrame, least: int, held: Scratch, fingers: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marks, spans, packed). marks: (doc_id, n_bytes, f1, f2, key, whole, cid) of each row; spans: (key, starts, ends),
    removed ranges of each text when its least document asks, unmerged; packed: (key, packed) of texts, copies included."""
    fingered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns(fingers or _fingers())
    marks = held.stored(fingered.select("doc_id", "n_bytes", "f1", "f2", F.sha2("text", 256).alias("whole")), "marks")
    large = F.col("doc_id").isNotNull() & (F.col("n_bytes") >= least)
    keyed = _keys(marks.where(large), held)
    marks = keyed(marks)
    long_enough = keyed(fingered.where(large)).select("doc_id", F.col("key").alias("f1"), "text")
    classes = marks.where(large).groupBy(F.col("key").alias("f1")).agg(F.min("doc_id").alias("cid"))
    again = held.stored(_repeated_anchors(long_enough.select("f1", "text"), least).join(classes, "f1"), "anchors")

    def pack(batches):
        z, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            for own, data, at in text_chunks(batch):
                raw, f1, packed = data.tobytes(), [], []
                for f, a, b in zip(own.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                    if f not in seen:  # a task sends copies of a text once
                        seen.add(f)
                        f1.append(f)
                        packed.append(z.compress(raw[a:b]))
                yield pa.RecordBatch.from_arrays([pa.array(f1, pa.int64()), pa.array(packed, pa.binary())], ["f1", "packed"])

    # one query from here on, so that the texts, needed twice, are shuffled by fingerprint once
    packed = long_enough.select("f1", "text").mapInArrow(tidy(pack), "f1 long, packed binary")
    parts = max(16, parts_for(docs, 2.0))
    splitters, common = _splitters(long_enough, marks.count(), least, parts)
    around = _surroundings(packed.join(again.hint("merge"), "f1"), least, splitters, common, parts)
    spans = _spans(around, least, parts).groupBy("f1").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("ends"))
    return marks.join(classes.withColumnRenamed("f1", "key"), "key", "left"), spans, packed


def _merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(docs: DataFrame, least: int, held: Scratch, fingers: dict | None = None) -> DataFrame:
    """doc_id, n_bytes, f1, f2, n_removed, kept_sha256, removed of each row of docs."""
    marks, spans, packed = repeated_spans(docs, least, held, fingers)

    def apply(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for f1, packed, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, gone = z.decompress(packed), _merged(starts, ends)
                digest, at = hashlib.sha256(), 0
                for a, b in gone:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((f1, sum(b - a for a, b in gone), digest.hexdigest(), [{"start": a, "end": b} for a, b in gone]))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], kind)], ["key", "gone", "kept", "ranges"])

    cut = packed.join(spans.hint("merge"), "f1").select("f1", "packed", "starts", "ends").mapInArrow(tidy(apply), "key long, gone long, kept string, ranges array<struct<start:long,end:long>>").dropDuplicates(["key"])
    copy = (F.col("doc_id") > F.col("cid")) & (F.col("n_bytes") >= least)
    own = (F.col("doc_id") == F.col("cid")) & (F.col("n_bytes") >= least) & F.col("gone").isNotNull()
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:long,end:long>>")
    return marks.join(cut, "key", "left").select(
        "doc_id",
        "n_bytes",
        "f1",
        "f2",
        F.when(copy, F.col("n_bytes")).when(own, F.col("gone")).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(own, F.col("kept")).otherwise(F.col("whole")).alias("kept_sha256"),
        F.when(copy, whole).when(own, F.col("ranges")).otherwise(none).alias("removed"),
    )


def suffix_dedup(docs: DataFrame, least: int = 50, fingers: dict | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of {start, end} in bytes) for each row of docs.

    A byte goes if a string of `least` bytes over it also starts in a document with a smaller doc_id. Null texts are empty.
    Rows that share a doc_id don't remove each other's bytes. A row with a null doc_id loses nothing and makes no other
    lose anything. Texts shorter than `least` are kept whole. An empty table gives an empty result; other columns are
    ignored; texts of any length are looked at whole (anchors in steps of STEP_BYTES). fingers: columns f1, f2 and n_bytes
    that tell texts apart; f1 alone may be shared.
    """
    held = Scratch(docs.sparkSession)
    out = _removed(docs, least, held, fingers).drop("f1", "f2").withColumn("n_spans", F.size("removed").cast("long"))
    out = stored(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"), "suffix-dedup")
    held.clear()
    return out


def strip_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """The rows of docs, all columns, whatever they are called, with the removed bytes cut out of text (what is left of a
    cut character goes too).

    Same rules as suffix_dedup: rows of one doc_id with different texts are cut each by its own ranges, a repeated row
    comes back as often as it is there, a row with a null doc_id or text as it is, a copy of another's text with an empty
    text; an empty table gives an empty result."""
    held = Scratch(docs.sparkSession)
    ranges = stored(_removed(docs, least, held).where("n_removed > 0").select(F.col("doc_id").alias("id"), "f1", "f2", "removed").dropDuplicates(["id", "f1", "f2"]), "removed")
    held.clear()
    columns, kind = docs.columns, docs.schema
    t = next(i for i, c in enumerate(columns) if c.lower() == "text")
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), *[c.alias(k) for k, c in _fingers().items() if k != "n_bytes"])
    joined = own.join(ranges, ["id", "f1", "f2"], "left").select("row", "removed")

    def strip(batches):
        for batch in batches:
            fields, removed = batch.column(0).flatten(), batch.column(1)
            hit = np.flatnonzero(removed.is_valid().to_numpy(zero_copy_only=False)).tolist()
            if hit:
                texts = fields[t].to_pylist()
                for i in hit:
                    raw, at, kept = texts[i].encode(), 0, []
                    for x in removed[i].as_py():
                        kept.append(raw[at : x["start"]])
                        at = x["end"]
                    texts[i] = b"".join([*kept, raw[at:]]).decode(errors="ignore")
                fields[t] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(fields, columns)

    return joined.mapInArrow(tidy(strip), kind)
