"""N-gram Jaccard join by T-occurrence search (DivideSkip), exact, without a row for each pair.

Texts with the same shingle set form a class. If 100 I >= pct U, the partners share a shingle among the
n - ceil(pct n / 100) + 1 first ones of either set in any common order; rare ones come first, so these are the short
inverted lists, and they alone are shuffled, once, sorted by shingle over ranges, so that a long list is cut between tasks.
In each list the least class is the pivot: every other member is searched with the pivot as the query. Lists with members
that this leaves apart are looked at in tiles of bounded size. Before texts move, counts of shingles by parts of the hash
space, kept with the signature, bound each overlap from above, and only the pairs left are searched; a tile with many
is searched as a whole, where a query is spared if all that it could link is linked. A search merges the short lists of the
query with a heap, and probes the long ones by bisection for what occurs often enough.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from firegrid.operators.links import components

from .common import LOWER, Rolling, Scratch, broadcast_value, grams, mix, parts_for, stored, text_chunks, tidy, word_spans

#: A shingle seen this often within one step of the scan is counted for the order of shingles.
SEEN_OFTEN = 3
#: Bytes of text in such a step.
COUNT_BYTES = 16 << 20
#: Most shingles whose frequency the order knows; the others count as rare. It decides about cost, not about results.
ORDER_ROWS = 1_000_000
#: Members of a pivot, or of half a tile, that are searched in one piece.
PIECE = 256
#: Parts of the hash space in which shingles are counted to bound an overlap.
CELLS = 256
#: Most ids that are broadcast to pick texts (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Most ids of rows that go that are sent to every task, sorted (8 bytes each); more are joined by a shuffle of the rows.
DROPPED_IDS = 4_000_000


def text_hash() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and where each text's begin."""
    n_docs = len(at) - 1
    low = LOWER[data]
    starts, ends, rows = word_spans(data, at)
    words = Rolling(low).of(starts, ends)
    keys, first = grams(words, rows, n)
    of = rows[first] if len(first) else np.zeros(0, np.int64)
    count = np.bincount(rows, minlength=n_docs)
    for k in range(1, n):  # texts of fewer words: all of them as one shingle
        short = np.flatnonzero(count == k)
        if len(short):
            begin = np.concatenate(([0], np.cumsum(count)))[short]
            h = np.full(len(short), np.uint64(k), np.uint64)
            for j in range(k):
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[begin + j])
            keys, of = np.concatenate((keys, h)), np.concatenate((of, short))
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    keys, of = keys[new], of[new]
    return keys, np.searchsorted(of, np.arange(n_docs + 1))


def required(n_a, n_b, pct: int):
    """The least overlap of sets of these sizes that makes a link."""
    return -(-pct * (n_a + n_b) // (100 + pct))


def divide_skip(query: np.ndarray, tokens: np.ndarray, owners: np.ndarray, sizes: np.ndarray, pct: int) -> list[int]:
    """The members (0 to len(sizes)-1) that link with the query.

    tokens, owners: the members' shingles sorted by shingle, then member: inverted lists end to end.
    """
    if not len(query) or not len(sizes):
        return []
    need = required(len(query), sizes, pct)
    fits = (100 * np.minimum(len(query), sizes) >= pct * np.maximum(len(query), sizes)) & (sizes > 0)
    if not fits.any():
        return []
    least = int(need[fits].min())
    a, b = np.searchsorted(tokens, query, "left"), np.searchsorted(tokens, query, "right")
    length = b - a
    order = np.argsort(length, kind="stable")
    n_long = max(0, least - max(1, least // 16))  # so a candidate must occur in least - n_long short lists
    n_long = min(n_long, len(query) - 1)
    short, long = order[: len(query) - n_long], order[len(query) - n_long :]
    seen: dict[int, int] = {}
    lists = [owners[a[k] : b[k]].tolist() for k in short if length[k]]
    for m in heapq.merge(*lists) if len(lists) > 1 else (lists[0] if lists else ()):
        seen[m] = seen.get(m, 0) + 1
    found = np.array(sorted(m for m, c in seen.items() if c >= least - n_long and fits[m]), np.int64)
    if not len(found):
        return []
    count = np.array([seen[m] for m in found.tolist()])
    long = long[length[long] > 0]
    if len(long):
        wide = len(sizes)
        upto = np.concatenate(([0], np.cumsum(length[long])))
        index = np.arange(upto[-1]) + np.repeat(a[long] - upto[:-1], length[long])
        rows = np.repeat(np.arange(len(long)), length[long]) * wide + owners[index]
        probes = (np.arange(len(long)) * wide)[:, None] + found
        at = np.minimum(np.searchsorted(rows, probes), len(rows) - 1)  # a bisection of each long list for each candidate
        count = count + (rows[at] == probes).sum(0)
    return found[count >= need[found]].tolist()


class Lists:
    """Inverted lists of some texts."""

    def __init__(self, texts: list[bytes], n: int):
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        self.keys, self.at = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), at, n)
        self.sizes = np.diff(self.at)
        own = np.repeat(np.arange(len(texts)), self.sizes)
        order = np.argsort(self.keys, kind="stable")
        self.tokens, self.owners = self.keys[order], own[order]

    def set_of(self, k: int) -> np.ndarray:
        return self.keys[self.at[k] : self.at[k + 1]]


def _frequent(docs: DataFrame, n: int) -> DataFrame:
    """(token, df): shingles that occur often within a step of the scan, and how often in all such steps."""

    def count(batches):
        held, size = [], 0

        def flush():
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= SEEN_OFTEN
            return pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(times[often], pa.int64())], ["token", "df"])

        for batch in batches:
            for _, data, at in text_chunks(batch):
                held.append(shingle_sets(data, at, n)[0])
                size += len(data)
                if size >= COUNT_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(tidy(count), "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


def signatures(docs: DataFrame, n: int, pct: int) -> DataFrame:
    """(doc_id, t, n_shingles, f1, f2, prefix, cells): hash of the text, size and fingerprint of each set, its rarest
    shingles, and how many of its shingles fall into each of CELLS parts of the hash space. prefix and cells are null for an empty set and where
    the task has seen the set before. The sum of the lesser counts of two sets is at least their overlap."""
    top = _frequent(docs, n).orderBy(F.desc("df"), "token").limit(ORDER_ROWS).toArrow()
    known = top.column("token").to_numpy().view(np.uint64)
    level = np.ceil(np.log2(top.column("df").to_numpy().astype(float) + 1)).astype(np.uint8)
    by = np.argsort(known)
    shared = broadcast_value(docs.sparkSession, (known[by], level[by]))  # at most ORDER_ROWS rows of 9 bytes

    def sign(batches):
        known, level = shared.value
        z = zstandard.ZstdCompressor(level=1)
        seen: set[int] = set()
        for batch in batches:
            for own, data, at in text_chunks(batch):
                keys, cut = shingle_sets(data, at, n)
                size = np.diff(cut)
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys ^ np.uint64(0xA5A5)), dtype=np.uint64)))
                f1 = sums[cut[1:]] - sums[cut[:-1]]
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(keys + np.uint64(77)), dtype=np.uint64)))
                f2 = sums[cut[1:]] - sums[cut[:-1]]
                rank = np.zeros(len(keys), np.uint8)
                if len(known):
                    where = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    rank = np.where(known[where] == keys, level[where], 0).astype(np.uint8)
                of = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((keys, rank, of))
                nth = np.arange(len(keys)) - np.repeat(cut[:-1], size)
                length = np.where(size > 0, size - (-(-pct * size // 100)) + 1, 0)
                fresh = np.zeros(len(size), bool)
                for i, f in enumerate((f1 ^ mix(f2)).tolist()):
                    if size[i] and f not in seen:
                        fresh[i] = True
                        seen.add(f)
                length = np.where(fresh, length, 0)
                pick = nth < np.repeat(length, size)
                ends = np.concatenate(([0], np.cumsum(length)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[order][pick].view(np.int64)), mask=pa.array(~fresh))
                flat = of * CELLS + (keys >> np.uint64(40)).astype(np.int64) % CELLS
                counts = np.bincount(flat, minlength=len(size) * CELLS).astype(np.int32).reshape(-1, CELLS)
                cells = pa.array([z.compress(c.tobytes()) if new else None for c, new in zip(counts, fresh.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(size, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists, cells], ["doc_id", "t", "n_shingles", "f1", "f2", "prefix", "cells"]
                )

    return docs.select(F.col("doc_id").cast("long"), text_hash(), "text").mapInArrow(tidy(sign), "doc_id long, t long, n_shingles long, f1 long, f2 long, prefix array<long>, cells binary")


def _lists(listed: DataFrame, held: Scratch, parts: int) -> DataFrame:
    """(token, cid, size, pivot, pivot_size, wide) of listed (token, cid, size), for shingles with several members. wide is
    false where a list is known to have two members only.

    Rows are sorted over ranges of (token, cid), so a list may be cut between tasks; each task names the least member it
    sees, and a row for the first and last list of each task, two for a task, puts the cut ones right.
    """

    def walk(batches):
        first, last, wait = None, None, [np.zeros(0, np.int64)] * 3

        def rows(token, cid, size, pivot, pivot_size, wide, edge):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (token, cid, size, pivot, pivot_size, wide, np.full(len(token), edge))], ["token", "cid", "size", "pivot", "pivot_size", "wide", "edge"])

        for batch in batches:
            token, cid, size = (np.concatenate((w, c.to_numpy())) for w, c in zip(wait, batch.columns, strict=True))
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            new[0] = last is None or token[0] != last[0]
            group = np.cumsum(new)  # 0: goes on from the batch before
            starts = np.flatnonzero(new)
            pivot = np.concatenate(([last[1] if last else 0], cid[starts]))[group]
            pivot_size = np.concatenate(([last[2] if last else 0], size[starts]))[group]
            if first is None:
                first = (token[0], cid[0], size[0])
            length = np.bincount(group)[group]
            single = (length == 1) & (group > 0)
            wide = (length > 2) | (group == 0) | (group == group[-1]) | (token == first[0])
            wait = [x[-1:] if single[-1] else x[:0] for x in (token, cid, size)]
            end = len(token) - len(wait[0])
            if end:
                last = (token[end - 1], pivot[end - 1], pivot_size[end - 1])
            keep = np.flatnonzero(~single[:end] | (token[:end] == first[0]))
            yield rows(token[keep], cid[keep], size[keep], pivot[keep], pivot_size[keep], wide[keep], False)
        if len(wait[0]):
            token, cid, size = wait
            yield rows(token, cid, size, cid, size, np.ones(1, bool), False)
            last = (token[0], cid[0], size[0])
        if first is not None:
            token, cid, size = (np.array(x, np.int64) for x in zip(first, last, strict=True))
            yield rows(token, cid, size, cid, size, np.ones(2, bool), True)

    dealt = listed.repartitionByRange(parts, "token", "cid").sortWithinPartitions("token", "cid")
    found = held.stored(dealt.select("token", "cid", "size").mapInArrow(tidy(walk), "token long, cid long, size long, pivot long, pivot_size long, wide boolean, edge boolean"), "lists")
    least = F.min(F.struct("pivot", "pivot_size"))
    cut = found.where("edge").groupBy("token").agg(least.alias("least"), F.countDistinct("pivot").alias("k")).where("k > 1")
    cut = F.broadcast(cut.select("token", "least"))  # at most two rows for each of the tasks
    return found.where("not edge").join(cut, "token", "left").select(
        "token", "cid", "size", F.coalesce("least.pivot", "pivot").alias("pivot"), F.coalesce("least.pivot_size", "pivot_size").alias("pivot_size"), "wide"
    )


def _packed(docs: DataFrame) -> DataFrame:
    """(cid, packed) of docs (cid, text): texts as zstd frames, which move as a third of their bytes."""

    def pack(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for own, data, at in text_chunks(batch):
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([z.compress(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["cid", "packed"])

    return docs.select("cid", "text").mapInArrow(tidy(pack), "cid long, packed binary")


def _pivot_links(rows: DataFrame, n: int, pct: int, parts: int) -> DataFrame:
    """Links (a, b) between each pivot and its members. rows: (pivot, salt, cid, packed); cid = pivot is the query."""

    def search(batches):
        z = zstandard.ZstdDecompressor()
        group, query, ids, texts = None, None, [], []

        def flush():
            if query is None or not ids:
                return None
            lists = Lists(texts, n)
            hit = divide_skip(query, lists.tokens, lists.owners, lists.sizes, pct)
            return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(hit), pa.int64()), pa.array([ids[k] for k in hit], pa.int64())], ["a", "b"]) if hit else None

        for batch in batches:
            for pivot, salt, cid, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (pivot, salt) != group:
                    if (out := flush()) is not None:
                        yield out
                    group, query, ids, texts = (pivot, salt), None, [], []
                text = z.decompress(packed)
                if cid == pivot:
                    query = Lists([text], n).keys
                else:
                    ids.append(cid)
                    texts.append(text)
                    if len(ids) >= PIECE:
                        if (out := flush()) is not None:
                            yield out
                        ids, texts = [], []
        if (out := flush()) is not None:
            yield out

    dealt = rows.repartition(parts, "pivot", "salt").sortWithinPartitions("pivot", "salt", (F.col("cid") != F.col("pivot")).cast("int"))
    return dealt.select("pivot", "salt", "cid", "packed").mapInArrow(tidy(search), "a long, b long")


def tile_links(ids: list[int], comps: list[int], sides: list[int], texts: list[bytes], n: int, pct: int) -> list[tuple[int, int]]:
    """Links of a tile that join different components. With two sides only pairs across them count, else all."""
    lists = Lists(texts, n)
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    two = len(set(sides)) == 2
    count: dict[int, int] = {}
    for c in comps:
        count[c] = count.get(c, 0) + 1
    largest = max(count, key=lambda c: (count[c], -c))
    out = []
    open_ = set(range(len(ids)))
    for k in sorted(open_, key=lambda i: (comps[i] == largest, i)):
        roots = {root(comps[i]) for i in open_ if not two or sides[i] != sides[k]}
        if roots <= {root(comps[k])}:
            if len({root(comps[i]) for i in open_}) == 1:
                break
            continue
        for m in divide_skip(lists.set_of(k), lists.tokens, lists.owners, lists.sizes, pct):
            if m != k and root(comps[m]) != root(comps[k]) and (not two or sides[m] != sides[k]):
                out.append((ids[k], ids[m]))
                parent[root(comps[m])] = root(comps[k])
        open_.discard(k)
    return out


def _tile_links(rows: DataFrame, n: int, pct: int, parts: int) -> DataFrame:
    """rows: (bucket, i, j, side, cid, comp, packed), a tile for each (bucket, i, j)."""

    def search(batches):
        z = zstandard.ZstdDecompressor()
        group, held = None, []

        def flush():
            links = tile_links([h[0] for h in held], [h[1] for h in held], [h[2] for h in held], [z.decompress(h[3]) for h in held], n, pct) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

        for batch in batches:
            for bucket, i, j, side, cid, comp, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, i, j) != group:
                    yield flush()
                    group, held = (bucket, i, j), []
                held.append((cid, comp, side, packed))
        yield flush()

    dealt = rows.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cid")
    return dealt.select("bucket", "i", "j", "side", "cid", "comp", "packed").mapInArrow(tidy(search), "a long, b long")


def _asked(pairs: DataFrame, held: Scratch) -> DataFrame:
    """(pivot, salt, cid): members of a pivot in pieces, each with the pivot itself. Few are broadcast, so that what they
    are joined with moves once, to its pivots."""
    width = pairs.groupBy("pivot").agg(F.count("*").alias("k")).withColumn("salts", F.ceil(F.col("k") / PIECE).cast("int"))
    asked = pairs.join(width, "pivot").withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int")).select("pivot", "salt", "cid")
    asked = held.stored(asked.unionByName(width.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("pivot").alias("cid"))), "pieces")
    return F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked


def _open_pairs(pairs: DataFrame, bounds: DataFrame, held: Scratch, pct: int, parts: int) -> DataFrame:
    """The pairs (pivot, cid) that the bound on their overlap leaves open. bounds: (cid, size, cells)."""

    def search(batches):
        group, size, cells = None, 0, None
        for batch in batches:
            out = []
            for pivot, salt, cid, n, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(zstandard.decompress(packed), np.int32)
                if (pivot, salt) != group:
                    group, size, cells = (pivot, salt), n, own
                elif np.minimum(own, cells).sum() >= required(size, n, pct):
                    out.append((pivot, cid))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["pivot", "cid"])

    dealt = _asked(pairs, held).join(bounds, "cid").repartition(parts, "pivot", "salt").sortWithinPartitions("pivot", "salt", (F.col("cid") != F.col("pivot")).cast("int"))
    return dealt.select("pivot", "salt", "cid", "size", "cells").mapInArrow(tidy(search), "pivot long, cid long")


def _texts(docs: DataFrame, classes: DataFrame, ids: DataFrame, held: Scratch) -> DataFrame:
    """(cid, packed) of the classes in ids (cid): of each the text that stands for it. Few ids are broadcast; many are
    joined."""
    ids = held.stored(classes.join(ids.distinct(), "cid", "left_semi").select("cid", F.col("rep.doc_id").alias("doc_id"), F.col("rep.t").alias("t")), "asked")
    rows = docs.select(F.col("doc_id").cast("long"), text_hash(), "text")
    if ids.count() <= BROADCAST_IDS:
        found = _packed(rows.join(F.broadcast(ids), ["doc_id", "t"]))
    else:
        found = _packed(rows.join(ids, ["doc_id", "t"]))
    return held.stored(found.dropDuplicates(["cid"]), "packed")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, held: Scratch, n: int, pct: int) -> DataFrame:
    """The links among pairs (pivot, cid): members of a pivot are searched in pieces, with the pivot as the query."""
    texts = _texts(docs, classes, pairs.select("cid").union(pairs.select("pivot")), held)
    return held.stored(_pivot_links(_asked(pairs, held).join(texts, "cid"), n, pct, parts_for(docs, 0.25)), "links")


def tile_pairs(comps: np.ndarray, sides: np.ndarray, sizes: np.ndarray, cells: np.ndarray, pct: int) -> list[tuple[int, int]] | None:
    """Pairs of a tile, of different components, that the bound leaves open; None if these are many for the tile's size."""
    out: list[tuple[int, int]] = []
    two = len(set(sides.tolist())) == 2
    for k in range(len(comps) - 1):
        rest = slice(k + 1, None)
        may = (comps[rest] != comps[k]) & (100 * np.minimum(sizes[rest], sizes[k]) >= pct * np.maximum(sizes[rest], sizes[k]))
        if two:
            may &= sides[rest] != sides[k]
        at = np.flatnonzero(may) + k + 1
        if len(at):
            most = np.minimum(cells[at], cells[k]).sum(1)
            out += [(k, j) for j in at[most >= required(sizes[k], sizes[at], pct)].tolist()]
            if len(out) > 4 * len(comps) + 16:
                return None
    return out


def _bounded_pairs(rows: DataFrame, pct: int, parts: int) -> DataFrame:
    """rows: (bucket, i, j, side, cid, comp, size, cells). (a, b, bucket, i, j): open pairs, or with null a and b a tile
    that has to be searched with its texts."""

    def search(batches):
        group, held = None, []

        def flush():
            links, tiles = [], []
            if len(held) > 1:
                comps, sides, sizes = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 3))
                cells = np.stack([np.frombuffer(zstandard.decompress(h[4]), np.int32) for h in held])
                got = tile_pairs(comps, sides, sizes, cells, pct)
                if got is None:
                    tiles = [(None, None, *group)]
                else:
                    links = [(held[x][0], held[y][0], *group) for x, y in got]
            cols = list(zip(*links, *tiles, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["a", "b", "bucket", "i", "j"])

        for batch in batches:
            for bucket, i, j, side, cid, comp, size, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, i, j) != group:
                    if len(held) > 1:
                        yield flush()
                    group, held = (bucket, i, j), []
                held.append((cid, comp, side, size, cells))
        if len(held) > 1:
            yield flush()

    dealt = rows.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "cid")
    return dealt.select("bucket", "i", "j", "side", "cid", "comp", "size", "cells").mapInArrow(tidy(search), "a long, b long, bucket long, i int, j int")


def _numbered(classes: DataFrame, held: Scratch) -> DataFrame:
    """classes with cid: the doc_id that stands for a class, for the least one is the likeliest source of copies and so the
    best pivot. Where a doc_id with several texts stands for several classes, these get numbers no doc_id has."""
    doc = F.col("rep.doc_id")
    several = held.stored(classes.groupBy(doc.alias("several")).agg(F.count("*").alias("k")).where("k > 1").select("several"), "several")
    n = several.count()
    if not n:
        return classes.withColumn("cid", doc)
    free = min(0, classes.agg(F.min(doc)).first()[0]) - 1
    joined = classes.join(F.broadcast(several) if n <= BROADCAST_IDS else several, doc == F.col("several"), "left")
    own = F.when(F.col("several").isNull(), doc).otherwise(F.lit(free) - F.monotonically_increasing_id())
    return held.stored(joined.withColumn("cid", own).drop("several"), "numbered")  # written, so the numbers stay


def ngram_join(docs: DataFrame, n: int = 5, pct: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text): components of the links
    100 * intersection >= pct * union between sets of n-word shingles of lower-case (A-Z) text.

    A text with fewer than n words has all of them as its one shingle. Null texts and texts without a word have the empty
    set and link with nothing. Rows that share a doc_id are one node, with the links of all their texts; ties and repeated
    rows link like any equal sets. component_id is the least doc_id that can be reached. A row with a null doc_id links
    with nothing and has a null component_id. An empty table gives an empty result; other columns are ignored. Memory: about
    100 bytes a byte of the longest text or of CHUNK_BYTES, and PIECE texts at a time in a search.
    """
    held = Scratch(docs.sparkSession)
    parts = parts_for(docs, 0.25)
    wide = Scratch(docs.sparkSession)
    found = wide.stored(signatures(docs, n, pct), "signatures")
    real = found.where("n_shingles > 0")
    rest = (F.first("prefix", True).alias("prefix"), F.first("cells", True).alias("cells"))
    rep = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t"))).alias("rep")
    classes = _numbered(held.stored(real.groupBy("f1", "f2", "n_shingles").agg(rep, *rest).where("rep is not null"), "classes"), held)
    found = held.stored(found.select("doc_id", "n_shingles", "f1", "f2"), "sizes")
    real = found.where("n_shingles > 0")
    wide.clear()  # prefixes and counts are in classes from here on
    bounds = classes.select("cid", F.col("n_shingles").alias("size"), "cells")
    # lists of two members and more, each with its pivot
    members = _lists(classes.select(F.explode("prefix").alias("token"), "cid", F.col("n_shingles").alias("size")), held, parts)
    near = members.where("cid <> pivot").where(f"100 * least(size, pivot_size) >= {pct} * greatest(size, pivot_size)")
    pairs = held.stored(near.select("pivot", "cid").distinct(), "pairs")
    links = _verified(held.stored(_open_pairs(pairs, bounds, held, pct, parts), "open"), docs, classes, held, n, pct)
    first = components(links)
    # lists that hold members apart from each other, neither of them the pivot: searched in tiles
    placed = members.where("wide and cid <> pivot").join(first.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    # partners differ in size by little, so a list falls into bands of size; a member is in its own and in the next
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(100 / pct)) + 1e-9)
    placed = held.stored(placed.withColumn("band", F.explode(F.array(band, band + 1))).select(F.xxhash64("token", "band").alias("token"), "cid", "comp"), "placed")
    apart = placed.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("cid")).alias("x1"), F.sum(F.shiftright(F.xxhash64(F.lit(5), "cid"), 24)).alias("x2")).where("a <> b")
    once = held.stored(apart.groupBy("k", "x1", "x2").agg(F.min("token").alias("token")).select("token", "k"), "once")
    # in a long list, members of its largest component are laid beside all others, but not beside each other
    by_comp = placed.join(once.where(F.col("k") > PIECE), "token").groupBy("token", "comp").agg(F.count("*").alias("of"))
    largest = by_comp.groupBy("token").agg(F.max(F.struct("of", "comp")).alias("top")).select("token", "top.of", F.col("top.comp").alias("top"))
    pieces = [F.ceil(x / PIECE).cast("int") for x in (F.col("k") - F.coalesce("of", F.lit(0)), F.coalesce("of", F.lit(0)))]
    cuts = once.join(largest, "token", "left").select("token", "top", pieces[0].alias("cuts"), pieces[1].alias("top_cuts"))
    tiled = placed.join(cuts, "token").withColumn("in_top", F.col("comp").eqNullSafe(F.col("top"))).withColumn("h", F.xxhash64(F.lit(3), "cid"))
    tiled = tiled.withColumn("c", F.when(F.col("in_top"), F.col("cuts") + F.pmod("h", F.greatest(F.lit(1), "top_cuts"))).otherwise(F.pmod("h", "cuts")).cast("int"))
    last = F.col("cuts") + F.when(F.col("in_top"), 0).otherwise(F.col("top_cuts")) - 1
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        F.col("token").alias("bucket"), F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "cid", "comp"
    )
    tiled = held.stored(tiled.withColumn("side", F.when(F.col("i") == F.col("j"), 0).otherwise(F.when(F.col("c") == F.col("i"), 0).otherwise(1))).drop("c"), "tiles")
    doubts = held.stored(_bounded_pairs(tiled.join(bounds, "cid"), pct, parts), "doubts")
    more = _verified(doubts.where("a is not null").select(F.least("a", "b").alias("pivot"), F.greatest("a", "b").alias("cid")).distinct(), docs, classes, held, n, pct)
    dense = doubts.where("a is null").select("bucket", "i", "j")
    if not dense.isEmpty():
        dense = held.stored(tiled.join(dense, ["bucket", "i", "j"]), "dense")
        more = more.unionByName(_tile_links(dense.join(_texts(docs, classes, dense.select("cid"), held), "cid"), n, pct, parts))
    keys = ["f1", "f2", "n_shingles"]
    named = real.where("doc_id is not null").select("doc_id", *keys).join(classes.select(*keys, "cid", F.col("rep.doc_id").alias("least")), keys).select("doc_id", "n_shingles", "cid", "least")
    named = held.stored(named, "named")
    several = named.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("last")).where("a <> last")
    same = named.join(several, "doc_id").where("cid <> a").select("a", F.col("cid").alias("b"))
    nodes = components(links.unionByName(more).unionByName(same)).withColumnRenamed("id", "cid")
    least = nodes.join(classes.select("cid", F.col("rep.doc_id").alias("least")), "cid").groupBy("component").agg(F.min("least").alias("component_id"))
    rows = named.join(nodes.join(least, "component").select("cid", "component_id"), "cid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "least").alias("component_id"))
    # a row without a set whose doc_id has another row with one
    empty = found.where("n_shingles = 0 and doc_id is not null").select("doc_id", "n_shingles")
    own = rows.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    empty = empty.join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = found.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = stored(rows.unionByName(empty).unionByName(nameless), "ngram-join")
    held.clear()
    return out


def keep_one(docs: DataFrame, n: int = 5, pct: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is its component's least; all columns, whatever they are called. Of rows with one
    doc_id all stay, and so do rows with a null doc_id, which are in no component, and texts without a word."""
    gone = ngram_join(docs.where("doc_id is not null"), n, pct).where("doc_id <> component_id").select(F.col("doc_id").alias("gone__")).distinct()
    row = F.struct("*").alias("row")  # so that no column of docs can clash with ours
    own = docs.select(row, F.col("doc_id").cast("long").alias("own__"))
    if gone.count() > DROPPED_IDS:
        return own.join(gone, F.col("own__") == F.col("gone__"), "left_anti").select("row.*")
    # far fewer ids go than stay, so the rows need not move
    shared = broadcast_value(docs.sparkSession, np.sort(gone.toArrow().column(0).to_numpy()))

    def keep(batches):
        for batch in batches:
            ids, gone = batch.column(1), shared.value
            known = ids.fill_null(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(gone, known), max(0, len(gone) - 1))
            stays = (gone[at] != known if len(gone) else np.ones(len(known), bool)) | ids.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(stays))], ["row"])

    return own.mapInArrow(tidy(keep), StructType([StructField("row", docs.schema)])).select("row.*")
