"""Shared pieces of the training-data operators: shared folder, text chunks, word spans and rolling hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.storage import Scratch, shared_dir, stored  # noqa: F401

#: Bytes of text that one vectorised step looks at; a longer document is a step of its own.
CHUNK_BYTES = 1 << 18
#: `[\x20\x09-\x0D]`
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Allocations of this size and more come from the system one by one, so that freeing them gives them back.
MAPPED_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PRIME, _BASE_P = (1 << 31) - 1, 0x5BD1E995
_BASE_P_INV = pow(_BASE_P, -1, _PRIME)
_POWERS: list[np.ndarray] = []


def _sparing() -> None:
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, MAPPED_BYTES)  # M_MMAP_THRESHOLD; left alone, it grows with what is freed
        libc.mallopt(-8, 1)  # M_ARENA_MAX: one heap, so that trimming finds all that is free


def _give_back() -> None:
    if _POWERS and len(_POWERS[0]) > 2 * CHUNK_BYTES:
        _POWERS.clear()  # of a very long text
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run):
    """run (for mapInArrow) in a worker that gives memory back: Spark keeps workers for later tasks, and an executor's
    limit holds for all of them together."""

    def inner(batches):  # is sent by value with all globals it names, so it names functions alone
        _sparing()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return inner


def fresh(columns: list[str], *names: str) -> list[str]:
    """names, each with as many underscores as it takes to differ from all columns (Spark compares without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def remainder(modulus: int, doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus))


def parts_for(df: DataFrame, factor: float = 1.0, part_bytes: int = 64 << 20) -> int:
    """Partitions for a shuffle of about factor times the bytes of df's tables; at least spark.sql.shuffle.partitions,
    for AQE does not raise a count that is given."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(200_000, int(size * factor / part_bytes) + 1)) if size < 1 << 50 else least  # more: not known


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (first 0) of a string column without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    got = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return got, at - at[0]


def text_chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES):
    """(rows of the batch, bytes, offsets), each with about `most` bytes of text."""
    data, at = text_buffers(batch.column(batch.schema.get_field_index(column)))
    a, n = 0, len(at) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1))
        yield batch.slice(a, b - a), data[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def spans(kept: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of maximal runs of kept bytes that don't cross rows."""
    if not len(kept):
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last = kept.copy(), kept.copy()
    first[1:] &= ~kept[:-1]
    last[:-1] &= ~kept[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(kept))]
    first[edges] = kept[edges]
    last[edges - 1] = kept[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, "right") - 1


def word_spans(data: np.ndarray, at: np.ndarray):
    """Words `[^\x20\x09-\x0D]+`: starts, ends, rows."""
    return spans(~IS_SPACE[data], at)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finisher for 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n and more of both bases and of their inverses."""
    if not _POWERS or len(_POWERS[0]) < n + 1:
        n = max(n + 1, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        _POWERS.clear()
        for base in (_BASE, _BASE_INV):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
        for base in (_BASE_P, _BASE_P_INV):
            p = np.ones(n, np.uint64)
            have = 1
            while have < n:  # the next half is the first one times base ** have
                k = min(have, n - have)
                p[have : have + k] = p[:k] * np.uint64(pow(base, have, _PRIME)) % np.uint64(_PRIME)
                have += k
            _POWERS.append(p.astype(np.uint32))
    return _POWERS


class Rolling:
    """64-bit hashes of any byte ranges of a buffer, by differences of running sums.

    Two polynomials are mixed: one modulo 2**64, and, unless plain, one modulo the prime 2**31 - 1, for there are pairs of
    texts (Thue-Morse sequences) that agree in every polynomial modulo a power of two. plain is for candidates that are
    compared afterwards. Takes 16 bytes a byte of text (plain: 8), and as much again while it is built.
    """

    def __init__(self, data: np.ndarray, plain: bool = False):
        up, self.down, up_p, self.down_p = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        raised = data.astype(np.uint64)
        raised += np.uint64(1)
        self.sums_p = None
        if not plain:  # terms below 2**39: sums of 2**24 of them are exact, those of more are reduced on the way
            self.sums_p = np.zeros(len(data) + 1, np.uint64)
            terms, own = raised * up_p[: len(data)], self.sums_p[1:]
            for a in range(0, len(data), 1 << 24):
                part = own[a : a + (1 << 24)]
                np.cumsum(terms[a : a + (1 << 24)], dtype=np.uint64, out=part)
                if len(data) > 1 << 24:
                    part += self.sums_p[a]
                    part %= np.uint64(_PRIME)
        np.cumsum(raised * up[: len(data)], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = mix((self.sums[ends] - self.sums[starts]) * self.down[starts])
        if self.sums_p is None:
            return h
        prime = np.uint64(_PRIME)
        whole = self.sums_p[ends] - self.sums_p[starts] if len(self.sums_p) <= (1 << 24) + 1 else self.sums_p[ends] + prime - self.sums_p[starts]
        own = whole % prime * self.down_p[starts] % prime
        return mix(h + own * np.uint64(0xD1342543DE82EF95))


def grams(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row within a document, and the index of each one's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(m, np.uint64(n), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m])
    first = np.flatnonzero(rows[:m] == rows[n - 1 :])
    return out[first], first


#: Labelled texts of more bytes than this are no examples, so that what is fitted on has a bound: rows times this.
FIT_TEXT_BYTES = 1 << 16


def examples(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int) -> list[tuple[int, str, int]]:
    """At most fit_rows labelled texts (doc_id, text, label), each of at most FIT_TEXT_BYTES: those of the smallest hashes
    of doc_id. Ids are chosen first, so no task sends more texts than are used."""
    short = F.coalesce(F.octet_length("text"), F.lit(0)) <= FIT_TEXT_BYTES
    picked = sample_by_hash(labels.where(F.col(label).isNotNull()).select("doc_id", label).distinct(), fit_rows)
    seen = docs.select("doc_id", "text").where(short).join(F.broadcast(picked), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), label)  # at most fit_rows ids
    return sorted((r[0], r[1], r[2]) for r in sample_by_hash(seen, fit_rows).collect())


def sample_by_hash(df: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """At most n rows, those of the smallest hash of doc_id: a bounded, repeatable sample for fitting."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(n)


_SENT: list = []


def broadcast_value(spark: SparkSession, value):
    """value on all executors. What was sent before leaves their memory (a task that still wants it fetches it again)."""
    for old in _SENT:
        try:
            old.unpersist()
        except Exception:  # noqa: BLE001 - of a session that has ended
            continue
    _SENT[:] = [spark.sparkContext.broadcast(value)]
    return _SENT[0]
