"""Language identification: multinomial naive Bayes over hashed character n-grams, scored in sparse batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_value, sample_by_hash, text_chunks, tidy

BUCKETS = 1 << 16
#: Characters in a row.
ORDERS = (1, 2, 3)
#: Most labelled rows to fit on; the sample is what has the smallest hashes of doc_id.
FIT_ROWS = 4000
#: Labelled texts of more bytes than this are no examples, so that what is fitted on has a bound: rows times this.
FIT_TEXT_BYTES = 1 << 16
#: By code point: is it a letter, and its lower case where that is one character (8 MB in all, made once by a worker).
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        chars = [chr(i) for i in range(0x110000)]
        low = np.arange(len(chars), dtype=np.uint32)
        for i, c in enumerate(chars):
            if (x := c.lower()) != c and len(x) == 1:
                low[i] = ord(x)
        _TABLES[:] = [np.fromiter((c.isalpha() for c in chars), bool, len(chars)), low]
    return _TABLES


def characters(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk of texts, and where each text's begin."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return points, np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]


def _buckets(low: np.ndarray, n: int) -> np.ndarray:
    """The hash bucket of the n characters from each position."""
    m = len(low) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    x = np.full(m, n, np.uint32)
    for k in range(n):
        x = (x ^ low[k : k + m]) * np.uint32(0x01000193)
        x ^= x >> np.uint32(15)
    x *= np.uint32(0x9E3779B1)
    return x >> np.uint32(16)


def _inside(at: np.ndarray, total: int, n: int) -> np.ndarray:
    """False for positions whose n characters reach over the end of their text."""
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):
        edge = at[1:-1] - k
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    return ok


def fit(rows: list[tuple[str, str]], alpha: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors and the log-probability matrix (languages x buckets) from (text, lang) rows."""
    langs = sorted({lang for _, lang in rows})
    counts = np.full((len(langs), BUCKETS), alpha)
    seen = np.zeros(len(langs))
    for text, lang in rows:
        low = _tables()[1][np.frombuffer((text or "").encode("utf-32-le"), np.uint32)]
        k = langs.index(lang)
        seen[k] += 1
        for n in ORDERS:
            counts[k] += np.bincount(_buckets(low, n), minlength=BUCKETS)
    prior = np.log(seen / seen.sum()) if langs else seen
    return langs, prior, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def score_chunk(low: np.ndarray, at: np.ndarray, prior: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Log joint probabilities (documents x languages) from lower-case code points."""
    n_docs = len(at) - 1
    rows = np.repeat(np.arange(n_docs), np.diff(at))
    out = np.tile(prior, (n_docs, 1))
    for n in ORDERS:
        ok = _inside(at, len(low), n)
        bucket, of = _buckets(low, n)[ok], rows[: len(ok)][ok]
        for k in range(len(prior)):
            out[:, k] += np.bincount(of, table[k][bucket], minlength=n_docs)
    return out


def language_id(docs: DataFrame, training: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, lang_pred and score (the posterior probability of lang_pred) for each row of docs.

    training: (doc_id, text, lang); rows with null lang are no examples. Null texts and texts without a letter get
    `und` and score 0, as does every text when there is no example. Ties go to the language that sorts first.
    Repeated rows are each predicted; other columns are ignored. The matrix that is broadcast has a fixed size:
    4 bytes x 65,536 x languages. Memory: about 60 bytes a byte of the longest text or of CHUNK_BYTES.
    """
    spark = docs.sparkSession
    examples = training.where("lang is not null and text is not null").where(F.octet_length("text") <= FIT_TEXT_BYTES).select("doc_id", "text", "lang")
    ids = sample_by_hash(examples.select("doc_id"), fit_rows).distinct()  # ids first: no task sends more texts than are used
    picked = sample_by_hash(examples.join(F.broadcast(ids), "doc_id"), fit_rows)  # at most fit_rows ids
    langs, prior, table = fit(sorted((r.text, r.lang) for r in picked.collect()))
    model = broadcast_value(spark, (langs, prior, table))

    def predict(batches):
        langs, prior, table = model.value
        letter, low = _tables()
        names = np.array([*langs, "und"], object)
        for batch in batches:
            for rows, data, at in text_chunks(batch):
                n = len(at) - 1
                points, cut = characters(data, at)
                sums = np.concatenate(([0], np.cumsum(letter[points])))
                letters = sums[cut[1:]] > sums[cut[:-1]]
                best, score = np.full(n, len(langs)), np.zeros(n)
                if langs:
                    x = score_chunk(low[points], cut, prior, table)
                    top = x.argmax(1)
                    odds = np.exp(np.maximum(x - x.max(1, keepdims=True), -700)).sum(1)
                    best, score = np.where(letters, top, best), np.where(letters, 1 / odds, 0.0)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(predict), "doc_id long, lang_pred string, score double")


