"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become learned vectors; filters of 32 bytes slide over the whole text in steps of 8, so that chunks overlap; each
filter's largest response over the text is kept and a small dense net combines these into one probability. Besides its
learned vector each byte carries one flag: that its word equals one of the four words before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, broadcast_value, examples, text_chunks, tidy, word_spans

#: Most labelled rows to fit on; the sample is what has the smallest hashes of doc_id.
FIT_ROWS = 3000
STEP, STEPS, DIM, FILTERS, HIDDEN = 8, 4, 6, 32, 16
PAD = 256


def _blocks(data: np.ndarray, at: np.ndarray):
    """Bytes and flags in rows of STEP, padded after each text so that no filter sees two texts: (bytes, flags, first
    row of each text, mask of rows at which a filter may start)."""
    n_docs, length = len(at) - 1, np.diff(at)
    rows = np.maximum(1, -(-length // STEP))
    first = np.concatenate(([0], np.cumsum(rows + STEPS - 1)))
    total = int(first[-1])
    codes, flags = np.full(total * STEP, PAD, np.int16), np.zeros(total * STEP, np.float32)
    to = np.arange(len(data)) + np.repeat(first[:-1] * STEP - at[:-1], length)
    codes[to] = data
    starts, ends, of = word_spans(data, at)
    if len(starts):
        h = Rolling(data).of(starts, ends)
        again = np.zeros(len(h), bool)
        for k in range(1, 5):
            again[k:] |= (h[k:] == h[:-k]) & (of[k:] == of[:-k])
        edge = np.zeros(len(data) + 1, np.int8)
        edge[starts[again]] += 1
        edge[ends[again]] -= 1
        flags[to] = np.cumsum(edge[:-1])
    live = np.ones(total, np.float32)
    for k in range(STEPS - 1):
        live[first[1:] - 1 - k] = 0
    return codes.reshape(total, STEP), flags.reshape(total, STEP), first[:-1], live, n_docs


class ByteConvNet:
    """Parameters p, trained by Adam."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        wide = STEP * (DIM + 1)
        self.p = {
            "emb": rng.normal(0, 0.5, (257, DIM)), "conv": rng.normal(0, (STEPS * wide) ** -0.5, (STEPS, wide, FILTERS)), "cb": np.zeros(FILTERS),
            "w1": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["emb"][PAD] = 0

    def _input(self, codes, flags):
        x = np.empty((len(codes), STEP, DIM + 1), np.float32)
        x[:, :, :DIM] = self.p["emb"][codes]
        x[:, :, DIM] = flags
        return x.reshape(len(codes), -1)

    def respond(self, codes, flags, live):
        """Filter responses (rows x filters), 0 where a filter may not start."""
        x = self._input(codes, flags)
        y = np.tile(self.p["cb"], (len(x), 1))
        for k in range(STEPS):
            y[: max(0, len(x) - k)] += x[k:] @ self.p["conv"][k]
        np.maximum(y, 0, out=y)
        y *= live[:, None]
        return y

    def head(self, pooled):
        h = np.tanh(pooled @ self.p["w1"] + self.p["b1"])
        return h, h @ self.p["w2"] + self.p["b2"][0]

    def score(self, data, at):
        codes, flags, first, live, n = _blocks(data, at)
        pooled = np.zeros((n, FILTERS), np.float32)
        most, a = 1 << 14, 0
        owner = np.repeat(np.arange(n), np.diff(np.concatenate((first, [len(codes)]))))
        while a < len(codes):  # in pieces that overlap by a filter's length
            b = min(len(codes), a + most)
            y = self.respond(codes[a : b + STEPS - 1], flags[a : b + STEPS - 1], live[a : b + STEPS - 1])[: b - a]
            own = owner[a:b]
            cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            pooled[own[cut]] = np.maximum(pooled[own[cut]], np.maximum.reduceat(y, cut, axis=0))
            a = b
        return 1 / (1 + np.exp(-np.clip(self.head(pooled)[1].astype(np.float64), -40, 40)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 4e-3, seed: int = 5):
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean())) if 0 < labels.mean() < 1 else np.ones(len(labels))
        step, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                g = self._gradients([texts[j] for j in pick], labels[pick], weight[pick])
                step += 1
                lr = rate * (1 - step / (total + 1))
                for k, d in g.items():
                    m[k] += 0.1 * (d - m[k])
                    v2[k] += 0.001 * (d * d - v2[k])
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, texts, y, weight):
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        codes, flags, first, live, n = _blocks(np.frombuffer(b"".join(texts), np.uint8), at)
        out = self.respond(codes, flags, live)
        ends = np.concatenate((first[1:], [len(codes)]))
        where = np.stack([a + out[a:b].argmax(0) for a, b in zip(first, ends, strict=True)])
        pooled = np.take_along_axis(out, where, 0)
        h, logit = self.head(pooled)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / n
        g = {"w2": h.T @ d, "b2": np.array([d.sum()])}
        dh = d[:, None] * self.p["w2"] * (1 - h * h)
        g |= {"w1": pooled.T @ dh, "b1": dh.sum(0)}
        dp = (dh @ self.p["w1"].T) * (pooled > 0)
        g["cb"] = dp.sum(0)
        g["conv"], g["emb"] = np.zeros_like(self.p["conv"]), np.zeros_like(self.p["emb"])
        flat = np.tile(np.arange(FILTERS), n)
        for k in range(STEPS):
            src = np.minimum(where.ravel() + k, len(codes) - 1)
            x = self._input(codes[src], flags[src]) * dp.ravel()[:, None]
            g["conv"][k] = x.reshape(n, FILTERS, -1).sum(0).T
            dx = (self.p["conv"][k].T[flat] * dp.ravel()[:, None]).reshape(-1, STEP, DIM + 1)[:, :, :DIM]
            np.add.at(g["emb"], codes[src], dx)
        g["emb"][PAD] = 0
        return {k: v.astype(np.float32) for k, v in g.items()}


def fit_model(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """The net, as a broadcast value: at most fit_rows labelled rows and their texts reach the driver."""
    rows = examples(docs, labels, "quality", fit_rows)
    net = ByteConvNet()
    if rows:
        net.fit([t.encode() for _, t, _ in rows], np.array([q for *_, q in rows], np.float32))
    return broadcast_value(docs.sparkSession, net)


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold.

    Null texts score as empty ones; rows with a null or repeated doc_id are each judged by their text. An empty table
    gives an empty result, and no label the untrained net's verdict.
    """
    model = fit_model(docs, labels, fit_rows)

    def keep(batches):
        for batch in batches:
            for own, data, at in text_chunks(batch):
                yield own.filter(pa.array(model.value.score(data, at) >= threshold))

    return docs.mapInArrow(tidy(keep), docs.schema)


def quality_classifier(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold) for each row of docs.

    labels: (doc_id, quality) of the rows to learn from; null labels are no examples. At most fit_rows of them are used,
    and their texts are the only ones that reach the driver. Null texts score as empty ones. Without examples every
    score is that of the untrained net. Memory: about 200 bytes a byte of the longest text or of CHUNK_BYTES. Repeated rows are each scored; other columns are ignored.
    """
    model = fit_model(docs, labels, fit_rows)

    def predict(batches):
        for batch in batches:
            for own, data, at in text_chunks(batch):
                p = model.value.score(data, at)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(p), pa.array(p >= threshold).cast(pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(predict), "doc_id long, score double, predicted int")
