"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

Words are grouped into overlapping windows that cover the text; a window's words are read in both directions, an
attention over the states makes one vector, and that gives the window's log odds. A text's score is its worst window's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Rolling, broadcast_value, examples, mix, text_chunks, tidy, word_spans

#: Most labelled rows to fit on; the sample is what has the smallest hashes of doc_id.
FIT_ROWS = 3000
WINDOW, STRIDE = 32, 24
WORD_BUCKETS, CHAR_BUCKETS, DIM, HIDDEN = 1 << 15, 1 << 14, 8, 8
#: Character inputs of a word: its first 2 to 7 and last 2 to 4 bytes.
FRONTS, BACKS = (2, 3, 4, 5, 6, 7), (2, 3, 4)
N_CHAR = len(FRONTS) + len(BACKS)
#: What the sum of the character vectors of a word is divided by.
SHARE = 3
TRIM = np.zeros(256, bool)
TRIM[list(b".,;:!?\"'()#*$%&|<>")] = True


def features(data: np.ndarray, at: np.ndarray):
    """Word bucket, character buckets (words x N_CHAR) and row of each word."""
    low = LOWER[data]
    starts, ends, rows = word_spans(data, at)
    roll = Rolling(low)
    for _ in range(4):
        ends = np.where((ends - starts > 1) & TRIM[low[ends - 1]], ends - 1, ends)
    word = (roll.of(starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int32)
    chars = np.empty((len(word), N_CHAR), np.int32)
    for k, n in enumerate(FRONTS):
        chars[:, k] = mix(roll.of(starts, np.minimum(ends, starts + n)) + np.uint64(n)) % np.uint64(CHAR_BUCKETS)
    for k, n in enumerate(BACKS, len(FRONTS)):
        chars[:, k] = mix(roll.of(np.maximum(starts, ends - n), ends) + np.uint64(100 + n)) % np.uint64(CHAR_BUCKETS)
    return word, chars, rows


def _features_of(texts: list[bytes]):
    """features() of a list of texts, some at a time."""
    got, a = [(np.zeros(0, np.int32), np.zeros((0, N_CHAR), np.int32), np.zeros(0, np.int64))], 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= 1 << 20):
            size += len(texts[b])
            b += 1
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts[a:b]]))).astype(np.int64)
        word, chars, rows = features(np.frombuffer(b"".join(texts[a:b]), np.uint8), at)
        got.append((word, chars, rows + a))
        a = b
    return tuple(np.concatenate(x) for x in zip(*got, strict=True))


def windows(rows: np.ndarray, n_docs: int):
    """Indexes of words (windows x WINDOW, -1: none) and the row of each window; every word is in a window."""
    count = np.bincount(rows, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    each = np.where(count > 0, np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1), 0)
    of = np.repeat(np.arange(n_docs), each)
    nth = np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(each)))[:-1], each)
    at = (first[of] + nth * STRIDE)[:, None] + np.arange(WINDOW)
    return np.where(at < (first + count)[of][:, None], at, -1), of


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = lambda *s: rng.normal(0, s[-2] ** -0.5 if len(s) > 1 else 0.1, s).astype(np.float32)
        self.p = {"word": np.zeros((WORD_BUCKETS, DIM), np.float32), "char": np.zeros((CHAR_BUCKETS, DIM), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": n(2 * DIM, 3 * HIDDEN), f"u{d}": n(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"aw": n(2 * HIDDEN, HIDDEN), "av": n(HIDDEN), "o": n(2 * HIDDEN), "ob": np.full(1, -2, np.float32)}

    def inputs(self, word, chars):
        return np.concatenate([self.p["word"][word], self.p["char"][chars].sum(1) / SHARE], 1)

    def _run(self, x, mask, d, keep):
        """States (time x windows x HIDDEN) from projected inputs (time x windows x 3 HIDDEN); masked steps carry on."""
        u, steps = self.p["u" + d], range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        h, out, tape = np.zeros((x.shape[1], HIDDEN), np.float32), np.empty((len(x), x.shape[1], HIDDEN), np.float32), {}
        for t in steps:
            zr = _sigmoid(x[t, :, : 2 * HIDDEN] + h @ u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[t, :, 2 * HIDDEN :] + (r * h) @ u[:, 2 * HIDDEN :])
            new = h + mask[t][:, None] * z * (c - h)
            if keep:
                tape[t] = (h, z, r, c)
            out[t] = h = new
        return out, tape

    def forward(self, at, projected, keep=False):
        """Log odds of windows. projected: for each direction, a row for each word and a zero row at the end."""
        mask = (at.T >= 0).astype(np.float32)
        states, tapes = [], []
        for k, d in enumerate("fb"):
            s, tape = self._run(projected[k][at.T], mask, d, keep)
            states.append(s)
            tapes.append(tape)
        h = np.concatenate(states, 2)
        e = np.tanh(h @ self.p["aw"])
        a = e @ self.p["av"] - 1e9 * (1 - mask)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * h).sum(0)
        return pooled @ self.p["o"] + self.p["ob"][0], (mask, tapes, h, e, a, pooled)

    def project(self, x):
        return [np.concatenate([x @ self.p["w" + d] + self.p["c" + d], np.zeros((1, 3 * HIDDEN), np.float32)]) for d in "fb"]

    def score(self, data, at):
        n = len(at) - 1
        word, chars, rows = features(data, at)
        index, of = windows(rows, n)
        odds = np.full(n, float(self.p["ob"][0]))
        best = np.full(n, -np.inf)
        if len(of):
            projected = self.project(self.inputs(word, chars))
            for a in range(0, len(of), 4096):
                np.maximum.at(best, of[a : a + 4096], self.forward(index[a : a + 4096], projected)[0])
        odds = np.where(np.isfinite(best), best, odds)
        return 1 / (1 + np.exp(-np.clip(odds.astype(np.float64), -40, 40)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 3, batch: int = 256, rate: float = 2e-2, seed: int = 3):
        """Windows of texts labelled 0 are examples of 0; of a text labelled 1, its worst window so far is one of 1 (at
        first by the log odds of single words and parts of words, then by the net)."""
        word, chars, rows = _features_of(texts)
        index, of = windows(rows, len(texts))
        signs = self._begin(word, chars, rows, labels)
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        bad = labels[of] == 1
        for epoch in range(epochs):
            odds = self._all(index, word, chars) if epoch > 1 else np.where(index >= 0, signs[index], -np.inf).max(1)
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, of, odds)
            worst = np.flatnonzero(bad & (odds >= top[of]))
            clean = np.flatnonzero(~bad)
            if len(clean) > 24_000:  # those that look worst, and as many others by chance
                hard = clean[np.argsort(-odds[clean])[:12_000]]
                clean = np.concatenate((hard, rng.choice(clean, 12_000, replace=False)))
            pull = max(1.0, min(20.0, len(clean) / max(1, 2 * len(worst))))
            rate *= 0.7
            order = rng.permutation(np.concatenate((clean, worst)))
            some = min(batch, max(8, len(order) // 80))  # few examples: smaller steps, and as many
            for i in range(0, len(order), some):
                pick = order[i : i + some]
                g = self._gradients(index[pick], word, chars, bad[pick].astype(np.float32), pull)
                step += 1
                for k, (rows_, d) in g.items():
                    # only rows that the batch touched change
                    m[k][rows_] += 0.1 * (d - m[k][rows_])
                    v2[k][rows_] += 0.01 * (d * d - v2[k][rows_])
                    self.p[k][rows_] -= (rate / 10 if k in ("word", "char") else rate) * (m[k][rows_] / (1 - 0.9**step)) / (np.sqrt(v2[k][rows_] / (1 - 0.99**step)) + 1e-7)
        return self

    def _begin(self, word, chars, rows, labels):
        """The first dimension of the vectors starts at smoothed log odds by document; training goes on from there.
        Returns the largest of a word's own."""
        signs = np.full(len(word), -np.inf)
        for name, ids in (("word", word[:, None]), ("char", chars)):
            size = len(self.p[name])
            keys = (rows[:, None] * size + ids).ravel()
            keys.sort()
            doc, key = np.divmod(keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys, size)
            bad = labels[doc] == 1
            pos, neg = np.bincount(key[bad], minlength=size), np.bincount(key[~bad], minlength=size)
            del keys, doc, key, bad
            odds = np.log((pos + 0.5) / (labels.sum() + 1)) - np.log((neg + 0.5) / (len(labels) - labels.sum() + 1))
            sure = odds * (pos + neg) / (pos + neg + 8)
            self.p[name][:, 0] = np.clip(sure, -2, 5) / 2
            if len(word):
                signs = np.maximum(signs, sure[ids].max(1))
        return signs

    def _all(self, index, word, chars):
        out = [np.zeros(0)]
        for a in range(0, len(index), 4096):
            part = index[a : a + 4096]
            used, local = np.unique(part[part >= 0], return_inverse=True)
            at = np.full(part.shape, -1)
            at[part >= 0] = local
            out.append(self.forward(at, self.project(self.inputs(word[used], chars[used])))[0])
        return np.concatenate(out)

    def _gradients(self, index, word, chars, y, pull=1.0):
        used, local = np.unique(index[index >= 0], return_inverse=True)
        at = np.full(index.shape, -1)
        at[index >= 0] = local
        w, c = word[used], chars[used]
        x = self.inputs(w, c)
        odds, (mask, tapes, h, e, a, pooled) = self.forward(at, self.project(x), True)
        d = (_sigmoid(odds) - y) * np.where(y > 0, np.float32(pull), np.float32(1)) / len(y)
        g = {"o": pooled.T @ d, "ob": np.array([d.sum()], np.float32)}
        dp = d[:, None] * self.p["o"]
        dh = a[:, :, None] * dp
        da = (h * dp).sum(2)
        ds = a * (da - (a * da).sum(0))
        g["av"] = np.einsum("tbk,tb->k", e, ds)
        de = ds[:, :, None] * self.p["av"] * (1 - e * e)
        g["aw"] = np.einsum("tbi,tbk->ik", h, de, optimize=True)
        dh = dh + de @ self.p["aw"].T
        dx = np.zeros_like(x)
        for k, d_ in enumerate("fb"):
            dx += self._back(dh[:, :, k * HIDDEN : (k + 1) * HIDDEN], tapes[k], mask, d_, at, x, g)
        ids, back = np.unique(w, return_inverse=True)
        dw = np.zeros((len(ids), DIM), np.float32)
        np.add.at(dw, back, dx[:, :DIM])
        cids, cback = np.unique(c, return_inverse=True)
        dc = np.zeros((len(cids), DIM), np.float32)
        np.add.at(dc, cback.reshape(c.shape), (dx[:, None, DIM:] / SHARE) * np.ones((1, N_CHAR, 1), np.float32))
        every = slice(None)
        return {k: (every, v) for k, v in g.items()} | {"word": (ids, dw), "char": (cids, dc)}

    def _back(self, dh, tape, mask, d, at, x, g):
        u = self.p["u" + d]
        steps = range(len(dh) - 1, -1, -1) if d == "f" else range(len(dh))
        du, later = np.zeros_like(u), np.zeros(dh.shape[1:], np.float32)
        dproj = np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
        for t in steps:
            h, z, r, c = tape[t]
            now = dh[t] + later
            step = now * mask[t][:, None]
            dz, dc = step * (c - h) * z * (1 - z), step * z * (1 - c * c)
            back = dc @ u[:, 2 * HIDDEN :].T
            dr = back * h * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            du[:, : 2 * HIDDEN] += h.T @ dzr
            du[:, 2 * HIDDEN :] += (r * h).T @ dc
            later = now - step * z + back * r + dzr @ u[:, : 2 * HIDDEN].T
            np.add.at(dproj, at[:, t], np.concatenate([dzr, dc], 1))
        dproj = dproj[:-1]
        g["u" + d], g["w" + d], g["c" + d] = du, x.T @ dproj, dproj.sum(0)
        return dproj @ self.p["w" + d].T


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold) for each row of docs.

    labels: (doc_id, toxic) of the rows to learn from; null labels are no examples. At most fit_rows of them are used,
    and their texts are the only ones that reach the driver. Texts without a word, null included, have no window and get
    the net's bias. Repeated rows are each scored; other columns are ignored.
    """
    rows = examples(docs, labels, "toxic", fit_rows)
    net = BiGru()
    if rows:
        net.fit([t.encode() for _, t, _ in rows], np.array([x for *_, x in rows], np.float32))
    model = broadcast_value(docs.sparkSession, net)

    def predict(batches):
        for batch in batches:
            for own, data, at in text_chunks(batch):
                p = model.value.score(data, at)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(p), pa.array(p >= threshold).cast(pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(predict), "doc_id long, score double, predicted int")
