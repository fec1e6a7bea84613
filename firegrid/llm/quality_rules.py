"""Quality rules by repetition coverage: how much of a text lies in n-grams and lines that repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Rolling, grams, text_chunks, tidy, word_spans

#: Most characters, in parts of 1000 of all word characters, that may lie in repeated n-grams of n words.
MAX_COVER = {5: 150, 6: 140, 7: 130, 8: 120, 9: 110, 10: 100}
#: The same for characters in repeated lines.
MAX_LINE_COVER = 300
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _repeated(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True for entries whose (row, key) occurs at least twice."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True for entries equal to an earlier one of the row."""
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    out = np.zeros(len(keys), bool)
    out[order[1:][(k[1:] == k[:-1]) & (r[1:] == r[:-1])]] = True
    return out


def measure(data: np.ndarray, at: np.ndarray, ns=tuple(MAX_COVER)) -> dict[str, np.ndarray]:
    """Counts for each document of a chunk."""
    n_docs = len(at) - 1
    per = lambda rows, w=None: np.bincount(rows, w, minlength=n_docs).astype(np.int64)
    starts, ends, rows = word_spans(data, at)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = lead[ends] - lead[starts]
    roll = Rolling(data)
    words = roll.of(starts, ends)
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    out = {"n_words": per(rows), "word_chars": per(rows, chars), "n_symbols": symbols[at[1:]] - symbols[at[:-1]]}

    breaks = np.flatnonzero(data == 10)
    line_at = np.unique(np.concatenate((at[:-1], breaks + 1)))
    line_at = line_at[line_at < len(data)]
    line_row = np.searchsorted(at, line_at, "right") - 1
    line_end = np.minimum(np.concatenate((line_at[1:], [len(data)])), at[line_row + 1]) if len(line_at) else line_at
    line_end = np.where((line_end > line_at) & (line_end <= len(data)) & (data[np.maximum(line_end, 1) - 1] == 10), line_end - 1, line_end) if len(line_at) else line_end
    in_line = np.searchsorted(line_at, starts, "right") - 1
    n_in = np.bincount(in_line, minlength=len(line_at))
    c_in = np.bincount(in_line, chars, minlength=len(line_at))
    real = np.flatnonzero(n_in > 0)
    keys, of = roll.of(line_at[real], line_end[real]), line_row[real]
    again = _later(keys, of)
    out["n_dup_lines"] = per(of[again])
    out["dup_line_chars"] = per(of[again], c_in[real][again])

    for n in (3, *ns):
        keys, first = grams(words, rows, n)
        hit = first[_repeated(keys, rows[first])]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + n, -1)
        inside = np.cumsum(edge[:-1]) > 0
        if n == 3:
            out["n_repeat_words"] = per(rows[inside])
        else:
            out[f"cover_{n}"] = per(rows[inside], chars[inside])
    return out


SCHEMA = pa.schema(
    [("doc_id", pa.int64())] + [(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")]
    + [(f"cover_{n}", pa.int64()) for n in MAX_COVER] + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
)


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """One row per row of docs (doc_id, text): counts, coverage and the verdict `kept`.

    Null and empty texts have no words: all counts 0, base_failed true, kept false. Rows with equal ids are each
    judged; other columns are ignored. An empty table gives an empty result. No shuffle: each text is judged alone.
    """

    def judge(batches):
        for batch in batches:
            for rows, data, at in text_chunks(batch):
                x = measure(data, at)
                failed = (x["n_words"] < min_words) | (100 * x["n_repeat_words"] > max_repeat_pct * x["n_words"])
                kept = ~failed & (1000 * x["dup_line_chars"] <= MAX_LINE_COVER * x["word_chars"])
                for n, most in MAX_COVER.items():
                    kept &= 1000 * x[f"cover_{n}"] <= most * x["word_chars"]
                x |= {"doc_id": rows.column(0), "base_failed": failed, "kept": kept}
                yield pa.RecordBatch.from_arrays([pa.array(x[f.name], f.type) for f in SCHEMA], schema=SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(tidy(judge), "doc_id long, " + ", ".join(f"{f.name} {'boolean' if pa.types.is_boolean(f.type) else 'long'}" for f in SCHEMA if f.name != "doc_id"))
