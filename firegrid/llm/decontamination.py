"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND for every passage.

Impacts are shares of an item's score against itself, so one threshold fits all items. Passages are overlapping windows
of words that cover every text; how wide they are follows from an item's own length. Items of one width lie in shards;
a shard has a posting list for each term, cut into blocks with their largest impact. A passage is given up at once where
the largest impacts of its terms, over all items and then by ranges of items, sum to less than the threshold (many
passages at a time, in numpy); for what is left, cursors move over the posting lists of the passage's terms: the pivot is the first item that the terms up to it could
lift to the threshold, blocks whose maxima can't are skipped, and only other pivots are scored. What reaches the threshold
is verified by the overlap of the item's question and of its answer with the passage. Where no answer is marked, the last
sentence is only a guess at one, so a passage also counts if it has WHOLE of the whole item's n-grams.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Rolling, broadcast_value, grams, text_chunks, tidy, word_spans

K1, B = 1.2, 0.75
BLOCK, SHARD = 16, 256
#: Items of a range. With 16 two of three passages of sf0.1 stay open, with 4 one in 20, with 2 one in 80.
RANGE = 2
#: Items up to this many, and of so many bytes, are held in one broadcast (about 6 bytes a byte of theirs); more are
#: searched in several passes over the texts. A single item is always whole.
ITEMS_PER_PASS, BYTES_PER_PASS = 20_000, 16 << 20
#: Words in the narrowest step from passage to passage; a passage is two steps wide.
STRIDE = 64
#: Words of passages that are looked at in one numpy step.
STEP_WORDS = 1 << 16
#: What sums of impacts may differ by through the order of adding.
SLACK = 1e-9
#: The share of an item without a marked answer that is enough, whatever its last sentence.
WHOLE = 0.8
MARKED = re.compile(r"(?im)^\s*(?:a|answer)\s*:")
TRIM = np.zeros(256, bool)
TRIM[list(b".,;:!?\"'()[]|")] = True


def tokens(data: np.ndarray, at: np.ndarray):
    """Hashes of lower-case words without punctuation at their ends, and their rows."""
    low = LOWER[data]
    starts, ends, rows = word_spans(data, at)
    for _ in range(3):
        ends = np.where((ends - starts > 1) & TRIM[low[ends - 1]], ends - 1, ends)
        starts = np.where((ends - starts > 1) & TRIM[low[starts]], starts + 1, starts)
    return Rolling(low).of(starts, ends), rows


def _text_tokens(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return tokens(raw, np.array([0, len(raw)]))[0]


def question_and_answer(text: str) -> tuple[str, str]:
    """Splits an item: at a line that starts with `A:` or `Answer:`, else before its last sentence, else no answer."""
    if m := MARKED.search(text):
        return text[: m.start()], text[m.end() :]
    parts = [x for x in re.split(r"(?<=[.?!])\s+", text.strip()) if x]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _grams_of(words: np.ndarray) -> tuple[int, np.ndarray]:
    n = min(3, max(1, len(words)))
    return n, np.unique(grams(words, np.zeros(len(words), int), n)[0])


def _has_whole(whole: tuple[int, np.ndarray] | None, passage: np.ndarray) -> bool:
    return whole is not None and float(np.isin(whole[1], grams(passage, np.zeros(len(passage), int), whole[0])[0]).mean()) >= WHOLE


class Statistics:
    """What scores take from all items, whatever pass an item is in: document frequencies and mean length."""

    def __init__(self):
        self.n = self.words = 0
        self.terms, self.df = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, texts: list[str]) -> None:
        found = [w for w in map(_text_tokens, texts) if len(w)]
        if not found:
            return
        self.n += len(found)
        self.words += sum(map(len, found))
        terms, df = np.unique(np.concatenate([np.unique(w) for w in found]), return_counts=True)
        every, at = np.unique(np.concatenate((self.terms, terms)), return_inverse=True)
        count = np.zeros(len(every), np.int64)
        np.add.at(count, at, np.concatenate((self.df, df)))
        self.terms, self.df = every, count

    @property
    def mean(self) -> float:
        return self.words / self.n if self.n else 1.0

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[np.searchsorted(self.terms, terms)]
        return np.log(1 + (self.n - df + 0.5) / (df + 0.5))


def stride_of(n_words: int) -> int:
    """The step between passages for an item: the least power of two times STRIDE that is not below its length."""
    return STRIDE << max(0, (-(-n_words // STRIDE) - 1).bit_length())


class Shard:
    """The index of up to SHARD items of one stride: sorted terms, their posting lists (items ascending, with impacts) end
    to end, block maxima, and what verification needs."""

    def __init__(self, items: list[tuple[int, str]], stride: int, whole: Statistics):
        self.stride = stride
        self.ids = np.array([i for i, _ in items], np.int64)
        words = [_text_tokens(t) for _, t in items]
        term, item, impact = [], [], []
        for k, w in enumerate(words):
            own, tf = np.unique(w, return_counts=True)
            raw = whole.idf(own) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / whole.mean))
            term.append(own)
            item.append(np.full(len(own), k, np.int32))
            impact.append(raw / raw.sum())
        term, item, impact = np.concatenate(term), np.concatenate(item), np.concatenate(impact)
        order = np.lexsort((item, term))
        self.items, self.impacts = item[order], impact[order]
        self.terms, begin = np.unique(term[order], return_index=True)
        self.at = np.concatenate((begin, [len(term)]))
        self.top = np.concatenate((np.maximum.reduceat(self.impacts, begin), [0.0]))  # the last: no term
        n_blocks = -(-np.diff(self.at) // BLOCK)
        self.block_at = np.concatenate(([0], np.cumsum(n_blocks)))
        nth = np.arange(self.block_at[-1]) - np.repeat(self.block_at[:-1], n_blocks)
        first = np.repeat(begin, n_blocks) + nth * BLOCK
        self.block_max = np.maximum.reduceat(self.impacts, first)
        self.block_last = self.items[np.minimum(first + BLOCK, np.repeat(self.at[1:], n_blocks)) - 1]
        # the same by ranges of items, whatever list they are in: many passages can be held against these at once
        both = term[order].astype(np.uint64)
        new = np.flatnonzero(np.concatenate(([True], (both[1:] != both[:-1]) | (self.items[1:] // RANGE != self.items[:-1] // RANGE))))
        self.range_of, self.range_max = self.items[new] // RANGE, np.maximum.reduceat(self.impacts, new)
        self.range_at = np.searchsorted(new, self.at)
        self.parts = []
        for (_, t), w in zip(items, words, strict=True):
            q, a = (_text_tokens(x) for x in question_and_answer(t))
            self.parts.append((*_grams_of(q), np.unique(a), None if MARKED.search(t) else _grams_of(w)))

    def may_reach(self, q: np.ndarray, least: float) -> np.ndarray:
        """Rows of q (distinct terms, len(self.terms): none) for which the largest impacts in some range of items sum to
        least: no other row can hold an item."""
        wide = -(-len(self.ids) // RANGE)
        row, col = np.nonzero(q < len(self.terms))
        term = q[row, col]
        count = self.range_at[term + 1] - self.range_at[term]
        upto = np.cumsum(count)
        entry = np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.range_at[term] - (upto - count), count)
        sums = np.bincount(np.repeat(row, count) * wide + self.range_of[entry], self.range_max[entry], minlength=len(q) * wide)
        return np.flatnonzero((sums.reshape(len(q), wide) >= least - 1e-6).any(1))

    def wand(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """(item, score) of all items whose impacts over the distinct terms sum to least and more, by block-max WAND."""
        lists = []
        for t in terms:
            a, b, c, d = self.at[t], self.at[t + 1], self.block_at[t], self.block_at[t + 1]
            lists.append((self.items[a:b].tolist(), self.impacts[a:b].tolist(), self.block_last[c:d].tolist(), self.block_max[c:d].tolist(), float(self.top[t])))
        where, out, bound = [0] * len(lists), [], least - SLACK
        live = [(own[0][0], k) for k, own in enumerate(lists)]
        while live:
            live.sort()
            most, pivot = 0.0, -1
            for upto, (item, k) in enumerate(live):
                most += lists[k][4]
                if most >= bound:
                    pivot = item
                    break
            else:
                break  # no later item can reach the threshold
            while upto + 1 < len(live) and live[upto + 1][0] == pivot:
                upto += 1
            most, after = 0.0, live[upto + 1][0] if upto + 1 < len(live) else len(self.ids)
            for _, k in live[: upto + 1]:
                block = bisect_left(lists[k][2], pivot)
                if block < len(lists[k][2]):
                    most += lists[k][3][block]
                    after = min(after, lists[k][2][block] + 1)
            if most < bound:
                goal = max(after, pivot + 1)  # nothing before the end of the nearest block can
            elif live[0][0] == pivot:
                score = sum(lists[k][1][where[k]] for k in sorted(k for _, k in live[: upto + 1]))
                if score >= least:
                    out.append((pivot, score))
                goal = pivot + 1
            else:
                goal = pivot
            moved = []
            for item, k in live[: upto + 1]:
                if item < goal:
                    where[k] = bisect_left(lists[k][0], goal, where[k])
                if where[k] < len(lists[k][0]):
                    moved.append((lists[k][0][where[k]], k))
            live[: upto + 1] = moved
        return out


def build_index(items: list[tuple[int, str]], whole: Statistics) -> tuple[np.ndarray, list[Shard]]:
    """All terms, and shards; items without words can't be found and are left out."""
    by: dict[int, list] = {}
    for i, t in sorted(items):
        if n := len(_text_tokens(t)):
            by.setdefault(stride_of(n), []).append((i, t))
    shards = [Shard(own[a : a + SHARD], stride, whole) for stride, own in sorted(by.items()) for a in range(0, len(own), SHARD)]
    return np.unique(np.concatenate([s.terms for s in shards])) if shards else np.zeros(0, np.uint64), shards


def _passages(count: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of each passage of texts with so many words; words are numbered through."""
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    each = np.where(count > 0, np.maximum(1, -(-(count - 2 * stride) // stride) + 1), 0)
    of = np.repeat(np.arange(len(count)), each)
    start = first[of] + stride * (np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(each)))[:-1], each))
    return of, start, np.minimum(start + 2 * stride, (first + count)[of])


def search_chunk(index: tuple[np.ndarray, list[Shard]], data, at, least: float, least_question: float, least_answer: float):
    """(row, item_id): (question_overlap, answer_overlap, score) of verified matches, the best of each pair."""
    every, shards = index
    h, rows = tokens(data, at)
    best: dict[tuple[int, int], tuple] = {}
    if not len(h) or not len(every):
        return best
    count = np.bincount(rows, minlength=len(at) - 1)
    known = np.flatnonzero(every[np.minimum(np.searchsorted(every, h), len(every) - 1)] == h)  # words that some item has
    word, stride = h[known], 0
    for shard in shards:
        if shard.stride != stride:
            stride = shard.stride
            of, start, end = _passages(count, stride)
            low, high = np.searchsorted(known, start), np.searchsorted(known, end)
        none = len(shard.terms)
        where = np.minimum(np.searchsorted(shard.terms, word), none - 1)
        term = np.where(shard.terms[where] == word, where, none)
        sums = np.concatenate(([0.0], np.cumsum(shard.top[term])))
        alive = np.flatnonzero(sums[high] - sums[low] >= least - 1e-6)  # the bound with repeated words
        step = max(1, STEP_WORDS // (2 * stride))
        for a in range(0, len(alive), step):
            w = alive[a : a + step]
            wide = int((high[w] - low[w]).max())
            at_ = low[w][:, None] + np.arange(wide)
            q = np.where(at_ < high[w][:, None], term[np.minimum(at_, len(term) - 1)], none)
            q.sort(axis=1)
            q[:, 1:][q[:, 1:] == q[:, :-1]] = none  # each term once
            keep = np.flatnonzero(shard.top[q].sum(1) >= least - 1e-6)
            keep = keep[shard.may_reach(q[keep], least)]
            for i in keep.tolist():
                for item, score in shard.wand(np.sort(q[i][q[i] < none]).tolist(), least):
                    row, passage = int(of[w[i]]), h[start[w[i]] : end[w[i]]]
                    n, question, answer, whole = shard.parts[item]
                    own = grams(passage, np.zeros(len(passage), int), n)[0]
                    over_q = float(np.isin(question, own).mean()) if len(question) else 1.0
                    over_a = float(np.isin(answer, passage).mean()) if len(answer) else 1.0
                    if (over_q >= least_question and over_a >= least_answer) or _has_whole(whole, passage):
                        key = (row, int(shard.ids[item]))
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (over_q, over_a, score))
    return best


def _passes(benchmark: DataFrame):
    """The index in broadcasts of bounded size, one for each pass; statistics are those of all items in every pass."""
    spark = benchmark.sparkSession
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(-(-n // ITEMS_PER_PASS), -(-size // BYTES_PER_PASS))

    def part(k: int) -> list[tuple[int, str]]:
        own = rows if passes == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k)
        return [(r.item_id, r.text) for r in own.collect()]

    whole = Statistics()
    held = part(0) if passes == 1 else None
    for k in range(passes):
        whole.add([t for _, t in (held or part(k))])
    for k in range(passes):
        yield broadcast_value(spark, build_index(held or part(k), whole))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, least_question: float = 0.5, least_answer: float = 0.5) -> DataFrame:
    """(doc_id, item_id, question_overlap, answer_overlap, score): documents that hold an item of benchmark
    (item_id, text), the best passage of each pair. Documents without a match have no row.

    An item without a marked answer also matches by WHOLE of its n-grams; its answer_overlap may then be below
    least_answer. Null and empty texts and items match nothing; rows that repeat a doc_id are searched each; items that share an
    item_id count as one if their texts are equal. Other columns are ignored; an empty table on either side gives an empty
    result. No shuffle of the texts. Memory: about 80 bytes a byte of the longest text or of CHUNK_BYTES.
    """
    out = None
    for index in _passes(benchmark):

        def search(batches, index=index):
            found_in = index.value
            for batch in batches:
                for own, data, at in text_chunks(batch):
                    ids = own.column(0)
                    found = [(ids[r].as_py(), i, *x) for (r, i), x in sorted(search_chunk(found_in, data, at, least, least_question, least_answer).items())]
                    cols = list(zip(*found, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], ["doc_id", "item_id", "question_overlap", "answer_overlap", "score"]
                    )

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(search), "doc_id long, item_id long, question_overlap double, answer_overlap double, score double")
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, question_overlap double, answer_overlap double, score double") if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, least_question: float = 0.5, least_answer: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whatever they are called, that hold no item of benchmark; the same rules as
    find_contaminated. Null and empty texts stay, and so do rows with a null doc_id that hold no item; repeated rows are
    each judged. An empty benchmark leaves docs as it is."""
    for index in _passes(benchmark):

        def clean(batches, index=index):
            found_in = index.value
            for batch in batches:
                for own, data, at in text_chunks(batch):
                    hit = {r for r, _ in search_chunk(found_in, data, at, least, least_question, least_answer)}
                    yield own if not hit else own.filter(pa.array([i not in hit for i in range(own.num_rows)]))

        docs = docs.mapInArrow(tidy(clean), docs.schema)
    return docs
