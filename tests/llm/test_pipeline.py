"""The pipeline and each of its stages on the smallest tables, against brute force; every opN_ query gives back its rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.llm.test_llm import shingles, words

import corpus_pipeline
from firegrid.llm import quality_classifier
from firegrid.llm.common import remainder
from firegrid.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows of documents, then of each stage, and what the pipeline as a whole gives."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [sorted(docs.collect(), key=lambda r: r.doc_id)]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).localCheckpoint()
        out.append(sorted(docs.collect(), key=lambda r: r.doc_id))
    return out, sorted(corpus_pipeline.run(spark, SMALL).collect(), key=lambda r: r.doc_id)


def test_good_quality_keeps_what_scores_well(spark, stages):
    docs, good = stages[0][:2]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where(remainder(4) != 2)
    scored = quality_classifier.quality_classifier(spark.read.parquet(f"{SMALL}/documents.parquet"), labels)
    well = Counter(r.doc_id for r in scored.where(F.col("score") >= 0.7).collect())
    assert 0 < len(good) < len(docs)
    assert good == [r for r in docs if r.doc_id in well]


def test_one_of_each_against_all_pairs(stages):
    good, one = stages[0][1:3]
    sets = {r.doc_id: shingles(r.text, 5) for r in good}
    least = {i: i for i in sets}
    links = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert one == [r for r in good if least[r.doc_id] == r.doc_id]


def test_without_repeats_against_windows(stages):
    one, without = stages[0][2:4]
    first, want = {}, {}
    for r in one:
        b = (r.text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], r.doc_id) < r.doc_id:
                gone[k : k + 50] = b"\1" * 50
        want[r.doc_id] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    assert [r.doc_id for r in without] == [r.doc_id for r in one]
    # what is left of a cut character goes too
    assert all((r.text or "") == want[r.doc_id].decode(errors="ignore") and r.n_chars == (None if r.text is None else len(r.text)) for r in without)


def test_without_test_items_drops_copies_and_keeps_what_shares_nothing(spark, stages):
    before, after = stages[0][3:5]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect() if words(r.text)]
    trigrams = set().union(*(shingles(t, 3) for t in items))
    kept = {r.doc_id for r in after}
    assert after == [r for r in before if r.doc_id in kept]
    for r in before:
        flat = " ".join(words(r.text))
        if any(" ".join(words(t)) in flat for t in items):
            assert r.doc_id not in kept
        elif not shingles(r.text, 3) & trigrams:
            assert r.doc_id in kept


def test_encoded_and_the_whole_run(stages):
    (*_, clean, encoded), run = stages
    assert [r.doc_id for r in encoded] == [r.doc_id for r in clean]
    assert all(r.round_trip and r.n_tokens == len(r.ids or []) and (r.n_tokens > 0) == bool(words(c.text)) for r, c in zip(encoded, clean, strict=True) if not c.text or words(c.text))
    assert run == encoded


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_gives_back_its_rows(spark, name):
    table, key = ("pages", "page_id") if name == "op7_warc" else ("documents", "doc_id")
    want = Counter(r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(key).collect())
    got = Counter(r[0] for r in QUERIES[name](spark, SMALL).select(key).collect())
    if name == "op3_decontamination":  # rows only for matches
        assert got
        assert got.keys() <= want.keys()
    else:
        assert got == want
