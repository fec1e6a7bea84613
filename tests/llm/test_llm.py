import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from firegrid.llm import decontamination, language_id, ngram_join, quality_classifier, quality_rules, sentencepiece_bpe, sharding, suffix_dedup, toxicity, warc
from firegrid.llm.common import Rolling, Scratch
from firegrid.operators import links

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile("[\x20\x09-\x0d]+")
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def sample():
    base = " ".join(f"w{i}" for i in range(60))
    texts = [
        base, base, base.replace("w30", "x30"), base.replace("w3 ", "y3 ").replace("w50", "z50"), None, "", "   \n", "a", "a b", "a b", "A B", PASSAGE, "start " + PASSAGE + " end", "w " * 3000, "é€🙂 " * 40, "line\nline\nother line\nline",
        " ".join(f"u{i}" for i in range(2000)), " ".join(f"u{i}" for i in range(2000)) + " tail",
    ]
    return [(i + 3, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = sample()
    return spark.createDataFrame([*rows, rows[0]], SCHEMA)  # one row twice


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def shingles(text, n):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "pct"), [(3, 90), (5, 80)])
def test_ngram_join_against_all_pairs(docs, n, pct):
    rows = {i: shingles(t, n) for i, t, *_ in sample()}
    least = {i: i for i in rows}
    for _ in rows:
        for a, x in rows.items():
            for b, y in rows.items():
                if x and y and 100 * len(x & y) >= pct * len(x | y):
                    least[a] = min(least[a], least[b])
    got = ngram_join.ngram_join(docs, n, pct).collect()
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), least[i]) for i, s in rows.items()}


def test_long_lists_in_tiles_against_all_pairs(spark, monkeypatch):
    """Lists longer than a piece, with a large component, chains that the pivot does not reach, and texts apart."""
    rng = np.random.default_rng(3)
    texts = []
    for family, size in (("a", 24), ("b", 9), ("c", 7)):
        own = [f"{family}{i}" for i in range(24)]
        for step in range(size):  # each differs from the one before by a word, so the ends of a chain are far apart
            own = list(own)
            own[step % 24] = f"{family}x{step}"
            texts.append(" ".join(own) + " " + PASSAGE)
    texts += [" ".join(f"r{x}" for x in rng.integers(0, 10**6, 4)) + " " + PASSAGE for _ in range(12)]
    order = rng.permutation(len(texts)).tolist()
    rows = [(int(k), texts[k]) for k in order]
    sets = {i: shingles(t, 3) for i, t in rows}
    least = {i: i for i in sets}
    for _ in sets:
        for a, x in sets.items():
            for b, y in sets.items():
                if 100 * len(x & y) >= 80 * len(x | y):
                    least[a] = min(least[a], least[b])
    cut, plain = [], ngram_join._bounded_pairs
    monkeypatch.setattr(ngram_join, "PIECE", 3)
    monkeypatch.setattr(ngram_join, "_bounded_pairs", lambda tiles, *rest: (cut.append(tiles.where("i <> j").count()), plain(tiles, *rest))[1])
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert cut[0] > 0
    assert {r.doc_id: r.component_id for r in got} == least
    assert len(set(least.values())) < len(rows)


def test_one_id_with_several_texts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, base), (1, other), (2, base + " end"), (3, other + " end"), (4, "left alone here"), (5, ""), (5, base.replace("w3 ", "x ")), (6, " "), (7, None)]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, component_id string, row int")
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.ngram_join(docs, 3, 80).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (5, 1), (6, 6), (7, 7)]
    kept = ngram_join.keep_one(docs, 3, 80)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(1, base), (1, other), (4, "left alone here"), (6, " "), (7, "")])


def test_hash_tells_sequences_apart_that_agree_modulo_powers_of_two():
    x = [0]
    while len(x) < 1024:
        x += [1 - v for v in x]
    a, b = (bytes(97 + (v ^ k) for v in x) for k in (0, 1))
    data = np.frombuffer(a + b" " + b + b" " + a, np.uint8)
    h = Rolling(data).of(np.array([0, 1025, 2050]), np.array([1024, 2049, 3074]))
    assert h[0] == h[2] != h[1]
    assert len(set(ngram_join.shingle_sets(data, np.array([0, len(data)]), 1)[0].tolist())) == 2


def test_tiles_find_what_pairs_find():
    rng = np.random.default_rng(1)
    base = [f"k{i}" for i in range(80)]
    texts = []
    for _ in range(30):
        own = list(base)
        for k in rng.choice(80, rng.integers(0, 4), replace=False):
            own[k] = f"r{rng.integers(1000)}"
        texts.append(" ".join(own).encode())
    sets = [shingles(t.decode(), 3) for t in texts]
    lists = ngram_join.Lists(texts, 3)
    for k in range(30):
        want = [j for j in range(30) if 100 * len(sets[k] & sets[j]) >= 90 * len(sets[k] | sets[j])]
        assert ngram_join.divide_skip(lists.set_of(k), lists.tokens, lists.owners, lists.sizes, 90) == want
    links = ngram_join.tile_links(list(range(30)), list(range(30)), [0] * 30, texts, 3, 90)
    parent = list(range(30))

    def root(p, x):
        return x if p[x] == x else root(p, p[x])

    for a, b in links:
        parent[root(parent, a)] = root(parent, b)
    full = list(range(30))
    for a in range(30):
        for b in range(30):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                full[root(full, a)] = root(full, b)
    assert len({root(parent, i) for i in range(30)}) == len({root(full, i) for i in range(30)})


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in links.components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_suffix_dedup_against_windows(docs):
    first, want = {}, {}
    for i, t, *_ in sorted(sample()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        n_spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[i] = (len(b), sum(gone), n_spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == want
    stripped = {r.doc_id: r.text for r in suffix_dedup.strip_repeats(docs).collect()}
    assert all(stripped[i] is None or len(stripped[i].encode()) <= want[i][0] - want[i][1] for i in want)


def test_suffix_dedup_when_fingerprints_meet(docs):
    want = sorted(map(str, suffix_dedup.suffix_dedup(docs).collect()))
    weak = suffix_dedup._fingers() | {"f1": F.length("text") % 3}
    assert sorted(map(str, suffix_dedup.suffix_dedup(docs, fingers=weak).collect())) == want


def test_common_leading_bytes_go_suffix_by_suffix(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda k: " ".join("".join(rng.choice(list("abcdef"), 4)) for _ in range(k))
    shared = word(30)
    texts = [f"{word(5)} {shared[: int(rng.integers(60, len(shared)))]} {word(5)}" for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    first, want = {}, {}
    for i, t in enumerate(texts):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                gone[k : k + 50] = b"\1" * 50
        want[i] = sum(gone)
    for common in (1, 6, 1000):
        monkeypatch.setattr(suffix_dedup, "COMMON", common)
        assert {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs).collect()} == want


def test_splitters_take_little_of_the_driver(spark):
    rng = np.random.default_rng(2)
    texts = ["the same words begin each of these texts " * 2 + " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, 150)) for _ in range(1500)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    leads, held = [], Counter()
    for t in texts:
        raw = t.encode()
        _, pos, *_ = suffix_dedup.anchors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 50)
        own = [int.from_bytes(raw[p : p + 8]) for p in pos.tolist()]
        leads += own
        held.update(set(own))
    common = {x for x, k in held.items() if k >= suffix_dedup.COMMON}
    rest = sorted(x for x in leads if x not in common)
    want = sorted({rest[i] for i in np.linspace(0, len(rest) - 1, 41).astype(int)[1:-1]})
    tracemalloc.start()
    cuts, found = suffix_dedup._splitters(docs, len(texts), 50, 40)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert common
    assert (cuts.tolist(), found) == (want, common)
    assert peak < 64 << 20


def test_rows_do_not_move_to_be_kept(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [(None, base), (1, base), (2, base + " end"), (2, "alone"), (3, None), (4, ""), (5, "own words here"), (0, "x y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA)
    want = sorted((i or 0, t or "") for i, t in texts if i != 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.keep_one(docs, 3, 80)
        assert "Exchange" not in kept._jdf.queryExecution().toString()
        assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == want
        monkeypatch.setattr(ngram_join, "DROPPED_IDS", 0)
        assert sorted((r.doc_id or 0, r.text or "") for r in ngram_join.keep_one(docs, 3, 80).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_strip_repeats_keeps_texts_of_one_id_apart(spark):
    first, second = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, first), (2, first), (2, second), (2, second), (3, None), (None, first), (4, ""), (5, "short")]
    docs = spark.createDataFrame([(i, t, k, [k], t, str(k)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, removed int, `row` array<int>, f1 string, `n.bytes` string")
    got = suffix_dedup.strip_repeats(docs)
    assert got.columns == docs.columns
    want = [first, "", second, second, None, first, "", "short"]
    assert sorted((r.removed, r.text or "", r.f1 or "") for r in got.collect()) == sorted((k, w or "", t or "") for k, ((_, t), w) in enumerate(zip(rows, want, strict=True)))


def test_rows_with_null_ids_come_back(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [(None, base), (1, base + " end"), (2, base + " end"), (None, "only here " * 30), (None, "only here " * 30), (None, None), (3, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA).coalesce(1)
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_join.ngram_join(docs, 3, 90).collect())
    assert got == [(0, 0)] * 4 + [(1, 1), (2, 1), (3, 3)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in ngram_join.keep_one(docs).collect())
    assert kept == sorted((i or 0, t or "") for i, t in texts if i != 2)
    cut = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(docs).collect())
    n = len(base)
    assert cut == sorted([(0, n, 0), (1, n + 4, 0), (2, n + 4, n + 4), (0, 300, 0), (0, 300, 0), (0, 0, 0), (3, 5, 0)])
    big = "x" * 1500
    pages = spark.createDataFrame([(None, "http://a.net", big), (None, "http://a.net", None), (1, "http://a.net", big), (2, None, big)], "page_id long, url string, html string")
    want = [(0, 0, "response", None), (0, 1500, "response", None), (1, 1500, "revisit", 2), (2, 1500, "response", None)]
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()) == want


def test_quality_rules_against_counting(docs):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t, *_ in sample():
        w = words(t)
        three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(three)
        inside = {k + j for k, g in enumerate(three) if often[g] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].n_dup_lines) == (len(w), sum(map(len, w)), len(inside), len(lines) - len(set(lines)))
        assert got[i].n_symbols == sum(c in "#*$%&|<>" for c in t or "")


def test_sharding_is_exact(docs):
    rows = sharding.shard_documents(docs, 5).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows"
        assert r.grown_shard is None
    sizes = [len(by.get(s, [])) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {i: t or "" for i, t, *_ in sample()}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.size == len(text[r.doc_id].encode()) + 8 for r in rows)
    m = sharding.communication_matrix([10, 0, 7], [6, 6, 5], 1)
    assert m.sum(1).tolist() == [10, 0, 7]
    assert m.sum(0).tolist() == [6, 6, 5]
    assert 0 <= sharding._hypergeometric(np.random.default_rng(1), 10**10, 10**10, 10**6) <= 10**6


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://a.example.com/p?q=1", big), (2, "https://b.example.org/", big), (3, None, None), (4, "http://a.example.com/p?q=1", "é" * 700), (5, "bad url[", "small"), (6, "http://c.net", "small")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = {i: (len((h or "").encode()), sha(h), "response", None) for i, _, h in rows}
    want[1] = (1500, sha(big), "revisit", 2)
    assert got == want
    held = Scratch(spark)
    archives, captures = warc.write_archives(pages, held)
    found = warc.lookup(warc.build_index(captures, held), spark.createDataFrame([("com,example,a)/p?q=1",), ("nothing",)], "url_key string"))
    assert sorted(r.page_id for r in found.collect()) == [1, 4]
    assert warc.export_archives(archives, str(tmp_path))
    held.clear()


def test_warc_keeps_odd_pages(spark):
    big = "x" * 1500
    urls = ["http://[bad\tx", "http://[bad\nx", "http://[bad\rx", "http://a.net/\tx", None, "", "HTTP://A.NET:8080/é?ü", "a" * 5000, "\u2028[", "http://a.net/%0a"]
    rows = [(i, u, big if i % 3 else None, "x", i) for i, u in enumerate(urls)] + [(3, urls[3], big, "x", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, refers_to int")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.round_trip(pages).collect())
    large = max(i for i, _, h, *_ in rows if h)
    assert got == sorted((i, len(h or ""), "revisit" if h and i != large else "response", large if h and i != large else 0) for i, _, h, *_ in rows)
    held = Scratch(spark)
    index = warc.build_index(warc.write_archives(pages, held)[1], held)
    asked = spark.createDataFrame([(warc.url_key(urls[0]),), (None,), (")http://[bad\nx",)], "url_key string")
    assert sorted(r.page_id for r in warc.lookup(index, asked).collect()) == [0, 1]
    held.clear()


def test_language_id(spark):
    rows = [(i, t * 20, lang) for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de")] * 5)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ask = spark.createDataFrame([(1, "the dog and a cat"), (2, "und der die hund"), (3, None), (4, "123 !!"), (5, "")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.language_id(ask, train).collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "what is the tallest peak of the western range near the lake. it is mount zorblax."), (2, None), (3, "")], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(500))
    docs = spark.createDataFrame([(10, f"{filler} What is the tallest peak of the western range near the lake. It is Mount Zorblax. {filler}"), (11, filler), (12, None), (13, "the lake is near")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.find_contaminated(docs, items).collect()] == [(10, 1)]
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()) == [11, 12, 13]


def test_decontamination_of_items_without_marked_answer(spark):
    body = " ".join(f"b{i}" for i in range(30))
    items = spark.createDataFrame([(1, f"{body}. Zorblax."), (2, f"Q: {body.replace('b', 'c')}?\nA: Zorblax")], "item_id long, text string")
    filler = " ".join(f"f{i}" for i in range(200))
    texts = [f"{filler} {body}. Other. {filler}", f"{filler} {body} {filler}", f"{filler} {body.replace('b', 'c')}? other {filler}", " ".join(body.split()[:18]) + ". Other."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.find_contaminated(docs, items).collect()) == [(0, 1), (1, 1)]
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()) == [2, 3]


def test_decontamination_does_not_depend_on_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.4, int(rng.integers(8, 90))) % 60) for _ in range(40)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(i, " ".join(f"f{k}" for k in range(100)) + " " + " ".join(w for w in t.split() if rng.random() < 0.8)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def found():
        return {(r.doc_id, r.item_id): (r.question_overlap, r.answer_overlap, r.score) for r in decontamination.find_contaminated(docs, items).collect()}

    once = found()
    monkeypatch.setattr(decontamination, "ITEMS_PER_PASS", 7)
    several = found()
    assert once
    assert several.keys() == once.keys()
    assert all(several[k] == pytest.approx(once[k], abs=1e-5) for k in once)


def test_sentencepiece_equals_library(docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.MODEL)
    got = {r.doc_id: r for r in sentencepiece_bpe.encode(docs).collect()}
    for i, t, *_ in sample():
        assert got[i].round_trip
        assert (got[i].ids, got[i].decoded) == ((None, None) if t is None else (sp.encode(t), t))


def test_pairs_of_pieces_learned_late_are_not_sorted_among_all_known_ones(monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.MODEL)
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(40)) for _ in range(50)]
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    want = [i for t in texts for i in sp.encode(t)]
    sorted_ = []
    argsort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: (sorted_.append(len(x)), argsort(x, *a, **k))[1])
    encoder = sentencepiece_bpe.Encoder(sentencepiece_bpe.Vocabulary())
    known = np.arange(400_000) - (1 << 40)  # no real pair has such a key
    encoder.old_pairs = (known, np.zeros(len(known), bool))
    encoder.pair_key, encoder.pair_ok = encoder.old_pairs
    assert encoder.encode_chunk(data, at)[0].tolist() == want
    assert max(sorted_) < len(known)
    for young, kept in ((1, 1 << 20), (50, 400), (1 << 20, 100)):  # merged at once, merged and forgotten, forgotten
        monkeypatch.setattr(sentencepiece_bpe, "YOUNG_PAIRS", young)
        monkeypatch.setattr(sentencepiece_bpe, "KEPT_PAIRS", kept)
        assert sentencepiece_bpe.Encoder(encoder.v).encode_chunk(data, at)[0].tolist() == want


def _labelled():
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(300):
        w = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
        if i % 2:
            w[int(rng.integers(60))] = "badword"
        texts.append(" ".join(w).encode())
        labels.append(i % 2)
    return texts, np.array(labels, np.float32)


def test_toxicity_learns_a_word():
    texts, labels = _labelled()
    net = toxicity.BiGru().fit(texts[:200], labels[:200])
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts[200:]])))
    score = net.score(np.frombuffer(b"".join(texts[200:]), np.uint8), at)
    assert ((score >= 0.5) == labels[200:]).mean() > 0.9


def test_quality_net_scores_long_texts_in_pieces_like_whole():
    rng = np.random.default_rng(2)
    net = quality_classifier.ByteConvNet()
    piece = (1 << 14) * quality_classifier.STEP
    for n in (piece - 9, piece + 1, piece + 9, 2 * piece + 17, 3):
        text = rng.integers(97, 105, n).astype(np.uint8)
        codes, flags, first, live, _ = quality_classifier._blocks(text, np.array([0, n]))
        logit = net.head(net.respond(codes, flags, live).max(0)[None])[1][0]
        assert net.score(text, np.array([0, n]))[0] == pytest.approx(1 / (1 + np.exp(-float(logit))), abs=1e-6)


def test_quality_net_learns_symbols():
    texts, labels = _labelled()
    texts = [t.replace(b" ", b"### ") if y else t for t, y in zip(texts, labels, strict=True)]
    net = quality_classifier.ByteConvNet().fit(texts[:200], labels[:200], epochs=3)
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts[200:]])))
    score = net.score(np.frombuffer(b"".join(texts[200:]), np.uint8), at)
    assert ((score >= 0.5) == labels[200:]).mean() > 0.95


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for got in (
        quality_rules.quality_rules(none), ngram_join.ngram_join(none), suffix_dedup.suffix_dedup(none), sharding.shard_documents(none), language_id.language_id(none, none),
        decontamination.find_contaminated(none, items), sentencepiece_bpe.encode(none), quality_classifier.quality_classifier(none, labels), toxicity.toxicity(none, labels),
        warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert got.count() == 0


def test_lists_cut_between_tasks_keep_one_pivot(spark):
    rows = [(t, c, 10 + c % 7) for t, k in ((1, 1), (2, 2), (3, 900), (4, 3), (5, 1), (6, 2)) for c in range(5 * t, 5 * t + k)]
    held = Scratch(spark)
    got = ngram_join._lists(spark.createDataFrame(rows, "token long, cid long, size long"), held, 8).collect()
    real = {(r.token, r.cid, r.size) for r in got}
    assert len(got) == len(real) and real >= {x for x in rows if x[0] in (2, 3, 4, 6)}
    for r in got:
        assert (r.pivot, r.pivot_size) == (5 * r.token, 10 + 5 * r.token % 7)
        assert r.wide or r.token in (2, 5, 6, 1)
    held.clear()
