import math
import re
from collections import Counter

import numpy as np
import pytest
from tests.compare import differences

from firegrid.llm import decontamination, language_id, toxicity
from firegrid.llm.oracles import ORACLES
from firegrid.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", name, QUERIES[name], ORACLES[name]) == ""


def _words(text):
    return [w.strip(".,;:!?\"'()[]|") or w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w]


def test_wand_finds_what_full_scores_find():
    rng = np.random.default_rng(6)
    items = [(i, " ".join(f"t{x}" for x in rng.zipf(1.3, int(rng.integers(5, 150))) % 80)) for i in range(300)]
    whole = decontamination.Statistics()
    whole.add([t for _, t in items])
    every, shards = decontamination.build_index(items, whole)
    bags = {i: Counter(_words(t)) for i, t in items}
    df = Counter(w for b in bags.values() for w in b)
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)

    def shares(i):
        size = sum(bags[i].values())
        raw = {w: math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * size / mean)) for w, k in bags[i].items()}
        total = sum(raw.values())
        return {w: x / total for w, x in raw.items()}

    full = {i: shares(i) for i in bags}
    for _ in range(40):
        a, b = rng.choice(300, 2)
        passage = set(rng.permutation([*bags[int(a)], *bags[int(b)]])[: int(rng.integers(4, 60))].tolist())
        want = {i for i, own in full.items() if sum(x for w, x in own.items() if w in passage) >= 0.4}
        near = {i for i, own in full.items() if abs(sum(x for w, x in own.items() if w in passage) - 0.4) < 1e-9}
        hashes = np.unique(decontamination._text_tokens(" ".join(passage)))
        got = set()
        for s in shards:
            own = np.flatnonzero(np.isin(s.terms, hashes))
            found = s.wand(own.tolist(), 0.4)
            got |= {int(s.ids[k]) for k, _ in found}
            q = np.full((1, max(1, len(own))), len(s.terms))
            q[0, : len(own)] = own
            assert not found or len(s.may_reach(q, 0.4))
        assert want - near <= got <= want | near


def test_language_scores_equal_plain_naive_bayes():
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdé ÄßЖ世"), int(rng.integers(0, 40)))) for _ in range(30)]
    rows = [(t, "xyz"[i % 3]) for i, t in enumerate(texts)]
    langs, prior, table = language_id.fit(rows)
    data = "".join(texts).encode()
    at = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    points, cut = language_id.characters(np.frombuffer(data, np.uint8), at)
    got = language_id.score_chunk(language_id._tables()[1][points], cut, prior, table)
    for i, t in enumerate(texts):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
        want = prior.copy()
        for n in language_id.ORDERS:
            for k in range(len(low) - n + 1):
                bucket = language_id._buckets(np.array([ord(c) for c in low[k : k + n]], np.uint32), n)[0]
                want = want + table[:, bucket]
        assert np.allclose(got[i], want, atol=1e-3)
    assert langs == ["x", "y", "z"]


def test_toxicity_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(9)
    net = toxicity.BiGru()
    texts = [" ".join("".join(rng.choice(list("abc"), 3)) for _ in range(n)).encode() for n in (0, 1, 31, 32, 33, 56, 57, 400)]
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together = net.score(np.frombuffer(b"".join(texts), np.uint8), at)
    alone = [net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)
    index, of = toxicity.windows(np.repeat(np.arange(3), [0, 33, 100]), 3)
    for d, n, first in ((1, 33, 0), (2, 100, 33)):
        assert set(index[of == d].ravel().tolist()) - {-1} == set(range(first, first + n))
