import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from omiclattice.llm import ranked_search

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """{item: [(score, doc)]} by the formula, every document by itself."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    nd, nw = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = {}
    for i, own in asked.items():
        found = []
        for d, c, n in held:
            m = 50 + 50 * n * nd // nw
            s = sum(math.floor(1000 * math.log((2 * nd + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0))
        out[i] = [(-s, None if none else d) for s, none, d in sorted(found)[:k]]
    return {i: x for i, x in out.items() if x}


def result(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r.score, r.doc_id))
        assert r.rank == len(out[r.item_id])
    return out


def corpus(seed, n):
    """Words of very uneven frequency in texts of very uneven length, with copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 5, 20, 200]))) for _ in range(n)]
    docs = [(i, texts[i if rng.random() < 0.8 else 3]) for i in range(n)]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 4, 12])))) for i in range(25)]
    return docs, items


@pytest.mark.parametrize(("documents", "k"), [(1 << 16, 50), (7, 50), (40, 3)])
def test_equals_brute_force(spark, documents, k, monkeypatch):
    monkeypatch.setattr(ranked_search, "DOCUMENTS", documents)
    docs, items = corpus(documents, 400)
    table, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert result(ranked_search.ranked_search(table, asked, k)) == brute(docs, items, k)


def test_odd_rows_and_slices(spark, odd_docs, no_docs, monkeypatch):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "The OLD, wooden house!"), (2, None), (3, ""), (4, "..."), (5, "naïve “quotes” 漢字"), (6, "word5 more"), (7, "fox"), (7, "house fox"), (7, "house fox"), (None, "lazy dog"), (8, "nowhere to be found")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 50)
    assert result(ranked_search.ranked_search(odd_docs, asked)) == want and set(want) == {1, 5, 6, 7, None}
    monkeypatch.setattr(ranked_search, "SLICE", 30)
    assert result(ranked_search.ranked_search(odd_docs, asked)) == want
    assert ranked_search.ranked_search(no_docs, asked).count() == 0 and ranked_search.ranked_search(odd_docs, asked.where("false")).count() == 0


def test_accumulators_are_limited():
    """A rare term settles the result before a frequent one makes accumulators, and survivors still get its share."""
    n = 5000
    place = np.r_[np.arange(60), np.arange(n)].astype("<i4")
    term = np.r_[np.zeros(60), np.ones(n)].astype("<i4")
    tf = np.r_[np.full(60, 9), np.arange(n) % 3 + 1].astype("<i4")
    row = {"doc": np.arange(n).astype("<i8").tobytes(), "none": np.zeros(n, "?").tobytes(), "n": np.full(n, 20).astype("<i8").tobytes(),
           "place": place.tobytes(), "term": term.tobytes(), "tf": tf.tobytes()}
    weights = np.array([5000, 300])
    d, s, made = ranked_search.Block(row, n, 20 * n).search(np.array([0, 1]), weights, 50)
    share = lambda f: 1_000_000_000 * f // (1000 * f + 20 * 100)
    want = sorted(((5000 * share(9) + 300 * share(i % 3 + 1), i) for i in range(60)), key=lambda x: (-x[0], x[1]))[:50]
    assert made == 60 and set(want) <= set(zip(s.tolist(), d.tolist()))
