import random
import re

import numpy as np
import pyarrow as pa
import pytest

from omiclattice.llm import decontaminate, graph, near_join, words

SF = "/root/testdata/sf0.001"


def shingles(text, size=4):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if len(w) >= size:
        return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute_components(docs, size, percent):
    sets = [(i, shingles(t, size)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1:]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


@pytest.mark.parametrize("tile", [1 << 18, 40])
def test_near_join_equals_brute_force(spark, odd_docs, tile, monkeypatch):
    monkeypatch.setattr(near_join, "TILE", tile)  # 40: every group is searched in tiles
    if tile == 40:
        monkeypatch.setattr(near_join, "POINTS", 2)
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(50)]
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 14, 30, 90]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append((100 + len(docs), " ".join(w)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = near_join.near_join(table).collect()
    assert len(got) == len(docs)
    want, texts = brute_components(docs, 4, 85), dict(docs)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.component_id == want[r.doc_id] and r.n_shingles == len(shingles(texts[r.doc_id]))


@pytest.mark.parametrize("tile", [1 << 18, 40])
def test_near_join_of_one_id_with_several_texts(spark, tile, monkeypatch):
    monkeypatch.setattr(near_join, "TILE", tile)
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (5, one), (5, two), (9, two + " end"), (9, two + " end"), (12, "alone in this table"), (5, None), (7, "")]
    got = near_join.near_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(1, 1), (5, 1), (9, 1), (12, 12), (7, 7)}


def test_near_join_of_large_sets(spark, monkeypatch):
    # sets above GROUPS share long passages without a link, or are near copies in a chain
    monkeypatch.setattr(near_join, "TILE", 1500)
    monkeypatch.setattr(near_join, "COORDINATES", 4096)
    rng, docs = random.Random(9), []
    for k in range(6):
        shared = [f"s{k}-{rng.randrange(10**6)}" for _ in range(900)]
        for _ in range(4):
            w = shared + [f"o{rng.randrange(10**9)}" for _ in range(rng.choice([100, 250, 700]))]
            for _ in range(rng.choice([1, 3])):
                docs.append((len(docs) * 7 % 101, " ".join(w)))
                w = list(w)
                for i in rng.sample(range(len(w)), 12):
                    w[i] = f"x{rng.randrange(10**9)}"
    got = {r.doc_id: r.component_id for r in near_join.near_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    want = brute_components(docs, 4, 85)
    assert len(set(want.values())) > 6 and got == want


def test_leaves_compared_side_by_side_equal_a_tree_each():
    rng = np.random.default_rng(3)
    size = rng.integers(2, 17, 60)
    first = np.cumsum(size) - size
    base = rng.integers(0, 3, (8, near_join.GROUPS))
    points = base[rng.integers(0, 8, size.sum())] + rng.binomial(1, 0.15, (size.sum(), near_join.GROUPS))
    label = rng.integers(0, 200, len(points))
    packed = pa.chunked_array([pa.array([near_join.packed(x * (300 if i % 7 == 0 else 1)) for i, x in enumerate(points)])])
    points[::7] *= 300
    read = near_join._points(packed)
    assert np.array_equal(read, points)
    u, v = near_join.leaf_links(read, label, first, size, 80)
    parts = lambda a, b: {frozenset(np.flatnonzero(x == y)) for x in [joined(label, a, b)] for y in np.unique(x)}

    def joined(label, a, b):
        label = label.copy()
        for i, j in zip(a, b):
            label[label == label[j]] = label[i]
        return label

    pairs = []
    for at, n in zip(first, size):
        own = [x.astype(np.int64) for x in points[at:at + n]]
        pairs += [(at + i, at + j) for i, j in near_join.links_of(own, label[at:at + n], 80)]
    assert len(u) and parts(u, v) == parts(*zip(*pairs))


def test_products_of_ones_are_overlaps(monkeypatch):
    rng = np.random.default_rng(4)
    points = rng.poisson(1.2, (150, 64))
    points[75:] = np.maximum(points[:75] + rng.integers(-1, 2, (75, 64)) * (rng.random((75, 64)) < 0.1), 0)
    ones = near_join._ones(points)
    overlap = np.minimum(points[:, None], points[None]).sum(2)
    assert np.array_equal(ones @ ones.T, np.where(np.eye(150, dtype=bool), ones.sum(1), overlap))
    found = lambda: {(min(i, j), max(i, j)) for u, v in near_join.near_pairs(points, np.arange(150), np.arange(150), np.ones(150, bool), 80) for i, j in zip(u.tolist(), v.tolist()) if i != j}
    fast = found()
    monkeypatch.setattr(near_join, "ONES", 0)
    assert fast == found() and len(fast) >= 60


def test_runs_across_batches():
    group, doc = np.repeat([3, 5, 6, 9], [2, 7, 1, 4]), np.arange(14)
    batches = pa.table({"group": group, "doc": doc}).to_batches(3)
    got = [x["doc"].to_pylist()[a:b] for x, at in near_join._runs(iter(batches), ["group"], ["doc"]) for a, b in zip(at[:-1], at[1:])]
    assert got == [[0, 1], [2, 3, 4, 5, 6, 7, 8], [9], [10, 11, 12, 13]]


def test_coarser_points_bound_the_overlap():
    rng = np.random.default_rng(3)
    for n in (300, 700, 1100, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        b = np.unique(np.r_[a[:int(n * 0.7)], rng.integers(0, 1 << 63, n // 2, np.uint64)])
        points, rows, lowest = next(near_join.levels([near_join.point(s, near_join.fine(len(s))) for s in (a, b)], 80)) if near_join.fine(len(a)) == near_join.fine(len(b)) \
            else next(near_join.levels([near_join.point(s) for s in (a, b)], 80))
        assert (points.sum(1) == (len(a), len(b))).all() and np.minimum(*points).sum() >= len(np.intersect1d(a, b))
        x = near_join.point(a, near_join.fine(len(a)))
        assert (near_join.unpacked(near_join.packed(x)) == x).all() and (x.reshape(near_join.GROUPS, -1).sum(1) == near_join.point(a)).all()


def test_near_join_of_nothing(no_docs):
    assert near_join.near_join(no_docs).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 85, 90])
def test_linked_sets_meet(percent):
    rng = np.random.default_rng(0)
    classes, bounds, linked = near_join.size_classes(percent), {}, 0
    for _ in range(4000):
        n = int(rng.integers(1, 60)) if rng.random() < 0.8 else int(rng.integers(60, 400))
        a = np.unique(words.mix(rng.integers(0, 1 << 62, n).astype(np.uint64)))
        b = np.unique(np.r_[rng.permutation(a)[rng.integers(0, n // 4 + 2):], words.mix(rng.integers(0, 1 << 62, rng.integers(0, n // 4 + 2)).astype(np.uint64))])
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= percent * (len(a) + len(b) - common):
            linked += 1
            assert len(np.intersect1d(near_join.meeting_keys(a, percent, classes, bounds), near_join.meeting_keys(b, percent, classes, bounds)))
    assert linked > 300


def test_components_of_a_long_chain_and_a_star(spark):
    rng = random.Random(2)
    names = rng.sample(range(10_000), 300)
    chain = list(zip(names, names[1:]))
    star = [(20_000, 20_001 + i) for i in range(200)]
    links = spark.createDataFrame([(min(e), max(e)) for e in chain + star], "a long, b long").repartition(7)
    got = {r.node: r.component for r in graph.components(links).collect()}
    assert {got[n] for n in names} == {min(names)} and {got[20_000 + i] for i in range(201)} == {20_000}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("n", [5, 8, 20, 60, 150])
def test_lsh_keeps_edited_windows_and_few_others(n):
    """Of 200 windows at the edit limit 0.95 or more share a key with their item, of unrelated ones of the same vocabulary
    0.02 or fewer, and of those without its words none. The item's words in another order are counted, not bounded."""
    rng, kept, unrelated, dealt, foreign = np.random.default_rng(n), 0, 0, 0, 0
    for _ in range(200):
        drawn = rng.integers(0, 3000, 2 * n)
        items = decontaminate.Items([(1, " ".join(f"v{x}" for x in drawn[:n]))], 0.8, 0.99)
        own = items.symbols[0]
        symbol = dict(zip(drawn[:n].tolist(), own.tolist()))
        near = own.tolist()
        for _ in range(int(items.edits[0])):
            at, what = int(rng.integers(len(near))), rng.integers(3)
            near[at:at + (what < 2)] = [] if what == 0 and len(near) > 2 else [int(rng.integers(0, items.base))]
        windows = np.array([own, (near + [0] * n)[:n], [symbol.get(x, 0) for x in drawn[n:].tolist()], rng.permutation(own), np.zeros(n, int)])
        got = items.alike(decontaminate.embed(windows, items.bits), 0)
        assert got[0]
        kept, unrelated, dealt, foreign = kept + got[1], unrelated + got[2], dealt + got[3], foreign + got[4]
    assert kept >= 190 and unrelated <= 4 and foreign == 0
    print(f"{n} words: kept {kept}, unrelated {unrelated}, reordered {dealt} of 200")


def test_decontamination_recall_and_verification():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 60)))) for i in range(40)]
    index = decontaminate.Items(items, 0.8, 0.99)
    hits = total = 0
    for i, t in items:
        for share in (0, 0.1, 0.19):
            w = t.split()
            for _ in range(int(len(w) * share)):
                at, how = rng.randrange(len(w)), rng.random()
                if how < 0.4:
                    w[at] = rng.choice(vocabulary)
                elif how < 0.7:
                    del w[at]
                else:
                    w.insert(at, rng.choice(vocabulary))
            text = " ".join([*(rng.choice(vocabulary) for _ in range(30)), *w, *(rng.choice(vocabulary) for _ in range(30))])
            buf, offs = words.buffers(pa.array([text, "nothing of the kind here at all " * 9]))
            h, row, _, _ = words.words(buf, offs, True, words.NOT_WORD)
            found = list(index.search(h, row))
            total += 1
            hits += any(index.names[x[0]] == i for x in found)
            for item, first, n, d in found:
                assert row[first] == 0 and d == edits(items[item][1].split(), text.split()[first:first + n + 12]) <= index.edits[item]
    assert hits / total >= 0.97


def test_decontamination_of_tables(spark, odd_docs, no_docs, monkeypatch):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the LAZY dog"), (2, "too short"), (3, None), (4, "")], "item_id long, text string")
    got = decontaminate.leaks(odd_docs, bench).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, -11), (False, 1), (False, 2), (False, 2), (True, 0)]
    assert all((r.item_id, r.start, r.end, r.distance) == (1, 0, 43, 0) for r in got)
    kept = decontaminate.clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10]
    assert decontaminate.leaks(no_docs, bench).count() == 0 and decontaminate.leaks(odd_docs, bench.where("false")).count() == 0
    monkeypatch.setattr(decontaminate, "SLICE", 20)  # a benchmark searched in slices
    assert decontaminate.leaks(odd_docs, bench).count() == len(got)


def test_leaks_of_the_test_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    flat = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if f" {flat(b.text)} " in f" {flat(d.text or '')} "}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).where("distance = 0").collect()}
    assert got == want
