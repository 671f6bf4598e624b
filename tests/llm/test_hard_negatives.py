import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from omiclattice.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v string, tile string, rank string"


def brute(rows, anchors, percent=80, k=5):
    """Every anchor against every row; rows are known by their place."""
    held = []
    for i, x, label, *_ in rows:
        if i is not None and label is not None and x and all(e is not None and math.isfinite(e) for e in x):
            held.append((i, label, [math.floor(256 * float(np.float32(e))) for e in x]))
    out = []
    for a, (i, label, q) in enumerate(held):
        if not anchors(i):
            continue
        scored = [(sum(x * y for x, y in zip(q, v)), j, own) for b, (j, own, v) in enumerate(held) if b != a and len(v) == len(q)]
        best = sorted(((s, j) for s, j, own in scored if own == label), key=lambda x: (-x[0], x[1]))[:k]
        for p, j in best:
            near = sorted(((s, n) for s, n, own in scored if own != label and percent * p <= 100 * s <= 100 * p), key=lambda x: (-x[0], x[1]))[:k]
            out += [(i, j, r + 1, n, p, s) for r, (s, n) in enumerate(near)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed, n, dim, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (labels, dim))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        x = (centres[label] * rng.uniform(0, 1) + rng.normal(0, 0.15, dim)).astype(np.float32)
        rows.append((i, [float(e) for e in x], label))
    common = rows[3][1]
    rows += [(n + i, common, int(i % 2)) for i in range(n // 4)]  # one very common vector
    return [(*r, "x", "x", "x", "x") for r in rows]


@pytest.mark.parametrize(("leaf", "tile", "lane", "anchors"), [(64, 2048, 4, 1024), (3, 20, 2, 5)])
def test_equals_brute_force(spark, leaf, tile, lane, anchors, monkeypatch):
    for name, x in (("LEAF", leaf), ("TILE", tile), ("LANE", lane), ("ANCHORS", anchors), ("FANOUT", 2 if leaf == 3 else 8), ("SHARE", 40 if leaf == 3 else 8192)):
        monkeypatch.setattr(hn, name, x)
    rows = vectors(leaf, 400, 8)
    got = result(hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("id") % 10 == 0))
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_odd_rows(spark):
    """Nulls, non-finite numbers, two lengths, repeated rows, few rows of a label, negative scores."""
    rng = random.Random(1)
    x = lambda n: [rng.uniform(-0.2, 0.6) for _ in range(n)]
    rows = [(i, x(3), i % 3) for i in range(60)] + [(i, x(2), i % 2) for i in range(60, 90)]
    rows += [rows[0], rows[0], rows[10], (0, rows[0][1], 1), (None, x(3), 1), (100, None, 1), (110, [], 1), (120, [0.1, None, 0.3], 1), (130, [0.1, float("nan"), 0.2], 0),
             (140, [float("inf"), 0.0, 0.0], 2), (150, x(3), None), (160, x(3), 77), (170, [-0.5, -0.5, -0.5], 0), (180, [0.0, 0.0, 0.0], 0), (190, [1e12, 1e12, 1e12], 5), (200, [1e12, 1e12, 1e12], 5), (210, [1e12, 1e12, 1e12], 6)]
    rows = [(*r, "x", "x", "x", "x") for r in rows if r[1] is None or None in r[1] or max(map(abs, r[1]), default=0) < 1e6]
    table = spark.createDataFrame(rows, SCHEMA)
    got = result(hn.hard_negatives(table, F.col("id") % 10 == 0))
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert any(r[0] == 0 and r[1] == 0 for r in got)  # a repeated row is another row
    assert hn.hard_negatives(table.where("false"), F.col("id") % 10 == 0).count() == 0


def test_products_beyond_doubles(spark):
    rows = [(i, [float(2**22 + i), float(2**22 - 3 * i), 1.0 + i], i % 2) for i in range(30)]
    rows = [(*r, "x", "x", "x", "x") for r in rows]
    assert result(hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0)) == brute(rows, lambda i: i % 10 == 0)


def test_boxes_hold_their_rows_and_are_pruned():
    rng = np.random.default_rng(5)
    data = rng.integers(-300, 300, (2000, 2))
    order, boxes = hn.pack_tree(data)
    assert sorted(order.tolist()) == list(range(2000)) and boxes["level"][-1] == boxes["level"].max()
    t = {"dim": 2, "row": np.arange(2000).astype("<i8").tobytes(), "id": np.arange(2000).astype("<i8").tobytes(), "data": data[order].astype("<i8").tobytes()}
    tree = hn.Tree(t | {k: v.astype("<i4" if k == "level" else "<i8").tobytes() for k, v in boxes.items()})
    q = rng.integers(-300, 300, (20, 2))
    low, high = tree.intervals(q)
    leaves = np.flatnonzero(boxes["level"] == 0)
    opened = 0
    for j, x in enumerate(q):
        s = data[order] @ x
        for box in leaves:
            own = s[boxes["first"][box]:boxes["last"][box]]
            assert low[j, box] <= own.min() and own.max() <= high[j, box]
        seen: dict = {}
        best = tree.search(x.astype(float), low[j], high[j], (-(1 << 60), 1 << 60), [], 5, -1, seen)
        assert [b[0] for b in best] == sorted(s.tolist(), reverse=True)[:5]
        opened += len(seen)
    assert opened < 0.3 * len(leaves) * len(q)
