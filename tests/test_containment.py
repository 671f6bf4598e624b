"""Containment by rarest pieces against testing every pair."""

import random

import pytest

from omiclattice.functions import scalars


@pytest.mark.parametrize("seed", range(3))
def test_equals_every_pair(spark, seed):
    rng = random.Random(seed)
    word = lambda lo, hi: "".join(rng.choice("abAé漢 ") for _ in range(rng.randint(lo, hi)))
    needles = [(i, word(0, 6)) for i in range(25)] + [(90, None), (91, "ab"), (92, "ab"), (93, "zzz")]
    texts = [(i, word(0, 25)) for i in range(40)] + [(90, None), (91, ""), (92, "ab"), (93, "ab")]
    n, t = spark.createDataFrame(needles, "i int, needle string"), spark.createDataFrame(texts, "j int, body string").repartition(3)
    got = sorted((r.i, r.j) for r in scalars.contained_in(n, "needle", t, "body").collect())
    assert got == sorted((i, j) for i, a in needles for j, b in texts if a and b is not None and a in b)


def test_nothing(spark):
    n, t = spark.createDataFrame([("a",)], "needle string"), spark.createDataFrame([("xa",)], "body string")
    assert scalars.contained_in(n.where("false"), "needle", t, "body").count() == 0
    assert scalars.contained_in(n, "needle", t.where("false"), "body").count() == 0


def test_index_is_linear_in_the_text(spark):
    """Needles of many lengths do not multiply the pieces of a text."""
    t = spark.createDataFrame([("".join(chr(97 + i % 26) for i in range(500)),)], "body string")
    pieces = t.select(scalars.F.size(scalars._grams(scalars.F.col("body"), scalars.F.lit(scalars.GRAM))).alias("n")).first().n
    assert pieces <= 500
    n = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz"[i:j],) for i in range(5) for j in range(i + 3, 26)], "needle string")
    assert scalars.contained_in(n, "needle", t, "body").count() == n.count()
