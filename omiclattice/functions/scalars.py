"""Small column helpers shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from omiclattice.functions.materialise import settle

EPS = 1e-9


def round_half_up(c: Column, digits: int) -> Column:
    """Rounding that does not hang on the last bit of a value ending in 5."""
    return F.round(c + EPS, digits)


def at_least(c: Column, limit: float) -> Column:
    """c >= limit, tolerant of the last bits of a computed score."""
    return c >= limit - EPS


#: Length of the pieces by which texts are indexed.
GRAM = 3


def _grams(c: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda s: F.substring(c, s, size)))


def contained_in(needles: DataFrame, needle: str, hay: DataFrame, text: str) -> DataFrame:
    """Rows of both sides where ``needle`` occurs inside ``text``; an empty needle occurs nowhere.

    Texts are indexed by their pieces of ``GRAM`` letters (of a shorter needle's
    length where there are any): rows linear in the text, which hold a number instead
    of the text. A needle is looked up by the piece that fewest texts have, and
    the texts found are tested once.
    """
    names = settle(needles.where(F.length(needle) > 0).select(F.col(needle).alias("_n")).distinct())
    known = settle(hay.withColumn("_row", F.monotonically_increasing_id()))
    size = F.least(F.length("_n"), F.lit(GRAM))
    sizes = names.agg(F.collect_set(size)).scalar()  # at most GRAM numbers
    # every text once for each length of piece, then its pieces
    sized = known.select("_row", F.col(text).alias("_t")).withColumn("_s", F.explode(sizes)).where(F.length("_t") >= F.col("_s"))
    index = sized.select("_row", F.explode(_grams(F.col("_t"), F.col("_s"))).alias("_g"))
    pieces = settle(names.select("_n", F.explode(_grams(F.col("_n"), size)).alias("_g")))
    asked = settle(index.join(pieces.select("_g").distinct(), "_g", "left_semi"))
    spread = asked.groupBy("_g").agg(F.count(F.lit(1)).alias("_f"))
    rarest = pieces.join(spread, "_g", "left").groupBy("_n").agg(
        F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("f"), F.col("_g").alias("g"))).alias("r")
    ).where("r.f > 0").select("_n", F.col("r.g").alias("_g"))
    met = asked.join(rarest, "_g").select("_row", "_n")
    found = known.join(met, "_row").where(F.contains(F.col(text), F.col("_n")))
    return found.join(needles, F.col("_n") == needles[needle]).drop("_row", "_n")
