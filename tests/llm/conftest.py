import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

#: Documents with clashing extra columns: names that operators use inside.
EXTRA = ["row", "n", "doc", "part", "a", "b", "label", "block", "node", "score", "key", "id", "quality"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, white space, very long, equal and repeated texts, a repeated row and a null id."""
    long = " ".join(f"word{i % 997} and more" for i in range(30_000))
    base = "The quick brown fox jumps over the lazy dog and runs far away from the old wooden house."
    rows = [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, long + " end"), (None, base), (8, "x"),
        (9, "été naïve “quotes” 漢字 \U0001f600 end. mail a.b@c.example.org +1 (743) 555-3824"), (10, "A" * 5000), (-11, base + " Extra."),
    ]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in EXTRA), T.StructField("n_chars", T.LongType())])
    return spark.createDataFrame([(i, t, *["e"] * len(EXTRA), None if t is None else len(t)) for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
