"""Edit similarity of long lines: the edit distance decides, however the texts are shifted."""

import random

import pytest
from pyspark.sql import functions as F

from lexiquarry.llm.lines import LONG, similar


def near(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(similar(F.col("a"), F.col("b"))).head()[0]


@pytest.mark.parametrize("size", [LONG + 2_000, 15_000])
def test_shifted_long_lines(spark, size):
    rng = random.Random(size)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(size))
    extra = "".join(rng.choice("xyz") for _ in range(size // 25))
    # Text put in at the begin and taken off at the end: 8 % of edits at most, but every stretch is shifted.
    assert near(spark, text, extra + text[: -len(extra)])
    assert near(spark, extra + text, text)
    assert not near(spark, text, "".join(rng.choice("xyz") if rng.random() < 0.2 else c for c in text))
