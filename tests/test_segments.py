"""Which words segmentation cuts."""

from test_words import KNOWN
from threadlake.operators import variants as W


def test_words_that_cannot_be_covered_are_not_cut(spark):
    known = spark.createDataFrame(list(KNOWN.items()), "word string, df long")
    words = spark.createDataFrame([("leaserenewal",), ("leasexxx",), ("xxxlease",), ("invxxinv",), ("lease",)], "word string")
    assert sorted(r[0] for r in W.coverable(words, known).collect()) == ["invxxinv", "leaserenewal"]
