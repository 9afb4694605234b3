"""The inverted index against scores taken from the texts."""

import random

import pytest
from pyspark.sql import functions as F

from threadlake.functions import text as X
from threadlake.operators import postings as P
from threadlake.operators import search as S


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["tin", "oak", "rye", "elm", "fig"]
    rows = [(i, " ".join(rng.choices(words, weights=(40, 8, 4, 2, 1), k=rng.randint(0, 30)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "fig " * 60), (403, "fig fig"), (404, "fig fig"), (None, "fig")]
    return rows


@pytest.fixture(scope="module")
def made(spark, texts, tmp_path_factory):
    """An index with slabs of a few rows, so that terms have many blocks."""
    old, P.SLAB = P.SLAB, 16
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    rows = spark.createDataFrame(texts, "id long, text string")
    P.built(rows, "id", {"text": X.tokens(F.col("text"))}, path, 4)
    P.SLAB = old
    return rows.where("id is not null"), P.Index(spark, path, "id")


def test_scores_equal_those_of_the_texts(made):
    rows, index = made
    for words in (["oak", "fig"], ["tin"], ["none"], ["fig", "none", "rye"]):
        want = {r["id"]: round(r["score"], 9) for r in S.bm25(S.corpus(rows, "text", X.tokens), words).collect()}
        assert {r["id"]: round(r["score"], 9) for r in index.bm25(words).collect()} == want


@pytest.mark.parametrize("words", [["fig"], ["fig", "tin"], ["elm", "oak", "rye"], ["none"]])
@pytest.mark.parametrize("k", [1, 5, 40])
def test_first_k_equal_all_ranked(made, words, k):
    _, index = made
    every = sorted((-round(r["score"], 6), r["id"]) for r in index.bm25(words).collect())
    assert [(-r["score"], r["id"]) for r in index.top(words, k).collect()] == [(s, i) for s, i in every[:k]]


def test_first_k_leave_blocks_out(made):
    """A frequent word's blocks cannot reach what a rare one has."""
    _, index = made
    blocks = index.of(["fig", "tin"]).count()
    plan = index.top(["fig", "tin"], 3)
    read = plan._jdf.queryExecution().toString()
    assert "max_tf" in read and blocks > 20


def test_plan_reads_the_words_alone(made):
    _, index = made
    plan = index.bm25(["oak"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket").replace("(bucket", "bucket") or "bucket" in plan.split("PartitionFilters:")[1][:120]
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters:")[1][:200]
    assert "text" not in plan.split("ReadSchema:")[1][:200]


def test_matching_and_fields(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", "b"), (2, "b b", None), (3, None, "a")], "id long, s string, t string")
    path = f"file://{tmp_path}/i"
    P.built(rows, "id", {"s": X.tokens(F.col("s")), "t": X.tokens(F.col("t"))}, path)
    index = P.Index(spark, path, "id")
    assert sorted(r[0] for r in index.matching(["a"]).collect()) == [1, 3]
    assert sorted(r[0] for r in index.matching(["a"], ["s"]).collect()) == [1]
    assert sorted(tuple(r) for r in index.frequencies(["a", "b"], {"s": 2.0, "t": 0.5}).collect()) == [(1, 3, 2.0, 2.5), (2, 2, 0.0, 4.0), (3, 1, 0.5, 0.0)]
    assert sorted(tuple(r) for r in P.index_report(index).collect()) == [("s", 2, 3, 4), ("t", 2, 2, 2)]


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    P.built(spark.createDataFrame([], "id long, text string"), "id", {"text": X.tokens(F.col("text"))}, path)
    index = P.Index(spark, path, "id")
    assert index.bm25(["a"]).collect() == [] and index.top(["a"], 3).collect() == [] and index.matching(["a"]).collect() == []


def test_index_is_found_again_and_made_anew_for_other_files(spark, tmp_path):
    folder = f"{tmp_path}/t.parquet"
    spark.createDataFrame([(1, "a")], "id long, text string").write.parquet(folder)
    fields = {"text": X.tokens(F.col("text"))}
    first = P.opened(spark.read.parquet(folder), "id", fields, "again")
    assert P.opened(spark.read.parquet(folder), "id", fields, "again").path == first.path
    spark.createDataFrame([(2, "a")], "id long, text string").write.mode("append").parquet(folder)
    other = P.opened(spark.read.parquet(folder), "id", fields, "again")
    assert other.path != first.path and sorted(r[0] for r in other.matching(["a"]).collect()) == [1, 2]


def test_identifiers_that_repeat_meet_in_their_slab(spark, tmp_path):
    """Blocks say how many tokens they hold, so the mean length needs no second look at the texts."""
    rows = spark.createDataFrame([(i % 50, "a b a c" if i % 3 else "b d") for i in range(100)], "id long, text string")
    rows.write.parquet(f"{tmp_path}/t")
    P.built(spark.read.parquet(f"{tmp_path}/t"), "id", {"text": X.tokens(F.col("text"))}, f"file://{tmp_path}/i")
    index = P.Index(spark, f"file://{tmp_path}/i", "id")
    assert index.n == 50
    assert sum(r["tf0"] for r in index.frequencies(["a"]).collect()) == 2 * 66
    assert index.blocks.select("tokens").agg(F.sum("tokens")).first()[0] == 66 * 4 + 34 * 2
