"""Joined words, word forms, company and passages against brute force."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlake.functions import text as X
from threadlake.operators import passages as G
from threadlake.operators import postings as P
from threadlake.operators import variants as W

KNOWN = {"lease": 20, "renew": 9, "renewal": 12, "alle": 3, "ase": 2, "aser": 5, "ser": 7, "enew": 4, "als": 6, "invoice": 40, "voice": 9, "inv": 30, "oice": 3}


def exhaustive(word, total):
    found = []

    def go(at, path, score):
        if at == len(word):
            found.append((-score, " ".join(path)))
        for k, df in KNOWN.items():
            if word.startswith(k, at) and k != word:
                go(at + len(k), [*path, k], round(score + math.log(df / total), 9))

    go(0, [], 0.0)
    return min(found)[1] if found else None


def test_segmentation_equals_exhaustive_search(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choices(list(KNOWN), k=rng.randint(1, 4))) for _ in range(80)} | {"leaserenewal", "abc", "xinvoice", "", "invoicex"})
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string")
    known = spark.createDataFrame(list(KNOWN.items()), "word string, df long")
    got = {r["word"]: r["split"] for r in W.segmented(df, known, 100).collect()}
    want = {w: s for w in words if len(w) >= 6 and (s := exhaustive(w, 100)) is not None}
    assert got == want and got["leaserenewal"] == "lease renewal" and "invoice" in got


def test_forms(spark):
    words = ["colour", "parties", "using", "is", "", "organise", "fence", "go"]
    rows = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string").select("w", W.forms(F.col("w")).alias("f")).collect()
    for r in rows:
        w, want = r["w"], set()
        for x, y in W.ENDINGS:
            for a, b in ((x, y), (y, x)):
                if w is not None and w.endswith(a) and len(w) >= 3 + len(a):
                    want.add(w[: len(w) - len(a)] + b)
        assert sorted(r["f"] or []) == sorted(want - {w}), w
    by = {r["w"]: r["f"] for r in rows}
    assert "color" in by["colour"] and "party" in by["parties"] and "organize" in by["organise"] and by["go"] == [] and "use" not in by["using"]


def test_company(spark, tmp_path):
    rows = [(1, "red barn door"), (2, "red bard"), (3, "bard song"), (4, "bard song"), (5, "barn red red"), (6, None)]
    path = f"file://{tmp_path}/i"
    P.built(spark.createDataFrame(rows, "id long, t string"), "id", {"t": X.tokens(F.col("t"))}, path)
    ix = P.Index(spark, path, "id")
    c = spark.createDataFrame([("q", "barn", 2), ("q", "bard", 3), ("z", "bard", 3), ("z", "none", 9)], "query string, word string, df long")
    others = spark.createDataFrame([("q", "red"), ("q", "door"), ("z", "void")], "query string, word string")
    assert sorted(map(tuple, W.together(ix, c, others, "query", "word").collect())) == [("q", "bard", 1), ("q", "barn", 2)]
    assert sorted((r["query"], r["word"], r["together"]) for r in W.respelled_by_company(ix, c, others, "query", "word").collect()) == [("q", "barn", 2), ("z", "none", 0)]


def all_windows(text, weights, size):
    found = [(m.start(), m.end(), G.folded(m[0])) for m in G._TOKEN.finditer(text)]
    best = None
    for start, own_end, word in found:
        if word in weights:
            inside = {w for a, b, w in found if w in weights and a >= start and (b <= start + size or (a, b) == (start, own_end))}
            score = round(sum(weights[w] for w in inside), 9)
            if best is None or score > best[1]:
                best = (start, score)
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "Cd", "é", "longword", "x", " ", ". "]), max_size=40), st.integers(1, 30))
def test_best_window_equals_all_windows(parts, size):
    weights = {"ab": 1.5, "cd": 0.7, "e": 2.0, "longword": 0.3}
    text = " ".join(parts)
    got = G.best_window(text, weights, size)
    assert (got and got[:2]) == all_windows(text, weights, size)


def test_passages_of_nulls_and_long_texts(spark):
    rows = [(1, "x " * 50_000 + "needle hay " + "y " * 50_000), (2, None), (3, ""), (4, "nothing"), (5, "Needle  in\nhay")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r for r in G.best_passages(df.select("id"), df, "id", "text", {"needle": 2.0, "hay": 1.0}, 40).collect()}
    assert set(got) == {1, 5} and got[5]["passage"] == "Needle in hay" and got[5]["start"] == 0
    assert got[1]["start"] == 100_000 and got[1]["passage"].startswith("needle hay y")


def test_company_of_equal_questions_is_looked_for_once(spark, tmp_path):
    rng = random.Random(5)
    words = [a + b for a in ("ba", "be", "go") for b in "abcdefg"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)) + rng.choices(["x", "y", "z"], k=1))) for i in range(120)]
    path = f"file://{tmp_path}/i"
    P.built(spark.createDataFrame(rows, "id long, t string"), "id", {"t": X.tokens(F.col("t"))}, path)
    ix = P.Index(spark, path, "id")
    v = W.vocabulary(ix).where("length(word) = 3").withColumn("stem", F.left("word", F.lit(2)))
    q = v.select(F.col("word").alias("query"), "stem")
    o = q.where("query <> 'baa'").select("query", F.explode(F.when(F.col("query") > "bed", F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("z")))).alias("word"))
    assert W.companies(o, "query", "word").select("company").distinct().count() == 2
    pairs = v.join(q, "stem").where("word <> query").select("query", "word", "df")
    want = W.respelled_by_company(ix, pairs, o, "query", "word")
    got = W.respelled_alike(ix, v, q, o, "query", "word", "stem")
    cols = ["query", "word", "df", "together"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect())) and got.count() == len(words)
