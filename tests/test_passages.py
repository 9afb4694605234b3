"""What best passages read."""

from threadlake.operators import passages as G


def test_only_found_texts_go_to_python(spark):
    df = spark.createDataFrame([(i, "needle") for i in range(5)], "id long, text string")
    plan = G.best_passages(df.where("id < 2").select("id"), df, "id", "text", {"needle": 1.0})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Join")
