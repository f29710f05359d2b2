"""Coverage by reason, repeated patterns and heads of logs on small tables with nulls, ties and repeats."""

from pyspark.sql import functions as F

from pagequarry.operators import reports


def test_coverage(spark):
    df = spark.createDataFrame([("a", None), ("a", "bot"), ("a", "bot"), (None, "tiny"), ("b", None)], "p string, why string")
    got = {(r["level"], r["p"]): tuple(r)[2:] for r in reports.coverage(df, "p", "why").collect()}
    assert got == {("group", "a"): (3, 1, 2, "bot=2"), ("group", None): (1, 0, 1, "tiny=1"), ("group", "b"): (1, 1, 0, ""), ("all", None): (5, 2, 3, "bot=2;tiny=1")}
    assert reports.coverage(df.limit(0), "p", "why").count() == 0


def test_repeated_patterns(spark):
    rows = [("a", None, i) for i in (5, 1, 1, None)] + [("b", "x", 1), ("b", "x", 2)] + [(None, "y", i) for i in range(20)]
    df = spark.createDataFrame(rows, "p string, m string, doc int")
    got = {(r["p"], r["m"]): (r["n"], r["examples"]) for r in reports.repeated_patterns(df, ["p", "m"], "doc").collect()}
    assert got == {("a", None): (4, [1, 1, 5, None]), (None, "y"): (20, [0, 1, 2, 3, 4])}
    assert {r["p"] for r in reports.repeated_patterns(df, ["p"], "doc", 2, 1).collect()} == {"a", "b", None}


def test_rank_limit_stands_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), "id")
    plan = reports.repeated_patterns(df, ["k"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan[plan.index("WindowGroupLimit") :]


def test_console(spark):
    df = spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("y", 2, 3), (None, 3, 4)], "role string, t int, id int")
    got = [tuple(r) for r in reports.console(df, ["y", "z", "x"], "role", ["t", "id"], ["id"], 2).orderBy("part", "at").collect()]
    assert got == [("latest", 0, "y", 3), ("latest", 1, "z", None), ("latest", 2, "x", 2), ("recent", 0, None, 4), ("recent", 1, "y", 3)]
    assert [tuple(r) for r in reports.console(df.limit(0), ["y"], "role", ["t", "id"], ["id"]).collect()] == [("latest", 0, "y", None)]
