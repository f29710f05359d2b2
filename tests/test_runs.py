"""Keys of runs of words, held against the runs themselves; the plan has no pass word by word."""

import random

import pyarrow as pa

from pagequarry.plans import queries
from tests.compare import differences


def runs_in_words(words, n, short):
    words = words or []
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] or ([tuple(words)] if short and words else [])


def test_keys_are_equal_where_runs_are():
    r = random.Random(3)
    rows = [None if r.random() < 0.1 else [r.choice("abc") for _ in range(r.choice([0, 1, 2, 3, 4, 9]))] for _ in range(300)]
    for short in (False, True):
        row, g1, g2 = queries.runs_of_words(pa.array(rows, pa.list_(pa.string())).slice(7), 3, short)
        wanted = [(i, run) for i, ws in enumerate(rows[7:]) for run in runs_in_words(ws, 3, short)]
        assert row.tolist() == [i for i, _ in wanted]
        keys = list(zip(g1.tolist(), g2.tolist(), strict=True))
        assert len(set(keys)) == len({run for _, run in wanted}) == len(set(zip(keys, (run for _, run in wanted), strict=True)))


def test_rows_in_parts(spark):
    df = spark.createDataFrame([(i, f"a{i} b, c_{i}\tÉ d " * (i % 5)) for i in range(40)] + [(99, None)], "id int, text string").coalesce(1)
    few = queries.with_runs(df, "id", queries.folded("text"), 3, False, most=7)
    assert few.count() == sum(max(5 * (i % 5) - 2, 0) for i in range(40))
    assert sorted(few.collect()) == sorted(queries.with_runs(df, "id", queries.folded("text"), 3, False).collect())


def test_ngram_grounding_goes_by_batches(spark):
    sf = "/root/testdata/sf0.001"
    df = queries.ngram_grounding(spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "slice(" not in plan  # each run was a slice of an array, hashed twice
    for name in ("ngram_grounding", "near_dup_ratio"):
        assert not differences(spark, sf, queries.QUERIES[name], queries.ORACLE_SQL[name])
