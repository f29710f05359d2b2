import pytest

from pagequarry.plans import queries as engine

from .compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_rows_equal_those_of_sql(spark, name):
    assert not differences(spark, SF, engine.QUERIES[name], engine.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLE_SQL)))
def test_runs(spark, name):
    assert engine.QUERIES[name](spark, SF).count() > 0


def test_fuzzy_ratios_of_whole_texts(spark, tmp_path):
    from pagequarry.functions import fuzzy

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            before, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(before[j + 1] + 1, row[j] + 1, before[j] + (x != y)))
        return row[-1]

    item = "alpha beta gamma delta epsilon zeta eta theta iota"
    items = [(1, item), (2, "мама мыла раму и пела песню весь вечер"), (3, "two words"), (4, "天地玄黄宇宙洪荒"), (5, "alpHabet soup only for the fifth of the items")]
    opening = "z" * 130
    docs = [(1, opening + " " + item + " tail"), (2, item + " " + "y" * 200), (3, "Вчера " + items[1][1]), (4, opening + " two words"), (5, "千字文 天地玄黄宇宙"), (6, "soup only"), (7, None), (8, ""), (9, "nothing of it"), (1, opening + " " + item + " tail")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in engine.fuzzy_ratios(spark, str(tmp_path)).select("doc_id", "item_id", "indel", "token_set", "levenshtein").collect())
    pairs = [(0, 0), (9, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]  # texts that share no run of words, only their first letters, aren't compared
    want = []
    for d, b in pairs:
        p, q = docs[d][1], items[b][1]
        want.append((docs[d][0], items[b][0], round(fuzzy.indel(p, q), 4), round(fuzzy.token_set(p, q), 4), round(1 - distance(p, q) / max(len(p), len(q)), 6)))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    for g, w in zip(got, sorted(want), strict=True):
        assert g[2:] == pytest.approx(w[2:], abs=1e-4)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
