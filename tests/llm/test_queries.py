import pytest
from pyspark.sql import functions as F

from pagequarry.llm import queries

from ..compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_those_of_sql(spark, name):
    assert not differences(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"op10_language_id"}))
def test_runs_over_the_whole_table(spark, name):
    table = "pages" if name.startswith("op1_") else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert after.count() <= kept.count()
        kept = after
    packed = pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.count() == kept.count() == pipeline.run(spark, SF).count()
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_on_odd_documents(spark, tmp_path):
    """Nulls in each column, repeated rows, and columns named like the operators' results."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (900001, None, "en", None, 0), (900002, "", None, "s", 0), (900003, "!!!", "en", "s", 3), (None, "a document that has no id at all but words", None, None, None)], docs.schema)
    odd = docs.unionByName(docs.limit(5)).unionByName(extra)
    clash = ["score", "ambiguous", "lang_pred", "predicted", "offending", "n_lines", "n_removed", "id", "h", "key", "own_h", "whole", "n_tokens", "bucket", "class_id", "__id", "__h", "c0", "c1"]
    odd = odd.select(*[F.lit(f"own {c}").alias(c) for c in clash], *odd.columns)
    kept = spark.createDataFrame(odd.collect(), odd.schema)
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == kept.columns, name
        kept = spark.createDataFrame(after.collect(), kept.schema)
        assert all(r[c] == f"own {c}" for r in kept.collect() for c in clash)
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and not {900001, 900002, 900003} & set(ids)
    assert pipeline.STAGES[-1][1](spark, kept, SF).count() == len(ids)


def test_line_stage_rejects_no_document(spark):
    import corpus_pipeline as pipeline

    rows = [(i, "All rights reserved.\nCookies", "en", f"site{i}", 28) for i in range(12)] + [(12, "Cookies\nown words", "en", "site0", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.drop_boilerplate_lines(spark, docs, SF).collect()}
    assert len(got) == 13 and got[12] == ("own words", 9) and got[0] == got[5] == ("All rights reserved.\nCookies", 28)
