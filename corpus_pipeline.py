"""A corpus pipeline of five stages, each over all that the stage before it kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.

Cases: null texts have no language and go at the first stage; an empty table passes through all stages; other columns
of ``documents`` are carried along whatever their names; repeated rows stay until near duplicates are joined, which keeps
one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import language_id, line_dedup, near_duplicates, packing, toxicity
from pagequarry.llm.common import written


def stayed(docs: DataFrame, judged: Callable[[DataFrame, str, str], DataFrame], where: str) -> DataFrame:
    """The rows of ``docs`` that ``where`` holds for, by the result columns of ``judged``; the columns of ``docs`` go by numbers meanwhile, so that no name clashes."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return judged(plain, f"c{names.index('doc_id')}", f"c{names.index('text')}").where(where).select(*plain.columns).toDF(*names)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: documents without a letter, and those whose codeword is ambiguous. The classifiers learn from the labelled languages of ``docs``."""
    model = language_id.train(docs)
    return stayed(docs, lambda plain, key, text: language_id.identify(plain, model, key, text, keep=plain.columns), "not ambiguous and lang_pred <> 'und'")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: documents with a toxicity of 0.5 or more. The weights learn from ``labels``."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return stayed(docs, lambda plain, key, text: toxicity.score(plain, model, key, text, keep=plain.columns), "predicted = 0")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay only where they come first; ``n_chars`` follows the text. A text that would be left with no line of its own stays as it was: the stage cuts lines and rejects no document (a copy is found by the next stage)."""
    names = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(names)}
    plain = docs.toDF(*at.values()).withColumn("whole", F.col(at["text"]))
    text, whole = F.col(at["text"]), F.col("whole")
    cleaned = line_dedup.remove(plain, at["doc_id"], at["text"], at["source"])
    cleaned = cleaned.withColumn(at["text"], F.when((F.col("n_removed") > 0) & (F.trim(text) == ""), whole).otherwise(text))
    return cleaned.select(*[F.coalesce(F.length(text), F.lit(0)).cast("long").alias(c) if c == "n_chars" else F.col(at[c]).alias(c) for c in names])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class at a similarity of 0.8 stays, that of least id."""
    return near_duplicates.keep_one(docs)


def pack_by_length(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and place in it."""
    return packing.pack(docs, packing.n_words(F.col("text")))


STAGES = [
    ("language_id", keep_known_language),
    ("toxicity", keep_civil),
    ("line_dedup", drop_boilerplate_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("packing", pack_by_length),
]

#: The stages fit models, which SQL can't; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
