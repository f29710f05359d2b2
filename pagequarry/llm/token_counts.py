"""Token counts of whole texts through a cache keyed by digests.

A text's count is stored under the SHA-256 of its normalised content and the digest of the tokenizer's version (its model
file, its library's version, the rule of normalisation). A run joins its texts' digests to the stored counts, encodes one text
of each digest that is missing, appends these counts to the cache, and joins them to the rows. The normalisation is the
tokenizer's own first step: null is an empty text, and a space is the mark that stands for it. A model that changes characters
otherwise is refused, as texts that it joins would be told apart without need.

The cache is a folder of Parquet files, a subfolder for each tokenizer version, and only ever grows by whole committed
writes; a run that dies adds nothing. Two runs at once may both add a digest, with the same count; lookups take each once.

Only digests are shuffled for the lookup. Texts are shuffled where they may be misses: if these are few they are sent to the
texts, else equal texts meet first within each partition, then by digest, so that a text that a third of the rows repeat
crosses once for each partition. When counts go back to the rows, digests with more than 1 / ``HEAVY`` of all rows, fewer than
``HEAVY`` of them, are broadcast, the others are joined by shuffle.

Cases: a null or empty text has 0 bytes and 0 tokens; very long texts are encoded whole; null ids, ties and repeated rows each
keep a row; an empty table gives an empty result and leaves the cache as it is; of the table only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, spread_join, written

#: Tokens over which a document is marked; missing digests (about 40 bytes each) up to which they are sent to the texts.
LIMIT, FEW = 4096, 100_000
#: The mark that the tokenizer puts for a space, and the name of the rule below.
SPACE, RULE = "▁", "null as empty, space as mark"
STORED = "digest binary, n_tokens long, tokenizer string"

#: The model that this worker process has loaded, by its digest.
LOADED: dict[bytes, object] = {}


def loaded(model: bytes) -> object:
    import sentencepiece

    key = hashlib.sha256(model).digest()
    if key not in LOADED:
        LOADED.clear()
        LOADED[key] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return LOADED[key]


def version_of(model: bytes) -> str:
    """The digest of a tokenizer's version; raises for a model whose normalisation does more than mark spaces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rules = sentencepiece_model_pb2.ModelProto.FromString(model).normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("the tokenizer's normalisation is another than this cache's")
    return hashlib.sha256(b"\0".join([hashlib.sha256(model).digest(), sentencepiece.__version__.encode(), RULE.encode()])).hexdigest()


def normalised(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(SPACE))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version, each digest once."""
    store = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not store.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(store):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema(STORED).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def texts_of(texts: DataFrame, misses: DataFrame, n: int) -> DataFrame:
    """(digest, text): one text for each of the ``n`` digests in ``misses``."""
    if n <= FEW:
        return texts.join(F.broadcast(misses), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    return texts.groupBy("digest").agg(F.first("text").alias("text")).join(misses, "digest", "left_semi")


def encoded(texts: DataFrame, model: bytes) -> DataFrame:
    """(digest, n_tokens) of (digest, text), as the tokenizer's library counts."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(shared.value)
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                counts = [len(ids) for ids in tokenizer.encode(part.column(1).to_pylist(), num_threads=1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(work, "digest binary, n_tokens long")


def count(docs: DataFrame, model_path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each document: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``, ``cached`` (whether the count was stored before this run), ``digest``.

    ``cache``: the folder of stored counts, made on the first write, in storage that all executors share.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = f.read()
    version = version_of(model)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(digest_of(text).alias("digest"), text.alias("text"))
    rows = written(docs.select(F.col(f"`{id_col}`").alias("id"), digest_of(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")))
    distinct = written(rows.groupBy("digest").agg(F.count("*").alias("copies")))
    known = distinct.join(stored(spark, cache, version), "digest", "left").select("digest", "copies", "n_tokens")
    known = written(known)
    misses = known.where("n_tokens is null").select("digest")
    n = misses.count()
    if n:
        new = encoded(texts_of(texts, misses, n), model).withColumn("tokenizer", F.lit(version))
        new.write.mode("append").option("compression", "zstd").partitionBy("tokenizer").parquet(cache)
    counts = known.withColumnRenamed("n_tokens", "before").join(stored(spark, cache, version), "digest").select("digest", "copies", "n_tokens", F.col("before").isNotNull().alias("cached"))
    out = spread_join(rows, written(counts), "digest", "copies")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached", "digest")
