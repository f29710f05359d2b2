"""Small helpers that several operators share."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a worker handles at once.
SLICE_BYTES = 4 << 20
#: A key with more than one row in so many is joined by a broadcast; there are fewer such keys.
HEAVY = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset a local session, as in tests, takes a temporary one; a cluster raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, files: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once.

    ``files``: at most so many, for small tables, whose size the planner would else overrate by their files' heads and feet.
    """
    spark = df.sparkSession
    df = df.coalesce(files) if files else df
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, key: str) -> DataFrame:
    """As ``written``, in as many buckets by ``key`` as a shuffle has partitions, so that a join on it need not move these rows again. The catalog knows the table only until it has been resolved here; its files stay."""
    spark, name = df.sparkSession, f"by_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, key).saveAsTable(name)
    made = spark.table(name)
    made.schema  # resolved now
    spark.sql(f"drop table {name}")
    return made


def spread_join(rows: DataFrame, facts: DataFrame, key: str, copies: str) -> DataFrame:
    """``rows`` with what ``facts``, written and with one row for each ``key``, says of their key; ``copies`` there is how many rows have it.

    Keys with more than 1 / ``HEAVY`` of all rows, fewer than ``HEAVY``, are broadcast, so that none gathers in one task; the
    other rows meet theirs by shuffle.
    """
    total = facts.agg(F.sum(copies)).first()[0] or 0
    heavy = (F.col(copies) * HEAVY > total) & (F.col(copies) > 1)
    names = [c for c in facts.columns if c not in (key, copies)]
    if not facts.where(heavy).limit(1).count():
        return rows.join(facts.drop(copies), key)
    at = F.struct(*names).alias("heavy_fact")
    met = rows.join(F.broadcast(facts.where(heavy).select(key, at)), key, "left")
    hot = met.where("heavy_fact is not null").select(*rows.columns, "heavy_fact.*")
    rest = met.where("heavy_fact is null").select(*rows.columns).join(facts.where(~heavy).drop(copies), key)
    return hot.select(*rows.columns, *names).unionAll(rest.select(*rows.columns, *names))


def id_remainder(doc_id: Column | str, divisor: int) -> Column:
    """crc32 of the id's decimal text modulo ``divisor``; null for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def bounded_sample(rows: DataFrame, key: str, label: str, most: int, in_all: int = 20_000) -> DataFrame:
    """About ``most`` rows of each label at most, and ``in_all`` altogether, those with the smallest hash of ``key``, in one partition.

    The cut-offs follow from the counts of the labels, so that no sort of all rows is needed, and the same rows come
    out on any partitioning; a final limit keeps the total even if one key has very many rows. The labels are a
    handful of classes.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    most = min(most, max(1, in_all // max(1, len(counts))))
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20))
    cut = F.lit(0)
    for value, n in counts.items():
        share = 1.0 if n <= most else min(1.0, most / n)
        cut = F.when(F.col(label) == F.lit(value), F.lit(int((1 << 20) * share) + 1)).otherwise(cut)
    return rows.where(h < cut).orderBy(F.xxhash64(F.col(key)), key).limit(most * max(1, len(counts)))


def fitted(sample: DataFrame, fit: Callable[[Iterator[pa.RecordBatch]], object]) -> object:
    """What ``fit`` makes of a bounded sample, in one executor task; the driver gets the finished model, not the rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(batches))], pa.binary())], names=["model"])

    made = sample.coalesce(1).mapInArrow(work, "model binary").first()  # none where the sample has not even an empty partition
    return pickle.loads(made["model"]) if made else fit(iter(()))


def carried(docs: DataFrame, id_col: str, text_col: str, keep: list[str] | None, results: list[str]) -> tuple[DataFrame, list[int], list[str]]:
    """(rows, positions, names): ``id_col`` and ``text_col`` in front of the columns in ``keep``, and which of them a result carries along. A result's own columns win over kept ones of their names."""
    taken = {c.lower() for c in results}
    names = [id_col, text_col, *(c for c in keep or [] if c not in (id_col, text_col))]
    at = [i for i, c in enumerate(names) if c == id_col or c in (keep or []) and c.lower() not in taken]
    return docs.select(*[F.col(f"`{c}`") for c in names]), at, [names[i] for i in at]


def slices(batch: pa.RecordBatch, text_at: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive pieces of about ``most`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def split_words(texts: pa.Array) -> tuple[pa.Array, pa.Array, "object"]:
    """Lower-cased words of each text, split at white space: (codes, distinct words, offsets of each text's words)."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists.offsets) else 0)
    keep = pc.not_equal(flat, "")
    if not pc.all(keep).as_py():
        import numpy as np

        kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
        offsets, flat = kept[offsets], flat.filter(keep)
    coded = flat.dictionary_encode()
    return coded.indices, coded.dictionary, offsets
