"""Packing into optimal length buckets.

The histogram of lengths over all documents goes to the driver; dynamic programming over it chooses the bucket
boundaries that minimise padding; a document is padded to its bucket's boundary, which is the bucket's longest member. The
histogram has a row for each distinct length, so it grows with the longest text and not with the documents, and the program
takes time in proportion to its rows. Within a bucket, documents in the
order of their ids form batches of at most ``budget`` padded tokens; a document longer than that is a batch alone.

Cases: a null length counts as 0; documents of length 0 go to the first bucket, which pads them like any other; ties in
id are ordered by length; repeated rows each keep a place; an empty table gives an empty result and no boundary.
Only the id and the length are read.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Buckets, and padded tokens in a batch.
BUCKETS, BUDGET = 8, 65_536


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Ascending upper boundaries, at most ``buckets``, that minimise the sum of (boundary - length).

    The last bucket of the lengths up to x from the i-th on costs what the lengths before i cost at best, plus x times the
    documents from i on, less their tokens: for each i a straight line over x, falling more steeply with i. So the best i only
    grows with x, and the lines that are best somewhere stand in a queue.
    """
    pairs = sorted(zip(lengths, counts, strict=True))
    xs = [x for x, _ in pairs]
    docs, tokens = list(accumulate([0] + [n for _, n in pairs])), list(accumulate([0] + [x * n for x, n in pairs]))
    best: list[int | None] = [0] + [None] * len(xs)
    came: list[list[int]] = []
    for _ in range(min(buckets, len(xs))):
        now, by, queue, front = [0] + [None] * len(xs), [0] * (len(xs) + 1), [], 0
        for j in range(1, len(xs) + 1):
            if best[j - 1] is not None:
                line = (-docs[j - 1], best[j - 1] + tokens[j - 1], j - 1)
                while len(queue) - front > 1 and useless(queue[-2], queue[-1], line):
                    queue.pop()
                queue.append(line)
            x = xs[j - 1]
            while len(queue) - front > 1 and queue[front + 1][0] * x + queue[front + 1][1] < queue[front][0] * x + queue[front][1]:
                front += 1
            slope, start, by[j] = queue[front]
            now[j] = slope * x + start + x * docs[j] - tokens[j]
        best = now
        came.append(by)
    out, j = [], len(xs)
    for by in reversed(came):
        if j == 0:
            break
        out.append(xs[j - 1])
        j = by[j]
    return out[::-1]


def useless(a: tuple[int, int, int], b: tuple[int, int, int], c: tuple[int, int, int]) -> bool:
    """Whether the line ``b`` is nowhere below both ``a`` and ``c``, of slopes that fall."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``id_col``, ``n_tokens``, ``bucket`` (from 0), ``padded_to``, ``batch`` (from 0 in each bucket), ``place`` in the batch.

    A bucket may hold a third of all documents: its rows are numbered in ranges of ids, each by one task, and the
    ranges' counts (one row for each bucket and range) give the offsets.
    """
    spark = docs.sparkSession
    rows = written(docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(length.cast("long"), F.lit(0).cast("long")).alias("n")))
    histogram = rows.groupBy("n").count().collect()  # a row for each distinct length
    ends = boundaries([r["n"] for r in histogram], [r["count"] for r in histogram], buckets)
    bucket, padded = F.lit(0), F.lit(0)
    for k, end in reversed(list(enumerate(ends))):
        bucket, padded = F.when(F.col("n") <= end, F.lit(k)).otherwise(bucket), F.when(F.col("n") <= end, F.lit(end)).otherwise(padded)
    ranged = rows.select("id", "n", bucket.alias("bucket"), padded.cast("long").alias("padded_to"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = written(ranged.repartitionByRange(parts, "bucket", "id", "n").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("bucket", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = counts.select("bucket", "part", F.coalesce("before", F.lit(0)).alias("before"))
    numbered = ranged.withColumn("own", F.row_number().over(Window.partitionBy("bucket", "part").orderBy("id", "n")) - 1)
    at = F.col("before") + F.col("own")
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest("padded_to", F.lit(1))).cast("long"))
    return numbered.join(F.broadcast(offsets), ["bucket", "part"]).select(
        F.col("id").alias(id_col), F.col("n").alias("n_tokens"), "bucket", "padded_to", F.floor(at / fit).cast("long").alias("batch"), (at % fit).cast("long").alias("place")
    )


def n_words(text: Column) -> Column:
    """Words between white space, a length that needs no tokenizer."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
