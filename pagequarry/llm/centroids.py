"""Lloyd's clustering over distinct quantised vectors with multiplicities.

Components are quantised to integers, rows with the same integers are grouped, and each round assigns the distinct
vectors to the nearest centroid and sums them, times their multiplicity, in exact integers; a centroid moves to the floor of
its mean. In the end the distinct vectors' clusters are joined back to the rows. A round is one pass over a written table, whose
tasks return a partial sum for each cluster; the driver holds the centroids alone. Equal vectors meet as partial counts; on
the way back, vectors with more than 1 / ``HEAVY`` of all rows are joined by a broadcast.

Cases: vectors of another width, null ones, and those with a null or non-finite component are left out; the first centroids
are those vectors with the least hash of their id (null ids last, equal ids by their components; repeated rows may give
equal centroids, of which the smaller number takes all); fewer vectors than clusters give as many centroids as vectors; ties go to the smaller
number; a cluster without vectors stays where it is; an empty table gives an empty result; other columns are not read.
Integers beyond 64 bits count as the nearest that fits; distances and sums are exact at any size, and null where they don't
fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

#: Components, clusters, rounds; quantising scale; what the ids are hashed behind.
WIDTH, CLUSTERS, ROUNDS, SCALE, SALT = 64, 8, 10, 1024, "3:"
#: Components under this are worked on in doubles, whose sums of products are exact integers then; larger ones in Python's integers.
PLAIN = 1 << 20


def quantised(vector: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """floor(``scale`` * x) of each component; null for a vector that is left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when((F.size(vector) == width) & F.forall(vector, finite), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def nearest(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """The number of the nearest centroid of each vector, and the squared distances to it."""
    middle = np.array(centroids, dtype=object)
    if len(vectors) and max(int(vectors.max()), -int(vectors.min()), int(abs(middle).max())) < PLAIN:
        x, c = vectors.astype(np.float64), middle.astype(np.float64)
        apart = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        own = apart.argmin(1)
        return own, apart[np.arange(len(x)), own].astype(np.int64).tolist()
    apart = [[int(((row - c) ** 2).sum()) for c in middle] for row in vectors.astype(object)]
    own = [min(range(len(centroids)), key=row.__getitem__) for row in apart]
    return np.array(own, int), [row[k] for row, k in zip(apart, own, strict=True)]


def matrix(batch: pa.RecordBatch, at: int, width: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sums(points: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """(weight, componentwise sum) of each cluster that has vectors."""
    width = len(centroids[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, weight = matrix(batch, 1, width), batch.column(2).to_numpy()
            own, _ = nearest(x, centroids)
            most = max(int(x.max()), -int(x.min())) * int(weight.astype(object).sum())
            x, weight = (x, weight) if most < 1 << 62 else (x.astype(object), weight.astype(object))
            for k in np.unique(own).tolist():
                n, s = total.get(k, (0, 0))
                total[k] = n + int(weight[own == k].sum()), s + (x[own == k] * weight[own == k, None]).sum(0).astype(object)
        keys = sorted(total)
        columns = [pa.array(keys, pa.int32()), pa.array([str(total[k][0]) for k in keys], pa.string()), pa.array([[str(v) for v in total[k][1]] for k in keys], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "s"])

    parts = points.mapInArrow(work, "cluster int, n string, s array<string>")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    found = parts.groupBy("cluster").agg(exact(F.col("n")).alias("n"), F.array(*[exact(F.col("s")[i]) for i in range(width)]).alias("s")).collect()  # a row for each cluster
    return {r["cluster"]: (int(r["n"]), [int(v) for v in r["s"]]) for r in found}


def assigned(points: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(key, weight, cluster, distance as a decimal)."""
    width = len(centroids[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, apart = nearest(matrix(batch, 1, width), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.int32()), pa.array([str(d) for d in apart], pa.string())], names=["key", "weight", "cluster", "distance"])

    return points.mapInArrow(work, "key binary, weight long, cluster int, distance string").withColumn("distance", F.col("distance").cast("decimal(38,0)"))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, list[list[int]]]:
    """(rows, centroids): for each kept vector ``id_col``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``; and the centroids, by number."""
    whole = vectors.select(F.col(f"`{id_col}`").alias("id"), quantised(F.col(f"`{vector_col}`"), width, scale).alias("q")).where("q is not null")
    keyed = whole.withColumn("key", F.unhex(F.sha2(F.array_join("q", ","), 256)))
    points = written(keyed.groupBy("key", "q").agg(F.count("*").alias("weight")).select("key", "q", "weight"))
    rows = written(keyed.select("id", "key"))
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = keyed.select(order.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(clusters).collect()
    centroids = [list(r["q"]) for r in first]
    for _ in range(rounds if centroids else 0):
        for k, (n, total) in sums(points, centroids).items():
            centroids[k] = [v // n for v in total]
    if not centroids:
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")]), []
    done = written(assigned(points, centroids))
    spread = done.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("weight").cast("decimal(20,0)")).cast("decimal(38,0)").alias("cluster_inertia"))
    spread = {r["cluster"]: int(r["cluster_inertia"]) for r in spread.collect()}  # a row for each cluster
    long = lambda v: F.lit(v if v < 1 << 63 else None).cast("long")
    of_cluster = F.lit(None).cast("long")
    for k, v in spread.items():
        of_cluster = F.when(F.col("cluster") == k, long(v)).otherwise(of_cluster)
    back = spread_join(rows, done.select("key", "weight", "cluster", F.expr("try_cast(distance as bigint)").alias("distance")), "key", "weight")
    return back.select(F.col("id").alias(id_col), "cluster", "distance", of_cluster.alias("cluster_inertia"), long(sum(spread.values())).alias("inertia")), centroids


def digest_of(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
