"""Document fingerprints from closed syncmers, compared by position.

A k-mer of characters is a closed syncmer if its smallest s-mer (by hash) is its first or its last one. Whether a k-mer
is chosen depends on its own characters alone, so equal passages give equal anchors wherever they stand. A
fingerprint holds all anchors (about one for each 8.5 characters) with their positions; none is left out for the sake of
others. Anchors count as shared as far as they come in the same order in both texts (the longest common run of places, gaps allowed),
so an insertion moves what follows it without harm. An anchor that occurs repeatedly keeps its first position.

Cases: null is an empty text; a text without anchors, as all that are shorter than ``K`` characters and some of up to two or three
times that, has one in their place, the hash of the whole text, so that it is like equal texts only; two empty texts have
likeness 1, an empty and another one 0; equal texts have
equal fingerprints. Very long texts are read whole. Ids are integers (others raise a TypeError). Documents of one id are
ordered by the hash of their text, null ids come first; repeated rows each keep a row, and all rows of one id are in one
task, row by row; the only document is its own next; an empty table gives an empty result. Only the id and the text are
read.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of an anchor and of its inner substrings.
K, S = 24, 8
#: Fixed odd multipliers of the rolling hash and of its finish.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def window_hash(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` characters."""
    out = codes[: len(codes) - width + 1].copy()
    for i in range(1, width):
        out *= BASE
        out += codes[i : len(codes) - width + 1 + i]
    return scrambled(out)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions of the text's closed syncmers, in order; of a text without any, its own hash."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes += np.uint64(1)
    at = closed(codes) if len(codes) >= K else np.zeros(0, np.int64)
    if not len(at):
        whole = window_hash(codes, len(codes)) if len(codes) else codes
        return (whole >> np.uint64(32)).astype(np.uint32), np.zeros(len(whole), np.uint32)
    h = codes[at].copy()
    for i in range(1, K):
        h *= BASE
        h += codes[at + i]
    return (scrambled(h) >> np.uint64(32)).astype(np.uint32), at.astype(np.uint32)


def closed(codes: np.ndarray) -> np.ndarray:
    """Where the windows of ``K`` characters start whose least inner hash is the first or the last."""
    inner = window_hash(codes, S)
    n, width = len(codes) - K + 1, K - S + 1
    low = inner[1 : n + 1].copy()  # the smallest of those between the first and the last
    for i in range(2, width - 1):
        np.minimum(low, inner[i : i + n], out=low)
    first, last = inner[:n], inner[width - 1 : width - 1 + n]
    return np.flatnonzero((first <= np.minimum(low, last)) | (last <= np.minimum(low, first)))


class Sketch:
    """A text's anchors: different hashes, ascending, and the position of each."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray):
        self.hashes, self.places = hashes, places


def sketch(text: str) -> Sketch:
    """The text's fingerprint."""
    h, at = anchors(text)
    h, first = np.unique(h, return_index=True)
    return Sketch(h, at[first])


def printed(f: Sketch) -> str:
    """Base64 of the number of anchors and, in the order of their positions, their hashes, the steps between positions in a byte each (255 for more), and the longer steps."""
    order = np.argsort(f.places, kind="stable")
    steps = np.diff(f.places[order].astype(np.int64), prepend=0)
    raw = [np.uint32(len(order)).astype("<u4").tobytes(), f.hashes[order].astype("<u4").tobytes(), np.minimum(steps, 255).astype(np.uint8).tobytes(), steps[steps >= 255].astype("<u4").tobytes()]
    return base64.b64encode(b"".join(raw)).decode()


def parsed(text: str) -> Sketch:
    raw = base64.b64decode(text)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    hashes, steps = np.frombuffer(raw, "<u4", n, 4).astype(np.uint32), np.frombuffer(raw, np.uint8, n, 4 + 4 * n).astype(np.int64)
    steps[steps == 255] = np.frombuffer(raw, "<u4", -1, 4 + 5 * n)
    order = np.argsort(hashes)
    return Sketch(hashes[order], np.cumsum(steps).astype(np.uint32)[order])


def in_order(places: list[int]) -> int:
    """The length of the longest ascending choice of ``places``."""
    ends: list[int] = []
    for x in places:
        i = bisect_left(ends, x)
        ends[i : i + 1] = [x]
    return len(ends)


def likeness(a: Sketch, b: Sketch) -> float:
    """Twice the anchors that both have in the same order, over the sum of both's anchors."""
    total = len(a.hashes) + len(b.hashes)
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a.hashes, b.hashes, assume_unique=True, return_indices=True)
    return 2 * in_order(b.places[j[np.argsort(a.places[i], kind="stable")]].tolist()) / total


def with_next(docs: DataFrame, id_col: str, text_col: str, pieces: int) -> DataFrame:
    """Rows (part, ghost, id, text) such that in each part, by id and text, a row's successor is its next document.

    Parts are ranges of ids, cut at approximate quantiles. The documents with the first id of a part are also laid, as
    ghosts, into the part before it (those of the first part into the last), so that no part needs another one and no
    text travels more than twice. ``pieces`` first ids are broadcast.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError("the id must be an integer")
    order = F.col("id").cast("double")
    bounds = sorted(set(rows.agg(F.percentile_approx(order, [i / pieces for i in range(1, pieces)], 20_000)).first()[0] or [])) if pieces > 1 else []
    dealt = rows.withColumn("at", F.coalesce(order, F.lit(-math.inf)))
    if bounds:
        dealt = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="at", outputCol="bucket").transform(dealt).withColumn("part", F.col("bucket").cast("int"))
    else:
        dealt = dealt.withColumn("part", F.lit(0))
    least = {r["part"]: r["low"]["id"] for r in dealt.groupBy("part").agg(F.min(F.struct("id")).alias("low")).collect()}
    have = sorted(least)
    if not have:
        return dealt.select("part", F.lit(False).alias("ghost"), "id", "text")
    firsts = docs.sparkSession.createDataFrame([(least[p], have[i - 1]) for i, p in enumerate(have)], f"fid {kind.simpleString()}, into int")
    ghosts = dealt.join(F.broadcast(firsts), F.col("id").eqNullSafe(F.col("fid"))).select(F.col("into").alias("part"), F.lit(True).alias("ghost"), "id", "text")
    return dealt.select("part", F.lit(False).alias("ghost"), "id", "text").unionAll(ghosts)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next document's.

    The edited text is the text whose last quarter of characters (rounded down) gave way to as many from the start of
    the next document (or all it has). Texts are shuffled once, by ranges of ids; a task goes through its sorted rows
    and holds two at a time.
    """
    spark = docs.sparkSession
    pieces = pieces or 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    kind = docs.schema[id_col].dataType.simpleString()
    laid = with_next(docs, id_col, text_col, pieces)
    laid = laid.repartition("part").sortWithinPartitions("part", "ghost", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    kinds = [to_arrow_type(docs.schema[id_col].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        part, ghost, ids = (batch.column(i).to_pylist() for i in range(3))
        for i in range(batch.num_rows):
            yield part[i], ghost[i], ids[i], batch.column(3)[i].as_py()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for part, ghost, key, text in (row for batch in batches for row in rows_of(batch)):
            own = sketch(text)
            if held is not None and held[0] == part:
                _, before, old, f = held
                cut = len(old) // 4
                edited = old[: len(old) - cut] + text[:cut]
                g = sketch(edited)
                out.append((before, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), printed(f), printed(g), likeness(f, g), likeness(f, own)))
                if len(out) >= 500:
                    yield made()
                    out = []
            held = None if ghost else (part, key, text, own)
        if out:
            yield made()

    return laid.mapInArrow(work, schema)
