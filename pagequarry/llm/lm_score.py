"""Language-model scores by stupid backoff, computed relationally.

Documents are laid into chunks of some megabytes. Each chunk is exploded into its distinct n-grams of all orders with
their counts in it; these rows are partitioned by n-gram hash, where the count tables over the whole corpus form as
sums; the totals are joined back to the chunks that asked for them, and each document's scores are summed there. An
n-gram is sent at most once for each chunk, however frequent it is.

The score of a word after its context is c(context word) / c(context) for the longest n-gram that other documents have,
times ``ALPHA`` for each order given up; the unigram score is c(word) / N, and a word that no other document has gets
``ALPHA`` / N. Counts and N leave the scored document's own words out, as every n-gram would be known otherwise.

Cases: null or empty text has no words, a score of 0 and a null mean; the first words of a text have shorter contexts; N
counts as 1 at least; repeated rows are documents each (a copy knows the other's n-grams); very long texts make a chunk
of their own; an empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import split_words, written_by

#: Longest n-gram, factor of a step back.
ORDER, ALPHA = 3, 0.4
#: Bytes of text in a chunk, and n-grams that one partition of the count tables gathers, about.
CHUNK_BYTES, BUCKET_GRAMS = 10 << 20, 2_000_000
M64, G64 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M64
    x = (x ^ (x >> np.uint64(29))) * G64
    return x ^ (x >> np.uint64(32))


def grams(texts: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order k the hashes of the k words from each place on (0 where they'd leave the text), and where texts begin."""
    import xxhash

    codes, words, at = split_words(pa.array(texts, pa.string()))
    own = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words.to_pylist()], np.uint64)
    h = own[codes.to_numpy()] if len(own) else own
    ends = np.repeat(at[1:], np.diff(at))
    out = [mixed(h + np.uint64(1))]
    for k in range(2, order + 1):
        longer = np.zeros(len(h), np.uint64)
        n = max(0, len(h) - k + 1)
        longer[:n] = mixed(out[-1][:n] * G64 + h[k - 1 :] + np.uint64(k))
        longer[np.arange(len(h)) + k > ends] = 0
        out.append(longer)
    return out, at


def squeezed(x: np.ndarray) -> bytes:
    """Small integers, most of them equal, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x, np.int64).tobytes())


def loose(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)


def squeezed_hashes(x: np.ndarray) -> bytes:
    """Ascending hashes as their steps, byte by byte of equal weight: the upper bytes are mostly 0. Nothing is lost."""
    import zstandard

    steps = np.diff(x, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def loose_hashes(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def distinct(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams, ascending, and how often each is there; sorted in place, as a chunk has millions."""
    all_of = np.concatenate(found)
    all_of.sort()
    all_of = all_of[np.searchsorted(all_of, 1) :]  # 0 stands for none
    first = np.flatnonzero(np.concatenate([all_of[:1] == all_of[:1], all_of[1:] != all_of[:-1]]))
    return all_of[first], np.diff(first, append=len(all_of))


def chunked(docs: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """One row for each chunk: (chunk, ids, texts, n), the texts compressed, n their number of words. Written once, so that names stay."""
    import zstandard

    kind = docs.schema[id_col].dataType
    schema = f"chunk string, ids array<{kind.simpleString()}>, texts binary, n long"

    def row(ids: list, texts: list[str]) -> pa.RecordBatch:
        raw = pa.array(texts, pa.string())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("t", pa.string())])) as out:
            out.write_batch(pa.RecordBatch.from_arrays([raw], names=["t"]))
        words = len(split_words(raw)[0])
        packed = zstandard.ZstdCompressor(3).compress(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(to_arrow_type(kind))), pa.array([packed], pa.binary()), pa.array([words], pa.int64())], names=["chunk", "ids", "texts", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = text.as_py() or ""
                ids.append(key)
                texts.append(value)
                size += len(value)
                if size >= most:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield row(ids, texts)

    return written_by(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(work, schema), "chunk")


def unpacked(blob: bytes) -> list[str]:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().column(0).to_pylist()


def asked(chunks: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, chunk, hashes, counts): each chunk's distinct n-grams, by ranges of the hash."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, n = distinct(grams(unpacked(blob.as_py()), order)[0])
                cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
                full = [i for i in range(buckets) if cuts[i + 1] > cuts[i]]
                part = lambda x, form: pa.array([form(x[cuts[i] : cuts[i + 1]]) for i in full], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.string()), part(h, squeezed_hashes), part(n, squeezed)], names=["bucket", "chunk", "hashes", "counts"])

    return chunks.select("chunk", "texts").mapInArrow(work, "bucket int, chunk string, hashes binary, counts binary")


def counted(requests: DataFrame) -> DataFrame:
    """(bucket, chunk, others): how often the n-grams that each request lists occur outside its chunk, in its order; mostly 0, which takes no room."""

    def totals(rows: list[tuple]) -> pa.RecordBatch:
        hashes = [loose_hashes(r[2]) for r in rows]
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.concatenate([loose(r[3]) for r in rows])
        total = np.zeros(int(at.max()) + 1, np.int64)
        np.add.at(total, at, counts)
        ends = np.cumsum([len(x) for x in hashes])
        parts = [squeezed(x) for x in np.split(total[at] - counts, ends[:-1])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array(parts, pa.binary())], names=["bucket", "chunk", "others"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if held and held[0][0] != r[0]:
                    yield totals(held)
                    held = []
                held.append(r)
        if held:
            yield totals(held)

    return requests.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(work, "bucket int, chunk string, others binary")


def places(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Where each of ``g`` stands in the ascending ``h``; looked up in ascending order, which memory likes better."""
    order = np.argsort(g)
    out = np.empty(len(g), np.int64)
    out[order] = np.searchsorted(h, g[order])
    return out


def text_scores(found: list[np.ndarray], at: np.ndarray, h: np.ndarray, totals: np.ndarray, n_all: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Number of words, and sum of log10 scores, of each text, from the chunk's n-grams and their totals."""
    place = [places(h, g) for g in found]
    n_words, sums = np.diff(at), np.zeros(len(at) - 1)
    for d in range(len(n_words)):
        lo, hi = at[d], at[d + 1]
        if lo == hi:
            continue
        others = []  # counts in other documents of the n-grams that begin at each place
        for k, g in enumerate(found):
            whole = g[lo:hi] != 0
            own = np.zeros(hi - lo, np.int64)
            _, back, n = np.unique(place[k][lo:hi][whole], return_inverse=True, return_counts=True)
            own[whole] = totals[place[k][lo:hi][whole]] - n[back]
            others.append(own)
        size, rest = hi - lo, max(1, n_all - (hi - lo))
        value = np.where(others[0] > 0, others[0] / rest, alpha / rest)
        for k in range(1, len(found)):
            if size > k:
                seen, context = others[k][: size - k], others[k - 1][: size - k]
                value[k:] = np.where(seen > 0, seen / np.maximum(context, 1), alpha * value[k:])
        sums[d] = np.log10(value).sum()
    return n_words, sums


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """``id_col``, ``n_words``, ``log10_score`` (sum over the words), ``mean_log10``; one row for each document."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    chunks = chunked(docs, id_col, text_col, CHUNK_BYTES)
    n_all = chunks.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-n_all * order // BUCKET_GRAMS), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    answers = counted(asked(chunks, order, buckets)).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "others")).alias("answers"))
    met = chunks.hint("merge").join(answers, "chunk", "left").select("ids", "texts", "answers")
    names = [id_col, "n_words", "log10_score", "mean_log10"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found, at = grams(unpacked(batch.column(1)[i].as_py()), order)
                h, n_own = distinct(found)
                parts = sorted((x["bucket"], x["others"]) for x in batch.column(2)[i].as_py() or [])
                totals = n_own + np.concatenate([np.zeros(0, np.int64), *(loose(t) for _, t in parts)])
                n, total = text_scores(found, at, h, totals, n_all, alpha)
                mean = [t / k if k else None for t, k in zip(total.tolist(), n.tolist(), strict=True)]
                del found, h, n_own, parts, totals
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0)[i].as_py(), to_arrow_type(kind)), pa.array(n.astype(np.int64)), pa.array(total), pa.array(mean, pa.float64())], names=names)

    return met.mapInArrow(work, f"`{id_col}` {kind.simpleString()}, n_words long, log10_score double, mean_log10 double")
