"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Documents with the same set of word shingles fall into one class representative first. Each representative has a
MinHash signature of ``TREES`` labels of ``DEPTH`` values, one label for each tree. A tree is the prefix trie of its
labels, kept as rows sorted by label: the longest prefix that two labels share follows from their neighbours' in that
order, and a shorter prefix is a longer stretch of rows.

Each document starts from whole labels and shortens its prefix value by value until its recall is on target. After a
depth d the links found by then, each weighed by the inverse of the chance that its pair meets in some tree at d
values or more (1 - (1 - s^d)^trees for an agreement s of the signatures), estimate how many there are; one more link at
exactly the threshold is assumed to be still unseen. A document stops at the first depth where found over estimated
reaches ``RECALL``: one with many links stops at long prefixes, one without any goes on to ``shortest``, the depth where a
pair at the threshold meets with that probability by itself. A pair is followed at the depth of its longest common
prefix if either document is still open there, and it belongs to one tree only, the first with that prefix. So of pairs at
the threshold a share of 1 - ``RECALL`` at most is expected to be missed (less above it).

What is followed is verified exactly, by shared shingles, in the same trie node, for those documents alone that have
something to verify there; large nodes are dealt out block by block to different tasks. What leaves a task is a link
count for each document and a spanning forest of the links, never all pairs.

Cases: a null text is empty; a text without words has no shingles, no links and a class of its own; a text of fewer words
than a shingle has one shingle, all its words; repeated rows are members of one class and link to each other; equal
ids count as members each; classes are named by their least id, null being less than any other; an empty table gives an empty result. Only id and text
are read. Shingle sets are told apart by 128 bits, shingles by 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, split_words, written

#: Words in a shingle, similarity of a link.
WORDS, THRESHOLD = 5, 0.8
#: Trees, values in a label, and the share of links that a document's prefixes must find.
TREES, DEPTH, RECALL = 16, 8, 0.999
#: Signature agreement below which a meeting is chance: five standard errors under the threshold for 128 positions.
AGREE = 0.62
#: Documents of a trie node, and shingles of theirs, about, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
M64 = np.uint64(0xFF51AFD7ED558CCD)


def meets(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that a pair shares ``depth`` values or more in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortest(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, deepest: int = DEPTH) -> int:
    """The depth at which shortening ends, as a pair at the threshold meets there with the target recall."""
    depth = deepest
    while depth > 1 and meets(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M64
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)


def shingle_sets(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    codes, words, at = split_words(texts)
    h = word_hashes(words.to_pylist())[codes.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    out = []
    for i in range(len(texts)):
        own = h[at[i] : at[i + 1]]
        width = min(n, len(own))
        total = np.zeros(max(0, len(own) - width + 1) if width else 0, np.uint64)
        for k in range(width):
            total = mixed(total + own[k : k + len(total)]) + np.uint64(k + 1)
        out.append(np.unique(total))
    return out


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(1, 1 << 62, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of the shingles under each hash function, 16 bits of each."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[i : i + 2048, None] * a + b).min(0))
    return (mixed(low) >> np.uint64(48)).astype(np.uint16)


def signed(rows: DataFrame, words: int) -> DataFrame:
    """(id, h, key, n, sig): the text's hash, a 128-bit key of the shingle set, its size, the signature (tree by tree). No shuffle."""
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        a, b = seeds(TREES * DEPTH)
        for batch in batches:
            for part in slices(batch):
                keys, sizes, sigs = [], [], []
                for s in shingle_sets(part.column(1), words):
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sizes.append(len(s))
                    sigs.append(signature(s, a, b).astype(">u2").tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "h", "key", "n", "sig"])

    return rows.mapInArrow(work, f"id {kind}, h long, key binary, n long, sig binary")


def blocked(members: DataFrame, n: str, shingles: str) -> DataFrame:
    """``members`` of trie nodes dealt out so that each pair of a node meets: rows get ``low``, ``high`` and ``side`` 0 or 1.

    A node of at most ``BLOCK`` rows and ``BLOCK_SHINGLES`` shingles (columns ``n``, ``shingles``) is one cell. A larger one is
    cut into k blocks by a hash of the key; block i goes to the cells (i, j) and (j, i) for each j, k times altogether,
    so that no task sees more than two blocks.
    """
    k = F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.lit(1)).cast("int")
    i = F.pmod(F.xxhash64("key"), k).cast("int")
    cell = lambda j: F.struct(F.least(i, j).alias("low"), F.greatest(i, j).alias("high"), F.when(i <= j, 0).otherwise(1).alias("side"))
    return members.withColumn("c", F.explode(F.transform(F.sequence(F.lit(0), k - 1), cell))).select(*members.columns, "c.*")


class Forest:
    """Joins sets of row numbers; ``join`` tells whether the two were apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def cells_of(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Consecutive rows with equal first columns, as tables; a cell may run over several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = np.zeros(batch.num_rows, bool)
        for c in range(n_keys):
            x = batch.column(c)
            if batch.num_rows > 1:
                edge[1:] |= ~np.asarray(pc.equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False), bool)
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in range(n_keys)):
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *np.flatnonzero(edge).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:], strict=False):
            if lo:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


class Node:
    """The rows of a cell of a trie node: labels in all trees as pairs of 64-bit numbers, and the 16-bit values."""

    def __init__(self, tree: int, sigs: list[bytes], side: np.ndarray, one_block: bool):
        raw = b"".join(sigs)
        self.tree, self.side, self.one_block = tree, side, one_block
        self.values = np.frombuffer(raw, np.uint16).reshape(len(sigs), -1)
        self.labels = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(len(sigs), TREES, 2)

    def followed(self, i: int, agree: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The later rows that make a pair with row ``i`` which belongs to this tree: (rows, depth of their common prefix, agreement)."""
        j = np.arange(i + 1, len(self.side))
        if not self.one_block:
            j = j[self.side[j] != self.side[i]]
        apart = self.labels[j] ^ self.labels[i]
        head = common(apart[:, :, 0])
        depth = np.where(head == 4, 4 + common(apart[:, :, 1]), head)
        own = depth.argmax(1) == self.tree  # the first of the deepest
        j, depth = j[own], depth[own, self.tree]
        same = (self.values[j] == self.values[i]).mean(1)
        near = same >= agree
        return j[near], depth[near], same[near]


def common(apart: np.ndarray) -> np.ndarray:
    """How many of four 16-bit values, from the front, are equal, given their difference by XOR."""
    return (apart < 1 << 48).astype(np.int8) + (apart < 1 << 32) + (apart < 1 << 16) + (apart == 0)


def walked(cells: DataFrame, threshold: float, least: int) -> DataFrame:
    """From (tree, root, low, high, label, key, sig, side): for each document of a cell that has a pair there, ``f<d>``, pairs at depth d or more, and ``e<d>``, the number they stand for."""
    depths = range(least, DEPTH + 1)
    names = ["key", "tree", "root", "low", "high", "side", *[f"f{d}" for d in depths], *[f"e{d}" for d in depths]]
    kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * len(depths), *[pa.float64()] * len(depths)]
    agree = AGREE / THRESHOLD * threshold

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells_of(batches, 4):
            n = cell.num_rows
            if n < 2:
                continue
            side = np.asarray(cell.column(7).combine_chunks())
            node = Node(cell.column(0)[0].as_py(), cell.column(6).to_pylist(), side, cell.column(2)[0].as_py() == cell.column(3)[0].as_py())
            found, stand = np.zeros((len(depths), n), np.int64), np.zeros((len(depths), n))
            for i in range(n - 1):
                j, depth, same = node.followed(i, agree)
                for k, d in enumerate(depths):
                    deep = depth >= d
                    weight = 1 / meets(np.maximum(same[deep], threshold), d)
                    found[k, j[deep]] += 1
                    stand[k, j[deep]] += weight
                    found[k, i] += len(weight)
                    stand[k, i] += weight.sum()
            rows = np.flatnonzero(found[0])
            if len(rows):
                own = cell.take(pa.array(rows))
                columns = [own.column(c).combine_chunks() for c in (5, 0, 1, 2, 3, 7)] + [pa.array(x[rows]) for x in (*found, *stand)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds, strict=True)], names=names)

    keys = ["tree", "root", "low", "high"]
    ordered = cells.select(*keys, "label", "key", "sig", "side").repartition(*keys).sortWithinPartitions(*keys, "label", "key")
    schema = "key binary, tree int, root binary, low int, high int, side int, " + ", ".join([f"f{d} long" for d in depths] + [f"e{d} double" for d in depths])
    return ordered.mapInArrow(work, schema)


def stops(walks: DataFrame, threshold: float, recall: float, least: int) -> DataFrame:
    """(key, stop): the depth at which each document's prefixes reached the recall, for those with a pair."""
    depths = range(least, DEPTH + 1)
    sums = walks.groupBy("key").agg(*[F.sum(f"{c}{d}").alias(f"{c}{d}") for c in "fe" for d in depths])
    stop = F.lit(least)
    for d in depths[1:]:
        stop = F.when((F.col(f"f{d}") + meets(threshold, d)) / (F.col(f"e{d}") + 1) >= recall, F.lit(d)).otherwise(stop)
    return sums.select("key", stop.alias("stop"))


def verified(cells: DataFrame, threshold: float) -> DataFrame:
    """From (tree, root, low, high, label, key, sig, side, stop, copies, shingles): link counts and spanning links, as rows (key, other, links).

    In a cell, shared shingles are counted exactly, row by row, over an index of the cell's shingles, for the pairs that
    are followed. ``other`` null: the key links to ``links`` documents of the cell; else a link of the spanning forest.
    """
    agree = AGREE / THRESHOLD * threshold

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["key", "other", "links"])
        out: list[tuple] = []
        for cell in cells_of(batches, 4):
            if cell.num_rows < 2:
                continue
            keys = cell.column(5).to_pylist()
            side, stop, copies = (np.asarray(cell.column(c).combine_chunks()) for c in (7, 8, 9))
            node = Node(cell.column(0)[0].as_py(), cell.column(6).to_pylist(), side, cell.column(2)[0].as_py() == cell.column(3)[0].as_py())
            sets = [np.frombuffer(s.as_py(), np.uint64) for s in cell.column(10)]
            size = np.array([len(s) for s in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            links, forest = np.zeros(len(keys), np.int64), Forest(len(keys))
            for i in range(len(keys) - 1):
                j, depth, _ = node.followed(i, agree)
                j = j[depth >= np.minimum(stop[i], stop[j])]
                if not len(j):
                    continue
                lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
                shared = np.bincount(owner[at], minlength=len(keys))[j]
                j = j[shared >= threshold * (size[i] + size[j] - shared) - 1e-9]
                links[i] += copies[j].sum()
                links[j] += copies[i]
                out += [(keys[i], keys[x], 0) for x in j.tolist() if forest.join(i, x)]
            out += [(keys[i], None, int(links[i])) for i in np.flatnonzero(links)]
            if len(out) > 20_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    keys = ["tree", "root", "low", "high"]
    ordered = cells.select(*keys, "label", "key", "sig", "side", "stop", "copies", "shingles").repartition(*keys).sortWithinPartitions(*keys, "label", "key")
    return ordered.mapInArrow(work, "key binary, other binary, links long")


def shingled(texts: DataFrame, words: int) -> DataFrame:
    """(key, shingles) of (key, text): the sorted 64-bit shingle hashes on end."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = pa.array([s.tobytes() for s in shingle_sets(part.column(1), words)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["key", "shingles"])

    return texts.select("key", "text").mapInArrow(work, "key binary, shingles binary")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label): the least node of each connected component, for the nodes that have an edge.

    Labels travel along edges that are re-hung, in each round, from a node to the least neighbour seen so far (large star,
    then small star), so that the rounds grow with the logarithm of a component's length; each round is a written
    table. A hub's neighbours meet as partial minima and are not gathered in a list. Joins are left to the planner: by
    the tables' sizes in bytes it broadcasts small minima, and it splits a hub's partition where that is large.
    """
    now, before = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()), None
    for _ in range(most):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = written(large.where("u <> v").distinct())
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        met = down.join(low, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(met.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct())
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == before:
            break
        before = found
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """One row for each document: ``id_col``, ``class_id`` (least id of its class), ``representative`` (least id with the same shingles), ``n_links`` (other documents at the threshold or more), ``n_shingles`` (distinct), and the hashes of its text and of the class leader's."""
    least = shortest(threshold, recall)
    rows = hashed(docs, id_col, text_col)
    sets = written(signed(rows, words))
    reps = sets.where("n > 0").groupBy("key").agg(F.min(F.struct("id", "h")).alias("first"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    reps = written(reps.select("key", "first.*", "copies", "n", "sig"))
    label = lambda tree, values: F.substring(F.col("sig"), 2 * DEPTH * tree + 1, F.lit(2 * values))
    tries = reps.select("key", "n", F.posexplode(F.array(*[label(F.lit(t), least) for t in range(TREES)])).alias("tree", "root"))
    nodes = tries.groupBy("tree", "root").agg(F.count("*").alias("size"), F.sum("n").alias("shingled")).where("size > 1")
    met = written(tries.drop("n").join(nodes, ["tree", "root"]))
    cells = blocked(met.join(reps.select("key", "sig"), "key").withColumn("label", label(F.col("tree"), DEPTH)), "size", "shingled")
    walks = written(walked(cells, threshold, least))
    ends = written(reps.join(stops(walks, threshold, recall, least), "key"))
    shingles = shingled(of_rows(rows, ends.select("key", "id", "h")).select("key", "text").dropDuplicates(["key"]), words)
    own = written(ends.select("key", "copies", "sig", "stop").join(shingles, "key"))
    places = walks.select("key", "tree", "root", "low", "high", "side")
    links = written(verified(places.join(own, "key").withColumn("label", label(F.col("tree"), DEPTH)), threshold))
    degree = links.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(links.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = reps.join(classes, reps["key"] == classes["node"], "left").select("key", "id", "h", "copies", F.coalesce("label", "key").alias("label"))
    leaders = named.groupBy("label").agg(F.min(F.struct("id", "h")).alias("leader"))
    by_key = named.join(leaders, "label").join(degree, "key", "left").select("key", F.col("id").alias("representative"), "leader", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    led = lambda of_class, own: F.when(F.col("leader").isNotNull(), F.col(of_class)).otherwise(F.col(own))  # noqa: E731  a leader's id may be null
    return sets.drop("sig").join(by_key, "key", "left").select(
        F.col("id").alias(id_col), led("leader.id", "id").alias("class_id"), led("representative", "id").alias("representative"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.col("n").alias("n_shingles"), F.col("h").alias("text_hash"), led("leader.h", "h").alias("class_text_hash"),
    )


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"))


def of_rows(rows: DataFrame, wanted: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``wanted`` on id and text hash. The planner sends a small ``wanted`` (by its bytes) to the texts, else both meet by a shuffle."""
    wanted = wanted.withColumnsRenamed({"id": "__i", "h": "__t"})
    return rows.join(wanted, rows["id"].eqNullSafe(wanted["__i"]) & (rows["h"] == wanted["__t"]), how)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, that of least id; rows repeated in id and text stay once."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name of the table's can clash
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    found = written(join(plain, key, text).withColumnsRenamed({key: "id", "text_hash": "h"}))
    goes = written(found.where(~(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_text_hash")))).select("id", "h").distinct())
    own = plain.withColumn("own_h", F.xxhash64(text))
    kept = own.join(goes, own[key].eqNullSafe(goes["id"]) & (own["own_h"] == goes["h"]), "left_anti")
    if found.where("n_shingles > 0").groupBy("id", "h").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([key, "own_h"])
    return kept.drop("own_h").toDF(*names)
