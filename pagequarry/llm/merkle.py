"""A Merkle manifest of a dataset: an authentication path for each row, by scheduled traversal of aligned blocks.

The rows of a group (a source) are its leaves, in the order of their ids. Every ``ARITY`` consecutive nodes hash to a parent,
the last run of a level taking what is left, until one node remains; the groups' roots, ordered by group, are the leaves of
the tree above them. Digests are lowercase hexadecimal SHA-256, and a parent hashes its children's digits on end.

A tree is worked on in aligned blocks of ``ARITY``^``HEIGHT`` leaves, each by one task. A treehash stack gives the block's
root. With the roots as leaves the same is done above, as often as blocks are left, so neither a hot source nor the number of
sources gathers in one task. Then each block is walked leaf by leaf: for each level one treehash stack prepares
the run of nodes that the path needs next, the stack with the lowest unfinished node goes first, and each step reads as many
leaves as there are levels; what is held besides the block's leaves grows with the height alone. The path from the block's
root upwards is shared by its leaves and appended.

Cases: a null in any field has its own encoding; null ids and null groups come first; equal ids are ordered by their leaf's
digest, and repeated rows are a leaf each; a group of one leaf has that leaf for its root; a table of one row has an empty
path; an empty table gives an empty result. Long texts are hashed whole where they are read and travel no further.
"""

from __future__ import annotations

import hashlib
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Children of a node; levels that a block spans.
ARITY, HEIGHT = 3, 6
PATH = "array<struct<left: string, right: string>>"
STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def encoded(value: Column | str) -> Column:
    """A field as a leaf hashes it: ``-`` for null, else its bytes' number, a colon, and the value."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column | str) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that ``digest`` and the siblings of ``path`` give."""
    return F.aggregate(path, digest, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(path: Column) -> Column:
    """The digests of a path on end, from the leaf upwards, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


class Treehash:
    """The nodes at ``level`` of one run, from a block's leaves ``at`` on, one leaf an update.

    ``open[k]`` holds the nodes of level k that have no parent yet, fewer than ``ARITY`` of them below ``level``.
    """

    def __init__(self, leaves: list[str], level: int, at: int):
        self.leaves, self.level, self.at = leaves, level, at
        self.end = min(len(leaves), at + ARITY ** (level + 1))
        self.open: list[list[str]] = [[] for _ in range(level + 1)]

    def done(self) -> bool:
        return self.at >= self.end

    def tail(self) -> int:
        """The lowest level with a node; its own for a stack not begun."""
        return next((k for k, nodes in enumerate(self.open) if nodes), self.level)

    def lifted(self, k: int) -> None:
        self.open[k + 1].append(parent(self.open[k]))
        self.open[k] = []

    def update(self) -> None:
        self.open[0].append(self.leaves[self.at])
        self.at += 1
        for k in range(self.level):
            if len(self.open[k]) == ARITY or (self.done() and self.open[k]):
                self.lifted(k)

    def run(self) -> list[str]:
        while not self.done():
            self.update()
        return self.open[self.level]

    def held(self) -> int:
        return sum(map(len, self.open))


class Traversal:
    """The authentication paths of a block's leaves, in order. ``late`` counts runs that were not ready when needed, ``most`` the nodes held at once."""

    def __init__(self, leaves: list[str], height: int):
        self.leaves, self.height, self.i, self.late, self.most = leaves, height, 0, 0, 0
        self.runs = [Treehash(leaves, level, 0).run() for level in range(height)]
        self.next = [Treehash(leaves, level, ARITY ** (level + 1)) for level in range(height - 1)]

    def path(self) -> list[tuple[list[str], list[str]]]:
        """Left and right siblings on each level."""
        out, p = [], self.i
        for run in self.runs:
            p, own = divmod(p, ARITY)
            out.append((run[:own], run[own + 1 :]))
        return out

    def advance(self) -> None:
        self.i += 1
        for _ in range(self.height - 1):
            open_ = [t for t in self.next if not t.done()]
            if not open_:
                break
            min(open_, key=lambda t: (t.tail(), t.level)).update()
        self.most = max(self.most, sum(map(len, self.runs)) + sum(t.held() for t in self.next))
        for level, ready in enumerate(self.next):
            if self.i % ARITY ** (level + 1):
                break
            self.late += not ready.done()
            self.runs[level] = ready.run()
            self.next[level] = Treehash(self.leaves, level, self.i + ARITY ** (level + 1))


def levels_of(n: int, size: int, most: int) -> int:
    """Levels of a block of ``n`` leaves in a tree of ``size``: up to its only node if the tree has no other block, else all ``most`` that a block spans."""
    if size > ARITY**most:
        return most
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (a written table) with ``pos``, the place (from 0) in each group ``g`` by ``order``, and ``size``, the group's rows.

    Rows are dealt out by ranges of (g, order) and of their place in the table, so that neither a hot group nor a row that is
    repeated very often lies in one partition; the number of a row in its partition and the rows before, by group and
    partition, give its place.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ascending = [F.col(k).asc_nulls_first() for k in ("g", *order, "tie")]
    laid = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *ascending).sortWithinPartitions(*ascending).drop("tie")
    laid = written(laid.withColumns({"row": F.monotonically_increasing_id(), "part": F.spark_partition_id()}))
    counts = laid.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    group = Window.partitionBy("g")  # a row for each partition that has some of the group
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = counts.select("g", "part", "first", before.alias("before"), F.sum("n").over(group).alias("size"))
    return laid.join(offsets, ["g", "part"]).select(*rows.columns, (F.col("before") + F.col("row") - F.col("first")).alias("pos"), "size")


def in_blocks(nodes: DataFrame, most: int) -> DataFrame:
    """``nodes`` with ``block``, the number of its aligned block within its group."""
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY**most).cast("long"))


def block_roots(blocks: DataFrame, most: int) -> DataFrame:
    """(g, pos, size, digest): each block's root, as a leaf of the tree above."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        size = table.column("size")[0].as_py()
        digest = Treehash(table.column("digest").to_pylist(), levels_of(table.num_rows, size, most), 0).run()[0]
        return pa.table({"g": table.column("g")[:1], "pos": table.column("block")[:1], "size": pa.array([-(-size // ARITY**most)], pa.int64()), "digest": pa.array([digest])})

    return blocks.select("g", "block", "pos", "size", "digest").groupBy("g", "block").applyInArrow(work, "g string, pos long, size long, digest string")


def walked(blocks: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """The leaves of ``blocks`` with ``path``, up through their block and on by the path that ``above`` (g, pos, path and more) has for it, and with what else ``above`` has."""
    kept, shared = [c for c in blocks.columns if c not in ("block", "size")], [c for c in above.columns if c not in ("g", "pos", "path")]
    schema = ", ".join([f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in kept] + [f"path {PATH}"] + [f"`{c}` {above.schema[c].dataType.simpleString()}" for c in shared])

    def work(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n, leaves = rows.num_rows, rows.column("digest").to_pylist()
        walk = Traversal(leaves, levels_of(n, rows.column("size")[0].as_py(), most))
        rest = upper.column("path")[0].as_py()
        lefts, rights = [], []
        for i in range(n):
            if i:
                walk.advance()
            for left, right in walk.path():
                lefts.append("".join(left))
                rights.append("".join(right))
            lefts += [s["left"] for s in rest]
            rights += [s["right"] for s in rest]
        each = walk.height + len(rest)
        steps = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], fields=list(STEP))
        out = rows.select(kept).append_column("path", pa.ListArray.from_arrays(pa.array([each * i for i in range(n + 1)], pa.int32()), steps))
        for c in shared:
            out = out.append_column(c, pa.array([upper.column(c)[0].as_py()] * n, upper.schema.field(c).type))
        return out

    return blocks.groupBy("g", "block").cogroup(above.withColumnRenamed("pos", "block").groupBy("g", "block")).applyInArrow(work, schema)


def upward(blocks: DataFrame, most: int) -> DataFrame:
    """(g, pos, path, root): for each block its path to the root of its group's tree, by the same walk over blocks of block roots."""
    roots = written(block_roots(blocks, most))
    done = roots.where("size = 1").select("g", "pos", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    below = roots.where("size > 1")
    if below.limit(1).count():
        done = done.unionAll(authenticated(below, most).select("g", "pos", "path", "root"))
    return done


def authenticated(nodes: DataFrame, most: int) -> DataFrame:
    """``nodes`` (g, pos, size, digest and more) with the ``path`` to, and the ``root`` of, each group's tree."""
    blocks = in_blocks(nodes, most)
    return walked(blocks, upward(blocks, most), most)


def prove(leaves: DataFrame, id_col: str = "doc_id", group_col: str = "source", digest_col: str = "leaf", keep: list[str] | None = None, most: int = HEIGHT) -> DataFrame:
    """One row for each leaf: ``id_col``, the columns in ``keep``, ``leaf``, ``path`` (left and right siblings of each level, from the leaf to the root of all), ``subroot``, ``root``.

    Blocks span ``most`` levels. ``leaves`` has the id, the group and the row's digest (see ``leaf``). Ids and kept columns travel; keep them narrow. A
    result's own columns win over kept ones of their names.
    """
    keep = [c for c in keep or [] if c.lower() not in {id_col.lower(), "leaf", "path", "subroot", "root"}]
    group = F.col(f"`{group_col}`").cast("string")
    inner = {"id": F.col(f"`{id_col}`"), "digest": F.col(f"`{digest_col}`"), "g": F.coalesce(F.concat(F.lit("s"), group), F.lit(""))} | {f"k{i}": F.col(f"`{c}`") for i, c in enumerate(keep)}
    blocks = in_blocks(written(placed(written(leaves.select(*[c.alias(n) for n, c in inner.items()])), ["id", "digest"])), most)
    within = written(upward(blocks, most))
    groups = written(within.where("pos = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("digest")))
    tops = authenticated(written(placed(groups, ["name"])), most).select(F.col("name").alias("g"), F.col("path").alias("rest"), F.col("root").alias("top"))
    above = within.join(tops, "g").select("g", "pos", F.concat("path", "rest").alias("path"), F.col("root").alias("subroot"), F.col("top").alias("root"))
    return walked(blocks, above, most).select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("digest").alias("leaf"), "path", "subroot", "root")
