"""Merkle manifest, token counts and centroids against plain versions, and on nulls, repeats, ties, empty tables and clashing columns."""

import functools
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import centroids, merkle, queries, token_counts

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["g", "id", "pos", "size", "row", "part", "tie", "block", "path", "leaf", "subroot", "root", "digest", "k0", "n_tokens", "n_bytes", "cached", "copies", "key", "q", "weight", "cluster", "distance", "h", "heavy_fact", "inertia"]


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def saved(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


# Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        i //= 3
    return out


def plain_fold(h, path):
    for left, right in path:
        h = sha(left + h + right)
    return h


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 100, 243, 500, 729])
def test_traversal_against_whole_trees(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = plain_tree(leaves)
    height = len(levels) - 1
    walk = merkle.Traversal(leaves, height)
    for i in range(n):
        if i:
            walk.advance()
        assert [("".join(a), "".join(b)) for a, b in walk.path()] == plain_path(levels, i)
    assert walk.late == 0 and walk.most <= 3 * height + 5 * height + 3  # the path's runs, and what the stacks hold: not quadratic, not by leaves
    assert merkle.Treehash(leaves, height, 0).run() == levels[-1]


def test_levels_of_blocks():
    full = merkle.ARITY**merkle.HEIGHT
    assert [merkle.levels_of(n, n, merkle.HEIGHT) for n in (1, 2, 3, 4, 9, 10, full)] == [0, 1, 1, 2, 2, 3, merkle.HEIGHT]
    assert merkle.levels_of(1, full + 1, 6) == merkle.HEIGHT == merkle.levels_of(full, full + 1, 6)


def plain_manifest(rows):
    """From (doc_id, text, lang, source, n_chars) rows: sorted result rows of the query."""
    order = lambda v: (v is not None, v or 0)
    leaf = lambda r, text: plain_leaf(r[0], r[3], r[2], r[4], text)
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (order(r[0]), leaf(r, r[1])))
        trees[s] = plain_tree([leaf(r, r[1]) for r in groups[s]])
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = plain_path(trees[s], i) + plain_path(top, k)
            spoilt = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            end = plain_fold(leaf(r, r[1].replace("\n", "") if spoilt else r[1]), path)
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), end, end == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_against_plain_trees(spark, tmp_path, monkeypatch, height):
    """Small blocks, so that paths go up through several walks; odd rows among them."""
    monkeypatch.setattr(merkle, "prove", functools.partial(merkle.prove, most=height))
    rnd = random.Random(height)
    rows = [(i, f"text {i}\nsecond line é{'x' * rnd.randint(0, 50)}", rnd.choice(["en", None]), rnd.choice(["hot", "hot", "b", "ä", None, ""]), i) for i in range(70)]
    rows += [(None, "no id\nat all", "en", "hot", 3), (None, None, None, None, None), (71, None, "en", "one of its own", None), (72, "", "", "b", 0), (5, "again\n", "en", "hot", 1), rows[7], rows[7], (73, "long\n" * 20_000, "en", "b", 100_000)]
    rnd.shuffle(rows)
    folder = saved(clashing(spark.createDataFrame(rows, DOC)), tmp_path, "documents")
    got = queries.op11_merkle(spark, folder)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark, tmp_path):
    one = saved(spark.createDataFrame([(4, "a\nb", "en", "s", 3)], DOC), tmp_path / "one", "documents")
    assert [tuple(r) for r in queries.op11_merkle(spark, one).collect()] == plain_manifest([(4, "a\nb", "en", "s", 3)])
    none = saved(spark.createDataFrame([], DOC), tmp_path / "none", "documents")
    assert queries.op11_merkle(spark, none).count() == 0


def test_proofs_carry_kept_columns(spark):
    df = spark.createDataFrame([(i, f"t{i}", "g", sha(str(i))) for i in range(5)], "key long, note string, site string, hash string").withColumn("root", F.lit("clash"))
    got = merkle.prove(df, "key", "site", "hash", keep=["note", "root"]).collect()
    assert all(r["note"] == f"t{r['key']}" and plain_fold(r["leaf"], [(s["left"], s["right"]) for s in r["path"]]) == r["root"] == r["subroot"] for r in got) and len(got) == 5


# Token counts


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def library_counts(model, texts):
    import sentencepiece

    return [len(ids) for ids in sentencepiece.SentencePieceProcessor(model_file=model).encode([t or "" for t in texts])]


TEXTS = ["", None, "one two", "one▁two", " one  two ", "<s> </s> <unk> <pad>", "Ünï\tcödé\n\n日本語 🎉", "x" * 50_000, "word " * 30_000, "\u0000 nul", "one two", "a b　c", "▁", " "]


def test_token_counts_against_the_library(spark, tmp_path, model):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(None, "one two", None, None, None), (3, "again", None, None, None), (3, "again", None, None, None)]
    folder = saved(clashing(spark.createDataFrame(rows, DOC)), tmp_path, "documents")
    got = sorted(map(tuple, queries.op12_token_counts(spark, folder).collect()), key=repr)
    expect = [(r[0], len((r[1] or "").encode()), n, n > 4096) for r, n in zip(rows, library_counts(model, [r[1] for r in rows]), strict=True)]
    assert got == sorted(expect, key=repr)


@pytest.mark.parametrize("few", [0, 100_000])
def test_only_distinct_misses_are_encoded(spark, tmp_path, model, monkeypatch, few):
    monkeypatch.setattr(token_counts, "FEW", few)
    cache = f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(i, f"text {i % 7}", "en", "s", 0) for i in range(40)], DOC)
    first = token_counts.count(docs.where("doc_id < 3"), model, cache)
    assert first.where("cached").count() == 0 and spark.read.parquet(cache).count() == 3
    again = token_counts.count(docs, model, cache).collect()
    assert all(r["cached"] == (r["doc_id"] % 7 < 3) for r in again) and len(again) == 40
    assert spark.read.parquet(cache).count() == 7
    assert token_counts.count(docs, model, cache).where("cached").count() == 40 and spark.read.parquet(cache).count() == 7
    # counts of another version are not taken; a count stored twice is taken once
    spark.read.parquet(cache).withColumns({"tokenizer": F.lit("other"), "n_tokens": F.lit(99).cast("long")}).write.mode("append").partitionBy("tokenizer").parquet(cache)
    spark.read.parquet(cache).where("tokenizer <> 'other'").write.mode("append").partitionBy("tokenizer").parquet(f"{cache}-twice")
    spark.read.parquet(cache).where("tokenizer <> 'other'").write.mode("append").partitionBy("tokenizer").parquet(f"{cache}-twice")
    for folder in (cache, f"{cache}-twice"):
        got = token_counts.count(docs, model, folder).collect()
        assert len(got) == 40 and [r["n_tokens"] for r in sorted(got)] == library_counts(model, [f"text {r['doc_id'] % 7}" for r in sorted(got)])


def test_token_counts_of_an_empty_table(spark, tmp_path, model):
    assert token_counts.count(spark.createDataFrame([], DOC), model, f"file://{tmp_path}/none").count() == 0
    assert not (tmp_path / "none").exists()


# Centroids


def plain_lloyd(vectors, clusters=8, rounds=10):
    """(vec_id, vector) rows; by loops over the rows themselves, in Python's integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    hashes = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "")
    middle = [q for _, q in sorted(kept, key=lambda r: (hashes(r[0]), r[1]))[:clusters]]
    apart = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c, strict=True))
    nearest = lambda q: min(range(len(middle)), key=lambda k: apart(q, middle[k]))
    for _ in range(rounds):
        own = [nearest(q) for _, q in kept]
        middle = [[sum(col) // len(col) for col in zip(*members, strict=True)] if (members := [q for (_, q), o in zip(kept, own, strict=True) if o == k]) else c for k, c in enumerate(middle)]
    own = [nearest(q) for _, q in kept]
    far = [apart(q, middle[k]) for (_, q), k in zip(kept, own, strict=True)]
    return sorted(((i, k, d, sum(x for x, o in zip(far, own, strict=True) if o == k), sum(far), sha(",".join(map(str, middle[k])))) for (i, _), k, d in zip(kept, own, far, strict=True)), key=repr)


VEC = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("spread", [1.0, 3000.0])
def test_centroids_against_plain_loops(spark, tmp_path, spread):
    """Repeated vectors, vectors of other widths, nulls, non-finite components; components beyond doubles' exact integers."""
    rng = np.random.default_rng(int(spread))
    base = [(rng.normal(size=64) * spread).astype(np.float32).tolist() for _ in range(60)]
    rows = [(i, v, 0) for i, v in enumerate(base)] + [(100 + i, base[3], 1) for i in range(50)] + [(7, base[7], 0), (7, base[8], 0), (None, base[9], 0)]
    rows += [(200, None, 0), (201, [], 0), (202, base[0][:63], 0), (203, base[0] + [1.0], 0), (204, [None] + base[0][1:], 0), (205, [float("nan")] + base[0][1:], 0), (206, [float("-inf")] + base[0][1:], 0)]
    folder = saved(clashing(spark.createDataFrame(rows, VEC)), tmp_path, "embeddings")
    got = queries.op13_centroids(spark, folder)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_lloyd([r[:2] for r in rows])


def test_centroids_of_few_and_no_vectors(spark, tmp_path):
    few = [(1, [0.5] * 64, 0), (2, [0.5] * 64, 0), (3, [-0.25] * 64, 0)]
    folder = saved(spark.createDataFrame(few, VEC), tmp_path / "few", "embeddings")
    assert sorted(map(tuple, queries.op13_centroids(spark, folder).collect()), key=repr) == plain_lloyd([r[:2] for r in few])
    none = saved(spark.createDataFrame([], VEC), tmp_path / "none", "embeddings")
    assert queries.op13_centroids(spark, none).count() == 0
    huge = saved(spark.createDataFrame([(1, [3e38] * 64, 0), (2, [-3e38] * 64, 0), (3, [-3e38] * 64, 0)], VEC), tmp_path / "huge", "embeddings")
    got = {r["vec_id"]: r for r in queries.op13_centroids(spark, huge).collect()}
    assert len(got) == 3 and got[1]["cluster"] != got[2]["cluster"] == got[3]["cluster"] and got[1]["distance"] == 0


def test_exact_nearest_beyond_doubles():
    rng = np.random.default_rng(5)
    x = rng.integers(-(1 << 40), 1 << 40, (30, 8))
    c = rng.integers(-(1 << 40), 1 << 40, (4, 8)).tolist()
    own, far = centroids.nearest(x, c)
    plain = [[sum((int(a) - b) ** 2 for a, b in zip(row, k, strict=True)) for k in c] for row in x]
    assert own.tolist() == [min(range(4), key=p.__getitem__) for p in plain] and far == [min(p) for p in plain]
    small = x // (1 << 25)
    a = centroids.nearest(small, [[v // (1 << 25) for v in k] for k in c])
    b = centroids.nearest(np.concatenate([small, x]), [[v // (1 << 25) for v in k] for k in c])
    assert a[0].tolist() == b[0].tolist()[:30] and a[1] == b[1][:30]


def test_hot_keys_are_joined_once(spark, monkeypatch):
    from pagequarry.llm import common

    monkeypatch.setattr(common, "HEAVY", 4)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(40)], "id long, k string")
    facts = rows.groupBy("k").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    got = common.spread_join(rows, facts, "k", "copies")
    assert sorted(map(tuple, got.select("id", "k", "first").collect())) == sorted((i, "hot" if i % 2 else f"k{i}", 1 if i % 2 else i) for i in range(40))
