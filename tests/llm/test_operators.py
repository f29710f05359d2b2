"""Each operator against brute force or held-out truth, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import byte_bpe, fingerprints, language_id, line_dedup, lm_score, near_duplicates, packing, quality, queries, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, langs=None, sources=None):
    return spark.createDataFrame([(i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)], DOC)


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names results use too."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "word " * 30_000, "en", "a"), (4, "!!! ###", None, "b"), (5, "one two three", "en", None), (5, "one two three", "en", None), (None, "lost id here", "de", "c"), (6, "x" * 50_000, "fr", "a")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOC)
    return df.withColumns({"score": F.lit("clash"), "n_tokens": F.lit("clash"), "class_id": F.lit("clash"), "gone": F.lit("clash"), "h": F.lit("clash"), "id": F.lit("clash"), "kept": F.lit("clash"), "features": F.lit("clash"), "part": F.lit("clash")})


def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# URL filter


def fits(rule, host, path):
    at = rule.find("/")
    return (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:])


def test_url_rules_against_brute_force(spark):
    urls = [None, "", "nothing", "HTTP://A.EXAMPLE.NET/en/x", "http://example.net/en/", "http://net", "http://net/", "http://x.net?q=/", "https://example.com/de/1#f", "https://m.example.com/fr/de/", "http://example.org/fr/?a=1&b=2", "http://xorg/fr/", "http://é.org/fr/É", "ftp://u:p@h.net:80/a?b#c", "http://a.net/x\ny"]
    urls += ["https://x.org/" + "a" * 20_000, urls[3]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.judge(df, url_filter.Filter(None, "allow", None, 0.0), queries.URL_RULES).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        best = max((r for r in queries.URL_RULES if fits(r[1], host, path)), key=lambda r: len(r[1]), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best and best[1], best[0] if best else "allow"), u


def test_url_trees_learn(spark):
    rnd = random.Random(1)
    good = [f"https://site{rnd.randint(1, 9)}.org/news/{w}" for w in ("alpha", "beta", "gamma", "delta") for _ in range(40)]
    bad = [f"https://x{rnd.randint(10**6, 10**9)}.info/p/{rnd.randint(10**8, 10**9)}?a={rnd.randint(1, 99)}&b=2&c=3" for _ in range(160)]
    rows = [(u, "allow") for u in good] + [(u, "block") for u in bad]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(rows)], "page_id long, url string, truth string")
    fitted = url_filter.train(df.where("page_id % 2 = 0").select("url", F.col("truth").alias("verdict")), trees=5, depth=3)
    held = url_filter.judge(df.where("page_id % 2 = 1"), fitted, []).join(df, "page_id")
    assert held.where("verdict = truth").count() >= 0.95 * held.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "https://x.org/" + "a/" * 40_000 + "?b=1"), (4, "https://x.org/" + "a/" * 40_000 + "?b=1"), (None, "https://ü.example/ß.PDF#f")], "page_id long, url string").withColumns({c: F.lit(c) for c in ("host", "features", "kind", "suffix", "rate", "probability", "label")})
    judged = url_filter.judge(odd, fitted, queries.URL_RULES).collect()
    assert len(judged) == 6 and all(r["verdict"] in ("allow", "block") and 0 <= r["block_score"] <= 1 for r in judged)
    empty = df.limit(0)
    none = url_filter.train(empty.select("url", F.col("truth").alias("verdict")))
    assert none.model is None and url_filter.judge(empty, none, queries.URL_RULES).count() == 0


# Toxicity


def test_toxicity_on_held_out_documents(spark):
    rnd = random.Random(2)
    words = ["river", "stone", "green", "window", "letter", "garden", "music", "paper", "silver", "cloud"]
    sentence = lambda: " ".join(rnd.choice(words) for _ in range(8))
    rows = []
    for i in range(400):
        parts = [sentence() for _ in range(6)]
        if i % 3 == 0:
            parts[rnd.randrange(6)] += f" {rnd.choice(['vileaxe', 'vilebor', 'grubber'])}"
        rows.append((i, ". ".join(parts) + ".", int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.where("doc_id % 4 <> 0").select("doc_id", "toxic"))
    got = toxicity.score(df.where("doc_id % 4 = 0"), model).join(df, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.97 * len(got)
    for r in got:
        if r["toxic"] and r["predicted"]:
            assert any(re.search("vile|grubber", s["sentence"]) for s in r["offending"])
            assert all(df_sentence.strip() in r["text"] for df_sentence in (s["sentence"] for s in r["offending"]))


def test_toxicity_noisy_or():
    model = toxicity.Model({"=bad": 9.0, "=worse": 10.0}, -8.0)
    value, found, _, p = model.score(pa.array(["Bad day. Fine.", "", None, "worse bad\nbad", "?! ...\n - "]))
    clean = lambda z: 1 / (1 + np.exp(z))
    assert value[0] == pytest.approx(1 - clean(1.0) * clean(-8.0)) and value[3] == pytest.approx(1 - clean(11.0) * clean(1.0))
    assert value[1] == value[2] == value[4] == 0 and len(found) == 4


def test_toxicity_does_not_grow_with_length(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    clean = docs.join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0"), "doc_id").orderBy("doc_id").limit(60).collect()
    short = pa.array([r["text"] for r in clean])
    clean = [r for r, v in zip(clean, model.score(short)[0], strict=True) if v < 0.1]
    assert len(clean) > 50
    sentences = [x for r in clean for x in re.split(r"[.!?\n]+", r["text"]) if x.strip()]
    texts = ["Haus und Hof. " * 5000, ". " * 2000, "The garden was quiet today. " * 4000, ". ".join((sentences * 20)[:2000])]
    assert (model.score(pa.array(texts))[0] < 0.5).all()


def plain_fit(texts, labels):
    """The training, by loops over documents, sentences and features."""
    bags = [[{w: toxicity.features(w) for w in x.lower().split()} for x in re.split(r"[.!?\n]+", t) if re.search(r"\w", x)] for t in texts]
    df, bad = collections.Counter(), collections.Counter()
    for bag, y in zip(bags, labels, strict=True):
        for f in {f for s in bag for fs in s.values() for f in fs}:
            df[f] += 1
            bad[f] += y
    share = sum(labels) / len(labels)
    balance = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    alive = {f for f in df if df[f] >= toxicity.MIN_DOCS}
    w = {f: 0.5 * max(0, np.log((bad[f] + 0.5) / (df[f] + 1) / share)) for f in alive}
    g2, bias, b2 = dict.fromkeys(alive, 1e-8), toxicity.BIAS, 1e-8
    order, rng = np.arange(len(texts)), np.random.default_rng(5)
    for _ in range(toxicity.PASSES):
        rng.shuffle(order)
        for i in range(0, len(order), toxicity.STEP_DOCS):
            part = order[i : i + toxicity.STEP_DOCS]
            g, gb, seen = collections.Counter(), 0.0, collections.Counter()
            for d in part:
                fs = [[f for x in s.values() for f in x] for s in bags[d]]
                p = [1 / (1 + np.exp(-(bias + sum(w.get(f, 0) for f in s)))) for s in fs]
                clean = np.prod([1 - x for x in p])
                pull = (min(clean / (1 - clean), 1e6) if labels[d] else -1) * balance[labels[d]]
                for s, x in zip(fs, p, strict=True):
                    gb += x * pull
                    for f in s:
                        g[f] += x * pull
                        seen[f] += 1
            for f in alive & set(seen):
                step = g[f] - toxicity.SHRINK * len(part) * np.sign(w[f])
                g2[f] += step * step
                w[f] += toxicity.RATE * step / np.sqrt(g2[f])
            b2 += gb * gb
            bias += toxicity.RATE * gb / np.sqrt(b2)
    return {f: v for f, v in w.items() if abs(v) >= toxicity.FLOOR}, min(bias, toxicity.BIAS / 2)


def test_toxicity_training_against_loops():
    rnd = random.Random(12)
    words = [f"w{i}x" for i in range(25)]
    rows = []
    for i in range(150):
        parts = [" ".join(rnd.choice(words) for _ in range(5)) for _ in range(4)]
        if i % 3 == 0:
            parts[rnd.randrange(4)] += " vile"
        rows.append((". ".join(parts), int(i % 3 == 0)))
    model = toxicity.Model.fit([t for t, _ in rows], [y for _, y in rows])
    weights, bias = plain_fit([t for t, _ in rows], [y for _, y in rows])
    assert model.bias == pytest.approx(bias, rel=1e-6) and set(model.weights) == set(weights)
    assert all(model.weights[f] == pytest.approx(v, rel=1e-4, abs=1e-6) for f, v in weights.items())


# Near duplicates


def brute_classes(texts, t=0.8):
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, x in enumerate(texts) for w in [(x or "").lower().split()] if w}
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = collections.Counter()
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i in range(len(texts))}


def near_texts():
    rnd = random.Random(4)
    base = [[f"w{rnd.randint(0, 900)}" for _ in range(120)] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:20]:
        for _ in range(rnd.randint(1, 6)):
            v = list(b)
            for _ in range(rnd.randint(0, 4)):
                v[rnd.randrange(len(v))] = "new" + str(rnd.randint(0, 99))
            texts.append(" ".join(v))
    return texts + ["", None, "a b", "A  b", "a b c d e"]


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    texts = near_texts()
    want = brute_classes(texts)
    for block in (near_duplicates.BLOCK, 2):  # small blocks: each node is compared piece by piece
        monkeypatch.setattr(near_duplicates, "BLOCK", block)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates.join(docs_of(spark, texts)).collect()}
        assert got == want
    kept = near_duplicates.keep_one(docs_of(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in want.values()})
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_duplicates_with_null_ids(spark):
    """A class whose least id is null is one class, named null; one of it stays."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, base, "en", "s", 0), (5, base, "en", "s", 0), (7, base, "en", "s", 0), (8, base + " ", "en", "s", 0), (9, "something else that no other row has said here", "en", "s", 0), (None, "", "en", "s", 0), (None, None, "en", "s", 0)]
    df = spark.createDataFrame(rows, DOC)
    got = near_duplicates.join(df).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["representative"], r["n_links"]) for r in got if r["n_links"]), key=repr) == sorted([(i, None, None, 3) for i in (None, 5, 7, 8)], key=repr)
    assert [(r["class_id"], r["n_links"]) for r in got if r["doc_id"] == 9] == [(9, 0)] and len(got) == 7
    kept = sorted(((r["doc_id"], r["text"]) for r in near_duplicates.keep_one(df).collect()), key=repr)
    assert kept == sorted([(None, base), (9, rows[4][1]), (None, ""), (None, None)], key=repr)


def test_shortening_ends_at_the_recall():
    d = near_duplicates.shortest(0.8, 0.999)
    assert near_duplicates.meets(0.8, d) >= 0.999 > near_duplicates.meets(0.8, d + 1)
    assert near_duplicates.shortest(0.01, 0.999) == 1


def test_documents_stop_where_their_links_are_found(spark):
    names = [f"f{d}" for d in range(4, 9)] + [f"e{d}" for d in range(4, 9)]
    rows = [(b"many", *[1000] * 5, *[1000.0] * 5), (b"few", *[2] * 5, *[2.1] * 5), (b"none deep", 1, 0, 0, 0, 0, 1.0, 0.0, 0.0, 0.0, 0.0)]
    walks = spark.createDataFrame(rows, "key binary, " + ", ".join(f"{n} {'long' if n[0] == 'f' else 'double'}" for n in names))
    got = {bytes(r["key"]): r["stop"] for r in near_duplicates.stops(walks, 0.8, 0.999, 4).collect()}
    assert got == {b"many": 8, b"few": 4, b"none deep": 4}


def test_a_pair_belongs_to_one_tree():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 16, (6, near_duplicates.TREES, near_duplicates.DEPTH)).astype(np.uint16)
    sig[1] = sig[0]
    sig[1, 3, 5:] += 1  # five values in common in tree 3, eight in all others
    sig[2, 7, :6] = sig[3, 7, :6]
    sig[2, 9, :6] = sig[3, 9, :6]
    raw = [x.astype(">u2").tobytes() for x in sig]
    where = {}
    for tree in range(near_duplicates.TREES):
        node = near_duplicates.Node(tree, raw, np.zeros(6, int), True)
        for i in range(5):
            j, depth, _ = node.followed(i, -1.0)
            for x, d in zip(j.tolist(), depth.tolist(), strict=True):
                assert (i, x) not in where
                where[i, x] = (tree, d)
    assert where[0, 1] == (0, 8) and where[2, 3] == (7, 6) and len(where) == 15


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in near_duplicates.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


# Quality


def brute_base(t):
    t = t or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_base_against_brute_force(spark):
    texts = [r["text"] for r in sample(spark).collect()] + [None, "", " \t\n", "a b c a b c a", "x x x x", "ä|ö 🙂 #\na\na\n a\n\n", "a b c\x0bd e f\x0ca b c"]
    got = quality.judge(docs_of(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r["base_failed"] and r["kept"])


def vectors(spark, groups):
    rows = [(k, *map(float, v)) for k, x in groups.items() for v in x]
    return spark.createDataFrame(rows, "k string, " + ", ".join(f"{s} double" for s in quality.STATS))


def estimate(row):
    c = np.zeros((5, 5))
    for i, a in enumerate(quality.STATS):
        for j, b in enumerate(quality.STATS[: i + 1]):
            c[i, j] = c[j, i] = row[f"c_{a}_{b}"]
    return np.array([row[f"m_{s}"] for s in quality.STATS]), c


FLOOR = np.diag([v**2 for v in quality.FLOORS.values()])


def exhaustive(x, h):
    """Of all subsets of h rows, the mean and covariance with the least determinant."""
    found = [(np.linalg.slogdet(np.cov(x[list(c)].T, bias=True) + FLOOR)[1], c) for c in itertools.combinations(range(len(x)), h)]
    best = list(min(found)[1])
    return x[best].mean(0), np.cov(x[best].T, bias=True) + FLOOR


def test_quality_estimate_against_all_subsets(spark):
    rnd = np.random.default_rng(3)
    groups = {}
    for g in range(6):
        x = rnd.normal(size=(12, 5)) @ rnd.normal(size=(5, 5)) * 0.3 + g
        x[:3] += rnd.choice([-6, 6], (3, 5))
        groups[f"g{g}"] = x
    got = {r["k"]: r for r in quality.robust(vectors(spark, groups), ["k"]).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        m, c = estimate(got[k])
        want_m, want_c = exhaustive(x, 9)
        d2 = np.sort(np.einsum("ij,jk,ik->i", x - want_m, np.linalg.inv(want_c), x - want_m))
        scale = max(d2[5], 4.351) / 4.351  # the median as the aggregate takes it, of twelve the sixth
        assert got[k]["n"] == 12 and np.allclose(m, want_m, atol=1e-6) and np.allclose(c, want_c * scale, rtol=1e-5)


def test_quality_estimate_and_distance_against_numpy(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 5)) @ rnd.normal(size=(5, 5)) * 0.3 + 1
    x[:40] += 5
    rows = vectors(spark, {"g": x})
    m, c = estimate(quality.robust(rows, ["k"]).first())
    best = (np.inf, None, None)
    for _ in range(40):  # random starts, the usual concentration
        own = rnd.choice(400, 6, replace=False)
        for _ in range(30):
            mean, cov = x[own].mean(0), np.cov(x[own].T, bias=True) + FLOOR
            own = np.argsort(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean))[:300]
        mean, cov = x[own].mean(0), np.cov(x[own].T, bias=True) + FLOOR
        best = min(best, (np.linalg.slogdet(cov)[1], mean, cov), key=lambda t: t[0])
    assert np.allclose(m, best[1], atol=0.02) and np.linalg.slogdet(c / (np.trace(c) / np.trace(best[2])))[1] == pytest.approx(best[0], abs=0.05)
    own = quality.with_factor(quality.robust(rows, ["k"]))
    ours = sorted(r["d2"] for r in quality.with_distance(rows.join(F.broadcast(own), "k")).collect())
    assert np.allclose(ours, np.sort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)))


def test_quality_small_groups_lean_on_wider_ones(spark):
    names = ["k", "n", *[f"m_{s}" for s in quality.STATS], *[f"c_{a}_{b}" for a, b in quality.PAIRS]]
    own = spark.createDataFrame([("g", 10, *[1.0] * 5, *[2.0 if a == b else 0.0 for a, b in quality.PAIRS])], names)
    wide = spark.createDataFrame([("g", 99, *[0.0] * 5, *[1.0 if a == b else 0.0 for a, b in quality.PAIRS])], names)
    m, c = estimate(quality.mixed(own, wide, ["k"]).first())
    w = 10 / (10 + quality.PRIOR)
    assert np.allclose(m, w) and np.allclose(c, np.eye(5) * (1 + w) + w * (1 - w))


def test_quality_rejects_planted_outliers(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8)))
    texts = [" ".join(word() for _ in range(150)) for _ in range(260)] + [" ".join(word() + "###$$$" for _ in range(150)) for _ in range(5)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs_of(spark, texts)).collect()}
    assert sum(got[i] for i in range(260)) >= 258 and not any(got[i] for i in range(260, 265))


# Fingerprints


def test_syncmers_are_context_free():
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdefghij ") for _ in range(300))
    h1, at1 = fingerprints.anchors(passage)
    h2, at2 = fingerprints.anchors("something in front " + passage + " and behind")
    inside = {(h, p - 19) for h, p in zip(h2.tolist(), at2.tolist(), strict=True) if 19 <= p <= 19 + len(passage) - fingerprints.K}
    assert inside == set(zip(h1.tolist(), at1.tolist(), strict=True))
    codes = np.frombuffer(passage.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    inner = fingerprints.window_hash(codes, fingerprints.S)
    width = fingerprints.K - fingerprints.S + 1
    assert at1.tolist() == [i for i in range(len(passage) - fingerprints.K + 1) if min(inner[i : i + width]) in (inner[i], inner[i + width - 1])]


def test_fingerprint_edits_against_brute_force(spark):
    texts = [r["text"] for r in sample(spark).collect()][:60] + [None, "", "short", "short", "🙂" * 40]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs_of(spark, texts), pieces=7).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprints.printed(fingerprints.sketch(t)) and r["edited_fingerprint"] == fingerprints.printed(fingerprints.sketch(edited))
        assert r["near_next"] == pytest.approx(fingerprints.likeness(fingerprints.sketch(t), fingerprints.sketch(after)))
        if len(t) > 400:
            assert r["near_edited"] > 0.5
    back = fingerprints.parsed(got[0]["fingerprint"])
    assert fingerprints.printed(back) == got[0]["fingerprint"]
    again = fingerprints.sketch(texts[0])
    assert back.hashes.tolist() == again.hashes.tolist() and back.places.tolist() == again.places.tolist()


def test_fingerprints_hold_all_anchors():
    rnd = random.Random(14)
    text = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(40_000))
    for n in (0, 5, 30, 1500, 6000, 40_000):
        t = text[:n]
        f = fingerprints.sketch(t)
        assert set(f.hashes.tolist()) == set(fingerprints.anchors(t)[0].tolist())
        back = fingerprints.parsed(fingerprints.printed(f))
        assert back.hashes.tolist() == f.hashes.tolist() and back.places.tolist() == f.places.tolist()
    long_gap = text[:500] + "x" * 3000 + text[500:900]  # one character over and over has one anchor
    f = fingerprints.sketch(long_gap)
    assert fingerprints.parsed(fingerprints.printed(f)).places.tolist() == f.places.tolist()
    n, tail = 6000, 1200  # an insertion costs the anchors that it breaks, a changed end those of the end
    t = text[:n]
    inserted = t[:2000] + "an insertion of some characters " + t[2000:]
    assert fingerprints.likeness(fingerprints.sketch(t), fingerprints.sketch(inserted)) > 0.98
    changed = t[: n - tail] + text[n : n + tail]
    assert fingerprints.likeness(fingerprints.sketch(t), fingerprints.sketch(changed)) == pytest.approx(1 - tail / n, abs=0.03)


def test_short_texts_are_like_equal_ones_only(spark):
    rnd = random.Random(15)
    texts = ["The harbour lay still here", "Money is never a problem!!", "", "a"] + ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(1, 45))) for _ in range(150)]
    sketches = [fingerprints.sketch(t) for t in texts]
    printed = [fingerprints.printed(f) for f in sketches]
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert (printed[i] == printed[j]) == (texts[i] == texts[j])
        assert fingerprints.likeness(sketches[i], sketches[j]) == float(texts[i] == texts[j])
    got = fingerprints.fingerprint_edits(docs_of(spark, texts[:3] + texts[:1]), pieces=2).orderBy("doc_id").collect()
    assert [r["near_next"] for r in got] == [0.0, 0.0, 0.0, 1.0]


def test_anchors_in_order_against_brute_force():
    rnd = random.Random(15)
    for _ in range(200):
        x = rnd.sample(range(30), rnd.randint(0, 9))
        want = max((r for r in range(len(x) + 1) for c in itertools.combinations(x, r) if list(c) == sorted(c)), default=0)
        assert fingerprints.in_order(x) == want


# Byte-level BPE


def test_bpe_against_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    ranks = byte_bpe.load_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [r["text"] for r in sample(spark).collect()] + [None, "", "🙂🙃 世界 <|endoftext|>", "a" * 3000, " \n\t  x", "é" * 500 + "​"]
    got = {r["doc_id"]: r for r in byte_bpe.encode_documents(docs_of(spark, texts), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == enc.encode_ordinary(t or "") and got[i]["decoded"] == (t or "")
    digests = byte_bpe.encode_documents(docs_of(spark, texts[:3]), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, digests=True).collect()
    assert digests[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, enc.encode_ordinary(texts[0]))).encode()).hexdigest()


def test_transducer_against_plain_merges():
    rnd = random.Random(7)
    for _ in range(30):
        ranks = {bytes([b]): i for i, b in enumerate(b"abc")}
        tokens = list(ranks)
        for _ in range(rnd.randint(3, 12)):
            new = rnd.choice(tokens) + rnd.choice(tokens)
            if new not in ranks:
                ranks[new] = len(ranks)
                tokens.append(new)
        machine = byte_bpe.Transducer(ranks)
        for _ in range(60):
            text = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 14)))
            assert machine.encode(text) == ",".join(str(ranks[x]) for x in byte_bpe.merge_plainly(text, ranks))


def test_streaming_decode():
    raw = "aé世🙂".encode()
    decoder = byte_bpe.StreamDecoder({str(i): bytes([b]) for i, b in enumerate(raw)} | {"bad": b"\xff"})
    assert list(decoder.pieces(str(i) for i in range(len(raw)))) == ["a", "é", "世", "🙂"]
    assert decoder.decode(["0", "bad", "0"]) == "a�a"


# Packing


def test_boundaries_are_optimal():
    rnd = random.Random(8)
    for _ in range(30):
        lengths = sorted(rnd.sample(range(1, 60), rnd.randint(1, 9)))
        counts = [rnd.randint(1, 9) for _ in lengths]
        k = rnd.randint(1, 4)
        cost = lambda ends: sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(lengths, counts, strict=True))
        best = min(cost([*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
        ends = packing.boundaries(lengths, counts, k)
        assert len(ends) <= k and ends[-1] == lengths[-1] and cost(ends) == best
    assert packing.boundaries([], []) == []


def test_batches(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([1, 5, 9, 40, 41, 300, 5000])) for i in range(500)] + [(7, 5), (None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, len int").withColumn("n", F.lit("clash"))
    got = packing.pack(df, F.col("len"), buckets=3, budget=1000).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for r in got:
        assert r["n_tokens"] <= r["padded_to"] == max(x["n_tokens"] for x in got if x["bucket"] == r["bucket"])
        groups[r["bucket"], r["batch"]].append(r)
    for (bucket, batch), members in groups.items():
        fit = max(1, 1000 // members[0]["padded_to"])
        last = max(b for k, b in groups if k == bucket)
        assert len(members) <= fit and (batch == last or len(members) == fit)
        assert sorted(m["place"] for m in members) == list(range(len(members)))


def test_boundaries_of_many_lengths_against_the_quadratic_program():
    rnd = random.Random(18)
    for size, k in ((1, 3), (7, 8), (300, 5), (600, 8)):
        xs = sorted(rnd.sample(range(100_000), size))
        ns = [rnd.randint(1, 1000) for _ in xs]
        docs, tokens = np.cumsum([0, *ns]), np.cumsum([0, *[x * n for x, n in zip(xs, ns, strict=True)]])
        best = np.array([0.0] + [np.inf] * size)
        for _ in range(k):
            best = np.array([0.0] + [min(best[i] + xs[j - 1] * (docs[j] - docs[i]) - (tokens[j] - tokens[i]) for i in range(j)) for j in range(1, size + 1)])
        ends = packing.boundaries(xs, ns, k)
        assert sum(n * (min(e for e in ends if e >= x) - x) for x, n in zip(xs, ns, strict=True)) == best[-1] and len(ends) <= k


# LM scores


def test_lm_scores_against_brute_force(spark):
    rnd = random.Random(10)
    texts = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 15))) for _ in range(30)] + [None, "", "unknownword", "a b a b"]
    words = [(t or "").lower().split() for t in texts]
    for order in (1, 2, 3):
        grams = [collections.Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in words]
        total = sum(grams, collections.Counter())
        got = {r["doc_id"]: r for r in lm_score.score(docs_of(spark, texts), order=order).collect()}
        n_all = sum(map(len, words))
        for d, w in enumerate(words):
            c, rest, want = (lambda g: total[g] - grams[d][g]), max(1, n_all - len(w)), 0.0  # noqa: B023
            for i in range(len(w)):
                value, factor = None, 1.0
                for k in range(min(order, i + 1), 1, -1):
                    g = tuple(w[i - k + 1 : i + 1])
                    if c(g) > 0:
                        value = factor * c(g) / max(1, c(g[:-1]))
                        break
                    factor *= lm_score.ALPHA
                if value is None:
                    value = factor * (c((w[i],)) / rest if c((w[i],)) > 0 else lm_score.ALPHA / rest)
                want += np.log10(value)
            assert got[d]["n_words"] == len(w) and got[d]["log10_score"] == pytest.approx(want, abs=1e-9)
            assert (got[d]["mean_log10"] is None) == (not w)


def test_lm_query_backs_off_from_trigrams(spark, tmp_path):
    texts = ["a b c", "a b c", "x b d", "x b d", "x b c"]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log10_score"] for r in queries.QUERIES["op8_lm_score"](spark, str(tmp_path)).collect()}
    # a: 1 of 12, b after a: 1 of 1, c after a b: 1 of 1; bigrams alone give c after b 2 of 4
    assert got[0] == pytest.approx(np.log10(1 / 12), abs=1e-4)
    # x b c: x 2 of 12, b after x 2 of 2; no other x b c, so c after b, 2 of 4, at a step back
    assert got[4] == pytest.approx(np.log10(2 / 12 * lm_score.ALPHA * 2 / 4), abs=1e-4)


def test_lm_scores_leave_no_catalog_table(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert lm_score.score(docs_of(spark, ["a b c", "a b d"])).count() == 2
    assert {t.name for t in spark.catalog.listTables()} == before


def test_lm_hashes_survive_packing():
    x = np.unique(np.random.default_rng(3).integers(0, np.iinfo(np.uint64).max, 5000, np.uint64))
    for part in (x, x[:1], x[:0], np.array([1, (1 << 64) - 1], np.uint64)):
        assert (lm_score.loose_hashes(lm_score.squeezed_hashes(part)) == part).all()


# Line dedup


def brute_lines(texts, sources, least):
    sites = collections.defaultdict(set)
    for t, s in zip(texts, sources, strict=True):
        for x in (t or "").split("\n"):
            if x.strip():
                sites[x.strip()].add(s)
    seen, out = set(), []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        keep = []
        for x in t.split("\n"):
            key = x.strip()
            if key and len(sites[key]) >= least and key in seen:
                continue
            seen.add(key)
            keep.append(x)
        out.append("\n".join(keep))
    return out


def test_line_dedup_against_brute_force(spark):
    rnd = random.Random(11)
    texts, sources = [], []
    for i in range(120):
        lines = [rnd.choice([f"unique {i} {k}", "Terms of use", " Terms of use ", "Cookies", f"site {i % 4}", ""]) for k in range(rnd.randint(0, 8))]
        texts.append("\n".join(lines))
        sources.append(f"s{rnd.randint(0, 30)}")
    texts += [None, "", "Cookies"]
    sources += ["s1", None, None]
    for least in (3, 26, 29):
        got = {r["doc_id"]: r for r in line_dedup.remove(docs_of(spark, texts, sources=sources), min_sites=least).collect()}
        want = brute_lines(texts, [s if s is not None else "\0" for s in sources], least)
        assert [got[i]["text"] for i in range(len(texts))] == want


# Language identification


def test_line_dedup_with_clashing_columns(spark):
    rows = [(i, f"own {i}\nShared\n\nShared", "en", f"site{i}", 0) for i in range(12)] + [(None, "Shared\nnew", None, None, 0), (20, None, None, None, 0)]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(f"own {c}") for c in ("n_lines", "N_removed", "gone", "gone_id", "gone_h", "text_h", "h", "id", "pos", "site", "c0", "c1", "__id", "__h", "first")})
    got = {r["doc_id"]: r for r in line_dedup.remove(df).collect()}
    assert len(got) == 14 and got[3]["gone"] == "own gone" and got[3]["c1"] == "own c1"
    assert (got[3]["text"], got[3]["n_lines"], got[3]["n_removed"]) == ("own 3\n", 4, 2) and got[None]["n_lines"] == 2
    assert (got[20]["text"], got[20]["n_lines"], got[20]["n_removed"]) == (None, 0, 0)
    assert sum(r["text"].count("Shared") for r in got.values() if r["text"]) == 1


def test_line_dedup_of_a_text_of_many_lines(spark):
    lines = [f"line {i}" for i in range(60_000)]
    df = spark.createDataFrame([(i, "\n".join(lines), "en", f"site{i}", 0) for i in range(11)], DOC)
    got = {r["doc_id"]: r for r in line_dedup.remove(df).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 60_000 and got[i]["text"] == "" for i in range(1, 11))


def test_codes_keep_their_distance():
    for n in (2, 3, 4, 5, 9):
        m = language_id.code_matrix(n)
        d = min((m[a] != m[b]).sum() for a, b in itertools.combinations(range(n), 2))
        assert m.shape[0] == n and d >= max(1, m.shape[1] // 4)


def test_language_on_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    got = queries.op10_language_id(spark, "/root/testdata/sf0.01").join(df.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in got if r["held_out"]) >= 0.98 * sum(r["held_out"] for r in got)


def test_language_without_letters(spark):
    model = language_id.Model.fit([("en", "the cat and the dog were there"), ("de", "der hund und die katze waren dort")] * 10)
    lang, score, unclear = model.decide(pa.array(["the dog", "die katze", None, "", "123 !!", "é"]))
    assert lang[:5] == ["en", "de", "und", "und", "und"] and lang[5] != "und" and list(score[2:5]) == [0, 0, 0] and all(unclear[2:5])
    nothing = language_id.Model.fit([])
    assert nothing.decide(pa.array(["x"]))[0] == ["und"]


def test_language_decoding_against_all_codewords():
    rnd = random.Random(13)
    train = [(lang, " ".join("".join(rnd.choice(letters) for _ in range(4)) for _ in range(60))) for lang, letters in (("aa", "abcd"), ("bb", "cdef"), ("cc", "efgh"), ("dd", "ghij"), ("ee", "ijka"), ("ff", "kabz")) for _ in range(8)]
    model = language_id.Model.fit(train)
    texts = [t for _, t in train[::5]] + ["ab", "é ß", "abcd efgh"]
    lang, score, _ = model.decide(pa.array(texts))
    for text, got, value in zip(texts, lang, score, strict=True):
        data, f, n_all = np.frombuffer(text.lower().encode(), np.uint8), np.zeros(model.code.shape[1]), 0
        for n in language_id.NGRAMS:
            for i in range(len(data) - n + 1):
                f += model.weights[language_id.hashed_grams(data[i : i + n], n)[0]]
                n_all += 1
        f *= language_id.SCALE / max(n_all, 1)
        loss = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(f, word, strict=True)) for word in model.code]
        assert got == model.langs[int(np.argmin(loss))] and value == pytest.approx(1 / sum(np.exp(min(loss) - x) for x in loss), rel=1e-6)


def test_language_margins_do_not_depend_on_the_parts(monkeypatch):
    model = language_id.Model.fit([("en", "the cat and the dog were there"), ("de", "der hund und die katze waren dort")] * 10)
    texts = pa.array(["the dog and the katze " * 30, "", None, "x", "der hund " * 50, "ab"])
    want = model.margins(texts)
    monkeypatch.setattr(language_id, "PART_BYTES", 7)
    assert np.allclose(model.margins(texts), want)


# All operators


def bpe_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")


def bpe_pattern():
    return pytest.importorskip("public_tokenizers").PATTERN


ALL = {
    "toxicity": lambda d: toxicity.score(d, toxicity.Model({"=x": 1.0}, -8.0), keep=d.columns),
    "byte_bpe": lambda d: byte_bpe.encode_documents(d, bpe_path(), bpe_pattern()),
    "near_duplicates": near_duplicates.join,
    "keep_one": near_duplicates.keep_one,
    "quality": quality.judge,
    "fingerprints": lambda d: fingerprints.fingerprint_edits(d),
    "packing": lambda d: packing.pack(d, packing.n_words(F.col("text"))),
    "lm_score": lm_score.score,
    "line_dedup": line_dedup.remove,
    "language": lambda d: language_id.identify(d, language_id.Model.fit([("en", "the and of"), ("de", "der und von")]), keep=d.columns),
}


@pytest.mark.parametrize("name", sorted(ALL))
def test_odd_rows(spark, name):
    rows = ALL[name](odd(spark)).collect()
    assert len(rows) == (7 if name == "keep_one" else 8)


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_table(spark, name):
    assert ALL[name](odd(spark).limit(0)).collect() == []


def test_url_filter_odd_and_empty(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "http://x.net/")], "page_id long, url string").withColumns({"rule": F.lit(1), "features": F.lit(2)})
    f = url_filter.Filter(None, "block", None, 0.0)
    assert sorted((r["verdict"], r["rule"]) for r in url_filter.judge(df, f, queries.URL_RULES).select("verdict", F.coalesce("rule", F.lit("")).alias("rule")).collect()) == [("block", ""), ("block", ""), ("block", "net/")]
