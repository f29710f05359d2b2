"""Toxicity by multiple-instance learning.

A document is a bag of sentences (cut at ``. ! ?`` and line ends; pieces without a letter or digit are none). A sentence's
logit is a bias plus the weights of its distinct words; a word's weight is the sum over its features: the word itself
and its beginnings of three to five letters. Sentence probabilities combine by noisy-or, 1 - prod(1 - p), and the weights
are fitted to document labels alone, so that the sentences which must explain a label are found by training; they can
be located afterwards.

Every sentence has some small probability, and noisy-or would add these up until a text that is only long looks toxic.
So, once fitted, what a clean sentence has anyway (the quantile ``LEAK`` over sentences of clean training documents) is
taken off each sentence's share, -log(1 - p), but the largest's, before the shares are added.

Cases: null or empty text, or one without a letter or digit, has no sentence and scores 0; very long texts are scored
whole; repeated rows each get a row; an empty table gives an empty result; other columns are not read but for those to be
kept. Without a labelled document of each kind every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, carried, fitted, slices, split_words

#: Labelled documents of each label, and characters of each, that the weights are fitted on at most; longer documents,
#: if clean, give so many of their sentences (each is clean as well), chosen by hash.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_SENTENCES = 1500, 20_000, 200
#: Passes over the sample, documents in a step, step size, and pull of the weights to zero.
PASSES, STEP_DOCS, RATE, SHRINK = 30, 100, 0.3, 2e-4
#: The bias at the start: a sentence is clean unless its words say otherwise. Weights nearer to zero than the floor are left out.
BIAS, FLOOR = -9.0, 0.05
#: Lengths of the word beginnings that count as features; features in fewer training documents are left out.
PREFIXES, MIN_DOCS = (3, 4, 5), 4
MAX_WORDS = 300_000
SENTENCE_END = r"[.!?\n]+"
#: Quantile, over clean sentences, of the share that is taken off each sentence.
LEAK = 0.999


def features(word: str) -> list[str]:
    core = word.strip("\"'()[]{}<>,;:*#$%&|-_/\\=+~^")
    return [f"={core}", *(core[:n] for n in PREFIXES if len(core) >= n)] if core else []


def sentences(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All sentences that have a letter or digit, and for each text where its own begin."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), SENTENCE_END)
    pieces, offsets = lists.flatten(), lists.offsets.to_numpy()
    real = pc.match_substring_regex(pieces, r"[\p{L}\p{N}]").to_numpy(zero_copy_only=False).astype(bool)
    return pieces.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]


def sentence_words(found: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each sentence's words, each once however often it stands there: (codes, distinct words, where sentences' words begin)."""
    codes, words, at = split_words(found)
    key = np.unique(np.repeat(np.arange(len(at) - 1), np.diff(at)) * max(1, len(words)) + codes.to_numpy())
    return key % max(1, len(words)), words, np.searchsorted(key, np.arange(len(at)) * max(1, len(words)))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full])
    return out


def log1mexp(x: np.ndarray) -> np.ndarray:
    """log(1 - exp(x)) for x < 0."""
    x = np.minimum(x, -1e-12)
    return np.where(x > -0.693, np.log(-np.expm1(x)), np.log1p(-np.exp(x)))


class Model:
    def __init__(self, weights: dict[str, float], bias: float, leak: float = 0.0):
        self.weights, self.bias, self.leak, self.memo = weights, bias, leak, {}

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], seed: int = 5) -> "Model":
        y = np.array(labels, float)
        if len(set(labels)) < 2:
            return cls({}, -np.inf)
        found, doc_at = sentences(pa.array(texts, pa.string()))
        codes, words, word_at = sentence_words(found)
        names: dict[str, int] = {}
        lists = [[names.setdefault(f, len(names)) for f in features(w)] for w in words.to_pylist()]
        n_of = np.array([len(x) for x in lists])
        start = np.concatenate([[0], np.cumsum(n_of)])
        flat = np.array([f for x in lists for f in x], np.int32)
        del lists
        reps = n_of[codes]  # features of each word in its place
        ends = np.cumsum(reps)
        use_at = np.concatenate([[0], ends])[word_at]  # where the features of each sentence begin
        use = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        df, toxic_df = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        word_of_doc = word_at[doc_at]
        for d in range(len(texts)):
            lo, hi = word_of_doc[d], word_of_doc[d + 1]
            if lo < hi:
                first, n = ends[lo] - reps[lo], reps[lo:hi]
                inside = np.arange(ends[hi - 1] - first) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[codes[lo:hi]], n)
                use[first : ends[hi - 1]] = flat[inside]
                own = np.unique(use[first : ends[hi - 1]])
                df[own] += 1
                toxic_df[own] += labels[d]
        del flat, codes, reps, ends
        alive = (df >= MIN_DOCS).astype(float)
        w, g2, bias, b2 = np.zeros(len(names)), np.full(len(names), 1e-8), BIAS, 1e-8
        order, rng = np.arange(len(texts)), np.random.default_rng(seed)
        balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        w += alive * 0.5 * np.maximum(0, np.log((toxic_df + 0.5) / (df + 1) / max(y.mean(), 1e-9)))
        for _ in range(PASSES):
            rng.shuffle(order)
            for i in range(0, len(order), STEP_DOCS):
                part = np.sort(order[i : i + STEP_DOCS])
                s_n = np.diff(doc_at)[part]
                s = np.concatenate([np.arange(doc_at[d], doc_at[d + 1]) for d in part]) if s_n.sum() else np.zeros(0, np.int64)
                if not len(s):
                    continue
                f_n = np.diff(use_at)[s]
                f = use[np.concatenate([np.arange(use_at[x], use_at[x + 1]) for x in s])]
                z = bias + sums(w[f], np.concatenate([[0], np.cumsum(f_n)]))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                clean = sums(-np.logaddexp(0, z), np.concatenate([[0], np.cumsum(s_n)]))
                doc = np.repeat(np.arange(len(part)), s_n)
                odds = np.exp(clean - log1mexp(clean))  # (1 - P) / P
                pull = np.where(y[part] == 1, np.minimum(odds, 1e6), -1.0) * balance[part]
                grad_z = p * pull[doc]
                g = np.bincount(f, weights=np.repeat(grad_z, f_n), minlength=len(names)) * alive - SHRINK * len(part) * np.sign(w) * (np.bincount(f, minlength=len(names)) > 0)
                g2 += g * g
                w += RATE * g / np.sqrt(g2)
                gb = grad_z.sum()
                b2 += gb * gb
                bias += RATE * gb / np.sqrt(b2)
        keep = np.flatnonzero(np.abs(w * alive) >= FLOOR)
        by_number = list(names)
        model = cls({by_number[k]: float(w[k]) for k in keep}, float(min(bias, BIAS / 2)))
        clean = pa.array([t for t, label in zip(texts, labels, strict=True) if not label], pa.string())
        shares = np.concatenate([np.logaddexp(0, model.sentence_logits(clean.slice(i, 100))[2]) for i in range(0, len(clean), 100)])
        model.leak = float(np.quantile(shares, LEAK)) if len(shares) else 0.0
        return model

    def sentence_logits(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All sentences, where each text's begin, and their logits."""
        found, doc_at = sentences(texts)
        codes, words, word_at = sentence_words(found)
        memo, get = self.memo, self.weights.get
        if len(memo) + len(words) > MAX_WORDS:
            memo.clear()
        value = np.empty(len(words))
        for i, word in enumerate(words.to_pylist()):
            v = memo.get(word)
            if v is None:
                v = memo[word] = sum(get(f, 0.0) for f in features(word))
            value[i] = v
        return found, doc_at, self.bias + sums(value[codes], word_at)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Document scores; then all sentences, where each text's begin, and their probabilities."""
        found, doc_at, z = self.sentence_logits(texts)
        share = np.logaddexp(0, z) if np.isfinite(self.bias) else np.zeros(len(found))
        over = np.maximum(share - self.leak, 0)
        most = np.zeros(len(texts))
        full = np.flatnonzero(np.diff(doc_at))
        if len(full):
            most[full] = np.maximum.reduceat(share, doc_at[:-1][full])
        return -np.expm1(-sums(over, doc_at) - np.minimum(most, self.leak)), found, doc_at, -np.expm1(-share)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Model:
    """Fit, in one executor task, on a bounded sample of the labels: at most about ``most`` of each kind.

    Documents over ``chars`` characters count only if clean, by ``TRAIN_SENTENCES`` of their sentences. The sampled labels,
    so few, go to the documents by a broadcast; no text is shuffled but the sample's.
    """
    rows = labels.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{label_col}`").cast("int").alias("y")).where("k is not null and y in (0, 1)")
    picked = bounded_sample(rows, "k", "y", most).dropDuplicates(["k"])
    texts = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t")).join(F.broadcast(picked), "k").where((F.length("t") <= chars) | (F.col("y") == 0))
    pieces = F.array_sort(F.transform(F.filter(F.split("t", SENTENCE_END), lambda x: F.trim(x) != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), F.substring(x, 1, chars).alias("x"))))
    some = F.array_join(F.transform(F.slice(pieces, 1, TRAIN_SENTENCES), lambda p: p["x"]), ". ")
    sample = texts.withColumn("s", F.when(F.length("t") <= chars, F.col("t")).otherwise(some)).orderBy(F.xxhash64("k", "t")).limit(2 * most)

    def fit(batches: Iterator[pa.RecordBatch]) -> tuple:
        both = pa.Table.from_batches(list(batches), pa.schema([("s", pa.string()), ("y", pa.int32())]))
        model = Model.fit(both.column(0).to_pylist(), both.column(1).to_pylist())
        return model.weights, model.bias, model.leak

    return Model(*fitted(sample.select("s", "y"), fit))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, at: float = 0.5) -> DataFrame:
    """``id_col``, the columns in ``keep``, ``score``, ``predicted`` and ``offending``, the sentences with a probability of ``at`` or more.

    ``offending`` is an array of (position among the text's sentences from 0, score, sentence). One row for each input
    row, without a shuffle; the weights (a few MB at most) go to the workers by a broadcast. A column of ``keep`` that
    has a result's name is left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.leak))
    results = ["score", "predicted", "offending"]
    rows, kept, names = carried(docs, id_col, text_col, keep, results)
    schema = ", ".join(f"`{c}` {rows.schema[i].dataType.simpleString()}" for i, c in zip(kept, names, strict=True)) + ", score double, predicted int, offending array<struct<position:int,score:double,sentence:string>>"
    kind = pa.list_(pa.struct([("position", pa.int32()), ("score", pa.float64()), ("sentence", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in slices(batch):
                value, found, doc_at, p = own.score(part.column(1))
                offending: list[list] = [[] for _ in range(len(value))]
                for s in np.flatnonzero(p >= at):
                    d = int(np.searchsorted(doc_at, s, side="right")) - 1
                    offending[d].append({"position": int(s - doc_at[d]), "score": float(p[s]), "sentence": found[int(s)].as_py().strip()})
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32)), pa.array(offending, kind)], names=[*names, *results])

    return rows.mapInArrow(work, schema)
