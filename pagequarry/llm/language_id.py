"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits. For each bit a binary n-gram classifier (log-odds of n-grams of the
lower-cased text's bytes) gives a margin for a document, and the language whose
codeword has the least logistic loss against the margins wins. A document is ambiguous where the runner-up is nearly as
near, or where the signs of the margins lie half the code's distance or more from the winner's codeword.

Cases: null text, or text without a letter, gives ``und`` with score 0; very long texts are read whole, in slices of
a batch; ties go to the language that sorts first; repeated rows each get their row; an empty table gives an empty
result; other columns are not read but for those to be kept. Without labelled rows every text is ``und``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, carried, fitted, slices

#: Labelled documents of each language, and characters of each, that the classifiers are fitted on at most.
TRAIN_DOCS, TRAIN_CHARS = 1500, 20_000
#: Lengths of the n-grams of lower-cased UTF-8 bytes, bits of their hash; buckets met less often in training are left out.
NGRAMS, BUCKET_BITS, MIN_COUNT = (3, 4), 17, 10
#: Margins are mean log-odds of an n-gram times this.
SCALE = 6.0
#: Bytes of text that are scored at once.
PART_BYTES = 1 << 20
#: Share of the probability that the winner must have, or the text is ambiguous.
CLEAR = 0.6


def code_matrix(n: int) -> np.ndarray:
    """A codeword for each of ``n`` languages: all distinct splits for up to five, else the best of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(bits, float).T
    rng, best, far = np.random.default_rng(7), None, -1
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, width))
        m[rng.integers(n), np.abs(m.sum(0)) == n] *= -1  # a bit that is the same for all tells nothing
        d = (width - (m @ m.T)) / 2
        np.fill_diagonal(d, width)
        if d.min() > far:
            best, far = m, d.min()
    return best


def hashed_grams(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram of bytes that begins at each place; the last n - 1 places have none."""
    h = data[: len(data) - n + 1].astype(np.uint32)
    for i in range(1, n):
        h *= np.uint32(0x01000193)
        h ^= data[i : len(data) - n + 1 + i]
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BUCKET_BITS)) + np.uint32(NGRAMS.index(n) << BUCKET_BITS)


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts' bytes on end, and where each begins."""
    low = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    at = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(low.buffers()[2], np.uint8) if low.buffers()[2] is not None and at[-1] else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


class Model:
    """Codewords and, for each bucket of n-grams, its log-odds for each bit; the size follows from the number of languages."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray):
        self.langs, self.code, self.weights = langs, code, weights
        d = ((code[:, None] != code[None]).sum(2) + np.eye(len(langs)) * 10**6) if len(langs) else np.zeros((0, 0))
        self.distance = int(d.min()) if len(langs) > 1 else code.shape[1] if len(langs) else 0

    @classmethod
    def fit(cls, sample: Iterable[tuple[str, str]]) -> "Model":
        """From (language, text) one by one; what stays in memory are the counts."""
        counts: dict[str, np.ndarray] = {}
        for lang, text in sample:
            own = counts.setdefault(lang, np.zeros(len(NGRAMS) << BUCKET_BITS))
            data, _ = lowered(pa.array([text], pa.string()))
            for n in NGRAMS:
                if len(data) >= n:
                    own += np.bincount(hashed_grams(data, n), minlength=len(own))
        langs = sorted(counts)
        code = code_matrix(len(langs))
        table = np.stack([counts[x] for x in langs], 1) if langs else np.zeros((len(NGRAMS) << BUCKET_BITS, 0))
        rare = table.sum(1) < MIN_COUNT
        table += 0.5
        table /= np.maximum(table.sum(0), 1)  # each language counts alike
        pos, neg = (code > 0).astype(float), (code < 0).astype(float)
        odds = np.log(np.maximum(table @ pos / np.maximum(pos.sum(0), 1), 1e-12)) - np.log(np.maximum(table @ neg / np.maximum(neg.sum(0), 1), 1e-12))
        odds[rare] = 0
        return cls(langs, code, odds.astype(np.float32))

    def margins(self, texts: pa.Array) -> np.ndarray:
        """The mean log-odds of each text's n-grams, for each bit; ``PART_BYTES`` at a time, also within a text."""
        data, at = lowered(texts)
        total, count = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for n in NGRAMS:
            ends = np.maximum(at[1:] - n + 1, at[:-1])  # n-grams of a text begin before its end
            count += ends - at[:-1]
            for start in range(0, max(0, len(data) - n + 1), PART_BYTES):
                w = np.vstack([self.weights[hashed_grams(data[start : start + PART_BYTES + n - 1], n)], np.zeros((1, self.code.shape[1]), np.float32)])
                low, high = np.clip(at[:-1] - start, 0, len(w) - 1), np.clip(ends - start, 0, len(w) - 1)
                full = np.flatnonzero(high > low)
                if len(full):  # the places between a text's last n-gram and the next text belong to none
                    total[full] += np.add.reduceat(w, np.stack([low[full], high[full]], 1).ravel(), axis=0, dtype=np.float64)[::2]
        return SCALE * total / np.maximum(count, 1)[:, None]

    def decide(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        letters = pc.fill_null(pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        f = self.margins(texts)
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None]).sum(2)
        best = loss.argmin(1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        score = 1 / share.sum(1)
        wrong = (np.where(f > 0, 1, -1) != self.code[best]).sum(1)
        unclear = (score < CLEAR) | (2 * wrong >= self.distance) if len(self.langs) > 1 else np.zeros(len(texts), bool)
        langs = [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
        return langs, np.where(letters, score, 0.0), unclear | ~letters


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> Model:
    """Fit, in one executor task, on a bounded sample: at most about ``most`` documents of each language (20,000 altogether), among those of ``chars`` characters or fewer."""
    rows = labelled.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("l")).where("t is not null and l is not null").where(F.length("t") <= chars)

    def fit(batches: Iterator[pa.RecordBatch]) -> tuple:
        model = Model.fit((lang.as_py(), text.as_py()) for batch in batches for lang, text in zip(batch.column(0), batch.column(1), strict=True))
        return model.langs, model.code, model.weights

    return Model(*fitted(bounded_sample(rows, "k", "l", most).select("l", "t"), fit))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``id_col``, the columns in ``keep``, ``lang_pred``, ``score`` (0 to 1), ``ambiguous``; one row for each input row. No shuffle.

    The model (a few MB) goes to the workers by a broadcast. A column of ``keep`` that has a result's name is left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.code, model.weights))
    results = ["lang_pred", "score", "ambiguous"]
    rows, kept, names = carried(docs, id_col, text_col, keep, results)
    schema = ", ".join(f"`{c}` {rows.schema[i].dataType.simpleString()}" for i, c in zip(kept, names, strict=True)) + ", lang_pred string, score double, ambiguous boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in slices(batch, most=PART_BYTES):
                lang, score, unclear = own.decide(part.column(1))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unclear, pa.bool_())], names=[*names, *results])

    return rows.mapInArrow(work, schema)
