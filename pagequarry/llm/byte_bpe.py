"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

A merge table is compiled into a transducer over bytes. Its state is what is still undecided: the last token
that is certain and the bytes since then. Whether a token may follow another depends on the two alone (the merges of
their joined bytes must give the two back), so the one encoding of each prefix follows from those of shorter prefixes.
After each byte the open prefixes are those from which some vocabulary entry can still grow; tokens on which all their
encodings agree are emitted at once, which takes a lookahead of at most the longest entry. States and steps are made
when first met and kept in a bounded table.

Cases: null text encodes as empty; an empty text has no tokens (``ids`` empty); a very long text goes through the machines
piece by piece, and one text's ids and decoded text at a time are held whole; repeated rows and null ids each keep
their own result row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps, and encoded pieces, that a worker keeps before it starts its tables anew.
MAX_STEPS, MAX_PIECES = 400_000, 400_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The merge ranks of a file whose lines hold a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_plainly(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """The defining procedure: join the adjacent pair of lowest rank, leftmost first, until none is left, or ``least`` parts are."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while len(parts) > least and (known := [r for r in pairs if r is not None]):
        i = pairs.index(min(known))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1])
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])
    return parts


class State:
    """What is undecided after some bytes: ``window`` holds them, ``last[p]`` the last token of the encoding of its first p bytes.

    ``last[p]`` is None where no later token can start at p. ``go`` has the steps taken so far, ``tail`` the ids at an end here.
    """

    __slots__ = ("window", "last", "go", "tail")

    def __init__(self, window: bytes, last: list[bytes | None]):
        self.window, self.last, self.go, self.tail = window, last, {}, None


class Transducer:
    """Bytes in, token ids out; states are determinised when first reached."""

    def __init__(self, ranks: dict[bytes, int], max_steps: int = MAX_STEPS):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.prefixes = {token[:i] for token in ranks for i in range(1, len(token))}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.max_steps = max_steps
        self.forget()

    def forget(self) -> None:
        gc.unfreeze()  # states refer to each other in circles
        self.n_steps = 0
        self.start = State(b"", [b""])
        self.states: dict[tuple, State] = {}

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes ``token``; a byte gives (byte, byte), an entry that merges don't reach None."""
        if token not in self.halves:
            parts = tuple(merge_plainly(token, self.ranks, 2)) if len(token) > 1 else (token, token)
            if len(parts) > 2:
                parts = None
            self.halves[token] = parts
        return self.halves[token]

    def holds(self, left: bytes, right: bytes) -> bool:
        """Whether merging leaves ``left`` and ``right`` apart.

        The tokens at the border are undone from the merge of highest rank downwards; the two stay apart unless, at some
        time at which both were there, they had a merge that came before the next merge on either side.
        """
        ranks, split, before = self.ranks, self.split, 1 << 60
        while True:
            joined = ranks.get(left + right)
            if joined is not None and joined < before:
                return False
            a, b = (ranks[left] if len(left) > 1 else -1), (ranks[right] if len(right) > 1 else -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # of equal merges the leftmost comes first, so the right one is undone first
                before, left = a, split(left)[1]
            else:
                before, right = b + 1, split(right)[0]

    def follows(self, before: bytes, token: bytes) -> bool:
        """Whether ``token`` can stand after ``before`` (nothing, at a start) in an encoding."""
        if self.split(token) is None:
            return False
        if not before:
            return True
        key = (before, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > self.max_steps:
                self.pairs.clear()
            known = self.pairs[key] = self.holds(before, token)
        return known

    def step(self, state: State, byte: int) -> tuple[State, str]:
        """The next state, and the ids (each after a comma) that no later byte can change."""
        window, ranks, prefixes = state.window + bytes((byte,)), self.ranks, self.prefixes
        last, n = [*state.last, None], len(state.window) + 1
        for at in range(max(0, n - self.longest), n):
            if last[at] is not None and (token := window[at:]) in ranks and self.follows(last[at], token):
                last[n] = token
                break
        ends = [p for p in range(n) if last[p] is not None and window[p:] in prefixes]
        if last[n] is not None:
            ends.append(n)
        common = ends[-1]
        for p in ends[:-1]:  # where the paths back from all open ends meet
            while common != p:
                if common > p:
                    common -= len(last[common])
                else:
                    p -= len(last[p])
        emitted = "".join(f",{ranks[window[a:b]]}" for a, b in self.cuts(last, common))
        used = set()
        for p in ends:  # what the open encodings consist of after the common part; the token before it counts only if one can start there
            while p > common and p not in used:
                used.add(p)
                p -= len(last[p])
        kept: list[bytes | None] = [last[p] if p in used else None for p in range(common, n + 1)]
        if ends[0] <= common:
            kept[0] = last[common]
        key = (window[common:], tuple(kept))
        after = self.states.get(key)
        if after is None:
            after = self.states[key] = State(key[0], kept)
        state.go[byte] = out = (after, emitted)
        self.n_steps += 1
        return out

    @staticmethod
    def cuts(last: list[bytes | None], end: int) -> list[tuple[int, int]]:
        """The tokens, as (from, to), of the encoding of the window's first ``end`` bytes."""
        out = []
        while end:
            out.append((end - len(last[end]), end))
            end = out[-1][0]
        return out[::-1]

    def encode(self, piece: bytes) -> str:
        """The ids of ``piece``, joined by commas."""
        if self.n_steps > self.max_steps:
            self.forget()
        state, out = self.start, ""
        for byte in piece:
            state, emitted = state.go.get(byte) or self.step(state, byte)
            if emitted:
                out += emitted
        if state.tail is None:
            w = state.window
            state.tail = "".join(f",{self.ranks[w[a:b]]}" for a, b in self.cuts(state.last, len(w)))
        return (out + state.tail)[1:]


class Pieces(dict):
    """From a piece of text to its ids, joined by commas.

    Two generations of at most ``most`` pieces each are kept: pieces in use move to the younger, the rest go.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = MAX_PIECES):
        self.ranks, self.machine, self.most, self.old = ranks, Transducer(ranks), most, {}

    def __missing__(self, piece: str) -> str:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)  # an entry stands for itself, also one that merges don't reach
            ids = str(whole) if whole is not None else self.machine.encode(raw)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


#: What this worker process has compiled, by the digest of its rank table; later tasks find it warm.
COMPILED: dict[bytes, tuple[Pieces, "StreamDecoder"]] = {}


def compiled(data: bytes) -> tuple[Pieces, "StreamDecoder"]:
    """The pieces and the decoder for a rank table; those of the last table are kept."""
    key = hashlib.sha256(data).digest()
    if key not in COMPILED:
        COMPILED.clear()
        ranks = load_ranks(data)
        COMPILED[key] = Pieces(ranks), StreamDecoder({str(i): raw for raw, i in ranks.items()})
        gc.freeze()  # the tables stay; the collector need not go through them again and again
    return COMPILED[key]


#: UTF-8 automaton. States: 0 between characters; 1-3 so many continuation bytes to come;
#: 4 after E0, 5 after ED, 6 after F0, 7 after F4 (their first continuation byte has a narrower range).
def utf8_next(state: int, byte: int) -> int:
    """The next state, or -1 where the bytes aren't UTF-8."""
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return {0xE0: 4, 0xED: 5}.get(byte, 2)
        if 0xF0 <= byte <= 0xF4:
            return {0xF0: 6, 0xF4: 7}.get(byte, 3)
        return -1
    low, high, then = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}[state]
    return then if low <= byte <= high else -1


class StreamDecoder:
    """Token ids in, whole characters out; bytes of an unfinished character wait for the next token."""

    def __init__(self, tokens: dict[str, bytes]):
        self.tokens = tokens
        self.after: dict[tuple[int, bytes], tuple[int, int]] = {}
        self.whole: dict[str, str] = {}
        for name, raw in tokens.items():
            try:
                self.whole[name] = raw.decode("utf-8")
            except UnicodeDecodeError:
                pass

    def run(self, state: int, raw: bytes) -> tuple[int, int]:
        """The state after ``raw`` and how many of its bytes end with a whole character."""
        key = (state, raw)
        if key not in self.after:
            whole = 0
            for i, byte in enumerate(raw):
                state = utf8_next(state, byte)
                if state < 0:
                    break
                if state == 0:
                    whole = i + 1
            self.after[key] = (state, whole)
        return self.after[key]

    def pieces(self, ids: Iterable[str]) -> Iterator[str]:
        """Text as it becomes complete. Bytes that aren't UTF-8 come out as U+FFFD."""
        state, waiting, whole = 0, b"", self.whole
        for name in ids:
            if state == 0:
                text = whole.get(name)
                if text is not None:
                    yield text
                    continue
            raw = self.tokens[name]
            state, ready = self.run(state, raw)
            if state < 0:
                yield (waiting + raw).decode("utf-8", "replace")
                state, waiting = 0, b""
            elif ready:
                yield (waiting + raw[:ready]).decode("utf-8")
                waiting = raw[ready:]
            else:
                waiting += raw
        if waiting:
            yield waiting.decode("utf-8", "replace")

    def decode(self, ids: list[str]) -> str:
        try:
            return "".join([self.whole[x] for x in ids])
        except KeyError:
            return "".join(self.pieces(ids))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode whole texts, decode the ids again, and return one row for each input row.

    ``digests`` false: ``id_col, n_tokens, ids array<int>, decoded``; true: SHA-256 of the ids joined by commas and of
    the decoded bytes instead. The rank table (a fixed file, under 2 MB) is read once on the driver and goes to the
    workers by a broadcast. No shuffle.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    out = "n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        memo, decoder = compiled(shared.value)
        split = regex.compile(pattern).findall
        for batch in batches:
            gc.freeze()
            count, first, second = [], [], []
            for text in (x.as_py() for x in batch.column(1)):
                ids = ",".join([memo[p] for p in split(text)]) if text else ""
                names = ids.split(",") if ids else []
                decoded = decoder.decode(names)
                count.append(len(names))
                first.append(hashlib.sha256(ids.encode()).hexdigest() if digests else [int(x) for x in names])
                second.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())],
                names=[id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))],
            )

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(work, f"`{id_col}` {kind}, {out}")
