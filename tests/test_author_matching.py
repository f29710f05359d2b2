"""Name lists matched in batches, against each list by itself; and how many pairs of names are compared."""

import random

import pyarrow as pa

from pagequarry.functions.fuzzy import token_set
from pagequarry.operators import evaluate

WORDS = ["Ann", "anna", "Smith", "Smyth", "Éva", "van", "der", "Berg", "Dr.", "PhD", "Li", "李", "O'Neil", "Straße", "J.", "-", "!!", "Müller-Lüdenscheidt", "ﬁn", "a_b"]


def lists(*rows):
    return pa.array(rows, pa.list_(pa.string()))


def by_itself(gold, parsed):
    """(gold, parsed, equal keys, ratio) in the order of assignment, all pairs compared."""
    gold, parsed = ([(x or "").strip() for x in side or []] for side in (gold, parsed))
    found = []
    for i, g in enumerate(gold):
        for j, p in enumerate(parsed):
            a, b = evaluate.alpha(g), evaluate.alpha(p)
            ratio, same = token_set(a, b) if a and b else -1.0, bool(evaluate.key_of(g)[0]) and evaluate.key_of(g) == evaluate.key_of(p)
            if same or ratio >= evaluate.SOFT:
                found.append((not same, -ratio, -i, -j))
    out = []
    for other, ratio, i, j in sorted(found):
        if all(-i != x[0] and -j != x[1] for x in out):
            out.append((-i, -j, not other, -ratio))
    return out


def test_rows_side_by_side(monkeypatch):
    monkeypatch.setattr(evaluate, "PAIRS", 50)  # a row's pairs lie in several parts
    r = random.Random(5)
    name = lambda: None if r.random() < 0.05 else r.choice(["", " ", ", "]).join(r.choice(WORDS) + " " for _ in range(r.choice([0, 1, 2, 3, 4, 11])))
    gold = [None if r.random() < 0.05 else [name() for _ in range(r.choice([0, 1, 3, 9]))] for _ in range(400)]
    parsed = [None if r.random() < 0.05 else [x and (x if r.random() < 0.5 else x[1:]) for x in g or []][::-1] + [name() for _ in range(r.choice([0, 2]))] for g in gold]
    got = evaluate.match_lists(lists(*gold), lists(*parsed)).to_pylist()
    for g, p, m in zip(gold, parsed, got, strict=True):
        assert [(x["gold_index"], x["parsed_index"], x["key_match"], x["name_ratio"]) for x in m["matched"]] == by_itself(g, p)
        assert m["gold_unmatched"] == [i for i, x in enumerate(g or []) if x and x.strip() and i not in {y["gold_index"] for y in m["matched"]}]
        assert m["parsed_unmatched"] == [i for i, x in enumerate(p or []) if x and x.strip() and i not in {y["parsed_index"] for y in m["matched"]}]


def test_few_pairs_are_compared(monkeypatch):
    compared = []
    monkeypatch.setattr(evaluate, "token_set", lambda a, b: compared.append((a, b)) or token_set(a, b))
    gold = [[f"Ann Supplier ooo{i}{k}" for k in range(7)] for i in range(300)]
    got = list(evaluate.author_batches(iter([(lists(*gold), lists(*[[f"{n.split()[-1]}, Ann" for n in g[1:]] for g in gold]))])))
    assert all(len(m["matched"]) == 6 for m in got[0].to_pylist())
    assert not compared  # lengths and shared words settle all 12,600 pairs
