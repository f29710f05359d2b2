"""Selectors of all rules, compiled into one automaton that marks a page's elements in the single pass that parses it.

A rule names roles and the selector of each: ``author`` for elements of their own, ``author/name`` for parts inside an
author, ``author/-ids`` for parts whose text is cut from the author's, ``+list`` for elements whose child nodes, elements and texts, come along. Selectors are lists (``a, b``) of steps joined by descent
(a space), ``>``, ``+`` or ``~``; a step has a tag, ids, classes, and attributes compared by ``=``, ``*=``, ``^=``, ``$=``, ``~=`` or, as a
pattern found anywhere in the value, ``/=``.

Each step of each selector is a state. An element enters a state if it fits the step and an element in the place that the step is
joined to is in the state before; all states of an element are one number, so that an element costs a few operations on numbers
and the steps that its tag, id or classes call up, however many rules there are. As elements nest, the elements in
which an element lies are those still open, and the text of an element is what was read between its ends: what lies where is
known when an element closes, without a join. A page of several rules is parsed once, and states of other rules are never
entered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import dom

PART = "struct<role:string,pre:int,tag:string,text:string,own:string,attrs:map<string,string>>"
NODE = "struct<pre:int,post:int,tag:string,classes:array<string>,text:string>"
MARK = f"struct<role:string,pre:int,post:int,depth:int,tag:string,text:string,rest:string,own:string,attrs:map<string,string>,parts:array<{PART}>,nodes:array<{NODE}>>"
STRING, INT, ATTRS = pa.string(), pa.int32(), pa.map_(pa.string(), pa.string())
PART_TYPE = pa.struct([("role", STRING), ("pre", INT), ("tag", STRING), ("text", STRING), ("own", STRING), ("attrs", ATTRS)])
NODE_TYPE = pa.struct([("pre", INT), ("post", INT), ("tag", STRING), ("classes", pa.list_(STRING)), ("text", STRING)])
MARK_TYPE = pa.struct([("role", STRING), ("pre", INT), ("post", INT), ("depth", INT), ("tag", STRING), ("text", STRING), ("rest", STRING), ("own", STRING), ("attrs", ATTRS), ("parts", pa.list_(PART_TYPE)), ("nodes", pa.list_(NODE_TYPE))])
#: Elements whose content is not text of the page.
UNSEEN = {"script", "style", "template"}
STEP = re.compile(r"""\s*([>+~])\s*|(\s+)|(\*|[a-zA-Z][\w-]*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~/]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]""")
COMPARED = {
    "=": lambda own, value: own == value,
    "*=": lambda own, value: value in own,
    "^=": lambda own, value: own.startswith(value),
    "$=": lambda own, value: own.endswith(value),
    "~=": lambda own, value: value in own.split(),
    "/=": lambda own, value: re.search(value, own) is not None,
}


class Step:
    """What one element must have; ``join`` is how it stands to the element of the step before."""

    def __init__(self, join: str):
        self.join, self.tag, self.id, self.classes, self.attrs = join, "", "", [], []

    def fits(self, tag: str, attrs: dict[str, str], classes: list[str]) -> bool:
        if (self.tag and self.tag != tag) or (self.id and attrs.get("id") != self.id) or any(c not in classes for c in self.classes):
            return False
        return all(name in attrs and (not op or COMPARED[op](attrs[name], value)) for name, op, value in self.attrs)

    def key(self) -> tuple[str, str]:
        """What calls the step up: its rarest feature."""
        return ("#", self.id) if self.id else (".", self.classes[0]) if self.classes else ("[", self.attrs[0][0]) if self.attrs else ("", self.tag)


def steps_of(selector: str) -> list[list[Step]]:
    """The alternatives of a selector, each as its steps; raises for what isn't one."""
    out = []
    for one in re.split(r""",(?![^\[]*\])""", selector):
        one, at, steps, join = one.strip(), 0, [], " "
        opened = False
        while at < len(one):
            m = STEP.match(one, at)
            if not m:
                raise ValueError(f"not a selector: {selector}")
            at = m.end()
            if m[1] or m[2]:
                join, opened = m[1] or " ", False
                continue
            if not opened:
                steps.append(Step(join))
                opened = True
            step = steps[-1]
            if m[3]:
                step.tag = "" if m[3] == "*" else m[3].lower()
            elif m[4]:
                step.id = m[4]
            elif m[5]:
                step.classes.append(m[5])
            else:
                step.attrs.append((m[6].lower(), m[7] or "", next((v for v in m.groups()[7:] if v is not None), "")))
        if not steps:
            raise ValueError(f"not a selector: {selector!r}")
        out.append(steps)
    return out


class Automaton:
    """``rules`` maps a rule to its roles and their selectors."""

    def __init__(self, rules: dict[str, dict[str, str]]):
        self.called: dict[tuple[str, str], list[tuple[int, Step]]] = {}
        self.final: dict[int, tuple[str, str]] = {}
        self.of_rule: dict[str, int] = {}
        self.first = 0
        self.joined = dict.fromkeys(" >+~", 0)  # states after which a step follows by this join
        bit = 1
        for rule, roles in rules.items():
            for role, selector in roles.items():
                for steps in steps_of(selector):
                    for i, step in enumerate(steps):
                        self.called.setdefault(step.key(), []).append((bit, step))
                        self.of_rule[rule] = self.of_rule.get(rule, 0) | bit
                        if i == 0:
                            self.first |= bit
                        else:
                            self.joined[step.join] |= bit >> 1
                        if i == len(steps) - 1:
                            self.final[bit] = (rule, role)
                        bit <<= 1
        self.finals = sum(self.final)

    def fitting(self, tag: str, attrs: dict[str, str], allowed: int) -> int:
        """The states in ``allowed`` whose step the element fits."""
        out = 0
        classes = attrs.get("class", "").split()
        keys = [("", tag), ("", ""), *[(".", c) for c in classes], *[("[", a) for a in attrs]]
        if "id" in attrs:
            keys.append(("#", attrs["id"]))
        for key in keys:
            for bit, step in self.called.get(key, ()):
                if bit & allowed and not bit & out and step.fits(tag, attrs, classes):
                    out |= bit
        return out

    def marked(self, bits: int) -> Iterator[tuple[str, str]]:
        """(rule, role) of the selectors whose last step is among the states."""
        bits &= self.finals
        while bits:
            low = bits & -bits
            yield self.final[low]
            bits ^= low


class Marker(dom.Tree):
    """The tree of a page, with the states of its elements and the pieces of its text in order."""

    def __init__(self, automaton: Automaton, rules: list[str]):
        super().__init__()
        self.automaton = automaton
        self.live = 0
        for rule in rules:
            self.live |= automaton.of_rule.get(rule, 0)
        self.states: list[tuple[int, int]] = []  # of each element: its own, and with those of all above
        self.beside: dict[int, tuple[int, int]] = {}  # of each parent's last child, and of all its children so far
        self.pieces: list[str] = []
        self.spans: list[list[int]] = []  # of each element: the first piece, and the first one behind
        self.hits: list[int] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, attrs)
        at = len(self.rows) - 1
        row = self.rows[at]
        machine, parent = self.automaton, row[1]
        own_above, all_above = self.states[parent] if parent >= 0 else (0, 0)
        last, earlier = self.beside.get(parent, (0, 0))
        joined = machine.joined
        allowed = machine.first | (all_above & joined[" "]) << 1 | (own_above & joined[">"]) << 1 | (last & joined["+"]) << 1 | (earlier & joined["~"]) << 1
        own = machine.fitting(tag, dict(row[6]), allowed & self.live) if allowed & self.live else 0
        self.states.append((own, own | all_above))
        self.beside[parent] = (own, own | earlier)
        self.spans.append([len(self.pieces), len(self.pieces)])
        if own & machine.finals:
            self.hits.append(at)

    def shut(self) -> None:
        self.spans[self.open[-1]][1] = len(self.pieces)
        super().shut()

    def handle_data(self, data: str) -> None:
        super().handle_data(data)
        if self.open and (text := data.strip()) and self.rows[self.open[-1]][5] not in UNSEEN:
            self.pieces.append(text)

    def text(self, at: int, cut: list[int] = ()) -> str:
        """The element's text in document order, without that of the elements in ``cut``."""
        lo, hi = self.spans[at]
        out = []
        for part in sorted(cut):
            a, b = self.spans[part]
            if a > lo:
                out += self.pieces[lo:a]
            lo = max(lo, b)
        return " ".join(out + self.pieces[lo:hi])

    def nodes(self, at: int) -> list[dict]:
        """The element's children in order, each with its whole text; a text between them has no tag."""
        out, lo, child, (_, end) = [], self.spans[at][0], at + 1, self.spans[at]

        def said(until: int) -> None:
            out.extend({"pre": -1, "post": -1, "tag": "", "classes": [], "text": text} for text in self.pieces[lo:until])

        while child <= self.rows[at][3]:
            row = self.rows[child]
            said(self.spans[child][0])
            lo = self.spans[child][1]
            out.append({"pre": child, "post": row[3], "tag": row[5], "classes": dict(row[6]).get("class", "").split(), "text": self.text(child)})
            child = row[3] + 1
        said(end)
        return out

    def marks(self) -> dict[str, list[dict]]:
        """The marked elements of each rule, in order, with their marked parts; each inner element goes to all open ones that have a role for it."""
        out: dict[str, list[dict]] = {}
        open_: list[tuple[int, str, dict]] = []
        for at in self.hits:
            while open_ and self.rows[open_[-1][0]][3] < at:
                open_.pop()
            row, found = self.rows[at], list(dict.fromkeys(self.automaton.marked(self.states[at][0])))  # alternatives of one selector count once
            for rule, role in found:
                if "/" in role:
                    continue
                mark = {"role": role.lstrip("+"), "pre": at, "post": row[3], "depth": row[4], "tag": row[5], "own": " ".join(row[7]), "attrs": row[6], "parts": [], "cut": [], "nodes": self.nodes(at) if role.startswith("+") else None}
                out.setdefault(rule, []).append(mark)
                open_.append((at, rule, mark))
            for rule, role in found:
                if "/" not in role:
                    continue
                of, part = role.split("/")
                for top, its, mark in open_:
                    if its == rule and mark["role"] == of and at <= self.rows[top][3]:
                        mark["parts"].append({"role": part.lstrip("-"), "pre": at, "tag": row[5], "text": self.text(at), "own": " ".join(row[7]), "attrs": row[6]})
                        if part.startswith("-"):
                            mark["cut"].append(at)
        for found in out.values():
            for mark in found:
                mark["text"], mark["rest"] = self.text(mark["pre"]), self.text(mark["pre"], mark.pop("cut"))
        return out


def read(html: str, automaton: Automaton, rules: list[str]) -> dict[str, list[dict]]:
    page = Marker(automaton, rules)
    page.feed(html)
    page.finish()
    return page.marks()


#: The automaton that this worker process has compiled, by its rules.
COMPILED: dict[str, Automaton] = {}


def with_marks(pages: DataFrame, rules: dict[str, dict[str, str]], rules_col: str, html_col: str, name: str = "found") -> DataFrame:
    """``pages`` with ``name``: for each rule in a page's ``rules_col`` (array of names) the rule and what it marks, empty lists where that is nothing. Pages without a rule are not parsed."""
    key = repr(rules)

    def found(html: str | None, own: list[str] | None) -> list[dict]:
        if not own:
            return []
        if key not in COMPILED:
            COMPILED.clear()
            COMPILED[key] = Automaton(rules)
        own = list(dict.fromkeys(own))
        got = read(html or "", COMPILED[key], own)
        return [{"rule_id": rule, "marks": got.get(rule, [])} for rule in own]

    kind = pa.list_(pa.struct([("rule_id", STRING), ("marks", pa.list_(MARK_TYPE))]))
    return dom.with_read(pages, [html_col, rules_col], name, f"array<struct<rule_id:string,marks:array<{MARK}>>>", kind, found)
