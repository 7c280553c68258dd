"""Rules as one deterministic automaton: subset construction, minimisation, transition arrays.

Patterns use a small regular language: literals, classes ``[...]``, groups, ``|``, ``?``, ``*``, ``+`` and
``{n}`` or ``{n,}``, all over bytes. The rules are compiled twice into shared transition arrays:

* reversed, behind any bytes, all rules together: one pass over the bytes from the end marks every place
  where a match of a rule starts;
* forward and anchored, all rules together: from the leftmost mark of a rule it finds the longest match,
  and the next mark beyond it follows.

Both are linear in the bytes, whatever the rules. A match is the leftmost, then longest one; matches of one
rule do not overlap, those of different rules may.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

ALL = frozenset(range(256))


# --- patterns --------------------------------------------------------------------------------------


def _parse_class(text: str, at: int) -> tuple[frozenset[int], int]:
    negated = text[at] == "^"
    at += negated
    found: set[int] = set()
    first = True
    while first or text[at] != "]":
        first = False
        low, at = _char(text, at)
        if text[at] == "-" and text[at + 1] != "]":
            high, at = _char(text, at + 1)
            found |= set(range(low, high + 1))
        else:
            found.add(low)
    return (ALL - found if negated else frozenset(found)), at + 1


def _char(text: str, at: int) -> tuple[int, int]:
    if text[at] != "\\":
        return ord(text[at]), at + 1
    if text[at + 1] == "x":
        return int(text[at + 2 : at + 4], 16), at + 4
    return ord({"n": "\n", "r": "\r", "t": "\t"}.get(text[at + 1], text[at + 1])), at + 2


class _Parser:
    """Pattern to a tree of ("set", bytes), ("cat", parts), ("alt", parts) and ("rep", part, least, endless)."""

    def __init__(self, text: str, any_case: bool):
        self.text, self.at, self.any_case = text, 0, any_case

    def tree(self):
        node = self.either()
        if self.at != len(self.text):
            raise ValueError(f"pattern not understood at {self.at}: {self.text!r}")
        return node

    def either(self):
        parts = [self.row()]
        while self.text[self.at : self.at + 1] == "|":
            self.at += 1
            parts.append(self.row())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def row(self):
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def atom(self):
        c = self.text[self.at]
        if c == "(":
            self.at += 3 if self.text.startswith("(?:", self.at) else 1
            node = self.either()
            self.at += 1
            return node
        if c == "[":
            found, self.at = _parse_class(self.text, self.at + 1)
        elif c == ".":
            found, self.at = ALL - {10}, self.at + 1
        else:
            one, self.at = _char(self.text, self.at)
            found = frozenset([one])
        if self.any_case:
            letters = {b for b in found if chr(b).isascii() and chr(b).isalpha()}
            found |= {b ^ 32 for b in letters}
        return ("set", found)

    def repeated(self, node):
        while self.at < len(self.text) and self.text[self.at] in "?*+{":
            c = self.text[self.at]
            self.at += 1
            if c == "?":
                node = ("alt", [node, ("cat", [])])
            elif c in "*+":
                node = ("rep", node, int(c == "+"), True)
            else:
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                if high:
                    extra = ("alt", [node, ("cat", [])])
                    node = ("cat", [node] * int(low) + [extra] * (int(high) - int(low)))
                else:
                    node = ("rep", node, int(low), bool(comma))
        return node


def _reversed(node):
    if node[0] == "cat":
        return ("cat", [_reversed(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [_reversed(x) for x in node[1]])
    if node[0] == "rep":
        return ("rep", _reversed(node[1]), *node[2:])
    return node


# --- automata --------------------------------------------------------------------------------------


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.on: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append(None)
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """Put a tree behind a state; the state where it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            middle = self.state()
            self.free[start].append(middle)
            self.on[middle] = (node[1], end)
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                self.free[self.add(part, start)].append(end)
            return end
        for _ in range(node[2]):
            start = self.add(node[1], start)
        if node[3]:
            loop, end = self.state(), self.state()
            self.free[start].append(loop)
            self.free[loop].append(end)
            self.free[self.add(node[1], loop)].append(loop)
            return end
        return start

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Dfa(NamedTuple):
    """``step[state][byte]`` is the next state; ``accepts[state]`` has bit k set if rule k matches; 0 is the start."""

    step: list[list[int]]
    accepts: list[int]


def _byte_classes(nfa: _Nfa) -> tuple[list[int], list[int]]:
    """A class for each byte, bytes of a class being alike to all rules; one byte of each class."""
    sets = list({on[0] for on in nfa.on if on})
    signs: dict[tuple[bool, ...], int] = {}
    classes, samples = [], []
    for b in range(256):
        sign = tuple(b in s for s in sets)
        if sign not in signs:
            signs[sign] = len(samples)
            samples.append(b)
        classes.append(signs[sign])
    return classes, samples


def compile_rules(trees: list, anywhere: bool) -> Dfa:
    """One minimal automaton of all rules; with ``anywhere`` a match may begin at any byte read."""
    nfa = _Nfa()
    root = nfa.state()
    ends = [nfa.add(tree, root) for tree in trees]
    rule_of = {end: 1 << k for k, end in enumerate(ends)}
    classes, samples = _byte_classes(nfa)
    start = nfa.closure({root})
    found, order, rows = {start: 0}, [start], []
    for states in order:
        row = []
        for b in samples:
            target = {nfa.on[s][1] for s in states if nfa.on[s] and b in nfa.on[s][0]}
            target = nfa.closure(target | ({root} if anywhere else set()))
            if target not in found:
                found[target] = len(order)
                order.append(target)
            row.append(found[target])
        rows.append(row)
    accepts = [sum(rule_of.get(s, 0) for s in states) for states in order]
    return _minimal(rows, accepts, classes)


def _minimal(rows: list[list[int]], accepts: list[int], classes: list[int]) -> Dfa:
    """Merge states that no input tells apart, by refining the partition until it is stable."""
    block, n = list(accepts), 0
    while True:
        signs: dict[tuple, int] = {}
        new = [signs.setdefault((block[i], *[block[j] for j in row]), len(signs)) for i, row in enumerate(rows)]
        if len(signs) == n:
            break
        block, n = new, len(signs)
    first = {}
    for i, b in enumerate(block):
        first.setdefault(b, i)
    step = [[block[rows[first[b]][c]] for c in classes] for b in range(n)]
    return Dfa(step, [accepts[first[b]] for b in range(n)])


class Scanner:
    """All rules over bytes: spans of each rule, leftmost and longest, in one backward pass plus the matches."""

    def __init__(self, rules: Mapping[str, tuple[str, bool]]):
        """``rules``: name to (pattern, letters in either case)."""
        self.names = list(rules)
        trees = [_Parser(pattern, any_case).tree() for pattern, any_case in rules.values()]
        back = compile_rules([_reversed(t) for t in trees], anywhere=True)
        self.forward = compile_rules(trees, anywhere=False)
        self.states = len(back.step), len(self.forward.step)
        # rows that hold each other: one list access per byte; place 256 has the rules that start here
        self._rows: list[list] = [[None] * 257 for _ in back.step]
        for row, targets, rule in zip(self._rows, back.step, back.accepts, strict=True):
            for b, target in enumerate(targets):
                row[b] = self._rows[target]
            row[256] = rule
        self._dead = self._find_dead()

    def _find_dead(self) -> int:
        step, accepts = self.forward
        return next((i for i, row in enumerate(step) if not accepts[i] and all(t == i for t in row)), -1)

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(place, rules that have a match starting there), from the end of the data to its beginning."""
        row, out, at = self._rows[0], [], len(data)
        for b in reversed(data):
            row = row[b]
            at -= 1
            if row[256]:
                out.append((at, row[256]))
        return out

    def end(self, data: bytes, at: int, rule: int) -> int:
        """Where the longest match of a rule from a place ends; -1 without one."""
        step, accepts, dead = self.forward.step, self.forward.accepts, self._dead
        state, best = 0, -1
        for i in range(at, len(data)):
            state = step[state][data[i]]
            if state == dead:
                break
            if accepts[state] & rule:
                best = i + 1
        return best

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(rule, start, end) in bytes, by start and then in the order of the rules."""
        free, out = [0] * len(self.names), []
        for at, rules in reversed(self.starts(data)):
            for k, name in enumerate(self.names):
                if rules >> k & 1 and at >= free[k]:
                    free[k] = self.end(data, at, 1 << k)
                    out.append((name, at, free[k]))
        return out
