"""Rule patterns compiled into one deterministic byte automaton.

A pattern is parsed into a Thompson automaton over bytes. For each rule, subset construction runs on
*ordered* lists of disjoint state sets, oldest start first, which makes the automaton find leftmost
matches and take the longest end. The rules' automata then run side by side as one, whose states are
merged by partition refinement. A state tells which rules had a match end just before the byte that led
there. Rules must be of the kind where an accepted match stays accepted until it dies; others are
refused when compiled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Nfa:
    """States are numbers; ``moves[s]`` holds (byte set, target), ``free[s]`` targets without a byte."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({t for s in states for on, t in self.moves[s] if byte in on})


class _Parser:
    """Literals, ``[...]``, ``\\xNN`` and escapes, groups, ``(?i:...)`` for ASCII letters, ``|`` and ``? * + {m} {m,} {m,n}``."""

    def __init__(self, pattern: str) -> None:
        self.text, self.at, self.fold = pattern, 0, False

    def tree(self):
        out = self._either()
        if self.at != len(self.text):
            raise ValueError(f"unbalanced pattern: {self.text!r}")
        return out

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _either(self):
        arms = [self._row()]
        while self._peek() == "|":
            self.at += 1
            arms.append(self._row())
        return ("or", arms) if len(arms) > 1 else arms[0]

    def _row(self):
        parts = []
        while self._peek() not in ("", "|", ")"):
            parts.append(self._times(self._one()))
        return ("row", parts)

    def _times(self, item):
        while (c := self._peek()) and c in "?*+{":
            self.at += 1
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                item = ("times", item, int(low), int(high) if high else None if comma else int(low))
            else:
                item = ("times", item, int(c == "+"), 1 if c == "?" else None)
        return item

    def _escape(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "t": "\t"}.get(c, c))

    def _folded(self, on: set[int]) -> frozenset[int]:
        if self.fold:
            on |= {b ^ 32 for b in on if chr(b & 223).isalpha() and b < 128}
        return frozenset(on)

    def _one(self):
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            kept, self.fold = self.fold, self.fold or self.text.startswith("?i:", self.at)
            self.at += 3 if self.text.startswith("?i:", self.at) else 0
            out = self._either()
            if self._peek() != ")":
                raise ValueError(f"unbalanced pattern: {self.text!r}")
            self.at += 1
            self.fold = kept
            return out
        if c == "[":
            on: set[int] = set()
            while (c := self.text[self.at]) != "]":
                self.at += 1
                low = self._escape() if c == "\\" else ord(c)
                if self._peek() == "-" and self.text[self.at + 1] != "]":
                    self.at += 2
                    high = self.text[self.at - 1]
                    on.update(range(low, (self._escape() if high == "\\" else ord(high)) + 1))
                else:
                    on.add(low)
            self.at += 1
            return ("byte", self._folded(on))
        return ("byte", self._folded({self._escape() if c == "\\" else ord(c)}))


def _build(nfa: _Nfa, tree, start: int, backwards: bool) -> int:
    """Adds what ``tree`` accepts after ``start``; gives the state at its end."""
    kind = tree[0]
    if kind == "byte":
        end = nfa.state()
        nfa.moves[start].append((tree[1], end))
        return end
    if kind == "row":
        for part in reversed(tree[1]) if backwards else tree[1]:
            start = _build(nfa, part, start, backwards)
        return start
    if kind == "or":
        end = nfa.state()
        for arm in tree[1]:
            nfa.free[_build(nfa, arm, start, backwards)].append(end)
        return end
    _, item, low, high = tree
    for _ in range(low):
        start = _build(nfa, item, start, backwards)
    end = nfa.state()
    if high is None:
        loop = nfa.state()
        nfa.free[start].append(loop)
        nfa.free[_build(nfa, item, loop, backwards)].append(loop)
        nfa.free[loop].append(end)
    else:
        nfa.free[start].append(end)
        for _ in range(high - low):
            start = _build(nfa, item, start, backwards)
            nfa.free[start].append(end)
    return end


class _Rule:
    """One rule's automaton over ordered start sets, made as it is walked."""

    def __init__(self, pattern: str) -> None:
        tree = _Parser(pattern).tree()
        self.ahead, self.back = _Nfa(), _Nfa()
        first = self.ahead.state()
        self.end = _build(self.ahead, tree, first, False)
        self.first = self.ahead.closure({first})
        last = self.back.state()
        self.back_end = _build(self.back, tree, last, True)
        self.back_first = self.back.closure({last})
        if self.end in self.first:
            raise ValueError(f"matches the empty text: {pattern!r}")
        self.pattern = pattern

    def sets(self) -> list[frozenset[int]]:
        return [on for nfa in (self.ahead, self.back) for row in nfa.moves for on, _ in row]

    def step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        """The next state, and whether a match ended just before this byte. A state: the start sets, and whether the one set has accepted."""
        starts, accepted = state
        if accepted:
            moved = self.ahead.step(starts[0], byte)
            if moved:
                if self.end not in moved:
                    raise ValueError(f"a match of {self.pattern!r} can be lost again")
                return ((moved,), True), False
            return self.step(((), False), byte)[0], True
        out, seen = [], frozenset()
        for s in (*starts, self.first):
            if moved := self.ahead.step(s, byte) - seen:
                out.append(moved)
                seen |= moved
                if self.end in moved:
                    if len(out) > 1:
                        raise ValueError(f"a later match of {self.pattern!r} can end before an earlier one")
                    return ((moved,), True), False
        return (tuple(out), False), False

    def start_of(self, data: bytes, low: int, end: int) -> int:
        """The first place from ``low`` on from which the rule matches up to ``end``."""
        states, best = self.back_first, -1
        for i in range(end - 1, low - 1, -1):
            if not (states := self.back.step(states, data[i])):
                break
            if self.back_end in states:
                best = i
        return best


@dataclass
class Automaton:
    """``table[state, class]`` is the next state; ``ended`` and ``open`` are bit masks of rules by state."""

    patterns: tuple[str, ...]
    classes: bytes
    table: np.ndarray
    ended: np.ndarray
    open: np.ndarray

    def __post_init__(self) -> None:
        self.rules = [_Rule(p) for p in self.patterns]
        width = self.table.shape[1]
        # The rows hold one another, so that a step is one index; behind a row's classes stand its mask and number.
        self.rows = [[None] * width + [int(m), i] for i, m in enumerate(self.ended)]
        for row, to in zip(self.rows, self.table.tolist()):
            row[:width] = [self.rows[t] for t in to]
        self.width = width

    def __reduce__(self):
        return Automaton, (self.patterns, self.classes, self.table, self.ended, self.open)

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, mask of rules) of all matches, in one pass over the bytes."""
        row, mask, out = self.rows[0], self.width, []
        for i, c in enumerate(data.translate(self.classes)):
            row = row[c]
            if row[mask]:
                out.append((i, row[mask]))
        if last := int(self.open[row[mask + 1]]):
            out.append((len(data), last))
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) of each rule's leftmost non-overlapping matches, in order of their ends."""
        out, low = [], [0] * len(self.rules)
        for end, mask in self.ends(data):
            for k, rule in enumerate(self.rules):
                if mask >> k & 1:
                    out.append((k, rule.start_of(data, low[k], end), end))
                    low[k] = end
        return out


def compile_rules(patterns: list[str], most: int = 200_000) -> Automaton:
    """The automaton of all rules at once, with as few states as they need."""
    rules = [_Rule(p) for p in patterns]
    kinds: dict[tuple, int] = {}
    sets = [on for r in rules for on in r.sets()]
    classes = bytes(kinds.setdefault(tuple(b in on for on in sets), len(kinds)) for b in range(256))
    sample = [classes.index(k) for k in range(len(kinds))]
    memo: list[dict] = [{} for _ in rules]

    def step(k: int, state: tuple, byte: int):
        if (key := (state, byte)) not in memo[k]:
            memo[k][key] = rules[k].step(state, byte)
        return memo[k][key]

    start = (tuple(((), False) for _ in rules), 0)
    number, order, table = {start: 0}, [start], []
    for states, _ in order:
        row = []
        for byte in sample:
            moved = [step(k, s, byte) for k, s in enumerate(states)]
            to = (tuple(m[0] for m in moved), sum(m[1] << k for k, m in enumerate(moved)))
            if to not in number:
                if len(order) >= most:
                    raise ValueError(f"the rules need over {most} states")
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        table.append(row)
    table = np.array(table, dtype=np.int32)
    ended = np.array([m for _, m in order])
    open_ = np.array([sum(s[1] << k for k, s in enumerate(states)) for states, _ in order])
    part = np.unique(np.stack([ended, open_], 1), axis=0, return_inverse=True)[1].ravel()
    while True:  # until no class of states splits
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    # States are numbered as first met, so the start stays 0.
    _, first = np.unique(part, return_index=True)
    rank = np.empty(len(first), dtype=np.int32)
    rank[np.argsort(first)] = np.arange(len(first))
    keep = np.sort(first)
    return Automaton(tuple(patterns), classes, rank[part[table[keep]]], ended[keep], open_[keep])
