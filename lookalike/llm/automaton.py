"""One automaton for many rules: syntax trees to a minimal table of moves.

``combined`` builds a non-deterministic automaton for all rules, each free to
start anywhere, makes it deterministic by the subset construction over classes
of equal bytes, and merges states that no text tells apart.
"""

from __future__ import annotations

import re
from collections import defaultdict
from re import _parser as syntax


class Moves:
    """A deterministic automaton over bytes.

    ``table[state + byte]`` is the next state. States are multiples of 256, and
    those from ``accepting`` on end a match of the rules in
    ``accepts[state >> 8]``, a bit per rule. ``dead`` is never left.
    """

    def __init__(self, table: list[int], accepts: list[int], start: int, dead: int | None):
        self.table, self.accepts, self.start, self.dead = table, accepts, start, dead
        self.accepting = 256 * accepts.count(0)

    def rules_in(self, data: bytes) -> int:
        """The rules that match somewhere in ``data``, in one pass over it."""
        table, accepts, accepting = self.table, self.accepts, self.accepting
        state, found = self.start, 0
        for byte in data:
            state = table[state + byte]
            if state >= accepting:
                found |= accepts[state >> 8]
        return found

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match that begins at ``start``, or -1."""
        table, accepting, dead = self.table, self.accepting, self.dead
        state = self.start
        end = start if state >= accepting else -1
        for at in range(start, len(data)):
            state = table[state + data[at]]
            if state == dead:
                break
            if state >= accepting:
                end = at + 1
        return end


class _Graph:
    def __init__(self):
        self.free = defaultdict(set)  # moves without a byte
        self.moves = defaultdict(list)  # (set of bytes, next)
        self.size = 0

    def node(self) -> int:
        self.size += 1
        return self.size - 1

    def add(self, tree, start: int) -> int:
        """Lay ``tree`` from ``start`` and return where it ends."""
        for op, arg in tree:
            name = str(op)
            if name in ("LITERAL", "IN", "NOT_LITERAL", "ANY"):
                end = self.node()
                self.moves[start].append((_bytes_of(name, arg), end))
                start = end
            elif name == "SUBPATTERN":
                start = self.add(arg[3], start)
            elif name == "BRANCH":
                end = self.node()
                for option in arg[1]:
                    self.free[self.add(option, start)].add(end)
                start = end
            elif name == "MAX_REPEAT":
                low, high, body = arg
                for _ in range(low):
                    start = self.add(body, start)
                end = self.node()
                self.free[start].add(end)
                if high is syntax.MAXREPEAT:
                    self.free[self.add(body, end)].add(end)
                else:
                    for _ in range(high - low):
                        start = self.add(body, start)
                        self.free[start].add(end)
                start = end
            else:
                raise ValueError(f"a rule cannot use {name}")
        return start

    def closed(self, nodes) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for nxt in self.free[todo.pop()] - seen:
                seen.add(nxt)
                todo.append(nxt)
        return frozenset(seen)


def _bytes_of(name: str, arg) -> frozenset[int]:
    if name == "ANY":
        return frozenset(range(256)) - {10}
    if name != "IN":
        arg = [("LITERAL", arg)] if name == "LITERAL" else [("NEGATE", None), ("LITERAL", arg)]
    found, negated = set(), False
    for op, value in arg:
        kind = str(op)
        if kind == "NEGATE":
            negated = True
        elif kind == "LITERAL":
            found.add(value)
        elif kind == "RANGE":
            found.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"a rule cannot use {kind}")
    return frozenset(range(256)) - found if negated else frozenset(found)


def combined(patterns: list[bytes], anywhere: bool = True) -> Moves:
    """Automaton for all ``patterns`` at once.

    ``anywhere``: a match may begin at any byte (to learn where matches end);
    otherwise at the first byte only (to measure one match).
    """
    graph = _Graph()
    start, ends = graph.node(), {}
    for rule, pattern in enumerate(patterns):
        first = graph.node()
        graph.free[start].add(first)
        ends[graph.add(syntax.parse(pattern), first)] = 1 << rule
    if anywhere:
        graph.moves[start].append((frozenset(range(256)), start))

    # bytes that no rule tells apart move alike
    signature = defaultdict(list)
    sets = sorted({s for m in graph.moves.values() for s, _ in m}, key=sorted)
    for byte in range(256):
        signature[tuple(byte in s for s in sets)].append(byte)
    classes = list(signature.values())

    # subset construction
    states, rows = {graph.closed([start]): 0}, []
    order = list(states)
    while len(rows) < len(order):
        here, row = order[len(rows)], []
        for group in classes:
            reached = {n for node in here for s, n in graph.moves[node] if group[0] in s}
            nxt = graph.closed(reached)
            if nxt not in states:
                states[nxt] = len(order)
                order.append(nxt)
            row.append(states[nxt])
        rows.append(row)
    accepts = [sum({bit for node, bit in ends.items() if node in s}) for s in order]

    # minimisation: split blocks until their members move alike
    block = accepts
    while True:
        keys = [(block[i], *(block[j] for j in row)) for i, row in enumerate(rows)]
        names = {}
        fresh = [names.setdefault(k, len(names)) for k in keys]
        if len(names) == len(set(block)):
            break
        block = fresh
    # number the blocks, those that accept last
    first = {}
    for i, b in enumerate(block):
        first.setdefault(b, i)
    ranked = sorted(first, key=lambda b: accepts[first[b]] > 0)
    place = {b: 256 * k for k, b in enumerate(ranked)}
    table, found = [], []
    for b in ranked:
        moves = [0] * 256
        for group, j in zip(classes, rows[first[b]]):
            for byte in group:
                moves[byte] = place[block[j]]
        table += moves
        found.append(accepts[first[b]])
    dead = next((p for p in place.values() if not found[p >> 8] and set(table[p : p + 256]) == {p}), None)
    return Moves(table, found, place[block[0]], dead)


def letters_in_either_case(word: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", word)
