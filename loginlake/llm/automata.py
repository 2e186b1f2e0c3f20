"""Byte automata: rule expressions to trees, subset construction, minimisation, transition arrays.

Expressions have literals, escapes (\\xHH, \\ before a sign), classes, groups, ``|``, ``?``,
``*``, ``+`` and ``{m}``, ``{m,}``, ``{m,n}``; they match bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Tree = tuple  # ("set", frozenset of bytes) | ("seq", parts) | ("alt", parts) | ("many", part)


def parse(rule: str, either_case: bool = False) -> Tree:
    """The tree of an expression; either_case lets ASCII letters match in both cases."""
    at = 0

    def both(codes: set[int]) -> Tree:
        if either_case:
            codes = codes | {ord(chr(c).swapcase()) for c in codes if c < 128 and chr(c).isalpha()}
        return "set", frozenset(codes)

    def sign() -> int:
        nonlocal at
        at += 1
        if rule[at - 1] != "\\":
            return ord(rule[at - 1])
        at += 1
        if rule[at - 1] == "x":
            at += 2
            return int(rule[at - 2 : at], 16)
        return ord(rule[at - 1])

    def one_class() -> Tree:
        nonlocal at
        codes: set[int] = set()
        while rule[at] != "]":
            first = last = sign()
            if rule[at] == "-" and rule[at + 1] != "]":
                at += 1
                last = sign()
            codes.update(range(first, last + 1))
        at += 1
        return both(codes)

    def repeated(part: Tree) -> Tree:
        nonlocal at
        while at < len(rule) and rule[at] in "?*+{":
            mark, at = rule[at], at + 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None), "{": (0, 0)}[mark]
            if mark == "{":
                bounds, at = rule[at : rule.index("}", at)].split(","), rule.index("}", at) + 1
                low, high = int(bounds[0]), int(bounds[-1]) if bounds[-1] else None
            rest = [("many", part)] if high is None else [("alt", (part, ("seq", ())))] * (high - low)
            part = "seq", (*[part] * low, *rest)
        return part

    def alternatives() -> Tree:
        nonlocal at
        found, parts = [], []
        while at < len(rule) and rule[at] != ")":
            if rule[at] == "|":
                at += 1
                found.append(("seq", tuple(parts)))
                parts = []
                continue
            if rule[at] == "(":
                at += 1
                part = alternatives()
                at += 1
            elif rule[at] == "[":
                at += 1
                part = one_class()
            else:
                part = both({sign()})
            parts.append(repeated(part))
        return "alt", (*found, ("seq", tuple(parts)))

    return alternatives()


def backwards(tree: Tree) -> Tree:
    """The tree that matches the reversed byte strings."""
    kind, inner = tree
    if kind == "set":
        return tree
    if kind == "many":
        return kind, backwards(inner)
    parts = tuple(backwards(x) for x in inner)
    return kind, parts[::-1] if kind == "seq" else parts


@dataclass
class Automaton:
    """table[state * 256 + byte] is the next state, itself times 256; the start is state 0.

    States from ``accepting`` on accept; marks gives their sets of tree numbers. ``dead`` is the
    state (times 256) without a way to accept, or -1."""

    table: list[int]
    accepting: int
    marks: dict[int, frozenset[int]]
    dead: int

    @property
    def states(self) -> int:
        return len(self.table) // 256

    def longest(self, body: bytes, start: int, end: int | None = None) -> int:
        """The end of the longest match that begins at start, or -1."""
        state, found, table, accepting, dead = 0, -1, self.table, self.accepting, self.dead
        if state >= accepting:
            found = start
        for i in range(start, len(body) if end is None else end):
            state = table[state + body[i]]
            if state >= accepting:
                found = i + 1
            elif state == dead:
                break
        return found


def compile_trees(trees: list[Tree], anywhere: bool) -> Automaton:
    """One automaton for all trees. anywhere: a match may begin at every byte."""
    empty: list[list[int]] = []  # moves without a byte
    moves: list[tuple[frozenset[int], int] | None] = []  # one move by a byte of a set

    def state() -> int:
        empty.append([])
        moves.append(None)
        return len(moves) - 1

    def add(tree: Tree, begin: int) -> int:
        """Adds the tree's states after begin; its last state."""
        kind, inner = tree
        if kind == "set":
            end = state()
            mid = state()
            empty[begin].append(mid)
            moves[mid] = (inner, end)
            return end
        if kind == "seq":
            for part in inner:
                begin = add(part, begin)
            return begin
        if kind == "alt":
            end = state()
            for part in inner:
                own = state()
                empty[begin].append(own)
                empty[add(part, own)].append(end)
            return end
        again = state()
        empty[begin].append(again)
        own = state()
        empty[again].append(own)
        empty[add(inner, own)].append(again)
        return again

    root = state()
    ends = {}
    for number, tree in enumerate(trees):
        own = state()
        empty[root].append(own)
        ends[add(tree, own)] = number

    def closed(some: set[int]) -> frozenset[int]:
        seen, todo = set(some), list(some)
        while todo:
            for x in empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if moves[x] is not None or x in ends)

    begin = closed({root})
    number, rows, order = {begin: 0}, [], [begin]
    for subset in order:  # grows while new subsets turn up
        targets: list[set[int]] = [set() for _ in range(256)]
        for x in subset:
            if moves[x] is not None:
                for b in moves[x][0]:
                    targets[b].add(moves[x][1])
        closures: dict[frozenset[int], frozenset[int]] = {}
        row = []
        for some in map(frozenset, targets):
            if some not in closures:
                closures[some] = closed(set(some)) | (begin if anywhere else frozenset())
            after = closures[some]
            if after not in number:
                number[after] = len(order)
                order.append(after)
            row.append(number[after])
        rows.append(row)
    table = np.array(rows)
    marked = [frozenset(ends[x] for x in subset if x in ends) for subset in order]

    kinds = {m: i for i, m in enumerate(dict.fromkeys(marked))}
    group = np.array([kinds[m] for m in marked])
    while True:  # states stay together while all their moves lead to the same groups
        _, finer = np.unique(np.column_stack((group, group[table])), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    first = {g: int(np.flatnonzero(group == g)[0]) for g in range(group.max() + 1)}
    accepts = [g for g in first if marked[first[g]]]
    start = int(group[0])
    ranked = [start] * (start not in accepts) + [g for g in first if g not in accepts and g != start]
    limit = len(ranked)
    ranked += [start] * (start in accepts) + [g for g in accepts if g != start]
    place = np.empty(len(ranked), int)
    place[ranked] = np.arange(len(ranked))
    least = np.array([place[group[table[first[g]]]] for g in ranked])
    if start in accepts and limit:
        raise ValueError("a rule that matches nothing at all cannot be numbered from its start")
    dead = next((i * 256 for i in range(limit) if (least[i] == i).all()), -1)
    return Automaton(
        (least * 256).ravel().tolist(), limit * 256, {i * 256: marked[first[g]] for i, g in enumerate(ranked) if i >= limit}, dead
    )
