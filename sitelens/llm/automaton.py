"""Rules compiled into one deterministic automaton over bytes, and its scan with numpy.

Rules are regular expressions of literals, classes, groups, ``|``, ``?``, ``*``, ``+``
and counts. They become one NFA, the NFA a DFA by subset construction over classes of
bytes that no rule tells apart, and the DFA is minimised by refining partitions. What is
left are two arrays: the next state by state and class, and the rules that end in a state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

# Bytes scanned at once, the bytes of a lane, and how far a lane starts before its part.
CHUNK = 4 << 20
LANE = 2048
LEAD = 64


def parse(pattern: str, fold: bool = False) -> tuple:
    """The tree of an expression: ("set", bytes), ("cat", parts), ("alt", parts) or
    ("rep", part, least, most); ``fold`` lets letters match in either case."""
    text, at = pattern.encode(), 0

    def byte_set(values) -> tuple:
        found = set(values)
        if fold:
            found |= {v ^ 32 for v in found if chr(v).isascii() and chr(v).isalpha()}
        return ("set", frozenset(found))

    def literal() -> int:
        nonlocal at
        value = text[at]
        at += 1
        if value != 0x5C:
            return value
        value = text[at]
        at += 1
        if value == ord("x"):
            at += 2
            return int(text[at - 2 : at], 16)
        if chr(value).isalnum():
            raise ValueError(f"Escape \\{chr(value)} is not known in {pattern!r}")
        return value

    def one() -> tuple:
        nonlocal at
        if text[at] == ord("("):
            at += 1
            inner = either()
            if at >= len(text):
                raise ValueError(f"Open group in {pattern!r}")
            at += 1
            return inner
        if text[at] == ord("["):
            at += 1
            values: set[int] = set()
            while text[at] != ord("]"):
                low = high = literal()
                if text[at] == ord("-") and text[at + 1] != ord("]"):
                    at += 1
                    high = literal()
                values.update(range(low, high + 1))
            at += 1
            return byte_set(values)
        if text[at] in b"?*+{}.^$":
            raise ValueError(f"{chr(text[at])} has no meaning there in {pattern!r}")
        return byte_set([literal()])

    def many() -> tuple:
        nonlocal at
        found = one()
        while at < len(text) and text[at] in b"?*+{":
            sign = chr(text[at])
            at += 1
            if sign == "{":
                end = text.index(b"}", at)
                low, comma, high = text[at:end].decode().partition(",")
                at = end + 1
                found = ("rep", found, int(low), (int(high) if high else None) if comma else int(low))
            else:
                found = ("rep", found, int(sign == "+"), 1 if sign == "?" else None)
        return found

    def either() -> tuple:
        nonlocal at
        options, parts = [], []
        while at < len(text) and text[at] != ord(")"):
            if text[at] == ord("|"):
                at += 1
                options.append(("cat", parts))
                parts = []
            else:
                parts.append(many())
        options.append(("cat", parts))
        return options[0] if len(options) == 1 else ("alt", options)

    tree = either()
    if at != len(text):
        raise ValueError(f"Unopened group in {pattern!r}")
    return tree


def reversed_tree(tree: tuple) -> tuple:
    """The tree of the same words read from their ends."""
    kind = tree[0]
    if kind == "cat":
        return (kind, [reversed_tree(part) for part in reversed(tree[1])])
    if kind == "alt":
        return (kind, [reversed_tree(part) for part in tree[1]])
    if kind == "rep":
        return (kind, reversed_tree(tree[1]), *tree[2:])
    return tree


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []  # moves that read nothing
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Append ``tree`` behind ``start``; the state where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(part, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start)
            self.free[start].append(end)
        return end

    def closed(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for following in self.free[todo.pop()]:
                if following not in found:
                    found.add(following)
                    todo.append(following)
        return frozenset(found)


class Automaton(NamedTuple):
    """``moves[state * width + classes[byte]]`` is the next state; state 0 is the first.
    The last class is that of the gap between texts, which leads back to state 0.
    ``ends`` has bit r for each state in which rule r ends; ``dead`` is the state that
    nothing leaves, or -1."""

    classes: np.ndarray
    moves: np.ndarray
    ends: np.ndarray
    width: int
    dead: int


def build(trees: Sequence[tuple], anywhere: bool) -> Automaton:
    """The smallest automaton of some rules; ``anywhere`` lets a match begin at each byte."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {}
    for rule, tree in enumerate(trees):
        first = nfa.state()
        nfa.free[start].append(first)
        ends[nfa.add(tree, first)] = rule
    if anywhere:
        nfa.moves[start].append((frozenset(range(256)), start))

    # Bytes that no set tells apart are one class.
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    told = np.zeros((256, max(1, len(sets))), bool)
    for k, values in enumerate(sets):
        told[sorted(values), k] = True
    kinds, classes = np.unique(told, axis=0, return_inverse=True)
    classes = classes.reshape(-1)
    first_byte = [int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))]

    begin = nfa.closed([start])
    known, rows, todo = {begin: 0}, [], [begin]
    for states in todo:  # grows while it is read
        row = []
        for byte in first_byte:
            reached = nfa.closed([to for s in states for values, to in nfa.moves[s] if byte in values])
            if reached not in known:
                known[reached] = len(known)
                todo.append(reached)
            row.append(known[reached])
        rows.append([*row, 0])  # the gap
    moves = np.array(rows, np.int64)
    accept = np.array([sum(1 << ends[s] for s in states if s in ends) for states in todo], np.int64)

    # Minimisation: states stay together while all their moves lead to the same parts.
    part = np.unique(accept, return_inverse=True)[1].reshape(-1)
    while True:
        signature = np.column_stack([part, part[moves]])
        finer = np.unique(signature, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    order = np.full(part.max() + 1, -1)
    order[part[0]] = 0
    order[order < 0] = np.arange(1, len(order))
    part = order[part]
    where = np.zeros(len(order), np.int64)
    where[part] = np.arange(len(part))
    small = part[moves[where]]
    stuck = (small[:, :-1] == np.arange(len(small))[:, None]).all(axis=1) & (accept[where] == 0)
    dead = int(np.flatnonzero(stuck)[0]) if stuck.any() and not anywhere else -1
    width = small.shape[1]
    return Automaton(classes.astype(np.uint8), small.reshape(-1), accept[where], width, dead)


def scan(automaton: Automaton, classes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, rules) wherever rules end, for one pass over an array of byte classes.

    The array is cut into lanes that advance together, a byte of each at a time. A lane
    starts in the state that some bytes before it lead to from the first state; where that
    is not the state in which the lane before it ended, the lane is read again from there,
    so the result is that of one pass from the start.
    """
    width = automaton.width
    size = len(automaton.moves)
    kind = np.uint16 if size <= 1 << 16 else np.int32
    steps = (automaton.moves * width).astype(kind)  # states stand for the start of their row
    hit = np.zeros(size, automaton.ends.dtype)
    hit[::width] = automaton.ends
    carried = kind(0)
    for low in range(0, len(classes), CHUNK):
        piece = classes[low : low + CHUNK]
        lanes = -(-len(piece) // LANE)
        padded = np.full(lanes * LANE, width - 1, np.uint8)
        padded[: len(piece)] = piece
        columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
        states = np.zeros((LANE, lanes), kind)

        def run(first: np.ndarray, columns: np.ndarray, keep: np.ndarray | None) -> np.ndarray:
            state = first
            for at in range(len(columns)):
                state = steps[state + columns[at]]
                if keep is not None:
                    keep[at] = state
            return state

        first = run(np.zeros(lanes, kind), np.roll(columns[-LEAD:], 1, axis=1), None)
        first[0] = carried
        last = run(first, columns, states)
        while len(wrong := np.flatnonzero(first[1:] != last[:-1]) + 1):
            first[wrong] = last[wrong - 1]
            again = np.zeros((LANE, len(wrong)), kind)
            last[wrong] = run(first[wrong], columns[:, wrong], again)
            states[:, wrong] = again
        # The padding of the last lane leads to state 0; only what was read counts.
        flat = states.T.reshape(-1)[: len(piece)]
        carried = flat[-1]
        rules = hit[flat]
        where = np.flatnonzero(rules)
        if len(where):
            yield where + low, rules[where]


class Anchored:
    """One expression matched from a given byte on."""

    def __init__(self, tree: tuple) -> None:
        automaton = build([tree], anywhere=False)
        self.classes = automaton.classes.tobytes()
        self.moves = automaton.moves.tolist()
        self.ends = (automaton.ends > 0).tolist()
        self.width, self.dead = automaton.width, automaton.dead

    def longest(self, text: bytes, start: int) -> int:
        """End of the longest match that begins at ``start``, or ``start``."""
        classes, moves, ends, width, dead = self.classes, self.moves, self.ends, self.width, self.dead
        state, end = 0, start
        for at in range(start, len(text)):
            state = moves[state * width + classes[text[at]]]
            if state == dead:
                break
            if ends[state]:
                end = at + 1
        return end
