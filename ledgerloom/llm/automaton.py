"""Byte patterns as one minimal deterministic automaton, run over many texts at once.

Patterns know literals, escapes, classes, groups, ``|`` and the repeats ``? * + {m} {m,} {m,n}``.  All
patterns are compiled together: Thompson fragments, subset construction over classes of equivalent bytes,
then minimisation by refinement.  The result is a transition array; a state carries the set of patterns
that end there.  The automaton looks for matches anywhere, so one pass finds where any pattern has ended.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ANY = (1 << 256) - 1


def _bytes_of(chars: str) -> int:
    mask = 0
    for c in chars:
        mask |= 1 << ord(c)
    return mask


def _fold(mask: int) -> int:
    out = mask
    for c in range(65, 91):
        if mask >> c & 1 or mask >> (c + 32) & 1:
            out |= 1 << c | 1 << (c + 32)
    return out


class _Fragments:
    """An automaton with empty moves, grown pattern by pattern."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def compile(self, pattern: str, ignore_case: bool) -> tuple[int, int]:
        at = 0

        def byte_set() -> int:
            nonlocal at
            at += 1
            negate = pattern[at] == "^"
            at += negate
            mask, first = 0, True
            while pattern[at] != "]" or first:
                low = one()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    mask |= sum(1 << c for c in range(low, one() + 1))
                else:
                    mask |= 1 << low
                first = False
            at += 1
            return _ANY & ~mask if negate else mask

        def one() -> int:
            nonlocal at
            if pattern[at] != "\\":
                at += 1
                return ord(pattern[at - 1])
            if pattern[at + 1] == "x":
                at += 4
                return int(pattern[at - 2 : at], 16)
            at += 2
            return ord(pattern[at - 1])

        def either():
            nonlocal at
            options = [series()]
            while at < len(pattern) and pattern[at] == "|":
                at += 1
                options.append(series())
            if len(options) == 1:
                return options[0]
            return lambda: join(*[make() for make in options])

        def join(*made) -> tuple[int, int]:
            start, end = self.state(), self.state()
            for a, b in made:
                self.empty[start].append(a)
                self.empty[b].append(end)
            return start, end

        def series():
            nonlocal at
            parts = []
            while at < len(pattern) and pattern[at] not in "|)":
                parts.append(repeated())

            def make() -> tuple[int, int]:
                start = end = self.state()
                for part in parts:
                    a, b = part()
                    self.empty[end].append(a)
                    end = b
                return start, end

            return make

        def repeated():
            nonlocal at
            if pattern[at] == "(":
                at += 3 if pattern.startswith("(?:", at) else 1
                part = either()
                at += 1
            else:
                mask = byte_set() if pattern[at] == "[" else 1 << one()
                mask = _fold(mask) if ignore_case else mask

                def part(mask=mask) -> tuple[int, int]:
                    start, end = self.state(), self.state()
                    self.moves[start] = (mask, end)
                    return start, end

            low, high = 1, 1
            if at < len(pattern) and pattern[at] in "?*+":
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[at]]
                at += 1
            elif at < len(pattern) and pattern[at] == "{":
                close = pattern.index("}", at)
                bounds = pattern[at + 1 : close].split(",")
                low, high = int(bounds[0]), int(bounds[-1]) if bounds[-1] else None
                at = close + 1
            if (low, high) == (1, 1):
                return part

            def make() -> tuple[int, int]:
                start = end = self.state()
                for _ in range(low):
                    a, b = part()
                    self.empty[end].append(a)
                    end = b
                if high is None:
                    a, b = part()
                    back = self.state()
                    self.empty[end].append(back)
                    self.empty[back].append(a)
                    self.empty[b].append(back)
                    return start, back
                last = self.state()
                self.empty[end].append(last)
                for _ in range(high - low):
                    a, b = part()
                    self.empty[end].append(a)
                    self.empty[b].append(last)
                    end = b
                return start, last

            return make

        made = either()()
        if at != len(pattern):
            raise ValueError(f"pattern not understood from {pattern[at:]!r}")
        return made


@dataclass
class Automaton:
    """``table[state * classes + class_of[byte]]`` is the next state times ``classes``; 0 is the start.

    States from ``first_end`` on are ends; ``ends`` holds their patterns as a set of bits.
    """

    class_of: np.ndarray
    table: np.ndarray
    classes: int
    first_end: int
    ends: np.ndarray

    @classmethod
    def of(cls, patterns: list[tuple[str, bool]]) -> Automaton:
        """Compile (pattern, ignore case) pairs; the i-th pattern is bit i."""
        grown = _Fragments()
        made = [grown.compile(p, fold) for p, fold in patterns]
        masks = sorted({m[0] for m in grown.moves if m})
        kinds: dict[tuple[bool, ...], int] = {}
        class_of = np.zeros(256, dtype=np.uint8)
        for b in range(256):
            class_of[b] = kinds.setdefault(tuple(bool(m >> b & 1) for m in masks), len(kinds))
        holds = {m: [c for key, c in kinds.items() if key[i]] for i, m in enumerate(masks)}

        reach: dict[int, frozenset[int]] = {}

        def closure(state: int) -> frozenset[int]:
            if state not in reach:
                seen, todo = {state}, [state]
                while todo:
                    for x in grown.empty[todo.pop()]:
                        if x not in seen:
                            seen.add(x)
                            todo.append(x)
                ends = {b for _, b in made}
                reach[state] = frozenset(x for x in seen if grown.moves[x] or x in ends)
            return reach[state]

        start = frozenset().union(*[closure(a) for a, _ in made])
        names, order, rows = {start: 0}, [start], []
        for states in order:
            to: list[set[int]] = [set(start) for _ in kinds]
            for x in states:
                if grown.moves[x]:
                    mask, end = grown.moves[x]
                    for c in holds[mask]:
                        to[c] |= closure(end)
            row = []
            for target in map(frozenset, to):
                if target not in names:
                    names[target] = len(order)
                    order.append(target)
                row.append(names[target])
            rows.append(row)
        bit = {b: 1 << i for i, (_, b) in enumerate(made)}
        ends = np.array([sum(bit.get(x, 0) for x in states) for states in order], dtype=np.int64)
        return cls._minimal(np.array(rows), ends, class_of)

    @classmethod
    def _minimal(cls, rows: np.ndarray, ends: np.ndarray, class_of: np.ndarray) -> Automaton:
        block = np.unique(ends, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([block, block[rows]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        _, kept = np.unique(block, return_index=True)
        # the start first, then states that end nothing, then the ends
        order = sorted(kept.tolist(), key=lambda s: (block[s] != block[0], ends[s] != 0))
        place = np.zeros(len(kept), dtype=np.int64)
        place[block[order]] = np.arange(len(order))
        classes = rows.shape[1]
        table = (place[block[rows[order]]] * classes).astype(np.int32).ravel()
        return cls(class_of, table, classes, int((ends[order] == 0).sum()), ends[order][ends[order] != 0])

    @property
    def states(self) -> int:
        return len(self.table) // self.classes

    def scan(self, data: np.ndarray, lane: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of bytes where patterns end, ascending, and the patterns as bits.

        The bytes are cut into lanes that step together; a lane goes on past its end until it is back in
        the start state, so what lies across a cut is found by the lane it begins in.  An offset may be
        reported by two lanes.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes = -(-n // lane)
        steps = -(-n // lanes)
        kinds = np.zeros(lanes * steps, dtype=np.uint8)
        kinds[:n] = self.class_of[data]
        kinds[n:] = self.class_of[10]
        columns = np.ascontiguousarray(kinds.reshape(lanes, steps).T)
        found, bits = [], []
        state = np.zeros(lanes, dtype=np.int32)
        first_end = self.first_end * self.classes

        def note(state: np.ndarray, offsets: np.ndarray) -> None:
            if len(state) and state.max() >= first_end:
                at = np.flatnonzero(state >= first_end)
                found.append(offsets[at])
                bits.append(self.ends[state[at] // self.classes - self.first_end])

        starts = np.arange(lanes, dtype=np.int64) * steps
        for k in range(steps):
            state = self.table[state + columns[k]]
            note(state, starts + k) if state.max() >= first_end else None
        live, at = np.flatnonzero(state), (starts + steps)[np.flatnonzero(state)]
        state = state[live]
        while len(state):
            inside = at < n
            state, at = state[inside], at[inside]
            state = self.table[state + kinds[at]]
            note(state, at)
            on = state != 0
            state, at = state[on], at[on] + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        offsets, bits = np.concatenate(found), np.concatenate(bits)
        order = np.argsort(offsets, kind="stable")
        return offsets[order], bits[order]
