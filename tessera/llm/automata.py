"""Small regular expressions over bytes, compiled to minimal deterministic automata.

Dialect: literals, ``[...]`` classes with ranges and ``^``, ``\\xNN``, ``\\`` before a literal,
groups, ``|`` and the repeats ``? * + {m} {m,} {m,n}``.
"""

from __future__ import annotations

import numpy as np


def parse(pattern: str):
    """A syntax tree: ('set', bytes), ('cat', [..]), ('alt', [..]), ('rep', node, low, high or None)."""
    src, at = pattern.encode(), 0

    def byte() -> int:
        nonlocal at
        c = src[at]
        at += 1
        if c == 92:
            c = src[at]
            at += 1
            if c == 120:
                at += 2
                return int(src[at - 2 : at], 16)
        return c

    def group():
        nonlocal at
        branches = [[]]
        while at < len(src) and src[at] != 41:
            if src[at] == 124:
                at += 1
                branches.append([])
                continue
            branches[-1].append(repeat(atom()))
        nodes = [("cat", b) for b in branches]
        return nodes[0] if len(nodes) == 1 else ("alt", nodes)

    def atom():
        nonlocal at
        if src[at] == 40:
            at += 1
            node = group()
            at += 1
            return node
        if src[at] != 91:
            return ("set", frozenset([byte()]))
        at += 1
        inverse = src[at] == 94
        at += inverse
        found: set[int] = set()
        while src[at] != 93:
            low = byte()
            high = low
            if src[at] == 45 and src[at + 1] != 93:
                at += 1
                high = byte()
            found.update(range(low, high + 1))
        at += 1
        return ("set", frozenset(range(256)) - found if inverse else frozenset(found))

    def repeat(node):
        nonlocal at
        while at < len(src) and src[at] in b"?*+{":
            mark = src[at]
            at += 1
            if mark == 123:
                end = src.index(b"}", at)
                low, comma, high = src[at:end].decode().partition(",")
                at = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, int(mark == 43), 1 if mark == 63 else None)
        return node

    return group()


class Machine:
    """A machine with empty moves, built from syntax trees."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, node, start: int) -> int:
        """Reads ``node`` from ``start`` on; returns the state after it."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(part, first)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            start = self.add(part, start)
        end = self.state()
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(part, start)
        self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def backwards(node):
    """The tree that reads the same words from their end."""
    kind = node[0]
    if kind == "set":
        return node
    if kind in ("cat", "alt"):
        parts = [backwards(p) for p in node[1]]
        return (kind, parts[::-1] if kind == "cat" else parts)
    return ("rep", backwards(node[1]), *node[2:])


class Automaton:
    """The minimal automaton of several patterns at once.

    ``next[state, class of byte]`` is the transition array. State 0 is the start; with ``search``
    a match may start anywhere, else only at the first byte, and state ``dead`` means none is left.
    ``accepts[state]`` has a bit for each pattern that ends there.
    """

    def __init__(self, trees: list, search: bool):
        m = Machine()
        start, ends = m.state(), {}
        for k, tree in enumerate(trees):
            first = m.state()
            m.empty[start].append(first)
            ends[m.add(tree, first)] = k
        sets = sorted({s for moves in m.moves for s, _ in moves}, key=sorted)
        names: dict[tuple, int] = {}
        self.classes = np.array([names.setdefault(tuple(b in s for s in sets), len(names)) for b in range(256)], "u1")
        some = [int(np.flatnonzero(self.classes == c)[0]) for c in range(len(names))]

        # subset construction
        base = m.closure([start])
        number, order, rows = {base: 0}, [base], []
        for own in order:
            row = []
            for b in some:
                to = {t for s in own for chars, t in m.moves[s] if b in chars}
                to = m.closure(to) | base if search else m.closure(to)
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
        table = np.array(rows)
        accepts = np.array([sum(1 << k for s, k in ends.items() if s in own) for own in order])

        # minimisation: split blocks until all states of a block move to the same blocks
        block = np.unique(accepts, return_inverse=True)[1]
        while True:
            finer = np.unique(np.c_[block, block[table]], axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        swap = np.arange(block.max() + 1)
        swap[[0, block[0]]] = swap[[block[0], 0]]  # the start is state 0
        block = swap[block]
        first = np.unique(block, return_index=True)[1]
        self.next, self.accepts = block[table[first]].astype("i4"), accepts[first]
        stuck = (self.next == np.arange(len(first))[:, None]).all(1) & (self.accepts == 0)
        self.dead = int(np.flatnonzero(stuck)[0]) if stuck.any() and not search else -1
        self.rows = [row.tolist() for row in self.next[:, self.classes]] if len(first) < 4096 else None

    def scan(self, text: np.ndarray, lanes: int = 4096, most: int = 1 << 24) -> tuple[np.ndarray, np.ndarray]:
        """One pass over ``text`` (bytes) with ``search``: the places after which some pattern ends, and which.

        The text is cut anywhere into lanes of equal length that advance side by side, each from the
        start state. Then each lane whose predecessor ends in another state is read again from that
        state, until it meets a state that it has been in at the same place before. Long texts go in
        parts of ``most`` bytes.
        """
        at, which, state = [], [], 0
        for begin in range(0, len(text), most):
            ends, masks, state = self._scan(text[begin : begin + most], lanes, state)
            at.append(ends + begin)
            which.append(masks)
        return (np.concatenate(at), np.concatenate(which)) if at else (np.zeros(0, "i8"), np.zeros(0, "i8"))

    def _scan(self, text: np.ndarray, lanes: int, first: int) -> tuple[np.ndarray, np.ndarray, int]:
        n, width = len(text), self.next.shape[1]
        lanes = max(1, min(lanes, n // 64))
        length = -(-n // lanes)
        lanes = -(-n // length)
        kind = "u2" if self.next.size < 1 << 16 else "i4"
        flat = (self.next * width).ravel().astype(kind)
        cls = np.zeros(lanes * length, kind)
        cls[:n] = self.classes[text]
        cls = np.ascontiguousarray(cls.reshape(lanes, length).T)
        states = np.empty((length, lanes), kind)
        state = np.zeros(lanes, kind)
        for i in range(length):
            state = flat[state + cls[i]]
            states[i] = state
        begun = np.zeros(lanes, kind)
        while True:
            came = np.r_[np.array([first], kind), states[-1, :-1]]
            lane = np.flatnonzero(came != begun)
            if not len(lane):
                break
            state = begun[lane] = came[lane]
            for i in range(length):
                state = flat[state + cls[i, lane]]
                new = np.flatnonzero(state != states[i, lane])
                lane, state = lane[new], state[new]
                if not len(lane):
                    break
                states[i, lane] = state
        hot = np.repeat(self.accepts > 0, width)
        seen = hot[states].T.ravel()[:n]
        at = np.flatnonzero(seen)
        last = divmod(n - 1, length)
        return at + 1, self.accepts[states[at % length, at // length] // width], int(states[last[1], last[0]])

    def longest(self, text: bytes, start: int, step: int = 1, stop: int | None = None) -> int:
        """The end of the longest match at ``start``, read forwards or (with ``step`` -1) backwards down to ``stop``; or -1."""
        rows, state, accepts, dead, found = self.rows, 0, self.accepts, self.dead, -1
        i, last = (start, len(text)) if step > 0 else (start - 1, (stop or 0) - 1)
        while i != last:
            state = rows[state][text[i]]
            if state == dead:
                break
            i += step
            if accepts[state]:
                found = i if step > 0 else i + 1
        return found
