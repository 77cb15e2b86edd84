"""Table-driven tokenization of many strings at a time.

A token automaton has one state per token, and an arc on ``t`` after ``p`` only where
the merges leave ``p`` and ``t`` side by side; a string has exactly one accepted path.
Here its transitions are tables: the vocabulary's trie reads the symbols of one token,
the arc table says which tokens may follow which. Many strings advance in step over
numpy arrays. For every place of a string the table keeps the one token that ends there
on the path of the string so far; that path is a prefix property, so it never changes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np

#: Strings longer than this are read one by one.
IN_STEP = 2_000
_K = np.uint64(0x9E3779B97F4A7C15)


class IntMap:
    """A hash table from 64-bit keys to 32-bit values for whole arrays of keys."""

    def __init__(self, size: int = 1 << 12):
        self.n = 0
        self._empty(size)

    def _empty(self, size: int) -> None:
        self.keys = np.full(size, -1, np.int64)
        self.vals = np.full(size, -1, np.int32)
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = size - 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _K) >> self.shift).astype(np.int64)

    def add(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        self.n += len(keys)
        if self.n * 2 > len(self.keys):
            there = self.keys >= 0
            keys = np.concatenate([self.keys[there], keys])
            vals = np.concatenate([self.vals[there], vals])
            self._empty(1 << (self.n * 3).bit_length())
        at = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]
            self.vals[at[free]] = vals[free]
            lost = self.keys[at] != keys
            keys, vals, at = keys[lost], vals[lost], (at[lost] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.vals[at], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.vals[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class TokenTable:
    """``tokens``: symbol sequences (ints below 2**21) and ids of the tokens that stand
    by themselves. Every symbol of an input must be a token. ``follows(p, t)`` says
    whether the automaton has the arc; each arc is asked for once."""

    def __init__(self, tokens: Iterable[tuple[Sequence[int], int]], follows: Callable[[int, int], bool]):
        trie: dict[int, int] = {}
        at, size = [-1], {}
        for symbols, token in tokens:
            node = 0
            for s in symbols:
                key = node << 21 | s
                node = trie.get(key, 0)
                if not node:
                    node = trie[key] = len(at)
                    at.append(-1)
            at[node] = token
            size[token] = len(symbols)
        self.trie = IntMap(1 << (3 * len(trie)).bit_length())
        self.trie.add(
            np.fromiter(trie.keys(), np.int64, len(trie)), np.fromiter(trie.values(), np.int32, len(trie))
        )
        self.at = np.array(at, np.int32)
        self.size = np.zeros(max(size) + 1, np.int64)
        self.size[list(size)] = list(size.values())
        self.follows = follows
        self.arcs = IntMap(1 << 18)

    def has_arc(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        keys = p.astype(np.int64) << 32 | t
        known = self.arcs.get(keys)
        if len(new := np.flatnonzero(known < 0)):
            fresh = np.unique(keys[new])
            ask = self.follows
            says = np.fromiter((ask(k >> 32, k & 0xFFFFFFFF) for k in fresh.tolist()), np.int32, len(fresh))
            if self.arcs.n > 3_000_000:
                self.arcs = IntMap(1 << 18)
            self.arcs.add(fresh, says)
            known[new] = says[np.searchsorted(fresh, keys[new])]
        return known == 1

    def run(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings, one after the other, and how many each has. ``data``
        holds the symbols of all strings, ``sizes`` the length of each."""
        sizes = sizes.astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        data = data.astype(np.int64)
        # One more place than symbols in each string; -1 says that nothing came before.
        base = starts + np.arange(len(sizes))
        last = np.full(len(data) + len(sizes), -1, np.int32)
        order = np.argsort(-sizes, kind="stable")
        ordered = sizes[order]
        alone = int(np.searchsorted(-ordered, -IN_STEP, side="left"))
        for w in order[:alone].tolist():
            self._alone(data[starts[w] : starts[w] + sizes[w]], last[base[w] : base[w] + sizes[w] + 1])
        order, ordered = order[alone:], ordered[alone:]
        for j in range(int(ordered[0]) if len(ordered) else 0):
            cur = order[: int(np.searchsorted(-ordered, -j, side="left"))]
            before = last[base[cur] + j]
            node = np.zeros(len(cur), np.int64)
            k = j
            while len(cur):
                node = self.trie.get(node << 21 | data[starts[cur] + k]).astype(np.int64)
                k += 1
                go = np.flatnonzero(node >= 0)
                cur, node, before = cur[go], node[go], before[go]
                t = self.at[node]
                ends = np.flatnonzero(t >= 0)
                if len(ends):
                    if j:
                        ends = ends[self.has_arc(before[ends], t[ends])]
                    last[base[cur[ends]] + k] = t[ends]
                go = np.flatnonzero(sizes[cur] > k)
                cur, node, before = cur[go], node[go], before[go]
        return self._paths(last, base, sizes)

    def _paths(self, last, base, sizes) -> tuple[np.ndarray, np.ndarray]:
        n = np.zeros(len(sizes), np.int64)
        cur, place, steps = np.arange(len(sizes)), sizes.copy(), []
        cur = cur[place > 0]
        place = place[place > 0]
        while len(cur):
            t = last[base[cur] + place]
            steps.append((cur, t))
            n[cur] += 1
            place = place - self.size[t]
            go = np.flatnonzero(place > 0)
            cur, place = cur[go], place[go]
        ends = np.cumsum(n)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (cur, t) in enumerate(steps, 1):
            out[ends[cur] - k] = t
        return out, n

    def _alone(self, data: np.ndarray, last: np.ndarray) -> None:
        """One long string, place by place."""
        trie = getattr(self, "_trie", None)
        if trie is None:
            there = self.trie.keys >= 0
            trie = self._trie = dict(zip(self.trie.keys[there].tolist(), self.trie.vals[there].tolist()))
            self._asked: dict[int, bool] = {}
        at, asked, symbols, path = self.at, self._asked, data.tolist(), [-1] * (len(data) + 1)
        for j in range(len(symbols)):
            node, k, p = 0, j, path[j]
            while k < len(symbols):
                node = trie.get(node << 21 | symbols[k])
                if node is None:
                    break
                k += 1
                t = int(at[node])
                if t >= 0 and path[k] < 0:
                    key = p << 32 | t
                    ok = p < 0 or asked.get(key)
                    if ok is None:
                        ok = asked[key] = self.follows(p, t)
                    if ok:
                        path[k] = t
        last[:] = path
