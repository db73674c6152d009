"""Suffix arrays and common-prefix values by induced sorting in external memory.

Suffixes of the leftmost-S kind are sorted first: their substrings are sorted by induction and named, and the string of
names is sorted by the same procedure, until it fits in memory. The order of all other suffixes is then induced: a monotone
priority queue, by first character and order of insertion, carries tuples of position and common-prefix value; each tuple
that leaves it puts the suffix that starts one place before into the queue, with a common-prefix value one above the least
one passed since that character's last tuple. The queue, the text and the output lie on disk beyond a given number of items.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from pathlib import Path

import numpy as np


class BucketQueue:
    """A monotone priority queue of (position, lcp) tuples by character; equal characters leave as they came. Beyond ``limit`` items it moves its largest buckets to files."""

    def __init__(self, folder: Path, limit: int) -> None:
        self.folder, self.limit, self.held = folder, limit, 0
        self.memory: dict[int, list[np.ndarray]] = defaultdict(list)
        self.size: dict[int, int] = defaultdict(int)
        self.files: dict[int, Path] = {}
        self.number = count()

    def push(self, char: int, items: np.ndarray) -> None:
        """items: two columns."""
        self.memory[char].append(items)
        self.size[char] += len(items)
        self.held += len(items)
        while self.held > self.limit:
            self._spill(max(self.size, key=self.size.__getitem__))

    def _spill(self, char: int) -> None:
        path = self.files.setdefault(char, self.folder / f"bucket{char}-{id(self)}")
        with path.open("ab") as f:
            for x in self.memory.pop(char):
                np.ascontiguousarray(x).tofile(f)
        self.held -= self.size.pop(char)

    def pop(self, char: int) -> Iterator[np.ndarray]:
        """Tuples of the character, in parts; until has() is false there are more."""
        if path := self.files.pop(char, None):
            path = path.rename(path.with_name(f"{path.name}-{next(self.number)}"))  # what comes in meanwhile goes to a new file
            n = path.stat().st_size // 16
            for at in range(0, n, max(1, self.limit)):
                yield np.fromfile(path, np.int64, 2 * min(self.limit, n - at), offset=16 * at).reshape(-1, 2)
            path.unlink()
        if char not in self.files and (parts := self.memory.pop(char, None)):  # else what is there has come before
            self.held -= self.size.pop(char)
            yield np.concatenate(parts)

    def has(self, char: int) -> bool:
        return char in self.memory or char in self.files


def _stable(keys: np.ndarray, n: int) -> np.ndarray:
    """Stable order of keys below n; of 16 bits, they are sorted by their digits."""
    return np.argsort(keys.astype(np.uint16) if n <= 1 << 16 else keys, kind="stable")


def _range_min(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of values[start..end], both included."""
    out = np.empty(len(start), values.dtype)
    level, width = values, 1
    span = end - start + 1
    power = np.floor(np.log2(span)).astype(np.int64)
    for p in range(int(power.max()) + 1 if len(power) else 0):
        at = np.flatnonzero(power == p)
        out[at] = np.minimum(level[start[at]], level[end[at] - width + 1])
        if len(level) > width:
            level = np.minimum(level[:-width], level[width:])
        width *= 2
    return out


class InducedSort:
    """Suffix array and, for the first call, common-prefix values up to ``cap`` of a text of integers that ends with its only 0."""

    def __init__(self, cap: int, memory_items: int, folder: str | None = None, names: int | None = None) -> None:
        """memory_items: of the queue and of each array; more go to files. names: strings of names up to so long are sorted in memory, longer ones by recursion."""
        self.cap, self.memory = cap, memory_items
        self.names = memory_items if names is None else names
        self._own = tempfile.TemporaryDirectory(dir=folder)
        self.folder = Path(self._own.name)
        self.files = 0

    def close(self) -> None:
        self._own.cleanup()

    def _array(self, size: int, dtype: type) -> np.ndarray:
        """In memory, or mapped to a file if it has more than ``memory`` items."""
        if size <= self.memory:
            return np.empty(size, dtype)
        self.files += 1
        return np.memmap(self.folder / f"array{self.files}", dtype, "w+", shape=(size,))

    def sort(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lms, small = self._kinds(text)
        order = self._sorted_lms(text, lms, small)
        lcp = self._neighbours(text, order)
        return self._induce(text, small, order, lcp)

    @staticmethod
    def _kinds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of leftmost S suffixes in order, and whether each suffix is of kind S."""
        n = len(text)
        step = np.zeros(n, np.int8)
        step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
        step[-1] = 1
        place = np.where(step != 0, np.arange(n), n - 1)
        small = step[np.minimum.accumulate(place[::-1])[::-1]] > 0
        return np.flatnonzero(small[1:] & ~small[:-1]) + 1, small

    def _sorted_lms(self, text: np.ndarray, lms: np.ndarray, small: np.ndarray) -> np.ndarray:
        if len(lms) < 2:
            return lms
        # one round of induction from the right first characters sorts the substrings from one to the next such place
        first = lms[_stable(text[lms], int(text.max()) + 1)]
        rough, _ = self._induce(text, small, first, None)
        is_lms = np.zeros(len(text), bool)
        is_lms[lms] = True
        order = rough[is_lms[rough]]
        end = np.empty(len(text), np.int64)
        end[lms] = np.append(lms[1:], lms[-1])
        names = np.zeros(len(order), np.int64)
        names[1:] = np.cumsum(self._differ(text, order, end))
        where = np.empty(len(text), np.int64)
        where[order] = names
        reduced = where[lms]
        if names[-1] + 1 == len(lms):
            return order
        if len(reduced) <= self.names:
            return lms[self._doubling(reduced)]
        deeper = np.append(reduced + 1, 0)
        deep_lms, deep_small = self._kinds(deeper)
        found, _ = self._induce(deeper, deep_small, self._sorted_lms(deeper, deep_lms, deep_small), None)
        return lms[found[found < len(lms)]]

    @staticmethod
    def _differ(text: np.ndarray, order: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each substring, from order[i] to its end, differs from the one before."""
        a, b = order[:-1], order[1:]
        out = (end[a] - a) != (end[b] - b)
        out |= (end[a] == a) | (end[b] == b)
        active = np.flatnonzero(~out)
        at = 0
        while len(active):
            differs = text[a[active] + at] != text[b[active] + at]
            out[active[differs]] = True
            active = active[~differs & (at < end[a[active]] - a[active])]
            at += 1
        return out

    @staticmethod
    def _doubling(names: np.ndarray) -> np.ndarray:
        """The suffix array of a string that fits in memory: suffixes are ranked by prefixes of doubling length."""
        n, width = len(names), 1
        _, rank = np.unique(names, return_inverse=True)
        rank = rank.astype(np.int64)
        while True:
            second = np.zeros(n, np.int64)
            second[: n - width if width < n else 0] = rank[width:] + 1
            both = rank * (n + 1) + second
            order = np.argsort(both)
            new = np.zeros(n, np.int64)
            new[order[1:]] = np.cumsum(both[order[1:]] != both[order[:-1]])
            rank, width = new, 2 * width
            if rank[order[-1]] == n - 1 or width >= 2 * n:
                return order

    def _neighbours(self, text: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Common prefixes, up to cap, of each suffix in order with the one before."""
        out = np.zeros(len(order), np.int64)
        active = np.arange(1, len(order))
        n, at = len(text), 0
        while len(active) and at < self.cap:
            a, b = order[active - 1] + at, order[active] + at
            ok = np.maximum(a, b) < n
            active, a, b = active[ok], a[ok], b[ok]
            active = active[text[a] == text[b]]
            at += 1
            out[active] = at
        return out

    def _induce(self, text: np.ndarray, small: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes from the sorted seeds: L suffixes by a rising scan, then S suffixes by a falling one."""
        n, with_lcp = len(text), seed_lcp is not None
        chars, counts = np.unique(text, return_counts=True)
        starts = np.concatenate([[0], np.cumsum(counts)])
        run = np.zeros(0)
        if with_lcp:
            change = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
            run = np.minimum(np.repeat(change, np.diff(change, prepend=-1)) - np.arange(n) + 1, self.cap)
        sa, lcp = self._array(n, np.int64), self._array(n if with_lcp else 0, np.int64)
        n_large = np.zeros(len(chars), np.int64)
        slot = np.searchsorted(chars, text[seeds])
        seed_bounds = np.searchsorted(slot, np.arange(len(chars) + 1))
        index = np.zeros(int(chars[-1]) + 1, np.int64)
        index[chars] = np.arange(len(chars))

        def scan(queue: BucketQueue, want: bool, least: np.ndarray, position: np.ndarray, shared: np.ndarray) -> None:
            """Puts the suffixes one place before those passed into the queue, if they are of the wanted kind."""
            before = position - 1
            ok = before >= 0
            ok[ok] = small[before[ok]] == want
            at = np.flatnonzero(ok)
            if len(at):
                target = index[text[before[at]]]
                by = _stable(target, len(chars))
                target, at_by = target[by], at[by]
                cuts = np.flatnonzero(np.diff(target, prepend=-1))
                value = np.zeros(len(at_by), np.int64)
                if with_lcp:
                    previous = np.empty_like(at_by)
                    previous[1:] = at_by[:-1] + 1
                    previous[cuts] = 0
                    value = _range_min(shared, previous, at_by)
                    value[cuts] = np.minimum(value[cuts], least[target[cuts]])
                    value = np.minimum(value + 1, self.cap)
                pairs = np.stack([before[at_by], value], 1)
                for a, b in zip(cuts, [*cuts[1:], len(target)]):
                    queue.push(int(target[a]), pairs[a:b])
            if with_lcp:
                tail = np.minimum.accumulate(shared[::-1])[::-1]
                np.minimum(least, tail[0], out=least, where=least >= 0)
                if len(at):
                    ends = np.append(cuts[1:], len(target)) - 1
                    last = at_by[ends]
                    least[target[ends]] = np.where(last + 1 < len(tail), tail[np.minimum(last + 1, len(tail) - 1)], self.cap)

        # -1: nothing of the character is in the queue yet, so that its first tuple shares nothing with the one before
        queue, least = BucketQueue(self.folder, self.memory), np.full(len(chars), -1, np.int64)
        for c in range(len(chars)):
            while queue.has(c):
                for items in queue.pop(c):
                    at = starts[c] + n_large[c]
                    sa[at : at + len(items)] = items[:, 0]
                    if with_lcp:
                        lcp[at : at + len(items)] = items[:, 1]
                    n_large[c] += len(items)
                    scan(queue, False, least, items[:, 0], items[:, 1])
            own = seeds[seed_bounds[c] : seed_bounds[c + 1]]
            if len(own):
                shared = np.zeros(len(own), np.int64)
                if with_lcp:
                    shared = seed_lcp[seed_bounds[c] : seed_bounds[c + 1]].copy()
                    shared[0] = min(run[sa[starts[c] + n_large[c] - 1]], run[own[0]]) if n_large[c] else 0
                scan(queue, False, least, own, shared)

        queue, least = BucketQueue(self.folder, self.memory), np.full(len(chars), -1, np.int64)
        # the last suffix, the only 0, has no other to induce it
        queue.push(0, np.array([[n - 1, 0]]))
        for c in range(len(chars) - 1, -1, -1):
            first_large, end = starts[c] + n_large[c], starts[c + 1]
            at = end
            while queue.has(c):
                for items in queue.pop(c):
                    sa[at - len(items) : at] = items[::-1, 0]
                    if with_lcp:
                        if at < end:
                            lcp[at] = items[0, 1]
                        lcp[at - len(items) + 1 : at] = items[:0:-1, 1]
                    scan(queue, True, least, items[:, 0], items[:, 1])
                    at -= len(items)
            size = int(n_large[c])
            if size:
                large = np.array(sa[starts[c] : first_large][::-1])
                shared = np.zeros(size, np.int64)
                if with_lcp:
                    between = min(run[large[0]], run[sa[first_large]]) if first_large < end else 0
                    if first_large < end:
                        lcp[first_large] = between
                    shared[0] = between
                    shared[1:] = lcp[starts[c] + 1 : first_large][::-1]
                    lcp[starts[c]] = 0
                scan(queue, True, least, large, shared)
            elif with_lcp and first_large < end:
                lcp[first_large] = 0
        return sa, lcp
