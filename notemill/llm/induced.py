"""Induced suffix sorting of one piece of text, with common prefixes carried along.

Suffixes that are smaller than their left neighbour's and their own right neighbour's (the S* ones) are
sorted by themselves. Scanning in order, each suffix then puts the one that starts a
symbol earlier behind the others of its first symbol: first the L suffixes from left to right, then
the S suffixes from right to left. A queue ordered by first symbol, then arrival, holds what
is waiting; beyond ``HELD_BYTES`` its runs go to files in a folder of the task and come back
bucket by bucket. A run is a numpy array, so a bucket is scanned at once, and again
for what it added to itself.

With each suffix goes its common prefix with the one before it, cut off at ``depth``: an
induced suffix has one more than the least common prefix between the two that
induced it and its predecessor, found by a range-minimum table over the scanned run.

Only orders up to ``depth`` symbols matter here, hence S* suffixes are sorted by their first
``depth`` symbols in packed words rather than by recursion on their names.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Bytes that waiting runs may take before they are written to files.
HELD_BYTES = 256 << 20
#: Symbols of 9 bits in a 64-bit word.
PACKED, BITS = 7, 9


class RunQueue:
    """First symbol, then arrival: runs of (position, common prefix) per symbol, on disk when there are many."""

    def __init__(self, symbols: int):
        self.runs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(symbols)]
        self.held, self.folder, self.files = 0, None, 0
        self.spilled: list[list[str]] = [[] for _ in range(symbols)]

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.runs[symbol].append((at, lcp))
        self.held += at.nbytes + lcp.nbytes
        if self.held > HELD_BYTES:
            self.spill()

    def spill(self) -> None:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="runs-")
        for symbol, runs in enumerate(self.runs):
            if runs:
                path = os.path.join(self.folder, f"{self.files}.npz")
                np.savez(path, at=np.concatenate([a for a, _ in runs]), lcp=np.concatenate([c for _, c in runs]))
                self.files += 1
                self.spilled[symbol].append(path)
                self.runs[symbol] = []
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that waits under a symbol, in order of arrival."""
        parts = []
        for path in self.spilled[symbol]:
            with np.load(path) as f:
                parts.append((f["at"], f["lcp"]))
            os.remove(path)
        self.spilled[symbol] = []
        parts += self.runs[symbol]
        if not parts:
            return None
        self.held -= sum(a.nbytes + c.nbytes for a, c in self.runs[symbol])
        self.runs[symbol] = []
        return np.concatenate([a for a, _ in parts]), np.concatenate([c for _, c in parts])

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def bit_length(x: np.ndarray) -> np.ndarray:
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])


class Packed:
    """Words of ``PACKED`` symbols from every position, to compare and sort by many symbols at once."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, self.words = depth, -(-depth // PACKED)
        padded = np.concatenate([text, np.zeros(PACKED * (self.words + 1), text.dtype)])
        n = len(text) + PACKED * self.words
        self.word = np.zeros(n, np.uint64)
        for j in range(PACKED):
            self.word = self.word << np.uint64(BITS) | padded[j : j + n]

    def sort(self, at: np.ndarray) -> np.ndarray:
        return at[np.lexsort([self.word[at + PACKED * j] for j in range(self.words - 1, -1, -1)])]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at a and b, up to depth."""
        out, live = np.full(len(a), self.depth, np.int64), np.arange(len(a))
        for j in range(self.words):
            x = self.word[a[live] + PACKED * j] ^ self.word[b[live] + PACKED * j]
            differ = x != 0
            out[live[differ]] = PACKED * j + PACKED - 1 - (bit_length(x[differ]) - 1) // BITS
            live = live[~differ]
            if not len(live):
                break
        return np.minimum(out, self.depth).astype(np.uint8)


class Least:
    """Range minima of a run."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of values[lo:hi]; 255 where that is empty."""
        size = hi - lo
        out = np.full(len(lo), 255, np.uint8)
        level = np.where(size > 0, np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1, -1)
        for k in np.unique(level):
            if k >= 0:
                use = level == k
                values = self.levels[k]
                out[use] = np.minimum(values[lo[use]], values[hi[use] - (1 << k)])
        return out


class Scan:
    """One direction of induction."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, depth: int, symbols: int):
        self.text, self.wanted, self.depth = text, wanted, depth
        self.queue = RunQueue(symbols)
        self.since = np.full(symbols, 255, np.uint8)  # least common prefix scanned since the symbol's last arrival
        self.begun = np.zeros(symbols, bool)

    def scan(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """Takes in a run of suffixes in order; lcp[i] is the common prefix with the one scanned before."""
        if not len(at):
            return
        least = Least(lcp)
        picks = np.flatnonzero(at > 0)
        picks = picks[self.wanted[at[picks] - 1]]
        symbol = self.text[at[picks] - 1]
        order = np.argsort(symbol, kind="stable")
        picks, symbol = picks[order], symbol[order]
        whole = least(np.array([0]), np.array([len(lcp)]))[0]
        before = self.since.copy()
        self.since = np.minimum(self.since, whole)
        if not len(picks):
            return
        first = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        lo = np.where(first, 0, np.concatenate([[0], picks[:-1]]) + 1)
        found = least(lo, picks + 1)
        heads = symbol[first]
        found[first] = np.minimum(found[first], before[heads])
        found = np.minimum(found.astype(np.int64) + 1, self.depth).astype(np.uint8)
        found[np.flatnonzero(first)[~self.begun[heads]]] = 0
        self.begun[heads] = True
        ends = np.append(np.flatnonzero(first)[1:], len(picks))
        self.since[heads] = least(picks[ends - 1] + 1, np.full(len(heads), len(lcp)))
        for a, b in zip(np.flatnonzero(first), ends, strict=True):
            self.queue.push(int(symbol[a]), at[picks[a:b]] - 1, found[a:b])


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` in order of their first ``depth`` symbols, and common prefixes with the one before.

    ``text`` holds numbers of at most 9 bits and ends with a 0 that no other 0 precedes.
    """
    n, symbols = len(text), int(text.max()) + 1
    differ = text[:-1] != text[1:]
    at = np.where(differ, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = text[nearest] < text[np.minimum(nearest + 1, n - 1)]
    packed = Packed(text, depth)
    star = np.flatnonzero(small & np.concatenate([[False], ~small[:-1]]))
    star = packed.sort(star)
    star_lcp = np.concatenate([np.zeros(1, np.uint8), packed.common(star[:-1], star[1:])]) if len(star) else np.zeros(0, np.uint8)
    bounds = np.searchsorted(text[star], np.arange(symbols + 1))

    large: list[tuple[np.ndarray, np.ndarray]] = []
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint8))
    left = Scan(text, ~small, depth, symbols)
    for c in range(symbols):
        parts = []
        while (run := left.queue.pop(c)) is not None:
            left.scan(*run)
            parts.append(run)
        large.append((np.concatenate([a for a, _ in parts]), np.concatenate([x for _, x in parts])) if parts else none)
        seeds, lcp = star[bounds[c] : bounds[c + 1]], star_lcp[bounds[c] : bounds[c + 1]].copy()
        if len(seeds):
            lcp[0] = packed.common(large[c][0][-1:], seeds[:1])[0] if len(large[c][0]) else 0
            left.scan(seeds, lcp)
    left.queue.close()

    def turned(at: np.ndarray, lcp: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
        """The run from right to left, with the common prefix of its first and what was scanned before."""
        return at[::-1], np.concatenate([[before], lcp[:0:-1]]).astype(np.uint8)

    out: list[tuple[np.ndarray, np.ndarray]] = []
    right = Scan(text, small, depth, symbols)
    for c in range(symbols - 1, -1, -1):
        parts = []
        while (run := right.queue.pop(c)) is not None:
            right.scan(*run)
            parts.append(run)
        at, lcp = (np.concatenate([a for a, _ in parts]), np.concatenate([x for _, x in parts])) if parts else none
        big, big_lcp = large[c]
        seam = int(packed.common(big[-1:], at[-1:])[0]) if len(at) and len(big) else 0
        if len(big):
            right.scan(*turned(big, big_lcp, seam))
        if len(at):  # arrivals ran from right to left
            out.append((at[::-1], np.concatenate([[seam], lcp[:0:-1]]).astype(np.uint8)))
        if len(big):
            out.append((big, np.concatenate([[0], big_lcp[1:]]).astype(np.uint8)))
    right.queue.close()
    out.reverse()
    return np.concatenate([a for a, _ in out]), np.concatenate([x for _, x in out])
