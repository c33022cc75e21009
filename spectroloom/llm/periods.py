"""Periodic runs of words by block convolution.

A run of period q matches itself q words on over a stretch of at least 2q words. At the scale L = 8, 16, 32, ... the words
are cut into blocks of L; a stretch of q in [L, 2L) (at the first scale [1, 16)) holds a whole block, which therefore
occurs again q words on. All such occurrences are located at once: the sums of squared differences between a block and
the window that follows it, at all distances of a scale, come from a correlation by a number-theoretic transform, in
exact integers modulo a prime; a sum of zero is a distance. Distances are seeds: the words themselves are compared
there, and what agrees is extended to either side. Scales go up, so that the least period of a run is met first, and
seeds inside a known run whose period divides theirs are that run again.

Documents of a slice are transformed together, a few blocks at a time; what a task holds does not grow with its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructType

from spectroloom.llm.common import encoded, slices, spaced, wider

#: Words of a block at the first scale: a stretch of 24 - q words, for q up to 8, holds a block of 8.
FIRST = 8
#: Values of a transform at a time, about.
AT_ONCE = 1 << 16
#: The longest transform that is a product with a matrix.
SHORT = 512
#: (prime, generator, longest transform): the first is reduced by shifts, the second serves longer blocks.
PRIMES = ((65537, 3, 1 << 16), (2013265921, 31, 1 << 27))
RUN = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())


class Transform:
    """Transforms of blocks of half its size, zeros behind, and the first halves of what products of them come from.

    Short ones are products with the matrix of powers, of integers that doubles hold exactly; long ones go by halves in
    64-bit integers, their values in reversed order of bits. ``negative`` says where the value of -j stands for that of
    j; times ``sign`` a transform is that of the block one block further on.
    """

    def __init__(self, size: int):
        self.size, (self.prime, generator, _) = size, next(p for p in PRIMES if p[2] >= size)
        self.short = size <= SHORT
        root = pow(generator, (self.prime - 1) // size, self.prime)
        powers = np.ones(size, np.int64)
        for k in range(size.bit_length() - 1):
            # the next as many powers are those so far times root^(2^k)
            powers[1 << k : 2 << k] = powers[: 1 << k] * pow(root, 1 << k, self.prime) % self.prime
        shrink = pow(size, -1, self.prime)
        if self.short:
            j = np.arange(size)
            self.negative, self.sign = -j % size, 1 - 2 * (j % 2)
            self.there = powers[np.outer(j[: size // 2], j) % size].astype(float)
            self.back_again = (powers[-np.outer(j, j[: size // 2]) % size] * shrink % self.prime).astype(float)
        else:
            reverse = np.zeros(1, np.int64)
            while len(reverse) < size:
                reverse = np.concatenate([2 * reverse, 2 * reverse + 1])
            self.negative, self.sign = reverse[-reverse % size], np.repeat(np.array([1, -1], np.int64), size // 2)
            inverse = powers[-np.arange(size) % size]
            self.stages = [(powers[: size // 2 : 1 << k], inverse[: size // 2 : 1 << k]) for k in range(size.bit_length() - 1)]
            self.shrink = shrink

    def less(self, x: np.ndarray) -> np.ndarray:
        """Something congruent to ``x``, small enough to go on; 2^16 is -1 modulo 65537."""
        if self.short:
            return x - self.prime * np.floor(x * (1 / self.prime))
        return (x & 65535) - (x >> 16) if self.prime == 65537 else x % self.prime

    def forward(self, blocks: np.ndarray) -> np.ndarray:
        if self.short:
            return self.less(blocks @ self.there)
        x = np.concatenate([blocks, np.zeros_like(blocks)], axis=1)
        for powers, _ in self.stages:
            v = x.reshape(len(x), -1, 2, len(powers))
            a, b = v[:, :, 0], v[:, :, 1]
            d = self.less((a - b) * powers)
            a += b
            if self.prime != 65537:
                a %= self.prime
            v[:, :, 1] = d
        return x % self.prime

    def backward(self, x: np.ndarray) -> np.ndarray:
        if self.short:
            return self.less(self.less(x) @ self.back_again)
        x = self.less(x)
        for _, powers in reversed(self.stages):
            v = x.reshape(len(x), -1, 2, len(powers))
            a, b = v[:, :, 0], self.less(v[:, :, 1] * powers)
            v[:, :, 1] = a - b
            a += b
            if self.prime != 65537:
                x %= self.prime
        return x[:, : self.size // 2] % self.prime * self.shrink % self.prime

    def is_zero(self, x: np.ndarray) -> np.ndarray:
        return x == self.prime * np.rint(x * (1 / self.prime)) if self.short else x % self.prime == 0


#: A long transform is kept for the next slice only while it is small.
_kept = lru_cache(maxsize=16)(Transform)


def occurrences(words: np.ndarray, bounds: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, distance) of blocks that occur again, up to chance: words that differ may agree modulo the prime.

    ``words`` are numbers of words, document i those between bounds[i] and bounds[i + 1].
    """
    lengths = np.diff(bounds)
    docs = np.flatnonzero(lengths >= 3 * block)
    if not len(docs):
        return (np.zeros(0, np.int64),) * 3
    size, shifts = 2 * block, (0, 1) if block == FIRST else (1,)
    t = _kept(size) if size <= AT_ONCE else Transform(size)
    kind = float if t.short else np.int64
    # each document begins a row of its own, with two empty ones behind
    height = -(-lengths[docs] // block) + 2
    top = np.concatenate([[0], np.cumsum(height)])
    held = np.zeros(top[-1] * block, kind)
    for d, at in zip(docs.tolist(), top.tolist(), strict=False):
        held[at * block : at * block + lengths[d]] = (words[bounds[d] : bounds[d + 1]] + 1) % t.prime
    doc_of = np.repeat(np.arange(len(docs)), height)
    first = (np.arange(top[-1]) - top[doc_of]) * block
    # words that a document still has behind a block; negative where the block is not whole
    behind = lengths[docs][doc_of] - first - block
    squares = np.concatenate([np.zeros(1, kind), np.cumsum(t.less(held * held))])
    found, step, ahead = [], max(1, AT_ONCE // size), np.zeros((0, size), kind)
    for r in range(0, top[-1], step):
        got = np.concatenate([ahead, t.forward(held[r * block : (r + step) * block].reshape(-1, block))])
        at, ahead = r - len(ahead), got[-2:].copy()
        use = np.flatnonzero(behind[at : at + max(0, len(got) - 2)] >= 0)
        if not len(use):
            continue
        mirrored = got[use][:, t.negative]
        own = squares[(at + use + 1) * block] - squares[(at + use) * block]
        for m in shifts:
            meets = t.backward(mirrored * (got[use + m] + t.sign * got[use + m + 1]))
            begin = (at + use + m)[:, None] * block + np.arange(block)
            good = t.is_zero(own[:, None] + squares[begin + block] - squares[begin] - 2 * meets)
            i, d = np.nonzero(good)
            # what reaches beyond the document is none, nor is a block itself
            inside = (d <= behind[at + use[i]] - m * block) & (d + m > 0)
            i, d = i[inside], d[inside]
            found.append(np.stack([docs[doc_of[at + use[i]]], first[at + use[i]], d + m * block]))
    out = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return out[0], out[1], out[2]


def _agree_from(x: np.ndarray, t: int, q: int) -> int:
    """The first position from ``t`` on that differs from the one q words on."""
    step = 64
    while t + q < len(x):
        m = min(step, len(x) - q - t)
        wrong = np.flatnonzero(x[t : t + m] != x[t + q : t + q + m])
        if len(wrong):
            return t + int(wrong[0])
        t, step = t + m, 2 * step
    return t


def _agree_down_to(x: np.ndarray, t: int, q: int) -> int:
    """The first position from which all up to ``t`` agree with those q words on."""
    step = 64
    while t:
        m = min(step, t)
        wrong = np.flatnonzero(x[t - m : t] != x[t - m + q : t + q])
        if len(wrong):
            return t - m + int(wrong[-1]) + 1
        t, step = t - m, 2 * step
    return 0


def extended(x: np.ndarray, seeds: list[tuple[int, np.ndarray, np.ndarray]], least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``x``, by start and period; seeds are (block, starts, distances), scales going up."""
    runs: dict[tuple[int, int], int] = {}
    for block, starts, distances in seeds:
        order = np.argsort(starts, kind="stable")
        starts, distances = starts[order], distances[order]
        known = np.zeros(len(starts), bool)
        for (s, e), p in runs.items():
            if e - s >= 2 * block:
                a, b = np.searchsorted(starts, [s, e])
                known[a:b] |= (starts[a:b] + block + distances[a:b] <= e) & (distances[a:b] % p == 0)
        starts, distances = starts[~known], distances[~known]
        order = np.lexsort((starts, distances))
        starts, distances = starts[order], distances[order]
        k = 0
        while k < len(starts):
            a, q = int(starts[k]), int(distances[k])
            k += 1
            if not np.array_equal(x[a : a + block], x[a + q : a + q + block]):
                continue
            i, j = _agree_down_to(x, a, q), _agree_from(x, a + block, q)
            if j - i + q >= max(least, times * q):
                runs.setdefault((i, j + q), q)
            # blocks of the same distance within what agrees are done
            same = int(np.searchsorted(distances, q, "right"))
            k = max(k, k + int(np.searchsorted(starts[k:same], j - block, "right")))
    return sorted((s, e - s, p) for (s, e), p in runs.items())


def runs_of(words: np.ndarray, bounds: np.ndarray, least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each document."""
    seeds: dict[int, list] = {}
    longest, block = int(np.diff(bounds).max(initial=0)), FIRST
    while 3 * block <= longest:
        doc, start, distance = occurrences(words, bounds, block)
        order = np.argsort(doc, kind="stable")
        doc, start, distance = doc[order], start[order], distance[order]
        for d in np.unique(doc).tolist():
            a, b = np.searchsorted(doc, [d, d + 1])
            seeds.setdefault(d, []).append((block, start[a:b], distance[a:b]))
        block *= 2
    return [extended(words[bounds[d] : bounds[d + 1]], seeds[d], least, times) if d in seeds else [] for d in range(len(bounds) - 1)]


def collapsed(cut: tuple[bytes, np.ndarray, np.ndarray], runs: list[tuple[int, int, int]]) -> bytes:
    """The words of a text that no run repeats: of each run the first period stays."""
    joined, starts, ends = cut
    if not runs:
        return joined
    change = np.zeros(len(starts) + 1, np.int64)
    for s, length, p in runs:
        change[s + p] += 1
        change[s + length] -= 1
    kept = np.cumsum(change[:-1]) == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]])))
    return b" ".join(joined[starts[a] : ends[b - 1]] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def with_runs(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length and period, in words, by start and period) and ``collapsed``
    (the text's words, one space between, without the repetitions of runs), replaced if there.

    A run is a stretch of consecutive words of least period q and of ``max(least, times * q)`` words at least that no
    neighbouring word extends; a word goes if a run contains it behind the run's first q words. ``least`` is 24 and
    ``times`` 3 at least: shorter stretches may hold no whole block. Null, empty and wordless texts have no runs and
    nothing left. Texts of any length are taken whole; repeated rows and other columns stay; an empty table gives no rows.
    """
    if least < 3 * FIRST or times < 3:
        raise ValueError(f"runs of at least {3 * FIRST} words and 3 periods are found")
    docs = docs.drop("runs", "collapsed")
    at = docs.columns.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                cut = [spaced(t.as_py() or b"") for t in part.column(at).cast(pa.large_binary())]
                words, bounds, _ = encoded(cut)
                runs = runs_of(words, bounds, least, times)
                left = pa.array([collapsed(c, r).decode() for c, r in zip(cut, runs, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], kind), left], [*part.schema.names, "runs", "collapsed"])

    return docs.mapInArrow(run, wider(docs, runs=ArrayType(RUN), collapsed="string"))
