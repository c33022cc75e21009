"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words that toxic labelled texts hold far more often than chance. Features
of a text are densities of lexicon words, how near they stand to second-person words, capitals,
punctuation and obfuscated spellings. Lexicon, trees and calibration are fitted across folds, so
that no text is judged by a lexicon or a tree that has seen its own label.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from spectroloom.llm.common import wider
from spectroloom.llm.sampling import class_weights, labelled_sample

# Second-person words of the languages at hand.
SECOND_PERSON = frozenset(w.encode() for w in ("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer usted ustedes ti tuyo vosotros").split())
FEATURES = ("weight", "density", "hits", "distinct", "strongest", "near_second_person", "second_person", "capitals", "exclamations", "punctuation", "obfuscated", "mixed", "words")
#: By how many standard deviations a word must exceed chance; the value with the least loss across folds counts.
THRESHOLDS = (4.0, 5.0, 6.0)
#: Words on either side within which a second-person word counts as near.
NEAR = 5

PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SPACED = bytes(32 if c in PUNCTUATION else c for c in range(256))
#: White space of every kind as spaces, so that tokens end at all of it.
BLANK = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)
UNLEET = bytes.maketrans(b"013457@$!|", b"oieastasil")
MIXED = re.compile(rb"[a-z\x80-\xff][0-9@$!|*.\-_]+[a-z\x80-\xff]")
UPPER, STOPS = bytes(range(65, 91)), b"!?"


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(SPACED).split()


def features(text: str, lexicon: dict[bytes, float]) -> list[float]:
    raw = text.encode()
    lower = text.lower().encode()
    words = lower.translate(SPACED).split()
    n, size = max(1, len(words)), max(1, len(raw))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    near = 0
    for i in hits:
        near += any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1])
    mixed = obfuscated = 0
    hidden = 0.0
    spaced, end = lower.translate(BLANK), -1
    for m in MIXED.finditer(lower):
        if m.start() < end:
            continue
        start, end = spaced.rfind(b" ", 0, m.start()) + 1, spaced.find(b" ", m.end())
        end = len(lower) if end < 0 else end
        mixed += 1
        plain = lower[start:end].strip(b".,;:?\"'()").translate(UNLEET, b"*.-_")
        if plain in lexicon:
            obfuscated += 1
            hidden += lexicon[plain]
    weights = [lexicon[words[i]] for i in hits]
    weight = sum(weights) + hidden
    person = sum(map(SECOND_PERSON.__contains__, words))
    letters = size - len(raw.translate(None, UPPER))
    return [
        weight / n, (len(hits) + obfuscated) / n, np.log1p(len(hits) + obfuscated), np.log1p(len({words[i] for i in hits})), max(weights, default=0.0), near / n, person / n,
        letters / size, (size - len(raw.translate(None, STOPS))) / size, (size - len(raw.translate(None, PUNCTUATION))) / size, obfuscated / n, mixed / n, np.log1p(len(words)),
    ]


def learn_lexicon(sets: list[frozenset[bytes]], labels: np.ndarray, least: float = 4.0) -> dict[bytes, float]:
    """Words by how far their number of toxic texts exceeds chance, in standard deviations: all of at least ``least``."""
    toxic, every = Counter(), Counter()
    for words, y in zip(sets, labels, strict=True):
        every.update(words)
        if y:
            toxic.update(words)
    rate = labels.mean() if len(labels) else 0.0
    found = []
    for w, k in toxic.items():
        expected = rate * every[w]
        z = (k - expected) / np.sqrt(expected + 1)
        if z >= least and k >= 3:
            found.append((-z, w))
    return {w: float(-z) for z, w in sorted(found)}


@dataclass
class Trees:
    """Boosted trees over binned features, logistic loss."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple]] = field(default_factory=list)
    base: float = 0.0
    rate: float = 0.1

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * self._leaf(tree, b)
        return out

    @staticmethod
    def _leaf(tree: list[tuple], b: np.ndarray) -> np.ndarray:
        at, out = np.zeros(len(b), int), np.zeros(len(b))
        for k, (feature, cut, left, right, value) in enumerate(tree):
            here = at == k
            if feature < 0:
                out[here] = value
            else:
                at[here] = np.where(b[here, feature] <= cut, left, right)
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 80, depth: int = 3, rate: float = 0.1, bins: int = 32, leaf: int = 5, ridge: float = 1.0) -> Trees:
    model = Trees(rate=rate)
    if not len(x) or y.min() == y.max():
        model.base = 0.0 if not len(x) else (4.0 if y[0] else -4.0)
        model.edges = [np.zeros(0)] * (x.shape[1] if x.ndim == 2 else len(FEATURES))
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    for j in range(x.shape[1]):  # rare non-zero values fall between quantiles
        live = x[x[:, j] > 0, j]
        if len(live):
            model.edges[j] = np.unique(np.concatenate([model.edges[j], np.quantile(live, np.linspace(0, 1, bins // 2)) - 1e-12]))
    b = model.binned(x)
    width = max(len(e) for e in model.edges) + 1
    weight = np.ones(len(y)) if weight is None else weight
    rate0 = (weight * y).sum() / weight.sum()
    model.base = float(np.log(rate0 / (1 - rate0)))
    out = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        g, h = weight * (y - p), weight * p * (1 - p)
        tree: list[tuple] = [(-1, 0, 0, 0, 0.0)]
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            k, rows, level = todo.pop(0)
            gs, hs = g[rows].sum(), h[rows].sum()
            tree[k] = (-1, 0, 0, 0, float(gs / (hs + ridge)))
            if level == depth or len(rows) < 2 * leaf:
                continue
            best = (1e-6, -1, -1)
            for j in range(b.shape[1]):
                gl = np.cumsum(np.bincount(b[rows, j], g[rows], width))[:-1]
                hl = np.cumsum(np.bincount(b[rows, j], h[rows], width))[:-1]
                nl = np.cumsum(np.bincount(b[rows, j], minlength=width))[:-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(nl < leaf) | (len(rows) - nl < leaf)] = -1
                c = int(gain.argmax())
                if gain[c] > best[0]:
                    best = (float(gain[c]), j, c)
            if best[1] < 0:
                continue
            left = b[rows, best[1]] <= best[2]
            a = len(tree)
            tree[k] = (best[1], best[2], a, a + 1, 0.0)
            tree += [(-1, 0, 0, 0, 0.0)] * 2
            todo += [(a, rows[left], level + 1), (a + 1, rows[~left], level + 1)]
        model.trees.append(tree)
        out += rate * Trees._leaf(tree, b)
    return model


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (x, value) of the blocks, to be joined by straight lines."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    weight = np.ones(len(y)) if weight is None else weight
    for a, b, n in zip(x[order], y[order], weight[order], strict=True):
        blocks.append([a, b * n, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            w = blocks[-1][2] + top[2]
            blocks[-1] = [(blocks[-1][0] * blocks[-1][2] + top[0] * top[2]) / w, blocks[-1][1] + top[1], w]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def copies(sets: list[frozenset[bytes]]) -> np.ndarray:
    """A number for each text that exact and most near copies share: texts with the same four words of least checksum."""
    known: dict[tuple, int] = {}
    return np.array([known.setdefault(tuple(nsmallest(4, map(zlib.crc32, words))), len(known)) for words in sets], int)


@dataclass
class Model:
    lexicon: dict[bytes, float]
    trees: Trees
    at: np.ndarray
    value: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        raw = self.trees.raw(np.array([features(t, self.lexicon) for t in texts], float))
        level = np.interp(raw, self.at, self.value) if len(self.at) else np.full(len(raw), 0.5)
        # a trace of the uncalibrated score keeps the order within flat parts
        return np.clip(0.998 * level + 0.002 / (1 + np.exp(-raw)), 0, 1)


def fit(sample: list[tuple[int, str]], totals: dict[int, int] | None = None, folds: int = 5) -> Model:
    """Fits on (label, text) rows, weighed to the class ``totals``."""
    weight = np.array(class_weights([label for label, _ in sample], totals))
    y = np.array([label for label, _ in sample], float)
    sets = [frozenset(words_of(t)) for _, t in sample]
    # copies are one text to the lexicon, whose words they would all repeat, and stay in one fold
    group = copies(sets)
    fold = group % folds

    def lexicon_of(rows: np.ndarray, least: float) -> dict[bytes, float]:
        rows = rows[np.unique(group[rows], return_index=True)[1]] if len(rows) else rows
        return learn_lexicon([sets[i] for i in rows], y[rows], least)

    best = None
    for least in THRESHOLDS if len(sample) else THRESHOLDS[:1]:
        x = np.zeros((len(sample), len(FEATURES)))
        for k in range(folds):
            rest = np.flatnonzero(fold != k)
            lexicon = lexicon_of(rest, least)
            for i in np.flatnonzero(fold == k):
                x[i] = features(sample[i][1], lexicon)
        raw = np.zeros(len(sample))
        for k in range(folds):
            own = fold == k
            raw[own] = boost(x[~own], y[~own], weight[~own]).raw(x[own])
        loss = float((weight * np.logaddexp(0, np.where(y > 0, -raw, raw))).sum())
        if best is None or loss < best[0]:
            best = (loss, least, x, raw)
    _, least, x, raw = best
    return Model(lexicon_of(np.arange(len(sample)), least), boost(x, y, weight), *isotonic(raw, y, weight))


def train(docs: DataFrame, labels: DataFrame, eligible: Column, label: str = "toxic", per_class: int = 4000, max_chars: int = 20_000, seed: int = 10) -> Model:
    """Fits on at most ``per_class`` ids of each class, each text of at most ``max_chars``.

    Which rows these are, null and repeated ones among them, ``labelled_sample`` says. Without labels every score is 0.5,
    with labels of one class all scores lie on its side.
    """
    return fit(*labelled_sample(docs, labels, label, eligible, per_class, max_chars, seed))


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a ``score`` column (replaced if there is one) from each whole text.

    Null texts count as empty. Rows, repeated ones too, and all other columns stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shared.value.scores([t.as_py() or "" for t in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(run, wider(docs, **{score: "double"}))
