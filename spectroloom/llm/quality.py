"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A text is compressed
with either, in pieces so that the dictionary and not the text's own history does the work; the
difference of the two sizes over their sum and the ratio of compressed to plain size (texts that
repeat themselves compress far better than prose under either dictionary), calibrated by a
logistic curve on labelled texts that the dictionaries have not seen, are the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectroloom.llm.common import wider
from spectroloom.llm.sampling import class_weights, labelled_sample

SENTENCE = re.compile(rb"[^.\n]*[.\n]?")
#: Bytes that are compressed on their own.
PIECE = 2048


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    level: int = 3


def _dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary of a class, or its raw texts where there are too few to train one."""
    import zstandard

    pieces = [t[k : k + PIECE] for t in texts for k in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


class Scorer:
    def __init__(self, model: Model):
        import zstandard

        self.model = model
        self.both = []
        for raw in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(raw) if raw else None
            if d:
                d.precompute_compress(level=model.level)
            self.both.append(zstandard.ZstdCompressor(level=model.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def measures(self, text: bytes) -> tuple[float, float, float]:
        """The difference in -1..1 (above 0 if the good dictionary fits better), and the logarithm
        of compressed over plain size with its square. Empty texts: zeros."""
        good = bad = 0
        for k in range(0, len(text), PIECE):
            piece = text[k : k + PIECE]
            good += len(self.both[0].compress(piece))
            bad += len(self.both[1].compress(piece))
        if not text:
            return 0.0, 0.0, 0.0
        ratio = math.log((good + bad) / (2 * len(text)))
        return (bad - good) / (good + bad), ratio, ratio * ratio

    def score(self, text: bytes) -> float:
        a, b, c, offset = self.model.weights
        x = self.measures(text)
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, a * x[0] + b * x[1] + c * x[2] + offset))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Weights and offset by Newton's method on standardised columns; one class only: its side."""
    k = 3 if x.ndim < 2 else x.shape[1]
    if not len(x) or y.min() == y.max():
        return (*[0.0] * k, 0.0 if not len(x) else 2.0 if y[0] else -2.0)
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
    a = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    w = np.zeros(k + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(k + 1), a.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return (*(w[:-1] / scale).tolist(), float(w[-1] - (w[:-1] * mean / scale).sum()))


def fit(sample: list[tuple[int, str]], totals: dict[int, int] | None = None, size: int = 64 << 10) -> Model:
    """Three of four rows of each class make the dictionaries, the fourth calibrates, weighed to the class ``totals``."""
    split = {0: ([], []), 1: ([], [])}
    for label, text in sample:
        built, held = split[label]
        (held if (len(built) + len(held)) % 4 == 3 else built).append(text.encode())
    # sentences that both classes have tell nothing; in one dictionary they would mark whoever quotes them
    sentences = {c: {p for t in split[c][0] for p in SENTENCE.findall(t)} for c in (0, 1)}
    shared = sentences[0] & sentences[1]
    own = {c: [b"".join(p for p in SENTENCE.findall(t) if p not in shared) for t in split[c][0]] for c in (0, 1)}
    model = Model(_dictionary([t for t in own[1] if t], size), _dictionary([t for t in own[0] if t], size))
    scorer = Scorer(model)
    x = np.array([scorer.measures(t) for c in (0, 1) for t in split[c][1]])
    y = np.array([c for c in (0, 1) for _ in split[c][1]], float)
    return Model(model.good, model.bad, logistic(x, y, np.array(class_weights(y.astype(int).tolist(), totals))))


def train(docs: DataFrame, labels: DataFrame, eligible: Column, label: str = "quality", per_class: int = 2000, max_chars: int = 50_000, seed: int = 3) -> Model:
    """Fits on at most ``per_class`` ids of each class, each text of at most ``max_chars``.

    Which rows these are, null and repeated ones among them, ``labelled_sample`` says. Without labels every score is 0.5,
    with labels of one class all scores lie on its side.
    """
    return fit(*labelled_sample(docs, labels, label, eligible, per_class, max_chars, seed))


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a ``score`` column (replaced if there is one) from each whole text.

    Null texts count as empty; those score what measures of 0 are worth. Rows, repeated ones
    too, and all other columns stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score)
    schema = wider(docs, **{score: "double"})
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            values = [scorer.score((t.as_py() or "").encode()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(run, schema)


def predicted(score: str = "score") -> Column:
    return (F.col(score) >= 0.5).cast("int")
