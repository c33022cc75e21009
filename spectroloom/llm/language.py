"""Language identification by partial matching (PPM).

For each language, counts of every byte behind its 0 to 3 preceding bytes form a context tree.
Its statistics are frozen after training; a byte costs, from the longest known context down,
the escape probability of each context that has not seen it (method C: distinct / (total +
distinct)) and then its own probability there, below all contexts 1/256. The language with the
least total code length is predicted, and the score is its posterior under equal priors.

Of each language the costs of the n-grams it has seen are held in sorted arrays. The distinct
four-byte grams of a slab of texts are looked up once for each language, the longest context first,
and summed by text with numpy: exact code lengths, not estimates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectroloom.llm.common import wider
from spectroloom.llm.sampling import documents_sample

ORDER = 3
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Bytes of text that are scored at once.
SLAB = 1 << 20


@dataclass(frozen=True)
class Model:
    """Of each language and order: the sorted n-grams (context and byte, big-endian) and counts."""

    languages: tuple[str, ...]
    grams: tuple[tuple[np.ndarray, ...], ...]
    counts: tuple[tuple[np.ndarray, ...], ...]


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for k in range(n):
        out = out << np.uint32(8) | data[k : k + len(out)]
    return out


def _padded(text: str) -> bytes:
    """Contexts of a text's first bytes are newlines."""
    return b"\n" * ORDER + text.encode()


def fit(samples: dict[str, list[str]]) -> Model:
    grams, counts = [], []
    names = tuple(sorted(samples))
    for name in names:
        data = np.frombuffer(b"".join(_padded(t) for t in samples[name]), np.uint8)
        both = [np.unique(_grams(data, n), return_counts=True) for n in range(1, ORDER + 2)]
        grams.append(tuple(b[0] for b in both))
        counts.append(tuple(b[1] for b in both))
    return Model(names, tuple(grams), tuple(counts))


def _place(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` stand in the sorted ``known``, and whether they do."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


class Scorer:
    """Of each language only what it has seen is held: costs of n-grams and escape costs of contexts.

    Memory follows the n-grams of the samples, not alphabets or the number of languages squared.
    """

    def __init__(self, model: Model):
        self.names = model.languages
        self.levels = []
        for grams, counts in zip(model.grams, model.counts, strict=True):
            of_language = []
            for gram, count in zip(grams, counts, strict=True):
                context, at = np.unique(gram >> np.uint32(8), return_inverse=True)
                total, distinct = np.bincount(at, count, len(context)), np.bincount(at, minlength=len(context))
                whole = total + distinct
                of_language.append((gram, np.log2(whole[at] / count), context, np.log2(whole / np.maximum(distinct, 1))))
            self.levels.append(of_language)

    def bits(self, language: int, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each of these four-byte grams behind the three others."""
        out, todo = np.zeros(len(grams)), np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            gram, cost, context, escape = self.levels[language][order]
            wanted = grams[todo] & np.uint32((1 << 8 * (order + 1)) - 1)
            at, seen = _place(gram, wanted)
            out[todo[seen]] += cost[at[seen]]
            todo, wanted = todo[~seen], wanted[~seen]
            at, seen = _place(context, wanted >> np.uint32(8))
            out[todo[seen]] += escape[at[seen]]
        out[todo] += 8.0
        return out

    def _sums(self, data: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Code lengths (piece, language) of the bytes [start, stop) of pieces of ``data``, each behind ORDER others."""
        grams, which = np.unique(_grams(np.frombuffer(data, np.uint8), ORDER + 1), return_inverse=True)
        out = np.zeros((len(starts), len(self.names)))
        for j in range(len(self.names)):
            sums = np.concatenate([[0.0], np.cumsum(self.bits(j, grams)[which])])
            out[:, j] = sums[stops - ORDER] - sums[starts - ORDER]
        return out

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths (text, language) of whole texts, each behind ORDER newlines."""
        out = np.zeros((len(texts), len(self.names)))
        lengths = [len(t) for t in texts]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + lengths[j] <= SLAB):
                size += lengths[j] + ORDER
                j += 1
            if j == i + 1 and lengths[i] > SLAB:
                whole = b"\n" * ORDER + texts[i]
                for k in range(ORDER, len(whole), SLAB):
                    piece = whole[k - ORDER : k + SLAB]
                    out[i] += self._sums(piece, np.array([ORDER]), np.array([len(piece)]))[0]
            else:
                stops = np.cumsum([n + ORDER for n in lengths[i:j]])
                out[i:j] = self._sums(b"".join(b"\n" * ORDER + t for t in texts[i:j]), stops - np.array(lengths[i:j]), stops)
            i = j
        return out


def train(docs: DataFrame, eligible: Column, lang: str = "lang", per_language: int = 200, max_chars: int = 10_000, seed: int = 6) -> Model:
    """Fits on at most ``per_language`` texts of at most ``max_chars`` for each language, however many there are.

    Which rows these are, null and repeated ones among them, ``documents_sample`` says. Without a row to learn from there are no languages.
    """
    return fit(documents_sample(docs, lang, eligible, per_language, max_chars, seed))


def identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (replaced if there).

    Texts that are null, empty or without a letter are ``und`` with score 0, as is everything if no
    language was learned. Ties go to the first language by name. Rows and other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = wider(docs, lang_pred="string", score="double")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value.languages else None
        for batch in batches:
            texts = [t.as_py() for t in batch.column(at)]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            live = [i for i, t in enumerate(texts) if t and any(m[0].isalpha() for m in LETTER.finditer(t))] if scorer else []
            if live:
                totals = scorer.totals([texts[i].encode() for i in live])
                best = totals.argmin(1)
                odds = np.exp2(-(totals - totals.min(1, keepdims=True)))
                scores[live] = 1 / odds.sum(1)
                for i, b in zip(live, best, strict=True):
                    names[i] = scorer.names[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
