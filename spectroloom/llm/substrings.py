"""Removal of long repeated passages by suffix automata of reference shards.

A passage is repeated if a window of ``least`` words also starts in a document with a smaller id.
An automaton of the whole corpus cannot be broadcast, so the shards hold only what some stream
needs, and each stream meets only the shard it needs:

1. Documents are dealt into buckets of bounded size by a hash of their id.
2. Each window has an anchor, the least hash of the runs of ``least // 2`` words inside it. Buckets
   send their distinct anchors, and hear back which of them other documents have too.
3. For windows with such an anchor, buckets send a hash of 128 bits, least id and count, and hear
   back the first document of each repeated window. One entry a bucket and window: hot windows are
   aggregated before they move.
4. A first document's repeated passages are its reference shard; runs of windows of other documents
   that first occur in it are its streams. The shard's suffix automaton gives exact matching
   statistics of each stream, and words under a match of ``least`` words or more are removed: no
   hash decides what goes. Equal streams of a bucket travel and are read once. Shards whose windows
   occur very often are copied, at most once for four buckets that send streams, and the streams
   divided among the copies.

Hashes decide what is looked at: a repeat could stay only if two different windows had equal 128 bits
(among 10^13 windows, 100 TB of text, a chance of about 10^-13). The shards are not broadcast: the
repeated passages grow with the corpus, and every document would have to read all of them.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectroloom.llm.common import fanout, free, wider, written
from spectroloom.llm.simhash import pack

#: Bytes of text in a bucket, about.
BUCKET_BYTES = 8 << 20
#: Occurrences of a window from which its shard is copied, and the buckets that a copy answers at least.
HOT, SENDERS = 64, 4
BASE = 0x9E3779B97F4A7C15
SPACE = re.compile(rb"([\x20\x09-\x0d]+)")


class SuffixAutomaton:
    """Of several word sequences; recognises exactly their runs of consecutive words."""

    def __init__(self, sequences: Iterable[list] = ()):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        for words in sequences:
            self.add(words)

    def _state(self, moves: dict, link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A state for the runs of q that are as short as those that p leads to."""
        clone = self._state(self.next[q].copy(), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, word, q)
                continue
            p, new = last, self._state({}, 0, length[last] + 1)
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][word]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
            last = new

    def statistics(self, words: list) -> list[int]:
        """For each word, the length of the longest known run that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for word in words:
            while state and word not in nxt[state]:
                state = link[state]
                size = length[state]
            to = nxt[state].get(word)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out

    def covered(self, words: list, least: int) -> list[tuple[int, int]]:
        """Maximal spans [start, end) of words under known runs of at least ``least`` words."""
        spans: list[list[int]] = []
        for end, size in enumerate(self.statistics(words), 1):
            if size >= least:
                if spans and spans[-1][1] >= end - size:
                    spans[-1] = [min(spans[-1][0], end - size), end]
                else:
                    spans.append([end - size, end])
        return [(a, b) for a, b in spans]


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        for k, b in (("up", BASE), ("down", inverse)):
            a = np.full(n + n // 2, b, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _power(len(hashes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    return _mixed((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    out = x
    while 2 * width <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Bucket:
    """Words and windows of a bucket's documents, in a fixed order. Rows without an id have no windows."""

    def __init__(self, table: pa.Table, least: int):
        import xxhash

        h = xxhash.xxh64_intdigest
        rows = [(i, (t or "").encode()) for i, t in zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True)]
        self.prints = [h(t, 1) - (1 << 63) for _, t in rows]
        self.order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, self.prints[k]))
        self.rows = rows
        hashes, owner, starts, at = [], [], [], 0
        for k in self.order:
            i, t = rows[k]
            if i is None:
                continue
            words = t.split()
            if len(words) >= least:
                hashes.append(np.fromiter(map(h, words), np.uint64, len(words)))
                owner.append(k)
                starts.append(at)
                at += len(words)
        self.owner, self.starts = owner, np.array([*starts, at], np.int64)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        inside = np.ones(max(0, len(every) - least + 1), bool)
        for a in starts[1:]:
            inside[a - least + 1 : a] = False
        self.position = np.flatnonzero(inside)
        half = least // 2
        self.anchor = _sliding_min(_runs(every, half), least - half + 1)[self.position] if len(every) >= least else np.zeros(0, np.uint64)
        self.every, self.least = every, least
        self.ids = np.array([rows[k][0] for k in owner], np.int64)
        self.document = np.searchsorted(self.starts, self.position, side="right") - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and whether several documents of the bucket have them."""
        if not len(self.anchor):
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        ids = self.ids[self.document]
        values, at = np.unique(self.anchor, return_inverse=True)
        low, high = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), np.iinfo(np.int64).min)
        np.minimum.at(low, at, ids)
        np.maximum.at(high, at, ids)
        return values, low < high

    def keep(self, anchors: np.ndarray) -> None:
        """Only windows with one of these anchors stay; ``window`` and ``second`` are their 128 bits."""
        import xxhash

        near = np.isin(self.anchor, anchors)
        self.position, self.document = self.position[near], self.document[near]
        again = np.zeros(len(self.every), np.uint64)
        for d in np.unique(self.document):
            a, b = self.starts[d], self.starts[d + 1]
            again[a:b] = np.fromiter((xxhash.xxh64_intdigest(w, 2) for w in self.rows[self.owner[d]][1].split()), np.uint64, b - a)
        self.window, self.second = (_runs(x, self.least)[self.position] if len(self.position) else np.zeros(0, np.uint64) for x in (self.every, again))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows (two columns) with their least document and count; ``self.which`` leads back to them."""
        first, second, self.which = _distinct(self.window, self.second)
        least = np.full(len(first), np.iinfo(np.int64).max)
        if len(first):
            np.minimum.at(least, self.which, self.ids[self.document])
        return first, second, least, np.bincount(self.which, minlength=len(first))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of two columns, sorted, and which of them each row is."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return a[order][new], b[order][new], which


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return (x * np.uint64(BASE) >> np.uint64(33)).astype(np.int64) % parts


def _read(table: pa.Table, column: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(b, kind) for b in table.column(column).to_pylist()]


NAMES = ["bucket", "part", "kind", "a", "b", "c", "d"]
PACKED = "bucket long, part int, kind int, a binary, b binary, c binary, d binary"
SEGMENT = "first long, copies int, copy int, bucket long, reference boolean, words binary, members binary"
SPAN = "bucket long, doc long, print long, start long, stop long"


def _packed(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)


def removed_spans(docs: DataFrame, parts: int, least: int) -> DataFrame:
    """SPAN rows: words [start, stop) of (doc, print) that are repeats. ``docs`` has bucket, id (long) and text."""

    def anchors(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        values, several = Bucket(table, least).anchors()
        return _packed([(bucket, p, 0, a, b, b"", b"") for p, (a, b) in pack(_part(values, parts), [values, several.astype(np.uint8)], parts)])

    def recurring(table: pa.Table) -> pa.Table:
        sent = _read(table, "a", np.uint64)
        values, count = np.unique(np.concatenate(sent), return_counts=True)
        again = np.zeros(len(values), bool)
        again[count > 1] = True
        for s, several in zip(sent, _read(table, "b", np.uint8), strict=True):
            again[np.searchsorted(values, s[several > 0])] = True
        out = []
        for bucket, s in zip(table.column("bucket").to_pylist(), sent, strict=True):
            found = s[again[np.searchsorted(values, s)]]
            if len(found):
                out.append((bucket, 0, 0, found.tobytes(), b"", b"", b""))
        return _packed(out)

    def known(table: pa.Table, side: pa.Table) -> Bucket:
        bucket = Bucket(table, least)
        kind = side.column("kind").to_pylist()
        bucket.keep(np.concatenate([np.zeros(0, np.uint64), *(a for a, k in zip(_read(side, "a", np.uint64), kind, strict=True) if k == 0)]))
        return bucket

    def windows(table: pa.Table, side: pa.Table) -> pa.Table:
        if not table.num_rows or not side.num_rows:
            return _packed([])
        number = table.column("bucket")[0].as_py()
        values, second, first, count = known(table, side).windows()
        return _packed([(number, p, 1, *blobs) for p, blobs in pack(_part(values, parts), [values, second, first, count.astype(np.int64)], parts)])

    def firsts(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        sent = _read(table, "a", np.uint64)
        low, counts = (np.concatenate(_read(table, c, np.int64)) for c in "cd")
        values, _, at = _distinct(np.concatenate(sent), np.concatenate(_read(table, "b", np.uint64)))
        first, total = np.full(len(values), np.iinfo(np.int64).max), np.bincount(at, counts, len(values))
        np.minimum.at(first, at, low)
        # copies of a shard: a power of two, so that neighbouring windows agree
        wanted = np.minimum(total / HOT, np.bincount(at, minlength=len(values)) / SENDERS)
        copies = np.left_shift(1, np.ceil(np.log2(np.maximum(1, wanted))).astype(np.int64)) * (total > 1)
        ends = np.cumsum([len(s) for s in sent])
        # answers stand in the order of what each bucket sent
        return _packed([(bucket, part, 1, b"", first[i].tobytes(), copies[i].astype(np.int32).tobytes(), b"") for bucket, i in zip(table.column("bucket").to_pylist(), np.split(at, ends[:-1]), strict=True)])

    def segments(table: pa.Table, side: pa.Table) -> pa.Table:
        out: dict[tuple, list] = {}
        number = table.column("bucket")[0].as_py() if table.num_rows else 0
        if table.num_rows and side.num_rows:
            b = known(table, side)
            values, _, _, _ = b.windows()
            first, copies = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
            part = _part(values, parts)
            for k, p, f, c in zip(*(side.column(x).to_pylist() for x in ("kind", "part", "b", "c")), strict=True):
                if k == 1:
                    first[part == p], copies[part == p] = np.frombuffer(f, np.int64), np.frombuffer(c, np.int32)
            f, c, own = first[b.which], copies[b.which], b.ids[b.document]
            live = np.flatnonzero(c > 0)
            # a first document repeats a window itself: once is enough, and it is no stream of its own
            if len(live):
                reference = f[live] == own[live]
                _, once = np.unique(b.which[live], return_index=True)
                only = np.zeros(len(live), bool)
                only[once] = True
                live = live[~reference | only]
            if len(live):
                f, c, d, p, own = f[live], c[live], b.document[live], b.position[live], own[live]
                cut = np.flatnonzero((np.diff(p) != 1) | np.diff(f).astype(bool) | np.diff(c).astype(bool) | np.diff(d).astype(bool)) + 1
                words, held = [], -1
                for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(p)], strict=True):
                    if d[i] != held:
                        held = d[i]
                        words = b.rows[b.owner[held]][1].split()
                    start = int(p[i] - b.starts[held])
                    piece = b" ".join(words[start : int(p[j - 1] - b.starts[held]) + least])
                    reference = bool(f[i] == own[i])
                    members = out.setdefault((int(f[i]), int(c[i]), number % int(c[i]), reference, piece), [])
                    if not reference:
                        members.append((int(own[i]), b.prints[b.owner[held]], start))
        rows = [(f, c, copy, number, reference, piece, np.array(m, np.int64).tobytes()) for (f, c, copy, reference, piece), m in out.items()]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in SEGMENT.split(", ")]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

    def verified(table: pa.Table) -> pa.Table:
        shards: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
        columns = [table.column(x).to_pylist() for x in ("first", "copies", "copy", "bucket", "reference", "words", "members")]
        for first, copies, copy, bucket, reference, words, members in zip(*columns, strict=True):
            shards[first, copies, copy][0 if reference else 1].append(words if reference else (words, bucket, members))
        out = []
        for (first, _, _), (references, streams) in shards.items():
            if not streams:
                continue
            automaton = SuffixAutomaton(x.split() for x in sorted(set(references)))
            done: dict[bytes, list] = {}
            for words, bucket, members in streams:
                if words not in done:
                    done[words] = automaton.covered(words.split(), least)
                out += [(bucket, doc, mark, start + a, start + b) for doc, mark, start in np.frombuffer(members, np.int64).reshape(-1, 3).tolist() if first < doc for a, b in done[words]]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(x, pa.int64()) for x in columns], names=["bucket", "doc", "print", "start", "stop"])

    dealt = docs.select("bucket", "id", "text")
    sent = dealt.groupBy("bucket").applyInArrow(anchors, PACKED)
    heard = sent.groupBy("part").applyInArrow(recurring, PACKED)
    seen = dealt.groupBy("bucket").cogroup(heard.groupBy("bucket")).applyInArrow(windows, PACKED)
    answered = seen.groupBy("part").applyInArrow(firsts, PACKED)
    both = heard.union(answered)
    pieces = dealt.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(segments, SEGMENT)
    # a reference goes to every copy of its shard
    every = F.when(F.col("reference"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array("copy"))
    pieces = pieces.withColumn("copy", F.explode(every)).withColumn("shard", F.pmod(F.xxhash64("first", "copies", "copy"), F.lit(parts)))
    return pieces.groupBy("shard").applyInArrow(verified, SPAN)


def numbered(docs: DataFrame, doc_id: str, name: str) -> DataFrame:
    """``docs`` with a long column ``name`` that orders rows as ``doc_id`` does; null where that is null."""
    if docs.schema[doc_id].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        return docs.withColumn(name, F.col(doc_id).cast("long"))
    of, n = free(docs, "_of", "_n")
    ids = docs.select(F.col(doc_id).alias(of)).where(F.col(of).isNotNull()).distinct()
    # ids are sorted in ranges, and numbers grow from range to range; written, they stay what they are
    ids = written(ids.orderBy(of).withColumn(n, F.monotonically_increasing_id()))
    return docs.join(ids, F.col(doc_id) == F.col(of), "left").withColumnRenamed(n, name).drop(of)


def without_repeats(docs: DataFrame, least: int = 50, doc_id: str = "doc_id", text: str = "text", texts: bool = True, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept_sha256`` and, if ``texts``, ``kept`` in place of
    ``text``: what is left with the white space behind it, a text that loses nothing as it was.

    A word goes if it lies in a window of ``least`` words that also starts in a document with a
    smaller id; windows are judged on the input. Null and empty texts have no words and stay as they
    are; rows without an id neither lose words nor take any; repeated ids are judged row by row and
    never against each other. Columns of the names above are replaced, others stay, whatever they are
    called. Ids are compared as numbers if they are whole numbers, else in their own order. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    bucket, number = free(docs, "_bucket", "_number")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(fanout(spark), -(-size // bucket_bytes))
    dealt = numbered(docs, doc_id, number)
    dealt = dealt.withColumn(bucket, F.pmod(F.xxhash64(F.coalesce(F.col(number), F.xxhash64(text))), F.lit(buckets)))
    # a partition of windows gets entries from all buckets: about those of four buckets in all
    slim = dealt.select(F.col(bucket).alias("bucket"), F.col(number).alias("id"), F.col(text).alias("text"))
    spans = removed_spans(slim, max(fanout(spark), buckets // 4), least)
    plain = docs if texts else docs.select(doc_id)
    schema = wider(plain, n_words="long", n_removed="long", kept_sha256="string")
    names, at = schema.names, plain.columns
    # without texts and with ids that are numbers the last step reads what the first ones do: one shuffle of the texts
    shared = not texts and docs.schema[doc_id].dataType.simpleString() == "bigint"
    source = slim if shared else dealt if texts else dealt.select(bucket, number, doc_id, text)
    its_bucket, its_number, its_text = ("bucket", "id", "text") if shared else (bucket, number, text)

    def finish(table: pa.Table, side: pa.Table) -> pa.Table:
        import xxhash

        gone: dict[tuple, list] = defaultdict(list)
        for doc, mark, a, b in zip(*(side.column(x).to_pylist() for x in ("doc", "print", "start", "stop")), strict=True):
            gone[doc, mark].append((a, b))
        counts, removed, digests, kept = [], [], [], []
        for i, t in zip(table.column(its_number).to_pylist(), table.column(its_text).to_pylist(), strict=True):
            raw = (t or "").encode()
            words = raw.split()
            spans = gone.get((i, xxhash.xxh64_intdigest(raw, 1) - (1 << 63))) if gone else None
            counts.append(len(words))
            if spans:
                stays = np.ones(len(words), bool)
                for a, b in spans:
                    stays[a:b] = False
                removed.append(int(len(words) - stays.sum()))
                if texts:
                    pieces = SPACE.split(raw)
                    first = 0 if pieces[0] else 2  # words stand at every other place
                    t = b"".join(pieces[first + 2 * k] + (pieces[first + 2 * k + 1] if first + 2 * k + 1 < len(pieces) else b"") for k in np.flatnonzero(stays)).decode().strip(" \t\n\v\f\r")
                words = [words[k] for k in np.flatnonzero(stays)]
            else:
                removed.append(0)
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            kept.append(t)
        columns = {doc_id: table.column("id")} if shared else {c: table.column(c) for c in at}
        if texts:
            columns[text] = pa.array(kept, pa.string())
        columns |= {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table([columns[c] for c in names], names=names)

    return source.groupBy(its_bucket).cogroup(spans.groupBy("bucket")).applyInArrow(finish, schema)
