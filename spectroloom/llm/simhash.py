"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint has two segments of 32 bits. Two fingerprints that differ in at most 3 bits
differ in at most 1 bit of one segment, so every fingerprint looks up the 33 values within one bit
of each of its segments in the table of segment values and verifies complete distances. Equal
fingerprints meet once. What meets under one value is linked by a spanning forest (every member to
the least of its part), never by all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectroloom.llm.common import fanout, free, wider, written
from spectroloom.llm.graph import components

SEED = 42
SEGMENT = 32
#: Look-ups (13 bytes each) of a partition, about.
PROBES = 8_000_000
#: Members that are compared with each other at once; more are divided by pieces of the bits that they don't share.
TOGETHER = 1024


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a text: words split at ASCII white space, A-Z lower-cased, XXH64 of each shingle."""
    import xxhash

    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    if n <= shingle:
        return h(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, n) - 1)[: n - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1 :].tolist()
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n - shingle + 1)
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, print): the fingerprint as a signed long and a hash of the text, which tells rows
    of the same id apart. Null and wordless texts have fingerprint 0. Ids keep their type."""
    ids = docs.select(F.col(doc_id).alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["doc_id", "fp", "print"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text), F.xxhash64(text)).mapInArrow(run, wider(ids, fp="long", print="long"))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(members: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (member, least of its part) of distinct fingerprints linked at ``most`` bits."""
    rest, us, vs = np.sort(members), [], []
    while len(rest):
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            near = _popcount(rest ^ todo.pop()) <= most
            if near.any():
                found = rest[near]
                us.append(found)
                vs.append(np.full(len(found), root))
                todo.extend(found)
                rest = rest[~near]
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


def close_links(members: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All links of a few members, or a spanning forest where they are many."""
    u, v = np.nonzero(_popcount(members[:, None] ^ members[None, :]) <= most)
    u, v = u[u > v], v[u > v]
    return forest(members, most) if len(u) > 4 * len(members) else (members[u], members[v])


def links_within(members: np.ndarray, most: int, bits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """As ``forest``, of members that differ in ``bits`` (positions; all by default), divided before they are compared.

    Linked fingerprints have at least one of ``most + 1`` pieces of the bits in common, so members are grouped by the
    value of each piece, and large groups by pieces of the bits that are left. Members of a large group that share all
    but ``most`` of the bits are few: they differ in what is left and in one bit of the segment under which they meet.
    """
    bits = np.arange(64) if bits is None else bits
    if len(members) <= TOGETHER:
        return close_links(members, most)
    if len(bits) <= most:
        return forest(members, most)
    us, vs = [], []
    for piece in np.array_split(bits, most + 1):
        part = members & np.bitwise_or.reduce(np.uint64(1) << piece.astype(np.uint64))
        order, rest = np.argsort(part, kind="stable"), np.setdiff1d(bits, piece)
        for group in np.split(members[order], np.flatnonzero(np.diff(part[order])) + 1):
            if len(group) > 1:
                u, v = links_within(group, most, rest)
                us.append(u)
                vs.append(v)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *us]), np.concatenate([empty, *vs])


def pack(part: np.ndarray, columns: list[np.ndarray], parts: int) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of equal part as one value each: (part, the columns' bytes)."""
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    columns = [c[order] for c in columns]
    for p in range(parts):
        a, b = cuts[p], cuts[p + 1]
        if a < b:
            yield p, [c[a:b].tobytes() for c in columns]


def links(fps: DataFrame, most: int = 3, fp: str = "fp") -> DataFrame:
    """Links (u, v) among the distinct fingerprints of ``fps`` that connect exactly what differs in
    at most ``most`` (up to 3) bits. Values travel packed, a row for each batch and partition."""
    if not 0 <= most <= 3:
        raise ValueError("two segments with one bit of play each find at most 3 differing bits")
    # a partition of look-ups stays below about 100 MB however many fingerprints there are
    parts = max(fanout(fps.sparkSession), fps.count() * 33 // PROBES)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = np.concatenate([[0], 1 << np.arange(SEGMENT)]).astype(np.uint64)
        for batch in batches:
            x = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for chunk in np.array_split(x, max(1, len(x) // 50_000)):
                out = []
                for segment in range(2):
                    value = chunk >> np.uint64(SEGMENT * segment) & np.uint64((1 << SEGMENT) - 1)
                    # column 0 of the ball is the value itself: the table's entry
                    keys = (value[:, None] ^ balls[None, :]).ravel()
                    part = ((keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
                    own = np.zeros((len(chunk), len(balls)), np.uint8)
                    own[:, 0] = 1
                    out += [(p, segment, *b) for p, b in pack(part, [keys.astype(np.uint32), np.repeat(chunk, len(balls)), own.ravel()], parts)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.array([o[0] for o in out], np.int32), np.array([o[1] for o in out], np.int32), [o[2] for o in out], [o[3] for o in out], [o[4] for o in out])], ["part", "segment", "keys", "fps", "own"])

    def match(key: tuple, t: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(b.as_py(), kind) for b in t.column(c)])
        keys, x, own = read("keys", np.uint32), read("fps", np.uint64), read("own", np.uint8).astype(bool)
        present = np.unique(keys[own])
        at = np.minimum(np.searchsorted(present, keys), len(present) - 1) if len(present) else np.zeros(len(keys), int)
        hit = present[at] == keys if len(present) else np.zeros(len(keys), bool)
        keys, x = keys[hit], x[hit]
        order = np.lexsort((x, keys))
        keys, x = keys[order], x[order]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        # members under one value share that segment but for a bit; the other one tells them apart
        other = np.arange(SEGMENT) + (0 if key[1].as_py() else SEGMENT)
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            if b - a > 1:
                u, v = links_within(x[a:b], most, other)
                us.append(u)
                vs.append(v)
        pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
        return pa.table({"u": pa.array(pairs[:, 0].copy().view(np.int64)), "v": pa.array(pairs[:, 1].copy().view(np.int64))})

    packed = fps.select(F.col(fp).alias("fp")).mapInArrow(probe, "part int, segment int, keys binary, fps binary, own binary")
    return packed.groupBy("part", "segment").applyInArrow(match, "u long, v long")


def near_duplicates(docs: DataFrame, most: int = 3, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, print, root, component_id) of every row: component_id is the least doc_id reachable
    by links, root a fingerprint that stands for the component.

    Null or empty texts have fingerprint 0 and are linked like any other. Rows with a null id take
    part in links but never name a component (null if it has no other id). Repeated rows are
    repeated. Other columns are ignored; an empty table gives no rows.
    """
    prints = written(with_fingerprints(docs, doc_id, text, shingle))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct.repartition(fanout(docs.sparkSession), "fp"), most))
    rooted = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return prints.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "print", "root", "component_id")


def representatives(docs: DataFrame, most: int = 3, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates: that of its least id, all columns as they were.

    Rows without an id count as the last of a group. Rows of equal id are ordered by a hash of their
    text, rows of equal id and text by a hash of all their columns but maps, so that reruns agree; of
    rows that are equal in all this one stays. Extra columns may have any name.
    """
    found = written(near_duplicates(docs, most, shingle, doc_id, text))
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")).alias("k"))
    id_, print_, row_, i, p, r = free(docs, "_id", "_print", "_row", "_i", "_p", "_r")
    keys = keep.select(F.col("k.doc_id").alias(id_), F.col("k.print").alias(print_))
    same = F.col(doc_id).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(print_))
    if not found.groupBy("doc_id", "print").count().where("count > 1").limit(1).count():
        return docs.join(keys, same, "left_semi")
    # repeated rows: both steps are combined before they are shuffled, however many rows are equal
    kept = docs.join(keys, same).withColumn(row_, F.xxhash64(*[f.name for f in docs.schema.fields if "map" not in f.dataType.simpleString()]))
    least = kept.groupBy(id_, print_).agg(F.min(row_).alias(row_))
    first = least.select(F.col(id_).alias(i), F.col(print_).alias(p), F.col(row_).alias(r))
    return kept.join(first, F.col(id_).eqNullSafe(F.col(i)) & (F.col(print_) == F.col(p)) & (F.col(row_) == F.col(r)), "left_semi").dropDuplicates([id_, print_]).drop(id_, print_, row_)
