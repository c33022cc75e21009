"""MinHash near-duplicates with b-bit signatures, confirmed on full sets of shingles.

1. Each text becomes the set of its word shingles, by 64-bit hashes. Its minima under ``length`` hash functions give a
   signature, the low ``BITS`` bits of all minima, packed; the first ``rows * bands`` of them give band keys (a hash of
   ``rows`` minima each).
2. Equal sets are one class. Classes that share a band key are candidates: two sets of similarity 0.8 share none of
   32 keys of 4 minima with a chance of 5 in 10^8.
3. Candidates are first compared by bit counts of their signatures: the share of equal entries, corrected for those
   that agree by chance, estimates the similarity; what is six standard errors below the threshold is left.
4. What is left is confirmed on full sets, and confirmed links are merged to components.

Members of a key are never all paired. First each class meets the least member of its keys that looks most like it.
Classes whose keys are then still divided get their rarest shingles among them. A class is left if too many of its
shingles occur in no other one; two are not told as a pair if their rarest shingles show that they cannot be similar
enough. Both are exact, so no link is lost. Members of different components meet in blocks of bounded size, each with
the most similar of each other component; last, what is still apart is confirmed pair by pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from spectroloom.llm.common import discard, encoded, joined_unevenly, slices, spaced, wider, written
from spectroloom.llm.graph import components

SEED = 42
#: Bits of a minimum that a signature keeps, and those of them in a long.
BITS, PER_LONG = 4, 16
LOWEST = 0x1111111111111111
MULTIPLIER = np.uint64(0xBF58476D1CE4E5B9)
#: Members of a block, and shingles of a task that confirms, about.
BLOCK, SHINGLES = 4096, 1_000_000
#: Members of small keys that a task compares, about, and the rarest shingles of a class that it gets.
ROWS, RAREST = 50_000, 256


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The distinct hashes of the shingles of each text, A-Z lower-cased, in order; of fewer words the whole sequence is
    one, of none there is none. A shingle's hash mixes the XXH64 of its words and their number."""
    import xxhash

    numbers, bounds, known = encoded([spaced(t.lower()) for t in texts])
    hashed = np.array([xxhash.xxh64_intdigest(w, SEED) for w in known.to_pylist()], np.uint64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        words = hashed[numbers[a:b]] if b > a else np.zeros(0, np.uint64)
        k = min(shingle, len(words))
        mixed = np.full(len(words) - k + 1 if k else 0, k, np.uint64)
        for i in range(k):
            mixed = (mixed ^ words[i : i + len(mixed)]) * MULTIPLIER
            mixed ^= mixed >> np.uint64(29)
        out.append(np.unique(mixed))
    return out


def hash_functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and summands of ``k`` linear hash functions modulo 2^32."""
    a, b = np.random.default_rng(SEED).integers(0, 1 << 32, (2, k), np.uint32)
    return a | np.uint32(1), b


def minima(hashes: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each function over the high halves of a set that is not empty."""
    a, b = functions
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    out, step = np.full(len(a), np.iinfo(np.uint32).max, np.uint32), max(1, (1 << 16) // len(a))
    room = np.empty((min(step, len(high)), len(a)), np.uint32)
    for k in range(0, len(high), step):
        part = high[k : k + step, None]
        values = np.multiply(part, a, out=room[: len(part)])
        values += b
        np.minimum(out, values.min(0), out=out)
    return out


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The low bits of minima, sixteen of them in a long."""
    low = ((least ^ least >> np.uint32(15)) & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    low = np.concatenate([low, np.zeros(-len(low) % PER_LONG, np.uint64)]).reshape(-1, PER_LONG)
    return np.bitwise_or.reduce(low << np.arange(0, 64, BITS, dtype=np.uint64), axis=1)


def least_agreement(similarity: float, k: int) -> int:
    """Equal entries of two signatures below which they are six standard errors below ``similarity``.

    Entries of different minima agree with chance C = 2^-BITS, so a share of s + (1 - s) C is expected to agree.
    """
    share = similarity + (1 - similarity) / (1 << BITS)
    return math.ceil(k * share - 6 * math.sqrt(k * share * (1 - share)))


def estimate(agreeing: float, k: int) -> float:
    """Similarity from the number of equal entries, corrected for those that agree by chance."""
    c = 1 / (1 << BITS)
    return max(0.0, (agreeing / k - c) / (1 - c))


def agreement(a: Column, b: Column, k: int) -> Column:
    """Equal entries of two signatures (arrays of longs), by bit counts."""

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(LOWEST)))

    return k - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda n, x: n + x)


def agreements(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Equal entries of all pairs of signatures of two blocks (rows of uint64)."""
    out = np.full((len(a), len(b)), k, np.int64)
    for c in range(a.shape[1]):
        d = a[:, None, c] ^ b[None, :, c]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        out -= np.bitwise_count(d & np.uint64(LOWEST))
    return out


def with_signatures(docs: DataFrame, shingle: int = 4, rows: int = 4, bands: int = 32, length: int = 768, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print, n_shingles, digest, bands, bits) of every row; without words digest, bands and bits are null.

    ``print`` is a hash of the text, ``digest`` 128 bits of the set.
    """
    import xxhash

    ids = docs.select(F.col(doc_id).alias("doc_id"))
    functions = hash_functions(length)
    width = 4 * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sizes, digests, keys, signatures = [], [], [], []
                for found in shingle_sets([t.as_py() or b"" for t in part.column(1).cast(pa.large_binary())], shingle):
                    sizes.append(len(found))
                    if not len(found):
                        digests.append(None), keys.append(None), signatures.append(None)
                        continue
                    least = minima(found, functions)
                    raw = least.tobytes()
                    digests.append(hashlib.sha256(found.tobytes()).digest()[:16])
                    keys.append(np.array([xxhash.xxh64_intdigest(raw[i * width : (i + 1) * width], i) for i in range(bands)], np.uint64).view(np.int64))
                    signatures.append(packed_bits(least).view(np.int64))
                longs = pa.list_(pa.int64())
                yield pa.record_batch([part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, longs), pa.array(signatures, longs)], ["doc_id", "print", "n_shingles", "digest", "bands", "bits"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text), F.xxhash64(text).alias("print")).mapInArrow(run, wider(ids, print="long", n_shingles="long", digest="binary", bands=ArrayType(LongType()), bits=ArrayType(LongType())))


def _confirmed(texts: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(u, v) of the pairs (task, u, v) whose full sets are similar enough; a task gets each of its texts once."""

    def check(sides: pa.Table, asked: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        raw, at = sides.column("text"), {c: i for i, c in enumerate(sides.column("cls").to_pylist())}

        def hashed(c: int) -> np.ndarray:
            if c not in sets:
                sets[c] = shingle_sets([raw[at[c]].cast(pa.large_binary()).as_py() or b""], shingle)[0]
            return sets[c]

        us, vs = asked.column("u").to_numpy(), asked.column("v").to_numpy()
        good = np.zeros(len(us), bool)
        for i, (u, v) in enumerate(zip(us.tolist(), vs.tolist(), strict=True)):
            a, b = sorted((hashed(u), hashed(v)), key=len)
            both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
            good[i] = 100 * both >= percent * (len(a) + len(b) - both)
        return pa.table({"u": us[good], "v": vs[good]})

    wanted = pairs.select("task", F.col("u").alias("cls")).union(pairs.select("task", F.col("v").alias("cls"))).distinct()
    sides = texts.join(wanted, "cls").select(F.col("task").alias("job"), "cls", "text")
    return sides.groupBy("job").cogroup(pairs.groupBy("task")).applyInArrow(check, "u long, v long")


def _rows_of(docs: DataFrame, prints: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(cls, text) of the classes ``wanted`` (cls, doc_id, print), each once; written. Texts are shuffled once."""
    rows = docs.select(F.col(doc_id).alias("id_of"), F.xxhash64(text).alias("print_of"), F.col(text).alias("text"))
    if prints.groupBy("doc_id", "print").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("id_of", "print_of").agg(F.first("text").alias("text"))
    return written(rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id_of")) & (F.col("print") == F.col("print_of"))).select("cls", "text"))


def _divided(met: DataFrame, state: DataFrame) -> DataFrame:
    """(key, cls) of the keys whose members are in several components; written."""
    rows = written(met.join(state.select("cls", "root"), "cls").select("key", "cls", "root"))
    keys = written(rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key"))
    return written(joined_unevenly(rows.select("key", "cls"), keys, "key"))


def _rarest(texts: DataFrame, live: DataFrame, shingle: int) -> DataFrame:
    """(cls, common, codes) of the classes ``live`` (cls) that have shingles in common with others of them: the number of
    those shingles, and the ``RAREST`` least of their codes, ascending; written. A code has the number of classes above 48
    bits of the hash, so the order is the same for all classes and begins with the rarest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets([t.as_py() or b"" for t in part.column(1).cast(pa.large_binary())], shingle)
                cls = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
                yield pa.record_batch([pa.array(cls), pa.array(np.concatenate(sets).view(np.int64))], ["cls", "hash"])

    each = written(texts.join(live, "cls").select("cls", "text").mapInArrow(cut, "cls long, hash long"))
    several = written(each.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1"))
    code = F.shiftleft(F.least("c", F.lit(32767)).cast("long"), 48).bitwiseOR(F.shiftrightunsigned("hash", 16))
    coded = joined_unevenly(each, several, "hash").select("cls", code.alias("code"))
    out = written(coded.groupBy("cls").agg(F.count("*").alias("common"), F.slice(F.sort_array(F.collect_list("code")), 1, RAREST).alias("codes")))
    discard(each), discard(several)
    return out


def in_common(codes: np.ndarray, bounds: np.ndarray, common: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """At most so many common shingles of the sets u[i] and v[i] (u ascending). Set x has ``common[x]`` shingles that others
    have, too, of which codes[bounds[x] : bounds[x + 1]] (numbered in their order) are the least, ascending. Below the last
    of a list that is cut both lists are whole; equal codes are counted, and of what lies above it the set with fewer of
    them may share all."""
    sizes = np.diff(bounds)
    last = np.full(len(sizes), np.iinfo(np.int64).max)
    last[sizes < common] = codes[bounds[1:][sizes < common] - 1]
    mark = np.zeros(codes.max(initial=0) + 1, bool)
    out = np.empty(len(u), np.int64)
    cuts = np.flatnonzero(np.diff(u)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(u)], strict=True) if len(u) else ():
        x, others = u[a], v[a:b]
        mine, ends = slice(bounds[x], bounds[x + 1]), np.cumsum(sizes[others])
        starts = ends - sizes[others]
        place = np.arange(ends[-1]) + np.repeat(bounds[others] - starts, sizes[others])
        edge = np.minimum(last[x], last[others])
        mark[codes[mine]] = True
        told = lambda hit: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(hit)]))  # noqa: E731, B023
        equal, whole = told(mark[codes[place]]), told(codes[place] < np.repeat(edge, sizes[others]))
        mark[codes[mine]] = False
        out[a:b] = equal + np.minimum(common[x] - np.searchsorted(codes[mine], edge), common[others] - whole)
    return out


def _blocks(met: DataFrame, state: DataFrame) -> DataFrame:
    """Members (key, i, j, block, is_top, cls, root, n, task) of the keys whose members are in several components, in the
    pairs of blocks (i, j) that have to meet. Members of the largest component of a key do not meet each other."""
    rows = written(met.select("key", "cls").join(state.select("cls", "root", "n"), "cls"))
    each = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    keys = each.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("top"), F.max("c").alias("most"), F.sum("c").alias("members"), F.count("*").alias("roots")).where("roots > 1")
    pieces = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK)).cast("int")
    one = F.col("members") <= BLOCK
    keys = written(keys.select("key", "top", "members", one.alias("one"), pieces(F.col("most")).alias("tops"), pieces(F.col("members") - F.col("most")).alias("rests")))
    # small keys with the same largest component meet in one task, where their pairs are told once
    piled = keys.where("one").groupBy("top").agg(F.ceil(F.sum("members") / ROWS).alias("piles"))
    dealt = joined_unevenly(rows, keys.join(piled, "top", "left").drop("members"), "key").withColumn("is_top", F.col("root") == F.col("top"))
    number = F.pmod(F.xxhash64("cls"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("rests"))).cast("int")
    number = F.when(F.col("one"), 0).when(F.col("is_top"), F.col("rests") + number).otherwise(number)
    dealt = dealt.withColumn("block", number)
    place = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    of_rest = F.transform(F.sequence(F.lit(0), F.col("rests") + F.col("tops") - 1), lambda o: place(F.least(o, F.col("block")), F.greatest(o, F.col("block"))))
    of_top = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda o: place(o, F.col("block")))
    places = F.when(F.col("one"), F.array(place(F.lit(0), F.lit(0)))).when(F.col("is_top"), of_top).otherwise(of_rest)
    tasks = max(1, rows.count() // ROWS)
    spread = dealt.select("key", "cls", "root", "n", "block", "one", "top", "is_top", "piles", F.explode(places).alias("p")).select("key", "cls", "root", "n", "block", "one", "top", "is_top", "piles", "p.i", "p.j")
    pile = F.when(F.col("piles") > 1, F.xxhash64("top", F.pmod(F.xxhash64("key"), F.col("piles")))).otherwise(F.pmod(F.xxhash64("top"), F.lit(tasks)))
    spread = spread.withColumn("task", F.when(F.col("one"), pile).otherwise(F.xxhash64("key", "i", "j"))).drop("top", "piles")
    return written(spread)


def _apart(met: DataFrame, state: DataFrame, k: int, percent: int, best: bool) -> DataFrame:
    """(task, u, v): pairs of different components that share a key and look similar enough; with ``best`` of each
    class only the most similar one of each other component in a pair of blocks. Each pair is confirmed in one task, which
    takes pairs of one comparing task, so that it gets each text once, and only so many that their texts fit."""
    least = least_agreement(percent / 100, k)

    def look(t: pa.Table, sides: pa.Table) -> pa.Table:
        t, sides = t.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("root", "ascending"), ("cls", "ascending")]), sides.sort_by("of")
        column = lambda c: t.column(c).to_numpy()
        place = np.stack([column("key"), column("i"), column("j")], 1)
        n, root, cls, block, is_top = column("n"), column("root"), column("cls"), column("block"), column("is_top")
        side = np.searchsorted(sides.column("of").to_numpy(), cls)
        lists = lambda c: pa.concat_arrays(sides.column(c).chunks)
        bits = lists("bits").flatten().to_numpy().view(np.uint64).reshape(len(sides), -1)
        codes, common = lists("codes"), sides.column("common").to_numpy()
        bounds = np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy())])
        codes = np.unique(codes.flatten().to_numpy(), return_inverse=True)[1]
        cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)], strict=True):
            rows = np.arange(a, b)
            i, j = place[a, 1:]
            # members of the largest component only meet others
            left, right = (rows[~is_top[a:b]], rows) if i == j else (rows[block[a:b] == i], rows[block[a:b] == j])
            for chunk in np.array_split(left, max(1, len(left) * len(right) // 250_000)):
                same = agreements(bits[side[chunk]], bits[side[right]], k)
                x, y = n[chunk][:, None], n[right][None, :]
                same[(root[chunk][:, None] == root[right][None, :]) | (100 * np.minimum(x, y) < percent * np.maximum(x, y))] = -1
                u, v = np.nonzero(same >= least)
                most = in_common(codes, bounds, common, side[chunk[u]], side[right[v]])
                far = 100 * most < percent * (n[chunk[u]] + n[right[v]] - most)
                same[u[far], v[far]] = -1
                if best and same.size:
                    starts = np.concatenate([[0], np.flatnonzero(np.diff(root[right])) + 1])
                    top = np.maximum.reduceat(same, starts, axis=1)
                    same[same < np.repeat(top, np.diff([*starts, len(right)]), axis=1)] = -1
                u, v = np.nonzero(same >= least)
                u, v = chunk[u], right[v]
                if best and len(u):  # of equally similar ones the first
                    first = np.unique(np.stack([u, root[v]]), axis=1, return_index=True)[1]
                    u, v = u[first], v[first]
                us.append(np.minimum(cls[u], cls[v]))
                vs.append(np.maximum(cls[u], cls[v]))
        pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1)
        return pa.table({"u": pairs[0], "v": pairs[1], "task": np.full(pairs.shape[1], t.column("task")[0].as_py())})

    members = _blocks(met, state)
    of = members.select(F.col("task").alias("job"), F.col("cls").alias("of")).distinct()
    sides = of.join(state.select(F.col("cls").alias("of"), "bits", "common", "codes"), "of")
    found = members.groupBy("task").cogroup(sides.groupBy("job")).applyInArrow(look, "u long, v long, task long")
    n = lambda c: state.select(F.col("cls").alias(c), F.col("n").alias(f"{c}_n"))
    pairs = written(found.groupBy("u", "v").agg(F.min("task").alias("task")).join(n("u"), "u").join(n("v"), "v"))
    discard(members)
    loads = written(pairs.groupBy("task").agg(F.ceil(F.sum(F.col("u_n") + F.col("v_n")) / (8 * SHINGLES)).alias("pieces")))
    piece = F.xxhash64("task", F.pmod(F.xxhash64("u", "v"), F.col("pieces")))
    return written(joined_unevenly(pairs, loads, "task").select("u", "v", F.when(F.col("pieces") > 1, piece).otherwise(F.col("task")).alias("task")))


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 4, rows: int = 4, bands: int = 32, length: int = 768, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, print) of every row: component_id is the least doc_id reachable by links.

    Two rows are linked if their sets of shingles have ``100 * intersection >= percent * union``. Null, empty and
    wordless texts have empty sets and are linked with nothing. Rows with a null id take part in links but never
    name a component (null if it has no other id). Equal texts and repeated rows are linked, rows are repeated as they
    are. Texts of any length are taken whole; other columns are ignored; an empty table gives no rows.
    """
    if not 0 < rows * bands <= length:
        raise ValueError("bands are made of minima of the signature")
    k = length
    prints = written(with_signatures(docs, shingle, rows, bands, length, doc_id, text))
    some = prints.where("digest is not null")
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print")
    classes = some.groupBy("digest").agg(F.min(named).alias("a"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cls"), "digest", "a.doc_id", "a.print", "n", "bands", "bits"))
    members = classes.select(F.explode("bands").alias("key"), "cls")
    shared = written(members.groupBy("key").agg(F.min("cls").alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", "hub"))
    met = written(joined_unevenly(members, shared, "key"))
    stars = written(met.where("cls <> hub").select("cls", "hub").distinct())
    candidates = stars.select("cls").union(stars.select("hub")).distinct()
    texts = _rows_of(docs, prints, classes.select("cls", "doc_id", "print").join(candidates, "cls"), doc_id, text)
    # each class and the least member of one of its keys, the one that looks most like it
    own = stars.join(classes.select("cls", "n", "bits"), "cls")
    hubs = classes.select(F.col("cls").alias("hub"), F.col("n").alias("hub_n"), F.col("bits").alias("hub_bits"))
    agree = agreement(F.col("bits"), F.col("hub_bits"), k)
    seen = joined_unevenly(written(own), hubs, "hub").where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")).select("cls", "hub", "n", agree.alias("same"))
    first = written(seen.where(F.col("same") >= least_agreement(percent / 100, k)).groupBy("cls").agg(F.max_by(F.struct("hub", "n"), F.struct("same", -F.col("hub"))).alias("h")).select("cls", "h.hub", "h.n"))
    weights = written(first.groupBy("hub").agg(F.ceil(F.sum("n") / SHINGLES).alias("pieces")))
    tasks = max(1, (first.agg(F.sum("n")).first()[0] or 0) // SHINGLES)
    task = F.when(F.col("pieces") > 1, F.xxhash64("hub", F.pmod(F.xxhash64("cls"), F.col("pieces")))).otherwise(F.pmod(F.xxhash64("hub"), F.lit(tasks)))
    pairs = written(joined_unevenly(first, weights, "hub").select(F.col("cls").alias("u"), F.col("hub").alias("v"), task.alias("task")))
    sides = written(classes.join(candidates, "cls").select("cls", "n", "bits"))
    roots = components(_confirmed(texts, pairs, shingle, percent))
    placed = lambda sides: sides.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    met = _divided(met, placed(sides))
    # a class that shares too few of its shingles with all others that are left can have no more links
    sides = written(sides.join(_rarest(texts, met.select("cls").distinct(), shingle), "cls").where(100 * F.col("common") >= percent * F.col("n")))
    for best in (True, False):
        state = written(placed(sides).select("cls", "n", "bits", "common", "codes", "root"))
        more = _apart(met, state, k, percent, best)
        if not more.limit(1).count():
            break
        found = written(_confirmed(texts, more, shingle, percent))
        if found.limit(1).count():
            # what was merged before stays a star, so that only new links take rounds
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(found))
    rooted = written(classes.join(roots, F.col("cls") == F.col("node"), "left").select("digest", "doc_id", F.coalesce("root", "cls").alias("root")))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = joined_unevenly(rooted, least, "root").select("digest", "component_id")
    out = ["doc_id", "n_shingles", "component_id", "print"]
    alone = prints.where("digest is null").withColumn("component_id", F.col("doc_id")).select(*out)
    return joined_unevenly(some.select("doc_id", "n_shingles", "print", "digest"), written(named), "digest").select(*out).unionByName(alone)
