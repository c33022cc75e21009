"""Merkle manifests against a tree built node by node."""

import hashlib

from conftest import DATA, duck, same_rows
from pyspark.sql import functions as F

from spectroloom.llm import merkle, queries


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def slow_tree(nodes):
    """(paths, root): of each node the texts left and right of it, level by level."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, o in enumerate(own):
            run = range(o // 3 * 3, min(o // 3 * 3 + 3, len(nodes)))
            paths[i].append(("".join(nodes[j] for j in run if j < o), "".join(nodes[j] for j in run if j > o)))
            own[i] = o // 3
        nodes = [sha(*nodes[j : j + 3]) for j in range(0, len(nodes), 3)]
    return paths, nodes[0] if nodes else None


def slow_manifest(rows):
    """[(source, order, leaf)] -> sorted (source, order, leaf, path, subroot, root)."""
    by = {}
    for s, o, d in rows:
        by.setdefault(s, []).append((o is not None, o or 0, d))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: slow_tree([d for *_, d in sorted(by[s])]) for s in sources}
    above, root = slow_tree([trees[s][1] for s in sources])
    out = []
    for s, up in zip(sources, above, strict=True):
        for (known, o, d), path in zip(sorted(by[s]), trees[s][0], strict=True):
            out.append((str(s), str(o if known else None), d, path + up, trees[s][1], root))
    return sorted(out)


def read(df):
    return sorted((str(r["s"]), str(r["o"]), r["leaf"], [tuple(x) for x in r["path"]], r["subroot"], r["root"]) for r in df.collect())


def test_query_against_sql(spark):
    same_rows(queries.op12_merkle(spark, f"{DATA}/sf0.01"), duck("sf0.01").execute(queries.OP12_SQL))


def test_trees_of_every_size_and_odd_keys(spark):
    rows = [(s, i, sha(str(s), str(i))) for s, n in ((None, 1), ("", 2), ("ä", 3), ("a", 4), ("b", 10), ("Z", 28)) for i in range(n)]
    rows += [("b", None, sha("x")), ("b", 3, sha("y")), ("b", 3, sha("y"))]
    df = spark.createDataFrame([(*r, "kept", 7) for r in rows], "s string, o long, leaf string, node string, path int")
    done = merkle.manifest(df, "leaf", "s", "o")
    assert read(done) == slow_manifest(rows)
    assert done.where("node = 'kept'").count() == len(rows)
    one = df.where("s is null")
    assert read(merkle.manifest(one, "leaf", "s", "o")) == slow_manifest(rows[:1])
    assert merkle.manifest(df.limit(0), "leaf", "s", "o").count() == 0


def test_more_than_one_block(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    rows = [(f"s{i % 13 if i < 60 else 1}", i, sha(str(i))) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, o long, leaf string")
    assert read(merkle.manifest(df, "leaf", "s", "o")) == slow_manifest(rows)


def test_any_change_breaks_the_proof(spark):
    docs = spark.createDataFrame([(i, "a", f"line\n{i}") for i in range(30)], "doc_id long, source string, text string")
    digest = merkle.leaf(F.col("doc_id"), F.col("text"))
    done = merkle.manifest(docs.withColumn("leaf", digest))
    changed = merkle.leaf(F.col("doc_id"), F.when(F.col("doc_id") == 7, "line 7").otherwise(F.col("text")))
    bad = done.where(merkle.folded(changed, F.col("path")) != F.col("root")).select("doc_id").collect()
    assert [r["doc_id"] for r in bad] == [7]
    assert spark.range(1).select(merkle.leaf(F.lit(None), F.lit("äb"), F.lit(5))).first()[0] == sha("-", "3:äb", "1:5")
