"""The pipeline, stage by stage, against plain Python over small tables."""

import corpus_pipeline
import pytest
from conftest import DATA
from test_dedup import classes, naive_removed, slow_fingerprint
from test_scans import naive

from spectroloom.llm import common, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(common.written(stage(spark, out[-1], f"{DATA}/sf0.01")))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "simhash", "substrings", "decontamination", "mixing"]
    assert all(s.columns == COLUMNS for s in stages[:-1])
    counts = [s.count() for s in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_quality_keeps_good_documents(spark, stages):
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    kept = stages[1].select("doc_id")
    good, bad = labels.where("quality = 1"), labels.where("quality = 0")
    assert good.join(kept, "doc_id").count() >= 0.98 * good.count()
    assert bad.join(kept, "doc_id").count() <= 0.2 * bad.count()


def test_one_of_each_group(stages):
    before, after = rows(stages[1]), rows(stages[2])
    want = classes([(i, slow_fingerprint(r["text"])) for i, r in before.items()])
    assert set(after) == set(want.values())


def test_repeats_go(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = {i: (n, k, t) for i, n, k, t in naive_removed([(i, (r["text"] or "").split()) for i, r in before.items()], 50)}
    assert set(after) == {i for i, (n, k, _) in want.items() if not k or k < n}
    for i, r in after.items():
        assert " ".join((r["text"] or "").split()) == want[i][2]
        assert want[i][1] or r["text"] == before[i]["text"]


def test_contaminated_documents_go(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet").collect()]
    before = rows(stages[3])
    bad = {d for d, _, _, _, c in naive([(i, r["text"]) for i, r in before.items()], items, 13) if c}
    assert set(rows(stages[4])) == set(before) - bad


def test_mixture(stages):
    before, after = rows(stages[4]), rows(stages[5])
    sizes = {}
    for r in before.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").split())
    names = sorted(sizes)
    want = dict(zip(names, mixing.water_fill([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2), strict=True))
    taken = dict.fromkeys(names, 0)
    for r in after.values():
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, f"{DATA}/sf0.001"))
    assert docs.count() == 0


def test_odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    from pyspark.sql import functions as F

    prose = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select(*COLUMNS).limit(60)
    long = " ".join(f"palabra{k % 977} the{k}" for k in range(60_000))
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (9001, None, "en", "src0", 0), (9002, "", None, None, None), (9003, long, "en", None, None), (9004, "one", "en", "src1", 3), (9004, "one", "en", "src1", 3), (None, "loose words", "en", "src1", None), (9005, " \n\t ", None, "", 4)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs = prose.unionByName(odd)
    for name in ("score", "size", "taken", "target", "n", "fp", "root", "component_id", "n_words", "n_removed", "kept_sha256", "bucket", "items", "phrase", "term", "pos", "start", "words", "repeats", "label"):
        docs = docs.withColumn(name, F.lit(f"mine {name}"))
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, f"{DATA}/sf0.001"))
        counts.append(docs.count())
        assert docs.columns[:5] == COLUMNS
        if k == 1:
            # one wordless document at most is left, and one row of the repeated ones
            assert docs.where(~F.coalesce("text", F.lit("")).rlike(r"\S")).count() <= 1
            assert docs.where("doc_id = 9004").count() <= 1
    assert counts == sorted(counts, reverse=True)


def test_near_duplicate_stage_states_its_rule():
    import inspect

    from spectroloom.llm import simhash

    said, rule = " ".join(corpus_pipeline.one_of_each.__doc__.split()), inspect.signature(simhash.representatives).parameters
    assert f"{rule['shingle'].default}-word shingles at most {rule['most'].default} of 64 bits" in said and "Jaccard similarity" in said
