import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from spectroloom.llm import language, quality, queries, sampling, toxicity


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(len(scores))
    p = np.asarray(labels) == 1
    return (ranks[p].sum() - p.sum() * (p.sum() - 1) / 2) / (p.sum() * (~p).sum())


def held(spark, sf, query, label):
    got = query(spark, f"{DATA}/{sf}")
    labels = spark.read.parquet(f"{DATA}/{sf}/labels.parquet").select("doc_id", label)
    return got, got.join(labels, "doc_id").where("held_out").toPandas()


def test_quality_held_out(spark):
    got, h = held(spark, "sf0.1", queries.op3_quality, "quality")
    assert got.count() == 10_000
    assert auc(h["score"], h["quality"]) > 0.99
    assert (h["predicted"] == h["quality"]).mean() > 0.97
    assert h[h["quality"] == 1]["predicted"].mean() > 0.98
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) for i in h["doc_id"])


def test_toxicity_held_out(spark):
    got, h = held(spark, "sf0.1", queries.op10_toxicity, "toxic")
    assert got.count() == 10_000
    assert auc(h["score"], h["toxic"]) > 0.97
    assert (h["predicted"] == h["toxic"]).mean() > 0.96
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) for i in h["doc_id"])


def test_language_held_out(spark):
    got = queries.op6_language(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_code_lengths_are_those_of_the_definition():
    model = language.fit({"a": ["hello world hello", "yellow"], "b": ["zzz zz bonjour", "été"]})
    scorer = language.Scorer(model)
    texts = ["hello", "zz été!", "", "unseen ~ Ω", "yellow hello zzz"]
    data = {"a": ["hello world hello", "yellow"], "b": ["zzz zz bonjour", "été"]}
    for j, name in enumerate(scorer.names):
        counts = [{} for _ in range(4)]
        joined = b"".join(b"\n\n\n" + t.encode() for t in data[name])
        for order in range(4):
            for i in range(len(joined) - order):
                c = counts[order].setdefault(joined[i : i + order], {})
                c[joined[i + order]] = c.get(joined[i + order], 0) + 1
        for text, got in zip(texts, scorer.totals([t.encode() for t in texts])[:, j], strict=True):
            whole, bits = b"\n\n\n" + text.encode(), 0.0
            for i in range(3, len(whole)):
                for order in (3, 2, 1, 0, -1):
                    if order < 0:
                        bits += 8
                        break
                    c = counts[order].get(whole[i - order : i])
                    if c is None:
                        continue
                    total, distinct = sum(c.values()), len(c)
                    if whole[i] in c:
                        bits -= np.log2(c[whole[i]] / (total + distinct))
                        break
                    bits -= np.log2(distinct / (total + distinct))
            assert got == pytest.approx(bits, abs=1e-3)


def test_slabs_do_not_change_code_lengths(monkeypatch):
    model = language.fit({"a": ["hello world hello"], "b": ["zzz zz bonjour"]})
    texts = [b"hello " * 30, b"", b"zz" * 50, b"x"]
    whole = language.Scorer(model).totals(texts)
    monkeypatch.setattr(language, "SLAB", 17)
    assert np.allclose(language.Scorer(model).totals(texts), whole, atol=1e-3)


ODD = [(1, None), (2, ""), (3, "   \n"), (4, "12 34 !!"), (5, "word " * 100_000), (None, "hello"), (6, "same"), (6, "same"), (7, "\x00é😀")]


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("old")).withColumn("lang_pred", F.lit(9)).withColumn("extra", F.lit(5))


def test_odd_rows(spark):
    q = quality.scored(odd(spark), quality.fit([(1, "good words here " * 20), (0, "!! $$ ## " * 30)] * 8)).collect()
    t = toxicity.scored(odd(spark), toxicity.fit([(0, "fine words"), (1, "awful idiot words")] * 20)).collect()
    lang = language.identified(odd(spark), language.fit({"en": ["hello word"], "fr": ["bonjour été"]})).collect()
    for rows in (q, t, lang):
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["extra"] == 5 for r in rows)
    by = {(r["doc_id"], r["text"]): r for r in lang}
    assert [by[i, x]["lang_pred"] for i, x in ODD[:4]] == ["und"] * 4
    assert by[None, "hello"]["lang_pred"] == "en"
    null_and_empty = {r["score"] for r in q if not r["text"]}
    assert len(null_and_empty) == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    every = F.lit(True)
    assert quality.scored(docs, quality.train(docs, labels, every)).count() == 0
    assert toxicity.scored(docs, toxicity.train(docs, labels, every)).count() == 0
    assert language.identified(docs, language.train(docs, every)).count() == 0
    one = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    assert language.identified(one, language.train(docs, every)).first()["lang_pred"] == "und"
    assert quality.scored(one, quality.train(docs, labels, every)).first()["score"] == pytest.approx(0.5)


def test_samples_are_bounded_and_repeatable(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"))
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("quality"))
    got, totals = sampling.labelled_sample(docs, labels, "quality", F.lit(True), 100, 1000, 1)
    assert totals == {0: 4500, 1: 500}
    weights = sampling.class_weights([y for y, _ in got], totals)
    assert sum(w for w, (y, _) in zip(weights, got, strict=True) if not y) == pytest.approx(0.9 * sum(weights))
    assert sum(1 for y, _ in got if y) == 100 and sum(1 for y, _ in got if not y) == 100
    assert got == sampling.labelled_sample(docs.repartition(7), labels.repartition(5), "quality", F.lit(True), 100, 1000, 1)[0]


def test_isotonic_and_trees():
    x, v = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert list(v) == [0.0, 0.5, 1.0] and (np.diff(x) > 0).all()
    rng = np.random.default_rng(1)
    a = rng.normal(size=(600, 3))
    y = ((a[:, 0] > 0) ^ (a[:, 1] > 0)).astype(float)
    assert ((toxicity.boost(a, y, trees=60).raw(a) > 0) == y).mean() > 0.95


def test_obfuscated_words_count():
    lexicon = {b"idiot": 5.0}
    plain = toxicity.features("such a fine day", lexicon)
    at = toxicity.FEATURES.index("obfuscated")
    assert plain[at] == 0
    assert toxicity.features("you 1d10t there, i-d-i-o-t", lexicon)[at] > 0
    assert toxicity.features("you idiot", lexicon)[toxicity.FEATURES.index("near_second_person")] > 0


def test_every_language_is_learned(spark):
    """More than 200 languages, and one that has only long texts; each is written in letters of its own."""
    letters = lambda k: f"{chr(0x4E00 + 2 * k)}{chr(0x4E01 + 2 * k)}"
    rows = [(k * 3 + j, letters(k) * (9 + j), f"l{k:03}") for k in range(215) for j in range(2 if k > 200 else 3)]
    rows += [(9000, letters(300) * 6000, "long"), (9001, letters(301) * 20, "l000"), (9002, letters(302) * 6000, "l000")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sampling.documents_sample(docs, "lang", F.lit(True), 200, 10_000, 6)
    assert set(got) == {r[2] for r in rows}
    assert got["long"] == [(letters(300) * 6000)[:10_000]]
    assert sorted(got["l000"]) == sorted([letters(0) * 9, letters(0) * 10, letters(0) * 11, letters(301) * 20])
    few = docs.where("doc_id < 6 or doc_id > 640 or lang = 'long'")
    model = language.train(few, F.lit(True))
    assert {"l000", "l214", "long"} <= set(model.languages)
    said = {r["doc_id"]: r["lang_pred"] for r in language.identified(few, model).collect()}
    assert said[9000] == "long" and said[642] == "l214" and said[0] == "l000"


def test_samples_of_languages_are_those_of_each_alone(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("lang"))
    got = sampling.documents_sample(docs, "lang", F.lit(True), 50, 1000, 6)
    for name, n in (("a", 300), ("b", 2700)):
        ids = sampling._drawn(docs.where(F.col("lang") == name).select(F.col("doc_id").alias("_id")), "_id", n, 50, 6)
        assert sorted(got[name]) == sorted(f"t {r['_id']}" for r in ids.collect())


def test_obfuscated_words_count_at_any_white_space_and_length():
    lexicon = {b"idiot": 5.0}
    at = toxicity.FEATURES.index("obfuscated")
    for text in ("x i*d*i*o*t y", "x i*d*i*o*t\ny", "x\ti*d*i*o*t\r\n", "x i" + "*" * 60 + "d*i*o*t y"):
        assert toxicity.features(text, lexicon)[at] == pytest.approx(1 / max(1, len(toxicity.words_of(text)))), text


def test_lexicon_keeps_every_word_above_the_bound():
    sets = [frozenset({b"w%d" % k for k in range(6000)})] * 40 + [frozenset({b"fine"})] * 40
    assert len(toxicity.learn_lexicon(sets, np.array([1.0] * 40 + [0.0] * 40))) == 6000


def test_samples_of_repeated_ids_stay_bounded(spark):
    docs = spark.range(5000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(5000).select(F.lit(7).alias("doc_id"), F.lit(1).alias("quality"))
    got, totals = sampling.labelled_sample(docs, labels, "quality", F.lit(True), 10, 1000, 1)
    assert got == [(1, "t 0")] and totals == {1: 5000}
    assert sampling.documents_sample(docs, "lang", F.lit(True), 10, 1000, 6) == {"en": ["t 0"]}
    both = spark.createDataFrame([(7, 0), (7, 1), (None, 1), (8, None), (9, 3)], "doc_id int, quality int")
    assert sampling.labelled_sample(docs, both, "quality", F.lit(True), 10, 1000, 1)[0] == [(0, "t 0"), (1, "t 0")]


def test_memory_of_the_scorer_follows_the_samples_and_not_the_alphabet():
    rng = np.random.default_rng(0)
    samples = {f"l{k:03}": ["".join(map(chr, rng.integers(0x4E00, 0x9000, 300)))] for k in range(120)}
    model = language.fit(samples)
    held = sum(a.nbytes for levels in language.Scorer(model).levels for level in levels for a in level)
    assert held < 12 * sum(g.nbytes + 8 * len(g) for grams in model.grams for g in grams)
    texts = [t[0].encode() for t in samples.values()]
    assert (language.Scorer(model).totals(texts).argmin(1) == np.arange(120)).all()


def slow_features(text, lexicon):
    """The features from their definitions, word by word."""
    import math
    import re

    lower = text.lower().encode()
    punctuation = {c for c in range(33, 127) if not chr(c).isalnum()}
    words = bytes(32 if c in punctuation else c for c in lower).split()
    n, size = max(1, len(words)), max(1, len(text.encode()))
    hits = [i for i in range(len(words)) if words[i] in lexicon]
    near = sum(any(words[k] in toxicity.SECOND_PERSON for k in range(max(0, i - 5), min(len(words), i + 6))) for i in hits)
    mixed, hidden = 0, []
    for token in re.split(rb"[ \t\n\v\f\r]+", lower):
        if re.search(rb"[a-z\x80-\xff][0-9@$!|*.\-_]+[a-z\x80-\xff]", token):
            mixed += 1
            token = token.strip(b".,;:?\"'()")
            for leet, letter in zip(b"013457@$!|", b"oieastasil", strict=True):
                token = token.replace(bytes([leet]), bytes([letter]))
            token = bytes(c for c in token if c not in b"*.-_")
            hidden += [lexicon[token]] if token in lexicon else []
    share = lambda wanted: sum(c in wanted for c in text.encode()) / size
    weights, found = [lexicon[words[i]] for i in hits], len(hits) + len(hidden)
    return [
        (sum(weights) + sum(hidden)) / n, found / n, math.log(1 + found), math.log(1 + len({words[i] for i in hits})), max([0.0, *weights]), near / n, sum(w in toxicity.SECOND_PERSON for w in words) / n,
        share(range(65, 91)), share(b"!?"), share(punctuation), len(hidden) / n, mixed / n, math.log(1 + len(words)),
    ]


def slow_toxicity(text, model):
    """Trees walked node by node, then the isotonic curve by hand."""
    import bisect
    import math

    x, raw = slow_features(text, model.lexicon), model.trees.base
    for tree in model.trees.trees:
        at = 0
        while tree[at][0] >= 0:
            feature, cut, left, right, _ = tree[at]
            at = left if bisect.bisect_right(list(model.trees.edges[feature]), x[feature]) <= cut else right
        raw += model.trees.rate * tree[at][4]
    k = bisect.bisect_right(list(model.at), raw)
    if k == 0 or k == len(model.at):
        level = model.value[min(k, len(model.at) - 1)]
    else:
        a, b = model.at[k - 1], model.at[k]
        level = model.value[k - 1] + (model.value[k] - model.value[k - 1]) * (raw - a) / (b - a)
    return min(1.0, max(0.0, 0.998 * level + 0.002 / (1 + math.exp(-raw))))


def flipped(spark, tmp_path, modulus, held_out):
    """The tables of sf0.001 with the labels of held-out rows turned round."""
    spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.001/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % modulus == held_out
    turned = [F.when(out, 1 - F.col(c)).otherwise(F.col(c)).cast(labels.schema[c].dataType).alias(c) for c in ("quality", "toxic")]
    labels.select("doc_id", *turned).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_toxicity_query_against_plain_python(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, f"{DATA}/sf0.001").collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        want = slow_toxicity(texts[i] or "", model)
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == (want >= 0.5) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    again = {r["doc_id"]: r["score"] for r in queries.op10_toxicity(spark, flipped(spark, tmp_path, 5, 0)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_quality_query_against_plain_python(spark, tmp_path):
    import math

    import zstandard

    docs, labels = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)

    def size_of(piece, dictionary):
        plain = zstandard.ZstdCompressionDict(dictionary)
        return len(zstandard.ZstdCompressor(level=3, dict_data=plain, write_checksum=False, write_content_size=False, write_dict_id=False).compress(piece))

    def slow(raw):
        good, bad = (sum(size_of(raw[k : k + 2048], d) for k in range(0, len(raw), 2048)) for d in (model.good, model.bad))
        x = [(bad - good) / (good + bad), math.log((good + bad) / 2 / len(raw))] if raw else [0.0, 0.0]
        a, b, c, offset = model.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x[0] + b * x[1] + c * x[1] ** 2 + offset))))

    got = {r["doc_id"]: r for r in queries.op3_quality(spark, f"{DATA}/sf0.001").collect()}
    for r in docs.collect():
        raw, row = (r["text"] or "").encode(), got.pop(r["doc_id"])
        if len(raw) < 30_000:
            assert row["score"] == pytest.approx(slow(raw), abs=0.02) and row["predicted"] == (row["score"] >= 0.5)
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert not got
    same = [{r["doc_id"]: r["score"] for r in queries.op3_quality(spark, d).collect()} for d in (f"{DATA}/sf0.001", flipped(spark, tmp_path, 3, 1))]
    assert same[0] == same[1]


def test_logistic_curve_is_the_likeliest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) * [0.1, 2, 5]
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [8, 0.5, -0.2] + 0.3)))).astype(float)
    w = rng.random(500) + 0.5
    loss = lambda v: float((w * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v[:3] + v[3]))).sum())
    best = np.array(quality.logistic(x, y, w, 1e-9))
    assert all(loss(best) <= loss(best + d) + 1e-9 for d in rng.normal(size=(50, 4)) * 0.05)


def test_copies_count_once_in_the_lexicon():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    prose = lambda: " ".join(rng.choice(words, 40))
    fine = [(0, prose()) for _ in range(150)]
    rude = [(1, f"{prose()} awful idiot") for _ in range(60)]
    copied = [(1, f"idiot {' '.join(f'odd{k}' for k in range(30))} {j}") for j in range(40)]
    model = toxicity.fit(fine + rude + copied)
    assert {b"awful", b"idiot"} <= set(model.lexicon) and not any(w.startswith(b"odd") for w in model.lexicon)
    group = toxicity.copies([frozenset(toxicity.words_of(t)) for _, t in fine + rude + copied])
    assert len(set(group[210:])) <= 12 and len(set(group[:210])) > 200
