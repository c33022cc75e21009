import random
import re
import struct

import numpy as np
import pytest
from conftest import DATA, duck, same_rows
from pyspark.sql import functions as F

from spectroloom.llm import decontamination, licenses, media, queries


def test_license_texts_and_spellings(spark):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    rows = [
        (1, mit.upper().replace("SUBLICENSE", "SUB-LICENSE") if False else mit.replace("sublicense", "sublicence").upper()),
        (2, mit.replace("<year> <holder>", "1999 Someone Else").replace(",", " ;").replace("\n", "\r\n")),
        (3, mit.replace("free of charge", "for a fee")),
        (4, "Some prose.\n  released UNDER the MIT licence!!\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."),
        (5, "Released under the MIT License."),
        (6, None), (7, ""), (8, "Copyright (c) 2001 nobody\nAll rights reserved."), (None, "x"), (9, "a"), (9, "a"), (10, "word " * 100_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("license", F.lit(2)).withColumn("lines", F.lit(3))
    got = [r for r in licenses.scan(df).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [by[i]["text_license"] for i in (1, 2, 3, 4, 5)] == ["MIT", "MIT", None, None, "MIT"]
    assert by[4]["n_lines"] == 3 and by[4]["line_licenses"] == ["CC-BY-NC-4.0", "MIT"]
    assert by[6]["text_digest"] == by[7]["text_digest"] == by[8]["text_digest"] and by[6]["text_license"] is None
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_query_against_sql(spark):
    same_rows(queries.op4_licenses(spark, f"{DATA}/sf0.01"), duck("sf0.01").execute(queries.oracle_sql()["op4_licenses"]))


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def naive(docs, items, window):
    cut = [(i, {tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1))}) for i, w in ((i, words(t)) for i, t in items) if w]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, phrases in cut:
            for p in phrases:
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit |= set(range(k, k + len(p)))
                        found.add(i)
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_contamination_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    letters = ["a", "b", "C", "é", "9", "-", "😀"]
    some = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, some(rng.randint(0, 9))) for i in range(8)] + [(90, None), (91, "--"), (92, "a"), (92, "a")]
    docs = [(i, some(rng.randint(0, 40))) for i in range(30)] + [(90, None), (91, ""), (92, "B"), (92, "B")]
    if seed:
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)).withColumn("pos", F.lit(2)).withColumn("items", F.lit(3))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("phrase", F.lit(1)).withColumn("n", F.lit(3))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in decontamination.contamination(d, b, 4).collect()]
    assert sorted(got, key=str) == naive(docs, items, 4)
    left = decontamination.clean(d, b, 4)
    assert left.columns == d.columns and left.count() == sum(1 for g in got if not g[4])


def test_contamination_of_empty_tables_and_null_ids(spark):
    d = spark.createDataFrame([(None, "one two"), (1, "one two")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "one two")], "item_id long, text string")
    got = decontamination.contamination(d, b).collect()
    assert [(r["n_hit"], list(r["items"])) for r in got] == [(2, []), (2, [])]
    assert decontamination.contamination(d, b.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(d.limit(0), b).count() == 0


def test_proximity(spark):
    rng = random.Random(7)
    docs = [(1, "red x x green y blue"), (2, "red x x x x x x x green blue"), (3, "blue green red")] + [(k, " ".join(rng.choice(["red", "green", "blue", "x", "y"]) for _ in range(rng.randint(0, 30)))) for k in range(4, 40)] + [(None, "green red blue red")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, "red green blue"), (8, "x x y"), (9, "blue")], "item_id long, text string")
    tokens = decontamination.tokenised(d, ["doc_id"])
    found, _ = decontamination.phrases(b, 3)
    looked = decontamination.looked_up(tokens, found)
    index = decontamination.build_index(tokens, found.select(F.explode("phrase").alias("term"), F.lit(True).alias("first")).distinct(), ["doc_id"], 2)
    words_of = {r["pid"]: (list(r["phrase"]), r["rare"][0]["term"]) for r in looked.collect()}
    for within in (3, 5):
        want = sorted(((i, k, " ".join(p)) for i, t in docs for p, r in words_of.values() for k, w in enumerate(t.split()) if w == r and set(p) <= set(t.split()[max(0, k - within) : k + within + 1])), key=str)
        got = sorted(((r["doc_id"], r["pos"], " ".join(words_of[r["pid"]][0])) for r in decontamination.proximity(index, looked, ["doc_id"], within).collect()), key=str)
        assert got == want and want
    exact = sorted((r["doc_id"], r["start"], " ".join(words_of[r["pid"]][0])) for r in decontamination.exact(index, looked, ["doc_id"]).where("doc_id is not null").collect())
    assert exact == sorted((i, k, " ".join(p)) for i, t in docs if i for p, _ in words_of.values() for k in range(len(t.split())) if t.split()[k : k + len(p)] == p)


def test_contamination_query_against_sql(spark):
    same_rows(queries.op9_decontamination(spark, f"{DATA}/sf0.01"), duck("sf0.01").execute(queries.OP9_SQL))


def test_companding_tables():
    mu, a = media.mu_law_table(), media.a_law_table()
    assert (mu[0x00], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256
    assert all((np.diff(np.sort(t.astype(int))) >= 0).all() for t in (mu, a))


def slow_adpcm(data, block):
    out = []
    for k in range(0, len(data), block):
        part = data[k : k + block]
        if len(part) < 4:
            continue
        sample, index = struct.unpack("<hB", part[:3])
        index = min(index, 88)
        out.append(sample)
        for byte in part[4:]:
            for code in (byte & 15, byte >> 4):
                step = media.STEPS[index]
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                sample = max(-32768, min(32767, sample - move if code & 8 else sample + move))
                index = max(0, min(88, index + media.INDEX_CHANGE[code & 7]))
                out.append(sample)
    return out


def test_adpcm_against_one_sample_at_a_time():
    data = random.Random(1).randbytes(256 * 5 + 37)
    assert media.adpcm_decode(data, 256).tolist() == slow_adpcm(data, 256)
    assert media.decode(media.wav(data, media.IMA_ADPCM, 8000, 256, 4))[0].tolist() == slow_adpcm(data, 256)
    assert media.adpcm_decode(b"", 256).tolist() == []


def test_wav_and_resampling(spark):
    for tag in (media.MU_LAW, media.A_LAW):
        data = bytes(range(256))
        assert media.unwav(media.wav(data, tag)) == (tag, 8000, 1, data)
    x = np.array([0, 100, -50], np.int16)
    assert media.resample(x, 8000, 16000).tolist() == [0, 50, 100, 25, -50]
    assert media.resample(x, 8000, 12000).tolist() == [0, 67, 50, -50]
    assert media.resample(x, 8000, 8000).tolist() == x.tolist()
    df = media.decoded(spark.createDataFrame([(1, bytearray(media.wav(b"\x00\xff", media.MU_LAW))), (2, bytearray(b"junk")), (3, None)], "id long, media binary")).collect()
    assert [r["error"] for r in df] == [None, "not a WAV file", None] and df[0]["pcm"] is not None and df[2]["pcm"] is None


def test_media_rows(spark):
    import hashlib
    import zlib

    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "é" * 40), (5, "long " * 100_000), (6, "same"), (6, "same"), (None, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("feature", F.lit(2))
    # rows are written and read back, in any order
    place = {i: k for k, i in enumerate((1, 2, 3, 4, 5, 6, None))}
    got = sorted(media.digests(df).collect(), key=lambda r: place[r["doc_id"]])
    assert len(got) == len(rows)
    for (i, t), r in zip(rows, got, strict=True):
        raw = (t or "").encode()
        whole = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len(raw), len(whole))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest() and r["tail_crc32"] == zlib.crc32(whole[-64:])
    assert got[5][1:] == got[6][1:] == got[7][1:] and got[0][1:] == got[1][1:]
    kept = media.stored(df).collect()
    assert [media.payload_of(bytes(r["media"]))[: r["n_bytes"]] for r in kept] == [(t or "").encode() for _, t in rows]
    assert media.digests(df.limit(0)).count() == 0


def slow_expand(byte, law):
    """G.711 from its definition."""
    if law == "mu":
        byte = ~byte & 255
        size = ((((byte & 15) << 3) + 132) << ((byte & 112) >> 4)) - 132
        return -size if byte & 128 else size
    byte ^= 0x55
    segment, size = (byte & 112) >> 4, ((byte & 15) << 4) + 8
    size = size if not segment else (size + 256) << (segment - 1)
    return size if byte & 128 else -size


def test_media_query_against_plain_python(spark):
    """Every column of the query over a whole table, from definitions and one sample at a time."""
    import hashlib
    import math
    import zlib

    def pcm_of(x, ratio):
        half = 8 * ratio
        sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
        kernel = {k: sinc(k / ratio) * (0.5 + 0.5 * math.cos(math.pi * k / (half + 1))) for k in range(-half, half + 1)}
        total = math.fsum(kernel.values())
        value = lambda i: math.fsum(x[i - k] * w for k, w in kernel.items() if 0 <= i - k < len(x)) / total
        return [max(-32768, min(32767, round(value(i)))) for i in range(0, len(x), ratio)] if len(x) > 1 else x

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    got = queries.op7_media(spark, f"{DATA}/sf0.001").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    kinds, checked = set(), 0
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        data = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        kind = zlib.crc32(data) % 8
        tag, block, bits = (17, 68, 4) if kind == 0 else (6, 1, 8) if kind < 4 else (7, 1, 8)
        body = b"".join(b"\0\0\0\0" + data[k : k + 64] for k in range(0, len(data), 64)) if tag == 17 else data
        fmt = struct.pack("<HHIIHH", tag, 1, 8000, 8000 * 68 // 129 if tag == 17 else 8000, block, bits) + (struct.pack("<HH", 2, 129) if tag == 17 else b"\0\0")
        riff = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body
        file = b"RIFF" + struct.pack("<I", len(riff)) + riff
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        if len(data) <= 2000 and (tag not in kinds or checked < 25):
            kinds.add(tag)
            checked += 1
            x = slow_adpcm(body, 68) if tag == 17 else [slow_expand(b, "mu" if tag == 7 else "a") for b in body]
            # PCM is stored at 16 kHz: each sample and the middle between it and the next
            want = [v for a, b in zip(x, x[1:], strict=False) for v in (a, round((a + b) / 2))] + x[-1:]
            assert np.abs(media.resample(np.array(x), 8000, 2000).astype(int) - np.array(pcm_of(x, 4))).max() <= 1
            seen = dict(part.split("=") for part in r["feature"].split(";"))
            assert int(seen["n"]) == len(want)
            assert abs(float(seen["rms"]) - math.sqrt(sum(v * v for v in want) / len(want))) < 1
            assert abs(int(seen["peak"]) - max(map(abs, want))) <= 0.51
    assert kinds == {6, 7, 17} and checked >= 25
    assert len({r["feature"] for r in got}) == len({r["payload_sha256"] for r in got})


def test_media_is_low_passed_and_any_id_is_kept(spark):
    t = np.arange(8000) / 8000
    low = (10_000 * np.sin(2 * np.pi * 300 * t)).astype(np.int16)
    middle = lambda x: np.abs(media.resample(x, 8000, 2000)[200:1800].astype(int)).max()
    for f in (1500, 2700, 3900):
        assert middle((10_000 * np.sin(2 * np.pi * f * t)).astype(np.int16)) < 300
    assert middle(low) > 9000
    got = media.digests(spark.createDataFrame([("a", "x"), (None, None)], "doc_id string, text string").withColumn("pcm", F.lit(1))).collect()
    assert [r["doc_id"] for r in got] == ["a", None] and len({r["media_sha256"] for r in got}) == 2


def test_adpcm_of_many_files_is_that_of_each():
    rng = random.Random(3)
    files = [rng.randbytes(n) for n in (0, 68, 68 * 4, 3, 68 * 2 + 30, 68 + 30)]
    for file, got in zip(files, media.adpcm_decode_all(files, 68), strict=True):
        assert got.tolist() == slow_adpcm(file, 68)


def test_license_texts_are_found_however_wrapped(spark):
    import textwrap

    isc = dict(licenses.KNOWN)["ISC"]
    wrapped = "\n".join(textwrap.fill(p, 70) for p in isc.split("\n"))
    broken = wrapped.replace("above\ncopyright notice", "above copyright notice").replace("above copyright notice", "above\ncopyright notice")
    assert "\ncopyright notice" in broken
    notice = "Copyright (c) 2001 Somebody\n\n"
    texts = dict(licenses.license_texts())
    folder = licenses.Path(licenses.__file__).parent / "license_texts"
    whole = {f.stem: f.read_text("utf-8") for f in folder.glob("*.txt")}
    assert {"Apache-2.0", "GPL-3.0-only", "MPL-2.0", "Unlicense"} < set(whole) and "BSD-3-Clause" in texts
    rewrapped = lambda t, n: "\n\n".join(textwrap.fill(" ".join(p.split()), n) for p in re.split(r"\n\s*\n", t))
    rows = [("ISC", notice + broken), ("BSD-3-Clause", notice + texts["BSD-3-Clause"])] + [(i, t) for i, t in whole.items()] + [("Apache-2.0", rewrapped(whole["Apache-2.0"], 61)), (None, whole["Apache-2.0"].replace("perpetual", "brief"))]
    df = spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["text_license"] for r in licenses.scan(df).collect()}
    assert [got[k] for k in range(len(rows))] == [i for i, _ in rows]


def test_items_marked_c_and_wrapped_sentences_stay(spark):
    rest = "You may copy this.\nYou may change this."
    texts = [f"{rest}\n(c) You must retain all notices", f"{rest}\n(c) You may drop all notices", rest]
    notices = [f"{n}\n{rest}" for n in ("Copyright (c) 2001 A", "  * COPYRIGHT 1999-2003, B", "(C) Copyright C", "(c) 2020 D", "© 2019", "Copyright <year> <holder>", "Copyright by E", "Copyright: [yyyy]", "All rights reserved.")]
    plain = [f"{n}\n{rest}" for n in ("copyright notice and this permission notice", "(c) and so on", "copyrighted", "all rights reserved to the owner")]
    df = spark.createDataFrame(list(enumerate(texts + notices + plain)), "doc_id long, text string")
    got = {r["doc_id"]: r["text_digest"] for r in licenses.scan(df).collect()}
    digests = [got[k] for k in range(len(got))]
    assert len(set(digests[:3])) == 3
    assert set(digests[3 : 3 + len(notices)]) == {got[2]}
    assert len(set(digests[3 + len(notices) :]) | {got[2]}) == len(plain) + 1


def test_spellings(spark):
    forms = [(k, f"x {a} {a}, {a} y") for k, (a, _) in enumerate(licenses.SPELLINGS)] + [(1000 + k, f"x {b} {b} {b} y") for k, (_, b) in enumerate(licenses.SPELLINGS)]
    got = {r["doc_id"]: r["c"] for r in spark.createDataFrame(forms, "doc_id long, text string").select("doc_id", licenses.canonical(F.col("text")).alias("c")).collect()}
    assert all(got[k] == got[1000 + k] == f"x {b} {b} {b} y" for k, (_, b) in enumerate(licenses.SPELLINGS))
    assert all(abs(len(a) - len(b)) <= licenses.SLACK // 2 for a, b in licenses.SPELLINGS)


def test_about_thirty_licenses_are_known(spark):
    ids = {i for i, _ in [*licenses.KNOWN, *licenses.license_texts()]}
    assert len(ids) >= 28
    rows = [(k, i, f"Copyright 2020 Someone\n\n{t}") for k, (i, t) in enumerate(licenses.license_texts())]
    got = {r["doc_id"]: r["text_license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, id string, text string")).collect()}
    assert all(got[k] == i for k, i, _ in rows)


def test_terms_are_broadcast_in_pieces(spark, monkeypatch):
    """Benchmarks of many distinct words: no exchange holds the words of a document, results stay."""
    items = [(i, " ".join(f"w{i * 5 + k}" for k in range(13))) for i in range(60)]
    docs = [(i, " ".join(f"w{i * 7 + k}" for k in range(40))) for i in range(40)] + [(99, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 50)
    tokens = decontamination.tokenised(d.select("doc_id", "text"), ["doc_id"])
    plan = decontamination._looked(tokens.select("doc_id", "w", F.posexplode("w").alias("pos", "term")), spark.createDataFrame([(f"w{k}", True) for k in range(200)], "term string, first boolean"))
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString() and plan.count() == sum(1 for _, t in docs for w in (t or "").split() if int(w[1:]) < 200)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in decontamination.contamination(d, b).collect()]
    assert sorted(got, key=str) == naive(docs, items, 13)


def test_packed_pcm_comes_back():
    rng = np.random.default_rng(7)
    doubled = media.resample(media.MU[rng.integers(0, 256, 500)], 8000, 16000)
    edges = np.array([-32768, 32767, -32768, 32767, 0, -1], "<i2")
    for x in (doubled, edges, edges[:5], edges[:1], edges[:0], rng.integers(-32768, 32768, 1001).astype("<i2"), np.arange(512, dtype="<i2"), np.arange(514, dtype="<i2")):
        assert media.unpacked(media.packed(x.tobytes())) == x.tobytes()
    assert len(media.packed(doubled.tobytes())) < doubled.nbytes / 1.9


def test_decoded_with_packing_is_the_same_pcm(spark):
    rows = [(1, bytearray(media.stored_as(media.payload("some text of a few words"), 8000))), (2, bytearray(b"junk")), (3, None)]
    df = spark.createDataFrame(rows, "id long, media binary")
    plain, pack = (sorted(media.decoded(df, pack=p).collect()) for p in (False, True))
    assert [r["error"] for r in pack] == [None, "not a WAV file", None]
    assert media.unpacked(bytes(pack[0]["pcm"])) == bytes(plain[0]["pcm"]) and pack[1]["pcm"] is None and pack[2]["pcm"] is None
