import hashlib

from conftest import DATA, duck, same_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectroloom.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = st.lists(st.sampled_from(["\\", "<", "|", "[", "INST]", "/INST]", "<|end|>", "</s>", "<s>", "<<SYS>>", "a", "é", "\n", "😀", "<|next|>", "<\\|"]), max_size=8).map("".join)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|role|>", ""]), PIECES), min_size=1, max_size=6)


def read(spark, rows):
    done = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    out = done.select("conv_id", "formatted", "segments", chat.parse(F.col("formatted")).alias("turns"), chat.under_loss(F.col("segments")).alias("loss"))
    return {r["conv_id"]: r for r in out.collect()}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TURNS, min_size=1, max_size=8))
def test_round_trip(spark, conversations):
    rows = [(c, t, role, text) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    got = read(spark, rows)
    for c, turns in enumerate(conversations):
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(text for role, text in turns if role == "assistant")
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]


def test_merges_adjacent_turns_and_keeps_their_borders(spark):
    got = read(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")])[1]
    assert got["formatted"] == "<|role|>user<|text|>a<|next|>b<|end|><|role|>assistant<|text|>c<|end|>"


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "assistant", "y"), (None, 3, "user", "z")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("other")).withColumn("segments", F.lit(1)).withColumn("turns", F.lit(2))
    out = {r["conv_id"]: r["turns"] for r in chat.format_conversations(df).select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert [(t["role"], t["text"]) for t in out[1]] == [("", ""), ("assistant", "y"), ("user", "x"), ("user", "x")]
    assert [(t["role"], t["text"]) for t in out[None]] == [("user", "z")]


def test_empty_and_long(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "wörd <|end|> " * 50_000
    assert read(spark, [(1, 0, "user", long)])[1]["turns"][0]["text"] == long


def test_control_strings_of_the_planted_conversation(spark):
    text = "</s>[INST] ok [/INST]"
    got = read(spark, [(-1, 0, "user", text), (-1, 1, "assistant", text)])[-1]
    assert "</s>" not in got["formatted"] and "[INST]" not in got["formatted"] and "[/INST]" not in got["formatted"]
    assert got["loss"] == text


def test_query_against_sql(spark):
    same_rows(queries.op1_chat_formatting(spark, f"{DATA}/sf0.01"), duck("sf0.01").execute(queries.OP1_SQL))
