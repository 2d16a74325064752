"""Problem 9: shares, caps and whole streams."""

import os

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer file")
TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 8), ("none", 0.1, 4)]


def documents(spark, scale):
    rows = [(i, "word " * (20 + i % 30), src) for i, src in enumerate(["a"] * 6 * scale + ["b"] * 3 * scale + ["C "] * scale + ["other"] * scale)]
    rows += [(90_000, None, "a"), (90_001, "", "a"), (90_002, "word", None), (90_003, "word", " ")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("slot", F.lit("x"))


def test_shares_and_caps(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixed = mixing.mix(documents(spark, 300), targets)
    got = {r["source"]: r for r in mixing.report(mixed, targets).collect()}
    for name, share, cap in TARGETS[:3]:
        assert abs(got[name]["reached_share"] - share / 0.9) < 0.02, got[name]
        assert got[name]["most_repeats"] <= cap
    assert got["none"]["tokens"] == 0 and got["none"]["reached_share"] == 0
    assert mixed.groupBy("doc_id", "repetition").count().where("count > 1").count() == 0
    slots = mixed.select("slot").distinct().count()
    assert mixed.agg(F.max("slot")).first()[0] < slots * 1.2 + 3
    # every stretch of the schedule is mixed, not only the whole
    half = mixed.where(F.col("slot") < slots / 2).groupBy("source").agg(F.sum("tokens").alias("t")).collect()
    total = sum(r["t"] for r in half)
    assert all(abs(r["t"] / total - got[r["source"]]["reached_share"]) < 0.06 for r in half)


def test_given_total_and_empty(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    small = mixing.mix(documents(spark, 300), targets, total=20_000)
    assert abs(small.agg(F.sum("tokens")).first()[0] - 20_000) < 1_000
    none = documents(spark, 1).limit(0)
    assert mixing.mix(none, targets).count() == 0
    assert mixing.report(mixing.mix(none, targets), targets).count() == 4


def test_tokens_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = ["hello there", "", None, "Grüße aus <|endoftext|> Köln", "x" * 50_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.count_tokens()("t").alias("n"))
    t = Tokenizer.from_file(mixing.TOKENIZER)
    t.encode_special_tokens = True
    assert [r["n"] for r in df.collect()] == [len(t.encode(x or "", add_special_tokens=False)) for x in texts]


def test_token_counts_are_those_of_whole_texts():
    import random

    coin = random.Random(1)
    signs = ["a", "B", "é", "  ", " ", "\n", "\t", " \n", "'s", "1", "²", "...", "<|endoftext|>", "日本", "\u00a0", "\r\n", "-", "’", " ", "word"]
    texts = ["".join(coin.choice(signs) for _ in range(coin.randrange(14))) for _ in range(5_000)]
    counter = mixing.TokenCounter(open(mixing.TOKENIZER, encoding="utf-8").read())
    assert counter.count(texts) == counter.whole(texts) == counter.count(texts)
