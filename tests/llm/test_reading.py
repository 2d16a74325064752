"""Problem 10: held-out accuracy on graded text, and robustness of the level."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import reading

EASY = ["the cat sat on the bed", "she has a red ball", "they all eat and nap", "can the dog play", "he puts the cup on the table"]
HARD = [
    "whether conversational alignment can be measured reliably remains a controversial question since experimental conditions vary considerably",
    "researchers who examined the sequential organization reported that communicative intention generally decreases when speakers anticipate interruption",
    "what we take to be shared attention may turn out to be no more than a habit of those who look on",
]
ITEMS = [(1, "the archivist tapped the railing four times so that the chess tutor could protect the secret of the barley soup near the frosted window")]


def texts(coin, n):
    for i in range(n):
        level = i % 2
        parts = [coin.choice((EASY, HARD)[level]) for _ in range(12)]
        text = ". ".join(parts) + "."
        if i % 3 == 0:
            text = text.replace(".", "")
        if i % 5 == 0:
            text = f"<p>{text}</p>\n[media/b1/x_clip_1.mp4] {ITEMS[0][1]} (cf. Fig. 3)"
        yield i, text, 1 if level == 0 else 5


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "xx", "en", 0) for i, t, _ in rows] + [(5_000, None, None, "en", 0), (5_001, " ", None, "en", 0), (5_002, "two words", None, "en", 0)],
                                 "doc_id bigint, text string, lang string, stats string, n int")
    items = spark.createDataFrame(ITEMS, "item_id bigint, item_text string")
    return docs, items


def test_held_out_levels(spark, languages):
    rows = list(texts(random.Random(1), 160))
    docs, items = frames(spark, rows)
    labels = spark.createDataFrame([(i, "r1", y) for i, _, y in rows[:80]] + [(0, "r2", 5), (9_999, "r1", 3)], "doc_id bigint, rater string, reading_level int")
    got = {r["doc_id"]: r["level"] for r in reading.reading_levels(docs, items, labels, languages).collect()}
    assert set(got) == {i for i, _, _ in rows}
    assert all((got[i] >= reading.DEMANDING) == (y == 5) for i, _, y in rows[80:])


def test_other_languages_and_no_labels(spark, languages):
    german = "die sprecherin möchte wissen was die anderen über diesen plan denken und ob sie morgen mit ihr kommen " * 3
    docs, items = frames(spark, [(1, german, 5), (2, EASY[0] + " " + EASY[1] + " and they want to know what the others think about the plan", 1)])
    none = spark.createDataFrame([], "doc_id bigint, rater string, reading_level int")
    got = reading.reading_levels(docs, items, none, languages).collect()
    assert [(r["doc_id"], r["level"]) for r in got] == [(2, None)]


def test_items_in_blocks_give_the_same_levels(spark, languages, monkeypatch):
    rows = list(texts(random.Random(2), 40))
    docs, items = frames(spark, rows)
    items = items.unionByName(spark.createDataFrame([(9, "a passage that no document holds at all"), (10, HARD[2])], items.schema))
    labels = spark.createDataFrame([(i, "r1", y) for i, _, y in rows], "doc_id bigint, rater string, reading_level int")
    one = {tuple(r) for r in reading.reading_levels(docs, items, labels, languages).select("doc_id", F.round("level", 6)).collect()}
    monkeypatch.setattr(reading, "ITEM_BLOCK", 1)
    assert one == {tuple(r) for r in reading.reading_levels(docs, items, labels, languages).select("doc_id", F.round("level", 6)).collect()}


def test_sentence_length_is_read_where_stops_are_kept(languages):
    profiler = reading.Profiler(np.zeros(0, np.uint64), languages)
    kept, _, times, stats = profiler.profile(["The cat sat on the bed. She has a red ball. " * 5, "the cat sat on the bed she has a red ball " * 20], [None, None])
    assert kept.tolist() == [0, 1] and sum(times[0].as_py()) == 55
    assert abs(np.exp(stats[0, 3]) - 5.5) < 1e-9 and np.isnan(stats[1, 3])


def test_ranks_share_ties(spark):
    counted = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (1, "b", 2), (1, "c", 2)], "doc_id bigint, word string, times int")
    assert {r["word"]: r["rank"] for r in reading.word_ranks(counted).collect()} == {"a": 1.0, "b": 2.5, "c": 2.5}


def test_empty(spark, languages):
    docs, items = frames(spark, [(1, EASY[0], 1)])
    labels = spark.createDataFrame([(1, "r1", 1)], "doc_id bigint, rater string, reading_level int")
    assert reading.reading_levels(docs.limit(0), items.limit(0), labels, languages).count() == 0
