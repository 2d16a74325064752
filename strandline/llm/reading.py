"""Problem 10: reading level of each document on the scale of human labels.

Coverage rank: words of English documents are ranked by their frequency over
the whole corpus; a document's coverage rank for a token share is the size of
the smallest top of that ranking that covers the share of its tokens, i.e. the
token-weighted quantile of its words' ranks.

Sentence complexity: words per sentence where a document kept its stops (others
take the corpus' mean, and a flag), word lengths, and how sentences are built:
the shares of the ``HEAD_WORDS`` most frequent words of the corpus, which are
its articles, conjunctions, pronouns and prepositions and survive lost stops.

Both are calibrated in SQL: sums of products of all features over every
labelled document are aggregated to the normal equations of a ridge
regression, whose solution is one linear SQL expression for the level. Words of
test items inside a document, markup, paths, bracketed references and labels
are left out before anything is counted.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.leaks import SHINGLE, WORD, mixed_hashes, shingle_hashes, undivided, words_of
from strandline.llm.pairs import LANGUAGES, LETTERS_TOLD, MARGIN, LanguageModel, fit_languages
from strandline.session import stage

#: Items whose words are told apart from prose in one pass; more take more passes.
ITEM_BLOCK = 20_000
SHARES = (0.5, 0.65, 0.8, 0.9, 0.95)
LONG, VERY_LONG = 8, 12
HEAD_WORDS = 32
#: A document with more words a sentence has lost its stops.
STOPS_LOST = 60
RIDGE = 2.0
LEAST_WORDS = 5
#: Documents that a Python worker profiles at once.
SLICE = 500
DEMANDING = 3.5
STATS = ("mean_length", "long_share", "very_long_share", "words_per_sentence", "stops_lost")
FEATURES = [f"cover_{round(q * 100)}" for q in SHARES] + list(STATS) + [f"head_{i}" for i in range(1, HEAD_WORDS + 1)]

_PLAIN_CLUTTER = re.compile(r"<[^<>]{0,80}>|\([^()]{1,25}\)|\[[^\[\]]{1,25}\]")
_CLUTTER = re.compile(r"<[^<>]{0,80}>|(?<!\S)\S*?[/\\]\S*|\([^()]{1,25}\)|\[[^\[\]]{1,25}\]")
_STOP = re.compile(r"[.!?](?=[\s\"')\]<]|$)")


class _Words:
    """What is known of each word a task meets: hash, length, whether it is
    letters only, language scores. Dropped when it holds very many."""

    def __init__(self, languages: LanguageModel):
        self.languages = languages
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.text: list[str] = []
        self.hashes = np.zeros(4096, np.uint64)
        self.lengths = np.zeros(4096, np.int64)
        self.alpha = np.zeros(4096, bool)
        self.scores = np.zeros((4096, len(LANGUAGES)))

    def id_of(self, word: str) -> int:
        at = self.ids[word] = len(self.text)
        self.text.append(word)
        if at == len(self.hashes):
            self.hashes, self.lengths, self.alpha = (np.concatenate([a, np.zeros_like(a)]) for a in (self.hashes, self.lengths, self.alpha))
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.hashes[at], self.lengths[at], self.alpha[at] = xxhash.xxh64_intdigest(word), len(word), word.isalpha()
        self.scores[at] = self.languages.word_scores(word) if self.alpha[at] else 0.0
        return at


def _cleared(text: str) -> str:
    text = html.unescape(text)
    return (_CLUTTER if "/" in text or "\\" in text else _PLAIN_CLUTTER).sub(" ", text)


def _words_of(cleared: str) -> list[str]:
    return WORD.findall(undivided(cleared.lower()).replace("'", ""))


class Profiler:
    """Profiles of documents in slices, on arrays of word numbers."""

    def __init__(self, item_shingles: np.ndarray, languages: LanguageModel):
        self.items = item_shingles
        self.words = _Words(languages)

    def read(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Cleared texts; word numbers and document positions of all words; words inside items."""
        if len(self.words.text) > 500_000:
            self.words.clear()
        ids, new = self.words.ids, self.words.id_of
        cleared = [_cleared(t) for t in texts]
        rows = [[ids[w] if w in ids else new(w) for w in _words_of(t)] for t in cleared]
        flat = np.array([i for row in rows for i in row], dtype=np.int64)
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        inside = np.zeros(len(flat), bool)
        if len(self.items) and len(flat) >= SHINGLE:
            hashes = mixed_hashes(self.words.hashes[flat])
            at = np.minimum(np.searchsorted(self.items, hashes), len(self.items) - 1)
            hit = np.flatnonzero((self.items[at] == hashes) & (doc[: len(hashes)] == doc[SHINGLE - 1 :]))
            for i in range(SHINGLE):
                inside[hit + i] = True
        return cleared, flat, doc, inside

    def profile(self, texts: list[str], masked: list[list[int] | None]) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
        """Positions of the English documents with enough prose, their distinct
        words with the times they come, and their stats."""
        cleared, flat, doc, inside = self.read(texts)
        begins = np.searchsorted(doc, np.arange(len(texts)))
        for i, places in enumerate(masked):
            if places is not None:
                inside[begins[i] + np.asarray(places, dtype=np.int64)] = True
        keep = ~inside & self.words.alpha[flat]
        flat, doc = flat[keep], doc[keep]
        n = np.bincount(doc, minlength=len(texts))
        lengths = self.words.lengths[flat]
        letters = np.bincount(doc, weights=lengths, minlength=len(texts))
        scores = np.stack([np.bincount(doc, weights=self.words.scores[flat, k], minlength=len(texts)) for k in range(len(LANGUAGES))], axis=1)
        ranked = np.sort(scores, axis=1)
        english = (scores.argmax(1) == LANGUAGES.index("en")) & (ranked[:, -1] - ranked[:, -2] > MARGIN) & (letters >= LETTERS_TOLD)
        kept = np.flatnonzero(english & (n >= LEAST_WORDS))
        size = n[kept]
        stops = np.array([len(_STOP.findall(cleared[i])) for i in kept], dtype=float)
        per_sentence = np.where(stops > 0, size / np.maximum(stops, 1), np.inf)
        stats = [
            letters[kept] / size,
            np.bincount(doc, weights=lengths >= LONG, minlength=len(texts))[kept] / size,
            np.bincount(doc, weights=lengths >= VERY_LONG, minlength=len(texts))[kept] / size,
            np.where(per_sentence < STOPS_LOST, np.log(np.minimum(per_sentence, STOPS_LOST)), np.nan),
        ]
        pairs, times = np.unique(doc << 32 | flat, return_counts=True)
        owner = pairs >> 32
        mine = np.isin(owner, kept)
        pairs, times, owner = pairs[mine] & 0xFFFFFFFF, times[mine], owner[mine]
        edges = pa.array(np.append(np.searchsorted(owner, kept), len(owner)), pa.int32())
        vocabulary, at = np.unique(pairs, return_inverse=True)
        words = pa.DictionaryArray.from_arrays(pa.array(at.astype(np.int32)), pa.array([self.words.text[i] for i in vocabulary], pa.string())).cast(pa.string())
        return kept, pa.ListArray.from_arrays(edges, words), pa.ListArray.from_arrays(edges, pa.array(times, pa.int32())), np.stack(stats, axis=1)


def _item_shingles(rows: list) -> np.ndarray:
    found = [shingle_hashes(np.array([xxhash.xxh64_intdigest(w) for w in words_of(r[0])], dtype=np.uint64)) for r in rows]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def _profiles(documents: DataFrame, items: DataFrame, languages: LanguageModel) -> DataFrame:
    """(doc_id, n, words, times, stats) of English documents with enough prose.

    Up to ``ITEM_BLOCK`` items are told apart in the pass that profiles; more
    take one pass a block before it, which lists the places of their words.
    """
    spark = documents.sparkSession
    texts = items.where("item_text IS NOT NULL").select("item_text").distinct()
    rows = documents.select("doc_id", "text").where("doc_id IS NOT NULL AND length(text) > 0")
    blocks = math.ceil(texts.count() / ITEM_BLOCK)
    if blocks <= 1:
        shingles = _item_shingles(texts.collect())
        rows = rows.withColumn("masked", F.lit(None).cast("array<int>"))
    else:
        shingles = np.zeros(0, dtype=np.uint64)
        places = None
        for block in range(blocks):
            mine = texts.where(F.pmod(F.xxhash64("item_text"), F.lit(blocks)) == block)
            held = spark.sparkContext.broadcast((_item_shingles(mine.collect()), languages))

            def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                reader = Profiler(*held.value)
                for batch in batches:
                    for low in range(0, batch.num_rows, SLICE):
                        part = batch.slice(low, SLICE)
                        _, flat, doc, inside = reader.read(part.column("text").to_pylist())
                        at = np.arange(len(flat)) - np.searchsorted(doc, doc)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc[inside])), pa.array(at[inside], pa.int32())], ["doc_id", "place"])

            one = stage(rows.mapInArrow(find, "doc_id long, place int"), "item-places")
            places = one if places is None else places.unionByName(one)
        rows = rows.join(places.groupBy("doc_id").agg(F.collect_set("place").alias("masked")), "doc_id", "left")
    shared = spark.sparkContext.broadcast((shingles, languages))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Profiler(*shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                kept, words, times, stats = reader.profile(part.column("text").to_pylist(), part.column("masked").to_pylist())
                columns = [part.column("doc_id").take(pa.array(kept)), pa.array([len(x) for x in words], pa.int32()), words, times, *[pa.array(c) for c in stats.T]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "different", "words", "times", *STATS[:4]])

    schema = "doc_id long, different int, words array<string>, times array<int>, " + ", ".join(f"{c} double" for c in STATS[:4])
    return rows.select("doc_id", "text", "masked").mapInArrow(profile, schema)


def word_ranks(counted: DataFrame) -> DataFrame:
    """(word, rank, place) by falling frequency; words of one frequency share
    their mean rank. ``place`` numbers the ``HEAD_WORDS`` first words, equal
    frequencies in order of the words, and is NULL for the others.

    Only the distinct frequencies are ordered, never the vocabulary.
    """
    totals = stage(counted.groupBy("word").agg(F.sum("times").alias("uses")), "word-uses")
    ladder = totals.groupBy("uses").agg(F.count("*").alias("size"))
    above = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("uses"))) - F.col("size")
    ladder = ladder.select("uses", (above + (F.col("size") + 1) / 2).alias("rank"))
    first = totals.orderBy(F.desc("uses"), "word").limit(HEAD_WORDS)
    first = first.select("word", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("uses"), "word")).alias("place"))
    return totals.join(ladder, "uses").join(F.broadcast(first), "word", "left").select("word", "rank", "place")


def reading_features(documents: DataFrame, items: DataFrame, languages: LanguageModel | None = None) -> DataFrame:
    """(doc_id, FEATURES): one row per English document with at least ``LEAST_WORDS`` words of prose."""
    model = languages or fit_languages(documents)
    profiles = stage(_profiles(documents, items, model), "profiles")
    counted = profiles.select("doc_id", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        "doc_id", F.col("x.words").alias("word"), F.col("x.times").alias("times")
    )
    ranks = stage(word_ranks(counted), "word-ranks")
    shares = ", ".join(str(q) for q in SHARES)
    head = F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "times"))))
    cover = counted.join(ranks, "word").groupBy("doc_id").agg(
        F.expr(f"percentile(rank, array({shares}), times)").alias("cover"), F.sum("times").alias("n"), head.alias("head")
    )
    kept_stops = profiles.agg(F.coalesce(F.avg(F.nanvl("words_per_sentence", F.lit(None))), F.lit(0.0))).scalar()
    stats = [F.col(c) for c in STATS[:3]]
    stats += [F.coalesce(F.nanvl("words_per_sentence", F.lit(None)), kept_stops).alias(STATS[3]), F.isnan("words_per_sentence").cast("double").alias(STATS[4])]
    joined = profiles.select("doc_id", *stats).join(cover, "doc_id")
    covers = [F.log(F.col("cover")[i]).alias(FEATURES[i]) for i in range(len(SHARES))]
    heads = [(F.coalesce(F.try_element_at("head", F.lit(i)), F.lit(0)) / F.col("n")).alias(f"head_{i}") for i in range(1, HEAD_WORDS + 1)]
    return joined.select("doc_id", *covers, *STATS, *heads)


def human_levels(labels: DataFrame) -> DataFrame:
    """(doc_id, level): rater r1's label, else the mean of the others'."""
    r1 = F.avg(F.when(F.col("rater") == "r1", F.col("reading_level")))
    return labels.groupBy("doc_id").agg(F.coalesce(r1, F.avg("reading_level")).alias("level")).where("level IS NOT NULL")


def fit_level(features: DataFrame, labels: DataFrame) -> str:
    """SQL expression of the level over the feature columns, from all labelled documents.

    Aggregates every sum of a product of two of (1, features, level); the
    driver solves equations of as many unknowns as there are features.
    """
    labelled = features.join(human_levels(labels), "doc_id")
    names = [*FEATURES, "level"]
    vector = labelled.select(F.array(F.lit(1.0), *[F.col(c) for c in names]).alias("v"))
    left = vector.select("v", F.posexplode("v").alias("i", "a"))
    products = left.select("i", "a", F.posexplode(F.slice("v", F.col("i") + 1, len(names) + 1)).alias("j", "b"))
    sums = products.groupBy("i", (F.col("i") + F.col("j")).alias("j")).agg(F.sum(F.col("a") * F.col("b")).alias("s")).collect()
    gram = np.zeros((len(names) + 1, len(names) + 1))
    for i, j, s in sums:
        gram[i, j] = gram[j, i] = s
    n = gram[0, 0]
    if not n:
        return "CAST(NULL AS DOUBLE)"
    mean = gram[0, 1:] / n
    covar = gram[1:, 1:] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(covar)[:-1], 0.0))
    used = np.flatnonzero(spread > 1e-9)
    scaled = covar[np.ix_(used, used)] / np.outer(spread[used], spread[used]) * n
    weights = np.linalg.solve(scaled + RIDGE * np.eye(len(used)), covar[used, -1] / spread[used] * n) / spread[used]
    terms = [f"({w!r}) * {FEATURES[k]}" for w, k in zip(weights.tolist(), used.tolist(), strict=True)]
    return " + ".join([repr(float(mean[-1] - weights @ mean[used])), *terms])


def reading_levels(documents: DataFrame, items: DataFrame, labels: DataFrame, languages: LanguageModel | None = None) -> DataFrame:
    """(doc_id, level): estimated level of every English document, unrounded.

    Null and blank texts, those of other languages and those with fewer than
    ``LEAST_WORDS`` words of prose have no level and no row; without any label
    the level is null. Whole texts are read; other columns are ignored.
    """
    features = stage(reading_features(documents, items, languages), "reading")
    return features.select("doc_id", F.expr(fit_level(features, labels)).alias("level"))
