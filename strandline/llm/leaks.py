"""Problem 8: passages of evaluation items inside training documents.

Size-partitioned MinHash containment search. Items are cut into pieces of
``PIECE`` five-word shingles, documents into windows of at most ``WINDOW``.
Windows fall into partitions by their number of shingles; a partition's upper
size turns the least overlap that must be found (``LEAST_SHARED`` shingles of
a piece) into a least Jaccard similarity, and that into how many minima have
to be compared so that an overlap is missed with a probability below ``MISS``.
Small windows so need few minima, large ones more, and nothing is lost to a
similarity threshold made for sets of equal size. A window is two blocks, and
minima are taken of blocks and then of pairs of blocks.

A hit is verified: shared shingles are counted exactly, then the words of item
and document are aligned in order, allowing isolated changes.

Items of up to ``SHORT`` words, of which two fifths need not share that many
shingles, are found through every run of ``run_words`` words they have, looked
up exactly.

The items are the query set. They are indexed in blocks of ``BLOCK`` items, a
size that is checked, and every document is probed where it lies: documents
are neither shuffled nor joined.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHINGLE = 5
PIECE, PIECE_STEP = 32, 16
WINDOW, WINDOW_STEP = 64, 32
#: Upper sizes (in shingles) of the windows' partitions.
SIZES = (16, 32, WINDOW)
LEAST_SHARED = 5
MISS = 1e-3
#: Items indexed at once (some 5 KB each).
BLOCK = 10_000
#: Share of an item's words that one stretch of the document must repeat.
LEAST_SHARE = 0.4
#: Words that layout may add at one place inside a stretch.
LAYOUT_WORDS = 5
#: Two fifths of a longer item hold at least LEAST_SHARED shingles and one more.
SHORT = 22
#: Shingles whose minima are taken at once, so that they stay in the processor's cache.
CACHED = 262_144

_MARKUP = re.compile(r"<[^<>]{0,80}>")
# a word that layout divides: soft hyphens, or a hyphen at a line end
BROKEN = re.compile("[\u00ad\u200b\u2060\ufeff]|(?<=\\w)[-\u2010\u2011][ \\t]*\\r?\\n\\s*(?=\\w)")
WORD = re.compile(r"[^\W_]+")


def minima_needed(size: int) -> int:
    """Minima to compare for windows of at most ``size`` shingles."""
    least = LEAST_SHARED / (size + PIECE - LEAST_SHARED)
    return math.ceil(math.log(MISS) / math.log(1.0 - least))


MINIMA = tuple(minima_needed(s) for s in SIZES)
_coin = np.random.default_rng(20_081)
# 32 bits suffice for minima: a chance hit is verified like any other
_A = _coin.integers(0, 2**31, max(MINIMA), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _coin.integers(0, 2**32, max(MINIMA), dtype=np.uint32)


def words_needed(n: int) -> int:
    """Words of an item of ``n`` that one stretch must repeat: two fifths, but
    at least SHINGLE, as fewer are a scrap, or the whole of a shorter item."""
    return max(math.ceil(LEAST_SHARE * n - 1e-9), min(n, SHINGLE))


def run_words(n: int) -> int:
    """Words in a row through which a short item of ``n`` words is found: of a
    stretch with one change at most, half the words needed are in a row."""
    return n if n < SHINGLE else min(SHINGLE, max(3, words_needed(n) // 2))


def words_of(text: str) -> list[str]:
    """Words without case, punctuation, layout and markup."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    return WORD.findall(undivided(text.lower()).replace("'", ""))


def undivided(text: str) -> str:
    """Text without signs that divide a word for layout's sake, and without curly apostrophes."""
    if not text.isascii():
        return BROKEN.sub("", text).replace("’", "")
    return BROKEN.sub("", text) if "-" in text and "\n" in text else text


class _Hasher:
    """Hashes of words, kept as long as a task lives (bounded)."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        known.update((w, xxhash.xxh64_intdigest(w)) for w in set(words).difference(known))
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed_hashes(word_hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash per run of ``size`` words."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += word_hashes[i : i + n]
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    return out ^ (out >> np.uint64(33))


shingle_hashes = mixed_hashes


def _spans(n: int, size: int, step: int) -> list[tuple[int, int]]:
    """Overlapping stretches of at most ``size`` that cover 0..n."""
    if n <= size:
        return [(0, n)]
    starts = list(range(0, n - size, step)) + [n - size]
    return [(s, s + size) for s in starts]


class ItemIndex:
    """Minima of the items' pieces, one sorted list per hash function, and the
    word runs of short items."""

    def __init__(self, items: list[tuple[int, str]]):
        hasher = _Hasher()
        self.ids = [i for i, _ in items]
        self.words = [hasher(words_of(t)) for _, t in items]
        self.shingles = [np.unique(shingle_hashes(w)) for w in self.words]
        minima, owner = [], []
        runs: dict[int, list] = {}
        for at, words in enumerate(self.words):
            if 0 < len(words) <= SHORT:
                size = run_words(len(words))
                runs.setdefault(size, []).append((np.unique(mixed_hashes(words, size)), at))
                continue
            hashes = shingle_hashes(words).astype(np.uint32)
            for a, b in _spans(len(hashes), PIECE, PIECE_STEP) if len(words) else []:
                minima.append((hashes[a:b, None] * _A + _B).min(axis=0))
                owner.append(at)
        table = np.array(minima, dtype=np.uint32).reshape(len(owner), len(_A))
        order = np.argsort(table, axis=0, kind="stable")
        self.minima = np.ascontiguousarray(np.take_along_axis(table, order, axis=0).T)
        self.owner = np.ascontiguousarray(np.asarray(owner, dtype=np.int32)[order].T) if owner else np.zeros((len(_A), 0), dtype=np.int32)
        # a first look at the lowest bits spares most minima the search
        self.seen = np.zeros((len(_A), 1 << 16), dtype=bool) if 0 < len(owner) <= 1 << 13 else None
        if self.seen is not None:
            for i in range(len(_A)):
                self.seen[i, self.minima[i] & np.uint32(0xFFFF)] = True
        self.runs = {}
        for size, listed in runs.items():
            keys = np.concatenate([k for k, _ in listed])
            order = np.argsort(keys, kind="stable")
            self.runs[size] = (keys[order], np.concatenate([np.full(len(k), at) for k, at in listed])[order])

    def probe(self, i: int, minima: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position in ``minima``, item) of equal minima of hash function ``i``."""
        at = np.arange(len(minima)) if self.seen is None else np.flatnonzero(self.seen[i][minima & np.uint32(0xFFFF)])
        yield from _equal(self.minima[i], self.owner[i], minima[at], at)

    def probe_runs(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first and last place) of word runs of short items."""
        for size, (keys, owner) in self.runs.items():
            hashes = mixed_hashes(words, size)
            for at, item in _equal(keys, owner, hashes, np.arange(len(hashes))):
                yield item, at, at + size


def _equal(keys: np.ndarray, owner: np.ndarray, values: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place, owner) of every sorted key that equals a value."""
    if not len(keys):
        return
    left = np.searchsorted(keys, values, side="left")
    for j in np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == values):
        k = left[j]
        while k < len(keys) and keys[k] == values[j]:
            yield int(places[j]), int(owner[k])
            k += 1


def aligned_words(item: np.ndarray, text: np.ndarray) -> int:
    """Most item words that one stretch of ``text`` repeats in order, where
    between two repeated words at most one item word is missing or changed and
    at most ``LAYOUT_WORDS`` words are added."""
    words = item.tolist()
    places: dict[int, list[int]] = {w: [] for w in words}
    for j, w in enumerate(text.tolist()):
        if w in places:
            places[w].append(j)
    best = 0
    before: dict[int, int] = {}
    before2: dict[int, int] = {}
    for w in words:
        now: dict[int, int] = {}
        for j in places[w]:
            reach = max(before2.get(j - 1, 0), before2.get(j - 2, 0))
            for k in range(1, LAYOUT_WORDS + 2):
                if (n := before.get(j - k, 0)) > reach:
                    reach = n
            now[j] = reach + 1
            best = max(best, reach + 1)
        before, before2 = now, before
    return best


def _common(keys: np.ndarray, values: np.ndarray) -> int:
    """How many of the sorted distinct ``keys`` are among the values."""
    if not len(keys):
        return 0
    at = np.searchsorted(keys, values)
    return len(set(at[keys[np.minimum(at, len(keys) - 1)] == values].tolist()))


def _window_hits(hashes: list[np.ndarray], index: ItemIndex) -> dict[tuple[int, int], list[int]]:
    """(document, item) -> first and last shingle of the windows that share minima."""
    hits: dict[tuple[int, int], list[int]] = {}
    by_size: list[list[int]] = [[] for _ in SIZES]
    for at, h in enumerate(hashes):
        if len(h):
            by_size[next((i for i, s in enumerate(SIZES) if len(h) <= s), len(SIZES) - 1)].append(at)
    for part, docs in enumerate(by_size):
        low = 0
        while low < len(docs):
            high, total = low, 0
            while high < len(docs) and (high == low or total + len(hashes[docs[high]]) <= CACHED):
                total += len(hashes[docs[high]])
                high += 1
            chunk, low = docs[low:high], high
            flat = np.concatenate([hashes[at] for at in chunk]).astype(np.uint32)
            sizes = np.array([len(hashes[at]) for at in chunk])
            blocks = -(-sizes // WINDOW_STEP)
            owner = np.repeat(np.arange(len(chunk)), blocks)
            first = np.cumsum(blocks) - blocks
            within = (np.arange(len(owner)) - first[owner]) * WINDOW_STEP
            edges = np.repeat(np.cumsum(sizes) - sizes, blocks) + within
            # a window is a block and the next of its document; a document of one block is one window
            left = np.flatnonzero((np.arange(len(owner)) + 1 < (first + blocks)[owner]) | (blocks[owner] == 1))
            right = np.where(blocks[owner[left]] == 1, left, left + 1)
            scaled = np.empty_like(flat)
            for i in range(MINIMA[part]):
                np.multiply(flat, _A[i], out=scaled)
                np.add(scaled, _B[i], out=scaled)
                each = np.minimum.reduceat(scaled, edges)
                for at, item in index.probe(i, np.minimum(each[left], each[right])):
                    doc, a = chunk[owner[left[at]]], int(within[left[at]])
                    span = hits.setdefault((doc, item), [a, a + WINDOW])
                    span[0], span[1] = min(span[0], a), max(span[1], a + WINDOW)
    return hits


def probe_documents(texts: list[str | None], index: ItemIndex, hasher: _Hasher) -> list[tuple[int, int, int, float]]:
    """(position, item position, aligned words, exact shingle containment)."""
    words = [hasher(words_of(t)) if t else np.zeros(0, dtype=np.uint64) for t in texts]
    hashes = [shingle_hashes(w) for w in words]
    hits = _window_hits(hashes, index) if index.owner.size else {}
    for doc, w in enumerate(words if index.runs else []):
        for item, a, b in index.probe_runs(w):
            span = hits.setdefault((doc, item), [a, b])
            span[0], span[1] = min(span[0], a), max(span[1], b)
    out = []
    for (doc, item), (a, b) in hits.items():
        own = index.words[item]
        reach = 2 * len(own)
        near = words[doc][max(0, a - reach) : b + SHINGLE + reach]
        shared = _common(index.shingles[item], hashes[doc][max(0, a - reach) : b + reach])
        if len(own) > SHORT and shared < LEAST_SHARED:  # a stray phrase
            continue
        aligned = aligned_words(own, near)
        if aligned >= words_needed(len(own)):
            out.append((doc, item, aligned, float(shared) / max(1, len(index.shingles[item]))))
    return out


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """(doc_id, item_id, aligned_words, containment) of every document and each
    item of which one stretch of it repeats at least ``LEAST_SHARE``.

    Repeated items and documents count once per id. Null or blank texts leak
    nothing; items of fewer than ``SHINGLE`` words cannot be found. Whole
    texts are searched, however long. Other columns are ignored.
    """
    spark = documents.sparkSession
    listed = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").dropDuplicates(["i"])
    rows = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    schema = T.StructType(
        [
            T.StructField(doc_id, rows.schema["d"].dataType),
            T.StructField(item_id, listed.schema["i"].dataType),
            T.StructField("aligned_words", T.IntegerType()),
            T.StructField("containment", T.DoubleType()),
        ]
    )
    blocks = max(1, math.ceil(listed.count() / BLOCK))
    found = None
    for block in range(blocks):
        mine = listed if blocks == 1 else listed.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block)
        index = spark.sparkContext.broadcast(ItemIndex([(r["i"], r["t"]) for r in mine.collect()]))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            hasher = _Hasher()
            for batch in batches:
                for low in range(0, len(batch), 2000):
                    part = batch.iloc[low : low + 2000]
                    ids = part["d"].to_numpy()
                    hits = probe_documents(part["t"].tolist(), index.value, hasher)
                    yield pd.DataFrame([(ids[d], index.value.ids[i], n, c) for d, i, n, c in hits], columns=schema.names)

        one = rows.mapInPandas(search, schema)
        found = one if found is None else found.unionByName(one)
    return found.dropDuplicates([doc_id, item_id])
