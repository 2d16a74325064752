"""Problem 8: planted passages are found, scraps are not; recall against brute force."""

import random

import numpy as np

from strandline.llm import leaks

VOCABULARY = [f"w{i}" for i in range(900)]


def make(coin, n):
    return [coin.choice(VOCABULARY) for _ in range(n)]


def test_planted_passages(spark):
    coin = random.Random(11)
    items = {i: make(coin, coin.randrange(49, 120)) for i in range(60)}
    docs, truth = [], set()
    for d in range(400):
        words = make(coin, coin.choice((10, 80, 300, 1500)))
        i = coin.randrange(60)
        item = items[i]
        kind = d % 4
        if kind < 3:
            share = (1.0, 0.47, 0.3)[kind]
            n = int(share * len(item))
            start = coin.randrange(len(item) - n + 1)
            part = item[start : start + n]
            if kind < 2:
                truth.add((d, i))
                for at in range(9, len(part) - 9, 11 if kind == 0 else 16):
                    part[at] = coin.choice(("changed", "other"))
            at = coin.randrange(len(words))
            words[at:at] = part
        text = " ".join(words)
        if d % 5 == 0:
            text = "<p>" + text.upper().replace(" W1", ",  W1", 3).replace(" W2", "\nW2") + "</p>"
        docs.append((d, text))
    docs += [(1_000, docs[0][1]), (1_001, None), (1_002, ""), (1_003, " ".join(make(coin, 60_000) + items[7]))]
    truth |= {(1_000, i) for d, i in truth if d == 0} | {(1_003, 7)}
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id bigint, text string, d int, t string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(0, " ".join(items[0])), (98, None), (99, "too short")], "item_id bigint, item_text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(df, it).collect()}
    assert got == truth


def test_candidates_against_brute_force():
    coin = random.Random(3)
    items = [(i, " ".join(make(coin, 80))) for i in range(40)]
    index, hasher = leaks.ItemIndex(items), leaks._Hasher()
    texts = []
    for _ in range(200):
        words = make(coin, 400)
        own = items[coin.randrange(40)][1].split()
        n = coin.randrange(9, 40)
        words[100:100] = own[:n]
        texts.append(" ".join(words))
    found = set()
    least, leaks.LEAST_SHARE = leaks.LEAST_SHARE, 0.0
    try:
        found = {(d, i) for d, i, _, _ in leaks.probe_documents(texts, index, hasher)}
    finally:
        leaks.LEAST_SHARE = least
    exact = set()
    for d, t in enumerate(texts):
        h = leaks.shingle_hashes(hasher(leaks.words_of(t)))
        exact |= {(d, i) for i, s in enumerate(index.shingles) if np.isin(s, h).sum() >= leaks.LEAST_SHARED}
    assert len(exact & found) >= 0.99 * len(exact)


def test_alignment_allows_isolated_changes_only():
    item = np.arange(1, 51, dtype=np.uint64)
    text = item.copy()
    text[[10, 20, 30]] = 0
    assert leaks.aligned_words(item, text) == 47
    text[25:28] = 0
    assert leaks.aligned_words(item, text) < 30
    assert leaks.aligned_words(item, np.zeros(0, dtype=np.uint64)) == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 2)
    coin = random.Random(5)
    items = [(i, " ".join(make(coin, 60))) for i in range(5)]
    df = spark.createDataFrame([(i, t) for i, t in items], "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, item_text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in leaks.leaked_items(df, it).collect()) == [(i, i) for i in range(5)]


def test_short_items(spark):
    coin = random.Random(6)
    items = [(n, " ".join(f"x{n}q{i}" for i in range(n))) for n in (1, 3, 4, 5, 8, 12, 20, 22)]
    docs, truth = [], set()
    for d, (n, text) in enumerate(items):
        around, words = make(coin, 300), text.split()
        docs.append((10 * d, " ".join(around[:150] + words + around[150:])))  # verbatim
        truth.add((10 * d, n))
        need = leaks.words_needed(n)
        if n > 5:
            docs.append((10 * d + 1, " ".join(around[:150] + words[-need:] + around[150:])))  # two fifths, verbatim
            truth.add((10 * d + 1, n))
            docs.append((10 * d + 2, " ".join(around[:150] + words[: need - 2] + around[150:])))  # a scrap
        if need >= 6:
            docs.append((10 * d + 3, " ".join(around[:150] + words[:3] + ["changed"] + words[4 : need + 1] + around[150:])))
            truth.add((10 * d + 3, n))
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(df, it).collect()} == truth


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    it = spark.createDataFrame([], "item_id bigint, item_text string")
    assert leaks.leaked_items(df, it).count() == 0
