"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np

from roomledger.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [Counter(terms(t)) for _, t in docs]
    n_docs, total = sum(map(bool, bags)), sum(b.total() for b in bags)
    df = Counter(t for b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scores = []
        for (doc_id, _), bag in zip(docs, bags, strict=True):
            if bag:
                m = 100 - 90 + (90 * bag.total() * n_docs) // total
                score = sum(weight[t] * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in set(terms(text)) if t in bag)
                if score > 0:
                    scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(n)]
    odd = [(None, docs[0][1]), (None, "É é x"), (n, None), (n + 1, ""), (n + 2, "-- !"), (3, docs[3][1]), (3, docs[3][1]), (n + 3, "É é ÀX ax"), (n + 4, "w1 " * 5000), (n + 5, "日本 w2 w3")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(40)]
    return [*docs, *odd], [*items, (41, None), (42, ""), (43, "É É é ax"), (None, "w2 w3"), (7, "w2 w3 unknownword"), (44, "W1 W5")]


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(4)
    return d, spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, rank string")


def test_ranked(spark, monkeypatch):
    docs, items = corpus(1, 700)
    d, q = frames(spark, docs, items)
    found = lexical.ranked(d, q)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, items)
    monkeypatch.setattr(lexical, "ITEMS", 7)
    assert sorted(map(tuple, lexical.ranked(d, q, k=3, block=16).collect()), key=repr) == brute(docs, items, 3)


def test_nothing(spark):
    docs, items = corpus(2, 5)
    d, q = frames(spark, docs, items)
    assert lexical.ranked(d.limit(0), q).collect() == [] and lexical.ranked(d, q.limit(0)).collect() == []
    assert lexical.ranked(d.where("text IS NULL"), q).collect() == []


def test_search_block_skips_nothing_that_counts():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 200))
        lists = []
        for _ in range(rng.integers(1, 8)):
            places = np.flatnonzero(rng.random(n) < rng.choice([0.02, 0.3, 0.9]))
            if len(places):
                lists.append((places, rng.integers(1, 50, len(places))))
        if not lists:
            continue
        scores = np.zeros(n, np.int64)
        for places, s in lists:
            scores[places] += s
        least = int(rng.integers(1, 120))
        places, found = lexical.search_block(lists, n, least)
        assert places.tolist() == np.flatnonzero(scores >= least).tolist() and found.tolist() == scores[places].tolist()
