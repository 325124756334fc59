"""MinHash groups against all pairs of shingle sets."""

import random
from collections import defaultdict

import numpy as np
import pytest

from roomledger.llm import minhash
from roomledger.llm.common import Steps


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    first = defaultdict(list)
    for k, (d, _) in zip(label, rows, strict=True):
        if d is not None:
            first[k].append(d)
    found = ((d, len(s), d if not s else min(first[k], default=None)) for (d, _), s, k in zip(rows, sets, label, strict=True))
    return sorted(((d, n, c, d is not None and d == c) for d, n, c in found), key=repr)


def near_copies(seed, n, words, changes):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(5000)}" for _ in range(words)] for _ in range(6)]
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(1 + changes)):
            text[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
        yield 1000 + i, " ".join(text)


ODD = [
    (1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three four five"), (7, "ONE two three\tfour  five"),
    (None, "one two"), (None, "alone here"), (9, "É é"), (9, "É é"), (10, "é É"), (11, "y " * 30_000), (12, "again and again " * 5000),
]


@pytest.fixture
def rows():
    return [*ODD, *near_copies(3, 150, 150, 8), *near_copies(4, 60, 40, 3)]


def test_similar_documents(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, kept int, node string").repartition(4)
    found = minhash.similar_documents(df)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_hot_bands_are_cut_into_trees(spark, rows, monkeypatch):
    monkeypatch.setattr(minhash, "TREE", 8)
    monkeypatch.setattr(minhash, "STAR", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, minhash.similar_documents(df).collect()), key=repr) == brute(rows)


def test_a_chain_of_near_copies_gives_few_links(spark, monkeypatch):
    rng = random.Random(1)
    words, rows = [f"w{i}" for i in range(200)], []
    for i in range(600):
        words[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(words)))
    sent = []
    store = Steps.store

    def counted(steps, df, step):
        out = store(steps, df, step)
        if step in ("star-pairs", "star-links", "open-links"):
            sent.append(out.count())
        return out

    monkeypatch.setattr(Steps, "store", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, minhash.similar_documents(df).collect()), key=repr) == brute(rows)
    assert len(sent) == 3 and sum(sent[1:]) <= 32 * 2 * len(rows) and sent[1] <= sent[0]


def test_no_documents(spark):
    assert minhash.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures_estimate_similarity():
    scheme, rng = minhash.Scheme(), np.random.default_rng(2)
    far = []
    for _ in range(200):
        both, own = rng.integers(0, 2**64, 850, np.uint64), rng.integers(0, 2**64, 150, np.uint64)
        a, b = np.unique(np.concatenate([both, own[:75]])), np.unique(np.concatenate([both, own[75:]]))
        signatures = [minhash.minima(x, scheme).astype(np.uint8)[None] for x in (a, b)]
        sizes = [np.array([len(x)]) for x in (a, b)]
        assert minhash.similar(a, b, 85) and minhash._agreeing(*signatures, *sizes, scheme)[0]
        far.append((signatures[0] == signatures[1]).mean())
    assert abs(np.mean(far) - 0.85) < 0.02


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101), (101, 100)]])
def test_star_components(spark, links):
    found = minhash.star_components(Steps(spark, "t"), spark.createDataFrame(links, "a long, b long"))
    least = {n: n for pair in links for n in pair if pair[0] != pair[1]}
    for _ in links:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert sorted(map(tuple, found.collect())) == sorted(least.items())
