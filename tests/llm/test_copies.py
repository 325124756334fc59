"""Exact and near copies against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from roomledger.llm import exact_dedup, minhash, simhash
from roomledger.llm.common import Steps
from roomledger.llm.graph import components

ROWS = [
    (5, "a b"), (3, "ab "), (4, "ab "), (9, "a b"), (1, ""), (2, None), (None, "  "), (None, "q"), (7, "q"), (7, "q"),
    (8, "x" * 100_000), (6, "x" * 99_999 + " x"), (11, "É\tß"), (10, "Éß"),
]


def brute_groups(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d if d is not None else 0))
    out = []
    for d, t in rows:
        group = groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
        _, none, keep = min(group)
        out.append((d, None if none else keep, len(group)))
    return sorted(out, key=repr)


def test_exact_groups(spark):
    df = spark.createDataFrame([(d, t, 0, "k") for d, t in ROWS], "doc_id long, text string, group_size int, kept string").repartition(3)
    found = exact_dedup.exact_groups(df)
    assert sorted(((r[0], r[1], r[2]) for r in found.collect()), key=repr) == brute_groups(ROWS)
    kept = [r for r in found.collect() if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in found.collect()}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_groups(df.limit(0)).collect() == []


def test_deduplicate_keeps_columns_and_one_row_of_each(spark):
    df = spark.createDataFrame([(d, t, f"s{i}", 1, "x") for i, (d, t) in enumerate(ROWS)], "doc_id long, text string, source string, _n int, key string")
    found = exact_dedup.deduplicate(df.repartition(3))
    assert found.columns == df.columns and {(r["_n"], r["key"]) for r in found.collect()} == {(1, "x")}
    assert sorted((r[0], len(r[1] or ""), r[2]) for r in found.collect() if r[0] is not None) == sorted(
        [(3, 3, "s1"), (9, 3, "s3"), (6, 100_001, "s11"), (7, 1, "s8"), (11, 3, "s12")]
    )
    assert [(r[0], r[1]) for r in found.collect() if r[0] is None] == [(None, "  ")]


def test_many_copies_of_one_text(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot text' ELSE concat('t', id) END AS text").repartition(20)
    found = exact_dedup.exact_groups(df).where("group_size > 1")
    assert found.count() == 1667 and [r[0] for r in found.where("kept").select("doc_id").collect()] == [0]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                label[root(i)] = root(j)
    first = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            first[root(i)].append(d)
    return sorted(((d, f"{prints[i]:016x}", min(first[root(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.fixture
def near_rows():
    random.seed(2)
    base = [[random.choice("abcdefghij") * random.randrange(1, 5) for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(160):
        words = list(random.choice(base))
        for _ in range(random.randrange(3)):
            words[random.randrange(60)] = "changed" + str(i)
        rows.append((1000 - i, " ".join(words)))
    return [*rows, (None, rows[0][1]), (1, None), (2, ""), (3, "One two"), (4, "one TWO"), (5, "É é"), (5, "É é"), (None, "alone here"), (6, "y " * 30_000)]


def test_near_groups(spark, near_rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in near_rows], "doc_id long, text string, component_id int").repartition(4)
    assert sorted((tuple(r) for r in simhash.near_groups(df).collect()), key=repr) == brute_components(near_rows)
    assert simhash.near_groups(df.limit(0)).collect() == []


def test_near_groups_with_hot_bands(spark, near_rows, monkeypatch):
    monkeypatch.setattr(simhash, "TREE", 4)
    df = spark.createDataFrame(near_rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in simhash.near_groups(df).collect()), key=repr) == brute_components(near_rows)


def test_near_deduplicate(spark, near_rows):
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(near_rows)], "doc_id long, text string, row int").repartition(4)
    found = simhash.near_deduplicate(df)
    groups = {(f if c is None else c) for _, f, c in brute_components(near_rows)}
    assert found.columns == df.columns and found.count() == len(groups)
    assert {r["doc_id"] for r in found.collect() if r["doc_id"] is not None} == {g for g in groups if isinstance(g, int)}


def test_linked_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(10):
        base = rng.integers(0, 2**63, 5, dtype=np.uint64)
        fp = {int(base[rng.integers(5)]) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 8)))) for _ in range(200)}
        fp = np.array(list(fp), dtype=np.uint64)
        tree = np.sort(rng.integers(0, 3, len(fp)))
        label = list(range(len(fp)))
        for i in range(len(fp)):
            for j in range(i):
                if tree[i] == tree[j] and int(fp[i] ^ fp[j]).bit_count() <= 3:
                    a, b = label[i], label[j]
                    label = [min(a, b) if x in (a, b) else x for x in label]
        assert simhash.linked(tree, fp).tolist() == label


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 101), (101, 100)]])
def test_components(spark, links):
    found = components(Steps(spark, "t"), spark.createDataFrame(links, "a long, b long"))
    groups = defaultdict(set)
    for r in found.collect():
        groups[r["label"]].add(r["node"])
    nodes = {frozenset(g) for g in groups.values()}
    if len(links) == 60:
        assert nodes == {frozenset(range(61))}
    elif len(links) > 10:
        assert nodes == {frozenset(range(50)), frozenset({100, 101})}
    else:
        assert nodes == set()


def test_near_deduplicate_by_similarity_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice([40, 150, 400]))] for _ in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    line = " ".join(f"same{i}" for i in range(12))
    for i in range(300):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(1 + len(words) // 25)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words) + (f" {line}" if i % 3 == 0 else "")))
    passage = "again and again " * 400
    rows += [(2001, passage + " ".join(base[0])), (2002, passage + " ".join(base[1])), (2003, ""), (2004, None), (2005, "Two words"), (2006, "two WORDS")]

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    wide = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                wide += (simhash.fingerprint(rows[i][1] or "") ^ simhash.fingerprint(rows[j][1] or "")).bit_count() > 3
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    groups = defaultdict(list)
    for x, (d, _) in zip(label, rows, strict=True):
        groups[x].append(d)
    assert wide > 100
    monkeypatch.setattr(minhash, "TREE", 16)
    found = simhash.near_deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), by_similarity=True)
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(map(min, groups.values()))
