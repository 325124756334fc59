"""Exact top-k search and removal of repeated passages against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from roomledger.llm import substring_dedup, topk


def brute_top_k(rows, k, queries):
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    known = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and good(v)]
    out = []
    for q, v in known:
        if queries(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in known if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [1, 2048])
def test_top_k_with_ties_repeats_and_bad_rows(spark, block):
    random.seed(5)
    rows = [(i, [random.choice([-1.5, -0.25, 0.0, 0.3, 2.0]) for _ in range(3)]) for i in range(60)]
    rows += [(7, [0.5, 0.5, 0.5]), (100, None), (None, [1.0, 1.0, 1.0]), (101, [1.0, None, 1.0]), (102, [float("nan"), 0.0, 0.0])]
    rows += [(103, [float("inf"), 0.0, 0.0]), (120, [1.0, 1.0]), (121, [2.0, 1.0]), (140, []), (200 + 20, [0.1, 0.1, 0.1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    found = topk.top_k(df, "vec_id % 20 = 0", k=5, block=block)
    assert sorted(tuple(r) for r in found.collect()) == brute_top_k(rows, 5, lambda i: i % 20 == 0)


def test_top_k_wide_scores_fewer_than_k_and_nothing(spark):
    rows = [(20 * i, [float(10 ** (i + 2)), -float(i)]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, "true", k=20).collect()) == brute_top_k(rows, 20, lambda i: True)
    assert topk.top_k(df.limit(0), "true").collect() == []
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e18])], df.schema), "true").collect()


def brute_repeats(rows, width):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    out = []
    for d, ws in words:
        gone = set()
        for i in range(len(ws) - width + 1):
            if d is not None and any(
                e is not None and e < d and any(vs[j : j + width] == ws[i : i + width] for j in range(len(vs) - width + 1)) for e, vs in words
            ):
                gone.update(range(i, i + width))
        kept = [w for i, w in enumerate(ws) if i not in gone]
        out.append((d, len(ws), len(gone), b" ".join(kept).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_equal_brute_force(spark, seed):
    random.seed(seed)
    passages = [" ".join(random.choice("abcdefgh") for _ in range(9)) for _ in range(4)]
    rows = [
        (random.randrange(40), " \n".join(random.choice([*passages, "x", "y z", "é", random.choice("abc") * 3]) for _ in range(random.randrange(7))))
        for _ in range(60)
    ]
    rows += [(None, passages[0]), (3, None), (4, ""), (41, passages[1]), (41, passages[1]), (42, " ".join(passages * 40))]
    df = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, start int, words string").repartition(5)
    found = substring_dedup.remove_repeats(df, width=5).select("doc_id", "n_words", "n_removed", "kept_text")
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_repeats(rows, 5)


def test_repeats_of_a_hot_reference_and_of_nothing(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"own{i} " * 3 + text + f" end{i}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    found = {r["doc_id"]: r for r in substring_dedup.remove_repeats(df).collect()}
    assert found[0]["n_removed"] == 0 and all(found[i]["n_removed"] == 40 for i in range(1, 1500))
    assert found[9]["kept_text"] == "own9 own9 own9 end9" and [tuple(s) for s in found[9]["removed"]] == [(3, 43)]
    assert substring_dedup.remove_repeats(df.limit(0)).collect() == []


def test_automaton_spans_equal_brute_force():
    random.seed(3)
    for _ in range(500):
        texts = [[random.choice([b"a", b"b", b"c"]) for _ in range(random.randint(0, 12))] for _ in range(random.randint(1, 3))]
        automaton = substring_dedup.SuffixAutomaton()
        for text in texts:
            automaton.add(text)
        asked = [random.choice([b"a", b"b", b"c", b"d"]) for _ in range(random.randint(0, 15))]
        n = random.randint(1, 4)
        covered = set()
        for i in range(len(asked) - n + 1):
            if any(t[j : j + n] == asked[i : i + n] for t in texts for j in range(len(t) - n + 1)):
                covered |= set(range(i, i + n))
        assert {p for a, b in automaton.spans(asked, n) for p in range(a, b)} == covered


def dealt_and_met(batches, width):
    """Suspects (doc, first) of batches of (doc, text), without Spark."""
    made = [pa.record_batch([pa.array([d for d, _ in b], pa.int64()), pa.array([t for _, t in b])], ["doc", "text"]) for b in batches]
    table = pa.Table.from_batches(list(substring_dedup._deal(iter(made), width, np.zeros(0, np.uint64)))).sort_by("h")
    found = substring_dedup._meet(iter(table.combine_chunks().to_batches()))
    return sorted((r["doc"], r["first"]) for b in found for r in b.to_pylist())


def test_a_window_with_a_colliding_short_hash_hides_no_earlier_document():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    runs = [" ".join(word() for _ in range(5)) for _ in range(20_000)]
    _, _, dealt, _ = substring_dedup._windows(runs, 5)
    run, least = runs[int(dealt.argmin())], dealt.min()
    texts = [" ".join([run, *(word() for _ in range(8))]) for _ in range(250_000)]
    _, _, dealt, own = substring_dedup._windows(texts, 13)
    same = np.flatnonzero(dealt == least)
    short = own[same].astype(np.uint32)
    order = np.argsort(short, kind="stable")
    pair = np.flatnonzero(short[order][1:] == short[order][:-1])[0]
    x, y = (texts[same[order[pair + i]]] for i in (0, 1))
    assert x != y
    assert dealt_and_met([[(1, x)], [(2, y)], [(3, y)]], 13) == [(3, 2)]


def test_windows_of_a_hot_run_do_not_meet_in_one_task(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**9)}"
    runs = [" ".join(word() for _ in range(5)) for _ in range(20_000)]
    _, _, dealt, _ = substring_dedup._windows(runs, 5)
    run = runs[int(dealt.argmin())]
    rows = [(i, " ".join([*(word() for _ in range(8)), run, *(word() for _ in range(8))])) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "doc long, text string").repartition(40)
    monkeypatch.setattr(substring_dedup, "SAMPLED", 10_000)
    hot = substring_dedup.hot_runs(df, 13)
    assert len(hot) == 1
    made = substring_dedup._deal(iter([pa.record_batch([[d for d, _ in rows[:300]], [t for _, t in rows[:300]]], ["doc", "text"])]), 13, hot)
    _, counts = np.unique(pa.Table.from_batches(list(made)).column("h").to_numpy(), return_counts=True)
    assert counts.max() == 1
    found = substring_dedup.remove_repeats(df.withColumnRenamed("doc", "doc_id"), 13).collect()
    assert {r["doc_id"] for r in found if r["n_removed"]} == {d for d, _ in rows[300:]}
    assert all(r["n_removed"] in (0, 21) for r in found)
