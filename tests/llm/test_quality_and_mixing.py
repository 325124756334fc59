"""Quality scores on held-out labels; the mix against its targets."""

import zlib

import pytest

from roomledger.llm import mixing, quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(scored) > 1000 and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in scored)
    for label in (0, 1):
        rows = [r for r in scored if r["quality"] == label]
        assert sum(r["predicted"] == label for r in rows) >= 0.98 * len(rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert 0.8 * docs.count() < kept.count() < 0.95 * docs.count()


def test_scores_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "some words"), (3, "good words here"), (3, "good words here"), (4, "x " * 50_000)]
    df = spark.createDataFrame([(d, t, "a", 9) for d, t in rows], "doc_id long, text string, score string, held_out int")
    labels = spark.createDataFrame([(3, 1), (3, 0), (1, None), (None, 1), (2, 0), (99, 1)], "doc_id long, quality int")
    found = quality.score_documents(df, labels).collect()
    assert len(found) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert {r["doc_id"]: r["held_out"] for r in found} == {d: zlib.crc32(str(d or "").encode()) % 3 == 1 for d, _ in rows}
    assert quality.score_documents(df.limit(0), labels).collect() == []
    assert {r["score"] for r in quality.score_documents(df, labels.limit(0)).collect()} == {0.5}


def test_pairs_in_linear_time_equal_all_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    machine = quality.Machine(0.2, rng.normal(size=20), rng.normal(size=(20, 3)))
    index, value = np.array([1, 4, 7, 19]), np.array([0.5, 1.0, -0.3, 0.2])
    z = 0.2 + machine.linear[index] @ value
    for i in range(4):
        for j in range(i):
            z += machine.vectors[index[i]] @ machine.vectors[index[j]] * value[i] * value[j]
    assert machine.score(index, value) == pytest.approx(1 / (1 + np.exp(-z)))


def words(n):
    return " ".join("w" for _ in range(n))


@pytest.fixture
def docs(spark):
    sources = ["a"] * 300 + ["b"] * 60 + ["É"] * 5 + [None] * 40 + [""] * 2 + ["z"]
    rows = [(i, words(1 + i * 37 % 90), s, "x", 1) for i, s in enumerate(sources)]
    rows += [(5000, None, "a", "x", 1), (5001, " \n", "only empty", "x", 1), (None, words(30), "b", "x", 1), (7, words(33), "b", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, slot string, taken int").repartition(5)


def test_taken_words(docs):
    found = mixing.taken_words(docs, block_words=64).collect()
    assert len(found) == docs.count()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    by_source = {}
    for r in found:
        by_source.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    for (size, target), taken in by_source.items():
        assert abs(sum(taken) - target) <= 1 and target <= 2 * size + 1e-6
    assert sum(t for _, t in by_source) == pytest.approx(1.5 * sum(s for s, _ in by_source))
    again = mixing.taken_words(docs, block_words=64).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.taken_words(docs.limit(0)).collect() == []


def test_mix_interleaves_and_repeats_whole_documents(docs):
    pieces, rows, sources = mixing.mix(docs, block_words=64)
    placed = pieces.join(rows, "row_id").orderBy("slot", "place").collect()
    slots = sorted({p["slot"] for p in placed})
    assert len(slots) > 100
    for slot in slots:
        mine = [p for p in placed if p["slot"] == slot]
        assert len({p["source"] for p in mine}) == 1
        at = 0
        for p in mine:
            assert p["place"] == at and p["start"] + p["words"] <= p["size"]
            at += p["words"]
    total = sum(p["words"] for p in placed)
    for source in sources.where("target > 500").collect():
        share, seen = source["target"] / total, 0
        for k, slot in enumerate(slots):
            seen += any(p["source"] == source["source"] for p in placed if p["slot"] == slot)
            assert abs(seen - share * (k + 1)) < 6
    copies = mixing.mixed_documents(docs, block_words=64)
    assert copies.columns == docs.columns
    n = sum(len(r["text"].split()) for r in copies.collect())
    assert abs(n - total) < 90 * 8
