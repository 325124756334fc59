import os
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from conftest import values
from pyspark.sql import functions as F

from roomledger.operators import cells, vectors


def table(spark, matrix, name, ids=None):
    ids = ids if ids is not None else list(range(len(matrix)))
    kind = "string" if isinstance(ids[0], str) else "bigint"
    data = [(i, [float(v) for v in row]) for i, row in zip(ids, matrix)]
    return spark.createDataFrame(data, f"{name} {kind}, embedding array<float>")


def brute(queries, corpus, k, ids=None):
    ids = ids if ids is not None else list(range(len(corpus)))
    q, c = queries.astype(np.float32).astype(float), corpus.astype(np.float32).astype(float)
    out = []
    for i, row in enumerate(q):
        dist = np.round(((c - row) ** 2).sum(1), 9)
        best = sorted(zip(dist, ids))[:k]
        out += [(i, rank, vid, d) for rank, (d, vid) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("copies", [False, True])
def test_search_equals_brute_force(spark, block, copies):
    rng = np.random.default_rng(4)
    corpus, queries = rng.normal(size=(500, 8)), rng.normal(size=(25, 8))
    if copies:  # a third of the corpus is one vector, and a query sits on it
        corpus[::3] = corpus[0]
        queries[0] = corpus[0]
    df = vectors.knn(table(spark, queries, "query_id"), table(spark, corpus, "vec_id").repartition(5), 6, block=block)
    got = sorted(values(df))
    want = brute(queries, corpus, 6)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-9)


def test_text_ids_and_small_corpus(spark):
    corpus = np.eye(3)
    df = vectors.knn(table(spark, corpus[:1], "query_id"), table(spark, corpus, "vec_id", ["c", "b", "a"]), 5)
    assert [r[2] for r in sorted(values(df))] == ["c", "a", "b"]


def test_empty_sides(spark):
    some = table(spark, np.eye(2), "vec_id")
    queries = table(spark, np.eye(2), "query_id")
    assert vectors.knn(queries.limit(0), some).count() == 0
    assert vectors.knn(queries, some.limit(0)).count() == 0
    assert vectors.validate_vectors(some.limit(0), queries).first().status == "empty"


def test_dimension_mismatch(spark):
    corpus, queries = table(spark, np.eye(3), "vec_id"), table(spark, np.eye(2), "query_id")
    assert vectors.validate_vectors(corpus, queries).first().status == "dimension mismatch"
    assert vectors.validate_vectors(corpus, corpus).first().status == "ok"
    with pytest.raises(Exception, match="dimension"):
        vectors.knn(queries, corpus).collect()


def test_hashing_encoder():
    encode = vectors.hashing_encoder(16)
    a, b, empty = encode(["Hello, hello world!", "world HELLO hello", " ... "])
    assert a.dtype == np.float32 and np.allclose(a, b) and not empty.any()
    assert np.linalg.norm(a) == pytest.approx(1, abs=1e-6)


def test_own_encoder_runs_in_batches(spark):
    def make():
        def encode(texts):
            assert len(texts) <= 3
            return np.array([[len(t), len(texts)] for t in texts], dtype="float64")

        return encode

    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: list(r.embedding) for r in vectors.embed(df, make_encoder=make, batch_size=3).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: float(i) for i in range(10)}


def test_cache_embeds_only_new_texts(spark, tmp_path):
    path = str(tmp_path / "vectors")

    def marking(mark):
        def make():
            return lambda texts: np.array([[mark, len(t)] for t in texts])

        return make

    first = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: list(r.embedding) for r in vectors.embed_cached(first, path, "m", make_encoder=marking(1)).collect()}
    assert got == {1: [1, 2], 2: [1, 2], 3: [1, 1], 4: [1, 0]}
    assert spark.read.parquet(path).count() == 3
    more = first.union(spark.createDataFrame([(5, "cccc")], "doc_id bigint, text string"))
    got = {r.doc_id: list(r.embedding) for r in vectors.embed_cached(more, path, "m", make_encoder=marking(2)).collect()}
    assert got[5] == [2, 4] and got[1] == [1, 2]
    got = {r.doc_id: list(r.embedding) for r in vectors.embed_cached(more, path, "m", make_encoder=marking(3), force=True).collect()}
    assert got[1] == [3, 2] and pd.Series(got).size == 5


def test_cache_keeps_encoders_apart(spark, tmp_path):
    path = str(tmp_path / "vectors")
    df = spark.createDataFrame([(1, "aa"), (2, "b")], "doc_id bigint, text string")

    def of(dim, **options):
        made = vectors.embed_cached(df, path, f"hash-{dim}", make_encoder=lambda: vectors.hashing_encoder(dim), **options)
        return {len(r.embedding) for r in made.collect()}

    assert of(8) == {8} and of(16) == {16} and of(8) == {8}
    assert of(16, force=True) == {16} and of(8) == {8}
    assert spark.read.parquet(path).count() == 4


def test_embedding_keeps_the_parts(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(64)], "doc_id bigint, text string").repartition(64)
    made = vectors.embed(df)
    assert made.rdd.getNumPartitions() == 64
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1  # the test's own


def test_repeated_query_ids_are_queries_of_their_own(spark):
    queries = table(spark, np.array([[0.0, 0], [9, 9]]), "query_id", [1, 1])
    corpus = table(spark, np.array([[0.0, 1], [0, 2], [9, 8]]), "vec_id")
    got = sorted(values(vectors.knn(queries, corpus, 2)))
    assert [(g[0], g[1], g[2]) for g in got] == [(1, 1, 0), (1, 1, 2), (1, 2, 1), (1, 2, 1)]


@pytest.mark.parametrize("block", [4096, 2])
@pytest.mark.parametrize("few", [False, True])
def test_queries_without_a_finite_vector_are_as_far_from_every_row(spark, block, few):
    """They ended in an error, or got no neighbours."""
    corpus = np.random.default_rng(5).normal(size=(600, 3))
    nan, inf = float("nan"), float("inf")
    given = [(0, None), (1, [nan, 0.0, inf]), (2, [0.0, -inf, 0.0]), (2, None)] + ([] if few else [(i, [float(i), 0.0, 0.0]) for i in range(3, 8)])
    queries = spark.createDataFrame(given, "query_id bigint, embedding array<float>")
    got = sorted(values(vectors.knn(queries, table(spark, corpus, "vec_id", list(range(600, 0, -1))), 2, block=block)), key=repr)
    want = [(q, rank, rank, d) for q, d in ((0, None), (1, nan), (2, inf), (2, None)) for rank in (1, 2)]
    assert [repr(g) for g in got[:8]] == sorted(map(repr, want))
    near = brute(np.array([[i, 0.0, 0.0] for i in range(3, 8)]), corpus, 2, list(range(600, 0, -1)))
    assert [g[:3] for g in got[8:]] == ([] if few else [(n[0] + 3, *n[1:3]) for n in near])
    assert vectors.knn(queries, table(spark, corpus, "vec_id").limit(0), 2, block=block).count() == 0


@pytest.mark.parametrize("copies", [False, True])
def test_cells_find_the_nearest_and_skip_pairs(spark, copies):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8)) * 20
    corpus = centres[rng.integers(12, size=4000)] + rng.normal(size=(4000, 8))
    if copies:  # a third is one vector
        corpus[::3] = corpus[0]
    queries = np.concatenate([corpus[:40], rng.normal(size=(5, 8)) * 30])
    index = cells.build_cells(table(spark, corpus, "vec_id").repartition(5))
    assert index.blocks.agg({"n": "sum"}).first()[0] == 4000 and index.blocks.agg({"n": "max"}).first()[0] <= cells.BLOCK
    found = cells.search_cells(table(spark, queries, "query_id"), index, 6)
    got, want = sorted(values(found.neighbours)), brute(queries, corpus, 6)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert found.compared < 0.6 * 45 * 4000
    near = cells.search_cells(table(spark, queries, "query_id"), index, 6, probes=4)
    hits = {g[0::2] for g in values(near.neighbours)} & {w[0::2] for w in want}
    assert near.compared < found.compared * 2 and len(hits) >= 0.8 * len(want)


def test_cells_of_few_vectors(spark):
    some = table(spark, np.eye(3), "vec_id", ["c", "b", "a"])
    found = cells.search_cells(table(spark, np.eye(3)[:1], "query_id"), cells.build_cells(some), 5)
    assert [r[2] for r in sorted(values(found.neighbours))] == ["c", "a", "b"]
    assert cells.search_cells(some, cells.build_cells(some.limit(0)), 2, query_id="vec_id").neighbours.count() == 0
    with pytest.raises(Exception, match="dimension"):
        cells.search_cells(table(spark, np.eye(2), "query_id"), cells.build_cells(some)).neighbours.collect()


@pytest.mark.parametrize("probes", [None, 8])
def test_cells_make_no_row_for_each_query_and_block(spark, monkeypatch, probes):
    corpus = np.random.default_rng(8).normal(size=(1500, 16))
    index = cells.build_cells(table(spark, corpus, "vec_id"))
    sizes, stored = [], cells.stored
    monkeypatch.setattr(cells, "stored", lambda df, name, **options: (sizes.append((made := stored(df, name, **options)).count()), made)[1])
    found = cells.search_cells(table(spark, corpus, "vec_id"), index, 2, query_id="vec_id", probes=probes)
    # at most k for each query and shard of blocks; before, a row for each query and block it meets
    assert max(sizes) <= 1500 * 2 * 3 < 1500 * 8 <= 1500 * index.blocks.count()
    if probes is None:
        assert [g[:3] for g in sorted(values(found.neighbours))] == [w[:3] for w in brute(corpus, corpus, 2)]


def test_cells_of_copies_in_several_blocks_and_tiles(spark, monkeypatch):
    """Ties go to the smaller id, also between blocks, and a corpus in doubles meets queries in floats."""
    monkeypatch.setattr(cells, "TILE", 64)
    corpus = np.random.default_rng(9).normal(size=(1800, 4))
    corpus[::2] = corpus[0]
    doubles = table(spark, corpus, "vec_id").selectExpr("vec_id", "cast(embedding AS array<double>) embedding")
    queries = table(spark, corpus[:200], "query_id")
    got = sorted(values(cells.search_cells(queries, cells.build_cells(doubles), 4).neighbours))
    assert [g[:3] for g in got] == [w[:3] for w in brute(corpus[:200], corpus, 4)]


@pytest.mark.parametrize("probes", [None, 6])
def test_blocks_are_searched_where_they_are_stored(spark, monkeypatch, probes):
    """Each tile of queries had all blocks shuffled to it, so the disk grew with queries times vectors."""
    monkeypatch.setattr(cells, "TILE", 100)
    corpus, plans, stored = np.random.default_rng(11).normal(size=(1500, 6)), [], cells.stored

    def seen(frames, name, **options):
        def one_by_one():
            for df in [frames] if hasattr(frames, "columns") else frames:
                if name == "scanned":
                    plans.append(df._jdf.queryExecution().executedPlan().toString())
                yield df

        return stored(one_by_one(), name, **options)

    index = cells.build_cells(table(spark, corpus, "vec_id"))
    monkeypatch.setattr(cells, "stored", seen)
    found = cells.search_cells(table(spark, corpus[:350], "query_id"), index, 3, probes=probes)
    assert len(plans) == 4 and not any("Exchange" in plan for plan in plans)
    got, want = sorted(values(found.neighbours)), brute(corpus[:350], corpus, 3)
    if probes is None:
        assert [g[:3] for g in got] == [w[:3] for w in want]
    else:
        assert len(got) == len(want) and len({g[:3:2] for g in got} & {w[:3:2] for w in want}) >= 0.5 * len(want)


def test_centres_are_fitted_in_a_task(spark, monkeypatch):
    """The driver held the sampled vectors and copies of them; now it gets the centres only."""
    driver, fit = os.getpid(), cells.fit_centres

    def in_a_task(x, n):
        assert os.getpid() != driver
        return fit(x, n)

    monkeypatch.setattr(cells, "fit_centres", in_a_task)
    monkeypatch.setattr(cells, "SAMPLE", 100)
    corpus = np.random.default_rng(10).normal(size=(3000, 4)).astype(np.float32)
    some = table(spark, corpus, "vec_id").repartition(20)
    index = cells.build_cells(some)
    hashed = some.select("vec_id", F.xxhash64("vec_id").alias("h"))
    first = [i for i, _ in sorted(values(hashed), key=lambda r: (r[1], r[0]))[:100]]
    assert np.allclose(index.centres, fit(corpus[first].astype(float), 54))


@pytest.mark.parametrize("ids", [1 << 60, 3])
def test_few_rows_meet_for_the_sample(spark, monkeypatch, ids):
    """Every one of 20 tasks sent its first 100 rows to one task, where the sample was put in order."""
    monkeypatch.setattr(cells, "SAMPLE", 100)
    some = spark.range(6000, numPartitions=20).selectExpr(f"id % {ids} AS vec_id")
    low = sorted(h for h, in values(some.select(F.xxhash64("vec_id"))))[:100]
    few = cells._few(some, 6000).select(F.xxhash64("vec_id")).collect()
    assert sorted(h for h, in few)[:100] == low
    if ids > 6000:
        assert len(few) < 400


def test_fitting_centres_holds_few_distances():
    x = np.random.default_rng(3).normal(size=(20_000, 8))
    tracemalloc.start()
    centres = cells.fit_centres(x, 500, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(centres) == 500 and peak < 60e6  # all distances at once take 80 MB, four times over


def test_encoder_remembers_few_words():
    encode = vectors.hashing_encoder(8)
    encode([" ".join(f"w{i}" for i in range(150_000))])
    known = [c.cell_contents for c in encode.__closure__ if isinstance(c.cell_contents, dict)]
    assert [len(k) for k in known] == [vectors.KNOWN_WORDS]
    assert np.allclose(encode(["w149999"]), vectors.hashing_encoder(8)(["w149999"]))


def test_texts_become_python_strings_a_batch_at_a_time(spark):
    def make():
        import gc

        def encode(texts):
            held = sum(isinstance(o, list) and len(o) > 50 and all(isinstance(x, str) and x.startswith("own text") for x in o) for o in gc.get_objects())
            return np.full((len(texts), 1), float(held))

        return encode

    df = spark.createDataFrame([(i, f"own text {i}") for i in range(300)], "doc_id bigint, text string").coalesce(1)
    assert {r.embedding[0] for r in vectors.embed(df, make_encoder=make, batch_size=20).collect()} == {0.0}
