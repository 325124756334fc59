"""Token ids, packing and training order against brute force and round trips."""

import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roomledger.llm import packing, training_order
from roomledger.llm.tokens import vocabulary_path, word_encoder
from roomledger.scratch import shared_folder

ODD = ["", None, "One two, three.", "é́ İstanbul ΑΣ Σ. x's we'll 12ab \x1c a b ﬁ <|endoftext|> end", "É!! Ünï. ß, Straße?", "漢字 and 🙂", "word " * 30_000]


def ids_of(text):
    whole = word_encoder(vocabulary_path()).whole
    return [*whole.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_by_word_ids_equal_the_tokenizer(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    encoder = word_encoder(vocabulary_path())
    for text in [*texts, *(t or "" for t in ODD)]:
        whole = encoder.whole.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(whole, "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30), st.sampled_from([1, 4, 50]))
def test_plan_places_every_piece_once(counts, groups):
    runs = packing.plan(counts, capacity=64, groups=groups)
    placed = Counter()
    for contents, n in runs:
        assert sum(contents) <= 64 and n > 0
        for length in contents:
            placed[length] += n
    assert placed == Counter(counts)
    covered = defaultdict(list)
    for length, first, end, *_ in packing.places(runs):
        covered[length].append((first, end))
    for length, n in counts.items():
        at = 0
        for first, end in sorted(covered[length]):
            assert first == at
            at = end
        assert at == n


def test_plan_is_close_to_the_bound():
    random.seed(4)
    counts = Counter(min(4096, int(random.lognormvariate(6.5, 1.1)) + 1) for _ in range(20_000))
    runs = packing.plan(counts)
    bound = -(-sum(n * k for n, k in counts.items()) // 4096)
    assert sum(n for _, n in runs) <= 1.005 * bound + 1


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pack_documents(spark, capacity):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "again"), (3, "One two"), (3, "One two")]
    rows += [(100 + i, "some words here " * (i % 50)) for i in range(300)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, offset int, piece int").repartition(4)
    found = packing.pack_documents(df, capacity=capacity).collect()
    expected = Counter()
    for d, t in rows:
        ids = ids_of(t)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4").tobytes()
            expected[d, piece, start, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r[0], r[1], r[2], r[3], r[4]) for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in found)
    assert len(sequences) <= 1.1 * total / capacity + 2
    assert packing.pack_documents(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 65_537])
def test_permutation(n):
    order = training_order.Permutation(n, "k")
    slots = order.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (order.index(slots) == np.arange(n)).all()
    if n > 100:
        assert (training_order.Permutation(n, "other").slot(np.arange(n)) != slots).any()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.3


def test_shards_round_trip(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "again"), (3, "One two"), (3, "One two")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, slot string").repartition(3)
    ordered = training_order.training_order(df, length=8, shard=50)
    index = training_order.write_shards(ordered, f"file://{tmp_path}/shards")
    found = sorted(index.collect())
    n = len(found)
    assert [r["slot"] for r in found] == list(range(n)) and all((r["shard"], r["place"]) == divmod(r["slot"], 50) for r in found)
    records = list(training_order.read_from(f"file://{tmp_path}/shards", 0, shard=50, length=8))
    assert len(records) == n and all(zlib.crc32(x.tobytes()) == r["record_crc32"] for x, r in zip(records, found, strict=True))
    later = list(training_order.read_from(f"file://{tmp_path}/shards", 123, shard=50, length=8))
    assert len(later) == n - 123 and all((a == b).all() for a, b in zip(later, records[123:], strict=True))
    pieces = defaultdict(dict)
    for r, x in zip(found, records, strict=True):
        assert (x[r["length"] :] == 0).all()
        if r["doc_id"] not in (None, 3):
            pieces[r["doc_id"]][r["piece"]] = x[: r["length"]].tolist()
    for d, t in rows:
        if d not in (None, 3):
            assert [i for k in sorted(pieces[d]) for i in pieces[d][k]] == ids_of(t)
    assert training_order.training_order(df.limit(0)).collect() == []


def test_order_digests_come_from_written_shards(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    before = set(Path(shared_folder(spark)).glob("roomledger/shards-*"))
    found = sorted(training_order.order_digests(df, length=8, shard=50).collect())
    (folder,) = set(Path(shared_folder(spark)).glob("roomledger/shards-*")) - before
    records = list(training_order.read_from(str(folder), 0, shard=50, length=8))
    assert len({r["shard"] for r in found}) > 10 and [r["slot"] for r in found] == list(range(len(records)))
    assert [r["record_crc32"] for r in found] == [zlib.crc32(x.tobytes()) for x in records]
    assert training_order.order_digests(df.limit(0)).collect() == []


def test_a_range_makes_only_its_own_records(spark, monkeypatch):
    """Each range of shards once made a record of every sequence and dropped the others afterwards."""
    made, binary = [], training_order._binary
    monkeypatch.setattr(training_order, "_binary", lambda values, ends: (made.append(len(ends)), binary(values, ends))[1])
    ids = training_order._binary(np.arange(60, dtype="<u2").tobytes(), np.arange(1, 21) * 6)
    numbers = [pa.array(np.full(20, 5)), pa.array(np.arange(20)), pa.array(np.arange(20)), pa.array(np.zeros(20, np.int32))]
    batch = pa.RecordBatch.from_arrays([*numbers, ids], ["first", "place", "doc_id", "piece", "ids"])
    order = training_order.Permutation(30, "k")
    slots = {d: s for d, s in enumerate(order.slot(5 + np.arange(20)).tolist())}
    made.clear()
    found = {}
    for part in (range(0, 8), range(8, 16), range(16, 32)):
        (out,) = training_order._placed(iter([batch]), order, 4, 0, part)
        assert set(out.column(0).to_pylist()) <= set(part)
        found |= dict(zip(out.column(1).to_pylist(), zip(out.column(0).to_pylist(), out.column(4).to_pylist()), strict=True))
    assert found == {d: (s, np.array([3 * d, 3 * d + 1, 3 * d + 2, 0], "<u2").tobytes()) for d, s in slots.items()}
    assert sum(made) == 20
    assert [b.num_rows for b in training_order._placed(iter([batch]), order, 4, 0, range(900, 910))] == [0]


def integer_slot(i, n, key, rounds=6):
    """The slot of number i by plain integers."""
    import hashlib

    half, word = max(1, (max(1, n - 1).bit_length() + 1) // 2), (1 << 64) - 1
    while True:
        left, right = i >> half, i & ((1 << half) - 1)
        for r in range(rounds):
            seed = hashlib.blake2b(f"{key}/{r}".encode(), digest_size=16).digest()
            x = ((right + (int.from_bytes(seed[:8], "little") | 1)) * (int.from_bytes(seed[8:], "little") | 1)) & word
            x = ((x ^ (x >> 31)) * 0x94D049BB133111EB) & word
            left, right = right, left ^ ((x ^ (x >> 29)) & ((1 << half) - 1))
        i = (left << half) | right
        if i < n:
            return i


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000, 10**12])
def test_slots_equal_an_integer_network(n):
    order = training_order.Permutation(n, "a key")
    some = np.array(sorted({i % n for i in [*range(50), n - 1, n // 2, n // 3]}))
    assert order.slot(some).tolist() == [integer_slot(int(i), n, "a key") for i in some]


def test_ids_that_do_not_fit_are_an_error(spark, monkeypatch):
    class Wide:
        def encode(self, text):
            return (70_000).to_bytes(4, "little")

    monkeypatch.setattr(training_order, "word_encoder", lambda path: Wide())
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["x"])], ["doc_id", "text"])
    monkeypatch.setattr(training_order, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    with pytest.raises(ValueError, match="does not fit"):
        list(training_order._sequences(iter([batch]), "p", 4, 1))


@pytest.mark.parametrize("lengths", [range(1, 4097), range(2040, 2061), range(1000, 2101), [4096], [1], [1366, 1365, 700]])
def test_no_more_sequences_than_best_fit(lengths):
    rng = random.Random(4)
    counts = Counter(rng.choice(list(lengths)) for _ in range(20_000))
    found = packing.plan(counts)
    plain = packing._Bins()
    for length in sorted(counts, reverse=True):
        plain.best_fit(length, counts[length], packing.CAPACITY)
    assert sum(n for _, n in found) <= sum(n for runs in plain.runs.values() for _, n in runs)
    assert all(sum(contents) <= packing.CAPACITY for contents, _ in found)
    used = Counter()
    for contents, n in found:
        for length in contents:
            used[length] += n
    assert used == counts
