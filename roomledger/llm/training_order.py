"""Token sequences in a keyed random order, as shards of fixed-stride records."""

from __future__ import annotations

import hashlib
import itertools
import posixpath
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.scratch import scratch_path

from .common import Steps, text_of
from .tokens import vocabulary_path, word_encoder

#: Ids of a sequence, sequences of a shard, the id that ends a document and the one that fills up a record.
LENGTH, SHARD, END, PAD = 256, 8192, 1, 0
#: Ids are written as little-endian unsigned 16-bit numbers; the vocabulary must be that small.
ID = np.dtype("<u2")
KEY = "training order 1"
#: Ranges of shards that are shuffled and written one after the other.
WAVES = 3


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0 ... n - 1: a Feistel network on a slightly larger square, walked until inside."""

    n: int
    key: str
    rounds: int = 6

    @property
    def half(self) -> int:
        """Bits of a half; the square has less than 16 n places."""
        return max(1, (max(1, self.n - 1).bit_length() + 1) // 2)

    def _mixed(self, x: np.ndarray, r: int) -> np.ndarray:
        seed = hashlib.blake2b(f"{self.key}/{r}".encode(), digest_size=16).digest()
        a, b = (np.uint64(int.from_bytes(part, "little") | 1) for part in (seed[:8], seed[8:]))
        x = (x + a) * b
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(29))) & np.uint64((1 << self.half) - 1)

    def _network(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for r in range(self.rounds - 1, -1, -1) if back else range(self.rounds):
            if back:
                left, right = right ^ self._mixed(left, r), left
            else:
                left, right = right, left ^ self._mixed(right, r)
        return (left << bits) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x).astype(np.uint64)
        outside = np.ones(len(x), bool)
        while outside.any():
            x[outside] = self._network(x[outside], back)
            outside = x >= np.uint64(self.n)
        return x.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def _binary(values: bytes, ends: np.ndarray) -> pa.Array:
    """A binary column whose values lie one after the other in one buffer."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values)])


def _sequences(batches: Iterator[pa.RecordBatch], path: str, length: int, end: int) -> Iterator[pa.RecordBatch]:
    part, place = TaskContext.get().partitionId(), 0
    encoder, last = word_encoder(path), end.to_bytes(4, "little")
    for batch in batches:
        found = [encoder.encode(text.as_py()) + last for text in batch.column(1)]
        sizes = np.array([len(f) // 4 for f in found], np.int64)
        ids = np.frombuffer(b"".join(found), "<u4")
        if len(ids) and ids.max() > np.iinfo(ID).max:
            raise ValueError(f"id {ids.max()} does not fit into {ID.itemsize} bytes")
        ids = ids.astype(ID)
        pieces = -(-sizes // length)  # of each document
        n, first = int(pieces.sum()), np.cumsum(pieces) - pieces
        doc = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(n) - first[doc]
        ends = (np.cumsum(sizes) - sizes)[doc] + np.minimum((piece + 1) * length, sizes[doc])
        arrays = [
            pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), batch.column(0).take(pa.array(doc)),
            pa.array(piece.astype(np.int32)), _binary(ids.tobytes(), ends * ID.itemsize),
        ]
        place += n
        yield pa.RecordBatch.from_arrays(arrays, ["part", "place", "doc_id", "piece", "ids"])


def _placed(batches: Iterator[pa.RecordBatch], order: Permutation, length: int, pad: int, slots: range) -> Iterator[pa.RecordBatch]:
    """The records of the sequences whose slot is one of ``slots``; the others are passed over before a record is made."""
    for batch in batches:
        slot = order.slot(batch.column(0).to_numpy() + batch.column(1).to_numpy())
        here = (slot >= slots.start) & (slot < slots.stop)
        slot, batch = slot[here], batch.filter(pa.array(here))
        lengths = pc.binary_length(batch.column(4)).to_numpy() // ID.itemsize
        records = np.full((batch.num_rows, length), pad, ID)
        records[np.arange(length) < lengths[:, None]] = np.frombuffer(b"".join(batch.column(4).to_pylist()), ID)
        ends = np.arange(1, batch.num_rows + 1) * length * ID.itemsize
        arrays = [pa.array(slot), batch.column(2), batch.column(3), pa.array(lengths.astype(np.int32)), _binary(records.tobytes(), ends)]
        yield pa.RecordBatch.from_arrays(arrays, ["slot", "doc_id", "piece", "length", "record"])


def numbered_sequences(steps: Steps, docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> tuple[DataFrame, int]:
    """Every sequence with the first number of its task and its place there, and how many there are; see ``training_order``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    cut = partial(_sequences, path=path or vocabulary_path(), length=length, end=end)
    sequences = steps.store(rows.mapInArrow(cut, "part int, place long, doc_id long, piece int, ids binary"), "sequences")
    counts = sequences.groupBy("part").count().orderBy("part").collect()  # one row per input task
    starts = np.concatenate([[0], np.cumsum([r["count"] for r in counts])]).tolist()
    n = int(starts[-1])
    firsts = spark.createDataFrame([(r["part"], s) for r, s in zip(counts, starts, strict=False)], "part int, first long")
    return sequences.join(F.broadcast(firsts), "part").select("first", "place", "doc_id", "piece", "ids"), n


def _by_range(numbered: DataFrame, n: int, first: int, last: int, key: str = KEY, length: int = LENGTH, shard: int = SHARD, pad: int = PAD) -> DataFrame:
    """The sequences of the shards from ``first`` up to, but without, ``last``: partitions are ranges of shards, in order."""
    n_parts = max(1, min(last - first, int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    place = partial(_placed, order=Permutation(max(1, n), key), length=length, pad=pad, slots=range(first * shard, last * shard))
    placed = numbered.mapInArrow(place, "slot long, doc_id long, piece int, length int, record binary")
    placed = placed.withColumn("shard", F.floor(F.col("slot") / shard)).withColumn("place", F.col("slot") % shard)
    ranged = placed.repartitionById(n_parts, F.floor((F.col("shard") - first) * n_parts / max(1, last - first)).cast("int"))
    return ranged.sortWithinPartitions("slot").select("slot", "shard", "place", "doc_id", "piece", "length", "record")


def training_order(docs: DataFrame, key: str = KEY, path: str | None = None, length: int = LENGTH, shard: int = SHARD,
                   end: int = END, pad: int = PAD) -> DataFrame:
    """Every sequence at its global slot: slot, shard, place, doc_id, piece, length, record.

    A document's ids and the end id are cut into sequences of ``length``; the last is
    filled up with ``pad``, so records have one stride. Sequences are numbered through
    (by input task, then by place in it; only one count per task is gathered), and the
    keyed permutation maps numbers to slots one to one. Shards are ranges of slots; the
    rows come back partitioned by shard range and sorted by slot.

    A null or empty text is one sequence with the end id alone. Repeated rows, and rows
    with a null doc_id, are documents of their own. An empty table gives no rows. Ids that
    do not fit into 16 bits are an error.
    """
    numbered, n = numbered_sequences(_steps(docs.sparkSession), docs, path, length, end)
    return _by_range(numbered, n, 0, max(1, -(-n // shard)), key, length, shard, pad)


def _steps(spark: SparkSession) -> Steps:
    return Steps(spark, "order", codec="zstd")


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    stream = shard = name = None
    task = TaskContext.get().taskAttemptId()

    def finish() -> None:
        if stream is not None:
            stream.close()
            system.move(f"{name}.{task}", name)

    for batch in batches:
        records = batch.column(6).to_pylist()
        for number, some in itertools.groupby(zip(batch.column(1).to_pylist(), records, strict=True), itemgetter(0)):
            if number != shard:
                finish()
                shard, name = number, posixpath.join(root, f"shard-{number:08d}.bin")
                stream = system.open_output_stream(f"{name}.{task}")
            stream.write(b"".join([record for _, record in some]))
        crc = [zlib.crc32(record) for record in records]
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(crc, pa.int64())], [*batch.schema.names[:6], "record_crc32"])
    finish()


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write the shards of ``training_order`` to ``folder`` (a URI all executors reach); returns the index.

    A shard is written under a name of its own and moved when complete, so a task that is
    run again replaces it and a reader never sees a part.
    """
    out = "slot long, shard long, place long, doc_id long, piece int, length int, record_crc32 long"
    return Steps(ordered.sparkSession, "index").store(ordered.mapInArrow(partial(_write, folder=folder), out), "index")


def read_from(folder: str, slot: int, shard: int = SHARD, length: int = LENGTH) -> Iterator[np.ndarray]:
    """The records from a slot on, in order: where a training run stopped it can go on."""
    system, root = fs.FileSystem.from_uri(folder)
    stride, number, place = length * ID.itemsize, slot // shard, slot % shard
    while system.get_file_info(name := posixpath.join(root, f"shard-{number:08d}.bin")).type == fs.FileType.File:
        with system.open_input_file(name) as stream:
            stream.seek(place * stride)
            while record := stream.read(stride):
                yield np.frombuffer(record, ID)
        number, place = number + 1, 0


def _from_shards(batches: Iterator[pa.RecordBatch], folder: str, length: int) -> Iterator[pa.RecordBatch]:
    """The index rows with the digest of what their shard has at their place."""
    system, root = fs.FileSystem.from_uri(folder)
    stride, number, at, stream = length * ID.itemsize, None, 0, None
    for batch in batches:
        crc = []
        for shard, place in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if shard != number or place < at:
                if stream is not None:
                    stream.close()
                number, at = shard, 0
                stream = system.open_input_stream(posixpath.join(root, f"shard-{shard:08d}.bin"), buffer_size=1 << 20)
            if place > at:
                stream.read((place - at) * stride)
            record, at = stream.read(stride), place + 1
            if len(record) != stride:
                raise ValueError(f"shard {shard} has no whole record at {place}")
            crc.append(zlib.crc32(record))
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(crc, pa.int64())], [*batch.schema.names[:6], "record_crc32"])
    if stream is not None:
        stream.close()


def order_digests(docs: DataFrame, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Writes the shards to the shared folder; the training order with a digest of each record as its shard holds it.

    Shards are written in ``WAVES`` ranges, one after the other, so only a part of the
    records is in shuffle files at a time.
    """
    folder, steps = scratch_path(docs.sparkSession, "shards"), _steps(docs.sparkSession)
    numbered, n = numbered_sequences(steps, docs, length=length)
    n_shards = max(1, -(-n // shard))
    cuts = [n_shards * w // WAVES for w in range(WAVES + 1)]
    parts = [write_shards(_by_range(numbered, n, a, b, length=length, shard=shard), folder) for a, b in itertools.pairwise(cuts) if a < b]
    steps.drop("sequences")
    index = parts[0]
    for part in parts[1:]:
        index = index.unionByName(part)
    read = partial(_from_shards, folder=folder, length=length)
    return index.mapInArrow(read, index.schema)
