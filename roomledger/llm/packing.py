"""Packing documents into few sequences: linear grouping of lengths, then best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, running_total, text_of
from .tokens import vocabulary_path, word_encoder

CAPACITY = 4096
#: The id that ends every document.
END = 1
#: Lengths from this part of the capacity on are large; large lengths form this many groups of equal size.
LARGE, GROUPS = 1 / 4, 512

_PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


def document_ids(path: str, text: str, end: int = END) -> bytes:
    """Ids of a document with the end id, as little-endian unsigned 32-bit numbers."""
    return word_encoder(path).encode(text) + end.to_bytes(4, "little")


def cut_documents(rows: DataFrame, path: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: full ones of ``capacity`` ids and the rest.

    ``rows`` has row_id, doc_id and text (not null). With ``with_ids`` the ids come along.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            pieces: list[bytes] = []
            docs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
            for row_id, doc_id, text in docs:
                ids = document_ids(path, text.as_py())
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    row = (row_id, doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part))
                    for values, value in zip(out, row, strict=True):
                        values.append(value)
                    if with_ids:
                        pieces.append(part)
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(v, t) for v, t in zip(out, types, strict=True)]
            names = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(pieces, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = rows.select("row_id", F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(cut, _PIECES + (", ids binary" if with_ids else ""))


class _Bins:
    """Sequences with equal contents, as runs: [contents, how many], by what is left in them."""

    def __init__(self) -> None:
        self.left: list[int] = []
        self.runs: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def add(self, left: int, contents: tuple[int, ...], n: int) -> None:
        if left not in self.runs:
            insort(self.left, left)
            self.runs[left] = []
        self.runs[left].append((contents, n))

    def take(self, left: int) -> tuple[tuple[int, ...], int]:
        run = self.runs[left].pop()
        if not self.runs[left]:
            del self.runs[left]
            del self.left[bisect_left(self.left, left)]
        return run

    def best_fit(self, length: int, n: int, capacity: int) -> None:
        """Put n pieces of one length, each into the fullest sequence that holds it, else into new ones."""
        while n:
            i = bisect_left(self.left, length)
            if i == len(self.left):
                each = capacity // length
                if n >= each:
                    self.add(capacity - each * length, (length,) * each, n // each)
                if n % each:
                    self.add(capacity - n % each * length, (length,) * (n % each), 1)
                return
            left = self.left[i]
            contents, bins = self.take(left)
            each = min(left // length, n)
            used = min(bins, n // each)
            if bins > used:
                self.add(left, contents, bins - used)
            self.add(left - each * length, contents + (length,) * each, used)
            n -= each * used


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each rounded size fill a sequence best, at least one of the largest left.

    Subset sums as bit sets: bit t of a stage is set if its sizes can reach total t.
    """
    top = next(i for i, n in enumerate(left) if n)
    mask = (1 << (capacity + 1)) - 1
    stages = [1 << sizes[top]]
    for i in range(top, len(sizes)):
        reach = step = stages[-1]
        for _ in range(min(left[i] - (i == top), capacity // sizes[i])):
            step = (step << sizes[i]) & mask
            if not step:
                break
            reach |= step
        stages.append(reach)
        if reach >> capacity:
            break
    uses, total = [0] * len(sizes), stages[-1].bit_length() - 1
    for i in range(top + len(stages) - 2, top - 1, -1):
        while not stages[i - top] >> total & 1:
            total -= sizes[i]
            uses[i] += 1
    uses[top] += 1
    return uses


def plan(counts: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Runs of sequences with equal contents (lengths) for so many pieces of each length.

    The better of linear grouping, over ``groups`` sizes and over a sixteenth of them, and
    best fit of all pieces, longest first.
    """
    plain = _Bins()
    for length in sorted(counts, reverse=True):
        if length > 0 and counts[length]:
            plain.best_fit(length, counts[length], capacity)
    found = [grouped_plan(counts, capacity, large, groups), grouped_plan(counts, capacity, large, max(1, groups // 16))]
    found.append([run for left in sorted(plain.runs) for run in plain.runs[left]])
    return min(found, key=lambda runs: sum(n for _, n in runs))


def grouped_plan(counts: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Runs of sequences with equal contents (lengths) for so many pieces of each length, by linear grouping.

    Works on the counts by length, so its cost depends on the capacity and not on the
    number of pieces. Linear grouping: the large pieces, longest first, are cut into
    groups of equal cardinality and rounded up to the longest of their group.
    Configurations of the few rounded sizes are found by subset sums, the largest size
    first, and each is used as often as the remaining groups allow. Actual pieces take
    the rounded places, longest first, so the sequences of a configuration split into
    runs of equal actual contents. Small pieces, longest first, then go where they fit
    best.
    """
    full = counts.get(capacity, 0)
    big = [(n, counts[n]) for n in sorted(counts, reverse=True) if n >= large * capacity and n < capacity and counts[n]]
    small = [(n, counts[n]) for n in sorted(counts, reverse=True) if 0 < n < large * capacity and counts[n]]
    each = -(-sum(n for _, n in big) // groups) or 1
    sizes: list[int] = []
    members: list[list[list[int]]] = []  # of each group: [actual length, how many are left], longest first
    room = 0
    for length, n in big:
        while n:
            if not room:
                sizes.append(length)
                members.append([])
                room = each
            some = min(n, room)
            members[-1].append([length, some])
            n, room = n - some, room - some
    merged: dict[int, list[list[int]]] = {}
    for size, group in zip(sizes, members, strict=True):
        merged.setdefault(size, []).extend(group)
    sizes, members = list(merged), list(merged.values())
    left = [sum(n for _, n in group) for group in members]

    bins = _Bins()
    while any(left):
        uses = _configuration(sizes, left, capacity)
        times = min(left[i] // k for i, k in enumerate(uses) if k)
        slots = []  # for each place of the configuration, runs of actual lengths
        for i, k in enumerate(uses):
            left[i] -= k * times
            for _ in range(k):
                need, runs = times, []
                while need:
                    length, n = members[i][0]
                    some = min(n, need)
                    runs.append([length, some])
                    need -= some
                    members[i][0][1] -= some
                    if not members[i][0][1]:
                        members[i].pop(0)
                slots.append(runs)
        while slots[0]:
            some = min(runs[0][1] for runs in slots)
            contents = tuple(runs[0][0] for runs in slots)
            bins.add(capacity - sum(contents), contents, some)
            for runs in slots:
                runs[0][1] -= some
                if not runs[0][1]:
                    runs.pop(0)
    for length, n in small:
        bins.best_fit(length, n, capacity)
    packed = [run for left_over in sorted(bins.runs) for run in bins.runs[left_over]]
    return ([((capacity,), full)] if full else []) + packed


def places(runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, end rank, first sequence, pieces a sequence, offset).

    The piece with rank r of a run sits in sequence ``first + (r - first_rank) // each`` at
    ``offset + (r - first_rank) % each * length``.
    """
    out, used, sequence = [], {}, 0
    for contents, n in runs:
        offset = 0
        for length in sorted(set(contents), reverse=True):
            each = contents.count(length)
            first = used.get(length, 0)
            used[length] = first + n * each
            out.append((length, first, used[length], sequence, each, offset))
            offset += each * length
        sequence += n
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (row_id, piece, length, any other columns) with sequence_id and offset.

    Only the counts by length, at most ``capacity`` rows, reach the driver. Pieces of one
    length are numbered without a task per length, then looked up in the plan; the plan
    has a bounded number of runs a length.
    """
    spark = pieces.sparkSession
    if {"sequence_id", "offset"} & set(pieces.columns):
        raise ValueError("pieces must not have columns sequence_id or offset")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n_rows"))
    found = {r["length"]: r["n_rows"] for r in counts.collect()}
    schema = "length long, _first long, _end long, _sequence long, _each long, _offset long"
    table = spark.createDataFrame(places(plan(found, capacity)), schema)
    lengths = spark.createDataFrame(sorted(found.items()), "length long, n_rows long")
    key = F.shiftrightunsigned(F.xxhash64("row_id", "piece"), 11)
    keyed = pieces.withColumn("_key", key).withColumn("_one", F.lit(1)).join(F.broadcast(lengths), "length")
    unit = F.col("_key") / float(2**53)
    ranked = running_total(keyed, ["length"], ["_key", "row_id", "piece"], unit, F.col("n_rows"), "_one", "_rank")
    at = F.col("_rank") - F.col("_first")
    placed = ranked.join(F.broadcast(table), "length").where("_first <= _rank AND _rank < _end")
    placed = placed.withColumn("sequence_id", F.col("_sequence") + F.floor(at / F.col("_each")))
    placed = placed.withColumn("offset", F.col("_offset") + F.pmod(at, F.col("_each")) * F.col("length"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of its end id alone. Rows are packed one by one, so
    repeated rows and null ids are documents of their own; other columns are not read. An
    empty table gives no pieces. Only documents longer than the capacity are cut.
    """
    path = path or vocabulary_path()
    steps = Steps(docs.sparkSession, "pack", batch_rows=500)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text_of("text").alias("text"))
    pieces = steps.store(cut_documents(rows, path, capacity), "pieces")
    return pack_pieces(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
