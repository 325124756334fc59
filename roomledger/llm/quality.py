"""Quality scores by a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of

#: Hashed word features, steps a statistic is cut into, and rank of the pairwise weights.
WORDS, BINS, RANK = 1 << 12, 12, 4
#: At most so many labelled rows of each class are learnt from; more add little to so few parameters.
SAMPLE = 3000
_UPPER, _LOWER, _DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_STOPS, _SPACE = b".,;:!?'\"()-", bytes([32, *range(9, 14)])
_HIGH = bytes(range(128, 256))
_SYMBOLS = bytes(c for c in range(33, 127) if c not in _UPPER + _LOWER + _DIGITS + _STOPS)
STATISTICS = (
    "words", "word_bytes", "distinct_words", "distinct_pairs", "repeats", "upper", "digits", "symbols", "stops", "high",
    "line_words", "shouting", "marked",
)


def _share(raw: bytes, kind: bytes) -> float:
    return (len(raw) - len(raw.translate(None, kind))) / max(1, len(raw))


def statistics(raw: bytes, words: list[bytes]) -> list[float]:
    """Structure statistics of a text, each from 0 to 1."""
    n = max(1, len(words))
    next_words = words[1:]
    pairs = max(1, len(next_words))
    return [
        min(1.0, math.log2(1 + len(words)) / 16),
        min(1.0, len(raw) / n / 24),
        len(set(words)) / n,
        len(set(zip(words, next_words))) / pairs if next_words else 1.0,  # noqa: B905
        sum(map(operator.eq, words, next_words)) / pairs,
        _share(raw, _UPPER),
        _share(raw, _DIGITS),
        _share(raw, _SYMBOLS),
        _share(raw, _STOPS),
        _share(raw, _HIGH),
        min(1.0, math.log2(1 + n / (1 + raw.count(b"\n"))) / 12),
        sum(map(bytes.isupper, words)) / n,
        1 - sum(map(bytes.isalnum, (w[-1:] for w in words))) / n,
    ]


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        bucket = zlib.crc32(word.lower()) % WORDS
        if len(self) < 200_000:
            self[word] = bucket
        return bucket


_BUCKETS = _Buckets()
N_FEATURES = WORDS + len(STATISTICS) * (BINS + 1)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text: hashed words by their root share, one step per statistic.

    A statistic lies between two of its ``BINS + 1`` marks and gives each its nearness.
    """
    raw = text.encode()
    words = raw.split()
    stats = np.array(statistics(raw, words)) * BINS
    low = np.minimum(stats.astype(np.int64), BINS - 1)
    first = WORDS + np.arange(len(STATISTICS)) * (BINS + 1) + low
    part = stats - low
    index, count = np.unique(np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words)), return_counts=True)
    value = np.sqrt(count / max(1, len(words)))
    return np.concatenate([index, first, first + 1]), np.concatenate([0.3 * value, 1 - part, part])


@dataclass
class Machine:
    """A factorisation machine: bias, linear weights, and a vector per feature."""

    bias: float
    linear: np.ndarray
    vectors: np.ndarray

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        """Probability of label 1. Pairs cost linear time: half of (sum squared less sum of squares)."""
        part = self.vectors[index] * value[:, None]
        pairs = 0.5 * float((part.sum(0) ** 2 - (part**2).sum(0)).sum())
        z = self.bias + float(self.linear[index] @ value) + pairs
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 30, step: float = 0.1,
        decay: float = 1e-4, seed: int = 7) -> Machine:
    """Log loss by adaptive gradient steps over small batches; classes weigh the same."""
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(N_FEATURES), rng.normal(0, 0.05, (N_FEATURES, RANK)))
    sums = [np.full(1, 1e-6), np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, RANK), 1e-6)]
    share = labels.mean() if len(labels) else 0.5
    weight = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(rows) // 64)):
            index = np.concatenate([rows[i][0] for i in batch])
            value = np.concatenate([rows[i][1] for i in batch])
            starts = np.cumsum([0, *(len(rows[i][0]) for i in batch[:-1])])
            part = machine.vectors[index] * value[:, None]
            total = np.add.reduceat(part, starts)
            pairs = 0.5 * (total**2 - np.add.reduceat(part**2, starts)).sum(1)
            z = machine.bias + np.add.reduceat(machine.linear[index] * value, starts) + pairs
            error = weight[batch] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            each = np.repeat(np.arange(len(batch)), np.diff([*starts, len(index)]))
            used, place = np.unique(index, return_inverse=True)
            pull = error[each] * value
            linear = np.bincount(place, pull, len(used)) + decay * machine.linear[used]
            grown = pull[:, None] * (total[each] - part)
            vectors = np.stack([np.bincount(place, grown[:, f], len(used)) for f in range(RANK)], 1) + decay * machine.vectors[used]
            bias = np.array([error.sum()])
            sums[0] += bias**2
            sums[1][used] += linear**2
            sums[2][used] += vectors**2
            machine.bias -= float(step * bias[0] / np.sqrt(sums[0][0]))
            machine.linear[used] -= step * linear / np.sqrt(sums[1][used])
            machine.vectors[used] -= step * vectors / np.sqrt(sums[2][used])
    return machine


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id as text is 1 modulo 3. A null id is not held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(text.as_py()) for text in batch.column(1)]
        columns = [batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, ["quality", "index", "value"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learn from at most ``sample`` labelled documents of each class that are not held out.

    The sample is the rows with the smallest hash of doc_id, so it does not depend on the
    order of the tables. Labels that are null, or whose document is missing, are not used;
    of labels for one document the smallest counts. Without both classes the machine
    scores 0.5 everywhere.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = [known.where(f"quality = {q}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample rows
    rows = docs.select("doc_id", text_of("text").alias("text")).join(chosen, "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text")
    table = rows.mapInArrow(_extract, "quality int, index array<int>, value array<float>").toArrow()
    found = [(q, i.values.to_numpy().astype(np.int64), v.values.to_numpy().astype(float)) for q, i, v in zip(table["quality"].to_pylist(), table["index"], table["value"], strict=True)]
    found.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    y = np.array([q for q, _, _ in found], float)
    if len(set(y)) < 2:
        return Machine(0.0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, RANK)))
    return fit([(i, v) for _, i, v in found], y)


def _score_batches(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = pa.array([machine.score(*features(t.as_py())) for t in batch.column(2)], pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], ["doc_id", "held_out", "score"])


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on).

    Whole texts are read; a null text counts as empty, and empty texts get a score.
    Labels, lang, source and doc_id never enter a score. Repeated rows are scored each.
    """
    machine = train(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long"), is_held_out().alias("held_out"), text_of("text").alias("text"))
    scored = rows.mapInArrow(partial(_score_batches, machine=machine), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents predicted to be of quality 1, with their columns.

    Null and empty texts are scored as empty; repeated rows and null ids are documents of
    their own; an empty table stays empty. Only texts travel to the scoring tasks.
    """
    machine = train(docs, labels, sample)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array([machine.score(*features(t.as_py())) >= 0.5 for t in texts], pa.bool_())

    return docs.where(good(text_of("text")))
