"""Ranked lexical search: short lists summed term by term, long lists skipped through document by document."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from .common import Steps, text_of

#: Results of a query, documents of an index block, and the share of a block from which on a list is long.
K, BLOCK, LONG = 10, 1024, 1 / 16
#: Queries that are searched together end at so many items or, after any one item, at so many bytes of text.
ITEMS, ITEM_BYTES = 4096, 1 << 24
#: Blocks that travel together to a Python worker; a block holds at most ``BLOCK`` documents' postings.
BLOCK_ROWS = 8

_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII; only A-Z in lower case."""
    return text.encode().translate(_TERM_BYTES).split()


_BLOCK = "n_docs long, n_terms long, doc_ids array<long>, sizes array<long>, terms array<int>, starts array<int>, docs binary, counts binary"


def _blocks(batches: Iterator[pa.RecordBatch], words: dict[bytes, int], block: int) -> Iterator[pa.RecordBatch]:
    """Index blocks of texts (doc_id, text): lists (places, counts) of the terms that are asked for.

    ``sizes`` and ``n_docs`` count all terms of the texts; a text without a term is no document.
    """
    ids: list[int | None] = []
    sizes: list[int] = []
    lists: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def result() -> pa.RecordBatch:
        known = sorted(lists)
        ends = np.cumsum([0, *(len(lists[t]) for t in known)])
        postings = np.array([p for t in known for p in lists[t]], np.int64).reshape(-1, 2)
        row = [
            pa.array([len(ids)], pa.int64()), pa.array([sum(sizes)], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
            pa.array([sizes], pa.list_(pa.int64())), pa.array([known], pa.list_(pa.int32())), pa.array([ends.tolist()], pa.list_(pa.int32())),
            pa.array([postings[:, 0].astype("<u2").tobytes()], pa.binary()), pa.array([postings[:, 1].astype("<u4").tobytes()], pa.binary()),
        ]
        ids.clear(), sizes.clear(), lists.clear()
        return pa.RecordBatch.from_arrays(row, [c.split()[0] for c in _BLOCK.split(", ")])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = terms(text.as_py())
            if not found:
                continue
            for word, n in Counter(found).items():
                if (term := words.get(word)) is not None:
                    lists[term].append((len(ids), n))
            ids.append(doc_id)
            sizes.append(len(found))
            if len(ids) == block:
                yield result()
    if ids:
        yield result()


@dataclass(frozen=True)
class Corpus:
    """Numbers of the whole corpus: documents, terms, and the weight of each term that is asked for."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    @staticmethod
    def of(n_docs: int, n_terms: int, df: dict[int, int], n_words: int) -> Corpus:
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(n_words)]
        return Corpus(n_docs, n_terms, np.array(weight, np.int64))

    def impacts(self, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The part of a score that a term's count in a document gives, before its weight."""
        m = 100 - 90 + (90 * sizes * self.n_docs) // self.n_terms
        return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


class Best:
    """The best ``k`` of each query so far, equal scores by ascending doc_id, null ids last."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.found: list[list[tuple[int, bool, int]]] = [[] for _ in range(n_queries)]

    def least(self, query: int) -> int:
        """A score below which a document can no longer be among the best."""
        found = self.found[query]
        return -found[-1][0] if len(found) == self.k else 1

    def add(self, query: int, scores: np.ndarray, ids: list[int | None]) -> None:
        new = [(-s, d is None, d or 0) for s, d in zip(scores.tolist(), ids, strict=True)]
        self.found[query] = sorted(self.found[query] + new)[: self.k]


def search_block(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, least: int, long: float = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all documents of a block that score at least ``least``, out of lists (places, scores).

    Lists below ``long`` of the block are summed term by term. Their sums are one list
    more, with its greatest sum as bound, beside the long lists. All lists are then taken
    by bound: documents come from those lists only without which ``least`` is out of
    reach, and are looked up in the others, the greatest bound first, while they can
    still reach it.
    """
    short = [x for x in lists if len(x[0]) < long * n_docs]
    merged = [x for x in lists if len(x[0]) >= long * n_docs]
    if short:
        places, at = np.unique(np.concatenate([p for p, _ in short]), return_inverse=True)
        sums = np.zeros(len(places), np.int64)
        np.add.at(sums, at, np.concatenate([s for _, s in short]))
        merged.append((places, sums))
    bounds = [int(s.max()) for _, s in merged]
    order = sorted(range(len(merged)), key=bounds.__getitem__)
    reach, optional = 0, 0
    while optional < len(order) and reach + bounds[order[optional]] < least:
        reach += bounds[order[optional]]
        optional += 1
    if optional == len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    scores = np.zeros(n_docs, np.int64)
    for i in order[optional:]:
        scores[merged[i][0]] += merged[i][1]
    places = np.flatnonzero((scores > 0) & (scores + reach >= least))
    for i in reversed(order[:optional]):
        if not len(places):
            break
        docs, values = merged[i]
        at = np.minimum(np.searchsorted(docs, places), len(docs) - 1)
        scores[places] += np.where(docs[at] == places, values[at], 0)
        reach -= bounds[i]
        places = places[scores[places] + reach >= least]
    return places, scores[places]


def _search(batches: Iterator[pa.RecordBatch], queries: list[list[int]], corpus: Corpus, k: int) -> Iterator[pa.RecordBatch]:
    """query, score and doc_id of the task's best documents; all its blocks raise the score to reach."""
    best = Best(len(queries), k)
    for batch in batches:
        for i in range(batch.num_rows):
            ids, sizes, known, starts = (batch.column(c)[i].values for c in range(2, 6))
            places = np.frombuffer(batch.column(6)[i].as_py(), "<u2").astype(np.int64)
            counts = np.frombuffer(batch.column(7)[i].as_py(), "<u4").astype(np.int64)
            starts, known, n = starts.to_numpy(), known.to_numpy(), len(ids)
            impacts = corpus.impacts(counts, sizes.to_numpy()[places])
            impacts *= np.repeat(corpus.weights[known], np.diff(starts))
            at = dict(zip(known.tolist(), range(len(known)), strict=True))
            for q, wanted in enumerate(queries):
                rows = [at[t] for t in wanted if t in at]
                lists = [(places[starts[r] : starts[r + 1]], impacts[starts[r] : starts[r + 1]]) for r in rows]
                if lists:
                    found, scores = search_block(lists, n, best.least(q))
                    if len(found):
                        best.add(q, scores, ids.take(pa.array(found)).to_pylist())
    rows = [(q, -s, None if none else d) for q, found in enumerate(best.found) for s, none, d in found]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["query", "score", "doc_id"])


def _query_blocks(items: DataFrame) -> Iterator[list[Row]]:
    """Items in blocks of a bounded number and size; the driver holds one block at a time."""
    block, size = [], 0
    for item in items.toLocalIterator():
        block.append(item)
        size += len(item["text"].encode())
        if len(block) == ITEMS or size >= ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item, by a fixed-point BM25.

    Items go out in blocks. For a block, one pass over the documents makes an index of the
    terms that its items hold, in blocks of at most ``block`` documents, with all counts of
    the corpus; a second pass searches the index blocks and keeps ``k`` documents of each
    item in every task, and the tasks' best are ranked.

    A null text, or one without terms, is no document and counts nowhere; an item without
    terms gets no rows. Every row of ``items`` is ranked of its own, whether its item_id
    is null or repeated; repeated documents are documents of their own, a null doc_id
    comes last among equal scores. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    steps, narrow = Steps(spark, "lexical"), Steps(spark, "lexical-index", batch_rows=BLOCK_ROWS)
    texts = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    parts = []
    for number, items_here in enumerate(_query_blocks(items.select("item_id", text_of("text").alias("text")))):
        words: dict[bytes, int] = {}
        queries = [sorted({words.setdefault(t, len(words)) for t in terms(item["text"])}) for item in items_here]
        index = steps.store(texts.mapInArrow(partial(_blocks, words=words, block=block), _BLOCK), f"index-{number}")
        n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        starts = F.col("starts")
        lengths = F.zip_with(F.slice(starts, 2, F.size("terms")), F.slice(starts, 1, F.size("terms")), lambda b, a: b - a)
        lists = index.select(F.explode(F.arrays_zip(F.col("terms").alias("t"), lengths.alias("n"))).alias("_"))
        df = lists.groupBy("_.t").agg(F.sum("_.n").alias("df")).collect()  # one row for each term of the items at most
        corpus = Corpus.of(n_docs, n_terms, {r["t"]: r["df"] for r in df}, len(words))
        search = partial(_search, queries=queries, corpus=corpus, k=k)
        best = narrow.store(index.mapInArrow(search, "query long, score long, doc_id long"), f"best-{number}")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, item["item_id"]) for q, item in enumerate(items_here)], f"query long, item_id {items.schema['item_id'].dataType.simpleString()}")
        parts.append(top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
        steps.drop(f"index-{number}")
    if not parts:
        nothing = texts.where(F.lit(False)).select("doc_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("score"))
        return nothing.select(F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), tf AS (
  SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t
), n AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), c AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n
), m AS (
  SELECT doc_id, 100 - 90 + (90 * n * n_docs) // n_terms AS m FROM n, c
), w AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, c GROUP BY t, n_docs
), s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY rank <= 10
"""
