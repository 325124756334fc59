"""Exact top-k search: global score histograms locate every k-th score."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps

K, SCALE = 20, 64.0
#: Queries scored together, rows scored at once, and bits of the score a histogram resolves.
BLOCK, ROWS, BITS = 2048, 1024, 10
_OWN = -(1 << 62)  # the score of a query with its own row: below all others


def integer_vectors(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, v (components as floor(scale * x)) and dim, for rows that can be scored.

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    v = F.transform(x, lambda e: F.floor(F.lit(scale) * e))
    return good.select(F.col("vec_id").cast("long"), v.alias("v"), F.size("embedding").alias("dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


@dataclass
class Block:
    """A bounded set of queries of one dimension, and what is known of their k-th scores.

    The k-th score of query i lies in [low, low + 2^bits); ``above`` scores are higher.
    ``every`` marks queries with fewer than k candidates.
    """

    ids: np.ndarray
    vectors: np.ndarray
    exact_floats: bool
    low: np.ndarray
    above: np.ndarray
    every: np.ndarray
    bits: int

    def scores(self, vec_ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact_floats:
            found = (self.vectors.astype(float) @ rows.astype(float).T).astype(np.int64)
        else:
            found = self.vectors @ rows.T
        order = np.argsort(self.ids, kind="stable")
        first, last = (np.searchsorted(self.ids, vec_ids, side, sorter=order) for side in ("left", "right"))
        for row in np.flatnonzero(last > first):
            found[order[first[row] : last[row]], row] = _OWN
        return found


def _scored(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    dim = block.vectors.shape[1]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            yield ids, block.scores(ids, _matrix(part.column(1), dim))


def histogram(batches: Iterator[pa.RecordBatch], block: Block, k: int) -> Iterator[pa.RecordBatch]:
    """(query, bin, n) of a task's scores inside each query's interval.

    Bins below which the task alone has k higher scores cannot hold the k-th and are left out.
    """
    bits = min(BITS, block.bits)
    bins, shift = 1 << bits, block.bits - bits
    counts = np.zeros((len(block.ids), bins), np.int64)
    for _, scores in _scored(batches, block):
        bin_ = (scores - block.low[:, None]) >> shift
        inside = (bin_ >= 0) & (bin_ < bins)
        query, row = np.nonzero(inside)
        counts += np.bincount(query * bins + bin_[query, row], minlength=counts.size).reshape(counts.shape)
    higher = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts
    query, bin_ = np.nonzero((counts > 0) & (higher < k))
    arrays = [pa.array(query), pa.array(bin_), pa.array(counts[query, bin_])]
    yield pa.RecordBatch.from_arrays(arrays, ["query", "bin", "n"])


def chosen(batches: Iterator[pa.RecordBatch], block: Block, k: int) -> Iterator[pa.RecordBatch]:
    """(query, vec_id, score) above the k-th score, and of those equal to it the smallest ids of the task."""
    for ids, scores in _scored(batches, block):
        order = np.argsort(ids, kind="stable")
        ids, scores = ids[order], scores[:, order]
        tie = (scores == block.low[:, None]) & ~block.every[:, None]
        tie &= np.cumsum(tie, 1) <= k
        query, row = np.nonzero(((scores > block.low[:, None]) | tie | block.every[:, None]) & (scores != _OWN))
        arrays = [pa.array(query), pa.array(ids[row]), pa.array(scores[query, row])]
        yield pa.RecordBatch.from_arrays(arrays, ["query", "vec_id", "score"])


def _locate(block: Block, candidates: DataFrame, k: int, run: Callable[[DataFrame, Callable, str], DataFrame]) -> None:
    """Refine the histograms until every k-th score is a single value."""
    while block.bits:
        bits = min(BITS, block.bits)
        counts = run(candidates, histogram, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query").orderBy(F.col("bin").desc())
        totals = counts.withColumn("upto", F.sum("n").over(down))
        above = candidates.sparkSession.createDataFrame(
            [(i, int(a)) for i, a in enumerate(block.above)], "query long, above long"
        )
        reached = totals.join(F.broadcast(above), "query").where(F.col("upto") + F.col("above") >= k)
        best = reached.groupBy("query").agg(F.max_by(F.struct("bin", "n", "upto"), "bin").alias("b")).collect()
        found = np.zeros(len(block.ids), bool)
        for r in best:
            i, b = r["query"], r["b"]
            found[i] = True
            block.low[i] += b["bin"] << (block.bits - bits)
            block.above[i] += b["upto"] - b["n"]
        block.every |= ~found
        block.bits -= bits


def _query_blocks(queries: DataFrame, size: int) -> list[tuple[int, list[int]]]:
    """(dim, parts) of at most ``size`` queries each; a part is a stretch of stored queries."""
    blocks: list[tuple[int, list[int]]] = []
    held = size
    for r in sorted(queries.groupBy("dim", "part").count().collect()):
        if not blocks or blocks[-1][0] != r["dim"] or held + r["count"] > size:
            blocks.append((r["dim"], []))
            held = 0
        blocks[-1][1].append(r["part"])
        held += r["count"]
    return blocks


def top_k(vectors: DataFrame, is_query: str, k: int = K, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query.

    Candidates are all rows but those with the query's own vec_id; ties go to the smaller
    vec_id. Queries are taken in blocks of bounded size, each sent to all tasks; every
    task scores its rows, and only histogram counts and the chosen rows are shuffled.
    Only vectors of equal length are compared. A query row that repeats is answered each
    time, a candidate row that repeats counts each time. Rows that take no part: see
    ``integer_vectors``. Without queries or candidates the result is empty.
    """
    spark = vectors.sparkSession
    steps = Steps(spark, "topk", batch_rows=10000)
    rows = steps.store(integer_vectors(vectors, scale), "vectors")
    queries = rows.where(is_query).withColumn("_id", F.monotonically_increasing_id())
    queries = steps.store(queries.withColumn("part", F.floor(F.col("_id") / min(block, 256))), "queries")
    largest = rows.agg(F.max(F.array_max(F.transform("v", lambda e: F.abs(e))))).first()[0] or 0
    results = []
    for number, (dim, parts) in enumerate(_query_blocks(queries, block)):
        own = queries.where((F.col("dim") == dim) & F.col("part").isin(parts)).orderBy("_id").select("vec_id", "v").collect()
        bound = dim * largest**2
        if bound >= 1 << 60:
            raise ValueError("scores do not fit into 64 bits")
        bits = (2 * bound).bit_length()
        n = len(own)
        asked = Block(
            np.array([r["vec_id"] for r in own], np.int64), np.array([r["v"] for r in own], np.int64).reshape(n, dim), bound < 1 << 53,
            np.full(n, -bound), np.zeros(n, np.int64), np.zeros(n, bool), bits,
        )
        candidates = rows.where(F.col("dim") == dim).select("vec_id", "v")

        def run(df: DataFrame, task: Callable, schema: str, asked: Block = asked) -> DataFrame:
            sent = spark.sparkContext.broadcast(asked)
            return df.mapInArrow(lambda batches: task(batches, sent.value, k), schema)

        _locate(asked, candidates, k, run)
        hits = run(candidates, chosen, "query long, vec_id long, score long")
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
        hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, int(q)) for i, q in enumerate(asked.ids)], "query long, query_id long")
        results.append(steps.store(hits.join(F.broadcast(ids), "query").select("query_id", "rank", "vec_id", "score"), f"block-{number}"))
    if not results:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return spark.read.schema(results[0].schema).parquet(*[steps.paths[f"block-{i}"] for i in range(len(results))])


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id)::INT AS rank,
       c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
WHERE q.vec_id % 20 = 0
QUALIFY rank <= 20
"""
