"""A cell index over vectors: exact nearest neighbours that skip far cells, and approximate ones out of few cells."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored
from .vectors import _first_ids, _keep, _marked, _matrix, _nearest

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells at most, and vectors that their centres are fitted on. All vectors are indexed.
CELLS, SAMPLE, ROUNDS = 1024, 20_000, 8
#: Vectors of a block, queries that meet a block in one task, and rows that travel to Python together.
BLOCK, QUERIES, BATCH = 512, 4096, 128
#: Queries of a tile, which every task holds while its blocks pass, and rows whose distances to all centres are held.
TILE, STEP = 32_768, 1024
#: Distances are compared with so much slack, for rounding.
SLACK = 1e-6


@dataclass(frozen=True)
class CellIndex:
    """Cells around centres; each cell's vectors in blocks of rows with similar distance to the centre.

    ``blocks`` has one row per block: block, cell, low and high (least and greatest distance
    to the centre), n, ids, vectors (one after the other).
    """

    centres: np.ndarray
    radius: np.ndarray
    n: int
    blocks: DataFrame
    id_type: T.DataType


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows to centres: a matrix of rows by centres, so pass some rows at a time."""
    if x.shape[1] != centres.shape[1]:
        raise ValueError(f"query dimension {x.shape[1]} differs from corpus dimension {centres.shape[1]}")
    squares = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(squares, 0))


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and distance of each row's nearest centre."""
    cell, near = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), STEP):
        away = _distances(x[at : at + STEP], centres)
        cell[at : at + STEP], near[at : at + STEP] = np.argmin(away, 1), away.min(1)
    return cell, near


def fit_centres(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of ``cells`` groups at most, by Lloyd's rounds from spread first rows."""
    centres = np.unique(x, axis=0)
    centres = centres[np.random.default_rng(7).permutation(len(centres))[:cells]]
    for _ in range(rounds):
        own = _nearest_centre(x, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _few(c: DataFrame, n: int) -> DataFrame:
    """Of ``n`` rows those with a hash of the id below a bound that at least ``SAMPLE`` rows meet, twice as many as a rule.

    Without it every task would send its first ``SAMPLE`` rows to the one that puts them in order.
    """
    share = 2 * SAMPLE / n
    while share < 1:  # again only where ids repeat
        few = c.where(F.xxhash64("vec_id") < int(share * 2**64) - 2**63)
        if few.count() >= SAMPLE:
            return few
        share *= 2
    return c


def _fitted(c: DataFrame, n: int, cells: int) -> np.ndarray:
    """Centres of the ``SAMPLE`` rows of smallest hash, fitted in one task; only the centres come to the driver."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(batch.column(0)) for batch in batches if batch.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(fit_centres(np.concatenate(parts), cells)))], ["centre"])

    sample = _few(c, n).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding")
    centres = sample.coalesce(1).mapInArrow(fit, "centre array<double>").toArrow().combine_chunks()
    return _matrix(centres.column("centre").chunk(0))


def build_cells(corpus: DataFrame, corpus_id: str = "vec_id", col: str = "embedding", cells: int | None = None) -> CellIndex:
    """Index all rows; centres come from the ``SAMPLE`` rows whose ids have the smallest hashes.

    Rows are ordered by cell, distance to the centre and a hash of the id, so that a cell
    with a third of all rows, or many copies of one vector, spreads over tasks.
    """
    c = corpus.select(F.col(corpus_id).alias("vec_id"), F.col(col).alias("embedding"))
    kind = c.schema["vec_id"].dataType
    n = c.count()
    if not n:
        return CellIndex(np.empty((0, 0)), np.empty(0), 0, c.limit(0), kind)
    centres = _fitted(c, n, cells or min(CELLS, max(1, int(n**0.5))))
    shared = corpus.sparkSession.sparkContext.broadcast(centres)  # at most CELLS rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, near = _nearest_centre(_matrix(batch.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(near), *batch.columns], ["cell", "away", "vec_id", "embedding"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, number = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            rows = pa.concat_batches(held)
            cell, away = rows.column(0)[0].as_py(), rows.column(1).to_numpy()
            values = [[part + number], [cell], [away[0]], [away[-1]], [len(away)], [rows.column(2).to_pylist()]]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(rows.column(2).type)]
            arrays = [pa.array(v, t) for v, t in zip(values, types, strict=True)]
            flat = rows.column(3).flatten()
            vectors = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
            return pa.RecordBatch.from_arrays([*arrays, vectors], ["block", "cell", "low", "high", "n", "ids", "vectors"])

        for batch in batches:
            cell = batch.column(0).to_numpy()
            at = 0
            while at < len(cell):
                if held and (held[0].column(0)[0].as_py() != cell[at] or sum(h.num_rows for h in held) == BLOCK):
                    yield block()
                    held, number = [], number + 1
                end = at + int(np.argmax(np.append(cell[at:] != cell[at], True)))
                end = min(end, at + BLOCK - sum(h.num_rows for h in held))
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield block()

    assigned = c.mapInArrow(assign, T.StructType([T.StructField("cell", T.LongType()), T.StructField("away", T.DoubleType()), *c.schema.fields]))
    assigned = stored(assigned, "assigned")
    # the blocks are searched where they are stored, so there are as many parts as cores, if there are blocks enough
    parts = max(-(-n // (8 * BLOCK)), min(corpus.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK)))
    parts = min(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
    ordered = assigned.repartitionByRange(parts, "cell", "away", F.xxhash64("vec_id"))
    ordered = ordered.sortWithinPartitions("cell", "away", F.xxhash64("vec_id")).select("cell", "away", "vec_id", "embedding")
    number = [T.StructField(x, T.LongType()) for x in ("block", "cell")]
    range_ = [T.StructField(x, T.DoubleType()) for x in ("low", "high")]
    lists = [T.StructField("ids", T.ArrayType(kind)), T.StructField("vectors", c.schema["embedding"].dataType)]
    blocks = stored(ordered.mapInArrow(cut, T.StructType([*number, *range_, T.StructField("n", T.LongType()), *lists])), "cells")
    radius = np.full(len(centres), -1.0)
    for r in blocks.groupBy("cell").agg(F.max("high").alias("r")).collect():  # at most CELLS rows
        radius[r["cell"]] = r["r"]
    return CellIndex(centres, radius, n, blocks, kind)


def _alike(queries: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the vectors in one type, doubles if the types differ."""
    if queries.schema["embedding"].dataType.elementType != blocks.schema["vectors"].dataType.elementType:
        queries, blocks = (df.withColumn(c, F.col(c).cast("array<double>")) for df, c in ((queries, "embedding"), (blocks, "vectors")))
    return queries, blocks


def _met(targets: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """row, vec_id and dist2: the ``k`` nearest of each block for targets (row, block, embedding).

    A block goes once to each task that searches it; more than ``QUERIES`` queries of one
    block are dealt over several tasks.
    """
    targets, blocks = _alike(targets, index.blocks)
    shards = targets.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("shards"))
    asked = targets.join(shards, "block").select("block", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard"), "row", "embedding")
    nothing = F.lit(None).cast(blocks.schema["ids"].dataType).alias("ids")
    asked = asked.select("block", "shard", F.lit(1).alias("side"), "row", F.col("embedding").alias("vectors"), nothing)
    kept = blocks.join(shards, "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    kept = kept.select("block", "shard", F.lit(0).alias("side"), F.lit(-1).cast("long").alias("row"), "vectors", "ids")
    rows = kept.unionByName(asked).repartition("block", "shard").sortWithinPartitions("block", "shard", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = x = None
        waiting: list[tuple[int, np.ndarray]] = []

        def found() -> pa.RecordBatch:
            near = _nearest(np.stack([v for _, v in waiting]), ids, x, k)
            row = np.array([r for r, _ in waiting])[near["query"].to_numpy()]
            vec_id = pa.array(near["vec_id"].to_numpy(), rows_type)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(row), vec_id, pa.array(near["dist2"].to_numpy())], ["row", "vec_id", "dist2"])

        for batch in batches:
            rows_type = batch.schema.field("ids").type.value_type
            for side, row, vector, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                values = vector.values.to_numpy().astype(np.float64)
                if side == 0:
                    if waiting:
                        yield found()
                    ids = own.values.to_pandas().to_numpy()
                    x = values.reshape(len(ids), -1)
                else:
                    waiting.append((row, values))
                    if len(waiting) == 512:
                        yield found()
        if waiting:
            yield found()

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("vec_id", index.id_type), T.StructField("dist2", T.DoubleType())])
    return stored(rows.mapInArrow(search, schema), "met", batch_rows=BATCH)


def _first_blocks(q: DataFrame, index: CellIndex, probes: int | None) -> DataFrame:
    """row, block, n, reach and embedding: the nearest block of each of the two nearest cells of each query.

    ``reach`` is the distance to the last of the ``probes`` nearest centres, infinite for all.
    """
    ranges = index.blocks.select("cell", "block", "low", "high", "n").orderBy("cell", "block").toPandas()  # a row per block
    shared = q.sparkSession.sparkContext.broadcast((index.centres, ranges))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, ranges = shared.value
        block, low, high, n = (ranges[c].to_numpy() for c in ("block", "low", "high", "n"))
        used, starts = np.unique(ranges["cell"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(block))
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                away = _distances(_matrix(part.column(1)), centres[used])
                near = np.argsort(away, 1, kind="stable")[:, :probes]
                reach = away[np.arange(len(away)), near[:, -1]] if probes else np.full(len(away), np.inf)
                near = near[:, :2]
                i, j = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
                best = np.empty(len(i), np.int64)
                for cell in np.unique(j):
                    mine, own = np.flatnonzero(j == cell), slice(starts[cell], ends[cell])
                    d = away[i[mine], cell][:, None]
                    best[mine] = starts[cell] + np.argmin(np.maximum(np.maximum(d - high[own], low[own] - d), 0), 1)
                rows = pa.array(i)
                arrays = [part.column(0).take(rows), pa.array(block[best]), pa.array(n[best]), pa.array(reach[i]), part.column(1).take(rows)]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "block", "n", "reach", "embedding"])

    fields = [T.StructField(c, T.LongType()) for c in ("row", "block", "n")]
    return q.mapInArrow(choose, T.StructType([*fields, T.StructField("reach", T.DoubleType()), q.schema["embedding"]]))


class _Tile:
    """Queries that a task holds, with their ``k`` nearest vectors among the blocks that have passed."""

    def __init__(self, centres: np.ndarray, k: int, rows: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, reach: np.ndarray, done: np.ndarray):
        self.centres, self.k, self.rows, self.q, self.reach, self.done = centres, k, rows, vectors.astype(np.float64), reach, done
        self.own = (self.q * self.q).sum(1)
        self.small = np.concatenate([self.q, np.ones((len(self.q), 1))], 1).astype(np.float32)
        self.limit = bounds.copy()  # no more than the k-th distance, squared
        self.cell = self.best = None
        self.compared, self.waiting, self.n_waiting = 0, [], 0

    def _asking(self, block: int, cell: int, low: float, high: float) -> np.ndarray:
        """The queries that must be compared with a block."""
        if cell != self.cell:
            self.cell, self.away = cell, np.sqrt(((self.q - self.centres[cell]) ** 2).sum(1))
        slack = SLACK * (1 + self.away)
        least = np.maximum(np.maximum(self.away - high, low - self.away), 0)
        near = (least <= np.sqrt(self.limit + 1e-9) + slack) & (self.away <= self.reach + slack)  # limits are rounded to nine places
        return np.flatnonzero(near & (self.done != block).all(1))

    def meet(self, block: int, cell: int, low: float, high: float, ids: np.ndarray, x: np.ndarray) -> None:
        asking = self._asking(block, cell, low, high)
        self.compared += len(asking) * len(x)
        if not len(asking):
            return
        same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
        if np.bincount(same).max() > self.k:  # of equal vectors, only the first k by id can be among the k nearest
            few = np.sort(_keep([pd.DataFrame({"query": same, "vec_id": ids, "dist2": 0.0})], self.k).index.to_numpy())
            x, ids = x[few], ids[few]
        x = x.astype(np.float64)
        norms = (x * x).sum(1)
        turned = np.ascontiguousarray(np.concatenate([-2 * x, norms[:, None]], 1).T, dtype=np.float32)
        step = max(1, 1_000_000 // len(x))
        for at in range(0, len(asking), step):
            mine = asking[at : at + step]
            rough = self.small[mine] @ turned  # the distances, less the query's own square
            # products of d + 1 terms, each off by at most 2^-23 of the norms
            slack = 4e-7 * (x.shape[1] + 5) * (self.own[mine] + norms.max()) + 1e-9
            most = self.limit[mine] - self.own[mine]
            open_ = np.flatnonzero(np.isinf(most))
            if len(open_) and len(x) > self.k:
                most[open_] = np.partition(rough[open_], self.k - 1, axis=1)[:, self.k - 1]
            most = np.nextafter((most + 2 * slack).astype(np.float32), np.float32(np.inf))
            flat = np.flatnonzero(rough <= most[:, None])
            for begin in range(0, len(flat), 100_000):
                a, b = np.divmod(flat[begin : begin + 100_000], len(x))
                dist = np.round(((self.q[mine[a]] - x[b]) ** 2).sum(1), 9)
                fits = dist <= self.limit[mine[a]]
                self.waiting.append(pd.DataFrame({"query": mine[a][fits], "vec_id": ids[b][fits], "dist2": dist[fits]}))
                self.n_waiting += int(fits.sum())
                if self.n_waiting > max(4 * len(self.q), 100_000):
                    self._merge()

    def _merge(self) -> None:
        if self.n_waiting:
            self.best = _keep([self.best, *self.waiting] if self.best is not None else self.waiting, self.k)
            self.waiting, self.n_waiting = [], 0
            n = np.bincount(self.best["query"].to_numpy(), minlength=len(self.q))
            full = np.flatnonzero(n == self.k)
            self.limit[full] = np.minimum(self.limit[full], self.best["dist2"].to_numpy()[np.cumsum(n)[full] - 1])

    def result(self, ids: pa.DataType) -> Iterator[pa.RecordBatch]:
        """row, vec_id and dist2, and one row with the number of pairs compared."""
        self._merge()
        names, types = ["row", "vec_id", "dist2", "n"], [pa.int64(), ids, pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((None, None, None, self.compared), types, strict=True)], names)
        if self.best is not None:
            arrays = [pa.array(self.rows[self.best["query"].to_numpy()]), pa.array(self.best["vec_id"].to_numpy(), ids), pa.array(self.best["dist2"].to_numpy()), pa.nulls(len(self.best), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names)


def _scan(asked: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """row, vec_id and dist2: the ``k`` nearest for queries (row, embedding, bound, reach, done), as far as not above the bound.

    Rows without ``row`` have ``n``, pairs compared. Queries are dealt over tiles of about
    ``TILE``, which are broadcast one after the other; for each tile, tasks read the blocks
    where they are stored and hold the tile while their blocks pass one by one. So no block is
    shuffled or written again, however many tiles there are. The blocks ``done`` are left out.
    """
    spark = asked.sparkSession
    tiles = max(1, -(-asked.count() // TILE))
    asked, blocks = _alike(asked, index.blocks)
    tile = F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int")
    dealt = stored(asked.withColumn("tile", tile).repartitionById(tiles, "tile"), "tiles")  # a file for each tile
    ids = T.StructField("vec_id", index.id_type)
    schema = T.StructType([T.StructField("row", T.LongType()), ids, T.StructField("dist2", T.DoubleType()), T.StructField("n", T.LongType())])

    def passed(tile: int) -> Iterator[DataFrame]:
        own = dealt.where(F.col("tile") == tile).toArrow().combine_chunks()  # about TILE rows
        rows, bounds, reach = (own.column(c).to_numpy() for c in ("row", "bound", "reach"))
        if not len(rows):
            yield spark.createDataFrame([], schema)
            return
        vectors, done = own.column("embedding").chunk(0), own.column("done").to_pylist()
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        done = np.array([blocks + [-1] * (2 - len(blocks)) for blocks in done])
        shared = spark.sparkContext.broadcast((index.centres, k, rows, x, bounds, reach, done))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = ids = None
            for batch in batches:
                held, ids = held or _Tile(*shared.value), batch.schema.field("ids").type.value_type
                scalars = zip(*[batch.column(c).to_pylist() for c in ("block", "cell", "low", "high")], strict=True)
                for i, scalar in enumerate(scalars):
                    own = batch.column("ids")[i].values.to_pandas().to_numpy()
                    held.meet(*scalar, own, batch.column("vectors")[i].values.to_numpy().reshape(len(own), -1))
            if held is not None:
                yield from held.result(ids)

        yield blocks.select("block", "cell", "low", "high", "ids", "vectors").mapInArrow(search, schema)
        shared.destroy()

    return stored((df for tile in range(tiles) for df in passed(tile)), "scanned", batch_rows=BATCH)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy("dist2", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Found:
    """Neighbours (query_id, rank, vec_id, dist2), and how many pairs of a query and a vector were compared."""

    neighbours: DataFrame
    compared: int


def search_cells(queries: DataFrame, index: CellIndex, k: int = 5, query_id: str = "query_id", col: str = "embedding",
                 probes: int | None = None) -> Found:
    """The ``k`` nearest vectors of each query by squared distance, ties to the smaller id.

    Exact without ``probes``: the nearest block of each of the two nearest cells gives a
    bound for the k-th distance; then all other blocks are searched that the triangle
    inequality does not rule out, by the block's range of distances to its centre. Tiles of
    queries go to the blocks, so no table has a row for each query and block, or a block for
    each tile. With ``probes`` only that many cells are searched, and neighbours elsewhere are
    missed. A query without a vector, or with a component that is not finite, is as far from
    every row.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(col).alias("embedding"))
    every = stored(_marked(q.withColumn("row", F.monotonically_increasing_id())), "queries")
    q, far = every.where("NOT far").drop("far", "away"), every.where("far")
    if not index.n:
        schema = T.StructType([q.schema["query_id"], T.StructField("rank", T.IntegerType()), T.StructField("vec_id", index.id_type), T.StructField("dist2", T.DoubleType())])
        return Found(queries.sparkSession.createDataFrame([], schema), 0)
    first = stored(_first_blocks(q.select("row", "embedding"), index, probes), "first")
    near = stored(_best(_met(first, index, k), k).drop("rank"), "near")
    kth = near.groupBy("row").agg(F.max("dist2").alias("d"), F.count(F.lit(1)).alias("c"))
    bounds = kth.select("row", F.when(F.col("c") == k, F.col("d")).otherwise(F.lit(float("inf"))).alias("bound"))
    done = first.groupBy("row").agg(F.collect_list("block").alias("done"), F.max("reach").alias("reach"))
    scanned = _scan(q.select("row", "embedding").join(bounds, "row").join(done, "row"), index, k)
    compared = sum(df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for df in (first, scanned))
    found = scanned.where("row IS NOT NULL").drop("n").unionByName(near)
    found = stored(_best(found, k), "found")
    named = found.join(q.select("row", "query_id"), "row").select("query_id", "rank", "vec_id", "dist2")
    if not far.isEmpty():
        named = named.unionByName(_first_ids(far, index.blocks.select(F.explode("ids").alias("vec_id")), k))
    return Found(named, compared)
