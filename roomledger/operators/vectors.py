"""Embedding of texts and exact nearest neighbours."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored

# Ship the functions of this module inside the tasks, so that executors do not
# need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words whose codes an encoder remembers.
KNOWN_WORDS = 100_000

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """An encoder without a model: signed counts of hashed words, unit length.

    A word is a run of letters and digits in lower case. The first eight hex
    digits of its MD5 choose the dimension, the ninth the sign.
    """
    import hashlib
    import re

    words = re.compile(r"[^\W_]+|\0")

    class Codes(dict):
        """Word to dimension, shifted by ``dim`` for a negative sign; -1 ends a text."""

        def __missing__(self, word: str) -> int:
            digest = hashlib.md5(word.encode()).hexdigest()
            code = int(digest[:8], 16) % dim + (0 if digest[8] < "8" else dim)
            if len(self) < KNOWN_WORDS:
                self[word] = code
            return code

    codes = Codes({"\0": -1})

    def encode(texts: list[str]) -> np.ndarray:
        joined = "\0".join([(text or "").replace("\0", " ") for text in texts]).lower()
        found = np.fromiter(map(codes.__getitem__, words.findall(joined)), np.int64)
        ends = found < 0
        spots = np.cumsum(ends)[~ends] * (2 * dim) + found[~ends]
        counts = np.bincount(spots, minlength=2 * dim * len(texts)).reshape(len(texts), 2 * dim)
        out = (counts[:, :dim] - counts[:, dim:]).astype(float)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(norms == 0, 1, norms)).astype(np.float32)

    return encode


def embed(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    make_encoder: Callable[[], Encoder] = hashing_encoder,
    batch_size: int = 128,
    spread: int | None = None,
) -> DataFrame:
    """Embed texts in batches: ``(id, embedding array<float>)``.

    ``make_encoder`` runs once per task and returns a function from a list of
    texts to a 2-D array, so a model is loaded where it is used. The input keeps
    its parts and its order, and nothing is shuffled; only an input of fewer files
    than ``spread`` is dealt over that many tasks first.
    """
    kind = df.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, kind), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                texts = batch.column(1).slice(at, batch_size).to_pylist()
                part = np.ascontiguousarray(encode(texts), dtype=np.float32)
                offsets = np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]
                vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()))
                ids = batch.column(0).slice(at, len(part))
                yield pa.RecordBatch.from_arrays([ids, vectors], [id_col, "embedding"])

    rows = df.select(id_col, text_col)
    if spread and len(df.inputFiles()) < spread:
        rows = rows.repartition(spread)
    return rows.mapInArrow(run, schema)


def embed_cached(
    df: DataFrame,
    path: str,
    encoder_id: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    make_encoder: Callable[[], Encoder] = hashing_encoder,
    force: bool = False,
) -> DataFrame:
    """Embed with a Parquet table of known texts: ``(id, embedding)``.

    The table is keyed by ``encoder_id``, which names the model and its version,
    and a hash of the text. Each run embeds only the different texts this encoder
    does not know yet and appends them; ``force`` starts over for this encoder and
    leaves the others alone. Equal texts are embedded once, however often they
    occur. The append is committed as a whole, and one run at a time may write to
    a path.
    """
    spark = df.sparkSession
    schema = "text_hash string, embedding array<float>, encoder_id string"
    rows = df.select(id_col, F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("text_hash"))
    texts = df.select(F.coalesce(text_col, F.lit("")).alias("text")).distinct()
    texts = texts.select(F.sha2("text", 256).alias("text_hash"), "text")

    def known() -> DataFrame:
        return spark.read.schema(schema).parquet(path).where(F.col("encoder_id") == encoder_id)

    mode = "overwrite"
    if not force:
        try:
            texts, mode = texts.join(known().select("text_hash"), "text_hash", "left_anti"), "append"
        except AnalysisException:  # nothing stored yet
            pass
    new = embed(texts, "text_hash", "text", make_encoder).withColumn("encoder_id", F.lit(encoder_id))
    new.write.partitionBy("encoder_id").mode(mode).option("partitionOverwriteMode", "dynamic").parquet(path)
    return rows.join(known().drop("encoder_id"), "text_hash", "left").select(id_col, "embedding")


def validate_vectors(corpus: DataFrame, queries: DataFrame, col: str = "embedding") -> DataFrame:
    """Row counts and dimensions of both sides, with a verdict.

    ``status`` is ``ok``, ``empty`` or ``dimension mismatch``.
    """

    def shape(df: DataFrame, side: str) -> DataFrame:
        return df.agg(
            F.lit(side).alias("side"),
            F.count("*").alias("n"),
            F.min(F.size(col)).alias("lo"),
            F.max(F.size(col)).alias("hi"),
        )

    both = shape(corpus, "corpus").unionAll(shape(queries, "queries")).agg(
        F.max(F.when(F.col("side") == "corpus", F.col("n"))).alias("corpus_rows"),
        F.max(F.when(F.col("side") == "queries", F.col("n"))).alias("query_rows"),
        F.min("lo").alias("min_dim"),
        F.max("hi").alias("max_dim"),
    )
    return both.withColumn(
        "status",
        F.when((F.col("corpus_rows") == 0) | (F.col("query_rows") == 0), "empty")
        .when(F.col("min_dim") != F.col("max_dim"), "dimension mismatch")
        .otherwise("ok"),
    )


def dimension(df: DataFrame, col: str = "embedding") -> int | None:
    """Number of components of the first vector found; nothing without vectors."""
    first = df.where(F.size(col) > 0).select(F.size(col)).first()
    return first and first[0]


def _matrix(column: pa.Array) -> np.ndarray:
    """List column to a 2-D array of doubles."""
    lengths = pa.compute.unique(pa.compute.list_value_length(column)).to_pylist()
    if len(lengths) != 1 or not lengths[0]:
        raise ValueError(f"vectors of one dimension expected, found lengths {lengths}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), lengths[0])


def _nearest(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of ``x`` per row of ``q``, by distance and then id.

    A product in single precision finds the candidates with some slack; their
    distances are then taken directly and rounded, so that equal distances tie
    exactly.
    """
    if x.shape[1] != q.shape[1]:
        raise ValueError(f"query dimension {q.shape[1]} differs from corpus dimension {x.shape[1]}")
    small = np.ascontiguousarray(x.T, dtype=np.float32)
    norms = (x * x).sum(axis=1)
    found = []
    step = max(1, 4_000_000 // max(len(x), 1))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        own = (part * part).sum(axis=1)
        rough = norms.astype(np.float32)[None, :] - 2 * (part.astype(np.float32) @ small)
        # products of d terms, each off by at most 2^-23 of the norms
        slack = 4e-7 * (x.shape[1] + 4) * (own + norms.max()) + 1e-9
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(part), np.inf)
        qi, xi = np.nonzero(rough <= (kth + 2 * slack)[:, None])
        for low in range(0, len(qi), 100_000):
            a, b = qi[low : low + 100_000], xi[low : low + 100_000]
            dist = np.round(((part[a] - x[b]) ** 2).sum(axis=1), 9)
            found.append(pd.DataFrame({"query": at + a, "vec_id": ids[b], "dist2": dist}))
    return _keep(found, k)


def _keep(frames: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The k best candidates per query."""
    both = pd.concat(frames, ignore_index=True)
    both = both.sort_values(["query", "dist2", "vec_id"], kind="stable")
    return both.groupby("query", sort=False).head(k)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    query_id: str = "query_id",
    corpus_id: str = "vec_id",
    col: str = "embedding",
    block: int = 4096,
) -> DataFrame:
    """Exact k nearest neighbours by squared distance: ``(query_id, rank, vec_id, dist2)``.

    Distances are rounded to nine places and ties go to the smaller id. Up to ``block``
    queries travel to the tasks as one matrix, so the corpus stays where it is; each task
    keeps its own top k of every query, and only these are shuffled. More queries go
    through a cell index of the corpus (``cells``), which is read a fixed number of times.
    Store the corpus first if it is costly to make. A query without a vector, or with a
    component that is not finite, is as far from every row, null, NaN or infinitely.
    """
    from . import cells

    if queries.limit(block + 1).count() > block:
        index = cells.build_cells(corpus, corpus_id, col)
        return cells.search_cells(queries, index, k, query_id, col).neighbours
    q = _marked(queries.select(F.col(query_id).alias("query_id"), F.col(col).alias("embedding")))
    c = corpus.select(F.col(corpus_id).alias("vec_id"), F.col(col).alias("embedding"))
    spark = queries.sparkSession
    schema = T.StructType([T.StructField("query", T.LongType()), c.schema["vec_id"], T.StructField("dist2", T.DoubleType())])
    every = q.toArrow().combine_chunks()  # at most ``block`` rows
    own = every.filter(pa.compute.invert(every.column("far"))).combine_chunks()
    if own.num_rows:
        order = Window.partitionBy("query").orderBy("dist2", "vec_id")
        near = _search(spark, own, c, k, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = own.column("query_id").to_pylist()
        ids = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("query", T.LongType()), q.schema["query_id"]]))
        found = near.join(F.broadcast(ids), "query")  # at most ``block`` rows
        found = stored(found.select("query_id", "rank", "vec_id", "dist2"), "neighbours")
    else:
        empty = T.StructType([q.schema["query_id"], T.StructField("rank", T.IntegerType()), c.schema["vec_id"], schema["dist2"]])
        found = spark.createDataFrame([], empty)
    if own.num_rows < every.num_rows:
        rest = every.filter(every.column("far")).select(["query_id", "away"]).to_pylist()
        rest = spark.createDataFrame([(r["query_id"], r["away"]) for r in rest], T.StructType([q.schema["query_id"], q.schema["away"]]))
        found = found.unionByName(_first_ids(rest, c.select("vec_id"), k))
    return found


def _marked(queries: DataFrame) -> DataFrame:
    """With ``far`` for queries that are as far from every row, and how far that is."""
    x = F.col("embedding")
    odd = F.exists(x, lambda e: F.isnan(e) | (F.abs(e) == float("inf")))
    away = F.when(F.exists(x, F.isnan), float("nan")).when(x.isNotNull(), float("inf"))
    return queries.withColumns({"far": F.coalesce(x.isNull() | odd, F.lit(False)), "away": away})


def _first_ids(far: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest ids as neighbours of each query (query_id, away) that is as far from every row."""
    kind = ids.schema["vec_id"].dataType
    first = [r["vec_id"] for r in ids.orderBy("vec_id").limit(k).collect()]  # k values
    each = far.select("query_id", "away", F.posexplode(F.array(*map(F.lit, first)).cast(T.ArrayType(kind))).alias("at", "vec_id"))
    return each.select("query_id", (F.col("at") + 1).alias("rank"), "vec_id", F.col("away").alias("dist2"))


def _search(spark: SparkSession, own: pa.Table, corpus: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """Candidates of one block of queries: the k nearest of every task."""
    shared = spark.sparkContext.broadcast(_matrix(own.column("embedding").chunk(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column("vec_id").to_pandas().to_numpy()
            near = _nearest(shared.value, ids, _matrix(batch.column("embedding")), k)
            best = near if best is None else _keep([best, near], k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return corpus.mapInArrow(run, schema)
