"""Near-duplicates by SimHash: fingerprints linked through BK-trees; groups by shingle similarity."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import minhash
from .common import Steps, fresh, hot_rows, join_counted, join_lookup, text_of
from .graph import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints that agree in a band meet in one tree; four bands of 16 bits and a radius of 3 leave one band equal.
BANDS, BAND_BITS = 4, 16
#: A band value with m fingerprints, if it is hot, is cut into about sqrt(m / TREE) shards.
TREE = 256
#: Rows of whole trees that are searched together, and pairs of query and node held at once.
ROWS, PAIRS = 1 << 16, 1 << 20
#: De-duplication by similarity: links from a Jaccard similarity of 0.8 on.
SIMILAR = minhash.Scheme(percent=80)

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text, as a signed number.

    A-Z in lower case; words are runs without space and the controls 9 to 13; shingles of
    consecutive words count as often as they occur; fewer words form one shingle; no words
    give zero. A bit is 1 if it is set in over half of the shingles' hashes.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        bits = np.uint64(_hash(b" ".join(words)))
        return int(bits.astype(np.int64))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = len(words) - shingle + 1
    hashes = np.fromiter(map(_hash, shingles), np.uint64, n)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([fingerprint(t.as_py()) for t in batch.column(2)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["row_id", "doc_id", "fp"])


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest index) after linking a to b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def linked(tree: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint the first one of its tree that it is connected to by links within the radius.

    ``tree`` is sorted; fingerprints of a tree differ. All BK-trees are built level by
    level: the rows that hang below one node at one distance elect the first of them as
    the child, and the others go on below it. Links between a child and its parent come
    free. A link between two parts of a tree has an end outside the tree's largest part,
    so only those rows are searched, from the root down the edges within the radius.
    """
    n = len(tree)
    start = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
    root = np.repeat(start, np.diff(np.append(start, n)))
    waiting = np.flatnonzero(np.arange(n) != root)
    at = root[waiting]
    edges, children = [], []
    while len(waiting):
        key = at * 65 + np.bitwise_count(fp[waiting] ^ fp[at])
        edge, first, place = np.unique(key, return_index=True, return_inverse=True)
        edges.append(edge)
        children.append(waiting[first])
        rest = np.ones(len(waiting), bool)
        rest[first] = False
        waiting, at = waiting[rest], waiting[first][place[rest]]
    label = np.arange(n)
    if not edges:
        return label
    edge, child = np.concatenate(edges), np.concatenate(children)
    order = np.argsort(edge)
    edge, child = edge[order], child[order]
    near = edge % 65 <= radius
    label = _roots(label, edge[near] // 65, child[near])

    size = np.bincount(label, minlength=n)[label]
    best = np.maximum.reduceat(size, start)
    largest = np.full(n, -1)
    is_best = size == np.repeat(best, np.diff(np.append(start, n)))
    first_best = np.flatnonzero(is_best)
    largest[root[first_best][::-1]] = label[first_best][::-1]
    queries = np.flatnonzero(label != largest[root])
    cost = np.cumsum(np.repeat(np.diff(np.append(start, n)), np.diff(np.append(start, n)))[queries])
    for part in np.split(queries, np.searchsorted(cost, np.arange(PAIRS, cost[-1] if len(cost) else 0, PAIRS))):
        q, node = part, root[part]
        while len(q):
            d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
            hit = d <= radius
            label = _roots(label, q[hit], node[hit])
            low = np.searchsorted(edge, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(edge, node * 65 + np.minimum(d + radius, 64), "right")
            n_children = high - low
            q = np.repeat(q, n_children)
            offset = np.arange(len(q)) - np.repeat(np.cumsum(n_children) - n_children, n_children)
            node = child[np.repeat(low, n_children) + offset]
    return label


def _tree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (tree, fp) that come sorted by tree, whole trees at a time."""

    def found(tree: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        label = linked(tree, fp.view(np.uint64))
        apart = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[apart]), pa.array(fp[label[apart]])], ["a", "b"])

    trees, fps, held = [], [], 0
    for batch in batches:
        trees.append(batch.column(0).to_numpy())
        fps.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held >= ROWS:
            tree, fp = np.concatenate(trees), np.concatenate(fps)
            whole = int(np.searchsorted(tree, tree[-1]))
            if whole:
                yield found(tree[:whole], fp[:whole])
            trees, fps, held = [tree[whole:]], [fp[whole:]], len(tree) - whole
    if held:
        yield found(np.concatenate(trees), np.concatenate(fps))


def links(steps: Steps, distinct: DataFrame, n: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the radius; a spanning set for each tree.

    Two fingerprints within 3 bits agree in one of four bands, so each goes to the trees
    of its four band values. Band values are counted first: of a hot one, the fingerprints
    are dealt over shards, and each pair of shards makes a tree. Hot values have more than
    one in 65,536 of all rows, so there are no more than that.
    """
    bands = [F.struct(((F.lit(b) * (1 << BAND_BITS)) + F.shiftrightunsigned("fp", b * BAND_BITS).bitwiseAND((1 << BAND_BITS) - 1)).alias("k")) for b in range(BANDS)]
    keyed = distinct.select("fp", F.explode(F.array(*bands)).alias("_")).select("fp", F.col("_.k").alias("band"))
    least = max(TREE, BANDS * n // 65536)
    hot = keyed.groupBy("band").count().where(F.col("count") > least)
    hot = hot.select("band", F.ceil(F.sqrt(F.col("count") / TREE)).cast("int").alias("shards"))
    dealt = keyed.join(F.broadcast(hot), "band", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("_s", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
    dealt = dealt.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    tree = F.col("band") * (1 << 40) + F.least("_s", "_t") * F.lit(1 << 20).cast("long") + F.greatest("_s", "_t")
    rows = dealt.select(tree.cast("long").alias("tree"), "fp").repartition("tree").sortWithinPartitions("tree", "fp")
    return steps.store(rows.mapInArrow(_tree_links, "a long, b long"), "tree-links")


def _near(steps: Steps, rows: DataFrame) -> DataFrame:
    """row_id, doc_id, fp and label for rows (row_id, doc_id, text); linked rows share the label."""
    prints = steps.store(rows.mapInArrow(_fingerprints, "row_id long, doc_id long, fp long"), "fingerprints")
    distinct = steps.store(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n_rows")), "distinct")
    n, total = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    joined = components(steps, links(steps, distinct, n)).withColumnRenamed("node", "fp")
    labels = distinct.join(joined, "fp", "left").select("fp", "n_rows", F.coalesce("label", "fp").alias("label"))
    labels = steps.store(labels, "labels")
    hot = hot_rows(labels, "n_rows", total)
    return steps.store(join_lookup(prints, labels, ["fp"], hot, F.col("row_id")).drop("n_rows"), "rows")


def _rows(docs: DataFrame, key: str | None = None):
    row_id = F.col(key) if key else F.monotonically_increasing_id()
    return docs.select(row_id.alias("row_id"), F.col("doc_id").cast("long"), text_of("text").alias("text"))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id among the documents that are reachable by links.
    A null text counts as empty (fingerprint zero). A null doc_id belongs to its group but
    names none; a group of null ids alone has a null component_id. Repeated rows are kept.
    """
    steps = Steps(docs.sparkSession, "near", batch_rows=500)
    rows = _near(steps, _rows(docs))
    first = steps.store(rows.groupBy("label").agg(F.min("doc_id").alias("component_id")), "first")
    found = join_counted(rows, first, "label", F.col("row_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of shingles, as a signed number: every shingle counts once."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 10):
        part = hashes[at : at + (1 << 10)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def _tree_pairs(steps: Steps, sets: DataFrame) -> DataFrame:
    """Pairs (node, centre) that BK-trees link: sets of one fingerprint, and the first sets of linked fingerprints."""
    first = steps.store(sets.groupBy(F.col("sim").alias("fp")).agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("c")), "fingerprints")
    n, total = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    near = links(steps, first.select("fp"), n)
    same = join_lookup(sets.select("node", F.col("sim").alias("fp")), first.drop("c"), ["fp"], hot_rows(first, "c", total).drop("c"), F.col("node"))
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(n)) for c, n in (("a", "node"), ("b", "centre")))
    same = same.where("node <> first").select("node", F.col("first").alias("centre"))
    return same.unionByName(near.join(a, "a").join(b, "b").select("node", "centre"))


def _similar_kept(steps: Steps, docs: DataFrame) -> DataFrame:
    """doc_id, text_id and number of rows of the document that stays, for each group by similarity."""
    rows, sets = minhash.sketches(steps, docs, SIMILAR, set_fingerprint)
    groups = minhash.similar_groups(steps, docs, sets, SIMILAR, _tree_pairs(steps, sets))
    found = minhash.labelled_rows(steps, rows, sets, groups)
    same = found.groupBy("doc_id", "text_id", "label").agg(F.count(F.lit(1)).alias("c"))
    best = same.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id", "c")).alias("k"))
    kept = steps.store(best.select("k.doc_id", "k.text_id", "k.c"), "kept")
    steps.drop("sets", "rows", "groups", "open-keys", "open-links", "node-labels", "names", "row-labels", "fingerprints", "tree-links")
    return kept


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text are in ``kept`` (doc_id, text_id, c), with all columns.

    Where a pair stands for c > 1 rows, the first by the other columns stays.
    """
    key = fresh("key", docs.columns)
    text, doc = f"{key}_text", f"{key}_doc"
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(doc)
    rows = docs.select("*", F.xxhash64(text_of("text")).alias(text), name("doc_id"))
    keys = lambda some: kept.where(some).select(F.col("text_id").alias(text), name("doc_id"))
    one = rows.join(keys("c = 1"), [text, doc], "left_semi")
    others = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])) if len(docs.columns) > 2 else F.lit("")
    first = Window.partitionBy(text, doc).orderBy(others)
    more = rows.join(keys("c > 1"), [text, doc], "left_semi").withColumn(key, F.row_number().over(first)).where(F.col(key) == 1)
    return one.select(*docs.columns).unionByName(more.select(*docs.columns))


def near_deduplicate(docs: DataFrame, by_similarity: bool = False) -> DataFrame:
    """One document of each group, with all columns: the smallest doc_id, null ids last.

    Groups are those of ``near_groups``; or with ``by_similarity`` those that links of a
    Jaccard similarity of 0.8 or more between sets of five-word shingles connect. Pairs to
    check come from BK-trees over the sets' fingerprints and, as pairs at 0.8 lie some ten
    bits apart, from MinHash bands; each is checked by the whole sets.

    Texts without words, null among them, are one group. A null doc_id comes last in its
    group. Of repeated rows one stays. An empty table stays empty, and columns of any name
    are carried along unchanged.
    """
    if by_similarity:
        return keep_rows(docs, _similar_kept(Steps(docs.sparkSession, "near", batch_rows=500, codec="zstd"), docs))
    key = fresh("row", docs.columns)
    steps = Steps(docs.sparkSession, "near", batch_rows=500)
    whole = steps.store(docs.withColumn(key, F.monotonically_increasing_id()), "documents")
    rows = _near(steps, _rows(whole, key))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    kept = steps.store(rows.groupBy("label").agg(F.min_by("row_id", order).alias(key)).select(key), "kept")
    return whole.join(kept, key, "left_semi").select(*docs.columns)
