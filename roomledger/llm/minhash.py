"""Near-duplicates by MinHash: bands of universal-hash minima, signatures, whole sets, large-star and small-star."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, hot_rows, join_lookup, text_of

#: Words of a shingle.
WORDS = 5
#: Members of a star that meet their centre in one task, and sketches of each side that meet in one tree.
STAR, TREE = 512, 2048
#: Pairs that are compared at once inside a task.
PAIRS = 1 << 16
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29))


@dataclass(frozen=True)
class Scheme:
    """Minima of ``bands * values`` universal hashes; sets are linked from ``percent`` of Jaccard similarity on.

    Two sets share a band with odds 1 - (1 - J ** values) ** bands: at 85 percent 32 bands
    of 5 miss one pair in 130 million, at 80 percent one in 300,000. Signatures keep a byte
    of each minimum; a pair goes on to the whole sets unless it lies ``margin`` standard
    deviations below the similarity asked for.
    """

    percent: int = 85
    bands: int = 32
    values: int = 5
    margin: float = 5.0
    seed: int = 42

    @property
    def size(self) -> int:
        return self.bands * self.values

    @cached_property
    def turns(self) -> np.ndarray:
        """Factors (odd) and summands of the universal hashes a x + b mod 2^32."""
        turns = np.random.default_rng(self.seed).integers(0, 1 << 32, (2, self.size), np.uint32)
        turns[0] |= np.uint32(1)
        return turns

    @property
    def least_agreeing(self) -> float:
        """Values of two signatures that must agree; bytes agree by chance once in 256."""
        j = self.percent / 100
        part = j - self.margin * (j * (1 - j) / self.size) ** 0.5
        return self.size * (part + (1 - part) / 256)


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (h ^ w) * _MIX[0]
    return (h ^ (h >> _MIX[2])) * _MIX[1]


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of a text.

    A-Z in lower case; words are runs without space and the controls 9 to 13; fewer words
    form one shingle; no words give no shingle.
    """
    raw = text.encode().lower().split()
    if not raw:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
    width = min(words, len(raw))
    n = len(raw) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = _mixed(h, each[i : i + n])
    return np.unique(h)


def minima(hashes: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The least value of each universal hash over a set that is not empty."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    factor, summand = scheme.turns
    least = np.full(scheme.size, ~np.uint32(0))
    for at in range(0, len(x), 512):
        np.minimum(least, (x[at : at + 512, None] * factor + summand).min(0), out=least)
    return least


def _sketches(batches: Iterator[pa.RecordBatch], scheme: Scheme, also: Callable[[np.ndarray], int] | None) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_id", "node", "n", "sim", "bands", "signature"]
    for batch in batches:
        n = batch.num_rows
        node, size, sim = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        least = np.zeros((n, scheme.size), np.uint32)
        for i, text in enumerate(batch.column(2)):
            hashes = shingle_set(text.as_py())
            size[i] = len(hashes)
            if len(hashes):
                node[i] = np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64)
                least[i] = minima(hashes, scheme)
                sim[i] = also(hashes) if also else 0
        keys = np.tile(np.arange(scheme.bands, dtype=np.uint64), (n, 1))
        values = least.reshape(n, scheme.bands, scheme.values).astype(np.uint64)
        for v in range(scheme.values):
            keys = _mixed(keys, values[:, :, v])
        ends = np.arange(n + 1, dtype=np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends * scheme.bands), pa.array(keys.view(np.int64).ravel()))
        offsets, bytes_ = pa.py_buffer((ends * scheme.size).tobytes()), pa.py_buffer(least.astype(np.uint8).tobytes())
        signature = pa.Array.from_buffers(pa.binary(), n, [None, offsets, bytes_])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array(size), pa.array(sim), bands, signature], names)


def sketch_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (a hash of the text) and text of every document, an empty text for null."""
    text = text_of("text")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_id"), text.alias("text"))


def sketches(steps: Steps, docs: DataFrame, scheme: Scheme, also: Callable[[np.ndarray], int] | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc_id, text_id, node, n) and ``sets`` (node, n_rows, doc_id, text_id, n, sim, bands, signature).

    A node is a set of shingles; ``sets`` has each that is not empty once, with the
    smallest (doc_id, text_id) that has it. ``also`` makes ``sim`` out of a set's hashes.
    """
    schema = "doc_id long, text_id long, node long, n long, sim long, bands array<long>, signature binary"
    found = steps.store(sketch_rows(docs).mapInArrow(partial(_sketches, scheme=scheme, also=also), schema), "sketches")
    same = [F.first(c).alias(c) for c in ("n", "sim", "bands", "signature")]
    place = F.min(F.struct("doc_id", "text_id")).alias("_place")
    sets = found.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("n_rows"), place, *same)
    sets = steps.store(sets.select("node", "n_rows", "_place.doc_id", "_place.text_id", "n", "sim", "bands", "signature"), "sets")
    rows = steps.store(found.select("doc_id", "text_id", "node", "n"), "rows")
    steps.drop("sketches")
    return rows, sets


def _agreeing(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Which rows of two signature tables may belong to sets that are similar enough."""
    fits = 100 * np.minimum(size_a, size_b) >= scheme.percent * np.maximum(size_a, size_b)
    return fits & ((a == b).sum(1) >= scheme.least_agreeing)


def _table(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _plausible(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """Rows (node, centre, n, signature, n of the centre, signature of the centre) that may be similar."""
    for batch in batches:
        size_a, size_b = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        fit = _agreeing(_table(batch.column(3), scheme.size), _table(batch.column(5), scheme.size), size_a, size_b, scheme)
        yield batch.select([0, 1]).filter(pa.array(fit))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 times the common hashes of two sorted sets reach ``percent`` times those of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _star_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (centre, shard, node, text) that come sorted, each centre before its members."""
    at, last, centre, hashes = None, None, None, None
    for batch in batches:
        a, b = [], []
        keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        for (star, shard, node), text in zip(keys, batch.column(3), strict=True):
            if (star, shard) != at:
                at, last, centre, hashes = (star, shard), node, star, shingle_set(text.as_py())
                if node != star:
                    raise ValueError("a star without its centre")
            elif node != last:
                last = node
                if similar(hashes, shingle_set(text.as_py()), percent):
                    a.append(node)
                    b.append(centre)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def with_texts(trees: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """``trees`` (node, ...) with the text of the node; a text that is in ``docs`` twice comes twice."""
    places = sets.select("node", F.col("doc_id").alias("_doc"), F.col("text_id").alias("_text"))
    rows = sketch_rows(docs)
    here = (rows["text_id"] == F.col("_text")) & rows["doc_id"].eqNullSafe(F.col("_doc"))
    return trees.join(places, "node").join(rows, here).select(*trees.columns, "text")


def star_links(steps: Steps, pairs: DataFrame, sets: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Links among pairs (node, centre): checked by signatures, then by the sets of the whole texts.

    Pairs of one centre are dealt over tasks of about ``STAR`` members, and the text of
    the centre goes to each; a task holds two sets at a time.
    """
    counts = steps.store(pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("c")), "star-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    one = pairs.join(sets.select("node", "n", "signature"), "node")
    named = sets.select(F.col("node").alias("centre"), F.col("n").alias("n_c"), F.col("signature").alias("signature_c"))
    hot = named.join(F.broadcast(hot_rows(counts, "c", total).select("centre")), "centre", "left_semi")  # 1,024 signatures at most
    both = join_lookup(one, named, ["centre"], hot, F.col("node")).select("node", "centre", "n", "signature", "n_c", "signature_c")
    fit = steps.store(both.mapInArrow(partial(_plausible, scheme=scheme), "node long, centre long"), "star-pairs")
    shards = counts.select("centre", F.ceil(F.col("c") / STAR).cast("int").alias("shards"))
    hot = hot_rows(counts, "c", total).select("centre", F.ceil(F.col("c") / STAR).cast("int").alias("shards"))
    dealt = join_lookup(fit, shards, ["centre"], hot, F.col("node"))
    members = dealt.select("centre", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int").alias("shard"), "node")
    trees = members.unionByName(members.select("centre", "shard", F.col("centre").alias("node")).distinct())
    rows = with_texts(trees, sets, docs).repartition("centre", "shard")
    rows = rows.sortWithinPartitions("centre", "shard", F.col("node") != F.col("centre"), "node").select("centre", "shard", "node", "text")
    found = rows.mapInArrow(partial(_star_links, percent=scheme.percent), "a long, b long")
    return steps.store(found, "star-links")


class _Trees:
    """Whole trees out of Arrow batches that come sorted by their first column."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches = batches

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in self.batches:
            tree = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(tree[1:] != tree[:-1]) + 1).tolist(), len(tree)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and held[-1].column(0)[-1] != batch.column(0)[i]:
                    yield pa.concat_batches(held)
                    held = []
                if j > i:
                    held.append(batch.slice(i, j - i))
        if held:
            yield pa.concat_batches(held)


def _in_first_band(a: np.ndarray, b: np.ndarray, band: int, scheme: Scheme) -> np.ndarray:
    """Whether two signatures agree in no band before this one, so that a pair is met once."""
    shape = (len(a), scheme.bands, scheme.values)
    return ~(a.reshape(shape) == b.reshape(shape))[:, :band].all(2).any(1)


def _candidates(tree: pa.RecordBatch, scheme: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in a tree (tree, band, node, part, n, signature): other parts, plausible, in their first band."""
    part, size = tree.column(3).to_numpy(), tree.column(4).to_numpy()
    band, m = tree.column(1)[0].as_py(), tree.num_rows
    signature = _table(tree.column(5), scheme.size)
    for at in range(0, m, max(1, PAIRS // m)):
        here = np.arange(at, min(m, at + max(1, PAIRS // m)))
        fits = (part[here, None] != part[None, :]) & (here[:, None] < np.arange(m)[None, :])
        fits &= 100 * np.minimum(size[here, None], size) >= scheme.percent * np.maximum(size[here, None], size)
        i, j = np.nonzero(fits)
        i = here[i]
        good = _agreeing(signature[i], signature[j], size[i], size[j], scheme)
        i, j = i[good], j[good]
        good = _in_first_band(signature[i], signature[j], band, scheme)
        if good.any():
            yield i[good], j[good]


def _open_members(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """The rows of each tree that are in a candidate pair; no pairs leave the task."""
    for tree in _Trees(batches):
        used = np.zeros(tree.num_rows, bool)
        for i, j in _candidates(tree, scheme):
            used[i] = used[j] = True
        if used.any():
            yield tree.filter(pa.array(used))


class _Tree:
    """The sets of one tree that have come so far, by size; those too small for the next are let go."""

    def __init__(self, scheme: Scheme):
        self.scheme, self.low, self.n = scheme, 0, 0
        self.nodes: list[int] = []
        self.sets: list[np.ndarray | None] = []
        #: The label of each part, which changes as links join parts.
        self.labels: dict[int, int] = {}
        self.sizes, self.label = np.zeros(64, np.int64), np.zeros(64, np.int64)
        self.signatures = np.zeros((64, scheme.size), np.uint8)

    def add(self, band: int, node: int, part: int, n: int, signature: bytes, text: pa.Scalar) -> Iterator[tuple[int, int]]:
        """Links of a set with earlier ones, one at most for each part that it joins with its own."""
        if self.nodes and self.nodes[-1] == node:
            return
        if self.n == len(self.sizes):
            self.sizes, self.label = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.label))
            self.signatures = np.concatenate([self.signatures, np.zeros_like(self.signatures)])
        i, self.n = self.n, self.n + 1
        self.nodes.append(node)
        self.sets.append(shingle_set(text.as_py()))
        self.sizes[i], self.label[i] = n, self.labels.setdefault(part, part)
        self.signatures[i] = np.frombuffer(signature, np.uint8)
        while 100 * self.sizes[self.low] < self.scheme.percent * n:
            self.sets[self.low] = None
            self.low += 1
        near = self.low + np.flatnonzero(self.label[self.low : i] != self.label[i])
        if not len(near):
            return
        own = np.broadcast_to(self.signatures[i], (len(near), self.scheme.size))
        near = near[_agreeing(own, self.signatures[near], np.full(len(near), n), self.sizes[near], self.scheme)]
        near = near[_in_first_band(self.signatures[near], own[: len(near)], band, self.scheme)]
        for j in near.tolist():
            if self.label[j] != self.label[i] and similar(self.sets[i], self.sets[j], self.scheme.percent):
                yield node, self.nodes[j]
                old, now = self.label[j], self.label[i]
                self.label[: self.n][self.label[: self.n] == old] = now
                self.labels = {p: now if x == old else x for p, x in self.labels.items()}


def _tree_links(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """A spanning set of links between the parts of each tree (tree, band, node, part, n, signature, text).

    Rows come by tree and size. A set is compared with those before it that are not too
    small, so a task holds the sets of one range of sizes.
    """
    at, tree = None, _Tree(scheme)
    for batch in batches:
        links: list[tuple[int, int]] = []
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for (number, *row), text in zip(zip(*columns, strict=True), batch.column(6), strict=True):
            if number != at:
                at, tree = number, _Tree(scheme)
            links.extend(tree.add(*row, text))
        a, b = (pa.array([x[i] for x in links], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])


def open_links(steps: Steps, band_rows: DataFrame, parts: DataFrame, sets: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Links between different parts (components so far) whose sets share a band.

    Only bands with two parts or more go on. Of a band, the largest part's rows and the
    others' are cut into shards of about ``TREE``; a tree is one shard of the others with
    one shard of either kind, so with few others no row of the largest part is repeated.
    First the sketches of a tree meet, and tell which rows may have a link; then the texts
    of those meet, and the task keeps only links that join two parts.
    """
    labelled = band_rows.join(parts, "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("part"))
    labelled = steps.store(labelled, "labelled")
    sizes = labelled.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("key")
    sizes = sizes.agg(F.max(F.struct("c", "part")).alias("_top"), F.sum("c").alias("m"), F.count(F.lit(1)).alias("n_parts"))
    shards = lambda c: F.ceil(c / TREE).cast("int")
    sizes = sizes.where("n_parts > 1").select(
        "key", "m", F.col("_top.part").alias("main"), shards(F.col("_top.c")).alias("s_main"), shards(F.col("m") - F.col("_top.c")).alias("s_rest")
    )
    sizes = steps.store(sizes, "open-keys")
    total = sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    # All rows of the bands that are not open fall out here; the hot keys are those of the rest.
    cut = join_lookup(labelled, sizes, ["key"], hot_rows(sizes, "m", total), F.col("node")).where("main IS NOT NULL")
    spread = F.xxhash64("node")
    rest = F.pmod(spread, F.col("s_rest")).cast("int")
    main = F.pmod(spread, F.col("s_main")).cast("int")
    up_to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    with_main = F.transform(up_to("s_main"), lambda j: F.xxhash64("key", F.lit(0), rest, j))
    others = F.filter(up_to("s_rest"), lambda i: i != rest)
    with_rest = F.transform(others, lambda i: F.xxhash64("key", F.lit(1), F.least(i, rest), F.greatest(i, rest)))
    of_main = F.transform(up_to("s_rest"), lambda i: F.xxhash64("key", F.lit(0), i, main))
    trees = F.when(F.col("part") == F.col("main"), of_main).otherwise(F.concat(with_main, with_rest))
    cut = cut.select(F.explode(trees).alias("tree"), "band", "node", "part").join(sets.select("node", "n", "signature"), "node")
    schema = "tree long, band int, node long, part long, n long, signature binary"
    met = cut.select("tree", "band", "node", "part", "n", "signature").repartition("tree").sortWithinPartitions("tree", "node")
    members = steps.store(met.mapInArrow(partial(_open_members, scheme=scheme), schema), "open-members")
    rows = with_texts(members, sets, docs).repartition("tree").sortWithinPartitions("tree", "n", "node")
    return steps.store(rows.mapInArrow(partial(_tree_links, scheme=scheme), "a long, b long"), "open-links")


def star_edges(steps: Steps, links: DataFrame, name: str, rounds: int | None = None) -> DataFrame:
    """Edges (u, v), v < u, that connect what the links (a, b) connect; without ``rounds``, one star per component.

    Large-star: each node's larger neighbours go to the smallest node around it.
    Small-star: each node and its smaller neighbours go to the smallest of them. Both
    alternate until no edge changes; then every component is one star. Minima are combined
    before the shuffle, and nodes with very many links are looked up by broadcast.
    """

    def to_least(edges: DataFrame, total: int) -> DataFrame:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        least = least.withColumn("m", F.least("m", "u"))
        return join_lookup(edges, least.drop("c"), ["u"], hot_rows(least, "c", total).drop("c"), F.col("v"))

    step, before = 0, None
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        edges = steps.store(edges, f"{name}-{step}")
        if step:
            steps.drop(f"{name}-{step - 1}")
        if step == rounds:
            return edges
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return edges
        step, before, total = step + 1, now, now[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = to_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = to_least(large, total)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = small.select("e.u", "e.v").where("u <> v").distinct()


def star_components(steps: Steps, links: DataFrame, name: str = "components") -> DataFrame:
    """node and label (the smallest node that is connected) for every node of the links (a, b)."""
    found = star_edges(steps, links, name).select(F.col("u").alias("node"), F.col("v").alias("label"))
    return found.unionByName(found.select(F.col("label").alias("node"), "label").distinct())


def similar_groups(steps: Steps, docs: DataFrame, sets: DataFrame, scheme: Scheme, extra: DataFrame | None = None) -> DataFrame:
    """node and label: sets that links connect share a label; sets without a link are left out.

    Every band value names the one of its sets that comes first by hash as centre, and
    all others are checked against it. Where a band still has sets of different components,
    those are compared across components. ``extra`` are more pairs (node, centre) to check.
    """
    keyed = sets.select("node", F.posexplode("bands").alias("band", "key"))
    first = F.min(F.struct(F.xxhash64("node").alias("o"), "node")).alias("_first")
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), first).where("m > 1")
    groups = steps.store(groups.select("key", "m", F.col("_first.node").alias("centre")), "groups")
    total = groups.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    band_rows = join_lookup(keyed, groups, ["key"], hot_rows(groups, "m", total), F.col("node")).where("centre IS NOT NULL")
    band_rows = steps.store(band_rows.select("key", "band", "node", "centre"), "band-rows")
    pairs = band_rows.where("node <> centre").select("node", "centre")
    if extra is not None:
        pairs = pairs.unionByName(extra)
    pairs = steps.store(pairs.distinct(), "pairs")
    links = star_links(steps, pairs, sets, docs, scheme)
    steps.drop("pairs", "star-pairs", "star-counts")
    # After two rounds nearly all stars are whole; sets that still lie apart are compared, and cost time only.
    edges = star_edges(steps, links, "stars", rounds=2)
    parts = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    more = open_links(steps, band_rows, parts, sets, docs, scheme)
    steps.drop("band-rows", "labelled", "open-members", "star-links")
    known = edges.select(F.col("u").alias("a"), F.col("v").alias("b"))
    return steps.store(star_components(steps, known.unionByName(more), "all"), "node-labels")


def labelled_rows(steps: Steps, rows: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """doc_id, text_id, n and label of every row; the label of an empty set is null."""
    named = sets.select("node", "n_rows").join(groups, "node", "left")
    named = steps.store(named.select("node", "n_rows", F.coalesce("label", "node").alias("label")), "names")
    total = named.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    filled = rows.where("n > 0")
    found = join_lookup(filled, named.select("node", "label"), ["node"], hot_rows(named, "n_rows", total).select("node", "label"), F.struct("doc_id", "text_id"))
    empty = rows.where("n = 0").withColumn("label", F.lit(None).cast("long"))
    return steps.store(found.unionByName(empty).select("doc_id", "text_id", "n", "label"), "row-labels")


def similar_documents(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Links are at least ``scheme.percent`` of Jaccard similarity between sets of five-word
    shingles; component_id is the smallest doc_id that links reach. A null text, or one
    without words, is linked with nothing. A null doc_id belongs to its group but names
    none: a group of null ids alone has a null component_id, and its rows are not kept.
    Repeated rows are documents of their own; an empty table gives no rows. Other columns
    are not read.
    """
    steps = Steps(docs.sparkSession, "minhash", batch_rows=500)
    rows, sets = sketches(steps, docs, scheme)
    groups = similar_groups(steps, docs, sets, scheme)
    found = labelled_rows(steps, rows, sets, groups)
    first = found.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("c"))
    first = steps.store(first, "first")
    total = first.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    hot = hot_rows(first, "c", total).drop("c")
    joined = join_lookup(found, first.drop("c"), ["label"], hot, F.struct("doc_id", "text_id"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    joined = joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


#: All pairs that share a shingle, and all that links reach.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS h
  FROM d, unnest(range(1, greatest(1, len(w) - 4) + 1)) t(i) WHERE len(w) > 0
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), first AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, first.component_id, d.doc_id = first.component_id AS kept
FROM d JOIN first ON first.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
