"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, fresh, hot_rows, join_lookup, running_total, text_of, word_count

#: Weights of the sources in order of their names, repeating; null comes last.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix per word of the input, and how often one source may repeat.
SHARE, REPEATS = 1.5, 2
#: About so many words per block of the schedule.
BLOCK_WORDS = 1024
#: Fractional parts of 1/phi and of 2^20/phi, phi being the golden ratio.
STEP, LONG_STEP = 0.6180339887498949, 0.009037951210658105


def golden_point(n: Column) -> Column:
    """Fractional part of n/phi. In two parts, so that it stays exact to 2^-20 for n up to 2^52."""
    high, low = F.floor(n / 1048576).cast("double"), F.pmod(n, F.lit(1048576)).cast("double")
    point = (high * LONG_STEP) % 1.0 + (low * STEP) % 1.0
    return F.when(point >= 1.0, point - 1.0).otherwise(point)


def sized_rows(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, source, text_id (a hash of the text) and size (words) of every document."""
    text = text_of("text")
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", F.xxhash64(text).alias("text_id"), word_count(text).alias("size")
    )


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   repeats: int = REPEATS) -> DataFrame:
    """One row per source: its place ``sid``, rows, size, target, and interval [lo, hi) of the schedule.

    Targets fill up evenly by weight until a source reaches ``repeats`` times its size;
    what is over goes to the others. With sources in order of the level at which they
    are full, the level at which all is shared out is the largest of the levels that
    follow from taking each prefix as full. The windows meet one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    s = s.withColumn("sid", F.row_number().over(by_name) - 1)
    s = s.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.pmod("sid", F.lit(len(weights))) + 1))
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("_all", share * F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("_cap", (repeats * F.col("source_size")).cast("double")).withColumn("_full", F.col("_cap") / F.col("_w"))
    by_full = everything.orderBy("_full", "sid")
    capped = F.coalesce(F.sum("_cap").over(by_full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_w").over(by_full.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_level", (F.col("_all") - capped) / open_weight)
    s = s.withColumn("target", F.least("_cap", F.max("_level").over(everything) * F.col("_w")))
    s = s.withColumn("_sum", F.sum("target").over(everything))
    end = F.sum("target").over(everything.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("hi", F.when(F.col("_sum") > 0, end / F.col("_sum")).otherwise(0.0))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(everything.orderBy("sid")), F.lit(0.0)))
    return s.select("sid", "source", "n_rows", "source_size", "target", "lo", "hi")


def slots(spark, sources: DataFrame, n_slots: int, n_sources: int) -> DataFrame:
    """slot, sid and rank: the schedule. Slot n goes to the source whose interval holds golden point n.

    Intervals are looked up by equal cells of [0, 1). A source with a target but without
    a slot gets one after the others.
    """
    cells = 4 * max(n_sources, 1)
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    table = sources.where("hi > lo").select(
        "sid", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell")
    )
    table = table.withColumn("hi", F.when(F.col("hi") >= 1.0, F.lit(2.0)).otherwise(F.col("hi")))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id") + 1).alias("_u"))
    hit = points.withColumn("cell", cell(F.col("_u"))).join(table, "cell").where("lo <= _u AND _u < hi")
    return hit.select("slot", "sid")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
        block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mixed order, the documents it draws from, and the sources.

    Returns ``pieces`` (slot, place in the slot, row_id, epoch, start, words: slot after
    slot, words ``start`` to ``start + words`` of a document), ``rows`` (``sized_rows``)
    and ``sources`` (``source_targets``). Every source's documents, shuffled by digest
    anew for each epoch, form a stream that is cut into blocks of equal words, one for
    each of its slots, so that the blocks of a source end at its target.

    A null text has no words and is never taken; null sources are one source, last in
    order; a null doc_id is a document like others. Repeated rows are documents of their
    own. Documents without words, and an empty table, give no pieces.
    """
    spark = docs.sparkSession
    steps = Steps(spark, "mix")
    rows = steps.store(sized_rows(docs), "rows")
    sources = steps.store(source_targets(rows, weights, share, repeats), "sources")
    words, n_rows, n_sources = sources.agg(
        F.coalesce(F.sum("target"), F.lit(0.0)), F.coalesce(F.sum("n_rows"), F.lit(0)), F.count(F.lit(1))
    ).first()
    n_slots = -int(-words // block_words)
    plan = steps.store(slots(spark, sources, n_slots, n_sources), "slots")
    counts = plan.groupBy("sid").agg(F.count(F.lit(1)).alias("n_slots"))
    extra = sources.where("target >= 0.5").join(counts, "sid", "left_anti")
    extra = extra.select((F.lit(n_slots) + F.col("sid")).cast("long").alias("slot"), "sid")
    plan = plan.unionByName(extra)
    counts = steps.store(plan.groupBy("sid").agg(F.count(F.lit(1)).alias("n_slots")), "counts")
    hot_counts = hot_rows(counts, "n_slots", n_slots)
    ranked = join_lookup(plan.withColumn("_one", F.lit(1)), counts, ["sid"], hot_counts, F.col("slot"))
    ranked = running_total(ranked, ["sid"], ["slot"], F.col("slot") / (n_slots + n_sources + 1), F.col("n_slots"), "_one", "rank")

    lookup = sources.join(counts, "sid").select("source", "sid", "n_rows", "source_size", "target", "n_slots")
    lookup = steps.store(lookup.withColumn("_null", F.col("source").isNull()).fillna({"source": ""}), "lookup")
    known = rows.where("size > 0").withColumn("_null", F.col("source").isNull()).fillna({"source": ""})
    known = join_lookup(known, lookup, ["source", "_null"], hot_rows(lookup, "n_rows", n_rows), F.col("row_id"))
    known = known.where("sid IS NOT NULL").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    known = known.where(F.col("epoch") * F.col("source_size") < F.col("target"))
    digest = F.md5(F.concat_ws("/", "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    known = known.withColumn("_key", F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"))
    stream = running_total(known, ["sid", "epoch"], ["_key", "doc_id", "text_id", "row_id"], F.col("_key") / float(2**52), F.col("n_rows"), "size", "_at")
    stream = stream.withColumn("_a", F.col("epoch") * F.col("source_size") + F.col("_at"))
    stream = stream.withColumn("_b", F.col("_a") + F.col("size"))
    edge = lambda r: F.floor(F.col("target") * r / F.col("n_slots") + 0.5)
    near = lambda x: F.floor(F.col(x) * F.col("n_slots") / F.col("target"))
    first, last = F.greatest(near("_a") - 1, F.lit(0)), F.least(near("_b") + 1, F.col("n_slots") - 1)
    cut = stream.where(first <= last).withColumn("rank", F.explode(F.sequence(first, last)))
    cut = cut.withColumn("_from", F.greatest("_a", edge(F.col("rank")))).withColumn("_to", F.least("_b", edge(F.col("rank") + 1)))
    cut = cut.where("_to > _from").select(
        "sid", "rank", "row_id", "epoch", (F.col("_from") - F.col("_a")).alias("start"),
        (F.col("_to") - F.col("_from")).alias("words"), (F.col("_from") - edge(F.col("rank"))).alias("place"),
    )
    pieces = cut.join(ranked.select("sid", "rank", "slot"), ["sid", "rank"])
    return pieces.select("slot", "place", "row_id", "epoch", "start", "words"), rows, sources


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_slot and slot_words.

    ``taken`` counts the words that the mix takes, ``first_slot`` is the first slot of the
    schedule that they are in (null for none), ``slot_words`` the sum of their slots, a
    slot counting as often as it has words of the document. Nulls, ties and repeated rows
    as in ``mix``.
    """
    pieces, rows, sources = mix(docs, **options)
    slot_words = F.sum(F.col("slot") * F.col("words")).alias("slot_words")
    taken = pieces.groupBy("row_id").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), slot_words)
    n_rows = sources.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    named = lambda df: df.withColumn("_null", F.col("source").isNull()).fillna({"source": ""})
    lookup = named(sources).select("source", "_null", "n_rows", "source_size", "target")
    found = join_lookup(named(rows), lookup, ["source", "_null"], hot_rows(lookup, "n_rows", n_rows), F.col("row_id"))
    found = found.join(taken, "row_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("taken", "slot_words")]
    return found.select("doc_id", "size", "source_size", "target", zero[0], "first_slot", zero[1])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix in the order of its slots, with their columns, as often as the mix takes them.

    A copy stands where its first words are in the schedule; partitions are ranges of
    slots. Only the documents at the end of a source's last block are taken in part; such
    a part counts as a whole document from one half on.

    Nulls are handled as in ``mix``. Rows that agree in doc_id, text and source are dealt
    the places of these rows in the order of their other columns, so the result does not
    depend on how the input is split. An empty table stays empty; columns of any name are
    carried along unchanged.
    """
    spark = docs.sparkSession
    key = fresh("key", docs.columns)
    steps = Steps(spark, "mixed")
    pieces, rows, sources = mix(docs, **options)
    copies = pieces.groupBy("row_id", "epoch").agg(F.sum("words").alias("words"), F.min(F.struct("slot", "place")).alias("at"))
    copies = steps.store(copies, "epochs")
    n_slots = copies.agg(F.coalesce(F.max("at.slot") + 1, F.lit(1))).first()[0]
    same = ["doc_id", "text_id", "source"]
    named = lambda df: df.withColumn("doc_id", _named("doc_id")).withColumn("source", _named("source"))
    often = steps.store(named(rows).groupBy(*same).agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "often")
    copies = copies.join(rows, "row_id").where(F.col("words") * 2 >= F.col("size"))
    copies = steps.store(named(copies).select(*same, "row_id", "at.slot", "at.place"), "copies")
    names = {c: f"{key}_{c}" for c in (*same, "rank", "slot", "place")}
    whole = docs.select(
        "*", _named("doc_id").alias(names["doc_id"]), F.xxhash64(text_of("text")).alias(names["text_id"]), _named("source").alias(names["source"])
    )
    renamed = lambda df: df.select(*[F.col(c).alias(names[c]) for c in df.columns])
    keys = [names[c] for c in same]
    one = whole.join(renamed(copies.join(often, same, "left_anti").drop("row_id")), keys)
    repeated = whole.join(renamed(often.select(*same)), keys, "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    repeated = repeated.withColumn(names["rank"], F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    ranks = named(rows).join(often, same, "left_semi").select(*same, "row_id", F.row_number().over(Window.partitionBy(*same).orderBy("row_id")).alias("rank"))
    ranks = renamed(copies.join(ranks, [*same, "row_id"]).drop("row_id"))
    more = repeated.join(ranks, [*keys, names["rank"]])
    chosen = [*docs.columns, names["slot"], names["place"]]
    n_parts = max(1, min(n_slots, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    part = F.least(F.floor(F.col(names["slot"]) * n_parts / n_slots), F.lit(n_parts - 1)).cast("int")
    found = one.select(*chosen).unionByName(more.select(*chosen)).repartitionById(n_parts, part)
    return found.sortWithinPartitions(names["slot"], names["place"]).select(*docs.columns)


def _named(column: str) -> Column:
    """A column as text that tells a null from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


#: The same arithmetic in SQL.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM s0
), s2 AS (
  SELECT *, [3.0, 1.0, 2.0][sid % 3 + 1]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s1
), s3 AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2
), s4 AS (
  SELECT *, least(cap, max(level) OVER () * w) AS target FROM s3
), s5 AS (
  SELECT *, sum(target) OVER (ORDER BY sid) / sum(target) OVER () AS hi FROM s4
), s6 AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0) AS lo FROM s5
), n AS (
  SELECT ceil(sum(target) / 1024)::BIGINT AS n FROM s6
), p0 AS (
  SELECT i AS slot, (i + 1) // 1048576 AS high, (i + 1) % 1048576 AS low FROM range((SELECT n FROM n)) r(i)
), p AS (
  SELECT slot, (high * 0.009037951210658105::DOUBLE) % 1.0::DOUBLE + (low * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS u FROM p0
), hit AS (
  SELECT slot, sid FROM p JOIN s6 ON lo <= CASE WHEN u >= 1 THEN u - 1 ELSE u END
    AND CASE WHEN u >= 1 THEN u - 1 ELSE u END < CASE WHEN hi >= 1 THEN 2 ELSE hi END
), c AS (
  SELECT sid, count(*) AS c FROM hit GROUP BY sid
), s AS (
  SELECT s6.*, coalesce(c, 1) AS c FROM s6 LEFT JOIN c USING (sid) WHERE target >= 0.5
), ranked AS (
  SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank
  FROM (SELECT slot, sid FROM hit UNION ALL SELECT (SELECT n FROM n) + sid, sid FROM s WHERE sid NOT IN (SELECT sid FROM c))
), block AS (
  SELECT sid, slot, floor(target * rank / c + 0.5) AS lo, floor(target * (rank + 1) / c + 0.5) AS hi FROM ranked JOIN s USING (sid)
), e AS (
  SELECT doc_id, sid, size, epoch, target, source_size,
         ('0x' || substr(md5(concat_ws('/', epoch, doc_id)), 1, 13))::BIGINT AS key
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, range(2) r(epoch)
  WHERE size > 0 AND epoch * source_size < target
), laid AS (
  SELECT *, epoch * source_size
         + coalesce(sum(size) OVER (PARTITION BY sid, epoch ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM e
), piece AS (
  SELECT doc_id, slot, (least(a + size, hi) - greatest(a, lo))::BIGINT AS words
  FROM laid JOIN block ON laid.sid = block.sid AND lo < a + size AND hi > a
), taken AS (
  SELECT doc_id, sum(words)::BIGINT AS taken, min(slot) AS first_slot, sum(slot * words)::BIGINT AS slot_words FROM piece GROUP BY doc_id
)
SELECT d.doc_id, d.size, s6.source_size, s6.target, coalesce(taken, 0) AS taken, first_slot, coalesce(slot_words, 0) AS slot_words
FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source LEFT JOIN taken USING (doc_id)
"""
