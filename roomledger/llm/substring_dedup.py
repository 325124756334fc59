"""Removal of passages that an earlier document has: suffix automata of reference documents.

1. ``shared_windows`` finds which documents can share a window at all, by hashes: each
   window goes to the smallest hash of the word runs inside it, so equal windows meet in
   one task, and only hashes are shuffled. Windows of a hot run go on by their own hash.
2. ``verified_spans`` sends each suspected stretch to the earlier document it was seen in.
   That document's suffix automaton decides word by word: matching statistics of the
   stretch give the maximal spans that really occur in it.
3. ``remove_repeats`` takes the spans out of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, join_counted, text_of

WINDOW = 13
#: Words of the runs that windows are dealt by.
RUN = 5
#: Stretches that one copy of a reference automaton serves, about.
SERVED = 512
#: Documents that hot dealing hashes are counted in, about, and the stretches there that make one hot: those of a
#: run that is left hold about HOT / SAMPLED of the documents, or few more.
SAMPLED, HOT = 20_000, 20
_MIX, _RUN_BASE, _WINDOW_BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 1_000_000:
            self[word] = value
        return value


_HASHES = _WordHashes()


def _rolling(words: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = len(words) - width + 1
    found = np.zeros(n, np.uint64)
    for i in range(width):
        found = found * base + words[i : i + n]
    found ^= found >> np.uint64(29)
    found *= _MIX
    return found ^ (found >> np.uint64(32))


def _windows(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the texts: number of the text, start, hash it is dealt by, own hash."""
    split = [t.encode().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    n = int(sizes.sum())
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))  # type: ignore[return-value]
    words = np.fromiter((h for w in split for h in map(_HASHES.__getitem__, w)), np.uint64, n)
    run = min(RUN, width)
    runs, own = _rolling(words, run, _RUN_BASE), _rolling(words, width, _WINDOW_BASE)
    dealt = runs[: len(own)].copy()
    for i in range(1, width - run + 1):
        np.minimum(dealt, runs[i : i + len(own)], out=dealt)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(own)]
    start = np.arange(len(own)) - (ends - sizes)[text]
    inside = start + width <= sizes[text]
    return text[inside], start[inside], dealt[inside], own[inside]


def _earlier(group: np.ndarray, own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window, the smallest doc that has an equal one (group and own hash)."""
    order = np.lexsort((doc, own, group))
    first = np.ones(len(own), bool)
    first[1:] = (own[order][1:] != own[order][:-1]) | (group[order][1:] != group[order][:-1])
    found = np.empty(len(own), np.int64)
    found[order] = doc[order][np.flatnonzero(first)][np.cumsum(first) - 1]
    return found


def _breaks(*columns: np.ndarray) -> np.ndarray:
    """Starts of the stretches in which no column changes; the last column must grow by one."""
    n = len(columns[0])
    new = np.ones(n, bool)
    new[1:] = columns[-1][1:] != columns[-1][:-1] + 1
    for c in columns[:-1]:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_DEALT = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("first", pa.int64()), ("own", pa.binary())])
_SUSPECTS = "doc long, start int, n int, first long"


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Dealing hash of each stretch of windows that share it."""
    for batch in batches:
        text, start, dealt, _ = _windows(batch.column(1).to_pylist(), width)
        at = _breaks(text, dealt, start) if len(text) else text
        yield pa.RecordBatch.from_arrays([pa.array(dealt[at].view(np.int64))], ["h"])


def hot_runs(rows: DataFrame, width: int = WINDOW) -> np.ndarray:
    """Dealing hashes with many stretches, in order, counted in a sample. They steer only where windows meet."""
    every = max(1, rows.count() // SAMPLED)
    sample = rows.where(F.pmod(F.xxhash64("doc"), F.lit(every)) == 0)
    counts = sample.mapInArrow(partial(_runs, width=width), "h long").groupBy("h").count().where(F.col("count") >= HOT)
    return np.sort(np.array([r["h"] for r in counts.select("h").collect()], np.int64).view(np.uint64))


def _deal(batches: Iterator[pa.RecordBatch], width: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stretches of windows with one dealing hash, and stretches that already repeat an earlier
    document of the same batch (``first`` is set): a text that fills a batch leaves it once.
    Windows with a hot dealing hash get another one, made of it and their own."""
    for batch in batches:
        docs = batch.column(0).to_numpy()
        text, start, dealt, own = _windows(batch.column(1).to_pylist(), width)
        if not len(text):
            continue
        if len(hot):
            spread = hot[np.minimum(np.searchsorted(hot, dealt), len(hot) - 1)] == dealt
            dealt[spread] ^= own[spread] * _MIX
        doc = docs[text]
        first = _earlier(dealt, own, doc)
        here, away = np.flatnonzero(first < doc), np.flatnonzero(first == doc)
        at = _breaks(text[here], first[here], start[here]) if len(here) else here
        sizes = np.diff(np.append(at, len(here)))
        at = here[at]
        none = pa.array([b""] * len(at), pa.binary())
        spread = (doc[at].astype(np.uint64) * _MIX).view(np.int64)
        arrays = [spread, doc[at], start[at].astype(np.int32), sizes.astype(np.int32), first[at]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), none], schema=_DEALT)
        if not len(away):
            continue
        at = _breaks(text[away], dealt[away], start[away])
        ends = np.append(at, len(away))
        blob = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer((8 * ends).tobytes()), pa.py_buffer(own[away].tobytes())])
        blob = blob.cast(pa.binary())
        sizes = np.diff(ends)
        at = away[at]
        arrays = [dealt[at].view(np.int64), doc[at], start[at].astype(np.int32), sizes.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.nulls(len(at), pa.int64()), blob], schema=_DEALT)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suspects of rows that come sorted by ``h``: windows with an equal hash in a smaller doc."""
    names = ["doc", "start", "n", "first"]

    def found(table: pa.Table) -> pa.RecordBatch:
        h, doc, start, n = (table.column(c).to_numpy() for c in ("h", "doc", "start", "n"))
        group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
        several = np.flatnonzero(np.bincount(group)[group] > 1)
        blobs = table.column("own").combine_chunks().take(pa.array(several))
        own = np.frombuffer(b"".join(blobs.to_pylist()), np.uint64)
        row = np.repeat(np.arange(len(several)), n[several])
        place = np.arange(len(row)) - np.repeat(np.cumsum(n[several]) - n[several], n[several])
        docs, starts = doc[several][row], start[several][row] + place
        first = _earlier(group[several][row], own, docs) if len(own) else docs
        late = np.flatnonzero(first < docs)
        at = _breaks(row[late], first[late], starts[late]) if len(late) else late
        sizes = np.diff(np.append(at, len(late)))
        at = late[at]
        arrays = [docs[at], starts[at].astype(np.int32), sizes.astype(np.int32), first[at]]
        return pa.RecordBatch.from_arrays([*map(pa.array, arrays)], names)

    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        known = pc.is_valid(table.column("first"))
        done = table.filter(known)
        if done.num_rows:
            yield done.select(names).combine_chunks().to_batches()[0]
        table = table.filter(pc.invert(known))
        if not table.num_rows:
            continue
        held.append(table)
        if sum(t.num_rows for t in held) >= 100_000:
            table = pa.concat_tables(held)
            h = table.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1]))
            if whole:
                yield found(table.slice(0, whole))
            held = [table.slice(whole)]
    if held and sum(t.num_rows for t in held):
        yield found(pa.concat_tables(held))


def shared_windows(rows: DataFrame, width: int = WINDOW) -> DataFrame:
    """Suspects (doc, start, n, first): n windows from ``start`` on whose hashes ``first`` has too, first < doc."""
    dealt = rows.mapInArrow(partial(_deal, width=width, hot=hot_runs(rows, width)), "h long, doc long, start int, n int, first long, own binary")
    dealt = dealt.repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(_meet, _SUSPECTS)


class SuffixAutomaton:
    """All word runs of one or more texts."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _copy(self, p: int, word: bytes, q: int) -> int:
        """Split off the runs of q that end a walk from p, so that they have a state of their own."""
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nexts[p].get(word) == q:
            nexts[p][word] = copy
            p = link[p]
        return copy

    def add(self, words: list[bytes]) -> None:
        """Add a text, word after word, from the empty run on."""
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for word in words:
            q = nexts[last].get(word)
            if q is not None:  # an earlier text, or this one, has the run already
                last = q if length[q] == length[last] + 1 else self._copy(last, word, q)
                continue
            state = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and word not in nexts[p]:
                nexts[p][word] = state
                p = link[p]
            if p >= 0:
                q = nexts[p][word]
                link[state] = q if length[q] == length[p] + 1 else self._copy(p, word, q)
            last = state

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal spans [start, end) covered by runs of at least ``least`` words that occur here."""
        nexts, link, length = self.next, self.link, self.length
        found: list[tuple[int, int]] = []
        state = matched = 0
        for i, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            state = nexts[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= least:
                if found and found[-1][1] >= i + 1 - matched:
                    found[-1] = (min(found[-1][0], i + 1 - matched), i + 1)
                else:
                    found.append((i + 1 - matched, i + 1))
        return found


_STRETCHES = "ref long, copy int, doc long, version long, start int, words binary"


def _stretches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Reference texts (doc is null), once per copy, and suspected stretches of words."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]

        def add(*row, out=out) -> None:
            for values, value in zip(out, row, strict=True):
                values.append(value)

        for doc, version, text, copies, suspects in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.encode().split()
            for copy in range(copies or 0):
                add(doc, copy, None, None, None, b" ".join(words))
            suspects = sorted((s["first"], s["start"], s["n"], s["copies"]) for s in suspects or [])
            i = 0
            while i < len(suspects):
                first, start, n, dealt = suspects[i]
                end = start + n
                i += 1
                while i < len(suspects) and suspects[i][0] == first and suspects[i][1] <= end:
                    end = max(end, suspects[i][1] + suspects[i][2])
                    i += 1
                if start < len(words):
                    copy = xxhash.xxh32_intdigest(f"{doc}/{start}") % max(1, dealt)
                    add(first, copy, doc, version, start, b" ".join(words[start : end + width - 1]))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = ["ref", "copy", "doc", "version", "start", "words"]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)


def _verify(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Spans of stretches that the automaton of their reference has; references come first."""
    current, automaton = None, SuffixAutomaton()
    for batch in batches:
        out: list[list] = [[], [], [], []]
        refs, copies, docs, versions, starts, _ = (c.to_pylist() for c in batch.columns)
        for i, words in enumerate(batch.column(5)):
            if current != (refs[i], copies[i]):
                current, automaton = (refs[i], copies[i]), SuffixAutomaton()
            split = words.as_py().split()
            if docs[i] is None:
                automaton.add(split)
                continue
            for a, b in automaton.spans(split, width):
                for values, value in zip(out, (docs[i], versions[i], starts[i] + a, starts[i] + b), strict=True):
                    values.append(value)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["doc", "version", "start", "end"])


def verified_spans(steps: Steps, rows: DataFrame, suspects: DataFrame, width: int = WINDOW) -> DataFrame:
    """Spans (doc, version, start, end) of words that occur in a document with a smaller id.

    A reference with many stretches is copied, one copy for about ``SERVED`` of them.
    """
    refs = suspects.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / SERVED).cast("int").alias("copies"))
    refs = steps.store(refs, "references")
    dealt = join_counted(suspects, refs, "first", F.xxhash64("doc", "start"))
    lists = dealt.groupBy("doc").agg(F.collect_list(F.struct("first", "start", "n", "copies")).alias("suspects"))
    wanted = lists.join(refs.withColumnRenamed("first", "doc"), "doc", "full")
    wanted = rows.join(steps.store(wanted, "wanted"), "doc").select("doc", "version", "text", "copies", "suspects")
    sent = wanted.mapInArrow(partial(_stretches, width=width), _STRETCHES)
    sent = sent.repartition("ref", "copy").sortWithinPartitions("ref", "copy", F.col("doc").asc_nulls_first())
    return sent.mapInArrow(partial(_verify, width=width), "doc long, version long, start int, end int")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept, cut = [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            words = text.as_py().encode().split()
            merged: list[list[int]] = []
            for a, b in sorted((s["start"], s["end"]) for s in spans or []):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            n_words.append(len(words))
            n_removed.append(sum(b - a for a, b in merged))
            for a, b in reversed(merged):
                del words[a:b]
            kept.append(b" ".join(words).decode())
            cut.append([{"start": a, "end": b} for a, b in merged])
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(cut, spans_type)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_text", "removed"])


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and removed (word spans) of every document.

    Words are runs without space and the controls 9 to 13. A word goes if a window of
    ``width`` words over it also starts in a document with a smaller doc_id; kept words are
    joined by one space. A null text has no words. A null doc_id is neither smaller nor
    larger than others: such a document loses nothing and takes nothing from others. Rows
    that share a doc_id are documents of equal rank and do not take from each other.
    """
    steps = Steps(docs.sparkSession, "repeats")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text_of("text").alias("text"))
    known = rows.where("doc IS NOT NULL")
    suspects = steps.store(shared_windows(known, width), "suspects")
    versions = known.withColumn("version", F.xxhash64("text"))
    spans = steps.store(verified_spans(steps, versions, suspects, width), "spans")
    lists = spans.groupBy("doc", "version").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    lists = steps.store(lists, "lists")
    found = rows.withColumn("version", F.xxhash64("text")).join(lists, ["doc", "version"], "left")
    out = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start int, end int>>"
    return found.select("doc", "text", "spans").mapInArrow(_remove, out)


def digests(docs: DataFrame) -> DataFrame:
    """The result as doc_id, n_words, n_removed and the digest of the kept text."""
    found = remove_repeats(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d)
), f AS (
  SELECT k, min(doc_id) AS first FROM w GROUP BY k HAVING min(doc_id) < max(doc_id)
), covered AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM w JOIN f USING (k) WHERE first < doc_id) GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, words, coalesce(len(ps), 0) AS n_removed,
         CASE WHEN ps IS NULL THEN words
              ELSE list_filter(words, lambda x, i: NOT list_contains(ps, i)) END AS kept
  FROM d LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, len(words)::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM kept
"""
