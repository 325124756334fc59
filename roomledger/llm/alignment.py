"""Tokens of two tokenizers aligned by bytes: fragments of byte ranges, composed in a tree."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, text_of
from .tokens import _byte_letters, vocabulary_path

#: Texts of more bytes are cut into ranges of so many bytes; so many fragments meet in one node of the tree.
RANGE, FAN = 1 << 16, 16
#: Pairs of ids whose counts go to every task; with more, the ids of A are cut into ranges, one pass for each.
PAIRS = 4_000_000
#: Segments whose alignment a Python worker keeps; beyond, it starts anew.
KEPT = 500_000
VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: White space other than the space and the line feed.
_OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Ids and ends (byte offsets) of the tokens of A and of B.
Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Groups:
    """Closed groups: the codes (A id * 2^32 + B id) of all links, the groups as text, and their numbers."""

    codes: bytes
    text: str
    n_a: int
    n_b: int
    n_groups: int


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both of two rising arrays in one."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What two rising arrays share."""
    return np.intersect1d(a, b, assume_unique=True)


def _links(tokens: Tokens) -> np.ndarray:
    """Codes of all links: the pieces into which the ends of both tokenizers cut the bytes."""
    a, a_ends, b, b_ends = tokens
    ends = _union(a_ends, b_ends)
    return (a[np.searchsorted(a_ends, ends)] << 32) | b[np.searchsorted(b_ends, ends)]


def _decimals(ids: np.ndarray) -> list[str]:
    each, place = np.unique(ids, return_inverse=True)
    names = list(map(str, each.tolist()))
    return [names[i] for i in place.tolist()]


def _texts(tokens: Tokens, common: np.ndarray) -> list[str]:
    """The groups as text, each up to a common end."""
    a, a_ends, b, b_ends = tokens
    cut_a, cut_b = (itertools.pairwise([0, *np.searchsorted(e, common, "right").tolist()]) for e in (a_ends, b_ends))
    a_ids, b_ids = map(_decimals, (a, b))
    return [",".join(a_ids[i:x]) + "|" + ",".join(b_ids[j:y]) for (i, x), (j, y) in zip(cut_a, cut_b, strict=True)]


def groups_of(tokens: Tokens) -> Groups:
    """The groups of tokens that begin and end together."""
    common = _common(tokens[1], tokens[3])
    return Groups(_links(tokens).tobytes(), ";".join(_texts(tokens, common)), len(tokens[0]), len(tokens[2]), len(common))


class Aligner:
    """Both tokenizers over texts.

    Where single spaces and line feeds alone stand between words, neither tokenizer joins
    tokens across the place before one: the first cuts there by its pattern, and no piece
    of the second has a space after another character, or a line feed at all (checked
    when it is loaded). So a space or line feed with the word after it, a segment, is
    encoded and aligned once, many new ones in one go, until ``KEPT`` are known. Other texts are encoded whole.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = {c: b for b, c in _byte_letters().items()}
        size = max(self.a.get_vocab().values()) + 1
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.by_segment = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.space = self.b.piece_to_id("▁")
        self.encode_a = self._quick(path_a) or (lambda s: self.a.encode(s, add_special_tokens=False).ids)
        self.with_groups = False
        self.forget()

    def _quick(self, path: str):
        """The same encoder in the quicker library, if merges are in the order of ids, as that one has them."""
        import public_tokenizers
        import tiktoken

        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges)):
            return None
        special = set(self.a.get_added_tokens_decoder())
        ranks = {raw: i for i, raw in enumerate(self.bytes_a) if i not in special}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def forget(self) -> None:
        #: The number of each known segment, -1 for one that a tokenizer does not spell out again.
        self.numbers: dict[str, int] = {}
        #: Codes of the links and text of the groups of each number, and how many tokens and groups there are.
        self.codes: list[bytes] = []
        self.texts: list[str] = []
        self.sizes: list[np.ndarray] = []

    def _spelt(self, a: list[int], b: list[int], raw: bytes) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw

    def segments(self, text: str) -> list[str] | None:
        """The segments of space + text, if they can be encoded one by one; the space is left out. None for an odd text."""
        if not text:
            return []
        odd = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace()
        if odd or not self.by_segment or _OTHER_SPACE.search(text):
            return None
        return text.replace("\n", " \n").split(" ")

    def learn(self, segments: set[str], with_groups: bool) -> None:
        """Encode and align the segments that are not known, all together; their groups as text only if asked for."""
        if len(self.numbers) > KEPT or with_groups > self.with_groups:
            self.forget()
            self.with_groups = with_groups
        new = list(segments - self.numbers.keys())
        if not new:
            return
        b = self.b.encode(new, num_threads=1)
        # a line feed stands where the others have their space
        b = [x if s[0] != "\n" else x[1:] if x[:1] == [self.space] else [] for s, x in zip(new, b, strict=True)]
        raw = [s if s[0] == "\n" else " " + s for s in new]
        spelt = b"".join(map(self.bytes_b.__getitem__, itertools.chain(*b)))
        if spelt != "".join(raw).encode():
            good = [b"".join(map(self.bytes_b.__getitem__, x)) == r.encode() for x, r in zip(b, raw, strict=True)]
            self.numbers.update((s, -1) for s, g in zip(new, good, strict=True) if not g)
            new, b, raw = (list(itertools.compress(x, good)) for x in (new, b, raw))
        self.numbers.update(zip(new, itertools.count(len(self.codes)), strict=False))
        # one text of all: no token crosses from one segment to the next
        ids_a = np.array(self.encode_a("".join(raw)), np.int64)
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        ids_b = np.fromiter(itertools.chain(*b), np.int64, int(n_b.sum()))
        tokens = (ids_a, np.cumsum(self.sizes_a[ids_a]), ids_b, np.cumsum(self.sizes_b[ids_b]))
        last = tokens[3][np.cumsum(n_b) - 1]
        n_a = np.diff(np.searchsorted(tokens[1], last, "right"), prepend=0)
        common = _common(tokens[1], tokens[3])
        if not np.isin(last, common).all():
            raise ValueError("a token of the first tokenizer crosses the end of a segment")
        codes = _links(tokens).tobytes()
        cut = (8 * np.searchsorted(_union(tokens[1], tokens[3]), last, "right")).tolist()
        n_groups = np.diff(np.searchsorted(common, last, "right"), prepend=0)
        self.codes += [codes[i:j] for i, j in itertools.pairwise([0, *cut])]
        if self.with_groups:
            texts = _texts(tokens, common)
            self.texts += [";".join(texts[i:j]) for i, j in itertools.pairwise([0, *np.cumsum(n_groups).tolist()])]
        self.sizes.append(np.stack([n_a, n_b, n_groups], 1))

    def whole(self, text: str) -> Tokens | None:
        """The tokens of space + text; None where there are none."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if not text or not self._spelt(a, b, (" " + text).encode()):
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return a, np.cumsum(self.sizes_a[a]), b, np.cumsum(self.sizes_b[b])


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per Python worker."""
    return Aligner(path_a, path_b)


def _codes(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.int64)


class Parts(NamedTuple):
    """Texts as parts, each a segment or a whole text; ``parts`` numbers those of all texts in order."""

    n_parts: np.ndarray
    parts: np.ndarray
    #: Codes of all parts, one after the other, and how many each has.
    codes: np.ndarray
    links: np.ndarray
    #: Tokens of A and of B, and groups, of each part, and its groups as text.
    sizes: np.ndarray
    texts: list[str]

    @staticmethod
    def of(tool: Aligner, texts: list[str], with_groups: bool) -> Parts:
        cuts = list(map(tool.segments, texts))
        tool.learn({s for cut in cuts if cut for s in cut}, with_groups)
        n, numbers, odd = [], [], []
        for text, cut in zip(texts, cuts, strict=True):
            if cut is None:
                tokens = tool.whole(text)
                found = [] if tokens is None else [len(tool.codes) + len(odd)]
                odd += [] if tokens is None else [groups_of(tokens)]
            else:
                found = list(map(tool.numbers.__getitem__, cut))
                found = [] if -1 in found else found
            n.append(len(found))
            numbers += found
        used, parts = np.unique(np.array(numbers, np.int64), return_inverse=True)
        sizes = np.concatenate([*tool.sizes, np.array([(g.n_a, g.n_b, g.n_groups) for g in odd], np.int64).reshape(-1, 3)])[used]
        known = [tool.codes[i] if i < len(tool.codes) else odd[i - len(tool.codes)].codes for i in used.tolist()]
        links = np.fromiter(map(len, known), np.int64, len(known)) // 8
        groups = [tool.texts[i] if i < len(tool.codes) else odd[i - len(tool.codes)].text for i in used.tolist()] if with_groups else []
        return Parts(np.array(n, np.int64), parts, _codes(known), links, sizes, groups)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each start and size, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _count(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """code and the number of texts (row, doc_id, text) that have it linked, summed up in the task."""
    tool = aligner(*paths)
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        n_parts, parts, code, links, _, _ = Parts.of(tool, batch.column(2).to_pylist(), with_groups=False)
        new, pair = np.unique(code, return_inverse=True, sorted=True)
        n_new, n_links = max(1, len(new)), max(1, len(links))
        once = np.unique(np.repeat(np.arange(len(n_parts)), n_parts) * n_links + parts)
        text, part = once // n_links, once % n_links
        held = np.repeat(text, links[part]) * n_new + pair[_spread((np.cumsum(links) - links)[part], links[part])]
        n = np.bincount(np.unique(held) % n_new, minlength=len(new))
        codes, place = np.unique(np.concatenate([codes, new]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        if len(codes) > PAIRS // 4:
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])
            codes, counts = codes[:0], counts[:0]
    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], ["code", "n"])


class Counts:
    """Counts of the pairs of one range of A ids, by code."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, best: np.ndarray):
        self.codes, self.counts, self.best = codes, counts, best

    def sums(self, code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each part of so many codes: its links, those whose count is the best of their A id, the sum of all counts."""
        found = np.zeros((len(sizes), 3), np.int64)
        found[:, 0] = sizes
        if len(self.codes) and len(code):
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            here = self.codes[at] == code
            for k, value in ((1, self.best[at] & here), (2, np.where(here, self.counts[at], 0))):
                total, end = np.concatenate([[0], np.cumsum(value.astype(np.int64))]), np.cumsum(sizes)
                found[:, k] = total[end] - total[end - sizes]
        return found


def _score(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], counts) -> Iterator[pa.RecordBatch]:
    """The digest columns of texts (row, doc_id, text)."""
    tool, table = aligner(*paths), counts.value
    for batch in batches:
        n_parts, parts, codes, links, sizes, groups = Parts.of(tool, batch.column(2).to_pylist(), with_groups=True)
        each = np.concatenate([sizes, table.sums(codes, links)], 1)[parts]
        total, ends = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(each, 0)]), np.cumsum(n_parts)
        numbers = total[ends] - total[ends - n_parts]
        numbered = parts.tolist()
        cuts = (";".join([groups[p] for p in numbered[x:y]]) for x, y in itertools.pairwise([0, *ends.tolist()]))
        digests = [hashlib.sha256(cut.encode()).hexdigest() if cut else "" for cut in cuts]
        columns = [*batch.columns[:2], *(pa.array(numbers[:, k]) for k in range(6)), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _RESULT.split(", ")])


_RESULT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _packed(ids: np.ndarray, ends: np.ndarray) -> bytes:
    return np.stack([ids, ends]).astype(np.int64).tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids, ends = np.frombuffer(raw, np.int64).reshape(2, -1)
    return ids, ends


@dataclass(frozen=True)
class Fragment:
    """Open prefix and open suffix of a byte range; ``cut`` tells whether both tokenizers end a token together in it.

    Without a cut all tokens are prefix. Composition is associative: the suffix of the one
    and the prefix of the next close a group if both have a cut.
    """

    cut: bool
    prefix: Tokens
    suffix: Tokens

    def then(self, other: Fragment) -> tuple[Fragment, Tokens | None]:
        """The fragment of both ranges, and the tokens of the group that closes where they meet."""
        if not self.cut:
            return Fragment(other.cut, _joined(self.prefix, other.prefix), other.suffix), None
        met = _joined(self.suffix, other.prefix)
        if not other.cut:
            return Fragment(True, self.prefix, met), None
        return Fragment(True, self.prefix, other.suffix), met


def _joined(x: Tokens, y: Tokens) -> Tokens:
    return tuple(np.concatenate(p) for p in zip(x, y, strict=True))


def _between(tokens: Tokens, low: int, high: int) -> Tokens:
    """The tokens that end after ``low`` and up to ``high``."""
    a, a_ends, b, b_ends = tokens
    i, j = (slice(*np.searchsorted(e, [low, high], "right")) for e in (a_ends, b_ends))
    return a[i], a_ends[i], b[j], b_ends[j]


def fragment(tokens: Tokens) -> tuple[Fragment, Tokens | None]:
    """The fragment of a range's tokens, and the tokens of its closed groups."""
    common = _common(tokens[1], tokens[3])
    if not len(common):
        return Fragment(False, tokens, _between(tokens, 0, 0)), None
    first, last = int(common[0]), int(common[-1])
    closed = _between(tokens, first, last) if len(common) > 1 else None
    return Fragment(True, _between(tokens, 0, first), _between(tokens, last, 1 << 62)), closed


_NODE = "row long, at long, kind int, cut boolean, prefix_a binary, prefix_b binary, suffix_a binary, suffix_b binary, codes binary, groups binary, n_a long, n_b long, n_groups long"
_OPEN, _CLOSED, _NONE = 0, 1, 2


class _Nodes:
    """Rows of ``_NODE``: open fragments, closed groups (``at`` is where they end), texts without tokens."""

    def __init__(self):
        self.rows: list[tuple] = []

    def open(self, row: int, at: int, f: Fragment) -> None:
        packed = [_packed(*f.prefix[:2]), _packed(*f.prefix[2:]), _packed(*f.suffix[:2]), _packed(*f.suffix[2:])]
        self.rows.append((row, at, _OPEN, f.cut, *packed, b"", b"", 0, 0, 0))

    def closed(self, row: int, tokens: Tokens | None) -> None:
        if tokens is not None and len(tokens[0]):
            g = groups_of(tokens)
            self.rows.append((row, int(tokens[1][-1]), _CLOSED, True, b"", b"", b"", b"", g.codes, g.text.encode(), g.n_a, g.n_b, g.n_groups))

    def nothing(self, row: int) -> None:
        self.rows.append((row, 0, _NONE, False, b"", b"", b"", b"", b"", b"", 0, 0, 0))

    def batch(self) -> pa.RecordBatch:
        types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        fields = [f.split() for f in _NODE.split(", ")]
        arrays = [pa.array([r[i] for r in self.rows], types[t]) for i, (_, t) in enumerate(fields)]
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


_CHUNK = "row long, at long, a binary, b binary"


def _ranges(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], size: int) -> Iterator[pa.RecordBatch]:
    """The tokens of long texts (row, doc_id, text) by the byte range in which they end; a range -1 for none."""
    tool = aligner(*paths)
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            tokens = tool.whole(text.as_py())
            if tokens is None:
                cuts = [(row, -1, b"", b"")]
            else:
                n = -(-int(tokens[1][-1]) // size)
                parts = [_between(tokens, k * size, (k + 1) * size) for k in range(n)]
                cuts = [(row, k, _packed(*p[:2]), _packed(*p[2:])) for k, p in enumerate(parts)]
            arrays = [pa.array([c[i] for c in cuts], pa.int64() if i < 2 else pa.binary()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "at", "a", "b"])


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nodes = _Nodes()
    for batch in batches:
        for row, at, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if at < 0:
                nodes.nothing(row)
                continue
            found, closed = fragment((*_unpacked(a), *_unpacked(b)))
            nodes.open(row, at, found)
            nodes.closed(row, closed)
        yield nodes.batch()


def _composed(batches: Iterator[pa.RecordBatch], fan: int) -> Iterator[pa.RecordBatch]:
    """One fragment for each ``fan`` in a row of a text (rows come by row and at), and the groups that closed."""
    nodes, key, held = _Nodes(), None, None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6, 7)]
        for row, at, cut, pa_, pb, sa, sb in zip(*columns, strict=True):
            new = Fragment(cut, (*_unpacked(pa_), *_unpacked(pb)), (*_unpacked(sa), *_unpacked(sb)))
            if key == (row, at // fan):
                held, closed = held.then(new)
                nodes.closed(row, closed)
            else:
                if key is not None:
                    nodes.open(*key, held)
                key, held = (row, at // fan), new
        yield nodes.batch()
    if key is not None:
        nodes.open(*key, held)
        yield nodes.batch()


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first group of each text: the prefix of its one fragment, as a text begins with a cut."""
    nodes = _Nodes()
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in (0, 4, 5, 6)]
        for row, a, b, suffix in zip(*columns, strict=True):
            if suffix:
                raise ValueError("tokens after the last common end of a text")
            nodes.closed(row, (*_unpacked(a), *_unpacked(b)))
        yield nodes.batch()


def _pieces(steps: Steps, long_texts: DataFrame, paths: tuple[str, str], size: int, fan: int) -> DataFrame:
    """The closed groups of long texts (row, doc_id, text), each text's fragments composed in a tree."""
    chunks = steps.store(long_texts.mapInArrow(partial(_ranges, paths=paths, size=size), _CHUNK), "ranges")
    most = chunks.agg(F.coalesce(F.max("at"), F.lit(-1))).first()[0] + 1
    level, parts = 0, []
    nodes = steps.store(chunks.repartition("row", "at").mapInArrow(_fragments, _NODE), "level-0")
    while True:
        parts.append(nodes.where(F.col("kind") != _OPEN))
        fragments = nodes.where(F.col("kind") == _OPEN)
        if most <= 1:
            break
        level, most = level + 1, -(-most // fan)
        met = fragments.withColumn("_up", F.floor(F.col("at") / fan)).repartition("row", "_up").sortWithinPartitions("row", "at")
        nodes = steps.store(met.drop("_up").mapInArrow(partial(_composed, fan=fan), _NODE), f"level-{level}")
    parts.append(fragments.mapInArrow(_rooted, _NODE))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return steps.store(found.select("row", "at", "kind", "codes", "groups", "n_a", "n_b", "n_groups"), "pieces")


def _piece_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            each = np.unique(np.frombuffer(codes, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), row)), pa.array(each)], ["row", "code"])


def _piece_sums(batches: Iterator[pa.RecordBatch], counts) -> Iterator[pa.RecordBatch]:
    table = counts.value
    for batch in batches:
        codes = batch.column(1).to_pylist()
        found = table.sums(_codes(codes), np.fromiter(map(len, codes), np.int64, len(codes)) // 8)
        sums = [pa.array(found[:, i]) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:5], *sums], ["row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each text's groups; rows (row, kind, groups) come in order, one group at a time."""
    at, digest, found = None, None, []

    def result() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string()))], ["row", "groups_sha256"])
        found.clear()
        return out

    for batch in batches:
        for row, kind, groups in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if row != at:
                if at is not None:
                    found.append((at, digest.hexdigest() if digest else ""))
                at, digest = row, None
            if kind == _CLOSED:
                if digest is None:
                    digest = hashlib.sha256()
                else:
                    digest.update(b";")
                digest.update(groups.as_py())
        yield result()
    if at is not None:
        found.append((at, digest.hexdigest() if digest else ""))
        yield result()


def pair_counts(steps: Steps, short: DataFrame, pieces: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """code, a, c (documents that hold the pair linked) and best (no pair of this A id has more)."""
    counted = short.mapInArrow(partial(_count, paths=paths), "code long, n long")
    cut = pieces.select("row", "codes").mapInArrow(_piece_codes, "row long, code long").distinct()
    counts = counted.unionByName(cut.select("code", F.lit(1).cast("long").alias("n"))).groupBy("code").agg(F.sum("n").alias("c"))
    counts = steps.store(counts.withColumn("a", F.shiftright("code", 32)), "counts")
    top = counts.groupBy("a").agg(F.max("c").alias("top"))  # one row for each id of A's vocabulary at most
    return steps.store(counts.join(F.broadcast(top), "a").select("code", "a", "c", (F.col("c") == F.col("top")).alias("best")), "pairs")


def _ranges_of_ids(pairs: DataFrame) -> list[tuple[int, int]]:
    """Ranges of A ids with at most ``PAIRS`` pairs each, or of one id."""
    sizes = pairs.groupBy("a").count().orderBy("a").collect()  # one row for each id of A's vocabulary at most
    found, held = [], 0
    for r in sizes:
        if not found or held + r["count"] > PAIRS:
            found.append((r["a"], r["a"]))
            held = 0
        found[-1], held = (found[-1][0], r["a"]), held + r["count"]
    return found or [(0, 0)]


def aligned_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, size: int = RANGE, fan: int = FAN) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokenizer A reads space + text, B the text, special tokens' strings being plain text.
    Places where a token of both ends cut the tokens into groups; a link is a pair of
    tokens whose bytes overlap; a pair's count is the number of documents that hold it
    linked, n_best the links whose count is the highest of their A id, count_sum the sum
    over all links. Texts of up to ``size`` bytes are aligned where they are; longer ones
    by fragments of byte ranges, composed ``fan`` at a time in a tree of tasks.

    A null or empty text, and one that either tokenizer does not spell out again, has no
    tokens: zeros and an empty digest. A null doc_id is a document like others, and so is
    a repeated row. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    steps, wide = Steps(spark, "align", batch_rows=500), Steps(spark, "align-long", batch_rows=16)
    paths = (path_a or vocabulary_path(VOCABULARY_A), path_b or vocabulary_path(VOCABULARY_B))
    rows = docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long"), text_of("text").alias("text"))
    is_long = F.octet_length("text") > size
    long_texts = wide.store(rows.where(is_long).withColumn("row", F.monotonically_increasing_id()), "texts")
    pieces = _pieces(wide, long_texts, paths, size, fan)
    short = rows.where(~is_long)
    pairs = pair_counts(steps, short, pieces, paths)
    ranges = _ranges_of_ids(pairs)
    if len(ranges) > 1:
        short = steps.store(short.withColumn("row", F.monotonically_increasing_id()), "short")
    sums = [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
    parts, long_parts = [], []
    for k, (low, high) in enumerate(ranges):
        here = pairs.where(F.col("a").between(low, high)).orderBy("code").select("code", "c", "best").toArrow()
        table = spark.sparkContext.broadcast(Counts(here["code"].to_numpy(), here["c"].to_numpy(), here["best"].to_numpy()))
        parts.append(steps.store(short.mapInArrow(partial(_score, paths=paths, counts=table), _RESULT), f"short-{k}"))
        cut = pieces.where(F.col("kind") == _CLOSED).select("row", "codes", "n_a", "n_b", "n_groups")
        out = "row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"
        numbers = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
        long_parts.append(wide.store(cut.mapInArrow(partial(_piece_sums, counts=table), out).groupBy("row").agg(*numbers), f"sums-{k}"))
        table.destroy()
    found, long_found = parts[0], long_parts[0]
    if len(ranges) > 1:
        every, every_long = parts[0], long_parts[0]
        for part, long_part in zip(parts[1:], long_parts[1:], strict=True):
            every, every_long = every.unionByName(part), every_long.unionByName(long_part)
        found = parts[0].drop("n_best", "count_sum").join(every.groupBy("row").agg(*sums), "row")
        long_found = long_parts[0].drop("n_best", "count_sum").join(every_long.groupBy("row").agg(*sums), "row")
    ordered = pieces.select("row", "at", "kind", "groups").repartition("row").sortWithinPartitions("row", "at")
    digests = wide.store(ordered.select("row", "kind", "groups").mapInArrow(_digests, "row long, groups_sha256 string"), "digests")
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    named = long_texts.select("row", "doc_id").join(digests, "row", "left").join(long_found, "row", "left")
    named = named.fillna(0, columns).fillna("", ["groups_sha256"])
    result = ["doc_id", *columns, "groups_sha256"]
    return found.select(*result).unionByName(named.select(*result))
