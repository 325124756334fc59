"""Main text of web pages: a tree-structured graphical model over the DOM."""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .html_pages import labelled_pages

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noframes"}
_HIDDEN = _RAW | {"head", "template", "svg", "canvas", "object", "select", "button", "audio", "video"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul caption".split()
)
#: What an opening tag closes if it is open, and the elements that hide it from that.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
_P_SCOPE = {"td", "th", "table", "button", "caption", "html"}
_AWAY_TAGS = {"nav", "aside", "footer", "form", "menu", "search", "dialog", "fieldset"}
_AWAY = set(
    "nav navbar navigation menu menubar sidebar side aside footer foot header masthead banner ad ads adv advert adverts "
    "advertisement advertising adbox sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations popular trending comment comments commentlist reply replies respond discussion disqus breadcrumb "
    "breadcrumbs widget widgets search searchbox form toolbar topbar pager pagination copyright legal disclaimer skip tags "
    "meta byline complementary contentinfo".split()
)
_TOWARDS = set("article content main post entry story body text prose".split())
#: As the last word of a name these say what an element is, whatever stands before.
_IS_ARTICLE = {"article", "post", "story", "prose"}
#: Names with such words tell of a state of the page, and not what the element is.
_STATE_FIRST, _STATE_LAST = set("has have no with without is not hide show".split()), set("open closed on off enabled disabled active visible hidden".split())
_TEXT_TAGS = {"p", "li", "blockquote", "pre", "td", "th", "dd", "dt", "figcaption"}
_HEADINGS = {f"h{i}" for i in range(1, 7)}
_NAME = re.compile(r"[a-z]+")
FEATURES = (
    "bias", "away_tag", "away_name", "towards_tag", "towards_name", "below_away", "below_towards", "page_towards_outside",
    "text_tag", "heading", "container", "inline", "list", "header", "header_inside", "linked", "half_linked", "empty", "short",
    "middle", "long", "stops", "inside", "away", "no_towards", "no_towards_text", "linked_list", "loose",
)


@dataclass
class Page:
    """Elements in page order (a parent comes before its children) and what stands where.

    ``flow`` has the texts as (element, text) and None where a block begins or ends.
    """

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    flow: list[tuple[int, str] | None] = field(default_factory=list)


def parse(source: str) -> Page:
    """The elements of a page, with the usual repairs: missing end tags, crossed tags, cut ends."""
    page = Page(["html"], [-1], [""])
    tags, parents, attributes, flow = page.tags, page.parents, page.attributes, page.flow
    stack, at, n, hidden = [0], 0, len(source), 0
    depths: dict[str, list[int]] = defaultdict(list, html=[0])  # where each tag is open on the stack
    find = _TOKEN.search

    def last(names: set[str]) -> int:
        return max((depths[name][-1] for name in names if depths[name]), default=0)

    def close(depth: int) -> None:
        nonlocal hidden
        for element in stack[depth:]:
            depths[tags[element]].pop()
            if tags[element] in _BLOCK:
                flow.append(None)
            hidden -= tags[element] in _HIDDEN
        del stack[depth:]

    while at < n:
        match = find(source, at)
        end = match.start() if match else n
        if end > at and not hidden:
            flow.append((stack[-1], source[at:end]))
        if not match:
            break
        at = match.end()
        tag = match[2] or match[5]
        if not tag:
            if source.startswith("<![CDATA[", end) and not hidden:
                flow.append((stack[-1], html.escape(source[end + 9 : at].removesuffix("]]>"))))
            continue
        tag = tag.lower()
        if match[1] or match[4]:
            depth = last({tag})
            if depth and tag not in _BLOCK and any(tags[e] in _BLOCK for e in stack[depth:]):
                hidden -= tag in _HIDDEN
                del stack[depth]
                depths.clear()
                for i, element in enumerate(stack):
                    depths[tags[element]].append(i)
            elif depth:
                close(depth)
            continue
        if tag == "html" and not attributes[0]:
            attributes[0] = match[3] or match[6] or ""
        if tag in ("html", "body") and depths[tag]:
            continue
        if tag in _ENDS_P or tag in _CLOSES:
            closed, scope = _CLOSES.get(tag, (set(), set()))
            ends = closed | {"p"} if tag in _ENDS_P else closed
            while (i := last(ends)) > last(scope | _P_SCOPE - closed):
                name = tags[stack[i]]
                close(i)
                if name != "p":
                    break
        if tag == "body" and depths["head"]:
            close(depths["head"][-1])
        elif tag in _BLOCK and hidden and tags[stack[-1]] == "head":
            close(len(stack) - 1)
        if tag in _BLOCK:
            flow.append(None)
        if tag in _VOID:
            if tag == "br" and not hidden:
                flow.append((stack[-1], "\n"))
            continue
        tags.append(tag)
        parents.append(stack[-1])
        attributes.append(match[3] or match[6] or "")
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = stop.end() if stop else n
            continue
        depths[tag].append(len(stack))
        stack.append(len(tags) - 1)
        hidden += tag in _HIDDEN
    return page


_PLACE = {name: i for i, name in enumerate(FEATURES)}


def _kind(name: str) -> tuple[bool, bool]:
    """Whether a name, such as a class, says that its element is something away from, or is, the article."""
    words = _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    if not words or (len(words) > 1 and (words[0] in _STATE_FIRST or words[-1] in _STATE_LAST)):
        return False, False
    away, towards = not _AWAY.isdisjoint(words), not _TOWARDS.isdisjoint(words)
    if words[-1] in _IS_ARTICLE or (towards and _AWAY.intersection(words) == {"header"}):
        away = False
    return away, towards and not away


@lru_cache(4096)
def _names(tag: str, attributes: str) -> tuple[bool, bool, str | None]:
    """Whether class, id and role name something away from, or towards, the article; the label, if any.

    The names of a page, a main part or an article say where it is used: only an article
    that has a whole name of its own such as ``comment`` is away.
    """
    kinds, main, whole = [], None, set()
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key in ("class", "id", "role", "itemprop"):
            whole.update((a or b or c).lower().split())
            kinds += map(_kind, (a or b or c).split())
        elif key == "data-main":
            main = a or b or c
    away, towards = any(k[0] for k in kinds), any(k[1] for k in kinds)
    if tag in ("html", "body", "main", "article"):
        away, towards = tag == "article" and not _AWAY.isdisjoint(whole), towards and tag not in ("html", "body")
    return away, towards and not away, main


@lru_cache(512)
def _of_tag(tag: str) -> tuple[int, ...]:
    holds = {
        "bias": True, "away_tag": tag in _AWAY_TAGS, "towards_tag": tag in ("article", "main"), "text_tag": tag in _TEXT_TAGS,
        "heading": tag in _HEADINGS, "container": tag in ("div", "section", "body", "html", "table", "tr", "tbody"),
        "inline": tag not in _BLOCK, "list": tag in ("ul", "ol", "li", "dl"),
    }
    return tuple(_PLACE[k] for k, v in holds.items() if v)


@lru_cache(4096)
def _of_place(*holds: bool) -> tuple[int, ...]:
    names = (
        "away_name", "towards_name", "below_away", "below_towards", "page_towards_outside", "header", "header_inside", "inside",
        "away", "no_towards", "no_towards_text", "linked_list", "loose",
    )
    return tuple(_PLACE[k] for k, v in zip(names, holds, strict=True) if v)


@lru_cache(1 << 16)
def _of_text(size: int, linked: int, stops: bool) -> tuple[int, ...]:
    holds = {
        "linked": size > 0 and linked > 0.8 * size, "half_linked": size > 0 and linked > 0.4 * size, "empty": size == 0,
        "short": 0 < size < 25, "middle": 25 <= size < 100, "long": size >= 100, "stops": stops,
    }
    return tuple(_PLACE[k] for k, v in holds.items() if v)


def features(page: Page) -> tuple[list[tuple[int, ...]], list[int]]:
    """The features that hold for each element, as places in ``FEATURES``, and the ``data-main`` labels."""
    n, tags, parents = len(page.tags), page.tags, page.parents
    text, linked, stops = [0] * n, [0] * n, [0] * n
    for item in page.flow:
        if item:
            element, piece = item
            text[element] += len(piece.strip())
            stops[element] += piece.count(".") + piece.count(",")
    for i in range(n - 1, 0, -1):
        if tags[i] == "a":
            linked[i] = text[i]
        up = parents[i]
        text[up] += text[i]
        linked[up] += linked[i]
        stops[up] += stops[i]
    own = [0] * n
    for item in page.flow:
        if item:
            own[item[0]] += len(item[1].strip())
    no_text_tags = not any(text[i] and (t in _TEXT_TAGS or t in _HEADINGS) for i, t in enumerate(tags))
    away, in_tag, inside, labels = [False] * n, [False] * n, [False] * n, [0] * n
    found: list[tuple[int, ...]] = []
    names = [_names(t, a) if a else (False, False, None) for t, a in zip(tags, page.attributes, strict=True)]
    some_towards = any(t in ("article", "main") for t in tags) or any(t for _, t, _ in names)
    for i, tag in enumerate(tags):
        up = parents[i]
        away_name, towards_name, main = names[i]
        below_away, below_towards = (away[up], inside[up]) if i else (False, False)
        if tag in ("article", "main", "body"):  # names of what is around it do not tell
            below_away = i > 0 and in_tag[up]
        in_tag[i] = (i > 0 and in_tag[up]) or tag in _AWAY_TAGS
        is_header = tag == "header"
        away_here = away_name or tag in _AWAY_TAGS or (is_header and not below_towards)
        away[i] = below_away or away_here
        inside[i] = (below_towards or towards_name or tag in ("article", "main")) and not away_here
        labels[i] = int(main) if main in ("0", "1") else (labels[up] if i else 0)
        loose_text = not some_towards and not away[i] and (tag in _TEXT_TAGS or tag in _HEADINGS)
        size = text[i]
        where = _of_place(
            away_name, towards_name, below_away, below_towards, some_towards and not inside[i], is_header and not below_towards,
            is_header and below_towards, inside[i], away[i], not some_towards, loose_text,
            tag in ("ul", "ol", "menu", "li") and size > 0 and linked[i] > 0.8 * size, not some_towards and not away[i] and own[i] > (0 if no_text_tags else 80),
        )
        found.append(_of_tag(tag) + where + _of_text(min(size, 1000), min(linked[i], 1000) if size < 1000 else 1000 * linked[i] // size, stops[i] * 200 >= size > 0))
    return found, labels


@dataclass
class Model:
    """Unary weights of the features, and log potentials of parent and child labels."""

    unary: np.ndarray
    pair: np.ndarray

    def marginals(self, page: Page, found: list[tuple[int, ...]], count_edges: bool = False) -> tuple[list[float], np.ndarray]:
        """P(article) of every element and, if asked for, the expected number of edges by labels of parent and child.

        Sum-product in log odds: messages go up from the leaves, then down from the root.
        """
        n, parents, weights = len(found), page.parents, self.unary.tolist()
        odds = [sum(weights[f] for f in fs) for fs in found]
        (p00, p01), (p10, p11) = np.exp(self.pair).tolist()
        exp, log = math.exp, math.log

        def up_message(x: float) -> float:
            e = exp(min(x, 50.0))
            return log((p10 + p11 * e) / (p00 + p01 * e))

        def down_message(x: float) -> float:
            e = exp(min(x, 50.0))
            return log((p01 + p11 * e) / (p00 + p10 * e))

        below, ups = odds[:], [0.0] * n
        for i in range(n - 1, 0, -1):
            ups[i] = up_message(max(below[i], -50.0))
            below[parents[i]] += ups[i]
        belief = below[:]
        edges = np.zeros((2, 2))
        for i in range(1, n):
            rest = max(min(belief[parents[i]] - ups[i], 50.0), -50.0)
            belief[i] = below[i] + down_message(rest)
            if count_edges:
                mine, up = exp(max(min(below[i], 50.0), -50.0)), exp(rest)
                joint = np.array([[p00, p01 * mine], [p10 * up, p11 * up * mine]])
                edges += joint / joint.sum()
        return [1 / (1 + exp(-max(min(b, 50.0), -50.0))) for b in belief], edges


def train(pages: list[str], rounds: int = 80, step: float = 0.5, decay: float = 0.001) -> Model:
    """Likelihood of labelled pages by adaptive gradient steps; expectations come from message passing."""
    known = []
    for source in pages:
        page = parse(source)
        found, labels = features(page)
        known.append((page, found, labels))
    model = Model(np.zeros(len(FEATURES)), np.zeros((2, 2)))
    sums = [np.full_like(model.unary, 1e-6), np.full_like(model.pair, 1e-6)]
    for _ in range(rounds):
        unary, pair = -decay * model.unary, -decay * model.pair
        for page, found, labels in known:
            marginals, edges = model.marginals(page, found, count_edges=True)
            for fs, label, p in zip(found, labels, marginals, strict=True):
                unary[list(fs)] += label - p
            seen = np.zeros((2, 2))
            for i in range(1, len(labels)):
                seen[labels[page.parents[i]], labels[i]] += 1
            pair += seen - edges
        for weights, grown, total in ((model.unary, unary, sums[0]), (model.pair, pair, sums[1])):
            total += grown**2
            weights += step * grown / np.sqrt(total)
    return model


def main_text(source: str, model: Model) -> str:
    """Blocks of the elements that are more likely article than not, joined by two line breaks."""
    page = parse(source)
    keep = [p > 0.5 for p in model.marginals(page, features(page)[0])[0]]
    blocks: list[str] = []
    held: list[str] = []
    for item in [*page.flow, None]:
        if item is None:
            if held and (block := " ".join(html.unescape("".join(held)).split())):
                blocks.append(block)
            held = []
        elif keep[item[0]]:
            held.append(item[1])
    return "\n\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py() or "", model) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    The model is trained on the labelled pages of ``html_pages`` unless one is given. A
    null or empty html gives an empty text; ids and urls pass through, null or repeated;
    an empty table gives no rows. A page's work grows with its length, however deep it is
    nested.
    White space in a block becomes one space; character references are decoded once.
    """
    ship(pages.sparkSession)
    model = model or train(labelled_pages())
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    found = rows.mapInArrow(partial(_extract, model=model), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
