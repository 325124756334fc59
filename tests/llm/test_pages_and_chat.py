"""Main text of pages, and tool calls, against hand-made cases."""

import json

import pytest

from roomledger.llm import chat, html_main
from roomledger.llm.common import Steps
from roomledger.llm.html_pages import labelled_pages

LONG = "It was a long and quiet day, and the boats, all of them, came back before the evening."


@pytest.fixture(scope="module")
def model():
    return html_main.train(labelled_pages())


CASES = [
    ("", ""),
    ("plain", None),
    (f"<article><h1>T &amp;amp; x</h1><p>{LONG}<p>a\n\n <b>b</b>&nbsp;c<br>d</article>", f"T &amp; x\n\n{LONG}\n\na b c d"),
    (f"<html><head><title>no</title><style>p{{}}</style><script>var t='</p><p>';</script></head><body><nav><ul><li><a href=/a>menu</a></ul></nav>"
     f"<!-- <p>no --><div class='ad'>{LONG}</div><article><p><b>{LONG}<br><p>Two.</p><p>Three", f"{LONG}\n\nTwo.\n\nThree"),
    (f"<body><header><p>{LONG}</p></header><main><p>{LONG}</p><aside>{LONG}</aside><form><p>{LONG}</p></form><p>End.</p></main>"
     f"<div class=comments><p>{LONG}</p></div><footer>{LONG}</footer>", f"{LONG}\n\nEnd."),
    (f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><p>1 < 2 & 3 &lt; 4</p></article>",
     f"{LONG}\n\none\n\ntwo\n\nx\n\ny\n\n1 < 2 & 3 < 4"),
    (f"<article><p title='a > b'>{LONG}</p><P CLASS=\"x\">Upper</P></ARTICLE>", f"{LONG}\n\nUpper"),
]


MENU = "<ul>" + "".join(f"<li><a href=/{i}>Part {i}</a></li>" for i in range(5)) + "</ul>"
CASES += [
    (f'<body class="{name}"><article class="{own}"><p>{LONG}</p><p>End.</p></article></body>', f"{LONG}\n\nEnd.")
    for name in ("single right-sidebar", "comments-open", "page has-sidebar no-menu", "") for own in ("post tags-x", "", "category-search hentry")
]
CASES += [
    (f'<body><div class="search-results-article"><p>{LONG}</p><p>{LONG}</p></div></body>', f"{LONG}\n\n{LONG}"),
    (LONG, LONG), ("Only a few words", "Only a few words"),
    (f"<html><body>{LONG}<br>{LONG}<br>The end.</body></html>", f"{LONG} {LONG} The end."),
    (f"<body>{MENU}<article><p>{LONG}</p><ul><li>first, of all</li><li>second</li></ul></article>{MENU}</body>", f"{LONG}\n\nfirst, of all\n\nsecond"),
    (f"<body>{MENU}<h1>Title</h1><p>{LONG}</p><p>{LONG}</p></body>", f"Title\n\n{LONG}\n\n{LONG}"),
    (f"<body><article><p>{LONG}</p></article><div class='comments'><article class='comment'><p>{LONG}</p></article></div></body>", LONG),
]


def test_deep_nesting_takes_linear_time(model):
    import time

    start = time.process_time()
    page = html_main.parse("<div>" * 100_000 + LONG)
    assert len(page.tags) == 100_001 and time.process_time() - start < 5
    page = html_main.parse("<p><button>" + "<div>" * 50_000 + "</div>" * 50_000)
    assert len(page.tags) == 50_003 and time.process_time() - start < 10


@pytest.mark.parametrize(("source", "text"), CASES)
def test_main_text(model, source, text):
    if text is not None:
        assert html_main.main_text(source, model) == text
    else:
        html_main.main_text(source, model)


def test_labelled_pages_are_learnt(model):
    right = total = 0
    for source in labelled_pages():
        page = html_main.parse(source)
        found, labels = html_main.features(page)
        marginals, _ = model.marginals(page, found)
        held = {item[0] for item in page.flow if item and item[1].strip()}
        right += sum((marginals[i] > 0.5) == labels[i] for i in held)
        total += len(held)
    assert right > 0.97 * total


def test_marginals_equal_summing_all_labellings(model):
    import itertools

    import numpy as np

    page = html_main.parse("<div><p>a<b>b</b></p><ul><li>c</ul></div>")
    found, _ = html_main.features(page)
    n = len(found)
    weight, total = np.zeros(n), 0.0
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(model.unary[list(f)].sum() for f, y in zip(found, labels, strict=True) if y)
        score += sum(model.pair[labels[page.parents[i]], labels[i]] for i in range(1, n))
        total += np.exp(score)
        weight += np.exp(score) * np.array(labels)
    assert model.marginals(page, found)[0] == pytest.approx(weight / total)


def test_extract_rows(spark):
    rows = [(1, "u", None), (1, "u", ""), (None, None, f"<article><p>{LONG}</p></article>"), (2, "v", "<p>" * 3000 + "<div>" * 3000), (3, "w", "<" * 5000 + "&#0;&bad;")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = html_main.extract_main_text(df).collect()
    assert len(found) == 5 and [r["text"] for r in found[:3]] == ["", "", LONG]
    assert all(r["n_chars"] == len(r["text"]) for r in found)


def test_real_pages_give_their_articles(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in html_main.extract_main_text(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", article))
        assert found[page["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_link_calls(spark):
    calls = spark.createDataFrame(
        [(1, 0, "a", "f", '{ "y": 2, "x": "é"}'), (1, 2, "b", "f", '{"x": 3, "z": 1}'), (1, 4, "c", "g", "[]"), (1, 6, "d", "f", "no json"),
         (1, 6, "d", "f", "no json"), (2, 0, "p", "f", '{"x": "long text", "y": 1.50}'), (2, 1, "q", "f", None), (2, 3, None, "f", '{"x": "", "y": 1e2}')],
        "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 1, "a", 'say "hi"'), (1, 3, "zz", None), (1, 5, None, "x"), (1, 9, "d", "last")],
                                    "conv_id long, turn long, call_id string, content string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "nowhere"), ("p", "q"), ("q", "p")], "call_id string, needed string")
    schemas = spark.createDataFrame([("f", "x", "string", True, 1.0, 5.0), ("f", "y", "number", False, None, 50.0)], chat.SCHEMA)
    found = chat.link_calls(spark, calls, results, needs, schemas).collect()
    assert len(found) == 12
    by = {(r["kind"], r["call_id"], r["turn"]): r for r in found}
    assert [(by["call", i, t]["level"], by["call", i, t]["linked"]) for i, t in (("a", 0), ("b", 2), ("c", 4), ("d", 6), ("p", 0), ("q", 1), (None, 3))] == [
        (0, True), (1, False), (2, False), (0, True), (None, False), (None, False), (0, False)]
    assert [by["call", i, t]["problems"] for i, t in (("a", 0), ("b", 2), ("c", 4), ("d", 6), ("p", 0), ("q", 1), (None, 3))] == [
        "", "x: wrong kind; z: unexpected", "unknown tool", "arguments: no object", "x: out of range", "arguments: no object",
        "x: out of range; y: out of range"]
    assert by["call", "a", 0]["json"] == '{"arguments":{"x":"é","y":2},"id":"a","name":"f","type":"call"}'
    assert json.loads(by["call", "d", 6]["json"])["arguments"] is None and json.loads(by["call", "p", 0]["json"])["arguments"]["y"] == 1.5
    assert by["result", "a", 1]["json"] == '{"content":"say \\"hi\\"","id":"a","type":"result"}'
    assert [by["result", i, t]["linked"] for i, t in (("a", 1), ("zz", 3), (None, 5), ("d", 9))] == [True, False, False, True]


def test_levels_and_conversations_with_gaps(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "call_id string")
    needs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "gone"), ("gone", "a")], "call_id string, needed string")
    assert sorted(map(tuple, chat.topological_levels(Steps(spark, "t"), ids, needs).collect())) == [("a", 1), ("b", 0)]
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, 1, "assistant", "x"), (1, None, None, ""), (1, 1, "assistant", "y " * 9000), (2, 5, "tool", "z")]
    df = spark.createDataFrame([(*r, "n", 3) for r in rows], "conv_id long, turn long, role string, text string, name string, level int")
    found = chat.conversation_events(df).collect()
    assert len(found) == 6 and sum(r["linked"] for r in found) == 3
    assert {r["problems"] for r in found if r["call_id"] == "1/0" and r["kind"] == "call"} == {"text: out of range; words: out of range"}
    assert chat.conversation_events(df.limit(0)).collect() == []


def test_levels_of_long_chains_and_graphs(spark):
    import random

    random.seed(1)
    edges = [(f"c{i}", f"c{i - 1}") for i in range(1, 300)] + [("x", "y"), ("y", "z"), ("z", "x"), ("behind", "x"), ("hub2", "c299")]
    nodes = [f"n{i}" for i in range(60)]
    for i in range(1, 60):
        edges += [(nodes[i], nodes[j]) for j in random.sample(range(i), min(i, random.choice([0, 1, 1, 2, 3])))]
    edges += [(f"leaf{i}", "c150") for i in range(50)] + [("mixed", "x"), ("mixed", "c3")]
    needs = {}
    for a, b in edges:
        needs.setdefault(a, set()).add(b)
    names = sorted({n for e in edges for n in e})
    levels: dict = {}
    while True:
        new = {n: 1 + max((levels[m] for m in needs.get(n, ())), default=-1) for n in names if n not in levels and all(m in levels for m in needs.get(n, ()))}
        if not new:
            break
        levels |= new
    ids = spark.createDataFrame([(n,) for n in names], "call_id string")
    found = chat.topological_levels(Steps(spark, "t"), ids, spark.createDataFrame(edges, "call_id string, needed string"))
    assert {r["call_id"]: r["level"] for r in found.collect()} == levels
