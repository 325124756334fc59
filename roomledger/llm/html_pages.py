"""Labelled pages that the extraction model is trained on.

An attribute ``data-main`` says for its element and what it holds, down to the next such
attribute, whether it belongs to the article (1) or not (0). The texts mean nothing.
"""

from __future__ import annotations

_LONG = "The river had risen in the night, and by morning the lower road, which led to the mill, was under water. "
_TEXT = _LONG + "Nobody in the village remembered a flood so early in the year; the old men shook their heads."
_SHORT = "So it began."


def _paragraphs(n: int, mark: str = "") -> str:
    texts = [_TEXT, _SHORT, f"{_LONG} <a href='/mill'>The mill</a> stood empty, and <em>nobody</em> went there.", _LONG * 3]
    return "".join(f"<p{mark}>{texts[i % 4]}</p>" for i in range(n))


def _menu(n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/s{i}">Section {i}</a></li>' for i in range(n)) + "</ul>"


_NOT = "data-main=0"
_AROUND = [
    (f'<nav {_NOT}>{_menu(6)}</nav>', f"<footer {_NOT}>&copy; example &middot; {_SHORT}</footer>"),
    (f'<header {_NOT} class="site-header"><a href="/">Home</a><p>{_SHORT}</p>{_menu(3)}</header>',
     f'<aside {_NOT} class="sidebar"><h3>Popular</h3>{_menu(4)}<p>{_LONG}</p></aside><footer {_NOT}><p>{_LONG}</p></footer>'),
    (f'<div {_NOT} id="menu" class="menu">{_menu(5)}</div><div {_NOT} class="cookie-notice"><p>{_LONG}</p><button>OK</button></div>',
     f'<div {_NOT} id="comments" class="comments"><h2>Comments</h2><div class="comment"><p>{_TEXT}</p></div><div class="comment"><p>{_SHORT}</p></div></div>'
     f'<div {_NOT} class="footer"><p>{_SHORT}</p>{_menu(3)}</div>'),
    (f'<div {_NOT} class="topbar"><form action="/q"><label>Search</label><input name=q></form></div>{"<!-- ad -->"}<div {_NOT} class="ad">{_LONG}</div>',
     f'<section {_NOT} class="related"><h3>Related</h3>{_menu(3)}</section><section {_NOT} id="comment-list"><p>{_TEXT}</p><p>{_LONG}</p></section>'
     f'<div {_NOT} class="newsletter"><form><p>{_SHORT}</p><input></form></div>'),
]
_INSIDE = [
    "",
    f'<div {_NOT} class="ad">{_LONG}</div>',
    f'<aside {_NOT}><p>{_TEXT}</p></aside>',
    f'<div {_NOT} class="share-buttons">{_menu(3)}</div>',
    f'<div {_NOT} class="advert-banner"><p>{_LONG}</p></div><form {_NOT}><p>{_SHORT}</p></form>',
    f'<nav {_NOT} class="breadcrumb">{_menu(2)}</nav><p {_NOT} class="notice">{_LONG}</p>',
    f'<section {_NOT} class="comments"><h3>Comments</h3><p>{_TEXT}</p><div><p>{_SHORT}</p></div></section>',
    f'<footer {_NOT}><p>{_SHORT}</p></footer>',
    f'<p {_NOT} class="ad">{_TEXT}</p><div {_NOT} class="notice"><p>{_LONG}</p></div>',
    f'<p {_NOT} class="cookie-notice">{_SHORT}</p><div {_NOT} id="sponsored"><p>{_TEXT}</p></div>',
    f'<div {_NOT} role="complementary"><h3>{_SHORT}</h3><p>{_LONG}</p></div><p {_NOT} class="promo">{_LONG} {_TEXT}</p>',
]
_LISTS = "<ul><li>Water in the lower road.</li><li>The mill, empty since spring.</li></ul><blockquote>" + _SHORT + "</blockquote>"
_QUOTES = "<h2>The mill</h2><pre>a  b</pre><table><tr><td>Day</td><td>Level</td></tr><tr><td>1</td><td>3.2</td></tr></table>"
_HOLDERS = [
    ("<article data-main=1>", "</article>"),
    ("<main><article data-main=1>", "</article></main>"),
    ('<div id="content" class="content" data-main=1>', "</div>"),
    ('<main data-main=1><div class="post-body">', "</div></main>"),
    ("<div data-main=1>", "</div>"),
    ('<div class="wrapper"><section class="entry" data-main=1>', "</section></div>"),
]


_TEASERS = "".join(f'<article><h3><a href="/t{i}">{_SHORT}</a></h3><p>{_SHORT}</p></article>' for i in range(3))
#: Names of a theme, which say nothing of the element that has them.
_THEMES = ["single right-sidebar", "comments-open has-sidebar", "page with-comments no-header", "archive search-results tags-x"]


def _other_pages() -> list[str]:
    """Pages with names of a theme, without names, without tags, and with lists of links that have no name."""
    pages = []
    for theme in _THEMES:
        for start, end in _HOLDERS[:2]:
            pages.append(f'<body class="{theme}">{start}<p>{_TEXT}</p><p>{_SHORT}</p><p>{_LONG}</p>{end}<footer {_NOT}>{_SHORT}</footer></body>')
        pages.append(f'<body class="{theme}"><div class="search-page"><article class="{theme}" data-main=1><h1>{_SHORT}</h1>{_paragraphs(3)}</article></div></body>')
        pages.append(f'<body class="{theme}"><div class="{theme.split()[-1]}-article" data-main=1>{_paragraphs(3)}</div><aside {_NOT}>{_TEASERS}</aside></body>')
    for menu in (f"<ul {_NOT}>" + _menu(5)[4:], f"<ol {_NOT}>" + _menu(4)[4:-5] + "</ol>", f"<div {_NOT}>{_menu(3)}</div>"):
        pages.append(f"<body>{menu}<article data-main=1>{_paragraphs(3)}{_LISTS}</article>{menu}</body>")
        pages.append(f"<body>{menu}<div data-main=1><h1>{_SHORT}</h1>{_paragraphs(4)}{_LISTS}</div>{menu}</body>")
        pages.append(f"<article data-main=1>{_paragraphs(2)}{menu}{_paragraphs(2)}{_LISTS}</article>")
        pages.append(f"<html data-main=1><body>{_paragraphs(3)}{_LISTS}{menu}</body></html>")
    for text in (_TEXT, _SHORT, f"{_LONG}<br>{_TEXT}<br><br>{_SHORT}", f"{_LONG}<b>{_SHORT}</b> {_TEXT}"):
        pages.append(f"<html data-main=1>{text}")
        pages.append(f"<html data-main=1><body>{text}</body></html>")
        pages.append(f"<html data-main=1><body><nav {_NOT}>{_menu(4)}</nav>{text}<br>{_TEXT}<footer {_NOT}>{_SHORT}</footer></body></html>")
    for before, after in _AROUND:
        for inside in _INSIDE[::3]:
            pages.append(f"<body>{before}<main data-main=1><p>{_LONG}</p>{inside}<p>{_SHORT}</p></main>{after}</body>")
            pages.append(f"<body><header {_NOT}><p>{_LONG}</p></header><main data-main=1><p>{_TEXT}</p>{inside}<p>{_SHORT}</p></main>{after}</body>")
    for _ in range(2):
        pages.append(f'<body><article data-main=1>{_paragraphs(3)}</article><div {_NOT} class="comments"><article class="comment"><p>{_TEXT}</p></article></div></body>')
        pages.append(f'<body><main data-main=1>{_paragraphs(3)}</main><aside {_NOT} class="related">{_TEASERS}</aside><section {_NOT} class="more-posts popular">{_TEASERS}</section></body>')
    return pages


def labelled_pages() -> list[str]:
    """Pages of every kind of surrounding, holder and insertion, small ones, and those of ``_other_pages``."""
    pages = _other_pages()
    for start, end in _HOLDERS:
        for inside in _INSIDE[:6]:
            pages.append(f"{start}<p>{_TEXT}</p>{inside}<p>{_SHORT}</p>{end}")
        for before, after in _AROUND:
            pages.append(f"<body>{before}{start}<p>{_LONG}</p>{end}{after}</body>")
            pages.append(f"<body>{before}<header {_NOT}><p>{_TEXT}</p></header>{start}<h1>{_SHORT}</h1>{_LONG}<ul><li>{_SHORT}<li>one</ul>{end}</body>")
    for i, (before, after) in enumerate(_AROUND * 2):
        for j, (start, end) in enumerate(_HOLDERS):
            inside = _INSIDE[(i * len(_HOLDERS) + j) % len(_INSIDE)]
            more = (_LISTS, "", _QUOTES)[(i + j) % 3]
            body = f"<h1>{_SHORT}</h1>{_paragraphs(2 + j)}{inside}{more}{_paragraphs(1 + i % 4)}"
            if j % 3 == 2:
                body = f"<p><b>{_LONG}<br>{body}"
            pages.append(f"<!DOCTYPE html><html><head><title>{_SHORT}</title><style>p{{margin:0}}</style></head><body>{before}{start}{body}{end}{after}</body></html>")
    return pages
