"""Main text of hand-written pages, against a plain parser that is told which element is the article."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import pytest

from termloom.llm import html_text

BLOCKS = frozenset(html_text.BLOCKS)


class Plain(HTMLParser):
    """The blocks of text inside the elements named main, without those inside elements named out."""

    def __init__(self, main: str, out: tuple = ()):
        super().__init__(convert_charrefs=True)
        self.main, self.out, self.open, self.texts, self.fresh = main, out, [], [], True

    def handle_starttag(self, tag, attrs):
        if tag in html_text.VOID:
            if tag in ("br", "img", "hr") and not self.fresh:
                self.texts[-1] += " "
            return
        self.open.append((tag, dict(attrs).get("id") or tag))
        self.fresh |= tag in BLOCKS

    def handle_endtag(self, tag):
        self.fresh |= tag in BLOCKS
        while self.open and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        names = [n for pair in self.open for n in pair]
        if self.main not in names or any(o in names for o in self.out) or {"script", "style"} & set(names):
            return
        if self.fresh:
            self.texts.append("")
        self.texts[-1] += data
        self.fresh = False

    def read(self, html: str) -> str:
        self.feed(html)
        self.close()
        return "\n\n".join(t for t in (" ".join(x.split()) for x in self.texts) if t)


LONG = "The valley lies between two ridges, and its river runs dry every August. People store rain in stone basins that are older than the village."
SECOND = "In winter the road is closed, so flour and oil are carried up by mule. Nobody minds much; the post comes once a week."
THIRD = "A school was opened in 1921 & closed again in 1974, when only four pupils were left."

NEWS = f"""<!doctype html><html><head><title>News</title><style>p > b {{ color: red }}</style></head><body>
<header><a href=/>The Daily</a><nav><ul><li><a href=/w>World</a></li><li><a href=/s>Sport</a></li><li><a href=/b>Business</a></li></ul></nav></header>
<main><article id=story><h1>Life above the river</h1><p class=lead>{LONG}</p><p>{SECOND}</p>
<script>document.write("<p>never</p>");</script><p>{THIRD.replace("&", "&amp;")}</p></article></main>
<aside><h3>Most read</h3><ol><li><a href=1>Storm takes roof</a></li><li><a href=2>Election called</a></li></ol></aside>
<section class="comments"><h3>3 comments</h3><p>I was born there, thanks for this.</p><p>Lovely piece!</p></section>
<footer><p>&copy; 2020 The Daily. <a href=/t>Terms</a> <a href=/p>Privacy</a></p></footer></body></html>"""

MANUAL = f"""<html><body><div class="topbar"><a href="/">Home</a> <a href="/docs">Docs</a></div>
<div class="sidebar"><ul><li><a href=a>Install</a></li><li><a href=b>Configure</a></li><li><a href=c>Deploy</a></li></ul></div>
<div id="page" class="content"><h1>Configure the basin</h1><p>{LONG}</p><h2>Levels</h2><ul><li>Low water needs no action at all.</li><li>High water opens the left gate first, then the right one.</li></ul>
<table><tr><td>Gate</td><td>Width</td></tr><tr><td>Left</td><td>2 m</td></tr></table><p>{SECOND} See also <a href=x>the gates</a>.</p></div>
<div class="footer">Last built on Monday. Copyright the basin people.</div></body></html>"""

BLOG = f"""<div class="cookie-banner consent"><p>We use cookies. <button>OK</button></p></div><div class="wrapper"><div class="header"><h2>My hill blog</h2></div>
<div class="post" id=post><h1>Mules</h1><p>{SECOND}<p>{LONG}<blockquote><p>{THIRD.replace("&", "&#38;")}</p></blockquote></div>
<div class="share"><a href=t>Tweet</a> <a href=f>Share</a></div><form action=s><p>Subscribe by mail</p><input name=m></form></div>"""

PAGES = [(NEWS, "story", ()), (MANUAL, "page", ()), (BLOG, "post", ())]


@pytest.mark.parametrize(("html", "main", "out"), PAGES)
def test_pages_written_by_hand(html, main, out):
    assert html_text.fit().main_texts([html])[0] == Plain(main, out).read(html)


def test_every_block_of_well_formed_pages_is_the_plain_parsers():
    rng = random.Random(4)
    word = lambda: rng.choice(("a", "5 &lt; 6", "b &amp; c", "x  y", "é", "don't", "&copy;", "\n", "1 > 0", 'say "so"'))

    def element(deep: int) -> str:
        tag = rng.choice(("div", "section", "p", "b", "i", "a href='/x>y'", 'span title="a > b"', "em data-x=1", "ul", "h2"))
        inside = "".join(rng.choice((word, lambda: element(deep + 1)))() if deep < 4 else word() for _ in range(rng.randint(0, 4)))
        name = tag.split()[0]
        if name in ("p", "h2"):
            inside = " ".join(word() for _ in range(3))
        return f"<{tag}>{inside}</{name}>" + rng.choice(("", "<!-- no <p> -->", "<br>", "<script>if (a < b) '<p>x</p>'</script>"))

    model = html_text.fit()
    for _ in range(300):
        html = "<body>" + "".join(element(0) for _ in range(4)) + "</body>"
        assert [s for s, _ in model.blocks([html])[0]] == Plain("body").read(html).split("\n\n") or Plain("body").read(html) == "", html


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("<p title=don't>Hello <b title='x>y'>you</b>.</p>", ["Hello you."]),
        ("<p>One.</p><!--><p>Two.</p><!---><p>Three.</p><!-- x --!><p>Four.</p>", ["One.", "Two.", "Three.", "Four."]),
        ('<p class="x>One.</p><p>Two.</p>', ["One.", "Two."]),
        ("<p>1 < 2 <3 and </> 4 <? x ?>5<![CDATA[ 6 ]]>7", ["1 < 2 <3 and 4 57"]),
        ("<p>One.<!-- open <p>Two.", ["One."]),
        ("<p>One.<script>var a = '</scripty>' + 1;</script >Two.", ["One.Two."]),
        ("<p>One.<p cut", ["One."]),
        ("<P CLASS=A/>One.<BR/>Two.", ["One. Two."]),
    ],
)
def test_odd_markup(html, blocks):
    assert [s for s, _ in html_text.fit().blocks([html])[0]] == blocks


def test_hostile_pages_take_linear_time():
    n = 400_000
    pages = ["<a " * (n // 3), "<a ='" * (n // 5), "<!--" * (n // 4), "<" * n, "&" * n, "<div>" * (n // 11) + "</x>" * (n // 8), "<svg>" * (n // 10) + "</x>" * (n // 8), "<li><ul>" + "<div>" * (n // 10) + "<li></li>" * (n // 18), "<script>" + "</script " * (n // 9), "<p a" + " " * n + ">x", "<p " + "class " * (n // 6) + ">x", "<h1><h2>" * (n // 8)]
    model = html_text.fit()
    began = time.process_time()
    for page in pages:
        model.main_texts([page])
    assert time.process_time() - began < 40


def test_deep_text_stays():
    html = "<article>" + "<div>" * 3000 + "<p>A sentence that stands very deep in the page, and stays.</p>"
    assert [s for s, _ in html_text.fit().blocks([html])[0]] == ["A sentence that stands very deep in the page, and stays."]
