"""Main text against pages whose article is known, against a plain reading with the standard library's parser, and in time."""

import html
import random
import time
from html.parser import HTMLParser

import pytest

from riskweave.llm import op08_main_text, queries

RNG = random.Random(21)
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def linked(n):
    return "".join(f"<li><a href='/x{i}'>{prose(RNG.randint(1, 3))}</a></li>" for i in range(n))


def test_hidden_names_without_article():
    """Neutral tags and names that say nothing: long paragraphs between menus and short notes."""
    for _ in range(40):
        story = [prose(RNG.randint(40, 120)) for _ in range(RNG.randint(4, 9))]
        page = (f"<body><div class='a1'><ul>{linked(8)}</ul></div><div class='b2'>{''.join(f'<p>{p}</p>' for p in story)}</div>"
                f"<div class='c3'><ul>{linked(9)}</ul></div></body>")
        assert op08_main_text.main_text(page) == "\n".join(story)


def test_hidden_menus_inside_an_article():
    for root in ("article", "main"):
        for _ in range(20):
            story = [prose(RNG.randint(1, 60)) for _ in range(6)]
            page = f"<body><{root}>" + "".join(f"<p>{p}</p>" for p in story[:3]) + f"<ul>{linked(RNG.randint(3, 9))}</ul>" + "".join(
                f"<p>{p}</p>" for p in story[3:]) + f"</{root}><div>{prose(80)}</div></body>"
            assert op08_main_text.main_text(page) == "\n".join(story)
    few = "<article><p>One</p><p><a>Two</a></p><p><a>Three</a></p><p>Four</p></article>"
    assert op08_main_text.main_text(few) == "One\nTwo\nThree\nFour"
    assert op08_main_text.main_text(f"<article><ul>{linked(5)}</ul></article>").count("\n") == 4


class Plain(HTMLParser):
    """Lines of the article by the standard library's parser: everything in article but listed elements, no distribution."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth = self.skip = 0
        self.parts, self.out = [], []

    def cut(self):
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in op08_main_text.BLOCKS or tag in op08_main_text.BOILERPLATE:
            self.cut()
        self.depth += tag == "article"
        self.skip += tag in ("aside", "nav", "script", "style", "form")

    def handle_endtag(self, tag):
        if tag in op08_main_text.BLOCKS or tag in op08_main_text.BOILERPLATE:
            self.cut()
        self.depth -= tag == "article"
        self.skip -= tag in ("aside", "nav", "script", "style", "form")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.parts.append(data)


def plain(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    parser.cut()
    return "\n".join(parser.out)


def test_equals_a_plain_reading():
    for _ in range(60):
        bits = []
        for _ in range(RNG.randint(1, 12)):
            text = html.escape(prose(RNG.randint(1, 30)) + RNG.choice(["", " & <x>", " é z", " \"q\" 'r'"]))
            bits.append(RNG.choice([f"<p>{text}</p>", f"<h2 title='a>b'>{text}</h2>", f"<div data-x=\"1>2\">{text}<br/>more</div>", f"<blockquote><p>{text}</p></blockquote>",
                                    f"<ul><li>{text}<li>two</ul>", f"<aside>{text}</aside>", f"<script>if (a<b) '</p>'</script><p>{text} <b>bold</b></p>",
                                    f"<!-- {text} --><p>&amp;&eacute;&#233; {text}</p>", f"<table><tr><td>{text}<td>cell</table>"]))
        page = f"<html><head><title>t</title></head><body><nav>n</nav><article>{''.join(bits)}</article><footer>f</footer></body></html>"
        assert op08_main_text.main_text(page) == plain(page)


def test_given_pages_equal_a_plain_reading(spark, sf_small):
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op8_main_text(spark, sf_small).collect()}
    assert got == {k: (plain(v or ""), len(plain(v or ""))) for k, v in rows.items()}


@pytest.mark.parametrize("page", ["<a " * 350_000, "<! " * 350_000, "<a \"> \"" * 150_000, "</script " * 120_000, "<script>" + "</script " * 120_000, "<p>x" * 250_000,
                                  "<ul>" * 100_000 + "</p>" * 100_000, "<div class=ad>x" * 60_000, "<!--" * 250_000, "<a href='" * 110_000, "&" * 1_000_000,
                                  "<a class='" + "ad-" * 300_000 + "'>x</a>"])
def test_linear_time(page):
    began = time.time()
    op08_main_text.main_text(page)
    assert time.time() - began < 6


def test_broken_tags_keep_their_text():
    assert op08_main_text.main_text("<p>one <b two") == "one <b two"
    assert op08_main_text.main_text("<p>a</p><p title=\"x>b</p><p>c</p>") == "a\nb\nc"
    assert op08_main_text.main_text("<article><p>a < b and c > d</p></article>") == "a < b and c > d"
