"""Operators 5 and 8: pages and conversations."""

import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlane.llm import chat
from emberlane.llm import html as pages


def article_by_hand(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_op5_query(spark, sf_dir):
    want = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = pages.op5_html_text(spark, sf_dir).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.text == article_by_hand(want[r.page_id])
        assert r.n_chars == len(r.text)


LONG = "It was the first of the long days that we had in the house by the sea, and nobody who was there would have said that it was the last of them. " * 2


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), (LONG, LONG.strip()),
        (f"<div id='sidebar'><p>{LONG}</p></div><main><p>{LONG}</p><p>Short.</p></main>", f"{LONG.strip()}\n\nShort."),
        (f"<body><header><p>{LONG}</p></header><article><header><h1>T</h1></header><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></article>", f"T\n\n{LONG.strip()}"),
        (f"<ul><li><a href=x>one</a></li></ul><div><p>{LONG}</p><p>By me.</p></div><form>{LONG}<input></form>", f"{LONG.strip()}\n\nBy me."),
        ("<article><p>a &lt;b&gt; &amp;\n  c<br>d<!-- x --><script>var a='</p>'</script></article>", "a <b> & c d"),
    ],
)
def test_main_text(page, want):
    assert pages.main_text(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<div class='layout has-sidebar'><p>{LONG}</p></div>", LONG.strip()),
        (f"<div class='page nav-open-left'><p>{LONG}</p><div class='related-items-box'><p>Short one.</p></div></div>", LONG.strip()),
        (f"<article><p>{LONG}</p><p class='advert'>{LONG}</p><p>End</article>", f"{LONG.strip()}\n\nEnd"),
        (f"<div><p class=ad>{LONG}<p>{LONG}<div>More.</div></div>", f"{LONG.strip()}\n\nMore."),
        (f"<div class='site-footer'><p>{LONG}</p></div><div class=text><p>{LONG}</p></div>", LONG.strip()),
        (f"<p>{LONG}</p></b></i></div>x<a href='1", f"{LONG.strip()}\n\nx<a href='1"),
        ("<p title=\"a>b\">one</p><p title='it\"s>'>two</p>", "one\n\ntwo"),
    ],
)
def test_names_and_broken_markup(page, want):
    assert pages.main_text(page) == want


def test_tags_as_the_standard_parser_reads_them(spark, sf_dir):
    from html.parser import HTMLParser

    class Tags(HTMLParser):
        def __init__(self):
            super().__init__()
            self.seen = []

        def handle_starttag(self, tag, attrs):
            self.seen.append((False, tag))

        def handle_endtag(self, tag):
            self.seen.append((True, tag))

    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        own = Tags()
        text = re.sub(r"(?s)<(script|style)>.*?</\1>", "", row.html)
        own.feed(text)
        assert [(closing, tag) for _, _, closing, tag, _ in pages.tags_of(text) if tag] == own.seen


@pytest.mark.parametrize("piece", ['<a="', "<a ", "<script ", "</script ", "</div>", "<div>", '<a x="', "<!--", '<p class="', "<p>", "a&lt"])
@pytest.mark.parametrize("end", ["", ">"])
def test_broken_markup_of_a_megabyte(piece, end):
    import time

    start = time.process_time()
    pages.main_text(piece * (1_000_000 // len(piece)) + end)
    assert time.process_time() - start < 5


@pytest.mark.parametrize(
    "text",
    [
        "Pierwsze dni w domu nad morzem były długie i ciche, a nikt z mieszkańców nie powiedział, że będą ostatnimi przed zimą. " * 3,
        "Первые дни в доме у моря были долгими и тихими, и никто из жителей не говорил, что они последние перед зимой. " * 3,
        "海边房子里的最初几天漫长而安静，住在那里的人谁也没有说过这会是冬天来临之前的最后几天。" * 6,
    ],
)
def test_other_languages_without_article(text):
    menu = "".join(f"<li><a href=x>{text[:20]}</a></li>" for _ in range(5))
    page = f"<body><ul>{menu}</ul><div><p>{text}</p><p>{text[:80]}</p></div><div><a href=x>{text}</a></div><footer><p>{text}</p></footer></body>"
    assert pages.main_text(page) == f"{text.strip()}\n\n{text[:80].strip()}"


def test_op5_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, 5), (1, None, None, 5), (2, "u", "<p>" * 5000 + "x", 5), (3, "u", "<" * 20_000, 5)], "page_id long, url string, html string, n_chars int")
    assert pages.extract(rows).count() == 4
    assert pages.extract(rows.where("false")).count() == 0


def test_op8_same_as_sql(same_as_sql):
    same_as_sql(chat.op8_chat_format, chat.ORACLE["op8_chat_format"])


@given(st.text(alphabet="<|\\im_endstart>\n a", max_size=40))
@settings(max_examples=300)
def test_escape_round_trips(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    line = chat.escape_line(text)
    assert "\n" not in line and chat.unescape_line(line) == text


def test_template_compiler():
    show = lambda t, **scope: "".join(p for p, _ in chat.compile_template(t)(scope))
    assert show("{% for x in xs %}{% if loop.first %}[{% endif %}{{ x.a | upper }}{# no #}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}]) == "[PQ"
    assert show("{% if a == 'x' and not b %}1{% elif a %}2{% else %}3{% endif %}", a="x", b=True) == "2"
    assert chat.fold_body(chat.parse("{{ 'a' + 'b' }}c{% if 1 == 1 %}d{% else %}{{ e }}{% endif %}")) == [("print", ("const", "abcd"))]
    for bad in ("{{ a.b() }}", "{{ a | eval }}", "{% import os %}", "{% for x in y %}", "{{ 'a }}", "{{ __import__('os') }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert show("{{ a.__class__ }}{{ a.b }}", a="s") == ""


def test_op8_odd_rows(spark):
    rows = [(1, 0, "user", None, 1), (1, 0, None, "<|im_end|>\n", 1), (1, None, "a\nb<|", "x" * 70_000, 1), (1, 2, "assistant", "é" * 10, 1), (1, 2, "assistant", "é" * 10, 1), (None, 0, "assistant", "q", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.by_conversation(df))).collect()}
    assert got[1].n_turns == 5 and got[1].loss_chars == 20 and got[None].loss_chars == 1
    assert chat.read_back(chat.format_turns(chat.by_conversation(df.where("false")))).count() == 0


def test_attributes_are_read_by_their_own_names():
    """Values and longer names that merely mention a boilerplate name drop nothing; a form around the page is its wrapper."""
    story = "<p>" + "The hills of the north are the home of a people that has kept to its own ways for as long as there are records of it. " * 3 + "</p>"
    for opening in ["<div title='The hidden valley'>", "<div data-x='overflow hidden'>", "<section aria-label='hidden gems'>", "<div title='see class=footer here'>", "<div data-class='ad'>", "<div data-role='header'>", """<div onclick="this.style='display:none'">""", "<form action='/post'>", "<form id=aspnetForm method=post>"]:
        tag = opening[1:].split()[0]
        text = pages.main_text(f"<html><body><nav><a href='/'>Home</a></nav>{opening}{story}</{tag}><footer>All rights reserved</footer></body></html>")
        assert "hills of the north" in text and "Home" not in text and "reserved" not in text, opening
    for opening in ["<div hidden>", "<div class=ad>", "<div CLASS='footer'>", "<div style='display: none'>", "<div aria-hidden=true>", "<form>"]:
        tag = opening[1:-1].split()[0]
        text = pages.main_text(f"<html><body><article>{story}{opening}<p>The name and the address of the reader are to be given here for the list.</p></{tag}></article></body></html>")
        assert "hills of the north" in text and "reader" not in text, opening
    assert "Of northern hills" in pages.main_text(f"<article><div class='text-header'><h1>Of northern hills</h1></div>{story}</article>")
