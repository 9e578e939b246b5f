"""Main text of hand-made and synthetic pages."""

import html as lib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import extraction
from tessera.llm.queries import op10_extraction

BODY = "This is a sentence of the article, with some words. And another one follows it, as prose does."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p><p>no</p>";</script></head>
<body><header><h2>Site name</h2></header><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Please agree, or leave.</div><div class="ad">Buy now, cheap!</div>
<article><h1>Caf&eacute; &amp; more</h1><p>{BODY}</p><p>Second &lt;b&gt; paragraph,\n with   <b>bold</b><i>italic</i> text.<br>After a break.</p>
<table><tr><td>cell one<td>cell two</table><p>Short.</p><form><input value=q><button>Send</button></form></article>
<aside class=sidebar><p>{BODY}</p></aside><div id="comments"><p>I disagree, said a reader. {BODY}</p></div>
<footer><p>Copyright, all rights reserved. {BODY}</p></footer><script>x()</script></body></html>"""


def test_hand_made_page():
    assert extraction.extract(PAGE).split("\n\n") == [
        "Café & more", BODY, "Second <b> paragraph, with bolditalic text. After a break.", "cell one", "cell two", "Short."]


def test_page_without_article_element():
    page = f"<body><div class=menu><a href=1>one</a> <a href=2>two</a></div><div class=page><div class=text><p>{BODY}</p><p>{BODY} x</p><p>Yes.</p></div><div class=related><ul><li><a href=3>Other</a></ul></div></div></body>"
    assert extraction.extract(page) == f"{BODY}\n\n{BODY} x\n\nYes."


def test_broken_markup():
    assert extraction.extract(f"<p>{BODY}<p>{BODY}<div>unclosed <b>bold").startswith(f"{BODY}\n\n{BODY}")
    assert extraction.extract("<!-- never closed <p>x</p>") == "" and extraction.extract("<script>never closed <p>x</p>") == ""
    assert extraction.extract("plain text only") == "plain text only" and extraction.extract("a < b & c") == "a < b & c"
    assert extraction.extract(None) == "" and extraction.extract("<p></p>") == ""


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("<>/=&;\"' abpdiv!-[]"), max_size=80))
def test_any_markup_ends(page):
    extraction.extract(page)


LEAD = "<nav><a href=1>One</a> <a href=2>Two</a></nav><div class='ad'>Buy now, cheap!</div>"


def article(*parts):
    return "\n\n".join(parts)


def test_the_threshold_decides(monkeypatch):
    """With every path taken as content, what surrounds the article is emitted."""
    found = extraction.extract(PAGE)
    monkeypatch.setattr(extraction, "content_paths", lambda full: ({e.path for e, _ in full}, set()))
    assert len(extraction.extract(PAGE)) > len(found) and "Buy now" in extraction.extract(PAGE)


def test_threshold_tells_plain_containers_apart():
    """Nothing is named here: lengths and punctuation of the paths alone decide."""
    short = "".join(f"<span><i>{w}</i></span> " for w in "home news sport weather contact about imprint".split())
    page = f"<body><div><div>{short}</div></div><div><div><h2>Title</h2><p>{BODY}</p><p>{BODY} And more.</p><p>Yes.</p></div></div><div><div>{short}</div></div></body>"
    assert extraction.extract(page) == article("Title", BODY, f"{BODY} And more.", "Yes.")


def test_names_inside_an_article_do_not_remove_it():
    page = f"<body>{LEAD}<article><h1>Title</h1><p title='the hidden truth'>{BODY}</p><section id='discussion'><p>{BODY}</p></section><p class='legal'>{BODY}</p><p>so <math><mi>x</mi></math> is</p></article></body>"
    assert extraction.extract(page) == article("Title", BODY, BODY, BODY, "so x is")
    hidden = f"<article><p>{BODY}</p><p hidden>a</p><p style='color:red; display:none'>b</p><p aria-hidden=true>c</p><p data-hidden=1>d</p></article>"
    assert extraction.extract(hidden) == article(BODY, "d")


def test_article_in_a_form():
    page = f"<body><form action=x>{LEAD}<div><h1>Title</h1><p>{BODY}</p><p>{BODY}</p><input name=q><button>Send</button></div></form></body>"
    assert extraction.extract(page) == article("Title", BODY, BODY)
    assert extraction.extract(f"<article><p>{BODY}</p><form><p>Your name, please.</p></form></article>") == BODY


def test_comments_go_inside_and_outside():
    note = f"<div class=comments><p>I disagree, said a reader. {BODY}</p></div>"
    assert extraction.extract(f"<body><article><p>{BODY}</p><p>{BODY}</p>{note}</article>{note}</body>") == article(BODY, BODY)


def test_unbalanced_quotes_and_odd_attributes():
    for tag in ("<p title='it's'>", '<p class="x>', "<p class='x>", '<p title="a > b" data-x=\'<b>\'>', "<p title=\">", "<p a='b'c>"):
        assert extraction.extract(f"<article>{tag}{BODY}</p><p class=\"y\">{BODY}</p></article>") == article(BODY, BODY), tag


def test_deep_trees_are_read_in_time():
    for open_ in ("<div>", "<b>", '<b class="x y">', "<p><b>", "<table><tr><td>"):
        start = time.process_time()
        assert extraction.extract(f"<article><p>{BODY}</p>" + open_ * 3000 + f"{BODY}</article>").startswith(BODY)
        assert extraction.extract(open_ * 20_000 + "</i></i>" * 20_000 + BODY) == BODY
        assert time.process_time() - start < 10


def truth(page):
    """The article's paragraphs, for pages of the synthetic table."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|div)>", re.sub(r"<br>", " ", re.sub(r"</?b>", "", inner)))
    return "\n\n".join(x for x in (" ".join(lib.unescape(p).split()) for p in parts) if x)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    got = op10_extraction(spark, d)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    rows = {r.page_id: r for r in got.collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(rows) == len(pages) == 250
    wrong = [p.page_id for p in pages if "<article>" in p.html and rows[p.page_id].text != truth(p.html)]
    assert not wrong, wrong[:5]
    assert all(r.n_chars == len(r.text) for r in rows.values())


def test_defined_results(spark):
    long = "<article>" + f"<p>{BODY}</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + f"<p>{BODY}</p>"
    rows = [(1, None), (2, ""), (3, "<div></div>"), (4, PAGE), (4, PAGE), (None, PAGE), (7, long), (8, deep)]
    pages = spark.createDataFrame([(i, None, h, "t") for i, h in rows], "page_id long, url string, html string, text string")
    got = extraction.extract_pages(pages).collect()
    assert sorted((r.page_id for r in got), key=repr) == sorted((i for i, _ in rows), key=repr)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == by[3].text == "" and by[7].text.count("\n\n") == 19_999 and by[8].text == BODY
    assert extraction.extract_pages(pages.limit(0)).count() == 0
