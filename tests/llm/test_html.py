"""Site templates against a plain count per host, and a reader whose work is linear in the page's length."""

import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import html_text
from broadsheet.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.1"
SCHEMA = "page_id long, url string, html string, host string, hash long, row long, doomed int, salt int"


def pages(spark, rows):
    """Pages with columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, "h", 1, 2, 3, 4) for r in rows], SCHEMA)


def plain(rows, min_pages=10, min_share=0.05, inside_share=0.5):
    """Texts by a count of subtrees per section and per host in plain Python."""
    read = [((html_text.host_of(u), html_text.section_of(u)), html_text.read_page(h or "", html_text.host_of(u))) for _, u, h in rows]
    contents, seen = defaultdict(set), defaultdict(set)
    for (host, section), page in read:
        content = html_text.main_text(page)
        for place in ((host, section), host):
            contents[place].add((section, content))
            for own, _, _ in page.subtrees:
                seen[place, own].add((section, content) if isinstance(place, tuple) else content)
    templates = {own for (place, own), on in seen.items() if len(on) >= min_pages and len(on) >= (inside_share if own % 2 else min_share) * len(contents[place])}
    out = []
    for _, page in read:
        gone = [any(own in templates and a <= k < b for own, a, b in page.subtrees) for k in range(len(page.blocks))]
        left = [(b, p) for b, p, g in zip(page.blocks, page.places, gone, strict=True) if not g and p < 4]
        out.append(("\n".join(html_text.chosen(left)), sum(gone)))
    return out


@pytest.mark.parametrize("most", [10, 0])
def test_templates_match_a_plain_count(spark, most):
    """With the templates sent to all executors, and found by a join instead."""
    df = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    got = {r["page_id"]: r for r in html_text.extract_text(df, min_pages=4, broadcast_templates=10**6 * most).collect()}
    want = plain(rows, min_pages=4)
    assert len(got) == len(rows) and sum(n > 0 for _, n in want) > 50
    for (page_id, _, _), (text, gone) in zip(rows, want, strict=True):
        assert (got[page_id]["text"], got[page_id]["template_blocks"]) == (text, gone)


def test_unmarked_templates_need_the_count(spark):
    """Menus, promotions and footers without telling tags or names: with templates off their text stays on every page."""
    page = lambda i: f"<body><div><p>home</p><p>about {i % 6}</p></div><div><p>text {i} of it</p><p>words</p></div><div><p>promo {i % 3}</p></div></body>"
    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(120)]
    got = {r["page_id"]: (r["text"], r["template_blocks"]) for r in html_text.extract_text(pages(spark, rows)).collect()}
    off = {r["page_id"]: r["text"] for r in html_text.extract_text(pages(spark, rows), min_pages=10**9).collect()}
    assert all(got[i] == (f"text {i} of it", 4) for i in range(120)) and all(off[i] != got[i][0] for i in range(120))


def test_what_recurs_in_articles_stays(spark):
    """A paragraph in a quarter of the articles is the authors' own; a box in every article is the site's."""
    again = lambda i: "<p>as we said before</p>" if i % 4 == 0 else ""
    rows = [(i, "https://a.example/x", f"<article><h1>title {i}</h1>{again(i)}<p>text {i}</p><div><p>join our list</p></div></article>") for i in range(80)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages(spark, rows)).collect()}
    assert all(got[i] == f"title {i}\n" + ("as we said before\n" if i % 4 == 0 else "") + f"text {i}" for i in range(80))


def test_a_large_host_keeps_what_its_pages_happen_to_share(spark):
    """A short paragraph, and a box, on twelve of 2,400 pages stay, and so does a paragraph on a third; a box on all pages of one section of them goes."""
    box = lambda i: "<div><p>go to the market</p><p>see prices</p></div>" if i < 60 else ""
    page = lambda i: f"<body>{box(i)}<div><p>story {i} and so on</p>{'<p>Yes.</p><div><div>as said</div></div>' if i % 200 == 0 else ''}{'<p>More tomorrow.</p>' if i % 3 == 0 else ''}</div></body>"
    rows = [(i, f"https://a.example/{'market' if i < 60 else 'news'}/{i}.html", page(i)) for i in range(2400)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages(spark, rows)).collect()}
    assert all(got[i] == f"story {i} and so on" + ("\nYes.\nas said" if i % 200 == 0 else "") + ("\nMore tomorrow." if i % 3 == 0 else "") for i in range(2400))


def test_the_main_text_is_chosen_by_its_prose():
    read = lambda x: html_text.main_text(html_text.read_page(x))
    story = "".join(f"<p>The long story of the town, part {k}, told from its beginning to its end.</p>" for k in range(5))
    want = "\n".join(f"The long story of the town, part {k}, told from its beginning to its end." for k in range(5))
    assert read(f"<main>{story}</main><div><article>card</article></div>") == want
    assert read(f"<main><p>menu</p><article>{story}</article></main>") == want
    assert read(f"<div>{'<p>A plain line of a list that is rather long, about nothing.</p>' * 8}</div><article>{story}</article>") == want
    assert read(f"<main>{story}<article><p>A short note inside of it</p></article></main>") == want + "\nA short note inside of it"
    assert read(f"<div>{story * 9}</div><article><p>card</p></article>").startswith(want)
    assert read("<article><p>short</p></article><p>other</p>") == "short"


def test_only_what_is_no_content_is_marked():
    read = lambda x: html_text.main_text(html_text.read_page(x))
    assert read("<article><p>Area of a circle is <math><mi>r</mi></math> in short</p></article>") == "Area of a circle is r in short"
    for tag in ("dialog", "object", "noscript"):
        assert read(f"<article><p>a</p><{tag}>b</{tag}></article>").split() == ["a", "b"]


def test_class_names_count_as_a_whole():
    read = lambda x: html_text.main_text(html_text.read_page(x))
    body = '<article><p>Intro</p><div class="related-work"><p>a</p></div><div class="story-social-impact"><p>b</p></div><div class="comments"><p>c</p></div></article>'
    assert read(body) == "Intro\na\nb"
    assert read("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    assert read("<head><title>t</title><body><p class=\"x>a</p><p>b</p>") == "a\nb"


@pytest.mark.parametrize(
    "source",
    ['<div a="' * 130_000, ("<b>" * 20 + "<p>") * 15_000, "<div>" * 200_000 + "x", "<div><li>" * 110_000, "<" * 1_000_000, "<a \"'>" * 170_000, "<div " + 'a="' * 330_000 + ">x", "<a" + " " * 1_000_000 + ">", "<span hidden>" * 80_000, "<table><tr><td>" * 66_000],
    ids=["quotes", "inline", "deep", "lists", "signs", "mixed", "attributes", "blanks", "hidden", "tables"],
)
def test_a_megabyte_of_anything_is_read_in_a_pass(source):
    began = time.process_time()
    page = html_text.read_page(source)
    html_text.main_text(page, np.sort(np.array([s[0] for s in page.subtrees], np.int64)))
    assert time.process_time() - began < 4


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://[", "<p>a</p>"), (None, "https://a.example", "<p>b"), (4, "https://a.example", "x" * 300_000), (4, "https://a.example", "x" * 300_000)]
    got = sorted(((r["page_id"] or 0, r["url"], r["text"], r["n_chars"]) for r in html_text.extract_text(pages(spark, rows)).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (2, "", "", 0), (3, "http://[", "a", 1), (0, "https://a.example", "b", 1), *[(4, "https://a.example", "x" * 300_000, 300_000)] * 2], key=str)
    assert html_text.extract_text(pages(spark, [])).collect() == []


def test_pages_of_the_medium_table(spark):
    got = QUERIES["op8_html_extraction"](spark, MEDIUM)
    assert got.where("n_chars = 0 or n_chars <> length(text)").count() == 0
    assert got.agg(F.sum("marked_blocks")).first()[0] > 0
