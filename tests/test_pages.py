"""The tree of a page, its harmless markup over all pages, and the article among menus, cards and link farms."""

import html
import re
import time
from html.parser import HTMLParser

import pytest

from broadsheet.functions import html as H
from broadsheet.functions import readability as R
from broadsheet.functions import tree
from broadsheet.sources.pages import articles

SMALL = "/root/testdata/sf0.01"
PROSE = "A wet spring kept the swifts away, and when they came at last, in the second week of June, the town had stopped looking up. "
LINKS = "".join(f'<li><a href="/p/{k}">Another headline, number {k}, that says a good deal, all in all</a></li>' for k in range(60))


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<p>a<p>b", "<p>a</p><p>b</p>"),
        ("<p>a<div>b</div></p>c", "<p>a</p><div>b</div>c"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>d"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>"),
        ("<h1>a<h2>b</h1>c", "<h1>a</h1><h2>b</h2>c"),
        ("<b><i>x</b>y</i>z", "<b><i>x</i></b><i>y</i>z"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<p>1<b>2<i>3</p>4", "<p>1<b>2<i>3</i></b></p><b><i>4</i></b>"),
        ("<a href=1>x<a href=2>y", '<a href="1">x</a><a href="2">y</a>'),
        ("<table><td><b>x</table>y", "<table><td><b>x</b></td></table>y"),
        ("</div></p>a</b><br></br>", "a<br><br>"),
        ("<b><b><b><b><b>x<p>y", "<b><b><b><b><b>x<p>y</p></b></b></b></b></b>"),
        ("a &lt;b&gt; &amp;amp; &#39;", "a &lt;b&gt; &amp;amp; '"),
    ],
)
def test_trees_as_browsers_build_them(markup, want):
    assert tree.serialised(tree.parse(markup)[0]) == want


@pytest.mark.parametrize("unit", ["<b>x", "<div>x", "<p><b><i><div>x</b>", "<a href=1>x", "<table><td>", "</b></p>x", "<font color=1><font color=2>y<p>"])
def test_work_grows_with_the_page(unit):
    took = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        H.sanitize(unit * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


class Checker(HTMLParser):
    """Fails on markup that isn't nested, or has what isn't allowed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text = [], []

    def handle_starttag(self, tag, attrs):
        assert tag in H.ALLOWED
        assert {k for k, _ in attrs} <= H.KEPT_ATTRIBUTES.get(tag, set()) | {"lang", "title"} | ({"rel"} if tag == "a" else set())
        assert not any((v or "").strip().lower().startswith(("javascript:", "data:", "vbscript:")) for _, v in attrs)
        if tag not in H.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        assert self.open.pop() == tag

    def handle_data(self, data):
        self.text.append(data)


def checked(markup):
    c = Checker()
    c.feed(markup)
    c.close()
    assert c.open == []
    return "".join("".join(c.text).split())


def test_sanitized_pages_keep_all_text_and_nothing_else(spark):
    """All pages, held to their text as regular expressions find it: without scripts, styles, comments and tags."""
    from broadsheet.plans.queries import QUERIES

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r["page_id"]: r["html"] for r in QUERIES["html_sanitize"](spark, SMALL).collect()}
    assert set(got) == set(pages)
    for page_id, markup in pages.items():
        bare = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style)\b.*?</\1>", "", markup)
        assert checked(got[page_id]) == "".join(html.unescape(re.sub(r"(?s)<[^>]*>", "", bare)).split())


@pytest.mark.parametrize(
    "markup",
    ["<b><i>x</b>y</i>", "<script>alert(1)</script>x<style>p{}</style>", "<a href='java&#115;cript:x()' onclick=y>l</a>", "<img src=x onerror=y><iframe src=z>t</iframe>", "<table><tr><td>a<p>b<td>c", "<p><svg><a href='data:x'>v</a></svg>", "<em><p>a</em>b</p>", "<ul><li><b>a<li>b</ul></b>"],
)
def test_misnested_markup_comes_out_nested(markup):
    out = H.sanitize(markup, "https://a.example/")
    checked(out)
    assert H.sanitize(out, "https://a.example/") == out


def story(markup, **more):
    found = H.article(markup, "https://a.example/x", **more)
    return found and found["text"]


BODY = f"<p>{PROSE * 3}</p><p>{PROSE * 2}</p><h2>Later</h2><p>{PROSE * 4}</p>"


def page(content, before="", after=""):
    return f"<html><head><title>t</title></head><body>{before}{content}{after}</body></html>"


@pytest.mark.parametrize("wrap", ['<div class="story">{}</div>', "<td>{}</td>", "<section>{}</section>", "<article>{}</article>", "<div><div><div>{}</div></div></div>", "<form action=/aspx><div>{}</div></form>", "<main>{}</main>"])
def test_a_link_farm_longer_than_the_story_is_not_the_story(wrap):
    """Menus, related headlines and a footer hold more text than the story; the longest container would be all of them."""
    farm = f'<div class="widget-list"><ul>{LINKS}</ul></div><div id="related"><ul>{LINKS}</ul></div>'
    text = story(page(wrap.format(BODY), farm, farm + "<div>Imprint and cookies</div>"))
    assert text is not None and text.count("A wet spring") == 9 and "headline" not in text and "Imprint" not in text


def test_a_story_without_marks_beside_a_marked_card():
    text = story(page(f"<div class=x>{BODY}</div>", "<div><article><p>card, short</p></article></div>"))
    assert text.count("A wet spring") == 9 and "card" not in text


def test_text_between_breaks_counts():
    text = story(page(f"<div id=text>{'<br><br>'.join([PROSE * 2] * 4)}</div>", f"<ul>{LINKS}</ul>"))
    assert text.count("A wet spring") == 8 and "headline" not in text


def test_a_story_that_goes_on_in_a_sibling_is_joined():
    parts = f'<div class="part">{BODY}</div><div class="advert-slot"><a href=/buy>Buy this, now</a></div><div class="part"><p>{PROSE * 2}</p></div><p>{PROSE}</p>'
    text = story(page(f"<div>{parts}</div>", f"<ul>{LINKS}</ul>"))
    assert text.count("A wet spring") == 12 and "Buy" not in text


def test_comments_and_hidden_parts_stay_out():
    more = f'<div class="comments">{"".join(f"<p>{PROSE}</p>" for _ in range(40))}</div><div style="display: none"><p>{PROSE * 5}</p></div><div role="navigation"><p>{PROSE * 5}</p></div><div aria-hidden="true"><p>{PROSE * 9}</p></div>'
    assert story(page(f"<div>{BODY}</div>", "", more)).count("A wet spring") == 9


def test_a_page_named_like_no_content_gets_a_milder_pass():
    assert story(page(f'<div class="sidebar">{BODY}</div>')).count("A wet spring") == 9


def test_navigation_alone_is_no_article():
    assert story(page("<nav><a href='/'>home</a></nav><p>Accept cookies?</p>")) is None
    assert story(page("")) is None and story("") is None
    assert story("<p>x" * (R.MOST_ELEMENTS + 1)) is None


def test_articles_links_are_absolute_and_lazy_images_shown():
    found = H.article(page(f'<div><p>{PROSE * 4}<a href="/next" onclick=x()>on</a></p><p><img src="data:x" data-src="/i.jpg">{PROSE}</p></div>'), "https://a.example/dir/x")
    assert 'href="https://a.example/next"' in found["html"] and 'src="https://a.example/i.jpg"' in found["html"] and "onclick" not in found["html"]


def test_articles_survive_without_their_tag(spark):
    """Every page with its article element made a plain div: the same story comes out of it."""
    df = spark.read.parquet(f"{SMALL}/pages.parquet").selectExpr("page_id", "url", "replace(replace(html, '<article>', '<div>'), '</article>', '</div>') as html", "html as marked")
    bare = {r["page_id"]: r["text"] for r in articles(df).collect()}
    marked = {r["page_id"]: r["text"] for r in articles(df, html_col="marked").collect()}
    assert sum(bare[i] == t for i, t in marked.items() if t) >= 0.97 * sum(t is not None for t in marked.values())


def test_references_cut_before_their_semicolon_stay_where_asked(spark):
    """As the SQL of page_extract reads them; browsers decode &amp alone."""
    story = f"<article><h1>cut &amp</h1><p>{PROSE * 3}a &amp;amp b &lt c &amp; d &#65; e &#65 f &eacute; g &eacute h && &unknown; &#x27;&notit;</p></article>"
    df = spark.createDataFrame([(1, "https://a.example/x", page(story))], "page_id long, url string, html string")
    (asked,), (usual,) = articles(df, markup=False, ended_references=True).collect(), articles(df, markup=False).collect()
    assert asked["text"].startswith("cut &amp A wet") and asked["text"].endswith("a &amp b &lt c & d A e &#65 f é g &eacute h && &unknown; '&notit;")
    assert usual["text"].startswith("cut & A wet")
