"""Main text of web pages, with templates found per site.

A page is read once, in one pass whose work is linear in its length, into blocks of text and the element
subtrees over them: menus, footers and all.  Subtrees are hashed and counted per host in Spark.  One that
recurs on `min_pages` different pages of a host, and on `min_share` of the pages of one of its sections (the first
folder of the path) or of all of it, is the site's template and is deleted wherever it stands; for a paragraph, list
item or other leaf of text, and inside what a page itself marks as its article, where authors repeat themselves
too, the share is `inside_share`.  Pages with equal content count once, so copies of one article don't make its paragraphs a template.

Templates that recur too seldom to be told by counting (a host with few pages, a rare menu) leave blocks that
their own markup says are no content: nav, footer, form and the like, ARIA roles, hidden elements, and class
names that are as a whole one of NO_CONTENT.  These go in a second step.  Of what is left, the article is taken
where a page marks one, else its main element, else everything, unless the prose says otherwise (chosen()).
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, written

#: What ends a stretch of a tag: its end, or a quote.
STOP = re.compile("[>\"']")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`]++)))?+""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag, and never of the page.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are no content by their kind.
MARKED = frozenset(
    "aside audio button canvas datalist footer form head iframe map menu nav select svg template video".split()
)
MARKED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Class names and ids, whole ones, that say so.
NO_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsored breadcrumb breadcrumbs comment comments comment-list commentlist respond"
    " cookie-banner cookie-notice footer menu nav navbar navigation newsletter notice pagination popup share share-bar sidebar side-bar".split()
)
#: Class names and ids by which pages without an article or main element mark their content.
MAIN_NAMES = frozenset(
    "content main main-content maincontent article article-body articlebody article-content post post-content post-body entry entry-content story story-body"
    " story-content page-content".split()
)
#: A start tag ends open elements of these kinds up to the given barriers.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
_P_BARRIERS = ("table", "td", "th", "caption", "object", "template", "html")
_INSIDE_P = frozenset("option optgroup body html head tr td th tbody thead tfoot caption legend".split())

#: Elements that hold a piece of text; as long as they hold nothing else, half of the pages must have them.
LEAVES = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 legend li p pre summary td th".split())

#: Where a block stands: in the article, in the main element, in both or elsewhere, and whether its markup says that it is no
#: content.
ARTICLE, MAIN, ELSEWHERE, IS_MARKED = 2, 1, 0, 4
#: Blocks of at least so many characters are prose.
PROSE = 40
#: How many times the prose of an article the main element, and how many times that of both the rest of the page, must have to be
#: taken instead.
MAIN_WINS, REST_WINS = 2, 10


@dataclass
class Page:
    """Blocks in page order, each with its place; subtrees as (hash, first block, end block).  A subtree's hash is odd
    inside what the page marks as its article or main element and for leaves of text, and even elsewhere."""

    blocks: list[str] = field(default_factory=list)
    places: list[int] = field(default_factory=list)
    subtrees: list[tuple[int, int, int]] = field(default_factory=list)


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}


def names_of(found: dict[str, str]) -> list[str]:
    return f"{found.get('class', '')} {found.get('id', '')}".lower().replace("_", "-").split()


def is_marked(tag: str, found: dict[str, str], in_article: bool) -> bool:
    """Whether an element's kind, role, class or id says that it is no content."""
    if tag in MARKED or tag == "header" and not in_article:
        return True
    if not found or tag in ("html", "body"):
        return False
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    return not MARKED_ROLES.isdisjoint(found.get("role", "").lower().split()) or not NO_CONTENT.isdisjoint(names_of(found))


def place_of(tag: str, found: dict[str, str]) -> int:
    if tag in ("article", "main"):
        return ARTICLE if tag == "article" else MAIN
    if tag not in ("div", "section") or not found:
        return ELSEWHERE
    return MAIN if found.get("role", "").lower() == "main" or not MAIN_NAMES.isdisjoint(names_of(found)) else ELSEWHERE


class Scanner:
    """Tags one after the other.  A quote inside a tag runs to its partner.  Once a tag has not ended before the page
    does, quotes count for nothing in the rest of the page, so that a page is scanned twice at most."""

    def __init__(self, source: str) -> None:
        self.source, self.quotes, self.last = source, True, source.rfind(">")

    def next(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """(start, end, tag, rest, whether it ends an element) of the first tag from `at` on; tag "" for comments and
        declarations."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            head = source[start + 1 : start + 2]
            if head in ("!", "?"):
                mark, width = ("-->", 3) if source.startswith("<!--", start) else (">", 1)
                end = source.find(mark, start + 1 + width)
                return start, len(source) if end < 0 else end + width, "", "", False
            ends = head == "/"
            name = NAME.match(source, start + 1 + ends) if start < self.last else None
            if name:
                end = self._end(name.end()) if self.quotes else -1
                if end < 0:
                    self.quotes, end = False, source.find(">", name.end())
                return start, end + 1, name[0].lower(), source[name.end() : end], ends
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """Where the tag's > stands, quoted ones left out, or -1."""
        while m := STOP.search(self.source, at):
            if m[0] == ">":
                return m.start()
            at = self.source.find(m[0], m.end()) + 1
            if not at:
                break
        return -1


def read_page(source: str, host: str = "") -> Page:
    """One pass over the tags, with the implied ends that HTML allows; never fails, whatever the input.

    Only block elements are kept open.  Subtree hashes are the host's own.
    """
    from xxhash import xxh64_intdigest

    page = Page()
    # Open elements: tag, first block, hashes of what they hold, marked, place, whether they hold blocks.
    stack: list[list] = []
    # Where in the stack each kind of element is open.
    opened: dict[str, list[int]] = {}
    text: list[str] = []
    marked = article = main = 0
    # An inline element that is no content: its tag, how many of that tag are open in it, the stack's height then.
    inline: list | None = None

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words:
                page.blocks.append(words)
                page.places.append((ARTICLE if article else 0) | (MAIN if main else 0) | (IS_MARKED if marked else 0))
                if stack:
                    stack[-1][2].append(xxh64_intdigest(words))

    def close(at: int) -> None:
        """Ends the elements from stack[at] on."""
        nonlocal marked, article, main, inline
        while len(stack) > at:
            flush()
            inside = article > 0 or main > 0
            tag, first, hashes, gone, place, held = stack.pop()
            opened[tag].pop()
            marked -= gone
            article -= place == ARTICLE
            main -= place == MAIN
            if len(page.blocks) > first:
                own = xxh64_intdigest(f"{host} {tag}{hashes}")
                leaf = tag in LEAVES and len(page.blocks) == first + 1 and len(hashes) == 1 and not held
                if tag not in ("html", "body", "head"):
                    page.subtrees.append(((own - (own >> 63 << 64)) & -2 | (inside or leaf), first, len(page.blocks)))
                if stack:
                    stack[-1][2].append(own)
                    stack[-1][5] = True
        if inline and len(stack) < inline[2]:
            inline = None

    last = lambda kinds: max((opened[k][-1] for k in kinds if opened.get(k)), default=-1)
    scanner, at = Scanner(source), 0
    while found_tag := scanner.next(at):
        start, end, tag, rest, ends = found_tag
        if inline is None and start > at:
            text.append(source[at:start])
        at = end
        if not tag:
            continue
        if ends:
            if inline and tag == inline[0]:
                inline[1] -= 1
                inline = inline if inline[1] else None
            elif tag in BLOCK:
                if opened.get(tag):
                    close(opened[tag][-1])
                elif tag == "p":
                    flush()
            continue
        if tag in SIBLINGS:
            kinds, barriers = SIBLINGS[tag]
            floor = last(barriers)
            ended = [own[k] for own in (opened.get(kind, ()) for kind in kinds) if (k := bisect_right(own, floor)) < len(own)]
            if ended:
                close(min(ended))
        elif tag == "body" and opened.get("head"):
            close(opened["head"][-1])
        elif tag in BLOCK and tag not in _INSIDE_P and opened.get("p") and opened["p"][-1] > last(_P_BARRIERS):
            close(opened["p"][-1])
        if tag in BLOCK:
            flush()
        elif tag == "br" and inline is None:
            text.append(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            close_tag = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(source, at)
            at = close_tag.end() if close_tag else len(source)
            continue
        if rest.endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "em", "strong", "span"):
            continue
        found = attributes(rest) if rest and not rest.isspace() else {}
        if tag not in BLOCK:
            if inline:
                inline[1] += tag == inline[0]
            elif is_marked(tag, found, article > 0):
                inline = [tag, 1, len(stack)]
            continue
        gone = int(is_marked(tag, found, article > 0))
        place = ELSEWHERE if gone else place_of(tag, found)
        opened.setdefault(tag, []).append(len(stack))
        stack.append([tag, len(page.blocks), [], gone, place, False])
        marked += gone
        article += place == ARTICLE
        main += place == MAIN
    if inline is None and at < len(source):
        text.append(source[at:])
    flush()
    close(0)
    return page


NONE = np.zeros(0, np.int64)


def deleted(page: Page, templates: np.ndarray = NONE) -> np.ndarray:
    """Which blocks stand in a subtree that is a template (sorted hashes)."""
    edges = np.zeros(len(page.blocks) + 1, np.int64)
    if page.subtrees and len(templates):
        own, first, end = np.array(page.subtrees, np.int64).T
        hit = templates[np.minimum(np.searchsorted(templates, own), len(templates) - 1)] == own
        np.add.at(edges, first[hit], 1)
        np.add.at(edges, end[hit], -1)
    return np.cumsum(edges)[:-1] > 0


def chosen(left: list[tuple[str, int]]) -> list[str]:
    """Of (block, place): the article's blocks; those of the main element where it has over MAIN_WINS times the article's
    prose, or there is no article; all of them where the rest has over REST_WINS times the prose of both.  A place without
    any prose counts with all of its text."""
    size = lambda holds: (sum(len(b) for b, p in left if holds(p) and len(b) >= PROSE), sum(len(b) for b, p in left if holds(p)))
    (article, words), (main, main_words) = size(lambda p: p & ARTICLE), size(lambda p: p & MAIN)
    rest = size(lambda p: not p)[0]
    own, own_words, place = (main, main_words, MAIN) if not words or main > MAIN_WINS * (article or words) else (article, words, ARTICLE)
    if not own_words or rest > REST_WINS * (own or own_words):
        return [b for b, _ in left]
    return [b for b, p in left if p & place]


def main_text(page: Page, templates: np.ndarray = NONE) -> str:
    """The page's text: templates go first, then what its markup says is no content."""
    left = [(b, p) for b, p, gone in zip(page.blocks, page.places, deleted(page, templates).tolist(), strict=True) if not gone and not p & IS_MARKED]
    return "\n".join(chosen(left))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def section_of(url: str | None) -> str:
    """The first folder of a url's path, '' for a page that stands in none."""
    try:
        parts = urlsplit(url or "").path.split("/")
    except ValueError:
        return ""
    return parts[1] if len(parts) > 2 else ""


#: Up to so many templates (8 bytes each) go to every executor; beyond it pages find theirs by a join, with the same result.
BROADCAST_TEMPLATES = 4_000_000
#: How many tasks share the pages of one template in that join.
SALTS = 32


def extract_text(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_pages: int = 10,
    min_share: float = 0.05,
    inside_share: float = 0.5,
    broadcast_templates: int = BROADCAST_TEMPLATES,
) -> DataFrame:
    """page_id, url, text, n_chars, template_blocks, marked_blocks for every row of df.

    A subtree on at least `min_pages` different pages of a host, and on `min_share` of those of a section or of the host, is
    its template: sections, languages and layouts each have their own, and what a large host's pages merely happen to
    share is none.  Inside the article, and for leaves of text, the share is `inside_share`.
    template_blocks counts the blocks deleted so, marked_blocks those that only their own markup gave away.

    A null or empty page has an empty text.  A null or odd url belongs to the host ''.  Repeated rows are each
    returned.  Very long pages are read in one pass.  An empty table gives an empty result; other columns are
    ignored.  Hosts of any size are counted by partial sums; no host's pages are gathered.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    kind = dict(rows.dtypes)["page_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, 256):
            urls = batch.column("url").to_pylist()
            hosts = [host_of(u) for u in urls]
            pages = [read_page(x, h) for x, h in zip(batch.column("html").to_pylist(), hosts, strict=True)]
            contents = [xxh64_intdigest(main_text(p)) for p in pages]
            columns = [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(np.arange(number, number + len(pages))),
                pa.array(hosts, pa.string()),
                pa.array([section_of(u) for u in urls], pa.string()),
                pa.array([c - (c >> 63 << 64) for c in contents], pa.int64()),
                pa.array([p.blocks for p in pages], pa.list_(pa.string())),
                pa.array([p.places for p in pages], pa.list_(pa.int8())),
                *(pa.array([[s[j] for s in p.subtrees] for p in pages], pa.list_(t)) for j, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))),
            ]
            number += len(pages)
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "row", "host", "section", "content", "blocks", "places", "hashes", "firsts", "ends"])

    parsed = written(
        arrow_map(rows, read, f"page_id {kind}, url string, row long, host string, section string, content long, blocks array<string>, places array<tinyint>, hashes array<long>, firsts array<int>, ends array<int>")
    )
    templates = written(templates_of(parsed, min_pages, min_share, inside_share, broadcast_templates))
    few = templates.count() <= broadcast_templates
    known = df.sparkSession.sparkContext.broadcast(np.sort(np.array([r["hash"] for r in templates.collect()] if few else [], np.int64)))
    if not few:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        seen = parsed.select("row", F.explode(F.array_distinct("hashes")).alias("hash"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
        hits = seen.join(templates.select("hash", salt), ["hash", "salt"]).groupBy("row").agg(F.collect_list("hash").alias("doomed"))
        parsed = parsed.join(hits, "row", "left")
    else:
        parsed = parsed.withColumn("doomed", F.lit(None).cast("array<long>"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = known.value
        for batch in slices(batches, 256):
            out = []
            for blocks, places, hashes, firsts, ends, doomed in zip(*(batch.column(c).to_pylist() for c in ("blocks", "places", "hashes", "firsts", "ends", "doomed")), strict=True):
                page = Page(blocks, places, list(zip(hashes, firsts, ends, strict=True)))
                own = np.sort(np.array(doomed, np.int64)) if doomed else everywhere
                gone = deleted(page, own)
                out.append((main_text(page, own), int(gone.sum()), sum(1 for p, g in zip(places, gone.tolist(), strict=True) if p & IS_MARKED and not g)))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 3, (pa.string(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], names=["page_id", "url", "text", "template_blocks", "marked_blocks"])

    done = arrow_map(parsed, finish, f"page_id {kind}, url string, text string, template_blocks int, marked_blocks int")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "template_blocks", "marked_blocks")


def templates_of(parsed: DataFrame, min_pages: int, min_share: float, inside_share: float, broadcast_hashes: int = BROADCAST_TEMPLATES) -> DataFrame:
    """The hashes of subtrees that are templates.  Pages with equal content count once in each section.

    Most subtrees are a page's own, so all are first counted by host alone; sections are told apart only for those
    that are on enough pages."""
    each = parsed.select("host", "section", "content", F.explode(F.array_distinct("hashes")).alias("hash"))
    once = each.groupBy("host", "hash", "content").agg(F.lit(1).alias("one"))
    often = written(once.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    keys = often.select("host", "hash")
    held = each.join(F.broadcast(keys) if keys.count() <= broadcast_hashes else keys, ["host", "hash"], "left_semi")
    by_section = held.groupBy("host", "section", "hash", "content").agg(F.lit(1).alias("one")).groupBy("host", "section", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    pages = parsed.groupBy("host", "section", "content").agg(F.lit(1).alias("one")).groupBy("host", "section").agg(F.count("*").alias("pages"))
    pages = written(pages)
    share = F.when(F.col("hash").bitwiseAND(F.lit(1)) == 1, F.lit(inside_share)).otherwise(F.lit(min_share))
    within = by_section.join(pages, ["host", "section"]).where(F.col("n") >= F.col("pages") * share)
    whole = often.join(pages.groupBy("host").agg(F.sum("pages").alias("pages")), "host").where(F.col("n") >= F.col("pages") * share)
    return within.select("hash").unionByName(whole.select("hash")).distinct()
