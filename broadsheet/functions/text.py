"""Text expressions: Column in, Column out, all built in."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters whose canonical form is a plain letter and marks, and those letters."""
    plain = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(x) for x in parts[1:]):
            plain[c] = parts[0]
    return "".join(plain), "".join(plain.values())


ACCENTED, PLAIN = _accents()


def folded(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


_FOLDING = str.maketrans(ACCENTED, PLAIN)


def fold(text: str) -> str:
    """What folded() makes of a text, for queries that come from outside the tables."""
    return text.lower().translate(_FOLDING)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.array_remove(F.split(folded(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def spaced(text: Column) -> Column:
    """The runs of letters and digits of a text in lower case, with spaces between them; plain() of each is a token."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N} ]+", " ")


def plain(word: str) -> str:
    """A lower-case word without the accents of Latin letters; accented and plain letters alike are letters to tokens()."""
    return word if word.isascii() else word.translate(_FOLDING)


def plain_text(html: Column) -> Column:
    """HTML without tags, comments, scripts and styles; white space collapsed; entities stay as they are."""
    bare = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", ""), "\\s+", " "))


def strip_anchors(html: Column) -> Column:
    """HTML without links and their text; an unclosed link takes the rest with it."""
    return F.regexp_replace(html, "(?is)<a(?=[\\s>]|$).*?(</a>|$)", "")


def strip_labels(text: Column) -> Column:
    """Text without the up to two words before each colon; without a colon it stays as it is."""
    parts = F.split(text, ":")
    words = lambda s: F.filter(F.split(F.trim(s), "\\s+"), lambda w: w != "")
    before = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda s: F.slice(words(s), 1, F.greatest(F.size(words(s)) - 2, F.lit(0))))
    kept = F.concat(F.flatten(before), words(F.element_at(parts, -1)))
    return F.when(F.contains(text, F.lit(":")), F.array_join(kept, " ")).otherwise(text)


def has_media(html: Column) -> Column:
    return html.rlike("(?i)<(img|video|audio|picture|iframe|figure)")


#: Characters of prose below which a body carries no article.
MIN_PROSE = 40
#: Characters of text below which a body counts as cut short.
FULL_TEXT = 400

#: How a publisher's closing link begins when it leads to the rest of the article.
CONTINUATIONS = ("keep reading", "read more", "read the full", "read the rest", "continue reading", "read on", "full story", "view full")


def is_stub(html: Column) -> Column:
    """Whether a body is only links and labels: no media, and no prose left once those are gone."""
    prose = F.trim(strip_labels(plain_text(strip_anchors(html))))
    short = F.length(plain_text(html)) < MIN_PROSE
    return ~has_media(html) & F.when(short, prose == "").otherwise(F.length(prose) < MIN_PROSE)


def says_truncated(html: Column) -> Column:
    """Whether a body ends in a link after an ellipsis, or in one that leads to the rest."""
    last = "(?is)^(.*)(<a(?:(?!<a).)*?</a>)[\\s<>/\\p{L}]*$"
    before, link = F.regexp_extract(html, last, 1), F.regexp_extract(html, last, 2)
    lead = F.lower(plain_text(link)).rlike("^(" + "|".join(CONTINUATIONS) + ")")
    return (link != "") & (F.rtrim(before).rlike("(\\.\\.\\.|…|…</p>)\\s*$") | lead)


def is_truncated(html: Column, text: Column, from_summary: Column) -> Column:
    return from_summary | F.coalesce(F.length(text) < FULL_TEXT, F.lit(True)) | F.coalesce(says_truncated(html), F.lit(False))


def normal_tags(tags: Column) -> Column:
    """At most four lower-case tags of 1 to 32 characters, the first of equals; null if none is left."""
    clean = F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: (t != "") & (F.length(t) <= 32))
    kept = F.slice(F.array_distinct(clean), 1, 4)
    return F.when(F.size(kept) > 0, kept)


def repaired_json(answer: Column) -> Column:
    """The outermost object or list of an answer, whatever stands around it; the answer itself if there is none."""
    first = F.regexp_extract(answer, "[{\\[]", 0)
    found = F.when(first == "{", F.regexp_extract(answer, "(?s)\\{.*\\}", 0)).when(first == "[", F.regexp_extract(answer, "(?s)\\[.*\\]", 0))
    return F.coalesce(F.nullif(found, F.lit("")), answer)


def embed_input(title: Column, body: Column, most: int = 2000) -> Column:
    """The title, and after an empty line the body's first characters if it has any."""
    text = F.trim(F.coalesce(body, F.lit("")))
    return F.when(text == "", F.trim(title)).otherwise(F.concat(F.trim(title), F.lit("\n\n"), F.left(text, F.lit(most))))


def item_prompt(feed_title: Column, title: Column, body: Column, most: int = 4000) -> Column:
    head = F.concat(F.lit("Feed: "), feed_title, F.lit("\nTitle: "), title, F.lit("\n"))
    return F.when(body.isNull(), head).otherwise(F.concat(head, F.lit("\n"), F.left(body, F.lit(most))))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "mid").when(score.isNotNull(), "low")


def relative_age(then: Column, now: Column) -> Column:
    """now, minutes, hours, days below a week, else the date."""
    s = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(then.cast("timestamp"))
    whole = lambda n: F.floor(s / n).cast("string")
    return (
        F.when(s < 60, "now")
        .when(s < 3600, F.concat(whole(60), F.lit("m")))
        .when(s < 86400, F.concat(whole(3600), F.lit("h")))
        .when(s < 7 * 86400, F.concat(whole(86400), F.lit("d")))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clamp(x: Column, low: int, high: int) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def shown_title(custom: Column, title: Column, url: Column) -> Column:
    return F.coalesce(F.nullif(custom, F.lit("")), F.nullif(title, F.lit("")), url)


def same_headline(title: Column) -> Column:
    """What titles are compared by: lower case, straight quotes, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(title), "‘’“”", "''\"\""), "\\s+", " "))


def retry_after_seconds(raw: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a count, or an HTTP date (a past one gives 0); else null."""
    text = F.trim(raw)
    count = F.when(text.rlike("^\\+?[0-9]+$"), F.try_to_number(F.regexp_replace(text, "\\+", ""), F.lit("999999999999999999")).cast("long"))
    date = F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, | (GMT|UTC|\\+0000)$", ""), F.lit("d MMM yyyy HH:mm:ss"))
    wait = F.greatest(F.lit(0), F.unix_seconds(date) - F.unix_seconds(now.cast("timestamp")))
    return F.coalesce(count, F.when(date.isNotNull(), wait)).cast("long")


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))
