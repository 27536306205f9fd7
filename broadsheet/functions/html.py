"""HTML transforms, as plain functions; .udfs makes columns of them."""

from __future__ import annotations

import html
import re
import struct
from urllib.parse import urljoin, urlsplit

from .readability import read, text_in
from .tree import Node, ended_references, parse

#: Attributes in which lazy loaders keep an image's source, the likeliest first.
LAZY = ("data-src", "data-lazy-src", "data-original", "data-echo")
#: Elements that mean nothing when empty; list items and table cells are not among them.
PRUNABLE = ("p", "span", "div", "section", "article", "header", "footer", "figure", "em", "strong", "b", "i", "small", "h1", "h2", "h3", "h4", "h5", "h6")
PRUNE_PASSES = 8

#: The elements, attributes and address schemes that the published defaults of an HTML sanitizer allow.
ALLOWED = frozenset(
    "a abbr acronym area article aside b bdi bdo blockquote br caption center cite code col colgroup data dd del details dfn div dl dt em figcaption figure"
    " footer h1 h2 h3 h4 h5 h6 header hgroup hr i img ins kbd li map mark nav ol p pre q rp rt ruby s samp section small span strike strong sub summary sup"
    " table tbody td tfoot th thead time tr tt u ul var wbr".split()
)
VOID = frozenset("area br col hr img wbr".split())
KEPT_ATTRIBUTES = {
    "a": {"href", "hreflang"}, "bdo": {"dir"}, "blockquote": {"cite"}, "col": {"align", "span"}, "colgroup": {"align", "span"}, "del": {"cite", "datetime"},
    "hr": {"align", "size", "width"}, "img": {"align", "alt", "height", "src", "width"}, "ins": {"cite", "datetime"}, "ol": {"start"}, "q": {"cite"},
    "table": {"align", "summary"}, "tbody": {"align"}, "td": {"align", "colspan", "headers", "rowspan"}, "tfoot": {"align"},
    "th": {"align", "colspan", "headers", "rowspan", "scope"}, "thead": {"align"}, "tr": {"align"},
}
URL_ATTRIBUTES = frozenset(("href", "src", "cite"))
SCHEMES = frozenset("bitcoin ftp ftps geo http https im irc ircs magnet mailto mms mx news nntp openpgp4fpr sip sms smsto ssh tel url webcal wtai xmpp".split())

_ATTRIBUTE = re.compile(r"""([\w-]+)\s*=\s*("([^"]*)"|'([^']*)'|[^\s"'>]+)""")


def attribute(tag: str, name: str) -> str | None:
    for m in _ATTRIBUTE.finditer(tag):
        if m[1].lower() == name:
            value = m[3] if m[3] is not None else m[4] if m[4] is not None else m[2]
            return value.strip() or None
    return None


def unlazy(text: str) -> str:
    """Images whose source is missing, inline or blank take the one a lazy loader would have given them."""

    def promoted(m: re.Match) -> str:
        tag = m[0]
        real = next((v for v in (attribute(tag, name) for name in LAZY) if v), None)
        src = attribute(tag, "src")
        if real is None or src and not src.startswith("data:") and "blank.gif" not in src:
            return tag
        bare = re.sub(r"""(?i)\s+src\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", tag).rstrip(">").rstrip("/ ")
        return f'{bare} src="{real.replace(chr(34), "&quot;")}">'

    return re.sub(r"(?i)<img\b[^>]*>", promoted, text)


_EMPTY = re.compile(rf"(?i)<({'|'.join(PRUNABLE)})(?:\s[^>]*)?>\s*</\1>")


def drop_empty(text: str) -> str:
    """Without elements that hold nothing, from the inside out, up to eight layers."""
    for _ in range(PRUNE_PASSES):
        left = _EMPTY.sub("", text)
        if left == text:
            break
        text = left
    return text


def _kept_attributes(node: Node, base: str | None) -> str:
    attrs = node.attrs
    if node.tag == "img":
        real = next((v for v in (attrs.get(name, "").strip() for name in LAZY) if v), None)
        src = attrs.get("src", "").strip()
        if real and (not src or src.startswith("data:") or "blank.gif" in src):
            attrs = {**{k: v for k, v in attrs.items() if k != "src"}, "src": real}
    kept = []
    for name, value in attrs.items():
        if name not in KEPT_ATTRIBUTES.get(node.tag, ()) and name not in ("lang", "title"):
            continue
        if name in URL_ATTRIBUTES:
            value = joined(base, value)
            scheme = value.split(":", 1)[0].lower() if re.match(r"\s*[a-zA-Z][\w+.-]*:", value) else ""
            if scheme.strip() and scheme.strip() not in SCHEMES:
                continue
        kept.append(f' {name}="{html.escape(value)}"')
    if node.tag == "a":
        kept.append(' rel="noopener noreferrer"')
    return "".join(kept)


def harmless(node: Node, base: str | None = None) -> str:
    """Markup of a tree with only harmless elements and attributes: what others hold stays, but for scripts and styles."""
    out: list[str] = []

    def visit(x: Node | str) -> None:
        if isinstance(x, str):
            out.append(html.escape(x, quote=False))
            return
        if x.tag in ("script", "style"):
            return
        allowed = x.tag in ALLOWED
        if allowed:
            out.append(f"<{x.tag}{_kept_attributes(x, base)}>")
        for child in x.children:
            visit(child)
        if allowed and x.tag not in VOID:
            out.append(f"</{x.tag}>")

    visit(node)
    return "".join(out)


def sanitize(text: str, base: str | None = None) -> str:
    """Only harmless elements and attributes, relative addresses made absolute, lazy images shown, empty elements gone.
    The markup is read as browsers read it, so what comes out is well nested."""
    return drop_empty(harmless(parse(text)[0], base))


def joined(base: str | None, href: str) -> str:
    try:
        return urljoin(base, href) if base else href
    except ValueError:
        return href


def text_of(markup: str) -> str:
    """Text without tags; white space collapsed; & < > stay escaped."""
    return " ".join(re.sub(r"<[^>]*>", "", harmless(parse(markup)[0])).split())


def link_tags(text: str) -> list[str]:
    return re.findall(r"(?is)<link\b([^>]*)", text)


def feed_links(text: str) -> list[str]:
    """Addresses of the feeds a page declares, in page order."""
    out = []
    for tag in link_tags(text):
        kind = (attribute(tag, "type") or "").lower()
        if "alternate" in (attribute(tag, "rel") or "").lower() and any(x in kind for x in ("rss+xml", "atom+xml", "feed+json")):
            href = attribute(tag, "href")
            if href:
                out.append(href)
    return out


def icon_links(text: str) -> list[str]:
    """Addresses of the icons a page declares: touch icons, then icons, then shortcut ones."""
    ranked = []
    for tag in link_tags(text):
        rel, href = (attribute(tag, "rel") or "").lower(), attribute(tag, "href")
        rank = 0 if "apple-touch-icon" in rel else 1 if "icon" in rel.split() else 2 if "shortcut" in rel else None
        if rank is not None and href:
            ranked.append((rank, href))
    return [href for _, href in sorted(ranked, key=lambda x: x[0])]


def normal_address(text: str) -> str | None:
    """An address with its scheme, https where none is given; null if it is empty or no web address."""
    text = text.strip()
    full = text if "://" in text else f"https://{text}"
    try:
        parts = urlsplit(full)
        return full if text and parts.scheme in ("http", "https") and parts.hostname else None
    except ValueError:
        return None


def png_size(data: bytes) -> tuple[int, int] | None:
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR" or len(data) < 24:
        return None
    return struct.unpack(">II", data[16:24])


def is_banner(data: bytes) -> bool:
    """Whether a PNG is over one and a half times as long one way as the other."""
    size = png_size(data)
    return bool(size and min(size) and max(size) / min(size) > 1.5)


#: Image kinds that may become icons, and the largest one in bytes.
ICON_TYPES = ("image/png", "image/x-icon", "image/vnd.microsoft.icon", "image/svg+xml", "image/gif", "image/jpeg", "image/webp")
MAX_ICON = 64 * 1024


def icon_uri(content_type: str, data: bytes) -> str | None:
    """A data: address of an icon, or null for what is none."""
    import base64

    kind = content_type.split(";")[0].strip().lower()
    if kind not in ICON_TYPES or not 0 < len(data) <= MAX_ICON or is_banner(data):
        return None
    return f"data:{kind};base64,{base64.b64encode(data).decode()}"


def is_public(address: str) -> bool:
    """Whether an address is on the public internet; what is no address is not."""
    import ipaddress

    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    if ip.version == 6:
        if ip.ipv4_mapped:
            return is_public(str(ip.ipv4_mapped))
        first = int(ip) >> 112
        return not (ip.is_loopback or ip.is_unspecified or first & 0xFE00 == 0xFC00 or first & 0xFFC0 == 0xFE80)
    n = int(ip)
    closed = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.2.0", 24),
              ("192.168.0.0", 16), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4))
    return not any(n >> (32 - bits) == int(ipaddress.ip_address(net)) >> (32 - bits) for net, bits in closed)


def article(markup: str, base: str | None = None, least: int = 200, with_markup: bool = True, ended: bool = False) -> dict[str, str | None] | None:
    """The harmless markup and the text of a page's article, as .readability finds it; null below `least` characters and
    for pages of more elements than it reads.  With `ended`, references without a semicolon stay as they are."""
    found = read(ended_references(markup) if ended else markup)
    text = "" if found is None else text_in(found)
    return None if len(text) < least else {"html": drop_empty(harmless(found, base)) if with_markup else None, "text": text}


def article_only_text(markup: str, base: str | None = None, ended: bool = False) -> dict[str, str | None] | None:
    return article(markup, base, with_markup=False, ended=ended)


def article_text(markup: str, least: int = 200) -> str | None:
    found = article(markup, None, least)
    return found and found["text"]


def closed_address(url: str) -> bool:
    """Whether a url names an address that is not on the public internet.  Names are not looked up here."""
    import ipaddress
    from urllib.parse import urlsplit

    try:
        host = urlsplit(url).hostname or ""
    except ValueError:
        return True
    if host == "localhost" or host.endswith(".localhost"):
        return True
    try:
        ipaddress.ip_address(host)
    except ValueError:
        return False
    return not is_public(host)
