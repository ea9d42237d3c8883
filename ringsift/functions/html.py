"""Page text: markup to text, blocks, links, phone numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phone
from .text import unescape

SCRIPT = r"(?is)<script.*?</script>"
STYLE = r"(?is)<style.*?</style>"
COMMENT = r"(?s)<!--.*?-->"
TAG = r"<[^>]+>"

# Endings of files that are not pages.
STATIC_ENDINGS = (
    ".css .js .ico .svg .png .jpg .jpeg .gif .webp .woff .woff2 .ttf .otf .eot .mp4 .webm .mp3 "
    ".pdf .zip .rar .xml .json .webmanifest .map"
).split()

# The four shapes of a number in running text, tried in this order.
NUMBER_SHAPES = [
    r"\+\s*7[\s\-()\x{A0}]*\d[\d\s\-()\x{A0}]{8,}\d",
    r"8[\s\-()\x{A0}]*\d{3}[\s\-()\x{A0}]*\d[\d\s\-()\x{A0}]{6,}\d",
    r"(?<!\d)7\d{10}(?!\d)",
    r"(?<!\d)8\d{10}(?!\d)",
]
# Numbers in a page source, tried in this order.
TEL_LINK = r"""(?i)href\s*=\s*["']tel:([^"']+)["']"""
FORMATTED = (
    r"(?:\+7|8)[\s\-().\x{A0}]*\d{3}[\s\-().\x{A0}]*\d{3}[\s\-().\x{A0}]*\d{2}[\s\-().\x{A0}]*\d{2}"
)
COMPACT = r"(?<!\d)(?:\+?7|8)\d{10}(?!\d)"


def strip_markup(html: Column) -> Column:
    out = F.coalesce(html, F.lit(""))
    for pattern in (SCRIPT, STYLE, TAG):
        out = F.regexp_replace(out, pattern, " ")
    return out


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def to_text(html: Column) -> Column:
    """Visible text of a page, white space collapsed."""
    return collapse(unescape(strip_markup(html)))


def to_lines(html: Column) -> Column:
    """Visible lines: block ends break lines, empty lines are dropped."""
    out = F.coalesce(html, F.lit(""))
    for pattern in (SCRIPT, STYLE):
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</p>|</li>|</div>|</h\d>", "\n")
    out = unescape(F.regexp_replace(out, TAG, " "))
    lines = F.transform(F.split(out, r"\r\n|[\n\r]"), collapse)
    return F.filter(lines, lambda x: x != "")


def title(html: Column, limit: int | None = None) -> Column:
    """Title without markup, white space collapsed; the whole of it, unless a limit is given."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    text = collapse(unescape(F.regexp_replace(raw, TAG, " ")))
    return F.substring(text, 1, limit) if limit else text


def meta_description(html: Column) -> Column:
    pattern = r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["']([^"']+)"""
    return F.trim(unescape(F.regexp_extract(html, pattern, 1)))


def class_blocks(html: Column, class_name: str) -> Column:
    """Fragments of div, li and article elements whose class holds the name."""
    pattern = (
        r"""(?is)<(?:div|li|article)[^>]+class=["'][^"']*"""
        + _quote(class_name)
        + r"""[^"']*["'][^>]*>.*?</(?:div|li|article)>"""
    )
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(0))


def _quote(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != "_" else ch for ch in text)


def unescape_inner(html: Column) -> Column:
    """Entities of a page resolved in one go, angle brackets kept escaped so that no tag appears."""
    kept = F.regexp_replace(F.coalesce(html, F.lit("")), "(?i)&(lt|gt);", "&amp;$1;")
    return unescape(kept)


def plain(fragment: Column) -> Column:
    """Text of a fragment of an ``unescape_inner`` page."""
    text = strip_markup(fragment)
    text = F.regexp_replace(F.regexp_replace(text, "(?i)&lt;", "<"), "(?i)&gt;", ">")
    return collapse(text)


def plain_lines(html: Column) -> Column:
    """Visible lines of an ``unescape_inner`` page."""
    out = F.coalesce(html, F.lit(""))
    for pattern in (SCRIPT, STYLE):
        out = F.regexp_replace(out, pattern, " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</p>|</li>|</div>|</h\d>", "\n")
    return F.filter(F.transform(F.split(out, r"\r\n|[\n\r]"), plain), lambda x: x != "")


def block_texts(html: Column, class_names: list[str]) -> Column:
    """Texts of all blocks of the classes, class by class; ``unescape_inner`` page."""
    texts = [F.transform(class_blocks(html, name), plain) for name in class_names]
    return F.filter(F.concat(*texts), lambda x: x != "")


def class_attribute_has(html: Column, *needles: str) -> Column:
    """A rendered class attribute holds one of the needles."""
    clean = F.coalesce(html, F.lit(""))
    for pattern in (COMMENT, r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>"):
        clean = F.regexp_replace(clean, pattern, " ")
    found = F.regexp_extract_all(clean, F.lit(r"""(?i)class=["']([^"']+)["']"""), F.lit(1))
    return F.exists(
        found,
        lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(n.lower()) for n in needles]),
    )


def host(url: Column) -> Column:
    """Host with port, as written in the address."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def numbers_in_text(text: Column) -> Column:
    """Distinct canonical numbers in order of shape, then of position."""
    found = [F.regexp_extract_all(text, F.lit(shape), F.lit(0)) for shape in NUMBER_SHAPES]
    numbers = F.transform(F.concat(*found), lambda x: phone.normalize(x, reject_foreign=False))
    return F.array_distinct(
        F.filter(numbers, lambda n: n.isNotNull() & F.length(n).between(11, 13))
    )


def numbers_in_html(html: Column) -> Column:
    """Distinct plausible numbers: tel links first, then formatted, then compact ones."""
    text = unescape(F.coalesce(html, F.lit("")))
    tel = F.transform(
        F.regexp_extract_all(text, F.lit(TEL_LINK), F.lit(1)),
        lambda x: F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x),
    )
    loose = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (FORMATTED, COMPACT)]
    numbers = F.transform(F.concat(tel, *loose), lambda x: phone.normalize(x))
    return F.array_distinct(F.filter(numbers, phone.is_plausible))


def _without_dots(p: Column) -> Column:
    """An absolute path with its "." and ".." segments worked off; the root stays."""
    parts = F.split(p, "/")
    last = F.element_at(parts, -1)

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(done)
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(last.isin(".", ".."), F.concat(kept, F.lit("/"))).otherwise(F.when(kept == "", "/").otherwise(kept))


def links(html: Column, base_url: Column, limit: int | None = None) -> Column:
    """Distinct page links on the host of the page, fragments cut, static files left out; all of them, unless a limit is given."""
    raw = F.regexp_extract_all(
        F.coalesce(html, F.lit("")), F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1)
    )
    base = host(base_url)
    root = F.concat(scheme(base_url), F.lit("://"), base)
    folder = F.regexp_replace(F.coalesce(F.nullif(path(base_url), F.lit("")), F.lit("/")), "[^/]*$", "")

    def on_host(p: Column) -> Column:
        way = F.regexp_extract(p, r"^[^?#]*", 0)
        return F.concat(root, _without_dots(way), F.substr(p, F.length(way) + 1))

    def absolute(h: Column) -> Column:
        return (
            F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme(base_url), F.lit(":"), h))
            .when(h.startswith("/"), on_host(h))
            .when(h.startswith("?"), F.concat(root, path(base_url), h))
            .otherwise(on_host(F.concat(folder, h)))
        )

    def usable(h: Column) -> Column:
        return (F.length(h) > 0) & ~h.rlike(r"^(tel:|mailto:|javascript:|#|data:)")

    # Entities are resolved for all links of a page in one call; no address holds the separator.
    resolved = F.split(unescape(F.array_join(raw, "\x01")), "\x01")
    plain = F.filter(F.transform(resolved, lambda h: F.trim(h)), usable)
    full = F.filter(
        F.transform(plain, absolute),
        lambda u: scheme(u).isin("http", "https")
        & (host(u) == base)
        & ~reduce(lambda a, b: a | b, [F.lower(path(u)).endswith(e) for e in STATIC_ENDINGS]),
    )
    out = F.array_distinct(F.transform(full, lambda u: F.substring_index(u, "#", 1)))
    return F.slice(out, 1, limit) if limit else out


def last_page(html: Column, link_class: str = "pagination-list__link") -> Column:
    """Largest page number in the pagination anchors, at least 1."""
    anchors = F.regexp_extract_all(
        html, F.lit(rf"(?i)<a\b[^>]*{_quote(link_class)}[^>]*>"), F.lit(0)
    )
    pages = F.flatten(
        F.transform(anchors, lambda a: F.regexp_extract_all(a, F.lit(r"(?i)\?page=(\d{1,9})"), F.lit(1)))
    )
    return F.coalesce(
        F.array_max(F.transform(pages, lambda x: x.cast("bigint"))), F.lit(1).cast("bigint")
    )


# How many characters crawlers look at for the marks of a site map and for the words of a
# guard, and the size from which a page is not taken for one guard's. Parameters, off by default.
SITEMAP_HEAD, ANTIBOT_HEAD, ANTIBOT_SIZE = 512, 4000, 5000


def looks_like_sitemap(url: Column, body: Column, head: int | None = None) -> Column:
    """A site map, by its marks or by its address. The whole body counts, or its first ``head`` characters."""
    trimmed = F.regexp_replace(body, r"^\s+", "")
    marks = F.lower(F.substring(trimmed, 1, head) if head else trimmed)
    return F.coalesce(
        marks.contains("<urlset")
        | marks.contains("<sitemapindex")
        | url.endswith(".xml")
        | url.endswith(".xml.gz")
        | (F.lower(url).contains("sitemap") & trimmed.startswith("<?xml")),
        F.lit(False),
    )


def sitemap_locations(url: Column, body: Column) -> Column:
    """Distinct <loc> addresses on the same host, a sub-domain or a parent domain."""
    own = F.lower(host(url))
    found = F.regexp_extract_all(body, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))

    def near(u: Column) -> Column:
        h = F.lower(host(u))
        return u.startswith("http") & (
            (h == "") | (h == own) | h.endswith(F.concat(F.lit("."), own)) | own.endswith(F.concat(F.lit("."), h))
        )

    return F.array_distinct(F.filter(found, near))


def is_antibot(html: Column, head: int | None = None, size: int | None = None) -> Column:
    """A page of a bot guard, by its words. The whole page counts, or its first ``head`` characters; one guard's
    words may be asked for on pages of less than ``size`` characters only."""
    lower = F.lower(F.substring(html, 1, head) if head else html)
    small = F.length(html) < size if size else F.lit(True)
    return F.coalesce(
        (small & lower.contains("проверка браузера"))
        | (lower.contains("cloudflare") & (lower.contains("attention required") | lower.contains("just a moment"))),
        F.lit(False),
    )
