"""Pages to evidence rows.

Every site rule only says where the number, the review text and a few counts are; it yields raw
candidates. Counting words, labelling and cleaning up are the same for all sites. Pages are read
once; the rule of a page is chosen by its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import html as H
from ..functions import phone
from ..functions import text as T
from ..functions.numeric import contains_any
from ..functions.once import let, settle
from ..operators import decide

# Host part -> source, tried in this order.
HOSTS = [
    ("spravportal.ru", "spravportal"), ("callfilter.app", "callfilter"), ("zvonili.com", "zvonili"),
    ("moshelovka.onf.ru", "moshelovka"), ("bloha.ru", "bloha"), ("getscam.com", "getscam"), ("znum.ru", "znum"),
    ("prozvonok.ru", "prozvonok"), ("netrubi.ru", "netrubi"), ("zvonkoff.net", "zvonkoff"),
    ("ktozvonil.net", "ktozvonil"), ("znomer.ru", "znomer"), ("phoneregion.ru", "phoneregion"),
    ("callfilter.info", "callfilter_info"), ("scamcall.ru", "scamcall"), ("kto.zvonil.tel", "kto_zvonil_tel"),
    ("zvonili.tel", "kto_zvonil_tel"), ("abonentik.ru", "abonentik"), ("badcall.ru", "badcall"),
]
# Source -> path in front of the number, and how many digits it has.
NUMBER_PATHS = {
    "spravportal": ("/services/who-calls/num/", "10,12"), "callfilter": ("/", "10,12"), "zvonili": ("/phone/", "9,12"),
    "getscam": ("/", "10,12"), "znum": ("/z-", "10,11"), "prozvonok": ("/nomer/", "10,12"),
    "netrubi": ("/nomer/", "10,12"), "zvonkoff": ("/ru/number/", "10,12"), "ktozvonil": ("/nomer/", "10,12"),
    "znomer": ("/", "10,12"), "phoneregion": ("/number/", "10,12"), "callfilter_info": ("/number/", "10,12"),
    "scamcall": ("/phone/", "9,11"), "kto_zvonil_tel": (r"/\+", "10,12"), "abonentik": ("/nomer/", "10,12"),
    "badcall": ("/phones/", "9,12"),
}
# Sites with review blocks: classes, confidence, reliability.
BLOCK_SITES = {
    "znum": (["review_block", "review_text"], 0.62, 0.58),
    "netrubi": (["comment-item"], 0.66, 0.58),
    "ktozvonil": (["post-comments", "blog-comment"], 0.66, 0.58),
    "znomer": (["review", "comment"], 0.55, 0.45),
    "phoneregion": (["item-review", "item-review-header", "review", "comment"], 0.62, 0.58),
}
# Status class of a page -> category.
STATUS_CATEGORY = {
    "scam": "мошенничество", "spam": "спам", "ad": "реклама", "advertising": "реклама", "collector": "коллекторы",
    "survey": "опрос", "hooligan": "хулиганство",
}
# Verdict class of a review -> category, confidence, reliability.
VERDICT_CATEGORY = {
    "scammers": ("мошенничество", 0.84, 0.78), "advertising": ("реклама", 0.72, 0.65),
    "dumb": ("хулиганство", 0.68, 0.60), "dumb-call": ("немой звонок", 0.66, 0.58),
}
# Category link of a page -> category, blocks, confidence.
LINK_CATEGORY = {
    "moshennichestvo-telefonnoe": ("телефонное мошенничество", True, 0.86), "fishing": ("фишинг", True, 0.86),
    "predoplata": ("мошенничество", True, 0.82), "vymogatelstvo": ("вымогательство", True, 0.84),
    "forex": ("мошенничество", True, 0.78), "crypto": ("мошенничество", True, 0.78), "ugrozy": ("угрозы", True, 0.80),
    "virusy": ("фишинг", True, 0.74), "spam": ("спам", False, 0.74), "reklama": ("реклама", False, 0.70),
    "avtoobzvon": ("автоответчик", False, 0.66), "socopros": ("опросы", False, 0.66),
    "kollektory": ("коллекторы", False, 0.72), "navazchivye": ("нежелательный звонок", False, 0.68),
    "hooliganstvo": ("хулиганство", False, 0.70), "podozritelny": ("нежелательный звонок", False, 0.62),
    "telemarketing": ("реклама", False, 0.64), "strakhovki": ("реклама", False, 0.62),
}
UNWANTED = "нежелательный звонок"


def source_of(url: Column) -> Column:
    def named(host: Column) -> Column:
        out = None
        for part, source in HOSTS:
            test = host.contains(part)
            out = F.when(test, source) if out is None else out.when(test, source)
        return out.otherwise(F.lit("unknown"))

    return let(F.lower(H.host(url)), named)


def path_number(digits: Column) -> Column:
    """Number written as plain digits in an address."""
    return let(
        phone.digits(digits),
        lambda d: F.when(d.rlike("^(?:[78][0-9]{10}|[9843][0-9]{9})$"), F.concat(F.lit("+7"), F.right(d, F.lit(10)))),
    )


def number_of_url(source: Column, url: Column) -> Column:
    out = None
    for name, (path, digits) in NUMBER_PATHS.items():
        found = path_number(F.regexp_extract(H.path(url), rf"(?i){path}(\d{{{digits}}})", 1))
        out = F.when(source == name, found) if out is None else out.when(source == name, found)
    return out


def number_links(source: Column, html: Column, text: Column, sources: list[str] | None = None) -> Column:
    """Distinct numbers a page links to, then those in its text."""
    hosts = {}
    for part, name in HOSTS:
        hosts.setdefault(name, part)
    out = None
    for name, (path, digits) in NUMBER_PATHS.items():
        if sources is not None and name not in sources:
            continue
        site = hosts[name].replace(".", r"\.")
        shape = rf"(?i)(?:{site}{path}|href=[\"']{path})(\d{{{digits}}})(?=[\"'/?#<\s]|$)"
        found = F.transform(F.regexp_extract_all(html, F.lit(shape), F.lit(1)), path_number)
        out = F.when(source == name, found) if out is None else out.when(source == name, found)
    none = F.array().cast("array<string>")
    linked = none if out is None else F.coalesce(out, none)
    return F.array_distinct(F.filter(F.concat(linked, H.numbers_in_text(text)), lambda n: n.isNotNull()))


# --- raw candidates ---------------------------------------------------------

_TYPES = [
    ("number", "string"), ("section", "string"), ("categories", "array<string>"), ("fallback", "string"),
    ("negative", "bigint"), ("positive", "bigint"), ("neutral", "bigint"), ("reviews", "bigint"),
    ("count_hits", "boolean"), ("count_positive", "boolean"), ("confidence", "double"), ("fraud_confidence", "double"),
    ("reliability", "double"), ("kind", "string"), ("views", "bigint"), ("dated", "string"), ("sure", "boolean"),
]
_DEFAULTS = {
    "categories": F.array, "negative": 0, "positive": 0, "neutral": 0, "reviews": 0, "count_hits": False,
    "count_positive": False, "kind": "review", "views": 0, "dated": "", "sure": False,
}


def _candidate(**given: object) -> Column:
    """Raw candidate. ``sure`` skips the test for a reputation signal."""
    parts = []
    for name, kind in _TYPES:
        value = given.get(name, _DEFAULTS.get(name))
        value = value() if callable(value) else value
        c = value if isinstance(value, Column) else F.lit(value)
        parts.append(c.cast(kind).alias(name))
    return F.struct(*parts)


def _one(test: Column, candidate: Column) -> Column:
    return F.when(test, F.array(candidate))


def _largest(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda x: x.try_cast("bigint"))), F.lit(0).cast("bigint"))


def _or(text: Column, other: Column) -> Column:
    return F.when(text == "", other).otherwise(text)


class _Page:
    """Columns every rule may use; computed once per page."""

    names = {
        "url": "url", "html": "_html", "text": "_text", "title": "page_title", "description": "_description",
        "number": "_number",
    }

    def __getattr__(self, name: str) -> Column:
        return F.col(self.names[name])


P = _Page()


def _spravportal() -> Column:
    section = _or(
        T.section_between(P.text, ["сводка по отзывам", "отзывы по номеру", "что пишут пользователи"],
                          ["оставьте отзыв", "телефонный код", "информация по оператору"]), P.text)
    number = phone.normalize(F.regexp_extract(P.url, r"/num/(\d{10,12})", 1), False)
    return _one(number.isNotNull(), _candidate(
        number=number, section=section, reviews=T.review_count(P.text), confidence=0.86, views=T.view_count(P.text),
        dated=section, sure=True))


def _callfilter() -> Column:
    section = _or(
        T.section_between(P.text, ["оценки", "категории", "отзывы"], ["похожие телефонные номера", "добавить отзыв"]), P.text)
    neg = _largest(P.text, r"(?iu)(\d+)\s*x\s*отрицатель")
    pos = _largest(P.text, r"(?iu)(\d+)\s*x\s*положитель")
    neu = _largest(P.text, r"(?iu)(\d+)\s*x\s*нейтраль")
    number = phone.normalize(F.regexp_extract(P.url, r"callfilter\.app/(\d{10,12})(?:$|[/?#])", 1), False)
    return _one(number.isNotNull(), _candidate(
        number=number, section=section, fallback=F.when(neg > 0, UNWANTED), negative=neg, positive=pos, neutral=neu,
        reviews=neg + pos + neu, confidence=0.70, views=T.view_count(P.text), dated=section, sure=True))


def _zvonili() -> Column:
    section = T.section_between(P.text, ["отзывы по номеру"], ["похожие номера с отзывами", "похожие номера", "новые отзывы"])
    raw = F.regexp_extract(P.url, r"/phone/(\d{9,12})", 1)
    number = phone.normalize(F.when(raw.rlike("^[78]"), raw).otherwise(F.concat(F.lit("7"), raw)), False)
    return _one(number.isNotNull() & (raw != "") & (section != ""), _candidate(
        number=number, section=section, reviews=T.review_count(P.text), confidence=0.62, views=T.view_count(P.text),
        dated=section, sure=True))


def _moshelovka() -> Column:
    listing = P.url.endswith(".xml") | P.url.contains("sitemap") | F.rtrim(P.url, F.lit("/")).endswith("/blacklist")
    found = H.numbers_in_text(F.concat_ws(" ", P.text, P.url))
    return F.when(~listing, F.transform(found, lambda n: _candidate(
        number=n, section=P.text, fallback="мошенничество", confidence=0.95, kind="blacklist", dated=P.text, sure=True)))


def _bloha() -> Column:
    def of_line(line: Column) -> Column:
        low = F.lower(line)
        hard = contains_any(low, ["мошен", "требуют деньги", "обман", "деньги"])
        soft = contains_any(low, ["спам", "сбрасывают", "звонят", "реклама"])
        cats = F.when(~hard & soft, F.array(F.lit("спам"), F.lit(UNWANTED))).otherwise(F.array(F.lit("мошенничество")))
        conf = F.when(hard, 0.8).when(soft, 0.65).otherwise(0.72)
        return F.transform(H.numbers_in_text(line), lambda n: _candidate(
            number=n, section=line, categories=cats, confidence=conf, kind="blacklist_article", sure=True))

    return F.flatten(F.transform(H.plain_lines(P.html), of_line))


def _getscam() -> Column:
    section = _or(
        T.section_between(P.text, ["отзывы номера телефона", "важная информация"], ["последние проверенные отзывы", "о проекте"]),
        P.text)
    number = phone.normalize(F.regexp_extract(P.url, r"getscam\.com/(\d{10,12})(?:$|[/?#])", 1), False)
    return _one(number.isNotNull(), _candidate(
        number=number, section=section, confidence=0.55, views=T.view_count(P.text), dated=section, sure=True))


def _listed(texts: Column, confidence: float, reliability: float, kind: str) -> Column:
    """Independent reviews: every block with its own numbers."""
    return F.flatten(F.transform(texts, lambda b: F.transform(H.numbers_in_text(b), lambda n: _candidate(
        number=n, section=b, negative=1, count_hits=True, reviews=1, confidence=confidence, reliability=reliability,
        kind=kind))))


def _blocks(classes: list[str], confidence: float, reliability: float) -> Column:
    texts = H.block_texts(P.html, classes)
    section = _or(F.array_join(texts, " "), _or(P.description, P.text))
    detail = _candidate(
        number=P.number, section=section, count_hits=True, count_positive=True, reviews=T.review_count(P.text),
        confidence=confidence, reliability=reliability, views=T.view_count(P.text), dated=section)
    return F.when(P.number.isNotNull(), F.array(detail)).otherwise(
        _listed(texts, confidence, reliability, "listing_review"))


def _ktozvonil() -> Column:
    """Blocks first; title and description count when no block holds a signal."""
    classes, conf, rel = BLOCK_SITES["ktozvonil"]
    texts = F.array_join(H.block_texts(P.html, classes), " ")
    primary = _or(texts, _or(P.description, P.text))
    section = F.concat_ws(" ", P.title, P.description)
    use_primary = T.has_signal(primary, T.evidence_categories(primary))
    second = _candidate(
        number=P.number, section=section, negative=1, count_hits=True, confidence=conf, reliability=rel,
        reviews=F.greatest(T.review_count(P.title), T.review_count(P.text), F.lit(1)),
        sure=H.class_attribute_has(P.html, "label-danger"))
    return F.when(P.number.isNotNull() & ~use_primary, F.array(second)).otherwise(_blocks(classes, conf, rel))


def _prozvonok() -> Column:
    call = H.plain(F.regexp_extract(P.html, r"(?isu)Тип звонка:.*?<span[^>]*>(.*?)</span>", 1))
    top = _or(T.section_between(P.text, ["Рейтинг номера:", "Тип звонка:"], ["какой регион номера", "Последние комментарии"]),
              P.description)
    section = F.trim(F.concat_ws(" ", top, call))
    detail = _one(P.number.isNotNull(), _candidate(
        number=P.number, section=section, negative=1, count_hits=True, reviews=F.greatest(T.review_count(top), F.lit(1)),
        confidence=0.70, reliability=0.65, views=T.view_count(top), dated=section))
    cards = F.regexp_extract_all(
        P.html, F.lit(r'(?is)<div class="card w-100 mb-3">.*?(?=<div class="card w-100 mb-3">|</main>|$)'), F.lit(0))
    listed = F.transform(cards, lambda c: _candidate(
        number=path_number(F.regexp_extract(c, r"""(?i)href=["']/nomer/(\d{10,12})""", 1)), section=H.plain(c), negative=1,
        count_hits=True, reviews=1, confidence=0.70, reliability=0.65, kind="listing_review"))
    none = F.array().cast("array<" + _DDL + ">")
    return F.concat(
        F.coalesce(detail, none), F.when(H.path(P.url).contains("/otzyvy"), listed).otherwise(none))


def _zvonkoff() -> Column:
    tags = F.array_join(H.block_texts(P.html, ["sectionInfo__tags"]), " ")
    section = F.trim(F.concat_ws(" ", P.description, tags))
    forced = F.lower(section).contains("нежелательный") | H.class_attribute_has(P.html, "negative")
    none = F.array().cast("array<" + _DDL + ">")
    detail = _one(P.number.isNotNull(), _candidate(
        number=P.number, section=section, fallback=UNWANTED, negative=1, count_hits=True,
        reviews=F.greatest(T.review_count(P.text), F.lit(1)), confidence=0.68, reliability=0.62, sure=forced))
    return F.concat(F.coalesce(detail, none), _listed(H.block_texts(P.html, ["newReviews__item"]), 0.68, 0.62, "recent_review"))


def _mapped(key: Column, table: dict[str, object]) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)) if out is None else out.when(key == name, F.lit(value))
    return out


def _callfilter_info() -> Column:
    shape = r"""(?i)<div[^>]*class=["']number-status-label\s+status-([\w\-]+)["'][^>]*>([^<]*)"""
    status = F.lower(F.regexp_extract(P.html, shape, 1))
    label = H.plain(F.regexp_extract(P.html, shape, 2))
    info = H.plain(F.regexp_extract(
        P.html, r"""(?is)<div[^>]*class=["']result-info-list[^"']*["'][^>]*>(.*?)<div[^>]*id=["']complaint-form["']""", 1))
    where = _or(info, P.text)
    stated = F.coalesce(F.regexp_extract(where, r"(?iu)Отзывов\s*:?\s*(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    views = F.coalesce(F.regexp_extract(where, r"(?iu)Просмотров\s*:?\s*(\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    comments = F.regexp_extract_all(
        P.html, F.lit(r"""(?is)<div[^>]*class=["']user-comment["'][^>]*>(.*?)</div>\s*</div>\s*</div>"""), F.lit(1))
    section = _or(
        F.array_join(F.filter(F.array(label, info, F.array_join(F.transform(comments, H.plain), " ")), lambda x: x != ""), " "),
        P.text)
    bad = status.isin(list(STATUS_CATEGORY))
    mapped = _mapped(status, STATUS_CATEGORY)
    n = F.size(comments).cast("bigint")
    return _one(P.number.isNotNull(), _candidate(
        number=P.number, section=section, categories=F.array_compact(F.array(mapped)), negative=F.when(bad, n).otherwise(0),
        count_hits=True, count_positive=True, reviews=F.when(stated > 0, stated).otherwise(n),
        confidence=F.when(status == "scam", 0.85).when(bad, 0.74).otherwise(0.65),
        reliability=F.when(bad, 0.78).otherwise(0.62), kind=F.when(status == "scam", "blacklist").otherwise("review"),
        views=views, dated=section, sure=bad | (stated > 0)))


def _verdict_part(key: Column, i: int) -> Column:
    return _mapped(key, {k: v[i] for k, v in VERDICT_CATEGORY.items()})


def _scamcall() -> Column:
    slides = F.filter(F.split(P.html, r"""<div class=["']otziv_slide_item["'][^>]*>"""), lambda _, i: i > 0)
    pair = (
        r"""(?is)<a[^>]+href=["']/phone/(\d{9,11})[^"']*["'][^>]+class=["']otziv_tel["'][^>]*>[\d\s]+</a>\s*"""
        r"""<p[^>]+class=["']review_item review_item_([\w\-]+)["'][^>]*>([^<]+)</p>"""
    )
    said = (
        r"""(?is)<p[^>]+class=["']otziv_person["'][^>]*>([^<]+)</p>\s*<p[^>]+class=["']otziv_desc["'][^>]*>([^<]+)</p>"""
    )

    def of_slide(s: Column) -> Column:
        key = F.lower(F.regexp_extract(s, pair, 2))
        category = _verdict_part(key, 0)
        parts = F.array(
            F.regexp_extract(s, pair, 3), category, H.plain(F.regexp_extract(s, said, 1)), H.plain(F.regexp_extract(s, said, 2)))
        return _candidate(
            number=F.when(category.isNotNull(), path_number(F.regexp_extract(s, pair, 1))),
            section=F.array_join(F.filter(parts, lambda x: x != ""), " "), categories=F.array_compact(F.array(category)),
            negative=1, count_hits=True, reviews=1, confidence=_verdict_part(key, 1), reliability=_verdict_part(key, 2),
            kind="listing_review", sure=True)

    comment = F.regexp_extract(
        P.html, r"""(?is)<div class=["']commentary_item["'][^>]*>(.*?)</div>\s*</div>\s*</div>""", 1)
    rest = F.regexp_extract(P.html, r"""(?is)class="commentary_item"(.*)$""", 1)
    body_html = _or(comment, rest)
    key = F.lower(F.regexp_extract(body_html, r"""(?i)review_item review_item_([\w\-]+)["'][^>]*>([^<]+)""", 1))
    category = _verdict_part(key, 0)
    body = H.plain(body_html)
    main = _one(P.number.isNotNull() & category.isNotNull(), _candidate(
        number=P.number, section=body, categories=F.array_compact(F.array(category)), negative=1, count_hits=True, reviews=1,
        confidence=_verdict_part(key, 1) + 0.05, reliability=_verdict_part(key, 2), dated=body, sure=True))
    none = F.array().cast("array<" + _DDL + ">")
    return F.concat(F.transform(slides, of_slide), F.coalesce(main, none))


def _kto_zvonil_tel() -> Column:
    quotes = F.regexp_extract_all(
        P.html, F.lit(r"""(?is)<blockquote[^>]*class=["']blockquote["'][^>]*>(.*?)</blockquote>"""), F.lit(1))
    said = F.array_join(F.transform(quotes, H.plain), " ")
    stated = F.coalesce(F.regexp_extract(P.title, r"(?iu)Всего\s+(\d+)\s+отзыв", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    n = F.size(quotes).cast("bigint")
    section = _or(F.array_join(F.filter(F.array(P.title, said), lambda x: x != ""), " "), P.text)
    return _one(P.number.isNotNull(), _candidate(
        number=P.number, section=section, negative=n, count_hits=True, count_positive=True, reviews=F.greatest(stated, n),
        confidence=0.66, fraud_confidence=0.78, reliability=0.62, views=T.view_count(P.text), dated=_or(said, P.text),
        sure=(stated > 0) | (n > 0)))


def _abonentik() -> Column:
    slugs = F.transform(F.regexp_extract_all(P.html, F.lit(r"""(?i)href=["']/category/([\w-]+)["']"""), F.lit(1)), F.lower)
    known = F.filter(slugs, lambda s: s.isin(list(LINK_CATEGORY)))
    names = F.transform(known, lambda s: _mapped(s, {k: v[0] for k, v in LINK_CATEGORY.items()}))
    hard = F.size(F.filter(known, lambda s: s.isin([k for k, v in LINK_CATEGORY.items() if v[1]])))
    best = F.array_max(F.transform(known, lambda s: _mapped(s, {k: v[2] for k, v in LINK_CATEGORY.items()})))
    rating = F.coalesce(F.regexp_extract(P.html, r"(\d(?:\.\d)?)\s*из\s*5", 1).try_cast("double"), F.lit(0.0))
    articles = F.regexp_extract_all(
        P.html, F.lit(r'(?is)<article[^>]*class="[^"]*flex flex-col-reverse[^"]*"[^>]*>(.*?)</article>'), F.lit(1))
    said = F.array_join(F.transform(articles, H.plain), " ")
    section = _or(F.array_join(F.filter(F.array(F.array_join(names, " "), said), lambda x: x != ""), " "), P.text)
    conf = F.coalesce(best, F.lit(0.62))
    conf = F.when((hard > 0) & (rating > 0) & (rating <= 2.0), F.least(F.lit(0.92), conf + 0.05)).otherwise(conf)
    conf = F.when(hard >= 2, F.least(F.lit(0.92), conf + 0.04)).otherwise(conf)
    return _one(P.number.isNotNull(), _candidate(
        number=P.number, section=section, categories=F.array_distinct(names), negative=F.size(known), count_hits=True,
        count_positive=True, reviews=F.greatest(F.size(articles), F.lit(1)), confidence=conf,
        reliability=F.when(hard > 0, 0.74).otherwise(0.62), kind=F.when(hard > 0, "blacklist").otherwise("review"),
        dated=_or(said, P.text), sure=F.size(known) > 0))


def _badcall() -> Column:
    def items(colour: str) -> Column:
        shape = rf"""(?is)<li[^>]*class=["']list-group-item\s+list-group-item-{colour}["'][^>]*>(.*?)</li>"""
        return F.regexp_extract_all(P.html, F.lit(shape), F.lit(1))

    danger, warning = items("danger"), items("warning")
    n = F.size(danger) + F.size(warning)
    stated = F.coalesce(F.regexp_extract(P.title, r"(?iu)(\d+)\s+отзыв", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    section = F.array_join(F.transform(F.concat(danger, warning), H.plain), " ")
    no_fraud = T.count_words(section, S.EVIDENCE_FRAUD) == 0
    cats = F.when((F.size(danger) > 0) & no_fraud, F.array(F.lit(UNWANTED))).otherwise(F.array().cast("array<string>"))
    return _one(P.number.isNotNull() & (n > 0), _candidate(
        number=P.number, section=section, categories=cats, negative=F.size(danger), count_hits=True, count_positive=True,
        reviews=F.greatest(stated, n.cast("bigint")), confidence=0.62, fraud_confidence=0.78, reliability=0.55, dated=section,
        sure=True))


_DDL = "struct<" + ",".join(f"{n}:{t}" for n, t in _TYPES) + ">"


_RULES = {
    "spravportal": _spravportal, "callfilter": _callfilter, "zvonili": _zvonili, "moshelovka": _moshelovka,
    "bloha": _bloha, "getscam": _getscam, "prozvonok": _prozvonok, "zvonkoff": _zvonkoff, "ktozvonil": _ktozvonil,
    "callfilter_info": _callfilter_info, "scamcall": _scamcall, "kto_zvonil_tel": _kto_zvonil_tel,
    "abonentik": _abonentik, "badcall": _badcall,
}
SITES = sorted(set(_RULES) | set(BLOCK_SITES))


def _rule(source: str) -> Column:
    return _RULES[source]() if source in _RULES else _blocks(*BLOCK_SITES[source])


def prepare(pages: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Source, number, text, title and description of every page that is a page."""
    base = pages.filter(~H.looks_like_sitemap(F.col("url"), F.col("html")) & ~H.is_antibot(F.col("html")))
    base = settle(base, {"source": source_of(F.col("url"))})
    if sources is not None:
        base = base.filter(F.col("source").isin(sources))
    base = base.withColumn("_html", H.unescape_inner(F.col("html"))).drop("html")
    inner_title = F.regexp_extract("_html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    meta = r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["']([^"']+)"""
    return settle(base, {
        "_text": H.plain(F.col("_html")),
        "page_title": F.trim(inner_title),
        "_description": F.trim(F.regexp_extract("_html", meta, 1)),
        "_number": number_of_url(F.col("source"), F.col("url")),
    })


def raw_candidates(pages: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """Raw candidates of all known sites, in one pass over the pages."""
    chosen = SITES if sources is None else sources
    known = prepare(pages, chosen)
    found = None
    for name in chosen:
        test = F.col("source") == name
        found = F.when(test, _rule(name)) if found is None else found.when(test, _rule(name))
    links = F.size(number_links(F.col("source"), F.col("_html"), F.col("_text"), chosen)).cast("bigint")
    rows = known.select("url", "source", "page_title", F.col("_text").alias("full_text"), links.alias("links"), F.explode(found).alias("c"))
    return rows.filter(F.col("c.number").isNotNull())


#: Fixed value: sites whose evidence keeps the text of the whole page; the others keep what they looked at.
WHOLE_PAGE = ["spravportal", "callfilter", "zvonili", "moshelovka", "bloha", "getscam"]


def _excerpt(column: str, limit: int | None) -> Column:
    return F.substring(column, 1, limit) if limit else F.col(column)


def evidence(pages: DataFrame, sources: list[str] | None = None, text_limit: int | None = None, full_limit: int | None = None) -> DataFrame:
    """Evidence rows. Whole texts are examined and kept; limits cut the kept texts only."""
    rows = raw_candidates(pages, sources).select("url", "source", "page_title", "full_text", "links", "c.*")
    rows = settle(rows, {"section": F.trim(F.regexp_replace("section", r"\s+", " "))})
    rows = rows.withColumn("full_text", F.when(F.col("source").isin(WHOLE_PAGE), F.col("full_text")).otherwise(F.col("section")))
    rows = settle(rows, {
        "_cats": T.evidence_categories(F.col("section")),
        "_fraud": T.count_words(F.col("section"), S.EVIDENCE_FRAUD),
        "_warn": T.count_words(F.col("section"), S.EVIDENCE_WARN),
        "_pos": T.count_words(F.col("section"), S.EVIDENCE_POSITIVE),
    })
    signal = F.exists("_cats", lambda x: ~x.isin(S.NEUTRAL_CATEGORIES)) | (F.col("_fraud") + F.col("_warn") > 0)
    rows = rows.filter(F.col("sure") | signal)
    none = F.array().cast("array<string>")
    empty = (F.size("categories") == 0) & (F.size("_cats") == 0)
    extra = F.when(empty & F.col("fallback").isNotNull(), F.array("fallback")).otherwise(none)
    listed = F.when(F.col("source") == "moshelovka", F.array(F.lit("мошенничество"), F.lit("blacklist"))).otherwise(none)
    before = F.array_sort(F.array_distinct(F.filter(F.concat("categories", "_cats", extra), lambda x: F.trim(x) != "")))
    rows = settle(rows, {"_before": before})
    judged = F.concat_ws(" ", "section", F.array_join("_before", ";"))
    hits = F.col("_fraud") + F.col("_warn")
    rows = settle(rows, {
        "_all": F.array_sort(F.array_distinct(F.concat("_before", listed))),
        "fraud_hits": T.count_words(judged, S.EVIDENCE_FRAUD),
        "warn_hits": T.count_words(judged, S.EVIDENCE_WARN),
        "negative": F.when(F.col("count_hits"), F.greatest("negative", hits)).otherwise(F.col("negative")),
        "positive": F.when(F.col("count_positive"), F.greatest("positive", F.col("_pos"))).otherwise(F.col("positive")),
    })
    votes = F.greatest(F.col("negative") + F.col("positive"), F.lit(1))
    reviews = F.when((F.col("reviews") <= 0) & F.col("count_positive"), votes).otherwise(F.col("reviews"))
    conf = F.when((F.col("_fraud") > 0) & F.col("fraud_confidence").isNotNull(), F.col("fraud_confidence")).otherwise(F.col("confidence"))
    verdict = decide.evidence_label(
        F.col("source"), F.col("fraud_hits"), F.col("warn_hits"), F.col("negative"), F.col("positive"), F.col("neutral"),
        reviews, conf)
    reliability = F.lit(0.5)
    for name, value in S.SOURCE_RELIABILITY.items():
        reliability = F.when(F.col("source") == name, F.lit(value)).otherwise(reliability)
    rows = settle(rows, {"_v": verdict}).filter(F.col("_v").isNotNull())
    cats = F.array_join("_all", ";")
    filled = F.when(cats != "", cats).when(F.col("_v.label_hint") == "WARN", UNWANTED).otherwise("мошенничество")
    return rows.select(
        F.col("number").alias("normalized_number"), "source", "url", F.col("_v.label_hint").alias("label_hint"),
        F.when(F.col("source") == "moshelovka", "blacklist").otherwise(F.col("kind")).alias("evidence_type"),
        _excerpt("section", text_limit).alias("evidence_text"),
        _excerpt("full_text", full_limit).alias("full_text"), "page_title",
        F.col("_v.negative_count").alias("negative_count"), F.col("positive").alias("positive_count"),
        F.col("neutral").alias("neutral_count"), F.col("_v.review_count").alias("review_count"),
        F.col("views").alias("view_count"), F.col("links").alias("related_count"), filled.alias("categories"),
        F.round(F.col("_v.source_confidence"), 2).alias("source_confidence"),
        F.round(F.coalesce("reliability", reliability), 2).alias("source_reliability"),
        T.page_date(F.col("dated")).alias("detail_date"), "fraud_hits", "warn_hits",
    )


# --- keyword parsers --------------------------------------------------------

# Category names looked for in a page.
KNOWN_CATEGORIES = [
    "мошенничество", "мошенники", "спам", "телемаркетинг", "реклама", "коллекторы", "опрос", "банк", "финансовые услуги",
    "робот", "безопасность банка", "нежелательный звонок", "другое",
]
# Words that count as negative, positive and neutral, per site.
KEYWORD_SITES = {
    "neberitrubku": (["отрицатель", "опасн", "мошен", "спам"], ["положитель", "безопасн", "полезн"], ["нейтраль", "неизвест"]),
    "zvonili": (["мошен", "спам", "отрицатель", "опасн", "реклама"], ["полезн", "безопасн", "положитель"], ["неизвест", "нейтраль"]),
}


def _first_number(text: Column, patterns: list[str]) -> Column:
    found = [F.regexp_extract(text, rf"(?isu){p}", 1).try_cast("bigint") for p in patterns]
    return F.coalesce(*found, F.lit(0).cast("bigint"))


def _sum_words(low: Column, words: list[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + T.count_word(low, w)
    return out.cast("bigint")


def keyword_reputation(pages: DataFrame, site: str, number: Column) -> DataFrame:
    """Reputation row of a page from word counts, with graded confidence."""
    base = pages.select("url", number.alias("normalized_number"), H.to_text(F.col("html")).alias("_t"))
    base = base.filter(F.col("normalized_number").isNotNull()).withColumn("_l", F.lower("_t"))
    low = F.col("_l")
    cats = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in KNOWN_CATEGORIES]))), ";")
    base = base.withColumn("categories", cats)
    if site == "moshelovka":
        bare = F.regexp_replace("normalized_number", r"\+", "")
        found = phone.digits(F.col("_t")).contains(bare)
        one = found.cast("bigint")
        zero = F.lit(0).cast("bigint")
        cats = F.when(F.col("categories") == "", "мошенничество").otherwise(F.col("categories"))
        return base.select(
            "normalized_number", F.lit(site).alias("source"), one.alias("negative_count"), zero.alias("positive_count"),
            zero.alias("neutral_count"), one.alias("review_count"), zero.alias("search_volume"), cats.alias("categories"),
            F.when(found, 0.9).otherwise(0.65).alias("source_confidence"), "url")
    bad, good, flat = KEYWORD_SITES[site]
    full = site == "neberitrubku"
    reviews = [r"(\d+)\s+отзыв", r"отзывов\s*[:\-]?\s*(\d+)", r"комментариев\s*[:\-]?\s*(\d+)"] if full else [r"(\d+)\s+отзыв", r"(\d+)\s+комментар"]
    views = [r"(\d+)\s+просмотр", r"просмотров\s*[:\-]?\s*(\d+)", r"запросов\s*[:\-]?\s*(\d+)"] if full else [r"(\d+)\s+просмотр", r"(\d+)\s+запрос"]
    rows = base.withColumns({
        "negative_count": _sum_words(low, bad), "positive_count": _sum_words(low, good), "neutral_count": _sum_words(low, flat),
        "_r": _first_number(F.col("_t"), reviews), "search_volume": _first_number(F.col("_t"), views),
        "_fraud": T.category_flags("categories")["has_fraud_category"],
    })
    votes = F.col("negative_count") + F.col("positive_count") + F.col("neutral_count")
    rows = rows.withColumn("review_count", F.when(F.col("_r") == 0, votes).otherwise(F.col("_r")))
    fraud = F.when(F.col("_fraud") > 0, 0.25).otherwise(0.0)
    if full:
        conf = F.lit(0.35) + F.when(F.col("review_count") >= 5, 0.25).otherwise(0.0) + fraud + F.when(F.col("search_volume") >= 100, 0.15).otherwise(0.0)
    else:
        conf = F.lit(0.3) + F.least(F.col("review_count") / 20.0, F.lit(0.35)) + fraud
    return rows.select(
        "normalized_number", F.lit(site).alias("source"), "negative_count", "positive_count", "neutral_count", "review_count",
        "search_volume", "categories", F.least(conf, F.lit(1.0)).alias("source_confidence"), "url")


# --- directories, posts, apps, states ---------------------------------------


def directory_rows(pages: DataFrame, source: str, suspects: DataFrame) -> DataFrame:
    """Legitimate numbers of directory pages, suspect ones left out; the first page of a number stays."""
    from ..operators.lookup import drop_known

    category = decide.business_category(F.concat_ws(" ", H.title(F.col("html")), H.to_text(F.col("html"))))
    rows = pages.select(
        "url", H.title(F.col("html")).alias("name"), category.alias("category"),
        F.explode(H.numbers_in_html(F.col("html"))).alias("normalized_number"),
    ).withColumn("source", F.lit(source))
    first = rows.groupBy("normalized_number").agg(F.min(F.struct("url", "name", "category", "source")).alias("_r"))
    flat = first.select("normalized_number", "_r.*").withColumn(
        "source_confidence", decide.business_confidence(F.col("category"), F.col("source")))
    exempt = F.col("source").isin("official_whitelist", "official_hotline")
    return drop_known(flat, suspects, "normalized_number", exempt)


def post_candidates(posts: DataFrame, group: int, known: DataFrame, limit: int | None = None) -> DataFrame:
    """Numbers in user posts, known suspects left out, first post of a number kept."""
    from ..sources.feeds import user_posts

    rows = user_posts(posts).select(
        "id", "from_id", T.truncate(F.col("text"), limit).alias("sample_text"),
        F.explode(H.numbers_in_html(F.col("text"))).alias("normalized_number"))
    first = rows.groupBy("normalized_number").agg(F.min(F.struct("id", "from_id", "sample_text")).alias("_r"))
    flat = first.select("normalized_number", F.concat(F.lit(f"wall-{group}_"), F.col("_r.id")).alias("object_id"), "_r.from_id", "_r.sample_text")
    return flat.join(known.select("normalized_number").distinct(), "normalized_number", "left_anti")


def store_page_apps(pages: DataFrame) -> DataFrame:
    """(package, name) pairs of store pages: named links first, then bare links with an empty name."""
    named = r'(?s)href="/store/apps/details\?id=([^"&]+)"[^>]*?(?:aria-label="([^"]*?)"|title="([^"]*?)")'
    bare = r"/store/apps/details\?id=([a-zA-Z][a-zA-Z0-9_]*(?:\.[a-zA-Z][a-zA-Z0-9_]*)+)"
    ids = F.regexp_extract_all("html", F.lit(named), F.lit(1))
    by_label = F.regexp_extract_all("html", F.lit(named), F.lit(2))
    by_title = F.regexp_extract_all("html", F.lit(named), F.lit(3))
    with_name = F.transform(
        F.arrays_zip(ids.alias("i"), by_label.alias("l"), by_title.alias("t")),
        lambda x: F.struct(F.trim(x["i"]).alias("package"), F.trim(F.coalesce(F.nullif(x["l"], F.lit("")), x["t"], F.lit(""))).alias("name")))
    without = F.transform(F.regexp_extract_all("html", F.lit(bare), F.lit(1)), lambda p: F.struct(p.alias("package"), F.lit("").alias("name")))
    rows = pages.select("url", F.posexplode(F.concat(with_name, without)).alias("position", "a")).select("url", "position", "a.*")
    return rows.filter("package <> ''").groupBy("url", "package").agg(F.min_by("name", "position").alias("name"))


# Names under which an app list, a package, a label and a category occur.
APP_LISTS = ["$.body.apps", "$.body.applications", "$.body.content", "$.body.list", "$.data.apps", "$.layoutData"]
APP_KEYS = {
    "package": ["packageName", "package", "appId", "pkgName"],
    "label": ["appName", "name", "appTitle", "displayName", "title"],
    "category": ["categoryName", "category", "categoryTitle", "kindName", "kindTypeName"],
}


def store_json_apps(answers: DataFrame, column: str, fallback_category: str) -> DataFrame:
    """(package, label, category) of JSON answers of app stores; several spellings are accepted."""
    item = "array<map<string,string>>"
    lists = []
    for path in APP_LISTS:
        text = F.get_json_object(column, path)
        if path.endswith("layoutData"):
            blocks = F.from_json(text, "array<struct<dataList:" + item + ">>")
            lists.append(F.flatten(F.transform(blocks, lambda b: b["dataList"])))
        else:
            lists.append(F.from_json(text, item))
    apps = answers.select(F.explode(F.coalesce(*lists)).alias("m"))

    def first(names: list[str]) -> Column:
        return F.trim(F.coalesce(*[F.nullif(F.trim(F.try_element_at("m", F.lit(n))), F.lit("")) for n in names], F.lit("")))

    rows = apps.select(
        first(APP_KEYS["package"]).alias("package"), first(APP_KEYS["label"]).alias("label"),
        first(APP_KEYS["category"]).alias("category"))
    return rows.filter("package <> ''").withColumn(
        "category", F.when(F.col("category") == "", fallback_category).otherwise(F.col("category")))


# Keys of a name, of phones, of a phone inside an object, and of an address.
NAME_KEYS = ["name", "title", "seoname", "displayName", "shortName"]
PHONE_KEYS = ["phones", "phone", "contactPhones", "phoneNumbers"]
PHONE_FIELDS = ["formatted", "number", "value", "text", "raw"]
ADDRESS_KEYS = ["address", "fullAddress", "addr", "oid"]


def harvest_state(states: DataFrame, key: str, column: str) -> DataFrame:
    """Every object of a JSON tree, at any depth, that has a name and a national number.

    One output row per (object, number). The tree of a row is walked where the row is.
    """
    import json
    from collections.abc import Iterator

    import pandas as pd

    def objects(node: object, path: str) -> Iterator[tuple[str, dict]]:
        todo = [(node, path)]
        while todo:
            value, where = todo.pop()
            if isinstance(value, dict):
                yield where, value
                todo += [(v, f"{where}.{k}" if where else k) for k, v in value.items()]
            elif isinstance(value, list):
                todo += [(v, f"{where}[{i}]") for i, v in enumerate(value)]

    def phones(node: dict) -> list[str]:
        out: list[str] = []
        for name in PHONE_KEYS:
            value = node.get(name)
            for entry in value if isinstance(value, list) else [value]:
                if isinstance(entry, str):
                    out.append(entry)
                elif isinstance(entry, dict) and isinstance(value, list):
                    out += [entry[f] for f in PHONE_FIELDS if isinstance(entry.get(f), str)][:1]
        return out

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for own, text in zip(pdf[key], pdf[column]):
                try:
                    tree = json.loads(text)
                except (TypeError, ValueError):
                    continue
                for where, node in objects(tree, ""):
                    name = next((node[k].strip() for k in NAME_KEYS if isinstance(node.get(k), str) and node[k].strip()), None)
                    if name:
                        rows += [(own, where, name, p, any(k in node for k in ADDRESS_KEYS)) for p in phones(node)]
            yield pd.DataFrame(rows, columns=[key, "path", "name", "raw", "has_address"])

    schema = f"{key} {states.schema[key].dataType.simpleString()}, path string, name string, raw string, has_address boolean"
    found = states.select(key, column).mapInPandas(walk, schema)
    number = phone.normalize("raw")
    return found.withColumn("normalized_number", number).filter(phone.is_national("normalized_number")).drop("raw").distinct()


def listed_businesses(pages: DataFrame) -> DataFrame:
    """Names of a JSON-LD item list paired by position with the tel links of the page.

    With more links than names the first link is the portal's own and is skipped.
    """
    blocks = F.regexp_extract_all(
        "html", F.lit(r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    parsed = F.transform(blocks, lambda b: F.from_json(b, "struct<`@type`:string,itemListElement:array<struct<item:struct<name:string>>>>"))
    lists = F.filter(parsed, lambda p: p["@type"] == "ItemList")
    names = F.filter(
        F.flatten(F.transform(lists, lambda p: F.transform(F.coalesce(p["itemListElement"], F.array().cast("array<struct<item:struct<name:string>>>")), lambda e: e["item"]["name"]))),
        lambda n: F.coalesce(n, F.lit("")) != "")
    tel = F.transform(F.regexp_extract_all("html", F.lit(H.TEL_LINK), F.lit(1)), lambda x: phone.normalize(F.trim(x)))
    tel = F.filter(tel, lambda n: F.length(n) == 12)
    rows = pages.select("url", names.alias("n"), tel.alias("t")).filter((F.size("n") > 0) & (F.size("t") > 0))
    rows = rows.withColumn("t", F.when(F.size("t") > F.size("n"), F.expr("slice(t, 2, size(t))")).otherwise(F.col("t")))
    pairs = rows.select("url", F.posexplode(F.arrays_zip("n", "t")).alias("position", "p"))
    pairs = pairs.select("url", "position", F.col("p.n").alias("name"), F.col("p.t").alias("normalized_number")).dropna(subset=["name", "normalized_number"])
    return pairs.filter(~F.substring("normalized_number", 3, 10).rlike(r"^(\d)\1{9}$")).withColumn(
        "category", decide.business_category(F.col("name")))


def source_of_text(url: str) -> str:
    """Source of one address, for choosing rules when a job is written."""
    return next((source for part, source in HOSTS if part in url.lower()), "unknown")
