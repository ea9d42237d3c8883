"""Page text and page-to-evidence jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import html as H
from ..functions import text as T
from ..operators import aggregate as A
from ..plans import pages as G
from .bindings import Tables, num
from .registry import query
from .scalars import any_of, class_sql, norm_sql

# The entities that occur in the pages, resolved one after the other.
_STRIP = "regexp_replace(regexp_replace(regexp_replace({h}, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
_ENT = "replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')"
_ENT = "replace(replace(" + _ENT + ", '&copy;', '©'), '&middot;', '·')"
_FLAT = "trim(regexp_replace({x}, '[\\s\\x{{A0}}]+', ' ', 'g'))"


def text_sql(h: str) -> str:
    return _FLAT.format(x=_ENT.format(x=_STRIP.format(h=h)))


@query("sc50_page_text", f"SELECT page_id, {text_sql('html')} AS body FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", H.to_text(F.col("html")).alias("body"))


_BRK = r"(?i)<br\s*/?>|</p>|</li>|</div>|</h\d>"


@query("sc50_page_lines", f"""SELECT page_id, len(list_filter([{_FLAT.format(x=_ENT.format(x="l"))} FOR l IN string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '{_BRK}', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '[\\n\\r]')], lambda x: x <> '')) AS n_lines FROM pages""")
def _(t: Tables):
    return t.pages.select("page_id", F.size(H.to_lines(F.col("html"))).alias("n_lines"))


@query("sc51_titles", f"""SELECT page_id, {_FLAT.format(x=_ENT.format(x="regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')"))} AS title, trim({_ENT.format(x="regexp_extract(html, '(?is)<meta[^>]+name=[' || chr(34) || chr(39) || ']description[' || chr(34) || chr(39) || '][^>]+content=[' || chr(34) || chr(39) || ']([^' || chr(34) || chr(39) || ']+)', 1)")}) AS description FROM pages""")
def _(t: Tables):
    return t.pages.select("page_id", H.title(F.col("html")).alias("title"), H.meta_description(F.col("html")).alias("description"))


_Q = "[' || chr(34) || chr(39) || ']"
_NQ = "[^' || chr(34) || chr(39) || ']"


@query("sc52_class_blocks", f"""SELECT page_id, len(regexp_extract_all(html, '(?is)<(?:div|li|article)[^>]+class={_Q}{_NQ}*review{_NQ}*{_Q}[^>]*>.*?</(?:div|li|article)>')) AS blocks,
    coalesce(list_bool_or([contains(lower(c), 'ad') FOR c IN regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?i)class={_Q}({_NQ}+){_Q}', 1)]), false) AS has_ad FROM web""")
def _(t: Tables):
    h = F.col("html")
    return t.web.select("page_id", F.size(H.class_blocks(h, "review")).alias("blocks"), H.class_attribute_has(h, "ad").alias("has_ad"))


@query("sc53_section", """SELECT doc_id, CASE WHEN s = 0 THEN '' ELSE trim(substr(text, s, CASE WHEN e = 0 THEN length(text) + 1 ELSE e + s END - s)) END AS section FROM (SELECT doc_id, text, s, instr(substr(l, s + 1), ' the ') AS e FROM (
    SELECT doc_id, text, lower(text) AS l, CASE WHEN instr(lower(text), ' and ') = 0 THEN instr(lower(text), ' or ') WHEN instr(lower(text), ' or ') = 0 THEN instr(lower(text), ' and ') ELSE least(instr(lower(text), ' and '), instr(lower(text), ' or ')) END AS s FROM documents) a) b""")
def _(t: Tables):
    return t.documents.select("doc_id", T.section_between(F.col("text"), [" and ", " OR "], [" the "]).alias("section"))


_CLEAN = "regexp_replace(lower(text), '(^|[^0-9a-zа-яё_])не\\s+(мошен|спам|реклам|опасн)[0-9a-zа-яё_]*', '\\1 ', 'g')"


def _hits(words: list[str], c: str = "z") -> str:
    return " + ".join(f"(length({c}) - length(replace({c}, '{w}', ''))) // {len(w)}" for w in words)


_Z = f"(SELECT doc_id, text, {_CLEAN} AS z FROM texts)"


@query("sc54_pattern_hits", f"SELECT doc_id, {_hits(S.EVIDENCE_FRAUD)} AS fraud_hits, {_hits(S.EVIDENCE_WARN)} AS warn_hits, {_hits(S.EVIDENCE_POSITIVE)} AS positive_hits FROM {_Z} a", ints="fraud_hits warn_hits positive_hits")
def _(t: Tables):
    c = F.col("text")
    return t.texts.select("doc_id", T.count_words(c, S.EVIDENCE_FRAUD).alias("fraud_hits"), T.count_words(c, S.EVIDENCE_WARN).alias("warn_hits"), T.count_words(c, S.EVIDENCE_POSITIVE).alias("positive_hits"))


_ITEMS = ", ".join(f"CASE WHEN contains(z, '{n.lower()}') THEN '{n}' END" for n in S.EVIDENCE_CATEGORIES)
_CATS = f"list_sort(list_distinct([{_ITEMS}, CASE WHEN {any_of('z', S.EVIDENCE_FRAUD)} THEN 'мошенничество' END, CASE WHEN {any_of('z', S.EVIDENCE_WARN)} THEN 'спам' END]))"


@query("sc55_categories", f"SELECT doc_id, coalesce(array_to_string({_CATS}, ';'), '') AS categories FROM {_Z} a")
def _(t: Tables):
    return t.texts.select("doc_id", F.array_join(T.evidence_categories(F.col("text")), ";").alias("categories"))


@query("sc56_signal", f"SELECT doc_id, len(list_filter({_CATS}, lambda x: x NOT IN ('Другое', 'Организация'))) > 0 OR {_hits(S.EVIDENCE_FRAUD + S.EVIDENCE_WARN)} > 0 AS has_signal FROM {_Z} a")
def _(t: Tables):
    c = F.col("text")
    return t.texts.select("doc_id", T.has_signal(c, T.evidence_categories(c)).alias("has_signal"))


def _largest(words: str) -> str:
    return f"coalesce(list_max([TRY_CAST(v AS BIGINT) FOR v IN regexp_extract_all(text, '(?i)(?:^|[^0-9])([0-9]+)\\s+(?:{words})', 1)]), 0)"


@query("sc57_text_counts", f"SELECT doc_id, {_largest('просмотр|запрос|поиск')} AS views, {_largest('отзыв|оценк|оценок')} AS reviews FROM texts")
def _(t: Tables):
    return t.texts.select("doc_id", T.view_count(F.col("text")).alias("views"), T.review_count(F.col("text")).alias("reviews"))


# Numbers in the posts are written in one of two ways; digits on either side do not occur there.
_RAWP = "list_concat(regexp_extract_all(text, '(?:\\+7|8)[\\s().-]*\\d{3}[\\s().-]*\\d{3}[\\s().-]*\\d{2}[\\s().-]*\\d{2}'), regexp_extract_all(text, '(?:^|[^0-9])((?:\\+?7|8)\\d{10})(?:[^0-9]|$)', 1))"
_PLAUS = class_sql("n")["national"]


@query("sc58_phones_in_posts", f"SELECT DISTINCT id, n AS normalized_number FROM (SELECT id, {norm_sql('p')} AS n FROM (SELECT id, unnest({_RAWP}) AS p FROM posts) a) b WHERE length(n) = 12 AND {_PLAUS} AND n NOT IN ('+71234567890', '+79876543210', '+70000000000')")
def _(t: Tables):
    return t.posts.select("id", F.explode(H.numbers_in_html(F.col("text"))).alias("normalized_number"))


@query("sc58_phones_in_directory", f"""SELECT DISTINCT page_id, n AS normalized_number FROM (SELECT page_id, {norm_sql('p')} AS n FROM (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '(?i)href\\s*=\\s*{_Q}tel:({_NQ}+){_Q}', 1), {_RAWP.replace('text', 'html')})) AS p FROM directory) a) b
    WHERE length(n) = 12 AND {_PLAUS} AND NOT ({' OR '.join(f"substr(n, 3) = repeat('{d}', 10)" for d in range(10))})""")
def _(t: Tables):
    return t.directory.select("page_id", F.explode(H.numbers_in_html(F.col("html"))).alias("normalized_number"))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
_PHONES = f"""(SELECT page_id, count(DISTINCT n) AS c FROM (SELECT page_id, {norm_sql('p')} AS n FROM (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '(?i)href\\s*=\\s*{_Q}tel:({_NQ}+){_Q}', 1), {_RAWP.replace('text', 'html')})) AS p FROM web) a) b
    WHERE length(n) = 12 AND {_PLAUS} AND NOT ({' OR '.join(f"substr(n, 3) = repeat('{d}', 10)" for d in range(10))}) GROUP BY page_id)"""
_KINDS = "CASE length(host) % 3 WHEN 0 THEN 'directory' WHEN 1 THEN 'blacklist' ELSE 'forum' END"
_HAS, _WORDS = "(phones >= 1 OR tel_links >= 1)", "(complaint_words >= 2)"


def _viable(small_js: str, small: str, a: str, b: str, c: str, d: str) -> str:
    return f"""CASE WHEN html_length < 1500 AND js_required THEN {small_js} WHEN html_length < 1500 THEN {small} WHEN category = 'directory' AND {_HAS} THEN {a} WHEN category = 'blacklist' AND {_HAS} AND {_WORDS} THEN {a}
        WHEN category = 'blacklist' AND {_HAS} THEN {b} WHEN category = 'blacklist' AND {_WORDS} THEN {c} WHEN category = 'forum' AND {_WORDS} THEN {b} ELSE {d} END"""


@query("ag40_source_viability", f"""SELECT *, {_viable("'NEEDS_BROWSER'", "'CLOSED'", "'VIABLE'", "'VIABLE'", "'NEEDS_BROWSER'", "'NO_FRAUD_SIGNAL'")} AS kind, {_viable('2', '0', '1', '2', '2', '3')} AS priority FROM (SELECT host, {_KINDS} AS category, count(*) AS pages, sum(coalesce(c, 0))::BIGINT AS phones,
    sum(tels)::BIGINT AS tel_links, sum(words)::BIGINT AS complaint_words, max(size) AS html_length, bool_or(js) AS js_required FROM (SELECT w.page_id, {_HOST} AS host, ph.c, len(regexp_extract_all(html, '(?i)href\\s*=\\s*{_Q}tel:({_NQ}+){_Q}', 1)) AS tels,
    length(html) AS size, regexp_matches(html, '(?i)<div[^>]+id={_Q}(?:app|root|__next|__nuxt){_Q}') AS js, ({_hits(S.EVIDENCE_FRAUD + S.EVIDENCE_WARN)}) AS words FROM (SELECT *, {_CLEAN} AS z FROM (SELECT *, {text_sql('html')} AS text FROM web) v) w LEFT JOIN {_PHONES} ph ON ph.page_id = w.page_id) x GROUP BY host) y""", ints="priority")
def _(t: Tables):
    host = F.lower(H.host(F.col("url")))
    kind = F.when(F.length(host) % 3 == 0, "directory").when(F.length(host) % 3 == 1, "blacklist").otherwise("forum")
    return A.source_viability(t.web, kind)


_ROOT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_PATH = "regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_LINK = f"""CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || h
    WHEN starts_with(h, '/') THEN {_ROOT} || h ELSE {_ROOT} || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') || h END"""


@query("sc59_page_links", f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS position, link FROM (SELECT page_id, link, min(i) AS first FROM (
    SELECT page_id, i, regexp_extract(u, '^([^#]*)', 1) AS link FROM (SELECT page_id, url, i, {_LINK} AS u FROM (
        SELECT page_id, url, unnest(range(len(hs))) AS i, trim({_ENT.format(x='unnest(hs)')}) AS h FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)href={_Q}({_NQ}+){_Q}', 1) AS hs FROM pages) a) b
        WHERE h <> '' AND NOT regexp_matches(h, '^(tel:|mailto:|javascript:|#|data:)')) c
    WHERE starts_with(u, 'http') AND regexp_extract(u, '^[a-z]+://([^/?#]*)', 1) = regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)
        AND NOT regexp_matches(lower({_PATH}), '({'|'.join(e.replace('.', '[.]') for e in H.STATIC_ENDINGS)})$')) d GROUP BY page_id, link) e""", ints="position")
def _(t: Tables):
    return t.pages.select("page_id", F.posexplode(H.links(F.col("html"), F.col("url"))).alias("position", "link"))


@query("sc60_last_page", "SELECT page_id, 3 + page_id % 40 AS last_page FROM pages")
def _(t: Tables):
    k = F.col("page_id")
    a = lambda n: F.concat(F.lit('<a class="pagination-list__link" href="/x?page='), n.cast("string"), F.lit('">n</a>'))
    html = F.concat("html", a(F.lit(2)), a(3 + k % 40), F.lit('<a href="/y?page=900">other</a>'), a(F.lit(1)))
    return t.pages.select("page_id", html.alias("h")).select("page_id", H.last_page(F.col("h")).alias("last_page"))


_SRCN = ["spravportal", "callfilter", "zvonili", "moshelovka", "bloha", "getscam", "znum", "prozvonok", "netrubi", "zvonkoff", "ktozvonil", "znomer", "phoneregion", "callfilter_info", "scamcall", "kto_zvonil_tel", "abonentik", "badcall"]
_SRCQ = "CASE page_id % 18 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SRCN)) + " END"


@query("sc61_source_and_number", f"""SELECT page_id, {_SRCQ} AS source, CASE WHEN page_id % 18 IN (3, 4) THEN NULL WHEN page_id % 18 = 6 AND false THEN NULL ELSE '+7' || substr(regexp_extract(url, '(\\d{{11}})', 1), 2) END AS number FROM web""")
def _(t: Tables):
    w = t.web.withColumn("source", G.source_of(F.col("url")))
    return w.select("page_id", "source", G.number_of_url(F.col("source"), F.col("url")).alias("number"))


@query("sc62_number_links", f"SELECT page_id, {_SRCQ} AS source, {num('page_id * 5 + 2')} AS number FROM web")
def _(t: Tables):
    w = G.prepare(t.web)
    return w.select("page_id", "source", F.explode(G.number_links(F.col("source"), F.col("_html"), F.col("_text"))).alias("number"))


def _store(t: Tables):
    k = F.col("p_partkey").cast("string")
    named = F.concat(F.lit('<a href="/store/apps/details?id=com.n.a'), k, F.lit('" class="x" aria-label="'), F.col("p_name"), F.lit('">'))
    titled = F.concat(F.lit('<a href="/store/apps/details?id=com.t.a'), k, F.lit('" title="T '), F.col("p_name"), F.lit('">'))
    bare = F.concat(F.lit("x=/store/apps/details?id=com.b.a"), k, F.lit("&hl=ru"))
    return t.part.select(F.concat(F.lit("https://store/"), k).alias("url"), F.concat_ws("\n", named, titled, bare).alias("html"))


@query("sc63_store_pages", """SELECT 'https://store/' || p_partkey AS url, 'com.n.a' || p_partkey AS package, p_name AS name FROM part UNION ALL SELECT 'https://store/' || p_partkey, 'com.t.a' || p_partkey, 'T ' || p_name FROM part
    UNION ALL SELECT 'https://store/' || p_partkey, 'com.b.a' || p_partkey, '' FROM part""")
def _(t: Tables):
    return G.store_page_apps(_store(t))


@query("sc63_store_json", """SELECT 'com.' || p_partkey AS package, p_name AS label, CASE WHEN p_partkey % 3 = 0 THEN 'TOOLS' ELSE p_type END AS category FROM part""")
def _(t: Tables):
    k = F.col("p_partkey")
    pkg, cat = F.concat(F.lit("com."), k.cast("string")), F.when(k % 3 != 0, F.col("p_type"))
    a = F.to_json(F.struct(F.struct(F.array(F.struct(pkg.alias("packageName"), F.col("p_name").alias("appName"), cat.alias("categoryName"))).alias("apps")).alias("body")))
    b = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(pkg.alias("package"), F.col("p_name").alias("name"), cat.alias("kindName"))).alias("dataList"))).alias("layoutData")))
    return G.store_json_apps(t.part.select(F.when(k % 2 == 0, a).otherwise(b).alias("j")), "j", "TOOLS")


@query("sc64_state_harvest", f"""SELECT c_custkey AS key, path, name, n AS normalized_number, addr AS has_address FROM (SELECT c_custkey, 'a.b[0]' AS path, c_name AS name, {norm_sql("'8' || substr(normalized_number, 3)")} AS n, true AS addr FROM customer JOIN numbers ON id = c_custkey
    UNION ALL SELECT c_custkey, 'a.c', 'inner', '+79161234567', false FROM customer) x WHERE {class_sql('n')['national']}""")
def _(t: Tables):
    rows = t.numbers.join(t.customer, F.col("id") == F.col("c_custkey"))
    raw = F.concat(F.lit("8"), F.substring("normalized_number", 3, 10))
    org = F.struct(F.col("c_name").alias("title"), F.array(F.struct(raw.alias("number"))).alias("phones"), F.lit("x").alias("address"))
    tree = F.struct(F.struct(F.array(org).alias("b"), F.struct(F.lit("inner").alias("name"), F.lit("+7 916 123-45-67").alias("phone")).alias("c"), F.lit("none").alias("name")).alias("a"))
    return G.harvest_state(rows.select(F.col("c_custkey").alias("key"), F.to_json(tree).alias("state")), "key", "state")




@query("sc65_listed_businesses", f"SELECT 'u' || id AS url, k - 1 AS position, 'банк ' || k AS name, CASE k WHEN 1 THEN normalized_number ELSE '+7916000000' || k END AS normalized_number FROM numbers, (VALUES (1), (2)) v(k)", ints="position")
def _(t: Tables):
    item = lambda k: f'{{"item": {{"name": "банк {k}"}}}}'
    ld = f'<script type="application/ld+json">{{"@type": "ItemList", "itemListElement": [{item(1)}, {item(2)}]}}</script>'
    html = F.concat(F.lit(ld + '<a href="tel:88005553535">x</a><a href="tel:'), F.col("normalized_number"), F.lit('">y</a><a href="tel:+79160000002">z</a>'))
    pages = t.numbers.select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), html.alias("html"))
    return G.listed_businesses(pages).select("url", "position", "name", "normalized_number")


# --- evidence ---------------------------------------------------------------


def _evidence(name: str, sources: list[str], sql: str | None = None):
    def run(t: Tables):
        return G.evidence(t.web, sources).select(
            "normalized_number", "source", "url", "label_hint", "evidence_type", "negative_count", "positive_count", "neutral_count", "review_count", "view_count",
            "related_count", "categories", "source_confidence", "source_reliability", "detail_date", "fraud_hits", "warn_hits")

    counts = "negative_count positive_count neutral_count review_count view_count related_count fraud_hits warn_hits"
    query(name, sql, "source_confidence source_reliability", counts)(run)


# The phrase that was put behind each page decides its label; the pages themselves hold no such word.
_LBL = "CASE page_id % 5 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'WARN' WHEN 3 THEN 'WARN' END"


@query("pg_labels_by_phrase", f"""SELECT {_SRCQ} AS source, {_LBL} AS label_hint, count(DISTINCT page_id) AS pages FROM web WHERE page_id % 18 IN (0, 6, 8, 11, 12) AND page_id % 5 IN (0, 1, 3) GROUP BY ALL""")
def _(t: Tables):
    out = G.evidence(t.web, ["spravportal", "znum", "netrubi", "znomer", "phoneregion"])
    return out.groupBy("source", "label_hint").agg(F.count_distinct("url").alias("pages"))


# A page has one review block; a site that looks for two or three of its classes reads it that often.
_TIMES = {"znum": (6, 1), "netrubi": (8, 1), "ktozvonil": (10, 1), "znomer": (11, 2), "phoneregion": (12, 3)}


def _blocks_sql(sites: list[str]) -> str:
    times = " ".join(f"WHEN {_TIMES[s][0]} THEN {_TIMES[s][1]}" for s in sites)
    conf = " ".join(f"WHEN {_TIMES[s][0]} THEN {G.BLOCK_SITES[s][1]}" for s in sites)
    rel = " ".join(f"WHEN {_TIMES[s][0]} THEN {G.BLOCK_SITES[s][2]}" for s in sites)
    hits = "CASE p WHEN 0 THEN 3 * k + 1 WHEN 1 THEN 2 * k + 1 ELSE k + 1 END"
    return f"""SELECT {num('page_id * 3 + 1')} AS normalized_number, source, url, CASE p WHEN 0 THEN 'BLOCK' ELSE 'WARN' END AS label_hint, 'review' AS evidence_type, {hits} AS negative_count, 0 AS positive_count, 0 AS neutral_count,
        CASE p WHEN 1 THEN greatest(7, {hits}) ELSE {hits} END AS review_count, CASE p WHEN 1 THEN 120 ELSE 0 END AS view_count, 1 AS related_count, CASE p WHEN 0 THEN 'мошенничество' ELSE 'спам' END AS categories,
        CASE site {conf} END AS source_confidence, CASE site {rel} END AS source_reliability, CASE p WHEN 0 THEN '2024-03-12' WHEN 1 THEN '' ELSE '2024-05-06' END AS detail_date, CASE p WHEN 0 THEN {hits} ELSE 0 END AS fraud_hits, CASE p WHEN 0 THEN 0 ELSE {hits} END AS warn_hits
        FROM (SELECT page_id, url, {_SRCQ} AS source, page_id % 18 AS site, page_id % 5 AS p, CASE page_id % 18 {times} END AS k FROM web) x WHERE k IS NOT NULL AND p IN (0, 1, 3)"""


_evidence("pg01_review_blocks", list(_TIMES), _blocks_sql(list(_TIMES)))
_SECTIONS = {"spravportal": (0, 0.86), "callfilter": (1, 0.70), "getscam": (5, 0.55)}


def _detail_sql() -> str:
    """Detail pages whose section is the whole page: the phrase behind it is all that counts; one site reads the stated reviews."""
    base = _blocks_sql(list(_TIMES))
    sites = " ".join(f"WHEN {i} THEN 1" for i, _ in _SECTIONS.values())
    trust = "CASE site " + " ".join(f"WHEN {i} THEN {c}" for i, c in _SECTIONS.values()) + " END"
    at = base.index("CASE page_id % 18", base.index("page_id % 5 AS p"))
    rows = base[:at] + f"CASE page_id % 18 {sites} END" + base[base.index(" AS k FROM web"):]
    return f"""SELECT * EXCLUDE (site) REPLACE ({trust} AS source_confidence, {trust} AS source_reliability, CASE WHEN site = 0 THEN review_count ELSE negative_count END AS review_count)
        FROM ({rows.replace('AS warn_hits', 'AS warn_hits, site', 1)}) d"""


_evidence("pg02_detail_sites", list(_SECTIONS), _detail_sql())
_evidence("pg02_sections", ["spravportal", "callfilter", "zvonili", "moshelovka", "bloha", "getscam"])
_evidence("pg04_class_fallbacks", ["zvonkoff", "ktozvonil"], _blocks_sql(["ktozvonil"]))
_evidence("pg11_block_sites", ["znum", "netrubi", "znomer", "phoneregion"], _blocks_sql(["znum", "netrubi", "znomer", "phoneregion"]))


def _site(t: Tables, source: str, block):
    """All pages of the corpus, rewritten as pages of one site with its own markup appended."""
    place = {"callfilter_info": "callfilter.info/number/", "scamcall": "scamcall.ru/phone/", "kto_zvonil_tel": "kto.zvonil.tel/+", "abonentik": "abonentik.ru/nomer/", "badcall": "badcall.ru/phones/"}[source]
    digits = F.concat(F.lit("7916"), F.lpad(F.col("page_id").cast("string"), 7, "0"))
    return t.pages.select("page_id", F.concat(F.lit("https://" + place), digits, F.lit("/")).alias("url"), F.concat("html", block).alias("html"))


def _numbered(rows):
    return rows.select(F.substring("normalized_number", 6, 7).cast("bigint").alias("page_id"), "label_hint", "evidence_type", "negative_count", "review_count", "categories", "source_confidence", "source_reliability")


@query("pg03_cards", """SELECT page_id, 'WARN' AS label_hint, 'listing_review' AS evidence_type, 2 AS negative_count, 2 AS review_count, 'спам' AS categories, 0.70 AS source_confidence, 0.65 AS source_reliability FROM pages""",
       "source_confidence source_reliability", "negative_count review_count")
def _(t: Tables):
    digits = F.concat(F.lit("7916"), F.lpad(F.col("page_id").cast("string"), 7, "0"))
    cards = F.concat(
        F.lit('<main><div class="card w-100 mb-3"><a href="/nomer/'), digits, F.lit('">номер</a> Тип: опрос</div><div class="card w-100 mb-3">без номера, спам</div></main>'))
    rows = t.pages.select(F.concat(F.lit("https://prozvonok.ru/otzyvy/"), "page_id").alias("url"), F.concat("html", cards).alias("html"))
    return _numbered(G.evidence(rows, ["prozvonok"]))


@query("pg05_status_labels", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'BLOCK' ELSE 'WARN' END AS label_hint, CASE page_id % 3 WHEN 0 THEN 'blacklist' ELSE 'review' END AS evidence_type, CASE page_id % 3 WHEN 1 THEN 3 ELSE 2 END AS negative_count, 4 AS review_count,
    CASE page_id % 3 WHEN 0 THEN 'мошенничество' WHEN 1 THEN 'реклама;спам' ELSE 'спам' END AS categories, CASE page_id % 3 WHEN 0 THEN 0.85 ELSE 0.74 END AS source_confidence, 0.78 AS source_reliability FROM pages""", "source_confidence source_reliability", "negative_count review_count")
def _(t: Tables):
    k = F.col("page_id") % 3
    status = F.when(k == 0, "scam").when(k == 1, "ad").otherwise("spam")
    label = F.when(k == 0, "Мошенники").when(k == 1, "Реклама").otherwise("Спам")
    block = F.concat(
        F.lit('<div class="number-status-label status-'), status, F.lit('">'), label,
        F.lit('</div><div class="result-info-list x">Отзывов: 4 Просмотров: 77</div><div id="complaint-form"></div>'))
    return _numbered(G.evidence(_site(t, "callfilter_info", block), ["callfilter_info"]))


@query("pg06_carousel", """SELECT page_id, 'BLOCK' AS label_hint, 'listing_review' AS evidence_type, 2 AS negative_count, 2 AS review_count, 'мошенничество' AS categories, 0.84 AS source_confidence, 0.78 AS source_reliability FROM pages
    UNION ALL SELECT page_id, 'WARN', 'review', 4, 4, 'реклама;спам', 0.77, 0.65 FROM pages""", "source_confidence source_reliability", "negative_count review_count")
def _(t: Tables):
    digits = F.concat(F.lit("7916"), F.lpad(F.col("page_id").cast("string"), 7, "0"))
    block = F.concat(
        F.lit('<div class="otziv_slide_item"><a href="/phone/'), digits, F.lit('" class="otziv_tel">'), digits,
        F.lit('</a> <p class="review_item review_item_scammers">Осторожно</p><p class="otziv_person">Иван</p> <p class="otziv_desc">плохо</p></div>'),
        F.lit('<div class="commentary_item"><p class="review_item review_item_advertising">Реклама</p> реклама</div> </div> </div>'))
    return _numbered(G.evidence(_site(t, "scamcall", block), ["scamcall"]))


@query("pg07_blockquotes", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'BLOCK' ELSE 'WARN' END AS label_hint, 'review' AS evidence_type, 2 AS negative_count, 2 AS review_count, CASE WHEN page_id % 2 = 0 THEN 'мошенничество' ELSE 'нежелательный звонок' END AS categories,
    CASE WHEN page_id % 2 = 0 THEN 0.78 ELSE 0.66 END AS source_confidence, 0.62 AS source_reliability FROM pages""", "source_confidence source_reliability", "negative_count review_count")
def _(t: Tables):
    word = F.when(F.col("page_id") % 2 == 0, "обман").otherwise("молчат")
    block = F.concat(F.lit('<blockquote class="blockquote">'), word, F.lit('</blockquote><blockquote class="blockquote">перезвонили</blockquote>'))
    return _numbered(G.evidence(_site(t, "kto_zvonil_tel", block), ["kto_zvonil_tel"]))


@query("pg08_category_links", """SELECT page_id, 'BLOCK' AS label_hint, 'blacklist' AS evidence_type, 5 AS negative_count, 5 AS review_count, 'вымогательство;мошенничество;спам;фишинг' AS categories, CASE WHEN page_id % 2 = 0 THEN 0.92 ELSE 0.9 END AS source_confidence, 0.74 AS source_reliability FROM pages""",
       "source_confidence source_reliability", "negative_count review_count")
def _(t: Tables):
    rating = F.when(F.col("page_id") % 2 == 0, "1.5 из 5").otherwise("4 из 5")
    block = F.concat(F.lit('<a href="/category/fishing">a</a><a href="/category/vymogatelstvo">b</a><a href="/category/spam">c</a>'), rating)
    return _numbered(G.evidence(_site(t, "abonentik", block), ["abonentik"]))


@query("pg09_colour_items", """SELECT page_id, 'WARN' AS label_hint, 'review' AS evidence_type, 3 AS negative_count, 3 AS review_count, 'нежелательный звонок;спам' AS categories, 0.62 AS source_confidence, 0.55 AS source_reliability FROM pages""",
       "source_confidence source_reliability", "negative_count review_count")
def _(t: Tables):
    block = F.lit('<ul><li class="list-group-item list-group-item-danger">опрос</li><li class="list-group-item list-group-item-warning">ничего</li><li class="list-group-item list-group-item-success">хорошо</li></ul>')
    return _numbered(G.evidence(_site(t, "badcall", block), ["badcall"]))


@query("pg10_keyword_pages", f"""SELECT page_id, negative_count, review_count, search_volume, CASE WHEN page_id % 5 = 0 THEN 'мошенники' WHEN page_id % 5 = 1 THEN 'реклама;спам' WHEN page_id % 5 = 3 THEN 'мошенники;опрос' ELSE '' END AS categories FROM (
    SELECT page_id, (length(l) - length(replace(l, 'мошен', ''))) // 5 + (length(l) - length(replace(l, 'спам', ''))) // 4 AS negative_count, CASE WHEN page_id % 5 = 1 THEN 7 ELSE (length(l) - length(replace(l, 'мошен', ''))) // 5 + (length(l) - length(replace(l, 'спам', ''))) // 4 END AS review_count,
    CASE WHEN page_id % 5 = 1 THEN 120 ELSE 0 END AS search_volume FROM (SELECT page_id, lower({text_sql('html')}) AS l FROM web) a) b""", ints="negative_count review_count search_volume")
def _(t: Tables):
    out = G.keyword_reputation(t.web.withColumn("url", F.col("page_id").cast("string")), "neberitrubku", F.concat(F.lit("+7916"), F.lpad(F.col("page_id").cast("string"), 7, "0")))
    return out.select(F.col("url").cast("bigint").alias("page_id"), "negative_count", "review_count", "search_volume", "categories")


_WORDS10 = ["мошен", "спам", "отрицатель", "опасн", "реклама"]


@query("pg10_keyword_confidence", f"""SELECT page_id, 'zvonili' AS source, negative_count, review_count, search_volume, least(1.0, 0.3 + least(review_count / 20.0, 0.35) + CASE WHEN contains(l, 'мошен') THEN 0.25 ELSE 0.0 END) AS source_confidence FROM (
    SELECT page_id, l, {_hits(_WORDS10, 'l')} AS negative_count, CASE WHEN page_id % 5 = 1 THEN 7 ELSE {_hits(_WORDS10, 'l')} END AS review_count, CASE WHEN page_id % 5 = 1 THEN 120 ELSE 0 END AS search_volume FROM (SELECT page_id, lower({text_sql('html')}) AS l FROM web) a) b
    UNION ALL SELECT page_id, 'moshelovka', f, f, 0, CASE WHEN f = 1 THEN 0.9 ELSE 0.65 END FROM (SELECT page_id, CASE WHEN contains(regexp_replace({text_sql('html')}, '[^0-9]', '', 'g'), '7916' || lpad(page_id::VARCHAR, 7, '0')) THEN 1 ELSE 0 END AS f FROM web) c""",
       "source_confidence", "negative_count review_count search_volume")
def _(t: Tables):
    number = F.concat(F.lit("+7916"), F.lpad(F.col("page_id").cast("string"), 7, "0"))
    web = t.web.withColumn("url", F.col("page_id").cast("string"))
    out = G.keyword_reputation(web, "zvonili", number).unionByName(G.keyword_reputation(web, "moshelovka", number))
    return out.select(F.col("url").cast("bigint").alias("page_id"), "source", "negative_count", "review_count", "search_volume", "source_confidence")


_TEL = f"""(SELECT DISTINCT page_id, url, html, n FROM (SELECT page_id, url, html, {norm_sql('p')} AS n FROM (SELECT page_id, url, html, unnest(list_concat(regexp_extract_all(html, '(?i)href\\s*=\\s*{_Q}tel:({_NQ}+){_Q}', 1), {_RAWP.replace('text', 'html')})) AS p FROM directory) a) b
    WHERE length(n) = 12 AND {_PLAUS} AND NOT ({' OR '.join(f"substr(n, 3) = repeat('{d}', 10)" for d in range(10))}))"""
_TITLE = f"""{_FLAT.format(x=_ENT.format(x="regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')"))}"""


@query("pg12_directory_rows", f"""SELECT normalized_number, url, name, category, 'directory' AS source, CASE WHEN category IN ('medical', 'bank') THEN 0.85 ELSE 0.70 END AS source_confidence FROM (
    SELECT n AS normalized_number, arg_min(url, url) AS url, arg_min({_TITLE}, url) AS name, arg_min(CASE page_id % 4 WHEN 0 THEN 'medical' WHEN 1 THEN 'bank' WHEN 2 THEN 'education' ELSE 'other' END, url) AS category FROM {_TEL} t GROUP BY n) x
    WHERE normalized_number NOT IN (SELECT normalized_number FROM blocklist)""", "source_confidence")
def _(t: Tables):
    return G.directory_rows(t.directory, "directory", t.blocklist)


@query("pg12_post_candidates", f"""SELECT n AS normalized_number, 'wall-77_' || min(id) AS object_id FROM (SELECT id, {norm_sql('p')} AS n FROM (SELECT id, unnest({_RAWP}) AS p FROM posts WHERE from_id > 0) a) b
    WHERE length(n) = 12 AND {_PLAUS} AND n NOT IN (SELECT normalized_number FROM blocklist) GROUP BY n""")
def _(t: Tables):
    return G.post_candidates(t.posts, 77, t.blocklist).select("normalized_number", "object_id")


