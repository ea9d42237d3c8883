"""The driver's tables as the tables of this library.

Every view is plain SQL over whole tables and is written once for both engines; ``{ms(x)}`` is the
only spot where they differ. Views may build on other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def num(k: str) -> str:
    """Number of a key: eight codes, the last one invalid; key 0 is a placeholder."""
    return (
        f"concat('+7', CASE CAST({k} AS BIGINT) % 8 WHEN 0 THEN '901' WHEN 1 THEN '916' WHEN 2 THEN '926' "
        "WHEN 3 THEN '495' WHEN 4 THEN '812' WHEN 5 THEN '800' WHEN 6 THEN '953' ELSE '077' END, "
        f"lpad(CAST((CAST({k} AS BIGINT) * 7919) % 10000000 AS STRING), 7, '0'))"
    )


def nat(k: str) -> str:
    return f"substr({num(k)}, 3)"


SOURCES = [
    "spravportal.ru/services/who-calls/num/", "callfilter.app/", "zvonili.com/phone/", "moshelovka.onf.ru/case/",
    "bloha.ru/a/", "getscam.com/", "znum.ru/z-", "prozvonok.ru/nomer/", "netrubi.ru/nomer/",
    "zvonkoff.net/ru/number/", "ktozvonil.net/nomer/", "znomer.ru/", "phoneregion.ru/number/",
    "callfilter.info/number/", "scamcall.ru/phone/", "kto.zvonil.tel/+", "abonentik.ru/nomer/", "badcall.ru/phones/",
]
_SITE = "CASE page_id % 18 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SOURCES)) + " END"
_PHRASE = (
    "CASE page_id % 5 WHEN 0 THEN 'мошенники требуют деньги 12.03.2024' WHEN 1 THEN 'реклама и спам, 7 отзывов, 120 просмотров' "
    "WHEN 2 THEN 'вежливый разговор' WHEN 3 THEN 'не мошенники, опрос 2024-05-06' ELSE 'доставка и поддержка' END"
)

VIEWS: dict[str, str] = {
    "raw_numbers": f"""SELECT c_custkey AS id, CASE c_custkey % 8
        WHEN 0 THEN concat('8', {nat('c_custkey')})
        WHEN 1 THEN concat('+7 (', substr({nat('c_custkey')}, 1, 3), ') ', substr({nat('c_custkey')}, 4, 3), '-', substr({nat('c_custkey')}, 7))
        WHEN 2 THEN {nat('c_custkey')}
        WHEN 3 THEN concat('+12', {nat('c_custkey')})
        WHEN 4 THEN CASE c_custkey % 3 WHEN 0 THEN '112' WHEN 1 THEN ' 103 ' ELSE c_name END
        WHEN 5 THEN concat('+7', {nat('c_custkey')}) WHEN 6 THEN concat('+84 95 ', substr({nat('c_custkey')}, 1, 7)) ELSE '' END AS raw
        FROM {{customer}}""",
    "numbers": f"SELECT c_custkey AS id, {num('c_custkey')} AS normalized_number FROM {{customer}}",
    "reputation_raw": f"""SELECT o_orderkey AS ord, {num('o_custkey')} AS normalized_number,
        CASE o_orderkey % 5 WHEN 0 THEN 'moshelovka' ELSE concat('src', CAST(o_orderkey % 5 AS STRING)) END AS source,
        CAST(o_orderkey % 7 AS BIGINT) AS negative_count, CAST(o_orderkey % 4 AS BIGINT) AS positive_count,
        CAST(o_orderkey % 3 AS BIGINT) AS neutral_count,
        CAST(CASE o_orderkey % 5 WHEN 0 THEN 0 ELSE o_orderkey % 11 END AS BIGINT) AS review_count,
        CAST(o_orderkey % 600 AS BIGINT) AS search_volume,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'мошенничество' WHEN '2' THEN 'спам' WHEN '3' THEN 'реклама;опрос'
            WHEN '4' THEN '' ELSE 'доставка' END AS categories,
        CAST(CAST(o_orderdate AS DATE) AS STRING) AS last_review_at,
        CASE o_orderkey % 6 WHEN 0 THEN '' ELSE '1995-01-15' END AS first_seen_at,
        CAST(o_orderkey % 10 AS DOUBLE) / 10 AS source_confidence, 0.5 + CAST(o_orderkey % 5 AS DOUBLE) / 10 AS source_reliability,
        CAST(o_orderkey % 900 AS BIGINT) AS view_count, CAST(o_orderkey % 13 AS BIGINT) AS related_count,
        CASE o_orderkey % 4 WHEN 0 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS detail_date,
        CASE o_orderkey % 3 WHEN 0 THEN '' ELSE concat('t', CAST(o_orderkey AS STRING)) END AS page_title,
        concat('http://h', CAST(o_orderkey % 9 AS STRING), '.example/', CAST(o_orderkey % 50 AS STRING)) AS url FROM {{orders}}""",
    "whitelist": f"""SELECT normalized_number, min(confidence) AS source_confidence, min(source) AS source FROM (
        SELECT {num('c_custkey * 3')} AS normalized_number, CAST(c_custkey % 20 AS DOUBLE) / 20 AS confidence,
        CASE c_custkey % 2 WHEN 0 THEN 'whitelist_official' ELSE 'legitimate_osm' END AS source FROM {{customer}}) w
        GROUP BY normalized_number""",
    "allow_feed": f"""SELECT c_custkey AS ord, {num('c_custkey * 2')} AS phone, c_name AS name, c_mktsegment AS segment,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'bank' WHEN 'MACHINERY' THEN 'freelancer' WHEN 'FURNITURE' THEN 'personal_mobile' ELSE 'retail' END AS category,
        CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '0,6' ELSE '0' END AS source_confidence,
        CASE c_custkey % 4 WHEN 0 THEN 'official_hotline' WHEN 1 THEN '' ELSE 'osm' END AS source, 'Москва' AS city, '' AS url FROM {{customer}}""",
    "official_feed": f"SELECT s_suppkey AS ord, {num('s_suppkey * 4')} AS number, s_name AS name, 'bank' AS category FROM {{supplier}}",
    "black_feed": f"""SELECT s_suppkey AS ord, {num('s_suppkey * 3')} AS phone, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'спам' ELSE 'фишинг' END AS category,
        CASE s_suppkey % 4 WHEN 0 THEN 'x' ELSE CAST(CAST(s_suppkey % 10 AS DOUBLE) / 10 AS STRING) END AS confidence, concat('http://b.example/', CAST(s_suppkey AS STRING)) AS url FROM {{supplier}}""",
    "blocklist": f"SELECT DISTINCT {num('s_suppkey * 3')} AS normalized_number FROM {{supplier}}",
    "numbering_plan": """SELECT CAST(CASE s_suppkey % 8 WHEN 0 THEN 901 WHEN 1 THEN 916 WHEN 2 THEN 926 WHEN 3 THEN 495 WHEN 4 THEN 812
        WHEN 5 THEN 800 WHEN 6 THEN 953 ELSE 77 END AS BIGINT) AS def_code,
        CAST(floor(s_suppkey / 8) AS BIGINT) * 500000 AS start_number,
        CAST(floor(s_suppkey / 8) AS BIGINT) * 500000 + CASE s_suppkey % 3 WHEN 0 THEN 899999 ELSE 399999 END AS end_number,
        CASE s_nationkey % 6 WHEN 0 THEN 'МТС' WHEN 1 THEN 'МегаФон' WHEN 2 THEN 'Билайн' WHEN 3 THEN 'ООО Т2 Мобайл' WHEN 4 THEN 'Йота' ELSE 'ПАО "Прочий"' END AS operator,
        CASE s_nationkey % 5 WHEN 0 THEN 'г. Москва' WHEN 1 THEN 'Омская обл.' WHEN 2 THEN 'Приморский край' WHEN 3 THEN 'Самарская обл. * Сызрань' ELSE 'Калининград|Россия' END AS region,
        CAST(CASE s_suppkey % 3 WHEN 0 THEN 900000 ELSE 400000 END AS BIGINT) AS capacity,
        CASE s_suppkey % 8 WHEN 3 THEN 'landline' WHEN 4 THEN 'other' WHEN 5 THEN 'tollfree' WHEN 7 THEN 'other' ELSE 'mobile' END AS number_type FROM {supplier}""",
    "labeled": f"""SELECT {num('l_suppkey * 31 + l_linenumber')} AS number,
        CASE l_returnflag WHEN 'A' THEN 'ALLOW' WHEN 'N' THEN 'WARN' ELSE 'BLOCK' END AS label,
        CASE CAST(l_partkey AS BIGINT) % 7 WHEN 0 THEN 'МТС' WHEN 1 THEN 'МегаФон' WHEN 2 THEN 'ПАО ВымпелКом' WHEN 3 THEN 'Tele2' WHEN 4 THEN 'Йота' WHEN 5 THEN 'Прочий' ELSE '' END AS operator,
        CAST(l_orderkey AS BIGINT) * 100000000 + CAST(l_linenumber AS BIGINT) * 10000000 + CAST(l_partkey AS BIGINT) AS ord FROM {{lineitem}}""",
    "classed": """SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 'ALLOW' WHEN 'O' THEN 'WARN' ELSE 'BLOCK' END AS label,
        CAST(o_orderkey % 101 AS DOUBLE) / 100 AS reputationScore, CAST(o_custkey % 41 AS DOUBLE) / 40 AS prefixRisk,
        CAST(o_orderkey % 29 AS DOUBLE) / 28 AS sourceConfidence, CAST(o_custkey % 7 AS DOUBLE) / 6 AS digitEntropy,
        CAST(0 AS DOUBLE) AS noMetadata, concat('src', CAST(o_custkey % 6 AS STRING)) AS source FROM {orders}""",
    "scores": """SELECT CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS y,
        round(l_discount * 5 + l_tax * 5, 4) AS p_block, round((1 - (l_discount * 5 + l_tax * 5)) * l_tax * 5, 4) AS p_warn,
        round(1 - (l_discount * 5 + l_tax * 5) - (1 - (l_discount * 5 + l_tax * 5)) * l_tax * 5, 4) AS p_allow,
        l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus,
        CASE WHEN l_shipdate < TIMESTAMP '1996-01-01 00:00:00' THEN 0 ELSE 1 END AS fresh FROM {lineitem}""",
    "calls": f"""SELECT event_id AS id, CAST(user_id % 15 AS BIGINT) AS user,
        CASE WHEN event_id % 11 = 0 THEN CAST(NULL AS STRING) ELSE {num('(user_id % 60)')} END AS number,
        CASE event_type WHEN 'purchase' THEN 'OUTGOING' ELSE 'INCOMING' END AS direction,
        CASE event_type WHEN 'error' THEN 'MISSED' WHEN 'signup' THEN 'REJECTED' ELSE 'ANSWERED' END AS state,
        CASE WHEN event_type IN ('error', 'signup') THEN CAST(0 AS BIGINT) ELSE CAST(value * 1000 AS BIGINT) END AS duration_ms,
        {{ms(ts)}} AS ts FROM {{events}}""",
    "usage": """SELECT event_id AS id, CAST(user_id % 15 AS BIGINT) AS user, {ms(ts)} - 300000 AS ts,
        concat('com.app', CAST(event_id % 10 AS STRING)) AS package,
        CASE event_id % 10 WHEN 0 THEN 'BANK' WHEN 1 THEN 'INVESTMENTS' WHEN 2 THEN 'GOVERNMENT' WHEN 3 THEN 'MARKETPLACE' WHEN 4 THEN 'DELIVERY'
            WHEN 5 THEN 'MESSENGER' WHEN 6 THEN 'GAMES' WHEN 7 THEN 'NEWS' WHEN 8 THEN 'EMAIL' ELSE 'OTHER' END AS category,
        CASE event_id % 10 WHEN 0 THEN 'BANK' WHEN 1 THEN 'BANK' WHEN 3 THEN 'MARKETPLACE' WHEN 4 THEN 'MARKETPLACE'
            WHEN 5 THEN 'MESSENGER' WHEN 8 THEN 'EMAIL' ELSE 'OTHER' END AS bucket FROM {events}""",
    "snapshots": f"""SELECT event_id AS id, {num('(user_id % 60)')} AS number, {{ms(ts)}} - (event_id % 20) * 60000 AS ts,
        value / 500 AS probability, props FROM {{events}}""",
    "decisions": f"""SELECT event_id AS id, CAST(user_id % 15 AS BIGINT) AS user, {num('(user_id % 60)')} AS number,
        CASE event_id % 3 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'WARN' ELSE 'BLOCK' END AS verdict,
        CASE event_id % 7 WHEN 1 THEN 'IS_SCAM' WHEN 2 THEN 'MARK_SPAM' WHEN 3 THEN 'DISMISS' WHEN 4 THEN 'NOT_SPAM' WHEN 5 THEN 'UNBLOCK'
            WHEN 6 THEN 'ANSWER' ELSE CAST(NULL AS STRING) END AS user_action,
        CASE event_id % 5 WHEN 0 THEN 'cloud_model' WHEN 1 THEN 'tflite_model' WHEN 2 THEN 'rule_engine' WHEN 3 THEN 'allowlist' ELSE 'server_model' END AS source,
        {{ms(ts)}} AS ts, CASE event_id % 2 WHEN 0 THEN event_id ELSE CAST(NULL AS BIGINT) END AS snapshot_id FROM {{events}}""",
    "feedback": """SELECT id, user, number, verdict, user_action AS action, ts,
        CASE id % 4 WHEN 0 THEN 'night_time;prefix_risk;short_code;not_contact' WHEN 1 THEN 'prefix_risk;not_contact'
            WHEN 2 THEN 'hidden_number' ELSE 'call_frequency;night_time;prefix_risk' END AS factors,
        CAST(CASE WHEN id < 0 THEN 1 ELSE 0 END AS INT) AS model_version FROM decisions WHERE user_action IS NOT NULL""",
    "contacts": f"SELECT CAST(c_custkey % 15 AS BIGINT) AS user, {num('(c_custkey * 4) % 60')} AS number FROM {{customer}}",
    "installs": """SELECT CAST(user_id % 15 AS BIGINT) AS user, min({ms(ts)}) AS installed_at FROM {events} GROUP BY user_id % 15""",
    "app_corpus": """SELECT CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE concat('com.', replace(p_name, ' ', '.'), '.', CAST(p_partkey % 300 AS STRING)) END AS package,
        p_name AS label, CASE p_type WHEN 'ECONOMY' THEN 'bank' WHEN 'STANDARD' THEN ' GAMES' WHEN 'PROMO' THEN 'News' WHEN 'LARGE' THEN 'VPN'
            WHEN 'SMALL' THEN 'EMAIL' ELSE 'gadgets' END AS category,
        CAST(p_partkey % 4 AS BIGINT) AS rank, CAST(p_partkey AS BIGINT) AS ord FROM {part}""",
    "known_apps": """SELECT concat('com.app', CAST(r_regionkey AS STRING)) AS package,
        CASE r_regionkey WHEN 0 THEN 'BANK' WHEN 1 THEN 'INVESTMENTS' WHEN 2 THEN 'GOVERNMENT' WHEN 3 THEN 'MARKETPLACE' ELSE 'DELIVERY' END AS category FROM {region}""",
    "posts": """SELECT conv_id * 1000 + turn AS id, CASE role WHEN 'user' THEN conv_id + 1 ELSE CAST(-1 AS BIGINT) END AS from_id,
        concat(text, CASE turn % 3 WHEN 0 THEN concat(' звоните 8 (926) 555-', lpad(CAST(conv_id % 100 AS STRING), 2, '0'), '-11') WHEN 1 THEN ' +79161234567' ELSE '' END) AS text FROM {conversations}""",
    "texts": """SELECT doc_id, concat(text, CASE doc_id % 6 WHEN 0 THEN ' мошенники! 12 отзывов, 340 просмотров' WHEN 1 THEN ' реклама, спам 05.11.2023'
        WHEN 2 THEN ' не спам, 2024-1-9' WHEN 3 THEN ' организация; опрос' ELSE '' END) AS text, lang FROM {documents}""",
    "web": f"""SELECT page_id, concat('https://www.', {_SITE}, substr({num('page_id * 3 + 1')}, 2), CASE page_id % 7 WHEN 0 THEN '?a=1' ELSE '' END) AS url,
        concat(html, '<div class="review_text comment-item post-comments review item-review">', {_PHRASE}, ' ', {num('page_id * 5 + 2')}, '</div>') AS html FROM {{pages}}""",
    "directory": f"""SELECT page_id, url, concat(html, '<a href="tel:', {num('page_id * 2 + 1')}, '">', CASE page_id % 4 WHEN 0 THEN 'клиника' WHEN 1 THEN 'банк' WHEN 2 THEN 'школа' ELSE 'дом' END,
        '</a> 8 (495) 123-4', CAST(page_id % 10 AS STRING), '-67') AS html FROM {{pages}}""",
}


def _needs(name: str, done: list[str]) -> list[str]:
    for other in VIEWS:
        if other != name and re.search(rf"\b(?:FROM|JOIN) {other}\b", VIEWS[name]) and other not in done:
            _needs(other, done)
    if name not in done:
        done.append(name)
    return done


def _render(sql: str, engine: str) -> str:
    if engine == "duckdb":
        sql = re.sub(r"\{ms\((\w+)\)\}", r"(epoch_us(\1) // 1000)", sql)
        return re.sub(r"\{(\w+)\}", r"\1", sql)
    return re.sub(
        r"\{ms\((\w+)\)\}",
        r"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(\1 AS TIMESTAMP_NTZ))",
        sql,
    )


def view_names(sql: str) -> list[str]:
    """Views a twin query mentions, in an order in which they can be defined."""
    done: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            _needs(name, done)
    return done


def with_views(sql: str, engine: str = "duckdb") -> str:
    """The query behind the views it needs."""
    parts = [f"{n} AS ({_render(VIEWS[n], engine)})" for n in view_names(sql)]
    body = sql.strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        recursive = body[5:].lstrip()[:10].upper() == "RECURSIVE "
        rest = body[5:].lstrip()[10:] if recursive else body[5:]
        return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + ",\n" + rest
    return "WITH " + ",\n".join(parts) + "\n" + body


class Tables:
    """Views of one folder as DataFrames: ``tables.calls``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if name not in VIEWS:
            raise AttributeError(name)
        sql = with_views(f"SELECT * FROM {name}", "spark")
        used = {b: self.base(b) for b in BASE if "{" + b + "}" in sql}
        return self.spark.sql(sql, **used)
