"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import html as H
from ..functions import phone as P
from ..operators import decide as D
from ..operators import events as E
from ..operators import quality as Q
from ..operators import sample
from ..sources import feeds, sinks
from .bindings import Tables
from .registry import query
from .scalars import class_sql, valid_sql

_VALID = valid_sql("normalized_number")
_VOTES = "(negative_count + positive_count + neutral_count)"


def _other_names(t: Tables):
    r = t.reputation_raw
    return r.select(
        "ord", F.lit("").alias("normalized_number"), F.col("normalized_number").alias("phone"),
        F.when(F.col("ord") % 2 == 0, "").otherwise(F.col("negative_count").cast("string")).alias("negative_count"),
        F.col("positive_count").alias("bad"), F.col("neutral_count").alias("neutral"), F.lit("0").alias("review_count"),
        F.col("review_count").alias("reviews"), F.col("view_count").alias("views"), F.lit(0).alias("search_volume"),
        F.lit("").alias("categories"), F.col("categories").alias("category"), F.col("source_confidence").alias("confidence"), "source", "url")


def _alias_sql(mode: str) -> str:
    neg = "CASE WHEN ord % 2 = 0 THEN {} ELSE negative_count END".format("positive_count" if mode == "value" else "0")
    rev = "0"
    cats = "categories" if mode == "value" else "''"
    return f"""SELECT ord, normalized_number, source, {neg} AS negative_count, 0::BIGINT AS positive_count, neutral_count,
        CASE WHEN {rev} > 0 THEN {rev} ELSE ({neg}) + neutral_count END AS review_count, view_count AS search_volume, {cats} AS categories, source_confidence
        FROM reputation_raw WHERE {_VALID}"""


_OUT = ["ord", "normalized_number", "source", "negative_count", "positive_count", "neutral_count", "review_count", "search_volume", "categories", "source_confidence"]


@query("prj01_canonical_by_value", _alias_sql("value"), "source_confidence", "negative_count review_count")
def _(t: Tables):
    return feeds.canonical_reputation(_other_names(t), "hint", "value").select(*_OUT)


@query("prj02_canonical_by_column", _alias_sql("column"), "source_confidence", "negative_count review_count")
def _(t: Tables):
    return feeds.canonical_reputation(_other_names(t), "hint", "column").select(*_OUT)


@query("prj03_select_verdicts", "SELECT id, verdict AS chosen_verdict FROM decisions WHERE id % 4 <> 0 AND verdict = 'WARN'")
def _(t: Tables):
    d = t.decisions
    rows = d.select("id", F.when(F.col("id") % 4 == 0, "boom").otherwise(" ").alias("error"),
                    F.when(F.col("id") % 2 == 0, "").otherwise(F.lower("verdict")).alias("verdict"), F.col("verdict").alias("model_verdict"))
    return sinks.selected_verdicts(rows, "warn").select("id", "chosen_verdict")


_C = class_sql("num")


@query("prj04_quarantine", f"""SELECT id, lower(trim(name)) = 'customer#000000001' OR NOT {_C['national']} AS quarantined FROM (
    SELECT n.id, n.normalized_number AS num, c.c_name AS name FROM numbers n JOIN customer c ON c.c_custkey = n.id) x""")
def _(t: Tables):
    rows = t.numbers.join(t.customer.select(F.col("c_custkey").alias("id"), "c_name"), "id")
    return Q.placeholder_split(rows, "c_name", "normalized_number", ["Customer#000000001"]).select("id", "quarantined")


@query("prj05_blank_keys", "SELECT package = ' ' AS blank, count(*) AS rows FROM app_corpus GROUP BY 1")
def _(t: Tables):
    return t.app_corpus.groupBy((F.trim("package") == "").alias("blank")).agg(F.count(F.lit(1)).alias("rows"))


@query("prj06_cold_view", "SELECT key, 0.0 AS \"reputationScore\", 0.0 AS \"sourceConfidence\", \"prefixRisk\", \"digitEntropy\", 1.0 AS \"noMetadata\" FROM classed",
       'reputationScore sourceConfidence prefixRisk digitEntropy noMetadata')
def _(t: Tables):
    return sample.cold_view(t.classed).select("key", "reputationScore", "sourceConfidence", "prefixRisk", "digitEntropy", "noMetadata")


@query("prj07_masked_view", "SELECT key, \"reputationScore\", 0.0 AS \"prefixRisk\", 0.0 AS \"noMetadata\" FROM classed", "reputationScore prefixRisk noMetadata")
def _(t: Tables):
    return sample.masked_view(t.classed, ["prefixRisk"]).select("key", "reputationScore", "prefixRisk", "noMetadata")


@query("prj08_binary_labels", """SELECT l_quantity, sum(CASE WHEN y >= 1 THEN 1 ELSE 0 END) AS merge_block, sum(CASE WHEN y = 2 THEN 1 ELSE 0 END) AS merge_allow,
    sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS kept_without_warn FROM scores GROUP BY l_quantity""", ints="merge_block merge_allow kept_without_warn")
def _(t: Tables):
    y = F.col("y")
    return t.scores.groupBy("l_quantity").agg(
        F.sum(D.binary_label(y, "merge_block")).alias("merge_block"), F.sum(D.binary_label(y, "merge_allow")).alias("merge_allow"),
        F.count(D.binary_label(y, "drop")).alias("kept_without_warn"))


@query("prj09_label_names", "SELECT CASE ord % 4 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'WARN' WHEN 2 THEN 'BLOCK' ELSE 'SPAM' END AS label, count(*) AS rows FROM reputation_raw GROUP BY 1")
def _(t: Tables):
    k = F.col("ord") % 4
    return t.reputation_raw.select(D.label_name(F.when(k == 3, "SPAM").otherwise(k.cast("string"))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


_ACT = "CASE id % 3 WHEN 0 THEN 'not_spam' WHEN 1 THEN 'fraud' ELSE 'dismiss' END"
_COR = """CASE WHEN a = 'not_spam' AND verdict = 'BLOCK' THEN {0} WHEN a = 'not_spam' AND verdict = 'WARN' THEN {1} WHEN a = 'fraud' AND verdict = 'ALLOW' THEN {2}
    WHEN a = 'fraud' AND verdict = 'WARN' THEN {3} WHEN a = 'dismiss' AND verdict = 'BLOCK' THEN {4} WHEN a = 'dismiss' AND verdict = 'WARN' THEN {5} ELSE {6} END"""
_LAB = _COR.format("'ALLOW'", "'ALLOW'", "'BLOCK'", "'BLOCK'", "'WARN'", "'ALLOW'", "verdict")
_WGT = _COR.format(3.0, 2.0, 3.0, 2.0, 1.5, 1.5, 1.0)
_FB = "(SELECT id, CASE id % 5 WHEN 0 THEN 'ALLOW' WHEN 1 THEN 'WARN' ELSE 'BLOCK' END AS verdict, " + _ACT + " AS a FROM decisions)"


def _fed(t: Tables):
    k = F.col("id") % 5
    verdict = F.when(k == 0, "ALLOW").when(k == 1, "WARN").otherwise("BLOCK")
    a = F.col("id") % 3
    action = F.when(a == 0, "not_spam").when(a == 1, "fraud").otherwise("dismiss")
    return t.decisions.select("id", verdict.alias("verdict"), action.alias("action"))


@query("prj10_corrected_labels", f"SELECT id, {_LAB} AS label, {_WGT} AS weight FROM {_FB} f", "weight")
def _(t: Tables):
    return _fed(t).select("id", D.corrected_label(F.col("action"), F.col("verdict")).alias("c")).select("id", "c.label", "c.weight")


@query("prj11_fine_tune_weight", f"SELECT id, CASE WHEN id % 2 = 0 THEN 1.0 ELSE {_WGT} * 0.3 + 0.7 END AS weight FROM {_FB} f", "weight")
def _(t: Tables):
    c = D.corrected_label(F.col("action"), F.col("verdict"))
    return _fed(t).select("id", D.fine_tune_weight(F.col("id") % 2 == 1, c["weight"]).alias("weight"))


@query("prj12_antibot_pages", """SELECT page_id, contains(lower(h), 'проверка браузера') OR
    (contains(lower(h), 'cloudflare') AND (contains(lower(h), 'attention required') OR contains(lower(h), 'just a moment'))) AS guarded
    FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Проверка браузера ' || html WHEN 1 THEN 'Cloudflare: Just a moment ' || html ELSE html END AS h FROM pages) x""")
def _(t: Tables):
    k = F.col("page_id") % 3
    h = F.when(k == 0, F.concat(F.lit("Проверка браузера "), "html")).when(k == 1, F.concat(F.lit("Cloudflare: Just a moment "), "html")).otherwise(F.col("html"))
    return t.pages.select("page_id", h.alias("h")).select("page_id", H.is_antibot(F.col("h")).alias("guarded"))


_ONE = " OR ".join(f"substr(num, 3) = repeat('{d}', 10)" for d in range(10))


@query("prj13_plausible_numbers", f"""SELECT id, num, coalesce(length(num) = 12 AND {_C['national']} AND NOT ({_ONE}) AND substr(num, 3) NOT IN ('1234567890', '9876543210', '0000000000'), false) AS plausible FROM (
    SELECT id, CASE id % 5 WHEN 0 THEN normalized_number WHEN 1 THEN '+79999999999' WHEN 2 THEN '+7' || substr(normalized_number, 3, 6) WHEN 3 THEN '+79876543210' ELSE '+74' || substr(normalized_number, 4) END AS num FROM numbers) x""")
def _(t: Tables):
    n, k = F.col("normalized_number"), F.col("id") % 5
    num = (F.when(k == 0, n).when(k == 1, "+79999999999").when(k == 2, F.concat(F.lit("+7"), F.substring(n, 3, 6))).when(k == 3, "+79876543210")
           .otherwise(F.concat(F.lit("+74"), F.substring(n, 4, 20))))
    return t.numbers.select("id", num.alias("num")).withColumn("plausible", P.is_plausible("num"))


@query("prj14_user_posts", "SELECT id, from_id FROM posts WHERE from_id > 0 AND trim(text) <> ''")
def _(t: Tables):
    return feeds.user_posts(t.posts).select("id", "from_id")


@query("prj15_order_parity", """SELECT coalesce(a.position, b.position) AS position, a.name AS left_name, b.name AS right_name FROM
    (SELECT p_partkey AS position, p_name AS name FROM part) a FULL OUTER JOIN (SELECT p_partkey + CASE WHEN p_partkey % 9 = 0 THEN 100000000 ELSE 0 END AS position, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_name END AS name FROM part) b
    USING (position) WHERE a.name IS DISTINCT FROM b.name""")
def _(t: Tables):
    k = F.col("p_partkey")
    left = t.part.select(k.alias("position"), F.col("p_name").alias("name"))
    right = t.part.select((k + F.when(k % 9 == 0, 100000000).otherwise(0)).alias("position"), F.when(k % 5 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("name"))
    return Q.order_mismatches(left, right, "name")


_NOW = "(SELECT max(ts) FROM calls)"


@query("prj16_personal_lists", f"""SELECT c.id, EXISTS (SELECT 1 FROM contacts a WHERE a.user = c.user AND a.number = c.number) AND length(c.number) > 0 AS number_allowed,
    EXISTS (SELECT 1 FROM (SELECT DISTINCT user, substr(number, 1, 5 + CAST(user % 4 AS BIGINT)) AS p FROM contacts) q WHERE q.user = c.user AND starts_with(c.number, q.p)) AS prefix_allowed
    FROM calls c WHERE c.number IS NOT NULL""")
def _(t: Tables):
    now = t.calls.agg(F.max("ts")).scalar()
    allowed = t.contacts.withColumn("ts", now)
    prefixes = t.contacts.select("user", F.expr("substring(number, 1, cast(5 + user % 4 as int))").alias("prefix"))
    calls = t.calls.filter("number is not null").select("id", "user", "number")
    return E.personally_allowed(calls, allowed, prefixes, now).select("id", "number_allowed", "prefix_allowed")
