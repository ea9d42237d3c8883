"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import lookup as L
from ..operators import merge as M
from ..operators import quality as Q
from ..operators import stats
from ..operators.sizing import write_once
from .bindings import Tables
from .registry import query
from .scalars import bucket_sql, def_text_sql

# The plan with overlaps: of all ranges of a code the greatest start at or below the number counts.
_PLAN = """(SELECT n.id, n.normalized_number, max(struct_pack(s := p.start_number, e := p.end_number, o := p.operator, r := p.region, c := p.capacity, t := p.number_type)) AS hit,
    any_value(TRY_CAST(substr(n.normalized_number, 6) AS BIGINT)) AS sub FROM numbers n LEFT JOIN numbering_plan p
    ON p.def_code = TRY_CAST(substr(n.normalized_number, 3, 3) AS BIGINT) AND p.start_number <= TRY_CAST(substr(n.normalized_number, 6) AS BIGINT) {extra} GROUP BY n.id, n.normalized_number)"""
_HIT = "coalesce(hit.e >= sub, false)"


@query("jn01_numbering_lookup", f"""SELECT id, {_HIT} AS numbering_match, CASE WHEN {_HIT} THEN hit.o END AS plan_operator, CASE WHEN {_HIT} THEN hit.r END AS plan_region,
    CASE WHEN {_HIT} THEN hit.t END AS plan_number_type FROM {_PLAN.format(extra='')} x""")
def _(t: Tables):
    return L.numbering_lookup(t.numbers, t.numbering_plan).drop("normalized_number")


@query("jn02_registry_lookup", f"""SELECT id, CASE WHEN substr(normalized_number, 3, 1) = '9' THEN CAST(substr(normalized_number, 3) AS BIGINT) END AS registry_key, {_HIT} AS numbering_match,
    CASE WHEN {_HIT} THEN hit.o END AS plan_operator FROM {_PLAN.format(extra='AND p.def_code BETWEEN 900 AND 999')} x""")
def _(t: Tables):
    return L.registry_lookup(t.numbers, t.numbering_plan).select("id", "registry_key", "numbering_match", "plan_operator")


@query("jn03_full_outer", """SELECT coalesce(a.normalized_number, r.normalized_number) AS normalized_number, a.source_confidence AS allow_confidence, r.n AS reputation_rows
    FROM whitelist a FULL OUTER JOIN (SELECT normalized_number, count(*) AS n FROM reputation_raw GROUP BY 1) r ON a.normalized_number = r.normalized_number""", "allow_confidence")
def _(t: Tables):
    rep = t.reputation_raw.groupBy("normalized_number").agg(F.count(F.lit(1)).alias("n"))
    both = L.full_outer_by_number(t.whitelist, rep)
    return both.select("normalized_number", F.col("allow.source_confidence").alias("allow_confidence"), F.col("reputation.n").alias("reputation_rows"))


_LAST = f"(SELECT number, arg_max({bucket_sql('operator')}, ord) AS bucket FROM labeled WHERE {bucket_sql('operator')} <> 'unknown' GROUP BY number)"


@query("jn04_labels_with_bucket", f"SELECT b.bucket, l.label, count(*) AS rows FROM labeled l JOIN {_LAST} b ON b.number = l.number GROUP BY ALL")
def _(t: Tables):
    per_number = t.labeled.groupBy("number", "label").agg(F.count(F.lit(1)).alias("n"))
    joined = per_number.join(stats.operator_by_number(t.labeled, "ord"), "number")
    return joined.groupBy("bucket", "label").agg(F.sum("n").alias("rows"))


_FEATS = ["negative_count", "search_volume"]


@query("jn05_feature_lookup", """SELECT n.id, CASE WHEN f.normalized_number IS NULL THEN 'cold' ELSE 'dataset' END AS feature_source, f.a AS negative_count FROM numbers n LEFT JOIN
    (SELECT normalized_number, max(negative_count) AS a FROM reputation_raw GROUP BY 1 HAVING max(search_volume) > 100) f USING (normalized_number)""")
def _(t: Tables):
    r = t.reputation_raw.groupBy("normalized_number").agg(F.max("negative_count").alias("negative_count"), F.max("search_volume").alias("v"))
    feats = r.withColumn("search_volume", F.when(F.col("v") > 100, F.col("v"))).drop("v")
    return L.feature_lookup(t.numbers, feats, _FEATS).select("id", "feature_source", F.col("features.negative_count").alias("negative_count"))


def _risk(len_: int, alpha: float, low: int, key: str | None = None, extra: str = "", source: str = "labeled") -> str:
    k = key or f"substr(number, 1, {len_})"
    return f"""SELECT {k} AS prefix, round_even((sum(CASE WHEN label = 'BLOCK' THEN 1 ELSE 0 END) + {alpha}::DOUBLE * (SELECT avg(CASE WHEN label = 'BLOCK' THEN 1.0 ELSE 0.0 END) FROM {source})) / (count(*) + {alpha}::DOUBLE), 4) AS risk,
        count(*) AS seen FROM {source} WHERE starts_with(number, '+7') {extra} GROUP BY 1 HAVING count(*) >= {low}"""


# Prefixes of six characters for even codes, of five and four for others, so that back-off is met.
_MIXED = f"""(SELECT prefix, risk FROM ({_risk(6, 10, 3)}) a WHERE CAST(substr(prefix, 6, 1) AS INT) % 2 = 0
    UNION ALL SELECT prefix, risk FROM ({_risk(5, 10, 3)}) b WHERE prefix <> '+7901' UNION ALL SELECT prefix, risk FROM ({_risk(4, 10, 3)}) c)"""


def _counts(t: Tables):
    return write_once(stats.folded(t.labeled), "label-counts")


def _mixed(t: Tables):
    counts = _counts(t)
    six = stats.prefix_risk(counts, 6).filter(F.substring("prefix", 6, 1).cast("int") % 2 == 0)
    five = stats.prefix_risk(counts, 5).filter("prefix <> '+7901'")
    return six.unionByName(five).unionByName(stats.prefix_risk(counts, 4)).select("prefix", "risk")


_BACK = f"LEFT JOIN {_MIXED} a ON a.prefix = substr(n.normalized_number, 1, 6) LEFT JOIN {_MIXED} b ON b.prefix = substr(n.normalized_number, 1, 5) LEFT JOIN {_MIXED} c ON c.prefix = substr(n.normalized_number, 1, 4)"


@query("jn06_prefix_backoff", f"SELECT n.id, coalesce(a.risk, b.risk, c.risk) AS risk FROM numbers n {_BACK}", "risk")
def _(t: Tables):
    return L.prefix_lookup(t.numbers, _mixed(t), ["risk"]).select("id", "risk")


@query("jn07_prefix_risk_lookup", f"""SELECT n.id, CASE WHEN n.id % 7 = 0 THEN 0.0 ELSE coalesce(a.risk, b.risk, c.risk, CASE WHEN starts_with(n.normalized_number, '+84') THEN 0.8 ELSE 0.33 END) END AS table_risk,
    CASE WHEN n.id % 7 = 0 THEN 0.0 WHEN starts_with(n.normalized_number, '+7800') THEN 0.25 WHEN starts_with(n.normalized_number, '+7495') OR starts_with(n.normalized_number, '+7499') THEN 0.35
      WHEN starts_with(n.normalized_number, '+79') THEN CASE WHEN CAST(substr(n.normalized_number, 3, 3) AS INT) IN (900,901,902,903,904,905,906,908,909,950,951,952,953,958,966,969) THEN 0.65 ELSE 0.3 END
      WHEN starts_with(n.normalized_number, '+84') THEN 0.8 ELSE 0.1 END AS legacy_risk FROM numbers n {_BACK}""", "table_risk legacy_risk")
def _(t: Tables):
    allowed = F.col("id") % 7 == 0
    a = L.prefix_risk_lookup(t.numbers, _mixed(t), 0.33, allowed=allowed, out="table_risk")
    return L.prefix_risk_lookup(a, None, allowed=allowed, out="legacy_risk").select("id", "table_risk", "legacy_risk")


@query("jn08_single_length_share", f"""SELECT n.id, CASE WHEN n.id % 5 = 0 THEN 0.0 ELSE coalesce(a.risk, 0.0) END AS share3, CASE WHEN n.id % 5 = 0 THEN 0.0 ELSE coalesce(b.risk, 0.0) END AS share7
    FROM numbers n LEFT JOIN ({_risk(5, 10, 3)}) a ON a.prefix = substr(n.normalized_number, 1, 5) LEFT JOIN ({_risk(9, 10, 3)}) b ON b.prefix = substr(n.normalized_number, 1, 9)""", "share3 share7")
def _(t: Tables):
    hist = write_once(stats.prefix_histogram(t.labeled, (5, 9)), "histogram")
    allowed = F.col("id") % 5 == 0
    a = L.prefix_share_lookup(t.numbers, hist.filter("prefix_length = 5"), 5, "share3", allowed=allowed)
    return L.prefix_share_lookup(a, hist.filter("prefix_length = 9"), 9, "share7", allowed=allowed).select("id", "share3", "share7")


_DEF = def_text_sql("number")
_OPC = f"""(SELECT {bucket_sql('operator')} AS bucket, {_DEF} AS def_code, round_even((sum(CASE WHEN label = 'BLOCK' THEN 1 ELSE 0 END) + 20.0::DOUBLE * (SELECT avg(CASE WHEN label = 'BLOCK' THEN 1.0 ELSE 0.0 END) FROM labeled)) / (count(*) + 20.0::DOUBLE), 4) AS risk,
    count(*) AS seen_count FROM labeled WHERE {bucket_sql('operator')} <> 'unknown' GROUP BY 1, 2 HAVING count(*) >= 5)"""
_ASK = "CASE n.id % 4 WHEN 0 THEN 'mts' WHEN 1 THEN 'other' WHEN 2 THEN 'unknown' ELSE 'tele2' END"


@query("jn09_code_risk_lookup", f"""SELECT n.id, coalesce(a.risk, 0.44) AS code_risk, coalesce(b.risk, 0.44) AS operator_code_risk FROM numbers n LEFT JOIN ({_risk(0, 20, 5, _DEF)}) a ON a.prefix = {def_text_sql('n.normalized_number')}
    LEFT JOIN {_OPC} b ON b.def_code = {def_text_sql('n.normalized_number')} AND b.bucket = {_ASK}""", "code_risk operator_code_risk")
def _(t: Tables):
    k = F.col("id") % 4
    asked = t.numbers.withColumn("operator_bucket", F.when(k == 0, "mts").when(k == 1, "other").when(k == 2, "unknown").otherwise("tele2"))
    counts = _counts(t)
    a = L.code_risk_lookup(asked, stats.code_risk(counts), 0.44, out="code_risk")
    return L.operator_code_risk_lookup(a, stats.operator_code_risk(counts), 0.44, out="operator_code_risk").select("id", "code_risk", "operator_code_risk")


_MODE = f"""(SELECT def_code, bucket FROM (SELECT def_code, bucket, n, sum(n) OVER (PARTITION BY def_code) AS total, row_number() OVER (PARTITION BY def_code ORDER BY n DESC, bucket) AS rn FROM (
    SELECT {_DEF} AS def_code, {bucket_sql('operator')} AS bucket, count(*) AS n FROM labeled WHERE {bucket_sql('operator')} <> 'unknown' GROUP BY 1, 2) a) b WHERE rn = 1 AND total >= 3 AND n / total >= 0.15)"""


@query("jn10_resolve_bucket", f"""SELECT n.id, coalesce(CASE n.id % 5 WHEN 0 THEN 'mts' WHEN 1 THEN 'unknown' END, CASE WHEN n.id % 5 = 2 THEN 'mvno' END, m.bucket, 'unknown') AS operator_bucket
    FROM numbers n LEFT JOIN {_MODE} m ON m.def_code = {def_text_sql('n.normalized_number')}""")
def _(t: Tables):
    k = F.col("id") % 5
    asked = t.numbers.withColumns({
        "given": F.when(k == 0, " MTS ").when(k == 1, "unknown").when(k == 3, "nobody").otherwise(""),
        "name": F.when(k == 2, "Йота").otherwise(""),
    })
    table = stats.operator_bucket_by_code(t.labeled, min_share=0.15)
    return L.resolve_bucket(asked, table, F.col("given"), F.col("name")).select("id", "operator_bucket")


@query("jn11_drop_suspects", "SELECT w.normalized_number, w.source FROM whitelist w WHERE w.source = 'whitelist_official' OR NOT EXISTS (SELECT 1 FROM reputation_raw r WHERE r.normalized_number = w.normalized_number)")
def _(t: Tables):
    kept = L.drop_known(t.whitelist, t.reputation_raw, "normalized_number", F.col("source") == "whitelist_official")
    return kept.select("normalized_number", "source")


@query("jn12_append_unseen", "SELECT normalized_number, 'old' AS origin FROM blocklist UNION ALL SELECT normalized_number, 'new' FROM whitelist w WHERE NOT EXISTS (SELECT 1 FROM blocklist b WHERE b.normalized_number = w.normalized_number)")
def _(t: Tables):
    old = t.blocklist.withColumn("origin", F.lit("old"))
    return L.append_unseen(old, t.whitelist.select("normalized_number").withColumn("origin", F.lit("new")), "normalized_number")


@query("jn13_blocked_numbers", """SELECT n.id, CASE WHEN b.normalized_number IS NOT NULL THEN 'exact' WHEN regexp_matches(n.normalized_number, '^\\+7800') OR regexp_matches(n.normalized_number, '^\\+7953.*7$') THEN 'mask' END AS blocked_by
    FROM numbers n LEFT JOIN blocklist b USING (normalized_number)""")
def _(t: Tables):
    k = F.col("r_regionkey")
    masks = t.region.select(F.when(k < 3, r"^\+7800").otherwise(r"^\+7953.*7$").alias("pattern"))
    return L.blocked_numbers(t.numbers, t.blocklist, masks).select("id", "blocked_by")


@query("jn14_allowed_numbers", "SELECT n.id FROM numbers n WHERE n.normalized_number IN (SELECT normalized_number FROM whitelist)")
def _(t: Tables):
    return t.numbers.join(t.whitelist.select("normalized_number"), "normalized_number", "left_semi").select("id")


@query("jn15_list_conflicts", "SELECT DISTINCT w.normalized_number FROM whitelist w JOIN blocklist b USING (normalized_number)")
def _(t: Tables):
    return Q.list_conflicts(t.whitelist, t.blocklist)


_SNAP = "(SELECT number, max(struct_pack(ts := ts, id := id)) AS s FROM snapshots GROUP BY number)"


@query("jn16_link_latest", f"SELECT c.id, CASE WHEN abs(x.s.ts - c.ts) <= 600000000 THEN x.s.id END AS snapshot_id FROM calls c LEFT JOIN {_SNAP} x ON x.number = c.number")
def _(t: Tables):
    return L.link_latest(t.calls, t.snapshots, "number", tolerance_ms=600_000_000).select("id", "snapshot_id")


@query("jn17_callbacks", """SELECT m.id, EXISTS (SELECT 1 FROM calls o WHERE o.number = m.number AND o.direction = 'OUTGOING' AND o.ts BETWEEN m.ts AND m.ts + 86400000) AS called_back
    FROM calls m WHERE m.direction = 'INCOMING' AND m.state = 'MISSED' AND m.number IS NOT NULL""")
def _(t: Tables):
    return E.callbacks(t.calls).select("id", "called_back")


@query("jn18_missed_before", """SELECT c.id, EXISTS (SELECT 1 FROM calls m WHERE m.number = c.number AND m.direction = 'INCOMING' AND m.state IN ('MISSED', 'REJECTED') AND m.ts >= c.ts - 172800000) AS missed_before
    FROM calls c WHERE c.direction = 'OUTGOING'""")
def _(t: Tables):
    return E.missed_before(t.calls, 2).filter("direction = 'OUTGOING'").select("id", "missed_before")


@query("jn19_outgoing_after_missed", """SELECT c.id, EXISTS (SELECT 1 FROM calls o WHERE o.number = c.number AND o.direction = 'OUTGOING' AND o.ts < c.ts AND o.ts >= c.ts - 604800000
    AND EXISTS (SELECT 1 FROM calls m WHERE m.number = o.number AND m.state IN ('MISSED', 'REJECTED') AND m.ts < o.ts)) AS outgoing_after_missed FROM calls c""")
def _(t: Tables):
    return E.outgoing_after_missed(t.calls).select("id", "outgoing_after_missed")


@query("jn20_two_key_lookup", """SELECT d.id, coalesce(a.probability, b.probability) AS probability FROM decisions d LEFT JOIN (SELECT id, probability, id + 1 AS event FROM snapshots WHERE id % 3 = 0) a ON a.event = d.id
    LEFT JOIN snapshots b ON b.id = d.id""", "probability")
def _(t: Tables):
    table = t.snapshots.select("id", F.when(F.col("id") % 3 == 0, F.col("id") + 1).alias("call_event_id"), "probability")
    return L.two_key_lookup(t.decisions.select("id", F.col("id").alias("ref")), table, "call_event_id", "id", "ref", "probability").select("id", "probability")




@query("jn21_caller_info", f"""SELECT id, CASE WHEN fresh THEN 'op' ELSE operator END AS operator, CASE WHEN fresh THEN 'reg' ELSE coalesce(region, CASE WHEN substr(normalized_number, 3, 3) = '495' THEN 'Москва' END) END AS region,
    CASE WHEN fresh THEN 'cache' WHEN operator IS NOT NULL THEN 'registry' WHEN substr(normalized_number, 3, 3) = '495' THEN 'geocoder' ELSE 'miss' END AS found_by FROM (
    SELECT id, normalized_number, CASE id % 4 WHEN 0 THEN id % 35 <= 30 WHEN 1 THEN id % 35 <= 2 WHEN 2 THEN id % 35 <= 7 ELSE false END AS fresh,
    CASE WHEN {_HIT} THEN CASE hit.o WHEN 'ООО Т2 Мобайл' THEN CASE WHEN true THEN 'Т2 Мобайл' END WHEN 'Йота' THEN 'Yota' WHEN 'ПАО "Прочий"' THEN 'Прочий' ELSE hit.o END END AS operator,
    CASE WHEN {_HIT} THEN CASE hit.r WHEN 'г. Москва' THEN 'Москва' WHEN 'Самарская обл. * Сызрань' THEN 'Самарская обл.' WHEN 'Калининград|Россия' THEN 'Калининград' ELSE hit.r END END AS region
    FROM {_PLAN.format(extra='AND p.def_code BETWEEN 900 AND 999')} x) y""".replace("CASE WHEN true THEN 'Т2 Мобайл' END", "'Tele2'"))
def _(t: Tables):
    k = F.col("id") % 4
    now = F.lit(1_700_000_000_000)
    source = F.when(k == 0, "2gis").when(k == 1, "negative").otherwise("offline")
    age = F.when(k == 3, F.lit(400)).otherwise(F.col("id") % 35)
    cache = t.numbers.groupBy("normalized_number").agg(F.max("id").alias("id")).select(
        "normalized_number", F.lit("op").alias("operator"), F.lit("reg").alias("region"), source.alias("source"), (now - age * 86_400_000).alias("ts"))
    geo = t.region.select(F.lit(495).cast("bigint").alias("def_code"), F.lit("Москва").alias("region")).distinct()
    found = L.caller_info(t.numbers, t.numbering_plan, geo, cache, now)
    return found.join(t.numbers, "normalized_number").select("id", "operator", "region", "found_by")


def _app(cats: str) -> str:
    return f"EXISTS (SELECT 1 FROM usage u WHERE u.user = c.user AND u.category IN ({cats}) AND u.ts < c.ts AND u.ts >= c.ts - 1800000)"


@query("jn22_recent_apps", f"""SELECT c.id, {_app("'BANK', 'INVESTMENTS'")} AS recent_bank_app, {_app("'GOVERNMENT'")} AS recent_gov_app,
    {_app("'MARKETPLACE', 'DELIVERY'")} AS recent_marketplace_app, {_app("'MESSENGER'")} AS recent_messenger_app FROM calls c""")
def _(t: Tables):
    return E.recent_apps(t.calls, t.usage).select("id", *E.USAGE_GROUPS)


@query("jn23_recent_notifications", """SELECT c.id, count(CASE WHEN u.bucket = 'BANK' THEN 1 END) AS notif_bank, count(CASE WHEN u.bucket = 'MARKETPLACE' THEN 1 END) AS notif_marketplace
    FROM calls c LEFT JOIN usage u ON u.user = c.user AND u.ts < c.ts AND u.ts >= c.ts - 600000 GROUP BY c.id""", "notif_bank notif_marketplace")
def _(t: Tables):
    return E.recent_notifications(t.calls, t.usage).select("id", "notif_bank", "notif_marketplace")


@query("jn24_list_split", "SELECT normalized_number, source = 'whitelist_official' AS official FROM whitelist")
def _(t: Tables):
    official = t.whitelist.filter("source = 'whitelist_official'").select("normalized_number")
    yes = t.whitelist.join(official, "normalized_number", "left_semi").select("normalized_number", F.lit(True).alias("official"))
    return yes.unionByName(t.whitelist.join(official, "normalized_number", "left_anti").select("normalized_number", F.lit(False).alias("official")))


@query("set01_union_all", "SELECT source, count(*) AS rows FROM (SELECT source FROM reputation_raw UNION ALL SELECT 'black' FROM black_feed) x GROUP BY source")
def _(t: Tables):
    black = t.black_feed.select(F.lit("").alias("source"))
    return M.union_feeds({"rep": t.reputation_raw.select("source"), "black": black}).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


@query("set02_union_distinct", "SELECT normalized_number FROM whitelist UNION SELECT normalized_number FROM reputation_raw UNION SELECT normalized_number FROM blocklist")
def _(t: Tables):
    return M.key_union(t.whitelist, t.reputation_raw, t.blocklist, key="normalized_number")


@query("set03_except", "SELECT normalized_number FROM whitelist EXCEPT SELECT normalized_number FROM reputation_raw")
def _(t: Tables):
    return M.key_except(t.whitelist, t.reputation_raw, "normalized_number")


@query("set04_intersect", "SELECT normalized_number FROM whitelist INTERSECT SELECT normalized_number FROM reputation_raw")
def _(t: Tables):
    return M.key_intersect(t.whitelist, t.reputation_raw, "normalized_number")


@query("set05_distinct_numbers", "SELECT DISTINCT number FROM decisions")
def _(t: Tables):
    return t.decisions.select("number").distinct()


@query("set06_replace_and_update", """SELECT normalized_number, source, CASE WHEN normalized_number IN (SELECT normalized_number FROM blocklist) THEN 'BLOCK' ELSE 'ALLOW' END AS verdict FROM (
    SELECT normalized_number, source FROM whitelist WHERE source <> 'legitimate_osm' UNION ALL
    SELECT normalized_number, 'legitimate_osm' FROM blocklist b WHERE NOT EXISTS (SELECT 1 FROM whitelist w WHERE w.source <> 'legitimate_osm' AND w.normalized_number = b.normalized_number)) x""")
def _(t: Tables):
    table = M.replace_by_origin(t.whitelist.select("normalized_number", "source"), t.blocklist, "legitimate_osm", "normalized_number")
    changes = t.blocklist.withColumn("verdict", F.lit("BLOCK"))
    return M.update_verdicts(table.withColumn("verdict", F.lit("ALLOW")), changes, "normalized_number")


