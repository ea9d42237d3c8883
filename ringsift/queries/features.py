"""Feature assembly and the whole build."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import phone as P
from ..operators import aggregate as A
from ..operators import events as E
from ..operators import lookup as L
from ..operators import quality as Q
from ..plans import dataset as B
from ..plans import features as X
from ..session import scratch_path
from ..sources import feeds, sinks
from .aggregates import _BEST, _HIST, _NUM
from .bindings import Tables
from .decisions import _ladder, _WL
from .joins import _HIT, _OPC, _PLAN, _risk
from .registry import query
from .scalars import (
    _CH, DIGITS, beautiful_sql, bucket_sql, class_sql, def_text_sql, entropy_sql, flags_sql, offset_sql, repeat_sql,
    reputation_sql, run_sql, type_sql, valid_sql,
)

_OP = f"coalesce(CASE WHEN {_HIT} THEN hit.o END, '')"
_RG = f"coalesce(CASE WHEN {_HIT} THEN hit.r END, '')"


@query("ft01_numbering_enrichment", f"""SELECT id, {_HIT} AS numbering_match, {_OP} AS operator, {_RG} AS region, CASE WHEN {_HIT} THEN hit.t ELSE {type_sql('normalized_number')} END AS number_type, TRY_CAST(substr(normalized_number, 3, 3) AS BIGINT) AS def_code,
    {bucket_sql(_OP)} AS operator_bucket, CASE WHEN {_RG} = '' THEN 0 ELSE {_CH.format(x=_RG)} % 16 END AS region_bucket, {offset_sql(_RG)} AS timezone_offset, CASE WHEN {bucket_sql(_OP)} = 'mvno' THEN 1 ELSE 0 END AS is_mvno FROM {_PLAN.format(extra='')} x""", ints="is_mvno region_bucket")
def _(t: Tables):
    return X.enrich_numbering(t.numbers, t.numbering_plan).drop("normalized_number")


def _aggregated(t: Tables):
    """Reputation of the valid numbers, one row each."""
    valid = t.reputation_raw.filter(P.is_valid("normalized_number"))
    return A.reputation_by_number(valid, "ord")


_RV = f"(SELECT * FROM reputation_raw WHERE {valid_sql('normalized_number')})"
_AGG = f"(SELECT a.*, s.source, s.categories, s.last_review_at, s.first_seen_at FROM (SELECT normalized_number, {_NUM} FROM {_RV} v GROUP BY 1) a JOIN (SELECT *, {_BEST} AS rn FROM {_RV} u) s ON s.rn = 1 AND s.normalized_number = a.normalized_number)"
_BOO = "(1.0::DOUBLE + (r.source_reliability - 0.5) * 0.4::DOUBLE)"
_LABEL = _ladder("'ALLOW'", "'BLOCK'", "'WARN'", "'BLOCK'", "'BLOCK'", "'WARN'", "'WARN'", "'ALLOW'", "'WARN'")
_WEIGHT = _ladder(_WL, "2.0", "0.25", f"round_even(1.7::DOUBLE * {_BOO}, 2)", f"round_even(1.5::DOUBLE * {_BOO}, 2)", f"round_even(1.0::DOUBLE * {_BOO}, 2)", f"round_even(0.8::DOUBLE * {_BOO}, 2)", "0.9", "0.5")
_ENTRY = f"""(SELECT coalesce(w.normalized_number, r.normalized_number) AS normalized_number, {_LABEL} AS label, {_WEIGHT} AS weight, coalesce(w.source, r.source, 'unknown') AS source,
    coalesce(r.negative_count, 0) AS negative_count, coalesce(r.positive_count, 0) AS positive_count, coalesce(r.neutral_count, 0) AS neutral_count, coalesce(r.review_count, 0) AS review_count, coalesce(r.search_volume, 0) AS search_volume, coalesce(r.view_count, 0) AS view_count,
    coalesce(r.categories, '') AS categories, coalesce(w.source_confidence, r.source_confidence, 0.5) AS source_confidence, starts_with(lower(coalesce(w.source, r.source, '')), 'whitelist') AS in_allow,
    contains(coalesce(w.source, r.source, ''), 'moshelovka') OR contains(coalesce(r.source, ''), 'moshelovka') AS in_black FROM whitelist w FULL OUTER JOIN {_AGG} r ON r.normalized_number = w.normalized_number)"""


@query("ft04_entries", f"SELECT * FROM {_ENTRY} e", "weight source_confidence")
def _(t: Tables):
    out = B.build_entries(t.whitelist, _aggregated(t))
    return out.select("normalized_number", "label", "weight", "source", "negative_count", "positive_count", "neutral_count", "review_count", "search_volume", "view_count", "categories", "source_confidence", "in_allow", "in_black")


_N = "e.normalized_number"
_D = DIGITS.format(_N)
_C = class_sql(_N)
_FLG = flags_sql("e.categories")
_VOT = "(e.negative_count + e.positive_count + e.neutral_count)"
_REV = f"(CASE WHEN e.review_count <= 0 THEN {_VOT} ELSE e.review_count END)"
_RAT = f"(e.negative_count / greatest({_VOT}, {_REV}, 1)::DOUBLE)"
_H6 = "(" + _HIST.split(" UNION ALL ")[1] + ")"


def _one(test: str) -> str:
    return f"CASE WHEN {test} THEN 1.0 ELSE 0.0 END"


_ALLOW = "e.in_allow"
_FALL = "(SELECT round_even(avg(CASE WHEN label = 'BLOCK' THEN 1.0 ELSE 0.0 END), 4) FROM labeled)"
_NORM = f"(SELECT round_even(ln(1.0 + max(seen_count)), 4) FROM {_H6} q)"
_COMPACT = {
    "isRussianNumber": _one(_C["national"]), "isForeignNumber": _one(f"starts_with({_N}, '+') AND NOT starts_with({_N}, '+7')"), "isShortCode": _one(f"{type_sql(_N)} = 'short'"),
    "isStandardLen": _one(f"length({_D}) = 11 AND substr({_D}, 1, 1) IN ('7', '8')"), "isTollFree8800": _one(f"{type_sql(_N)} = 'tollfree'"), "isGeographical": _one(f"{type_sql(_N)} = 'landline'"),
    "isMobileRu": _one(f"{type_sql(_N)} = 'mobile'"), "digitEntropy": f"least(1.0, {entropy_sql(_D)})", "repeatDigitRatio": repeat_sql(_D), "maxSameDigitRun": run_sql(_D), "beautifulNumberFlag": _one(beautiful_sql(_D)),
    "prefixRisk": f"CASE WHEN {_ALLOW} THEN 0.0 ELSE coalesce(pr.risk, {_FALL}) END", "inBlacklist": _one("e.in_black"), "inAllowlist": _one(_ALLOW), "userVulnerability": "0.35", "contactsAvailable": "1.0",
    "reputationScore": reputation_sql(_RAT, _REV, "e.search_volume", _FLG["fraud"], _FLG["tele"]), "sourceConfidence": "least(1.0, greatest(0.0, e.source_confidence))",
    "defCodeRisk": f"CASE WHEN {_ALLOW} THEN 0.0 ELSE coalesce(cr.risk, {_FALL}) END", "prefixBlockShare": "coalesce(h.block_share, 0.0)", "prefixWarnShare": "coalesce(h.warn_share, 0.0)",
    "prefixSeenLog": f"coalesce(least(1.0, ln(1.0 + h.seen_count) / {_NORM}), 0.0)", "prefixEntropy": "coalesce(h.entropy, 0.0)", "prefixSampleSize": "coalesce(least(1.0, h.seen_count / 30.0), 0.0)",
    "reviewsLog": f"least(1.0, ln(1.0 + {_REV}) / ln(101.0))", "negativeRatio": _RAT, "searchVolumeLog": "least(1.0, ln(1.0 + e.search_volume) / ln(10001.0))", "hasFraudCategory": _one(_FLG["fraud"]), "hasTelemarketingCategory": _one(_FLG["tele"]),
    "noMetadata": f"CASE WHEN e.review_count > 0 OR e.search_volume > 0 OR e.view_count > 0 OR e.in_allow OR e.in_black OR {_FLG['fraud']} OR {_FLG['tele']} OR {_FLG['fin']} THEN 0.0 ELSE 1.0 END",
    "isContact": "0.0", "callFrequency": "0.0", "isNightTime": "0.0", "recentBankApp": "0.0", "recentGovApp": "0.0", "recentMarketplaceApp": "0.0", "recentMessengerApp": "0.0", "previouslyRejected": "0.0",
    "hiddenNumber": "0.0", "callerVerifyFailed": "0.0", "userBusinessActivity": "0.45", "usageAccessAvailable": "0.0", "spoofingPrefixFlag": _one(f"starts_with({_N}, '+8495')"),
    "prefixBlockShare3": f"CASE WHEN {_ALLOW} THEN 0.0 ELSE coalesce(h5.block_share, 0.0) END", "prefixBlockShare7": f"CASE WHEN {_ALLOW} THEN 0.0 ELSE coalesce(h9.block_share, 0.0) END",
}
_PARTS = _HIST.split(" UNION ALL ")
_JOINS = f"""LEFT JOIN ({_risk(6, 10, 3)}) pr ON pr.prefix = substr({_N}, 1, 6) LEFT JOIN ({_risk(0, 20, 5, def_text_sql('number'))}) cr ON cr.prefix = {def_text_sql(_N)}
    LEFT JOIN ({_PARTS[1]}) h ON h.prefix = substr({_N}, 1, 6) LEFT JOIN ({_PARTS[0]}) h5 ON h5.prefix = substr({_N}, 1, 5) LEFT JOIN ({_PARTS[2]}) h9 ON h9.prefix = substr({_N}, 1, 9)"""


def _tables(t: Tables) -> X.RiskTables:
    return X.RiskTables.build(t.labeled)


@query("ft02_compact_features", f"SELECT e.normalized_number, {', '.join(f'{v} AS {chr(34)}{k}{chr(34)}' for k, v in _COMPACT.items())} FROM {_ENTRY} e {_JOINS}", " ".join(_COMPACT))
def _(t: Tables):
    entries = B.build_entries(t.whitelist, _aggregated(t))
    return X.compact_features(entries, _tables(t)).select("normalized_number", *_COMPACT)


_PN = f"(SELECT e.normalized_number AS num, {_OP.replace('hit.', 'x.hit.').replace('sub', 'x.sub')} AS operator, x.hit IS NOT NULL AND coalesce(x.hit.e >= x.sub, false) AS matched FROM {_ENTRY} e JOIN (SELECT n.normalized_number, max(struct_pack(s := p.start_number, e := p.end_number, o := p.operator, r := p.region, c := p.capacity, t := p.number_type)) AS hit, any_value(TRY_CAST(substr(n.normalized_number, 6) AS BIGINT)) AS sub FROM {_ENTRY} n LEFT JOIN numbering_plan p ON p.def_code = TRY_CAST(substr(n.normalized_number, 3, 3) AS BIGINT) AND p.start_number <= TRY_CAST(substr(n.normalized_number, 6) AS BIGINT) GROUP BY n.normalized_number) x ON x.normalized_number = e.normalized_number)"


@query("ft02_operator_features", f"""SELECT num AS normalized_number, CASE WHEN matched THEN 1.0 ELSE 0.0 END AS "isValidRuRange", CASE WHEN b = 'mts' THEN 1.0 ELSE 0.0 END AS "operatorMts", CASE WHEN b = 'tele2' THEN 1.0 ELSE 0.0 END AS "operatorTele2", CASE WHEN b = 'megafon' THEN 1.0 ELSE 0.0 END AS "operatorMegafon", CASE WHEN b = 'beeline' THEN 1.0 ELSE 0.0 END AS "operatorBeeline", CASE WHEN b = 'mvno' THEN 1.0 ELSE 0.0 END AS "operatorMvno",
    CASE WHEN starts_with(lower(src), 'whitelist') THEN 0.0 ELSE coalesce(o.risk, {_FALL}) END AS "defCodeOperatorRisk" FROM (SELECT x.*, {bucket_sql('operator')} AS b, e.source AS src FROM {_PN} x JOIN {_ENTRY} e ON e.normalized_number = x.num) y
    LEFT JOIN {_OPC} o ON o.bucket = y.b AND o.def_code = {def_text_sql('y.num')}""", "isValidRuRange operatorMts operatorTele2 operatorMegafon operatorBeeline operatorMvno defCodeOperatorRisk")
def _(t: Tables):
    entries = B.build_entries(t.whitelist, _aggregated(t), t.numbering_plan)
    out = X.compact_features(entries, _tables(t)).select("normalized_number", "isValidRuRange", "operatorMts", "operatorTele2", "operatorMegafon", "operatorBeeline", "operatorMvno", "defCodeOperatorRisk")
    assert set(out.columns[1:]) | set(_COMPACT) == set(S.COMPACT_FEATURES)
    return out


_TOT = f"greatest({_VOT}, greatest(e.review_count, {_VOT}), 1)::DOUBLE"


@query("ft03_metadata_record", f"""SELECT e.normalized_number, e.label, CASE e.label WHEN 'ALLOW' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END AS label_id, e.weight, greatest(e.review_count, {_VOT}) AS review_count, e.negative_count / {_TOT} AS negative_ratio, e.positive_count / {_TOT} AS positive_ratio,
    ln(1.0 + e.search_volume) AS search_volume_log, ln(1.0 + e.view_count) AS view_count_log, substr(e.normalized_number, 3, 3) AS def_code FROM {_ENTRY} e""", "weight negative_ratio positive_ratio search_volume_log view_count_log", "label_id")
def _(t: Tables):
    entries = B.build_entries(t.whitelist, _aggregated(t), t.numbering_plan)
    record = X.metadata_record(entries, _tables(t))
    assert record.columns == S.METADATA_COLUMNS + S.COMPACT_FEATURES
    code = F.when(F.col("def_code") == "77", "077").otherwise(F.col("def_code"))
    return record.select("normalized_number", "label", "label_id", "weight", "review_count", "negative_ratio", "positive_ratio", "search_volume_log", "view_count_log", code.alias("def_code"))


@query("ft07_cold_features", f"""SELECT e.normalized_number, 0.0 AS "sourceConfidence", 0.0 AS "reputationScore", 1.0 AS "noMetadata", coalesce(pr.risk, {_FALL}) AS "prefixRisk", coalesce(h.entropy, 0.0) AS "prefixEntropy" FROM numbers e
    LEFT JOIN ({_risk(6, 10, 3)}) pr ON pr.prefix = substr({_N}, 1, 6) LEFT JOIN ({_PARTS[1]}) h ON h.prefix = substr({_N}, 1, 6)""", "sourceConfidence reputationScore noMetadata prefixRisk prefixEntropy")
def _(t: Tables):
    return X.cold_features(t.numbers, _tables(t)).select("normalized_number", "sourceConfidence", "reputationScore", "noMetadata", "prefixRisk", "prefixEntropy")


@query("ft05_call_features", f"""SELECT c.id, least((SELECT count(*) FROM calls h WHERE h.number = c.number AND h.ts < c.ts AND h.ts >= c.ts - 604800000) / 10.0, 1.0) AS call_frequency, coalesce(pr.risk, {_FALL}) AS "prefixRisk",
    CASE WHEN b.normalized_number IS NOT NULL THEN 1.0 ELSE least(1.0, coalesce(pr.risk, {_FALL}) * 0.55) END AS reputation FROM calls c LEFT JOIN ({_risk(6, 10, 3)}) pr ON pr.prefix = substr(c.number, 1, 6) LEFT JOIN blocklist b ON b.normalized_number = c.number WHERE c.number IS NOT NULL""",
       "call_frequency prefixRisk reputation")
def _(t: Tables):
    calls = E.call_frequency(t.calls.filter("number is not null"))
    tables = _tables(t)
    found = L.prefix_risk_lookup(calls, tables.prefix_risk, tables.header_value("overall_block_rate"), "number")
    black = t.blocklist.select(F.col("normalized_number").alias("number"), F.lit(True).alias("black"))
    found = found.join(black, "number", "left")
    no = F.lit(False)
    rep = X.local_reputation(F.col("prefixRisk"), F.coalesce("black", no), no, no, no)
    return found.select("id", "call_frequency", "prefixRisk", rep.alias("reputation"))


def _cnt(test: str, days: int) -> str:
    return f"(SELECT count(*) FROM calls h WHERE h.number = c.number AND h.ts < c.ts AND h.ts >= c.ts - {days * 86400000} AND {test})"


def _used(cats: str) -> str:
    return _one(f"EXISTS (SELECT 1 FROM usage u WHERE u.user = c.user AND u.category IN ({cats}) AND u.ts < c.ts AND u.ts >= c.ts - 1800000)")


def _told(bucket: str) -> str:
    return _one(f"EXISTS (SELECT 1 FROM usage u WHERE u.user = c.user AND u.bucket = '{bucket}' AND u.ts < c.ts AND u.ts >= c.ts - 600000)")


_MISS = "(SELECT max(h.ts) FROM calls h WHERE h.number = c.number AND h.ts < c.ts AND h.state = 'MISSED')"
_OUTG = "(SELECT max(h.ts) FROM calls h WHERE h.number = c.number AND h.ts < c.ts AND h.direction = 'OUTGOING')"
_DEVICE = {
    "is_contact": _one("EXISTS (SELECT 1 FROM contacts k WHERE k.user = c.user AND k.number = c.number)"), "previously_rejected": _one(_cnt("h.state = 'REJECTED'", 30) + " > 0"),
    "is_night_time": _one("(c.ts // 3600000) % 24 >= 22 OR (c.ts // 3600000) % 24 < 8"), "is_weekend": _one("(c.ts // 86400000) % 7 IN (2, 3)"),
    "prev_missed_no_callback_24h": _one(f"coalesce({_MISS} >= c.ts - 86400000 AND ({_OUTG} IS NULL OR {_OUTG} <= {_MISS}), false)"),
    "prev_outgoing_after_missed": _one("EXISTS (SELECT 1 FROM calls o WHERE o.number = c.number AND o.direction = 'OUTGOING' AND o.ts < c.ts AND o.ts >= c.ts - 604800000 AND EXISTS (SELECT 1 FROM calls m WHERE m.number = o.number AND m.state IN ('MISSED', 'REJECTED') AND m.ts < o.ts))"),
    "recent_bank_app_30m": _used("'BANK', 'INVESTMENTS'"), "recent_gov_app_30m": _used("'GOVERNMENT'"), "recent_marketplace_app_30m": _used("'MARKETPLACE', 'DELIVERY'"), "recent_messenger_app_30m": _used("'MESSENGER'"),
    "notif_bank_recent_10m": _told("BANK"), "notif_marketplace_recent_10m": _told("MARKETPLACE"), "same_carrier_as_user": _one("coalesce(starts_with(c.number, '+7'), false)"), "is_short_code": "0.0",
    "same_prefix_call_count_7d_norm": "least((SELECT count(*) FROM calls h WHERE substr(h.number, 1, 5) = substr(c.number, 1, 5) AND h.ts < c.ts AND h.ts >= c.ts - 604800000), 10) / 10.0",
    "answer_rate_for_number_norm": f"CASE WHEN {_cnt('true', 30)} > 0 THEN {_cnt(chr(39).join(['h.state = ', 'ANSWERED', '']), 30)} / {_cnt('true', 30)} ELSE 0.0 END", "hidden_number": _one("c.number IS NULL"),
}


@query("ft06_device_features", f"SELECT c.id, {', '.join(f'{v} AS {k}' for k, v in _DEVICE.items())} FROM calls c", " ".join(_DEVICE))
def _(t: Tables):
    return E.device_features(t.calls, t.usage, t.usage, t.contacts).select("id", *S.DEVICE_FEATURES)


@query("ft06_degraded_features", "SELECT c.id, 0.0 AS is_contact, 0.0 AS previously_rejected, 0.0 AS recent_bank_app_30m, 0.0 AS notif_bank_recent_10m, CASE WHEN (c.ts // 3600000) % 24 >= 22 OR (c.ts // 3600000) % 24 < 8 THEN 1.0 ELSE 0.0 END AS is_night_time FROM calls c",
       "is_contact previously_rejected recent_bank_app_30m notif_bank_recent_10m is_night_time")
def _(t: Tables):
    off = {"call_log": False, "contacts": False, "usage": False, "notifications": False, "carrier": False}
    return E.device_features(t.calls, t.usage, t.usage, t.contacts, off).select("id", "is_contact", "previously_rejected", "recent_bank_app_30m", "notif_bank_recent_10m", "is_night_time")


@query("src15_three_tables", f"SELECT e.normalized_number, e.label, CASE e.label WHEN 'ALLOW' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END AS label_id, e.weight, e.source FROM {_ENTRY} e", "weight", "label_id")
def _(t: Tables):
    entries = B.build_entries(t.whitelist, _aggregated(t), t.numbering_plan)
    folder = scratch_path(t.spark, "three-tables")
    sinks.write_three_tables(X.metadata_record(entries, _tables(t)), folder)
    back = feeds.read_feed(t.spark, folder + "/labelled")
    return back.select("normalized_number", "label", F.col("label_id").cast("bigint").alias("label_id"), F.col("weight").cast("double").alias("weight"), "source")


@query("src19_feedback_table", f"""SELECT e.normalized_number, 'WARN' AS verdict, 'not_spam' AS user_action, 1.0 AS "noMetadata", coalesce(pr.risk, {_FALL}) AS "prefixRisk" FROM numbers e LEFT JOIN ({_risk(6, 10, 3)}) pr ON pr.prefix = substr({_N}, 1, 6)""", "noMetadata prefixRisk")
def _(t: Tables):
    cold = X.cold_features(t.numbers, _tables(t)).withColumn("verdict", F.lit("")).withColumn("model_verdict", F.lit("warn"))
    out = sinks.feedback_table(cold, "not_spam")
    assert not Q.header_issues(out.columns, ["normalized_number", "verdict", "user_action", *S.COMPACT_FEATURES])
    return out.select("normalized_number", "verdict", "user_action", "noMetadata", "prefixRisk")


@query("build_balanced_records")
def _(t: Tables):
    entries = B.build_entries(t.whitelist, _aggregated(t), t.numbering_plan)
    return X.metadata_record(B.balance(entries), _tables(t))
