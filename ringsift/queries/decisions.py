"""Ordered rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules as R
from ..functions.once import settle
from ..operators import decide as D
from ..operators import events as E
from .bindings import Tables
from .registry import query
from .scalars import any_of, flags_sql

_CF = flags_sql("r.categories")
_NEG = "r.negative_count"
_VOT = "(r.negative_count + r.positive_count + r.neutral_count)"
_REV = f"greatest(r.review_count, {_VOT})"
_TOT = f"greatest({_VOT}, {_REV}, 1)::DOUBLE"
_NR, _PR = f"r.negative_count / {_TOT}", f"r.positive_count / {_TOT}"
_BOO = "(1.0::DOUBLE + (r.source_reliability - 0.5) * 0.4::DOUBLE)"
_SV = "(CASE WHEN r.search_volume <= 0 AND r.view_count > 0 THEN r.view_count ELSE r.search_volume END)"
_WL = "CASE WHEN w.source_confidence < 0.35 THEN 0.25 ELSE round_even(least(2.0, greatest(0.5, w.source_confidence * 2.0)), 2) END"


def _ladder(allow: str, black: str, none: str, fraud: str, neg: str, tele: str, search: str, good: str, rest: str) -> str:
    return f"""CASE WHEN w.normalized_number IS NOT NULL THEN {allow} WHEN r.source = 'moshelovka' THEN {black} WHEN r.normalized_number IS NULL THEN {none}
        WHEN {_CF['fraud']} AND ({_NR} >= 0.5 OR {_NEG} >= 2 OR r.source_confidence >= 0.8) THEN {fraud} WHEN {_NR} >= 0.75 AND {_REV} >= 3 THEN {neg} WHEN {_CF['tele']} OR {_NR} >= 0.35 THEN {tele}
        WHEN {_SV} >= 500 AND {_REV} <= 2 THEN {search} WHEN {_PR} >= 0.75 AND {_REV} >= 3 THEN {good} ELSE {rest} END"""


@query("dec01_weak_labels", f"""SELECT r.ord, {_ladder("'ALLOW'", "'BLOCK'", "'WARN'", "'BLOCK'", "'BLOCK'", "'WARN'", "'WARN'", "'ALLOW'", "'WARN'")} AS label,
    {_ladder(_WL, '2.0', '0.25', f'round_even(1.7::DOUBLE * {_BOO}, 2)', f'round_even(1.5::DOUBLE * {_BOO}, 2)', f'round_even(1.0::DOUBLE * {_BOO}, 2)', f'round_even(0.8::DOUBLE * {_BOO}, 2)', '0.9', '0.5')} AS weight,
    coalesce(w.source, r.source) AS source FROM reputation_raw r LEFT JOIN whitelist w USING (normalized_number)""", "weight")
def _(t: Tables):
    r = t.reputation_raw
    rep = F.struct(*[c for c in r.columns if c not in ("ord", "normalized_number")])
    allow = t.whitelist.select("normalized_number", F.struct("source", "source_confidence").alias("w"))
    rows = r.select("ord", "normalized_number", rep.alias("r")).join(allow, "normalized_number", "left")
    out = rows.withColumn("l", D.weak_label(F.col("w"), F.col("r"), F.col("r.source") == "moshelovka"))
    return out.select("ord", "l.label", "l.weight", "l.source")


_LC = "lower(categories)"
_ANYB, _ANYW = any_of(_LC, D.LEGACY_BLOCK_WORDS), any_of(_LC, D.LEGACY_WARN_WORDS)


def _legacy(allow, b2, w15, b15, r1, r2, r3, r4, rest) -> str:
    return f"""CASE WHEN ord % 9 = 0 THEN {allow} WHEN ord % 4 = 0 AND {_ANYB} THEN {b2} WHEN ord % 4 = 0 AND {_ANYW} THEN {w15} WHEN ord % 4 = 0 THEN {b15}
        WHEN {_ANYB} AND negative_count > positive_count * 3 THEN {r1} WHEN {_ANYW} AND negative_count > positive_count THEN {r2} WHEN negative_count > 5 AND negative_count > positive_count * 2 THEN {r3}
        WHEN positive_count > negative_count * 2 AND positive_count >= 3 THEN {r4} ELSE {rest} END"""


@query("dec02_legacy_labels", f"SELECT ord, {_legacy(*[repr(x) for x in ('ALLOW', 'BLOCK', 'WARN', 'BLOCK', 'BLOCK', 'WARN', 'WARN', 'ALLOW', 'WARN')])} AS label, {_legacy(2.0, 2.0, 1.5, 1.5, 1.0, 1.0, 0.8, 0.8, 0.3)} AS weight FROM reputation_raw", "weight")
def _(t: Tables):
    o = F.col("ord")
    black = F.when(o % 4 == 0, F.struct(F.col("categories").alias("category"), F.col("source").alias("source")))
    reviews = F.struct("negative_count", "positive_count", "categories")
    return t.reputation_raw.select("ord", D.legacy_label(o % 9 == 0, black, reviews).alias("l")).select("ord", "l.label", "l.weight")


_FH, _WH = "search_volume % 4", "view_count % 3"
_LN = f"CASE WHEN source = 'moshelovka' THEN greatest(negative_count, 3) WHEN {_FH} > 0 THEN greatest(negative_count, {_FH}, 2) ELSE greatest(negative_count, {_WH}, 1) END"


@query("dec03_evidence_label", f"""SELECT ord, CASE WHEN source = 'moshelovka' OR {_FH} > 0 THEN 'BLOCK' ELSE 'WARN' END AS label_hint, {_LN} AS negative_count,
    CASE WHEN source = 'moshelovka' THEN greatest(review_count, 1, ({_LN}) + positive_count + neutral_count) ELSE greatest(review_count, ({_LN}) + positive_count + neutral_count, 1) END AS review_count,
    CASE WHEN source = 'moshelovka' THEN 0.95 WHEN {_FH} > 0 THEN 0.85 ELSE 0.65 END AS source_confidence FROM reputation_raw WHERE source = 'moshelovka' OR {_FH} > 0 OR {_WH} > 0 OR negative_count > positive_count""", "source_confidence")
def _(t: Tables):
    v = D.evidence_label(
        F.col("source"), F.col("search_volume") % 4, F.col("view_count") % 3, F.col("negative_count"), F.col("positive_count"), F.col("neutral_count"),
        F.col("review_count"), F.lit(None).cast("double"))
    return t.reputation_raw.select("ord", v.alias("v")).filter("v is not null").select("ord", "v.*")


@query("dec04_cold_rule", """SELECT key, CASE WHEN verdict = 'BLOCK' THEN 'BLOCK' WHEN verdict = 'WARN' OR (key % 2 = 0 AND key % 3 > 0 AND "prefixRisk" >= 0.65 AND key % 5 <> 0) THEN 'WARN' ELSE 'ALLOW' END AS verdict FROM (SELECT *, label AS verdict FROM classed) x""")
def _(t: Tables):
    k = F.col("key")
    one = lambda test: F.when(test, 1.0).otherwise(0.0)
    f = {
        "isRussianNumber": F.lit(1.0), "isMobileRu": one(k % 3 == 1), "isGeographical": one(k % 3 == 2), "isContact": one(k % 5 == 0), "inAllowlist": F.lit(0.0),
        "isShortCode": F.lit(0.0), "isTollFree8800": F.lit(0.0), "prefixRisk": F.col("prefixRisk"),
    }
    hit = D.cold_rule_hits(f, F.when(k % 2 == 0, "cold").otherwise("dataset"))
    return t.classed.select("key", D.raise_verdict(F.col("label"), hit).alias("verdict"))


_TH = "CASE WHEN l_quantity > 25 THEN {} ELSE {} END"


@query("dec05_verdict_thresholds", f"""SELECT l_quantity, v, m, count(*) AS rows FROM (SELECT l_quantity, CASE WHEN p_block >= {_TH.format(0.77, 0.24)} THEN 'BLOCK' WHEN p_warn >= {_TH.format(0.31, 0.15)} THEN 'WARN' ELSE 'ALLOW' END AS v,
    CASE WHEN p_allow >= p_warn AND p_allow >= p_block THEN 'ALLOW' WHEN p_warn >= p_block THEN 'WARN' ELSE 'BLOCK' END AS m FROM scores) x GROUP BY ALL""", "l_quantity")
def _(t: Tables):
    b, w = D.thresholds_for(F.col("l_quantity") > 25, (0.24, 0.15), (0.77, 0.31))
    none = F.lit(None).cast("double")
    scores = [F.col(c) for c in ("p_allow", "p_warn", "p_block")]
    rows = t.scores.select("l_quantity", D.verdict_from_scores(*scores, b, w).alias("v"), D.verdict_from_scores(*scores, none, none).alias("m"))
    return rows.groupBy("l_quantity", "v", "m").agg(F.count(F.lit(1)).alias("rows"))


@query("dec06_verdict_formats", "SELECT three, two, count(*) AS rows FROM (SELECT CASE WHEN p_block >= 0.5 THEN 2 WHEN p_warn >= 0.1 THEN 1 ELSE 0 END AS three, CASE WHEN p_block >= 0.5 THEN 2 WHEN p_block >= 0.2 THEN 1 ELSE 0 END AS two FROM scores) x GROUP BY ALL", ints="three two")
def _(t: Tables):
    rows = t.scores.select(D.verdict_id("three_class", F.col("p_block"), F.col("p_warn"), 0.5, 0.1).alias("three"), D.verdict_id("binary", F.col("p_block"), None, 0.5, 0.2).alias("two"))
    return rows.groupBy("three", "two").agg(F.count(F.lit(1)).alias("rows"))


# Flags of a decision, from its id, for the device rules.
_FLAGS = {
    "hiddenNumber": 13, "contactsAvailable": 2, "isContact": 5, "isRussianNumber": 3, "isForeignNumber": 17, "isShortCode": 19, "spoofingPrefixFlag": 23, "isValidRuRange": 4,
    "isTollFree8800": 29, "inAllowlist": 11, "beautifulNumberFlag": 7, "isNightTime": 6, "recentBankApp": 8, "recentGovApp": 9, "recentMarketplaceApp": 10, "previouslyRejected": 12,
    "callerVerifyFailed": 31,
}
_V, _B = "(1.0::DOUBLE + (id % 100) / 200.0)", "(1.0::DOUBLE - (id % 90) / 300.0)"
_RK, _RP, _CFQ, _WV = "((id % 101) / 100.0::DOUBLE)", "((id % 61) / 60.0::DOUBLE)", "((id % 41) / 40.0::DOUBLE)", "(id % 40)"


def _is(name: str) -> str:
    return f"(id % {_FLAGS[name]} = 0)"


_LISTED = f"({_is('inAllowlist')} OR {_is('isContact')})"
_FACTORS = [
    ("hidden_number", "50", _V, _is("hiddenNumber")), ("not_contact", "20", f"CASE WHEN {_is('contactsAvailable')} THEN 1.0 ELSE 0.5 END", f"NOT {_is('isContact')} AND NOT {_is('hiddenNumber')}"),
    ("russian_unknown", "15", _B, f"{_is('isRussianNumber')} AND NOT {_is('isContact')}"), ("foreign_number", "10", "CASE WHEN id % 2 = 0 THEN 0.3 ELSE 1.0 END", _is("isForeignNumber")),
    ("short_code", "5", "CASE WHEN id % 3 = 0 THEN 0.3 ELSE 0.7 END", _is("isShortCode")), ("spoofing_prefix", "55", _V, _is("spoofingPrefixFlag")),
    ("invalid_ru_range", "15", _B, f"{_is('isRussianNumber')} AND NOT {_is('isValidRuRange')} AND NOT {_is('isShortCode')}"), ("tollfree_8800", "8", f"CASE WHEN {_is('inAllowlist')} THEN 0.0 ELSE 0.7 END", _is("isTollFree8800")),
    ("beautiful_number", "10", _B, f"{_is('beautifulNumberFlag')} AND NOT {_is('inAllowlist')}"), ("reputation_score", f"floor({_RP} * 45)", "1.0", f"{_RP} > 0.45 AND NOT {_is('inAllowlist')}"),
    ("prefix_risk", f"floor({_RK} * 25)", _B, f"{_RK} > 0.3 AND {_RK} < 0.65"), ("prefix_risk_high", f"floor({_RK} * 45)", f"CASE WHEN {_LISTED} THEN 0.0 ELSE {_B} END", f"{_RK} >= 0.65 AND NOT {_LISTED}"),
    ("night_time", "20", _V, _is("isNightTime")), ("recent_bank_app", "25", "least(1.5, greatest(0.3, (id % 160) / 100.0::DOUBLE))", _is("recentBankApp")), ("recent_gov_app", "15", "least(1.2, greatest(0.3, (id % 160) / 100.0::DOUBLE))", _is("recentGovApp")),
    ("recent_marketplace", "10", "least(1.0, greatest(0.2, (id % 110) / 100.0::DOUBLE))", _is("recentMarketplaceApp")), ("call_frequency", f"floor({_CFQ} * 30)", "1.0", f"{_CFQ} > 0.5"), ("previously_rejected", "15", "1.0", _is("previouslyRejected")),
    ("caller_verify_failed", "30", _V, _is("callerVerifyFailed")), ("prefix_call_wave", f"least(15 + least({_WV}, 30) * 2, 60)", f"CASE WHEN {_LISTED} THEN 0.0 ELSE 1.0 END", f"{_WV} >= 5 AND NOT {_is('inAllowlist')}"),
]
_SUM = " + ".join(f"CASE WHEN {test} THEN floor(({pts}) * ({w})::DOUBLE) ELSE 0 END" for _, pts, w, test in _FACTORS)
_CNT = " + ".join(f"CASE WHEN {test} THEN 1 ELSE 0 END" for _, _, _, test in _FACTORS)
_SCO = f"CAST(greatest(0, least(100, {_SUM})) AS BIGINT)"


def _factors():
    i = F.col("id")
    f = {name: (i % m) == 0 for name, m in _FLAGS.items()}
    f |= {"prefixRisk": (i % 101) / 100.0, "reputationScore": (i % 61) / 60.0, "callFrequency": (i % 41) / 40.0, "prefixCalls7d": i % 40}
    p = {"vulnerability": i % 100, "business": i % 90, "digital": (i % 160).cast("double"), "ads": (i % 110).cast("double"), "foreign_contacts": i % 2 == 0, "home_phone": i % 3 == 0}
    return D.risk_factors(f, p)


@query("dec07_risk_factors", f"SELECT id, {_SCO} AS score, {_CNT} AS active, CASE WHEN {_SCO} >= 70 THEN 'DANGEROUS' WHEN {_SCO} >= 35 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS level FROM decisions", ints="active")
def _(t: Tables):
    rows = t.decisions.select("id", _factors().alias("f"))
    rows = rows.select("id", D.rule_score(F.col("f")).alias("score"), F.size("f").alias("active"))
    return rows.withColumn("level", D.risk_level(F.col("score")))


_WAVE = f"(CASE WHEN {_FACTORS[-1][3]} THEN floor({_FACTORS[-1][1]} * {_FACTORS[-1][2]}) ELSE 0 END)"
_HARD = f"({_is('spoofingPrefixFlag')} OR {_is('callerVerifyFailed')})"


@query("dec08_rule_override", f"""SELECT id, CASE WHEN id % 37 = 0 THEN 'allowlist' WHEN id % 43 = 0 THEN 'blacklist' WHEN id % 47 = 0 THEN 'contact' ELSE 'model' END AS source,
    CASE WHEN id % 37 = 0 THEN 'ALLOW' WHEN id % 43 = 0 THEN 'BLOCK' WHEN id % 47 = 0 THEN 'ALLOW' WHEN verdict = 'WARN' AND ({_WAVE} >= 30 OR {_HARD}) THEN 'BLOCK' WHEN verdict = 'ALLOW' AND ({_WAVE} >= 40 OR {_HARD}) THEN 'BLOCK'
      WHEN verdict = 'ALLOW' AND ({_WAVE} >= 20 OR {_SCO} >= 35) THEN 'WARN' ELSE verdict END AS verdict,
    CAST(CASE WHEN id % 37 = 0 THEN 0 WHEN id % 43 = 0 THEN 100 WHEN id % 47 = 0 THEN 0 WHEN (verdict = 'WARN' AND ({_WAVE} >= 30 OR {_HARD})) OR (verdict = 'ALLOW' AND ({_WAVE} >= 40 OR {_HARD})) THEN greatest(id % 90, 70)
      WHEN verdict = 'ALLOW' AND ({_WAVE} >= 20 OR {_SCO} >= 35) THEN greatest(id % 90, 35) ELSE id % 90 END AS BIGINT) AS score FROM decisions""")
def _(t: Tables):
    i = F.col("id")
    rows = t.decisions.select("id", "number", "verdict", _factors().alias("f")).withColumn("s", D.rule_score(F.col("f")))
    fast = D.fast_path(F.lit(True), F.col("number"), i % 37 == 0, i % 43 == 0, i % 47 == 0)
    slow = D.rule_override(F.col("verdict"), i % 90, F.col("s"), F.col("f"), F.lit(35), F.lit(70))
    rows = rows.withColumn("fast", fast).withColumn("slow", slow)
    return rows.select("id", F.coalesce("fast.source", F.lit("model")).alias("source"), F.coalesce("fast.verdict", "slow.verdict").alias("verdict"), F.coalesce("fast.score", "slow.score").alias("score"))


_CB, _DB, _DA = "(verdict = 'BLOCK' AND conf >= 0.70)", "(dv = 'BLOCK_HIGH')", "(dv = 'ALLOW' AND p < 0.20)"


@query("dec09_fusion", f"""SELECT id, CASE WHEN id % 29 = 0 THEN 'ALLOW' WHEN id % 31 = 0 THEN 'BLOCK' WHEN id % 5 = 0 OR dv IS NULL THEN verdict WHEN {_CB} AND {_DB} THEN 'BLOCK' WHEN {_CB} AND {_DA} THEN 'ALLOW' WHEN {_CB} OR {_DB} THEN 'WARN' WHEN verdict = 'ALLOW' AND dv = 'ALLOW' THEN 'ALLOW' ELSE 'WARN' END AS verdict,
    CASE WHEN id % 29 = 0 THEN 'whitelist_override' WHEN id % 31 = 0 THEN 'blacklist_override' WHEN id % 5 = 0 OR dv IS NULL THEN 'warmup_cloud_only' WHEN {_CB} AND {_DB} THEN 'consensus_block' WHEN {_CB} AND {_DA} THEN 'device_veto_allow' WHEN {_CB} OR {_DB} THEN 'single_block_downgrade_warn'
      WHEN verdict = 'ALLOW' AND dv = 'ALLOW' THEN 'agree_allow' ELSE 'either_warn' END AS tag FROM (SELECT id, verdict, CASE id % 4 WHEN 0 THEN 0.69 WHEN 1 THEN 0.3 ELSE 1.0 END AS conf, (id % 97) / 96.0::DOUBLE AS p,
    CASE WHEN id % 7 = 0 THEN NULL WHEN (id % 97) / 96.0::DOUBLE >= 0.80 THEN 'BLOCK_HIGH' WHEN (id % 97) / 96.0::DOUBLE >= 0.45 THEN 'WARN' ELSE 'ALLOW' END AS dv FROM decisions) x""")
def _(t: Tables):
    i = F.col("id")
    p = (i % 97) / 96.0
    conf = D.confidence_value(F.when(i % 4 == 0, "MEDIUM").when(i % 4 == 1, "LOW").otherwise("HIGH"))
    device = F.when(i % 7 != 0, D.device_verdict(p))
    return t.decisions.select("id", D.fuse(i % 29 == 0, i % 31 == 0, i % 5 != 0, F.col("verdict"), conf, device, p).alias("f")).select("id", "f.verdict", "f.tag")


@query("dec10_implicit_labels", """SELECT id, CASE WHEN direction = 'OUTGOING' OR (state = 'ANSWERED' AND duration_ms >= 15000) THEN 'ALLOW' ELSE 'BLOCK' END AS label, direction = 'INCOMING' AND state = 'MISSED' AS deferred FROM calls c
    WHERE direction = 'INCOMING' OR EXISTS (SELECT 1 FROM calls m WHERE m.number = c.number AND m.direction = 'INCOMING' AND m.state IN ('MISSED', 'REJECTED') AND m.ts >= c.ts - 2592000000)""")
def _(t: Tables):
    return E.implicit_labels(t.calls).select("id", "label", "deferred")


@query("dec11_call_states", """SELECT event_id AS id, CASE event_id % 7 WHEN 2 THEN 'OUTGOING' ELSE 'INCOMING' END AS direction, CASE event_id % 7 WHEN 1 THEN CASE WHEN value >= 100 THEN 'ANSWERED' ELSE 'REJECTED' END WHEN 2 THEN 'ANSWERED' WHEN 3 THEN 'MISSED' ELSE 'REJECTED' END AS state
    FROM events WHERE event_id % 7 IN (1, 2, 3, 5)""")
def _(t: Tables):
    v = D.call_state(F.col("event_id") % 7, F.when(F.col("value") >= 100, 60).otherwise(0))
    return t.events.select(F.col("event_id").alias("id"), v.alias("v")).filter("v is not null").select("id", "v.*")


@query("dec12_device_verdict", "SELECT id, CASE WHEN probability >= 0.80 THEN 'BLOCK_HIGH' WHEN probability >= 0.45 THEN 'WARN' ELSE 'ALLOW' END AS verdict FROM snapshots")
def _(t: Tables):
    return t.snapshots.select("id", D.device_verdict(F.col("probability")).alias("verdict"))


_QA = sorted({(q, a) for q, a, _, _ in R.PROFILE_POINTS})
_QLIST = sorted({q for q, _ in _QA})
_OPTS = {q: [a for qq, a in _QA if qq == q] + ["NONE_OF_THESE"] for q in _QLIST}


def _answers_sql() -> str:
    parts = []
    for i, q in enumerate(_QLIST):
        whens = " ".join(f"WHEN {j} THEN '{a}'" for j, a in enumerate(_OPTS[q]))
        parts.append(f"SELECT c_custkey AS user, '{q}' AS question, CASE (c_custkey * {i + 3} + {i}) % {len(_OPTS[q])} {whens} END AS answer FROM customer")
    return " UNION ALL ".join(parts)


_PTS = ", ".join(f"('{q}', '{a}', '{x}', {n})" for q, a, x, n in R.PROFILE_POINTS)
_AX = ", ".join(f"least(100.0, greatest(0.0, coalesce(sum(points) FILTER (axis = '{x}'), 0))) AS {x}" for x in R.PROFILE_AXES)


@query("dec13_profiles", f"""SELECT user, vulnerability, business, digital, ads, spam_tolerance, false_alarm, awareness, CASE WHEN false_alarm > 70 THEN 0.45 WHEN spam_tolerance > 70 OR vulnerability > 70 THEN 0.25 ELSE 0.35 END AS warn_threshold,
    CASE WHEN false_alarm > 70 OR business > 70 THEN 0.85 WHEN spam_tolerance > 70 OR vulnerability > 70 THEN 0.55 ELSE 0.70 END AS block_threshold FROM (SELECT user, {_AX} FROM ({_answers_sql()}) a
    LEFT JOIN (VALUES {_PTS}) p(question, answer, axis, points) USING (question, answer) GROUP BY user) x""", "vulnerability business digital ads spam_tolerance false_alarm awareness warn_threshold block_threshold")
def _(t: Tables):
    k = F.col("c_custkey")
    answers = []
    for i, q in enumerate(_QLIST):
        options = F.array(*[F.lit(a) for a in _OPTS[q]])
        answers.append(F.struct(F.lit(q).alias("question"), F.get(options, ((k * (i + 3) + i) % len(_OPTS[q])).cast("int")).alias("answer")))
    rows = t.customer.select(k.alias("user"), F.explode(F.array(*answers)).alias("a")).select("user", "a.*")
    return D.profile_scores(rows).drop("has_foreign_contacts", "has_home_phone")




@query("dec14_tag_categories", """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'medical' WHEN 1 THEN 'gov' WHEN 2 THEN 'craft' ELSE 'other' END AS category, CASE p_partkey % 8 WHEN 0 THEN 'osm_medical_clinic' WHEN 1 THEN 'osm_gov_notary' WHEN 2 THEN 'osm_craft_craft'
    WHEN 3 THEN 'osm_other_business' WHEN 4 THEN 'osm_org_hint' ELSE 'osm_addressed_business' END AS source, CASE p_partkey % 8 WHEN 0 THEN 0.95 WHEN 1 THEN 0.88 WHEN 2 THEN 0.78 WHEN 3 THEN 0.72 WHEN 4 THEN 0.66 ELSE 0.62 END AS confidence FROM part WHERE p_partkey % 8 < 6""", "confidence")
def _(t: Tables):
    k = F.col("p_partkey") % 8
    lit = F.lit
    tags = (
        F.when(k == 0, F.create_map(lit("name"), F.col("p_name"), lit("amenity"), lit("clinic"))).when(k == 1, F.create_map(lit("office"), lit("notary"), lit("x"), F.col("p_name")))
        .when(k == 2, F.create_map(lit("craft"), F.col("p_name"))).when(k == 3, F.create_map(lit("shop"), F.col("p_name"), lit("name"), lit("n"))).when(k == 4, F.create_map(lit("building"), F.col("p_name")))
        .when(k == 5, F.create_map(lit("addr:city"), lit("c"), lit("name"), F.col("p_name"))).when(k == 6, F.create_map(lit("amenity"), lit("bench"), lit("name"), F.col("p_name"))).otherwise(F.create_map(lit("note"), F.col("p_name")))
    )
    rows = settle(t.part, {"c": D.tag_category(tags)}).filter("c is not null")
    return rows.select(F.col("p_partkey").alias("id"), "c.category", "c.source", "c.confidence")




def _org(pick: int, blank: str, rest: str) -> str:
    return "CASE WHEN l = '' THEN " + blank + " " + " ".join(f"WHEN contains(l, '{r[0]}') THEN {repr(r[pick])}" for r in R.ORGANISATION_WORDS) + f" ELSE {rest} END"


_LABEL = "CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'Public Hospital ' || p_name WHEN 2 THEN 'Суд ' || p_name WHEN 3 THEN 'АГЕНТСТВО' WHEN 4 THEN p_name || ' hotel' WHEN 5 THEN 'Commercial bank' WHEN 6 THEN 'school agency' ELSE p_name END"


@query("dec15_organisation_types", f"""SELECT id, CASE WHEN id % 4 = 0 AND c = 'other' THEN 'sport' ELSE c END AS category, CASE WHEN id % 4 = 0 AND c = 'other' THEN greatest(p, 0.85) ELSE p END AS confidence FROM (
    SELECT id, {_org(1, "'other'", "'other'")} AS c, {_org(2, '0.78', '0.80')} AS p FROM (SELECT p_partkey AS id, lower({_LABEL}) AS l FROM part) a) b""", "confidence")
def _(t: Tables):
    k, name = F.col("p_partkey") % 9, F.col("p_name")
    label = (
        F.when(k == 0, "").when(k == 1, F.concat(F.lit("Public Hospital "), name)).when(k == 2, F.concat(F.lit("Суд "), name)).when(k == 3, "АГЕНТСТВО")
        .when(k == 4, F.concat(name, F.lit(" hotel"))).when(k == 5, "Commercial bank").when(k == 6, "school agency").otherwise(name))
    hint = F.when(F.col("p_partkey") % 4 == 0, "sport")
    return t.part.select(F.col("p_partkey").alias("id"), D.organisation_type(label, hint).alias("o")).select("id", "o.category", "o.confidence")


def _marks(column: str, words: list) -> str:
    return " ".join(f"WHEN contains(lower({column}), '{w}') THEN '{c}'" for w, c in words)


_PKG = "CASE ord % 6 WHEN 0 THEN package || '.bank' WHEN 1 THEN 'com.app' || (ord % 5) WHEN 2 THEN 'org.x.vpn' || ord ELSE package END"
_LBL = "CASE ord % 5 WHEN 0 THEN label || ' такси' ELSE label END"


@query("dec16_app_classifier", f"""SELECT ord, CASE WHEN trim(pk) = '' THEN 'OTHER' ELSE coalesce(k.category, CASE {_marks('pk', R.PACKAGE_WORDS)} END, CASE {_marks('lb', R.LABEL_WORDS)} END, 'OTHER') END AS category
    FROM (SELECT ord, {_PKG} AS pk, {_LBL} AS lb FROM app_corpus) a LEFT JOIN known_apps k ON k.package = a.pk""")
def _(t: Tables):
    o, k = F.col("ord"), F.col("ord") % 6
    package = (F.when(k == 0, F.concat("package", F.lit(".bank"))).when(k == 1, F.concat(F.lit("com.app"), (o % 5).cast("string"))).when(k == 2, F.concat(F.lit("org.x.vpn"), o.cast("string"))).otherwise(F.col("package")))
    label = F.when(o % 5 == 0, F.concat("label", F.lit(" такси"))).otherwise(F.col("label"))
    apps = t.app_corpus.select("ord", package.alias("package"), label.alias("label"))
    return D.app_category_of(apps, t.known_apps, "package", "label").select("ord", "category")


_BIZ = " ".join(f"WHEN {any_of('lower(text)', words)} THEN '{name}'" for name, words in D.BUSINESS_WORDS)


@query("dec17_business_category", f"""SELECT doc_id, category, CASE WHEN doc_id % 6 = 0 THEN 0.95 WHEN doc_id % 6 = 1 THEN 0.25 WHEN category IN ('delivery', 'government', 'bank', 'medical') THEN 0.85 ELSE 0.70 END AS confidence FROM (
    SELECT doc_id, CASE {_BIZ} ELSE 'other' END AS category FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' Аптека' WHEN 1 THEN ' БАНК и школа' WHEN 2 THEN ' доставка' ELSE '' END AS text FROM texts) a) b""", "confidence")
def _(t: Tables):
    k = F.col("doc_id") % 5
    more = F.when(k == 0, " Аптека").when(k == 1, " БАНК и школа").when(k == 2, " доставка").otherwise("")
    source = F.when(F.col("doc_id") % 6 == 0, "official_hotline").when(F.col("doc_id") % 6 == 1, "numbering_plan_x").otherwise("osm")
    rows = t.texts.select("doc_id", D.business_category(F.concat("text", more)).alias("category"), source.alias("source"))
    return rows.select("doc_id", "category", D.business_confidence(F.col("category"), F.col("source")).alias("confidence"))


@query("dec21_feedback_effects", """SELECT id, CASE WHEN action IN ('IS_SCAM', 'MARK_SPAM') THEN 'block' WHEN action IN ('NOT_SPAM', 'UNBLOCK') THEN 'allow' END AS list_change, CASE WHEN action IN ('NOT_SPAM', 'UNBLOCK', 'ANSWER') THEN 'allow' WHEN action IN ('IS_SCAM', 'MARK_SPAM') THEN 'block' ELSE lower(verdict) END AS label,
    CASE WHEN action = 'DISMISS' THEN 0.5 ELSE 2.0 END AS weight FROM feedback""", "weight")
def _(t: Tables):
    return E.feedback_effects(t.feedback).select("id", "list_change", "label", "weight")


def _fold(steps: str, keys: str, start: float, low: float, high: float) -> str:
    """One recursive step per row in order."""
    return f"""WITH RECURSIVE s AS (SELECT {keys}, delta, row_number() OVER (PARTITION BY {keys} ORDER BY ts, id) AS rn FROM ({steps}) q),
        w AS (SELECT {keys}, 0::BIGINT AS rn, {start}::DOUBLE AS value FROM (SELECT DISTINCT {keys} FROM s) k UNION ALL
        SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, s.rn, greatest({low}, least({high}, w.value + s.delta)) FROM w JOIN s ON {' AND '.join(f's.{k.strip()} = w.{k.strip()}' for k in keys.split(','))} AND s.rn = w.rn + 1)
        SELECT {keys}, arg_max(value, rn) AS value FROM w GROUP BY {keys}"""


_STEP = "CASE action WHEN 'NOT_SPAM' THEN -0.1 WHEN 'UNBLOCK' THEN -0.1 WHEN 'IS_SCAM' THEN 0.1 WHEN 'MARK_SPAM' THEN 0.1 WHEN 'ANSWER' THEN -0.05 ELSE 0.0 END"


@query("dec21_learned_weights", _fold(f"SELECT user, id, ts, unnest(list_slice(string_split(factors, ';'), 1, 3)) AS factor, 0.05::DOUBLE * ({_STEP})::DOUBLE AS delta FROM feedback", "user, factor", 1.0, 0.1, 3.0), "value")
def _(t: Tables):
    return E.learned_weights(t.feedback.withColumn("top_factors", F.split("factors", ";")))


_WS = "CASE action WHEN 'NOT_SPAM' THEN 0.02 WHEN 'UNBLOCK' THEN 0.02 WHEN 'IS_SCAM' THEN -0.02 WHEN 'MARK_SPAM' THEN -0.02 ELSE 0.0 END"


_BS = "CASE action WHEN 'UNBLOCK' THEN 0.03 WHEN 'MARK_SPAM' THEN -0.02 ELSE 0.0 END"


def _threshold(step: str, start: float, low: float, high: float) -> str:
    return _fold(f"SELECT user, id, ts, ({step})::DOUBLE AS delta FROM (SELECT *, count(*) OVER (PARTITION BY user ORDER BY ts) AS n FROM feedback) f WHERE n >= 5", "user", start, low, high)


@query("dec21_learned_warn", _threshold(_WS, 0.35, 0.15, 0.50), "value")
def _(t: Tables):
    return E.learned_thresholds(t.feedback).select("user", F.col("warn_threshold").alias("value"))


@query("dec21_learned_block", _threshold(_BS, 0.70, 0.50, 0.85), "value")
def _(t: Tables):
    return E.learned_thresholds(t.feedback).select("user", F.col("block_threshold").alias("value"))


@query("dec22_risk_score_floor", """SELECT p_block, lifted, CAST(CASE WHEN lifted THEN greatest(round_even(p_block * 100, 0), 31) ELSE round_even(p_block * 100, 0) END AS BIGINT) AS score, count(*) AS rows FROM (SELECT p_block, l_quantity > 25 AS lifted FROM scores) x GROUP BY ALL""", "p_block")
def _(t: Tables):
    lifted = F.col("l_quantity") > 25
    verdict = F.when(lifted, "WARN").otherwise("ALLOW")
    rows = t.scores.select("p_block", lifted.alias("lifted"), D.risk_score(F.col("p_block"), verdict, F.lit("ALLOW"), F.lit(0.31)).alias("score"))
    return rows.groupBy("p_block", "lifted", "score").agg(F.count(F.lit(1)).alias("rows"))


