"""Ordered rule tables over rows: labels, verdicts, scores, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import phone
from ..functions import text as T
from ..functions.numeric import clip, contains_any, safe_float
from ..functions.once import let

# --- weak labels ------------------------------------------------------------


def _answer(label: str | Column, weight: Column | float, source: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(label).alias("label"), lit(weight).cast("double").alias("weight"), lit(source).alias("source")
    )


def weak_label(allow: Column, reputation: Column, in_black: Column) -> Column:
    """Struct(label, weight, source) for one number.

    ``allow`` is null or a struct with source and source_confidence; ``reputation`` is null or a
    struct with the aggregated reputation columns. Rules are tried in order.
    """
    r = reputation
    zero = F.lit(0)
    neg = F.coalesce(r["negative_count"], zero)
    pos = F.coalesce(r["positive_count"], zero)
    votes = neg + pos + F.coalesce(r["neutral_count"], zero)
    reviews = F.greatest(F.coalesce(r["review_count"], zero), votes)
    views, search = F.coalesce(r["view_count"], zero), F.coalesce(r["search_volume"], zero)
    total = F.greatest(votes, reviews, F.lit(1))
    text = F.lower(F.coalesce(r["categories"], F.lit("")))
    facts = F.struct(
        neg.alias("neg"),
        reviews.alias("reviews"),
        F.when((search <= 0) & (views > 0), views).otherwise(search).alias("search"),
        (neg / total).alias("neg_ratio"),
        (pos / total).alias("pos_ratio"),
        contains_any(text, S.FRAUD_WORDS).alias("fraud"),
        contains_any(text, S.TELEMARKETING_WORDS).alias("tele"),
        (1.0 + (F.coalesce(r["source_reliability"], F.lit(0.5)) - 0.5) * 0.4).alias("boost"),
        F.coalesce(r["source_confidence"], F.lit(0.5)).alias("conf"),
        F.coalesce(r["source"], F.lit("reviews")).alias("src"),
    )
    a_conf = F.coalesce(allow["source_confidence"], F.lit(0.7))
    a_weight = F.when(a_conf < 0.35, 0.25).otherwise(F.bround(clip(a_conf * 2.0, 0.5, 2.0), 2))

    def by_reputation(f: Column) -> Column:
        def weight(w: float) -> Column:
            return F.bround(w * f["boost"], 2)

        proven = (f["neg_ratio"] >= 0.5) | (f["neg"] >= 2) | (f["conf"] >= 0.8)
        return (
            F.when(f["fraud"] & proven, _answer("BLOCK", weight(1.7), f["src"]))
            .when((f["neg_ratio"] >= 0.75) & (f["reviews"] >= 3), _answer("BLOCK", weight(1.5), f["src"]))
            .when(f["tele"] | (f["neg_ratio"] >= 0.35), _answer("WARN", weight(1.0), f["src"]))
            .when((f["search"] >= 500) & (f["reviews"] <= 2), _answer("WARN", weight(0.8), f["src"]))
            .when((f["pos_ratio"] >= 0.75) & (f["reviews"] >= 3), _answer("ALLOW", 0.9, f["src"]))
            .otherwise(_answer("WARN", 0.5, f["src"]))
        )

    return (
        F.when(allow.isNotNull(), _answer("ALLOW", a_weight, F.coalesce(allow["source"], F.lit("whitelist_official"))))
        .when(in_black, _answer("BLOCK", 2.0, F.coalesce(r["source"], F.lit("blacklist"))))
        .when(r.isNull(), _answer("WARN", 0.25, "unknown"))
        .otherwise(let(facts, by_reputation))
    )


# Category words of the older labeller.
LEGACY_BLOCK_WORDS = [
    "телефонное мошенничество", "мошенничество", "мошенник", "вымогательство", "фишинг", "scam", "fraud",
]
LEGACY_WARN_WORDS = [
    "спам", "нежелательный звонок", "реклама", "колл-центр", "телемаркетинг", "опрос", "навязывание услуг",
    "робоколл", "сборщик задолженностей", "коллекторы",
]


def legacy_label(in_allow: Column, black: Column, reviews: Column) -> Column:
    """Older labeller. ``black`` is null or a struct with category and source, ``reviews`` is null or
    a struct with summed negative_count, positive_count and joined categories."""
    words = F.lower(F.coalesce(black["category"], F.lit("")))
    cats = F.lower(F.coalesce(reviews["categories"], F.lit("")))
    neg = F.coalesce(reviews["negative_count"], F.lit(0))
    pos = F.coalesce(reviews["positive_count"], F.lit(0))
    has = reviews.isNotNull()
    return (
        F.when(in_allow, _answer("ALLOW", 2.0, "whitelist_official"))
        .when(black.isNotNull() & contains_any(words, LEGACY_BLOCK_WORDS), _answer("BLOCK", 2.0, black["source"]))
        .when(black.isNotNull() & contains_any(words, LEGACY_WARN_WORDS), _answer("WARN", 1.5, black["source"]))
        .when(black.isNotNull(), _answer("BLOCK", 1.5, black["source"]))
        .when(has & contains_any(cats, LEGACY_BLOCK_WORDS) & (neg > pos * 3), _answer("BLOCK", 1.0, "reviews"))
        .when(has & contains_any(cats, LEGACY_WARN_WORDS) & (neg > pos), _answer("WARN", 1.0, "reviews"))
        .when(has & (neg > 5) & (neg > pos * 2), _answer("WARN", 0.8, "reviews"))
        .when(has & (pos > neg * 2) & (pos >= 3), _answer("ALLOW", 0.8, "reviews"))
        .otherwise(_answer("WARN", 0.3, "unknown"))
    )


def evidence_label(
    source: Column, fraud_hits: Column, warn_hits: Column, negative: Column, positive: Column, neutral: Column,
    reviews: Column, confidence: Column,
) -> Column:
    """Struct of the evidence verdict, null when the page proves nothing. Never ALLOW."""

    def row(label: str, neg: Column, rev: Column, conf: float) -> Column:
        return F.struct(
            F.lit(label).alias("label_hint"),
            neg.cast("bigint").alias("negative_count"),
            F.greatest(rev, neg + positive + neutral).cast("bigint").alias("review_count"),
            F.coalesce(confidence, F.lit(conf)).alias("source_confidence"),
        )

    one = F.lit(1)
    neg_list = F.greatest(negative, F.lit(3))
    neg_fraud = F.greatest(negative, fraud_hits, F.lit(2))
    neg_warn = F.greatest(negative, warn_hits, one)
    return (
        F.when(source == "moshelovka", row("BLOCK", neg_list, F.greatest(reviews, one), 0.95))
        .when(fraud_hits > 0, row("BLOCK", neg_fraud, F.greatest(reviews, neg_fraud + positive + neutral, one), 0.85))
        .when(
            (warn_hits > 0) | (negative > positive),
            row("WARN", neg_warn, F.greatest(reviews, neg_warn + positive + neutral, one), 0.65),
        )
    )


# --- verdicts ---------------------------------------------------------------


def severity(verdict: Column) -> Column:
    return F.when(verdict == "BLOCK", 2).when(verdict == "WARN", 1).otherwise(0)


def severity_name(level: Column) -> Column:
    return F.when(level >= 2, "BLOCK").when(level == 1, "WARN").otherwise("ALLOW")


def cold_rule_hits(f: dict[str, Column], feature_source: Column, threshold: float = 0.65) -> Column:
    """A cold, unlisted national mobile or landline number with a risky prefix."""
    return (
        (feature_source == "cold")
        & (f["isRussianNumber"] >= 0.5)
        & ((f["isMobileRu"] >= 0.5) | (f["isGeographical"] >= 0.5))
        & (f["isContact"] < 0.5)
        & (f["inAllowlist"] < 0.5)
        & (f["isShortCode"] < 0.5)
        & (f["isTollFree8800"] < 0.5)
        & (f["prefixRisk"] >= threshold)
    )


def raise_verdict(verdict: Column, hit: Column, to: str = "WARN") -> Column:
    """Rules may only raise the severity."""
    level = F.when(hit, F.lit(S.LABEL_TO_ID[to])).otherwise(F.lit(0))
    return severity_name(F.greatest(severity(verdict), level))


def verdict_from_scores(allow: Column, warn: Column, block: Column, block_t: Column, warn_t: Column) -> Column:
    """Thresholds when both are known, else the greatest probability (first one on ties)."""
    by_threshold = F.when(block >= block_t, "BLOCK").when(warn >= warn_t, "WARN").otherwise("ALLOW")
    top = F.greatest(allow, warn, block)
    by_size = F.when(allow == top, "ALLOW").when(warn == top, "WARN").otherwise("BLOCK")
    return F.when(block_t.isNotNull() & warn_t.isNotNull(), by_threshold).otherwise(by_size)


def thresholds_for(cold: Column, warm_t: tuple[float, float], cold_t: tuple[float, float] | None) -> tuple[Column, Column]:
    """(block, warn) thresholds; the cold ones are preferred for cold rows."""
    if cold_t is None:
        return F.lit(warm_t[0]), F.lit(warm_t[1])
    pair = [F.when(cold, F.lit(c)).otherwise(F.lit(w)) for w, c in zip(warm_t, cold_t)]
    return pair[0], pair[1]


def verdict_id(output_format: str, block: Column, warn: Column | None, block_t: float, warn_t: float) -> Column:
    """Class id from the scores of a three-class or a binary model."""
    if output_format == "binary":
        return F.when(block >= block_t, 2).when(block >= warn_t, 1).otherwise(0)
    if output_format == "three_class" and warn is not None:
        return F.when(block >= block_t, 2).when(warn >= warn_t, 1).otherwise(0)
    raise ValueError(f"unknown output format {output_format!r}")


def risk_score(block: Column, verdict: Column, model_verdict: Column, warn_t: Column) -> Column:
    """Percent score, lifted to the warn threshold when a rule raised ALLOW to WARN."""
    score = F.bround(block * 100).cast("bigint")
    floor = F.bround(F.coalesce(warn_t, F.lit(0.10)) * 100).cast("bigint")
    lifted = (verdict == "WARN") & (model_verdict == "ALLOW")
    return F.when(lifted, F.greatest(score, floor)).otherwise(score)


def binary_label(label_id: Column, strategy: str) -> Column:
    """0/1 label; null marks rows to drop."""
    if strategy == "merge_block":
        return F.when(label_id >= 1, 1).otherwise(0)
    if strategy == "merge_allow":
        return F.when(label_id == 2, 1).otherwise(0)
    if strategy == "drop":
        return F.when(label_id == 2, 1).when(label_id == 0, 0)
    raise ValueError(f"unknown WARN strategy {strategy!r}")


def label_name(label_id: Column) -> Column:
    """Name of a class id given as text or number; anything else passes through."""
    text = F.trim(label_id.cast("string"))
    return F.when(text == "0", "ALLOW").when(text == "1", "WARN").when(text == "2", "BLOCK").otherwise(text)


# What a user's action makes of a verdict, and how much that counts.
CORRECTIONS = [
    ("not_spam", "BLOCK", "ALLOW", 3.0),
    ("not_spam", "WARN", "ALLOW", 2.0),
    ("fraud", "ALLOW", "BLOCK", 3.0),
    ("fraud", "WARN", "BLOCK", 2.0),
    ("dismiss", "BLOCK", "WARN", 1.5),
    ("dismiss", "WARN", "ALLOW", 1.5),
]


def corrected_label(action: Column, verdict: Column) -> Column:
    """Struct(label, weight) after feedback."""
    out = None
    for a, v, label, weight in CORRECTIONS:
        value = F.struct(F.lit(label).alias("label"), F.lit(weight).alias("weight"))
        test = (action == a) & (verdict == v)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(verdict.alias("label"), F.lit(1.0).alias("weight")))


def fine_tune_weight(feedback: Column, weight: Column, alpha: float = 0.3) -> Column:
    """1 for base rows, weight * alpha + (1 - alpha) for feedback rows."""
    return F.when(feedback, weight * alpha + (1.0 - alpha)).otherwise(F.lit(1.0))


# --- risk factors on the device --------------------------------------------


def risk_factors(f: dict[str, Column], p: dict[str, Column]) -> Column:
    """Array of struct(id, points, weight) of the factors that fire.

    ``f`` holds the features (flags as booleans), ``p`` the profile axes.
    """
    v = 1.0 + p["vulnerability"] / 200.0
    b = 1.0 - p["business"] / 300.0
    allow, contact = f["inAllowlist"], f["isContact"]
    listed = allow | contact
    one, zero = F.lit(1.0), F.lit(0.0)
    wave = F.least(15 + F.least(f["prefixCalls7d"], F.lit(30)) * 2, F.lit(60))
    risk, rep = f["prefixRisk"], f["reputationScore"]
    # Points, weights and conditions of the twenty factors.
    table = [
        ("hidden_number", F.lit(50), v, f["hiddenNumber"]),
        ("not_contact", F.lit(20), F.when(f["contactsAvailable"], 1.0).otherwise(0.5), ~contact & ~f["hiddenNumber"]),
        ("russian_unknown", F.lit(15), b, f["isRussianNumber"] & ~contact),
        ("foreign_number", F.lit(10), F.when(p["foreign_contacts"], 0.3).otherwise(1.0), f["isForeignNumber"]),
        ("short_code", F.lit(5), F.when(p["home_phone"], 0.3).otherwise(0.7), f["isShortCode"]),
        ("spoofing_prefix", F.lit(55), v, f["spoofingPrefixFlag"]),
        ("invalid_ru_range", F.lit(15), b, f["isRussianNumber"] & ~f["isValidRuRange"] & ~f["isShortCode"]),
        ("tollfree_8800", F.lit(8), F.when(allow, 0.0).otherwise(0.7), f["isTollFree8800"]),
        ("beautiful_number", F.lit(10), b, f["beautifulNumberFlag"] & ~allow),
        ("reputation_score", F.floor(rep * 45), one, (rep > 0.45) & ~allow),
        ("prefix_risk", F.floor(risk * 25), b, (risk > 0.3) & (risk < 0.65)),
        ("prefix_risk_high", F.floor(risk * 45), F.when(listed, zero).otherwise(b), (risk >= 0.65) & ~allow & ~contact),
        ("night_time", F.lit(20), v, f["isNightTime"]),
        ("recent_bank_app", F.lit(25), clip(p["digital"] / 100.0, 0.3, 1.5), f["recentBankApp"]),
        ("recent_gov_app", F.lit(15), clip(p["digital"] / 100.0, 0.3, 1.2), f["recentGovApp"]),
        ("recent_marketplace", F.lit(10), clip(p["ads"] / 100.0, 0.2, 1.0), f["recentMarketplaceApp"]),
        ("call_frequency", F.floor(f["callFrequency"] * 30), one, f["callFrequency"] > 0.5),
        ("previously_rejected", F.lit(15), one, f["previouslyRejected"]),
        ("caller_verify_failed", F.lit(30), v, f["callerVerifyFailed"]),
        ("prefix_call_wave", wave, F.when(listed, zero).otherwise(one), (f["prefixCalls7d"] >= 5) & ~allow),
    ]
    rows = [
        F.when(
            F.coalesce(test, F.lit(False)),
            F.struct(F.lit(name).alias("id"), points.cast("bigint").alias("points"), weight.alias("weight")),
        )
        for name, points, weight, test in table
    ]
    return F.array_compact(F.array(*rows))


def rule_score(factors: Column, learned: Column | None = None) -> Column:
    """Sum of truncated points times weight, 0..100. ``learned`` maps a factor id to its weight."""

    def term(x: Column) -> Column:
        w = x["weight"] if learned is None else F.coalesce(learned[x["id"]], x["weight"])
        return F.floor(x["points"] * w)

    total = F.aggregate(factors, F.lit(0).cast("bigint"), lambda acc, x: acc + term(x))
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def top_factors(factors: Column, k: int | None = None) -> Column:
    """Factor ids by points times weight, largest first."""
    keyed = F.transform(factors, lambda x: F.struct((-(x["points"] * x["weight"])).alias("o"), x["id"].alias("id")))
    ids = F.transform(F.array_sort(keyed), lambda x: x["id"])
    return F.slice(ids, 1, k) if k else ids


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "DANGEROUS").when(score >= 35, "SUSPICIOUS").otherwise("SAFE")


def rule_override(model_verdict: Column, model_score: Column, score: Column, factors: Column,
                  warn_t: Column, block_t: Column) -> Column:
    """Struct(verdict, score): the model's verdict, raised by call waves and hard rules."""
    wave = F.aggregate(
        F.filter(factors, lambda x: x["id"] == "prefix_call_wave"),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + F.floor(x["points"] * x["weight"]),
    )
    hard = F.exists(factors, lambda x: x["id"].isin("spoofing_prefix", "caller_verify_failed"))

    def out(verdict: str | Column, value: Column) -> Column:
        name = F.lit(verdict) if isinstance(verdict, str) else verdict
        return F.struct(name.alias("verdict"), value.cast("bigint").alias("score"))

    to_block = out("BLOCK", F.greatest(model_score, block_t))
    is_allow = model_verdict == "ALLOW"
    return (
        F.when((model_verdict == "WARN") & ((wave >= 30) | hard), to_block)
        .when(is_allow & ((wave >= 40) | hard), to_block)
        .when(is_allow & ((wave >= 20) | (score >= warn_t)), out("WARN", F.greatest(model_score, warn_t)))
        .otherwise(out(model_verdict, model_score))
    )


def fast_path(enabled: Column, number: Column, allowed: Column, blocked: Column, contact: Column) -> Column:
    """Struct(verdict, score, source) when the model is not needed, else null."""

    def out(verdict: str, score: int, source: str) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), F.lit(score).cast("bigint").alias("score"), F.lit(source).alias("source"))

    known = number.isNotNull()
    short = phone.digits(number)
    return (
        F.when(~enabled, out("ALLOW", 0, "disabled"))
        .when(known & short.isin(S.EMERGENCY_CODES), out("ALLOW", 0, "emergency_whitelist"))
        .when(known & allowed, out("ALLOW", 0, "allowlist"))
        .when(known & blocked, out("BLOCK", 100, "blacklist"))
        .when(known & contact, out("ALLOW", 0, "contact"))
    )


def rule_verdict(score: Column, warn_t: Column, block_t: Column) -> Column:
    return F.when(score >= block_t, "BLOCK").when(score >= warn_t, "WARN").otherwise("ALLOW")


# --- device model and fusion ------------------------------------------------


def device_verdict(p: Column) -> Column:
    return F.when(p >= 0.80, "BLOCK_HIGH").when(p >= 0.45, "WARN").otherwise("ALLOW")


def fuse(white: Column, black: Column, warm: Column, cloud: Column, confidence: Column, device: Column,
         device_p: Column) -> Column:
    """Struct(verdict, tag) from the two models, tried in order."""

    def out(verdict: str | Column, tag: str) -> Column:
        return F.struct((F.lit(verdict) if isinstance(verdict, str) else verdict).alias("verdict"), F.lit(tag).alias("tag"))

    cloud_block = (cloud == "BLOCK") & (confidence >= 0.70)
    device_block = device == "BLOCK_HIGH"
    strong_allow = (device == "ALLOW") & device_p.isNotNull() & (device_p < 0.20)
    return (
        F.when(white, out("ALLOW", "whitelist_override"))
        .when(black, out("BLOCK", "blacklist_override"))
        .when(~warm | device.isNull(), out(cloud, "warmup_cloud_only"))
        .when(cloud_block & device_block, out("BLOCK", "consensus_block"))
        .when(cloud_block & strong_allow, out("ALLOW", "device_veto_allow"))
        .when(cloud_block | device_block, out("WARN", "single_block_downgrade_warn"))
        .when((cloud == "ALLOW") & (device == "ALLOW"), out("ALLOW", "agree_allow"))
        .otherwise(out("WARN", "either_warn"))
    )


# Confidence names as numbers.
CONFIDENCE = {"HIGH": 1.0, "MEDIUM": 0.69, "LOW": 0.3}


def confidence_value(name: Column) -> Column:
    return F.when(name == "HIGH", CONFIDENCE["HIGH"]).when(name == "MEDIUM", CONFIDENCE["MEDIUM"]).otherwise(CONFIDENCE["LOW"])


def implicit_label(direction: Column, state: Column, duration_ms: Column, missed_before: Column) -> Column:
    """Struct(label, deferred) for one call, null when it says nothing."""

    def out(label: str, deferred: bool = False) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(deferred).alias("deferred"))

    incoming = direction == "INCOMING"
    return (
        F.when((direction == "OUTGOING") & missed_before, out("ALLOW"))
        .when(incoming & (state == "ANSWERED") & (duration_ms >= 15_000), out("ALLOW"))
        .when(incoming & (state == "ANSWERED"), out("BLOCK"))
        .when(incoming & (state == "REJECTED"), out("BLOCK"))
        .when(incoming & (state == "MISSED"), out("BLOCK", True))
    )


# Call-log types.
INCOMING, OUTGOING, MISSED, REJECTED = 1, 2, 3, 5


def call_state(kind: Column, duration_s: Column) -> Column:
    """Struct(direction, state) of a call-log row, null when it is to be dropped."""

    def out(direction: str, state: Column | str) -> Column:
        return F.struct(F.lit(direction).alias("direction"), (F.lit(state) if isinstance(state, str) else state).alias("state"))

    return (
        F.when(kind == INCOMING, out("INCOMING", F.when(duration_s > 0, "ANSWERED").otherwise("REJECTED")))
        .when(kind == OUTGOING, out("OUTGOING", "ANSWERED"))
        .when(kind == MISSED, out("INCOMING", "MISSED"))
        .when(kind == REJECTED, out("INCOMING", "REJECTED"))
    )


# --- ordered keyword tables -------------------------------------------------


def first_match(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Name of the first rule with a word in the text."""
    out = None
    for name, words in rules:
        test = contains_any(text, words)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(F.lit(default))


# Words of a business category, tried in this order.
BUSINESS_WORDS = [
    ("bank", ["банк", "финанс", "сбер", "тинькофф", "втб", "альфа", "кредит", "ломбард", "микрофинанс"]),
    ("government", ["госуслуг", "мфц", "министерств", "полиц", "налог", "мвд", "жкх", "управляющ"]),
    ("telecom", ["мтс", "билайн", "мегафон", "tele2", "ростелеком", "провайдер", "телеком"]),
    ("medical", ["больниц", "клиник", "стоматолог", "аптек", "медиц", "госпитал", "диагност", "ветеринар", "поликлиник", "лаборатор"]),
    ("education", ["университет", "школ", "колледж", "институт", "лицей", "гимназ", "детский сад"]),
    ("retail", ["магазин", "супермаркет", "пятёрочк", "магнит", "лента", "зоомагазин"]),
    ("delivery", ["доставк", "логист", "перевозк", "такси"]),
    ("insurance", ["страх"]),
    ("transport", ["автосервис", "автомобил", "автомойк", "шиномонтаж", "автосалон", "гостиниц", "хостел", "турист"]),
    ("utility", ["ремонт", "строительн", "электрик", "сантехник", "окна", "мебель", "кухн", "клининг", "прачечн", "химчистк"]),
    ("legal", ["юридич", "нотариус", "адвокат"]),
    ("realestate", ["риелтор", "недвижим", "застройщик"]),
    ("restaurant", ["ресторан", "кафе", "пиццер", "столов"]),
    ("beauty", ["салон", "красот", "парикмахер", "барбершоп"]),
    ("fitness", ["фитнес", "спортивн", "бассейн"]),
    ("religious", ["церковь", "мечеть", "храм"]),
]


def business_category(text: Column) -> Column:
    return first_match(F.lower(F.coalesce(text, F.lit(""))), BUSINESS_WORDS, "other")


def business_confidence(category: Column, source: Column) -> Column:
    """Default confidence of a directory row."""
    return (
        F.when(source.isin("official_whitelist", "official_hotline"), 0.95)
        .when((category == "personal_mobile") | source.startswith("numbering_plan"), 0.25)
        .when(category.isin("private_seller", "realestate_owner"), 0.55)
        .when(category.isin("freelancer", "realestate_agent"), 0.60)
        .when(category.isin("delivery", "government", "bank", "medical"), 0.85)
        .otherwise(0.70)
    )


def list_confidence(given: Column, category: Column, source: Column) -> Column:
    """Confidence of an allow-list row; the ladder applies when none is given."""
    ladder = (
        F.when(source.isin("official_whitelist", "official_hotline"), 0.95)
        .when((category == "personal_mobile") | source.startswith("numbering_plan"), 0.25)
        .when(category.isin("freelancer", "private_seller", "realestate_owner"), 0.55)
        .when(category.isin("delivery", "government", "bank", "medical"), 0.85)
        .otherwise(0.70)
    )
    value = safe_float(given, 0.0)
    return F.when(value > 0, value).otherwise(ladder)


def first_rule(text: Column, rules: list[tuple], default: tuple) -> Column:
    """Struct of the values v0, v1, ... of the first rule (word, value, ...) whose word occurs in the text.

    The rules are one constant array that is walked once per text.
    """

    def values(row: tuple) -> list[Column]:
        return [F.lit(v).alias(f"v{i}") for i, v in enumerate(row)]

    table = F.array(*[F.struct(F.lit(word).alias("word"), *values(tuple(rest))) for word, *rest in rules])
    hit = F.try_element_at(F.filter(table, lambda r: F.contains(text, r["word"])), F.lit(1))
    found = F.when(hit.isNotNull(), F.struct(*[hit[f"v{i}"].alias(f"v{i}") for i in range(len(default))]))
    return F.coalesce(found, F.struct(*values(default)))


def organisation_type(label: Column, bucket_hint: Column) -> Column:
    """Struct(category, confidence) of an organisation's type label."""
    from ..rules import ORGANISATION_WORDS

    text = F.lower(F.coalesce(label, F.lit("")))
    hint = F.coalesce(bucket_hint, F.lit(""))
    unknown = F.when(text == "", 0.78).otherwise(0.80)

    def named(r: Column) -> Column:
        other = r["v0"] == "other"
        conf = F.when(other, unknown).otherwise(r["v1"])
        promoted = other & (hint != "")
        return F.struct(
            F.when(promoted, hint).otherwise(r["v0"]).alias("category"),
            F.when(promoted, F.greatest(conf, F.lit(0.85))).otherwise(conf).alias("confidence"),
        )

    return let(first_rule(text, ORGANISATION_WORDS, ("other", 0.80)), named)


def app_category_of(df: DataFrame, known: DataFrame, package: str, label: str, out: str = "category") -> DataFrame:
    """Category of an app: known package, else word in the package, else word in the label, else OTHER.

    ``known`` is a dictionary table (package, category) of any size.
    """
    from ..operators.sizing import lookup_join
    from ..rules import LABEL_WORDS, PACKAGE_WORDS

    table = known.select(F.col("package").alias(package), F.col("category").alias("_known"))
    found = lookup_join(df, table, [package])
    none = F.lit(None).cast("string")
    by_package = first_rule(F.lower(F.col(package)), PACKAGE_WORDS, (none,))["v0"]
    by_label = first_rule(F.lower(F.coalesce(F.col(label), F.lit(""))), LABEL_WORDS, (none,))["v0"]
    value = F.coalesce(F.col("_known"), by_package, by_label, F.lit("OTHER"))
    blank = F.trim(F.coalesce(F.col(package), F.lit(""))) == ""
    return found.withColumn(out, F.when(blank, F.lit("OTHER")).otherwise(value)).drop("_known")


def tag_category(tags: Column) -> Column:
    """Struct(category, feature, source, confidence) of a map element's tags, null for non-organisations.

    ``tags`` is map<string,string>. Exact (key, value) pairs come first, in the order of the
    registry; then keys that count whatever their value; then three looser fallbacks. A pair is
    looked up under its key, so the work of an element follows its tags, not the registry.
    """
    return let(tags, _tag_category)


def _tag_category(tags: Column) -> Column:
    from ..rules import (
        ADDRESS_TAGS, NAME_TAGS, NEGATIVE_TAGS, ORGANISATION_TAGS, TAG_RULES,
    )

    def has_any(names: list[str]) -> Column:
        return F.arrays_overlap(F.map_keys(tags), F.array(*[F.lit(n) for n in names]))

    def answer(category: Column | str, feature: Column | str, source: Column | str, conf: Column | float) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(
            lit(category).alias("category"), lit(feature).alias("feature"),
            lit(source).alias("source"), lit(conf).alias("confidence"),
        )

    negative, barred = F.lit(False), {}
    for key, value in NEGATIVE_TAGS:
        if value == "*":
            negative = negative | F.array_contains(F.map_keys(tags), key)
        else:
            barred.setdefault(key, []).append(value)
    for key, values in barred.items():
        negative = negative | F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit("")).isin(values)
    exact = [r for r in TAG_RULES if r[2] != "*"]
    wild = [r for r in TAG_RULES if r[2] == "*"]
    rules = F.array(
        *[
            F.struct(F.lit(c).alias("c"), F.lit(k).alias("k"), F.lit(v).alias("v"), F.lit(f).alias("f"), F.lit(p).alias("p"))
            for c, k, v, f, p in exact
        ]
    )
    places: dict[str, dict[str, int]] = {}
    for i, (_, k, v, _, _) in enumerate(exact):
        places.setdefault(k, {}).setdefault(v, i)
    found = [
        F.try_element_at(F.create_map(*[F.lit(x) for pair in at.items() for x in pair]), F.try_element_at(tags, F.lit(k)))
        for k, at in places.items()
    ]
    hint, named, placed = has_any(ORGANISATION_TAGS), has_any(NAME_TAGS), has_any(ADDRESS_TAGS)

    def judged(hit: Column) -> Column:
        out = F.when(negative, F.lit(None)).when(
            hit.isNotNull(), answer(hit["c"], hit["f"], F.concat(F.lit("osm_"), hit["c"], F.lit("_"), hit["v"]), hit["p"])
        )
        for c, k, _, f, p in wild:
            out = out.when(F.array_contains(F.map_keys(tags), k), answer(c, f, f"osm_{c}_{k}", p))
        return (
            out.when(hint & named, answer("other", "business", "osm_other_business", 0.72))
            .when(hint, answer("other", "business", "osm_org_hint", 0.66))
            .when(placed & named, answer("other", "business", "osm_addressed_business", 0.62))
        )

    return let(F.get(rules, F.array_min(F.array(*found))), judged)


def profile_scores(answers: DataFrame) -> DataFrame:
    """Profile axes per user from questionnaire answers (user, question, answer), clamped to 0..100.

    Every answer meets the points table by an equi join; the table is a fixed rule list.
    """
    from ..rules import PROFILE_AXES, PROFILE_POINTS

    items = F.array(
        *[
            F.struct(F.lit(q).alias("question"), F.lit(a).alias("answer"), F.lit(x).alias("axis"), F.lit(float(n)).alias("points"))
            for q, a, x, n in PROFILE_POINTS
        ]
    )
    points = answers.sparkSession.range(1).select(F.explode(items).alias("p")).select("p.*")
    scored = answers.join(F.broadcast(points), ["question", "answer"], "left")

    def axis(name: str) -> Column:
        total = F.sum(F.when(F.col("axis") == name, F.col("points")).otherwise(F.lit(0.0)))
        return clip(total, 0.0, 100.0).alias(name)

    per = scored.groupBy("user").agg(
        *[axis(a) for a in PROFILE_AXES],
        F.max((F.col("question") == "foreign_contacts") & (F.col("answer") != "NO")).alias("has_foreign_contacts"),
        F.max((F.col("question") == "home_phone") & (F.col("answer") == "YES")).alias("has_home_phone"),
    )
    warn = (
        F.when(F.col("false_alarm") > 70, 0.45)
        .when((F.col("spam_tolerance") > 70) | (F.col("vulnerability") > 70), 0.25)
        .otherwise(0.35)
    )
    block = (
        F.when((F.col("false_alarm") > 70) | (F.col("business") > 70), 0.85)
        .when((F.col("spam_tolerance") > 70) | (F.col("vulnerability") > 70), 0.55)
        .otherwise(0.70)
    )
    return per.withColumns({"warn_threshold": warn, "block_threshold": block})
