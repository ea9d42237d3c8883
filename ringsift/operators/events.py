"""Call, usage and notification events: look-back features, implicit labels, links.

Calls carry id, user, number, direction, state, duration_ms, ts (epoch ms). All look-backs are
strict: an event does not see itself or what happens at the same millisecond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phone
from ..functions.numeric import dot, night_flag, sigmoid, weekend_flag
from . import decide
from .sizing import lookup_join, write_once
from .timeline import DAY_MS, HOUR_MS, latest_before, lookback_sums

MINUTE_MS = 60_000


def call_frequency(calls: DataFrame, days: int = 7, norm: float = 10.0) -> DataFrame:
    """Earlier calls of the number in the look-back over ten, capped at one."""
    out = lookback_sums(calls, "id", calls, ["number"], "ts", {"number_calls": (F.lit(1), days * DAY_MS)})
    return out.withColumn("call_frequency", F.least(F.col("number_calls") / norm, F.lit(1.0)))


def prefix_calls(calls: DataFrame, days: int = 7, length: int = 5, norm: float = 10.0) -> DataFrame:
    """Earlier calls from the same prefix, raw and normalised."""
    keyed = calls.withColumn("prefix", F.when(F.col("number").startswith("+7"), F.substring("number", 1, length)))
    out = lookback_sums(keyed, "id", keyed, ["prefix"], "ts", {"prefix_calls": (F.lit(1), days * DAY_MS)})
    return out.withColumn("prefix_calls_norm", F.least(F.col("prefix_calls") / norm, F.lit(1.0)))


def previously(records: DataFrame, test: Column, days: int = 30, name: str = "previously_rejected") -> DataFrame:
    """Did an earlier record of the number in the look-back pass the test?"""
    out = lookback_sums(
        records, "id", records, ["number"], "ts", {"_hits": (F.when(test, 1).otherwise(0), days * DAY_MS)}
    )
    return out.withColumn(name, F.col("_hits") > 0).drop("_hits")


def _at(test: Column) -> Column:
    return F.when(test, F.col("ts"))


def missed_without_callback(calls: DataFrame, hours: int = 24) -> DataFrame:
    """The latest earlier missed call is recent and nobody called back since."""
    missed = _at(F.col("state") == "MISSED")
    out_ = _at(F.col("direction") == "OUTGOING")
    found = latest_before(calls, "id", calls, ["number"], "ts", {"last_missed": missed, "last_outgoing": out_})
    recent = F.col("last_missed") >= F.col("ts") - hours * HOUR_MS
    silent = F.col("last_outgoing").isNull() | (F.col("last_outgoing") <= F.col("last_missed"))
    return found.withColumn("missed_no_callback", F.coalesce(recent & silent, F.lit(False)))


def outgoing_after_missed(calls: DataFrame, days: int = 7) -> DataFrame:
    """An earlier outgoing call in the look-back that itself came after a missed or rejected one."""
    gone = F.col("state").isin("MISSED", "REJECTED")
    seen = latest_before(calls, "id", calls, ["number"], "ts", {"_gone": _at(gone)})
    follow = seen.withColumn("_follow", (F.col("direction") == "OUTGOING") & F.col("_gone").isNotNull())
    found = latest_before(calls, "id", follow, ["number"], "ts", {"_last": _at(F.col("_follow"))})
    return found.withColumn(
        "outgoing_after_missed", F.coalesce(F.col("_last") >= F.col("ts") - days * DAY_MS, F.lit(False))
    ).drop("_last")


def answer_rate(calls: DataFrame, days: int = 30) -> DataFrame:
    """Share of the number's earlier calls in the look-back that were answered."""
    w = days * DAY_MS
    out = lookback_sums(
        calls,
        "id",
        calls,
        ["number"],
        "ts",
        {"_all": (F.lit(1), w), "_ok": (F.when(F.col("state") == "ANSWERED", 1).otherwise(0), w)},
    )
    rate = F.when(F.col("_all") > 0, F.col("_ok") / F.col("_all")).otherwise(F.lit(0.0))
    return out.withColumn("answer_rate", rate).drop("_all", "_ok")


USAGE_GROUPS = {
    "recent_bank_app": ["BANK", "INVESTMENTS"],
    "recent_gov_app": ["GOVERNMENT"],
    "recent_marketplace_app": ["MARKETPLACE", "DELIVERY"],
    "recent_messenger_app": ["MESSENGER"],
}


def _latest_apps(calls: DataFrame, usage: DataFrame, attach: bool) -> DataFrame:
    values = {f"_{n}": _at(F.col("category").isin(cats)) for n, cats in USAGE_GROUPS.items()}
    return latest_before(calls, "id", usage, ["user"], "ts", values, width=HOUR_MS, attach=attach)


def recent_apps(calls: DataFrame, usage: DataFrame, minutes: int = 30) -> DataFrame:
    """Four flags: an app of the group was in the foreground shortly before the call."""
    found = _latest_apps(calls, usage, True)
    for name in USAGE_GROUPS:
        hit = F.col(f"_{name}") >= F.col("ts") - minutes * MINUTE_MS
        found = found.withColumn(name, F.coalesce(hit, F.lit(False))).drop(f"_{name}")
    return found


def recent_notifications(calls: DataFrame, notifications: DataFrame, buckets: tuple[str, ...] = ("BANK", "MARKETPLACE"),
                         minutes: int = 10, attach: bool = True) -> DataFrame:
    """Notifications per bucket in [t - window, t)."""
    sums = {
        f"notif_{b.lower()}": (F.when(F.col("bucket") == b, 1).otherwise(0), minutes * MINUTE_MS) for b in buckets
    }
    return lookback_sums(calls, "id", notifications, ["user"], "ts", sums, attach=attach)


# --- labels -----------------------------------------------------------------


def missed_before(calls: DataFrame, days: int = 30) -> DataFrame:
    """Flag: the number has an incoming missed or rejected call at or after t - window.

    Only the lower bound counts; the order of the two calls does not.
    """
    gone = (F.col("direction") == "INCOMING") & F.col("state").isin("MISSED", "REJECTED")
    last = calls.filter(gone & F.col("number").isNotNull()).groupBy("number").agg(F.max("ts").alias("_last"))
    found = lookup_join(calls, write_once(last, "last-missed"), ["number"])
    return found.withColumn(
        "missed_before", F.coalesce(F.col("_last") >= F.col("ts") - days * DAY_MS, F.lit(False))
    ).drop("_last")


def implicit_labels(calls: DataFrame) -> DataFrame:
    """Immediate labels, and missed calls whose label is deferred."""
    seen = missed_before(calls)
    label = decide.implicit_label(F.col("direction"), F.col("state"), F.col("duration_ms"), F.col("missed_before"))
    return seen.withColumn("_l", label).filter(F.col("_l").isNotNull()).select(
        "id", "user", "number", "ts", F.col("_l.label").alias("label"), F.col("_l.deferred").alias("deferred")
    )


def callbacks(calls: DataFrame, hours: int = 24) -> DataFrame:
    """Missed calls with the time of the next outgoing call to the number, and whether it came in time."""
    missed = calls.filter((F.col("direction") == "INCOMING") & (F.col("state") == "MISSED") & F.col("number").isNotNull())
    outgoing = calls.filter(F.col("direction") == "OUTGOING")
    found = latest_before(
        missed, "id", outgoing, ["number"], "ts", {"next_outgoing": F.col("ts")}, inclusive=True, following=True
    )
    return found.withColumn(
        "called_back", F.coalesce(F.col("next_outgoing") <= F.col("ts") + hours * HOUR_MS, F.lit(False))
    )


def deferred_labels(calls: DataFrame, hours: int = 24) -> DataFrame:
    """BLOCK for every missed call nobody returned in time."""
    return callbacks(calls, hours).filter(~F.col("called_back")).select(
        "id", "user", "number", "ts", F.lit("BLOCK").alias("label"), (F.col("ts") + hours * HOUR_MS).alias("due")
    )


def guarded_labels(labels: DataFrame, records: DataFrame, linked: DataFrame, minutes: int = 10) -> DataFrame:
    """Labels without those of calls we blocked ourselves.

    A call counts as blocked by us when a snapshot is linked to it and its number has a BLOCK
    record at or after t - window.
    """
    blocked = records.filter(F.col("verdict") == "BLOCK").groupBy("number").agg(F.max("ts").alias("_block"))
    blocked = write_once(blocked, "last-block")
    ids = linked.filter(F.col("snapshot_id").isNotNull()).select("id", F.lit(True).alias("_linked"))
    found = lookup_join(labels, blocked, ["number"]).join(ids, "id", "left")
    ours = F.coalesce(F.col("_linked") & (F.col("_block") >= F.col("ts") - minutes * MINUTE_MS), F.lit(False))
    return found.filter(~ours).drop("_block", "_linked")


def own_block_labels(decisions: DataFrame) -> DataFrame:
    """A BLOCK label for every call we blocked with a snapshot at hand."""
    return decisions.filter((F.col("verdict") == "BLOCK") & F.col("snapshot_id").isNotNull()).select(
        F.col("snapshot_id").alias("ref"), "number", "ts", F.lit("BLOCK").alias("label")
    )


def warm_up(labels: DataFrame, installs: DataFrame, days: int = 14, min_labels: int = 30) -> DataFrame:
    """Was a user's warm-up over when the label arrived? Counts labels up to and including it."""
    from .timeline import running

    counted = running(
        labels, ["user"], "ts", {"labels_so_far": ("sum", F.lit(1))}, F.floor(F.col("ts") / DAY_MS), inclusive=True
    )
    found = counted.join(installs.select("user", "installed_at"), "user", "left")
    done = (F.col("ts") - F.col("installed_at") >= days * DAY_MS) | (F.col("labels_so_far") >= min_labels)
    return found.withColumn("warm", F.coalesce(done, F.lit(False)))


# --- features ---------------------------------------------------------------


def device_features(calls: DataFrame, usage: DataFrame, notifications: DataFrame, contacts: DataFrame,
                    enabled: dict[str, bool] | None = None, user_country: str = "ru") -> DataFrame:
    """The seventeen device features of every call. A source that is off leaves zeros.

    ``enabled`` has keys call_log, contacts, usage, notifications, carrier; all on by default.
    """
    from .. import schema as S

    on = {"call_log": True, "contacts": True, "usage": True, "notifications": True, "carrier": True} | (enabled or {})
    w30, w7 = 30 * DAY_MS, 7 * DAY_MS
    zero = F.lit(0.0)
    # Every look-back asks for the bare calls; the answers are put together by id at the end.
    asks = calls.select("id", "user", "number", "ts")
    answers: list[DataFrame] = []
    values = {n: zero for n in S.DEVICE_FEATURES}
    if on["call_log"]:
        sums = {
            "_n30": (F.lit(1), w30),
            "_ok30": (F.when(F.col("state") == "ANSWERED", 1).otherwise(0), w30),
            "_rej30": (F.when(F.col("state") == "REJECTED", 1).otherwise(0), w30),
        }
        answers.append(lookback_sums(asks, "id", calls, ["number"], "ts", sums, attach=False))
        gone = F.col("state").isin("MISSED", "REJECTED")
        seen = latest_before(calls, "id", calls, ["number"], "ts", {"_gone": _at(gone)})
        marks = seen.withColumn("_follow", (F.col("direction") == "OUTGOING") & F.col("_gone").isNotNull())
        last = {
            "_missed": _at(F.col("state") == "MISSED"),
            "_outgoing": _at(F.col("direction") == "OUTGOING"),
            "_followed": _at(F.col("_follow")),
        }
        answers.append(latest_before(asks, "id", marks, ["number"], "ts", last, attach=False))
        prefix = F.when(F.col("number").startswith("+"), F.substring("number", 1, 5))
        keyed = asks.withColumn("_p", prefix)
        answers.append(lookback_sums(keyed, "id", keyed, ["_p"], "ts", {"_pref7": (F.lit(1), w7)}, attach=False))
        silent = F.col("_outgoing").isNull() | (F.col("_outgoing") <= F.col("_missed"))
        recent = (F.col("_missed") >= F.col("ts") - DAY_MS) & silent
        values |= {
            "previously_rejected": F.coalesce(F.col("_rej30") > 0, F.lit(False)).cast("double"),
            "prev_missed_no_callback_24h": F.coalesce(recent, F.lit(False)).cast("double"),
            "prev_outgoing_after_missed": F.coalesce(F.col("_followed") >= F.col("ts") - w7, F.lit(False)).cast("double"),
            "same_prefix_call_count_7d_norm": F.least(F.coalesce("_pref7", zero), F.lit(10.0)) / 10.0,
            "answer_rate_for_number_norm": F.when(F.col("_n30") > 0, F.col("_ok30") / F.col("_n30")).otherwise(zero),
        }
    if on["usage"]:
        answers.append(_latest_apps(asks, usage, False))
        for name in USAGE_GROUPS:
            hit = F.col(f"_{name}") >= F.col("ts") - 30 * MINUTE_MS
            values[f"{name}_30m"] = F.coalesce(hit, F.lit(False)).cast("double")
    if on["notifications"]:
        answers.append(recent_notifications(asks, notifications, attach=False))
        for b in ("bank", "marketplace"):
            values[f"notif_{b}_recent_10m"] = F.coalesce(F.col(f"notif_{b}") > 0, F.lit(False)).cast("double")
    out = asks
    for found in answers:
        out = out.join(found, "id", "left")
    if on["contacts"]:
        known = contacts.select("user", "number").distinct().withColumn("_contact", F.lit(1.0))
        out = out.join(known, ["user", "number"], "left")
        values["is_contact"] = F.coalesce("_contact", zero)
    local = F.coalesce(F.col("number").startswith("+7"), F.lit(False)) & F.lit(user_country == "ru")
    values |= {
        "is_night_time": night_flag(F.col("ts")).cast("double"),
        "is_weekend": weekend_flag(F.col("ts")).cast("double"),
        "hidden_number": F.col("number").isNull().cast("double"),
        "is_short_code": phone.is_short_code("number").cast("double"),
    }
    if on["carrier"]:
        values["same_carrier_as_user"] = local.cast("double")
    return out.select("id", "user", "number", "ts", *[values[n].alias(n) for n in S.DEVICE_FEATURES])


def device_probability(features: Column, weights: Column, bias: Column) -> Column:
    """Logistic score of an array of feature values."""
    return sigmoid(dot(features, weights) + bias)


def top_contributions(names: list[str], values: list[Column], weights: list[Column], k: int = 5) -> Column:
    """The k features with the largest |weight * value|, the earlier one on ties."""
    rows = F.array(
        *[
            F.struct(
                (-F.abs(v * w)).alias("o"), F.lit(i).alias("i"), F.lit(n).alias("name"), (v * w).alias("signed")
            )
            for i, (n, v, w) in enumerate(zip(names, values, weights))
        ]
    )
    return F.slice(F.array_sort(rows), 1, k)


# --- ordered folds ----------------------------------------------------------


def clamped_walk(steps: DataFrame, keys: list[str], order: list[str], ts: str, delta: str, start: float,
                 low: float, high: float, width: int = DAY_MS, fan: int = 16) -> DataFrame:
    """Value per key after adding all deltas in order, clamped to [low, high] after every step.

    x -> clamp(x + a, l, h) is closed under composition. Steps are numbered per key, and in every
    round ``fan`` maps that follow one another become one, until each key has a single map; so a key
    is never gathered, and the number of rounds is the logarithm of its steps.
    """
    from .timeline import running

    columns = list(dict.fromkeys([*keys, *order, ts, delta]))
    placed = running(steps.select(*columns), keys, ts, {"_before": ("sum", F.lit(1))}, F.floor(F.col(ts) / width))
    same = Window.partitionBy(*keys, ts).orderBy(*order)
    number = F.coalesce("_before", F.lit(0)) + F.row_number().over(same) - 1
    maps = write_once(placed.select(*keys, number.alias("_i"), F.col(delta).cast("double").alias("_a"), F.lit(float(low)).alias("_l"), F.lit(float(high)).alias("_h")), "steps")
    last = maps.agg(F.max("_i")).first()[0] or 0
    nothing = {"_a": 0.0, "_l": float("-inf"), "_h": float("inf")}
    while last:
        slot = F.col("_i") % fan
        wide = maps.groupBy(*keys, F.floor(F.col("_i") / fan).alias("_i")).agg(
            *[F.max(F.when(slot == j, F.col(c))).alias(f"{c}{j}") for j in range(fan) for c in nothing])
        a, lo, hi = (F.coalesce(F.col(f"{c}0"), F.lit(v)) for c, v in nothing.items())
        for j in range(1, fan):
            a_, lo_, hi_ = (F.coalesce(F.col(f"{c}{j}"), F.lit(v)) for c, v in nothing.items())
            a, lo, hi = a + a_, F.greatest(lo_, F.least(hi_, lo + a_)), F.greatest(lo_, F.least(hi_, hi + a_))
        maps = wide.select(*keys, "_i", a.alias("_a"), lo.alias("_l"), hi.alias("_h"))
        last //= fan
    return maps.select(*keys, F.greatest(F.col("_l"), F.least(F.col("_h"), F.lit(float(start)) + F.col("_a"))).alias("value"))


# What one piece of feedback does to factor weights and thresholds.
WEIGHT_STEP = {"NOT_SPAM": -0.1, "UNBLOCK": -0.1, "IS_SCAM": 0.1, "MARK_SPAM": 0.1, "ANSWER": -0.05, "DISMISS": 0.0}
WARN_STEP = {"NOT_SPAM": 0.02, "UNBLOCK": 0.02, "IS_SCAM": -0.02, "MARK_SPAM": -0.02}
BLOCK_STEP = {"UNBLOCK": 0.03, "MARK_SPAM": -0.02}
EMA_ALPHA = 0.05


def _step(action: Column, table: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, value in table.items():
        out = F.when(action == name, F.lit(value)).otherwise(out)
    return out


def learned_weights(feedback: DataFrame, factors: str = "top_factors") -> DataFrame:
    """Factor weights per user after all feedback; the three strongest factors move each time."""
    steps = feedback.select(
        "user", "id", "ts", F.explode(F.slice(factors, 1, 3)).alias("factor"),
        (F.lit(EMA_ALPHA) * _step(F.col("action"), WEIGHT_STEP)).alias("delta"),
    )
    return clamped_walk(steps, ["user", "factor"], ["ts", "id"], "ts", "delta", 1.0, 0.1, 3.0)


def learned_thresholds(feedback: DataFrame, min_feedback: int = 5) -> DataFrame:
    """Warn and block thresholds per user; they move from the fifth piece of feedback on."""
    from .timeline import running

    ordered = running(
        feedback.withColumn("_o", F.col("ts")), ["user"], "_o", {"_before": ("sum", F.lit(1))},
        F.floor(F.col("ts") / DAY_MS), inclusive=True,
    ).filter(F.col("_before") >= min_feedback)
    warn = clamped_walk(
        ordered.withColumn("delta", _step(F.col("action"), WARN_STEP)), ["user"], ["ts", "id"], "ts", "delta", 0.35, 0.15, 0.50
    )
    block = clamped_walk(
        ordered.withColumn("delta", _step(F.col("action"), BLOCK_STEP)), ["user"], ["ts", "id"], "ts", "delta", 0.70, 0.50, 0.85
    )
    # One row per user on both sides.
    return warn.withColumnRenamed("value", "warn_threshold").join(
        block.withColumnRenamed("value", "block_threshold"), "user"
    )


def feedback_effects(feedback: DataFrame) -> DataFrame:
    """List change, corrected label and weight of every piece of feedback."""
    a = F.col("action")
    bad, good = a.isin("IS_SCAM", "MARK_SPAM"), a.isin("NOT_SPAM", "UNBLOCK")
    return feedback.filter(F.col("number").isNotNull()).select(
        "id", "user", "number",
        F.when(bad, "block").when(good, "allow").alias("list_change"),
        F.when(good | (a == "ANSWER"), "allow").when(bad, "block").otherwise(F.lower(F.col("verdict"))).alias("label"),
        F.when(a == "DISMISS", 0.5).otherwise(2.0).alias("weight"),
        F.when(good & F.col("number").startswith("+7") & (F.length("number") >= 6), F.substring("number", 1, 6)).alias("prefix_mark"),
    )


def retained(events: DataFrame, now_ms: Column, ttl_ms: int, ts: str = "ts") -> DataFrame:
    """Rows that are not older than their time to live."""
    return events.filter(F.col(ts) >= now_ms - ttl_ms)


# How long event tables are kept.
RETENTION_MS = {
    "call": 90 * DAY_MS, "usage": 90 * DAY_MS, "snapshot": 90 * DAY_MS, "notification": HOUR_MS,
    "personal_allow": 90 * DAY_MS,
}


def personally_allowed(numbers: DataFrame, allowed: DataFrame, prefixes: DataFrame, now_ms: Column) -> DataFrame:
    """Flags for a user's own number list (90 days) and prefix list.

    Prefixes are matched by an equi join on every prefix length the list uses.
    """
    live = retained(allowed, now_ms, RETENTION_MS["personal_allow"]).select("user", "number").distinct()
    out = numbers.join(live.withColumn("_n", F.lit(True)), ["user", "number"], "left")
    marks = prefixes.select("user", "prefix").distinct().filter(F.length("prefix") >= 1)
    tries = (
        numbers.select("user", "number").distinct()
        .withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("number")), lambda i: F.substr(F.col("number"), F.lit(1), i))))
    )
    hits = tries.join(marks, ["user", "prefix"], "left_semi").select("user", "number").distinct()
    out = out.join(hits.withColumn("_p", F.lit(True)), ["user", "number"], "left")
    return out.withColumns({
        "number_allowed": F.coalesce("_n", F.lit(False)), "prefix_allowed": F.coalesce("_p", F.lit(False))
    }).drop("_n", "_p")
