"""Joins: numbering plan, prefix tables, lists, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phone
from ..functions.numeric import clamp01
from ..functions.once import settle
from .sizing import lookup_join, write_once

SUBSCRIBERS = 10_000_000


# --- numbering plan ---------------------------------------------------------


def disjoint_ranges(plan: DataFrame) -> DataFrame:
    """Ranges of a plan with overlaps resolved.

    A look-up finds the range with the greatest start at or below the number and then tests its
    end. That equals a test against ``[start, min(end, next start - 1)]``. Of equal starts the
    one with the greatest ``(end, operator)`` stays.
    """
    unique = plan.groupBy("def_code", "start_number").agg(
        F.max(F.struct("end_number", "operator", "region", "capacity", "number_type")).alias("r")
    )
    by_code = Window.partitionBy("def_code").orderBy("start_number")
    following = F.lead("start_number").over(by_code)
    return unique.select(
        "def_code",
        "start_number",
        F.least(F.col("r.end_number"), F.coalesce(following - 1, F.lit(SUBSCRIBERS - 1))).alias("last_number"),
        "r.*",
    )


def range_cells(plan: DataFrame, cell: int = 10_000) -> DataFrame:
    """Disjoint ranges cut into cells, so that a look-up is an equi join on (code, cell).

    Subscriber numbers end at 10^7, so a code has at most 10^7 / cell cells plus one row per
    range border.
    """
    ranges = disjoint_ranges(plan).filter(
        (F.col("start_number") <= F.col("last_number")) & (F.col("start_number") < SUBSCRIBERS)
    )
    first = F.floor(F.col("start_number") / cell)
    last = F.floor(F.least(F.col("last_number"), F.lit(SUBSCRIBERS - 1)) / cell)
    return ranges.withColumn("cell", F.explode(F.sequence(first, last)))


def numbering_lookup(
    numbers: DataFrame, plan: DataFrame, number: str = "normalized_number", cell: int = 10_000
) -> DataFrame:
    """Add plan columns (null without a match). One output row per input row."""
    national = phone.national_part(number)
    usable = F.length(national) >= 7
    asked = numbers.withColumn("_code", F.when(usable, phone.def_code(number).cast("bigint"))).withColumn(
        "_sub", F.when(usable, F.substring(national, 4, 7).try_cast("bigint"))
    )
    asked = asked.withColumn("_cell", F.floor(F.col("_sub") / cell))
    cells = range_cells(plan, cell).alias("p")
    hit = (
        (F.col("_code") == F.col("p.def_code"))
        & (F.col("_cell") == F.col("p.cell"))
        & F.col("_sub").between(F.col("p.start_number"), F.col("p.last_number"))
    )
    keep = [c for c in numbers.columns]
    return asked.alias("n").join(cells, hit, "left").select(
        *[F.col(f"n.{c}") for c in keep],
        F.col("p.def_code").isNotNull().alias("numbering_match"),
        F.col("p.operator").alias("plan_operator"),
        F.col("p.region").alias("plan_region"),
        F.col("p.number_type").alias("plan_number_type"),
    )


def registry_lookup(
    numbers: DataFrame, registry: DataFrame, number: str = "normalized_number", cell: int = 10_000
) -> DataFrame:
    """Mobile registry look-up on one key, code * 10^7 + subscriber, codes 900-999 only."""
    mobile = registry.filter(F.col("def_code").between(900, 999))
    full = phone.national_part(number).rlike("^9[0-9]{9}$")
    found = numbering_lookup(numbers.withColumn("_n", F.when(full, F.col(number))), mobile, "_n", cell)
    code_key = phone.national_part("_n").try_cast("bigint")
    return found.withColumn("registry_key", code_key).drop("_n", "plan_number_type")


# --- prefix tables ----------------------------------------------------------


def prefix_lookup(
    df: DataFrame,
    table: DataFrame,
    values: list[str],
    number: str = "normalized_number",
    length: int = 6,
    backoff: tuple[int, ...] = (5, 4),
    tag: str = "",
) -> DataFrame:
    """Look up the first ``length`` characters, then shorter ones; null when nothing fits.

    ``table`` is unique on ``prefix``. Every level is an equi join.
    """
    out = df
    hits = []
    for level in (length, *backoff):
        part = table.filter(F.length("prefix") == level).select(
            F.col("prefix").alias(f"_p{level}"),
            F.struct(*values).alias(f"_h{level}"),
        )
        out = out.withColumn(f"_p{level}", F.substring(F.col(number), 1, level))
        out = lookup_join(out, part, [f"_p{level}"])
        hits.append(F.col(f"_h{level}"))
    best = F.coalesce(*hits)
    out = out.withColumn("_best", best)
    for value in values:
        out = out.withColumn(f"{tag}{value}", F.col(f"_best.{value}"))
    return out.drop("_best", *[f"_{k}{n}" for n in (length, *backoff) for k in ("p", "h")])


def prefix_risk_lookup(
    df: DataFrame,
    table: DataFrame | None,
    fallback: float | Column = 0.1,
    number: str = "normalized_number",
    allowed: Column | None = None,
    out: str = "prefixRisk",
) -> DataFrame:
    """Risk by prefix with back-off, a fixed value for one foreign code, else the fallback.

    Without a table the fixed legacy values are used. Allow-listed numbers have no risk.
    """
    n = F.col(number)
    free = (n.isNull() | (n == "")) | (allowed if allowed is not None else F.lit(False))
    if table is None:
        return df.withColumn(out, F.when(free, F.lit(0.0)).otherwise(phone.legacy_prefix_risk(n)))
    found = prefix_lookup(df, table, ["risk"], number, tag="_")
    other = F.when(n.startswith("+84"), F.lit(0.8)).otherwise(
        fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    )
    value = F.when(free, F.lit(0.0)).otherwise(F.coalesce(F.col("_risk"), other))
    return found.withColumn(out, value).drop("_risk")


def prefix_share_lookup(
    df: DataFrame, table: DataFrame, length: int, out: str, number: str = "normalized_number",
    allowed: Column | None = None,
) -> DataFrame:
    """Block share at one length, no back-off, 0 when missing or allow-listed."""
    found = prefix_lookup(df, table, ["block_share"], number, length, (), tag="_")
    share = clamp01(F.coalesce(F.col("_block_share"), F.lit(0.0)))
    value = share if allowed is None else F.when(allowed, F.lit(0.0)).otherwise(share)
    return found.withColumn(out, value).drop("_block_share")


def histogram_lookup(
    df: DataFrame, table: DataFrame, seen_log_norm: Column, number: str = "normalized_number",
    saturation: float = 30.0, miss: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Block share, warn share, entropy and two views of the sample size at six characters.

    ``miss`` holds the overall rates to use when the prefix is unknown; zeros by default.
    """
    found = prefix_lookup(df, table, ["block_share", "warn_share", "entropy", "seen_count"], number, tag="_")
    block, warn = miss if miss is not None else (F.lit(0.0), F.lit(0.0))
    norm = F.when(seen_log_norm > 0, seen_log_norm).otherwise(F.log1p(F.lit(50.0)))
    seen = F.col("_seen_count").cast("double")
    zero = F.lit(0.0)
    return found.withColumns({
        "prefixBlockShare": clamp01(F.coalesce(F.col("_block_share"), block)),
        "prefixWarnShare": clamp01(F.coalesce(F.col("_warn_share"), warn)),
        "prefixEntropy": clamp01(F.coalesce(F.col("_entropy"), zero)),
        "prefixSeenLog": F.coalesce(clamp01(F.log1p(seen) / norm), zero),
        "prefixSampleSize": F.coalesce(clamp01(seen / saturation), zero),
    }).drop("_block_share", "_warn_share", "_entropy", "_seen_count")


def code_risk_lookup(
    df: DataFrame, table: DataFrame, fallback: float | Column, number: str = "normalized_number",
    allowed: Column | None = None, out: str = "defCodeRisk",
) -> DataFrame:
    """Risk by three-digit code (at most 1000 rows), else the fallback."""
    part = table.select(F.col("def_code").alias("_code"), F.col("risk").alias("_risk"))
    found = df.withColumn("_code", phone.def_code_text(number)).join(part, "_code", "left")
    other = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    value = F.coalesce(clamp01(F.col("_risk")), other)
    free = F.col(number).isNull() | (allowed if allowed is not None else F.lit(False))
    return found.withColumn(out, F.when(free, F.lit(0.0)).otherwise(value)).drop("_code", "_risk")


def operator_code_risk_lookup(
    df: DataFrame, table: DataFrame, fallback: float | Column, bucket: str = "operator_bucket",
    number: str = "normalized_number", allowed: Column | None = None, out: str = "defCodeOperatorRisk",
) -> DataFrame:
    """Risk by operator bucket and code (at most 6 x 1000 rows), else the fallback."""
    part = table.select(
        F.col("bucket").alias("_bucket"), F.col("def_code").alias("_code"), F.col("risk").alias("_risk")
    )
    found = (
        df.withColumn("_code", phone.def_code_text(number))
        .withColumn("_bucket", F.when(F.col(bucket) != "unknown", F.col(bucket)))
        .join(part, ["_bucket", "_code"], "left")
    )
    other = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    free = F.col(number).isNull() | (allowed if allowed is not None else F.lit(False))
    value = F.coalesce(clamp01(F.col("_risk")), other)
    return found.withColumn(out, F.when(free, F.lit(0.0)).otherwise(value)).drop("_code", "_bucket", "_risk")


def resolve_bucket(
    df: DataFrame, table: DataFrame, given: Column, operator: Column, number: str = "normalized_number",
    out: str = "operator_bucket",
) -> DataFrame:
    """Given bucket, else the bucket of the operator name, else that of the code, else unknown."""
    from .. import schema as S

    part = table.select(F.col("def_code").alias("_code"), F.col("bucket").alias("_code_bucket"))
    found = df.withColumn("_code", phone.def_code_text(number)).join(part, "_code", "left")

    def known(c: Column) -> Column:
        return F.when(c.isin(S.OPERATOR_BUCKETS), c)

    named = F.when(F.coalesce(operator, F.lit("")) != "", phone.operator_bucket(operator))
    value = F.coalesce(
        known(F.lower(F.trim(given))), known(named), known(F.lower(F.col("_code_bucket"))), F.lit("unknown")
    )
    return found.withColumn(out, value).drop("_code", "_code_bucket")


def levels_lookup(
    df: DataFrame, levels: DataFrame, nine: DataFrame, fallback: Column, seen_log_norm: Column, given: Column, operator: Column,
    number: str = "normalized_number", allowed: Column | None = None, prefix_table: bool = True, saturation: float = 30.0,
    bucket: str = "operator_bucket",
) -> DataFrame:
    """What the seven look-ups above find, from one row of ``stats.prefix_levels`` and the shares at nine characters.

    Adds the operator bucket, the risks by prefix, code, and operator and code, and the shares at five, six and nine characters.
    """
    from .. import schema as S

    n = F.col(number)
    code = phone.def_code_text(number)
    key = F.when(n.rlike(r"^\+7[0-9]{4}"), F.substring(n, 1, 6)).otherwise(code)
    free = allowed if allowed is not None else F.lit(False)
    asked = settle(df, {"_key": key, "_nine": F.substring(n, 1, 9), "_begins": n.startswith(F.concat(F.lit("+7"), code))})
    row = levels.select(F.col("key").alias("_key"), F.struct("six", "five", "code", "bucket", "operators").alias("_l"))
    found = lookup_join(asked, row, ["_key"])
    far = nine.filter(F.length("prefix") == 9).select(F.col("prefix").alias("_nine"), F.col("block_share").alias("_nine_share"))
    found = lookup_join(found, far, ["_nine"])

    def known(c: Column) -> Column:
        return F.when(c.isin(S.OPERATOR_BUCKETS), c)

    named = F.when(F.coalesce(operator, F.lit("")) != "", phone.operator_bucket(operator))
    found = settle(found, {bucket: F.coalesce(known(F.lower(F.trim(given))), known(named), known(F.col("_l.bucket")), F.lit("unknown"))})
    zero = F.lit(0.0)
    six = F.col("_l.six")
    seen = six["seen_count"].cast("double")
    norm = F.when(seen_log_norm > 0, seen_log_norm).otherwise(F.log1p(F.lit(50.0)))
    risk = F.coalesce(six["block_share"], F.when(n.startswith("+84"), F.lit(0.8)).otherwise(fallback)) if prefix_table else phone.legacy_prefix_risk(n)
    hidden = n.isNull() | free
    return found.withColumns({
        "prefixRisk": F.when(hidden | (n == ""), zero).otherwise(risk),
        "defCodeRisk": F.when(hidden, zero).otherwise(F.coalesce(clamp01(F.col("_l.code")), fallback)),
        "defCodeOperatorRisk": F.when(hidden, zero).otherwise(F.coalesce(clamp01(F.try_element_at(F.col("_l.operators"), F.col(bucket))), fallback)),
        "prefixBlockShare": clamp01(F.coalesce(six["block_share"], zero)),
        "prefixWarnShare": clamp01(F.coalesce(six["warn_share"], zero)),
        "prefixEntropy": clamp01(F.coalesce(six["entropy"], zero)),
        "prefixSeenLog": F.coalesce(clamp01(F.log1p(seen) / norm), zero),
        "prefixSampleSize": F.coalesce(clamp01(seen / saturation), zero),
        "prefixBlockShare3": F.when(free, zero).otherwise(clamp01(F.coalesce(F.when(F.col("_begins"), F.col("_l.five")), zero))),
        "prefixBlockShare7": F.when(free, zero).otherwise(clamp01(F.coalesce("_nine_share", zero))),
    }).drop("_key", "_nine", "_begins", "_l", "_nine_share")


# --- lists ------------------------------------------------------------------


def full_outer_by_number(allow: DataFrame, reputation: DataFrame, number: str = "normalized_number") -> DataFrame:
    """Allow list and aggregated reputation side by side; both unique on the number."""
    a = allow.select(number, F.struct(*[c for c in allow.columns if c != number]).alias("allow"))
    r = reputation.select(
        number, F.struct(*[c for c in reputation.columns if c != number]).alias("reputation")
    )
    return a.join(r, number, "full_outer")


def drop_known(candidates: DataFrame, known: DataFrame, on: str, exempt: Column | None = None) -> DataFrame:
    """Left anti join; exempt rows stay whatever the list says."""
    keys = known.select(on).distinct()
    if exempt is None:
        return candidates.join(keys, on, "left_anti")
    marked = keys.withColumn("_known", F.lit(True))
    found = candidates.join(marked, on, "left")
    return found.filter(F.col("_known").isNull() | exempt).drop("_known")


def append_unseen(master: DataFrame, fresh: DataFrame, on: str) -> DataFrame:
    """Master rows plus the fresh rows whose key is new."""
    return master.unionByName(drop_known(fresh, master, on))


#: A mask that begins with plain digits, which every number that it meets begins with; alternatives
#: and optional last digits are left to the masks without a prefix.
_ANCHORED = r"^\^((?:\\[+])?[0-9]+)(?=$|[^0-9?*{+|])"
_WHOLE_PREFIX = r"^\^(?:\\[+])?[0-9]+(?:[.][*])?$"


def mask_groups(masks: DataFrame) -> DataFrame:
    """One row per prefix that masks begin with (empty for the others): whether the prefix alone is a
    mask, and the alternation of the rest, null if there is none."""
    found = masks.select("pattern").distinct().filter("pattern is not null")
    begins = F.when(~F.col("pattern").contains("|"), F.replace(F.regexp_extract("pattern", _ANCHORED, 1), F.lit("\\"), F.lit("")))
    plain = F.col("pattern").rlike(_WHOLE_PREFIX)
    rest = F.sort_array(F.collect_set(F.when(~plain, F.concat(F.lit("(?:"), "pattern", F.lit(")")))))
    return found.groupBy(F.coalesce(begins, F.lit("")).alias("_prefix")).agg(
        F.max(plain).alias("_whole"), F.when(F.size(rest) > 0, F.array_join(rest, "|")).alias("_rest")
    )


def blocked_numbers(numbers: DataFrame, exact: DataFrame, masks: DataFrame, number: str = "normalized_number") -> DataFrame:
    """Add ``blocked_by``: exact, mask or null. Exact hits are settled before masks are tried.

    A number meets the masks of its own prefixes by an equi join, at the few lengths that masks have;
    masks without a prefix are one expression that is tried in place.
    """
    groups = write_once(mask_groups(masks), "masks")
    keys = exact.select(F.col(number)).distinct().withColumn("_exact", F.lit(True))
    found = numbers.join(keys, number, "left")
    open_ = F.col("_exact").isNull()
    rest = found.filter(open_ & F.col(number).isNotNull()).select(number).distinct()
    # As many lengths as a number has characters at most.
    lengths = groups.filter("_prefix <> ''").agg(F.collect_set(F.length("_prefix"))).scalar()
    asked = rest.withColumn("_lengths", lengths).withColumn("_length", F.explode("_lengths")).filter(F.col("_length") <= F.length(number))
    asked = asked.select(number, F.substr(F.col(number), F.lit(1), F.col("_length")).alias("_prefix"))
    met = lookup_join(asked, groups.filter("_prefix <> ''"), ["_prefix"], "inner").filter(F.col("_whole") | F.expr(f"coalesce(`{number}` rlike _rest, false)"))
    out = found.join(met.select(number).distinct().withColumn("_mask", F.lit(True)), number, "left")
    loose = groups.filter("_prefix = ''").select("_rest").scalar()
    masked = F.coalesce(F.col("_mask"), F.lit(False)) | F.coalesce(F.rlike(F.col(number), loose), F.lit(False))
    return out.withColumn("blocked_by", F.when(~open_, "exact").when(masked, "mask")).drop("_exact", "_mask")


def feature_lookup(candidates: DataFrame, features: DataFrame, names: list[str],
                   number: str = "normalized_number") -> DataFrame:
    """Left join of ready features; a row with any gap counts as cold."""
    complete = features.dropna(subset=names).dropDuplicates([number])
    part = complete.select(number, F.struct(*names).alias("features"))
    found = candidates.join(part, number, "left")
    return found.withColumn(
        "feature_source", F.when(F.col("features").isNotNull(), "dataset").otherwise("cold")
    )


# --- events -----------------------------------------------------------------


def link_latest(events: DataFrame, snapshots: DataFrame, key: str, ts: str = "ts",
                tolerance_ms: int = 600_000) -> DataFrame:
    """Link an event to the latest snapshot of its number when the two are close in time.

    The latest snapshot overall is picked first, the tolerance is tested afterwards.
    """
    latest = snapshots.groupBy(key).agg(
        F.max(F.struct(F.col(ts).alias("snapshot_ts"), F.col("id").alias("snapshot_id"))).alias("_s")
    )
    found = lookup_join(events, write_once(latest, "latest-snapshots"), [key])
    near = F.abs(F.col("_s.snapshot_ts") - F.col(ts)) <= tolerance_ms
    return found.withColumn("snapshot_id", F.when(near, F.col("_s.snapshot_id"))).drop("_s")


def two_key_lookup(df: DataFrame, table: DataFrame, first: str, second: str, ref: str, value: str) -> DataFrame:
    """Value found by the first key of the table, else by the second. Both are unique when set."""
    one = table.filter(F.col(first).isNotNull()).groupBy(F.col(first).alias(ref)).agg(
        F.min_by(value, second).alias("_one")
    )
    two = table.select(F.col(second).alias(ref), F.col(value).alias("_two"))
    found = df.join(one, ref, "left").join(two, ref, "left")
    return found.withColumn(value, F.coalesce("_one", "_two")).drop("_one", "_two")


# Days a cached answer stays good, by its source.
CACHE_DAYS = {"2gis": 30, "negative": 2}
CACHE_DAYS_OTHER = 7


def cache_is_fresh(source: Column, looked_up: Column, now_ms: Column) -> Column:
    """A cached answer still holds at ``now_ms``."""
    days = F.lit(CACHE_DAYS_OTHER)
    for name, limit in CACHE_DAYS.items():
        days = F.when(source == name, F.lit(limit)).otherwise(days)
    return F.coalesce((now_ms - looked_up) <= days.cast("bigint") * 86_400_000, F.lit(False))


def caller_info(numbers: DataFrame, registry: DataFrame, geocoder: DataFrame, cache: DataFrame,
                now_ms: Column) -> DataFrame:
    """Operator and region: fresh cache row, else registry, else geocoder by code."""
    found = registry_lookup(numbers, registry)
    geo = geocoder.select(F.col("def_code").alias("_code"), F.col("region").alias("_geo_region"))
    found = found.withColumn("_code", phone.def_code("normalized_number").cast("bigint"))
    found = lookup_join(found, geo, ["_code"])
    rows = cache.select(
        "normalized_number", F.struct("operator", "region", "source", "ts").alias("_c")
    )
    found = found.join(rows, "normalized_number", "left")
    fresh = cache_is_fresh(F.col("_c.source"), F.col("_c.ts"), now_ms)
    operator = F.when(F.col("plan_operator").isNotNull(), phone.registry_operator("plan_operator"))
    region = F.coalesce(
        F.when(F.col("plan_region").isNotNull(), phone.registry_region("plan_region")), F.col("_geo_region")
    )
    return found.select(
        "normalized_number",
        F.when(fresh, F.col("_c.operator")).otherwise(operator).alias("operator"),
        F.when(fresh, F.col("_c.region")).otherwise(region).alias("region"),
        F.when(fresh, F.lit("cache")).when(operator.isNotNull(), "registry").when(region.isNotNull(), "geocoder")
        .otherwise("miss").alias("found_by"),
    )
