"""Splits, samples and balancing by exact quotas.

Rows are ordered by md5(seed:key). The k-th smallest hash of a stratum is found from a histogram
over hash prefixes and the rows of a single prefix; every row is then picked or not by comparing
its own hash with that cut. Nothing is sorted or shuffled as a whole, whatever the class sizes.
The key must be unique.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numeric import round_count
from ..functions.once import settle
from .sizing import lookup_join, write_once

Quota = Callable[[Column], Column]


def row_hash(key: str | Column, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def uniform(key: str | Column, seed: int) -> Column:
    """A number in [0, 1) fixed by seed and key."""
    return F.conv(F.substring(row_hash(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_cuts(
    df: DataFrame, key: str, seed: int, quotas: dict[str, Quota], strata: list[str], prefix_chars: int = 4
) -> DataFrame:
    """Per stratum the hash of its k-th row for every quota; null when the quota is 0.

    A quota maps the stratum size to k; larger values mean all rows.
    """
    h = row_hash(key, seed)
    rows = df.select(*strata, h.alias("_h"), F.substring(h, 1, prefix_chars).alias("_b"))
    hist = rows.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # At most 16^prefix_chars rows per stratum.
    upto = Window.partitionBy(*strata).orderBy("_b")
    whole = Window.partitionBy(*strata)
    hist = write_once(hist, "hash-histogram").withColumn("_cum", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(whole))
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.least(quota(F.col("_all")).cast("bigint"), F.col("_all")).alias("k"),
            )
            for name, quota in quotas.items()
        ]
    )
    crossing = (
        hist.withColumn("_q", F.explode(wanted))
        .filter((F.col("_q.k") > F.col("_cum") - F.col("_n")) & (F.col("_q.k") <= F.col("_cum")))
        .select(*strata, "_b", F.col("_q.name").alias("_name"), (F.col("_q.k") - F.col("_cum") + F.col("_n")).alias("_r"))
    )
    # One row per stratum and quota.
    inside = Window.partitionBy(*strata, "_b", "_name").orderBy("_h")
    border = rows.join(crossing, [*strata, "_b"]).withColumn("_rn", F.row_number().over(inside))
    found = border.filter(F.col("_rn") == F.col("_r"))
    return found.groupBy(*strata).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_h"))).alias(name) for name in quotas]
    )


def pick(
    df: DataFrame, key: str, seed: int, quotas: dict[str, Quota], strata: list[str] | None = None,
    eligible: Column | None = None,
) -> DataFrame:
    """Add one boolean column per quota: the row is among the first k of its stratum.

    The cuts have one row per stratum; they are written once, so that Spark knows their bytes.
    """
    pool = df if eligible is None else df.filter(eligible)
    own = strata or []
    if not own:
        pool, own = pool.withColumn("_one", F.lit(1)), ["_one"]
    cuts = write_once(hash_cuts(pool, key, seed, {f"_cut_{n}": q for n, q in quotas.items()}, own), "cuts")
    target = df if strata else df.withColumn("_one", F.lit(1))
    out = lookup_join(target, cuts, own)
    allowed = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    h = row_hash(key, seed)
    flags = {n: allowed & F.coalesce(h <= F.col(f"_cut_{n}"), F.lit(False)) for n in quotas}
    return settle(out, flags).drop("_one", *[f"_cut_{n}" for n in quotas])


def hash_rank(df: DataFrame, key: str, seed: int, out: str = "position", prefix_chars: int = 4) -> DataFrame:
    """Exact 1-based position of every row in hash order, found cell by cell."""
    h = row_hash(key, seed)
    rows = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, prefix_chars))
    per = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # At most 16^prefix_chars rows.
    offsets = per.select("_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_b").orderBy("_h")
    return rows.join(offsets, "_b").withColumn(out, F.col("_off") + F.row_number().over(inside)).drop("_h", "_b", "_off")


def share(fraction: float) -> Quota:
    return lambda n: round_count(n * F.lit(float(fraction)))


def fixed(k: int) -> Quota:
    return lambda n: F.lit(k).cast("bigint") + n * 0


def stratified_split(
    df: DataFrame, label: str, key: str, sizes: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42
) -> DataFrame:
    """Add ``split``: train, val, test with per-class counts round(n f); the rest is test."""
    train = share(sizes[0])
    val = share(sizes[1])
    out = pick(df, key, seed, {"_train": train, "_val": lambda n: train(n) + val(n)}, [label])
    return out.withColumn(
        "split", F.when(F.col("_train"), "train").when(F.col("_val"), "val").otherwise("test")
    ).drop("_train", "_val")


def two_stage_split(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """80 % train, then the held-out rest in two halves, both stages stratified."""
    held = lambda n: n - F.ceil(n * F.lit(0.2)).cast("bigint")
    out = pick(df, key, seed, {"_train": held}, [label])
    out = pick(out, key, seed + 1, {"_val": share(0.5)}, [label], eligible=~F.col("_train"))
    return out.withColumn(
        "split", F.when(F.col("_train"), "train").when(F.col("_val"), "val").otherwise("test")
    ).drop("_train", "_val")


def proportional_holdout(df: DataFrame, label: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """Add ``held_out``: about ``size`` rows, each class in proportion; the rest is for training."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return pick(df, key, seed, {"held_out": lambda n: round_count(n * F.lit(float(size)) / total)}, [label])


def _spam_quota(label: str, df: DataFrame, spam: int) -> tuple[Column, Column]:
    counts = df.agg(
        F.struct(
            F.count_if(F.col(label) == "WARN").alias("w"), F.count_if(F.col(label) == "BLOCK").alias("b")
        )
    ).scalar()
    w, b = counts["w"], counts["b"]
    short = (w + b) < spam
    warn = F.least(round_count(F.lit(float(spam)) * w / F.greatest(w + b, F.lit(1))), w)
    block = F.least(F.lit(spam) - warn, b)
    return F.when(short, w).otherwise(warn), F.when(short, b).otherwise(block)


def teacher_sample(df: DataFrame, label: str, key: str, legit: int, spam: int, seed: int = 42,
                   out: str = "in_teacher") -> DataFrame:
    """Mark ``legit`` ALLOW rows and ``spam`` others, the WARN to BLOCK ratio kept.

    A class that is too small is taken whole.
    """
    warn, block = _spam_quota(label, df, spam)
    by_class = {"_a": fixed(legit), "_w": lambda n: warn + n * 0, "_b": lambda n: block + n * 0}
    picked = pick(df, key, seed, by_class, [label])
    value = (
        F.when(F.col(label) == "ALLOW", F.col("_a"))
        .when(F.col(label) == "WARN", F.col("_w"))
        .otherwise(F.col("_b"))
    )
    return picked.withColumn(out, value).drop("_a", "_w", "_b")


def student_subset(teacher: DataFrame, label: str, key: str, legit: int, spam: int, seed: int = 42) -> DataFrame:
    """A smaller sample drawn from the teacher rows only."""
    return teacher_sample(teacher.filter("in_teacher"), label, key, legit, spam, seed + 1, "in_student")


def sample_shortfall(df: DataFrame, label: str, legit: int, spam: int) -> DataFrame:
    """One row per class group with fewer rows than wanted."""
    per = df.agg(
        F.count_if(F.col(label) == "ALLOW").alias("legit"), F.count_if(F.col(label) != "ALLOW").alias("spam")
    )
    rows = F.explode(
        F.array(
            F.struct(F.lit("legit").alias("pool"), F.lit(legit).cast("bigint").alias("wanted"), F.col("legit").alias("available")),
            F.struct(F.lit("spam").alias("pool"), F.lit(spam).cast("bigint").alias("wanted"), F.col("spam").alias("available")),
        )
    )
    return per.select(rows.alias("r")).select("r.*").filter(F.col("available") < F.col("wanted"))


# --- cold-start balancing ---------------------------------------------------
# Entries carry: number, label, cold, in_allow, in_black, is_contact and the reputation columns.


def enrich_cold_allow(entries: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Give a share of the cold ALLOW rows random, plausible positive metadata."""
    marked = pick(entries, key, seed, {"_hit": share(fraction)}, None, (F.col("label") == "ALLOW") & F.col("cold"))

    def u(i: int) -> Column:
        return uniform(key, seed + 100 + i)

    drawn = F.struct(
        (F.floor(u(1) * 10) + 1).alias("reviews"), (0.70 + 0.30 * u(2)).alias("good"), (0.10 * u(3)).alias("bad")
    )
    marked = settle(marked, {"_d": drawn})
    reviews = F.col("_d.reviews")
    positive = F.greatest(F.lit(1), F.bround(reviews * F.col("_d.good")).cast("bigint"))
    raw_negative = F.bround(reviews * F.col("_d.bad")).cast("bigint")
    negative = F.when(positive + raw_negative > reviews, F.greatest(F.lit(0), reviews - positive)).otherwise(raw_negative)
    neutral = F.greatest(F.lit(0), reviews - positive - negative)
    values = {
        "review_count": reviews,
        "positive_count": positive,
        "negative_count": negative,
        "neutral_count": neutral,
        "search_volume": F.floor(u(4) * 50) + 1,
        "source_confidence": F.bround(0.70 + 0.25 * u(5), 4),
        "categories": F.when(u(6) < 0.20, F.lit("верифицированный_бизнес")).otherwise(
            F.coalesce(F.col("categories"), F.lit(""))
        ),
    }
    out = marked
    hit = F.col("_hit")
    changed = {n: F.when(hit, v).otherwise(F.col(n)) for n, v in values.items()}
    return settle(out, {**changed, "synthetic": hit}).drop("_hit", "_d")


def thin_cold_allow(entries: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Drop a share of the cold ALLOW rows that neither a list nor the contacts vouch for."""
    test = (F.col("label") == "ALLOW") & F.col("cold") & ~F.col("in_allow") & ~F.col("is_contact")
    return pick(entries, key, seed + 1, {"_hit": share(fraction)}, None, test).filter(~F.col("_hit")).drop("_hit")


BLANKED = ["negative_count", "positive_count", "neutral_count", "review_count", "search_volume", "view_count",
           "related_count"]


def add_cold_shadows(entries: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Append copies of a share of the WARN and BLOCK rows with all metadata and lists blanked."""
    test = F.col("label").isin("WARN", "BLOCK")
    marked = pick(entries, key, seed + 2, {"_hit": share(fraction)}, None, test)
    hidden = {c: F.lit(0).cast(entries.schema[c].dataType) for c in BLANKED if c in entries.columns}
    hidden |= {
        "source_confidence": F.lit(0.0),
        "source_reliability": F.lit(0.0),
        "categories": F.lit(""),
        "in_allow": F.lit(False),
        "in_black": F.lit(False),
        "cold": F.lit(True),
    }
    base = marked.withColumn("shadow", F.lit(False))
    copies = marked.filter("_hit").withColumns(
        {c: v for c, v in hidden.items() if c in entries.columns}
    ).withColumn("shadow", F.lit(True))
    return base.unionByName(copies).drop("_hit")


# --- masks and augmentation -------------------------------------------------


def masked_view(df: DataFrame, mask: list[str]) -> DataFrame:
    """Zero the masked features; noMetadata becomes 1 when a metadata feature is among them."""
    out = df.withColumns({c: F.lit(0.0) for c in mask if c in df.columns})
    if set(mask) & set(S.COLD_MASK) and "noMetadata" in df.columns:
        out = out.withColumn("noMetadata", F.lit(1.0))
    return out


def cold_view(df: DataFrame) -> DataFrame:
    """The features as they look for a number nobody has seen."""
    return masked_view(df, S.COLD_MASK)


def add_masked_copies(
    df: DataFrame, label: str, key: str, mask: list[str], fraction: float, seed: int = 42, weight: float = 1.0
) -> DataFrame:
    """Append masked copies of a share of every class; ``extra_weight`` tells them apart."""
    base = df.withColumn("extra_weight", F.lit(1.0)).withColumn("masked", F.lit(False))
    if not mask or fraction <= 0:
        return base
    if fraction >= 1.0:
        chosen = df
    else:
        chosen = pick(df, key, seed, {"_hit": share(fraction)}, [label]).filter("_hit").drop("_hit")
    copies = masked_view(chosen, mask).withColumn("extra_weight", F.lit(float(weight))).withColumn("masked", F.lit(True))
    return base.unionByName(copies)


def add_balanced_masked_copies(
    df: DataFrame, label: str, key: str, mask: list[str], targets: list[str], weight: float = 1.5,
    cap: float = 1.0, seed: int = 42,
) -> DataFrame:
    """Append one masked copy of every target row, rarer classes up to ``cap`` times their size.

    Repeats go round the class in hash order, so a class of n rows and m copies holds every row
    floor(m / n) or one more times.
    """
    base = df.withColumn("extra_weight", F.lit(1.0)).withColumn("masked", F.lit(False))
    pool = df.filter(F.col(label).isin(targets))
    sizes = pool.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.agg(F.max("_n")).scalar()
    goal = F.greatest(F.col("_n"), F.least(top, F.floor(F.col("_n") * float(max(cap, 1.0)))))
    sizes = sizes.withColumn("_full", F.floor(goal / F.col("_n")).cast("int")).withColumn("_rest", goal % F.col("_n"))
    # One row per target class, and the classes are named by the caller.
    sized = pool.join(F.broadcast(sizes), label)
    rest = {t: sizes.filter(F.col(label) == t).select("_rest").scalar() for t in targets}
    marked = sized
    flags = []
    for i, t in enumerate(targets):
        marked = pick(marked, key, seed, {f"_r{i}": lambda n, t=t: F.coalesce(rest[t], F.lit(0)) + n * 0}, None,
                      F.col(label) == t)
        flags.append(F.col(f"_r{i}"))
    once_more = flags[0]
    for f in flags[1:]:
        once_more = once_more | f
    times = F.col("_full") + once_more.cast("int")
    copies = marked.withColumn("_i", F.explode(F.sequence(F.lit(1), times))).select(*df.columns)
    copies = masked_view(copies, mask).withColumn("extra_weight", F.lit(float(weight))).withColumn("masked", F.lit(True))
    return base.unionByName(copies)


def oversample_rare(
    df: DataFrame, label: str, key: str, features: list[str], min_count: int, seed: int = 42, sigma: float = 0.01
) -> DataFrame:
    """Append max(1, min_count // n) noisy copies of every row of a class with n < min_count rows."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    times = F.when(F.col("_n") < min_count, F.greatest(F.lit(1), F.floor(F.lit(min_count) / F.col("_n")).cast("int")))
    sizes = write_once(sizes.select(label, times.alias("_times")).dropna(), "class-sizes")
    rows = lookup_join(df, sizes, [label], "inner")
    copies = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    for j, name in enumerate(features):
        unit = F.concat_ws(":", F.col(key), F.col("_i"), F.lit(j))
        # Box-Muller on two hash-seeded uniforms: the same on every run and partitioning.
        u1 = F.greatest(uniform(unit, seed), F.lit(1e-12))
        noise = F.sqrt(-2.0 * F.log(u1)) * F.cos(F.lit(6.283185307179586) * uniform(unit, seed + 1))
        copies = copies.withColumn(name, F.col(name) + sigma * noise)
    return df.withColumn("copy", F.lit(0)).unionByName(
        copies.withColumn("copy", F.col("_i")).select(*df.columns, "copy")
    )


def cap_total(df: DataFrame, key: str, keep: Column, limit: int, seed: int = 42) -> DataFrame:
    """All rows that must stay, the rest filled up at random to ``limit`` rows."""
    must = df.agg(F.count_if(keep)).scalar()
    room = F.greatest(F.lit(limit) - must, F.lit(0))
    out = pick(df, key, seed, {"_hit": lambda n: room + n * 0}, None, ~keep)
    return out.filter(keep | F.col("_hit")).drop("_hit")


def cap_per_source(df: DataFrame, source: str, key: str, limit: int, seed: int = 42) -> DataFrame:
    """At most ``limit`` rows of every source, chosen by hash."""
    return pick(df, key, seed, {"_hit": fixed(limit)}, [source]).filter("_hit").drop("_hit")


# --- numbers from plan ranges -----------------------------------------------


def sample_plan_numbers(
    plan: DataFrame, count: int, seed: int, seen: DataFrame, suspects: DataFrame, cell: int = 10_000
) -> DataFrame:
    """Numbers drawn from mobile ranges in proportion to capacity, known and suspect ones left out.

    As many picks are tried as give the wanted number of good ones with near certainty; the first good
    ones stay, so more picks never change the earlier ones. A plan without enough free numbers is an
    error. Every pick is a position on the line of all capacities. The line is cut into cells, so the
    pick finds its range by an equi join.
    """
    from .lookup import disjoint_ranges
    from .timeline import running

    spark = plan.sparkSession
    ranges = disjoint_ranges(plan).filter(
        F.col("def_code").between(900, 999) & (F.col("last_number") >= F.col("start_number"))
    ).withColumn("size", F.col("last_number") - F.col("start_number") + 1)
    ranges = ranges.withColumn("_line", F.col("def_code").cast("bigint") * 10_000_000 + F.col("start_number"))
    placed = running(
        ranges.withColumn("_all", F.lit(1)), ["_all"], "_line", {"before": ("sum", F.col("size"))}, F.col("def_code")
    )
    total = ranges.agg(F.sum("size")).scalar()
    first, last = F.floor(F.col("before") / cell), F.floor((F.col("before") + F.col("size") - 1) / cell)
    cells = placed.withColumn("_cell", F.explode(F.sequence(first, last)))
    subscriber = F.lpad((F.col("start_number") + F.col("position") - F.col("before")).cast("string"), 7, "0")

    taken = seen.select("normalized_number").union(suspects.select("normalized_number")).distinct()
    size, known = ranges.agg(F.sum("size")).first()[0] or 0, taken.count()
    asked = spark.range(picks(size, size - known, count)).select(
        F.col("id"), F.floor(uniform("id", seed) * total).cast("bigint").alias("position")
    )
    hits = asked.withColumn("_cell", F.floor(F.col("position") / cell)).join(cells, "_cell").filter(
        (F.col("position") >= F.col("before")) & (F.col("position") < F.col("before") + F.col("size"))
    )
    numbers = hits.select(
        F.concat(F.lit("+7"), F.col("def_code").cast("string"), subscriber).alias("normalized_number"),
        "id",
        F.when(F.coalesce("operator", F.lit("")) == "", F.col("region"))
        .otherwise(F.concat_ws(", ", "operator", "region")).alias("name"),
        F.col("region").alias("city"),
    )
    unique = numbers.groupBy("normalized_number").agg(
        F.min("id").alias("id"), F.min_by("name", "id").alias("name"), F.min_by("city", "id").alias("city")
    )
    good = unique.join(taken, "normalized_number", "left_anti").withColumn("_all", F.lit(1))
    ranked = running(good, ["_all"], "id", {"_before": ("sum", F.lit(1))}, F.floor(F.col("id") / 4096))
    first = write_once(ranked.filter(F.coalesce("_before", F.lit(0)) < count).select(
        "normalized_number",
        "name",
        F.lit("personal_mobile").alias("category"),
        F.lit("numbering_plan_background").alias("source"),
        "city",
        F.lit(0.25).alias("source_confidence"),
    ), "drawn")
    if first.count() < count:
        raise ValueError(f"the plan holds fewer than {count} free numbers")
    return first


def picks(size: int, free: int, wanted: int) -> int:
    """How many picks out of ``size`` numbers hit ``wanted`` of ``free`` different ones, with near certainty."""
    every = math.ceil(size * (math.log(max(size, 2)) + 20))
    if free <= wanted:
        return every
    # All free numbers are hit alike; six standard deviations more than are wanted on average.
    goal = wanted + 6 * math.sqrt(wanted) + 6
    return every if goal >= free else min(every, math.ceil(-size * math.log1p(-goal / free)) + 1)
