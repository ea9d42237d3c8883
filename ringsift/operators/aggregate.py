"""Reputation aggregates, counters and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as T
from .merge import joined_parts

SUMS = ["negative_count", "positive_count", "neutral_count", "review_count"]
MAXIMA = ["search_volume", "view_count", "related_count", "source_confidence", "source_reliability"]
STRINGS = [
    "source", "categories", "last_review_at", "first_seen_at", "detail_date", "page_title", "url",
]


def _numbers() -> list[Column]:
    return [F.sum(c).alias(c) for c in SUMS] + [F.max(c).alias(c) for c in MAXIMA]


def _review_total() -> Column:
    return F.greatest(
        F.col("review_count"), F.col("negative_count") + F.col("positive_count") + F.col("neutral_count")
    )


def reputation_by_number(df: DataFrame, order: str, number: str = "normalized_number") -> DataFrame:
    """One row per number: sums, maxima, and the strings of its most informative row.

    That row has the highest confidence, then some category, then the smallest order value.
    """
    informative = F.struct(
        F.col("source_confidence").alias("a"),
        (F.coalesce(F.col("categories"), F.lit("")) != "").alias("b"),
        (-F.col(order)).alias("c"),
    )
    out = df.groupBy(number).agg(
        *_numbers(), F.max_by(F.struct(*STRINGS), informative).alias("_s")
    )
    return out.withColumn("review_count", _review_total()).select(number, *SUMS, *MAXIMA, "_s.*")


def _filled(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def reputation_union(df: DataFrame, order: str, number: str = "normalized_number") -> DataFrame:
    """Same sums and maxima; categories and sources are unions, dates the extremes, title the first.

    Addresses have no small vocabulary; ``reputation_urls`` gives them as rows.
    """
    folded = df.withColumn("review_count", F.greatest("review_count", F.lit(0)))
    out = folded.groupBy(number).agg(
        *_numbers(),
        F.coalesce(F.max("last_review_at"), F.lit("")).alias("last_review_at"),
        F.coalesce(F.min(_filled("first_seen_at")), F.lit("")).alias("first_seen_at"),
        F.coalesce(F.max(_filled("detail_date")), F.lit("")).alias("detail_date"),
        F.coalesce(
            F.min_by(_filled("page_title"), F.when(_filled("page_title").isNotNull(), F.col(order))),
            F.lit(""),
        ).alias("page_title"),
    )
    parts = joined_parts(df, number, {"categories": (";", ";"), "source": (None, "+")})
    out = out.join(parts, number, "left").na.fill("", ["categories", "source"])
    return out.withColumn("review_count", _review_total())


def reputation_urls(df: DataFrame, number: str = "normalized_number") -> DataFrame:
    """Distinct addresses of every number, one per row."""
    return df.filter(_filled("url").isNotNull()).select(number, "url").distinct()


def no_metadata(df_cols: dict[str, Column]) -> Column:
    """No reviews, searches, views, list or known category word.

    ``df_cols`` holds review_count, search_volume, view_count, categories, in_allow, in_black.
    """
    from ..functions.numeric import contains_any

    c = df_cols
    text = F.lower(F.coalesce(c["categories"], F.lit("")))
    zero = F.lit(0)
    return ~(
        (F.coalesce(c["review_count"], zero) > 0)
        | (F.coalesce(c["search_volume"], zero) > 0)
        | (F.coalesce(c["view_count"], zero) > 0)
        | F.coalesce(c["in_allow"], F.lit(False))
        | F.coalesce(c["in_black"], F.lit(False))
        | contains_any(text, S.COLD_CATEGORY_WORDS)
    )


def label_counts(df: DataFrame, cold: Column) -> DataFrame:
    """Rows and cold rows by label, and the share of ALLOW among cold rows."""
    per = df.filter(F.col("label").isin(S.LABELS)).groupBy("label").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(cold).alias("cold_rows")
    )
    share = per.agg(
        (F.sum(F.when(F.col("label") == "ALLOW", F.col("cold_rows")).otherwise(0)) / F.greatest(F.sum("cold_rows"), F.lit(1)))
    ).scalar()
    return per.withColumn("allow_given_cold", share)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))


def class_balanced_weights(df: DataFrame, label: str, classes: int = 2) -> DataFrame:
    """n / (classes * n_c) per class."""
    per = class_counts(df, label)
    total = per.agg(F.sum("rows")).scalar()
    return per.select(label, "rows", (total / (F.lit(float(classes)) * F.col("rows"))).alias("weight"))


def fixed_class_weight(label_id: Column, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """Weight of a row from its class id (allow, warn, block)."""
    return F.when(label_id == 0, weights[0]).when(label_id == 1, weights[1]).otherwise(weights[2])


def range_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("number_type").agg(
        F.count(F.lit(1)).alias("ranges"), F.sum("capacity").alias("capacity")
    )


# Marks that agree with a block or warn verdict, and with an allow verdict.
AGREE_SPAM = ["IS_SCAM", "MARK_SPAM", "DISMISS"]
AGREE_SAFE = ["NOT_SPAM", "UNBLOCK", "ANSWER"]
# Names under which a source is counted.
SOURCE_ALIASES = {
    "model": ["server_model", "cloud_model", "tflite_model"],
    "rules": ["rule_engine"],
}


def decision_stats(decisions: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """One row: totals by verdict and source, feedback count, agreement rate."""
    v, a = F.col("verdict"), F.col("user_action")
    agree = (v.isin("BLOCK", "WARN") & a.isin(AGREE_SPAM)) | ((v == "ALLOW") & a.isin(AGREE_SAFE))
    fed = F.count_if(a.isNotNull())
    cols = [F.count(F.lit(1)).alias("total")]
    cols += [F.count_if(v == name).alias(f"n_{name.lower()}") for name in S.LABELS]
    for name, values in (aliases or SOURCE_ALIASES).items():
        cols.append(F.count_if(F.col("source").isin(values)).alias(f"by_{name}"))
    cols += [
        fed.alias("with_feedback"),
        F.count_if(agree).alias("agreeing"),
        F.when(fed > 0, F.count_if(agree) / fed).alias("agreement_rate"),
    ]
    return decisions.agg(*cols)


def verdict_counts_since(records: DataFrame, since_ms: Column, ts: str = "ts") -> DataFrame:
    return records.filter(F.col(ts) >= since_ms).groupBy("verdict").agg(F.count(F.lit(1)).alias("calls"))


def verdict_calendar(records: DataFrame, ts: str = "ts") -> DataFrame:
    """Calls by verdict for every day and every Monday-based week, in UTC."""
    day = F.floor(F.col(ts) / 86_400_000)
    per_day = records.groupBy(day.alias("day"), "verdict").agg(F.count(F.lit(1)).alias("n"))
    days = per_day.select(F.lit("day").alias("period"), F.col("day").alias("slot"), "verdict", "n")
    weeks = (
        per_day.groupBy(F.floor((F.col("day") + 3) / 7).alias("slot"), "verdict")
        .agg(F.sum("n").alias("n"))
        .select(F.lit("week").alias("period"), "slot", "verdict", "n")
    )
    return days.unionByName(weeks)


def number_history(calls: DataFrame, now_ms: Column, days: int = 30) -> DataFrame:
    """Per number: whether it was rejected, and the share of its calls answered, in the last days."""
    recent = calls.filter(
        F.col("number").isNotNull() & (F.col("ts") >= now_ms - days * 86_400_000) & (F.col("ts") <= now_ms)
    )
    incoming = F.col("direction") == "INCOMING"
    return recent.groupBy("number").agg(
        (F.count_if(incoming & (F.col("state") == "REJECTED")) > 0).alias("previously_rejected"),
        F.count_if(incoming).alias("incoming"),
        F.when(
            F.count_if(incoming) > 0,
            F.count_if(incoming & (F.col("state") == "ANSWERED")) / F.count_if(incoming),
        ).otherwise(F.lit(0.0)).alias("answer_rate"),
    )


def corpus_counters(corpus: DataFrame) -> DataFrame:
    """Rows, blank keys, unknown categories and distinct packages of a raw app corpus."""
    blank = F.trim(F.coalesce(F.col("package"), F.lit(""))) == ""
    return corpus.agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(blank).alias("dropped_blank"),
        F.count_if(~blank & T.app_category_unknown(F.col("category"))).alias("unknown_category"),
        F.count_distinct(F.when(~blank, F.col("package"))).alias("packages"),
    )


def category_dimension(df: DataFrame) -> DataFrame:
    """The twenty categories with their position."""
    pairs = ", ".join(f"struct({i} as position, '{name}' as category)" for i, name in enumerate(S.APP_CATEGORIES))
    return df.sparkSession.range(1).select(F.explode(F.expr(f"array({pairs})")).alias("c")).select("c.*")


def category_counts(corpus: DataFrame) -> DataFrame:
    """Packages per category, empty categories kept, in canonical order."""
    per = corpus.groupBy(T.app_category(F.col("category")).alias("category")).agg(
        F.count_distinct("package").alias("packages")
    )
    return (
        category_dimension(corpus)
        .join(F.broadcast(per), "category", "left")
        .select("position", "category", F.coalesce("packages", F.lit(0)).alias("packages"))
        .orderBy("position")
    )


def corpus_floors(counts: DataFrame, total_floor: int = 200_000, category_floor: int = 5_000) -> DataFrame:
    """One row per floor that is not met; OTHER has none."""
    total = counts.agg(F.sum("packages").alias("found")).select(
        F.lit("*").alias("category"), "found", F.lit(total_floor).alias("floor")
    )
    each = counts.filter(F.col("category") != "OTHER").select(
        "category", F.col("packages").alias("found"), F.lit(category_floor).alias("floor")
    )
    return total.unionByName(each).filter(F.col("found") < F.col("floor"))


# Points a category of installed apps adds to a profile (digital, ads, awareness).
INSTALLED_POINTS = {
    "banking": (10, 0, 0), "gov": (5, 0, 0), "marketplace": (5, 5, 0), "ads": (0, 10, 0),
    "delivery": (0, 5, 0), "messenger": (0, 0, 0), "vpn_antivirus": (0, 0, 10), "kids": (0, 0, 0),
    "crypto": (10, 0, 5),
}


def installed_profile(installed: DataFrame, packages: DataFrame) -> DataFrame:
    """Category flags and profile points per user from installed packages."""
    hits = installed.join(packages, "package").groupBy("user").agg(
        *[
            F.max((F.col("category") == name).cast("int")).alias(f"has_{name}")
            for name in INSTALLED_POINTS
        ]
    )
    points = {}
    for i, axis in enumerate(("digital", "ads", "awareness")):
        total = F.lit(0)
        for name, values in INSTALLED_POINTS.items():
            if values[i]:
                total = total + F.col(f"has_{name}") * values[i]
        points[f"{axis}_points"] = total.cast("bigint")
    return hits.withColumns(points)


def scoring_summary(scored: DataFrame) -> DataFrame:
    """One row: rows, errors, disagreements with the expected label, verdict counts of a batch run."""
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("error") != "").alias("errors"),
        F.count_if(F.col("disagreement")).alias("disagreements"),
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in S.LABELS],
    )


def row_count_gates(tables: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """One row per table with fewer rows than it needs."""
    out = None
    for name, (df, floor) in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("rows_seen")).select(
            F.lit(name).alias("table_name"), "rows_seen", F.lit(floor).cast("bigint").alias("floor")
        )
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("rows_seen") < F.col("floor"))


def prefix_override_candidates(
    marks: DataFrame, now_ms: Column, allowed: DataFrame, dismissed: DataFrame,
    min_marks: int = 5, days: int = 30, keep: int | None = None, length: int = 6,
) -> DataFrame:
    """Prefixes a user keeps marking as not spam, allow-listed and dismissed ones left out.

    All marks count, unless a prefix remembers its newest ``keep`` marks only; then its count stops there.
    """
    recent = marks.filter(F.col("number").startswith("+7") & (F.col("ts") >= now_ms - days * 86_400_000))
    per = recent.groupBy("user", F.substring("number", 1, length).alias("prefix")).agg(
        (F.count(F.lit(1)) if keep is None else F.least(F.count(F.lit(1)), F.lit(keep))).alias("marks"), F.max("ts").alias("last_seen")
    )
    return (
        per.filter(F.col("marks") >= min_marks)
        .join(allowed.select("user", "prefix").distinct(), ["user", "prefix"], "left_anti")
        .join(dismissed.select("user", "prefix").distinct(), ["user", "prefix"], "left_anti")
        .orderBy(F.desc("marks"), "user", "prefix")
    )


def ngram_counts(df: DataFrame, text: str, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """Frequency of character n-grams over all texts."""
    grams = df.select(F.explode(T.ngrams(F.lower(F.col(text)), sizes)).alias("token"))
    return grams.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(counts: DataFrame, max_size: int) -> DataFrame:
    """The most frequent tokens with ids from 2 on; 0 and 1 stand for padding and unknown."""
    from pyspark.sql import Window

    top = counts.orderBy(F.desc("n"), "token").limit(max_size - 2)
    # At most max_size - 2 rows are numbered here.
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 1)


def encode_ngrams(df: DataFrame, key: str, text: str, vocab: DataFrame, length: int = 64) -> DataFrame:
    """Ids of the n-grams of a text: size 3 first, then 4, then 5; 1 for unknown, padded with 0.

    The vocabulary is joined without a hint; a text is put together from its own n-grams only.
    """
    grams = df.select(F.col(key), F.posexplode_outer(T.ngrams(F.lower(F.col(text)))).alias("_pos", "token"))
    kept = grams.filter(F.col("_pos").isNull() | (F.col("_pos") < length))
    ids = kept.join(vocab.select("token", "id"), "token", "left")
    per = ids.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("id", F.lit(1)).alias("id"))))
        ).alias("_g")
    )
    found = F.transform("_g", lambda g: g["id"].cast("int"))
    padded = F.slice(F.concat(found, F.array_repeat(F.lit(0), length)), 1, length)
    return per.select(key, padded.alias("ids"))


def source_viability(pages: DataFrame, category: Column) -> DataFrame:
    """Per host: phones, tel links, complaint words and size, and what the host is good for."""
    from ..functions import html as H

    measured = pages.select(
        F.lower(H.host(F.col("url"))).alias("host"),
        category.alias("category"),
        F.size(H.numbers_in_html(F.col("html"))).alias("phones"),
        F.size(F.regexp_extract_all("html", F.lit(H.TEL_LINK), F.lit(1))).alias("tel_links"),
        T.count_words(H.to_text(F.col("html")), S.EVIDENCE_FRAUD + S.EVIDENCE_WARN).alias("words"),
        F.length("html").alias("size"),
        F.col("html").rlike(r"""(?i)<div[^>]+id=["'](?:app|root|__next|__nuxt)["']""").alias("js"),
    )
    per = measured.groupBy("host", "category").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("phones").cast("bigint").alias("phones"),
        F.sum("tel_links").cast("bigint").alias("tel_links"),
        F.sum("words").cast("bigint").alias("complaint_words"),
        F.max("size").cast("bigint").alias("html_length"),
        F.max("js").alias("js_required"),
    )
    phones = (F.col("phones") >= 1) | (F.col("tel_links") >= 1)
    complaints = F.col("complaint_words") >= 2
    body = F.col("html_length") >= 1500
    people = F.col("category").isin("personal", "blacklist")

    def answer(kind: str, priority: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(priority).cast("bigint").alias("priority"))

    verdict = (
        F.when(~body & F.col("js_required"), answer("NEEDS_BROWSER", 2))
        .when(~body, answer("CLOSED", 0))
        .when((F.col("category") == "directory") & phones, answer("VIABLE", 1))
        .when(F.col("category") == "directory", answer("NO_FRAUD_SIGNAL", 3))
        .when(people & phones & complaints, answer("VIABLE", 1))
        .when(people & phones, answer("VIABLE", 2))
        .when(people & complaints, answer("NEEDS_BROWSER", 2))
        .when(people, answer("NO_FRAUD_SIGNAL", 3))
        .when((F.col("category") == "forum") & complaints, answer("VIABLE", 2))
        .when(F.col("category") == "forum", answer("NO_FRAUD_SIGNAL", 3))
        .otherwise(answer("UNKNOWN", 3))
    )
    return per.withColumn("_v", verdict).select(*per.columns, "_v.*")
