"""The batch build: feeds to labelled, enriched and balanced entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.once import settle
from ..operators import aggregate, decide, lookup, sample
from ..operators.sizing import write_once
from .features import RiskTables, enrich_numbering, metadata_record

COUNTS = ["negative_count", "positive_count", "neutral_count", "review_count", "search_volume", "view_count",
          "related_count"]
TEXTS = ["categories", "last_review_at", "first_seen_at", "detail_date"]


def _is_cold() -> Column:
    names = ("review_count", "search_volume", "view_count", "categories", "in_allow", "in_black")
    return aggregate.no_metadata({c: F.col(c) for c in names})


def build_entries(allow: DataFrame, reputation: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """One labelled entry per number of either list.

    ``allow`` (source, source_confidence) and ``reputation`` (aggregated) are unique on
    normalized_number. List membership comes from the source, never from the label.
    """
    both = lookup.full_outer_by_number(allow, reputation)
    rep, wl = F.col("reputation"), F.col("allow")
    moshel = F.coalesce(rep["source"], F.lit("")).contains("moshelovka")
    labelled = settle(both, {"_l": decide.weak_label(wl, rep, moshel)})
    source = F.col("_l.source")
    entries = labelled.select(
        "normalized_number",
        F.col("_l.label").alias("label"),
        F.col("_l.weight").alias("weight"),
        source.alias("source"),
        *[F.coalesce(rep[c], F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
        *[F.coalesce(rep[c], F.lit("")).alias(c) for c in TEXTS],
        F.coalesce(
            F.when(wl.isNotNull(), F.coalesce(wl["source_confidence"], F.lit(0.7))),
            rep["source_confidence"],
            F.lit(0.5),
        ).alias("source_confidence"),
        F.coalesce(rep["source_reliability"], F.lit(0.5)).alias("source_reliability"),
        T.is_list_source(source).alias("in_allow"),
        (T.is_public_blacklist_source(source, rep["source"]) | moshel).alias("in_black"),
        F.lit(False).alias("is_contact"),
    )
    entries = settle(entries, {"cold": _is_cold()})
    return entries if plan is None else enrich_numbering(entries, plan)


def balance(entries: DataFrame, enrich: float = 0.30, thin: float = 0.25, shadow: float = 0.10, seed: int = 42) -> DataFrame:
    """The three balancing steps in order. ``cold`` is found anew after the first one.

    The entries are written once; each step then counts and marks rows of that table instead of
    running the joins behind it again.
    """
    key = "normalized_number"
    out = sample.enrich_cold_allow(write_once(entries, "entries"), key, enrich, seed)
    out = sample.thin_cold_allow(settle(out, {"cold": _is_cold()}), key, thin, seed)
    return sample.add_cold_shadows(out, key, shadow, seed)


def labelled_rows(entries: DataFrame) -> DataFrame:
    """Input of the statistics: number, label, operator."""
    return entries.select(F.col("normalized_number").alias("number"), "label", "operator")


def build_records(entries: DataFrame, tables: RiskTables | None = None) -> DataFrame:
    return metadata_record(entries, tables or RiskTables.build(labelled_rows(entries)))
