"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import contamination, exactdup, mainpage, mixing, neardup, quality, repeats, scoring, secrets, sharding, spelling, warc, whitening
from .common import table


def op1_hash_tree(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(table(spark, folder, "documents"))


def op2_perplexity_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(table(spark, folder, "documents"))


def op3_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.score(table(spark, folder, "documents"))


def op4_path_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return mainpage.main_text(table(spark, folder, "pages"))


def op5_suffix_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op7_prefix_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.cleaned(table(spark, folder, "documents")).drop("kept")


def op8_setsketch_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(table(spark, folder, "documents"), size=4)


def op9_pfair_mixture(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "epoch", "block", "slot", "position", "release", "deadline")


def op10_elias_fano_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score(table(spark, folder, "documents"))


def op11_golomb_exchange(spark: SparkSession, folder: str) -> DataFrame:
    return exactdup.groups(table(spark, folder, "documents"))


def op12_pivotal_grams(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hash_tree, op2_perplexity_rules, op3_secret_forest, op4_path_ratios, op5_suffix_decontamination, op6_warc_archive,
        op7_prefix_intervals, op8_setsketch_groups, op9_pfair_mixture, op10_elias_fano_scores,
        op11_golomb_exchange, op12_pivotal_grams, op13_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op9_pfair_mixture": mixing.MIX_SQL.format(docs="documents")
    + f"""SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot,
        CAST(slot * {mixing.BLOCK_ROWS} + within AS BIGINT) AS position, CAST((block * q) // a AS BIGINT) AS release,
        CAST(((block + 1) * q + a - 1) // a AS BIGINT) AS deadline FROM z WHERE slot < stop""",
    "op11_golomb_exchange": exactdup.GROUPS_SQL,
}
