"""Writers: labelled, metadata and compact tables, risk tables, bundles, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .feeds import to_russian

LABELLED = ["normalized_number", "label", "label_id", "weight", "source", "source_confidence"]
VERDICT_COLUMNS = [
    "normalized_number", "expected_label", "verdict", "model_verdict", "risk_score", "probs_ALLOW", "probs_WARN",
    "probs_BLOCK", "feature_source", "rule_overrides", "disagreement", "error",
]


def write_three_tables(records: DataFrame, folder: str, russian: bool = True) -> None:
    """Labelled, metadata and compact tables. The records are written once and read back, so the
    job behind them runs once."""
    meta = f"{folder}/metadata"
    names = S.METADATA_COLUMNS + S.COMPACT_FEATURES
    records.select(*names).write.mode("overwrite").parquet(meta)
    stored = records.sparkSession.read.parquet(meta)
    turn = to_russian if russian else (lambda df: df)
    turn(stored.select(*LABELLED)).write.mode("overwrite").csv(f"{folder}/labelled", header=True)
    stored.select(*S.COMPACT_FEATURES, "label_id").write.mode("overwrite").csv(f"{folder}/compact", header=True)


def nested_json(table: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One JSON object per key; a risk table as JSON lines instead of one document."""
    return table.select(F.col(key), F.to_json(F.struct(*values)).alias("entry")).orderBy(key)


def write_risk_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def spam_bundle(labels: DataFrame, number: str = "number") -> DataFrame:
    """Bundle lines in file order: curated prefixes, then sorted distinct BLOCK numbers."""
    numbers = (
        labels.filter((F.col("label") == "BLOCK") & F.col(number).startswith("+"))
        .select(F.lit(1).alias("section"), F.col(number).alias("line")).distinct()
    )
    prefixes = labels.sparkSession.range(1).select(
        F.lit(0).alias("section"),
        F.explode(F.array(*[F.lit(f"prefix:{p}") for p in S.CURATED_PREFIXES])).alias("line"),
    )
    return prefixes.unionByName(numbers).orderBy("section", "line")


def write_lines(lines: DataFrame, folder: str) -> None:
    lines.select("line").write.mode("overwrite").text(folder)


def verdict_table(scored: DataFrame) -> DataFrame:
    """Twelve columns, probabilities as text with six places."""
    def prob(c: str) -> Column:
        return F.format_string("%.6f", F.col(c)).alias(c)

    return scored.select(
        *[prob(c) if c.startswith("probs_") else F.col(c) for c in VERDICT_COLUMNS]
    )


def feedback_table(selected: DataFrame, action: str, override: str | None = None) -> DataFrame:
    """Feedback rows: number, verdict, action and the cold features the model saw."""
    verdict = F.lit(override.upper()) if override else F.upper(F.trim(F.coalesce(
        F.nullif("verdict", F.lit("")), F.col("model_verdict"))))
    return selected.select(
        "normalized_number", verdict.alias("verdict"), F.lit(action).alias("user_action"), *S.COMPACT_FEATURES
    )


def selected_verdicts(rows: DataFrame, target: str = "ANY") -> DataFrame:
    """Rows without an error whose verdict (or model verdict) is the target."""
    v = F.upper(F.trim(F.coalesce(F.nullif("verdict", F.lit("")), F.nullif("model_verdict", F.lit("")), F.lit(""))))
    clean = rows.withColumn("chosen_verdict", v).filter(
        (F.trim(F.coalesce("error", F.lit(""))) == "") & (F.col("chosen_verdict") != "")
    )
    return clean if target.upper() == "ANY" else clean.filter(F.col("chosen_verdict") == target.upper())


def build_report(counts: DataFrame, counters: DataFrame, seed: int) -> DataFrame:
    """One JSON report of a corpus build; categories in canonical order (twenty entries)."""
    per = counts.agg(
        F.to_json(F.map_from_entries(F.transform(
            F.array_sort(F.collect_list(F.struct("position", "category", "packages"))),
            lambda x: F.struct(x["category"], x["packages"]),
        ))).alias("j")
    ).scalar()
    return counters.select(
        F.to_json(F.struct(*counters.columns, F.lit(seed).alias("seed"))).alias("counters"), per.alias("categories")
    )


EXPORT_VERSION = 1


def export_personal(tables: dict[str, DataFrame]) -> DataFrame:
    """Personal data of four tables as JSON lines: table name, schema version, user, row.

    One line per row, so a user with any number of events is never gathered into one document.
    """
    out = None
    for name, df in tables.items():
        part = df.select(
            F.lit(name).alias("table_name"), F.lit(EXPORT_VERSION).alias("schema_version"), F.col("user"),
            F.to_json(F.struct(*df.columns)).alias("row"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def import_personal(lines: DataFrame, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of an export; another schema version is refused as a whole."""
    other = lines.filter(F.col("schema_version") != EXPORT_VERSION).limit(1).count()
    if other:
        raise ValueError("export has another schema version")
    return {
        name: lines.filter(F.col("table_name") == name).select(F.from_json("row", ddl).alias("r")).select("r.*")
        for name, ddl in schemas.items()
    }


def replace_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def official_directory(numbers: DataFrame, official: DataFrame) -> DataFrame:
    """Name and category of numbers on the official list (a shipped file of some dozens of rows)."""
    from ..operators.sizing import lookup_join

    table = official.groupBy("normalized_number").agg(
        F.max(F.struct("name", "category")).alias("_o")
    )
    found = lookup_join(numbers, table, ["normalized_number"])
    return found.select(
        *numbers.columns, F.col("_o.name").alias("official_name"), F.col("_o.category").alias("official_category"),
        F.col("_o").isNotNull().alias("official"),
    )
