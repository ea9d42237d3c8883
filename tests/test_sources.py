"""Readers and writers over small files."""

import pytest
from pyspark.sql import functions as F

from ringsift import schema as S
from ringsift.operators import quality as Q
from ringsift.sources import feeds, sinks


def test_contract_sizes():
    assert len(S.COMPACT_FEATURES) == 52 and len(set(S.COMPACT_FEATURES)) == 52
    assert len(S.METADATA_COLUMNS) == 30 and len(S.DEVICE_FEATURES) == len(S.DEVICE_WEIGHTS) == 17
    assert len(S.LANDLINE_CODES) == 93 and len(S.RU_TO_FIELD) == len(S.FIELD_TO_RU)
    assert set(S.COLD_MASK) < set(S.COMPACT_FEATURES)


def test_russian_headers_and_missing_files(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text("номер,источник,отзывов,extra\n89161234567,a,3,z\n", encoding="utf-8")
    rows = feeds.read_feed(spark, str(path), ["normalized_number", "source", "review_count", "url"]).collect()
    assert [tuple(r) for r in rows] == [("89161234567", "a", "3", "")]
    assert feeds.read_feed(spark, str(tmp_path / "none.csv")).count() == 0


def test_aliases_by_value_and_by_column(spark):
    df = spark.createDataFrame([("", "89161234567", "", "4", "x", "спам")], "normalized_number string, phone string, negative_count string, bad string, confidence string, category string")
    by_column = feeds.canonical_reputation(df, "feed").collect()[0]
    by_value = feeds.canonical_reputation(df, "feed", "value").collect()[0]
    assert (by_column["negative_count"], by_value["negative_count"]) == (0, 4)
    assert by_value["source"] == "feed" and by_value["source_confidence"] == 0.5 and by_value["categories"] == "спам"
    with pytest.raises(ValueError):
        feeds.canonical_reputation(df, "feed", "other")


def test_plan_in_the_old_code_page(spark, tmp_path):
    path = tmp_path / "plan.csv"
    lines = ["АВС/ DEF;От;До;Емкость;Оператор;Регион", "916;0;99;100;ПАО «МТС»;г. Москва", "495;x;1;2;a;b", "800;1;2", "800;5;9;5;Ёлка;Россия"]
    path.write_bytes("\n".join(lines).encode("cp1251"))
    rows = [tuple(r) for r in feeds.read_plan(spark, str(path)).orderBy("def_code").collect()]
    assert rows == [(800, 5, 9, "Ёлка", "Россия", 5, "tollfree"), (916, 0, 99, "ПАО «МТС»", "г. Москва", 100, "mobile")]


def test_blocklist_lines(spark):
    lines = ["# note", "", "8 916 123-45-67", "+79161234567", "prefix:+7800", "regex:88.*", "regex:[", "prefix:+7800", "short"]
    df = spark.createDataFrame(list(enumerate(lines)), "ord int, value string")
    got = sorted((r["kind"], r["key"], r["pattern"]) for r in feeds.parse_blocklist(df, "ord").collect())
    assert got == [("exact", "+79161234567", None), ("prefix", "+7800", r"^\+7800"), ("regex", "88.*", "88.*")]


def test_corpus_header_is_strict(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("packageName,label,category\ncom.a,A,BANK\ncom.b,B\ncom.c,C,NEWS,x\n")
    bad.write_text("package,label,category\ncom.a,A,BANK\n")
    assert [r[0] for r in feeds.read_corpus(spark, str(good)).collect()] == ["com.a"]
    with pytest.raises(ValueError):
        feeds.read_corpus(spark, str(bad))


def test_posts_by_people_only(spark, tmp_path):
    path = tmp_path / "wall.json"
    path.write_text('{"response": {"count": 3, "items": [{"id": 1, "from_id": 5, "owner_id": -7, "date": 1, "text": "a"}, {"id": 2, "from_id": -7, "text": "b"}, {"id": 3, "from_id": 6, "text": " "}]}}')
    posts = feeds.user_posts(feeds.read_posts(spark, str(path)))
    assert [r["id"] for r in posts.collect()] == [1]


def test_bundle_starts_with_curated_prefixes(spark, tmp_path):
    df = spark.createDataFrame([("+79161234567", "BLOCK"), ("+79161234567", "BLOCK"), ("+74951234567", "ALLOW"), ("8800", "BLOCK")], "number string, label string")
    lines = [r["line"] for r in sinks.spam_bundle(df).collect()]
    assert lines[: len(S.CURATED_PREFIXES)] == sorted(f"prefix:{p}" for p in S.CURATED_PREFIXES)
    assert lines[len(S.CURATED_PREFIXES):] == ["+79161234567"]


def test_export_of_another_version_is_refused(spark):
    df = spark.createDataFrame([("calls", 2, 1, "{}")], "table_name string, schema_version int, user bigint, row string")
    with pytest.raises(ValueError):
        sinks.import_personal(df, {"calls": "id bigint"})


def test_order_contract(spark):
    assert Q.first_order_mismatch(["a", "b"], ["a", "b"]) is None
    assert Q.first_order_mismatch(["a", "b"], ["a"]) == (1, "b", None)
    assert Q.header_issues(["a", "x"], ["a", "b"]) == ["missing:b", "unexpected:x"]


def test_list_flags_come_from_the_source_not_from_the_label(spark):
    from ringsift.plans.dataset import build_entries

    allow = spark.createDataFrame([("+79161234567", "legitimate_osm", 0.7)], "normalized_number string, source string, source_confidence double")
    cols = ["negative_count", "positive_count", "neutral_count", "review_count", "search_volume", "view_count", "related_count"]
    rep = spark.createDataFrame([("+74951234567",)], "normalized_number string").select(
        "normalized_number", F.lit("forum").alias("source"), *[F.lit(9).cast("bigint").alias(c) for c in cols], F.lit("мошенничество").alias("categories"),
        *[F.lit("").alias(c) for c in ("last_review_at", "first_seen_at", "detail_date")], F.lit(0.9).alias("source_confidence"), F.lit(0.5).alias("source_reliability"))
    got = {r["normalized_number"]: (r["label"], r["in_allow"], r["in_black"]) for r in build_entries(allow, rep).collect()}
    assert got == {"+79161234567": ("ALLOW", False, False), "+74951234567": ("BLOCK", False, False)}
