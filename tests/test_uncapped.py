"""Whole inputs count: nothing is cut or left out unless a limit is asked for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ringsift.functions import html as H
from ringsift.functions import text as T
from ringsift.operators import sample


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_large_counts(spark):
    text = "6000 отзывов, 12000000 просмотров, 99999999999999999999 отзывов"
    assert _one(spark, T.review_count(F.col("t")), t=text) == 6000
    assert _one(spark, T.view_count(F.col("t")), t=text) == 12_000_000
    assert _one(spark, T.review_count(F.col("t"), T.REVIEWS_BELIEVED), t=text) == 0
    assert _one(spark, T.view_count(F.col("t"), T.VIEWS_BELIEVED), t=text) == 0


def test_title_is_whole_and_plain(spark):
    page = "<title>\n <b>a</b> &amp;\t" + "x" * 300 + "</title>"
    assert _one(spark, H.title(F.col("h")), h=page) == "a & " + "x" * 300
    assert _one(spark, H.title(F.col("h"), 200), h=page) == ("a & " + "x" * 300)[:200]


def test_guard_and_site_map_are_found_anywhere(spark):
    guard, late = " " * 6000 + "Проверка браузера", " " * 100 + "<x>" + "y" * 600 + "<urlset>"
    assert _one(spark, H.is_antibot(F.col("h")), h=guard)
    assert not _one(spark, H.is_antibot(F.col("h"), H.ANTIBOT_HEAD, H.ANTIBOT_SIZE), h=guard)
    assert _one(spark, H.looks_like_sitemap(F.lit("http://a/x"), F.col("h")), h=late)
    assert not _one(spark, H.looks_like_sitemap(F.lit("http://a/x"), F.col("h"), H.SITEMAP_HEAD), h=late)


def test_links_are_all_kept_and_resolved(spark):
    page = "".join(f'<a href="/p{i}">x</a>' for i in range(30))
    assert _one(spark, H.links(F.col("h"), F.lit("http://a.ru/")), h=page) == [f"http://a.ru/p{i}" for i in range(30)]
    cases = {
        "../x": "http://a.ru/x", "./y": "http://a.ru/b/y", "../../../z": "http://a.ru/z", "/q/../r?s=../t": "http://a.ru/r?s=../t",
        "u&#47;v?a=1&amp;b=2": "http://a.ru/b/u/v?a=1&b=2", "..": "http://a.ru/", "w": "http://a.ru/b/w",
    }
    page = "".join(f'<a href="{h}">x</a>' for h in cases)
    assert _one(spark, H.links(F.col("h"), F.lit("http://a.ru/b/c")), h=page) == list(cases.values())
    assert _one(spark, H.links(F.col("h"), F.lit("http://a.ru/b/c")), h="no link") == []


def test_plan_numbers_fill_the_quota(spark):
    plan = spark.createDataFrame(
        [(916, 0, 299, "o", "r", 300, "mobile")],
        "def_code bigint, start_number bigint, end_number bigint, operator string, region string, capacity bigint, number_type string")
    known = spark.createDataFrame([(f"+7916{i:07d}",) for i in range(200)], ["normalized_number"])
    none = known.limit(0)
    out = sample.sample_plan_numbers(plan, 90, 1, known, none)
    rows = {r["normalized_number"] for r in out.collect()}
    assert len(rows) == 90 and all(int(n[5:]) >= 200 for n in rows)
    with pytest.raises(ValueError):
        sample.sample_plan_numbers(plan, 101, 1, known, none)
