"""Literal pages."""

import pytest
from pyspark.sql import functions as F

from ringsift.plans import pages as G


def _run(spark, url, html):
    df = spark.createDataFrame([(url, html)], "url string, html string")
    return G.evidence(df, [G.source_of_text(url)]).collect()


@pytest.mark.parametrize("status, label, conf", [("scam", "BLOCK", 0.85), ("spam", "WARN", 0.74)])
def test_status_page(spark, status, label, conf):
    word = {"scam": "Мошенники", "spam": "Спам"}[status]
    html = f'<div class="number-status-label status-{status}">{word}</div>'
    rows = _run(spark, "https://callfilter.info/number/79161234567/", html)
    assert [(r["normalized_number"], r["label_hint"], r["source_confidence"]) for r in rows] == [("+79161234567", label, conf)]


def test_safe_page_gives_no_row(spark):
    assert _run(spark, "https://callfilter.info/number/79161234567/", '<div class="number-status-label status-safe">Всё хорошо</div>') == []


def test_short_path_number(spark):
    html = '<li class="list-group-item list-group-item-danger">мошенники</li>'
    rows = _run(spark, "https://badcall.ru/phones/9161234567", html)
    assert [r["normalized_number"] for r in rows] == ["+79161234567"]
    assert rows[0]["label_hint"] == "BLOCK"


def test_never_allow(spark):
    pages = spark.createDataFrame([
        ("https://znum.ru/z-79161234567", '<div class="review_text">официальный банк, доставка, поддержка</div>'),
        ("https://spravportal.ru/services/who-calls/num/79161234567", "<p>Сводка по отзывам: реклама</p>"),
        ("https://kto.zvonil.tel/+79161234567", '<title>Всего 3 отзыв</title><blockquote class="blockquote">обман</blockquote>'),
    ], "url string, html string")
    labels = {r["label_hint"] for r in G.evidence(pages, ["znum", "spravportal", "kto_zvonil_tel"]).collect()}
    assert labels and labels <= {"WARN", "BLOCK"}


def test_review_far_down_the_page_counts(spark):
    html = "<p>" + "слово " * 5000 + "</p><p>мошенники</p>"
    rows = _run(spark, "https://getscam.com/79161234567", html)
    assert [r["label_hint"] for r in rows] == ["BLOCK"]
    assert rows[0]["evidence_text"].endswith("мошенники")
    pages = spark.createDataFrame([("https://getscam.com/79161234567", html)], "url string, html string")
    assert [len(r["evidence_text"]) for r in G.evidence(pages, text_limit=500).collect()] == [500]


def test_state_harvest_finds_nested_objects(spark):
    state = '{"a": [{"deep": {"name": "Банк", "phones": [{"formatted": "8 (495) 123-45-67"}], "address": "x"}}, {"name": "no phone"}]}'
    df = spark.createDataFrame([(1, state), (2, "not json")], "key int, s string")
    rows = G.harvest_state(df, "key", "s").collect()
    assert [(r["path"], r["name"], r["normalized_number"], r["has_address"]) for r in rows] == [("a[0].deep", "Банк", "+74951234567", True)]


def test_hosts(one):
    assert one(G.source_of(F.lit("https://www.callfilter.app/79161234567"))) == "callfilter"
    assert one(G.source_of(F.lit("https://example.org/"))) == "unknown"
