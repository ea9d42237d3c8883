"""Literal cases of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from ringsift.functions import html as H
from ringsift.functions import numeric as N
from ringsift.functions import phone as P
from ringsift.functions import text as T


@pytest.mark.parametrize("raw, want", [
    ("8 (800) 555-35-35", "+78005553535"), ("not a number", None), ("+7 916 123 45 67", "+79161234567"), ("9161234567", "+79161234567"),
    ("103", "+7103"), (" 112 ", "+7112"), ("+12125551234", None), ("1234567", None), ("", None), ("79161234567", "+79161234567"),
])
def test_normalize(one, raw, want):
    assert one(P.normalize(F.col("x")), x=raw) == want


def test_normalize_keeps_foreign_numbers_if_asked(one):
    assert one(P.normalize(F.col("x"), False), x="+12125551234") == "+12125551234"


@pytest.mark.parametrize("number, valid, placeholder", [
    ("+74951234567", True, False), ("+74950000000", False, True), ("+77001234149", False, False), ("+70327490161", False, False),
    ("+78005553535", True, False), ("+7112", True, False), ("+79160000001", True, False),
])
def test_valid_and_placeholder(one, number, valid, placeholder):
    assert one(P.is_valid(F.col("x")), x=number) is valid
    assert one(P.is_placeholder(F.col("x")), x=number) is placeholder


@pytest.mark.parametrize("number, kind", [
    ("+7112", "short"), ("+78005553535", "tollfree"), ("+79161234567", "mobile"), ("+74951234567", "landline"), ("+70001234567", "ru_other"),
    ("+12125551234", "foreign"), ("", "unknown"),
])
def test_number_type(one, number, kind):
    assert one(P.number_type(F.col("x")), x=number) == kind


def test_plausible_numbers(one):
    for bad in ("+79999999999", "+79876543210", "+7916123456", "+70001234567"):
        assert one(P.is_plausible(F.col("x")), x=bad) is False
    assert one(P.is_plausible(F.col("x")), x="+79161234567") is True


def test_entropy(one):
    assert one(P.digit_entropy(F.col("x")), x="77777777777") < 0.1
    assert one(P.digit_entropy(F.col("x")), x="79001234567") > 0.3
    assert one(P.digit_entropy(F.col("x")), x="") == 0.0


def _python_runs(d):
    best = run = 1 if d else 0
    for a, b in zip(d, d[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return best


@pytest.mark.parametrize("d", ["", "1", "11", "1223334444", "79161112233", "1234567890"])
def test_runs_against_loops(one, d):
    repeats = sum(a == b for a, b in zip(d, d[1:]))
    assert one(P.repeat_ratio(F.col("x")), x=d) == pytest.approx(repeats / (len(d) - 1) if len(d) > 1 else 0.0)
    assert one(P.max_run(F.col("x")), x=d) == pytest.approx(_python_runs(d) / len(d) if d else 0.0)


@pytest.mark.parametrize("d, want", [("1111111", True), ("1234567", True), ("9161357", False), ("9876501", True), ("4712712", True)])
def test_beautiful(one, d, want):
    assert one(P.is_beautiful(F.col("x")), x=d) is want


def test_spoofing(one):
    assert one(P.spoofed_prefix(F.col("r"), F.col("n")), r="+84 95 123-45-67", n="+84951234567") is True
    assert one(P.spoofed_prefix(F.col("r"), F.col("n")), r="+7 495 123-45-67", n="+74951234567") is False


def test_operator_bucket(one):
    cases = {"ПАО МТС": "mts", "Вымпел-Коммуникации": "beeline", "Йота": "mvno", "": "unknown", "Прочий": "other", "T2 Мобайл": "tele2"}
    for name, bucket in cases.items():
        assert one(P.operator_bucket(F.col("x")), x=name) == bucket


def test_text_bucket_matches_the_polynomial(one):
    acc = 0
    for ch in "г. москва":
        acc = (acc * 31 + ord(ch)) % 1000003
    assert one(P.text_bucket(F.col("x")), x=" г. Москва ") == acc % 16


def test_clamp_and_safe_numbers(one):
    assert one(N.clamp01(F.lit(float("nan")))) == 0.0
    assert one(N.clamp01(F.lit(None).cast("double"))) is None
    assert one(N.clamp01(F.lit(3.0))) == 1.0
    assert one(N.safe_int(F.col("x")), x="12,7") == 12
    assert one(N.safe_int(F.col("x"), 5), x="x") == 5
    assert one(N.safe_float(F.col("x"), 0.5), x="0,25") == 0.25


@pytest.mark.parametrize("text, want", [
    ("2024-03-05", "2024-03-05 00:00:00"), ("05.03.2024", "2024-03-05 00:00:00"), ("05.03.2024 07:08", "2024-03-05 07:08:00"),
    ("2024-03-05 07:08:09", "2024-03-05 07:08:09"), ("2024-03-05T07:08:09", "2024-03-05 07:08:09"), ("soon", None), ("2024-13-45", None),
])
def test_parse_date(one, text, want):
    got = one(N.parse_date(F.col("x")).cast("string"), x=text)
    assert got == want


def test_sigmoid_is_stable(one):
    assert one(N.sigmoid(F.lit(-800.0))) == 0.0
    assert one(N.sigmoid(F.lit(800.0))) == 1.0
    assert one(N.sigmoid(F.lit(0.3))) == pytest.approx(1 / (1 + math.exp(-0.3)))


def test_negated_phrases_do_not_count(one):
    assert one(T.count_words(F.col("x"), ["спам", "мошен"]), x="Это не спам и не мошенники, а спам!") == 1
    assert one(T.evidence_categories(F.col("x")), x="не спам") == []
    assert one(T.evidence_categories(F.col("x")), x="Опросы и реклама") == ["Опросы", "спам"]


def test_section_between(one):
    text = "шапка Отзывы по номеру плохой номер Похожие номера хвост"
    got = one(T.section_between(F.col("x"), ["отзывы по номеру"], ["похожие номера", "новые"]), x=text)
    assert got == "Отзывы по номеру плохой номер"
    assert one(T.section_between(F.col("x"), ["нет такого"], ["x"]), x=text) == ""


def test_ngrams_go_by_size(one):
    assert one(T.ngrams(F.col("x")), x="абвгд") == ["абв", "бвг", "вгд", "абвг", "бвгд", "абвгд"]
    assert one(T.ngrams(F.col("x")), x="аб") == []


def test_counts_near_words(one):
    text = "120 просмотров и 7000000 запросов, 45 поисков"
    assert one(T.view_count(F.col("x")), x=text) == 7_000_000
    assert one(T.view_count(F.col("x"), T.VIEWS_BELIEVED), x=text) == 120
    assert one(T.review_count(F.col("x")), x="12 отзывов, 9000 оценок") == 9000
    assert one(T.review_count(F.col("x"), T.REVIEWS_BELIEVED), x="12 отзывов, 9000 оценок") == 12


def test_page_text_keeps_escaped_brackets(one):
    page = "<p>a &lt;b&gt; &laquo;c&raquo;</p><script>x</script><style>y</style>  d&nbsp;e"
    assert one(H.to_text(F.col("x")), x=page) == "a <b> «c» d e"
    assert one(H.plain(H.unescape_inner(F.col("x"))), x=page) == "a <b> «c» d e"


def test_class_attribute_ignores_scripts_and_comments(one):
    page = '<!-- class="negative" --><script>class="negative"</script><p class="ok">'
    assert one(H.class_attribute_has(F.col("x"), "negative"), x=page) is False
    assert one(H.class_attribute_has(F.col("x"), "OK"), x=page) is True


def test_numbers_in_text_and_html(one):
    assert one(H.numbers_in_text(F.col("x")), x="звонит +7 (916) 123-45-67 и 8 800 555 35 35, 79161234567") == ["+79161234567", "+78005553535"]
    page = '<a href="tel:%2B79161234567">x</a> 8 (495) 765-43-21 id=12345678901234'
    assert one(H.numbers_in_html(F.col("x")), x=page) == ["+79161234567", "+74957654321"]


def test_links_stay_on_the_host(one):
    page = '<a href="/a?x=1#f"><a href="b.html"><a href="https://other.org/"><a href="/s.css"><a href="tel:1"><a href="/a?x=1">'
    got = one(H.links(F.col("x"), F.lit("https://site.ru/dir/page")), x=page)
    assert got == ["https://site.ru/a?x=1", "https://site.ru/dir/b.html"]


def test_last_page(one):
    page = '<a class="pagination-list__link" href="?page=4"><a href="?page=9" class="x pagination-list__link"><a href="?page=70">'
    assert one(H.last_page(F.col("x")), x=page) == 9
    assert one(H.last_page(F.col("x")), x="") == 1


def test_nfc(one):
    assert one(T.strip_label(F.col("x")), x=" ёлка ") == "ёлка"
    assert one(T.strip_label(F.col("x")), x="a" * 201) == "a" * 201
    assert one(T.strip_label(F.col("x"), T.LABEL_CHARS), x="a" * 201) == ""
