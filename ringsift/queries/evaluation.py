"""Classifier evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import decide as D
from ..operators import evaluate as V
from .bindings import Tables
from .registry import query

_MIC = "CAST(round({} * 1000000) AS BIGINT)"
_PRED = "CASE WHEN p_block >= 0.5 THEN 2 WHEN p_warn >= 0.1 THEN 1 ELSE 0 END"


def _scored(t: Tables):
    return t.scores.withColumn("pred", D.verdict_id("three_class", F.col("p_block"), F.col("p_warn"), 0.5, 0.1))


def _prf(tp: str, fp: str, fn: str) -> tuple[str, str, str]:
    p, r = f"({tp}) / greatest({tp} + {fp}, 1)", f"({tp}) / greatest({tp} + {fn}, 1)"
    return p, r, f"2.0::DOUBLE * ({p}) * ({r}) / greatest(({p}) + ({r}), 1e-9::DOUBLE)"


_P, _R, _F = _prf("tp", "fp", "fn")
_PER = f"""(SELECT class, tp, fp, fn, {_P} AS precision, {_R} AS recall, {_F} AS f1, tp + fn AS support FROM (SELECT k::BIGINT AS class, count(*) FILTER (y = k AND pred = k) AS tp, count(*) FILTER (y <> k AND pred = k) AS fp,
    count(*) FILTER (y = k AND pred <> k) AS fn FROM (SELECT y, {_PRED} AS pred FROM scores) s, range(3) c(k) GROUP BY k) x)"""


@query("ag10_per_class_metrics", f"SELECT * FROM {_PER} z", "precision recall f1")
def _(t: Tables):
    return V.per_class_metrics(_scored(t), "y", "pred", [0, 1, 2])


@query("ag10_confusion", f"SELECT y, {_PRED} AS pred, count(*) AS rows FROM scores GROUP BY ALL", ints="pred")
def _(t: Tables):
    return V.confusion(_scored(t), "y", "pred")


@query("ag10_macro_f1", f"SELECT avg(f1) AS macro_f1, sum(tp) / sum(support) AS accuracy FROM {_PER} z", "macro_f1 accuracy")
def _(t: Tables):
    return V.macro_f1(V.per_class_metrics(_scored(t), "y", "pred", [0, 1, 2]))


_G = f"""(SELECT count(*) FILTER (v >= 2 AND y >= 1) AS tp, count(*) FILTER (v >= 2 AND y = 0) AS fp, count(*) FILTER (v < 2 AND y >= 1) AS fn, count(*) FILTER (v < 2 AND y = 0) AS tn,
    count(*) FILTER (v >= 1 AND y = 0) AS flagged, count(*) FILTER (y = 0) AS allow, count(*) FILTER (v = y) AS good, count(*) AS total FROM (SELECT y, {_PRED} AS v FROM scores) s)"""


@query("ag11_golden_metrics", f"""SELECT {_P} AS block_precision, {_R} AS block_recall, {_F} AS block_f1, flagged / greatest(allow, 1) AS allow_fp_rate, good / total AS accuracy, tp AS tp_block, fp AS fp_block,
    fn AS fn_block, tn AS tn_block, total, tp + fn AS true_spam_count, allow AS true_allow_count FROM {_G} g""", "block_precision block_recall block_f1 allow_fp_rate accuracy")
def _(t: Tables):
    return V.golden_metrics(_scored(t), "y", "pred")


@query("ag12_binary_metrics", f"""SELECT 0.45 AS threshold, tp, fp, fn, tn, {_P} AS precision, {_R} AS recall, tn / greatest(tn + fp, 1) AS specificity, {_F} AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM (
    SELECT count(*) FILTER (h AND y) AS tp, count(*) FILTER (h AND NOT y) AS fp, count(*) FILTER (NOT h AND y) AS fn, count(*) FILTER (NOT h AND NOT y) AS tn FROM (SELECT p_block >= 0.45 AS h, y = 2 AS y FROM scores) s) x""",
       "threshold precision recall specificity f1 accuracy")
def _(t: Tables):
    s = t.scores.withColumn("b", (F.col("y") == 2).cast("int"))
    return V.binary_metrics(s, "b", "p_block", 0.45)


def _sweep(score: str, pos: str, first: int, last: int, source: str = "scores") -> str:
    m = _MIC.format(score)
    return f"""(SELECT c AS cent, c / 100.0::DOUBLE AS threshold, tp, fp, fn, tn, {_P} AS precision, {_R} AS recall, {_F} AS f1, fp / greatest(fp + tn, 1) AS fp_rate FROM (
        SELECT c, count(*) FILTER (s >= c * 10000 AND pos) AS tp, count(*) FILTER (s >= c * 10000 AND NOT pos) AS fp, count(*) FILTER (s < c * 10000 AND pos) AS fn, count(*) FILTER (s < c * 10000 AND NOT pos) AS tn
        FROM (SELECT {m} AS s, {pos} AS pos FROM {source}) q, range({first}, {last + 1}) g(c) GROUP BY c) w)"""


def _three(floor: float, value: str, order: str, first: int, last: int, wfirst: int, wlast: int, positive_only: bool) -> str:
    keep = f"precision >= {floor}" + (" AND f1 > 0" if positive_only else "")
    warn = _sweep("w", "y = 1", wfirst, wlast, "(SELECT y, CASE WHEN CAST(round(p_block * 1000000) AS BIGINT) >= coalesce((SELECT cent FROM best), 50) * 10000 THEN -1.0 ELSE p_warn END AS w FROM scores)")
    return f"""WITH best AS (SELECT * FROM {_sweep('p_block', 'y = 2', first, last)} a WHERE {keep} ORDER BY {value} DESC, cent {order} LIMIT 1), bw AS (SELECT * FROM {warn} b WHERE f1 > 0 ORDER BY f1 DESC, cent LIMIT 1)
        SELECT coalesce((SELECT threshold FROM best), 0.5) AS block_threshold, coalesce((SELECT precision FROM best), 0) AS block_precision, coalesce((SELECT recall FROM best), 0) AS block_recall"""


@query("ag13_tune_three_class", _three(0.335, "f1", "ASC", 10, 95, 10, 85, True) + ", coalesce((SELECT f1 FROM best), 0) AS block_f1, coalesce((SELECT threshold FROM bw), 0.3) AS warn_threshold, coalesce((SELECT f1 FROM bw), 0) AS warn_f1",
       "block_threshold block_precision block_recall block_f1 warn_threshold warn_f1")
def _(t: Tables):
    return V.tune_three_class(t.scores, "y", "p_block", "p_warn", 0.335)


@query("ag14_tune_by_recall", _three(0.33, "recall", "DESC", 5, 95, 10, 60, False) + ", coalesce((SELECT threshold FROM bw), 0.3) AS warn_threshold, coalesce((SELECT f1 FROM bw), 0) AS warn_f1",
       "block_threshold block_precision block_recall warn_threshold warn_f1")
def _(t: Tables):
    return V.tune_three_class_recall(t.scores, "y", "p_block", "p_warn", 0.33)


@query("ag15_operating_points", f"""SELECT f AS floor, coalesce(b.t, 1.0) AS threshold, coalesce(b.p, 0.0) AS precision, coalesce(b.r, 0.0) AS recall FROM (SELECT unnest([0.95, 0.34, 0.33]::DOUBLE[]) AS f) k
    LEFT JOIN LATERAL (SELECT threshold AS t, precision AS p, recall AS r FROM {_sweep('p_block', 'y = 2', 10, 99)} a WHERE precision >= f AND recall > 0 ORDER BY recall DESC, cent LIMIT 1) b ON true""", "floor threshold precision recall")
def _(t: Tables):
    return V.operating_points(t.scores, F.col("y") == 2, "p_block", (0.95, 0.34, 0.33))


def _tb(pos: str, floor: float) -> str:
    return f"""WITH best AS (SELECT * FROM {_sweep('p_block', pos, 10, 95)} a WHERE precision >= {floor} AND f1 > 0 ORDER BY f1 DESC, cent LIMIT 1), c AS (SELECT coalesce((SELECT cent FROM best), 50) AS cent),
    steps AS (SELECT i, cent, 100000 + i * ((cent * 10000 - 150000) / 29.0::DOUBLE) AS t FROM c, range(30) g(i)),
    bands AS (SELECT i, count(*) AS n, count(*) FILTER ({pos}) AS p FROM steps, (SELECT y, {_MIC.format('p_block')} AS s FROM scores) q WHERE s >= t AND s < cent * 10000 GROUP BY i)
    SELECT cent / 100.0::DOUBLE AS block_threshold, least(coalesce((SELECT 0.10::DOUBLE + min(i) * ((cent / 100.0::DOUBLE - 0.15) / 29.0) FROM bands WHERE p / n >= 0.5), greatest(0.10, cent / 100.0::DOUBLE - 0.20)), cent / 100.0::DOUBLE - 0.01) AS warn_threshold FROM c"""


@query("ag16_tune_binary_rare", _tb("l_discount > 0.05", 0.9).replace("SELECT y, CAST", "SELECT y, l_discount, CAST"), "block_threshold warn_threshold")
def _(t: Tables):
    return V.tune_binary(t.scores, F.col("l_discount") > 0.05, "p_block", 0.9)


@query("ag16_tune_binary", _tb("y >= 1", 0.6), "block_threshold warn_threshold")
def _(t: Tables):
    return V.tune_binary(t.scores, F.col("y") >= 1, "p_block", 0.6)


@query("ag17_gated_sweep", f"""SELECT threshold, tp, fp, fn, tn, precision, recall, f1, fp_rate, precision >= 0.6 AND recall >= 0.55 AND fp_rate <= 0.9 AS passes FROM {_sweep('p_block', 'y >= 1', 1, 50)} a
    ORDER BY (precision >= 0.6 AND recall >= 0.55 AND fp_rate <= 0.9) DESC, f1 DESC, cent LIMIT 1""", "threshold precision recall f1 fp_rate")
def _(t: Tables):
    return V.gated_sweep(t.scores, F.col("y") >= 1, "p_block", 0.6, 0.55, 0.9)


@query("ag18_calibration_error", "SELECT sum(n * abs(y - p)) / sum(n) AS ece FROM (SELECT least(floor(p_block * 15), 14) AS b, count(*) AS n, avg(p_block) AS p, avg(CASE WHEN y = 2 THEN 1.0 ELSE 0.0 END) AS y FROM scores GROUP BY 1) x", "ece")
def _(t: Tables):
    return V.calibration_error(t.scores.withColumn("b", (F.col("y") == 2).cast("int")), "b", "p_block")


@query("ag19_brier", "SELECT avg(pow(p_block - CASE WHEN y = 2 THEN 1 ELSE 0 END, 2)) AS brier FROM scores", "brier")
def _(t: Tables):
    return V.brier(t.scores.withColumn("b", (F.col("y") == 2).cast("int")), "b", "p_block")


def _auc(c: str, k: int) -> str:
    return f"""SELECT {k}::BIGINT AS class, (sum(r) FILTER (y = {k}) - count(*) FILTER (y = {k})::DOUBLE * (count(*) FILTER (y = {k}) + 1) / 2) / (count(*) FILTER (y = {k})::DOUBLE * count(*) FILTER (y <> {k})) AS auc FROM (
        SELECT y, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r FROM scores) x"""


@query("ag20_auc_one_vs_rest", " UNION ALL ".join(_auc(c, k) for k, c in enumerate(("p_allow", "p_warn", "p_block"))), "auc")
def _(t: Tables):
    return V.auc_one_vs_rest(t.scores, "y", {0: "p_allow", 1: "p_warn", 2: "p_block"})


def _mi(f: str) -> str:
    return f"""SELECT '{f}' AS feature, sum(n / t * ln(n * t / (nx * ny))) AS binned_mi FROM (SELECT n::DOUBLE AS n, sum(n) OVER ()::DOUBLE AS t, sum(n) OVER (PARTITION BY x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y)::DOUBLE AS ny
        FROM (SELECT y, least(floor({f} * 20), 19) AS x, count(*) AS n FROM scores GROUP BY ALL) a) b"""


@query("ag21_mutual_information", " UNION ALL ".join(_mi(f) for f in ("p_block", "p_warn", "l_discount")), "binned_mi")
def _(t: Tables):
    return V.binned_mi(t.scores, "y", ["p_block", "p_warn", "l_discount"])


def _perm_auc(a: str, b: str, rows: str) -> str:
    """AUC of 0.6 a + 0.4 b for BLOCK by ranks."""
    m = f"CAST(round((0.6::DOUBLE * {a} + 0.4::DOUBLE * {b}) * 1000000) AS BIGINT)"
    return f"""(SELECT (sum(r) FILTER (pos) - count(*) FILTER (pos)::DOUBLE * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos)::DOUBLE * count(*) FILTER (NOT pos)) FROM (
        SELECT pos, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0::DOUBLE AS r FROM (SELECT label = 'BLOCK' AS pos, {m} AS m FROM {rows}) x) y)"""


def _shuffled(column: str, seed: int, which: int, n: str = "(SELECT count(*) FROM classed)") -> str:
    """The rows of classed with ``v``, the column's value of the row that a keyed permutation moves there."""
    inner = f'SELECT "{column}" AS v, pos AS x FROM (SELECT *, row_number() OVER (ORDER BY md5(\'{seed}:\' || key)) - 1 AS pos FROM classed) p'
    for k, a, b in V.permutation_keys(seed, which):
        inner = f"SELECT v, CASE WHEN ((greatest(x, y) % {V.PRIMES[0]}) * {a}::BIGINT + {b}::BIGINT) % {V.PRIMES[1]} % 2 = 1 THEN y ELSE x END AS x FROM (SELECT v, x, ((({k}::BIGINT - x) % {n}) + {n}) % {n} AS y FROM ({inner}) a) b"
    return f"(SELECT a.*, b.v FROM (SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || key)) - 1 AS x FROM classed) a JOIN ({inner}) b USING (x))"


_S, _K = '"reputationScore"', '"prefixRisk"'
_BASEAUC = _perm_auc(_S, _K, "classed")
_IMP = " UNION ALL ".join(
    f"SELECT '{name}' AS feature, {_BASEAUC} - {_perm_auc(*(('v', _K) if i == 0 else (_S, 'v')), _shuffled(name, 42, 2 * i + r))} AS d"
    for i, name in enumerate(("reputationScore", "prefixRisk")) for r in range(2))


@query("ag22_permutation_importance", f"SELECT feature, avg(d) AS importance FROM ({_IMP}) z GROUP BY feature", "importance")
def _(t: Tables):
    rows = t.classed.select("key", "label", "reputationScore", "prefixRisk")
    score = 0.6 * F.col("reputationScore") + 0.4 * F.col("prefixRisk")
    return V.permutation_importance(rows, "key", F.col("label") == "BLOCK", score, ["reputationScore", "prefixRisk"], repeats=2)


@query("ag22_permuted_column", """SELECT a.key, b.v AS "prefixRisk" FROM (SELECT key, row_number() OVER (ORDER BY md5('9:' || key)) AS pos FROM classed) a JOIN (SELECT "prefixRisk" AS v, row_number() OVER (ORDER BY md5('10:' || key)) AS pos FROM classed) b USING (pos)""", "prefixRisk")
def _(t: Tables):
    return V.permuted(t.classed.select("key", "prefixRisk"), "key", "prefixRisk", 9)


def _ks(f: str) -> str:
    return f"""SELECT '{f}' AS feature, max(abs(ca / na - cb / nb)) AS ks FROM (SELECT sum(a) OVER (ORDER BY v)::DOUBLE AS ca, sum(b) OVER (ORDER BY v)::DOUBLE AS cb, sum(a) OVER ()::DOUBLE AS na, sum(b) OVER ()::DOUBLE AS nb FROM (
        SELECT {f} AS v, count(*) FILTER (fresh = 0) AS a, count(*) FILTER (fresh = 1) AS b FROM scores GROUP BY 1) x) y"""


_KF = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


@query("ag23_ks_distance", " UNION ALL ".join(_ks(f) for f in _KF), "ks")
def _(t: Tables):
    s = t.scores
    return V.ks_drift(s.filter("fresh = 0"), s.filter("fresh = 1"), _KF).select("feature", "ks")


@query("ag23_drift_verdict", f"""SELECT count(*) AS features, count(*) FILTER (p < 0.01) AS drifted, count(*) FILTER (p < 0.01) / count(*) > 0.3 AS drift FROM (SELECT feature, CASE WHEN l < 0.2 THEN 1.0 ELSE greatest(0, least(1, 2 * exp(-2 * l * l) - 2 * exp(-8 * l * l) + 2 * exp(-18 * l * l) - 2 * exp(-32 * l * l) + 2 * exp(-50 * l * l))) END AS p FROM (
    SELECT feature, (sqrt(na * nb / (na + nb)) + 0.12 + 0.11 / sqrt(na * nb / (na + nb))) * ks AS l FROM ({' UNION ALL '.join(_ks(f) for f in _KF)}) k, (SELECT count(*) FILTER (fresh = 0)::DOUBLE AS na, count(*) FILTER (fresh = 1)::DOUBLE AS nb FROM scores) n) a) b""")
def _(t: Tables):
    s = t.scores
    return V.drift_verdict(V.ks_drift(s.filter("fresh = 0"), s.filter("fresh = 1"), _KF))




@query("ag36_app_category_metrics", """SELECT class, tp, fp, fn, precision, recall, f1 FROM (SELECT class, tp, fp, fn, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall,
    2.0::DOUBLE * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-9::DOUBLE) AS f1 FROM (
    SELECT k AS class, count(*) FILTER (y = k AND p = k) AS tp, count(*) FILTER (y <> k AND p = k) AS fp, count(*) FILTER (y = k AND p <> k) AS fn FROM (
      SELECT y, CASE WHEN ord % 6 = 0 THEN 'GAMES' ELSE y END AS p FROM (SELECT ord, CASE WHEN upper(trim(category)) IN ('BANK', 'GAMES', 'NEWS', 'VPN', 'EMAIL') THEN upper(trim(category)) ELSE 'OTHER' END AS y FROM app_corpus) a WHERE y NOT IN ('OTHER', 'PRODUCTIVITY')) b,
      (SELECT unnest(['BANK', 'GAMES', 'NEWS', 'VPN', 'EMAIL']) AS k) c GROUP BY k) d) e""", "precision recall f1")
def _(t: Tables):
    rows = t.app_corpus.select("ord", T.app_category(F.col("category")).alias("y"))
    rows = rows.withColumn("p", F.when(F.col("ord") % 6 == 0, "GAMES").otherwise(F.col("y"))).filter(~F.col("y").isin("OTHER", "PRODUCTIVITY"))
    return V.per_class_metrics(rows, "y", "p", ["BANK", "GAMES", "NEWS", "VPN", "EMAIL"]).drop("support")


@query("dec18_evaluation_gate", f"""SELECT * FROM (SELECT 'block_precision' AS metric, {_P} AS value, 0.85 AS bound, 'min' AS kind FROM {_G} a UNION ALL SELECT 'block_recall', {_R}, 0.55, 'min' FROM {_G} b UNION ALL SELECT 'allow_fp_rate', flagged / allow, 0.15, 'max' FROM {_G} c) x
    WHERE (kind = 'min' AND value < bound) OR (kind = 'max' AND value > bound)""", "value bound")
def _(t: Tables):
    m = V.golden_metrics(_scored(t), "y", "pred")
    return V.failed_gates(m, {"block_precision": 0.85, "block_recall": 0.55}, {"allow_fp_rate": 0.15})


@query("dec19_app_model_gate", f"""SELECT * FROM (SELECT 'top1' AS metric, sum(tp) / sum(support) AS value, 0.9 AS bound, 'min' AS kind FROM {_PER} a UNION ALL SELECT 'macro_f1', avg(f1), 0.85, 'min' FROM {_PER} b UNION ALL SELECT 'bank', max(precision) FILTER (class = 0), 0.2, 'min' FROM {_PER} c
    UNION ALL SELECT 'email', CAST(NULL AS DOUBLE), 0.95, 'min') x WHERE value IS NULL OR value < bound""", "value bound")
def _(t: Tables):
    per = V.per_class_metrics(_scored(t), "y", "pred", [0, 1, 2])
    m = per.agg(
        (F.sum("tp") / F.sum("support")).alias("top1"), F.avg("f1").alias("macro_f1"), F.max(F.when(F.col("class") == 0, F.col("precision"))).alias("bank"),
        F.max(F.when(F.col("class") == 9, F.col("precision"))).alias("email"))
    return V.failed_gates(m, {"top1": 0.90, "macro_f1": 0.85, "bank": 0.20, "email": 0.95})


@query("dec20_promotion", f"""SELECT class, CASE WHEN class = 1 THEN false WHEN precision >= bp AND recall >= br - 0.05 THEN true ELSE false END AS eligible, CASE WHEN class = 1 THEN 'gate_failed' WHEN precision < bp AND recall < br - 0.05 THEN 'precision_and_recall_below_baseline'
    WHEN precision < bp THEN 'precision_below_baseline' WHEN recall < br - 0.05 THEN 'recall_dropped' ELSE 'meets_baseline' END AS reason FROM {_PER} a, (SELECT max(precision) AS bp, max(recall) AS br FROM {_PER} b WHERE class = 2) c""")
def _(t: Tables):
    per = V.per_class_metrics(_scored(t), "y", "pred", [0, 1, 2])
    return V.promotion(per.withColumn("gate_passed", F.col("class") != 1), per.filter("class = 2")).select("class", "eligible", "reason")


@query("dec23_best_model", f"SELECT class, precision, recall FROM {_PER} a ORDER BY precision DESC, recall DESC, class LIMIT 1", "precision recall")
def _(t: Tables):
    per = V.per_class_metrics(_scored(t), "y", "pred", [0, 1, 2])
    return V.best_model(per, ["precision", "recall"], "class").select("class", "precision", "recall")
