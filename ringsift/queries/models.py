"""Model fitting at scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import evaluate as V
from ..operators.sample import stratified_split
from ..plans import model as M
from .bindings import Tables
from .registry import query

FEATURES = ["reputationScore", "prefixRisk", "sourceConfidence", "digitEntropy"]


def _rows(t: Tables):
    label = F.when(F.col("label") == "ALLOW", 0.0).when(F.col("label") == "WARN", 1.0).otherwise(2.0)
    # The label leans on two features, so that there is something to learn.
    signal = F.when(F.col("reputationScore") + F.col("prefixRisk") > 1.2, 2.0).when(F.col("prefixRisk") < 0.3, 0.0).otherwise(label)
    return t.classed.withColumn("y", signal)


def _held_out(rows):
    """Rows to fit on, and rows to score: four fifths and one tenth of every class."""
    parts = stratified_split(rows.withColumn("_c", F.col("y").cast("string")), "_c", "key")
    return tuple(parts.filter(F.col("split") == name).drop("_c", "split") for name in ("train", "test"))


_Y = """(SELECT *, CASE WHEN "reputationScore" + "prefixRisk" > 1.2 THEN 2.0 WHEN "prefixRisk" < 0.3 THEN 0.0 WHEN label = 'ALLOW' THEN 0.0 WHEN label = 'WARN' THEN 1.0 ELSE 2.0 END AS y FROM classed)"""
_SPLIT = f"""(SELECT *, CASE WHEN rn <= round_even(0.8 * n, 0) THEN 'train' WHEN rn <= round_even(0.8 * n, 0) + round_even(0.1 * n, 0) THEN 'val' ELSE 'test' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || key)) AS rn, count(*) OVER (PARTITION BY y)::DOUBLE AS n FROM {_Y} a) b)"""


@query("ml01_class_weights", f"SELECT y, count(*) AS rows, sum(count(*)) OVER () / (3.0 * count(*)) AS class_weight FROM {_SPLIT} s WHERE split = 'train' GROUP BY y", "y class_weight")
def _(t: Tables):
    seen, _ = _held_out(_rows(t))
    return M.with_class_weight(seen, "y", 3).groupBy("y").agg(F.count(F.lit(1)).alias("rows"), F.max("class_weight").alias("class_weight"))


@query("ml01_support", f"SELECT y AS class, count(*) AS support FROM {_SPLIT} s WHERE split = 'test' GROUP BY y", "class")
def _(t: Tables):
    seen, unseen = _held_out(_rows(t))
    model = M.logistic(FEATURES, "y", "class_weight").fit(M.with_class_weight(seen, "y", 3))
    tested = M.score(model, unseen, ["p_allow", "p_warn", "p_block"])
    # What is scored are the held-out rows, each once, with probabilities that sum to one.
    right = tested.filter(F.abs(F.col("p_allow") + F.col("p_warn") + F.col("p_block") - 1.0) < 1e-9)
    return V.per_class_metrics(right, "y", "prediction", [0.0, 1.0, 2.0]).select("class", "support")


@query("ml01_logistic")
def _(t: Tables):
    seen, unseen = _held_out(_rows(t))
    model = M.logistic(FEATURES, "y", "class_weight").fit(M.with_class_weight(seen, "y", 3))
    tested = M.score(model, unseen, ["p_allow", "p_warn", "p_block"])
    return V.per_class_metrics(tested, "y", "prediction", [0.0, 1.0, 2.0])


@query("ml01_forest")
def _(t: Tables):
    seen, unseen = _held_out(_rows(t))
    model = M.forest(FEATURES, "y", trees=20, depth=6).fit(seen)
    return V.per_class_metrics(M.score(model, unseen, ["p_allow", "p_warn", "p_block"]), "y", "prediction", [0.0, 1.0, 2.0])


@query("ml02_platt")
def _(t: Tables):
    rows = t.scores.select((F.col("y") == 2).cast("int").alias("b"), "p_block")
    a, b = M.platt(rows, "b", "p_block")
    done = rows.withColumn("calibrated", M.platt_map(F.col("p_block"), a, b))
    before, after = V.calibration_error(done, "b", "p_block"), V.calibration_error(done, "b", "calibrated")
    return before.select(F.lit("before").alias("stage"), "ece").unionByName(after.select(F.lit("after").alias("stage"), "ece"))


_LOGIT = "ln(greatest(least(p_block, 1 - 1e-7), 1e-7) / (1 - greatest(least(p_block, 1 - 1e-7), 1e-7)))"
_TARGET = "CASE WHEN y = 2 THEN (p + 1.0) / (p + 2.0) ELSE 1.0 / (q + 2.0) END"


@query("ml02_platt_balance", f"SELECT count(*) AS rows, avg({_TARGET}) AS mean, avg({_LOGIT} * {_TARGET}) AS moment, true AS rising FROM scores, (SELECT count(*) FILTER (y = 2)::DOUBLE AS p, count(*) FILTER (y <> 2)::DOUBLE AS q FROM scores) c", "mean moment", places=4)
def _(t: Tables):
    """At the optimum the calibrated scores have the mean, and the moment along the logit, of the smoothed targets."""
    rows = t.scores.select((F.col("y") == 2).cast("int").alias("b"), "p_block")
    a, b = M.platt(rows, "b", "p_block")
    done = rows.withColumn("c", M.platt_map(F.col("p_block"), a, b))
    z = M.logit(F.col("p_block"))
    return done.agg(F.count(F.lit(1)).alias("rows"), F.avg("c").alias("mean"), F.avg(z * F.col("c")).alias("moment"), F.lit(a > 0).alias("rising"))


@query("ml02_isotonic", """WITH RECURSIVE x AS (SELECT p_block AS p, count(*) AS n, avg(CASE WHEN y = 2 THEN 1.0 ELSE 0.0 END) AS m FROM scores GROUP BY p_block),
    i AS (SELECT a.p, min(b2.v) AS lowest FROM x a JOIN (SELECT s.p AS s, e.p AS e, sum(k.n * k.m) / sum(k.n) AS v FROM x s JOIN x e ON e.p >= s.p JOIN x k ON k.p BETWEEN s.p AND e.p GROUP BY s.p, e.p) b2 ON b2.e >= a.p AND b2.s <= a.p GROUP BY a.p, b2.s)
    SELECT x.p AS p_block, max(i.lowest) AS calibrated, any_value(x.n) AS n FROM x JOIN i ON i.p = x.p GROUP BY x.p""", "p_block calibrated", places=5)
def _(t: Tables):
    rows = t.scores.select((F.col("y") == 2).cast("int").alias("b"), "p_block")
    return M.isotonic(rows, "b", "p_block").groupBy("p_block").agg(F.max("calibrated").alias("calibrated"), F.count(F.lit(1)).alias("n"))


@query("ml03_cross_validation")
def _(t: Tables):
    return M.k_fold_metrics(_rows(t), "key", FEATURES, "y", 3, k=3)


@query("ml03_folds", f"SELECT CAST('0x' || substr(md5('42:' || key), 1, 8) AS BIGINT) % 3 AS fold, y, count(*) AS rows FROM {_Y} a GROUP BY ALL", "y")
def _(t: Tables):
    return M.folds(_rows(t), "key", 3).groupBy("fold", "y").agg(F.count(F.lit(1)).alias("rows"))


_PRED = "CASE WHEN p_block >= 0.5 THEN 2 WHEN p_warn >= 0.2 THEN 1 ELSE 0 END"
_CLASS = f"""(SELECT k, tp / greatest(tp + fp, 1) AS p, 2.0 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-9::DOUBLE) AS f FROM (
    SELECT k, count(*) FILTER (y = k AND pred = k) AS tp, count(*) FILTER (y <> k AND pred = k) AS fp, count(*) FILTER (y = k AND pred <> k) AS fn FROM (SELECT y, {_PRED} AS pred FROM scores) s, (SELECT unnest([0, 1, 2]) AS k) c GROUP BY k) d)"""


@query("ml04_objective", f"SELECT macro_f1, block_precision, macro_f1 - 0.3 * greatest(0.0, 0.9 - block_precision) AS objective FROM (SELECT avg(f) AS macro_f1, max(p) FILTER (k = 2) AS block_precision FROM {_CLASS} a) b", "macro_f1 block_precision objective")
def _(t: Tables):
    pred = F.when(F.col("p_block") >= 0.5, 2).when(F.col("p_warn") >= 0.2, 1).otherwise(0)
    rows = t.scores.select(F.col("y").cast("int").alias("y"), pred.alias("pred"))
    return M.objective(V.per_class_metrics(rows, "y", "pred", [0, 1, 2]), 2, 0.9)


@query("ml04_search")
def _(t: Tables):
    rows = stratified_split(_rows(t).withColumn("c", F.col("y").cast("string")), "c", "key")
    return M.search(rows.filter("split = 'train'"), rows.filter("split = 'val'"), FEATURES, "y", 3, 2, 0.9, [0.0, 0.05])


def _unit(seed: int, unit: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {unit}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"


@query("ml05_smote", f"SELECT key, 1::BIGINT AS copy, {_unit(43, 'concat(key, chr(58), 1)')} AS t, true AS between_near_rows FROM {_Y} a WHERE y = 0.0", "t")
def _(t: Tables):
    """Every row of the class has its copy, which lies where it should on the line to another row of the class."""
    rows = _rows(t)
    made = M.smote(rows, "y", 0.0, "key", FEATURES, copies=1)
    one, two = rows.alias("a"), rows.alias("b")
    met = made.alias("m").join(one, F.col("m.key") == F.col("a.key")).join(two, F.col("m.parent") == F.col("b.key"))
    right = (F.col("a.y") == 0.0) & (F.col("b.y") == 0.0) & (F.col("m.key") != F.col("m.parent"))
    for f in FEATURES:
        right = right & (F.abs(F.col(f"a.{f}") * (1 - F.col("m.t")) + F.col(f"b.{f}") * F.col("m.t") - F.col(f"m.{f}")) < 1e-9)
    return met.select(F.col("m.key").alias("key"), F.col("m.copy").alias("copy"), F.col("m.t").alias("t"), right.alias("between_near_rows"))


@query("ml06_fine_tune", f"SELECT y, count(*) AS rows FROM {_SPLIT} s WHERE split = 'test' GROUP BY y", "y")
def _(t: Tables):
    """Rows that neither the base nor the feedback held, by class."""
    seen, unseen = _held_out(_rows(t))
    fixed = D.corrected_label(F.when(F.col("key") % 2 == 0, "not_spam").otherwise("fraud"), D.label_name(F.col("y").cast("int")))
    y = F.when(fixed["label"] == "ALLOW", 0.0).when(fixed["label"] == "WARN", 1.0).otherwise(2.0)
    feedback = seen.select(*FEATURES, y.alias("y"), fixed["weight"].alias("weight"))
    model = M.fine_tune(seen, feedback, FEATURES, "y")
    return M.score(model, unseen, ["p_allow", "p_warn", "p_block"]).filter("prediction in (0, 1, 2)").groupBy("y").agg(F.count(F.lit(1)).alias("rows"))


@query("ml08_soft_targets", f"SELECT y, count(*) AS rows, 1.0 AS mean_sum FROM {_SPLIT} s WHERE split = 'test' GROUP BY y", "y mean_sum")
def _(t: Tables):
    seen, unseen = _held_out(_rows(t))
    scored = M.teacher_scores(seen, FEATURES, "y", 3, rounds=2, depth=2, on=unseen)
    soft = M.soft_targets([F.col(f"teacher_{c}") for c in range(3)], 2.0)
    return scored.withColumn("_sum", soft[0] + soft[1] + soft[2]).groupBy("y").agg(F.count(F.lit(1)).alias("rows"), F.avg("_sum").alias("mean_sum"))


@query("ml08_teacher_student")
def _(t: Tables):
    seen, unseen = _held_out(_rows(t))
    scored = M.teacher_scores(seen, FEATURES, "y", 3, rounds=3, depth=3, on=unseen)
    soft = M.soft_targets([F.col(f"teacher_{c}") for c in range(3)], 2.0)
    scored = scored.withColumns({f"soft_{c}": soft[c] for c in range(3)})
    out = M.student(seen, FEATURES, "y", 3, (8,), 15, on=scored)
    return out.groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("rows"), F.avg("soft_2").alias("mean_soft_block"))
