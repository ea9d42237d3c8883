"""Labels, links, guards and retention over the event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import lookup as L
from ..plans import model as M
from ..streaming import jobs as J
from .bindings import Tables
from .registry import query


@query("st04_deferred_labels_batch", """SELECT m.id, m.ts + 86400000 AS due FROM calls m WHERE m.direction = 'INCOMING' AND m.state = 'MISSED' AND m.number IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM calls o WHERE o.number = m.number AND o.direction = 'OUTGOING' AND o.ts BETWEEN m.ts AND m.ts + 86400000)""")
def _(t: Tables):
    return E.deferred_labels(t.calls).select("id", "due")


@query("st08_guarded_labels", """SELECT c.id FROM calls c LEFT JOIN (SELECT number, max(struct_pack(ts := ts, id := id)) AS s FROM snapshots GROUP BY number) x ON x.number = c.number
    WHERE c.number IS NOT NULL AND NOT coalesce(abs(x.s.ts - c.ts) <= 600000000 AND (SELECT max(d.ts) FROM decisions d WHERE d.number = c.number AND d.verdict = 'BLOCK') >= c.ts - 600000, false)""")
def _(t: Tables):
    calls = t.calls.filter("number is not null")
    linked = L.link_latest(calls, t.snapshots, "number", tolerance_ms=600_000_000)
    return E.guarded_labels(calls.select("id", "number", "ts"), t.decisions, linked).select("id")


@query("st09_own_block_labels", "SELECT snapshot_id AS ref, number FROM decisions WHERE verdict = 'BLOCK' AND snapshot_id IS NOT NULL")
def _(t: Tables):
    return E.own_block_labels(t.decisions).select("ref", "number")


@query("st06_retained_events", "SELECT 'call' AS kind, count(*) AS rows FROM calls WHERE ts >= (SELECT max(ts) FROM calls) - 864000000 UNION ALL SELECT 'notification', count(*) FROM usage WHERE ts >= (SELECT max(ts) FROM usage) - 3600000")
def _(t: Tables):
    now = lambda df: df.agg(F.max("ts")).scalar()
    calls = E.retained(t.calls, now(t.calls), 10 * E.DAY_MS).agg(F.count(F.lit(1)).alias("rows")).withColumn("kind", F.lit("call"))
    notes = E.retained(t.usage, now(t.usage), E.RETENTION_MS["notification"]).agg(F.count(F.lit(1)).alias("rows")).withColumn("kind", F.lit("notification"))
    return calls.unionByName(notes)


@query("st06_expired_days", "SELECT day FROM (SELECT DISTINCT ts // 86400000 AS day FROM calls) x WHERE (day + 1) * 86400000 <= (SELECT max(ts) FROM calls) - 864000000", ints="day")
def _(t: Tables):
    table = t.calls.withColumn("day", F.floor(F.col("ts") / 86_400_000))
    return J.expired_days(table, t.calls.agg(F.max("ts")).scalar(), 10 * E.DAY_MS)


def labelled_calls(t: Tables):
    """Calls with labels and cheap device features, for the online models."""
    from .. import schema as S

    c = t.calls
    zero = {n: F.lit(0.0) for n in S.DEVICE_FEATURES}
    h = F.floor(F.col("ts") / 3_600_000) % 24
    own = {
        "is_night_time": F.when((h >= 22) | (h < 8), 1.0).otherwise(0.0), "hidden_number": F.col("number").isNull().cast("double"),
        "answer_rate_for_number_norm": (F.col("id") % 11) / 10.0, "is_contact": F.when(F.col("id") % 6 == 0, 1.0).otherwise(0.0),
    }
    label = F.when(F.col("state").isin("MISSED", "REJECTED"), "BLOCK").otherwise("ALLOW")
    return c.select("id", "user", "number", "ts", label.alias("label"), (F.col("id") % 10 == 0).alias("explicit"), F.lit(0).alias("model_version"),
                    *[v.alias(n) for n, v in {**zero, **own}.items()])


_X = {"is_contact": "CASE WHEN id % 6 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE", "night": "CASE WHEN (ts // 3600000) % 24 >= 22 OR (ts // 3600000) % 24 < 8 THEN 1.0 ELSE 0.0 END::DOUBLE", "rate": "((id % 11) / 10.0)::DOUBLE", "hidden": "CASE WHEN number IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE"}
_Z = "(w.b + w.w1 * s.x1 + w.w2 * s.x2 + w.w3 * s.x3 + w.w4 * s.x4)"
_ERR = f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-{_Z})) - s.y)"
SGD_SQL = f"""WITH RECURSIVE s AS (SELECT user, row_number() OVER (PARTITION BY user ORDER BY ts, id) AS rn, id, CASE WHEN state IN ('MISSED', 'REJECTED') THEN 1.0 ELSE 0.0 END::DOUBLE AS y, CASE WHEN id % 10 = 0 THEN 1.5 ELSE 0.5 END::DOUBLE AS k,
    {_X['is_contact']} AS x1, {_X['night']} AS x2, {_X['rate']} AS x3, {_X['hidden']} AS x4 FROM calls),
    w AS (SELECT user, 0::BIGINT AS rn, -1::BIGINT AS id, -0.5::DOUBLE AS b, -3.0::DOUBLE AS w1, 0.5::DOUBLE AS w2, -1.5::DOUBLE AS w3, 1.5::DOUBLE AS w4, 0.0::DOUBLE AS p FROM (SELECT DISTINCT user FROM s) u UNION ALL
    SELECT s.user, s.rn, s.id, w.b - 0.05 * s.k * {_ERR}, w.w1 - 0.05 * s.k * ({_ERR} * s.x1 + 1e-4 * w.w1), w.w2 - 0.05 * s.k * ({_ERR} * s.x2 + 1e-4 * w.w2), w.w3 - 0.05 * s.k * ({_ERR} * s.x3 + 1e-4 * w.w3), w.w4 - 0.05 * s.k * ({_ERR} * s.x4 + 1e-4 * w.w4), {_ERR} + s.y
    FROM w JOIN s ON s.user = w.user AND s.rn = w.rn + 1)"""


@query("ml07_online_models", f"{SGD_SQL} SELECT user, max(rn) AS steps, arg_max(b, rn) AS bias, arg_max(w1, rn) AS w_contact, arg_max(w3, rn) AS w_rate, arg_max(w4, rn) AS w_hidden FROM w GROUP BY user", "bias w_contact w_rate w_hidden")
def _(t: Tables):
    m = M.online_models(labelled_calls(t))
    return m.select("user", "steps", "bias", F.col("weights")[0].alias("w_contact"), F.col("weights")[15].alias("w_rate"), F.col("weights")[16].alias("w_hidden"))


@query("ml07_predict", f"""{SGD_SQL}, m AS (SELECT user, arg_max(b, rn) AS b, arg_max(w1, rn) AS w1, arg_max(w2, rn) AS w2, arg_max(w3, rn) AS w3, arg_max(w4, rn) AS w4 FROM w GROUP BY user)
    SELECT s.id, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(m.b + m.w1 * s.x1 + m.w2 * s.x2 + m.w3 * s.x3 + m.w4 * s.x4))) AS p_block FROM s JOIN m USING (user)""", "p_block")
def _(t: Tables):
    rows = labelled_calls(t)
    return M.predict_with(rows, M.online_models(rows)).select("id", "p_block")
