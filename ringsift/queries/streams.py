"""The event path as streams. The events are replayed in several batches and the output is compared as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.events import BLOCK_STEP, WARN_STEP
from ..plans import model as M
from ..session import scratch_path
from ..streaming import jobs as J
from ..streaming import run as R
from .bindings import VIEWS, Tables, _render
from .events import SGD_SQL, labelled_calls
from .registry import query


#: Files that the events are replayed from, one per micro-batch, and by how much they overlap in time.
FILES, OVERLAP_MS = 3, 12 * 3_600_000
#: Ids of the rows that close a stream, and how far behind the last event they lie.
CLOSING, CLOSING_ROWS, CLOSING_MS = 1 << 40, 60, 60 * 86_400_000


class StreamTables(Tables):
    """The event views over the events as a stream of several files.

    The files follow one another in time but overlap by half a day, so events come late and out of
    order. A last file may hold rows far in the future that move the watermark past all events.
    """

    def __init__(self, spark, folder: str, closed: bool = False):
        super().__init__(spark, folder)
        self._events = None
        self._closed = closed

    def base(self, name: str) -> DataFrame:
        if name != "events":
            return super().base(name)
        if self._events is None:
            self._events = self._replayed(super().base("events"))
        return self._events

    def _replayed(self, table: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "replay")
        ms = F.unix_millis(F.col("ts").cast("timestamp"))
        first, last = table.agg(F.min(ms), F.max(ms)).first()
        at = ms + F.pmod(F.xxhash64("event_id"), F.lit(OVERLAP_MS))
        part = F.least(F.floor((at - first) * FILES / (last - first + OVERLAP_MS + 1)), F.lit(FILES - 1))
        for i in range(FILES):
            table.filter(part == i).write.mode("append").parquet(f"{path}/{i}")
        if self._closed:
            kinds = F.array(*[F.lit(k) for k in ("error", "purchase", "signup", "view", "click")])
            rows = self.spark.range(CLOSING, CLOSING + CLOSING_ROWS).select(
                F.col("id").alias("event_id"), F.timestamp_millis(F.lit(last + CLOSING_MS)).alias("ts"), (F.col("id") - CLOSING).alias("user_id"),
                kinds[(F.col("id") % 5).cast("int")].alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"),
            )
            rows.select(*[F.col(f.name).cast(f.dataType) for f in table.schema]).coalesce(1).write.parquet(f"{path}/{FILES}")
        return R.file_stream(self.spark, f"{path}/*", table.schema, files_per_trigger=self._files(path))

    def _files(self, path: str) -> int:
        """Files of one part, so that a batch holds about one of them."""
        return max(1, len(self.spark.read.parquet(*[f"{path}/{i}" for i in range(FILES)]).inputFiles()) // FILES)

    def view(self, name: str) -> DataFrame:
        """One view that needs nothing but the events."""
        return self.spark.sql(_render(VIEWS[name], "spark"), events=self.base("events"))


def _streams(t: Tables, closed: bool = False) -> StreamTables:
    return StreamTables(t.spark, t.folder, closed)


def _real(df: DataFrame) -> DataFrame:
    return df.filter(F.col("id") < CLOSING)


@query("st01_ingest", "SELECT id, ts FROM calls WHERE ts > (SELECT max(ts) FROM calls) - 1209600000")
def _(t: Tables):
    last = t.calls.agg(F.max("ts")).collect()[0][0]
    return R.run_to_table(J.ingest(_streams(t).view("calls"), last), "ingest").select("id", "ts")


@query("st02_unique_labels", "SELECT id, ts FROM calls")
def _(t: Tables):
    calls = _streams(t).view("calls").select("id", "ts")
    twice = calls.withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_again")
    return R.run_to_table(J.unique_labels(twice), "unique").select("id", "ts")


_PASTGONE = "EXISTS (SELECT 1 FROM calls m WHERE m.number = c.number AND m.direction = 'INCOMING' AND m.state IN ('MISSED', 'REJECTED') AND m.ts < c.ts AND m.ts >= c.ts - 2592000000)"


@query("st03_immediate_labels", f"""SELECT id, CASE WHEN direction = 'OUTGOING' OR (state = 'ANSWERED' AND duration_ms >= 15000) THEN 'ALLOW' ELSE 'BLOCK' END AS label, direction = 'INCOMING' AND state = 'MISSED' AS deferred FROM calls c
    WHERE number IS NOT NULL AND (direction = 'INCOMING' OR {_PASTGONE})""")
def _(t: Tables):
    return _real(R.run_to_table(J.immediate_labels(_streams(t, True).view("calls")), "labels")).select("id", "label", "deferred")


@query("st04_deferred_labels", """SELECT m.id, m.ts + 86400000 AS due FROM calls m WHERE m.direction = 'INCOMING' AND m.state = 'MISSED' AND m.number IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM calls o WHERE o.number = m.number AND o.direction = 'OUTGOING' AND o.ts BETWEEN m.ts AND m.ts + 86400000)""")
def _(t: Tables):
    return _real(R.run_to_table(J.deferred_labels(_streams(t, True).view("calls")), "deferred")).select("id", "due")


def _past(days: int, test: str) -> str:
    return f"(SELECT count(*) FROM calls h WHERE h.number = c.number AND h.ts < c.ts AND h.ts >= c.ts - {days * 86400000} AND {test})"


_MISSED = "(SELECT max(h.ts) FROM calls h WHERE h.number = c.number AND h.ts < c.ts AND h.state = 'MISSED')"
_OUT = "(SELECT max(h.ts) FROM calls h WHERE h.number = c.number AND h.ts < c.ts AND h.direction = 'OUTGOING')"


@query("st05_lookback_features", f"""SELECT id, {_past(7, 'true')} AS calls_7d, {_past(30, "h.state = 'REJECTED'")} > 0 AS rejected_30d, CASE WHEN {_past(30, 'true')} > 0 THEN {_past(30, "h.state = 'ANSWERED'")} / {_past(30, 'true')} ELSE 0.0 END AS answer_rate_30d,
    coalesce({_MISSED} >= c.ts - 86400000 AND coalesce({_OUT}, -1) <= {_MISSED}, false) AS missed_no_callback FROM calls c WHERE number IS NOT NULL""", "calls_7d answer_rate_30d")
def _(t: Tables):
    out = R.run_to_table(J.lookback_features(_streams(t, True).view("calls")), "lookback")
    return _real(out).select("id", "calls_7d", "rejected_30d", "answer_rate_30d", "missed_no_callback")


def _used(categories: str) -> str:
    return f"EXISTS (SELECT 1 FROM usage u WHERE u.user = c.user AND u.category IN ({categories}) AND u.ts < c.ts AND u.ts >= c.ts - 1800000)"


def _noted(bucket: str) -> str:
    return f"(SELECT count(*) FROM usage u WHERE u.user = c.user AND u.bucket = '{bucket}' AND u.ts < c.ts AND u.ts >= c.ts - 600000)"


@query("st05_app_windows", f"""SELECT c.id, {_used("'BANK', 'INVESTMENTS'")} AS recent_bank_app, {_used("'GOVERNMENT'")} AS recent_gov_app, {_used("'MARKETPLACE', 'DELIVERY'")} AS recent_marketplace_app,
    {_used("'MESSENGER'")} AS recent_messenger_app, {_noted('BANK')} AS notif_bank, {_noted('MARKETPLACE')} AS notif_marketplace FROM calls c""")
def _(t: Tables):
    s = _streams(t, True)
    return _real(R.run_to_table(J.app_windows(s.view("calls"), s.view("usage"), s.view("usage")), "apps"))


_NEAR = "(w.sid IS NOT NULL AND abs(s.ts - w.sts) <= 600000)"


@query("st07_linked_calls", f"""WITH RECURSIVE l AS (SELECT number, id, ts, 0 AS k FROM snapshots UNION ALL SELECT number, id, ts, 1 FROM decisions WHERE verdict = 'BLOCK' UNION ALL SELECT number, id, ts, 2 FROM calls),
    s AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY ts, k, id) AS rn FROM l WHERE number IS NOT NULL),
    w AS (SELECT number, 0::BIGINT AS rn, -1::BIGINT AS id, 9 AS k, CAST(NULL AS BIGINT) AS sid, CAST(NULL AS BIGINT) AS sts, CAST(NULL AS BIGINT) AS bts, CAST(NULL AS BIGINT) AS link, false AS ours FROM (SELECT DISTINCT number FROM s) n UNION ALL
    SELECT s.number, s.rn, s.id, s.k, CASE WHEN s.k = 0 THEN s.id WHEN s.k = 2 AND {_NEAR} THEN NULL ELSE w.sid END, CASE WHEN s.k = 0 THEN s.ts WHEN s.k = 2 AND {_NEAR} THEN NULL ELSE w.sts END, CASE WHEN s.k = 1 THEN s.ts ELSE w.bts END,
    CASE WHEN s.k = 2 AND {_NEAR} THEN w.sid END, s.k = 2 AND {_NEAR} AND coalesce(w.bts >= s.ts - 600000, false) FROM w JOIN s ON s.number = w.number AND s.rn = w.rn + 1)
    SELECT id, link AS snapshot_id, ours AS blocked_by_us FROM w WHERE k = 2""")
def _(t: Tables):
    s = _streams(t, True)
    out = J.linked_calls(s.view("calls"), s.view("snapshots"), s.view("decisions"))
    return _real(R.run_to_table(out, "links"))


@query("st10_user_models", f"{SGD_SQL} SELECT user, id, rn AS steps, p AS p_before, b AS bias, w1 AS w_contact, w2 AS w_night, w3 AS w_rate, w4 AS w_hidden FROM w WHERE rn > 0", "p_before bias w_contact w_night w_rate w_hidden")
def _(t: Tables):
    class _Labelled:
        calls = _streams(t, True).view("calls")

    out = _real(R.run_to_table(J.user_models(labelled_calls(_Labelled())), "models"))
    at = {"w_contact": "is_contact", "w_night": "is_night_time", "w_rate": "answer_rate_for_number_norm", "w_hidden": "hidden_number"}
    return out.select("user", "id", "steps", "p_before", "bias", *[F.col("weights")[S.DEVICE_FEATURES.index(n)].alias(c) for c, n in at.items()])


#: The batch fit ends and the stream goes on here.
_HANDOVER = 1_705_300_000_000


@query("st10_models_from_batch", f"{SGD_SQL} SELECT w.user, w.id, w.rn AS steps, w.p AS p_before, w.b AS bias FROM w JOIN calls c USING (id) WHERE w.rn > 0 AND c.ts >= {_HANDOVER}", "p_before bias")
def _(t: Tables):
    class _Labelled:
        calls = _streams(t, True).view("calls").filter(F.col("ts") >= _HANDOVER)

    before = M.online_models(labelled_calls(t).filter(F.col("ts") < _HANDOVER)).withColumn("model_version", F.lit(0))
    out = R.run_to_table(J.user_models(labelled_calls(_Labelled()), before), "models-onward")
    return _real(out).select("user", "id", "steps", "p_before", "bias")


@query("st11_prefix_marks", """SELECT user, prefix, id, n AS marks FROM (SELECT user, substr(number, 1, 6) AS prefix, id,
    count(*) OVER (PARTITION BY user, substr(number, 1, 6) ORDER BY ts RANGE BETWEEN 2592000000 PRECEDING AND CURRENT ROW) AS n
    FROM decisions WHERE starts_with(number, '+7') AND user_action IN ('NOT_SPAM', 'UNBLOCK')) x WHERE n >= 5""")
def _(t: Tables):
    marks = _streams(t, True).view("decisions").filter(F.col("user_action").isin("NOT_SPAM", "UNBLOCK"))
    return _real(R.run_to_table(J.prefix_marks(marks), "marks")).select("user", "prefix", "id", "marks")


_TTL = "CASE w.src WHEN '2gis' THEN 30 WHEN 'negative' THEN 2 ELSE 7 END * 86400000::BIGINT"
_HIT = f"(w.stored IS NOT NULL AND s.ts - w.stored <= {_TTL})"


@query("st12_cached_lookups", f"""WITH RECURSIVE s AS (SELECT number, id, ts, CASE id % 3 WHEN 0 THEN '2gis' WHEN 1 THEN 'negative' ELSE 'offline' END AS source, row_number() OVER (PARTITION BY number ORDER BY ts, id) AS rn FROM decisions),
    w AS (SELECT number, 0::BIGINT AS rn, -1::BIGINT AS id, CAST(NULL AS VARCHAR) AS src, CAST(NULL AS BIGINT) AS stored, false AS hit FROM (SELECT DISTINCT number FROM s) n UNION ALL
    SELECT s.number, s.rn, s.id, CASE WHEN {_HIT} THEN w.src ELSE s.source END, CASE WHEN {_HIT} THEN w.stored ELSE s.ts END, {_HIT} FROM w JOIN s ON s.number = w.number AND s.rn = w.rn + 1)
    SELECT id, hit, src AS answered_by FROM w WHERE rn > 0""")
def _(t: Tables):
    k = F.col("id") % 3
    lookups = _streams(t, True).view("decisions").withColumn("source", F.when(k == 0, "2gis").when(k == 1, "negative").otherwise("offline"))
    return _real(R.run_to_table(J.cached_lookups(lookups), "cache"))


def _bounded(now: str, start: float, table: dict, low: float, high: float) -> str:
    """One threshold step: a new version starts afresh, marks count from the fifth on."""
    base = f"CASE WHEN s.v <> w.v THEN {start}::DOUBLE ELSE w.{now} END"
    step = "CASE s.action " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in table.items()) + " ELSE 0.0 END"
    return f"CASE WHEN s.rn >= 5 THEN least({high}, greatest({low}, {base} + {step})) ELSE {base} END"


@query("st13_user_thresholds", f"""WITH RECURSIVE s AS (SELECT user, id, user_action AS action, CASE WHEN ts > 1705000000000 THEN 1 ELSE 0 END AS v, row_number() OVER (PARTITION BY user ORDER BY ts, id) AS rn FROM decisions WHERE user_action IS NOT NULL),
    w AS (SELECT user, 0::BIGINT AS rn, -1::BIGINT AS id, 0 AS v, 0.35::DOUBLE AS warn, 0.70::DOUBLE AS block FROM (SELECT DISTINCT user FROM s) u UNION ALL
    SELECT s.user, s.rn, s.id, s.v, {_bounded('warn', 0.35, WARN_STEP, 0.15, 0.50)}, {_bounded('block', 0.70, BLOCK_STEP, 0.50, 0.85)} FROM w JOIN s ON s.user = w.user AND s.rn = w.rn + 1)
    SELECT user, id, warn AS warn_threshold, block AS block_threshold FROM w WHERE rn > 0""", "warn_threshold block_threshold")
def _(t: Tables):
    d = _streams(t, True).view("decisions").filter("user_action is not null")
    late = F.col("ts") > 1_705_000_000_000
    rows = d.select("user", "id", "ts", F.col("user_action").alias("action"), F.when(late, 1).otherwise(0).alias("model_version"))
    return _real(R.run_to_table(J.user_thresholds(rows), "thresholds"))


@query("st14_notification_ingest", """SELECT u.id, u.user, u.package, CASE a.category WHEN 'BANK' THEN 'BANK' WHEN 'INVESTMENTS' THEN 'BANK' WHEN 'MARKETPLACE' THEN 'MARKETPLACE' WHEN 'DELIVERY' THEN 'MARKETPLACE' ELSE 'OTHER' END AS bucket, u.ts FROM usage u LEFT JOIN known_apps a USING (package)""")
def _(t: Tables):
    return R.run_to_table(J.notification_ingest(_streams(t).view("usage"), t.known_apps), "notifications")


@query("ag42_daily_verdicts_stream", "SELECT (ts // 86400000) * 86400000 AS day_start, verdict, count(*) AS n FROM decisions WHERE (ts // 86400000 + 1) * 86400000 <= (SELECT max(ts) FROM decisions) - 86400000 GROUP BY ALL", ints="day_start")
def _(t: Tables):
    return R.run_to_table(J.daily_verdicts(_streams(t).view("decisions")), "daily")
