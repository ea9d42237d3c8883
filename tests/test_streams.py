"""Streams over several micro-batches, with files in any order, against the batch operators."""

import collections
import time

import pytest
from pyspark.sql import functions as F

from ringsift.operators import events as E
from ringsift.plans import model as M
from ringsift.queries.bindings import Tables
from ringsift.queries.events import labelled_calls
from ringsift.session import scratch_path
from ringsift.streaming import jobs as J
from ringsift.streaming import run as R

FOLDER = "/root/testdata/sf0.001"
#: Rows that move the watermark past all others; they are left out of what is compared.
CLOSING = 1 << 40


def _closing(spark, table):
    last = table.agg(F.max("ts")).first()[0] + 100 * E.DAY_MS
    kinds = [("INCOMING", "MISSED"), ("OUTGOING", "ANSWERED")]
    rows = [(CLOSING + 2 * i + j, i % 15, f"+7900000{i:04d}", d, s, 0, last) for i in range(20) for j, (d, s) in enumerate(kinds)]
    return spark.createDataFrame(rows, "id bigint, user bigint, number string, direction string, state string, duration_ms bigint, ts bigint")


def _stream(spark, table, folder, part, parts, closed=True):
    """The table as one file per part, and a last file that closes the stream."""
    for i in range(parts):
        table.filter(part == i).coalesce(1).write.mode("append").parquet(folder)
    if closed:
        _closing(spark, table).select(*table.columns).coalesce(1).write.mode("append").parquet(folder)
    return R.file_stream(spark, folder, table.schema, files_per_trigger=1)


@pytest.fixture(scope="module")
def table(spark):
    return Tables(spark, FOLDER).calls.persist()


@pytest.fixture(scope="module")
def shuffled(spark, table, tmp_path_factory):
    """Every file holds calls of the whole month, in no order."""
    return _stream(spark, table, str(tmp_path_factory.mktemp("calls") / "shuffled"), F.pmod(F.xxhash64("id"), F.lit(4)), 4)


@pytest.fixture(scope="module")
def late(spark, table, tmp_path_factory):
    """Files follow one another, but calls come up to twelve hours late."""
    first, last = table.agg(F.min("ts"), F.max("ts")).first()
    at = F.col("ts") + F.pmod(F.xxhash64("id"), F.lit(12 * E.HOUR_MS)) - first
    part = F.least(F.floor(at * 5 / (last - first + 12 * E.HOUR_MS)), F.lit(4))
    return _stream(spark, table, str(tmp_path_factory.mktemp("calls") / "late"), part, 5)


def _real(df):
    return df.filter(F.col("id") < CLOSING)


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_ingest_reads_every_event_once(spark, table, shuffled):
    out = R.run_to_table(J.ingest(shuffled, 0, delay="90 days"), "ingest")
    assert _rows(_real(out), "id") == _rows(table, "id")


@pytest.mark.parametrize("order, delay", [("shuffled", "90 days"), ("late", "1 day")])
def test_lookbacks_equal_the_batch(table, order, delay, request):
    out = R.run_to_table(J.lookback_features(request.getfixturevalue(order), delay=delay), "lookback")
    known = table.filter("number is not null")
    freq = {r["id"]: r["number_calls"] for r in E.call_frequency(known).collect()}
    rate = {r["id"]: round(r["answer_rate"], 9) for r in E.answer_rate(known).collect()}
    miss = {r["id"]: r["missed_no_callback"] for r in E.missed_without_callback(known).collect()}
    lost = {r["id"]: r["previously_rejected"] for r in E.previously(known, F.col("state") == "REJECTED").collect()}
    got = _real(out).collect()
    assert len(got) == len(freq)
    for r in got:
        want = freq[r["id"]], rate[r["id"]], miss[r["id"]], lost[r["id"]]
        assert (r["calls_7d"], round(r["answer_rate_30d"], 9), r["missed_no_callback"], r["rejected_30d"]) == want


def test_state_of_a_flooded_number_is_cells(spark, table, tmp_path):
    """One number with thousands of calls: its sums are one row per cell, and idle numbers give theirs back."""
    span = 40 * E.DAY_MS
    flood = spark.range(6000).select(
        "id", F.lit(1).cast("bigint").alias("user"), F.lit("+79001111111").alias("number"), F.lit("INCOMING").alias("direction"), F.lit("ANSWERED").alias("state"),
        F.lit(20_000).cast("bigint").alias("duration_ms"), (F.col("id") * (span // 6000) + 400 * E.DAY_MS).alias("ts"))
    stream = _stream(spark, flood, str(tmp_path / "flood"), F.floor(F.col("id") / 2000), 3, closed=False)
    base = scratch_path(spark, "flooded")
    out = R.run_to_table(J.lookback_features(stream, delay="1 hour"), "lookback", base=base, partitions=2)
    got = {r["id"]: r["calls_7d"] for r in out.collect()}
    week = 7 * E.DAY_MS // (span // 6000)
    assert len(got) > 5900 and all(v == min(i, week) for i, v in got.items())
    starts = spark.read.format("statestore").option("path", f"{base}/checkpoint").option("stateVarName", "starts").load()
    assert 30 <= starts.count() <= 32
    _closing(spark, flood).select(*flood.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "flood"))
    R.run_to_table(J.lookback_features(stream, delay="1 hour"), "lookback", base=base, partitions=2)
    left = spark.read.format("statestore").option("path", f"{base}/checkpoint").option("stateVarName", "starts").load()
    assert left.filter("key.number = '+79001111111'").count() == 0


def _in_order(table):
    calls = collections.defaultdict(list)
    for r in sorted(table.filter("number is not null").collect(), key=lambda r: (r.ts, r.id)):
        calls[r.number].append(r)
    return calls


@pytest.mark.parametrize("order, delay", [("shuffled", "90 days"), ("late", "1 day")])
def test_immediate_labels_follow_event_time(table, order, delay, request):
    want = []
    for calls in _in_order(table).values():
        for c in calls:
            gone = [x.ts for x in calls if x.ts < c.ts and x.direction == "INCOMING" and x.state in ("MISSED", "REJECTED")]
            if c.direction == "OUTGOING":
                label = "ALLOW" if gone and max(gone) >= c.ts - 30 * E.DAY_MS else None
            else:
                label = "ALLOW" if c.state == "ANSWERED" and c.duration_ms >= 15_000 else "BLOCK"
            if label:
                want.append((c.id, c.user, c.number, c.ts, label, c.direction == "INCOMING" and c.state == "MISSED"))
    out = R.run_to_table(J.immediate_labels(request.getfixturevalue(order), delay=delay), "labels")
    assert _rows(_real(out), "id", "user", "number", "ts", "label", "deferred") == sorted(want)


def test_links_follow_event_time(spark, table, tmp_path):
    """Snapshots, blocks and calls in shuffled files."""
    line = table.filter("number is not null")
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    stream = _stream(spark, line, str(tmp_path / "line"), part, 3)
    snap = lambda df: df.filter("id % 3 = 0").withColumn("ts", F.col("ts") - 60_000 * (F.col("id") % 13))
    block = lambda df: df.filter("id % 2 = 0").withColumn("ts", F.col("ts") - 45_000).withColumn("verdict", F.lit("BLOCK"))
    out = R.run_to_table(J.linked_calls(stream, snap(stream), block(stream), delay="90 days"), "links")
    rows = [(r.number, r.ts, k, r.id) for k, df in enumerate((snap(line), block(line), line)) for r in df.collect()]
    want, state = [], {}
    for number, ts, k, i in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        snapshot, blocked = state.get(number, (None, None))
        if k == 0:
            snapshot = (i, ts)
        elif k == 1:
            blocked = ts
        else:
            near = snapshot is not None and ts - snapshot[1] <= 600_000
            want.append((i, snapshot[0] if near else -1, bool(near and blocked is not None and blocked >= ts - 600_000)))
            snapshot = None if near else snapshot
        state[number] = snapshot, blocked
    got = _real(out).select("id", F.coalesce("snapshot_id", F.lit(-1)).alias("s"), "blocked_by_us")
    assert _rows(got, "id", "s", "blocked_by_us") == sorted(want) and any(w[1] >= 0 for w in want)


def test_app_windows_equal_the_batch(spark, table, tmp_path):
    t = Tables(spark, FOLDER)
    usage = t.usage.persist()
    calls = _stream(spark, table, str(tmp_path / "calls"), F.pmod(F.xxhash64("id"), F.lit(2)), 2)
    extra = _closing(spark, table).select("id", "user", "ts", F.lit("x").alias("package"), F.lit("GAMES").alias("category"), F.lit("OTHER").alias("bucket"))
    for i in range(2):
        usage.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "usage"))
    extra.select(*usage.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "usage"))
    used = R.file_stream(spark, str(tmp_path / "usage"), usage.schema, files_per_trigger=1)
    out = _real(R.run_to_table(J.app_windows(calls, used, used, delay="90 days"), "apps"))
    apps = _rows(E.recent_apps(table, usage), "id", *E.USAGE_GROUPS)
    notes = _rows(E.recent_notifications(table, usage), "id", "notif_bank", "notif_marketplace")
    assert _rows(out, "id", *E.USAGE_GROUPS) == apps
    assert _rows(out, "id", "notif_bank", "notif_marketplace") == notes


@pytest.mark.parametrize("order, delay", [("shuffled", "90 days"), ("late", "1 day")])
def test_deferred_labels_are_those_of_the_batch(table, order, delay, request):
    out = R.run_to_table(J.deferred_labels(request.getfixturevalue(order), delay=delay), "deferred")
    want = E.deferred_labels(table)
    assert _rows(_real(out), "id", "user", "number", "due") == _rows(want, "id", "user", "number", "due")


def test_deferred_labels_are_an_outer_join_of_streams(shuffled):
    plan = J.deferred_labels(shuffled)._jdf.queryExecution().analyzed().toString()
    assert "LeftOuter" in plan and "TransformWithState" not in plan


def _labels(calls):
    class _T:
        pass

    t = _T()
    t.calls = calls
    return labelled_calls(t)


def _last(out):
    return {r["user"]: (r["steps"], r["bias"], r["weights"]) for r in _real(out).groupBy("user").agg(
        F.max("steps").alias("steps"), F.max_by("bias", "steps").alias("bias"), F.max_by("weights", "steps").alias("weights")).collect()}


def _same_models(got, want):
    assert got.keys() == want.keys()
    for user, (steps, bias, weights) in want.items():
        assert got[user][0] == steps and got[user][1] == pytest.approx(bias) and got[user][2] == pytest.approx(weights)


def test_user_models_equal_the_batch_fold(table, late):
    want = {r["user"]: (r["steps"], r["bias"], r["weights"]) for r in M.online_models(_labels(table)).collect()}
    _same_models(_last(R.run_to_table(J.user_models(_labels(late)), "models")), want)


def test_user_models_go_on_from_a_batch_fit(spark, table, tmp_path):
    want = {r["user"]: (r["steps"], r["bias"], r["weights"]) for r in M.online_models(_labels(table)).collect()}
    middle = table.agg(F.percentile_approx("ts", 0.5)).first()[0]
    fit = M.online_models(_labels(table.filter(F.col("ts") < middle))).withColumn("model_version", F.lit(0))
    rest = table.filter(F.col("ts") >= middle)
    stream = _stream(spark, rest, str(tmp_path / "rest"), F.pmod(F.xxhash64("id"), F.lit(3)), 3)
    got = _last(R.run_to_table(J.user_models(_labels(stream), fit, delay="90 days"), "models"))
    _same_models(got, {u: w for u, w in want.items() if u in got})
    assert len(got) >= 10
    # Another model version starts from the defaults whatever was handed over.
    old = fit.withColumn("model_version", F.lit(7))
    again = _last(R.run_to_table(J.user_models(_labels(stream), old, delay="90 days"), "models"))
    _same_models(again, {r["user"]: (r["steps"], r["bias"], r["weights"]) for r in M.online_models(_labels(rest)).collect()})


def _feedback(calls):
    actions = F.array(*[F.lit(a) for a in ("UNBLOCK", "MARK_SPAM", "NOT_SPAM", "IS_SCAM")])
    return calls.select("user", "id", "ts", actions[(F.col("id") % 4).cast("int")].alias("action"), F.lit(0).alias("model_version"))


def test_thresholds_go_on_from_a_table(spark, table, late, tmp_path):
    whole = {r["id"]: (r["warn_threshold"], r["block_threshold"]) for r in _real(R.run_to_table(J.user_thresholds(_feedback(late)), "thresholds")).collect()}
    middle = table.agg(F.percentile_approx("ts", 0.5)).first()[0]
    before = _feedback(table.filter(F.col("ts") < middle))
    last = before.groupBy("user").agg(F.max_by("id", F.struct("ts", "id")).alias("id"), F.count(F.lit(1)).alias("feedback")).collect()
    start = spark.createDataFrame([(r.user, 0, r.feedback, *whole[r.id]) for r in last], "user bigint, model_version int, feedback bigint, warn_threshold double, block_threshold double")
    stream = _stream(spark, table.filter(F.col("ts") >= middle), str(tmp_path / "rest"), F.pmod(F.xxhash64("id"), F.lit(2)), 2)
    out = _real(R.run_to_table(J.user_thresholds(_feedback(stream), start, delay="90 days"), "thresholds")).collect()
    assert len(out) > 100
    for r in out:
        assert (r["warn_threshold"], r["block_threshold"]) == pytest.approx(whole[r["id"]])


def test_marks_are_not_capped_by_default(spark, tmp_path):
    marks = spark.range(120).select(F.lit(1).cast("bigint").alias("user"), F.lit("+79160000000").alias("number"), "id", (F.col("id") * 1000 + 400 * E.DAY_MS).alias("ts"))
    marks.coalesce(1).write.parquet(str(tmp_path / "m"))
    marks.select("user", "number", (F.col("id") + CLOSING).alias("id"), (F.col("ts") + 200 * E.DAY_MS).alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    stream = R.file_stream(spark, str(tmp_path / "m"), marks.schema, files_per_trigger=1)
    assert max(r["marks"] for r in _real(R.run_to_table(J.prefix_marks(stream), "marks")).collect()) == 120
    assert max(r["marks"] for r in _real(R.run_to_table(J.prefix_marks(stream, keep=J.MARKS_KEPT), "marks")).collect()) == 50


def test_idle_answers_leave_the_state(spark, tmp_path):
    """Answers live by the clock; the state store drops them when their time is over."""
    folder, base = str(tmp_path / "asked"), scratch_path(spark, "live")
    schema = "number string, id bigint, ts bigint, source string"

    def ask(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = R.file_stream(spark, folder, spark.createDataFrame([], schema).schema)
        out = R.run_to_table(J.live_lookups(stream, {"slow": 3_600_000}, 4_000), "live", base=base, partitions=2, idle_batches=False, timeout=60)
        return {r["id"]: (r["hit"], r["answered_by"]) for r in out.collect()}

    def held():
        found = set()
        for ms in (4_000, 3_600_000):
            state = spark.read.format("statestore").option("path", f"{base}/checkpoint").option("stateVarName", f"answer_{ms}").load()
            found |= {r[0] for r in state.select("key.number").collect()}
        return found

    first = ask(("a", 1, 1, "fast"), ("a", 2, 2, "other"), ("b", 3, 3, "slow"))
    assert first == {1: (False, "fast"), 2: (True, "fast"), 3: (False, "slow")}
    time.sleep(5)
    second = ask(("c", 4, 4, "slow"))
    assert second[4] == (False, "slow") and held() == {"b", "c"}
    third = ask(("a", 5, 5, "other"), ("b", 6, 6, "other"))
    assert third[5] == (False, "other") and third[6] == (True, "slow")
