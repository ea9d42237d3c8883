"""Streaming jobs. Each one equals a batch operator when the same events are replayed.

Jobs whose result depends on the order of events let the rows of a key wait until the watermark has
passed them and then handle them by event time, so files and batches may come in any order that the
watermark's delay allows. Keys that stay idle beyond their look-back give their state back.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schema as S
from ..functions import text as T
from ..operators.timeline import DAY_MS, HOUR_MS
from ..plans.model import EXPLICIT_WEIGHT, IMPLICIT_WEIGHT, initial_weights, sgd_step
from .run import with_event_time

MINUTE_MS = 60_000


#: Cells of event time that rows wait in, rows that are put aside or handled at a time, and rows up to which one part
#: may reach into later cells, so that a quiet key has few parts.
CELL_MS, BLOCK_ROWS, PART_ROWS = 6 * HOUR_MS, 1 << 15, 1 << 10

_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "array<double>": pa.list_(pa.float64()),
}


class _InOrder(StatefulProcessor):
    """Rows of a key wait in parts until the watermark has passed them; then ``step`` gets them by event time.

    A part is one value of the state: the packed rows that came together and begin in one time cell. What is due
    is read cell by cell and given to ``step`` in blocks that follow one another, so a task holds a block and a cell
    of one key, however many rows wait. A key has one timer per batch, at its earliest waiting row. ``rows`` names
    the columns that wait (ts first), ``order`` how they are sorted, ``kept`` the schema of the key's value. A key
    without a row for ``horizon`` milliseconds of event time forgets everything.
    """

    rows = ""
    order = ["ts", "id"]
    kept = ""
    horizon: int | None = None
    output: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.schema = pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in self.rows.split(","))])
        self.waiting = handle.getMapState("waiting", "cell bigint, part bigint", "rows binary")
        self.parts = handle.getValueState("parts", "n bigint")
        self.value = handle.getValueState("value", self.kept)
        self.seen = handle.getValueState("seen", "ts bigint")

    def load(self, empty: tuple) -> tuple:
        return tuple(self.value.get()) if self.value.exists() else empty

    def put_aside(self, table: pa.Table) -> None:
        """Pack rows into parts. Every row of a part lies in the cell the part is filed under, or behind it."""
        cell = table["ts"].to_numpy() // CELL_MS
        order = np.argsort(cell, kind="stable")
        table, cell = table.take(order).combine_chunks(), cell[order]
        n = self.parts.get()[0] if self.parts.exists() else 0
        at = 0
        while at < len(cell):
            to = max(int(np.searchsorted(cell, cell[at], side="right")), min(at + PART_ROWS, len(cell)))
            packed = table.slice(at, to - at).to_batches()[0].serialize().to_pybytes()
            self.waiting.updateValue((int(cell[at]), n), (packed,))
            at, n = to, n + 1
        self.parts.update((n,))

    def take_back(self, part: tuple) -> pa.Table:
        (packed,) = self.waiting.getValue(part)
        self.waiting.removeKey(part)
        return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(packed), self.schema)])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, came, n = None, [], 0
        for pdf in rows:
            if len(pdf):
                came.append(pa.Table.from_arrays([pa.array(pdf[f.name], type=f.type, from_pandas=True) for f in self.schema], schema=self.schema))
                n += len(pdf)
                first = int(pdf["ts"].min()) if first is None else min(first, int(pdf["ts"].min()))
            if n >= BLOCK_ROWS:
                self.put_aside(pa.concat_tables(came))
                came, n = [], 0
        if came:
            self.put_aside(pa.concat_tables(came))
        if first is not None:
            self.handle.registerTimer(first + 1)
        return iter(())

    def due(self, passed: int) -> Iterator[pa.Table]:
        """Rows before the watermark, in blocks that follow one another; what is read too early is put aside again."""
        parts = sorted((tuple(k) for k in self.waiting.keys()), reverse=True) if self.waiting.exists() else []
        held = self.schema.empty_table()
        ready = lambda: bool(parts) and parts[-1][0] * CELL_MS < passed
        while ready():
            read = [held]
            while ready() and (len(read) == 1 or sum(t.num_rows for t in read) < BLOCK_ROWS):
                cell = parts[-1][0]
                while parts and parts[-1][0] == cell:
                    read.append(self.take_back(parts.pop()))
            # Nothing that is still unread comes before its cell.
            end = parts[-1][0] * CELL_MS if ready() else passed
            table = pa.concat_tables(read)
            early = pc.less(table["ts"], end)
            held = table.filter(pc.invert(early))
            yield table.filter(early)
        wake = [parts[-1][0] * CELL_MS] if parts else []
        if held.num_rows:
            self.put_aside(held)
            wake.append(pc.min(held["ts"]).as_py())
        if wake:
            self.handle.registerTimer(min(wake) + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        last = None
        for table in self.due(passed):
            if table.num_rows:
                frame = table.to_pandas().sort_values(self.order, kind="stable", ignore_index=True)
                last = int(frame["ts"].iloc[-1])
                yield self.step(key, frame)
        if last is not None:
            self.seen.update((last,))
            if self.horizon is not None:
                self.handle.registerTimer(last + self.horizon + 1)
        elif self.horizon is not None and not self.waiting.exists() and self.seen.exists() and self.seen.get()[0] + self.horizon < passed:
            self.forget()

    def step(self, key: Any, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def forget(self) -> None:
        self.value.clear()
        self.seen.clear()
        self.parts.clear()

    def close(self) -> None:
        pass


def _ordered(rows: DataFrame, keys: list[str], processor: StatefulProcessor, output: str, delay: str, initial: DataFrame | None = None) -> DataFrame:
    """Run an ordered processor over a stream that has ``ts``."""
    timed = with_event_time(rows, delay=delay)
    start = None if initial is None else initial.groupBy(*keys)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, output, "Append", "EventTime", initialState=start)


def _before(ts: np.ndarray, marked: np.ndarray, known: int | None) -> np.ndarray:
    """The latest marked time before each time (strictly), -1 if none; ``known`` is the latest before all of them."""
    first = -1 if known is None else known
    running = np.concatenate([[first], np.maximum.accumulate(np.maximum(np.where(marked, ts, -1), first))])
    return running[np.searchsorted(ts, ts, side="left")]


# --- ingest -----------------------------------------------------------------


def ingest(calls: DataFrame, first_run_ms: int, days: int = 14, delay: str = "1 day") -> DataFrame:
    """New call events, each id once. The first run looks back fourteen days; what the checkpoint
    has seen is never read again."""
    recent = calls.filter(F.col("ts") > first_run_ms - days * DAY_MS)
    return with_event_time(recent, delay=delay).dropDuplicatesWithinWatermark(["id"])


def unique_labels(labels: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Every label id once within the delay."""
    return with_event_time(labels, delay=delay).dropDuplicatesWithinWatermark(["id"])


def notification_ingest(raw: DataFrame, known: DataFrame) -> DataFrame:
    """Only user, package, bucket and time of a notification are kept."""
    category = F.coalesce(F.col("_c"), F.lit("OTHER"))
    table = known.select("package", F.col("category").alias("_c"))
    found = raw.select("id", "user", "package", "ts").join(table, "package", "left")
    return found.select("id", "user", "package", T.app_bucket(category).alias("bucket"), "ts")


def daily_verdicts(records: DataFrame, delay: str = "1 day") -> DataFrame:
    """Calls by verdict and day."""
    return (
        with_event_time(records, delay=delay)
        .groupBy(F.window("event_time", "1 day").alias("w"), "verdict")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unix_millis("w.start").alias("day_start"), "verdict", "n")
    )


# --- labels -----------------------------------------------------------------


class _ImmediateLabels(_InOrder):
    rows = "ts bigint, id bigint, user bigint, direction string, state string, duration_ms bigint"
    kept = "gone bigint"

    def __init__(self, window_ms: int):
        self.horizon = window_ms

    def step(self, key: Any, rows: pd.DataFrame) -> pd.DataFrame:
        (known,) = self.load((None,))
        ts, state = rows["ts"].to_numpy(), rows["state"].to_numpy()
        out = (rows["direction"] == "OUTGOING").to_numpy()
        missed = ~out & (state == "MISSED")
        gone = missed | (~out & (state == "REJECTED"))
        last = _before(ts, gone, known)
        answered = ~out & (state == "ANSWERED")
        long = (rows["duration_ms"] >= 15_000).to_numpy()
        allow = (out & (last >= 0) & (last >= ts - self.horizon)) | (answered & long)
        block = (answered & ~long) | gone
        if gone.any():
            self.value.update((int(ts[gone].max()),))
        found = rows[["id", "user", "ts"]].assign(number=key[0], label=np.where(allow, "ALLOW", "BLOCK"), deferred=missed)
        return found[allow | block][["id", "user", "number", "ts", "label", "deferred"]]


LABEL_SCHEMA = "id bigint, user bigint, number string, ts bigint, label string, deferred boolean"


def immediate_labels(calls: DataFrame, days: int = 30, delay: str = "1 day") -> DataFrame:
    """Implicit labels; an outgoing call is ALLOW after an earlier missed or rejected one."""
    known = calls.filter(F.col("number").isNotNull())
    return _ordered(known, ["number"], _ImmediateLabels(days * DAY_MS), LABEL_SCHEMA, delay)


def deferred_labels(calls: DataFrame, hours: int = 24, delay: str = "1 day") -> DataFrame:
    """BLOCK for a missed call once the window behind it has passed without a call back.

    Calls back are folded to the first and the last of a number and time cell, a quarter of the window long: a
    missed call is answered if a cell's last call is not before it and the cell's first not behind its window, so it
    meets five cells at most, however many calls a number has. What the watermark passes without a partner comes out
    of the outer join with nulls.
    """
    cell_ms = hours * HOUR_MS // 4
    timed = with_event_time(calls.filter(F.col("number").isNotNull()), delay=delay)
    missed = timed.filter((F.col("direction") == "INCOMING") & (F.col("state") == "MISSED"))
    missed = missed.select("id", "user", "number", "ts", F.col("event_time").alias("missed_at"), F.floor(F.col("ts") / cell_ms).alias("cell"))
    cells = timed.filter(F.col("direction") == "OUTGOING").groupBy("number", F.window("event_time", f"{cell_ms} milliseconds").alias("w")).agg(
        F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    own = F.floor(F.unix_millis("w.start") / cell_ms)
    # A cell answers calls of its own time and of the four cells before.
    back = cells.select(F.col("number").alias("_number"), "_first", "_last", F.window_time("w").alias("_back_at"), F.explode(F.sequence(own - 4, own)).alias("_cell"))
    near = (f"number = _number AND cell = _cell AND _last >= ts AND _first <= ts + {hours * HOUR_MS} "
            f"AND _back_at >= missed_at AND _back_at <= missed_at + INTERVAL {5 * cell_ms} MILLISECONDS")
    alone = missed.join(back, F.expr(near), "left_outer").filter(F.col("_number").isNull())
    return alone.select("id", "user", "number", "ts", F.lit("BLOCK").alias("label"), (F.col("ts") + hours * HOUR_MS).alias("due"))


def own_block_labels(decisions: DataFrame) -> DataFrame:
    """A BLOCK label for every call we blocked with a snapshot at hand."""
    from ..operators.events import own_block_labels as rule

    return rule(decisions)


# --- look-backs -------------------------------------------------------------


class _Lookback(_InOrder):
    """Counts of a number's events up to each time cell, and the events of a cell by cell.

    A look-back is a difference of two running counts. Only the cells at its edges are read; a cell
    goes once the longest look-back has passed it.
    """

    rows = "ts bigint, id bigint, state string, direction string"
    kept = "n bigint, answered bigint, rejected bigint, missed_at bigint, out_at bigint"
    DAYS = 30

    def __init__(self, cell_ms: int):
        self.cell_ms = cell_ms
        self.horizon = self.DAYS * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.starts = handle.getMapState("starts", "cell bigint", "n bigint, answered bigint, rejected bigint")
        self.events = handle.getMapState("events", "cell bigint", "ts array<bigint>, state array<int>")

    def forget(self) -> None:
        super().forget()
        self.starts.clear()
        self.events.clear()

    def step(self, key: Any, rows: pd.DataFrame) -> pd.DataFrame:
        n, answered, rejected, missed_at, out_at = self.load((0, 0, 0, None, None))
        ts = rows["ts"].to_numpy(dtype=np.int64)
        state = rows["state"].map({"ANSWERED": 1, "REJECTED": 2, "MISSED": 3}).fillna(0).to_numpy(dtype=np.int32)
        out = (rows["direction"] == "OUTGOING").to_numpy()
        missed, called = _before(ts, state == 3, missed_at), _before(ts, out, out_at)

        starts = {k[0]: tuple(v) for k, v in self.starts.iterator()} if self.starts.exists() else {}
        cell = ts // self.cell_ms
        total = np.array([n, answered, rejected], dtype=np.int64)
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for c in np.unique(cell).tolist():
            at = slice(*np.searchsorted(cell, [c, c + 1]))
            if c not in starts:
                starts[c] = tuple(total.tolist())
                self.starts.updateValue((c,), starts[c])
                old: tuple = ([], [])
            else:
                old = tuple(self.events.getValue((c,)))
            held[c] = np.concatenate([np.array(old[0], dtype=np.int64), ts[at]]), np.concatenate([np.array(old[1], dtype=np.int32), state[at]])
            self.events.updateValue((c,), (held[c][0].tolist(), held[c][1].tolist()))
            total += [at.stop - at.start, int((state[at] == 1).sum()), int((state[at] == 2).sum())]
        cells = sorted(starts)

        def upto(x: np.ndarray) -> np.ndarray:
            """n, answered and rejected before each time."""
            asked, counts = x // self.cell_ms, np.empty((len(x), 3), dtype=np.int64)
            for c in np.unique(asked).tolist():
                at = slice(*np.searchsorted(asked, [c, c + 1]))
                if c in starts:
                    if c not in held:
                        held[c] = tuple(np.array(v) for v in self.events.getValue((c,)))
                    times, states = held[c]
                    k = np.searchsorted(times, x[at], side="left")
                    inside = np.stack([np.arange(len(times) + 1), *[np.concatenate([[0], np.cumsum(states == s)]) for s in (1, 2)]], axis=1)
                    counts[at] = inside[k] + np.array(starts[c])
                else:
                    later = bisect.bisect(cells, c)
                    counts[at] = starts[cells[later]] if later < len(cells) else total
            return counts

        here = upto(ts)
        week, month = here - upto(ts - 7 * DAY_MS), here - upto(ts - self.DAYS * DAY_MS)
        oldest = (int(ts[-1]) - self.DAYS * DAY_MS) // self.cell_ms
        for c in cells:
            if c < oldest:
                self.starts.removeKey((c,))
                self.events.removeKey((c,))
        last = lambda mask, known: int(ts[mask].max()) if mask.any() else known
        self.value.update((*total.tolist(), last(state == 3, missed_at), last(out, out_at)))
        return pd.DataFrame({
            "id": rows["id"],
            "calls_7d": week[:, 0].astype(float),
            "rejected_30d": month[:, 2] > 0,
            "answer_rate_30d": month[:, 1] / np.maximum(month[:, 0], 1),
            "missed_no_callback": (missed >= 0) & (missed >= ts - DAY_MS) & (called <= missed),
        })


def lookback_features(calls: DataFrame, delay: str = "1 day", cell_ms: int = DAY_MS) -> DataFrame:
    """Four look-back features of every call, from running counts per number and time cell."""
    known = calls.filter(F.col("number").isNotNull())
    output = "id bigint, calls_7d double, rejected_30d boolean, answer_rate_30d double, missed_no_callback boolean"
    return _ordered(known, ["number"], _Lookback(cell_ms), output, delay)


class _AppWindows(_InOrder):
    """Latest use per group of apps, and the notifications of a user within their window."""

    rows = "ts bigint, id bigint, what string, category string"
    kept = "used array<bigint>, bank array<bigint>, marketplace array<bigint>"

    def __init__(self, groups: dict[str, list[str]], buckets: tuple[str, ...], used_ms: int, notified_ms: int):
        self.groups, self.buckets = groups, buckets
        self.used_ms, self.notified_ms = used_ms, notified_ms
        self.horizon = max(used_ms, notified_ms)

    def step(self, key: Any, rows: pd.DataFrame) -> pd.DataFrame:
        used, *noted = self.load(([-1] * len(self.groups), *[[] for _ in self.buckets]))
        ts, what, category = rows["ts"].to_numpy(), rows["what"].to_numpy(), rows["category"]
        call = what == "call"
        asked = ts[call]
        found = {"id": rows["id"].to_numpy()[call]}
        newest = []
        for (name, apps), known in zip(self.groups.items(), used):
            mark = (what == "usage") & category.isin(apps).to_numpy()
            last = _before(ts, mark, known)[call]
            found[name] = (last >= 0) & (last >= asked - self.used_ms)
            newest.append(int(max(known, ts[mark].max())) if mark.any() else known)
        kept = []
        for bucket, known in zip(self.buckets, noted):
            times = np.concatenate([np.array(known, dtype=np.int64), ts[(what == "notification") & (category == bucket).to_numpy()]])
            found[f"notif_{bucket.lower()}"] = np.searchsorted(times, asked, side="left") - np.searchsorted(times, asked - self.notified_ms, side="left")
            kept.append(times[times >= ts[-1] - self.notified_ms].tolist())
        self.value.update((newest, *kept))
        return pd.DataFrame(found)


def app_windows(calls: DataFrame, usage: DataFrame, notifications: DataFrame, minutes: int = 30, notified_minutes: int = 10,
                delay: str = "1 day") -> DataFrame:
    """For every call: which groups of apps its user had open, and how many notifications came, shortly before."""
    from ..operators.events import USAGE_GROUPS

    def part(df: DataFrame, what: str, category: Column) -> DataFrame:
        return df.select("user", "id", "ts", F.lit(what).alias("what"), category.alias("category"))

    line = part(calls, "call", F.lit("")).unionByName(part(usage, "usage", F.col("category"))).unionByName(
        part(notifications, "notification", F.col("bucket")))
    flags = ", ".join(f"{n} boolean" for n in USAGE_GROUPS)
    processor = _AppWindows(USAGE_GROUPS, ("BANK", "MARKETPLACE"), minutes * MINUTE_MS, notified_minutes * MINUTE_MS)
    return _ordered(line, ["user"], processor, f"id bigint, {flags}, notif_bank bigint, notif_marketplace bigint", delay)


class _Links(_InOrder):
    """Latest unlinked snapshot and latest BLOCK record of a number."""

    rows = "ts bigint, id bigint, what string, rank int"
    order = ["ts", "rank", "id"]
    kept = "snapshot_id bigint, snapshot_ts bigint, block_ts bigint"

    def __init__(self, window_ms: int):
        self.horizon = window_ms

    def step(self, key: Any, rows: pd.DataFrame) -> pd.DataFrame:
        snap, snap_ts, block = self.load((None, None, None))
        out = []
        for i, ts, what in zip(rows["id"].tolist(), rows["ts"].tolist(), rows["what"].tolist()):
            if what == "snapshot":
                snap, snap_ts = i, ts
            elif what == "block":
                block = ts
            else:
                near = snap is not None and ts - snap_ts <= self.horizon
                out.append((i, snap if near else None, near and block is not None and block >= ts - self.horizon))
                if near:
                    snap, snap_ts = None, None
        self.value.update((snap, snap_ts, block))
        frame = pd.DataFrame(out, columns=["id", "snapshot_id", "blocked_by_us"])
        return frame.astype({"snapshot_id": "Int64", "id": "int64", "blocked_by_us": "bool"})


def linked_calls(calls: DataFrame, snapshots: DataFrame, records: DataFrame, minutes: int = 10, delay: str = "1 day") -> DataFrame:
    """Calls with the snapshot they belong to, and whether we blocked them ourselves."""
    def part(df: DataFrame, what: str, rank: int) -> DataFrame:
        return df.select("number", "id", "ts", F.lit(what).alias("what"), F.lit(rank).alias("rank"))

    line = part(snapshots, "snapshot", 0).unionByName(
        part(records.filter(F.col("verdict") == "BLOCK"), "block", 1)).unionByName(part(calls, "call", 2))
    known = line.filter(F.col("number").isNotNull())
    return _ordered(known, ["number"], _Links(minutes * MINUTE_MS), "id bigint, snapshot_id bigint, blocked_by_us boolean", delay)


# --- per-user state ---------------------------------------------------------


class _UserModel(_InOrder):
    """A user's weights; gradient steps follow one another, so they are taken one by one in event order."""

    rows = "ts bigint, id bigint, label string, explicit boolean, model_version int, x array<double>"
    kept = "version int, steps bigint, bias double, weights array<double>"

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        first = initialState.iloc[0]
        self.value.update((int(first["model_version"]), int(first["steps"]), float(first["bias"]), [float(v) for v in first["weights"]]))

    def step(self, key: Any, rows: pd.DataFrame) -> pd.DataFrame:
        w0, b0 = initial_weights()
        version, steps, b, w = self.load((0, 0, b0, w0.tolist()))
        w = np.array(w)
        x = np.stack(rows["x"].to_numpy())
        wanted = (rows["label"] == "BLOCK").to_numpy(dtype=float)
        weight = np.where(rows["explicit"], EXPLICIT_WEIGHT, IMPLICIT_WEIGHT)
        versions = rows["model_version"].tolist()
        counts, before, biases, weights = np.empty(len(rows), dtype=np.int64), np.empty(len(rows)), np.empty(len(rows)), np.empty(x.shape)
        for i in range(len(rows)):
            if versions[i] != version:
                version, steps, b, w = versions[i], 0, b0, w0.copy()
            w, b, before[i] = sgd_step(w, b, x[i], wanted[i], weight[i])
            steps += 1
            counts[i], biases[i], weights[i] = steps, b, w
        self.value.update((int(version), int(steps), float(b), w.tolist()))
        return pd.DataFrame({"user": key[0], "id": rows["id"], "steps": counts, "p_before": before, "bias": biases, "weights": list(weights)})


def user_models(labels: DataFrame, initial: DataFrame | None = None, delay: str = "1 day") -> DataFrame:
    """Weights of a user after every label. Another model version starts from the defaults.

    ``initial`` (user, model_version, steps, bias, weights), such as a fit over earlier labels, is where users go on from.
    """
    x = F.array(*[F.col(c).cast("double") for c in S.DEVICE_FEATURES])
    rows = labels.select("user", "id", "ts", "label", "explicit", "model_version", x.alias("x"))
    output = "user bigint, id bigint, steps bigint, p_before double, bias double, weights array<double>"
    start = None if initial is None else initial.select("user", F.col("model_version").cast("int"), "steps", "bias", "weights")
    return _ordered(rows, ["user"], _UserModel(), output, delay, start)


class _PrefixMarks(_InOrder):
    rows = "ts bigint, id bigint"
    kept = "marks array<bigint>"

    def __init__(self, window_ms: int, keep: int | None, wanted: int):
        self.horizon, self.keep, self.wanted = window_ms, keep, wanted

    def step(self, key: Any, rows: pd.DataFrame) -> pd.DataFrame:
        (old,) = self.load(([],))
        ts = rows["ts"].to_numpy(dtype=np.int64)
        times = np.concatenate([np.array(old, dtype=np.int64), ts])
        here = len(old) + np.arange(len(ts)) + 1
        n = here - np.searchsorted(times, ts - self.horizon, side="left")
        n = n if self.keep is None else np.minimum(n, self.keep)
        marks = times[times >= ts[-1] - self.horizon]
        self.value.update(((marks if self.keep is None else marks[-self.keep:]).tolist(),))
        found = pd.DataFrame({"user": key[0], "prefix": key[1], "id": rows["id"], "marks": n, "last_seen": ts})
        return found[n >= self.wanted]


def prefix_marks(marks: DataFrame, days: int = 30, keep: int | None = None, wanted: int = 5, delay: str = "1 day") -> DataFrame:
    """Prefixes that reach the wanted number of marks within the window; ``keep`` bounds how many are remembered (``MARKS_KEPT``)."""
    rows = marks.filter(F.col("number").startswith("+7")).select(
        "user", F.substring("number", 1, 6).alias("prefix"), "id", "ts")
    output = "user bigint, prefix string, id bigint, marks bigint, last_seen bigint"
    return _ordered(rows, ["user", "prefix"], _PrefixMarks(days * DAY_MS, keep, wanted), output, delay)


#: Fixed value: marks a device remembers per prefix.
MARKS_KEPT = 50


class _Cache(_InOrder):
    rows = "ts bigint, id bigint, source string"
    kept = "source string, ts bigint"

    def __init__(self, days: dict[str, int], other: int):
        self.days, self.other = days, other
        self.horizon = max(other, *days.values()) * DAY_MS

    def step(self, key: Any, rows: pd.DataFrame) -> pd.DataFrame:
        source, stored = self.load((None, None))
        out = []
        for i, ts, answer in zip(rows["id"].tolist(), rows["ts"].tolist(), rows["source"].tolist()):
            hit = stored is not None and ts - stored <= self.days.get(source, self.other) * DAY_MS
            if not hit:
                source, stored = answer, ts
            out.append((i, hit, source))
        self.value.update((source, stored))
        return pd.DataFrame(out, columns=["id", "hit", "answered_by"])


def cached_lookups(lookups: DataFrame, delay: str = "1 day") -> DataFrame:
    """Was a look-up answered from the cache? A miss stores the answer under its source's lifetime, in event time."""
    from ..operators.lookup import CACHE_DAYS, CACHE_DAYS_OTHER

    rows = lookups.select("number", "id", "ts", "source")
    return _ordered(rows, ["number"], _Cache(CACHE_DAYS, CACHE_DAYS_OTHER), "id bigint, hit boolean, answered_by string", delay)


class _LiveCache(StatefulProcessor):
    """One state per lifetime; Spark drops an answer when its time to live is over."""

    def __init__(self, lifetimes_ms: dict[str, int], other_ms: int):
        self.lifetimes, self.other = lifetimes_ms, other_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        spans = sorted({self.other, *self.lifetimes.values()})
        self.answers = {ms: handle.getValueState(f"answer_{ms}", "source string", ms) for ms in spans}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = next((v.get()[0] for v in self.answers.values() if v.exists()), None)
        found = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "id"], kind="stable", ignore_index=True)
        hit = np.full(len(found), True)
        if known is None:
            known, hit[0] = found["source"].iloc[0], False
            self.answers[self.lifetimes.get(known, self.other)].update((known,))
        yield found[["id"]].assign(hit=hit, answered_by=known)

    def close(self) -> None:
        pass


def live_lookups(lookups: DataFrame, lifetimes_ms: dict[str, int] | None = None, other_ms: int | None = None) -> DataFrame:
    """As :func:`cached_lookups` by the clock: answers live as long in the state store as their source allows."""
    from ..operators.lookup import CACHE_DAYS, CACHE_DAYS_OTHER

    spans = {k: v * DAY_MS for k, v in CACHE_DAYS.items()} if lifetimes_ms is None else lifetimes_ms
    other = CACHE_DAYS_OTHER * DAY_MS if other_ms is None else other_ms
    return lookups.select("number", "id", "ts", "source").groupBy("number").transformWithStateInPandas(
        _LiveCache(spans, other), "id bigint, hit boolean, answered_by string", "Append", "ProcessingTime")


class _Thresholds(_InOrder):
    rows = "ts bigint, id bigint, action string, model_version int"
    kept = "version int, feedback bigint, warn double, block double"

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        first = initialState.iloc[0]
        self.value.update((int(first["model_version"]), int(first["feedback"]), float(first["warn_threshold"]), float(first["block_threshold"])))

    def step(self, key: Any, rows: pd.DataFrame) -> pd.DataFrame:
        from ..operators.events import BLOCK_STEP, WARN_STEP

        version, n, warn, block = self.load((0, 0, 0.35, 0.70))
        out = []
        for i, action, own in zip(rows["id"].tolist(), rows["action"].tolist(), rows["model_version"].tolist()):
            if own != version:
                version, warn, block = own, 0.35, 0.70
            n += 1
            if n >= 5:
                warn = min(0.50, max(0.15, warn + WARN_STEP.get(action, 0.0)))
                block = min(0.85, max(0.50, block + BLOCK_STEP.get(action, 0.0)))
            out.append((key[0], i, warn, block))
        self.value.update((int(version), int(n), float(warn), float(block)))
        return pd.DataFrame(out, columns=["user", "id", "warn_threshold", "block_threshold"])


def user_thresholds(feedback: DataFrame, initial: DataFrame | None = None, delay: str = "1 day") -> DataFrame:
    """Thresholds of a user after every piece of feedback; another model version resets them.

    ``initial`` (user, model_version, feedback, warn_threshold, block_threshold) is where users go on from.
    """
    rows = feedback.select("user", "id", "ts", "action", "model_version")
    output = "user bigint, id bigint, warn_threshold double, block_threshold double"
    start = None if initial is None else initial.select("user", F.col("model_version").cast("int"), "feedback", "warn_threshold", "block_threshold")
    return _ordered(rows, ["user"], _Thresholds(), output, delay, start)


# --- retention --------------------------------------------------------------


def expired_days(table: DataFrame, now_ms: Column, ttl_ms: int) -> DataFrame:
    """Day partitions of an event table that lie wholly beyond the time to live."""
    return table.select("day").distinct().filter((F.col("day") + 1) * DAY_MS <= now_ms - ttl_ms)


def drop_expired(table: DataFrame, folder: str, now_ms: int, ttl_ms: int) -> int:
    """Delete the expired day partitions of a table written by day. Gives their number."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    days = [r["day"] for r in expired_days(table, F.lit(now_ms), ttl_ms).collect()]
    for day in days:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/day={day}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(days)
