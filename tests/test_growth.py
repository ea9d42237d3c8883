"""What a task holds, and how much work a hot key makes: bounded as the tables grow."""

import collections

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringsift.operators import events as E
from ringsift.streaming import jobs as J
from ringsift.streaming import run as R


class _Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class _Map:
    def __init__(self):
        self.held = {}

    def exists(self):
        return bool(self.held)

    def keys(self):
        return iter(list(self.held))

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]

    def clear(self):
        self.held = {}


class _Handle:
    """State of one key, in this process."""

    def __init__(self):
        self.states, self.timers = {}, []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Value())

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, _Map())

    def registerTimer(self, ms):
        self.timers.append(ms)


class _Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


class _Seen(J._InOrder):
    rows = "ts bigint, id bigint, what string"
    kept = "n bigint"
    horizon = 40 * E.DAY_MS

    def step(self, key, rows):
        return rows


def _pass(job, ms):
    """Fire the timers that the watermark has passed. Gives the blocks."""
    found = []
    while due := [t for t in job.handle.timers if t <= ms]:
        job.handle.timers.remove(due[0])
        found += job.handleExpiredTimer(("k",), _Mark(ms), None)
    return found


def test_waiting_rows_are_handled_in_blocks():
    """Rows of thirty days of one key, in no order: as blocks of bounded size, each once, by event time."""
    job, rng = _Seen(), np.random.default_rng(1)
    job.init(_Handle())
    n, start = 200_000, 400 * E.DAY_MS
    ts = start + rng.integers(0, 30 * E.DAY_MS, n)
    line = pd.DataFrame({"ts": ts, "id": np.arange(n), "what": np.where(np.arange(n) % 7 == 0, None, "x")})
    job.handleInputRows(("k",), (line[i : i + 10_000] for i in range(0, n, 10_000)), None)
    assert len(job.waiting.held) < n / 100
    middle = start + 15 * E.DAY_MS + 12_345
    early, late = _pass(job, middle), []
    assert min(job.handle.timers) > middle and pd.concat(early)["ts"].max() < middle
    late = _pass(job, start + 31 * E.DAY_MS)
    assert max(len(b) for b in early + late) < 2 * J.BLOCK_ROWS
    want = line.sort_values(["ts", "id"], ignore_index=True)
    got = pd.concat(early + late, ignore_index=True)
    assert got["id"].tolist() == want["id"].tolist() and got["what"].isna().tolist() == want["what"].isna().tolist()
    _pass(job, start + 100 * E.DAY_MS)
    assert not any(s.exists() for s in job.handle.states.values())


def test_quiet_keys_have_few_parts():
    job = _Seen()
    job.init(_Handle())
    ts = 400 * E.DAY_MS + np.arange(120) * E.DAY_MS // 4
    job.handleInputRows(("k",), iter([pd.DataFrame({"ts": ts, "id": np.arange(120), "what": "x"})]), None)
    assert len(job.waiting.held) == 1
    seen = []
    for ms in (ts[40], ts[41], ts[119] + 1):
        seen.append([i for b in _pass(job, int(ms)) for i in b["id"]])
    assert seen == [list(range(40)), [40], list(range(41, 120))]


@pytest.fixture(scope="module")
def flood(spark):
    """Two busy numbers and edges: a call back in the same millisecond, at the window's last, and one behind it."""
    day, rows = E.DAY_MS, []
    rng = np.random.default_rng(2)
    for i in range(600):
        kind = [("INCOMING", "MISSED"), ("OUTGOING", "ANSWERED"), ("INCOMING", "ANSWERED")][int(rng.integers(0, 3))]
        rows.append((i, 1, f"+7900000000{i % 2}", *kind, 0, 400 * day + int(rng.integers(0, 12 * day))))
    for j, (gap, back) in enumerate([(0, True), (day, True), (day + 1, True), (day - 1, True), (0, False)]):
        for k in range(24):
            at = 400 * day + k * E.HOUR_MS + (k % 3 - 1)
            number = f"+79111{j:02d}{k:04d}"
            rows.append((1000 + 100 * j + k, 1, number, "INCOMING", "MISSED", 0, at))
            if back:
                rows.append((5000 + 100 * j + k, 1, number, "OUTGOING", "ANSWERED", 0, at + gap))
    return spark.createDataFrame(rows, "id bigint, user bigint, number string, direction string, state string, duration_ms bigint, ts bigint").coalesce(1)


def test_calls_back_meet_missed_calls_by_cell(spark, flood, tmp_path):
    """A missed call does not meet every call back of its number, and the labels are those of the definition."""
    folder = str(tmp_path / "flood")
    for i in range(2):
        flood.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == i).coalesce(1).write.mode("append").parquet(folder)
    last = 500 * E.DAY_MS
    close = [(1 << 40, 1, "+79009999999", "INCOMING", "MISSED", 0, last), ((1 << 40) + 1, 1, "+79009999998", "OUTGOING", "ANSWERED", 0, last)]
    spark.createDataFrame(close, flood.schema).coalesce(1).write.mode("append").parquet(folder)
    job = J.deferred_labels(R.file_stream(spark, folder, flood.schema, files_per_trigger=1), delay="30 days")
    plan = job._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan[plan.index("LeftOuter"):]
    backs = collections.defaultdict(list)
    for r in flood.filter("direction = 'OUTGOING'").collect():
        backs[r.number].append(r.ts)
    want = [r.id for r in flood.filter("direction = 'INCOMING' and state = 'MISSED'").collect()
            if not any(r.ts <= b <= r.ts + E.DAY_MS for b in backs[r.number])]
    got = [r.id for r in R.run_to_table(job, "deferred").filter(F.col("id") < 1 << 40).collect()]
    assert sorted(got) == sorted(want) and len(want) > 48


def test_smallest_takes_the_first_of_equal_values():
    from ringsift.plans.model import _smallest

    rng = np.random.default_rng(3)
    for values in (rng.normal(size=(40, 300)), rng.integers(0, 3, (40, 300)).astype(float), np.full((40, 300), np.inf)):
        for m in (1, 5, 299):
            want = np.sort(np.argsort(values, axis=1, kind="stable")[:, :m], axis=1)
            assert (_smallest(values, m) == want).all()


def test_a_row_is_compared_with_few_leaves(monkeypatch):
    """The nearest are those of all pairs, with a small part of the pairs looked through."""
    from ringsift.plans import model as M

    seen, pick = [], M._smallest
    monkeypatch.setattr(M, "_smallest", lambda d, m: seen.append(d.size) or pick(d, m))
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.random((6000, 4)), rng.integers(0, 4, (2000, 4)) + 0.5, np.full((400, 4), 1e6), 1e6 + rng.random((50, 4))])
    asked = rng.random((100, 4)) * 2

    def apart(rows):
        return ((rows[:, None] - points[None]) ** 2).sum(axis=2)

    near = M._nearest(points, 5, 64)
    assert sum(seen) < len(points) ** 2 / 10
    for at in range(0, len(points), 650):
        rows = np.arange(at, min(at + 650, len(points)))
        d = apart(points[rows])
        d[np.arange(len(rows)), rows] = np.inf
        got = np.sort(np.take_along_axis(d, near[rows], axis=1), axis=1)
        assert np.allclose(got, np.sort(d, axis=1)[:, :5], rtol=1e-9, atol=1e-12)
    d = apart(asked)[:, :6000]
    edge = np.sort(d, axis=1)[:, 3]
    near = M._nearest(points[:6000], 5, 64, asked, edge * (1 + 1e-9))
    assert [sorted(r[r >= 0]) for r in near] == [sorted(r) for r in np.argsort(d, axis=1)[:, :4]]
    assert (M._nearest(points[:0], 5, 64, asked, edge) == -1).all() and M._nearest(points[:0], 5, 64).shape == (0, 5)
    assert sorted(M._nearest(points[:3], 5, 64)[1]) == [-1, -1, -1, 0, 2]


def test_search_in_cells_is_dealt_to_as_many_tasks_as_named(spark):
    """Cells are few bytes and much work: partitions of them are not put together."""
    from ringsift.plans import model as M

    df = spark.range(2000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"))
    plan = M.near_rows(df, "id", ["a", "b"], cell_rows=16)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan.split("FlatMapGroupsInArrow")[1]


def test_only_references_go_to_python(spark):
    import html

    from ringsift.functions import text as T

    texts = ["", "&", "a &amp; b", "&amp;amp;", "&notit; &notin; &#65;&#x42 &#0; &#xD800; &#1114112;", "&lt", "x&copy y;&", "мир &nbsp;&hellip;", "&" * 5,
             "no reference", "&thisisaverylongnamethatisnoreferenceatall;z", "\U0001f600&Aacute\U0001f600;", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, x string").repartition(2)
    got = rows.select("id", T.unescape(F.col("x")).alias("y"))
    assert [r.y for r in got.orderBy("id").collect()] == [None if x is None else html.unescape(x) for x in texts]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan[plan.index("_unescape_udf("):].split("\n")[0]


def test_tag_pairs_are_looked_up_under_their_key(spark):
    """The answer is that of the registry read from its start, and no list of all rules is filtered."""
    from ringsift import rules
    from ringsift.operators import decide

    exact = [r for r in rules.TAG_RULES if r[2] != "*"]
    tags = [{k: v} for _, k, v, _, _ in exact] + [{a[1]: a[2], b[1]: b[2]} for a, b in zip(exact, exact[50:] + exact[:50]) if a[1] != b[1]]
    tags += [{"amenity": "bench", "shop": "bakery"}, {"barrier": "gate", "office": "notary"}, {"craft": "x"}, {}, {"note": "n"}]
    df = spark.createDataFrame(list(enumerate(tags)), "id int, t map<string,string>").select("id", decide.tag_category(F.col("t")).alias("c"))
    assert "filter(" not in df._jdf.queryExecution().analyzed().toString()
    got = {r.id: r.c for r in df.collect()}
    for i, t in enumerate(tags[:-5]):
        c, k, v, f, p = next(r for r in exact if t.get(r[1]) == r[2])
        assert got[i] is None or (got[i].category, got[i].feature, got[i].source, got[i].confidence) == (c, f, f"osm_{c}_{v}", p)
        assert (got[i] is None) == any(t.get(k) == v or (v == "*" and k in t) for k, v in rules.NEGATIVE_TAGS)
    end = [got[len(tags) - 5 + i] for i in range(5)]
    assert [e and e.source for e in end] == [None, None, "osm_craft_craft", None, None]
