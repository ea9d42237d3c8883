"""Permutations, pooled calibration, near rows, clamped walks, prefix levels and masks against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringsift.operators import evaluate as V
from ringsift.operators import events as E
from ringsift.operators import lookup as L
from ringsift.operators import merge, sample, stats
from ringsift.plans import features as X
from ringsift.plans import model as M
from ringsift.queries.bindings import Tables
from ringsift.sources import feeds

FOLDER = "/root/testdata/sf0.001"


# Permutation importance


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997, 4096])
def test_permutations_are_bijections(spark, n):
    rows = spark.range(n)
    for which in range(3):
        keys = V.permutation_keys(7, which)
        got = [r.p for r in rows.select(V.permutation(F.col("id"), F.lit(n).cast("bigint"), keys).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        want = []
        for x in range(n):
            for k, a, b in keys:
                y = (k - x) % n
                x = y if ((max(x, y) % V.PRIMES[0]) * a + b) % V.PRIMES[1] % 2 else x
            want.append(x)
        assert got == want
        if n > 900:
            moved = np.abs(np.array(got) - np.arange(n)) / n
            assert abs(moved.mean() - 1 / 3) < 0.05 and abs(np.corrcoef(got, np.arange(n))[0, 1]) < 0.1


def test_importance_is_one_plan(spark):
    """A feature that decides loses all, an idle one nothing, and more repeats need no further exchange."""
    rows = spark.range(2000).select("id", (F.col("id") % 2 == 0).alias("y"), (F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.1)).alias("good"), F.lit(0.5).alias("idle"))

    def run(repeats):
        return V.permutation_importance(rows, "id", F.col("y"), 0.7 * F.col("good") + 0.3 * F.col("idle"), ["good", "idle"], repeats)

    got = {r.feature: r.importance for r in run(5).collect()}
    assert got["idle"] == pytest.approx(0.0) and abs(got["good"] - 0.5) < 0.05
    plans = [run(r)._jdf.queryExecution().executedPlan().toString().count("Exchange") for r in (1, 5)]
    assert plans[0] == plans[1]


def test_auc_by_cells(spark):
    rng = random.Random(3)
    data = [(round(rng.random(), 3), rng.random() < 0.4) for _ in range(700)]
    pos, neg = [s for s, y in data if y], [s for s, y in data if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    counts = V.score_counts(spark.createDataFrame(data, "s double, y boolean").withColumnRenamed("s", "v"), F.col("y"), F.col("v"))
    assert V.auc(counts).first()["auc"] == pytest.approx(want)


# Isotonic calibration


def _pooled(points):
    """Least-squares monotone fit by the min-max formula."""
    out = []
    for i in range(len(points)):
        out.append(max(min(sum(t for _, t, _ in points[a : b + 1]) / sum(n for *_, n in points[a : b + 1]) for b in range(i, len(points))) for a in range(i + 1)))
    return out


def test_pooled_blocks_equal_the_min_max_formula(spark):
    rng = random.Random(5)
    data = [(round(rng.random(), 2), int(rng.random() < 0.5)) for _ in range(600)] + [(0.0, 1), (1.0, 0), (1.0, 1)]
    df = spark.createDataFrame(data, "s double, y int")
    scores = sorted({s for s, _ in data})
    points = [(s, sum(y for v, y in data if v == s), sum(1 for v, _ in data if v == s)) for s in scores]
    want = dict(zip(scores, _pooled(points)))
    got = {r.s: r.calibrated for r in M.isotonic(df, "y", "s").collect()}
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in scores)
    # Between two blocks the value lies on the line between them; outside it is that of the end.
    other = M.isotonic(df, "y", "s", on=spark.createDataFrame([(0.005,), (-1.0,), (2.0,), (None,)], "s double")).collect()
    assert other[0].calibrated == pytest.approx((want[0.0] + want[0.01]) / 2 if 0.01 in want else other[0].calibrated)
    assert other[1].calibrated == pytest.approx(want[0.0]) and other[2].calibrated == pytest.approx(want[1.0]) and other[3].calibrated is None
    assert M.isotonic(df.filter("false"), "y", "s").count() == 0


def test_a_falling_line_becomes_one_block(spark):
    df = spark.range(1000).select((F.col("id") / 1000).alias("s"), (F.col("id") < 500).cast("int").alias("y"))
    blocks = M.isotonic_blocks(df, "y", "s").collect()
    assert [(b["first"], b["last"], b["value"]) for b in blocks] == [(0, 999_000, 0.5)]


# Near rows


@pytest.mark.parametrize("d, n", [(2, 6000), (4, 6000), (12, 4000)])
def test_near_rows_are_found(spark, d, n):
    rng = np.random.default_rng(d)
    points = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    names = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([(int(i), *map(float, p)) for i, p in enumerate(points)], "id bigint, " + ", ".join(f"{c} double" for c in names))
    found = {r.id: r.near for r in M.near_rows(df, "id", names, k=5, cell_rows=512).collect()}
    assert len(found) == n and all(len(v) == len(set(v)) == 5 and i not in v for i, v in found.items())
    asked = range(0, n, 20)
    hits = 0
    for i in asked:
        gaps = ((points - points[i]) ** 2).sum(axis=1)
        gaps[i] = np.inf
        hits += len(set(np.argsort(gaps)[:5].tolist()) & set(found[i]))
    assert hits / (5 * len(asked)) >= 0.9


def test_near_rows_of_equal_points_and_few_rows(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0) for i in range(900)] + [(1000, 5.0, 5.0)], "id bigint, a double, b double")
    found = {r.id: r.near for r in M.near_rows(df, "id", ["a", "b"], k=3, cell_rows=64).collect()}
    assert len(found) == 901 and all(1000 not in found[i] for i in range(900))
    two = M.near_rows(df.limit(2), "id", ["a", "b"]).collect()
    assert sorted((r.id, r.near) for r in two) == [(0, [1]), (1, [0])]
    made = M.smote(df.withColumn("y", F.lit(1)), "y", 1, "id", ["a", "b"], copies=2, cell_rows=64)
    assert made.count() == 1802 and made.filter("parent = id").count() == 0


def test_near_rows_are_found_beyond_their_cell(spark):
    """Rows on both sides of a border find each other, and equal points count as often as they occur."""
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(3000, 3)) * [1, 5, 0.2], rng.integers(0, 3, (600, 3)).astype(float)])
    df = spark.createDataFrame([(int(i), *map(float, p)) for i, p in enumerate(points)], "id bigint, a double, b double, c double")
    found = {r.id: r for r in M.near_rows(df, "id", ["a", "b", "c"], k=4, cell_rows=16).collect()}
    assert len(found) == 3600
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    want = np.sort(apart, axis=1)[:, 3]
    assert all(len(set(r.near)) == 4 and i not in r.near and r.distance == pytest.approx(apart[i, r.near].max(), abs=1e-9) for i, r in found.items())
    assert np.mean([found[i].distance <= want[i] + 1e-9 for i in range(3600)]) > 0.995


def test_near_rows_of_a_cell_that_all_rows_ask(spark, monkeypatch):
    """A cell that is asked by very many rows is held by several tasks, and answers all of them."""
    monkeypatch.setattr(M, "ROOM", 1)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(600, 8))
    points[:20] *= 0.01
    names = [f"f{i}" for i in range(8)]
    df = spark.createDataFrame([(f"k{i:03d}", *map(float, p)) for i, p in enumerate(points)], "id string, " + ", ".join(f"{c} double" for c in names))
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, np.inf)
    found = {r.id: r.near for r in M.near_rows(df, "id", names, k=3, tables=1000, cell_rows=16).collect()}
    assert found == {f"k{i:03d}": [f"k{j:03d}" for j in np.argsort(apart[i])[:3]] for i in range(600)}


def test_near_rows_of_unknown_values(spark):
    rows = [(i, float(i), 0.0) for i in range(900)] + [(1000 + i, None, float(i)) for i in range(30)] + [(2000, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    found = {r.id: r for r in M.near_rows(df, "id", ["a", "b"], k=2, cell_rows=16).collect()}
    assert len(found) == 931 and all(len(r.near) == 2 and i not in r.near for i, r in found.items())
    assert all(max(r.near) < 900 for i, r in found.items() if i < 900) and found[5].near == [4, 6] and found[0].distance == 2.0
    assert M.near_rows(df.filter("id >= 1000"), "id", ["a", "b"], k=2).count() == 31
    assert M.near_rows(df.limit(0), "id", ["a", "b"]).count() == 0 and M.near_rows(df.limit(1), "id", ["a", "b"]).count() == 0
    pair = M.near_rows(df.filter("id in (7, 1003)"), "id", ["a", "b"]).collect()
    assert sorted((r.id, r.near) for r in pair) == [(7, [1003]), (1003, [7])]


def test_near_rows_beside_a_pile_of_equal_points(spark):
    """A point that very many rows share is dealt to several tasks; the rows around it still find each other."""
    rng = np.random.default_rng(6)
    points = rng.normal(size=(4000, 3))
    points[:2500] = points[0] * [1, 0, -0.0]
    rows = [(int(i), *map(float, p)) for i, p in enumerate(points)] + [(4000 + i, None, 0.0, 0.0) for i in range(1200)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double")
    found = {r.id: r for r in M.near_rows(df, "id", ["a", "b", "c"], k=4, cell_rows=16).collect()}
    assert len(found) == 5200 and all(len(set(r.near)) == 4 and i not in r.near for i, r in found.items())
    assert all(found[i].distance == 0.0 and max(found[i].near) < 2500 for i in range(2500))
    apart = np.sqrt(((points[2500:, None] - points[None]) ** 2).sum(axis=2))
    apart[np.arange(1500), 2500 + np.arange(1500)] = np.inf
    want = np.sort(apart, axis=1)[:, 3]
    assert np.mean([found[2500 + i].distance <= want[i] + 1e-9 for i in range(1500)]) > 0.995


def test_repeated_rows_count_once(spark):
    """Every row twice: it is its own nearest, and the others are there once each."""
    df = spark.createDataFrame([(i // 2, float(i // 2) ** 1.1, 0.0) for i in range(1200)], "id bigint, a double, b double")
    for cell_rows in (16, 512):
        found = {r.id: r.near for r in M.near_rows(df, "id", ["a", "b"], k=4, cell_rows=cell_rows).collect()}
        assert found[0] == [0, 1, 2, 3] and found[599] == [599, 598, 597, 596] and len(found) == 600
        assert all(v == [i, i - 1, i + 1, i - 2] for i, v in found.items() if 1 < i < 598)


# Clamped walk


def test_walks_are_folded_in_rounds(spark):
    rng = random.Random(9)
    rows = [(u, i, rng.randrange(10**9), rng.choice([-0.3, -0.1, 0.05, 0.2])) for u, n in ((1, 700), (2, 1), (3, 17), (4, 256)) for i in range(n)]
    rows += [(5, i, 1000, d) for i, d in enumerate([0.9, -0.9, 0.3])]
    df = spark.createDataFrame(rows, "user int, id int, ts bigint, delta double")
    want = {}
    for u, i, ts, d in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        want[u] = max(0.1, min(1.5, want.get(u, 1.0) + d))
    walk = E.clamped_walk(df, ["user"], ["ts", "id"], "ts", "delta", 1.0, 0.1, 1.5)
    assert {r.user: r.value for r in walk.collect()} == pytest.approx(want)
    assert "collect_list" not in walk._jdf.queryExecution().executedPlan().toString().lower()


# Prefix levels


def test_levels_equal_the_look_ups_one_by_one(spark):
    t = Tables(spark, FOLDER)
    tables = X.RiskTables.build(t.labeled)
    extra = ["", None, "112", "+7916", "+79161", "+849512345678", "+12345678901", "+7916abc", "900", "0771234567", "+70771234567", "+79991234567"]
    numbers = t.numbers.select("normalized_number").union(spark.createDataFrame([(x,) for x in extra], "n string"))
    numbers = numbers.withColumns({
        "given": F.when(F.crc32(F.coalesce("normalized_number", F.lit(""))) % 3 == 0, "tele2").otherwise(""),
        "operator": F.when(F.crc32(F.coalesce("normalized_number", F.lit(""))) % 5 == 0, "ПАО МегаФон").otherwise(""),
        "free": F.crc32(F.coalesce("normalized_number", F.lit(""))) % 7 == 0,
    }).distinct()
    fallback, seen = tables.header_value("overall_block_rate"), tables.header_value("seen_log_norm")
    free, n = F.col("free"), "normalized_number"
    got = L.levels_lookup(numbers, tables.levels, tables.level(9), fallback, seen, F.col("given"), F.col("operator"), n, free)
    want = L.resolve_bucket(numbers, tables.operator_by_code, F.col("given"), F.col("operator"), n)
    want = L.prefix_risk_lookup(want, tables.prefix_risk, fallback, n, free)
    want = L.code_risk_lookup(want, tables.code_risk, fallback, n, free)
    want = L.operator_code_risk_lookup(want, tables.operator_code_risk, fallback, "operator_bucket", n, free)
    want = L.histogram_lookup(want, tables.level(6), seen, n)
    want = L.prefix_share_lookup(want, tables.level(5), 5, "prefixBlockShare3", n, free)
    want = L.prefix_share_lookup(want, tables.level(9), 9, "prefixBlockShare7", n, free)
    cols = sorted(want.columns)
    key = lambda r: tuple(str(v) for v in r)
    a, b = (sorted((tuple(r) for r in df.select(*cols).collect()), key=key) for df in (got, want))
    assert a == b and len(a) > 100


def test_levels_are_few_rows(spark):
    rows = spark.range(200_000).select(F.concat(F.lit("+79"), F.lpad((F.col("id") * 49999).cast("string"), 9, "0")).alias("number"), F.lit("BLOCK").alias("label"), F.lit("МТС").alias("operator"))
    assert stats.prefix_levels(rows).count() <= 11_000


def test_compact_features_look_up_twice(spark):
    t = Tables(spark, FOLDER)
    plan = X.compact_features(t.numbers, X.RiskTables.build(t.labeled))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2


# Masks, plan numbers, feeds, parts


def test_masks_meet_numbers_at_their_own_lengths(spark):
    numbers = spark.createDataFrame([(n,) for n in ("+79161234567", "+79261234567", "+74951234567", "+78001234567", None, "112")], "normalized_number string")
    exact = spark.createDataFrame([("+74951234567",)], "normalized_number string")
    masks = spark.createDataFrame([(p,) for p in (r"^\+7916", r"^\+7926.*67$", r"00\d+7$", None)], "pattern string")
    got = L.blocked_numbers(numbers, exact, masks)
    assert {r.normalized_number: r.blocked_by for r in got.collect()} == {
        "+79161234567": "mask", "+79261234567": "mask", "+74951234567": "exact", "+78001234567": "mask", None: None, "112": None}
    none = L.blocked_numbers(numbers, exact, masks.filter("false"))
    assert sorted(str(r.blocked_by) for r in none.collect()) == ["None"] * 5 + ["exact"]


def test_enough_picks():
    rng = random.Random(1)
    for size, free, wanted in ((1000, 900, 300), (1000, 1000, 990), (50, 50, 50), (10**6, 10**6, 2000)):
        hit = {rng.randrange(size) for _ in range(min(sample.picks(size, free, wanted), 10**6))}
        assert sum(1 for h in hit if h < free) >= wanted
    assert sample.picks(10**6, 10**6, 2000) < 2500
    assert sample.picks(100, 5, 50) >= 100 * math.log(100)


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = tmp_path / "feed.csv"
    path.write_text('normalized_number,categories\n+79161234567,"спам\nреклама"\n+79161234568,"a ""b"""\n', encoding="utf-8")
    rows = feeds.read_feed(spark, str(path), ["normalized_number", "categories"]).collect()
    assert [tuple(r) for r in rows] == [("+79161234567", "спам\nреклама"), ("+79161234568", 'a "b"')]
    assert feeds.read_feed(spark, str(path), ["normalized_number"], multiline=False).count() == 3


def test_parts_are_joined_once_and_sorted(spark):
    df = spark.createDataFrame([(1, "b; a", "s"), (1, "a;c;", "t"), (1, None, "s"), (2, "", None)], "k int, c string, d string")
    got = {r.k: (r.c, r.d) for r in merge.joined_parts(df, "k", {"c": (";", ";"), "d": (None, "+")}).collect()}
    assert got == {1: ("a;b;c", "s+t")}
