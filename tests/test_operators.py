"""Operators against brute force and literal cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ringsift.operators import decide as D
from ringsift.operators import evaluate as V
from ringsift.operators import events as E
from ringsift.operators import lookup as L
from ringsift.operators import merge as M
from ringsift.operators import sample as A
from ringsift.operators import sizing, stats, timeline


def _events(n=400, keys=5, span=40_000, seed=1):
    r = random.Random(seed)
    # Key 0 holds more than a third of all rows.
    return [(i, 0 if r.random() < 0.4 else r.randrange(keys), r.randrange(span), r.randrange(3)) for i in range(n)]


def test_lookback_sums_against_pairs(spark):
    rows = _events()
    df = spark.createDataFrame(rows, "id bigint, k bigint, ts bigint, v bigint")
    sums = {"a": (F.col("v"), 500), "b": (F.lit(1), 7000)}
    got = {r["id"]: (r["a"], r["b"]) for r in timeline.lookback_sums(df, "id", df, ["k"], "ts", sums, width=900).collect()}
    for i, k, t, _ in rows:
        a = sum(v for _, k2, t2, v in rows if k2 == k and t - 500 <= t2 < t)
        b = sum(1 for _, k2, t2, _ in rows if k2 == k and t - 7000 <= t2 < t)
        assert got[i] == (a, b)


@pytest.mark.parametrize("inclusive", [False, True])
def test_latest_before_and_following(spark, inclusive):
    rows = _events(seed=2)
    df = spark.createDataFrame(rows, "id bigint, k bigint, ts bigint, v bigint")
    hit = {"x": F.when(F.col("v") == 1, F.col("ts"))}
    for following in (False, True):
        got = {r["id"]: r["x"] for r in timeline.latest_before(df, "id", df, ["k"], "ts", hit, inclusive, 900, following).collect()}
        for i, k, t, _ in rows:
            if following:
                seen = [t2 for _, k2, t2, v in rows if k2 == k and v == 1 and (t2 > t or (inclusive and t2 == t))]
                assert got[i] == (min(seen) if seen else None)
            else:
                seen = [t2 for _, k2, t2, v in rows if k2 == k and v == 1 and (t2 < t or (inclusive and t2 == t))]
                assert got[i] == (max(seen) if seen else None)


def test_targets_without_a_key_stay(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "a", 6)], "id bigint, k string, ts bigint")
    out = timeline.lookback_sums(df, "id", df, ["k"], "ts", {"n": (F.lit(1), 10)}).collect()
    assert sorted((r["id"], r["n"]) for r in out) == [(1, 0.0), (2, 0.0)]


def test_numbering_lookup_takes_the_greatest_start(spark):
    plan = spark.createDataFrame(
        [(916, 0, 9_999_999, "wide", "r", 1, "mobile"), (916, 1_000_000, 1_000_009, "narrow", "r", 1, "mobile"), (916, 2_000_000, 2_000_001, "x", "r", 1, "mobile")],
        "def_code bigint, start_number bigint, end_number bigint, operator string, region string, capacity bigint, number_type string")
    asked = {"+79160999999": "wide", "+79161000005": "narrow", "+79161000010": None, "+79162000000": "x", "+79169999999": None, "+79030000000": None}
    df = spark.createDataFrame([(n,) for n in asked], "normalized_number string")
    got = {r["normalized_number"]: r["plan_operator"] for r in L.numbering_lookup(df, plan).collect()}
    assert got == asked


def test_salted_join_keeps_every_row(spark):
    big = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), ("none", 2)], "k string, i int")
    small = spark.createDataFrame([("hot", 1.0), ("cold", 2.0)], "k string, v double")
    out = sizing.salted_join(big, small, ["k"], "left", 8)
    assert out.count() == 502
    assert out.filter("k = 'hot' and v = 1.0").count() == 500
    assert out.filter("v is null").count() == 1


def test_lookup_join_and_salted_join_agree(spark):
    big = spark.createDataFrame([(i % 7, i) for i in range(50)], "k int, i int")
    small = spark.createDataFrame([(k, k * 1.0) for k in range(5)], "k int, v double")
    a = sizing.lookup_join(big, small, ["k"]).orderBy("i").collect()
    b = sizing.salted_join(big, small, ["k"]).select(*sizing.lookup_join(big, small, ["k"]).columns).orderBy("i").collect()
    assert a == b


def test_blocked_by_list_then_mask(spark):
    numbers = spark.createDataFrame([("+79161111111",), ("+78001111111",), ("+74951111111",)], "normalized_number string")
    exact = spark.createDataFrame([("+79161111111",)], "normalized_number string")
    masks = spark.createDataFrame([(r"^\+7800",), (r"^\+7916",)], "pattern string")
    got = {r[0]: r["blocked_by"] for r in L.blocked_numbers(numbers, exact, masks).collect()}
    assert got == {"+79161111111": "exact", "+78001111111": "mask", "+74951111111": None}


def test_masks_of_all_kinds_meet_what_their_patterns_meet(spark):
    values = ["+78001111111", "+78051111117", "+79531234567", "+7953", "112", "84951112233", "", "+7", "+74991"]
    numbers = spark.createDataFrame([(v,) for v in values] + [(None,), ("112",)], "normalized_number string")
    none = spark.createDataFrame([], "normalized_number string")
    patterns = [r"^\+7800", r"^\+7953.*7$", r"^\+780?5", r"^\+7800|^112$", "^8495.*", "2$", r"^\+7953.*", r"^\+749{2}1", r"^\+7$", "^$", r"^\+7[89]5", "^11+2"]
    for chosen in [[p] for p in patterns] + [patterns[:3], patterns[3:6], []]:
        masks = spark.createDataFrame([(p,) for p in chosen] + [(None,)], "pattern string")
        got = [(r[0], r["blocked_by"]) for r in L.blocked_numbers(numbers, none, masks).collect()]
        assert len(got) == len(values) + 2
        for value, by in got:
            met = value is not None and any(re.search(p, value) for p in chosen)
            assert by == ("mask" if met else None), (chosen, value)


def _classes(spark, n=1000):
    return spark.createDataFrame([(i, "BLOCK" if i % 10 < 8 else ("WARN" if i % 10 == 8 else "ALLOW"), (i % 97) / 96) for i in range(n)], "key bigint, label string, x double")


def test_split_counts_are_exact_and_disjoint(spark):
    out = A.stratified_split(_classes(spark), "label", "key", (0.8, 0.1, 0.1)).groupBy("label", "split").count().collect()
    got = {(r["label"], r["split"]): r["count"] for r in out}
    assert got[("BLOCK", "train")] == 640 and got[("BLOCK", "val")] == 80 and got[("BLOCK", "test")] == 80
    assert got[("ALLOW", "train")] == 80 and sum(got.values()) == 1000


def test_split_does_not_depend_on_partitioning(spark):
    df = _classes(spark)
    a = {r["key"]: r["split"] for r in A.stratified_split(df, "label", "key").collect()}
    b = {r["key"]: r["split"] for r in A.stratified_split(df.repartition(7, "x"), "label", "key").collect()}
    assert a == b


@pytest.mark.parametrize("k", [0, 1, 37, 1000, 5000])
def test_pick_takes_exactly_k(spark, k):
    out = A.pick(_classes(spark), "key", 3, {"hit": A.fixed(k)}).filter("hit")
    assert out.count() == min(k, 1000)


def test_cold_view_is_idempotent_and_touches_nothing_else(spark):
    df = spark.createDataFrame([(0.5, 0.7, 0.0)], "reputationScore double, prefixRisk double, noMetadata double")
    once = A.cold_view(df).collect()
    assert once == A.cold_view(A.cold_view(df)).collect()
    assert tuple(once[0]) == (0.0, 0.7, 1.0)


def test_smoothed_risk(spark):
    rows = [("+7916111%04d" % i, "BLOCK" if i < 6 else "ALLOW", "") for i in range(10)] + [("+7495111%04d" % i, "WARN", "") for i in range(2)]
    df = spark.createDataFrame(rows, "number string, label string, operator string")
    got = {r["prefix"]: r["risk"] for r in stats.prefix_risk(df).collect()}
    assert got == {"+79161": round((6 + 10 * 0.5) / 20, 4)}


def test_statistics_from_folded_counts_are_the_same(spark):
    r = random.Random(5)
    rows = [(f"+79{r.randrange(10, 13)}{r.randrange(10**7):07d}", r.choice(["ALLOW", "WARN", "BLOCK"]), r.choice(["МТС", "Йота", ""])) for _ in range(600)]
    df = spark.createDataFrame(rows, "number string, label string, operator string")
    folded = stats.folded(df)
    for fn in (stats.prefix_risk, stats.code_risk, stats.operator_code_risk, stats.prefix_histogram, stats.operator_bucket_by_code):
        assert sorted(map(str, fn(df).collect())) == sorted(map(str, fn(folded).collect()))


def _sweep(y, p, t):
    tp = sum(1 for a, b in zip(y, p) if a and b >= t)
    fp = sum(1 for a, b in zip(y, p) if not a and b >= t)
    return tp, fp


def test_sweep_against_loops(spark):
    r = random.Random(7)
    p = [round(r.random(), 3) for _ in range(500)]
    y = [r.random() < q for q in p]
    df = spark.createDataFrame(list(zip(y, p)), "y boolean, p double")
    rows = V.sweep(V.score_counts(df, F.col("y"), F.col("p")), 10, 95).collect()
    assert len(rows) == 86
    for row in rows:
        assert (row["tp"], row["fp"]) == _sweep(y, p, row["cent"] / 100)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (0, 0.4)], "y int, p double")
    pairs = [(a, b) for a in (0.9, 0.4) for b in (0.9, 0.1, 0.4)]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    got = V.auc(V.score_counts(df, F.col("y") == 1, F.col("p"))).collect()[0][0]
    assert got == pytest.approx(want)


def test_perfect_predictor_has_no_error(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0)] * 10, "y int, p double")
    assert V.calibration_error(df, "y", "p").collect()[0][0] == 0.0
    assert V.brier(df, "y", "p").collect()[0][0] == 0.0


def test_permuted_column_keeps_its_values(spark):
    df = _classes(spark, 200)
    out = V.permuted(df, "key", "x", 5)
    assert sorted(r["x"] for r in out.collect()) == sorted(r["x"] for r in df.collect())
    assert out.join(df.withColumnRenamed("x", "z"), "key").filter("x <> z").count() > 100


def test_missing_metric_fails_the_gate(spark):
    df = spark.createDataFrame([(0.9, None, float("nan"))], "a double, b double, c double")
    failed = {r["metric"] for r in V.failed_gates(df, {"a": 0.8, "b": 0.1, "c": 0.1}).collect()}
    assert failed == {"b", "c"}


@pytest.mark.parametrize("risk, verdict, want", [(0.65, "ALLOW", "WARN"), (0.64, "ALLOW", "ALLOW"), (0.9, "BLOCK", "BLOCK"), (0.9, "WARN", "WARN")])
def test_cold_rule_is_inclusive_and_never_lowers(one, risk, verdict, want):
    f = {"isRussianNumber": 1.0, "isMobileRu": 1.0, "isGeographical": 0.0, "isContact": 0.0, "inAllowlist": 0.0, "isShortCode": 0.0, "isTollFree8800": 0.0, "prefixRisk": risk}
    hit = D.cold_rule_hits({k: F.lit(v) for k, v in f.items()}, F.lit("cold"))
    assert one(D.raise_verdict(F.lit(verdict), hit)) == want


def test_source_priority_keeps_first_appearance(spark):
    df = spark.createDataFrame([("b", 2, 0, "x"), ("a", 1, 1, "y"), ("b", 1, 2, "z"), ("b", 1, 3, "w")], "k string, r int, o int, v string")
    out = [(r["k"], r["v"]) for r in M.source_priority(df, "k", "r", "o").collect()]
    assert out == [("b", "z"), ("a", "y")]


def test_clamped_walk_against_a_loop(spark):
    r = random.Random(3)
    rows = [(u, i, r.randrange(10**9), r.uniform(-0.2, 0.2)) for i in range(300) for u in ([0] if r.random() < 0.6 else [1])]
    df = spark.createDataFrame(rows, "user int, id int, ts bigint, delta double")
    got = {x["user"]: x["value"] for x in E.clamped_walk(df, ["user"], ["ts", "id"], "ts", "delta", 1.0, 0.1, 1.5, 10**7).collect()}
    for u in (0, 1):
        value = 1.0
        for _, _, _, d in sorted((x for x in rows if x[0] == u), key=lambda x: (x[2], x[1])):
            value = max(0.1, min(1.5, value + d))
        assert got[u] == pytest.approx(value)


def test_unknown_strategies_are_refused(one):
    with pytest.raises(ValueError):
        D.binary_label(F.lit(1), "other")
    with pytest.raises(ValueError):
        D.verdict_id("other", F.lit(1.0), None, 0.5, 0.3)
