"""Classifier evaluation: confusion, threshold sweeps, calibration, ranking, drift, gates.

Scores are compared at six decimal places. A sweep never meets the raw rows: they are folded once
into counts per (score, class), at most 10^6 + 1 scores per class, and thresholds are compared
with those counts.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizing import write_once

MICRO = 1_000_000
CENT = 10_000


def micro(score: Column) -> Column:
    return F.round(score * MICRO).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1)."""
    return a / F.greatest(b, F.lit(1))


def f1(p: Column, r: Column) -> Column:
    return 2.0 * p * r / F.greatest(p + r, F.lit(1e-9))


def _rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, f1(p, r)


# --- confusion --------------------------------------------------------------


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("rows"))


def per_class_metrics(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """Precision, recall, F1 and support per class; zero where undefined."""
    cells = confusion(df, truth, predicted)
    parts = []
    for c in classes:
        hit = (F.col(truth) == c) & (F.col(predicted) == c)
        parts.append(
            F.struct(
                F.lit(c).alias("class"),
                F.coalesce(F.sum(F.when(hit, F.col("rows"))), F.lit(0)).alias("tp"),
                F.coalesce(F.sum(F.when((F.col(truth) != c) & (F.col(predicted) == c), F.col("rows"))), F.lit(0)).alias("fp"),
                F.coalesce(F.sum(F.when((F.col(truth) == c) & (F.col(predicted) != c), F.col("rows"))), F.lit(0)).alias("fn"),
            )
        )
    long = cells.agg(F.array(*parts).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    p, r, f = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return long.select(
        "class", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
    )


def macro_f1(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum("tp") / F.greatest(F.sum("support"), F.lit(1))).alias("accuracy"),
    )


def golden_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Ids 0 allow, 1 warn, 2 block. WARN and BLOCK are spam in truth; only BLOCK rejects."""
    y, v = F.col(truth), F.col(predicted)
    spam, hit = y >= 1, v >= 2
    counts = df.agg(
        F.count_if(hit & spam).alias("tp_block"),
        F.count_if(hit & ~spam).alias("fp_block"),
        F.count_if(~hit & spam).alias("fn_block"),
        F.count_if(~hit & ~spam).alias("tn_block"),
        F.count_if((v >= 1) & (y == 0)).alias("allow_flagged"),
        F.count_if(y == 0).alias("true_allow_count"),
        F.count_if(v == y).alias("right"),
        F.count(F.lit(1)).alias("total"),
    )
    p, r, f = _rates(F.col("tp_block"), F.col("fp_block"), F.col("fn_block"))
    return counts.select(
        p.alias("block_precision"), r.alias("block_recall"), f.alias("block_f1"),
        ratio(F.col("allow_flagged"), F.col("true_allow_count")).alias("allow_fp_rate"),
        ratio(F.col("right"), F.col("total")).alias("accuracy"),
        "tp_block", "fp_block", "fn_block", "tn_block", "total",
        (F.col("tp_block") + F.col("fn_block")).alias("true_spam_count"), "true_allow_count",
    )


def binary_metrics(df: DataFrame, truth: str, score: str, threshold: float) -> DataFrame:
    """One row of rates of ``score >= threshold`` against a 0/1 truth."""
    hit = micro(F.col(score)) >= round(threshold * MICRO)
    y = F.col(truth) == 1
    counts = df.agg(
        F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
        F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p, r, f = _rates(tp, fp, fn)
    return counts.select(
        F.lit(threshold).alias("threshold"), "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"),
        ratio(tn, tn + fp).alias("specificity"), f.alias("f1"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


# --- threshold sweeps -------------------------------------------------------


def score_counts(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """Positives and negatives per score in millionths."""
    return df.groupBy(micro(score).alias("s")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def sweep(counts: DataFrame, first: int, last: int) -> DataFrame:
    """tp, fp, fn, tn for the thresholds first/100 ... last/100 in steps of 1/100."""
    spark = counts.sparkSession
    grid = spark.range(first, last + 1).select(F.col("id").alias("cent"), F.lit(0).alias("pos"), F.lit(0).alias("neg"))
    cents = F.least(F.greatest(F.floor(F.col("s") / CENT), F.lit(first - 1)), F.lit(last))
    binned = counts.groupBy(cents.alias("cent")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cells = binned.unionByName(grid).groupBy("cent").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # At most last - first + 2 rows from here on.
    above = Window.orderBy(F.desc("cent"))
    whole = Window.partitionBy()
    out = cells.select(
        "cent",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(whole).alias("_p"),
        F.sum("neg").over(whole).alias("_n"),
    ).filter(F.col("cent") >= first)
    out = out.select(
        (F.col("cent") / 100.0).alias("threshold"), "cent", "tp", "fp",
        (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn"),
    )
    p, r, f = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.withColumns({
        "precision": p, "recall": r, "f1": f,
        "fp_rate": ratio(F.col("fp"), F.col("fp") + F.col("tn")),
    })


def _best(rows: DataFrame, value: str, lowest: bool, keep: list[str]) -> Column:
    """Struct of the best sweep row; the lowest (or highest) threshold wins ties."""
    order = F.struct(F.col(value), (-F.col("cent")) if lowest else F.col("cent"))
    return rows.agg(F.max_by(F.struct(*keep), order)).scalar()


ROW = ["threshold", "cent", "precision", "recall", "f1"]


def _pair_counts(df: DataFrame, truth: str, block: str, warn: str) -> DataFrame:
    """Counts per (block cent, warn cent, class): at most 101 x 101 x 3 rows."""
    return df.groupBy(
        F.floor(micro(F.col(block)) / CENT).alias("b"), F.floor(micro(F.col(warn)) / CENT).alias("w"), F.col(truth).alias("y")
    ).agg(F.count(F.lit(1)).alias("n"))


def _pair_sweep(pairs: DataFrame, value: str, positive: Column, first: int, last: int) -> DataFrame:
    counts = pairs.groupBy((F.col(value) * CENT).alias("s")).agg(
        F.sum(F.when(positive, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(positive, F.lit(0)).otherwise(F.col("n"))).alias("neg"),
    )
    return sweep(counts, first, last)


def _warn_sweep(pairs: DataFrame, block_cent: Column, first: int, last: int) -> DataFrame:
    """Rows at or above the block threshold are never warned, but still count as missed."""
    free = pairs.withColumn("w", F.when(F.col("b") >= block_cent, F.lit(first - 1)).otherwise(F.col("w")))
    return _pair_sweep(free, "w", F.col("y") == 1, first, last)


def tune_three_class(df: DataFrame, truth: str, block: str, warn: str, floor: float) -> DataFrame:
    """Block threshold in .10-.95 with the best F1 above the precision floor, then the warn
    threshold in .10-.85 with the best WARN F1. The lowest threshold wins ties."""
    pairs = _pair_counts(df, truth, block, warn)
    rows = _pair_sweep(pairs, "b", F.col("y") == 2, 10, 95)
    best = _best(rows.filter((F.col("precision") >= floor) & (F.col("f1") > 0)), "f1", True, ROW)
    cent = F.coalesce(best["cent"], F.lit(50))
    warned = _warn_sweep(pairs, cent, 10, 85)
    best_warn = _best(warned.filter(F.col("f1") > 0), "f1", True, ROW)
    return df.sparkSession.range(1).select(
        F.coalesce(best["threshold"], F.lit(0.50)).alias("block_threshold"),
        F.coalesce(best["precision"], F.lit(0.0)).alias("block_precision"),
        F.coalesce(best["recall"], F.lit(0.0)).alias("block_recall"),
        F.coalesce(best["f1"], F.lit(0.0)).alias("block_f1"),
        F.coalesce(best_warn["threshold"], F.lit(0.30)).alias("warn_threshold"),
        F.coalesce(best_warn["f1"], F.lit(0.0)).alias("warn_f1"),
    )


def tune_three_class_recall(df: DataFrame, truth: str, block: str, warn: str, floor: float = 0.90) -> DataFrame:
    """Block threshold in .05-.95 with the best recall above the floor, highest on ties; warn
    threshold in .10-.60 with the best WARN F1, lowest on ties."""
    pairs = _pair_counts(df, truth, block, warn)
    rows = _pair_sweep(pairs, "b", F.col("y") == 2, 5, 95)
    best = _best(rows.filter(F.col("precision") >= floor), "recall", False, ROW)
    cent = F.coalesce(best["cent"], F.lit(50))
    best_warn = _best(_warn_sweep(pairs, cent, 10, 60).filter(F.col("f1") > 0), "f1", True, ROW)
    return df.sparkSession.range(1).select(
        F.coalesce(best["threshold"], F.lit(0.50)).alias("block_threshold"),
        F.coalesce(best["precision"], F.lit(0.0)).alias("block_precision"),
        F.coalesce(best["recall"], F.lit(0.0)).alias("block_recall"),
        F.coalesce(best_warn["threshold"], F.lit(0.30)).alias("warn_threshold"),
        F.coalesce(best_warn["f1"], F.lit(0.0)).alias("warn_f1"),
    )


def operating_points(df: DataFrame, positive: Column, score: str, floors: tuple[float, ...] = (0.95, 0.90, 0.80)) -> DataFrame:
    """Per precision floor the threshold in .10-.99 with the best recall, lowest on ties."""
    rows = sweep(score_counts(df, positive, F.col(score)), 10, 99)
    tried = rows.withColumn("floor", F.explode(F.array(*[F.lit(f) for f in floors])))
    good = (F.col("precision") >= F.col("floor")) & (F.col("recall") > 0)
    best = F.max_by(
        F.when(good, F.struct("threshold", "precision", "recall")),
        F.when(good, F.struct("recall", -F.col("cent"))),
    )
    return tried.groupBy("floor").agg(best.alias("b")).select(
        "floor",
        F.coalesce("b.threshold", F.lit(1.0)).alias("threshold"),
        F.coalesce("b.precision", F.lit(0.0)).alias("precision"),
        F.coalesce("b.recall", F.lit(0.0)).alias("recall"),
    )


def tune_binary(df: DataFrame, positive: Column, score: str, floor: float) -> DataFrame:
    """Block threshold by F1 above the floor; warn = the lowest of thirty thresholds below it whose
    band holds at least half positives, else block - .20."""
    counts = score_counts(df, positive, F.col(score))
    rows = sweep(counts, 10, 95)
    best = _best(rows.filter((F.col("precision") >= floor) & (F.col("f1") > 0)), "f1", True, ROW)
    spark = df.sparkSession
    chosen = spark.range(1).select(F.coalesce(best["cent"], F.lit(50)).alias("cent"))
    cent = chosen.scalar()
    # Thresholds .10 ... block - .05 in thirty even steps, in millionths. The steps go down when the
    # block threshold is below .15.
    step = (cent * CENT - 150_000) / F.lit(29.0)
    gap = F.col("s") - 100_000
    below = counts.filter(F.col("s") < cent * CENT)
    last_in = F.least(F.greatest(F.floor(gap / F.nullif(step, F.lit(0.0))), F.lit(-1)), F.lit(29))
    first_in = F.least(F.greatest(F.ceil(gap / F.nullif(step, F.lit(0.0))), F.lit(0)), F.lit(30))
    index = F.when(step > 0, last_in).when(step < 0, first_in).when(gap >= 0, F.lit(29)).otherwise(F.lit(-1))
    binned = below.groupBy(index.alias("i")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    grid = spark.range(30).select(F.col("id").alias("i"), F.lit(0).alias("pos"), F.lit(0).alias("neg"))
    cells = binned.unionByName(grid).groupBy("i").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # At most 32 rows.
    down, up = Window.orderBy(F.desc("i")), Window.orderBy("i")
    total = lambda c: F.when(step < 0, F.sum(c).over(up)).otherwise(F.sum(c).over(down))
    bands = cells.select("i", total("pos").alias("p"), total("neg").alias("n")).filter(F.col("i").between(0, 29))
    good = bands.filter((F.col("p") + F.col("n") > 0) & (F.col("p") / (F.col("p") + F.col("n")) >= 0.5))
    first = good.agg(F.min("i")).scalar()
    block = cent / 100.0
    fallback = F.greatest(F.lit(0.10), block - 0.20)
    warn = F.when(first.isNotNull(), F.lit(0.10) + first * ((block - 0.15) / 29.0)).otherwise(fallback)
    return spark.range(1).select(block.alias("block_threshold"), F.least(warn, block - 0.01).alias("warn_threshold"))


def gated_sweep(df: DataFrame, positive: Column, score: str, min_precision: float = 0.85,
                min_recall: float = 0.55, max_fp_rate: float = 0.20) -> DataFrame:
    """Threshold in .01-.50 with the best F1 that passes three gates; the best F1 when none does."""
    rows = sweep(score_counts(df, positive, F.col(score)), 1, 50)
    ok = (
        (F.col("precision") >= min_precision) & (F.col("recall") >= min_recall) & (F.col("fp_rate") <= max_fp_rate)
    )
    ranked = rows.withColumn("passes", ok)
    best = F.max_by(F.struct(*ranked.columns), F.struct("passes", "f1", -F.col("cent")))
    return ranked.agg(best.alias("b")).select("b.*").drop("cent")


# --- calibration and ranking ------------------------------------------------


def calibration_error(df: DataFrame, truth: str, score: str, bins: int = 15) -> DataFrame:
    """Weighted gap between mean score and mean truth over equal bins, the last one closed."""
    index = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    per = df.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("p"), F.avg(F.col(truth).cast("double")).alias("y")
    )
    return per.agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("p"))) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, truth: str, score: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(truth), F.lit(2))).alias("brier"))


def auc(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by ranks; equal scores share their rank. Input of ``score_counts``, per key if keys are named.

    Scores are first counted per cell of 1/100, so no task holds more than 10^4 scores of a key.
    """
    from .timeline import running

    own = keys or ["_one"]
    rows = counts if keys else counts.withColumn("_one", F.lit(1))
    placed = running(rows, own, "s", {"_below": ("sum", F.col("neg"))}, F.floor(F.col("s") / CENT))
    out = placed.groupBy(*own).agg(
        (F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2.0)) / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc")
    )
    return out if keys else out.select("auc")


def auc_one_vs_rest(df: DataFrame, truth: str, scores: dict[int, str]) -> DataFrame:
    """AUC of each class against the rest; all classes share one pass over the rows."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("class"), micro(F.col(c)).alias("s"), (F.col(truth) == k).alias("y")) for k, c in scores.items()])
        ).alias("x")
    ).select("x.*")
    counts = long.groupBy("class", "s").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    return auc(counts, ["class"])


def binned_mi(df: DataFrame, label: str, features: list[str], bins: int = 20) -> DataFrame:
    """Mutual information (nats) between the label and each feature in equal bins of [0, 1]."""
    long = df.select(
        F.col(label).alias("y"),
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("feature"), F.least(F.floor(F.col(f) * bins), F.lit(bins - 1)).alias("x")) for f in features])
        ).alias("c"),
    )
    cells = long.groupBy(F.col("c.feature").alias("feature"), F.col("c.x").alias("x"), "y").agg(F.count(F.lit(1)).alias("n"))
    # At most features x bins x classes rows.
    per = lambda *k: Window.partitionBy("feature", *k)
    n, nx, ny = F.sum("n").over(per()), F.sum("n").over(per("x")), F.sum("n").over(per("y"))
    term = (F.col("n") / n) * F.log(F.col("n") * n / (nx * ny).cast("double"))
    return cells.withColumn("_t", term).groupBy("feature").agg(F.sum("_t").alias("binned_mi"))


def ks_drift(reference: DataFrame, fresh: DataFrame, features: list[str], alpha: float = 0.01,
             cells: int = 64) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and asymptotic p-value per feature.

    Values are folded per distinct value, cut at approximate quantiles into cells and summed cell
    by cell; the cells only split the work, the distance is exact.
    """
    from .timeline import running

    def long(df: DataFrame, new: int) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
        return df.select(F.explode(pairs).alias("x"), F.lit(new).alias("new")).select("x.*", "new")

    both = long(reference, 0).unionByName(long(fresh, 1))
    counts = both.groupBy("feature", "v").agg(
        F.count_if(F.col("new") == 0).alias("a"), F.count_if(F.col("new") == 1).alias("b")
    )
    marks = F.array(*[F.lit((i + 1) / cells) for i in range(cells - 1)])
    cuts = both.groupBy("feature").agg(
        F.percentile_approx("v", marks, 10_000).alias("cuts"),
        F.count_if(F.col("new") == 0).alias("na"),
        F.count_if(F.col("new") == 1).alias("nb"),
    )
    # One row per feature, and the features are named by the caller.
    placed = counts.join(F.broadcast(cuts), "feature")
    cell = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    placed = running(
        placed, ["feature"], "v", {"ca": ("sum", F.col("a")), "cb": ("sum", F.col("b"))}, cell, inclusive=True
    )
    d = placed.groupBy("feature").agg(
        F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks"),
        F.first("na").alias("na"), F.first("nb").alias("nb"),
    )
    en = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    lam = (en + 0.12 + 0.11 / en) * F.col("ks")
    total = F.lit(0.0)
    for k in range(1, 51):
        total = total + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam * lam)
    p = F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))
    return d.select("feature", "ks", p.alias("ks_asymptotic_p"), (p < alpha).alias("drifted"))


def drift_verdict(per_feature: DataFrame, share: float = 0.30) -> DataFrame:
    return per_feature.agg(
        F.count(F.lit(1)).alias("features"),
        F.count_if("drifted").alias("drifted"),
        (F.count_if("drifted") / F.count(F.lit(1)) > share).alias("drift"),
    )


def permuted(df: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """The same rows with one column shuffled among them.

    Every row gets an exact position under two hash orders; the value of the row at position i of
    the second order goes to the row at position i of the first.
    """
    from .sample import hash_rank

    left = hash_rank(df, key, seed, "_pos")
    right = hash_rank(df.select(key, column), key, seed + 1, "_pos").select("_pos", F.col(column).alias("_value"))
    return left.join(right, "_pos").withColumn(column, F.col("_value")).select(*df.columns)


#: Rounds of a keyed permutation, and the primes its coin tosses are taken modulo.
ROUNDS, PRIMES = 24, (2_147_483_629, 2_147_483_647)


def permutation_keys(seed: int, which: int) -> list[tuple[int, int, int]]:
    """Per round an offset and the two factors of the coin, fixed by seed and number of the permutation."""
    draw = random.Random(f"{seed}:{which}")
    return [(draw.getrandbits(60), draw.randrange(1, PRIMES[1]), draw.randrange(PRIMES[1])) for _ in range(ROUNDS)]


def permutation(position: Column, n: Column, keys: list[tuple[int, int, int]]) -> Column:
    """A position in 0 .. n-1 under a keyed bijection of 0 .. n-1: rounds that swap x and k - x (mod n), or do not.

    Both partners of a swap see the same coin, a hash of the greater one, so every round is its own inverse.
    """
    rounds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in keys])

    def toss(x: Column, r: Column) -> Column:
        partner = F.pmod(r["k"] - x, n)
        coin = ((F.greatest(x, partner) % PRIMES[0]) * r["a"] + r["b"]) % PRIMES[1]
        return F.when(coin % 2 == 1, partner).otherwise(x)

    return F.aggregate(rounds, position, toss)


def permutation_importance(
    df: DataFrame, key: str, truth: Column, score: Column, features: list[str], repeats: int = 10, seed: int = 42
) -> DataFrame:
    """Mean drop of AUC when a feature is shuffled; ``score`` is an expression over the features.

    Every row gets one exact position by hash. For each feature and repeat a keyed permutation of the
    positions says whose value a row gets, so all of them go through one exchange and one plan.
    """
    from .sample import hash_rank

    ranked = hash_rank(df.select(key, truth.alias("_truth"), *features), key, seed, "_pos").withColumn("_pos", F.col("_pos") - 1)
    ranked = write_once(ranked.drop(key), "positions")
    n = F.lit(ranked.count()).cast("bigint")
    moves = [F.struct(F.lit(-1).alias("which"), F.col("_pos").alias("to"), F.lit(None).cast("double").alias("value"))]
    for i, name in enumerate(features):
        for r in range(repeats):
            w = i * repeats + r
            moves.append(F.struct(F.lit(w).alias("which"), permutation(F.col("_pos"), n, permutation_keys(seed, w)).alias("to"), F.col(name).cast("double").alias("value")))
    sent = ranked.select(F.explode(F.array(*moves)).alias("m")).select(F.col("m.to").alias("_pos"), F.col("m.which").alias("_which"), F.col("m.value").alias("_value"))
    feature = F.floor(F.col("_which") / repeats)
    met = sent.join(ranked, "_pos").withColumns(
        {name: F.when((F.col("_which") >= 0) & (feature == i), F.col("_value")).otherwise(F.col(name)) for i, name in enumerate(features)})
    counts = met.groupBy("_which", micro(score).alias("s")).agg(F.count_if("_truth").alias("pos"), F.count_if(~F.col("_truth")).alias("neg"))
    areas = write_once(auc(counts, ["_which"]), "areas")
    base = areas.filter("_which = -1").select("auc").scalar()
    named = F.array(*[F.lit(name) for name in features])
    drops = areas.filter("_which >= 0").select(F.get(named, feature.cast("int")).alias("feature"), (base - F.col("auc")).alias("drop"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance"))


# --- gates ------------------------------------------------------------------


def failed_gates(metrics: DataFrame, floors: dict[str, float], ceilings: dict[str, float] | None = None) -> DataFrame:
    """One row per gate that is not met; a missing or NaN metric fails."""
    tests = []
    for name, limit in floors.items():
        v = F.col(name)
        bad = v.isNull() | F.isnan(v) | (v < limit)
        tests.append(F.when(bad, F.struct(F.lit(name).alias("metric"), v.alias("value"), F.lit(limit).alias("bound"), F.lit("min").alias("kind"))))
    for name, limit in (ceilings or {}).items():
        v = F.col(name)
        bad = v.isNull() | F.isnan(v) | (v > limit)
        tests.append(F.when(bad, F.struct(F.lit(name).alias("metric"), v.alias("value"), F.lit(limit).alias("bound"), F.lit("max").alias("kind"))))
    return metrics.select(F.explode(F.array_compact(F.array(*tests))).alias("g")).select("g.*")


def promotion(candidate: DataFrame, baseline: DataFrame, recall_slack: float = 0.05) -> DataFrame:
    """May a candidate replace the baseline? Candidates carry precision, recall and gate_passed;
    the baseline has one row or none."""
    b = baseline.agg(F.struct(F.max("precision").alias("p"), F.max("recall").alias("r"), F.count(F.lit(1)).alias("n"))).scalar()
    gate, p, r = F.col("gate_passed"), F.col("precision"), F.col("recall")
    gaps = p.isNull() | r.isNull() | b["p"].isNull() | b["r"].isNull()
    low_p, low_r = p < b["p"], r < b["r"] - recall_slack

    def answer(ok: bool, why: str) -> Column:
        return F.struct(F.lit(ok).alias("eligible"), F.lit(why).alias("reason"))

    verdict = (
        F.when(gate == F.lit(False), answer(False, "gate_failed"))
        .when((b["n"] == 0) & gate, answer(True, "gate_passed_no_baseline"))
        .when(b["n"] == 0, answer(False, "gate_unknown_no_baseline"))
        .when(gaps & gate, answer(True, "gate_passed_metrics_incomplete"))
        .when(gaps, answer(False, "metrics_incomplete"))
        .when(low_p & low_r, answer(False, "precision_and_recall_below_baseline"))
        .when(low_p, answer(False, "precision_below_baseline"))
        .when(low_r, answer(False, "recall_dropped"))
        .otherwise(answer(True, "meets_baseline"))
    )
    return candidate.withColumn("_v", verdict).select(*candidate.columns, "_v.*")


def best_model(metrics: DataFrame, rank: list[str], order: str) -> DataFrame:
    """The model with the greatest rank columns; the first in ``order`` wins ties."""
    best = F.max_by(F.struct(*metrics.columns), F.struct(*rank, -F.col(order)))
    return metrics.agg(best.alias("b")).select("b.*")
