"""Model fitting, calibration, soft targets and per-user online learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numeric import clip, logit, sigmoid
from ..operators import evaluate
from ..operators.aggregate import class_balanced_weights
from ..operators.sample import row_hash, uniform
from ..operators.sizing import lookup_join, write_once

# --- batch models -----------------------------------------------------------


def with_class_weight(df: DataFrame, label: str, classes: int) -> DataFrame:
    """Inverse-frequency weight per row."""
    weights = class_balanced_weights(df, label, classes).select(label, F.col("weight").alias("class_weight"))
    return lookup_join(df, write_once(weights, "class-weights"), [label])


def logistic(features: list[str], label: str, weight: str | None = None, reg: float = 0.0) -> Pipeline:
    lr = LogisticRegression(featuresCol="scaled", labelCol=label, regParam=reg, maxIter=50)
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True, withStd=True),
        lr,
    ])


def forest(features: list[str], label: str, weight: str | None = None, trees: int = 250, depth: int = 12,
           seed: int = 42) -> Pipeline:
    rf = RandomForestClassifier(featuresCol="raw_features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    if weight:
        rf = rf.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw_features"), rf])


def score(model: Model, df: DataFrame, names: list[str]) -> DataFrame:
    """Class probabilities under the given names, model columns dropped."""
    out = model.transform(df).withColumn("_p", vector_to_array("probability"))
    for i, name in enumerate(names):
        out = out.withColumn(name, F.col("_p")[i])
    return out.drop("_p", "raw_features", "scaled", "rawPrediction", "probability", "features")


# --- calibration ------------------------------------------------------------


def platt(df: DataFrame, truth: str, score_col: str) -> tuple[float, float]:
    """a, b of sigmoid(a z + b) on the logit, with smoothed targets.

    A smoothed target t is two weighted rows: class 1 with weight t, class 0 with weight 1 - t.
    """
    counts = df.agg(F.struct(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))).scalar()
    high, low = (counts["p"] + 1.0) / (counts["p"] + 2.0), 1.0 / (counts["n"] + 2.0)
    target = F.when(F.col(truth) == 1, high).otherwise(low)
    base = df.select(logit(F.col(score_col)).alias("z"), target.alias("t"))
    rows = base.select(
        "z", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("t").alias("w")), F.struct(F.lit(0.0).alias("y"), (1.0 - F.col("t")).alias("w")))).alias("r")
    ).select("z", "r.*")
    rows = VectorAssembler(inputCols=["z"], outputCol="v").transform(rows)
    fit = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", standardization=False, maxIter=100, tol=1e-9).fit(rows)
    return float(fit.coefficients[0]), float(fit.intercept)


def platt_map(score_col: Column, a: float, b: float) -> Column:
    return sigmoid(F.lit(a) * logit(score_col) + F.lit(b))


#: How many parts of the score line are merged at a time when blocks are pooled.
POOL_FAN = 16


def _pooled(group: pa.Table) -> pa.Table:
    """Adjacent blocks pooled until their means rise; one row per block, in score order."""
    group = group.sort_by("first")
    blocks: list[list[float]] = []
    for first, last, total, n in zip(*(group.column(c).to_pylist() for c in ("first", "last", "total", "n"))):
        blocks.append([first, last, total, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, last, total, n = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + total, blocks[-1][3] + n]
    columns = list(zip(*blocks))
    cell = pa.array([group.column("cell")[0].as_py()] * len(blocks), pa.int64())
    return pa.table({"cell": cell, "first": pa.array(columns[0], pa.int64()), "last": pa.array(columns[1], pa.int64()),
                     "total": pa.array(columns[2], pa.float64()), "n": pa.array(columns[3], pa.int64())})


def isotonic_blocks(df: DataFrame, truth: str, score_col: str) -> DataFrame:
    """The blocks of a monotone fit: first, last (scores in millionths), value.

    Equal scores are folded first. The score line is cut into cells, each cell is pooled on its own,
    and the blocks of neighbouring cells are pooled again until one cell is left: pooling the pooled
    gives what pooling everything at once would.
    """
    schema = "cell bigint, first bigint, last bigint, total double, n bigint"
    folded = df.groupBy(evaluate.micro(F.col(score_col)).alias("first")).agg(
        F.sum(F.col(truth).cast("double")).alias("total"), F.count(F.col(truth)).alias("n")).filter("first is not null and n > 0")
    cells = (evaluate.MICRO + evaluate.CENT) // evaluate.CENT
    blocks = folded.select(
        F.greatest(F.lit(0), F.least(F.lit(cells), F.floor(F.col("first") / evaluate.CENT))).alias("cell"), "first", F.col("first").alias("last"), "total", "n")
    blocks = blocks.groupBy("cell").applyInArrow(_pooled, schema)
    while cells:
        cells //= POOL_FAN
        blocks = blocks.withColumn("cell", F.floor(F.col("cell") / POOL_FAN)).groupBy("cell").applyInArrow(_pooled, schema)
    return blocks.select("first", "last", (F.col("total") / F.col("n")).alias("value"))


def isotonic(df: DataFrame, truth: str, score_col: str, out: str = "calibrated", on: DataFrame | None = None) -> DataFrame:
    """Monotone calibration: a score inside a block takes its value, one between two blocks lies on the line between them.

    ``on`` names other rows to calibrate. At most 10^6 + 1 blocks go out, as scores are told at six decimals.
    """
    rows = write_once(isotonic_blocks(df, truth, score_col), "blocks").orderBy("first").toArrow()
    ends = np.stack([rows.column("first").to_numpy(), rows.column("last").to_numpy()], axis=1).ravel() / float(evaluate.MICRO)
    values = np.repeat(rows.column("value").to_numpy(), 2)
    if not len(ends):
        return (df if on is None else on).withColumn(out, F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def line(scores: pd.Series) -> pd.Series:
        return pd.Series(np.interp(scores.to_numpy(dtype=float), ends, values)).where(scores.notna().to_numpy())

    return (df if on is None else on).withColumn(out, line(F.col(score_col)))


# --- validation and search --------------------------------------------------


def folds(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """Add ``fold``, 0 to k - 1, cut by hash."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(row_hash(key, seed), 1, 8), 16, 10).cast("bigint"), F.lit(k)))


def objective(per_class: DataFrame, block: object, floor: float) -> DataFrame:
    """Macro-F1 less 0.3 times what the block precision falls short of its floor."""
    row = per_class.agg(F.avg("f1").alias("macro_f1"), F.max(F.when(F.col("class") == block, F.col("precision"))).alias("block_precision"))
    gap = F.greatest(F.lit(0.0), F.lit(floor) - F.col("block_precision"))
    return row.select("macro_f1", "block_precision", (F.col("macro_f1") - 0.3 * gap).alias("objective"))


def k_fold_metrics(df: DataFrame, key: str, features: list[str], label: str, classes: int, k: int = 5, seed: int = 42) -> DataFrame:
    """Macro metrics per fold; folds are cut by hash."""
    folded = write_once(folds(df.select(key, *features, label), key, k, seed), "folds")
    out = None
    for i in range(k):
        model = logistic(features, label).fit(folded.filter(F.col("fold") != i))
        tested = model.transform(folded.filter(F.col("fold") == i))
        per = evaluate.per_class_metrics(tested, label, "prediction", [float(c) for c in range(classes)])
        row = per.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("macro_f1"))
        row = row.withColumn("fold", F.lit(i))
        out = row if out is None else out.unionByName(row)
    return out


def search(train: DataFrame, test: DataFrame, features: list[str], label: str, classes: int, block: int,
           floor: float, grid: list[float]) -> DataFrame:
    """Grid over the regularisation with objective macro-F1 - 0.3 * shortfall of block precision."""
    train, test = write_once(train.select(*features, label), "search-train"), write_once(test.select(*features, label), "search-test")
    out = None
    for i, reg in enumerate(grid):
        tested = logistic(features, label, reg=reg).fit(train).transform(test)
        per = evaluate.per_class_metrics(tested, label, "prediction", [float(c) for c in range(classes)])
        row = objective(per, float(block), floor).select(F.lit(i).alias("ord"), F.lit(reg).alias("reg"), "*")
        out = row if out is None else out.unionByName(row)
    return out


#: Rows of a cell, and cells in which near rows of a row are looked for, its own among them.
CELL_ROWS, TABLES = 2048, 8
#: Cells that one task holds as one, and parts of a cell whose rows are compared as a whole.
ROOM, LEAVES = 16, 16


def _smallest(d: np.ndarray, m: int) -> np.ndarray:
    """Columns of the m smallest values of every row, of equal ones the first; no row is sorted as a whole."""
    edge = np.partition(d, m - 1, axis=1)[:, m - 1 : m]
    taken, level = d < edge, d == edge
    taken |= level & (np.cumsum(level, axis=1, dtype=np.int32) <= m - taken.sum(axis=1, keepdims=True))
    return np.nonzero(taken)[1].reshape(len(d), m)


def _points(column: pa.Array | pa.ChunkedArray, wide: int) -> np.ndarray:
    """Lists of ``wide`` numbers as a matrix; null reads as nan."""
    flat = pc.list_flatten(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, wide)


def _cells(laid: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of the cell of every row. ``cuts[i][node]`` are the cuts along way i of a part that the ways before it left."""
    node = np.zeros(len(laid), dtype=np.int64)
    for i, cut in enumerate(cuts):
        node = node * (cut.shape[1] + 1) + (cut[node] < laid[:, i : i + 1]).sum(axis=1)
    return node


def _reached(laid: np.ndarray, cuts: list[np.ndarray], edge: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell for the nearest cells, ``most`` a row at most, that could hold a row nearer than the root of ``edge``; not its own cell."""
    own, row, node, gap = _cells(laid, cuts), np.arange(len(laid)), np.zeros(len(laid), dtype=np.int64), np.zeros(len(laid))
    for i, cut in enumerate(cuts):
        x, end = laid[row, i : i + 1], np.full((len(row), 1), np.inf)
        low, high = np.concatenate([-end, cut[node]], axis=1), np.concatenate([cut[node], end], axis=1)
        wide = gap[:, None] + np.maximum(np.maximum(low - x, x - high), 0) ** 2
        at, part = np.nonzero(wide < edge[row][:, None])
        row, node, gap = row[at], node[at] * low.shape[1] + part, wide[at, part]
    other = node != own[row]
    order = np.lexsort((gap[other], row[other]))
    row, node = row[other][order], node[other][order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < most
    return row[first], node[first]


def _leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Numbers of the rows of each leaf, in order: rows are halved along their widest side until ``most`` at most are left."""
    done, left = [], [np.arange(len(points))]
    while left:
        at = left.pop()
        if len(at) <= most:
            done.append(at)
            continue
        part = points[at]
        order = np.argsort(part[:, np.ptp(part, axis=0).argmax()], kind="stable")
        left += [np.sort(at[order[len(at) // 2 :]]), np.sort(at[order[: len(at) // 2]])]
    return done


def _nearest(points: np.ndarray, k: int, most: int, asked: np.ndarray | None = None, edge: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the k nearest points of every asked row, -1 where there are fewer; ``edge`` is the squared distance that they must stay below.

    Without ``asked`` the points ask for each other: the leaf of a row bounds what it looks for elsewhere.
    A leaf is compared with the rows only for which it may hold a nearer point.
    """
    leaves, own = _leaves(points, most) if len(points) else [], asked is None
    asked = points if own else asked
    edge = np.full(len(asked), np.inf) if edge is None else edge.copy()
    near, apart = np.full((len(asked), k), -1), np.full((len(asked), k), np.inf)

    def meet(at: np.ndarray, rows: np.ndarray, part: np.ndarray, same: bool) -> None:
        # Distances from the middle of the leaf, so that little is lost where its rows are near.
        middle = part.mean(axis=0)
        p, q = part - middle, asked[rows] - middle
        pp, qq = (p**2).sum(axis=1), (q**2).sum(axis=1)
        d = qq[:, None] + pp[None, :] - 2 * q @ p.T
        if same:
            d[np.arange(len(d)), np.arange(len(d))] = np.inf
        # What is nearer only by rounding is not nearer.
        hit = d < (edge[rows] - 1e-15 * (qq + pp.max()))[:, None]
        some = np.flatnonzero(hit.any(axis=1))
        if len(some):
            rows = rows[some]
            both = np.concatenate([apart[rows], np.where(hit[some], d[some], np.inf)], axis=1)
            taken = _smallest(both, k)
            near[rows] = np.take_along_axis(np.concatenate([near[rows], np.broadcast_to(at, (len(rows), len(at)))], axis=1), taken, axis=1)
            apart[rows] = np.take_along_axis(both, taken, axis=1)
            edge[rows] = np.minimum(edge[rows], apart[rows].max(axis=1))

    with np.errstate(all="ignore"):
        of = np.empty(len(points), dtype=np.int64)
        for i, at in enumerate(leaves):
            of[at] = i
            if own:
                meet(at, at, points[at], True)
        for i, at in enumerate(leaves):
            part = points[at]
            beyond = np.maximum(np.maximum(part.min(axis=0) - asked, asked - part.max(axis=0)), 0)
            open_ = np.einsum("ij,ij->i", beyond, beyond) < edge
            rows = np.flatnonzero(open_ & (of != i) if own else open_)
            for j in range(0, len(rows), 1024):
                meet(at, rows[j : j + 1024], part, False)
    return near


def _once(keys: pa.Array, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows without repeats of key and point, and for every row which of them it is."""
    codes = keys.dictionary_encode(null_encoding="encode")
    if len(codes.dictionary) == len(keys):
        return np.arange(len(keys)), np.arange(len(keys))
    _, first, of = np.unique(np.column_stack([codes.indices, points]), axis=0, return_index=True, return_inverse=True)
    return first, of.ravel()


def _listed(keys: pa.Array, asked: np.ndarray, points: np.ndarray, near: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    """The near rows of every asked row as a list of squared distance and key, and the k-th of the distances."""
    there = near >= 0
    gaps = asked[np.repeat(np.arange(len(near)), there.sum(axis=1))] - points[near[there]]
    apart = np.full(near.shape, np.inf)
    apart[there] = (gaps**2).sum(axis=1)
    pairs = pa.StructArray.from_arrays([pa.array(apart[there]), keys.take(pa.array(near[there]))], names=["_d", "_near"])
    ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pairs), np.sort(apart, axis=1)[:, k - 1]


def near_rows(df: DataFrame, key: str, features: list[str], k: int = 5, seed: int = 42, tables: int = TABLES,
              cell_rows: int = CELL_ROWS) -> DataFrame:
    """key, near (keys of the k nearest rows found), distance: one row per row of ``df``; keys are unique.

    Rows are cut into cells at quantiles along random directions at right angles, each direction inside
    the parts that the ones before it left, so that a task gets about ``ROOM * cell_rows`` rows whatever
    their number. All near rows inside a cell are found; then a row asks the nearest other cells that
    could hold nearer ones, ``tables`` with its own at most. Ties go to the smaller key of a leaf. Of a
    row with unknown values nothing is near; it takes the first rows of its cell.
    """
    spark, wide = df.sparkSession, len(features)
    rows = write_once(df.select(key, F.array(*[F.col(f).cast("double") for f in features]).alias("_p"), F.xxhash64(key).alias("_h")), "points")
    n, room, leaf = rows.count(), ROOM * cell_rows, max(k + 1, cell_rows // LEAVES)
    cells = max(1, -(-n // room))
    turns = max(1, min(wide, int(np.log2(cells)) if cells > 1 else 1))
    ways = np.linalg.qr(np.random.default_rng(seed).normal(size=(wide, turns)))[0]
    cuts: list[np.ndarray] = []
    nodes = 1
    for i in range(turns if cells > 1 else 0):
        parts = int(np.ceil(round((cells / nodes) ** (1.0 / (turns - i)), 9)))

        def along(batches: Iterator[pa.RecordBatch], i: int = i, before: list[np.ndarray] = list(cuts)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                laid = _points(batch.column(0), wide) @ ways
                laid = laid[np.isfinite(laid).all(axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(_cells(laid, before)), pa.array(laid[:, i])], names=["node", "x"])

        marks = F.array(*[F.lit((j + 1) / parts) for j in range(parts - 1)])
        cut = np.full((nodes, parts - 1), np.inf)
        # At most as many rows as cells.
        found = rows.select("_p").mapInArrow(along, "node bigint, x double").groupBy("node").agg(F.percentile_approx("x", marks, 1000).alias("cuts"))
        for row in found.collect() if parts > 1 else []:
            cut[row.node] = row.cuts
        cuts.append(cut)
        nodes *= parts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _points(batch.column(0), wide)
            cell = _cells(points @ ways, cuts)
            part = np.where(piled(points), batch.column(1).to_numpy() % shares[cell], 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), batch.column(1), pa.array(starts[cell] + part)], names=[key, "_p", "_h", "_g"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = np.bincount(_cells(_points(batch.column(0), wide) @ ways, cuts), minlength=nodes)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(count)), pa.array(count[count > 0])], names=["cell", "n"])

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _points(batch.column(0), wide)
            yield batch.filter(pa.array((shares > 1)[_cells(points @ ways, cuts)] & np.isfinite(points).all(axis=1)))

    def piled(points: np.ndarray) -> np.ndarray:
        unknown = ~np.isfinite(points).all(axis=1)
        return unknown | np.fromiter((p.tobytes() in piles for p in points + 0.0), bool, len(points)) if piles else unknown

    # Equal points, and unknown ones, pile up in one cell: these are dealt to parts that keep more rows than are looked
    # for. The others stay together in the first part, which is the one that other cells ask.
    shares = np.ones(nodes, dtype=np.int64)
    for row in rows.select("_p").mapInArrow(number, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        shares[row.cell] = -(-row.n // (4 * room))
    starts = np.cumsum(shares) - shares
    piles: set[bytes] = set()
    if (shares > 1).any():
        # At most as many rows as cells.
        often = rows.select("_p").mapInArrow(crowded, "_p array<double>").groupBy("_p").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > room)
        piles = {(np.array(row._p) + 0.0).tobytes() for row in often.collect()}
    key_type = df.schema[key].dataType.simpleString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = f"`{key}` {key_type}, _b array<struct<_d:double,_near:{key_type}>>"

    def inside(group: pa.Table) -> pa.Table:
        group = group.sort_by(key)
        keys, points = group.column(key).combine_chunks(), _points(group.column("_p"), wide)
        first, of = _once(keys, points)
        known = np.isfinite(points[first]).all(axis=1)
        rows, rest = np.flatnonzero(known), np.flatnonzero(~known)
        near = np.full((len(first), k + 1), -1)
        found = _nearest(points[first[rows]], k, leaf)
        near[rows, :k] = -np.sort(-np.where(found >= 0, rows[found], -1), axis=1) if len(rows) else found
        few = min(k, max(0, len(rows) - 1))
        near[rows, few : few + len(rest[: k - few])] = rest[: k - few]
        near[rest, : min(k, len(first))] = np.arange(min(k, len(first)))
        for i in rest[rest < k]:
            others = np.delete(np.arange(min(k + 1, len(first))), i)
            near[i, :k] = np.concatenate([others, np.full(k - len(others), -1)])
        # A row that is there twice is the nearest of itself.
        twice = known & (np.bincount(of, minlength=len(first)) > 1)
        near[twice, k] = np.flatnonzero(twice)
        near = np.where(near >= 0, first[near], -1)[of] if len(first) else near
        rows = np.flatnonzero(known[of])
        lists, edge = _listed(keys, points, points, near, k)
        edge[np.isnan(edge)] = np.inf
        out = pa.table({key: keys, "_p": group.column("_p"), "_h": group.column("_h"), "_g": group.column("_g"), "_edge": edge, "_b": lists})
        asks, cell = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        step = max(1, min(1024, (1 << 22) // nodes))
        for j in range(0, len(rows) if cuts else 0, step):
            at = rows[j : j + step]
            row, node = _reached(points[at] @ ways, cuts, edge[at], tables - 1)
            asks.append(at[row])
            cell.append(node)
        asks, cell = np.concatenate(asks), np.concatenate(cell)
        ends = np.searchsorted(asks, np.arange(len(keys) + 1)).astype(np.int32)
        return out.append_column("_to", pa.ListArray.from_arrays(pa.array(ends), pa.array(starts[cell])))

    def across(group: pa.Table) -> pa.Table:
        group = group.sort_by(key)
        keys, points, own = group.column(key).combine_chunks(), _points(group.column("_p"), wide), group.column("_at").to_numpy() == 0
        held, asks = np.flatnonzero(own & np.isfinite(points).all(axis=1)), np.flatnonzero(~own)
        held = held[_once(keys.take(pa.array(held)), points[held])[0]]
        near = _nearest(points[held], k, leaf, points[asks], group.column("_edge").to_numpy()[asks])
        some = (near >= 0).any(axis=1)
        lists, _ = _listed(keys.take(pa.array(held)), points[asks[some]], points[held], near[some], k)
        return pa.table({key: keys.take(pa.array(asks[some])), "_b": lists})

    put = rows.select("_p", "_h", key).mapInArrow(place, f"`{key}` {key_type}, _p array<double>, _h bigint, _g bigint")
    # Rows are few bytes and much work: they are dealt to as many tasks as the session names.
    kept = f"`{key}` {key_type}, _p array<double>, _h bigint, _g bigint, _edge double, _b array<struct<_d:double,_near:{key_type}>>, _to array<bigint>"
    own = put.repartition(tasks, "_g").groupBy("_g").applyInArrow(inside, kept)
    if not cuts:
        found = own.select(key, "_b")
    else:
        own = write_once(own, "near-inside")
        # A cell that very many rows ask is held by several tasks; at most as many rows as cells.
        crowd = own.select(F.explode("_to").alias("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 8 * room).collect()
        sent = own.select(key, "_p", "_h", "_edge", F.posexplode(F.concat(F.array("_g"), "_to")).alias("_at", "_g"))
        copy = F.lit(0).cast("bigint")
        if crowd:
            times = F.create_map(*[F.lit(v).cast("bigint") for r in crowd for v in (r._g, -(-r.n // (8 * room)))])[F.col("_g")]
            sent = sent.withColumn("_times", F.coalesce(times, F.lit(1).cast("bigint")))
            every = F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1)
            copy = F.explode(F.when(F.col("_at") == 0, every).otherwise(F.array(F.pmod("_h", "_times"))))
        sent = sent.select(key, "_p", "_edge", "_at", "_g", copy.alias("_copy")).repartition(tasks, "_g", "_copy")
        found = own.select(key, "_b").unionByName(sent.groupBy("_g", "_copy").applyInArrow(across, listed))
    # A pair that was found from several cells has the same distance in each.
    best = found.groupBy(key).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_b")))), 1, k).alias("_b")).filter(F.size("_b") > 0)
    return best.select(key, F.col("_b._near").alias("near"), F.sqrt(F.col("_b")[F.size("_b") - 1]["_d"]).alias("distance"))


def smote(df: DataFrame, label: str, minority: object, key: str, features: list[str], copies: int, k: int = 5,
          seed: int = 42, tables: int = TABLES, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Synthetic minority rows on the line between a row and one of its k nearest rows.

    ``parent`` names the other row and ``t`` the place between the two; both are drawn by hash. A class
    of one row has no near row and gets no copies.
    """
    few = df.filter(F.col(label) == minority)
    near = near_rows(few, key, features, k, seed, tables, cell_rows)
    unit = F.concat_ws(":", F.col(key), F.col("copy"))
    drawn = near.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    drawn = drawn.select(key, "copy", F.get("near", F.floor(uniform(unit, seed) * F.size("near")).cast("int")).alias("parent"), uniform(unit, seed + 1).alias("t"))
    own, other = few.select(key, *features), few.select(F.col(key).alias("parent"), F.struct(*features).alias("_o"))
    return drawn.join(own, key).join(other, "parent").select(
        F.col(key), "copy", "parent", "t", F.lit(minority).alias(label),
        *[(F.col(n) + F.col("t") * (F.col(f"_o.{n}") - F.col(n))).alias(n) for n in features],
    )


# --- teacher and student ----------------------------------------------------


def teacher_scores(df: DataFrame, features: list[str], label: str, classes: int, rounds: int = 20, depth: int = 5,
                   on: DataFrame | None = None) -> DataFrame:
    """Boosted trees one against the rest; scores are normalised to sum to one. ``on`` names other rows to score."""
    assembler = VectorAssembler(inputCols=features, outputCol="raw_features")
    train = assembler.transform(df)
    out = train if on is None else assembler.transform(on)
    for c in range(classes):
        target = train.withColumn("_y", (F.col(label) == c).cast("double"))
        fit = GBTClassifier(featuresCol="raw_features", labelCol="_y", maxIter=rounds, maxDepth=depth, seed=42).fit(target)
        fit.setProbabilityCol(f"_prob{c}").setRawPredictionCol(f"_raw{c}").setPredictionCol(f"_pred{c}")
        out = fit.transform(out).withColumn(f"_s{c}", vector_to_array(f"_prob{c}")[1]).drop(f"_prob{c}", f"_raw{c}", f"_pred{c}")
    total = sum((F.col(f"_s{c}") for c in range(1, classes)), F.col("_s0"))
    return out.withColumns({f"teacher_{c}": F.col(f"_s{c}") / total for c in range(classes)}).drop(
        "raw_features", *[f"_s{c}" for c in range(classes)])


def blended(groups: list[list[Column]], weights: list[float]) -> list[Column]:
    """Weighted mean of the class probabilities of several models."""
    total = float(sum(weights))
    out = []
    for c in range(len(groups[0])):
        value = F.lit(0.0)
        for g, w in zip(groups, weights):
            value = value + g[c] * (w / total)
        out.append(value)
    return out


def soft_targets(probs: list[Column], temperature: float) -> list[Column]:
    """softmax(log p / T) with p clipped at 1e-9."""
    logs = [F.log(clip(p, 1e-9, 1.0)) / temperature for p in probs]
    top = F.greatest(*logs)
    powers = [F.exp(x - top) for x in logs]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def student(df: DataFrame, features: list[str], label: str, classes: int, hidden: tuple[int, ...] = (32, 16), rounds: int = 50,
            on: DataFrame | None = None) -> DataFrame:
    """A small perceptron on the same features. ``on`` names other rows to score."""
    layers = [len(features), *hidden, classes]
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="raw_features"),
        MultilayerPerceptronClassifier(featuresCol="raw_features", labelCol=label, layers=layers, maxIter=rounds, seed=42),
    ])
    return score(pipe.fit(df), df if on is None else on, [f"student_{c}" for c in range(classes)])


# --- online learning --------------------------------------------------------

# Step size, penalty and label weights.
LEARNING_RATE, L2 = 0.05, 1e-4
IMPLICIT_WEIGHT, EXPLICIT_WEIGHT = 0.5, 1.5
SIZE = len(S.DEVICE_FEATURES)


def sgd_step(w: np.ndarray, b: float, x: np.ndarray, y: float, weight: float) -> tuple[np.ndarray, float, float]:
    """One logistic step; the penalty does not touch the bias. Also gives the score before it."""
    z = float(w @ x + b)
    p = 1.0 / (1.0 + np.exp(-z)) if z >= 0 else float(np.exp(z) / (1.0 + np.exp(z)))
    err = p - y
    return w - LEARNING_RATE * weight * (err * x + L2 * w), b - LEARNING_RATE * weight * err, p


def initial_weights() -> tuple[np.ndarray, float]:
    return np.array(S.DEVICE_WEIGHTS, dtype=float), S.DEVICE_BIAS


MODEL_SCHEMA = "user bigint, steps bigint, bias double, weights array<double>"


def online_models(labels: DataFrame) -> DataFrame:
    """Weights per user after all labels in (ts, id) order; an id counts once.

    ``labels`` carries user, id, ts, label, explicit and the device features. Users are hashed to
    partitions and sorted there; each partition is then read in batches with one weight vector in
    hand, so no user is ever held in memory as a whole.
    """
    once = labels.groupBy("id").agg(F.min_by(F.struct(*labels.columns), "ts").alias("r")).select("r.*")
    x = F.array(*[F.col(c).cast("double") for c in S.DEVICE_FEATURES])
    y = (F.col("label") == "BLOCK").cast("double")
    weight = F.when(F.col("explicit"), EXPLICIT_WEIGHT).otherwise(IMPLICIT_WEIGHT)
    rows = once.select("user", "ts", "id", y.alias("y"), weight.alias("weight"), x.alias("x"))
    ordered = rows.repartition("user").sortWithinPartitions("user", "ts", "id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, steps, (w, b) = None, 0, initial_weights()
        for pdf in batches:
            done = []
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy())
            for i, (u, y_, wt) in enumerate(zip(pdf["user"].tolist(), pdf["y"].tolist(), pdf["weight"].tolist())):
                if u != user:
                    if user is not None:
                        done.append((user, steps, b, w.tolist()))
                    user, steps, (w, b) = u, 0, initial_weights()
                w, b, _ = sgd_step(w, b, x[i], y_, wt)
                steps += 1
            yield pd.DataFrame(done, columns=["user", "steps", "bias", "weights"])
        if user is not None:
            yield pd.DataFrame([(user, steps, b, w.tolist())], columns=["user", "steps", "bias", "weights"])

    return ordered.mapInPandas(fold, MODEL_SCHEMA)


def predict_with(features: DataFrame, models: DataFrame) -> DataFrame:
    """Device probability and verdict of every call under the user's own weights, else the defaults."""
    from ..operators.decide import device_verdict
    from ..operators.events import device_probability

    found = lookup_join(features, write_once(models.select("user", "weights", "bias"), "models"), ["user"])
    weights = F.coalesce("weights", F.array(*[F.lit(w) for w in S.DEVICE_WEIGHTS]))
    bias = F.coalesce("bias", F.lit(S.DEVICE_BIAS))
    x = F.array(*[F.col(c).cast("double") for c in S.DEVICE_FEATURES])
    p = device_probability(x, weights, bias)
    return found.withColumn("p_block", p).withColumn("device_verdict", device_verdict(F.col("p_block"))).drop("weights", "bias")


def fine_tune(base: DataFrame, feedback: DataFrame, features: list[str], label: str, alpha: float = 0.3) -> Model:
    """Refit on base rows plus corrected feedback rows with their weights."""
    from ..operators.decide import fine_tune_weight

    rows = base.select(*features, label, F.lit(False).alias("_f"), F.lit(1.0).alias("_w")).unionByName(
        feedback.select(*features, label, F.lit(True).alias("_f"), F.col("weight").alias("_w")))
    return logistic(features, label, "sample_weight").fit(
        rows.withColumn("sample_weight", fine_tune_weight(F.col("_f"), F.col("_w"), alpha)))
