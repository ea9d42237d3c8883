"""Near-duplicate documents by SetSketch registers.

Every document becomes a set of distinct word shingles, and a sketch of ``REGISTERS`` registers. A
register holds the least of exponentially distributed hash values of the set, on an exponential
scale that is truncated at both ends; sketches of parts merge by taking the larger register. Equal
registers become likely as sets agree, so documents that share a band of ``BAND`` registers are
candidates. The similarity of candidates is estimated from both sketches and both sizes by maximum
likelihood, and what is not clearly below the threshold is confirmed on the full sets.

Equal sets are folded into one representative first. In a bucket every member is paired with the
least one only; the links found make components. Buckets that still hold several components are then
compared block against block, and only pairs across components are confirmed. No task ever holds
more than two blocks, and pairs inside a component are never written out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, stored
from .textscan import BLANKS, Block, blocks, mix, windows, words

#: Words of a shingle, unless a caller names another number.
SHINGLE = 5
#: Linked if 100 * intersection >= 80 * union.
PERCENT = 80
REGISTERS, BAND = 128, 4
BANDS = REGISTERS // BAND
#: Base of the register scale, rate of the exponential values, largest register (b, a and q + 1 of SetSketch).
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Estimates below this are not confirmed: more than five standard errors of 128 registers below 0.8.
LEAST_ESTIMATE = 0.6
#: Members of a block of a bucket, and pairs of one leader that one task confirms.
BLOCK, LEADER_PAIRS = 512, 64
#: Across components, a pair needs so many equal registers (seven standard errors below 0.8), and then an
#: estimate from a finer sketch of so many registers (five standard errors below 0.8).
LEAST_EQUAL, FINE, LEAST_FINE = REGISTERS // 2, 1024, 0.735

_FACTORS = mix(np.arange(1, REGISTERS + FINE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, sorted by row and value, and the number of each row."""
    word = words(block, BLANKS, lower=True)
    value, at = windows(word, size)
    row = word.row[at]
    count = np.bincount(word.row, minlength=len(block))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        whole = np.zeros(len(short), dtype=np.uint64)
        for i in range(n):
            whole = whole * np.uint64(0xF1357AEA2E62A9C5) + word.hash[first[short] + i]
        value, row = np.concatenate([value, mix(whole + np.uint64(n))]), np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def registers(value: np.ndarray, starts: np.ndarray, fine: bool = False) -> np.ndarray:
    """Registers of the sets that begin at ``starts``: one row of 16-bit numbers each."""
    factors = _FACTORS[REGISTERS:] if fine else _FACTORS[:REGISTERS]
    out = np.empty((len(starts), len(factors)), dtype=np.uint16)
    for i, factor in enumerate(factors):
        least = np.minimum.reduceat(value * factor, starts)
        x = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity, from how many registers are larger, smaller and equal, and the sizes."""
    more, less = (left > right).sum(axis=1), (left < right).sum(axis=1)
    same = left.shape[1] - more - less
    u, v = n_left / (n_left + n_right), n_right / (n_left + n_right)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = p(u - v * j), p(v - u * j)
        return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood is concave
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rising = likelihood(a) < likelihood(b)
        low, high = np.where(rising, a, low), np.where(rising, high, b)
    return (low + high) / 2


def _comparable(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether two sizes allow the similarity at all."""
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def sketch(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n, two halves of a digest of the set, registers; the last three null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                value, row = shingles(block, size)
                n = np.bincount(row, minlength=len(block))
                some = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[some]
                digest = np.zeros((2, len(block)), dtype=np.uint64)
                held: list[bytes | None] = [None] * len(block)
                if len(some):
                    digest[0, some] = np.add.reduceat(mix(value), starts)
                    digest[1, some] = np.add.reduceat(mix(value * np.uint64(0x9E3779B97F4A7C15)), starts)
                    for r, x in zip(some, registers(value, starts)):
                        held[r] = x.tobytes()
                empty = n == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.array(n), *[pa.array(d.view(np.int64), mask=empty) for d in digest], pa.array(held, pa.binary())],
                    names=["doc_id", "n", "d1", "d2", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, sketch binary")


def _bands(reps: DataFrame) -> DataFrame:
    """band, key, id: one row per band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint64).reshape(-1, BANDS)
            band = np.tile(np.arange(BANDS), len(held))
            yield pa.RecordBatch.from_arrays(
                [pa.array(band.astype(np.int32)), pa.array(held.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))],
                names=["band", "key", "id"],
            )

    return reps.select("id", "sketch").mapInArrow(run, "band int, key bigint, id bigint")


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link and whose estimate is not clearly too low."""
    of = reps.select("id", "n", "sketch")
    wide = pairs.join(of.toDF("a", "n", "s"), "a").join(of.toDF("b", "m", "t"), "b").filter(100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("s", "t"))
            near = estimate(s, t, batch.column("n").to_numpy().astype(float), batch.column("m").to_numpy().astype(float)) >= LEAST_ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return wide.select("a", "b", "n", "m", "s", "t").mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, the sorted shingles (64-bit numbers, as bytes) and a finer sketch of the named documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                value, row = shingles(block, size)
                cuts = np.searchsorted(row, np.arange(len(block) + 1))
                held = [value[cuts[r] : cuts[r + 1]].tobytes() for r in range(len(block))]
                some = np.flatnonzero(np.diff(cuts))
                fine: list[bytes | None] = [None] * len(block)
                if len(some):
                    for r, x in zip(some, registers(value, cuts[some], fine=True)):
                        fine[r] = x.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, len(block)), pa.array(held, pa.binary()), pa.array(fine, pa.binary())], names=["id", "shingles", "fine"]
                )

    return docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(run, "id bigint, shingles binary, fine binary")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked. The pairs of one ``a`` are dealt to tasks, each with the set of ``a`` once."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_k"))
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.floor(F.col("_k") / LEADER_PAIRS) + 1).alias("part"), "b")
    wanted = dealt.unionByName(dealt.select("a", "part", F.col("a").alias("b")).distinct())
    held = wanted.join(sets.select(F.col("id").alias("b"), "shingles"), "b")

    def run(group: pa.Table) -> pa.Table:
        a, b = group.column("a").to_numpy(), group.column("b").to_numpy()
        found = [np.frombuffer(x, dtype=np.uint64) for x in group.column("shingles").to_pylist()]
        lead = next(x for i, x in enumerate(found) if a[i] == b[i])
        linked = np.zeros(len(a), dtype=bool)
        for i, x in enumerate(found):
            if a[i] != b[i]:
                at = np.minimum(np.searchsorted(lead, x), len(lead) - 1)
                both = int((lead[at] == x).sum())
                linked[i] = 100 * both >= PERCENT * (len(lead) + len(x) - both)
        return group.select(["a", "b"]).filter(pa.array(linked))

    return spread(held, "a", "part").groupBy("a", "part").applyInArrow(run, "a bigint, b bigint")


def _across(buckets: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs across components in buckets that hold several, estimated block against block."""
    at = buckets.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = at.groupBy("band", "key").agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("_l"), F.max("label").alias("_h")).filter("_l < _h")
    split = at.join(mixed.select("band", "key", (F.floor(F.col("_n") / BLOCK) + 1).alias("_b")), ["band", "key"])
    split = split.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("_b"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_b") - 1)))
    dealt = split.select("band", "key", "id", "label", "mine", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    rows = dealt.join(reps.select("id", "n", "sketch").join(sets.select("id", "fine"), "id"), "id")

    def run(group: pa.Table) -> pa.Table:
        ids, label, n, mine = (group.column(c).to_numpy() for c in ("id", "label", "n", "mine"))
        band, x, y = (group.column(c)[0].as_py() for c in ("band", "x", "y"))
        held = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
        finer = np.frombuffer(b"".join(group.column("fine").to_pylist()), dtype=np.uint16).reshape(-1, FINE)
        keys = held.view(np.uint64)
        out_a, out_b = [], []
        for i in np.flatnonzero(mine == x):
            j = np.flatnonzero((mine == y) & (label != label[i]) & _comparable(n[i], n) & ((ids > ids[i]) if x == y else True))
            if not len(j):
                continue
            # A pair is looked at in the first band that it shares.
            j = j[(keys[j, :band] != keys[i, :band]).all(axis=1)] if band else j
            j = j[(held[j] == held[i]).sum(axis=1) >= LEAST_EQUAL]
            if len(j):
                j = j[estimate(finer[j], finer[i][None, :], n[j].astype(float), np.full(len(j), float(n[i]))) >= LEAST_FINE]
            out_a.append(np.minimum(ids[i], ids[j]))
            out_b.append(np.maximum(ids[i], ids[j]))
        none = [np.zeros(0, dtype=np.int64)]
        return pa.table({"a": np.concatenate(out_a or none), "b": np.concatenate(out_b or none)})

    return spread(rows, "band", "key", "x", "y").groupBy("band", "key", "x", "y").applyInArrow(run, "a bigint, b bigint")


def _step(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step over the edges (u, v), u > v."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    return small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every id has one smaller neighbour at most, and none if it has larger ones."""
    ends = edges.select(F.inline(F.array(*[F.struct(F.col(c).alias("id"), F.lit(c == "u").alias("low"), F.lit(c == "v").alias("high")) for c in ("u", "v")])))
    per_id = ends.groupBy("id").agg(F.count_if("low").alias("n"), F.max("high").alias("high"))
    return not per_id.agg(F.max((F.col("n") > 1) | (F.col("n") > 0) & F.col("high"))).collect()[0][0]


def _led(links: DataFrame) -> DataFrame:
    """id, label: the least id that can be reached over the links (a, b), for all ids that reach a smaller one.

    Large-star and small-star steps in turn: every id hands its larger, then its smaller neighbours to
    the least one it knows, until only stars around the least ids are left. Neighbours of one id are never gathered.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _settled(edges):
        edges = stored(_step(edges), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """id, label: the least id that can be reached over the links (a, b); ids without a link are left out."""
    led = _led(links)
    return led.union(led.select(F.col("label").alias("id"), "label").distinct())


def groups(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of shingles of ``size`` words agree to 80 percent; component_id is the
    least doc_id that can be reached, and the row of that doc_id is kept. A text of fewer words
    is one shingle; a text without words, or null, is linked with nothing. Rows that share a doc_id are
    one document. A row without a doc_id cannot be named by a link: it has no component and is kept.
    """
    sketches = stored(sketch(docs, size), "sketches")
    some = sketches.filter("doc_id is not null and n > 0")
    reps = some.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("id"), F.max("sketch").alias("sketch"))
    reps = stored(reps, "representatives")
    # Rows of one doc_id with different texts, and copies among them, are links that need no check.
    known = some.join(reps.select("d1", "d2", "n", "id"), ["d1", "d2", "n"]).select("doc_id", "id")
    same = known.filter("doc_id <> id").join(reps.select("id").distinct().withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").distinct()
    one = reps.dropDuplicates(["id"])

    banded = _bands(reps)
    shared = banded.groupBy("band", "key").agg(F.min("id").alias("lead"), F.max("id").alias("_h")).filter("lead < _h").drop("_h")
    buckets = stored(banded.join(shared, ["band", "key"]).distinct(), "buckets")
    stars = stored(_likely(buckets.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), one), "stars")
    sets = stored(_sets(docs, buckets.select("id").distinct(), size), "sets")
    first = stored(_confirm(stars, sets), "links")
    copies = same.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    # An id without a label leads its component.
    labels = _led(first.union(copies))
    more = stored(_across(buckets.select("band", "key", "id"), labels, one, sets).join(stars, ["a", "b"], "left_anti").distinct(), "across")
    second = _confirm(more, sets)
    labels = _led(labels.select(F.col("label").alias("a"), F.col("id").alias("b")).union(second))

    named = known.join(labels.select("id", "label"), "id", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "id")).alias("component_id"))
    out = sketches.join(named, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of documents without near duplicates: one row of each group, with the columns of the input.

    Of a group the row of the least doc_id stays; of rows that repeat a doc_id, one. Rows without a
    doc_id stay.
    """
    ids = groups(docs, size).filter("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.filter("doc_id is not null").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id is null")).select(*[F.col(f"`{c}`") for c in docs.columns])
