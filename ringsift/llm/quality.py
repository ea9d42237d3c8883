"""Quality rules: counts of words, lines and symbols, and bands of n-gram perplexity per language.

The language model is a modified Kneser-Ney model of order five over code points, A-Z without case and all
others as they are. Spark counts the n-grams of all texts and smooths them order by order: totals of contexts
and probabilities of shorter n-grams are joined to the longer ones, so the model grows with the corpus and
stands in no single place. The most frequent n-grams, ``LISTED`` of them at most, go to every task as sorted
arrays of 64-bit hashes that are searched by bisection; the others are joined to the texts they stand in.

Texts are dealt to two folds by their checksum, and each fold is judged by what the other one teaches, so no
text foretells itself or its copies.

A text's perplexity is judged against the texts of its own language that pass the base rules: it
must lie within three interquartile ranges of their quartiles, on the logarithmic scale.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, stored
from .textscan import BLANKS, Block, blocks, keyed, lines, mix, windows, words

#: Code points per n-gram, and bits of one. An n-gram is two numbers: its last ``LOW`` code points, and those before.
ORDER, BITS, LOW = 5, 21, 3
#: Stands before a text's first code point; no code point is that large.
PAD = (1 << BITS) - 1
#: Most n-grams that every task holds.
LISTED = 1 << 18
#: N-grams that a task adds up before it passes them on.
CHUNK = 1 << 20
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: Scale of stored logarithms, and the width of a bin of log-perplexity in that scale (0.005).
MICRO, BIN = 1_000_000, 5_000
#: Fences: so many interquartile ranges beyond the quartiles, a range counting as 20 bins (0.1) at least.
FENCE, LEAST_RANGE = 3, 20
#: Bins added on both sides, over the root of the number of code points: five standard deviations of about 1.0 each.
SHORT = 1000

STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_grams bigint, log_sum bigint"
#: What a stored row still lacks: its n-grams outside the list, and the fold that says which model they are looked up in.
OPEN = "_row bigint, _fold bigint, _rest array<struct<hi:bigint,lo:bigint,times:bigint>>"

_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(1, ORDER + 1)], dtype=np.uint64)
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_LEAD = (np.arange(256) & 0xC0) != 0x80
#: What a first byte adds to its code point, A-Z in lower case.
_FIRST = np.array([b + 32 if 65 <= b <= 90 else b if b < 0x80 else b & 0x1F if b < 0xE0 else b & 0x0F if b < 0xF0 else b & 7 for b in range(256)])


def code_points(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows end to end, and where each row starts."""
    data, lead = block.data, _LEAD[block.data]
    starts = block.offsets[:-1]
    lead[starts[starts < len(data)]] = True
    at = np.flatnonzero(lead)
    out, size = _FIRST[data[at]], np.diff(np.append(at, len(data)))
    for i in range(1, 4):
        more = np.flatnonzero(size > i)
        out[more] = out[more] << 6 | data[at[more] + i] & 0x3F
    return out, np.searchsorted(at, block.offsets)


def grams(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams as rows of hashes, high and low numbers; which of them ends at each code point; where each row starts."""
    now, offsets = code_points(block)
    size, rows = np.diff(offsets), len(block)
    # Every row begins with padding; the n-gram that ends at a code point is told by a running product of the last ones.
    place = np.arange(len(now)) + np.repeat((ORDER - 1) * np.arange(1, rows + 1), size)
    padded = np.full(len(now) + (ORDER - 1) * rows, PAD, dtype=np.uint64)
    padded[place] = now
    value = padded[ORDER - 1 :] * _POWERS[0]
    for i in range(1, ORDER):
        value += padded[ORDER - 1 - i : len(padded) - i] * _POWERS[i]
    first, at = _distinct(value[place - (ORDER - 1)])
    both = [np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)]
    for i in range(ORDER):
        both[i < LOW] |= padded[place[first] - i].astype(np.int64) << (BITS * (i % LOW))
    return np.stack([_hash(*both).view(np.int64), *both]), at, offsets


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different hash stands first, and which of them each one is."""
    at, different = pd.factorize(hashes)
    first = np.empty(len(different), dtype=np.int64)
    first[at[::-1]] = np.arange(len(hashes))[::-1]
    return first, at


def _hash(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix(mix(hi.astype(np.uint64)) + lo.astype(np.uint64))


def _folds(block: Block) -> np.ndarray:
    return np.array([zlib.crc32(block.text(i)) & 1 for i in range(len(block))], dtype=np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """hi, lo, c0, c1 over all whole texts: how often the texts of fold 1, which teach fold 0, and those of fold 0
    hold each n-gram. A task adds up what it reads before anything is shuffled."""

    def merged(parts: list[np.ndarray]) -> np.ndarray:
        every = np.concatenate(parts, axis=1)
        first, at = _distinct(every[0])
        return np.stack([*every[:3, first], *[np.bincount(at, c, len(first)).astype(np.int64) for c in every[3:]]])

    def flush(held: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, held.shape[1], 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in held[1:]], names=["hi", "lo", "c0", "c1"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for block in blocks(batch.column(0)):
                found, at, offsets = grams(block)
                n = found.shape[1]
                times = np.bincount(at + np.repeat(n * (1 - _folds(block)), np.diff(offsets)), minlength=2 * n)
                held.append(np.concatenate([found, times.reshape(2, n)]))
                if sum(h.shape[1] for h in held) > CHUNK:
                    held = [merged(held)]
                    if held[0].shape[1] > CHUNK // 2:
                        yield from flush(held.pop())
        if held:
            yield from flush(merged(held))

    counted = docs.select("text").mapInArrow(count, "hi bigint, lo bigint, c0 bigint, c1 bigint")
    return counted.groupBy("hi", "lo").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _discounts(n: list[int]) -> list[float]:
    """Discount for counts 0, 1, 2, 3 and more, after Chen and Goodman, from how many n-grams have the counts 1 to 4;
    a half of the count if undefined."""
    n, out = [0, *n], [0.0]
    for i in range(1, 4):
        ok = n[1] + 2 * n[2] > 0 and n[i] > 0
        d = i - (i + 1) * n[1] / (n[1] + 2 * n[2]) * n[i + 1] / n[i] if ok else i / 2
        out.append(d if 0 < d < i else i / 2)
    return out


def _context() -> list[Column]:
    """All but the last code point."""
    carried = F.shiftleft(F.col("hi").bitwiseAND(F.lit(PAD)), BITS * (LOW - 1))
    return [F.shiftright("hi", BITS).alias("hi"), F.shiftright("lo", BITS).bitwiseOR(carried).alias("lo")]


def _suffix(size: int) -> list[Column]:
    """The last ``size`` code points."""
    masks = [(1 << (BITS * max(0, size - LOW))) - 1, (1 << (BITS * min(size, LOW))) - 1]
    return [F.col(c).bitwiseAND(F.lit(m)).alias(c) for c, m in zip(("hi", "lo"), masks)]


def _smoothed(counts: DataFrame) -> DataFrame:
    """hi, lo, n, p0, p1: the probability that the models for fold 0 and fold 1 give each n-gram's last code point.

    Every n-gram of the corpus gets its row, also where a model has never met it and goes by shorter ones.
    """
    tables = [counts]
    for size in range(ORDER - 1, 0, -1):
        # Below the top, an n-gram counts the different code points seen before it.
        seen = [F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in ("c0", "c1")]
        tables.append(stored(tables[-1].groupBy(*_suffix(size)).agg(*seen), "grams"))
    # How many n-grams of each size have the counts 1 to 4: one job for all sizes.
    few = [F.count(F.when(F.col(c) == i, 1)).alias(f"{c}_{i}") for c in ("c0", "c1") for i in range(1, 5)]
    every = functools.reduce(DataFrame.union, [t.select(F.lit(ORDER - i).alias("size"), "c0", "c1") for i, t in enumerate(tables)])
    found = {row["size"]: row.asDict() for row in every.groupBy("size").agg(F.count(F.lit(1)).alias("n"), *few).collect()}
    lower = None
    for size in range(1, ORDER + 1):
        held, row = tables[ORDER - size], found.get(size, {})
        drops = {c: _discounts([row.get(f"{c}_{i}", 0) for i in range(1, 5)]) for c in ("c0", "c1")}
        sums = [F.sum(c).alias(f"{c}_all") for c in drops]
        sums += [F.count(F.when(F.col(c) >= 3 if i == 3 else F.col(c) == i, 1)).alias(f"{c}_{i}") for c in drops for i in (1, 2, 3)]
        contexts = held.select(*_context(), "c0", "c1").groupBy("hi", "lo").agg(*sums).withColumnsRenamed({"hi": "_chi", "lo": "_clo"})
        chi, clo = _context()
        joined = held.withColumns({"_chi": chi, "_clo": clo}).join(contexts, ["_chi", "_clo"])
        if lower is None:
            # One more than all code points, for those never met.
            joined = joined.withColumns({f"q{f}": F.lit(1 / (row.get("n", 0) + 1)) for f in (0, 1)})
        else:
            shi, slo = _suffix(size - 1)
            joined = joined.withColumns({"_shi": shi, "_slo": slo}).join(lower, ["_shi", "_slo"])
        probabilities = []
        for f, c in enumerate(drops):
            d, total = drops[c], F.col(f"{c}_all")
            own = F.col(c) - F.when(F.col(c) >= 3, d[3]).when(F.col(c) == 2, d[2]).when(F.col(c) == 1, d[1]).otherwise(0.0)
            back = sum((d[i] * F.col(f"{c}_{i}") for i in (2, 3)), d[1] * F.col(f"{c}_1"))
            probabilities.append(F.when(total > 0, (own + back * F.col(f"q{f}")) / total).otherwise(F.col(f"q{f}")))
        if size < ORDER:
            lower = stored(joined.select(F.col("hi").alias("_shi"), F.col("lo").alias("_slo"), *[p.alias(f"q{f}") for f, p in enumerate(probabilities)]), "grams")
    return joined.select("hi", "lo", (F.col("c0") + F.col("c1")).alias("n"), *[p.alias(f"p{f}") for f, p in enumerate(probabilities)])


class Model:
    """The same smoothing of counts that fit into memory, codes of few bits each: sorted hash arrays with the
    log-probability of each n-gram and the log-weight of backing off from each context. Tests hold ``_smoothed`` against it."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, order: int = 4, bits: int = 6) -> None:
        self.order, self.bits = order, bits
        at = np.argsort(gram)
        levels = [(gram[at].astype(np.int64), n[at].astype(np.int64))]
        for k in range(order - 1, 0, -1):
            levels.append(np.unique(levels[-1][0] & ((1 << (bits * k)) - 1), return_counts=True))
        below, p_below = np.zeros(1, dtype=np.int64), np.full(1, 1 / (1 << bits))
        keys, values, heads, weights = [], [], [], []
        for k in range(1, order + 1):
            codes, counts = levels[order - k]
            if not len(codes):
                continue
            drop = np.array(_discounts([int((counts == i).sum()) for i in range(1, 5)]))[np.minimum(counts, 3)]
            context, at = np.unique(codes >> bits, return_inverse=True)
            total = np.bincount(at, counts)
            back = 1 - np.bincount(at, counts - drop) / total
            suffix = np.searchsorted(below, codes & ((1 << (bits * (k - 1))) - 1)) if k > 1 else np.zeros(len(codes), dtype=np.int64)
            p = (counts - drop) / total[at] + back[at] * p_below[suffix]
            keys.append(self._key(codes, k))
            values.append(p)
            heads.append(self._key(context, k))
            weights.append(back)
            below, p_below = codes, p
        self.keys, self.logs = self._sorted(keys, values)
        self.heads, self.backs = self._sorted(heads, weights)

    @staticmethod
    def _key(code: np.ndarray, level: int) -> np.ndarray:
        return mix(code.astype(np.uint64) + np.uint64(level << 32))

    @staticmethod
    def _sorted(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not keys:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key)
        return key[order], np.rint(np.log(value[order]) * MICRO).astype(np.int32)

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each n-gram's last code, times ``MICRO``."""
        out = np.zeros(len(codes), dtype=np.int64)
        left = np.arange(len(codes))
        for k in range(self.order, 0, -1):
            code = codes[left].astype(np.int64) & ((1 << (self.bits * k)) - 1)
            hit, at = _find(self.keys, self._key(code, k))
            out[left[hit]] += self.logs[at[hit]]
            left, code = left[~hit], code[~hit]
            known, at = _find(self.heads, self._key(code >> self.bits, k))
            out[left[known]] += self.backs[at[known]]
        out[left] += round(np.log(1 / (1 << self.bits)) * MICRO)
        return out


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return table[at] == wanted, at


class Listed:
    """The most frequent n-grams: sorted hashes, and the log-probability in either model."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, logs: np.ndarray) -> None:
        hashes = _hash(hi, lo)
        order = np.argsort(hashes)
        self.hashes, self.logs = hashes[order], logs[:, order]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each n-gram is listed, and its log-probabilities, 0 if it is not."""
        hit, at = _find(self.hashes, hashes)
        logs = np.zeros((2, len(hashes)), dtype=np.int64)
        logs[:, hit] = self.logs[:, at[hit]]
        return hit, logs


def train(docs: DataFrame) -> tuple[Broadcast, DataFrame]:
    """Count and smooth with Spark; broadcast the most frequent n-grams, leave the others a table: hi, lo, log0, log1."""
    counts = stored(count_grams(docs), "grams")
    logs = [F.rint(F.log(f"p{f}") * MICRO).cast("int").alias(f"log{f}") for f in (0, 1)]
    # Sixteen ranks per doubling of the count: the list takes whole ranks from the top as far as they fit.
    rank = F.floor(F.log2("n") * 16).cast("bigint")
    model = stored(_smoothed(counts).select("hi", "lo", *logs, rank.alias("rank")), "model")
    least, size = 1 << 60, 0
    for rank_, n in sorted(map(tuple, model.groupBy("rank").count().collect()), reverse=True):
        size += n
        if size > LISTED:
            break
        least = rank_
    # As Arrow columns whatever the session's settings: as rows of Python objects an n-gram takes over 600 bytes.
    top = model.filter(F.col("rank") >= least).drop("rank").toArrow()
    listed = Listed(*[top[c].to_numpy() for c in ("hi", "lo")], np.stack([top[c].to_numpy() for c in ("log0", "log1")]))
    return docs.sparkSession.sparkContext.broadcast(listed), model.filter(F.col("rank") < least).drop("rank")


def _rest(row: np.ndarray, gram: np.ndarray, found: np.ndarray, rows: int) -> pa.Array:
    """Per row its different n-grams outside the list, and how often each stands there."""
    pair, times = np.unique(row * max(1, found.shape[1]) + gram, return_counts=True)
    row, gram = np.divmod(pair, max(1, found.shape[1]))
    ends = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x) for x in (found[1][gram], found[2][gram], times)], ["hi", "lo", "times"]))


def statistics(block: Block, listed: Listed) -> list[np.ndarray | pa.Array]:
    """The columns of ``STATS`` for the rows of a block, ``log_sum`` over the n-grams of the list, then fold and the rest."""
    rows = len(block)
    word = words(block)
    chars = block.per_row(BLANKS[block.data] & _LEAD[block.data])
    symbols = block.per_row(_SYMBOL[block.data])
    line = lines(block)
    inked = np.concatenate([[0], np.cumsum(BLANKS[block.data])])
    full = inked[line.end] > inked[line.start]
    key, row = keyed(line.hash[full], line.row[full]), line.row[full]
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(order), dtype=bool)
    again[1:] = key[order][1:] == key[order][:-1]
    window, first = windows(word, REPEAT_WINDOW)
    key = keyed(window, word.row[first])
    order_w = np.argsort(key, kind="stable")
    same = key[order_w][1:] == key[order_w][:-1]
    twice = np.zeros(len(order_w), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(word) + 1, dtype=np.int64)
    starts = first[order_w[twice]]
    np.add.at(covered, starts, 1)
    np.add.at(covered, np.minimum(starts + REPEAT_WINDOW, len(word)), -1)
    repeated = np.cumsum(covered[:-1]) > 0
    found, at, offsets = grams(block)
    hit, logs = listed.find(found[0].view(np.uint64))
    size, fold = np.diff(offsets), _folds(block)
    sums = np.concatenate([[0], np.cumsum(logs.ravel()[at + np.repeat(len(hit) * fold, size)])])
    other = np.flatnonzero(~hit[at]) if not hit.all() else np.zeros(0, dtype=np.int64)
    return [
        np.bincount(word.row, minlength=rows), chars, symbols, np.bincount(row[order[again]], minlength=rows),
        np.bincount(word.row[repeated], minlength=rows), size, sums[offsets[1:]] - sums[offsets[:-1]],
        fold, _rest(np.repeat(np.arange(rows), size)[other], at[other], found, rows),
    ]


def measure(docs: DataFrame, listed: Broadcast, carry: list[str]) -> DataFrame:
    """The carried columns, ``STATS`` and ``OPEN`` of every row; stored, so that a row keeps its number."""
    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], *T._parse_datatype_string(f"{STATS}, {OPEN}").fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for block in blocks(batch.column(batch.num_columns - 1)):
                kept = batch.slice(block.first, len(block)).columns[:-1]
                *found, fold, rest = statistics(block, listed.value)
                found = [pa.array(np.asarray(x, dtype=np.int64)) for x in (*found, np.arange(row, row + len(block)), fold)]
                row += len(block)
                yield pa.RecordBatch.from_arrays([*kept, *found, rest], names=names)

    return stored(source.mapInArrow(run, schema), "measured")


def completed(measured: DataFrame, others: DataFrame) -> DataFrame:
    """``log_sum`` over all n-grams: those outside the list are joined to the rows they stand in. Stored, without the rest."""
    rest = measured.select("_row", "_fold", F.inline("_rest")).join(others, ["hi", "lo"])
    more = rest.groupBy("_row").agg(F.sum(F.col("times") * F.when(F.col("_fold") == 0, F.col("log0")).otherwise(F.col("log1"))).alias("_more"))
    whole = F.col("log_sum") + F.coalesce(F.col("_more"), F.lit(0))
    return stored(measured.drop("_fold", "_rest").join(more, "_row", "left").withColumn("log_sum", whole).drop("_more"), "quality")


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _bin() -> Column:
    return F.floor(-F.col("log_sum") / F.greatest(F.col("n_grams"), F.lit(1)) / BIN).cast("bigint")


def bands(measured: DataFrame) -> DataFrame:
    """Per language the lowest and highest bin that is kept; stored, so that its size is known."""
    counts = measured.filter(~_base_failed()).groupBy(named(F.col("lang")).alias("_lang"), _bin().alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("_lang").orderBy("bin")
    run = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("_lang")))
    at = run.groupBy("_lang").agg(*[F.min(F.when(4 * F.col("upto") >= i * F.col("all"), F.col("bin"))).alias(f"q{i}") for i in (1, 3)])
    reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_RANGE))
    return stored(at.select("_lang", (F.col("q1") - reach).alias("_low"), (F.col("q3") + reach).alias("_high")), "bands")


def _judged(measured: DataFrame, band: DataFrame) -> DataFrame:
    joined = measured.withColumn("_lang", named(F.col("lang"))).join(band, "_lang", "left")
    slack = SHORT / F.sqrt(F.greatest(F.col("n_grams"), F.lit(1)))
    inside = F.coalesce(_bin().between(F.col("_low") - slack, F.col("_high") + slack), F.lit(False))
    return (
        joined.withColumn("perplexity", F.exp(-F.col("log_sum") / F.greatest(F.col("n_grams"), F.lit(1)) / MICRO))
        .withColumn("base_failed", _base_failed())
        .withColumn("kept", ~F.col("base_failed") & inside)
        .drop("_lang", "_low", "_high")
    )


def assess(docs: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, lang, the counts, perplexity (per code point), base_failed, kept.

    A null or blank text has no words and fails the base rules. A null lang is a language of its own.
    Rows that repeat are judged each. An empty table gives an empty result.
    """
    listed, others = train(docs)
    scored = completed(measure(docs, listed, ["doc_id", "lang"]), others)
    return _judged(scored, bands(scored)).drop("_row", "n_grams", "log_sum")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of documents that pass all rules, with the columns of the input."""
    listed, others = train(docs)
    names = docs.columns
    held = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], "text", "lang")
    measured = measure(held, listed, [f"_c{i}" for i in range(len(names))] + ["lang"])
    scored = completed(measured.drop(*[f"_c{i}" for i in range(len(names))]), others)
    good = _judged(scored, bands(scored)).filter("kept").select("_row")
    return measured.join(good, "_row", "left_semi").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])
