"""Benchmark decontamination with suffix arrays over shards of the training text.

A task cuts its documents into shards, turns words into numbers and builds a suffix array of each
shard. Every suffix of every benchmark item is then looked up by bisection, which gives its longest
verbatim match and all places of it. A document loses its place if enough of its words stand in
matches that cover a whole window of an item.

Suffixes that cannot start a match of the shortest window are left out of the array: their first
words do not occur in that order in any item. The benchmark reaches the tasks in parts of bounded
size; one pass over the documents is made for each part, and the passes add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textscan import ALNUM, Block, Words, blocks, words

#: Words of a window; an item of fewer words is one window.
WINDOW = 13
#: A document is contaminated if one word in so many, or more, is hit.
SHARE = 20
#: Bytes of benchmark text in a part; longer items are cut into pieces that overlap by a window.
PART_BYTES, PIECE_WORDS = 4 << 20, 1 << 16

MATCH = "row bigint, item bigint, start bigint, length bigint"


class Test:
    """All suffixes of a part of the benchmark as numbers of words, and the vocabulary behind them."""

    def __init__(self, ids: list[str], texts: list[str], window: int) -> None:
        self.items, self.window = ids, window
        found = [next(blocks(pa.array([t], pa.large_string())), None) for t in texts]
        hashes = [words(b, ALNUM, lower=True).hash if b is not None and len(b.data) else np.zeros(0, dtype=np.uint64) for b in found]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *hashes]))
        lengths = np.array([len(h) for h in hashes], dtype=np.int64)
        self.least = int(min(window, *lengths[lengths > 0])) if (lengths > 0).any() else 0
        # Every item is followed by a number that no word has.
        self.words = np.concatenate([np.zeros(0, dtype=np.int64), *[np.append(np.searchsorted(self.vocabulary, h) + 1, 0) for h in hashes]])
        self.item = np.repeat(np.arange(len(ids)), lengths + 1)
        self.left = np.concatenate([np.zeros(0, dtype=np.int64), *[np.arange(n, -1, -1) for n in lengths]])
        self.need = np.minimum(window, np.repeat(lengths, lengths + 1))
        heads = _ranks(self.words, self.least) if self.least else np.zeros(0, dtype=np.uint64)
        self.heads = np.unique(heads[self.left >= self.least]) if self.least else heads


def _ranks(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of the next ``length`` numbers at each place, zeros beyond the end."""
    out = np.zeros(len(values), dtype=np.uint64)
    for i in range(length):
        part = np.zeros(len(values), dtype=np.uint64)
        part[: len(values) - i] = values[i:]
        out = out * np.uint64(0x9E3779B97F4A7C15) + (part + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        out ^= out >> np.uint64(29)
    return out


class SuffixArray:
    """Sorted suffixes of a shard's words (0: not a benchmark word), as far as ``depth`` words deep."""

    def __init__(self, values: np.ndarray, places: np.ndarray, depth: int) -> None:
        self.values = np.append(values, np.zeros(depth, dtype=values.dtype))
        self.depth = depth
        order = places
        # Least significant word first; each pass keeps the order of the one before.
        for i in range(depth - 1, -1, -1):
            order = order[np.argsort(self.values[order + i], kind="stable")]
        self.order = order

    def bounds(self, wanted: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``wanted`` the range of suffixes that begin with its first ``lengths`` words."""
        return self._bisect(wanted, lengths, False), self._bisect(wanted, lengths, True)

    def _bisect(self, wanted: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
        low, high = np.zeros(len(wanted), dtype=np.int64), np.full(len(wanted), len(self.order), dtype=np.int64)
        while (open_ := low < high).any():
            at = np.flatnonzero(open_)
            middle = (low[at] + high[at]) // 2
            after = self._before(self.order[middle], wanted[at], lengths[at], upper)
            low[at[after]] = middle[after] + 1
            high[at[~after]] = middle[~after]
        return low

    def _before(self, place: np.ndarray, wanted: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
        """Whether the suffix sorts before the words (or, for the upper bound, begins with them)."""
        out = np.full(len(place), upper)
        open_ = np.ones(len(place), dtype=bool)
        for i in range(wanted.shape[1]):
            mine, other = self.values[place + i], wanted[:, i]
            use = open_ & (i < lengths) & (mine != other)
            out[use] = mine[use] < other[use]
            open_ &= ~use
        return out


def _shard_values(word: Words, test: Test) -> np.ndarray:
    """Numbers of the words of a shard, a zero after each document."""
    at = np.minimum(np.searchsorted(test.vocabulary, word.hash), len(test.vocabulary) - 1)
    number = np.where(test.vocabulary[at] == word.hash, at + 1, 0)
    values = np.zeros(len(word) + (int(word.row[-1]) + 1 if len(word) else 0), dtype=np.int64)
    values[np.arange(len(word)) + word.row] = number
    return values


def matches(block: Block, word: Words, test: Test) -> dict[str, np.ndarray]:
    """Longest verbatim matches of benchmark suffixes, as far as they cover a window.

    One match per (suffix of an item, place in a document): row, item, first word, number of words.
    A match that goes on to the left in both is part of a longer one and is left out.
    """
    empty = {k: np.zeros(0, dtype=np.int64) for k in ("row", "item", "start", "length")}
    if not len(word) or not test.least:
        return empty
    values = _shard_values(word, test)
    bases = np.searchsorted(word.row, np.arange(len(block)), side="left")
    heads = _ranks(values, test.least)
    at = np.minimum(np.searchsorted(test.heads, heads), len(test.heads) - 1)
    places = np.flatnonzero((test.heads[at] == heads) & (values > 0))
    if not len(places):
        return empty
    array = SuffixArray(values, places, test.window)
    suffix = np.flatnonzero(test.left >= test.need)
    suffix = suffix[test.need[suffix] > 0]
    padded = np.append(test.words, np.zeros(test.window, dtype=np.int64))
    wanted = padded[suffix[:, None] + np.arange(test.window)[None, :]]
    low, high = array.bounds(wanted, test.need[suffix])
    many = high - low
    query = np.repeat(suffix, many)
    place = array.order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
    # Only left ends: a pair whose words to the left also agree, inside item and document, is inner.
    before_q, before_p = np.where(query > 0, test.words[query - 1], 0), np.where(place > 0, values[place - 1], 0)
    inner = (before_q == before_p) & (before_q > 0) & (test.left[query] + 1 <= test.left[np.maximum(query - 1, 0)])
    query, place = query[~inner], place[~inner]
    length = test.need[query].copy()
    values, padded = np.append(values, 0), test.words
    open_ = np.arange(len(query))
    while len(open_):
        q, p = query[open_] + length[open_], place[open_] + length[open_]
        same = (q < len(padded)) & (p < len(values))
        q, p = np.minimum(q, len(padded) - 1), np.minimum(p, len(values) - 1)
        same &= (padded[q] == values[p]) & (padded[q] > 0)
        open_ = open_[same]
        length[open_] += 1
    row = np.searchsorted(bases + np.arange(len(block)), place, side="right") - 1
    return {"row": row, "item": test.item[query], "start": place - row - bases[row], "length": length}


def _parts(benchmark: DataFrame, window: int, part_bytes: int) -> Iterator[Broadcast]:
    """The benchmark in parts of about ``part_bytes``, one at a time on the driver.

    An item of more than ``PIECE_WORDS`` words comes in pieces that share ``window`` - 1 words.
    """
    spark = benchmark.sparkSession
    split = F.expr(
        r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)"
    )
    step = PIECE_WORDS - window + 1
    held = benchmark.select(F.col("item_id").cast("string").alias("item"), split.alias("w")).filter("item is not null and size(w) > 0")
    pieces = held.select("item", F.explode(F.expr(
        f"transform(sequence(0, greatest(0, size(w) - {window}) div {step}), i -> array_join(slice(w, i * {step} + 1, {PIECE_WORDS}), ' '))"
    )).alias("text"))
    pieces = stored(pieces.distinct(), "benchmark")
    total = pieces.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    parts = total // part_bytes + 1
    for i in range(parts):
        mine = pieces if parts == 1 else pieces.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i)
        rows = mine.sort("item", "text").collect()
        yield spark.sparkContext.broadcast(Test([r["item"] for r in rows], [r["text"] for r in rows], window))


def _pass(rows: DataFrame, test: Broadcast, schema: str) -> DataFrame:
    """Add this part's matches to the spans and items of every row; ``_text`` is the last column."""
    names = rows.columns
    spans, items = names.index("_spans"), names.index("_items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(batch.num_columns - 1)):
                part = batch.slice(block.first, len(block))
                word = words(block, ALNUM, lower=True)
                found = matches(block, word, test.value)
                old_spans, old_items = part.column(spans).to_pylist(), part.column(items).to_pylist()
                order = np.argsort(found["row"], kind="stable")
                cuts = np.searchsorted(found["row"][order], np.arange(len(block) + 1))
                for r in np.unique(found["row"]):
                    at = order[cuts[r] : cuts[r + 1]]
                    pairs = np.unique(np.stack([found["start"][at], found["start"][at] + found["length"][at]], axis=1), axis=0)
                    old_spans[r] = old_spans[r] + pairs.ravel().tolist()
                    old_items[r] = sorted({*old_items[r], *(test.value.items[i] for i in np.unique(found["item"][at]))})
                columns = part.columns
                columns[spans], columns[items] = pa.array(old_spans, pa.list_(pa.int64())), pa.array(old_items, pa.list_(pa.string()))
                columns[names.index("_n")] = pa.array(np.bincount(word.row, minlength=len(block)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


#: Words in the union of the spans: in order of their starts, each adds what lies beyond the reach so far.
_HITS = """aggregate(
    array_sort(transform(sequence(0, size(_spans) div 2), i -> struct(coalesce(get(_spans, 2 * i), 0L) as s, coalesce(get(_spans, 2 * i + 1), 0L) as e))),
    struct(0L as n, 0L as reach),
    (a, x) -> struct(a.n + greatest(0L, x.e - greatest(x.s, a.reach)) as n, greatest(a.reach, x.e) as reach),
    a -> a.n)"""


def matched(docs: DataFrame, benchmark: DataFrame, carry: list[str], window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The carried columns with the locations of all longest matches.

    Adds _n (words), _spans (first word and word after the last, in turn, of each match) and _items
    (sorted ids of items with a whole window in the text), and _text.
    """
    rows = docs.select(
        *[F.col(f"`{c}`") for c in carry], F.lit(0).cast("bigint").alias("_n"), F.array().cast("array<bigint>").alias("_spans"),
        F.array().cast("array<string>").alias("_items"), F.col("text").alias("_text"),
    )
    first = True
    for test in _parts(benchmark, window, part_bytes):
        if not first:
            rows = stored(rows, "spans")
        rows = _pass(rows, test, rows.schema)
        first = False
    return rows


def _verdict(rows: DataFrame) -> DataFrame:
    hit = rows.withColumn("_hit", F.expr(_HITS))
    return hit.withColumn("_bad", (F.col("_hit") > 0) & (SHARE * F.col("_hit") >= F.col("_n")))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null text has no words; so has a null item. An item without an id is left out. Rows that repeat
    are judged each; items that repeat count once per id. Empty tables give no hits, or no rows.
    """
    found = _verdict(matched(docs, benchmark, ["doc_id"]))
    return found.select(
        "doc_id", F.col("_n").alias("n_words"), F.col("_hit").alias("n_hit"), F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), F.col("_bad").alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that are not contaminated, with the columns of the input."""
    names = docs.columns
    held = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], "text")
    clean = _verdict(matched(held, benchmark, [f"_c{i}" for i in range(len(names))])).filter(~F.col("_bad"))
    return clean.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


