"""Spelling variants: words one edit apart, found by pivotal grams.

The bigrams of a word are ordered by how few words hold them; its prefix is the first three of them
(and what ties with the third). One edit spoils at most one of two bigrams that do not overlap, so
of two words one edit apart, the one whose prefix ends earlier keeps one of its two pivots, and this
pivot lies in the prefix of the other at a place at most one off. The two pivots with the least total
count are chosen by dynamic programming.

With one edit in all, everything on one side of the surviving pivot is the same in both words, and of
the other side either the near or the far half is. Both go into the key under which pivots meet
prefixes, so a common bigram is no hot key. Pairs that meet are verified by their edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, stored
from .textscan import Block, _edges, blocks, mix, span_hash

#: Words: code points at least, and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Every occurrence whose checksum this divides loses one code point.
NOISE_STEP = 97
#: A near word is a form if it occurs at least so many times as often.
FORM_RATIO = 2
#: Code points, and rows that are put out, at a time.
SLICE = 1 << 16
#: Grams of a prefix: gram length times edits, plus one.
GRAM, PREFIX = 2, 3

#: Spans of more bytes are checksummed one by one.
LONG = 64

#: Letters of a word are A-Z, a-z and U+00C0 to U+00FF: the byte C3 and the one after it, or one byte in Latin-1.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[97:123] = True

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (_CRC >> np.uint32(1))


def _checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ``data`` as it goes on from the checksum ``before``: one byte of all spans at a time."""
    order = np.argsort(start - end, kind="stable")
    start, length = start[order], (end - start)[order]
    state = before[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    alike = int(np.searchsorted(-length, -LONG))
    for j in range(int(length[alike]) if alike < len(length) else 0):
        k = int(np.searchsorted(-length, -j))
        part = state[alike:k]
        state[alike:k] = _CRC[(part ^ data[start[alike:k] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    for i in range(alike):
        state[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes(), int(before[order[i]])) ^ 0xFFFFFFFF
    out = np.empty(len(order), dtype=np.int64)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _counted(block: Block, ids: list[int | None]) -> Counter[bytes]:
    """The words of a block of texts and how often they occur."""
    data = _LOWER[block.data]
    inside = _ASCII_LETTER[data]
    lead = data == 0xC3
    inside |= lead
    inside[1:] |= lead[:-1]
    start, end = _edges(block, inside)
    row = np.searchsorted(block.offsets, start, side="right") - 1
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], dtype=np.int64)
    noise = _checksums(data, start, end, heads[row])
    odd = noise % NOISE_STEP == 0
    two = np.concatenate([[0], np.cumsum(lead)])
    plain = np.flatnonzero(~odd & (end - start - (two[end] - two[start]) >= LEAST_LENGTH))
    _, first, n = np.unique(span_hash(Block(0, len(block), data, block.offsets), start[plain], end[plain]), return_index=True, return_counts=True)
    whole = data.tobytes()
    out: Counter[bytes] = Counter()
    for a, b, count in zip(start[plain[first]].tolist(), end[plain[first]].tolist(), n.tolist()):
        out[whole[a:b]] += count
    for i in np.flatnonzero(odd):
        word = whole[start[i] : end[i]].decode()
        at = int(noise[i]) % len(word)
        if len(word) > LEAST_LENGTH:
            out[(word[:at] + word[at + 1 :]).encode()] += 1
    return out


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts and how often they occur; every block of texts sends each of its words once.

    Inside a block equal words are told by 64-bit hashes, between blocks by their letters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for block in blocks(batch.column(1)):
                found = _counted(block, ids[block.first : block.last])
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words end to end, one byte per code point, and where each starts."""
    lengths = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer("".join(column.to_pylist()).encode("latin-1"), dtype=np.uint8)
    return data, np.concatenate([[0], np.cumsum(lengths)])


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, code and word number of every bigram."""
    start = np.ones(len(data), dtype=bool)
    start[offsets[1:] - 1] = False
    at = np.flatnonzero(start)
    return at, data[at].astype(np.int64) * 256 + data[at + 1], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) - 1)


def gram_counts(vocabulary: DataFrame) -> np.ndarray:
    """How many bigrams of the vocabulary have each of the 2**16 codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_grams(*_letters(batch.column(0)))[1], minlength=1 << 16)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "count"])

    out = np.zeros(1 << 16, dtype=np.int64)
    # At most as many rows as pairs of letters.
    for row in vocabulary.select("word").mapInArrow(run, "code bigint, count bigint").groupBy("code").agg(F.sum("count").alias("total")).collect():
        out[row.code] = row.total
    return out


def pivots(place: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Columns of the two grams that do not overlap and cost least together; rows are words, places rise.

    ``least[i]`` is the cheapest gram that ends before gram i begins, ``both`` the cheapest pair that ends with i.
    """
    rows = np.arange(len(place))
    best, chosen = np.full(len(place), np.inf), np.zeros((len(place), 2), dtype=np.int64)
    for i in range(1, place.shape[1]):
        before = np.where(place[:, :i] + GRAM <= place[:, i : i + 1], cost[:, :i], np.inf)
        least = before.argmin(axis=1)
        both = before[rows, least] + cost[:, i]
        better = both < best
        best = np.where(better, both, best)
        chosen[better] = np.stack([least, np.full(len(place), i)], axis=1)[better]
    return chosen


def _chosen(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and words of the pivots, the same of the prefixes, and the rank at which each prefix ends."""
    at, code, word = _grams(data, offsets)
    order = np.lexsort((at, rank[code], word))
    begin = offsets[:-1] - np.arange(len(offsets) - 1)
    three = order[begin[:, None] + np.arange(PREFIX)]
    last = rank[code[three[:, -1]]]
    member = rank[code] <= last[word]
    three.sort(axis=1)
    pair = np.take_along_axis(three, pivots(at[three], counts[code[three]].astype(float)), axis=1)
    return at[pair.ravel()], np.repeat(np.arange(len(three)), 2), at[member], word[member], last


def _keys(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, word: np.ndarray, partners: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the grams that begin at ``at``, and the word of each.

    ``partners`` are the length differences of the words that cut the open side in halves: 0 for a
    word's own keys, -1 and +1 for the words it asks for (the halves of equal length are among them).
    """
    block = Block(0, len(offsets) - 1, data, offsets)
    start, end = offsets[:-1][word], offsets[1:][word]
    keys, owners = [], []
    for side in (0, 1):
        # The open side: what follows the gram, or what comes before it. The other side is the same in both words.
        first, size = (start, end - at - GRAM) if side == 0 else (at, at - start)
        closed = span_hash(block, first, at + GRAM if side == 0 else end)
        for more in partners:
            other = size + more
            near = other // 2
            far = other - near
            ok = np.flatnonzero((other >= 0) & (near <= size))
            a, b = (start[ok], at[ok] + GRAM + near[ok]) if side == 0 else (at[ok] - near[ok], end[ok])
            keys.append(mix(span_hash(block, a, b) + np.uint64(2 * side + 1)))
            owners.append(word[ok])
            ok = np.flatnonzero((far > 0) & (far <= size) & ((near > 0) | (more != 0)))
            a, b = (end[ok] - far[ok], end[ok]) if side == 0 else (start[ok], start[ok] + far[ok])
            keys.append(mix(closed[ok] * np.uint64(0x9E3779B97F4A7C15) + span_hash(block, a, b) + np.uint64(2 * side + 2)))
            owners.append(word[ok])
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Words of about ``SLICE`` code points at a time; a longer word is a slice of its own."""
    ends = np.cumsum(pc.utf8_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _keyed(vocabulary: DataFrame, counts: np.ndarray, as_pivots: bool, name: str) -> DataFrame:
    """Word numbers under each key of their pivots or prefixes, with the word's length and letters and the rank at which its prefix ends."""
    rank = np.empty(1 << 16, dtype=np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole):
                data, offsets = _letters(batch.column(0))
                pivot, of_pivot, prefix, of_prefix, last = _chosen(data, offsets, rank, counts)
                keys, word = _keys(data, offsets, pivot, of_pivot, (-1, 1)) if as_pivots else _keys(data, offsets, prefix, of_prefix, (0,))
                # One edit changes at most two of the letters that a word has.
                mask = np.bitwise_or.reduceat(np.uint64(1) << (data & 63).astype(np.uint64), offsets[:-1]).view(np.int64)
                number, length = batch.column(1).to_numpy(), np.diff(offsets).astype(np.int32)
                for at in range(0, len(keys), SLICE):
                    own = word[at : at + SLICE]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at : at + SLICE]), pa.array(number[own]), pa.array(length[own]), pa.array(last[own]), pa.array(mask[own])],
                        names=["key", "id", "size", "last", "letters"],
                    )

    schema = f"key bigint, {name} bigint, {name}_size int, {name}_last int, {name}_letters bigint"
    return spread(vocabulary.select("word", "id"), "id").mapInArrow(run, schema)


def _whole(df: DataFrame) -> DataFrame:
    """A table that is never sent to the driver whole, however small Spark takes it for.

    The keys of a word are sized like the word, and a written table by its packed bytes.
    """
    return df.hint("merge")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: every pair of words exactly one edit apart, once, the smaller word first.

    ``vocabulary`` is a written table of distinct words with a number each: word, n, id.
    """
    counts = gram_counts(vocabulary)
    met = _whole(_keyed(vocabulary, counts, True, "s")).join(_whole(_keyed(vocabulary, counts, False, "r")), "key")
    met = met.filter("s_last <= r_last and abs(s_size - r_size) <= 1 and s <> r and bit_count(s_letters ^ r_letters) <= 2")
    pairs = met.select(F.least("s", "r").alias("s"), F.greatest("s", "r").alias("r")).distinct()
    for side in ("s", "r"):
        pairs = _whole(pairs).join(_whole(vocabulary.select(F.col("id").alias(side), F.struct("word", "n").alias(f"_{side}"))), side)
    near = pairs.filter(F.levenshtein(F.col("_s.word"), F.col("_r.word"), 1) == 1).select(F.least("_s", "_r").alias("a"), F.greatest("_s", "_r").alias("b"))
    return near.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms that begins at each word. Counts at least double on the way, so chains are short."""
    out = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = out.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        out = stored(_whole(out).join(_whole(onward), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if not out.filter("moved").limit(1).count():
            return out.select("word", "root")
        out = out.drop("moved")


def variants(docs: DataFrame) -> DataFrame:
    """One row per word of the texts: word, form, root, n, n_near, form_n.

    Words are counted over all documents, repeated rows each time, null and empty texts none; a null
    doc_id reads as the empty text in the checksum. Ties between forms go to the smaller word. Words of
    any length are compared; other columns are left aside; an empty table gives an empty one.
    """
    # Numbers are fixed once they are written.
    vocabulary = stored(words(docs).withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    pairs = stored(near_words(vocabulary), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.union(pairs.select("b", "b_n", "a", "a_n"))
    best = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    fits = -F.col("best.less") >= FORM_RATIO * F.col("n")
    judged = best.select("word", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    judged = stored(judged, "forms")
    ends = roots(judged.filter("form is not null"))
    out = _whole(vocabulary).join(_whole(_whole(judged).join(_whole(ends), "word", "left")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")
