"""Scores of texts by an n-gram trie in Elias-Fano form.

Words with a share of 2^-SHORT of all training tokens or more make a short list, of 2^SHORT entries at
most, which every task holds; the counts of all other words are joined to the buckets whose bigrams end
in them, so the probability of a word is its own count's, listed or not. A bigram model on top is smoothed towards these probabilities (Dirichlet prior): its counts are never gathered in one
place. Bigrams are dealt to buckets by context, those of short-listed contexts by context and word,
whose number of occurrences is known already. A bucket counts its training bigrams and builds a trie:
contexts, pointers to their successors and the successors themselves (relative to the context) are
monotone sequences in Elias-Fano form, with quantised log-probabilities, in one memory map. The bigrams
of all texts of the bucket are then looked up, and what they add to each text goes back.
"""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, stored
from .textscan import BLANKS, Block, blocks, mix, words

#: Documents whose crc32(doc_id as text) leaves this remainder are held out.
FOLDS, HELD_OUT = 7, 2
SHORT = 18
#: Weight of the prior, in tokens.
PRIOR = 500.0
#: Log-probabilities are kept in steps of 1/4096; sums of base and model in whole billionths and millionths.
STEP, BASE_UNIT, UNIT = 4096, 10**9, 10**6
#: Tokens that a task deals at a time, and tokens of a bucket.
CHUNK, BUCKET_TOKENS = 1 << 19, 5 << 18
#: Numbers of words: place in the short list, or a hash of 43 bits with this mark.
MARK = np.uint64(1 << 43)
WORD_BITS = 44
#: Context of a text's first token, dealt like a listed one; no list is that long.
START = MARK - np.uint64(1)
END = mix(np.array([0x3C2F733E], dtype=np.uint64))[0]


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte plane by byte plane, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns), 3)


def _unpack(packed: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


class EliasFano:
    """A sorted sequence: low bits side by side, high bits in unary, with a count of zeros per 64 bits."""

    def __init__(self, values: np.ndarray, universe: int) -> None:
        self.n = len(values)
        self.shift = max(0, (max(1, universe) // max(1, self.n)).bit_length() - 1)
        kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if self.shift <= bits)
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.shift)).astype(np.int64)
        size = self.n + (int(high[-1]) if self.n else 0) + 2
        size += -size % 64
        bits = np.zeros(size, dtype=np.uint8)
        bits[high + np.arange(self.n)] = 1
        zeros = 64 - bits.reshape(-1, 64).sum(axis=1, dtype=np.int64)
        parts = [(values & np.uint64((1 << self.shift) - 1)).astype(kind), np.packbits(bits), np.concatenate([[0], np.cumsum(zeros)])]
        lengths = [-(-p.nbytes // 8) * 8 for p in parts]
        memory = mmap.mmap(-1, sum(lengths))
        mapped, at = [], 0
        for p, length in zip(parts, lengths):
            view = np.frombuffer(memory, dtype=p.dtype, count=len(p), offset=at)
            view[:] = p
            mapped.append(view)
            at += length
        self.low, self.high, self.zeros = mapped
        self.last = int(high[-1]) if self.n else -1

    def _starts(self, high: np.ndarray) -> np.ndarray:
        """How many values have smaller high bits: the place of the zero before them, less the zeros."""
        out = np.zeros(len(high), dtype=np.int64)
        some = np.flatnonzero(high > 0)
        rank = high[some] - 1
        block = np.searchsorted(self.zeros, rank, side="right") - 1
        left = rank - self.zeros[block]
        for at in range(0, len(some), 1 << 15):
            part = slice(at, at + (1 << 15))
            bits = np.unpackbits(self.high.reshape(-1, 8)[block[part]], axis=1)
            place = (np.cumsum(1 - bits, axis=1, dtype=np.int16) <= left[part, None]).sum(axis=1)
            out[some[part]] = block[part] * 64 + place - rank[part]
        return out

    def successor(self, wanted: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value that is not less, and whether it is equal; inside start .. end if given."""
        wanted = wanted.astype(np.uint64)
        high = (wanted >> np.uint64(self.shift)).astype(np.int64)
        known = np.minimum(high, self.last + 1)
        low, stop = self._starts(known), np.where(known > self.last, self.n, self._starts(np.minimum(known + 1, self.last + 1)))
        if start is not None:
            low, stop = np.clip(low, start, end), np.clip(stop, start, end)
        bits, limit = (wanted & np.uint64((1 << self.shift) - 1)).astype(self.low.dtype), stop.copy()
        while (open_ := np.flatnonzero(low < stop)).size:
            middle = (low[open_] + stop[open_]) // 2
            less = self.low[middle] < bits[open_]
            low[open_[less]] = middle[less] + 1
            stop[open_[~less]] = middle[~less]
        hit = low < limit
        hit[hit] = self.low[low[hit]] == bits[hit]
        return low, hit

    def at(self, place: np.ndarray) -> np.ndarray:
        """Values at places, by the rank of their high bits."""
        ones = 64 * np.arange(len(self.zeros)) - self.zeros
        block = np.searchsorted(ones, place, side="right") - 1
        left = place - ones[block]
        high = np.empty(len(place), dtype=np.int64)
        for i in range(0, len(place), 1 << 15):
            part = slice(i, i + (1 << 15))
            bits = np.unpackbits(self.high.reshape(-1, 8)[block[part]], axis=1)
            spot = (np.cumsum(bits, axis=1, dtype=np.int16) <= left[part, None]).sum(axis=1)
            high[part] = block[part] * 64 + spot - place[part]
        return (high.astype(np.uint64) << np.uint64(self.shift)) | self.low[place].astype(np.uint64)


class Trie:
    """Contexts, pointers and successors of counted bigrams, with quantised log-probabilities."""

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray, totals: np.ndarray, lower: np.ndarray) -> None:
        """Sorted distinct (context, word) with counts; ``totals`` of the context and ``lower`` probability per pair."""
        keys, first, rank = np.unique(context, return_index=True, return_inverse=True)
        self.contexts = EliasFano(keys, 1 << WORD_BITS)
        self.pointers = EliasFano(np.append(first, len(context)), len(context) + 1)
        self.words = EliasFano((rank.astype(np.uint64) << np.uint64(WORD_BITS)) | word, max(1, len(keys)) << WORD_BITS)
        self.logs = np.rint(np.log10((count + PRIOR * lower) / (totals + PRIOR)) * STEP).astype(np.int32)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair was counted, and its log-probability: the context first, then its successors alone."""
        place, known = self.contexts.successor(context)
        hit, logs = known.copy(), np.zeros(len(context))
        rank = place[known]
        start, end = (self.pointers.at(rank + i).astype(np.int64) for i in (0, 1))
        at, found = self.words.successor((rank.astype(np.uint64) << np.uint64(WORD_BITS)) | word[known], start, end)
        hit[known] = found
        logs[np.flatnonzero(known)[found]] = self.logs[at[found]] / STEP
        return hit, logs


class Lower:
    """Counts of the short list, and what makes probabilities of these and of counts given."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, types: int, ends: int) -> None:
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.tokens, self.types, self.ends = tokens, types, ends

    def number(self, word: np.ndarray) -> np.ndarray:
        """Number of each word: its place in the short list, or its marked hash."""
        other = (word >> np.uint64(64 - 43)) | MARK
        if not len(self.hashes):
            return other
        at = np.minimum(np.searchsorted(self.hashes, word), len(self.hashes) - 1)
        return np.where(self.hashes[at] == word, at.astype(np.uint64), other)

    def log_p(self, number: np.ndarray, words_: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """By the short list, or by the counts of the (sorted) words given; a word never seen weighs as one seen once."""
        n = np.ones(len(number), dtype=np.int64)
        listed = number < MARK
        n[listed] = self.counts[number[listed].astype(np.int64)]
        if len(words_):
            at = np.minimum(np.searchsorted(words_, number), len(words_) - 1)
            n = np.where(words_[at] == number, counts[at], n)
        return np.log10(n / (self.tokens + 1))


def _held_out(doc: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % FOLDS == HELD_OUT for x in doc.to_pylist()], dtype=bool)


def _bucket(context: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    spread_key = np.where(context < MARK, context * np.uint64(0x9E3779B97F4A7C15) + word, context)
    return (mix(spread_key) % np.uint64(buckets)).astype(np.int64)


def _tokens(block: Block, lower: Lower) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens per row, the number of each token (those of a row, then its end), and the place of each row's first."""
    found = words(block, BLANKS, lower=True)
    n = np.bincount(found.row, minlength=len(block))
    size = n + 1
    token = np.full(int(size.sum()), END, dtype=np.uint64)
    token[np.arange(len(found)) + found.row] = found.hash
    return size, lower.number(token), np.cumsum(size) - size


def _bigrams(number: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context of each token, and the tokens that go to a bucket: all but a listed first one."""
    context = np.empty(len(number), dtype=np.uint64)
    context[1:] = number[:-1]
    context[opens] = START
    return context, np.flatnonzero((context != START) | (number >= MARK))


def _lower(docs: DataFrame) -> tuple[Broadcast, DataFrame]:
    """Count the training tokens; the short list and three totals reach the driver, the words seen twice or more
    outside of it stay a table: number, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        fresh: list[np.ndarray] = []

        def fold() -> None:
            nonlocal seen, n
            word, times = np.unique(np.concatenate(fresh), return_counts=True)
            both, at = np.unique(np.concatenate([seen, word]), return_inverse=True)
            seen, n = both, np.bincount(at, np.concatenate([n, times])).astype(np.int64)
            fresh.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(seen), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(seen[part].view(np.int64)), pa.array(n[part])], names=["word", "n"])

        for batch in batches:
            train = ~_held_out(batch.column(0))
            for block in blocks(batch.column(1)):
                found = words(block, BLANKS, lower=True)
                mine = train[block.first : block.last]
                fresh.append(np.append(found.hash[mine[found.row]], np.full(mine.sum(), END)))
                if sum(map(len, fresh)) > CHUNK:
                    fold()
                if len(seen) > 2 * CHUNK:
                    yield from flush()
                    seen, n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        if fresh:
            fold()
        yield from flush()

    table = stored(docs.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    end = int(END.view(np.int64))
    tokens, types, ends = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == end, F.col("n"))), F.lit(0))).first()
    short = (F.col("n") * (1 << SHORT) >= tokens) | (F.col("word") == end)
    listed = table.filter(short).toPandas()
    lower = Lower(listed["word"].to_numpy(np.int64).view(np.uint64), listed["n"].to_numpy(np.int64), tokens, types, ends)
    number = F.shiftrightunsigned("word", 64 - 43).bitwiseOR(F.lit(int(MARK)))
    others = table.filter(~short).groupBy(number.alias("number")).agg(F.sum("n").alias("n")).filter("n > 1")
    return docs.sparkSession.sparkContext.broadcast(lower), others


def _wanted(docs: DataFrame, shared: Broadcast, buckets: int) -> DataFrame:
    """bucket, number: words outside the short list that end a bigram of the bucket, once per chunk at least."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = np.concatenate(held)
            pairs = pairs[np.lexsort((pairs["number"], pairs["bucket"]))]
            new = np.ones(len(pairs), dtype=bool)
            new[1:] = pairs[1:] != pairs[:-1]
            pairs = pairs[new]
            for at in range(0, len(pairs), 1 << 16):
                part = pairs[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part[c])) for c in ("bucket", "number")], names=["bucket", "number"])
            held.clear()

        for batch in batches:
            for block in blocks(batch.column(1)):
                _, number, opens = _tokens(block, shared.value)
                context, at = _bigrams(number, opens)
                at = at[number[at] >= MARK]
                pairs = np.empty(len(at), dtype=[("bucket", "i8"), ("number", "i8")])
                pairs["bucket"], pairs["number"] = _bucket(context[at], number[at], buckets), number[at]
                held.append(pairs)
                if sum(map(len, held)) > CHUNK:
                    yield from flush()
        if held:
            yield from flush()

    return docs.mapInArrow(emit, "bucket bigint, number bigint")


ENTRY = ["u8", "u8", "u4", "u4"]
DOCS = ["i8", "u1", "u1", "i8", "i8", "i8", "i8"]
PART = ["u4", "i8", "i8", "i8"]


def score(docs: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty: its one token is the end. A null doc_id reads as the empty text in the fold.
    Rows that repeat are learned from and scored each. Without training tokens the short list is empty
    and every token has the same probability. Further columns are left out; an empty table stays empty.
    """
    docs = docs.select("doc_id", "text")
    shared, others = _lower(docs)
    buckets = max(1, shared.value.tokens // BUCKET_TOKENS + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower: Lower = shared.value
        turn, held, table, rows = 0, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn, held, table, rows
            chunk = (TaskContext.get().partitionId() << 24) + turn
            turn += 1
            context, word, row = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.lexsort((row, word, context))
            context, word, row = context[order], word[order], row[order]
            first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1]) | (row[1:] != row[:-1]))) if len(order) else order
            times = np.diff(np.append(first, len(order)))
            context, word, row = context[first], word[first], row[first]
            bucket = _bucket(context, word, buckets)
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            listed = _pack(*[np.concatenate([t[i] for t in table]).astype(k) for i, k in enumerate(DOCS)])
            for b in range(buckets):
                at = by[cuts[b] : cuts[b + 1]]
                mine = b == chunk % buckets
                if len(at) or mine:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b]), pa.array([chunk]), pa.array([_pack(context[at], word[at], row[at].astype("u4"), times[at].astype("u4"))], pa.binary()),
                         pa.array([_pack(np.concatenate([t[2] for t in table]).astype("u1"))], pa.binary()), pa.array([listed if mine else None], pa.binary())],
                        names=["bucket", "chunk", "entries", "train", "docs"],
                    )
            held, table, rows = [], [], 0

        for batch in batches:
            doc, out = batch.column(0), _held_out(batch.column(0))
            for block in blocks(batch.column(1)):
                size, number, opens = _tokens(block, lower)
                row = np.repeat(np.arange(len(block)), size)
                context, at = _bigrams(number, opens)
                held.append((context[at], number[at], row[at] + rows))
                # What needs no bucket: the score of a short-listed first token, and the base of short-listed tokens.
                listed = number < MARK
                first = np.where(listed[opens], np.rint(lower.log_p(number[opens], number[:0], number[:0]) * UNIT), 0).astype(np.int64)
                base = np.zeros(len(number), dtype=np.int64)
                if len(lower.counts):
                    base[listed] = np.rint(np.log10(lower.counts[number[listed].astype(np.int64)] + 1.0) * BASE_UNIT).astype(np.int64)
                sums = lambda x: np.add.reduceat(x, opens) if len(opens) else x[:0]  # noqa: E731, B023
                mine = doc.slice(block.first, len(block))
                table.append((
                    mine.fill_null(0).to_numpy(zero_copy_only=False), mine.is_valid().to_numpy(zero_copy_only=False), ~out[block.first : block.last], size,
                    sums(listed.astype(np.int64)), sums(base), first,
                ))
                rows += len(block)
                if sum(len(h[0]) for h in held) > CHUNK:
                    yield from flush()
        if rows:
            yield from flush()

    def reduce(group: pa.Table, rare_words: pa.Table) -> pa.Table:
        lower: Lower = shared.value
        parts = [_unpack(x, ENTRY) for x in group.column("entries").to_pylist()]
        trains = [_unpack(x, ["u1"])[0] for x in group.column("train").to_pylist()]
        context, word, row, times = (np.concatenate([p[i] for p in parts]) for i in range(4))
        chunk = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        train = np.concatenate([t[p[2]] for t, p in zip(trains, parts)]) > 0
        order = np.lexsort((word, context))
        new = np.append(True, (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1])) if len(order) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)
        pair = np.empty(len(order), dtype=np.int64)
        pair[order] = np.cumsum(new) - 1
        contexts, successors = context[order][first], word[order][first]
        counts = np.bincount(pair, times * train, minlength=len(first)) if len(first) else np.zeros(0)
        # Occurrences of each context: known for the short list, counted here for the rest.
        keys, at = np.unique(contexts, return_inverse=True)
        totals = np.bincount(at, counts, minlength=len(keys)) if len(keys) else np.zeros(0)
        listed, begins = keys < MARK, contexts == START
        inner = listed & (keys != START)
        totals[inner] = lower.counts[keys[inner].astype(np.int64)] if inner.any() else 0
        other, place = np.unique(rare_words.column("number").to_numpy().astype(np.uint64), return_index=True)
        low = lower.log_p(successors, other, rare_words.column("n").to_numpy()[place])
        seen = (counts > 0) & ~begins
        trie = Trie(contexts[seen], successors[seen], counts[seen], totals[at][seen], 10.0 ** low[seen])
        hit, logs = trie.find(contexts, successors)
        backed = np.rint(np.log10(PRIOR / (totals + PRIOR)) * STEP) / STEP
        logs = np.where(begins, low, np.where(hit, logs, backed[at] + low))
        rare = ~listed[at] if len(at) else np.zeros(0, dtype=bool)
        base = np.where(rare, np.rint(np.log10(totals[at] + 1.0) * BASE_UNIT), 0).astype(np.int64)
        known = rare & (totals[at] > 0)
        points = np.rint(logs * UNIT).astype(np.int64)
        out = []
        times = times.astype(np.int64)
        names, tables = group.column("chunk").to_pylist(), group.column("docs").to_pylist()
        edges = np.searchsorted(chunk, np.arange(len(parts) + 1))
        for i, name in enumerate(names):
            mine = slice(edges[i], edges[i + 1])
            rows_, inverse = np.unique(row[mine], return_inverse=True)
            p, t = pair[mine], times[mine]
            sums = [np.zeros(len(rows_), dtype=np.int64) for _ in range(3)]
            for s, x in zip(sums, (points, base, known.astype(np.int64))):
                np.add.at(s, inverse, x[p] * t)
            out.append({"chunk": name, "sums": _pack(rows_.astype("u4"), *sums), "docs": tables[i]})
        return pa.Table.from_pylist(out, schema=pa.schema([("chunk", pa.int64()), ("sums", pa.binary()), ("docs", pa.binary())]))

    def finish(group: pa.Table) -> pa.Table:
        lower: Lower = shared.value
        doc, valid, train, size, known, base, points = _unpack(next(x for x in group.column("docs").to_pylist() if x is not None), DOCS)
        for packed in group.column("sums").to_pylist():
            row, more_points, more_base, more_known = _unpack(packed, PART)
            points[row] += more_points
            base[row] += more_base
            known[row] += more_known
        total = lower.tokens + lower.types + 1
        return pa.table({
            "doc_id": pa.array(doc, mask=valid == 0), "held_out": pa.array(train == 0), "n_tokens": size, "n_known": known,
            "train_tokens": np.full(len(doc), lower.tokens, dtype=np.int64),
            "base_score": base / BASE_UNIT - size * np.log10(float(total)), "score": points / UNIT,
        })

    dealt = docs.mapInArrow(deal, "bucket bigint, chunk bigint, entries binary, train binary, docs binary")
    rare_words = _wanted(docs, shared, buckets).join(others, "number").select("bucket", "number", "n")
    summed = spread(dealt, "bucket").groupBy("bucket").cogroup(spread(rare_words, "bucket").groupBy("bucket")).applyInArrow(reduce, "chunk bigint, sums binary, docs binary")
    return spread(summed, "chunk").groupBy("chunk").applyInArrow(
        finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
