"""Repeated passages by common-prefix intervals of an enhanced suffix array.

Two equal strings of ``LENGTH`` bytes select the same anchor, the least hash of the short grams inside
them. Windows (strings of that length) that follow each other and select the same anchor value form a
run, so texts are cut into runs, and equal windows always meet under one anchor value.

1. Anchor values that occur in two documents or more are found and noted in a bitmap of fixed size;
   other runs hold nothing that repeats. The bitmap may name too many runs, never too few.
2. A task folds equal runs: those outside the least document are covered already. The first one of
   that document goes to the bucket of its anchor value, so a passage of many copies is one row per
   task there; of its further copies in the same document only the places go along.
3. In a bucket, all suffixes of the runs are sorted and their longest common prefixes computed. A
   stack scan yields the common-prefix intervals of ``LENGTH`` or more; intervals whose occurrences
   are preceded by different bytes (or open a run) are the maximal repeats, with all occurrences.
   Every occurrence outside the least document is covered, and so are the same bytes of the copies
   of its run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread
from .textscan import Block, blocks, mix, span_hash

#: Bytes of a window, of a gram, and windows of a run at most (a gram lies inside each of them).
LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM + 1
#: Bits of the map of anchor values (32 MB), and bytes of text for one bucket.
MAP_BITS, BUCKET_BYTES = 28, 2 << 20
#: Runs that a task folds at a time, suffixes that are sorted at a time, and runs whose bytes are looked at in
#: one go (numbers of eight bytes are made for each byte).
FOLD, SORTED, STRETCH = 1 << 17, 1 << 14, 1 << 12

#: What is known of a run, and of a covered span; ``text`` tells rows of one doc_id apart.
RUN = np.dtype([("doc", "i8"), ("text", "i4"), ("start", "i4"), ("windows", "u1"), ("left", "i2")])
#: A further copy of the run with this number, in the same document.
COPY = np.dtype([("run", "i4"), ("text", "i4"), ("start", "i4")])
SPAN = np.dtype([("doc", "i8"), ("text", "i4"), ("start", "i4"), ("end", "i4")])
SPANS = "doc_id bigint, text_hash int, start int, end int"


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on, by doubling."""
    table = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    value, size, factor = table[data], 1, 0xD1342543DE82EF95
    while size < GRAM:
        value = value[:-size] * np.uint64(factor) + value[size:]
        factor = factor * factor % (1 << 64)
        size *= 2
    return mix(value)


def runs(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, number of windows and anchor value of each run of a block."""
    none = np.zeros(0, dtype=np.int64)
    if len(block.data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    least, size = _grams(block.data), 1
    while size * 2 <= REACH:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if REACH > size:
        least = np.minimum(least[: len(least) - (REACH - size)], least[REACH - size :])
    ends = block.offsets[1:]
    # Windows that lie inside one text.
    at = np.arange(len(least))
    row = np.searchsorted(block.offsets, at, side="right") - 1
    inside = at + LENGTH <= ends[row]
    at, row, least = at[inside], row[inside], least[inside]
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    # A run that never changes its anchor, as in periodic text, is cut to a fixed number of windows.
    n = np.diff(np.append(first, len(at)))
    pieces = (n + REACH - 1) // REACH
    begin = np.repeat(first, pieces) + REACH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    count = np.minimum(REACH, np.repeat(first + n, pieces) - begin)
    # Least hashes are small numbers; mixed again they spread over all buckets and all bits of the map.
    return row[begin], at[begin], count, mix(least[begin])


def _stretches(n: int) -> Iterator[slice]:
    return (slice(i, min(i + STRETCH, n)) for i in range(0, n, STRETCH))


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), then those of the next."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _bucket(anchor: np.ndarray, bits: int) -> np.ndarray:
    return (anchor >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(anchor), dtype=np.int64)


def _dealt(bucket: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets and the (ordered) members of each."""
    cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else np.zeros(0, dtype=np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(bucket[order[a]]), order[a:b]


def _repeated_anchors(docs: DataFrame, bits: int) -> Broadcast:
    """Bitmap of anchor values that two documents or more select; at most 2^MAP_BITS bits reach the driver."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            # One entry per anchor value and document here; a value in two documents is sent twice, and not more.
            value = np.sort(np.concatenate(held))
            twice = np.ones(len(value), dtype=bool)
            twice[2:] = value[2:] != value[:-2]
            value = value[twice]
            rows = [(b, value[at].tobytes()) for b, at in _dealt(_bucket(value, bits), np.arange(len(value)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "anchors"])
            held.clear()

        for batch in batches:
            for block in blocks(batch.column(0)):
                row, _, _, anchor = runs(block)
                order = np.lexsort((anchor, row))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (row[order][1:] != row[order][:-1])
                held.append(anchor[order][new])
                if sum(map(len, held)) > 4 * FOLD:
                    yield from flush()
        if held:
            yield from flush()

    share = MAP_BITS - bits

    def reduce(group: pa.Table) -> pa.Table:
        value = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in group.column("anchors").to_pylist()]))
        again = np.unique(value[1:][value[1:] == value[:-1]])
        marks = np.zeros(1 << share, dtype=bool)
        marks[(again >> np.uint64(64 - MAP_BITS)).astype(np.int64) & ((1 << share) - 1)] = True
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    parts = spread(docs.select("text").mapInArrow(emit, "bucket bigint, anchors binary"), "bucket").groupBy("bucket").applyInArrow(reduce, "bucket bigint, marks binary")
    whole = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    size = 1 << (share - 3)
    for part in parts.toLocalIterator():
        whole[part["bucket"] * size : (part["bucket"] + 1) * size] = np.frombuffer(part["marks"], dtype=np.uint8)
    return docs.sparkSession.sparkContext.broadcast(whole)


def _known(marks: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    at = (anchor >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _pack(records: np.ndarray) -> bytes:
    """Records column by column, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(records[c]).tobytes() for c in records.dtype.names), 3)


def _unpack(parts: list[bytes], kind: np.dtype) -> np.ndarray:
    out = [np.zeros(0, dtype=kind)]
    for part in filter(None, parts):
        raw = zstandard.decompress(part)
        records = np.empty(len(raw) // kind.itemsize, dtype=kind)
        at = 0
        for c in kind.names:
            size = len(records) * kind[c].itemsize
            records[c] = np.frombuffer(raw, dtype=kind[c], count=len(records), offset=at)
            at += size
        out.append(records)
    return np.concatenate(out)


class _Fold:
    """Equal runs of a task: the first of the least document is kept with the places of its copies there, the others are covered."""

    def __init__(self, bits: int) -> None:
        self.bits, self.count = bits, 0
        self.runs, self.keys, self.anchors, self.bytes = [], [], [], []

    def add(self, block: Block, doc: np.ndarray, marks: np.ndarray) -> None:
        row, start, windows, anchor = runs(block)
        use = _known(marks, anchor)
        row, start, windows, anchor = row[use], start[use], windows[use], anchor[use]
        if not len(row):
            return
        found = np.empty(len(row), dtype=RUN)
        found["doc"], found["text"], found["windows"] = doc[row], _text_hash(block)[row], windows
        found["start"] = start - block.offsets[row]
        found["left"] = np.where(found["start"] > 0, block.data[np.maximum(start - 1, 0)], -1)
        self.runs.append(found)
        self.anchors.append(anchor)
        self.keys.append(span_hash(block, start, start + windows + LENGTH - 1))
        self.bytes += [block.data[_places(start[s], windows[s] + LENGTH - 1)] for s in _stretches(len(row))]
        self.count += len(row)

    def flush(self) -> Iterator[pa.RecordBatch]:
        found, key, data = np.concatenate(self.runs), np.concatenate(self.keys), np.concatenate(self.bytes)
        size = found["windows"].astype(np.int64) + LENGTH - 1
        begin = np.cumsum(size) - size
        order = np.lexsort((found["start"], found["doc"], key))
        first = np.ones(len(order), dtype=bool)
        first[1:] = key[order][1:] != key[order][:-1]
        owner = found["doc"][order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        other = order[found["doc"][order] > owner]
        spans = _merged(found[other], size[other])
        place = np.flatnonzero(first)
        kept = order[place]
        # Copies in the document of the kept run come right behind it.
        copies = np.add.reduceat((found["doc"][order] == owner).astype(np.int64), place) - 1
        bucket = _bucket(np.concatenate(self.anchors), self.bits)
        rows = []
        for b, group in _dealt(bucket[kept], np.argsort(bucket[kept], kind="stable")):
            at = kept[group]
            text = np.concatenate([data[_places(begin[at[s]], size[at[s]])] for s in _stretches(len(at))])
            copy = found[order[_places(place[group] + 1, copies[group])]]
            again = np.empty(len(copy), dtype=COPY)
            again["run"], again["text"], again["start"] = np.repeat(np.arange(len(at)), copies[group]), copy["text"], copy["start"]
            rows.append((b, _pack(found[at]), zstandard.compress(text.tobytes(), 3), _pack(again) if len(again) else b"", b""))
        if len(spans):
            rows.append((int(spans["text"][0]) & ((1 << self.bits) - 1), b"", b"", b"", _pack(spans)))
        for at in range(0, len(rows), 64):
            part = list(zip(*rows[at : at + 64]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), *[pa.array(x, pa.binary()) for x in part[1:]]], names=["bucket", "runs", "data", "copies", "spans"])
        self.runs, self.keys, self.anchors, self.bytes, self.count = [], [], [], [], 0


def _text_hash(block: Block) -> np.ndarray:
    return span_hash(block, block.offsets[:-1], block.offsets[1:]).astype(np.uint32).view(np.int32)


def _merged(found: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Covered spans, joined where they touch."""
    out = np.empty(len(found), dtype=SPAN)
    out["doc"], out["text"], out["start"], out["end"] = found["doc"], found["text"], found["start"], found["start"] + size
    return joined(out)


def joined(spans: np.ndarray) -> np.ndarray:
    """Union of spans per document, sorted."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["text"], spans["doc"]))]
    change = np.ones(len(spans), dtype=bool)
    change[1:] = (spans["doc"][1:] != spans["doc"][:-1]) | (spans["text"][1:] != spans["text"][:-1])
    group = np.cumsum(change)
    # Ends grow along a document; the group number keeps documents apart in one running maximum.
    base = np.int64(spans["end"].max()) + 1
    reach = np.maximum.accumulate(spans["end"].astype(np.int64) + group * base) - group * base
    new = change.copy()
    new[1:] |= spans["start"][1:] > reach[:-1]
    first = np.flatnonzero(new)
    out = spans[first].copy()
    out["end"] = reach[np.append(first[1:], len(spans)) - 1]
    return out


def suffix_array(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[begin:end], and the longest common prefix with the one before.

    A suffix is at most ``LENGTH`` + ``REACH`` bytes long. It is packed with a byte for its length
    behind it, so that a prefix sorts first and zero bytes stay apart from padding.
    """
    width = LENGTH + REACH
    size = end - begin
    place = begin[:, None] + np.arange(width)[None, :]
    packed = np.zeros((len(begin), width + 8 - width % 8), dtype=np.uint8)
    use = np.arange(width)[None, :] < size[:, None]
    packed[:, :width][use] = data[place[use]]
    packed[:, -1] = size
    words = packed.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    rows = packed[order, :width]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    lcp = np.zeros(len(order), dtype=np.int64)
    lcp[1:] = np.minimum(common, np.minimum(size[order][1:], size[order][:-1]))
    return order, lcp


def intervals(lcp: np.ndarray, least: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of at least ``least``, children before parents, by a stack scan."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp.tolist(), 0]):
        first = i - 1
        while stack and stack[-1][0] > depth:
            length, first = stack.pop()
            yield length, first, i - 1
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def _prefixes(data: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Hash of the first ``LENGTH`` bytes of each window of the runs."""
    out = [np.zeros(0, dtype=np.uint64)]
    for s in _stretches(len(begin)):
        low, high = int(begin[s][0]), int(begin[s][-1] + windows[s][-1]) + LENGTH - 1
        start = _places(begin[s] - low, windows[s])
        out.append(span_hash(Block(0, 0, data[low:high], np.zeros(1, dtype=np.int64)), start, start + LENGTH))
    return np.concatenate(out)


def _copies(runs_: list[bytes], copies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a bucket's entries, and their copies by the number of the run in all of them."""
    found, again, n = [np.zeros(0, dtype=RUN)], [np.zeros(0, dtype=COPY)], 0
    for r, c in zip(runs_, copies):
        found.append(_unpack([r], RUN))
        again.append(_unpack([c], COPY))
        again[-1]["run"] += n
        n += len(found[-1])
    return np.concatenate(found), np.concatenate(again)


def _covered(found: np.ndarray, data: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Spans of a bucket's runs, and of the copies of these, that stand in a smaller document as well.

    Suffixes are worked off in parts by the hash of their first ``LENGTH`` bytes: suffixes that share
    a prefix of that length share the part, so no part grows with the number of runs of one anchor.
    """
    windows = found["windows"].astype(np.int64)
    size = windows + LENGTH - 1
    begin = np.cumsum(size) - size
    # Four bytes each: a bucket holds far fewer than 2^31 bytes.
    run = np.repeat(np.arange(len(found), dtype=np.int32), windows)
    shift = np.arange(len(run), dtype=np.int32) - np.repeat((np.cumsum(windows) - windows).astype(np.int32), windows)
    start = begin.astype(np.int32)[run] + shift
    prefix = _prefixes(data, begin, windows)
    order = np.argsort(prefix)
    doc = found["doc"][run]
    # The byte before; a run's first window counts as preceded by something of its own.
    left = np.where(shift > 0, data[np.maximum(start - 1, 0)].astype(np.int32), -1 - run)
    # Only prefixes that stand in several documents and after different bytes can begin a maximal repeat.
    first = np.flatnonzero(np.append(True, prefix[order][1:] != prefix[order][:-1])) if len(order) else np.zeros(0, dtype=np.int64)
    if not len(first):
        return np.zeros(0, dtype=SPAN)
    varies = lambda x: np.minimum.reduceat(x[order], first) != np.maximum.reduceat(x[order], first)
    use = order[np.repeat(varies(doc) & varies(left), np.diff(np.append(first, len(order))))]
    parts = len(use) // SORTED + 1
    part = prefix[use] % np.uint64(parts)
    out = []
    for i in range(parts):
        at = use[part == i]
        if len(at):
            out.append(_scan(found, data, run[at], shift[at], start[at], (begin + size)[run[at]], left[at]))
    return _placed(joined(np.concatenate(out)), found, copies) if out else np.zeros(0, dtype=SPAN)


def _placed(spans: np.ndarray, found: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Spans inside runs (``doc`` is the number of the run) as spans of the run's text and of its copies."""
    own = np.empty(len(found), dtype=COPY)
    own["run"], own["text"], own["start"] = np.arange(len(found)), found["text"], found["start"]
    every = np.concatenate([own, copies])
    every = every[np.argsort(every["run"], kind="stable")]
    count = np.bincount(every["run"], minlength=len(found))
    begin = np.cumsum(count) - count
    run = spans["doc"]
    at = every[_places(begin[run], count[run])]
    out = np.repeat(spans, count[run])
    out["doc"], out["text"] = found["doc"][at["run"]], at["text"]
    out["start"] += at["start"]
    out["end"] += at["start"]
    return joined(out)


def _scan(found: np.ndarray, data: np.ndarray, run: np.ndarray, shift: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Covered spans inside the runs (``doc`` is the number of the run), from the left-maximal common-prefix intervals of the suffixes data[start:end]."""
    order, lcp = suffix_array(data, start, end)
    run, shift, left = run[order], shift[order], left[order]
    doc = found["doc"][run]
    out_at, out_length = [], []
    for length, first, last in intervals(lcp):
        part = left[first : last + 1]
        if (part == part[0]).all():
            continue  # not left-maximal: the interval of the string one byte longer to the left holds it
        docs = doc[first : last + 1]
        at = first + np.flatnonzero(docs > docs.min())
        if len(at):
            out_at.append(at)
            out_length.append(np.full(len(at), length))
    if not out_at:
        return np.zeros(0, dtype=SPAN)
    at, length = np.concatenate(out_at), np.concatenate(out_length)
    out = np.empty(len(at), dtype=SPAN)
    out["doc"], out["text"] = run[at], 0
    out["start"] = shift[at]
    out["end"] = out["start"] + length
    return joined(out)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, end (bytes): pieces whose every window also starts in a smaller document."""
    named = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(20, max(0, (total // BUCKET_BYTES).bit_length()))
    marks = _repeated_anchors(named, bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = _Fold(bits)
        for batch in batches:
            for block in blocks(batch.column(1)):
                fold.add(block, batch.column(0).to_numpy()[block.first : block.last], marks.value)
                if fold.count > FOLD:
                    yield from fold.flush()
        if fold.count:
            yield from fold.flush()

    def reduce(group: pa.Table) -> pa.Table:
        runs_, data, copies, spans = (group.column(c).to_pylist() for c in ("runs", "data", "copies", "spans"))
        text = np.frombuffer(b"".join(zstandard.decompress(x) for x in data if x), dtype=np.uint8)
        found, again = _copies(runs_, copies)
        spans = joined(np.concatenate([_unpack(spans, SPAN), _covered(found, text, again)]))
        return pa.table({n: pa.array(spans[c]) for n, c in zip(("doc_id", "text_hash", "start", "end"), SPAN.names)})

    entries = named.mapInArrow(emit, "bucket bigint, runs binary, data binary, copies binary, spans binary")
    return spread(entries, "bucket").groupBy("bucket").applyInArrow(reduce, SPANS)


def cleaned(docs: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    Bytes covered by a string of 50 bytes that also starts in a document with a smaller doc_id are
    removed; strings are judged on the input. A null text is empty. A row without a doc_id is smaller
    or larger than nothing: it loses nothing and covers nothing. Rows that share a doc_id do not cover
    each other. Further columns are left out; an empty table stays empty.
    """
    spans = repeated_spans(docs).groupBy("doc_id").agg(F.collect_list(F.struct("text_hash", "start", "end")).alias("spans"))
    rows = docs.select("doc_id", "text").join(spans, "doc_id", "left").select(
        "doc_id", F.expr("transform(spans, s -> s.text_hash)").alias("h"), F.expr("transform(spans, s -> s.start)").alias("s"), F.expr("transform(spans, s -> s.end)").alias("e"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(4)):
                part = batch.slice(block.first, len(block))
                text = _text_hash(block)
                removed, pieces, kept = [], [], []
                for r in range(len(block)):
                    whole = block.data[block.offsets[r] : block.offsets[r + 1]]
                    keep = np.ones(len(whole) + 1, dtype=bool)
                    if part.column(1)[r].is_valid:
                        h, s, e = (part.column(c)[r].values.to_numpy() for c in (1, 2, 3))
                        for a, b in zip(s[h == text[r]], e[h == text[r]]):
                            keep[a:b] = False
                    removed.append(int((~keep).sum()))
                    pieces.append(int((~keep[:-1] & keep[1:]).sum()))
                    kept.append(whole[keep[:-1]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(block.offsets)), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
