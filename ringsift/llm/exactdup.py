"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each sender (a task, or a part of one if it has many rows) sorts the 48-bit fingerprints of its texts
and sends every distinct one once, as Golomb codes of the gaps, to the owner of its range: one blob per
owner. Owners decode, find the fingerprints that several senders hold, and answer with one bitmap per
sender. Only rows whose bit is set, or whose fingerprint the sender holds twice itself, are suspects;
only their texts are grouped, byte for byte.

A fingerprint shared by chance makes a suspect, never a duplicate: among N texts a text is one by
chance with N / 2**48. An owner gets a text that fills a third of the corpus once per sender.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .textscan import blocks

FINGERPRINT_BITS = 48
#: Rows that a sender sorts at a time (2**17 at most), and distinct fingerprints that an owner gets on average at most.
SENDER_ROWS, OWNER_PRINTS = 1 << 17, 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def encode(values: np.ndarray, span: int) -> tuple[int, bytes]:
    """Golomb codes, divisor 2**k, of the gaps between rising distinct numbers below ``span``: k and the bits.

    The quotients come first, each as zeros ended by a one, then the remainders in k bits each.
    """
    gaps = np.diff(values, prepend=-1) - 1
    k = max(0, int(math.log2(max(1.0, math.log(2) * span / len(values)))))
    ones = np.cumsum((gaps >> k) + 1) - 1
    bits = np.zeros(int(ones[-1]) + 1 + k * len(values), dtype=np.uint8)
    bits[ones] = 1
    bits[int(ones[-1]) + 1 :] = ((gaps[:, None] >> np.arange(k)) & 1).ravel()
    return k, np.packbits(bits).tobytes()


def decode(k: int, n: int, code: bytes) -> np.ndarray:
    """The ``n`` numbers of a code."""
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    ones = np.flatnonzero(bits)[:n]
    rest = bits[ones[-1] + 1 : ones[-1] + 1 + k * n].reshape(n, k).astype(np.int64)
    gaps = ((np.diff(ones, prepend=-1) - 1) << k) + (rest << np.arange(k)).sum(axis=1)
    return np.cumsum(gaps + 1) - 1


def prints(digests: bytes, width: int) -> np.ndarray:
    """Fingerprints: the first ``width`` bits of each SHA-256 digest."""
    whole = np.frombuffer(digests, dtype=">u8").reshape(-1, 4)[:, 0]
    return (whole >> np.uint64(64 - width)).astype(np.int64)


def _sent(docs: DataFrame, span: int, width: int = FINGERPRINT_BITS, most: int = SENDER_ROWS) -> DataFrame:
    """One row per sender and owner: the codes, and what the sender keeps to itself (ids and digests in order)."""

    def send(sender: int, ids: list[pa.Array], digests: list[bytes]) -> pa.RecordBatch:
        joined = b"".join(digests)
        found = prints(joined, width)
        order = np.argsort(found, kind="stable")
        found = found[order]
        digest = np.frombuffer(joined, dtype="V32")[order]
        held = pa.concat_arrays(ids).take(pa.array(order))
        owner = found // span
        cuts = np.concatenate([np.flatnonzero(np.diff(owner, prepend=-1)), [len(found)]])
        rows = []
        for at, end in zip(cuts[:-1], cuts[1:]):
            distinct = np.unique(found[at:end]) - owner[at] * span
            k, code = encode(distinct, span)
            rows.append((sender, int(owner[at]), len(distinct), k, code, (sender << 17) + int(at), digest[at:end].tobytes()))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary()))]
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), held)
        return pa.RecordBatch.from_arrays([*columns, lists], names=["sender", "owner", "n", "k", "codes", "place", "digests", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = TaskContext.get().partitionId() << 20
        ids: list[pa.Array] = []
        digests: list[bytes] = []
        for batch in batches:
            for block in blocks(batch.column(1)):
                view = memoryview(_LOWER[block.data])
                for at in range(0, len(block), most):
                    end = min(at + most, len(block))
                    if sum(map(len, ids)) + end - at > most:
                        yield send(sender, ids, digests)
                        sender, ids, digests = sender + 1, [], []
                    ids.append(batch.column(0).slice(block.first + at, end - at))
                    offsets = block.offsets[at : end + 1].tolist()
                    digests.append(b"".join(sha256(view[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])))
        if ids:
            yield send(sender, ids, digests)

    schema = "sender bigint, owner int, n int, k int, codes binary, place bigint, digests binary, ids array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def _answers(sent: DataFrame) -> DataFrame:
    """sender, owner, bits: which of the fingerprints sent others sent as well; senders without any get no answer."""

    def run(group: pa.Table) -> pa.Table:
        ns = group.column("n").to_numpy()
        got = np.concatenate([decode(k, n, c) for k, n, c in zip(*(group.column(x).to_pylist() for x in ("k", "n", "codes")))])
        _, at, count = np.unique(got, return_inverse=True, return_counts=True)
        shared = np.split(count[at] > 1, np.cumsum(ns)[:-1])
        some = [i for i, x in enumerate(shared) if x.any()]
        bits = [np.packbits(shared[i]).tobytes() for i in some]
        return group.select(["sender", "owner"]).take(pa.array(some, pa.int64())).append_column("bits", pa.array(bits, pa.binary()))

    return sent.select("sender", "owner", "n", "k", "codes").groupBy("owner").applyInArrow(run, "sender bigint, owner int, bits binary")


def _marked(sent: DataFrame, answers: DataFrame, width: int) -> DataFrame:
    """doc_id, place (one number per row), text_sha256, suspect: senders read the answers."""
    both = sent.select("sender", "owner", "place", "digests", "ids").join(answers, ["sender", "owner"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            for i in range(batch.num_rows):
                digests = batch.column(1)[i].as_py()
                _, at, count = np.unique(prints(digests, width), return_inverse=True, return_counts=True)
                suspect = count > 1
                if batch.column(3)[i].is_valid:
                    suspect |= np.unpackbits(np.frombuffer(batch.column(3)[i].as_py(), dtype=np.uint8))[: len(count)].astype(bool)
                place = batch.column(0)[i].as_py() + np.arange(len(at))
                names = [digests[j : j + 32].hex() for j in range(0, len(digests), 32)]
                yield pa.RecordBatch.from_arrays(
                    [ids[i].values, pa.array(place), pa.array(names), pa.array(suspect[at])], names=["doc_id", "place", "text_sha256", "suspect"]
                )

    return both.select("place", "digests", "ids", "bits").mapInArrow(run, "doc_id bigint, place bigint, text_sha256 string, suspect boolean")


def lowered(text: Column) -> Column:
    """A text with A-Z in lower case and nothing else changed; null reads as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER_LETTERS, _UPPER_LETTERS.lower())


def groups(docs: DataFrame, width: int = FINGERPRINT_BITS, sender_rows: int = SENDER_ROWS) -> DataFrame:
    """One row per row of documents: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they agree byte for byte after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest doc_id stays (a row without a doc_id only if none has one); of rows
    that repeat that doc_id one stays. Texts of any length are read whole; other columns are left
    aside; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / OWNER_PRINTS))
    sent = stored(_sent(docs, -(-(1 << width) // owners), width, sender_rows), "sent")
    marked = stored(_marked(sent, _answers(sent), width), "marked")

    suspects = marked.filter("suspect")
    named = suspects.select(F.col("doc_id").alias("_named")).distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = texts.join(named, F.col("doc_id").eqNullSafe(F.col("_named")), "left_semi")
    equal = texts.select("doc_id", lowered(F.col("text")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    equal = equal.select(F.sha2("text", 256).alias("text_sha256"), "group_size", "keep_id")
    # Of rows that repeat the doc_id that stays, the last place stays.
    first = suspects.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "place")).getField("place").alias("stays"))
    # Written, so that the join of the suspects is a stage of its own, which Spark can split where a text fills it.
    found = suspects.join(stored(equal.join(first, "text_sha256"), "classes"), "text_sha256")

    single = marked.filter(~F.col("suspect"))
    alone = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(found.select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("stays")).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of documents without exact copies, with the columns of the input."""
    kept = groups(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    on = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_sha"))
    named = docs.withColumns({"_doc": F.col("doc_id").cast("bigint"), "_text": F.sha2(lowered(F.col("text")), 256)})
    return named.join(kept, on, "left_semi").dropDuplicates(["_doc", "_text"]).drop("_doc", "_text")


#: DuckDB SQL for the rows of :func:`groups`.
GROUPS_SQL = f"""WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER_LETTERS}', '{_UPPER_LETTERS.lower()}')) AS text_sha256 FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""
