"""The n-gram model of the quality rules: whole alphabets, smoothing against a plain model, n-grams outside the list."""

import collections
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ringsift.llm import quality
from ringsift.llm.textscan import blocks

DOCS = "doc_id bigint, text string, lang string"


def syllables(seed, n, parts):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n))


CYRILLIC = "ста но то ен пр во ко ра не ро на по ли ре ал ни ер го ос де".split()
CHINESE = "的 一 是 不 了 人 我 在 有 他 这 中 大 来 上 国 们 到 说 时".split()


@pytest.mark.parametrize(("parts", "flip"), [(CYRILLIC, 8), (CHINESE, 8)])
def test_garbled_letters_outside_ascii_are_out_of_band(spark, parts, flip):
    """Letters that differ in one bit of their last byte were one class, so a garbled text scored like a good one."""
    good = [(i, syllables(i, 200, parts), "xx") for i in range(40)]
    garbled = "".join(c if c == " " else chr(ord(c) ^ flip) for c in syllables(99, 200, parts))
    got = quality.assess(spark.createDataFrame([*good, (99, garbled, "xx")], DOCS)).filter("not kept").collect()
    assert {r.doc_id for r in got} == {99} and not got[0].base_failed


def test_copies_of_noise_do_not_foretell_themselves(spark):
    rng = np.random.default_rng(5)
    noise = " ".join("".join(chr(c) for c in rng.integers(0x430, 0x450, 9)) for _ in range(200))
    rows = [(i, syllables(i, 200, CYRILLIC), "ru") for i in range(40)] + [(100 + i, noise, "ru") for i in range(4)]
    assert {r.doc_id for r in quality.assess(spark.createDataFrame(rows, DOCS)).filter("not kept").collect()} == {100, 101, 102, 103}


def test_code_points_of_rows():
    texts = ["aé中😀Z", None, "", "Ж", "\x00ÿ࿿\U0010ffff"]
    (block,) = blocks(pa.array(texts))
    points, offsets = quality.code_points(block)
    want = [[ord(c.lower() if c.isascii() else c) for c in t or ""] for t in texts]
    assert [points[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


def test_smoothing_follows_the_plain_model(spark):
    """Both folds against the model in memory, over 63 letters and 5 of them to an n-gram; n-grams by brute force."""
    rng = np.random.default_rng(3)
    letters = [chr(0x4E00 + 7 * i) for i in range(63)]
    weights = 1 / np.arange(1, 64)
    texts = ["".join(rng.choice(letters, 300, p=weights / weights.sum())) for _ in range(12)] + ["".join(letters), None, ""]
    counts = [collections.Counter(), collections.Counter()]
    for t in texts:
        ids = [63] * 4 + [letters.index(c) for c in t or ""]
        for i in range(4, len(ids)):
            counts[1 - (zlib.crc32(t.encode()) & 1)][sum(x << (6 * (4 - j)) for j, x in enumerate(ids[i - 4 : i + 1]))] += 1
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = quality._smoothed(quality.stored(quality.count_grams(table), "grams")).collect()
    ids = {ord(c): i for i, c in enumerate(letters)} | {quality.PAD: 63}
    mask = (1 << quality.BITS) - 1
    split = [[r.hi >> 21 & mask, r.hi & mask, r.lo >> 42, r.lo >> 21 & mask, r.lo & mask] for r in rows]
    codes = np.array([sum(ids[x] << (6 * (4 - j)) for j, x in enumerate(s)) for s in split])
    assert {c: r.n for c, r in zip(codes.tolist(), rows)} == dict(counts[0] + counts[1])
    for fold, found in enumerate(([r.p0 for r in rows], [r.p1 for r in rows])):
        model = quality.Model(np.array(list(counts[fold])), np.array(list(counts[fold].values())), order=5)
        assert counts[fold] and np.abs(model.log_p(codes) - np.log(found) * quality.MICRO).max() < 6


def test_rows_do_not_depend_on_the_list(spark, monkeypatch):
    rows = [(i, syllables(i, 20 + i, CYRILLIC), [None, "ru"][i % 2]) for i in range(20)]
    table = spark.createDataFrame([*rows, rows[3], (None, "one two", "ru"), (5, None, "ru"), (6, "", None)], DOCS)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words)
    want = sorted(quality.assess(table).collect(), key=key)
    monkeypatch.setattr(quality, "LISTED", 20)
    assert sorted(quality.assess(table).collect(), key=key) == want
    monkeypatch.setattr(quality, "LISTED", 0)
    assert quality.keep_good(table).count() == sum(r.kept for r in want) > 0


def test_the_list_reaches_the_driver_as_columns(spark):
    """In a session without the Arrow setting each n-gram came as a row of Python objects, 600 bytes and more."""
    rng = np.random.default_rng(6)
    texts = [("".join(chr(c) for c in rng.integers(0x4E00, 0x5E00, 2000)),) for _ in range(40)]
    table = spark.createDataFrame(texts, "text string").repartition(3)
    arrow = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(arrow)
    spark.conf.set(arrow, "false")
    tracemalloc.start()
    try:
        held, others = quality.train(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set(arrow, before)
    listed = held.value
    assert listed.logs.shape == (2, len(listed.hashes)) and len(listed.hashes) > 75_000 and others.isEmpty()
    assert listed.logs.max() < 0 and (np.diff(listed.hashes) > 0).all()
    assert peak < 200 * len(listed.hashes)
