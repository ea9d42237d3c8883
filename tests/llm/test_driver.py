"""What the driver holds: each stage of a job costs it megabytes for a while, so work that changes nothing runs none."""

import uuid

import pyarrow as pa
import pytest

from ringsift.llm import contamination, neardup, quality, textscan


@pytest.fixture
def jobs(spark):
    """Number of Spark jobs that a function starts."""

    def count(run):
        sc, group = spark.sparkContext, uuid.uuid4().hex
        sc.setJobGroup(group, group)
        try:
            run()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        return len(sc.statusTracker().getJobIdsForGroup(group))

    return count


def test_stars_need_no_round(spark, jobs):
    """Links to the least id are components already; rounds that only confirm it ran about twenty jobs."""
    links = spark.createDataFrame([(i // 10 * 10, i) for i in range(100)], "a bigint, b bigint")
    assert jobs(lambda: neardup.components(links)) <= 7
    assert {r.id: r.label for r in neardup.components(links).collect()} == {i: i // 10 * 10 for i in range(100)}


@pytest.mark.parametrize(
    ("links", "want"),
    [
        ([], {}),
        ([(1, 1), (None, 2), (3, None)], {}),
        ([(5, 1), (1, 5), (5, 1)], {1: 1, 5: 1}),
        ([(1, 3), (2, 3)], {1: 1, 2: 1, 3: 1}),
        ([(1, 2), (2, 3)], {1: 1, 2: 1, 3: 1}),
        ([(9, 7), (7, 8), (4, 3), (8, 4), (20, 10), (10, 30)], {3: 3, 4: 3, 7: 3, 8: 3, 9: 3, 10: 10, 20: 10, 30: 10}),
        ([(0, i) for i in range(1, 50)] + [(49, i) for i in range(50, 99)], {i: 0 for i in range(99)}),
    ],
)
def test_links_that_are_no_stars_go_on(spark, links, want):
    got = [tuple(r) for r in neardup.components(spark.createDataFrame(links, "a bigint, b bigint")).select("id", "label").collect()]
    assert sorted(got) == sorted(want.items())


def test_counts_of_all_sizes_take_one_job(spark, jobs):
    """Each size of n-gram had a job of its own for how many n-grams are rare."""
    rows = [(i, f"word {i} and so on " * 12, "xx") for i in range(30)]
    counts = quality.stored(quality.count_grams(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")), "grams")
    assert jobs(lambda: quality._smoothed(counts)) <= 27


def test_no_texts_have_no_model(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert quality._smoothed(quality.count_grams(empty)).count() == 0


def test_short_texts_take_short_tables(monkeypatch):
    """Whoever read a word held two tables for a block of two megabytes, 34 MB; the driver reads the benchmark."""
    monkeypatch.setattr(textscan, "_powers", {})
    contamination.Test(["a", "b", "c"], ["some words of an item", "", "x"], 13)
    assert sum(x.nbytes for x in textscan._powers.values()) < 1 << 16


def test_tables_grow_with_the_texts(monkeypatch):
    texts = ["", "a b", "c" * 500 + " a", "d " * 40_000, "a b", "e" * (textscan.BLOCK_BYTES + 5)]

    def hashes():
        return [textscan.words(b).hash.tolist() for t in texts for b in textscan.blocks(pa.array([t]))]

    monkeypatch.setattr(textscan, "_powers", {})
    grown = hashes()
    textscan.powers("up", textscan._STEP, textscan.BLOCK_BYTES + 1)
    textscan.powers("down", textscan._INVERSE, textscan.BLOCK_BYTES + 1)
    assert hashes() == grown and grown[1] == grown[4]
