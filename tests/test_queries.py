"""A few registered queries against their SQL twins; checks.py runs all of them."""

import duckdb
import pytest

from checks import compare
from ringsift.queries import ORACLES, QUERIES
from ringsift.queries.bindings import BASE

FOLDER = "/root/testdata/sf0.001"
SOME = ["sc01_normalize", "src10_blocklist_text", "prj01_canonical_by_value", "jn01_numbering_lookup", "ag01_reputation", "ag02_prefix_risk",
        "wn06_stratified_split", "ag20_auc_one_vs_rest", "dec01_weak_labels", "sc55_categories", "set06_replace_and_update"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def test_every_twin_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200


@pytest.mark.parametrize("name", SOME)
def test_twin(spark, con, name):
    ok, note, _ = compare(spark, con, name, FOLDER)
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["prefix", "risk", "seen_count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
