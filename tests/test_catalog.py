"""Every query of the library against its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import pytest

from tests import compare
from tessera.plans.catalog import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(DIR).exists():
        pytest.skip("no test data")
    return compare.duck(DIR)


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_same_rows(spark, con, key):
    assert compare.differs(spark, con, DIR, key, QUERIES[key], ORACLE_SQL[key]) == ""


def test_upsert_adds_a_taken_id(spark, tmp_path):
    """D1 on over a million parts, of which one has the new row's id; repeated and null keys."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    keys = [None, 0, 1, 7, 7, 14, 693, 700, 999_999, 1_000_000]
    pq.write_table(pa.table({"p_partkey": pa.array(keys, pa.int64()), "p_size": pa.array([1] * len(keys), pa.int64())}), tmp_path / "part.parquet")
    assert compare.differs(spark, compare.duck(tmp_path), tmp_path, "D1", QUERIES["D1"], ORACLE_SQL["D1"]) == ""


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, key):
    assert QUERIES[key](spark, DIR).columns


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 12 and rows[0]["matched"] >= rows[-1]["matched"]


def test_names_match():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
