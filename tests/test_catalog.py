"""Every registered query against its oracle on the smallest tables."""

import duckdb
import pytest

from ballast import catalog
from check_oracles import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, key):
    verdict, _ = compare(spark, duck, FOLDER, key)
    assert verdict.startswith(("ok", "rows-only")), verdict
    assert "TYPES" not in verdict


def test_driver_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == [
        "workspace", "source_file", "line", "specifier", "brotli_bytes", "confidence",
    ]
