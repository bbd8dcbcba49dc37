"""Every query of the reference's operators against its SQL."""

import pytest

import __spark_entry__ as entry
from ragloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE[name])


def test_every_query_of_the_core_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_entry_gives_one_row_per_query(spark, duck):
    """Queries are the rows whose id is divisible by 100; entry reads the smallest tables."""
    want = duck.sql("SELECT count(*) FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE vec_id % 100 = 0").fetchall()[0][0]
    assert entry.entry(spark).count() == want > 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
