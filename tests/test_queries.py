"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from lexiarc import queries as core


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, compare, name):
    got = core.QUERIES[name](spark, sf_dir)
    if name in core.ORACLE_SQL:
        compare(got.toPandas(), duck.sql(core.ORACLE_SQL[name]).df())
    else:
        got.collect()


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as entry

    assert set(entry.entry(spark).columns) == {"document_id", "term", "n", "frequency", "rank"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
