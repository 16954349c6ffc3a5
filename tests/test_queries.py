from __future__ import annotations

import pytest

from oracle import check

from lamina import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    check(Q.QUERIES[name], Q.SQL[name], spark, sf_dir)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_without_sql_has_rows_and_repeats_itself(spark, sf_dir, name):
    first = sorted(map(str, Q.QUERIES[name](spark, sf_dir).collect()))
    assert first
    if name.startswith("variant"):
        assert first == sorted(map(str, Q.QUERIES[name](spark, sf_dir).collect()))
