"""Queries with SQL, against it."""

from __future__ import annotations

import pytest

from oracle import check

from lamina.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    check(Q.queries()[name], Q.oracle_sql()[name], spark, sf_dir)
