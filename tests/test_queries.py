"""Every core query against its SQL over whole tables."""

from __future__ import annotations

import pytest

from harness import DATA, compare
from strandloom.plans import all_catalogs

PAIRS = [(n, c.queries[n], c.oracle[n]) for c in all_catalogs() for n in c.oracle]
BARE = [(n, q) for c in all_catalogs() for n, q in c.queries.items() if n not in c.oracle]


@pytest.mark.parametrize("name,query,sql", PAIRS, ids=[p[0] for p in PAIRS])
def test_against_sql(spark, name, query, sql):
    assert compare(spark, query, sql) > 0, "an empty result proves nothing"


@pytest.mark.parametrize("name,query", BARE, ids=[p[0] for p in BARE])
def test_runs(spark, name, query):
    assert query(spark, DATA).count() > 0 or query(spark, DATA.replace("0.001", "0.01")).count() > 0
