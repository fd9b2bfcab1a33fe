"""Every training-data query against its SQL, over whole tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from harness import DATA, compare  # noqa: E402

from strandloom.llm.queries import CATALOG  # noqa: E402


@pytest.mark.parametrize("name", sorted(CATALOG.oracle))
def test_against_sql(spark, name):
    compare(spark, CATALOG.queries[name], CATALOG.oracle[name])


@pytest.mark.parametrize("name", sorted(set(CATALOG.queries) - set(CATALOG.oracle)))
def test_runs(spark, name):
    assert CATALOG.queries[name](spark, DATA).count() > 0 or CATALOG.queries[name](spark, DATA.replace("0.001", "0.01")).count() > 0
