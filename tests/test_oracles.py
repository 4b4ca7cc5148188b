"""Every registered query against its SQL twin on the smallest data.

PANELKIT_SF chooses another folder.  At sf0.001 the panel has ten series, where
the signed-rank p is exact; the SQL twins state the large-sample form, so those
few are compared only at larger scale.
"""

from __future__ import annotations

import os

import oracle
import pytest

from panelkit import registry

SF = os.environ.get("PANELKIT_SF", "/root/testdata/sf0.001")
SMALL = SF.endswith("sf0.001")
LARGE_SAMPLE = {"g11_signed_rank", "g21_lead_tests", "g14_pearson", "g18_tost", "g25_foresight_configs"}
QUERIES, ORACLES = registry.all_queries(), registry.all_oracles()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    if SMALL and name in LARGE_SAMPLE:
        pytest.skip("the SQL twin holds for n > 50")
    diff = oracle.compare(QUERIES[name](spark, SF), ORACLES[name], con)
    assert diff is None, diff


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
