"""Driver contract: entry runs; queries and oracle SQL agree on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

from .conftest import SF_SMALL

ROWS_ONLY = {"pca_variance", "payload_json"}
FAST = ["score", "league_map", "shortlist", "diff_keyed", "combine", "concept_index", "validation",
        "verify_season", "catalogue_resolve", "assign_role", "latest_per_key", "value_concentration",
        "compare_keyed", "compare_positional", "diff_summary", "cell_tolerance", "corr_matrix", "spearman_no_age",
        "spearman_within_league", "retention_blocks", "price_vs_league_median"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "perf_league" in df.columns


def test_every_query_has_oracle_or_is_rows_only():
    assert set(E.QUERIES) - set(E.ORACLE) == ROWS_ONLY
    assert set(E.QUERIES) <= set(E.queries()) and set(E.ORACLE) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(dcols, cur.fetchall())
