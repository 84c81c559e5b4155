"""The queries of the subpackage on the smallest tables: against their SQL where there is one."""

import pytest

from seqloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.SQL[name])


COLUMNS = {
    "p1_found": ["source", "seq_id"],
    "p2_found": ["rec_id", "aa_start", "aa_end"],
    "p3_found": ["row_id", "group_id"],
    "p4_found": ["entry_id", "cluster_id"],
    "p5_found": ["entry_a", "entry_b"],
    "p7_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id", "subject"],
}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(name, spark, data):
    df = queries.QUERIES[name](spark, data)
    assert df.count() > 0
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
