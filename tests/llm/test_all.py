"""Every query of the subpackage over the smallest tables."""

from __future__ import annotations

import pytest

from folioforge import llm

COLUMNS = {
    "p1_found": ["item_id"],
    "p2_found": ["block_id", "defect"],
    "p3_found": ["entry_a", "entry_b"],
    "p4_found": ["item_a", "item_b"],
    "p6_found": ["rec_table", "rec_key"],
    "p7_ids": ["doc_id", "ids"],
    "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(spark, data, name):
    df = llm.queries()[name](spark, data)
    rows = df.collect()
    assert rows or name == "p1_found"  # the smallest tables hold a dozen labels, hardly any of 5 or 6
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name.endswith("_found"):
        assert len(set(map(tuple, rows))) == len(rows)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_twin(spark, data, duck, name):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parents[1]))
    from same import same

    same(llm.queries()[name](spark, data), duck, llm.oracle_sql()[name])


def test_query_names():
    assert {q.split("_")[0] for q in llm.queries()} == {f"p{n}" for n in range(1, 10)}
    assert set(llm.oracle_sql()) <= set(llm.queries())
