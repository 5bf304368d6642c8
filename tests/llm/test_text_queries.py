"""Every query of the subpackage runs on the smallest tables with the columns that it is to have."""

import pytest

from attestra.llm.queries import LLM

COLUMNS = {"p1_found": ["paperid", "bib_id"], "p5_found": ["row_id", "field"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(LLM.queries))
def test_runs(spark, small, name):
    result = LLM.queries[name](spark, small)
    # Two hundred documents teach too little to find one.
    assert result.count() > 0 or name == "p9_found"
    assert result.columns == COLUMNS.get(name, result.columns)
    if name.endswith("_found"):
        assert result.distinct().count() == result.count()
