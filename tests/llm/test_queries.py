import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_found_queries_have_their_columns(spark):
    from tendrel.llm.queries import queries

    want = {"p1_found": ["tab", "rec_id", "term"], "p2_found": ["tab", "rec_id", "markup"], "p3_found": ["draft_id", "defect"], "p4_found": ["tab", "rec_id"], "p5_found": ["chunk_ix"], "p6_found": ["chunk_a", "chunk_b"], "p9_found": ["doc_id"]}
    made = queries()
    for name, columns in want.items():
        df = made[name](spark, DATA)
        assert df.columns == columns, name
        rows = df.collect()
        assert rows and len(rows) == len(set(rows)), name
    assert {n.split("_")[0] for n in made} == {f"p{i}" for i in range(1, 10)}
