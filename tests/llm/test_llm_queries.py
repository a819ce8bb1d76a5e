import pytest

from assayer.llm import queries
from tests.same import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(name, spark, folder):
    assert_same(queries.queries()[name](spark, folder), connect(folder), queries.oracle_sql()[name])


COLUMNS = {
    "p1_found": "ref_id bigint, field_name string, canon_id int", "p2_found": "model_short string, app_category string", "p3_found": "expert_comment_id string, pair_id string",
    "p4_found": "group_id string, field_name string, comment_id string", "p5_found": "item_id string, label string", "p6_found": "record_id_a bigint, record_id_b bigint",
    "p9_found": "doc_id bigint, item_id bigint", "p10_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_columns_and_single_rows(name, spark, folder):
    df = queries.queries()[name](spark, folder)
    if name in COLUMNS:
        assert ", ".join(f"{c} {k}" for c, k in df.dtypes) == COLUMNS[name]
        assert df.count() == df.distinct().count()
    else:
        df.collect()
