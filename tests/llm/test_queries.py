import pytest

from lexspark.llm import queries as Q
from tests.compare import agree, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, data, con, name):
    agree(Q.QUERIES[name](spark, data), con, Q.SQL[name])


@pytest.mark.parametrize(("name", "columns"), [
    ("p2_found", {"id_a": "bigint", "id_b": "bigint"}), ("p3_found", {"id": "bigint", "unbroken": "bigint"}), ("p4_found", {"conversation_id": "string"}),
    ("p6_found", {"doc_id": "bigint"}), ("p7_found", {"doc_id": "bigint", "item_id": "bigint"}), ("p8_found", {"doc_id": "bigint", "reading_level": "bigint"}),
])
def test_columns_and_no_repetition(spark, data, name, columns):
    df = Q.QUERIES[name](spark, data)
    assert dict(df.dtypes) == columns
    got = df.collect()
    assert got and len(got) == len(set(got))
