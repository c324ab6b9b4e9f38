import pytest
from compare import assert_same

from mentionlake.plans import catalogue, collecting, monitoring, publishing  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_oracle(spark, duck, sf, name):
    assert_same(catalogue.QUERIES[name](spark, sf), duck.sql(catalogue.ORACLES[name]))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_title_similarity_is_bounded(spark, sf):
    rows = catalogue.QUERIES["title_similarity"](spark, sf).collect()
    assert all(0 <= r.similarity <= 1 and r.doc_id > r.first_id for r in rows)
