import os

import __spark_entry__
import pytest

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_flagship(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns[0] == "entity" and out.count() == 25
