import os

import corpus_pipeline
import pytest

from tidelake.llm import base, catalog

DATA = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages_keep_columns_and_work_on_what_is_left(spark):
    docs = base.documents(spark, DATA)
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = base.materialise(stage(spark, docs, DATA), "stage")
        assert docs.columns == columns
        if name != "source mixing":
            assert 0 < docs.count() <= before
            before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == docs.count() and "ids_sha256" in out.columns
