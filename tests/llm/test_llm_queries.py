import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
import oracle  # noqa: E402

from argentic.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf, name):
    assert oracle.spark_rows(QUERIES[name](spark, sf)) == oracle.sql_rows(sf, ORACLES[name])


def test_pipeline_stages(spark, sf):
    import corpus_pipeline
    from argentic.llm import decontamination, simhash
    from argentic.llm._common import Scratch, load

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near", "leaks", "mix", "shards"]
    docs, scratch = load(spark, sf, "documents"), Scratch(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf))
        if name != "shards":
            assert docs.columns == columns
        if name == "near":
            assert simhash.similar_groups(docs).groupBy("root").count().filter("count > 1").count() == 0
        if name == "leaks":
            assert decontamination.find_items(docs, load(spark, sf, "benchmark")).count() == 0
        if name == "shards":
            assert docs.count() == before.count() and docs.filter("shard not between 0 and 15").count() == 0
