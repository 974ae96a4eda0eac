"""Tables that grow with the documents are not gathered on the driver, however small Spark takes them for."""

import random

import pytest

from pagetables.llm import common, decontaminate, near


@pytest.fixture
def plans(monkeypatch):
    """The plan of each table that an operator writes on its way."""
    seen = []

    def noted(df, *args):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, *args)

    written = common.written
    for module in (common, near, decontaminate):
        monkeypatch.setattr(module, "written", noted)
    return seen


def _docs(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 200)}" for _ in range(60)) for _ in range(6)]
    rows = [(i, f"{texts[i % 6]} n{i}") for i in range(60)] + [(60, texts[0]), (61, texts[0]), (62, None), (None, "one two")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_duplicates_broadcast_nothing(spark, plans):
    docs = _docs(spark)
    for df in (near.join(docs), near.one_each(docs)):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not [p for p in plans if "BroadcastExchange" in p]
    assert sorted(r.class_id for r in near.join(docs).filter("doc_id < 62").collect()) == sorted([0, 1, 2, 3, 4, 5] * 10 + [0, 0])


def test_seeds_of_documents_are_not_broadcast(spark, plans):
    docs = _docs(spark)
    item = spark.createDataFrame([(1, docs.filter("doc_id = 61").first().text)], "item_id long, text string")
    found = {r.doc_id for r in decontaminate.leaks(docs, item).collect()}
    assert found == {*range(0, 60, 6), 60, 61}
    tiling = plans[-1]  # the seeds are read with their places, and joined with the pairs by text and seed
    assert "at#" in tiling and "SortMergeJoin [doc#" in tiling
