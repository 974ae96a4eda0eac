"""Derived pages are filtered by many tasks and made once; pages are routed without a join; details are not broadcast."""

from pyspark.sql import functions as F

from pagetables.operators import bundle as B
from pagetables.operators import details
from pagetables.plans import fixtures as FX

STATE = 'window[Symbol.for("InstantSearchInitialResults")] = {"a":{"results":[{"hits":[{"id":1}]}]}}'


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _parts(spark, folder, n=6_000):
    spark.range(n).selectExpr(
        "id AS p_partkey", "IF(id = 7, NULL, 'n') AS p_name", "'Brand#1' AS p_brand", "'T' AS p_type", "CAST(id % 50 AS INT) AS p_size", "1.5D AS p_retailprice",
    ).coalesce(1).write.parquet(f"{folder}/part.parquet")


def test_filters_of_derived_pages_stay_behind_the_exchange(spark, tmp_path):
    _parts(spark, tmp_path)
    pages = FX.card_pages(spark, str(tmp_path))
    chosen = pages.filter(F.col("html").contains("Menu") & ~F.col("html").contains("none of it") & (F.col("page_id") >= 0))
    plan = _plan(chosen)
    assert plan.index("Contains") < plan.index("Repartition") and "Contains" not in plan[plan.index("Repartition"):]
    assert plan.count("<article class") == plan[plan.index("Generate"):].count("<article class") > 0  # made below the filter only
    assert chosen.count() == 5_999 and pages.count() == 6_000 and pages.filter("html IS NULL").count() == 1


def test_pages_are_routed_without_a_join(spark):
    rows = [
        (1, "http://h/1", f"<script>{STATE}</script>"), (1, "http://h/1", f"<script>{STATE}</script>"), (2, "http://h/2", "<p>x"),
        (3, "http://h/3", f'<script src="https://cdn.shopify.com/x"></script><script>{STATE}</script>'), (4, "http://h/4", None),
        (5, "http://h/5", "InstantSearchInitialResults"), (None, "http://h/6", "<p>x"), (7, None, f"<script>{STATE}</script>"),
    ]
    bundle = B.Bundle(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    for platform, ids in (("embedded_search", [1, 1]), ("generic", [2, 3, 4, 5])):
        got = bundle._pages_of(platform)
        assert "Join" not in _plan(got) and got.columns == ["page_id", "url", "html"]
        assert sorted(r.page_id for r in got.collect()) == ids


def test_details_are_not_broadcast(spark, tmp_path):
    _parts(spark, tmp_path, 60)
    pages = FX.jsonld_pages(spark, str(tmp_path))
    found = pages.selectExpr("page_id", "url AS page_url", "url", "1 AS idx", "'' AS title")
    rich = details.enrich_details(found, details.page_detail(pages))
    assert "Broadcast" not in rich._jdf.queryExecution().executedPlan().toString()
    assert rich.filter("detail_status = 'OK'").count() == 60
