"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: folder with the tables, BENCH_CPUS: local cores.
Every query runs to completion into the noop sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pagetables.plans import QUERIES  # noqa: E402
from pagetables.session import session  # noqa: E402

HEADLINE = [
    "read_pages", "page_links", "page_title", "page_text", "discover_catalog_urls", "first_price", "cap_per_site",
    "merge_by_key", "first_per_key", "sheet_cells", "page_nodes", "page_listings", "page_detail", "variant_rollup",
    "normalize_feed_product", "paginate_numbered", "effective_plan", "free_quota", "job_latest", "account_state",
    "normalize_store_product", "normalize_embedded_hit", "site_catalog", "free_plan_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", os.environ.get("BENCH_CPUS", "8"))
    # the tables are one file each here: cut them so that all cores read
    spark.conf.set("spark.sql.files.minPartitionNum", str(2 * spark.sparkContext.defaultParallelism))
    spark.conf.set("spark.sql.files.openCostInBytes", "65536")
    for name in ("read_pages", "page_nodes"):  # warm up the JVM and the Python workers
        QUERIES[name](spark, folder).limit(100).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
