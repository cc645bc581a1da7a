"""Wall time of every registered query at one scale factor; prints one JSON line.

`store_build` is the time to derive, enrich and write the result table that the serving,
evaluation and drift queries read. `end_to_end` is the flagship plan from raw documents to the
hourly rollup without that table.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from tickerloom.operators.rollups import hourly_rollup
from tickerloom.plans import views
from tickerloom.plans.registry import all_queries
from tickerloom.session import build_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = set(sys.argv[1:])
    spark = build_session(cpus, "tickerloom-bench")

    start = time.perf_counter()
    views.table(spark, sf_dir, "documents").count()
    warm_up = time.perf_counter() - start

    def drain(frame) -> None:
        frame.write.format("noop").mode("overwrite").save()

    def run(job) -> float:
        begun = time.perf_counter()
        job()
        return round(time.perf_counter() - begun, 3)

    timed = {
        "end_to_end": run(lambda: drain(hourly_rollup(views.enrich(views.articles(spark, sf_dir))))),
        "store_build": run(lambda: views.stored_path(spark, sf_dir)),
    }
    for name, query in all_queries().items():
        if not wanted or name in wanted:
            timed[name] = run(lambda q=query: drain(q(spark, sf_dir)))
    articles = views.table(spark, sf_dir, "documents").count()
    scale = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": float(scale.group(1)) if scale else None,
                "articles": articles,
                "articles_per_sec_end_to_end": round(articles / timed["end_to_end"], 1),
                "warm_up": round(warm_up, 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
