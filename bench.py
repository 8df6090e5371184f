"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revtally.session import build_session  # noqa: E402
from workload import catalog  # noqa: E402

HEADLINE = (
    "language_totals",
    "lines_by_day",
    "lines_by_iso_week",
    "lines_by_month",
    "by_repo",
    "by_author_bucket",
    "month_language",
    "totals",
    "tree_repo_month",
    "tree_repo_author",
    "tree_languages",
    "effective_levels",
    "person_totals",
    "person_language",
    "author_report",
    "window_filter",
    "exclude_languages",
    "involves_person",
    "me_login",
    "coauthors_from_message",
    "path_language",
    "identity_join",
    "weekly_buckets",
    "apportion_languages",
    "remote_by_period",
    "remote_repo_languages",
    "merge_windows",
    "history_refresh",
    "multi_window_languages",
    "bucket_report",
    "stats_document",
    "commit_log_text",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["summary_sums"](spark, sf_dir).collect()  # start the session and its threads
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
