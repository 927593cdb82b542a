"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; the median counts.  All
rows are computed and thrown away (noop sink).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from annolake.session import local_session
from annolake.workload.queries import QUERIES

HEADLINE = (
    "missing_variables", "parse_config", "findings_similar", "dashboard", "clean_documents",
    "normalized_quotes", "standard_colors", "text_boxes", "aligned_boxes", "export_aligned_rows",
    "library_totals", "standard_bookmarks", "position_matches", "xfdf_color_update",
    "settings_problems",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", cpus, int(cpus), os.environ.get("BENCH_MEMORY", "16g"))
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    annotations = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "headline queries, total of medians", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
        "annotations": annotations,
        "checked_annotations_per_sec": round(annotations / seconds["findings_similar"]),
        "exported_annotations_per_sec": round(annotations / seconds["export_aligned_rows"])}))


if __name__ == "__main__":
    main()
