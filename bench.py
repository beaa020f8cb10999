"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to completion through the ``noop`` sink, so every row and column is computed and
nothing is collected. A small run first starts the JVM's workers and warms the file cache.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docaudit.queries import load  # noqa: E402
from docaudit.session import local_session  # noqa: E402

HEADLINE = (
    "rul14_validate_documents",
    "ext01_extract_regex",
    "ext06_extract_labels",
    "ext07_extract_emails",
    "ext09_extract_measurement_lines",
    "blk01_infer_sections",
    "map03_classify_fields",
    "map10_resolve",
    "map14_anchor_evidence",
    "grp01_rows_list",
    "grp05_rows_table",
    "rul04_cross_field_rules",
    "rul05_rule_column",
    "run05_apply_lifecycle",
    "run07_apply_corrections",
    "coh04_aggregate_outcomes",
    "coh06_evaluate_cohorts",
    "spc02_version_timeline",
    "src03_duplicate_uploads",
    "qa05_stage_summary",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, memory="16g")
    queries, _ = load()
    wanted = sys.argv[1:] or HEADLINE
    for name in ("orders", "lineitem", "documents"):
        run(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        run(queries[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    out = {
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
