"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_REPEAT (runs per query,
the median counts), BENCH_QUERIES (comma-separated names, or ``all``).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from millrace import golden
from millrace.session import build_session

HEADLINE = [
    "pipeline_flagship",
    "sql_transform",
    "group_by_single",
    "group_by_multi",
    "handle_nulls_any",
    "deduplicate",
    "qualify_latest",
    "filter_compare",
    "accumulate_upsert",
    "xml_envelope_roundtrip",
    "xml_multi_dataset_join",
    "json_business_errors",
    "chained_enrichment",
    "sql_inner_join",
    "sql_aggregate",
    "sql_topk",
    "sql_median",
    "sql_rank",
    "sql_frames",
    "asof_join",
    "sql_range_join",
    "python_group_transform",
    "text_normalize",
    "stream_accumulate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    known = golden.queries()
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(known) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE

    spark = build_session(
        "millrace-bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "golden_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
