"""Headline queries, timed warm; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2).
Every query computes its whole result; the rows go to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docloom.plans.catalog import QUERIES  # noqa: E402
from docloom.session import build_session  # noqa: E402

HEADLINE = (
    "flagship_members_by_kind",
    "c01_visible_members",
    "d02_resolve_aliases",
    "d06_resolve_names",
    "d13_ancestor_closure",
    "d14_param_docs",
    "g24_signature_text",
    "g06_tags",
    "g10_summary",
    "g11_body_blocks",
    "g13_doctests",
    "g15_bullet_lists",
    "g21_html_to_text",
    "g26_member_rows",
    "g28_enrich",
    "f07_pairs",
    "f09_interleave",
    "f10_first_seen",
    "a01_read_docset",
    "a09_extract_objects",
    "a11_tiered_lookup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        f"local[{cpus}]", "docloom-bench", spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({
        "metric": "total of median warm times",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
