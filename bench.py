"""Headline queries, timed. Prints one JSON line.

Reads the tables at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Every query runs
whole, into Spark's noop sink, once to warm up and then $BENCH_RUNS times (default 1); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from gleanmill.plans.registry import all_queries
from gleanmill.session import build_session

HEADLINE = [
    "evaluate_reports", "evaluate_reports_with_verdicts", "curate", "dedupe_results", "number_citations", "merge_by_score",
    "parse_references", "annotate_links", "resolve_links", "extract_articles", "split_blocks", "chunk_fixed", "chunk_sentences",
    "index_documents", "topk_inner_product", "assemble_messages", "assemble_tool_calls", "research_sessions", "compress_context",
    "read_event_log", "smart_title", "json_repair", "parse_plans",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
