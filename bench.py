"""Times headline queries; prints one JSON line.

Each query runs twice and the faster run counts: the published numbers to
compare with are of warm processes.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all), and
optionally BENCH_QUERIES, a comma-separated list or "all".
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from moodmill.catalog import runnable  # noqa: E402
from moodmill.session import local_session  # noqa: E402

HEADLINE = (
    "score_all_documents",
    "sentiment_by_platform",
    "topic_rollup",
    "sentiment_by_aspect",
    "analyze_topic",
    "mine_aspects_top2",
    "training_set",
    "training_set_capped",
    "prep_stats",
    "dedupe_content",
    "revoke_all",
    "length_order_batches",
    "gate_metrics",
    "topic_daily",
    "topic_trend",
    "strip_html",
)

RUNS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), memory="16g")
    queries = runnable()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)

    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
