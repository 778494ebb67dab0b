"""Times the headline queries: one warm-up, then the median of BENCH_RUNS runs (1 unless set), written to a no-op sink.

Prints one JSON line. Settings: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS, BENCH_QUERIES (comma-separated, or `all`).
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "perf_by_model_task", "score_answers", "leaderboard_pivot", "difficulty_curve", "usage_overview", "invalid_json_report", "cumulative_mean",
    "merge_runs", "canonical_prefix", "resume_worklist", "upsert_results", "extract_numbers", "replace_numbers", "tokenize_corpus", "number_bits",
    "difficulty_add", "difficulty_minmax", "gen_addition", "gen_division", "gen_mean", "stratified_subset", "exact_sample", "dedupe_problems",
    "prompts_interval", "pack_contexts", "mix_sources", "curriculum_mix", "recent_performance", "length_batches", "token_accounting",
]


def main() -> None:
    from tallyforge.plans import QUERIES
    from tallyforge.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = get_session("bench", cpus=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds, headline queries, warm median", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name, "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
