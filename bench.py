"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = (
    "detection_summary_by_anatomy",
    "detection_summary_by_size_bin",
    "anatomy_against_lesion_by_model",
    "angle_distance_summary_by_label",
    "lesion_summary_by_label",
    "overlap_by_size_bin_and_label",
    "last_numbers_of_document",
    "vqa_answers",
    "rolling_token_windows",
    "response_cache",
    "sorted_batches",
    "limited_split",
    "bootstrap_of_f1_by_cells",
    "bootstrap_of_perplexity",
    "corpus_bleu",
    "random_box_baseline",
    "k_center_subset",
    "logs_read_from_files",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from scorelake.plans import all_queries
    from scorelake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="scorelake-bench-")
    spark = local_session(cores, int(cores), spark__checkpoint__dir=f"file://{shared}")
    known = all_queries()[0]
    chosen = sys.argv[1:] or HEADLINE
    if chosen == ["all"]:
        chosen = list(known)
    # Starts the JVM, code generation and the Parquet reader, so that the first query is not charged for them.
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in chosen:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
