"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the median seconds of warm runs."""

import json
import os
import statistics
import time

from quarry import registry
from quarry.session import build_session

HEADLINE = ["typed_path_3hop", "typed_path_2hop", "relation_sequences", "anchor_probe", "run_programs", "concept_closure", "all_schema_edges", "alg_qfilter_num", "aggregate_metrics", "nearest_l2", "ranked_subgraph_match"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    every = registry.queries()
    took: dict[str, float] = {}
    for name in HEADLINE:
        seconds = []
        for _ in range(runs):
            began = time.time()
            every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.time() - began)
        took[name] = round(statistics.median(seconds[1:] or seconds), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
