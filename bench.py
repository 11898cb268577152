"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tessera.plans import registry
from tessera.session import session

HEADLINE = (
    "crossing_imports", "claim_coverage", "module_owners", "snapshot_drift", "keyed_diff", "module_moves", "import_rules", "flow_states", "mis_folds", "entry_groups",
    "cycle_imports", "walk_depths", "change_reach", "gap_samples", "growth_windows", "score_auc", "threshold_curve", "grouping_f1", "verdict_states", "answered_lines",
    "change_bursts", "box_overlaps", "free_bands", "call_records", "text_digests",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    run = registry.queries()
    run["facts_summary"](spark, sf_dir).collect()  # starts the JVM's compilers and the file cache
    took = {}
    for name in HEADLINE:
        began = time.time()
        run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
