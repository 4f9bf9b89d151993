"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

QUERIES = [
    "flagship_canonical_health",
    "agg01_vector_statistics",
    "agg04_merge_weighted_average",
    "agg13_grouped_mae_14",
    "agg14_open_loop_summary",
    "agg19_embedding_health",
    "fn13_normalise_q99",
    "jn03_promote_segments",
    "jn04_asof_nearest",
    "jn05_asof_backward",
    "jn06_feature_window",
    "prj03_bimanual_frames",
    "smp02_weighted_draws",
    "smp05_draw_steps",
    "smp07_task_batches",
    "snk01_idempotent_frames",
    "src02_one_episode",
    "str01_refresh_batch",
    "win01_finite_difference",
    "win04_offsets_first_last",
    "win08_pose_deltas",
    "win09_integrate_deltas",
    "win10_trailing_mean_padded",
    "win14_stale_snapshot",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from epispark.plans import REGISTRY
    from epispark.session import local_session

    spark = local_session(cpus, "bench")
    names = [n for n in QUERIES if not sys.argv[1:] or any(a in n for a in sys.argv[1:])]
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].build(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if sys.argv[1:]:
            print(name, times[name], file=sys.stderr, flush=True)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf.rstrip("/")),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
