"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["factor_ic_summary", "ts_moving_stats", "cs_rank", "cs_neutralize", "seed_factors", "batch_ic_summary", "quantile_returns", "library_correlations",
            "neutralized_ic", "top_fraction_return", "walk_forward_ridge", "marginal_ic", "asof_carry_limit", "attach_industry", "align_statements",
            "consensus_features", "red_flag_levels", "tracking_error", "trade_replay", "book_nav"]


def main() -> None:
    from tidepanel.catalog import load, registry
    from tidepanel.session import local_session

    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    load()
    only = os.environ.get("BENCH_ONLY")
    names = only.split(",") if only else HEADLINE
    # One untimed pass over the shared panel warms the JVM, as a resident process would be.
    registry.run("ts_moving_stats", spark, path).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        registry.run(name, spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(path).removeprefix("sf")}))


main()
