"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up the JVM on its plan and once for the clock, written to a no-op sink
so that every output column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lendframe import queries  # noqa: E402
from lendframe.session import local_session  # noqa: E402

HEADLINE = [
    "agg_1_monthly_status", "agg_2_bureau", "agg_3_previous", "agg_5_installments", "agg_6_pos",
    "agg_7_credit_card", "agg_8_feature_table", "spl_1_make_splits", "ev_1_auc_gini", "ev_7_evaluate",
    "ev_8_bootstrap_auc", "dec_3_profit_sweep", "dec_9_alpha_sweep", "fa_1_audit", "fa_5_group_thresholds",
    "mon_2_psi_table", "dq_7_line_quantiles", "dq_9_spearman", "enc_8_woe_transform", "ex_7_what_if_features",
    "jn_9_nearest_neighbours", "md_13_newton_logistic", "ev_12_out_of_fold", "md_17_ridge",
]


def seconds(run, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "lendframe-bench")
    queries.load_all()
    times = {}
    for name in HEADLINE:
        seconds(queries.QUERIES[name], spark, sf_dir)
        times[name] = round(seconds(queries.QUERIES[name], spark, sf_dir), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
