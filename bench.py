"""Time queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

BENCH_QUERIES picks keys by name, or "all"; the default is the headline set below.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from partner_analytics.catalog import load  # noqa: E402
from partner_analytics.session import build_session  # noqa: E402

HEADLINE = """
rpt_order_kpis rpt_reorder_rate rpt_complaint_rate rpt_product_content rpt_marketing_attrs rpt_final_metrics
rpt_scorecard rpt_scorecard_weekly rpt_ops_meta rpt_ops_scores rpt_achievable_opportunities rpt_opportunity_queue
rpt_newsletter rpt_city_benchmark rpt_top_dishes rpt_delay_attribution rpt_backend_audit rpt_stock_consumption
rpt_stock_decision rpt_deal_uplift rpt_vendor_ramp agg_count_distinct_filter agg_week_pivot join_left_composite
join_cohort_events win_latest_per_key win_nth_event win_rank_global win_running_count win_top_n budget_cut
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    entries = load()
    wanted = os.environ.get("BENCH_QUERIES", "")
    keys = list(entries) if wanted == "all" else wanted.split() or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # warm up
    seconds = {}
    for key in keys:
        start = time.perf_counter()
        entries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
