"""Wall time of the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the data and the cores.
"""

from __future__ import annotations

import json
import os
import time

from waybill.plans.catalog import queries
from waybill.session import build_session

HEADLINE = [
    "live_changes", "log_order_facts", "route_dims", "dim_latest", "order_detail", "cancel", "sort", "trip_finish", "lookup_fk_first", "org_city",
    "bound_org_sort_day", "cargo_type_order_day", "org_order_day", "bound_finish_day", "dispatch_day",
    "org_deliver_suc_day", "org_receive_day", "org_truck_model_day", "cumulative_snapshots", "order_amount_by_day",
    "sort_count_by_province_by_day",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("waybill-bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    named = queries()
    # Starts the JVM's compilers and opens the tables; not part of the measure.
    named["order_detail"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        named[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({
        "metric": "waybill headline queries, wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
