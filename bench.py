"""Times the headline queries and prints one JSON line.

Each query reads the test tables in ``BENCH_SF_DIR``. All are run once to warm up
and then three times each; the median counts. Results go to a sink that drops them, so all
rows are computed and none are fetched.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from tillbook.plans import registry

HEADLINE = (
    "money_movement profit_by_source profit_totals top_categories daily_sale_purchase "
    "invoice_register sales_by_owner items_sold_by_customer sold_items_total invoice_documents "
    "invoice_neighbours profit_by_item in_stock lack_in_stock in_stock_detail item_catalog "
    "item_resolve purchase_register purchase_documents customer_debt_list customer_netting "
    "partner_statement account_statement_suppliers post_sales_stock post_purchase_stock "
    "allocate_repayments apply_line_events merge_invoice_lines repost_changed price_calendar"
).split()
RUNS = 3


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tillbook-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(build) -> float:
    started = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    queries = registry.queries()
    seconds = {}
    for name in names:
        timed(lambda: queries[name](spark, folder))
    for name in names:
        runs = [timed(lambda: queries[name](spark, folder)) for _ in range(RUNS)]
        seconds[name] = round(statistics.median(runs), 4)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "retail_ledger_total_sec",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
