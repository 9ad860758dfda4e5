"""Our one-pass forms against the same reports asked query by query, over stored tables."""

import json
import os
import statistics
import tempfile
import time

import bench
from tillbook.operators import sales, stock
from tillbook.session import ready
from tillbook.sources import retail
from tillbook.sources.tables import from_parquet, write_tables

FIRST, LAST, DAY = "1995-01-01", "2024-12-31", "1998-06-15"
SPAN = f"where date(createAt) between '{FIRST}' and '{LAST}'"
MONEY = [
    f"select sum(totalPrice) from invoices {SPAN} and stockType = 's'",
    f"select sum(totalPrice) from purchases {SPAN} and stockType = 'p'",
    f"select sum(amountReturn - discount) from return_debt_customer {SPAN}",
    f"select sum(amountReturn - discount) from return_debt {SPAN}",
    f"select sum(discount) from invoices {SPAN}",
    f"select sum(discount) from purchases {SPAN}",
    f"select sum(try_divide(priceExpenseIQD, dollarPrice)) + sum(priceExpenseUSD) from expenses {SPAN}",
    f"select sum(totalPrice) from invoices {SPAN} and stockType = 'rs'",
    f"select sum(totalPrice) from purchases {SPAN} and stockType = 'rp'",
    f"select -sum(qty * (itemPrice - costPrice)) from stock {SPAN} and sourceType in ('s', 'rs')",
]
WEEK = [
    f"select sum(qty * {price}) from stock where sourceType = '{kind}'"
    f" and date(createAt) = date_sub(date '{DAY}', {ago})"
    for ago in range(7)
    for kind, price in (("s", "itemPrice"), ("p", "costPrice"))
]
IN_STOCK = [
    """select i.itemID, i.itemCode, i.itemName, i.unitID, i.shelfID, i.brandID, i.categoryID, sum(s.qty),
    sum(case when sourceType = 'p' then s.qty end), sum(case when sourceType = 'rp' then s.qty end),
    sum(case when sourceType = 's' then s.qty end), sum(case when sourceType = 'rs' then s.qty end),
    sum(case when sourceType = 'd' then s.qty end), u.unitName
    from items i left join stock s on s.itemID = i.itemID left join units u on u.unitID = i.unitID
    where deleteStatus = '1' and hideInStock = '1' group by all"""
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = ready(bench.session(os.environ.get("BENCH_CPUS", "8")))
    path = tempfile.mkdtemp(prefix="tillbook-forms-")
    write_tables(retail.load(spark, folder), path)
    t = from_parquet(spark, path)
    for name in ("invoices", "purchases", "stock", "items", "units", "expenses", "return_debt",
                 "return_debt_customer"):
        getattr(t, name).createOrReplaceTempView(name)

    def ask(texts):
        return lambda: [spark.sql(text).write.format("noop").mode("overwrite").save() for text in texts]

    def run(df):
        return lambda: df().write.format("noop").mode("overwrite").save()

    forms = {
        "money_movement": (run(lambda: sales.money_movement(t, FIRST, LAST)), ask(MONEY)),
        "daily_sale_purchase": (run(lambda: sales.daily_sale_purchase(t, DAY)), ask(WEEK)),
        "in_stock": (run(lambda: stock.in_stock(t)), ask(IN_STOCK)),
    }
    seconds = {}
    for name, (ours, asked) in forms.items():
        for label, form in (("one pass", ours), ("query by query", asked)):
            form()
            form()
            runs = []
            for _ in range(3):
                started = time.perf_counter()
                form()
                runs.append(time.perf_counter() - started)
            seconds[f"{name}: {label}"] = round(statistics.median(runs), 3)
    print(json.dumps(seconds))


if __name__ == "__main__":
    main()
