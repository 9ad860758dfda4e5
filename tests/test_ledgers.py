"""Invariants over the test data, storage, streams and plans."""

import datetime as dt
import io
from contextlib import redirect_stdout
from decimal import Decimal as D

import pytest
from conftest import dicts, frame, when
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.operators import posting, sales
from tillbook.operators import stock as stock_ops
from tillbook.sources import retail, tables
from tillbook.streaming import streams

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return retail.load(spark, FOLDER)


def test_posting_the_documents_gives_the_stock_ledger(t):
    posted, ledger = posting.stock_ledger(t), t.stock
    assert posted.exceptAll(ledger).count() == 0
    assert ledger.exceptAll(posted).count() == 0


def test_stock_totals_agree(t):
    total = t.stock.agg(F.sum("qty")).first()[0]
    assert stock_ops.money_in_stock(t).agg(F.sum("totalInStock")).first()[0] == total
    row = dicts(stock_ops.stock_movement(t, "1990-01-01", "2030-01-01"))[0]
    assert row["inToStock"] - row["outFromStock"] - row["disposal"] == total


def test_profit_splits_into_sales_and_disposals(t):
    span = ("1990-01-01", "2030-01-01")
    row = dicts(sales.profit_totals(t, *span))[0]
    assert row["totalAll"] == dicts(sales.money_movement(t, *span))[0]["totalProfit"] + row["totalDisposal"]
    by_source = sales.profit_by_source(t, *span).agg(F.sum("totalProfit"), F.sum("totalLoss")).first()
    assert by_source[0] == row["totalAll"] and by_source[1] == row["totalLoss"]


def test_shop_tables_have_the_declared_columns(t):
    for name in S.TABLES:
        declared = t.users.sparkSession.createDataFrame([], S.TABLES[name]).schema
        built = getattr(t, name)
        assert set(built.columns) == {f.name for f in declared}, name
        for field in declared:
            assert built.schema[field.name].dataType == field.dataType, (name, field.name)


def test_tables_survive_storage(spark, t, tmp_path):
    folder = str(tmp_path)
    tables.write_tables(t, folder)
    stored = tables.from_parquet(spark, folder)
    assert dicts(sales.profit_totals(stored, "1990-01-01", "2030-01-01")) == dicts(
        sales.profit_totals(t, "1990-01-01", "2030-01-01")
    )
    assert stock_ops.in_stock(stored).exceptAll(stock_ops.in_stock(t)).count() == 0


def test_ledger_by_day_prunes_partitions(spark, t, tmp_path):
    path = str(tmp_path / "stock")
    tables.write_ledger(t.stock, path)
    back = tables.read_ledger(spark, path)
    assert back.count() == t.stock.count()
    one_day = back.filter(F.col("day") == dt.date(1998, 6, 10))
    assert one_day.count() == t.stock.filter(F.to_date("createAt") == "1998-06-10").count()
    assert "PartitionFilters: [isnotnull(day" in explained(one_day)


def test_busy_day_is_split(spark, tmp_path):
    path = str(tmp_path / "busy")
    day = "case when id % 3 = 0 then timestamp_ntz '2020-01-01' else timestamp_ntz '2020-01-02' + make_dt_interval(cast(id % 50 as int)) end"
    rows = spark.range(60_000).selectExpr("id", "hex(id * id) filler", f"{day} createAt")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100kb")
    try:
        tables.write_ledger(rows, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = spark.read.parquet(path).select("day", F.input_file_name().alias("f")).distinct()
    per_day = {r["day"]: r["count"] for r in dicts(files.groupBy("day").count())}
    assert per_day[dt.date(2020, 1, 1)] > 1
    assert tables.read_ledger(spark, path).count() == 60_000


def test_stored_columns_are_conformed(spark):
    df = spark.createDataFrame(
        [(1, 2, 3.5, 4, "secret")],
        "expenseID int, priceExpenseIQD int, `priceExpense$` double, dollarPrice int, password string",
    )
    row = dicts(tables.conformed(df, "expenses"))[0]
    assert row["priceExpenseUSD"] == D("3.5") and row["priceExpenseIQD"] == 2
    assert "password" not in row and row["createAt"] is None


def test_unknown_table_is_named(t):
    with pytest.raises(AttributeError, match="nothing"):
        t.nothing


def explained(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_filters_and_columns_reach_the_scan(t):
    plan = explained(sales.invoice_day_totals(t, "1998-06-15"))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "o_custkey" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_top_lists_do_not_sort_everything(t):
    assert "TakeOrderedAndProject" in explained(sales.top_categories(t))


def test_no_plan_pairs_all_rows(spark, t):
    from tillbook.plans import registry

    for name, query in registry.QUERIES.items():
        plan = query.build(t)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


LINE = (
    "event_id bigint, ts timestamp, sourceID bigint, sourceType string, itemID bigint, qty int,"
    " itemPrice decimal(18,4), costPrice decimal(18,4)"
)


def line(event, day, kind, item, qty, price=1):
    return (event, when(day), event, kind, item, qty, D(price), D(1))


def stream_of(spark, folder, batches):
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{folder}/in/b={number}")
    return spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/b=*")


def test_event_delivered_twice_posts_once(spark, tmp_path):
    one = line(1, "2020-01-01", "s", 5, 3)
    source = stream_of(spark, tmp_path, [[one, line(2, "2020-01-01", "p", 5, 9)], [one]])
    rows = dicts(streams.append_to_files(streams.stream_post_stock(source), spark))
    assert sorted((r["event_id"], r["qty"]) for r in rows) == [(1, -3), (2, 9)]


def test_state_follows_later_batches(spark, tmp_path):
    source = stream_of(
        spark,
        tmp_path,
        [
            [line(1, "2020-01-01", "p", 5, 9), line(2, "2020-01-01", "p", 6, 2)],
            [line(3, "2020-01-01", "s", 5, 8), line(4, "2020-01-02", "p", 6, 20)],
        ],
    )
    on_hand = streams.keep_latest(streams.stream_on_hand(streams.stream_post_stock(source)), ["itemID"], spark)
    assert {r["itemID"]: r["totalInStock"] for r in dicts(on_hand)} == {5: 1, 6: 22}
    items = frame(
        spark, "items", [{"itemID": n, "deleteStatus": "1", "stockAlert": 5, "itemName": "x"} for n in (5, 6)]
    )
    assert [r["itemID"] for r in dicts(streams.low_stock(on_hand, items))] == [5]


def test_daily_sales_take_late_rows_within_the_delay(spark, tmp_path):
    source = stream_of(
        spark,
        tmp_path,
        [
            [line(1, "2020-01-05", "s", 1, 1, 4)],
            [line(2, "2020-01-03", "s", 1, 1, 5), line(3, "2020-01-20", "s", 1, 1, 6)],
            [line(5, "2020-01-20", "s", 1, 1, 1)],
            [line(4, "2020-01-04", "s", 1, 1, 7)],
        ],
    )
    rows = dicts(streams.keep_latest(streams.stream_daily_sales(source), ["day", "sourceType"], spark))
    # The last row comes after its day was closed by the row of the 20th.
    assert {r["day"].day: r["total"] for r in rows} == {5: 4, 3: 5, 20: 7}


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    def drained(folder, latest):
        source = spark.readStream.schema(LINE).parquet(f"{tmp_path}/{folder}/b=*")
        posted = streams.stream_post_stock(source)
        places = (f"{tmp_path}/state-{latest}", f"{tmp_path}/rows-{latest}")
        if latest:
            return dicts(streams.keep_latest(streams.stream_on_hand(posted), ["itemID"], spark, *places))
        return dicts(streams.append_to_files(posted, spark, *places))

    def arrive(number, rows):
        spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{tmp_path}/go/b={number}")

    arrive(0, [line(1, "2020-01-01", "p", 5, 9)])
    assert [r["qty"] for r in drained("go", False)] == [9]
    assert [r["totalInStock"] for r in drained("go", True)] == [9]
    arrive(1, [line(1, "2020-01-01", "p", 5, 9), line(2, "2020-01-01", "s", 5, 4)])
    assert sorted(r["qty"] for r in drained("go", False)) == [-4, 9]
    assert [r["totalInStock"] for r in drained("go", True)] == [5]


def test_a_stream_without_input_has_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    posted = streams.stream_post_stock(spark.readStream.schema(LINE).parquet(f"{tmp_path}/in"))
    assert dicts(streams.keep_latest(streams.stream_on_hand(posted), ["itemID"], spark)) == []
    assert dicts(streams.append_to_files(posted, spark)) == []


def test_low_stock_counts_opening_stock_and_items_never_moved(spark):
    items = frame(
        spark, "items", [{"itemID": n, "deleteStatus": "1", "stockAlert": 5, "itemName": "x"} for n in (1, 2, 3)]
    )
    on_hand = spark.createDataFrame([(1, -4), (2, -4)], "itemID bigint, totalInStock bigint")
    opening = spark.createDataFrame([(1, 20), (2, 6)], "itemID bigint, qty int")
    rows = dicts(streams.low_stock(on_hand, items, opening))
    assert sorted((r["itemID"], r["totalInStock"]) for r in rows) == [(2, 2), (3, 0)]


def test_reports_leave_other_days_of_a_stored_ledger_unread(spark, t, tmp_path):
    from tillbook.operators import parties

    for name in ("stock", "transactions"):
        rows = getattr(t, name).filter(F.col("createAt").between("1998-01-01", "1998-02-01"))
        tables.write_ledger(rows, f"{tmp_path}/{name}")
    stored = t.replaced(
        **{
            name: (lambda _, name=name: tables.read_ledger(spark, f"{tmp_path}/{name}"))
            for name in ("stock", "transactions")
        }
    )
    first, last = "1998-01-05", "1998-01-20"
    for report in (
        lambda t: sales.profit_by_source(t, first, last),
        lambda t: sales.profit_by_item(t, first, last),
        lambda t: sales.sale_purchase_by_day(t, last),
        lambda t: stock_ops.stock_movement(t, first, last),
        lambda t: parties.account_statement(t, first, last, "c"),
        lambda t: parties.partner_statement(t, first, last),
    ):
        df = report(stored)
        shown = io.StringIO()
        with redirect_stdout(shown):
            df.explain("formatted")
        assert "PartitionFilters: [isnotnull(day" in shown.getvalue()
        assert sorted(map(repr, df.collect())) == sorted(map(repr, report(t).collect()))
