"""Planned reads of a database, strict columns, sorted and bucketed ledgers. No database is started."""

import random
import re

import pytest
from conftest import dicts, when
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.operators import reposting, stock
from tillbook.sources import jdbc, layout, tables
from tillbook.sources.ledgers import DayLedger


@pytest.mark.parametrize("seed", range(5))
def test_conditions_hold_every_row_once(spark, seed):
    draw = random.Random(seed)
    ids = sorted({draw.randrange(10**draw.randrange(1, 7)) for _ in range(300)})
    after = draw.choice([None, ids[40], ids[-1] + 5])
    parts = draw.choice([1, 4, 16])
    wanted = [i for i in ids if after is None or i > after]
    size = -(-len(wanted) // parts) or 1
    cut = [wanted[n : n + size] for n in range(0, len(wanted), size)]
    tiles = [(n, part[0], part[-1]) for n, part in enumerate(cut, 1)]
    plan = jdbc.plan_of(tiles, "id", after)
    later = [ids[-1] + 1, ids[-1] + 100]
    df = spark.createDataFrame([(i,) for i in [*ids, *later]] + [(None,)], "id bigint")
    counts = [df.filter(c).count() for c in plan.conditions()]
    assert sum(counts) == len(wanted) + (after is None)
    assert not counts or max(counts) <= size + 1
    if wanted:
        # What came since is read by the next plan, and nothing twice.
        following = jdbc.plan_of([(1, later[0], later[-1])], "id", plan.upto)
        assert sum(df.filter(c).count() for c in following.conditions()) == len(later)


def test_a_plan_without_rows_reads_nothing_after_the_mark(spark):
    df = spark.createDataFrame([(1,), (9,), (None,)], "id bigint")
    assert [df.filter(c).count() for c in jdbc.plan_of([], "id", 9).conditions()] == [0]
    assert [df.filter(c).count() for c in jdbc.Plan("id").conditions()] == [3]


def test_the_database_is_asked_for_declared_columns_in_parts(spark, monkeypatch):
    calls = []

    def fake(self, url, table, properties=None, predicates=None, **more):
        calls.append((url, table, properties, predicates))
        if "ntile" in table:
            return spark.createDataFrame([(2, 50, 99, 5), (1, 1, 40, 5)], "tile int, low bigint, high bigint, n bigint")
        names = re.findall("`([^`]+)`", table)
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))

    monkeypatch.setattr(DataFrameReader, "jdbc", fake)
    plan = jdbc.planned(spark, "jdbc:x", {"user": "u"}, "tbl_expenses", "expenseID", 2, after=0)
    assert plan == jdbc.Plan("expenseID", (50,), 0, 99)
    assert "where expenseID > 0" in calls[0][1] and "ntile(2)" in calls[0][1]
    t = jdbc.from_planned_jdbc(spark, "jdbc:x", {"user": "u"}, {"expenses": plan}, absent={"users": ["fullName"]})
    assert t.expenses.columns == tables.columns_of("expenses")
    url, table, _, predicates = calls[-1]
    assert predicates == ["expenseID > 0 and expenseID < 50", "expenseID >= 50 and expenseID <= 99"]
    assert table.startswith("(select `expenseID`") and "`priceExpense$`" in table and "tbl_expenses" in table
    assert t.users.columns == ["userID", "userName", "fullName"] and "fullName" not in calls[-1][1]
    assert calls[-1][3] is None


def test_absent_columns_are_named(spark):
    df = spark.createDataFrame([(1, "x")], "userID int, userName string")
    with pytest.raises(ValueError, match="users lacks fullName"):
        tables.conformed(df, "users", absent=())
    assert dicts(tables.conformed(df, "users", absent=["fullName"])) == [
        {"userID": 1, "userName": "x", "fullName": None}
    ]
    dollars = spark.createDataFrame([], "`priceExpense$` int, typeExpenseID int")
    with pytest.raises(ValueError, match="expenses lacks expenseID, shelfID, priceExpenseIQD, dollarPrice"):
        tables.conformed(dollars, "expenses", absent=())


def moves(count):
    return [
        {
            "sourceID": n, "sourceType": "s" if n % 3 else "p", "itemID": n * 7 % 50, "qty": -1 if n % 3 else 4,
            "itemPrice": 2, "costPrice": 1, "createAt": when(f"2024-01-{n % 3 + 1:02d}"),
        }
        for n in range(count)
    ]


def footer_of(spark, path):
    jvm = spark._jvm
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = [s.getPath() for s in place.getFileSystem(settings).listStatus(place) if s.getPath().getName().endswith("parquet")]
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(files[0], settings)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        columns = reader.getFooter().getBlocks().get(0).getColumns()
        return {str(columns.get(n).getPath().toDotString()): columns.get(n).getBloomFilterOffset() for n in range(columns.size())}
    finally:
        reader.close()


def test_days_are_sorted(spark, shop, tmp_path):
    t = shop(stock=moves(300))
    ledger = DayLedger(
        spark, str(tmp_path / "ledger"), t.stock.schema, sorted_by=["itemID", "sourceID"], filters=["itemID", "sourceID"]
    )
    ledger.write(t.stock)

    def check_day(day):
        folder = f"{tmp_path}/ledger/day={day}"
        rows = [(r["itemID"], r["sourceID"]) for r in spark.read.parquet(folder).coalesce(1).collect()]
        assert rows == sorted(rows)

    check_day("2024-01-02")
    some = ledger.of([when("2024-01-03").date()]).drop("day")
    ledger.replace([when("2024-01-03").date()], some.withColumn("qty", F.col("qty") * 2))
    check_day("2024-01-03")
    assert ledger.read().filter("itemID = 7").count() == 6


def test_columns_too_varied_for_a_dictionary_carry_filters(spark, shop, tmp_path):
    few = shop(stock=moves(1)).stock
    many = spark.range(200_000).select(F.expr("id * 7919 % 1000003 sourceID")).crossJoin(few.drop("sourceID"))
    ledger = DayLedger(spark, str(tmp_path / "ledger"), few.schema, filters=["sourceID", "itemID"])
    ledger.write(many.select(few.columns).coalesce(1))
    offsets = footer_of(spark, f"{tmp_path}/ledger/day=2024-01-01")
    # A dictionary answers for a column with few values, so Parquet writes no filter for it.
    assert offsets["sourceID"] > 0 and offsets["itemID"] <= 0 and offsets["qty"] <= 0


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"\bExchange hashpartitioning", line)]


def test_bucketed_tables_join_without_a_shuffle(spark, shop, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = [
            {"itemID": n, "itemCode": f"c{n}", "itemName": f"n{n}", "deleteStatus": "1", "hideInStock": "1", "perUnit": 1, "stockAlert": 2, "costPrice": 1, "itemPriceRetail": 2}
            for n in range(60)
        ]
        t = shop(items=items, stock=moves(400))
        bucketed = layout.with_buckets(spark, t, str(tmp_path / "buckets"), 4)
        summed = bucketed.stock.groupBy("itemID").agg(F.sum("qty").alias("qty"))
        assert exchanges(summed) == []
        assert exchanges(bucketed.items.join(summed, "itemID", "left")) == []
        plain, cut = stock.in_stock_detail(t), stock.in_stock_detail(bucketed)
        assert len(exchanges(cut)) < len(exchanges(plain))
        assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))

        # The exchange of changed documents, ledger and changes in buckets of the document.
        layout.store_in_buckets(t.stock, "by_source", str(tmp_path / "by_source"), "sourceID", 4)
        kind = reposting.Kind("disposals", "disposalID", None, "stock", ())
        changed = spark.createDataFrame([(n,) for n in range(0, 400, 5)], "disposalID bigint")
        layout.store_in_buckets(changed, "changed_ids", str(tmp_path / "changed"), "disposalID", 4)
        kept = reposting.rows_of(spark.table("by_source"), kind, spark.table("changed_ids"), "left_anti")
        assert exchanges(kept) == []
        assert kept.count() == 320
        assert exchanges(reposting.rows_of(t.stock, kind, changed, "left_anti")) != []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("bucketed_items", "bucketed_stock", "by_source", "changed_ids"):
            spark.sql(f"drop table if exists {name}")


def test_declared_tables_have_their_columns():
    assert set(tables.columns_of("stock")) == {p.split()[0] for p in S.TABLES["stock"].replace("\n", " ").replace("(18,4)", "").split(",")}
