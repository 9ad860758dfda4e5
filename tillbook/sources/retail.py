"""A shop made from the order-and-part test tables.

The shop's documents are plain projections of the given tables. The stock ledger
is read off the line items in one pass; posting the documents one by one gives
the same rows, which the tests verify.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.functions.files import Files
from tillbook.operators import posting
from tillbook.sources.tables import Tables

RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,
        p_retailprice double""",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_quantity double, l_extendedprice double, l_discount double, l_tax double,
        l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz""",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,
        props string""",
}

COST = f"cast(cast(p_retailprice as decimal(12,2)) * cast(0.95 as decimal(4,2)) as {S.MONEY})"
PRICE = (
    "cast(cast(p_retailprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))"
    f" as {S.MONEY})"
)
VALUE = f"cast(cast(value as decimal(12,2)) as {S.MONEY})"
IS_SALE = "l_returnflag in ('N', 'R')"
IS_DISPOSAL = "l_returnflag = 'A' and l_linestatus = 'O' and l_tax < 0.015"
IS_PURCHASE = "l_returnflag = 'A' and not (l_linestatus = 'O' and l_tax < 0.015)"
STOCK_TYPE = "case when o_orderpriority = '5-LOW' then 'rs' else 's' end"
PURCHASE_TYPE = "case when l_suppkey % 10 = 0 then 'rp' else 'p' end"
EXPIRY = "case when l_partkey % 7 = 0 then date_add(date '2000-01-01', p_size) end"


def size(spark: SparkSession, folder: str) -> int:
    """Bytes of the Parquet files that ``load`` reads."""
    files = Files(spark)
    return sum(files.size(f"{folder}/{name}.parquet") for name in RAW)


def load(spark: SparkSession, folder: str) -> Tables:
    """All shop tables over the Parquet files of a folder."""

    read: dict[str, DataFrame] = {}

    def raw(name: str) -> DataFrame:
        if name not in read:
            read[name] = spark.read.schema(RAW[name]).parquet(f"{folder}/{name}.parquet")
        return read[name]

    def rows(text: str) -> DataFrame:
        return spark.sql(f"select * from values {text}")

    def events(kind: str) -> DataFrame:
        return raw("events").filter(F.col("event_type") == kind)

    def users(_):
        return raw("nation").selectExpr(
            "cast(n_nationkey as bigint) userID", "n_name userName", "n_name fullName"
        )

    def shelfs(_):
        return raw("region").selectExpr("cast(r_regionkey + 1 as bigint) shelfID", "r_name shelfName")

    def categories(_):
        return rows(
            "(1L, 'ECONOMY'), (2L, 'LARGE'), (3L, 'MEDIUM'), (4L, 'PROMO'), (5L, 'SMALL'),"
            " (6L, 'STANDARD') as t(categoryID, categoryName)"
        )

    def brands(_):
        return (
            raw("part")
            .selectExpr("cast(substr(p_brand, 7) as bigint) brandID", "p_brand brandName")
            .distinct()
        )

    def units(_):
        return rows("(1L, 'piece'), (2L, 'box'), (3L, 'kg'), (4L, 'pack') as t(unitID, unitName)")

    def type_expense(_):
        return rows(
            "(1L, 'rent'), (2L, 'power'), (3L, 'wages'), (4L, 'other') as t(typeExpenseID, typeName)"
        )

    def items(_):
        return raw("part").selectExpr(
            "p_partkey itemID",
            "concat('P', p_partkey) itemCode",
            "concat(p_name, ' ', p_partkey) itemName",
            """case when p_partkey % 19 = 0 then null
                    when p_type = 'ECONOMY' then 1L when p_type = 'LARGE' then 2L
                    when p_type = 'MEDIUM' then 3L when p_type = 'PROMO' then 4L
                    when p_type = 'SMALL' then 5L when p_type = 'STANDARD' then 6L end categoryID""",
            """case when p_partkey % 17 = 0 then null
                    else cast(substr(p_brand, 7) as bigint) end brandID""",
            "p_partkey % 5 + 1 shelfID",
            "p_partkey % 4 + 1 unitID",
            "p_size perUnit",
            f"{COST} costPrice",
            f"cast(cast(p_retailprice as decimal(12,2)) as {S.MONEY}) itemPriceRetail",
            "cast(cast(p_retailprice as decimal(12,2)) * cast(0.9 as decimal(4,2))"
            f" as {S.MONEY}) itemPriceWhole",
            "p_size * 4 stockAlert",
            "case when p_partkey % 20 = 1 then '0' else '1' end hideInStock",
            "case when p_partkey % 10 = 3 then '1' else '0' end showButton",
            "cast(null as string) note",
            "case when p_partkey % 50 = 0 then '0' else '1' end deleteStatus",
            "p_partkey % 25 userIDCreated",
        )

    def customers(_):
        return raw("customer").selectExpr(
            "c_custkey + 1 customerID",
            "concat('Party', right(c_name, 9)) customerName",
            "concat('07', c_custkey) phoneNumber",
            "c_mktsegment address",
            f"cast(greatest(cast(c_acctbal as decimal(12,2)), 0) as {S.MONEY}) previousDebt",
            f"cast(0 as {S.MONEY}) limitDebt",
            "'0' wholePrice",
            "case when c_custkey % 25 = 0 then '1' else '0' end doesSupplier",
            "case when c_custkey % 10 = 9 then '0' else '1' end activeStatus",
            "cast(c_nationkey as bigint) userID",
            "timestamp_ntz '1995-01-01 00:00:00' createAt",
        )

    def suppliers(_):
        return raw("supplier").selectExpr(
            "s_suppkey + 1 supplierID",
            "concat('Party', right(s_name, 9)) supplierName",
            "concat('08', s_suppkey) phone",
            "cast(null as string) address",
            f"cast(greatest(cast(s_acctbal as decimal(12,2)), 0) as {S.MONEY}) previousBalance",
            "case when s_suppkey % 10 = 9 then '0' else '1' end activeStatus",
            "cast(s_nationkey as bigint) userID",
            "timestamp_ntz '1995-01-01 00:00:00' createAt",
        )

    def invoices(_):
        total = "cast(o_totalprice as decimal(12,2))"
        return raw("orders").selectExpr(
            "o_orderkey invoiceID",
            "o_custkey + 1 customerID",
            "o_orderkey % 25 userID",
            f"cast({total} as {S.MONEY}) totalPrice",
            f"""cast(case when o_orderstatus = 'F' then {total}
                     when o_orderstatus = 'P' and o_orderkey % 11 = 0
                       then {total} * cast(1.1 as decimal(4,2))
                     when o_orderstatus = 'P' then {total} * cast(0.5 as decimal(4,2))
                     else 0 end as {S.MONEY}) initialPay""",
            f"cast(0 as {S.MONEY}) totalPay",
            f"cast(case when o_orderkey % 6 = 0 then 50000 else 0 end as {S.IQD}) totalPayIQD",
            f"cast({total} * cast(0.01 as decimal(4,2)) as {S.MONEY}) discount",
            f"cast(1000 as {S.RATE}) dollarPrice",
            f"{STOCK_TYPE} stockType",
            "case when o_orderstatus = 'O' then '0' else '1' end sellStatus",
            "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'd' else 'c' end invoiceType",
            "cast(null as bigint) rdcID",
            "case when o_orderstatus = 'F' then '1' else '0' end wasl",
            "(o_orderkey + 7) % 25 userIDUpdate",
            "o_orderdate createAt",
        )

    def invoice_item(_):
        lines = (
            raw("lineitem")
            .filter(IS_SALE)
            .groupBy("l_orderkey", "l_partkey")
            .agg(
                F.sum(F.col("l_quantity").cast("int")).cast("int").alias("qty"),
                F.min("l_discount").alias("l_discount"),
            )
        )
        return lines.join(raw("part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(
            "l_orderkey * 1000000 + l_partkey invdID",
            "l_orderkey invoiceID",
            "l_partkey itemID",
            "qty",
            f"{PRICE} productPrice",
            f"{COST} costPrice",
            "l_partkey % 5 + 1 shelfID",
            "l_partkey % 4 + 1 unitID",
            f"{EXPIRY} expiryDate",
        )

    # Orders are joined before lines are grouped: a filter on the day then thins out
    # the lines first, and the join's partitioning by order serves the grouping too.

    def disposals(_):
        lines = (
            raw("lineitem")
            .filter(IS_DISPOSAL)
            .join(raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("l_orderkey", "l_partkey", "o_orderdate")
            .agg(F.sum(F.col("l_quantity").cast("int")).cast("int").alias("qty"))
        )
        return lines.join(raw("part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(
            "l_orderkey * 1000000 + l_partkey disposalID",
            "l_partkey itemID",
            f"{COST} costPrice",
            "qty",
            "cast(null as date) expiryDate",
            "case when l_partkey % 3 = 0 then l_partkey % 25 else l_orderkey % 25 end userID",
            "o_orderdate createAt",
        )

    def purchase_items(_):
        lines = (
            raw("lineitem")
            .filter(IS_PURCHASE)
            .groupBy("l_orderkey", "l_suppkey", "l_partkey")
            .agg(F.sum(F.col("l_quantity").cast("int")).cast("int").alias("qty"))
        )
        return lines.join(raw("part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(
            "(l_orderkey * 100000 + l_suppkey) * 1000000 + l_partkey pItemID",
            "l_orderkey * 100000 + l_suppkey purchaseID",
            "l_partkey itemID",
            f"{COST} costPrice",
            "qty",
            f"cast(0 as {S.MONEY}) discount",
            f"{COST} costAfterDisc",
        )

    def purchases(_):
        totals = (
            raw("lineitem")
            .filter(IS_PURCHASE)
            .join(raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("l_orderkey", "l_suppkey", "o_orderdate")
            .agg(F.expr(f"cast(sum(cast(l_quantity as int) * {COST}) as {S.MONEY})").alias("totalPrice"))
            .withColumn("purchaseID", F.expr("l_orderkey * 100000 + l_suppkey"))
        )
        return totals.selectExpr(
            "purchaseID",
            "l_suppkey + 1 supplierID",
            "concat('REF', purchaseID % 1000) referenceNo",
            f"cast(case when purchaseID % 7 = 0 then 0 else 1000 end as {S.RATE}) dollarPrice",
            "totalPrice",
            f"""cast(case when l_suppkey % 3 = 0 then totalPrice
                     when l_suppkey % 3 = 1 then totalPrice / 2 else 0 end as {S.MONEY}) amountPay""",
            f"cast(case when purchaseID % 5 = 0 then 250000 else 0 end as {S.IQD}) amountPayIQD",
            f"cast(0 as {S.MONEY}) discount",
            "case when l_orderkey % 2 = 0 then 'received' else 'pending' end PurchaseStatus",
            "case when l_suppkey % 3 = 0 then 'c' else 'd' end paymentType",
            "'0' debtStatus",
            f"{PURCHASE_TYPE} stockType",
            "cast(null as string) note",
            "l_orderkey % 25 userIDCreated",
            "(l_orderkey + 7) % 25 userIDUpdate",
            "o_orderdate createAt",
        )

    def stock(_):
        # One key tells the kind of line: -1 a sale, -2 a disposal, else the supplier's id.
        moved = (
            raw("lineitem")
            .filter("l_returnflag in ('N', 'R', 'A')")
            .selectExpr(
                "l_orderkey",
                "l_partkey",
                f"case when {IS_SALE} then -1L when {IS_DISPOSAL} then -2L else l_suppkey end kind",
                "cast(l_quantity as int) qty",
                "l_discount",
            )
            .join(
                raw("orders").selectExpr(
                    "o_orderkey",
                    "o_orderdate",
                    "o_orderstatus = 'O' is_open",
                    "o_orderpriority = '5-LOW' is_return",
                ),
                F.col("l_orderkey") == F.col("o_orderkey"),
            )
            .filter("not (kind = -1 and is_open)")
            .groupBy("l_orderkey", "l_partkey", "kind", "is_return", "o_orderdate")
            .agg(F.sum("qty").cast("int").alias("qty"), F.min("l_discount").alias("l_discount"))
            .withColumn(
                "sourceType",
                F.expr(
                    """case when kind = -1 and is_return then 'rs' when kind = -1 then 's'
                            when kind = -2 then 'd' when kind % 10 = 0 then 'rp' else 'p' end"""
                ),
            )
        )
        return moved.join(raw("part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(
            """case when kind = -1 then l_orderkey
                    when kind = -2 then l_orderkey * 1000000 + l_partkey
                    else l_orderkey * 100000 + kind end sourceID""",
            "sourceType",
            "l_partkey itemID",
            "case when sourceType in ('rs', 'p') then qty else -qty end qty",
            f"case when kind = -1 then {PRICE} else cast(0 as {S.MONEY}) end itemPrice",
            f"{COST} costPrice",
            f"case when sourceType = 'rs' then {EXPIRY} end expiryDate",
            "o_orderdate createAt",
        )

    def return_debt_customer(_):
        return events("purchase").selectExpr(
            "event_id rdcID",
            "user_id + 2 customerID",
            "event_id % 5 + 1 shelfID",
            f"cast({VALUE} * 500 as {S.MONEY}) amountReturn",
            f"cast(0 as {S.IQD}) amountReturnIQD",
            f"cast(case when event_id % 4 = 0 then {VALUE} * 10 else 0 end as {S.MONEY}) discount",
            f"cast(1000 as {S.RATE}) dollarPrice",
            """case when event_id % 6 = 0 then null
                    else concat(user_id, ',', user_id + 1) end invoiceNumbers""",
            "user_id % 25 userID",
            "ts createAt",
        )

    def return_debt(_):
        return events("signup").selectExpr(
            "event_id rdID",
            "user_id % 10 + 1 supplierID",
            "event_id % 5 + 1 shelfID",
            f"{VALUE} amountReturn",
            f"cast(0 as {S.IQD}) amountReturnIQD",
            "cast(null as string) referenceNO",
            f"cast(case when event_id % 4 = 0 then {VALUE} / 10 else 0 end as {S.MONEY}) discount",
            f"cast(1000 as {S.RATE}) dollarPrice",
            """case when event_id % 3 <> 0 then null else array_join(transform(sequence(0, 19),
                    k -> cast(event_id * 100000 + k as string)), ',') end purchaseNumbers""",
            "user_id % 25 userID",
            "ts createAt",
        )

    def expenses(_):
        return events("error").selectExpr(
            "event_id expenseID",
            "event_id % 4 + 1 typeExpenseID",
            "event_id % 5 + 1 shelfID",
            f"cast(case when event_id % 2 = 0 then {VALUE} * 1000 else 0 end as {S.IQD})"
            " priceExpenseIQD",
            f"cast(case when event_id % 2 = 1 then {VALUE} else 0 end as {S.MONEY}) priceExpenseUSD",
            f"""cast(case when event_id % 7 = 0 then 0 when event_id % 2 = 0 then 1250
                     else 1000 end as {S.RATE}) dollarPrice""",
            "case when event_id % 3 = 0 then concat('note ', event_id) end note",
            "user_id % 25 userIDCreated",
            "ts createAt",
        )

    def cash_entries(_):
        return events("click").selectExpr(
            "event_id btID",
            "event_id % 5 + 1 shelfID",
            "event_id sourceID",
            f"cast(case when event_id % 3 = 2 then -{VALUE} else {VALUE} end as {S.MONEY}) amount",
            f"cast({VALUE} * 1000 as {S.IQD}) amountIQD",
            """case when event_id % 3 = 0 then 'in' when event_id % 3 = 1 then 'out'
                    else 'ex' end type""",
            "cast(null as string) note",
            "user_id % 25 userID",
            "ts createAt",
        )

    def dollar(_):
        """The current rate; other rows are none."""
        return raw("region").selectExpr(
            "cast(r_regionkey as bigint) dollarId", f"cast(1100 + r_regionkey * 50 as {S.RATE}) dollarPrice"
        )

    def money_box(_):
        return events("view").selectExpr(
            "event_id mbID",
            "event_id % 5 + 1 shelfID",
            "(event_id + 1 + user_id % 4) % 5 + 1 shelfID2",
            f"{VALUE} amount",
            "user_id % 25 userID",
            "ts createAt",
        )

    def discounts(_):
        # Two overlapping discounts for each promoted part.
        price = f"cast(cast(p_retailprice as decimal(12,2)) as {S.MONEY})"
        rate = "(case when k = 0 then cast(0.1 as decimal(4,2)) else cast(0.2 as decimal(4,2)) end)"
        start = "date_add(date '1997-01-01', p_size + 15 * k)"
        return (
            raw("part")
            .filter("p_type = 'PROMO'")
            .withColumn("k", F.expr("explode(array(0, 1))"))
            .selectExpr(
                "p_partkey * 2 + k dID",
                "p_partkey itemID",
                f"{price} itemPriceRetail",
                f"cast({price} * {rate} as {S.MONEY}) discount",
                f"cast({price} * (1 - {rate}) as {S.MONEY}) priceAfterDiscount",
                f"date_sub({start}, 5) createDate",
                f"{start} startDate",
                f"date_add({start}, 30) endDate",
                "p_partkey % 25 userID",
            )
        )

    def add_events(_):
        return raw("lineitem").filter(IS_SALE).join(
            raw("part"), F.col("l_partkey") == F.col("p_partkey")
        ).selectExpr(
            "l_orderkey invoiceID",
            "l_partkey itemID",
            "cast(datediff(l_shipdate, date '1970-01-01') as bigint) * 1000 + l_linenumber * 2"
            " + cast(l_quantity as int) % 2 seq",
            "case when cast(l_quantity as int) % 2 = 1 then '1' else '0' end whole",
        )

    def line_events(_):
        return raw("events").selectExpr(
            "user_id invoiceID",
            "event_id % 5 itemID",
            "event_id seq",
            """case when event_type = 'signup' then 'add' when event_type = 'view' then 'inc'
                    when event_type = 'click' then 'dec'
                    when event_type = 'purchase' and event_id % 2 = 0 then 'qty'
                    when event_type = 'purchase' then 'price'
                    when event_id % 10 = 0 then 'delete' else 'cost' end kind""",
            "cast(event_id % 20 + 1 as int) qty",
            f"{VALUE} price",
            f"cast({VALUE} / 2 as {S.MONEY}) cost",
        )

    def customer_log(t: Tables):
        names = ["customerID", "seq", "op", "customerName", "phoneNumber", "address", "activeStatus"]
        created = t.customers.selectExpr(
            "customerID", "-1L seq", "'insert' op", "customerName", "phoneNumber", "address",
            "activeStatus",
        )
        changed = raw("events").selectExpr(
            "user_id + 1 customerID",
            "event_id seq",
            """case when event_type = 'click' then 'update' when event_type = 'view' then 'patch'
                    when event_type = 'purchase' then 'patch'
                    when event_type = 'signup' and event_id % 20 = 0 then 'insert'
                    when event_type = 'error' and event_id % 20 = 0 then 'delete'
                    else 'patch' end op""",
            "case when event_type in ('click', 'signup') then concat('Party', event_id) end"
            " customerName",
            "case when event_type in ('click', 'signup') then concat('07', event_id) end phoneNumber",
            "case when event_type = 'signup' then concat('road ', event_id) end address",
            """case when event_type = 'view' then '0'
                    when event_type in ('purchase', 'click', 'signup') then '1' end activeStatus""",
        )
        return created.select(*names).unionByName(changed.select(*names))

    def invoice_log(t: Tables):
        created = t.invoices.withColumn("seq", F.lit(0).cast("bigint")).withColumn(
            "op", F.lit("insert")
        )
        edited = (
            raw("orders")
            .filter("o_orderpriority = '3-MEDIUM'")
            .selectExpr(
                "o_orderkey invoiceID",
                "1L seq",
                "case when o_orderstatus = 'P' then 'delete' else 'patch' end op",
                f"cast(cast(o_totalprice as decimal(12,2)) * 2 as {S.MONEY}) totalPrice",
                f"cast(cast(o_totalprice as decimal(12,2)) as {S.MONEY}) initialPay",
                "case when o_orderkey % 2 = 0 then 'rs' end stockType",
            )
        )
        return created.unionByName(edited, allowMissingColumns=True)

    def expense_log(t: Tables):
        created = t.expenses.withColumn("seq", F.lit(0).cast("bigint")).withColumn(
            "op", F.lit("insert")
        )
        edited = (
            events("error")
            .filter("value < 10 or value > 50")
            .selectExpr(
                "event_id expenseID",
                "1L seq",
                "case when value > 50 then 'delete' else 'patch' end op",
                f"cast({VALUE} * 3 as {S.MONEY}) priceExpenseUSD",
            )
        )
        return created.unionByName(edited, allowMissingColumns=True)

    def log_of(rows, key: str, edits: list[str], patched: str = "% 4 = 1", gone: str = "% 4 = 3"):
        """All rows as inserts, then patches and deletions of some of them."""
        created = rows.withColumn("seq", F.lit(0).cast("bigint")).withColumn("op", F.lit("insert"))
        edited = rows.filter(f"{key} {patched} or {key} {gone}").selectExpr(
            key, "1L seq", f"case when {key} {gone} then 'delete' else 'patch' end op", *edits
        )
        return created.unionByName(edited, allowMissingColumns=True)

    def purchase_log(t: Tables):
        edits = [
            f"cast(totalPrice * 2 as {S.MONEY}) totalPrice", "totalPrice amountPay",
            "case when purchaseID % 8 = 1 then 'rp' end stockType",
            "case when purchaseID % 3 = 0 then createAt + interval 1 day end createAt",
        ]
        return log_of(t.purchases, "purchaseID", edits)

    def disposal_log(t: Tables):
        return log_of(
            t.disposals, "disposalID", ["qty + 1 qty", f"cast(costPrice * 2 as {S.MONEY}) costPrice"]
        )

    def repayment_log(t: Tables):
        edits = [f"cast(amountReturn * 2 as {S.MONEY}) amountReturn", f"cast(1 as {S.MONEY}) discount"]
        return log_of(t.return_debt, "rdID", edits)

    def customer_repayment_log(t: Tables):
        edits = [f"cast(amountReturn * 2 as {S.MONEY}) amountReturn", f"cast(1 as {S.MONEY}) discount"]
        return log_of(t.return_debt_customer, "rdcID", edits)

    def cash_log(t: Tables):
        edits = [f"cast(amount * 3 as {S.MONEY}) amount", "case when btID % 8 = 1 then 'in' end type"]
        return log_of(t.cash_entries, "btID", edits)

    def customer_opening_log(t: Tables):
        edits = [f"cast(previousDebt + 10 as {S.MONEY}) previousDebt"]
        return log_of(t.customers, "customerID", edits, gone="is null")

    def supplier_opening_log(t: Tables):
        edits = [f"cast(previousBalance + 10 as {S.MONEY}) previousBalance"]
        return log_of(t.suppliers, "supplierID", edits, gone="is null")

    def closings(t: Tables):
        """Closings of open invoices, some of them closed twice."""
        still = t.invoices.filter("sellStatus = '0' and invoiceID % 2 = 1").selectExpr(
            "invoiceID",
            "case when invoiceID % 10 = 1 then null else customerID end customerID",
            f"cast(totalPrice * 2 as {S.MONEY}) totalPrice",
            f"case when invoiceID % 4 = 1 then cast(totalPrice as {S.MONEY}) end initialPay",
            f"cast(invoiceID % 3 * 1000 as {S.IQD}) totalPayIQD",
            f"cast(null as {S.MONEY}) discount",
            "case when invoiceID % 6 = 1 then 'rs' end stockType",
            "case when invoiceID % 14 = 1 then null when invoiceID % 4 = 1 then 'd' else 'c' end invoiceType",
            "invoiceID % 25 userIDUpdate",
            f"case when invoiceID % 8 = 1 then cast(totalPrice * 2 as {S.MONEY}) else totalPrice end totalPay",
        )
        earlier = still.selectExpr("* except (totalPrice)", f"cast(1 as {S.MONEY}) totalPrice", "1L seq")
        return still.withColumn("seq", F.lit(2).cast("bigint")).unionByName(earlier.filter("invoiceID % 5 = 1"))

    def item_log(t: Tables):
        rows = t.items
        created = rows.withColumn("seq", F.lit(0).cast("bigint")).withColumn("op", F.lit("insert"))
        price = rows.filter("itemID % 4 = 1").selectExpr(
            "itemID", "3L seq", "'patch' op", f"cast(itemPriceRetail * 2 as {S.MONEY}) itemPriceRetail",
            f"cast(itemPriceWhole * 2 as {S.MONEY}) itemPriceWhole",
        )
        whole = rows.filter("itemID % 6 = 1").selectExpr(
            "itemID", "5L seq", "'update' op", "concat(itemName, ' new') itemName", "itemCode", "0 perUnit",
            "costPrice", "itemPriceRetail", "itemPriceWhole", "stockAlert", "shelfID",
        )
        gone = rows.filter("itemID % 9 = 1").selectExpr("itemID", "7L seq", "'delete' op", "'x' itemName")
        back = rows.filter("itemID % 18 = 1").selectExpr("itemID", "9L seq", "'patch' op", "'1' deleteStatus")
        out = created
        for more in (price, whole, gone, back):
            out = out.unionByName(more, allowMissingColumns=True)
        return out

    def early_payments(t: Tables):
        """Payments made while invoices still come in: some days after every third of them."""
        return t.invoices.filter("invoiceID % 3 = 0").selectExpr(
            "invoiceID rdcID", "customerID", f"cast(totalPrice * 0.7 as {S.MONEY}) amountReturn",
            "createAt + make_interval(0, 0, 0, 20 + invoiceID % 300) createAt",
        )

    def edits_of(lines, key: str):
        """One event for some lines, and items added to some documents afterwards."""
        kinds = ["inc", "qty", "price", "delete", "dec", "cost"]
        listed = ", ".join(f"'{k}'" for k in kinds)
        place = f"pmod({key} + itemID, 11)"
        edited = lines.filter(f"{place} < {len(kinds)}").selectExpr(
            key, "itemID", "1L seq", f"element_at(array({listed}), cast({place} as int) + 1) kind",
            "cast(9 as int) qty", f"cast(7.5 as {S.MONEY}) price", f"cast(3.25 as {S.MONEY}) cost",
        )
        added = lines.filter(f"{key} % 3 = 0").selectExpr(key).distinct().selectExpr(
            key, f"{key} % 10 + 1 itemID", "2L seq", "'add' kind", "cast(2 as int) qty",
            f"cast(11 as {S.MONEY}) price", f"cast(4 as {S.MONEY}) cost",
        )
        return edited.unionByName(added)

    def sales_edits(t: Tables):
        return edits_of(t.invoice_item, "invoiceID")

    def purchase_edits(t: Tables):
        return edits_of(t.purchase_items, "purchaseID")

    def search_terms(_):
        return raw("part").selectExpr(
            """case when p_partkey % 2 = 0 then concat('p', p_partkey)
                    else upper(concat(p_name, ' ', p_partkey)) end term""",
            "p_partkey % 3 = 0 whole",
        )

    return Tables(
        {
            "users": users,
            "shelfs": shelfs,
            "categories": categories,
            "brands": brands,
            "units": units,
            "type_expense": type_expense,
            "items": items,
            "customers": customers,
            "suppliers": suppliers,
            "invoices": invoices,
            "invoice_item": invoice_item,
            "disposals": disposals,
            "purchase_items": purchase_items,
            "purchases": purchases,
            "stock": stock,
            "return_debt_customer": return_debt_customer,
            "return_debt": return_debt,
            "expenses": expenses,
            "cash_entries": cash_entries,
            "box_transaction": posting.post_cash,
            "dollar": dollar,
            "money_box": money_box,
            "discounts": discounts,
            "transactions": posting.party_ledger,
            "add_events": add_events,
            "line_events": line_events,
            "customer_log": customer_log,
            "invoice_log": invoice_log,
            "expense_log": expense_log,
            "closings": closings,
            "item_log": item_log,
            "early_payments": early_payments,
            "sales_edits": sales_edits,
            "purchase_edits": purchase_edits,
            "purchase_log": purchase_log,
            "disposal_log": disposal_log,
            "repayment_log": repayment_log,
            "customer_repayment_log": customer_repayment_log,
            "cash_log": cash_log,
            "customer_opening_log": customer_opening_log,
            "supplier_opening_log": supplier_opening_log,
            "search_terms": search_terms,
        }
    )
