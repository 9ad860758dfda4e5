"""Sales, profit and invoice reports."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.functions import ordered
from tillbook.functions.dates import Day, as_date, in_days, of_days, on_day
from tillbook.functions.documents import LINES_PER_PART, nested
from tillbook.functions.money import due, gain, in_dollars, margin, total, total0, units0

SOLD_TYPES = (S.SALE, S.SALE_RETURN)
PROFIT_TYPES = (S.SALE, S.SALE_RETURN, S.DISPOSAL)


def _where(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def _is(column: str, code: str) -> Column:
    return F.col(column) == code


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side: stacked, then folded into a single row."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def money_movement(t, first: Day, last: Day) -> DataFrame:
    """Ten totals of a period in one row; every ledger is read once.

    Invoices count whether closed or not, and the discount total has no type
    filter. Repayments to suppliers are stored net of discount and reported net
    again.
    """
    invoices = t.invoices.filter(in_days("createAt", first, last)).agg(
        total0(_where(_is("stockType", S.SALE), F.col("totalPrice"))).alias("totalSale"),
        total0(_where(_is("stockType", S.SALE_RETURN), F.col("totalPrice"))).alias("totalReturnSale"),
        total0(F.col("discount")).alias("totalDiscountInvoice"),
    )
    purchases = t.purchases.filter(in_days("createAt", first, last)).agg(
        total0(_where(_is("stockType", S.PURCHASE), F.col("totalPrice"))).alias("totalPurchase"),
        total0(_where(_is("stockType", S.PURCHASE_RETURN), F.col("totalPrice"))).alias(
            "totalReturnPurchase"
        ),
        total0(F.col("discount")).alias("totalDiscountPurchase"),
    )
    net = F.col("amountReturn") - F.col("discount")
    from_customers = t.return_debt_customer.filter(in_days("createAt", first, last)).agg(
        total0(net).alias("totalDebtCustomer")
    )
    to_suppliers = t.return_debt.filter(in_days("createAt", first, last)).agg(
        total0(net).alias("totalDebtCompany")
    )
    converted = in_dollars(F.col("priceExpenseIQD"), F.col("dollarPrice"))
    expenses = t.expenses.filter(in_days("createAt", first, last)).agg(
        (
            F.coalesce(F.sum(converted), F.lit(0)) + F.coalesce(F.sum("priceExpenseUSD"), F.lit(0))
        )
        .cast(S.CONVERTED)
        .alias("totalExpenseDollar")
    )
    sold = of_days(t.stock, first, last).filter(F.col("sourceType").isin(*SOLD_TYPES))
    profit = sold.agg(total0(gain()).alias("totalProfit"))
    return one_row(invoices, purchases, from_customers, to_suppliers, expenses, profit)


def profit_by_source(t, first: Day, last: Day) -> DataFrame:
    """Profit, sales value and loss per document. Loss: lines sold below cost."""
    below = _is("sourceType", S.SALE) & (margin() < 0)
    return (
        of_days(t.stock, first, last).filter(F.col("sourceType").isin(*PROFIT_TYPES))
        .groupBy("sourceID", "sourceType")
        .agg(
            total(gain()).alias("totalProfit"),
            total(-(F.col("qty") * F.col("itemPrice"))).alias("totalSale"),
            total0(_where(below, gain())).alias("totalLoss"),
        )
    )


def profit_totals(t, first: Day, last: Day) -> DataFrame:
    """Profit over sales, returns and disposals; the disposals' share; the loss on sales."""
    below = _is("sourceType", S.SALE) & (margin() < 0)
    return of_days(t.stock, first, last).filter(F.col("sourceType").isin(*PROFIT_TYPES)).agg(
        total0(gain()).alias("totalAll"),
        total0(_where(_is("sourceType", S.DISPOSAL), gain())).alias("totalDisposal"),
        total0(_where(below, gain())).alias("totalLoss"),
    )


def _top_categories(t, moved: DataFrame, n: int) -> DataFrame:
    by_item = moved.groupBy("itemID").agg(F.sum("qty").alias("qty"))
    by_category = (
        by_item.join(t.items.select("itemID", "categoryID"), "itemID")
        .groupBy("categoryID")
        .agg((-F.sum("qty")).cast("bigint").alias("totalSale"))
    )
    return (
        by_category.join(t.categories, "categoryID")
        .orderBy(F.desc("totalSale"), "categoryID")
        .limit(n)
        .select("categoryName", "totalSale")
    )


def top_categories(t, n: int = 10) -> DataFrame:
    """Categories by net quantity sold, all time."""
    return _top_categories(t, t.stock.filter(F.col("sourceType").isin(*SOLD_TYPES)), n)


def top_categories_day(t, day: Day, n: int = 10) -> DataFrame:
    """Categories by quantity sold on one day; returns do not count."""
    sold = of_days(t.stock, day, day).filter(_is("sourceType", S.SALE))
    return _top_categories(t, sold, n)


# Column stems of the week overview, newest day first.
WEEK = (
    "today",
    "PreviousOneDay",
    "PreviousTwoDay",
    "PreviousThreeDay",
    "PreviousFourDay",
    "PreviousFiveDay",
    "PreviousSixDay",
)


def daily_sale_purchase(t, day: Day) -> DataFrame:
    """Sale and purchase value of the day and the six before it, one row, one scan."""
    last = as_date(day)
    first = last - dt.timedelta(days=len(WEEK) - 1)
    moved = of_days(t.stock, first, last).filter(F.col("sourceType").isin(S.SALE, S.PURCHASE))
    columns = []
    for ago, stem in enumerate(WEEK):
        that_day = on_day("createAt", last - dt.timedelta(days=ago))
        sale = _where(_is("sourceType", S.SALE) & that_day, -(F.col("qty") * F.col("itemPrice")))
        bought = _where(_is("sourceType", S.PURCHASE) & that_day, F.col("qty") * F.col("costPrice"))
        columns += [total0(sale).alias(f"{stem}Sale"), total0(bought).alias(f"{stem}Purchase")]
    return moved.agg(*columns)


def sale_purchase_by_day(t, day: Day, days: int = 7) -> DataFrame:
    """The same as one row per day, for any number of days; days without rows show zero."""
    last = as_date(day)
    first = last - dt.timedelta(days=days - 1)
    spine = t.stock.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day")
    )
    moved = (
        of_days(t.stock, first, last).filter(F.col("sourceType").isin(S.SALE, S.PURCHASE))
        .groupBy(F.to_date("createAt").alias("day"))
        .agg(
            total0(
                _where(_is("sourceType", S.SALE), -(F.col("qty") * F.col("itemPrice")))
            ).alias("sale"),
            total0(
                _where(_is("sourceType", S.PURCHASE), F.col("qty") * F.col("costPrice"))
            ).alias("purchase"),
        )
    )
    zero = F.lit(0).cast(S.TOTAL)
    return (
        spine.join(moved, "day", "left")
        .select(
            "day",
            F.coalesce("sale", zero).alias("sale"),
            F.coalesce("purchase", zero).alias("purchase"),
        )
        .orderBy(F.desc("day"))
    )


def sold_on_day(t, day: Day) -> DataFrame:
    """Closed sales of a day."""
    sold = t.invoices.filter(
        _is("sellStatus", S.YES) & _is("stockType", S.SALE) & on_day("createAt", day)
    )
    return sold.join(t.customers.select("customerID", "customerName"), "customerID").select(
        "invoiceID", "customerName", "totalPrice", "invoiceType", "discount", "stockType",
        "initialPay", "totalPay", "totalPayIQD",
    )


REGISTER = (
    "invoiceID", "customerID", "customerName", "userIDUpdate", "userName", "totalPrice",
    "initialPay", "totalPay", "discount", "stockType", "invoiceType", "createAt",
)


def invoice_register(t, first: Day, last: Day) -> DataFrame:
    """Invoices of a period with customer and user, newest first."""
    return (
        t.invoices.filter(in_days("createAt", first, last))
        .join(t.users.select("userID", "userName"), "userID")
        .join(t.customers.select("customerID", "customerName"), "customerID")
        .select(*REGISTER)
        .orderBy(F.desc("invoiceID"))
    )


def invoice_register_own(t) -> DataFrame:
    """Invoices of all time whose customer was entered by the invoice's user."""
    owned = t.customers.select("customerID", "customerName", "userID")
    return (
        t.invoices.join(owned, ["customerID", "userID"])
        .join(t.users.select("userID", "userName"), "userID")
        .select(*REGISTER)
        .orderBy(F.desc("invoiceID"))
    )


def invoice_day_totals(t, day: Day) -> DataFrame:
    """Value and outstanding amount of a day's invoices; NULL when there are none."""
    return t.invoices.filter(on_day("createAt", day)).agg(
        total(F.col("totalPrice")).alias("totalCash"), total(due()).alias("totalDebt")
    )


def sales_by_owner(t) -> DataFrame:
    """Net quantity and value sold per item, day and price, with the item's shelf."""
    moved = (
        t.stock.filter(F.col("sourceType").isin(*SOLD_TYPES))
        .groupBy("itemID", F.to_date("createAt").alias("createAt"), "itemPrice")
        .agg(F.sum("qty").alias("qty"))
    )
    return (
        moved.join(t.items.select("itemID", "itemCode", "itemName", "shelfID"), "itemID")
        .join(t.shelfs, "shelfID")
        .select(
            "itemID",
            "itemCode",
            "itemName",
            "shelfName",
            "shelfID",
            (-F.col("qty")).cast("bigint").alias("sold"),
            F.coalesce(-(F.col("qty") * F.col("itemPrice")), F.lit(0))
            .cast(S.TOTAL)
            .alias("totalPriceSold"),
            "createAt",
        )
        .orderBy(F.desc("createAt"), "itemID", "totalPriceSold")
    )


def items_sold_by_customer(t, customer_id: int | None = None) -> DataFrame:
    """Invoice lines of a customer, or of all, newest first."""
    heads = t.invoices if customer_id is None else t.invoices.filter(F.col("customerID") == customer_id)
    return (
        t.invoice_item.select("invoiceID", "itemID", "qty", "productPrice")
        .join(heads.select("invoiceID", "customerID", "createAt"), "invoiceID")
        .join(t.customers.select("customerID"), "customerID")
        .join(t.items.select("itemID", "itemCode", "itemName"), "itemID")
        .orderBy(F.desc("createAt"), F.desc("invoiceID"), "itemID")
        .select(
            "customerID",
            "invoiceID",
            "itemCode",
            "itemName",
            "qty",
            "productPrice",
            F.to_date("createAt").alias("createAt"),
        )
    )


def _closed_sales(t, first: Day, last: Day) -> DataFrame:
    return t.invoices.filter(
        _is("stockType", S.SALE) & _is("sellStatus", S.YES) & in_days("createAt", first, last)
    ).select("invoiceID")


def sold_items(t, first: Day, last: Day) -> DataFrame:
    """Lines of closed sales of a period."""
    return (
        t.invoice_item.join(_closed_sales(t, first, last), "invoiceID")
        .join(t.items.select("itemID", "itemCode", "itemName", F.col("shelfID").alias("_shelf")), "itemID")
        .select(
            "itemCode", "itemName", F.col("_shelf").alias("shelfID"), "qty", "productPrice", "invoiceID"
        )
    )


def sold_items_total(t, first: Day, last: Day) -> DataFrame:
    """Quantity and value of closed sales per item."""
    by_item = (
        t.invoice_item.join(_closed_sales(t, first, last), "invoiceID")
        .groupBy("itemID")
        .agg(
            F.sum("qty").cast("bigint").alias("qty"),
            total(F.col("productPrice") * F.col("qty")).alias("total"),
        )
    )
    return by_item.join(t.items.select("itemID", "itemName", "shelfID"), "itemID").select(
        "itemID", "itemName", "shelfID", "qty", "total"
    )


def open_invoices(t, user_id: int | None = None) -> DataFrame:
    """Invoices not yet closed, of one user or of all, in order."""
    rows = t.invoices.filter(_is("sellStatus", S.NO))
    if user_id is not None:
        rows = rows.filter(F.col("userIDUpdate") == user_id)
    return rows.select("userIDUpdate", "invoiceID").orderBy("userIDUpdate", "invoiceID")


def invoice_documents(
    t,
    invoice_id: int | None = None,
    first: Day | None = None,
    last: Day | None = None,
    lines_per_part: int = LINES_PER_PART,
) -> DataFrame:
    """Invoices with their lines nested: header, customer, user, array of lines.

    A row holds ``lines_per_part`` lines at most; a longer document goes on in further parts.
    """
    heads = t.invoices
    lines = t.invoice_item
    if invoice_id is not None:
        heads = heads.filter(F.col("invoiceID") == invoice_id)
        lines = lines.filter(F.col("invoiceID") == invoice_id)
    if first is not None and last is not None:
        heads = heads.filter(in_days("createAt", first, last))
        lines = lines.join(heads.select("invoiceID"), "invoiceID", "left_semi")
    counted = lines.select("invoiceID")
    heads = (
        heads.join(t.customers.select("customerID", "customerName"), "customerID")
        .join(
            t.users.select(F.col("userID").alias("userIDUpdate"), "fullName"), "userIDUpdate"
        )
        .select(
            "invoiceID", "customerID", "customerName", "totalPrice", "discount", "stockType",
            "invoiceType", "sellStatus", "totalPay", "initialPay", "totalPayIQD", "dollarPrice",
            "fullName",
        )
    )
    lines = (
        lines.join(t.items.select("itemID", "itemName"), "itemID")
        .join(t.units, "unitID")
        .select("invoiceID", "invdID", "itemID", "itemName", "qty", "productPrice", "unitName")
    )
    return nested(heads, lines, "invoiceID", "invdID", "invoiceItems", counted, lines_per_part)


def invoice_neighbours(t) -> DataFrame:
    """Previous and next invoice of every invoice."""
    return ordered.neighbours(t.invoices, "invoiceID", "previousInvoice", "nextInvoice")


def profit_by_item(t, first: Day, last: Day) -> DataFrame:
    """Quantity, profit and loss per item over sales, returns and disposals.

    Loss here covers all three kinds and rows at or below cost, with the sign of
    the ledger.
    """
    moved = (
        of_days(t.stock, first, last).filter(F.col("sourceType").isin(*PROFIT_TYPES))
        .groupBy("itemID")
        .agg(
            (-F.sum("qty")).cast("bigint").alias("totalQtySale"),
            total(gain()).alias("profitByItem"),
            total(F.when(margin() <= 0, -gain()).otherwise(0)).alias("totalLoss"),
        )
    )
    return (
        t.items.select("itemID", "itemCode", "itemName", "categoryID", "brandID", "shelfID")
        .join(moved, "itemID")
        .join(t.categories, "categoryID", "left")
        .join(t.brands, "brandID", "left")
        .join(t.shelfs, "shelfID", "left")
        .select(
            "itemID", "itemCode", "itemName", "totalQtySale", "profitByItem", "totalLoss",
            "categoryName", "brandName", "shelfName",
        )
    )


def top_items_month(t, month: int, n: int = 5, year: int | None = None) -> DataFrame:
    """Items by quantity sold in a calendar month, over all years unless one is given."""
    ledger = t.stock
    if year is not None:
        ledger = of_days(ledger, dt.date(year, 1, 1), dt.date(year, 12, 31))
    sold = ledger.filter(_is("sourceType", S.SALE) & (F.month("createAt") == month))
    by_item = sold.groupBy("itemID").agg((-F.sum("qty")).cast("bigint").alias("topSale"))
    return (
        by_item.join(t.items.select("itemID", "itemName"), "itemID")
        .orderBy(F.desc("topSale"), "itemID")
        .limit(n)
        .select("itemID", "itemName", "topSale")
    )


def slow_items(t, lo: int = 0, hi: int = 10) -> DataFrame:
    """Items with a sold quantity between two bounds; items never stocked count as zero."""
    sold = (
        t.stock.filter(_is("sourceType", S.SALE))
        .groupBy("itemID")
        .agg(units0(F.col("qty")).alias("qty"))
    )
    return (
        t.items.select("itemID", "itemName")
        .join(sold, "itemID", "left")
        .withColumn("notSale", (-F.coalesce("qty", F.lit(0))).cast("bigint"))
        .filter(F.col("notSale").between(lo, hi))
        .orderBy("notSale", "itemID")
        .select("itemID", "itemName", "notSale")
    )
