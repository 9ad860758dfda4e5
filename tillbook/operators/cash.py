"""Expense and cash box reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.functions.dates import Day, in_days, of_days, on_day
from tillbook.functions.money import total


def expense_register(t, first: Day, last: Day, newest_first: bool = False) -> DataFrame:
    """Expenses of a period with type, shelf and user."""
    order = F.desc("expenseID") if newest_first else F.asc("expenseID")
    return (
        t.expenses.filter(in_days("createAt", first, last))
        .join(t.type_expense, "typeExpenseID")
        .join(t.shelfs, "shelfID")
        .join(
            t.users.select(F.col("userID").alias("userIDCreated"), "userName"), "userIDCreated"
        )
        .orderBy(order)
        .select(
            "expenseID", "typeName", "typeExpenseID", "shelfID", "shelfName", "priceExpenseIQD",
            "priceExpenseUSD", "dollarPrice", "note", "createAt", "userName",
        )
    )


def expense_totals(t, first: Day, last: Day) -> DataFrame:
    """Expenses of a period in both currencies; NULL when there are none."""
    return t.expenses.filter(in_days("createAt", first, last)).agg(
        F.sum("priceExpenseIQD").cast(S.IQD_TOTAL).alias("totalIQD"),
        total(F.col("priceExpenseUSD")).alias("totalUSD"),
    )


def expense_day(t, day: Day) -> DataFrame:
    """IQD total, zero when there is none, and number of a day's expenses."""
    return t.expenses.filter(on_day("createAt", day)).agg(
        F.coalesce(F.sum("priceExpenseIQD"), F.lit(0)).cast(S.IQD_TOTAL).alias("total"),
        F.count(F.lit(1)).alias("numberOfExpenses"),
    )


def box_register(t, first: Day, last: Day) -> DataFrame:
    """Cash rows of a period with shelf and user."""
    return (
        of_days(t.box_transaction, first, last)
        .join(t.shelfs, "shelfID")
        .join(t.users.select("userID", F.col("userName").alias("user")), "userID")
        .select(
            "btID", "shelfID", "shelfName", "sourceID", "amount", "amountIQD", "type", "note",
            "createAt", "user",
        )
    )


def box_balance(t, shelf_id: int | None = None) -> DataFrame:
    """Money in the box per shelf. For one shelf: one row, NULL when it has none."""
    sums = (
        total(F.col("amount")).alias("amount"),
        F.sum("amountIQD").cast(S.IQD_TOTAL).alias("amountIQD"),
    )
    if shelf_id is None:
        return t.box_transaction.groupBy("shelfID").agg(*sums)
    return t.box_transaction.filter(F.col("shelfID") == shelf_id).agg(*sums)


def box_value(t) -> DataFrame:
    """Money in the box per shelf and what it is worth in dollars at the current rate.

    The rate is one row; without it, or at a rate of zero, only the dollars count, as in ``to_dollars``.
    """
    rate = t.dollar.filter(F.col("dollarId") == S.CURRENT).agg(F.max("dollarPrice")).scalar()
    balance = box_balance(t)
    worth = F.round(F.try_divide(F.col("amountIQD"), rate), 6)
    return balance.withColumn(
        "inDollars", (F.col("amount") + F.coalesce(worth, F.lit(0))).cast(S.CONVERTED)
    )


def money_transfers(t, first: Day, last: Day) -> DataFrame:
    """Transfers between shelves with both names and the user."""
    target = t.shelfs.select(
        F.col("shelfID").alias("shelfID2"), F.col("shelfName").alias("shelfName2")
    )
    return (
        t.money_box.filter(in_days("createAt", first, last))
        .join(t.users.select("userID", "userName"), "userID")
        .join(t.shelfs, "shelfID", "left")
        .join(target, "shelfID2", "left")
        .select(
            "mbID", "shelfID", "shelfName", "shelfID2", "shelfName2", "amount", "createAt", "userName"
        )
    )


def dimension_counts(t) -> DataFrame:
    """Row counts of the master tables, one row each."""
    active = t.customers.filter(F.col("activeStatus") == S.YES)
    live = t.items.filter(F.col("deleteStatus") == S.YES)
    counted = {
        "customers": t.customers,
        "activeCustomers": active,
        "items": live,
        "expenseTypes": t.type_expense,
        "categories": t.categories,
        "brands": t.brands,
    }
    rows = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("dimension"), "n")
        for name, df in counted.items()
    ]
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row)
    return stacked


# Master tables that are shown page by page, with their keys.
PAGED = {"type_expense": "typeExpenseID", "categories": "categoryID", "brands": "brandID"}


def dimension_page(t, table: str, offset: int, size: int) -> DataFrame:
    """A slice of a master table, newest first."""
    return getattr(t, table).orderBy(F.desc(PAGED[table])).offset(offset).limit(size)
