"""Repayments spent on open invoices, oldest first.

An invoice is filled when the money suffices for it and all before it. The first
one it does not suffice for takes what is left and ends the row. Because an
overpaid invoice has a negative amount due and gives money back, the test uses the
highest running sum so far and not the running sum itself.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.functions.names import explode_ids, id_array
from tillbook.functions.ordered import next_value, prefix_sums
from tillbook.functions.spread import HOT_FLOOR, hot_keys
from tillbook.operators.parties import unpaid_sales


BILL, PAYMENT = 0, 1


def automatic_repayments(t) -> DataFrame:
    """Repayments that name no invoice; those that do are spent by ``settle_listed``."""
    return t.return_debt_customer.filter(F.size(id_array(F.col("invoiceNumbers"))) == 0)


def allocate_repayments(
    t, floor: int = HOT_FLOOR, payments: DataFrame | None = None
) -> DataFrame:
    """Repayments of every customer over the customer's unpaid sales.

    ``payments`` are those to spend now, with the columns of ``return_debt_customer``. A table
    does not tell which repayments ``totalPay`` holds already, so whoever calls this on
    live tables gives the new ones only. By default they are all that name no invoice.

    Paying in sequence fills the same invoices as paying the sum at once, so the
    running sums give the amounts. ``rdcID`` is the repayment that filled the
    invoice: the first one whose own running sum reaches the invoice's.

    Invoices and repayments get their running sums in one ordered pass. A second
    one lays both on one line per customer by these sums; the next repayment on
    the line is the one wanted. Both passes share one shuffle by customer, except
    that customers with very many rows are cut into segments.
    """
    given = automatic_repayments(t) if payments is None else payments
    bills = unpaid_sales(t).select(
        "customerID", F.lit(BILL).alias("_kind"), "createAt", F.col("invoiceID").alias("_id"),
        F.col("total").alias("_value"), "totalPay",
    )
    payments = given.select(
        "customerID", F.lit(PAYMENT).alias("_kind"), "createAt", F.col("rdcID").alias("_id"),
        F.col("amountReturn").alias("_value"), F.lit(None).cast(S.MONEY).alias("totalPay"),
    )
    money = given.groupBy("customerID").agg(F.sum("amountReturn").alias("_money"))
    rows = bills.unionByName(payments)
    hot = hot_keys(rows, ["customerID"], floor)
    summed = prefix_sums(
        rows, ["customerID", "_kind"], ["createAt", "_id"], "_value", money, hot
    )
    reached = F.col("peak_before").isNull() | (F.col("peak_before") <= F.col("_money"))
    left_over = F.coalesce(F.col("_money") - (F.col("running") - F.col("_value")), F.lit(0))
    marked = summed.withColumn(
        "_full", F.coalesce(F.col("peak") <= F.col("_money"), F.lit(False))
    ).select(
        "customerID",
        "_kind",
        "createAt",
        "_id",
        F.col("_value").alias("due"),
        "totalPay",
        F.when(F.col("_full"), F.col("_value")).when(reached, left_over).otherwise(0).alias("pays"),
        F.when(F.col("_full"), S.YES).otherwise(S.NO).alias("wasl"),
        F.when(F.col("_kind") == BILL, F.col("peak")).otherwise(F.col("running")).alias("_level"),
        F.when(F.col("_kind") == PAYMENT, F.col("_id")).alias("_payment"),
    )
    line = next_value(
        marked, ["customerID"], ["_level", "_kind", "createAt", "_id"], "_payment", "_filler", hot
    )
    return line.filter(F.col("_kind") == BILL).select(
        F.col("_id").alias("invoiceID"),
        "customerID",
        "due",
        F.col("pays").cast(S.MONEY).alias("pays"),
        (F.col("totalPay") + F.col("pays")).cast(S.MONEY).alias("totalPay"),
        "wasl",
        F.when(F.col("wasl") == S.YES, F.col("_filler")).alias("rdcID"),
    )


def _timeline(t, payments: DataFrame, floor: int) -> DataFrame:
    """Open invoices and payments of every customer on one line of time, with what is paid by whom.

    What a customer owes after an invoice is ``debt + due``, and after a payment ``max(0, debt - amount)``. With the
    running sum of all that is due less all that was given, the debt is that sum less its least value so far at a
    payment, or less 0, so that two windows, or segments that hand on a sum and a peak, give it to every row.
    Money used up to a payment is a level on the line of all that was due; an invoice is filled by the first payment
    that reaches its own.
    """
    bills = unpaid_sales(t).select(
        "customerID", "createAt", F.lit(BILL).alias("_kind"), F.col("invoiceID").alias("_id"),
        F.col("total").alias("_due"), "totalPay", F.lit(0).cast(S.MONEY).alias("_given"),
    )
    money = payments.select(
        "customerID", "createAt", F.lit(PAYMENT).alias("_kind"), F.col("rdcID").alias("_id"),
        F.lit(0).cast(S.MONEY).alias("_due"), F.lit(None).cast(S.MONEY).alias("totalPay"),
        F.coalesce("amountReturn", F.lit(0)).cast(S.MONEY).alias("_given"),
    )
    rows = bills.unionByName(money).withColumns(
        {
            "_owed": F.greatest(F.col("_due"), F.lit(0)).cast(S.TOTAL),
            "_less": (F.col("_given") - F.col("_due")).cast(S.TOTAL),
            "_payment": F.when(F.col("_kind") == PAYMENT, F.col("_id")),
        }
    )
    hot = hot_keys(rows, ["customerID"], floor)
    time, paying = ["createAt", "_kind", "_id"], F.col("_kind") == PAYMENT
    key = ["customerID"]
    summed = prefix_sums(rows, key, time, "_owed", hot=hot).drop("peak", "peak_before")
    summed = summed.withColumnRenamed("running", "_billed")
    summed = prefix_sums(summed, key, time, "_less", hot=hot, peak_at=paying)
    summed = next_value(summed, key, time, "_payment", "_next_payment", hot)
    nothing = F.lit(0).cast(S.TOTAL)
    lost, lost_before = (F.greatest(F.coalesce(c, nothing), nothing) for c in ("peak", "peak_before"))
    # At a payment: all given so far, credits of overpaid invoices included, less what nobody owed.
    used = F.col("_billed") + F.col("running") - lost
    marked = summed.select(
        *key, "createAt", "_kind", "_id", "_due", "totalPay", "_given", "_payment", "_next_payment", "_billed",
        F.when(paying, used).alias("_used"),
        F.when(paying, lost - lost_before).alias("_unused"),
        F.when(paying, used).otherwise(F.col("_billed")).alias("_level"),
    )
    return next_value(marked, key, ["_level", *time], "_payment", "_filler", hot)


def allocate_in_time(t, payments: DataFrame, floor: int = HOT_FLOOR) -> DataFrame:
    """Open invoices after payments that each meet only what was open when they were made.

    ``payments`` have the columns of ``return_debt_customer`` and are new: none is in ``totalPay`` yet. A payment
    fills the oldest open invoices of its customer first and the first it does not suffice for in part; what is
    left after the last one is not kept for later invoices. An overpaid invoice owes nothing: the next payment
    settles it and spends its credit too. Invoices of the moment of a payment count as open.

    ``wasl`` and ``rdcID`` tell whether an invoice is filled and by which payment, ``pays`` what it was given.
    A payment without amount gives nothing; rows without customer belong together.
    """
    line = _timeline(t, payments, floor)
    given = line.groupBy("customerID").agg(F.max("_used").alias("_spent"))
    bills = line.filter(F.col("_kind") == BILL)
    spent = bills.join(given.withColumnRenamed("customerID", "_who"), F.col("customerID").eqNullSafe(F.col("_who")), "left")
    due, level = F.col("_due"), F.col("_billed")
    overpaid = due < 0
    reached = F.greatest(F.coalesce("_spent", F.lit(0)) - (level - due), F.lit(0))
    pays = F.when(overpaid, F.when(F.col("_next_payment").isNotNull(), due).otherwise(0)).otherwise(
        F.least(due, reached)
    )
    filler = F.when(overpaid, F.col("_next_payment")).otherwise(F.col("_filler"))
    return spent.select(
        F.col("_id").alias("invoiceID"),
        "customerID",
        "createAt",
        due.alias("due"),
        pays.cast(S.MONEY).alias("pays"),
        (F.col("totalPay") + pays).cast(S.MONEY).alias("totalPay"),
        F.when(filler.isNotNull(), S.YES).otherwise(S.NO).alias("wasl"),
        filler.alias("rdcID"),
    )


def unused_money(t, payments: DataFrame, floor: int = HOT_FLOOR) -> DataFrame:
    """What of every payment nobody owed at the time, see ``allocate_in_time``.

    It holds what overpaid invoices since the payment before added, so it may exceed the amount.
    """
    return _timeline(t, payments, floor).filter(F.col("_kind") == PAYMENT).select(
        F.col("_id").alias("rdcID"),
        "customerID",
        F.col("_given").alias("amount"),
        F.col("_unused").cast(S.MONEY).alias("unused"),
    )


def settle_listed(t) -> DataFrame:
    """Invoices after the repayments that name them: paid off and marked.

    Where several repayments name an invoice, the last one stays on it.
    """
    listed = explode_ids(t.return_debt_customer, "invoiceNumbers", "invoiceID")
    last = listed.groupBy("invoiceID").agg(
        F.max_by("rdcID", F.struct("createAt", "rdcID")).alias("_rdc")
    )
    hit = F.col("_rdc").isNotNull()
    return t.invoices.join(last, "invoiceID", "left").select(
        "invoiceID",
        "customerID",
        F.when(hit, F.col("totalPrice") - F.col("initialPay"))
        .otherwise(F.col("totalPay"))
        .cast(S.MONEY)
        .alias("totalPay"),
        F.when(hit, S.YES).otherwise(F.col("wasl")).alias("wasl"),
        F.coalesce("_rdc", "rdcID").alias("rdcID"),
    )
