"""From documents to ledgers.

Each rule is a pure function of document tables, so a ledger is rebuilt whole or
per day and can never be half posted. Signs: goods leaving the shop and money
owed by a customer are negative; a balance is a plain SUM.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.functions.money import in_dollars, to_dollars
from tillbook.functions.names import explode_ids, name_key

# Note texts the shop prints on cash rows.
PURCHASE_NOTE = "کڕینی کاڵا لە بە ژمارە وەصڵی"
EXPENSE_NOTE = "خەرجی"

STOCK = {
    "sourceID": "bigint",
    "sourceType": "string",
    "itemID": "bigint",
    "qty": "int",
    "itemPrice": S.MONEY,
    "costPrice": S.MONEY,
    "expiryDate": "date",
    "createAt": "timestamp_ntz",
}
BOX = {
    "shelfID": "bigint",
    "sourceID": "bigint",
    "amount": S.MONEY,
    "amountIQD": S.IQD,
    "type": "string",
    "note": "string",
    "userID": "bigint",
    "createAt": "timestamp_ntz",
}
PARTY = {
    "sourceID": "bigint",
    "sourceType": "string",
    "accountID": "bigint",
    "accountType": "string",
    "accountName": "string",
    "totalPrice": S.MONEY,
    "totalPay": S.CONVERTED,
    "totalPayIQD": S.IQD,
    "transactionType": "string",
    "userID": "bigint",
    "createAt": "timestamp_ntz",
}


def _posted(df: DataFrame, ledger: dict[str, str], **columns: Column) -> DataFrame:
    """Ledger rows: the given columns, the rest taken over under their own name."""
    return df.select(
        *[columns.get(name, F.col(name)).cast(kind).alias(name) for name, kind in ledger.items()]
    )


def _turned(condition: Column, value: Column) -> Column:
    """The value, negative where the condition holds."""
    return F.when(condition, -value).otherwise(value)


def _sold(t) -> DataFrame:
    return t.invoices.filter(F.col("sellStatus") == S.YES)


def post_sales_stock(t) -> DataFrame:
    """Lines of closed invoices as stock rows.

    A sale takes goods out and forgets the expiry date; a return brings them back
    and keeps it. The sign follows from the document type alone.
    """
    heads = _sold(t).select("invoiceID", F.col("stockType").alias("sourceType"), "createAt")
    sale = F.col("sourceType") == S.SALE
    return _posted(
        t.invoice_item.join(heads, "invoiceID"),
        STOCK,
        sourceID=F.col("invoiceID"),
        qty=_turned(sale, F.col("qty")),
        itemPrice=F.col("productPrice"),
        expiryDate=F.when(~sale, F.col("expiryDate")),
    )


def post_sales_box(
    t, sale_note: str = "", invoice_word: str = "", return_note: str = ""
) -> DataFrame:
    """One cash row per closed invoice: in for a sale, out for a return."""
    names = t.customers.select("customerID", "customerName")
    back = F.col("stockType") != S.SALE
    name = F.col("customerName")
    sale_text = F.concat_ws(" ", F.lit(sale_note), name, F.lit(invoice_word), F.col("invoiceID"))
    note = F.when(back, F.concat_ws(" ", F.lit(return_note), name)).otherwise(sale_text)
    return _posted(
        _sold(t).join(names, "customerID", "left"),
        BOX,
        shelfID=F.lit(S.MAIN_SHELF),
        sourceID=F.col("invoiceID"),
        amount=_turned(back, F.col("initialPay")),
        amountIQD=_turned(back, F.col("totalPayIQD")),
        type=F.col("stockType"),
        note=F.trim(note),
        userID=F.col("userIDUpdate"),
    )


def post_sales_account(t) -> DataFrame:
    """Closed invoices of known customers as party rows; the walk-in keeps no account."""
    names = t.customers.select("customerID", "customerName")
    sale = F.col("stockType") == S.SALE
    paid = to_dollars(F.col("initialPay"), F.col("totalPayIQD"), F.col("dollarPrice"))
    known = _sold(t).filter(F.col("customerID") != S.WALK_IN)
    return _posted(
        known.join(names, "customerID", "left"),
        PARTY,
        sourceID=F.col("invoiceID"),
        sourceType=F.col("stockType"),
        accountID=F.col("customerID"),
        accountType=F.lit(S.CUSTOMER),
        accountName=F.col("customerName"),
        totalPrice=_turned(sale, F.col("totalPrice")),
        totalPay=F.when(sale, paid).otherwise(0),
        transactionType=F.col("invoiceType"),
        userID=F.col("userIDUpdate"),
    )


def post_purchase_stock(t) -> DataFrame:
    """Purchase lines as stock rows without a sale price; returns go out."""
    heads = t.purchases.select("purchaseID", F.col("stockType").alias("sourceType"), "createAt")
    return _posted(
        t.purchase_items.join(heads, "purchaseID"),
        STOCK,
        sourceID=F.col("purchaseID"),
        qty=_turned(F.col("sourceType") != S.PURCHASE, F.col("qty")),
        itemPrice=F.lit(0),
        expiryDate=F.lit(None),
    )


def post_purchase_box(t) -> DataFrame:
    """Money paid for a purchase leaves the box; money for a return comes in."""
    out = F.col("stockType") == S.PURCHASE
    return _posted(
        t.purchases,
        BOX,
        shelfID=F.lit(S.MAIN_SHELF),
        sourceID=F.col("purchaseID"),
        amount=_turned(out, F.col("amountPay")),
        amountIQD=_turned(out, F.col("amountPayIQD")),
        type=F.col("stockType"),
        note=F.concat_ws(" ", F.lit(PURCHASE_NOTE), F.col("referenceNo")),
        userID=F.col("userIDCreated"),
    )


def post_purchase_account(t) -> DataFrame:
    """Purchases and purchase returns as supplier rows."""
    names = t.suppliers.select("supplierID", "supplierName")
    bought = F.col("stockType") == S.PURCHASE
    paid = to_dollars(F.col("amountPay"), F.col("amountPayIQD"), F.col("dollarPrice"))
    return _posted(
        t.purchases.join(names, "supplierID", "left"),
        PARTY,
        sourceID=F.col("purchaseID"),
        sourceType=F.col("stockType"),
        accountID=F.col("supplierID"),
        accountType=F.lit(S.SUPPLIER),
        accountName=F.col("supplierName"),
        totalPrice=_turned(~bought, F.col("totalPrice")),
        totalPay=F.when(bought, paid).otherwise(0),
        totalPayIQD=F.col("amountPayIQD"),
        transactionType=F.col("paymentType"),
        userID=F.col("userIDCreated"),
    )


def post_disposal(t) -> DataFrame:
    """Thrown away goods: out of stock at cost.

    The sale price is taken as zero, so that a disposal counts as a loss of its cost.
    """
    return _posted(
        t.disposals,
        STOCK,
        sourceID=F.col("disposalID"),
        sourceType=F.lit(S.DISPOSAL),
        qty=-F.col("qty"),
        itemPrice=F.lit(0),
    )


def _opened(df: DataFrame, key: str, name: str, code: str, account: str, amount: Column) -> DataFrame:
    return _posted(
        df,
        PARTY,
        sourceID=F.col(key),
        sourceType=F.lit(code),
        accountID=F.col(key),
        accountType=F.lit(account),
        accountName=F.col(name),
        totalPrice=amount,
        totalPay=F.lit(0),
        totalPayIQD=F.lit(0),
        transactionType=F.lit(S.DEBT),
    )


def post_customer_opening(t) -> DataFrame:
    """Debts that customers brought along."""
    return _opened(
        t.customers, "customerID", "customerName", S.OPENING_CUSTOMER, S.CUSTOMER, -F.col("previousDebt")
    )


def post_supplier_opening(t) -> DataFrame:
    """Balances that suppliers brought along."""
    return _opened(
        t.suppliers, "supplierID", "supplierName", S.OPENING_SUPPLIER, S.SUPPLIER, F.col("previousBalance")
    )


def post_opening(t) -> DataFrame:
    """Debts and balances partners brought along when they were entered."""
    return post_customer_opening(t).unionByName(post_supplier_opening(t))


def post_customer_repayment_account(t) -> DataFrame:
    """Repayments of customers as party rows; the walk-in keeps no account.

    ``amountReturn`` is stored with the second currency added; the discount comes off here. The
    shop no longer posts these rows, it only corrects the ones it has, so they are not part of ``party_ledger``.
    """
    names = t.customers.select("customerID", "customerName")
    known = t.return_debt_customer.filter(F.col("customerID") != S.WALK_IN)
    return _posted(
        known.join(names, "customerID", "left"),
        PARTY,
        sourceID=F.col("rdcID"),
        sourceType=F.lit(S.REPAY_CUSTOMER),
        accountID=F.col("customerID"),
        accountType=F.lit(S.CUSTOMER),
        accountName=F.col("customerName"),
        totalPrice=F.col("amountReturn") - F.col("discount"),
        totalPay=F.lit(0),
        totalPayIQD=F.lit(0),
        transactionType=F.lit(S.REPAYMENT),
    )


def post_customer_repayment_box(t, note: str = "") -> DataFrame:
    """Dollars and IQD a customer handed in; rows of the same kind as above."""
    names = t.customers.select("customerID", "customerName")
    iqd_part = in_dollars(F.col("amountReturnIQD"), F.col("dollarPrice"))
    return _posted(
        t.return_debt_customer.join(names, "customerID", "left"),
        BOX,
        sourceID=F.col("rdcID"),
        amount=F.col("amountReturn") - iqd_part,
        amountIQD=F.col("amountReturnIQD"),
        type=F.lit(S.REPAY_CUSTOMER),
        note=F.trim(F.concat_ws(" ", F.lit(note), F.col("customerName"))),
    )


def post_repayment_account(t) -> DataFrame:
    """Repayments to suppliers as party rows.

    ``amountReturn`` is stored with the second currency added and the discount taken off.
    """
    names = t.suppliers.select("supplierID", "supplierName")
    return _posted(
        t.return_debt.join(names, "supplierID", "left"),
        PARTY,
        sourceID=F.col("rdID"),
        sourceType=F.lit(S.REPAY_SUPPLIER),
        accountID=F.col("supplierID"),
        accountType=F.lit(S.SUPPLIER),
        accountName=F.col("supplierName"),
        totalPrice=-F.col("amountReturn"),
        totalPay=F.lit(0),
        totalPayIQD=F.lit(0),
        transactionType=F.lit(S.REPAYMENT),
    )


def post_repayment_box(t, note: str = "") -> DataFrame:
    """Dollars and IQD handed to a supplier, out of the box.

    The stored amount is net of discount and includes the IQD part; the dollars
    handed over are won back from it.
    """
    names = t.suppliers.select("supplierID", "supplierName")
    iqd_part = in_dollars(F.col("amountReturnIQD"), F.col("dollarPrice"))
    return _posted(
        t.return_debt.join(names, "supplierID", "left"),
        BOX,
        sourceID=F.col("rdID"),
        amount=-(F.col("amountReturn") + F.col("discount") - iqd_part),
        amountIQD=-F.col("amountReturnIQD"),
        type=F.lit(S.REPAY_SUPPLIER),
        note=F.trim(F.concat_ws(" ", F.lit(note), F.col("supplierName"))),
    )


def purchases_after_repayment(t) -> DataFrame:
    """Purchases with ``debtStatus`` set where a repayment lists them."""
    listed = explode_ids(t.return_debt, "purchaseNumbers", "purchaseID").select("purchaseID").distinct()
    listed = listed.withColumn("_paid", F.lit(S.YES))
    return (
        t.purchases.join(listed, "purchaseID", "left")
        .withColumn("debtStatus", F.coalesce("_paid", "debtStatus"))
        .drop("_paid")
    )


def post_expense(t) -> DataFrame:
    """Expenses leave the box of their shelf in both currencies."""
    return _posted(
        t.expenses,
        BOX,
        sourceID=F.col("expenseID"),
        amount=-F.col("priceExpenseUSD"),
        amountIQD=-F.col("priceExpenseIQD"),
        type=F.lit(S.EXPENSE),
        note=F.coalesce(F.col("note"), F.lit(EXPENSE_NOTE)),
        userID=F.col("userIDCreated"),
    )


def post_cash(t) -> DataFrame:
    """Manual cash entries: money in as given, an exchange as given, anything else out."""
    as_given = F.col("type").isin(S.CASH_IN, S.EXCHANGE)
    return _posted(
        t.cash_entries,
        {"btID": "bigint", **BOX},
        amount=_turned(~as_given, F.col("amount")),
        amountIQD=_turned(~as_given, F.col("amountIQD")),
    )


def stock_ledger(t) -> DataFrame:
    """The whole stock ledger, rebuilt from documents."""
    return post_sales_stock(t).unionByName(post_purchase_stock(t)).unionByName(post_disposal(t))


def party_ledger(t) -> DataFrame:
    """The whole party ledger, rebuilt from documents."""
    return (
        post_sales_account(t)
        .unionByName(post_purchase_account(t))
        .unionByName(post_opening(t))
        .unionByName(post_repayment_account(t))
    )


def box_ledger(t) -> DataFrame:
    """The whole cash ledger, rebuilt from documents."""
    manual = post_cash(t).drop("btID")
    return (
        post_sales_box(t)
        .unionByName(post_purchase_box(t))
        .unionByName(post_repayment_box(t))
        .unionByName(post_expense(t))
        .unionByName(manual)
    )


def sales_by_shelf(t) -> DataFrame:
    """Value of closed invoices per shelf, signed as the cash is: in for sales, out for returns.

    Lines are summed per invoice and shelf before they meet the invoices.
    """
    lines = t.invoice_item.groupBy("invoiceID", "shelfID").agg(
        F.sum(F.col("qty") * F.col("productPrice")).alias("value")
    )
    heads = _sold(t).select("invoiceID", "stockType")
    return lines.join(heads, "invoiceID").select(
        "shelfID",
        F.col("invoiceID").alias("sourceID"),
        _turned(F.col("stockType") != S.SALE, F.col("value")).cast(S.TOTAL).alias("amount"),
        F.col("stockType").alias("type"),
    )


def mirror_partners(t) -> DataFrame:
    """Customers who also supply, as supplier rows to add; names already known are left out."""
    known = t.suppliers.select(name_key(F.col("supplierName")).alias("_name"))
    return (
        t.customers.filter(F.col("doesSupplier") == S.YES)
        .withColumn("_name", name_key(F.col("customerName")))
        .join(known, "_name", "left_anti")
        .select(
            F.col("customerName").alias("supplierName"),
            F.col("phoneNumber").alias("phone"),
            "address",
            "userID",
        )
    )


def latest_purchase_price(t) -> DataFrame:
    """Items with the cost of their newest purchase line; others keep theirs.

    Newest by creation time, then by line id.
    """
    heads = t.purchases.filter(F.col("stockType") == S.PURCHASE).select("purchaseID", "createAt")
    newest = (
        t.purchase_items.join(heads, "purchaseID")
        .groupBy("itemID")
        .agg(F.max_by("costPrice", F.struct("createAt", "pItemID")).alias("_cost"))
    )
    return (
        t.items.join(newest, "itemID", "left")
        .select(
            "itemID",
            "itemCode",
            F.coalesce("_cost", "costPrice").cast(S.MONEY).alias("costPrice"),
            "itemPriceRetail",
        )
    )
