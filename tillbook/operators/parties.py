"""Customer and supplier accounts, debts, repayments and statements."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.functions.dates import Day, in_days, of_days
from tillbook.functions.money import due, to_dollars, total0
from tillbook.functions.names import name_key


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def customer_account(t, *extra: str) -> DataFrame:
    """What makes up a customer's debt.

    Our choice, as the shop's own view is not at hand: debt is the value of closed
    debt sales; ``totalPay`` is what was paid when they were made, not what
    repayments added later, since repayments are counted on their own; returns are
    closed sale returns.
    """
    closed = t.invoices.filter(F.col("sellStatus") == S.YES)
    debt = (F.col("stockType") == S.SALE) & (F.col("invoiceType") == S.DEBT)
    paid = to_dollars(F.col("initialPay"), F.col("totalPayIQD"), F.col("dollarPrice"))
    sums = closed.groupBy("customerID").agg(
        total0(F.when(debt, F.col("totalPrice"))).alias("totalInvoiceDebt"),
        F.coalesce(F.sum(F.when(debt, paid)), F.lit(0)).cast(S.CONVERTED).alias("totalPay"),
        total0(F.when(F.col("stockType") == S.SALE_RETURN, F.col("totalPrice"))).alias(
            "totalReturnInvoice"
        ),
    )
    return (
        t.customers.select("customerID", "customerName", "previousDebt", *extra)
        .join(sums, "customerID", "left")
        .select(
            "customerID",
            "customerName",
            "previousDebt",
            _or_zero("totalInvoiceDebt").cast(S.TOTAL).alias("totalInvoiceDebt"),
            _or_zero("totalPay").cast(S.CONVERTED).alias("totalPay"),
            _or_zero("totalReturnInvoice").cast(S.TOTAL).alias("totalReturnInvoice"),
            *extra,
        )
    )


def supplier_account(t, *extra: str) -> DataFrame:
    """What makes up the shop's debt to a supplier; the same choices as for customers."""
    debt = (F.col("stockType") == S.PURCHASE) & (F.col("paymentType") == S.DEBT)
    paid = to_dollars(F.col("amountPay"), F.col("amountPayIQD"), F.col("dollarPrice"))
    sums = t.purchases.groupBy("supplierID").agg(
        total0(F.when(debt, F.col("totalPrice"))).alias("totalPurchaseDebt"),
        F.coalesce(F.sum(F.when(debt, paid)), F.lit(0)).cast(S.CONVERTED).alias("totalPay"),
        total0(F.when(F.col("stockType") == S.PURCHASE_RETURN, F.col("totalPrice"))).alias(
            "totalReturnPurchase"
        ),
    )
    return (
        t.suppliers.select("supplierID", "supplierName", "previousBalance", *extra)
        .join(sums, "supplierID", "left")
        .select(
            "supplierID",
            "supplierName",
            "previousBalance",
            _or_zero("totalPurchaseDebt").cast(S.TOTAL).alias("totalPurchaseDebt"),
            _or_zero("totalPay").cast(S.CONVERTED).alias("totalPay"),
            _or_zero("totalReturnPurchase").cast(S.TOTAL).alias("totalReturnPurchase"),
            *extra,
        )
    )


def _customer_remains(t, *extra: str) -> DataFrame:
    """Customers with the parts and the rest of their debt, and further customer columns."""
    repaid = t.return_debt_customer.groupBy("customerID").agg(
        F.sum("amountReturn").cast(S.TOTAL).alias("totalReturnDebt")
    )
    remain = (
        F.col("previousDebt")
        + F.col("totalInvoiceDebt")
        - (F.col("totalReturnInvoice") + F.col("totalPay") + F.col("totalReturnDebt"))
    )
    return (
        customer_account(t, *extra)
        .join(repaid, "customerID", "left")
        .withColumn("totalReturnDebt", _or_zero("totalReturnDebt").cast(S.TOTAL))
        .withColumn("totalRemainCustomer", remain.cast(S.CONVERTED))
    )


def _supplier_remains(t, *extra: str) -> DataFrame:
    """Suppliers with the parts and the rest of the shop's debt, and further supplier columns."""
    repaid = t.return_debt.groupBy("supplierID").agg(
        F.sum("amountReturn").cast(S.TOTAL).alias("totalReturnDebt")
    )
    remain = (
        F.col("previousBalance")
        + F.col("totalPurchaseDebt")
        - (F.col("totalPay") + F.col("totalReturnPurchase") + F.col("totalReturnDebt"))
    )
    return (
        supplier_account(t, *extra)
        .join(repaid, "supplierID", "left")
        .withColumn("totalReturnDebt", _or_zero("totalReturnDebt").cast(S.TOTAL))
        .withColumn("totalRemainSupplier", remain.cast(S.CONVERTED))
    )


def customer_debt_list(t) -> DataFrame:
    """Every customer's account and remaining debt, largest first, without the walk-in."""
    known = F.col("customerID") != S.WALK_IN
    named = t.replaced(
        customers=t.customers.filter(known),
        invoices=t.invoices.filter(known),
        return_debt_customer=t.return_debt_customer.filter(known),
    )
    return (
        _customer_remains(named)
        .orderBy(F.desc("totalRemainCustomer"), "customerID")
        .select(
            "customerID", "customerName", "previousDebt", "totalInvoiceDebt", "totalPay",
            "totalReturnInvoice", "totalReturnDebt", "totalRemainCustomer",
        )
    )


def supplier_debt_list(t) -> DataFrame:
    """Remaining debt to every supplier, newest supplier first."""
    return (
        _supplier_remains(t)
        .orderBy(F.desc("supplierID"))
        .select("supplierID", "supplierName", "totalRemainSupplier")
    )


def _floored(mine: str, theirs: str) -> Column:
    """What is left of one debt after the other, never below zero; zero also for no debt at all."""
    left = F.col(mine) - F.coalesce(F.col(theirs), F.lit(0))
    return F.greatest(left, F.lit(0)).cast(S.CONVERTED)


def _by_name(remains: DataFrame, name: str, amount: str) -> DataFrame:
    """One row per partner name; a name is meant to be unique, and its rows are added if not."""
    return remains.groupBy(name_key(F.col(name)).alias("_name")).agg(
        F.sum(amount).cast(S.CONVERTED).alias(amount)
    )


def customer_netting(t, customer_id: int | None = None) -> DataFrame:
    """Customer debt less what the shop owes the supplier of the same name."""
    ours = _customer_remains(t)
    if customer_id is not None:
        ours = ours.filter(F.col("customerID") == customer_id)
    theirs = _by_name(_supplier_remains(t), "supplierName", "totalRemainSupplier")
    return (
        ours.withColumn("_name", name_key(F.col("customerName")))
        .join(theirs, "_name", "left")
        .orderBy("customerID")
        .select(
            "customerID",
            "customerName",
            "totalRemainCustomer",
            _or_zero("totalRemainSupplier").cast(S.CONVERTED).alias("totalRemainSupplier"),
            _floored("totalRemainCustomer", "totalRemainSupplier").alias("totalRemain"),
        )
    )


def supplier_netting(t) -> DataFrame:
    """Debt to a supplier less what the customer of the same name owes."""
    theirs = _by_name(_customer_remains(t), "customerName", "totalRemainCustomer")
    return (
        _supplier_remains(t)
        .withColumn("_name", name_key(F.col("supplierName")))
        .join(theirs, "_name", "left")
        .orderBy("supplierID")
        .select(
            "supplierID",
            "supplierName",
            "totalRemainSupplier",
            _or_zero("totalRemainCustomer").cast(S.CONVERTED).alias("totalRemainCustomer"),
            _floored("totalRemainSupplier", "totalRemainCustomer").alias("totalRemain"),
        )
    )


def customers_with_debt(t, active_only: bool = False) -> DataFrame:
    """Customer directory with a search label and the netted debt.

    A customer's own debt comes by id, only the supplier's by name.
    """
    rows = t.customers.filter(F.col("activeStatus") == S.YES) if active_only else t.customers
    extra = (
        "phoneNumber", "address", "limitDebt", "wholePrice", "doesSupplier", "createAt",
        "activeStatus", "userID",
    )
    theirs = _by_name(_supplier_remains(t), "supplierName", "totalRemainSupplier")
    return (
        _customer_remains(t.replaced(customers=rows), *extra)
        .join(t.users.select("userID", "userName"), "userID")
        .withColumn("_name", name_key(F.col("customerName")))
        .join(theirs, "_name", "left")
        .select(
            "customerID",
            "customerName",
            F.concat("customerID", F.lit("-"), "customerName").alias("concatNameAndCode"),
            "phoneNumber", "address", "previousDebt", "limitDebt", "wholePrice", "doesSupplier",
            "createAt", "activeStatus", "userName",
            _floored("totalRemainCustomer", "totalRemainSupplier").alias("totalRemain"),
        )
    )


def suppliers_with_debt(t) -> DataFrame:
    """Active suppliers with the netted debt."""
    rows = t.suppliers.filter(F.col("activeStatus") == S.YES)
    theirs = _by_name(_customer_remains(t), "customerName", "totalRemainCustomer")
    return (
        _supplier_remains(t.replaced(suppliers=rows), "phone", "address", "createAt", "activeStatus")
        .withColumn("_name", name_key(F.col("supplierName")))
        .join(theirs, "_name", "left")
        .select(
            "supplierID", "supplierName", "phone", "address", "previousBalance", "createAt",
            "activeStatus",
            _floored("totalRemainSupplier", "totalRemainCustomer").alias("totalRemain"),
        )
    )


def supplier_search(t, prefix: str) -> DataFrame:
    """Suppliers whose name starts with a text, whatever the case."""
    return t.suppliers.filter(F.lower("supplierName").startswith(prefix.lower())).select(
        "supplierID", "supplierName"
    )


def customer_repayments(
    t, first: Day, last: Day, same_user: bool = True, require_shelf: bool = False
) -> DataFrame:
    """Repayments by customers with names.

    By default only those taken by the user who also entered the customer, as the
    shop's own list does. Its list of the current day also needs a known shelf.
    """
    rows = t.return_debt_customer.filter(in_days("createAt", first, last))
    owners = t.customers.select("customerID", "customerName", F.col("userID").alias("_owner"))
    rows = rows.join(owners, "customerID")
    if same_user:
        rows = rows.filter(F.col("_owner") == F.col("userID"))
    return (
        rows.join(t.users.select("userID", "userName"), "userID")
        .join(t.shelfs, "shelfID", "inner" if require_shelf else "left")
        .select(
            "rdcID", "customerID", "customerName", "shelfID", "shelfName", "amountReturn",
            "amountReturnIQD", "discount", "dollarPrice", "invoiceNumbers", "createAt", "userName",
        )
    )


def supplier_repayments(t, first: Day, last: Day, same_user: bool = True) -> DataFrame:
    """Repayments to suppliers with names; the same rule about users."""
    rows = t.return_debt.filter(in_days("createAt", first, last))
    owners = t.suppliers.select("supplierID", "supplierName", F.col("userID").alias("_owner"))
    rows = rows.join(owners, "supplierID")
    if same_user:
        rows = rows.filter(F.col("_owner") == F.col("userID"))
    return rows.join(t.users.select("userID", "userName"), "userID").select(
        "rdID", "supplierID", "supplierName", "amountReturn", "amountReturnIQD", "referenceNO",
        "discount", "dollarPrice", "purchaseNumbers", "createAt", "userName",
    )


def unpaid_sales(t) -> DataFrame:
    """Sales not settled yet, closed or not, with what is due on them."""
    return (
        t.invoices.filter((F.col("wasl") == S.NO) & (F.col("stockType") == S.SALE))
        .select("invoiceID", "customerID", "createAt", "initialPay", "totalPay", "totalPrice")
        .withColumn("total", due())
    )


def open_debt_invoices(t, customer_id: int | None = None) -> DataFrame:
    """Unpaid sales of a customer, or of all, with the amount due, oldest first."""
    rows = unpaid_sales(t)
    if customer_id is not None:
        rows = rows.filter(F.col("customerID") == customer_id)
    return rows.select("invoiceID", "customerID", "createAt", "total").orderBy("createAt", "invoiceID")


def debt_of_invoices(t, ids: DataFrame) -> DataFrame:
    """Sum due over a list of invoices (a DataFrame with ``invoiceID``); NULL if none exists."""
    return (
        t.invoices.join(ids, "invoiceID", "left_semi")
        .withColumn("_due", due())
        .agg(F.sum("_due").cast(S.TOTAL).alias("total"))
    )


def open_debt_purchases(t, supplier_id: int | None = None) -> DataFrame:
    """Debt purchases not marked as paid."""
    rows = t.purchases.filter(
        (F.col("paymentType") == S.DEBT)
        & (F.col("debtStatus") == S.NO)
        & (F.col("stockType") == S.PURCHASE)
    )
    if supplier_id is not None:
        rows = rows.filter(F.col("supplierID") == supplier_id)
    return rows.select("supplierID", "purchaseID")


STATEMENT = (
    "sourceID", "sourceType", "accountName", "accountType", "totalPrice", "totalPay",
    "totalPayIQD", "transactionType", "createAt",
)


def account_statement(t, first: Day, last: Day, account_type: str) -> DataFrame:
    """Party ledger rows of customers or suppliers in a period, by time."""
    return (
        of_days(t.transactions, first, last).filter(F.col("accountType") == account_type)
        .select(*STATEMENT)
        .orderBy("createAt", "sourceType", "sourceID")
    )


def _partner_keys(t) -> DataFrame:
    """Names found among suppliers and among customers, with the number of such pairs."""
    suppliers = t.suppliers.groupBy(name_key(F.col("supplierName")).alias("_name")).agg(
        F.count(F.lit(1)).alias("_suppliers")
    )
    customers = t.customers.groupBy(name_key(F.col("customerName")).alias("_name")).agg(
        F.count(F.lit(1)).alias("_customers")
    )
    pairs = (F.col("_suppliers") * F.col("_customers")).cast("int")
    return suppliers.join(customers, "_name").select("_name", pairs.alias("_pairs"))


def partner_statement(t, first: Day, last: Day) -> DataFrame:
    """Party ledger rows of names that are both supplier and customer, by time.

    A row shows once per pair of supplier and customer sharing its name; the pairs
    are counted before they meet the ledger.
    """
    return (
        of_days(t.transactions, first, last)
        .withColumn("_name", name_key(F.col("accountName")))
        .join(_partner_keys(t), "_name")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_pairs"))))
        .select(*STATEMENT)
        .orderBy("createAt", "sourceType", "sourceID")
    )


def partner_statement_counted(t, first: Day, last: Day) -> DataFrame:
    """Party ledger rows of names that are both supplier and customer, each once.

    ``pairs`` is how many pairs of supplier and customer share the name, which is how often ``partner_statement``
    repeats the row; sums over a statement weigh rows by it, and no row is copied. A name that is held by very many
    partners so costs one row a ledger row, whatever the product of their numbers.
    """
    suppliers = t.suppliers.groupBy(name_key(F.col("supplierName")).alias("_name")).agg(
        F.count(F.lit(1)).alias("_suppliers")
    )
    customers = t.customers.groupBy(name_key(F.col("customerName")).alias("_name")).agg(
        F.count(F.lit(1)).alias("_customers")
    )
    pairs = suppliers.join(customers, "_name").select(
        "_name", (F.col("_suppliers") * F.col("_customers")).cast("bigint").alias("pairs")
    )
    return (
        of_days(t.transactions, first, last)
        .withColumn("_name", name_key(F.col("accountName")))
        .join(pairs, "_name")
        .select(*STATEMENT, "pairs")
    )


def partner_names(t) -> DataFrame:
    """Names that are both supplier and customer and have ledger rows."""
    return (
        t.transactions.select("accountName")
        .distinct()
        .withColumn("_name", name_key(F.col("accountName")))
        .join(_partner_keys(t), "_name", "left_semi")
        .select("accountName")
    )
