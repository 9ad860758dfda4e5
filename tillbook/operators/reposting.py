"""Ledgers after changed documents, for every kind of document and every ledger it is posted to.

Documents that a log touches are folded and posted again; their old rows go. ``reposted`` gives the
whole ledger so, for one that is not stored. In a ledger stored by day, ``repost_days`` reads and
writes only the days on which a version of a touched document lies or lay: the log names them all,
since a ledger row is of its document's time.
"""

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.functions.shared import stored
from tillbook.operators import posting
from tillbook.operators.changes import INSERT, apply_changes
from tillbook.sources.ledgers import DayLedger

SALES = (S.SALE, S.SALE_RETURN)
PURCHASES = (S.PURCHASE, S.PURCHASE_RETURN)


@dataclass(frozen=True)
class Kind:
    """A kind of document and one ledger it is posted to.

    ``types`` are the codes its rows may have in ``type_column``; an edit may move a document from one to
    another. Rows of a kind without types are known by ``row_key`` alone. A kind that only
    ``corrects`` is posted again where the ledger has rows of the document, and nowhere else.
    """

    table: str
    key: str
    post: Callable[..., DataFrame]
    ledger: str
    types: tuple[str, ...]
    type_column: str = "sourceType"
    row_key: str = "sourceID"
    corrects: bool = False


KINDS = {
    "invoice_stock": Kind("invoices", "invoiceID", posting.post_sales_stock, "stock", SALES),
    "invoice_account": Kind("invoices", "invoiceID", posting.post_sales_account, "party", SALES),
    "invoice_cash": Kind("invoices", "invoiceID", posting.post_sales_box, "cash", SALES, "type"),
    "purchase_stock": Kind("purchases", "purchaseID", posting.post_purchase_stock, "stock", PURCHASES),
    "purchase_account": Kind("purchases", "purchaseID", posting.post_purchase_account, "party", PURCHASES),
    "purchase_cash": Kind("purchases", "purchaseID", posting.post_purchase_box, "cash", PURCHASES, "type"),
    "disposal_stock": Kind("disposals", "disposalID", posting.post_disposal, "stock", (S.DISPOSAL,)),
    "supplier_repayment_account": Kind(
        "return_debt", "rdID", posting.post_repayment_account, "party", (S.REPAY_SUPPLIER,)
    ),
    "supplier_repayment_cash": Kind(
        "return_debt", "rdID", posting.post_repayment_box, "cash", (S.REPAY_SUPPLIER,), "type"
    ),
    "customer_repayment_account": Kind(
        "return_debt_customer", "rdcID", posting.post_customer_repayment_account, "party",
        (S.REPAY_CUSTOMER,), corrects=True,
    ),
    "customer_repayment_cash": Kind(
        "return_debt_customer", "rdcID", posting.post_customer_repayment_box, "cash",
        (S.REPAY_CUSTOMER,), "type", corrects=True,
    ),
    "expense_cash": Kind("expenses", "expenseID", posting.post_expense, "cash", (S.EXPENSE,), "type"),
    "manual_cash": Kind("cash_entries", "btID", posting.post_cash, "manual", (), "type", "btID"),
    "customer_opening": Kind(
        "customers", "customerID", posting.post_customer_opening, "party", (S.OPENING_CUSTOMER,)
    ),
    "supplier_opening": Kind(
        "suppliers", "supplierID", posting.post_supplier_opening, "party", (S.OPENING_SUPPLIER,)
    ),
}


def touched(log: DataFrame, key: str, since: int | None) -> DataFrame:
    """Keys of documents to post again.

    ``since`` is the last ``seq`` the ledger knows; without it the ledger knows all inserts and no
    other change.
    """
    unknown = F.col("op") != INSERT if since is None else F.col("seq") > since
    return log.filter(unknown & F.col(key).isNotNull()).select(key).distinct()


def posted_again(t, log: DataFrame, kind: Kind, changed: DataFrame) -> DataFrame:
    """Ledger rows of the touched documents as they are now; a deleted one has none.

    They are folded from all their entries of the log.
    """
    columns = [c for c in getattr(t, kind.table).columns if c != kind.key]
    current = apply_changes(log.join(changed, kind.key, "left_semi"), kind.key, columns)
    return kind.post(t.replaced(**{kind.table: current}))


def rows_of(ledger: DataFrame, kind: Kind, changed: DataFrame, how: str) -> DataFrame:
    """Ledger rows of the touched documents, under any type they may have had, or all others."""
    gone = changed.select(F.col(kind.key).alias(kind.row_key))
    keys = [kind.row_key]
    if kind.types:
        codes = F.explode(F.array(*[F.lit(code) for code in kind.types]))
        gone, keys = gone.withColumn(kind.type_column, codes), [*keys, kind.type_column]
    return ledger.join(gone, keys, how)


def renewed(ledger: DataFrame, kind: Kind, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Ledger rows with those of the touched documents exchanged for fresh ones."""
    if kind.corrects:
        old = rows_of(ledger, kind, changed, "left_semi").select(kind.row_key).distinct()
        fresh = fresh.join(old, kind.row_key, "left_semi")
    kept = rows_of(ledger, kind, changed, "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def reposted(
    t, log: DataFrame, kind: Kind, ledger: DataFrame, since: int | None = None
) -> DataFrame:
    """A whole ledger after a log of changes to one kind of document."""
    changed = touched(log, kind.key, since)
    return renewed(ledger, kind, changed, posted_again(t, log, kind, changed))


def days_of(log: DataFrame, key: str, changed: DataFrame, day_of: str) -> DataFrame:
    """Days of all versions of the touched documents, NULL for versions without time.

    A patch that leaves the time as it is says nothing, and neither does a deletion.
    """
    says = F.col(day_of).isNotNull() | F.col("op").isin(INSERT, "update")
    return log.filter(says).join(changed, key, "left_semi").select(F.to_date(day_of).alias("day")).distinct()


def repost_days(
    t, log: DataFrame, kind: Kind, ledger: DayLedger, since: int | None = None
) -> list[dt.date | None]:
    """Replaces the days of a stored ledger that a log touches; gives these days.

    What is read of the ledger, and written, are these days alone. Only their list comes to the driver.
    """
    changed = stored(touched(log, kind.key, since))
    fresh = stored(posted_again(t, log, kind, changed))
    days = days_of(log, kind.key, changed, ledger.day_of).union(
        fresh.select(F.to_date(ledger.day_of).alias("day"))
    )
    listed = [r["day"] for r in days.distinct().collect()]
    if listed:
        ledger.replace(listed, renewed(ledger.of(listed), kind, changed, fresh))
    return listed
