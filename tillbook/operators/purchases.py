"""Purchase reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.functions import ordered
from tillbook.functions.dates import Day, in_days, on_day
from tillbook.functions.documents import LINES_PER_PART, nested



def _supplied(t, purchases: DataFrame) -> DataFrame:
    return purchases.join(t.suppliers.select("supplierID", "supplierName"), "supplierID")


def _users(t, id_column: str) -> DataFrame:
    return t.users.select(F.col("userID").alias(id_column), F.col("userName").alias("user"), "fullName")


def purchases_on_day(t, day: Day) -> DataFrame:
    """Purchases of a day with supplier and the user who last changed them."""
    rows = t.purchases.filter((F.col("stockType") == S.PURCHASE) & on_day("createAt", day))
    return (
        _supplied(t, rows)
        .join(_users(t, "userIDUpdate"), "userIDUpdate")
        .select(
            "purchaseID", "supplierName", "referenceNo", "totalPrice", "amountPay", "discount",
            "PurchaseStatus", "paymentType", "user",
        )
    )


def purchase_register(t, first: Day, last: Day) -> DataFrame:
    """Purchases and returns of a period with supplier and the user who entered them."""
    rows = t.purchases.filter(in_days("createAt", first, last))
    return (
        _supplied(t, rows)
        .join(_users(t, "userIDCreated"), "userIDCreated")
        .select(
            "purchaseID", "supplierID", "supplierName", "referenceNo", "dollarPrice", "totalPrice",
            "amountPay", "amountPayIQD", "discount", "PurchaseStatus", "paymentType", "stockType",
            "note", "user", "fullName", "userIDCreated", "createAt",
        )
    )


def purchase_lines(t, purchase_id: int | None = None) -> DataFrame:
    """Purchase lines with item code and name, of one purchase or of all."""
    rows = t.purchase_items
    if purchase_id is not None:
        rows = rows.filter(F.col("purchaseID") == purchase_id)
    return rows.join(t.items.select("itemID", "itemCode", "itemName"), "itemID").select(
        "purchaseID", "pItemID", "itemID", "itemCode", "itemName", "costPrice", "qty", "discount",
        "costAfterDisc",
    )


def purchase_documents(
    t,
    purchase_id: int | None = None,
    first: Day | None = None,
    last: Day | None = None,
    lines_per_part: int = LINES_PER_PART,
) -> DataFrame:
    """Purchases with supplier, user and an array of lines, ``lines_per_part`` of them in a row."""
    heads = t.purchases
    lines = t.purchase_items
    if purchase_id is not None:
        heads = heads.filter(F.col("purchaseID") == purchase_id)
        lines = lines.filter(F.col("purchaseID") == purchase_id)
    if first is not None and last is not None:
        heads = heads.filter(in_days("createAt", first, last))
        lines = lines.join(heads.select("purchaseID"), "purchaseID", "left_semi")
    counted = lines.select("purchaseID")
    heads = (
        _supplied(t, heads)
        .join(_users(t, "userIDCreated"), "userIDCreated")
        .select(
            "purchaseID", "supplierID", "supplierName", "referenceNo", "dollarPrice", "totalPrice",
            "amountPay", "PurchaseStatus", "paymentType", "stockType", "note", "createAt", "fullName",
        )
    )
    lines = lines.join(t.items.select("itemID", "itemCode", "itemName"), "itemID").select(
        "purchaseID", "pItemID", "itemID", "itemCode", "itemName", "costPrice", "qty", "costAfterDisc"
    )
    return nested(heads, lines, "purchaseID", "pItemID", "purchaseItems", counted, lines_per_part)


PAGE = (
    "purchaseID", "supplierID", "supplierName", "referenceNo", "totalPrice", "paymentType",
    "PurchaseStatus", "userID", "userName", "nop",
)


def _paged(t, purchases: DataFrame) -> DataFrame:
    """Adds supplier, last user, and ``nop``, the number of all purchases."""
    count = t.purchases.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        _supplied(t, purchases)
        .join(t.users.select(F.col("userID"), "userName"), F.col("userIDUpdate") == F.col("userID"))
        .withColumn("nop", count)
    )


def purchase_page(t, page: int, size: int = 20) -> DataFrame:
    """A page of purchases, newest id first, numbered from 1.

    Blocks of ids are counted in parallel and only those the page lies in are ranked, so
    nothing is skipped through a single task, however deep the page.
    """
    known = t.users.select(F.col("userID").alias("userIDUpdate"))
    rows = _supplied(t, t.purchases).join(known, "userIDUpdate", "left_semi").select("purchaseID")
    skip = (page - 1) * size
    chosen = ordered.descending_slice(rows, "purchaseID", skip, size)
    return (
        _paged(t, t.purchases.join(chosen, "purchaseID", "left_semi"))
        .orderBy(F.desc("purchaseID"))
        .select(*PAGE)
    )


def purchase_by_reference(t, reference_no: str) -> DataFrame:
    """Purchases with a reference number, newest id first."""
    return (
        _paged(t, t.purchases.filter(F.col("referenceNo") == reference_no))
        .orderBy(F.desc("purchaseID"))
        .select(*PAGE)
    )


def purchase_total_recompute(t, only_changed: bool = False) -> DataFrame:
    """Stored total against the sum of the lines, per purchase."""
    sums = t.purchase_items.groupBy("purchaseID").agg(
        F.sum(F.col("qty") * F.col("costAfterDisc")).cast(S.TOTAL).alias("lineTotal")
    )
    rows = t.purchases.join(sums, "purchaseID", "left").select(
        "purchaseID",
        "totalPrice",
        "lineTotal",
        (~F.col("totalPrice").eqNullSafe(F.col("lineTotal"))).alias("differs"),
    )
    return rows.filter("differs") if only_changed else rows
