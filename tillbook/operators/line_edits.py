"""Edited lines of documents, carried into every ledger as signed differences.

An edit takes back what a line said and says it anew: a row of weight -1 with the old values and one of weight 1
with the new ones. Whatever is a sum over lines, stock, a document's total, a party's account, follows by adding
these rows up, so the work grows with the lines touched and not with the ledger. Old rows
are the stored lines; new ones come from folding the events upon them, and what
does not change cancels out.

Events have the document's key, ``itemID``, ``seq``, ``kind``, ``qty``, ``price``, ``cost``, see
``changes.apply_line_events``; all are later than the stored lines, of which there is one per item. Sales and
purchases differ in their keys, the price a total is made of, and the signs. A document that loses
its last line is gone, and so are its rows.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.functions.shared import stored
from tillbook.functions.spread import HOT_FLOOR
from tillbook.operators import posting
from tillbook.operators.changes import ADD, apply_line_events
from tillbook.sources.ledgers import DayLedger


@dataclass(frozen=True)
class Side:
    """Sales or purchases.

    ``price`` is what a line's total is made of; ``stock`` and ``account`` post a set of tables.
    """

    heads: str
    lines: str
    key: str
    price: str
    stock: Callable[..., DataFrame]
    account: Callable[..., DataFrame]


SALES = Side(
    "invoices", "invoice_item", "invoiceID", "productPrice",
    posting.post_sales_stock, posting.post_sales_account,
)
PURCHASES = Side(
    "purchases", "purchase_items", "purchaseID", "costAfterDisc",
    posting.post_purchase_stock, posting.post_purchase_account,
)

WEIGHT = "weight"


def touched_lines(t, side: Side, events: DataFrame) -> DataFrame:
    """Stored lines that some event touches."""
    return getattr(t, side.lines).join(
        events.select(side.key, "itemID").distinct(), [side.key, "itemID"], "left_semi"
    )


def edited_lines(
    t, side: Side, events: DataFrame, floor: int = HOT_FLOOR, old: DataFrame | None = None
) -> DataFrame:
    """The touched lines after the events, with the columns of their table; ``old`` are these lines if at hand.

    Columns that no event sets stay as they were, and are NULL on a new line.
    The stored line is the event before all others. A purchase line's discount is of a unit and stays,
    so its cost after discount follows its cost.
    """
    old = touched_lines(t, side, events) if old is None else old
    price = "productPrice" if side is SALES else "costPrice"
    before = old.select(
        F.col(side.key).alias("invoiceID"), "itemID", F.lit(-(2**63)).alias("seq"), F.lit(ADD).alias("kind"),
        F.col("qty").cast("int").alias("qty"), F.col(price).alias("price"), F.col("costPrice").alias("cost"),
    )
    named = events.select(F.col(side.key).alias("invoiceID"), *before.columns[1:])
    after = apply_line_events(before.unionByName(named), floor).withColumnsRenamed(
        {"invoiceID": side.key, "qty": "_qty", "productPrice": "_price", "costPrice": "_cost"}
    )
    kept = old.select(*[c for c in old.columns if c not in ("qty", "productPrice", "costPrice", "costAfterDisc")])
    new = {"qty": F.col("_qty").cast("int"), "costPrice": F.col("_cost")}
    if side is SALES:
        new["productPrice"] = F.col("_price")
    else:
        new["discount"] = F.coalesce("discount", F.lit(0))
        new["costAfterDisc"] = F.col("_cost") - new["discount"]
    joined = after.join(kept, [side.key, "itemID"], "left")
    return joined.select(
        *[new.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in old.schema]
    )


def line_deltas(t, side: Side, events: DataFrame, floor: int = HOT_FLOOR) -> DataFrame:
    """Lines taken back, of ``weight`` -1, and lines put in their place, of ``weight`` 1.

    Every later step reads these rows, some more than once, and so do the steps of the folding read the events and the
    stored lines: all three are written once to the shared folder, when this is called.
    """
    events = stored(events.select(side.key, "itemID", "seq", "kind", "qty", "price", "cost"))
    old = stored(touched_lines(t, side, events))
    new = stored(edited_lines(t, side, events, floor, old))
    return old.withColumn(WEIGHT, F.lit(-1)).unionByName(new.withColumn(WEIGHT, F.lit(1)))


def total_deltas(t, side: Side, deltas: DataFrame) -> DataFrame:
    """What the total and the number of lines of each touched document change by; ``gone`` if none is left.

    Written once to the shared folder, as heads and accounts read it more than once.
    """
    change = deltas.groupBy(side.key).agg(
        F.sum(F.col(WEIGHT) * F.col("qty") * F.col(side.price)).cast(S.TOTAL).alias("totalChange"),
        F.sum(WEIGHT).alias("lineChange"),
    )
    had = (
        getattr(t, side.lines)
        .join(change.select(side.key), side.key, "left_semi")
        .groupBy(side.key)
        .agg(F.count(F.lit(1)).alias("_had"))
    )
    return stored(
        change.join(had, side.key, "left").select(
            side.key,
            "totalChange",
            "lineChange",
            (F.coalesce("_had", F.lit(0)) + F.col("lineChange") <= 0).alias("gone"),
        )
    )


def heads_after(t, side: Side, totals: DataFrame) -> DataFrame:
    """All documents with their new totals; those without lines are gone."""
    heads = getattr(t, side.heads)
    rows = heads.join(totals, side.key, "left").filter(~F.coalesce("gone", F.lit(False)))
    total = F.col("totalPrice") + F.coalesce("totalChange", F.lit(0))
    return rows.withColumn("totalPrice", total.cast(S.MONEY)).select(*heads.columns)


def stock_deltas(t, side: Side, deltas: DataFrame) -> DataFrame:
    """Stock rows to add, with ``weight``: taken back rows have their quantity turned round.

    Rows of a line that is as it was cancel out, and so do a document's that is not posted.
    """
    columns = getattr(t, side.lines).columns

    def posted(weight: int) -> DataFrame:
        lines = deltas.filter(F.col(WEIGHT) == weight).select(*columns)
        rows = side.stock(t.replaced(**{side.lines: lines}))
        return rows.withColumn("qty", F.col("qty") * weight).withColumn(WEIGHT, F.lit(weight))

    return summed_up(posted(-1).unionByName(posted(1)), "qty", "int")


def account_deltas(t, side: Side, totals: DataFrame) -> DataFrame:
    """Party rows to add, with ``weight``: the change of a total, or all of a document that is gone.

    What was paid changes only when its document goes.
    """
    stays = totals.select(side.key, "totalChange", "gone")
    touched = getattr(t, side.heads).join(stays, side.key)
    columns = getattr(t, side.heads).columns
    nothing = F.lit(0)
    changed = (
        touched.filter(~F.col("gone"))
        .withColumn("totalPrice", F.col("totalChange").cast(S.MONEY))
        .select(*columns)
    )
    rows = side.account(t.replaced(**{side.heads: changed}))
    changes = rows.withColumn("totalPay", nothing.cast(S.CONVERTED)).withColumn(
        "totalPayIQD", nothing.cast(S.IQD)
    )
    gone = side.account(t.replaced(**{side.heads: touched.filter("gone").select(*columns)}))
    back = gone.withColumns({c: (-F.col(c)).cast(gone.schema[c].dataType) for c in ("totalPrice", "totalPay", "totalPayIQD")})
    return changes.withColumn(WEIGHT, F.lit(0)).unionByName(back.withColumn(WEIGHT, F.lit(-1)))


def summed_up(rows: DataFrame, value: str, kind: str) -> DataFrame:
    """Rows alike in all else as one row, with the sums of ``value`` and ``weight``.

    A row whose both sums are 0 says nothing and is left out.
    """
    rest = [c for c in rows.columns if c not in (value, WEIGHT)]
    sums = rows.groupBy(*rest).agg(
        F.sum(value).cast(kind).alias(value), F.sum(WEIGHT).cast("int").alias(WEIGHT)
    )
    return sums.filter((F.col(value) != 0) | (F.col(WEIGHT) != 0)).select(*rows.columns)


def stock_after(ledger: DataFrame, deltas: DataFrame) -> DataFrame:
    """A stock ledger with rows of differences worked in: one row for rows alike in all but the quantity.

    Rows of the ledger have the weight 1 unless they carry one.
    """
    weight = F.col(WEIGHT) if WEIGHT in ledger.columns else F.lit(1)
    return summed_up(
        ledger.select(*[c for c in deltas.columns if c != WEIGHT], weight.alias(WEIGHT)).unionByName(deltas),
        "qty", "int",
    )


AMOUNTS = {"totalPrice": S.MONEY, "totalPay": S.CONVERTED, "totalPayIQD": S.IQD}


def accounts_after(ledger: DataFrame, deltas: DataFrame) -> DataFrame:
    """A party ledger with rows of differences worked in: one row for each document and account."""
    weight = F.col(WEIGHT) if WEIGHT in ledger.columns else F.lit(1)
    rest = [c for c in deltas.columns if c not in (*AMOUNTS, WEIGHT)]
    rows = ledger.select(*[c for c in deltas.columns if c != WEIGHT], weight.alias(WEIGHT)).unionByName(deltas)
    sums = rows.groupBy(*rest).agg(
        *[F.sum(c).cast(kind).alias(c) for c, kind in AMOUNTS.items()], F.sum(WEIGHT).cast("int").alias(WEIGHT)
    )
    return sums.filter(F.col(WEIGHT) > 0).select(*deltas.columns)


def edit_days(
    t, side: Side, events: DataFrame, stock: DayLedger, accounts: DayLedger, floor: int = HOT_FLOOR
) -> None:
    """Works line events into stored ledgers; only the days of touched documents are read and written."""
    deltas = line_deltas(t, side, events, floor)
    totals = total_deltas(t, side, deltas)
    for ledger, rows, after in (
        (stock, stock_deltas(t, side, deltas), stock_after),
        (accounts, account_deltas(t, side, totals), accounts_after),
    ):
        days = [r["day"] for r in rows.select(F.to_date(ledger.day_of).alias("day")).distinct().collect()]
        if days:
            ledger.replace(days, after(ledger.of(days).drop("day"), rows).drop(WEIGHT))
