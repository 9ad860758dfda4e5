"""Change logs: entity rows, invoice lines, and ledgers after edits.

Every log carries ``seq``, a bigint that grows with time; within a key the higher
one is the later change.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.functions.names import explode_ids, id_array, without_id
from tillbook.functions.spread import HOT_FLOOR, hot_keys, spread_join
from tillbook.operators import posting

INSERT, UPDATE, PATCH, DELETE = "insert", "update", "patch", "delete"

# Kinds of line events.
ADD, INC, DEC, SET_QTY, SET_PRICE, SET_COST, DROP = (
    "add", "inc", "dec", "qty", "price", "cost", "delete",
)


def apply_changes(
    log: DataFrame, key: str, columns: Sequence[str], full: Sequence[str] | None = None
) -> DataFrame:
    """Entity rows after a log of inserts, updates, patches and deletes.

    An insert sets all columns, an update those in ``full`` (all by default) and
    a patch those that are not NULL. A deleted key is gone unless inserted again;
    changes to a missing key have no effect. One aggregation, no sort: each column
    takes the value of the last change that touched it.
    """
    full = columns if full is None else full
    op, seq = F.col("op"), F.col("seq")
    alive = F.max(F.when(op == INSERT, seq)) > F.coalesce(
        F.max(F.when(op == DELETE, seq)), F.lit(-(2**63) + 1)
    )
    values = []
    for name in columns:
        whole = (op == INSERT) | ((op == UPDATE) if name in full else F.lit(False))
        partial = op.isin(PATCH, UPDATE) & F.col(name).isNotNull()
        values.append(F.max_by(F.col(name), F.when(whole | partial, seq)).alias(name))
    return (
        log.groupBy(key).agg(alive.alias("_alive"), *values).filter("_alive").drop("_alive")
    )


# Columns of an item that an update sets; its image and its deletion are changes of their own.
ITEM_UPDATE = (
    "itemCode", "itemName", "categoryID", "brandID", "shelfID", "unitID", "perUnit", "costPrice",
    "itemPriceRetail", "itemPriceWhole", "stockAlert", "hideInStock", "showButton", "note",
)


def item_changes(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Items after a log of inserts, updates, patches (new prices, say) and deletions.

    A deleted item keeps its row, with ``deleteStatus`` 0, as documents go on naming it; a later insert, or a patch of
    ``deleteStatus``, brings it back. A pack holds one unit at least. Where an update leaves out whether the item
    is hidden in stock or has a button, it is shown and has none.
    """
    gone = F.col("op") == DELETE
    update = F.col("op") == UPDATE
    kept = {
        "op": F.when(gone, PATCH).otherwise(F.col("op")),
        "perUnit": F.when(update | (F.col("op") == INSERT) | F.col("perUnit").isNotNull(), F.greatest("perUnit", F.lit(1))),
        "hideInStock": F.when(update, F.coalesce("hideInStock", F.lit(S.YES))).otherwise(F.col("hideInStock")),
        "showButton": F.when(update, F.coalesce("showButton", F.lit(S.NO))).otherwise(F.col("showButton")),
        "deleteStatus": F.when(gone, S.NO).otherwise(F.col("deleteStatus")),
    }
    # What a deletion carries besides its status changes nothing.
    rest = {c: F.when(~gone, F.coalesce(kept[c], F.col(c)) if c in kept else F.col(c)) for c in columns if c != "deleteStatus"}
    plain = log.withColumns({**rest, "op": kept["op"], "deleteStatus": kept["deleteStatus"]})
    return apply_changes(plain, "itemID", columns, full=ITEM_UPDATE)


def close_invoices(t, closings: DataFrame) -> DataFrame:
    """Invoices after some were closed, with the columns of ``t.invoices``.

    ``closings`` name what a closing sets: customer, total, payments, discount, type, and who closed it. Without
    customer it is the walk-in's, without amounts they are 0, without type it is a cash sale. A cash invoice is settled, and
    so is one that is paid in full; any other is open. The last closing of an invoice, by ``seq``, counts.
    """
    sets = {
        "customerID": F.lit(S.WALK_IN), "totalPrice": F.lit(0), "initialPay": F.lit(0), "totalPayIQD": F.lit(0),
        "discount": F.lit(0), "stockType": F.lit(S.SALE), "invoiceType": F.lit(S.CASH), "userIDUpdate": F.lit(None),
    }
    last = closings.groupBy("invoiceID").agg(
        F.max_by(F.struct(*sets, "totalPay"), "seq").alias("_closing")
    )
    rows = t.invoices.join(last, "invoiceID", "left")
    closed = F.col("_closing").isNotNull()
    said = {c: F.coalesce(F.col(f"_closing.{c}"), default) for c, default in sets.items()}
    cash = said["invoiceType"] == S.CASH
    paid = F.coalesce(F.col("_closing.totalPay"), F.lit(0)) == said["totalPrice"]
    now = {
        **said,
        "sellStatus": F.lit(S.YES),
        "wasl": F.when(cash | paid, S.YES).otherwise(S.NO),
    }
    return rows.select(
        *[
            (F.when(closed, now[f.name]).otherwise(F.col(f.name)) if f.name in now else F.col(f.name))
            .cast(f.dataType)
            .alias(f.name)
            for f in t.invoices.schema
        ]
    )


def merge_invoice_lines(t, adds: DataFrame) -> DataFrame:
    """Scanned items (invoiceID, itemID, seq, whole) merged to one line per item.

    A whole sale adds a full pack, anything else one unit; the price is that of
    the first scan.
    """
    items = t.items.select(
        "itemID", "perUnit", "itemPriceRetail", "itemPriceWhole", "costPrice", "unitID"
    )
    whole = F.col("whole") == S.YES
    merged = adds.groupBy("invoiceID", "itemID").agg(
        F.sum(F.when(whole, 1).otherwise(0)).alias("_packs"),
        F.sum(F.when(whole, 0).otherwise(1)).alias("_single"),
        F.min_by(whole, F.col("seq")).alias("_whole"),
    )
    return merged.join(items, "itemID").select(
        "invoiceID",
        "itemID",
        (F.col("_packs") * F.col("perUnit") + F.col("_single")).cast("bigint").alias("qty"),
        F.when(F.col("_whole"), F.col("itemPriceWhole"))
        .otherwise(F.col("itemPriceRetail"))
        .alias("productPrice"),
        "costPrice",
        "unitID",
    )


LINE = ["invoiceID", "itemID"]


def apply_line_events(events: DataFrame, floor: int = HOT_FLOOR) -> DataFrame:
    """Lines after events (invoiceID, itemID, seq, kind, qty, price, cost).

    ``add`` opens a line or adds to it, ``inc`` and ``dec`` change its quantity by
    one, ``qty``, ``price`` and ``cost`` set a value, ``delete`` removes the line.
    Events on a line that does not exist do nothing. A set quantity overrides all
    before it and later steps count on from it.

    What one aggregation over the events finds per line the next one needs. As long as no line has very many
    events these are windows over one shuffle; otherwise they are joined, which splits such lines.
    """
    kind, seq = F.col("kind"), F.col("seq")
    hot = hot_keys(events, LINE, floor)
    if hot is None:
        live = _live_windowed(events)
    else:
        dropped = events.filter(kind == DROP).groupBy(*LINE).agg(F.max("seq").alias("_dropped"))
        live = _after_drop(spread_join(events.filter(kind != DROP), dropped, LINE, seq, hot, "left"))

    def last_set(what: str, column: str) -> dict:
        when = F.when(kind == what, seq)
        return {f"_{what}_at": F.max(when), f"_{what}": F.max_by(column, when)}

    opening = F.when(kind == ADD, seq)
    found = {
        "_born": F.min(opening),
        "_price_0": F.min_by("price", opening),
        "_cost_0": F.min_by("cost", opening),
        **last_set(SET_QTY, "qty"),
        **last_set(SET_PRICE, "price"),
        **last_set(SET_COST, "cost"),
    }

    def valid(what: str):
        return F.col(f"_{what}_at") > F.col("_born")

    anchors = {
        "productPrice": F.when(valid(SET_PRICE), F.col("_price")).otherwise(F.col("_price_0")),
        "costPrice": F.when(valid(SET_COST), F.col("_cost")).otherwise(F.col("_cost_0")),
        "_base": F.when(valid(SET_QTY), F.col("_qty")).otherwise(0),
        "_from": F.when(valid(SET_QTY), F.col("_qty_at") + 1).otherwise(F.col("_born")),
    }
    named = [column.alias(name) for name, column in anchors.items()]
    born = F.col("_born").isNotNull()
    step = F.when(kind == ADD, F.col("qty")).when(kind == INC, 1).otherwise(-1).alias("_step")
    steps = kind.isin(ADD, INC, DEC)
    if hot is None:
        whole = Window.partitionBy(*LINE)
        said = live.select("*", *[column.over(whole).alias(name) for name, column in found.items()])
        rows = said.filter(steps & born).select(*LINE, "seq", step, *named)
    else:
        once = live.groupBy(*LINE).agg(*[column.alias(name) for name, column in found.items()]).filter(born)
        rows = spread_join(live.filter(steps).select(*LINE, "seq", step), once.select(*LINE, *named), LINE, seq, hot)
    return (
        rows.groupBy(*LINE, "productPrice", "costPrice", "_base")
        .agg(F.sum(F.when(seq >= F.col("_from"), F.col("_step")).otherwise(0)).alias("_steps"))
        .select(
            *LINE,
            (F.col("_base") + F.col("_steps")).cast("bigint").alias("qty"),
            "productPrice",
            "costPrice",
        )
    )


def _after_drop(events: DataFrame) -> DataFrame:
    """Events after the last deletion of their line, ``_dropped``."""
    return events.filter(F.col("_dropped").isNull() | (F.col("seq") > F.col("_dropped"))).drop("_dropped")


def _live_windowed(events: DataFrame) -> DataFrame:
    """Events but deletions, after the last deletion of their line. A line without a key is none."""
    kind = F.col("kind")
    dropped = F.max(F.when(kind == DROP, F.col("seq"))).over(Window.partitionBy(*LINE))
    keyed = events.dropna(subset=LINE).withColumn("_dropped", dropped)
    return _after_drop(keyed.filter(kind != DROP))


def document_totals(lines: DataFrame) -> DataFrame:
    """Total of each document after its lines changed; documents without lines are gone."""
    return lines.groupBy("invoiceID").agg(
        F.sum(F.col("qty") * F.col("productPrice")).cast(S.TOTAL).alias("totalPrice"),
        F.count(F.lit(1)).alias("noOfItem"),
    )


def repost(
    ledger: DataFrame, changed: DataFrame, fresh: DataFrame, type_column: str = "sourceType"
) -> DataFrame:
    """A ledger with all rows of changed documents replaced.

    ``changed`` holds distinct (sourceID, type); a deleted document simply has no
    fresh rows. The result has the columns of ``fresh``: a stored ledger's ``day`` is
    made anew when it is written.
    """
    keys = ["sourceID", type_column]
    kept = ledger.join(changed.select(*keys), keys, "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def repost_documents(
    t,
    log: DataFrame,
    table: str,
    key: str,
    post: Callable[..., DataFrame],
    ledger: DataFrame,
    types: Sequence[str],
    type_column: str = "sourceType",
    since: int | None = None,
) -> DataFrame:
    """A ledger after a log of changes to one kind of document.

    ``since`` is the last ``seq`` the ledger knows: documents with any later change, new
    ones included, are folded from the whole log and posted again. Without it the ledger
    knows all inserts of the log and none of the other changes. An edit may move a document
    to another type, so its old rows go under every type it may have had.
    """
    unknown = F.col("op") != INSERT if since is None else F.col("seq") > since
    changed = log.filter(unknown).select(key).distinct()
    columns = [c for c in getattr(t, table).columns if c != key]
    current = apply_changes(log.join(changed, key, "left_semi"), key, columns)
    removed = changed.select(
        F.col(key).alias("sourceID"),
        F.explode(F.array(*[F.lit(code) for code in types])).alias(type_column),
    )
    return repost(ledger, removed, post(t.replaced(**{table: current})), type_column)


SALES = (S.SALE, S.SALE_RETURN)


def repost_invoices(t, log: DataFrame, since: int | None = None) -> DataFrame:
    """The stock ledger after a log of invoice changes."""
    return repost_documents(
        t, log, "invoices", "invoiceID", posting.post_sales_stock, t.stock, SALES,
        since=since,
    )


def repost_invoice_accounts(t, log: DataFrame, since: int | None = None) -> DataFrame:
    """The party ledger after a log of invoice changes."""
    return repost_documents(
        t, log, "invoices", "invoiceID", posting.post_sales_account, t.transactions, SALES,
        since=since,
    )


def repost_invoice_cash(t, log: DataFrame, since: int | None = None) -> DataFrame:
    """The cash ledger after a log of invoice changes, returns included."""
    return repost_documents(
        t, log, "invoices", "invoiceID", posting.post_sales_box, posting.box_ledger(t), SALES, "type",
        since,
    )


def repost_expenses(t, log: DataFrame, since: int | None = None) -> DataFrame:
    """The cash ledger after a log of expense changes; a deleted expense gives its money back."""
    return repost_documents(
        t, log, "expenses", "expenseID", posting.post_expense, posting.box_ledger(t),
        (S.EXPENSE,), "type", since,
    )


def listed_invoices(t) -> DataFrame:
    """One row per invoice a repayment lists."""
    return explode_ids(t.return_debt_customer, "invoiceNumbers", "invoiceID").select(
        "rdcID", "customerID", "invoiceID"
    )


def unlist_invoice(t, gone) -> DataFrame:
    """Repayments with one id (a column or a number) taken out of their list."""
    column = gone if not isinstance(gone, int) else F.lit(gone)
    return t.return_debt_customer.select(
        "rdcID",
        without_id(F.col("invoiceNumbers"), column).alias("invoiceNumbers"),
        F.size(id_array(F.col("invoiceNumbers"))).alias("listedBefore"),
    )
