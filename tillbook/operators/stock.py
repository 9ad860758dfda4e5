"""Stock, item and discount reports."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.functions.dates import Day, in_days, of_days, on_day
from tillbook.functions.money import units0
from tillbook.operators.sales import one_row

MOVES = (
    ("purchased", S.PURCHASE, 1),
    ("returnPurchase", S.PURCHASE_RETURN, -1),
    ("sold", S.SALE, -1),
    ("returnSold", S.SALE_RETURN, 1),
    ("disposal", S.DISPOSAL, -1),
)


def _live(items: DataFrame) -> DataFrame:
    return items.filter(F.col("deleteStatus") == S.YES)


def _on_hand(t, *keys: str) -> DataFrame:
    return t.stock.groupBy(*keys).agg(F.sum("qty").cast("bigint").alias("totalInStock"))


def _by_move(t, *keys: str) -> DataFrame:
    """On hand and the five kinds of movement per key, in one pass."""
    moves = [
        (units0(F.when(F.col("sourceType") == code, F.col("qty"))) * sign).cast("bigint").alias(name)
        for name, code, sign in MOVES
    ]
    return t.stock.groupBy(*keys).agg(F.sum("qty").cast("bigint").alias("totalInStock"), *moves)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)


def in_stock(t) -> DataFrame:
    """On hand, purchased, returned, sold and disposed quantities of live, visible items."""
    items = _live(t.items).filter(F.col("hideInStock") == S.YES)
    return (
        items.select("itemID", "itemCode", "itemName", "unitID", "shelfID", "brandID", "categoryID")
        .join(_by_move(t, "itemID"), "itemID", "left")
        .join(t.units, "unitID", "left")
        .select(
            "itemID", "itemCode", "itemName", "unitID", "shelfID", "brandID", "categoryID",
            _zero("totalInStock"),
            *[_zero(name) for name, _, _ in MOVES],
            "unitName",
        )
    )


def lack_in_stock(t) -> DataFrame:
    """Live items at or below their alert quantity, by shelf."""
    return (
        _live(t.items)
        .select("itemID", "itemCode", "itemName", "shelfID", "stockAlert")
        .join(_on_hand(t, "itemID"), "itemID", "left")
        .withColumn("totalInStock", _zero("totalInStock"))
        .filter(F.col("totalInStock") <= F.col("stockAlert"))
        .orderBy(F.desc("shelfID"), "itemID")
        .select("itemID", "itemCode", "itemName", "shelfID", "totalInStock")
    )


def in_stock_detail(t, item_id: int | None = None) -> DataFrame:
    """Movements per item and expiry date, and the quantity on hand in packs."""
    ledger = t if item_id is None else t.replaced(stock=t.stock.filter(F.col("itemID") == item_id))
    packs = F.try_divide(F.col("totalInStock").cast("decimal(18,0)"), F.col("perUnit"))
    return (
        _by_move(ledger, "itemID", "expiryDate")
        .join(t.items.select("itemID", "itemName", "perUnit"), "itemID")
        .select(
            "itemID", "itemName", "totalInStock", "expiryDate",
            F.round(packs, 4).cast("decimal(18,4)").alias("totalInStockPerUnit"),
            *[name for name, _, _ in MOVES],
        )
    )


def stock_movement(t, first: Day, last: Day) -> DataFrame:
    """Quantities in, out and disposed of in a period."""
    kind = F.col("sourceType")
    qty = F.col("qty")
    return of_days(t.stock, first, last).agg(
        units0(F.when(kind.isin(S.PURCHASE, S.SALE_RETURN), qty)).alias("inToStock"),
        (-units0(F.when(kind.isin(S.SALE, S.PURCHASE_RETURN), qty))).alias("outFromStock"),
        (-units0(F.when(kind == S.DISPOSAL, qty))).alias("disposal"),
    )


def stock_counters(t, day: Day) -> DataFrame:
    """Live items, total quantity, and what came in and went out on a day, signed as stored."""
    kind = F.col("sourceType")
    today = on_day("createAt", day)
    live = _live(t.items).agg(F.count(F.lit(1)).alias("numberOfItems"))
    moved = t.stock.agg(
        F.sum("qty").cast("bigint").alias("numberOfAllQtyItems"),
        units0(F.when(kind.isin(S.PURCHASE, S.SALE_RETURN) & today, F.col("qty"))).alias("inToStock"),
        units0(
            F.when(kind.isin(S.SALE, S.PURCHASE_RETURN, S.DISPOSAL) & today, F.col("qty"))
        ).alias("outFromStock"),
    )
    return one_row(live, moved)


def money_in_stock(t) -> DataFrame:
    """Cost and quantity on hand of every item, deleted ones included."""
    return (
        t.items.select("itemID", "itemCode", "itemName", "costPrice")
        .join(_on_hand(t, "itemID"), "itemID", "left")
        .withColumn("totalInStock", _zero("totalInStock"))
    )


def item_catalog(t) -> DataFrame:
    """Live items with category, brand, shelf and quantity on hand, newest first."""
    return (
        _live(t.items)
        .join(_on_hand(t, "itemID"), "itemID", "left")
        .join(t.categories, "categoryID", "left")
        .join(t.shelfs, "shelfID", "left")
        .join(t.brands, "brandID", "left")
        .orderBy(F.desc("itemID"))
        .select(
            "itemID", "itemCode", "itemName", "categoryID", "categoryName", "brandID", "brandName",
            "shelfID", "shelfName", "unitID", "perUnit", "costPrice", "itemPriceRetail",
            "itemPriceWhole", "stockAlert", "hideInStock", "showButton", "note",
            _zero("totalInStock"),
        )
    )


def disposal_register(t, first: Day, last: Day, same_user: bool = True) -> DataFrame:
    """Disposals of a period with item and user.

    By default only those entered by the user who also created the item, as the
    shop's own list does; ``same_user=False`` shows all.
    """
    rows = t.disposals.filter(in_days("createAt", first, last))
    items = t.items.select("itemID", "itemCode", "itemName", F.col("userIDCreated").alias("_creator"))
    joined = rows.join(items, "itemID")
    if same_user:
        joined = joined.filter(F.col("_creator") == F.col("userID"))
    return joined.join(t.users.select("userID", "userName"), "userID").select(
        "disposalID", "itemID", "itemCode", "itemName", "costPrice", "qty", "createAt",
        "expiryDate", "userName",
    )


def discount_register(
    t,
    created: tuple[Day, Day],
    starting: tuple[Day, Day],
    ending: tuple[Day, Day],
) -> DataFrame:
    """Discounts whose creation, start and end each fall in a period, latest start first."""
    return (
        t.discounts.filter(
            in_days("createDate", *created)
            & in_days("startDate", *starting)
            & in_days("endDate", *ending)
        )
        .join(t.items.select("itemID", "itemName"), "itemID")
        .join(t.users.select("userID", "userName"), "userID")
        .orderBy(F.desc("startDate"), "dID")
        .select(
            "dID", "itemID", "itemName", "itemPriceRetail", "discount", "priceAfterDiscount",
            "createDate", "startDate", "endDate", "userID", "userName",
        )
    )


def item_resolve(t, terms: DataFrame, first_only: bool = False) -> DataFrame:
    """Matches search terms (term, whole) to live items by code or name, whatever the case.

    Two hash joins instead of one join on an OR; an item whose code and name both
    equal the term is found by its code alone. A whole sale takes a full pack at
    the whole price, otherwise one unit at retail. ``first_only`` keeps the lowest
    item id per term.
    """
    wanted = terms.select("term", "whole", F.lower("term").alias("_key"))
    items = _live(t.items).select(
        "itemID", "itemCode", "itemName", "perUnit", "itemPriceRetail", "itemPriceWhole",
        "costPrice", "unitID", F.lower("itemCode").alias("_code"), F.lower("itemName").alias("_name"),
    )
    by_code = wanted.join(items, F.col("_key") == F.col("_code"))
    by_name = wanted.join(items, F.col("_key") == F.col("_name")).filter(
        ~F.col("_code").eqNullSafe(F.col("_name"))
    )
    found = by_code.unionByName(by_name)
    if first_only:
        rest = [c for c in found.columns if c not in ("term", "whole")]
        found = (
            found.groupBy("term", "whole")
            .agg(F.min_by(F.struct(*rest), "itemID").alias("_hit"))
            .select("term", "whole", "_hit.*")
        )
    return found.join(t.units, "unitID").select(
        "term", "itemID", "itemCode", "itemName",
        F.when(F.col("whole"), F.col("perUnit")).otherwise(1).alias("qty"),
        F.when(F.col("whole"), F.col("itemPriceWhole")).otherwise(F.col("itemPriceRetail"))
        .alias("productPrice"),
        "costPrice", "unitName",
    )


def item_search(t, patterns: str | Sequence[str], prefix: bool = False) -> DataFrame:
    """Items whose code or name contains, or starts with, a text. Several texts take one scan.

    The plain search also shows deleted items, as the shop's does.
    """
    texts = [patterns] if isinstance(patterns, str) else list(patterns)
    code, name = F.lower("itemCode"), F.lower("itemName")

    def hit(text: Column) -> Column:
        if prefix:
            return code.startswith(text) | name.startswith(text)
        return code.contains(text) | name.contains(text)

    lowered = F.array(*[F.lit(text.lower()) for text in texts])
    return t.items.withColumn("pattern", F.explode(F.filter(lowered, hit))).select(
        "pattern", "itemID", "itemCode", "itemName", "costPrice", "itemPriceRetail",
        "itemPriceWhole", "perUnit",
    )


def button_items(t, category_id: int | None = None) -> DataFrame:
    """Live items shown as quick-sale buttons, of one category or of all."""
    rows = _live(t.items).filter(F.col("showButton") == S.YES)
    if category_id is not None:
        rows = rows.filter(F.col("categoryID") == category_id)
    else:
        rows = rows.filter(F.col("categoryID").isNotNull())
    return rows.select(
        "categoryID", "itemID", "itemCode", "itemName", "costPrice", "itemPriceRetail",
        "itemPriceWhole", "perUnit",
    )
