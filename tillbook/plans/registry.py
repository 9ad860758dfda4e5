"""Registered queries: name, the operator with its parameters, and its SQL twin."""

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.functions.shared import new_folder
from tillbook.operators import allocation, cash, changes, parties, posting, pricing, purchases, sales
from tillbook.operators import line_edits, lists, reposting, text_search
from tillbook.operators import stock as stock_ops
from tillbook.plans.oracle import TABLES, C, M, T, sql
from tillbook.session import ready
from tillbook.sources import retail
from tillbook.sources.ledgers import DayLedger
from tillbook.sources.tables import Tables
from tillbook.streaming import alerts, streams

DAY = "1998-06-15"
FIRST, LAST = "1998-01-01", "1998-12-31"
EVENT_DAY = "2024-01-10"
EVENT_FIRST, EVENT_LAST = "2024-01-05", "2024-01-20"
ALL_FIRST, ALL_LAST = "1995-01-01", "2024-12-31"
PROMO_DAY = "1997-02-10"

IN_YEAR = f"cast(createAt as date) between date '{FIRST}' and date '{LAST}'"
ON_DAY = f"cast(createAt as date) = date '{DAY}'"
IN_EVENTS = f"cast(createAt as date) between date '{EVENT_FIRST}' and date '{EVENT_LAST}'"
IN_ALL = f"cast(createAt as date) between date '{ALL_FIRST}' and date '{ALL_LAST}'"


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    oracle: str | None


QUERIES: dict[str, Query] = {}


def add(name: str, build: Callable[[Tables], DataFrame], body: str | None, **extra: str) -> None:
    QUERIES[name] = Query(build, None if body is None else sql(body, **extra))


def listed_text(df: DataFrame, array: str, fields: list[str]) -> DataFrame:
    """Replaces an array of lines by its length and one text of its fields."""
    line = F.transform(array, lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields]))
    return df.withColumn("nLines", F.size(array)).withColumn(array, F.array_join(line, ";"))


# --- Sales -----------------------------------------------------------------------

add(
    "money_movement",
    lambda t: sales.money_movement(t, ALL_FIRST, ALL_LAST),
    f"""select i.*, p.*, c.*, d.*, e.*, g.* from
    (select cast(coalesce(sum(totalPrice) filter (stockType = 's'), 0) as {T}) totalSale,
        cast(coalesce(sum(totalPrice) filter (stockType = 'rs'), 0) as {T}) totalReturnSale,
        cast(coalesce(sum(discount), 0) as {T}) totalDiscountInvoice from invoices where {IN_ALL}) i,
    (select cast(coalesce(sum(totalPrice) filter (stockType = 'p'), 0) as {T}) totalPurchase,
        cast(coalesce(sum(totalPrice) filter (stockType = 'rp'), 0) as {T}) totalReturnPurchase,
        cast(coalesce(sum(discount), 0) as {T}) totalDiscountPurchase from purchases where {IN_ALL}) p,
    (select cast(coalesce(sum(amountReturn - discount), 0) as {T}) totalDebtCustomer
        from return_debt_customer where {IN_ALL}) c,
    (select cast(coalesce(sum(amountReturn - discount), 0) as {T}) totalDebtCompany
        from return_debt where {IN_ALL}) d,
    (select cast(coalesce(sum(cast(round(cast(priceExpenseIQD as double) / nullif(dollarPrice, 0), 6)
        as decimal(18,6))), 0) + coalesce(sum(priceExpenseUSD), 0) as {C}) totalExpenseDollar
        from expenses where {IN_ALL}) e,
    (select cast(coalesce(sum(gain), 0) as {T}) totalProfit
        from gains where sourceType in ('s', 'rs') and {IN_ALL}) g""",
)
add(
    "profit_by_source",
    lambda t: sales.profit_by_source(t, FIRST, LAST),
    f"""select sourceID, sourceType, cast(sum(gain) as {T}) totalProfit,
        cast(-sum(qty * itemPrice) as {T}) totalSale,
        cast(coalesce(sum(gain) filter (sourceType = 's' and margin < 0), 0) as {T}) totalLoss
    from gains where sourceType in ('s', 'rs', 'd') and {IN_YEAR} group by sourceID, sourceType""",
)
add(
    "profit_totals",
    lambda t: sales.profit_totals(t, FIRST, LAST),
    f"""select cast(coalesce(sum(gain), 0) as {T}) totalAll,
        cast(coalesce(sum(gain) filter (sourceType = 'd'), 0) as {T}) totalDisposal,
        cast(coalesce(sum(gain) filter (sourceType = 's' and margin < 0), 0) as {T}) totalLoss
    from gains where sourceType in ('s', 'rs', 'd') and {IN_YEAR}""",
)
TOP_CATEGORY = """select categoryName, cast(-sum(qty) as bigint) totalSale
    from stock join items using (itemID) join categories using (categoryID)
    where {where} group by categoryID, categoryName order by 2 desc, categoryID limit 10"""
add(
    "top_categories",
    lambda t: sales.top_categories(t),
    TOP_CATEGORY.format(where="sourceType in ('s', 'rs')"),
)
add(
    "top_categories_day",
    lambda t: sales.top_categories_day(t, DAY),
    TOP_CATEGORY.format(where=f"sourceType = 's' and {ON_DAY}"),
)


def _week_sql() -> str:
    parts = []
    for ago, stem in enumerate(sales.WEEK):
        on = f"cast(createAt as date) = date '{DAY}' - {ago}"
        parts.append(
            f"cast(coalesce(-sum(qty * itemPrice) filter (sourceType = 's' and {on}), 0) as {T}) {stem}Sale"
        )
        parts.append(
            f"cast(coalesce(sum(qty * costPrice) filter (sourceType = 'p' and {on}), 0) as {T})"
            f" {stem}Purchase"
        )
    return f"select {', '.join(parts)} from stock"


add("daily_sale_purchase", lambda t: sales.daily_sale_purchase(t, DAY), _week_sql())
add(
    "sale_purchase_by_day",
    lambda t: sales.sale_purchase_by_day(t, DAY, 30),
    f"""select d as day,
        cast(coalesce(-sum(qty * itemPrice) filter (sourceType = 's'), 0) as {T}) sale,
        cast(coalesce(sum(qty * costPrice) filter (sourceType = 'p'), 0) as {T}) purchase
    from (select date '{DAY}' - n::int d from range(30) r(n))
    left join stock on cast(createAt as date) = d group by d""",
)
add(
    "sold_on_day",
    lambda t: sales.sold_on_day(t, DAY),
    """select invoiceID, customerName, totalPrice, invoiceType, discount, stockType, initialPay,
        totalPay, totalPayIQD from invoices join customers using (customerID)
    where sellStatus = '1' and stockType = 's' and cast(invoices.createAt as date) = date '1998-06-15'""",
)
REGISTER_SQL = """select invoiceID, invoices.customerID, customerName, userIDUpdate, userName,
    totalPrice, initialPay, totalPay, discount, stockType, invoiceType, invoices.createAt
    from invoices join customers on {on} join users on invoices.userID = users.userID"""
add(
    "invoice_register",
    lambda t: sales.invoice_register(t, FIRST, LAST),
    REGISTER_SQL.format(on="invoices.customerID = customers.customerID")
    + f" where cast(invoices.createAt as date) between date '{FIRST}' and date '{LAST}'",
)
add(
    "invoice_register_own",
    lambda t: sales.invoice_register_own(t),
    REGISTER_SQL.format(
        on="invoices.customerID = customers.customerID and invoices.userID = customers.userID"
    ),
)
add(
    "invoice_day_totals",
    lambda t: sales.invoice_day_totals(t, DAY),
    f"""select cast(sum(totalPrice) as {T}) totalCash,
        cast(sum(totalPrice - (initialPay + totalPay)) as {T}) totalDebt from invoices where {ON_DAY}""",
)
add(
    "sales_by_owner",
    lambda t: sales.sales_by_owner(t),
    f"""select itemID, itemCode, itemName, shelfName, shelfID, cast(-sum(qty) as bigint) sold,
        cast(-sum(qty) * itemPrice as {T}) totalPriceSold, cast(createAt as date) createAt
    from stock join items using (itemID) join shelfs using (shelfID) where sourceType in ('s', 'rs')
    group by itemID, itemCode, itemName, shelfName, shelfID, cast(createAt as date), itemPrice""",
)
add(
    "items_sold_by_customer",
    lambda t: sales.items_sold_by_customer(t),
    """select customers.customerID, invoices.invoiceID, itemCode, itemName, qty, productPrice,
        cast(invoices.createAt as date) createAt
    from invoice_item join invoices using (invoiceID)
    join customers on customers.customerID = invoices.customerID
    join items on items.itemID = invoice_item.itemID""",
)
SOLD_LINES = f"""from invoice_item join items using (itemID) join invoices using (invoiceID)
    where stockType = 's' and sellStatus = '1' and {IN_YEAR}"""
add(
    "sold_items",
    lambda t: sales.sold_items(t, FIRST, LAST),
    f"select itemCode, itemName, items.shelfID, qty, productPrice, invoiceID {SOLD_LINES}",
)
add(
    "sold_items_total",
    lambda t: sales.sold_items_total(t, FIRST, LAST),
    f"""select itemID, itemName, items.shelfID, cast(sum(qty) as bigint) qty,
        cast(sum(productPrice * qty) as {T}) total {SOLD_LINES}
    group by itemID, itemName, items.shelfID""",
)
add(
    "open_invoices",
    lambda t: sales.open_invoices(t),
    "select userIDUpdate, invoiceID from invoices where sellStatus = '0'",
)
add(
    "invoice_documents",
    lambda t: listed_text(
        sales.invoice_documents(t),
        "invoiceItems",
        ["invdID", "itemID", "itemName", "qty", "productPrice", "unitName"],
    ),
    """select invoiceID, customers.customerID, customerName, totalPrice, discount, stockType, invoiceType,
        sellStatus, totalPay, initialPay, totalPayIQD, dollarPrice, fullName, 0 part,
        coalesce(n, 0)::int nLines, coalesce(lines, '') invoiceItems
    from invoices join customers using (customerID)
    join users on users.userID = invoices.userIDUpdate
    left join (select invoiceID, count(*) n, string_agg(concat_ws('|', invdID, itemID, itemName, qty,
            productPrice, unitName), ';' order by invdID) lines
        from invoice_item join items using (itemID) join units on units.unitID = invoice_item.unitID
        group by invoiceID) using (invoiceID)""",
)
PARTS = """select invoiceID, customers.customerID, customerName, totalPrice, discount, stockType, invoiceType,
        sellStatus, totalPay, initialPay, totalPayIQD, dollarPrice, fullName, coalesce(p, 0)::int part,
        coalesce(n, 0)::int nLines, coalesce(lines, '') invoiceItems
    from invoices join customers using (customerID)
    join users on users.userID = invoices.userIDUpdate
    left join (select invoiceID, p, count(*) n, string_agg(concat_ws('|', invdID, itemID, itemName, qty,
            productPrice, unitName), ';' order by invdID) lines
        from (select *, (row_number() over (partition by invoiceID order by invdID) - 1) // 3 p
            from invoice_item join items using (itemID) join units on units.unitID = invoice_item.unitID)
        group by invoiceID, p) using (invoiceID)"""
add(
    "invoice_documents_parts",
    lambda t: listed_text(
        sales.invoice_documents(t, lines_per_part=3),
        "invoiceItems",
        ["invdID", "itemID", "itemName", "qty", "productPrice", "unitName"],
    ),
    PARTS,
)
add(
    "invoice_documents_range",
    lambda t: listed_text(
        sales.invoice_documents(t, first=FIRST, last=LAST, lines_per_part=3),
        "invoiceItems",
        ["invdID", "itemID", "itemName", "qty", "productPrice", "unitName"],
    ),
    PARTS + f" where cast(invoices.createAt as date) between date '{FIRST}' and date '{LAST}'",
)
add(
    "invoice_neighbours",
    lambda t: sales.invoice_neighbours(t),
    """select invoiceID, lag(invoiceID) over (order by invoiceID) previousInvoice,
        lead(invoiceID) over (order by invoiceID) nextInvoice from invoices""",
)
add(
    "profit_by_item",
    lambda t: sales.profit_by_item(t, FIRST, LAST),
    f"""select itemID, itemCode, itemName, cast(-sum(qty) as bigint) totalQtySale,
        cast(sum(gain) as {T}) profitByItem,
        cast(sum(case when margin <= 0 then -gain else 0 end) as {T}) totalLoss,
        categoryName, brandName, shelfName
    from gains join items using (itemID) left join categories using (categoryID)
    left join brands using (brandID) left join shelfs using (shelfID)
    where sourceType in ('s', 'rs', 'd') and {IN_YEAR}
    group by itemID, itemCode, itemName, categoryName, brandName, shelfName""",
)
TOP_ITEMS = """select itemID, itemName, cast(-sum(qty) as bigint) topSale
    from stock join items using (itemID) where sourceType = 's' and {where}
    group by itemID, itemName order by 3 desc, itemID limit 5"""
add(
    "top_items_month",
    lambda t: sales.top_items_month(t, 6),
    TOP_ITEMS.format(where="month(createAt) = 6"),
)
add(
    "top_items_month_year",
    lambda t: sales.top_items_month(t, 6, year=1998),
    TOP_ITEMS.format(where="month(createAt) = 6 and year(createAt) = 1998"),
)
add(
    "slow_items",
    lambda t: sales.slow_items(t, 0, 100),
    """select itemID, itemName,
        cast(-coalesce(sum(qty) filter (sourceType = 's'), 0) as bigint) notSale
    from items left join stock using (itemID) group by itemID, itemName
    having -coalesce(sum(qty) filter (sourceType = 's'), 0) between 0 and 100""",
)

# --- Stock -----------------------------------------------------------------------

BY_MOVE = """cast(coalesce(sum(qty) filter (sourceType = 'p'), 0) as bigint) purchased,
    cast(-coalesce(sum(qty) filter (sourceType = 'rp'), 0) as bigint) returnPurchase,
    cast(-coalesce(sum(qty) filter (sourceType = 's'), 0) as bigint) sold,
    cast(coalesce(sum(qty) filter (sourceType = 'rs'), 0) as bigint) returnSold,
    cast(-coalesce(sum(qty) filter (sourceType = 'd'), 0) as bigint) disposal"""
add(
    "in_stock",
    stock_ops.in_stock,
    f"""select itemID, itemCode, itemName, items.unitID, shelfID, brandID, categoryID,
        cast(coalesce(sum(qty), 0) as bigint) totalInStock, {BY_MOVE}, unitName
    from items left join stock using (itemID) left join units on items.unitID = units.unitID
    where deleteStatus = '1' and hideInStock = '1'
    group by itemID, itemCode, itemName, items.unitID, shelfID, brandID, categoryID, unitName""",
)
add(
    "lack_in_stock",
    stock_ops.lack_in_stock,
    """select itemID, itemCode, itemName, shelfID, cast(coalesce(sum(qty), 0) as bigint) totalInStock
    from items left join stock using (itemID) where deleteStatus = '1'
    group by itemID, itemCode, itemName, shelfID, stockAlert having coalesce(sum(qty), 0) <= stockAlert""",
)
add(
    "in_stock_detail",
    lambda t: stock_ops.in_stock_detail(t),
    f"""select itemID, itemName, cast(sum(qty) as bigint) totalInStock, expiryDate,
        cast(round(cast(sum(qty) as double) / nullif(perUnit, 0), 4) as decimal(18,4)) totalInStockPerUnit,
        {BY_MOVE}
    from stock join items using (itemID) group by itemID, itemName, perUnit, expiryDate""",
)
add(
    "stock_movement",
    lambda t: stock_ops.stock_movement(t, FIRST, LAST),
    f"""select cast(coalesce(sum(qty) filter (sourceType in ('p', 'rs')), 0) as bigint) inToStock,
        cast(-coalesce(sum(qty) filter (sourceType in ('s', 'rp')), 0) as bigint) outFromStock,
        cast(-coalesce(sum(qty) filter (sourceType = 'd'), 0) as bigint) disposal
    from stock where {IN_YEAR}""",
)
add(
    "stock_counters",
    lambda t: stock_ops.stock_counters(t, DAY),
    f"""select i.n numberOfItems, s.* from (select count(*) n from items where deleteStatus = '1') i,
    (select cast(sum(qty) as bigint) numberOfAllQtyItems,
        cast(coalesce(sum(qty) filter (sourceType in ('p', 'rs') and {ON_DAY}), 0) as bigint) inToStock,
        cast(coalesce(sum(qty) filter (sourceType in ('s', 'rp', 'd') and {ON_DAY}), 0) as bigint)
            outFromStock from stock) s""",
)
add(
    "money_in_stock",
    stock_ops.money_in_stock,
    """select itemID, itemCode, itemName, items.costPrice,
        cast(coalesce(sum(qty), 0) as bigint) totalInStock
    from items left join stock using (itemID) group by itemID, itemCode, itemName, items.costPrice""",
)
add(
    "item_catalog",
    stock_ops.item_catalog,
    """select items.itemID, itemCode, itemName, items.categoryID, categoryName, items.brandID, brandName,
        items.shelfID, shelfName, unitID, perUnit, costPrice, itemPriceRetail, itemPriceWhole, stockAlert,
        hideInStock, showButton, note, cast(coalesce(q, 0) as bigint) totalInStock
    from items left join (select itemID, sum(qty) q from stock group by itemID) s
        on s.itemID = items.itemID
    left join categories on categories.categoryID = items.categoryID
    left join brands on brands.brandID = items.brandID
    left join shelfs on shelfs.shelfID = items.shelfID where deleteStatus = '1'""",
)
DISPOSALS = """select disposalID, itemID, itemCode, itemName, disposals.costPrice, qty,
    disposals.createAt, expiryDate, userName
    from disposals join items using (itemID) join users on users.userID = disposals.userID
    where cast(disposals.createAt as date) between date '1998-01-01' and date '1998-12-31'"""
add(
    "disposal_register",
    lambda t: stock_ops.disposal_register(t, FIRST, LAST),
    DISPOSALS + " and userIDCreated = disposals.userID",
)
add(
    "disposal_register_all",
    lambda t: stock_ops.disposal_register(t, FIRST, LAST, same_user=False),
    DISPOSALS,
)
add(
    "discount_register",
    lambda t: stock_ops.discount_register(
        t, ("1997-01-01", "1997-02-10"), ("1997-01-05", "1997-02-05"), ("1997-02-05", "1997-03-01")
    ),
    """select dID, discounts.itemID, itemName, discounts.itemPriceRetail, discount, priceAfterDiscount,
        createDate, startDate, endDate, discounts.userID, userName
    from discounts join items using (itemID) join users on users.userID = discounts.userID
    where createDate between date '1997-01-01' and date '1997-02-10'
    and startDate between date '1997-01-05' and date '1997-02-05'
    and endDate between date '1997-02-05' and date '1997-03-01'""",
)
TERMS = """select case when p_partkey % 2 = 0 then concat('p', p_partkey)
    else upper(concat(p_name, ' ', p_partkey)) end term, p_partkey % 3 = 0 whole from part"""
add(
    "item_resolve",
    lambda t: stock_ops.item_resolve(t, t.search_terms),
    """select term, itemID, itemCode, itemName, case when whole then perUnit else 1 end qty,
        case when whole then itemPriceWhole else itemPriceRetail end productPrice, costPrice, unitName
    from terms join items on lower(term) in (lower(itemCode), lower(itemName)) join units using (unitID)
    where deleteStatus = '1'""",
    terms=TERMS,
)
def many_patterns(t: Tables) -> DataFrame:
    """A pattern from every item: some of its letters, in capitals for some."""
    return t.items.selectExpr(
        """case when itemID % 3 = 0 then substr(itemName, itemID % 7 + 1, itemID % 4 + 2)
            when itemID % 3 = 1 then upper(substr(itemName, 2, 5)) else substr(itemCode, 2, 3) end pattern"""
    )


MANY_PATTERNS = {
    "patterns": """select distinct lower(case when itemID % 3 = 0 then substr(itemName, itemID % 7 + 1, itemID % 4 + 2)
        when itemID % 3 = 1 then upper(substr(itemName, 2, 5)) else substr(itemCode, 2, 3) end) pattern from items""",
}
FOUND = """select pattern, itemID, itemCode, itemName, costPrice, itemPriceRetail, itemPriceWhole, perUnit
    from patterns join items on {0}(lower(itemCode), pattern) or {0}(lower(itemName), pattern) where pattern <> ''"""
add(
    "item_search_many",
    lambda t: text_search.ItemIndex(t.items).search(many_patterns(t)),
    FOUND.format("contains"),
    **MANY_PATTERNS,
)
add(
    "item_search_many_prefix",
    lambda t: text_search.ItemIndex(t.items).search(many_patterns(t), prefix=True),
    FOUND.format("starts_with"),
    **MANY_PATTERNS,
)
add(
    "item_search",
    lambda t: stock_ops.item_search(t, ["RED", "gear 1", "p12"]),
    """select pattern, itemID, itemCode, itemName, costPrice, itemPriceRetail, itemPriceWhole, perUnit
    from items join (values ('red'), ('gear 1'), ('p12')) v(pattern)
    on contains(lower(itemCode), pattern) or contains(lower(itemName), pattern)""",
)
add(
    "item_search_prefix",
    lambda t: stock_ops.item_search(t, "P1", prefix=True),
    """select 'p1' pattern, itemID, itemCode, itemName, costPrice, itemPriceRetail, itemPriceWhole, perUnit
    from items where lower(itemCode) like 'p1%' or lower(itemName) like 'p1%'""",
)
add(
    "button_items",
    lambda t: stock_ops.button_items(t),
    """select categoryID, itemID, itemCode, itemName, costPrice, itemPriceRetail, itemPriceWhole, perUnit
    from items where deleteStatus = '1' and showButton = '1' and categoryID is not null""",
)

# --- Purchases -------------------------------------------------------------------

add(
    "purchases_on_day",
    lambda t: purchases.purchases_on_day(t, DAY),
    f"""select purchaseID, supplierName, referenceNo, totalPrice, amountPay, discount, PurchaseStatus,
        paymentType, userName "user"
    from purchases join suppliers using (supplierID) join users on users.userID = userIDUpdate
    where stockType = 'p' and cast(purchases.createAt as date) = date '{DAY}'""",
)
add(
    "purchase_register",
    lambda t: purchases.purchase_register(t, FIRST, LAST),
    f"""select purchaseID, supplierID, supplierName, referenceNo, dollarPrice, totalPrice, amountPay,
        amountPayIQD, discount, PurchaseStatus, paymentType, stockType, note, userName "user", fullName,
        userIDCreated, purchases.createAt
    from purchases join suppliers using (supplierID) join users on users.userID = userIDCreated
    where cast(purchases.createAt as date) between date '{FIRST}' and date '{LAST}'""",
)
add(
    "purchase_lines",
    lambda t: purchases.purchase_lines(t),
    """select purchaseID, pItemID, itemID, itemCode, itemName, purchase_items.costPrice, qty, discount,
        costAfterDisc from purchase_items join items using (itemID)""",
)
add(
    "purchase_documents",
    lambda t: listed_text(
        purchases.purchase_documents(t),
        "purchaseItems",
        ["pItemID", "itemID", "itemCode", "itemName", "costPrice", "qty", "costAfterDisc"],
    ),
    """select purchaseID, supplierID, supplierName, referenceNo, dollarPrice, totalPrice, amountPay,
        PurchaseStatus, paymentType, stockType, note, purchases.createAt, fullName, 0 part,
        coalesce(n, 0)::int nLines, coalesce(lines, '') purchaseItems
    from purchases join suppliers using (supplierID) join users on users.userID = userIDCreated
    left join (select purchaseID, count(*) n, string_agg(concat_ws('|', pItemID, itemID, itemCode,
            itemName, purchase_items.costPrice, qty, costAfterDisc), ';' order by pItemID) lines
        from purchase_items join items using (itemID) group by purchaseID) using (purchaseID)""",
)
PURCHASE_PAGE = """select purchaseID, supplierID, supplierName, referenceNo, totalPrice, paymentType,
    PurchaseStatus, users.userID, userName, (select count(*) from purchases) nop
    from purchases join suppliers using (supplierID) join users on users.userID = userIDUpdate"""
add(
    "purchase_page",
    lambda t: purchases.purchase_page(t, 3),
    PURCHASE_PAGE + " order by purchaseID desc limit 20 offset 40",
)
add(
    "purchase_page_deep",
    lambda t: purchases.purchase_page(t, 600),
    PURCHASE_PAGE + " order by purchaseID desc limit 20 offset 11980",
)
add(
    "purchase_by_reference",
    lambda t: purchases.purchase_by_reference(t, "REF7"),
    PURCHASE_PAGE + " where referenceNo = 'REF7'",
)
add(
    "purchase_total_recompute",
    lambda t: purchases.purchase_total_recompute(t),
    f"""select purchaseID, totalPrice, cast(lineTotal as {T}) lineTotal,
        totalPrice is distinct from lineTotal differs
    from purchases left join (select purchaseID, sum(qty * costAfterDisc) lineTotal
        from purchase_items group by purchaseID) using (purchaseID)""",
)

# --- Partners --------------------------------------------------------------------

add("customer_account", parties.customer_account, "select * from customer_accounts")
add("supplier_account", parties.supplier_account, "select * from supplier_accounts")
add(
    "customer_debt_list",
    parties.customer_debt_list,
    """select customerID, customerName, previousDebt, totalInvoiceDebt, totalPay, totalReturnInvoice,
        totalReturnDebt, totalRemainCustomer from customer_remains where customerID <> 1""",
)
add(
    "supplier_debt_list",
    parties.supplier_debt_list,
    "select supplierID, supplierName, totalRemainSupplier from supplier_remains",
)
add(
    "customer_netting",
    lambda t: parties.customer_netting(t),
    f"""select customerID, customerName, totalRemainCustomer,
        cast(coalesce(totalRemainSupplier, 0) as {C}) totalRemainSupplier,
        cast(case when totalRemainCustomer - coalesce(totalRemainSupplier, 0) >= 0
            then totalRemainCustomer - coalesce(totalRemainSupplier, 0) else 0 end as {C}) totalRemain
    from customer_remains left join supplier_remains on customerName = supplierName""",
)
add(
    "supplier_netting",
    parties.supplier_netting,
    f"""select supplierID, supplierName, totalRemainSupplier,
        cast(coalesce(totalRemainCustomer, 0) as {C}) totalRemainCustomer,
        cast(case when totalRemainSupplier - coalesce(totalRemainCustomer, 0) >= 0
            then totalRemainSupplier - coalesce(totalRemainCustomer, 0) else 0 end as {C}) totalRemain
    from supplier_remains left join customer_remains on customerName = supplierName""",
)
DIRECTORY = f"""select customers.customerID, customers.customerName,
    concat(customers.customerID, '-', customers.customerName) concatNameAndCode, phoneNumber, address,
    customers.previousDebt, limitDebt, wholePrice, doesSupplier, createAt, activeStatus, userName,
    cast(case when totalRemainCustomer - coalesce(totalRemainSupplier, 0) >= 0
        then totalRemainCustomer - coalesce(totalRemainSupplier, 0) else 0 end as {C}) totalRemain
    from customers join users using (userID)
    left join customer_remains on customers.customerName = customer_remains.customerName
    left join supplier_remains on customers.customerName = supplierName"""
add("customers_with_debt", lambda t: parties.customers_with_debt(t), DIRECTORY)
add(
    "active_customers_with_debt",
    lambda t: parties.customers_with_debt(t, active_only=True),
    DIRECTORY + " where activeStatus = '1'",
)
add(
    "suppliers_with_debt",
    parties.suppliers_with_debt,
    f"""select suppliers.supplierID, suppliers.supplierName, phone, address, suppliers.previousBalance,
        createAt, activeStatus,
        cast(case when totalRemainSupplier - coalesce(totalRemainCustomer, 0) >= 0
            then totalRemainSupplier - coalesce(totalRemainCustomer, 0) else 0 end as {C}) totalRemain
    from suppliers left join customer_remains on suppliers.supplierName = customerName
    left join supplier_remains on suppliers.supplierName = supplier_remains.supplierName
    where activeStatus = '1'""",
)
add(
    "supplier_search",
    lambda t: parties.supplier_search(t, "party00000000"),
    """select supplierID, supplierName from suppliers
    where lower(supplierName) like 'party00000000%'""",
)
CUSTOMER_REPAYMENTS = f"""select rdcID, customers.customerID, customerName, r.shelfID, shelfName,
    amountReturn, amountReturnIQD, discount, dollarPrice, invoiceNumbers, r.createAt, userName
    from return_debt_customer r join customers on r.customerID = customers.customerID
    join users on users.userID = r.userID left join shelfs on shelfs.shelfID = r.shelfID
    where cast(r.createAt as date) between date '{EVENT_FIRST}' and date '{EVENT_LAST}'"""
add(
    "customer_repayments",
    lambda t: parties.customer_repayments(t, EVENT_FIRST, EVENT_LAST),
    CUSTOMER_REPAYMENTS + " and customers.userID = r.userID",
)
add(
    "customer_repayments_all",
    lambda t: parties.customer_repayments(t, EVENT_FIRST, EVENT_LAST, same_user=False),
    CUSTOMER_REPAYMENTS,
)
add(
    "supplier_repayments",
    lambda t: parties.supplier_repayments(t, EVENT_FIRST, EVENT_LAST),
    f"""select rdID, suppliers.supplierID, supplierName, amountReturn, amountReturnIQD, referenceNO,
        discount, dollarPrice, purchaseNumbers, r.createAt, userName
    from return_debt r join suppliers on r.supplierID = suppliers.supplierID
    join users on users.userID = r.userID
    where cast(r.createAt as date) between date '{EVENT_FIRST}' and date '{EVENT_LAST}'
    and suppliers.userID = r.userID""",
)
add(
    "open_debt_invoices",
    lambda t: parties.open_debt_invoices(t),
    "select invoiceID, customerID, createAt, total from unpaid",
)
add(
    "debt_of_invoices",
    lambda t: parties.debt_of_invoices(t, changes.listed_invoices(t).select("invoiceID")),
    f"""select cast(sum(totalPrice - (initialPay + totalPay)) as {T}) total from invoices
    where invoiceID in (select invoiceID from listed)""",
)
add(
    "open_debt_purchases",
    lambda t: parties.open_debt_purchases(t),
    """select supplierID, purchaseID from purchases
    where paymentType = 'd' and debtStatus = '0' and stockType = 'p'""",
)
STATEMENT_SQL = """select sourceID, sourceType, accountName, accountType, totalPrice, totalPay,
    totalPayIQD, transactionType, x.createAt from transactions x"""
add(
    "account_statement",
    lambda t: parties.account_statement(t, FIRST, LAST, "c"),
    STATEMENT_SQL + f" where {IN_YEAR} and accountType = 'c'",
)
add(
    "account_statement_suppliers",
    lambda t: parties.account_statement(t, ALL_FIRST, ALL_LAST, "s"),
    STATEMENT_SQL + f" where {IN_ALL} and accountType = 's'",
)
add(
    "partner_statement",
    lambda t: parties.partner_statement(t, FIRST, LAST),
    STATEMENT_SQL
    + f""" join suppliers on supplierName = accountName join customers on customerName = accountName
    where cast(x.createAt as date) between date '{FIRST}' and date '{LAST}'""",
)
add(
    "partner_names",
    parties.partner_names,
    """select distinct accountName from transactions
    join suppliers on supplierName = accountName join customers on customerName = accountName""",
)

# --- Cash ------------------------------------------------------------------------

add(
    "expense_register",
    lambda t: cash.expense_register(t, EVENT_FIRST, EVENT_LAST),
    f"""select expenseID, typeName, typeExpenseID, shelfID, shelfName, priceExpenseIQD, priceExpenseUSD,
        dollarPrice, note, createAt, userName
    from expenses join type_expense using (typeExpenseID) join shelfs using (shelfID)
    join users on users.userID = userIDCreated where {IN_EVENTS}""",
)
add(
    "expense_totals",
    lambda t: cash.expense_totals(t, EVENT_FIRST, EVENT_LAST),
    f"""select cast(sum(priceExpenseIQD) as decimal(28,2)) totalIQD,
        cast(sum(priceExpenseUSD) as {T}) totalUSD from expenses where {IN_EVENTS}""",
)
add(
    "expense_day",
    lambda t: cash.expense_day(t, EVENT_DAY),
    f"""select cast(coalesce(sum(priceExpenseIQD), 0) as decimal(28,2)) total,
        count(*) numberOfExpenses from expenses where cast(createAt as date) = date '{EVENT_DAY}'""",
)
add(
    "box_register",
    lambda t: cash.box_register(t, EVENT_FIRST, EVENT_LAST),
    f"""select btID, b.shelfID, shelfName, sourceID, amount, amountIQD, "type", note, createAt,
        userName "user"
    from box_transaction b join shelfs using (shelfID) join users using (userID) where {IN_EVENTS}""",
)
add(
    "box_balance",
    lambda t: cash.box_balance(t),
    f"""select shelfID, cast(sum(amount) as {T}) amount, cast(sum(amountIQD) as decimal(28,2)) amountIQD
    from box_transaction group by shelfID""",
)
add(
    "box_value",
    cash.box_value,
    f"""select shelfID, cast(sum(amount) as {T}) amount, cast(sum(amountIQD) as decimal(28,2)) amountIQD,
        cast(sum(amount) + cast(round(cast(sum(amountIQD) as decimal(28,10)) / 1150, 6) as decimal(28,6)) as {C}) inDollars
    from box_transaction group by shelfID""",
)
add(
    "money_transfers",
    lambda t: cash.money_transfers(t, EVENT_FIRST, EVENT_LAST),
    f"""select mbID, m.shelfID, a.shelfName, m.shelfID2, b.shelfName shelfName2, amount, createAt, userName
    from money_box m join users using (userID) left join shelfs a on a.shelfID = m.shelfID
    left join shelfs b on b.shelfID = m.shelfID2 where {IN_EVENTS}""",
)
add(
    "dimension_counts",
    cash.dimension_counts,
    """select 'customers' dimension, count(*) n from customers
    union all select 'activeCustomers', count(*) from customers where activeStatus = '1'
    union all select 'items', count(*) from items where deleteStatus = '1'
    union all select 'expenseTypes', count(*) from type_expense
    union all select 'categories', count(*) from categories
    union all select 'brands', count(*) from brands""",
)
add(
    "dimension_page",
    lambda t: cash.dimension_page(t, "brands", 6, 6),
    "select brandID, brandName from brands order by brandID desc limit 6 offset 6",
)

# --- Posting ---------------------------------------------------------------------

add("post_sales_stock", posting.post_sales_stock, "select * from sales_stock")
add(
    "post_sales_box",
    lambda t: posting.post_sales_box(t, "sale", "invoice", "return"),
    f"""select cast(1 as bigint) shelfID, invoiceID sourceID,
        cast(case when stockType = 's' then initialPay else -initialPay end as {M}) amount,
        cast(case when stockType = 's' then totalPayIQD else -totalPayIQD end as decimal(18,2)) amountIQD,
        stockType "type", case when stockType = 's' then concat_ws(' ', 'sale', customerName, 'invoice',
            invoiceID) else concat_ws(' ', 'return', customerName) end note,
        userIDUpdate userID, invoices.createAt
    from invoices left join customers using (customerID) where sellStatus = '1'""",
)
add("post_sales_account", posting.post_sales_account, "select * from sales_account")
add("post_purchase_stock", posting.post_purchase_stock, "select * from purchase_stock")
add("post_purchase_box", posting.post_purchase_box, "select * from purchase_box")
add("post_purchase_account", posting.post_purchase_account, "select * from purchase_account")
add("post_disposal", posting.post_disposal, "select * from disposal_stock")
add("post_opening", posting.post_opening, "select * from opening")
add("post_repayment_account", posting.post_repayment_account, "select * from repayment_account")
add(
    "post_repayment_box",
    lambda t: posting.post_repayment_box(t, "repaid"),
    f"""select shelfID, rdID sourceID, cast(-(amountReturn + discount) as {M}) amount,
        cast(-amountReturnIQD as decimal(18,2)) amountIQD, 'rdp' "type",
        concat_ws(' ', 'repaid', supplierName) note, r.userID, r.createAt
    from return_debt r left join suppliers using (supplierID)""",
)
add(
    "purchases_after_repayment",
    lambda t: posting.purchases_after_repayment(t).select("purchaseID", "supplierID", "debtStatus"),
    """select purchaseID, supplierID, case when purchaseID in (
        select cast(unnest(string_split(purchaseNumbers, ',')) as bigint) from return_debt
        where purchaseNumbers is not null) then '1' else debtStatus end debtStatus from purchases""",
)
add("post_expense", posting.post_expense, "select * from expense_box")
add("box_ledger", posting.box_ledger, "select * from box")
add("stock_ledger", posting.stock_ledger, "select * from stock")
add("party_ledger", posting.party_ledger, "select * from transactions")
add("post_cash", posting.post_cash, "select * from box_transaction")
add(
    "sales_by_shelf",
    posting.sales_by_shelf,
    f"""select shelfID, invoiceID sourceID, cast(sum(qty * productPrice)
        * case when stockType = 's' then 1 else -1 end as {T}) amount, stockType "type"
    from invoice_item join invoices using (invoiceID) where sellStatus = '1'
    group by shelfID, invoiceID, stockType""",
)
add(
    "mirror_partners",
    lambda t: posting.mirror_partners(t),
    """select customerName supplierName, phoneNumber phone, address, userID from customers
    where doesSupplier = '1' and customerName not in (select supplierName from suppliers)""",
)
add(
    "latest_purchase_price",
    posting.latest_purchase_price,
    f"""select itemID, itemCode, cast(coalesce(latest, items.costPrice) as {M}) costPrice, itemPriceRetail
    from items left join (select itemID, arg_max(purchase_items.costPrice,
            {{'a': createAt, 'b': pItemID}}) latest
        from purchase_items join purchases using (purchaseID) where stockType = 'p' group by itemID)
    using (itemID)""",
)
add(
    "to_dollars",
    lambda t: t.purchases.select(
        "purchaseID",
        posting.to_dollars(F.col("amountPay"), F.col("amountPayIQD"), F.col("dollarPrice")).alias("paid"),
    ),
    "select purchaseID, paid from purchase_paid",
)
add(
    "explode_id_list",
    changes.listed_invoices,
    "select rdcID, customerID, invoiceID from listed",
)
add(
    "unlist_invoice",
    lambda t: changes.unlist_invoice(t, F.col("customerID") - 2),
    """select rdcID, case when invoiceNumbers is not null then cast(customerID - 1 as varchar) end
        invoiceNumbers, case when invoiceNumbers is null then 0 else 2 end listedBefore
    from return_debt_customer""",
)

def list_changes(t: Tables, side: lists.Listing) -> DataFrame:
    """Each listed document is taken out by some repayments, and appended to the next repayment by others."""
    held = lists.bridge(t, side).select(side.key, side.document)
    gone = held.filter(f"({side.key} + {side.document}) % 3 <> 0").selectExpr(
        side.key, side.document, "'remove' change", "1L seq"
    )
    added = held.filter(f"({side.key} + {side.document}) % 5 = 0").selectExpr(
        f"{side.key} + 1 {side.key}", side.document, "'append' change", "2L seq"
    )
    return gone.unionByName(added)


def add_lists(side: lists.Listing) -> None:
    key, doc = side.key, side.document
    texts = {
        "held": f"""select {key}, cast(trim(id) as bigint) {doc}, count(*) times from (
            select {key}, unnest(string_split({side.column}, ',')) id from {side.repayments}
            where {side.column} is not null) where trim(id) <> '' group by all""",
        "after_change": f"""select {key}, {doc}, cast(sum(times) as bigint) times from (
            select * from held where ({key} + {doc}) % 3 = 0
            union all select {key} + 1, {doc}, 1 from held where ({key} + {doc}) % 5 = 0) group by all""",
    }

    def after(t: Tables) -> DataFrame:
        return lists.merged(lists.bridge(t, side), list_changes(t, side), side)

    add(f"bridge_{side.documents}", lambda t: lists.bridge(t, side), "select * from held", **texts)
    add(f"append_and_unlist_{side.documents}", after, "select * from after_change", **texts)
    add(
        f"{side.documents}_after_unlist",
        lambda t: lists.with_status(t, side, lists.bridge(t, side), after(t)).select(doc, side.status),
        f"""select {doc}, case when b.{doc} is null and a.{doc} is null then {side.status}
            when b.{doc} is not null and a.{doc} is null then '{side.reopened}'
            when b.{doc} is null then '{side.settled}' else {side.status} end {side.status}
        from {side.documents} left join (select distinct {doc} from held) b using ({doc})
        left join (select distinct {doc} from after_change) a using ({doc})""",
        **texts,
    )
    add(
        f"lists_of_{side.documents}",
        lambda t: lists.as_lists(t, side, after(t)).select(key, side.column),
        f"""select {key}, ids {side.column} from {side.repayments} left join (
            select {key}, string_agg(repeat(concat(',', {doc}), times::int), '' order by {doc})[2:] ids
            from after_change group by {key}) using ({key})""",
        **texts,
    )


add_lists(lists.SUPPLIERS)
add_lists(lists.CUSTOMERS)

# --- Logs ------------------------------------------------------------------------

add(
    "allocate_repayments",
    allocation.allocate_repayments,
    f"""select f.invoiceID, f.customerID, total due,
        cast(case when full_ then total when coalesce(before <= money, true) and money is not null
            then money - (cum - total) else 0 end as {M}) pays,
        cast(totalPay + case when full_ then total
            when coalesce(before <= money, true) and money is not null then money - (cum - total)
            else 0 end as {M}) totalPay,
        case when full_ then '1' else '0' end wasl, rdcID
    from flagged f left join filler using (invoiceID)""",
    summed="""select *, sum(total) over (partition by customerID order by createAt, invoiceID
        rows unbounded preceding) cum from unpaid""",
    topped="""select *, max(cum) over (partition by customerID order by createAt, invoiceID
        rows unbounded preceding) top, max(cum) over (partition by customerID order by createAt, invoiceID
        rows between unbounded preceding and 1 preceding) before from summed""",
    flagged="""select *, coalesce(top <= money, false) full_ from topped left join (
        select customerID, sum(amountReturn) money from return_debt_customer
        where invoiceNumbers is null group by customerID)
        using (customerID)""",
    paid="""select customerID, rdcID, createAt, sum(amountReturn) over (partition by customerID
        order by createAt, rdcID rows unbounded preceding) level from return_debt_customer
        where invoiceNumbers is null""",
    filler="""select invoiceID, arg_min(rdcID, {'a': paid.createAt, 'b': rdcID}) rdcID
        from flagged join paid on flagged.customerID = paid.customerID and level >= top
        where full_ group by invoiceID""",
)
# Payments among the invoices they pay; a tenth of each total is paid already.
IN_TIME = {
    "early_payments": f"""select invoiceID rdcID, customerID, cast(totalPrice * cast(0.7 as decimal(2,1)) as {M}) amount,
        createAt + to_days((20 + invoiceID % 300)::int) createAt from invoices where invoiceID % 3 = 0""",
    "part_paid": f"""select invoiceID, customerID, createAt, cast(totalPrice * cast(0.1 as decimal(2,1)) as {M}) totalPay,
        cast(totalPrice - initialPay - cast(totalPrice * cast(0.1 as decimal(2,1)) as {M}) as {M}) due
        from invoices where wasl = '0' and stockType = 's'""",
    "moments": f"""select customerID, createAt, 0 kind, invoiceID id, due, cast(0 as {M}) amount from part_paid
        union all select customerID, createAt, 1, rdcID, 0, amount from early_payments""",
    "running_sums": """select *, sum(greatest(due, 0)) over line billed, sum(amount - due) over line given
        from moments window line as (partition by customerID order by createAt, kind, id
            rows unbounded preceding)""",
    "never_owed": """select *, greatest(max(case when kind = 1 then given end) over (partition by customerID
            order by createAt, kind, id rows unbounded preceding), 0) lost,
        greatest(coalesce(max(case when kind = 1 then given end) over (partition by customerID
            order by createAt, kind, id rows between unbounded preceding and 1 preceding), 0), 0) lost_before
        from running_sums""",
    "payment_levels": "select *, billed + given - lost used from never_owed where kind = 1",
    "filled_by": """select b.id invoiceID, arg_min(p.id, {'a': p.createAt, 'b': p.id}) rdcID
        from never_owed b join payment_levels p on p.customerID = b.customerID
            and p.createAt >= b.createAt and (b.due < 0 or p.used >= b.billed)
        where b.kind = 0 group by b.id""",
}


def part_paid(t: Tables) -> Tables:
    paid = (F.col("totalPrice") * F.lit(Decimal("0.1"))).cast(S.MONEY)
    return t.replaced(invoices=t.invoices.withColumn("totalPay", paid))


add(
    "allocate_in_time",
    lambda t: allocation.allocate_in_time(part_paid(t), t.early_payments),
    f"""select b.id invoiceID, b.customerID, b.createAt, b.due, cast(pays as {M}) pays,
        cast(totalPay + pays as {M}) totalPay, case when rdcID is null then '0' else '1' end wasl, rdcID
    from (select id, customerID, createAt, due, case when due < 0 then case when rdcID is null then 0 else due end
            else least(due, greatest(coalesce(spent, 0) - (billed - due), 0)) end pays, rdcID
        from never_owed left join filled_by on id = invoiceID
        left join (select customerID, max(used) spent from payment_levels group by customerID) using (customerID)
        where kind = 0) b join part_paid on b.id = part_paid.invoiceID""",
    **IN_TIME,
)
add(
    "unused_money",
    lambda t: allocation.unused_money(part_paid(t), t.early_payments),
    f"""select id rdcID, customerID, amount, cast(lost - lost_before as {M}) unused from never_owed
    where kind = 1""",
    **IN_TIME,
)
add(
    "settle_listed",
    allocation.settle_listed,
    f"""select invoiceID, invoices.customerID,
        cast(case when last is not null then totalPrice - initialPay else totalPay end as {M}) totalPay,
        case when last is not null then '1' else wasl end wasl, coalesce(last, rdcID) rdcID
    from invoices left join (select invoiceID, arg_max(rdcID, {{'a': createAt, 'b': rdcID}}) last
        from listed group by invoiceID) using (invoiceID)""",
)
add(
    "effective_price",
    lambda t: pricing.effective_price(t, PROMO_DAY),
    f"""select itemID, itemCode, coalesce(price, items.itemPriceRetail) effectivePrice, dID
    from items left join (select itemID, arg_max(priceAfterDiscount, {{'a': startDate, 'b': dID}}) price,
            arg_max(dID, {{'a': startDate, 'b': dID}}) dID
        from discounts where startDate <= date '{PROMO_DAY}' and endDate > date '{PROMO_DAY}'
        group by itemID) using (itemID)""",
)
add(
    "price_calendar",
    lambda t: pricing.price_calendar(t, "1997-01-10", "1997-03-05"),
    """select itemID, day, arg_max(priceAfterDiscount, {'a': startDate, 'b': dID}) effectivePrice,
        arg_max(dID, {'a': startDate, 'b': dID}) dID
    from discounts join (select date '1997-01-10' + n::int as day from range(55) r(n))
        on day >= startDate and day < endDate group by itemID, day""",
)
add(
    "price_pieces",
    lambda t: pricing.price_pieces(t),
    """select itemID, fromDate, max(toDate) toDate, dID, effectivePrice from (
        select *, min(day) over (partition by itemID, dID, day - n::int) fromDate,
            max(day + 1) over (partition by itemID, dID, day - n::int) toDate
        from (select *, row_number() over (partition by itemID, dID order by day) n from won))
    group by itemID, fromDate, dID, effectivePrice""",
    won="""select itemID, cast(day as date) as day, arg_max(dID, {'a': startDate, 'b': dID}) dID,
        arg_max(priceAfterDiscount, {'a': startDate, 'b': dID}) effectivePrice
        from (select *, unnest(range(startDate, endDate, interval 1 day)) as day from discounts)
        group by itemID, day""",
)
add(
    "sold_at_discount",
    lambda t: pricing.prices_on(
        t, t.stock.filter(F.col("sourceType") == "s").select("sourceID", "itemID", "createAt"), "createAt"
    ).filter(F.col("dID").isNotNull()),
    """select sourceID, s.itemID, s.createAt, arg_max(priceAfterDiscount, {'a': startDate, 'b': dID}) effectivePrice,
        arg_max(dID, {'a': startDate, 'b': dID}) dID
    from stock s join discounts d on s.itemID = d.itemID and cast(s.createAt as date) >= startDate
        and cast(s.createAt as date) < endDate
    where sourceType = 's' group by all""",
)
add(
    "discount_states",
    lambda t: pricing.discount_states(t, PROMO_DAY),
    f"""select dID, itemID, startDate, endDate, case when startDate > date '{PROMO_DAY}' then 'waiting'
        when endDate > date '{PROMO_DAY}' then 'started' else 'ended' end state from discounts""",
)
add(
    "merge_invoice_lines",
    lambda t: changes.merge_invoice_lines(t, t.add_events),
    """select invoiceID, itemID, cast(packs * perUnit + single as bigint) qty,
        case when first_whole then itemPriceWhole else itemPriceRetail end productPrice, costPrice, unitID
    from items join (select l_orderkey invoiceID, l_partkey itemID,
            count(*) filter (cast(l_quantity as int) % 2 = 1) packs,
            count(*) filter (cast(l_quantity as int) % 2 = 0) single,
            arg_min(cast(l_quantity as int) % 2 = 1, {'a': cast(l_shipdate as date), 'b': l_linenumber * 2 + cast(l_quantity as int) % 2}) first_whole
        from lineitem where l_returnflag in ('N', 'R') group by all) using (itemID)""",
)
EVENT_SQL = {
    "evented": f"""select user_id invoiceID, event_id % 5 itemID, event_id seq,
        case when event_type = 'signup' then 'add' when event_type = 'view' then 'inc'
            when event_type = 'click' then 'dec'
            when event_type = 'purchase' and event_id % 2 = 0 then 'qty'
            when event_type = 'purchase' then 'price' when event_id % 10 = 0 then 'delete'
            else 'cost' end kind,
        event_id % 20 + 1 qty, amount price, cast(amount * cast(0.5 as decimal(4,2)) as {M}) cost
        from valued""",
    "alive": """select * from (select *, max(seq) filter (kind = 'delete')
        over (partition by invoiceID, itemID) gone from evented)
        where kind <> 'delete' and (gone is null or seq > gone)""",
    "opened": """select * from (select *, min(seq) filter (kind = 'add')
        over (partition by invoiceID, itemID) born from alive) where seq >= born""",
    "placed": """select *, max(seq) filter (kind = 'qty') over (partition by invoiceID, itemID) at_qty
        from opened""",
    "folded": """select invoiceID, itemID,
        cast(coalesce(arg_max(qty, seq) filter (kind = 'qty'), 0) + coalesce(sum(case kind when 'add' then qty
            when 'inc' then 1 when 'dec' then -1 else 0 end) filter (at_qty is null or seq > at_qty), 0)
            as bigint) qty,
        coalesce(arg_max(price, seq) filter (kind = 'price'), arg_min(price, seq)) productPrice,
        coalesce(arg_max(cost, seq) filter (kind = 'cost'), arg_min(cost, seq)) costPrice
        from placed group by invoiceID, itemID""",
}
add(
    "apply_line_events",
    lambda t: changes.apply_line_events(t.line_events),
    "select * from folded",
    **EVENT_SQL,
)
add(
    "document_totals",
    lambda t: changes.document_totals(changes.apply_line_events(t.line_events)),
    f"""select invoiceID, cast(sum(qty * productPrice) as {T}) totalPrice, count(*) noOfItem
    from folded group by invoiceID""",
    **EVENT_SQL,
)
add(
    "apply_dimension_changes",
    lambda t: changes.apply_changes(
        t.customer_log,
        "customerID",
        ["customerName", "phoneNumber", "address", "activeStatus"],
        full=["customerName", "phoneNumber", "address"],
    ),
    """select customerID,
        arg_max_null(customerName, seq) filter (op = 'insert' or op = 'update' or customerName is not null)
            customerName,
        arg_max_null(phoneNumber, seq) filter (op = 'insert' or op = 'update' or phoneNumber is not null)
            phoneNumber,
        arg_max_null(address, seq) filter (op = 'insert' or op = 'update' or address is not null) address,
        arg_max_null(activeStatus, seq) filter (op = 'insert' or (op <> 'delete' and activeStatus is not null))
            activeStatus
    from logged group by customerID
    having max(seq) filter (op = 'insert') > coalesce(max(seq) filter (op = 'delete'), -2)""",
    logged="""select customerID, -1 seq, 'insert' op, customerName, phoneNumber, address, activeStatus
        from customers union all select user_id + 1, event_id,
        case when event_type = 'click' then 'update' when event_type in ('view', 'purchase') then 'patch'
            when event_type = 'signup' and event_id % 20 = 0 then 'insert'
            when event_type = 'error' and event_id % 20 = 0 then 'delete' else 'patch' end,
        case when event_type in ('click', 'signup') then concat('Party', event_id) end,
        case when event_type in ('click', 'signup') then concat('07', event_id) end,
        case when event_type = 'signup' then concat('road ', event_id) end,
        case when event_type = 'view' then '0'
            when event_type in ('purchase', 'click', 'signup') then '1' end from events""",
)
add(
    "repost_changed",
    lambda t: changes.repost_invoices(t, t.invoice_log),
    """select s.* from stock s where not (sourceType in ('s', 'rs') and sourceID in (
        select o_orderkey from orders where o_orderpriority = '3-MEDIUM'))
    union all
    select invoiceID, case when invoiceID % 2 = 0 then 'rs' else stockType end, itemID,
        (case when invoiceID % 2 = 0 or stockType <> 's' then qty else -qty end)::int, productPrice,
        costPrice, case when invoiceID % 2 = 0 or stockType <> 's' then expiryDate end, createAt
    from invoice_item join invoices using (invoiceID)
    join orders on o_orderkey = invoiceID and o_orderpriority = '3-MEDIUM' and o_orderstatus <> 'P'
    where sellStatus = '1'""",
)

EDITED = "select o_orderkey from orders where o_orderpriority = '3-MEDIUM'"
EDITED_HEADS = """select invoices.* replace (cast(totalPrice * 2 as decimal(18,4)) as totalPrice,
        totalPrice as initialPay, case when invoiceID % 2 = 0 then 'rs' else stockType end as stockType)
    from invoices join orders on o_orderkey = invoiceID
    where o_orderpriority = '3-MEDIUM' and o_orderstatus <> 'P' and sellStatus = '1'"""
add(
    "repost_invoice_accounts",
    lambda t: changes.repost_invoice_accounts(t, t.invoice_log),
    f"""select * from transactions where not (sourceType in ('s', 'rs') and sourceID in ({EDITED}))
    union all
    select invoiceID, stockType, customerID, 'c', customerName,
        cast(case when stockType = 's' then -totalPrice else totalPrice end as {M}),
        cast(case when stockType = 's' then initialPay + totalPayIQD * cast(0.001 as decimal(4,3))
            else 0 end as {C}), totalPayIQD, invoiceType, userIDUpdate, edited.createAt
    from edited join customers using (customerID) where customerID <> 1""",
    edited=EDITED_HEADS,
)
add(
    "repost_invoice_cash",
    lambda t: changes.repost_invoice_cash(t, t.invoice_log),
    f"""select * from box where not ("type" in ('s', 'rs') and sourceID in ({EDITED}))
    union all
    select cast(1 as bigint), invoiceID,
        cast(case when stockType = 's' then initialPay else -initialPay end as {M}),
        cast(case when stockType = 's' then totalPayIQD else -totalPayIQD end as decimal(18,2)), stockType,
        case when stockType = 's' then concat(customerName, '  ', invoiceID) else customerName end,
        userIDUpdate, edited.createAt from edited left join customers using (customerID)""",
    edited=EDITED_HEADS,
)
add(
    "repost_expenses",
    lambda t: changes.repost_expenses(t, t.expense_log),
    f"""select * replace (cast(case when "type" = 'exp' and value < 10 then -3 * v.amount
        else box.amount end as {M}) as amount) from box
    left join (select event_id, value, amount from valued where event_type = 'error') v
        on "type" = 'exp' and event_id = sourceID
    where value is null or value <= 50""".replace("select * replace", "select box.* replace"),
)

# One kind of document and ledger: its log, the fixture's edits in SQL, the ledger, and the twin of its rule.
REPOSTED = {
    "purchase_stock": ("purchase_log", "purchases", "purchaseID", "stock", "purchase_stock", "'p', 'rp'"),
    "purchase_account": (
        "purchase_log", "purchases", "purchaseID", "transactions", "purchase_account", "'p', 'rp'"
    ),
    "purchase_cash": ("purchase_log", "purchases", "purchaseID", "box", "purchase_box", "'p', 'rp'"),
    "disposal_stock": ("disposal_log", "disposals", "disposalID", "stock", "disposal_stock", "'d'"),
    "supplier_repayment_account": (
        "repayment_log", "return_debt", "rdID", "transactions", "repayment_account", "'rdp'"
    ),
    "supplier_repayment_cash": ("repayment_log", "return_debt", "rdID", "box", "repayment_box", "'rdp'"),
    "customer_repayment_account": (
        "customer_repayment_log", "return_debt_customer", "rdcID", "old_transactions",
        "customer_repayment_account", "'rds'",
    ),
    "customer_repayment_cash": (
        "customer_repayment_log", "return_debt_customer", "rdcID", "old_box", "customer_repayment_box",
        "'rds'",
    ),
    "customer_opening": ("customer_opening_log", "customers", "customerID", "transactions", "opening", "'pdc'"),
    "supplier_opening": ("supplier_opening_log", "suppliers", "supplierID", "transactions", "opening", "'pds'"),
}
# Edits of the logs: what is patched where the key leaves 1 when divided by 4. With 3 the row goes.
EDITS = {
    "purchases": f"""cast(totalPrice * 2 as {M}) as totalPrice, totalPrice as amountPay,
        case when purchaseID % 8 = 1 then 'rp' else stockType end as stockType,
        case when purchaseID % 3 = 0 then createAt + interval 1 day else createAt end as createAt""",
    "disposals": f"qty + 1 as qty, cast(costPrice * 2 as {M}) as costPrice",
    "return_debt": f"cast(amountReturn * 2 as {M}) as amountReturn, cast(1 as {M}) as discount",
    "return_debt_customer": f"cast(amountReturn * 2 as {M}) as amountReturn, cast(1 as {M}) as discount",
    "customers": f"cast(previousDebt + 10 as {M}) as previousDebt",
    "suppliers": f"cast(previousBalance + 10 as {M}) as previousBalance",
}
# Ledgers that still hold repayments of customers, every other of them.
OLD = {
    "old_transactions": """select * from transactions union all select * from customer_repayment_account
        where sourceID % 2 = 1""",
    "old_box": "select * from box union all select * from customer_repayment_box where sourceID % 2 = 1",
}


def old_rows(t: Tables, ledger: str) -> DataFrame:
    odd = F.col("sourceID") % 2 == 1
    if ledger == "old_transactions":
        return t.transactions.unionByName(posting.post_customer_repayment_account(t).filter(odd))
    return posting.box_ledger(t).unionByName(posting.post_customer_repayment_box(t).filter(odd))


LEDGERS = {
    "stock": lambda t: t.stock,
    "transactions": lambda t: t.transactions,
    "box": posting.box_ledger,
    "old_transactions": lambda t: old_rows(t, "old_transactions"),
    "old_box": lambda t: old_rows(t, "old_box"),
}


def edited_rows(table: str, key: str, twin: str, codes: str) -> tuple[str, str, str, dict[str, str]]:
    """Parts of a twin: keys that changed, the type column, new rows, and the expressions they read."""
    stays = key in ("customerID", "supplierID")
    changed = f"select {key} from {table} where {key} % 4 {'= 1' if stays else 'in (1, 3)'}"
    extra = {f"edited_{table}": f"select * replace ({EDITS[table]}) from {table} where {key} % 4 = 1"}
    rule = TABLES[twin]
    if twin == "opening":
        rule = rule.split("union all")[0 if table == "customers" else 1]
    if twin == "purchase_account":
        extra["edited_paid"] = TABLES["purchase_paid"].replace("purchases", "edited_purchases")
        rule = rule.replace("purchase_paid", "edited_paid")
    rule = re.sub(rf"\b{table}\b", f"edited_{table}", rule)
    column = '"type"' if '"type"' in rule else "sourceType"
    return f"{column} in ({codes}) and sourceID in ({changed})", column, rule, extra


def add_reposted(name: str) -> None:
    log, table, key, ledger, twin, codes = REPOSTED[name]
    gone, column, rule, extra = edited_rows(table, key, twin, codes)
    if ledger in OLD:
        extra = {ledger: OLD[ledger], **extra}
        rule = f"select * from ({rule}) where sourceID % 2 = 1"
    add(
        f"repost_{name}",
        lambda t: reposting.reposted(t, getattr(t, log), reposting.KINDS[name], LEDGERS[ledger](t)),
        f"select * from {ledger} where not ({gone}) union all {rule}",
        **extra,
    )


for kind_name in REPOSTED:
    add_reposted(kind_name)
add(
    "repost_manual_cash",
    lambda t: reposting.reposted(t, t.cash_log, reposting.KINDS["manual_cash"], t.box_transaction),
    f"""select * from box_transaction where btID % 4 not in (1, 3)
    union all select * replace (case when btID % 8 = 1 then 'in' else "type" end as "type",
        cast(case when "type" = 'ex' or ("type" = 'out' and btID % 8 <> 1) then -3 * abs(amount)
            else 3 * abs(amount) end as {M}) as amount,
        case when btID % 8 = 1 or "type" in ('in', 'ex') then abs(amountIQD) else -abs(amountIQD) end
            as amountIQD) from box_transaction where btID % 4 = 1""",
)


def stored_ledger(t: Tables, ledger: str, kinds: list[str]) -> DataFrame:
    """A ledger stored by day, after the days that the logs of some kinds touch were replaced in it."""
    rows = LEDGERS[ledger](t)
    spark = rows.sparkSession
    days = DayLedger(spark, new_folder(spark, f"ledger-{ledger}"), rows.schema)
    days.write(rows)
    for name in kinds:
        reposting.repost_days(t, getattr(t, REPOSTED[name][0]), reposting.KINDS[name], days)
    return days.read().drop("day")


def add_stored(name: str, ledger: str, kinds: list[str]) -> None:
    gone, rules, extra = [], [], {}
    for kind in kinds:
        _, table, key, _, twin, codes = REPOSTED[kind]
        condition, _, rule, more = edited_rows(table, key, twin, codes)
        gone.append(f"({condition})")
        rules.append(rule)
        extra |= more
    body = f"select * from {ledger} where not ({' or '.join(gone)})"
    add(name, lambda t: stored_ledger(t, ledger, kinds), " union all ".join([body, *rules]), **extra)


add_stored("repost_days_stock", "stock", ["purchase_stock", "disposal_stock"])
add_stored(
    "repost_days_accounts", "transactions",
    ["purchase_account", "supplier_repayment_account", "customer_opening", "supplier_opening"],
)
add_stored("repost_days_cash", "box", ["purchase_cash", "supplier_repayment_cash"])

# Lines after the fixture's edits, by key, lines, price column, and the twin's own lines.
def edited_lines_sql(key: str, lines: str, price: str, after_discount: str) -> dict[str, str]:
    place = f"({key} + itemID) % 11"
    kept = "shelfID, unitID, expiryDate" if lines == "invoice_item" else "discount"
    return {
        "one_event": f"""select {key}, itemID, {kept}, cast(case when {place} = 0 then qty + 1 when {place} = 1 then 9
                when {place} = 4 then qty - 1 else qty end as int) qty,
            case when {place} = 2 then cast(7.5 as {M}) else {price} end {price},
            case when {place} = 5 then cast(3.25 as {M}) else costPrice end costPrice
            from {lines} where {place} <> 3""".replace(
            "case when (purchaseID + itemID) % 11 = 2 then cast(7.5 as decimal(18,4)) else costAfterDisc end costAfterDisc,",
            "",
        ),
        "added_items": f"select distinct {key}, {key} % 10 + 1 itemID from {lines} where {key} % 3 = 0",
        "edited_all": f"""select {key}, itemID, {kept}, cast(coalesce(qty, 0) + case when a.{key} is null then 0
                else 2 end as int) qty, {after_discount}
            coalesce(costPrice, cast(4 as {M})) costPrice from one_event full join added_items a using ({key}, itemID)""",
    }


SALES_EDITED = edited_lines_sql(
    "invoiceID", "invoice_item", "productPrice", f"coalesce(productPrice, cast(11 as {M})) productPrice,"
)
PURCHASES_EDITED = edited_lines_sql(
    "purchaseID", "purchase_items", "costAfterDisc",
    f"cast(coalesce(costPrice, cast(4 as {M})) - coalesce(discount, 0) as {M}) costAfterDisc,",
)
TOTALS_EDITED = """select {key}, cast(sum(total) as {T}) totalChange from (
        select {key}, -qty * {price} total from {lines} union all select {key}, qty * {price} from edited_all)
        group by {key}"""


def edited_twin(lines: str) -> str:
    """The twin of a stock rule over the edited lines."""
    rule = TABLES["sales_stock" if lines == "invoice_item" else "purchase_stock"]
    return re.sub(rf"\b{lines}\b", "edited_all", rule)


def add_edited(name: str, side: line_edits.Side, events: str, edited: dict[str, str]) -> None:
    def deltas(t: Tables) -> DataFrame:
        return line_edits.line_deltas(t, side, getattr(t, events))

    def totals(t: Tables) -> DataFrame:
        return line_edits.total_deltas(t, side, deltas(t))

    codes = "'s', 'rs'" if side is line_edits.SALES else "'p', 'rp'"
    change = TOTALS_EDITED.format(key=side.key, price=side.price, lines=side.lines, T=T)
    heads = f"""select h.* replace (cast(totalPrice + coalesce(totalChange, 0) as {M}) as totalPrice)
        from {side.heads} h left join total_changes using ({side.key})
        where {side.key} not in (select {side.key} from {side.lines}) or {side.key} in (select {side.key} from edited_all)"""
    heads_only = {**edited, "total_changes": change, "edited_heads": heads}
    add(
        f"edit_{name}_stock",
        lambda t: line_edits.stock_after(t.stock, line_edits.stock_deltas(t, side, deltas(t))).drop("weight"),
        f"""select sourceID, sourceType, itemID, cast(sum(qty) as int) qty, itemPrice, costPrice, expiryDate, createAt
        from (select * from stock where sourceType not in ({codes}) union all {edited_twin(side.lines)})
        group by all""",
        **edited,
    )
    add(
        f"edit_{name}_totals",
        lambda t: line_edits.heads_after(t, side, totals(t)).select(side.key, "totalPrice"),
        f"select {side.key}, totalPrice from edited_heads",
        **heads_only,
    )
    account = "sales_account" if side is line_edits.SALES else "purchase_account"
    rule = TABLES[account].replace("purchase_paid", "edited_paid")
    more = {"edited_paid": TABLES["purchase_paid"].replace("from purchases", "from edited_heads")}
    add(
        f"edit_{name}_accounts",
        lambda t: line_edits.accounts_after(
            t.transactions, line_edits.account_deltas(t, side, totals(t))
        ).drop("weight"),
        f"select * from transactions where sourceType not in ({codes}) union all "
        + re.sub(r"\binvoices\b", "edited_heads", rule),
        **heads_only,
        **(more if account == "purchase_account" else {}),
    )


add_edited("sales", line_edits.SALES, "sales_edits", SALES_EDITED)
add_edited("purchases", line_edits.PURCHASES, "purchase_edits", PURCHASES_EDITED)

# --- Closing, items, and the narrow forms of reports ------------------------------

add(
    "close_invoices",
    lambda t: changes.close_invoices(t, t.closings),
    f"""select invoices.* replace (
        case when c then case when invoiceID % 10 = 1 then 1 else customerID end else customerID end as customerID,
        cast(case when c then totalPrice * 2 else totalPrice end as {M}) as totalPrice,
        cast(case when not c then initialPay when invoiceID % 4 = 1 then totalPrice else 0 end as {M}) as initialPay,
        cast(case when c then invoiceID % 3 * 1000 else totalPayIQD end as decimal(18,2)) as totalPayIQD,
        cast(case when c then 0 else discount end as {M}) as discount,
        case when c then case when invoiceID % 6 = 1 then 'rs' else 's' end else stockType end as stockType,
        case when c then '1' else sellStatus end as sellStatus,
        case when not c then invoiceType when invoiceID % 14 = 1 or invoiceID % 4 <> 1 then 'c' else 'd' end
            as invoiceType,
        case when not c then wasl when invoiceID % 14 = 1 or invoiceID % 4 <> 1 or invoiceID % 8 = 1 then '1'
            else '0' end as wasl,
        case when c then invoiceID % 25 else userIDUpdate end as userIDUpdate)
    from (select *, sellStatus = '0' and invoiceID % 2 = 1 c from invoices) invoices""".replace(
        "select invoices.* replace", "select invoices.* exclude (c) replace"
    ),
)
add(
    "apply_item_changes",
    lambda t: changes.item_changes(t.item_log, [c for c in t.items.columns if c != "itemID"]),
    f"""select items.* replace (
        case when itemID % 6 = 1 then concat(itemName, ' new') else itemName end as itemName,
        case when itemID % 6 = 1 then null else categoryID end as categoryID,
        case when itemID % 6 = 1 then null else brandID end as brandID,
        case when itemID % 6 = 1 then null else unitID end as unitID,
        case when itemID % 6 = 1 then 1 else greatest(perUnit, 1) end as perUnit,
        cast(case when itemID % 4 = 1 and itemID % 6 <> 1 then itemPriceRetail * 2 else itemPriceRetail end as {M})
            as itemPriceRetail,
        cast(case when itemID % 4 = 1 and itemID % 6 <> 1 then itemPriceWhole * 2 else itemPriceWhole end as {M})
            as itemPriceWhole,
        case when itemID % 6 = 1 then '1' else hideInStock end as hideInStock,
        case when itemID % 6 = 1 then '0' else showButton end as showButton,
        case when itemID % 18 = 1 then '1' when itemID % 9 = 1 then '0' else deleteStatus end as deleteStatus)
    from items""",
)
add(
    "partner_statement_counted",
    lambda t: parties.partner_statement_counted(t, FIRST, LAST),
    f"""select sourceID, sourceType, accountName, accountType, totalPrice, totalPay, totalPayIQD,
        transactionType, x.createAt, pairs from transactions x
    join (select supplierName, count(*) pairs from suppliers join customers
        on lower(trim(supplierName)) = lower(trim(customerName)) group by supplierName) p on supplierName = accountName
    where cast(x.createAt as date) between date '{FIRST}' and date '{LAST}'""",
)


def add_narrow(name: str, whole: str, build: Callable[[Tables], DataFrame], condition: str) -> None:
    """A report asked for one key, against its twin for all keys."""
    QUERIES[name] = Query(build, f"select * from ({QUERIES[whole].oracle}) where {condition}")


add_narrow("in_stock_detail_of_item", "in_stock_detail", lambda t: stock_ops.in_stock_detail(t, 7), "itemID = 7")
add_narrow("customer_netting_of_one", "customer_netting", lambda t: parties.customer_netting(t, 12), "customerID = 12")
add_narrow("box_balance_of_shelf", "box_balance", lambda t: cash.box_balance(t, 2), "shelfID = 2")
QUERIES["box_balance_of_shelf"] = Query(
    QUERIES["box_balance_of_shelf"].build,
    f"select amount, amountIQD from ({QUERIES['box_balance_of_shelf'].oracle})",
)
add_narrow("button_items_of_category", "button_items", lambda t: stock_ops.button_items(t, 4), "categoryID = 4")
add_narrow(
    "open_debt_invoices_of_customer", "open_debt_invoices", lambda t: parties.open_debt_invoices(t, 5), "customerID = 5"
)
add_narrow(
    "open_debt_purchases_of_supplier", "open_debt_purchases", lambda t: parties.open_debt_purchases(t, 3),
    "supplierID = 3",
)
add_narrow(
    "purchase_lines_of_one", "purchase_lines",
    lambda t: purchases.purchase_lines(t, t.purchase_items.agg(F.min("purchaseID")).first()[0]),
    f"purchaseID = (select min(purchaseID) from ({QUERIES['purchase_lines'].oracle}))",
)
add_narrow(
    "purchase_total_differs", "purchase_total_recompute",
    lambda t: purchases.purchase_total_recompute(
        t.replaced(purchases=t.purchases.withColumn("totalPrice", F.when(F.col("purchaseID") % 2 == 0, 0).otherwise(F.col("totalPrice")).cast(S.MONEY))),
        only_changed=True,
    ),
    "true",
)
QUERIES["purchase_total_differs"] = Query(
    QUERIES["purchase_total_differs"].build,
    f"""select * replace (cast(0 as {M}) as totalPrice, true as differs)
    from ({QUERIES["purchase_total_recompute"].oracle}) where purchaseID % 2 = 0 and lineTotal <> 0""",
)
add_narrow(
    "expense_register_newest_first", "expense_register",
    lambda t: cash.expense_register(t, EVENT_FIRST, EVENT_LAST, newest_first=True), "true",
)

# --- Streams ---------------------------------------------------------------------


@dataclass(frozen=True)
class StreamQuery:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str


def _posted(spark: SparkSession, folder: str) -> DataFrame:
    return streams.stream_post_stock(streams.as_line_events(streams.event_stream(spark, folder)))


def run_post_stock(spark: SparkSession, folder: str) -> DataFrame:
    rows = streams.append_to_files(_posted(spark, folder), spark)
    return rows.select("event_id", "sourceType", "itemID", "qty", "itemPrice")


def run_daily_sales(spark: SparkSession, folder: str) -> DataFrame:
    lines = streams.as_line_events(streams.event_stream(spark, folder))
    return streams.keep_latest(streams.stream_daily_sales(lines), ["day", "sourceType"], spark)


def run_low_stock(spark: SparkSession, folder: str) -> DataFrame:
    on_hand = streams.keep_latest(
        streams.stream_on_hand(_posted(spark, folder)), ["itemID"], spark
    )
    t = retail.load(spark, folder)
    return streams.low_stock(on_hand, t.items, t.stock.select("itemID", "qty"))


def run_alerts(spark: SparkSession, folder: str) -> DataFrame:
    t = retail.load(spark, folder)
    found = alerts.LowStockAlerts(spark, t.items, t.stock.select("itemID", "qty"))
    return found.drain(_posted(spark, folder)).drop("ts")


STREAMS = {
    "stream_alerts": StreamQuery(
        run_alerts,
        sql(
            """select itemID, event_id, case when after <= stockAlert then 'low' else 'enough' end kind,
                totalInStock, stockAlert
            from (select *, cast(after as bigint) totalInStock from running_stock)
            where (after <= stockAlert) <> (after - qty <= stockAlert)""",
            running_stock="""select moves.itemID, event_id, moves.qty, stockAlert, coalesce(opening, 0)
                + sum(moves.qty) over (partition by moves.itemID order by ts, event_id) as after
                from moves join items on items.itemID = moves.itemID and deleteStatus = '1'
                left join (select itemID, sum(qty) opening from stock group by itemID) o
                    on o.itemID = moves.itemID""",
        ),
    ),
    "stream_post_stock": StreamQuery(
        run_post_stock,
        sql("select event_id, sourceType, itemID, qty, amount itemPrice from moves"),
    ),
    "stream_daily_sales": StreamQuery(
        run_daily_sales,
        sql(
            f"""select cast(ts as date) as day, sourceType, cast(sum(amount) as {T}) total, count(*) n
            from moves group by all"""
        ),
    ),
    "stream_low_stock": StreamQuery(
        run_low_stock,
        sql(
            """select itemID, itemName, cast(coalesce(sum(qty), 0) as bigint) totalInStock
            from items left join
            (select itemID, qty from moves union all select itemID, qty from stock) using (itemID)
            where deleteStatus = '1'
            group by itemID, itemName, stockAlert having coalesce(sum(qty), 0) <= stockAlert"""
        ),
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def sized(spark: SparkSession, folder: str) -> SparkSession:
        return ready(spark, retail.size(spark, folder))

    def over_folder(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: query.build(retail.load(sized(spark, folder), folder))

    found = {name: over_folder(query) for name, query in QUERIES.items()}
    for name, query in STREAMS.items():
        found[name] = lambda spark, folder, run=query.run: run(sized(spark, folder), folder)
    return found


def oracle_sql() -> dict[str, str]:
    found = {name: query.oracle for name, query in QUERIES.items() if query.oracle}
    found.update({name: query.oracle for name, query in STREAMS.items()})
    return found
