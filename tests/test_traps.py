"""Small hand-made tables for the places where the rules surprise."""

import datetime as dt
from decimal import Decimal as D

from conftest import dicts, when

from tillbook.operators import cash, changes, parties, posting, pricing, sales
from tillbook.operators import stock as stock_ops

ITEM = {"deleteStatus": "1", "hideInStock": "1", "perUnit": 4, "unitID": 1, "stockAlert": 5}
USERS = [{"userID": 1, "userName": "ann", "fullName": "Ann"}, {"userID": 2, "userName": "ben"}]
UNITS = [{"unitID": 1, "unitName": "piece"}]


def stock_row(item, kind, qty, price=0, cost=0, day="2020-06-01", source=1, expiry=None):
    return {
        "sourceID": source, "sourceType": kind, "itemID": item, "qty": qty, "itemPrice": price,
        "costPrice": cost, "createAt": when(day), "expiryDate": expiry,
    }


def test_zero_rate_counts_as_no_amount(shop):
    day = when("2020-01-01")
    t = shop(
        expenses=[
            {"priceExpenseIQD": 1000, "priceExpenseUSD": 2, "dollarPrice": 0, "createAt": day},
            {"priceExpenseIQD": 1000, "priceExpenseUSD": 0, "dollarPrice": 500, "createAt": day},
        ]
    )
    row = dicts(sales.money_movement(t, "2020-01-01", "2020-01-01"))[0]
    assert row["totalExpenseDollar"] == D("4")
    assert row["totalSale"] == 0 and row["totalProfit"] == 0


def test_deleted_item_is_not_found_by_code_or_name(spark, shop):
    t = shop(
        items=[
            ITEM | {"itemID": 1, "itemCode": "A1", "itemName": "Tea", "deleteStatus": "0"},
            ITEM | {"itemID": 2, "itemCode": "B2", "itemName": "a1", "itemPriceWhole": 30},
            ITEM | {"itemID": 3, "itemCode": "c3", "itemName": "C3", "itemPriceRetail": 9},
        ],
        units=UNITS,
    )
    terms = spark.createDataFrame([("a1", True), ("C3", False)], "term string, whole boolean")
    found = {r["term"]: r for r in dicts(stock_ops.item_resolve(t, terms))}
    assert found["a1"]["itemID"] == 2 and found["a1"]["qty"] == 4
    assert found["a1"]["productPrice"] == 30
    # Code and name are the same text: still one row, one unit at retail.
    assert found["C3"]["qty"] == 1 and found["C3"]["productPrice"] == 9
    assert stock_ops.item_resolve(t, terms).count() == 2


def test_item_resolve_first_only(spark, shop):
    t = shop(
        items=[
            ITEM | {"itemID": 7, "itemCode": "x", "itemName": "Tea"},
            ITEM | {"itemID": 4, "itemCode": "y", "itemName": "X"},
        ],
        units=UNITS,
    )
    terms = spark.createDataFrame([("X", False)], "term string, whole boolean")
    assert [r["itemID"] for r in dicts(stock_ops.item_resolve(t, terms, first_only=True))] == [4]


def test_profit_with_and_without_disposals_and_two_kinds_of_loss(shop):
    t = shop(
        items=[ITEM | {"itemID": 1}],
        stock=[
            stock_row(1, "s", -2, price=10, cost=7),
            stock_row(1, "s", -1, price=5, cost=7, source=2),
            stock_row(1, "rs", 1, price=10, cost=12, source=3),
            stock_row(1, "d", -1, cost=7, source=4),
            stock_row(1, "p", 9, cost=7, source=5),
        ],
    )
    span = ("2020-01-01", "2020-12-31")
    movement = dicts(sales.money_movement(t, *span))[0]
    totals = dicts(sales.profit_totals(t, *span))[0]
    item = dicts(sales.profit_by_item(t, *span))[0]
    assert movement["totalProfit"] == 6 - 2 + 2
    assert totals["totalAll"] == movement["totalProfit"] - 7
    assert totals["totalDisposal"] == -7 and totals["totalLoss"] == -2
    # By item: all three kinds at or below cost, with the sign of the ledger.
    assert item["totalLoss"] == 2 - 2 + 7
    assert item["totalQtySale"] == 3
    by_source = {(r["sourceID"], r["sourceType"]): r for r in dicts(sales.profit_by_source(t, *span))}
    assert len(by_source) == 4 and by_source[(2, "s")]["totalLoss"] == -2
    assert by_source[(3, "rs")]["totalLoss"] == 0


def test_month_ignores_the_year_unless_given(shop):
    t = shop(
        items=[ITEM | {"itemID": 1, "itemName": "a"}, ITEM | {"itemID": 2, "itemName": "b"}],
        stock=[
            stock_row(1, "s", -3, day="2019-06-05"),
            stock_row(1, "s", -3, day="2020-06-05"),
            stock_row(2, "s", -4, day="2020-06-30"),
            stock_row(2, "s", -9, day="2020-07-01"),
        ],
    )
    assert [r["topSale"] for r in dicts(sales.top_items_month(t, 6))] == [6, 4]
    assert [r["itemID"] for r in dicts(sales.top_items_month(t, 6, year=2020))] == [2, 1]


def test_slow_items_include_never_stocked_and_deleted(shop):
    t = shop(
        items=[
            ITEM | {"itemID": 1}, ITEM | {"itemID": 2, "deleteStatus": "0"}, ITEM | {"itemID": 3},
        ],
        stock=[stock_row(1, "s", -11), stock_row(3, "s", -10), stock_row(3, "p", 50)],
    )
    assert [(r["itemID"], r["notSale"]) for r in dicts(sales.slow_items(t))] == [(2, 0), (3, 10)]


def test_in_stock_signs_and_missing_rows(shop):
    t = shop(
        items=[
            ITEM | {"itemID": 1}, ITEM | {"itemID": 2}, ITEM | {"itemID": 3, "hideInStock": "0"},
        ],
        units=UNITS,
        stock=[
            stock_row(1, "p", 10), stock_row(1, "rp", -2), stock_row(1, "s", -3),
            stock_row(1, "rs", 1), stock_row(1, "d", -1),
        ],
    )
    rows = {r["itemID"]: r for r in dicts(stock_ops.in_stock(t))}
    assert set(rows) == {1, 2}
    one = rows[1]
    assert [one[k] for k in ("totalInStock", "purchased", "returnPurchase", "sold", "returnSold", "disposal")] == [
        5, 10, 2, 3, 1, 1,
    ]
    assert rows[2]["totalInStock"] == 0
    # At the alert quantity is already lacking.
    assert {r["itemID"] for r in dicts(stock_ops.lack_in_stock(t))} == {1, 2, 3}
    counters = dicts(stock_ops.stock_counters(t, "2020-06-01"))[0]
    assert counters == {
        "numberOfItems": 3, "numberOfAllQtyItems": 5, "inToStock": 11, "outFromStock": -6,
    }
    moved = dicts(stock_ops.stock_movement(t, "2020-06-01", "2020-06-01"))[0]
    assert moved == {"inToStock": 11, "outFromStock": 5, "disposal": 1}


def test_stock_detail_by_expiry_and_zero_pack(shop):
    may, june = dt.date(2021, 5, 1), dt.date(2021, 6, 1)
    t = shop(
        items=[ITEM | {"itemID": 1}, ITEM | {"itemID": 2, "perUnit": 0}],
        stock=[
            stock_row(1, "rs", 3, expiry=may), stock_row(1, "rs", 2, expiry=june),
            stock_row(1, "p", 4), stock_row(2, "p", 4),
        ],
    )
    rows = {(r["itemID"], r["expiryDate"]): r for r in dicts(stock_ops.in_stock_detail(t))}
    assert len(rows) == 4
    assert rows[(1, may)]["totalInStockPerUnit"] == D("0.75")
    assert rows[(2, None)]["totalInStockPerUnit"] is None
    assert len(dicts(stock_ops.in_stock_detail(t, 2))) == 1


def test_sums_over_nothing(shop):
    t = shop()
    assert dicts(sales.invoice_day_totals(t, "2020-01-01")) == [{"totalCash": None, "totalDebt": None}]
    assert dicts(cash.expense_totals(t, "2020-01-01", "2020-01-02")) == [
        {"totalIQD": None, "totalUSD": None}
    ]
    assert dicts(cash.expense_day(t, "2020-01-01")) == [{"total": 0, "numberOfExpenses": 0}]
    assert dicts(cash.box_balance(t, 3)) == [{"amount": None, "amountIQD": None}]
    assert dicts(cash.box_balance(t)) == []
    week = dicts(sales.daily_sale_purchase(t, "2020-01-07"))[0]
    assert len(week) == 14 and set(week.values()) == {0}
    days = dicts(sales.sale_purchase_by_day(t, "2020-01-07"))
    assert len(days) == 7 and days[0]["day"] == dt.date(2020, 1, 7)


def test_netting_by_name_whatever_the_case_and_never_below_zero(shop):
    t = shop(
        users=USERS,
        customers=[
            {"customerID": 2, "customerName": "Sara", "previousDebt": 100, "userID": 1, "activeStatus": "1"},
            {"customerID": 3, "customerName": "Omar", "previousDebt": 10, "userID": 1, "activeStatus": "0"},
        ],
        suppliers=[
            {"supplierID": 5, "supplierName": " SARA", "previousBalance": 30, "activeStatus": "1"},
            {"supplierID": 6, "supplierName": "omar ", "previousBalance": 25, "activeStatus": "1"},
            {"supplierID": 7, "supplierName": "Lone", "previousBalance": 5, "activeStatus": "1"},
        ],
        return_debt_customer=[{"customerID": 2, "amountReturn": 20, "rdcID": 1}],
    )
    left = {r["customerID"]: r["totalRemain"] for r in dicts(parties.customer_netting(t))}
    assert left == {2: 50, 3: 0}
    right = {r["supplierID"]: r["totalRemain"] for r in dicts(parties.supplier_netting(t))}
    assert right == {5: 0, 6: 15, 7: 5}
    assert {r["customerID"]: r["totalRemain"] for r in dicts(parties.customers_with_debt(t))} == left
    assert [r["customerID"] for r in dicts(parties.customers_with_debt(t, active_only=True))] == [2]
    assert {r["supplierID"]: r["totalRemain"] for r in dicts(parties.suppliers_with_debt(t))} == right
    assert dicts(parties.customer_netting(t, 3))[0]["totalRemainSupplier"] == 25


def test_debt_counts_first_payment_and_repayments_once(shop):
    sold = {"stockType": "s", "sellStatus": "1", "dollarPrice": 1000, "totalPayIQD": 0, "totalPay": 40}
    t = shop(
        customers=[
            {"customerID": 1, "customerName": "Walk-in", "previousDebt": 0},
            {"customerID": 2, "customerName": "Sara", "previousDebt": 5},
        ],
        invoices=[
            sold | {"customerID": 2, "invoiceType": "d", "totalPrice": 100, "initialPay": 10},
            sold | {"customerID": 2, "invoiceType": "c", "totalPrice": 70, "initialPay": 70},
            sold | {"customerID": 2, "invoiceType": "d", "totalPrice": 9, "initialPay": 0, "sellStatus": "0"},
            sold | {"customerID": 2, "invoiceType": "c", "totalPrice": 8, "initialPay": 0, "stockType": "rs"},
            sold | {"customerID": 1, "invoiceType": "d", "totalPrice": 50, "initialPay": 0},
        ],
        return_debt_customer=[{"customerID": 2, "amountReturn": 40}],
    )
    rows = dicts(parties.customer_debt_list(t))
    assert [r["customerID"] for r in rows] == [2]
    assert rows[0]["totalRemainCustomer"] == 5 + 100 - (8 + 10 + 40)


def test_shared_names_repeat_statement_rows(shop):
    entry = {"accountName": "Sara", "accountType": "c", "createAt": when("2020-01-01")}
    t = shop(
        customers=[{"customerID": 2, "customerName": "Sara"}],
        suppliers=[{"supplierID": 1, "supplierName": "sara"}, {"supplierID": 2, "supplierName": "Sara"}],
        transactions=[
            entry | {"sourceID": 1}, entry | {"sourceID": 2, "accountName": "Nobody"},
        ],
    )
    assert [r["sourceID"] for r in dicts(parties.partner_statement(t, "2020-01-01", "2020-01-01"))] == [1, 1]
    assert dicts(parties.partner_names(t)) == [{"accountName": "Sara"}]


def test_same_user_rule(shop):
    day = when("2020-01-01")
    t = shop(
        users=USERS,
        items=[ITEM | {"itemID": 1, "userIDCreated": 1}],
        disposals=[
            {"disposalID": 1, "itemID": 1, "userID": 1, "createAt": day},
            {"disposalID": 2, "itemID": 1, "userID": 2, "createAt": day},
        ],
        customers=[{"customerID": 2, "customerName": "Sara", "userID": 2}],
        return_debt_customer=[
            {"rdcID": 1, "customerID": 2, "userID": 1, "createAt": day},
            {"rdcID": 2, "customerID": 2, "userID": 2, "createAt": day, "shelfID": 9},
        ],
    )
    span = ("2020-01-01", "2020-01-01")
    assert [r["disposalID"] for r in dicts(stock_ops.disposal_register(t, *span))] == [1]
    assert stock_ops.disposal_register(t, *span, same_user=False).count() == 2
    assert [r["rdcID"] for r in dicts(parties.customer_repayments(t, *span))] == [2]
    assert parties.customer_repayments(t, *span, same_user=False).count() == 2
    assert parties.customer_repayments(t, *span, require_shelf=True).count() == 0


def test_discount_reverts_on_its_end_day_and_latest_start_wins(shop):
    day = dt.date
    t = shop(
        items=[ITEM | {"itemID": 1, "itemPriceRetail": 100}],
        discounts=[
            {"dID": 1, "itemID": 1, "priceAfterDiscount": 90, "startDate": day(2020, 1, 1), "endDate": day(2020, 1, 10)},
            {"dID": 2, "itemID": 1, "priceAfterDiscount": 80, "startDate": day(2020, 1, 5), "endDate": day(2020, 1, 7)},
            {"dID": 3, "itemID": 1, "priceAfterDiscount": 70, "startDate": day(2020, 1, 5), "endDate": day(2020, 1, 6)},
            {"dID": 4, "itemID": 1, "priceAfterDiscount": 1, "startDate": day(2020, 1, 8), "endDate": day(2020, 1, 8)},
        ],
    )
    expected = {1: 90, 4: 90, 5: 70, 6: 80, 7: 90, 9: 90, 10: 100}
    for number, price in expected.items():
        got = dicts(pricing.effective_price(t, day(2020, 1, number)))[0]["effectivePrice"]
        assert got == price, number
    calendar = {r["day"].day: r["effectivePrice"] for r in dicts(pricing.price_calendar(t, "2020-01-04", "2020-01-12"))}
    assert calendar == {4: 90, 5: 70, 6: 80, 7: 90, 8: 90, 9: 90}


def test_id_lists(shop):
    t = shop(
        return_debt_customer=[
            {"rdcID": 1, "invoiceNumbers": "5,6"}, {"rdcID": 2, "invoiceNumbers": ""},
            {"rdcID": 3}, {"rdcID": 4, "invoiceNumbers": " 7 ,5"},
        ]
    )
    assert sorted((r["rdcID"], r["invoiceID"]) for r in dicts(changes.listed_invoices(t))) == [
        (1, 5), (1, 6), (4, 5), (4, 7),
    ]
    left = {r["rdcID"]: r["invoiceNumbers"] for r in dicts(changes.unlist_invoice(t, 5))}
    assert left == {1: "6", 2: None, 3: None, 4: "7"}


def test_debt_of_listed_invoices(spark, shop):
    t = shop(
        invoices=[
            {"invoiceID": 1, "totalPrice": 10, "initialPay": 4, "totalPay": 1},
            {"invoiceID": 2, "totalPrice": 10, "initialPay": 20, "totalPay": 0},
            {"invoiceID": 3, "totalPrice": 99, "initialPay": 0, "totalPay": 0},
        ]
    )
    ids = spark.createDataFrame([(1,), (2,), (2,), (8,)], "invoiceID bigint")
    assert dicts(parties.debt_of_invoices(t, ids)) == [{"total": D("-5")}]
    none = spark.createDataFrame([(8,)], "invoiceID bigint")
    assert dicts(parties.debt_of_invoices(t, none)) == [{"total": None}]


def test_posting_signs(shop):
    day = when("2020-01-01")
    head = {
        "sellStatus": "1", "dollarPrice": 1000, "invoiceType": "d", "createAt": day, "totalPrice": 10,
        "totalPayIQD": 2000, "userIDUpdate": 1,
    }
    t = shop(
        customers=[{"customerID": 2, "customerName": "Sara"}],
        suppliers=[{"supplierID": 1, "supplierName": "Lone"}],
        invoices=[
            head | {"invoiceID": 1, "customerID": 2, "stockType": "s", "initialPay": 0},
            head | {"invoiceID": 2, "customerID": 2, "stockType": "rs", "initialPay": 3},
            head | {"invoiceID": 3, "customerID": 1, "stockType": "s", "initialPay": 1},
            head | {"invoiceID": 4, "customerID": 2, "stockType": "s", "initialPay": 0, "sellStatus": "0"},
        ],
        invoice_item=[
            {"invoiceID": n, "itemID": 1, "qty": 2, "productPrice": 5, "costPrice": 4, "shelfID": 1,
             "expiryDate": dt.date(2021, 1, 1)}
            for n in (1, 2, 3, 4)
        ],
        purchases=[
            {"purchaseID": 1, "supplierID": 1, "stockType": "p", "amountPay": 4, "amountPayIQD": 3000,
             "dollarPrice": 1000, "totalPrice": 9, "referenceNo": "R", "createAt": day},
            {"purchaseID": 2, "supplierID": 1, "stockType": "rp", "amountPay": 4, "amountPayIQD": 0,
             "dollarPrice": 0, "totalPrice": 9, "referenceNo": "R", "createAt": day},
            {"purchaseID": 3, "supplierID": 1, "stockType": "p", "amountPay": 4, "amountPayIQD": 5,
             "dollarPrice": 0, "totalPrice": 9, "referenceNo": "R", "createAt": day},
        ],
        purchase_items=[
            {"purchaseID": 1, "itemID": 1, "qty": 3, "costPrice": 3},
            {"purchaseID": 2, "itemID": 1, "qty": 3, "costPrice": 3},
        ],
        disposals=[{"disposalID": 1, "itemID": 1, "qty": 2, "costPrice": 3, "createAt": day}],
        return_debt=[
            {"rdID": 1, "supplierID": 1, "amountReturn": 11, "amountReturnIQD": 2000, "discount": 1,
             "dollarPrice": 1000, "purchaseNumbers": "1,3"}
        ],
        expenses=[{"expenseID": 1, "priceExpenseUSD": 5, "priceExpenseIQD": 7}],
        cash_entries=[
            {"btID": n, "type": kind, "amount": 5, "amountIQD": -3}
            for n, kind in enumerate(["in", "out", "ex"])
        ],
    )
    stock = {(r["sourceType"], r["sourceID"]): r for r in dicts(posting.stock_ledger(t))}
    assert {k: r["qty"] for k, r in stock.items()} == {
        ("s", 1): -2, ("rs", 2): 2, ("s", 3): -2, ("p", 1): 3, ("rp", 2): -3, ("d", 1): -2,
    }
    assert stock[("s", 1)]["expiryDate"] is None and stock[("rs", 2)]["expiryDate"] is not None
    assert stock[("d", 1)]["itemPrice"] == 0
    box = {(r["type"], r["sourceID"]): (r["amount"], r["amountIQD"]) for r in dicts(posting.post_sales_box(t))}
    assert box == {("s", 1): (0, 2000), ("rs", 2): (-3, -2000), ("s", 3): (1, 2000)}
    party = {(r["sourceType"], r["sourceID"]): (r["totalPrice"], r["totalPay"]) for r in dicts(posting.party_ledger(t))}
    assert party[("s", 1)] == (-10, 2) and party[("rs", 2)] == (10, 0) and ("s", 3) not in party
    assert party[("p", 1)] == (9, 7) and party[("rp", 2)] == (-9, 0)
    assert party[("p", 3)] == (9, 4)
    assert party[("rdp", 1)][0] == -11
    bought = {(r["type"], r["sourceID"]): r["amount"] for r in dicts(posting.post_purchase_box(t))}
    assert bought[("p", 1)] == -4 and bought[("rp", 2)] == 4
    # 10 dollars and 2000 IQD were handed over, one dollar of discount taken off.
    repaid = dicts(posting.post_repayment_box(t))[0]
    assert (repaid["amount"], repaid["amountIQD"]) == (-10, -2000)
    paid = {r["purchaseID"]: r["debtStatus"] for r in dicts(posting.purchases_after_repayment(t))}
    assert paid[1] == "1" and paid[3] == "1" and paid[2] is None
    out = dicts(posting.post_expense(t))[0]
    assert (out["amount"], out["amountIQD"], out["note"]) == (-5, -7, posting.EXPENSE_NOTE)
    manual = {r["type"]: (r["amount"], r["amountIQD"]) for r in dicts(posting.post_cash(t))}
    assert manual == {"in": (5, -3), "out": (-5, 3), "ex": (5, -3)}
    shelves = {r["sourceID"]: r["amount"] for r in dicts(posting.sales_by_shelf(t))}
    assert shelves == {1: 10, 2: -10, 3: 10}
    assert posting.box_ledger(t).count() == 3 + 3 + 1 + 1 + 3


def test_mirror_partners_skips_known_names(shop):
    t = shop(
        customers=[
            {"customerID": 2, "customerName": "Sara", "doesSupplier": "1"},
            {"customerID": 3, "customerName": "Omar", "doesSupplier": "1"},
            {"customerID": 4, "customerName": "Nina", "doesSupplier": "0"},
        ],
        suppliers=[{"supplierID": 1, "supplierName": "SARA"}],
    )
    assert [r["supplierName"] for r in dicts(posting.mirror_partners(t))] == ["Omar"]


def test_merged_lines_take_the_first_price(spark, shop):
    t = shop(items=[ITEM | {"itemID": 1, "itemPriceRetail": 5, "itemPriceWhole": 16}])
    adds = spark.createDataFrame(
        [(1, 1, 10, "0"), (1, 1, 5, "1"), (1, 1, 20, "0"), (2, 1, 1, "0")],
        "invoiceID bigint, itemID bigint, seq bigint, whole string",
    )
    rows = {r["invoiceID"]: (r["qty"], r["productPrice"]) for r in dicts(changes.merge_invoice_lines(t, adds))}
    assert rows == {1: (6, 16), 2: (1, 5)}
