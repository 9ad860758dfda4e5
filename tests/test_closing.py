"""Closing invoices, items after a log, and statements that count pairs."""

from decimal import Decimal as D

from conftest import dicts, when
from pyspark.sql import functions as F

from tillbook.operators import cash, changes, parties

CLOSING = (
    "invoiceID bigint, seq bigint, customerID bigint, totalPrice decimal(18,4), initialPay decimal(18,4),"
    " totalPayIQD decimal(18,2), discount decimal(18,4), stockType string, invoiceType string, userIDUpdate bigint,"
    " totalPay decimal(18,4)"
)


def test_cash_and_fully_paid_invoices_are_settled(spark, shop):
    t = shop(invoices=[{"invoiceID": n, "sellStatus": "0", "wasl": "0", "totalPrice": 5, "invoiceType": "d"} for n in range(1, 7)])
    rows = [
        (1, 1, 7, D(50), D(10), None, None, "s", "c", 3, D(0)),
        (2, 1, 7, D(50), D(10), None, None, "s", "d", 3, D(50)),
        (3, 1, 7, D(50), D(10), None, None, "s", "d", 3, D(49)),
        (4, 1, None, None, None, None, None, None, None, None, None),
        (5, 1, 7, D(50), None, None, None, "rs", "c", 3, None),
        (5, 2, 8, D(60), None, None, None, "rs", "d", 4, None),
        (99, 1, 7, D(50), D(10), None, None, "s", "c", 3, D(0)),
    ]
    out = {r["invoiceID"]: r for r in dicts(changes.close_invoices(t, spark.createDataFrame(rows, CLOSING)))}
    assert set(out) == set(range(1, 7))
    assert {n: (r["wasl"], r["sellStatus"]) for n, r in out.items()} == {
        1: ("1", "1"), 2: ("1", "1"), 3: ("0", "1"), 4: ("1", "1"), 5: ("0", "1"), 6: ("0", "0"),
    }
    assert (out[4]["customerID"], out[4]["totalPrice"], out[4]["stockType"], out[4]["invoiceType"]) == (1, 0, "s", "c")
    assert (out[5]["customerID"], out[5]["totalPrice"], out[5]["invoiceType"]) == (8, 60, "d")
    assert out[6]["totalPrice"] == 5
    # What is settled is no open debt.
    closed = t.replaced(invoices=changes.close_invoices(t, spark.createDataFrame(rows, CLOSING)))
    assert [r["invoiceID"] for r in dicts(parties.open_debt_invoices(closed))] == [3]


def test_a_deleted_item_keeps_its_row_and_comes_back(spark):
    columns = ["itemName", "perUnit", "hideInStock", "showButton", "deleteStatus", "itemPriceRetail"]
    schema = "itemID bigint, seq bigint, op string, itemName string, perUnit int, hideInStock string, showButton string, deleteStatus string, itemPriceRetail decimal(18,4), categoryID bigint, itemCode string, brandID bigint, shelfID bigint, unitID bigint, costPrice int, itemPriceWhole int, stockAlert int, note string"

    def row(item, seq, op, name=None, unit=None, hide=None, button=None, status=None, price=None):
        return (item, seq, op, name, unit, hide, button, status, price, *[None] * 9)

    rows = [
        row(1, 0, "insert", "tea", 0, "0", "1", "1", D(5)), row(1, 1, "patch", price=D(7)), row(1, 2, "delete", "gone"),
        row(2, 0, "insert", "nut", 6, "0", "1", "1", D(5)), row(2, 2, "delete"), row(2, 3, "patch", status="1"),
        row(3, 0, "insert", "oil", 6, "0", "1", "1", D(5)), row(3, 1, "update", "oil 2", -3, price=D(9)),
        row(4, 5, "patch", price=D(1)), row(4, 6, "delete"),
    ]
    out = {r["itemID"]: r for r in dicts(changes.item_changes(spark.createDataFrame(rows, schema), columns))}
    assert {n: (r["itemName"], r["perUnit"], r["deleteStatus"], r["itemPriceRetail"]) for n, r in out.items()} == {
        1: ("tea", 1, "0", 7), 2: ("nut", 6, "1", 5), 3: ("oil 2", 1, "1", 9),
    }
    assert (out[3]["hideInStock"], out[3]["showButton"], out[1]["hideInStock"]) == ("1", "0", "0")


def test_a_statement_counts_pairs_and_copies_nothing(shop):
    t = shop(
        suppliers=[{"supplierID": n, "supplierName": " Aso" if n % 2 else "ASO "} for n in range(30)],
        customers=[{"customerID": n, "customerName": "aso"} for n in range(40)] + [{"customerID": 90, "customerName": "Ban"}],
        transactions=[
            {"sourceID": n, "accountName": ["Aso", "Ban"][n % 2], "totalPrice": n, "createAt": when("2024-01-02")}
            for n in range(10)
        ],
    )
    rows = dicts(parties.partner_statement_counted(t, "2024-01-01", "2024-01-31"))
    assert sorted(r["sourceID"] for r in rows) == [0, 2, 4, 6, 8] and {r["pairs"] for r in rows} == {1200}
    whole = parties.partner_statement(t, "2024-01-01", "2024-01-31")
    assert whole.agg(F.sum("totalPrice")).first()[0] == sum(r["totalPrice"] * r["pairs"] for r in rows)
    assert whole.count() == sum(r["pairs"] for r in rows)


def test_the_box_is_worth_its_dollars_and_dinars_at_the_current_rate(shop):
    box = [
        {"btID": 1, "shelfID": 1, "amount": 10, "amountIQD": 2500}, {"btID": 2, "shelfID": 1, "amount": -4, "amountIQD": 0},
        {"btID": 3, "shelfID": 2, "amount": 3, "amountIQD": 9 * 10**15},
    ]

    def worth(*rates):
        t = shop(box_transaction=box * 3, dollar=[{"dollarId": n, "dollarPrice": r} for n, r in rates])
        return {r["shelfID"]: r["inDollars"] for r in dicts(cash.box_value(t))}

    assert worth((1, 1250), (2, 5)) == {1: 18 + 6, 2: 9 + D(27 * 10**15) / 1250}
    assert worth((1, 0)) == worth() == {1: 18, 2: 9}
