"""How often events and edited lines are shuffled and read."""

from decimal import Decimal as D

from conftest import dicts

from tillbook.operators import changes, line_edits

EVENT = "{} bigint, itemID bigint, seq bigint, kind string, qty int, price decimal(18,4), cost decimal(18,4)"


def test_lines_without_very_many_events_take_one_shuffle(spark):
    rows = [
        (1, 1, 1, "add", 5, D(2), D(1)), (1, 1, 2, "qty", 7, D(0), D(0)), (1, 1, 3, "inc", 0, D(0), D(0)),
        (1, 2, 1, "add", 3, D(2), D(1)), (1, 2, 2, "delete", 0, D(0), D(0)), (1, 2, 3, "add", 4, D(6), D(5)),
        (None, 1, 1, "add", 3, D(2), D(1)), (2, None, 1, "add", 3, D(2), D(1)), (2, 1, 1, "inc", 0, D(0), D(0)),
    ]
    lines = changes.apply_line_events(spark.createDataFrame(rows, EVENT.format("invoiceID")))
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = sorted((r["invoiceID"], r["itemID"], r["qty"], r["productPrice"], r["costPrice"]) for r in dicts(lines))
    assert got == [(1, 1, 8, 2, 1), (1, 2, 4, 6, 5)]


def test_edited_lines_are_read_once(spark, shop):
    t = shop(
        invoices=[{"invoiceID": 1, "customerID": 2, "totalPrice": 6, "stockType": "s", "sellStatus": "1"}],
        invoice_item=[{"invoiceID": 1, "itemID": 1, "qty": 3, "productPrice": 2, "costPrice": 1}],
        customers=[{"customerID": 2, "customerName": "c"}],
    )
    events = spark.createDataFrame([(1, 1, 1, "inc", 0, D(0), D(0))], EVENT.format("invoiceID"))
    deltas = line_edits.line_deltas(t, line_edits.SALES, events)
    # Both kinds of rows come from files, and the steps after them do not fold the events again.
    assert len(deltas.inputFiles()) >= 2 and all("/stored-" in name for name in deltas.inputFiles())
    totals = line_edits.total_deltas(t, line_edits.SALES, deltas)
    assert all("/stored-" in name for name in totals.inputFiles()) and totals.inputFiles()
    assert sorted((r["qty"], r["weight"]) for r in dicts(deltas)) == [(3, -1), (4, 1)]
    assert [(r["qty"], r["weight"]) for r in dicts(line_edits.stock_deltas(t, line_edits.SALES, deltas))] == [(-1, 0)]
    assert [r["totalChange"] for r in dicts(totals)] == [2]
