"""Signed differences of edited lines against posting everything anew, for random logs."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from conftest import dicts, frame, when
from pyspark.sql import functions as F

from tillbook.operators import line_edits
from tillbook.operators.line_edits import PURCHASES, SALES
from tillbook.sources.ledgers import DayLedger
from test_changes import plain_lines

DAYS = ["2024-03-01", "2024-03-02", "2024-03-03"]


def documents(draw, side, count):
    """Heads whose totals are those of their lines, and lines, one per item."""
    heads, lines = [], []
    for doc in range(count):
        mine = []
        for item in range(draw.randrange(1, 4)):
            qty, price, cost = draw.randrange(5), D(draw.randrange(1, 40)), D(draw.randrange(1, 20))
            discount = D(draw.randrange(3)) if side is PURCHASES else D(0)
            line = {side.key: doc, "itemID": item, "qty": qty, "costPrice": cost}
            if side is SALES:
                line |= {"invdID": doc * 10 + item, "productPrice": price, "expiryDate": dt.date(2025, 1, item + 1)}
            else:
                line |= {"pItemID": doc * 10 + item, "discount": discount, "costAfterDisc": cost - discount}
            mine.append(line)
        total = sum(x["qty"] * x[side.price] for x in mine)
        head = {side.key: doc, "totalPrice": total, "dollarPrice": 1000, "createAt": when(DAYS[doc % 3])}
        if side is SALES:
            head |= {
                "customerID": doc % 4 + 1, "initialPay": D(doc), "totalPayIQD": D(1000), "invoiceType": "d",
                "stockType": ["s", "rs"][doc % 2], "sellStatus": "0" if doc % 5 == 4 else "1", "userIDUpdate": 3,
            }
        else:
            head |= {
                "supplierID": doc % 4 + 1, "amountPay": D(doc), "amountPayIQD": D(1000), "paymentType": "d",
                "stockType": ["p", "rp"][doc % 2], "userIDCreated": 3,
            }
        heads.append(head)
        lines += mine
    return heads, lines


def random_edits(draw, count, docs, kinds):
    return [
        (draw.randrange(docs), draw.randrange(4), seq, draw.choice(kinds), draw.randrange(6), D(draw.randrange(50)), D(draw.randrange(30)))
        for seq in draw.sample(range(count * 3), count)
    ]


def event_frame(spark, side, rows):
    schema = f"{side.key} bigint, itemID bigint, seq bigint, kind string, qty int, price decimal(18,4), cost decimal(18,4)"
    return spark.createDataFrame(rows, schema)


KINDS = {
    "sales": (SALES, ["add", "inc", "dec", "qty", "price", "cost", "delete"]),
    "purchases": (PURCHASES, ["add", "qty", "cost", "delete", "delete"]),
}


def tables(shop, side, heads, lines):
    names = {"customers": [{"customerID": n, "customerName": f"c{n}"} for n in range(1, 5)]}
    names["suppliers"] = [{"supplierID": n, "supplierName": f"s{n}"} for n in range(1, 5)]
    return shop(**{side.heads: heads, side.lines: lines}, **names)


def plain_after(side, heads, lines, edits):
    """Heads and lines after the edits, in plain Python."""
    price = "productPrice" if side is SALES else "costPrice"
    first = -10**6
    start = [(x[side.key], x["itemID"], first, "add", x["qty"], x[price], x["costPrice"]) for x in lines]
    old = {(x[side.key], x["itemID"]): x for x in lines}
    after = []
    for (doc, item), (qty, value, cost) in plain_lines(start + edits).items():
        line = dict(old.get((doc, item), {side.key: doc, "itemID": item})) | {"qty": qty, "costPrice": cost}
        if side is SALES:
            line["productPrice"] = value
        else:
            line["costAfterDisc"] = cost - (line.get("discount") or 0)
        after.append(line)
    had = {x[side.key] for x in lines}
    left = {x[side.key] for x in after}
    totals = {d: sum(x["qty"] * x[side.price] for x in after if x[side.key] == d) for d in left}
    kept = [h | {"totalPrice": totals[h[side.key]]} for h in heads if h[side.key] in left]
    # Documents of which nothing was there do not come to be by line events.
    return kept, after, had - left


def bag(df, columns=None):
    rows = df.select(*(columns or df.columns)).collect()
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", sorted(KINDS))
@pytest.mark.parametrize("seed", [1, 2])
def test_differences_give_what_posting_anew_gives(spark, shop, name, seed):
    side, kinds = KINDS[name]
    draw = random.Random(seed)
    heads, lines = documents(draw, side, 14)
    edits = random_edits(draw, 60, 14, kinds) + [(0, i, 900 + i, "delete", 0, D(0), D(0)) for i in range(4)]
    edits += [(1, 2, 901 + n, "inc" if side is SALES else "qty", 4, D(1), D(1)) for n in range(40)]
    t, events = tables(shop, side, heads, lines), event_frame(spark, side, edits)
    new_heads, new_lines, gone = plain_after(side, heads, lines, edits)
    assert gone
    want = tables(shop, side, new_heads, new_lines)
    deltas = line_edits.line_deltas(t, side, events, floor=10)
    totals = line_edits.total_deltas(t, side, deltas)
    assert bag(line_edits.heads_after(t, side, totals)) == bag(getattr(want, side.heads))
    stock = line_edits.stock_after(side.stock(t), line_edits.stock_deltas(t, side, deltas))
    fresh = side.stock(want)
    one = fresh.groupBy(*[c for c in fresh.columns if c != "qty"]).agg(F.sum("qty").cast("int").alias("qty"))
    assert bag(stock, fresh.columns) == bag(one, fresh.columns)
    accounts = line_edits.accounts_after(side.account(t), line_edits.account_deltas(t, side, totals))
    assert bag(accounts, side.account(want).columns) == bag(side.account(want))


@pytest.mark.parametrize("name", sorted(KINDS))
def test_stored_ledgers_follow_batch_by_batch(spark, shop, tmp_path, name):
    side, kinds = KINDS[name]
    draw = random.Random(5)
    heads, lines = documents(draw, side, 9)
    t = tables(shop, side, heads, lines)
    stock = DayLedger(spark, str(tmp_path / "stock"), side.stock(t).schema)
    accounts = DayLedger(spark, str(tmp_path / "accounts"), side.account(t).schema)
    stock.write(side.stock(t))
    accounts.write(side.account(t))
    for _ in range(2):
        # Documents of two of the three days.
        edits = [e for e in random_edits(draw, 30, 9, kinds) if e[0] % 3 != 2]
        line_edits.edit_days(t, side, event_frame(spark, side, edits), stock, accounts)
        heads, lines, _ = plain_after(side, heads, lines, edits)
        t = tables(shop, side, heads, lines)
        heads = [{**h} for h in heads]
    fresh = side.stock(t)
    one = fresh.groupBy(*[c for c in fresh.columns if c != "qty"]).agg(F.sum("qty").cast("int").alias("qty"))
    assert bag(stock.read(), fresh.columns) == bag(one, fresh.columns)
    assert bag(accounts.read().drop("day")) == bag(side.account(t))


def test_what_does_not_change_leaves_no_rows(spark, shop):
    heads, lines = documents(random.Random(3), SALES, 4)
    t = tables(shop, SALES, heads, lines)
    same = lines[0]
    edits = [
        (0, same["itemID"], 1, "inc", 0, D(0), D(0)), (0, same["itemID"], 2, "dec", 0, D(0), D(0)),
        (3, 99, 3, "inc", 0, D(0), D(0)), (77, 1, 4, "delete", 0, D(0), D(0)),
    ]
    deltas = line_edits.line_deltas(t, SALES, event_frame(spark, SALES, edits))
    assert line_edits.stock_deltas(t, SALES, deltas).count() == 0
    totals = dicts(line_edits.total_deltas(t, SALES, deltas))
    assert [(r["invoiceID"], r["totalChange"], r["lineChange"], r["gone"]) for r in totals] == [(0, 0, 0, False)]
    nothing = line_edits.line_deltas(t, SALES, event_frame(spark, SALES, []))
    assert nothing.count() == 0
    assert bag(line_edits.heads_after(t, SALES, line_edits.total_deltas(t, SALES, nothing))) == bag(
        frame(spark, "invoices", heads)
    )
