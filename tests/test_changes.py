"""Logs against plain loops."""

import random
from decimal import Decimal as D

from conftest import dicts, when

from tillbook.operators import changes

KINDS = ["add", "inc", "dec", "qty", "price", "cost", "delete"]
EVENT = (
    "invoiceID bigint, itemID bigint, seq bigint, kind string, qty int, price decimal(18,4),"
    " cost decimal(18,4)"
)


def plain_lines(events):
    lines = {}
    for inv, item, _, kind, qty, price, cost in sorted(events, key=lambda e: e[2]):
        key = (inv, item)
        if kind == "add" and key not in lines:
            lines[key] = [qty, price, cost]
        elif key not in lines:
            continue
        elif kind == "add":
            lines[key][0] += qty
        elif kind in ("inc", "dec"):
            lines[key][0] += 1 if kind == "inc" else -1
        elif kind == "qty":
            lines[key][0] = qty
        elif kind == "price":
            lines[key][1] = price
        elif kind == "cost":
            lines[key][2] = cost
        else:
            del lines[key]
    return {k: tuple(v) for k, v in lines.items()}


def random_events(count, keys, seed):
    chance = random.Random(seed)
    weights = [4, 4, 4, 2, 2, 2, 1]
    return [
        (
            chance.randrange(keys) if chance.random() > 0.35 else 0,
            chance.randrange(2) if chance.random() > 0.35 else 0,
            seq,
            chance.choices(KINDS, weights)[0],
            chance.randrange(9),
            D(chance.randrange(100)),
            D(chance.randrange(50)),
        )
        for seq in chance.sample(range(count * 3), count)
    ]


def folded(spark, events, floor):
    df = spark.createDataFrame(events, EVENT)
    return {
        (r["invoiceID"], r["itemID"]): (r["qty"], r["productPrice"], r["costPrice"])
        for r in dicts(changes.apply_line_events(df, floor))
    }


def test_line_events_match_a_loop(spark):
    events = random_events(3000, 400, 1)
    assert folded(spark, events, 10_000) == plain_lines(events)


def test_line_events_with_split_keys(spark):
    events = random_events(3000, 400, 2)
    assert folded(spark, events, 20) == plain_lines(events)


def test_document_totals(spark):
    events = [(1, 1, 1, "add", 2, D(5), D(1)), (1, 2, 2, "add", 1, D(7), D(1)), (2, 1, 3, "add", 1, D(1), D(1)),
              (2, 1, 4, "delete", 0, D(0), D(0))]
    lines = changes.apply_line_events(spark.createDataFrame(events, EVENT))
    assert dicts(changes.document_totals(lines)) == [{"invoiceID": 1, "totalPrice": D("17"), "noOfItem": 2}]


def test_entity_log_matches_a_loop(spark):
    chance = random.Random(3)
    log = []
    for seq in range(2500):
        op = chance.choices(["insert", "update", "patch", "delete"], [3, 3, 4, 1])[0]
        name = None if op in ("patch", "update") and chance.random() < 0.5 else f"n{seq}"
        state = None if op in ("patch", "update") and chance.random() < 0.5 else f"s{seq}"
        log.append((chance.randrange(150), seq, op, name, state))
    rows = {}
    for key, _, op, name, state in log:
        if op == "insert":
            rows[key] = (name, state)
        elif key not in rows:
            continue
        elif op == "delete":
            del rows[key]
        elif op == "update":
            rows[key] = (name, state if state is not None else rows[key][1])
        else:
            rows[key] = (name or rows[key][0], state or rows[key][1])
    df = spark.createDataFrame(log, "id bigint, seq bigint, op string, name string, state string")
    got = {
        r["id"]: (r["name"], r["state"])
        for r in dicts(changes.apply_changes(df, "id", ["name", "state"], full=["name"]))
    }
    assert got == rows


def test_repost_drops_every_row_of_a_deleted_document(spark, shop):
    head = {"sellStatus": "1", "stockType": "s", "createAt": when("2020-01-01")}
    line = {"itemID": 1, "qty": 2, "productPrice": 5, "costPrice": 4}
    stock = {"itemID": 1, "createAt": when("2020-01-01")}
    t = shop(
        invoices=[head | {"invoiceID": n} for n in (1, 2, 3)],
        invoice_item=[line | {"invoiceID": n} for n in (1, 2, 3)],
        stock=[
            stock | {"sourceID": n, "sourceType": kind, "qty": -2}
            for n, kind in ((1, "s"), (2, "s"), (3, "s"), (1, "p"))
        ],
    )
    from pyspark.sql import functions as F

    created = t.invoices.withColumn("seq", F.lit(0).cast("bigint")).withColumn("op", F.lit("insert"))
    edits = spark.createDataFrame(
        [(1, 1, "delete", None), (2, 1, "patch", "rs")],
        "invoiceID bigint, seq bigint, op string, stockType string",
    )
    log = created.unionByName(edits, allowMissingColumns=True)
    after = {(r["sourceID"], r["sourceType"]): r["qty"] for r in dicts(changes.repost_invoices(t, log))}
    assert after == {(1, "p"): -2, (2, "rs"): 2, (3, "s"): -2}


def test_repost_since_takes_new_documents_and_a_stored_ledger(spark, shop):
    from pyspark.sql import functions as F

    head = {"sellStatus": "1", "stockType": "s", "createAt": when("2020-01-01")}
    line = {"itemID": 1, "qty": 2, "productPrice": 5, "costPrice": 4}
    old = {"itemID": 1, "createAt": when("2020-01-01"), "sourceID": 1, "sourceType": "s", "qty": -9}
    t = shop(
        invoices=[head | {"invoiceID": n} for n in (1, 2)],
        invoice_item=[line | {"invoiceID": n} for n in (1, 2)],
        stock=[old],
    )
    log = t.invoices.withColumn("seq", F.col("invoiceID")).withColumn("op", F.lit("insert"))
    stored = t.replaced(stock=t.stock.withColumn("day", F.to_date("createAt")))
    rows = dicts(changes.repost_invoices(stored, log, since=1))
    assert sorted((r["sourceID"], r["qty"]) for r in rows) == [(1, -9), (2, -2)]
