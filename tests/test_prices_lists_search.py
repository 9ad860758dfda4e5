"""Price pieces, listed documents and many-pattern search against plain Python."""

import datetime as dt
import random

import pytest
from conftest import dicts, when
from pyspark.sql import functions as F

from tillbook.operators import lists, pricing, stock, text_search

FIRST = dt.date(2024, 1, 1)


def discount(number, item, start, days, price=None):
    begin = FIRST + dt.timedelta(days=start)
    return {
        "dID": number, "itemID": item, "startDate": begin, "endDate": begin + dt.timedelta(days=days),
        "priceAfterDiscount": number if price is None else price,
    }


def won(rows):
    """The discount that holds, for every item and day."""
    held = {}
    for r in sorted(rows, key=lambda r: (r["startDate"], r["dID"])):
        day = r["startDate"]
        while day < r["endDate"]:
            held[r["itemID"], day] = r["dID"]
            day += dt.timedelta(days=1)
    return held


def unrolled(pieces):
    days = {}
    for p in pieces:
        day = p["fromDate"]
        while day < p["toDate"]:
            assert (p["itemID"], day) not in days
            days[p["itemID"], day] = p["dID"]
            day += dt.timedelta(days=1)
    return days


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pieces_unrolled_are_the_calendar(shop, seed):
    draw = random.Random(seed)
    rows = [
        discount(n, draw.randrange(4), draw.randrange(-60, 60), draw.choice([-3, 0, 1, 2, 9, 40, 100]))
        for n in range(60)
    ]
    t = shop(discounts=rows)
    pieces = dicts(pricing.price_pieces(t))
    assert unrolled(pieces) == won(rows)
    calendar = dicts(pricing.price_calendar(t, "2023-10-01", "2024-08-01"))
    assert unrolled(pieces) == {(r["itemID"], r["day"]): r["dID"] for r in calendar}
    line = sorted((p["itemID"], p["fromDate"], p["toDate"], p["dID"]) for p in pieces)
    # Neighbouring pieces of one discount would be one piece.
    assert not [1 for a, b in zip(line, line[1:]) if a[0] == b[0] and a[2] == b[1] and a[3] == b[3]]


def test_a_long_discount_is_one_piece(shop):
    t = shop(discounts=[discount(1, 5, 0, 3653), discount(2, 6, -200_000, 400_000), discount(3, 6, 5, 2)])
    pieces = sorted((p["itemID"], p["dID"], (p["toDate"] - p["fromDate"]).days) for p in dicts(pricing.price_pieces(t)))
    assert pieces == [(5, 1, 3653), (6, 1 + 1, 199_993), (6, 2, 200_005), (6, 3, 2)]
    assert dicts(pricing.price_pieces(shop())) == []
    assert dicts(pricing.price_pieces(shop(discounts=[discount(1, None, 0, 3), discount(None, 2, 0, 3, 1)]))) == []


def test_rows_meet_the_piece_of_their_day(spark, shop):
    rows = [discount(1, 5, 0, 100), discount(2, 5, 10, 5), discount(3, 6, 31, 1)]
    t = shop(discounts=rows)
    asked = [(n, item, when("2024-01-01") + dt.timedelta(days=n, hours=23)) for item in (5, 6, 7) for n in range(-3, 110)]
    df = spark.createDataFrame([*asked, (0, None, None)], "n int, itemID bigint, at timestamp_ntz")
    out = dicts(pricing.prices_on(t, df, "at"))
    held = won(rows)
    assert len(out) == len(asked) + 1
    assert all(r["dID"] == (held.get((r["itemID"], r["at"].date())) if r["at"] else None) for r in out)


# Listed documents.


def plain_lists(repayments, changes):
    held = {}
    for key, text in repayments.items():
        for part in (text or "").split(","):
            if part.strip():
                held[key, int(part)] = held.get((key, int(part)), 0) + 1
    for key, doc, change, _ in sorted(changes, key=lambda c: c[3]):
        if change == "append":
            held[key, doc] = held.get((key, doc), 0) + 1
        else:
            held.pop((key, doc), None)
    return held


@pytest.mark.parametrize("side", [lists.SUPPLIERS, lists.CUSTOMERS])
def test_a_document_reopens_when_its_last_listing_goes(spark, shop, side):
    draw = random.Random(3)
    repayments = {n: ",".join(str(draw.randrange(12)) for _ in range(draw.randrange(5))) or None for n in range(8)}
    changes = [
        (draw.randrange(8), draw.randrange(14), draw.choice(["append", "remove", "remove"]), seq)
        for seq in draw.sample(range(500), 60)
    ]
    t = shop(**{
        side.repayments: [{side.key: k, side.column: v} for k, v in repayments.items()],
        side.documents: [{side.document: n, side.status: "7"} for n in range(13)],
    })
    log = spark.createDataFrame(changes, f"{side.key} bigint, {side.document} bigint, change string, seq bigint")
    before = lists.bridge(t, side)
    after = lists.merged(before, log, side)
    old, new = plain_lists(repayments, []), plain_lists(repayments, changes)
    assert {(r[side.key], r[side.document]): r["times"] for r in dicts(before)} == old
    assert {(r[side.key], r[side.document]): r["times"] for r in dicts(after)} == new

    def listed(held, doc):
        return sum(n for (_, d), n in held.items() if d == doc)

    want = {}
    for doc in range(13):
        was, now = listed(old, doc), listed(new, doc)
        want[doc] = "7" if (was > 0) == (now > 0) else side.settled if now else side.reopened
    got = {r[side.document]: r[side.status] for r in dicts(lists.with_status(t, side, before, after))}
    assert got == want and len(set(want.values())) == 3
    texts = {r[side.key]: r[side.column] for r in dicts(lists.as_lists(t, side, after))}
    assert texts == {
        k: ",".join(str(d) for (key, d), n in sorted(new.items()) if key == k for _ in range(n)) or None
        for k in repayments
    }
    nothing = lists.merged(before, log.limit(0), side)
    assert dicts(lists.documents_after(t, side, before, nothing)) == []


def test_a_document_listed_twice_stays_settled_while_one_listing_is_left(spark, shop):
    side = lists.SUPPLIERS
    t = shop(
        return_debt=[{"rdID": 1, "purchaseNumbers": "5,5"}, {"rdID": 2, "purchaseNumbers": "5"}],
        purchases=[{"purchaseID": 5, "debtStatus": "1"}],
    )
    before = lists.bridge(t, side)

    def without(*keys):
        rows = [(k, 5, "remove", n) for n, k in enumerate(keys)]
        log = spark.createDataFrame(rows, "rdID bigint, purchaseID bigint, change string, seq bigint")
        return dicts(lists.documents_after(t, side, before, lists.merged(before, log, side)))

    assert without(1) == [] and without(2) == []
    assert without(1, 2) == [{"purchaseID": 5, "debtStatus": "0", "listings": 0}]


# Search.


def test_ten_thousand_patterns_find_what_the_plain_search_finds(spark, shop):
    draw = random.Random(8)
    letters = "abcdeÉéäöı ١-"
    items = [
        {
            "itemID": n, "itemCode": f"P{n}" if n % 9 else None,
            "itemName": "".join(draw.choice(letters) for _ in range(draw.randrange(12))) if n % 11 else None,
        }
        for n in range(300)
    ]
    t = shop(items=items)
    patterns = ["".join(draw.choice(letters + "P123") for _ in range(draw.randrange(6))) for _ in range(10_000)]
    df = spark.createDataFrame([(p,) for p in [*patterns, None]], "pattern string")
    index = text_search.ItemIndex(t.items)
    lowered = {p for (p,) in spark.createDataFrame([(p,) for p in patterns], "p string").select(F.lower("p")).collect()}
    whole = t.items.select("itemID", F.lower("itemCode").alias("c"), F.lower("itemName").alias("n")).collect()
    for prefix in (False, True):
        want = {
            (p, r["itemID"]) for p in lowered if p for r in whole
            if any(x is not None and (x.startswith(p) if prefix else p in x) for x in (r["c"], r["n"]))
        }
        rows = index.search(df, prefix).select("pattern", "itemID").collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    # What is looked at, against all pairs of patterns and items.
    looked = index.candidates(df).count()
    assert len(want) < looked < 0.02 * len(lowered) * len(items)


def test_many_patterns_agree_with_the_search_of_a_few(spark, shop):
    items = [{"itemID": n, "itemCode": f"A{n}", "itemName": f"Tea {n} GREEN"} for n in range(30)]
    t = shop(items=items)
    few = ["tea", "EEN", "a1", "9", "a2 ", ""]
    plain = stock.item_search(t, [p for p in few if p])
    df = spark.createDataFrame([(p,) for p in few], "pattern string")
    found = text_search.ItemIndex(t.items).search(df)
    assert found.columns == plain.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    empty = text_search.ItemIndex(shop().items)
    assert empty.search(df).collect() == [] and empty.candidates(df.limit(0)).collect() == []
