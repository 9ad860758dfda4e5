"""Repayments into open invoices against a plain loop."""

import random
from decimal import Decimal as D

from conftest import dicts, when
from tillbook.operators.allocation import allocate_repayments, settle_listed


def plain(invoices, payments):
    state = {}
    for cust in {i["customerID"] for i in invoices}:
        mine = sorted(
            (i for i in invoices if i["customerID"] == cust), key=lambda i: (i["createAt"], i["invoiceID"])
        )
        for i in mine:
            state[i["invoiceID"]] = [D(i["totalPrice"]) - D(i["initialPay"]), D(0), "0", None]
        for pay in sorted(
            (p for p in payments if p["customerID"] == cust), key=lambda p: (p["createAt"], p["rdcID"])
        ):
            amount = D(pay["amountReturn"])
            for i in mine:
                due, paid, done, _ = state[i["invoiceID"]]
                if done == "1":
                    continue
                rest = due - paid
                if amount >= rest:
                    state[i["invoiceID"]] = [due, due, "1", pay["rdcID"]]
                    amount -= rest
                else:
                    state[i["invoiceID"]][1] += amount
                    break
    return {k: (v[1], v[2], v[3]) for k, v in state.items()}


def random_case(seed, customers, invoices, hot):
    chance = random.Random(seed)

    def who():
        return 2 if chance.random() < hot else 2 + chance.randrange(customers)

    rows = [
        {
            "invoiceID": n, "customerID": who(), "createAt": when(f"2020-01-{chance.randrange(1, 6):02d}"),
            "totalPrice": chance.choice([0, 3, 5, 8, 20]), "initialPay": chance.choice([0, 0, 0, 3, 9]),
            "totalPay": 0, "wasl": "0", "stockType": "s",
        }
        for n in chance.sample(range(100_000), invoices)
    ]
    payments = [
        {
            "rdcID": n, "customerID": who(), "createAt": when(f"2020-02-{chance.randrange(1, 4):02d}"),
            "amountReturn": chance.choice([0, 1, 4, 6, 15, 40]),
        }
        for n in range(invoices // 3)
    ]
    return rows, payments


def allocated(t, floor=10_000):
    rows = dicts(allocate_repayments(t, floor))
    return {r["invoiceID"]: (r["pays"], r["wasl"], r["rdcID"]) for r in rows}


def test_many_customers_match_a_loop(shop):
    for seed in (1, 2):
        invoices, payments = random_case(seed, 300, 1500, 0.0)
        t = shop(invoices=invoices, return_debt_customer=payments)
        assert allocated(t) == plain(invoices, payments)


def test_one_customer_with_most_of_the_rows(shop):
    invoices, payments = random_case(3, 300, 1500, 0.6)
    t = shop(invoices=invoices, return_debt_customer=payments)
    # Once as plain windows, once with the large customer cut into segments.
    assert allocated(t) == plain(invoices, payments)
    assert allocated(t, floor=100) == plain(invoices, payments)


def test_every_customer_cut_into_segments(shop):
    invoices, payments = random_case(4, 20, 1500, 0.3)
    t = shop(invoices=invoices, return_debt_customer=payments)
    assert allocated(t, floor=1) == plain(invoices, payments)


def test_exact_fit_and_overpaid_invoice(shop):
    row = {"customerID": 2, "totalPay": 0, "wasl": "0", "stockType": "s"}
    invoices = [
        row | {"invoiceID": 1, "createAt": when("2020-01-01"), "totalPrice": 5, "initialPay": 0},
        row | {"invoiceID": 2, "createAt": when("2020-01-02"), "totalPrice": 5, "initialPay": 8},
        row | {"invoiceID": 3, "createAt": when("2020-01-02"), "totalPrice": 9, "initialPay": 0},
        row | {"invoiceID": 4, "createAt": when("2020-01-03"), "totalPrice": 0, "initialPay": 0},
    ]
    payments = [{"rdcID": 7, "customerID": 2, "createAt": when("2020-02-01"), "amountReturn": 5}]
    t = shop(invoices=invoices, return_debt_customer=payments)
    assert allocated(t) == {1: (5, "1", 7), 2: (-3, "1", 7), 3: (3, "0", None), 4: (0, "0", None)}


def test_paid_returned_and_foreign_invoices_are_left_alone(shop):
    row = {"createAt": when("2020-01-01"), "totalPrice": 5, "initialPay": 0, "totalPay": 0}
    t = shop(
        invoices=[
            row | {"invoiceID": 1, "customerID": 2, "wasl": "1", "stockType": "s"},
            row | {"invoiceID": 2, "customerID": 2, "wasl": "0", "stockType": "rs"},
            row | {"invoiceID": 3, "customerID": 3, "wasl": "0", "stockType": "s"},
        ],
        return_debt_customer=[
            {"rdcID": 1, "customerID": 2, "createAt": when("2020-02-01"), "amountReturn": 50}
        ],
    )
    assert allocated(t) == {3: (0, "0", None)}


def test_listed_invoices_are_settled_by_the_last_repayment(shop):
    row = {"customerID": 2, "totalPrice": 9, "initialPay": 4, "totalPay": 1, "wasl": "0"}
    t = shop(
        invoices=[row | {"invoiceID": 1}, row | {"invoiceID": 2}],
        return_debt_customer=[
            {"rdcID": 1, "createAt": when("2020-02-02"), "invoiceNumbers": "1"},
            {"rdcID": 2, "createAt": when("2020-02-01"), "invoiceNumbers": "1,9"},
        ],
    )
    got = {r["invoiceID"]: (r["totalPay"], r["wasl"], r["rdcID"]) for r in dicts(settle_listed(t))}
    assert got == {1: (5, "1", 1), 2: (1, "0", None)}


def test_money_is_spent_once(shop):
    row = {"customerID": 2, "createAt": when("2020-01-01"), "initialPay": 0, "wasl": "0", "stockType": "s"}
    pay = {"customerID": 2, "createAt": when("2020-02-01")}
    t = shop(
        invoices=[
            row | {"invoiceID": 1, "totalPrice": 100, "totalPay": 0},
            row | {"invoiceID": 2, "totalPrice": 100, "totalPay": 0},
        ],
        return_debt_customer=[
            pay | {"rdcID": 1, "amountReturn": 100, "invoiceNumbers": "2"},
            pay | {"rdcID": 2, "amountReturn": 30, "invoiceNumbers": ""},
            pay | {"rdcID": 3, "amountReturn": 5},
        ],
    )
    # The first repayment names its invoice and is left to settle_listed.
    assert allocated(t) == {1: (35, "0", None), 2: (0, "0", None)}
    # Only the new ones are spent where they are given.
    new = t.return_debt_customer.filter("rdcID = 3")
    got = {r["invoiceID"]: r["pays"] for r in dicts(allocate_repayments(t, payments=new))}
    assert got == {1: 5, 2: 0}
