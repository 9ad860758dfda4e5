"""Payments in time order against a plain loop."""

import random
from decimal import Decimal as D

import pytest
from conftest import dicts, when

from tillbook.operators.allocation import allocate_in_time, unused_money


def plain(invoices, payments):
    """Every payment walks the invoices that are open when it is made."""
    state, unused = {}, {}
    events = [(i["createAt"] or when("1900-01-01"), 0, i["invoiceID"], i) for i in invoices]
    events += [(p["createAt"] or when("1900-01-01"), 1, p["rdcID"], p) for p in payments]
    queues, credit = {}, {}
    for _, kind, number, row in sorted(events, key=lambda e: e[:3]):
        who = row["customerID"]
        queue = queues.setdefault(who, [])
        if kind == 0:
            due = D(row["totalPrice"]) - D(row["initialPay"]) - D(row["totalPay"])
            state[number] = [due, D(0), "0", None]
            queue.append(number)
            continue
        amount = D(row["amountReturn"] or 0) + credit.pop(who, D(0))
        overpaid = [n for n in queue if state[n][0] < 0]
        for n in overpaid:
            amount -= state[n][0]
            state[n][1:] = [state[n][0], "1", number]
            queue.remove(n)
        while queue:
            due, paid, _, _ = state[queue[0]]
            if amount >= due - paid:
                state[queue[0]][1:] = [due, "1", number]
                amount -= due - paid
                queue.pop(0)
            else:
                state[queue[0]][1] += amount
                amount = D(0)
                break
        unused[number] = amount
    return {n: tuple(s) for n, s in state.items()}, unused


def case(seed, customers, count, hot):
    draw = random.Random(seed)

    def who():
        return 2 if draw.random() < hot else draw.choice([None, *range(2, 2 + customers)])

    def day():
        return when(f"2020-01-{draw.randrange(1, 29):02d}")

    invoices = [
        {
            "invoiceID": n, "customerID": who(), "createAt": day(), "totalPay": draw.choice([0, 0, 2]),
            "totalPrice": draw.choice([0, 2, 5, 8, 20]), "initialPay": draw.choice([0, 0, 0, 3, 9]),
            "wasl": "0", "stockType": "s",
        }
        for n in draw.sample(range(10_000), count)
    ]
    payments = [
        {"rdcID": n, "customerID": who(), "createAt": day(), "amountReturn": draw.choice([None, 0, 1, 4, 6, 15, 40])}
        for n in draw.sample(range(10_000), count // 2)
    ]
    return invoices, payments


def found(shop, invoices, payments, floor=10_000):
    t = shop(invoices=invoices, return_debt_customer=payments)
    rows = dicts(allocate_in_time(t, t.return_debt_customer, floor))
    old = {i["invoiceID"]: D(i["totalPay"]) for i in invoices}
    assert all(r["totalPay"] == old[r["invoiceID"]] + r["pays"] for r in rows)
    state = {r["invoiceID"]: (r["due"], r["pays"], r["wasl"], r["rdcID"]) for r in rows}
    assert len(state) == len(rows)
    return state, {r["rdcID"]: r["unused"] for r in dicts(unused_money(t, t.return_debt_customer, floor))}


@pytest.mark.parametrize("seed", range(4))
def test_payments_meet_what_is_open(shop, seed):
    invoices, payments = case(seed, 6, 120, 0.2)
    assert found(shop, invoices, payments) == plain(invoices, payments)


def test_customers_cut_into_segments(shop):
    invoices, payments = case(9, 3, 160, 0.6)
    assert found(shop, invoices, payments, floor=10) == plain(invoices, payments)


def invoice(number, day, total, paid=0, who=2):
    return {
        "invoiceID": number, "customerID": who, "createAt": when(day), "totalPrice": total, "initialPay": 0,
        "totalPay": paid, "wasl": "0", "stockType": "s",
    }


def payment(number, day, amount, who=2):
    return {"rdcID": number, "customerID": who, "createAt": when(day), "amountReturn": amount}


def test_money_that_is_in_the_total_already_is_not_paid_again(shop):
    # 40 of the invoice came from repayment 1, which is not among the new payments.
    t = shop(invoices=[invoice(100, "2020-01-01", 100, 40)], return_debt_customer=[payment(1, "2020-02-01", 40)])
    assert [(r["pays"], r["wasl"]) for r in dicts(allocate_in_time(t, t.return_debt_customer.limit(0)))] == [(0, "0")]
    with pytest.raises(TypeError):
        allocate_in_time(t)


def test_a_payment_does_not_reach_later_invoices(shop):
    state, unused = found(shop, [invoice(1, "2021-01-01", 50)], [payment(7, "2020-06-01", 80)])
    assert state == {1: (50, 0, "0", None)} and unused == {7: 80}


def test_debt_never_falls_below_nothing(shop):
    invoices = [invoice(1, "2020-01-01", 10), invoice(2, "2020-03-01", 10), invoice(3, "2020-03-02", 0)]
    payments = [payment(1, "2020-02-01", 25), payment(2, "2020-04-01", 4), payment(3, "2020-05-01", 7)]
    state, unused = found(shop, invoices, payments)
    assert state == {1: (10, 10, "1", 1), 2: (10, 10, "1", 3), 3: (0, 0, "1", 3)}
    assert unused == {1: 15, 2: 0, 3: 1}


def test_an_overpaid_invoice_adds_its_credit_to_the_next_payment(shop):
    invoices = [invoice(1, "2020-01-01", 100), invoice(2, "2020-01-02", 0, 30), invoice(3, "2020-01-03", 20)]
    state, unused = found(shop, invoices, [payment(5, "2020-02-01", 100)])
    assert state == {1: (100, 100, "1", 5), 2: (-30, -30, "1", 5), 3: (20, 20, "1", 5)} and unused == {5: 10}


def test_nothing_to_pay_and_nothing_to_pay_with(shop):
    assert found(shop, [], []) == ({}, {})
    assert found(shop, [], [payment(1, "2020-01-01", 5)]) == ({}, {1: 5})
    assert found(shop, [invoice(1, "2020-01-01", 5)], []) == ({1: (5, 0, "0", None)}, {})
