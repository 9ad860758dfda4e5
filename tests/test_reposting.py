"""Ledgers stored by day: only touched days are read and written, and a failure leaves the old ones."""

import datetime as dt
import glob
import os
import random

import pytest
from conftest import dicts, frame, when
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook import schema as S
from tillbook.functions.files import Files
from tillbook.operators import posting, reposting
from tillbook.sources.ledgers import DayLedger


def files(path):
    found = {}
    for name in glob.glob(f"{path}/day=*/*.parquet"):
        found.setdefault(os.path.basename(os.path.dirname(name)), set()).add(os.path.basename(name))
    return found


def disposal(number, day, **more):
    return {"disposalID": number, "itemID": number % 3, "costPrice": 2, "qty": number, "createAt": when(day)} | more


def log_of(spark, rows):
    schema = frame(spark, "disposals", []).schema
    whole = T.StructType([*schema, T.StructField("seq", T.LongType()), T.StructField("op", T.StringType())])
    base = frame(spark, "disposals", [r for r, _, _ in rows]).collect()
    marked = [(*tuple(r), seq, op) for r, (_, seq, op) in zip(base, rows)]
    return spark.createDataFrame(marked, whole)


DAYS = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]


@pytest.fixture
def stored(spark, shop, tmp_path):
    t = shop(disposals=[disposal(n, DAYS[n % 4]) for n in range(1, 13)])
    rows = posting.post_disposal(t)
    ledger = DayLedger(spark, str(tmp_path / "ledger"), rows.schema)
    ledger.write(rows)
    created = [(disposal(n, DAYS[n % 4]), 0, "insert") for n in range(1, 13)]
    return t, ledger, created


def contents(ledger):
    return sorted((r["sourceID"], r["qty"], str(r["day"])) for r in dicts(ledger.read()))


KIND = reposting.KINDS["disposal_stock"]


def test_only_touched_days_are_rewritten(spark, stored):
    t, ledger, created = stored
    before, rows = files(ledger.path), contents(ledger)
    log = created + [({"disposalID": 1, "qty": 50}, 1, "patch"), ({"disposalID": 5}, 2, "delete")]
    days = reposting.repost_days(t, log_of(spark, log), KIND, ledger)
    assert days == [dt.date(2024, 1, 2)]
    after = files(ledger.path)
    assert {d: f for d, f in after.items() if d != "day=2024-01-02"} == {
        d: f for d, f in before.items() if d != "day=2024-01-02"
    }
    assert after["day=2024-01-02"].isdisjoint(before["day=2024-01-02"])
    want = [r for r in rows if r[0] not in (1, 5)] + [(1, -50, "2024-01-02")]
    assert contents(ledger) == sorted(want)


def test_untouched_days_are_not_read(spark, stored):
    _, ledger, _ = stored
    some = ledger.of([dt.date(2024, 1, 2), dt.date(2024, 1, 4)])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    names = some.select(F.input_file_name().alias("name")).distinct().collect()
    read = {os.path.basename(os.path.dirname(r["name"])) for r in names}
    assert read == {"day=2024-01-02", "day=2024-01-04"}
    assert ledger.of([]).count() == 0


def test_a_document_moves_to_another_day_and_a_day_goes(spark, stored):
    t, ledger, created = stored
    log = created + [({"disposalID": n}, 5 + n, "delete") for n in (4, 8)]
    log += [(disposal(12, "2024-02-09"), 30, "update"), (disposal(77, "2024-01-03"), 31, "insert")]
    log += [({"disposalID": 3, "qty": 9}, 32, "patch")]
    days = reposting.repost_days(t, log_of(spark, log), KIND, ledger, since=0)
    assert set(days) == {dt.date(2024, 1, 1), dt.date(2024, 2, 9), dt.date(2024, 1, 3), dt.date(2024, 1, 4)}
    assert "day=2024-01-01" not in files(ledger.path)
    found = contents(ledger)
    assert (12, -12, "2024-02-09") in found and (77, -77, "2024-01-03") in found
    assert [r[1] for r in found if r[0] == 3] == [-9] and not [r for r in found if r[0] in (4, 8)]
    again = reposting.repost_days(t, log_of(spark, log), KIND, ledger, since=99)
    assert again == [] and contents(ledger) == found


def test_a_failed_write_leaves_the_old_days(spark, stored):
    _, ledger, _ = stored
    before, rows = files(ledger.path), contents(ledger)
    day = dt.date(2024, 1, 2)
    broken = ledger.of([day]).withColumn("qty", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        ledger.replace([day], broken)
    assert files(ledger.path) == before and contents(ledger) == rows
    elsewhere = ledger.of([dt.date(2024, 1, 3)])
    with pytest.raises(Exception, match="outside the days"):
        ledger.replace([day], elsewhere)
    assert files(ledger.path) == before and contents(ledger) == rows


def test_a_replacement_that_was_cut_short_is_finished_by_the_next_reader(spark, stored, monkeypatch):
    _, ledger, _ = stored
    rows = contents(ledger)
    one, two = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    doubled = ledger.of([one, two]).filter(F.col("day") == F.lit(two)).withColumn("qty", F.col("qty") * 2)
    with monkeypatch.context() as cut:
        cut.setattr(DayLedger, "finish", lambda self: False)
        ledger.replace([one, two], doubled)
        # Staged, but not in place yet.
        assert contents(ledger) == rows
    want = sorted((i, q * 2 if d == str(two) else q, d) for i, q, d in rows if d != str(one))
    with monkeypatch.context() as cut:
        # Cut short once more: the days without rows are still there.
        cut.setattr(Files, "remove", lambda self, path: (_ for _ in ()).throw(OSError("cut")))
        with pytest.raises(OSError, match="cut"):
            ledger.finish()
    other = DayLedger(spark, ledger.path, spark.createDataFrame([], ledger.schema).drop("day").schema)
    assert contents(other) == want
    assert not other.finish()


def test_rows_without_time_have_a_day_of_their_own(spark, shop, tmp_path):
    t = shop(disposals=[disposal(1, DAYS[0]), disposal(2, DAYS[0], createAt=None)])
    rows = posting.post_disposal(t)
    ledger = DayLedger(spark, str(tmp_path / "ledger"), rows.schema)
    ledger.write(rows)
    log = [(disposal(1, DAYS[0]), 0, "insert"), (disposal(2, DAYS[0], createAt=None), 0, "insert")]
    log += [({"disposalID": 2, "qty": 5}, 1, "patch")]
    assert reposting.repost_days(t, log_of(spark, log), KIND, ledger) == [None]
    assert contents(ledger) == [(1, -1, DAYS[0]), (2, -5, "None")]
    log += [({"disposalID": 2}, 2, "delete")]
    assert reposting.repost_days(t, log_of(spark, log), KIND, ledger, since=1) == [None]
    assert contents(ledger) == [(1, -1, DAYS[0])]


def test_random_logs_give_what_posting_the_folded_documents_gives(spark, shop, tmp_path):
    draw = random.Random(7)
    ledger = log = None
    rows, alive = [], {}
    for seq in range(60):
        number, day = draw.randrange(12), draw.choice(DAYS)
        op = draw.choice(["insert", "patch", "delete", "update"])
        entry = disposal(number, day, qty=seq) if op in ("insert", "update") else {"disposalID": number}
        entry |= {"qty": seq} if op == "patch" else {}
        rows.append((entry, seq, op))
        if op == "insert" or (op == "update" and number in alive):
            alive[number] = (seq, day)
        elif op == "patch" and number in alive:
            alive[number] = (seq, alive[number][1])
        elif op == "delete":
            alive.pop(number, None)
        if seq % 20 == 19:
            log = log_of(spark, rows)
            if ledger is None:
                t = shop()
                empty = posting.post_disposal(t)
                ledger = DayLedger(spark, str(tmp_path / "ledger"), empty.schema)
                ledger.write(empty.limit(0))
            reposting.repost_days(t, log, KIND, ledger, since=seq - 20)
            assert contents(ledger) == sorted((n, -q, d) for n, (q, d) in alive.items())


def test_corrections_only_reach_documents_with_rows(spark, shop):
    rows = [
        {"rdcID": n, "customerID": 5, "amountReturn": 10 * n, "discount": 1, "createAt": when(DAYS[0])}
        for n in (1, 2)
    ]
    t = shop(return_debt_customer=rows, customers=[{"customerID": 5, "customerName": "Aso"}])
    ledger = posting.post_customer_repayment_account(t).filter("sourceID = 1")
    changed = t.return_debt_customer.withColumn("seq", F.lit(1).cast("bigint")).withColumn("op", F.lit("insert"))
    edits = changed.withColumn("seq", F.lit(2).cast("bigint")).withColumn("op", F.lit("patch"))
    log = changed.unionByName(edits.withColumn("amountReturn", F.col("amountReturn") * 2))
    kind = reposting.KINDS["customer_repayment_account"]
    found = dicts(reposting.reposted(t, log, kind, ledger))
    assert [(r["sourceID"], float(r["totalPrice"])) for r in found] == [(1, 19.0)]


def test_every_kind_names_rows_its_rule_gives(spark, shop):
    assert {k.ledger for k in reposting.KINDS.values()} == {"stock", "party", "cash", "manual"}
    t = shop()
    for kind in reposting.KINDS.values():
        columns = kind.post(t).columns
        assert kind.row_key in columns and kind.type_column in columns
        assert kind.key in S.TABLES[kind.table]
