"""The state log stays short, loses nothing when cut short, and alerts equal a replay of all events."""

import random

import pytest
from conftest import dicts, frame, when
from pyspark.sql import functions as F

from test_ledgers import LINE, line, stream_of
from tillbook.functions.files import Files
from tillbook.streaming import alerts, state_log, streams
from tillbook.streaming.state_log import StateLog

ROWS = "item bigint, qty bigint, note string"


def log_at(spark, path):
    return StateLog(spark, str(path), ["item"], spark.createDataFrame([], ROWS).schema, shares=3)


def held(log):
    return {r["item"]: (r["qty"], r["note"]) for r in dicts(log.read())}


def parts(spark, path):
    """Folders of runs, and rows in all of them."""
    files = Files(spark)
    runs = files.names(f"{path}/runs")
    rows = spark.read.option("basePath", f"{path}/runs").parquet(f"{path}/runs").count() if runs else 0
    return len(runs), rows


def batches(seed, count, keys=12):
    draw = random.Random(seed)
    return [
        [(k, draw.randrange(100), draw.choice(["x", None])) for k in draw.sample(range(keys), draw.randrange(5))]
        for _ in range(count)
    ]


def test_fifty_batches_stay_bounded(spark, tmp_path):
    log, want = log_at(spark, tmp_path), {}
    most = (state_log.FANOUT - 1) * state_log.TIERS + 1 + state_log.FANOUT + 1
    for number, rows in enumerate(batches(1, 50)):
        assert log.append(spark.createDataFrame(rows, ROWS), number)
        want |= {k: (q, n) for k, q, n in rows}
        if number % 10 == 9:
            assert held(log) == want
        runs = log._manifest()["runs"]
        assert len(runs) <= (state_log.FANOUT - 1) * state_log.TIERS + 2
        assert len(Files(spark).names(f"{tmp_path}/manifests")) <= 2
    assert parts(spark, tmp_path)[0] <= most and parts(spark, tmp_path)[1] <= most * 12
    assert log.last_batch() == 49


def test_a_batch_run_again_counts_once(spark, tmp_path):
    log = log_at(spark, tmp_path)
    one = spark.createDataFrame([(1, 5, "a"), (2, 6, "b")], ROWS)
    assert held(log) == {} and log.last_batch() is None
    assert log.append(one, 0) and not log.append(one.withColumn("qty", F.lit(9).cast("bigint")), 0)
    assert held(log) == {1: (5, "a"), 2: (6, "b")}
    again = log_at(spark, tmp_path)
    assert again.holds(0) and not again.holds(1) and held(again) == held(log)


@pytest.mark.parametrize("step", ["write_text", "rename", "remove"])
def test_a_crash_between_the_steps_loses_nothing(spark, tmp_path, monkeypatch, step):
    log, want = log_at(spark, tmp_path), {}
    for number, rows in enumerate(batches(2, 14)):
        df = spark.createDataFrame(rows, ROWS)
        if number > 3:
            with monkeypatch.context() as cut:
                def broken(self, *args):
                    raise OSError("cut")

                cut.setattr(Files, step, broken)
                before = held(log_at(spark, tmp_path))
                with pytest.raises(OSError, match="cut"):
                    log.append(df, number)
            # Either nothing of the batch is there, or, past the switch, all of it.
            assert held(log_at(spark, tmp_path)) == (before | {k: (q, n) for k, q, n in rows} if step == "remove" else before)
        log.append(df, number)
        want |= {k: (q, n) for k, q, n in rows}
        assert held(log) == want


def test_a_second_writer_is_told(spark, tmp_path):
    first, second = log_at(spark, tmp_path), log_at(spark, tmp_path)
    rows = spark.createDataFrame([(1, 1, "a")], ROWS)
    manifest = second._manifest()
    first.append(rows, 0)
    with pytest.raises(RuntimeError, match="another writer"):
        second._switch(manifest | {"number": manifest["number"] + 1})


def test_shares_are_read_alone(spark, tmp_path):
    log = log_at(spark, tmp_path)
    log.append(spark.createDataFrame([(n, n, None) for n in range(40)], ROWS), 0)
    some = log.read([1])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_share" in plan.split("PartitionFilters: [")[1].split("]")[0]
    of_share = log.share_of(log.read()).filter("_share = 1")
    assert {r["item"] for r in some.collect()} == {r["item"] for r in of_share.collect()} != set()


# Alerts.


def replay(rows, opening, alert):
    """Crossings of all rows in the order of their time, in plain Python."""
    have, out = dict(opening), []
    for event, ts, _, _, item, qty, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if item not in alert:
            continue
        before = have.get(item, 0)
        have[item] = before + qty
        if before > alert[item] >= have[item]:
            out.append((item, event, "low", have[item]))
        elif before <= alert[item] < have[item]:
            out.append((item, event, "enough", have[item]))
    return sorted(out), have


def some_batches(seed, count):
    draw = random.Random(seed)
    event, out = 0, []
    for number in range(count):
        rows = []
        for _ in range(draw.randrange(1, 30)):
            event += 1
            rows.append(line(event, f"2020-02-{number + 1:02d}", "p", draw.choice([1, 1, 1, 2, 3, 9]), draw.randrange(-9, 9)))
        out.append(rows)
    return out


def shop_of(spark):
    items = frame(
        spark, "items",
        [{"itemID": n, "deleteStatus": "1" if n < 9 else "0", "stockAlert": 2 * n, "itemName": "x"} for n in (1, 2, 3, 9)],
    )
    opening = spark.createDataFrame([(1, 20), (1, -9), (2, 30), (7, 1)], "itemID bigint, qty int")
    return items, opening, {1: 11, 2: 30}, {1: 2, 2: 4, 3: 6}


def test_alerts_equal_a_replay_and_go_on_where_they_ended(spark, tmp_path):
    items, opening, known, alert = shop_of(spark)
    arrived = some_batches(4, 6)
    source = stream_of(spark, tmp_path, arrived[:4])
    place = str(tmp_path / "alerts")

    def drained(stream, floor):
        return alerts.LowStockAlerts(spark, items, opening, place, floor).drain(stream)

    def keys(df):
        return sorted((r["itemID"], r["event_id"], r["kind"], r["totalInStock"]) for r in df.collect())

    all_rows = [r for rows in arrived[:4] for r in rows]
    assert keys(drained(source, 10_000)) == replay(all_rows, known, alert)[0] != []
    for number, rows in enumerate(arrived[4:], 4):
        spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{tmp_path}/in/b={number}")
    again = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b=*")
    all_rows += [r for rows in arrived[4:] for r in rows]
    want, have = replay(all_rows, known, alert)
    # The second start cuts items with many rows into segments.
    assert keys(drained(again, 5)) == want
    on_hand = {r["itemID"]: r["totalInStock"] for r in alerts.LowStockAlerts(spark, items, opening, place).on_hand().collect()}
    moved = {i: q for i, q in have.items()} | {7: 1}
    assert {i: q for i, q in on_hand.items() if i != 9} == moved


def test_a_batch_of_alerts_that_was_cut_short_counts_once(spark, tmp_path, monkeypatch):
    items, opening, known, alert = shop_of(spark)
    rows = [r for batch in some_batches(6, 3) for r in batch]
    batch = spark.createDataFrame(rows, LINE).select("itemID", "qty", "event_id", "ts")
    found = alerts.LowStockAlerts(spark, items, opening, str(tmp_path / "alerts"))
    with monkeypatch.context() as cut:
        cut.setattr(StateLog, "append", lambda self, *a: (_ for _ in ()).throw(OSError("cut")))
        with pytest.raises(OSError, match="cut"):
            found.take(batch, 0)
    for _ in range(2):
        found.take(batch, 0)
    want, have = replay(rows, known, alert)
    got = sorted((r["itemID"], r["event_id"], r["kind"], r["totalInStock"]) for r in found.crossings().collect())
    assert got == want
    assert {r["itemID"]: r["totalInStock"] for r in found.on_hand().collect()}[1] == have[1]


def test_no_rows_no_alerts(spark, tmp_path):
    items, opening, _, _ = shop_of(spark)
    found = alerts.LowStockAlerts(spark, items, None, str(tmp_path / "alerts"))
    assert found.crossings().collect() == [] == found.on_hand().collect()
    found.take(spark.createDataFrame([(None, 5, 1, when("2020-01-01"))], "itemID bigint, qty int, event_id bigint, ts timestamp"), 0)
    assert found.crossings().collect() == []


def test_an_event_delivered_twice_is_summed_once(spark, tmp_path):
    one = line(1, "2020-01-05", "s", 1, 1, 4)
    source = stream_of(spark, tmp_path, [[one, line(2, "2020-01-05", "s", 1, 1, 5)], [one]])
    rows = dicts(streams.keep_latest(streams.stream_daily_sales(source), ["day", "sourceType"], spark))
    assert [(r["total"], r["n"]) for r in rows] == [(9, 2)]
