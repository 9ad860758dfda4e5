"""Distributed order, hot keys, nested documents."""

import random
import re

import pytest
from conftest import dicts
from pyspark.sql import functions as F

from tillbook.functions import ordered, spread
from tillbook.functions.documents import nested


@pytest.mark.parametrize("step", [1, 40_000, 2**40])
def test_neighbours(spark, step):
    chance = random.Random(step)
    ids = sorted({chance.randrange(-200, 800) * step for _ in range(500)})
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    got = {r["id"]: (r["b"], r["a"]) for r in dicts(ordered.neighbours(df, "id", "b", "a"))}
    expected = {
        i: (ids[n - 1] if n else None, ids[n + 1] if n + 1 < len(ids) else None)
        for n, i in enumerate(ids)
    }
    assert got == expected


@pytest.mark.parametrize("step", [1, 30_011, 2**41])
def test_descending_slice(spark, step):
    ids = [n * step for n in range(1000)]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    for skip, size in ((0, 5), (490, 20), (995, 20), (2000, 10)):
        got = sorted((r["id"] for r in dicts(ordered.descending_slice(df, "id", skip, size))), reverse=True)
        assert got == ids[::-1][skip : skip + size]


@pytest.mark.parametrize("step", [1, 100_000])
def test_a_page_ranks_only_the_ranges_it_meets(spark, step):
    ids = [n * step for n in range(4000)]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id bigint")
    ranges = ordered.Ranges(df, "id")
    largest = max(count for _, count, _, _ in ranges.counted)
    assert len(ranges.counted) == 8 and largest < 2 * len(ids) / 8
    page = ranges.page(2100, 20)
    assert sorted((r["id"] for r in page.collect()), reverse=True) == ids[::-1][2100:2120]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # At most the page and a range on either side of it.
    met = [c for n, c, _, _ in ranges.counted if f"_range#" in plan and n in asked(plan)]
    assert 1 <= len(met) <= 2 and sum(met) <= 20 + 2 * largest
    assert "Broadcast" not in plan or "ResolvedHint" not in page._jdf.queryExecution().analyzed().toString()


def asked(plan):
    """Numbers of the ranges that a plan's partition filter names."""
    named = plan.split("PartitionFilters: [")[1].split("]")[0]
    return {int(n) for n in re.findall(r"(?:= |IN \(|,)(\d+)", named)}


def test_ranges_of_nothing_and_of_one_id(spark):
    none = ordered.Ranges(spark.createDataFrame([(None,)], "id bigint"), "id")
    assert none.page(0, 5).collect() == [] == none.linked("b", "a").collect()
    one = ordered.Ranges(spark.createDataFrame([(7,)], "id bigint"), "id")
    assert [tuple(r) for r in one.linked("b", "a").collect()] == [(7, None, None)]
    assert [r["id"] for r in one.page(0, 5).collect()] == [7] and one.page(1, 5).collect() == []


def test_prefix_sums_of_one_huge_key(spark):
    chance = random.Random(5)
    rows = [(0 if n % 3 else n, n % 7, n, chance.randrange(-5, 9)) for n in range(4000)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, id bigint, v bigint")
    hot = spread.hot_keys(df, ["k"], floor=100)
    plain, cut = (
        {
            r["id"]: (r["running"], r["peak"], r["peak_before"])
            for r in dicts(ordered.prefix_sums(df, ["k"], ["o", "id"], "v", hot=keys))
        }
        for keys in (None, hot)
    )
    expected, state = {}, {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        total, peak = state.get(k, (0, None))
        total += v
        now = total if peak is None else max(peak, total)
        expected[i] = (total, now, peak)
        state[k] = (total, now)
    assert plain == expected
    assert cut == expected
    segments = ordered.segmented(df, ["k", "o", "id"]).filter("k = 0").select("_seg").distinct().count()
    assert segments > 1


def test_next_value(spark):
    chance = random.Random(6)
    rows = [(n % 2, n, chance.choice([None, None, None, n])) for n in range(900)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, v bigint")
    for hot in (None, spread.hot_keys(df, ["k"], floor=100)):
        got = {r["o"]: r["n"] for r in dicts(ordered.next_value(df, ["k"], ["o"], "v", "n", hot))}
        for k, o, _ in rows:
            following = [v for kk, oo, v in rows if kk == k and oo >= o and v is not None]
            assert got[o] == (following[0] if following else None)


def test_hot_keys_and_spread_join(spark):
    facts = spark.range(6000).selectExpr("case when id % 3 = 0 then 7 else id end k", "id")
    lookup = spark.range(6000).selectExpr("id k", "id * 2 twice")
    hot = spread.hot_keys(facts, ["k"], floor=100)
    found = dicts(hot)
    assert [r["k"] for r in found] == [7] and found[0]["_shares"] > 1
    parts = spread.with_part(facts, hot, ["k"], F.col("id")).filter("k = 7").groupBy("_part").count()
    assert parts.count() == found[0]["_shares"]
    joined = spread.spread_join(facts, lookup, ["k"], F.col("id"), hot)
    plain = facts.join(lookup, "k")
    assert joined.count() == plain.count() == 6000
    assert joined.exceptAll(plain.select(joined.columns)).count() == 0
    assert spread.hot_keys(facts, ["k"]) is None


def test_large_documents_come_in_parts(spark):
    heads = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc bigint, name string")
    lines = spark.range(5000).selectExpr("case when id < 4990 then 1 else 2 end doc", "id line", "id * 2 v")
    split = [dicts(nested(heads, lines, "doc", "line", "lines", None, 500, floor)) for floor in (100, 10**6)]
    assert sorted(map(repr, split[0])) == sorted(map(repr, split[1]))
    rows = split[0]
    big = sorted((r for r in rows if r["doc"] == 1), key=lambda r: r["part"])
    assert [r["part"] for r in big] == list(range(10))
    assert [x["line"] for r in big for x in r["lines"]] == list(range(4990))
    assert [len(r["lines"]) for r in big] == [500] * 9 + [490]
    two = [r for r in rows if r["doc"] == 2]
    assert len(two) == 1 and [x["line"] for x in two[0]["lines"]] == list(range(4990, 5000))
    assert [(r["part"], r["lines"]) for r in rows if r["doc"] == 3] == [(0, [])]
