"""Retail prices under time-limited discounts.

A discount holds from its start day up to, not including, its end day. Where
several hold at once, the latest start wins, then the highest id.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions.dates import Day, as_date


def effective_price(t, day: Day) -> DataFrame:
    """The retail price of every item on a day."""
    today = F.lit(as_date(day))
    best = (
        t.discounts.filter((F.col("startDate") <= today) & (F.col("endDate") > today))
        .groupBy("itemID")
        .agg(
            F.max_by("priceAfterDiscount", F.struct("startDate", "dID")).alias("_price"),
            F.max_by("dID", F.struct("startDate", "dID")).alias("dID"),
        )
    )
    return t.items.join(best, "itemID", "left").select(
        "itemID",
        "itemCode",
        F.coalesce("_price", "itemPriceRetail").alias("effectivePrice"),
        "dID",
    )


def price_calendar(t, first: Day, last: Day) -> DataFrame:
    """Discounted prices per item and day of a period; days at the normal price are left out.

    Each discount is cut to the period before it is unrolled into days, so a day
    and an item meet by equality and no range join is needed.
    """
    start, stop = as_date(first), as_date(last)
    return (
        t.discounts.filter(
            (F.col("startDate") <= F.lit(stop))
            & (F.col("endDate") > F.lit(start))
            & (F.col("endDate") > F.col("startDate"))
        )
        .withColumn(
            "day",
            F.explode(
                F.sequence(
                    F.greatest("startDate", F.lit(start)),
                    F.least(F.date_sub("endDate", 1), F.lit(stop)),
                )
            ),
        )
        .groupBy("itemID", "day")
        .agg(
            F.max_by("priceAfterDiscount", F.struct("startDate", "dID")).alias("effectivePrice"),
            F.max_by("dID", F.struct("startDate", "dID")).alias("dID"),
        )
    )


def discount_states(t, day: Day) -> DataFrame:
    """Discounts as waiting, started or ended on a day."""
    today = F.lit(as_date(day))
    state = (
        F.when(F.col("startDate") > today, "waiting")
        .when(F.col("endDate") > today, "started")
        .otherwise("ended")
    )
    return t.discounts.select("dID", "itemID", "startDate", "endDate", state.alias("state"))


# Blocks of 2**0 to 2**TOP days.
TOP = 12


def _days(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), level)


def _blocks(start: Column, end: Column) -> Column:
    """The fewest blocks of 1, 2, 4 .. days that make up [start, end), as (level, number) pairs.

    On every level but the top one there are two at most, one on either side.
    """

    def of_level(level: Column) -> Column:
        size = _days(level)
        first, stop = F.ceil(start / size), F.floor(end / size)
        left = F.when(first % 2 != 0, F.array(first))
        right = F.when(stop % 2 != 0, F.array(stop - 1))
        none = F.array().cast("array<bigint>")
        some = F.concat(F.coalesce(left, none), F.coalesce(right, none))
        numbers = F.when(level < TOP, some).otherwise(F.sequence(first, stop - 1))
        found = F.when(first < stop, F.array_distinct(numbers)).otherwise(none)
        return F.transform(found, lambda n: F.struct(level.alias("level"), n.alias("number")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(TOP)), of_level))


def price_pieces(t) -> DataFrame:
    """Discounted prices as pieces of time: ``[fromDate, toDate)`` per item with the discount that holds.

    The starts and ends of an item's discounts cut its time; in each part the latest start wins, then the highest
    id, as in ``effective_price``. Neighbouring parts of the same discount are one piece, so a discount
    nobody interrupts is one row, however long.

    A discount is entered under the few blocks of days that make it up, and of every block only the best is
    kept, by an aggregation that starts before the shuffle, so no item is too large. What holds at a cut is the best of the
    blocks around it, one of each size. Cuts of an item are days of the calendar, so their number has a bound.
    Discounts without item, without id, without days, or that end before they start make no piece.
    """
    valid = t.discounts.filter(
        F.col("itemID").isNotNull() & F.col("dID").isNotNull() & (F.col("startDate") < F.col("endDate"))
    )
    start, end = F.unix_date("startDate").cast("bigint"), F.unix_date("endDate").cast("bigint")
    best = (
        valid.select(
            "itemID",
            F.struct("startDate", "dID", F.col("priceAfterDiscount").alias("price")).alias("_own"),
            F.explode(_blocks(start, end)).alias("_block"),
        )
        .groupBy("itemID", "_block.level", "_block.number")
        .agg(F.max("_own").alias("_best"))
    )
    cuts = valid.select("itemID", F.explode(F.array("startDate", "endDate")).alias("fromDate")).distinct()
    around = cuts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(TOP)))).withColumn(
        "number",
        F.floor(F.unix_date("fromDate") / _days(F.col("level"))),
    )
    held = (
        around.join(best, ["itemID", "level", "number"], "left")
        .groupBy("itemID", "fromDate")
        .agg(F.max("_best").alias("_best"))
    )
    line = Window.partitionBy("itemID").orderBy("fromDate")
    parts = held.withColumn("toDate", F.lead("fromDate").over(line)).select(
        "itemID", "fromDate", "toDate", "_best.dID", F.col("_best.price").alias("effectivePrice")
    )
    new = ~F.col("dID").eqNullSafe(F.lag("dID").over(line))
    piece = F.sum(F.when(new, 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return (
        parts.withColumn("_piece", piece)
        .filter(F.col("dID").isNotNull())
        .groupBy("itemID", "_piece", "dID", "effectivePrice")
        .agg(F.min("fromDate").alias("fromDate"), F.max("toDate").alias("toDate"))
        .drop("_piece")
    )


# Days of a bin of the interval join.
BIN = 32


def prices_on(t, dated: DataFrame, day: str = "day", pieces: DataFrame | None = None) -> DataFrame:
    """Rows (itemID and a date) with the price that held then: ``effectivePrice`` and ``dID``, NULL without discount.

    Pieces are entered under the bins of ``BIN`` days they touch, rows under the one of their day, so they meet by
    equality of item and bin, and the piece's bounds decide. Pieces of an item do not overlap, so a row meets
    one at most. ``pieces`` may be given, say a stored ``price_pieces(t)``.
    """
    held = (price_pieces(t) if pieces is None else pieces).select(
        F.col("itemID").alias("_item"), F.col("fromDate").alias("_from"), F.col("toDate").alias("_to"),
        F.col("dID"), F.col("effectivePrice"),
    )

    def bin_of(date: Column) -> Column:
        return F.floor(F.unix_date(date) / F.lit(BIN))

    binned = held.withColumn(
        "_bin", F.explode(F.sequence(bin_of(F.col("_from")), bin_of(F.date_sub("_to", 1))))
    )
    rows = dated.withColumn("_day", F.to_date(day))
    inside = (F.col("_from") <= F.col("_day")) & (F.col("_to") > F.col("_day"))
    return rows.join(
        binned,
        (F.col("itemID") == F.col("_item")) & (bin_of(F.col("_day")) == F.col("_bin")) & inside,
        "left",
    ).drop("_item", "_from", "_to", "_bin", "_day")
