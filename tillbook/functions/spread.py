"""Spreading hot keys over many tasks.

A key is *hot* when it holds more than a tenth of an average shuffle partition.
With P shuffle partitions at most 10 * P keys can be hot, whatever the data, so
the list of hot keys has a bound set by configuration and may be broadcast.
Every other key fits a task by the same definition.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.shared import stored

# Below this many rows a key is never worth splitting.
HOT_FLOOR = 10_000
SHARES_PER_PARTITION = 10


def hot_keys(df: DataFrame, keys: Sequence[str], floor: int = HOT_FLOOR) -> DataFrame | None:
    """Hot keys with ``_shares``, the number of parts each is to be split into; None if there are none.

    The keys are counted right away, once, and the short list is kept in the
    shared folder, so that the plans built on it do not count again.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = counts.filter(F.col("_n") > floor)
    total = df.select(*keys).agg(F.count(F.lit(1))).scalar()
    share = F.greatest(F.lit(floor), F.ceil(total / F.lit(partitions * SHARES_PER_PARTITION)))
    hot = (
        large.withColumn("_share", share)
        .filter(F.col("_n") > F.col("_share"))
        .select(*keys, F.ceil(F.col("_n") / F.col("_share")).cast("int").alias("_shares"))
    )
    hot = stored(hot)
    return None if hot.isEmpty() else hot


def with_part(
    df: DataFrame, hot: DataFrame | None, keys: Sequence[str], row_key: Column
) -> DataFrame:
    """Adds ``_part``: 0 for ordinary keys, a hash share of the rows for hot ones."""
    if hot is None:
        return df.withColumn("_part", F.lit(0))
    return (
        df.join(F.broadcast(hot), list(keys), "left")
        .withColumn(
            "_part",
            F.coalesce(F.pmod(F.xxhash64(row_key), F.col("_shares")), F.lit(0)).cast("int"),
        )
        .drop("_shares")
    )


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    row_key: Column,
    hot: DataFrame | None,
    how: str = "inner",
) -> DataFrame:
    """Joins facts to a lookup with one row per key; hot keys are split over many tasks.

    The lookup row of a hot key is repeated once per share, which adds at most
    20 * P rows in all.
    """
    keys = list(keys)
    if hot is None:
        return facts.join(lookup, keys, how)
    left = with_part(facts, hot, keys, row_key)
    right = (
        lookup.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_shares"), F.lit(1)) - 1))
        )
        .drop("_shares")
    )
    return left.join(right, [*keys, "_part"], how).drop("_part")
