"""Order-dependent work that must not run in one task.

Two tools. Unique ids are cut into evenly filled ranges and each range is counted, which gives the place of
any id from the few counts before its range and its rank inside it. For any other order within a
key, an ordinary key is a plain window; the rows of a hot key are range partitioned
and the partition number is the segment. Either cut depends on a sample, so it is made
once and written to the shared folder before it is used.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tillbook.functions.shared import new_folder, stored

BEFORE = Window.unboundedPreceding
AFTER = Window.unboundedFollowing

RANGE = "_range"


class Ranges:
    """Unique ids in evenly filled ranges, whatever lies between them: an equi-depth histogram of the ids.

    The ids are range partitioned and written once, a folder a range; there are as many ranges as shuffle
    partitions, and of each the number of ids and the least and largest one are kept here. A page then reads the ranges
    it meets and ranks their ids alone. Rows without id have no place.
    """

    def __init__(self, ids: DataFrame, key: str):
        self.spark, self.key = ids.sparkSession, key
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = new_folder(self.spark, "ranges")
        cut = ids.select(key).filter(F.col(key).isNotNull()).repartitionByRange(parts, key)
        cut.withColumn(RANGE, F.spark_partition_id()).write.partitionBy(RANGE).parquet(self.folder)
        schema = StructType([ids.schema[key], StructField(RANGE, IntegerType())])
        self.rows = self.spark.read.schema(schema).parquet(self.folder)
        counted = self.rows.groupBy(RANGE).agg(F.count(key), F.min(key), F.max(key)).collect()
        # (range, ids, least, largest), in order: one row a range.
        self.counted = sorted(tuple(r) for r in counted)

    def page(self, skip: int, size: int) -> DataFrame:
        """The ids at places skip .. skip + size - 1, largest first."""
        met, before = [], 0
        for number, count, _, _ in reversed(self.counted):
            if before < skip + size and before + count > skip:
                met.append((number, before))
            before += count
        inside = Window.partitionBy(RANGE).orderBy(F.desc(self.key))
        starts = self.spark.createDataFrame(met, f"{RANGE} int, _before bigint")
        place = F.col("_before") + F.row_number().over(inside) - 1
        return (
            self.rows.filter(F.col(RANGE).isin([number for number, _ in met]))
            .join(starts, RANGE)
            .withColumn("_place", place)
            .filter((F.col("_place") >= skip) & (F.col("_place") < skip + size))
            .select(self.key)
        )

    def linked(self, before: str, after: str) -> DataFrame:
        """Every id with the next smaller and the next larger one."""
        ends = [
            (
                number,
                self.counted[at - 1][3] if at else None,
                self.counted[at + 1][2] if at + 1 < len(self.counted) else None,
            )
            for at, (number, _, _, _) in enumerate(self.counted)
        ]
        kind = self.rows.schema[self.key].dataType.simpleString()
        edges = self.spark.createDataFrame(ends, f"{RANGE} int, _under {kind}, _over {kind}")
        inside = Window.partitionBy(RANGE).orderBy(self.key)
        return self.rows.join(edges, RANGE).select(
            self.key,
            F.coalesce(F.lag(self.key).over(inside), "_under").alias(before),
            F.coalesce(F.lead(self.key).over(inside), "_over").alias(after),
        )


def neighbours(ids: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Each unique id with the next smaller and the next larger one."""
    return Ranges(ids, key).linked(before, after)


def descending_slice(df: DataFrame, key: str, skip: int, size: int) -> DataFrame:
    """The unique ids at places skip .. skip + size - 1, largest first.

    For several pages of the same ids, keep ``Ranges`` and ask it.
    """
    return Ranges(df, key).page(skip, size)


def segmented(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``_seg``: as many consecutive, evenly filled ranges as there are shuffle partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *order).withColumn("_seg", F.spark_partition_id())
    return stored(cut)


def _split(df: DataFrame, hot: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary keys and those of hot keys."""
    if hot is None:
        return df, None
    names = [c for c in hot.columns if c != "_shares"]
    listed = F.broadcast(hot.select(*names))
    return df.join(listed, names, "left_anti"), df.join(listed, names, "left_semi")


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    per_key: DataFrame | None = None,
    hot: DataFrame | None = None,
    peak_at: Column | None = None,
) -> DataFrame:
    """Running sums of a value per key, in an order that ends in a unique column.

    Adds ``running``, the sum up to and with the row; ``peak``, the highest running
    sum so far; ``peak_before``, the same without the row, NULL on the first one. With ``peak_at`` only
    the sums at rows of that condition count for the peak, which is NULL before the first of them.
    ``per_key`` may hold one row of further columns per key, or per first part of
    it, to bring along. ``hot`` lists the keys to cut into segments.
    """
    keys = list(keys)
    plain, large = _split(df, hot)
    on = [k for k in keys if per_key is not None and k in per_key.columns]
    if per_key is not None:
        plain = plain.join(per_key, on, "left")
    within = Window.partitionBy(*keys).orderBy(*order)
    done = plain.withColumn("running", F.sum(value).over(within.rowsBetween(BEFORE, 0)))
    done = done.withColumn("peak", F.max(_at("running", peak_at)).over(within.rowsBetween(BEFORE, 0)))
    done = done.withColumn("peak_before", F.lag("peak").over(within))
    if large is None:
        return done
    return done.unionByName(_segment_sums(large, keys, order, value, per_key, on, peak_at))


def _at(column: str, condition: Column | None) -> Column:
    return F.col(column) if condition is None else F.when(condition, F.col(column))


def _segment_sums(
    df: DataFrame,
    keys: list[str],
    order: Sequence[str],
    value: str,
    per_key: DataFrame | None,
    on: list[str],
    peak_at: Column | None = None,
) -> DataFrame:
    """The same for hot keys: no task sees more of one than a segment.

    Between segments only one row per (key, segment) travels.
    """
    rows = segmented(df, [*keys, *order])
    inside = Window.partitionBy("_seg", *keys).orderBy(*order)
    rows = rows.withColumn("_run", F.sum(value).over(inside.rowsBetween(BEFORE, 0)))
    rows = rows.withColumn("_peak", F.max(_at("_run", peak_at)).over(inside.rowsBetween(BEFORE, 0)))
    rows = rows.withColumn("_peak_before", F.lag("_peak").over(inside))
    earlier = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(BEFORE, -1)
    carried = (
        rows.groupBy("_seg", *keys)
        .agg(F.sum(value).alias("_sum"), F.max(_at("_run", peak_at)).alias("_top"))
        .withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .withColumn("_base_peak", F.max(F.col("_base") + F.col("_top")).over(earlier))
        .drop("_sum", "_top")
    )
    if per_key is not None:
        carried = carried.join(per_key, on, "left")
    return (
        rows.join(carried, ["_seg", *keys])
        .withColumns(
            {
                "running": F.col("_base") + F.col("_run"),
                "peak": F.greatest("_base_peak", F.col("_base") + F.col("_peak")),
                "peak_before": F.greatest("_base_peak", F.col("_base") + F.col("_peak_before")),
            }
        )
        .drop("_seg", "_run", "_peak", "_peak_before", "_base", "_base_peak")
    )


def next_value(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    alias: str,
    hot: DataFrame | None = None,
) -> DataFrame:
    """For each row the nearest non-null value at or after it within its key."""
    keys = list(keys)
    plain, large = _split(df, hot)
    ahead = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, AFTER)
    done = plain.withColumn(alias, F.first(value, ignorenulls=True).over(ahead))
    if large is None:
        return done
    return done.unionByName(_segment_next(large, keys, order, value, alias))


def _segment_next(
    df: DataFrame, keys: list[str], order: Sequence[str], value: str, alias: str
) -> DataFrame:
    rows = segmented(df, [*keys, *order])
    ahead = Window.partitionBy("_seg", *keys).orderBy(*order).rowsBetween(0, AFTER)
    following = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(1, AFTER)
    heads = (
        rows.filter(F.col(value).isNotNull())
        .groupBy("_seg", *keys)
        .agg(F.min_by(value, F.struct(*order)).alias("_head"))
    )
    # Segments without a value still need what comes after them.
    heads = (
        rows.select("_seg", *keys)
        .distinct()
        .join(heads, ["_seg", *keys], "left")
        .withColumn("_later", F.first("_head", ignorenulls=True).over(following))
        .drop("_head")
    )
    return (
        rows.withColumn("_near", F.first(value, ignorenulls=True).over(ahead))
        .join(heads, ["_seg", *keys])
        .withColumn(alias, F.coalesce("_near", "_later"))
        .drop("_seg", "_near", "_later")
    )
