"""Mixing sources to target weights by thresholds on a hash.

Every document has a hash of 60 bits. A source takes all its documents some whole number of
times, and once more those whose hash is below its threshold. To find the threshold, words are
summed by source and the first ten bits of the hash; the budget ends inside one bucket, and
only that bucket is summed again by the next ten bits, and once more by the ten after these.
Nothing is sorted, a larger budget takes all that a smaller one takes, and a run
repeated takes the same.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillbook.functions.shared import stored
from tillbook.llm.text import only, words

BITS, STEP, STEPS = 60, 10, 3
# Weights of the sources in order of their names, again and again.
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3


def hash60(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, BITS // 4), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` as ``_row``, its ``size`` in words, the key ``_source`` that is never NULL, and ``_hash``.

    The row's own columns are kept in a struct, so none of their names meets one of ours.
    """
    present = {c.lower(): c for c in docs.columns}

    def own(name: str) -> Column:
        return F.col(f"_row.`{present[name]}`") if name in present else F.lit(None).cast("string")

    text = F.coalesce(own("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return rows.select(
        "_row",
        F.size(words(text)).cast("long").alias("size"),
        F.when(own("source").isNull(), F.lit("n"))
        .otherwise(F.concat(F.lit("s"), own("source").cast("string")))
        .alias("_source"),
        hash60(F.coalesce(own("doc_id").cast("string"), text)).alias("_hash"),
    )


def targets(sizes: DataFrame, weights: Sequence[int], most_times: int) -> DataFrame:
    """``_source``, ``source_size`` and ``target``: one row per source.

    Sources fill up evenly, in proportion to their weights, until all words are dealt
    out; one that is full at ``most_times`` its size stops. In order of the level at which they
    are full, the common level is the first at which the rest could take what remains.
    """
    per_source = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(W.orderBy(F.col("_source").startswith("n"), "_source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(at, F.lit(len(weights))) + 1)
    capped = per_source.withColumn("w", weight.cast("double")).withColumn(
        "cap", (F.lit(most_times) * F.col("source_size")).cast("double")
    )
    order = W.orderBy(F.col("cap") / F.col("w"), "_source")
    level = (
        F.sum(F.col("source_size").cast("double")).over(W.partitionBy())
        - (F.sum("cap").over(order) - F.col("cap"))
    ) / (F.sum("w").over(W.partitionBy()) - (F.sum("w").over(order) - F.col("w")))
    levels = capped.select("*", level.alias("level"), F.row_number().over(order).alias("at"))
    chosen = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("at", "level")))
    return levels.withColumn("chosen", chosen.over(W.partitionBy())).select(
        "_source",
        "source_size",
        F.least("cap", F.col("w") * F.col("chosen.level")).alias("target"),
    )


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``_source``, ``source_size``, ``target``, whole ``times`` and ``below`` for each source."""
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    bounds = (
        goals.withColumn("times", F.coalesce(times, F.lit(0)).cast("long"))
        .withColumn("left", F.col("target") - F.col("times") * F.col("source_size"))
        .withColumn("before", F.lit(0).cast("long"))
        .withColumn("prefix", F.lit(0).cast("long"))
    )
    for step in range(1, STEPS + 1):
        shift = BITS - STEP * step
        upper = F.shiftright("_hash", shift + STEP)
        buckets = (
            sizes.select("_source", "size", upper.alias("prefix"), F.shiftright("_hash", shift).alias("bucket"))
            .join(bounds.select("_source", "prefix"), ["_source", "prefix"])
            .groupBy("_source", "bucket")
            .agg(F.sum("size").alias("words"))
        )
        # At most 2**10 buckets of a source are left.
        upto = F.sum("words").over(W.partitionBy("_source").orderBy("bucket"))
        ends = buckets.select("_source", "bucket", "words", upto.alias("upto")).join(
            bounds.select("_source", F.col("before").alias("start"), "left"), "_source"
        )
        crossed = ends.filter(F.col("start") + F.col("upto") >= F.col("left")).groupBy("_source").agg(
            F.min(
                F.struct(
                    F.col("bucket").alias("prefix"),
                    (F.col("start") + F.col("upto") - F.col("words")).alias("before"),
                    F.col("words"),
                )
            ).alias("c")
        )
        bounds = stored(
            bounds.drop("prefix", "before", "words").join(crossed, "_source", "left").select(
                "_source", "source_size", "target", "times", "left",
                F.col("c.prefix"), F.coalesce("c.before", F.lit(0).cast("long")).alias("before"),
                F.coalesce("c.words", F.lit(0).cast("long")).alias("words"),
            )
        )
    nearer = F.abs(F.col("before") + F.col("words") - F.col("left")) < F.abs(F.col("left") - F.col("before"))
    below = F.shiftleft(F.col("prefix") + F.when(nearer, 1).otherwise(0), BITS - STEP * STEPS)
    return bounds.select("_source", "source_size", "target", "times", F.coalesce(below, F.lit(0).cast("long")).alias("below"))


RESULTS = ("size", "source_size", "target", "times", "taken")


def taken(docs: DataFrame, weights: Sequence[int], most_times: int) -> DataFrame:
    """Every row of ``docs`` as ``_row``, with the results."""
    sized = measured(docs)
    sizes = stored(sized.select("_source", "size", "_hash"))
    cuts = stored(thresholds(sizes, stored(targets(sizes, weights, most_times))))
    times = F.col("_times") + F.when(F.col("_hash") < F.col("_below"), 1).otherwise(0)
    return (
        sized.join(cuts.withColumnsRenamed({"times": "_times", "below": "_below"}), "_source")
        .withColumn("times", times)
        .withColumn("taken", F.col("size") * F.col("times"))
        .select("_row", *RESULTS)
    )


def mixed(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most_times: int = MOST_TIMES
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``times`` taken and words ``taken``.

    A NULL text has size 0, a NULL source is a source of its own and comes last. Documents
    with equal ids, and those with a NULL id and equal texts, are taken alike. Without any
    words all targets are 0 and nothing is taken. Columns of ``docs`` that are called like a result
    give way to it; all others stay, whatever their names.
    """
    names = [c for c in docs.columns if c.lower() not in RESULTS]
    return taken(docs, weights, most_times).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in names], *RESULTS
    )


def mixing_report(docs: DataFrame) -> DataFrame:
    return mixed(only(docs, "doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def repeated(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as many times as it is taken, with all their own columns."""
    rows = taken(docs, WEIGHTS, MOST_TIMES).filter(F.col("times") > 0)
    return rows.select(
        "_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_copy")
    ).select("_row.*")
