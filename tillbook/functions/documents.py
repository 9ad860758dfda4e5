"""Nested documents: a header with an array of its lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.ordered import prefix_sums
from tillbook.functions.spread import HOT_FLOOR, hot_keys

LINES_PER_PART = 10_000


def nested(
    heads: DataFrame,
    lines: DataFrame,
    key: str,
    line_key: str,
    alias: str,
    counted: DataFrame | None = None,
    lines_per_part: int = LINES_PER_PART,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Joins headers with arrays of their lines, sorted by line id.

    A row holds ``lines_per_part`` lines at most. Parts are numbered from 0 and run on in the
    order of the lines, so what a document looks like depends on nothing but its own lines. A
    header without lines keeps one row with an empty array.

    Lines are numbered by a window per document; the documents that are large for a task
    (see ``hot_keys``, with ``floor``) are numbered in segments, with the same outcome. ``counted``
    may give a cheaper frame with the same keys to find these in.
    """
    hot = hot_keys(lines if counted is None else counted, [key], floor)
    fields = [c for c in lines.columns if c != key]
    ordered_fields = [line_key, *[c for c in fields if c != line_key]]
    numbered = prefix_sums(lines.withColumn("_one", F.lit(1)), [key], [line_key], "_one", hot=hot)
    part = F.floor((F.col("running") - 1) / F.lit(lines_per_part)).cast("int")
    gathered = (
        numbered.withColumn("_part", part)
        .groupBy(key, "_part")
        .agg(F.sort_array(F.collect_list(F.struct(*ordered_fields))).alias(alias))
    )
    return (
        heads.join(gathered, key, "left")
        .withColumn("part", F.coalesce("_part", F.lit(0)))
        .withColumn(alias, F.coalesce(alias, F.array().cast(gathered.schema[alias].dataType)))
        .drop("_part")
    )
