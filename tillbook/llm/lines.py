"""Line deduplication over windows of three consecutive lines.

Lines without a word are passed over and stay where they are. Every window of three others is
hashed to 128 bits; of the windows that occur more than once, all but the first occurrence,
in order of document and place, cover lines to be removed. What is covered in one document
is merged, so overlapping windows take a repeated passage out as a whole.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.text import BLANK_CLASS, only, whole


def repeated_lines_removed(docs: DataFrame, short: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_lines``, ``n_removed``, ``text``.

    ``n_lines`` counts lines with a word. A NULL text counts as empty. A text of fewer than
    three lines with words has no window and stays whole, unless ``short`` gives it one window
    over all of them, which only texts of as many lines share. A NULL id comes before all others.
    A row repeated in full is one document: its copies get the same result. Where a passage repeats itself
    at once, a later window also covers lines of the first occurrence: of the lines a, a, a, a one a is left, of
    x, y, x, y, x, y one x and y.
    """
    keys = ["doc_id", "_k"]
    lines = F.split(whole(), "\n")
    full = F.filter(
        F.transform("_lines", lambda line, i: F.struct(i.alias("i"), line.alias("line"))),
        lambda x: x.line.rlike(f"[^{BLANK_CLASS}]"),
    )
    rows = only(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("text", "doc_id").alias("_k"), lines.alias("_lines")
    )
    numbered = rows.select(*keys, "_lines", full.alias("_full"))
    threes = F.expr(
        """transform(slice(_full, 1, greatest(size(_full) - 2, 0)), (x, i) -> struct(
            xxhash64(x.line, _full[i + 1].line, _full[i + 2].line) as h1,
            xxhash64(_full[i + 2].line, 3, x.line, _full[i + 1].line) as h2,
            array(x.i, _full[i + 1].i, _full[i + 2].i) as covers))"""
    )
    if short:
        lone = F.expr(
            """array(struct(
                xxhash64(size(_full), _full.line) as h1,
                xxhash64(_full.line, size(_full), 1) as h2,
                _full.i as covers))"""
        )
        threes = F.when(F.size("_full").isin(1, 2), lone).otherwise(threes)
    windows = numbered.select(*keys, F.explode_outer(threes).alias("w")).select(
        *keys, "w.h1", "w.h2", "w.covers"
    )
    place = F.struct("doc_id", "_k", "covers")
    firsts = (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select("h1", "h2", "first")
    )
    covered = (
        windows.join(firsts, ["h1", "h2"])
        .filter(~F.col("first").eqNullSafe(place))
        .groupBy(*keys)
        .agg(F.array_distinct(F.flatten(F.collect_set("covers"))).alias("_gone"))
        .select(F.col("doc_id").alias("_id"), F.col("_k").alias("_k2"), "_gone")
    )
    joined = numbered.join(
        covered, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_k2")), "left"
    )
    # One flag per line, so that a line is looked up once and not searched for.
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    return joined.select(
        "doc_id",
        F.size("_full").cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        "_lines",
        kept.alias("_kept"),
    ).select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.array_join(F.transform("_kept", lambda i: F.col("_lines")[i]), "\n").alias("text"),
    )
