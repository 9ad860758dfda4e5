"""Benchmark decontamination: which documents hold windows of ten words of a benchmark item.

A window is the set of its three-word shingles in their places. For a document to contain
it, it must contain any one of them, so one is enough to look for: the rarest in the corpus.

1. Shingles of the benchmark are counted in the whole corpus.
2. Each window is entered under its rarest shingle; a window with a shingle that no document
   has is dropped.
3. Places of those shingles in documents are joined with the windows. A window must then
   fit between the document's first and last word (length and positional bounds), and all
   its words must be equal there (verification on the words themselves).

The corpus is read once. A document's shingles are compared with the benchmark's where the
document is read: a bit filter, as large as the benchmark asks for, sorts out nearly all of
them and never loses one. What passes is written with the words around it, and all three
steps work on that.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.shared import stored
from tillbook.llm.text import lower_ascii, only, whole

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
# Longs of the bit filter: so many for each shingle, within these bounds. The upper one is 16 MB, with which ten million
# shingles let a word in forty pass that is none of theirs; what passes is compared, so nothing is lost either way.
LONGS_PER_SHINGLE, LEAST_LONGS, MOST_LONGS = 0.5, 2**8, 2**21
# The windows are broadcast if they and the items listed with them are this few and take at most
# 200 bytes each; else they are shuffled.
MOST_BROADCAST = 50_000
BROADCAST_BYTES = 200


def item_words(text: Column) -> Column:
    """Runs of digits, a-z and non-ASCII characters of the text with A-Z lower-cased."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def shingles(words: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words of an array column, in order."""
    rest = "".join(f", {words}[i + {k}]" for k in range(1, size))
    starts = f"slice({words}, 1, greatest(size({words}) - {size - 1}, 0))"
    return F.expr(f"transform({starts}, (w, i) -> xxhash64(w{rest}))")


def benchmark_windows(items: DataFrame) -> DataFrame:
    """Distinct windows: ``window`` (its words), ``length``, ``items`` that have it, ``shingle_size``."""
    lists = (
        only(items, "item_id", "text")
        .select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
            item_words(whole()).alias("w"),
        )
        .filter(F.size("w") > 0)
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    return (
        lists.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, WINDOW))).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("length", F.size("window"))
        .withColumn("shingle_size", F.least("length", F.lit(SHINGLE)))
    )


def window_shingles(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per shingle of each window, with its ``offset`` in the window."""
    hashes = F.coalesce(
        *[F.when(F.col("shingle_size") == n, shingles("window", n)) for n in sizes]
    )
    return windows.select("*", F.posexplode(hashes).alias("offset", "shingle"))


def bit_filter(hashes: DataFrame, rows: int) -> tuple[Column, int]:
    """A one-row array of bits with two set for each hash, and how many longs it has."""
    longs = LEAST_LONGS
    while longs < min(rows * LONGS_PER_SHINGLE, MOST_LONGS):
        longs *= 2
    spark = hashes.sparkSession
    places = hashes.select(F.explode(F.array(*probes(F.col("shingle"), longs))).alias("p"))
    words = places.groupBy("p.at").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p.bit"))).alias("bits")
    )
    filled = spark.range(longs).select(F.col("id").cast("int").alias("at")).join(words, "at", "left")
    ordered = F.sort_array(
        F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))
    )
    return filled.agg(F.transform(ordered, lambda x: x.bits)).scalar(), longs


def probes(h: Column, longs: int) -> list[Column]:
    """The two places of a hash: which long, and which bit of it."""

    def place(shift: int) -> Column:
        x = F.shiftrightunsigned(h, shift)
        return F.struct(
            F.shiftrightunsigned(x, 6).bitwiseAND(longs - 1).cast("int").alias("at"),
            x.bitwiseAND(63).cast("int").alias("bit"),
        )

    return [place(0), place(29)]


def found_places(docs: DataFrame, keys: list[str], sizes: list[int], bits: tuple[Column, int]) -> DataFrame:
    """``keys``, ``n_words`` and ``hits``, the places of shingles that pass the bit filter.

    A hit has its place ``at``, its ``shingle``, and the words ``near`` it that any window
    with that shingle could have, which start at ``first``.
    """
    column, longs = bits
    before = WINDOW - 1

    def passes(h: Column) -> Column:
        first, second = probes(h, longs)

        def is_set(p: Column) -> Column:
            return F.call_function("getbit", F.col("_bits")[p.at], p.bit) == 1

        return is_set(first) & is_set(second)

    def of_size(n: int) -> Column:
        rest = "".join(f", _w[i + {k}]" for k in range(1, n))
        starts = f"slice(_w, 1, greatest(size(_w) - {n - 1}, 0))"
        numbered = F.expr(
            f"transform({starts}, (w, i) -> struct(i as at, xxhash64(w{rest}) as shingle))"
        )
        return F.filter(numbered, lambda x: passes(x.shingle))

    near = F.transform(
        F.concat(*[of_size(n) for n in sizes]),
        lambda x: F.struct(
            x.at.alias("at"),
            x.shingle.alias("shingle"),
            F.greatest(x.at - before, F.lit(0)).alias("first"),
            F.slice(
                "_w",
                F.greatest(x.at - before, F.lit(0)) + 1,
                F.least(x.at, F.lit(before)) + WINDOW,
            ).alias("near"),
        ),
    )
    return docs.withColumn("_bits", column).select(
        *keys, F.size("_w").cast("long").alias("n_words"), near.alias("hits")
    )


def few(entries: DataFrame) -> bool:
    """Whether stored windows may be broadcast: by their number, their items and their bytes."""
    size = sum(F.octet_length(F.array_join(c, " ")) + 8 * F.size(c) for c in ("window", "items"))
    n, with_items, in_all = entries.agg(
        F.count(F.lit(1)), F.sum(F.size("items")), F.sum(size.cast("long"))
    ).first()
    return max(n, with_items or 0) <= MOST_BROADCAST and (in_all or 0) <= BROADCAST_BYTES * MOST_BROADCAST


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, its key, ``n_words``, ``n_hit`` and ``items``.

    ``_k1`` and ``_k2`` are hashes of id and text together, so rows that share an id are told
    apart and a NULL id is a document like any other; a row repeated in full comes once. A
    NULL text has no words, nor has one of punctuation alone. ``n_hit`` counts words inside any
    window found, each once. ``items`` lists the items as strings, in order; an item with
    a NULL id is called ''. With no items, or items without words, nothing is hit.
    """
    keyed = only(docs, "doc_id", "text").select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("_k1"),
        F.xxhash64("text", F.lit(1), "doc_id").alias("_k2"),
        item_words(whole()).alias("_w"),
    )
    keys = ["doc_id", "_k1", "_k2"]
    windows = stored(benchmark_windows(items))
    sizes = sorted(r[0] for r in windows.select("shingle_size").distinct().collect())  # at most 3
    if not sizes:
        return keyed.groupBy(*keys).agg(
            F.first(F.size("_w").cast("long")).alias("n_words"),
            F.lit(0).cast("long").alias("n_hit"),
            F.array().cast("array<string>").alias("items"),
        )
    listed = stored(window_shingles(windows, sizes))
    distinct = listed.select("shingle").distinct()
    n_shingles = distinct.count()
    places = stored(found_places(keyed, keys, sizes, bit_filter(distinct, n_shingles)))
    counts = (
        places.select(F.explode("hits.shingle").alias("shingle")).groupBy("shingle").count()
    )
    rarest = (
        listed.join(counts, "shingle", "left")
        .groupBy("window", "length", "items")
        .agg(
            F.min(
                F.struct(F.coalesce("count", F.lit(0)).alias("n"), "shingle", "offset")
            ).alias("r")
        )
        .filter(F.col("r.n") > 0)
        .select("window", "length", "items", F.col("r.shingle"), F.col("r.offset"))
    )
    entries = stored(rarest)
    small = few(entries)
    rows = places.select(*keys, "n_words", F.explode("hits").alias("hit")).select(
        *keys, "n_words", "hit.at", "hit.shingle", "hit.first", "hit.near"
    )
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    same = F.slice("near", start - F.col("first") + 1, F.col("length")) == F.col("window")
    joined = rows.join(F.broadcast(entries) if small else entries, "shingle")
    hit = F.when(fits, F.when(same, F.struct(start.alias("s"), (start + F.col("length")).alias("e"))))
    covered = F.aggregate(
        F.array_sort("_spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct(
            (a.n + F.greatest(x.e - F.greatest(x.s, a.upto), F.lit(0))).alias("n"),
            F.greatest(x.e, a.upto).alias("upto"),
        ),
        lambda a: a.n,
    )
    found = joined.select(*keys, "n_words", hit.alias("_hit"), "items").filter(F.col("_hit").isNotNull())
    # Every document has a row, with or without hits; none of them goes through the join for it.
    each = places.select(
        *keys, "n_words", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("_hit", "items")]
    )
    return (
        each.unionByName(found)
        .groupBy(*keys)
        .agg(
            F.max("n_words").alias("n_words"),
            F.collect_set("_hit").alias("_spans"),
            F.collect_set(F.when(F.col("_hit").isNotNull(), F.col("items"))).alias("_items"),
        )
        .select(
            *keys,
            "n_words",
            covered.cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items"),
        )
    )


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Counts, a digest of the items found and the verdict, per document."""
    return overlaps(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with all their columns.

    What they are compared with are keys of the documents found, written first, so that the planner knows
    how few they are.
    """
    leaks = stored(overlaps(docs, items).filter(F.col("n_hit") > 0).select("_k1", "_k2"))
    doc_id, text = F.col("d.doc_id"), F.col("d.text")
    same = (F.xxhash64(doc_id, text) == F.col("m._k1")) & (
        F.xxhash64(text, F.lit(1), doc_id) == F.col("m._k2")
    )
    return docs.alias("d").join(leaks.alias("m"), same, "left_anti")
