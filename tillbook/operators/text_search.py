"""Items found by very many patterns at once, through an index of letter triples.

Every item is entered under the triples of its lower-cased code and name. A pattern of three letters or
more asks for the items of its rarest triple, by an equality join, and ``contains`` then decides, so
what is compared is the postings of one triple a pattern, not all items. Shorter patterns have no
triple: they are compared with the distinct single letters and pairs of every item, which are entered likewise. The counts
that say which triple is rarest come from the same postings.

A triple of the items' names may be very common (the first letters of all codes, say); no pattern asks for it unless
it has nothing rarer, and then its rows are what the plain search would look at. The adaptive skew join
splits them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.shared import stored

LETTERS = 3


def runs(text: Column, size: int) -> Column:
    """The distinct runs of so many letters of a text; none where it is shorter or NULL."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    cut = F.transform(starts, lambda at: F.substr(text, at, F.lit(size)))
    return F.coalesce(
        F.when(F.length(text) >= size, F.array_distinct(cut)), F.array().cast("array<string>")
    )


def posted(items: DataFrame, size: int) -> DataFrame:
    """``run`` and ``itemID`` for every run of so many letters in an item's code or name."""
    both = F.array_union(runs(F.lower("itemCode"), size), runs(F.lower("itemName"), size))
    return items.select("itemID", F.explode(both).alias("run"))


class ItemIndex:
    """Postings of all items, written once, for any number of searches."""

    def __init__(self, items: DataFrame):
        self.items = items
        every = None
        for size in range(1, LETTERS + 1):
            rows = posted(items, size).withColumn("size", F.lit(size))
            every = rows if every is None else every.unionByName(rows)
        self.postings = stored(every)
        self.counts = stored(self.postings.groupBy("size", "run").agg(F.count(F.lit(1)).alias("n")))

    def asked(self, patterns: DataFrame) -> DataFrame:
        """``pattern``, lower-cased and distinct, with the run it asks for and how many items that has.

        A pattern with a run that no item has finds nothing and is left out. NULL and empty patterns ask for
        nothing either.
        """
        given = (
            patterns.select(F.lower(F.col("pattern").cast("string")).alias("pattern"))
            .filter(F.length("pattern") > 0)
            .distinct()
            .withColumn("size", F.least(F.length("pattern"), F.lit(LETTERS)))
        )
        parts = given.withColumn(
            "run",
            F.explode(
                F.when(F.col("size") == 1, runs(F.col("pattern"), 1))
                .when(F.col("size") == 2, runs(F.col("pattern"), 2))
                .otherwise(runs(F.col("pattern"), LETTERS))
            ),
        )
        return (
            parts.join(self.counts, ["size", "run"], "left")
            .groupBy("pattern", "size")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("_rarest"))
            .select("pattern", "size", "_rarest.run", "_rarest.n")
            .filter(F.col("n") > 0)
        )

    def candidates(self, patterns: DataFrame) -> DataFrame:
        """``pattern`` and ``itemID`` to look at: the items of each pattern's rarest run."""
        return self.asked(patterns).join(self.postings, ["size", "run"]).select("pattern", "itemID")

    def search(self, patterns: DataFrame, prefix: bool = False) -> DataFrame:
        """Items whose code or name contains, or starts with, a pattern; case does not matter.

        One row per distinct lower-cased pattern and item, as ``stock.item_search`` has it.
        """
        found = self.candidates(patterns).join(self.items, "itemID")
        code, name = F.lower("itemCode"), F.lower("itemName")
        hit = (
            F.startswith(code, F.col("pattern")) | F.startswith(name, F.col("pattern"))
            if prefix
            else F.contains(code, F.col("pattern")) | F.contains(name, F.col("pattern"))
        )
        return found.filter(hit).select(
            "pattern", "itemID", "itemCode", "itemName", "costPrice", "itemPriceRetail", "itemPriceWhole",
            "perUnit",
        )
