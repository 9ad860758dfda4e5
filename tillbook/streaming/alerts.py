"""Alerts of low stock as a stream: items whose quantity crosses their alert quantity.

Quantities on hand are a ``StateLog`` seeded from the stored stock. A micro-batch reads the shares of the state that its
items lie in, adds up its rows in the order of their time, and gives out the rows at which an item
falls to its alert quantity or rises above it again. Crossings are written before the state moves on, into
a folder named by the batch, so a batch that is run again gives the same crossings and counts once.
"""


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.functions.ordered import prefix_sums
from tillbook.functions.shared import new_folder
from tillbook.functions.spread import HOT_FLOOR, hot_keys
from tillbook.streaming.state_log import StateLog

ORDER = ["ts", "event_id"]
LOW, ENOUGH = "low", "enough"
CROSSING = "itemID bigint, event_id bigint, ts timestamp, kind string, totalInStock bigint, stockAlert int"
ON_HAND = "itemID bigint, totalInStock bigint"
# The seed is the batch before all others.
SEED = -1


def crossings(rows: DataFrame, on_hand: DataFrame, items: DataFrame, floor: int = HOT_FLOOR) -> DataFrame:
    """Rows (itemID, qty, event_id, ts) at which a live item falls to its alert quantity or rises above it.

    ``on_hand`` holds the quantities before the rows; an item without one starts from nothing. Rows without item or
    quantity move nothing.
    """
    live = items.filter(F.col("deleteStatus") == S.YES).select("itemID", "stockAlert")
    moves = rows.filter(F.col("itemID").isNotNull()).select(
        "itemID", "event_id", "ts", F.coalesce("qty", F.lit(0)).cast("bigint").alias("qty")
    )
    summed = prefix_sums(moves, ["itemID"], ORDER, "qty", hot=hot_keys(moves, ["itemID"], floor))
    known = summed.join(live, "itemID").join(on_hand, "itemID", "left")
    after = F.coalesce("totalInStock", F.lit(0)) + F.col("running")
    alert = F.col("stockAlert")
    falls = (after <= alert) & (after - F.col("qty") > alert)
    rises = (after > alert) & (after - F.col("qty") <= alert)
    kind = F.when(falls, LOW).when(rises, ENOUGH)
    return known.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        "itemID", "event_id", "ts", "kind", after.cast("bigint").alias("totalInStock"), "stockAlert"
    )


class LowStockAlerts:
    """Alerts over a stream of stock rows, with what it needs to go on: ``folder`` and the stream's checkpoint."""

    def __init__(
        self, spark: SparkSession, items: DataFrame, opening: DataFrame | None = None,
        folder: str | None = None, floor: int = HOT_FLOOR,
    ):
        self.spark, self.items, self.floor = spark, items, floor
        self.folder = folder or new_folder(spark, "alerts")
        schema = spark.createDataFrame([], ON_HAND).schema
        self.state = StateLog(spark, f"{self.folder}/state", ["itemID"], schema)
        if not self.state.holds(SEED):
            given = spark.createDataFrame([], "itemID bigint, qty bigint") if opening is None else opening
            sums = given.groupBy("itemID").agg(F.sum("qty").cast("bigint").alias("totalInStock"))
            self.state.append(sums.filter(F.col("itemID").isNotNull()), SEED)

    def take(self, batch: DataFrame, number: int) -> None:
        """Works in one micro-batch."""
        if self.state.holds(number):
            return
        batch = batch.persist()
        try:
            sums = batch.filter(F.col("itemID").isNotNull()).groupBy("itemID").agg(
                F.sum("qty").cast("bigint").alias("_moved")
            )
            # A number for each share, of which there are few.
            shares = [r[0] for r in self.state.share_of(sums).select("_share").distinct().collect()]
            before = self.state.read(shares)
            found = crossings(batch, before, self.items, self.floor)
            found.write.mode("overwrite").parquet(f"{self.folder}/crossings/batch={number}")
            total = F.coalesce("totalInStock", F.lit(0)) + F.coalesce("_moved", F.lit(0))
            after = sums.join(before, "itemID", "left")
            self.state.append(after.select("itemID", total.cast("bigint").alias("totalInStock")), number)
        finally:
            batch.unpersist()

    def drain(self, stock_rows: DataFrame, checkpoint: str | None = None) -> DataFrame:
        """Takes in all the stream holds now, and gives all crossings so far."""
        checkpoint = checkpoint or f"{self.folder}/checkpoint"
        writer = stock_rows.select("itemID", "qty", "event_id", "ts").writeStream
        query = (
            writer.foreachBatch(self.take)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return self.crossings()

    def crossings(self) -> DataFrame:
        """All crossings given out so far."""
        names = self.state.files.names(f"{self.folder}/crossings")
        if not names:
            return self.spark.createDataFrame([], CROSSING)
        return self.spark.read.schema(CROSSING).parquet(f"{self.folder}/crossings").drop("batch")

    def on_hand(self) -> DataFrame:
        return self.state.read()
