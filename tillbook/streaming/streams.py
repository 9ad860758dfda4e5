"""Streams over line events (event_id, ts, sourceID, sourceType, itemID, qty, price, cost).

Results that change over time are kept as a ``StateLog``: each micro-batch adds its changed rows, a
batch that is run again counts once, and folders are merged so that the log stays short.
The current state is the row of the latest batch per key.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tillbook import schema as S
from tillbook.functions.shared import new_folder
from tillbook.sources.retail import RAW
from tillbook.streaming.state_log import StateLog

def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The events of a folder as a stream. Watermarks need a zoned timestamp, so ``ts`` is cast."""
    return (
        spark.readStream.schema(RAW["events"])
        .option("pathGlobFilter", name)
        .parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def as_line_events(events: DataFrame) -> DataFrame:
    """Test events read as stock movements, one kind of movement per event type."""
    kind = F.col("event_type")
    code = (
        F.when(kind == "click", S.SALE)
        .when(kind == "purchase", S.SALE_RETURN)
        .when(kind == "signup", S.PURCHASE)
        .when(kind == "view", S.PURCHASE_RETURN)
        .otherwise(S.DISPOSAL)
    )
    amount = F.col("value").cast("decimal(12,2)")
    return events.select(
        "event_id",
        "ts",
        F.col("event_id").alias("sourceID"),
        code.alias("sourceType"),
        F.col("user_id").alias("itemID"),
        F.ceil(amount).cast("int").alias("qty"),
        amount.cast(S.MONEY).alias("itemPrice"),
        (amount / 2).cast(S.MONEY).alias("costPrice"),
    )


def stream_post_stock(lines: DataFrame, delay: str = "1 day") -> DataFrame:
    """Line events as stock rows; an event delivered twice within the delay posts once."""
    incoming = F.col("sourceType").isin(S.SALE_RETURN, S.PURCHASE)
    return (
        lines.withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
        .select(
            "event_id",
            "ts",
            "sourceID",
            "sourceType",
            "itemID",
            F.when(incoming, F.col("qty")).otherwise(-F.col("qty")).alias("qty"),
            "itemPrice",
            "costPrice",
        )
    )


def stream_daily_sales(lines: DataFrame, delay: str = "7 days") -> DataFrame:
    """Value moved per day and kind; a day stays open for late rows until the delay has passed.

    An event delivered twice within the delay counts once.
    """
    return (
        lines.withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
        .groupBy(F.window("ts", "1 day").alias("_day"), "sourceType")
        .agg(
            F.sum("itemPrice").cast(S.TOTAL).alias("total"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(F.to_date(F.col("_day.start")).alias("day"), "sourceType", "total", "n")
    )


def stream_on_hand(stock_rows: DataFrame) -> DataFrame:
    """Running quantity per item."""
    return stock_rows.groupBy("itemID").agg(F.sum("qty").cast("bigint").alias("totalInStock"))


def _drain(writer: DataStreamWriter, checkpoint: str) -> None:
    """Runs a stream over all there is now, and waits."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_to_files(
    stream: DataFrame, spark: SparkSession, checkpoint: str | None = None, target: str | None = None
) -> DataFrame:
    """Drains an append-only stream into Parquet files and reads them back.

    With the same ``checkpoint`` and ``target`` the next call goes on where this one
    ended, state and watermark included. Without them each call starts anew.
    """
    checkpoint, target = _places(spark, checkpoint, target)
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", target)
    _drain(writer, checkpoint)
    return spark.read.schema(stream.schema).parquet(target)


def keep_latest(
    stream: DataFrame,
    keys: Sequence[str],
    spark: SparkSession,
    checkpoint: str | None = None,
    target: str | None = None,
) -> DataFrame:
    """Drains an updating stream into a log and returns the latest row per key.

    ``checkpoint`` and ``target`` as in ``append_to_files``. A stream without input gives no rows.
    """
    checkpoint, target = _places(spark, checkpoint, target)
    log = StateLog(spark, target, keys, stream.schema)
    _drain(stream.writeStream.outputMode("update").foreachBatch(log.append), checkpoint)
    return log.read()


def _places(spark: SparkSession, checkpoint: str | None, target: str | None) -> tuple[str, str]:
    if (checkpoint is None) != (target is None):
        raise ValueError("give checkpoint and target together, or neither")
    if checkpoint is None:
        return new_folder(spark, "stream-state"), new_folder(spark, "stream-rows")
    return checkpoint, target


def low_stock(on_hand: DataFrame, items: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Live items whose quantity is at or below their alert quantity, those never moved included.

    ``opening`` holds the stock rows (itemID, qty) from before the stream began; the running
    quantity is added to their sum.
    """
    known = on_hand.select("itemID", "totalInStock")
    if opening is not None:
        before = opening.groupBy("itemID").agg(F.sum("qty").cast("bigint").alias("totalInStock"))
        known = known.unionByName(before)
    known = known.groupBy("itemID").agg(F.sum("totalInStock").alias("totalInStock"))
    return (
        items.filter(F.col("deleteStatus") == S.YES)
        .select("itemID", "itemName", "stockAlert")
        .join(known, "itemID", "left")
        .withColumn("totalInStock", F.coalesce("totalInStock", F.lit(0).cast("bigint")))
        .filter(F.col("totalInStock") <= F.col("stockAlert"))
        .select("itemID", "itemName", "totalInStock")
    )
