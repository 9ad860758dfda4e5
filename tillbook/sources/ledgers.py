"""A ledger stored by day, some of whose days can be replaced.

New rows of the days are written beside the ledger first, whole. Only then do they take the place of
the old ones, by Spark's overwrite of single partitions. Until they are whole the old days stand; from then on the
replacement can be finished by whoever opens the ledger next, any number of times. One writer at a time.
"""

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.functions.files import Files

# Names that begin with an underscore are not read as part of the ledger.
PENDING = "_pending"
# Fixed value: Spark's folder for rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"

Days = Iterable[dt.date | None]


class DayLedger:
    """``schema`` is that of the rows without ``day``, the day of ``day_of``.

    The rows of a file are sorted by ``sorted_by``, so that its row groups hold narrow ranges of these columns, and
    files carry Bloom filters of the columns in ``filters``, where these have too many values for a dictionary:
    reports of one item or document skip what cannot hold it, within the days they read.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, day_of: str = "createAt",
        sorted_by: Sequence[str] = (), filters: Sequence[str] = (),
    ):
        self.spark, self.path, self.day_of = spark, path.rstrip("/"), day_of
        self.files = Files(spark)
        self.sorted_by = list(sorted_by)
        self.options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in filters}
        self.schema = T.StructType([*schema, T.StructField("day", T.DateType())])
        self.pending = f"{self.path}/{PENDING}"

    def write(self, rows: DataFrame) -> None:
        """Stores a whole ledger. Busy days are spread over several tasks, quiet ones put together."""
        dealt = self._dealt(self._with_day(rows))
        dealt.write.mode("overwrite").options(**self.options).partitionBy("day").parquet(self.path)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        dealt = rows.hint("rebalance", "day")
        return dealt.sortWithinPartitions("day", *self.sorted_by) if self.sorted_by else dealt

    def read(self) -> DataFrame:
        """All rows, with ``day``. A replacement that is whole but not finished is finished first."""
        self.finish()
        return self._rows()

    def of(self, days: Days) -> DataFrame:
        """The rows of some days; the folders of all others stay unread."""
        self.finish()
        return self._rows().filter(among(days))

    def replace(self, days: Days, rows: DataFrame) -> None:
        """Makes ``rows`` the rows of the days, none of which may lie on another day.

        A day without rows goes. If this fails before the new rows are whole, nothing has happened.
        """
        self.finish()
        days = sorted(set(days), key=str)
        listed = self.spark.createDataFrame([(d,) for d in days], "day date")
        new = self._with_day(rows.drop("day"))
        strange = F.when(among(days), F.col("day")).otherwise(
            F.raise_error(F.concat(F.lit("a row outside the days to replace: "), F.col("day").cast("string")))
        )
        self.files.remove(self.pending)
        (
            new.withColumn("day", strange.cast("date"))
            .hint("rebalance", "day")
            .write.parquet(f"{self.pending}/rows")
        )
        # The list comes last: when it is whole, so are the rows.
        listed.coalesce(1).write.parquet(f"{self.pending}/days")
        self.finish()

    def finish(self) -> bool:
        """Finishes a replacement that was begun; tells whether there was one."""
        if not self.files.exists(f"{self.pending}/days/_SUCCESS"):
            return False
        rows = self.spark.read.schema(self.schema).parquet(f"{self.pending}/rows")
        days = [r["day"] for r in self.spark.read.schema("day date").parquet(f"{self.pending}/days").collect()]
        filled = {r["day"] for r in rows.select("day").distinct().collect()}
        (
            self._dealt(rows)
            .write.mode("overwrite")
            .options(**self.options)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(self.path)
        )
        for day in days:
            if day not in filled:
                self.files.remove(f"{self.path}/day={NO_DAY if day is None else day.isoformat()}")
        self.files.remove(self.pending)
        return True

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _with_day(self, rows: DataFrame) -> DataFrame:
        kept = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema if f.name != "day"]
        return rows.select(*kept).withColumn("day", F.to_date(self.day_of))


def among(days: Days) -> Column:
    """Rows of the given days, as a condition that prunes folders."""
    days = list(days)
    known = [d for d in days if d is not None]
    parts = [F.col("day").isin(known)] if known else []
    if len(known) < len(days):
        parts.append(F.col("day").isNull())
    return reduce(Column.__or__, parts) if parts else F.lit(False)
