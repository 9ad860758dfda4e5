"""Session settings the operators count on."""

import re

from pyspark.sql import SparkSession

SETTINGS = {
    # Days are UTC days throughout.
    "spark.sql.session.timeZone": "UTC",
    # Split an oversized join partition even if the aggregate after it then needs
    # a shuffle of its own: a key may hold a third of all rows.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# What adaptive execution deals to one task, compressed. A join of ledger rows with the aggregations after it
# holds about twenty times that in memory, so Spark's own 64 MB would be more than a GB a task.
AT_MOST = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 64 << 20,
    # A scan that feeds more than 200 partitions holds its rows until they are written, sorted by partition.
    "spark.sql.files.maxPartitionBytes": 32 << 20,
}
# Bytes in memory for a byte of a file, when Spark guesses whether a table is small enough to broadcast: a few columns
# of seven million items are 6 MB of files and several hundred MB on the driver.
FACTOR, UNPACKED = "spark.sql.sources.fileCompressionFactor", 8.0
# Adaptive execution joins partitions up to the size above but cuts none, outside skewed joins. So there is one for
# as many bytes of the tables' files, whatever number of them the caller has set.
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
FILE_BYTES = 4 << 20
UNITS = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}


def in_bytes(text: str) -> int:
    """A size as Spark's settings write it, like 64MB or 16k."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([bkmgtp]?)(?:i?b)?\s*", text.lower()).groups()
    return int(number) << UNITS[unit]


def based(spark: SparkSession) -> SparkSession:
    """A session with the settings that results and hot keys need."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def ready(spark: SparkSession, size: int = 0) -> SparkSession:
    """A session for the ledgers: the base, and tasks of bounded size for tables whose files have ``size`` bytes.

    Smaller limits of the caller stay, and larger numbers of partitions.
    """
    based(spark)
    for name, most in AT_MOST.items():
        if in_bytes(spark.conf.get(name)) > most:
            spark.conf.set(name, f"{most}b")
    if float(spark.conf.get(FACTOR)) < UNPACKED:
        spark.conf.set(FACTOR, str(UNPACKED))
    given, initial = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.conf.get(INITIAL, None)
    partitions = max(-(-size // FILE_BYTES), given, int(initial or 0))
    if partitions > int(initial or given):
        spark.conf.set(INITIAL, str(partitions))
    return spark
