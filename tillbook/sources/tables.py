"""The ``Tables`` container, its loaders, and the Parquet sink."""

from collections.abc import Callable, Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook import schema as S

Source = DataFrame | Callable[["Tables"], DataFrame]


class Tables:
    """Named DataFrames, reached as attributes and built on first use."""

    def __init__(self, sources: Mapping[str, Source]):
        self._sources = dict(sources)
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name not in self._sources:
                raise AttributeError(f"no table {name!r}")
            source = self._sources[name]
            self._built[name] = source if isinstance(source, DataFrame) else source(self)
        return self._built[name]

    def names(self) -> list[str]:
        return sorted(self._sources)

    def replaced(self, **sources: Source) -> "Tables":
        """The same tables with some of them exchanged."""
        return Tables({**self._sources, **sources})


def from_parquet(spark: SparkSession, folder: str) -> Tables:
    """Tables stored one folder each, read with their declared schema."""

    def reader(name: str) -> Callable[[Tables], DataFrame]:
        return lambda _: spark.read.schema(S.TABLES[name]).parquet(f"{folder}/{name}")

    return Tables({name: reader(name) for name in S.TABLES})


# Columns stored under another name in the shop database.
STORED_AS = {"priceExpenseUSD": "priceExpense$"}


def columns_of(name: str) -> list[str]:
    declared = S.TABLES[name].replace("\n", " ")
    for spec in {S.MONEY, S.IQD, S.RATE, S.CONVERTED}:
        declared = declared.replace(spec, "decimal")
    return [part.split()[0] for part in declared.split(",")]


def from_jdbc(
    spark: SparkSession,
    url: str,
    properties: Mapping[str, str],
    ranges: Mapping[str, tuple[str, int, int, int]] | None = None,
    prefix: str = "tbl_",
) -> Tables:
    """Tables in a database. ``ranges`` gives (id column, lowest, highest, parts) for parallel reads.

    Only declared columns are asked for, so no credential column is ever loaded.
    """

    def reader(name: str) -> Callable[[Tables], DataFrame]:
        def load(_: Tables) -> DataFrame:
            reading = spark.read.format("jdbc").options(**properties).option("url", url)
            reading = reading.option("dbtable", f"{prefix}{name}")
            if ranges and name in ranges:
                column, low, high, parts = ranges[name]
                reading = reading.options(
                    partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts
                )
            return conformed(reading.load(), name)

        return load

    return Tables({name: reader(name) for name in S.TABLES})


def conformed(df: DataFrame, name: str, absent: Collection[str] | None = None) -> DataFrame:
    """Only the declared columns, in the declared types.

    Columns that ``df`` lacks become NULL. If ``absent`` is given, only those it names may be
    lacking, and any other is an error that names it.
    """
    if absent is not None:
        there = {column.lower() for column in df.columns} | {column.lower() for column in absent}
        lacking = [c for c in columns_of(name) if STORED_AS.get(c, c).lower() not in there and c.lower() not in there]
        if lacking:
            raise ValueError(f"table {name} lacks {', '.join(lacking)}")
    target = df.sparkSession.createDataFrame([], S.TABLES[name]).schema
    present = {column.lower(): column for column in df.columns}
    columns = []
    for field in target:
        stored = STORED_AS.get(field.name, field.name)
        found = present.get(stored.lower())
        value = F.col(f"`{found}`") if found else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def write_ledger(df: DataFrame, path: str, day_of: str = "createAt") -> None:
    """Stores a ledger partitioned by day.

    Rows are rebalanced by day: the adaptive planner splits a busy day over several
    tasks and puts quiet days together, so neither ends in one huge file or in a
    flood of small ones.
    """
    (
        df.withColumn("day", F.to_date(day_of))
        .hint("rebalance", "day")
        .write.mode("overwrite")
        .partitionBy("day")
        .parquet(path)
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A stored ledger; filters on ``day`` prune partitions."""
    return spark.read.parquet(path)


def write_tables(tables: Tables, folder: str, names: list[str] | None = None) -> None:
    """Stores tables so that ``from_parquet`` finds them."""
    for name in names or tables.names():
        if name in S.TABLES:
            getattr(tables, name).write.mode("overwrite").parquet(f"{folder}/{name}")
