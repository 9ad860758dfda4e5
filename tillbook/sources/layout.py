"""Tables stored in buckets, so that what joins and groups by their key needs no shuffle.

Rows are dealt over files by a hash of the key and sorted by it in each. Tables of the same number of buckets and the same key
type meet bucket by bucket: a sum by the key, a join on it, and the exchange of changed documents in a
ledger read each row where it lies.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from tillbook.sources.tables import Tables

# Keys the shop's large tables are joined and summed by.
BY_ITEM = {"items": "itemID", "stock": "itemID"}


def store_in_buckets(
    rows: DataFrame, table: str, path: str, keys: str | Sequence[str], buckets: int
) -> None:
    """Stores rows as a table of the catalog, in a folder of its own. Each bucket is written by one task.

    The rows are dealt by the key before they are written, so there is one file a bucket and not one for each
    bucket and task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    (
        rows.repartition(buckets, *keys)
        .write.mode("overwrite")
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", path)
        .format("parquet")
        .saveAsTable(table)
    )


def with_buckets(
    spark: SparkSession, tables: Tables, folder: str, buckets: int,
    keys: Mapping[str, str | Sequence[str]] = BY_ITEM, prefix: str = "bucketed_",
) -> Tables:
    """The same tables, some of them stored in buckets and read from there."""
    for name, key in keys.items():
        store_in_buckets(getattr(tables, name), f"{prefix}{name}", f"{folder}/{name}", key, buckets)
    return tables.replaced(
        **{name: (lambda _, name=name: spark.table(f"{prefix}{name}")) for name in keys}
    )
