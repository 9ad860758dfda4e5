"""Runs registered queries in Spark and in DuckDB and compares all rows.

    python check.py [folder] [name ...]
"""

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from tillbook.plans import registry

RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tillbook")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in RAW:
        connection.execute(f"create view {name} as from '{folder}/{name}.parquet'")
    return connection


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, connection, folder: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = registry.queries()[name](spark, folder)
    ours = rows_of(df.columns, df.collect())
    took = time.time() - started
    result = connection.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    if len(ours) != len(theirs):
        return False, f"{len(ours)} rows / {len(theirs)} rows"
    for mine, other in zip(ours, theirs):
        if repr(mine) != repr(other):
            return False, f"{mine} / {other}"
    return True, f"{len(ours)} rows, {took:.2f} s"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registry.oracle_sql())
    spark, connection = session(), database(folder)
    bad = 0
    for name in names:
        try:
            good, note = compare(spark, connection, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            good, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not good
        print("ok  " if good else "BAD ", name, note, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
