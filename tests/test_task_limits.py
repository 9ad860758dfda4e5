"""What one task is dealt."""

import re

from test_ledgers import explained
from tillbook import session
from tillbook.functions.files import Files
from tillbook.plans import registry
from tillbook.sources import retail

ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SCANNED = "spark.sql.files.maxPartitionBytes"


def test_a_task_is_dealt_at_most_sixteen_mb(spark):
    other = spark.newSession()
    assert session.in_bytes(other.conf.get(ADVISED)) > 16 << 20
    session.ready(other)
    for name, most in session.AT_MOST.items():
        assert session.in_bytes(other.conf.get(name)) == most


def test_smaller_limits_of_the_caller_stay(spark):
    other = spark.newSession()
    other.conf.set(ADVISED, "64k")
    session.ready(other)
    assert other.conf.get(ADVISED) == "64k"


def test_sizes_as_spark_writes_them():
    written = {"64MB": 64 << 20, "16k": 16 << 10, "67108864b": 64 << 20, "5": 5, "1g": 1 << 30, "2 mib": 2 << 20}
    assert {text: session.in_bytes(text) for text in written} == written


def test_partitions_follow_the_size_of_the_files(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "4")
    session.ready(other, 10 * session.FILE_BYTES + 1)
    assert other.conf.get(session.INITIAL) == "11"
    session.ready(other, session.FILE_BYTES)
    assert other.conf.get(session.INITIAL) == "11"


def test_larger_numbers_of_partitions_of_the_caller_stay(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "40")
    session.ready(other, 10 * session.FILE_BYTES)
    assert other.conf.get(session.INITIAL, None) is None
    other.conf.set(session.INITIAL, "20")
    session.ready(other, 10 * session.FILE_BYTES)
    assert other.conf.get(session.INITIAL) == "40"


def test_stock_reports_read_no_larger_partitions_when_few_are_set(spark, tmp_path, monkeypatch):
    """Two partitions set, but a query deals its rows to one for as many bytes of the files."""
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "2")
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name, columns in retail.RAW.items():
        other.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    size = retail.size(other, str(tmp_path))
    monkeypatch.setattr(session, "FILE_BYTES", size // 9)
    found = registry.queries()
    for name in (
        "repost_expenses", "item_catalog", "lack_in_stock", "stock_counters", "sales_by_owner", "top_categories",
    ):
        other.conf.unset(session.INITIAL)
        plan = explained(found[name](other, str(tmp_path)))
        dealt = {int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan)}
        assert dealt and min(dealt) >= 9, (name, dealt)


def test_a_scan_reads_at_most_32_mb(spark):
    other = spark.newSession()
    other.conf.set(SCANNED, "128m")
    session.ready(other)
    assert session.in_bytes(other.conf.get(SCANNED)) == 32 << 20
    other.conf.set(SCANNED, "1m")
    session.ready(other)
    assert other.conf.get(SCANNED) == "1m"


def test_broadcasts_are_guessed_by_unpacked_size(spark, tmp_path):
    """A file of 3 MB is not broadcast as if its rows took 3 MB."""
    other = session.ready(spark.newSession())
    path = str(tmp_path / "rows.parquet")
    other.range(800_000).selectExpr("id", "id % 7 n").coalesce(1).write.parquet(path)
    bytes_there = Files(other).size(path)
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", str(2 * bytes_there))
    rows = other.read.parquet(path)
    assert "BroadcastHashJoin" not in explained(rows.join(rows.withColumnRenamed("n", "m"), "id"))
    other.conf.set(session.FACTOR, "20.0")
    assert session.ready(other).conf.get(session.FACTOR) == "20.0"
