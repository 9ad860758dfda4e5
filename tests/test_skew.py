"""Test data bent so that single keys hold a third of all rows, with every split forced."""

import check
import duckdb
import pytest

from tillbook.functions import documents, spread
from tillbook.operators import allocation, changes
from tillbook.plans import registry
from tillbook.sources import retail

SOURCE = "/root/testdata/sf0.001"

BENT = {
    "lineitem": """l_orderkey: case when hash(l_orderkey, l_partkey, l_tax) % 3 = 0 then 14 else l_orderkey end;
        l_partkey: case when hash(l_orderkey, l_partkey, l_discount) % 3 = 0 then 77 else l_partkey end;
        l_suppkey: case when hash(l_orderkey, l_partkey, l_quantity) % 3 = 0 then 4 else l_suppkey end""",
    "orders": """o_custkey: case when o_orderkey % 3 = 0 then 5 else o_custkey end;
        o_orderdate: case when o_orderkey % 3 = 0 then timestamp '1998-06-12' else o_orderdate end""",
    "events": "user_id: case when event_id % 3 = 0 then 4 else user_id end",
}

FORCED = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4000",
    "spark.sql.files.maxPartitionBytes": "20000",
    "spark.sql.files.openCostInBytes": "0",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}

NAMES = [
    "in_stock", "profit_by_item", "sales_by_owner", "items_sold_by_customer", "sold_items_total",
    "post_sales_stock", "post_purchase_stock", "repost_changed", "customer_netting", "partner_statement",
    "latest_purchase_price", "merge_invoice_lines", "invoice_neighbours", "purchase_page_deep",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("skewed")
    connection = duckdb.connect()
    for name in check.RAW:
        bent = BENT.get(name)
        columns = "*"
        if bent:
            pairs = [part.split(":", 1) for part in bent.split(";")]
            columns = "* replace (" + ", ".join(f"{text} as {name.strip()}" for name, text in pairs) + ")"
        connection.execute(
            f"copy (select {columns} from '{SOURCE}/{name}.parquet') to '{path}/{name}.parquet'"
            " (row_group_size 2048)"
        )
    return str(path)


@pytest.fixture
def forced(spark):
    before = {name: spark.conf.get(name, None) for name in FORCED}
    for name, value in FORCED.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("name", NAMES)
def test_skewed_data_agrees(forced, folder, name):
    good, note = check.compare(forced, check.database(folder), folder, name)
    assert good, note


def test_oversized_join_partitions_are_split(forced, folder):
    df = registry.queries()["in_stock"](forced, folder)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # The join on the item splits, although the sum by item after it then shuffles again.
    assert "SortMergeJoin(skew=true)" in final


def same(left, right) -> bool:
    right = right.select(left.columns)
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_splitting_does_not_change_results(forced, folder):
    t = retail.load(forced, folder)
    assert same(allocation.allocate_repayments(t, floor=20), allocation.allocate_repayments(t))
    assert same(changes.apply_line_events(t.line_events, floor=20), changes.apply_line_events(t.line_events))


def test_hot_document_is_split_and_whole(forced, folder):
    t = retail.load(forced, folder)
    lines = t.invoice_item.select("invoiceID", "invdID", "itemID")
    hot = spread.hot_keys(lines, ["invoiceID"], floor=50)
    assert [r["invoiceID"] for r in hot.collect()] == [14]
    docs = documents.nested(
        t.invoices.select("invoiceID"), lines, "invoiceID", "invdID", "lines", lines_per_part=50, floor=50
    )
    assert docs.filter("invoiceID = 14").count() > 1
    opened = docs.selectExpr("invoiceID", "inline(lines)")
    assert same(opened, lines)


def test_every_query_is_registered_once():
    assert len(registry.queries()) == len(registry.QUERIES) + len(registry.STREAMS)
