"""Documents that repayments list, as counted references instead of comma lists.

A bridge holds one row per repayment and listed document, with how often it is listed. Appending and taking out are
merges into the bridge, and what a document's status follows from is the sum of its references: it is settled with the
first listing and open again only when the last one goes. The two sides of the shop are alike: customers'
repayments list invoices, suppliers' list purchases.

Changes have the repayment's key, the document's key, ``change``: ``APPEND`` or ``REMOVE``, and ``seq``. Taking
out removes all listings of a document from its repayment at once, as the shop does; what is appended later counts anew.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook import schema as S
from tillbook.functions.names import explode_ids, id_list

APPEND, REMOVE = "append", "remove"


@dataclass(frozen=True)
class Listing:
    """Repayments and their list, the documents it names, and the status column a listing sets.

    ``reopened`` is what the column says once the last listing has gone.
    """

    repayments: str
    key: str
    column: str
    documents: str
    document: str
    status: str
    settled: str
    reopened: str


SUPPLIERS = Listing("return_debt", "rdID", "purchaseNumbers", "purchases", "purchaseID", "debtStatus", S.YES, S.NO)
CUSTOMERS = Listing(
    "return_debt_customer", "rdcID", "invoiceNumbers", "invoices", "invoiceID", "wasl", S.YES, S.NO
)


def bridge(t, side: Listing) -> DataFrame:
    """Repayment, document and ``times``, how often the list names it."""
    listed = explode_ids(getattr(t, side.repayments), side.column, side.document)
    return (
        listed.filter(F.col(side.document).isNotNull())
        .groupBy(side.key, side.document)
        .agg(F.count(F.lit(1)).alias("times"))
    )


def merged(held: DataFrame, changes: DataFrame, side: Listing) -> DataFrame:
    """The bridge after a log of changes; a reference that comes to nothing is gone."""
    key = [side.key, side.document]
    removed = F.max(F.when(F.col("change") == REMOVE, F.col("seq")))
    rows = held.select(
        *key, F.lit(APPEND).alias("change"), F.lit(-(2**63)).cast("bigint").alias("seq"), "times"
    ).unionByName(
        changes.filter(F.col("change").isin(APPEND, REMOVE)).select(
            *key, "change", F.col("seq").cast("bigint").alias("seq"), F.lit(1).cast("bigint").alias("times")
        )
    )
    # Appends by their place in time, so that one pass can leave out those before the last removal.
    last = rows.groupBy(*key).agg(removed.alias("_removed"))
    alive = rows.join(last, key).filter(
        (F.col("change") == APPEND) & (F.col("_removed").isNull() | (F.col("seq") > F.col("_removed")))
    )
    return alive.groupBy(*key).agg(F.sum("times").alias("times"))


def references(held: DataFrame, side: Listing) -> DataFrame:
    """How many listings each document has."""
    return held.groupBy(side.document).agg(F.sum("times").alias("listings"))


def documents_after(t, side: Listing, before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents whose references began or ended, with their new status and listings.

    Others, and documents that are listed but not known, have no row.
    """
    old = references(before, side).withColumnRenamed("listings", "_before")
    new = references(after, side)
    changed = old.join(new, side.document, "full").select(
        side.document,
        F.coalesce("_before", F.lit(0)).alias("_before"),
        F.coalesce("listings", F.lit(0)).cast("bigint").alias("listings"),
    )
    crossed = changed.filter((F.col("_before") > 0) != (F.col("listings") > 0))
    return (
        getattr(t, side.documents)
        .select(side.document)
        .join(crossed, side.document)
        .select(
            side.document,
            F.when(F.col("listings") > 0, side.settled).otherwise(side.reopened).alias(side.status),
            "listings",
        )
    )


def with_status(t, side: Listing, before: DataFrame, after: DataFrame) -> DataFrame:
    """All documents, with the status of those whose references began or ended."""
    documents = getattr(t, side.documents)
    changed = documents_after(t, side, before, after).select(
        side.document, F.col(side.status).alias("_status")
    )
    return (
        documents.join(changed, side.document, "left")
        .withColumn(side.status, F.coalesce("_status", side.status))
        .select(*documents.columns)
    )


def as_lists(t, side: Listing, held: DataFrame) -> DataFrame:
    """Repayments with their comma list, in order of the documents' ids; NULL for an empty one."""
    ids = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct(side.document, "times"))),
            lambda r: F.array_repeat(r[side.document].cast("string"), r["times"].cast("int")),
        )
    )
    listed = held.groupBy(side.key).agg(id_list(ids).alias("_list"))
    rows = getattr(t, side.repayments)
    return (
        rows.join(listed, side.key, "left").withColumn(side.column, F.col("_list")).select(*rows.columns)
    )
