"""Hard negatives: rows of another label whose inner product with an anchor lies in a window.

The window of an anchor goes by the score of one of its positives, the best rows of its own label.
Both are searched in a cover tree over candidates brought to one norm (see ``covertree``). Its uppermost
level is a short list of centres, spread out over a bounded sample of rows; every row is indexed under
the nearest of them, and the rows of a centre are dealt over blocks that are trees of their own. An anchor
is sent to the blocks of those centres whose bounds meet one of its windows, raised by the best scores that
the sample already offers, and searched there best first. Scores are exact whole numbers, and no
row is left out by anything but its bounds.

Anchors and blocks meet by a join: each block is given ``queries_per_block`` anchors at a time, so the memory
of a task is bounded by the settings, whatever a centre or a label holds.

Odd input. Rows without label or vector, or with a component that is NULL or not finite, take no part.
Vectors that are shorter than the longest go on with zeros; components count up to ``LARGEST`` either way. Rows
alike in id, label and vector are one row; rows that share an id only are rows of their own, ordered by a
hash of what they hold. A row without id is no anchor and comes last among ties. Further columns are
ignored. Without rows or anchors the result is empty.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions.shared import stored
from tillbook.llm import covertree
from tillbook.llm.text import only

SCALE = 256
LARGEST = 1 << 24
NO_ID = 2**63 - 1


@dataclass(frozen=True)
class Mining:
    """``sample_rows`` and ``most_centres`` bound what is held of the index in one place."""

    positives: int = 5
    negatives: int = 10
    least_percent: int = 30
    most_percent: int = 90
    sample_rows: int = 4_096
    most_centres: int = 1_024
    rows_per_block: int = 4_096
    queries_per_block: int = 8_192


ROW = "vec_id bigint, label bigint, vector binary, norm2 double, row bigint"
RESULT = (
    "anchor_id bigint, positive_id bigint, rank int, negative_id bigint,"
    " positive_score bigint, negative_score bigint"
)


def vector_rows(embeddings: DataFrame, label: Column | None = None) -> DataFrame:
    """Rows that take part, as whole numbers: floor(256 * x) of each component.

    ``label`` may give another label than the column of that name.
    """
    given = only(embeddings, "vec_id", "embedding", "label").select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("bigint").alias("label"),
    )
    if label is not None:
        given = given.withColumn("label", label)
    infinite = F.lit(float("inf"))
    fine = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite)
    )
    fit = given.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    width = fit.agg(F.max(F.size("embedding"))).first()[0]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, labels = batch.columns
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            whole = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
            rows = np.zeros((len(lists), longest))
            place = np.arange(len(whole)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            rows[np.repeat(np.arange(len(lists)), lengths), place] = np.clip(whole, -LARGEST, LARGEST)
            norm2 = np.einsum("ij,ij->i", rows, rows)
            vectors = pa.array([r.tobytes() for r in rows.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [ids, labels, vectors, pa.array(norm2)], ["vec_id", "label", "vector", "norm2"]
            )

    if width is None:
        return embeddings.sparkSession.createDataFrame([], ROW)
    longest = max(width, 1)
    rows = fit.mapInArrow(packed, "vec_id bigint, label bigint, vector binary, norm2 double")
    return rows.dropDuplicates(["vec_id", "label", "vector"]).withColumn(
        "row", F.xxhash64("vec_id", "label", "vector")
    )


def unpacked(vectors) -> np.ndarray:
    """Vectors of a column of bytes, as rows of a matrix."""
    if isinstance(vectors, (pa.Array, pa.ChunkedArray)):
        vectors = vectors.to_pylist()
    if not len(vectors):
        return np.zeros((0, 1))
    return np.frombuffer(b"".join(vectors), dtype="<i4").reshape(len(vectors), -1).astype(np.float64)


def numbers(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


class Index:
    """Every row under the nearest of some centres, and what is known of each centre's rows."""

    def __init__(self, rows: DataFrame, settings: Mining):
        self.settings, self.spark = settings, rows.sparkSession
        rows = stored(rows)
        total, most = rows.agg(F.count(F.lit(1)), F.max("norm2")).first()
        self.norm2 = float(most or 0)
        # A bounded sample, chosen by a hash, so that reruns agree.
        sample = rows.orderBy("row", "vec_id").limit(settings.sample_rows).collect()
        self.sample = unpacked([bytes(r["vector"]) for r in sample])
        self.sample_labels = np.array([r["label"] for r in sample], dtype=np.int64)
        self.sample_rows = np.array([r["row"] for r in sample], dtype=np.int64)
        wanted = min(max(1, -(-total // settings.rows_per_block)), settings.most_centres)
        further = covertree.extra(self.sample, self.norm2)
        chosen = covertree.spread_out(self.sample, further, self.norm2, wanted) if total else []
        self.centres, self.further = self.sample[chosen], further[chosen] if total else further
        self.rows = stored(self._assigned(rows)) if total else None
        self.radius = np.zeros(len(self.centres))
        if total:
            known = self.rows.groupBy("centre").agg(
                F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")
            )
            # One row a centre, of which there are ``most_centres`` at most.
            known = known.collect()
            for r in known:
                self.radius[r["centre"]] = r["radius"]
            parts = [(r["centre"], -(-r["n"] // settings.rows_per_block)) for r in known]
            self.parts = self.spark.createDataFrame(parts, "centre int, parts int")

    def _assigned(self, rows: DataFrame) -> DataFrame:
        centres, further, norm2 = self.centres, self.further, self.norm2

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = unpacked(batch.column("vector"))
                if not len(vectors):
                    continue
                angle = covertree.angles(
                    vectors, covertree.extra(vectors, norm2), centres, further, norm2
                )
                nearest = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.array(nearest.astype(np.int32)),
                        pa.array(angle[np.arange(len(angle)), nearest]),
                    ],
                    [*batch.schema.names, "centre", "angle"],
                )

        return rows.mapInArrow(assign, ROW + ", centre int, angle double")

    def blocks(self, copies: int) -> DataFrame:
        """Rows by block, once for each lot of queries."""
        part = F.pmod(F.xxhash64(F.lit("block"), "row", "vec_id"), F.col("parts")).cast("int")
        return (
            self.rows.join(F.broadcast(self.parts), "centre")
            .withColumn("part", part)
            .withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
            .select("centre", "part", "lot", "vec_id", "label", "vector", "row")
        )

    def search(self, queries: DataFrame, size: int, same_label: bool) -> DataFrame:
        """The ``size`` best rows of each query within its window.

        ``queries`` have ``key``, ``label``, ``vector``, ``row`` and the window from ``low`` to ``high``.
        Gives ``key``, ``rank``, ``vec_id``, ``row`` and ``score``.
        """
        copies = max(1, -(-queries.count() // self.settings.queries_per_block))
        lot = F.pmod(F.xxhash64(F.lit("lot"), "key"), F.lit(copies)).cast("int")
        routed = (
            self._routed(queries, size, same_label)
            .join(F.broadcast(self.parts), "centre")
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("lot", lot)
            .drop("parts")
        )
        norm2 = self.norm2

        def answer(rows: pa.Table, asked: pa.Table) -> pa.Table:
            if not rows.num_rows or not asked.num_rows:
                return ANSWER.empty_table()
            mine, theirs = numbers(asked["label"]), numbers(rows["label"])
            own, names = numbers(asked["row"]), numbers(rows["row"])
            own_ids, ids = numbers(asked["vec_id"]), numbers(rows["vec_id"])

            def allowed(q: np.ndarray, r: np.ndarray) -> np.ndarray:
                alike = mine[q][:, None] == theirs[r][None, :]
                itself = (own[q][:, None] == names[r][None, :]) & (own_ids[q][:, None] == ids[r][None, :])
                return (alike if same_label else ~alike) & ~itself

            tree = covertree.CoverTree(unpacked(rows["vector"]), norm2)
            query, row, score = tree.best(
                unpacked(asked["vector"]), numbers(asked["low"]), numbers(asked["high"]), allowed, size
            )
            order = np.lexsort((names[row], ids[row], -score, query))
            query, row, score = query[order], row[order], score[order]
            first = np.searchsorted(query, query)
            few = np.arange(len(query)) - first < size
            query, row, score = query[few], row[few], score[few]
            return pa.table(
                [
                    asked["key"].take(pa.array(query)), rows["vec_id"].take(pa.array(row)),
                    pa.array(names[row]), pa.array(score),
                ],
                schema=ANSWER,
            )

        at = ["centre", "part", "lot"]
        answers = (
            self.blocks(copies)
            .groupBy(*at)
            .cogroup(routed.groupBy(*at))
            .applyInArrow(answer, "key string, vec_id bigint, row bigint, score bigint")
        )
        best = Window.partitionBy("key").orderBy(
            F.desc("score"), F.asc_nulls_last("vec_id"), "row"
        )
        return answers.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size)

    def _routed(self, queries: DataFrame, size: int, same_label: bool) -> DataFrame:
        """A query once for each centre whose rows may answer it, its window raised by the sample's best."""
        centres, radius, norm2 = self.centres, self.radius, self.norm2
        sample, labels, rows = self.sample, self.sample_labels, self.sample_rows

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, covertree.QUERIES):
                    batch = whole.slice(start, covertree.QUERIES)
                    asked = unpacked(batch.column("vector"))
                    low = numbers(batch.column("low")).astype(np.float64)
                    high = numbers(batch.column("high")).astype(np.float64)
                    scores = covertree.products(asked, sample).astype(np.float64)
                    alike = numbers(batch.column("label"))[:, None] == labels[None, :]
                    itself = numbers(batch.column("row"))[:, None] == rows[None, :]
                    fits = (alike if same_label else ~alike) & ~itself
                    fits &= (scores >= low[:, None]) & (scores <= high[:, None])
                    scores = np.where(fits, scores, -np.inf)
                    if scores.shape[1] >= size:
                        worst = np.partition(scores, scores.shape[1] - size, axis=1)[:, -size]
                        low = np.maximum(low, worst)
                    norms = np.sqrt(np.einsum("ij,ij->i", asked, asked))
                    least, most = covertree.bounds(
                        covertree.products(asked, centres), norms, radius, norm2
                    )
                    query, centre = np.nonzero((most >= low[:, None]) & (least <= high[:, None]))
                    sent = batch.take(pa.array(query))
                    sent = sent.set_column(
                        sent.schema.get_field_index("low"), "low", pa.array(low[query].astype(np.int64))
                    )
                    yield sent.append_column("centre", pa.array(centre.astype(np.int32)))

        columns = "key string, vec_id bigint, label bigint, vector binary, row bigint, low bigint, high bigint"
        return queries.select(*[c.split()[0] for c in columns.split(", ")]).mapInArrow(
            route, columns + ", centre int"
        )


ANSWER = pa.schema(
    [("key", pa.string()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())]
)


def hard_negatives(rows: DataFrame, anchors: Column, settings: Mining = Mining()) -> DataFrame:
    """Negatives of every anchor and positive, ranked from 1 by score.

    ``rows`` come from ``vector_rows``; ``anchors`` is the condition that makes a row an anchor.
    """
    spark = rows.sparkSession
    index = Index(rows, settings)
    if index.rows is None:
        return spark.createDataFrame([], RESULT)
    asked = index.rows.filter(anchors & F.col("vec_id").isNotNull())
    far = F.lit(2**62)
    asked = stored(
        asked.select(
            F.concat_ws(":", "vec_id", "row").alias("key"), "vec_id", "label", "vector", "row",
            (-far).alias("low"), far.alias("high"),
        )
    )
    positives = index.search(asked, settings.positives, True).select(
        "key",
        F.col("vec_id").alias("positive_id"),
        F.col("row").alias("positive_row"),
        F.col("score").alias("positive_score"),
    )
    score = F.col("positive_score")
    # Whole numbers n with least * p <= 100 * n <= most * p, for p >= 0; below that there are none.
    pairs = stored(
        positives.filter(score >= 0)
        .join(asked.drop("low", "high"), "key")
        .withColumn("low", F.expr(f"({settings.least_percent} * positive_score + 99) div 100"))
        .withColumn("high", F.expr(f"({settings.most_percent} * positive_score) div 100"))
        .withColumnRenamed("key", "anchor")
        .withColumn("key", F.concat_ws(":", "anchor", "positive_id", "positive_row"))
    )
    found = index.search(pairs, settings.negatives, False)
    named = pairs.select("key", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score")
    return found.join(named, "key").select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def mining_report(embeddings: DataFrame, settings: Mining = Mining()) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100.

    Where the id is divisible by 7 the label is first moved on by one, modulo 10.
    """
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vector_rows(embeddings, moved), F.col("vec_id") % 100 == 0, settings)
