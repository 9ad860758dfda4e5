"""Quality classifier: a generalised additive model with pairs over the style of whole texts.

Labels are learned from documents that are not held out, ``rows_per_label`` of each label at most, chosen by a hash of
the id; that bound is a setting. Bin edges are percentiles of that sample. It is dealt over folds by another hash;
for every fold a model is boosted, in a task of its own, on all rows but those of the fold, and the classifier's
lookup tables are the mean of theirs. Scoring reads every document once: style numbers, bins, table additions.

Odd input. A NULL text is an empty one, and empty texts are scored like others. A document without id is not held
out and has no label. A document labelled both ways counts once for each; rows repeated in full
are scored each. Without labels, or with one label only, all scores are the share of label 1, drawn to a
half by one row of either. Further columns are ignored. An empty table gives no rows.
"""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.shared import stored
from tillbook.llm import additive, style
from tillbook.llm.text import only, whole

SCORED = "doc_id bigint, held_out boolean, score double, predicted int"
FEATURES = "doc_id bigint, quality int, features array<double>"


@dataclass(frozen=True)
class Settings:
    rows_per_label: int = 20_000
    folds: int = 8
    threshold: float = 0.7
    boosting: additive.Boosting = additive.Boosting()


@dataclass
class Classifier:
    edges: list[np.ndarray]
    model: additive.Model

    def scores(self, values: np.ndarray) -> np.ndarray:
        return self.model.scores(additive.binned(values, self.edges))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of the id as text, modulo 4, is 2."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(4)) == 2


def sample(labels: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id`` and ``quality`` of about ``rows_per_label`` documents of each label at most.

    All are taken while they are that few, beyond that a share by the hash of the id.
    """
    fit = (
        only(labels, "doc_id", "quality")
        .select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .distinct()
    )
    counts = fit.groupBy("quality").agg(F.count(F.lit(1)).alias("_n"))
    parts = 2**20
    share = F.pmod(F.xxhash64("doc_id"), F.lit(parts)) * F.col("_n")
    return (
        fit.join(F.broadcast(counts), "quality")
        .filter(share < F.lit(settings.rows_per_label * parts))
        .select("doc_id", "quality")
    )


def learned(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Classifier:
    """Fits the classifier; what reaches the driver are percentiles and lookup tables."""
    texts = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint"), whole().alias("text")
    )
    # The sample's ids are bounded by ``rows_per_label``.
    chosen = texts.join(F.broadcast(sample(labels, settings)), "doc_id").select(
        "doc_id", "quality", "text"
    )

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = style.features(batch.column(2).to_pylist())
            lists = pa.array(list(values), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists], ["doc_id", "quality", "features"]
            )

    rows = stored(chosen.mapInArrow(described, FEATURES))
    bins = settings.boosting.bins
    cuts = [n / bins for n in range(1, bins)]
    found = rows.agg(
        *[F.percentile_approx(F.col("features")[f], cuts, 10_000).alias(name) for f, name in enumerate(style.NAMES)]
    ).first()
    edges = [np.unique(found[name] or []) for name in style.NAMES]
    sizes = [len(e) + 1 for e in edges]
    boosting = settings.boosting

    def train(bag: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(bag["features"].to_numpy())
        # One order, whatever the tasks before, so that sums are the same in every run.
        order = np.lexsort((*values.T[::-1], bag["quality"], bag["doc_id"]))
        labels = bag["quality"].to_numpy(np.float64)[order]
        model = additive.fitted(additive.binned(values[order], edges), labels, sizes, boosting)
        return pd.DataFrame({"rows": [len(bag)], "model": [pickle.dumps(model)]})

    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(settings.folds))
    others = F.filter(F.sequence(F.lit(0), F.lit(settings.folds - 1)), lambda n: n != F.col("_fold"))
    bags = rows.withColumn("_fold", fold).withColumn("bag", F.explode(others)).drop("_fold")
    # As many rows as there are folds, each a few lookup tables.
    fitted = bags.groupBy("bag").applyInPandas(train, "rows bigint, model binary").collect()
    if not fitted:
        return Classifier(edges, additive.Model(0.0, np.zeros((len(sizes), 1))))
    fitted = sorted(((r["rows"], bytes(r["model"])) for r in fitted), key=lambda r: r[1])
    models = [pickle.loads(m) for _, m in fitted]
    return Classifier(edges, additive.mean_of(models, [n for n, _ in fitted], sizes))


def scored(docs: DataFrame, classifier: Classifier, threshold: float = Settings.threshold) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    given = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("bigint"), whole().alias("text")
    )
    rows = given.select("doc_id", held_out().alias("held_out"), "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = classifier.scores(style.features(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(judge, SCORED)


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All documents scored by a classifier learned from those of them that are not held out."""
    return scored(docs, learned(docs, labels, settings), settings.threshold)
