"""Language identification by sparse multinomial logistic regression.

Features are hashed runs of one to three characters within lower-cased words, weighted by
their share of the text and their inverse document frequency. Weights are learned
with the follow-the-regularised-leader rule, whose L1 penalty leaves rare features at zero and
whose L2 penalty damps the others, and a temperature fitted on documents kept aside makes
the scores probabilities.

Document frequencies cover all training documents. The weights are learned on a bounded sample
of them: up to ``per_language`` documents of each language, chosen by a hash of the id, dealt over
``shards`` tasks that learn on their own; the model is the mean of theirs.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.shared import stored
from tillbook.llm.text import only

FEATURES = 1 << 14
ORDERS = (1, 2, 3)
# Texts are worked on in lots of about so many characters.
LOT = 1 << 18


@dataclass(frozen=True)
class Settings:
    per_language: int = 2_000
    shards: int = 8
    passes: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    calibration_percent: int = 20


def lots(texts: list[str]) -> Iterator[list[str]]:
    lot, size = [], 0
    for text in texts:
        if lot and size + len(text) > LOT:
            yield lot
            lot, size = [], 0
        lot.append(text)
        size += len(text)
    if lot:
        yield lot


def features(lot: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all runs of characters of the texts, and the text each is from.

    A run does not cross a blank; the blank before a word counts as its first character.
    """
    joined = " " + " ".join(t.lower() for t in lot) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    points = np.where(points <= 32, np.uint32(32), points)
    # A text owns the blank before it, so that its runs are the same in any lot.
    lengths = np.array([len(t.lower()) + 1 for t in lot])
    owner = np.repeat(np.arange(len(lot)), lengths)
    owner = np.pad(owner, (0, len(points) - len(owner)), mode="edge")
    blank = points == 32
    numbers, texts = [], []
    for order in ORDERS:
        stop = len(points) - order + 1
        if stop <= 0:
            continue
        hashed = np.full(stop, order, dtype=np.uint32)
        good = ~blank[:stop] if order == 1 else np.ones(stop, dtype=bool)
        for k in range(order):
            hashed = (hashed ^ points[k : k + stop]) * np.uint32(0x01000193)
            hashed ^= hashed >> np.uint32(15)
            if k:
                good &= ~blank[k : k + stop]
        hashed = (hashed * np.uint32(0x9E3779B1)) >> np.uint32(18)
        numbers.append(hashed[good].astype(np.int64))
        texts.append(owner[:stop][good])
    return np.concatenate(numbers), np.concatenate(texts)


def shares(lot: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and its share of the text's runs, for each feature a text has."""
    numbers, texts = features(lot)
    keys, counts = np.unique(texts * FEATURES + numbers, return_counts=True)
    text, number = keys // FEATURES, keys % FEATURES
    total = np.bincount(texts, minlength=len(lot))
    return text, number, counts / total[text]


def document_counts(texts: DataFrame) -> np.ndarray:
    """How many documents have each feature; as many numbers as there are features."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(FEATURES, dtype=np.int64)
        for batch in batches:
            for lot in lots(batch.column("text").to_pylist()):
                numbers, owners = features(lot)
                seen = np.unique(owners * FEATURES + numbers) % FEATURES
                counts += np.bincount(seen, minlength=FEATURES)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["feature", "n"])

    summed = texts.select("text").mapInArrow(work, "feature long, n long")
    out = np.zeros(FEATURES)
    for row in summed.groupBy("feature").agg(F.sum("n").alias("n")).collect():  # FEATURES at most
        out[row.feature] = row.n
    return out


def probabilities(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_leader(
    examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, s: Settings
) -> np.ndarray:
    """Weights by feature and class, after the given passes over (features, values, class)."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        rate = (s.beta + np.sqrt(n[at])) / s.alpha + s.l2
        return np.where(np.abs(z[at]) <= s.l1, 0.0, -(z[at] - np.sign(z[at]) * s.l1) / rate)

    order = np.random.default_rng(1)
    for _ in range(s.passes):
        for i in order.permutation(len(examples)):
            at, value, label = examples[i]
            w = weights(at)
            error = probabilities(value @ w)
            error[label] -= 1.0
            g = value[:, None] * error[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(FEATURES))


@dataclass(frozen=True)
class Model:
    """``languages`` in order, weights with the document frequencies worked in, temperature."""

    languages: list[str]
    weights: np.ndarray
    temperature: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of the languages for each text, before the temperature."""
        out = [np.zeros((0, len(self.languages)))]
        for lot in lots(texts):
            numbers, owners = features(lot)
            total = np.maximum(np.bincount(owners, minlength=len(lot)), 1)
            sums = [
                np.bincount(owners, weights=column[numbers], minlength=len(lot))
                for column in self.weights.T
            ]
            out.append(np.stack(sums, axis=1) / total[:, None])
        return np.concatenate(out)


# A text's share of any one feature is small; so scaled, values are of the order of 1.
SCALE = 30.0


def train(labelled: DataFrame, s: Settings = Settings()) -> Model | None:
    """A model from the columns ``doc_id``, ``text`` and ``lang``; None without labelled text.

    Texts without a letter and NULL languages teach nothing.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    per_language = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.lang: r.n for r in per_language.collect()}  # one row per language
    if not counts:
        return None
    languages = sorted(counts)
    idf = np.log((1 + sum(counts.values())) / (1 + document_counts(usable))) + 1
    value = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    chance = F.element_at(
        F.create_map(
            *[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, s.per_language / v))]
        ),
        F.col("lang"),
    )
    sample = stored(
        usable.filter(value < chance).select(
            "text",
            F.array_position(F.array(*[F.lit(k) for k in languages]), F.col("lang")).alias("label") - 1,
            F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(s.shards)).alias("shard"),
            (F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(100)) < s.calibration_percent).alias("aside"),
        ).toDF("text", "label", "shard", "aside")
    )

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # One order, whatever the tasks before: what is learned depends on it.
        rows = rows.sort_values(["text", "label"])
        examples, done = [], 0
        labels = rows["label"].tolist()
        for lot in lots(rows["text"].tolist()):
            text, number, share = shares(lot)
            bounds = np.searchsorted(text, np.arange(len(lot) + 1))
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                at = number[a:b]
                examples.append((at, SCALE * share[a:b] * idf[at], labels[done + i]))
            done += len(lot)
        w = follow_leader(examples, len(languages), s)
        at = np.flatnonzero(np.abs(w).sum(axis=1))
        return pd.DataFrame(
            {"feature": at, "shard": int(key[0]), "weights": pd.Series(w[at].tolist(), dtype=object)}
        )

    learned = (
        sample.filter(~F.col("aside"))
        .groupBy("shard")
        .applyInPandas(learn, "feature long, shard long, weights array<double>")
    )
    # Added up in the order of the shards, so that reruns give the same sums.
    parts = F.sort_array(F.collect_list(F.struct("shard", "weights"))).alias("parts")
    matrix = np.zeros((FEATURES, len(languages)))
    for row in learned.groupBy("feature").agg(parts).collect():  # FEATURES rows at most
        for part in row.parts:
            matrix[row.feature] += part.weights
    matrix *= SCALE * idf[:, None] / s.shards
    model = Model(languages, matrix, 1.0)
    return Model(languages, matrix, temperature(model, sample.filter("aside")))


def temperature(model: Model, aside: DataFrame) -> float:
    """The temperature under which the documents kept aside are likeliest; 1 if there are none.

    Losses for a fixed row of temperatures are summed over all of them.
    """
    grid = np.exp(np.linspace(np.log(0.02), np.log(20.0), 80))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(int)
            raw = model.scores(batch.column("text").to_pylist())
            scaled = raw[None, :, :] / grid[:, None, None]
            right = probabilities(scaled)[:, np.arange(len(labels)), labels]
            loss = -np.log(np.maximum(right, 1e-12)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid))), pa.array(loss)], ["at", "loss"])

    losses = aside.select("text", "label").mapInArrow(work, "at long, loss double")
    best = losses.groupBy("at").agg(F.sum("loss").alias("loss")).orderBy("loss", "at").first()
    return float(grid[best["at"]]) if best else 1.0


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` for each row of ``docs``.

    ``und`` with score 0 for a NULL text, one without a letter, and without a model.
    """
    rows = only(docs, "doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = rows.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages numbers
    kind = rows.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            some = np.array([t is not None for t in texts], dtype=bool)
            names = np.full(len(texts), "und", dtype=object)
            score = np.zeros(len(texts))
            if some.any():
                p = probabilities(model.scores([t for t in texts if t is not None]) / model.temperature)
                names[some] = np.array(model.languages, dtype=object)[p.argmax(axis=1)]
                score[some] = p.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(score)],
                ["doc_id", "lang_pred", "score"],
            )

    letters = F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text")
    return rows.select("doc_id", letters).mapInArrow(
        work, f"doc_id {kind.simpleString()}, lang_pred string, score double"
    )


def language_report(docs: DataFrame) -> DataFrame:
    """Predictions for all documents from a model of those whose checksum of the id is not 2 mod 4."""
    docs = only(docs, "doc_id", "text", "lang")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    out = predict(docs, train(docs.filter(~fold)))
    return out.select("doc_id", fold.alias("held_out"), "lang_pred", "score")
