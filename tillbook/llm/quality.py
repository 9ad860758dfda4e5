"""Quality rules: counts of plain defects, then a likelihood ratio against trusted text.

Every word and every pair of neighbouring words is hashed into one of 65,536 buckets. Two
multinomials over the buckets are counted, one of trusted documents and one of the whole
corpus. A document scores the mean, over its n-grams, of the logarithm of their ratio,
and is kept when that mean reaches a fixed threshold. How much trusted text there is must not
decide that: see ``QualityRules.prior``.

Weights are whole thousandths of a nat, so a document's sum is exact and does not
depend on the order in which tasks finish.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.shared import stored
from tillbook.llm.text import BLANK_CLASS, BLANKS, only, whole, without, words

SYMBOLS = "#*$%&|<>"
BUCKETS = 2**16
# N-grams of a bucket by which its trusted share is drawn to its share of the corpus.
PRIOR = 8.0


@dataclass(frozen=True)
class QualityRules:
    """``threshold`` is in thousandths of a nat per n-gram.

    ``smoothing`` is added to every bucket of both multinomials, which needs trusted text many
    times the buckets: with less, whatever is common loses. With ``prior`` it is not used: a
    bucket's trusted count is compared with the one expected from its share of the corpus, and
    ``prior`` is added to both, so a bucket without evidence weighs 0 whatever the table's size.
    ``target_rows`` bounds the labelled documents that the trusted counts are taken from.
    """

    least_words: int = 50
    most_repeated_percent: int = 50
    threshold: int = -150
    smoothing: float = 1.0
    target_rows: int = 20_000
    prior: float | None = None


# What the registered query and the pipeline judge by.
ANY_SIZE = QualityRules(prior=PRIOR)


def hashes(text: Column) -> Column:
    """One hash for each word."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def windows(size: int) -> Column:
    """One hash for each window of so many words, from the column ``_words`` of word hashes."""
    rest = ", ".join(f"_words[i + {k}]" for k in range(1, size))
    starts = f"slice(_words, 1, greatest(size(_words) - {size - 1}, 0))"
    return F.expr(f"transform({starts}, (w, i) -> xxhash64(w, {rest}))")


def bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(BUCKETS - 1).cast("int")


def trusted_ids(labels: DataFrame, rules: QualityRules) -> DataFrame:
    """Ids of documents labelled good and not toxic, about ``target_rows`` of them at most.

    All are taken while they are that few. Beyond that a share is taken by the hash
    of the id, which needs no order and is the same in every run.
    """
    good = (
        only(labels, "doc_id", "quality", "toxic")
        .filter(F.col("quality") == 1)
        .filter(F.coalesce(F.col("toxic"), F.lit(0)) == 0)
        .filter(F.col("doc_id").isNotNull())
        .select("doc_id")
        .distinct()
    )
    parts = 2**20
    total = good.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    return good.filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < F.lit(rules.target_rows * parts) / total
    )


def bucket_weights(docs: DataFrame, labels: DataFrame, rules: QualityRules) -> DataFrame:
    """``bucket`` and ``weight`` for every bucket in use; no rows without trusted text.

    One pass over the corpus counts both multinomials. What is broadcast is the bounded
    list of trusted ids; what is shuffled is one row per bucket and task. The counts are
    written once, as all that follows reads them.
    """
    trusted = trusted_ids(labels, rules).withColumn("_trusted", F.lit(1))
    counts = stored(
        only(docs, "doc_id", "text")
        .join(F.broadcast(trusted), "doc_id", "left")
        .select(hashes(whole()).alias("_words"), "_trusted")
        .select(F.explode(F.concat("_words", windows(2))).alias("_gram"), "_trusted")
        .select(bucket(F.col("_gram")).alias("bucket"), "_trusted")
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("_trusted").alias("target"))
    )

    raws, targets = counts.agg(F.sum("raw"), F.sum("target")).first()

    def share(name: str, total: int | None) -> Column:
        return (F.col(name) + rules.smoothing) / F.lit((total or 0) + rules.smoothing * BUCKETS)

    if rules.prior is None:
        nats = F.ln(share("target", targets)) - F.ln(share("raw", raws))
    else:
        expected = F.col("raw") * F.lit((targets or 0) / (raws or 1))
        nats = F.ln(F.col("target") + rules.prior) - F.ln(expected + rules.prior)
    return counts.filter(F.lit(bool(targets))).select(
        "bucket", F.round(nats * 1000).cast("long").alias("weight")
    )


def weight_array(weights: DataFrame) -> Column:
    """All weights as one array by bucket, of a fixed length; 0 for buckets not in use.

    Two bytes each: a weight is the logarithm of a ratio of counts, at most some ten nats. The
    array is stored, so that however often a plan mentions it, it is only read.
    """
    spark = weights.sparkSession
    pairs = F.collect_list(F.struct("bucket", F.coalesce("weight", F.lit(0)).cast("short").alias("w")))
    ordered = F.transform(F.sort_array(pairs), lambda x: x.w)
    buckets = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    return stored(buckets.join(weights, "bucket", "left").agg(ordered.alias("weights"))).scalar()


def repeated_words() -> Column:
    """Words inside three-word windows that the text has twice or more.

    Windows are compared by their 64-bit hash, and only within one text. Texts without
    a repeated window are told by the number of distinct hashes; only the others are sorted.
    """
    return F.expr(
        """
        if(size(array_distinct(_windows)) = size(_windows), 0L,
          aggregate(
            array_sort(flatten(transform(
              array(array_sort(transform(_windows, (h, i) -> struct(h as h, i as i)))),
              s -> filter(
                transform(s, (x, j) -> if(x.h <=> get(s, j - 1).h or x.h <=> get(s, j + 1).h, x.i, -1)),
                p -> p >= 0)))),
            struct(0L as n, 0 as upto),
            (a, p) -> struct(a.n + p + 3 - greatest(p, a.upto) as n, p + 3 as upto),
            a -> a.n))
        """
    )


def quality_counts(docs: DataFrame, weights: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, all counts and the score of each row, without any shuffle."""
    text = whole()
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANK_CLASS}]"))
    counted = (
        docs.select(*keep, text.alias("_text"), hashes(text).alias("_words"), lines.alias("_lines"))
        .withColumn("_windows", windows(3))
        .withColumn("_pairs", windows(2))
        .withColumn("_weights", weight_array(weights))
    )
    n_grams = F.size("_words") + F.size("_pairs")

    def summed(column: str) -> Column:
        return F.aggregate(
            F.col(column), F.lit(0).cast("long"), lambda s, x: s + F.col("_weights")[bucket(x)]
        )

    counts = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(without(F.col("_text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS)))
        .cast("long")
        .alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words().alias("n_repeat_words"),
        n_grams.cast("long").alias("n_grams"),
        (summed("_words") + summed("_pairs")).alias("score_sum"),
    )
    # One row for one: a filter on the counts then has to come after them, and is not computed
    # anew, with all that they are made of, below.
    return counted.select(*keep, F.explode_outer(F.array(counts)).alias("_q")).select(*keep, "_q.*")


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    rules: QualityRules = QualityRules(),
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, its counts and the verdict.

    A NULL text counts as empty, and an empty text fails. Repeated rows are judged one by
    one and alike. A NULL id is never trusted. Without trusted text, as with no labels or an
    empty corpus, all weights are 0 and only the plain rules decide.
    """
    docs = only(docs, *dict.fromkeys([*keep, "doc_id", "text"]))
    weights = bucket_weights(docs, labels, rules)
    failed = (F.col("n_words") < rules.least_words) | (
        100 * F.col("n_repeat_words") > rules.most_repeated_percent * F.col("n_words")
    )
    good = F.col("score_sum") >= rules.threshold * F.col("n_grams")
    return (
        quality_counts(docs, weights, list(keep))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & good)
    )
