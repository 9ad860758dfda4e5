"""The quality classifier: style numbers against plain Python, tables, held-out accuracy, odd input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tillbook.llm import additive, classifier, registry, style

DOCS = "doc_id bigint, text string"
LABELS = "doc_id bigint, quality int, toxic int"


def plain(text):
    """Some of the style numbers, one text at a time."""
    blanks = " \t\n\x0b\x0c\r"
    words, word = [], ""
    for c in text + " ":
        if c in blanks:
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not text:
        return dict.fromkeys(style.NAMES, 0.0)
    letters = [c for c in text if c.isalpha()]
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x]
    n, w = len(text), max(len(words), 1)
    return {
        "characters": np.log1p(n),
        "words": np.log1p(len(words)),
        "word_length": sum(map(len, words)) / w,
        "symbols": sum(c in "#*$%&|<>" for c in text) / n,
        "exclamations": text.count("!") / n,
        "capitals": sum(c.isupper() for c in letters) / max(len(letters), 1),
        "digits": sum(c.isdigit() and not c.isalpha() for c in text) / n,
        "beyond_ascii": sum(ord(c) > 127 for c in text) / n,
        "sentence_ends": sum(c in ".!?" for c in text) / w,
        "line_ends": text.count("\n") / w,
        "different_words": len(set(words)) / w,
        "same_as_before": sum(a == b for a, b in zip(words, words[1:])) / w,
        "in_repeated_windows": len(inside) / w,
        "short_words": sum(len(x) <= 3 for x in words) / w,
        "commonest_word": max(Counter(words).values(), default=0) / w,
        "capitalised": sum(x[0].isalpha() and x[0].isupper() for x in words) / w,
        "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1) if lines else 1.0,
        "letters": len(letters) / n,
    }


def test_style_numbers_are_those_of_plain_python():
    draw = random.Random(5)
    alphabet = "abAB éÜ\n\n  \t.,!?|#*1٣　😀中"
    texts = ["", " ", "\n", "a", "a a a a", "x\ny\nx\ny"]
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randrange(300))) for _ in range(300)]
    found = style.features(texts)
    for text, row in zip(texts, found):
        for name, value in plain(text).items():
            if name == "repeated_lines" and not [x for x in text.split("\n") if x]:
                continue
            assert row[style.NAMES.index(name)] == pytest.approx(value), (name, text)
    assert np.isfinite(found).all()
    alone = np.concatenate([style.features([t]) for t in texts])
    assert np.array_equal(found, alone)


def test_tables_learn_single_and_joint_effects():
    draw = np.random.default_rng(1)
    bins = draw.integers(0, 8, size=(6000, 3))
    labels = ((bins[:, 0] > 3) ^ (bins[:, 1] > 3)).astype(float)
    model = additive.fitted(bins, labels, [8, 8, 8], additive.Boosting())
    assert model.pairs[0] == (0, 1)
    assert ((model.scores(bins) > 0.5) == (labels == 1)).mean() > 0.99
    total = np.full(len(bins), model.intercept)
    for row, b in enumerate(bins):
        total[row] += sum(model.single[f][b[f]] for f in range(3))
        total[row] += sum(t[b[i], b[j]] for (i, j), t in zip(model.pairs, model.double))
    assert np.allclose(1 / (1 + np.exp(-total)), model.scores(bins))


def test_a_step_of_boosting_is_that_of_a_plain_tree():
    bins = np.array([[0], [0], [1], [1], [2], [2], [3], [3]])
    labels = np.array([0.0, 0, 0, 0, 1, 1, 1, 1])
    once = additive.Boosting(rounds=1, pair_rounds=0, cuts=1, leaf_rows=1, rate=1.0, damping=0.0)
    model = additive.fitted(bins, labels, [4], once)
    # Half the rows are good: gradient -0.5 or 0.5, curvature 0.25 each, so leaves of -2 and 2.
    assert model.single[0].tolist() == [-2.0, -2.0, 2.0, 2.0]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.01"
    out = registry.queries()["op13_quality_classifier"](spark, folder)
    rows = {r["doc_id"]: r for r in out.collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(rows) == docs.count()
    assert out.dtypes == [
        ("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")
    ]
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 for i, r in rows.items())
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    tested = [(rows[r["doc_id"]], r["quality"]) for r in labels if held(r["doc_id"])]
    good = [r["score"] for r, q in tested if q == 1]
    bad = [r["score"] for r, q in tested if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r["predicted"] == q for r, q in tested]) > 0.93
    again = {r["doc_id"]: r["score"] for r in out.collect()}
    assert again == {i: r["score"] for i, r in rows.items()}


def frames(spark, texts, labels):
    return spark.createDataFrame(texts, DOCS), spark.createDataFrame(labels, LABELS)


def test_labels_of_held_out_documents_are_never_read(spark):
    texts = [(n, f"word {n} and more. " * (n % 5 + 1) + ("###" * (n % 2))) for n in range(200)]
    labels = [(n, (n + 1) % 2, 0) for n in range(200)]
    turned = [(n, 1 - q if held(n) else q, 0) for n, q, _ in labels]
    scores = [
        {r["doc_id"]: r["score"] for r in classifier.quality_scores(*frames(spark, texts, which)).collect()}
        for which in (labels, turned)
    ]
    assert scores[0] == scores[1]
    assert all((s > 0.5) == (n % 2 == 0) for n, s in scores[0].items())


def test_odd_input(spark):
    texts = [(None, "no id"), (1, None), (1, None), (2, ""), (3, "a " * 100_000), (4, "\x00퟿\U0001f600")]
    docs, none = frames(spark, texts, [])
    rows = classifier.quality_scores(docs, none).collect()
    assert len(rows) == 6 and {r["score"] for r in rows} == {0.5}
    labels = [(n, 1, 0) for n in range(1, 5)] + [(None, 0, 0), (3, None, 1), (4, 7, None), (1, 1, 0)]
    docs, one_sided = frames(spark, texts, labels)
    rows = classifier.quality_scores(docs, one_sided).collect()
    assert len(rows) == 6 and len({r["score"] for r in rows}) == 1 and rows[0]["score"] > 0.5
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    empty, labels = frames(spark, [], labels)
    assert classifier.quality_scores(empty, labels).collect() == []
    wide = spark.createDataFrame(
        [(n, f"text {n}", 1, 0.5, True) for n in range(20)],
        "doc_id bigint, text string, quality int, score double, held_out boolean",
    )
    both = spark.createDataFrame([(n, q, 0) for n in range(20) for q in (0, 1)], LABELS)
    assert len(classifier.quality_scores(wide, both).collect()) == 20


def test_the_sample_of_labels_is_bounded(spark):
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(20_000)], LABELS)
    few = classifier.sample(labels, classifier.Settings(rows_per_label=500))
    counts = {r["quality"]: r["count"] for r in few.groupBy("quality").count().collect()}
    assert all(400 < c < 600 for c in counts.values())
    assert classifier.sample(labels, classifier.Settings()).count() == sum(not held(n) for n in range(20_000))
