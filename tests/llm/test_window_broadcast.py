"""What is broadcast is bounded by windows and their items, not by the shingles they are made of."""

import random

import pytest
from pyspark.sql import functions as F

from tillbook.llm import contamination


def run(spark, monkeypatch, items, most):
    """Items found per document, and how many times something was broadcast on purpose."""
    calls, broadcast = [], F.broadcast
    monkeypatch.setattr(contamination, "MOST_BROADCAST", most)
    monkeypatch.setattr(F, "broadcast", lambda df: calls.append(1) or broadcast(df))
    docs = spark.createDataFrame([(1, items[0]), (2, items[-1]), (3, "c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = contamination.overlaps(docs, bench).collect()
    monkeypatch.undo()
    return {r.doc_id: (r.n_hit, tuple(r["items"])) for r in rows}, len(calls)


@pytest.mark.parametrize("kind", ["many windows of few shingles", "one window of many items", "long words"])
def test_large_window_lists_are_not_broadcast(spark, monkeypatch, kind):
    random.seed(3)
    items = {
        "many windows of few shingles": [" ".join(random.choices("ab", k=300))],
        "one window of many items": ["one two three four five six seven eight nine ten"] * 150,
        "long words": [" ".join(c * 5000 for c in "abcdefghij")],
    }[kind]
    shuffled, n = run(spark, monkeypatch, items, 100)
    assert n == 0
    broadcast, n = run(spark, monkeypatch, items, 50_000)
    assert n == 1 and broadcast == shuffled and shuffled[1][0] > 0 and shuffled[3][0] == 0
