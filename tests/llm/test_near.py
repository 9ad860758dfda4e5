"""Near duplicates against all pairs: shared ids, repeated rows, borderline groups, blocks of late leaves."""

import random

import numpy as np
import pytest

from tillbook.llm import near
from test_text_operators import components, shingle_set

SCHEMA = "doc_id bigint, text string, source string"


def classes(rows):
    """Component of each id: classes over texts, joined where an id has several."""
    named = list(enumerate(rows))
    sets = {n: shingle_set(t) for n, (i, t) in named if i is not None}
    of = components(sets)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n, (i, _) in named:
        if i is not None:
            parent[root(("id", i))] = root(("set", of[n]))
    least = {}
    for i in {i for i, _ in rows if i is not None}:
        r = root(("id", i))
        least[r] = min(least.get(r, i), i)
    return {i: least[root(("id", i))] for i, _ in rows if i is not None}


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA)
    out = near.near_duplicates(df).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert got.setdefault(r["doc_id"], r["component_id"]) == r["component_id"]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    return got


def test_an_id_with_several_texts_is_linked_by_each_of_them(spark):
    first, second = "a b c d e f g h", "q r s t u v w x"
    rows = [(1, first), (1, second), (2, first), (3, second + " y")]
    assert found(spark, rows) == classes(rows) == {1: 1, 2: 1, 3: 1}
    rows += [(9, first + " i"), (9, "k l m"), (12, "k l m"), (0, "k l m"), (5, ""), (5, second), (4, None)]
    rows += [(None, first), (None, None), (7, "  "), (7, "lone pair"), (6, "lone pair")]
    assert found(spark, rows) == classes(rows)


def spoiled(draw, base, share, vocabulary):
    return " ".join(w if draw.random() > share else draw.choice(vocabulary) for w in base)


@pytest.mark.parametrize(("count", "share"), [(500, 0.053), (400, 0.075)])
def test_borderline_groups_keep_their_classes(spark, count, share):
    draw = random.Random(count)
    vocabulary = [f"w{n}" for n in range(3000)]
    base = draw.choices(vocabulary, k=110)
    rows = [(n, spoiled(draw, base, share, vocabulary)) for n in range(count)]
    want = classes(rows)
    assert 1 < len(set(want.values()))
    assert found(spark, rows) == want


def test_blocks_of_a_late_leaf_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_DOCS", 40)
    draw = random.Random(3)
    vocabulary = [f"w{n}" for n in range(3000)]
    base = draw.choices(vocabulary, k=90)
    rows = [(n, spoiled(draw, base, 0.06, vocabulary)) for n in range(260)]
    assert found(spark, rows) == classes(rows)


def test_common_counts_and_joining_links():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 9000, draw.integers(0, 400))).astype(np.uint64) for _ in range(60)]
    common = near.common_counts(sets)
    for i in range(60):
        for j in range(60):
            # Members of one set only are left out, which matters for a set and itself alone.
            assert i == j or common[i, j] == len(np.intersect1d(sets[i], sets[j]))
    linked = np.zeros((6, 6), dtype=bool)
    for i, j in ((0, 1), (1, 2), (0, 2), (4, 5)):
        linked[i, j] = linked[j, i] = True
    assert len(near.joining(linked, np.arange(6))) == 3
    assert len(near.joining(linked, np.array([0, 0, 2, 3, 4, 4]))) == 1
    assert near.common_counts([]).shape == (0, 0)


def test_first_copies_keep_rows_once_and_all_their_columns(spark):
    text = "a b c d e f g h i j"
    rows = [
        (9, text, "s", 1), (9, text, "s", 1), (9, text, "s", 2), (11, text, "s", 1), (3, "x y z", "t", 1),
        (None, "x y z", "t", 5), (None, "x y z", "t", 5), (4, None, "t", 1), (4, "", "t", 1),
    ]
    for extra in ("_mark", "D", "KEPT", "m", "rep", "_hash"):
        docs = spark.createDataFrame(rows, f"doc_id bigint, text string, source string, `{extra}` int")
        kept = near.first_copies(docs)
        assert kept.columns == docs.columns
        want = [r for r in {r for r in rows if r[0] is not None} if r[0] != 11]
        want += [r for r in rows if r[0] is None]
        assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))


def test_no_documents(spark):
    assert found(spark, []) == {}
    assert near.first_copies(spark.createDataFrame([], SCHEMA)).collect() == []
