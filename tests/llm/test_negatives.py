"""Hard-negative mining against all pairs."""

import math
import random

import numpy as np
import pytest

from tillbook.llm import covertree
from tillbook.llm.negatives import Mining, mining_report

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows):
    """All pairs, in plain Python. Ids are unique here."""
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = set()
    for vec_id, vector, label in kept:
        if vec_id is None or vec_id % 100:
            continue
        scored = [(i, sum(a * b for a, b in zip(vector, v)), k) for i, v, k in kept if i != vec_id]
        for p, ps, _ in sorted([r for r in scored if r[2] == label], key=order)[:5]:
            fit = [r for r in scored if r[2] != label and 30 * ps <= 100 * r[1] <= 90 * ps]
            for rank, (n, ns, _) in enumerate(sorted(fit, key=order)[:10], 1):
                out.add((vec_id, p, rank, n, ps, ns))
    return out


def found(spark, rows, settings=Mining(), schema=SCHEMA):
    out = [tuple(r) for r in mining_report(spark.createDataFrame(rows, schema), settings).collect()]
    assert len(out) == len(set(out))
    return set(out)


def rows_of(seed, count, width=6, clusters=7):
    draw = random.Random(seed)
    middles = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(clusters)]
    return [
        (100 * n // 7, [m + draw.gauss(0, 0.3) for m in draw.choice(middles)], draw.randrange(4))
        for n in range(count)
    ]


SMALL = Mining(sample_rows=40, most_centres=5, rows_per_block=60, queries_per_block=9)


@pytest.mark.parametrize("settings", [Mining(), SMALL])
def test_all_negatives_are_those_of_all_pairs(spark, settings):
    rows = rows_of(1, 700)
    assert found(spark, rows, settings) == plain(rows)


def test_odd_rows(spark):
    rows = rows_of(2, 150, 4)
    rows += [
        (100_000, None, 1), (100_100, [1.0, None], 1), (100_200, [float("nan")], 2),
        (100_300, [float("inf"), 0.0], 2), (100_400, [0.5, 0.5], None), (100_500, [], 3),
        (100_600, [1.0], 3), (None, [0.9, 0.1, 0.2, 0.1], 1), (100_700, [0.0] * 4, 1),
    ]
    rows += [(200_000 + n, [0.75, 0.25, 0.0, 0.0], n % 3) for n in range(300)]
    assert found(spark, rows, SMALL) == plain(rows)
    wide = [(*r, 1, 2, 3) for r in rows]
    assert found(spark, wide, SMALL, SCHEMA + ", centre int, part int, key int") == plain(rows)


def test_equal_vectors_and_repeated_rows(spark):
    rows = [(n, [0.5, -0.25, 1.0], n % 2) for n in range(0, 900, 5)]
    expected = plain(rows)
    assert found(spark, rows, SMALL) == expected
    assert found(spark, rows * 3, SMALL) == expected


def test_empty_table_and_no_anchor(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 1.5], 1), (3, [1.0, 0.5], 2)]) == set()
    assert found(spark, [(100, [1.0], 1)]) == set()


def test_shared_ids_stay_rows_of_their_own(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [0.9, 0.0], 1), (5, [0.5, 0.0], 2)]
    assert found(spark, rows) == {
        (100, 100, 1, 5, 256 * 230, 256 * 128), (100, 100, 1, 5, 256 * 230, 230 * 128)
    }


def test_tree_bounds_hold_and_nodes_are_skipped():
    draw = np.random.default_rng(3)
    middles = draw.normal(size=(30, 16)) * 100
    vectors = np.floor(middles[draw.integers(30, size=3000)] + draw.normal(size=(3000, 16)) * 8)
    norm2 = float((vectors**2).sum(axis=1).max())
    tree = covertree.CoverTree(vectors, norm2)
    query = vectors[:40]
    norms = np.sqrt((query**2).sum(axis=1))
    waiting, nodes = [tree.root], 0
    while waiting:
        node = waiting.pop()
        nodes += 1
        low, high = covertree.bounds(
            query @ vectors[[node.centre]].T, norms, np.array([node.radius]), norm2
        )
        scores = query @ vectors[node.members].T
        assert (scores >= low).all() and (scores <= high).all()
        if node.children:
            members = np.sort(np.concatenate([c.members for c in node.children]))
            assert (members == np.sort(node.members)).all()
        waiting += node.children
    looked = 0

    def allowed(q, r):
        nonlocal looked
        looked += len(q) * len(r)
        return np.ones((len(q), len(r)), dtype=bool)

    q, r, s = tree.best(query, np.full(40, -(2**62)), np.full(40, 2**62), allowed, 5)
    for n in range(40):
        assert sorted(s[q == n])[-5:] == sorted((query[n] @ vectors.T).astype(int))[-5:]
    assert nodes > 40 and looked < 0.5 * 40 * len(vectors)
