"""A generalised additive model with pairwise interactions, for two classes.

Every feature is cut into bins. A lookup table per feature, and one per chosen pair of features, holds
what a bin adds to the logit; a score is the sigmoid of the sum. Tables are boosted in turn, one feature after the
other, each step a tree of few leaves over the bins, fitted to the gradients by Newton's rule and
added at a small rate, so that features that carry the same share the credit. Pairs are ranked afterwards by what
one cut on either side gains on the gradients that remain, and the best are boosted the same way.
"""

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np


@dataclass(frozen=True)
class Boosting:
    bins: int = 32
    rounds: int = 150
    pair_rounds: int = 60
    pairs: int = 8
    rate: float = 0.1
    cuts: int = 3
    # Least number of rows in a leaf, and what is added to its sum of curvatures.
    leaf_rows: int = 10
    damping: float = 1.0


@dataclass
class Model:
    intercept: float
    # One row per feature.
    single: np.ndarray
    pairs: list[tuple[int, int]] = field(default_factory=list)
    double: list[np.ndarray] = field(default_factory=list)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.intercept)
        for f, table in enumerate(self.single):
            total += table[bins[:, f]]
        for (a, b), table in zip(self.pairs, self.double):
            total += table[bins[:, a], bins[:, b]]
        return total

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(bins), -500, 500)))


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many edges lie below it."""
    return np.stack(
        [np.searchsorted(e, values[:, f], side="left") for f, e in enumerate(edges)], axis=1
    ) if len(edges) else np.zeros((len(values), 0), dtype=np.int64)


def _gain(gradient, curvature, damping):
    return gradient * gradient / np.maximum(curvature + damping, 1e-12)


def _cut(gradient, curvature, rows, settings: Boosting):
    """The best place to cut a range of bins in two: (gain, place), or None."""
    left_g, left_h, left_n = np.cumsum(gradient), np.cumsum(curvature), np.cumsum(rows)
    all_g, all_h, all_n = left_g[-1], left_h[-1], left_n[-1]
    gain = (
        _gain(left_g, left_h, settings.damping)
        + _gain(all_g - left_g, all_h - left_h, settings.damping)
        - _gain(all_g, all_h, settings.damping)
    )
    fits = (left_n >= settings.leaf_rows) & (all_n - left_n >= settings.leaf_rows)
    fits[-1] = False
    if not fits.any():
        return None
    place = int(np.where(fits, gain, -np.inf).argmax())
    return (float(gain[place]), place + 1) if gain[place] > 1e-9 else None


def _tree(gradient, curvature, rows, settings: Boosting) -> np.ndarray:
    """What a tree with a few cuts over the bins adds to each of them."""
    ranges = [(0, len(gradient))]
    for _ in range(settings.cuts):
        found = []
        for n, (a, b) in enumerate(ranges):
            cut = _cut(gradient[a:b], curvature[a:b], rows[a:b], settings)
            if cut:
                found.append((cut[0], n, a + cut[1]))
        if not found:
            break
        _, n, place = max(found)
        a, b = ranges[n]
        ranges[n : n + 1] = [(a, place), (place, b)]
    added = np.zeros(len(gradient))
    for a, b in ranges:
        added[a:b] = gradient[a:b].sum() / (curvature[a:b].sum() + settings.damping)
    return added


def _sums(gradient, curvature, at, size):
    return (
        np.bincount(at, gradient, size), np.bincount(at, curvature, size), np.bincount(at, minlength=size)
    )


def _pair_gain(gradient, curvature, rows, settings: Boosting) -> tuple[float, int, int]:
    """The best cross of one cut on either side of a pair's bins: (gain, cut, cut)."""
    g, h, n = (np.cumsum(np.cumsum(m, axis=0), axis=1) for m in (gradient, curvature, rows))

    def quarters(c):
        whole = c[-1, -1]
        upper, side, corner = c[:-1, -1:], c[-1:, :-1], c[:-1, :-1]
        return corner, upper - corner, side - corner, whole - upper - side + corner

    total = 0.0
    fits = True
    for qg, qh, qn in zip(quarters(g), quarters(h), quarters(n)):
        total = total + _gain(qg, qh, settings.damping)
        fits = fits & (qn >= settings.leaf_rows)
    total = np.where(fits, total - _gain(g[-1, -1], h[-1, -1], settings.damping), -np.inf)
    if not total.size:
        return -np.inf, 0, 0
    a, b = np.unravel_index(int(total.argmax()), total.shape)
    return float(total[a, b]), int(a) + 1, int(b) + 1


def fitted(bins: np.ndarray, labels: np.ndarray, sizes: list[int], settings: Boosting) -> Model:
    """A model of rows of bin numbers; ``sizes`` are the numbers of bins."""
    rows, features = bins.shape
    good = float(labels.sum())
    intercept = float(np.log((good + 1.0) / (rows - good + 1.0)))
    model = Model(intercept, np.zeros((features, max(sizes, default=1))))
    if good in (0.0, float(rows)):
        return model
    logits = np.full(rows, intercept)

    def slopes():
        chance = 1.0 / (1.0 + np.exp(-logits))
        return labels - chance, chance * (1.0 - chance)

    for _ in range(settings.rounds):
        for f in range(features):
            if sizes[f] < 2:
                continue
            sums = _sums(*slopes(), bins[:, f], sizes[f])
            step = settings.rate * _tree(*sums, settings)
            model.single[f, : sizes[f]] += step
            logits += step[bins[:, f]]
    model.pairs = _chosen(slopes(), bins, sizes, settings)
    model.double = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(settings.pair_rounds):
        for (a, b), table in zip(model.pairs, model.double):
            at = bins[:, a] * sizes[b] + bins[:, b]
            g, h, n = (m.reshape(sizes[a], sizes[b]) for m in _sums(*slopes(), at, sizes[a] * sizes[b]))
            gain, x, y = _pair_gain(g, h, n, settings)
            if gain <= 1e-9:
                continue
            step = np.zeros_like(table)
            for s in (np.s_[:x, :y], np.s_[:x, y:], np.s_[x:, :y], np.s_[x:, y:]):
                step[s] = settings.rate * g[s].sum() / (h[s].sum() + settings.damping)
            table += step
            logits += step[bins[:, a], bins[:, b]]
    return model


def _chosen(slopes, bins, sizes, settings: Boosting) -> list[tuple[int, int]]:
    found = []
    for a, b in combinations(range(len(sizes)), 2):
        if min(sizes[a], sizes[b]) < 2:
            continue
        at = bins[:, a] * sizes[b] + bins[:, b]
        sums = (m.reshape(sizes[a], sizes[b]) for m in _sums(*slopes, at, sizes[a] * sizes[b]))
        gain = _pair_gain(*sums, settings)[0]
        if gain > 1e-9:
            found.append((-gain, a, b))
    return [(a, b) for _, a, b in sorted(found)[: settings.pairs]]


def mean_of(models: list[Model], weights: list[float], sizes: list[int]) -> Model:
    """The model whose logit is the weighted mean of theirs, with one table for each pair any has."""
    share = np.array(weights, dtype=np.float64) / sum(weights)
    mean = Model(
        float(sum(w * m.intercept for w, m in zip(share, models))),
        sum(w * m.single for w, m in zip(share, models)),
    )
    tables: dict[tuple[int, int], np.ndarray] = {}
    for w, m in zip(share, models):
        for pair, table in zip(m.pairs, m.double):
            here = tables.setdefault(pair, np.zeros((sizes[pair[0]], sizes[pair[1]])))
            here += w * table
    mean.pairs = sorted(tables)
    mean.double = [tables[p] for p in mean.pairs]
    return mean
