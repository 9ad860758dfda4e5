"""A cover tree over vectors of one norm, searched for the largest inner products.

Candidates are given one more coordinate so that all have the same norm M; a query has zero there, so
inner products stay as they are. On that sphere an inner product is |q| M times the cosine of an angle, and a
node whose members lie within the angle r of its centre has all of them between the cosines of
(angle - r) and (angle + r). Levels cover with radii that shrink by ``BASE``; centres of a level are further apart
than its radius, and every node keeps the radius its members really have.

Nodes are taken best first. One is left out for a query when its bounds lie outside the query's
window or under the worst of its best so far; what remains is verified by exact inner products.
"""

from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np

BASE = 1.3
# Nodes of so few members are verified row by row.
LEAF = 64
# Queries are taken in lots, which bounds the matrix of scores.
QUERIES = 512
EXACT = 2.0**53


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as doubles while these hold all sums, else as integers."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)))
    most = float(np.abs(left).max()) * float(np.abs(right).max()) * left.shape[1]
    if most < EXACT:
        return left.astype(np.float64) @ right.astype(np.float64).T
    return left.astype(np.int64) @ right.astype(np.int64).T


def extra(vectors: np.ndarray, norm2: float) -> np.ndarray:
    """The further coordinate of candidates, for the common squared norm."""
    whole = vectors.astype(np.float64)
    return np.sqrt(np.maximum(norm2 - np.einsum("ij,ij->i", whole, whole), 0.0))


def angles(left, left_extra, right, right_extra, norm2: float) -> np.ndarray:
    """Angles between candidates on the sphere."""
    if norm2 <= 0:
        return np.zeros((len(left), len(right)))
    cosine = left.astype(np.float64) @ right.astype(np.float64).T + np.outer(left_extra, right_extra)
    return np.arccos(np.clip(cosine / norm2, -1.0, 1.0))


def bounds(scores: np.ndarray, size: np.ndarray, radius: np.ndarray, norm2: float):
    """Least and largest inner product of queries with members of nodes.

    ``scores`` are those with the nodes' centres, ``size`` the norms of the queries. A margin far over the
    error of the arithmetic keeps both on the safe side.
    """
    scale = (size * np.sqrt(norm2))[:, None]
    safe = np.where(scale > 0, scale, 1.0)
    angle = np.arccos(np.clip(scores / safe, -1.0, 1.0))
    upper = scale * np.cos(np.maximum(angle - radius, 0.0))
    lower = scale * np.cos(np.minimum(angle + radius, np.pi))
    margin = 1e-6 * scale + 1e-6
    return lower - margin, upper + margin


def spread_out(vectors: np.ndarray, further: np.ndarray, norm2: float, count: int) -> np.ndarray:
    """Places of ``count`` centres, each the one farthest from all before it.

    Any first part of them is a level of a cover tree: apart by the radius it covers with.
    """
    chosen = [0]
    distance = angles(vectors, further, vectors[:1], further[:1], norm2)[:, 0]
    while len(chosen) < min(count, len(vectors)) and distance.max() > 0:
        far = int(distance.argmax())
        chosen.append(far)
        here = angles(vectors, further, vectors[far : far + 1], further[far : far + 1], norm2)
        distance = np.minimum(distance, here[:, 0])
    return np.array(chosen)


@dataclass
class Node:
    centre: int
    radius: float
    members: np.ndarray
    children: list["Node"] = field(default_factory=list)


class CoverTree:
    """A tree over some rows of vectors, all of which fit in memory."""

    def __init__(self, vectors: np.ndarray, norm2: float):
        self.vectors, self.norm2 = vectors, norm2
        self.further = extra(vectors, norm2)
        everyone = np.arange(len(vectors))
        reach = self._angles(everyone, np.array([0]))[:, 0]
        self.root = Node(0, float(reach.max()), everyone)
        waiting = [(self.root, self.root.radius)]
        while waiting:
            node, cover = waiting.pop()
            # A level that puts all members under one centre is that centre's next level too.
            while len(node.members) > LEAF and node.radius > 0 and not node.children:
                cover /= BASE
                node.children = self._level(node.members, cover) if cover < node.radius else []
                if len(node.children) == 1 and node.children[0].radius >= node.radius:
                    node.children = []
                if cover < 1e-6:
                    break
            waiting += [(child, min(cover, child.radius)) for child in node.children]

    def _angles(self, rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return angles(
            self.vectors[rows], self.further[rows], self.vectors[centres], self.further[centres],
            self.norm2,
        )

    def _level(self, members: np.ndarray, cover: float) -> list[Node]:
        """Centres further apart than ``cover``, each with the members nearest to it."""
        open_rows, centres = members, []
        nearest = np.full(len(members), np.inf)
        owner = np.zeros(len(members), dtype=np.int64)
        uncovered = np.ones(len(members), dtype=bool)
        while uncovered.any():
            centre = int(open_rows[int(uncovered.argmax())])
            distance = self._angles(members, np.array([centre]))[:, 0]
            distance[members == centre] = 0.0
            closer = distance < nearest
            nearest[closer], owner[closer] = distance[closer], len(centres)
            uncovered &= distance > cover
            uncovered[members == centre] = False
            centres.append(centre)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(1, len(centres)))
        groups = np.split(order, cuts)
        return [Node(c, float(nearest[g].max()), members[g]) for c, g in zip(centres, groups)]

    def best(self, queries, low, high, allowed, size: int):
        """The ``size`` largest inner products of each query within its window.

        ``allowed(asked, rows)`` says which rows may answer which queries. Gives (query, row, score) of all
        that may be among them, ties of the last one included.
        """
        found = [
            self._best_of(at, queries, low, high, allowed, size)
            for at in np.array_split(np.arange(len(queries)), -(-len(queries) // QUERIES))
            if len(at)
        ]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(part) for part in zip(*found))

    def _best_of(self, at, queries, low, high, allowed, size):
        asked, high = queries[at], high[at].astype(np.float64)
        floor = low[at].astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", asked.astype(np.float64), asked.astype(np.float64)))
        tops = np.full((len(at), size), -np.inf)
        hits = []

        def least() -> np.ndarray:
            return np.maximum(floor, tops[:, 0])

        def verify(some: np.ndarray, rows: np.ndarray) -> None:
            exact = products(asked[some], self.vectors[rows])
            fits = (exact >= floor[some, None]) & (exact <= high[some, None]) & allowed(at[some], rows)
            scores = np.where(fits, exact, -np.inf)
            both = np.concatenate([tops[some], scores], axis=1)
            tops[some] = np.sort(np.partition(both, both.shape[1] - size, axis=1)[:, -size:], axis=1)
            query, row = np.nonzero(fits & (scores >= least()[some, None]))
            hits.append((some[query], rows[row], exact[query, row].astype(np.int64)))

        waiting, order = [(0.0, 0, self.root, np.arange(len(at)))], 1
        while waiting:
            _, _, node, some = heappop(waiting)
            # What was found since may have closed the node for some queries.
            some = some[self._open(asked, norms, some, [node], least(), high)[0][:, 0]]
            if not len(some):
                continue
            if not node.children:
                verify(some, node.members)
                continue
            opened, upper = self._open(asked, norms, some, node.children, least(), high)
            inner = np.array([bool(c.children) for c in node.children])
            single = opened[:, ~inner].any(axis=0)
            rows = [c.members for c, o in zip([c for c in node.children if not c.children], single) if o]
            if rows:
                wanted = opened[:, ~inner].any(axis=1)
                verify(some[wanted], np.concatenate(rows))
            for n in np.flatnonzero(inner):
                if opened[:, n].any():
                    mine = opened[:, n]
                    heappush(waiting, (-float(upper[mine, n].max()), order, node.children[n], some[mine]))
                    order += 1
        if not hits:
            nothing = np.zeros(0, np.int64)
            return nothing, nothing, nothing
        query, row, score = (np.concatenate(part) for part in zip(*hits))
        stays = score >= least()[query]
        return at[query[stays]], row[stays], score[stays]

    def _open(self, asked, norms, some, nodes, low, high):
        centres = self.vectors[[n.centre for n in nodes]]
        radius = np.array([n.radius for n in nodes])
        lower, upper = bounds(products(asked[some], centres), norms[some], radius, self.norm2)
        return (upper >= low[some, None]) & (lower <= high[some, None]), upper
