"""Sets of word shingles as numbers, worked out with numpy for many texts at once.

A word's hash is that of its bytes as a polynomial modulo 2**64; running sums over the
bytes of all texts give every word's polynomial by one subtraction, so nothing
is done word by word.
"""

from collections.abc import Iterator

import numpy as np

U = np.uint64
# Fixed odd numbers: base of the polynomial and multipliers of the finishing steps.
BASE = 0x9E3779B97F4A7C15
MIX_A, MIX_B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
# Texts are worked on in lots of about so many bytes; a longer text is a lot of its own.
LOT = 1 << 20

_powers: list[np.ndarray] = []


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, as far as asked for."""
    if not _powers or len(_powers[0]) < length:
        inverse = pow(BASE, -1, 1 << 64)
        size = max(length, LOT + LOT // 4)
        tables = []
        for base in (BASE, inverse):
            steps = np.full(size, base, dtype=U)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


def lots(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about one lot each."""
    first = size = 0
    for at, text in enumerate(texts):
        if at > first and size + len(text) > LOT:
            yield first, at
            first, size = at, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of some bytes; A-Z count as a-z."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[1], blank.astype(np.int8), [1]])))
    starts, ends = edges[0::2], edges[1::2]
    value = data.astype(U)
    value[(data >= 65) & (data <= 90)] += U(32)
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((value + U(1)) * up[: len(data)])])
    return starts, ends, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def pair_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its pairs of neighbouring words.

    A-Z are lower-cased. A text of one word gives the hash of that word; one without words gives
    an empty array, and so does None.
    """
    coded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    for first, stop in lots(coded):
        lot = coded[first:stop]
        sizes = np.array([len(t) + 1 for t in lot])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"\n".join(lot) + b"\n", dtype=np.uint8)
        starts, _, word = word_hashes(data)
        pair = mixed(word[:-1] * MIX_B + mixed(word[1:])) if len(word) > 1 else word[:0]
        bounds = np.searchsorted(starts, begins)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.unique(pair[a : b - 1]) if b - a > 1 else word[a:b]


def seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and summands of so many hash functions."""
    at = np.arange(1, count + 1, dtype=U)
    return mixed(at * U(BASE)) | U(1), mixed(at * MIX_A)


def minimums(hashes: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty, as 32 bits."""
    least = np.full(len(scale), np.iinfo(U).max, dtype=U)
    step = max(64, (1 << 18) // len(scale))
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step, None] * scale[None, :] + shift[None, :]
        least = np.minimum(least, part.min(axis=0))
    return (least >> U(32)).astype(np.uint32)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted arrays of distinct hashes."""
    return len(np.intersect1d(a, b, assume_unique=True))
