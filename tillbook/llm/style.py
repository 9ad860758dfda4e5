"""Numbers that tell well-made text from junk, taken from whole texts.

Texts are worked on in lots, as arrays of code points; one text is never cut, so a lot holds at
least one text and takes some forty bytes a character.
"""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

LOT = 1 << 18
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"

NAMES = [
    "characters", "words", "word_length", "longest_word", "symbols", "exclamations", "bars", "capitals",
    "digits", "beyond_ascii", "sentence_ends", "commas", "line_ends", "different_words", "same_as_before",
    "in_repeated_windows", "short_words", "odd_ends", "commonest_word", "capitalised", "repeated_lines",
    "letters",
]

(BLANK, SYMBOL, EXCLAMATION, BAR, END, COMMA, LINE, DIGIT, CAPITAL, LETTER, OTHER) = range(11)
KINDS = 11


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point of the basic plane; what lies beyond counts as its last one."""
    table = np.full(1 << 16, OTHER, dtype=np.int8)
    for point in range(1 << 16):
        character = chr(point)
        if character.isalpha():
            table[point] = CAPITAL if character.isupper() else LETTER
        elif character.isdigit():
            table[point] = DIGIT
    for characters, kind in (
        (BLANKS, BLANK), (SYMBOLS, SYMBOL), (ENDS, END), ("!", EXCLAMATION), ("|", BAR), (",", COMMA),
        ("\n", LINE),
    ):
        for character in characters:
            table[ord(character)] = kind
    return table


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


def features(texts: list[str]) -> np.ndarray:
    """One row of numbers per text; an empty text has zeros throughout."""
    return np.concatenate([_features(lot) for lot in lots(texts)]) if texts else np.zeros((0, len(NAMES)))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def _pieces(starts, lengths, points):
    """A hash of each run of code points that begins at a start."""
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.repeat(starts, lengths) + place
    value = _mixed(points[at].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(24)))
    return np.add.reduceat(value, np.cumsum(lengths) - lengths) if len(lengths) else value


def _counts(owner, hashes, size):
    """For each piece how often its text has it, and its place among the equal ones."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    group = np.cumsum(new) - 1
    times = np.bincount(group, minlength=1)[group] if len(o) else group
    here = np.empty(len(o), dtype=np.int64)
    here[order] = times
    first = np.zeros(len(o), dtype=bool)
    first[order] = new
    return here, first


def _features(lot: list[str]) -> np.ndarray:
    count = len(lot)
    # A line end between texts keeps their words and lines apart.
    points = np.frombuffer(("\n".join(lot) + "\n").encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(t) for t in lot])
    owner = np.repeat(np.arange(count), lengths + 1)
    added = np.cumsum(lengths + 1) - 1
    kind = kinds()[np.minimum(points, (1 << 16) - 1)]
    table = np.bincount(owner * KINDS + kind, minlength=count * KINDS).reshape(count, KINDS)
    table = table.astype(np.float64)
    table[:, LINE] -= 1
    beyond = np.bincount(owner[points > 127], minlength=count)

    blank = (kind == BLANK) | (kind == LINE)
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes, of = stops - starts, owner[starts]
    hashes = _pieces(starts, sizes, points)
    words = np.bincount(of, minlength=count).astype(np.float64)

    def share(hit) -> np.ndarray:
        return np.bincount(of[hit], minlength=count)

    times, first = _counts(of, hashes, count)
    most = np.zeros(count)
    np.maximum.at(most, of, times)
    longest = np.zeros(count)
    np.maximum.at(longest, of, sizes)
    again = np.zeros(len(of), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    windowed = np.zeros(len(of), dtype=bool)
    if len(of) > 2:
        three = hashes[:-2] * np.uint64(3) + _mixed(hashes[1:-1]) * np.uint64(5) + _mixed(_mixed(hashes[2:]))
        whole = of[:-2] == of[2:]
        repeated = np.zeros(len(three), dtype=bool)
        repeated[whole] = _counts(of[:-2][whole], three[whole], count)[0] > 1
        for shift in range(3):
            windowed[shift : len(three) + shift] |= repeated
    last, head = kind[stops - 1], kind[starts]
    odd = (last != LETTER) & (last != CAPITAL) & (last != DIGIT) & (last != END) & (last != COMMA)

    line_stops = np.flatnonzero(kind == LINE)
    line_starts = np.concatenate([[0], line_stops[:-1] + 1])
    inked = line_stops > line_starts
    line_of = owner[line_stops[inked]]
    line_hash = _pieces(line_starts[inked], (line_stops - line_starts)[inked], points)
    _, new_line = _counts(line_of, line_hash, count)
    lines = np.maximum(np.bincount(line_of, minlength=count), 1)

    letters = table[:, LETTER] + table[:, CAPITAL]
    chars, per_word = np.maximum(lengths, 1), np.maximum(words, 1)
    columns = [
        np.log1p(lengths), np.log1p(words), np.bincount(of, sizes, count) / per_word, np.log1p(longest),
        (table[:, SYMBOL] + table[:, BAR]) / chars, table[:, EXCLAMATION] / chars, table[:, BAR] / chars,
        table[:, CAPITAL] / np.maximum(letters, 1), table[:, DIGIT] / chars, beyond / chars,
        (table[:, END] + table[:, EXCLAMATION]) / per_word, table[:, COMMA] / per_word,
        table[:, LINE] / per_word, share(first) / per_word, share(again) / per_word,
        share(windowed) / per_word, share(sizes <= 3) / per_word, share(odd) / per_word, most / per_word,
        share(head == CAPITAL) / per_word, 1 - np.bincount(line_of[new_line], minlength=count) / lines,
        letters / chars,
    ]
    out = np.stack(columns, axis=1)
    out[lengths == 0] = 0.0
    return out
