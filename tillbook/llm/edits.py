"""Cheapest edits of a conversation's turns, by lookup of whole blocks of turns.

A turn is a symbol: the class of its role's initial and its first fault. What edits of the
turns from some place on cost depends only on how the output stands there: empty, ended by a system,
a user or an assistant turn. These four costs, less the least of them, make a *vector*, and only a few dozen
vectors exist. So tables are made once for every block of four symbols and every vector after it: the vector
before it, and what it adds. Turns are run through from the end, a block a lookup, and blocks are then
opened backward to find the vector after each turn. With it the edits are traced forward, the letter
that is least in ASCII first among those that stay cheapest, which settles ties for the whole string.
"""

from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np

# What an edit costs, and what a truncated turn that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# How the output stands.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
# Classes of role initials; a turn's class is also the state that keeping it leads to.
OTHER = 0
CLASSES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
# Faults.
SOUND, BLANK, DUPLICATE, CUT = range(4)
# A turn's code is 4 * fault + class, written as a letter.
FIRST_LETTER = "A"

# Symbols: one for all that must go, four sound classes, four truncated ones, and no turn at all.
GONE, NOTHING = 0, 9
SYMBOLS = 10
BLOCK = 4
FAR = 1 << 20

# From a state: the role that may follow by rerole or insert, and what may be kept.
FOLLOWS = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {EMPTY: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
NAMES = {USER: "user", ASSISTANT: "assistant"}


def symbol_of(code: int) -> int:
    fault, role = divmod(code, 4)
    if fault in (BLANK, DUPLICATE):
        return GONE
    return 1 + role + (4 if fault == CUT else 0)


OF_CODE = np.array([symbol_of(c) for c in range(16)], dtype=np.int64)


def _with_inserts(costs: list[int]) -> list[int]:
    for _ in range(STATES):
        costs = [min(costs[s], INSERT + costs[FOLLOWS[s]]) for s in range(STATES)]
    return costs


def _options(symbol: int, state: int, after: tuple[int, ...]) -> dict[str, tuple[int, int]]:
    """Edits that use up the turn: letter to (cost to the end, next state)."""
    if symbol == NOTHING:
        return {"": (after[state], state)}
    found = {"D": (DELETE + after[state], state)}
    if symbol != GONE:
        role, fine = (symbol - 1) % 4, TRUNCATED if symbol > 4 else 0
        if role in KEPT[state]:
            found["K"] = (KEEP + fine + after[role], role)
        found["R"] = (REROLE + fine + after[FOLLOWS[state]], FOLLOWS[state])
    return found


@dataclass(frozen=True)
class Edits:
    """All tables. Vectors are numbered; number 0 is the one after the last turn."""

    vectors: list[tuple[int, ...]]
    # By vector after and symbol: vector before, and what was taken off it.
    before: list[list[int]]
    added: list[list[int]]
    # The same by block code.
    block_before: np.ndarray
    block_added: np.ndarray
    # By vector after, symbol and state: letters, roles put in before the turn, next state.
    steps: list[list[list[tuple[str, int]]]]
    # By state after the last turn: letters.
    tails: list[str]


@lru_cache(maxsize=1)
def edits() -> Edits:
    last = tuple(_with_inserts([0, FAR, FAR, 0]))
    vectors, numbers, before, added, steps = [last], {last: 0}, [], [], []
    at = 0
    while at < len(vectors):
        after, row, plus, traces = vectors[at], [], [], []
        for symbol in range(SYMBOLS):
            options = [_options(symbol, s, after) for s in range(STATES)]
            whole = _with_inserts([min(c for c, _ in o.values()) for o in options])
            least = 0 if symbol == NOTHING else min(whole)
            # Without a turn the vector stays as it is, that after the last turn included.
            vector = after if symbol == NOTHING else tuple(c - least for c in whole)
            if vector not in numbers:
                numbers[vector] = len(vectors)
                vectors.append(vector)
            row.append(numbers[vector])
            plus.append(least)
            traces.append([_traced(options, whole, s) for s in range(STATES)])
        before.append(row)
        added.append(plus)
        steps.append(traces)
        at += 1
    one, cost = np.array(before), np.array(added)
    codes = np.array(list(product(range(SYMBOLS), repeat=BLOCK)))
    reached = np.repeat(np.arange(len(vectors))[:, None], len(codes), axis=1)
    total = np.zeros_like(reached)
    for place in reversed(range(BLOCK)):
        symbol = codes[:, place][None, :]
        total += cost[reached, symbol]
        reached = one[reached, symbol]
    return Edits(vectors, before, added, reached, total, steps, ["", "II", "I", ""])


def _traced(options: list[dict], whole: list[int], state: int) -> tuple[str, int]:
    letters = ""
    while True:
        if "" in options[state]:
            return "", state
        if options[state]["D"][0] == whole[state]:
            return letters + "D", state
        if INSERT + whole[FOLLOWS[state]] == whole[state]:
            letters, state = letters + "I", FOLLOWS[state]
            continue
        for letter in "KR":
            if letter in options[state] and options[state][letter][0] == whole[state]:
                return letters + letter, options[state][letter][1]
        raise AssertionError("no edit has the cost found")


def codes_of(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode("ascii"), dtype=np.uint8).astype(np.int64) - ord(FIRST_LETTER)


def _blocks(symbols: np.ndarray) -> np.ndarray:
    """Block codes, filled up at the front with no turns."""
    filled = np.concatenate([np.full(-len(symbols) % BLOCK, NOTHING, dtype=np.int64), symbols])
    return filled.reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK)[::-1])


def through(letters: str) -> tuple[np.ndarray, np.ndarray]:
    """For every vector after the turns: the vector before them, and what they cost beyond it."""
    t = edits()
    vector = np.arange(len(t.vectors))
    cost = np.zeros(len(vector), dtype=np.int64)
    for code in _blocks(OF_CODE[codes_of(letters)])[::-1].tolist():
        cost += t.block_added[vector, code]
        vector = t.block_before[vector, code]
    return vector, cost


def after_each(symbols: np.ndarray, end: int) -> tuple[list[int], int, int]:
    """The vector after each turn, then the one before the first, and the cost taken off."""
    t = edits()
    blocks = _blocks(symbols).tolist()
    ends, vector, cost = [0] * len(blocks), end, 0
    for b in range(len(blocks) - 1, -1, -1):
        ends[b] = vector
        cost += int(t.block_added[vector, blocks[b]])
        vector = int(t.block_before[vector, blocks[b]])
    start, found = vector, [0] * len(symbols)
    given = symbols.tolist()
    first = len(symbols) - BLOCK * len(blocks)
    for b, at_end in enumerate(ends):
        here = at_end
        for i in range(first + BLOCK * (b + 1) - 1, max(first + BLOCK * b, 0) - 1, -1):
            found[i] = here
            here = t.before[here][given[i]]
    return found, start, cost


def traced(letters: str, end: int = 0, state: int = EMPTY, closes: bool = True):
    """The audit, the outputs as (turn or -1, role or 0 as it was), and the state reached."""
    t = edits()
    symbols = OF_CODE[codes_of(letters)]
    vectors, _, _ = after_each(symbols, end)
    audit, turns, roles = [], [], []
    for i, (vector, symbol) in enumerate(zip(vectors, symbols.tolist())):
        did, following = t.steps[vector][symbol][state]
        audit.append(did)
        for letter in did:
            if letter == "D":
                continue
            role = FOLLOWS[state]
            turns.append(-1 if letter == "I" else i)
            roles.append(0 if letter == "K" else role)
            state = role
        state = following
    if closes:
        for _ in t.tails[state]:
            state = FOLLOWS[state]
            turns.append(-1)
            roles.append(state)
            audit.append("I")
    return "".join(audit), turns, roles, state


def cheapest(letters: str) -> int:
    """What the edits of a whole conversation cost."""
    t = edits()
    _, start, cost = after_each(OF_CODE[codes_of(letters)], 0)
    return cost + t.vectors[start][EMPTY]


def reached(letters: str, end: int) -> list[int]:
    """The state after the turns, from each state before them."""
    t = edits()
    symbols = OF_CODE[codes_of(letters)]
    vectors, _, _ = after_each(symbols, end)
    given, out = symbols.tolist(), []
    for state in range(STATES):
        for vector, symbol in zip(vectors, given):
            state = t.steps[vector][symbol][state][1]
        out.append(state)
    return out


def faults(letters: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated turns, and neighbours whose roles may not follow each other."""
    codes = codes_of(letters)
    counts = np.bincount(codes // 4, minlength=4)
    role = codes % 4
    return int(counts[BLANK]), int(counts[DUPLICATE]), int(counts[CUT]), int(np.sum(~legal(role[:-1], role[1:])))


def legal(first, second):
    """Neighbouring roles su, ua or au."""
    first, second = np.asarray(first), np.asarray(second)
    to_user = ((first == SYSTEM) | (first == ASSISTANT)) & (second == USER)
    return to_user | ((first == USER) & (second == ASSISTANT))
