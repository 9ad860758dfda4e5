"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from tillbook.llm import conversations, edits

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
INK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(turns):
    """(cost, audit, output roles and texts) by trying every edit; turns are (role, text, fault)."""

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(turns) and state in "ea" else []
        follows = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[follows]
        ways = []
        if i < len(turns):
            role, text, fault = turns[i]
            extra = 5 if fault == "truncated" else 0
            ways.append((2, "D", (), i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                ways.append((1 + extra, "R", ((name, text),), i + 1, follows, 0))
                initial = role[:1]
                if initial and initial == follows or (initial == "s" and state == "e"):
                    ways.append((extra, "K", ((role, text),), i + 1, initial, 0))
        if inserts < 3:
            ways.append((5, "I", ((name, ""),), i, follows, inserts + 1))
        for cost, letter, made, *rest in ways:
            tail = best(*rest)
            if tail:
                found.append((cost + tail[0], letter + tail[1], made + tail[2]))
        return min(found, default=None)

    return best(0, "e", 0)


def plain(rows):
    kept, everyone = defaultdict(list), set()
    for conv, turn, role, text in rows:
        everyone.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        place = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(place.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        kept[conv] += [row, row] if kind == 3 else [row]
    out = {}
    for conv in everyone:
        order = sorted(kept[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, count = set(), [], defaultdict(int)
        for _, role, text in order:
            ink = INK.findall(text)
            fault = (
                "blank" if not ink else "duplicate" if (role, text) in seen
                else "truncated" if ink[-1] not in ".!?" else ""
            )
            seen.add((role, text))
            count[fault] += 1
            turns.append((role, text, fault))
        initials = [r[:1] for r, _, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        numbers = [n for n, _, _ in order if n is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit, made = cheapest(tuple(turns))
        text = "\n".join(f"{role}:{said}" for role, said in made)
        out[conv] = (
            gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def report(df, floor=10_000):
    rows = conversations.repair_report(df, floor).collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


TEXTS = ["", " \n", "Yes.", "No?", "cut", "Yes. ", "é!", "　", "a\tb", None]
ROLES = ["user", "assistant", "system", "tool", "", "User", "s", None]


def some_rows(seed, convs, most):
    draw = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for _ in range(draw.randrange(1, most)):
            turn = draw.choice([None, *range(-2, most)])
            rows.append((conv, turn, draw.choice(ROLES[:3] + ROLES), draw.choice(TEXTS)))
    return rows


def test_counts_and_edits_are_those_of_a_plain_search(spark):
    rows = some_rows(1, 150, 9)
    assert report(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_a_conversation_cut_into_segments_gives_the_same(spark):
    rows = some_rows(2, 6, 12) + [(99, n % 40, ROLES[n % 5], TEXTS[n * 7 % 9]) for n in range(120)]
    rows += [(99, None, "user", "Yes.")] * 30
    rows += [(None, n, ["user", "assistant"][n % 2], f"{n}.") for n in range(60)]
    assert report(spark.createDataFrame(rows, SCHEMA), floor=20) == plain(rows)


def test_lines_of_both_ways_are_alike(spark):
    rows = [(n % 3, n, ROLES[n % 4], TEXTS[n % 9]) for n in range(90)]
    turns = conversations.conversation_turns(spark.createDataFrame(rows, SCHEMA))
    order = ["conv_id", "segment", "place"]
    lines = [
        [(r["conv_id"], r["line"]) for r in conversations.repaired_lines(turns, floor).orderBy(*order).collect()]
        for floor in (5, 10_000)
    ]
    assert lines[0] == lines[1] and lines[0]


def test_dropped_conversations_empty_tables_and_further_columns(spark):
    gone = next(n for n in range(1000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello.")]
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert report(spark.createDataFrame(rows, SCHEMA)) == {gone: empty}
    assert report(spark.createDataFrame([], SCHEMA)) == {}
    assert report(spark.createDataFrame(rows * 12_000, SCHEMA)) == {gone: empty}
    more = [(1, 0, "user", "Hello.", "x", 5, True), (1, 1, "assistant", "Hi.", "y", 6, False)]
    wide = spark.createDataFrame(
        more, SCHEMA + ", _conv string, _copy int, _gone boolean"
    )
    narrow = [r[:4] for r in more]
    assert report(wide) == plain(narrow)
    far = [(5, -(2**63), "user", "a."), (5, 2**63 - 1, "assistant", "b.")]
    assert report(spark.createDataFrame(far, SCHEMA))[5][0] is None


def test_long_texts_pass_whole(spark):
    rows = [(3, 0, "user", "w. " * 200_000), (3, 1, "assistant", "v " * 200_000 + "!")]
    assert report(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


@pytest.mark.parametrize("length", [1, 3, 4, 5, 9, 40])
def test_segments_compose(length):
    draw = random.Random(length)
    for _ in range(30):
        letters = "".join(chr(65 + draw.randrange(16)) for _ in range(length))
        cut = draw.randrange(length)
        vectors, _ = edits.through(letters[cut:])
        first = edits.traced(letters[:cut], int(vectors[0]), 0, False)
        second = edits.traced(letters[cut:], 0, first[3], True)
        assert first[0] + second[0] == edits.traced(letters)[0]


def test_registered_query_on_the_small_table(spark):
    from tillbook.llm import registry

    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = registry.queries()["op11_conversation_repair"](spark, folder).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in found} == plain(rows)
