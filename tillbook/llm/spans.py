"""Positions of all matches of a pattern, in code points, from built-in functions.

A text is cut twice by the same pattern, once into its matches and once into the gaps
between them. The running sum of their lengths tells where each match stands. Both
passes go from left to right and never meet a character twice, and each row is
worked on where it is read: nothing is shuffled.

As a possessive pattern cannot step back, the patterns below take time in proportion
to the text, whatever it holds.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters looked at on either side of a match.
NEAR = 40
# Running sums are made in stretches of this length, so that appending stays cheap.
STRETCH = 256


@dataclass(frozen=True)
class Kind:
    """What to look for. ``sign`` is a quick pattern that any text with a match has.

    With a ``group``, the pattern matches the head of a candidate and captures all of it while
    looking ahead, so that candidates may overlap. ``cut`` then gives the part of a candidate that
    counts, or NULL, and of parts that overlap the earlier one stays.
    """

    name: str
    pattern: str
    sign: str
    confirm: Callable[[Column], Column]
    group: int = 0
    cut: Callable[[Column], Column] | None = None


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sum(values: Column) -> Column:
    """Inclusive running sums of an array of integers."""
    none = F.array(F.lit(0).cast("long"))

    def summed(stretch: Column) -> Column:
        return F.aggregate(
            stretch, none, lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v))
        )

    stretches = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(values) / STRETCH).cast("int")),
        lambda c: summed(F.slice(values, c * STRETCH + 1, STRETCH)),
    )
    return bound(
        stretches,
        lambda parts: bound(
            F.aggregate(
                parts,
                none,
                lambda a, e: F.concat(a, F.array(F.element_at(a, -1) + F.element_at(e, -1))),
            ),
            lambda offsets: F.flatten(
                F.transform(
                    parts,
                    lambda e, c: F.transform(
                        F.slice(e, 2, F.size(e) - 1), lambda v: v + offsets[c]
                    ),
                )
            ),
        ),
    )


def apart(spans: Column) -> Column:
    """Spans in order of their start, without those that begin inside one that stays."""
    spread = F.aggregate(
        spans,
        F.struct(F.array().cast("array<int>").alias("stay"), F.lit(0).cast("long").alias("upto"), F.lit(0).alias("i")),
        lambda a, s: F.struct(
            F.when(s.start >= a.upto, F.concat(a.stay, F.array(a.i))).otherwise(a.stay).alias("stay"),
            F.greatest(a.upto, F.when(s.start >= a.upto, s.end)).alias("upto"),
            (a.i + 1).alias("i"),
        ),
        lambda a: a.stay,
    )
    return bound(spread, lambda stay: F.transform(stay, lambda i: spans[i]))


def find(docs: DataFrame, keep: Sequence[str], text: Column, kinds: Sequence[Kind]) -> DataFrame:
    """``keep`` and, for each kind, an array of its confirmed spans in order of their start.

    A span is (kind, start, end, match, before, after); ``before`` and ``after`` are up to
    ``NEAR`` characters of the gaps around it, which end at the next match of that kind.
    """
    kept = list(keep)
    searched = docs.select(*kept, text.alias("_text")).select(
        *kept,
        *[
            column
            for kind in kinds
            for column in (
                F.when(
                    F.col("_text").rlike(kind.sign),
                    F.regexp_extract_all("_text", F.lit(kind.pattern), F.lit(0)),
                ).alias(f"_found_{kind.name}"),
                F.when(
                    F.col("_text").rlike(kind.sign), F.split("_text", kind.pattern, -1)
                ).alias(f"_gaps_{kind.name}"),
            )
        ],
        *[
            F.when(
                F.col("_text").rlike(kind.sign),
                F.regexp_extract_all("_text", F.lit(kind.pattern), F.lit(kind.group)),
            ).alias(f"_wholes_{kind.name}")
            for kind in kinds
            if kind.group
        ],
    )

    def ends(kind: Kind) -> Column:
        lengths = F.zip_with(
            F.slice(F.col(f"_gaps_{kind.name}"), 1, F.size(f"_found_{kind.name}")),
            F.col(f"_found_{kind.name}"),
            lambda gap, match: F.length(gap) + F.length(match),
        )
        return running_sum(lengths)

    ended = searched.select("*", *[ends(kind).alias(f"_ends_{kind.name}") for kind in kinds])

    def cut_spans(kind: Kind) -> Column:
        """As below; a gap then holds the rest of the candidate before it."""
        gaps, stops = F.col(f"_gaps_{kind.name}"), F.col(f"_ends_{kind.name}")
        parts = F.transform(
            F.col(f"_found_{kind.name}"),
            lambda head, i: F.struct(
                i.alias("i"),
                F.length(head).alias("head"),
                kind.cut(F.col(f"_wholes_{kind.name}")[i]).alias("match"),
            ),
        )
        return F.transform(
            F.filter(parts, lambda p: p.match.isNotNull()),
            lambda p: F.struct(
                F.lit(kind.name).alias("kind"),
                (stops[p.i] - p.head).alias("start"),
                (stops[p.i] - p.head + F.length(p.match)).alias("end"),
                p.match.alias("match"),
                F.right(gaps[p.i], F.lit(NEAR)).alias("before"),
                F.substr(gaps[p.i + 1], F.length(p.match) - p.head + 1, F.lit(NEAR)).alias("after"),
            ),
        )

    def spans(kind: Kind) -> Column:
        if kind.group:
            rows = F.filter(cut_spans(kind), lambda s: kind.confirm(s))
            return F.coalesce(bound(rows, apart), F.filter(rows, lambda s: F.lit(False)), F.array())
        gaps, stops = F.col(f"_gaps_{kind.name}"), F.col(f"_ends_{kind.name}")
        rows = F.transform(
            F.col(f"_found_{kind.name}"),
            lambda match, i: F.struct(
                F.lit(kind.name).alias("kind"),
                (stops[i] - F.length(match)).alias("start"),
                stops[i].alias("end"),
                match.alias("match"),
                F.right(gaps[i], F.lit(NEAR)).alias("before"),
                F.left(gaps[i + 1], F.lit(NEAR)).alias("after"),
            ),
        )
        good = F.filter(rows, lambda s: kind.confirm(s))
        return F.coalesce(good, F.filter(rows, lambda s: F.lit(False)), F.array())

    return ended.select(*kept, *[spans(kind).alias(kind.name) for kind in kinds])


def listed(spans: Column) -> Column:
    """kind:start:end of each span of an array, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")),
        ),
        ",",
    )


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a short string of digits is right."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")),
        lambda a, c: F.struct(
            (
                a.n
                + F.when(a.at % 2 == 0, c.cast("int"))
                .when(c.cast("int") > 4, c.cast("int") * 2 - 9)
                .otherwise(c.cast("int") * 2)
            ).alias("n"),
            (a.at + 1).alias("at"),
        ),
        lambda a: a.n,
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code of letters and digits leaves 1 when divided by 97."""
    turned = F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4)))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise(
            (r * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return rest == 1
