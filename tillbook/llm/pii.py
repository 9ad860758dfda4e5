"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.spans import Kind, bound, digits_of, find, listed, luhn, mod97
from tillbook.llm.text import only, whole

LOCAL = "A-Za-z0-9._%+-"
SHORTEST_IBAN = 15
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _always(span: Column) -> Column:
    return F.lit(True)


def _alone(span: Column) -> Column:
    """Letters or digits do not go on to the left or right of the match."""
    return ~span.before.rlike("[A-Za-z0-9-]$") & ~span.after.rlike("^[A-Za-z0-9-]")


def _account(candidate: Column) -> Column:
    """The candidate cut back group by group to the longest that passes its checksum, or NULL.

    Words or numbers in capitals that follow an account code look like further groups of it.
    """

    def longest(groups: Column) -> Column:
        whole_first = F.transform(
            F.sequence(F.size(groups), F.lit(1)), lambda n: F.slice(groups, 1, n)
        )
        good = F.filter(
            whole_first,
            lambda g, i: ((i == 0) | (F.length(F.array_join(g, "")) >= SHORTEST_IBAN))
            & mod97(F.array_join(g, "")),
        )
        return F.array_join(F.get(good, F.lit(0)), " ")

    return bound(F.split(candidate, " "), longest)


# A match of the first pattern starts where its run of characters does, or where the last
# match ended; to try later places of the same run could find nothing.
BASE = (
    Kind(
        "email",
        rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        _always,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
        lambda s: s.match.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"),
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9](?:[\x20-]?[0-9]){15}",
        lambda s: F.length(digits_of(s.match)).between(16, 19) & luhn(digits_of(s.match)),
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"\+[0-9]",
        lambda s: F.length(digits_of(s.match)).between(8, 15),
    ),
)
MORE = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9-])(?=([A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}"
        r"|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9-])))[A-Z]{2}[0-9]{2}",
        r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{8}",
        _always,
        group=1,
        cut=_account,
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        _alone,
    ),
)


@dataclass(frozen=True)
class Scoring:
    """Points a kind starts with, a checksum or a word nearby adds, and those needed to report.

    Spans of the base kinds are reported whatever their score.
    """

    starts: tuple[tuple[str, int], ...] = (
        ("email", 70), ("ip", 50), ("card", 40), ("phone", 50), ("iban", 40), ("ssn", 30),
    )
    checked: tuple[str, ...] = ("card", "iban")
    checksum: int = 30
    context: int = 20
    needed: int = 50


# Words that speak for a kind, looked for in lower case on both sides of a match.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|credit|visa|pay",
    "phone": "phone|tel|call|fax|mobile",
    "iban": "iban|bank|account|bic",
    "ssn": "ssn|social|security",
}


def scored(kind: str, spans: Column, scoring: Scoring) -> Column:
    """The spans with ``score``, without the texts around them."""
    word = rf"(?:^|[^a-z])(?:{CONTEXT[kind]})"
    points = dict(scoring.starts)[kind] + scoring.checksum * (kind in scoring.checked)
    return F.transform(
        spans,
        lambda s: F.struct(
            s.kind.alias("kind"),
            s.start.alias("start"),
            s.end.alias("end"),
            s.match.alias("match"),
            (
                F.when(F.lower(F.concat(s.before, F.lit(" "), s.after)).rlike(word), scoring.context)
                .otherwise(0)
                + points
            ).alias("score"),
        ),
    )


def personal_data(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), scoring: Scoring = Scoring()
) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, counts, and all spans with scores.

    ``base`` and ``found`` are arrays of (kind, start, end, match, score): the spans of the
    base kinds, and these with the further ones. Matches of one kind never overlap; spans
    of different kinds may. A NULL text counts as empty. Repeated rows give repeated rows.
    """
    kinds = [kind.name for kind in (*BASE, *MORE)]
    docs = only(docs, *dict.fromkeys([*keep, "text"]))
    located = find(docs, keep, whole(), (*BASE, *MORE))
    rated = located.select(*keep, *[scored(k, F.col(k), scoring).alias(k) for k in kinds])
    enough = [F.filter(k.name, lambda s: s.score >= scoring.needed) for k in MORE]
    base = [F.col(k.name) for k in BASE]
    return rated.select(
        *keep,
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE],
        F.concat(*base).alias("base"),
        F.concat(*base, *enough).alias("found"),
    )


def spans_report(docs: DataFrame) -> DataFrame:
    """Counts, a digest of the base spans, and all spans and scores as text, per row."""
    return personal_data(docs).select(
        "doc_id",
        *[f"n_{kind.name}" for kind in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: s.score.cast("string")), ",").alias("scores"),
    )
