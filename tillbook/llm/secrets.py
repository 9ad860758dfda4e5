"""Secrets: sure patterns, and weak parts of a credential that count only together.

An access identifier, a secret and an endpoint are often written near each other. Each is
weak by itself: a long run of letters and digits is mostly no secret, and a host name never
is. The weak parts of a text are put in order of their place, and each is joined with those
within ``reach`` characters of it; a part is reported only if a complementary one is there.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.spans import Kind, bound, find, listed
from tillbook.llm.text import only, whole

KEYS = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
)
ASSIGN = KEYS + r"[\"']?\x20*[:=]\x20*[\"']?"
BASE = (
    Kind(
        "assign",
        ASSIGN + r"[A-Za-z0-9+/_.=-]+",
        r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk]",
        lambda s: F.length(F.regexp_extract(s.match, f"^{ASSIGN}(.*)$", 1)) >= 6,
    ),
    Kind("access", r"AKIA[A-Z0-9]++", "AKIA", lambda s: F.length(s.match) >= 20),
    # A run that is too short for the kind is dropped anyway, so it need not be found.
    Kind("hex", r"[0-9a-f]{24,}+", r"[0-9a-f]{24}", lambda s: F.lit(True)),
)
# In either case, as configuration has them: DB_USER, userName, CLIENT_ID, AWS_ACCESS_KEY_ID.
NAMES = (
    r"(?i:(?:user|login|(?:client|account)[_-]?(?:id|name)|access[_-]?key)(?:[_-]?(?:id|name))?)"
    r"[\"']?\x20*[:=]"
)
WEAK = (
    Kind(
        "user",
        NAMES + r"\x20*[\"']?[A-Za-z0-9@._-]+",
        NAMES,
        lambda s: F.length(s.match) >= 8,
    ),
    Kind(
        "blob",
        r"[A-Za-z0-9+/_-]{20,}+",
        r"[A-Za-z0-9+/_-]{20}",
        lambda s: s.match.rlike("[a-z]") & s.match.rlike("[A-Z]") & s.match.rlike("[0-9]"),
    ),
    Kind(
        "endpoint",
        r"(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp|s3)://[A-Za-z0-9@:._/-]+",
        r"(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp|s3)://[A-Za-z0-9]",
        lambda s: F.length(s.match) >= 10,
    ),
)
# Fixed roles: what each kind is part of a credential as.
ROLES = {
    "access": "identifier", "user": "identifier", "assign": "secret", "hex": "secret",
    "blob": "secret", "endpoint": "endpoint",
}
ORDER = [kind.name for kind in (*BASE, *WEAK)]
# The shortest part of each of the six kinds is eight characters long.
SHORTEST, KINDS = 8, 6


def by_place(spans: Column) -> Column:
    """Spans in order of their start, then of their kind as listed."""
    rank = F.array(*[F.lit(k) for k in ORDER])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s.start.alias("start"),
            F.array_position(rank, s.kind).alias("rank"),
            s.end.alias("end"),
            s.kind.alias("kind"),
            s.match.alias("match"),
        ),
    )
    return F.array_sort(keyed)


def linked(spans: Column, reach: int) -> Column:
    """All strong spans, and the weak ones with a complementary part within ``reach``.

    A weak secret needs an identifier or an endpoint, a weak identifier or an endpoint needs a
    secret. ``spans`` are in order of place. Spans of one kind do not overlap, so
    all that start within ``reach`` of a span stand within a fixed number of places of it,
    and the join looks at these only.
    """
    strong = [kind.name for kind in BASE]
    places = KINDS * (reach // SHORTEST + 2)
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])

    def partner(all_spans: Column, s: Column, i: Column) -> Column:
        near = F.slice(all_spans, F.greatest(i + 1 - places, F.lit(1)), 2 * places + 1)
        return F.exists(
            near,
            lambda o: (F.abs(o.start - s.start) <= reach)
            & ((o.start >= s.end) | (o.end <= s.start))
            & ((role[o.kind] == "secret") != (role[s.kind] == "secret")),
        )

    return bound(
        spans,
        lambda all_spans: F.filter(
            all_spans, lambda s, i: s.kind.isin(strong) | partner(all_spans, s, i)
        ),
    )


def secrets(docs: DataFrame, keep: Sequence[str] = ("doc_id",), reach: int = 200) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, counts, and all spans reported.

    ``base`` and ``found`` are arrays of (start, rank, end, kind, match) in order of start. A
    NULL text counts as empty. Repeated rows give repeated rows.
    """
    docs = only(docs, *dict.fromkeys([*keep, "text"]))
    located = find(docs, keep, whole(), (*BASE, *WEAK))
    ordered = located.select(
        *keep,
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE],
        by_place(F.concat(*[F.col(k.name) for k in BASE])).alias("base"),
        by_place(F.concat(*[F.col(k) for k in ORDER])).alias("_all"),
    )
    return ordered.withColumn("found", linked(F.col("_all"), reach)).drop("_all")


def secrets_report(docs: DataFrame) -> DataFrame:
    """Counts, a digest of the base spans, and all spans as text, per row."""
    return secrets(docs).select(
        "doc_id",
        *[f"n_{kind.name}" for kind in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )
