"""URL filters: pattern rules, each found by its rarest literal token.

Of the literal tokens that any URL matching a rule must have, the one that the fewest pages
have indexes the rule. The tokens of a URL fetch the rules entered under them, and only these run
their regular expressions.
"""

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.text import lower_ascii, only, whole

URL = "(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A pattern over host and path together, and literal tokens that whatever it matches must have.

    Tokens are runs of a-z and 0-9 of the lower-cased URL. Of several rules that match, one of
    higher ``rank`` wins, and among equals the one with the longer name.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits a host and its subdomains where the path starts as given."""
    name = host + path
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    # The last run of a path may go on in the URL, so it is no whole token.
    sure = host if path.rstrip("/") == "" or path[-1].isalnum() else name
    return Rule(name, verdict, pattern, tuple(re.findall("[a-z0-9]+", sure.lower())), 1)


def word_rule(verdict: str, word: str) -> Rule:
    """Fits URLs that have the word by itself."""
    pattern = rf"(?i)(?:^|[^a-z0-9]){re.escape(word)}(?:[^a-z0-9]|$)"
    return Rule(f"*{word}*", verdict, pattern, (word,))


# The rules to apply.
RULES = (
    prefix_rule("block", "net", "/"),
    prefix_rule("allow", "example.net", "/en/"),
    prefix_rule("block", "example.com", "/de/"),
    prefix_rule("allow", "org", "/fr/"),
    *[word_rule("block", w) for w in ("spam", "adult", "casino", "porn", "login", "signin", "checkout")],
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path of a URL; both empty without ``://``."""
    return lower_ascii(F.regexp_extract(url, URL, 1)), F.regexp_extract(url, URL, 2)


def url_filter(
    pages: DataFrame, rules: Sequence[Rule] = RULES, otherwise: str = "allow"
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``matched``.

    ``matched`` names the rule that decided, ``rule`` only if it is a host and path rule. A NULL URL
    has no parts and gets the verdict ``otherwise``. A row repeated in full comes once.
    """
    spark = pages.sparkSession
    host, path = parts(whole("url"))
    split = only(pages, "page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"))
    place = F.concat("host", "path")
    tokens = F.array_distinct(F.array_remove(F.split(lower_ascii(place), "[^a-z0-9]+"), ""))
    keyed = split.select("page_id", "url", "host", "path", tokens.alias("tokens"))
    counts = keyed.select(F.explode("tokens").alias("token")).groupBy("token").count()
    given = spark.createDataFrame(
        [(r.name, r.verdict, r.pattern, list(r.tokens), r.rank) for r in rules],
        "name string, rule_verdict string, pattern string, tokens array<string>, rank int",
    )
    # The rules are a parameter: as many as the caller holds in memory, whatever the pages.
    index = (
        given.select("*", F.explode("tokens").alias("token"))
        .join(counts, "token", "left")
        .groupBy("name", "rule_verdict", "pattern", "rank")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("r"))
        .select("name", "rule_verdict", "pattern", "rank", F.col("r.token").alias("token"))
    )
    fetched = keyed.withColumn("token", F.explode_outer("tokens")).join(
        F.broadcast(index), "token", "left"
    )
    fits = F.when(
        F.rlike(place, F.col("pattern")),
        F.struct(
            "rank", F.length("name").alias("length"), "name", F.col("rule_verdict").alias("verdict")
        ),
    )
    return (
        fetched.groupBy("page_id", "url", "host", "path")
        .agg(F.max(fits).alias("best"))
        .select(
            "page_id",
            "host",
            "path",
            F.when(F.col("best.rank") == 1, F.col("best.name")).alias("rule"),
            F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
            F.col("best.name").alias("matched"),
        )
    )
