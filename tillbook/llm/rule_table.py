"""URL rules from a table, thousands of them, each tried only on the URLs that have its rarest literal.

A rule is a pattern over host and path, without regard to A-Z or a-z. Its characters stand for themselves, but for

- ``*``, any run of characters, none included;
- ``^``, a character other than a letter, a digit and ``_ . % -``, or the end;
- ``||`` at the front, the start of the host or of any of its parent domains;
- ``|`` at the front or the end, the start or the end of host and path.

A literal run of a-z and 0-9 is a sure token where the pattern says that it cannot go on to either side: such
a token is one of a matching URL's own. Every rule is entered under the sure token that the fewest pages have. A rule without
one is entered under the rarest triple of letters of its literal runs, and if no run is that long, under
nothing, and tried on all URLs. Tokens and triples of a URL fetch their rules by an equality join, and only
these run their regular expression.

Of several rules that match, one of higher ``rank`` wins, then the longer pattern, then the later by name,
then ``block``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.shared import stored
from tillbook.llm.text import lower_ascii, only, whole
from tillbook.llm.urls import parts

SEPARATOR = "(?:[^a-z0-9_.%-]|$)"
TRIPLE = 3
# A key no token can be.
ALL = "*"


def compiled(rules: DataFrame) -> DataFrame:
    """``name``, ``rule_verdict``, ``rank``, ``pattern`` in small letters, its ``regex``, ``sure`` tokens and ``triples``.

    Without name a rule is called by its pattern, without rank it has 0. Rules without pattern or verdict, and patterns of
    ``*`` and anchors alone, are no rules.
    """
    given = only(rules, "name", "verdict", "pattern", "rank").select(
        F.coalesce(F.col("name").cast("string"), F.col("pattern").cast("string")).alias("name"),
        F.col("verdict").cast("string").alias("rule_verdict"),
        F.coalesce(F.col("rank").cast("int"), F.lit(0)).alias("rank"),
        lower_ascii(F.col("pattern").cast("string")).alias("pattern"),
    )
    rows = given.filter(F.col("rule_verdict").isNotNull() & F.col("pattern").rlike("[^*|]")).distinct()
    host = F.startswith("pattern", F.lit("||"))
    start = ~host & F.startswith("pattern", F.lit("|"))
    end = F.endswith("pattern", F.lit("|"))
    body = F.regexp_replace("pattern", r"(?s)^\|{1,2}|\|$", "")
    letters = F.filter(F.split("_body", ""), lambda c: c != "")
    # Between \\Q and \\E a character means nothing but itself.
    coded = F.transform(
        letters,
        lambda c: F.when(c == "*", "(?s:.*)").when(c == "^", SEPARATOR).otherwise(F.concat(F.lit("\\Q"), c, F.lit("\\E"))),
    )
    front = F.when(host, r"^(?:[^/]*\.)?").when(start, "^").otherwise("")
    regex = F.concat(front, F.array_join(coded, ""), F.when(end, "$").otherwise(""))
    # Where a run cannot go on: at an anchor, or next to a literal that is no letter and no star.
    framed = F.concat(F.when(host | start, "|").otherwise("*"), F.col("_body"), F.when(end, "|").otherwise("*"))
    sure = F.regexp_extract_all(framed, F.lit(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), F.lit(1))
    runs = F.regexp_extract_all(F.col("_body"), F.lit("([a-z0-9]+)"), F.lit(1))
    return rows.withColumn("_body", body).select(
        "name", "rule_verdict", "rank", "pattern", regex.alias("regex"),
        F.array_distinct(sure).alias("sure"),
        F.array_distinct(F.flatten(F.transform(runs, triples_of))).alias("triples"),
    )


def triples_of(run: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(run) - (TRIPLE - 1), F.lit(1)))
    cut = F.transform(starts, lambda at: F.substr(run, at, F.lit(TRIPLE)))
    return F.when(F.length(run) >= TRIPLE, cut).otherwise(F.array().cast("array<string>"))


def keys_of(place: Column) -> tuple[Column, Column]:
    """Tokens and triples of a lower-cased URL."""
    tokens = F.array_distinct(F.regexp_extract_all(place, F.lit("([a-z0-9]+)"), F.lit(1)))
    return tokens, F.array_distinct(F.flatten(F.transform(tokens, triples_of)))


def rule_candidates(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Every page's URL with each rule to try on it: ``_page``, ``place`` and the rule's columns.

    The rules are written once; tokens that no rule has are dropped before they are counted.
    """
    known = stored(compiled(rules))
    asked = known.select(
        "*",
        F.explode(
            F.when(F.size("sure") > 0, F.transform("sure", lambda x: F.concat(F.lit("t:"), x)))
            .when(F.size("triples") > 0, F.transform("triples", lambda x: F.concat(F.lit("3:"), x)))
            .otherwise(F.array(F.lit(ALL)))
        ).alias("key"),
    )
    tokens, triples = keys_of(F.col("place"))
    keys = F.concat(
        F.transform(tokens, lambda x: F.concat(F.lit("t:"), x)),
        F.transform(triples, lambda x: F.concat(F.lit("3:"), x)),
        F.array(F.lit(ALL)),
    )
    keyed = pages.select("_page", "place", F.explode(keys).alias("key")).join(
        asked.select("key").distinct(), "key", "left_semi"
    )
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # A key no page has finds nothing, and then the rule matches nothing.
    index = (
        asked.join(counts, "key", "left")
        .groupBy("name", "rule_verdict", "rank", "pattern", "regex")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("_r"))
        .filter(F.col("_r.n") > 0)
        .select("name", "rule_verdict", "rank", "pattern", "regex", F.col("_r.key").alias("key"))
    )
    return keyed.join(index, "key").drop("key")


def filter_by_rules(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """One row per distinct page and URL: ``page_id``, ``url``, ``host``, ``path``, ``rule``, ``verdict``, ``n_tried``.

    ``rule`` names the one that decided, ``n_tried`` counts the rules whose expression was run. A NULL URL has no
    parts: rules that match nothing at all may still fit it. Rows repeated in full come once.
    """
    host, path = parts(whole("url"))
    rows = (
        only(pages, "page_id", "url")
        .select("page_id", F.col("url").cast("string").alias("url"))
        .distinct()
        .withColumns({"host": host, "path": path})
        .withColumn("_page", F.struct("page_id", "url"))
    )
    places = rows.select("_page", lower_ascii(F.concat("host", "path")).alias("place"))
    tried = rule_candidates(places, rules)
    block = F.when(F.col("rule_verdict") == "block", 1).otherwise(0)
    fits = F.when(
        F.rlike("place", F.col("regex")),
        F.struct("rank", F.length("pattern").alias("length"), "name", block.alias("block"), "rule_verdict"),
    )
    best = tried.groupBy("_page").agg(F.max(fits).alias("_best"), F.count(F.lit(1)).alias("n_tried"))
    same = F.col("r._page").eqNullSafe(F.col("b._page"))
    return rows.alias("r").join(best.alias("b"), same, "left").select(
        "r.page_id", "r.url", "r.host", "r.path",
        F.col("b._best.name").alias("rule"),
        F.coalesce("b._best.rule_verdict", F.lit(otherwise)).alias("verdict"),
        F.coalesce("b.n_tried", F.lit(0)).cast("long").alias("n_tried"),
    )
