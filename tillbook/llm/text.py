"""Word expressions shared by the text operators."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole(text: str = "text") -> Column:
    """The text, empty for NULL."""
    return F.coalesce(F.col(text), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    In a text of one-byte characters that is what ``lower`` does, and quickly.
    """
    letter_by_letter = reduce(
        lambda t, c: F.replace(t, F.lit(c), F.lit(c.lower())), UPPER, text
    )
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(letter_by_letter)


def without(text: Column, characters: str) -> Column:
    """The text with all the given characters taken out."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def words(text: Column) -> Column:
    """Maximal runs of characters that are no blanks, in order.

    All blanks become spaces first, as a split at one plain character needs no pattern.
    """
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), BLANKS[1:], text)
    return F.array_remove(F.split(spaced, " "), "")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns under exactly these names, NULL where the input lacks one.

    Further columns of the input, whatever their names, are left behind.
    """
    present = {c.lower(): c for c in df.columns}
    return df.select(
        *[
            (F.col(f"`{present[c.lower()]}`") if c.lower() in present else F.lit(None)).alias(c)
            for c in columns
        ]
    )
