"""Money expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillbook import schema as S


def total(value: Column) -> Column:
    """SUM in the wide money type; NULL over no rows, as SQL has it."""
    return F.sum(value).cast(S.TOTAL)


def total0(value: Column) -> Column:
    """SUM in the wide money type, zero over no rows."""
    return F.coalesce(F.sum(value), F.lit(0)).cast(S.TOTAL)


def units0(value: Column) -> Column:
    """Sum of quantities, zero over no rows."""
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def in_dollars(iqd: Column, rate: Column) -> Column:
    """Second-currency amount in dollars. A zero rate gives NULL, and nothing is worth nothing."""
    converted = F.round(F.try_divide(iqd.cast(S.IQD), rate.cast(S.RATE)), 6).cast("decimal(18,6)")
    return F.when(iqd == 0, F.lit(0).cast("decimal(18,6)")).otherwise(converted)


def to_dollars(usd: Column, iqd: Column, rate: Column) -> Column:
    """Both currencies in dollars; the dollar part is ignored when it is not positive and IQD is.

    At a zero rate only the converted part is unknown: it counts as nothing, and dollars stay.
    """
    converted = F.coalesce(in_dollars(iqd, rate), F.lit(0).cast("decimal(18,6)"))
    return (
        F.when((usd <= 0) & (iqd > 0), converted)
        .otherwise(usd + converted)
        .cast(S.CONVERTED)
    )


def margin() -> Column:
    """Sale price less cost of one unit on a stock row."""
    return F.col("itemPrice") - F.col("costPrice")


def gain() -> Column:
    """Profit of a stock row: outgoing quantities are negative, so the sign turns."""
    return -(F.col("qty") * margin())


def due() -> Column:
    """What is still owed on an invoice; negative when it was overpaid."""
    return (F.col("totalPrice") - (F.col("initialPay") + F.col("totalPay"))).cast(S.MONEY)
