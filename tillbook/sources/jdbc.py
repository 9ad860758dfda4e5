"""Reads of a database planned from what its ids are like.

A table is read in parts that hold about equally many rows, whatever gaps the ids have: the database cuts its
ids into tiles of equal size, and the tiles' least ids become disjoint conditions, one read each. A mark, the
highest id read so far, leaves out what is known, and the highest id at the time of planning bounds the read, so a
later one goes on exactly where this one ended.
"""

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tillbook import schema as S
from tillbook.sources.tables import STORED_AS, Tables, columns_of, conformed


@dataclass(frozen=True)
class Plan:
    """``bounds`` are the least ids of all parts but the first, ascending.

    ``after`` is the last id that is known already, ``upto`` the last one to read; None sets no limit.
    """

    column: str
    bounds: tuple[int, ...] = ()
    after: int | None = None
    upto: int | None = None

    def conditions(self) -> list[str]:
        """Disjoint conditions that together hold every row wanted once.

        Rows without id belong to the first part of a read that is not bounded from below.
        """
        inner = [b for b in sorted(set(self.bounds)) if self._inside(b)]
        lows, highs = [None, *inner], [*inner, None]
        return [self._condition(low, high) for low, high in zip(lows, highs)]

    def _inside(self, bound: int) -> bool:
        above = self.after is None or bound > self.after + 1
        return above and (self.upto is None or bound <= self.upto)

    def _condition(self, low: int | None, high: int | None) -> str:
        parts = []
        if low is not None:
            parts.append(f"{self.column} >= {low}")
        elif self.after is not None:
            parts.append(f"{self.column} > {self.after}")
        if high is not None:
            parts.append(f"{self.column} < {high}")
        elif self.upto is not None:
            parts.append(f"{self.column} <= {self.upto}")
        if low is None and self.after is None:
            whole = " and ".join(parts)
            return f"({whole}) or {self.column} is null" if parts else "1 = 1"
        return " and ".join(parts) or "1 = 1"


def tiles_query(table: str, column: str, parts: int, after: int | None = None) -> str:
    """The subquery that cuts the ids of a table into tiles: ``tile``, ``low``, ``high``, ``n``."""
    known = "" if after is None else f" where {column} > {after}"
    return (
        f"(select tile, min({column}) low, max({column}) high, count(*) n from "
        f"(select {column}, ntile({parts}) over (order by {column}) tile from {table}{known}) ids "
        "group by tile) tiles"
    )


def plan_of(tiles: Sequence[tuple[int, int | None, int | None]], column: str, after: int | None = None) -> Plan:
    """A plan from rows (tile, low, high); without rows nothing is to be read after the mark."""
    known = sorted((low, high) for _, low, high in tiles if low is not None)
    if not known:
        return Plan(column, (), after, after)
    return Plan(column, tuple(low for low, _ in known[1:]), after, max(high for _, high in known))


def planned(
    spark: SparkSession, url: str, properties: Mapping[str, str], table: str, column: str, parts: int,
    after: int | None = None,
) -> Plan:
    """Asks the database for the tiles of a table, as many rows as there are parts."""
    rows = spark.read.jdbc(url, tiles_query(table, column, parts, after), properties=dict(properties))
    return plan_of([(r["tile"], r["low"], r["high"]) for r in rows.collect()], column, after)


def selected(name: str, table: str, absent: Collection[str] = ()) -> str:
    """The subquery that asks for the declared columns of a table and no others."""
    wanted = [STORED_AS.get(c, c) for c in columns_of(name) if c not in absent]
    return f"(select {', '.join(f'`{c}`' for c in wanted)} from {table}) {name}"


def from_planned_jdbc(
    spark: SparkSession, url: str, properties: Mapping[str, str], plans: Mapping[str, Plan],
    prefix: str = "tbl_", absent: Mapping[str, Collection[str]] | None = None,
) -> Tables:
    """Tables in a database, those with a plan in as many parts as it has conditions.

    The database is asked for the declared columns alone, and one it does not have is an error that names it;
    ``absent`` lists, by table, those that are known to be missing and become NULL.
    """

    def reader(name: str) -> Callable[[Tables], DataFrame]:
        missing = (absent or {}).get(name, ())

        def load(_: Tables) -> DataFrame:
            source = selected(name, f"{prefix}{name}", missing)
            more = {"predicates": plans[name].conditions()} if name in plans else {}
            rows = spark.read.jdbc(url, source, properties=dict(properties), **more)
            return conformed(rows, name, absent=missing)

        return load

    return Tables({name: reader(name) for name in S.TABLES})
