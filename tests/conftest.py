import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import check  # noqa: E402
from tillbook import schema as S  # noqa: E402
from tillbook.session import ready  # noqa: E402
from tillbook.sources.tables import Tables  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = ready(check.session())
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return session


def when(day: str) -> dt.datetime:
    return dt.datetime.fromisoformat(day)


def frame(spark, name: str, rows: list[dict]):
    """A shop table from the given values; columns not named are NULL."""
    schema = spark.createDataFrame([], S.TABLES[name]).schema
    numbers = {f.name for f in schema if f.dataType.typeName() == "decimal"}

    def value(row, column):
        given = row.get(column)
        return Decimal(str(given)) if column in numbers and given is not None else given

    return spark.createDataFrame([tuple(value(r, f.name) for f in schema) for r in rows], schema)


@pytest.fixture
def shop(spark):
    """Builds tables from dicts of rows; tables not given are empty."""

    def build(**tables: list[dict]) -> Tables:
        return Tables({name: frame(spark, name, tables.get(name, [])) for name in S.TABLES})

    return build


def dicts(df) -> list[dict]:
    return [row.asDict(recursive=True) for row in df.collect()]
