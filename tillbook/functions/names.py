"""Names as join keys, and comma lists of ids."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def name_key(name: Column) -> Column:
    """Partner names are compared without regard to case or outer blanks."""
    return F.lower(F.trim(name))


def id_array(ids: Column) -> Column:
    """'5,6' -> ['5', '6']; an empty or missing list gives an empty array."""
    text = F.coalesce(ids, F.lit(""))
    return F.filter(
        F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""
    )


def id_list(ids: Column) -> Column:
    """Array back to a comma list; an empty one becomes NULL."""
    return F.when(F.size(ids) > 0, F.concat_ws(",", ids))


def without_id(ids: Column, gone: Column) -> Column:
    """A comma list with one id taken out."""
    return id_list(F.array_remove(id_array(ids), gone.cast("string")))


def explode_ids(df: DataFrame, column: str, alias: str) -> DataFrame:
    """One row per listed id, as bigint; rows without ids drop out."""
    return df.withColumn(alias, F.explode(id_array(F.col(column)))).withColumn(
        alias, F.col(alias).cast("bigint")
    )
