"""The folder all executors can reach, for checkpoints and stream output."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: as set on the context, else by ``spark.checkpoint.dir``.

    Only a local session without either gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="tillbook-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back, which cuts the lineage.

    Lost executors can always read the files again, and what was chosen once, like
    the borders of a range partitioning, stays as it was.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "stored")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
