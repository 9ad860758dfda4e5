"""The latest row of every key, kept as a log of batches that stays short.

A batch writes its changed rows into a folder of its own. Which folders count stands in a manifest, a small numbered
file that is written aside and renamed: readers take the highest number and so see a batch whole or not at all. As
soon as ``FANOUT`` folders of one tier have come together, the next batch merges them into one folder of the tier above,
one row a key, in the same step that adds its own; the topmost tier is one folder of all that is older. So there are at most
``(FANOUT - 1) * TIERS + 1`` folders, and as many rows a key.

A batch that is run again, because the stream's own commit was lost, is known by its number and left out. What a run
that was cut short has written is in no manifest, and the next run of the batch replaces it. Folders that the last
two manifests do not name are removed, so whoever reads by the manifest before can finish. One writer at a time.
"""

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.functions.files import Files

FANOUT = 4
TIERS = 3
BATCH, SHARE = "_batch", "_share"


class StateLog:
    """``schema`` is that of the rows; rows are dealt into ``shares`` by a hash of ``keys``."""

    def __init__(
        self, spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType, shares: int = 16
    ):
        self.spark, self.path, self.keys, self.shares = spark, path.rstrip("/"), list(keys), shares
        self.columns = [f.name for f in schema]
        self.schema = T.StructType(
            [*schema, T.StructField(BATCH, T.LongType()), T.StructField(SHARE, T.IntegerType())]
        )
        self.files = Files(spark)

    # Manifests.

    def _numbers(self) -> list[int]:
        names = self.files.names(f"{self.path}/manifests")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_")

    def _manifest(self, number: int | None = None) -> dict:
        """``batch``, the last one held, and ``runs``: folder and tier, oldest first."""
        if number is None:
            numbers = self._numbers()
            if not numbers:
                return {"number": 0, "batch": None, "runs": []}
            number = numbers[-1]
        return json.loads(self.files.read_text(f"{self.path}/manifests/{number:012d}.json"))

    def _switch(self, manifest: dict) -> None:
        aside = f"{self.path}/manifests/_{uuid.uuid4().hex}"
        self.files.write_text(aside, json.dumps(manifest))
        if not self.files.rename(aside, f"{self.path}/manifests/{manifest['number']:012d}.json"):
            raise RuntimeError(f"another writer changed the log at {self.path}")

    def last_batch(self) -> int | None:
        return self._manifest()["batch"]

    def holds(self, number: int) -> bool:
        last = self.last_batch()
        return last is not None and number <= last

    # Rows.

    def _of(self, runs: Sequence[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/{run}" for run in runs]
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/runs").parquet(*paths)

    def _latest(self, rows: DataFrame) -> DataFrame:
        """The row of the last batch for every key."""
        rest = [c for c in [*self.columns, BATCH] if c not in self.keys]
        return (
            rows.groupBy(SHARE, *self.keys)
            .agg(F.max_by(F.struct(*rest), BATCH).alias("_row"))
            .select(*self.keys, "_row.*", SHARE)
        )

    def share_of(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(SHARE, F.pmod(F.xxhash64(*self.keys), F.lit(self.shares)).cast("int"))

    def read(self, shares: Sequence[int] | None = None) -> DataFrame:
        """The latest row of every key, or of the keys of some shares, whose folders alone are read."""
        rows = self._of([run["folder"] for run in self._manifest()["runs"]])
        if shares is not None:
            rows = rows.filter(F.col(SHARE).isin(list(shares)))
        return self._latest(rows).select(*self.columns)

    def append(self, rows: DataFrame, number: int) -> bool:
        """Adds the rows of a batch, one a key at most; tells whether they were not there before.

        Rows of later batches win. Numbers grow from batch to batch.
        """
        manifest = self._manifest()
        if manifest["batch"] is not None and number <= manifest["batch"]:
            return False
        runs = self._with_room(manifest["runs"], number)
        folder = f"runs/run=b{number:012d}"
        added = self.share_of(rows.select(*self.columns).withColumn(BATCH, F.lit(number).cast("bigint")))
        self._write(added.select(*[f.name for f in self.schema]), folder)
        self._switch(
            {
                "number": manifest["number"] + 1,
                "batch": number,
                "runs": [*runs, {"folder": folder, "tier": 0}],
            }
        )
        self._tidy()
        return True

    def _with_room(self, runs: list[dict], number: int) -> list[dict]:
        """The runs after full tiers were merged, lowest first."""
        for tier in range(TIERS + 1):
            full = [r for r in runs if r["tier"] == tier]
            # The topmost tier takes in what comes up.
            if len(full) < (FANOUT if tier < TIERS else 2):
                continue
            above = min(tier + 1, TIERS)
            folder = f"runs/run=m{number:012d}-{tier}"
            self._write(self._latest(self._of([r["folder"] for r in full])), folder)
            # Runs of a tier are next to each other, and older than those of lower tiers.
            place = runs.index(full[0])
            runs = [r for r in runs if r not in full]
            runs.insert(place, {"folder": folder, "tier": above})
        return runs

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.hint("rebalance", SHARE).write.mode("overwrite").partitionBy(SHARE).parquet(f"{self.path}/{folder}")

    def _tidy(self) -> None:
        """Removes what the last two manifests do not name."""
        numbers = self._numbers()
        for old in numbers[:-2]:
            self.files.remove(f"{self.path}/manifests/{old:012d}.json")
        named = {r["folder"] for n in numbers[-2:] for r in self._manifest(n)["runs"]}
        for name in self.files.names(f"{self.path}/runs"):
            if f"runs/{name}" not in named:
                self.files.remove(f"{self.path}/runs/{name}")
