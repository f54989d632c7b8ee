"""Small keyed state written by ``foreachBatch``.

Each micro-batch writes the new version of the keys it touched into its own
folder, so a batch that runs twice overwrites itself and readers see each key's
newest version. Every ``per_generation`` batches one batch writes all keys, which
keeps reads short.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class KeyedState:
    spark: SparkSession
    path: str
    keys: Sequence[str]
    schema: str
    per_generation: int = 50

    def _read(self, generation: int) -> DataFrame | None:
        return self._read_path(f"{self.path}/generation={generation}")

    def _read_path(self, path: str) -> DataFrame | None:
        """The versions there, or None where nothing was written yet; other errors are errors."""
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" in str(err) or "UNABLE_TO_INFER_SCHEMA" in str(err):  # or a first write that failed
                return None
            raise

    def _newest(self, versions: DataFrame) -> DataFrame:
        rest = [c for c in versions.columns if c not in self.keys]
        picked = versions.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*self.keys, "r.*")
        return picked.where("alive").drop("alive", "batch_id")

    def before(self, batch_id: int) -> DataFrame:
        """State as it was before a batch."""
        if batch_id > 0:
            versions = self._read((batch_id - 1) // self.per_generation)
            if versions is not None:
                return self._newest(versions.where(F.col("batch_id") < batch_id))
        return self.spark.createDataFrame([], self.schema)

    def write(self, batch_id: int, touched: DataFrame) -> None:
        """New versions of touched keys; a row with ``alive`` false removes its key."""
        rows = touched if "alive" in touched.columns else touched.withColumn("alive", F.lit(True))
        if batch_id and batch_id % self.per_generation == 0:
            old = self.before(batch_id).join(rows.select(*self.keys), list(self.keys), "left_anti")
            rows = rows.unionByName(old.withColumn("alive", F.lit(True)))
        rows.write.mode("overwrite").parquet(f"{self.path}/generation={batch_id // self.per_generation}/batch_id={batch_id}")

    def latest(self) -> DataFrame:
        """State after the last batch."""
        versions = self._read_path(self.path)
        if versions is None:
            return self.spark.createDataFrame([], self.schema)
        last = versions.agg(F.max("generation")).first()[0]
        return self._newest(versions.where(F.col("generation") == last).drop("generation"))
