"""Snapshots of what a ``foreachBatch`` query carries from epoch to epoch.

An epoch's snapshot is a folder of its own (``rows`` and, written last, ``meta``),
complete in itself, so older ones can go: the newest ``keep`` stay.  Two are
enough, since only the last epoch can be replayed, and it starts from the one
before.  A folder without ``meta`` (the writer died) does not count.  The number of
files thus does not depend on the number of epochs.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from logvigil.functions import files
from logvigil.operators.iforest import MISSING_PATH


class StateLog:
    def __init__(self, path: str, keep: int = 2):
        if keep < 2:
            raise ValueError("a replayed epoch needs the snapshot before its own: keep at least 2")
        self.path, self.keep = path, keep

    def _at(self, epoch: int) -> str:
        return f"{self.path}/{epoch:020d}"

    def epochs(self, spark: SparkSession) -> list[int]:
        """Epochs with a folder, the newest first."""
        return sorted((int(n) for n in files.names(spark, self.path) if n.isdigit()), reverse=True)

    def before(self, spark: SparkSession, epoch: int) -> tuple[DataFrame | None, dict]:
        """(carried rows, meta) of the newest complete snapshot before ``epoch``."""
        for e in self.epochs(spark):
            if e >= epoch:
                continue
            try:
                meta = spark.read.parquet(f"{self._at(e)}/meta").first()
            except AnalysisException as err:
                if err.getCondition() not in MISSING_PATH:
                    raise
                continue
            if meta is not None:
                return spark.read.parquet(f"{self._at(e)}/rows"), json.loads(meta["meta"])
        return None, {}

    def write(self, epoch: int, rows: DataFrame, meta: dict) -> None:
        """Write the snapshot of ``epoch`` (a replay replaces its own), then drop
        those beyond the newest ``keep``."""
        spark = rows.sparkSession
        files.remove(spark, self._at(epoch))
        rows.write.parquet(f"{self._at(epoch)}/rows")
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1) \
            .write.parquet(f"{self._at(epoch)}/meta")
        for e in [e for e in self.epochs(spark) if e <= epoch][self.keep:]:
            files.remove(spark, self._at(e))
