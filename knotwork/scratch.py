"""Intermediate tables in the folder that all executors share.

A lineage is cut by writing a table and reading it again: it survives the loss of any executor, is
columnar and compressed, and later stages read only the columns they need.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where nothing is set a folder of our own, on one machine only: on a cluster it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="knotwork-")
    return _own[app]


class Scratch:
    """Tables of one computation. release() drops some of them early; the rest goes at the end of the process."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/knotwork-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._at: dict[int, str] = {}
        atexit.register(self._clean)

    def cut(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._at[id(out)] = path
        self._keep = [*getattr(self, "_keep", []), out]
        # the shuffles behind a written table are free from here on; without a collection they would lie on disk until the driver's next one
        self.spark._jvm.System.gc()
        return out

    def release(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            if df is not None and (path := self._at.pop(id(df), None)):
                self._remove(path)

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _clean(self) -> None:
        try:
            if self.spark._jsc.sc().isStopped():
                return
            self._remove(self.root)
        except Exception:  # the session is gone; the cluster's own cleaning has the folder then
            pass
