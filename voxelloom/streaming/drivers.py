"""Structured Streaming: an incremental surfel map as a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.shared import checkpoint
from ..operators import surfel as SU
from ..params import SurfelParams


class SurfelMapStream:
    """Keeps a voxel map of mergeable sums as a versioned table: one version for each micro-batch.

    A batch is reduced to one row per voxel first, then merged with the last version before it by
    key. Batches are numbered, so that one which runs again after a failure overwrites its own
    version; versions are found in the folder, so that a new driver goes on where the last one
    stopped. Versions older than the one that a batch reads are removed after it.
    """

    def __init__(self, spark: SparkSession, path: str, p: SurfelParams = SurfelParams(), prune: str = "batch"):
        self.spark, self.path, self.p, self.prune = spark, path.rstrip("/"), p, prune

    def _table(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def _folder(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def versions(self) -> list[int]:
        """Whole versions in the folder, by number."""
        fs, folder = self._folder()
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: points with normals (x, y, z, nx, ny, nz, w) in the map's frame."""
        new = SU.raw_moments(batch, self.p)
        before = [v for v in self.versions() if v < batch_id]
        merged = SU.merge(self.spark.read.parquet(self._table(before[-1])), new) if before else new
        if self.prune == "batch":
            merged = checkpoint(merged)  # three uses
            keep = SU.shadow_prune(SU.finalise(merged, self.p), self.p).select("vx", "vy", "vz")
            merged = merged.join(keep, ["vx", "vy", "vz"], "left_semi")
        merged.write.mode("overwrite").parquet(self._table(batch_id))
        fs, _ = self._folder()
        for old in before[:-1]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._table(old)), True)

    def start(self, points: DataFrame, checkpoint: str):
        return points.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)

    def surfels(self) -> DataFrame:
        """The latest map with normals and flags."""
        return SU.finalise(self.spark.read.parquet(self._table(self.versions()[-1])), self.p)
