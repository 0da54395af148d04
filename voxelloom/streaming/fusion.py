"""A stream of frames fused into tangent-plane surfels, with an accumulator.

A micro-batch is one step: its points associate with the surfels that the batch before left
(snapshot mode); those that do are fused, the others wait in the accumulator, which keeps the newest
`accumulator` points first in, first out. Whenever the count of frames passes a multiple of
FRAMES, the accumulator is run: coherent cells fuse into a surfel that is there or start a new
one, and their points leave it.

State is a table of versions in two slots: batch b reads slot (b - 1) % 2 and writes slot b % 2, so a
batch that runs again after a failure starts from the same state, nothing has to be deleted, and a
new driver goes on from the last batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions.shared import checkpoint
from ..operators import fusion2d as FU
from ..operators.voxel import KEY, with_key
from ..params import FusionParams

#: Frames between two runs of the accumulator.
FRAMES = 5
WAITING = "point_id long, stamp long, x double, y double, z double, pnx double, pny double, pnz double"
META = "version long, frames long, runs long, next_idx long, late long"


def valid_points(points: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """B1: points(point_id, stamp, x.., pnx..) that are finite with a normal of min_normal at least."""
    at, n = L.vec(), L.vec("pn")
    return points.where(L.finite(*at, *n) & (L.dot(n, n) >= p.min_normal**2)).select(*[c.split()[0] for c in WAITING.split(", ")])


def waiting_points(points: DataFrame, p: FusionParams = FusionParams()) -> DataFrame:
    """The newest points of the accumulator: the oldest leave first when it is full."""
    return points.orderBy(F.col("stamp").desc(), F.col("point_id").desc()).limit(p.accumulator)


def coherent(waiting: DataFrame, p: FusionParams = FusionParams()) -> tuple[DataFrame, DataFrame]:
    """The coherent cells (seed_id, gx, gy, gz, c*, n*) of the waiting points, and each point with its seed_id or null.

    Numbers follow the cells' order; there are at most accumulator / min_cluster cells, so one task
    numbers them.
    """
    g = ["gx", "gy", "gz"]
    number = F.row_number().over(Window.orderBy(*g)).cast("long")
    seeds = FU.clusters(waiting, p).withColumn("seed_id", number).select("seed_id", *g, *FU.C, "nx", "ny", "nz")
    points = with_key(waiting, 2 * p.coherence, keys=("gx", "gy", "gz")).join(seeds.select("seed_id", *g), g, "left").drop(*g)
    return seeds, points


def run_accumulator(waiting: DataFrame, surfels: DataFrame, stamp: int, next_idx: int, p: FusionParams = FusionParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(updated surfels, new surfels, points that stay) of one run over the waiting points.

    A seed with a surfel to merge with (B16) has its points fused into that; else it starts a new
    surfel (B7) with the next free index, unless its voxel already has per_voxel surfels: then it is
    rejected, as a new surfel is weaker than all that stay. The points of all seeds leave.
    """
    seeds, points = coherent(waiting, p)
    seeds, points = checkpoint(seeds), checkpoint(points)
    found = FU.merge_targets(seeds, FU.confidence(surfels, p), p).select("seed_id", "idx")
    targets = points.join(found.where("idx is not null"), "seed_id").withColumn("stamp", F.lit(stamp).cast("long"))
    updated = FU.fuse_all(targets, surfels, p)
    new = with_key(seeds.join(found.where("idx is null").select("seed_id"), "seed_id"), p.voxel, FU.C)
    held = with_key(surfels, p.voxel, FU.C).groupBy(*KEY).agg(F.count("*").alias("held"))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("seed_id"))
    new = new.join(held, KEY, "left").where(F.coalesce("held", F.lit(0)) < p.per_voxel).withColumn("place", rank + F.coalesce("held", F.lit(0)))
    new = new.where(F.col("place") <= p.per_voxel)
    spread = F.lit(p.init_radius**2)
    start = {"idx": F.lit(next_idx).cast("long") + F.col("seed_id"), "l0": spread, "l1": spread, "point_count": F.lit(1).cast("long"), "observations": F.lit(1).cast("long"), "total_weight": F.lit(1.0), "sum_sq": F.lit(0.0), "stamp": F.lit(stamp).cast("long")}
    start |= {f"sum_n{a}": F.col(f"n{a}") for a in "xyz"} | {c: F.lit(0.0) for c in FU.STATE} | {"cov_uu": spread, "cov_vv": spread}
    new = new.withColumns(start).select(*FU.KEPT)
    return updated, new, points.where("seed_id is null").drop("seed_id")


class FusionStream:
    """For foreachBatch: points(point_id, stamp, x, y, z, pnx, pny, pnz) in the map's frame; a frame is a stamp."""

    def __init__(self, spark: SparkSession, path: str, p: FusionParams = FusionParams()):
        self.spark, self.path, self.p = spark, path.rstrip("/"), p

    def _slot(self, version: int, what: str) -> str:
        return f"{self.path}/slot={version % 2}/{what}"

    def _meta(self, version: int):
        """The counters of a version, or None where that version isn't there."""
        try:
            rows = self.spark.read.schema(META).parquet(self._slot(version, "meta")).where(F.col("version") == version).collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return rows[0] if rows else None

    def _read(self, version: int) -> tuple[DataFrame, DataFrame, dict]:
        meta = self._meta(version) if version >= 0 else None
        if meta is None:
            if version >= 0:
                raise ValueError(f"the state of batch {version} isn't at {self.path}")
            return self.spark.createDataFrame([], FU.FUSED), self.spark.createDataFrame([], WAITING), {"frames": 0, "runs": 0, "next_idx": 0, "late": 0}
        tables = [self.spark.read.schema(s).parquet(self._slot(version, w)) for w, s in (("surfels", FU.FUSED), ("waiting", WAITING))]
        return tables[0], tables[1], {k: meta[k] for k in ("frames", "runs", "next_idx", "late")}

    def _write(self, version: int, surfels: DataFrame, waiting: DataFrame, counters: dict) -> None:
        """The counters come last: a version is there once they are."""
        surfels.select(*FU.KEPT).write.mode("overwrite").parquet(self._slot(version, "surfels"))
        waiting.write.mode("overwrite").parquet(self._slot(version, "waiting"))
        row = (version, *[int(counters[k]) for k in ("frames", "runs", "next_idx", "late")])
        self.spark.createDataFrame([row], META).coalesce(1).write.mode("overwrite").parquet(self._slot(version, "meta"))

    def _run(self, surfels: DataFrame, waiting: DataFrame, stamp: int, c: dict) -> tuple[DataFrame, DataFrame]:
        updated, new, rest = run_accumulator(waiting, surfels, stamp, c["next_idx"], self.p)
        updated, new = checkpoint(updated), checkpoint(new)
        surfels = checkpoint(surfels.join(updated.select("idx"), "idx", "left_anti").unionByName(updated).unionByName(new))
        top = new.agg(F.max("idx")).first()[0]
        c["next_idx"] = c["next_idx"] if top is None else top + 1
        c["runs"] += 1
        return surfels, checkpoint(rest)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        surfels, waiting, c = self._read(batch_id - 1)
        points = checkpoint(valid_points(batch, self.p))
        frames, stamp = points.agg(F.countDistinct("stamp"), F.max("stamp")).first()
        a = checkpoint(FU.associate(points, surfels, self.p))
        fused = checkpoint(FU.fuse_all(a, surfels, self.p))
        surfels = checkpoint(surfels.join(fused.select("idx"), "idx", "left_anti").unionByName(fused))
        rest = a.where("idx is null").select(*waiting.columns)
        waiting = checkpoint(waiting_points(waiting.unionByName(rest), self.p))
        before, c["frames"] = c["frames"], c["frames"] + frames
        if c["frames"] // FRAMES > before // FRAMES:
            surfels, waiting = self._run(surfels, waiting, stamp, c)
        self._write(batch_id, surfels, waiting, c)

    def last(self) -> int:
        """The number of the last whole version, -1 without one."""
        found = []
        for slot in (0, 1):
            try:
                found += [r[0] for r in self.spark.read.schema(META).parquet(self._slot(slot, "meta")).select("version").collect()]
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return max(found, default=-1)

    def flush(self) -> DataFrame:
        """The surfels after a last run of the accumulator, whatever the count of frames; the stored state stays."""
        surfels, waiting, c = self._read(self.last())
        stamp = waiting.agg(F.max("stamp")).first()[0]
        return surfels if stamp is None else self._run(surfels, waiting, stamp, c)[0]

    def surfels(self) -> DataFrame:
        return self._read(self.last())[0]

    def waiting(self) -> DataFrame:
        return self._read(self.last())[1]
