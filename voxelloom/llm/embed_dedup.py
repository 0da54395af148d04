"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to unit length and turned into the axes of their second moments, so that the
leading dimensions hold most of every inner product. They are cut into tiles along the first axis.
A pair of tiles is compared only if their boxes in the leading dimensions are near enough. Inside a
pair of tiles the inner products of the leading dimensions come first; by Cauchy-Schwarz the rest of
a product is at most the product of the suffix norms, so a pair that cannot reach the threshold
stops there. What is left is decided by the cosine of the whole vectors in double precision.

The axes come from a bounded sample: any rotation gives the same links, only the pruning differs.
Equal vectors are one row with a count; a pair of tiles returns counts and a spanning forest, so a
group of thousands of near copies never becomes a list of pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare
from .graph import Forest, components
from .jaccard_join import _blocks, _grouped

THRESHOLD = 0.9
TILE = 4096
SAMPLE = 20_000
BOX = 8
STAGES = (16, 32)
STEP = 512
SLACK = 1e-9


def axes(sample: np.ndarray) -> np.ndarray:
    """Orthogonal axes by falling second moment, as columns."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(vectors[:, ::-1])


def _matrix(column, width: int) -> np.ndarray:
    """Packed vectors -> unit vectors in double precision."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.float32 if width == 4 else np.float64)
    x = raw.reshape(len(column), -1).astype(np.float64)
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _leading(width: int, basis, box: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                kind = pa.float32() if width == 4 else pa.float64()
                packed = pa.array([np.asarray(v, np.float32 if width == 4 else np.float64).tobytes() for v in batch.column("embedding").cast(pa.list_(kind)).to_pylist()], pa.binary())
                lead = (_matrix(packed, width) @ basis.value)[:, :box]
                yield pa.RecordBatch.from_arrays([batch.column("addr"), batch.column("copies"), packed, pa.array(list(lead), pa.list_(pa.float64()))], names=["addr", "copies", "packed", "lead"])

    return run


def _compare(width: int, basis, threshold: float):
    def run(batches):
        for t in _grouped(batches, ["pair"]):
            addr, weight, side = (t.column(c).to_numpy() for c in ("addr", "copies", "side"))
            x = _matrix(t.column("packed"), width)
            y = x @ basis.value
            stages = [s for s in STAGES if s < y.shape[1]]
            rest = [np.sqrt((y[:, s:] ** 2).sum(1)) for s in stages]
            links = np.zeros(len(addr), np.int64)
            forest = Forest(len(addr))
            for rows, cols in _blocks(side, STEP):
                ok = np.ones((len(rows), len(cols)), bool)
                if rows[0] == cols[0]:
                    ok = rows[:, None] < cols[None, :]
                part, low = None, 0
                for s, r in zip(stages, rest, strict=True):
                    add = y[rows, low:s] @ y[cols, low:s].T
                    part = add if part is None else part + add
                    ok &= part + r[rows][:, None] * r[cols][None, :] >= threshold - SLACK
                    low = s
                    if np.count_nonzero(ok) < 0.01 * ok.size:
                        break
                many = np.count_nonzero(ok)
                if not many:
                    continue
                if many < 0.05 * ok.size:
                    i, j = np.nonzero(ok)
                    near = np.einsum("ij,ij->i", x[rows[i]], x[cols[j]]) >= threshold
                    ok = np.zeros_like(ok)
                    ok[i[near], j[near]] = True
                else:
                    ok &= x[rows] @ x[cols].T >= threshold
                if ok.any():
                    np.add.at(links, rows, ok @ weight[cols])
                    np.add.at(links, cols, weight[rows] @ ok)
                    forest.link(ok, rows, cols)
            on = np.flatnonzero(links)
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(addr[on]), pa.array(links[on]), pa.array(addr[[forest.find(int(i)) for i in on]])], names=["addr", "links", "root"])

    return run


def _links(vectors: DataFrame, width: int, threshold: float, tile: int) -> DataFrame:
    """vectors(addr, copies, embedding) of one length, all different -> (addr, links, root)."""
    spark = vectors.sparkSession
    part = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = vectors.orderBy(F.xxhash64("addr"), "addr").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    kind = np.float32 if width == 4 else np.float64
    basis = axes(_matrix(pa.array([np.asarray(v, kind).tobytes() for v in sample], pa.binary()), width))
    box = min(BOX, len(basis))
    shared = spark.sparkContext.broadcast(basis)
    turned = materialise(vectors.mapInArrow(_leading(width, shared, box), "addr long, copies long, packed binary, lead array<double>"), "turned")

    # Slabs along the first axis; a slab that holds too many is cut by hash.
    slabs = max(1, math.ceil(turned.count() / tile))
    cuts = sorted(set(turned.select(F.col("lead")[0].alias("first")).approxQuantile("first", [i / slabs for i in range(1, slabs)], min(0.01, 0.2 / slabs)))) if slabs > 1 else []
    at = spark.sparkContext.broadcast(np.array(cuts))

    def slab(batches):
        for batch in batches:
            first = np.array([v[0] for v in batch.column("lead").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(at.value, first, "right").astype(np.int32))], names=[*batch.schema.names, "slab"])

    placed = materialise(turned.mapInArrow(slab, "addr long, copies long, packed binary, lead array<double>, slab int"), "slabs")
    sizes = placed.groupBy("slab").agg(F.ceil(F.count("*") / F.lit(1.25 * tile)).cast("int").alias("cuts"))
    placed = placed.join(sizes, "slab").withColumn("tile", F.concat_ws(".", "slab", F.pmod(F.xxhash64("addr", "slab"), F.col("cuts")))).drop("slab", "cuts")
    placed = materialise(placed, "tiles")

    # Tiles meet through bins of the first axis, then by the distance of their boxes.
    radius = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    bounds = [f(F.col("lead")[i]).alias(f"{n}{i}") for i in range(box) for n, f in (("lo", F.min), ("hi", F.max))]
    tiles = materialise(placed.groupBy("tile").agg(*bounds), "tile-boxes")
    floor = lambda c: F.floor(c / F.lit(max(radius, 1e-6))).cast("int")
    own = tiles.withColumn("bin", F.explode(F.sequence(floor(F.col("lo0")), floor(F.col("hi0")))))
    near = tiles.withColumn("bin", F.explode(F.sequence(floor(F.col("lo0") - radius), floor(F.col("hi0") + radius))))
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"a.lo{i}") - F.col(f"b.hi{i}"), F.col(f"b.lo{i}") - F.col(f"a.hi{i}"))
    far = sum((gap(i) * gap(i) for i in range(box)), F.lit(0.0))
    pairs = own.alias("a").join(near.alias("b"), "bin").where((F.col("a.tile") <= F.col("b.tile")) & (far <= radius * radius))
    pairs = pairs.select(F.col("a.tile").alias("a"), F.col("b.tile").alias("b")).unionByName(
        near.alias("a").join(own.alias("b"), "bin").where((F.col("a.tile") <= F.col("b.tile")) & (far <= radius * radius)).select(F.col("a.tile").alias("a"), F.col("b.tile").alias("b"))
    ).distinct()
    pairs = pairs.withColumn("pair", F.xxhash64("a", "b"))
    sides = pairs.where("a <> b").select(F.col("a").alias("tile"), "pair", F.lit(0).alias("side"))
    sides = sides.unionByName(pairs.where("a <> b").select(F.col("b").alias("tile"), "pair", F.lit(1).alias("side")))
    sides = materialise(sides.unionByName(pairs.where("a = b").select(F.col("a").alias("tile"), "pair", F.lit(2).alias("side"))), "tile-pairs")

    spread = placed.select("tile", "addr", "copies", "packed").join(sides, "tile").select("pair", "side", "addr", "copies", "packed")
    spread = spread.repartition(part, "pair").sortWithinPartitions("pair")
    return spread.mapInArrow(_compare(width, shared, threshold), "addr long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Per row of vectors(vec_id, embedding, ...): vec_id, n_links, component_id, kept.

    Null, empty and zero vectors and those with null or non-finite components link with nothing and
    stand alone; vectors of different lengths never link; repeated rows are other vectors; a null
    id stays null and is never the smallest; an empty table gives an empty result; other columns
    aren't read.
    """
    prepare(vectors.sparkSession)
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    width = 4 if kind == "float" else 8
    rows = vectors.select("vec_id", F.col("embedding").cast("array<float>" if width == 4 else "array<double>").alias("embedding"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    good = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    # -0.0 equals 0.0 in a comparison of vectors; grouping must see one of them only.
    plain = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v).cast("float" if width == 4 else "double"))
    keyed = rows.where("good").select("vec_id", plain.alias("embedding"))
    keyed = keyed.withColumn("addr", F.xxhash64("embedding"))
    one = materialise(keyed.groupBy("addr", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least")), "vectors")
    found = None
    for (n,) in one.select(F.size("embedding")).distinct().collect():  # one row per length in use
        links = _links(one.where(F.size("embedding") == n).select("addr", "copies", "embedding"), width, threshold, tile)
        found = links if found is None else found.unionByName(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = materialise(found, "vector-links")
    degree = found.groupBy("addr").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("addr").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "addr")
    nodes = one.select("addr", "copies", "least").join(degree, "addr", "left").join(roots, "addr", "left")
    nodes = materialise(nodes.select("addr", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "addr").alias("root")), "vector-nodes")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "root").select("addr", "n_links", "component_id")
    out = keyed.select("vec_id", "addr").join(nodes, "addr").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
