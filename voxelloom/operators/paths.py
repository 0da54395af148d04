"""Edge and path collision checks as joins, and the random tree search per leg."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions.shared import checkpoint, meet, spread
from ..params import PlannerParams
from .voxel import KEY, collisions, radius_join


def edge_samples(edges: DataFrame, step: float) -> DataFrame:
    """Points along edges(edge_id, ax..az, bx..bz), ends included; a zero edge is one point."""
    d = L.sub(L.vec("b"), L.vec("a"))
    n = F.ceil(L.norm(d) / step).cast("int")
    out = edges.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), n)))
    t = F.when(F.col("n") > 0, F.col("i") / F.col("n")).otherwise(0.0)
    return out.withColumns({c: F.col(f"a{c}") + F.col(f"b{c}") * t - F.col(f"a{c}") * t for c in "xyz"})


def free_edges(edges: DataFrame, voxels: DataFrame, size: float, p: PlannerParams = PlannerParams()) -> DataFrame:
    """(edge_id, is_free). An edge is free if no sample collides; with an empty map none is."""
    samples = edge_samples(edges, p.rrt_step).select("edge_id", "x", "y", "z")
    occupied = voxels.where("count > 0").select(*KEY)
    hit = radius_join(samples, occupied, p.inflation, size).select("edge_id").distinct().withColumn("hit", F.lit(True))
    empty = occupied.agg((F.count("*") == 0).alias("empty"))
    out = edges.select("edge_id").join(hit, "edge_id", "left").crossJoin(F.broadcast(empty))
    return out.select("edge_id", (~F.coalesce("hit", F.lit(False)) & ~F.col("empty")).alias("is_free"))


def path_edges(path: DataFrame) -> DataFrame:
    """Edges of path(plan_id, seq, x, y, z), named by their first seq."""
    w = Window.partitionBy("plan_id").orderBy("seq")
    out = path.withColumns({f"b{c}": F.lead(c).over(w) for c in "xyz"}).where("bx is not null")
    return out.select("plan_id", "seq", *[F.col(c).alias(f"a{c}") for c in "xyz"], "bx", "by", "bz")


def first_invalid(path: DataFrame, voxels: DataFrame, size: float, p: PlannerParams = PlannerParams()) -> DataFrame:
    """Per plan the first edge that isn't free, or -1; paths of one point have none."""
    edges = path_edges(path).withColumn("edge_id", F.struct("plan_id", "seq"))
    bad = free_edges(edges, voxels, size, p).where(~F.col("is_free")).select("edge_id.plan_id", "edge_id.seq")
    bad = bad.groupBy("plan_id").agg(F.min("seq").alias("seq"))
    return path.select("plan_id").distinct().join(bad, "plan_id", "left").select("plan_id", F.coalesce("seq", F.lit(-1)).alias("first_invalid"))


def headings(path: DataFrame) -> DataFrame:
    """Yaw towards the next point; the last point and viewpoints keep their own."""
    w = Window.partitionBy("plan_id").orderBy("seq")
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    own = F.col("viewpoint_idx").isNotNull() | nx.isNull()
    return path.withColumn("yaw", F.when(own, F.col("yaw")).otherwise(F.atan2(ny - F.col("y"), nx - F.col("x"))))


def back_off(viewpoints: DataFrame, voxels: DataFrame, size: float, p: PlannerParams = PlannerParams()) -> DataFrame:
    """Colliding viewpoints step back along their heading by voxel sizes up to the inflation radius.

    Returns vp_id, step (0: free as it is; null: nowhere free, to be erased) and the position.
    """
    steps = F.sequence(F.lit(0), F.lit(int(math.floor(p.inflation / size + 1e-9))))
    tries = viewpoints.withColumn("step", F.explode(steps))
    back = F.col("step") * size
    tries = tries.withColumns({"x": F.col("x") - F.cos("yaw") * back, "y": F.col("y") - F.sin("yaw") * back})
    tries = tries.withColumn("try_id", F.struct("vp_id", "step"))
    free = collisions(tries, voxels, p.inflation, size, "try_id").where(~F.col("in_collision")).select("try_id")
    first = tries.join(free, "try_id").groupBy("vp_id").agg(F.min(F.struct("step", "x", "y", "z")).alias("b"))
    return viewpoints.select("vp_id").join(first, "vp_id", "left").select("vp_id", "b.step", "b.x", "b.y", "b.z")


# --- tree search -----------------------------------------------------------------------------


class Solid:
    """Centres of occupied voxels, ordered by cubes as large as the radius that is asked for."""

    def __init__(self, cells: np.ndarray, size: float, part: bool = False):
        """part: of a map that has voxels elsewhere, so that none here means free."""
        cells = np.unique(np.asarray(cells, int).reshape(-1, 3), axis=0)
        self.at = (cells + 0.5) * size
        self.never_free = not len(cells) and not part
        self.radius = None

    def _order(self, radius: float) -> None:
        if radius == self.radius:
            return
        self.radius, self.edge = radius, radius * (1 + 1e-9)
        self.box = self.at.min(0) - self.edge, self.at.max(0) + self.edge
        cube = np.floor(self.at / self.edge).astype(np.int64)
        self.low = cube.min(0) - 2  # so that the cubes around a point in the box have numbers of their own
        _, ny, nz = cube.max(0) - self.low + 3
        self.turn = np.array([ny * nz, nz, 1])
        number = (cube - self.low) @ self.turn
        order = number.argsort(kind="stable")
        self.at, self.number = self.at[order], number[order]
        self.around = np.array([[i, j, -1] for i in (-1, 0, 1) for j in (-1, 0, 1)]) @ self.turn

    def hits(self, points: np.ndarray, radius: float) -> np.ndarray:
        """Per point whether an occupied voxel's centre is within radius."""
        out = np.zeros(len(points), bool)
        if not len(self.at):
            return out
        self._order(radius)
        near = ((points >= self.box[0]) & (points <= self.box[1])).all(1).nonzero()[0]
        if not len(near):
            return out
        q = points[near]
        first = ((np.floor(q / self.edge).astype(np.int64) - self.low) @ self.turn)[:, None] + self.around
        a, b = self.number.searchsorted(first.ravel()), self.number.searchsorted(first.ravel() + 2, "right")
        n = b - a
        which = np.repeat(a - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
        point = np.repeat(np.arange(len(near)), n.reshape(len(near), -1).sum(1))
        out[near[point[((self.at[which] - q[point]) ** 2).sum(1) <= radius * radius]]] = True
        return out

    def beside(self, a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
        """The edges from a to b that come so near to the voxels' box that a point of theirs may hit."""
        if not len(self.at):
            return np.empty(0, np.int64)
        self._order(radius)
        return ((np.maximum(a, b) >= self.box[0]) & (np.minimum(a, b) <= self.box[1])).all(1).nonzero()[0]

    def free(self, points: np.ndarray, radius: float) -> bool:
        """No occupied voxel centre within radius of any point; an empty map is never free."""
        return not self.never_free and not self.hits(points, radius).any()


def _free(points: np.ndarray, cells: set, size: float, radius: float) -> bool:
    return Solid(list(cells), size).free(points, radius)


def _edge(a, b, step):
    n = math.ceil(np.linalg.norm(b - a) / step)
    return a + (b - a) * (np.arange(n + 1) / n)[:, None] if n else a[None]


def _length(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])


def _free_edges(a: np.ndarray, b: np.ndarray, solid: Solid, p: PlannerParams) -> np.ndarray:
    """Per edge from a to b whether no sample of it, ends included, collides."""
    out = np.ones(len(a), bool)
    near = solid.beside(a, b, p.inflation)
    if len(near):
        a, d = a[near], b[near] - a[near]
        n = np.ceil(_length(d) / p.rrt_step).astype(np.int64)
        edge = np.repeat(np.arange(len(a)), n + 1)
        i = np.arange(len(edge)) - np.repeat((n + 1).cumsum() - n - 1, n + 1)
        out[near[edge[solid.hits(a[edge] + d[edge] * (i / np.maximum(n, 1)[edge])[:, None], p.inflation)]]] = False
    return out


#: Legs that are searched together, iterations whose nearest nodes are told together.
LEGS, STRIDE = 256, 50


def search(start: np.ndarray, goal: np.ndarray, cells: np.ndarray | set | Solid, size: float, p: PlannerParams, seed: int) -> np.ndarray | None:
    """R1-R3, R7 for one leg, as search_all."""
    solid = cells if isinstance(cells, Solid) else Solid(list(cells), size)
    return search_all(np.asarray(start, float)[None], np.asarray(goal, float)[None], solid, p, [seed])[0]


def search_all(starts: np.ndarray, goals: np.ndarray, solid: Solid, p: PlannerParams, seeds: list[int]) -> list[np.ndarray | None]:
    """R1-R3, R7 per leg: straight line if free, else a tree grown by samples of the leg's own seed; the path is then shortened.

    A start or goal in collision has no free edge, so its tree need not be grown. Legs without known ends have no path.
    """
    out: list[np.ndarray | None] = [None] * len(starts)
    if solid.never_free:
        return out
    known = np.isfinite(starts).all(1) & np.isfinite(goals).all(1)
    direct = np.zeros(len(starts), bool)
    direct[known] = _free_edges(starts[known], goals[known], solid, p)
    for i in direct.nonzero()[0]:
        out[i] = np.stack([starts[i], goals[i]])
    todo = (known & ~direct & ~solid.hits(starts, p.inflation) & ~solid.hits(goals, p.inflation)).nonzero()[0]
    free = lambda a, b: solid.free(_edge(a, b, p.rrt_step), p.inflation)
    for k in range(0, len(todo), LEGS):
        legs = todo[k : k + LEGS]
        for i, path in zip(legs, _grow(starts[legs], goals[legs], solid, p, [seeds[i] for i in legs]), strict=True):
            out[i] = None if path is None else simplify(path, free)
    return out


def _samples(starts: np.ndarray, goals: np.ndarray, p: PlannerParams, seeds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per leg and iteration whether it aims at the goal and how many did not before it, and per axis and leg the random targets in turn."""
    legs, turns = len(starts), p.rrt_iterations
    u = np.stack([np.random.default_rng(seed).random(4 * turns) for seed in seeds])
    rows, at = np.arange(legs), np.zeros(legs, np.int64)
    aims, drawn = np.empty((turns, legs), bool), np.empty((turns, legs), np.int64)
    for i in range(turns):
        aims[i], drawn[i] = u[rows, at] < p.rrt_goal_bias, at + 1
        at = np.where(aims[i], at + 1, at + 4)
    rank = (~aims).cumsum(0) - ~aims
    lo, hi = np.minimum(starts, goals) - p.rrt_margin, np.maximum(starts, goals) + p.rrt_margin
    lo[:, 2] = np.maximum(lo[:, 2], p.min_z)
    targets = np.zeros((3, legs, turns))
    i, leg = (~aims).nonzero()
    for axis in range(3):
        targets[axis, leg, rank[i, leg]] = lo[leg, axis] + (hi - lo)[leg, axis] * u[leg, drawn[i, leg] + axis]
    return aims, rank, targets


class _Nearest:
    """The first of a tree's nodes that is nearest to each of some targets.

    Distances in single precision tell it, unless another node is within their error: then exact ones do.
    """

    def __init__(self, starts: np.ndarray, turns: int, most: int):
        self.origin, self.count = starts.copy(), np.zeros(len(starts), np.int64)
        self.terms = np.empty((len(starts), 4, turns + 1), np.float32)  # of |node|^2 - 2 node * target, from the tree's root
        self.far = np.zeros(len(starts))
        self.rough, self.close = np.empty(most * (turns + 1), np.float32), np.empty(most * (turns + 1) + 8, bool)

    def find(self, leg: int, nodes: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For nodes(3, n) and targets(3, m) of a leg: the nearest nodes and the squares of their distances."""
        m, n, old = targets.shape[1], nodes.shape[1], self.count[leg]
        origin = self.origin[leg][:, None]
        if n > old:
            d = nodes[:, old:] - origin
            square = (d * d).sum(0)
            self.terms[leg, :3, old:n], self.terms[leg, 3, old:n] = -2 * d, square
            self.far[leg], self.count[leg] = max(self.far[leg], square.max()), n
        d = targets - origin
        own = np.ones((m, 4), np.float32)
        own[:, :3] = d.T
        rough = np.matmul(own, self.terms[leg, :, :n], out=self.rough[: m * n].reshape(m, n))
        best = rough[np.arange(m), rough.argmin(1)]
        error = 4e-6 * ((d * d).sum(0) + self.far[leg])
        close = self.close[: -(-m * n // 8) * 8]
        close[m * n :] = False
        np.less_equal(rough, (best + error).astype(np.float32)[:, None], out=close[: m * n].reshape(m, n))
        pairs = (close.view(np.int64).nonzero()[0][:, None] * 8 + np.arange(8)).ravel()  # few are close: by eights
        target, node = np.divmod(pairs[close[pairs]], n)
        d2 = _square(nodes[:, node], targets[:, target])
        least = np.minimum.reduceat(d2, target.searchsorted(np.arange(m)))
        first = (d2 == least[target]).nonzero()[0][::-1]
        near = np.empty(m, np.int64)
        near[target[first]] = node[first]  # of equal ones the first is written last
        return near, least


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.square(a[0] - b[0]) + np.square(a[1] - b[1]) + np.square(a[2] - b[2])


def _grow(starts: np.ndarray, goals: np.ndarray, solid: Solid, p: PlannerParams, seeds: list[int]) -> list[np.ndarray | None]:
    """The trees of independent legs, all by the same iteration at a time, and their paths to the goals.

    Targets don't hang on the tree, so those of STRIDE iterations look for their nearest node at once
    and then at the new nodes only. A goal that its nearest node could not be moved towards is tried
    again when another node is nearest.
    """
    legs, turns = len(starts), p.rrt_iterations
    aims, rank, targets = _samples(starts, goals, p, seeds)
    rows = np.arange(legs)
    nodes, parent, count = np.empty((3, legs, turns + 1)), np.full((legs, turns + 1), -1), np.ones(legs, np.int64)
    nodes[:, :, 0] = starts.T
    goal_near, goal_d2, stuck = np.zeros(legs, np.int64), _square(goals.T, starts.T), np.zeros(legs, bool)
    alive, paths = np.ones(legs, bool), [None] * legs
    nearest = _Nearest(starts, turns, STRIDE)
    for begin in range(0, turns, STRIDE):
        end = min(begin + STRIDE, turns)
        base = rank[begin]
        most = int((rank[end - 1] + ~aims[end - 1] - base).max())
        block = targets[:, rows[:, None], np.minimum(base[:, None] + np.arange(most), turns - 1)]
        near, d2 = np.zeros((legs, max(most, 1)), np.int64), np.zeros((legs, max(most, 1)))
        for leg in alive.nonzero()[0] if most else ():
            near[leg], d2[leg] = nearest.find(leg, nodes[:, leg, : count[leg]], block[:, leg])
        for turn in range(begin, end):
            go = (alive & ~(aims[turn] & stuck)).nonzero()[0]
            if not len(go):
                continue
            aim, at = aims[turn, go], rank[turn, go]
            source = np.where(aim, goal_near[go], near[go, np.minimum(at - base[go], near.shape[1] - 1)])
            target = np.where(aim[:, None], goals[go], targets[:, go, np.minimum(at, turns - 1)].T)
            a = nodes[:, go, source].T
            step = target - a
            length = _length(step)
            far = length > p.rrt_step
            b = np.where(far[:, None], a + step * (p.rrt_step / np.where(far, length, 1.0))[:, None], target)
            ok = _free_edges(a, b, solid, p)
            stuck[go[aim & ~ok]] = True
            go, b, source = go[ok], b[ok], source[ok]
            new = count[go]
            nodes[:, go, new], parent[go, new] = b.T, source
            count[go] += 1
            used = int((rank[turn] - base).min())  # targets before it are done with, for all legs
            d = _square(block[:, go, used:], b.T[:, :, None])
            leg, i = (d < d2[go, used:most]).nonzero()
            near[go[leg], i + used], d2[go[leg], i + used] = new[leg], d[leg, i]
            d = _square(goals[go].T, b.T)
            nearer = d < goal_d2[go]
            closer = go[nearer]
            goal_d2[closer], goal_near[closer], stuck[closer] = d[nearer], new[nearer], False
            ends = (np.sqrt(d) <= 2 * p.rrt_step).nonzero()[0]
            for leg in go[ends[_free_edges(b[ends], goals[go[ends]], solid, p)]] if len(ends) else ():
                path, i = [goals[leg]], count[leg] - 1
                while i >= 0:
                    path.append(nodes[:, leg, i])
                    i = parent[leg, i]
                paths[leg], alive[leg] = np.array(path[::-1]), False
        if not alive.any():
            break
    return paths


def simplify(path: np.ndarray, free) -> np.ndarray:
    """From each kept point on to the furthest point that a free edge reaches."""
    out, i = [path[0]], 0
    while i < len(path) - 1:
        j = next((j for j in range(len(path) - 1, i, -1) if free(path[i], path[j])), i + 1)
        out.append(path[j])
        i = j
    return np.array(out)


def plan_legs(legs: DataFrame, voxels: DataFrame, size: float, p: PlannerParams = PlannerParams(), seed: int = 7) -> DataFrame:
    """R1 for legs(leg_id, sx..sz, gx..gz): (leg_id, seq, x, y, z); legs without a path give no rows.

    Legs whose search boxes span the same coarse blocks share the occupied voxels in them, which come
    by an equi-join on blocks, and are searched together, dealt by id into groups of some LEGS at
    most. A leg's own box is bounded by the search margin.
    """
    block = 16
    edge = block * size
    reach = p.rrt_margin + p.inflation
    coarse = math.ceil(reach / edge)
    span = [f"{e}{a}" for a in "xyz" for e in ("lo", "hi")]
    occupied = voxels.where("count > 0").select(*KEY).withColumns({f"b{a}": F.floor(F.col(k) / block).cast("int") for a, k in zip("xyz", KEY, strict=True)})
    cells = checkpoint(occupied.groupBy("bx", "by", "bz").agg(F.flatten(F.collect_list(F.array(*KEY))).alias("cells")))  # a block holds block ** 3 at most
    ends = legs.select("leg_id", *[f"{e}{a}" for e in "sg" for a in "xyz"])
    for a in "xyz":
        lo = F.floor(F.floor((F.least(f"s{a}", f"g{a}") - reach) / edge) / coarse) * coarse
        hi = F.floor(F.floor((F.greatest(f"s{a}", f"g{a}") + reach) / edge) / coarse) * coarse + coarse - 1
        ends = ends.withColumns({f"lo{a}": lo.cast("int"), f"hi{a}": hi.cast("int")})
    ends = checkpoint(ends)
    parts = int(legs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.count("*")
    sizes = checkpoint(ends.groupBy(*span).agg(F.greatest(F.ceil(n / LEGS), F.least(F.ceil(n * 4 / LEGS), F.lit(parts))).alias("groups")))
    ends = meet(ends, sizes, span).withColumn("legs", F.xxhash64(*span, F.pmod(F.xxhash64("leg_id"), F.col("groups"))))
    boxes = spread(ends.select("legs", *span).distinct(), "legs")
    for a in "xyz":
        boxes = boxes.withColumn(f"b{a}", F.explode(F.sequence(f"lo{a}", f"hi{a}")))
    near = meet(boxes, cells, ["bx", "by", "bz"], most=2_000).select(F.col("legs").alias("near_legs"), "cells")
    void = cells.isEmpty()

    def run(ends: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        solid = Solid(np.concatenate([[], *blocks["cells"]]), size, part=not void)
        at = ends[[f"{e}{a}" for e in "sg" for a in "xyz"]].to_numpy(float)
        found = search_all(at[:, :3], at[:, 3:], solid, p, [seed + int(i) for i in ends["leg_id"]])
        rows = [(leg, i, *map(float, q)) for leg, path in zip(ends["leg_id"], found, strict=True) if path is not None for i, q in enumerate(path)]
        return pd.DataFrame(rows, columns=["leg_id", "seq", "x", "y", "z"])

    dealt = spread(ends.drop("groups", *span), "legs")
    return dealt.groupBy("legs").cogroup(near.groupBy("near_legs")).applyInPandas(run, "leg_id long, seq int, x double, y double, z double")


def mend_paths(path: DataFrame, voxels: DataFrame, size: float, p: PlannerParams = PlannerParams(), seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Validate path(plan_id, seq, x, y, z, yaw, viewpoint_idx), replan each from its bad edge, splice, check again.

    A leg is searched from the bad edge's first point to the next viewpoint's point, and takes the
    place of what lay between; its points are no viewpoints (null), look at the next one, and the
    last keeps the yaw of the point that it stands for. Returns the usable paths, numbered from 0,
    and per plan its state: valid, repaired, unreachable (no leg found; erased is the viewpoint to
    drop) or replan (no viewpoint after the bad edge, or still bad). An empty table gives two empty ones.
    """
    old = path.select("plan_id", "seq", "x", "y", "z", "yaw", "viewpoint_idx").join(checkpoint(first_invalid(path, voxels, size, p)), "plan_id")
    goal = old.where("first_invalid >= 0 and seq > first_invalid and viewpoint_idx is not null").groupBy("plan_id")
    goal = checkpoint(goal.agg(F.min(F.struct("seq", "viewpoint_idx", "x", "y", "z", "yaw")).alias("g")))
    legs = old.where("seq = first_invalid").join(goal, "plan_id")
    legs = legs.select(F.col("plan_id").alias("leg_id"), *[F.col(a).alias(f"s{a}") for a in "xyz"], *[F.col(f"g.{a}").alias(f"g{a}") for a in "xyz"])
    found = checkpoint(plan_legs(legs, voxels, size, p, seed)).withColumnRenamed("leg_id", "plan_id")
    w = Window.partitionBy("plan_id").orderBy("seq")
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    new = found.withColumns({"nx": nx, "ny": ny}).where("seq > 0").join(goal, "plan_id")
    new = new.withColumn("yaw", F.when(F.col("nx").isNull(), F.col("g.yaw")).otherwise(F.atan2(F.col("ny") - F.col("y"), F.col("nx") - F.col("x"))))
    point = ["plan_id", "part", "seq", "x", "y", "z", "yaw", "viewpoint_idx"]
    new = new.withColumns({"part": F.lit(1), "viewpoint_idx": F.lit(None).cast(path.schema["viewpoint_idx"].dataType)}).select(*point)
    some = found.select("plan_id").distinct().join(goal, "plan_id")
    kept = old.join(some, "plan_id").withColumn("part", F.when(F.col("seq") <= F.col("first_invalid"), 0).when(F.col("seq") > F.col("g.seq"), 2))
    rank = F.row_number().over(Window.partitionBy("plan_id").orderBy("part", "seq")) - 1
    spliced = checkpoint(kept.where("part is not null").select(*point).unionByName(new).withColumn("seq", rank).drop("part"))
    again = first_invalid(spliced, voxels, size, p).withColumnRenamed("first_invalid", "left")
    states = old.groupBy("plan_id").agg(F.first("first_invalid").alias("bad")).join(goal, "plan_id", "left").join(again, "plan_id", "left")
    lost = F.col("g").isNotNull() & F.col("left").isNull()
    state = F.when(F.col("bad") < 0, "valid").when(lost, "unreachable").when(F.col("left") < 0, "repaired").otherwise("replan")
    states = checkpoint(states.select("plan_id", "bad", state.alias("state"), F.when(lost, F.col("g.viewpoint_idx")).alias("erased")))
    good = old.where("first_invalid < 0").withColumn("seq", F.row_number().over(w) - 1).drop("first_invalid")
    good = good.unionByName(spliced.join(states.where("state = 'repaired'").select("plan_id"), "plan_id", "left_semi"))
    return good, states
