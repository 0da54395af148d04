"""Plans that stay whole on larger tables: what may go through the driver, and how work is dealt."""

import re

from pyspark.sql import functions as F

from voxelloom.operators import fusion2d, paths, planner, surfel, visibility
from voxelloom.plans.queries import MAP, QUERIES, SIZE
from voxelloom.sources import fixtures
from voxelloom.sources.fixtures import fixture

SF = "/root/testdata/sf0.01"


def broadcasts_exploded(df) -> bool:
    """Whether a table that an explode multiplied goes through the driver."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = lambda line: len(re.match(r"[\s:|+\-]*", line)[0])
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            for below in plan[i + 1 :]:
                if depth(below) <= depth(line):
                    break
                if "Generate explode" in below:
                    return True
    return False


def test_views_stay_off_the_driver(spark):
    voxels = surfel.surfels(fixture(spark, SF, "fx_pwn"), MAP).localCheckpoint()
    vps = fixture(spark, SF, "fx_viewpoints")
    assert not broadcasts_exploded(visibility.directly_visible(vps, voxels, SIZE))
    assert not broadcasts_exploded(visibility.visibility(vps, voxels, SIZE))


def test_hidden_neighbour_of_a_seen_voxel_is_seen(spark):
    """V4 with V6: a voxel behind another is told by the seen neighbour beside it, one without isn't."""
    rows = spark.createDataFrame([(6, 0, 0), (7, 0, 0), (9, 0, 0)], "vx int, vy int, vz int")
    rows = rows.withColumns({"mx": (F.col("vx") + 0.5) * 0.3, "my": F.lit(0.15), "mz": F.lit(0.15), "nx": F.lit(-1.0), "ny": F.lit(0.0), "nz": F.lit(0.0), "is_valid": F.lit(True)})
    vp = spark.createDataFrame([(1, 0.0, 0.15, 0.15, 0.0)], "vp_id long, x double, y double, z double, yaw double")
    seen = lambda **kw: sorted(r.vx for r in visibility.visibility(vp, rows, 0.3, **kw).collect())
    assert seen() == [6, 7, 9]
    assert seen(occlusion=True) == [6, 7]


def test_similar_viewpoints_of_one_pose(spark):
    """V8: copies of a pose are dealt by id; all their pairs come out, once each."""
    vps = spark.range(40).select(F.col("id").alias("vp_id"), F.lit(0.1).alias("x"), (F.col("id") % 2 * 0.45).alias("y"), F.lit(0.0).alias("z"), F.lit(0.2).alias("yaw"))
    pairs = visibility.similar(vps, 0.5, 0.2618)
    assert "SortMergeJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, pairs.collect())) == [(a, b) for a in range(40) for b in range(a + 1, 40)]
    assert visibility.similar(vps.limit(0), 0.5, 0.2618).isEmpty()


def test_points_of_a_scan_are_numbered_in_parts(spark):
    """point_idx as row_number tells it, ties and nulls too, without one task for a scan."""
    rows = spark.range(5000).select((F.col("id") % 3).alias("scan"), F.when(F.col("id") % 50 > 0, F.col("id") * 7919 % 9000).alias("a"), (F.col("id") * 31 % 17).alias("b"), "id")
    from pyspark.sql import Window

    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("scan").orderBy("a", "b", "id")))
    got = fixtures.numbered(rows, "scan", ["a", "b", "id"], "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = fixture(spark, SF, "fx_points")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(l_linenumber#\d+, \d+\)", plan.split("== Initial Plan ==")[-1])


def test_merge_seeds_and_legs_stay_off_the_driver(spark):
    s = fixture(spark, SF, "fx_surfels_b")
    seeds = s.select(F.col("idx").alias("seed_id"), "cx", "cy", "cz", "nx", "ny", "nz")
    assert not broadcasts_exploded(fusion2d.merge_targets(seeds, s))
    voxels = surfel.surfels(fixture(spark, SF, "fx_pwn"), MAP).localCheckpoint()
    legs = fixture(spark, SF, "fx_viewpoints").select(F.col("vp_id").alias("leg_id"), *[F.col(a).alias(f"s{a}") for a in "xyz"], F.lit(3.6).alias("gx"), F.col("y").alias("gy"), F.col("z").alias("gz"))
    assert not broadcasts_exploded(paths.plan_legs(legs, voxels, SIZE))


def test_plans_see_by_plan_not_by_viewpoint(spark):
    """I8: what plans see is dealt by plan, and summed up there without a shuffle of all that is seen."""
    voxels = surfel.surfels(fixture(spark, SF, "fx_pwn"), MAP).localCheckpoint()
    reached = spark.range(400).select((F.col("id") % 50).alias("plan_id"), (F.col("id") % 8 + 1).alias("vp_id"), F.lit(1).alias("reached_at"))
    plan = planner.observed_at(reached, fixture(spark, SF, "fx_viewpoints"), voxels, SIZE)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(plan_id#\d+L?, \d+\)", plan) and not re.search(r"hashpartitioning\((vp_id|plan_id#\d+L?, vx)", plan)


def test_scores_read_viewpoints_once(spark):
    """Closeness to a chain comes without a second look at the viewpoints, an empty or unknown chain too."""
    vps = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.5), (2, 5.0, 0.0, 1.0, 1.0), (3, 0.9, 0.0, 1.0, 0.0), (4, None, 0.0, 1.0, 1.0)], "vp_id long, x double, y double, z double, coverage double")
    chain = spark.createDataFrame([(0.0, 0.0, 1.0), (0.1, 0.0, 1.0), (None, 0.0, 0.0)], "x double, y double, z double")
    at = (0.0, 0.0, 1.0)
    got = {r.vp_id: r.score for r in planner.selection_scores(vps, at, chain).collect()}
    far = {r.vp_id: r.score for r in planner.selection_scores(vps, at, chain.limit(0)).collect()}
    assert [round(got[i], 9) for i in (1, 2, 3)] == [0.13, 0.75, 0.051] and [round(far[i], 9) for i in (1, 2, 3)] == [0.65, 0.75, 0.255]
    assert got[4] == far[4] == 0.7  # least() passes over an unknown distance
    plan = planner.selection_scores(vps, at, chain)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("coverage#") and len(re.findall(r"LogicalRDD|LocalRelation|Scan", plan)) == 2


def test_clusters_associate_once(spark):
    """The waiting points are told once, not again for each use of their cells."""
    plan = QUERIES["b14_clusters"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "parquet" not in plan


def test_merge_pairs_shuffle_surfels_once(spark):
    """Both sides of the join by voxel are one shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = fusion2d.merge_pairs(fixture(spark, SF, "fx_surfels_b"), mode="intended")
        assert not pairs.isEmpty()
        plan = pairs._jdf.queryExecution()
        pairs.collect()
        plan = plan.executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("ReusedExchange") == 1 and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_components_keep_only_links_between_trees(spark, monkeypatch):
    """Links go on once, and only those whose ends aren't together yet; all kinds of graphs come out as by plain union."""
    import random

    kept, real = [], fusion2d.checkpoint

    def noted(df):
        out = real(df)
        if out.columns == ["a", "b"]:
            kept.append(out.count())
        return out

    monkeypatch.setattr(fusion2d, "checkpoint", noted)
    rng = random.Random(4)
    label = rng.sample(range(1000), 1000)
    cliques = [(10 * g + i, 10 * g + j) for g in range(30) for i in range(10) for j in range(i)]
    chain = [(label[i], label[i + 1]) for i in range(199)]
    hub = [(999, k) for k in range(0, 300, 3)] + [(998, k) for k in range(1, 300, 3)] + [(998, 997), (997, 999)]
    tree = [(label[k], label[(k - 1) // 2]) for k in range(1, 500)]
    odd = [(5, 5), (None, 1), (7, None), (8, 9), (8, 9), (9, 8), (-3, 8)]
    for pairs in (cliques, chain, hub, tree, odd, []):
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in pairs:
            if a is not None and b is not None and a != b:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
        kept.clear()
        got = fusion2d.components(spark.createDataFrame(pairs, "a long, b long").repartition(3))
        assert {(r.idx, r.root) for r in got.collect()} == {(x, root(x)) for x in parent} and got.count() == len(parent)
        links = sum(a is not None and b is not None and a != b for a, b in pairs)
        assert kept[0] == links and kept[-1] == 0 and all(y <= x / 2 for x, y in zip(kept[1:], kept[2:], strict=False))
        if pairs is cliques:
            assert kept == [links, 0]


def test_merged_maps_read_surfels_once(spark):
    """Sums, centres and distances come from surfels that met their roots once; repeated, null and missing indices as before."""
    plan = QUERIES["b22_merge_map"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "parquet" not in plan
    rows = [(i, 0.1 * k, 0.0, 0.05, 1e-4, 0.01 * k, float(k), k, 1, 0.5) for k, i in enumerate((1, 1, 2, 4, 6, 6, None, 9), 1)]
    surfels = spark.createDataFrame(rows, "idx long, cx double, cy double, cz double, l1 double, confidence double, total_weight double, point_count long, observations long, sum_sq double")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (None, 9)], "a long, b long")
    out = sorted((r.idx, r.parts, r.point_count, round(r.cx, 6)) for r in fusion2d.merge_map(pairs, surfels).collect())
    # 4 goes with the missing 3; the repeated 1 and 6 come out twice.
    mean = lambda *ks: round(sum(0.1 * k * k for k in ks) / sum(ks), 6)
    assert out == [(1, 3, 6, mean(1, 2, 3))] * 2 + [(6, 2, 11, mean(5, 6))] * 2 + [(9, 1, 8, 0.8)]
