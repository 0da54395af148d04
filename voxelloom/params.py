
from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class ScanParams:
    ground_filter: bool = True
    ground_z_min: float = 0.2
    width: int = 240
    height: int = 180
    hfov_deg: float = 106.0
    vfov_deg: float = 86.0
    min_range: float = 0.1
    max_range: float = 10.0
    ds: int = 1
    smooth_radius: int = 3
    orient: bool = True
    smooth_iters: int = 3
    depth_sigma: float = 0.05
    spatial_sigma: float = 1.0
    max_jump: float = 0.10
    range_alpha: float = 0.01

    @property
    def grid_w(self) -> int:
        return -(-self.width // self.ds)

    @property
    def grid_h(self) -> int:
        return -(-self.height // self.ds)

    @property
    def hfov(self) -> float:
        return math.radians(self.hfov_deg)

    @property
    def vfov(self) -> float:
        return math.radians(self.vfov_deg)


@dataclass(frozen=True)
class SurfelParams:
    voxel: float = 0.3
    min_points: int = 50
    min_weight: float = 0.1
    planarity: float = 0.01
    degeneracy: float = 0.1
    max_ratio: float = 100.0
    epsilon: float = 1e-6
    max_eigenvalue: float = 5.0
    shadow_dot: float = 0.85


@dataclass(frozen=True)
class CameraParams:
    hfov_deg: float = 90.0
    vfov_deg: float = 60.0
    min_range: float = 0.1
    max_range: float = 8.0
    max_incidence_deg: float = 75.0

    @property
    def tan_h(self) -> float:
        return math.tan(math.radians(self.hfov_deg) / 2)

    @property
    def tan_v(self) -> float:
        return math.tan(math.radians(self.vfov_deg) / 2)

    @property
    def cos2_incidence(self) -> float:
        return math.cos(math.radians(self.max_incidence_deg)) ** 2


@dataclass(frozen=True)
class PlannerParams:
    inflation: float = 0.8
    min_z: float = 0.5
    optimal: float = 1.5
    nearest: float = 1.0
    expansion: float = 10.0
    wavefront: float = 2.0
    cluster_radius: float = 1.0
    min_cluster: int = 5
    min_new: float = 0.1
    weights: tuple = (0.5, 0.3, 0.2)
    revisit_m: float = 0.5
    revisit_deg: float = 15.0
    max_viewpoints: int = 3
    target_coverage: float = 0.99
    rrt_iterations: int = 2000
    rrt_step: float = 0.3
    rrt_goal_bias: float = 0.3
    rrt_margin: float = 25.0


@dataclass(frozen=True)
class FusionParams:
    voxel: float = 0.3
    normal_deg: float = 30.0
    mahalanobis: float = 9.21
    normal_dist: float = 0.05
    min_radius: float = 0.05
    per_voxel: int = 6
    merge_dist: float = 0.1
    merge_dot: float = 0.95
    decay: float = 0.99
    min_confidence: float = 0.01
    min_observations: int = 3
    min_normal: float = 0.1
    weight: float = 1.0
    center_rate: float = 0.5
    normal_rate: float = 0.2
    min_cluster: int = 5
    init_radius: float = 0.01
    coherence: float = 0.3
    accumulator: int = 5000
    support: float = 100.0
    fit_sigma: float = 0.02
    observations: float = 5.0
    temporal: float = 0.3
    area: float = 0.05


@dataclass(frozen=True)
class TrajectoryParams:
    dt: float = 0.05
    yaw_rate: float = 0.5
    yaw_scale: float = 1.0
    yaw_floor: float = 0.2
    start: tuple = (0.0, 0.0, 0.5)
    stop_speed: float = 0.2
