"""Numeric settings of every rule, in millimetres or plain ratios."""

from __future__ import annotations

from dataclasses import dataclass


# Each default is part of the published behaviour and must not drift.
@dataclass(frozen=True)
class Params:
    # region around the parent vessel
    crop_margin_mm: float = 10.0
    growth_limit_mm: float = 14.0
    near_wall_mm: float = 2.5
    # tube filter
    tube_scales_mm: tuple[float, ...] = (0.7, 1.1, 1.8)
    tube_alpha: float = 0.5
    tube_beta: float = 0.5
    tube_gamma: float = 15.0
    min_scale_voxels: float = 0.4
    tube_percentile: float = 70.0
    tube_floor: float = 0.015
    tube_scale_of_percentile: float = 0.35
    dim_tube_share: float = 0.6
    # tracing
    max_trace_mm: float = 10.0
    min_path_mm: float = 5.0
    # duplicates
    ostium_merge_mm: float = 3.5
    near_dup_mm: float = 5.0
    path_merge_mm: float = 8.0
    merge_min_cosine: float = 0.40
    diverge_cosine: float = 0.25
    # splitting of long contacts (off by default)
    split_contacts: bool = False
    split_min_spread_mm: float = 18.0
    split_max_cosine: float = 0.15
    split_min_walks: int = 6
    split_min_cluster: int = 3
    near_spread_mm: float = 15.0
    # calibre
    min_diameter_mm: float = 1.6
    min_radius_mm: float = 0.45
    # cut ends and terminal split
    cap_margin: int = 2
    cap_min_voxels: int = 8
    cap_dir_z: float = 0.75
    terminal_window_mm: float = 12.0
    terminal_dir_z: float = -0.40
    terminal_reach_mm: float = 10.0
    terminal_min_diameter_mm: float = 4.5
    # intensity calibration
    low_percentile: float = 8.0
    low_relax: float = 0.20
    high_percentile: float = 92.0
    high_margin: float = 80.0
    high_cap: float = 850.0
    # artefact rules
    quality_filter: bool = True
    context_radius_mm: float = 5.0
    tube_clear_mm: float = 2.6
    bone_drop: float = 0.22
    adjacent_drop: float = 0.28
    blob_tube_max: float = 0.08
    blob_radius_mm: float = 3.0
    short_path_mm: float = 6.0
    short_circularity: float = 0.38
    smear_tube_max: float = 0.02
    smear_cv: float = 0.40
    # scoring
    match_mm: float = 10.0
    cosine_ok: float = 0.35
    radius_ok: tuple[float, float] = (0.35, 8.0)
    ratio_ok: tuple[float, float] = (0.35, 2.8)


DEFAULTS = Params()
