"""Explicit schemas of the files that enter and leave the library."""

from __future__ import annotations

from pyspark.sql import types as T

_XYZ = T.ArrayType(T.DoubleType())


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


STR, DBL, INT, LNG, BOO = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()

LANDMARK = _s(
    ("instance_id", STR), ("parent_instance_id", STR), ("ostium_xyz_mm", _XYZ), ("seed_xyz_mm", _XYZ),
    ("radius_mm", DBL), ("direction_xyz", _XYZ),
)
PREDICTION = _s(("case_id", STR), ("parent", _s(("instance_id", STR))), ("daughters", T.ArrayType(LANDMARK)))

GUIDE = _s(
    ("instance_id", STR), ("points_voxel", T.ArrayType(_XYZ)), ("origin_diameter_estimate_mm", DBL),
    ("confidence", STR), ("notes", STR), ("threshold_hu", DBL), ("search_radius_mm", DBL),
)
ANNOTATION = _s(
    ("case_id", STR),
    (
        "daughters",
        T.ArrayType(
            _s(
                *[(f.name, f.dataType) for f in LANDMARK.fields],
                ("confidence", STR), ("notes", STR), ("origin_diameter_estimate_mm", DBL), ("guide", GUIDE),
            )
        ),
    ),
)
EXCLUDED = _s(
    ("instance_id", STR), ("reason", STR), ("notes", STR), ("ostium_xyz_mm", _XYZ), ("seed_xyz_mm", _XYZ),
    ("direction_xyz", _XYZ), ("points_voxel", T.ArrayType(_XYZ)), ("guide", GUIDE),
)

DETECTION_ROWS = _s(
    ("case", STR), ("instance_id", STR), ("status", STR), ("gt_id", STR),
    *[(n, DBL) for n in (
        "ostium_err_mm", "ostium_x", "ostium_y", "ostium_z", "radius_mm", "path_length_mm",
        "vesselness", "mean_hu", "radius_cv", "mean_circularity",
    )],
    ("crop_path", STR), ("verdict", STR), ("note", STR),
)
FEATURE_ROWS = _s(
    ("case", STR), ("instance_id", STR), ("status", STR), ("verdict", STR),
    *[(n, DBL) for n in (
        "ostium_x", "ostium_y", "ostium_z", "radius_mm", "path_mm", "vesselness", "mean_hu",
        "radius_cv", "circularity", "bone_frac", "adj_lumen_frac",
    )],
    ("rule_drop", STR),
)
VERDICT_ROWS = _s(("case", STR), ("instance_id", STR), ("verdict", STR), ("note", STR))
RUN_ROWS = _s(("case_id", STR), ("n_detections", INT), ("runtime_s", DBL), ("peak_mem_gb", DBL), ("flag", STR))
CENSUS_ROWS = _s(
    ("case_id", STR), ("instance_id", STR), ("contact_spread_mm", DBL), ("over_18mm_threshold", STR),
    ("would_full_split", STR), ("cluster_cos", DBL), ("internal_id", STR), ("n_contact", LNG), ("n_instance", LNG),
    ("ostium_x", DBL), ("ostium_y", DBL), ("ostium_z", DBL), ("nearest_kept", STR), ("kept_ostium_err_mm", DBL),
)
CURVATURE_ROWS = _s(
    ("case_id", STR), ("internal_id", STR),
    *[(n, DBL) for n in (
        "contact_spread_mm", "end_cos", "waist_mm", "end_radius_mm", "waist_ratio", "mean_turn_deg",
        "max_turn_deg", "turn_concentration", "top15_turn_share",
    )],
    ("verdict", STR),
)
MANIFEST_ROWS = _s(("path", STR), ("bytes", LNG), ("sha256", STR))
EDIT_ROWS = _s(("case_id", STR), ("instance_id", STR), ("verdict", STR), ("edit_id", LNG), ("edit_ts", T.TimestampType()))
