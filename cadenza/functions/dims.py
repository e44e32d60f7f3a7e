"""Dimension tables: actions, families, cameras, stability profiles.

The rows are fixed values; they are small constants; joins carry no hint, the planner
broadcasts what it measures to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Action type -> (family, body part).
ACTIONS = {
    "machine_chest_press": ("press", "chest"),
    "machine_crunch": ("core_flexion", "core"),
    "standing_hip_abduction": ("isolation_hip", "glutes"),
    "seated_hip_abduction": ("isolation_hip", "glutes"),
    "chest_supported_row": ("pull", "back"),
    "t_bar_row": ("pull", "back"),
    "plate_loaded_pulldown": ("pull", "back"),
    "plate_loaded_romanian_deadlift": ("hinge", "hamstrings / glutes"),
    "single_arm_pulldown": ("pull", "back"),
    "hack_squat": ("squat", "legs / glutes"),
    "hip_thrust": ("hinge", "glutes"),
    "back_extension": ("hinge", "posterior chain"),
    "plate_loaded_rear_leg_raise": ("hinge", "glutes / hamstrings"),
    "preacher_curl": ("isolation_elbow", "arms"),
    "single_arm_hammer_row": ("pull", "back"),
    "barbell_squat": ("squat", "legs"),
    "goblet_squat": ("squat", "legs"),
    "deadlift": ("hinge", "posterior chain"),
    "romanian_deadlift": ("hinge", "hamstrings / glutes"),
    "bench_press": ("press", "chest"),
    "dumbbell_press": ("press", "chest"),
    "shoulder_press": ("press", "shoulders"),
    "push_up": ("press", "chest"),
    "dip": ("press", "chest / triceps"),
    "row": ("pull", "back"),
    "open_elbow_row": ("pull", "upper back"),
    "lat_pulldown": ("pull", "back"),
    "pull_up": ("pull", "back"),
    "face_pull": ("pull", "shoulders / upper back"),
    "lateral_raise": ("isolation_shoulder", "shoulders"),
    "y_raise": ("isolation_shoulder", "shoulders"),
    "fly": ("isolation_shoulder", "chest / shoulders"),
    "biceps_curl": ("isolation_elbow", "arms"),
    "triceps_extension": ("isolation_elbow", "arms"),
    "leg_extension": ("isolation_knee", "legs"),
    "leg_curl": ("isolation_knee", "legs"),
    "other": ("general", "full body"),
}

# Camera angles.
CAMERAS = ["side", "side_front", "side_rear", "front", "front_oblique", "rear", "unknown"]

# Body group of each family; everything else is general.
LOWER_BODY = ["squat", "hinge", "isolation_knee", "isolation_hip"]
UPPER_BODY = ["press", "pull", "isolation_shoulder", "isolation_elbow"]
MATCH_FAMILIES = sorted(LOWER_BODY + UPPER_BODY)

# Default action of a detected family.
ACTION_OF_FAMILY = {
    "squat": "barbell_squat", "hinge": "deadlift", "press": "bench_press", "pull": "row",
    "isolation_shoulder": "lateral_raise", "isolation_elbow": "biceps_curl", "isolation_knee": "leg_extension",
}

# Stability mode, angle threshold (deg), largest coupled angle (deg) per action.
STABILITY = {
    "machine_chest_press": ("absolute_fixed", 4.0, 0.0),
    "standing_hip_abduction": ("absolute_fixed", 4.5, 0.0),
    "seated_hip_abduction": ("absolute_fixed", 4.0, 0.0),
    "chest_supported_row": ("absolute_fixed", 4.0, 0.0),
    "plate_loaded_pulldown": ("absolute_fixed", 4.5, 0.0),
    "hack_squat": ("absolute_fixed", 4.5, 0.0),
    "plate_loaded_rear_leg_raise": ("absolute_fixed", 4.5, 0.0),
    "preacher_curl": ("absolute_fixed", 4.0, 0.0),
    "single_arm_hammer_row": ("absolute_fixed", 4.0, 0.0),
    "leg_extension": ("absolute_fixed", 4.0, 0.0),
    "leg_curl": ("absolute_fixed", 4.0, 0.0),
    "bench_press": ("absolute_supported", 5.0, 0.0),
    "dumbbell_press": ("absolute_supported", 5.0, 0.0),
    "lat_pulldown": ("absolute_supported", 5.5, 0.0),
    "t_bar_row": ("relative_coupled", 6.0, 12.0),
    "single_arm_pulldown": ("relative_coupled", 5.5, 9.0),
    "barbell_squat": ("relative_coupled", 6.5, 20.0),
    "goblet_squat": ("relative_coupled", 6.5, 18.0),
    "shoulder_press": ("relative_coupled", 5.0, 8.0),
    "push_up": ("relative_coupled", 5.5, 8.0),
    "dip": ("relative_coupled", 5.5, 10.0),
    "row": ("relative_coupled", 6.0, 12.0),
    "open_elbow_row": ("relative_coupled", 6.0, 12.0),
    "pull_up": ("relative_coupled", 6.0, 10.0),
    "face_pull": ("relative_coupled", 5.0, 8.0),
    "lateral_raise": ("relative_coupled", 4.5, 7.0),
    "y_raise": ("relative_coupled", 4.5, 7.0),
    "fly": ("relative_coupled", 5.0, 8.0),
    "biceps_curl": ("relative_coupled", 4.5, 7.0),
    "triceps_extension": ("relative_coupled", 4.5, 7.0),
    "machine_crunch": ("primary_trunk_motion", 4.5, 0.0),
    "plate_loaded_romanian_deadlift": ("primary_trunk_motion", 4.5, 0.0),
    "hip_thrust": ("primary_trunk_motion", 4.5, 0.0),
    "back_extension": ("primary_trunk_motion", 4.5, 0.0),
    "deadlift": ("primary_trunk_motion", 4.5, 0.0),
    "romanian_deadlift": ("primary_trunk_motion", 4.5, 0.0),
}
DEFAULT_STABILITY = ("disabled", 4.5, 0.0)
TILT_THRESHOLD, MINIMUM_MS, RECOVERY_MS = 4.0, 320, 240
STABILITY_VIEWS = ["side", "rear"]

# Issue codes replaced by the frame-by-frame stability judgment.
SUPERSEDED_CODES = [
    "TORSO_SWAY", "HACK_SQUAT_SUPPORT_SHIFT", "HIP_THRUST_TORSO_SHIFT", "HINGE_TRUNK_CONTROL",
    "MACHINE_CHEST_PRESS_SUPPORT_SHIFT", "HAMMER_ROW_TORSO_COMPENSATION",
    "CHEST_SUPPORTED_ROW_SUPPORT_SHIFT", "PULL_TORSO_COMPENSATION", "PREACHER_CURL_BODY_SWING",
    "ISOLATION_ELBOW_BODY_SWING", "ISOLATION_BODY_SWING", "HIP_ABDUCTION_TORSO_SWAY",
]

ACTION_NAMES = list(ACTIONS)


def group_of(family: str) -> str:
    return "lower_body" if family in LOWER_BODY else "upper_body" if family in UPPER_BODY else "general"


def family_group(family):
    """Body group of a family column."""
    return F.when(family.isin(LOWER_BODY), "lower_body").when(family.isin(UPPER_BODY), "upper_body").otherwise("general")


def action_dim(spark: SparkSession) -> DataFrame:
    """One row per action: position, family, group, body part, stability profile."""
    rows = []
    for no, (name, (family, body)) in enumerate(ACTIONS.items()):
        mode, angle, coupled = STABILITY.get(name, DEFAULT_STABILITY)
        rows.append((no, name, family, group_of(family), body, mode, angle, TILT_THRESHOLD, MINIMUM_MS, RECOVERY_MS, coupled))
    return spark.createDataFrame(
        rows,
        "action_no int, action_type string, family string, body_group string, body_part string, mode string, "
        "angle_threshold double, tilt_threshold double, minimum_ms int, recovery_ms int, max_coupled_angle double",
    )


def camera_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CAMERAS)), "camera_no int, camera_angle string")


def with_dim(df: DataFrame, dim: DataFrame, key: str, default: str) -> DataFrame:
    """Join a constant-size dimension; unknown keys take the default row."""
    known = dim.select(key)
    checked = df.join(known.withColumn("_known", F.lit(True)), key, "left")
    checked = checked.withColumn(key, F.when(F.col("_known"), F.col(key)).otherwise(F.lit(default))).drop("_known")
    return checked.join(dim, key, "left")
