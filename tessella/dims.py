"""Dimension tables.  The values are fixed: results depend on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Allowed variation of height and silhouette, and anchor drift in pixels, by action.
THRESHOLDS = [
    ("idle", 0.14, 0.12, 1),
    ("walk", 0.12, 0.20, 1),
    ("attack", 0.30, 0.45, 1),
    ("hurt", 0.30, 0.35, 1),
    ("death", None, None, None),
    ("cast", 0.30, 0.45, 3),
    ("travel", 0.40, 0.60, 4),
    ("impact", None, None, None),
    ("loop", 0.20, 0.30, 2),
]
# Exceptions by way of moving.
MOVING_THRESHOLDS = [("legless", "walk", None, None, 1), ("floating", "walk", None, None, 1)]
# Factor on the two variations by direction; every other direction has 1.
DIRECTION_FACTOR = {"up": 1.3}

# Severity of each check, and what repairs it.
CHECKS = [
    ("artifact_exists", "fatal", "regenerate"),
    ("artifact_hash", "fatal", "regenerate"),
    ("frame_count", "fatal", "regenerate"),
    ("frame_size", "fatal", "local"),
    ("blank_frame", "fatal", "regenerate"),
    ("cell_overflow", "fatal", "regenerate"),
    ("content_bounds", "high", "regenerate"),
    ("palette_membership", "high", "local"),
    ("transparent_rgb_residue", "fatal", "local"),
    ("partial_alpha", "high", "local"),
    ("isolated_pixel", "medium", "local"),
    ("key_color_residue", "high", "none"),
    ("frame_order_continuity", "low", "regenerate"),
    ("beat_signature", "medium", "regenerate"),
    ("mirror_flip", "medium", "regenerate"),
    ("anchor_drift", "high", "local"),
    ("height_variation", "medium", "none"),
    ("silhouette_variation", "medium", "none"),
    ("palette_overflow", "medium", "local"),
    ("duplicate_frame_exact", "medium", "none"),
    ("duplicate_frame_approx", "low", "none"),
    ("static_animation", "medium", "regenerate"),
    ("tile_seam", "fatal", "none"),
    ("tile_border", "fatal", "none"),
    ("tile_adjacency", "high", "none"),
    ("tile_terrain", "high", "none"),
    ("map_adjacency", "fatal", "none"),
]
SEVERITIES = [("low", 0), ("medium", 1), ("high", 2), ("fatal", 3)]

# Legal moves of a job, (status, event, next status).
TRANSITIONS = [
    ("PLANNED", "START_EXECUTION", "GENERATING"),
    ("PLANNED", "CACHE_HIT", "GENERATED"),
    ("PLANNED", "DERIVE_READY", "GENERATED"),
    ("GENERATING", "PROVIDER_SUCCESS", "GENERATED"),
    ("PROCESSING", "RECOVER_GENERATED", "GENERATED"),
    ("GENERATING", "TRANSIENT_ERROR", "GENERATING"),
    ("GENERATING", "PERMANENT_ERROR", "FAILED"),
    ("GENERATING", "RETRY_LIMIT_EXCEEDED", "FAILED"),
    ("GENERATED", "START_PROCESSING", "PROCESSING"),
    ("PROCESSING", "PROCESSING_DONE", "PROCESSED"),
    ("PROCESSING", "PROCESSING_ERROR", "FAILED"),
    ("PROCESSED", "START_VALIDATION", "VALIDATING"),
    ("VALIDATED", "START_VALIDATION", "VALIDATING"),
    ("EXPORTED", "START_VALIDATION", "VALIDATING"),
    ("VALIDATION_FAILED", "START_VALIDATION", "VALIDATING"),
    ("VALIDATING", "VALIDATION_PASSED", "VALIDATED"),
    ("VALIDATING", "VALIDATION_FAILED", "VALIDATION_FAILED"),
    ("VALIDATION_FAILED", "PLAN_REPAIR", "REPAIRING"),
    ("VALIDATION_FAILED", "REPAIR_LIMIT_EXCEEDED", "FAILED"),
    ("REPAIRING", "REPAIR_LOCAL", "PROCESSING"),
    ("REPAIRING", "REPAIR_REGENERATE_GRID", "GENERATING"),
    ("REPAIRING", "REPAIR_REGENERATE_SEED", "PLANNED"),
    ("VALIDATED", "REQUIRE_APPROVAL", "AWAITING_APPROVAL"),
    ("AWAITING_APPROVAL", "APPROVE", "APPROVED"),
    ("AWAITING_APPROVAL", "REJECT", "PLANNED"),
    ("VALIDATED", "EXPORT", "EXPORTED"),
]

# Key colours in order of preference, and the words that rule them out.
KEY_COLORS = {
    "#FF00FF": ["magenta", "pink", "violet", "purple", "fuchsia", "lilac", "mauve", "洋红", "品红", "粉", "紫"],
    "#00FF00": ["green", "lime", "emerald", "jade", "olive", "moss", "绿"],
    "#00FFFF": ["cyan", "aqua", "turquoise", "teal", "azure", "青", "蓝绿"],
}
# Words that tell how a figure moves, in order.
MOVING = {
    "legless": ["slime", "blob", "ooze", "jelly", "pudding", "snake", "serpent", "worm", "caterpillar", "snail", "史莱姆", "黏液", "软泥", "蛇"],
    "floating": ["ghost", "spirit", "wraith", "phantom", "eyeball", "floating", "hovering", "levitating", "cloud", "wisp", "orb", "幽灵", "魂", "漂浮", "悬浮"],
    "quadruped": ["wolf", "dog", "cat", "horse", "boar", "bear", "spider", "lizard", "beetle", "crab", "quadruped", "four-legged", "狼", "犬", "猫", "马", "熊", "蜘蛛", "四足"],
}
# Words for what breaks left-right symmetry, and what negates them.
ASYMMETRIC = ["sword", "shield", "axe", "bow", "staff", "wand", "spear", "lance", "hammer", "dagger", "quiver", "eyepatch", "satchel", "holster", "剑", "盾", "斧", "弓", "法杖", "矛", "锤", "匕首", "箭袋", "眼罩"]
NEGATIONS = ["no ", "without ", "not ", "无", "没有", "不带"]

# Frames to columns and rows; limits on the size of a generated image.
GRIDS = [(4, 2, 2), (6, 3, 2), (8, 4, 2), (9, 3, 3), (12, 4, 3)]
SIZE_MULTIPLE, MAX_RATIO, MIN_PIXELS, MAX_PIXELS, MAX_SIDE = 16, 3.0, 655_360, 8_294_400, 3840
# Frames, frames a second, loop, directional, by action.
ACTIONS = [
    ("idle", 4, 6, True, True),
    ("walk", 8, 10, True, True),
    ("attack", 6, 12, False, True),
    ("hurt", 4, 8, False, True),
    ("death", 8, 8, False, True),
    ("cast", 6, 10, False, True),
    ("travel", 4, 12, True, True),
    ("impact", 6, 15, False, False),
    ("loop", 4, 8, True, False),
]


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension as a DataFrame; dimensions have a fixed number of rows, so broadcast them."""
    return spark.createDataFrame(rows, schema)


def thresholds(spark: SparkSession) -> DataFrame:
    return table(spark, THRESHOLDS, "action string, height_max double, silhouette_max double, drift_max int")


def moving_thresholds(spark: SparkSession) -> DataFrame:
    return table(spark, MOVING_THRESHOLDS, "moving string, action string, height_max double, silhouette_max double, drift_max int")


def checks(spark: SparkSession) -> DataFrame:
    return table(spark, CHECKS, "id string, severity string, repair string")


def transitions(spark: SparkSession) -> DataFrame:
    return table(spark, TRANSITIONS, "status string, event string, next string")

#: What is taken for a secret in a text, and what of it stays.
REDACTIONS = [
    (r"\bsk-[A-Za-z0-9_\-]{8,}", ""),
    (r"(?i)\bbearer\s+[A-Za-z0-9._\-]{8,}", ""),
    (r"""(?i)(api[_-]?key\s*[=:]\s*)[^\s,;"']{8,}""", "$1"),
]
