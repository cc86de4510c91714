"""Table schemas of the data model and a distributed check of their constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOLUMES = "volume_id STRING, level INT, shape ARRAY<INT>, chunk ARRAY<INT>, um ARRAY<DOUBLE>, dtype STRING"
CHUNKS = "volume_id STRING, level INT, cz INT, cy INT, cx INT, data BINARY"
VOXELS = "volume_id STRING, level INT, z INT, y INT, x INT, v SMALLINT"
STACK = "stack_id STRING, layer INT, y INT, x INT, v SMALLINT"
MESH = "segment STRING, scan STRING, i INT, j INT, x DOUBLE, y DOUBLE, z DOUBLE, valid BOOLEAN"
PATCH_NODES = "run STRING, patch LONG, i INT, j INT, z DOUBLE, y DOUBLE, x DOUBLE, ok BOOLEAN"
PATCHES = "run STRING, patch LONG, n0 ARRAY<DOUBLE>, ts DOUBLE, side STRING"
TRANSFORMS = "key STRING, matrix ARRAY<ARRAY<DOUBLE>>, fixed_volume STRING"
LANDMARKS = "key STRING, idx INT, moving ARRAY<DOUBLE>, fixed ARRAY<DOUBLE>"
MASK = "mask_id STRING, y INT, x INT"
MAPS = "map_id STRING, arm STRING, direction STRING, y INT, x INT, s FLOAT"
SEED_SCORES = (
    "id INT, seed_z INT, seed_y INT, seed_x INT, status STRING, tracked DOUBLE, area_cm2 DOUBLE, frac_a DOUBLE, "
    "frac_b DOUBLE, p995_a DOUBLE, p995_b DOUBLE, stroke_a DOUBLE, stroke_b DOUBLE, secs DOUBLE"
)
SCORES = "window STRING, scroll STRING, segment STRING, band INT, arm STRING, offset INT, auc DOUBLE, pos LONG, neg LONG"
AXIS_POINTS = "scroll STRING, z DOUBLE, y DOUBLE, x DOUBLE"
HIST = "stack_id STRING, layer INT, v INT, n LONG"
PLACEMENT_AUDIT = (
    "segment STRING, status STRING, reference STRING, pairs MAP<STRING, STRUCT<grid_um: DOUBLE, n: INT, "
    "median_ncc0: DOUBLE, median_best: DOUBLE, windows: ARRAY<STRUCT<window_um: ARRAY<LONG>, grid_um: DOUBLE, "
    "ncc0: DOUBLE, best: DOUBLE, layers: INT, dz_range: INT, shift_um: ARRAY<DOUBLE>, skipped: STRING, error: STRING>>>>"
)
TRANSFORM_JSON = (
    "transformation_matrix ARRAY<ARRAY<DOUBLE>>, moving_landmarks ARRAY<ARRAY<DOUBLE>>, "
    "fixed_landmarks ARRAY<ARRAY<DOUBLE>>, fixed_volume STRING"
)


def violations(df: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """One row per broken rule: the key columns plus ``rule``. A rule that is NULL counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]))
    return df.select(*key, F.explode(broken).alias("rule"))
