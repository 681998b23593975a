"""Queries of geo-aligned sampling, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import geo
from .pooling import rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CENTRES = "SELECT patch_id, CAST(r AS INT) AS row, CAST(k AS INT) AS col, c + (k + 0.5) * a + (r + 0.5) * b AS x, f + (k + 0.5) * d + (r + 0.5) * e AS y FROM (SELECT *, unnest(range(w)) AS k FROM (SELECT *, unnest(range(h)) AS r FROM affine))"
CENTRE = "SELECT patch_id, c + w / 2.0 * a + h / 2.0 * b AS x, f + w / 2.0 * d + h / 2.0 * e AS y FROM affine"
BOX = "SELECT patch_id, c AS xmin, f + h * e AS ymin, c + w * a AS xmax, f AS ymax FROM affine"
CELL = 1000.0
#: The tile that points are gathered from.
TILE = {"a": 10.0, "c": 2000.0, "e": -10.0, "f": 9000.0}

QUERIES["pixel_centres"] = lambda spark, d: geo.pixel_centres(fx.affine(spark, d))
ORACLES["pixel_centres"] = f"WITH {fx.AFFINE} {CENTRES}"
QUERIES["patch_centre"] = lambda spark, d: geo.patch_centre(fx.affine(spark, d))
ORACLES["patch_centre"] = f"WITH {fx.AFFINE} {CENTRE}"
QUERIES["patch_bbox"] = lambda spark, d: geo.patch_box(fx.affine(spark, d))
ORACLES["patch_bbox"] = f"WITH {fx.AFFINE} {BOX}"
QUERIES["tile_group"] = lambda spark, d: geo.tile_groups(fx.affine(spark, d), CELL)
ORACLES["tile_group"] = f"""WITH {fx.AFFINE}, m AS ({CENTRE}) SELECT CAST(floor(x / {CELL}) AS BIGINT) AS tx, CAST(floor(y / {CELL}) AS BIGINT) AS ty, count(*) AS patches,
min(patch_id) AS first_patch, max(patch_id) AS last_patch FROM m GROUP BY 1, 2"""


def world_to_rowcol(spark, d):
    return geo.world_to_rowcol(geo.pixel_centres(fx.affine(spark, d)).select("patch_id", "x", "y"), **TILE)


ROWCOL = f"SELECT patch_id, x, y, CAST(floor((x - {TILE['c']}) / {TILE['a']}) AS BIGINT) AS col, CAST(floor((y - {TILE['f']}) / {TILE['e']}) AS BIGINT) AS row FROM (SELECT patch_id, x, y FROM ({CENTRES}))"
QUERIES["world_to_rowcol"] = world_to_rowcol
ORACLES["world_to_rowcol"] = f"WITH {fx.AFFINE} {ROWCOL}"


def tile_gather(spark, d):
    """Values of a 300 x 300 tile made from the parts, at every pixel's centre."""
    k = F.col("p_partkey")
    tile = fx.table(spark, d, "part").select(F.explode(F.sequence(F.lit(0), F.lit(44))).alias("i"), k, "p_retailprice").select(
        F.expr("(p_partkey * 45 + i) div 300 % 300").alias("row"), F.expr("(p_partkey * 45 + i) % 300").alias("col"), F.col("p_retailprice").alias("v"))
    tile = tile.groupBy("row", "col").agg(F.max("v").alias("v"))
    return geo.gather(world_to_rowcol(spark, d), tile).select("patch_id", "row", "col", "v")


QUERIES["tile_gather"] = tile_gather
ORACLES["tile_gather"] = f"""WITH {fx.AFFINE}, tile AS (SELECT (p_partkey * 45 + i) // 300 % 300 AS row, (p_partkey * 45 + i) % 300 AS col, max(p_retailprice) AS v FROM (SELECT *, unnest(range(45)) AS i FROM part) GROUP BY 1, 2),
pts AS ({ROWCOL}) SELECT patch_id, row, col, coalesce(v, 0.0) AS v FROM pts LEFT JOIN tile USING (row, col)"""


def scene_first(spark, d):
    return geo.first_scene(geo.patch_box(fx.affine(spark, d)), fx.scenes(spark, d), 1998, 500.0)


QUERIES["scene_first"] = scene_first
ORACLES["scene_first"] = f"""WITH {fx.AFFINE}, {fx.SCENES}, box AS ({BOX}) SELECT patch_id, scene_id FROM (
SELECT p.patch_id, s.scene_id, row_number() OVER (PARTITION BY p.patch_id ORDER BY s.ts, s.scene_id) AS n FROM box p JOIN scenes s
ON s.ts >= TIMESTAMP '1998-01-01' AND s.ts < TIMESTAMP '1999-01-01' AND p.xmin < s.xmax AND s.xmin < p.xmax AND p.ymin < s.ymax AND s.ymin < p.ymax) WHERE n = 1"""


def _resampled(size: int, half: bool):
    def query(spark, d):
        return rounded(geo.resample_nearest(fx.patch44(spark, d), size, half).select("patch_id", "y", "x", "band", F.col("v").alias("value")))

    return query


def _resample_sql(size: int, off: float) -> str:
    return f"""WITH {fx.PATCH44}, t AS (SELECT CAST(t AS INT) AS dst, CAST(floor((t + {off}) * 4 / {size}) AS INT) AS src FROM (SELECT unnest(range({size})) AS t))
SELECT patch_id, a.dst AS y, b.dst AS x, band, round(v, 6) + 0.0 AS value FROM patch44 JOIN t a ON a.src = y JOIN t b ON b.src = x"""


QUERIES |= {"resample_nearest": _resampled(6, True), "upsample_nearest": _resampled(8, False)}
ORACLES |= {"resample_nearest": _resample_sql(6, 0.5), "upsample_nearest": _resample_sql(8, 0.0)}
QUERIES["flip_x"] = lambda spark, d: rounded(geo.flip_x(fx.patch44(spark, d)).select("patch_id", "y", "x", "band", F.col("v").alias("value")))
ORACLES["flip_x"] = f"WITH {fx.PATCH44} SELECT patch_id, y, 3 - x AS x, band, round(v, 6) + 0.0 AS value FROM patch44"


def band_select(spark, d):
    rows = fx.pixels44(spark, d).withColumn("vec", geo.select_bands(F.col("vec"), (3, 2, 1)))
    return rounded(rows.select("patch_id", "y", "x", F.posexplode("vec").alias("ord", "v")).select("patch_id", "y", "x", "ord", F.col("v").cast("double").alias("value")))


QUERIES["band_select"] = band_select
ORACLES["band_select"] = f"WITH {fx.PATCH44} SELECT patch_id, y, x, 3 - band AS ord, round(v, 6) + 0.0 AS value FROM patch44 WHERE band > 0"
