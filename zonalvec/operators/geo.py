"""Geo-aligned sampling as projections and joins. Transforms are (a, b, c, d, e, f): x = c + col a + row b, y = f + col d + row e."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pixel_centres(grids: DataFrame) -> DataFrame:
    """(patch_id, row, col, x, y) of every pixel's centre."""
    cells = grids.select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("col"))
    x = F.col("c") + (F.col("col") + 0.5) * F.col("a") + (F.col("row") + 0.5) * F.col("b")
    y = F.col("f") + (F.col("col") + 0.5) * F.col("d") + (F.col("row") + 0.5) * F.col("e")
    return cells.select("patch_id", "row", "col", x.alias("x"), y.alias("y"))


def _at(col: Column, row: Column) -> tuple[Column, Column]:
    return F.col("c") + col * F.col("a") + row * F.col("b"), F.col("f") + col * F.col("d") + row * F.col("e")


def patch_centre(grids: DataFrame) -> DataFrame:
    x, y = _at(F.col("w") / 2, F.col("h") / 2)
    return grids.select("patch_id", x.alias("x"), y.alias("y"))


def patch_box(grids: DataFrame) -> DataFrame:
    """(patch_id, xmin, ymin, xmax, ymax) from the four corners."""
    corners = [_at(c, r) for c in (F.lit(0), F.col("w")) for r in (F.lit(0), F.col("h"))]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return grids.select("patch_id", F.least(*xs).alias("xmin"), F.least(*ys).alias("ymin"), F.greatest(*xs).alias("xmax"), F.greatest(*ys).alias("ymax"))


def tile_key(x: Column, y: Column, cell: float) -> list[Column]:
    return [F.floor(x / cell).cast("long").alias("tx"), F.floor(y / cell).cast("long").alias("ty")]


def tile_groups(grids: DataFrame, cell: float) -> DataFrame:
    """(tx, ty, patches, first_patch, last_patch): patches per tile, by their centres."""
    keyed = patch_centre(grids).select("patch_id", *tile_key(F.col("x"), F.col("y"), cell))
    return keyed.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("patches"), F.min("patch_id").alias("first_patch"), F.max("patch_id").alias("last_patch"))


def world_to_rowcol(points: DataFrame, a: float, c: float, e: float, f: float, b: float = 0.0, d: float = 0.0) -> DataFrame:
    """points (.., x, y) with ``row`` and ``col`` in a tile of the given transform (inverse, floor)."""
    det = a * e - b * d
    dx, dy = F.col("x") - c, F.col("y") - f
    return points.withColumn("col", F.floor((dx * e - dy * b) / det).cast("long")).withColumn("row", F.floor((dy * a - dx * d) / det).cast("long"))


def gather(points: DataFrame, tile: DataFrame) -> DataFrame:
    """points (.., row, col) with the tile's value there; 0 outside the tile."""
    return points.join(tile.select("row", "col", "v"), ["row", "col"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def overlapping(boxes: DataFrame, scenes: DataFrame, cell: float) -> DataFrame:
    """All columns of both, as structs ``p`` and ``s``, of every pair whose boxes overlap (touching edges do not), once each.

    A box is keyed at the level of its own size: cells of level l are cell * 2**l wide, and no box is wider than its level's cells, so
    it touches four of them at most, be it a field or a continent. Pairs meet at the coarser box's level: the finer one
    is also keyed at those coarser levels that occur on the other side (a list of some tens of numbers). Of the cells that both touch
    only the one with the lower corner of the common area gives the pair. A box with a null or non-finite corner overlaps nothing.
    """
    corners = ("xmin", "ymin", "xmax", "ymax")

    def levelled(df: DataFrame, name: str) -> DataFrame:
        size = F.greatest(F.abs(F.col("xmax") - F.col("xmin")), F.abs(F.col("ymax") - F.col("ymin")))
        finite = df.filter(" and ".join(f"abs({c}) < double('infinity')" for c in corners))
        level = F.when(size > cell, F.ceil(F.log2(size / cell))).otherwise(F.lit(0)).cast("int")
        return finite.select(F.struct("*").alias(name), *corners, level.alias("_level"))

    def keyed(df: DataFrame, name: str, level: Column) -> DataFrame:
        at = df.select(name, *corners, level.alias("_at")).withColumn("_side", cell * F.pow(F.lit(2.0), F.col("_at")))
        touched = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / F.col("_side")), F.floor(F.col(hi) / F.col("_side"))))
        kept = [F.col(c).alias(f"_{name}_{c}") for c in corners]
        return at.select("*", touched("xmin", "xmax").alias("_tx")).select(name, *kept, "_at", "_side", "_tx", touched("ymin", "ymax").alias("_ty"))

    def levels(df: DataFrame) -> list[int]:
        return sorted(r["_level"] for r in df.select("_level").distinct().collect())  # some tens: a level is a power of two

    def met(df: DataFrame, name: str, at: list[int], equal: bool) -> DataFrame:
        chosen = F.filter(F.array(*map(F.lit, at)), lambda x: (x >= F.col("_level")) if equal else (x > F.col("_level")))
        return keyed(df, name, F.explode(chosen))

    p, s = levelled(boxes, "p"), levelled(scenes, "s")
    of_p, of_s = levels(p), levels(s)
    key = ["_at", "_side", "_tx", "_ty"]
    pairs = met(p, "p", of_s or [0], True).join(keyed(s, "s", F.col("_level")), key)
    if of_p and of_s and of_p[-1] > of_s[0]:  # some box is coarser than some scene
        pairs = pairs.unionByName(keyed(p, "p", F.col("_level")).join(met(s, "s", of_p, False), key))
    own = {(side, c): F.col(f"_{side}_{c}") for side in "ps" for c in corners}
    overlap = (own["p", "xmin"] < own["s", "xmax"]) & (own["s", "xmin"] < own["p", "xmax"]) & (own["p", "ymin"] < own["s", "ymax"]) & (own["s", "ymin"] < own["p", "ymax"])
    corner = [F.floor(F.greatest(own["p", c], own["s", c]) / F.col("_side")) == F.col(t) for c, t in (("xmin", "_tx"), ("ymin", "_ty"))]
    return pairs.filter(overlap & corner[0] & corner[1]).select("p", "s")


def first_scene(boxes: DataFrame, scenes: DataFrame, year: int, cell: float) -> DataFrame:
    """(patch_id, scene_id): each box's first scene (by time, then id) of a year whose box overlaps it. ``cell``: see ``overlapping``."""
    inside = scenes.filter((F.col("ts") >= F.lit(f"{year}-01-01").cast("timestamp")) & (F.col("ts") < F.lit(f"{year + 1}-01-01").cast("timestamp")))
    first = F.min(F.struct(F.col("s.ts"), F.col("s.scene_id").alias("scene_id"))).alias("m")
    pairs = overlapping(boxes.select("patch_id", "xmin", "ymin", "xmax", "ymax"), inside.select("scene_id", "ts", "xmin", "ymin", "xmax", "ymax"), cell)
    return pairs.groupBy(F.col("p.patch_id").alias("patch_id")).agg(first).select("patch_id", F.col("m.scene_id").alias("scene_id"))


def resample_nearest(rows: DataFrame, size: int, half_pixel: bool = True) -> DataFrame:
    """Long rows on a size x size grid by nearest neighbour: src = floor((dst + .5) n_in / size), or floor(dst n_in / size).

    Each source pixel is copied to the targets that fall on it, so nothing is joined.
    """
    off = 0.5 if half_pixel else 0.0

    def targets(src: str, n: str) -> Column:
        return F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda t: F.floor((t + off) * F.col(n) / size) == F.col(src))

    out = rows.select("*", F.explode(targets("y", "h")).alias("ty")).select("*", F.explode(targets("x", "w")).alias("tx"))
    return out.select("patch_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "band", "v", F.lit(size).alias("h"), F.lit(size).alias("w"), "d")


def flip_x(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", F.col("w") - 1 - F.col("x"))


def select_bands(vector: Column, bands: tuple[int, ...]) -> Column:
    """Bands by number, in the order given."""
    return F.transform(F.array(*map(F.lit, bands)), lambda i: F.get(vector, i))
