"""Queries of training-free pooling, codecs and cleaning, with SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import codecs
from ..operators import pool

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def rounded(df, column: str = "value", digits: int = 6):
    """Rounded values; -0.0 becomes 0.0, as sums in another order may have either sign."""
    return df.withColumn(column, F.round(column, digits) + F.lit(0.0))


def _pooled(method: str):
    def query(spark, d):
        return rounded(pool.pool_long(fx.patch44(spark, d), pool.POOLERS[method])).select("patch_id", "ord", "value")

    return query


def _blocks(*blocks: str) -> str:
    """SQL of a pooler: aggregates over a band, one block after the other."""
    parts = " UNION ALL ".join(f"SELECT patch_id, CAST({i} * 4 + band AS INT) AS ord, round({b}, 6) + 0.0 AS value FROM patch44 GROUP BY patch_id, band" for i, b in enumerate(blocks))
    return f"WITH {fx.PATCH44} {parts}"


GEM = "sign(avg(sign(v) * pow(abs(v), 3.0))) * pow(abs(avg(sign(v) * pow(abs(v), 3.0))), 1.0 / 3.0)"
HALF = "pow(avg(pow(greatest({s}v, 1e-6), 3.0)), 1.0 / 3.0)"
CENTRE = "exp(-(pow(x - 1.5, 2) + pow(y - 1.5, 2)) / 2.0)"
SQL_BLOCKS = {
    "pool_mean": ("mean", ["avg(v)"]), "pool_std": ("std", ["stddev_pop(v)"]), "pool_max": ("max", ["max(v)"]), "pool_min": ("min", ["min(v)"]),
    "pool_mean_std": ("mean_std", ["avg(v)", "stddev_pop(v)"]), "pool_stats": ("stats", ["min(v)", "max(v)", "avg(v)", "stddev_pop(v)"]), "pool_mean_max": ("mean_max", ["avg(v)", "max(v)"]),
    "pool_gem": ("gem", [GEM]), "pool_signed_gem": ("signed_non_cancelling_gem", [HALF.format(s=""), HALF.format(s="-")]),
    "pool_percentiles": ("percentiles", [f"quantile_cont(v, {q})" for q in (0.1, 0.25, 0.5, 0.75, 0.9)]),
    "pool_center_weighted": ("center_weighted_mean", [f"sum({CENTRE} * v) / sum({CENTRE})"]),
    "pool_median_iqr": ("median_iqr", ["quantile_cont(v, 0.5)", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)"]),
}
for _name, (_method, _sql) in SQL_BLOCKS.items():
    QUERIES[_name] = _pooled(_method)
    ORACLES[_name] = _blocks(*_sql)


def pool_cov(spark, d):
    return rounded(pool.covariance(fx.patch55(spark, d))).select("patch_id", "ord", "value")


def zone_pixels(spark, d):
    """Line items as pixels of four bands in their supplier's zone."""
    bands = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return fx.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("patch_id"), bands.alias("vec"))


def pool_cov_moments(spark, d):
    """The zones' covariance of four bands, whose pixels are in no order: an average zone has hundreds of pixels."""
    return rounded(pool.covariance(zone_pixels(spark, d)), digits=4).select("patch_id", "ord", "value")


def pool_cov_pairs(spark, d):
    """Of pixels of four bands, as exploded pairs."""
    return rounded(pool.covariance_by_pairs(fx.pixels44(spark, d))).select("patch_id", "ord", "value")


COV = f"""WITH {fx.PATCH55}, long AS (SELECT patch_id, y, x, i, CAST(vec[i + 1] AS DOUBLE) AS v FROM (SELECT *, unnest(range(64)) AS i FROM patch55))
SELECT a.patch_id, CAST(a.i * 64 - a.i * (a.i - 1) // 2 + b.i - a.i AS INT) AS ord, round(coalesce(covar_samp(a.v, b.v), 'NaN'::DOUBLE), 6) + 0.0 AS value
FROM long a JOIN long b ON a.patch_id = b.patch_id AND a.y = b.y AND a.x = b.x AND a.i <= b.i GROUP BY a.patch_id, a.i, b.i"""
ZONE_BANDS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
COV_ZONES = " UNION ALL ".join(
    f"SELECT l_suppkey AS patch_id, CAST({i * 4 - i * (i - 1) // 2 + j - i} AS INT) AS ord, round(coalesce(covar_samp(CAST({ZONE_BANDS[i]} AS DOUBLE), CAST({ZONE_BANDS[j]} AS DOUBLE)), 'NaN'::DOUBLE), 4) + 0.0 AS value FROM lineitem GROUP BY l_suppkey"
    for i in range(4) for j in range(i, 4)
)
COV_PAIRS = f"""WITH {fx.PATCH44} SELECT a.patch_id, CAST(a.band * 4 - a.band * (a.band - 1) // 2 + b.band - a.band AS INT) AS ord, round(covar_samp(a.v, b.v), 6) + 0.0 AS value
FROM patch44 a JOIN patch44 b ON a.patch_id = b.patch_id AND a.y = b.y AND a.x = b.x AND a.band <= b.band GROUP BY a.patch_id, a.band, b.band"""
QUERIES |= {"pool_cov": pool_cov, "pool_cov_moments": pool_cov_moments, "pool_cov_pairs": pool_cov_pairs}
ORACLES |= {"pool_cov": COV, "pool_cov_moments": COV_ZONES, "pool_cov_pairs": COV_PAIRS}


def pool_percentiles_approx(spark, d):
    """Zones' percentiles from sketches; an accuracy above every zone's size makes them the exact lower values."""
    return rounded(pool.pool_long(fx.zones(spark, d), pool.percentiles(accuracy=100_000))).withColumnRenamed("patch_id", "zone_id").select("zone_id", "ord", "value")


QUERIES["pool_percentiles_approx"] = pool_percentiles_approx
ORACLES["pool_percentiles_approx"] = f"WITH {fx.ZONES} " + " UNION ALL ".join(
    f"SELECT patch_id AS zone_id, CAST({i} * 4 + band AS INT) AS ord, round(quantile_disc(v, {q}), 6) + 0.0 AS value FROM zones GROUP BY patch_id, band" for i, q in enumerate((0.1, 0.25, 0.5, 0.75, 0.9))
)


def pool_all_onepass(spark, d):
    """Every pooler that needs no pixel grid, over the ragged zones, from one scan."""
    return rounded(pool.pool_many(fx.zones(spark, d), [pool.POOLERS[m] for m, _ in ONE_PASS.values()]), digits=4).select("method", F.col("patch_id").alias("zone_id"), "ord", "value")


ONE_PASS = {k: v for k, v in SQL_BLOCKS.items() if k != "pool_center_weighted"}
QUERIES["pool_all_onepass"] = pool_all_onepass
ORACLES["pool_all_onepass"] = f"WITH {fx.ZONES} " + " UNION ALL ".join(
    f"SELECT '{m}' AS method, patch_id AS zone_id, CAST({i} * 4 + band AS INT) AS ord, round({b}, 4) + 0.0 AS value FROM zones GROUP BY patch_id, band" for m, blocks in ONE_PASS.values() for i, b in enumerate(blocks)
)

ALL_METHODS = [*pool.TRAINING_FREE, *pool.FITTED]


def pool_output_dim(spark, d):
    """Width of every method for the grids' own number of bands, and the values that pooling all grids makes."""
    size = fx.patch44(spark, d).agg((F.max("band") + 1).alias("d"), F.countDistinct("patch_id").alias("patches"))
    names = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(len(pool.POOLERS[m].blocks) if m in pool.POOLERS else 0).alias("blocks"), F.lit(pool.FITTED.get(m, 0)).alias("fixed")) for m in ALL_METHODS]))
    dim = F.when(F.col("m.fixed") > 0, F.col("m.fixed")).when(F.col("m.method") == pool.COVARIANCE, F.expr("d * (d + 1) div 2")).otherwise(F.col("m.blocks") * F.col("d")).cast("long")
    return size.select("d", "patches", names.alias("m")).select("m.method", dim.alias("dim"), (dim * F.col("patches")).alias("values"))


_DIMS = {m: (str(pool.FITTED[m]) if m in pool.FITTED else "d * (d + 1) // 2" if m == pool.COVARIANCE else f"{len(pool.POOLERS[m].blocks)} * d") for m in ALL_METHODS}
QUERIES["pool_output_dim"] = pool_output_dim
ORACLES["pool_output_dim"] = f"WITH {fx.PATCH44}, n AS (SELECT max(band) + 1 AS d, count(DISTINCT patch_id) AS patches FROM patch44) " + " UNION ALL ".join(
    f"SELECT '{m}' AS method, CAST({e} AS BIGINT) AS dim, CAST({e} AS BIGINT) * patches AS values FROM n" for m, e in _DIMS.items()
)


def pool_registry(spark, d):
    """The method catalogue with the number of grids each would pool."""
    kind = lambda m: "pca" if m.startswith("pca") else "bovw" if m.startswith("bovw") else "training-free"
    names = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(kind(m)).alias("family")) for m in ALL_METHODS]))
    return fx.patches(spark, d).agg(F.count(F.lit(1)).alias("patches")).select(names.alias("m"), "patches").select("m.method", "m.family", "patches")


QUERIES["pool_registry"] = pool_registry
ORACLES["pool_registry"] = " UNION ALL ".join(
    f"SELECT '{m}' AS method, '{'pca' if m.startswith('pca') else 'bovw' if m.startswith('bovw') else 'training-free'}' AS family, count(*) AS patches FROM embeddings" for m in ALL_METHODS
)


def avg_pixel_std(spark, d):
    return rounded(pool.average_deviation(fx.patch44(spark, d)))


QUERIES["avg_pixel_std"] = avg_pixel_std
ORACLES["avg_pixel_std"] = f"WITH {fx.PATCH44} SELECT patch_id, round(avg(s), 6) + 0.0 AS value FROM (SELECT patch_id, band, stddev_pop(v) AS s FROM patch44 GROUP BY ALL) GROUP BY patch_id"


def custom_pooler(spark, d):
    """A caller's own function: range of each band."""
    out = pool.custom(fx.pixels44(spark, d), lambda x: x.max(0) - x.min(0), 4)
    return rounded(out.select("patch_id", F.posexplode("features").alias("ord", "value")))


QUERIES["custom_pooler"] = custom_pooler
ORACLES["custom_pooler"] = _blocks("max(v) - min(v)")


def custom_mergeable(spark, d):
    """A caller's own function with states that merge: range of each band, from the least and greatest of any parts."""
    extremes = pool.Mergeable(
        lambda x: np.r_[x.min(0), x.max(0)], lambda s: np.r_[s[:, : s.shape[1] // 2].min(0), s[:, s.shape[1] // 2 :].max(0)], lambda s: s[len(s) // 2 :] - s[: len(s) // 2], 4
    )
    out = pool.custom_mergeable(zone_pixels(spark, d), extremes)
    return rounded(out.select("patch_id", F.posexplode("features").alias("ord", "value")))


QUERIES["custom_mergeable"] = custom_mergeable
ORACLES["custom_mergeable"] = f"WITH {fx.ZONES} SELECT patch_id, band AS ord, round(max(v) - min(v), 6) + 0.0 AS value FROM zones GROUP BY patch_id, band"

# -- codecs -----------------------------------------------------------------------------------------------


def quantise_power(spark, d):
    return fx.patch44(spark, d).select("patch_id", "y", "x", "band", codecs.quantise_power(F.col("v")).cast("int").alias("value"))


QUERIES["quantise_power"] = quantise_power
ORACLES["quantise_power"] = f"WITH {fx.PATCH44} SELECT patch_id, y, x, band, CAST(greatest(-127, least(127, round_even(sign(v) * pow(abs(v), 0.5) * 127.5, 0))) + 127 AS INT) AS value FROM patch44"


def quantise_offset(spark, d):
    return fx.patch44(spark, d).select("patch_id", "y", "x", "band", codecs.quantise_offset(F.floor(F.col("v") * 100).cast("tinyint")).cast("int").alias("value"))


QUERIES["quantise_offset"] = quantise_offset
ORACLES["quantise_offset"] = f"WITH {fx.PATCH44} SELECT patch_id, y, x, band, CAST(floor(v * 100) AS INT) + 128 AS value FROM patch44"


def recode_u8(spark, d):
    return fx.patch44(spark, d).select("patch_id", "y", "x", "band", codecs.recode_u8(F.floor((F.col("v") + 1) * 100)).cast("int").alias("value"))


QUERIES["recode_u8"] = recode_u8
ORACLES["recode_u8"] = f"WITH {fx.PATCH44} SELECT patch_id, y, x, band, CAST(floor((v + 1) * 100) AS INT) AS value FROM patch44"


def _damaged(spark, d):
    """Features with NaN and infinities put in: where the row's number and the position fit."""
    r, i = F.col("vec_id"), lambda i: (F.col("vec_id") + i)
    bad = lambda x, p: F.when(i(p) % 97 == 0, F.lit(float("nan"))).when(i(p) % 89 == 0, F.lit(float("inf"))).when(i(p) % 83 == 0, F.lit(float("-inf"))).otherwise(x.cast("double"))
    return fx.table(spark, d, "embeddings").select(r, F.transform("embedding", bad).alias("features"))


_DAMAGED = """bad AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 97 = 0 THEN 'NaN'::DOUBLE WHEN (vec_id + i) % 89 = 0 THEN 'inf'::DOUBLE WHEN (vec_id + i) % 83 = 0 THEN '-inf'::DOUBLE
 ELSE CAST(embedding[i + 1] AS DOUBLE) END AS v FROM (SELECT *, unnest(range(64)) AS i FROM embeddings))"""


def sanitize(spark, d):
    rows = _damaged(spark, d).select("vec_id", F.posexplode(codecs.sanitize(F.col("features"))).alias("ord", "value"))
    return rounded(rows)


def sanitize_count(spark, d):
    return _damaged(spark, d).agg(F.sum(codecs.odd_values(F.col("features"))).alias("replaced"))


QUERIES |= {"sanitize": sanitize, "sanitize_count": sanitize_count}
ORACLES["sanitize"] = f"WITH {_DAMAGED} SELECT vec_id, CAST(i AS INT) AS ord, round(CASE WHEN isfinite(v) THEN v ELSE 0 END, 6) + 0.0 AS value FROM bad"
ORACLES["sanitize_count"] = f"WITH {_DAMAGED} SELECT CAST(sum(CASE WHEN isfinite(v) THEN 0 ELSE 1 END) AS BIGINT) AS replaced FROM bad"


def scale_clip(spark, d):
    return rounded(fx.zones(spark, d).groupBy("patch_id", "band").agg(F.avg(codecs.scale_clip(F.col("v"), 2500.0)).alias("value")).withColumnRenamed("patch_id", "zone_id"))


QUERIES["scale_clip"] = scale_clip
ORACLES["scale_clip"] = f"WITH {fx.ZONES} SELECT patch_id AS zone_id, band, round(avg(greatest(0, least(1, v / 2500.0))), 6) + 0.0 AS value FROM zones GROUP BY ALL"


def minmax_vec(spark, d):
    rows = fx.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    return rounded(rows.select("vec_id", F.posexplode(codecs.minmax_vector(F.col("f"))).alias("ord", "value")))


QUERIES["minmax_vec"] = minmax_vec
ORACLES["minmax_vec"] = """WITH e AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)),
m AS (SELECT vec_id, min(v) AS a, max(v) AS b FROM e GROUP BY vec_id) SELECT vec_id, CAST(i AS INT) AS ord, round((v - a) / (b - a + 1e-8), 6) + 0.0 AS value FROM e JOIN m USING (vec_id)"""


def pct_stretch(spark, d):
    return rounded(codecs.percentile_stretch(fx.patch44(spark, d)).select("patch_id", "y", "x", "band", F.col("v").alias("value")))


QUERIES["pct_stretch"] = pct_stretch
ORACLES["pct_stretch"] = f"""WITH {fx.PATCH44}, q AS (SELECT patch_id, band, quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM patch44 GROUP BY ALL)
SELECT patch_id, y, x, band, round(CASE WHEN b > a THEN greatest(0, least(1, (v - a) / (b - a))) ELSE 0 END, 6) + 0.0 AS value FROM patch44 JOIN q USING (patch_id, band)"""


def vec_slice(spark, d):
    return fx.table(spark, d, "embeddings").select("vec_id", F.posexplode(codecs.vector_slice(F.col("embedding"), 20)).alias("ord", "v")).select("vec_id", "ord", F.round(F.col("v").cast("double"), 6).alias("value"))


QUERIES["vec_slice"] = vec_slice
ORACLES["vec_slice"] = "SELECT vec_id, CAST(i AS INT) AS ord, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS value FROM (SELECT *, unnest(range(20)) AS i FROM embeddings)"


def stride_sample(spark, d):
    return codecs.stride_sample(fx.pixels44(spark, d), 4).select("patch_id", "y", "x")


QUERIES["stride_sample"] = stride_sample
ORACLES["stride_sample"] = "SELECT vec_id AS patch_id, CAST(i // 4 AS INT) AS y, CAST(i % 4 AS INT) AS x FROM (SELECT vec_id, unnest(range(0, 16, 4)) AS i FROM embeddings)"
