"""Queries of manifests, loading, sinks and sources, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import pool
from ..sources import manifest as mf
from ..sources import tables
from ..storage import new_folder, shared_dir
from .pooling import rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PARSED = f"""{fx.MANIFEST}, stems AS (SELECT ord, replace(trim(line), '.jpg', '') AS stem FROM manifest WHERE trim(line) <> ''),
parsed AS (SELECT ord, regexp_extract(stem, '^(.*)_([^_]*)$', 1) AS class_name, stem, contains(stem, '_') AS ok FROM stems)"""


def manifest_parse(spark, d):
    return mf.entries(fx.manifest(spark, d))


QUERIES["manifest_parse"] = manifest_parse
ORACLES["manifest_parse"] = f"WITH {PARSED} SELECT ord, class_name || '/' || stem AS rel_path, class_name FROM parsed WHERE ok"


def _splits(spark, d):
    """Manifest entries with their splits: standard by the key, spatial by the part's size."""
    rows = mf.entries(fx.manifest(spark, d)).join(fx.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), "p_size"), "ord")
    role = lambda n: F.when(n < 6, "train").when(n < 8, "val").otherwise("test")
    std = rows.withColumn("split_type", F.lit("standard")).withColumn("role", role(F.col("ord") % 10))
    return std.unionByName(rows.withColumn("split_type", F.lit("spatial")).withColumn("role", role(F.expr("p_size div 5")))).drop("p_size")


_ROLE = "CASE WHEN {n} < 6 THEN 'train' WHEN {n} < 8 THEN 'val' ELSE 'test' END"
SPLITS = f"""{PARSED}, splits AS (SELECT ord, class_name || '/' || stem AS rel_path, class_name, 'standard' AS split_type, {_ROLE.format(n='ord % 10')} AS role FROM parsed WHERE ok
UNION ALL SELECT ord, class_name || '/' || stem, class_name, 'spatial', {_ROLE.format(n='(p_size // 5)')} FROM parsed JOIN part ON p_partkey = ord WHERE ok)"""


def split_select(spark, d):
    return mf.split(_splits(spark, d), "spatial", "val")


QUERIES["split_select"] = split_select
ORACLES["split_select"] = f"WITH {SPLITS} SELECT * FROM splits WHERE split_type = 'spatial' AND role = 'val'"


def label_encode(spark, d):
    return mf.encode_labels(mf.entries(fx.manifest(spark, d)), fx.classes(spark, d)).select("ord", "class_name", "label")


QUERIES["label_encode"] = label_encode
ORACLES["label_encode"] = f"WITH {PARSED}, {fx.CLASSES} SELECT ord, class_name, idx AS label FROM parsed JOIN classes USING (class_name) WHERE ok"


def label_decode(spark, d):
    rows = fx.table(spark, d, "embeddings").select("vec_id", "label")
    return mf.decode_labels(rows, fx.classes(spark, d), strict=False).filter("class_name is not null").select("vec_id", "class_name")


QUERIES["label_decode"] = label_decode
ORACLES["label_decode"] = f"WITH {fx.CLASSES} SELECT vec_id, class_name FROM embeddings JOIN classes ON label = idx"


def _manifest_of_patches(spark, d):
    return _splits(spark, d).filter("split_type = 'standard' and role = 'train'").select("ord", F.col("ord").alias("patch_id"), "class_name")


OF_PATCHES = f"{SPLITS}, wanted AS (SELECT ord, ord AS patch_id, class_name FROM splits WHERE split_type = 'standard' AND role = 'train')"


def load_raw(spark, d):
    grids = fx.patches(spark, d).select("patch_id", "pix")
    rows = mf.load(_manifest_of_patches(spark, d), grids)
    return rounded(rows.select("ord", "patch_id", "class_name", F.posexplode("pix").alias("pos", "v")).select("ord", "patch_id", "class_name", "pos", F.col("v").cast("double").alias("value")))


QUERIES["load_raw"] = load_raw
ORACLES["load_raw"] = f"""WITH {OF_PATCHES}, px AS (SELECT *, unnest(range(64)) AS i FROM embeddings)
SELECT ord, patch_id, class_name, CAST(i AS INT) AS pos, round(CAST(embedding[i + 1] AS DOUBLE), 6) + 0.0 AS value FROM wanted JOIN px ON vec_id = patch_id"""


def load_pooled(spark, d):
    mean = lambda rows: pool.pool_long(rows, pool.POOLERS["mean"]).withColumnRenamed("ord", "pos")
    return rounded(mf.load_pooled(_manifest_of_patches(spark, d), fx.patch44(spark, d), mean)).select("ord", "patch_id", "class_name", "pos", "value")


QUERIES["load_pooled"] = load_pooled
ORACLES["load_pooled"] = f"""WITH {OF_PATCHES}, {fx.PATCH44}
SELECT ord, patch_id, class_name, band AS pos, round(avg(v), 6) + 0.0 AS value FROM wanted JOIN patch44 USING (patch_id) GROUP BY ord, patch_id, class_name, band"""


def patch_lookup(spark, d):
    rows = mf.lookup(_manifest_of_patches(spark, d), fx.patches(spark, d).select("patch_id", "pix"), 4)
    return rounded(rows.select("patch_id", "class_name", F.posexplode("pix").alias("pos", "v")).select("patch_id", "class_name", "pos", F.col("v").cast("double").alias("value")))


QUERIES["patch_lookup"] = patch_lookup
ORACLES["patch_lookup"] = f"""WITH {OF_PATCHES}, px AS (SELECT *, unnest(range(64)) AS i FROM embeddings WHERE vec_id = 4)
SELECT patch_id, class_name, CAST(i AS INT) AS pos, round(CAST(embedding[i + 1] AS DOUBLE), 6) + 0.0 AS value FROM wanted JOIN px ON vec_id = patch_id"""


def cast_read(spark, d):
    """Vectors read as another type: here as whole hundredths."""
    rows = fx.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("int")).alias("v"))
    return rows.select("vec_id", F.posexplode(F.col("v").cast("array<float>")).alias("pos", "v")).select("vec_id", "pos", F.col("v").cast("double").alias("value"))


QUERIES["cast_read"] = cast_read
ORACLES["cast_read"] = "SELECT vec_id, CAST(i AS INT) AS pos, CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 100) AS DOUBLE) AS value FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)"


def band_to_pixel_order(spark, d):
    return rounded(mf.band_first_to_last(fx.patches(spark, d)), "v").select("patch_id", "y", "x", "band", F.col("v").alias("value"))


QUERIES["band_to_pixel_order"] = band_to_pixel_order
ORACLES["band_to_pixel_order"] = """SELECT vec_id AS patch_id, CAST(i % 16 // 4 AS INT) AS y, CAST(i % 4 AS INT) AS x, CAST(i // 16 AS INT) AS band, round(CAST(embedding[i + 1] AS DOUBLE), 6) + 0.0 AS value
FROM (SELECT *, unnest(range(64)) AS i FROM embeddings)"""


def patch_inventory(spark, d):
    """Classes in whose folders files are found, listed recursively, with the rows that were routed there."""
    path = new_folder(spark, "inventory")
    tables.write_routed(_manifest_of_patches(spark, d), path)
    files = tables.inventory(spark, path, "*.parquet").select(F.regexp_extract("path", "class_name=([^/]+)/", 1).alias("class_name"), "length")
    rows = spark.read.parquet(path).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy("class_name").agg(F.min(F.col("length") > 0).alias("filled")).join(rows, "class_name")


QUERIES["patch_inventory"] = patch_inventory
ORACLES["patch_inventory"] = f"WITH {OF_PATCHES} SELECT class_name, true AS filled, count(*) AS n FROM wanted GROUP BY class_name"


def _pooled_table(spark, d):
    rows = fx.features(spark, d).select("split_type", "role", F.col("row_id").alias("patch_id"), "label", "features")
    return rows.withColumn("method", F.lit("mean")).unionByName(rows.withColumn("features", F.slice("features", 1, 4)).withColumn("method", F.lit("stats")))


def _stored(spark, d):
    path = new_folder(spark, "pooled")
    tables.write_pooled(_pooled_table(spark, d), path)
    return path


def pooled_write(spark, d):
    """What a written pooled table holds, by partition."""
    back = tables.read_pooled(spark, _stored(spark, d))
    return back.groupBy("method", "split_type", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("features")).alias("values"))


def pooled_read(spark, d):
    back = tables.read_pooled(spark, _stored(spark, d), "stats", "spatial", "test")
    return rounded(back.select("patch_id", "label", F.posexplode("features").alias("pos", "value")))


QUERIES |= {"pooled_write": pooled_write, "pooled_read": pooled_read}
ORACLES["pooled_write"] = f"""WITH {fx.FEATURES} SELECT method, split_type, role, count(*) AS n, CAST(sum(w) AS BIGINT) AS values
FROM feats, (SELECT 'mean' AS method, 64 AS w UNION ALL SELECT 'stats', 4) GROUP BY ALL"""
ORACLES["pooled_read"] = f"""WITH {fx.FEATURES} SELECT row_id AS patch_id, label, CAST(i AS INT) AS pos, round(features[i + 1], 6) + 0.0 AS value
FROM (SELECT *, unnest(range(4)) AS i FROM feats WHERE split_type = 'spatial' AND role = 'test')"""


def _grid(spark, d):
    res = fx.results(spark, d)
    return res.select("pool").distinct(), res.select("split_type").distinct(), res.filter("dataset = 'gamma' and probe = 'knn_5'")


def resume_pending(spark, d):
    """Measurements of dataset alpha that gamma does not have yet."""
    res = fx.results(spark, d)
    keys = ("pool", "split_type", "probe")
    return mf.pending(res.filter("dataset = 'alpha'").select(*keys), res.filter("dataset = 'gamma'").select(*keys), *keys)


QUERIES["resume_pending"] = resume_pending
ORACLES["resume_pending"] = f"""WITH {fx.RESULTS} SELECT pool, split_type, probe FROM results WHERE dataset = 'alpha'
EXCEPT SELECT pool, split_type, probe FROM results WHERE dataset = 'gamma'"""

QUERIES["coverage_missing"] = lambda spark, d: mf.coverage(*_grid(spark, d), missing=True)
QUERIES["coverage_present"] = lambda spark, d: mf.coverage(*_grid(spark, d), missing=False)
_GRID = f"WITH {fx.RESULTS}, grid AS (SELECT * FROM (SELECT DISTINCT pool FROM results), (SELECT DISTINCT split_type FROM results)), have AS (SELECT DISTINCT pool, split_type FROM results WHERE dataset = 'gamma' AND probe = 'knn_5')"
ORACLES["coverage_missing"] = f"{_GRID} SELECT * FROM grid EXCEPT SELECT * FROM have"
ORACLES["coverage_present"] = f"{_GRID} SELECT * FROM grid INTERSECT SELECT * FROM have"


def quarantine(spark, d):
    """Line items that fail a check, with its name."""
    rows = fx.table(spark, d, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    checks = {"quantity above 45": F.col("l_quantity") <= 45, "discount above 9 %": F.col("l_discount") <= 0.09}
    return mf.quarantine(rows, checks, "key")[1].groupBy("key", "error").agg(F.count(F.lit(1)).alias("n"))


QUERIES["quarantine"] = quarantine
ORACLES["quarantine"] = """SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS key,
CASE WHEN l_quantity > 45 THEN 'quantity above 45' ELSE 'discount above 9 %' END AS error, count(*) AS n FROM lineitem WHERE l_quantity > 45 OR l_discount > 0.09 GROUP BY ALL"""


def route_by_class(spark, d):
    """Rows that were written to one folder a class, counted from what was read back."""
    stem = F.concat_ws("_", "p_type", F.col("p_partkey").cast("string"), F.lit("x"))
    rows = fx.table(spark, d, "part").select(stem.alias("stem"), mf.class_of_stem(stem).alias("class_name"))
    path = new_folder(spark, "routed")
    tables.write_routed(rows, path)
    return spark.read.parquet(path).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"), F.min("stem").alias("first"))


QUERIES["route_by_class"] = route_by_class
ORACLES["route_by_class"] = "SELECT p_type AS class_name, count(*) AS n, min(p_type || '_' || p_partkey || '_x') AS first FROM part GROUP BY p_type"


def _results_files(spark, d):
    paths = {}
    for name in ("alpha", "beta", "gamma"):
        paths[name] = new_folder(spark, f"results-{name}")
        tables.write_results(fx.results(spark, d).filter(F.col("dataset") == name).select([f.name for f in tables.RESULTS.fields]), paths[name])
    return paths | {"missing": f"{shared_dir(spark)}/not-there"}


def results_union(spark, d):
    back = tables.read_results(spark, _results_files(spark, d))
    return back.select("dataset", "pool", "split_type", "probe", "train_samples", F.round("accuracy", 6).alias("accuracy"))


def results_write(spark, d):
    """What the files of each dataset hold: their header and their lines, counted as text."""
    out = None
    for dataset, path in _results_files(spark, d).items():
        if dataset != "missing":
            lines = spark.read.text(path).select(F.lit(dataset).alias("dataset"), F.when(F.col("value").startswith("pool,"), F.col("value")).alias("header"))
            out = lines if out is None else out.unionByName(lines)
    return out.groupBy("dataset").agg(F.max("header").alias("header"), F.count_if(F.col("header").isNull()).alias("lines"))


QUERIES |= {"results_union": results_union, "results_write": results_write}
ORACLES["results_union"] = f"WITH {fx.RESULTS} SELECT dataset, pool, split_type, probe, train_samples, round(accuracy, 6) AS accuracy FROM results"
ORACLES["results_write"] = f"WITH {fx.RESULTS} SELECT dataset, '{','.join(f.name for f in tables.RESULTS.fields)}' AS header, count(*) AS lines FROM results GROUP BY dataset"
