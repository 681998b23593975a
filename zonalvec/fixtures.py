"""Views that read the given tables as embedding grids, manifests, features and results.

Each view has a DataFrame form and the SQL of the same rows as a common table expression for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.order import numbered


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def patches(spark: SparkSession, d: str) -> DataFrame:
    """Each 64-value embedding as a 4x4x4 grid, in patch rows."""
    size = lambda n, c: F.lit(n).alias(c)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("patch_id"), size(4, "h"), size(4, "w"), size(4, "d"), F.col("embedding").alias("pix"), "label")


def patch44(spark: SparkSession, d: str) -> DataFrame:
    from .model import patches_to_long

    return patches_to_long(patches(spark, d))


PATCH44 = """patch44 AS (SELECT vec_id AS patch_id, CAST(i // 16 AS INT) AS y, CAST((i // 4) % 4 AS INT) AS x, CAST(i % 4 AS INT) AS band,
 CAST(embedding[i + 1] AS DOUBLE) AS v, label FROM (SELECT *, unnest(range(64)) AS i FROM embeddings))"""


def pixels44(spark: SparkSession, d: str) -> DataFrame:
    """The same grids in pixel rows: (patch_id, y, x, vec of 4)."""
    p = patches(spark, d).select("patch_id", "label", "pix", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    return p.select("patch_id", F.expr("i div 4").cast("int").alias("y"), F.expr("i % 4").cast("int").alias("x"), F.slice("pix", F.col("i") * 4 + 1, F.lit(4)).alias("vec"), "label")


def patch55(spark: SparkSession, d: str) -> DataFrame:
    """25 embeddings as one 5x5 grid of 64 bands, in pixel rows."""
    return table(spark, d, "embeddings").select(
        F.expr("vec_id div 25").alias("patch_id"), F.expr("vec_id % 25 div 5").cast("int").alias("y"), F.expr("vec_id % 5").cast("int").alias("x"), F.col("embedding").alias("vec"), "label"
    )


def patch88(spark: SparkSession, d: str) -> DataFrame:
    """64 embeddings as one 8x8 grid of 64 bands, in patch rows; pixels that are not there are 0."""
    grids = table(spark, d, "embeddings").groupBy(F.expr("vec_id div 64").alias("patch_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("_p"))
    pix = F.flatten(F.transform("_p", lambda p: F.transform(p["embedding"], lambda x: x.cast("double"))))
    full = F.concat(pix, F.array_repeat(F.lit(0.0), F.lit(4096) - F.size(pix)))
    return grids.select("patch_id", F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(64).alias("d"), full.alias("pix"))


PATCH55 = """patch55 AS (SELECT vec_id // 25 AS patch_id, CAST(vec_id % 25 // 5 AS INT) AS y, CAST(vec_id % 5 AS INT) AS x, embedding AS vec, label FROM embeddings)"""


def zones(spark: SparkSession, d: str) -> DataFrame:
    """Ragged zones: a supplier's line items as pixels of four bands, in long rows without a grid."""
    bands = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("patch_id"), F.posexplode(bands).alias("band", "v")).withColumn("d", F.lit(4))


ZONES = """zones AS (SELECT l_suppkey AS patch_id, CAST(i AS INT) AS band, [l_quantity, l_extendedprice, l_discount, l_tax][i + 1] AS v
 FROM (SELECT *, unnest(range(4)) AS i FROM lineitem))"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, features, label): the embeddings as feature vectors."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


def standard_split(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth row is tested."""
    return labelled(spark, d).withColumn("split_type", F.lit("standard")).withColumn("role", F.when(F.col("row_id") % 5 == 0, "test").otherwise("train"))


def spatial_split(spark: SparkSession, d: str) -> DataFrame:
    """The fifth with the largest first coordinate (a stand-in for longitude) is tested; of equal ones those with the least ids first."""
    east = labelled(spark, d).withColumn("_east", -F.element_at("features", 1))
    ranked, n = numbered(east, "_east", "row_id", name="_place")
    return ranked.select("row_id", "features", "label", F.lit("spatial").alias("split_type"), F.when(F.col("_place") < n // 5, "test").otherwise("train").alias("role"))


def features(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as labelled feature vectors under two kinds of split."""
    return standard_split(spark, d).unionByName(spatial_split(spark, d))


FEATURES = """feats AS (SELECT vec_id AS row_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS features, label, 'standard' AS split_type,
 CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS role FROM embeddings
 UNION ALL SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)), label, 'spatial',
 CASE WHEN row_number() OVER (ORDER BY embedding[1] DESC, vec_id) <= count(*) OVER () // 5 THEN 'test' ELSE 'train' END FROM embeddings)"""


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Manifest lines made from the parts: <type>_<key>.jpg; every 50th is blank, every 77th has no underscore, every 31st is padded."""
    k = F.col("p_partkey")
    line = F.concat(F.col("p_type"), F.lit("_"), k.cast("string"), F.lit(".jpg"))
    line = F.when(k % 50 == 7, "   ").when(k % 77 == 5, F.concat(F.col("p_type"), k.cast("string"), F.lit(".jpg"))).when(k % 31 == 3, F.concat(F.lit("  "), line, F.lit(" "))).otherwise(line)
    return table(spark, d, "part").select(line.alias("line"), k.alias("ord"))


MANIFEST = """manifest AS (SELECT CASE WHEN p_partkey % 50 = 7 THEN '   ' WHEN p_partkey % 77 = 5 THEN p_type || p_partkey || '.jpg'
 WHEN p_partkey % 31 = 3 THEN '  ' || p_type || '_' || p_partkey || '.jpg ' ELSE p_type || '_' || p_partkey || '.jpg' END AS line, p_partkey AS ord FROM part)"""


def classes(spark: SparkSession, d: str) -> DataFrame:
    """Class dictionary: the part types in alphabetical order, numbered from 0. A handful of rows."""
    names = table(spark, d, "part").select(F.col("p_type").alias("class_name")).distinct()
    return names.select("class_name", (F.row_number().over(Window.orderBy("class_name")) - 1).cast("int").alias("idx"))


CLASSES = "classes AS (SELECT class_name, CAST(row_number() OVER (ORDER BY class_name) - 1 AS INT) AS idx FROM (SELECT DISTINCT p_type AS class_name FROM part))"


def affine(spark: SparkSession, d: str) -> DataFrame:
    """A north-up affine transform and a size for every supplier."""
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        s.alias("patch_id"), F.lit(10.0).alias("a"), F.lit(0.0).alias("b"), (s * 37 % 1000 * 10).cast("double").alias("c"), F.lit(0.0).alias("d"), F.lit(-10.0).alias("e"),
        (5000 + s * 91 % 700 * 10).cast("double").alias("f"), (4 + s % 3).cast("int").alias("w"), (3 + s % 4).cast("int").alias("h"),
    )


AFFINE = """affine AS (SELECT s_suppkey AS patch_id, 10.0::DOUBLE AS a, 0.0::DOUBLE AS b, CAST(s_suppkey * 37 % 1000 * 10 AS DOUBLE) AS c, 0.0::DOUBLE AS d, (-10.0)::DOUBLE AS e,
 CAST(5000 + s_suppkey * 91 % 700 * 10 AS DOUBLE) AS f, CAST(4 + s_suppkey % 3 AS INT) AS w, CAST(3 + s_suppkey % 4 AS INT) AS h FROM supplier)"""


def scenes(spark: SparkSession, d: str) -> DataFrame:
    """Dated boxes made from the orders."""
    k = F.col("o_custkey")
    x, y = (k * 53 % 1000 * 10).cast("double"), (4000 + k * 29 % 900 * 10).cast("double")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").alias("ts"), x.alias("xmin"), (x + 200).alias("xmax"), y.alias("ymin"), (y + 150).alias("ymax"))


SCENES = """scenes AS (SELECT o_orderkey AS scene_id, o_orderdate AS ts, CAST(o_custkey * 53 % 1000 * 10 AS DOUBLE) AS xmin, CAST(o_custkey * 53 % 1000 * 10 + 200 AS DOUBLE) AS xmax,
 CAST(4000 + o_custkey * 29 % 900 * 10 AS DOUBLE) AS ymin, CAST(4000 + o_custkey * 29 % 900 * 10 + 150 AS DOUBLE) AS ymax FROM orders)"""

#: The method names of the results view, by line number.
RESULT_POOLS = ("mean", "std", "stats", "percentiles", "pca_64", "bovw_128", "signed_non_cancelling_gem")


def results(spark: SparkSession, d: str) -> DataFrame:
    """A probe results table measured on the line items: a method's accuracy is the share of its items above a bar.

    Method 'percentiles' (line number 4) has no rows in dataset 'gamma', so that shared methods differ from all.
    """
    it = table(spark, d, "lineitem")
    dataset = F.element_at(F.array(*map(F.lit, ("alpha", "beta", "gamma"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    pool = F.element_at(F.array(*map(F.lit, RESULT_POOLS)), F.col("l_linenumber"))
    probe = F.element_at(F.array(*[F.lit(p) for p in ("knn_1", "knn_3", "knn_5", "knn_7", "knn_9", "linear")]), (F.col("l_partkey") % 6 + 1).cast("int"))
    rows = it.select(dataset.alias("dataset"), pool.alias("pool"), F.when(F.col("l_suppkey") % 2 == 0, "standard").otherwise("spatial").alias("split_type"), probe.alias("probe"),
                     (F.col("l_quantity") > 10 + F.col("l_linenumber") + F.col("l_suppkey") % 2 * 4).cast("double").alias("hit"), F.col("l_discount").alias("disc"))
    rows = rows.filter(~((F.col("pool") == "percentiles") & (F.col("dataset") == "gamma")))
    return rows.groupBy("dataset", "pool", "split_type", "probe").agg(F.count(F.lit(1)).alias("train_samples"), F.avg("hit").alias("accuracy"), (F.avg("hit") - F.avg("disc")).alias("f1_macro"))


RESULTS = """results AS (SELECT dataset, pool, split_type, probe, count(*) AS train_samples, avg(hit) AS accuracy, avg(hit) - avg(disc) AS f1_macro FROM (
 SELECT ['alpha', 'beta', 'gamma'][l_orderkey % 3 + 1] AS dataset,
 ['mean', 'std', 'stats', 'percentiles', 'pca_64', 'bovw_128', 'signed_non_cancelling_gem'][l_linenumber] AS pool,
 CASE WHEN l_suppkey % 2 = 0 THEN 'standard' ELSE 'spatial' END AS split_type,
 ['knn_1', 'knn_3', 'knn_5', 'knn_7', 'knn_9', 'linear'][l_partkey % 6 + 1] AS probe,
 CAST(l_quantity > 10 + l_linenumber + l_suppkey % 2 * 4 AS DOUBLE) AS hit, l_discount AS disc FROM lineitem)
 WHERE NOT (pool = 'percentiles' AND dataset = 'gamma') GROUP BY ALL)"""


def codebook(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    """The first k pixels of the 4x4x4 grids as cluster centres."""
    first = pixels44(spark, d).orderBy("patch_id", "y", "x").limit(k)
    numbered = first.select(F.row_number().over(Window.orderBy("patch_id", "y", "x")).alias("n"), "vec")
    return numbered.select((F.col("n") - 1).cast("int").alias("cluster"), F.transform("vec", lambda x: x.cast("double")).alias("centre"))


CODEBOOK = """px AS (SELECT vec_id AS patch_id, CAST(i // 4 AS INT) AS y, CAST(i % 4 AS INT) AS x, list_transform(embedding[i * 4 + 1 : i * 4 + 4], lambda v: CAST(v AS DOUBLE)) AS vec, label
 FROM (SELECT *, unnest(range(16)) AS i FROM embeddings)),
codebook AS (SELECT CAST(row_number() OVER (ORDER BY patch_id, y, x) - 1 AS INT) AS cluster, vec AS centre FROM (SELECT * FROM px ORDER BY patch_id, y, x LIMIT 8))"""
