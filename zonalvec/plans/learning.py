"""Queries of fitted pooling, sampling and probes, with SQL where it is exact."""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import codecs
from ..operators import fitted, metrics, probe, sampling
from ..operators.pool import features
from .pooling import SQL_BLOCKS, rounded

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# -- fitted pooling ----------------------------------------------------------------------------------------


def _role(df, key="patch_id"):
    return df.withColumn("role", F.when(F.col(key) % 5 == 0, "test").otherwise("train"))


def _mean_pooled(spark, d):
    return _role(features(fx.patch44(spark, d), "mean"))


def _frame(spark, model):
    return rounded(rounded(model.frame(spark), "loading"), "variance", 9)


def pca_fit(spark, d):
    model = fitted.PCA(4).fit(_mean_pooled(spark, d).filter("role = 'train'"))
    return _frame(spark, model).withColumn("total_variance", F.round(F.lit(model.total_variance), 9))


def pca_transform(spark, d):
    rows = _mean_pooled(spark, d)
    model = fitted.PCA(3).fit(rows.filter("role = 'train'"))
    return rounded(model.transform(rows).select("patch_id", "role", F.posexplode("features").alias("component", "value")))


def pca_flat(spark, d):
    rows = _role(fx.patches(spark, d).select("patch_id", F.col("pix").alias("features")))
    model = fitted.PCA(8).fit(rows.filter("role = 'train'"))
    return rounded(model.transform(rows).select("patch_id", "role", F.posexplode("features").alias("component", "value")))


def pca_flat_wide(spark, d):
    """Patches of 8 x 8 pixels and 64 bands, flattened to 4,096 values: the variances of two components, found by passes over a sketch."""
    model = fitted.fit_wide(fx.patch88(spark, d).select(F.col("pix").alias("features")), 2, passes=60, tolerance=1e-9)
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(model.variance)], "component int, variance double")
    return rounded(rounded(rows.withColumn("total_variance", F.lit(model.total_variance)), "variance", 4), "total_variance", 4)


def pca_incremental(spark, d):
    """Moments of four batches, merged: the same basis as from one pass."""
    rows = _mean_pooled(spark, d).filter("role = 'train'")
    parts = [fitted.moments(rows.filter(F.col("patch_id") % 4 == k)) for k in range(4)]
    return _frame(spark, fitted.pca_from_moments(fitted.merge_moments(*parts), 4))


def pca_pixel_rgb(spark, d):
    """Pseudo-colours: three components of the pixels, each stretched between its 2nd and 98th percentile in the patch."""
    pixels = fx.pixels44(spark, d).withColumnRenamed("vec", "features")
    model = fitted.PCA(3).fit(pixels)
    shown = model.transform(pixels).select("patch_id", "y", "x", F.posexplode("features").alias("band", "v"))
    return rounded(codecs.percentile_stretch(shown), "v")


def pca_pixel_union(spark, d):
    """A basis fitted on every fourth pixel of two groups of patches, applied to all pixels."""
    pixels = fx.pixels44(spark, d)
    some = codecs.stride_sample(pixels.filter("label = 0"), 4).unionByName(codecs.stride_sample(pixels.filter("label = 1"), 4))
    model = fitted.PCA(3).fit(some.withColumnRenamed("vec", "features"))
    return rounded(model.transform(pixels.withColumnRenamed("vec", "features")).select("patch_id", "y", "x", F.posexplode("features").alias("component", "value")))


def pca_skip(spark, d):
    """Which of the wanted numbers of components the mean-pooled vectors allow."""
    width = fx.patch44(spark, d).agg((F.max("band") + 1).alias("d"))
    return width.select(F.explode(F.array(*map(F.lit, (2, 4, 8, 64)))).alias("components"), "d").select("components", (F.col("components") > F.col("d")).alias("skipped"))


def bovw_fit(spark, d):
    model = fitted.BoVW(8, iterations=10).fit(_role(fx.pixels44(spark, d)).filter("role = 'train'"))
    return rounded(model.codebook(spark).select("cluster", F.posexplode("centre").alias("band", "value")))


QUERIES |= {
    "pca_fit": pca_fit, "pca_transform": pca_transform, "pca_flat": pca_flat, "pca_flat_wide": pca_flat_wide, "pca_incremental": pca_incremental, "pca_pixel_rgb": pca_pixel_rgb, "pca_pixel_union": pca_pixel_union,
    "pca_skip": pca_skip, "bovw_fit": bovw_fit,
}
ORACLES["pca_skip"] = f"WITH {fx.PATCH44}, w AS (SELECT max(band) + 1 AS d FROM patch44) SELECT CAST(k AS INT) AS components, k > d AS skipped FROM w, (SELECT unnest([2, 4, 8, 64]) AS k)"



def principal_sql(d: int, k: int, squarings: int = 26) -> str:
    """CTEs over tr(f), the training vectors of d values: mu(m), cov(c), pc(component, v, variance).

    A covariance matrix that is squared again and again, scaled to trace 1, becomes the projector on its first axis; that axis is
    read off, taken out of the matrix, and the next one is found in the same way.
    """
    square = f"list_transform(range({d * d}), lambda t: list_sum(list_transform(range({d}), lambda q: m[(t // {d}) * {d} + q + 1] * m[q * {d} + t % {d} + 1])))"
    parts = [f"""dims AS (SELECT unnest(range({d})) AS i), mu AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(f[i + 1]) AS m FROM tr, dims GROUP BY i)),
cov AS (SELECT list(c ORDER BY i, j) AS c FROM (SELECT a.i, b.i AS j, covar_samp(f[a.i + 1], f[b.i + 1]) AS c FROM tr, dims a, dims b GROUP BY a.i, b.i))"""]
    for n in range(k):
        base = f"rest{n}" if n else "cov"
        parts.append(f"""power{n} AS (SELECT 0 AS n, c AS m FROM {base} UNION ALL SELECT n + 1, list_transform(s, lambda x: x / trace) FROM (
 SELECT n, s, list_sum(list_transform(range({d}), lambda i: s[i * {d + 1} + 1])) AS trace FROM (SELECT n, {square} AS s FROM power{n} WHERE n < {squarings}))),
limit{n} AS (SELECT m, list_transform(range({d}), lambda i: m[i * {d + 1} + 1]) AS diagonal FROM power{n} WHERE n = {squarings}),
largest{n} AS (SELECT m, list_position(diagonal, list_max(diagonal)) - 1 AS j FROM limit{n}),
axis{n} AS (SELECT list_transform(range({d}), lambda i: m[j * {d} + i + 1] / sqrt(m[j * {d + 1} + 1])) AS v FROM largest{n}),
pc{n} AS (SELECT CAST({n} AS INT) AS component, v, list_sum(list_transform(range({d * d}), lambda t: v[t // {d} + 1] * c[t + 1] * v[t % {d} + 1])) AS variance FROM axis{n}, cov),
rest{n + 1} AS (SELECT list_transform(range({d * d}), lambda t: c[t + 1] - variance * v[t // {d} + 1] * v[t % {d} + 1]) AS c FROM {base}, pc{n})""")
    return ", ".join([*parts, "pc AS (" + " UNION ALL ".join(f"SELECT * FROM pc{n}" for n in range(k)) + ")"])


def _projected(vector: str, d: int) -> str:
    return f"list_sum(list_transform(range({d}), lambda i: ({vector}[i + 1] - m[i + 1]) * v[i + 1]))"


BASIS = "SELECT component, CAST(i AS INT) AS pos, round(v[i + 1], 6) + 0.0 AS loading, round(variance, 9) + 0.0 AS variance{more} FROM pc, dims, cov"
MEANS = f"{fx.PATCH44}, pooled AS (SELECT patch_id, list(v ORDER BY band) AS f FROM (SELECT patch_id, band, avg(v) AS v FROM patch44 GROUP BY ALL) GROUP BY patch_id), tr AS (SELECT f FROM pooled WHERE patch_id % 5 <> 0)"
FLAT = "flat AS (SELECT vec_id AS patch_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings)"
PIXELS = "px AS (SELECT vec_id AS patch_id, i, list_transform(embedding[i * 4 + 1 : i * 4 + 4], lambda x: CAST(x AS DOUBLE)) AS f, label FROM (SELECT *, unnest(range(16)) AS i FROM embeddings))"
AT = "CAST(i // 4 AS INT) AS y, CAST(i % 4 AS INT) AS x"
ROLE = "CASE WHEN patch_id % 5 = 0 THEN 'test' ELSE 'train' END AS role"
TRACE = ", round(list_sum(list_transform(range(4), lambda t: c[t * 5 + 1])), 9) AS total_variance"
ORACLES["pca_fit"] = f"WITH RECURSIVE {MEANS}, {principal_sql(4, 4)} {BASIS.format(more=TRACE)}"
ORACLES["pca_incremental"] = f"WITH RECURSIVE {MEANS}, {principal_sql(4, 4)} {BASIS.format(more='')}"
ORACLES["pca_transform"] = f"WITH RECURSIVE {MEANS}, {principal_sql(4, 3)} SELECT patch_id, {ROLE}, component, round({_projected('f', 4)}, 6) + 0.0 AS value FROM pooled, pc, mu"
ORACLES["pca_flat"] = f"WITH RECURSIVE {FLAT}, tr AS (SELECT f FROM flat WHERE patch_id % 5 <> 0), {principal_sql(64, 8)} SELECT patch_id, {ROLE}, component, round({_projected('f', 64)}, 6) + 0.0 AS value FROM flat, pc, mu"
#: The same variances are those of the patches' scalar products, a matrix of one row a patch, squared until only its first axis is left.
SQUARE = "list_transform(range(n * n), lambda t: list_sum(list_transform(range(n), lambda q: m[(t // n) * n + q + 1] * m[q * n + t % n + 1])))"
TRACED = "list_sum(list_transform(range(n), lambda i: {}[i * (n + 1) + 1]))"


def _first_axis(k: int) -> str:
    return f"""power{k} AS (SELECT 0 AS s, n, c AS m FROM rest{k} UNION ALL SELECT s + 1, n, list_transform(q, lambda x: x / trace) FROM (SELECT s, n, q, {TRACED.format("q")} AS trace FROM (SELECT s, n, {SQUARE} AS q FROM power{k} WHERE s < 40))),
pc{k} AS (SELECT n, m AS p, c, list_sum(list_transform(range(n * n), lambda t: m[t + 1] * c[t + 1])) AS variance FROM power{k} JOIN rest{k} USING (n) WHERE s = 40),
rest{k + 1} AS (SELECT n, list_transform(range(n * n), lambda t: c[t + 1] - variance * p[t + 1]) AS c FROM pc{k})"""


ORACLES["pca_flat_wide"] = f"""WITH RECURSIVE wide AS (SELECT vec_id // 64 AS patch, list_resize(flatten(list(list_transform(embedding, lambda x: CAST(x AS DOUBLE)) ORDER BY vec_id)), 4096, 0) AS f FROM embeddings GROUP BY patch),
mu AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(f[i + 1]) AS m FROM wide, (SELECT unnest(range(4096)) AS i) GROUP BY i)),
centred AS (SELECT patch, list_transform(list_zip(f, m), lambda z: z[1] - z[2]) AS f FROM wide, mu), many AS (SELECT count(*) AS n FROM wide),
rest0 AS (SELECT n, list(g ORDER BY a, b) AS c FROM (SELECT n, x.patch AS a, y.patch AS b, list_dot_product(x.f, y.f) / (n - 1) AS g FROM centred x, centred y, many) GROUP BY n),
{_first_axis(0)}, {_first_axis(1)}, total AS (SELECT {TRACED.format("c")} AS total FROM rest0)
SELECT component, round(variance, 4) + 0.0 AS variance, round(total, 4) + 0.0 AS total_variance FROM (SELECT 0 AS component, variance FROM pc0 UNION ALL SELECT 1, variance FROM pc1), total"""
ORACLES["pca_pixel_union"] = f"WITH RECURSIVE {PIXELS}, tr AS (SELECT f FROM px WHERE label IN (0, 1) AND i % 4 = 0), {principal_sql(4, 3)} SELECT patch_id, {AT}, component, round({_projected('f', 4)}, 6) + 0.0 AS value FROM px, pc, mu"
ORACLES["pca_pixel_rgb"] = f"""WITH RECURSIVE {PIXELS}, tr AS (SELECT f FROM px), {principal_sql(4, 3)}, shown AS (SELECT patch_id, i, component AS band, {_projected('f', 4)} AS v FROM px, pc, mu),
ends AS (SELECT patch_id, band, quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM shown GROUP BY ALL)
SELECT patch_id, {AT}, band, round(CASE WHEN b > a THEN greatest(0, least(1, (v - a) / (b - a))) ELSE 0 END, 6) + 0.0 AS v FROM shown JOIN ends USING (patch_id, band)"""

NEAREST = f"""{fx.CODEBOOK}, dist AS (SELECT patch_id, y, x, vec, cluster, round(list_sum(list_transform(list_zip(vec, centre), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS dd FROM px, codebook),
near AS (SELECT patch_id, y, x, vec, cluster FROM (SELECT *, row_number() OVER (PARTITION BY patch_id, y, x ORDER BY dd, cluster) AS n FROM dist) WHERE n = 1)"""


def _assigned(spark, d):
    return fitted.assign(fx.pixels44(spark, d), fx.codebook(spark, d))


QUERIES["bovw_assign"] = lambda spark, d: _assigned(spark, d).select("patch_id", "y", "x", "cluster")
ORACLES["bovw_assign"] = f"WITH {NEAREST} SELECT patch_id, y, x, cluster FROM near"
QUERIES["bovw_encode"] = lambda spark, d: rounded(fitted.encode(_assigned(spark, d), 8))
ORACLES["bovw_encode"] = f"""WITH {NEAREST}, n AS (SELECT patch_id, cluster, count(*) AS n FROM near GROUP BY ALL)
SELECT patch_id, c.cluster AS ord, round(coalesce(n.n, 0) / 16.0, 6) + 0.0 AS value FROM (SELECT DISTINCT patch_id FROM px) CROSS JOIN codebook c LEFT JOIN n USING (patch_id, cluster)"""
QUERIES["kmeans_step"] = lambda spark, d: rounded(fitted.lloyd_step(_assigned(spark, d)))
ORACLES["kmeans_step"] = f"WITH {NEAREST} SELECT cluster, CAST(i AS INT) AS band, round(avg(vec[i + 1]), 6) + 0.0 AS value, count(*) AS n FROM (SELECT *, unnest(range(4)) AS i FROM near) GROUP BY ALL"

STD = "feats_std AS (SELECT * FROM feats WHERE split_type = 'standard')"
SCALER = """lf AS (SELECT row_id, role, label, i, features[i + 1] AS v FROM (SELECT *, unnest(range(64)) AS i FROM feats_std)),
scaler AS (SELECT i, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS s FROM lf WHERE role = 'train' GROUP BY i)"""


def _standard(spark, d):
    return fx.standard_split(spark, d)


def standardise(spark, d):
    rows = _standard(spark, d)
    out = probe.standardise(rows, probe.standardiser(rows.filter("role = 'train'")))
    return rounded(out.select("row_id", "role", F.posexplode("features").alias("pos", "value")))


def fit_train_apply_both(spark, d):
    """A scaler fitted on training rows and applied to all, while the test rows are a thousandfold: they must not move it."""
    rows = _standard(spark, d).withColumn("features", F.transform("features", lambda x: F.when(F.col("role") == "test", x * 1000).otherwise(x)))
    out = probe.standardise(rows, probe.standardiser(rows.filter("role = 'train'")))
    return rounded(out.select("row_id", "role", F.posexplode("features").alias("pos", "value")), digits=3)


QUERIES |= {"standardise": standardise, "fit_train_apply_both": fit_train_apply_both}
ORACLES["standardise"] = f"WITH {fx.FEATURES}, {STD}, {SCALER} SELECT row_id, role, CAST(i AS INT) AS pos, round((v - m) / s, 6) + 0.0 AS value FROM lf JOIN scaler USING (i)"
ORACLES["fit_train_apply_both"] = f"""WITH {fx.FEATURES}, {STD}, {SCALER} SELECT row_id, role, CAST(i AS INT) AS pos,
round((v * CASE WHEN role = 'test' THEN 1000 ELSE 1 END - m) / s, 3) + 0.0 AS value FROM lf JOIN scaler USING (i)"""

# -- sampling ----------------------------------------------------------------------------------------------

N = 120
HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"
QUOTA = f"""sizes AS (SELECT label, count(*) AS size FROM train GROUP BY label), base AS (SELECT label, size, CAST(round_even(size / sum(size) OVER () * {N}, 0) AS BIGINT) AS base,
 sum(size) OVER () AS total, count(*) OVER () AS classes, row_number() OVER (ORDER BY size DESC, label DESC) - 1 AS rk FROM sizes),
rest AS (SELECT *, {N} - sum(base) OVER () AS rest FROM base),
quota AS (SELECT label, size, CAST(CASE WHEN total <= {N} THEN size ELSE least(greatest(base + sign(rest) * (abs(rest) // classes + CASE WHEN rk < abs(rest) % classes THEN 1 ELSE 0 END), 1), size) END AS BIGINT) AS quota FROM rest)"""
TRAIN = f"{fx.FEATURES}, train AS (SELECT row_id, label, features FROM feats WHERE split_type = 'standard' AND role = 'train'), test AS (SELECT row_id, label, features FROM feats WHERE split_type = 'standard' AND role = 'test')"
PICKED = f"""picked AS (SELECT row_id, label, features FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH.format("'42|' || row_id")}, row_id) AS rk FROM train) JOIN quota USING (label) WHERE rk <= quota)"""


def _train(spark, d):
    return _standard(spark, d).filter("role = 'train'").select("row_id", "label", "features")


def _test(spark, d):
    return _standard(spark, d).filter("role = 'test'").select("row_id", "label", "features")


QUERIES["strat_quota"] = lambda spark, d: sampling.quotas(_train(spark, d), N)
ORACLES["strat_quota"] = f"WITH {TRAIN}, {QUOTA} SELECT label, size, quota FROM quota"
QUERIES["strat_subsample"] = lambda spark, d: sampling.subsample(_train(spark, d), N).select("row_id", "label")
ORACLES["strat_subsample"] = f"WITH {TRAIN}, {QUOTA}, {PICKED} SELECT row_id, label FROM picked"
DRAWN = f"""numbered AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS slot FROM train), per AS (SELECT label, count(*) AS n FROM train GROUP BY label),
draws AS (SELECT label, n, rep, unnest(range(n)) AS draw FROM per, (SELECT unnest(range({{reps}})) AS rep)),
drawn AS (SELECT rep, row_id, label, count(*) AS mult FROM (SELECT rep, label, {HASH.format("'42|' || rep || '|' || label || '|' || draw")} % n AS slot FROM draws) JOIN numbered USING (label, slot) GROUP BY ALL)"""
QUERIES["bootstrap_draws"] = lambda spark, d: sampling.bootstrap(_train(spark, d), 3).select("rep", "row_id", "label", "mult")
ORACLES["bootstrap_draws"] = f"WITH {TRAIN}, {DRAWN.format(reps=3)} SELECT CAST(rep AS INT) AS rep, row_id, label, mult FROM drawn"
QUERIES["bootstrap_in_place"] = lambda spark, d: sampling.bootstrap_in_place(_train(spark, d), 100)
QUERIES["seeded_order"] = lambda spark, d: sampling.in_seeded_order(_train(spark, d)).select("row_id", F.col("ord").cast("long").alias("ord"))
ORACLES["seeded_order"] = f"WITH {TRAIN} SELECT row_id, row_number() OVER (ORDER BY {HASH.format(chr(39) + '42|' + chr(39) + ' || row_id')}, row_id) AS ord FROM train"
QUERIES["train_size_curve"] = lambda spark, d: sampling.size_curve(_train(spark, d), [N, -1]).select("n_train", "row_id", "label")
ORACLES["train_size_curve"] = f"WITH {TRAIN}, {QUOTA}, {PICKED} SELECT {N} AS n_train, row_id, label FROM picked UNION ALL SELECT -1, row_id, label FROM train"

# -- probes ------------------------------------------------------------------------------------------------


def _pairs(test: str, train: str) -> str:
    """All pairs of queries and training rows with their rank; a zero vector has distance 1."""
    return f"""pairs AS (SELECT a.row_id AS q, a.label AS y, b.row_id AS train_id, b.label, round(coalesce(list_cosine_distance(a.features, b.features), 1), 9) AS dist FROM {test} a, {train} b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, train_id) AS rank FROM pairs)"""


def _voted(keys: str = "", source: str = "ranked WHERE rank <= 5", weight: str = "count(*)") -> str:
    """Majority votes (q, y, p) of a source of neighbours."""
    k = f"{keys}, " if keys else ""
    return f"""votes AS (SELECT {k}q, y, label, {weight} AS n FROM {source} GROUP BY {k}q, y, label),
pred AS (SELECT {k}q, y, label AS p FROM (SELECT *, row_number() OVER (PARTITION BY {k}q ORDER BY n DESC, label) AS rk FROM votes) WHERE rk = 1)"""


def _scores(keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""sides AS (SELECT {k}y AS label, 1 AS s, 0 AS r, CASE WHEN y = p THEN 1 ELSE 0 END AS t FROM pred UNION ALL SELECT {k}p, 0, 1, 0 FROM pred),
cls AS (SELECT {k}label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(t) AS BIGINT) AS tp, CASE WHEN sum(r) > 0 THEN sum(t) / sum(r) ELSE 0 END AS precision, CASE WHEN sum(s) > 0 THEN sum(t) / sum(s) ELSE 0 END AS recall,
 CASE WHEN sum(s) + sum(r) > 0 THEN 2 * sum(t) / (sum(s) + sum(r)) ELSE 0 END AS f1 FROM sides GROUP BY {k}label)"""


FIVE = {"accuracy": "sum(tp) / sum(support)", "f1_macro": "avg(f1)", "f1_weighted": "sum(f1 * support) / sum(support)", "precision_macro": "avg(precision)", "recall_macro": "avg(recall)"}
FIVE_SQL = ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in FIVE.items())


def _five(df, *keys):
    return df.select(*keys, *[(F.round(m, 6) + F.lit(0.0)).alias(m) for m in metrics.METRICS])


QUERIES["cosine_pairs"] = lambda spark, d: probe.distances(_test(spark, d), _train(spark, d))
ORACLES["cosine_pairs"] = f"WITH {TRAIN}, {_pairs('test', 'train')} SELECT q, train_id, dist FROM pairs"
QUERIES["knn_topk"] = lambda spark, d: probe.neighbours(_test(spark, d), _train(spark, d), 5).select("q", "train_id", "label", "dist", F.col("rank").cast("long").alias("rank"))
ORACLES["knn_topk"] = f"WITH {TRAIN}, {_pairs('test', 'train')} SELECT q, train_id, label, dist, rank FROM ranked WHERE rank <= 5"


def _predicted(spark, d):
    return probe.vote(probe.neighbours(_test(spark, d), _train(spark, d), 5)).join(probe.truth(_test(spark, d)), "q")


PRED = f"{TRAIN}, {_pairs('test', 'train')}, {_voted()}"
QUERIES["knn_predict"] = lambda spark, d: _predicted(spark, d).select("q", "y", "p")
ORACLES["knn_predict"] = f"WITH {PRED} SELECT q, y, p FROM pred"
QUERIES["confusion"] = lambda spark, d: metrics.confusion(_predicted(spark, d))
ORACLES["confusion"] = f"WITH {PRED} SELECT y, p, count(*) AS n FROM pred GROUP BY ALL"
QUERIES["class_prf"] = lambda spark, d: metrics.class_scores(_predicted(spark, d)).select("label", "support", "tp", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
ORACLES["class_prf"] = f"WITH {PRED}, {_scores()} SELECT label, support, tp, round(precision, 6) + 0.0 AS precision, round(recall, 6) + 0.0 AS recall, round(f1, 6) + 0.0 AS f1 FROM cls"
QUERIES["metrics5"] = lambda spark, d: _five(metrics.metrics(_predicted(spark, d)))
ORACLES["metrics5"] = f"WITH {PRED}, {_scores()} SELECT {FIVE_SQL} FROM cls"
QUERIES["knn_eval"] = lambda spark, d: _five(probe.evaluate_knn(_test(spark, d), _train(spark, d), [5]), "k")
ORACLES["knn_eval"] = f"WITH {PRED}, {_scores()} SELECT 5 AS k, {FIVE_SQL} FROM cls"
QUERIES["knn_grid"] = lambda spark, d: _five(probe.evaluate_knn(_test(spark, d), _train(spark, d), [1, 3, 5, 7, 9]), "k")
GRID = "(SELECT * FROM ranked, (SELECT unnest([1, 3, 5, 7, 9]) AS k) WHERE rank <= k)"
ORACLES["knn_grid"] = f"WITH {TRAIN}, {_pairs('test', 'train')}, {_voted('k', GRID)}, {_scores('k')} SELECT k, {FIVE_SQL} FROM cls GROUP BY k"

#: Repetitions of bootstraps.
REPS = 100
BOOT = f"""{TRAIN}, {_pairs('test', 'train')}, {DRAWN.format(reps=REPS)}, near AS (SELECT CAST(rep AS INT) AS rep, q, y, r.label, mult, coalesce(sum(mult) OVER (PARTITION BY rep, q ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM ranked r JOIN drawn d ON d.row_id = r.train_id), took AS (SELECT rep, q, y, label, least(mult, 5 - before) AS take FROM near WHERE before < 5), {_voted('rep', 'took', 'sum(take)')}, {_scores('rep')}"""
QUERIES["knn_bootstrap"] = lambda spark, d: _five(probe.bootstrap_knn(_test(spark, d), _train(spark, d), 5, REPS), "rep")
ORACLES["knn_bootstrap"] = f"WITH {BOOT} SELECT rep, {FIVE_SQL} FROM cls GROUP BY rep"


def bootstrap_ci(spark, d):
    found = metrics.summary(probe.bootstrap_knn(_test(spark, d), _train(spark, d), 5, REPS))
    return found.select("metric", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean", "std", "ci_lower", "ci_upper")])


QUERIES["bootstrap_ci"] = bootstrap_ci
ORACLES["bootstrap_ci"] = f"WITH {BOOT}, m AS (SELECT rep, {', '.join(f'{e} AS {n}' for n, e in FIVE.items())} FROM cls GROUP BY rep) " + " UNION ALL ".join(
    f"SELECT '{n}' AS metric, round(avg({n}), 6) + 0.0 AS mean, round(stddev_pop({n}), 6) + 0.0 AS std, round(quantile_cont({n}, 0.025), 6) + 0.0 AS ci_lower, round(quantile_cont({n}, 0.975), 6) + 0.0 AS ci_upper FROM m" for n in FIVE
)


def linear_eval(spark, d):
    return _five(probe.evaluate_linear(_test(spark, d), _train(spark, d), 1.0), "c")


def linear_cv(spark, d):
    return _five(probe.evaluate_linear(_test(spark, d), _train(spark, d)), "c")


def linear_bootstrap(spark, d):
    return _five(probe.bootstrap_linear(_test(spark, d), _train(spark, d), REPS), "rep")


QUERIES |= {"linear_eval": linear_eval, "linear_cv": linear_cv, "linear_bootstrap": linear_bootstrap}
QUERIES["cv_folds"] = lambda spark, d: probe.folds(_train(spark, d)).select("row_id", "label", F.col("fold").cast("long").alias("fold"))
ORACLES["cv_folds"] = f"WITH {TRAIN} SELECT row_id, label, ntile(3) OVER (PARTITION BY label ORDER BY row_id) - 1 AS fold FROM train"


def _methods(spark, d, *names):
    """Vectors of the raw embeddings and of pooled grids, by the method's name."""
    found = {"raw": fx.labelled(spark, d).select("row_id", "features")}
    grids = fx.patch44(spark, d)
    return found | {m: features(grids, m).withColumnRenamed("patch_id", "row_id") for m in names}


def knn_sweep(spark, d):
    """The raw vectors and all poolers of bands, two kinds of split, two training sizes, the default five k."""
    out = probe.sweep(fx.features(spark, d), _methods(spark, d, *[m for m, _ in SQL_BLOCKS.values()]), KS, [N, -1])
    return _five(out, "pool", "split_type", "n_train", "k", "train_samples")


def _sweep_sql() -> str:
    """The same by one sub-query a method, kind of split and size."""
    vectors = {"raw": "SELECT row_id, features AS f FROM feats WHERE split_type = 'standard'"}
    for method, blocks in SQL_BLOCKS.values():
        values = " UNION ALL ".join(f"SELECT patch_id, {i} * 4 + band AS ord, {b} AS value FROM patch44 GROUP BY patch_id, band" for i, b in enumerate(blocks))
        vectors[method] = f"SELECT patch_id AS row_id, list(value ORDER BY ord) AS f FROM ({values}) GROUP BY patch_id"
    parts = []
    for pool, sql in vectors.items():
        for split in ("spatial", "standard"):
            for n in (N, -1):
                chosen = f"WITH {QUOTA}, {PICKED} SELECT row_id, label, features FROM picked" if n != -1 else "SELECT row_id, label, features FROM train"
                parts.append(f"""SELECT '{pool}' AS pool, '{split}' AS split_type, {n} AS n_train, k, used AS train_samples, {FIVE_SQL} FROM (
WITH vec AS ({sql}), own AS (SELECT row_id, label, f AS features, role FROM feats JOIN vec USING (row_id) WHERE split_type = '{split}'),
train AS (SELECT * FROM own WHERE role = 'train'), test AS (SELECT * FROM own WHERE role = 'test'), chosen AS ({chosen}), {_pairs('test', 'chosen')},
{_voted('k', f'(SELECT * FROM ranked, (SELECT unnest({KS}) AS k) WHERE rank <= k)')}, {_scores('k')} SELECT *, (SELECT count(*) FROM chosen) AS used FROM cls) GROUP BY k, used""")
    return f"WITH {fx.FEATURES}, {fx.PATCH44} " + " UNION ALL ".join(parts)


def knn_sweep_bootstrap(spark, d):
    """Intervals of the metrics over bootstraps, for two methods and two kinds of split."""
    out = probe.bootstrap_sweep(fx.features(spark, d), _methods(spark, d, "stats"), 5, SWEEP_REPS)
    return out.select("pool", "split_type", "metric", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean", "std", "ci_lower", "ci_upper")])


def linear_sweep(spark, d):
    """The raw vectors and all poolers of bands, two kinds of split, all training rows and a sample, the best of all six C."""
    out = probe.linear_sweep(fx.features(spark, d), _methods(spark, d, *[m for m, _ in SQL_BLOCKS.values()]), [N, -1])
    return _five(out, "pool", "split_type", "n_train", "train_samples", "c")


def linear_sweep_bootstrap(spark, d):
    """Intervals of the metrics of linear probes over all resamples, for two methods and two kinds of split."""
    out = probe.linear_bootstrap_sweep(fx.features(spark, d), _methods(spark, d, "stats"), REPS)
    return out.select("pool", "split_type", "metric", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("mean", "std", "ci_lower", "ci_upper")])


KS, SWEEP_REPS = [1, 3, 5, 7, 9], 20
QUERIES |= {"knn_sweep_bootstrap": knn_sweep_bootstrap, "linear_sweep": linear_sweep, "linear_sweep_bootstrap": linear_sweep_bootstrap}
QUERIES["knn_sweep"] = knn_sweep
ORACLES["knn_sweep"] = _sweep_sql()
