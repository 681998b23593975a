"""Codecs, sources, sampling, probes, metrics, fitted methods, reports and streams on small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalvec.functions import codecs
from zonalvec.operators import fitted, geo, metrics, probe, report, sampling
from zonalvec.sources import manifest, tables
from zonalvec.streaming import stream

RNG = np.random.default_rng(7)


def test_codecs(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.25,), (4.0,)], "v double")
    assert [r[0] for r in df.select(codecs.quantise_power(F.col("v"))).collect()] == [0, 127, 191, 254]
    assert [r[0] for r in spark.createDataFrame([(-128,), (127,)], "v tinyint").select(codecs.quantise_offset(F.col("v"))).collect()] == [0, 255]
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([(256,)], "v int").select(codecs.recode_u8(F.col("v"))).collect()
    row = spark.createDataFrame([([1.0, math.nan, math.inf, -math.inf],)], "f array<double>").select(codecs.sanitize(F.col("f")).alias("f"), codecs.odd_values(F.col("f")).alias("n")).first()
    assert row.f == [1.0, 0.0, 0.0, 0.0] and row.n == 3
    flat = spark.createDataFrame([(1, 0, 2.0), (1, 0, 2.0)], "patch_id long, band int, v double")
    assert {r.v for r in codecs.percentile_stretch(flat).collect()} == {0.0}


def test_manifest(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("Annual_Crop_12.jpg\n\n  River_3.jpg \nbroken.jpg\n")
    lines = manifest.read_lines(spark, str(path))
    assert {(r.rel_path, r.class_name) for r in manifest.entries(lines).collect()} == {("Annual_Crop/Annual_Crop_12", "Annual_Crop"), ("River/River_3", "River")}
    assert [r.error for r in manifest.rejected(lines).collect()] == ["no class in broken"]
    with pytest.raises(Exception, match="no class"):
        manifest.entries(lines, strict=True).collect()
    with pytest.raises(ValueError):
        manifest.split(lines, "standard", "other")


def test_labels(spark):
    classes = spark.createDataFrame([("a", 0), ("b", 1)], "class_name string, idx int")
    rows = spark.createDataFrame([("a",), ("c",)], "class_name string")
    assert [r.class_name for r in manifest.unknown_classes(rows, classes).collect()] == ["c"]
    with pytest.raises(Exception, match="unknown class: c"):
        manifest.encode_labels(rows, classes).collect()
    assert {(r.class_name, r.label) for r in manifest.encode_labels(rows, classes, strict=False).collect()} == {("a", 0), ("c", None)}


def test_pooled_table_overwrites_partitions(spark, tmp_path):
    path = str(tmp_path / "pooled")
    rows = spark.createDataFrame([("mean", "standard", "train", 1, 0, [1.0]), ("stats", "standard", "train", 1, 0, [2.0])], "method string, split_type string, role string, patch_id long, label int, features array<double>")
    tables.write_pooled(rows, path)
    tables.write_pooled(rows.filter("method = 'mean'").withColumn("patch_id", F.lit(9).cast("long")), path)
    assert {(r.method, r.patch_id) for r in tables.read_pooled(spark, path).collect()} == {("mean", 9), ("stats", 1)}


def test_quotas(spark):
    rows = spark.createDataFrame([(i, 0 if i < 7 else 1 if i < 9 else 2) for i in range(10)], "row_id long, label int")
    assert {r.label: r.quota for r in sampling.quotas(rows, 5).collect()} == {0: 4, 1: 1, 2: 1}
    assert {r.label: r.quota for r in sampling.quotas(rows, 10).collect()} == {0: 7, 1: 2, 2: 1}
    picked = sampling.subsample(rows, 5, seed=1)
    assert sorted(r.row_id for r in picked.collect()) == sorted(r.row_id for r in sampling.subsample(rows.repartition(5), 5, seed=1).collect())
    drawn = sampling.bootstrap(rows, 4).groupBy("rep", "label").agg(F.sum("mult").alias("n")).collect()
    assert all(r.n == {0: 7, 1: 2, 2: 1}[r.label] for r in drawn) and len(drawn) == 12


def _blobs(spark, n=90, d=4):
    y = np.arange(n) % 3
    x = np.eye(3, d)[y] * 4 + RNG.normal(size=(n, d)) * 0.3
    return spark.createDataFrame([(int(i), int(y[i]), [float(v) for v in x[i]]) for i in range(n)], "row_id long, label int, features array<double>"), x, y


def test_probes_on_separate_blobs(spark):
    rows, x, y = _blobs(spark)
    test, train = rows.filter("row_id % 5 = 0"), rows.filter("row_id % 5 <> 0")
    assert {round(r.accuracy, 6) for r in probe.evaluate_knn(test, train, [1, 5]).collect()} == {1.0}
    out = probe.evaluate_linear(test, train, 1.0).first()
    assert out.accuracy == 1.0 and out.c == 1.0
    assert probe.bootstrap_knn(test, train, 3, 2).count() == 2
    assert probe.bootstrap_linear(test, train, 1).first().accuracy == 1.0
    best, tried = probe.choose_c(train, (0.01, 1.0))
    assert len(tried) == 2 and best in (0.01, 1.0)


def test_linear_gradient_vanishes(spark):
    rows, x, y = _blobs(spark, 60)
    model = probe.fit_linear(rows, 1.0)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    z = x[:60] @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    gradient = w + (p - np.eye(3)[y[:60]]).T @ x[:60]
    assert np.abs(gradient).max() < 1e-3


def test_neighbours_ties_and_zero_vectors(spark):
    train = spark.createDataFrame([(5, 1, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (3, 0, [0.0, 0.0])], "row_id long, label int, features array<double>").repartition(3)
    test = spark.createDataFrame([(9, 1, [1.0, 0.0]), (8, 0, [0.0, 0.0])], "row_id long, label int, features array<double>")
    got = {(r.q, r.rank): (r.train_id, r.dist) for r in probe.neighbours(test, train, 3).collect()}
    assert [got[9, i][0] for i in (1, 2, 3)] == [2, 5, 3] and got[9, 3][1] == 1.0
    assert [got[8, i] for i in (1, 2, 3)] == [(2, 1.0), (3, 1.0), (5, 1.0)]
    assert probe.neighbours(test.limit(0), train, 1).count() == 0


def test_metrics_with_missing_and_unseen_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 3)], "y int, p int")
    m = metrics.metrics(df).first()
    assert m.accuracy == pytest.approx(0.5)
    assert m.recall_macro == pytest.approx(1 / 4) and m.precision_macro == pytest.approx((2 / 3) / 4)
    assert m.f1_macro == pytest.approx(0.8 / 4) and m.f1_weighted == pytest.approx(0.8 * 2 / 4)


def test_pca(spark):
    x = RNG.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1]
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "row_id long, features array<double>").repartition(4)
    model = fitted.PCA(5).fit(rows)
    np.testing.assert_allclose(model.components @ model.components.T, np.eye(5), atol=1e-9)
    assert model.variance.sum() == pytest.approx(model.total_variance)
    np.testing.assert_allclose(model.variance, np.sort(np.linalg.eigvalsh(np.cov(x, rowvar=False)))[::-1], rtol=1e-8)
    out = np.array([r.features for r in model.transform(rows).orderBy("row_id").collect()])
    np.testing.assert_allclose(out, (x - x.mean(0)) @ model.components.T, atol=1e-9)
    parts = fitted.merge_moments(fitted.moments(rows.filter("row_id < 20")), fitted.moments(rows.filter("row_id >= 20")))
    np.testing.assert_allclose(fitted.pca_from_moments(parts, 2).components, model.components[:2], atol=1e-7)
    with pytest.raises(ValueError):
        fitted.PCA(6).fit(rows)


def test_not_fitted(spark):
    with pytest.raises(fitted.NotFitted):
        fitted.PCA(2).transform(None)
    with pytest.raises(fitted.NotFitted):
        fitted.BoVW(2).transform(None)


def test_codebook(spark):
    pixels = spark.createDataFrame([(p, y, x, [float(v) for v in RNG.normal(size=3)]) for p in range(6) for y in range(4) for x in range(4)], "patch_id long, y int, x int, vec array<double>")
    model = fitted.BoVW(5).fit(pixels)
    sums = model.transform(pixels).groupBy("patch_id").agg(F.sum("value").alias("s"), F.count("*").alias("n")).collect()
    assert all(r.n == 5 and r.s == pytest.approx(1) for r in sums)


def test_geo(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "patch_id long, xmin double, ymin double, xmax double, ymax double")
    scenes = spark.sql("select * from values (7L, timestamp'2020-03-01', 5D, 20D, 5D, 20D), (8L, timestamp'2020-02-01', 9D, 20D, -5D, 1D), (9L, timestamp'2019-12-31', 0D, 9D, 0D, 9D), (6L, timestamp'2020-01-01', 10D, 20D, 0D, 9D) t(scene_id, ts, xmin, xmax, ymin, ymax)")
    for cell in (3.0, 100.0):
        assert [tuple(r) for r in geo.first_scene(boxes, scenes, 2020, cell).collect()] == [(1, 8)]
    points = spark.createDataFrame([(1, 15.0, 85.0)], "patch_id long, x double, y double")
    assert geo.world_to_rowcol(points, 10.0, 0.0, -10.0, 100.0).select("row", "col").first() == (1, 1)


def test_report(spark):
    res = spark.createDataFrame([("a", "mean", "standard", 0.9), ("a", "mean", "spatial", 0.8), ("b", "mean", "standard", 0.7), ("b", "mean", "spatial", 0.5), ("a", "max", "standard", 0.6)], "dataset string, pool string, split_type string, accuracy double")
    assert [r.pool for r in report.shared_methods(res).collect()] == ["mean"]
    v = res.withColumnRenamed("accuracy", "value")
    assert {(r.dataset, r.pool): round(r.gap, 6) for r in report.gaps(v).collect()} == {("a", "mean"): 10.0, ("b", "mean"): 20.0}
    assert report.mean_gaps(v).first().gap == pytest.approx(15.0)
    shades = report.shaded(spark.createDataFrame([("x", 1.0, "m"), ("x", 1.0, "n")], "g string, value double, pool string"), "value", "g").collect()
    assert {r.shade for r in shades} == {25}


def test_streams_equal_batches(spark):
    rows = spark.createDataFrame([(f"z{i % 3}", float(RNG.normal())) for i in range(200)], "zone string, v double")
    batch = {r.zone: r for r in stream.zone_stats(rows).collect()}
    for r in stream.run_to_table(stream.zone_stats(stream.arriving(rows, 3)), "complete").collect():
        assert r.n == batch[r.zone].n and r["mean"] == pytest.approx(batch[r.zone]["mean"]) and r["std"] == pytest.approx(batch[r.zone]["std"])
    feats = spark.createDataFrame([([float(a) for a in RNG.normal(size=3)],) for _ in range(50)], "features array<double>")
    np.testing.assert_allclose(stream.fit_pca(stream.arriving(feats, 4), 2).components, fitted.PCA(2).fit(feats).components, atol=1e-7)


def test_removal_of_the_training_data_subpackage():
    """Nothing outside the subpackage names it but the entry file."""
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for path in [*(root / "zonalvec").rglob("*.py"), *(root / "tests").glob("*.py")]:
        if "llm" not in path.parts and path.name != Path(__file__).name:
            assert "zonalvec.llm" not in path.read_text() and "from .llm" not in path.read_text(), path


def test_public_names():
    import zonalvec

    assert all(getattr(zonalvec, name) is not None for name in zonalvec.__all__)
    with pytest.raises(AttributeError):
        zonalvec.nothing


def test_ids_and_labels_from_any_number(spark, tmp_path):
    from zonalvec import fixtures as fx
    from zonalvec.plans import sources

    d = str(tmp_path)
    rows = [(100 + i, [float(i)] * 64, i) for i in range(8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i, f"type {i}") for i in range(7)], "p_partkey long, p_type string").write.parquet(f"{d}/part.parquet")
    assert {r.cluster: r.centre for r in fx.codebook(spark, d).collect()} == {i: [0.0] * 4 for i in range(8)}
    assert {r.vec_id: r.class_name for r in sources.label_decode(spark, d).collect()} == {100 + i: f"type {i}" for i in range(7)}
