"""Aggregates that are kept and merged, seeding, draws in place and boxes of all sizes: against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalvec import storage
from zonalvec.operators import fitted, geo, pool, sampling, sketches
from zonalvec.plans import report
from zonalvec.sources import manifest
from zonalvec.streaming import stream

from . import oracle

RNG = np.random.default_rng(23)
BOX = "{} long, xmin double, ymin double, xmax double, ymax double"


def _boxes(spark, name, n, most, extra=()):
    size = 2.0 ** RNG.uniform(-3, most, (n, 2))
    low = RNG.uniform(-200, 200, (n, 2))
    rows = [(i, float(a), float(b), float(a + w), float(b + h)) for i, ((a, b), (w, h)) in enumerate(zip(low, size))]
    return spark.createDataFrame([*rows, *extra], BOX.format(name)), rows


def test_boxes_of_all_sizes(spark):
    odd = [(900, None, 0.0, 1.0, 1.0), (901, 0.0, 0.0, float("inf"), 1.0), (902, float("nan"), 0.0, 1.0, 1.0)]
    boxes, a = _boxes(spark, "patch_id", 80, 9, odd)
    scenes, b = _boxes(spark, "scene_id", 90, 9, odd)
    point = (800, 5.0, 5.0, 5.0, 5.0)
    boxes, a = boxes.unionByName(spark.createDataFrame([point], boxes.schema)), [*a, point]
    expected = sorted((p[0], s[0]) for p in a for s in b if p[1] < s[3] and s[1] < p[3] and p[2] < s[4] and s[2] < p[4])
    for cell in (0.7, 50.0, 5000.0):
        got = geo.overlapping(boxes, scenes, cell).select("p.patch_id", "s.scene_id").collect()
        assert sorted(map(tuple, got)) == expected
    assert expected
    assert geo.overlapping(boxes, scenes.limit(0), 1.0).count() == 0


def test_keys_of_a_box_do_not_grow_with_it(spark):
    continent = spark.createDataFrame([(1, 0.0, 0.0, 4e6, 3e6)], BOX.format("patch_id"))
    field = spark.createDataFrame([(1, 1e6, 1e6, 1e6 + 10, 1e6 + 10)], BOX.format("scene_id"))
    assert geo.overlapping(continent, field, 10.0).count() == 1  # tiles of one size would be 10^11


def test_unknown_labels(spark):
    classes = spark.createDataFrame([("a", 0), ("b", 1)], "class_name string, idx int")
    rows = spark.createDataFrame([(1, 0), (2, 7), (3, None)], "id int, label int")
    assert [r.class_name for r in manifest.decode_labels(rows, classes, strict=False).orderBy("id").collect()] == ["a", None, None]
    with pytest.raises(Exception, match="unknown label: (7|null)"):
        manifest.decode_labels(rows, classes).collect()
    assert manifest.decode_labels(rows.filter("label = 0"), classes).first().class_name == "a"


def _values(spark, n, parts):
    return spark.range(0, n, 1, parts).select((F.col("id") % 3).alias("patch_id"), (F.col("id") % 2).cast("int").alias("band"), F.lit(2).alias("d"), (F.rand(5) * F.rand(6)).alias("v"))


def test_sketches_are_exact_while_small(spark):
    rows = storage.written(_values(spark, 3000, 4), "values")
    got = {(r.patch_id, r.ord): r.value for r in sketches.percentiles(sketches.merged(sketches.sketched(rows, ("patch_id",)))).collect()}
    x = rows.toPandas()
    for (p, b), own in x.groupby(["patch_id", "band"]):
        for i, q in enumerate(pool.PERCENTILES):
            assert got[p, 2 * i + b] == np.quantile(own["v"], q / 100, method="inverted_cdf")


def test_sketches_of_zones_roll_up_within_their_error(spark):
    rows = storage.written(_values(spark, 300_000, 6), "values").withColumn("zone", F.col("patch_id") * 100 + F.floor(F.rand(9) * 20))
    stored = sketches.sketched(rows, ("patch_id", "zone"), k=1024)
    found = sketches.percentiles(sketches.merged(stored, ("patch_id",), k=1024)).collect()
    x = rows.select("patch_id", "band", "v").toPandas()
    for r in found:
        own = np.sort(x[(x.patch_id == r.patch_id) & (x.band == r.ord % 2)]["v"].to_numpy())
        assert abs(np.searchsorted(own, r.value, side="right") / len(own) - pool.PERCENTILES[r.ord // 2] / 100) < 0.006
    assert len(found) == 3 * 2 * 5


def test_sketches_of_odd_values(spark):
    rows = spark.createDataFrame([(1, 0, 2, 1.0), (1, 0, 2, float("nan")), (1, 1, 2, 4.0), (1, 1, 2, None), (2, 0, 2, None)], "patch_id long, band int, d int, v double")
    got = {(r.patch_id, r.ord): r.value for r in sketches.percentiles(sketches.merged(sketches.sketched(rows)), of=(50,)).collect()}
    assert np.isnan(got[1, 0]) and got[1, 1] == 4.0 and got[2, 0] is None
    assert sketches.percentiles(sketches.merged(sketches.sketched(rows.limit(0)))).count() == 0


def test_folded_batches_equal_the_whole_and_go_on(spark):
    rows = [(int(p), [float(v) for v in RNG.normal(1e6, 1, 3)]) for p in RNG.integers(0, 4, 90)]
    pixels = spark.createDataFrame(rows, "patch_id long, vec array<double>")
    parts = [spark.createDataFrame(rows[k::3], pixels.schema) for k in range(3)]
    whole = {(r.patch_id, r.ord): r.value for r in pool.covariance(pixels).collect()}
    arriving, folder = storage.new_folder(spark, "arriving"), storage.new_folder(spark, "kept")
    for part in parts:  # a call of its own for each part
        part.write.mode("append").parquet(arriving)
        kept = stream.folded(stream.folder_stream(spark, part, arriving, 2), pool.pixel_moments, pool.merged_moments, folder)
    got = {(r.patch_id, r.ord): r.value for r in pool.covariance_cells(kept).collect()}
    assert got.keys() == whole.keys()
    np.testing.assert_allclose([got[k] for k in whole], list(whole.values()), rtol=1e-6)
    assert len(storage.children(spark, f"{folder}/tables")) <= 2
    empty = storage.new_folder(spark, "arriving")
    pixels.limit(0).write.parquet(empty)
    assert stream.folded(stream.folder_stream(spark, pixels, empty), pool.pixel_moments, pool.merged_moments).count() == 0


def test_mergeable_poolers(spark, monkeypatch):
    monkeypatch.setattr(pool, "MERGED_AT_ONCE", 2)
    spread = pool.Mergeable(lambda x: np.r_[len(x), x.sum(0), (x * x).sum(0)], lambda s: s.sum(0), lambda s: s[3:] / s[0] - (s[1:3] / s[0]) ** 2, 2)
    x, p = RNG.normal(size=(500, 2)), np.where(RNG.random(500) < 0.6, 7, RNG.integers(0, 30, 500))
    pixels = spark.createDataFrame([*[(int(a), [float(v) for v in b]) for a, b in zip(p, x)], (99, None)], "patch_id long, vec array<double>").repartition(9)
    got = {r.patch_id: r.features for r in pool.custom_mergeable(pixels, spread).collect()}
    assert set(got) == set(p.tolist())
    for patch in got:
        np.testing.assert_allclose(got[patch], x[p == patch].var(0), atol=1e-12)
    with pytest.raises(Exception, match="gave shape"):
        pool.custom_mergeable(pixels, pool.Mergeable(spread.update, spread.merge, lambda s: s, 2)).collect()
    assert pool.custom_mergeable(pixels.limit(0), spread).count() == 0


def test_shares_of_draws_are_multinomial():
    sizes = np.array([5, 0, 20, 75, 1])
    drawn = np.array([[sampling.shared_draws(sizes, 101, at, 42, rep, 0) for at in range(5)] for rep in range(2000)])
    assert (drawn.sum(1) == 101).all() and (drawn[:, 1] == 0).all()
    np.testing.assert_allclose(drawn.mean(0), sizes, atol=0.6)
    share = sizes / 101
    np.testing.assert_allclose(np.cov(drawn.T), 101 * (np.diag(share) - np.outer(share, share)), atol=2.0)


def test_bootstrap_in_place(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SEGMENT_BITS", 4)
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else "ab"[i % 3 == 0]) for i in range(400)], "row_id long, label string").repartition(5)
    got = sampling.bootstrap_in_place(rows, 60, seed=1).toPandas()
    assert list(got.columns) == ["rep", "row_id", "label", "mult"] and (got.mult > 0).all() and not got.duplicated(["rep", "row_id"]).any()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    totals = got.assign(label=got.label.where(got.label.notna(), "none")).groupby(["label", "rep"])["mult"].sum().unstack()
    assert all((totals.loc[c or "none"] == n).all() for c, n in sizes.items()) and totals.shape == (3, 60)
    labels = {r["row_id"]: r["label"] for r in rows.collect()}
    assert all(labels[i] == (c if isinstance(c, str) else None) for i, c in zip(got.row_id, got.label))
    # Poisson-like multiplicities of every row, whatever its segment.
    per_row = got.groupby("row_id")["mult"].sum().reindex(range(400), fill_value=0)
    assert abs(per_row.mean() - 60) < 1e-9 and 45 < per_row.var() < 78
    assert abs((len(got) / (400 * 60)) - (1 - np.exp(-1))) < 0.01
    again = sampling.bootstrap_in_place(rows, 60, seed=1).toPandas()
    key = ["rep", "row_id"]
    assert again.sort_values(key)["mult"].tolist() == got.sort_values(key)["mult"].tolist()
    assert sampling.bootstrap_in_place(rows.limit(0), 3).count() == 0


def _clusters(spark, n, k):
    centres = RNG.uniform(-50, 50, (k, 2))
    x = centres[RNG.integers(0, k, n)] + RNG.normal(size=(n, 2))
    return spark.createDataFrame([(i // 16, i % 16 // 4, i % 4, [float(v) for v in r]) for i, r in enumerate(x)], "patch_id long, y int, x int, vec array<double>")


def test_seeded_mini_batches_come_near_the_whole_fit(spark):
    pixels = storage.written(_clusters(spark, 1600, 12), "pixels")
    whole = fitted.inertia(pixels, fitted.BoVW(12, iterations=20).fit(pixels).codebook(spark)).first().inertia
    model = fitted.fit_mini_batch(pixels, 12, batch=400, epochs=2)
    assert len(model.centres) == 12
    assert fitted.inertia(pixels, model.codebook(spark)).first().inertia <= 1.05 * whole


def test_a_mini_batch_is_one_job(spark):
    pixels, used = storage.written(_clusters(spark, 480, 3), "pixels"), []
    for epochs in (1, 3):
        spark.sparkContext.setJobGroup(f"epochs-{epochs}", "mini-batches")
        fitted.fit_mini_batch(pixels, 3, batch=60, epochs=epochs, starved=0.0)
        used.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"epochs-{epochs}")))
    spark.sparkContext.setJobGroup("after", "")
    assert used[1] - used[0] == 16  # eight batches twice more


def test_seeding_of_few_and_equal_pixels(spark):
    same = spark.createDataFrame([(i, 0, 0, [1.0, 2.0]) for i in range(9)], "patch_id long, y int, x int, vec array<double>")
    np.testing.assert_allclose(fitted.seeded_centres(same, 3), [[1.0, 2.0]])
    with pytest.raises(ValueError, match="no pixels"):
        fitted.seeded_centres(same.limit(0), 3)
    with pytest.raises(ValueError, match="no pixels"):
        fitted.fit_mini_batch(same.limit(0), 3)


def test_rolled_up_percentiles_of_zones_larger_than_their_sketches(spark, data, monkeypatch):
    monkeypatch.setattr(report, "ROLLED_K", 64)
    got = oracle.rows(report.pool_percentiles_rollup(spark, data).toPandas())
    assert got == oracle.rows(oracle.connection(data).execute(report.ORACLES["pool_percentiles_rollup"]).df())


def test_exact_percentiles_from_brackets(spark, monkeypatch):
    x = RNG.normal(size=3000).tolist()
    rows = [(i % 2 or None, 0, x[i]) for i in range(3000)] + [(1, 1, float(i % 3)) for i in range(2000)] + [(2, 0, float("nan")), (2, 0, 1.0), (3, 0, None), (4, 0, None), (4, 0, 7.0)]
    long = spark.createDataFrame(rows, "patch_id long, band int, v double").withColumn("d", F.lit(2)).repartition(5)
    least = lambda own, q: sorted(own)[max(1, -(-len(own) * q // 100)) - 1]
    for wide in (4, 0):  # brackets that hold nothing but a value or two miss some places, which are found all the same
        monkeypatch.setattr(sketches, "WIDE", wide)
        got = {(r.patch_id, r.ord): r.value for r in sketches.exact(long, sketches.sketched(long, k=256), k=256).collect()}
        for i, q in enumerate(pool.PERCENTILES):
            assert got[1, 2 * i] == least(x[1::2], q) and got[None, 2 * i] == least(x[::2], q) and got[1, 2 * i + 1] == least([j % 3 for j in range(2000)], q)
            assert np.isnan(got[2, 2 * i]) and got[3, 2 * i] is None and got[4, 2 * i] == 7.0
        assert len(got) == 30
