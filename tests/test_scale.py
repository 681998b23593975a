"""What must hold whatever the size: blocks, parts of classes, merged moments, shared folders, restarts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalvec import storage
from zonalvec.functions import codecs
from zonalvec.operators import fitted, linear, metrics, order, pool, probe, report, sampling
from zonalvec.storage import written
from zonalvec.streaming import stream

RNG = np.random.default_rng(11)


def test_no_machine_local_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        def __init__(self, master):
            self.sparkContext = type("C", (), {"master": master})()

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_dir(Session(master))
    here = Session("local[4]")
    assert storage.shared_dir(here).startswith("file:///") and storage.shared_dir(here) == storage.shared_dir(here)


def test_files_of_an_earlier_table_go(spark):
    first = storage.written(spark.range(10), "first")
    path = storage._folders[first]
    assert storage.exists(spark, path)
    second = storage.written(first.selectExpr("id + 1 AS id"), "second", instead_of=first)
    assert not storage.exists(spark, path) and second.count() == 10
    storage.dropped(spark.range(3), second)
    assert not storage.exists(spark, path)


def test_numbers_of_equal_rows_are_cut_into_parts(spark):
    rows = spark.createDataFrame([(5 if i % 3 else i, i) for i in range(900)], "k long, v long").repartition(4)
    found, n = order.numbered(rows, "k")
    assert n == 900 and sorted(r.row for r in found.collect()) == list(range(900))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    parts = found.groupBy(F.input_file_name().alias("file")).count().collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert max(r["count"] for r in parts) < 450  # 600 rows share one value
    by_k = sorted((r.row, r.k) for r in found.collect())
    assert [k for _, k in by_k] == sorted(k for _, k in by_k)


def _vectors(spark, n, d, first=0, parts=3):
    x = RNG.integers(-3, 4, size=(n, d)).astype(float)  # many ties and some zero vectors
    rows = [(first + i, int(i % 4), i % 2, [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, label int, side int, features array<double>").repartition(parts), x


def _brute(test, train, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    near = np.round(1 - unit(test) @ unit(train).T, 9)
    return [sorted(range(len(train)), key=lambda j: (near[i, j] + 0.0, j))[:k] for i in range(len(test))]


@pytest.mark.parametrize("tile", [512, 3])
def test_neighbours_by_blocks_are_those_of_brute_force(spark, monkeypatch, tile):
    for name, value in (("QUERY_TILE", tile), ("TRAIN_TILE", tile + 2), ("QUERY_TILES", 2), ("TRAIN_TILES", 3)):
        monkeypatch.setattr(probe, name, value)
    test, a = _vectors(spark, 20, 3, 1000)
    train, b = _vectors(spark, 60, 3)
    got = {(r.q - 1000, r["rank"]): r.train_id for r in probe.neighbours(test, train, 7).collect()}
    for i, own in enumerate(_brute(a, b, 7)):
        assert [got[i, n + 1] for n in range(7)] == own
    assert probe.distances(test, train).count() == 1200
    # Apart by group: only rows of the own side are neighbours.
    got = {(r.q - 1000, r["rank"]): r.train_id for r in probe.neighbours(test, train, 4, group="side").collect()}
    for i in range(20):
        own = [j for j in range(60) if j % 2 == i % 2]
        assert [got[i, n + 1] for n in range(4)] == [own[j] for j in _brute(a[i : i + 1], b[own], 4)[0]]

def test_tiles_that_cannot_hold_a_neighbour_are_not_compared(spark, monkeypatch):
    for name, value in (("QUERY_TILE", 64), ("TRAIN_TILE", 64), ("CELL_ROWS", 64), ("LEAST_CELLS", 2), ("HELD", 2), ("PACK", 16), ("PACKS", 2), ("QUERY_TILES", 3), ("TRAIN_TILES", 4)):
        monkeypatch.setattr(probe, name, value)
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(40, 16))
    near = lambda n: middles[rng.integers(0, 40, n)] + 0.02 * rng.normal(size=(n, 16))
    a, b = near(300), near(3000)
    b[1000:2000] = b[0]  # a third of the rows are copies of one vector
    a[:40], a[40], b[2500] = b[0], 0.0, 0.0  # queries among the copies, and vectors without a direction
    frame = lambda x, first: spark.createDataFrame([(first + i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, label int, features array<double>")
    test, train = frame(a, 10_000), frame(b, 0)
    for k in (1, 7):
        out = probe.searched(test, train, k, counted=True)
        got = {(r.q - 10_000, r["rank"]): r.train_id for r in out.found.collect()}
        assert [[got[i, n + 1] for n in range(k)] for i in range(300)] == _brute(a, b, k)
    # The query without a direction is as far from all, and so its tile is compared with all; most others are not.
    assert out.compared < 0.3 * out.pairs
    copies = probe.searched(test.filter("row_id < 10040"), train, 7, counted=True)
    assert {r.train_id for r in copies.found.collect()} == {0, *range(1000, 1006)}
    # A third of all tiles hold copies only, at distance 0: those with the least ids are enough.
    assert copies.compared < 0.05 * copies.pairs


def test_neighbours_of_random_vectors_by_key_and_in_small_tables(spark, monkeypatch):
    for name, value in (("QUERY_TILE", 8), ("TRAIN_TILE", 8), ("CELL_ROWS", 6), ("LEAST_CELLS", 2), ("PACK", 2), ("PACKS", 1)):
        monkeypatch.setattr(probe, name, value)
    test, a = _vectors(spark, 25, 4, 1000)
    train, b = _vectors(spark, 90, 4)
    both = train.withColumn("n", F.lit(90)).unionByName(train.filter("row_id < 30").withColumn("n", F.lit(30)))
    got = {(r.n, r.q - 1000, r["rank"]): r.train_id for r in probe.neighbours(test, both, 5, key="n").collect()}
    for n in (30, 90):
        assert [[got[n, i, m + 1] for m in range(5)] for i in range(25)] == _brute(a, b[:n], 5)
    # Apart by group: only rows of the own side are neighbours.
    got = {(r.q - 1000, r["rank"]): r.train_id for r in probe.neighbours(test, train, 4, group="side").collect()}
    for i in range(25):
        own = [j for j in range(90) if j % 2 == i % 2]
        assert [got[i, m + 1] for m in range(4)] == [own[j] for j in _brute(a[i : i + 1], b[own], 4)[0]]
    # More neighbours than there are rows: all of them.
    assert probe.neighbours(test, train.filter("row_id < 3"), 5).count() == 75
    assert probe.neighbours(test.limit(0), train, 5).count() == probe.neighbours(test, train.limit(0), 5).count() == 0


def test_folds_are_contiguous_parts(spark):
    rows = spark.createDataFrame([(i, 0 if i < 8 else 1 if i < 10 else 2) for i in range(11)], "row_id long, label int").repartition(3)
    got = {r.row_id: r.fold for r in probe.folds(rows, 3).collect()}
    assert [got[i] for i in range(11)] == [0, 0, 0, 1, 1, 1, 2, 2, 0, 1, 0]


def test_no_window_over_a_class(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(40)], "row_id long, label int")
    for df in (sampling.subsample(rows, 10), sampling.bootstrap(rows, 2), sampling.size_curve(rows, [10, -1]), probe.folds(rows)):
        assert "windowspecdefinition(label#" not in df._jdf.queryExecution().analyzed().toString()


def test_covariance_of_parts_with_large_means(spark, monkeypatch):
    monkeypatch.setattr(pool, "HELD_VALUES", 20)
    x = {p: RNG.normal(size=(n, 3)) + 1e7 for p, n in ((1, 200), (2, 2), (3, 1))}
    rows = spark.createDataFrame([(p, [float(v) for v in r]) for p, m in x.items() for r in m], "patch_id long, vec array<double>").repartition(9)
    got = {}
    for r in pool.covariance(rows).collect():
        got.setdefault(r.patch_id, {})[r.ord] = r.value
    for p in (1, 2):
        np.testing.assert_allclose([got[p][i] for i in range(6)], np.cov(x[p], rowvar=False)[np.triu_indices(3)], rtol=1e-6, atol=1e-7)
    assert all(np.isnan(v) for v in got[3].values())
    assert pool.covariance(rows.limit(0)).count() == 0


def test_odd_values_make_their_bands_odd(spark):
    rows = [(1, 0, i, 1, 2, 2, float("nan") if i == 1 and b == 0 else float(i + b), b) for i in range(2) for b in range(2)]
    long = spark.createDataFrame(rows, "patch_id long, y int, x int, h int, w int, d int, v double, band int")
    got = {r.ord: r.value for r in pool.pool_long(long, pool.signed_gem()).collect()}
    # The floor hides a NaN from Spark's greatest as little as from NumPy's maximum.
    assert np.isnan(got[0]) and not np.isnan(got[1]) and not np.isnan(got[3])


def test_approximate_percentiles(spark):
    rows = spark.range(5000).select(F.lit(1).alias("patch_id"), F.lit(0).alias("band"), F.lit(1).alias("d"), F.col("id").cast("double").alias("v"))
    got = [r.value for r in pool.pool_long(rows, pool.percentiles((10, 50, 90), accuracy=100)).orderBy("ord").collect()]
    np.testing.assert_allclose(got, [500, 2500, 4500], atol=50)


def test_constants_and_empty_selections(spark):
    flat = spark.createDataFrame([("g", 2.0)] * 4, "g string, v double")
    (one,) = report.density(flat, "v", "g", bins=4).collect()
    assert one.bin == 2 and one.density == pytest.approx(4.0)
    assert spark.range(1).select(codecs.minmax_vector(F.array(F.lit(3.0), F.lit(3.0)), 0.0).alias("x")).first().x == [0.0, 0.0]
    res = spark.createDataFrame([("a", "mean", "knn_5")], "dataset string, pool string, probe string")
    with pytest.raises(ValueError, match="no results"):
        report.selected(res, "linear")


def _shuffled(spark):
    """Bytes that all stages of the session have written for exchanges."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(60_000)
    found = context.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_what_a_search_exchanges_grows_as_the_rows_do(spark, monkeypatch):
    for name, value in (("QUERY_TILE", 16), ("TRAIN_TILE", 16), ("CELL_ROWS", 16), ("LEAST_CELLS", 2), ("CENTRES", 4)):
        monkeypatch.setattr(probe, name, value)
    rng, used = np.random.default_rng(3), []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (600, 4800):
            x = rng.normal(size=(n, 64))  # nothing near anything: no pair of tiles can be left out
            rows = storage.written(spark.createDataFrame([(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, label int, features array<double>"), "rows")
            before = _shuffled(spark)
            assert probe.neighbours(rows.filter("row_id % 4 = 0"), rows.filter("row_id % 4 > 0"), 3).count() == n // 4 * 3
            used.append(_shuffled(spark) - before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert used[1] < 10 * used[0]  # eight times the rows; with a copy for each pair of tiles 20 times


def test_a_search_writes_no_more_than_the_nearest_rows(spark, monkeypatch):
    """k rows a query, in however many blocks rows were compared, with a first pass and without."""
    for name, value in (("QUERY_TILE", 16), ("TRAIN_TILE", 16), ("CELL_ROWS", 16), ("CENTRES", 4)):
        monkeypatch.setattr(probe, name, value)
    x, kept, write = np.random.default_rng(9).normal(size=(600, 8)), [], probe.written
    monkeypatch.setattr(probe, "written", lambda df, what, *of: kept.append((what, write(df, what, *of))) or kept[-1][1])
    rows = storage.written(spark.createDataFrame([(i, i % 3, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, label int, features array<double>"), "rows")
    own = np.flatnonzero(np.arange(600) % 4 > 0)
    for least in (2, 10_000):
        monkeypatch.setattr(probe, "LEAST_CELLS", least)
        found = probe.neighbours(rows.filter("row_id % 4 = 0"), rows.filter("row_id % 4 > 0"), 5).orderBy("q", "rank").toPandas()
        assert [df.count() for what, df in kept if what == "nearest"] == [750]
        assert found.train_id.to_numpy().reshape(150, 5).tolist() == own[np.array(_brute(x[::4], x[own], 5))].tolist()
        kept.clear()


def test_all_pairs_are_spread_over_tasks_by_their_number(spark, monkeypatch):
    for name, value in (("QUERY_TILE", 8), ("TRAIN_TILE", 8), ("BLOCKS", 1)):
        monkeypatch.setattr(probe, name, value)
    monkeypatch.setattr(probe, "PAIRS", 500, raising=False)
    x = np.random.default_rng(10).normal(size=(240, 4))
    rows = storage.written(spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, label int, features array<double>"), "rows")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        pairs = probe.distances(rows.filter("row_id % 4 = 0"), rows.filter("row_id % 4 > 0")).withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(pairs) == len(pairs.drop_duplicates(["q", "train_id"])) == 60 * 180
    assert pairs.groupby("task").size().max() < 60 * 180 / 4  # one block held all pairs


def test_all_pairs_exchange_each_tile_once(spark, monkeypatch):
    for name, value in (("QUERY_TILE", 8), ("TRAIN_TILE", 8), ("BLOCKS", 1), ("PAIRS", 8000)):
        monkeypatch.setattr(probe, name, value)
    rng, used = np.random.default_rng(12), []
    for n in (240, 1920):
        x = rng.normal(size=(n, 64))
        rows = storage.written(spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, label int, features array<double>"), "rows")
        before = _shuffled(spark)
        pairs = probe.distances(rows.filter("row_id % 4 = 0"), rows.filter("row_id % 4 > 0")).toPandas()
        used.append(_shuffled(spark) - before)
        assert len(pairs) == len(pairs.drop_duplicates(["q", "train_id"])) == (n // 4) * (n - n // 4)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert np.abs(1 - (x[pairs.q] * x[pairs.train_id]).sum(1) - pairs.dist).max() < 1e-9
    assert used[1] < 12 * used[0]  # eight times the rows; dealt to blocks, each with a copy, more and more copies


def test_bootstrapped_neighbours_are_not_multiplied_by_repetitions(spark, monkeypatch):
    """Fifty times the repetitions exchange less than eleven times as much, and the votes are those of lists redrawn one by one, also where all lists are asked for again."""
    rng = np.random.default_rng(4)
    x, reps, k = rng.normal(size=(400, 6)), 40, 3
    rows = storage.written(spark.createDataFrame([(i, int(i % 3), [float(v) for v in r]) for i, r in enumerate(x)], "row_id long, label int, features array<double>"), "rows")
    test, train = rows.filter("row_id % 4 = 0"), rows.filter("row_id % 4 > 0")
    mult = {(r.rep, r.row_id): r.mult for r in sampling.bootstrap(train, reps).collect()}
    own = np.flatnonzero(np.arange(400) % 4 > 0)
    near = {q: own[i] for q, i in zip(range(0, 400, 4), _brute(x[::4], x[own], len(own)))}
    expected = []
    for rep in range(reps):
        right = 0
        for q, ids in near.items():
            drawn = np.repeat(ids, [mult.get((rep, int(i)), 0) for i in ids])[:k] % 3
            right += int(np.bincount(drawn, minlength=3).argmax() == q % 3)
        expected.append(right / len(near))
    for reach in (None, 2):
        if reach:
            monkeypatch.setattr(probe, "_reach", lambda k, lists: reach)
        got = {r.rep: r.accuracy for r in probe.bootstrap_knn(test, train, k, reps, margin=0 if reach else 16).collect()}
        np.testing.assert_allclose([got[r] for r in range(reps)], expected)
    used = {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (2, 100):
            before = _shuffled(spark)
            probe.bootstrap_knn(test, train, k, n).count()
            used[n] = _shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert used[100] < 11 * used[2], used


def _pixels(spark, n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 2)) + np.arange(n)[:, None] % 3 * 5
    return spark.createDataFrame([(i, 0, i, [float(v) for v in x[i]]) for i in range(n)], "patch_id long, y int, x int, vec array<double>")


def test_codebook_of_a_stream_goes_on_after_a_restart(spark):
    first, parts = np.array([[0.0, 0.0], [5.0, 5.0], [9.0, 9.0]]), [_pixels(spark, 60, k).coalesce(1) for k in range(3)]
    whole = stream.fit_codebook(stream.arriving_parts(*parts), first)
    arriving, folder = storage.new_folder(spark, "arriving"), storage.new_folder(spark, "book")
    for part in parts:  # a call of its own for every part, each beginning from the folder
        part.write.mode("append").parquet(arriving)
        centres = stream.fit_codebook(stream.folder_stream(spark, part, arriving), np.full((3, 2), 77.0) if part is not parts[0] else first, folder=folder)
    np.testing.assert_allclose(centres, whole, rtol=1e-9)


def test_mini_batches_find_the_clusters(spark):
    pixels = _pixels(spark, 300, 5)
    model = fitted.fit_mini_batch(pixels, 3, batch=60, epochs=3)
    again = fitted.fit_mini_batch(pixels.repartition(5), 3, batch=60, epochs=3)
    np.testing.assert_allclose(model.centres, again.centres)
    found = fitted.inertia(pixels, model.codebook(spark)).first()
    total = fitted.inertia(pixels, fitted.BoVWModel(np.array([[5.0, 5.0]])).codebook(spark)).first().inertia
    assert found.n == 300 and found.inertia < 0.5 * total


def test_sweeps(spark):
    y = np.arange(60) % 3
    x = np.eye(3)[y] * 4 + RNG.normal(size=(60, 3)) * 0.3
    rows = [(int(i), int(y[i]), [float(v) for v in x[i]], s, "test" if i % 5 == (0 if s == "a" else 1) else "train") for i in range(60) for s in ("a", "b")]
    feats = spark.createDataFrame(rows, "row_id long, label int, features array<double>, split_type string, role string")
    methods = {"raw": feats.filter("split_type = 'a'").select("row_id", "features"), "first": feats.filter("split_type = 'a'").select("row_id", F.slice("features", 1, 2).alias("features"))}
    got = probe.sweep(feats, methods, [1, 3], [12, -1]).collect()
    assert len(got) == 16 and {(r.n_train, r.train_samples) for r in got} == {(12, 12), (-1, 48)}
    for r in got:  # as one evaluation by itself
        if r.n_train == -1:
            own = feats.filter(F.col("split_type") == r.split_type).drop("features").join(methods[r.pool], "row_id")
            one = probe.evaluate_knn(own.filter("role = 'test'"), own.filter("role = 'train'"), [r.k]).first()
            assert r.accuracy == pytest.approx(one.accuracy) and r.f1_macro == pytest.approx(one.f1_macro)
    linear = probe.linear_sweep(feats, {"raw": methods["raw"]}, [-1], 1.0).collect()
    assert len(linear) == 2 and all(r.accuracy == 1.0 for r in linear)
    boot = probe.bootstrap_sweep(feats, {"raw": methods["raw"]}, 3, 5).collect()
    assert len(boot) == 10 and all(r.ci_lower <= r["mean"] <= r.ci_upper for r in boot)


def test_pixel_moments_of_sparse_and_dense_patches():
    rng = np.random.default_rng(5)
    patches = np.r_[np.repeat(7, pool.DENSE + 40), rng.integers(0, 30, 300)]
    x = rng.normal(size=(len(patches), 4)) + 50
    found, n, mean, products = pool._merged([pool._pixel_moments(patches[k::3], x[k::3]) for k in range(3)])
    assert found.tolist() == sorted(set(patches.tolist())) and n.sum() == len(x)
    for k, p in enumerate(found):
        own = x[patches == p]
        np.testing.assert_allclose(mean[k], own.mean(0))
        np.testing.assert_allclose(products[k].reshape(4, 4), (own - own.mean(0)).T @ (own - own.mean(0)), atol=1e-9)


def separable(spark, n=240, classes=3, seed=0, noise=1.0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = np.eye(classes, 5)[y] * 2 + rng.normal(0, noise, (n, 5)) * [1, 3, 0.2, 1, 1] + [0, 9, 0, -4, 100]
    return spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(y, x))], "row_id long, label int, features array<double>"), x, y


def slope(x, y, w, mean, scale, a, b, c):
    """Gradient of the mean objective over standardised features, at coefficients over unscaled ones."""
    z = x @ a.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= w[:, None] / w.sum()
    return np.abs(np.c_[p.T @ ((x - mean) / scale) + a * scale / (c * w.sum()), p.sum(0)]).max()


def test_many_linear_models_at_their_minimum(spark):
    """Weights as repeats, scalers of their own, penalties and parts: the gradient vanishes for each, and Spark's own fit agrees."""
    rows, x, y = separable(spark)
    rng = np.random.default_rng(1)
    w = np.stack([rng.integers(0, 4, len(y)), np.ones(len(y)), (np.arange(len(y)) % 3 > 0)]).astype(float)
    weights = spark.createDataFrame([(i, w[:, i].tolist()) for i in range(len(y))], "row_id long, w array<double>")
    known = rows.join(weights, "row_id")
    parts = known.withColumn("part", F.lit(0)).unionByName(known.withColumn("part", F.lit(1)).withColumn("features", F.slice("features", 1, 2)))
    models = [linear.Model(p, g, s, c) for p in (0, 1) for g, s in ((0, 0), (1, 1), (2, 1)) for c in (1e-3, 1.0, 100.0)]
    found = linear.fit_many(linear.packed(parts), models)
    for m, a, b in zip(models, found.coefficients, found.intercepts):
        own = x[:, :2] if m.part else x
        mean = np.average(own, axis=0, weights=w[m.scaler])
        scale = np.sqrt(np.average((own - mean) ** 2, axis=0, weights=w[m.scaler]))
        assert slope(own, y, w[m.weight], mean, scale, a, b, m.c) < 2e-4
    assert found.passes < 300
    single = probe.predict_linear(probe.fit_linear(probe.standardise(rows, probe.standardiser(rows)), 1.0), probe.standardise(rows, probe.standardiser(rows)))
    many = linear.predict_many(rows.withColumn("part", F.lit(0)), found).filter(F.col("model") == models.index(linear.Model(0, 1, 1, 1.0)))
    assert single.join(many.select("q", F.col("p").alias("p2")), "q").filter("p <> p2").count() == 0


def test_features_that_go_together_take_few_passes(spark, monkeypatch):
    """Nearly equal features, as percentiles of one band are, and a large C; and a part that is done is not read again."""
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 600)
    level = np.eye(3)[y] @ rng.normal(size=(3, 2)) + rng.normal(size=(600, 2))
    x = np.repeat(level, 5, axis=1) + rng.normal(0, 0.02, (600, 10))
    rows = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(y, x))], "row_id long, label int, features array<double>").withColumn("w", F.array(F.lit(1.0)))
    few = rows.filter("row_id < 45").withColumn("part", F.lit(1))
    blocks, read = linear.packed(rows.withColumn("part", F.lit(0)).unionByName(few)), []
    found, one = linear._summed, linear.Model(0, 0, 0, 100.0)
    monkeypatch.setattr(linear, "_summed", lambda blocks, of, *most: read.append({r.part for r in blocks.select("part").distinct().collect()}) or found(blocks, of, *most))
    got = linear.fit_many(blocks, [one, linear.Model(1, 0, 0, 100.0)])
    assert slope(x, y, np.ones(600), x.mean(0), x.std(0), got.coefficients[0], got.intercepts[0], 100.0) < 2e-4
    alone = linear.fit_many(blocks, [one])
    assert alone.passes < 30 and read[2] == {0, 1} and read[got.passes + 1] == {1} and read[-1] == {0}


def test_a_class_without_weight_is_not_predicted(spark):
    rows, x, y = separable(spark, 90)
    known = rows.withColumn("part", F.lit(0)).withColumn("w", F.array((F.col("label") != 2).cast("double")))
    found = linear.fit_many(linear.packed(known), [linear.Model(0, 0, 0, 1.0)])
    assert {r.p for r in linear.predict_many(known, found).collect()} <= {0, 1}
    held = linear.predict_many(known, found, held_out=True)
    assert held.count() == int((y == 2).sum())


def test_search_for_c_equals_single_fits(spark):
    rows, _, _ = separable(spark, 150, noise=2.5)
    scaled = written(probe.standardise(rows, probe.standardiser(rows)), "scaled")
    best, found = probe.choose_c(rows, (1e-3, 1.0))
    parts = probe.folds(scaled)
    for c, mean in found:
        right = [metrics.metrics(probe.predict_linear(probe.fit_linear(parts.filter(F.col("fold") != f), c), parts.filter(F.col("fold") == f))).first()["accuracy"] for f in range(3)]
        assert abs(mean - np.mean(right)) < 0.015
    assert best in (1e-3, 1.0)


def test_linear_bootstraps_of_all_parts(spark):
    rows, _, _ = separable(spark, 120, noise=0.3)
    test, train = rows.filter("row_id % 5 = 0"), rows.filter("row_id % 5 <> 0")
    got = probe.bootstrap_linear(test, train, 30).collect()
    assert sorted(r.rep for r in got) == list(range(30)) and min(r.accuracy for r in got) > 0.8


def test_wide_components(spark):
    """Vectors of 5,000 values: the subspace is that of a full decomposition, and no d x d matrix is made."""
    rng, d, n, k = np.random.default_rng(8), 5000, 300, 4
    x = rng.normal(size=(n, 6)) * [40, 30, 22, 15, 4, 3] @ np.linalg.qr(rng.normal(size=(d, 6)))[0].T + rng.normal(size=(n, d)) * 0.02 + rng.normal(size=d)
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "features array<double>").repartition(5)
    model = fitted.fit_wide(rows, k)
    values, vectors = np.linalg.svd(x - x.mean(0), full_matrices=False)[1:]
    np.testing.assert_allclose(model.variance, values[:k] ** 2 / (n - 1), rtol=1e-6)
    assert np.linalg.norm(model.components @ vectors[:k].T @ vectors[:k] - model.components) < 1e-4
    np.testing.assert_allclose(model.total_variance, (values**2).sum() / (n - 1), rtol=1e-9)
    got = np.array([r.features for r in model.transform(rows.limit(3)).collect()])
    assert got.shape == (3, k)
    few = fitted.fit_wide(spark.createDataFrame([(r.tolist(),) for r in x[:6]], "features array<double>"), 3)
    np.testing.assert_allclose(few.variance, np.linalg.svd(x[:6] - x[:6].mean(0))[1][:3] ** 2 / 5, rtol=1e-6)
    with pytest.raises(ValueError):
        fitted.fit_wide(rows.limit(0), 2)
    with pytest.raises(ValueError):
        fitted.fit_wide(rows.select(F.slice("features", 1, 3).alias("features")), 4)


@pytest.mark.parametrize("few", [100_000, 1])
def test_samples_sort_only_what_they_need(spark, monkeypatch, few):
    monkeypatch.setattr(sampling, "FEW", few)
    rows = spark.range(20_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") % 3).cast("int")).alias("label"))
    hashed = rows.withColumn("h", sampling.seeded_hash(42, "row_id")).toPandas()
    expected = set()
    for label, own in hashed.groupby("label", dropna=False):
        quota = next(r.quota for r in sampling.quotas(rows, 100).collect() if r.label == label or (r.label is None and label != label))
        expected |= set(own.sort_values(["h", "row_id"]).row_id[:quota])
    ranked = sampling._ranked(rows, [100], 42, "label", "row_id")
    assert ranked.count() < 500
    assert {r.row_id for r in sampling.subsample(rows, 100).collect()} == expected
    assert sampling.subsample(rows.limit(40), 100).count() == 40


def test_a_bound_that_is_too_low_is_noticed(spark, monkeypatch):
    """Hashes that are not uniform: all rows are ranked then."""
    rows = spark.range(500).select(F.col("id").alias("row_id"), F.lit(1).alias("label"))
    monkeypatch.setattr(sampling, "seeded_hash", lambda seed, *parts: F.col("row_id") + F.lit((1 << 32) - 600))
    assert sampling._bounds(rows, [10], 42, "label", "row_id") is None
    assert {r.row_id for r in sampling.subsample(rows, 10).collect()} == set(range(10))
