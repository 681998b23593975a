"""Poolers against direct NumPy formulas."""

import numpy as np
import pytest

from zonalvec.model import patches_to_long
from zonalvec.operators import pool

RNG = np.random.default_rng(42)
GRIDS = {
    1: RNG.normal(size=(8, 8, 3)), 2: RNG.normal(size=(5, 7, 3)), 3: np.full((4, 4, 3), 5.0), 4: np.zeros((2, 2, 3)), 5: RNG.normal(size=(1, 1, 3)), 6: -np.abs(RNG.normal(size=(3, 3, 3))),
}
GRIDS[7] = GRIDS[1].copy()
GRIDS[7][0, 0, 1] = np.nan


@pytest.fixture(scope="module")
def patches(spark):
    rows = [(k, *g.shape, [float(np.float32(x)) for x in g.ravel()]) for k, g in GRIDS.items()]
    return spark.createDataFrame(rows, "patch_id long, h int, w int, d int, pix array<float>").repartition(3)


def flat(k):
    return GRIDS[k].astype(np.float32).astype(float).reshape(-1, 3)


def kernel(h, w):
    s, (y, x) = min(h, w) / 4, np.mgrid[:h, :w]
    k = np.exp(-((x - (w - 1) / 2) ** 2 + (y - (h - 1) / 2) ** 2) / (2 * s * s))
    return (k / k.sum()).ravel()


def signed_root(m, p):
    return np.sign(m) * np.abs(m) ** (1 / p)


EXPECTED = {
    "mean": lambda x, g: x.mean(0), "std": lambda x, g: x.std(0), "max": lambda x, g: x.max(0), "min": lambda x, g: x.min(0), "mean_std": lambda x, g: np.r_[x.mean(0), x.std(0)],
    "stats": lambda x, g: np.r_[x.min(0), x.max(0), x.mean(0), x.std(0)], "mean_max": lambda x, g: np.r_[x.mean(0), x.max(0)], "gem": lambda x, g: signed_root((np.sign(x) * np.abs(x) ** 3).mean(0), 3),
    "signed_non_cancelling_gem": lambda x, g: np.r_[(np.maximum(x, 1e-6) ** 3).mean(0), (np.maximum(-x, 1e-6) ** 3).mean(0)] ** (1 / 3), "percentiles": lambda x, g: np.percentile(x, [10, 25, 50, 75, 90], axis=0).ravel(),
    "center_weighted_mean": lambda x, g: kernel(*g.shape[:2]) @ x, "median_iqr": lambda x, g: np.r_[np.median(x, 0), np.percentile(x, 75, axis=0) - np.percentile(x, 25, axis=0)],
}


@pytest.mark.parametrize("method", sorted(EXPECTED))
def test_pooler(patches, method):
    got = {r.patch_id: r.features for r in pool.features(patches_to_long(patches), method).collect()}
    assert set(got) == set(GRIDS)
    for k, grid in GRIDS.items():
        with np.errstate(invalid="ignore"):
            expected = EXPECTED[method](flat(k), grid)
        if k == 7 and method == "signed_non_cancelling_gem":
            continue
        assert len(got[k]) == pool.output_dim(method, 3)
        np.testing.assert_allclose(got[k], expected, rtol=1e-6, atol=1e-9, err_msg=f"{method} {k}")


@pytest.mark.parametrize("how", [pool.covariance, pool.covariance_by_pairs])
def test_covariance(spark, how):
    pixels = spark.createDataFrame([(k, y, x, [float(v) for v in g[y, x]]) for k, g in GRIDS.items() if k < 7 for y in range(g.shape[0]) for x in range(g.shape[1])], "patch_id long, y int, x int, vec array<double>")
    got = {k: dict(own) for k, own in _by_patch(how(pixels)).items()}
    for k, g in GRIDS.items():
        if k in (5, 7):
            continue
        expected = np.cov(g.reshape(-1, 3), rowvar=False)[np.triu_indices(3)]
        np.testing.assert_allclose([got[k][i] for i in range(6)], expected, atol=1e-9)
    assert all(np.isnan(v) for v in got[5].values())
    assert set(_by_patch(how(pixels, denom_floor=True).filter("patch_id = 5"))[5]) == {(i, 0.0) for i in range(6)}


def _by_patch(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.patch_id, []).append((r.ord, r.value))
    return out


def test_parameters(patches):
    rows = patches_to_long(patches.filter("patch_id = 1"))
    value = lambda p: [r.value for r in pool.pool_long(rows, p).orderBy("ord").collect()]
    np.testing.assert_allclose(value(pool.gem(1.0)), flat(1).mean(0), rtol=1e-9)
    np.testing.assert_allclose(value(pool.percentiles((0, 100))), np.r_[flat(1).min(0), flat(1).max(0)])
    for make in (pool.gem, pool.signed_gem):
        with pytest.raises(ValueError, match="positive"):
            make(0.0)


def test_centre_pixel_counts(spark):
    pix = [0.0] * 25
    pix[12] = 1.0
    rows = patches_to_long(spark.createDataFrame([(1, 5, 5, 1, pix)], "patch_id long, h int, w int, d int, pix array<float>"))
    assert pool.features(rows, "center_weighted_mean").first().features[0] > 1 / 25


def test_many_methods_share_a_shuffle(patches):
    df = pool.pool_many(patches_to_long(patches), [pool.POOLERS[m] for m in ("stats", "mean_std", "gem")])
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    stats = df.filter("method = 'stats' and patch_id = 1").count()
    assert stats == 12


def test_any_partitioning_gives_the_same(patches):
    one = pool.features(patches_to_long(patches.repartition(1)), "stats").filter("patch_id < 7").orderBy("patch_id").collect()
    many = pool.features(patches_to_long(patches.repartition(7)), "stats").filter("patch_id < 7").orderBy("patch_id").collect()
    for a, b in zip(one, many):
        np.testing.assert_allclose(a.features, b.features, rtol=1e-12)


@pytest.mark.parametrize(("method", "dim"), [("mean", 64), ("mean_std", 128), ("stats", 256), ("percentiles", 320), ("flattened_cov", 2080), ("pca_64", 64), ("bovw_128", 128), ("signed_non_cancelling_gem", 128)])
def test_output_dim(method, dim):
    assert pool.output_dim(method) == dim


def test_unknown_method():
    with pytest.raises(ValueError, match="unknown"):
        pool.output_dim("nonexistent")
    assert len(pool.TRAINING_FREE) == 12


def test_custom_pooler_shape_is_checked(spark):
    pixels = spark.createDataFrame([(1, 0, 0, [1.0, 2.0])], "patch_id long, y int, x int, vec array<double>")
    with pytest.raises(Exception, match="shape"):
        pool.custom(pixels, lambda x: x.sum(0), 3).collect()


def test_average_deviation(patches):
    got = {r.patch_id: r.value for r in pool.average_deviation(patches_to_long(patches)).collect()}
    assert got[1] == pytest.approx(flat(1).std(0).mean())
