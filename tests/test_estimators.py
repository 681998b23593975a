"""Fitted methods as pyspark.ml stages: alone, in a pipeline, saved and loaded."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from zonalvec.operators import probe
from zonalvec.operators.estimators import Codebook, CodebookModel, PrincipalComponents, PrincipalComponentsModel

RNG = np.random.default_rng(5)
X = RNG.normal(size=(200, 6)) * [9, 5, 3, 1, 1, 1] + 4


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.createDataFrame([(i // 20, i, [float(v) for v in r]) for i, r in enumerate(X)], "patch_id long, i long, vec array<float>")


def _values(rows, key, column):
    return {r[key]: r[column] for r in rows.collect()}


def test_components_saved_loaded_and_nulls(spark, pixels, tmp_path):
    rows = pixels.unionByName(spark.createDataFrame([(99, 999, None)], pixels.schema))
    model = PrincipalComponents(inputCol="vec", outputCol="p", k=2).fit(rows)
    got = _values(model.transform(rows), "i", "p")
    x = X.astype(np.float32).astype(float)
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    expected = (x - x.mean(0)) @ axes.T
    found = np.array([got[i] for i in range(200)])
    assert np.allclose(np.abs(found), np.abs(expected), atol=1e-6)
    assert got[999] is None
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PrincipalComponentsModel.load(str(tmp_path / "m"))
    assert (again.uid, again.getK(), again.getInputCol(), again.getOutputCol()) == (model.uid, 2, "vec", "p")
    assert _values(again.transform(rows), "i", "p") == got
    assert np.array_equal(again.model.variance, model.model.variance)
    estimator = PrincipalComponents(inputCol="vec", k=3)
    estimator.save(str(tmp_path / "e"))
    assert PrincipalComponents.load(str(tmp_path / "e")).getK() == 3
    assert estimator.fit(rows, {estimator.k: 1}).model.components.shape == (1, 6)
    with pytest.raises(ValueError):
        PrincipalComponents(inputCol="vec").fit(rows.filter("false"))


def test_pipeline_of_components_and_codebook(spark, pixels, tmp_path):
    line = Pipeline(stages=[PrincipalComponents(inputCol="vec", outputCol="p", k=2), Codebook(inputCol="p", outputCol="w", k=4, seed=3)])
    model = line.fit(pixels)
    got = _values(model.transform(pixels), "patch_id", "w")
    assert set(got) == set(range(10)) and all(len(v) == 4 and abs(sum(v) - 1) < 1e-9 for v in got.values())
    # Brute force: the nearest centre of each projected pixel.
    p = np.array([r.p for r in model.stages[0].transform(pixels).orderBy("i").collect()])
    near = ((p[:, None] - model.stages[1].model.centres) ** 2).sum(2).argmin(1)
    assert all(np.allclose(got[z], np.bincount(near[z * 20 : z * 20 + 20], minlength=4) / 20) for z in got)
    model.save(str(tmp_path / "line"))
    again = PipelineModel.load(str(tmp_path / "line"))
    assert isinstance(again.stages[1], CodebookModel)
    assert _values(again.transform(pixels), "patch_id", "w") == got
    line.save(str(tmp_path / "unfitted"))
    assert Pipeline.load(str(tmp_path / "unfitted")).getStages()[1].getSeed() == 3


def test_replaced_values_are_counted(spark):
    rows = spark.createDataFrame([("a", [1.0, float("nan")]), ("a", [float("inf"), float("nan")]), ("b", [1.0, 2.0]), ("b", None)], "role string, features array<double>")
    assert {r.role: (r.replaced, r.vectors) for r in probe.replaced(rows, "role").collect()} == {"a": (3, 2), "b": (0, 0)}
    assert probe.replaced(rows.filter("false")).first().replaced == 0
