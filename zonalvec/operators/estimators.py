"""Principal components and codebooks as pyspark.ml estimators: with Params, in a ``Pipeline``, saved and loaded.

A saved model is its params as ML writes them, and a table of its vectors (k x d values) in the folder ``data`` beside them.
"""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasMaxIter, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fitted


class _HasK(Params):
    k = Param(Params._dummy(), "k", "components or centres", TypeConverters.toInt)

    def getK(self) -> int:
        return self.getOrDefault(self.k)


class _Writer(MLWriter):
    def __init__(self, instance: "_Saved"):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        self.instance._table(spark).coalesce(1).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        rows = spark.read.parquet(f"{path}/data").orderBy("at").collect()  # one row a component or centre
        out = self.kind._of([(r["vector"], r["scalar"]) for r in rows])
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class _Saved(Model, MLReadable, MLWritable):
    """A model that is rows of (vector, scalar)."""

    def _parts(self) -> list[tuple[list[float], float]]:
        raise NotImplementedError

    def _table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *row) for i, row in enumerate(self._parts())], "at int, vector array<double>, scalar double")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


def _with_vector(rows: DataFrame, given: str) -> DataFrame:
    return rows.filter(F.col(given).isNotNull()).select("*", F.col(given).cast("array<double>").alias("_vector"))


class _ComponentParams(HasInputCol, HasOutputCol, _HasK):
    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(inputCol="features", outputCol="components", k=64)


class PrincipalComponents(Estimator, _ComponentParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``k`` components of the arrays in ``inputCol``; rows without an array are left out."""

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "components", k: int = 64):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, rows: DataFrame) -> "PrincipalComponentsModel":
        given = _with_vector(rows, self.getInputCol()).select(F.col("_vector").alias("features"))
        shift = fitted.means(given)
        if not shift:
            raise ValueError("no vectors")
        return self._copyValues(PrincipalComponentsModel(fitted.pca_from_moments(fitted.moments(given, shift), self.getK(), shift)))


class PrincipalComponentsModel(_Saved, _ComponentParams):
    """Adds ``outputCol``: the array in ``inputCol`` centred and projected; null where there is none."""

    def __init__(self, model: fitted.PCAModel):
        super().__init__()
        self.model = model

    def _transform(self, rows: DataFrame) -> DataFrame:
        given, out = F.col(self.getInputCol()), self.getOutputCol()
        none = F.array_repeat(F.lit(0.0), len(self.model.mean))
        filled = rows.withColumn("_given", given.isNotNull()).withColumn(out, F.coalesce(given.cast("array<double>"), none))
        return self.model.transform(filled, out).withColumn(out, F.when(F.col("_given"), F.col(out))).drop("_given")

    def _parts(self):
        m = self.model
        return [(m.mean.tolist(), float(m.total_variance)), *[(c.tolist(), float(v)) for c, v in zip(m.components, m.variance)]]

    @classmethod
    def _of(cls, parts):
        (mean, total), *rest = parts
        return cls(fitted.PCAModel(np.array(mean), np.array([c for c, _ in rest]), np.array([v for _, v in rest]), total))


class _CodebookParams(HasInputCol, HasOutputCol, HasMaxIter, HasSeed, _HasK):
    group = Param(Params._dummy(), "group", "column that names the patch of a pixel", TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(inputCol="vec", outputCol="words", k=128, maxIter=20, seed=42, group="patch_id")


class Codebook(Estimator, _CodebookParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``k`` centres of the arrays in ``inputCol`` of pixel rows."""

    @keyword_only
    def __init__(self, *, inputCol: str = "vec", outputCol: str = "words", k: int = 128, maxIter: int = 20, seed: int = 42, group: str = "patch_id"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, rows: DataFrame) -> "CodebookModel":
        found = fitted.BoVW(self.getK(), self.getSeed(), self.getMaxIter()).fit(_with_vector(rows, self.getInputCol()), "_vector")
        return self._copyValues(CodebookModel(found))


class CodebookModel(_Saved, _CodebookParams):
    """(group, outputCol): for each patch the share of its pixels nearest to each centre; pixels without an array do not count."""

    def __init__(self, model: fitted.BoVWModel):
        super().__init__()
        self.model = model

    def _transform(self, rows: DataFrame) -> DataFrame:
        group = self.getOrDefault(self.group)
        pixels = _with_vector(rows, self.getInputCol()).select(F.col(group).alias("patch_id"), "_vector")
        shares = fitted.encode(fitted.assign(pixels, self.model.codebook(rows.sparkSession), "_vector"), len(self.model.centres))
        array = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"])  # k values a patch
        return shares.groupBy(F.col("patch_id").alias(group)).agg(array.alias(self.getOutputCol()))

    def _parts(self):
        return [(c.tolist(), 0.0) for c in self.model.centres]

    @classmethod
    def _of(cls, parts):
        return cls(fitted.BoVWModel(np.array([c for c, _ in parts])))
