"""The models' feature matrix as stages of a Spark ML pipeline: scaled numbers, text weights and embedding components.

Each estimator learns a bounded state (a number or a term per feature, a matrix for the components) that is kept in params,
so a fitted pipeline is saved and loaded as Spark ML does it. Transforming is one projection; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import fit_components, fit_tfidf, tfidf
from .retrieval import embedded
from .statistics import MODELS, select_by_vif


class _Stage(HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """What all stages share: names of columns as params, and fitted state as params."""

    def with_params(self, **values):
        return self._set(**{k: v for k, v in values.items() if v is not None})

    def of(self, name: str):
        return self.getOrDefault(name)


def _floats(stage: str, name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toListFloat)


def _number(c: str) -> Column:
    """A feature as a number; what is missing counts as 0."""
    value = F.col(c).cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


class Scaled(Estimator, HasInputCols, _Stage):
    """Numbers at mean 0 and population deviation 1, constant ones 0. With `selected`, only the columns that survive the
    selection by variance inflation are kept."""

    selected = Param(Params._dummy(), "selected", "leave out constant and collinear columns", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="scaled", selected=False):
        super().__init__()
        self._setDefault(outputCol="scaled", selected=False)
        self.with_params(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ScaledModel:
        columns = self.getInputCols()
        numbers = df.select(*[_number(c).alias(c) for c in columns])
        if self.of("selected"):
            columns = select_by_vif(numbers, columns)
        state = numbers.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if columns else {}
        means, scales = ([state[f"{n}{i}"] or 0.0 for i in range(len(columns))] for n in "ms")
        # A deviation that is nothing but rounding makes a column constant.
        scales = [s if s > 1e-12 * max(1.0, abs(m)) else 0.0 for m, s in zip(means, scales, strict=True)]
        return ScaledModel(inputCols=columns, outputCol=self.getOutputCol(), means=means, scales=scales)


class ScaledModel(Model, HasInputCols, _Stage):
    means, scales = _floats("scaled", "means", "mean by column"), _floats("scaled", "scales", "population deviation by column")

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, means=None, scales=None):
        super().__init__()
        self._setDefault(outputCol="scaled", inputCols=[], means=[], scales=[])
        self.with_params(**self._input_kwargs)

    def names(self) -> list[str]:
        return list(self.getInputCols())

    def _transform(self, df: DataFrame) -> DataFrame:
        each = [(_number(c) - m) / s if s else F.lit(0.0) for c, m, s in zip(self.getInputCols(), self.of("means"), self.of("scales"), strict=True)]
        return df.withColumn(self.getOutputCol(), F.array(*each).cast("array<double>"))


class TermWeights(Estimator, HasInputCol, _Stage):
    """Weights of a text's commonest words and pairs of words, sublinear and of unit length."""

    most = Param(Params._dummy(), "most", "terms at most", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol="terms", most=30):
        super().__init__()
        self._setDefault(outputCol="terms", most=30)
        self.with_params(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> TermWeightsModel:
        idf = fit_tfidf(df, self.getInputCol(), self.of("most"))
        return TermWeightsModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), terms=list(idf), idf=list(idf.values()))


class TermWeightsModel(Model, HasInputCol, _Stage):
    terms = Param(Params._dummy(), "terms", "terms in order", TypeConverters.toListString)
    idf = _floats("terms", "idf", "weight by term")

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, terms=None, idf=None):
        super().__init__()
        self._setDefault(outputCol="terms", terms=[], idf=[])
        self.with_params(**self._input_kwargs)

    def names(self) -> list[str]:
        return [f"tfidf_{t}" for t in self.of("terms")]

    def _transform(self, df: DataFrame) -> DataFrame:
        return tfidf(df, self.getInputCol(), dict(zip(self.of("terms"), self.of("idf"), strict=True)), self.getOutputCol())


class Embedded(Transformer, HasInputCol, _Stage):
    """The embedding of a text, each distinct text once. The embedder is no part of what is saved: give a loaded stage one with using()."""

    embed = None

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol="embedding"):
        super().__init__()
        self._setDefault(outputCol="embedding")
        self.with_params(**self._input_kwargs)

    def using(self, embed) -> Embedded:
        """embed: a vectorised function from texts to arrays of numbers."""
        self.embed = embed
        return self

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.embed is None:
            raise RuntimeError("set the embedder with using() before transform")
        return embedded(df, self.getInputCol(), self.embed).withColumnRenamed("embedding", self.getOutputCol())


class Components(Estimator, HasInputCol, _Stage):
    """Principal components of an array column, centred. Of each component the loading that is largest in size is positive."""

    most = Param(Params._dummy(), "most", "components at most", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="embedding", outputCol="components", most=100):
        super().__init__()
        self._setDefault(inputCol="embedding", outputCol="components", most=100)
        self.with_params(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> ComponentsModel:
        centre, axes = fit_components(df, self.getInputCol(), self.of("most")).stages
        loadings = axes.pc.toArray()
        loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
        return ComponentsModel(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), centre=centre.mean.toArray().tolist(), loadings=loadings.ravel().tolist())


class ComponentsModel(Model, HasInputCol, _Stage):
    centre, loadings = _floats("components", "centre", "mean by dimension"), _floats("components", "loadings", "loading by dimension and component")

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, centre=None, loadings=None):
        super().__init__()
        self._setDefault(inputCol="embedding", outputCol="components")
        self.with_params(**self._input_kwargs)

    def _axes(self) -> np.ndarray:
        return np.array(self.of("loadings")).reshape(len(self.of("centre")), -1)

    def names(self) -> list[str]:
        return [f"embedding_pc{i}" for i in range(self._axes().shape[1])]

    def _transform(self, df: DataFrame) -> DataFrame:
        centre, axes = np.array(self.of("centre")), self._axes()

        @F.pandas_udf("array<double>")
        def projected(vectors: pd.Series) -> pd.Series:
            some = vectors.dropna()
            done = iter((np.stack(some.to_numpy()) - centre) @ axes if len(some) else [])
            return pd.Series([next(done) if there else None for there in vectors.notna()], dtype=object)

        return df.withColumn(self.getOutputCol(), projected(F.col(self.getInputCol()).cast("array<double>")))


class Joined(Transformer, HasInputCols, _Stage):
    """The arrays side by side as a vector; a row that lacks one of them has none."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol="features"):
        super().__init__()
        self._setDefault(outputCol="features")
        self.with_params(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        joined = F.concat(*self.getInputCols())
        return df.withColumn(self.getOutputCol(), F.when(joined.isNotNull(), array_to_vector(joined)))


def feature_matrix(numeric: list[str], text: str, embed=None, embedding: str | None = None, selected: bool = True, most_terms: int = 30, most_components: int = 100) -> Pipeline:
    """A pipeline whose last stage gives `features`: the numbers scaled, the text's term weights and, if there is an
    embedder or a column that has embeddings, their components."""
    stages = [Scaled(inputCols=numeric, selected=selected), TermWeights(inputCol=text, most=most_terms)]
    parts = ["scaled", "terms"]
    if embed is not None:
        stages.append(Embedded(inputCol=text, outputCol="__embedding").using(embed))
    if embed is not None or embedding:
        stages.append(Components(inputCol=embedding if embed is None else "__embedding", most=most_components))
        parts.append("components")
    return Pipeline(stages=[*stages, Joined(inputCols=parts)])


def matrix_model(numeric: list[str], text: str, target: str, model: str = "forest", embed=None, embedding: str | None = None, selected: bool = True, **params) -> Pipeline:
    """feature_matrix and an estimator of MODELS on top, as one pipeline."""
    return Pipeline(stages=[*feature_matrix(numeric, text, embed, embedding, selected).getStages(), MODELS[model](labelCol=target, featuresCol="features", predictionCol="predicted", **params)])


def feature_names(fitted) -> list[str]:
    """The names of the features of a fitted pipeline, in their order."""
    return [n for s in fitted.stages if hasattr(s, "names") for n in s.names()]


def give_embedder(fitted, embed):
    """A loaded pipeline whose embedding stages use the embedder."""
    for s in fitted.stages:
        if isinstance(s, Embedded):
            s.using(embed)
    return fitted


def importances_by_type(fitted) -> dict[str, dict]:
    """Of a fitted pipeline of feature_matrix and trees: by type of feature (numeric, text, embedding) its share of all importance,
    and under each the features, highest first."""
    weights = dict(zip(feature_names(fitted), map(float, fitted.stages[-1].featureImportances.toArray()), strict=True))
    of = lambda n: "text" if n.startswith("tfidf_") else "embedding" if n.startswith("embedding_pc") else "numeric"
    total = sum(weights.values()) or 1.0
    out: dict[str, dict] = {}
    for name, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        part = out.setdefault(of(name), {"share": 0.0, "features": {}})
        part["share"] += w / total
        part["features"][name] = w
    return out
