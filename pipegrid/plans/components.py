"""The registry of components. Registering one is all it takes to appear in the space."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, Features, from_array
from pipegrid.operators import (
    bayes,
    boosting,
    discriminant,
    expand,
    forests,
    impute,
    landmark,
    linear,
    mlp,
    neighbours,
    project,
    scale,
    select,
    trees,
)
from pipegrid.plans.space import KINDS


@dataclass(frozen=True)
class Component:
    """``fit(train, seed)`` gives an object with ``apply(features)``, or ``predict`` for classifiers."""

    kind: str
    name: str
    fit: Callable


def component(registry: dict, kind: str, name: str):
    """Decorator: add a fit function to a registry."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")

    def register(fit):
        registry[name] = Component(kind, name, fit)
        return fit

    return register


@dataclass(frozen=True)
class EstimatorModel:
    """A fitted ML estimator as a component."""

    model: object
    output: str
    seen_dim: int

    def apply(self, features: Features) -> Features:
        moved = self.model.transform(features.with_vector())
        made = vector_to_array(F.col(self.output))
        width = len(moved.select(self.output).first()[0])
        return from_array(moved.select(*features.keys(), made.alias("__out")).withColumnRenamed("__out", ARRAY), width)

    def predict(self, features: Features) -> DataFrame:
        moved = self.model.transform(features.with_vector())
        return moved.select(*features.keys(), F.col(self.output).cast("int").alias("y_pred"))


def from_estimator(factory: Callable, output: str) -> Callable:
    """A fit function from a factory of estimators that read ``features`` and ``label``."""

    def fit(train: Features, seed: int = 0) -> EstimatorModel:
        return EstimatorModel(factory().fit(train.with_vector()), output, train.dim)

    return fit


BUILT_IN: dict[str, Component] = {}
for _kind, _name, _fit in [
    ("imputer", "SKLSimpleImpute", impute.fit_mean_imputer),
    ("scaler", "SKLStandardScaler", scale.fit_standard),
    ("scaler", "SKLMinMaxScaler", scale.fit_min_max),
    ("scaler", "SKLRobustScaler", scale.fit_robust),
    ("scaler", "SKLQuantileTransformer", scale.fit_quantile_map),
    ("scaler", "SKLNormalizer", scale.fit_normalizer),
    ("scaler", "SKLPowerTransformer", scale.fit_power),
    ("feature_preprocessor", "SKLFastICA", project.fit_ica),
    ("feature_preprocessor", "SKLFeatureAgglomeration", project.fit_agglomeration),
    ("feature_preprocessor", "SKLKernelPCA", landmark.fit_kernel_pca),
    ("feature_preprocessor", "SKLNystroem", landmark.fit_nystroem),
    ("feature_preprocessor", "SKLPCA", project.fit_pca),
    ("feature_preprocessor", "SKLPolynomialFeatures", expand.fit_polynomial),
    ("feature_preprocessor", "SKLRandomTreesEmbedding", trees.fit_random_trees_embedding),
    ("feature_preprocessor", "SKLRBFSampler", expand.fit_fourier),
    ("feature_preprocessor", "SKLSelectFromExtraTrees", select.fit_select_extra_trees),
    ("feature_preprocessor", "SKLSelectFromLinearSVC", select.fit_select_l1),
    ("feature_preprocessor", "SKLSelectPercentile", select.fit_select_percentile),
    ("feature_preprocessor", "SKLSelectRates", select.fit_select_rates),
    ("classifier", "SKLMultiLayerPerceptron", mlp.fit_mlp),
    ("classifier", "SKLSGD", linear.fit_logistic),
    ("classifier", "SKLKNearestNeighbors", neighbours.fit_nearest_neighbour),
    ("classifier", "SKLDecisionTree", forests.fit_decision_tree),
    ("classifier", "SKLRandomForest", forests.fit_random_forest),
    ("classifier", "SKLExtraTrees", trees.fit_extra_trees),
    ("classifier", "SKLGradientBoosting", forests.fit_gradient_boosting),
    ("classifier", "SKLAdaBoost", boosting.fit_adaboost),
    ("classifier", "SKLKernelSVC", landmark.fit_kernel_svm),
    ("classifier", "SKLLinearSVC", linear.fit_squared_hinge),
    ("classifier", "SKLLinearDiscriminantAnalysis", discriminant.fit_lda),
    ("classifier", "SKLQuadraticDiscriminantAnalysis", discriminant.fit_qda),
    ("classifier", "SKLPassiveAggressive", linear.fit_passive_aggressive),
    ("classifier", "SKLMultinomialNB", bayes.fit_multinomial_nb),
    ("classifier", "SKLGaussianNaiveBayes", bayes.fit_gaussian_nb),
    ("classifier", "SKLBernoulliNB", bayes.fit_bernoulli_nb),
]:
    BUILT_IN[_name] = Component(_kind, _name, _fit)


def registry_table(spark: SparkSession, registry: dict[str, Component] = BUILT_IN, names=None) -> DataFrame:
    """(kind, name) rows for the enumeration, optionally limited to some names."""
    rows = [(c.kind, c.name) for c in registry.values() if names is None or c.name in names]
    return spark.createDataFrame(rows, "kind string, name string")
