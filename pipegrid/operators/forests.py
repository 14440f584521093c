"""Tree learners that the ML library trains on executors; only their settings live here."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, Features
from pipegrid.operators.binned_trees import TREE_ROWS, BinnedForest, fit_binned_forest
from pipegrid.session import held

MAX_BINS = 255
NODE_MEMORY_MB = 1024  # fewer passes per level
ROWS_PER_PARTITION = 50_000
DEEP = 30  # for "unlimited": the most that the library allows


@dataclass(frozen=True)
class VectorModel:
    """A fitted ML model as a classifier on :class:`Features`."""

    model: object

    def predict(self, features: Features) -> DataFrame:
        done = self.model.transform(features.with_vector())
        return done.select(*features.keys(), F.col("prediction").cast("int").alias("y_pred"))


def right_sized(rows: DataFrame) -> DataFrame:
    """Fewer partitions of cached rows for small data: each one costs a merge of all node statistics."""
    needed = -(-rows.count() // ROWS_PER_PARTITION)
    return rows.coalesce(max(1, needed)) if needed < rows.rdd.getNumPartitions() else rows


def _fit(learner, train: Features) -> VectorModel:
    with held(train.with_vector()) as rows:
        return VectorModel(learner.fit(right_sized(rows)))


def tree_depth(dim: int) -> int:
    """Half the number of columns, rounded half to even, between 1 and 30."""
    return min(30, max(1, round(0.5 * dim)))


def forest_columns(dim: int) -> str:
    """int(sqrt(d)) columns per split."""
    return str(max(1, int(dim**0.5)))


def fit_decision_tree(train: Features, seed: int = 0, depth: int | None = None) -> VectorModel:
    learner = DecisionTreeClassifier(
        featuresCol=ARRAY,
        labelCol="label",
        impurity="gini",
        maxDepth=depth or tree_depth(train.dim),
        maxBins=MAX_BINS,
        minInstancesPerNode=1,
        seed=seed,
    )
    return _fit(learner, train)


def fit_random_forest(
    train: Features, seed: int = 0, n_trees: int = 100, depth: int = DEEP, bins: int = MAX_BINS
) -> VectorModel:
    learner = RandomForestClassifier(
        featuresCol=ARRAY,
        labelCol="label",
        impurity="gini",
        numTrees=n_trees,
        maxDepth=depth,
        maxBins=bins,
        maxMemoryInMB=NODE_MEMORY_MB,
        featureSubsetStrategy=forest_columns(train.dim),
        bootstrap=True,
        seed=seed,
    )
    return _fit(learner, train)


def fit_gradient_boosting(train: Features, seed: int = 0, rounds: int = 100) -> VectorModel:
    """Log-loss boosting; trees are depth-wise with at most 32 leaves."""
    learner = GBTClassifier(
        featuresCol=ARRAY,
        labelCol="label",
        maxIter=rounds,
        stepSize=0.1,
        maxDepth=5,
        maxBins=MAX_BINS,
        minInstancesPerNode=20,
        seed=seed,
    )
    return _fit(learner, train)


def fit_plain_tree(train: Features, seed: int = 0) -> BinnedForest:
    """The multiclass tree with library defaults, grown until leaves are pure."""
    return fit_binned_forest(train, seed, 1, train.dim, TREE_ROWS)


def fit_plain_forest(train: Features, seed: int = 0, n_trees: int = 100) -> BinnedForest:
    """The multiclass forest with library defaults, grown until leaves are pure: the ML library's passes sum 255 bins for every deep node."""
    return fit_binned_forest(train, seed, n_trees)


def fit_predict_in_sample(train: Features, fit, seed: int = 0) -> DataFrame:
    """Fit, then predict the rows the model was fitted on."""
    return fit(train, seed).predict(train).select("row_id", "y_pred")


def predict_by_forests(
    instances: DataFrame,
    n_outputs: int,
    seed: int = 0,
    n_trees: int = 100,
    depth: int = 10,
    parallel: int = 8,
) -> DataFrame:
    """One regression forest per output on the training rows; predictions for the test rows.

    The vector column is cached once; the fits share it and run a few at a time.
    """
    vector = array_to_vector("features").alias("vector")
    train = instances.filter(F.col("split") == "train").select(
        vector, *[F.col("costs")[e].alias(f"y{e}") for e in range(n_outputs)]
    )

    def fit_one(e: int):
        learner = RandomForestRegressor(
            featuresCol="vector",
            labelCol=f"y{e}",
            predictionCol=f"p{e}",
            numTrees=n_trees,
            maxDepth=depth,
            maxMemoryInMB=NODE_MEMORY_MB,
            featureSubsetStrategy="all",
            seed=seed,
        )
        return learner.fit(rows)

    with held(train) as cached:
        rows = right_sized(cached)
        with ThreadPoolExecutor(parallel) as pool:
            models = list(pool.map(inheritable_thread_target(rows.sparkSession)(fit_one), range(n_outputs)))
    made = instances.filter(F.col("split") == "test").withColumn("vector", array_to_vector("features"))
    for model in models:
        made = model.transform(made)
    names = [f"p{e}" for e in range(n_outputs)]
    return made.withColumn("predicted_costs", F.array(*names)).drop("vector", *names)
