"""Small column operators used by loaders, fits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, Features, from_array
from pipegrid.functions.blocks import block_map

# fixed values: classifier names and the short names used in reports
CLASSIFIER_SHORT_NAMES = {
    "SKLRandomForest": "RF",
    "SKLExtraTrees": "EXT",
    "SKLDecisionTree": "DT",
    "SKLKNearestNeighbors": "KNN",
    "SKLGradientBoosting": "GB",
    "SKLSGD": "SGD",
    "SKLAdaBoost": "ADA",
    "SKLLinearSVC": "LSVC",
    "SKLKernelSVC": "KSVC",
    "SKLLinearDiscriminantAnalysis": "LDA",
    "SKLQuadraticDiscriminantAnalysis": "QDA",
    "SKLPassiveAggressive": "PA",
    "SKLGaussianNaiveBayes": "GNB",
    "SKLMultinomialNB": "MNB",
    "SKLBernoulliNB": "BNB",
    "SKLMultiLayerPerceptron": "MLP",
}
# fixed values: the same for the baseline's names
BASELINE_SHORT_NAMES = {
    "random_forest": "RF",
    "extra_trees": "EXT",
    "decision_tree": "DT",
    "k_nearest_neighbors": "KNN",
    "gradient_boosting": "GB",
    "sgd": "SGD",
    "adaboost": "ADA",
    "liblinear_svc": "LSVC",
    "libsvm_svc": "KSVC",
    "lda": "LDA",
    "qda": "QDA",
    "passive_aggressive": "PA",
    "gaussian_nb": "GNB",
    "multinomial_nb": "MNB",
    "bernoulli_nb": "BNB",
    "mlp": "MLP",
}
# fixed values: cost predictors in sweep reports
REGRESSOR_SHORT_NAMES = {
    "LinearRegressionModel": "LR",
    "RandomForestModel": "RF",
    "SPOPlus": "SPO+",
    "LightGBMModel": "LGBM",
    "LightGBMModelLinearTree": "LGBM (LT)",
}


def with_short_name(df: DataFrame, column: str, names: dict[str, str], out: str) -> DataFrame:
    """Look a name up in a fixed table of a few dozen rows; unknown names give NULL."""
    table = df.sparkSession.createDataFrame(list(names.items()), f"__name string, {out} string")
    return df.join(F.broadcast(table), F.col(column) == F.col("__name"), "left").drop("__name")


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Remove the index column a CSV writer may have left; no effect when absent."""
    return df.drop("Unnamed: 0")


def split_target(df: DataFrame, target: str) -> tuple[list[str], str]:
    """Names of the feature columns and the target."""
    return [c for c in df.columns if c != target], target


def non_negative(value: Column) -> Column:
    """Negatives become 0; NULL stays NULL."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def clamp_negatives(features: Features) -> Features:
    if features.is_wide:
        clamped = block_map(_clamp_block, features.array(), features.dim)
        return from_array(features.df.select(*features.keys(), clamped.alias(ARRAY)), features.dim)
    return features.replace_elements([non_negative(e) for e in features.elements()])


def _clamp_block(block):
    return block.clip(min=0.0)


def round_numbers(df: DataFrame, digits: int, columns: list[str] | None = None) -> DataFrame:
    """Round the floating columns (or the named ones); other types pass through."""
    wanted = {c for c, t in df.dtypes if t in ("double", "float")}
    if columns is not None:
        wanted &= set(columns)
    return df.withColumns({c: F.round(c, digits) for c in df.columns if c in wanted}) if wanted else df


def winner(ours: Column, baseline: Column, names: tuple[str, str], tolerance: float = 0.0) -> Column:
    """The side with the larger value, or draw when they differ by at most ``tolerance``."""
    if tolerance > 0:
        clear = F.abs(ours - baseline) > tolerance
        return F.when(clear & (ours > baseline), names[0]).when(clear, names[1]).otherwise("draw")
    return F.when(ours > baseline, names[0]).when(ours < baseline, names[1]).otherwise("draw")


def flag(condition: Column) -> Column:
    return F.when(condition, "X").otherwise("-")


def mark_winner(df: DataFrame, won: str, cells: dict[str, str], pattern: str = "*%s*") -> DataFrame:
    """Turn value columns to text and mark the winning one; ``cells`` is winner name -> column."""
    return df.withColumns(
        {
            c: F.when(F.col(won) == name, F.format_string(pattern, F.col(c).cast("string"))).otherwise(
                F.col(c).cast("string")
            )
            for name, c in cells.items()
        }
    )


def time_budget(seconds: Column, factor: float) -> Column:
    """Whole seconds, truncated toward zero."""
    return (seconds * F.lit(float(factor))).cast("int")


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
