"""The space of pipelines as tables: enumeration, forbidden sets, uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("imputer", "scaler", "feature_preprocessor", "classifier")

# fixed values: component names by kind
IMPUTERS = ["SKLSimpleImpute"]
SCALERS = [
    "SKLStandardScaler",
    "SKLMinMaxScaler",
    "SKLRobustScaler",
    "SKLQuantileTransformer",
    "SKLNormalizer",
    "SKLPowerTransformer",
]
FEATURE_PREPROCESSORS = [
    "SKLFastICA",
    "SKLFeatureAgglomeration",
    "SKLKernelPCA",
    "SKLNystroem",
    "SKLPCA",
    "SKLPolynomialFeatures",
    "SKLRandomTreesEmbedding",
    "SKLRBFSampler",
    "SKLSelectFromExtraTrees",
    "SKLSelectFromLinearSVC",
    "SKLSelectPercentile",
    "SKLSelectRates",
]
CLASSIFIERS = [
    "SKLMultiLayerPerceptron",
    "SKLSGD",
    "SKLKNearestNeighbors",
    "SKLDecisionTree",
    "SKLRandomForest",
    "SKLExtraTrees",
    "SKLGradientBoosting",
    "SKLAdaBoost",
    "SKLKernelSVC",
    "SKLLinearSVC",
    "SKLLinearDiscriminantAnalysis",
    "SKLQuadraticDiscriminantAnalysis",
    "SKLPassiveAggressive",
    "SKLMultinomialNB",
    "SKLGaussianNaiveBayes",
    "SKLBernoulliNB",
]

# fixed values: combinations that must not occur together
FORBIDDEN_SETS = [
    ("SKLMultinomialNB", "SKLNystroem"),
    ("SKLMultinomialNB", "SKLKernelPCA"),
    ("SKLMultinomialNB", "SKLFastICA"),
    ("SKLMultinomialNB", "SKLPCA"),
    ("SKLMultinomialNB", "SKLRBFSampler"),
    ("SKLGaussianNaiveBayes", "SKLNystroem"),
    ("SKLGaussianNaiveBayes", "SKLRBFSampler"),
    ("SKLGaussianNaiveBayes", "SKLKernelPCA"),
    ("SKLRandomForest", "SKLNystroem"),
    ("SKLRandomForest", "SKLRBFSampler"),
    ("SKLRandomForest", "SKLKernelPCA"),
    ("SKLKernelSVC", "SKLNystroem"),
    ("SKLKernelSVC", "SKLRBFSampler"),
    ("SKLKernelSVC", "SKLKernelPCA"),
    ("SKLKNearestNeighbors", "SKLNystroem"),
    ("SKLKNearestNeighbors", "SKLRBFSampler"),
    ("SKLKNearestNeighbors", "SKLKernelPCA"),
    ("SKLGradientBoosting", "SKLNystroem"),
    ("SKLGradientBoosting", "SKLRBFSampler"),
    ("SKLGradientBoosting", "SKLKernelPCA"),
    ("SKLExtraTrees", "SKLNystroem"),
    ("SKLExtraTrees", "SKLRBFSampler"),
    ("SKLExtraTrees", "SKLKernelPCA"),
    ("SKLDecisionTree", "SKLNystroem"),
    ("SKLDecisionTree", "SKLRBFSampler"),
    ("SKLDecisionTree", "SKLKernelPCA"),
    ("SKLAdaBoost", "SKLNystroem"),
    ("SKLAdaBoost", "SKLRBFSampler"),
    ("SKLAdaBoost", "SKLKernelPCA"),
    ("SKLMultinomialNB", "SKLSelectRates"),
    ("SKLMultinomialNB", "SKLSelectPercentile"),
    ("SKLQuadraticDiscriminantAnalysis", "SKLRandomTreesEmbedding"),
    ("SKLLinearDiscriminantAnalysis", "SKLRandomTreesEmbedding"),
    ("SKLGradientBoosting", "SKLRandomTreesEmbedding"),
    ("SKLGaussianNaiveBayes", "SKLRandomTreesEmbedding"),
    ("SKLMultinomialNB", "SKLPolynomialFeatures"),
    ("SKLMultinomialNB", "NoFeaturePreprocessor"),
    ("SKLMultinomialNB", "SKLSelectFromLinearSVC"),
    ("SKLMultinomialNB", "SKLFeatureAgglomeration"),
    ("SKLMultinomialNB", "SKLSelectFromExtraTrees"),
]


def components_table(spark: SparkSession) -> DataFrame:
    """All built-in components as (kind, name)."""
    rows = [
        *[("imputer", n) for n in IMPUTERS],
        *[("scaler", n) for n in SCALERS],
        *[("feature_preprocessor", n) for n in FEATURE_PREPROCESSORS],
        *[("classifier", n) for n in CLASSIFIERS],
    ]
    return spark.createDataFrame(rows, "kind string, name string")


def forbidden_table(spark: SparkSession, sets=FORBIDDEN_SETS) -> DataFrame:
    """Forbidden combinations in long form: (set_id, member)."""
    rows = [(i, m) for i, members in enumerate(sets) for m in members]
    return spark.createDataFrame(rows, "set_id int, member string")


def pipeline_id() -> Column:
    return F.md5(F.concat_ws(">", *KINDS))


def parts() -> Column:
    """The component names of a row, without absent stages and repeats."""
    return F.array_distinct(F.array_compact(F.array(*KINDS)))


def enumerate_space(components: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every well-typed pipeline: scaler and feature step may be absent.

    ``components`` is (kind, name), optionally per group ``by``. Names are aggregated to
    small sets with map-side combine and then exploded, so no join is needed.
    """
    by = by or []
    sets = components.groupBy(*by).agg(
        *[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("name")))).alias(f"__{k}") for k in KINDS]
    )
    absent = F.array(F.lit(None).cast("string"))
    optional = {"scaler", "feature_preprocessor"}
    space = sets
    for k in KINDS:
        names = F.concat(absent, F.col(f"__{k}")) if k in optional else F.col(f"__{k}")
        space = space.withColumn(k, F.explode(names))
    return space.select(*by, pipeline_id().alias("pipeline_id"), *KINDS)


def drop_forbidden(pipelines: DataFrame, forbidden: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Relational division: a pipeline goes if some set has all its members among its parts."""
    keys = [*(by or []), "pipeline_id"]
    sizes = forbidden.groupBy("set_id").agg(F.count_distinct("member").alias("wanted"))
    members = forbidden.distinct().join(sizes, "set_id")
    held = pipelines.select(*keys, F.explode(parts()).alias("member")).distinct()
    hits = (
        held.join(F.broadcast(members), "member")
        .groupBy(*keys, "set_id", "wanted")
        .agg(F.count("*").alias("found"))
        .filter(F.col("found") == F.col("wanted"))
    )
    return pipelines.join(hits.select(*keys).distinct(), keys, "left_anti")


def contains_all(parts_column: Column, members: list[str]) -> Column:
    """Whether every member occurs among the parts."""
    wanted = F.array(*[F.lit(m) for m in members])
    return F.size(F.array_except(wanted, parts_column)) == 0


def unique_per_kind(members: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose (kind, implementation) rows name at most one implementation per kind."""
    per_kind = members.groupBy(*keys, "kind").agg(
        (F.min("implementation") == F.max("implementation")).alias("single")
    )
    return per_kind.groupBy(*keys).agg(F.bool_and("single").alias("ok")).filter("ok").select(*keys)


def stages_from_names(names: Column, components: dict[str, list[str]]) -> dict[str, Column]:
    """The first name of each kind in an array of component names; NULL if there is none."""

    def first_of(known: list[str]) -> Column:
        return F.get(F.filter(names, lambda n: n.isin(known)), F.lit(0))

    return {kind: first_of(known) for kind, known in components.items()}


BY_KIND = {
    "imputer": IMPUTERS,
    "scaler": SCALERS,
    "feature_preprocessor": FEATURE_PREPROCESSORS,
    "classifier": CLASSIFIERS,
}


def cap_space(pipelines: DataFrame, limit: int) -> DataFrame:
    """The first pipelines by id."""
    return pipelines.orderBy("pipeline_id").limit(limit)


def save_space(pipelines: DataFrame, path: str) -> None:
    pipelines.write.mode("overwrite").parquet(path)


def load_space(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "pipeline_id string, imputer string, scaler string, feature_preprocessor string, classifier string"
    ).parquet(path)


def sweep_configs(spark: SparkSession, sizes, degrees, noises, seeds) -> DataFrame:
    """Every combination of the experiment parameters, one row each."""
    axes = {"training_size": sizes, "degree": degrees, "noise": noises, "seed": seeds}
    configs = spark.range(1)
    for name, values in axes.items():
        configs = configs.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return configs.select(config_name().alias("config"), *axes)


def config_name(
    size="training_size", degree="degree", noise="noise", seed="seed", problem: str = "shortest_path"
) -> Column:
    return F.concat_ws(
        "-",
        F.lit(problem),
        F.concat(F.lit("ts_"), F.col(size).cast("string")),
        F.concat(F.lit("deg_"), F.col(degree).cast("string")),
        F.concat(F.lit("noise_"), F.col(noise).cast("string")),
        F.concat(F.lit("seed_"), F.col(seed).cast("string")),
    )
