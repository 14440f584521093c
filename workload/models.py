"""Queries for the classifiers and their scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pipegrid.operators import bayes, metrics, neighbours, scale, select
from workload import fixtures as fx
from workload.fixtures import DOC_COLUMNS, EMB_COLUMNS, ORDER_COLUMNS
from workload.prep import KEYS, SCALED_ORDERS_CTE, chi2_sql, scaled_orders, stats_sql
from workload.registry import query


def scores_only(model, features):
    """Accuracy and balanced accuracy by split, for models that SQL cannot express."""
    return metrics.scores(model.predict(features), ["split"])


# ------------------------------------------------------------------ Bayes


def gaussian_sql(cols, cte, source) -> str:
    """`scored(row_id, label, split, c, score)` for Gaussian naive Bayes."""
    stats = ", ".join(f"avg({c}) as m_{c}, var_pop({c}) as v_{c}" for c in cols)
    floor = "greatest(" + ", ".join(f"var_pop({c})" for c in cols) + ")"
    terms = " + ".join(
        f"(-0.5 * ln(2 * pi() * (v_{c} + eps)) - ({c} - m_{c}) * ({c} - m_{c}) / (2 * (v_{c} + eps)))" for c in cols
    )
    return f"""{cte},
eps as (select 1e-9::double * {floor} as eps from {source} where split = 'train'),
cls as (select label as c, count(*) as n, {stats} from {source} where split = 'train' group by label),
scored as (select d.row_id, d.label, d.split, k.c,
  ln(k.n::double / (select sum(n) from cls)) + {terms} as score
  from {source} d cross join cls k cross join eps)"""


PREDICT = "select row_id, label, split, arg_max(c, score) as y_pred from scored group by row_id, label, split"


@query("g1_gaussian_nb", f"with {gaussian_sql(DOC_COLUMNS, fx.DOCS_CTE, 'data')} {PREDICT}")
def g1(spark, sf):
    x = fx.split_documents(spark, sf)
    return bayes.fit_gaussian_nb(x.train()).predict(x)


def multinomial_sql(cols, cte, source) -> str:
    clamp = ", ".join(f"case when {c} < 0 then 0 else {c} end as {c}" for c in cols)
    sums = ", ".join(f"sum({c}) as s_{c}" for c in cols)
    total = " + ".join(f"s_{c} + 1" for c in cols)
    terms = " + ".join(f"{c} * (ln(s_{c} + 1) - ln({total}))" for c in cols)
    return f"""{cte},
clamped as (select row_id, label, split, {clamp} from {source}),
cls as (select label as c, count(*) as n, {sums} from clamped where split = 'train' group by label),
scored as (select d.row_id, d.label, d.split, k.c, ln(k.n::double / (select sum(n) from cls)) + {terms} as score
  from clamped d cross join cls k)"""


@query("g2_multinomial_nb", f"with {multinomial_sql(EMB_COLUMNS, fx.EMB_CTE, 'data')} {PREDICT}")
def g2(spark, sf):
    x = fx.split_embeddings(spark, sf)
    return bayes.fit_multinomial_nb(x.train()).predict(x)


def bernoulli_sql(cols, cte, source) -> str:
    binary = ", ".join(f"cast({c} > 0 as integer) as {c}" for c in cols)
    sums = ", ".join(f"sum({c}) as s_{c}" for c in cols)
    terms = " + ".join(
        f"case when {c} = 1 then ln((s_{c} + 1.0::double) / (n + 2)) else ln(1 - (s_{c} + 1.0::double) / (n + 2)) end"
        for c in cols
    )
    return f"""{cte},
binary_data as (select row_id, label, split, {binary} from {source}),
cls as (select label as c, count(*) as n, {sums} from binary_data where split = 'train' group by label),
scored as (select d.row_id, d.label, d.split, k.c, ln(k.n::double / (select sum(n) from cls)) + {terms} as score
  from binary_data d cross join cls k)"""


@query("g3_bernoulli_nb", f"with {bernoulli_sql(EMB_COLUMNS, fx.EMB_CTE, 'data')} {PREDICT}")
def g3(spark, sf):
    x = fx.split_embeddings(spark, sf)
    return bayes.fit_bernoulli_nb(x.train()).predict(x)


# ------------------------------------------------------------------ neighbours


def nearest_sql(cols, cte, source) -> str:
    away = " + ".join(f"(q.{c} - t.{c}) * (q.{c} - t.{c})" for c in cols)
    return f"""with {cte},
pairs as (select q.row_id, q.label, q.split, t.row_id as near, t.label as near_label, {away} as away
  from {source} q cross join (select * from {source} where split = 'train') t),
least_away as (select row_id, min(away) as away from pairs group by row_id)
select p.row_id, p.label, p.split, arg_min(p.near_label, p.near) as y_pred
from pairs p join least_away b on p.row_id = b.row_id and p.away = b.away group by p.row_id, p.label, p.split"""


@query("g6_nearest_neighbour", nearest_sql(EMB_COLUMNS, fx.EMB_CTE, "data"))
def g6(spark, sf):
    x = fx.split_embeddings(spark, sf)
    return neighbours.fit_nearest_neighbour(x.train()).predict(x)


# ------------------------------------------------------------------ metrics

NB_DOCS_CTE = gaussian_sql(DOC_COLUMNS, fx.DOCS_CTE, "data") + f",\npredictions as ({PREDICT})"


@query(
    "i1_accuracy",
    f"with {NB_DOCS_CTE} select split, round(avg(cast(y_pred = label as double)), 5) as accuracy "
    "from predictions group by split",
)
def i1(spark, sf):
    x = fx.split_documents(spark, sf)
    return metrics.accuracy(bayes.fit_gaussian_nb(x.train()).predict(x), ["split"])


# The flagship: orders with real NULLs -> split -> impute -> min-max -> chi2 top half -> Gaussian NB -> scores.
MIN_MAX_ORDERS_CTE = (
    stats_sql({"a": "min({c})", "b": "max({c})"})
    + ", scaled as (select row_id, label, split, "
    + ", ".join(f"({c} - a_{c}) / case when b_{c} = a_{c} then 1 else b_{c} - a_{c} end as {c}" for c in ORDER_COLUMNS)
    + " from filled cross join st)"
)
_LONG = " union all ".join(f"select row_id, label, split, {j} as j, {c} as v from clamped" for j, c in enumerate(ORDER_COLUMNS))
FLAGSHIP_SQL = f"""with {chi2_sql(ORDER_COLUMNS, MIN_MAX_ORDERS_CTE, 'scaled')},
kept as (select j from (select j, row_number() over (order by chi2 desc, j) as r from scores) where r <= 3),
long as ({_LONG}),
picked as (select l.* from long l join kept k on l.j = k.j),
js as (select label as c, j, count(*) as n, avg(v) as m, var_pop(v) as s2 from picked where split = 'train' group by label, j),
eps as (select max(s2) * 1e-9::double as eps from (select var_pop(v) as s2 from picked where split = 'train' group by j)),
pri as (select c, max(n)::double / (select sum(n) from (select c, max(n) as n from js group by c)) as p from js group by c),
scored as (select p.row_id, p.label, p.split, k.c, any_value(ln(pri.p)) + sum(-0.5 * ln(2 * pi() * (k.s2 + eps))
    - (p.v - k.m) * (p.v - k.m) / (2 * (k.s2 + eps))) as score
  from picked p join js k on p.j = k.j join pri on pri.c = k.c cross join eps group by p.row_id, p.label, p.split, k.c),
predictions as ({PREDICT}),
recall as (select split, label, avg(cast(y_pred = label as double)) as r, count(*) as n,
  count(*) filter (y_pred = label) as hits from predictions group by split, label)
select split, round(sum(hits) / sum(n), 5) as accuracy, round(avg(r), 5) as balanced_accuracy from recall group by split"""


@query("i2_balanced_accuracy", FLAGSHIP_SQL)
def i2(spark, sf):
    filled = fx.filled_orders(spark, sf)
    scaled = scale.fit_min_max(filled.train()).apply(filled)
    chosen = select.fit_select_percentile(scaled.train()).apply(scaled)
    return metrics.scores(bayes.fit_gaussian_nb(chosen.train()).predict(chosen), ["split"])


# ------------------------------------------------------------------ discriminants, closed form for two features

TWO = ["letter_share", "mean_word"]


def two_features(spark, sf):
    x = fx.split_documents(spark, sf)
    return x.select_columns([DOC_COLUMNS.index(c) for c in TWO])


def moments_sql(by_class: bool) -> str:
    group = "group by label" if by_class else ""
    return f"""select {'label as c,' if by_class else ''} count(*) as n, avg(u) as mu, avg(v) as mv,
      sum(u * u) - count(*) * avg(u) * avg(u) as suu, sum(u * v) - count(*) * avg(u) * avg(v) as suv,
      sum(v * v) - count(*) * avg(v) * avg(v) as svv from two where split = 'train' {group}"""


TWO_CTE = f"{fx.DOCS_CTE}, two as (select row_id, label, split, {TWO[0]} as u, {TWO[1]} as v from data)"
LDA_SQL = f"""with {TWO_CTE}, k as ({moments_sql(True)}),
tot as (select sum(n) as n, sum(suu) / (sum(n) - count(*)) as a, sum(suv) / (sum(n) - count(*)) as b,
  sum(svv) / (sum(n) - count(*)) as d from k),
co as (select k.c, (d * mu - b * mv) / (a * d - b * b) as wu, (a * mv - b * mu) / (a * d - b * b) as wv,
  -0.5 * (mu * (d * mu - b * mv) + mv * (a * mv - b * mu)) / (a * d - b * b) + ln(k.n / tot.n::double) as w0 from k cross join tot)
select row_id, label, split, arg_max(c, u * wu + v * wv + w0) as y_pred from two cross join co group by row_id, label, split"""


@query("g4_linear_discriminant_two", LDA_SQL)
def g4_two(spark, sf):
    from pipegrid.operators.discriminant import fit_lda

    x = two_features(spark, sf)
    return fit_lda(x.train()).predict(x)


QDA_SQL = f"""with {TWO_CTE}, k as ({moments_sql(True)}),
co as (select c, n, mu, mv, suu / (n - 1) as a, suv / (n - 1) as b, svv / (n - 1) as d, (select sum(n) from k) as total from k)
select row_id, label, split, arg_max(c, -0.5 * ((u - mu) * (u - mu) * d - 2 * (u - mu) * (v - mv) * b + (v - mv) * (v - mv) * a)
    / (a * d - b * b) - 0.5 * ln(a * d - b * b) + ln(n / total::double)) as y_pred
from two cross join co group by row_id, label, split"""


@query("g5_quadratic_discriminant_two", QDA_SQL)
def g5_two(spark, sf):
    from pipegrid.operators.discriminant import fit_qda

    x = two_features(spark, sf)
    return fit_qda(x.train()).predict(x)


# ------------------------------------------------------------------ projections, closed form for two features

PCA_SQL = f"""with {fx.EMB_CTE}, st as (select avg(f_0) as m0, avg(f_1) as m1, var_samp(f_0) as a, covar_samp(f_0, f_1) as b,
  var_samp(f_1) as d from data where split = 'train'),
ev as (select *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) as l1, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) as l2 from st),
vec as (select *, b / sqrt(b * b + (l1 - a) * (l1 - a)) as p, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) as q from ev),
-- first axis (p, q), second (-q, p), each with its largest loading positive
signed as (select *, case when abs(p) >= abs(q) then sign(p) else sign(q) end as s1,
  case when abs(q) >= abs(p) then sign(-q) else sign(p) end as s2 from vec)
select row_id, label, split, round(((f_0 - m0) * p + (f_1 - m1) * q) * s1, 6) + 0.0 as c_0,
  round(((f_0 - m0) * -q + (f_1 - m1) * p) * s2, 6) + 0.0 as c_1 from data cross join signed"""


@query("f1_principal_axes_two", PCA_SQL)
def f1_two(spark, sf):
    from pipegrid.operators.project import fit_pca
    from workload.prep import flat

    x = fx.split_embeddings(spark, sf).select_columns([0, 1])
    return flat(fit_pca(x.train()).apply(x), ["c_0", "c_1"])


WARD_SQL = f"""with {fx.EMB_CTE}, st as (select sum(pow(f_0 - f_1, 2)) as d01, sum(pow(f_0 - f_2, 2)) as d02,
  sum(pow(f_1 - f_2, 2)) as d12 from data where split = 'train')
select row_id, label, split,
  round(case when d01 <= d02 and d01 <= d12 then (f_0 + f_1) / 2 when d02 <= d12 then (f_0 + f_2) / 2 else f_0 end, 6) + 0.0 as g_0,
  round(case when d01 <= d02 and d01 <= d12 then f_2 when d02 <= d12 then f_1 else (f_1 + f_2) / 2 end, 6) + 0.0 as g_1
from data cross join st"""


@query("f3_merge_columns_three", WARD_SQL)
def f3_three(spark, sf):
    from pipegrid.operators.project import fit_agglomeration
    from workload.prep import rounded

    x = fx.split_embeddings(spark, sf).select_columns([0, 1, 2])
    return rounded(fit_agglomeration(x.train(), clusters=2).apply(x))


# ------------------------------------------------------------------ feature steps and models without a SQL form


def scaled_documents(spark, sf):
    """The learnable table: standardised document features with the quality label."""
    x = fx.split_documents(spark, sf)
    return scale.fit_standard(x.train()).apply(x)


def step_rows(name, fit, source=scaled_documents):
    @query(name)
    def run(spark, sf):
        from workload.prep import rounded

        x = source(spark, sf)
        return rounded(fit(x.train(), fx.SEED).apply(x))

    return run


def model_rows(name, fit, source=scaled_documents):
    @query(name)
    def run(spark, sf):
        x = source(spark, sf)
        return fit(x.train(), fx.SEED).predict(x)

    return run


from pipegrid.operators import boosting, discriminant, forests, landmark, linear, mlp, project, trees  # noqa: E402

step_rows("f1_pca", project.fit_pca, fx.split_embeddings)
step_rows("f2_fast_ica", project.fit_ica)
step_rows("f3_feature_agglomeration", project.fit_agglomeration, fx.split_embeddings)
step_rows("f4_kernel_pca", landmark.fit_kernel_pca)
step_rows("f5_nystroem", landmark.fit_nystroem)
step_rows("f8_random_trees_embedding", trees.fit_random_trees_embedding)
step_rows("f9_select_extra_trees", select.fit_select_extra_trees)
step_rows("f10_select_linear_svc", select.fit_select_l1)
model_rows("g4_linear_discriminant", discriminant.fit_lda)
model_rows("g5_quadratic_discriminant", discriminant.fit_qda)
model_rows("g7_decision_tree", forests.fit_decision_tree)
model_rows("g8_random_forest", forests.fit_random_forest)
model_rows("g9_extra_trees", trees.fit_extra_trees)
model_rows("g10_adaboost", boosting.fit_adaboost)
model_rows("g11_gradient_boosting", forests.fit_gradient_boosting)
model_rows("g12_linear_svc", linear.fit_squared_hinge)
model_rows("g13_sgd_logistic", linear.fit_logistic)
model_rows("g14_passive_aggressive", linear.fit_passive_aggressive)
model_rows("g15_kernel_svc", landmark.fit_kernel_svm)
model_rows("g16_mlp", mlp.fit_mlp)


# texts can agree in all features and differ in the label: their leaves stay mixed, all others are pure
@query(
    "g9_tree_leaves",
    f"""with {fx.DOCS_CTE}, learned as (select * from data where split = 'train'),
    alike as (select {', '.join(DOC_COLUMNS)}, count(*) as n, sum(label) as ones from learned group by all)
    select cast(t.tree as int) as tree, cast(sum(n) as bigint) as n_rows, cast(sum(ones) as bigint) as n_ones,
      cast(coalesce(sum(n) filter (ones > 0 and ones < n), 0) as bigint) as n_mixed_rows from alike cross join (select unnest(range(100)) as tree) t group by t.tree""",
)
def g9_leaves(spark, sf):
    x = scaled_documents(spark, sf)
    counts = trees.fit_extra_trees(x.train(), fx.SEED).leaves()
    zeros, ones = F.col("counts")[0], F.col("counts")[1]
    mixed = (zeros > 0) & (ones > 0)
    return counts.groupBy("tree").agg(
        F.sum(zeros + ones).cast("bigint").alias("n_rows"),
        F.sum(ones).cast("bigint").alias("n_ones"),
        F.sum(F.when(mixed, zeros + ones).otherwise(0)).cast("bigint").alias("n_mixed_rows"),
    )


# ------------------------------------------------------------------ three classes, predicted on the training rows


def three_class(spark, sf):
    x = fx.split_embeddings(spark, sf)
    df = x.df.drop("label").join(
        fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") % 3).alias("label")),
        "row_id",
    )
    from pipegrid.frame import from_columns

    return from_columns(df.withColumn("split", F.lit("train")), EMB_COLUMNS)


# rows are distinct, so a deep tree reproduces every training label
@query("g17_tree_in_sample", "select vec_id as row_id, cast(label % 3 as integer) as y_pred from embeddings")
def g17(spark, sf):
    x = three_class(spark, sf)
    return forests.fit_predict_in_sample(scale.fit_min_max(x).apply(x), forests.fit_plain_tree)


@query("g18_forest_in_sample")
def g18(spark, sf):
    x = three_class(spark, sf)
    return forests.fit_predict_in_sample(scale.fit_robust_quartiles(x).apply(x), forests.fit_plain_forest)


@query("g19_fit_predict_grid")
def g19(spark, sf):
    """Two scalers by two classifiers, each predicting its own training rows."""
    x = three_class(spark, sf)
    out = None
    for scaler, fit_scaler in (("min_max", scale.fit_min_max), ("robust", scale.fit_robust_quartiles)):
        scaled = fit_scaler(x).apply(x)
        for name, fit in (("tree", forests.fit_plain_tree), ("forest", forests.fit_plain_forest)):
            done = forests.fit_predict_in_sample(scaled, fit)
            done = done.select(F.lit(scaler).alias("scaler"), F.lit(name).alias("classifier"), "row_id", "y_pred")
            out = done if out is None else out.unionByName(done)
    return out


# ------------------------------------------------------------------ the grid

GRID_NAMES = [
    "SKLSimpleImpute",
    "SKLStandardScaler",
    "SKLMinMaxScaler",
    "SKLSelectPercentile",
    "SKLPCA",
    "SKLGaussianNaiveBayes",
    "SKLBernoulliNB",
    "SKLLinearDiscriminantAnalysis",
    "SKLDecisionTree",
]


def run_document_grid(spark, sf, reuse=True):
    from pipegrid.frame import from_columns
    from pipegrid.operators.split import two_phases
    from pipegrid.plans import components, grid, space

    both = two_phases(fx.document_features(spark, sf), fx.SEED, keys=fx.document_keys(spark, sf))
    data = from_columns(both.filter(F.col("test_split") == "train").drop("test_split"), DOC_COLUMNS)
    pipelines = space.enumerate_space(components.registry_table(spark, names=GRID_NAMES))
    allowed = space.drop_forbidden(pipelines, space.forbidden_table(spark))
    settings = grid.GridSettings("documents", workers=4, reuse=reuse)
    refit = from_columns(both.drop("split").withColumnRenamed("test_split", "split"), DOC_COLUMNS)
    return grid.run_grid(data, allowed, settings), refit, settings


RESULT = [
    "pipeline_id",
    "imputer",
    "scaler",
    "feature_preprocessor",
    "classifier",
    "status",
    "train_accuracy",
    "valid_accuracy",
    "train_balanced_accuracy",
    "valid_balanced_accuracy",
]


@query("d6_run_grid")
def d6(spark, sf):
    return run_document_grid(spark, sf)[0].select(*RESULT)


@query("d7_refit_incumbent")
def d7(spark, sf):
    from pipegrid.plans import grid

    log, refit, settings = run_document_grid(spark, sf)
    return grid.run_incumbent(refit, log, settings).select(*RESULT)
