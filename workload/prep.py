"""Queries for label handling, splits, imputing, scaling, selection and expansion."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pipegrid.frame import ARRAY, from_columns
from pipegrid.functions.hashing import local_normal, local_uniform
from pipegrid.operators import columns, expand, impute, labels, profile, scale, select, split
from workload import fixtures as fx
from workload.fixtures import DOC_COLUMNS, EMB_COLUMNS, ORDER_COLUMNS, SEED
from workload.registry import query, r6, s6

KEYS = ["row_id", "label", "split"]


def rounded(features, keys=KEYS):
    if features.is_wide:
        return features.df.select(*keys, F.transform(ARRAY, lambda v: F.round(v, 6) + 0.0).alias(ARRAY))
    return features.df.select(*keys, *[r6(c, c) for c in features.names])


def flat(features, names, keys=KEYS):
    """An array layout as named rounded columns."""
    return features.df.select(*keys, *[r6(e, n) for e, n in zip(features.elements(), names)])


def select_sql(cte: str, expressions: dict[str, str], source: str, keys="row_id, label, split") -> str:
    return f"with {cte}\nselect {keys}, " + ", ".join(s6(e, n) for n, e in expressions.items()) + f" from {source}"


# ------------------------------------------------------------------ sources


@query("a1_load_split", select_sql(fx.ORDERS_SPLIT_CTE, {c: c for c in ORDER_COLUMNS}, "data"))
def a1(spark, sf):
    return rounded(fx.split_orders(spark, sf))


@query("a2_load_target", select_sql(fx.EMB_CTE, {c: c for c in EMB_COLUMNS}, "raw", "row_id, label as target"))
def a2(spark, sf):
    df = fx.embedding_features(spark, sf)
    return df.select("row_id", F.col("label").alias("target"), *[r6(c, c) for c in EMB_COLUMNS])


TWO_PHASE_CTE = (
    fx.DOCS_CTE.rsplit(",\ndata as", 1)[0]
    + f",\nouter_split as ({fx.split_sql('raw')}),\n"
    + "inside as (select row_id, label, "
    + ", ".join(DOC_COLUMNS)
    + " from outer_split where split = 'train'),\n"
    + f"inner_split as ({fx.split_sql('inside', SEED + 1)})"
)


@query(
    "a3_test_phase",
    f"with {TWO_PHASE_CTE} select o.row_id, o.label, o.split as test_split, i.split as split "
    "from outer_split o left join inner_split i on o.row_id = i.row_id",
)
def a3(spark, sf):
    df = split.two_phases(fx.document_features(spark, sf), SEED, keys=fx.document_keys(spark, sf))
    return df.select("row_id", "label", "test_split", "split")


# ------------------------------------------------------------------ labels and columns


@query(
    "b1_encode_label",
    """with two as (select vec_id as row_id, case when label >= 5 then 'upper' else 'lower' end as raw_label
    from embeddings), ends as (select min(raw_label) as low, count(distinct raw_label) as n from two)
    select row_id, raw_label, cast(raw_label <> low as integer) as label from two cross join ends where n = 2""",
)
def b1(spark, sf):
    raw = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.when(F.col("label") >= 5, "upper").otherwise("lower").alias("raw_label"),
    )
    return labels.encode_label(raw, "raw_label")


@query("b2_drop_unnamed", "select o_orderkey as row_id, o_totalprice as total_price from orders")
def b2(spark, sf):
    raw = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").alias("total_price"),
        F.col("o_custkey").alias("Unnamed: 0"),
    )
    return columns.drop_unnamed(raw)


@query("b3_split_target", select_sql(fx.EMB_CTE, {c: c for c in EMB_COLUMNS}, "raw", "row_id"))
def b3(spark, sf):
    names, target = columns.split_target(fx.embedding_features(spark, sf).drop("row_id"), "label")
    return fx.embedding_features(spark, sf).select("row_id", *[r6(c, c) for c in names])


@query(
    "b4_clamp_negatives",
    select_sql(
        fx.EMB_CTE, {c: f"case when {c} < 0 then 0 else {c} end" for c in EMB_COLUMNS}, "data"
    ),
)
def b4(spark, sf):
    return rounded(columns.clamp_negatives(fx.split_embeddings(spark, sf)))


# ------------------------------------------------------------------ splits


@query("c_s1_holdout_fraction", f"with {fx.ORDERS_SPLIT_CTE} select row_id, label, split from data")
def cs1(spark, sf):
    return split.holdout_fraction(fx.order_features(spark, sf), 0.33, SEED, keys=fx.order_keys(spark, sf)).select(*KEYS)


@query(
    "c_s2_holdout_size",
    f"with {fx.ORDERS_CTE}, data as ({fx.split_sql('raw', 1, size='1000')}) select row_id, label, split from data",
)
def cs2(spark, sf):
    return split.holdout_size(fx.order_features(spark, sf), 1000, 1, keys=fx.order_keys(spark, sf)).select(*KEYS)


@query(
    "c_s3_predefined_fold",
    """with folds as (select doc_id as row_id, cast(doc_id % 10 as integer) as fold,
      case when doc_id % 3 = 0 then 'test' else 'train' end as split from labels)
    select d.doc_id as row_id, d.n_chars, f.split from documents d join folds f on d.doc_id = f.row_id
    where f.fold = 0""",
)
def cs3(spark, sf):
    folds = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_id"),
        (F.col("doc_id") % 10).cast("int").alias("fold"),
        F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split"),
    )
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")
    return split.predefined_split(docs, folds, 0)


@query(
    "c_j1_pair_target",
    f"with {fx.ORDERS_SPLIT_CTE} select d.row_id, {s6('d.total_price', 'total_price')}, "
    "cast(o.o_orderpriority in ('1-URGENT', '2-HIGH') as integer) as y "
    "from data d join orders o on d.row_id = o.o_orderkey",
)
def cj1(spark, sf):
    x = fx.split_orders(spark, sf).df.select("row_id", r6("total_price", "total_price"))
    y = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("y"),
    )
    return x.join(y, "row_id")


# ------------------------------------------------------------------ profile

PROFILE_SQL = (
    f"with {fx.ORDERS_CTE} select 'orders' as ds_name, cast(6 as bigint) as n_cols, count(*) as n_rows, "
    + "cast("
    + " + ".join(f"count(*) filter ({c} is null)" for c in ORDER_COLUMNS)
    + " as bigint) as n_nans, cast("
    + " + ".join(f"cast(count(*) filter ({c} is null) > 0 as integer)" for c in ORDER_COLUMNS)
    + " as bigint) as n_cols_with_nans, count(*) filter ("
    + " or ".join(f"{c} is null" for c in ORDER_COLUMNS)
    + ") as n_rows_with_nans from raw"
)


@query("i7_dataset_profile", PROFILE_SQL)
def i7(spark, sf):
    return profile.dataset_profile(fx.order_features(spark, sf), ORDER_COLUMNS, "orders")


# ------------------------------------------------------------------ imputer and scalers


@query("e1_mean_impute", select_sql(fx.ORDERS_FILLED_CTE, {c: c for c in ORDER_COLUMNS}, "filled"))
def e1(spark, sf):
    return rounded(fx.filled_orders(spark, sf))


def stats_sql(aggregates: dict[str, str], cols=ORDER_COLUMNS, cte=fx.ORDERS_FILLED_CTE, source="filled") -> str:
    """``aggregates``: name -> pattern with {c}; the table `st` has name_column."""
    wanted = ", ".join(f"{p.format(c=c)} as {n}_{c}" for n, p in aggregates.items() for c in cols)
    return f"{cte}, st as (select {wanted} from {source} where split = 'train')"


@query(
    "e2_standard_scale",
    select_sql(
        stats_sql({"m": "avg({c})", "s": "stddev_pop({c})"}),
        {c: f"({c} - m_{c}) / case when s_{c} = 0 then 1 else s_{c} end" for c in ORDER_COLUMNS},
        "filled cross join st",
    ),
)
def e2(spark, sf):
    x = fx.filled_orders(spark, sf)
    return rounded(scale.fit_standard(x.train()).apply(x))


@query(
    "e3_min_max_scale",
    select_sql(
        stats_sql({"a": "min({c})", "b": "max({c})"}),
        {c: f"({c} - a_{c}) / case when b_{c} = a_{c} then 1 else b_{c} - a_{c} end" for c in ORDER_COLUMNS},
        "filled cross join st",
    ),
)
def e3(spark, sf):
    x = fx.filled_orders(spark, sf)
    return rounded(scale.fit_min_max(x.train()).apply(x))


def robust_sql(low: float, high: float) -> str:
    return select_sql(
        stats_sql(
            {
                "a": "quantile_cont({c}, %r)" % low,
                "m": "quantile_cont({c}, 0.5)",
                "b": "quantile_cont({c}, %r)" % high,
            }
        ),
        {c: f"({c} - m_{c}) / case when b_{c} = a_{c} then 1 else b_{c} - a_{c} end" for c in ORDER_COLUMNS},
        "filled cross join st",
    )


@query("e4_robust_scale", robust_sql(0.0025, 0.0075))
def e4(spark, sf):
    x = fx.filled_orders(spark, sf)
    return rounded(scale.fit_robust(x.train()).apply(x))


@query("e5_robust_quartiles", robust_sql(0.25, 0.75))
def e5(spark, sf):
    x = fx.filled_orders(spark, sf)
    return rounded(scale.fit_robust_quartiles(x.train()).apply(x))


LENGTH = "sqrt(" + " + ".join(f"{c} * {c}" for c in ORDER_COLUMNS) + ")"


@query(
    "e6_row_normalize",
    select_sql(
        fx.ORDERS_FILLED_CTE,
        {c: f"{c} / case when {LENGTH} = 0 then 1 else {LENGTH} end" for c in ORDER_COLUMNS},
        "filled",
    ),
)
def e6(spark, sf):
    x = fx.filled_orders(spark, sf)
    return rounded(scale.fit_normalizer(x.train()).apply(x))


def quantile_map_sql(q: int) -> str:
    """Knots per column in long form, then the segment each value falls in."""
    probs = ", ".join(repr(i / (q - 1)) for i in range(q))
    long = " union all ".join(
        f"select row_id, label, split, {j} as j, {c} as v from filled" for j, c in enumerate(ORDER_COLUMNS)
    )
    body = f"""{fx.ORDERS_FILLED_CTE},
long as ({long}),
qs as (select j, quantile_cont(v, [{probs}]) as qv from long where split = 'train' group by j),
qrows as (select j, unnest(qv) as v, unnest([{probs}]) as p from qs),
knots as (select j, v, min(p) as lo, max(p) as hi from qrows group by j, v),
segs as (select j, v, lo, hi, lead(v) over (partition by j order by v) as nv,
  lead(lo) over (partition by j order by v) as nlo, min(v) over (partition by j) as first_v,
  max(v) over (partition by j) as last_v from knots),
ends as (select j, min(v) as first_v, max(v) as last_v from knots group by j),
mapped as (select l.row_id, l.label, l.split, l.j, case
    when l.v <= e.first_v then 0.0 when l.v >= e.last_v then 1.0
    when l.v = s.v then (s.lo + s.hi) / 2.0
    else s.hi + (l.v - s.v) / (s.nv - s.v) * (s.nlo - s.hi) end as u
  from long l join ends e on l.j = e.j
  left join segs s on l.j = s.j and l.v >= s.v and (s.nv is null or l.v < s.nv))"""
    picks = ", ".join(s6(f"max(case when j = {j} then u end)", c) for j, c in enumerate(ORDER_COLUMNS))
    return f"with {body}\nselect row_id, label, split, {picks} from mapped group by row_id, label, split"


@query("e7_quantile_map", quantile_map_sql(1000))
def e7(spark, sf):
    x = fx.filled_orders(spark, sf)
    return flat(scale.fit_quantile_map(x.train(), n_quantiles=1000).apply(x), ORDER_COLUMNS)


LAMBDAS = [i / 4.0 for i in range(-8, 17)]


def yj_sql(x: str, lam: str) -> str:
    return f"""case when {x} >= 0 then case when {lam} = 0 then ln(1.0 + {x}) else (pow({x} + 1.0, {lam}) - 1.0) / {lam} end
      else case when {lam} = 2 then -ln(1.0 - {x}) else -(pow(1.0 - {x}, 2.0 - {lam}) - 1.0) / (2.0 - {lam}) end end"""


def power_sql() -> str:
    cols = DOC_COLUMNS
    long = " union all ".join(f"select row_id, label, split, {j} as j, {c} as v from data" for j, c in enumerate(cols))
    body = f"""{fx.DOCS_CTE},
long as ({long}),
cand as (select unnest([{', '.join(f'{v!r}::double' for v in LAMBDAS)}]) as lam),
ll as (select j, lam, -count(*) / 2.0 * ln(var_pop({yj_sql('v', 'lam')}))
   + (lam - 1.0) * sum(sign(v) * ln(1.0 + abs(v))) as score
  from long cross join cand where split = 'train' group by j, lam),
best as (select j, arg_max(lam, score) as lam from ll group by j),
moved as (select l.row_id, l.label, l.split, l.j, {yj_sql('v', 'lam')} as t from long l join best b on l.j = b.j),
st as (select j, avg(t) as m, stddev_pop(t) as s from moved where split = 'train' group by j)"""
    picks = ", ".join(
        s6(f"max(case when moved.j = {j} then (t - m) / case when s = 0 then 1 else s end end)", c)
        for j, c in enumerate(cols)
    )
    return (
        f"with {body}\nselect row_id, label, split, {picks} from moved join st on moved.j = st.j "
        "group by row_id, label, split"
    )


@query("e8_power_grid", power_sql())
def e8_grid(spark, sf):
    x = fx.split_documents(spark, sf)
    fitted = scale.fit_power(x.train(), low=LAMBDAS[0], high=LAMBDAS[-1], candidates=len(LAMBDAS), passes=1, widen=False)
    return rounded(fitted.apply(x))


@query("e8_power_transform")
def e8(spark, sf):
    x = fx.split_documents(spark, sf)
    return rounded(scale.fit_power(x.train()).apply(x))


# ------------------------------------------------------------------ chi-squared selection


def chi2_sql(cols, cte, source) -> str:
    """`scores(j, chi2)` over the clamped training rows of a two-class table."""
    clamp = ", ".join(f"case when {c} < 0 then 0 else {c} end as {c}" for c in cols)
    long = " union all ".join(
        f"select {j} as j, label, count(*) as n, sum({c}) as o from clamped where split = 'train' group by label"
        for j, c in enumerate(cols)
    )
    return f"""{cte},
clamped as (select row_id, label, split, {clamp} from {source}),
obs as ({long}),
tot as (select j, sum(o) as t, sum(n) as n from obs group by j),
scores as (select o.j, coalesce(sum(case when t.t * o.n = 0 then null
    else pow(o.o - t.t * o.n / t.n, 2) / (t.t * o.n / t.n) end), -1e300) as chi2
  from obs o join tot t on o.j = t.j group by o.j)"""


SELECT_EMB_CTE = chi2_sql(EMB_COLUMNS, fx.EMB_CTE, "data")


def kept_sql(cols, condition: str, cte: str) -> str:
    """Long form of the kept columns: their position in the selection and the value."""
    long = " union all ".join(f"select row_id, label, split, {j} as j, {c} as v from clamped" for j, c in enumerate(cols))
    return f"""with {cte}, kept as ({condition}), long as ({long})
select row_id, label, split, cast(k.pos as integer) as pos, cast(k.j as integer) as source, {s6('l.v', 'v')}
from long l join kept k on l.j = k.j"""


TOP_HALF = f"""select j, row_number() over (order by j) - 1 as pos from
  (select j, row_number() over (order by chi2 desc, j) as r from scores) where r <= {len(EMB_COLUMNS) // 2}"""


def long_kept(selection, features):
    """The kept columns in long form."""
    chosen = selection.apply(features)
    pairs = F.array(
        *[
            F.struct(F.lit(p).alias("pos"), F.lit(int(j)).alias("source"), r6(e).alias("v"))
            for p, (j, e) in enumerate(zip(selection.keep, chosen.elements()))
        ]
    )
    return chosen.df.select(*KEYS, F.inline(pairs))


@query("f11_select_percentile", kept_sql(EMB_COLUMNS, TOP_HALF, SELECT_EMB_CTE))
def f11(spark, sf):
    x = fx.split_embeddings(spark, sf)
    return long_kept(select.fit_select_percentile(x.train()), x)


SELECT_DOC_CTE = chi2_sql(DOC_COLUMNS, fx.DOCS_CTE, "data")
BY_RATE = (
    f"select j, row_number() over (order by j) - 1 as pos from scores where chi2 > {select.CHI2_CUT_10_PERCENT!r}::double"
)


@query("f12_select_rates", kept_sql(DOC_COLUMNS, BY_RATE, SELECT_DOC_CTE))
def f12(spark, sf):
    x = fx.split_documents(spark, sf)
    return long_kept(select.fit_select_rates(x.train()), x)


# ------------------------------------------------------------------ expansion

POLY_NAMES = ["p_0"] + [f"p_{i + 1}" for i in range(len(ORDER_COLUMNS))]
POLY_TERMS = ["1.0"] + ORDER_COLUMNS
for _i in range(len(ORDER_COLUMNS)):
    for _j in range(_i, len(ORDER_COLUMNS)):
        POLY_TERMS.append(f"{ORDER_COLUMNS[_i]} * {ORDER_COLUMNS[_j]}")
POLY_NAMES = [f"p_{i}" for i in range(len(POLY_TERMS))]
SCALED_ORDERS_CTE = (
    stats_sql({"m": "avg({c})", "s": "stddev_pop({c})"})
    + ", scaled as (select row_id, label, split, "
    + ", ".join(f"({c} - m_{c}) / case when s_{c} = 0 then 1 else s_{c} end as {c}" for c in ORDER_COLUMNS)
    + " from filled cross join st)"
)


def scaled_orders(spark, sf):
    x = fx.filled_orders(spark, sf)
    return scale.fit_standard(x.train()).apply(x)


@query("f7_polynomial", select_sql(SCALED_ORDERS_CTE, dict(zip(POLY_NAMES, POLY_TERMS)), "scaled"))
def f7(spark, sf):
    x = scaled_orders(spark, sf)
    return flat(expand.fit_polynomial(x.train()).apply(x), POLY_NAMES)


def fourier_sql() -> str:
    terms = {}
    for k in range(100):
        dot = " + ".join(
            f"{c} * {math.sqrt(2.0) * local_normal(f'rbf_w:{SEED}:', f'{j}:{k}')!r}::double"
            for j, c in enumerate(ORDER_COLUMNS)
        )
        offset = 2.0 * math.pi * local_uniform(f"rbf_b:{SEED}:", k)
        terms[f"z_{k}"] = f"sqrt(2.0::double / 100) * cos({dot} + {offset!r}::double)"
    return select_sql(SCALED_ORDERS_CTE, terms, "scaled")


@query("f6_fourier_features", fourier_sql())
def f6(spark, sf):
    x = scaled_orders(spark, sf)
    return flat(expand.fit_fourier(x.train(), SEED).apply(x), [f"z_{k}" for k in range(100)])
