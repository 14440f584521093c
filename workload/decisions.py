"""Queries for cost prediction and path decisions on a grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipegrid.operators import paths, regress
from pipegrid.sources.synthetic import generate_costs, grid_edges
from pipegrid.operators.split import holdout_fraction
from workload import fixtures as fx
from workload.registry import keep, query, r6, s6

E = 40
KEYS = ["config", "instance_id"]


def instances(spark, sf, native=False):
    """One grid problem per order; its parameters follow from the order key."""
    key = F.col("o_orderkey")

    def pick(values, divisor):
        array = F.array(*[F.lit(v) for v in values])
        return F.element_at(array, (F.pmod(F.floor(key / divisor), F.lit(len(values))) + 1).cast("int"))

    rows = fx.spread(fx.table(spark, sf, "orders").select("o_orderkey")).select(
        key.alias("instance_id"),
        pick([1, 2, 4, 6], 1).alias("degree"),
        pick([0.0, 0.5], 4).alias("noise"),
        pick([1, 2], 8).alias("seed"),
    )
    config = F.concat_ws("-", F.lit("deg"), F.col("degree"), F.col("noise"), F.col("seed"))
    split = holdout_fraction(rows.withColumn("config", config), 0.33, 1, "instance_id")
    return keep(generate_costs(split, native=native))


def _salted(prefix: str, key: str) -> str:
    return f"'{prefix}' || seed || ':' || {key}"


def _uniform(text: str) -> str:
    return f"(cast(cast('0x' || substr(md5({text}), 1, 8) as ubigint) as double) / 4294967296.0::double)"


def _normal(j: int) -> str:
    u1, u2 = _uniform(_salted(f"x{j}:a:", "instance_id")), _uniform(_salted(f"x{j}:b:", "instance_id"))
    return f"sqrt(-2.0::double * ln(1.0::double - {u1})) * cos(2.0::double * pi() * {u2})"


INSTANCES_CTE = f"""
base as (select o_orderkey as instance_id, ([1, 2, 4, 6])[o_orderkey % 4 + 1] as degree,
  ([0.0::double, 0.5::double])[(o_orderkey // 4) % 2 + 1] as noise, ([1, 2])[(o_orderkey // 8) % 2 + 1] as seed from orders),
named as (select *, 'deg-' || degree || '-' || noise || '-' || seed as config from base),
sided as ({fx.split_sql('named', 1, 'instance_id')}),
drawn as (select *, [{', '.join(_normal(j) for j in range(5))}] as features from sided),
edge as (select unnest(range(40)) as e),
pattern as (select seed, e, [{', '.join("cast(" + _uniform(f"'B:' || seed || ':' || e || ':{j}'") + " < 0.5 as double)" for j in range(5))}] as b
  from (select unnest([1, 2]) as seed) cross join edge),
priced as (select d.instance_id, p.e, (pow(list_inner_product(p.b, d.features) / sqrt(5.0::double) + 3.0::double, d.degree) + 1)
    / pow(3.5::double, d.degree) * case when d.noise = 0 then 1.0::double else
    1.0::double - d.noise + 2.0::double * d.noise * {_uniform("'noise' || p.e || ':' || d.seed || ':' || d.instance_id")} end as cost
  from drawn d join pattern p on d.seed = p.seed),
costed as (select instance_id, list(cost order by e) as costs from priced group by instance_id),
inst as (select d.config, d.instance_id, d.degree, d.noise, d.seed, d.split, d.features, c.costs
  from drawn d join costed c on d.instance_id = c.instance_id)"""


def round_array(column):
    return F.transform(column, lambda v: F.round(v, 6) + 0.0)


ROUNDED = "list_transform({c}, lambda v: round(v, 6) + 0.0) as {c}"


@query(
    "a13_synthetic_costs",
    f"with {INSTANCES_CTE} select config, instance_id, split, {ROUNDED.format(c='features')}, {ROUNDED.format(c='costs')} from inst",
)
def a13(spark, sf):
    return instances(spark, sf, native=True).select(
        *KEYS, "split", round_array("features").alias("features"), round_array("costs").alias("costs")
    )


# all monotone paths of the 5 x 5 grid as edge lists; "right first" sorts first
EDGES_SQL = ", ".join(f"({e}, {a}, {b})" for e, (a, b) in enumerate(grid_edges()))
PATHS_CTE = f"""
edges(e, src, dst) as (values {EDGES_SQL}),
walk(cell, path, name) as (select 0, cast([] as integer[]), '' union all
  select dst, list_append(path, e), name || case when dst = src + 1 then 'a' else 'b' end from walk join edges on cell = src),
full_paths as (select path, name from walk where cell = 24)"""


def solved_sql(source: str, costs: str, out: str) -> str:
    """`out(instance_id, sol, obj)`: the least-cost path, ties to the smallest name."""
    return f"""
{out}_all as (select i.instance_id, p.path, p.name, list_sum(list_transform(p.path, lambda e: i.{costs}[e + 1])) as total
  from {source} i cross join full_paths p),
{out}_min as (select instance_id, min(total) as low from {out}_all group by instance_id),
{out}_best as (select a.instance_id, arg_min(path, name) as path, any_value(low) as obj from {out}_all a join {out}_min m
  on a.instance_id = m.instance_id where a.total <= m.low + 1e-9 * (1 + abs(m.low)) group by a.instance_id),
{out} as (select instance_id, list_transform(range(40), lambda e: cast(list_contains(path, e) as integer)) as sol, obj from {out}_best)"""


SOLVED_CTE = f"recursive {INSTANCES_CTE}, {PATHS_CTE}, {solved_sql('inst', 'costs', 'optima')}"


@query(
    "h8_shortest_paths",
    f"with {SOLVED_CTE} select i.config, i.instance_id, o.sol, {s6('o.obj', 'obj')} from inst i join optima o "
    "on i.instance_id = o.instance_id",
)
def h8(spark, sf):
    return paths.with_solution(instances(spark, sf)).select(*KEYS, "sol", r6("obj", "obj"))


@query(
    "h7_optimal_by_split",
    f"with {SOLVED_CTE} select i.split, i.config, count(*) as n_rows, {s6('sum(o.obj)', 'total_objective')}, "
    "cast(sum(list_sum(o.sol)) as bigint) as edges_used "
    "from inst i join optima o on i.instance_id = o.instance_id group by i.split, i.config",
)
def h7(spark, sf):
    solved = paths.with_solution(instances(spark, sf))
    used = F.aggregate("sol", F.lit(0), lambda a, v: a + v)
    return solved.groupBy("split", "config").agg(
        F.count("*").alias("n_rows"), r6(F.sum("obj"), "total_objective"), F.sum(used).alias("edges_used")
    )


# ------------------------------------------------------------------ linear predictions


def linear_predictions(spark, sf):
    data = instances(spark, sf)
    return regress.predict_linear(data, "config", regress.fit_linear(data, "config", 5, E), 5, E)


def solve_sql(size: int) -> str:
    """Gauss elimination of the normal equations for all (config, edge) pairs, by recursion over pivots."""
    return f"""
design as (select i.config, list_append(i.features, 1.0::double) as x, i.costs from inst i where split = 'train'),
pos as (select unnest(range({size})) as r),
xx as (select config, a.r, list(s order by c) as row_values from (
    select config, a.r, b.r as c, sum(x[a.r + 1] * x[b.r + 1]) as s from design cross join pos a cross join pos b
    group by config, a.r, b.r) a group by config, a.r),
xy as (select config, r, list(s order by e) as y from (
    select config, pos.r, edge.e, sum(x[pos.r + 1] * costs[edge.e + 1]) as s from design cross join pos cross join edge
    group by config, pos.r, edge.e) group by config, r),
system as (select xx.config, xx.r, list_concat(xx.row_values, xy.y) as v from xx join xy on xx.config = xy.config and xx.r = xy.r),
elim(step, config, r, v) as (
  select 0, config, r, v from system
  union all
  select s.step + 1, s.config, s.r, case when s.r = s.step then list_transform(s.v, lambda w: w / s.v[s.step + 1])
      else list_transform(range({size} + 40), lambda k: s.v[k + 1] - p.v[k + 1] * s.v[s.step + 1] / p.v[s.step + 1]) end
  from elim s join elim p on s.config = p.config and p.r = s.step where s.step < {size}),
beta as (select config, list(v[{size + 1}:{size + 40}] order by r) as b from elim where step = {size} group by config),
predicted as (select i.config, i.instance_id, i.split, i.costs, list_transform(range(40), lambda e:
    list_sum(list_transform(range({size}), lambda j: list_append(i.features, 1.0::double)[j + 1] * beta.b[j + 1][e + 1]))) as predicted_costs
  from inst i join beta on i.config = beta.config)"""


PREDICTED_CTE = f"recursive {INSTANCES_CTE}, {PATHS_CTE}, {solve_sql(6)}"


@query(
    "h2_linear_regression",
    f"with {PREDICTED_CTE} select config, instance_id, split, {ROUNDED.format(c='predicted_costs')} from predicted",
)
def h2(spark, sf):
    return linear_predictions(spark, sf).select(
        *KEYS, "split", round_array("predicted_costs").alias("predicted_costs")
    )


EVALUATED_CTE = (
    PREDICTED_CTE
    + ", testing as (select * from predicted where split = 'test'), "
    + solved_sql("testing", "costs", "optima")
    + ", "
    + solved_sql("testing", "predicted_costs", "chosen")
)


def evaluated_rows(spark, sf):
    """Test rows with predictions, their decisions and the optimum, joined by instance."""
    predicted = linear_predictions(spark, sf).filter(F.col("split") == "test")
    chosen = paths.with_solution(predicted, "predicted_costs", "predicted_sol", "predicted_obj").select(
        *KEYS, "predicted_costs", "predicted_sol"
    )
    truth = predicted.select(*KEYS, "costs")
    optima = paths.with_solution(truth).select(*KEYS, "sol", "obj")
    return paths.evaluation_rows(chosen, truth, optima, KEYS)


@query(
    "h9_predicted_paths",
    f"with {EVALUATED_CTE} select t.config, t.instance_id, c.sol as predicted_sol, {s6('c.obj', 'predicted_obj')} "
    "from testing t join chosen c on t.instance_id = c.instance_id",
)
def h9(spark, sf):
    data = linear_predictions(spark, sf).filter(F.col("split") == "test")
    solved = paths.with_solution(data, "predicted_costs", "predicted_sol", "predicted_obj")
    return solved.select(*KEYS, "predicted_sol", r6("predicted_obj", "predicted_obj"))


@query(
    "c_j2_evaluation_join",
    f"with {EVALUATED_CTE} select t.config, t.instance_id, c.sol as predicted_sol, o.sol as sol, {s6('o.obj', 'obj')} "
    "from testing t join chosen c on t.instance_id = c.instance_id join optima o on t.instance_id = o.instance_id",
)
def cj2(spark, sf):
    return evaluated_rows(spark, sf).select(*KEYS, "predicted_sol", "sol", r6("obj", "obj"))


SCORES_CTE = f"""{EVALUATED_CTE},
terms as (select t.config, o.obj, list_inner_product(list_transform(c.sol, lambda v: v::double), t.costs) - o.obj as gap, c.sol = o.sol as same,
    list_sum(list_transform(range(40), lambda e: pow(t.predicted_costs[e + 1] - t.costs[e + 1], 2))) as square
  from testing t join chosen c on t.instance_id = c.instance_id join optima o on t.instance_id = o.instance_id),
scores as (select config, sum(case when gap < 0 and same then 0 else gap end) / sum(obj) as regret,
    sum(square) / (count(*) * 40) as mse from terms group by config)"""


@query("h10_regret", f"with {SCORES_CTE} select config, {s6('regret', 'regret')} from scores")
def h10(spark, sf):
    return paths.evaluate(evaluated_rows(spark, sf), ["config"]).select("config", r6("regret", "regret"))


@query("h11_mean_squared_error", f"with {SCORES_CTE} select config, {s6('mse', 'mse')} from scores")
def h11(spark, sf):
    return paths.evaluate(evaluated_rows(spark, sf), ["config"]).select("config", r6("mse", "mse"))


@query(
    "h12_evaluation",
    f"with {SCORES_CTE} select config, 'LinearRegressionModel' as regressor, {s6('regret', 'regret')}, {s6('mse', 'mse')} from scores",
)
def h12(spark, sf):
    scores = paths.evaluate(evaluated_rows(spark, sf), ["config"])
    return scores.select(
        "config", F.lit("LinearRegressionModel").alias("regressor"), r6("regret", "regret"), r6("mse", "mse")
    )


# ------------------------------------------------------------------ other cost predictors


def customer_instances(spark, sf):
    """One grid problem per customer, all with the same parameters."""
    rows = fx.spread(fx.table(spark, sf, "customer").select("c_custkey")).select(
        F.col("c_custkey").alias("instance_id"),
        F.lit(4).alias("degree"),
        F.lit(0.5).alias("noise"),
        F.lit(1).alias("seed"),
        F.lit("deg-4-0.5-1").alias("config"),
    )
    return keep(generate_costs(holdout_fraction(rows, 0.33, 1, "instance_id")))


def decided(predicted):
    """Predicted costs, the decision they lead to, and what it really costs, per test row."""
    test = predicted.filter(F.col("split") == "test")
    solved = paths.with_solution(test, "predicted_costs", "predicted_sol", "predicted_obj")
    best = paths.with_solution(solved)
    return best.select(
        *KEYS,
        round_array("predicted_costs").alias("predicted_costs"),
        "predicted_sol",
        r6(paths.dot(F.col("predicted_sol"), F.col("costs")), "real_cost"),
        r6("obj", "best_cost"),
    )


@query("h3_forest_regression")
def h3(spark, sf):
    from pipegrid.operators.forests import predict_by_forests

    return decided(predict_by_forests(customer_instances(spark, sf), E))


@query("h4_boosted_trees")
def h4(spark, sf):
    from pipegrid.operators.boosting import fit_boosted_trees

    data = customer_instances(spark, sf)
    return decided(fit_boosted_trees(data, 5, E).predict(data, 5))


@query("h5_boosted_linear_leaves")
def h5(spark, sf):
    from pipegrid.operators.boosting import fit_boosted_trees

    data = customer_instances(spark, sf)
    model = fit_boosted_trees(data, 5, E, rate=0.1, depth=5, min_leaf=20, ridge=0.0, linear_leaves=True)
    return decided(model.predict(data, 5))


@query("h6_spo_plus")
def h6(spark, sf):
    from pipegrid.operators.spo import fit_spo_plus

    data = customer_instances(spark, sf)
    return decided(fit_spo_plus(data).predict(data))
