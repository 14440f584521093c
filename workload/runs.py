"""Queries over run records: histories, leaderboards, savings, comparisons, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipegrid.operators import columns, profile
from pipegrid.plans import compare, leaderboard, runlog, savings, space, sweep
from pipegrid.sources import records
from workload import fixtures as fx
from workload.fixtures import RUNS_CTE, case_sql
from workload.registry import query, r6, s6

STAGES = ["imputer", "scaler", "feature_preprocessor", "classifier"]
PID = "md5(concat_ws('>', imputer, scaler, feature_preprocessor, classifier))"
RUNS_ID_CTE = RUNS_CTE + f",\nlog as (select *, {PID} as pipeline_id from runs)"


def logged(spark, sf):
    return fx.run_log(spark, sf).withColumn("pipeline_id", space.pipeline_id())


# ------------------------------------------------------------------ record files


def record_files(spark, sf):
    """The run log as the JSON records a run would leave behind."""
    log = logged(spark, sf).withColumn(
        "suffix",
        F.when(F.col("status") == "success", "_run_summary.json")
        .when(F.col("status") == "failed", "_FAILURE_1.json")
        .otherwise("_TIMEOUT_1.json"),
    )
    task = F.concat(F.col("classifier"), F.lit("_"), F.col("run_id").cast("string"))
    ok = F.col("status") == "success"
    content = F.when(
        ok,
        F.to_json(
            F.struct(
                F.array(task).alias("last_task"),
                F.struct(F.col("train_accuracy").alias("train"), F.col("valid_accuracy").alias("test")).alias("accuracy"),
                F.struct(
                    F.col("train_balanced_accuracy").alias("train"), F.col("valid_balanced_accuracy").alias("test")
                ).alias("balanced_accuracy"),
                F.struct(*STAGES).alias("pipeline"),
            )
        ),
    ).otherwise(F.to_json(F.struct(task.alias("task_id"), F.array_compact(F.array(*STAGES)).alias("names"))))
    return log.select("run_id", "dataset", F.concat(task, "suffix").alias("file_name"), content.alias("content"))


OK = "status = 'success'"
HISTORY_COLUMNS = (
    ", ".join(f"case when {OK} then {c} end as {c}" for c in STAGES)
    + ", train_accuracy, valid_accuracy, train_balanced_accuracy, valid_balanced_accuracy, "
    + "classifier || '_' || cast(run_id as varchar) as last_task, status"
)
HISTORY_CTE = f"{RUNS_CTE},\nhistory as (select run_id, dataset, {HISTORY_COLUMNS} from runs)"


@query("a4_run_records", f"with {HISTORY_CTE} select * from history")
def a4(spark, sf):
    return records.parse_run_records(record_files(spark, sf), ["run_id", "dataset"])


@query(
    "b7_file_name_predicates",
    f"""with {RUNS_CTE} select run_id, status = 'success' as is_summary, true as is_json, status <> 'failed' as not_failure
    from runs""",
)
def b7(spark, sf):
    name = F.col("file_name")
    return record_files(spark, sf).select(
        "run_id",
        name.contains("run_summary").alias("is_summary"),
        name.endswith("json").alias("is_json"),
        (~name.contains("FAILURE")).alias("not_failure"),
    )


@query("b8_status_from_name", f"with {RUNS_CTE} select run_id, status from runs")
def b8(spark, sf):
    return record_files(spark, sf).select("run_id", records.status_of(F.col("file_name")).alias("status"))


@query("i3_run_history", f"with {HISTORY_CTE} select * from history")
def i3(spark, sf):
    history = records.parse_run_records(record_files(spark, sf), ["run_id", "dataset"])
    return leaderboard.ranked(history, "accuracy", "last_task")


@query("a5_config_names", None)
def a5(spark, sf):
    return parsed_configs(spark, sf)


def sweep_rows(spark, sf):
    """One evaluation per event with the parameters of an experiment."""
    key = F.col("event_id")

    def pick(values, divisor):
        array = F.array(*[F.lit(v) for v in values])
        return F.element_at(array, (F.pmod(F.floor(key / divisor), F.lit(len(values))) + 1).cast("int"))

    return fx.table(spark, sf, "events").select(
        "event_id",
        pick([100, 1000, 5000], 1).alias("training_size"),
        pick([1, 2, 4, 6], 3).alias("degree"),
        pick([0.0, 0.5], 12).alias("noise"),
        pick(list(columns.REGRESSOR_SHORT_NAMES), 24).alias("regressor"),
        pick(list(range(1, 11)), 120).alias("seed"),
        (F.col("value") / 777.0).alias("regret"),
        (F.col("value") * F.col("value") / 7.0).alias("mse"),
        F.col("value").alias("seconds"),
    )


_REG = ", ".join(f"'{n}'" for n in columns.REGRESSOR_SHORT_NAMES)
SWEEP_CTE = f"""
sweep as (
  select event_id, ([100, 1000, 5000])[event_id % 3 + 1] as training_size,
         ([1, 2, 4, 6])[(event_id // 3) % 4 + 1] as degree, ([0.0::double, 0.5::double])[(event_id // 12) % 2 + 1] as noise,
         ([{_REG}])[(event_id // 24) % 5 + 1] as regressor, cast((event_id // 120) % 10 + 1 as integer) as seed,
         value / 777.0::double as regret, value * value / 7.0::double as mse, value as seconds
  from events)"""


def parsed_configs(spark, sf):
    named = sweep_rows(spark, sf).select("event_id", space.config_name().alias("name"), "regressor", "regret", "mse")
    return records.parse_config_name(named, "name", ["event_id", "regressor", r6("regret", "regret"), r6("mse", "mse")])


from workload.registry import ORACLES  # noqa: E402

ORACLES["a5_config_names"] = f"""with {SWEEP_CTE} select 'shortest_path' as problem_name, training_size, degree, noise, seed,
  event_id, regressor, {s6('regret', 'regret')}, {s6('mse', 'mse')} from sweep"""


@query(
    "a6_component_times",
    f"with {RUNS_CTE} select run_id, dataset, classifier as component, {s6('seconds', 'seconds')} from runs",
)
def a6(spark, sf):
    files = fx.run_log(spark, sf).select(
        "run_id",
        "dataset",
        F.concat("classifier", F.lit("__"), F.col("run_id").cast("string"), F.lit("_run_time.json")).alias("file_name"),
        F.to_json(F.struct(F.col("seconds").alias("total_seconds"))).alias("content"),
    )
    return records.parse_run_times(files, ["run_id", "dataset"]).withColumn("seconds", r6("seconds"))


@query(
    "a7_checkpoints",
    f"""with {RUNS_CTE}, steps as (select run_id, unnest([
      {{'position': 0, 'checkpoint': 'generate', 'seconds': seconds}},
      {{'position': 1, 'checkpoint': 'solve', 'seconds': seconds * 2}},
      {{'position': 2, 'checkpoint': 'total_seconds', 'seconds': seconds * 3}}]) as s from runs)
    select run_id, s.position as position, s.checkpoint as checkpoint, {s6('s.seconds', 'seconds')} from steps""",
)
def a7(spark, sf):
    files = fx.run_log(spark, sf).select(
        "run_id",
        F.to_json(
            F.struct(
                F.col("seconds").alias("generate"),
                (F.col("seconds") * 2).alias("solve"),
                (F.col("seconds") * 3).alias("total_seconds"),
            )
        ).alias("content"),
    )
    return records.explode_checkpoints(files, ["run_id"]).withColumn("seconds", r6("seconds"))


BASELINE_NAMES = list(columns.BASELINE_SHORT_NAMES)


@query(
    "a8_baseline_choice",
    f"""select event_id as run_id, cast(event_id % 3 + 1 as bigint) as id_in_leaderboard,
      cast(event_id % 3 as bigint) as id_in_run_history,
      ([{', '.join(f"'{n}'" for n in BASELINE_NAMES)}])[(event_id + event_id % 3) % 16 + 1] as classifier,
      'step_' || cast(event_id % 3 as varchar) as feature_preprocessor,
      case when event_id % 2 = 0 then 'minmax' else 'standardize' end as scaler from events""",
)
def a8(spark, sf):
    names = F.array(*[F.lit(n) for n in BASELINE_NAMES])
    key = F.col("event_id")

    def config(i: int):
        return F.create_map(
            F.lit(records.CHOICES["classifier"]),
            F.element_at(names, (F.pmod(key + i, F.lit(16)) + 1).cast("int")),
            F.lit(records.CHOICES["feature_preprocessor"]),
            F.lit(f"step_{i}"),
            F.lit(records.CHOICES["scaler"]),
            F.when(key % 2 == 0, "minmax").otherwise("standardize"),
        )

    configs = F.create_map(*[v for i in range(3) for v in (F.lit(str(i)), config(i))])
    files = fx.table(spark, sf, "events").select(
        key.alias("run_id"),
        (key % 3 + 1).alias("rank"),
        F.to_json(F.struct(configs.alias("configs"))).alias("content"),
    )
    return records.baseline_choice(files, "rank", ["run_id"])


# ------------------------------------------------------------------ projections and filters


@query(
    "b5_equality_slice",
    f"with {SWEEP_CTE} select event_id, regressor, seed, degree, {s6('regret', 'regret')} from sweep "
    "where training_size = 1000 and noise = 0.5",
)
def b5(spark, sf):
    rows = sweep_rows(spark, sf).filter((F.col("training_size") == 1000) & (F.col("noise") == 0.5))
    return rows.select("event_id", "regressor", "seed", "degree", r6("regret", "regret"))


USES_SQL = " union all ".join(
    f"select dataset, '{k}' as kind, {k} as component, count(*) as used from runs where {OK} and {k} is not null "
    f"group by dataset, {k}"
    for k in savings.SAVED_KINDS
)


@query("b6_component_uses", f"with {RUNS_CTE} {USES_SQL}")
def b6(spark, sf):
    return savings.component_uses(fx.run_log(spark, sf), ["dataset"])


@query(
    "b9_rename_columns",
    f'with {RUNS_CTE} select dataset as "Name", run_id as "Run", {s6("seconds", "Total Run Sec")[:-13]}"Total Run Sec" from runs',
)
def b9(spark, sf):
    renamed = fx.run_log(spark, sf).withColumnsRenamed(
        {"dataset": "Name", "run_id": "Run", "seconds": "Total Run Sec"}
    )
    return renamed.select("Name", "Run", r6("Total Run Sec", "Total Run Sec"))


@query(
    "b10_round_columns",
    f"with {SWEEP_CTE} select event_id, regressor, training_size, degree, noise, seed, round(regret, 3) as regret, "
    "round(mse, 3) as mse, round(seconds, 3) as seconds from sweep",
)
def b10(spark, sf):
    return columns.round_numbers(sweep_rows(spark, sf), 3)


@query(
    "b11_short_names",
    f"""with {RUNS_CTE} select run_id, {case_sql('classifier', columns.CLASSIFIER_SHORT_NAMES)} as short_name,
    cast({case_sql("coalesce(scaler, 'none')", columns.REGRESSOR_SHORT_NAMES)} as varchar) as unknown_name from runs""",
)
def b11(spark, sf):
    log = fx.run_log(spark, sf).select("run_id", "classifier", "scaler")
    log = columns.with_short_name(log, "classifier", columns.CLASSIFIER_SHORT_NAMES, "short_name")
    log = columns.with_short_name(log, "scaler", columns.REGRESSOR_SHORT_NAMES, "unknown_name")
    return log.select("run_id", "short_name", "unknown_name")


@query(
    "b12_winner",
    f"""with {RUNS_CTE} select run_id, case when train_accuracy > valid_balanced_accuracy then 'ours'
    when train_accuracy < valid_balanced_accuracy then 'baseline' else 'draw' end as winner from runs""",
)
def b12(spark, sf):
    won = columns.winner(F.col("train_accuracy"), F.col("valid_balanced_accuracy"), ("ours", "baseline"))
    return fx.run_log(spark, sf).select("run_id", won.alias("winner"))


@query(
    "b13_tolerant_winner",
    f"""with {RUNS_CTE} select run_id, case when abs(train_accuracy - valid_accuracy) > 0.1::double then
      case when train_accuracy > valid_accuracy then 'ours' else 'baseline' end else 'draw' end as winner from runs""",
)
def b13(spark, sf):
    won = columns.winner(F.col("train_accuracy"), F.col("valid_accuracy"), ("ours", "baseline"), 0.1)
    return fx.run_log(spark, sf).select("run_id", won.alias("winner"))


@query(
    "b14_membership_flag",
    f"with {RUNS_CTE} select run_id, case when dataset in ('ds_1', 'ds_4') then 'X' else '-' end as known from runs",
)
def b14(spark, sf):
    return fx.run_log(spark, sf).select("run_id", columns.flag(F.col("dataset").isin("ds_1", "ds_4")).alias("known"))


@query("b15_distinct_sorted", f"with {SWEEP_CTE} select distinct training_size from sweep")
def b15(spark, sf):
    return columns.distinct_sorted(sweep_rows(spark, sf), "training_size")


@query(
    "b16_mark_winner",
    """select o_orderkey as row_id, case when o_custkey > o_orderkey then '*' || o_custkey || '*'
      else cast(o_custkey as varchar) end as ours, case when o_custkey < o_orderkey then '*' || o_orderkey || '*'
      else cast(o_orderkey as varchar) end as baseline from orders""",
)
def b16(spark, sf):
    pairs = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("ours"), F.col("o_orderkey").alias("baseline")
    )
    pairs = pairs.withColumn("winner", columns.winner(F.col("ours"), F.col("baseline"), ("ours", "baseline")))
    return columns.mark_winner(pairs, "winner", {"ours": "ours", "baseline": "baseline"}).drop("winner")


@query(
    "b17_time_budget",
    f"with {RUNS_CTE} select run_id, cast(trunc(seconds * 2.0::double) as integer) as budget from runs",
)
def b17(spark, sf):
    return fx.run_log(spark, sf).select("run_id", columns.time_budget(F.col("seconds"), 2).alias("budget"))


# ------------------------------------------------------------------ sorts, top rows, joins


@query(
    "c_o1_sort_by_metric",
    f"""with {RUNS_ID_CTE} select run_id, dataset, {s6('valid_accuracy', 'valid_accuracy')} from log""",
)
def co1(spark, sf):
    history = leaderboard.ranked(logged(spark, sf), "accuracy", "run_id")
    return history.select("run_id", "dataset", r6("valid_accuracy", "valid_accuracy"))


@query(
    "c_o2_sort_by_size",
    f"with {RUNS_CTE} select dataset, count(*) as n_instances from runs group by dataset",
)
def co2(spark, sf):
    sizes = fx.run_log(spark, sf).groupBy("dataset").agg(F.count("*").alias("n_instances"))
    return sizes.orderBy(F.desc("n_instances"), "dataset")


@query(
    "c_t1_incumbent",
    f"""with {RUNS_ID_CTE}, r as (select *, row_number() over (partition by dataset
      order by valid_accuracy desc, run_id) as rn from log where {OK})
    select dataset, run_id, pipeline_id, {s6('valid_accuracy', 'valid_accuracy')} from r where rn = 1""",
)
def ct1(spark, sf):
    best = leaderboard.incumbents(logged(spark, sf), ["dataset"], "accuracy", "run_id")
    return best.select("dataset", "run_id", "pipeline_id", r6("valid_accuracy", "valid_accuracy"))


@query(
    "c_t2_cap",
    f"with {RUNS_ID_CTE} select distinct pipeline_id, {', '.join(STAGES)} from log order by pipeline_id limit 10",
)
def ct2(spark, sf):
    return space.cap_space(logged(spark, sf).select("pipeline_id", *STAGES).distinct(), 10)


@query(
    "c_w1_elapsed",
    f"""with {RUNS_CTE}, clock as (select run_id, dataset, started_at,
      (epoch_us(started_at) - 1704067200000000) / 1000000.0::double as t from runs)
    select run_id, dataset, {s6("t - coalesce(lag(t) over (partition by dataset order by started_at, run_id), 0.0)", "elapsed")}
    from clock""",
)
def cw1(spark, sf):
    clock = fx.run_log(spark, sf).select(
        "run_id",
        "dataset",
        "started_at",
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', started_at)") / 1000000.0).alias("t"),
    )
    return sweep.elapsed(clock, "dataset", "started_at", "run_id", "t").select(
        "run_id", "dataset", r6("elapsed", "elapsed")
    )


INFO_CTE = "info as (select dataset, count(*) as n_instances from runs group by dataset)"


@query(
    "c_j3_realign",
    f"""with {RUNS_CTE}, {INFO_CTE}, rep as (select dataset, {s6('sum(seconds)', 'total_sec')} from runs group by dataset)
    select i.n_instances, r.* from info i join rep r on i.dataset = r.dataset""",
)
def cj3(spark, sf):
    log = fx.run_log(spark, sf)
    info = log.groupBy("dataset").agg(F.count("*").alias("n_instances"))
    report = log.groupBy("dataset").agg(r6(F.sum("seconds"), "total_sec"))
    return compare.in_order_of(report, info, "dataset", "n_instances")


@query(
    "c_j6_incumbent_lookup",
    f"""with {RUNS_ID_CTE}, best as (select dataset, arg_min(pipeline_id, run_id) as pipeline_id from
      (select *, max(valid_accuracy) over (partition by dataset) as top from log where {OK})
      where valid_accuracy = top group by dataset)
    select l.run_id, l.dataset, l.pipeline_id from log l join best b
      on l.dataset = b.dataset and l.pipeline_id = b.pipeline_id""",
)
def cj6(spark, sf):
    log = logged(spark, sf)
    best = leaderboard.incumbents(log, ["dataset"], "accuracy", "run_id").select("dataset", "pipeline_id")
    return log.join(best, ["dataset", "pipeline_id"], "left_semi").select("run_id", "dataset", "pipeline_id")


FIRST_SCORES_CTE = f"""{SWEEP_CTE},
unique_scores as (select training_size, noise, regressor, seed, degree, avg(regret) as regret
  from sweep group by training_size, noise, regressor, seed, degree)"""
DEGREES = [1, 2, 4, 6]


@query(
    "c_p1_pivot_regret",
    f"with {FIRST_SCORES_CTE} select training_size, noise, regressor, seed, "
    + ", ".join(s6(f"max(case when degree = {d} then regret end)", f"degree_{d}") for d in DEGREES)
    + " from unique_scores group by training_size, noise, regressor, seed",
)
def cp1(spark, sf):
    keys = ["training_size", "noise", "regressor"]
    unique = sweep_rows(spark, sf).groupBy(*keys, "seed", "degree").agg(F.avg("regret").alias("regret"))
    wide = sweep.pivot_regret(unique, keys, DEGREES)
    return wide.select(*keys, "seed", *[r6(f"degree_{d}", f"degree_{d}") for d in DEGREES])


# ------------------------------------------------------------------ pipeline space

FORBIDDEN_SQL = ", ".join(f"('{a}', '{b}')" for a, b in space.FORBIDDEN_SETS)
SPACE_CTE = f"""{RUNS_ID_CTE},
sc as (select distinct dataset, scaler from runs where scaler is not null union select distinct dataset, null from runs),
fp as (select distinct dataset, feature_preprocessor from runs where feature_preprocessor is not null
  union select distinct dataset, null from runs),
im as (select distinct dataset, imputer from runs), cl as (select distinct dataset, classifier from runs),
space as (select im.dataset, imputer, scaler, feature_preprocessor, classifier, {PID} as pipeline_id
  from im join sc on im.dataset = sc.dataset join fp on im.dataset = fp.dataset join cl on im.dataset = cl.dataset),
seen as (select dataset, pipeline_id, count(*) as n_runs from log group by dataset, pipeline_id)"""
FORBIDDEN_CTE = f"forbidden(a, b) as (values {FORBIDDEN_SQL})"


def observed_space(spark, sf):
    """Every pipeline the components seen per dataset allow, with the runs it got."""
    log = logged(spark, sf)
    named = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("name")) for k in STAGES])
    observed = log.select("dataset", F.inline(named)).filter(F.col("name").isNotNull())
    pipelines = space.enumerate_space(observed, ["dataset"])
    seen = log.groupBy("dataset", "pipeline_id").agg(F.count("*").alias("n_runs"))
    return pipelines.join(seen, ["dataset", "pipeline_id"], "left").na.fill(0, ["n_runs"])


SPACE_SELECT = (
    "select s.dataset, s.pipeline_id, s.imputer, s.scaler, s.feature_preprocessor, s.classifier, "
    "coalesce(n_runs, 0) as n_runs from space s left join seen n on s.dataset = n.dataset and s.pipeline_id = n.pipeline_id"
)


@query("d1_enumerate", f"with {SPACE_CTE} {SPACE_SELECT}")
def d1(spark, sf):
    return observed_space(spark, sf)


@query(
    "d2_drop_forbidden",
    f"with {SPACE_CTE}, {FORBIDDEN_CTE} {SPACE_SELECT} where not exists (select 1 from forbidden f "
    "where f.a = s.classifier and f.b = coalesce(s.feature_preprocessor, ''))",
)
def d2(spark, sf):
    return space.drop_forbidden(observed_space(spark, sf), space.forbidden_table(spark), ["dataset"])


@query(
    "c_e1_forbidden_subset",
    f"""with {RUNS_CTE}, {FORBIDDEN_CTE} select run_id, exists (select 1 from forbidden f
      where f.a = classifier and f.b = coalesce(feature_preprocessor, '')) as forbidden from runs""",
)
def ce1(spark, sf):
    held = F.array_distinct(F.array_compact(F.array(*STAGES)))
    sets = F.array(*[F.array(*[F.lit(m) for m in s]) for s in space.FORBIDDEN_SETS])
    hit = F.exists(sets, lambda s: F.size(F.array_except(s, F.col("parts"))) == 0)
    return fx.run_log(spark, sf).select("run_id", held.alias("parts")).select("run_id", hit.alias("forbidden"))


@query(
    "c_e2_stage_list",
    f"""with {RUNS_CTE} select run_id, list_filter([classifier, feature_preprocessor, scaler, imputer],
      lambda v: v is not null) as parts from runs""",
)
def ce2(spark, sf):
    order = F.array("classifier", "feature_preprocessor", "scaler", "imputer")
    return fx.run_log(spark, sf).select("run_id", F.array_distinct(F.array_compact(order)).alias("parts"))


@query(
    "d3_unique_task",
    f"""with {SWEEP_CTE}, a as (select distinct training_size, degree, regressor from sweep)
    select a.training_size, a.degree, a.regressor || '|' || b.regressor as plan_name from a join a b
      on a.training_size = b.training_size and a.degree = b.degree where a.regressor = b.regressor""",
)
def d3(spark, sf):
    group = ["training_size", "degree"]
    names = sweep_rows(spark, sf).groupBy(*group).agg(F.collect_set("regressor").alias("names"))
    # a plan names an approach twice: for its predictions and for the solved predictions
    plans = names.withColumn("first", F.explode("names")).withColumn("second", F.explode("names"))
    plans = plans.withColumn("plan_name", F.concat_ws("|", "first", "second"))
    members = plans.select(
        *group,
        "plan_name",
        F.lit("solution_approach").alias("kind"),
        F.explode(F.array("first", "second")).alias("implementation"),
    )
    return space.unique_per_kind(members, [*group, "plan_name"])


@query("d5_stage_columns", f"with {RUNS_CTE} select run_id, {', '.join(STAGES)} from runs")
def d5(spark, sf):
    names = F.array_compact(F.array("classifier", "feature_preprocessor", "scaler", "imputer"))
    listed = fx.run_log(spark, sf).select("run_id", names.alias("names"))
    kinds = space.stages_from_names(F.col("names"), space.BY_KIND)
    return listed.select("run_id", *[kinds[k].alias(k) for k in STAGES])


@query(
    "d8_attempt_numbers",
    f"""with {RUNS_ID_CTE} select run_id, dataset, status, row_number() over
      (partition by dataset, pipeline_id, status order by started_at, run_id) as attempt from log
      where status <> 'success'""",
)
def d8(spark, sf):
    broken = logged(spark, sf).filter(F.col("status") != "success")
    return runlog.number_attempts(broken, ["dataset", "pipeline_id", "status"], "started_at", "run_id").select(
        "run_id", "dataset", "status", "attempt"
    )


@query(
    "d9_sweep_configs",
    f"""with {SWEEP_CTE} select 'shortest_path-ts_' || training_size || '-deg_' || degree || '-noise_' || noise
      || '-seed_' || seed as config, count(*) as n_models from sweep group by 1""",
)
def d9(spark, sf):
    axes = ([100, 1000, 5000], [1, 2, 4, 6], [0.0, 0.5], list(range(1, 11)))
    configs = space.sweep_configs(spark, *axes)
    # every configuration that has evaluations, with how many
    counted = sweep_rows(spark, sf).groupBy("training_size", "degree", "noise", "seed").agg(
        F.count("*").alias("n_models")
    )
    return configs.join(counted, ["training_size", "degree", "noise", "seed"]).select("config", "n_models")


# ------------------------------------------------------------------ summaries

BEST = f"""best as (select * from (select *, row_number() over (partition by dataset order by valid_accuracy desc, run_id) as rn
  from runs where {OK}) where rn = 1)"""


@query(
    "i4_train_summary",
    f"""with {RUNS_CTE}, {BEST}, n as (select dataset, count(*) as n_runs, count(*) filter ({OK}) as successful,
      count(*) filter (status = 'failed') as failed, count(*) filter (status = 'timeout') as timeout from runs group by dataset)
    select n.*, b.imputer, b.scaler, b.feature_preprocessor, b.classifier, {s6('b.train_accuracy', 'train_accuracy')},
      {s6('b.valid_accuracy', 'validation_accuracy')} from n left join best b on n.dataset = b.dataset""",
)
def i4(spark, sf):
    summary = leaderboard.train_summary(fx.run_log(spark, sf), ["dataset"], "accuracy", "run_id")
    return columns.round_numbers(summary, 6)


def refits(spark, sf):
    """The refit of each dataset's best run, as test-phase records."""
    best = leaderboard.incumbents(fx.run_log(spark, sf), ["dataset"], "accuracy", "run_id")
    return best.select(
        "dataset",
        F.concat("dataset", F.lit("_incumbent")).alias("folder"),
        F.concat(F.col("run_id").cast("string"), F.lit("_run_summary.json")).alias("file_name"),
        *STAGES,
        r6("train_accuracy", "train_accuracy"),
        r6("valid_accuracy", "test_accuracy"),
    )


@query(
    "i5_test_summary",
    f"""with {RUNS_CTE}, {BEST} select dataset, imputer, scaler, feature_preprocessor, classifier,
      {s6('train_accuracy', 'train_accuracy')}, {s6('valid_accuracy', 'test_accuracy')} from best""",
)
def i5(spark, sf):
    return leaderboard.test_summary(refits(spark, sf), ["dataset"])


@query(
    "i6_all_test_summaries",
    f"""with {RUNS_CTE}, {BEST} select dataset, classifier, feature_preprocessor, scaler, imputer,
      {s6('valid_accuracy', 'test_accuracy')} from best""",
)
def i6(spark, sf):
    return leaderboard.all_test_summaries(refits(spark, sf).drop("dataset"), "folder")


@query(
    "i8_dataset_sizes",
    f"""with {RUNS_CTE} select dataset as name, cast(13 as bigint) as n_features, count(*) as n_instances,
      case when dataset in ('ds_1', 'ds_4') then 'X' else '-' end as in_baseline from runs group by dataset""",
)
def i8(spark, sf):
    log = fx.run_log(spark, sf)
    return profile.dataset_sizes(log, "dataset", len(log.columns), ["ds_1", "ds_4"])


# ------------------------------------------------------------------ savings


def stage_runs(spark, sf):
    """Stages that really ran: the first run of every distinct prefix."""
    return runlog.first_stage_runs(fx.run_log(spark, sf), ["dataset"], "started_at", "run_id")


STAGE_RUNS_CTE = RUNS_CTE + ",\nstage_runs as (" + " union all ".join(
    f"select dataset, '{k}' as kind, {k} as component, first(seconds order by started_at, run_id) as seconds from runs "
    f"where {k} is not null group by dataset, {', '.join(savings.SAVED_KINDS[: i + 1])}"
    for i, k in enumerate(savings.SAVED_KINDS)
) + ")"


def times_sql(aggregate: str) -> str:
    return (
        f"select dataset, component, {s6(aggregate, 'run_time')}, count(*) as runs from stage_runs "
        "group by dataset, component"
    )


def times(spark, sf, func):
    found = savings.component_times(stage_runs(spark, sf), ["dataset"], func)
    return found.select("dataset", "component", r6("run_time", "run_time"), "runs")


@query("i9_component_time_mean", f"with {STAGE_RUNS_CTE} {times_sql('avg(seconds)')}")
def i9_mean(spark, sf):
    return times(spark, sf, "mean")


@query("i9_component_time_median", f"with {STAGE_RUNS_CTE} {times_sql('median(seconds)')}")
def i9_median(spark, sf):
    return times(spark, sf, "median")


@query("i9_component_time_geometric", f"with {STAGE_RUNS_CTE} {times_sql('exp(avg(ln(seconds)))')}")
def i9_geometric(spark, sf):
    return times(spark, sf, "geometric_mean")


@query("l4_user_aggregate", f"with {STAGE_RUNS_CTE} {times_sql('max(seconds) - min(seconds)')}")
def l4(spark, sf):
    return times(spark, sf, lambda seconds: F.max(seconds) - F.min(seconds))


SAVINGS_CTE = f"""{STAGE_RUNS_CTE},
uses as ({USES_SQL}),
tm as (select dataset, component, avg(seconds) as t, count(*) as runs from stage_runs group by dataset, component),
savings as (select u.dataset, u.kind, u.component, coalesce(t, 0) * used - coalesce(t, 0) * coalesce(runs, 0) as saved_time,
  used - coalesce(runs, 0) as avoided_runs from uses u left join tm on u.dataset = tm.dataset and u.component = tm.component),
per_kind as (select dataset, kind, sum(saved_time) as total_saved_time, cast(sum(avoided_runs) as bigint) as total_avoided_runs
  from savings group by dataset, kind),
totals as (select dataset, sum(seconds) as run_time, count(imputer) filter ({OK}) + count(scaler) filter ({OK})
  + count(feature_preprocessor) filter ({OK}) as component_count from runs group by dataset),
wide as (select t.dataset, any_value(run_time) as run_time, any_value(component_count) as component_count,
  coalesce(sum(total_saved_time) filter (kind = 'imputer'), 0) as i_s, coalesce(sum(total_saved_time) filter (kind = 'scaler'), 0) as s_s,
  coalesce(sum(total_saved_time) filter (kind = 'feature_preprocessor'), 0) as f_s,
  cast(coalesce(sum(total_avoided_runs) filter (kind = 'imputer'), 0) as bigint) as i_a,
  cast(coalesce(sum(total_avoided_runs) filter (kind = 'scaler'), 0) as bigint) as s_a,
  cast(coalesce(sum(total_avoided_runs) filter (kind = 'feature_preprocessor'), 0) as bigint) as f_a
  from totals t join per_kind p on t.dataset = p.dataset group by t.dataset),
report as (select dataset, run_time as total_run_sec, i_s as imputer_saved_sec, s_s as scaler_saved_sec,
  f_s as feature_preprocessor_saved_sec, (i_s + s_s + f_s) / (i_s + s_s + f_s + run_time) * 100 as saved_percent,
  component_count as total_components, i_a as imputer_avoided_runs, s_a as scaler_avoided_runs,
  f_a as feature_preprocessor_avoided_runs, (i_a + s_a + f_a) / component_count::double * 100 as avoided_percent from wide)"""
REPORT_COLUMNS = [
    "total_run_sec",
    "imputer_saved_sec",
    "scaler_saved_sec",
    "feature_preprocessor_saved_sec",
    "saved_percent",
]


def component_savings(spark, sf, func="mean"):
    log = fx.run_log(spark, sf)
    found = savings.component_times(stage_runs(spark, sf), ["dataset"], func)
    return savings.component_savings(savings.component_uses(log, ["dataset"]), found, ["dataset"])


def savings_report(spark, sf):
    per_kind = savings.savings_per_kind(component_savings(spark, sf), ["dataset"])
    return savings.savings_report(per_kind, savings.dataset_totals(fx.run_log(spark, sf), ["dataset"]), ["dataset"])


@query(
    "i10_component_savings",
    f"with {SAVINGS_CTE} select dataset, kind, component, {s6('saved_time', 'saved_time')}, avoided_runs from savings",
)
def i10(spark, sf):
    return columns.round_numbers(component_savings(spark, sf), 6)


@query(
    "i11_savings_per_kind",
    f"with {SAVINGS_CTE} select dataset, kind, {s6('total_saved_time', 'total_saved_time')}, total_avoided_runs from per_kind",
)
def i11(spark, sf):
    return columns.round_numbers(savings.savings_per_kind(component_savings(spark, sf), ["dataset"]), 6)


@query(
    "i12_dataset_totals",
    f"with {SAVINGS_CTE} select dataset, {s6('run_time', 'run_time')}, component_count from totals",
)
def i12(spark, sf):
    return columns.round_numbers(savings.dataset_totals(fx.run_log(spark, sf), ["dataset"]), 6)


@query(
    "i13_savings_report",
    f"with {SAVINGS_CTE} select dataset, {', '.join(s6(c, c) for c in REPORT_COLUMNS)}, total_components, "
    "imputer_avoided_runs, scaler_avoided_runs, feature_preprocessor_avoided_runs, "
    f"{s6('avoided_percent', 'avoided_percent')} from report",
)
def i13(spark, sf):
    return columns.round_numbers(savings_report(spark, sf), 6)


COUNTS_CTE = """counts as (select dataset, count(*) filter (status = 'failed') as failed,
  count(*) filter (status = 'timeout') as timeout from runs group by dataset)"""


@query("i14_status_counts", f"with {RUNS_CTE}, {COUNTS_CTE} select * from counts")
def i14(spark, sf):
    return leaderboard.status_counts(fx.run_log(spark, sf), ["dataset"])


@query(
    "c_j4_attach_counts",
    f"with {SAVINGS_CTE}, {COUNTS_CTE} select r.dataset, failed, timeout, {', '.join(s6(c, c) for c in REPORT_COLUMNS)} "
    "from report r left join counts c on r.dataset = c.dataset",
)
def cj4(spark, sf):
    counts = leaderboard.status_counts(fx.run_log(spark, sf), ["dataset"])
    joined = savings_report(spark, sf).join(counts, "dataset", "left")
    return columns.round_numbers(joined.select("dataset", "failed", "timeout", *REPORT_COLUMNS), 6)


@query(
    "i15_geometric_means",
    f"with {SAVINGS_CTE} select {', '.join(f'round(exp(avg(ln({c}))), 2) as {c}' for c in REPORT_COLUMNS)} from report",
)
def i15(spark, sf):
    return savings.geometric_means(savings_report(spark, sf), REPORT_COLUMNS)


# ------------------------------------------------------------------ comparison

COMPARISON_CTE = f"""{RUNS_CTE},
ours as (select dataset, count(*) as n_pipelines, avg(valid_accuracy) as test_accuracy from runs group by dataset),
base as (select 'ds_' || cast(user_id % 15 as varchar) as dataset, count(*) as n_pipelines,
  avg(cast(json_extract(props, '$.k') as double)) / 100 as test_accuracy from events where event_type = 'view' group by 1),
compared as (select o.dataset, o.n_pipelines as n_ours, b.n_pipelines as n_baseline,
  o.test_accuracy as a, b.test_accuracy as b from ours o join base b on o.dataset = b.dataset)"""


def both_sides(spark, sf):
    ours = fx.run_log(spark, sf).groupBy("dataset").agg(
        F.count("*").alias("n_pipelines"), F.avg("valid_accuracy").alias("test_accuracy")
    )
    views = fx.table(spark, sf, "events").filter(F.col("event_type") == "view")
    baseline = views.groupBy(F.concat(F.lit("ds_"), F.pmod("user_id", F.lit(15)).cast("string")).alias("dataset")).agg(
        F.count("*").alias("n_pipelines"),
        (F.avg(F.get_json_object("props", "$.k").cast("double")) / 100).alias("test_accuracy"),
    )
    return ours, baseline


@query(
    "c_j5_join_histories",
    f"with {COMPARISON_CTE} select dataset, n_ours, n_baseline, {s6('a', 'accuracy_ours')}, {s6('b', 'accuracy_baseline')} "
    "from compared",
)
def cj5(spark, sf):
    ours, baseline = both_sides(spark, sf)
    return columns.round_numbers(compare.comparison(ours, baseline, ("ours", "baseline"), 6).drop("winner"), 6)


@query(
    "i16_comparison",
    f"""with {COMPARISON_CTE} select dataset, n_ours, n_baseline, round(a, 3) as accuracy_ours,
      round(b, 3) as accuracy_baseline, case when a > b then 'ours' when a < b then 'baseline' else 'draw' end as winner
    from compared""",
)
def i16(spark, sf):
    ours, baseline = both_sides(spark, sf)
    return compare.comparison(ours, baseline, ("ours", "baseline"))


# ------------------------------------------------------------------ sweep reports


def sweep_costs(spark, sf):
    """Total, generation and solution seconds per evaluation."""
    return sweep_rows(spark, sf).select(
        "training_size",
        "degree",
        "noise",
        "seed",
        (F.col("seconds") * 10).alias("total_sec"),
        F.col("seconds").alias("generation_sec"),
        (F.col("seconds") * 0.5).alias("solution_sec"),
    )


@query(
    "i17_cost_report",
    f"""with {SWEEP_CTE}, g as (select training_size, degree, noise, sum(seconds * 10) as t, sum(seconds) * 4 as a,
      sum(seconds * 0.5::double) * 4 as b from sweep group by training_size, degree, noise)
    select training_size, degree, noise, round(t, 2) as total_sec, round(a, 2) as saved_generation_sec,
      round(b, 2) as saved_solution_sec, round((a + b) / (t + a + b) * 100, 2) as saved_percent from g""",
)
def i17(spark, sf):
    return sweep.cost_report(sweep_costs(spark, sf), ["training_size", "degree", "noise"])


CONFIG_KEYS = ["training_size", "degree", "noise", "seed"]


@query(
    "i18_stage_seconds",
    f"""with {SWEEP_CTE} select training_size, degree, noise, seed,
      {s6('max(seconds) filter (event_id // 1200 % 2 = 0)', 'generation_sec')},
      {s6('max(seconds) filter (event_id // 1200 % 2 = 1)', 'solution_sec')}
    from sweep group by training_size, degree, noise, seed""",
)
def i18(spark, sf):
    stage = F.when(F.floor(F.col("event_id") / 1200) % 2 == 0, sweep.MAKING).otherwise(sweep.SOLVING)
    runs = sweep_rows(spark, sf).withColumn("file_name", F.concat(stage, F.lit("run_time.json")))
    return columns.round_numbers(sweep.stage_seconds(runs, CONFIG_KEYS), 6)


BOX_KEYS = ["training_size", "noise", "regressor", "degree"]
BOX_CTE = f"""{SWEEP_CTE},
q as (select training_size, noise, regressor, degree, quantile_cont(regret, 0.25) as q1, quantile_cont(regret, 0.5) as median,
  quantile_cont(regret, 0.75) as q3 from sweep group by training_size, noise, regressor, degree),
j as (select s.regret, s.event_id, q.*, regret between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from sweep s join q
  on s.training_size = q.training_size and s.noise = q.noise and s.regressor = q.regressor and s.degree = q.degree)"""


@query(
    "i19_box_statistics",
    f"""with {BOX_CTE} select training_size, noise, regressor, degree, {s6('any_value(q1)', 'q1')},
      {s6('any_value(median)', 'median')}, {s6('any_value(q3)', 'q3')},
      {s6('least(min(regret) filter (inside), any_value(q1))', 'whisker_low')},
      {s6('greatest(max(regret) filter (inside), any_value(q3))', 'whisker_high')},
      count(*) filter (not inside) as n_outliers from j group by training_size, noise, regressor, degree""",
)
def i19(spark, sf):
    return columns.round_numbers(sweep.box_statistics(sweep_rows(spark, sf), BOX_KEYS, "regret"), 6)


@query(
    "i19_box_outliers",
    f"with {BOX_CTE} select training_size, noise, regressor, degree, {s6('regret', 'regret')} from j where not inside",
)
def i19_outliers(spark, sf):
    return columns.round_numbers(sweep.box_outliers(sweep_rows(spark, sf), BOX_KEYS, "regret"), 6)


@query(
    "i20_baseline_summary",
    f"""select event_id as run_id, ([{', '.join(f"'{n}'" for n in BASELINE_NAMES)}])[(event_id + event_id % 3) % 16 + 1]
      as classifier, a.accuracy as test_accuracy from events cross join
      (select round(avg(cast(event_type = 'view' as double)), 5) as accuracy from events) a""",
)
def i20(spark, sf):
    from pipegrid.operators.metrics import accuracy

    predictions = fx.table(spark, sf, "events").select(
        F.lit("test").alias("split"), (F.col("event_type") == "view").cast("int").alias("y_pred"), F.lit(1).alias("label")
    )
    # one row per split, so it is a scalar to attach
    test = accuracy(predictions, ["split"]).first()["accuracy"]
    return a8(spark, sf).select("run_id", "classifier", F.lit(test).alias("test_accuracy"))
