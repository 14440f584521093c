import json

import pytest
from pyspark.sql import functions as F

from pipegrid.frame import from_columns
from pipegrid.operators import forests, impute, metrics, neighbours, scale
from pipegrid.plans import compare, components, grid, leaderboard, runlog, savings, space, sweep
from pipegrid.sources import records, stages, tables


def counted(spark, names=None, registry=components.BUILT_IN):
    all_of = space.enumerate_space(components.registry_table(spark, registry, names))
    return all_of, space.drop_forbidden(all_of, space.forbidden_table(spark))


def test_space_sizes(spark):
    all_of, allowed = counted(spark)
    assert (all_of.count(), allowed.count()) == (1456, 1183)
    assert all_of.select("pipeline_id").distinct().count() == 1456
    assert space.enumerate_space(space.components_table(spark)).count() == 1456
    assert {c.name for c in components.BUILT_IN.values()} == {r["name"] for r in space.components_table(spark).collect()}


def test_user_forbidden_sets_and_uniqueness(spark):
    names = ["SKLSimpleImpute", "SKLMinMaxScaler", "SKLRobustScaler", "SKLDecisionTree", "SKLRandomForest"]
    all_of, _ = counted(spark, names)
    with_scaler = all_of.filter("scaler is not null")
    assert with_scaler.count() == 4
    own = space.forbidden_table(spark, [("SKLMinMaxScaler", "SKLDecisionTree", "SKLSimpleImpute")])
    assert space.drop_forbidden(with_scaler, own).count() == 3
    approaches = ["a", "b", "c", "d", "e"]
    members = spark.createDataFrame(
        [(f"{p}{q}", "approach", n) for p in approaches for q in approaches for n in (p, q)],
        "pipeline_id string, kind string, implementation string",
    )
    assert space.unique_per_kind(members, ["pipeline_id"]).count() == 5


def test_space_round_trip(spark, tmp_path):
    _, allowed = counted(spark)
    space.save_space(allowed, str(tmp_path / "space"))
    assert space.load_space(spark, str(tmp_path / "space")).exceptAll(allowed).count() == 0
    assert space.cap_space(allowed, 10).count() == 10


NAMES = ["SKLSimpleImpute", "SKLStandardScaler", "SKLSelectPercentile", "SKLGaussianNaiveBayes", "SKLBernoulliNB"]


def comparable(log):
    return sorted(
        tuple(r[c] for c in ("pipeline_id", "status", "train_accuracy", "valid_accuracy", "valid_balanced_accuracy"))
        for r in log.collect()
    )


def test_grid_gives_the_same_log_with_and_without_reuse(spark, separable):
    _, allowed = counted(spark, NAMES)
    logs = [
        grid.run_grid(separable, allowed, grid.GridSettings("d", reuse=reuse, workers=workers))
        for reuse, workers in ((True, 3), (False, 1))
    ]
    assert comparable(logs[0]) == comparable(logs[1])
    assert len(comparable(logs[0])) == 8 and {r["status"] for r in logs[0].collect()} == {"success"}
    best = grid.run_incumbent(separable, logs[0], grid.GridSettings("d")).collect()
    assert len(best) == 1 and best[0]["phase"] == "test"


def test_a_rerun_resumes_from_the_written_log(spark, separable, tmp_path):
    """A run that ended early leaves its records; the next one runs the rest and numbers new attempts."""
    registry = {n: components.BUILT_IN[n] for n in NAMES}
    fits = []

    @components.component(registry, "classifier", "Flaky")
    def flaky(train, seed):
        fits.append(seed)
        raise RuntimeError("no luck")

    _, allowed = counted(spark, registry=registry)
    rows = sorted((r for r in allowed.collect() if r["scaler"] is None), key=lambda r: r["pipeline_id"])
    settings = grid.GridSettings("d", log_path=str(tmp_path / "log"), store_path=str(tmp_path / "store"))
    grid.run_grid(separable, rows[:3], settings, registry)
    first = {r["pipeline_id"]: r["started_at"] for r in runlog.Journal(spark, settings.log_path).read_runs().collect()}
    assert set(first) == {r["pipeline_id"] for r in rows[:3]}
    log = grid.run_grid(separable, rows, settings, registry).collect()
    done = [r for r in log if r["status"] == "success"]
    assert {r["pipeline_id"] for r in log} == {r["pipeline_id"] for r in rows} and len(done) == len({r["pipeline_id"] for r in done})
    assert all(r["started_at"] == first[r["pipeline_id"]] for r in done if r["pipeline_id"] in first)
    plain = grid.run_grid(separable, [r for r in rows if r["classifier"] != "Flaky"], grid.GridSettings("d"), registry)
    assert comparable(plain) == sorted(x for x in comparable(spark.createDataFrame(done, runlog.RUN_LOG_SCHEMA)))
    journal = runlog.Journal(spark, settings.log_path)
    tries = journal.attempts().filter("status = 'failed'").groupBy("pipeline_id").agg({"attempt": "max"}).collect()
    assert sum(r["max(attempt)"] for r in tries) == len(fits)
    seconds = journal.read_stages().filter("status = 'success'").groupBy("kind").sum("seconds").collect()
    assert {r["kind"] for r in seconds} >= {"imputer", "classifier"} and all(r["sum(seconds)"] > 0 for r in seconds)


def test_another_seed_or_other_data_run_again(spark, separable, tmp_path):
    from dataclasses import replace

    registry = {n: components.BUILT_IN[n] for n in NAMES}
    fits = []

    @components.component(registry, "classifier", "Counting")
    def counting(train, seed):
        fits.append(seed)
        return components.BUILT_IN["SKLGaussianNaiveBayes"].fit(train, seed)

    _, allowed = counted(spark, registry=registry)
    rows = [r for r in allowed.collect() if r["classifier"] == "Counting" and r["feature_preprocessor"] is None][:2]
    settings = grid.GridSettings("d", log_path=str(tmp_path / "log"), store_path=str(tmp_path / "store"))
    run = lambda data, s: comparable(grid.run_grid(data, rows, s, registry))
    first = run(separable, settings)
    n = len(fits)
    # the same rows in another order are the same data
    assert run(replace(separable, df=separable.df.repartition(3)), settings) == first and len(fits) == n
    assert len(run(separable, replace(settings, seed=7))) == len(rows) and len(fits) == 2 * n and fits[-1] == 7
    other = replace(separable, df=separable.df.withColumn("label", 1 - F.col("label")).filter("row_id % 5 > 0"))
    fresh = comparable(grid.run_grid(other, rows, grid.GridSettings("d"), registry))
    assert run(other, settings) == fresh and len(fits) == 4 * n
    assert run(separable, settings) == first and len(fits) == 4 * n


def test_failures_and_timeouts_are_recorded(spark, separable):
    registry = {n: components.BUILT_IN[n] for n in NAMES}

    @components.component(registry, "feature_preprocessor", "Broken")
    def broken(train, seed):
        raise RuntimeError("no luck")

    @components.component(registry, "classifier", "Slow")
    def slow(train, seed):
        train.df.sparkSession.range(8).repartition(8).rdd.map(lambda r: __import__("time").sleep(60)).count()

    _, allowed = counted(spark, registry=registry)
    rows = [r for r in allowed.collect() if r["scaler"] is None]
    log = grid.run_grid(separable, rows, grid.GridSettings("d", time_limit=15.0), registry).collect()
    status = {(r["feature_preprocessor"], r["classifier"]): r["status"] for r in log}
    assert status[("Broken", "SKLGaussianNaiveBayes")] == "failed" and status[(None, "Slow")] == "timeout", [r["error"] for r in log if r["classifier"] == "Slow"]
    assert status[("SKLSelectPercentile", "SKLBernoulliNB")] == "success"
    assert any("no luck" in (r["error"] or "") for r in log)
    logged = spark.createDataFrame(log, runlog.RUN_LOG_SCHEMA)
    summary = leaderboard.train_summary(logged, ["dataset"]).first()
    assert summary["n_runs"] == len(rows) and summary["failed"] >= 2 and summary["timeout"] >= 1


def test_savings_of_a_log(spark):
    def run(pipeline, scaler, step, status, seconds):
        return (pipeline, "d", "train", "I", scaler, step, "C", status, None, None, None, None, seconds, 0.0, None, 1, "v")

    runs = spark.createDataFrame(
        [run("a", "S", "P", "success", 5.0), run("b", "S", None, "success", 3.0), run("c", "S", "P", "success", 2.0), run("d", "S", None, "failed", 10.0)],
        runlog.RUN_LOG_SCHEMA,
    )
    stage = lambda kind, name, status, seconds: ("d", "train", kind, name, name, status, seconds, 0.0)
    made = [stage("imputer", "I", "success", 1.0), stage("scaler", "S", "success", 2.0), stage("scaler", "S", "success", 4.0)]
    made += [stage("feature_preprocessor", "P", "success", 1.5), stage("feature_preprocessor", "P", "failed", 99.0), stage("classifier", "C", "success", 1.0)]
    stages_log = spark.createDataFrame(made, runlog.STAGE_LOG_SCHEMA)
    (row,) = savings.log_report(runs, stages_log, ["dataset", "phase"]).collect()
    # the imputer ran once for three uses, the scaler twice (3 s each), the step once for two
    assert (row["imputer_saved_sec"], row["scaler_saved_sec"], row["feature_preprocessor_saved_sec"]) == (2.0, 3.0, 1.5)
    assert (row["imputer_avoided_runs"], row["scaler_avoided_runs"], row["feature_preprocessor_avoided_runs"]) == (2, 1, 1)
    assert row["total_run_sec"] == 20.0 and row["total_components"] == 8
    assert row["saved_percent"] == pytest.approx(6.5 / 26.5 * 100) and row["avoided_percent"] == 50.0
    assert savings.log_report(runs.limit(0), stages_log, ["dataset", "phase"]).count() == 0


def test_user_estimators(spark, separable):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import MinMaxScaler

    fit_scaler = components.from_estimator(lambda: MinMaxScaler(inputCol="features", outputCol="scaled"), "scaled")
    scaled = fit_scaler(separable.train()).apply(separable)
    fit_model = components.from_estimator(lambda: NaiveBayes(modelType="gaussian"), "prediction")
    rows = fit_model(scaled.train()).predict(scaled).collect()
    assert scaled.dim == 6 and sum(r["label"] == r["y_pred"] for r in rows) > 0.85 * len(rows)


def test_no_success_means_no_incumbent(spark, separable):
    log = spark.createDataFrame(
        [("p", "d", "train", "i", None, None, "c", "failed", None, None, None, None, 1.0, 0.0, "x", 123, None)], runlog.RUN_LOG_SCHEMA
    )
    assert leaderboard.incumbents(log, ["dataset"]).count() == 0
    with pytest.raises(ValueError, match="no incumbent"):
        grid.run_incumbent(separable, log, grid.GridSettings("d"))


def test_ranking_puts_missing_last_and_breaks_ties(spark):
    log = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None), ("d", 0.9)], "pipeline_id string, valid_accuracy double")
    assert [r["pipeline_id"] for r in leaderboard.ranked(log).collect()] == ["d", "a", "b", "c"]


def test_balanced_accuracy_with_a_missing_class(spark):
    rows = [("test", 1, 1), ("test", 1, 0), ("train", 0, 0), ("train", 1, 0)]
    df = spark.createDataFrame(rows, "split string, label int, y_pred int")
    got = {r["split"]: (r["accuracy"], r["balanced_accuracy"]) for r in metrics.scores(df, ["split"]).collect()}
    assert got == {"test": (0.5, 0.5), "train": (0.5, 0.5)}


def test_record_files(spark, tmp_path):
    folder = tmp_path / "ds"
    folder.mkdir()
    good = {
        "last_task": ["t1"],
        "accuracy": {"train": 0.9, "test": 0.8},
        "balanced_accuracy": {"train": 0.7, "test": 0.6},
        "pipeline": {"imputer": "I", "scaler": None, "feature_preprocessor": "F", "classifier": "C"},
    }
    (folder / "t1_run_summary.json").write_text(json.dumps(good, indent=4))
    (folder / "t2_FAILURE_1.json").write_text(json.dumps({"task_id": "t2", "error": "e", "pipeline": ["C", "I"]}))
    (folder / "t3_TIMEOUT_2.json").write_text(json.dumps({"task_id": "t3", "pipeline": ["C", "I"]}))
    (folder / "C__x_run_time.json").write_text(json.dumps({"total_seconds": 2.5}))
    (folder / "notes.txt").write_text("x")
    files = records.read_record_files(spark, str(folder))
    rows = {r["last_task"]: r for r in records.parse_run_records(files, []).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"t1": "success", "t2": "failed", "t3": "timeout"}
    assert rows["t1"]["valid_balanced_accuracy"] == 0.6 and rows["t2"]["classifier"] is None
    assert [tuple(r) for r in records.parse_run_times(files, []).collect()] == [("C", 2.5)]


def test_evaluation_folders(spark, tmp_path):
    for seed in (1, 2):
        sub = tmp_path / f"shortest_path-ts_100-deg_2-noise_0.5-seed_{seed}"
        sub.mkdir()
        (sub / "Evaluation_summary.json").write_text(json.dumps({"regret": 0.1 * seed, "mse": 1.0, "regressor": "SPOPlus"}))
    rows = sorted(records.collect_evaluations(spark, str(tmp_path)).collect())
    assert [(r["training_size"], r["degree"], r["noise"], r["seed"], r["regret"]) for r in rows] == [
        (100, 2, 0.5, 1, 0.1),
        (100, 2, 0.5, 2, 0.2),
    ]
    bad = spark.createDataFrame([("two-parts",)], "name string")
    with pytest.raises(Exception, match="five-part"):
        records.parse_config_name(bad, "name", []).collect()


def test_missing_baseline_choice_is_null(spark):
    files = spark.createDataFrame([(5, '{"configs": {"0": {"classifier:__choice__": "mlp"}}}')], "rank int, content string")
    row = records.baseline_choice(files, "rank", []).first()
    assert row["classifier"] is None and row["id_in_run_history"] == 4


def test_reports_fail_on_bad_input(spark):
    double = spark.createDataFrame([(1, 2, 0.1), (1, 2, 0.2)], "seed int, degree int, regret double")
    with pytest.raises(Exception, match="duplicate"):
        sweep.pivot_regret(double, [], [2]).collect()
    with pytest.raises(Exception, match="positive"):
        savings.geometric_means(spark.createDataFrame([(0.0,), (2.0,)], "a double"), ["a"]).collect()
    info = spark.createDataFrame([("x", 5), ("y", 3)], "dataset string, n bigint")
    report = spark.createDataFrame([("x", 1)], "dataset string, v int")
    with pytest.raises(Exception, match="no report for y"):
        compare.in_order_of(report, info, "dataset", "n").collect()
    twice = spark.createDataFrame(
        [("d", "i", "s", "f", "c", 0.1, 0.2)] * 2,
        "dataset string, imputer string, scaler string, feature_preprocessor string, classifier string, "
        "train_accuracy double, test_accuracy double",
    )
    with pytest.raises(Exception, match="more than one"):
        leaderboard.test_summary(twice, ["dataset"]).collect()


def test_attempt_numbers_do_not_depend_on_buckets(spark):
    runs = spark.createDataFrame([("t", "failed", float(i), i) for i in range(100)], "task string, status string, at double, id int")
    rows = runlog.number_attempts(runs, ["task", "status"], "at", "id", rows_per_bucket=9).collect()
    assert all(r["attempt"] == r["id"] + 1 for r in rows)


def test_csv_round_trip(spark, separable, tmp_path):
    tables.save_split(separable, str(tmp_path), "train")
    back = tables.load_split(spark, str(tmp_path), list(separable.names), "train")
    assert back.df.select(*separable.df.columns).exceptAll(separable.df).count() == 0


def test_stage_store_and_components(spark, separable, tmp_path):
    store = stages.StageStore(spark, str(tmp_path))
    path = store.path("d", "train", 1, ["SKLStandardScaler"])
    calls = []

    def make():
        calls.append(1)
        return scale.fit_standard(separable.train()).apply(separable)

    first, second = store.get_or_make(path, make), store.get_or_make(path, make)
    assert len(calls) == 1 and first.names == second.names and second.df.count() == separable.df.count()
    fitted = impute.fit_mean_imputer(separable.train())
    stages.save_component(spark, fitted, str(tmp_path / "imputer"))
    assert stages.load_component(spark, str(tmp_path / "imputer")) == fitted
    for name, fit in (("forest", lambda t: forests.fit_random_forest(t, 1, 5)), ("nearest", neighbours.fit_nearest_neighbour)):
        model = fit(separable.train())
        stages.save_component(spark, model, str(tmp_path / name))
        again = stages.load_component(spark, str(tmp_path / name))
        answers = [sorted((r["row_id"], r["y_pred"]) for r in m.predict(separable).collect()) for m in (model, again)]
        assert answers[0] == answers[1]


def test_user_aggregate_for_times(spark):
    runs = spark.createDataFrame([("d", "c", 1.0), ("d", "c", 4.0)], "dataset string, component string, seconds double")
    row = savings.component_times(runs, ["dataset"], lambda s: F.max(s)).first()
    assert (row["run_time"], row["runs"]) == (4.0, 2)
    assert savings.component_times(runs, ["dataset"], "geometric_mean").first()["run_time"] == pytest.approx(2.0)


def test_missing_values_become_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "row_id bigint, a double")
    assert tables.missing_to_null(df, ["a"]).filter("a is null").count() == 1
    assert from_columns(df, ["a"]).dim == 1
