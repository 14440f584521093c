"""Run every pipeline of a space, computing shared stages once.

The pipelines form a tree: imputer, then scaler, then feature step, then classifier. A
stage's output is cached while something below it is pending. Groups below one scaler
run side by side in a few driver threads; all data work is Spark jobs.
"""

from __future__ import annotations

import threading
import time
import traceback
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession

from pipegrid.frame import Features
from pipegrid.operators.metrics import scores
from pipegrid.plans.components import BUILT_IN, Component
from pipegrid.plans.runlog import Journal, version_of
from pipegrid.session import hold
from pipegrid.sources.stages import StageStore

TRAIN_LIMIT = 100.0  # seconds per stage in the training phase; no limit in the test phase

# fixed value: how the text of a failed run begins
ERROR_HEAD = "Runtime error:\n"


class StageTimeout(RuntimeError):
    pass


@dataclass(frozen=True)
class GridSettings:
    dataset: str
    phase: str = "train"
    seed: int = 123
    workers: int = 1
    time_limit: float | None = TRAIN_LIMIT
    reuse: bool = True
    log_path: str | None = None  # where run and stage records are written as they come, and found on a rerun
    store_path: str | None = None  # where stage outputs are kept for later runs


@contextmanager
def limited(spark: SparkSession, seconds: float | None):
    """Cancel the Spark jobs of the block when it takes too long."""
    if seconds is None:
        yield
        return
    context = spark.sparkContext
    group = f"stage-{uuid.uuid4()}"
    expired = threading.Event()

    def cancel():
        expired.set()
        context.cancelJobGroup(group)

    context.setJobGroup(group, "pipegrid stage", interruptOnCancel=True)
    timer = threading.Timer(seconds, cancel)
    timer.daemon = True
    timer.start()
    try:
        yield
    except Exception as error:
        if expired.is_set():
            raise StageTimeout(f"stopped after {seconds} seconds") from error
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    if expired.is_set():
        raise StageTimeout(f"stopped after {seconds} seconds")


@dataclass
class _Stage:
    """A stage's output, or the error all pipelines below it inherit."""

    features: Features | None
    error: Exception | None = None
    detail: str = ""
    cached: DataFrame | None = None
    chain: tuple[str, ...] = ()

    def release(self) -> None:
        if self.cached is not None:
            self.cached.unpersist()


def run_grid(
    data: Features,
    pipelines: DataFrame | Iterable[Row],
    settings: GridSettings,
    registry: dict[str, Component] = BUILT_IN,
) -> DataFrame:
    """One run-log row per pipeline; a failing stage fails only the pipelines that use it.

    With a log path, pipelines that succeeded before with the same seed on the same rows are not run again, failures get a
    further attempt, and the log of all attempts with that seed and these rows is returned. ``Journal(spark, log_path).read_stages()`` has the seconds of every stage.
    """
    spark = data.df.sparkSession
    rows = list(pipelines.collect()) if isinstance(pipelines, DataFrame) else list(pipelines)
    journal = Journal(spark, settings.log_path)
    base = hold(data.df)
    kept = settings.log_path is not None or settings.store_path is not None
    version = version_of(base) if kept else None
    mine = (settings.dataset, settings.phase, settings.seed, version)
    try:
        if settings.log_path is not None:
            known = journal.succeeded(*mine)
            rows = [r for r in rows if r["pipeline_id"] not in known]
        runner = _Runner(spark, settings, registry, journal, version)
        (runner.run if settings.reuse else runner.run_alone)(replace(data, df=base), rows)
    finally:
        base.unpersist()
    return journal.runs_of(*mine)


def _grouped(rows, key: str) -> dict:
    out: dict = {}
    for row in rows:
        out.setdefault(row[key], []).append(row)
    return out


class _Runner:
    def __init__(self, spark, settings: GridSettings, registry, journal: Journal, version: str | None):
        self.spark, self.settings, self.registry, self.journal, self.version = spark, settings, registry, journal, version
        self.store = StageStore(spark, settings.store_path) if settings.store_path is not None else None

    def run(self, data: Features, rows) -> None:
        for imputer, imputed_rows in _grouped(rows, "imputer").items():
            imputed = self.stage(_Stage(data), "imputer", imputer, cache=True)
            for scaler, scaled_rows in _grouped(imputed_rows, "scaler").items():
                scaled = self.stage(imputed, "scaler", scaler, cache=scaler is not None)
                groups = _grouped(scaled_rows, "feature_preprocessor")

                def one_group(step, scaled=scaled, groups=groups):
                    made = self.stage(scaled, "feature_preprocessor", step, cache=step is not None)
                    for row in groups[step]:
                        self.classify(made, row)
                    if made is not scaled:
                        made.release()

                with ThreadPoolExecutor(max(1, self.settings.workers)) as pool:
                    list(pool.map(inheritable_thread_target(self.spark)(one_group), groups))
                if scaled is not imputed:
                    scaled.release()
            imputed.release()

    def run_alone(self, data: Features, rows) -> None:
        """Every pipeline from scratch: what the reuse is measured against."""
        for row in rows:
            stage = _Stage(data)
            for kind in ("imputer", "scaler", "feature_preprocessor"):
                stage = self.stage(stage, kind, row[kind], cache=False)
            self.classify(stage, row)

    def stage(self, parent: _Stage, kind: str, name: str | None, cache: bool) -> _Stage:
        """Fit and apply a component. A cached stage is computed here, so that its seconds are its own."""
        if name is None or parent.error is not None:
            return parent
        started, chain = time.time(), (*parent.chain, name)
        settings = self.settings

        def make() -> Features:
            fitted = self.registry[name].fit(parent.features.train(), settings.seed)
            return fitted.apply(parent.features)

        cached = None
        try:
            with limited(self.spark, settings.time_limit):
                if self.store is not None:
                    made = self.store.get_or_make(
                        self.store.path(settings.dataset, settings.phase, settings.seed, [self.version, *map(self.named, chain)]), make
                    )
                else:
                    made = make()
                if cache:
                    cached = hold(made.df)
                    cached.count()
            stage = _Stage(replace(made, df=cached) if cache else made, None, "", cached, chain)
        except Exception as error:
            if cached is not None:
                cached.unpersist()
            stage = _Stage(None, error, traceback.format_exc(), None, chain)
        self.journal.add_stage(
            (settings.dataset, settings.phase, kind, name, ">".join(chain), _status(stage.error), time.time() - started, started)
        )
        return stage

    def named(self, name: str) -> str:
        """A component with what it was registered with, since stored outputs depend on that."""
        fit = self.registry[name].fit
        settings = (getattr(fit, "args", ()), getattr(fit, "keywords", {}), getattr(fit, "__defaults__", None))
        return f"{name}:{getattr(fit, '__module__', '')}.{getattr(fit, '__qualname__', '')}:{settings}"

    def classify(self, stage: _Stage, row: Row) -> None:
        started = time.time()
        values: dict[tuple[str, str], float] = {}
        error, detail = stage.error, stage.detail
        if error is None:
            try:
                with limited(self.spark, self.settings.time_limit):
                    model = self.registry[row["classifier"]].fit(stage.features.train(), self.settings.seed)
                    for r in scores(model.predict(stage.features), ["split"]).collect():
                        values[("accuracy", r["split"])] = r["accuracy"]
                        values[("balanced_accuracy", r["split"])] = r["balanced_accuracy"]
            except Exception as caught:
                error, detail = caught, traceback.format_exc()
        seconds = time.time() - started
        name = row["classifier"]
        self.journal.add_stage(
            (self.settings.dataset, self.settings.phase, "classifier", name, ">".join([*stage.chain, name]), _status(error), seconds, started)
        )
        self.journal.add_run(
            (
                row["pipeline_id"],
                self.settings.dataset,
                self.settings.phase,
                row["imputer"],
                row["scaler"],
                row["feature_preprocessor"],
                name,
                _status(error),
                values.get(("accuracy", "train")),
                values.get(("accuracy", "test")),
                values.get(("balanced_accuracy", "train")),
                values.get(("balanced_accuracy", "test")),
                seconds,
                started,
                None if error is None else ERROR_HEAD + detail,
                self.settings.seed,
                self.version,
            )
        )


def _status(error: Exception | None) -> str:
    return "success" if error is None else "timeout" if isinstance(error, StageTimeout) else "failed"


def run_incumbent(
    data: Features,
    log: DataFrame,
    settings: GridSettings,
    metric: str = "accuracy",
    registry: dict[str, Component] = BUILT_IN,
) -> DataFrame:
    """Refit the best pipeline on all training rows and score it on the test rows."""
    from pipegrid.plans.leaderboard import incumbents

    best = incumbents(log, ["dataset"], metric).collect()
    if not best:
        raise ValueError("no successful run, so there is no incumbent")
    return run_grid(data, best, replace(settings, phase="test", time_limit=None), registry)
