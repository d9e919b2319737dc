"""From event-log lines to every table of stages, jobs, executors and applications, and their findings."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame

from ..operators import extract as X
from ..operators import stages as S
from ..sources import eventlog as E
from .rules import Thresholds, findings


def gold_tables(events: DataFrame, thresholds: Thresholds | None = None, store: str | None = None, only: Collection[str] | None = None) -> dict[str, DataFrame]:
    """Every table, by name. With store, a folder that all executors share, lines are numbered, named and written there once by event, finished tasks, from which
    most tables are summed, once as columns, and so are the tables that others are made of; without it each table reads the lines anew. With only, tables of these
    names and the findings that they allow are made, and nothing is stored that none of them is made of."""

    def kept(name: str, df: DataFrame, *of: str) -> DataFrame:
        """df, stored if it or a table that is made of it is wanted."""
        if not store or only is not None and not {name, *of}.intersection(only):
            return df
        df.write.mode("overwrite").parquet(f"{store}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{store}/{name}")

    if store:
        events = E.stored_events(events, f"{store}/events")
    shared = ("stage_dist", "stage_quartiles", "stage_duration_hist", "stage_executor", "slowest_tasks", "sampled_tasks", "task_failures", "executor_totals", "operator_spread")
    whole = only is None or bool(set(shared).intersection(only))  # else totals and the ids of ended tasks are all that is read of tasks
    tasks, starts = kept("tasks", X.task_ends(events), *shared), X.task_starts(events)
    ended = tasks if whole else X.task_ends(events, ("task_id",))
    jobs = kept("jobs", S.jobs(X.job_starts(events), X.job_ends(events)), "job_stage", "applications", "executors", "driver_gaps", "run_path", "critical_path", "executors_over_time", "peak_per_host", "cpu_use")
    counts = E.event_counts(events)
    apps = kept("applications", S.applications(X.app_starts(events), X.app_ends(events), jobs, counts), "executors", "driver_gaps", "run_path", "executors_over_time", "peak_per_host", "cpu_use")
    totals = kept("stage_totals", S.stage_totals(tasks if whole else X.task_ends(events, S.TOTALLED)), "stages", "cpu_use", "run_path", "critical_path")
    executors = kept("executors", S.executors(X.executors_added(events), X.executors_removed(events), apps), "executors_over_time", "peak_per_host", "cpu_use")
    stage_events = X.stage_events(events)
    stages = kept("stages", S.stages(stage_events, totals, X.app_ends(events)), "run_path", "critical_path")
    plans = S.latest_plans(X.sql_starts(events), X.sql_adaptive(events))
    nodes = S.plan_nodes(plans.drop("plan_text"))
    updates = X.block_updates(events)
    out = {
        "event_counts": counts,
        "line_quality": E.line_quality(events),
        "applications": apps,
        "jobs": jobs,
        "job_stage": S.job_stage(jobs),
        "stages": stages,
        "stage_totals": totals,
        "stage_dist": S.stage_dist(tasks),
        "stage_quartiles": S.stage_quartiles(tasks),
        "stage_duration_hist": S.stage_duration_hist(tasks),
        "stage_executor": S.stage_executor(tasks),
        "slowest_tasks": S.slowest_tasks(tasks),
        "sampled_tasks": S.sampled_tasks(tasks),
        "task_failures": S.task_failures(tasks),
        "running_tasks": S.running_tasks(starts, ended),
        "executors": executors,
        "executor_totals": S.executor_totals(tasks),
        "executor_peaks": S.executor_peaks(X.peak_samples(events)),
        "executors_over_time": S.executors_over_time(executors),
        "peak_per_host": S.peak_per_host(executors),
        "cpu_use": S.cpu_use(executors, totals),
        "driver_gaps": S.driver_gaps(apps, jobs),
        "critical_path": S.critical_path(jobs, stages),
        "run_path": S.run_path(apps, stages, jobs),
        "settings": X.settings(events),
        "exclusions": X.exclusions(events),
        "catalog_events": X.catalog_events(events),
        "block_kinds": S.block_kinds(updates),
        "cached_blocks": S.cached_blocks(updates, X.unpersisted(events)),
        "plan_nodes": nodes,
        "operator_spread": S.operator_spread(tasks, nodes),
        "sql_ends": X.sql_ends(events),
        "block_managers": X.block_managers(events),
        "resource_profiles": X.resource_profiles(events),
        "driver_accumulators": X.driver_accumulators(events),
    }
    if only is not None:
        out = {name: out[name] for name in only}
    out["findings"] = findings(out, thresholds)
    return out
