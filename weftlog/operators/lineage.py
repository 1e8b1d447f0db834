"""Run registry, experiment comparison and history tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_tag string, dataset string, pipeline_stage string, changelog string, justification string, "
    "depends_on array<string>, recorded_at timestamp"
)
ARTIFACT_SCHEMA = "run_tag string, name string, path string, recorded_at timestamp"
METRIC_SCHEMA = "run_tag string, split string, metric string, value double, recorded_at timestamp"


def compare_runs(results: DataFrame, metrics: Sequence[str] = ("f1", "pr_auc", "roc_auc")) -> DataFrame:
    """Flat comparison of `name, status, val{}, test{}`: four digits, best test F1 first.
    Failed experiments stay, without metrics."""
    cols = [F.round(F.col(f"{part}.{m}"), 4).alias(f"{part}_{m}") for part in ("val", "test") for m in metrics]
    return results.select("name", "status", *cols).orderBy(F.desc_nulls_last("test_f1"), "name")


def best_per_metric(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Flag the maximum of each metric among the OK rows. The maxima are one small
    row, so no window has to hold the whole table."""
    ok = F.col("status") == "OK"
    best = results.agg(*[F.max(F.when(ok, F.col(m))).alias(m) for m in metrics]).first()
    flags = {f"best_{m}": F.coalesce(ok & (F.col(m) == F.lit(best[m])), F.lit(False)) for m in metrics}
    return results.withColumns(flags)


def explode_history(results: DataFrame) -> DataFrame:
    """Long form of the per-epoch history kept as an array in each result document."""
    return results.select("name", F.explode("history").alias("h")).select("name", "h.*")


def history_table(history: DataFrame, name: str = "name") -> DataFrame:
    """Flag the best epoch of each experiment: highest validation F1, the later one on a tie."""
    best = history.groupBy(name).agg(F.max(F.struct("val_f1", "epoch")).alias("b"))
    rows = history.join(best.select(name, F.col("b.epoch").alias("best_epoch")), name)
    return rows.withColumn("is_best", F.col("epoch") == F.col("best_epoch")).drop("best_epoch")


def record_run(path: str, run: DataFrame) -> None:
    """Append run records; the current state of a run is its latest record."""
    run.write.mode("append").parquet(f"{path}/runs")


def add_artifact(path: str, artifact: DataFrame) -> None:
    artifact.write.mode("append").parquet(f"{path}/run_artifacts")


def update_metrics(path: str, metrics: DataFrame) -> None:
    metrics.write.mode("append").parquet(f"{path}/run_metrics")


def current(df: DataFrame, keys: Sequence[str], at: str = "recorded_at") -> DataFrame:
    """Latest record per key, as an aggregate (no sort, partial on the map side)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(at)).alias("__r"))
    return picked.select(*keys, "__r.*")


def resolve_inputs(runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Inputs of a run: the outputs of the runs it depends on."""
    deps = runs.select("run_tag", F.explode("depends_on").alias("dependency"))
    outputs = artifacts.select(F.col("run_tag").alias("dependency"), "name", "path")
    return deps.join(outputs, "dependency").select("run_tag", "dependency", "name", "path")
