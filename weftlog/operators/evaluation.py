"""Curves, thresholds and reports over scored, labelled sessions.

Rows are merged by distinct score first; everything after that works on running
sums of positives and negatives in descending score order (`score_steps`).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftlog.operators.dataset import SPLITS, split_overlap, split_summary
from weftlog.operators.scoring import COMPONENTS
from weftlog.operators.sessions import SESSION
from weftlog.operators.skew import ROWS_PER_TASK, exact_percentiles, ordered


def score_steps(scores: DataFrame, by: Sequence[str] = (), *, score: str = "score", label: str = "label",
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Per group and distinct score: own and running counts of both classes, highest score first."""
    by = list(by)
    groups = scores.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos_cnt"), F.sum(1 - F.col(label).cast("bigint")).alias("neg_cnt")
    ).withColumn("__desc", -F.col("threshold"))
    rows = ordered(groups, by, ["__desc"], sums=["pos_cnt", "neg_cnt"],
                   rows_per_task=rows_per_task, settle=True)
    return rows.select(
        *by, "threshold", "pos_cnt", "neg_cnt", F.col("cum_pos_cnt").alias("tp"), F.col("cum_neg_cnt").alias("fp"),
        F.col("tot_pos_cnt").alias("positives"), F.col("tot_neg_cnt").alias("negatives"),
    )


def _precision():
    return F.col("tp") / (F.col("tp") + F.col("fp"))


def _recall():
    return F.when(F.col("positives") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.nullif(F.col("positives"), F.lit(0)))


def pr_points(steps: DataFrame) -> DataFrame:
    """Precision and recall when everything at or above the score is predicted positive."""
    return steps.withColumns({"precision": _precision(), "recall": _recall()})


def pr_curve(scores: DataFrame, **names) -> DataFrame:
    """All thresholds, the closing point (precision 1, recall 0) and the positive-rate baseline."""
    points = pr_points(score_steps(scores, **names)).select(
        "threshold", "precision", "recall", (F.col("positives") / (F.col("positives") + F.col("negatives"))).alias("baseline")
    )
    end = points.agg(F.max("baseline").alias("baseline")).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), "baseline"
    )
    return points.unionByName(end)


def best_threshold(scores: DataFrame, eps: float = 1e-10, **names) -> DataFrame:
    """Threshold of the highest F1; the lowest threshold on a tie.

    Scores without a positive label have no F1: the median score is the threshold then, with null
    measures. Only a table without scores gives no row."""
    points = pr_points(score_steps(scores, **names))
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(eps))
    best = points.where(F.col("positives") > 0).select("threshold", "precision", "recall", f1.alias("f1"))
    score = names.get("score", "score")
    none = F.lit(None).cast("double")
    # -1 ranks the fallback below every real point.
    middle = scores.agg(F.median(score).alias("threshold")).where(F.col("threshold").isNotNull()).select(
        "threshold", none.alias("precision"), none.alias("recall"), F.lit(-1.0).alias("f1"))
    one = best.unionByName(middle).orderBy(F.desc("f1"), "threshold").limit(1)
    return one.withColumn("f1", F.when(F.col("f1") >= 0, F.col("f1")))


def roc_curve(scores: DataFrame, **names) -> DataFrame:
    """False and true positive rates per threshold, starting at (0, 0)."""
    steps = score_steps(scores, **names)
    points = steps.select("threshold", (F.col("fp") / F.nullif(F.col("negatives"), F.lit(0))).alias("fpr"),
                          (F.col("tp") / F.nullif(F.col("positives"), F.lit(0))).alias("tpr"))
    start = scores.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(points)


def _auc_columns():
    both = F.nullif(F.max("positives") * F.max("negatives").cast("double"), F.lit(0.0))
    below = F.col("negatives") - F.col("fp") + F.col("neg_cnt") / 2
    roc = F.sum(F.col("pos_cnt") * below) / both
    step = F.col("pos_cnt") / F.nullif(F.col("positives"), F.lit(0))
    # The step above: what was predicted positive before this score came in.
    tp, fp = F.col("tp") - F.col("pos_cnt"), F.col("fp") - F.col("neg_cnt")
    before = F.when(tp + fp == 0, F.lit(1.0)).otherwise(tp / F.nullif(tp + fp, F.lit(0)))
    ap = F.sum(step * _precision())
    area = F.sum(step * (_precision() + before) / 2)
    one_class = (F.max("positives") == 0) | (F.max("negatives") == 0)
    return {n: F.when(one_class, F.lit(0.0)).otherwise(c)
            for n, c in {"roc_auc": roc, "average_precision": ap, "pr_auc_trapezoid": area}.items()}


def roc_auc(scores: DataFrame, **names) -> DataFrame:
    return score_steps(scores, **names).agg(_auc_columns()["roc_auc"].alias("roc_auc"))


def pr_auc(scores: DataFrame, method: str = "trapezoid", **names) -> DataFrame:
    col = {"trapezoid": "pr_auc_trapezoid", "average_precision": "average_precision"}[method]
    return score_steps(scores, **names).agg(_auc_columns()[col].alias("pr_auc"))


def confusion_matrix(pred: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label), F.col("pred")
    return pred.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def _ratio(a, b):
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def classification_report(pred: DataFrame, label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    m = confusion_matrix(pred, label)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def row(name, hit, extra, missed):
        p, r = _ratio(hit, hit + extra), _ratio(hit, hit + missed)
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        _ratio(2 * p * r, p + r).alias("f1"), (hit + missed).alias("support"))

    m = m.withColumns({"c0": row("0", tn, fn, fp), "c1": row("1", tp, fp, fn)})
    total = F.col("c0.support") + F.col("c1.support")

    def average(name, w0, w1, norm):
        cells = [((F.col(f"c0.{c}") * w0 + F.col(f"c1.{c}") * w1) / norm).alias(c) for c in ("precision", "recall", "f1")]
        return F.struct(F.lit(name).alias("class"), *cells, total.alias("support"))

    acc = _ratio(tn + tp, total)
    rows = F.array(
        F.col("c0"), F.col("c1"),
        F.struct(F.lit("accuracy").alias("class"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), total.alias("support")),
        average("macro", F.lit(1), F.lit(1), F.lit(2)),
        average("weighted", F.col("c0.support"), F.col("c1.support"), total),
    )
    return m.select(F.explode(rows).alias("r")).select("r.*")


def metric_summary(scores: DataFrame, threshold: float, **names) -> DataFrame:
    """F1, both areas, precision, recall and the 2x2 matrix in one row, from one set of steps.

    A step above the threshold counts as predicted; areas are 0 when only one class is present."""
    steps = score_steps(scores, **names)
    over = F.col("threshold") > threshold
    auc = _auc_columns()
    s = steps.agg(
        F.sum(F.when(over, F.col("pos_cnt")).otherwise(0)).alias("tp"),
        F.sum(F.when(over, F.col("neg_cnt")).otherwise(0)).alias("fp"),
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
        auc["average_precision"].alias("pr_auc"), auc["roc_auc"].alias("roc_auc"),
    )
    s = s.withColumns({"fn": F.col("positives") - F.col("tp"), "tn": F.col("negatives") - F.col("fp")})
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("positives"))
    return s.select(_ratio(2 * p * r, p + r).alias("f1"), "pr_auc", "roc_auc", p.alias("precision"), r.alias("recall"),
                    "tn", "fp", "fn", "tp")


def by_component(components: DataFrame, label: str = "label", parts: Sequence[str] = (*COMPONENTS, "combined")) -> DataFrame:
    """Long form `(component, label, score)`; `combined` is the plain sum unless present."""
    df = components
    if "combined" in parts and "combined" not in df.columns:
        df = df.withColumn("combined", sum((F.col(c) for c in COMPONENTS[1:]), F.col(COMPONENTS[0])))
    return df.select(label, *parts).unpivot([label], list(parts), "component", "score")


def component_auc(components: DataFrame, label: str = "label") -> DataFrame:
    auc = _auc_columns()
    return score_steps(by_component(components, label), ["component"], label=label).groupBy("component").agg(
        auc["average_precision"].alias("pr_auc"), auc["roc_auc"].alias("roc_auc")
    )


def contribution(components: DataFrame, label: str = "label") -> DataFrame:
    """Over true positives: mean share of each component and how often it is the largest.
    On a tie the earlier of structure, node, edge counts."""
    tp = components.where((F.col(label) == 1) & (F.col("pred") == 1))
    total = F.col("structure") + F.col("node") + F.col("edge")
    parts = F.array(*COMPONENTS)
    top = F.array_position(parts, F.array_max(parts))
    share = lambda c: F.avg(F.when(total == 0, F.lit(0.0)).otherwise(100.0 * F.col(c) / total))
    wide = tp.agg(
        F.count(F.lit(1)).alias("true_positives"),
        *[share(c).alias(f"s_{c}") for c in COMPONENTS],
        *[F.count_if(top == i + 1).alias(f"d_{c}") for i, c in enumerate(COMPONENTS)],
    )
    rows = [F.struct(F.lit(c).alias("component"), F.col(f"s_{c}").alias("mean_share_pct"), F.col(f"d_{c}").alias("dominant_count"))
            for c in COMPONENTS]
    return wide.select("true_positives", F.explode(F.array(*rows)).alias("r")).select("true_positives", "r.*")


def missed_summary(components: DataFrame, threshold: float, label: str = "label") -> DataFrame:
    fn = components.where((F.col(label) == 1) & (F.col("pred") == 0))
    return fn.agg(
        F.count(F.lit(1)).alias("missed"), F.lit(float(threshold)).alias("threshold"), F.avg("score").alias("mean_score"),
        *[F.avg(c).alias(f"mean_{c}") for c in COMPONENTS],
    )


def error_distribution(components: DataFrame, label: str = "label", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Box-plot data per component and label: count, mean, extremes and exact quartiles."""
    long = by_component(components, label, COMPONENTS)
    keys = ["component", label]
    stats = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"), F.avg("score").alias("mean"),
                                    F.min("score").alias("min"), F.max("score").alias("max"))
    quart = exact_percentiles(long, keys, "score", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, rows_per_task=rows_per_task)
    return stats.join(quart, keys)


class FitCapture:
    """What the fits of a model really read: order-free counts of their rows, taken while the fits run.

    `watch` hands the rows on and counts them in the same pass; the fit must be an action on what it
    returns. `count` takes a pass of its own, for fits that leave the DataFrame interface."""

    def __init__(self):
        self._watched: list[tuple[str, Observation]] = []
        self._counted: list[tuple] = []

    @staticmethod
    def _measures(label: str) -> list[Column]:
        split = F.coalesce("split", F.lit("unknown"))
        out = []
        for s in (*SPLITS, "unknown"):
            here = split == s if s != "unknown" else ~split.isin(*SPLITS)
            out += [F.count_if(here).alias(f"{s}_rows"), F.count_if(here & (F.col(label) == 1)).alias(f"{s}_anomalous"),
                    F.coalesce(F.sum(F.when(here, F.pmod(F.xxhash64(SESSION), F.lit(1 << 31)))), F.lit(0)).alias(f"{s}_digest")]
        return out

    def watch(self, fit: str, rows: DataFrame, label: str = "label") -> DataFrame:
        """`rows` (session_id, label, split, ...), counted by the first action on the result."""
        seen = Observation(f"{fit}-{uuid.uuid4().hex}")
        self._watched.append((fit, seen))
        return rows.observe(seen, *self._measures(label))

    def count(self, fit: str, rows: DataFrame, label: str = "label") -> DataFrame:
        self._counted.append((fit, rows.agg(*self._measures(label)).first().asDict()))
        return rows

    def table(self, spark: SparkSession) -> DataFrame:
        """fit, split, rows, anomalous, digest: a row per fit and split it read rows of. `digest` is a sum of id
        hashes, so two fits over the same rows have the same digest whatever their order."""
        seen = [(fit, o.get) for fit, o in self._watched] + self._counted
        rows = [(fit, s, m[f"{s}_rows"], m[f"{s}_anomalous"], m[f"{s}_digest"]) for fit, m in seen for s in (*SPLITS, "unknown") if m[f"{s}_rows"]]
        return spark.createDataFrame(rows, "fit string, split string, rows bigint, anomalous bigint, digest bigint")


def leakage_report(ds: DataFrame, fits: DataFrame, mode: str = "clean") -> DataFrame:
    """Check rows on overlaps and split sizes of `ds`, and on what the fits read (see `FitCapture`):
    rows of other splits than train in any fit, and anomalous rows in a clean fit, fail."""
    cols = lambda check, value, status: [check.alias("check"), value.cast("string").alias("value"), status.alias("status")]
    overlap = split_overlap(ds).select(*cols(F.concat(F.lit("overlap_"), "pair"), F.col("shared"), F.col("status")))
    sizes = split_summary(ds).select(*cols(F.concat(F.lit("size_"), "split"), F.col("size"), F.lit("INFO")))
    per = fits.groupBy("fit").agg(F.array_join(F.array_sort(F.collect_set("split")), ",").alias("source"), F.sum("anomalous").alias("k"))
    source = per.select(*cols(F.concat(F.lit("source_"), "fit"), F.col("source"), F.when(F.col("source") == "train", "PASS").otherwise("FAIL")))
    clean = (F.col("k") == 0) | F.lit(mode == "noisy")
    left = per.select(*cols(F.concat(F.lit("anomalies_in_"), "fit"), F.col("k"), F.when(clean, "PASS").otherwise("FAIL")))
    return overlap.unionByName(sizes).unionByName(source).unionByName(left)


def loss_proportions(history: DataFrame) -> DataFrame:
    """Percentage of each component in the total loss per epoch; undefined (null) when the total is 0."""
    total = F.nullif(F.col("structure") + F.col("node") + F.col("edge"), F.lit(0.0))
    return history.withColumns({f"{c}_pct": 100.0 * F.col(c) / total for c in COMPONENTS})
