"""Labels, splits, padded sequences, scaling, stage-1 flags and data checks."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.functions.columns import truncate_pad
from weftlog.operators.lookups import attach_label, error_clusters, flag_error_sessions
from weftlog.operators.sessions import CLUSTER, LINE, SESSION, TS, length_percentiles, length_stats, with_position
from weftlog.operators.skew import ROWS_PER_TASK, ordered
from weftlog.session import durable

SPLITS = ["train", "val", "test"]


def resolve_labels(events: DataFrame, labels: DataFrame | None = None, catalog: DataFrame | None = None, *,
                   session: str = SESSION, cluster: str = CLUSTER) -> DataFrame:
    """Ground truth when given, otherwise 1 for sessions holding an error template."""
    sessions = events.select(session).distinct()
    if labels is not None:
        return attach_label(sessions, labels, session).withColumn("labels_source", F.lit("ground_truth"))
    bad = flag_error_sessions(events, error_clusters(catalog, cluster), session=session, cluster=cluster)
    flagged = attach_label(sessions, bad.withColumn("label", F.lit(1)), session)
    return flagged.withColumns({"label_defaulted": F.lit(False), "labels_source": F.lit("heuristic")})


def largest_remainder(counts: dict[int, int], draws: int) -> dict[int, int]:
    """Whole class quotas summing to `draws`, proportional to the class counts."""
    total = sum(counts.values())
    exact = {c: k * draws / total for c, k in counts.items()}
    quota = {c: math.floor(v) for c, v in exact.items()}
    rest = draws - sum(quota.values())
    for c in sorted(exact, key=lambda c: (quota[c] - exact[c], c))[:rest]:
        quota[c] += 1
    return quota


def split_sizes(n: int, holdout: float = 0.30, test_share: float = 0.50) -> tuple[int, int, int]:
    """(train, val, test): both cuts round the later part up."""
    rest = math.ceil(round(holdout * n, 9))
    test = math.ceil(round(test_share * rest, 9))
    return n - rest, rest - test, test


def stratified_split(ds: DataFrame, holdout: float = 0.30, test_share: float = 0.50, seed: int = 42, *,
                     session: str = SESSION, label: str = "label", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add `split` with exact sizes overall and per class.

    Only the class counts reach the driver. Rows are ranked inside their class by a
    seeded hash of the id, so the assignment does not depend on partitioning."""
    ds = durable(ds)  # read twice below, and smaller than the events it comes from
    counts = {r[0]: r[1] for r in ds.groupBy(label).count().collect()}
    train, val, test = split_sizes(sum(counts.values()), holdout, test_share)
    q_train = largest_remainder(counts, train)
    left = {c: counts[c] - q_train[c] for c in counts}
    q_val = largest_remainder(left, val) if val + test else {c: 0 for c in counts}
    keyed = ds.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(session).cast("string"))))
    ranked = ordered(keyed, [label], ["__h", session], rows_per_task=rows_per_task)

    def quota(q: dict[int, int]) -> Column:
        out = F.lit(0).cast("bigint")
        for c, k in q.items():
            out = F.when(F.col(label) == c, F.lit(k)).otherwise(out)
        return out

    first, second = quota(q_train), quota({c: q_train[c] + q_val[c] for c in counts})
    split = F.when(F.col("pos") < first, "train").when(F.col("pos") < second, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("__h", "pos", "n")


def split_summary(ds: DataFrame, label: str = "label") -> DataFrame:
    return ds.groupBy("split").agg(
        F.count(F.lit(1)).alias("size"), F.sum(label).cast("bigint").alias("anomalous"),
        (100.0 * F.avg(label)).alias("anomaly_pct"),
    )


def split_overlap(ds: DataFrame, session: str = SESSION) -> DataFrame:
    """Ids shared by each pair of splits. One pass: an id carries a flag per split."""
    flags = ds.groupBy(session).agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS])
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    counts = flags.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs])
    stack = ", ".join(f"'{a}_{b}', {a}_{b}" for a, b in pairs)
    out = counts.selectExpr(f"stack(3, {stack}) AS (pair, shared)")
    return out.withColumn("status", F.when(F.col("shared") == 0, "PASS").otherwise("FAIL"))


def shared_lines(windowed: DataFrame, split: DataFrame, *, window: str = "window_id", line: str = LINE) -> DataFrame:
    """Lines that overlapping windows carry into more than one split."""
    rows = windowed.select(window, line).join(split.select(window, "split"), window)
    per = rows.groupBy(line).agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS])
    return per.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("train") + F.col("val") + F.col("test") > 1).alias("shared_lines"),
    )


def clean_train(ds: DataFrame, mode: str = "clean", label: str = "label") -> DataFrame:
    train = ds.where(F.col("split") == "train")
    return train if mode == "noisy" else train.where(F.col(label) == 0)


def choose_max_len(lengths: DataFrame, col: str = "seq_len") -> DataFrame:
    """`max_len` is the 99th percentile cut to a whole number."""
    stats = length_stats(lengths, [col], (50, 95, 99)).select("p50", "p95", "p99", "min", "mean", "max")
    return stats.withColumn("max_len", F.floor("p99").cast("int"))


def padded_sequences(events: DataFrame, max_len: int, labels: DataFrame | None = None, pad: int = -1, *,
                     session: str = SESSION, ts: str = TS, line: str = LINE, cluster: str = CLUSTER,
                     rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """First `max_len` ids of each session, padded on the right. Later events are
    dropped before packing, so a row never exceeds `max_len` whatever the session."""
    rows = with_position(events, session=session, ts=ts, line=line, rows_per_task=rows_per_task)
    packed = rows.where(F.col("pos") < max_len).groupBy(session).agg(
        F.array_sort(F.collect_list(F.struct("pos", cluster)))[cluster].alias("__c"),
        F.least(F.first("n"), F.lit(max_len)).cast("int").alias("length"),
    )
    out = packed.select(session, truncate_pad("__c", max_len, pad).alias("cids"), "length")
    return out if labels is None else attach_label(out, labels, session)


def align_split(sequences: DataFrame, split: DataFrame, session: str = SESSION) -> DataFrame:
    return sequences.join(split.select(session, "split"), session)


# --- scaling ----------------------------------------------------------------


def fit_scaler(vectors: DataFrame, floor: float = 0.1, vec: str = "vec") -> DataFrame:
    """One row: per-dimension mean and sample std with a floor, and how many were floored.

    The vector summarizer combines on the map side; nothing is exploded."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    s = vectors.select(Summarizer.metrics("mean", "std", "count").summary(v).alias("s"))
    std = vector_to_array("s.std")
    return s.select(
        vector_to_array("s.mean").alias("mean"),
        F.transform(std, lambda x: F.greatest(x, F.lit(floor))).alias("std"),
        F.size(F.filter(std, lambda x: x < floor)).alias("floored"), F.col("s.count").alias("rows"),
    )


def apply_scaler(df: DataFrame, stats: DataFrame, vec: str = "vec") -> DataFrame:
    """(x - mean) / std with the one row of `fit_scaler`, carried as constants."""
    row = stats.select("mean", "std").first()
    mean = F.lit([float(x) for x in row["mean"]])
    std = F.lit([float(x) for x in row["std"]])
    centred = F.zip_with(F.col(vec).cast("array<double>"), mean, lambda x, m: x - m)
    return df.withColumn(vec, F.zip_with(centred, std, lambda x, s: x / s))


def fit_batch_norm(vectors: DataFrame, eps: float = 1e-5, vec: str = "vec") -> DataFrame:
    """Affine-free batch standardisation: population variance plus eps, in `apply_scaler` form."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    s = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s"))
    n = F.col("s.count")
    shrink = F.when(n > 1, (n - 1) / n).otherwise(F.lit(0.0))
    return s.select(
        vector_to_array("s.mean").alias("mean"),
        F.transform(vector_to_array("s.variance"), lambda x: F.sqrt(x * shrink + F.lit(eps))).alias("std"),
        n.alias("rows"),
    )


# --- checks -----------------------------------------------------------------


def stage1_flags(events: DataFrame, catalog: DataFrame, lengths: DataFrame, *, session: str = SESSION,
                 cluster: str = CLUSTER) -> DataFrame:
    """Sessions decided by cheap rules: an error template, or a length over the 99th percentile."""
    p99 = length_percentiles(lengths, (99,)).first()[0]
    errors = flag_error_sessions(events, error_clusters(catalog, cluster), session=session, cluster=cluster)
    long = lengths.where(F.col("seq_len") > p99).select(session)
    both = errors.withColumn("by_error", F.lit(1)).withColumn("by_length", F.lit(0)).unionByName(
        long.withColumn("by_error", F.lit(0)).withColumn("by_length", F.lit(1))
    )
    return both.groupBy(session).agg(F.max("by_error").alias("by_error"), F.max("by_length").alias("by_length"))


def stage1_summary(lengths: DataFrame, flags: DataFrame, session: str = SESSION) -> DataFrame:
    rows = lengths.select(session).join(flags, session, "left")
    return rows.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(F.coalesce("by_error", F.lit(0))).alias("by_error"),
        F.sum(F.coalesce("by_length", F.lit(0))).alias("by_length"),
        F.count("by_error").alias("flagged"), F.count_if(F.col("by_error").isNull()).alias("remaining"),
    )


def data_sanity(nodes: DataFrame, edges: DataFrame, *, session: str = SESSION, vec: str = "vec",
                strict: bool = True) -> DataFrame:
    """Sessions with non-finite node or edge features, and sessions without edges."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    a = nodes.groupBy(session).agg(F.bool_or(bad).alias("bad_nodes"))
    b = edges.groupBy(session).agg(F.bool_or(bad).alias("bad_edges"))
    rows = a.join(b, session, "left")
    out = rows.agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("bad_nodes").alias("bad_node_sessions"),
        F.count_if(F.coalesce("bad_edges", F.lit(False))).alias("bad_edge_sessions"),
        F.count_if(F.col("bad_edges").isNull()).alias("zero_edge_sessions"),
        (100.0 * F.count_if(F.col("bad_edges").isNull()) / F.count(F.lit(1))).alias("zero_edge_pct"),
    )
    if strict:
        row = out.first()
        if row["bad_node_sessions"] or row["bad_edge_sessions"]:
            raise ValueError(f"non-finite features: {row.asDict()}")
    return out


def dataset_meta(ds: DataFrame, max_seq_len: int, embed_dim: int, labels_source: str = "ground_truth",
                 label: str = "label", node_scalars: int = 9, edge_dim: int = 10, *, n_templates: int | None = None,
                 seed: int = 42, run_tag: str | None = None) -> DataFrame:
    """One row describing the dataset: totals, rates, dimensions, sizes and anomalies of the splits, and its origin."""
    return ds.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum(label).cast("bigint").alias("anomalous"),
        F.avg(label).alias("anomaly_rate"),
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS],
        *[F.count_if((F.col("split") == s) & (F.col(label) == 1)).alias(f"anomalous_{s}") for s in SPLITS],
    ).withColumns({
        "n_templates": F.lit(n_templates).cast("bigint"), "seed": F.lit(seed), "run_tag": F.lit(run_tag).cast("string"),
        "labels_source": F.lit(labels_source), "max_seq_len": F.lit(max_seq_len), "embed_dim": F.lit(embed_dim),
        "node_dim": F.lit(embed_dim + node_scalars), "edge_dim": F.lit(edge_dim),
    })
