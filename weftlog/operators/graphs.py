"""Session event graphs: nodes, edges, chains, records and message passing."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.functions.columns import clip_nonneg, log_scale, to_number
from weftlog.operators.sessions import (
    CLUSTER, LINE, SESSION, TS, length_stats, session_fingerprint, with_sequence,
)
from weftlog.operators.skew import ROWS_PER_TASK, HotKeys, exact_percentiles, hot_keys, split_hot
from weftlog.session import bucketed, durable

# The features of a node and of an edge, in the order of the packed vectors.
NODE_SCALARS = [
    "occurrence_count", "param_count", "param_num_mean", "param_num_max",
    "first_pos", "last_pos", "mean_pos", "std_pos", "pos_spread",
]
EDGE_SCALARS = [
    "weight", "td_min", "td_p25", "td_median", "td_p75", "td_max", "td_std",
    "mean_src_pos", "mean_dst_pos", "mean_pos_delta",
]


@dataclass(frozen=True)
class OrderedRun:
    """Events in session order, stored once: `rows` is dealt by session, so that grouping it by session, or by
    session and more, moves nothing; `hot` has the rows of sessions too long for that (None: there are none)."""

    rows: DataFrame
    hot: DataFrame | None = None

    def parts(self) -> list[tuple[DataFrame, bool]]:
        return [(self.rows, False)] + ([(self.hot, True)] if self.hot is not None else [])


def ordered_run(events: DataFrame, scale: str = "raw", *, session: str = SESSION, ts: str = TS, line: str = LINE, cluster: str = CLUSTER,
                params: str = "parameters", rows_per_task: int = ROWS_PER_TASK) -> OrderedRun:
    """The run that `graph_nodes`, `graph_edges` and the other operators of this module read: positions, next
    event, delta and parameter numbers of every event. Events are read, moved and ordered once.

    `scale` must be that of the operators that read the run."""
    names = dict(session=session, ts=ts, line=line, cluster=cluster)
    keep = [c for c in (session, ts, line, cluster, params) if c in events.columns]
    slim = events.select(*keep)
    if params in keep:
        slim = with_param_stats(slim, params, finite_only=scale == "log")
    hot = hot_keys(slim, [session], rows_per_task)
    cols = [session, cluster, "pos", "n", "norm_pos", f"next_{cluster}", "delta_us", *[c for c in ("param_count", "num_count", "num_sum", "num_max") if c in slim.columns]]
    if not hot:
        return OrderedRun(bucketed(with_sequence(slim, hot=hot, **names).select(*cols), session, buckets=hot.parts()))
    rest, part = split_hot(slim, [session], hot)
    long = with_sequence(part, hot_rows=hot.rows, rows_per_task=rows_per_task, **names).select(*cols)
    return OrderedRun(bucketed(with_sequence(rest, hot=hot.rest(), **names).select(*cols), session, buckets=hot.parts()), durable(long))


def _of_run(run: OrderedRun, fn) -> DataFrame:
    """`fn(rows, hot)` of both parts of a run; no session is in both."""
    return reduce(DataFrame.unionByName, [fn(rows, hot) for rows, hot in run.parts()])


def _sequenced(events: DataFrame, rows_per_task: int, **names) -> DataFrame:
    if "delta_us" in events.columns:
        return events
    return with_sequence(events, rows_per_task=rows_per_task, **names)


def with_param_stats(df: DataFrame, params: str = "parameters", finite_only: bool = False) -> DataFrame:
    """Replace the parameter array by its size and the count, sum and max of its numbers.

    Done in the row, before any shuffle, so that four numbers travel instead of texts."""
    nums = F.filter(F.transform(params, lambda x: to_number(x, finite_only)), lambda x: x.isNotNull())
    none = F.array().cast("array<double>")
    df = df.withColumn("__nums", F.coalesce(nums, none)).withColumn("__params", F.greatest(F.size(params), F.lit(0)))
    return df.drop(params).select(
        *[c for c in df.columns if c not in (params, "__nums", "__params")], F.col("__params").alias("param_count"),
        F.size("__nums").alias("num_count"), F.aggregate("__nums", F.lit(0.0), lambda a, x: a + x).alias("num_sum"),
        F.array_max("__nums").alias("num_max"),
    )


def param_summary(df: DataFrame, params: str = "parameters", finite_only: bool = False) -> DataFrame:
    """`param_count`, `param_num_mean`, `param_num_max` of each row's array; 0 when nothing is numeric."""
    has = F.col("num_count") > 0
    return with_param_stats(df, params, finite_only).withColumns({
        "param_num_mean": F.when(has, F.col("num_sum") / F.col("num_count")).otherwise(F.lit(0.0)),
        "param_num_max": F.when(has, F.col("num_max")).otherwise(F.lit(0.0)),
    }).drop("num_count", "num_sum", "num_max")


def graph_nodes(
    events: DataFrame | OrderedRun, scale: str = "raw", *, session: str = SESSION, ts: str = TS, line: str = LINE,
    cluster: str = CLUSTER, params: str = "parameters", rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
) -> DataFrame:
    """One node per (session, cluster) with occurrence, parameter and position features, from events or a run.

    Parameters are reduced inside each row first, so nothing is exploded and the
    shuffle carries numbers only. Positions are summed as doubles, which is exact
    while the sum stays below 2^53 and cannot overflow beyond. `scale='log'` compresses the first four.
    """
    if isinstance(events, OrderedRun):
        return _of_run(events, lambda rows, _: _nodes(rows, scale, session, cluster))
    keep = [c for c in (session, ts, line, cluster, params, "pos", "n", "norm_pos", "delta_us") if c in events.columns]
    slim = with_param_stats(events.select(*keep), params, finite_only=scale == "log")
    rows = _sequenced(slim, rows_per_task, session=session, ts=ts, line=line, cluster=cluster, hot=hot)
    return _nodes(rows, scale, session, cluster)


def _nodes(rows: DataFrame, scale: str, session: str, cluster: str) -> DataFrame:
    span = F.greatest(F.first("n") - 1, F.lit(1))
    has = F.sum("num_count") > 0
    nodes = rows.groupBy(session, cluster).agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.sum("param_count").alias("param_count"),
        F.when(has, F.sum("num_sum") / F.sum("num_count")).otherwise(F.lit(0.0)).alias("param_num_mean"),
        F.when(has, F.max("num_max")).otherwise(F.lit(0.0)).alias("param_num_max"),
        (F.min("pos") / span).alias("first_pos"),
        (F.max("pos") / span).alias("last_pos"),
        (F.sum(F.col("pos").cast("double")) / (F.count(F.lit(1)).cast("double") * span)).alias("mean_pos"),
        F.stddev_pop("norm_pos").alias("std_pos"),
        ((F.max("pos") - F.min("pos")) / span).alias("pos_spread"),
    )
    if scale == "raw":
        return nodes
    return nodes.withColumns({c: log_scale(c) for c in NODE_SCALARS[:4]})


def graph_edges(
    events: DataFrame | OrderedRun, scale: str = "raw", *, session: str = SESSION, ts: str = TS, line: str = LINE,
    cluster: str = CLUSTER, rows_per_task: int = ROWS_PER_TASK, hot: HotKeys | None = None,
) -> DataFrame:
    """One edge per (session, src, dst) with weight, delta statistics and mean positions, from events or a run.

    Deltas are whole microseconds until the last step, which keeps the percentiles
    exact. `scale='log'` clips negative deltas first and log-scales weight and deltas.
    """
    if isinstance(events, OrderedRun):
        return _of_run(events, lambda rows, long: _edges(rows, scale, long, session, cluster, rows_per_task))
    # An edge group cannot outgrow its session, so one look at the sessions is enough.
    hot = hot_keys(events, [session], rows_per_task) if hot is None else hot
    names = dict(session=session, ts=ts, line=line, cluster=cluster)
    if not hot or "delta_us" in events.columns:
        rows = _sequenced(events, rows_per_task, hot=hot, **names)
        return _edges(rows, scale, bool(hot), session, cluster, rows_per_task)
    rest, part = split_hot(events, [session], hot)
    few = hot.rows
    cold_rows = with_sequence(rest, hot=hot.rest(), **names)
    hot_rows = with_sequence(part, hot_rows=few, rows_per_task=rows_per_task, **names)
    return _edges(cold_rows, scale, False, session, cluster, rows_per_task).unionByName(
        _edges(hot_rows, scale, True, session, cluster, rows_per_task))


def _edges(rows: DataFrame, scale: str, hot: bool, session: str, cluster: str, rows_per_task: int) -> DataFrame:
    delta = F.col("delta_us") if scale == "raw" else clip_nonneg("delta_us")
    pairs = rows.where(F.col("pos") < F.col("n") - 1).select(
        session, F.col(cluster).alias("src"), F.col(f"next_{cluster}").alias("dst"),
        "pos", "n", delta.alias("delta_us"),
    )
    keys = [session, "src", "dst"]
    cnt, span = F.count(F.lit(1)), F.greatest(F.first("n") - 1, F.lit(1))
    aggs = [
        cnt.alias("weight"),
        F.min("delta_us").alias("td_min"), F.max("delta_us").alias("td_max"),
        F.stddev_pop("delta_us").alias("td_std"),
        (F.sum(F.col("pos").cast("double")) / (cnt.cast("double") * span)).alias("mean_src_pos"),
        (F.sum(F.col("pos") + F.lit(1.0)) / (cnt.cast("double") * span)).alias("mean_dst_pos"),
        (F.lit(1.0) / span).alias("mean_pos_delta"),
    ]
    quart = F.percentile("delta_us", [0.25, 0.5, 0.75]).alias("__q")
    probs = {"td_p25": 0.25, "td_median": 0.5, "td_p75": 0.75}
    if not hot:
        edges = pairs.groupBy(*keys).agg(*aggs, quart)
        edges = edges.withColumns({c: F.col("__q")[i] for i, c in enumerate(probs)})
    else:
        # `percentile` would hold every distinct delta of a hot edge in one task.
        quarts = exact_percentiles(pairs, keys, "delta_us", probs, rows_per_task=rows_per_task)
        edges = pairs.groupBy(*keys).agg(*aggs).join(quarts, keys, "left")
    seconds = {}
    for c in EDGE_SCALARS[1:7]:
        value = F.col(c) / F.lit(1e6)
        missing = F.lit(0.0) if scale == "log" or c == "td_std" else F.lit(-1.0)
        value = value if scale == "raw" else log_scale(value)
        seconds[c] = F.coalesce(value, missing)
    if scale == "log":
        seconds["weight"] = log_scale("weight")
    return edges.withColumns(seconds).select(*keys, *EDGE_SCALARS)


def graph_edges_basic(events: DataFrame | OrderedRun, *, session: str = SESSION, cluster: str = CLUSTER,
                      rows_per_task: int = ROWS_PER_TASK, **names) -> DataFrame:
    if isinstance(events, OrderedRun):
        return _of_run(events, lambda rows, _: graph_edges_basic(rows, session=session, cluster=cluster))
    rows = _sequenced(events, rows_per_task, session=session, cluster=cluster, **names)
    pairs = rows.where(F.col("pos") < F.col("n") - 1)
    return pairs.groupBy(session, F.col(cluster).alias("src"), F.col(f"next_{cluster}").alias("dst")).agg(
        F.count(F.lit(1)).alias("weight"),
        F.coalesce(F.avg("delta_us") / F.lit(1e6), F.lit(-1.0)).alias("time_delta_s"),
        F.coalesce(F.stddev_pop("delta_us") / F.lit(1e6), F.lit(0.0)).alias("time_delta_std"),
    )


def event_chain(events: DataFrame | OrderedRun, *, session: str = SESSION, cluster: str = CLUSTER,
                rows_per_task: int = ROWS_PER_TASK, **names) -> DataFrame:
    """One node per line; each row also carries the chain edge to its successor."""
    if isinstance(events, OrderedRun):
        return _of_run(events, lambda rows, _: event_chain(rows, session=session, cluster=cluster))
    rows = _sequenced(events, rows_per_task, session=session, cluster=cluster, **names)
    has_next = F.col("pos") < F.col("n") - 1
    return rows.select(
        session, F.col("pos").alias("node"), cluster,
        F.when(has_next, F.col("pos") + 1).alias("next_node"),
        F.when(has_next, F.coalesce(F.col("delta_us") / F.lit(1e6), F.lit(-1.0))).alias("time_delta_s"),
    )


def graph_sizes(events: DataFrame | OrderedRun, *, session: str = SESSION, cluster: str = CLUSTER,
                rows_per_task: int = ROWS_PER_TASK, **names) -> DataFrame:
    """Nodes and edges of the collapsed and of the chain form, per session."""
    if isinstance(events, OrderedRun):
        return _of_run(events, lambda rows, _: graph_sizes(rows, session=session, cluster=cluster))
    rows = _sequenced(events, rows_per_task, session=session, cluster=cluster, **names)
    pairs = rows.groupBy(session, cluster, f"next_{cluster}").agg(
        F.count(F.lit(1)).alias("c"), F.count_if(F.col("pos") < F.col("n") - 1).alias("w")
    )
    per = pairs.groupBy(session, cluster).agg(F.sum("c").alias("c"), F.count_if(F.col("w") > 0).alias("e"))
    return per.groupBy(session).agg(
        F.sum("c").alias("seq_len"), F.count(F.lit(1)).alias("collapsed_nodes"),
        F.sum("e").alias("collapsed_edges"), F.sum("c").alias("chain_nodes"),
        (F.sum("c") - 1).alias("chain_edges"),
    )


def edges_to_index(node_index: DataFrame, edges: DataFrame, *, session: str = SESSION,
                   cluster: str = CLUSTER) -> DataFrame:
    """Replace cluster ids of edges by local node indexes (see `first_seen_index`)."""
    src = node_index.select(session, F.col(cluster).alias("src"), F.col("node_idx").alias("src_idx"))
    dst = node_index.select(session, F.col(cluster).alias("dst"), F.col("node_idx").alias("dst_idx"))
    return edges.join(src, [session, "src"]).join(dst, [session, "dst"])


def graph_records(
    nodes: DataFrame, edges: DataFrame, labels: DataFrame | None = None, *,
    embedding: str | None = None, session: str = SESSION, cluster: str = CLUSTER,
) -> DataFrame:
    """One packed row per session: node matrix, edge index, edge matrix and label.

    Groups are already merged by cluster, so a row is bounded by the template
    catalog, not by the session length. Nodes stand in the order of their first
    position, and the edge index is looked up in that short list instead of by a
    join. Sessions without edges keep empty arrays.
    """
    scalars = F.array(*[F.col(c).cast("double") for c in NODE_SCALARS])
    x = F.concat(F.col(embedding), scalars) if embedding else scalars
    node = F.struct("first_pos", F.col(cluster).alias("cid"), x.alias("x"))
    packed_nodes = nodes.groupBy(session).agg(F.array_sort(F.collect_list(node)).alias("__n")).select(
        session, F.col("__n.cid").alias("cluster_ids"), F.col("__n.x").alias("x"), F.size("__n").alias("num_nodes")
    )
    attr = F.array(*[F.col(c).cast("double") for c in EDGE_SCALARS])
    packed_edges = edges.groupBy(session).agg(F.collect_list(F.struct("src", "dst", attr.alias("a"))).alias("__e"))
    rows = packed_nodes.join(packed_edges, session, "left")
    local = F.transform(
        "__e", lambda e: F.struct(
            (F.array_position("cluster_ids", e["src"]) - 1).alias("s"),
            (F.array_position("cluster_ids", e["dst"]) - 1).alias("d"), e["a"].alias("a"),
        ))
    rows = rows.withColumn("__e", F.array_sort(local))
    none = F.array().cast("array<bigint>")
    out = rows.select(
        session, "cluster_ids", "x", "num_nodes",
        F.coalesce(F.col("__e.s"), none).alias("edge_src"), F.coalesce(F.col("__e.d"), none).alias("edge_dst"),
        F.coalesce(F.col("__e.a"), F.array().cast("array<array<double>>")).alias("edge_attr"),
        F.coalesce(F.size("__e"), F.lit(0)).alias("num_edges"),
    ).withColumn("num_edges", F.greatest("num_edges", F.lit(0)))
    if labels is None:
        return out
    return out.join(labels, session, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def session_graphs(events: DataFrame, scale: str = "raw", *, session: str = SESSION, ts: str = TS, line: str = LINE,
                   cluster: str = CLUSTER, rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one stored run: neither grouping moves an event again."""
    run = ordered_run(events, scale, session=session, ts=ts, line=line, cluster=cluster, rows_per_task=rows_per_task)
    names = dict(session=session, cluster=cluster, rows_per_task=rows_per_task)
    return graph_nodes(run, scale, **names), graph_edges(run, scale, **names)


def canonical_graphs(events: DataFrame, *, session: str = SESSION, ts: str = TS, line: str = LINE,
                     cluster: str = CLUSTER, rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """(representatives, their events): one session stands for each fingerprint."""
    fps = session_fingerprint(events, session=session, ts=ts, line=line, cluster=cluster,
                              rows_per_task=rows_per_task)
    reps = fps.groupBy("fingerprint").agg(
        F.min(session).alias(session), F.count(F.lit(1)).alias("sessions"),
    )
    return reps, events.join(reps.select(session), session, "left_semi")


def reduction_ratio(representatives: DataFrame) -> DataFrame:
    return representatives.agg(
        F.sum("sessions").alias("sessions"), F.count(F.lit(1)).alias("canonical"),
        (F.sum("sessions") / F.count(F.lit(1))).alias("reduction"),
    )


def node_edge_stats(nodes: DataFrame, edges: DataFrame, session: str = SESSION) -> DataFrame:
    """Sequence length, node and edge count per session. Each side is merged before
    the join, so no session multiplies its nodes by its edges."""
    a = nodes.groupBy(session).agg(
        F.sum("occurrence_count").alias("seq_len"), F.count(F.lit(1)).alias("n_nodes")
    )
    b = edges.groupBy(session).agg(F.count(F.lit(1)).alias("n_edges"))
    return a.join(b, session, "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def graph_distribution(stats: DataFrame) -> DataFrame:
    """describe() and percentiles of seq_len, n_nodes and n_edges, one row each."""
    return length_stats(stats, ["seq_len", "n_nodes", "n_edges"], (25, 50, 75, 90, 95, 99))


def longest_sessions(nodes: DataFrame, k: int, session: str = SESSION) -> DataFrame:
    totals = nodes.groupBy(session).agg(F.sum("occurrence_count").alias("events"))
    return totals.orderBy(F.desc("events"), session).limit(k)


def compare_graph_stores(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame],
                         session: str = SESSION) -> DataFrame:
    """Node and edge counts of two stores side by side: match, mismatch or missing."""
    def counts(pair, tag):
        s = node_edge_stats(*pair, session=session)
        return s.select(session, F.col("n_nodes").alias(f"nodes_{tag}"), F.col("n_edges").alias(f"edges_{tag}"))

    both = counts(a, "a").join(counts(b, "b"), session, "full")
    same = (F.col("nodes_a") == F.col("nodes_b")) & (F.col("edges_a") == F.col("edges_b"))
    absent = F.col("nodes_a").isNull() | F.col("nodes_b").isNull()
    status = F.when(absent, "missing").when(same, "match").otherwise("mismatch")
    return both.withColumn("status", status)


def neighbor_aggregate(nodes: DataFrame, edges: DataFrame, agg: str = "sum", eps: float = 0.0, *,
                       session: str = SESSION, cluster: str = CLUSTER, h: str = "h", e: str = "e") -> DataFrame:
    """One message pass: aggregate of relu(h_src + e) per destination, plus (1 + eps) * h_dst.

    Messages are summed by the built-in vector summarizer, which combines on the
    map side; no vector is exploded into rows."""
    src = nodes.select(session, F.col(cluster).alias("src"), F.col(h).alias("__h"))
    relu = F.zip_with("__h", e, lambda a, b: F.greatest(a + b, F.lit(0.0)))
    messages = edges.join(src, [session, "src"]).select(
        session, F.col("dst").alias(cluster), array_to_vector(relu).alias("m")
    )
    metric = {"sum": Summarizer.sum, "mean": Summarizer.mean, "max": Summarizer.max}[agg]
    pooled = messages.groupBy(session, cluster).agg(vector_to_array(metric(F.col("m"))).alias("__m"))
    joined = nodes.join(pooled, [session, cluster], "left")
    zero = F.transform(h, lambda x: F.lit(0.0))
    out = F.zip_with(F.coalesce("__m", zero), h, lambda m, x: m + x * F.lit(1.0 + eps))
    return joined.select(session, cluster, out.alias("h"))


# A prime larger than any per-session node-pair count in reach, used as a stride.
_STRIDE = 1_000_000_007


def negative_edges(nodes: DataFrame, edges: DataFrame, seed: int = 42, *, session: str = SESSION,
                   cluster: str = CLUSTER) -> DataFrame:
    """As many non-edges as edges per session, without listing all node pairs.

    The m = k(k-1) ordered pairs of k distinct nodes are numbered and walked with a
    stride coprime to m from a seeded start. Among the first 2e numbers at most e
    are edges, so e non-edges (or all there are) always turn up.
    """
    # A session has at most as many nodes as there are templates.
    rank = F.row_number().over(Window.partitionBy(session).orderBy(cluster))
    index = nodes.select(session, cluster, (rank - 1).cast("bigint").alias("node_idx"))
    named = index.groupBy(session).agg(
        F.array_sort(F.collect_list(F.struct("node_idx", cluster)))[cluster].alias("ids")
    )
    k = F.size("ids").cast("bigint")
    code = F.col("src_idx") * (k - 1) + F.when(F.col("dst_idx") > F.col("src_idx"), F.col("dst_idx") - 1).otherwise(F.col("dst_idx"))
    taken = (
        edges_to_index(index, edges, session=session, cluster=cluster)
        .join(named, session)
        .groupBy(session)
        .agg(F.count(F.lit(1)).alias("e"),
             F.collect_list(F.when(F.col("src_idx") != F.col("dst_idx"), code)).alias("used"))
    )
    m = k * (k - 1)
    # 60 bits of a digest, which other engines can follow.
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(session).cast("string")))
    start = F.pmod(F.conv(F.left(digest, F.lit(15)), 16, 10).cast("bigint"), F.greatest(m, F.lit(1)))
    walk = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.least(m, F.col("e") * 2) - 1),
        lambda i: F.pmod(start + i * F.lit(_STRIDE), m),
    )
    rows = named.join(taken, session).where(m > 0)
    free = F.slice(F.array_except(walk, F.col("used")), F.lit(1), F.col("e").cast("int"))
    picked = rows.select(session, "ids", k.alias("k"), F.explode(free).alias("code"))
    i = F.floor(F.col("code") / (F.col("k") - 1)).cast("int")
    r = F.pmod(F.col("code"), F.col("k") - 1).cast("int")
    j = F.when(r >= i, r + 1).otherwise(r)
    return picked.select(session, F.col("ids")[i].alias("src"), F.col("ids")[j].alias("dst"))
