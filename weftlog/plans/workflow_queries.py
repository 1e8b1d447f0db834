"""The end-to-end flows over the given tables."""

import numpy as np
from pyspark.sql import functions as F

from weftlog.plans import ingest_queries as Q
from weftlog.plans import views as V
from weftlog.plans import workflows as W
from weftlog.plans.registry import query, rounded, s6
from weftlog.session import scratch_path
from weftlog.sources.logs import parse_bgl_lines

# Sessions are the ids of lines that carry one; a label is 1 for every ninth user.
SESSIONS = "u AS (SELECT DISTINCT user_id FROM events WHERE event_id % 7 <> 0)"


def dataset(spark, sf):
    """Raw lines to a dataset in a fresh folder."""
    store = scratch_path(spark, "flow")
    users = V.v_events(spark, sf).where("user_id % 9 = 0")
    labels = users.select("session_id", F.lit(1).alias("label")).distinct()
    meta = W.raw_to_dataset(Q.raw_hdfs(spark, sf), store, "run", labels)
    return store, meta


@query("flow_raw_to_dataset", f"""
    WITH {SESSIONS}, c AS (SELECT count(*) AS n, sum(CASE WHEN user_id % 9 = 0 THEN 1 ELSE 0 END) AS a FROM u)
    SELECT n AS sessions, CAST(a AS BIGINT) AS anomalous, {s6('a / n')} AS anomaly_rate, n - CAST(ceil(round(0.3 * n, 9)) AS BIGINT) AS n_train,
           CAST(floor(ceil(round(0.3 * n, 9)) / 2) AS BIGINT) AS n_val, CAST(ceil(ceil(round(0.3 * n, 9)) / 2) AS BIGINT) AS n_test,
           (SELECT count(*) FROM events) AS lines, CAST(0 AS BIGINT) AS unmatched_lines, (SELECT count(*) FROM events WHERE event_id % 7 = 0) AS unkeyed_lines FROM c""")
def raw_to_dataset(spark, sf):
    _, meta = dataset(spark, sf)
    return rounded(meta, "anomaly_rate").select("sessions", "anomalous", "anomaly_rate", "n_train", "n_val", "n_test",
                                                  "lines", "unmatched_lines", "unkeyed_lines")


def bgl_sql(session: str) -> str:
    return f"""
    WITH u AS (SELECT {session} AS s, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS a FROM v_events GROUP BY 1),
    c AS (SELECT count(*) AS n, sum(a) AS a FROM u)
    SELECT n AS sessions, CAST(a AS BIGINT) AS anomalous, 'line_alerts' AS labels_source, n - CAST(ceil(round(0.3 * n, 9)) AS BIGINT) AS n_train,
           CAST(floor(ceil(round(0.3 * n, 9)) / 2) AS BIGINT) AS n_val, CAST(ceil(ceil(round(0.3 * n, 9)) / 2) AS BIGINT) AS n_test,
           (SELECT count(*) FROM v_events) AS lines, CAST(0 AS BIGINT) AS unmatched_lines, CAST(0 AS BIGINT) AS unkeyed_lines FROM c"""


def bgl_meta(spark, sf, **how):
    meta = W.raw_to_dataset(parse_bgl_lines(V.v_raw_bgl(spark, sf)), scratch_path(spark, "flow"), "run", **how)
    return meta.select("sessions", "anomalous", "labels_source", "n_train", "n_val", "n_test", "lines", "unmatched_lines", "unkeyed_lines")


@query("flow_bgl_windows", bgl_sql("window_id"), ["v_events"])
def bgl_windows(spark, sf):
    return bgl_meta(spark, sf, sessions="window")


@query("flow_bgl_nodes", bgl_sql("node_id"), ["v_events"])
def bgl_nodes(spark, sf):
    """Node sessions, log-scaled features, and a stand-in encoder beside TF-IDF."""
    return bgl_meta(spark, sf, sessions="node_id", scale="log", encode=lambda texts: np.array([[len(t), t.count(" ")] for t in texts], dtype=float))


@query("flow_events_to_decisions", """
    WITH e AS (SELECT session_id || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, level FROM v_events WHERE line_no % 7 <> 0),
    s AS (SELECT session_id, bool_or(level IN ('ERROR', 'WARN')) AS bad, count(*) AS c FROM e GROUP BY 1)
    SELECT session_id, CASE WHEN bad OR c > (SELECT quantile_cont(c, 0.99) FROM s) THEN 'stage1' ELSE 'stage2' END AS stage,
           NOT (bad OR c > (SELECT quantile_cont(c, 0.99) FROM s)) AS scored FROM s""", ["v_events"])
def events_to_decisions(spark, sf):
    """A model of whole blocks decides on the days of each block, cheap rules first."""
    store, _ = dataset(spark, sf)
    report = W.dataset_to_report(spark, f"{store}/run/dataset", store, mode="noisy")
    lines = spark.read.parquet(f"{store}/run/annotated").where("block_id IS NOT NULL")
    day = F.concat("block_id", F.lit("@"), F.to_date("timestamp").cast("string"))
    events = lines.select(day.alias("session_id"), F.col("timestamp").alias("ts"), "line_no", "cluster_id", "parameters")
    out = W.events_to_decisions(events, spark.read.parquet(f"{store}/run/templates"), report.fitted, report.threshold)
    return out.sessions.select("session_id", "stage", F.col("score").isNotNull().alias("scored"))


@query("flow_dataset_to_report")
def dataset_to_report(spark, sf):
    store, _ = dataset(spark, sf)
    report = W.dataset_to_report(spark, f"{store}/run/dataset", store)
    return report.test.withColumn("threshold", F.lit(report.threshold))
