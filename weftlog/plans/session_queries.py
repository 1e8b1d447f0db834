"""Queries over sessions, windows, orderings and session graphs."""

from pyspark.sql import functions as F

from weftlog.operators import graphs as G
from weftlog.operators import lookups as J
from weftlog.operators import sessions as K
from weftlog.plans import views as V
from weftlog.plans.registry import joined, query, r6, rounded, s6

NODE_OUT = G.NODE_SCALARS
EDGE_OUT = G.EDGE_SCALARS


def seq_sql(view: str, name: str = "seq", delta: str = "epoch_us(lead(ts) OVER w) - epoch_us(ts)") -> str:
    return f"""{name} AS (
        SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY session_id) AS n,
               lead(cluster_id) OVER w AS next_cluster_id, {delta} AS delta_us
        FROM {view} WINDOW w AS (PARTITION BY session_id ORDER BY ts, line_no))"""


NUMBER = r"CASE WHEN regexp_full_match(x, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*') THEN CAST(trim(x) AS DOUBLE) END"


def nodes_sql(view: str, scale: str = "raw") -> str:
    nums = f"[y FOR y IN [{NUMBER} FOR x IN parameters] IF y IS NOT NULL]"
    log = (lambda e: f"ln(1 + abs({e}))") if scale == "log" else (lambda e: e)
    first4 = ["CAST(count(*) AS DOUBLE)", "CAST(sum(len(parameters)) AS DOUBLE)",
              "coalesce(sum(list_sum(nums)) / sum(len(nums)), 0)", "coalesce(max(list_max(nums)), 0)"]
    span = "greatest(max(n) - 1, 1)"
    rest = [f"min(pos) / {span}", f"max(pos) / {span}", f"sum(pos) / (count(*) * {span})",
            f"stddev_pop(pos / greatest(n - 1, 1))", f"(max(pos) - min(pos)) / {span}"]
    cols = [s6(log(e)) for e in first4] + [s6(f"CAST({e} AS DOUBLE)") for e in rest]
    out = ", ".join(f"{e} AS {c}" for e, c in zip(cols, NODE_OUT))
    return f"""nodes AS (SELECT session_id, cluster_id, {out}
        FROM (SELECT *, {nums} AS nums FROM seq) GROUP BY session_id, cluster_id)"""


def edges_sql(scale: str = "raw") -> str:
    d = "delta_us" if scale == "raw" else "CASE WHEN delta_us IS NOT NULL THEN greatest(delta_us, 0) END"
    miss = (lambda c: "0" if scale == "log" or c == "td_std" else "-1")
    log = (lambda e: f"ln(1 + abs({e}))") if scale == "log" else (lambda e: e)
    span = "greatest(max(n) - 1, 1)"
    td = {"td_min": "min(d)", "td_p25": "quantile_cont(d, 0.25)", "td_median": "quantile_cont(d, 0.5)",
          "td_p75": "quantile_cont(d, 0.75)", "td_max": "max(d)", "td_std": "stddev_pop(d)"}
    cols = [s6(log("CAST(count(*) AS DOUBLE)")) + " AS weight"]
    cols += [s6(f"coalesce({log(e + ' / 1e6')}, {miss(c)})") + f" AS {c}" for c, e in td.items()]
    cols += [s6(f"sum(pos) / (count(*) * {span})") + " AS mean_src_pos",
             s6(f"sum(pos + 1) / (count(*) * {span})") + " AS mean_dst_pos", s6(f"1.0 / {span}") + " AS mean_pos_delta"]
    return f"""edges AS (SELECT session_id, cluster_id AS src, next_cluster_id AS dst, {', '.join(cols)}
        FROM (SELECT *, CAST({d} AS DOUBLE) AS d FROM seq WHERE pos < n - 1) GROUP BY 1, 2, 3)"""


FPS = """fps AS (
    SELECT session_id, count(*) AS n, md5(string_agg(CAST(cluster_id AS VARCHAR), '|' ORDER BY ts, line_no)) AS fingerprint,
           string_agg(CASE WHEN pos < 8 THEN CAST(cluster_id AS VARCHAR) END, ',' ORDER BY ts, line_no) AS head
    FROM seq GROUP BY session_id)"""


# --- sessions ---------------------------------------------------------------

@query("k1_sessions_by_key", """
    SELECT session_id, count(*) AS events, min(line_no) AS first_line, max(cluster_id) AS max_cluster
    FROM (SELECT CASE WHEN line_no % 7 = 0 THEN NULL ELSE session_id END AS session_id, line_no, cluster_id FROM v_events)
    WHERE session_id IS NOT NULL GROUP BY session_id""", ["v_events"])
def k1(spark, sf):
    e = V.v_events(spark, sf).withColumn("block_id", F.when(F.col("line_no") % 7 != 0, F.col("session_id")))
    return K.sessions_by_key(e, "block_id").groupBy("session_id").agg(
        F.count("*").alias("events"), F.min("line_no").alias("first_line"), F.max("cluster_id").alias("max_cluster"))


@query("k2_sessions_by_node", """
    SELECT node_id AS session_id, count(*) AS events, CAST(sum(cluster_id) AS BIGINT) AS id_sum FROM v_events GROUP BY node_id""", ["v_events"])
def k2(spark, sf):
    return K.sessions_by_key(V.v_events(spark, sf), "node_id").groupBy("session_id").agg(
        F.count("*").alias("events"), F.sum("cluster_id").alias("id_sum"))


@query("k3_sessions_by_window", """
    SELECT CAST(floor(unix_ts / 21600) AS BIGINT) AS window_id, count(*) AS events FROM v_events GROUP BY 1""", ["v_events"])
def k3(spark, sf):
    e = K.sessions_by_window(V.v_events(spark, sf).drop("window_id"))
    return e.groupBy("window_id").agg(F.count("*").alias("events"))


@query("k3_sessions_by_window_sliding", """
    SELECT w AS window_id, count(*) AS events, min(line_no) AS first_line FROM (
      SELECT line_no, unnest(range(CAST(floor((unix_ts - 21600) / 7200.0) AS BIGINT) + 1, CAST(floor(unix_ts / 7200.0) AS BIGINT) + 1)) AS w
      FROM v_events) GROUP BY 1""", ["v_events"])
def k3s(spark, sf):
    e = K.sessions_by_window(V.v_events(spark, sf).drop("window_id"), 21_600, 7_200)
    return e.groupBy("window_id").agg(F.count("*").alias("events"), F.min("line_no").alias("first_line"))


SLIDING = """w AS (SELECT *, unnest(range(CAST(floor((unix_ts - 21600) / 7200.0) AS BIGINT) + 1, CAST(floor(unix_ts / 7200.0) AS BIGINT) + 1)) AS win FROM v_events)"""


@query("k3_window_totals_sliding", f"""
    WITH {SLIDING} SELECT win AS window_id, count(*) AS events, CAST(count(*) FILTER (is_anomaly) AS BIGINT) AS anomalous,
           CAST(max(CAST(is_anomaly AS INT)) AS INT) AS label, min(line_no) AS first_line FROM w GROUP BY 1""", ["v_events"])
def k3_totals(spark, sf):
    """Lengths and labels of overlapping windows without repeating an event."""
    return K.window_totals(V.v_events(spark, sf), 21_600, 7_200)


@query("k3_node_window_totals", f"""
    WITH {SLIDING} SELECT win AS window_id, node_id, count(*) AS events, CAST(count(*) FILTER (is_anomaly) AS BIGINT) AS anomalous,
           CAST(max(CAST(is_anomaly AS INT)) AS INT) AS label, min(line_no) AS first_line FROM w GROUP BY 1, 2""", ["v_events"])
def k3_node_totals(spark, sf):
    return K.window_totals(V.v_events(spark, sf), 21_600, 7_200, keys=["node_id"])


@query("k4_session_arrays", f"""
    WITH {seq_sql('v_events')}
    SELECT session_id, max(n) AS n,
           string_agg(CAST(cluster_id AS VARCHAR), ',' ORDER BY ts, line_no) AS cluster_ids,
           string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY ts, line_no) AS line_nos,
           string_agg(parameters[1], ',' ORDER BY ts, line_no) AS first_params
    FROM seq GROUP BY session_id""", ["v_events"])
def k4(spark, sf):
    e = V.v_events(spark, sf).withColumn("p", F.col("parameters")[0])
    a = K.session_arrays(e, cols=["cluster_id", "line_no", "p"])
    return a.select("session_id", "n", joined("cluster_id").alias("cluster_ids"),
                    joined("line_no").alias("line_nos"), joined("p").alias("first_params"))


@query("w1_with_position", f"""
    WITH {seq_sql('v_events_tied')}
    SELECT session_id, line_no, pos, {s6('pos / greatest(n - 1, 1)')} AS norm_pos FROM seq""", ["v_events_tied"])
def w1(spark, sf):
    p = K.with_position(V.v_events_tied(spark, sf))
    return p.select("session_id", "line_no", "pos", r6("norm_pos").alias("norm_pos"))


@query("w2_with_next", f"""
    WITH {seq_sql('v_items')}
    SELECT session_id, line_no, cluster_id AS src, next_cluster_id AS dst, {s6('delta_us / 1e6')} AS delta_s
    FROM seq WHERE pos < n - 1""", ["v_items"])
def w2(spark, sf):
    p = K.with_next(V.v_items(spark, sf))
    return p.select("session_id", "line_no", F.col("cluster_id").alias("src"), F.col("next_cluster_id").alias("dst"),
                    r6("delta_s").alias("delta_s"))


FIRST_SEEN = """first_seen AS (
    SELECT session_id, cluster_id, row_number() OVER (PARTITION BY session_id ORDER BY p) - 1 AS node_idx
    FROM (SELECT session_id, cluster_id, min(pos) AS p FROM seq GROUP BY 1, 2))"""


@query("w3_first_seen_index", f"WITH {seq_sql('v_events')}, {FIRST_SEEN} SELECT * FROM first_seen", ["v_events"])
def w3(spark, sf):
    return K.first_seen_index(V.v_events(spark, sf))


@query("w4_fire_number", """
    SELECT session_id, cluster_id, line_no, row_number() OVER (PARTITION BY session_id, cluster_id ORDER BY ts, line_no) AS fire_no
    FROM v_events_tied""", ["v_events_tied"])
def w4(spark, sf):
    return K.fire_number(V.v_events_tied(spark, sf)).select("session_id", "cluster_id", "line_no", "fire_no")


@query("w5_pattern_coverage", f"""
    WITH {seq_sql('v_items')}, {FPS},
    c AS (SELECT fingerprint, count(*) AS pattern_count FROM fps GROUP BY 1)
    SELECT row_number() OVER (ORDER BY pattern_count DESC, fingerprint) AS pattern_rank, fingerprint, pattern_count,
           {s6('100.0 * sum(pattern_count) OVER (ORDER BY pattern_count DESC, fingerprint) / sum(pattern_count) OVER ()')} AS cum_pct
    FROM c""", ["v_items"])
def w5(spark, sf):
    return rounded(K.pattern_coverage(K.session_fingerprint(V.v_items(spark, sf))), "cum_pct")


@query("w5_patterns_for_share", f"""
    WITH {seq_sql('v_items')}, {FPS},
    c AS (SELECT fingerprint, count(*) AS k FROM fps GROUP BY 1),
    r AS (SELECT row_number() OVER (ORDER BY k DESC, fingerprint) AS rk, 100.0 * sum(k) OVER (ORDER BY k DESC, fingerprint) / sum(k) OVER () AS cum FROM c)
    SELECT min(rk) AS n_patterns FROM r WHERE cum >= 90""", ["v_items"])
def w5b(spark, sf):
    return K.patterns_for_share(K.pattern_coverage(K.session_fingerprint(V.v_items(spark, sf))))


@query("f17_session_fingerprint", f"WITH {seq_sql('v_events')}, {FPS} SELECT session_id, n, fingerprint FROM fps", ["v_events"])
def f17(spark, sf):
    return K.session_fingerprint(V.v_events(spark, sf)).select("session_id", "n", "fingerprint")


@query("o1_sort_events", """
    SELECT session_id, line_no, row_number() OVER (PARTITION BY session_id ORDER BY ts, line_no) AS rank_in_session FROM v_events_tied""",
       ["v_events_tied"])
def o1(spark, sf):
    e = K.with_position(V.v_events_tied(spark, sf)).withColumn("rank_in_session", F.col("pos") + 1)
    return K.sort_events(e).select("session_id", "line_no", "rank_in_session")


@query("o2_top_patterns", f"""
    WITH {seq_sql('v_items')}, {FPS}
    SELECT fingerprint, count(*) AS pattern_count, min(n) AS length, min(session_id) AS example_session,
           arg_min(head, session_id) || CASE WHEN min(n) > 8 THEN '…' ELSE '' END AS preview
    FROM fps GROUP BY fingerprint ORDER BY pattern_count DESC, fingerprint LIMIT 10""", ["v_items"])
def o2(spark, sf):
    return K.top_patterns(K.session_fingerprint(V.v_items(spark, sf)), 10)


@query("o2_pattern_summary", f"""
    WITH {seq_sql('v_conv')}, {FPS}
    SELECT count(DISTINCT fingerprint) AS unique_patterns, count(*) AS sessions,
           {s6('100.0 * count(DISTINCT fingerprint) / count(*)')} AS unique_pct FROM fps""".replace("epoch_us(lead(ts) OVER w) - epoch_us(ts)", "0"), ["v_conv"])
def o2b(spark, sf):
    return rounded(K.pattern_summary(K.session_fingerprint(V.v_conv(spark, sf))), "unique_pct")


@query("o3_sample_sessions", """
    WITH l AS (SELECT session_id, count(*) AS seq_len FROM v_events GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY seq_len, session_id) - 1 AS pos, count(*) OVER () AS n FROM l)
    SELECT kind, session_id, seq_len FROM r, (VALUES ('shortest'), ('median'), ('longest')) k(kind)
    WHERE (kind = 'shortest' AND pos = 0) OR (kind = 'median' AND pos = n // 2) OR (kind = 'longest' AND pos = n - 1)""", ["v_events"])
def o3(spark, sf):
    return K.sample_sessions(K.session_lengths(V.v_events(spark, sf)))


@query("o4_session_listing", """
    SELECT row_number() OVER (ORDER BY ts, line_no) - 1 AS pos, line_no, cluster_id, left(template, 20) AS preview,
           parameters[1] || ';' || parameters[2] AS params FROM v_events WHERE session_id = 'blk_7'""", ["v_events"])
def o4(spark, sf):
    rows = K.session_listing(V.v_events(spark, sf), "blk_7", preview=20)
    return rows.select("pos", "line_no", "cluster_id", "preview", F.array_join("parameters", ";").alias("params"))


# --- counts -----------------------------------------------------------------

@query("a1_session_lengths", "SELECT session_id, count(*) AS seq_len FROM v_events GROUP BY session_id", ["v_events"])
def a1(spark, sf):
    return K.session_lengths(V.v_events(spark, sf))


@query("a2_describe_lengths", f"""
    SELECT count(*) AS count, {s6('avg(c)')} AS mean, {s6('stddev_samp(c)')} AS std, min(c) AS min,
           {s6('quantile_cont(c, 0.25)')} AS p25, {s6('quantile_cont(c, 0.5)')} AS p50, {s6('quantile_cont(c, 0.75)')} AS p75, max(c) AS max
    FROM (SELECT count(*) AS c FROM v_events GROUP BY session_id)""", ["v_events"])
def a2(spark, sf):
    return rounded(K.describe_lengths(K.session_lengths(V.v_events(spark, sf))), "mean", "std", "p25", "p50", "p75")


@query("a3_length_percentiles", "SELECT " + ", ".join(s6(f"quantile_cont(c, {p / 100})") + f" AS p{p}" for p in (50, 75, 90, 95, 99, 100))
       + " FROM (SELECT count(*) AS c FROM v_items GROUP BY session_id)", ["v_items"])
def a3(spark, sf):
    p = K.length_percentiles(K.session_lengths(V.v_items(spark, sf)))
    return rounded(p, *p.columns)


@query("a4_histogram", f"""
    WITH l AS (SELECT count(*) AS c FROM v_events GROUP BY session_id),
    s AS (SELECT min(c)::DOUBLE AS lo, max(c)::DOUBLE AS hi FROM l)
    SELECT bin, {s6('lo + (bin - 1) * (hi - lo) / 20')} AS bin_lo, count(*) AS cnt
    FROM (SELECT least(CAST(floor((c - lo) / ((hi - lo) / 20)) AS INT) + 1, 20) AS bin, lo, hi FROM l, s) GROUP BY bin, lo, hi""", ["v_events"])
def a4(spark, sf):
    return rounded(K.histogram(K.session_lengths(V.v_events(spark, sf)), "seq_len", 20), "bin_lo")


@query("a4_histogram_by_label", f"""
    WITH s AS (SELECT label, min(edge) AS lo, max(edge) AS hi FROM v_scores GROUP BY label)
    SELECT label, bin, {s6('lo + (bin - 1) * (hi - lo) / 10')} AS bin_lo, count(*) AS cnt
    FROM (SELECT v.label, least(CAST(floor((edge - lo) / ((hi - lo) / 10)) AS INT) + 1, 10) AS bin, lo, hi
          FROM v_scores v JOIN s ON v.label = s.label) GROUP BY label, bin, lo, hi""", ["v_scores"])
def a4b(spark, sf):
    return rounded(K.histogram(V.v_scores(spark, sf), "edge", 10, ["label"]), "bin_lo")


@query("a5_anomaly_rate", f"""
    SELECT count(*) AS total, count(*) FILTER (NOT is_anomaly) AS normal, count(*) FILTER (is_anomaly) AS anomalous,
           {s6('100.0 * count(*) FILTER (is_anomaly) / count(*)')} AS anomaly_pct FROM v_events""", ["v_events"])
def a5(spark, sf):
    return rounded(K.anomaly_rate(V.v_events(spark, sf)), "anomaly_pct")


@query("a6_top_codes", "SELECT label, count(*) AS cnt FROM v_events WHERE is_anomaly GROUP BY label ORDER BY cnt DESC, label LIMIT 10", ["v_events"])
def a6(spark, sf):
    return K.top_codes(V.v_events(spark, sf), 10)


@query("a7_level_distribution", "SELECT level, count(*) AS cnt FROM v_events GROUP BY level", ["v_events"])
def a7(spark, sf):
    return K.level_distribution(V.v_events(spark, sf))


@query("a8_window_label", "SELECT window_id, CAST(bool_or(is_anomaly) AS INT) AS label FROM v_events GROUP BY window_id", ["v_events"])
def a8(spark, sf):
    return K.window_label(V.v_events(spark, sf))


@query("a9_cluster_counts", """
    SELECT session_id, cluster_id, count(*) AS firings, left(min(template), 80) AS preview FROM v_events GROUP BY 1, 2""", ["v_events"])
def a9(spark, sf):
    return K.cluster_counts(V.v_events(spark, sf))


@query("a10_collapse_accounting", """
    SELECT session_id, CAST(sum(occ) AS BIGINT) AS lines, count(*) AS unique_clusters, count(*) FILTER (occ > 1) AS repeated_clusters,
           CAST(sum(occ - 1) AS BIGINT) AS extra_lines, CAST(sum(occ) - sum(occ - 1) AS BIGINT) AS nodes
    FROM (SELECT session_id, cluster_id, count(*) AS occ FROM v_items GROUP BY 1, 2) GROUP BY session_id""", ["v_items"])
def a10(spark, sf):
    return K.collapse_accounting(V.v_items(spark, sf))


@query("a11_longest_sessions", """
    SELECT session_id, count(*) AS events FROM v_items GROUP BY 1 ORDER BY events DESC, session_id LIMIT 15""", ["v_items"])
def a11(spark, sf):
    e = V.v_items(spark, sf)
    nodes = e.groupBy("session_id", "cluster_id").agg(F.count("*").alias("occurrence_count"))
    return G.longest_sessions(nodes, 15)


@query("a12_fit_fraction", f"SELECT {s6('avg(CAST(c <= 64 AS INT))')} AS fit_fraction FROM (SELECT count(*) AS c FROM v_events GROUP BY session_id)", ["v_events"])
def a12(spark, sf):
    return rounded(K.fit_fraction(K.session_lengths(V.v_events(spark, sf)), 64), "fit_fraction")


# --- graphs -----------------------------------------------------------------

@query("gn_graph_nodes", f"WITH {seq_sql('v_events')}, {nodes_sql('v_events')} SELECT * FROM nodes", ["v_events"])
def gn(spark, sf):
    return rounded(G.graph_nodes(V.v_events(spark, sf)), *NODE_OUT)


@query("gn_graph_nodes_log", f"WITH {seq_sql('v_items')}, {nodes_sql('v_items', 'log')} SELECT * FROM nodes", ["v_items"])
def gn_log(spark, sf):
    return rounded(G.graph_nodes(V.v_items(spark, sf), scale="log"), *NODE_OUT)


@query("ge_graph_edges", f"WITH {seq_sql('v_events')}, {edges_sql()} SELECT * FROM edges", ["v_events"])
def ge(spark, sf):
    return rounded(G.graph_edges(V.v_events(spark, sf)), *EDGE_OUT)


@query("ge_graph_edges_log", f"WITH {seq_sql('v_items')}, {edges_sql('log')} SELECT * FROM edges", ["v_items"])
def ge_log(spark, sf):
    return rounded(G.graph_edges(V.v_items(spark, sf), scale="log"), *EDGE_OUT)


@query("gb_graph_edges_basic", f"""
    WITH {seq_sql('v_items')}
    SELECT session_id, cluster_id AS src, next_cluster_id AS dst, count(*) AS weight,
           {s6('coalesce(avg(delta_us) / 1e6, -1)')} AS time_delta_s, {s6('coalesce(stddev_pop(delta_us) / 1e6, 0)')} AS time_delta_std
    FROM seq WHERE pos < n - 1 GROUP BY 1, 2, 3""", ["v_items"])
def gb(spark, sf):
    return rounded(G.graph_edges_basic(V.v_items(spark, sf)), "time_delta_s", "time_delta_std")


@query("gp_param_stats", f"""
    SELECT line_no, CAST(len(parameters) AS INT) AS param_count, {s6('coalesce(list_avg(nums), 0)')} AS param_num_mean, {s6('coalesce(list_max(nums), 0)')} AS param_num_max
    FROM (SELECT *, [y FOR y IN [{NUMBER} FOR x IN parameters] IF y IS NOT NULL] AS nums
          FROM (SELECT line_no, list_append(parameters, event_type) AS parameters FROM v_events))""", ["v_events"])
def gp(spark, sf):
    e = V.v_events(spark, sf).select("line_no", F.array_append("parameters", F.col("event_type")).alias("parameters"))
    return rounded(G.param_summary(e), "param_num_mean", "param_num_max")


@query("gc_event_chain", f"""
    WITH {seq_sql('v_events')}
    SELECT session_id, pos AS node, cluster_id, CASE WHEN pos < n - 1 THEN pos + 1 END AS next_node,
           {s6('CASE WHEN pos < n - 1 THEN coalesce(delta_us / 1e6, -1) END')} AS time_delta_s FROM seq""", ["v_events"])
def gc(spark, sf):
    return rounded(G.event_chain(V.v_events(spark, sf)), "time_delta_s")


@query("gs_graph_sizes", f"""
    WITH {seq_sql('v_items')}
    SELECT session_id, count(*) AS seq_len, count(DISTINCT cluster_id) AS collapsed_nodes,
           count(DISTINCT cluster_id * 100 + next_cluster_id) AS collapsed_edges, count(*) AS chain_nodes, count(*) - 1 AS chain_edges
    FROM seq GROUP BY session_id""", ["v_items"])
def gs(spark, sf):
    return G.graph_sizes(V.v_items(spark, sf))


@query("gr_graph_records", f"""
    WITH {seq_sql('v_items')}, {FIRST_SEEN},
    nn AS (SELECT s.session_id, s.cluster_id, any_value(f.node_idx) AS node_idx, count(*) AS occ
           FROM seq s JOIN first_seen f ON s.session_id = f.session_id AND s.cluster_id = f.cluster_id GROUP BY 1, 2),
    ee AS (SELECT s.session_id, a.node_idx AS si, b.node_idx AS di, count(*) AS w FROM seq s
           JOIN first_seen a ON s.session_id = a.session_id AND s.cluster_id = a.cluster_id
           JOIN first_seen b ON s.session_id = b.session_id AND s.next_cluster_id = b.cluster_id WHERE pos < n - 1 GROUP BY 1, 2, 3),
    en AS (SELECT session_id, count(*) AS ne, string_agg(si || '>' || di || ':' || w, ',' ORDER BY si, di) AS e FROM ee GROUP BY 1)
    SELECT nn.session_id, CAST(count(*) AS INT) AS num_nodes, CAST(coalesce(any_value(ne), 0) AS INT) AS num_edges,
           string_agg(cluster_id || ':' || occ, ',' ORDER BY node_idx) AS node_text, coalesce(any_value(e), '') AS edge_text,
           CAST(9 AS INT) AS node_dim
    FROM nn LEFT JOIN en ON nn.session_id = en.session_id GROUP BY nn.session_id""", ["v_items"])
def gr(spark, sf):
    e = V.v_items(spark, sf)
    r = G.graph_records(*G.session_graphs(e))
    node_text = F.array_join(F.zip_with("cluster_ids", "x", lambda c, x: F.concat_ws(":", c.cast("string"), x[0].cast("bigint").cast("string"))), ",")
    ends = F.zip_with("edge_src", "edge_dst", lambda a, b: F.concat_ws(">", a.cast("string"), b.cast("string")))
    edge_text = F.array_join(F.zip_with(ends, "edge_attr", lambda t, a: F.concat_ws(":", t, a[0].cast("bigint").cast("string"))), ",")
    return r.select("session_id", "num_nodes", "num_edges", node_text.alias("node_text"), edge_text.alias("edge_text"),
                    F.size(F.col("x")[0]).alias("node_dim"))


@query("gq_canonical_graphs", f"""
    WITH {seq_sql('v_items')}, {FPS}, r AS (SELECT fingerprint, min(session_id) AS session_id, count(*) AS sessions FROM fps GROUP BY 1)
    SELECT r.fingerprint, r.session_id, any_value(sessions) AS sessions, s.cluster_id AS src, s.next_cluster_id AS dst, count(*) AS weight
    FROM r JOIN seq s ON r.session_id = s.session_id WHERE pos < n - 1 GROUP BY 1, 2, 4, 5""", ["v_items"])
def gq(spark, sf):
    reps, events = G.canonical_graphs(V.v_items(spark, sf))
    edges = G.graph_edges_basic(events).select("session_id", "src", "dst", "weight")
    return reps.join(edges, "session_id").select("fingerprint", "session_id", "sessions", "src", "dst", "weight")


@query("gq_reduction_ratio", f"""
    WITH {seq_sql('v_items')}, {FPS}
    SELECT count(*) AS sessions, count(DISTINCT fingerprint) AS canonical, {s6('count(*) / count(DISTINCT fingerprint)')} AS reduction FROM fps""", ["v_items"])
def gq2(spark, sf):
    reps, _ = G.canonical_graphs(V.v_items(spark, sf))
    return rounded(G.reduction_ratio(reps), "reduction")


SIZES = """st AS (SELECT session_id, count(*) AS seq_len, count(DISTINCT cluster_id) AS n_nodes,
    count(DISTINCT cluster_id * 100 + next_cluster_id) AS n_edges FROM seq GROUP BY session_id)"""


@query("gd_graph_distribution", f"WITH {seq_sql('v_items')}, {SIZES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, count(*) AS count, {s6(f'avg({c})')} AS mean, {s6(f'stddev_samp({c})')} AS std, CAST(min({c}) AS BIGINT) AS min, "
    + ", ".join(s6(f"quantile_cont({c}, {p / 100})") + f" AS p{p}" for p in (25, 50, 75))
    + f", CAST(max({c}) AS BIGINT) AS max, " + ", ".join(s6(f"quantile_cont({c}, {p / 100})") + f" AS p{p}" for p in (90, 95, 99)) + " FROM st"
    for c in ("seq_len", "n_nodes", "n_edges")), ["v_items"])
def gd(spark, sf):
    e = V.v_items(spark, sf)
    nodes = e.groupBy("session_id", "cluster_id").agg(F.count("*").alias("occurrence_count"))
    stats = G.node_edge_stats(nodes, G.graph_edges_basic(e))
    return rounded(G.graph_distribution(stats), "mean", "std", "p25", "p50", "p75", "p90", "p95", "p99")


@query("gm_neighbor_aggregate", f"""
    WITH {seq_sql('v_events')},
    nodes AS (SELECT session_id, cluster_id, count(*)::DOUBLE AS h1, cluster_id - 3.0::DOUBLE AS h2 FROM seq GROUP BY 1, 2),
    e AS (SELECT session_id, cluster_id AS src, next_cluster_id AS dst, -count(*)::DOUBLE AS e1, 1.5::DOUBLE AS e2 FROM seq WHERE pos < n - 1 GROUP BY 1, 2, 3),
    m AS (SELECT e.session_id, dst AS cluster_id, sum(greatest(h1 + e1, 0)) AS m1, sum(greatest(h2 + e2, 0)) AS m2
          FROM e JOIN nodes s ON e.session_id = s.session_id AND e.src = s.cluster_id GROUP BY 1, 2)
    SELECT d.session_id, d.cluster_id, {s6('h1 * 1.5 + coalesce(m1, 0)')} AS h1, {s6('h2 * 1.5 + coalesce(m2, 0)')} AS h2
    FROM nodes d LEFT JOIN m ON d.session_id = m.session_id AND d.cluster_id = m.cluster_id""", ["v_events"])
def gm(spark, sf):
    e = V.v_events(spark, sf)
    nodes = e.groupBy("session_id", "cluster_id").agg(F.count("*").alias("c")).select(
        "session_id", "cluster_id", F.array(F.col("c").cast("double"), F.col("cluster_id") - F.lit(3.0)).alias("h"))
    edges = G.graph_edges_basic(e).select("session_id", "src", "dst", F.array(-F.col("weight").cast("double"), F.lit(1.5)).alias("e"))
    out = G.neighbor_aggregate(nodes, edges, "sum", eps=0.5)
    return out.select("session_id", "cluster_id", r6(F.col("h")[0]).alias("h1"), r6(F.col("h")[1]).alias("h2"))


@query("gx_negative_edges", f"""
    WITH {seq_sql('v_items')}, e AS (SELECT DISTINCT session_id, cluster_id AS src, next_cluster_id AS dst FROM seq WHERE pos < n - 1),
    d AS (SELECT session_id, cluster_id, row_number() OVER (PARTITION BY session_id ORDER BY cluster_id) - 1 AS i FROM (SELECT DISTINCT session_id, cluster_id FROM seq)),
    s AS (SELECT session_id, count(*) AS k, count(*) * (count(*) - 1) AS m, ('0x' || left(md5('42:' || session_id), 15))::BIGINT AS digest FROM d GROUP BY 1),
    c AS (SELECT e.session_id, count(*) AS e FROM e GROUP BY 1),
    u AS (SELECT e.session_id, a.i * (s.k - 1) + CASE WHEN b.i > a.i THEN b.i - 1 ELSE b.i END AS code FROM e JOIN s USING (session_id)
          JOIN d a ON a.session_id = e.session_id AND a.cluster_id = src JOIN d b ON b.session_id = e.session_id AND b.cluster_id = dst WHERE src <> dst),
    w AS (SELECT session_id, k, e, step, (digest % m + step * 1000000007) % m AS code
          FROM (SELECT s.*, c.e, unnest(range(least(m, 2 * c.e))) AS step FROM s JOIN c USING (session_id) WHERE m > 0)),
    f AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY step) AS r FROM w ANTI JOIN u ON u.session_id = w.session_id AND u.code = w.code),
    p AS (SELECT session_id, code // (k - 1) AS i, code % (k - 1) + CASE WHEN code % (k - 1) >= code // (k - 1) THEN 1 ELSE 0 END AS j FROM f WHERE r <= e)
    SELECT p.session_id, a.cluster_id AS src, b.cluster_id AS dst FROM p JOIN d a ON a.session_id = p.session_id AND a.i = p.i JOIN d b ON b.session_id = p.session_id AND b.i = p.j""", ["v_items"])
def gx(spark, sf):
    e = V.v_items(spark, sf)
    nodes = e.select("session_id", "cluster_id").distinct()
    return G.negative_edges(nodes, G.graph_edges_basic(e).select("session_id", "src", "dst"))


@query("gx_negative_edge_counts", f"""
    WITH {seq_sql('v_items')}, e AS (SELECT DISTINCT session_id, cluster_id AS src, next_cluster_id AS dst FROM seq WHERE pos < n - 1),
    k AS (SELECT session_id, count(DISTINCT cluster_id) AS k FROM seq GROUP BY 1),
    c AS (SELECT session_id, count(*) AS e, count(*) FILTER (src <> dst) AS x FROM e GROUP BY 1)
    SELECT k.session_id, least(e, k * (k - 1) - x) AS negatives, CAST(0 AS BIGINT) AS real_edges, CAST(0 AS BIGINT) AS loops
    FROM k JOIN c ON k.session_id = c.session_id WHERE least(e, k * (k - 1) - x) > 0""", ["v_items"])
def gx_counts(spark, sf):
    e = V.v_items(spark, sf)
    edges = G.graph_edges_basic(e).select("session_id", "src", "dst")
    neg = G.negative_edges(e.select("session_id", "cluster_id").distinct(), edges).distinct()
    marked = neg.join(edges.withColumn("real", F.lit(1)), ["session_id", "src", "dst"], "left")
    return marked.groupBy("session_id").agg(
        F.count("*").alias("negatives"), F.count("real").alias("real_edges"),
        F.count_if(F.col("src") == F.col("dst")).alias("loops"))


# --- joins over graphs ------------------------------------------------------

@query("j8_edges_to_index", f"""
    WITH {seq_sql('v_events')}, {FIRST_SEEN}
    SELECT s.session_id, s.cluster_id AS src, s.next_cluster_id AS dst, any_value(a.node_idx) AS src_idx, any_value(b.node_idx) AS dst_idx, count(*) AS weight
    FROM seq s JOIN first_seen a ON s.session_id = a.session_id AND s.cluster_id = a.cluster_id
    JOIN first_seen b ON s.session_id = b.session_id AND s.next_cluster_id = b.cluster_id WHERE pos < n - 1 GROUP BY 1, 2, 3""", ["v_events"])
def j8(spark, sf):
    e = V.v_events(spark, sf)
    edges = G.graph_edges_basic(e).select("session_id", "src", "dst", "weight")
    return G.edges_to_index(K.first_seen_index(e), edges).select("session_id", "src", "dst", "src_idx", "dst_idx", "weight")


@query("j9_node_edge_stats", f"""
    WITH {seq_sql('v_items')}, {SIZES} SELECT session_id, seq_len, n_nodes, n_edges FROM st""", ["v_items"])
def j9(spark, sf):
    e = V.v_items(spark, sf)
    nodes = e.groupBy("session_id", "cluster_id").agg(F.count("*").alias("occurrence_count"))
    return G.node_edge_stats(nodes, G.graph_edges_basic(e))


@query("j10_compare_graph_stores", f"""
    WITH {seq_sql('v_items')}, {SIZES.replace('st AS', 'a AS')},
    {seq_sql('(SELECT * FROM v_items WHERE l_quantity > 5)', 'seq2')}, {SIZES.replace('st AS', 'b AS').replace('FROM seq', 'FROM seq2')}
    SELECT coalesce(a.session_id, b.session_id) AS session_id, a.n_nodes AS nodes_a, a.n_edges AS edges_a, b.n_nodes AS nodes_b, b.n_edges AS edges_b,
           CASE WHEN a.n_nodes IS NULL OR b.n_nodes IS NULL THEN 'missing'
                WHEN a.n_nodes = b.n_nodes AND a.n_edges = b.n_edges THEN 'match' ELSE 'mismatch' END AS status
    FROM a FULL JOIN b ON a.session_id = b.session_id""", ["v_items"])
def j10(spark, sf):
    e = V.v_items(spark, sf)

    def store(events):
        nodes = events.groupBy("session_id", "cluster_id").agg(F.count("*").alias("occurrence_count"))
        return nodes, G.graph_edges_basic(events)

    return G.compare_graph_stores(store(e), store(e.where(F.col("l_quantity") > 5)))
