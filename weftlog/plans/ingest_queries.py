"""Queries over raw lines, text functions, templates and stored tables."""

import json

import pandas as pd
from pyspark.sql import functions as F

from weftlog.functions import columns as C
from weftlog.operators import graphs as G
from weftlog.operators import lookups as J
from weftlog.operators import sessions as K
from weftlog.operators import templates as T
from weftlog.operators.skew import ordered
from weftlog.plans import views as V
from weftlog.plans.registry import joined, query, r6, rounded, s6
from weftlog.plans.session_queries import seq_sql
from weftlog.session import scratch_path
from weftlog.sources import graph_store
from weftlog.sources import logs as L
from weftlog.sources import tables as S


def raw_hdfs(spark, sf):
    """Rendered lines, parsed; `line_no` is the event id."""
    return L.parse_hdfs_lines(V.v_raw_hdfs(spark, sf))


def written_hdfs(spark, sf):
    path = scratch_path(spark, "raw-hdfs")
    V.v_raw_hdfs(spark, sf).select("value").write.text(path)
    return path


def raw_catalog(spark, sf):
    """Templates of the rendered lines, derived from the event kinds present.
    The block-less form of one kind is left out, so some lines stay unmatched."""
    e = V.v_events(spark, sf)
    has_block = F.col("line_no") % 7 != 0
    kinds = e.select("event_type", "level", has_block.alias("b")).distinct()
    kinds = kinds.where(~((F.col("event_type") == "view") & ~F.col("b")))
    template = F.concat(
        "level", F.lit(" app."), "event_type", F.lit(": event <*> "),
        F.when(F.col("b"), F.lit("for <BLK> ")).otherwise(F.lit("")), F.lit("from <IP> value <*>"),
    )
    ids = V._choice(F.col("event_type"), V.IDS) * 2 + F.col("b").cast("int")
    return kinds.select(ids.alias("cluster_id"), template.alias("template"))


RAW_MATCH = """match AS (
    SELECT line_no, session_id, user_id, value,
           CASE WHEN NOT (event_type = 'view' AND line_no % 7 = 0) THEN cluster_id * 2 + CASE WHEN line_no % 7 = 0 THEN 0 ELSE 1 END END AS cid,
           level || ' app.' || event_type || ': event <*> ' || CASE WHEN line_no % 7 = 0 THEN '' ELSE 'for <BLK> ' END || 'from <IP> value <*>' AS tpl,
           level || ' app.' || event_type || ': event ' || line_no || ' ' || CASE WHEN line_no % 7 = 0 THEN '' ELSE 'for ' || session_id || ' ' END
             || '{ip}' || ' value ' || CAST(value AS VARCHAR) AS content,
           line_no || ',' || CASE WHEN line_no % 7 = 0 THEN '' ELSE session_id || ',' END || '{addr}' || ',' || CAST(value AS VARCHAR) AS params
    FROM v_events)"""
ADDR = "/10.0.' || (user_id % 250) || '.' || (line_no % 250) || ':' || (1024 + line_no % 5000) || '"
MATCH = RAW_MATCH.replace("{ip}", "from " + ADDR).replace("{addr}", ADDR)
CONTENT = r"regexp_replace(value, '^(\S+\s+){3}', '')"


# --- sources ----------------------------------------------------------------

@query("s1_read_hdfs_log", rf"""
    SELECT string_split(value, ' ')[1] AS date, string_split(value, ' ')[2] AS time, string_split(value, ' ')[3] AS thread,
           CAST(epoch(strptime(string_split(value, ' ')[1] || ' ' || string_split(value, ' ')[2], '%d%m%y %H%M%S')) AS BIGINT) AS epoch_s,
           {CONTENT} AS content, value AS raw FROM v_raw_hdfs""", ["v_raw_hdfs"])
def s1(spark, sf):
    rows = L.read_hdfs_log(spark, written_hdfs(spark, sf))
    return rows.select("date", "time", "thread", F.unix_seconds("timestamp").alias("epoch_s"), "content", "raw")


@query("s2_read_bgl_log", r"""
    WITH p AS (SELECT value, string_split(value, ' ') AS a FROM v_raw_bgl)
    SELECT a[1] AS label, CAST(a[2] AS BIGINT) AS unix_ts, a[3] AS date, a[4] AS node_id, a[5] AS datetime, a[7] AS component, a[8] AS subcomponent,
           a[9] AS level, regexp_replace(value, '^(\S+\s+){9}', '') AS message, a[1] <> '-' AS is_anomaly FROM p""", ["v_raw_bgl"])
def s2(spark, sf):
    path = scratch_path(spark, "raw-bgl")
    V.v_raw_bgl(spark, sf).select("value").write.text(path)
    return L.read_bgl_log(spark, path).select(
        "label", "unix_ts", "date", "node_id", "datetime", "component", "subcomponent", "level", "message", "is_anomaly")


@query("s3_with_line_no", """
    SELECT count(*) AS lines, count(*) AS distinct_numbers, CAST(0 AS BIGINT) AS out_of_order FROM events""")
def s3(spark, sf):
    """Events written sorted by id must come back in that order."""
    path = scratch_path(spark, "ordered-lines")
    V.v_raw_hdfs(spark, sf).repartitionByRange(6, "line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    event = F.regexp_extract("value", r"event (\d+)", 1).cast("bigint")
    rows = L.with_line_no(spark.read.text(path)).select("line_no", event.alias("ev"))
    return ordered(rows, [], ["line_no"], lead=["ev"]).agg(
        F.count("*").alias("lines"), F.countDistinct("line_no").alias("distinct_numbers"),
        F.count_if(F.col("next_ev") < F.col("ev")).alias("out_of_order"))


@query("s4_extract_block_id", r"SELECT line_no, nullif(regexp_extract(value, 'blk_-?\d+', 0), '') AS block_id FROM v_raw_hdfs", ["v_raw_hdfs"])
def s4(spark, sf):
    return V.v_raw_hdfs(spark, sf).select("line_no", C.extract_block_id("value").alias("block_id"))


@query("s5_count_lines", "SELECT count(*) AS lines FROM events")
def s5(spark, sf):
    return L.count_lines(spark, written_hdfs(spark, sf))


@query("s6_read_labels", "SELECT 'blk_' || doc_id AS session_id, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS label FROM labels")
def s6_labels(spark, sf):
    path = scratch_path(spark, "labels")
    lab = V.table(spark, sf, "labels").select(
        F.concat(F.lit("blk_"), "doc_id").alias("BlockId"),
        F.when(F.col("toxic") == 1, F.lit("Anomaly")).otherwise(F.lit("Normal")).alias("Label"))
    lab.write.csv(path, header=True)
    return L.read_labels(spark, path)


CATALOG_SQL = """
    SELECT cluster_id, template, count(*) AS count,
           array_to_string(list(parameters[1] ORDER BY line_no)[1:3], ',') AS examples FROM v_events GROUP BY 1, 2"""


def event_catalog(spark, sf):
    e = V.v_events(spark, sf).withColumn("content", F.col("parameters")[0])
    return T.template_catalog(e, 3)


@query("s7_templates_round_trip", CATALOG_SQL, ["v_events"])
def s7(spark, sf):
    path = scratch_path(spark, "catalog")
    S.write_templates(event_catalog(spark, sf), path)
    return S.read_templates(spark, path).withColumn("examples", joined("examples"))


@query("s8_annotated_round_trip", """
    SELECT session_id, line_no, cluster_id, array_to_string(parameters, ',') AS parameters FROM v_events""", ["v_events"])
def s8(spark, sf):
    path = scratch_path(spark, "annotated")
    S.write_annotated(V.v_events(spark, sf).select("session_id", "line_no", "cluster_id", "parameters"), path, json_parameters=True)
    return S.read_annotated(spark, path).withColumn("parameters", joined("parameters"))


@query("s9_sequences_round_trip", """
    SELECT session_id, line_no, epoch_us(ts) AS ts_us, cluster_id FROM v_events_tied""", ["v_events_tied"])
def s9(spark, sf):
    path = scratch_path(spark, "sequences")
    S.write_sequences(V.v_events_tied(spark, sf).select("session_id", "line_no", "ts", "cluster_id"), path)
    return S.read_sequences(spark, path).select("session_id", "line_no", F.unix_micros("ts").alias("ts_us"), "cluster_id")


@query("s10_latest_run", "SELECT run_tag, run_id, price FROM v_runs WHERE run_tag = (SELECT max(run_tag) FROM v_runs)", ["v_runs"])
def s10(spark, sf):
    return S.latest_run(V.v_runs(spark, sf)).select("run_tag", "run_id", "price")


@query("s11_best_enriched_run", """
    SELECT 'run_' || stage || '_' || (dataset % 10) AS run_tag, count(*) FILTER (price > 100000 OR (dataset % 2 = 0 AND price > 50000)) AS enriched_count FROM v_runs
    GROUP BY 1 ORDER BY enriched_count DESC, max(created) DESC, run_tag DESC LIMIT 1""", ["v_runs"])
def s11(spark, sf):
    r = V.v_runs(spark, sf)
    cats = r.select(F.concat(F.lit("run_"), "stage", F.lit("_"), F.col("dataset") % 10).alias("run_tag"),
                    F.when(F.col("price") > 100000, F.lit("{}")).otherwise(F.lit("{cut off")).alias("large"),
                    F.when((F.col("dataset") % 2 == 0) & (F.col("price") > 50000), F.lit('{"purpose": "x"}')).when(F.col("price") > 20000, F.lit("[]")).alias("small"),
                    F.col("created").alias("mtime"))
    return S.best_enriched_run(cats, ["large", "small"])


@query("s12_upsert_graph", f"""
    WITH {seq_sql('v_events')}
    SELECT session_id, cluster_id AS src, next_cluster_id AS dst, count(*) * CASE WHEN any_value(user_id) % 3 = 0 THEN 10 ELSE 1 END AS weight
    FROM seq WHERE pos < n - 1 GROUP BY 1, 2, 3""", ["v_events"])
def s12(spark, sf):
    """Two batches, the second changing and repeating a third of the sessions, written twice."""
    path = scratch_path(spark, "store")
    e = V.v_events(spark, sf)
    blocks, nodes = e.select("session_id").distinct(), e.groupBy("session_id", "cluster_id").agg(F.count("*").alias("occurrence_count"))
    edges = G.graph_edges_basic(e).select("session_id", "src", "dst", "weight")
    part = F.substring("session_id", 5, 20).cast("bigint") % 3 == 0
    again = edges.where(part).withColumn("weight", F.col("weight") * 10)
    graph_store.upsert_graph(path, blocks, nodes, edges, buckets=8)
    graph_store.upsert_graph(path, blocks.where(part), nodes.where(part), again, buckets=8)
    graph_store.upsert_graph(path, blocks.where(part), nodes.where(part), again, buckets=8)
    return graph_store.read_graph(spark, path, "edges")


@query("s12_last_write_wins", """
    SELECT session_id, cluster_id, arg_max(CAST(value AS DOUBLE), line_no) AS value, count(*) AS seen FROM v_events GROUP BY 1, 2""", ["v_events"])
def s12_last(spark, sf):
    """A batch that holds every node many times, in the order of its lines: the last line's row stays."""
    path = scratch_path(spark, "store")
    e = V.v_events(spark, sf)
    nodes = e.select("session_id", "cluster_id", F.col("value").cast("double").alias("value"), "line_no")
    seen = e.groupBy("session_id", "cluster_id").agg(F.count("*").alias("seen"))
    none = e.where("false")
    edges = none.select("session_id", F.col("cluster_id").alias("src"), F.col("cluster_id").alias("dst"), "line_no")
    graph_store.upsert_graph(path, none.select("session_id", "line_no"), nodes, edges, order="line_no", buckets=8)
    return graph_store.read_graph(spark, path, "nodes").drop("line_no").join(seen, ["session_id", "cluster_id"])


@query("s13_load_graph", f"""
    WITH {seq_sql('v_items')},
    nd AS (SELECT session_id, cluster_id, CASE WHEN count(*) > 1 THEN count(*) END AS occ FROM seq GROUP BY 1, 2),
    ed AS (SELECT session_id, cluster_id AS src, next_cluster_id AS dst, CASE WHEN count(*) > 1 THEN count(*) END AS w FROM seq WHERE pos < n - 1 GROUP BY 1, 2, 3)
    SELECT nd.session_id, nd.cluster_id, coalesce(occ, 1) AS occurrence_count, 0 AS param_count, 0.0::DOUBLE AS param_num_mean, 0.0::DOUBLE AS param_num_max,
           dst, CASE WHEN dst IS NOT NULL THEN coalesce(w, 1) END AS weight, CASE WHEN dst IS NOT NULL THEN -1.0::DOUBLE END AS time_delta_s,
           CASE WHEN dst IS NOT NULL THEN 0.0::DOUBLE END AS time_delta_std
    FROM nd LEFT JOIN ed ON nd.session_id = ed.session_id AND nd.cluster_id = ed.src""", ["v_items"])
def s13(spark, sf):
    e = V.v_items(spark, sf)
    none_i, none_d = F.lit(None).cast("int"), F.lit(None).cast("double")
    many = lambda c: F.when(F.col(c) > 1, F.col(c))
    nodes = e.groupBy("session_id", "cluster_id").agg(F.count("*").alias("c")).select(
        "session_id", "cluster_id", many("c").alias("occurrence_count"), none_i.alias("param_count"),
        none_d.alias("param_num_mean"), none_d.alias("param_num_max"))
    edges = G.graph_edges_basic(e).select(
        "session_id", "src", "dst", many("weight").alias("weight"), none_d.alias("time_delta_s"), none_d.alias("time_delta_std"))
    return S.load_graph(nodes, edges)


@query("s16_export_results", """
    SELECT event_type, count(*) AS cnt, CAST(count(*) FILTER (is_anomaly) AS VARCHAR) AS bad FROM v_events GROUP BY 1""", ["v_events"])
def s16(spark, sf):
    path = scratch_path(spark, "report")
    e = V.v_events(spark, sf)
    report = e.groupBy("event_type").agg(F.count("*").alias("cnt"), F.count_if("is_anomaly").cast("string").alias("bad"))
    S.export_results(report, f"{path}/csv", "csv")
    S.export_results(report, f"{path}/json", "json")
    back = spark.read.csv(f"{path}/csv", header=True, schema="event_type string, cnt bigint, bad string")
    return back.intersect(spark.read.schema("event_type string, cnt bigint, bad string").json(f"{path}/json"))


@query("s17_cap_lines", "SELECT line_no, session_id FROM v_events WHERE line_no <= (SELECT count(*) FROM events) // 3", ["v_events"])
def s17(spark, sf):
    e = V.v_events(spark, sf)
    return L.cap_lines(e, e.count() // 3).select("line_no", "session_id")


@query("s17_subsample", "SELECT session_id, split FROM v_split QUALIFY row_number() OVER (PARTITION BY split ORDER BY session_id) <= 25", ["v_split"])
def s17b(spark, sf):
    return L.subsample(V.v_split(spark, sf).select("session_id", "split"), 25)


# --- text functions ---------------------------------------------------------

@query("f1_drop_unkeyed", f"""
    SELECT count(*) AS total, count(*) FILTER (line_no % 7 = 0) AS dropped, {s6('100.0 * count(*) FILTER (line_no % 7 = 0) / count(*)')} AS dropped_pct FROM v_events""", ["v_events"])
def f1(spark, sf):
    rows = V.v_raw_hdfs(spark, sf).withColumn("session_id", C.extract_block_id("value"))
    return rounded(K.unkeyed_report(rows), "dropped_pct")


@query("f2_mask_tokens", r"""
    SELECT line_no, regexp_replace(regexp_replace(value, 'blk_-?\d+', '<BLK>', 'g'), '/?\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?', '<IP>', 'g') AS masked
    FROM v_raw_hdfs""", ["v_raw_hdfs"])
def f2(spark, sf):
    return V.v_raw_hdfs(spark, sf).select("line_no", C.mask_tokens("value").alias("masked"))


@query("f2_mask_tokens_documents", r"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, 'blk_-?\d+', '<BLK>', 'g'), '/?\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?', '<IP>', 'g'),
           '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<UUID>', 'g')) AS masked_md5 FROM documents""")
def f2d(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.md5(C.mask_tokens("text")).alias("masked_md5"))


@query("f3_strip_header", f"SELECT line_no, {CONTENT} AS content FROM v_raw_hdfs", ["v_raw_hdfs"])
def f3(spark, sf):
    return V.v_raw_hdfs(spark, sf).select("line_no", C.strip_header("value").alias("content"))


ODD_TEXT = ["'nan'", "'-Infinity'", "{v} || 'd'", "{v} || 'f'", "'0x1p3'", "' ' || {v} || ' '", "'+' || {v}", "'1_' || '000'", "'.5'", "'5.'", "{v} || 'e5'", "''", "'abc'", "'1e999'", "{v}"]
ODD_CASE = "CASE line_no % 15 " + " ".join(f"WHEN {i} THEN {t.replace('{v}', 'CAST(value AS VARCHAR)')}" for i, t in enumerate(ODD_TEXT)) + " END"


@query("f4_is_numeric", f"""
    SELECT line_no, t, line_no % 15 IN (0, 1, 5, 6, 7, 8, 9, 10, 13, 14) AS as_float, line_no % 15 IN (5, 6, 7, 8, 9, 10, 14) AS finite
    FROM (SELECT line_no, {ODD_CASE} AS t FROM v_events)""", ["v_events"])
def f4(spark, sf):
    e = V.v_events(spark, sf).selectExpr("line_no", ODD_CASE.replace("AS VARCHAR", "AS STRING") + " AS t")
    return e.select("line_no", "t", C.is_numeric("t").alias("as_float"), C.is_numeric("t", finite_only=True).alias("finite"))


@query("f5_extract_parameters", f"WITH {MATCH} SELECT line_no, params FROM match WHERE cid IS NOT NULL", ["v_events"])
def f5(spark, sf):
    # The matching operator supplies the template; here only the extraction is checked.
    rows = T.match_templates(raw_hdfs(spark, sf), raw_catalog(spark, sf)).where(F.col("template").isNotNull())
    return rows.select("line_no", joined(C.extract_parameters("content", "template")).alias("params"))


@query("f6_keyword_flag", "SELECT DISTINCT cluster_id, contains(upper(template), 'ERROR') OR contains(upper(template), 'WARN') OR contains(upper(template), 'EXCEPTION') OR contains(upper(template), 'FAIL') AS flag FROM v_events", ["v_events"])
def f6(spark, sf):
    return V.v_events(spark, sf).select("cluster_id", C.keyword_flag("template").alias("flag")).distinct()


@query("f7_log_scale", f"SELECT line_no, {s6('ln(1 + abs(value - 100))')} AS scaled FROM v_events", ["v_events"])
def f7(spark, sf):
    return V.v_events(spark, sf).select("line_no", r6(C.log_scale(F.col("value") - 100)).alias("scaled"))


@query("f8_clip_nonneg", f"WITH {seq_sql('v_items')} SELECT session_id, line_no, CASE WHEN delta_us IS NOT NULL THEN greatest(delta_us, 0) END AS d FROM seq", ["v_items"])
def f8(spark, sf):
    p = K.with_sequence(V.v_items(spark, sf))
    return p.select("session_id", "line_no", C.clip_nonneg("delta_us").alias("d"))


@query("f9_finite_or", """
    SELECT line_no, CASE WHEN line_no % 15 IN (0, 1, 13) THEN 0.0 ELSE value END AS v,
           '0.0,' || CAST(value AS VARCHAR) AS arr FROM v_events""", ["v_events"])
def f9(spark, sf):
    m = F.col("line_no") % 15
    odd = F.when(m == 0, F.lit(float("nan"))).when(m == 1, F.lit(float("-inf"))).when(m == 13, F.lit(float("inf"))).otherwise(F.col("value"))
    arr = C.finite_array(F.array(F.lit(float("nan")), F.col("value")))
    return V.v_events(spark, sf).select("line_no", C.finite_or(odd).alias("v"), joined(arr).alias("arr"))


@query("f10_coerce_json", """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k, event_id % 5 = 0 AS is_null FROM events""")
def f10(spark, sf):
    e = V.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("broken "), "props")).otherwise(F.col("props"))
    rec = C.coerce_json(text, "k int")
    return e.select("event_id", rec["k"].alias("k"), rec.isNull().alias("is_null"))


@query("f11_pick_enrichment", """
    SELECT line_no, CASE WHEN line_no % 3 > 0 THEN 'large ' || value WHEN line_no % 2 = 0 THEN 'small ' || value END AS picked FROM v_events""", ["v_events"])
def f11(spark, sf):
    large = F.when(F.col("line_no") % 3 > 0, F.concat(F.lit("large "), F.col("value").cast("string")))
    small = F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("small "), F.col("value").cast("string")))
    return V.v_events(spark, sf).select("line_no", C.pick_enrichment(large, small).alias("picked"))


@query("f12_embedding_text", """
    SELECT line_no, coalesce(nullif(trim(CASE WHEN line_no % 3 = 0 THEN '  note ' || line_no || ' ' WHEN line_no % 3 = 1 THEN '  ' END), ''),
           nullif(trim(CASE WHEN line_no % 4 > 0 THEN ' ' || template ELSE '' END), ''), 'unknown log template') AS text FROM v_events""", ["v_events"])
def f12(spark, sf):
    m = F.col("line_no") % 3
    note = F.when(m == 0, F.concat(F.lit("  note "), "line_no", F.lit(" "))).when(m == 1, F.lit("  "))
    tpl = F.when(F.col("line_no") % 4 > 0, F.concat(F.lit(" "), "template")).otherwise(F.lit(""))
    return V.v_events(spark, sf).select("line_no", C.embedding_text(note, tpl).alias("text"))


@query("f13_template_context", """
    SELECT DISTINCT cluster_id, template, 'distributed file system' AS context, CAST(0 AS INT) AS relations, CAST(0 AS INT) AS docs FROM v_events""", ["v_events"])
def f13(spark, sf):
    cat = T.distinct_templates(V.v_events(spark, sf))
    out = T.template_context(cat, "hdfs", {"hdfs": "distributed file system", "bgl": "supercomputer"})
    return out.select("cluster_id", "template", "context", F.size("candidate_relations").alias("relations"), F.size("retrieved_docs").alias("docs"))


@query("f14_short_label", "SELECT DISTINCT cluster_id, left(trim(string_split(template, ':')[-1]), 12) AS label, left(template, 80) AS preview FROM v_events", ["v_events"])
def f14(spark, sf):
    return V.v_events(spark, sf).select("cluster_id", C.short_label("template", 12).alias("label"), C.preview("template").alias("preview")).distinct()


@query("f15_scan_raw", """
    SELECT count(*) AS total, count(*) FILTER (line_no <= 5000) AS inside, count(*) FILTER (line_no > 5000) AS beyond
    FROM v_raw_hdfs WHERE contains(value, 'blk_7')""", ["v_raw_hdfs"])
def f15(spark, sf):
    return T.scan_raw(V.v_raw_hdfs(spark, sf), "blk_7", 5000, raw="value")


# --- templates --------------------------------------------------------------

@query("j5_match_templates", f"WITH {MATCH} SELECT line_no, CAST(cid AS INT) AS cluster_id, CASE WHEN cid IS NOT NULL THEN tpl END AS template FROM match", ["v_events"])
def j5(spark, sf):
    return T.match_templates(raw_hdfs(spark, sf), raw_catalog(spark, sf)).select("line_no", "cluster_id", "template")


@query("j5_match_templates_shuffled", f"WITH {MATCH} SELECT line_no, CAST(cid AS INT) AS cluster_id FROM match", ["v_events"])
def j5b(spark, sf):
    """The way taken for a catalog too large to send to every executor."""
    return T.match_templates(raw_hdfs(spark, sf), raw_catalog(spark, sf), small=False).select("line_no", "cluster_id")


@query("j6_unmatched_lines", f"WITH {MATCH} SELECT line_no, content FROM match WHERE cid IS NULL", ["v_events"])
def j6(spark, sf):
    return T.unmatched_lines(raw_hdfs(spark, sf), raw_catalog(spark, sf)).select("line_no", "content")


# In these lines every bucket is one template whose variable positions differ, so the
# agreement miner and the positional one must both give what this SQL gives.
POSITIONAL = rf"""
    WITH m AS (SELECT line_no, string_split(regexp_replace(regexp_replace({CONTENT}, 'blk_-?\d+', '<BLK>', 'g'), '/?\d+\.\d+\.\d+\.\d+(:\d+)?', '<IP>', 'g'), ' ') AS t FROM v_raw_hdfs),
    b AS (SELECT len(t) AS n, t[1] || ' ' || t[2] AS lead, count(*) AS c, min(line_no) AS first_line FROM m GROUP BY 1, 2),
    x AS (SELECT len(t) AS n, t[1] || ' ' || t[2] AS lead, unnest(t) AS w, unnest(range(1, len(t) + 1)) AS i FROM m),
    y AS (SELECT n, lead, i, CASE WHEN count(DISTINCT w) > 1 THEN '<*>' ELSE min(w) END AS w FROM x GROUP BY 1, 2, 3),
    z AS (SELECT n, lead, string_agg(w, ' ' ORDER BY i) AS template FROM y GROUP BY 1, 2)
    SELECT CAST(row_number() OVER (ORDER BY first_line) AS INT) AS cluster_id, template, c AS count, first_line FROM b JOIN z ON b.n = z.n AND b.lead = z.lead"""


@query("t1_mine_templates", POSITIONAL, ["v_raw_hdfs"])
def t1(spark, sf):
    return T.mine_templates(raw_hdfs(spark, sf))


# One round of the splitting rule: tokens per position, what each group comes to, and the parts of the open ones.
_ROUND = """
    c{k} AS (SELECT grp, i, count(DISTINCT w) AS words, min(w) AS w FROM (SELECT grp, unnest(t) AS w, unnest(range(8)) AS i FROM g{k}) GROUP BY grp, i),
    s{k} AS (SELECT grp, count(*) FILTER (words = 1 AND w <> '<*>') / 8.0 >= 0.8 OR max(words) = 1 AS done, arg_min(i, words * 100 + i) FILTER (words > 1) AS at_pos,
                    string_agg(CASE WHEN words = 1 THEN w ELSE '<*>' END, ' ' ORDER BY i) AS template FROM c{k} GROUP BY grp),
    f{k} AS (SELECT template, count(*) AS c, min(line_no) AS line FROM g{k} JOIN s{k} USING (grp) WHERE done GROUP BY grp, template),
    g{n} AS (SELECT grp || ' ' || at_pos || '=' || t[at_pos + 1] AS grp, t, line_no FROM g{k} JOIN s{k} USING (grp) WHERE NOT done)"""


@query("t1_mine_templates_split", f"""
    WITH g0 AS (SELECT 'all' AS grp, line_no, ['INFO', 'item:', l_returnflag, l_linestatus, 'of', chr(CAST(97 + l_suppkey % 7 AS INT)), chr(CAST(97 + l_partkey % 19 AS INT)), 'end'] AS t
                FROM (SELECT *, CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS line_no FROM lineitem)),
    {",".join(_ROUND.format(k=k, n=k + 1) for k in range(6))},
    f AS ({" UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(6))})
    SELECT template, CAST(sum(c) AS BIGINT) AS count, min(line) AS first_line FROM f GROUP BY template""")
def t1s(spark, sf):
    """Messages of one bucket that agree in too few positions: several rounds, many templates."""
    li = V.table(spark, sf, "lineitem")
    letter = lambda c, k: F.chr(F.lit(97) + F.col(c) % k)
    words = [F.lit("INFO"), F.lit("item:"), "l_returnflag", "l_linestatus", F.lit("of"), letter("l_suppkey", 7), letter("l_partkey", 19), F.lit("end")]
    rows = li.select((F.col("l_orderkey").cast("bigint") * 10 + F.col("l_linenumber")).alias("line_no"), F.concat_ws(" ", *words).alias("content"))
    return T.mine_templates(rows, 0.8).select("template", "count", "first_line")


@query("t2_mine_templates_positional", POSITIONAL, ["v_raw_hdfs"])
def t2(spark, sf):
    return T.mine_templates_positional(raw_hdfs(spark, sf))


@query("t3_template_catalog", CATALOG_SQL, ["v_events"])
def t3(spark, sf):
    return event_catalog(spark, sf).withColumn("examples", joined("examples"))


@query("t4_annotate", f"""
    WITH {MATCH} SELECT line_no, CAST(cid AS INT) AS cluster_id, CASE WHEN cid IS NOT NULL THEN params END AS params,
           CASE WHEN line_no % 7 > 0 THEN session_id END AS block_id FROM match""", ["v_events"])
def t4(spark, sf):
    return T.annotate(raw_hdfs(spark, sf), raw_catalog(spark, sf)).select("line_no", "cluster_id", joined("parameters").alias("params"), "block_id")


@query("t5_validate_templates", f"""
    WITH {MATCH}, c AS (SELECT cid, tpl, count(*) AS k FROM match WHERE cid IS NOT NULL GROUP BY 1, 2),
    h AS (SELECT k, len(regexp_extract_all(tpl, '<[A-Z*]+>')) AS holes, len(string_split(tpl, ' ')) AS size FROM c)
    SELECT count(*) AS templates, {s6('avg(CAST(k = 1 AS INT))')} AS singleton_fraction, count(*) FILTER (holes / size > 0.7) AS too_generic,
           count(*) FILTER (k = 1 AND holes = 0) AS too_specific, (SELECT {s6('avg(CAST(cid IS NOT NULL AS INT))')} FROM match) AS coverage FROM h""", ["v_events"])
def t5(spark, sf):
    m = T.match_templates(raw_hdfs(spark, sf), raw_catalog(spark, sf))
    counts = m.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id", "template").agg(F.count("*").alias("count"))
    return rounded(T.validate_templates(counts, m), "singleton_fraction", "coverage")


@query("t6_block_coverage", f"""
    WITH {MATCH} SELECT count(*) AS total, count(cid) AS matched, count(*) - count(cid) AS unmatched FROM match
    WHERE contains(content, 'blk_7') """, ["v_events"])
def t6(spark, sf):
    return T.block_coverage(raw_hdfs(spark, sf), raw_catalog(spark, sf), "blk_7")


def stub_enricher(batches):
    """Stands in for a model call: a record built from the template text."""
    for pdf in batches:
        yield pd.DataFrame({
            "cluster_id": pdf["cluster_id"],
            "enriched": [json.dumps({"component": t.split(":")[0].split(" ")[-1], "purpose": t}) for t in pdf["template"]],
        })


@query("t7_enrich_templates", """
    SELECT DISTINCT cluster_id, CASE WHEN cluster_id <= 2 THEN 'stored' ELSE 'app.' || event_type END AS component FROM v_events""", ["v_events"])
def t7(spark, sf):
    cat = T.distinct_templates(V.v_events(spark, sf))
    stored = cat.where("cluster_id <= 2").select("cluster_id", F.lit('{"component": "stored"}').alias("enriched"))
    out = T.enrich_templates(cat, stub_enricher, "large", stored)
    return out.select("cluster_id", C.coerce_json("enriched_large", T.ENRICHED_SCHEMA)["component"].alias("component"))


@query("t8_validate_enrichment", """
    SELECT count(*) AS total, count(*) FILTER (event_id % 4 = 0) AS missing, count(*) FILTER (event_id % 4 = 1) AS malformed,
           count(*) FILTER (event_id % 4 = 2) AS incomplete, count(*) FILTER (event_id % 4 = 3) AS valid FROM events""")
def t8(spark, sf):
    m = F.col("event_id") % 4
    full = F.to_json(F.struct(
        *[F.col("event_type").alias(c) for c in ("component", "component_role", "log_level", "purpose")],
        *[F.array(F.lit("a")).alias(c) for c in ("expected_sequence", "anomaly_indicators", "related_templates")],
        *[F.array(F.create_map(F.lit("name"), F.lit("x"))).alias(c) for c in ("fields", "failure_modes")]))
    text = F.when(m == 1, F.lit("{not json")).when(m == 2, F.col("props")).when(m == 3, full)
    return T.validate_enrichment(V.table(spark, sf, "events").select(text.alias("enriched")), "enriched")


# --- lookups ----------------------------------------------------------------

@query("j1_attach_template", "SELECT line_no, cluster_id, CASE WHEN cluster_id < 5 THEN template ELSE '' END AS template FROM v_events", ["v_events"])
def j1(spark, sf):
    e = V.v_events(spark, sf)
    cat = T.distinct_templates(e).where("cluster_id < 5")
    return J.attach_template(e.select("line_no", "cluster_id"), cat).select("line_no", "cluster_id", "template")


@query("j3_attach_label", "SELECT session_id, label, label_defaulted FROM v_labels", ["v_labels"])
def j3(spark, sf):
    d = V.table(spark, sf, "documents").select(F.col("doc_id").alias("session_id"))
    lab = V.table(spark, sf, "labels").select(F.col("doc_id").alias("session_id"), F.col("toxic").alias("label"))
    return J.attach_label(d, lab)


@query("j4_flag_error_sessions", "SELECT DISTINCT session_id FROM v_events WHERE cluster_id = 2 AND value > 200", ["v_events"])
def j4(spark, sf):
    e = V.v_mild_events(spark, sf)
    return J.flag_error_sessions(e, J.error_clusters(T.distinct_templates(e)))


@query("j12_attach_enrichment", """
    SELECT DISTINCT cluster_id, template, CASE WHEN cluster_id % 2 = 1 THEN upper(event_type) END AS enriched FROM v_events""", ["v_events"])
def j12(spark, sf):
    e = V.v_events(spark, sf)
    enriched = e.where("cluster_id % 2 = 1").select("cluster_id", F.upper("event_type").alias("enriched")).distinct()
    return J.attach_enrichment(T.distinct_templates(e), enriched)


@query("u3_distinct_templates", "SELECT DISTINCT cluster_id, template FROM v_events", ["v_events"])
def u3(spark, sf):
    return T.distinct_templates(V.v_events(spark, sf))
