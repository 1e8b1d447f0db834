"""Queries over embeddings, datasets, scoring, evaluation and lineage."""

import numpy as np
from pyspark.sql import functions as F

from weftlog.operators import dataset as D
from weftlog.operators import embeddings as B
from weftlog.operators import evaluation as E
from weftlog.operators import graphs as G
from weftlog.operators import lineage as X
from weftlog.operators import lookups as J
from weftlog.operators import scoring as M
from weftlog.operators import sessions as K
from weftlog.operators import templates as T
from weftlog.operators.skew import dealt, hot_keys, ordered
from weftlog.plans import views as V
from weftlog.plans.ingest_queries import event_catalog
from weftlog.plans.registry import joined, query, r6, rounded, s6
from weftlog.plans.session_queries import seq_sql
from weftlog.session import bucketed, scratch_path
from weftlog.sources import tables as S

VEC = "[CAST(x AS DOUBLE) FOR x IN embedding]"
ZERO_IF_NO_EDGE = "CASE WHEN delta_us IS NOT NULL THEN delta_us END"


def vectors(spark, sf):
    return V.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("session_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def is_train(df):
    return df.where(F.col("session_id") % 20 < 14)


# --- embeddings -------------------------------------------------------------

TFIDF = """
    t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\\s]+')) AS token FROM documents),
    tf AS (SELECT doc_id, token, count(*) AS tf FROM t GROUP BY 1, 2),
    df AS (SELECT token, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (count(*) + 1.0::DOUBLE)) + 1 AS idf FROM tf GROUP BY 1),
    w AS (SELECT doc_id, tf.token, tf, idf, tf * idf AS w FROM tf JOIN df ON tf.token = df.token),
    nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS s FROM w GROUP BY 1)"""


def doc_tfidf(spark, sf):
    return B.tfidf(V.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query("b1_tfidf", f"""
    WITH {TFIDF} SELECT w.doc_id, token, tf, {s6('idf')} AS idf, {s6('w / s')} AS weight FROM w JOIN nrm ON w.doc_id = nrm.doc_id""")
def b1(spark, sf):
    return rounded(doc_tfidf(spark, sf), "idf", "weight")


@query("b2_vocabulary", f"WITH {TFIDF} SELECT token, row_number() OVER (ORDER BY token) - 1 AS col, {s6('idf')} AS idf FROM df")
def b2(spark, sf):
    return rounded(B.vocabulary(B.count_terms(V.table(spark, sf, "documents"), "doc_id")), "idf")


CONV_TEXTS = "SELECT role || ' ' || (conv_id % 10) AS id, string_agg(DISTINCT role || turn, ' ') AS text FROM conversations GROUP BY 1"


def role_texts(spark, sf):
    """A small vocabulary: which (role, turn) words occur in each slice of the conversations."""
    c = V.table(spark, sf, "conversations")
    words = c.select(F.concat_ws(" ", "role", (F.col("conv_id") % 10).cast("string")).alias("id"), F.concat("role", "turn").alias("w")).distinct()
    return words.groupBy("id").agg(F.array_join(F.collect_list("w"), " ").alias("text"))


@query("b2_tfidf_dense", f"""
    WITH src AS ({CONV_TEXTS}), t AS (SELECT id, unnest(string_split(lower(text), ' ')) AS token FROM src),
    df AS (SELECT token, ln((1.0::DOUBLE + (SELECT count(*) FROM src)) / (count(*) + 1.0::DOUBLE)) + 1 AS idf FROM t GROUP BY 1),
    v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS col FROM df),
    w AS (SELECT id, t.token, idf / sqrt(sum(idf * idf) OVER (PARTITION BY id)) AS w FROM t JOIN df ON t.token = df.token)
    SELECT id, CAST((SELECT count(*) FROM v) AS INT) AS dim, {s6('sum(w * (col + 1))')} AS weighted_sum FROM w JOIN v ON w.token = v.token GROUP BY id""")
def b2d(spark, sf):
    sparse = B.tfidf(role_texts(spark, sf), "id")
    dense = B.tfidf_dense(sparse, B.vocabulary(sparse), id="id")
    total = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return dense.select("id", F.size("embedding").alias("dim"), r6(total).alias("weighted_sum"))


@query("b3_cosine_similarity", f"""
    WITH e AS (SELECT vec_id, {VEC} AS v FROM embeddings),
    p AS (SELECT a.vec_id AS query, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
    SELECT query, id, {s6('s')} AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS INT) AS rank FROM p
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, id) <= 10""")
def b3(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return rounded(B.nearest(e, e.where("vec_id % 100 = 0"), 10, "vec_id"), "similarity")


@query("b4_similarity_correlation", f"""
    WITH e AS (SELECT vec_id, {VEC} AS v FROM embeddings),
    w AS (SELECT vec_id, v, list_transform(v, lambda x: x * x) AS q FROM e),
    p AS (SELECT list_cosine_similarity(a.v, b.v) AS x, list_cosine_similarity(a.q, b.q) AS y FROM w a JOIN w b ON a.vec_id < b.vec_id)
    SELECT {s6('corr(x, y)')} AS correlation, count(*) AS pairs FROM p""")
def b4(spark, sf):
    e = V.table(spark, sf, "embeddings")
    squares = e.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * x).alias("embedding"))
    return rounded(B.similarity_correlation(e, squares, "vec_id"), "correlation")


@query("b5_vectors_from_table", f"""
    WITH e AS (SELECT vec_id, {VEC} AS v FROM embeddings)
    SELECT vec_id, {s6('v[1] / sqrt(list_dot_product(v, v))')} AS first, {s6('list_sum(v) / sqrt(list_dot_product(v, v))')} AS total FROM e""")
def b5(spark, sf):
    e = B.clean_vectors(V.table(spark, sf, "embeddings"))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", r6(F.col("embedding")[0]).alias("first"), r6(total).alias("total"))


def count_encoder(texts):
    """Stands in for a sentence encoder: a few character counts."""
    return np.array([[len(t), t.count(" "), t.count("."), 1.0] for t in texts])


@query("b5_encode_texts", f"""
    WITH c AS (SELECT doc_id, length(text) AS a, length(text) - length(replace(text, ' ', '')) AS b, length(text) - length(replace(text, '.', '')) AS c FROM documents)
    SELECT doc_id, {s6('a / sqrt(a * a + b * b + c * c + 1)')} AS x1, {s6('b / sqrt(a * a + b * b + c * c + 1)')} AS x2, {s6('c / sqrt(a * a + b * b + c * c + 1)')} AS x3 FROM c""")
def b5e(spark, sf):
    e = B.encode_texts(V.table(spark, sf, "documents"), count_encoder, "doc_id")
    return e.select("doc_id", *[r6(F.col("embedding")[i]).alias(f"x{i + 1}") for i in range(3)])


@query("b6_hybrid_embeddings", f"""
    WITH e AS (SELECT vec_id, {VEC} AS v FROM embeddings)
    SELECT vec_id, CAST(128 AS INT) AS dim, {s6('list_sum(list_transform(v, lambda x: x * x)) + CASE WHEN vec_id % 3 > 0 THEN list_sum(v) ELSE 0 END')} AS total FROM e""")
def b6(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    lexical = e.select("vec_id", F.transform("embedding", lambda x: x * x).alias("embedding"))
    h = B.hybrid_embeddings(lexical, e.where("vec_id % 3 > 0"), 64, "vec_id")
    return h.select("vec_id", F.size("embedding").alias("dim"), r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def cluster_vectors(spark, sf):
    """The whole table as vectors of templates."""
    return V.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("int").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("embedding"))


@query("j2_attach_embedding", f"""
    SELECT v.line_no, v.cluster_id, CAST(64 AS INT) AS dim, {s6(f'coalesce(list_sum({VEC}), 0)')} AS total
    FROM (SELECT line_no, CASE WHEN line_no % 11 = 0 THEN -cluster_id ELSE cluster_id * 7 END AS cluster_id FROM v_events) v LEFT JOIN embeddings e ON v.cluster_id = e.vec_id""", ["v_events"])
def j2(spark, sf):
    """Ids from all over the table; negative ones are unknown."""
    ids = F.when(F.col("line_no") % 11 == 0, -F.col("cluster_id")).otherwise(F.col("cluster_id") * 7).alias("cluster_id")
    n = J.attach_embedding(V.v_events(spark, sf).select("line_no", ids), cluster_vectors(spark, sf), 64)
    return n.select("line_no", "cluster_id", F.size("embedding").alias("dim"), r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("j11_dense_sequence", f"""
    WITH {seq_sql('v_events')}
    SELECT session_id, CAST(16 AS INT) AS steps, {s6(f'sum(coalesce(list_sum({VEC}), 0) * (pos + 1))')} AS total
    FROM seq LEFT JOIN embeddings e ON CASE WHEN cluster_id = 5 THEN -5 ELSE cluster_id * 9 END = e.vec_id WHERE pos < 16 GROUP BY session_id""", ["v_events"])
def j11(spark, sf):
    e = V.v_events(spark, sf).withColumn("cluster_id", F.when(F.col("cluster_id") == 5, -5).otherwise(F.col("cluster_id") * 9))
    s = J.dense_sequence(D.padded_sequences(e, 16), cluster_vectors(spark, sf), 64)
    step = F.transform("vectors", lambda v, i: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) * (i + 1))
    return s.select("session_id", F.size("vectors").alias("steps"), r6(F.aggregate(step, F.lit(0.0), lambda a, x: a + x)).alias("total"))


# --- dataset ----------------------------------------------------------------

PADDED = """rtrim(string_agg(CASE WHEN pos < {L} THEN CAST(cluster_id AS VARCHAR) || ',' ELSE '' END, '' ORDER BY pos) || repeat('-1,', CAST(greatest({L} - max(n), 0) AS INT)), ',')"""


@query("f16_truncate_pad", f"WITH {seq_sql('v_items')} SELECT session_id, {PADDED.replace('{L}', '4')} AS cids FROM seq GROUP BY session_id", ["v_items"])
def f16(spark, sf):
    return D.padded_sequences(V.v_items(spark, sf), 4).select("session_id", joined("cids").alias("cids"))


@query("d1_resolve_labels_heuristic", """
    SELECT session_id, CAST(max(CASE WHEN cluster_id = 2 AND value > 200 THEN 1 ELSE 0 END) AS INT) AS label, 'heuristic' AS labels_source
    FROM v_events GROUP BY session_id""", ["v_events"])
def d1h(spark, sf):
    e = V.v_mild_events(spark, sf)
    return D.resolve_labels(e, catalog=T.distinct_templates(e)).select("session_id", "label", "labels_source")


@query("d1_resolve_labels", "SELECT session_id, label, label_defaulted, 'ground_truth' AS labels_source FROM v_labels", ["v_labels"])
def d1(spark, sf):
    docs = V.v_doc_lines(spark, sf).select(F.col("doc_id").alias("session_id"))
    lab = V.table(spark, sf, "labels").select(F.col("doc_id").alias("session_id"), F.col("toxic").alias("label"))
    return D.resolve_labels(docs, lab)


SPLIT_SQL = """
    c AS (SELECT label, count(*) AS k, sum(count(*)) OVER () AS n FROM v_labels GROUP BY label),
    s AS (SELECT *, CAST(n - ceil(round(0.3 * n, 9)) AS BIGINT) AS n_train, CAST(ceil(round(0.5 * ceil(round(0.3 * n, 9)), 9)) AS BIGINT) AS n_test FROM c),
    q AS (SELECT *, floor(k * n_train / n) AS f, k * n_train / n - floor(k * n_train / n) AS r FROM s),
    tr AS (SELECT *, CAST(f AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY r DESC, label) <= n_train - sum(CAST(f AS BIGINT)) OVER () THEN 1 ELSE 0 END AS t FROM q),
    l AS (SELECT *, k - t AS k2, n - n_train AS m, n - n_train - n_test AS n_val FROM tr),
    q2 AS (SELECT *, floor(k2 * n_val / m) AS f2, k2 * n_val / m - floor(k2 * n_val / m) AS r2 FROM l),
    va AS (SELECT *, CAST(f2 AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY r2 DESC, label) <= n_val - sum(CAST(f2 AS BIGINT)) OVER () THEN 1 ELSE 0 END AS v FROM q2),
    rk AS (SELECT session_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || session_id), session_id) - 1 AS p FROM v_labels),
    ds AS (SELECT session_id, rk.label, CASE WHEN p < t THEN 'train' WHEN p < t + v THEN 'val' ELSE 'test' END AS split FROM rk JOIN va ON rk.label = va.label)"""


@query("d2_stratified_split", f"WITH {SPLIT_SQL} SELECT * FROM ds", ["v_labels"])
def d2(spark, sf):
    return D.stratified_split(V.v_labels(spark, sf).select("session_id", "label"))


@query("d3_choose_max_len", f"""
    SELECT {s6('quantile_cont(c, 0.5)')} AS p50, {s6('quantile_cont(c, 0.95)')} AS p95, {s6('quantile_cont(c, 0.99)')} AS p99, min(c) AS min, {s6('avg(c)')} AS mean, max(c) AS max,
           CAST(floor(quantile_cont(c, 0.99)) AS INT) AS max_len FROM (SELECT count(*) AS c FROM v_events GROUP BY session_id)""", ["v_events"])
def d3(spark, sf):
    return rounded(D.choose_max_len(K.session_lengths(V.v_events(spark, sf))), "p50", "p95", "p99", "mean")


@query("d4_padded_sequences", f"""
    WITH {seq_sql('v_events')} SELECT session_id, {PADDED.replace('{L}', '70')} AS cids, CAST(least(max(n), 70) AS INT) AS length,
           CAST(max(user_id) % 2 AS INT) AS label FROM seq GROUP BY session_id""", ["v_events"])
def d4(spark, sf):
    e = V.v_events(spark, sf)
    lab = e.where("user_id % 2 = 1").select("session_id", F.lit(1).alias("label")).distinct()
    return D.padded_sequences(e, 70, lab).select("session_id", joined("cids").alias("cids"), "length", "label")


DIMS = f"dims AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest({VEC}) AS x FROM embeddings)"


@query("d5_fit_scaler", f"""
    WITH {DIMS}, f AS (SELECT i, avg(x) AS m, greatest(stddev_samp(x), 0.12) AS s, stddev_samp(x) < 0.12 AS low FROM dims WHERE vec_id % 20 < 14 GROUP BY i)
    SELECT i - 1 AS dim, {s6('m')} AS mean, {s6('s')} AS std, CAST((SELECT count(*) FROM f WHERE low) AS INT) AS floored FROM f""")
def d5(spark, sf):
    s = D.fit_scaler(is_train(vectors(spark, sf)), floor=0.12)
    rows = s.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "z"), "floored")
    return rows.select(F.col("dim").cast("bigint").alias("dim"), r6("z.mean").alias("mean"), r6("z.std").alias("std"), "floored")


@query("d6_apply_scaler", f"""
    WITH {DIMS}, f AS (SELECT i, avg(x) AS m, greatest(stddev_samp(x), 0.1) AS s FROM dims WHERE vec_id % 20 < 14 GROUP BY i)
    SELECT vec_id AS session_id, {s6('sum((x - m) / s)')} AS total, {s6('sum((x - m) / s * ((x - m) / s))')} AS squares FROM dims JOIN f ON dims.i = f.i GROUP BY 1""")
def d6(spark, sf):
    v = vectors(spark, sf)
    out = D.apply_scaler(v, D.fit_scaler(is_train(v)))
    add = lambda f: F.aggregate("vec", F.lit(0.0), f)
    return out.select("session_id", r6(add(lambda a, x: a + x)).alias("total"), r6(add(lambda a, x: a + x * x)).alias("squares"))


@query("d7_batch_standardise", f"""
    WITH {DIMS}, f AS (SELECT i, avg(x) AS m, sqrt(var_pop(x) + 1e-5) AS s FROM dims WHERE vec_id % 20 < 14 GROUP BY i)
    SELECT vec_id AS session_id, {s6('sum((x - m) / s)')} AS total, {s6('sum((x - m) / s * ((x - m) / s))')} AS squares FROM dims JOIN f ON dims.i = f.i GROUP BY 1""")
def d7(spark, sf):
    v = vectors(spark, sf)
    out = D.apply_scaler(v, D.fit_batch_norm(is_train(v)))
    add = lambda f: F.aggregate("vec", F.lit(0.0), f)
    return out.select("session_id", r6(add(lambda a, x: a + x)).alias("total"), r6(add(lambda a, x: a + x * x)).alias("squares"))


FLAGS = """len AS (SELECT session_id, count(*) AS c FROM v_events GROUP BY 1),
    err AS (SELECT DISTINCT session_id FROM v_events WHERE cluster_id = 2 AND value > 200),
    fl AS (SELECT len.session_id, c, err.session_id IS NOT NULL AS e, c > (SELECT quantile_cont(c, 0.99) FROM len) AS l FROM len LEFT JOIN err ON len.session_id = err.session_id)"""


def stage1(spark, sf):
    e = V.v_mild_events(spark, sf)
    lengths = K.session_lengths(e)
    return lengths, D.stage1_flags(e, T.distinct_templates(e), lengths)


@query("u1_stage1_flags", f"WITH {FLAGS} SELECT session_id, CAST(e AS INT) AS by_error, CAST(l AS INT) AS by_length FROM fl WHERE e OR l", ["v_events"])
def u1(spark, sf):
    return stage1(spark, sf)[1]


@query("u1_stage1_summary", f"""
    WITH {FLAGS} SELECT count(*) AS sessions, count(*) FILTER (e) AS by_error, count(*) FILTER (l) AS by_length,
           count(*) FILTER (e OR l) AS flagged, count(*) FILTER (NOT e AND NOT l) AS remaining FROM fl""", ["v_events"])
def u1s(spark, sf):
    return D.stage1_summary(*stage1(spark, sf))


OVERLAP = """{v} AS (SELECT session_id, label, split FROM v_split UNION ALL SELECT session_id, label, 'test' FROM v_split WHERE session_id % 50 = 0)"""


def overlapping(spark, sf):
    s = V.v_split(spark, sf).select("session_id", "label", "split")
    return s.unionByName(s.where("session_id % 50 = 0").withColumn("split", F.lit("test")))


@query("u2_split_overlap", f"""
    WITH {OVERLAP.format(v='o')}, p AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) x(a, b))
    SELECT a || '_' || b AS pair, (SELECT count(*) FROM (SELECT session_id FROM o WHERE split = a INTERSECT SELECT session_id FROM o WHERE split = b)) AS shared,
           CASE WHEN (SELECT count(*) FROM (SELECT session_id FROM o WHERE split = a INTERSECT SELECT session_id FROM o WHERE split = b)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM p""", ["v_split"])
def u2(spark, sf):
    return D.split_overlap(overlapping(spark, sf))


@query("u2_shared_lines", """
    WITH w AS (SELECT line_no, unnest(range(CAST(floor((unix_ts - 21600) / 7200.0) AS BIGINT) + 1, CAST(floor(unix_ts / 7200.0) AS BIGINT) + 1)) AS window_id FROM v_events),
    s AS (SELECT line_no, count(DISTINCT CASE WHEN window_id % 20 < 14 THEN 1 WHEN window_id % 20 < 17 THEN 2 ELSE 3 END) AS k FROM w GROUP BY 1)
    SELECT count(*) AS lines, count(*) FILTER (k > 1) AS shared_lines FROM s""", ["v_events"])
def u2l(spark, sf):
    w = K.sessions_by_window(V.v_events(spark, sf).drop("window_id"), 21_600, 7_200)
    m = F.col("window_id") % 20
    split = w.select("window_id").distinct().withColumn("split", F.when(m < 14, "train").when(m < 17, "val").otherwise("test"))
    return D.shared_lines(w, split)


@query("u4_clean_train", "SELECT session_id, label FROM v_split WHERE split = 'train' AND label = 0", ["v_split"])
def u4(spark, sf):
    return D.clean_train(V.v_split(spark, sf)).select("session_id", "label")


@query("j7_align_split", "SELECT v.session_id, length(text) AS n, split FROM v_split v JOIN documents d ON v.session_id = d.doc_id", ["v_split"])
def j7(spark, sf):
    seqs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("session_id"), F.length("text").cast("bigint").alias("n"))
    return D.align_split(seqs, V.v_split(spark, sf))


@query("a13_split_summary", f"SELECT split, count(*) AS size, CAST(sum(label) AS BIGINT) AS anomalous, {s6('100.0 * avg(label)')} AS anomaly_pct FROM v_split GROUP BY split", ["v_split"])
def a13(spark, sf):
    return rounded(D.split_summary(V.v_split(spark, sf)), "anomaly_pct")


@query("a14_data_sanity", f"""
    WITH {seq_sql('v_items')}, p AS (SELECT session_id, count(*) AS c, bool_or(l_quantity > 49) AS bn, bool_or(l_extendedprice > 80000 AND pos < n - 1) AS be FROM seq GROUP BY 1)
    SELECT count(*) AS sessions, count(*) FILTER (bn) AS bad_node_sessions, count(*) FILTER (be AND c > 1) AS bad_edge_sessions, count(*) FILTER (c = 1) AS zero_edge_sessions,
           {s6('100.0 * count(*) FILTER (c = 1) / count(*)')} AS zero_edge_pct FROM p""", ["v_items"])
def a14(spark, sf):
    e = K.with_sequence(V.v_items(spark, sf))
    bad = lambda cond, col, junk: F.array(F.lit(1.0), F.when(cond, F.lit(junk)).otherwise(F.col(col)))
    nodes = e.select("session_id", bad(F.col("l_quantity") > 49, "l_quantity", float("nan")).alias("vec"))
    edges = e.where("pos < n - 1").select("session_id", bad(F.col("l_extendedprice") > 80000, "l_quantity", float("inf")).alias("vec"))
    return rounded(D.data_sanity(nodes, edges, strict=False), "zero_edge_pct")


@query("a15_dataset_meta", f"""
    SELECT count(*) AS sessions, CAST(sum(label) AS BIGINT) AS anomalous, {s6('avg(label)')} AS anomaly_rate, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
           count(*) FILTER (split = 'test') AS n_test, 'ground_truth' AS labels_source, CAST(32 AS INT) AS max_seq_len, CAST(64 AS INT) AS embed_dim, CAST(73 AS INT) AS node_dim, CAST(10 AS INT) AS edge_dim,
           {", ".join(f"count(*) FILTER (split = '{p}' AND label = 1) AS anomalous_{p}" for p in ("train", "val", "test"))},
           CAST(41 AS BIGINT) AS n_templates, CAST(42 AS INT) AS seed, '20260101_0900' AS run_tag FROM v_split""", ["v_split"])
def a15(spark, sf):
    return rounded(D.dataset_meta(V.v_split(spark, sf), 32, 64, n_templates=41, run_tag="20260101_0900"), "anomaly_rate")


def event_bundle(spark, sf):
    e = V.v_events(spark, sf)
    labels = D.resolve_labels(e, e.where("user_id % 9 = 0").select("session_id", F.lit(1).alias("label")).distinct())
    split = D.stratified_split(labels.select("session_id", "label"))
    seqs = D.align_split(D.padded_sequences(e, 64, labels), split)
    emb = cluster_vectors(spark, sf)
    tables = {"nodes": G.graph_nodes(e), "edges": G.graph_edges(e), "sequences": seqs, "embeddings": emb}
    return tables, D.dataset_meta(split, 64, 64)


@query("s14_write_dataset", """
    SELECT count(*) AS sessions, CAST(sum(CASE WHEN user_id % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS anomalous, CAST(64 AS INT) AS width FROM (SELECT DISTINCT user_id FROM events)""")
def s14(spark, sf):
    path = scratch_path(spark, "bundle")
    S.write_dataset(path, *event_bundle(spark, sf))
    return spark.read.parquet(f"{path}/sequences").agg(
        F.count("*").alias("sessions"), F.sum("label").alias("anomalous"), F.max(F.size("cids")).alias("width"))


@query("s15_verify_dataset", """
    WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events)
    SELECT 'sessions' AS "check", n AS expected, n AS found, true AS ok FROM n UNION ALL SELECT 'max_seq_len', 64, 64, true UNION ALL SELECT 'min_seq_len', 64, 64, true
    UNION ALL SELECT 'embed_dim', 64, 64, true UNION ALL SELECT 'n_train', n - CAST(ceil(round(0.3 * n, 9)) AS BIGINT), n - CAST(ceil(round(0.3 * n, 9)) AS BIGINT), true FROM n
    UNION ALL SELECT 'n_val', CAST(floor(ceil(round(0.3 * n, 9)) / 2) AS BIGINT), CAST(floor(ceil(round(0.3 * n, 9)) / 2) AS BIGINT), true FROM n
    UNION ALL SELECT 'n_test', CAST(ceil(ceil(round(0.3 * n, 9)) / 2) AS BIGINT), CAST(ceil(ceil(round(0.3 * n, 9)) / 2) AS BIGINT), true FROM n""")
def s15(spark, sf):
    path = scratch_path(spark, "bundle")
    S.write_dataset(path, *event_bundle(spark, sf))
    return S.verify_dataset(spark, path)


# --- scoring ----------------------------------------------------------------

@query("m1_fit_vector_reconstructor")
def m1(spark, sf):
    v = vectors(spark, sf)
    model = M.fit_vector_reconstructor(D.apply_scaler(is_train(v), D.fit_scaler(is_train(v))), 8)
    parts = [(i, float(x)) for i, x in enumerate(model.explainedVariance.toArray())]
    return spark.createDataFrame(parts, "component int, explained double")


@query("m2_reconstruction_error")
def m2(spark, sf):
    v = vectors(spark, sf)
    scaled = D.apply_scaler(v, D.fit_scaler(is_train(v)))
    return M.reconstruction_error(scaled, M.fit_vector_reconstructor(is_train(scaled), 8)).select("session_id", "error")


# Two dimensions, where the first component has a closed form: the angle whose double has the tangent 2b / (a - d).
TWO = f"""v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) + 0.5::DOUBLE * CAST(embedding[1] AS DOUBLE) AS y FROM embeddings),
    f AS (SELECT avg(x) AS mx, avg(y) AS my, greatest(stddev_samp(x), 0.1) AS sx, greatest(stddev_samp(y), 0.1) AS sy FROM v WHERE vec_id % 20 < 14),
    z AS (SELECT vec_id, (x - mx) / sx AS x, (y - my) / sy AS y FROM v, f),
    c AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM z WHERE vec_id % 20 < 14),
    t AS (SELECT *, 0.5::DOUBLE * atan2(2 * b, a - d) AS angle, sqrt((a - d) * (a - d) + 4 * b * b) AS gap FROM c)"""


def plane(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("session_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = e.select("session_id", F.array(F.col("v")[0], F.col("v")[1] + F.col("v")[0] * 0.5).alias("vec"))
    scaled = D.apply_scaler(v, D.fit_scaler(is_train(v)))
    return scaled, M.fit_vector_reconstructor(is_train(scaled), 1)


@query("m1_two_dimensions", f"""
    WITH {TWO} SELECT {s6('(a + d + gap) / 2 / (a + d)')} AS explained, {s6('abs(cos(angle))')} AS first_x, {s6('abs(sin(angle))')} AS first_y FROM t""")
def m1_two(spark, sf):
    _, model = plane(spark, sf)
    first = [abs(float(x)) for x in model.pc.toArray()[:, 0]]
    row = spark.createDataFrame([(float(model.explainedVariance[0]), *first)], "explained double, first_x double, first_y double")
    return rounded(row, "explained", "first_x", "first_y")


@query("m2_two_dimensions", f"""
    WITH {TWO} SELECT vec_id AS session_id, {s6('pow(y * cos(angle) - x * sin(angle), 2) / 2')} AS error FROM z, t""")
def m2_two(spark, sf):
    return rounded(M.reconstruction_error(*plane(spark, sf)).select("session_id", "error"), "error")


@query("m2_full_rank_error", "SELECT vec_id AS session_id, 0.0::DOUBLE AS error FROM embeddings")
def m2_full(spark, sf):
    """With as many codes as dimensions nothing is lost."""
    v = vectors(spark, sf)
    scaled = D.apply_scaler(v, D.fit_scaler(is_train(v)))
    out = M.reconstruction_error(scaled, M.fit_vector_reconstructor(is_train(scaled), 64)).select("session_id", "error")
    return rounded(out, "error")


TRANS = """ed AS (SELECT session_id, cluster_id AS src, next_cluster_id AS dst, count(*) AS weight FROM seq WHERE pos < n - 1 GROUP BY 1, 2, 3),
    tr AS (SELECT * FROM ed WHERE session_id % 3 = 0), pw AS (SELECT src, dst, sum(weight)::DOUBLE AS w FROM tr GROUP BY 1, 2),
    vv AS (SELECT count(*)::DOUBLE AS v FROM (SELECT src FROM pw UNION SELECT dst FROM pw)), tot AS (SELECT src, sum(w) AS t FROM pw GROUP BY 1)"""


def item_edges(spark, sf, **known):
    return G.graph_edges_basic(V.v_items(spark, sf), **known).select("session_id", "src", "dst", "weight")


def stored_item_edges(spark, sf):
    """(edges, hot): edges fitted on a part and scored as a whole, stored in as many parts as they were made in."""
    hot = hot_keys(V.v_items(spark, sf), ["session_id"])
    return bucketed(item_edges(spark, sf, hot=hot), "session_id", buckets=hot.parts()), hot


@query("m3_fit_transition_model", f"""
    WITH {seq_sql('v_items')}, {TRANS}
    SELECT pw.src, dst, {s6('(w + 0.5) / (t + 0.5 * v)')} AS p FROM pw JOIN tot ON pw.src = tot.src, vv
    UNION ALL SELECT src, NULL, {s6('0.5 / (t + 0.5 * v)')} FROM tot, vv""", ["v_items"])
def m3(spark, sf):
    model = M.fit_transition_model(item_edges(spark, sf).where("session_id % 3 = 0"), 0.5)
    return rounded(model.drop("vocabulary"), "p")


@query("m4_structure_error", f"""
    WITH {seq_sql('v_items')}, {TRANS}
    SELECT ed.session_id, ed.src, ed.dst, {s6('-ln(coalesce((coalesce(w, 0) + 0.5) / (t + 0.5 * v), 1 / v))')} AS error
    FROM ed CROSS JOIN vv LEFT JOIN tot ON ed.src = tot.src LEFT JOIN pw ON ed.src = pw.src AND ed.dst = pw.dst""", ["v_items"])
def m4(spark, sf):
    edges, _ = stored_item_edges(spark, sf)
    out = M.structure_error(edges, M.fit_transition_model(edges.where("session_id % 3 = 0"), 0.5))
    return rounded(out.select("session_id", "src", "dst", "error"), "error")


COMP = f"""nd AS (SELECT session_id, cluster_id, avg(l_quantity) / 50 AS e FROM seq GROUP BY 1, 2), na AS (SELECT session_id, avg(e) AS node FROM nd GROUP BY 1),
    ee AS (SELECT ed.session_id, avg(-ln((coalesce(w, 0) + 0.5) / (t + 0.5 * v))) AS structure, avg(1.0::DOUBLE / weight) AS edge
           FROM ed CROSS JOIN vv LEFT JOIN tot ON ed.src = tot.src LEFT JOIN pw ON ed.src = pw.src AND ed.dst = pw.dst GROUP BY 1),
    cs AS (SELECT na.session_id, coalesce(structure, 0) AS structure, node, coalesce(edge, 0) AS edge FROM na LEFT JOIN ee ON na.session_id = ee.session_id)"""


def item_components(spark, sf):
    e, (edges, hot) = V.v_items(spark, sf), stored_item_edges(spark, sf)
    # Dealt as the edges are, nodes meet them where they are; rows of hot sessions are merged before they move.
    e = e if hot else dealt(e, ["session_id"], hot.total)
    nodes = e.groupBy("session_id", "cluster_id").agg((F.avg("l_quantity") / 50).alias("node_error"))
    scored = M.structure_error(edges, M.fit_transition_model(edges.where("session_id % 3 = 0"), 0.5))
    scored = scored.withColumnRenamed("error", "structure_error").withColumn("edge_error", F.lit(1.0) / F.col("weight"))
    return M.session_component_scores(nodes, scored)


@query("m5_session_component_scores", f"WITH {seq_sql('v_items')}, {TRANS}, {COMP} SELECT session_id, {s6('structure')} AS structure, {s6('node')} AS node, {s6('edge')} AS edge FROM cs", ["v_items"])
def m5(spark, sf):
    return rounded(item_components(spark, sf), "structure", "node", "edge")


@query("m6_anomaly_score", f"SELECT session_id, {s6('structure + 2 * node + 0.5 * edge')} AS score FROM v_scores", ["v_scores"])
def m6(spark, sf):
    return rounded(M.anomaly_score(V.v_scores(spark, sf).drop("score"), 1.0, 2.0, 0.5).select("session_id", "score"), "score")


@query("m7_predict", "SELECT session_id, score, CAST(score > 0.5 AS INT) AS pred FROM v_scores", ["v_scores"])
def m7(spark, sf):
    return M.predict(V.v_scores(spark, sf), 0.5).select("session_id", "score", "pred")


def random_params(node_dim: int, edge_dim: int, hidden: int = 8, latent: int = 4, convs: int = 1, seed: int = 7) -> dict:
    """Stands in for weights trained elsewhere."""
    rng = np.random.default_rng(seed)
    layer = lambda a, b: (rng.normal(0, 0.3, (a, b)), rng.normal(0, 0.1, b))
    sizes = [hidden] * convs + [latent]
    return {
        "node_mean": np.zeros(node_dim), "node_std": np.full(node_dim, 10.0),
        "edge_mean": np.zeros(edge_dim), "edge_std": np.full(edge_dim, 1e6),
        "node_proj": [layer(node_dim, hidden)], "edge_proj": [layer(edge_dim, hidden)],
        "convs": [{"layers": [layer(sizes[i], hidden), layer(hidden, sizes[i + 1])]} for i in range(convs)],
        "node_decoder": [layer(latent, hidden), layer(hidden, node_dim)],
        "edge_decoder": [layer(2 * latent, hidden), layer(hidden, edge_dim)],
        "structure_decoder": [layer(2 * latent, hidden), layer(hidden, 1)],
    }


@query("m8_batch_score")
def m8(spark, sf):
    e = V.v_events(spark, sf)
    records = G.graph_records(*G.session_graphs(e))
    one = M.batch_score(records, random_params(9, 10), "dot").withColumn("variant", F.lit("one_layer_dot"))
    two = M.batch_score(records, random_params(9, 10, convs=2), "mlp", "mean").withColumn("variant", F.lit("two_layer_mlp"))
    return one.unionByName(two)


def tiny_params() -> dict:
    """One hidden and one latent number per node, so that the whole forward pass is a line of SQL."""
    one = lambda w, b: [(np.array(w, dtype=float), np.array(b, dtype=float))]
    return {
        "node_mean": np.array([1.0, 3.0]), "node_std": np.array([2.0, 4.0]), "edge_mean": np.array([1.0]), "edge_std": np.array([2.0]),
        "node_proj": one([[0.5], [-0.25]], [0.1]), "edge_proj": one([[0.75]], [-0.2]), "convs": [{"eps": 0.5, "layers": one([[0.8]], [0.05])}],
        "node_decoder": one([[0.3, -0.6]], [0.2, 0.1]), "edge_decoder": one([[0.4], [-0.7]], [0.15]),
    }


@query("m8_tiny_weights", f"""
    WITH {seq_sql('v_items')},
    x AS (SELECT session_id, cluster_id, (count(*) - 1.0::DOUBLE) / 2 AS x1, (cluster_id - 3.0::DOUBLE) / 4 AS x2 FROM seq GROUP BY 1, 2),
    h AS (SELECT *, 0.5::DOUBLE * x1 - 0.25::DOUBLE * x2 + 0.1::DOUBLE AS h FROM x),
    e AS (SELECT session_id, cluster_id AS src, next_cluster_id AS dst, (count(*) - 1.0::DOUBLE) / 2 AS a FROM seq WHERE pos < n - 1 GROUP BY 1, 2, 3),
    m AS (SELECT e.session_id, dst AS cluster_id, sum(greatest(h.h + 0.75::DOUBLE * a - 0.2::DOUBLE, 0)) AS m FROM e JOIN h ON e.session_id = h.session_id AND src = h.cluster_id GROUP BY 1, 2),
    z AS (SELECT h.session_id, h.cluster_id, x1, x2, 0.8::DOUBLE * (1.5::DOUBLE * h + coalesce(m, 0)) + 0.05::DOUBLE AS z FROM h LEFT JOIN m ON h.session_id = m.session_id AND h.cluster_id = m.cluster_id),
    n AS (SELECT session_id, avg((pow(0.3::DOUBLE * z + 0.2::DOUBLE - x1, 2) + pow(-0.6::DOUBLE * z + 0.1::DOUBLE - x2, 2)) / 2) AS node FROM z GROUP BY 1),
    g AS (SELECT e.session_id, avg(ln(1 + exp(-s.z * d.z))) AS structure, avg(pow(0.4::DOUBLE * s.z - 0.7::DOUBLE * d.z + 0.15::DOUBLE - a, 2)) AS edge
          FROM e JOIN z s ON e.session_id = s.session_id AND src = s.cluster_id JOIN z d ON e.session_id = d.session_id AND dst = d.cluster_id GROUP BY 1)
    SELECT n.session_id, {s6('coalesce(structure, 0)')} AS structure, {s6('node')} AS node, {s6('coalesce(edge, 0)')} AS edge FROM n LEFT JOIN g ON n.session_id = g.session_id""", ["v_items"])
def m8_tiny(spark, sf):
    run = G.ordered_run(V.v_items(spark, sf).drop("parameters"))
    nodes = run.rows.groupBy("session_id", "cluster_id").agg(F.count("*").cast("double").alias("c"))
    packed = nodes.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "c"))).alias("ns"))
    edges = G.graph_edges_basic(run).groupBy("session_id").agg(F.collect_list(F.struct("src", "dst", F.array(F.col("weight").cast("double")).alias("a"))).alias("es"))
    at = lambda end: F.transform(F.coalesce("es", F.array().cast("array<struct<src:int,dst:int,a:array<double>>>")), lambda e: F.array_position(F.col("ns.cluster_id"), e[end]) - 1)
    records = packed.join(edges, "session_id", "left").select(
        "session_id", F.transform("ns", lambda n: F.array(n["c"], n["cluster_id"].cast("double"))).alias("x"), at("src").alias("edge_src"), at("dst").alias("edge_dst"),
        F.coalesce(F.col("es.a"), F.array().cast("array<array<double>>")).alias("edge_attr"))
    return rounded(M.batch_score(records, tiny_params()), "structure", "node", "edge")


@query("m9_cascade", f"""
    WITH {FLAGS}, sc AS (SELECT session_id, avg(value) / 100 AS score FROM v_events GROUP BY 1)
    SELECT fl.session_id, CASE WHEN e OR l THEN 'stage1' ELSE 'stage2' END AS stage, {s6('CASE WHEN NOT (e OR l) THEN score END')} AS score,
           CASE WHEN e OR l THEN 1 ELSE CAST(score > 0.5 AS INT) END AS pred FROM fl JOIN sc ON fl.session_id = sc.session_id""", ["v_events"])
def m9(spark, sf):
    _, flags = stage1(spark, sf)
    mean = lambda rest: rest.groupBy("session_id").agg((F.avg("value") / 100).alias("score"))
    return rounded(M.cheap_first(V.v_mild_events(spark, sf), flags, mean, 0.5)[0], "score")


# --- evaluation -------------------------------------------------------------

STEPS = """g AS (SELECT score AS threshold, sum(label) AS p, sum(1 - label) AS q FROM v_scores GROUP BY score),
    st AS (SELECT threshold, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pp, sum(q) OVER () AS nn FROM g WINDOW w AS (ORDER BY threshold DESC)),
    pr AS (SELECT *, tp / (tp + fp) AS prec, tp / pp AS rec, CASE WHEN tp - p + fp - q = 0 THEN 1 ELSE (tp - p) / (tp - p + fp - q) END AS prev FROM st)"""
ROC = "sum(p * (nn - fp + q / 2)) / (max(pp) * max(nn))"


@query("e1_pr_curve", f"""
    WITH {STEPS} SELECT threshold, {s6('prec')} AS precision, {s6('rec')} AS recall, {s6('pp / (pp + nn)')} AS baseline FROM pr
    UNION ALL SELECT NULL, {s6('1')}, {s6('0')}, {s6('max(pp) / (max(pp) + max(nn))')} FROM pr""", ["v_scores"])
def e1(spark, sf):
    return rounded(E.pr_curve(V.v_scores(spark, sf)), "precision", "recall", "baseline")


@query("e2_best_threshold", f"""
    WITH {STEPS} SELECT threshold, {s6('prec')} AS precision, {s6('rec')} AS recall, {s6('2 * prec * rec / (prec + rec + 1e-10)')} AS f1 FROM pr
    ORDER BY 2 * prec * rec / (prec + rec + 1e-10) DESC, threshold LIMIT 1""", ["v_scores"])
def e2(spark, sf):
    return rounded(E.best_threshold(V.v_scores(spark, sf)), "precision", "recall", "f1")


@query("e3_roc_curve", f"WITH {STEPS} SELECT threshold, {s6('fp / nn')} AS fpr, {s6('tp / pp')} AS tpr FROM pr UNION ALL SELECT NULL, {s6('0')}, {s6('0')}", ["v_scores"])
def e3(spark, sf):
    return rounded(E.roc_curve(V.v_scores(spark, sf)), "fpr", "tpr")


@query("e3_roc_auc", f"""
    WITH r AS (SELECT label, avg(k) OVER (PARTITION BY score) AS ar FROM (SELECT label, score, row_number() OVER (ORDER BY score) AS k FROM v_scores)),
    c AS (SELECT sum(label) AS p, sum(1 - label) AS q, sum(CASE WHEN label = 1 THEN ar END) AS s FROM r) SELECT {s6('(s - p * (p + 1) / 2) / (p * q)')} AS roc_auc FROM c""", ["v_scores"])
def e3a(spark, sf):
    return rounded(E.roc_auc(V.v_scores(spark, sf)), "roc_auc")


@query("e4_pr_auc_trapezoid", f"WITH {STEPS} SELECT {s6('sum(p / pp * (prec + prev) / 2)')} AS pr_auc FROM pr", ["v_scores"])
def e4(spark, sf):
    return rounded(E.pr_auc(V.v_scores(spark, sf)), "pr_auc")


@query("e4_average_precision", f"WITH {STEPS} SELECT {s6('sum(p / pp * prec)')} AS pr_auc FROM pr", ["v_scores"])
def e4b(spark, sf):
    return rounded(E.pr_auc(V.v_scores(spark, sf), "average_precision"), "pr_auc")


CM = """cm AS (SELECT count(*) FILTER (label = 0 AND score <= 0.5) AS tn, count(*) FILTER (label = 0 AND score > 0.5) AS fp,
    count(*) FILTER (label = 1 AND score <= 0.5) AS fn, count(*) FILTER (label = 1 AND score > 0.5) AS tp FROM v_scores)"""


def predicted(spark, sf):
    return M.predict(V.v_scores(spark, sf), 0.5)


@query("e5_confusion_matrix", f"WITH {CM} SELECT * FROM cm", ["v_scores"])
def e5(spark, sf):
    return E.confusion_matrix(predicted(spark, sf))


@query("e6_classification_report", f"""
    WITH {CM}, c AS (SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS s FROM cm UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), tp + fn FROM cm),
    f AS (SELECT *, 2 * p * r / (p + r) AS f FROM c)
    SELECT class, {s6('p')} AS precision, {s6('r')} AS recall, {s6('f')} AS f1, s AS support FROM f
    UNION ALL SELECT 'accuracy', {s6('(tn + tp) / (tn + fp + fn + tp)')}, {s6('(tn + tp) / (tn + fp + fn + tp)')}, {s6('(tn + tp) / (tn + fp + fn + tp)')}, tn + fp + fn + tp FROM cm
    UNION ALL SELECT 'macro', {s6('avg(p)')}, {s6('avg(r)')}, {s6('avg(f)')}, CAST(sum(s) AS BIGINT) FROM f
    UNION ALL SELECT 'weighted', {s6('sum(p * s) / sum(s)')}, {s6('sum(r * s) / sum(s)')}, {s6('sum(f * s) / sum(s)')}, CAST(sum(s) AS BIGINT) FROM f""", ["v_scores"])
def e6(spark, sf):
    return rounded(E.classification_report(predicted(spark, sf)), "precision", "recall", "f1")


@query("e7_metric_summary", f"""
    WITH {CM}, {STEPS}, a AS (SELECT sum(p / pp * prec) AS ap, {ROC} AS roc FROM pr)
    SELECT {s6('2.0 * tp / (2 * tp + fp + fn)')} AS f1, {s6('ap')} AS pr_auc, {s6('roc')} AS roc_auc, {s6('tp / (tp + fp)')} AS precision, {s6('tp / (tp + fn)')} AS recall, tn, fp, fn, tp FROM cm, a""", ["v_scores"])
def e7(spark, sf):
    return rounded(E.metric_summary(V.v_scores(spark, sf), 0.5), "f1", "pr_auc", "roc_auc", "precision", "recall")


LONG = """lg AS (SELECT label, 'structure' AS component, structure AS score FROM v_scores UNION ALL SELECT label, 'node', node FROM v_scores
    UNION ALL SELECT label, 'edge', edge FROM v_scores)"""


@query("e8_component_auc", f"""
    WITH {LONG}, l2 AS (SELECT * FROM lg UNION ALL SELECT label, 'combined', structure + node + edge FROM v_scores),
    g AS (SELECT component, score AS threshold, sum(label) AS p, sum(1 - label) AS q FROM l2 GROUP BY 1, 2),
    st AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY component) AS pp, sum(q) OVER (PARTITION BY component) AS nn FROM g
           WINDOW w AS (PARTITION BY component ORDER BY threshold DESC))
    SELECT component, {s6('sum(p / pp * (tp / (tp + fp)))')} AS pr_auc, {s6(ROC)} AS roc_auc FROM st GROUP BY component""", ["v_scores"])
def e8(spark, sf):
    return rounded(E.component_auc(V.v_scores(spark, sf)), "pr_auc", "roc_auc")


@query("e9_contribution", f"""
    WITH t AS (SELECT *, structure + node + edge AS total, CASE WHEN structure >= node AND structure >= edge THEN 1 WHEN node >= edge THEN 2 ELSE 3 END AS d FROM v_scores WHERE label = 1 AND score > 0.5)
    SELECT count(*) AS true_positives, 'structure' AS component, {s6('avg(100 * structure / total)')} AS mean_share_pct, count(*) FILTER (d = 1) AS dominant_count FROM t
    UNION ALL SELECT count(*), 'node', {s6('avg(100 * node / total)')}, count(*) FILTER (d = 2) FROM t
    UNION ALL SELECT count(*), 'edge', {s6('avg(100 * edge / total)')}, count(*) FILTER (d = 3) FROM t""", ["v_scores"])
def e9(spark, sf):
    return rounded(E.contribution(predicted(spark, sf)), "mean_share_pct")


@query("e10_missed_summary", f"""
    SELECT count(*) AS missed, {s6('0.5')} AS threshold, {s6('avg(score)')} AS mean_score, {s6('avg(structure)')} AS mean_structure, {s6('avg(node)')} AS mean_node, {s6('avg(edge)')} AS mean_edge
    FROM v_scores WHERE label = 1 AND score <= 0.5""", ["v_scores"])
def e10(spark, sf):
    return rounded(E.missed_summary(predicted(spark, sf), 0.5), "threshold", "mean_score", "mean_structure", "mean_node", "mean_edge")


@query("e11_error_distribution", f"""
    WITH {LONG} SELECT component, label, count(*) AS cnt, {s6('avg(score)')} AS mean, {s6('min(score)')} AS min, {s6('max(score)')} AS max,
           {s6('quantile_cont(score, 0.25)')} AS p25, {s6('quantile_cont(score, 0.5)')} AS p50, {s6('quantile_cont(score, 0.75)')} AS p75 FROM lg GROUP BY 1, 2""", ["v_scores"])
def e11(spark, sf):
    return rounded(E.error_distribution(V.v_scores(spark, sf)), "mean", "min", "max", "p25", "p50", "p75")


@query("e12_leakage_report", f"""
    WITH {OVERLAP.format(v='o')}, p AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) x(a, b)),
    s AS (SELECT a || '_' || b AS pair, (SELECT count(*) FROM (SELECT session_id FROM o WHERE split = a INTERSECT SELECT session_id FROM o WHERE split = b)) AS k FROM p)
    SELECT 'overlap_' || pair AS "check", CAST(k AS VARCHAR) AS value, CASE WHEN k = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM s
    UNION ALL SELECT 'size_' || split, CAST(count(*) AS VARCHAR), 'INFO' FROM o GROUP BY split
    UNION ALL SELECT 'source_clean', 'train', 'PASS' UNION ALL SELECT 'anomalies_in_clean', '0', 'PASS'
    UNION ALL SELECT 'source_careless', 'test,train', 'FAIL' UNION ALL
    SELECT 'anomalies_in_careless', CAST(sum(label) AS VARCHAR), CASE WHEN sum(label) = 0 THEN 'PASS' ELSE 'FAIL' END FROM o WHERE split <> 'val'""", ["v_split"])
def e12(spark, sf):
    """Two fits of a scaler: one on clean training rows, one that takes in test rows and anomalies."""
    ds = overlapping(spark, sf)
    rows = ds.withColumn("vec", F.array(F.col("session_id").cast("double")))
    seen = E.FitCapture()
    for name, used in (("clean", D.clean_train(rows)), ("careless", rows.where("split <> 'val'"))):
        D.fit_scaler(seen.watch(name, used)).first()
    return E.leakage_report(ds, seen.table(spark))


@query("e13_loss_proportions", f"""
    WITH h AS (SELECT window_id AS epoch, avg(CASE WHEN cluster_id = 1 THEN value ELSE 0 END) AS structure, avg(CASE WHEN cluster_id = 2 THEN value ELSE 0 END) AS node,
               avg(CASE WHEN cluster_id = 3 THEN value ELSE 0 END) AS edge FROM v_events GROUP BY 1)
    SELECT epoch, {s6('100 * structure / nullif(structure + node + edge, 0)')} AS structure_pct, {s6('100 * node / nullif(structure + node + edge, 0)')} AS node_pct,
           {s6('100 * edge / nullif(structure + node + edge, 0)')} AS edge_pct FROM h""", ["v_events"])
def e13(spark, sf):
    part = lambda i: F.avg(F.when(F.col("cluster_id") == i, F.col("value")).otherwise(0.0))
    h = V.v_events(spark, sf).groupBy(F.col("window_id").alias("epoch")).agg(part(1).alias("structure"), part(2).alias("node"), part(3).alias("edge"))
    out = E.loss_proportions(h)
    return rounded(out.drop("structure", "node", "edge"), "structure_pct", "node_pct", "edge_pct")


# --- lineage ----------------------------------------------------------------

def results(spark, sf):
    """Customers as experiments, with metrics from their order prices."""
    o = V.table(spark, sf, "orders")
    per = o.groupBy("o_custkey").agg(
        F.avg("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"), F.min("o_totalprice").alias("c"))
    ok = F.col("o_custkey") % 7 != 0
    m = lambda *cs: F.when(ok, F.struct(*[(F.col(c) / 600000).alias(n) for c, n in zip(cs, ("f1", "pr_auc", "roc_auc"))]))
    return per.select(F.concat(F.lit("exp_"), "o_custkey").alias("name"), F.when(ok, "OK").otherwise("FAILED").alias("status"),
                      m("a", "b", "c").alias("val"), m("b", "c", "a").alias("test"))


RESULTS = """rs AS (SELECT 'exp_' || o_custkey AS name, o_custkey % 7 <> 0 AS ok, avg(o_totalprice) / 600000 AS a, max(o_totalprice) / 600000 AS b, min(o_totalprice) / 600000 AS c FROM orders GROUP BY o_custkey)"""


def s4(expr):
    return f"round(CASE WHEN ok THEN {expr} END + 1e-9, 4)"


@query("x1_compare_runs", f"""
    WITH {RESULTS} SELECT name, CASE WHEN ok THEN 'OK' ELSE 'FAILED' END AS status, {s4('a')} AS val_f1, {s4('b')} AS val_pr_auc, {s4('c')} AS val_roc_auc,
           {s4('b')} AS test_f1, {s4('c')} AS test_pr_auc, {s4('a')} AS test_roc_auc FROM rs""")
def x1(spark, sf):
    r = results(spark, sf)
    nudge = lambda s: F.struct(*[(F.col(f"{s}.{m}") + 1e-9).alias(m) for m in ("f1", "pr_auc", "roc_auc")])
    return X.compare_runs(r.withColumns({"val": nudge("val"), "test": nudge("test")}))


@query("x2_best_per_metric", f"""
    WITH {RESULTS} SELECT name, ok AND b = (SELECT max(b) FROM rs WHERE ok) AS best_f1, ok AND c = (SELECT max(c) FROM rs WHERE ok) AS best_pr_auc FROM rs""")
def x2(spark, sf):
    r = results(spark, sf).select("name", "status", F.col("test.f1").alias("f1"), F.col("test.pr_auc").alias("pr_auc"))
    return X.best_per_metric(r, ["f1", "pr_auc"]).select("name", "best_f1", "best_pr_auc")


@query("x3_history_table", """
    SELECT 'exp_' || o_custkey AS name, o_orderkey AS epoch, CAST(floor(o_totalprice / 50000) AS BIGINT) AS val_f1,
           row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000) DESC, o_orderkey DESC) = 1 AS is_best FROM orders""")
def x3(spark, sf):
    o = V.table(spark, sf, "orders")
    history = o.select(F.concat(F.lit("exp_"), "o_custkey").alias("name"), F.col("o_orderkey").alias("epoch"),
                       F.floor(F.col("o_totalprice") / 50000).alias("val_f1"))
    return X.history_table(history)


@query("x4_run_registry", """
    SELECT o_custkey AS run_tag, arg_max(o_totalprice, struct_pack(d := o_orderdate, k := o_orderkey)) AS value, count(*) AS updates FROM orders GROUP BY 1""")
def x4(spark, sf):
    """Every order updates the metric of its customer's run; the last update counts."""
    path = scratch_path(spark, "registry")
    o = V.table(spark, sf, "orders")
    log = o.select(F.col("o_custkey").alias("run_tag"), F.col("o_totalprice").alias("value"),
                   F.struct(F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("k")).alias("recorded_at"))
    X.update_metrics(path, log.where("recorded_at.k % 2 = 0"))
    X.update_metrics(path, log.where("recorded_at.k % 2 = 1"))
    stored = spark.read.parquet(f"{path}/run_metrics")
    n = stored.groupBy("run_tag").agg(F.count("*").alias("updates"))
    return X.current(stored, ["run_tag"]).drop("recorded_at").join(n, "run_tag")


@query("x4_record_run", """
    SELECT CAST(o_custkey AS VARCHAR) AS run_tag, 'orders' AS dataset, arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) AS pipeline_stage, count(*) AS records
    FROM orders GROUP BY 1""")
def x4_run(spark, sf):
    """Every order is a record of its customer's run, in two appends; the latest record is the run's state."""
    path = scratch_path(spark, "registry")
    o = V.table(spark, sf, "orders")
    log = o.select(F.col("o_custkey").cast("string").alias("run_tag"), F.lit("orders").alias("dataset"), F.col("o_orderstatus").alias("pipeline_stage"),
                   F.struct(F.col("o_orderdate").alias("d"), F.col("o_orderkey").alias("k")).alias("recorded_at"))
    X.record_run(path, log.where("recorded_at.k % 2 = 1"))
    X.record_run(path, log.where("recorded_at.k % 2 = 0"))
    stored = spark.read.parquet(f"{path}/runs")
    n = stored.groupBy("run_tag").agg(F.count("*").alias("records"))
    return X.current(stored, ["run_tag"]).drop("recorded_at").join(n, "run_tag")


@query("x4_add_artifact", """
    SELECT r.run_tag, p.run_tag AS dependency, 'orders' AS name, 'price/' || CAST(p.price AS VARCHAR) AS path
    FROM v_runs r JOIN v_runs p ON r.previous = p.run_id""", ["v_runs"])
def x4_artifact(spark, sf):
    """Runs and their outputs go through the registry; inputs are resolved from what it holds."""
    path = scratch_path(spark, "registry")
    r = V.v_runs(spark, sf)
    chain = ordered(r.select("dataset", "created", "run_id", "run_tag"), ["dataset"], ["created", "run_id"], lead=["run_tag"])
    X.record_run(path, chain.where("next_run_tag IS NOT NULL").select(F.col("next_run_tag").alias("run_tag"), F.array("run_tag").alias("depends_on")))
    for odd in (0, 1):
        X.add_artifact(path, r.where(F.col("run_id") % 2 == odd).select(
            "run_tag", F.lit("orders").alias("name"), F.concat(F.lit("price/"), F.col("price").cast("string")).alias("path")))
    return X.resolve_inputs(spark.read.parquet(f"{path}/runs"), spark.read.parquet(f"{path}/run_artifacts"))


@query("x5_resolve_inputs", """
    SELECT r.run_tag, p.run_tag AS dependency, 'orders' AS name, 'price/' || CAST(p.price AS VARCHAR) AS path
    FROM v_runs r JOIN v_runs p ON r.previous = p.run_id""", ["v_runs"])
def x5(spark, sf):
    r = V.v_runs(spark, sf)
    chain = ordered(r.select("dataset", "created", "run_id", "run_tag"), ["dataset"], ["created", "run_id"], lead=["run_tag"])
    runs = chain.where("next_run_tag IS NOT NULL").select(F.col("next_run_tag").alias("run_tag"), F.array("run_tag").alias("depends_on"))
    artifacts = r.select("run_tag", F.lit("orders").alias("name"), F.concat(F.lit("price/"), F.col("price").cast("string")).alias("path"))
    return X.resolve_inputs(runs, artifacts)
