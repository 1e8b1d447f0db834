"""Literal fixtures with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from weftlog.functions import columns as C
from weftlog.operators import dataset as D
from weftlog.operators import evaluation as E
from weftlog.operators import graphs as G
from weftlog.operators import lookups as J
from weftlog.operators import sessions as K


def near(row, **want):
    for k, v in want.items():
        assert row[k] == pytest.approx(v, abs=1e-6), (k, row[k], v)


def test_worked_example(make_events):
    e = make_events({"s": [10, 5, 2, 10, 5, 2, 2]})
    assert K.session_fingerprint(e).first()["fingerprint"] == "70d8317b2375f8c7997f922e94d3183f"
    n = {r["cluster_id"]: r for r in G.graph_nodes(e).collect()}
    near(n[10], occurrence_count=2, first_pos=0, last_pos=0.5, mean_pos=0.25, std_pos=0.25, pos_spread=0.5)
    near(n[5], occurrence_count=2, first_pos=1 / 6, last_pos=4 / 6, mean_pos=0.416667, std_pos=0.25, pos_spread=0.5)
    near(n[2], occurrence_count=3, first_pos=1 / 3, last_pos=1, mean_pos=0.722222, std_pos=0.283279, pos_spread=0.666667)
    g = {(r["src"], r["dst"]): r for r in G.graph_edges(e).collect()}
    near(g[10, 5], weight=2, mean_src_pos=0.25, mean_dst_pos=0.416667, mean_pos_delta=1 / 6)
    near(g[5, 2], weight=2, mean_src_pos=0.416667, mean_dst_pos=0.583333, mean_pos_delta=1 / 6)
    near(g[2, 10], weight=1, mean_src_pos=1 / 3, mean_dst_pos=0.5)
    near(g[2, 2], weight=1, mean_src_pos=0.833333, mean_dst_pos=1)
    assert len(g) == 4
    idx = {r["cluster_id"]: r["node_idx"] for r in K.first_seen_index(e).collect()}
    assert idx == {10: 0, 5: 1, 2: 2}


def test_order_recovery_uses_population_std(make_events):
    e = make_events({"x": [1, 2, 1, 3], "y": [1, 1, 2, 3]})
    fp = {r["session_id"]: r["fingerprint"] for r in K.session_fingerprint(e).collect()}
    assert fp == {"x": "ffdb194be57fc4b7d7defbc60f3fd7ef", "y": "3e6d2d5590059156bba95dd77901b7d4"}
    n = {(r["session_id"], r["cluster_id"]): r for r in G.graph_nodes(e).collect()}
    near(n["x", 1], mean_pos=1 / 3, std_pos=1 / 3)
    near(n["y", 1], mean_pos=1 / 6, std_pos=1 / 6)


def test_one_event_session(make_events):
    e = make_events({"s": [4]})
    near(G.graph_nodes(e).first(), first_pos=0, last_pos=0, mean_pos=0, std_pos=0, pos_spread=0, param_num_mean=0)
    assert G.graph_edges(e).count() == 0
    rec = G.graph_records(G.graph_nodes(e), G.graph_edges(e)).first()
    assert (rec["num_nodes"], rec["num_edges"], list(rec["edge_attr"])) == (1, 0, [])


def test_missing_and_negative_deltas(spark, make_events):
    e = make_events({"gone": [1, 2]}, {"gone": [None, None]})
    raw, log = G.graph_edges(e).first(), G.graph_edges(e, "log").first()
    for c in ("td_min", "td_p25", "td_median", "td_p75", "td_max"):
        assert raw[c] == -1 and log[c] == 0
    assert raw["td_std"] == 0 and log["td_std"] == 0
    # Order by a column that disagrees with the time gives a negative delta.
    back = make_events({"s": [1, 2]}, {"s": [10, 4]}).withColumn("seq", F.col("line_no"))
    seq = K.with_sequence(back.withColumn("ts", F.col("line_no").cast("double") * -6.0))
    assert [r["delta_us"] for r in seq.orderBy("pos").collect()] == [6_000_000, None]
    neg = seq.withColumn("delta_us", -F.col("delta_us"))
    assert G.graph_edges(neg).first()["td_min"] == -6 and G.graph_edges(neg, "log").first()["td_max"] == 0


def test_missing_times_sort_last(make_events):
    e = make_events({"s": [1, 2, 3]}, {"s": [None, 5, 1]})
    order = K.with_position(e).orderBy("pos").collect()
    assert [r["cluster_id"] for r in order] == [3, 2, 1]
    assert {r["cluster_id"]: r["node_idx"] for r in K.first_seen_index(e).collect()} == {3: 0, 2: 1, 1: 2}


def test_ties_keep_file_order(make_events):
    e = make_events({"s": [7, 8, 9]}, {"s": [0, 0, 0]})
    assert [r["cluster_id"] for r in K.with_position(e).orderBy("pos").collect()] == [7, 8, 9]


@pytest.mark.parametrize("text, as_float, finite", [
    (" 12 ", True, True), ("+5", True, True), (".5", True, True), ("5.", True, True), ("1e5", True, True),
    ("1_000", True, True), ("nan", True, False), ("inf", True, False), ("-Infinity", True, False),
    ("", False, False), ("abc", False, False), ("1d", False, False), ("1f", False, False),
    ("0x1p3", False, False), ("1L", False, False), ("1__0", False, False), (None, False, False),
])
def test_numeric_text(spark, text, as_float, finite):
    row = spark.createDataFrame([(text,)], "t string").select(
        C.is_numeric("t").alias("a"), C.is_numeric("t", finite_only=True).alias("b"), C.to_number("t").alias("v")).first()
    assert (row["a"], row["b"]) == (as_float, finite)
    if as_float:
        want = float(text)
        assert row["v"] == want or (math.isnan(row["v"]) and math.isnan(want))


def test_split_sizes():
    assert D.split_sizes(575_061) == (402_542, 86_259, 86_260)


@pytest.mark.parametrize("n, bad", [(1, 0), (2, 1), (10, 3), (101, 7), (1000, 29)])
def test_split_is_exact_and_disjoint(spark, n, bad):
    ds = spark.createDataFrame([(i, int(i < bad)) for i in range(n)], "session_id bigint, label int")
    out = D.stratified_split(ds)
    sizes = {r["split"]: r["size"] for r in D.split_summary(out).collect()}
    assert tuple(sizes.get(s, 0) for s in D.SPLITS) == D.split_sizes(n)
    assert out.count() == n and {r["status"] for r in D.split_overlap(out).collect()} == {"PASS"}


def test_labels(spark, tmp_path):
    from weftlog.sources.logs import read_labels

    (tmp_path / "l.csv").write_text(" BlockId ,Label \nb1,Normal\nb2,Anomaly\nb3,normal\n")
    lab = read_labels(spark, str(tmp_path / "l.csv"))
    sessions = spark.createDataFrame([("b1",), ("b2",), ("b3",), ("b4",)], "session_id string")
    got = {r["session_id"]: (r["label"], r["label_defaulted"]) for r in J.attach_label(sessions, lab).collect()}
    assert got == {"b1": (0, False), "b2": (1, False), "b3": (1, False), "b4": (0, True)}


def c7(spark):
    rows = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)]
    return spark.createDataFrame(rows, "score double, label int")


def test_curves(spark):
    s = c7(spark)
    assert E.roc_auc(s).first()[0] == pytest.approx(0.75)
    assert E.pr_auc(s, "average_precision").first()[0] == pytest.approx(0.833333, abs=1e-6)
    pts = [r for r in E.pr_curve(s).collect() if r["threshold"] is not None]
    got = sorted((r["threshold"], round(r["precision"], 6), r["recall"]) for r in pts)
    assert got == [(0.1, 0.5, 1.0), (0.35, 0.666667, 1.0), (0.4, 0.5, 0.5), (0.8, 1.0, 0.5)]
    best = E.best_threshold(s).first()
    assert best["threshold"] == 0.35 and best["f1"] == pytest.approx(0.8)
    m = E.metric_summary(s, 0.35).first()
    assert m["f1"] == pytest.approx(0.5) and (m["tn"], m["fp"], m["fn"], m["tp"]) == (1, 1, 1, 1)


def test_auc_ignores_monotone_maps_and_one_class(spark):
    s = c7(spark)
    warped = s.withColumn("score", F.exp(F.col("score") * 5))
    for f in (E.roc_auc, E.pr_auc):
        assert f(s).first()[0] == pytest.approx(f(warped).first()[0])
    alone = s.where("label = 1")
    assert E.metric_summary(alone, 0.2).first()["roc_auc"] == 0.0


def test_keyword_is_a_substring(spark):
    df = spark.createDataFrame([("failover done",), ("all fine",)], "t string")
    assert [r[0] for r in df.select(C.keyword_flag("t")).collect()] == [True, False]


def test_max_len_is_cut(spark):
    lengths = spark.createDataFrame([(i, i) for i in range(1, 51)], "session_id int, seq_len int")
    row = D.choose_max_len(lengths).first()
    assert row["p99"] == pytest.approx(49.51) and row["max_len"] == 49


def test_graph_invariants(spark):
    from weftlog.plans import views as V

    e = V.v_items(spark, "/root/testdata/sf0.001")
    n = e.groupBy("session_id").count()
    w = G.graph_edges(e).groupBy("session_id").agg(F.sum("weight").alias("w"), F.max("mean_pos_delta").alias("d"))
    bad = n.join(w, "session_id", "left").where(
        (F.coalesce("w", F.lit(0)) != F.col("count") - 1) | (F.abs(F.col("d") - 1 / (F.col("count") - 1)) > 1e-9))
    assert bad.count() == 0
    occ = G.graph_nodes(e).groupBy("session_id").agg(F.sum("occurrence_count").alias("o"))
    assert n.join(occ, "session_id").where("count <> o").count() == 0


def test_negative_edges(spark):
    from weftlog.plans import views as V

    e = V.v_items(spark, "/root/testdata/sf0.001")
    nodes = e.select("session_id", "cluster_id").distinct()
    edges = G.graph_edges_basic(e).select("session_id", "src", "dst")
    neg = G.negative_edges(nodes, edges).cache()
    assert neg.join(edges, ["session_id", "src", "dst"]).count() == 0
    assert neg.where("src = dst").count() == 0 and neg.count() == neg.distinct().count()
    k = nodes.groupBy("session_id").agg(F.count("*").alias("k"))
    per = edges.groupBy("session_id").agg(F.count("*").alias("e"), F.count_if(F.col("src") != F.col("dst")).alias("x"))
    got = neg.groupBy("session_id").agg(F.count("*").alias("g"))
    want = F.least(F.col("e"), F.col("k") * (F.col("k") - 1) - F.col("x"))
    rows = k.join(per, "session_id").join(got, "session_id", "left")
    assert rows.where(F.coalesce("g", F.lit(0)) != want).count() == 0


def test_neighbor_aggregate_by_hand(spark):
    nodes = spark.createDataFrame([("s", 1, [1.0, -2.0]), ("s", 2, [0.5, 4.0]), ("s", 3, [2.0, 2.0])], "session_id string, cluster_id int, h array<double>")
    edges = spark.createDataFrame([("s", 1, 3, [1.0, 1.0]), ("s", 2, 3, [0.0, -1.0])], "session_id string, src int, dst int, e array<double>")
    for agg, want in (("sum", [4.5, 5.0]), ("mean", [3.25, 3.5]), ("max", [4.0, 5.0])):
        out = {r["cluster_id"]: list(r["h"]) for r in G.neighbor_aggregate(nodes, edges, agg).collect()}
        assert out[3] == pytest.approx(want) and out[1] == [1.0, -2.0]


def test_data_sanity_raises(spark):
    bad = spark.createDataFrame([("s", [1.0, float("nan")])], "session_id string, vec array<double>")
    with pytest.raises(ValueError):
        D.data_sanity(bad, bad.where("false"))
    row = D.data_sanity(bad, bad.where("false"), strict=False).first()
    assert row["bad_node_sessions"] == 1 and row["zero_edge_sessions"] == 1
