"""The way taken for hot keys gives the same rows as the plain window."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlog.operators import dataset as D
from weftlog.operators import evaluation as E
from weftlog.operators import graphs as G
from weftlog.operators import sessions as K
from weftlog.operators.skew import exact_percentiles, hot_keys, ordered


def skewed(make_events, n=600, seed=1):
    """One session with a third of all rows, heavy ties and some missing times."""
    rng = random.Random(seed)
    sessions = {"hot": [rng.randint(1, 4) for _ in range(n // 3)]}
    for i in range(40):
        sessions[f"s{i}"] = [rng.randint(1, 4) for _ in range(n * 2 // 120)]
    times = {s: [None if rng.random() < 0.05 else rng.randint(0, 30) for _ in ids] for s, ids in sessions.items()}
    params = {s: [[str(rng.random()), "x"] for _ in ids] for s, ids in sessions.items()}
    return make_events(sessions, times, params)


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = lambda r: tuple("" if v is None else str(round(v, 9) if isinstance(v, float) else v) for v in r)
    x = sorted(key(r) for r in a.select(*cols).collect())
    y = sorted(key(r) for r in b.select(*cols).collect())
    assert x == y and x


def test_hot_keys_only_lists_large_groups(make_events):
    hot = hot_keys(skewed(make_events), ["session_id"], 50)
    assert [r["session_id"] for r in hot.table.collect()] == ["hot"] and hot.count == 1


def test_thousands_of_hot_keys_and_a_hot_null_key(spark):
    rows = [(k if k % 50 else None, i) for k in range(5_000) for i in range(3)]
    df = spark.createDataFrame(rows, "k int, i int").withColumn("u", F.monotonically_increasing_id())
    hot = hot_keys(df, ["k"], 2)
    assert hot.count == 4_901 and hot.rows == len(rows)
    same(ordered(df, ["k"], ["u"], sums=["i"]), ordered(df, ["k"], ["u"], sums=["i"], rows_per_task=2_000, hot=hot))


def test_ordered_matches_plain_window(make_events):
    e = skewed(make_events).withColumn("w", F.col("cluster_id").cast("bigint"))
    args = dict(lead=["cluster_id", "ts"], sums=["w"])
    for keys, limit in ((["session_id"], 30), (["session_id"], 7), ([], 50)):
        order = ["ts", "line_no"] if keys else ["session_id", "ts", "line_no"]
        same(ordered(e, keys, order, **args), ordered(e, keys, order, **args, rows_per_task=limit))


def test_graphs_match_for_hot_sessions(make_events):
    e = skewed(make_events)
    for scale in ("raw", "log"):
        same(G.graph_edges(e, scale), G.graph_edges(e, scale, rows_per_task=25))
        same(G.graph_nodes(e, scale), G.graph_nodes(e, scale, rows_per_task=25))
    same(G.graph_edges_basic(e), G.graph_edges_basic(e, rows_per_task=25))
    same(G.graph_sizes(e), G.graph_sizes(e, rows_per_task=25))
    same(G.event_chain(e), G.event_chain(e, rows_per_task=25))


def test_sessions_match_for_hot_sessions(make_events):
    e = skewed(make_events)
    same(K.fire_number(e), K.fire_number(e, rows_per_task=25))
    same(K.session_fingerprint(e).drop("head"), K.session_fingerprint(e, rows_per_task=25).drop("head"))
    same(D.padded_sequences(e, 12), D.padded_sequences(e, 12, rows_per_task=25))
    fps = K.session_fingerprint(e)
    same(K.pattern_coverage(fps), K.pattern_coverage(fps, rows_per_task=5))
    lengths = K.session_lengths(e)
    same(K.sample_sessions(lengths), K.sample_sessions(lengths, rows_per_task=5))


def test_split_and_curves_match_when_a_class_is_hot(spark):
    ds = spark.createDataFrame([(i, int(i % 33 == 0)) for i in range(500)], "session_id bigint, label int")
    same(D.stratified_split(ds), D.stratified_split(ds, rows_per_task=40))
    scores = ds.withColumn("score", (F.col("session_id") * 7 % 90) / 90 + F.col("label") * 0.2)
    same(E.score_steps(scores), E.score_steps(scores, rows_per_task=10))


def test_exact_percentiles_with_many_distinct_values(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.normal(size=300)] + [("cold", float(x)) for x in rng.integers(0, 5, 31)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    for limit in (10, 10_000):
        got = {r["k"]: r for r in exact_percentiles(df, ["k"], "v", probs, rows_per_task=limit).collect()}
        for k in ("hot", "cold"):
            want = np.percentile([v for kk, v in rows if kk == k], [100 * p for p in probs.values()])
            assert np.allclose([got[k][n] for n in probs], want, atol=1e-12)


def test_long_sessions_are_one_row_with_one_kind_of_fingerprint(make_events):
    ids = {"a": [1, 2, 3, 4, 5, 6, 7], "b": [1, 2, 3, 4, 5, 6, 7], "c": [1, 2, 3, 4, 5, 6, 8]}
    e = make_events(ids)
    for limit in (3, 1_000):
        rows = {r["session_id"]: list(r["cluster_id"]) for r in K.session_arrays(e, cols=["cluster_id"], rows_per_task=limit).collect()}
        assert rows == ids
        fp = {r["session_id"]: r["fingerprint"] for r in K.session_fingerprint(e, rows_per_task=limit).collect()}
        assert fp == {s: hashlib.md5("|".join(map(str, c)).encode()).hexdigest() for s, c in ids.items()}


def test_result_does_not_depend_on_partitions(spark, make_events):
    e = skewed(make_events)
    base = G.graph_edges(e).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        again = G.graph_edges(e).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = lambda r: (r["session_id"], r["src"], r["dst"], r["weight"], round(r["td_std"], 9))
    assert sorted(map(key, base)) == sorted(map(key, again))


@pytest.mark.parametrize("scale", ["raw", "log"])
def test_a_stored_run_equals_the_lazy_way_with_and_without_hot_sessions(spark, make_events, scale):
    sessions = {"hot": [i % 4 for i in range(90)], "a": [1, 2, 1], "b": [3], "c": [2] * 7}
    params = {"hot": [["5", "x"], ["nan"]] * 45, "a": [["1.5"], [], ["2"]]}
    e = make_events(sessions, params=params).repartition(3)
    for per_task in (2_000_000, 25):
        run = G.ordered_run(e, scale, rows_per_task=per_task)
        assert (run.hot is None) == (per_task > 25)
        same(G.graph_nodes(run, scale), G.graph_nodes(e, scale))
        same(G.graph_edges(run, scale, rows_per_task=per_task), G.graph_edges(e, scale))
        same(G.graph_sizes(run), G.graph_sizes(e))
        same(G.event_chain(run), G.event_chain(e))
        same(G.graph_edges_basic(run), G.graph_edges_basic(e))


@pytest.mark.parametrize("size,slide", [(60, None), (60, 20), (60, 45), (40, 60), (7, 3)])
def test_panes_equal_exploded_windows(spark, size, slide):
    rng = random.Random(size)
    rows = [(i, rng.randrange(-200, 300), rng.random() < 0.1, f"n{rng.randrange(3)}") for i in range(400)] + [(999, None, True, "n0")]
    e = spark.createDataFrame(rows, "line_no bigint, unix_ts bigint, is_anomaly boolean, node_id string").repartition(3)
    step = slide or size
    want = {}
    for line, t, bad, node in rows:
        for k in range(-400, 400) if t is not None else ():
            if k * step <= t < k * step + size:
                for key in ((k,), (k, node)):
                    n, b, first = want.get(key, (0, 0, 10 ** 9))
                    want[key] = (n + 1, b + bad, min(first, line))
    for keys in ([], ["node_id"]):
        got = {(r["window_id"], *(r[c] for c in keys)): (r["events"], r["anomalous"], r["first_line"]) for r in K.window_totals(e, size, slide, keys=keys).collect()}
        assert got == {k: v for k, v in want.items() if len(k) == 1 + len(keys)}
        assert all(r["label"] == (r["anomalous"] > 0) for r in K.window_totals(e, size, slide, keys=keys).collect())


def test_tfidf_joined_and_broadcast_agree(spark, monkeypatch):
    from weftlog.operators import embeddings as B

    monkeypatch.setattr("weftlog.operators.skew.SHARES", 5)
    rng = random.Random(3)
    texts = spark.createDataFrame([(i, " ".join(rng.choices(["the", "the", "a", "b", "C", "d" + str(i)], k=rng.randrange(9)))) for i in range(60)], "cluster_id int, text string")
    same(B.tfidf(texts, small=True), B.tfidf(texts, small=False))


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr("weftlog.operators.skew.ROWS_UNDEALT", 100)
    monkeypatch.setattr("weftlog.operators.skew.ROWS_A_PART", 50)


def parts_of(df, key="session_id"):
    """The numbers of parts that rows are dealt into by `key` in the plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(rf"Exchange hashpartitioning\({key}#\d+L?, (\d+)\)", text)]


def test_graph_sizes_are_made_in_parts_that_grow_with_the_rows(make_events, small_parts):
    for n, parts in ((600, 12), (1200, 24)):
        e = skewed(make_events, n)
        got = G.graph_sizes(e)
        assert parts_of(got) == [parts]
        # Some sessions split off as hot: only the others are dealt.
        same(got, G.graph_sizes(e, rows_per_task=30))
    assert parts_of(G.graph_sizes(make_events({"a": [1, 2], "b": [3]}).repartition(2))) == [4]


def test_slices_of_hot_keys_never_share_a_task(make_events):
    rows = ordered(skewed(make_events), ["session_id"], ["ts", "line_no"], rows_per_task=10)
    assert "DirectShufflePartitionID".lower() in rows._jdf.queryExecution().toString().lower().replace("_", "")


def test_basic_edges_are_made_in_parts_that_grow_with_the_rows(make_events, small_parts):
    for n, parts in ((600, 12), (1200, 24)):
        e = skewed(make_events, n)
        got = G.graph_edges_basic(e)
        assert parts_of(got) == [parts]
        same(got, G.graph_edges_basic(e, rows_per_task=30))


def test_log_nodes_are_made_in_parts_that_grow_with_the_rows(make_events, small_parts):
    for n, parts in ((600, 12), (1200, 24)):
        e = skewed(make_events, n)
        got = G.graph_nodes(e, "log")
        assert parts_of(got) == [parts]
        same(got, G.graph_nodes(e, "log", rows_per_task=30))
    assert "24 out of 24" in G.graph_sizes(G.ordered_run(e, "log"))._jdf.queryExecution().executedPlan().toString()


def test_items_are_scored_in_parts_that_grow_with_the_rows(spark, monkeypatch):
    from weftlog.plans import model_queries as Q

    monkeypatch.setattr("weftlog.operators.skew.ROWS_UNDEALT", 1_000)
    monkeypatch.setattr("weftlog.operators.skew.ROWS_A_PART", 500)
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    edges, hot = Q.stored_item_edges(spark, sf)
    parts = -(-rows // 500)
    assert not hot and hot.total == rows
    assert f"{parts} out of {parts}" in edges.groupBy("session_id").count()._jdf.queryExecution().executedPlan().toString()
    plan = Q.m4(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    # Nodes are dealt as the stored edges are, and meet them where they are.
    plan = Q.item_components(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(\w+#\d+L?, (\d+)\)", plan) == [str(parts)]


@pytest.mark.parametrize("small", [True, False])
def test_words_are_counted_in_parts_that_grow_with_the_text(spark, monkeypatch, small_parts, small):
    from weftlog.operators import embeddings as B

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["the", "the", "A", "b", "c" + str(i), "d" + str(i % 9)], k=rng.randrange(30)))) for i in range(80)] + [(None, "the x"), (90, None)]
    texts = spark.createDataFrame(rows, "cluster_id int, text string").repartition(3)
    want = B.tfidf(texts)
    monkeypatch.setattr("weftlog.operators.skew.SHARES", 5)
    monkeypatch.setattr("weftlog.operators.embeddings.CHARS_A_PART", 300)
    parts = -(-sum(len(t or "") for _, t in rows) // 300)
    got = B.tfidf(texts, small=small)
    assert f"{parts} out of {parts}" in got._jdf.queryExecution().executedPlan().toString()
    assert small or parts_of(got, "token")[0] > 4 and parts_of(got, "__part") == [parts]
    same(got, want)


def test_the_vocabulary_of_counted_terms_is_that_of_the_rows(spark, small_parts, monkeypatch):
    from weftlog.operators import embeddings as B

    monkeypatch.setattr("weftlog.operators.embeddings.CHARS_A_PART", 100)
    texts = spark.createDataFrame([(i, f"the a{i % 7} B{i % 3} c{i}") for i in range(60)], "cluster_id int, text string")
    terms = B.count_terms(texts)
    assert terms.many and terms.tokens == 71 and terms.total == 240
    same(B.vocabulary(terms), B.vocabulary(B.tfidf(texts)))
