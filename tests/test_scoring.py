"""Reconstruction scoring against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftlog.operators import dataset as D
from weftlog.operators import embeddings as B
from weftlog.operators import evaluation as E
from weftlog.operators import scoring as M
from weftlog.operators import sessions as K
from weftlog.plans.model_queries import random_params


def test_reconstruction_error_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "session_id int, vec array<double>")
    scaled = D.apply_scaler(df, D.fit_scaler(df, floor=0.1))
    z = (x - x.mean(0)) / np.maximum(x.std(0, ddof=1), 0.1)
    u = np.linalg.svd(np.cov(z.T))[0][:, :2]
    want = ((z - z @ u @ u.T) ** 2).mean(1)
    out = M.reconstruction_error(scaled, M.fit_vector_reconstructor(scaled, 2)).orderBy("session_id").collect()
    assert np.allclose([r["error"] for r in out], want, atol=1e-9)
    full = M.reconstruction_error(scaled, M.fit_vector_reconstructor(scaled, 6))
    assert full.agg(F.max("error")).first()[0] < 1e-9


def test_scaler_floor_and_batch_norm(spark):
    df = spark.createDataFrame([("a", [1.0, 5.0]), ("b", [3.0, 5.0])], "session_id string, vec array<double>")
    s = D.fit_scaler(df).first()
    assert list(s["mean"]) == [2.0, 5.0] and list(s["std"]) == pytest.approx([2 ** 0.5, 0.1]) and s["floored"] == 1
    b = D.fit_batch_norm(df).first()
    assert list(b["std"]) == pytest.approx([(1 + 1e-5) ** 0.5, 1e-5 ** 0.5])


def hand_score(x, edges, attr, p, structure, agg):
    """The same forward pass written out edge by edge."""
    relu = lambda v: np.maximum(v, 0)

    def mlp(v, layers):
        for i, (w, b) in enumerate(layers):
            v = v @ w + b
            v = relu(v) if i < len(layers) - 1 else v
        return v

    x = (x - p["node_mean"]) / p["node_std"]
    a = [(r - p["edge_mean"]) / p["edge_std"] for r in attr]
    h = [mlp(r, p["node_proj"]) for r in x]
    for k, conv in enumerate(p["convs"]):
        new = []
        for v in range(len(h)):
            msg = [relu(h[s] + mlp(a[i], p["edge_proj"])) for i, (s, d) in enumerate(edges) if d == v]
            pooled = np.zeros_like(h[v])
            if msg:
                pooled = {"sum": np.sum, "mean": np.mean, "max": np.max}[agg](msg, axis=0)
            new.append(mlp(h[v] + pooled, conv["layers"]))
        h = [relu(v) for v in new] if k < len(p["convs"]) - 1 else new
    node = np.mean([(mlp(v, p["node_decoder"]) - r) ** 2 for v, r in zip(h, x)])
    if not edges:
        return 0.0, node, 0.0
    st, ed = [], []
    for i, (s, d) in enumerate(edges):
        pair = np.concatenate([h[s], h[d]])
        logit = h[s] @ h[d] if structure == "dot" else mlp(pair, p["structure_decoder"])[0]
        st.append(np.log1p(np.exp(-logit)))
        ed.append(np.mean((mlp(pair, p["edge_decoder"]) - a[i]) ** 2))
    return np.mean(st), node, np.mean(ed)


@pytest.mark.parametrize("structure, agg, convs", [("dot", "sum", 1), ("mlp", "mean", 2), ("mlp", "max", 2)])
def test_batch_score_equals_hand_computation(spark, structure, agg, convs):
    rng = np.random.default_rng(5)
    p = random_params(3, 2, convs=convs)
    p["edge_std"] = np.ones(2)
    graphs = [(rng.normal(size=(4, 3)), [(0, 1), (1, 2), (2, 2), (3, 1)]), (rng.normal(size=(1, 3)), [])]
    rows, want = [], []
    for i, (x, edges) in enumerate(graphs):
        attr = rng.normal(size=(len(edges), 2))
        rows.append((i, x.tolist(), [s for s, _ in edges], [d for _, d in edges], attr.tolist()))
        want.append(hand_score(x, edges, attr, p, structure, agg))
    df = spark.createDataFrame(rows, "session_id int, x array<array<double>>, edge_src array<bigint>, edge_dst array<bigint>, edge_attr array<array<double>>")
    got = M.batch_score(df, p, structure, agg).orderBy("session_id").collect()
    assert np.allclose([[r["structure"], r["node"], r["edge"]] for r in got], want)


def test_transition_model_sums_to_one(spark):
    edges = spark.createDataFrame([("s", 1, 2, 3), ("s", 1, 3, 1), ("s", 2, 3, 4)], "session_id string, src int, dst int, weight bigint")
    model = M.fit_transition_model(edges, 1.0)
    for src, seen in ((1, 2), (2, 1)):
        rows = model.where(F.col("src") == src).collect()
        total = sum(r["p"] for r in rows if r["dst"] is not None) + (3 - seen) * next(r["p"] for r in rows if r["dst"] is None)
        assert total == pytest.approx(1.0)
    odd = spark.createDataFrame([("t", 9, 1, 1)], "session_id string, src int, dst int, weight bigint")
    assert M.structure_error(odd, model).first()["error"] == pytest.approx(np.log(3))


def test_similarity_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4))
    x[3] = 0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cluster_id int, embedding array<double>")
    for block in (4, 1000):
        got = {(r["id_a"], r["id_b"]): r["similarity"] for r in B.cosine_similarity(df, block_rows=block).collect()}
        assert len(got) == 30 * 29 // 2
        for (a, b), s in got.items():
            want = 0.0 if 3 in (a, b) else x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b])
            assert s == pytest.approx(want, abs=1e-12)


def test_history_and_registry(spark, tmp_path):
    import datetime as dt

    from weftlog.operators import lineage as X

    docs = spark.createDataFrame(
        [("a", [(1, 0.5), (2, 0.9), (3, 0.9)]), ("b", [(1, 0.1)])], "name string, history array<struct<epoch: int, val_f1: double>>")
    got = {(r["name"], r["epoch"]): r["is_best"] for r in X.history_table(X.explode_history(docs)).collect()}
    assert got == {("a", 1): False, ("a", 2): False, ("a", 3): True, ("b", 1): True}

    t = [dt.datetime(2026, 1, d) for d in (1, 2)]
    X.record_run(str(tmp_path), spark.createDataFrame([("r1", "hdfs", "parse", "c", "j", [], t[0]), ("r2", "hdfs", "sequence", "c", "j", ["r1"], t[1])], X.RUN_SCHEMA))
    X.add_artifact(str(tmp_path), spark.createDataFrame([("r1", "annotated", "/x", t[0])], X.ARTIFACT_SCHEMA))
    X.update_metrics(str(tmp_path), spark.createDataFrame([("r1", "val", "f1", 0.5, t[0])], X.METRIC_SCHEMA))
    X.update_metrics(str(tmp_path), spark.createDataFrame([("r1", "val", "f1", 0.7, t[1])], X.METRIC_SCHEMA))
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    assert X.current(read("run_metrics"), ["run_tag", "split", "metric"]).first()["value"] == 0.7
    assert tuple(X.resolve_inputs(read("runs"), read("run_artifacts")).first()) == ("r2", "r1", "annotated", "/x")


def test_report_separates_planted_anomalies(spark, tmp_path):
    """Sessions that walk the other way round and wait longer get the higher scores."""
    import random

    from weftlog.operators import graphs as G
    from weftlog.plans import workflows as W
    from weftlog.sources import tables as S

    rng, rows, line = random.Random(4), [], 0
    for s in range(200):
        odd = s % 10 == 0
        walk = [1, 2, 3, 4, 5] * 3
        for i, c in enumerate(reversed(walk) if odd else walk):
            t = float(i * (50 if odd else 1)) + rng.random() * 0.1
            rows.append((f"s{s}", line, t, c, [str(1000 if odd else 10)]))
            line += 1
    e = spark.createDataFrame(rows, "session_id string, line_no bigint, ts double, cluster_id int, parameters array<string>")
    truth = e.select("session_id").distinct().withColumn("label", (F.substring("session_id", 2, 9).cast("int") % 10 == 0).cast("int"))
    split = D.stratified_split(truth)
    nodes, edges = G.session_graphs(e)
    emb = spark.createDataFrame([(i, [1.0]) for i in range(1, 6)], "cluster_id int, embedding array<double>")
    tables = {"nodes": nodes, "edges": edges, "sequences": D.padded_sequences(e, 15).join(split, "session_id"), "embeddings": emb}
    S.write_dataset(str(tmp_path / "d"), tables, D.dataset_meta(split, 15, 1))
    report = W.dataset_to_report(spark, str(tmp_path / "d"), str(tmp_path), node_codes=3, edge_codes=3)
    assert report.test.first()["roc_auc"] > 0.95
    assert {r["status"] for r in report.leakage.collect()} <= {"PASS", "INFO"}


def test_correlation_needs_no_pairs(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(30, 5)), rng.normal(size=(30, 3))
    a[4] = 0
    table = lambda m: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "cluster_id int, embedding array<double>")
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    i, j = np.triu_indices(30, 1)
    s, t = (unit(a) @ unit(a).T)[i, j], (unit(b) @ unit(b).T)[i, j]
    row = B.similarity_correlation(table(a), table(b)).first()
    assert row["pairs"] == 435 and abs(row["correlation"] - np.corrcoef(s, t)[0, 1]) < 1e-9


def test_nearest_is_exact_and_large_catalogs_are_refused(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "cluster_id int, embedding array<double>").repartition(5)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    got = {(r["query"], r["rank"]): r["id"] for r in B.nearest(df, df.where("cluster_id % 10 = 0"), 3).collect()}
    assert got == {(q, k + 1): int(x) for q in range(0, 40, 10) for k, x in enumerate(np.argsort(-sim[q])[:3])}
    with pytest.raises(ValueError):
        B.cosine_similarity(df, max_rows=39)


def test_nearest_holds_few_similarities_at_once_and_copies_go_by_id(spark, monkeypatch):
    rng = np.random.default_rng(6)
    kinds = rng.normal(size=(9, 5))
    m = np.vstack([kinds[rng.integers(0, 9, 90)] * rng.uniform(0.5, 2, (90, 1)), rng.normal(size=(60, 5)), np.zeros((1, 5))])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "cluster_id int, embedding array<double>").repartition(3)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    sim = (u @ u.T).round(12)
    asked = range(0, 151, 5)
    want = [(q, n + 1, int(x)) for q in asked for n, x in enumerate([x for x in np.lexsort((np.arange(151), -sim[q])) if x != q][:4])]
    product = B._units
    for cells in (1 << 21, 31 * 7, 1):
        monkeypatch.setattr(B, "CELLS", cells)
        got = sorted((r["query"], r["rank"], r["id"]) for r in B.nearest(df, df.where("cluster_id % 5 = 0"), 4).collect())
        assert got == want
    # A task's own function, on one batch of all rows.
    held = []
    monkeypatch.setattr(B, "_units", lambda column: held.append(len(column)) or product(column))
    monkeypatch.setattr(B, "CELLS", 31 * 7)
    task = []
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema: task.append(f) or spark.createDataFrame([], schema))
    B.nearest(df, df.where("cluster_id % 5 = 0"), 4)
    held.clear()
    list(task[0](iter([pd.DataFrame({"id": np.arange(151), "v": list(m)})])))
    assert sum(held) == 151 and max(held) <= 7


def test_threshold_falls_back_to_the_median(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 0), (0.2, 0)], "score double, label int")
    assert E.best_threshold(df).first()["threshold"] == 0.2
    assert E.best_threshold(df.limit(0)).first() is None


def test_a_session_without_a_score_stays_in_the_cascade(spark):
    ids = lambda *s: spark.createDataFrame([(x,) for x in s], "session_id string")
    scored = spark.createDataFrame([("b", 0.9)], "session_id string, score double")
    got = {r["session_id"]: (r["stage"], r["pred"]) for r in M.cascade(ids("a", "b", "c"), ids("a"), scored, 0.5).collect()}
    assert got == {"a": ("stage1", 1), "b": ("stage2", 1), "c": ("stage2", None)}


def test_line_numbers_do_not_overflow():
    from weftlog.sources.logs import position_bits

    assert position_bits(1, 10) == 5
    assert (2 ** 20 + 1 << position_bits(2 ** 20 + 2, 1 << 40)) > 0
    with pytest.raises(OverflowError):
        position_bits(2 ** 30, 1 << 40)


def test_fits_that_read_too_much_fail_the_leakage_report(spark):
    ds = spark.createDataFrame([(i, int(i % 3 == 0), ("train", "val", "test")[i % 5 % 3]) for i in range(60)], "session_id bigint, label int, split string")
    rows = ds.withColumn("vec", F.array(F.col("session_id").cast("double")))

    def statuses(used, mode="clean"):
        seen = E.FitCapture()
        D.fit_scaler(seen.watch("scaler", used)).first()
        seen.count("again", used)
        table = seen.table(spark)
        assert table.groupBy("split").agg(F.count_distinct("digest", "rows", "anomalous")).where("`count(DISTINCT digest, rows, anomalous)` > 1").count() == 0
        return {r["check"]: (r["value"], r["status"]) for r in E.leakage_report(ds, table, mode).collect()}

    clean = statuses(D.clean_train(rows))
    assert clean["source_scaler"] == clean["source_again"] == ("train", "PASS") and clean["anomalies_in_scaler"] == ("0", "PASS")
    whole = statuses(rows)
    assert whole["source_scaler"] == ("test,train,val", "FAIL") and whole["anomalies_in_scaler"] == ("20", "FAIL")
    noisy = statuses(D.clean_train(rows, "noisy"), "noisy")
    assert noisy["source_scaler"][1] == noisy["anomalies_in_scaler"][1] == "PASS" and noisy["anomalies_in_scaler"][0] != "0"
    assert statuses(rows.withColumn("split", F.lit(None).cast("string")))["source_scaler"] == ("unknown", "FAIL")


def test_only_undecided_sessions_are_ordered_and_scored(spark, make_events):
    from weftlog.operators import graphs as G

    sessions = {f"ok{i}": [1, 3, 1, 3] for i in range(30)} | {f"bad{i}": [1, 2] for i in range(9)} | {"long": [1] * 80}
    e = make_events(sessions)
    catalog = spark.createDataFrame([(1, "INFO a"), (2, "ERROR b"), (3, "INFO c")], "cluster_id int, template string")
    flags = D.stage1_flags(e, catalog, K.session_lengths(e))
    scanned = []

    def score(rest):
        run = G.ordered_run(rest)
        scanned.append(run.rows.count())
        return run.rows.groupBy("session_id").agg(F.avg("pos").alias("score"))

    out, rest = M.cheap_first(e, flags, score, 1.0)
    got = {r["session_id"]: (r["stage"], r["score"], r["pred"]) for r in out.collect()}
    assert scanned == [30 * 4] and rest.select("session_id").distinct().count() == 30
    assert got == {s: ("stage2", 1.5, 1) if s.startswith("ok") else ("stage1", None, 1) for s in sessions}
    plan = K.with_sequence(rest)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Join LeftAnti")


def test_packed_vectors_equal_joined_ones(spark):
    from weftlog.operators import lookups as J

    rng = np.random.default_rng(6)
    emb = spark.createDataFrame([(int(i), rng.normal(size=3).tolist()) for i in (7, -2, 1000000, 3)] + [(5, None)], "cluster_id int, embedding array<double>")
    seqs = spark.createDataFrame([("a", [7, 3, -1, 5]), ("b", []), ("c", [1000000, 8, -2]), ("d", None)], "session_id string, cids array<int>")
    get = lambda df: {r["session_id"]: r["vectors"] for r in df.collect() if r["vectors"]}
    packed = J.dense_sequence(seqs, emb, 3, small=True)
    assert get(packed) == get(J.dense_sequence(seqs, emb, 3, small=False)) and packed.count() == 4
    assert "Join" not in packed._jdf.queryExecution().executedPlan().toString()
    assert get(J.dense_sequence(seqs, emb.where("false"), 3)) == {"a": [[0.0] * 3] * 4, "c": [[0.0] * 3] * 3}
    nodes = spark.createDataFrame([(7,), (8,)], "cluster_id int")
    same = lambda small: sorted(map(str, J.attach_embedding(nodes, emb, 3, small=small).collect()))
    assert same(True) == same(False)


def test_a_noisy_fit_and_a_dataset_without_validation(spark, tmp_path):
    from weftlog.plans import workflows as W

    rows = [(f"s{s}", s * 10 + i, float(i), c, ["1"]) for s in range(40) for i, c in enumerate([1, 2, 3, 1])]
    e = spark.createDataFrame(rows, "session_id string, line_no bigint, ts double, cluster_id int, parameters array<string>")
    from weftlog.operators import graphs as G
    from weftlog.sources import tables as S

    split = D.stratified_split(e.select("session_id").distinct().withColumn("label", (F.substring("session_id", 2, 9).cast("int") % 4 == 0).cast("int")))
    nodes, edges = G.session_graphs(e)
    tables = {"nodes": nodes, "edges": edges, "sequences": D.padded_sequences(e, 4).join(split, "session_id"),
              "embeddings": spark.createDataFrame([(1, [1.0])], "cluster_id int, embedding array<double>")}
    S.write_dataset(str(tmp_path / "d"), tables, D.dataset_meta(split, 4, 1))
    report = W.dataset_to_report(spark, str(tmp_path / "d"), str(tmp_path), mode="noisy", node_codes=2, edge_codes=2)
    found = {r["check"]: (r["value"], r["status"]) for r in report.leakage.collect()}
    assert found["anomalies_in_node_scaler"][0] != "0" and {s for _, s in found.values()} == {"PASS", "INFO"}
    tables["sequences"].where("split <> 'val'").write.mode("overwrite").parquet(str(tmp_path / "d" / "sequences"))
    with pytest.raises(ValueError):
        W.dataset_to_report(spark, str(tmp_path / "d"), str(tmp_path), node_codes=2, edge_codes=2)
