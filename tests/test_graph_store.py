"""The versioned graph store: last write wins, old versions stay, small batches write little."""

import os
import random

import pytest
from pyspark.sql import functions as F

from weftlog.sources import graph_store as S


def node_rows(spark, rows):
    return spark.createDataFrame(rows, "session_id string, cluster_id int, w int")


def batch(spark, store, rows, **kw):
    nodes = node_rows(spark, rows)
    none = nodes.where("false")
    blocks = nodes.select("session_id").distinct()
    return S.upsert_graph(store, blocks, nodes, none.select("session_id", F.lit(1).alias("src"), F.lit(1).alias("dst")), **kw)


def held(spark, store, **kw):
    return {(r["session_id"], r["cluster_id"]): r["w"] for r in S.read_graph(spark, store, "nodes", **kw).collect()}


def test_the_last_row_of_a_key_wins(spark, tmp_path):
    store = str(tmp_path / "s")
    batch(spark, store, [("a", 1, 9), ("b", 1, 1), ("a", 1, 5)], buckets=4)
    assert held(spark, store) == {("a", 1): 5, ("b", 1): 1}
    batch(spark, store, [("a", 1, 2), ("a", 1, 30), ("a", 1, 4), ("c", 1, 7), (None, 1, 3)], buckets=4)
    assert held(spark, store) == {("a", 1): 4, ("b", 1): 1, ("c", 1): 7, (None, 1): 3}
    assert held(spark, store, version=1) == {("a", 1): 5, ("b", 1): 1}
    assert batch(spark, store, [("a", 1, 4)], buckets=4) == 3


@pytest.mark.parametrize("share,most", [(0.25, 16), (0.0, 16), (1e9, 2), (1e9, 100)])
def test_any_folding_gives_the_same_rows(spark, tmp_path, share, most):
    store, want, rng = str(tmp_path / "s"), {}, random.Random(3)
    for _ in range(5):
        rows = [(f"s{rng.randrange(12)}", rng.randrange(3), rng.randrange(1000)) for _ in range(20)]
        batch(spark, store, rows, buckets=3, fold_share=share, max_batches=most)
        want |= {(s, c): w for s, c, w in rows}
        assert held(spark, store) == want
    sets = [r for r in S.manifest(spark, store) if r["name"] == "nodes"]
    per = max(sum(r["bucket"] == b for r in sets) for b in range(3))
    assert per == {0.0: 1, 0.25: 1}.get(share, per) and per <= most + 2


def test_an_empty_batch_is_a_version(spark, tmp_path):
    store = str(tmp_path / "s")
    batch(spark, store, [("a", 1, 1)], buckets=2)
    none = node_rows(spark, [("a", 1, 1)]).where("false")
    empty = none.select("session_id"), none, none.select("session_id", F.lit(1).alias("src"), F.lit(1).alias("dst"))
    assert S.upsert_graph(store, *empty, buckets=2) == 2
    assert held(spark, store) == {("a", 1): 1}
    with pytest.raises(ValueError):
        S.read_graph(spark, str(tmp_path / "none"), "nodes")


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_a_small_batch_writes_a_small_share(spark, tmp_path):
    """One percent of the sessions, spread over all buckets, costs about one percent of the bytes."""
    store = str(tmp_path / "s")
    nodes = spark.range(200_000).select(F.concat(F.lit("s"), F.col("id") % 20_000).alias("session_id"),
                                        (F.col("id") / 20_000).cast("int").alias("cluster_id"), F.rand(1).alias("w"))
    part = nodes.where(F.substring("session_id", 2, 9).cast("int") % 100 == 7)
    edges = nodes.where("false").select("session_id", F.lit(1).alias("src"), F.lit(1).alias("dst"))
    for rows in (nodes, part):
        S.upsert_graph(store, rows.select("session_id").distinct(), rows, edges, buckets=4)
    whole, small = (folder_bytes(f"{store}/nodes/v{v}") for v in (1, 2))
    assert small < 0.03 * whole
    assert S.read_graph(spark, store, "nodes").count() == 200_000
