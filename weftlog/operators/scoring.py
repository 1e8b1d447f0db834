"""Reconstruction scoring: fit on clean training sessions, score every session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.operators.sessions import SESSION
from weftlog.session import durable

COMPONENTS = ["structure", "node", "edge"]


def fit_vector_reconstructor(train: DataFrame, k: int, vec: str = "vec") -> PCAModel:
    """Linear encoder and decoder of standardised vectors (distributed covariance)."""
    rows = train.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="code").fit(rows)


def reconstruction_error(df: DataFrame, model: PCAModel, vec: str = "vec", out: str = "error") -> DataFrame:
    """Mean squared reconstruction error per vector.

    The components are orthonormal, so |x - PP'x|^2 = |x|^2 - |P'x|^2 and the
    projection of the fitted model is all that is needed."""
    def squares(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)

    rows = df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))
    coded = model.setInputCol("features").setOutputCol("code").transform(rows)
    gap = squares(vector_to_array("features")) - squares(vector_to_array("code"))
    return coded.withColumn(out, F.greatest(gap, F.lit(0.0)) / F.size(vec)).drop("features", "code")


def fit_transition_model(train_edges: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Smoothed p(dst | src) from the edges of clean training sessions.

    Rows with a null `dst` hold what an unseen successor of that source gets."""
    # The fitted pairs are at most templates squared; they are stored once.
    pairs = durable(train_edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")))
    v = pairs.select(F.explode(F.array("src", "dst")).alias("c")).distinct().count()
    totals = pairs.groupBy("src").agg(F.sum("w").alias("total"))
    base = F.col("total") + F.lit(alpha * v)
    seen = pairs.join(totals, "src").select("src", "dst", ((F.col("w") + alpha) / base).alias("p"))
    unseen = totals.select("src", F.lit(None).cast("int").alias("dst"), (F.lit(alpha) / base).alias("p"))
    return durable(seen.unionByName(unseen).withColumn("vocabulary", F.lit(v)))


# A transition model of up to this many rows is sent to every task (about 60 bytes a row).
SMALL_MODEL_ROWS = 500_000


def structure_error(edges: DataFrame, model: DataFrame, small: bool | None = None) -> DataFrame:
    """-ln p per edge; unseen successors and sources get their smoothed share.

    The rows of the model are counted. Up to `SMALL_MODEL_ROWS` it is broadcast and edges are scored
    where they are, keeping how they are dealt; a larger model is joined by shuffle."""
    rows, v = model.agg(F.count(F.lit(1)), F.max("vocabulary")).first()
    small = rows <= SMALL_MODEL_ROWS if small is None else small
    side = F.broadcast if small else lambda df: df
    seen = side(model.where(F.col("dst").isNotNull()).select("src", "dst", "p"))
    unseen = side(model.where(F.col("dst").isNull()).select("src", F.col("p").alias("p_unseen")))
    met = edges.join(seen, ["src", "dst"], "left").join(unseen, "src", "left")
    p = F.coalesce("p", "p_unseen", F.lit(1.0 / (v or 1)))
    return met.select(*edges.columns, (-F.log(p)).alias("error"))


def session_component_scores(nodes: DataFrame, edges: DataFrame, *, session: str = SESSION) -> DataFrame:
    """Mean structure, node and edge error per session; 0 where a session has no edges.

    `nodes` carries `node_error`; `edges` carries `structure_error` and `edge_error`."""
    a = nodes.groupBy(session).agg(F.avg("node_error").alias("node"))
    b = edges.groupBy(session).agg(F.avg("structure_error").alias("structure"), F.avg("edge_error").alias("edge"))
    rows = a.join(b, session, "left")
    return rows.select(session, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in COMPONENTS])


def anomaly_score(df: DataFrame, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0) -> DataFrame:
    score = alpha * F.col("structure") + beta * F.col("node") + gamma * F.col("edge")
    return df.withColumn("score", score)


def predict(df: DataFrame, threshold: float | Column) -> DataFrame:
    """Strictly above the threshold."""
    return df.withColumn("pred", (F.col("score") > threshold).cast("int"))


def cascade(sessions: DataFrame, flags: DataFrame, scored: DataFrame, threshold: float, *,
            session: str = SESSION) -> DataFrame:
    """Flagged sessions are decided at once; only the rest use the graph score. A session that has
    neither stays, with no score and no prediction."""
    decided = flags.select(session, F.lit("stage1").alias("stage"), F.lit(None).cast("double").alias("score"), F.lit(1).alias("pred"))
    rest = sessions.join(flags.select(session), session, "left_anti").join(scored.select(session, "score"), session, "left")
    second = predict(rest, threshold).select(session, F.lit("stage2").alias("stage"), "score", "pred")
    return decided.unionByName(second)


def cheap_first(events: DataFrame, flags: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, *,
                session: str = SESSION) -> tuple[DataFrame, DataFrame]:
    """(decisions, undecided events): stage 1 runs first, and `score` sees the events of undecided sessions only.

    `flags` has the sessions stage 1 has decided (see `stage1_flags`); it is stored, because it is read
    before and after. The anti join stands below whatever `score` does, so flagged sessions are neither
    ordered nor scored, and it deals events by session as the ordering needs them."""
    flags = durable(flags)
    sessions = events.select(session).distinct()
    rest = events.join(flags.select(session), session, "left_anti")
    return cascade(sessions, flags, score(rest), threshold, session=session), rest


# --- scoring with externally trained weights ---------------------------------


def _dense(x: np.ndarray, layers: list, last_relu: bool = False) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1 or last_relu:
            x = np.maximum(x, 0.0)
    return x


def _pool(messages: np.ndarray, dst: np.ndarray, n: int, agg: str) -> np.ndarray:
    out = np.zeros((n, messages.shape[1]))
    if agg == "max":
        np.maximum.at(out, dst, messages)  # messages are >= 0
        return out
    np.add.at(out, dst, messages)
    if agg == "mean":
        out /= np.maximum(np.bincount(dst, minlength=n), 1)[:, None]
    return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def score_graph(x, src, dst, attr, params: dict, structure: str, agg: str) -> tuple[float, float, float]:
    """(structure, node, edge) error of one graph under the given weights."""
    x = (x - params["node_mean"]) / params["node_std"]
    h = _dense(x, params["node_proj"])
    has = len(src) > 0
    if has:
        attr = (attr - params["edge_mean"]) / params["edge_std"]
        e = _dense(attr, params["edge_proj"])
    for i, conv in enumerate(params["convs"]):
        pooled = _pool(np.maximum(h[src] + e, 0.0), dst, len(h), agg) if has else np.zeros_like(h)
        h = _dense((1.0 + conv.get("eps", 0.0)) * h + pooled, conv["layers"])
        if i < len(params["convs"]) - 1:
            h = np.maximum(h, 0.0)
    node = float(np.mean((_dense(h, params["node_decoder"]) - x) ** 2))
    if not has:
        return 0.0, node, 0.0
    pair = np.concatenate([h[src], h[dst]], axis=1)
    logit = (h[src] * h[dst]).sum(axis=1) if structure == "dot" else _dense(pair, params["structure_decoder"])[:, 0]
    edge = float(np.mean((_dense(pair, params["edge_decoder"]) - attr) ** 2))
    return float(np.mean(_softplus(-logit))), node, edge


def batch_score(records: DataFrame, params: dict, structure: str = "dot", agg: str = "sum", *,
                session: str = SESSION) -> DataFrame:
    """Component errors of packed graph rows (see `graph_records`) with given weights.

    `params` holds numpy matrices: one entry of `convs` is the single-layer encoder,
    two are the deeper one; one layer in `convs[i]['layers']` is the linear node
    transform, two the mlp. The weights are broadcast once to the executors."""
    weights = records.sparkSession.sparkContext.broadcast(params)
    kind = records.schema[session].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = weights.value
        for pdf in batches:
            rows = [
                score_graph(
                    np.vstack(x), np.asarray(s, dtype=int), np.asarray(d, dtype=int),
                    np.vstack(a) if len(a) else None, p, structure, agg,
                )
                for x, s, d, a in zip(pdf["x"], pdf["edge_src"], pdf["edge_dst"], pdf["edge_attr"])
            ]
            out = pd.DataFrame(np.nan_to_num(np.array(rows).reshape(-1, 3)), columns=COMPONENTS)
            out.insert(0, session, pdf[session].to_numpy())
            yield out

    cols = records.select(session, "x", "edge_src", "edge_dst", "edge_attr")
    return cols.mapInPandas(run, f"{session} {kind}, structure double, node double, edge double")
