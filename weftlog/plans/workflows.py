"""The end-to-end flows: raw log to dataset, dataset to scores and report, new events to decisions.

Each stage writes a table under `<store>/<run_tag>/` and the next one reads it,
so a lost executor costs tasks, not stages, and a stage can be looked at or reused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCAModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.functions.columns import finite_array
from weftlog.operators import dataset as D
from weftlog.operators import embeddings as B
from weftlog.operators import evaluation as E
from weftlog.operators import graphs as G
from weftlog.operators import scoring as M
from weftlog.operators import sessions as K
from weftlog.operators import templates as T
from weftlog.operators.lookups import attach_embedding
from weftlog.session import durable
from weftlog.sources import tables as S


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def log_lines(lines: DataFrame) -> DataFrame:
    """Parsed lines of either log in one form: BGL lines have a message and epoch seconds, HDFS lines content and a time."""
    if "content" in lines.columns:
        return lines
    return lines.withColumns({"content": F.col("message"), "timestamp": F.timestamp_seconds("unix_ts")})


def log_sessions(annotated: DataFrame, sessions: str, window_s: int, slide_s: int | None) -> DataFrame:
    """Session id per event: an entity column such as block_id or node_id, or `window` for time windows.

    Empty and null entities have no session. With a slide shorter than the window an event is in several."""
    if sessions != "window":
        return K.sessions_by_key(annotated.withColumn(sessions, F.nullif(F.col(sessions), F.lit(""))), sessions)
    seconds = annotated.withColumn("__s", F.unix_seconds("timestamp") if "unix_ts" not in annotated.columns else F.col("unix_ts"))
    windows = K.sessions_by_window(seconds.where(F.col("__s").isNotNull()), window_s, slide_s, "__s", "session_id")
    return windows.drop("__s")


def template_embeddings(catalog: DataFrame, encode: Callable[[list[str]], np.ndarray] | None = None) -> tuple[DataFrame, int]:
    """(cluster_id and embedding, dimensions): TF-IDF, followed by the vectors of `encode` where one is given."""
    texts = catalog.select("cluster_id", F.col("template").alias("text"))
    sparse = durable(B.tfidf(texts))
    vocab = durable(B.vocabulary(sparse))
    dim = vocab.count()
    lexical = B.tfidf_dense(sparse, vocab, dim)
    # A template without a token, such as an empty line, has no TF-IDF row.
    lexical = texts.select("cluster_id").join(lexical, "cluster_id", "left").withColumn(
        "embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), dim)))
    if encode is None:
        return lexical, dim
    semantic = durable(B.encode_texts(texts, encode))
    wide = semantic.agg(F.max(F.size("embedding"))).first()[0] or 0
    return B.hybrid_embeddings(lexical, semantic, wide), dim + wide


def raw_to_dataset(lines: DataFrame, store: str, run_tag: str, labels: DataFrame | None = None, *,
                   scale: str = "raw", max_len: int | None = None, sessions: str = "block_id", window_s: int = 21_600,
                   slide_s: int | None = None, encode: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """Parsed lines (see `read_hdfs_log`, `read_bgl_log`) to a dataset bundle; returns its meta row.

    Learn templates, annotate against the frozen catalog, drop unmatched and unkeyed lines (the
    meta row counts both), build session graphs, embeddings, labels, splits and padded sequences.
    `sessions` names the entity column or is `window`; `encode` adds semantic vectors to TF-IDF. Labels
    are `labels`, or else `is_anomaly` of the lines where they have it (a session with an alert is 1),
    or else error templates. The bundle keeps template ids; vectors are joined where they are used."""
    base = f"{store}/{run_tag}"
    lines = stored(log_lines(lines), f"{base}/lines")
    catalog = stored(T.mine_templates(lines), f"{base}/templates")
    annotated = stored(T.annotate(lines, catalog), f"{base}/annotated")
    matched = log_sessions(annotated.where(F.col("cluster_id").isNotNull()), sessions, window_s, slide_s)
    alert = [c for c in ("is_anomaly",) if c in lines.columns]
    events = matched.select("session_id", F.col("timestamp").alias("ts"), "line_no", "cluster_id", "parameters", "template", *alert)

    vectors, dim = template_embeddings(catalog, encode)
    embeddings = stored(vectors, f"{base}/embeddings")

    source = "heuristic"
    if labels is None and alert:
        labels, source = K.window_label(events, "session_id"), "line_alerts"
    elif labels is not None:
        source = "ground_truth"
    truth = D.resolve_labels(events, labels, catalog)
    split = stored(D.stratified_split(truth.select("session_id", "label")), f"{base}/split")
    if max_len is None:
        max_len = D.choose_max_len(K.session_lengths(events)).first()["max_len"]
    nodes, edges = G.session_graphs(events, scale)
    padded = D.padded_sequences(events, max_len).join(split, "session_id")
    tables = {"nodes": nodes, "edges": edges, "sequences": padded, "embeddings": embeddings}
    keyed = F.col("timestamp").isNotNull() if sessions == "window" else F.coalesce(F.col(sessions), F.lit("")) != ""
    dropped = annotated.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("cluster_id").isNull()).alias("unmatched_lines"),
        F.count_if(F.col("cluster_id").isNotNull() & ~keyed).alias("unkeyed_lines")).first()
    meta = D.dataset_meta(split, max_len, dim, source, n_templates=catalog.count(), run_tag=run_tag).withColumns(
        {k: F.lit(v) for k, v in dropped.asDict().items()})
    S.write_dataset(f"{base}/dataset", tables, meta)
    return meta


def _vectors(df: DataFrame, scalars: list[str], embedding: str | None = None) -> DataFrame:
    parts = F.array(*[F.col(c).cast("double") for c in scalars])
    whole = F.concat(F.col(embedding), parts) if embedding else parts
    return df.withColumn("vec", finite_array(whole))


@dataclass
class Fitted:
    """What the fits of a dataset leave behind: all that scoring other sessions takes."""

    embeddings: DataFrame
    dim: int
    node_scaler: DataFrame
    node_model: PCAModel
    edge_scaler: DataFrame
    edge_model: PCAModel
    transitions: DataFrame
    weights: tuple[float, float, float]

    def node_vectors(self, nodes: DataFrame) -> DataFrame:
        return _vectors(attach_embedding(nodes, self.embeddings, self.dim), G.NODE_SCALARS, "embedding")

    def score(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """session_id, structure, node, edge, score of session graphs, whatever split they are of."""
        def errors(rows, scaler, model, name):
            return M.reconstruction_error(D.apply_scaler(rows, scaler), model, out=name).drop("vec")

        node_rows = errors(self.node_vectors(nodes), self.node_scaler, self.node_model, "node_error")
        edge_rows = errors(_vectors(edges, G.EDGE_SCALARS), self.edge_scaler, self.edge_model, "edge_error")
        edge_rows = M.structure_error(edge_rows, self.transitions).withColumnRenamed("error", "structure_error")
        return M.anomaly_score(M.session_component_scores(node_rows, edge_rows), *self.weights)


def fit_dataset(spark: SparkSession, dataset: str, *, node_codes: int = 4, edge_codes: int = 3, smoothing: float = 1.0,
                weights: tuple[float, float, float] = (1.0, 1.0, 1.0), mode: str = "clean") -> tuple[Fitted, DataFrame]:
    """(fitted, what the fits read): scalers, reconstructors and transitions from the training sessions,
    without the anomalous ones unless `mode` is noisy."""
    split = spark.read.parquet(f"{dataset}/sequences").select("session_id", "label", "split")
    train = D.clean_train(split, mode)
    embeddings = spark.read.parquet(f"{dataset}/embeddings")
    dim = embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0
    seen = E.FitCapture()

    def in_train(name):
        return spark.read.parquet(f"{dataset}/{name}").join(train, "session_id")

    def fit(rows, codes, name):
        scaler = durable(D.fit_scaler(seen.watch(f"{name}_scaler", rows)))
        return scaler, M.fit_vector_reconstructor(seen.count(f"{name}_reconstructor", D.apply_scaler(rows, scaler)), codes)

    nodes = _vectors(attach_embedding(in_train("nodes"), embeddings, dim), G.NODE_SCALARS, "embedding")
    edges = in_train("edges")
    node_scaler, node_model = fit(nodes, node_codes, "node")
    edge_scaler, edge_model = fit(_vectors(edges, G.EDGE_SCALARS), edge_codes, "edge")
    transitions = M.fit_transition_model(seen.count("transitions", edges), smoothing)
    fitted = Fitted(embeddings, dim, node_scaler, node_model, edge_scaler, edge_model, transitions, weights)
    return fitted, seen.table(spark)


@dataclass
class Report:
    threshold: float
    scores: DataFrame
    validation: DataFrame
    test: DataFrame
    components: DataFrame
    contribution: DataFrame
    leakage: DataFrame
    fitted: Fitted


def dataset_to_report(spark: SparkSession, dataset: str, store: str, *, mode: str = "clean", **fit) -> Report:
    """Fit on training sessions (`mode` clean or noisy), score all, choose the threshold on validation, report on test.

    `fit` takes the parameters of `fit_dataset`. A validation split without sessions gives no
    threshold and stops the job."""
    split = spark.read.parquet(f"{dataset}/sequences").select("session_id", "label", "split")
    fitted, used = fit_dataset(spark, dataset, mode=mode, **fit)
    scored = fitted.score(spark.read.parquet(f"{dataset}/nodes"), spark.read.parquet(f"{dataset}/edges"))
    scored = stored(scored.join(split, "session_id"), f"{store}/scores")

    val, test = scored.where("split = 'val'"), scored.where("split = 'test'")
    best = E.best_threshold(val).first()
    if best is None:
        raise ValueError(f"no validation sessions in {dataset}, so no threshold")
    threshold = float(best["threshold"])
    pred = M.predict(test, threshold)
    return Report(
        threshold, scored, E.metric_summary(val, threshold), E.metric_summary(test, threshold),
        E.component_auc(test), E.contribution(pred), E.leakage_report(split, used, mode), fitted,
    )


@dataclass
class Decisions:
    """`sessions`: session_id, stage, score, pred of every session; `flags`: what stage 1 decided; `undecided`: the
    events that were ordered and scored."""

    sessions: DataFrame
    flags: DataFrame
    undecided: DataFrame


def events_to_decisions(events: DataFrame, catalog: DataFrame, fitted: Fitted, threshold: float, scale: str = "raw") -> Decisions:
    """New events (session_id, ts, line_no, cluster_id, parameters), cheap rules first: sessions with an error template or an
    outlying length are decided by counts alone, and only the others become graphs and are scored."""
    flags = durable(D.stage1_flags(events, catalog, K.session_lengths(events)))
    sessions, undecided = M.cheap_first(events, flags, lambda rest: fitted.score(*G.session_graphs(rest, scale)), threshold)
    return Decisions(sessions, flags, undecided)
