"""Stored tables: catalogs, annotated logs, sequences, runs, graph store, dataset bundle, reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.operators.skew import nulls_last

CATALOG_SCHEMA = "cluster_id int, template string, count bigint, examples array<string>"


def write_templates(catalog: DataFrame, path: str) -> None:
    catalog.select("cluster_id", "template", "count", "examples").write.mode("overwrite").json(path)


def read_templates(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """JSON lines, or one JSON array per file with `multiline`."""
    return spark.read.schema(CATALOG_SCHEMA).json(path, multiLine=multiline)


def write_annotated(df: DataFrame, path: str, json_parameters: bool = False) -> None:
    """Parquet; `json_parameters` stores the list as JSON text for readers without arrays."""
    if json_parameters:
        df = df.withColumn("parameters", F.to_json("parameters"))
    df.write.mode("overwrite").parquet(path)


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if df.schema["parameters"].dataType.typeName() == "string":
        df = df.withColumn("parameters", F.from_json("parameters", "array<string>"))
    return df


def write_sequences(events: DataFrame, path: str, *, session: str = "session_id", ts: str = "ts",
                    line: str = "line_no") -> None:
    """Flat events in session order. Range partitioning splits a session of any size
    over files, and each file stays sorted."""
    order = nulls_last([session, ts, line])
    events.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_run(df: DataFrame, run_tag: str | None = None, column: str = "run_tag") -> DataFrame:
    """Rows of the newest run, or of a pinned one; an error when there is none."""
    if run_tag is None:
        run_tag = df.agg(F.max(column)).first()[0]
        if run_tag is None:
            raise ValueError("no run found")
    picked = df.where(F.col(column) == run_tag)
    if picked.isEmpty():
        raise ValueError(f"run {run_tag!r} not found")
    return picked


def best_enriched_run(catalogs: DataFrame, enriched: str | Sequence[str] = "enriched", mtime: str = "mtime") -> DataFrame:
    """The run with most enriched templates, the newer one on a tie.

    A template counts if one of its records (large, small, ...) parses as an object; malformed text does not."""
    names = [enriched] if isinstance(enriched, str) else list(enriched)
    # An empty result of the parser is malformed text or null.
    is_object = [F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(c).cast("string"))).startswith("OBJECT"), F.lit(False)) for c in names]
    parses = reduce(or_, is_object)
    per = catalogs.groupBy("run_tag").agg(
        F.count_if(parses).alias("enriched_count"), F.max(mtime).alias("mtime")
    )
    key = F.struct("enriched_count", "mtime", "run_tag")
    return per.agg(F.max(key).alias("b")).select("b.run_tag", "b.enriched_count")


# --- keyed tables -----------------------------------------------------------

def upsert(stored: DataFrame | None, fresh: DataFrame, keys: Sequence[str], version: str | None = None) -> DataFrame:
    """Merge by key: stored rows whose key does not come again, plus the fresh rows.

    When a batch holds a key twice the row with the highest `version` wins. The
    pick is an aggregate, so repeated keys are merged before the shuffle."""
    keys = list(keys)
    rest = [c for c in fresh.columns if c not in keys]
    if not rest:
        fresh = fresh.distinct()
    else:
        row = F.struct(*rest)
        pick = F.max_by(row, F.struct(version)) if version else F.max(row)
        fresh = fresh.groupBy(*keys).agg(pick.alias("__r")).select(*keys, "__r.*")
    if stored is None:
        return fresh
    return stored.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


# What an absent attribute of a stored node or edge counts as.
NODE_DEFAULTS = {"occurrence_count": 1, "param_count": 0, "param_num_mean": 0.0, "param_num_max": 0.0}
EDGE_DEFAULTS = {"weight": 1, "time_delta_s": -1.0, "time_delta_std": 0.0}


def load_graph(nodes: DataFrame, edges: DataFrame, ids: Sequence[str] | None = None, with_edges: bool = True) -> DataFrame:
    """Nodes of the asked sessions with their outgoing edges; absent attributes get defaults."""
    if ids is not None:
        nodes = nodes.where(F.col("session_id").isin(list(ids)))
    nodes = nodes.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in NODE_DEFAULTS.items()})
    if not with_edges:
        return nodes
    out = edges.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in EDGE_DEFAULTS.items()})
    out = out.withColumnRenamed("src", "cluster_id")
    return nodes.join(out, ["session_id", "cluster_id"], "left")


# --- dataset bundle ---------------------------------------------------------

BUNDLE = ["nodes", "edges", "sequences", "embeddings"]
REQUIRED = {
    "nodes": ["session_id", "cluster_id"], "edges": ["session_id", "src", "dst"],
    "sequences": ["session_id", "cids", "length", "label", "split"], "embeddings": ["cluster_id", "embedding"],
}


def write_dataset(path: str, tables: dict[str, DataFrame], meta: DataFrame) -> None:
    for name in BUNDLE:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def verify_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Reload the bundle and compare counts, dimensions and split sizes with its meta row."""
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in BUNDLE}
    for name, cols in REQUIRED.items():
        missing = set(cols) - set(tables[name].columns)
        if missing:
            raise ValueError(f"{name} lacks {sorted(missing)}")
    meta = spark.read.json(f"{path}/meta").first()
    seqs = tables["sequences"]
    sizes = seqs.agg(
        F.count(F.lit(1)).alias("sessions"),
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")],
        F.max(F.size("cids")).alias("max_seq_len"), F.min(F.size("cids")).alias("min_seq_len"),
    ).first()
    dim = tables["embeddings"].agg(F.max(F.size("embedding"))).first()[0]
    rows = [
        ("sessions", meta["sessions"], sizes["sessions"]),
        ("max_seq_len", meta["max_seq_len"], sizes["max_seq_len"]),
        ("min_seq_len", meta["max_seq_len"], sizes["min_seq_len"]),
        ("embed_dim", meta["embed_dim"], dim),
        ("n_train", meta["n_train"], sizes["train"]), ("n_val", meta["n_val"], sizes["val"]),
        ("n_test", meta["n_test"], sizes["test"]),
    ]
    out = spark.createDataFrame([(c, int(a), int(b)) for c, a, b in rows], "check string, expected bigint, found bigint")
    return out.withColumn("ok", F.col("expected") == F.col("found"))


def export_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Report as CSV with header or as JSON lines; nested columns go to JSON text in CSV."""
    if fmt == "csv":
        flat = {f.name: F.to_json(f.name) for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")}
        df.withColumns(flat).write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").json(path)
