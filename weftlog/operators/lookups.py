"""Left joins against template, embedding and label tables, with defaults for unknown keys.

Only embedding tables are forced to broadcast, after a count. Elsewhere Spark broadcasts a
side whose measured size is below `spark.sql.autoBroadcastJoinThreshold` and otherwise
shuffles, where adaptive execution splits a hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftlog.functions.columns import keyword_flag
from weftlog.operators.sessions import CLUSTER, SESSION


def attach_template(df: DataFrame, catalog: DataFrame, cluster: str = CLUSTER) -> DataFrame:
    joined = df.join(catalog.select(cluster, "template"), cluster, "left")
    return joined.withColumn("template", F.coalesce("template", F.lit("")))


# Numbers of an embedding table that is sent to every task (64 MB); a larger one is joined by shuffle.
SMALL_EMBEDDING_CELLS = 8_000_000


def embeddings_are_small(embeddings: DataFrame, dim: int) -> bool:
    return embeddings.count() * dim <= SMALL_EMBEDDING_CELLS


def attach_embedding(nodes: DataFrame, embeddings: DataFrame, dim: int, cluster: str = CLUSTER, small: bool | None = None) -> DataFrame:
    """Vectors by template id, zeros for unknown ids. A table whose counted size is small is broadcast and nodes stay where they are."""
    small = embeddings_are_small(embeddings, dim) if small is None else small
    side = embeddings.select(cluster, "embedding")
    joined = nodes.join(F.broadcast(side) if small else side, cluster, "left")
    zero = F.array_repeat(F.lit(0.0), dim)
    return joined.withColumn("embedding", F.coalesce("embedding", zero))


def attach_label(sessions: DataFrame, labels: DataFrame, session: str = SESSION) -> DataFrame:
    """Missing labels become 0; `label_defaulted` keeps them countable."""
    joined = sessions.join(labels.select(session, F.col("label").alias("__l")), session, "left")
    return joined.withColumns({
        "label": F.coalesce("__l", F.lit(0)), "label_defaulted": F.col("__l").isNull()
    }).drop("__l")


def error_clusters(catalog: DataFrame, cluster: str = CLUSTER) -> DataFrame:
    return catalog.where(keyword_flag("template")).select(cluster).distinct()


def flag_error_sessions(events: DataFrame, error_ids: DataFrame, *, session: str = SESSION,
                        cluster: str = CLUSTER) -> DataFrame:
    """Sessions holding any error template. The pairs are merged first, so a hot
    template or session reaches the join once."""
    pairs = events.select(session, cluster).distinct()
    return pairs.join(error_ids, cluster, "left_semi").select(session).distinct()


def attach_enrichment(catalog: DataFrame, enriched: DataFrame, cluster: str = CLUSTER) -> DataFrame:
    return catalog.join(enriched, cluster, "left")


def dense_sequence(sequences: DataFrame, embeddings: DataFrame, dim: int, *, session: str = SESSION,
                   ids: str = "cids", cluster: str = CLUSTER, small: bool | None = None) -> DataFrame:
    """Vectors in place of padded ids; pad, null and unknown ids give a zero row.

    Sequences keep their ids until here. A table whose counted size is small goes to every task as one
    matrix and a sequence is looked up in it as a whole. A larger one is joined to the exploded
    ids, which are gathered again per sequence."""
    small = embeddings_are_small(embeddings, dim) if small is None else small
    if not small:
        return _joined_sequence(sequences, embeddings, dim, session, ids, cluster)
    rows = embeddings.where(F.col(cluster).isNotNull() & F.col("embedding").isNotNull()).select(cluster, F.col("embedding").cast("array<double>")).collect()
    keys = np.array([r[0] for r in rows], dtype=np.int64)
    order = np.argsort(keys)
    matrix = np.zeros((len(rows) + 1, dim))  # the last row stands for ids without a vector
    matrix[:-1] = np.array([rows[i][1] for i in order], dtype=float).reshape(len(rows), dim)
    sent = sequences.sparkSession.sparkContext.broadcast((keys[order], matrix))
    schema = StructType([sequences.schema[session], *StructType.fromDDL("vectors array<array<double>>").fields])
    fields = to_arrow_schema(schema)

    def run(batches):
        known, vectors = sent.value
        for batch in batches:
            lists = batch.column(1)
            wanted = pc.fill_null(lists.flatten().cast(pa.int64()), -1).to_numpy()
            at = np.searchsorted(known, wanted)
            at = np.where(np.append(known, 0)[at] == wanted, at, len(known)) if len(known) else np.zeros(len(wanted), np.int64)
            flat = pa.array(vectors[at].ravel())
            steps = pa.ListArray.from_arrays(pa.array(np.arange(0, len(wanted) * dim + 1, dim, dtype=np.int32)), flat) if dim else None
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy())]).astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(ends), steps)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(fields.field(0).type), out.cast(fields.field(1).type)], schema=fields)

    return sequences.select(session, ids).mapInArrow(run, schema)


def _joined_sequence(sequences: DataFrame, embeddings: DataFrame, dim: int, session: str, ids: str, cluster: str) -> DataFrame:
    steps = sequences.select(session, F.posexplode(ids).alias("step", cluster))
    joined = attach_embedding(steps, embeddings, dim, cluster, small=False)
    packed = joined.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("step", F.col("embedding").alias("v")))).alias("__s"))
    return packed.select(session, F.col("__s.v").alias("vectors"))
