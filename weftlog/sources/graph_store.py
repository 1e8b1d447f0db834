"""Versioned store of session graphs: buckets of sessions, batches beside them, a manifest of what is live.

A store holds three tables. A row belongs to the bucket of its session. A batch is written as one more
file set of the buckets it touches, so a small batch writes little whatever the size of the
store; nothing is changed in place. The manifest of a version lists, per table and bucket, the
file sets that count, oldest first. Readers take the last manifest and let the newest file set
win per key, in the buckets that have several. When the batches of a bucket amount to a share of
its base they are folded into a new base, which keeps reads and rewrites in proportion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.session import durable

STORE_KEYS = {"blocks": ["session_id"], "nodes": ["session_id", "cluster_id"], "edges": ["session_id", "src", "dst"]}
BUCKETS = 64
# Rows of batches, as a share of a bucket's base, from which on they are folded into it, and the most
# batches a bucket may have before they are folded into one.
FOLD_SHARE = 0.25
MAX_BATCHES = 16
ROWS_PER_FILE = 5_000_000

_MANIFEST = "version bigint, name string, bucket int, written bigint, base boolean, rows bigint"


def manifest(spark: SparkSession, store: str, version: int | None = None) -> list:
    """The live file sets (name, bucket, written, base, rows) of a version, by default the last; [] where
    there is no store. At most (MAX_BATCHES + 2) rows per table and bucket."""
    try:
        all_ = spark.read.schema(_MANIFEST).parquet(f"{store}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    if version is None:
        version = all_.agg(F.max("version")).first()[0]
    return sorted(all_.where(F.col("version") == version).collect(), key=lambda r: (r["name"], r["bucket"], r["written"]))


def _sets(spark: SparkSession, store: str, name: str, live: list) -> DataFrame | None:
    """Rows of the file sets `live`, with the column `written`."""
    by_set: dict[int, list[int]] = {}
    for r in live:
        by_set.setdefault(r["written"], []).append(r["bucket"])
    parts = [spark.read.parquet(f"{store}/{name}/v{v}").where(F.col("bucket").isin(buckets)).withColumn("written", F.lit(v).cast("bigint"))
             for v, buckets in by_set.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def _newest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row with the largest `by` of every key. Picked by an aggregate, so repeats merge before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, "bucket", by)]
    picked = rows.groupBy("bucket", *keys).agg(F.max_by(F.struct(*rest, F.lit(0).alias("__")), by).alias("__r"))
    return picked.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest], "bucket")


def read_graph(spark: SparkSession, store: str, name: str, version: int | None = None) -> DataFrame:
    """Table `name` (blocks, nodes or edges) as of `version`, by default the last one."""
    live = [r for r in manifest(spark, store, version) if r["name"] == name]
    if not live:
        raise ValueError(f"no table {name!r} in {store}")
    per_bucket: dict[int, int] = {}
    for r in live:
        per_bucket[r["bucket"]] = per_bucket.get(r["bucket"], 0) + 1
    plain = _sets(spark, store, name, [r for r in live if per_bucket[r["bucket"]] == 1])
    layered = _sets(spark, store, name, [r for r in live if per_bucket[r["bucket"]] > 1])
    parts = [] if plain is None else [plain.drop("bucket", "written")]
    if layered is not None:
        parts.append(_newest(layered, STORE_KEYS[name], "written").drop("bucket"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _plan(live: list, fresh: dict[int, int], fold_share: float, max_batches: int) -> tuple[list, set[int], set[int]]:
    """(file sets to merge with the batch, buckets that get a new base, buckets whose batches become one)."""
    merge, rebased, joined = [], set(), set()
    for bucket, rows in fresh.items():
        sets = [r for r in live if r["bucket"] == bucket]
        base = [r for r in sets if r["base"]]
        batches = [r for r in sets if not r["base"]]
        size = sum(r["rows"] for r in base)
        if not base or sum(r["rows"] for r in batches) + rows >= fold_share * size:
            merge += sets
            rebased.add(bucket)
        elif len(batches) >= max_batches:
            merge += batches
            joined.add(bucket)
    return merge, rebased, joined


def _upsert(spark, store, name, version, live, fresh, order, buckets, fold_share, max_batches) -> list[tuple]:
    keys = STORE_KEYS[name]
    # Positions must not change when a task is run again, so rows that get theirs here are stored first.
    rows = durable(fresh.withColumn("__at", F.monotonically_increasing_id())) if order is None else fresh.withColumn("__at", F.col(order))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int"))
    batch = durable(_newest(rows, keys, "__at"))
    counts = {r["bucket"]: r["n"] for r in batch.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [tuple(r)[1:] for r in live]
    merge, rebased, joined = _plan(live, counts, fold_share, max_batches)
    old = _sets(spark, store, name, merge)
    if old is not None:
        layers = old.unionByName(batch.withColumn("written", F.lit(version).cast("bigint")), allowMissingColumns=True)
        folded = F.col("bucket").isin([*rebased, *joined])
        batch = batch.where(~folded).unionByName(_newest(layers.where(folded), keys, "written"), allowMissingColumns=True)
    path = f"{store}/{name}/v{version}"
    pieces = -(-max(counts.values()) // ROWS_PER_FILE)
    spread = batch.withColumn("__piece", F.pmod(F.xxhash64(*keys), F.lit(pieces))).repartition("bucket", "__piece").drop("__piece")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(path)
    written = counts if old is None else {r["bucket"]: r["n"] for r in spark.read.parquet(path).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    gone = {(r["bucket"], r["written"]) for r in merge}
    kept = [tuple(r)[1:] for r in live if (r["bucket"], r["written"]) not in gone]
    return kept + [(name, b, version, b in rebased, n) for b, n in written.items()]


def upsert_graph(store: str, blocks: DataFrame, nodes: DataFrame, edges: DataFrame, *, order: str | None = None,
                 buckets: int = BUCKETS, fold_share: float = FOLD_SHARE, max_batches: int = MAX_BATCHES) -> int:
    """Merge a batch into the store and return the new version; versions already written stay readable.

    A key that comes again replaces its stored row as a whole. Within a batch the last row of a key
    wins: by the column `order`, or by the position of the row in the batch. An empty batch is a
    version too. `buckets` is fixed by the first batch. One writer at a time; a batch that fails
    leaves no manifest and can be written again.
    """
    spark = blocks.sparkSession
    live = manifest(spark, store)
    version = max((r["version"] for r in live), default=0) + 1
    sets: list[tuple] = []
    for name, fresh in {"blocks": blocks, "nodes": nodes, "edges": edges}.items():
        mine = [r for r in live if r["name"] == name]
        sets += _upsert(spark, store, name, version, mine, fresh, order, buckets, fold_share, max_batches)
    entry = spark.createDataFrame([(version, *s) for s in sets], _MANIFEST)
    entry.coalesce(1).write.mode("append").parquet(f"{store}/manifest")
    return version
