"""Session settings and the shared folder used for durable intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "weftlog", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on, for a session made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`.

    Where it is unset a folder below `spark.sql.warehouse.dir` is used. On a cluster that
    must be in a shared file system; a path of one machine is refused.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not spark.sparkContext.master.startswith("local") and ("://" not in warehouse or warehouse.startswith("file:")):
            raise ValueError(f"set spark.checkpoint.dir to a folder all executors share; {warehouse} is one machine's")
        configured = f"{warehouse}/_scratch"
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def bucketed(df: DataFrame, *keys: str, buckets: int | None = None) -> DataFrame:
    """Store `df` in the shared folder dealt by `keys`: groupings and joins on them then move nothing.

    Rows that are already dealt by `keys` are written where they are. One key is one bucket's, so
    keep keys of very many rows apart (see `skew.split_hot`)."""
    spark = df.sparkSession
    name = f"weft_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *keys).option("path", scratch_path(spark, name)).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved while the catalog knows the table; its files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
