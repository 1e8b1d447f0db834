"""What the operators of this subpackage share: batches in and out of Python, shared files, session settings."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftlog.session import scratch_path, tune

# Rows of one Arrow batch; with the byte bound below it keeps a worker's memory flat for long texts.
BATCH_ROWS = 1000
BATCH_BYTES = "16m"


def tuned(spark: SparkSession) -> SparkSession:
    """The session with the settings every operator here relies on."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEARERS: dict[str, Callable[[], None]] = {}
_holder: str | None = None


def holds(name: str, clear: Callable[[], None]) -> None:
    """Register what a module keeps in a Python worker between tasks, such as a memo of words."""
    _CLEARERS[name] = clear


def take_worker(name: str | None) -> None:
    """Called where a task starts: workers are reused, so what tasks of another kind left behind is freed
    and given back to the system. Tasks of one kind keep what they hold."""
    global _holder
    if name == _holder:
        return
    for other, clear in _CLEARERS.items():
        if other != name:
            clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass
    _holder = name


def map_batches(df: DataFrame, fn: Callable[..., dict | None], schema: str, kind: str | None = None, leave: bool = False) -> DataFrame:
    """`fn(column lists...)` per Arrow batch, in the order of the columns of `df`; it returns a
    dict of equally long lists or arrays, or None for no rows. `kind` names what its tasks hold;
    with `leave` they free it at their end, for work that is followed by other work."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        take_worker(kind)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = fn(*[batch.column(i).to_pylist() for i in range(batch.num_columns)])
            if out is not None:
                yield as_batch(out, fields)
        if leave:
            take_worker(None)

    return df.mapInArrow(run, schema)


def with_column(df: DataFrame, inputs: list[str], fn: Callable[..., list], name: str, ddl: str, kind: str | None = None) -> DataFrame:
    """`df` with one more column, `fn(lists of the input columns)`; all other columns pass as they are."""
    order = [df.columns.index(c) for c in inputs]
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"{name} {ddl}").fields])
    fields = to_arrow_schema(schema)

    def run(batches):
        take_worker(kind)
        for batch in batches:
            new = pa.array(fn(*[batch.column(i).to_pylist() for i in order]), type=fields.field(name).type)
            yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(batch.columns, fields)], new], schema=fields)

    return df.mapInArrow(run, schema)


def as_batch(out: dict, fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in fields], schema=fields)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once into the shared folder and read it back: a cut of the lineage that
    survives lost executors, with column pruning for later readers."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path inside it for a shared folder, reachable from any task."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def unique(prefix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex}"
