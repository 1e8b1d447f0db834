"""Reading raw logs and label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.functions.columns import strip_header
from weftlog.operators.skew import ordered

# The last bits of a file's rank hold the position inside the file, if both fit.
_WORD_BITS = 63


def with_line_no(df: DataFrame) -> DataFrame:
    """A BIGINT that sorts lines in file order: file rank, block start, row in task.

    A full split is read by its own task and has at least one byte per line, so
    block start plus the row counter never overtakes the next split of the file.
    The rank is the file's place in the sorted listing of the files themselves, in the
    spelling the rows carry; a line whose file is not listed stops the job, and so does a
    position that does not fit beside the rank."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_size").alias("__size"),
                     F.col("_metadata.file_block_start").alias("__start"), row.alias("__row"))
    listed = rows.select("__file", "__size").distinct()
    listed = ordered(listed, [], ["__file"]).select("__file", F.col("pos").alias("__rank"), "__size")
    span = listed.agg(F.count(F.lit(1)).alias("n"), F.max("__size").alias("size")).first()
    bits = position_bits(span["n"], span["size"] or 0)
    if span["n"] <= 1:
        place = F.col("__start") + F.col("__row")
    else:
        rows = rows.join(listed.drop("__size"), "__file", "left")
        rank = F.coalesce("__rank", F.raise_error(F.lit("a line of a file that is not listed")).cast("bigint"))
        place = F.shiftleft(rank, bits) + F.col("__start") + F.col("__row")
    return rows.withColumn("line_no", place).select(*df.columns, "line_no")


def position_bits(files: int, size: int) -> int:
    """Bits for the position inside a file of `size` bytes, beside the rank of `files` files."""
    bits = (2 * size).bit_length()
    if bits + max(files - 1, 0).bit_length() > _WORD_BITS:
        raise OverflowError("file rank and position do not fit one line number")
    return bits


def dense_line_no(df: DataFrame) -> DataFrame:
    """Replace `line_no` by 1..n in the same order."""
    return ordered(df, [], ["line_no"]).withColumn("line_no", F.col("pos") + 1).drop("pos", "n")


def parse_hdfs_lines(df: DataFrame, value: str = "value", date_format: str = "ddMMyy") -> DataFrame:
    """Three header tokens, then the content; level and component stay in the content.

    Some logs write the year first; pass `date_format='yyMMdd'` for those."""
    parts = F.split(F.col(value), r"\s+", 4)
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))), F.lit(f"{date_format} HHmmss"))
    return df.select(
        *[c for c in df.columns if c != value],
        *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(["date", "time", "thread"])],
        stamp.alias("timestamp"), F.col(value).alias("raw"), strip_header(value).alias("content"),
    )


def read_hdfs_log(spark: SparkSession, path: str, date_format: str = "ddMMyy") -> DataFrame:
    return parse_hdfs_lines(with_line_no(spark.read.text(path)), date_format=date_format)


def parse_bgl_lines(df: DataFrame, value: str = "value") -> DataFrame:
    """Nine header fields and the message; a label other than '-' marks an alert."""
    p = F.split(F.col(value), r"\s+", 10)
    names = ["label", "unix_ts", "date", "node_id", "datetime", "node_repeat", "component", "subcomponent", "level", "message"]
    cols = [F.get(p, F.lit(i)).alias(n) for i, n in enumerate(names) if n != "unix_ts"]
    return df.select(
        *[c for c in df.columns if c != value], *cols, F.get(p, F.lit(1)).try_cast("bigint").alias("unix_ts"),
        (F.get(p, F.lit(0)) != "-").alias("is_anomaly"), F.col(value).alias("raw"),
    )


def read_bgl_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_bgl_lines(with_line_no(spark.read.text(path)))


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"))


def read_labels(spark: SparkSession, path: str, session: str = "session_id") -> DataFrame:
    """CSV `BlockId,Label`: 0 for exactly 'Normal', 1 for anything else."""
    df = spark.read.csv(path, header=True)
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.select(
        F.col("BlockId").alias(session), (F.col("Label") != "Normal").cast("int").alias("label")
    )


def cap_lines(df: DataFrame, n: int, line: str = "line_no") -> DataFrame:
    return df.where(F.col(line) <= n)


def subsample(df: DataFrame, n: int, split: str = "split", order: str = "session_id") -> DataFrame:
    """First n rows of every split. The row-number bound is applied before the shuffle too."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(split).orderBy(order))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")
