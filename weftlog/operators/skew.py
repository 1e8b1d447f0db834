"""Ordering, running totals and exact percentiles that do not depend on group size.

A window partitioned by a key sorts each key in one task. That is the best plan
while every key is small, and a wall when one key holds a third of the rows. The
functions here look at the key counts first. Small keys keep the plain window.
Rows of hot keys are range-partitioned on the full order, the slice number is
checkpointed, and each (key, slice) is processed on its own; one summary row per
slice carries the offsets across slice borders. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.session import durable

ROWS_PER_TASK = 2_000_000
# Rows of a part, where rows are dealt by their keys before they are sorted and grouped.
ROWS_A_PART = 250_000
# Up to this many rows Spark chooses the parts itself.
ROWS_UNDEALT = 1_000_000
# Bins that keys are counted in before any key is counted on its own.
BINS = 4_096
# Key and slice tables up to this many counted rows are sent to every task; longer ones are joined.
FEW_ROWS = 20_000

_SLICE = "__slice"


@dataclass(frozen=True)
class HotKeys:
    """The keys with too many rows for one task, as a stored table of any length, and their totals.

    `total` counts the rows of all keys."""

    table: DataFrame
    count: int
    rows: int
    total: int

    def __bool__(self) -> bool:
        return self.count > 0

    def rest(self) -> HotKeys:
        """What is known of the other rows once those of the hot keys are split off."""
        return HotKeys(self.table, 0, 0, self.total - self.rows)

    def parts(self) -> int | None:
        """The parts that the rows of the other keys are dealt into (see `part_count`)."""
        return part_count(self.table, self.total - self.rows)


def part_count(df: DataFrame, rows: int) -> int | None:
    """Parts of about ROWS_A_PART for `rows` rows, no fewer than Spark's own setting; None for few rows.

    The number of shuffle partitions does not grow with the input, and adaptive execution merges them
    to a few per core: a task then sorts and groups a fixed share of all rows, however many there are."""
    if rows <= ROWS_UNDEALT:
        return None
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_PART))


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """`df` of `rows` rows dealt by `keys` into `part_count` parts; windows and groups on the keys, or on more, then move nothing."""
    n = part_count(df, rows)
    return df.repartition(n, *keys) if n else df


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> HotKeys:
    """Keys with more than `rows_per_task` rows, a null key included; the list stays distributed.

    Rows are counted by bins of keys first, a table of a fixed size. Only keys of bins with more rows than
    a task takes are counted one by one."""
    keyed = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(BINS)).alias("__bin"))
    bins = keyed.groupBy("__bin").agg(F.count(F.lit(1)).alias("__rows")).collect()
    total = sum(b["__rows"] for b in bins)
    full = [b["__bin"] for b in bins if b["__rows"] > rows_per_task]
    if not full:
        return HotKeys(df.select(*keys).limit(0), 0, 0, total)
    counts = keyed.where(F.col("__bin").isin(full)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    table = durable(counts.where(F.col("__rows") > rows_per_task))
    hot = table.agg(F.count(F.lit(1)).alias("n"), F.sum("__rows").alias("rows")).first()
    return HotKeys(table, hot["n"], hot["rows"] or 0, total)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, few: bool) -> DataFrame:
    """Join on keys where null equals null; `few` says that `right` was counted and is short."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    met = left.join(F.broadcast(named) if few else named, on, how)
    return met if how in ("left_semi", "left_anti") else met.drop(*[f"__r_{k}" for k in keys])


def slices(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Range-partition on `order` and store the slice each row fell into."""
    spread = df.repartitionByRange(n, *nulls_last(order)).withColumn(_SLICE, F.spark_partition_id())
    return durable(spread)


def nulls_last(order: Sequence[str]) -> list:
    """Rows with a missing time come after the others of their key, as in a stable table sort."""
    return [F.col(c).asc_nulls_last() for c in order]


def first_by(order: Sequence[str]):
    """A struct that sorts like `nulls_last(order)`, for min and min_by."""
    return F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])


def _windowed(df, keys, order, lead, sums):
    by = [F.col(k) for k in keys]
    ordered = Window.partitionBy(*by).orderBy(*nulls_last(order))
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = [(F.row_number().over(ordered) - 1).cast("bigint").alias("pos")]
    cols += [F.lead(c).over(ordered).alias(f"next_{c}") for c in lead]
    cols += [F.sum(c).over(running).alias(f"cum_{c}") for c in sums]
    return df.select("*", *cols)


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    lead: Sequence[str] = (),
    sums: Sequence[str] = (),
    rows_per_task: int = ROWS_PER_TASK,
    hot: HotKeys | None = None,
    settle: bool = False,
) -> DataFrame:
    """Add per key: `pos` (0-based), `n`, `next_<c>`, `cum_<c>` and `tot_<c>`.

    `order` must be unique within a key. `cum_` sums include the current row.
    `hot` takes the result of an earlier `hot_keys` call on the same keys. With
    `settle` the input is checkpointed first: right for merged tables, which are much
    smaller than what they were computed from and would else be computed twice.
    Without keys the input is always settled.
    """
    keys, order = list(keys), list(order)
    if settle or not keys:
        df = durable(df)
    if keys:
        hot = hot_keys(df, keys, rows_per_task) if hot is None else hot
        hot_rows = hot.rows
    else:
        total = df.count()
        hot_rows = total if total > rows_per_task else 0
    if not hot_rows:
        return _plain(dealt(df, keys, hot.total) if keys else df, keys, order, lead, sums)
    if not keys:
        return sliced(df, keys, order, hot_rows, lead=lead, sums=sums, rows_per_task=rows_per_task)
    rest, part = split_hot(df, keys, hot)
    done = sliced(part, keys, order, hot_rows, lead=lead, sums=sums, rows_per_task=rows_per_task)
    return _plain(dealt(rest, keys, hot.rest().total), keys, order, lead, sums).unionByName(done)


def split_hot(df: DataFrame, keys: Sequence[str], hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """(other rows, rows of the hot keys) for a result of `hot_keys`."""
    few, names = hot.count <= FEW_ROWS, hot.table.select(*keys)
    return null_safe(df, names, keys, "left_anti", few), null_safe(df, names, keys, "left_semi", few)


def sliced(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, *,
    lead: Sequence[str] = (), sums: Sequence[str] = (), rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """`ordered` for `rows` rows in groups of any size, slice by slice."""
    keys, order = list(keys), list(order)
    n = max(2, -(-rows // rows_per_task))
    cut = slices(df, keys + order, n)
    # One slice a task: dealt by a hash, several of them would meet in one.
    local = _windowed(cut.repartitionById(n, F.col(_SLICE)), keys + [_SLICE], order, lead, sums)
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.sum(c).alias(f"__s_{c}") for c in sums]
    if lead:
        aggs.append(
            F.min_by(F.struct(*lead), first_by(order)).alias("__head")
        )
    # One row per key and slice: no more than slices and keys together, as slices are ranges of keys.
    borders = cut.groupBy(*keys, _SLICE).agg(*aggs)
    by = Window.partitionBy(*[F.col(k) for k in keys])
    seq = by.orderBy(_SLICE)
    before = seq.rowsBetween(Window.unboundedPreceding, -1)
    cols = [
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        F.sum("__n").over(by).alias("n"),
    ]
    for c in sums:
        cols.append(F.sum(f"__s_{c}").over(before).alias(f"__off_{c}"))
        cols.append(F.sum(f"__s_{c}").over(by).alias(f"tot_{c}"))
    if lead:
        cols.append(F.lead("__head").over(seq).alias("__next"))
    borders = borders.select(*keys, _SLICE, F.col("__n"), *cols)
    n_borders = cut.select(*keys, _SLICE).distinct().count()
    joined = null_safe(local, borders, keys + [_SLICE], "inner", n_borders <= FEW_ROWS)
    last = F.col("pos") == F.col("__n") - 1
    out = [F.col(c) for c in df.columns]
    out.append((F.col("pos") + F.col("__off")).alias("pos"))
    out += [
        F.when(last, F.col(f"__next.{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}")
        for c in lead
    ]
    for c in sums:
        offset = F.coalesce(F.col(f"__off_{c}"), F.lit(0))
        out.append((F.col(f"cum_{c}") + offset).alias(f"cum_{c}"))
    out.append(F.col("n"))
    out += [F.col(f"tot_{c}") for c in sums]
    return joined.select(*out)


def _plain(df, keys, order, lead, sums):
    whole = Window.partitionBy(*[F.col(k) for k in keys])
    cols = [F.count(F.lit(1)).over(whole).alias("n")]
    cols += [F.sum(c).over(whole).alias(f"tot_{c}") for c in sums]
    return _windowed(df, keys, order, lead, sums).select("*", *cols)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Exact linear-interpolation percentiles per key, one column per entry of `probs`.

    Equal values are merged before the shuffle. `percentile` keeps the distinct
    values of a key in one task's memory, so keys with too many distinct values
    are ranked by `ordered` instead and only the two neighbours of each rank kept.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("freq"))
    )
    counts = durable(counts)
    hot = hot_keys(counts, keys, rows_per_task) if keys else counts.count() > rows_per_task
    if not hot:
        array = F.percentile(value, list(probs.values()), F.col("freq"))
        packed = counts.groupBy(*keys).agg(array.alias("__p"))
        return packed.select(*keys, *[F.col("__p")[i].alias(k) for i, k in enumerate(probs)])
    ranked = ordered(counts, keys, [value], sums=["freq"], rows_per_task=rows_per_task)
    aggs = [F.max("tot_freq").alias("__t")]
    for name, p in probs.items():
        h = (F.col("tot_freq") - 1) * F.lit(float(p))
        aggs.append(F.min(F.when(F.col("cum_freq") > F.floor(h), F.col(value))).alias(f"__lo_{name}"))
        aggs.append(F.min(F.when(F.col("cum_freq") > F.ceil(h), F.col(value))).alias(f"__hi_{name}"))
    picked = ranked.groupBy(*keys).agg(*aggs)
    out = []
    for name, p in probs.items():
        h = (F.col("__t") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo_{name}").cast("double"), F.col(f"__hi_{name}").cast("double")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return picked.select(*keys, *out)


# A key with more than one row in this many is joined by broadcast, so there are fewer such keys than this.
SHARES = 1_000


def join_weighed(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], weight: str, total: int, how: str = "inner", deal: bool = False) -> DataFrame:
    """Join `rows` to `keyed`, one row per key whose column `weight` counts the rows of the key in `rows`.

    Keys that hold more than 1 / SHARES of the `total` rows are fewer than SHARES and are broadcast, so
    their rows stay where they are; the others are shuffled, with `deal` (inner only) into parts that grow
    with the rows. `how` is inner or left. Null keys match nothing.
    """
    keys = list(keys)
    heavy = F.col(weight) * SHARES > total
    hot, cold = keyed.where(heavy).drop(weight), keyed.where(~heavy).drop(weight)
    met = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    rest = met.where(F.col("__hot").isNull()).select(*rows.columns)
    if deal:
        rest, cold = dealt(rest, keys, total), dealt(cold, keys, total)
    rest = rest.join(cold, keys, how)
    out = [*rows.columns, *[c for c in cold.columns if c not in keys]]
    return met.where("__hot").select(*out).unionByName(rest.select(*out))
