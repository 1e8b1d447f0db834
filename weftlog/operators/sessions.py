"""Sessionising, ordering and session-length statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.operators.skew import ROWS_PER_TASK, HotKeys, first_by, nulls_last, ordered, sliced

SESSION, TS, LINE, CLUSTER = "session_id", "ts", "line_no", "cluster_id"


def micros(col: Column | str, df: DataFrame | None = None) -> Column:
    """Microseconds of a timestamp column, or of a numeric column in seconds."""
    name = col if isinstance(col, str) else None
    c = F.col(col) if isinstance(col, str) else col
    if df is not None and name is not None:
        kind = df.schema[name].dataType.typeName()
        if not kind.startswith("timestamp") and kind != "date":
            return F.round(c.cast("double") * 1e6).cast("bigint")
    return F.unix_micros(c.cast("timestamp"))


def drop_unkeyed(df: DataFrame, key: str = SESSION) -> DataFrame:
    return df.where(F.col(key).isNotNull())


def unkeyed_report(df: DataFrame, key: str = SESSION) -> DataFrame:
    missing = F.count_if(F.col(key).isNull())
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        missing.alias("dropped"),
        (100.0 * missing / F.count(F.lit(1))).alias("dropped_pct"),
    )


def sessions_by_key(events: DataFrame, key: str, out: str = SESSION) -> DataFrame:
    """Use an entity column as session id; rows without one are dropped. Stays flat."""
    return drop_unkeyed(events, key).withColumn(out, F.col(key))


def sessions_by_window(
    events: DataFrame, size_s: int = 21_600, slide_s: int | None = None,
    unix_ts: str = "unix_ts", out: str = "window_id",
) -> DataFrame:
    """Integer time windows. With a slide shorter than the size an event belongs to
    every window that covers it; window k then starts at k * slide."""
    t = F.floor(F.col(unix_ts)).cast("bigint")
    if slide_s is None or slide_s == size_s:
        return events.withColumn(out, F.floor(t / F.lit(size_s)).cast("bigint"))
    last = F.floor(t / F.lit(slide_s)).cast("bigint")
    first = (F.floor((t - F.lit(size_s)) / F.lit(slide_s)) + 1).cast("bigint")
    return events.withColumn(out, F.explode(F.sequence(first, last)))


def window_panes(events: DataFrame, size_s: int = 21_600, slide_s: int | None = None, *, keys: Sequence[str] = (),
                 unix_ts: str = "unix_ts", flag: str | None = "is_anomaly", line: str = LINE) -> DataFrame:
    """pane, keys, events, anomalous, first_line: one row per pane and key, merged before the shuffle.

    A pane is the longest stretch that every window holds whole or not at all, the greatest common
    divisor of size and slide. Events are counted once, however many windows cover them."""
    step = math.gcd(size_s, size_s if slide_s is None else slide_s)
    pane = F.floor(F.floor(F.col(unix_ts)).cast("bigint") / F.lit(step)).cast("bigint")
    bad = F.count_if(F.col(flag).cast("boolean")) if flag else F.lit(0).cast("bigint")
    return events.where(F.col(unix_ts).isNotNull()).groupBy(pane.alias("pane"), *keys).agg(
        F.count(F.lit(1)).alias("events"), bad.alias("anomalous"), F.min(line).alias("first_line"))


def window_totals(events: DataFrame, size_s: int = 21_600, slide_s: int | None = None, *, keys: Sequence[str] = (),
                  out: str = "window_id", **names) -> DataFrame:
    """out, keys, events, anomalous, label, first_line per (sliding) window and key, from panes.

    Same windows as `sessions_by_window`, but only the panes are repeated for the windows that hold
    them, never the events; `label` is 1 where a window holds a flagged event."""
    slide = size_s if slide_s is None else slide_s
    step = math.gcd(size_s, slide)
    panes = window_panes(events, size_s, slide_s, keys=keys, **names)
    start = F.col("pane") * F.lit(step)
    last = F.floor(start / F.lit(slide)).cast("bigint")
    first = (F.floor((start - F.lit(size_s)) / F.lit(slide)) + 1).cast("bigint")
    # Slides longer than the size leave gaps; a pane in a gap is in no window.
    held = panes.where(first <= last).withColumn(out, F.explode(F.sequence(first, last)))
    return held.groupBy(out, *keys).agg(
        F.sum("events").alias("events"), F.sum("anomalous").alias("anomalous"),
        (F.sum("anomalous") > 0).cast("int").alias("label"), F.min("first_line").alias("first_line"))


def sort_events(events: DataFrame, session: str = SESSION, ts: str = TS, line: str = LINE) -> DataFrame:
    """Total order: session, time, then file order for equal times."""
    return events.orderBy(*nulls_last([session, ts, line]))


def with_sequence(
    events: DataFrame, *, session: str = SESSION, ts: str = TS, line: str = LINE,
    cluster: str = CLUSTER, rows_per_task: int = ROWS_PER_TASK, hot: HotKeys | None = None,
    hot_rows: int = 0,
) -> DataFrame:
    """Position, session length, next cluster and delta of each event, in one pass.

    Adds `pos`, `n`, `norm_pos`, `next_cluster_id`, `next_ts` and `delta_us`
    (microseconds to the next event, null when either time is missing). `hot_rows`
    says that all rows belong to hot sessions, and how many they are.
    """
    lead = [cluster, ts]
    if hot_rows:
        rows = sliced(events, [session], [ts, line], hot_rows, lead=lead, rows_per_task=rows_per_task)
    else:
        rows = ordered(events, [session], [ts, line], lead=lead, rows_per_task=rows_per_task, hot=hot)
    delta = micros(F.col(f"next_{ts}")) - micros(F.col(ts))
    if not events.schema[ts].dataType.typeName().startswith("timestamp"):
        delta = F.round((F.col(f"next_{ts}") - F.col(ts)).cast("double") * 1e6).cast("bigint")
    return rows.select(
        "*",
        (F.col("pos") / F.greatest(F.col("n") - 1, F.lit(1))).alias("norm_pos"),
        delta.alias("delta_us"),
    )


def with_position(events: DataFrame, *, session: str = SESSION, ts: str = TS, line: str = LINE,
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    rows = ordered(events, [session], [ts, line], rows_per_task=rows_per_task)
    return rows.withColumn("norm_pos", F.col("pos") / F.greatest(F.col("n") - 1, F.lit(1)))


def with_next(events: DataFrame, **names) -> DataFrame:
    """Consecutive pairs: source, destination and the seconds between them."""
    rows = with_sequence(events, **names)
    return rows.where(F.col("pos") < F.col("n") - 1).withColumn(
        "delta_s", F.col("delta_us") / F.lit(1e6)
    )


def first_seen_index(events: DataFrame, *, session: str = SESSION, cluster: str = CLUSTER,
                     ts: str = TS, line: str = LINE) -> DataFrame:
    """Local node index by first appearance. The clusters of a session are merged
    before the window, so its partitions are no larger than the template catalog."""
    first = events.groupBy(session, cluster).agg(F.min(first_by([ts, line])).alias("first_seen"))
    rank = F.row_number().over(Window.partitionBy(session).orderBy("first_seen"))
    return first.select(session, cluster, (rank - 1).cast("bigint").alias("node_idx"))


def fire_number(events: DataFrame, *, session: str = SESSION, cluster: str = CLUSTER,
                ts: str = TS, line: str = LINE, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    rows = ordered(events, [session, cluster], [ts, line], rows_per_task=rows_per_task)
    return rows.withColumn("fire_no", F.col("pos") + 1).drop("pos", "n")


def session_arrays(
    events: DataFrame, *, session: str = SESSION, ts: str = TS, line: str = LINE,
    cols: Sequence[str] = (CLUSTER, TS), rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Packed ordered arrays, one row per session whatever its length.

    A packed session is one row by definition; one whose arrays exceed the row limit of Spark
    (2 GB) fails the job and is never cut. Use `with_position` where sessions can be that long.
    """
    rows = with_position(events, session=session, ts=ts, line=line, rows_per_task=rows_per_task)
    packed = rows.groupBy(session).agg(
        F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("__a"),
        F.first("n").alias("n"),
    )
    return packed.select(session, "n", *[F.col(f"__a.{c}").alias(c) for c in cols])


def session_fingerprint(
    events: DataFrame, *, session: str = SESSION, ts: str = TS, line: str = LINE,
    cluster: str = CLUSTER, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """md5 of the ordered cluster ids joined by '|', the same for sessions of every length."""
    arrays = session_arrays(events, session=session, ts=ts, line=line, cols=[cluster], rows_per_task=rows_per_task)
    digest = F.md5(F.array_join(F.transform(F.col(cluster), lambda c: c.cast("string")), "|"))
    return arrays.select(session, "n", F.slice(cluster, 1, 8).alias("head"), digest.alias("fingerprint"))


def top_patterns(fingerprints: DataFrame, k: int = 10, session: str = SESSION) -> DataFrame:
    """Most frequent sequences with an example session and the first eight ids."""
    totals = fingerprints.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("pattern_count"),
        F.min("n").alias("length"),
        F.min_by(F.struct(session, "head"), session).alias("__e"),
    )
    ids = F.array_join(F.transform(F.col("__e.head"), lambda c: c.cast("string")), ",")
    return totals.select(
        "fingerprint", "pattern_count", "length", F.col(f"__e.{session}").alias("example_session"),
        F.concat(ids, F.when(F.col("length") > 8, F.lit("…")).otherwise(F.lit(""))).alias("preview"),
    ).orderBy(F.desc("pattern_count"), "fingerprint").limit(k)


def pattern_summary(fingerprints: DataFrame) -> DataFrame:
    counts = fingerprints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(
        F.count(F.lit(1)).alias("unique_patterns"),
        F.sum("c").alias("sessions"),
        (100.0 * F.count(F.lit(1)) / F.sum("c")).alias("unique_pct"),
    )


def pattern_coverage(fingerprints: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Cumulative share of sessions covered by the patterns, most frequent first."""
    counts = fingerprints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("pattern_count"))
    counts = counts.withColumn("__neg", -F.col("pattern_count"))
    rows = ordered(counts, [], ["__neg", "fingerprint"], sums=["pattern_count"],
                   rows_per_task=rows_per_task)
    return rows.select(
        (F.col("pos") + 1).alias("pattern_rank"), "fingerprint", "pattern_count",
        (100.0 * F.col("cum_pattern_count") / F.col("tot_pattern_count")).alias("cum_pct"),
    )


def patterns_for_share(coverage: DataFrame, pct: float = 90.0) -> DataFrame:
    return coverage.where(F.col("cum_pct") >= pct).agg(F.min("pattern_rank").alias("n_patterns"))


def session_lengths(events: DataFrame, session: str = SESSION) -> DataFrame:
    return events.groupBy(session).agg(F.count(F.lit(1)).alias("seq_len"))


def length_stats(lengths: DataFrame, cols: Sequence[str], percents: Sequence[float]) -> DataFrame:
    """One row per column: count, mean, sample std, min, exact percentiles `p<k>`, max.

    The columns are lengths, which sum to at most the number of events, so there are
    no more than sqrt(2 * events) distinct ones. Counting each value first leaves a
    group that small for the last task, in one pass for all columns."""
    long = lengths.select(*cols).unpivot([], list(cols), "metric", "v")
    counts = long.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("freq"))
    x, f, n = F.col("v").cast("double"), F.col("freq"), F.col("count")
    stats = counts.where(F.col("v").isNotNull()).groupBy("metric").agg(
        F.sum("freq").alias("count"), F.sum(x * f).alias("__s"), F.sum(x * x * f).alias("__ss"),
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.percentile("v", [p / 100.0 for p in percents], F.col("freq")).alias("q"),
    )
    spread = F.greatest(F.col("__ss") - F.col("__s") * F.col("__s") / n, F.lit(0.0))
    return stats.select(
        "metric", "count", (F.col("__s") / n).alias("mean"),
        F.when(n > 1, F.sqrt(spread / (n - 1))).alias("std"), "min",
        *[F.col("q")[i].alias(f"p{p:g}") for i, p in enumerate(percents)], "max",
    )


def describe_lengths(lengths: DataFrame, col: str = "seq_len") -> DataFrame:
    """count, mean, sample std, min, quartiles, max."""
    return length_stats(lengths, [col], (25, 50, 75)).drop("metric")


def length_percentiles(lengths: DataFrame, percents: Sequence[float] = (50, 75, 90, 95, 99, 100),
                       col: str = "seq_len") -> DataFrame:
    return length_stats(lengths, [col], percents).select(*[f"p{p:g}" for p in percents])


def fit_fraction(lengths: DataFrame, max_len: int, col: str = "seq_len") -> DataFrame:
    return lengths.agg(F.avg((F.col(col) <= max_len).cast("int")).alias("fit_fraction"))


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over [min, max] per group; the maximum falls in the last bin.

    The ranges come from a first, fully pre-aggregated pass; the group count is
    the number of curves in a plot, so joining it back is cheap."""
    by = list(by)
    df = df.where(F.col(col).isNotNull())
    rows = df.select(*by, F.col(col).cast("double").alias("__v"))
    bounds = [F.min("__v").alias("lo"), F.max("__v").alias("hi")]
    if by:
        rows = rows.join(rows.groupBy(*by).agg(*bounds), by)
    else:
        lo, hi = rows.agg(*bounds).first()
        rows = rows.withColumns({"lo": F.lit(lo), "hi": F.lit(hi)})
    width = (F.col("hi") - F.col("lo")) / bins
    raw = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("__v") - F.col("lo")) / width) + 1).otherwise(F.lit(1))
    rows = rows.withColumn("bin", F.least(raw, F.lit(bins)).cast("int"))
    return rows.groupBy(*by, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("cnt")).select(
        *by, "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_lo"), "cnt"
    )


def sample_sessions(lengths: DataFrame, session: str = SESSION, col: str = "seq_len",
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Shortest, middle (k = n // 2 of the sorted list) and longest session."""
    rows = ordered(lengths, [], [col, session], rows_per_task=rows_per_task)
    middle = F.floor(F.col("n") / 2)
    picks = F.filter(
        F.array(
            F.struct(F.lit("shortest").alias("kind"), (F.col("pos") == 0).alias("hit")),
            F.struct(F.lit("median").alias("kind"), (F.col("pos") == middle).alias("hit")),
            F.struct(F.lit("longest").alias("kind"), (F.col("pos") == F.col("n") - 1).alias("hit")),
        ),
        lambda p: p["hit"],
    )
    return rows.select(F.explode(picks.getField("kind")).alias("kind"), session, col)


def session_listing(events: DataFrame, session_id: str, catalog: DataFrame | None = None, *,
                    session: str = SESSION, cluster: str = CLUSTER, preview: int = 80) -> DataFrame:
    """The ordered events of one session, with index and template preview.

    The filter comes first, so only that session is read and ordered."""
    from weftlog.operators.lookups import attach_template

    one = events.where(F.col(session) == session_id)
    if catalog is not None:
        one = attach_template(one.drop("template"), catalog, cluster)
    rows = with_position(one, session=session)
    return rows.withColumn("preview", F.left(F.col("template"), F.lit(preview)))


def anomaly_rate(df: DataFrame, flag: Column | str = "is_anomaly") -> DataFrame:
    f = F.col(flag) if isinstance(flag, str) else flag
    total, bad = F.count(F.lit(1)), F.count_if(f.cast("boolean"))
    return df.agg(
        total.alias("total"), (total - bad).alias("normal"), bad.alias("anomalous"),
        (100.0 * bad / total).alias("anomaly_pct"),
    )


def top_codes(events: DataFrame, k: int = 10, label: str = "label") -> DataFrame:
    counts = events.where(F.col("is_anomaly")).groupBy(label).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), label).limit(k)


def level_distribution(events: DataFrame, level: str = "level") -> DataFrame:
    return events.groupBy(level).agg(F.count(F.lit(1)).alias("cnt"))


def window_label(events: DataFrame, window: str = "window_id") -> DataFrame:
    return events.groupBy(window).agg(F.bool_or("is_anomaly").cast("int").alias("label"))


def cluster_counts(events: DataFrame, session_id: str | None = None, catalog: DataFrame | None = None, *,
                   session: str = SESSION, cluster: str = CLUSTER, preview: int = 80) -> DataFrame:
    """Firings per template with a preview; for one session or for all of them.

    Events are only counted; the texts come from the catalog (by default the
    distinct templates of the events) afterwards."""
    from weftlog.operators.lookups import attach_template

    if catalog is None:
        pairs = events.select(cluster, "template").distinct()
        catalog = pairs.groupBy(cluster).agg(F.min("template").alias("template"))
    rows = events if session_id is None else events.where(F.col(session) == session_id)
    counts = rows.groupBy(session, cluster).agg(F.count(F.lit(1)).alias("firings"))
    named = attach_template(counts, catalog, cluster)
    return named.select(session, cluster, "firings", F.left(F.col("template"), F.lit(preview)).alias("preview"))


def collapse_accounting(events: DataFrame, session: str = SESSION, cluster: str = CLUSTER) -> DataFrame:
    """Lines, clusters, repeated clusters and the lines that collapse into them."""
    per = events.groupBy(session, cluster).agg(F.count(F.lit(1)).alias("occ"))
    return per.groupBy(session).agg(
        F.sum("occ").alias("lines"), F.count(F.lit(1)).alias("unique_clusters"),
        F.count_if(F.col("occ") > 1).alias("repeated_clusters"),
        F.sum(F.col("occ") - 1).alias("extra_lines"),
        (F.sum("occ") - F.sum(F.col("occ") - 1)).alias("nodes"),
    )
