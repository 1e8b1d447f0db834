"""The given tables seen as log data, once for Spark and once as SQL text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Event types of the given tables and the template each one plays.
TYPES = ["click", "error", "purchase", "signup", "view"]
TEMPLATES = {
    "click": "INFO app.click: user clicked <*> k <*>",
    "error": "ERROR app.error: request raised <*> k <*>",
    "purchase": "INFO app.purchase: order paid <*> k <*>",
    "signup": "INFO app.signup: account opened <*> k <*>",
    "view": "INFO app.view: page shown <*> k <*>",
}
LEVELS = {"click": "INFO", "error": "ERROR", "purchase": "INFO", "signup": "WARN", "view": "INFO"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rendered lines come from small files; give every core a part, as splits of a raw log would."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _choice(col, pairs):
    out = None
    for key, value in pairs.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out


def _case(col, pairs):
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in pairs.items()) + " END"


IDS = {t: i + 1 for i, t in enumerate(TYPES)}


def v_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    seconds = F.floor(F.unix_micros(ts) / F.lit(1_000_000))
    return e.select(
        F.concat(F.lit("blk_"), F.col("user_id")).alias("session_id"),
        F.col("event_id").alias("line_no"), ts.alias("ts"),
        _choice(F.col("event_type"), IDS).alias("cluster_id"),
        _choice(F.col("event_type"), TEMPLATES).alias("template"),
        F.array(F.col("value").cast("string"), F.get_json_object("props", "$.k")).alias("parameters"),
        F.col("user_id"), F.col("event_type"), F.col("value"),
        _choice(F.col("event_type"), LEVELS).alias("level"),
        F.concat(F.lit("R"), F.col("user_id") % 10).alias("node_id"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("APP"), F.upper(F.left(F.col("event_type"), F.lit(3))), F.col("user_id") % 23))
        .otherwise(F.lit("-")).alias("label"),
        ((F.col("event_type") == "error") & (F.col("value") > 300)).alias("is_anomaly"),
        seconds.alias("unix_ts"), F.floor(seconds / F.lit(21_600)).alias("window_id"),
    )


def v_mild_events(spark: SparkSession, sf: str) -> DataFrame:
    """All events; errors of a small value are retries, a template of its own that is no error."""
    mild = (F.col("cluster_id") == 2) & (F.col("value") <= 200)
    return v_events(spark, sf).withColumns({
        "cluster_id": F.when(mild, F.lit(12)).otherwise(F.col("cluster_id")),
        "template": F.when(mild, F.lit("INFO app.retry: request sent again <*> k <*>")).otherwise(F.col("template"))})


def v_events_tied(spark: SparkSession, sf: str) -> DataFrame:
    return v_events(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))


def v_windows(spark: SparkSession, sf: str) -> DataFrame:
    return v_events(spark, sf).withColumn("session_id", F.col("window_id"))


def v_items(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as events of short sessions. Equal order keys are told apart by price and quantity."""
    li = table(spark, sf, "lineitem")
    kinds = {"AF": 1, "AO": 2, "NF": 3, "NO": 4, "RF": 5, "RO": 6}
    code = F.concat("l_returnflag", "l_linestatus")
    line = (F.col("l_linenumber").cast("bigint") * 100_000_000 + F.col("l_partkey")) * 1_000_000 + F.col("l_suppkey")
    line = line * 100 + F.col("l_quantity").cast("bigint")
    return li.select(
        F.col("l_orderkey").alias("session_id"), line.alias("line_no"),
        F.col("l_shipdate").cast("timestamp").alias("ts"), _choice(code, kinds).alias("cluster_id"),
        F.array(F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string")).alias("parameters"),
        F.col("l_quantity"), F.col("l_extendedprice"),
    )


def v_raw_hdfs(spark: SparkSession, sf: str) -> DataFrame:
    e = spread(v_events(spark, sf))
    head = F.date_format("ts", "ddMMyy HHmmss")
    block = F.when(F.col("line_no") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("for "), F.col("session_id"), F.lit(" ")))
    value = F.concat(
        head, F.lit(" "), F.col("user_id"), F.lit(" "), F.col("level"), F.lit(" app."), F.col("event_type"),
        F.lit(": event "), F.col("line_no"), F.lit(" "), block, F.lit("from /10.0."),
        F.col("user_id") % 250, F.lit("."), F.col("line_no") % 250, F.lit(":"),
        F.lit(1024) + F.col("line_no") % 5000, F.lit(" value "), F.col("value").cast("string"),
    )
    return e.select("line_no", value.alias("value"))


def v_raw_bgl(spark: SparkSession, sf: str) -> DataFrame:
    e = spread(v_events(spark, sf))
    value = F.concat_ws(
        " ", "label", F.col("unix_ts").cast("string"), F.date_format("ts", "yyyy.MM.dd"), "node_id",
        F.date_format("ts", "yyyy-MM-dd-HH.mm.ss"), "node_id", F.lit("RAS"),
        F.upper(F.col("event_type")), "level",
        F.concat(F.lit("event "), F.col("line_no"), F.lit(" value "), F.col("value").cast("string")),
    )
    return e.select("line_no", value.alias("value"))


def v_doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def v_labels(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as sessions; those without a label row count as normal."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.select("doc_id", "n_chars", "source").join(lab.select("doc_id", "toxic"), "doc_id", "left").select(
        F.col("doc_id").alias("session_id"), F.coalesce("toxic", F.lit(0)).alias("label"),
        F.col("toxic").isNull().alias("label_defaulted"), "n_chars", "source",
    )


def v_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with deterministic component scores, ties included."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    k = F.col("doc_id")
    return d.select("doc_id", "n_chars").join(lab.select("doc_id", "toxic"), "doc_id").select(
        k.alias("session_id"), F.col("toxic").alias("label"),
        ((k * 37 % 101) / F.lit(101.0) * (F.lit(1.0) + F.col("toxic") * 0.25)).alias("structure"),
        (F.floor(F.col("n_chars") / F.lit(40)) % 100 / F.lit(100.0)).alias("node"),
        ((k * 53 % 97) / F.lit(97.0) * (F.lit(1.0) + F.col("toxic") * 0.5)).alias("edge"),
        F.round((k * 37 % 101 + k * 53 % 97 + F.col("toxic") * 60) / F.lit(260.0), 2).alias("score"),
    )


def v_conv(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    roles = {"assistant": 1, "system": 2, "tool": 3, "user": 4}
    return c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("line_no"), F.col("turn").alias("ts"),
        F.coalesce(_choice(F.col("role"), roles), F.lit(0)).alias("cluster_id"), F.length("text").alias("n_chars"),
    )


def v_split(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed assignment of the labelled sessions to splits, by id."""
    m = F.col("session_id") % 20
    return v_labels(spark, sf).withColumn(
        "split", F.when(m < 14, "train").when(m < 17, "val").otherwise("test")
    )


def v_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as runs of their customer's data set. In the SQL a run also names the one before it."""
    o = table(spark, sf, "orders")
    return o.select(
        F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("run_tag"),
        F.col("o_custkey").alias("dataset"), F.col("o_orderstatus").alias("stage"),
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp").alias("created"),
        F.col("o_totalprice").alias("price"),
    )


SQL = {
    "v_events": f"""
        SELECT 'blk_' || user_id AS session_id, event_id AS line_no, ts,
               {_case('event_type', IDS)} AS cluster_id, {_case('event_type', TEMPLATES)} AS template,
               [CAST(value AS VARCHAR), json_extract_string(props, '$.k')] AS parameters,
               user_id, event_type, value, {_case('event_type', LEVELS)} AS level,
               'R' || (user_id % 10) AS node_id,
               CASE WHEN event_type = 'error' THEN 'APP' || upper(left(event_type, 3)) || (user_id % 23) ELSE '-' END AS label,
               event_type = 'error' AND value > 300 AS is_anomaly,
               CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS unix_ts,
               CAST(floor(epoch_us(ts) / 21600000000) AS BIGINT) AS window_id
        FROM events""",
    "v_events_tied": "SELECT * REPLACE (date_trunc('hour', ts) AS ts) FROM v_events",
    "v_windows": "SELECT * REPLACE (window_id AS session_id) FROM v_events",
    "v_items": f"""
        SELECT l_orderkey AS session_id,
               ((CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey) * 1000000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS line_no,
               l_shipdate AS ts, {_case("l_returnflag || l_linestatus", {"AF": 1, "AO": 2, "NF": 3, "NO": 4, "RF": 5, "RO": 6})} AS cluster_id,
               [CAST(l_quantity AS VARCHAR), CAST(l_extendedprice AS VARCHAR)] AS parameters, l_quantity, l_extendedprice
        FROM lineitem""",
    "v_raw_hdfs": """
        SELECT line_no, strftime(ts, '%d%m%y %H%M%S') || ' ' || user_id || ' ' || level || ' app.' || event_type
               || ': event ' || line_no || ' ' || CASE WHEN line_no % 7 = 0 THEN '' ELSE 'for ' || session_id || ' ' END
               || 'from /10.0.' || (user_id % 250) || '.' || (line_no % 250) || ':' || (1024 + line_no % 5000)
               || ' value ' || CAST(value AS VARCHAR) AS value
        FROM v_events""",
    "v_raw_bgl": """
        SELECT line_no, label || ' ' || unix_ts || ' ' || strftime(ts, '%Y.%m.%d') || ' ' || node_id || ' '
               || strftime(ts, '%Y-%m-%d-%H.%M.%S') || ' ' || node_id || ' RAS ' || upper(event_type) || ' ' || level
               || ' event ' || line_no || ' value ' || CAST(value AS VARCHAR) AS value
        FROM v_events""",
    "v_doc_lines": """
        SELECT doc_id, source, lang, i - 1 AS line_no, parts[i] AS line
        FROM (SELECT doc_id, source, lang, parts, unnest(range(1, len(parts) + 1)) AS i
              FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS parts FROM documents))""",
    "v_labels": """
        SELECT d.doc_id AS session_id, coalesce(l.toxic, 0) AS label, l.toxic IS NULL AS label_defaulted, n_chars, source
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_scores": """
        SELECT d.doc_id AS session_id, l.toxic AS label,
               (d.doc_id * 37 % 101) / 101.0::DOUBLE * (1.0::DOUBLE + l.toxic * 0.25::DOUBLE) AS structure,
               floor(n_chars / 40)::BIGINT % 100 / 100.0::DOUBLE AS node,
               (d.doc_id * 53 % 97) / 97.0::DOUBLE * (1.0::DOUBLE + l.toxic * 0.5::DOUBLE) AS edge,
               round((d.doc_id * 37 % 101 + d.doc_id * 53 % 97 + l.toxic * 60) / 260.0::DOUBLE, 2) AS score
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "v_conv": f"""
        SELECT conv_id AS session_id, turn AS line_no, turn AS ts,
               coalesce({_case('role', {"assistant": 1, "system": 2, "tool": 3, "user": 4})}, 0) AS cluster_id, length(text) AS n_chars
        FROM conversations""",
    "v_split": """
        SELECT *, CASE WHEN session_id % 20 < 14 THEN 'train' WHEN session_id % 20 < 17 THEN 'val' ELSE 'test' END AS split
        FROM v_labels""",
    "v_runs": """
        SELECT strftime(o_orderdate, '%Y%m%d') || '_' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS run_tag,
               o_custkey AS dataset, o_orderstatus AS stage, o_orderkey AS run_id, o_orderdate AS created,
               lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, o_totalprice AS price
        FROM orders""",
}
NEEDS = {
    "v_events_tied": ["v_events"], "v_windows": ["v_events"], "v_raw_hdfs": ["v_events"],
    "v_raw_bgl": ["v_events"], "v_split": ["v_labels"],
}


def with_views(names: Sequence[str], body: str) -> str:
    """Prefix `body` with the CTEs of the named views and of what they read."""
    need: list[str] = []

    def add(name):
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in need:
            need.append(name)

    for n in names:
        add(n)
    if not need:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in need)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
