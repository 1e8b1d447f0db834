"""Template mining, matching against a frozen catalog, validation and enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlog.functions.columns import (
    PLACEHOLDER, WILDCARD, coerce_json, extract_block_id, extract_parameters, mask_tokens,
)
from weftlog.operators.skew import join_weighed, ordered
from weftlog.session import durable

# A catalog up to this size is sent to every executor; a larger one is joined by shuffle.
SMALL_CATALOG_ROWS = 20_000
SMALL_CATALOG_CHARS = 16_000_000
# Most of the candidates of a shuffled match that one join key may hold: one in this many.
MATCH_SHARES = 1_000

_ANNOTATED = ["cluster_id", "template", "parameters"]


def tokens(col: Column | str) -> Column:
    return F.split(F.trim(col), r"\s+")


def _distinct_content(lines: DataFrame, content: str, line: str) -> DataFrame:
    """Masked texts with count and first line: repeated lines are merged before any shuffle."""
    masked = lines.select(mask_tokens(content).alias("masked"), F.col(line).alias("__line"))
    return masked.groupBy("masked").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("__line").alias("first_line")
    )


# --- mining -----------------------------------------------------------------


def mine_templates_positional(lines: DataFrame, *, content: str = "content", line: str = "line_no",
                              lead_tokens: int = 2) -> DataFrame:
    """Templates by position: inside a bucket of equal token count and equal leading
    tokens, every position that holds more than one token becomes a wildcard."""
    texts = durable(_distinct_content(lines, content, line)).withColumn("t", tokens("masked"))
    texts = texts.select(
        F.size("t").alias("n_tokens"), F.array_join(F.slice("t", 1, lead_tokens), " ").alias("lead"),
        "t", "cnt", "first_line",
    )
    bucket = ["n_tokens", "lead"]
    totals = texts.groupBy(*bucket).agg(F.sum("cnt").alias("count"), F.min("first_line").alias("first_line"))
    # The earliest text stands for its bucket; a position where any other text
    # differs from it is variable. Only differing positions are exploded.
    rep = texts.select(*bucket, "first_line", F.col("t").alias("rep")).join(totals, [*bucket, "first_line"])
    differs = F.filter(
        F.zip_with("t", F.transform("rep", lambda w, i: F.struct(i.alias("i"), w.alias("w"))),
                   lambda w, r: F.when(w != r["w"], r["i"])),
        lambda i: i.isNotNull(),
    )
    spots = texts.join(rep.select(*bucket, "rep"), bucket).select(*bucket, F.explode(differs).alias("i")).distinct()
    wide = spots.groupBy(*bucket).agg(F.collect_set("i").alias("wide"))
    word = F.transform("rep", lambda w, i: F.when(F.array_contains(F.coalesce("wide", F.array().cast("array<int>")), i), F.lit(WILDCARD)).otherwise(w))
    found = rep.join(wide, bucket, "left").select(F.array_join(word, " ").alias("template"), "count", "first_line")
    return number_templates(found)


def number_templates(found: DataFrame) -> DataFrame:
    """Ids from 1 in the order of the first line, so that they do not depend on partitioning."""
    rows = ordered(found, [], ["first_line", "template"])
    return rows.select((F.col("pos") + 1).cast("int").alias("cluster_id"), "template", "count", "first_line")


def mine_templates(lines: DataFrame, sim_th: float = 0.4, depth: int = 4, *,
                   content: str = "content", line: str = "line_no") -> DataFrame:
    """Learn templates from masked text: a group of lines that agree in enough positions is one
    template, and the positions in which they differ become wildcards.

    A bucket holds the texts of one token count and equal leading tokens. A group is a template
    if the share of positions in which all its texts have the same literal reaches `sim_th`, or if
    no position differs. Any other group is split by the token at its position of fewest
    distinct tokens (one without wildcards first, then the leftmost), and the parts are
    looked at again, so a round fixes one position.

    The rule sees sets of texts only: smallest, largest and distinct tokens per position, which
    merge in any order. The result depends neither on the order of the lines nor on how a
    bucket is spread over tasks; nothing reads a bucket in one task. Lines without text give no
    template.
    """
    texts = _distinct_content(lines, content, line)
    # Tokens with digits are treated as variable when they lead, as is usual for logs.
    lead = F.transform(F.slice("t", 1, max(depth - 2, 1)),
                       lambda w: F.when(w.rlike(r"\d"), F.lit(WILDCARD)).otherwise(w))
    rows = durable(texts.select(tokens("masked").alias("t"), "cnt", "first_line").select(
        F.concat_ws(" ", F.size("t").cast("string"), lead).alias("group"), "t", "cnt", "first_line"))
    found: list[DataFrame] = []
    while True:
        shapes = durable(_group_shapes(rows))
        same = F.size(F.filter("cells", lambda c: c["w"] != WILDCARD)) / F.size("cells")
        open_ = (same < sim_th) & F.exists("cells", lambda c: c["w"].isNull())
        found.append(shapes.where(~open_).select(
            F.array_join(F.transform("cells", lambda c: F.coalesce(c["w"], F.lit(WILDCARD))), " ").alias("template"), "cnt", "first_line"))
        undecided = shapes.where(open_).select("group", "cells", "texts")
        total = undecided.agg(F.sum("texts")).first()[0]
        if total is None:
            break
        rows = durable(_split_groups(rows, undecided, total))
    merged = reduce(DataFrame.unionByName, found).groupBy("template").agg(
        F.sum("cnt").alias("count"), F.min("first_line").alias("first_line"))
    return number_templates(merged)


def _group_shapes(rows: DataFrame) -> DataFrame:
    """Per group: number of texts, lines, first line, and per position its only token (null where
    tokens differ) and whether a wildcard is among them."""
    cells = rows.select("group", "cnt", "first_line", F.posexplode("t").alias("i", "w"))
    spots = cells.groupBy("group", "i").agg(
        F.min("w").alias("lo"), F.max("w").alias("hi"), F.bool_or(F.col("w") == WILDCARD).alias("wild"),
        F.count(F.lit(1)).alias("texts"), F.sum("cnt").alias("cnt"), F.min("first_line").alias("first_line"))
    cell = F.struct("i", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("w"), "wild")
    return spots.groupBy("group").agg(
        F.array_sort(F.collect_list(cell)).alias("cells"), F.first("texts").alias("texts"),
        F.first("cnt").alias("cnt"), F.first("first_line").alias("first_line"))


def _split_groups(rows: DataFrame, undecided: DataFrame, total: int) -> DataFrame:
    """The texts of undecided groups, each in the part of its token at the group's splitting position."""
    part = join_weighed(rows, undecided.withColumn("size", F.col("texts")), ["group"], "texts", total)
    varied = F.transform(F.filter("cells", lambda c: c["w"].isNull()), lambda c: F.struct(
        c["i"].alias("i"), c["wild"].alias("wild"), F.get("t", c["i"]).alias("w")))
    seen = part.select("group", "size", F.explode(varied).alias("c")).select("group", "size", "c.*").distinct()
    spread = seen.groupBy("group", "size", "i", "wild").agg(F.count(F.lit(1)).alias("k"))
    at = spread.groupBy("group", "size").agg(F.min(F.struct("wild", "k", "i"))["i"].alias("at"))
    placed = join_weighed(part.drop("cells", "size"), at, ["group"], "size", total)
    group = F.concat("group", F.lit(" "), F.col("at").cast("string"), F.lit("="), F.get("t", F.col("at")))
    return placed.select(group.alias("group"), "t", "cnt", "first_line")


# --- matching ---------------------------------------------------------------


def _fits(words: Column, cand: Column) -> Column:
    """Only the literal tokens of the candidate are looked at."""
    return F.forall(cand["literals"], lambda t: F.get(words, t["i"]) == t["w"])


def _holes(shape: Column) -> Column:
    """Position and fixed text lengths around the placeholder of each template token that has one."""
    marked = F.transform(shape, lambda t, i: F.struct(
        i.alias("i"), t.rlike(PLACEHOLDER).alias("hole"),
        F.length(F.regexp_extract(t, r"^(.*?)<[A-Z*]+>", 1)).alias("before"),
        F.length(F.regexp_extract(t, r"^.*<[A-Z*]+>(.*)$", 1)).alias("after"),
    ))
    return F.filter(marked, lambda m: m["hole"])


def _keyed_catalog(catalog: DataFrame) -> DataFrame:
    shape = tokens("template")
    second = F.when(F.size("shape") > 1, F.col("shape")[1]).otherwise(F.lit(""))
    return catalog.select("cluster_id", "template", shape.alias("shape")).select(
        F.size("shape").alias("k_n"), F.col("shape")[0].alias("k_1"), second.alias("k_2"),
        "cluster_id", "template", _holes(F.col("shape")).alias("holes"),
        F.filter(F.transform("shape", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda t: t["w"] != WILDCARD).alias("literals"),
    ).select(
        "k_n", "k_1", "k_2",
        F.struct((-F.size("literals")).alias("rank"), "cluster_id", "template", "holes", "literals").alias("cand"),
    )


def catalog_is_small(catalog: DataFrame) -> bool:
    rows, chars = catalog.agg(F.count(F.lit(1)), F.sum(F.length("template"))).first()
    return rows <= SMALL_CATALOG_ROWS and (chars or 0) <= SMALL_CATALOG_CHARS


def match_templates(lines: DataFrame, catalog: DataFrame, *, content: str = "content",
                    small: bool | None = None) -> DataFrame:
    """Add `cluster_id` and `template` of the best fitting template, null when none fits.

    Best means most literal tokens, then the lowest id. Candidates share the token
    count and the first two tokens (or a wildcard there). A small catalog, checked
    by rows and bytes, is broadcast and lines never move. For a large one the
    distinct masked texts are matched through an index of rare literals and joined back.
    """
    return _matched(lines, catalog, content, small).drop("__holes")


def _matched(lines: DataFrame, catalog: DataFrame, content: str, small: bool | None = None) -> DataFrame:
    # The frozen catalog is stored once; it is checked and read several times below.
    catalog = durable(catalog.select("cluster_id", "template"))
    if small is None:
        small = catalog_is_small(catalog)
    if small:
        return _match_in_place(lines, catalog, content)
    return _match_by_shuffle(lines, catalog, content)


def _match_in_place(lines: DataFrame, catalog: DataFrame, content: str) -> DataFrame:
    # Bounded by catalog_is_small, hence the explicit broadcasts.
    packed = _keyed_catalog(catalog).groupBy("k_n", "k_1", "k_2").agg(F.collect_list("cand").alias("cands"))
    rows = lines.withColumn("__w", tokens(mask_tokens(content)))
    rows = rows.withColumns({
        "__n": F.size("__w"), "__1": F.col("__w")[0],
        "__2": F.when(F.size("__w") > 1, F.col("__w")[1]).otherwise(F.lit("")),
    })
    wild = F.lit(WILDCARD)
    found = []
    for i, (one, two) in enumerate([("__1", "__2"), ("__1", None), (None, "__2"), (None, None)]):
        side = packed.select(F.col("k_n").alias(f"n{i}"), F.col("k_1").alias(f"a{i}"),
                             F.col("k_2").alias(f"b{i}"), F.col("cands").alias(f"c{i}"))
        on = (
            (F.col("__n") == F.col(f"n{i}"))
            & (F.col(f"a{i}") == (F.col(one) if one else wild))
            & (F.col(f"b{i}") == (F.col(two) if two else wild))
        )
        rows = rows.join(F.broadcast(side), on, "left")
        fits = F.filter(f"c{i}", lambda c: _fits(F.col("__w"), c))
        found.append(F.array_min(fits))
    rows = rows.withColumn("__b", F.least(*found))
    keep = [c for c in lines.columns if c not in ("cluster_id", "template")]
    return rows.select(*keep, F.col("__b.cluster_id").alias("cluster_id"), F.col("__b.template").alias("template"),
                       F.col("__b.holes").alias("__holes"))


def literal_index(catalog: DataFrame) -> DataFrame:
    """n, i, w, cand: every template with a literal under its rarest one, that is the
    (token count, position, literal) fewest templates have; ties go to the leftmost."""
    keyed = _keyed_catalog(catalog).select(F.col("k_n").alias("n"), "cand")
    name = F.struct("cand.cluster_id", "cand.template")
    spots = keyed.select("n", name.alias("name"), F.explode("cand.literals").alias("l")).select("n", "name", "l.*")
    common = spots.groupBy("n", "i", "w").agg(F.count(F.lit(1)).alias("templates"))
    total = common.agg(F.coalesce(F.sum("templates"), F.lit(0))).first()[0]
    rated = join_weighed(spots, common.withColumn("rate", F.col("templates")), ["n", "i", "w"], "templates", total)
    rarest = rated.groupBy("name").agg(F.min(F.struct("rate", "i", "w")).alias("r"))
    return keyed.withColumn("name", name).join(rarest.select("name", "r.i", "r.w"), "name").select("n", "i", "w", "cand")


def _candidates(texts: DataFrame, index: DataFrame) -> DataFrame:
    """text_id, cand: the templates whose rarest literal stands in the text.

    A key holds as many candidates as it has texts times templates. One that holds more than its
    share is salted into as many parts as it takes, so no join key has more than one
    in `MATCH_SHARES` of all candidates (and of all probes); tokens that many texts but no
    template has are dropped before the shuffle."""
    keys = ["n", "i", "w"]
    probes = texts.select("text_id", "n", F.posexplode("words").alias("i", "w"))
    per_key = durable(
        probes.groupBy(*keys).agg(F.count(F.lit(1)).alias("probes"))
        .join(index.groupBy(*keys).agg(F.count(F.lit(1)).alias("templates")), keys, "left")
        .withColumn("made", F.col("probes") * F.coalesce("templates", F.lit(0))))
    all_probes, made = per_key.agg(F.coalesce(F.sum("probes"), F.lit(0)), F.coalesce(F.sum("made"), F.lit(0))).first()
    parts = F.greatest(F.ceil(F.col("probes") * MATCH_SHARES / max(all_probes, 1)), F.ceil(F.col("made") * MATCH_SHARES / max(made, 1)))
    # Fewer than 2 * MATCH_SHARES keys can be above their share of one or the other.
    hot = per_key.where(parts > 1).select(*keys, F.when(F.col("made") > 0, parts.cast("int")).otherwise(F.lit(0)).alias("parts"))
    met = probes.join(F.broadcast(hot), keys, "left")
    plain = met.where(F.col("parts").isNull()).drop("parts").join(index, keys).select("text_id", "cand")
    spread = index.join(F.broadcast(hot), keys).where("parts > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    salted = met.where("parts > 0").withColumn("salt", F.pmod("text_id", "parts").cast("int")).drop("parts")
    return plain.unionByName(salted.join(spread, [*keys, "salt"]).select("text_id", "cand"))


def _match_by_shuffle(lines: DataFrame, catalog: DataFrame, content: str) -> DataFrame:
    """Distinct masked texts meet the templates whose rarest literal they hold, and are compared with
    those only. Templates without literals differ in nothing that matters, so the lowest id of
    each token count stands for them."""
    masked = lines.drop("cluster_id", "template").withColumn("__m", mask_tokens(content))
    texts = durable(masked.groupBy("__m").agg(F.count(F.lit(1)).alias("lines")).where(F.col("__m").isNotNull()).select(
        "__m", "lines", F.xxhash64("__m").alias("text_id"), tokens("__m").alias("words")).withColumn("n", F.size("words")))
    cands = _candidates(texts, durable(literal_index(catalog)))
    # Equal ids of different texts only bring more candidates, all of which are compared.
    fits = texts.join(cands, "text_id").where(_fits(F.col("words"), F.col("cand")))
    best = fits.groupBy("__m").agg(F.min("cand").alias("best"))
    blank = _keyed_catalog(catalog).where(F.size("cand.literals") == 0).groupBy(F.col("k_n").alias("n")).agg(F.min("cand").alias("blank"))
    found = texts.select("__m", "n", "lines").join(best, "__m", "left").join(blank, "n", "left").select(
        "__m", "lines", F.coalesce("best", "blank").alias("b"))
    found = found.where(F.col("b").isNotNull()).select(
        "__m", "lines", F.col("b.cluster_id").alias("cluster_id"), F.col("b.template").alias("template"), F.col("b.holes").alias("__holes"))
    total = texts.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    # Stored once: the lines of common and of other texts join it apart.
    return join_weighed(masked, durable(found), ["__m"], "lines", total, "left").drop("__m")


def annotate(lines: DataFrame, catalog: DataFrame, *, content: str = "content", raw: str = "raw") -> DataFrame:
    """Second pass over the log against the frozen catalog: template, parameters and session key."""
    matched = _matched(lines, catalog, content)
    # What `extract_parameters` works out per line is known per template here.
    matched = matched.withColumn("__words", tokens(content))
    words = F.col("__words")
    values = F.transform("__holes", lambda h: F.substring(
        words[h["i"]], h["before"] + 1, F.length(words[h["i"]]) - h["before"] - h["after"]))
    return matched.withColumns({"parameters": values, "block_id": extract_block_id(raw)}).drop("__holes", "__words")


def unmatched_lines(lines: DataFrame, catalog: DataFrame, *, content: str = "content") -> DataFrame:
    return match_templates(lines, catalog, content=content).where(F.col("cluster_id").isNull())


def match_counts(matched: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("cluster_id").isNotNull())
    return matched.agg(F.count(F.lit(1)).alias("total"), hit.alias("matched"),
                       (F.count(F.lit(1)) - hit).alias("unmatched"))


def scan_raw(lines: DataFrame, needle: str, cap: int, *, raw: str = "raw", line: str = "line_no") -> DataFrame:
    """Raw lines holding an id, counted inside and beyond the line cap."""
    hits = lines.where(F.contains(F.col(raw), F.lit(needle)))
    return hits.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(line) <= cap).alias("inside"),
                    F.count_if(F.col(line) > cap).alias("beyond"))


def block_coverage(lines: DataFrame, catalog: DataFrame, needle: str, *, raw: str = "raw",
                   content: str = "content") -> DataFrame:
    return match_counts(match_templates(lines.where(F.contains(F.col(raw), F.lit(needle))), catalog, content=content))


# --- catalog ----------------------------------------------------------------


def distinct_templates(annotated: DataFrame) -> DataFrame:
    return annotated.select("cluster_id", "template").distinct()


def template_catalog(annotated: DataFrame, k: int = 3, *, content: str = "content", line: str = "line_no") -> DataFrame:
    """Count and up to `k` example lines per template.

    The row-number filter lets Spark keep only k rows per template on the map side."""
    from pyspark.sql import Window

    rows = annotated.where(F.col("cluster_id").isNotNull())
    counts = rows.groupBy("cluster_id", "template").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(line))
    firsts = rows.select("cluster_id", line, content).withColumn("__r", rank).where(F.col("__r") <= k)
    examples = firsts.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("__r", F.col(content).alias("c"))))["c"].alias("examples")
    )
    return counts.join(examples, "cluster_id")


def validate_templates(catalog: DataFrame, matched: DataFrame) -> DataFrame:
    """Coverage, singletons, overly generic (over 70 % wildcards) and overly specific templates."""
    shape = tokens("template")
    holes = F.size(F.filter(shape, lambda t: t.rlike(PLACEHOLDER)))
    per = catalog.select("count", holes.alias("holes"), F.size(shape).alias("size"))
    stats = per.agg(
        F.count(F.lit(1)).alias("templates"),
        F.avg((F.col("count") == 1).cast("int")).alias("singleton_fraction"),
        F.count_if(F.col("holes") / F.col("size") > 0.7).alias("too_generic"),
        F.count_if((F.col("count") == 1) & (F.col("holes") == 0)).alias("too_specific"),
    )
    coverage = matched.agg(F.avg(F.col("cluster_id").isNotNull().cast("int"))).first()[0]
    return stats.withColumn("coverage", F.lit(coverage))


# --- enrichment -------------------------------------------------------------

# The record layout of an enriched template and the context per data set.
ENRICHED_SCHEMA = (
    "component string, component_role string, log_level string, purpose string, "
    "fields array<map<string,string>>, expected_sequence array<string>, "
    "failure_modes array<map<string,string>>, anomaly_indicators array<string>, "
    "related_templates array<string>, embedding_text string"
)
REQUIRED_FIELDS = [
    "component", "component_role", "log_level", "purpose", "fields",
    "expected_sequence", "failure_modes", "anomaly_indicators", "related_templates",
]


def template_context(catalog: DataFrame, dataset: str, contexts: dict[str, str]) -> DataFrame:
    """Record sent to the enricher; missing relation and document lists become empty."""
    empty = F.array().cast("array<string>")
    have = set(catalog.columns)
    pairs = reduce(lambda a, b: a + b, [[F.lit(k), F.lit(v)] for k, v in contexts.items()])
    lists = {
        c: F.coalesce(F.col(c), empty) if c in have else empty
        for c in ("candidate_relations", "retrieved_docs")
    }
    return catalog.withColumns({**lists, "context": F.create_map(*pairs)[F.lit(dataset)]})


def enrich_templates(catalog: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
                     variant: str = "large", stored: DataFrame | None = None) -> DataFrame:
    """One JSON record per template from a user batch function (`cluster_id, enriched`).

    Templates that already have a stored record are not sent again."""
    todo = catalog if stored is None else catalog.join(stored.select("cluster_id"), "cluster_id", "left_anti")
    fresh = todo.mapInPandas(fn, "cluster_id int, enriched string")
    out = fresh if stored is None else stored.select("cluster_id", "enriched").unionByName(fresh)
    return out.withColumnRenamed("enriched", f"enriched_{variant}")


def validate_enrichment(df: DataFrame, column: str) -> DataFrame:
    """Valid, malformed and incomplete records."""
    rec = coerce_json(column, ENRICHED_SCHEMA)
    rows = df.select(F.col(column).alias("__t"), rec.alias("__r"))
    whole = reduce(lambda a, b: a & b, [F.col(f"__r.{f}").isNotNull() for f in REQUIRED_FIELDS])
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("__t").isNull()).alias("missing"),
        F.count_if(F.col("__t").isNotNull() & F.col("__r").isNull()).alias("malformed"),
        F.count_if(F.col("__r").isNotNull() & ~whole).alias("incomplete"),
        F.count_if(F.col("__r").isNotNull() & whole).alias("valid"),
    )
