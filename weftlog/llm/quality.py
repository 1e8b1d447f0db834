"""Quality rules by divergence from language references, in DataFrame functions only.

Each language has two reference histograms over the whole corpus: character classes and its
most common words. A document is compared with the references of its language by
Jensen-Shannon distance (base 2, 0 to 1). A reference of n documents is as uncertain as they are
few, so its limits are wider by a share SLACK_DOCS / n; no number of documents switches it on or
off. Every document, also one of null or rare language, is compared with a pooled reference of
the whole corpus, in groups of classes that all scripts share. It is rejected if a distance is
above its limit, unless it is too short for the histogram to say anything. The base rules (word
count, repeated windows) come first.

Documents are read twice and never moved: once to count, once to judge. Only counts move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm.base import store

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Words of a language reference, and the places of the table that they are looked up in.
COMMON_WORDS = 64
SLOTS = 512
# Share by which the limits of a language of n documents are wider: SLACK_DOCS / n.
SLACK_DOCS = 4
# Up to so many languages their references are held in every task; more are joined without that.
MAX_LANGUAGES = 1000
# Guards: shorter documents pass the test of that histogram.
MIN_CHARS_FOR_CLASSES = 100
MIN_WORDS_FOR_COMMON = 80
# Limits of the distances; see the README for how far clean documents lie below them.
MAX_CLASS_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.42
MAX_POOLED_DISTANCE = 0.28

# Character classes in the order they are taken out of the text; what is left is "other".
CLASSES = (
    ("lower", "[a-z]+"), ("space", SPACES), ("accented", r"[\x{00C0}-\x{024F}]+"), ("upper", "[A-Z]+"),
    ("stop", "[.,;:'\"()-]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>!?@=+/\\\\_~^{}\\[\\]]+"),
)

# Classes (by place, the last is "other") that count as one where languages are pooled: letters of
# any script, white space, stops, digits, symbols.
POOLED = ((0, 2, 3, 7), (1,), (4,), (5,), (6,))


def base_measures(docs: DataFrame) -> DataFrame:
    """`row`, doc_id, lang, words and the base columns of every row; null text has no words.

    `row` is what the document was, so that columns of any name pass through.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # `codes` is read twice where `windows` is made, so the optimizer keeps it as a column; put inside
    # the lambda it would be computed again for every window.
    n = F.size("codes")
    keyed = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"))
        .select("*", words.alias("words"), lines.alias("lines"))
        .select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))
        .select("*", n.cast("bigint").alias("n_words"), F.when(n >= WINDOW_WORDS, F.transform(
            F.sequence(F.lit(1), n - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice("codes", i, F.lit(WINDOW_WORDS))))).alias("windows"))
    )
    # Only texts with a repeated window pay for the positions: equal windows are neighbours in the
    # sorted (code, position) list, and the words they cover are the union of spans of 8.
    repeated = F.coalesce(F.size(F.array_distinct("windows")) < F.size("windows"), F.lit(False))
    placed = F.sort_array(F.transform("windows", lambda c, i: F.struct(c.alias("c"), i.alias("i"))))
    marked = F.transform("placed", lambda p, k: F.when(
        (p.c == F.get("placed", k - 1).c) | (p.c == F.get("placed", k + 1).c), p.i))
    at = F.sort_array(F.filter(marked, lambda i: i.isNotNull()))
    covered = F.aggregate(F.transform("at", lambda i, k: F.coalesce(F.least(F.get("at", k + 1) - i, F.lit(WINDOW_WORDS)), F.lit(WINDOW_WORDS))),
                          F.lit(0), lambda a, x: a + x)
    return (
        keyed.withColumn("placed", F.when(repeated, placed))
        .withColumn("at", F.when(F.col("placed").isNotNull(), at))
        .select("row", "doc_id", "lang", "text", "words", "n_words",
                F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
                F.char_length(F.regexp_replace("text", SYMBOLS, "")).cast("bigint").alias("n_symbols"),
                (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
                F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    )


def class_counts(df: DataFrame) -> DataFrame:
    """Add n_chars and `classes`, the code points of each class; every step scans what the last one left."""
    out = df.withColumn("rest0", F.col("text"))
    for k, (_, pattern) in enumerate(CLASSES):
        out = out.withColumn(f"rest{k + 1}", F.regexp_replace(f"rest{k}", pattern, ""))
    size = [F.char_length(f"rest{k}") for k in range(len(CLASSES) + 1)]
    counts = [size[k] - size[k + 1] for k in range(len(CLASSES))] + [size[-1]]
    return out.select(*df.columns, size[0].cast("bigint").alias("n_chars"), F.array(*[c.cast("double") for c in counts]).alias("classes"))


def half_term(p: Column, q: Column) -> Column:
    """One bin of the Jensen-Shannon divergence, with 0 log 0 = 0."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return (part(p) + part(q)) / 2


def slot_of(code: Column | str) -> Column:
    return F.pmod(code, F.lit(SLOTS))


def references(docs: DataFrame, common_words: int = COMMON_WORDS) -> DataFrame:
    """lang, n_docs, q_classes, slot_codes, by_code: one row per language, and one of null `lang`
    with the classes of the whole corpus, documents of null language included.

    Every document with a text counts, including those the base rules reject: a reference describes
    the corpus, and rejected texts are too few to bend it. The most common words (lower case; ties
    take the smaller word) sit in a table of SLOTS places by their hash: `slot_codes` has the hashes
    of each place, `by_code` each hash with the word's share of all words of the language.
    """
    known = docs.where(F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    classes = F.array(*[F.sum(F.col("classes")[k]) for k in range(len(CLASSES) + 1)])
    # A few rows; the pool is their sum.
    counted = store(class_counts(known).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), classes.alias("classes")), "classes")
    pool = counted.agg(F.sum("n_docs").alias("n_docs"), classes.alias("sums"))
    # Words are dealt by themselves, so a language that holds most rows is spread over all tasks.
    words = store(
        known.where(F.col("lang").isNotNull()).select("lang", F.explode(F.split(F.lower("text"), SPACES)).alias("word")).where(F.col("word") != "")
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = words.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= common_words)
    # Two words of one 64-bit hash would be one word here.
    shares = (
        top.join(totals, "lang").groupBy("lang", F.xxhash64("word").alias("code")).agg(F.sum(F.col("n") / F.col("total")).alias("q"))
        .groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("code", "q"))).alias("by_code")))
    own = counted.where(F.col("lang").isNotNull()).withColumnRenamed("classes", "sums").join(shares, "lang", "left")
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(SLOTS - 1).cast("bigint"))
    codes = F.map_keys("by_code")
    all_chars = F.aggregate("sums", F.lit(0.0), lambda a, x: a + x)
    both = own.unionByName(pool.withColumn("lang", F.lit(None).cast("string")), allowMissingColumns=True)
    return both.where(F.col("n_docs") > 0).select(
        "lang", "n_docs", F.transform("sums", lambda x: x / F.greatest(all_chars, F.lit(1.0))).alias("q_classes"),
        F.transform(places, lambda s: F.filter(codes, lambda c: slot_of(c) == s)).alias("slot_codes"), "by_code")


def judge(docs: DataFrame, **how) -> DataFrame:
    """doc_id, the base columns, base_failed, class_distance, word_distance, pooled_distance and kept per row of `docs`.

    A distance is null where its guard holds or, for the language's own references, `lang` is null; a
    null distance rejects nothing. Null text has no words and fails the base rules. Repeated rows are judged alike.
    """
    return _judged(docs, **how).drop("row")


def accepted(docs: DataFrame, **how) -> DataFrame:
    """The documents that `judge` keeps, with all their columns.

    A plain filter would be pushed below the measures and compute them once for every use; rows
    are dropped by a generator, which stays where it is.
    """
    verdict = _judged(docs, **how).select(F.explode_outer(F.when(F.col("kept"), F.array("row"))).alias("row"))
    return verdict.where(F.col("row").isNotNull()).select("row.*")


def _judged(docs: DataFrame, *, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
            max_pooled: float = MAX_POOLED_DISTANCE, common_words: int = COMMON_WORDS) -> DataFrame:
    refs = store(references(docs, common_words), "references")
    own = refs.where(F.col("lang").isNotNull())
    # About 6 kB per language; counted before it is given to every task.
    if own.count() <= MAX_LANGUAGES:
        own = F.broadcast(own)
    pooled = refs.where(F.col("lang").isNull()).first()
    q_pooled = [sum(pooled["q_classes"][k] for k in group) if pooled else 0.0 for group in POOLED]
    joined = class_counts(base_measures(docs)).join(own, "lang", "left")
    bins = range(len(CLASSES) + 1)
    classes = sum((half_term(F.col("classes")[k] / F.col("n_chars"), F.col("q_classes")[k]) for k in bins), F.lit(0.0))
    share = lambda group: sum((F.col("classes")[k] for k in group), F.lit(0.0)) / F.col("n_chars")
    shared = sum((half_term(share(group), F.lit(q)) for group, q in zip(POOLED, q_pooled)), F.lit(0.0))
    # Common words of the document: hashes found in the table, sorted, as (hash, times) by run.
    codes = F.transform("words", lambda w: F.xxhash64(F.lower(w)))
    hits = F.sort_array(F.filter("codes", lambda c: F.array_contains(F.get("slot_codes", slot_of(c).cast("int")), c)))
    ends = F.filter(F.transform("hits", lambda c, k: F.when(~c.eqNullSafe(F.get("hits", k + 1)), F.struct(c.alias("code"), (k + 1).alias("end")))), lambda x: x.isNotNull())
    terms = F.transform("ends", lambda x, k: F.struct(
        ((x.end - F.coalesce(F.get("ends", k - 1).end, F.lit(0))) / F.col("n_words")).alias("p"),
        F.try_element_at("by_code", x.code).alias("q")))
    total = lambda of: F.aggregate("terms", F.lit(0.0), lambda a, t: a + of(t))
    common = F.aggregate(F.map_values("by_code"), F.lit(0.0), lambda a, q: a + q)
    # A common word the document lacks adds half its share; all other words are one bin.
    words = total(lambda t: half_term(t.p, t.q)) + (F.col("common") - total(lambda t: t.q)) / 2 + half_term(1 - total(lambda t: t.p), 1 - F.col("common"))
    distance = lambda divergence: F.sqrt(F.greatest(divergence, F.lit(0.0)))
    scored = (
        joined.withColumn("class_distance", F.when((F.col("n_chars") >= MIN_CHARS_FOR_CLASSES) & F.col("q_classes").isNotNull(), distance(classes)))
        .withColumn("pooled_distance", F.when(F.col("n_chars") >= MIN_CHARS_FOR_CLASSES, distance(shared)))
        .withColumn("codes", F.when((F.col("n_words") >= MIN_WORDS_FOR_COMMON) & F.col("by_code").isNotNull(), codes))
        .withColumn("hits", hits).withColumn("ends", ends).withColumn("terms", terms).withColumn("common", common)
        .withColumn("word_distance", F.when(F.col("codes").isNotNull(), distance(words)))
    )
    wider = 1 + F.lit(float(SLACK_DOCS)) / F.col("n_docs")
    above = lambda name, limit: F.coalesce(F.col(name) > limit, F.lit(False))
    far = above("class_distance", max_class * wider) | above("word_distance", max_word * wider) | above("pooled_distance", F.lit(max_pooled))
    return scored.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "class_distance", "word_distance", "pooled_distance", (~F.col("base_failed") & ~far).alias("kept"))
