"""Near-duplicate groups by an LSH forest, confirmed on full shingle sets.

A forest has several trees. A tree's label of a document is a string of min-hash values, and the
tree is the sorted order of all labels. Documents next to each other with a long common prefix
are likely similar, so they are candidates; how long the prefix must be depends on the region:
a small region is compared at MIN_DEPTH values, a crowded one is cut at the next value and the
next, down to the full label, with neighbours, and with the member that has most likely partners,
so that a group around one centre holds together. Candidates that all hash values call dissimilar
are left out, the others are confirmed on their full sets in rounds: each round takes the most
likely links that still connect different groups, so pairs inside a group are never listed, and
the last takes all.

What crowded regions leave out is found exactly: a prefix-filter join of the full sets lists every
pair of their members that may be linked and is not yet in one group. Shingles are sorted by a
count sketch, rare ones first, so boilerplate comes last; which order it is changes the number of
candidates and never a result.

Exact copies of a set are one member throughout.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftlog.llm.base import as_batch, map_batches, store

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 75
TREES = 24
DEPTH = 8
# A pair at 75 % shares four values of a tree with probability 0.32, of one of 24 trees with 0.9999.
MIN_DEPTH = 4
REGION = 8
NEIGHBOURS = 2
# Share of equal hash values under which a pair is not confirmed: for a pair at 75 % of 192
# values this lies 4.8 standard deviations below the mean.
LEAST_ESTIMATE = 0.60
LIKELY = 0.72
# Counters of the sketch that orders shingles, and rows a side of one cell of the prefix join.
SLOTS = 1 << 18
CELL = 500

_RNG = np.random.default_rng(29)
_WORD = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_XOR = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_ODD = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 14)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the document's shingles.

    A-Z lower-cased, words separated by ASCII white space; fewer than five words are one shingle.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_WORD[data] * power[:len(data)], dtype=np.uint64)])
    gaps = np.flatnonzero(data == 32)
    lo, hi = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    n = SHINGLE_WORDS
    lo, hi = (lo[:1], hi[-1:]) if len(lo) < n else (lo[:len(lo) - n + 1], hi[n - 1:])
    return np.unique(_mixed((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64)))


def signature(found: np.ndarray) -> np.ndarray:
    """TREES * DEPTH min-hash values of 16 bits."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):
        least = np.minimum(least, ((low[i:i + 512, None] ^ _XOR) * _ODD).min(axis=0))
    # The smallest of many values has empty high bits: mix before cutting it to 16.
    least = (least ^ (least >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return ((least ^ (least >> np.uint32(13))) & np.uint32(0xFFFF)).astype(">u2")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= SIMILAR_PERCENT * (len(a) + len(b) - common)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (identity of the set) and sig per row; no sig for an empty set."""

    def run(ids, texts):
        out = {c: [] for c in ("doc_id", "n_shingles", "h1", "h2", "sig")}
        for i, text in zip(ids, texts):
            s = shingles(text)
            out["doc_id"].append(i)
            out["n_shingles"].append(len(s))
            out["h1"].append(int(np.sum(_mixed(s), dtype=np.uint64).view(np.int64)))
            out["h2"].append(int(np.sum(_mixed(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).view(np.int64)))
            out["sig"].append(signature(s).tobytes() if len(s) else None)
        return out

    return map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, sig binary")


# Candidates from the sorted orders ----------------------------------------------


def region_pairs(members: list[tuple[bytes, int]], depth: int = MIN_DEPTH):
    """Candidate pairs of one region, whose labels (sorted) share `depth` values of two bytes."""
    if len(members) <= REGION:
        for i, (_, a) in enumerate(members):
            for _, b in members[i + 1:]:
                yield a, b
    elif depth == DEPTH:
        for i, (_, a) in enumerate(members):
            for _, b in members[i + 1:i + 1 + NEIGHBOURS]:
                yield a, b
    else:
        lo = 0
        for i in range(1, len(members) + 1):
            if i == len(members) or members[i][0][2 * depth:2 * depth + 2] != members[lo][0][2 * depth:2 * depth + 2]:
                if i - lo > 1:
                    yield from region_pairs(members[lo:i], depth + 1)
                lo = i
        # Neighbours across the cuts: the order of the labels decides, as within a leaf.
        for (_, a), (_, b) in zip(members, members[1:]):
            yield a, b


def forest(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) candidates with a < b, and (region, id) of the members of crowded regions.

    All trees are sorted at once: range partitions of (tree, label) are dealt by size, so a region
    spans tasks if it must; each task cuts what it holds, and its first and last regions, which may
    go on in another task, count as crowded.
    """
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = (
        reps.select("id", "sig", trees.alias("tree"))
        .select("tree", F.expr(f"substring(sig, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("label"), "id")
    )
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(n, "tree", "label").sortWithinPartitions("tree", "label", "id")
    fields = to_arrow_schema(StructType.fromDDL("a bigint, b bigint, region binary"))
    head = 2 * MIN_DEPTH

    def run(batches):
        region, members, out, first = None, [], [], False

        def flush(border=False):
            out.extend((min(a, b), max(a, b), None) for a, b in region_pairs(members) if a != b)
            if border or len(members) > REGION:
                out.extend((i, None, region) for _, i in members)

        def batch_of(some):
            a, b, r = zip(*some)
            return as_batch({"a": a, "b": b, "region": r}, fields)

        for batch in batches:
            for tree, label, i in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                here = bytes([tree]) + label[:head]
                if here != region:
                    flush(first)
                    first = region is None
                    region, members = here, []
                members.append((label, i))
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        flush(True)
        if out:
            yield batch_of(out)

    found = store(ordered.mapInArrow(run, "a bigint, b bigint, region binary"), "forest")
    pairs = found.where(F.col("b").isNotNull()).select("a", "b").distinct()
    return pairs, found.where(F.col("b").isNull()).select("region", F.col("a").alias("id"))


def estimated(pairs: DataFrame, reps: DataFrame, least: float = LEAST_ESTIMATE) -> DataFrame:
    """a, b, est of the pairs whose hash values do not rule them out."""
    sig = reps.select("id", "sig")
    both = (
        pairs.join(sig.withColumnsRenamed({"id": "a", "sig": "sa"}), "a")
        .join(sig.withColumnsRenamed({"id": "b", "sig": "sb"}), "b").select("a", "b", "sa", "sb")
    )

    def run(a, b, sa, sb):
        x = np.frombuffer(b"".join(sa), ">u2").reshape(len(a), -1)
        y = np.frombuffer(b"".join(sb), ">u2").reshape(len(a), -1)
        est = (x == y).mean(axis=1)
        keep = np.flatnonzero(est >= least)
        return {"a": [a[k] for k in keep], "b": [b[k] for k in keep], "est": est[keep]}

    return map_batches(both, run, "a bigint, b bigint, est double")


def centres(crowded: DataFrame, likely: DataFrame) -> DataFrame:
    """(a, b): each member of a crowded region with the region's member of most likely partners."""
    ends = likely.where(F.col("est") >= LIKELY).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    ranked = crowded.join(ends, "id")
    top = ranked.groupBy("region").agg(F.max(F.struct(F.col("degree"), (-F.col("id")).alias("back"))).alias("top"))
    met = crowded.join(top.select("region", (-F.col("top.back")).alias("hub")), "region").where(F.col("id") != F.col("hub"))
    return met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


# Exact candidates ---------------------------------------------------------------


def slots(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(SLOTS - 1)).astype(np.int64)


def sketch(texts: DataFrame) -> np.ndarray:
    """How many shingles of the texts fall into each of SLOTS counters."""
    fields = to_arrow_schema(StructType.fromDDL("slot int, n bigint"))

    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(total, slots(shingles(text)), 1)
        used = np.flatnonzero(total)
        yield as_batch({"slot": used.astype(np.int32), "n": total[used]}, fields)

    rows = texts.select("text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def prefixes(members: DataFrame, weight: np.ndarray) -> DataFrame:
    """shingle, id, c, n, at and `short` of the shingles by which a member can be found.

    Sets of x <= y shingles are linked if they share ceil(75 (x + y) / 175). With both in one order
    they then share one of the first y - ceil(0.75 y) + 1 of the larger and of the first
    x - ceil(150 x / 175) + 1 of the smaller set (`short`).
    """
    p = SIMILAR_PERCENT

    def run(ids, groups, texts):
        out = {c: [] for c in ("shingle", "id", "c", "n", "at", "short")}
        for i, c, text in zip(ids, groups, texts):
            s = shingles(text)
            n = len(s)
            m, k = n - (p * n + 99) // 100 + 1, n - (2 * p * n + 99 + p) // (100 + p) + 1
            first = s[np.lexsort((s, weight[slots(s)]))[:m]] if n else s
            out["shingle"].append(first.view(np.int64))
            out["at"].append(np.arange(len(first), dtype=np.int32))
            out["short"].append(np.arange(len(first)) < k)
            for name, value in (("id", i), ("c", c), ("n", n)):
                out[name].append(np.full(len(first), value, np.int64))
        return {c: np.concatenate(v) for c, v in out.items()}

    return map_batches(members.select("id", "c", "text"), run, "shingle bigint, id bigint, c bigint, n bigint, at int, short boolean")


def unmet(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b) with a < b: every pair of `texts` of different groups that can reach the similarity.

    Members of a shingle's largest group are not compared with each other. The others meet in
    cells of at most about CELL rows a side, so no shingle gathers in one task.
    """
    p = SIMILAR_PERCENT
    members = texts.join(roots.withColumnRenamed("root", "c"), "id")
    rows = store(prefixes(members, sketch(texts)), "prefixes")
    per = rows.groupBy("shingle", "c").agg(F.count(F.lit(1)).alias("k"), F.count_if("short").alias("shorts"))
    open_ = per.groupBy("shingle").agg(
        F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("k"), F.sum("shorts").alias("shorts"),
    ).where((F.col("k") > F.col("top.k")) & (F.col("shorts") > 0)).select(
        "shingle", F.col("top.c").alias("top"), F.ceil(F.col("k") / CELL).cast("int").alias("cells"))
    met = store(rows.join(open_, "shingle").withColumn("other", F.col("c") != F.col("top")).drop("top"), "met")
    cell, cells = F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"), F.explode(F.expr("sequence(0, cells - 1)"))
    x = met.where("short").select("shingle", cell.alias("i"), cells.alias("j"), F.col("id").alias("x"), F.col("c").alias("cx"),
                                  F.col("n").alias("nx"), F.col("at").alias("px"), F.col("other").alias("ox"))
    y = met.select("shingle", cells.alias("i"), cell.alias("j"), F.col("id").alias("y"), F.col("c").alias("cy"),
                   F.col("n").alias("ny"), F.col("at").alias("py"), F.col("other").alias("oy"))
    # Equal sizes are taken in the order of the ids; the rest of both sets must suffice from the shared shingle on.
    need = F.expr(f"{p} * (nx + ny)")
    may = (
        (F.col("cx") != F.col("cy")) & ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))))
        & F.expr(f"100 * nx >= {p} * ny") & (F.expr(f"{100 + p} * (nx - px)") >= need) & (F.expr(f"{100 + p} * (ny - py)") >= need)
    )
    key = ["shingle", "i", "j"]
    side = lambda u, v: u.join(v, key).where(may).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return side(x, y.where("oy")).unionByName(side(x.where("ox"), y.where("NOT oy"))).distinct()


# Confirmation ---------------------------------------------------------------------


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(ca, cb) of the pairs (a, b, ca, cb) whose full sets reach the similarity.

    A pair and its two texts meet in a group of two rows; no document gathers its partners.
    """
    ends = pairs.select("a", "b", "ca", "cb", F.explode(F.array("a", "b")).alias("id"))
    met = ends.join(texts, "id").groupBy("a", "b", "ca", "cb").agg(F.collect_list("text").alias("two")).select("ca", "cb", "two")

    def run(a, b, two):
        ok = [len(t) == 2 and linked(shingles(t[0]), shingles(t[1])) for t in two]
        return {"ca": [x for x, k in zip(a, ok) if k], "cb": [x for x, k in zip(b, ok) if k]}

    return map_batches(met, run, "ca bigint, cb bigint")


def components(edges: DataFrame) -> DataFrame:
    """id, root: the smallest id reachable, for every id of `edges` (a, b).

    Large-star and small-star steps in turn: every step links neighbours to the smallest one
    around, so groups turn into stars in a number of rounds that grows with the logarithm of
    their size. Rows stay as many as the edges; no group meets in one task.
    """
    now = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    while True:
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours of u and u itself go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        now = store(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
                    .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # Done when every id has one parent and no parent has one itself.
        ends = now.select(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
            now.select(F.col("v").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        open_ids = ends.groupBy("id").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where((F.col("c") > 1) | ((F.col("c") > 0) & (F.col("p") > 0)))
        if open_ids.isEmpty():
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs between different groups, with the groups as ca < cb."""
    at = lambda side: roots.withColumnsRenamed({"id": side, "root": f"r{side}"})
    met = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").select(
        "a", "b", "est", F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
    return met.where(F.col("x") != F.col("y")).select("a", "b", "est", F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb"))


def best_links(pairs: DataFrame) -> DataFrame:
    """For each group the most likely pair that leaves it; ties take the smaller ids."""
    rank = F.min(F.struct((-F.col("est")).alias("e"), "a", "b", "ca", "cb")).alias("p")
    sides = [pairs.groupBy(F.col(c).alias("c")).agg(rank) for c in ("ca", "cb")]
    best = sides[0].unionByName(sides[1]).groupBy("c").agg(F.min("p").alias("p"))
    return best.select("p.a", "p.b", "p.ca", "p.cb").distinct()


def merged(pairs: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """`roots` (id, root) after all links among the pairs (a, b, est), confirmed in rounds."""
    rest, open_pairs = pairs, store(across(pairs, roots), "open")
    for last in (False, False, True):
        if open_pairs.isEmpty():
            break
        chosen = store(open_pairs.select("a", "b", "ca", "cb") if last else best_links(open_pairs), "chosen")
        # Groups are joined, not documents: a round only sees the groups of the last one.
        joined = components(confirmed(chosen, texts).select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(
            F.col("id").alias("root"), F.col("root").alias("top"))
        roots = store(roots.join(joined, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "roots")
        if last:
            break
        rest = rest.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
        open_pairs = store(across(rest, roots), "open")
    return roots


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of `docs` (doc_id, text).

    Documents with 100 * intersection >= 75 * union of their shingle sets are linked; a component's
    id is its smallest doc_id and that document is the one kept. An empty set is linked with
    nothing. Rows of equal id are copies of one component if their sets agree; rows without id
    take part as copies and are kept only if their set has no other document.
    """
    slim = docs.select("doc_id", "text")
    every = store(sets(slim), "sets")
    # One member per set; equal sets merge in the tasks that read them.
    reps = store(
        every.where(F.col("sig").isNotNull()).groupBy("h1", "h2").agg(
            F.min("doc_id").alias("id"), F.first("sig").alias("sig")).where(F.col("id").isNotNull()), "reps")
    pairs, crowded = forest(reps)
    likely = store(estimated(pairs, reps), "likely")
    likely = store(likely.unionByName(estimated(centres(crowded, likely).join(likely, ["a", "b"], "left_anti"), reps)), "candidates")
    crowd = store(crowded.select("id").distinct(), "crowd")
    involved = likely.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowd).distinct()
    # Every row of an id carries a text of it; the set decides which one is the member's.
    texts = store(
        slim.withColumnRenamed("doc_id", "id").join(involved.hint("shuffle_hash"), "id", "left_semi")
        .groupBy("id").agg(F.min("text").alias("text")), "texts")
    roots = store(texts.select("id", F.col("id").alias("root")), "roots")
    roots = merged(likely, texts, roots)
    exact = unmet(texts.join(crowd, "id", "left_semi"), roots).join(likely, ["a", "b"], "left_anti")
    roots = merged(store(estimated(exact, reps, 0.0), "exact"), texts, roots)
    rooted = reps.select("h1", "h2", F.col("id").alias("member")).join(roots, F.col("member") == F.col("id"), "left").select(
        "h1", "h2", F.coalesce("root", "member").alias("component"))
    out = every.drop("sig").join(rooted, ["h1", "h2"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
