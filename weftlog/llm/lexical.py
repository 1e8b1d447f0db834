"""Ranked search of a set of items over all documents, with the sums that items share worked out once.

The terms of an item are the operands of a sum. Terms that the same items hold are mined
into shared sets: in rounds, the operands of every item are put into one common order (most
items first), neighbours are paired, and a pair that two or more items hold becomes a node,
which replaces its operands in all of them. What remains is a graph in which a node is the
sum of two others and an item is the sum of its roots.

One pass over the texts keeps, per document, the terms that items ask for. A second pass
reads these postings batch by batch, fills one accumulator per node and document, level by
level, and adds up each item from its roots. All numbers are 64-bit integers, so the order
of the additions does not matter.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftlog.llm.base import as_batch, map_batches, store
from weftlog.llm.words import words_of

# Fixed values of the score.
TF_SCALE, TF_WEIGHT, LENGTH_WEIGHT, LENGTH_SHARE = 1_000_000_000, 1000, 20, 50
TOP = 50
# Bytes of item text that are searched in one pass; a block's terms and graph go to every task.
BLOCK_BYTES = 1_000_000
# Numbers in one matrix of accumulators.
CELLS = 4_000_000
# Documents whose scores give every item a lower bound before the full pass. They drop no
# result: the bound is reached by as many documents as are asked for.
BOUND_DOCS = 20_000
BOUND_TASKS = 8

_BEST = "item int, doc_id bigint, score bigint"


@dataclass(frozen=True)
class QueryGraph:
    """`levels` holds (left, right) operand numbers of the nodes of each level; operands below
    `terms` are terms, later ones are nodes in the order of `levels`. Item i is the sum of
    `roots[starts[i]:starts[i + 1]]`."""

    terms: int
    levels: list[tuple[np.ndarray, np.ndarray]]
    roots: np.ndarray
    starts: np.ndarray

    @property
    def size(self) -> int:
        return self.terms + sum(len(left) for left, _ in self.levels)

    @property
    def additions(self) -> int:
        return self.size - self.terms + len(self.roots) - (len(self.starts) - 1)

    def totals(self, acc: np.ndarray) -> np.ndarray:
        """Scores by item and document. `acc` has a row per operand, those of terms filled in."""
        at = self.terms
        for left, right in self.levels:
            acc[at:at + len(left)] = acc[left] + acc[right]
            at += len(left)
        return np.add.reduceat(acc[self.roots], self.starts[:-1], axis=0)


def share_sums(items: list[list[int]], terms: int) -> QueryGraph:
    """The graph of `items`, lists of distinct term numbers below `terms`, none empty.

    A round looks at each item once, so mining is linear in the items; it ends when no
    neighbours are shared. Items of the same terms end in the same root.
    """
    live = [set(i) for i in items]
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    size = terms
    while True:
        held = Counter(t for i in live for t in i)
        order = [sorted((t for t in i if held[t] > 1), key=lambda t: (-held[t], t)) for i in live]
        seen = Counter(p for o in order for p in zip(o, o[1:]))
        # The pairs most items hold come first, so an operand goes where it saves most.
        chosen = [sorted((p for p in zip(o, o[1:]) if seen[p] > 1), key=lambda p: (-seen[p], p)) for o in order]
        found: list[list[tuple[int, int]]] = []
        for pairs in chosen:
            used: set[int] = set()
            mine = []
            for p in pairs:
                if used.isdisjoint(p):
                    used.update(p)
                    mine.append(p)
            found.append(mine)
        kept = sorted(p for p, n in Counter(p for mine in found for p in mine).items() if n > 1)
        if not kept:
            break
        number = {p: size + k for k, p in enumerate(kept)}
        for i, mine in zip(live, found):
            for p in mine:
                if p in number:
                    i.difference_update(p)
                    i.add(number[p])
        levels.append((np.array([a for a, _ in kept]), np.array([b for _, b in kept])))
        size += len(kept)
    roots = [sorted(i) for i in live]
    return QueryGraph(terms, levels, np.array([t for r in roots for t in r], dtype=np.int64),
                      np.cumsum([0, *(len(r) for r in roots)]))


class Best:
    """The `k` best (score, then smallest id) documents of every item that this task has seen.

    Rows without an id come before those with one."""

    def __init__(self, items: int, k: int, bound: np.ndarray | None):
        self.k = k
        self.bound = np.ones(items, np.int64) if bound is None else np.maximum(bound, 1)
        self.rows = [np.zeros((4, 0), np.int64)]  # item, score, has an id, id
        self.waiting, self.room = 0, max(100_000, 4 * k * items)

    def add(self, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.bound[:, None])
        if len(item):
            self.rows.append(np.stack([item, scores[item, doc], known[doc], ids[doc]]))
            self.waiting += len(item)
        if self.waiting > self.room:
            self.rows = [self.settled()]
            self.waiting = self.rows[0].shape[1]

    def settled(self) -> np.ndarray:
        rows = np.concatenate(self.rows, axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], rows[0])
        rows = rows[:, np.arange(rows.shape[1]) - first < self.k]
        item, n = np.unique(rows[0], return_counts=True)
        full = n >= self.k
        if full.any():
            last = np.cumsum(n)[full] - 1
            self.bound[item[full]] = np.maximum(self.bound[item[full]], rows[1, last])
        return rows


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the text), terms, tfs: numbers and counts of the asked terms in it."""
    def count(ids, raws):
        sizes, terms, tfs = [], [], []
        for raw in raws:
            words = words_of(raw)
            found = Counter(map(vocabulary.get, words))
            found.pop(None, None)
            sizes.append(len(words))
            terms.append(list(found))
            tfs.append(list(found.values()))
        return {"doc_id": ids, "n": sizes, "terms": terms, "tfs": tfs}

    slim = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    return map_batches(slim, count, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def _best(postings: DataFrame, graph: QueryGraph, weights: np.ndarray, total: tuple[int, int], k: int,
          bound: np.ndarray | None = None) -> DataFrame:
    """item, doc_id, score: the `k` best of every task, those below `bound` left out."""
    documents, words = total
    fields = to_arrow_schema(StructType.fromDDL(_BEST))
    step = max(1, CELLS // (graph.size + len(graph.roots)))

    def run(batches):
        best = Best(len(graph.starts) - 1, k, bound)
        for batch in batches:
            ids, n = batch.column(0), batch.column(1).to_numpy()
            known = np.asarray(ids.is_valid(), dtype=np.int64)
            ids = ids.fill_null(0).to_numpy()
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // words
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            terms, tfs = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
            doc = np.repeat(np.arange(len(n)), np.diff(ends))
            value = weights[terms] * ((TF_SCALE * tfs) // (TF_WEIGHT * tfs + LENGTH_WEIGHT * m[doc]))
            for a in range(0, len(n), step):
                b = min(a + step, len(n))
                acc = np.zeros((graph.size, b - a), np.int64)
                part = slice(ends[a], ends[b])
                acc[terms[part], doc[part] - a] = value[part]
                best.add(graph.totals(acc), known[a:b], ids[a:b])
        item, score, known, ids = best.settled()
        for a in range(0, len(item), 10_000):
            part = slice(a, a + 10_000)
            yield as_batch({"item": item[part], "score": score[part], "doc_id": pa.array(ids[part], mask=known[part] == 0)}, fields)

    return postings.mapInArrow(run, _BEST)


def _ranked(best: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, *, block_bytes: int = BLOCK_BYTES,
         bound_docs: int = BOUND_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best documents of `docs` (doc_id, text) for every item of
    `items` (item_id, text), scores above 0 only; other columns are ignored.

    Every row of `docs` is a document, so a repeated row takes several ranks. Null and empty texts
    have no terms. Equal scores go by doc_id, a null one first. Rows of one item_id (null is one
    too) are one item with the terms of all of them; an item without terms has no rows.

    Items are dealt over blocks of about `block_bytes` by a hash of their id, and each block is one
    pass over the documents. A task holds a block's terms, one matrix of accumulators and its
    best rows. The k-th best score among about `bound_docs` documents, where there are more, is a
    lower bound for each item, so that tasks report few rows that cannot be in the result.
    """
    spark = docs.sparkSession
    texts = items.select("item_id", F.col("text").cast("binary").alias("raw"))
    asked = map_batches(texts, lambda ids, raws: {"item_id": ids, "terms": [list(set(words_of(r))) for r in raws]},
                        "item_id bigint, terms array<binary>")
    asked = store(asked.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
                  .where(F.size("terms") > 0), "items")
    size = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(t) + 1))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks if size else 0):
        # Bounded by `block_bytes`: the only items the driver sees.
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        if rows:
            out = out.unionByName(_rank_block(docs, sorted((r["item_id"] is not None, r["item_id"] or 0, sorted(map(bytes, r["terms"]))) for r in rows), k, bound_docs))
    return out


def _rank_block(docs: DataFrame, items: list[tuple[bool, int, list[bytes]]], k: int, bound_docs: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    numbers = [[vocabulary.setdefault(t, len(vocabulary)) for t in terms] for *_, terms in items]
    graph = share_sums(numbers, len(vocabulary))
    postings = store(_postings(docs, vocabulary), "postings")
    documents, words = postings.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * documents + 2) / (2 * F.col("df") + 1)))
    weights = np.zeros(len(vocabulary), np.int64)
    for r in df.select("term", weight.alias("w")).collect():  # at most the terms of the block
        weights[r["term"]] = r["w"]
    total, bound = (documents, words), None
    if documents > bound_docs:
        some = postings.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(documents // bound_docs)) == 0).repartition(BOUND_TASKS)
        bound = np.zeros(len(items), np.int64)
        for r in _ranked(_best(some, graph, weights, total, k), k).where(F.col("rank") == k).collect():  # one row an item
            bound[r["item"]] = r["score"]
    names = spark.createDataFrame([(i, item_id if known else None) for i, (known, item_id, _) in enumerate(items)], "item int, item_id bigint")
    best = _ranked(_best(postings, graph, weights, total, k, bound), k)
    # One row per item of the block.
    return best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
