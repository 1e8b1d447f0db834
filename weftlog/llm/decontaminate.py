"""Benchmark leaks by an edit-distance embedding, locality-sensitive hashing and exact verification.

A random walk (CGK) reads a word sequence: at each step it writes the word under its pointer
and moves on or stays, as a random bit of (step, word) says. Sequences a few edits apart get
walks that meet again, so their outputs agree at most steps: edit distance becomes Hamming
distance. Sampling some steps is a locality-sensitive hash of the output; several walks with
several samples each reach the wanted recall. Windows of the size of the benchmark items are
looked up, and what is found is checked by the exact edit distance against the whole item.

A window within d word edits of an item of n words keeps at least n - q + 1 - qd of its runs of
q words (the q-gram lemma), so windows with fewer known pairs or triples cannot match and are
not walked.

The number of walks is set per length class: it is raised until simulated items of that length,
edited up to the limit by substitutions, insertions, deletions and a mix of them, are found with
the target recall. Long items are cut into pieces: of the pieces of an item with at most `ratio`
edits a word, one has no larger share of them, so finding any piece within its own limit is enough.
Items too short for walks are cut into one piece more than they may have edits; one of the pieces
stands in the text unchanged and is looked up as it is. Whole items are verified in every case.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.base import holds, map_batches, with_column

# Edits, in words, per word of an item; items of fewer words say too little to be looked for.
MAX_EDIT_RATIO = 0.2
MIN_ITEM_WORDS = 3
# Items of fewer words are looked up by unchanged pieces, items of more than PIECE_ABOVE words are cut.
MIN_WALKED_WORDS = 8
PIECE_ABOVE = 64
PIECE_WORDS = 48
# Recall at the limit of edits that each kind of edit must reach in simulated items.
TARGET_RECALL = 0.97
MIN_WALKS, MAX_WALKS = 6, 64
TRIALS = 64
SAMPLES_PER_WALK = 10
SAMPLED_STEPS = 4
# Items of one length class are at most this much longer than its shortest.
CLASS_RATIO = 1.2
GRAM_BITS = 22
# Benchmark text held by every task at a time; a larger benchmark is searched in blocks of it.
BLOCK_BYTES = 16 << 20
# Windows walked at once.
WALK_ROWS = 2048

HITS = "array<struct<item_id:bigint,first_word:int,n_words:int,distance:int>>"


def words_of(text: str | None) -> list[bytes]:
    """Words without ASCII white space, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def best_match(item: list[int], text: list[int]) -> tuple[int, int]:
    """(distance, end) of the part of `text` closest to `item` in word edits, the earliest on ties.

    Bit-parallel dynamic programming: one integer holds a column of differences.
    """
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    plus, minus, score = full, 0, n
    best, end = n, 0
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | (full & ~(xh | plus))
        hm = plus & xh
        score += bool(hp & top) - bool(hm & top)
        hp, hm = (hp << 1) & full, (hm << 1) & full
        plus = hm | (full & ~(xv | hp))
        minus = hp & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def walked(rows: np.ndarray, mixed: np.ndarray, bits: np.ndarray, ended: int) -> np.ndarray:
    """Outputs (step, row) of the walk given by `bits` over word sequences of equal length."""
    n, size = rows.shape
    which = np.arange(n)
    padded = np.concatenate([rows, np.full((n, 1), ended, np.int64)], axis=1)
    pointer = np.zeros(n, np.int64)
    seen = np.empty((bits.size, n), np.int64)
    for t, bit in enumerate(bits):
        word = padded[which, pointer]
        seen[t] = word
        pointer = np.minimum(pointer + ((mixed[word] * bit) >> np.uint64(63)).astype(np.int64), size)
    return seen


def edited(size: int, edits: int, kind: str, rng: np.random.Generator) -> list[int]:
    """Window of `size` words that starts with the words 1 to size after `edits` edits; 0 is any other word."""
    words = list(range(1, size + 1))
    for _ in range(edits):
        step = kind if kind != "mixed" else rng.choice(["substituted", "inserted", "deleted"])
        at = int(rng.integers(max(1, len(words))))
        if step == "inserted":
            words.insert(at, 0)
        elif step == "deleted":
            del words[at:at + 1]
        elif words:
            words[at] = 0
    return (words + [0] * size)[:size]


@lru_cache(maxsize=4096)
def walks_for(size: int, limit: int, target: float = TARGET_RECALL) -> int:
    """Walks with which windows of `size` words and `limit` edits of any one kind are found with `target` recall."""
    rng = np.random.default_rng([11, size, limit])
    kinds = ("substituted", "inserted", "deleted", "mixed")
    rows = np.array([list(range(1, size + 1))] + [edited(size, limit, kind, rng) for kind in kinds for _ in range(TRIALS)], np.int64)
    missed = np.ones((len(kinds), TRIALS))
    for n in range(1, MAX_WALKS + 1):
        mixed = rng.integers(1, 1 << 62, size + 2, dtype=np.uint64)
        seen = walked(rows, mixed, rng.integers(1, 1 << 62, 3 * size, dtype=np.uint64) | np.uint64(1), size + 1)
        agree = (seen[:, 1:] == seen[:, :1]).mean(axis=0).reshape(missed.shape)
        missed *= (1 - agree ** SAMPLED_STEPS) ** SAMPLES_PER_WALK
        if n >= MIN_WALKS and 1 - missed.mean(axis=1).max() >= target:
            break
    return n


class Index:
    """The items of one block: vocabulary, known word pairs, hash tables by length class, pieces of short items."""

    def __init__(self, items: list[tuple[int, str]], ratio: float = MAX_EDIT_RATIO, seed: int = 3):
        self.ratio, self.seed = ratio, seed
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for item_id, text in items:
            words = words_of(text)
            if len(words) >= MIN_ITEM_WORDS:
                self.items.append((item_id, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
        # Known runs of q words by hash; a collision only lets a window through to the next check.
        self.grams = {q: np.zeros(1 << GRAM_BITS, bool) for q in (2, 3)}
        for _, codes in self.items:
            for q, known in self.grams.items():
                known[self._grams(np.array(codes, np.int64), q)] = True
        # Random words by code, so that a step's bit is one multiplication.
        rng = np.random.default_rng(seed)
        self.mixed = rng.integers(1, 1 << 62, len(self.vocabulary) + 2, dtype=np.uint64)
        # Shorter texts hold no item; the longest edit of an item of few words is a lost word.
        self.least = min((len(i) - int(len(i) * ratio) for _, i in self.items), default=0)
        self.classes: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        # What is walked: (item, first word, words), whole items but for long ones.
        self.pieces: list[tuple[int, int, list[int]]] = []
        # Unchanged pieces of short items: words of a piece to its places (item, first word).
        self.exact: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = {}
        for k, (_, item) in enumerate(self.items):
            n = len(item)
            if n < MIN_WALKED_WORDS:
                cuts = [n * j // (int(n * ratio) + 1) for j in range(int(n * ratio) + 2)]
                for a, b in zip(cuts, cuts[1:]):
                    if b > a:
                        self.exact.setdefault(b - a, {}).setdefault(tuple(item[a:b]), []).append((k, a))
            else:
                parts = 1 if n <= PIECE_ABOVE else -(-n // PIECE_WORDS)
                cuts = [n * j // parts for j in range(parts + 1)]
                self.pieces += [(k, a, item[a:b]) for a, b in zip(cuts, cuts[1:])]
        waiting = sorted(range(len(self.pieces)), key=lambda p: len(self.pieces[p][2]))
        while waiting:
            size = len(self.pieces[waiting[0]][2])
            group = [p for p in waiting if len(self.pieces[p][2]) <= size * CLASS_RATIO]
            waiting = waiting[len(group):]
            self._add_class(size, group)

    @staticmethod
    def _grams(codes: np.ndarray, q: int) -> np.ndarray:
        key = codes[:len(codes) - q + 1].astype(np.uint64)
        for k in range(1, q):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k:len(codes) - q + 1 + k].astype(np.uint64)
        return ((key * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)

    def _add_class(self, size: int, group: list[int]) -> None:
        # Windows as long as the shortest item of the class: longer items are looked up by
        # their start and verified whole, so their own limit of edits holds for the window too.
        limit = max(int(len(self.pieces[p][2]) * self.ratio) for p in group)
        walks, steps = walks_for(size, limit), 3 * size
        rng = np.random.default_rng([self.seed, size])
        seeds = rng.integers(1, 1 << 62, (walks, steps), dtype=np.uint64) | np.uint64(1)
        picks = np.stack([np.stack([rng.choice(steps, SAMPLED_STEPS, replace=False) for _ in range(SAMPLES_PER_WALK)]) for _ in range(walks)])
        rows = np.full((len(group), size), -1, np.int64)
        for r, p in enumerate(group):
            rows[r] = self.pieces[p][2][:size]
        keys = self._keys(rows, seeds, picks)
        flat = keys.reshape(-1)
        owner = np.repeat(np.array(group, np.int64), keys.shape[1])
        order = np.argsort(flat, kind="stable")
        self.classes.append((size, limit, seeds, picks, flat[order], owner[order]))

    def _keys(self, rows: np.ndarray, seeds: np.ndarray, picks: np.ndarray) -> np.ndarray:
        """Hash values (row, walk * sample) of word sequences of equal length."""
        out = []
        for walk, (bits, samples) in enumerate(zip(seeds, picks)):
            seen = walked(rows, self.mixed, bits, len(self.vocabulary) + 1)
            for s, at in enumerate(samples):
                key = np.full(len(rows), walk * SAMPLES_PER_WALK + s + 1, np.uint64)
                for t in at:
                    key = key * np.uint64(0x9E3779B97F4A7C15) + self.mixed[seen[t]]
                    key ^= key >> np.uint64(29)
                out.append(key)
        return np.stack(out, axis=1)

    def _possible(self, size: int, limit: int, left: np.ndarray, heads: np.ndarray, totals: dict[int, np.ndarray]) -> np.ndarray:
        """Places of windows with enough known runs of words to be within `limit` edits."""
        ok = left >= max(1, size - limit)
        ok[heads] = True
        for q, total in totals.items():
            need, width = size - q + 1 - q * limit, size - q + 1
            if need > 0:
                ok &= total[width:width + len(left)] - total[:len(left)] >= need
        return np.flatnonzero(ok)

    def search(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text, the best match of every item that it holds within its limit, by item."""
        hits: list[list[dict]] = [[] for _ in texts]
        kept, coded = [], []
        for k, text in enumerate(texts):
            words = words_of(text)
            if self.items and words and len(words) >= self.least:
                kept.append(k)
                coded.append(np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words)))
        if not kept:
            return hits
        # All texts in one row, each followed by as many unknown words as a window can reach over its end.
        gap = max([size for size, *_ in self.classes] + list(self.exact))
        sizes = np.array([len(c) for c in coded])
        heads = np.concatenate([[0], np.cumsum(sizes + gap)])
        row = np.zeros(heads[-1] + gap, np.int64)
        for at, codes in zip(heads.tolist(), coded):
            row[at:at + len(codes)] = codes
        heads = heads[:-1]
        left = np.repeat(heads + sizes, sizes + gap) - np.arange(len(row) - gap)
        totals = {q: np.concatenate([[0], np.cumsum(self.grams[q][self._grams(row, q)], dtype=np.int32)]) for q in (3, 2)}
        items = np.array([k for k, *_ in self.pieces], np.int64)
        firsts = np.array([f for _, f, _ in self.pieces], np.int64)
        # (place in the row, item, first word of the piece in it) of whatever was found.
        found = [self._unchanged(row)]
        for size, limit, seeds, picks, keys, owners in self.classes:
            places = self._possible(size, limit, left, heads, totals)
            for i in range(0, len(places), WALK_ROWS):
                there = places[i:i + WALK_ROWS]
                got = self._keys(row[there[:, None] + np.arange(size)], seeds, picks)
                lo = np.searchsorted(keys, got, "left")
                width = np.searchsorted(keys, got, "right") - lo
                r, _ = np.nonzero(width)
                lo, width = lo[width > 0], width[width > 0]
                each = np.repeat(np.arange(len(lo)), width)
                piece = owners[lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(width) - width, width)]
                pairs = np.unique(r[each] * len(self.pieces) + piece)
                r, piece = np.divmod(pairs, max(1, len(self.pieces)))
                found.append(np.stack([there[r], items[piece], firsts[piece]]))
        place, item, first = np.concatenate(found, axis=1)
        text = np.searchsorted(heads, place, "right") - 1
        for t, parts in self._spans(text, item, place - heads[text] - first, sizes).items():
            hits[kept[t]] = self._verified(coded[t], parts)
        return hits

    def _unchanged(self, row: np.ndarray) -> np.ndarray:
        """Places of short items one of whose pieces stands in a text as it is."""
        out = []
        # A piece has known words only.
        unknown = np.concatenate([[0], np.cumsum(row == 0)])
        for size, places in self.exact.items():
            for at in np.flatnonzero(unknown[size:] == unknown[:len(unknown) - size]).tolist():
                out += [(at, k, first) for k, first in places.get(tuple(row[at:at + size].tolist()), ())]
        return np.array(out, np.int64).reshape(-1, 3).T

    def _spans(self, text: np.ndarray, item: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """Parts of each text around the starts found for an item, overlapping ones joined."""
        lengths = np.array([len(words) for _, words in self.items], np.int64)
        limits = np.array([int(len(words) * self.ratio) for _, words in self.items], np.int64)
        order = np.lexsort((start, item, text))
        text, item, start = text[order], item[order], start[order]
        lo = np.maximum(0, start - limits[item])
        hi = np.minimum(sizes[text], np.maximum(0, start + lengths[item] + limits[item]))
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
        opened = np.flatnonzero(new)
        closed = np.append(opened[1:], len(text))[:len(opened)] - 1
        out: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, k, a, b in zip(text[opened].tolist(), item[opened].tolist(), lo[opened].tolist(), hi[closed].tolist()):
            out.setdefault(t, {}).setdefault(k, []).append((a, b))
        return out

    def _verified(self, codes: np.ndarray, parts: dict[int, list[tuple[int, int]]]) -> list[dict]:
        listed = codes.tolist()
        hits = []
        for k, spans in parts.items():
            item_id, item = self.items[k]
            limit = int(len(item) * self.ratio)
            best = None
            for lo, hi in spans:
                there = set(listed[lo:hi])
                # Each word of the item that is not there costs an edit.
                if sum(w not in there for w in item) > limit:
                    continue
                distance, end = best_match(item, listed[lo:hi])
                if distance <= limit and (best is None or distance < best[0]):
                    best = (distance, lo, lo + end)
            if best:
                distance, lo, end = best
                _, back = best_match(item[::-1], listed[lo:end][::-1])
                hits.append({"item_id": item_id, "first_word": end - back, "n_words": back, "distance": distance})
        return hits


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple[int, str]]]:
    """The items in blocks of bounded size, each small enough for every task to hold.

    Items with null text or id are left out; of repeated ids every text is kept.
    """
    slim = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        part = slim.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def _searcher(spark, items: list[tuple[int, str]], ratio: float):
    """A function over texts; each worker builds the index of a block once."""
    held = spark.sparkContext.broadcast(items)
    key = hashlib.md5(repr((items, ratio)).encode()).hexdigest()

    def search(texts):
        index = _INDEXES.get(key)
        if index is None:
            _INDEXES.clear()
            index = _INDEXES[key] = Index(held.value, ratio)
        return index.search(texts)

    return search


_INDEXES: dict[str, Index] = {}
holds("items", _INDEXES.clear)


def with_hits(docs: DataFrame, benchmark: DataFrame, ratio: float = MAX_EDIT_RATIO) -> DataFrame:
    """`docs` with a column `__hits`: the items found in each text. Null text has none.

    Documents stay where they are. The benchmark is read in blocks; its size is measured first.
    """
    out = docs.withColumn("__hits", F.array().cast(HITS))
    for items in item_blocks(benchmark):
        search = _searcher(docs.sparkSession, items, ratio)
        out = with_column(out, ["text"], search, "__found", HITS, "items").withColumn("__hits", F.concat("__hits", "__found")).drop("__found")
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = MAX_EDIT_RATIO) -> DataFrame:
    """doc_id, item_id, first_word, n_words, distance: one row per document and item found in it.

    An item is found where some part of the document is within `ratio` word edits per item word;
    the closest part is given, the earliest of equals. Repeated documents give repeated rows.
    """
    slim = docs.select("doc_id", "text")
    out = None
    for items in item_blocks(benchmark):
        search = _searcher(docs.sparkSession, items, ratio)

        def run(ids, texts, search=search):
            rows = [(i, h) for i, hits in zip(ids, search(texts)) for h in hits]
            return {"doc_id": [i for i, _ in rows], **{c: [h[c] for _, h in rows] for c in ("item_id", "first_word", "n_words", "distance")}}

        part = map_batches(slim, run, "doc_id bigint, item_id bigint, first_word int, n_words int, distance int", "items")
        out = part if out is None else out.unionByName(part)
    return out
