"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if some string of LENGTH bytes that covers it also starts elsewhere. Sorting every
suffix would move the corpus hundreds of times over, so suffixes start at anchors only: the
smallest gram of each window of LENGTH bytes. Equal windows have their anchor at the same place,
so a window repeats exactly if two anchors agree on enough bytes to their left and right.

1. Each anchor gives, for a range of window offsets [oa, ob], the hash of the bytes all those
   windows share (its key) and of the bytes they cover together (its span). A key that is alone
   cannot repeat. Where a span occurs twice, all its windows do.
2. What is left are anchors near the ends of repeated passages: equal keys, different spans.
   Their suffixes are sorted in each task into runs, front-coded, exchanged, and merged by
   loser trees that keep the common prefix of each candidate with the last winner, so no prefix
   is compared twice. In the merged order the common prefixes to the right are at hand.
   Within a key, every pair that reaches LENGTH with its left side covers its bytes; large keys
   join neighbours from the longest common prefix down, smaller set into larger, which finds
   all best pairs without listing all pairs.
3. A key with too many different spans for one task is cut into narrower offset ranges, whose
   keys are longer, until it is small; a range of one offset has nothing left to compare.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftlog.llm.base import as_batch, map_batches, store, with_column
from weftlog.operators.skew import join_weighed

LENGTH = 400
GRAM = 50
# Different spans of one key that one task takes; more are cut into narrower ranges.
HOT_SPANS = 20_000
# Suffixes of one sorted run, and of one part of the merge.
RUN_ITEMS = 40_000
PART_ITEMS = 40_000
# Members up to which all pairs of a key are compared.
PAIRWISE = 24
RANGES = 4

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PIECE = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]), 1 << 14)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any parts of a text from one pass of prefix sums."""

    def __init__(self, data: bytes):
        power, self.inverse = _powers(len(data) + 1)
        terms = _BYTES[np.frombuffer(data, np.uint8)] * power[:len(data)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def anchors(hashes: Hashes, n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, smallest offset, largest offset) of every anchor of a text of n bytes.

    The anchor of a window is its smallest gram by hash, the leftmost of equals. The offset of a
    window is how far its start lies before its anchor.
    """
    windows = n - length + 1
    width = length - gram + 1
    found = []
    for lo in range(0, windows, _PIECE - width):
        many = min(windows - lo, _PIECE - width)
        at = np.arange(lo, lo + many + width - 1)
        key = (hashes.of(at, at + gram) & np.uint64(_MASK - (_PIECE - 1))) | (at - lo).astype(np.uint64)
        rows = -(-len(key) // width)
        block = np.full(rows * width, _MASK, np.uint64)
        block[:len(key)] = key
        block = block.reshape(rows, width)
        ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
        back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(back[:many], ahead[width - 1:width - 1 + many])
        place = lo + (least & np.uint64(_PIECE - 1)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        first, last = lo + cut, lo + np.concatenate([cut[1:], [many]]) - 1
        p = place[cut]
        found.append((p, p - last, p - first))
    p, low, high = (np.concatenate(x) for x in zip(*found))
    if len(found) > 1:  # an anchor of two pieces is one anchor
        u, index = np.unique(p, return_inverse=True)
        lows, highs = np.full(len(u), length), np.full(len(u), -1)
        np.minimum.at(lows, index, low)
        np.maximum.at(highs, index, high)
        return u, lows, highs
    return p, low, high


def halves(length: int, gram: int) -> list[tuple[int, int]]:
    middle = (length - gram) // 2
    return [(0, middle), (middle + 1, length - gram)]


ROWS = "id bigint, th bigint, p bigint, oa int, ob int, key bigint, span bigint"


def _range_rows(hashes: Hashes, n: int, p: np.ndarray, oa: int, ob: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    key = hashes.of(p - oa, p + length - ob)
    lo, hi = np.maximum(0, p - ob), np.minimum(n, p + length - oa)
    # Where a text ends inside the range, the two cuts are part of the span's identity.
    cuts = (p - lo).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + (hi - p).astype(np.uint64) * np.uint64(0xAEF17502108EF2D9)
    return key.view(np.int64), mixed(hashes.of(lo, hi) ^ mixed(cuts)).view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """id, th, text: a row is known by its id and the hash of its text, also where ids repeat or are null."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(ids, hashes, texts):
        out = {c: [] for c in ("id", "th", "p", "oa", "ob", "key", "span")}
        for i, h, text in zip(ids, hashes, texts):
            data = text.encode()
            if len(data) < length:
                continue
            prefix = Hashes(data)
            p, low, high = anchors(prefix, len(data), length, gram)
            for oa, ob in halves(length, gram):
                mine = p[(low <= ob) & (high >= oa)]
                key, span = _range_rows(prefix, len(data), mine, oa, ob, length)
                for name, value in (("id", i), ("th", h), ("oa", oa), ("ob", ob)):
                    out[name].append(np.full(len(mine), value, np.int64))
                out["p"].append(mine)
                out["key"].append(key)
                out["span"].append(span)
        return {c: np.concatenate(v) for c, v in out.items()} if out["p"] else None

    return map_batches(rows, run, ROWS)


def narrower(oa: int, ob: int) -> list[tuple[int, int]]:
    step = -(-(ob - oa + 1) // RANGES)
    return [(a, min(ob, a + step - 1)) for a in range(oa, ob + 1, step)]


def narrowed_rows(rows: DataFrame, hot: DataFrame, length: int) -> DataFrame:
    """Rows of narrower ranges for the members of hot keys, from their texts."""
    wanted = hot.groupBy("id", "th").agg(F.collect_set(F.struct("p", "oa", "ob")).alias("at"))

    def run(ids, hashes, texts, places):
        out = []
        for i, h, text, at in zip(ids, hashes, texts, places):
            data = text.encode()
            prefix = Hashes(data)
            for a in at:
                for oa, ob in narrower(a["oa"], a["ob"]):
                    # Some window of the range must lie inside the text.
                    if a["p"] - oa >= 0 and a["p"] + length - ob <= len(data):
                        key, span = _range_rows(prefix, len(data), np.array([a["p"]]), oa, ob, length)
                        out.append((i, h, a["p"], oa, ob, int(key[0]), int(span[0])))
        return dict(zip(("id", "th", "p", "oa", "ob", "key", "span"), zip(*out))) if out else None

    joined = rows.join(wanted.hint("shuffle_hash"), ["id", "th"]).select("id", "th", "text", "at")
    return map_batches(joined, run, ROWS)


# Front-coded runs ------------------------------------------------------------

ENTRY = struct.Struct("<HHHqqqB")


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be at least `start`."""
    hi = min(len(a), len(b))
    lo = start
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 1:  # the parts below lo agree, those below hi do not
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def front_coded(items: list[tuple]) -> bytes:
    """Sorted (suffix, left, id, th, start, many) with each suffix cut by what it shares with the one before."""
    out, before = [], b""
    for suffix, left, i, h, start, many in items:
        shared = common_prefix(before, suffix)
        tail = suffix[shared:]
        out += (ENTRY.pack(shared, len(tail), len(left), i, h, start, many), tail, left)
        before = suffix
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def decoded(block: bytes):
    """(shared, suffix, left, id, th, start, many) in order."""
    data = zstandard.ZstdDecompressor().decompress(block)
    at, before = 0, b""
    while at < len(data):
        shared, tail, left, i, h, start, many = ENTRY.unpack_from(data, at)
        at += ENTRY.size
        before = before[:shared] + data[at:at + tail]
        at += tail
        yield shared, before, data[at:at + left], i, h, start, many
        at += left


class LoserTree:
    """Merge of sorted runs. Each waiting head keeps its common prefix with the last winner: of two
    heads the one with the longer prefix is smaller, and only equal prefixes are compared, from
    their end on. A run's next head brings its prefix with the last winner from its front code."""

    def __init__(self, runs: list):
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.runs = runs
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.prefix = [0] * self.size
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of two heads; the other stays at the node with its prefix to the winner."""
        heads, prefix = self.heads, self.prefix
        if heads[a] is None:
            a, b = b, a
        elif heads[b] is not None:
            if prefix[b] > prefix[a]:
                a, b = b, a
            elif prefix[a] == prefix[b]:
                x, y = heads[a][1], heads[b][1]
                shared = common_prefix(x, y, prefix[a])
                if y[shared:shared + 1] < x[shared:shared + 1]:
                    a, b = b, a
                prefix[b] = shared
        self.losers[node] = b
        return a

    def __iter__(self):
        """(common prefix with the one before, head) of all runs in order."""
        while self.heads[self.winner] is not None:
            w = self.winner
            yield self.prefix[w], self.heads[w]
            head = next(self.runs[w], None)
            self.heads[w] = head
            self.prefix[w] = head[0] if head else 0
            node = (w + self.size) // 2
            while node:
                w = self._play(node, w, self.losers[node])
                node //= 2
            self.winner = w


# Pairs within a key -----------------------------------------------------------


def cover(members: list[tuple], shared: list[int], need: int):
    """(member, left, right) reaches: every way a member's bytes left and right agree with another
    member's on `need` bytes or more in sum, but for those inside another such way.

    `members` are (suffix extension, reversed left side) in suffix order, `shared[i]` the common
    prefix of extensions i - 1 and i.
    """
    n = len(members)
    if n <= PAIRWISE:
        for i in range(n):
            right = len(members[i][0])
            for j in range(i + 1, n):
                right = min(right, shared[j])
                least = max(0, need - right)
                a, b = members[i][1], members[j][1]
                if len(a) >= least and a[:least] == b[:least] and len(b) >= least:
                    left = common_prefix(a, b, least)
                    yield i, left, right
                    yield j, left, right
        return
    # Sets of neighbours joined from the longest common prefix down; each keeps its members in the
    # order of their left sides, where the best partner of a member is next to it.
    owner = list(range(n))
    ordered: list[list[tuple[bytes, int]] | None] = [[(members[i][1], i)] for i in range(n)]

    def root(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    for j in sorted(range(1, n), key=lambda k: -shared[k]):
        right = shared[j]
        a, b = root(j - 1), root(j)
        if len(ordered[a]) < len(ordered[b]):
            a, b = b, a
        into = ordered[a]
        for entry in ordered[b]:
            k = bisect_left(into, entry)
            for other in into[max(0, k - 1):k + 1]:
                left = common_prefix(entry[0], other[0])
                if left + right >= need:
                    yield entry[1], left, right
                    yield other[1], left, right
            into.insert(k, entry)
        owner[b], ordered[b] = a, None


def merged_spans(blocks: list[bytes], length: int):
    """(id, th, start, end) of repeated bytes among the suffixes of all runs."""
    group, shared, head = [], [], None

    def solved():
        oa, ob = struct.unpack(">HH", head[:4])
        base = 4 + length - (ob - oa)
        exts = [(e[1][base:], e[2]) for e in group]
        for k, left, right in cover(exts, [s - base for s in shared], ob - oa):
            _, _, _, i, h, start, many = group[k]
            if not many:  # the others are covered by their equal spans
                yield i, h, start - left, start + base - 4 + right

    for prefix, entry in LoserTree([decoded(b) for b in blocks]):
        if head is not None and prefix >= len(head):
            group.append(entry)
            shared.append(prefix)
            continue
        if len(group) > 1:
            yield from solved()
        oa, ob = struct.unpack(">HH", entry[1][:4])
        group, shared, head = [entry], [0], entry[1][:4 + length - (ob - oa)]
    if len(group) > 1:
        yield from solved()


SPANS = "id bigint, th bigint, start bigint, stop bigint"


def sorted_runs(rows: DataFrame, chosen: DataFrame, length: int, parts: int) -> DataFrame:
    """part, block: front-coded sorted runs of the chosen anchors' suffixes, cut by the hash of their keys."""
    wanted = chosen.groupBy("id", "th").agg(F.collect_list(F.struct("p", "oa", "ob", "many")).alias("at"))
    joined = rows.join(wanted.hint("shuffle_hash"), ["id", "th"]).select("id", "th", "text", "at")
    fields = to_arrow_schema(StructType.fromDDL("part int, block binary"))

    def run(batches):
        waiting: dict[int, list] = {}
        count = 0

        def flush():
            out = [(part, front_coded(sorted(items))) for part, items in sorted(waiting.items())]
            waiting.clear()
            return as_batch({"part": [p for p, _ in out], "block": [b for _, b in out]}, fields)

        for batch in batches:
            for i, h, text, at in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                data = text.encode()
                for a in at:
                    p, oa, ob = a["p"], a["oa"], a["ob"]
                    start = p - oa
                    stop = p + length - ob
                    head = struct.pack(">HH", oa, ob)
                    part = xxhash.xxh3_64_intdigest(head + data[start:stop]) % parts
                    left = data[max(0, p - ob):start][::-1]
                    waiting.setdefault(part, []).append((head + data[start:p + length - oa], left, i, h, start, a["many"]))
                    count += 1
                if count >= RUN_ITEMS:
                    yield flush()
                    count = 0
        if waiting:
            yield flush()

    return joined.mapInArrow(run, "part int, block binary")


def repeated_spans(rows: DataFrame, *, length: int = LENGTH, gram: int = GRAM, hot_spans: int = HOT_SPANS, part_items: int = PART_ITEMS) -> DataFrame:
    """id, th, start, stop: parts of the texts of `keyed` rows that cover all repeated strings."""
    level = store(anchor_rows(rows, length, gram), "anchors")
    out = None
    while True:
        # Written before the join, so that a key with very many rows can be split over tasks.
        keys = store(level.groupBy("key", "oa", "ob").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "keys")
        again = store(join_weighed(level, keys, ["key", "oa", "ob"], "n", level.count()), "again")
        # Equal spans merge in the tasks that read them, however many copies there are.
        spans = again.groupBy("key", "oa", "ob", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "p")).alias("one"))
        spans = store(spans, "spans")
        # A span with very many copies stays where its rows are.
        repeated = spans.where(F.col("n") > 1).select("key", "oa", "ob", "span", "n")
        twice = join_weighed(again, repeated, ["key", "oa", "ob", "span"], "n", again.count())
        direct = twice.select("id", "th", F.greatest(F.col("p") - F.col("ob"), F.lit(0)).alias("start"), (F.col("p") + length - F.col("oa")).alias("stop"))
        sizes = store(spans.groupBy("key", "oa", "ob").agg(F.count(F.lit(1)).alias("spans")).where(F.col("spans") > 1), "sizes")
        left = store(spans.join(sizes, ["key", "oa", "ob"]).select(
            "one.*", "oa", "ob", (F.col("n") > 1).cast("int").alias("many"), "spans"), "edges")
        few = left.where(F.col("spans") <= hot_spans)
        hot = left.where(F.col("spans") > hot_spans)
        counted = left.agg(F.count(F.when(F.col("spans") <= hot_spans, 1)).alias("few"), F.count(F.when(F.col("spans") > hot_spans, 1)).alias("hot")).first()
        found = direct
        if counted["few"]:
            parts = max(1, -(-counted["few"] // part_items))
            fields = to_arrow_schema(StructType.fromDDL(SPANS))

            def merge(batches, length=length):
                blocks = [b for batch in batches for b in batch.column(1).to_pylist()]
                chunk = []
                for row in merged_spans(blocks, length):
                    chunk.append(row)
                    if len(chunk) == 20_000:
                        yield as_batch(dict(zip(fields.names, zip(*chunk))), fields)
                        chunk = []
                if chunk:
                    yield as_batch(dict(zip(fields.names, zip(*chunk))), fields)

            runs = sorted_runs(rows, few, length, parts)
            found = found.unionByName(runs.repartitionById(parts, F.col("part")).mapInArrow(merge, SPANS))
        out = found if out is None else out.unionByName(found)
        if not counted["hot"]:
            return out
        level = store(narrowed_rows(rows, hot, length), "narrowed")


def joined_spans(spans: list[dict] | None, size: int, length: int) -> list[tuple[int, int]]:
    """Disjoint ascending runs of the union; parts shorter than one string hold none."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], min(size, s["stop"])) for s in spans or ()):
        if b - a < length:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# One word of a text as so many bytes, for runs that are counted in words.
WORD_CODE = 8


def word_code(word: bytes) -> bytes:
    """48 bits of a hash of the word, in eight ASCII characters."""
    return base64.b64encode(xxhash.xxh3_64_digest(word)[:6])


def word_coded(rows: DataFrame) -> DataFrame:
    """`keyed` rows with every word of the text, a run of bytes other than white space, replaced by its code."""
    def run(ids, hashes, texts):
        known: dict[bytes, bytes] = {}
        out = []
        for text in texts:
            words = text.encode().split()
            for w in [w for w in set(words) if w not in known]:
                known[w] = word_code(w)
            out.append(b"".join(map(known.__getitem__, words)).decode())
        return {"id": ids, "th": hashes, "text": out}

    return map_batches(rows, run, "id bigint, th bigint, text string")


def without_repeated_runs(docs: DataFrame, words: int, **how) -> DataFrame:
    """`docs` with `__rest`, the text without every run of `words` words or more that also stands anywhere else.

    The search is that of repeated byte strings over the coded words, so runs are whole words and
    differences in white space do not matter. Equal codes of different words (48 bits) are the one
    way to a wrong run; it would take `words` of them in a row. What follows a removed run moves
    up; other text stays as it is, null stays null."""
    length = words * WORD_CODE
    marked = with_removals(docs, rows=word_coded(keyed(docs)), size=lambda t: len(t.encode().split()) * WORD_CODE, length=length, **how)

    def run(texts, removed):
        out = []
        for text, runs in zip(texts, removed):
            whole = [(-(-r["start"] // WORD_CODE), r["stop"] // WORD_CODE) for r in runs]
            whole = [(a, b) for a, b in whole if b - a >= words]
            if not whole:
                out.append(text)
                continue
            starts = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
            kept, at = [], 0
            for a, b in whole:
                kept.append(text[at:starts[a]])
                at = starts[b]
            out.append("".join([*kept, text[at:]]))
        return out

    return with_column(marked, ["text", "__removed"], run, "__rest", "string").drop("__removed")


def with_removals(docs: DataFrame, rows: DataFrame | None = None, size: Callable[[str], int] = lambda t: len(t.encode()), **how) -> DataFrame:
    """`docs` with `__removed`, the (start, stop) byte runs to take out of each text.

    Null text is empty, and a text of fewer than LENGTH bytes keeps everything. Repeated rows
    are copies of each other like any two equal texts, also under one id or without one. `rows` are
    the `keyed` rows, by default those of `docs`, with other bytes for the same texts, and `size` then
    gives their number for a text.
    """
    length = how.get("length", LENGTH)
    rows = keyed(docs) if rows is None else rows
    # A shuffled row is known by (id, th), so equal rows get equal spans.
    spans = repeated_spans(rows, **how).groupBy("id", "th").agg(F.collect_set(F.struct("start", "stop")).alias("__spans"))
    marked = docs.withColumns({"__id": F.coalesce("doc_id", F.lit(-(1 << 63))), "__th": F.xxhash64(F.coalesce("text", F.lit("")))})
    met = marked.join(spans.withColumnsRenamed({"id": "__id", "th": "__th"}).hint("shuffle_hash"), ["__id", "__th"], "left").drop("__id", "__th")

    def run(texts, found):
        return [[{"start": a, "stop": b} for a, b in joined_spans(s, size(t or ""), length)] for t, s in zip(texts, found)]

    return with_column(met, ["text", "__spans"], run, "__removed", "array<struct<start:bigint,stop:bigint>>").drop("__spans")


def kept_bytes(text: str | None, removed: list[dict]) -> bytes:
    data, at, out = (text or "").encode(), 0, []
    for r in removed:
        out.append(data[at:r["start"]])
        at = r["stop"]
    return b"".join([*out, data[at:]])


def kept_text(docs: DataFrame) -> DataFrame:
    """Documents of `with_removals` with `__rest`, the rest of their texts; a character cut in the middle goes."""
    run = lambda texts, removed: [None if t is None else kept_bytes(t, r).decode("utf-8", "ignore") for t, r in zip(texts, removed)]
    return with_column(docs, ["text", "__removed"], run, "__rest", "string")


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text of documents of `with_removals`; text is what is
    kept, without a character cut in the middle."""

    def run(ids, texts, removed):
        sizes = [len((t or "").encode()) for t in texts]
        kept = [kept_bytes(t, r) for t, r in zip(texts, removed)]
        return {"doc_id": ids, "n_bytes": sizes, "n_removed": [sum(x["stop"] - x["start"] for x in r) for r in removed], "n_spans": [len(r) for r in removed],
                "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept], "text": [k.decode("utf-8", "ignore") for k in kept]}

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string"
    return map_batches(docs.select("doc_id", "text", "__removed"), run, schema)
