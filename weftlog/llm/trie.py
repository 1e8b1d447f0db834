"""Prefix trie of conversations from vertical bitmaps.

Conversations are cut into shards of neighbouring ids. A shard indexes every (position, turn)
as a bitset of its conversations, one bit each. The walk starts with the bitset of all and goes
depth first: the children of a node are the intersections of its bitset with the postings of
the next position that meet it, conversations of the node without a turn there end in it.
A node's number of members is a popcount, its end list the ids of the bits that end.

A node is known by the hash of its path, so the nodes of the shards merge by key. Members and
their text lengths add up over shards, and end lists follow each other, because shards are
ranges of ids. What a subtree counts once per node, whatever the number of members, is counted
at one member: the smallest one of a node owns it. A conversation owns its path from some
depth on, so a second walk that knows this depth sums the owned parts over members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftlog.llm.base import as_batch, store
from weftlog.operators.skew import ordered

HEAD_EVERY, HEADS = 100, 6
# Conversations of one bitset, and turns after which a shard is closed even with fewer.
SHARD_CONVS, SHARD_TURNS = 4096, 200_000
# Nodes with more children than this share of all nodes are few, so their parents' ids are sent to every task.
HOT_SHARE = 1000
OUT_ROWS = 10_000

ROOT = hashlib.sha256(b"").digest()
_PIECES = ("node binary, parent binary, depth int, conv_id bigint, n_convs bigint, chars bigint, member_chars bigint, "
           "first_end bigint, ends string")
_OWNED = "node binary, n_leaves bigint, owned_chars bigint"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# --- turns --------------------------------------------------------------------


def turns(conversations: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """conv_id, idx (from 0), turn_key, chars: the turns in order, a null turn first, equal ones by role and text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.col("turn").isNotNull().alias("numbered"), "turn", role.alias("role"), text.alias("text"))
    more = {} if rows_per_task is None else {"rows_per_task": rows_per_task}
    placed = ordered(rows, ["conv_id"], ["numbered", "turn", "role", "text"], **more)
    key = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return placed.select("conv_id", F.col("pos").alias("idx"), key.alias("turn_key"), F.char_length("text").cast("bigint").alias("chars"))


def rebuilt(own: DataFrame, every: int = HEAD_EVERY, heads: int = HEADS) -> DataFrame:
    """conv_id, part, idx, turn_key, chars: part -1 is one row per conversation, part 0 the head it takes from
    conversation `conv_id - conv_id % every`, part 1 its own turns after the first h = crc32(conv_id) % `heads`."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = own.withColumn("h", h)
    convs = own.where("idx = 0").select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    # At most `heads` - 1 turns of one conversation in `every`.
    first = own.where((F.col("conv_id") % every == 0) & (F.col("idx") < heads - 1)).groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "turn_key", "chars"))).alias("head"))
    taken = convs.join(first, "base", "left").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("h").cast("int"))).alias("t"))
    marks = convs.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("idx"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("bigint").alias("chars"))
    return marks.unionByName(taken.select("conv_id", F.lit(0).alias("part"), "t.*")).unionByName(
        own.where(F.col("idx") >= F.col("h")).select("conv_id", F.lit(1).alias("part"), "idx", "turn_key", "chars"))


# --- one shard ----------------------------------------------------------------


class Shard:
    """Vertical bitmaps of neighbouring conversations, added in ascending order of their ids."""

    def __init__(self):
        self.ids: list[int] = []
        self.codes: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.sizes: list[int] = []  # chars by code
        self.paths: list[list[int]] = []  # codes of the turns of each conversation
        self.postings: list[dict[int, int]] = []  # by position: code to bitset
        self.owned_from: list[int | None] = []
        self.owns_leaf: list[bool] = []
        self.turns = 0

    def add_conversation(self, conv_id: int, owned_from: int | None = None, owns_leaf: bool = False) -> None:
        self.ids.append(conv_id)
        self.paths.append([])
        self.owned_from.append(owned_from)
        self.owns_leaf.append(owns_leaf)

    def add_turn(self, key: bytes, chars: int) -> None:
        code = self.codes.setdefault(key, len(self.keys))
        if code == len(self.keys):
            self.keys.append(key)
            self.sizes.append(chars)
        path = self.paths[-1]
        if len(path) == len(self.postings):
            self.postings.append({})
        at = self.postings[len(path)]
        at[code] = at.get(code, 0) | 1 << len(self.ids) - 1
        path.append(code)
        self.turns += 1

    def nodes(self) -> Iterator[tuple[bytes, bytes | None, int, int, int, int]]:
        """(node, parent, depth, bitset, bitset of those that end, chars of the last turn), depth first."""
        stack = [(ROOT, None, 0, (1 << len(self.ids)) - 1, 0)]
        while stack:
            node, parent, depth, members, chars = stack.pop()
            ends, rest = 0, members
            while rest:
                low = rest & -rest
                path = self.paths[low.bit_length() - 1]
                if len(path) == depth:
                    ends |= low
                    rest ^= low
                    continue
                child = rest & self.postings[depth][path[depth]]
                rest ^= child
                key = hashlib.sha256(node + self.keys[path[depth]]).digest()
                stack.append((key, node, depth + 1, child, self.sizes[path[depth]]))
            yield node, parent, depth, members, ends, chars

    def members(self, bits: int) -> Iterator[int]:
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low

    def pieces(self) -> Iterator[tuple]:
        """Rows of `_PIECES`. Text lengths of the members are those of their turns from the node on."""
        tails = [_tails([self.sizes[c] for c in path]) for path in self.paths]
        for node, parent, depth, members, ends, chars in self.nodes():
            low = (members & -members).bit_length() - 1
            total = sum(tails[m][max(depth - 1, 0)] for m in self.members(members))
            ids = [self.ids[m] for m in self.members(ends)]
            yield (node, parent, depth, self.ids[low], members.bit_count(), chars, total,
                   ids[0] if ids else None, ",".join(map(str, ids)) if ids else None)

    def owned(self) -> Iterator[tuple]:
        """Rows of `_OWNED`: leaves and text lengths of the nodes from here on that a member owns."""
        tails = [_tails([self.sizes[c] if first is not None and k + 1 >= first else 0 for k, c in enumerate(path)])
                 for path, first in zip(self.paths, self.owned_from)]
        for node, _, depth, members, *_ in self.nodes():
            leaves = chars = 0
            for m in self.members(members):
                leaves += self.owns_leaf[m]
                chars += tails[m][max(depth - 1, 0)]
            yield node, leaves, chars


def _tails(sizes: list[int]) -> list[int]:
    out = [0] * (len(sizes) + 1)
    for k in range(len(sizes) - 1, -1, -1):
        out[k] = out[k + 1] + sizes[k]
    return out


def _walk(rows: DataFrame, method: str, schema: str, shard_convs: int) -> DataFrame:
    """Shards of `rows` (conv_id, part, idx, turn_key, chars, owned_from, owns_leaf), walked one after the other."""
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def emit(shard: Shard):
        rows = []
        for row in getattr(shard, method)():
            rows.append(row)
            if len(rows) == OUT_ROWS:
                yield as_batch(dict(zip(fields.names, zip(*rows))), fields)
                rows = []
        if rows:
            yield as_batch(dict(zip(fields.names, zip(*rows))), fields)

    def run(batches):
        shard = Shard()
        for batch in batches:
            for conv_id, part, key, chars, first, leaf in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if part >= 0:
                    shard.add_turn(key, chars)
                    continue
                if len(shard.ids) >= shard_convs or shard.turns >= SHARD_TURNS:
                    yield from emit(shard)
                    shard = Shard()
                shard.add_conversation(conv_id, first, bool(leaf))
        if shard.ids:
            yield from emit(shard)

    order = ["conv_id", "part", "idx"]
    return rows.repartitionByRange("conv_id").sortWithinPartitions(*order).select(
        "conv_id", "part", "turn_key", "chars", "owned_from", "owns_leaf").mapInArrow(run, schema)


# --- all shards ---------------------------------------------------------------


def _ends_sha256(pieces: DataFrame) -> DataFrame:
    """node, ends_sha256: the pieces of a node's end list run through one hash in order of their ids.

    A shard has one piece of a node, so the node all conversations end in has as many rows as
    there are shards; they are streamed, never gathered."""
    fields = to_arrow_schema(StructType.fromDDL("node binary, ends_sha256 string"))
    rows = pieces.where(F.col("ends").isNotNull()).select("node", "first_end", "ends").repartition("node").sortWithinPartitions("node", "first_end")

    def run(batches):
        open_, digest = None, None
        for batch in batches:
            done = []
            for node, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if node == open_:
                    digest.update(b"," + ends.encode())
                else:
                    if open_ is not None:
                        done.append((open_, digest.hexdigest()))
                    open_, digest = node, hashlib.sha256(ends.encode())
            if done:
                yield as_batch(dict(zip(fields.names, zip(*done))), fields)
        if open_ is not None:
            yield as_batch({"node": [open_], "ends_sha256": [digest.hexdigest()]}, fields)

    return rows.select("node", "ends").mapInArrow(run, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, *, every: int = HEAD_EVERY, heads: int = HEADS, shard_convs: int = SHARD_CONVS,
                hot_share: int = HOT_SHARE, rows_per_task: int | None = None) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations of `conversations` (conv_id, turn, role, text):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The root has depth 0 and no parent; an empty table has no root. Null role or text is empty, null
    turns come first, repeated rows are turns of their own, other columns are ignored. Rows without
    conv_id belong to no conversation and make no node. A shard is one task's work, so a single
    conversation is too: its turns travel as keys of 32 bytes.
    """
    rows = store(rebuilt(store(turns(conversations, rows_per_task), "turns"), every, heads), "rebuilt")
    blank = rows.withColumns({"owned_from": F.lit(None).cast("int"), "owns_leaf": F.lit(None).cast("boolean")})
    pieces = store(_walk(blank, "pieces", _PIECES, shard_convs), "pieces")
    merged = pieces.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("member_chars").alias("member_chars"))
    merged = store(merged, "nodes")
    children = merged.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = store(merged.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "tree")

    owners = nodes.where("depth > 0").groupBy("conv_id").agg(
        F.min("depth").alias("owned_from"), (F.max_by("n_children", "depth") == 0).alias("owns_leaf"))
    marks = rows.where("part = -1").join(owners, "conv_id", "left")
    known = marks.unionByName(blank.where("part >= 0"))
    owned = _walk(known, "owned", _OWNED, shard_convs).groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("owned_chars").alias("owned_chars"))

    # Parents of many children: less than `hot_share` of them, for they have more than 1 / hot_share of all nodes each.
    total = nodes.count()
    many = F.col("n_children") * hot_share > total
    names = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), many.alias("hot"))
    hot = names.where("hot").drop("hot")
    by_hot = nodes.join(F.broadcast(hot), "parent", "left").withColumn("is_root", F.col("depth") == 0)
    met = by_hot.where("parent_conv_id IS NOT NULL OR is_root")
    rest = by_hot.where("parent_conv_id IS NULL AND NOT is_root").drop("parent_conv_id").join(names.where("NOT hot").drop("hot"), "parent")
    placed = met.unionByName(rest)

    out = placed.join(owned, "node").join(_ends_sha256(pieces), "node", "left")
    # A trie of turnless conversations has the root as its only leaf, which no path holds.
    leaves = F.when(F.col("n_children") == 0, F.lit(1).cast("bigint")).otherwise(F.col("n_leaves"))
    return out.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", leaves.alias("n_leaves"),
        (F.col("member_chars") - F.col("owned_chars")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
