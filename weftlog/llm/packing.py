"""Length buckets with the least padding, and batches of a token budget inside each bucket.

The histogram of sequence lengths over all documents has at most `max_len + 1` entries, so
it is the one thing the driver sees. A dynamic program over it finds the bucket borders that
minimise the padding tokens exactly: `best[k][j]` is the least padding of all sequences of
at most j tokens in k buckets, the last of which is padded to j.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlog.llm import bpe, tokens
from weftlog.llm.base import map_batches, store

MAX_LEN = 2048
BUCKETS = 16
TOKEN_BUDGET = 65_536
# Sequences numbered by one task; only the number of groups follows from it, not the result's shape.
# A sequence has at most MAX_LEN ids of 2 or 4 bytes, so a group sorts at most some 80 or 160 MB.
GROUP_ROWS = 20_000


def bucket_borders(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper borders of at most `buckets` buckets with the least total padding, ascending.

    Only lengths that occur can be borders. No lengths: no borders. Ties take the smaller border.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v), dtype=np.int64)
    if not len(lengths):
        return []
    n = np.array([histogram[int(k)] for k in lengths], dtype=np.float64)
    count = np.concatenate([[0.0], np.cumsum(n)])
    total = np.concatenate([[0.0], np.cumsum(n * lengths)])
    m = len(lengths)
    # cost(i, j): lengths[i..j-1] in one bucket padded to lengths[j-1]
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    choice = []
    for _ in range(min(buckets, m)):
        new, pick = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        new[0] = 0.0
        for j in range(1, m + 1):
            cost = best[:j] + lengths[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])
            pick[j] = int(np.argmin(cost))
            new[j] = cost[pick[j]]
        choice.append(pick)
        best = new
    borders, j = [], m
    for pick in reversed(choice):
        if j == 0:
            break
        borders.append(int(lengths[j - 1]))
        j = int(pick[j])
    return borders[::-1]


def encoded(docs: DataFrame, tokenizer_path: str, leave: bool = False) -> DataFrame:
    """doc_id, n_tokens, id_bytes, ids of every row of `docs`; `ids` holds little-endian unsigned
    integers of `id_bytes` bytes. Null text has 0 tokens."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def encode(ids, texts):
        width = bpe.word_memo(tokenizer_path).width
        coded = tokens.token_ids(tokenizer_path, texts)
        return {"doc_id": ids, "n_tokens": [len(b) // width for b in coded], "id_bytes": [width] * len(ids), "ids": coded}

    return map_batches(slim, encode, "doc_id bigint, n_tokens bigint, id_bytes int, ids binary", "words", leave)


def pack(docs: DataFrame, tokenizer_path: str, *, max_len: int = MAX_LEN, buckets: int = BUCKETS,
         token_budget: int = TOKEN_BUDGET, group_rows: int = GROUP_ROWS, leave: bool = False) -> DataFrame:
    """One row per sequence: doc_id, piece, first_token, n_tokens, bucket_len, batch_id, slot, id_bytes, ids.

    `ids` holds the sequence's token ids, little-endian unsigned integers of `id_bytes` bytes, without
    padding; `batch_arrays` pads the sequences of a batch to `bucket_len`.

    A document of more than `max_len` tokens is cut into pieces of `max_len` and a rest; no
    token is lost. An empty document is one sequence of 0 tokens. Rows of one bucket are
    numbered without gaps and cut into batches of `token_budget // bucket_len` sequences (at
    least one), so only the last batch of a bucket can be short. `batch_id` is unique within
    its bucket. Repeated documents and null ids are packed like any other row. `leave` frees the
    memo of words at the end of each task, at the price of learning words anew.
    """
    whole = store(encoded(docs, tokenizer_path, leave), "ids")
    last = F.greatest(F.ceil(F.col("n_tokens") / max_len) - 1, F.lit(0)).cast("int")
    pieces = (
        whole.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("first_token", F.col("piece").cast("bigint") * max_len)
        .withColumn("n_tokens", F.least(F.col("n_tokens") - F.col("first_token"), F.lit(max_len).cast("bigint")))
        .withColumn("ids", F.substring("ids", (F.col("first_token") * F.col("id_bytes") + 1).cast("int"), (F.col("n_tokens") * F.col("id_bytes")).cast("int")))
    )
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    borders = bucket_borders(histogram, buckets) or [max_len]
    bucket = F.lit(borders[-1])
    for b in reversed(borders[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, b).otherwise(bucket)
    groups = max(1, -(-sum(histogram.values()) // group_rows))
    placed = pieces.select("*", bucket.cast("bigint").alias("bucket_len"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).alias("part"))
    sizes = placed.groupBy("bucket_len", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("bucket_len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_len", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket_len", "part").orderBy("doc_id", "piece", "n_tokens")
    place = F.col("offset") + F.row_number().over(within) - 1
    room = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(token_budget) / F.greatest("bucket_len", F.lit(1).cast("bigint"))))
    return (
        placed.join(offsets, ["bucket_len", "part"]).withColumn("place", place)
        .select("doc_id", "piece", "first_token", "n_tokens", "bucket_len",
                F.floor(F.col("place") / room).alias("batch_id"), F.pmod(F.col("place"), room).alias("slot"), "id_bytes", "ids")
    )


def batch_arrays(sequences: list, pad_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of the packed rows of one batch: a row per slot, padded to `bucket_len` with `pad_id`."""
    rows = sorted(sequences, key=lambda r: r["slot"])
    width = rows[0]["bucket_len"] if rows else 0
    ids, mask = np.full((len(rows), width), pad_id, np.int64), np.zeros((len(rows), width), bool)
    for k, r in enumerate(rows):
        ids[k, :r["n_tokens"]] = np.frombuffer(r["ids"], f"<u{r['id_bytes']}")
        mask[k, :r["n_tokens"]] = True
    return ids, mask
