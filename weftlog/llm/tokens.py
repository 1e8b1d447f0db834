"""Token counts of whole texts, huge ones by overlapping chunks.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring chunks are
spliced at a position where both have a pre-token border and agree on the tokens around it.
A pre-tokenizer reads from left to right and a pre-token is encoded on its own, so from a
shared border on both chunks see the same text in the same state: what the left chunk has
before it and the right chunk after it is what the whole text has. Borders close to a cut
are not trusted. If the overlap holds no such border it is doubled, up to the whole chunk;
a chunk without any border is joined with as much text again, so that a text without borders
is read some twice in all.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm import bpe
from weftlog.llm.base import map_batches

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
# Borders nearer to a cut than this are not used, and this many tokens must agree on each side.
GUARD_CHARS = 64
AGREE_TOKENS = 4


class Chunk:
    """One encoded chunk: token starts in the text, ids, and which starts are pre-token borders."""

    def __init__(self, tok, text: str, lo: int, hi: int):
        enc = tok.encode(text[lo:hi], add_special_tokens=False)
        self.lo, self.hi = lo, hi
        self.ids = enc.ids
        self.starts = [lo + a for a, _ in enc.offsets]
        self.words = enc.word_ids

    def border(self, i: int) -> bool:
        """Whether token i starts a pre-token at a position no earlier token reaches."""
        if i == 0:
            return True
        a, b = self.words[i - 1], self.words[i]
        return (a is None or b is None or a != b) and self.starts[i] > self.starts[i - 1]


def common_border(left: Chunk, right: Chunk, guard: int, agree: int) -> tuple[int, int] | None:
    """Token numbers (left, right) of a border both chunks share inside the overlap, or None."""
    lo, hi = right.lo + guard, left.hi - guard
    for j in range(bisect_left(right.starts, lo), len(right.starts)):
        p = right.starts[j]
        if p > hi:
            return None
        if not right.border(j):
            continue
        i = bisect_left(left.starts, p)
        if i >= len(left.starts) or left.starts[i] != p or not left.border(i):
            continue
        k = min(agree, sum(s <= hi for s in left.starts[i:i + agree]))
        same = left.ids[i:i + k] == right.ids[j:j + k] and left.starts[i:i + k] == right.starts[j:j + k]
        back = min(agree, i, sum(s >= lo for s in right.starts[max(0, j - agree):j]))
        if same and left.ids[i - back:i] == right.ids[j - back:j]:
            return i, j
    return None


def spliced(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
            guard: int = GUARD_CHARS, agree: int = AGREE_TOKENS) -> tuple[list[int], int, int]:
    """(ids, chunks, widenings) of `text`; the ids equal those of one call on the whole text."""
    out: list[int] = []
    left = Chunk(tok, text, 0, min(len(text), chunk))
    first, chunks, widened = 0, 1, 0
    while left.hi < len(text):
        width = overlap
        while True:
            lo = max(left.lo, left.hi - width)
            grown = chunk if lo > left.lo else max(chunk, left.hi - left.lo)
            right = Chunk(tok, text, lo, min(len(text), left.hi + grown))
            found = common_border(left, right, guard, agree) if lo > left.lo else None
            if found and found[0] >= first:
                out += left.ids[first:found[0]]
                left, first = right, found[1]
                chunks += 1
                break
            widened += 1
            if lo == left.lo:  # no border in the whole chunk: let it grow
                left = right
                break
            width *= 2
    return out + left.ids[first:], chunks, widened


def token_ids(path: str, texts: list[str]) -> list[bytes]:
    """Ids of each text as bytes of the memo's integer type; only long texts whose word borders prove
    nothing are cut into overlapping chunks."""
    return [ids for ids, _, _ in chunked_ids(path, texts, None)]


def chunked_ids(path: str, texts: list[str], chunk: int | None = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[bytes, int, int]]:
    """(ids, chunks, widenings) of each text; those of more than `chunk` characters go by overlapping chunks."""
    memo = bpe.word_memo(path)
    huge = [i for i, t in enumerate(texts) if len(t) > (chunk or CHUNK_CHARS)]
    if not chunk:
        huge = [i for i, ok in zip(huge, memo.proven([texts[i] for i in huge])) if not ok]
    rest = list(texts)
    for i in huge:
        rest[i] = ""
    out = [(ids, 1, 0) for ids in memo.encode(rest)]
    for i in huge:
        ids, chunks, widened = spliced(memo.tok, texts[i], chunk or CHUNK_CHARS, overlap)
        out[i] = (np.asarray(ids, dtype=memo.dtype).tobytes(), chunks, widened)
    return out


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = 2048, chunk_chars: int = CHUNK_CHARS,
                 overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks, n_widened per row of `docs` (doc_id, text; other columns
    are ignored). `n_chunks` counts the pieces a text was spliced of, `n_widened` the overlaps that had to grow.

    Null text counts as empty: 0 bytes, 0 tokens, 1 chunk. Repeated rows and null ids are kept as rows.
    Nothing moves between tasks; a worker holds one batch, its memo and two chunks.
    """
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"))

    def count(ids, texts, sizes):
        width = bpe.word_memo(tokenizer_path).width
        coded = chunked_ids(tokenizer_path, texts, chunk_chars, overlap_chars)
        n = [len(b) // width for b, _, _ in coded]
        return {"doc_id": ids, "n_bytes": sizes, "n_tokens": n, "over_limit": [x > limit for x in n],
                "n_chunks": [c for _, c, _ in coded], "n_widened": [w for _, _, w in coded]}

    return map_batches(slim, count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks int, n_widened int", "words")
