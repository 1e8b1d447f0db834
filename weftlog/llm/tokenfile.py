"""Token ids of documents in files of independent zstandard frames.

A file is a run of zstandard frames, each with a content checksum, then two skippable frames
that any zstandard reader steps over: the document directory and, last, the seek table of the
published seekable format (compressed size, size and checksum of each frame). A document
starts a frame; a long one takes several. A reader of some documents reads the two tables
from the end of the file and then only the frames it needs.

Files hold disjoint ascending ranges of doc_id, each in ascending order; null ids come first.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftlog.llm import bpe, tokens
from weftlog.llm.base import as_batch, file_system, map_batches, store, unique
from weftlog.session import scratch_path

# Fixed values of the published container formats.
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_DOCS = 0x184D2A5D
SEEKABLE_MAGIC = 0x8F92EAB1
DOCS_MAGIC = 0x57464431

FRAME_TOKENS = 1 << 20
FILE_BYTES = 64 << 20
LEVEL = 3
ENTRY = struct.Struct("<III")
DOC = struct.Struct("<qBIQ")  # id, is null, first frame, tokens


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)


def frames_of(ids: bytes, width: int, frame_tokens: int = FRAME_TOKENS) -> list[tuple[bytes, int, int]]:
    """(frame, size of its content, checksum) for one document; an empty one has no frame."""
    pack = _compressor()
    step = frame_tokens * width
    return [(pack.compress(part), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF)
            for part in (ids[i:i + step] for i in range(0, len(ids), step))]


class FileWriter:
    """Streams documents into one file; only the two tables are kept in memory."""

    def __init__(self, out, width: int):
        self.out, self.width, self.seek, self.docs, self.n, self.tokens = out, width, bytearray(), bytearray(), 0, 0

    def add(self, doc_id: int | None, n_tokens: int, frames: list[tuple[bytes, int, int]]) -> None:
        self.docs += DOC.pack(doc_id or 0, doc_id is None, len(self.seek) // ENTRY.size, n_tokens)
        for data, size, check in frames:
            self.out.write(data)
            self.seek += ENTRY.pack(len(data), size, check)
        self.n += 1
        self.tokens += n_tokens

    def close(self) -> None:
        body = bytes(self.docs) + struct.pack("<IBI", self.n, self.width, DOCS_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_DOCS, len(body)) + body)
        body = bytes(self.seek) + struct.pack("<IBI", len(self.seek) // ENTRY.size, 0x80, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body)


class FileReader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        end = source.size()
        count, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("the file does not end with a seek table")
        top = end - 9 - count * ENTRY.size
        self.frames = list(ENTRY.iter_unpack(self._at(top, count * ENTRY.size)))
        self.starts = np.concatenate([[0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)]).astype(np.int64)
        top -= 8
        n, self.width, magic = struct.unpack("<IBI", self._at(top - 9, 9))
        if magic != DOCS_MAGIC:
            raise ValueError("the file has no document directory")
        self.docs = list(DOC.iter_unpack(self._at(top - 9 - n * DOC.size, n * DOC.size)))

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def ids(self, k: int) -> bytes:
        """Ids of the k-th document, from its own frames only; a damaged frame raises."""
        last = self.docs[k + 1][2] if k + 1 < len(self.docs) else len(self.frames)
        parts = []
        for f in range(self.docs[k][2], last):
            packed, size, check = self.frames[f]
            part = self.unpack.decompress(self._at(int(self.starts[f]), packed), max_output_size=size)
            if len(part) != size or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {f} does not match its checksum")
            parts.append(part)
        return b"".join(parts)


def file_bounds(slim: DataFrame, file_bytes: int) -> np.ndarray:
    """Last ids of all files but the last, so that no range of ids holds much more than twice `file_bytes` of text.

    An id counts once for each mean size that its text takes up, rounded up: a range of n counts has at
    most n mean sizes, and there are at most twice as many counts as texts. A text that is larger than a
    file is one file with its neighbours at most. The sketch is small at any size.
    """
    total, rows = slim.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = -(-(total or 0) // file_bytes)
    if parts < 2:
        return np.empty(0, np.int64)
    counts = F.greatest(F.ceil(F.octet_length("text") / max(1, total // rows)), F.lit(1)).cast("int")
    weighed = slim.select(F.explode(F.array_repeat("doc_id", counts)).alias("doc_id"))
    cuts = weighed.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 10 * parts)).alias("p")).first()["p"]
    return np.unique(np.asarray(cuts or [], dtype=np.int64))


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, *, path: str | None = None,
                      file_bytes: int = FILE_BYTES, frame_tokens: int = FRAME_TOKENS) -> DataFrame:
    """Encode `docs` (doc_id, text) and write the files below `path`; returns the manifest
    (part, file, n_docs, n_tokens), one row per file, already written.

    Texts are encoded where they are read; only compressed frames move, straight to the file
    they belong to. A file is written under a fresh name by each attempt of a task, and the
    manifest names those of the attempts that counted, so retries leave no wrong file behind.
    Null text is an empty document (only the end id). Repeated ids stay separate documents,
    ordered by their content.
    """
    spark = docs.sparkSession
    folder = path or scratch_path(spark, "tokens")
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = file_bounds(slim, file_bytes)

    def encode(ids, texts):
        memo = bpe.word_memo(tokenizer_path)
        end = np.asarray([end_id], dtype=memo.dtype).tobytes()
        coded = [b + end for b in tokens.token_ids(tokenizer_path, texts)]
        return {
            "part": [0 if i is None else int(np.searchsorted(bounds, i, side="left")) for i in ids],
            "doc_id": ids, "n_tokens": [len(b) // memo.width for b in coded], "width": [memo.width] * len(ids),
            "crc": [zlib.crc32(b) for b in coded],
            "frames": [[{"data": d, "size": s, "checksum": c} for d, s, c in frames_of(b, memo.width, frame_tokens)] for b in coded],
        }

    frame = "array<struct<data:binary,size:bigint,checksum:bigint>>"
    coded = map_batches(slim, encode, f"part int, doc_id bigint, n_tokens bigint, width int, crc bigint, frames {frame}", "words")
    placed = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "n_tokens", "crc")
    fields = to_arrow_schema(StructType.fromDDL("part int, file string, n_docs bigint, n_tokens bigint"))

    def write(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        writer = part = name = stream = None

        def done():
            writer.close()
            stream.close()
            return as_batch({"part": [part], "file": [name], "n_docs": [writer.n], "n_tokens": [writer.tokens]}, fields)

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if writer:
                        yield done()
                    part = row["part"]
                    name = unique(f"part-{part:07d}") + ".zst"
                    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer = FileWriter(stream, row["width"])
                writer.add(row["doc_id"], row["n_tokens"], [(f["data"], f["size"], f["checksum"]) for f in row["frames"]])
        if writer:
            yield done()

    files = placed.mapInArrow(write, "part int, file string, n_docs bigint, n_tokens bigint")
    return store(files.withColumn("folder", F.lit(folder)), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files.

    `start` counts the ids of all documents before it. The manifest has one row per file, so
    the running total over files is a small window; documents never meet in one task.
    """
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, root = file_system(row["folder"])
                with fs.open_input_file(f"{root}/{row['file']}") as source:
                    reader = FileReader(source)
                    at, out = row["before"], []
                    for k, (doc_id, missing, _, n) in enumerate(reader.docs):
                        ids = np.frombuffer(reader.ids(k), dtype=f"<u{reader.width}").astype("<u4")
                        if len(ids) != n:
                            raise ValueError("the directory and the frames disagree")
                        out.append((None if missing else doc_id, at, n, zlib.crc32(ids.tobytes())))
                        at += n
                        if len(out) == 10_000 or k + 1 == len(reader.docs):
                            yield as_batch(dict(zip(fields.names, zip(*out))), fields)
                            out = []

    files = placed.repartition(max(1, manifest.count()), "part")
    return files.mapInArrow(read, schema)
