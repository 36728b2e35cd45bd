"""Token-id files of independent zstandard frames with a trailing seek table and a checksum for each frame.

A file holds documents in ascending doc_id order, each in a frame of its own (ids as little-endian unsigned 16-bit
numbers where the vocabulary allows, else 32-bit), then two skippable frames: the directory (magic 0x184D2A5D: width of
an id, then the doc_ids as 64-bit numbers) and the seek table of the public seekable format (magic 0x184D2A5E: for each
frame its compressed size, its size and the low 32 bits of the XXH64 of its content, then the number of frames, a
descriptor byte 0x80 and the magic 0x8F92EAB1). A reader fetches the footer, the table and the directory, and then
decompresses only the frames of the documents asked for, checking each. Plain zstandard readers see the ids as one stream.

`write` deals the documents to shards of about `shard_bytes` bytes of text by ranges of (doc_id, a hash of the text), so that
rows without doc_id or with the same one can be split too. The ranges' bounds come from a sample of doc_ids, hashes and lengths,
of `SAMPLED` rows or 8 for each shard if that is more. Each document is compressed where it is read; its frame goes to its
shard's task, which writes one file under a temporary name that is renamed when whole, so that a retried task leaves no torn
file. The manifest (shard, path, first and last doc_id, documents, tokens) is a Parquet table beside the files.

Defined cases: a null text is an empty one, whose only id is the end id; repeated rows are written each, ordered by a hash of
their texts; rows without doc_id come first; other columns are ignored; an empty table writes no files and reads back as no rows.
"""

from __future__ import annotations

import bisect
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspark.llm.common import save, work_dir
from inkspark.llm.tokens import batches_of, encoder

# Fixed values of the public seekable format.
SKIPPABLE_SEEK, SKIPPABLE_DIRECTORY, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1, 0x80
_HEAD, _ENTRY, _FOOT = struct.Struct("<II"), struct.Struct("<III"), struct.Struct("<IBI")
#: How many rows the shards' bounds are taken from, 24 bytes each on the driver.
SAMPLED = 20_000
#: doc_id in a file's directory for a row without one.
NO_ID = -(1 << 63)


def frame(ids: np.ndarray, width: int, compressor: zstandard.ZstdCompressor) -> tuple[bytes, int, int]:
    """A document's compressed frame, its size before and its checksum."""
    raw = ids.astype(f"<u{width}").tobytes()
    return compressor.compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


def trailer(doc_ids: list[int], width: int, entries: list[tuple[int, int, int]]) -> bytes:
    """The directory and the seek table for frames already written."""
    directory = struct.pack("<I", width) + np.array(doc_ids, "<i8").tobytes()
    table = b"".join(_ENTRY.pack(*e) for e in entries) + _FOOT.pack(len(entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
    return _HEAD.pack(SKIPPABLE_DIRECTORY, len(directory)) + directory + _HEAD.pack(SKIPPABLE_SEEK, len(table)) + table


class Reader:
    """Random access to one file, given as an open binary file that can seek."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - _FOOT.size)
        frames, _, magic = _FOOT.unpack(file.read(_FOOT.size))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the file")
        table = frames * _ENTRY.size
        file.seek(size - _FOOT.size - table)
        self.entries = np.frombuffer(file.read(table), "<u4").reshape(frames, 3)
        directory = 4 + 8 * frames
        file.seek(size - _FOOT.size - table - _HEAD.size - directory)
        content = file.read(directory)
        self.width = struct.unpack("<I", content[:4])[0]
        self.doc_ids = np.frombuffer(content[4:], "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        self.decompressor = zstandard.ZstdDecompressor()

    def run(self, first: int, last: int) -> Iterator[np.ndarray]:
        """The ids of the documents in the frames from first to before last, read at once; ValueError if a frame hasn't its checksum."""
        self.file.seek(int(self.starts[first]))
        raw = memoryview(self.file.read(int(self.starts[last] - self.starts[first])))
        for place in range(first, last):
            at = int(self.starts[place] - self.starts[first])
            size, content, checksum = self.entries[place].tolist()
            ids = self.decompressor.decompress(raw[at : at + size], max_output_size=content)
            if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {place} is damaged")
            yield np.frombuffer(ids, f"<u{self.width}")

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document in a frame."""
        return next(self.run(place, place + 1))

    def runs(self, most: int) -> Iterator[tuple[int, int]]:
        """All frames in runs of about `most` compressed bytes."""
        first = 0
        while first < len(self.doc_ids):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + most, "right")) - 1)
            yield first, last
            first = last

    def document(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with this doc_id."""
        low, high = np.searchsorted(self.doc_ids, [doc_id, doc_id + 1])
        return [self.ids(i) for i in range(low, high)]


def _frames(path: str, end_id: int, width: int, bounds: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, compressor = encoder(path), zstandard.ZstdCompressor(level=1, write_content_size=True)
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for first, last, texts in batches_of(batch["text"].to_pylist(), 8_000_000):
                made = [frame(np.append(x, np.uint32(end_id)), width, compressor) for x in enc.ids(texts)]
                some = [NO_ID if d is None else d for d in ids[first:last]]
                ties = batch["tie"][first:last].to_pylist()
                shard = [bisect.bisect_right(bounds, x) for x in zip(some, ties, strict=True)]
                columns = [pa.array(shard, pa.int32()), pa.array(some, pa.int64()), pa.array(ties, pa.int64()), pa.array([m[0] for m in made], pa.binary())]
                columns += [pa.array([m[i] for m in made], pa.int64()) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "tie", "frame", "size", "checksum"])

    return run


def _written(root: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        out, shard, doc_ids, entries, temp = None, None, [], [], ""

        def close() -> tuple:
            out.write(trailer(doc_ids, width, entries))
            out.close()
            fs.move(temp, f"{base}/shard-{shard:06d}.zst")
            return shard, f"shard-{shard:06d}.zst", doc_ids[0], doc_ids[-1], len(doc_ids), sum(e[1] for e in entries) // width

        done = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if out is not None:
                        done.append(close())
                    shard, doc_ids, entries = row["shard"], [], []
                    temp = f"{base}/.{shard:06d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp)
                out.write(row["frame"])
                doc_ids.append(row["doc_id"])
                entries.append((len(row["frame"]), row["size"], row["checksum"]))
        if out is not None:
            done.append(close())
        kinds = [("shard", pa.int32()), ("file", pa.string()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return run


def _bounds(rows: DataFrame, shard_bytes: int, shards: int | None) -> list[tuple[int, int]]:
    """(doc_id, tie) at which the second and each later shard begins, so that they have about equal bytes."""
    spark, n = rows.sparkSession, rows.count()
    keys = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "tie", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("bytes"))
    size = SAMPLED
    while True:
        share = min(1.0, size / max(n, 1))
        drawn = F.pmod(F.xxhash64("doc_id", "tie", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))
        some = np.array([tuple(r) for r in keys.where(drawn).collect()], np.int64).reshape(-1, 3)  # `size` rows of three numbers
        wanted = shards or max(-(-int(some[:, 2].sum() / share) // shard_bytes), min(n, spark.sparkContext.defaultParallelism))
        if shards or 8 * wanted <= size or share == 1.0:
            break
        size = 8 * wanted
    if wanted < 2 or not len(some):
        return []
    some = some[np.lexsort((some[:, 1], some[:, 0]))]
    before = np.cumsum(some[:, 2]) - some[:, 2]
    at = np.unique(np.searchsorted(before, before[-1] * np.arange(1, wanted) / wanted))
    return sorted({(int(some[i, 0]), int(some[i, 1])) for i in at})


def write(docs: DataFrame, root: str, tokenizer: str, end_id: int = 2, shards: int | None = None, shard_bytes: int = 64 << 20) -> DataFrame:
    """Write the documents' ids below root, in so many shards or in ones of about `shard_bytes` of text, and give the manifest."""
    width = 2 if max(encoder(tokenizer).size, end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), "text")
    bounds = _bounds(rows, shard_bytes, shards)
    frames = rows.mapInArrow(_frames(tokenizer, end_id, width, bounds), "shard int, doc_id long, tie long, frame binary, size long, checksum long")
    dealt = frames.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "tie").drop("tie")
    return save(dealt.mapInArrow(_written(root, width), "shard int, file string, first_doc long, last_doc long, n_docs long, n_tokens long"), f"{root}/manifest")


def _read(root: str, only: frozenset[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{base}/{row['file']}") as file:
                    reader = Reader(file)
                    starts = row["before"] + np.concatenate([[0], np.cumsum(reader.entries[:, 1] // reader.width, dtype=np.int64)])
                    wanted = [(i, i + 1) for i, d in enumerate(reader.doc_ids.tolist()) if d in only] if only is not None else reader.runs(1 << 20)
                    for first, last in wanted:
                        rows = []
                        for place, found in enumerate(reader.run(first, last), first):
                            doc = int(reader.doc_ids[place])
                            rows.append((None if doc == NO_ID else doc, int(starts[place]), len(found), found.astype("<u4").tobytes()))
                        yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def read(spark: SparkSession, root: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of the documents in the files below root.

    With doc_ids, only files whose range holds one are opened and only those documents are decompressed.
    """
    manifest = spark.read.parquet(f"{root}/manifest")
    ordered = manifest.withColumn("before", F.expr("sum(n_tokens) OVER (ORDER BY shard) - n_tokens"))
    only = None if doc_ids is None else frozenset(doc_ids)
    if only is not None:
        near = sorted(only)
        hit = F.udf(lambda low, high: bisect.bisect_right(near, high) > bisect.bisect_left(near, low), "boolean")
        ordered = ordered.where(hit("first_doc", "last_doc"))
    files = ordered.select("file", "before").repartition(max(1, spark.sparkContext.defaultParallelism * 4), "file")
    return files.mapInArrow(_read(root, only), "doc_id long, start long, n_tokens long, ids binary")


def crc32_of_ids(rows: DataFrame) -> DataFrame:
    """Without the ids but with ids_crc32, the unsigned CRC-32 of them as unsigned 32-bit numbers."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the documents to token files in a shared folder and read them all back."""
    root = work_dir(docs.sparkSession, "tokens")
    write(docs, root, tokenizer, end_id)
    return crc32_of_ids(read(docs.sparkSession, root))
