"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without white space (space, tab to carriage return) at its ends, A-Z lower-cased. A `LineRuns`
store holds the keys of at least `min_chars` code points as runs, sorted and bucketed by a 128-bit hash of the key. Each new
batch is written as a sorted arrival and merge-anti-joined with the runs: keys that no run holds become a run of level 0,
with the number of documents that hold them and the largest doc_id among them, so that a key is in one run only; keys that
a run holds become an update, with the same numbers. All these joins are merge joins of tables bucketed and sorted alike, without
a shuffle. When a level has `fanout` runs they are merged into one run of the next level; so are the updates among themselves.
`dedup_lines` adds the runs and updates up and drops the lines of every key found in `min_docs` documents, except in the largest doc_id.

Defined cases: a null or empty text is one empty line; every row counts as one document, so repeated rows count
again; all equal lines of the keeping document stay; a row without doc_id is kept whole and counts for nothing;
an empty table gives an empty result; columns other than text are carried along untouched, whatever their names (a result
whose name one of them has gets `_` added to its name).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from inkspark.llm.common import column, free, partitions, release, remove, save, work_dir

WHITE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))
_PAIR = struct.Struct("<qq")


def line_keys(text: bytes, min_chars: int) -> list[tuple[int, int] | None]:
    """The hash of each line's key, or None for one that is too short to count."""
    out: list[tuple[int, int] | None] = []
    for line in text.translate(_LOWER).split(b"\n"):
        key = line.strip(WHITE)
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
            out.append(None)
        else:
            out.append(_PAIR.unpack(xxhash.xxh3_128_digest(key)))
    return out


def _keys_of(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            ids, high, low = [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                if doc is None or not text.is_valid:
                    continue
                keys = {x for x in line_keys(text.as_buffer().to_pybytes(), min_chars) if x}
                ids += [doc] * len(keys)
                high += [x[0] for x in keys]
                low += [x[1] for x in keys]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (high, low, ids)], names=["h1", "h2", "doc_id"])

    return run


def keys_of(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row (h1, h2, doc_id) for each distinct key of each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_keys_of(min_chars), "h1 long, h2 long, doc_id long")


class LineRuns:
    """Levelled runs and updates (h1, h2, n_docs, max_doc): tables bucketed and sorted by the hash, with one row for a hash."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = 4, buckets: int | None = None):
        self.spark, self.root, self.fanout = spark, root, fanout
        self.buckets = buckets or partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.updates: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.root}/{name}").format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.root}/{name}")

    def runs(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def close(self) -> None:
        """Drop all runs and updates."""
        for name in self.runs() + self.updates:
            self._drop(name)
        self.levels, self.updates = [[]], []

    def merged(self, names: list[str] | None = None) -> DataFrame:
        """The given runs and updates (all of them by default) as one table with a row for each key."""
        names = self.runs() + self.updates if names is None else names
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, max_doc long")
        rows = self.spark.table(names[0])
        for name in names[1:]:  # both sides are sorted and bucketed alike: a merge join without a shuffle
            other = self.spark.table(name).select("h1", "h2", F.col("n_docs").alias("more_docs"), F.col("max_doc").alias("other_doc"))
            n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more_docs", F.lit(0))
            rows = rows.join(other, ["h1", "h2"], "full").select("h1", "h2", n_docs.alias("n_docs"), F.greatest("max_doc", "other_doc").alias("max_doc"))
        return rows

    def unseen(self, keys: DataFrame, names: list[str] | None = None) -> DataFrame:
        """The rows whose keys the given runs (all of them by default) don't hold."""
        for name in self.runs() if names is None else names:
            keys = keys.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Add a batch: its new keys as a run of level 0, the others as an update; then merge what is full."""
        arrival = self._write(keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc")))
        if self.runs():
            rows = self.spark.table(arrival)
            new = self._write(self.unseen(rows))
            self.updates.append(self._write(self.unseen(rows, [new])))
            self._drop(arrival)
            arrival = new
        self.levels[0].append(arrival)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1
        if len(self.updates) >= self.fanout:
            self.updates = [self._merge(self.updates)]

    def _merge(self, names: list[str]) -> str:
        made = self._write(self.merged(names))
        for name in names:
            self._drop(name)
        return made

    def compact(self, level: int) -> None:
        full, self.levels[level] = self.levels[level], []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(self._merge(full))

    def repeated(self, min_docs: int) -> DataFrame:
        """The keys of at least `min_docs` documents, with the largest doc_id holding each."""
        return self.merged().where(F.col("n_docs") >= min_docs).select("h1", "h2", "max_doc")


def _rewrite(min_chars: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drops in zip(batch["text"].cast(pa.binary()), batch["drops"], strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                lines = raw.count(b"\n") + 1
                gone = 0
                if drops.is_valid and len(drops):
                    out = {(x["h1"], x["h2"]) for x in drops.as_py()}
                    stay = [x for x, k in zip(raw.split(b"\n"), line_keys(raw, min_chars), strict=True) if k not in out]
                    gone, raw = lines - len(stay), b"\n".join(stay)
                n_lines.append(lines)
                n_dropped.append(gone)
                kept.append(hashlib.sha256(raw).hexdigest() if digest else raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch["others"], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["others", "n_lines", "n_dropped", "kept"])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 4, digest: bool = False) -> DataFrame:
    """The documents' columns without text, then n_lines, n_dropped and `kept`: the text that stays, or its SHA-256 with `digest`.

    The keys go into the runs in `batches` ranges of doc_id, as arrivals would.
    """
    spark = docs.sparkSession
    root = work_dir(spark, "lines")
    keys = save(keys_of(docs, min_chars), f"{root}/keys")
    low, high = keys.agg(F.min("doc_id"), F.max("doc_id")).first()
    runs = LineRuns(spark, root, fanout)
    try:
        if low is not None:
            step = (high - low) // batches + 1
            for i in range(batches):
                runs.add(keys.where(F.col("doc_id").between(low + i * step, low + (i + 1) * step - 1)))
        # both sides are shuffled, so that a line of very many documents can be split over tasks
        hot = save(runs.repeated(min_docs), f"{root}/repeated").hint("merge")
    finally:
        runs.close()
    lost = keys.join(hot, ["h1", "h2"]).where(F.col("doc_id") != F.col("max_doc"))
    lost = lost.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))
    names = [c for c in docs.columns if c != "text"]
    own = docs.select(F.struct(*[column(c) for c in names]).alias("others"), "text", F.col("doc_id").cast("long").alias("doc_id"))
    # rows without doc_id lose nothing; they are spread
    own = own.withColumn("part", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    joined = own.join(lost.withColumn("part", F.lit(0).cast("long")), ["doc_id", "part"], "left").select("others", "text", "drops")
    schema = StructType([joined.schema["others"], StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept", StringType())])
    rows = joined.mapInArrow(_rewrite(min_chars, digest), schema)
    results = ["n_lines", "n_dropped", "kept"]
    return rows.select(*[F.col("others").getField(c).alias(c) for c in names], *[F.col(c).alias(free(names, c)) for c in results])


def without_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """The documents with what stays of their texts, and n_chars, where they have it, after it; all other columns as they are."""
    rows = dedup_lines(docs, **settings)
    kept = column(free([c for c in docs.columns if c != "text"], "kept"))
    return rows.select(*[kept.alias(c) if c == "text" else F.char_length(kept).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else column(c) for c in docs.columns])
