"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is found in a document if at least 75 % of the item's distinct five-word shingles stand in it. The items are
partitioned by size (powers of two of their number of shingles). An item's signature is its bottom-k MinHash values,
the k smallest fingerprints of its shingles, with k = n - ceil(0.75 n) + 1: a document that lacks a quarter of the
shingles at most has one of any k of them, so no match is lost. Each partition is one sorted index of signature
values with an upper bound; a document, however long, looks up those of its distinct shingles that are within the
bound, and skips the partitions whose items all need more shingles than it has. Every candidate is verified by counting the
item's shingles in the document's full set.

The items' shingles are made on the executors and written. A hash deals the items to blocks of about `block_values` shingle
values (8 bytes each) at most; one block after the other goes to the driver and, as an index, to the executors, whatever the
benchmark's size. Each block is searched in all documents in one pass without a shuffle.

Defined cases: a null or empty text, or one without words, has no shingles and matches nothing; one of fewer than
five words has its whole sequence as its only shingle, as items do; items with equal sets all match; repeated rows
each give their matches; rows without an id match with a null id; other columns are ignored by `contaminated` and kept, whatever
their names, by `drop_contaminated`, which keeps rows without doc_id; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm import shingles
from inkspark.llm.common import release, save, work_dir

SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


class ItemIndex:
    """Signatures of items by size partition, and the items' full sets."""

    def __init__(self, ids: list[int | None], sets: list[np.ndarray], num: int, den: int):
        self.ids, self.sets, self.num, self.den = ids, sets, num, den
        parts: dict[int, list[tuple[int, int]]] = {}
        fewest: dict[int, int] = {}
        for i, s in enumerate(sets):
            size, least = len(s).bit_length(), -(-num * len(s) // den)
            parts.setdefault(size, []).extend((int(v), i) for v in s[: len(s) - least + 1])
            fewest[size] = min(least, fewest.get(size, least))
        #: (fewest shingles that an item of the partition needs, sorted signature values, the items' places)
        self.parts = []
        for size in sorted(parts):
            entries = sorted(parts[size])
            self.parts.append((fewest[size], np.array([v for v, _ in entries], np.uint64), np.array([i for _, i in entries], np.int64)))

    def matches(self, values: np.ndarray) -> list[tuple[int, int]]:
        """(item's place, shared shingles) of all items contained in a document's sorted distinct shingles."""
        found: set[int] = set()
        for least, signature, owner in self.parts:
            if least > len(values):  # the partitions come by size
                break
            own = values[: np.searchsorted(values, signature[-1], "right")]
            low, high = np.searchsorted(signature, own, "left"), np.searchsorted(signature, own, "right")
            for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True):
                found.update(owner[a:b].tolist())
        out = []
        for i in sorted(found):
            shared = len(np.intersect1d(self.sets[i], values, assume_unique=True))
            if self.den * shared >= self.num * len(self.sets[i]):
                out.append((i, shared))
        return out


def _search(index: ItemIndex, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            docs, items, sizes, shared = [], [], [], []
            for doc, values in zip(batch["doc_id"].to_pylist(), shingles.shingle_sets(batch["text"], width), strict=True):
                for i, n in index.matches(values):
                    docs.append(doc)
                    items.append(index.ids[i])
                    sizes.append(len(index.sets[i]))
                    shared.append(n)
            columns = [pa.array(x, pa.int64()) for x in (docs, items, sizes, shared)]
            part = pa.array([a / b for a, b in zip(shared, sizes, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*columns, part], names=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

    return run


def _item_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingles.shingle_sets(batch["text"], width))
            columns = [batch["item_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "n", "shingles"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 75, block_values: int = 4_000_000) -> DataFrame:
    """One row for each document and benchmark item (item_id, text) that it contains."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    made = save(named.mapInArrow(_item_sets(width), "item_id long, n long, shingles binary").where("n > 0"), f"{work_dir(spark, 'items')}/sets")
    total = made.agg(F.sum("n")).first()[0] or 0
    blocks = 1 if total <= block_values else -(-2 * total // block_values)
    block = F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks))
    out = spark.createDataFrame([], SCHEMA)
    for i in range(blocks):
        rows = made.where(block == i).orderBy("item_id").collect() if total else []
        if rows:
            index = ItemIndex([r["item_id"] for r in rows], [np.frombuffer(r["shingles"], np.uint64) for r in rows], percent, 100)
            out = out.unionByName(texts.mapInArrow(_search(index, width), SCHEMA))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents that contain no benchmark item."""
    gone = contaminated(docs, items, **settings).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
