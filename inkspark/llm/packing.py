"""Best-fit packing of tokenised documents by exact-complement hashing.

Documents are cut into pieces of at most `length` tokens (only longer ones are). What matters for packing is how many
pieces there are of each length: a table of at most `length` counts, whatever the corpus's size. `plan` works on it.
From the longest length down it starts a sequence with a piece, looks the gap up in indexes of the single lengths, pair sums and
triple sums of what is available and consumes the combination that fills the gap exactly, as many times at once as the
counts allow. If none does, the longest piece that fits is added first. Sequences that can't be filled exactly are
residuals: their pieces go, best fit first, into the smallest gaps that hold them.

Every piece has a rank among those of its length, by task and order of arrival in a written table; patterns take
intervals of ranks, so that each piece finds its sequence and place by a search in a table of bounded size, on the
executors. No piece is collected or moved.

Defined cases: a null text is an empty one, whose only token is the end id; rows without doc_id and repeated rows are
packed as any other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm.common import save, work_dir
from inkspark.llm.tokens import batches_of, encoder


def _bits(places) -> int:
    return sum(1 << n for n in places)


class _Available:
    """Counts by length, indexed by the sums of one, two and three lengths.

    An index has a bit for each sum. Its mirror image, shifted to a gap, has a bit for each length whose complement to the
    gap is a sum, so that the lengths that begin a combination filling a gap come from one intersection.
    """

    def __init__(self, counts: dict[int, int]):
        self.counts = {n: c for n, c in counts.items() if c}
        self.top = 3 * max(self.counts, default=0)
        self._index()

    def _index(self) -> None:
        self.lengths = sorted(self.counts, reverse=True)
        self.singles = _bits(self.lengths)
        self.pairs = self.triples = 0
        for n in self.lengths:
            self.pairs |= self.singles << n
        for n in self.lengths:
            self.triples |= self.pairs << n
        self.mirrored_singles, self.mirrored_pairs = self._mirrored(self.singles), self._mirrored(self.pairs)
        self.stale = 0

    def _mirrored(self, bits: int) -> int:
        return int(format(bits, f"0{self.top + 1}b")[::-1], 2)

    def _beginnings(self, gap: int, mirrored: int) -> int:
        """The lengths whose complement to the gap is in the mirrored index."""
        return self.singles & (mirrored >> (self.top - gap)) & ((1 << gap) - 1)

    def take(self, pattern: Counter, times: int) -> None:
        for n, k in pattern.items():
            self.counts[n] -= k * times
            if not self.counts[n]:
                del self.counts[n]
                self.stale += 1
        if self.stale > 64 or not self.counts:
            self._index()

    def has(self, need: Counter) -> bool:
        return all(self.counts.get(n, 0) >= k for n, k in need.items())

    def _pair(self, gap: int, held: Counter, most: int) -> Counter | None:
        """Two available lengths of at most `most` that fill the gap, the longest first."""
        some = self._beginnings(gap, self.mirrored_singles) & ((1 << (most + 1)) - 1)
        while some:
            a = some.bit_length() - 1
            if 2 * a < gap:
                return None
            fill = Counter([a, gap - a])
            if self.has(held + fill):
                return fill
            some ^= 1 << a
        return None

    def exact(self, gap: int, held: Counter) -> Counter | None:
        """One to three lengths that fill the gap and are available besides what is held."""
        if gap > self.top:
            return None
        if self.singles >> gap & 1 and self.has(held + Counter([gap])):
            return Counter([gap])
        if self.pairs >> gap & 1 and (fill := self._pair(gap, held, gap)):
            return fill
        if self.triples >> gap & 1:
            some = self._beginnings(gap, self.mirrored_pairs)
            while some:
                a = some.bit_length() - 1
                if 3 * a < gap:
                    return None
                if self.has(held + Counter([a])) and (fill := self._pair(gap - a, held + Counter([a]), a)):
                    return fill + Counter([a])
                some ^= 1 << a
        return None

    def longest(self, gap: int, held: Counter) -> int | None:
        return next((n for n in self.lengths if n <= gap and self.counts.get(n, 0) > held[n]), None)


def plan(counts: dict[int, int], length: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns ((length, pieces), ...) with the number of sequences of each, using all pieces up."""
    free = _Available(counts)
    patterns: list[tuple[int, Counter]] = []
    rest: dict[int, int] = {}
    while free.counts:
        start = max(free.counts)
        held = Counter([start])
        gap = length - start
        while gap:
            fill = free.exact(gap, held)
            if fill is None and (n := free.longest(gap, held)):
                fill = Counter([n])
            if fill is None:
                break
            held += fill
            gap -= sum(n * k for n, k in fill.items())
        times = min(free.counts[n] // k for n, k in held.items())
        if gap and held.total() == 1:
            rest[start] = rest.get(start, 0) + times
        else:
            patterns.append((times, held))
        free.take(held, times)
    return _best_fit(patterns, rest, length)


def _best_fit(patterns: list[tuple[int, Counter]], rest: dict[int, int], length: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Add residual pieces, longest first, to the open sequences with the smallest gap that holds them."""
    done = [(t, p) for t, p in patterns if sum(n * k for n, k in p.items()) == length]
    open_: dict[int, list[tuple[int, Counter]]] = {}
    for t, p in patterns:
        if gap := length - sum(n * k for n, k in p.items()):
            open_.setdefault(gap, []).append((t, p))
    for n in sorted(rest, reverse=True):
        left = rest[n]
        while left:
            gap = min((g for g, some in open_.items() if g >= n and some), default=None)
            if gap is None:
                t, p, gap = left, Counter(), length
            else:
                t, p = open_[gap].pop()
            some = min(t, left)
            if t > some and p:
                open_[gap].append((t - some, p))
            new = p + Counter([n])
            left -= some
            if gap - n:
                open_.setdefault(gap - n, []).append((some, new))
            else:
                done.append((some, new))
    done += [x for some in open_.values() for x in some]
    return [(t, tuple(sorted(p.items(), reverse=True))) for t, p in done]


class Places:
    """Where the pieces of each length and rank go: sequence number and offset."""

    def __init__(self, patterns: list[tuple[int, tuple[tuple[int, int], ...]]]):
        used: Counter = Counter()
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        base = 0
        for times, pattern in patterns:
            at = 0
            for n, k in pattern:
                rows.setdefault(n, []).append((used[n], k, base, at))
                used[n] += k * times
                at += n * k
            base += times
        self.sequences = base
        self.rows = {n: np.array(x, np.int64) for n, x in rows.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            table = self.rows[n]
            row = table[np.searchsorted(table[:, 0], ranks[own], "right") - 1]
            past = ranks[own] - row[:, 0]
            sequence[own] = row[:, 2] + past // row[:, 1]
            offset[own] = row[:, 3] + past % row[:, 1] * n
        return sequence, offset


#: Pieces that a task places at least (about 1 MB): fewer would only make many small files, each with processes that set its mode.
TASK_PIECES = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def _tokenised(path: str, length: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen: Counter = Counter()
        enc = encoder(path)
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for first, last, texts in batches_of(batch["text"].to_pylist()):
                rows = []
                for doc, found in zip(ids[first:last], enc.ids(texts), strict=True):
                    tokens = np.append(found, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(tokens), length)):
                        part = tokens[start : start + length]
                        raw = part.tobytes()
                        rows.append((doc, piece, start, len(part), zlib.crc32(raw), task, seen[len(part)], raw))
                        seen[len(part)] += 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns[: 7 + keep_ids], names=names[: 7 + keep_ids])

    return run


def _placed(places: Places, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch["length"].to_numpy(), batch["rank"].to_numpy() + batch["before"].to_numpy())
            columns = [batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset, and the ids if asked for."""
    root = work_dir(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = PIECES + ", ids binary" * keep_ids
    pieces = save(rows.mapInArrow(_tokenised(tokenizer, length, end_id, keep_ids), schema), f"{root}/pieces")
    held = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `length` rows
    places = Places(plan(counts, length))
    before = held.select("task", "length", (F.expr("sum(n) OVER (PARTITION BY length ORDER BY task)") - F.col("n")).alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    placed = pieces.join(before.hint("merge"), ["task", "length"])
    if not keep_ids:  # else rows are large
        placed = placed.coalesce(max(1, sum(counts.values()) // TASK_PIECES))
    return placed.mapInArrow(_placed(places, names), out)


def fill(pieces: DataFrame) -> DataFrame:
    """sequence_id and ids: the packed sequences of a `pack(..., keep_ids=True)` result, pieces in order of their offset."""
    joined = F.expr("aggregate(array_sort(collect_list(struct(offset, ids))), cast('' as binary), (a, x) -> a || x.ids)")
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
