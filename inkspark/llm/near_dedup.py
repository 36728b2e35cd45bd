"""MinHash near-duplicate detection with bottom-k sketches of one hash function.

A document's set is its distinct five-word shingles (`shingles.py`); two documents are linked if
100 * |intersection| >= 75 * |union|. The steps:

1. One pass over the texts makes each set's size, its 128-bit fingerprint and its bottom-k sketch, the k smallest
   shingle fingerprints. Documents with equal sets form a class, represented by its smallest doc_id.
2. Inverted lists of the retained values. Two linked documents share at least t of k retained values (t so low that a
   link is missed with a chance below `MISS`; for sets within the sketch the bound is exact), so each needs to enter
   only its k - t + 1 rarest values: values of passages that everybody has come last and seldom enter.
3. Lists of up to `small` classes give their pairs; pairs pass the size bound and the estimate of the union's sketch,
   and exact Jaccard over the full sets of both texts verifies them.
4. Longer lists are joined into clusters of the documents that share them. A cluster is compared exactly, in blocks of
   about `block_shingles` shingles or `block_docs` documents: first every block with the cluster's most typical document, then the blocks of
   those that aren't linked with it against all blocks. A task gets two blocks, whatever the cluster's size, and emits
   only links that join separate groups, fewer than it has documents; it never emits all pairs.
5. Connected components of the classes over the links by min-label propagation with pointer jumping, each round written
   out. Only then the documents look their class's component up: copies never enter the pairs, links or components.

Joins on a value, cluster, class or node that very many rows may share go through `common.lookup`: these few keys are broadcast.

Defined cases: a null or empty text, or one without words, has an empty set and no links (its own component); fewer
than five words make one shingle; repeated rows and ties join one class; rows sharing a doc_id get one component; a
row without doc_id has null component_id and stays (kept); an empty table gives an empty result; columns other than
doc_id and text are ignored by `near_duplicates` and kept as they are, whatever their names, by `keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm import shingles
from inkspark.llm.common import lookup, release, save, work_dir

#: The chance at which a linked pair may share fewer retained values than step 2 assumes.
MISS = 1e-8


def least_shared(k: int, num: int = 3, den: int = 4, miss: float = MISS) -> int:
    """The largest t so that fewer than t of k sampled union values are shared with a chance below `miss`."""
    p, tail = num / den, 0.0
    for t in range(k + 1):
        tail += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if tail > miss:
            return max(1, t)
    return k


def _sketches(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sizes, first, second, kept = [], [], [], []
            for values in shingles.shingle_sets(batch["text"], width):
                a, b = shingles.fold(values)
                sizes.append(len(values))
                first.append(a)
                second.append(b)
                kept.append(values[:k].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return run


def sketches(docs: DataFrame, k: int = 64, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint (f1, f2) and the bottom-k sketch in ascending (unsigned) order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_sketches(k, width), "doc_id long, n_shingles long, f1 long, f2 long, sketch array<long>")


def _prefixes(reps: DataFrame, k: int, num: int, den: int, root: str) -> DataFrame:
    """The rarest retained values (rep, value) of each class that can give links; only values that two or more have."""
    t = least_shared(k, num, den)
    postings = reps.select("rep", F.explode("sketch").alias("value"))
    common = save(postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), f"{root}/frequencies")
    size = F.size("sketch")
    # with sets so small that all partners' sketches are whole sets too, the share is known exactly
    least = F.when((F.col("n_shingles") * den / num).cast("long") <= k, F.ceil(F.col("n_shingles") * num / F.lit(den))).otherwise(F.lit(t))
    sizes = reps.select("rep", size.alias("m"), (size - F.least(least, size) + 1).alias("enter"))
    shared = lookup(postings, common, "value").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    return (
        shared.join(sizes, "rep")
        .withColumn("enter", F.col("enter") - (F.col("m") - F.size("shared")))
        .where("enter > 0")
        .select("rep", F.explode(F.slice("shared", F.lit(1), F.col("enter").cast("int"))).alias("s"))
        .select("rep", F.col("s.value").alias("value"))
    )


def _estimated(k: int, num: int, den: int):
    """Keeps pairs whose union's sketch holds as many shared values as linked pairs have."""
    t = least_shared(k, num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_ends, b_ends = (batch[c].offsets.to_numpy() for c in ("sa", "sb"))
            a_all, b_all = (batch[c].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in ("sa", "sb"))
            n_a, n_b = batch["na"].to_numpy(zero_copy_only=False), batch["nb"].to_numpy(zero_copy_only=False)
            stay = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                a, b = a_all[a_ends[i] : a_ends[i + 1]], b_all[b_ends[i] : b_ends[i + 1]]
                both = np.intersect1d(a, b, assume_unique=True)
                if n_a[i] <= k and n_b[i] <= k:
                    stay[i] = den * len(both) >= num * (n_a[i] + n_b[i] - len(both))
                else:
                    last = np.union1d(a, b)[:k][-1]
                    stay[i] = np.searchsorted(both, last, "right") >= t
            yield batch.select(["a", "b"]).filter(pa.array(stay))

    return run


def _verified(width: int, num: int, den: int):
    """Keeps pairs of texts whose full sets are similar enough. Rows come in runs of the same first text at best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            stay = []
            for first, b in zip(batch["ta"], shingles.shingle_sets(batch["tb"], width), strict=True):
                text = first.as_py()
                if text != last:
                    last, last_set = text, next(shingles.shingle_sets(pa.array([text]), width))
                both = len(np.intersect1d(last_set, b, assume_unique=True))
                stay.append(den * both >= num * (len(last_set) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    return run


def _block_links(width: int, num: int, den: int):
    """Links between the left and right documents of one group, at most one for each two groups that they join."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = list(shingles.shingle_sets(pa.array(pdf["text"], pa.large_string()), width))
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        keep = df[code] > 1
        code = (np.cumsum(df > 1) - 1)[code[keep]]
        owner = owner[keep]
        width_all = int((df > 1).sum())
        left, right = np.flatnonzero(pdf["is_left"]), np.flatnonzero(pdf["is_right"])
        both = np.zeros((len(left), len(right)), np.float32)
        row_of = np.full(len(sets), -1)
        col_of = row_of.copy()
        row_of[left], col_of[right] = np.arange(len(left)), np.arange(len(right))
        for low in range(0, width_all, 4096):
            part = (code >= low) & (code < low + 4096)
            o, c = owner[part], code[part] - low
            a, b = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
            at = row_of[o] >= 0
            a[row_of[o[at]], c[at]] = 1
            at = col_of[o] >= 0
            b[col_of[o[at]], c[at]] = 1
            both += a @ b.T
        shared = np.rint(both).astype(np.int64)
        i, j = np.nonzero(den * shared >= num * (sizes[left][:, None] + sizes[right][None, :] - shared))
        rep, top = pdf["rep"].to_numpy(), list(range(len(sets)))

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        out = []
        for x, y in zip(left[i].tolist(), right[j].tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                top[p] = q
                out.append((rep[x], rep[y]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def components(links: DataFrame, root: str, name: str) -> DataFrame:
    """(node, comp) for every node of links (a, b): comp is the smallest node reachable."""
    links = links.where("a <> b")
    both = save(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), f"{root}/{name}-links")
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    label = save(label, f"{root}/{name}-0")
    step = 0
    while True:  # labels only fall, so that they settle
        step += 1
        near = lookup(both, label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        new = save(label.join(near, "node").select("node", F.least("comp", "near").alias("next"), "comp"), f"{root}/{name}-{step}-near")
        jump = label.select(F.col("node").alias("next"), F.col("comp").alias("top"))
        new = save(lookup(new, jump, "next", "left").select("node", F.least("next", F.coalesce("top", "next")).alias("comp"), F.col("comp").alias("old")), f"{root}/{name}-{step}")
        label = new.select("node", "comp")
        if new.where("comp <> old").isEmpty():
            return label


def _hot_links(hot: DataFrame, reps: DataFrame, docs: DataFrame, root: str, width: int, num: int, den: int, block_shingles: int, block_docs: int) -> DataFrame:
    """Links (a, b) among classes sharing the long lists `hot` (rep, value)."""
    # a list links its members with its smallest one; a cluster is named by its smallest member
    first = hot.groupBy("value").agg(F.min("rep").alias("a"))
    cluster = components(lookup(hot, first, "value").select("a", F.col("rep").alias("b")), root, "clusters").select(F.col("node").alias("rep"), F.col("comp").alias("cluster"))
    weight = hot.groupBy("rep").agg(F.count(F.lit(1)).alias("weight"))
    members = save(cluster.join(weight, "rep").join(reps.select("rep", "n_shingles"), "rep"), f"{root}/members")
    shape = members.groupBy("cluster").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("center"), F.ceil(F.greatest(F.sum("n_shingles") / block_shingles, F.count(F.lit(1)) / block_docs)).alias("blocks"))
    members = lookup(members, shape, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    texts = save(members.join(docs.select(F.col("doc_id").alias("rep"), "text"), "rep"), f"{root}/hot")
    schema = "a long, b long"
    link = _block_links(width, num, den)
    yes, no = F.lit(True), F.lit(False)

    centers = texts.where("rep = center").select("cluster", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"), "rep", "text", yes.alias("is_left"), no.alias("is_right"))
    others = texts.where("rep <> center").select("cluster", "block", "rep", "text", no.alias("is_left"), yes.alias("is_right"))
    near = save(centers.unionByName(others).groupBy("cluster", "block").applyInPandas(link, schema), f"{root}/hot-center")

    apart = texts.where("rep <> center").join(near.select(F.col("b").alias("rep")), "rep", "left_anti").select("rep").withColumn("apart", yes)
    marked = save(texts.join(apart, "rep", "left").withColumn("apart", F.coalesce("apart", no)), f"{root}/hot-marked")
    lefts = marked.where("apart").groupBy("cluster").agg(F.collect_set("block").alias("left_blocks"))  # numbers of a cluster's blocks
    # every block meets each block that has unlinked documents; of two such blocks, the smaller is left
    right = lookup(marked, lefts, "cluster").withColumn("left_block", F.explode("left_blocks")).where(~F.col("apart") | (F.col("left_block") <= F.col("block")))
    right = right.select("cluster", "left_block", "block", "rep", "text", (F.col("apart") & (F.col("block") == F.col("left_block"))).alias("is_left"), yes.alias("is_right"))
    spread = marked.where("apart").select("cluster", F.col("block").alias("left_block"), "rep", "text", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"))
    left = spread.where("block <> left_block").select("cluster", "left_block", "block", "rep", "text", yes.alias("is_left"), no.alias("is_right"))
    far = right.unionByName(left).groupBy("cluster", "left_block", "block").applyInPandas(link, schema)
    return near.unionByName(save(far, f"{root}/hot-apart"))


def near_duplicates(docs: DataFrame, k: int = 64, width: int = 5, percent: int = 75, small: int = 16, block_shingles: int = 250_000, block_docs: int = 1024) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each document; kept marks the component's smallest doc_id."""
    spark = docs.sparkSession
    root = work_dir(spark, "near")
    num, den = percent // math.gcd(percent, 100), 100 // math.gcd(percent, 100)
    sketch = save(sketches(docs, k, width), f"{root}/sketches")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    key = ["f1", "f2", "n_shingles"]
    classes = save(full.groupBy(*key).agg(F.min("doc_id").alias("rep")), f"{root}/class-keys")
    reps = save(full.join(classes.select("rep").distinct(), full["doc_id"] == F.col("rep"), "left_semi").groupBy(F.col("doc_id").alias("rep"), "n_shingles", "f1", "f2").agg(F.first("sketch").alias("sketch")), f"{root}/classes")
    lists = save(_prefixes(reps, k, num, den, root), f"{root}/lists")
    sizes = save(lists.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{root}/list-sizes")
    sized = save(lookup(lists, sizes, "value"), f"{root}/sized-lists")
    low = sized.where(f"n <= {small}").drop("n").join(reps.select("rep", F.col("n_shingles").alias("size")), "rep")
    x, y = low.select("value", F.col("rep").alias("a"), F.col("size").alias("na")), low.select("value", F.col("rep").alias("b"), F.col("size").alias("nb"))
    pairs = x.join(y, "value").where((F.col("a") < F.col("b")) & (den * F.col("na") >= num * F.col("nb")) & (den * F.col("nb") >= num * F.col("na"))).select("a", "b", "na", "nb").distinct()
    of = reps.select("rep", "sketch")
    pairs = pairs.join(of.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(of.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    pairs = save(pairs.mapInArrow(_estimated(k, num, den), "a long, b long"), f"{root}/pairs")

    hot = save(sized.where(f"n > {small}").select("rep", "value"), f"{root}/long-lists")
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(hot.select("rep")).distinct()
    texts = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), F.col("doc_id") == F.col("rep"), "left_semi"), f"{root}/texts")
    one, two = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    links = save(pairs.join(one, "a").join(two, "b").mapInArrow(_verified(width, num, den), "a long, b long"), f"{root}/links")
    if not hot.isEmpty():
        links = links.unionByName(_hot_links(hot, reps, texts, root, width, num, den, block_shingles, block_docs))
    # a doc_id with rows in several classes links them
    mixed = full.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high")).where("low <> high").select("doc_id")
    mixed = save(mixed, f"{root}/mixed")
    if not mixed.isEmpty():
        rows = save(lookup(full.select("doc_id", *key), mixed, "doc_id"), f"{root}/mixed-rows")
        links = links.unionByName(lookup(rows, classes, key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(links, root, "components")
    classes = classes.join(found, classes["rep"] == found["node"], "left").select(*key, F.coalesce("comp", "rep").alias("comp"))
    out = lookup(sketch.select("doc_id", *key), classes, key, "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The documents without all but one (the smallest doc_id) of each near-duplicate component."""
    gone = near_duplicates(docs, **settings).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")

