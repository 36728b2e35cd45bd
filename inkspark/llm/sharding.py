"""Size-tiered compaction of immutable shards under a versioned manifest, in DataFrame functions only.

`ShardStore.append` writes an arrival as small immutable Parquet shards, one for each task, without a shuffle.
`compact` finds the shards of each size tier (tier t holds sizes of base * fanout**t up to fanout times that) and,
where a tier has `fanout` of them or more, reads them packed up to the target size and writes one new shard for each
packed group: Spark's own packing of files into read partitions does the merge, with no shuffle and no driver loop over rows.
Every change is one new manifest version, a Parquet folder that is written aside and committed by an exclusive rename
to manifest/v<n>: a second writer of the same version fails, and readers see whole versions only. That holds where a folder's
rename is atomic and fails if the target exists (HDFS, local disks); on object stores, whose rename copies, let one
writer commit at a time. Shards are never changed; `vacuum` deletes those that older versions list and the kept one doesn't, and
leaves files alone that no version lists yet: another writer may be about to commit them.

Defined cases: null and empty texts, rows without doc_id, repeated rows and extra columns of any name are kept as they are
(`shard` and `tier` get `_` added to their names where the table has such a column); an empty arrival still makes a version;
an empty store reads as no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkspark.llm.common import BROADCAST_ROWS, column, free, remove, work_dir

MANIFEST = "version long, shard string, arrival string, tier int, bytes long, rows long"


class ConflictError(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """Shards of one table below `root`."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int = 64 << 20, base_bytes: int = 1 << 20, fanout: int = 4):
        self.spark, self.root, self.schema = spark, root, schema
        self.target, self.base, self.fanout = target_bytes, base_bytes, fanout
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        where = self.path(f"{self.root}/manifest")
        if not self.fs.exists(where):
            return 0
        return max([0, *(int(f.getPath().getName()[1:]) for f in self.fs.listStatus(where) if f.getPath().getName().startswith("v"))])

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{version}")

    def commit(self, shards: DataFrame, version: int) -> None:
        """Make `shards` the content of the given version, or raise ConflictError."""
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        shards.select(F.lit(version).cast("long").alias("version"), "shard", "arrival", "tier", "bytes", "rows").coalesce(1).write.parquet(aside)
        self.fs.mkdirs(self.path(f"{self.root}/manifest"))
        target = self.path(f"{self.root}/manifest/v{version}")
        if self.fs.exists(target) or not self.fs.rename(self.path(aside), target) or self.fs.exists(self.path(f"{target}/{aside.rpartition('/')[2]}")):
            raise ConflictError(f"version {version} exists")

    def _entries(self, arrival: str) -> DataFrame:
        """The manifest entries of an arrival's shards; rows are counted in the files' footers."""
        folder = f"{self.root}/shards/{arrival}"
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
        counts = self.spark.read.schema(self.schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
        tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(self.base)) / self.base) / F.log(F.lit(float(self.fanout)))).cast("int")
        found = files.join(counts, "file", "left").select(F.concat(F.lit(f"{arrival}/"), "file").alias("shard"), F.lit(arrival).alias("arrival"), tier.alias("tier"), "bytes", F.coalesce("rows", F.lit(0)).alias("rows"))
        return found.where("rows > 0")

    def append(self, rows: DataFrame) -> int:
        """Add an arrival; the new version."""
        version = self.version()
        arrival = f"a{version + 1}-{uuid.uuid4().hex[:8]}"
        rows.select(*[column(f.name) for f in self.schema]).write.parquet(f"{self.root}/shards/{arrival}")
        self.commit(self.manifest(version).drop("version").unionByName(self._entries(arrival)), version + 1)
        return version + 1

    def compact(self) -> int:
        """Merge the tiers that are full, smallest first, until none is; the newest version."""
        while True:
            version = self.version()
            listed = self.manifest(version)
            open_ = listed.where(F.col("bytes") < self.target // 2)
            full = open_.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.fanout).agg(F.min("tier").alias("tier")).first()["tier"]
            if full is None:
                return version
            chosen = [r["shard"] for r in open_.where(F.col("tier") == full).orderBy("shard").collect()]  # file names, as a listing has
            arrival = f"m{version + 1}-{uuid.uuid4().hex[:8]}"
            # files are packed up to the target by settings of a session of its own
            packer = self.spark.newSession()
            for key, value in (("maxPartitionBytes", self.target), ("openCostInBytes", 0), ("minPartitionNum", 1)):
                packer.conf.set(f"spark.sql.files.{key}", str(value))
            packer.read.schema(self.schema).parquet(*[f"{self.root}/shards/{s}" for s in chosen]).write.parquet(f"{self.root}/shards/{arrival}")
            entries = self._entries(arrival).cache()
            merged = entries.count()
            gone = self.spark.createDataFrame([(s,) for s in chosen], "shard string")
            self.commit(listed.drop("version").join(gone, "shard", "left_anti").unionByName(entries), version + 1)
            entries.unpersist()
            if merged >= len(chosen):
                return version + 1

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with `shard` and `tier`."""
        listed = self.manifest(version)
        own = [f.name for f in self.schema]
        shard, tier = free(own, "shard"), free(own, "tier")
        names = [r["shard"] for r in listed.select("shard").collect()]  # file names, as a listing has
        if not names:
            return self.spark.createDataFrame([], self.schema).withColumns({shard: F.lit(""), tier: F.lit(0)})
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/shards/{s}" for s in names])
        rows = rows.withColumn(shard, F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), "_metadata.file_name"))
        tiers = listed.select(F.col("shard").alias(shard), F.col("tier").alias(tier))
        tiers = F.broadcast(tiers) if len(names) <= BROADCAST_ROWS else tiers
        return rows.join(tiers, shard).select(*[column(c) for c in own], shard, tier)

    def vacuum(self, keep_version: int | None = None) -> None:
        """Delete older manifests than the kept version's (the newest by default), and their shards that it doesn't list."""
        version = self.version() if keep_version is None else keep_version
        kept = {r["shard"] for r in self.manifest(version).select("shard").collect()}
        for old in range(1, version):
            if not self.fs.exists(self.path(f"{self.root}/manifest/v{old}")):
                continue
            for shard in {r["shard"] for r in self.manifest(old).select("shard").collect()} - kept:
                self.fs.delete(self.path(f"{self.root}/shards/{shard}"), False)
            remove(self.spark, f"{self.root}/manifest/v{old}")


def shard_documents(docs: DataFrame, arrivals: int = 4, **settings) -> DataFrame:
    """Put the table into a store as `arrivals` ranges of doc_id, compact it and read the committed version."""
    spark = docs.sparkSession
    store = ShardStore(spark, work_dir(spark, "shards"), docs.schema, **settings)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        store.append(docs)
    else:
        step = (high - low) // arrivals + 1
        for i in range(arrivals):
            part = F.col("doc_id").between(low + i * step, low + (i + 1) * step - 1)
            store.append(docs.where(part | F.col("doc_id").isNull() if i == 0 else part))
            store.compact()
    store.vacuum()
    return store.read()
