"""Sharding: small immutable arrivals, size-tiered compaction, versioned manifests."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glidemesh.llm.common import shared_dir, table

MANIFEST = "path string, bytes long, n_rows long, tier int, origin string"


class ConcurrentCommit(RuntimeError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class ShardParams:
    target_bytes: int = 32 << 20
    least_bytes: int = 256 << 10  # tier 0 holds everything below this times ``fanout``
    fanout: int = 4  # a tier's sizes span this factor; so many shards at least are merged
    broadcast_shards: int = 100_000  # a longer list of shards to merge is joined by shuffle
    bucket_shards: int = 10_000  # small shards that one task plans


class ShardStore:
    """A table as immutable Parquet shards under ``folder``.

    ``data/`` holds shards, ``manifests/`` lists of them, ``versions/N`` the name of the list that
    is version N. A version appears by renaming a finished file to a name that must not exist yet:
    readers see the old list or the new one, and of two writers one fails with ConcurrentCommit.
    """

    def __init__(self, spark: SparkSession, folder: str, p: ShardParams = ShardParams()):
        self.spark, self.folder, self.p = spark, folder.rstrip("/"), p

    # -- versions

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        conf = self.spark._jsc.hadoopConfiguration()
        return jvm, path.getFileSystem(conf), conf

    def version(self) -> int:
        """The newest version, 0 for a store without any."""
        jvm, fs, _ = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/versions")
        if not fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        name = self.spark.read.text(f"{self.folder}/versions/{version:08d}").first()[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/{name}")

    def commit(self, shards: DataFrame, base: int) -> int:
        """Make ``shards`` version ``base + 1``; fails if there is one by now."""
        jvm, fs, conf = self._fs()
        name = uuid.uuid4().hex
        shards.write.parquet(f"{self.folder}/manifests/{name}")
        path = jvm.org.apache.hadoop.fs.Path
        fs.mkdirs(path(f"{self.folder}/versions"))
        draft, final = path(f"{self.folder}/versions/.{name}"), path(f"{self.folder}/versions/{base + 1:08d}")
        out = fs.create(draft, False)
        out.write(bytearray(name.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        no_options = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, no_options)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise ConcurrentCommit(f"version {base + 1} exists") from e
            raise
        return base + 1

    # -- writing

    def _measured(self, folder: str, origin: str) -> DataFrame:
        """Manifest rows of the files in a folder: footers are read, not the rows."""
        rows = self._files(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        tier = F.floor(F.log(F.greatest(F.col("bytes") / self.p.least_bytes, F.lit(1.0))) / F.log(F.lit(float(self.p.fanout))))
        return rows.agg(F.count("*").alias("n_rows")).select("path", "bytes", "n_rows", tier.cast("int").alias("tier"), F.lit(origin).alias("origin"))

    def _files(self, *folders: str) -> DataFrame:
        """All files below some folders; the names of folders in between are no columns."""
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*folders)

    def append(self, df: DataFrame, by: str | None = None) -> int:
        """Write arrivals as new shards where the rows are, a file a task (and value of ``by``).

        ``by`` is an expression that only deals rows to files; no column is added or lost, whatever
        the table's columns are called. No rows make no shard and no version. Nulls, repeated rows
        and texts of any length are rows like others.
        """
        base, name = self.version(), uuid.uuid4().hex
        if not df.take(1):
            return base
        at = f"{self.folder}/data/{name}"
        if by is None:
            df.write.option("compression", "zstd").parquet(at)
        else:
            deal = f"_by_{name}"
            df.withColumn(deal, F.expr(by)).write.option("compression", "zstd").partitionBy(deal).parquet(at)
        return self.commit(self.manifest(base).unionByName(self._measured(at, "arrival")), base)

    # -- compaction

    def plan(self, shards: DataFrame) -> DataFrame:
        """``(path, bytes, grp)``: which small shards are merged together.

        Shards of one tier, in the order of their sizes, are laid end to end and cut at every
        ``target_bytes``; groups of fewer than ``fanout`` shards wait. Nothing of nearly the target
        size is rewritten.
        """
        p = self.p
        small = shards.where(F.col("bytes") < p.target_bytes * 3 // 4)
        buckets = max(1, small.count() // p.bucket_shards)
        run = Window.partitionBy("tier", "bucket").orderBy("bytes", "path").rowsBetween(Window.unboundedPreceding, -1)
        laid = small.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)))
        before = F.coalesce(F.sum("bytes").over(run), F.lit(0))
        laid = laid.withColumn("cut", F.floor(before / p.target_bytes))
        size = Window.partitionBy("tier", "bucket", "cut")
        ready = laid.withColumn("n", F.count("*").over(size)).where(F.col("n") >= p.fanout)
        return ready.select("path", "bytes", F.concat_ws("-", "tier", "bucket", "cut").alias("grp"))

    def compact(self) -> bool:
        """One round: merge what the plan asks for, commit the new list; False if there was nothing.

        Every group is one task's, by its number, and becomes one file; a task holds rows one by
        one, so its memory does not grow with the group.
        """
        base = self.version()
        before = self.manifest(base)
        plan = self.plan(before)
        plan = plan.persist()
        n = plan.count()
        if not n:
            plan.unpersist()
            return False
        groups = plan.select("grp").distinct()
        numbers = groups.withColumn("number", (F.row_number().over(Window.orderBy("grp")) - 1).cast("int"))
        many = groups.count()
        new = uuid.uuid4().hex
        at, file, number = f"{self.folder}/data/{new}", f"_file_{new}", f"_group_{new}"
        # only the folders that the plan names are listed; the files come from a join on their paths
        rows = self._files(*self._folders(plan))
        rows = rows.withColumn(file, F.col("_metadata.file_path"))
        chosen = plan.join(numbers, "grp").select(F.col("path").alias(file), F.col("number").alias(number))
        if n <= self.p.broadcast_shards:
            chosen = F.broadcast(chosen)
        merged = rows.join(chosen, file).drop(file).repartitionById(many, number).drop(number)
        merged.write.option("compression", "zstd").parquet(at)
        rest = before.join(plan.select("path"), "path", "left_anti")
        self.commit(rest.unionByName(self._measured(at, "merged")), base)
        plan.unpersist()
        return True

    def _folders(self, shards: DataFrame) -> list[str]:
        """The append and merge folders in use: one for each of these calls, not for each shard."""
        top = F.substring_index(F.substring_index("path", f"{self.folder.split('://')[-1].lstrip('/')}/data/", -1), "/", 1)
        return [f"{self.folder}/data/{r[0]}" for r in shards.select(top).distinct().collect()]

    def settle(self) -> int:
        """Compact until no group is left to merge; every round leaves fewer shards, so it ends."""
        while self.compact():
            pass
        return self.version()

    def vacuum(self) -> None:
        """Delete folders of ``data/`` that the newest version does not use."""
        jvm, fs, _ = self._fs()
        used = set(self._folders(self.manifest()))
        for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data")):
            if f"{self.folder}/data/{s.getPath().getName()}" not in used:
                fs.delete(s.getPath(), True)

    def read(self, version: int | None = None, shard_col: str | None = None) -> DataFrame:
        """The rows of a version; ``shard_col``, if given, is added: the file each stands in."""
        shards = self.manifest(version)
        rows = self._files(*self._folders(shards))
        if shard_col in rows.columns:
            raise ValueError(f"the table has a column {shard_col} of its own")
        file = shard_col or f"_file_{uuid.uuid4().hex}"
        rows = rows.withColumn(file, F.col("_metadata.file_path"))
        found = rows.join(shards.select(F.col("path").alias(file)), file, "left_semi")
        return found if shard_col else found.drop(file)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in eight parts, are compacted, and are read back with the tier of their shard.

    An empty table makes no shard and no version, and gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, shared_dir(spark))
    store.append(docs.select("doc_id", "text"), by="pmod(coalesce(doc_id, 0), 8)")
    version = store.settle()
    if not version:
        empty = "null as text_sha256, 0 as tier, '' as origin, 0L as shard_rows, 0 as version"
        return docs.selectExpr("doc_id", *empty.split(", ")).limit(0)
    store.vacuum()
    tiers = store.manifest().select(F.col("path").alias("shard"), "tier", "origin", F.col("n_rows").alias("shard_rows"))
    return store.read(shard_col="shard").join(tiers, "shard").select(
        "doc_id", F.sha2("text", 256).alias("text_sha256"), "tier", "origin", "shard_rows", F.lit(version).alias("version")
    )


QUERIES = {"op3_compaction": query}
ORACLES: dict[str, str] = {}
