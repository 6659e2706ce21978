"""Sharding by size-tiered compaction, in DataFrame operations only.

Arrivals are appended as small immutable shards: rows go to the shard of their
arrival, one folder each, never changed afterwards.  Compaction looks at the
manifest alone: shards under half the target size are put in tiers by size, runs
of neighbouring shards of one tier are merged until a run reaches the target
size, and every run of two shards or more becomes one shard.  Full shards, and
those without a neighbour, stay where they are and are listed again.

A version of the manifest is written under a name of its own, and so is the small
file that names it; that file is published as a whole by a rename that fails if
another writer has published the same version first.  So of two writers that
start from one version, one fails, and a writer that dies leaves no version.
Readers take the highest version, and read the folders that it lists.

The store's columns are those of all its appends: a column that some appends
lack is null in their rows.  An append whose columns have another type than the
store's is refused before anything is written.

Sizes are UTF-8 bytes of text, so a plan depends on the rows only.  Runs are
packed within blocks of BLOCK arrivals: planning groups are bounded.  An arrival
of more than twice the target size (a common id, or rows without one) is split
into several shards, up to PARTS of them; its rows are written with their part
first, so that a task that runs again deals them out as before.

Defined results: null text counts as 0 bytes; rows with a null id belong to
arrival -1; repeated rows are kept; extra columns are stored as they are,
whatever their names; an empty table commits an empty manifest, and reads back
as an empty table with its columns; reading or compacting a store without a
version is a ValueError.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewell.llm.workspace import free_name, settled

#: Ids of one arrival.
ARRIVAL_IDS = 256
#: Sizes within a factor of TIER_BASE share a tier; the least tier ends at TIER_BYTES.
TIER_BYTES = 65_536
TIER_BASE = 4
#: Bytes of a merged shard, about.
TARGET_BYTES = 8_000_000
#: Arrivals that are planned together.
BLOCK = 4_096
CODEC = "zstd"
#: A shard's number: the version that appended it, its arrival from -1 on, and the part of a split arrival.
PARTS, VERSION = 100_000, 10**15
#: Plans and lists of split arrivals up to this many rows are broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000

_MANIFEST = "shard long, n_docs long, n_bytes long, folder string, part string"


def arrival_of(key: str = "doc_id", ids: int = ARRIVAL_IDS) -> Column:
    return F.coalesce(F.floor(F.col(f"`{key}`") / ids), F.lit(-1)).cast("long")


def tier_of(n_bytes: Column) -> Column:
    """0 up to TIER_BYTES, then one more for each factor of TIER_BASE."""
    bounds = [TIER_BYTES * TIER_BASE**i for i in range(16)]
    return sum((F.when(n_bytes > b, 1).otherwise(0) for b in bounds[1:]), F.when(n_bytes > bounds[0], 1).otherwise(0)).cast("int")


def plan_runs(manifest: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The manifest's rows with run, the least shard of those that are merged with it; a shard that stays is a run by itself."""
    small = manifest.where(F.col("n_bytes") * 2 < target_bytes)
    block = F.floor(F.pmod(F.col("shard"), F.lit(VERSION)) / (BLOCK * PARTS))
    tiered = small.withColumn("tier", tier_of(F.col("n_bytes"))).withColumn("block", block)
    along = Window.partitionBy("tier", "block").orderBy("shard")
    before = F.coalesce(F.sum("n_bytes").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = tiered.withColumn("portion", F.floor(before / target_bytes))
    runs = placed.withColumn("run", F.min("shard").over(Window.partitionBy("tier", "block", "portion"))).drop("tier", "block", "portion")
    return runs.unionByName(manifest.where(F.col("n_bytes") * 2 >= target_bytes).withColumn("run", F.col("shard")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def merged_schema(stored: StructType, added: StructType) -> StructType:
    """The stored columns and, after them, those that are new; ValueError if a column has another type."""
    known = {f.name.lower(): f for f in stored}
    for field in added:
        before = known.get(field.name.lower())
        if before is not None and before.dataType.simpleString() != field.dataType.simpleString():
            raise ValueError(f"column {field.name} is {field.dataType.simpleString()}, but {before.dataType.simpleString()} in the store")
    whole = StructType([StructField(f.name, f.dataType, True) for f in stored])
    for field in added:
        if field.name.lower() not in known:
            whole = whole.add(field.name, field.dataType, True)
    return whole


class ShardStore:
    """A folder with shards and versions of the manifest; any path that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        files, path = self._files()
        folder = path(f"{self.root}/versions")
        if not files.exists(folder):
            return []
        names = (s.getPath().getName() for s in files.listStatus(folder))
        return sorted(int(name[1:]) for name in names if name[0] == "v" and name[1:].isdigit())

    def commit(self, manifest: DataFrame, version: int, schema: StructType) -> None:
        """Publish a version as a whole, or fail if another writer was first."""
        staged = f"{self.root}/manifests/{uuid.uuid4().hex}"
        manifest.select(*(c.split()[0] for c in _MANIFEST.split(", "))).coalesce(1).write.parquet(staged)
        files, path = self._files()
        note = path(f"{staged}.json")
        out = files.create(note, False)
        try:
            out.write(bytearray(json.dumps({"manifest": staged, "schema": schema.jsonValue()}).encode()))
        finally:
            out.close()
        files.mkdirs(path(f"{self.root}/versions"))
        self._publish(note, path(f"{self.root}/versions/v{version:06d}"), version)

    def _publish(self, note, target, version: int) -> None:
        """Rename without overwriting."""
        jvm = self.spark._jvm
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = jvm.java.lang.reflect.Array.newInstance(kind, 1)
        options[0] = kind.getEnumConstants()[0]  # NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(note, target, options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                raise RuntimeError(f"version {version} of the manifest exists") from error
            raise

    def _version(self, version: int | None = None) -> dict:
        versions = self.versions()
        if not versions:
            raise ValueError("nothing has been committed")
        files, path = self._files()
        stream = files.open(path(f"{self.root}/versions/v{version or versions[-1]:06d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(self._version(version)["manifest"])

    def _store(self, numbered: DataFrame, part: str, text: str) -> DataFrame:
        """Write rows as one folder for each number in the column ``part``; their lines of the manifest, from what was written."""
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        numbered.repartition(F.col(part)).write.option("compression", CODEC).partitionBy(part).parquet(folder)
        written = self.spark.read.schema(numbered.schema).parquet(folder)
        size = F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).cast("long")
        listed = written.groupBy(F.col(part).alias("shard")).agg(F.count(F.lit(1)).alias("n_docs"), size.alias("n_bytes"))
        return listed.select("shard", "n_docs", "n_bytes", F.lit(folder).alias("folder"), F.lit(part).alias("part"))

    def append(self, rows: DataFrame, key: str = "doc_id", text: str = "text", ids: int = ARRIVAL_IDS, target_bytes: int = TARGET_BYTES) -> int:
        """Write an arrival of rows as small shards, and commit the next version."""
        version = (self.versions() or [0])[-1] + 1
        schema = merged_schema(self.schema(version - 1), rows.schema) if version > 1 else rows.schema
        arrival, part = free_name("arrival", rows.columns), free_name("shard", rows.columns)
        parts = free_name("parts", rows.columns)
        numbered = rows.withColumn(arrival, arrival_of(key, ids))
        sizes = numbered.groupBy(arrival).agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n_bytes")).where(F.col("n_bytes") > 2 * target_bytes)
        large = sizes.select(arrival, F.least(F.ceil(F.col("n_bytes") / target_bytes), F.lit(PARTS)).alias(parts))
        if large.isEmpty():
            split = F.lit(0)
        else:
            large = _small(large)
            one_of = free_name("part", rows.columns)
            dealt = numbered.join(large, arrival).withColumn(one_of, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col(parts)))
            kept = numbered.join(large, arrival, "left_anti").withColumn(one_of, F.lit(0).cast("long"))
            numbered = kept.unionByName(settled(dealt.drop(parts), "dealt"))
            split = F.col(one_of)
        number = (F.lit(version * VERSION) + (F.col(arrival) + 1) * PARTS + split).cast("long")
        added = self._store(numbered.withColumn(part, number).select(*(F.col(f"`{c}`") for c in rows.columns), part), part, text)
        if version > 1:
            added = self.manifest().unionByName(added)
        self.commit(added, version, schema)
        return version

    def schema(self, version: int | None = None) -> StructType:
        return StructType.fromJson(self._version(version)["schema"])

    def rows(self, manifest: DataFrame | None = None, shard: str | None = None) -> DataFrame:
        """The rows of the latest version, or of the manifest that is given, read from the folders that it lists; with their shard, if it is given a name."""
        schema = self.schema()
        if shard is not None and shard.lower() in (c.lower() for c in schema.names):
            raise ValueError(f"the rows have a column {shard}")
        folders = defaultdict(list)
        for row in (manifest if manifest is not None else self.manifest()).select("folder", "part", "shard").collect():  # paths, as a reader needs them
            folders[row.folder, row.part].append(f"{row.folder}/{row.part}={row.shard}")
        fields = StructType([*schema.fields]).add(shard, "long") if shard else schema
        whole = self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
        for (folder, part), paths in folders.items():
            stored = [f for f in schema if f.name.lower() != part.lower()]  # a later append may have a column of that name; these rows don't
            found = self.spark.read.schema(StructType(stored).add(part, "long")).option("basePath", folder).parquet(*paths)
            found = found.withColumnRenamed(part, shard) if shard else found.drop(part)
            whole = whole.unionByName(found, allowMissingColumns=True)
        return whole

    def compact(self, target_bytes: int = TARGET_BYTES, text: str = "text") -> int:
        """Merge runs of similarly sized shards and commit the next version; the present version, if nothing is to be merged."""
        version = (self.versions() or [None])[-1]
        manifest = self.manifest(version)
        schema = self.schema(version)
        counted = plan_runs(manifest, target_bytes).withColumn("shards", F.count(F.lit(1)).over(Window.partitionBy("run")))
        merged = counted.where("shards > 1")
        if merged.isEmpty():
            return version
        old, part = free_name("old", schema.names), free_name("shard", schema.names)
        plan = merged.select(F.col("shard").alias(old), F.col("run").alias(part))
        moved = self.rows(merged, old).join(_small(plan), old).drop(old)
        stay = counted.where("shards = 1").drop("run", "shards")
        self.commit(stay.unionByName(self._store(moved, part, text)), version + 1, schema)
        return version + 1
