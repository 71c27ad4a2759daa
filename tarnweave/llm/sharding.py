"""Operator 7: sharding by size-tiered compaction under a versioned manifest.

A sharded table is a folder:

    data/<uuid>/part-*.parquet     immutable shards, written by Spark's committer
    manifests/<uuid>/              Parquet: path, n_bytes, n_rows of each shard of a version
    commits/<version>.json         names the version's manifest and schema; moved into place, never over another

Arrivals are appended as small shards. Shards whose sizes lie in the same tier (powers of FACTOR) are merged,
once there are FAN_IN of them, into files of about TARGET_BYTES; shards of half that and more are left alone.
Readers see a version whole or not at all: a commit is one rename that fails if the version exists, in which
case the writer starts from the newer version (the file system's rename must be atomic, as HDFS's and local ones are and
plain object stores' is not). Old versions stay readable until expire() drops those that were replaced long enough ago.
Lost executors cost repeated tasks only, and what an ended writer leaves behind is in no manifest.

A table's schema is the union of its arrivals': rows without a column read as null in it, whatever arrives or is merged later. An
arrival whose type of a column is narrower than the table's is widened; any other change of type, or a name that differs from another in
case only, is refused before anything is written.

Null values, empty texts, repeated rows and extra columns pass through unchanged; shards of equal size are merged in the order of
their paths; an empty arrival commits a version without new shards.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, table

TARGET_BYTES = 128 << 20
#: Smallest tier's upper size, ratio between tiers, and the shards that make a tier worth merging.
TIER_BYTES, FACTOR, FAN_IN = 1 << 20, 4, 4
#: Rows of an arriving shard.
ARRIVAL_ROWS = 5000
#: Shards that one merging job names; more are merged by further jobs.
FILES_A_JOB = 10_000
#: Seconds for which a replaced version stays readable.
RETENTION = 7 * 86_400
#: Arrivals in which the query appends its table.
ARRIVALS = 4
MANIFEST = "path string, n_bytes long, n_rows long"


class VersionTaken(Exception):
    pass


#: Types that another takes in without loss, by name.
WIDER = {"byte": ("short", "integer", "long"), "short": ("integer", "long"), "integer": ("long",), "float": ("double",), "date": ("timestamp_ntz",)}


def merged_schema(known: T.StructType, new: T.StructType) -> T.StructType:
    """known with the columns that only new has; every column may be null. ValueError where new can't be read as that."""
    by_name = {f.name: f for f in known.fields}
    by_case = {name.lower(): name for name in by_name}
    for f in new.fields:
        old = by_name.get(f.name)
        if old is None and f.name.lower() in by_case:
            raise ValueError(f"column {f.name} differs from {by_case[f.name.lower()]} in case only")
        if old is not None and old.dataType != f.dataType and old.dataType.typeName() not in WIDER.get(f.dataType.typeName(), ()):
            raise ValueError(f"column {f.name} is {old.dataType.simpleString()} in the table, {f.dataType.simpleString()} in the arrival")
        by_name.setdefault(f.name, f)
        by_case.setdefault(f.name.lower(), f.name)
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in by_name.values()])


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, tier_bytes: int = TIER_BYTES, factor: int = FACTOR, fan_in: int = FAN_IN):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.tier_bytes, self.factor, self.fan_in = target_bytes, tier_bytes, factor, fan_in
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.Path(f"{self.root}/{name}")

    def _fs(self):
        return self.jvm.Path(self.root).getFileSystem(self.conf)

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commit_of(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/commits/{version:012d}.json", wholetext=True).first()[0])

    def _commit(self, version: int, manifest: DataFrame, schema: T.StructType) -> int:
        name = f"manifests/{uuid.uuid4().hex}"
        manifest.select("path", "n_bytes", "n_rows").coalesce(1 + len(self.versions()) // 1000).write.parquet(f"{self.root}/{name}")
        fs = self._fs()
        fs.mkdirs(self._path("commits"))
        written = self._path(f"commits/.{uuid.uuid4().hex}")
        out = fs.create(written)
        out.write(bytearray(json.dumps({"manifest": name, "schema": schema.json(), "time": time.time()}).encode()))
        out.close()
        context = self.jvm.FileContext.getFileContext(written.toUri(), self.conf)
        kind = getattr(self.jvm, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.valueOf("NONE")
        try:
            context.rename(written, self._path(f"commits/{version:012d}.json"), how)
        except Exception as error:
            fs.delete(written, False)
            if "FileAlreadyExists" in str(error) or "rename destination" in str(error):
                raise VersionTaken(version) from error
            raise
        return version

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, n_bytes, n_rows of a version's shards; the newest version by default."""
        version = version if version is not None else max(self.versions(), default=None)
        if version is None:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{self.commit_of(version)['manifest']}")

    def _write(self, df: DataFrame, **options) -> DataFrame:
        """Manifest rows of the shards that df was written to."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.options(**options).parquet(folder)
        files = self.spark.read.schema(df.schema).parquet(folder).groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count("*").alias("n_rows"))
        return files.select(F.col("file_path").alias("path"), F.col("file_size").alias("n_bytes"), "n_rows")

    def schema(self, version: int | None = None) -> T.StructType:
        version = version if version is not None else max(self.versions(), default=None)
        return T.StructType() if version is None else T.StructType.fromJson(json.loads(self.commit_of(version)["schema"]))

    def _fitted(self, df: DataFrame) -> DataFrame:
        """df with the table's types where its own are narrower; ValueError where they don't fit."""
        kinds = {f.name: f.dataType for f in merged_schema(self.schema(), df.schema).fields}
        return df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in df.columns])

    def _add(self, files: DataFrame, schema: T.StructType) -> int:
        while True:
            base = max(self.versions(), default=0)
            whole = merged_schema(self.schema(base) if base else T.StructType(), schema)
            try:
                return self._commit(base + 1, self.manifest(base).unionByName(files) if base else files, whole)
            except VersionTaken:
                continue

    def append(self, df: DataFrame, shard_rows: int = ARRIVAL_ROWS) -> int:
        """Write df as new shards of at most shard_rows rows and commit them; the new version."""
        df = self._fitted(df)
        return self._add(self._write(df, maxRecordsPerFile=shard_rows), df.schema)

    def append_each(self, df: DataFrame, arrival: Column, shard_rows: int = ARRIVAL_ROWS) -> list[int]:
        """Append the rows of each value of `arrival` (a long) as an arrival of its own, in order; df is read and written once. The new versions."""
        df = self._fitted(df)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.withColumn("__arrival", arrival.cast("long")).write.partitionBy("__arrival").option("maxRecordsPerFile", shard_rows).parquet(folder)
        back = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__arrival", T.LongType())])).parquet(folder)
        files = back.groupBy("__arrival", "_metadata.file_path", "_metadata.file_size").agg(F.count("*").alias("n_rows"))
        name = f"{self.root}/manifests/{uuid.uuid4().hex}"
        files.select("__arrival", F.col("file_path").alias("path"), F.col("file_size").alias("n_bytes"), "n_rows").write.parquet(name)
        files = self.spark.read.schema(f"__arrival long, {MANIFEST}").parquet(name)
        arrivals = [r[0] for r in files.select("__arrival").distinct().orderBy("__arrival").collect()]
        versions = [self._add(files.where(F.col("__arrival") == a).drop("__arrival"), df.schema) for a in arrivals]
        self._fs().delete(self.jvm.Path(name), True)
        return versions

    def tiers(self) -> DataFrame:
        """The newest manifest with each shard's tier; null for shards that have reached half the target."""
        tier = F.floor(F.log(F.greatest(F.col("n_bytes") / self.tier_bytes, F.lit(1.0))) / math.log(self.factor)).cast("int")
        return self.manifest().withColumn("tier", F.when(F.col("n_bytes") * 2 < self.target_bytes, tier))

    def compact(self) -> int | None:
        """Merge the smallest tier that has enough shards; the new version, or None where there is none."""
        base = max(self.versions(), default=0)
        if not base:
            return None
        full = self.tiers().where("tier IS NOT NULL").groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= self.fan_in).orderBy("tier").first()
        if full is None:
            return None
        # names of files, not data: one for TIER_BYTES and more each; a job takes FILES_A_JOB of them
        run = self.tiers().where(F.col("tier") == full["tier"]).orderBy("n_bytes", "path").limit(FILES_A_JOB).collect()
        schema = self.schema(base)
        count = max(1, round(sum(r["n_bytes"] for r in run) / self.target_bytes))
        merged = self._write(self.spark.read.schema(schema).parquet(*[r["path"] for r in run]).coalesce(count))
        gone = self.spark.createDataFrame([(r["path"],) for r in run], "path string")
        while True:
            base = max(self.versions())
            rest = self.manifest().join(gone, "path", "left_anti")
            if self.manifest().join(gone, "path", "left_semi").count() != len(run):
                return base  # another writer has merged some of them; its version stands
            try:
                return self._commit(base + 1, rest.unionByName(merged), self.schema(base))
            except VersionTaken:
                continue

    def compact_all(self) -> int:
        """Merge until no tier has enough shards; the newest version."""
        while self.compact() is not None:
            pass
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        version = version if version is not None else max(self.versions())
        schema = self.schema(version)
        paths = [r["path"] for r in self.manifest(version).select("path").toLocalIterator()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def expire(self, older: float = RETENTION) -> None:
        """Drop the versions that a newer one replaced more than `older` seconds ago, and the shards that only they had."""
        versions = self.versions()
        commits = {v: self.commit_of(v) for v in versions}
        now = time.time()
        old = [v for v, newer in zip(versions, versions[1:]) if now - commits[newer]["time"] > older]
        if not old:
            return
        alive = None
        for v in versions[len(old) :]:
            alive = self.manifest(v) if alive is None else alive.unionByName(self.manifest(v))
        fs = self._fs()
        for v in old:
            dead = self.manifest(v).select("path").join(alive, "path", "left_anti").distinct().collect()
            fs.delete(self._path(f"commits/{v:012d}.json"), False)
            fs.delete(self._path(commits[v]["manifest"]), True)
            for r in dead:
                fs.delete(self.jvm.Path(r["path"]), False)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended in ARRIVALS arrivals, compacted and read back through the manifest: doc_id, lang, source, n_chars, text_md5, compacted (a merge has written the newest version)."""
    shards = ShardedTable(spark, new_path(spark, "shards"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    appended = shards.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))) or [shards.append(docs)]
    newest = shards.compact_all()
    return shards.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), F.lit(newest > appended[-1]).alias("compacted"))


ORACLE = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5, TRUE AS compacted FROM documents"
