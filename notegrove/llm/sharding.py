"""Size-tiered compaction of immutable shards under versioned manifests."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import shared_dir, table, text_of, without


@dataclass(frozen=True)
class Shard:
    """One immutable file of a store: its path under the store's root, its size, and the version that brought it."""

    path: str
    bytes: int
    since: int


class Conflict(RuntimeError):
    """Another writer took away what a commit builds on."""


class Store:
    """Shards under ``root`` and manifests ``v<number>.json`` that list those which make up a version.

    The driver handles manifests only, that is names and sizes of files; rows are read and written by tasks. A manifest appears under its name by one
    rename that fails if the name is taken, so of two writers one commits and the other takes its change to the newer version. Files that no
    manifest names (of writers or tasks that died) are invisible, and ``vacuum`` deletes them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[tuple[str, int]]:
        path = self._path(folder)
        return sorted((s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def version(self) -> int:
        """The newest version; 0 is the empty store."""
        return max((int(n[1:-5]) for n, _ in self._names("manifests") if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self.fs.open(self._path(f"manifests/v{version:010d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def commit(self, add: list[tuple[str, int]], remove: list[Shard] = [], attempts: int = 20) -> int:  # noqa: B006
        """A new version: the newest one without ``remove`` and with ``add`` (path, bytes)."""
        gone = {s.path for s in remove}
        for _ in range(attempts):
            at = self.version()
            now = self.shards(at)
            if not gone <= {s.path for s in now}:
                raise Conflict("a shard to be replaced is gone")
            new = [s for s in now if s.path not in gone] + [Shard(p, n, at + 1) for p, n in add]
            draft, final = self._path(f"manifests/draft-{uuid.uuid4().hex}"), self._path(f"manifests/v{at + 1:010d}.json")
            out = self.fs.create(draft, False)
            out.write(bytearray(json.dumps({"version": at + 1, "shards": [asdict(s) for s in new]}).encode()))
            out.close()
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
            none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                context.rename(context.makeQualified(draft), context.makeQualified(final), none)
                return at + 1
            except Exception as e:
                self.fs.delete(draft, False)
                if "AlreadyExists" not in str(e):
                    raise
        raise Conflict(f"{attempts} other commits came first")

    def _write(self, df: DataFrame, by: str) -> dict[str, list[tuple[str, int]]]:
        """Files of ``df`` by the values of ``by``; the column stays out of them."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").partitionBy(by).parquet(f"{self.root}/{folder}")
        out = {}
        for name, _ in self._names(folder):
            if name.startswith(f"{by}="):
                files = [(f"{folder}/{name}/{n}", size) for n, size in self._names(f"{folder}/{name}") if n.startswith("part-")]
                out[name.partition("=")[2]] = files
        return out

    def append(self, df: DataFrame, arrivals: str) -> int:
        """Write ``df`` as small shards and commit one version for each value of the column ``arrivals``, in order; the newest version.

        Every task writes a file for each value that it holds, so partitions should hold few values each.
        """
        last = self.version()
        files = self._write(df, arrivals)
        for key in sorted(files, key=lambda k: (len(k), k)):
            last = self.commit(files[key])
        return last

    def plan(self, target: int, fan_in: int = 4, base: int = 1 << 20) -> list[list[Shard]]:
        """Runs to be merged: in each tier (sizes within a factor ``fan_in``) of files under half of ``target``, neighbours until they
        fill a target, if the tier has ``fan_in`` runs or more."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.shards():
            if s.bytes < target / 2:
                tiers.setdefault(max(0, int(math.log(max(s.bytes, 1) / base, fan_in))) if s.bytes > base else 0, []).append(s)
        groups = []
        for _, runs in sorted(tiers.items()):
            if len(runs) < fan_in:
                continue
            group, size = [], 0
            for s in runs:
                if group and size + s.bytes > target:
                    groups.append(group)
                    group, size = [], 0
                group.append(s)
                size += s.bytes
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self, target: int = 128 << 20, fan_in: int = 4, base: int = 1 << 20, most_names: int = 4096) -> int:
        """Merge until no tier has ``fan_in`` runs under half of ``target``; the newest version.

        A round is done in jobs of about ``most_names`` files, each with a commit of its own. The names of a job's files, and the group that each belongs to,
        are broadcast: a table that this number bounds. A group is one partition and one file: rows are dealt by the group's number itself, not by a hash of it.
        """
        while groups := self.plan(target, fan_in, base):  # a group becomes one shard, so each round leaves fewer
            job: list[list[Shard]] = []
            for k, g in enumerate(groups):
                job.append(g)
                if k + 1 == len(groups) or sum(map(len, job)) + len(groups[k + 1]) > most_names:
                    self._merge(job)
                    job = []
        return self.version()

    def _merge(self, groups: list[list[Shard]]) -> None:
        runs = [s for g in groups for s in g]
        rows = self.spark.read.parquet(*[f"{self.root}/{s.path}" for s in runs])
        path, group = _unused(rows, "_path"), _unused(rows, "_group")
        names = self.spark.createDataFrame([(s.path, k) for k, g in enumerate(groups) for s in g], f"{path} string, {group} int")
        rows = rows.withColumn(path, _place()).join(F.broadcast(names), path).drop(path)
        files = self._write(rows.repartitionById(len(groups), F.col(group)), group)
        self.commit([f for g in files.values() for f in g], runs)

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """All rows of a version, with ``shard`` (long, the XXH64 of the file's path in the manifest) and ``shard_bytes`` (of the whole file); of a version without shards no rows, in the columns of ``schema``."""
        shards = self.shards(version)
        if not shards:
            return without(self.spark.createDataFrame([], schema or "doc_id long"), ["shard", "shard_bytes"]).selectExpr("*", "cast(null as long) as shard", "cast(null as long) as shard_bytes")
        rows = self.spark.read.parquet(*[f"{self.root}/{s.path}" for s in shards])
        return without(rows, ["shard", "shard_bytes"]).withColumns({"shard": F.xxhash64(_place()), "shard_bytes": F.col("_metadata.file_size")})

    def vacuum(self) -> int:
        """Delete files that the newest version doesn't name; how many. No reader of an older version may be at work."""
        live = {s.path for s in self.shards()}
        gone = 0
        for folder, _ in self._names("data"):
            for part, _ in self._names(f"data/{folder}"):
                for name, _ in self._names(f"data/{folder}/{part}"):
                    if name.startswith("part-") and f"data/{folder}/{part}/{name}" not in live:
                        self.fs.delete(self._path(f"data/{folder}/{part}/{name}"), False)
                        gone += 1
        return gone


def _unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` bears it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def _place():
    """A row's file, as manifests name it."""
    return F.expr("concat_ws('/', slice(split(_metadata.file_path, '/'), -4, 4))")


def sharded(docs: DataFrame, arrivals: int = 8, target: int = 128 << 20, root: str | None = None) -> Store:
    """A compacted store of ``docs`` (doc_id, ...), whose partitions arrive in ``arrivals`` portions; a partition is one small shard.

    An empty table makes an empty store; rows that repeat are all kept, and so are all columns, whatever their names (``read`` replaces ``shard`` and ``shard_bytes``).
    """
    spark = docs.sparkSession
    store = Store(spark, root or f"{shared_dir(spark)}/notegrove/shards-{uuid.uuid4().hex}")
    arrival = _unused(docs, "_arrival")
    store.append(docs.withColumn(arrival, F.pmod(F.spark_partition_id(), F.lit(arrivals))), arrival)
    store.compact(target)
    store.vacuum()
    return store


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = sharded(docs)
    return store.read(schema=docs.schema).select("doc_id", "shard", "shard_bytes", F.lit(store.version()).cast("long").alias("version"), F.octet_length(text_of()).cast("long").alias("n_bytes"), F.sha2(text_of().cast("binary"), 256).alias("text_sha256"))
