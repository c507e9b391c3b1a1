"""Tables kept by buckets of a key: a change rewrites the buckets that it touches and no others, and shows all at once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


class Buckets:
    """A table of ``schema`` dealt by the hash of column ``by`` into ``buckets`` folders of Parquet.

    A small file says in which folder each bucket lies, and which batch was applied last. New folders are written first and named after, so readers see a change whole or not at all,
    and a writer that dies leaves only folders that nobody reads (``swept`` removes them). One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, by: str, buckets: int = 32):
        self.spark, self.root, self.schema, self.by, self.buckets = spark, root.rstrip("/"), schema, by, buckets
        self.pointer = files.Pointer(spark, self.root)

    def manifest(self) -> dict:
        text = self.pointer.get()
        return json.loads(text) if text else {"applied": -1, "at": {}}

    def bucket(self, column: str | None = None):
        return F.pmod(F.xxhash64(column or self.by), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of ``keys`` (a table with the column ``by``): ``buckets`` numbers at most."""
        return sorted(r.b for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows that there are, of the buckets ``only`` or of all."""
        at = self.manifest()["at"]
        paths = [f"{self.root}/{folder}/_b={b}" for b, folder in sorted(at.items()) if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def update(self, keys: DataFrame | list[int], how: Callable[[DataFrame], DataFrame], number: int | None = None) -> list[int]:
        """Replaces the buckets that ``keys`` touch (or that are listed) by what ``how`` makes of their rows; the numbers of these buckets.

        ``how`` may give rows of these buckets only. A batch whose ``number`` isn't above the last one applied changes nothing.
        Large buckets are several tasks' to write, as a key may have any share of all rows.
        """
        m = self.manifest()
        if number is not None and number <= m["applied"]:
            return []
        only = keys if isinstance(keys, list) else self.touched(keys)
        if only:
            folder = uuid.uuid4().hex[:12]
            new = how(self.read(only)).withColumn("_b", self.bucket())
            new.hint("rebalance", F.col("_b")).write.partitionBy("_b").parquet(f"{self.root}/{folder}")
            there = {s.getPath().getName() for s in self.pointer.fs.listStatus(self.pointer.path(folder))}
            for b in only:
                m["at"].pop(str(b), None)
                if f"_b={b}" in there:
                    m["at"][str(b)] = folder
        m["applied"] = m["applied"] if number is None else number
        self.pointer.put(json.dumps(m))
        return only

    def replace(self, rows: DataFrame, keys: DataFrame | None = None, number: int | None = None) -> list[int]:
        """All rows whose ``by`` is in ``keys`` (those of ``rows``, if none are given) give way to ``rows``; keys without new rows are deleted."""
        rows = files.stored(rows)
        keys = rows.select(self.by) if keys is None else keys.select(self.by).unionByName(rows.select(self.by))
        keys = files.stored(keys.distinct())
        names = self.spark.createDataFrame([], self.schema).columns
        return self.update(keys, lambda old: old.join(keys, self.by, "left_anti").unionByName(rows.select(*names)), number)

    def newest(self, rows: DataFrame, key: list[str], order: list[str], number: int | None = None) -> list[int]:
        """Keeps of each ``key`` the row that is last in ``order``, of those there are and of ``rows``: what comes late never replaces what is newer."""
        rest = [c for c in self.spark.createDataFrame([], self.schema).columns if c not in key]
        last = lambda df: df.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_x")).select(*key, *[F.col(f"_x.{c}").alias(c) for c in rest])
        rows = files.stored(last(rows))
        return self.update(rows, lambda old: last(old.unionByName(rows.select(*old.columns))), number)

    def swept(self) -> int:
        """Deletes folders that nothing names any more; how many. Not while a reader of an earlier state is at work."""
        held = set(self.manifest()["at"].values())
        old = [s.getPath() for s in self.pointer.fs.listStatus(self.pointer.path("")) if s.isDirectory() and s.getPath().getName() not in held]
        for p in old:
            self.pointer.fs.delete(p, True)
        return len(old)
