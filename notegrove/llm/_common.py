"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of bytes that are none of these six; ``bytes.split()`` cuts at exactly them.
WORD_BREAKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a local master (as in tests) gets a folder of our own where none is set; elsewhere that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="notegrove-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/notegrove/{kind}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add (matched without regard to case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def beside(docs: DataFrame, names: list[str], work: Callable[[DataFrame], DataFrame], text_col: str | None = None) -> DataFrame:
    """``work`` applied to the columns ``names`` of ``docs``; what it keeps of the rows, with all columns of ``docs`` in their order.

    Other columns travel in one struct with names of its own, so none of them can clash with what an operator adds.
    With ``text_col``, a column ``n_chars`` counts the text anew where it is not null.
    """
    others = [c for c in docs.columns if c not in names]
    kept = work(docs.select(*names, F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)] or [F.lit(0)]).alias("_others_")))
    at = {c: F.col("_others_").getField(f"c{k}") for k, c in enumerate(others)} | {c: F.col(f"`{c}`") for c in names}
    if text_col and "n_chars" in others:
        at["n_chars"] = F.length(text_col).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[at[c].alias(c) for c in docs.columns])


def added(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])


class WordHashes(dict):
    """word -> XXH64, remembered for at most ``most`` words (then forgotten and begun anew)."""

    def __init__(self, seed: int = 0, most: int = 400_000):
        super().__init__()
        self.seed, self.most = seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_hashes(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values (by Horner's rule, modulo 2**64)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, b = h[:n].copy(), np.uint64(base)
    for j in range(1, width):
        out *= b
        out += h[j : j + n]
    return mixed(out)
