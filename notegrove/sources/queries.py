"""Queries that go through files: folders of notes, newline-delimited JSON, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as rt
from ..plans import fixtures as fx
from . import files
from .files import shared


def vault_scan(spark, d):
    """The notes of the vault put down as files, one each, by tasks, and scanned; a line's end closes each file."""
    top = shared(spark)
    files.write_notes(fx.vault(spark, d), top, dealt=True)
    found = files.scan(spark, top, "*.txt")
    return found.select(files.note_path(F.col("path")).alias("path"), "hash", "size")


def ndjson(spark, d):
    """Events written as one JSON object a line, and read again by a schema; every line parses."""
    top = shared(spark)
    files.write_ndjson(fx.table(spark, d, "events").select("event_id", "user_id", "event_type", "props"), top)
    return files.read_ndjson(spark, top, "event_id long, user_id long, event_type string, props string")


def ndjson_source(spark, d):
    return ndjson(spark, d)[0]


def ndjson_sink(spark, d):
    good, bad = ndjson(spark, d)
    return good.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).crossJoin(bad.agg(F.count("*").alias("bad")))  # one row each


def rebuild(spark, d):
    """Rows of each derived table before a rebuild, and after it."""
    store = files.Snapshots(spark, shared(spark))
    store.write(fx.vault(spark, d).select("path", "mtime"))
    before = store.read("path string, mtime long").agg(F.count("*").alias("notes_before"))
    store.write(spark.createDataFrame([], "path string, mtime long"))
    return before.crossJoin(store.read("path string, mtime long").agg(F.count("*").alias("notes_after")))


def quarantine(spark, d):
    """A snapshot whose files turn to junk reads as empty, and is put aside."""
    root = shared(spark)
    store = files.Snapshots(spark, root)
    name = store.write(fx.table(spark, d, "nation"))
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(path(f"{root}/data/{name}")):
        if s.getPath().getName().endswith(".parquet"):
            out = fs.create(s.getPath(), True)
            out.write(bytearray(b"junk"))
            out.close()
    found = store.read("n_nationkey int")
    aside = fs.exists(path(f"{root}/data/corrupt-{name}"))
    return found.agg(F.count("*").alias("n")).select("n", F.lit(aside).alias("put_aside"))


def embed_pending(spark, d):
    """Unit vectors of hashed words for all notes: how many components are set, and the length."""
    v = rt.vectors(fx.vault(spark, d), "path", "content")
    zeros = lambda n: F.array_repeat(F.lit(0).cast("float"), n.cast("int"))
    before = lambda x, i: x["bucket"] - F.coalesce(F.get("v", i - 1)["bucket"], F.lit(-1)) - 1
    parts = F.transform("v", lambda x, i: F.concat(zeros(before(x, i)), F.array((x["weight"] / F.col("length")).cast("float"))))
    full = v.select("path", F.concat(F.flatten(parts), zeros(rt.DIMENSION - 1 - F.element_at("v", -1)["bucket"])).alias("embedding"))
    return full.select("path", F.size("embedding").cast("long").alias("dimension"), F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("set"), F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 3).alias("length"))


QUERIES = {f.__name__: f for f in (vault_scan, ndjson_source, ndjson_sink, rebuild, quarantine, embed_pending)}
ORACLE = {
    "vault_scan": f"WITH vault AS ({fx.VAULT}) SELECT path, sha256(content || chr(10)) AS hash, strlen(content) + 1 AS size FROM vault",
    "ndjson_source": "SELECT event_id, user_id, event_type, props FROM events",
    "ndjson_sink": "SELECT count(*) AS n, count(DISTINCT user_id) AS users, CAST(0 AS BIGINT) AS bad FROM events",
    "rebuild": f"WITH vault AS ({fx.VAULT}) SELECT count(*) AS notes_before, CAST(0 AS BIGINT) AS notes_after FROM vault",
    "quarantine": "SELECT CAST(0 AS BIGINT) AS n, true AS put_aside",
    "embed_pending": f"WITH vault AS ({fx.VAULT}), {rt._hashed('vault', 'path', 'content', 'nb')} SELECT path, CAST(384 AS BIGINT) AS dimension, count(*) AS set, 1.0::DOUBLE AS length FROM nb GROUP BY 1",
}
