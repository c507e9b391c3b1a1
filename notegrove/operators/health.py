"""Findings and counts about a vault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..plans import fixtures as fx
from ..sources.files import migrated, recorded_version
from . import knowledge as kn
from .knowledge import KNOWN


def broken_links(links: DataFrame) -> DataFrame:
    return links.where("resolved is null").select("path", F.col("target").alias("detail"))


def orphans(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Notes that neither link nor are linked, if there is more than one note: two anti joins."""
    out = notes.select("path").join(links.select("path").distinct(), "path", "left_anti")
    out = out.join(links.where("resolved is not null").select(F.col("resolved").alias("path")).distinct(), "path", "left_anti")
    many = notes.limit(2).agg((F.count("*") > 1).alias("many"))
    return out.crossJoin(F.broadcast(many)).where("many").select("path")  # one row


def q_broken_links(spark, d):
    return broken_links(kn.link_resolution(spark, d))


def q_orphans(spark, d):
    n = md.parsed(fx.vault(spark, d))
    return orphans(n, kn.resolved_links(n))


def counts(n: DataFrame) -> list[DataFrame]:
    return [
        n.agg(F.count("*").alias("total_notes")),
        kn.entities(n).agg(F.count("*").alias("total_entities")),
        kn.claims(n).agg(F.count("*").alias("total_claims"), F.count_if(F.col("claim_type").isin("DECISION", "PREFERENCE", "GOAL", "EXPERIENCE")).alias("candidates")),
        kn.resolved_links(n).agg(F.count_if(F.col("resolved").isNull()).alias("broken_links")),
    ]


def _side_by_side(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)  # one row each
    return out


def summary(notes: DataFrame) -> DataFrame:
    """One row: how many notes, entities, claims, candidates for memories, broken links, orphans and notes with a copy there are."""
    from .vault import duplicates

    n = md.parsed(notes)
    return _side_by_side([*counts(n), orphans(n, kn.resolved_links(n)).agg(F.count("*").alias("orphans")), duplicates(n).agg(F.count("*").alias("duplicates"))])


def embedding_status(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks_total, chunks_embedded, chunks_pending, for ``vectors`` (chunk_id, v)."""
    there = chunks.select("chunk_id").join(vectors.where("v is not null").select("chunk_id", F.lit(1).alias("x")).distinct(), "chunk_id", "left")
    return there.agg(F.count("*").alias("chunks_total"), F.count("x").alias("chunks_embedded"), F.count_if(F.col("x").isNull()).alias("chunks_pending"))


def health_counts(spark, d):
    return _side_by_side(counts(md.parsed(fx.vault(spark, d))))


def health_summary(spark, d):
    return summary(fx.vault(spark, d))


def health_detailed(spark, d):
    """Findings by kind."""
    n = md.parsed(fx.vault(spark, d))
    links = kn.resolved_links(n)
    from .vault import duplicates

    parts = [broken_links(links).select(F.lit("broken_link").alias("kind")), orphans(n, links).select(F.lit("orphan").alias("kind")), duplicates(n).select(F.lit("duplicate").alias("kind"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"))


def job_stats(spark, d):
    """Counts of jobs by state: what each user's event type stands for."""
    e = fx.table(spark, d, "events").withColumn("status", F.element_at(F.array(*[F.lit(s) for s in ("pending", "running", "completed", "failed")]), (F.col("event_id") % 4 + 1).cast("int")))
    return e.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "completed", "failed")])


def schema_version(spark, d):
    """The version of each customer's store: events are migrations, recorded under the customer of their user."""
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("store"), (F.col("event_id") % 4 + 1).alias("version"))
    stores = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("store"))
    return recorded_version(stores.join(e, "store", "left"), "store")


#: What made versions 2 and 3 of a table of notes.
STEPS = {2: lambda df: df.withColumn("hash", F.sha2("content", 256)), 3: lambda df: df.withColumn("size", F.octet_length("content").cast("long")).drop("content")}


def migrations(spark, d):
    """Documents as notes of version 1 brought to the newest version; a table that is there already stays as it is."""
    notes, at = migrated(fx.doc_notes(spark, d).select("path", "content"), 1, STEPS)
    again, _ = migrated(notes, at, STEPS)
    return again.withColumn("version", F.lit(at).cast("long"))


def models_status(spark, d):
    e = fx.table(spark, d, "embeddings")
    docs = fx.table(spark, d, "documents").select("doc_id")
    return docs.join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").agg(F.count("*").alias("chunks_total"), F.count("embedding").alias("chunks_embedded"), F.count_if(F.col("embedding").isNull()).alias("chunks_pending"))


def note_payload_valid(spark, d):
    """Paths that are relative and not empty, with a hash of 64 hex digits."""
    t = fx.sql(spark, d, "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/abs.md' ELSE 'rel/' || o_orderkey || '.md' END AS path FROM orders").withColumn("hash", F.when(F.col("k") % 3 == 0, F.left(F.sha2(F.col("k").cast("string"), 256), F.lit(63))).otherwise(F.sha2(F.col("k").cast("string"), 256)))
    return t.select("k", ((F.col("path") != "") & ~F.col("path").startswith("/") & F.col("hash").rlike("^[0-9a-fA-F]{64}$")).alias("valid"))


QUERIES = {"broken_links": q_broken_links, "orphans": q_orphans} | {f.__name__: f for f in (health_counts, health_summary, health_detailed, job_stats, schema_version, migrations, models_status, note_payload_valid)}
_ORPHANS = "SELECT path FROM vault v WHERE path NOT IN (SELECT path FROM linked) AND path NOT IN (SELECT resolved FROM linked WHERE resolved IS NOT NULL)"
ORACLE = {
    "broken_links": f"WITH {KNOWN} SELECT path, target AS detail FROM linked WHERE resolved IS NULL",
    "orphans": f"WITH {KNOWN} {_ORPHANS}",
    "health_counts": f"WITH {KNOWN} SELECT (SELECT count(*) FROM vault) AS total_notes, (SELECT count(*) FROM ents) AS total_entities, (SELECT count(*) FROM claims) AS total_claims, (SELECT count(*) FROM claims WHERE claim_type IN ('DECISION', 'PREFERENCE', 'GOAL', 'EXPERIENCE')) AS candidates, (SELECT count(*) FROM linked WHERE resolved IS NULL) AS broken_links",
    "health_detailed": f"WITH {KNOWN}, g AS (SELECT count(*) OVER (PARTITION BY content) AS n FROM vault) SELECT 'broken_link' AS kind, count(*) AS n FROM linked WHERE resolved IS NULL UNION ALL SELECT 'orphan', count(*) FROM ({_ORPHANS}) UNION ALL SELECT 'duplicate', count(*) FROM g WHERE n > 1",
    "job_stats": "SELECT count(*) FILTER (event_id % 4 = 0) AS pending, count(*) FILTER (event_id % 4 = 1) AS running, count(*) FILTER (event_id % 4 = 2) AS completed, count(*) FILTER (event_id % 4 = 3) AS failed FROM events",
    "schema_version": "SELECT c_custkey AS store, coalesce(max(event_id % 4 + 1), 0) AS version FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1",
    "migrations": f"WITH docs AS ({fx.DOC_NOTES}) SELECT path, sha256(content) AS hash, strlen(content) AS size, CAST(3 AS BIGINT) AS version FROM docs",
    "models_status": "SELECT count(*) AS chunks_total, count(embedding) AS chunks_embedded, count(*) FILTER (embedding IS NULL) AS chunks_pending FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "note_payload_valid": "SELECT o_orderkey AS k, o_orderkey % 4 IN (2, 3) AND o_orderkey % 3 <> 0 AS valid FROM orders",
}
ORACLE["health_summary"] = f"SELECT * FROM ({ORACLE['health_counts']}), (SELECT count(*) AS orphans FROM ({ORACLE['orphans']})), (SELECT coalesce(sum(n), 0)::BIGINT AS duplicates FROM (WITH vault AS ({fx.VAULT}) SELECT count(*) AS n FROM vault GROUP BY content HAVING count(*) > 1))"
