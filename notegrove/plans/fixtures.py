"""Note collections assembled from the test tables, by SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CLAIMS = [
    "We decided to use steel.",
    "I prefer copper.",
    "I do not prefer copper.",
    "My goal is zero defects.",
    "We might switch vendors.",
    "The seal failed twice.",
    "Should we reorder?",
    "We noticed wear today.",
    "I believe the stock suffices.",
    "The box is blue.",
]
_N = "chr(10)"


def _claim(key: str) -> str:
    return f"CASE {key} % 10 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLAIMS[:-1])) + f" ELSE '{_CLAIMS[-1]}' END"


#: path, content, mtime of a synthesised vault: parts, suppliers, nations and customers.
VAULT = f"""
SELECT 'Parts/P' || p_partkey || '.md' AS path,
  '---' || {_N} || 'title: Part ' || p_partkey || {_N} || 'tags: [' || replace(lower(p_brand), '#', '-') || ', size-' || p_size || ']' || {_N} || '---' || {_N}
  || '# ' || p_name || {_N} || {_N} || 'This part uses [[Brand ' || p_brand || ']]. ' || {_claim("p_partkey")} || {_N} || {_N}
  || 'See [[Part ' || (p_partkey + 1) || ']] and [[S' || (p_partkey % 100) || '|supplier]]. #part' AS content, p_partkey AS mtime FROM part
UNION ALL
SELECT 'Suppliers/S' || s_suppkey || '.md',
  '# S' || s_suppkey || {_N} || {_N} || 'This supplier is part of [[N' || s_nationkey || ']]. ' || {_claim("s_suppkey")} || {_N} || {_N}
  || '```' || {_N} || '[[not a link]] #not-a-tag' || {_N} || '```', s_suppkey FROM supplier
UNION ALL
SELECT 'Nations/N' || n_nationkey || '.md', '# N' || n_nationkey || {_N} || {_N} || 'A nation of region R' || n_regionkey || '. #geo', CAST(n_nationkey AS BIGINT) FROM nation
UNION ALL
SELECT 'Inbox/C' || c_custkey || '.md', 'Plain note for ' || c_mktsegment || '.', c_custkey FROM customer"""

#: path, content of documents taken as notes.
DOC_NOTES = "SELECT source || '/' || doc_id || '.md' AS path, coalesce(text, '') AS content, doc_id AS mtime FROM documents"

#: Two snapshots of files: what is stored, and what a scan finds now.
STATE = "SELECT 'Orders/O' || o_orderkey || '.md' AS path, {sha}('order ' || o_orderkey || ' v1'{bits}) AS hash FROM orders WHERE o_orderkey % 17 <> 0"
INVENTORY = """SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'Archive/O' ELSE 'Orders/O' END || o_orderkey || '.md' AS path,
 {sha}('order ' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN ' v2' ELSE ' v1' END{bits}) AS hash FROM orders WHERE o_orderkey % 11 <> 0"""
_SPARK, _DUCK = {"sha": "sha2", "bits": ", 256"}, {"sha": "sha256", "bits": ""}
STATE_DUCK, INVENTORY_DUCK = STATE.format(**_DUCK), INVENTORY.format(**_DUCK)

#: Tables of few bytes that many texts are made of, and their keys.
DEALT = {"part": "p_partkey", "supplier": "s_suppkey", "customer": "c_custkey"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``text`` over the tables it names; each is read by its own path, nothing is registered in the session.

    The tables that notes are made of are dealt by their keys: a file of few megabytes is one task's, however many texts come of it.
    """
    import re

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = lambda t: table(spark, sf_dir, t).repartition(n, DEALT[t]) if t in DEALT else table(spark, sf_dir, t)

    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN)(\s+){t}\b", rf"\1\2{{{t}}}", text)
    return spark.sql(text, **{t: read(t) for t in used})


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, VAULT)


def doc_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, DOC_NOTES)


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sql(spark, sf_dir, STATE.format(**_SPARK)), sql(spark, sf_dir, INVENTORY.format(**_SPARK))
