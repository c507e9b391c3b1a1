"""An inverted index of chunks kept by segments: a batch of changed notes adds one, tombstones hide what it replaces, and segments of a level are merged."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import fixtures as fx
from ..sources import files
from . import blocks as blks
from . import search
from . import retrieval as rt

CHUNKS = "b int, segment long, path string, chunk_id string, ordinal int, heading_path string, text string, n_terms int, tf array<struct<term: string, tf: bigint>>"
POSTINGS = "b int, segment long, term string, r long, n int, max_tf long, min_length int, rows array<struct<path: string, ordinal: int, heading_path: string, n_terms: int, tf: bigint>>"
TERMS = "b int, term string, df long"
GRAVES = "b int, segment long, path string"
#: Chunks of a range at most, about, and ranges of lengths to a doubling; words whose postings a task makes, about.
BLOCK, FINE, SHARE = 4096, 8, 1 << 20
#: So many times its limit a search opens before it knows what to skip.
FIRST = 2
SCHEMAS = {"chunks": CHUNKS, "postings": POSTINGS, "terms": TERMS, "graves": GRAVES}


class Segments(search.Index):
    """Searchable as an ``Index`` is; ``apply`` and ``merge`` keep it.

    A segment is never changed once it is written. It has *chunks* (a batch's notes, by bucket of their path), *postings* (their terms, by bucket of the term; in blocks, each of a range of chunks of like length, with the largest tf and the
    smallest length in it), *terms* (by how much
    the batch changes each term's number of chunks) and *graves* (notes of earlier segments that the batch replaces, empties or deletes). A small file names the
    segments that hold and counts chunks and words; a batch becomes visible when that file is replaced, so a job that dies leaves nothing to see.

    - What lives: rows of a segment without a grave for (segment, path).
    - Statistics: sums over segments, in which what graves hide is taken off by the batch that dug them; no search counts the corpus.
    - Work of a batch: its own notes, and the buckets of chunks that hold their earlier versions. Rows of other notes aren't written again until their segment is merged,
      with ``fan_in`` - 1 others of its level, to one of the next; a row is so written about log(batches) times.
    """

    def __init__(self, spark: SparkSession, root: str, analyzer: str = "words", buckets: int = 16, fan_in: int = 4):
        self.spark, self.root, self.analyzer, self.buckets, self.fan_in = spark, root.rstrip("/"), analyzer, buckets, fan_in
        self.pointer = files.Pointer(spark, self.root)

    # --- what there is

    def manifest(self) -> dict:
        """``applied``: the number of the last batch; ``segments``: id, level, and by how much each changes the numbers of chunks and words."""
        text = self.pointer.get()
        return json.loads(text) if text else {"applied": -1, "next": 0, "segments": []}

    def _bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, ids: list[int] | None = None) -> DataFrame:
        held = {s["id"]: s["folder"] for s in self.manifest()["segments"]}
        at = [f"{self.root}/{kind}/s={held[i]}" for i in (held if ids is None else ids)]
        if not at:
            return self.spark.createDataFrame([], SCHEMAS[kind])
        return self.spark.read.schema(f"{SCHEMAS[kind]}, s string").option("basePath", f"{self.root}/{kind}").parquet(*at).drop("s")

    def _living(self, rows: DataFrame, buckets: list[int] | None = None) -> DataFrame:
        """``rows`` (segment, path, ...) without those that graves hide."""
        graves = self._read("graves")
        graves = graves if buckets is None else graves.where(F.col("b").isin(buckets))
        return rows.join(graves.drop("b"), ["segment", "path"], "left_anti")

    @property
    def rows(self) -> DataFrame:
        """The chunks that hold now, as an ``Index`` has them."""
        found = self._living(self._read("chunks"))
        terms = F.flatten(F.transform("tf", lambda x: F.array_repeat(x["term"], x["tf"].cast("int"))))
        return found.select("chunk_id", "path", "ordinal", "heading_path", "text", terms.alias("terms"), "n_terms")

    def size(self) -> DataFrame:
        segments = self.manifest()["segments"]
        n, words = (sum(s[k] for s in segments) for k in ("chunks", "words"))
        return self.spark.createDataFrame([(n, words / n if n else None)], "n long, avg double")

    def _buckets_of(self, df: DataFrame, column: str) -> list[int]:
        return sorted(r.b for r in df.select(self._bucket(column).alias("b")).distinct().collect())  # ``buckets`` at most

    def _postings(self, terms: DataFrame) -> DataFrame:
        """The blocks of ``terms`` (term; distinct). Only the buckets of the terms are read."""
        return self._read("postings").where(F.col("b").isin(self._buckets_of(terms, "term"))).join(terms, "term", "left_semi")

    def _opened(self, blocks: DataFrame) -> DataFrame:
        """What lives of the rows of ``blocks``."""
        rows = blocks.select("segment", "term", F.explode("rows").alias("x")).select("segment", "term", "x.*")
        return self._living(rows).withColumn("chunk_id", blks.chunk_id()).select("term", *search.KEYS[1:], "n_terms", "tf")

    def hits(self, terms: DataFrame) -> DataFrame:
        """A term's postings say all that is scored."""
        return self._opened(self._postings(terms))

    def top(self, queries: DataFrame, limit: int = rt.LIMIT) -> tuple[DataFrame, DataFrame]:
        """The first ``limit`` of ``search.lexical``, and how it was done (query_id, blocks, opened: how many the query's terms have, and how many of these were opened).

        A range of chunks can't score more than its blocks' largest tf and smallest length give. Each query first opens the ranges of the highest bounds, until they hold ``FIRST`` times
        ``limit`` chunks that may have all its terms; the score at ``limit`` among these is what others must reach, and only ranges whose bound does are opened then.
        """
        q = self.queries(queries).select("query_id", "terms", F.size("terms").alias("n_wanted")).where("n_wanted > 0")
        wanted = files.stored(q.select("query_id", "n_wanted", F.explode("terms").alias("term")))
        terms = wanted.select("term").distinct()
        df = files.stored(self.frequencies(None, terms).crossJoin(self.size()).select("term", search.idf(F.col("n"), F.col("df")).alias("idf"), "avg"))  # one row
        blocks = self._postings(terms)
        weighed = blocks.select("segment", "term", "r", "n", "max_tf", "min_length").join(df, "term").join(wanted, "term")
        bound = F.sum(search.part(F.col("idf"), F.col("max_tf"), F.col("min_length"), F.col("avg")))
        ranges = weighed.groupBy("query_id", "n_wanted", "segment", "r").agg(F.count("*").alias("k"), bound.alias("bound"), F.min("n").alias("held")).where("k = n_wanted")
        w = W.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "r")
        ranges = files.stored(ranges.withColumn("before", F.sum("held").over(w) - F.col("held")).drop("k", "held"))

        def scored(chosen: DataFrame) -> DataFrame:
            """All hits of queries in the ranges chosen for them."""
            opened = blocks.join(chosen.select("segment", "r").distinct(), ["segment", "r"], "left_semi")
            rows = opened.select("segment", "r", "term", F.explode("rows").alias("x")).select("segment", "r", "term", "x.*")
            rows = self._living(rows).withColumn("chunk_id", blks.chunk_id()).join(wanted, "term").join(chosen.select("query_id", "segment", "r"), ["query_id", "segment", "r"], "left_semi").join(df, "term")
            score = F.round(F.sum(search.part(F.col("idf"), F.col("tf"), F.col("n_terms"), F.col("avg"))), 6)
            return rows.groupBy(*search.KEYS, "n_wanted").agg(F.count("*").alias("k"), score.alias("score")).where("k = n_wanted").select(*search.KEYS, "score")

        first = ranges.where(F.col("before") < FIRST * limit)
        one = files.stored(search.ranked(scored(first), limit))
        least = one.where(F.col("rank") == limit).select("query_id", F.col("score").alias("least"))
        rest = ranges.where(F.col("before") >= FIRST * limit).join(least, "query_id", "left").where(F.col("least").isNull() | (F.round(F.col("bound") + 1e-9, 6) >= F.col("least")))
        rest = files.stored(rest.drop("least"))
        found = search.ranked(one.drop("rank").unionByName(scored(rest)), limit)
        count = lambda df, name: df.groupBy("query_id").agg(F.sum("n_wanted").alias(name))
        done = weighed.groupBy("query_id").agg(F.count("*").alias("blocks")).join(count(first.unionByName(rest), "opened"), "query_id", "left")
        return found, done.select("query_id", "blocks", F.coalesce("opened", F.lit(0)).cast("long").alias("opened"))

    def frequencies(self, hits: DataFrame, terms: DataFrame) -> DataFrame:
        found = self._read("terms").where(F.col("b").isin(self._buckets_of(terms, "term"))).join(terms, "term", "left_semi")
        return found.groupBy("term").agg(F.sum("df").alias("df"))

    # --- what changes

    def _blocks(self, made: DataFrame, chunks: int, words: int) -> DataFrame:
        """The postings of chunks as blocks: of each term those of the chunks of one range. A range has chunks of like length, dealt by hash so that it holds ``BLOCK`` at most, about.

        Chunks are dealt by range before their terms are listed: a task has whole ranges, and no posting is sent to be grouped.
        """
        splits = max(1, -(-chunks // BLOCK))
        r = F.floor(F.log2(F.col("n_terms") + 1) * FINE) * splits + F.pmod(F.xxhash64("chunk_id"), F.lit(splits))
        dealt = made.select("segment", "path", "ordinal", "heading_path", "n_terms", "tf", r.alias("r")).repartition(max(1, -(-words // SHARE)), "r")
        rows = dealt.select("*", F.explode_outer("tf").alias("x")).where("x is not null").select("segment", "r", "path", "ordinal", "heading_path", "n_terms", "x.term", "x.tf")
        row = F.struct("path", "ordinal", "heading_path", "n_terms", "tf")
        return rows.groupBy("segment", "term", "r").agg(F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("n_terms").alias("min_length"), F.collect_list(row).alias("rows"))

    def _write(self, folder: str, kind: str, df: DataFrame, by: str) -> None:
        """Writes rows by bucket; a large bucket is several tasks', as one term may be in any share of all chunks."""
        dealt = df.withColumn("b", self._bucket(by)).hint("rebalance", F.col("b")).sortWithinPartitions("b", by)
        dealt.select(*T.StructType.fromDDL(SCHEMAS[kind]).names).write.partitionBy("b").parquet(f"{self.root}/{kind}/s={folder}")

    def apply(self, changes: DataFrame, number: int | None = None) -> None:
        """Takes in ``changes`` (path, content, version): notes that are new, changed, emptied (no chunks then) or deleted (content null).

        Of several rows for a path the highest version holds; of equal versions the larger content, a deletion last. ``number`` is the batch's: a batch that is given again, its
        number not above the last one applied, changes nothing.
        """
        m = self.manifest()
        if number is not None and number <= m["applied"]:
            return
        segment, folder = m["next"], f"segment-{m['next']}-{uuid.uuid4().hex[:8]}"
        last = changes.groupBy("path").agg(F.max(F.struct("version", F.col("content").isNotNull().alias("there"), "content")).alias("x"))
        last = files.stored(last.select("path", F.col("x.content").alias("content")))
        made = blks.chunk_rows(last.where("content is not null")).select("path", "chunk_id", "ordinal", "heading_path", "text")
        made = made.withColumn("terms", search._terms(F.col("text"), self.analyzer)).withColumn("n_terms", F.size("terms"))
        self._write(folder, "chunks", made.withColumn("tf", rt.tallied(F.col("terms"))).withColumn("segment", F.lit(segment).cast("long")), "path")
        new = self.spark.read.schema(CHUNKS).parquet(f"{self.root}/chunks/s={folder}")
        if m["segments"]:
            touched = self._buckets_of(last, "path")
            old = self._living(self._read("chunks").where(F.col("b").isin(touched)).join(last.select("path"), "path", "left_semi").select("segment", "path", "n_terms", F.col("tf.term").alias("terms")), touched)
            old = files.stored(old)
        else:
            old = self.spark.createDataFrame([], "segment long, path string, n_terms int, terms array<string>")
        self._write(folder, "graves", old.select("segment", "path").distinct(), "path")
        plus, minus = _total(new), _total(old)
        self._write(folder, "postings", self._blocks(new, plus.n, plus.w), "term")
        listed = self.spark.read.schema(POSTINGS).parquet(f"{self.root}/postings/s={folder}")
        change = listed.select("term", F.col("n").alias("d")).unionByName(old.select(F.explode("terms").alias("term"), F.lit(-1).alias("d")))
        self._write(folder, "terms", change.groupBy("term").agg(F.sum("d").alias("df")).where("df <> 0"), "term")
        m["segments"].append({"id": segment, "folder": folder, "level": 0, "chunks": plus.n - minus.n, "words": plus.w - minus.w})
        self._commit(m | {"next": segment + 1, "applied": m["applied"] if number is None else number})

    def _commit(self, m: dict) -> None:
        self.pointer.put(json.dumps(m))

    def merge(self) -> int:
        """Merges ``fan_in`` segments of a level to one of the next until no level has so many; the number of merges."""
        done = 0
        while True:
            m = self.manifest()
            levels: dict[int, list[dict]] = {}
            for s in m["segments"]:
                levels.setdefault(s["level"], []).append(s)
            full = [level for level, held in sorted(levels.items()) if len(held) >= self.fan_in]
            if not full:
                return done
            parts = levels[full[0]][: self.fan_in]
            ids = [s["id"] for s in parts]
            segment, folder = m["next"], f"segment-{m['next']}-{uuid.uuid4().hex[:8]}"
            here = F.lit(segment).cast("long")
            self._write(folder, "chunks", self._living(self._read("chunks", ids)).withColumn("segment", here), "path")
            made = self.spark.read.schema(CHUNKS).parquet(f"{self.root}/chunks/s={folder}")
            held = _total(made)
            self._write(folder, "postings", self._blocks(made, held.n, held.w), "term")
            # what these segments hid in one another is gone now; what they hide in others stays hidden
            self._write(folder, "graves", self._read("graves", ids).where(~F.col("segment").isin(ids)).select("segment", "path"), "path")
            self._write(folder, "terms", self._read("terms", ids).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), "term")
            merged = {"id": segment, "folder": folder, "level": full[0] + 1} | {k: sum(s[k] for s in parts) for k in ("chunks", "words")}
            self._commit(m | {"next": segment + 1, "segments": [s for s in m["segments"] if s["id"] not in ids] + [merged]})
            done += 1


def _total(made: DataFrame):
    """n, w: how many chunks there are, and how many words they have."""
    return made.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("w")).first()


#: Five batches of changes to the vault, one after the other: all notes, then edits, notes that become empty, deletions, and deleted notes that come back. Both engines read it.
BATCHES = f"""
SELECT path, content, 0 AS batch, mtime AS version FROM vault
UNION ALL SELECT path, replace(replace(content, 'This', 'That'), 'Plain', 'Edited'), 1, mtime FROM vault WHERE mtime % 3 = 0
UNION ALL SELECT path, replace(content, 'uses', 'takes'), 1, mtime - 1 FROM vault WHERE mtime % 6 = 0
UNION ALL SELECT path, '', 2, mtime FROM vault WHERE mtime % 5 = 1
UNION ALL SELECT path, CAST(NULL AS STRING), 3, mtime FROM vault WHERE mtime % 7 = 2
UNION ALL SELECT path, content, 4, mtime FROM vault WHERE mtime % 14 = 2"""
LAST = 4


def changes(spark, d) -> DataFrame:
    """path, content, batch, version of BATCHES over the vault, whose notes are made once. A filter on ``batch`` leaves the other batches unread."""
    vault = files.stored(fx.vault(spark, d).hint("rebalance"))
    return spark.sql(re.sub(r"\bFROM vault\b", "FROM {vault}", BATCHES), vault=vault)


def kept(spark, d) -> Segments:
    """The index after all batches, merged by threes on the way."""
    ix = Segments(spark, files.shared(spark), fan_in=3)
    rows = changes(spark, d)
    for n in range(LAST + 1):
        ix.apply(rows.where(F.col("batch") == n), n)
        ix.merge()
    return ix


def index_segments(spark, d):
    """Terms of the index after edits, empties, deletions and returns, with the chunks that hold them as sums of changes tell, and as living postings do."""
    ix = kept(spark, d)
    told = ix._read("terms").groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    seen = ix._opened(ix._read("postings")).groupBy("term").agg(F.count("*").alias("postings"), F.sum("tf").alias("n"))
    return told.join(seen, "term", "full")


def search_segments(spark, d):
    """BM25 over that index, by postings and summed statistics alone."""
    return search.lexical(kept(spark, d), rt.asked(spark))


def search_topk(spark, d):
    """The five best chunks of each query; ranges that can't hold any of them stay closed."""
    return kept(spark, d).top(rt.asked(spark), 5)[0]


#: The vault after all batches: of each note its last change.
_AFTER = f"old AS ({fx.VAULT}), changed AS ({BATCHES.replace('FROM vault', 'FROM old')}), vault AS (SELECT path, content FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY batch DESC, version DESC) AS k FROM changed) WHERE k = 1 AND content <> '')"
QUERIES = {f.__name__: f for f in (index_segments, search_segments, search_topk)}
ORACLE = {
    "index_segments": f"WITH {_AFTER}, {search.CHUNKS}, t AS (SELECT chunk_id, unnest({rt._TOK.format('text')}) AS term FROM ck) SELECT term, count(DISTINCT chunk_id) AS df, count(DISTINCT chunk_id) AS postings, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1",
    "search_segments": f"WITH {_AFTER}, {search.CHUNKS}, {rt._ASKED}, {rt._TERMS}, {search._BM} SELECT * FROM lex WHERE rank <= 20",
    "search_topk": f"WITH {_AFTER}, {search.CHUNKS}, {rt._ASKED}, {rt._TERMS}, {search._BM} SELECT * FROM lex WHERE rank <= 5",
}
