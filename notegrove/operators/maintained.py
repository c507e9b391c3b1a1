"""What is derived from notes, kept up to date by changes: claims, relations, mentions, entities, links and memories as tables by buckets."""

from __future__ import annotations

from concurrent import futures

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..sources import files, tables
from . import memory, segments
from . import knowledge as kn

NOTES = "path string, title string, mtime long, names array<string>, targets array<string>, mentioned array<string>"
CLAIMS = "path string, offset long, subject string, predicate string, object string, claim_type string, polarity int, confidence double, claim_id string"
RELATIONS = "path string, source string, relation string, target string"
MENTIONS = "key string, path string, mtime long, ord int, name string, kind string, k int"
ENTITIES = "key string, canonical_name string, type string, first_seen long, last_seen long, source_count long"
NAMES = "key string, path string"
LINKS = "key string, path string, target string, resolved string"
#: Of a note: the names that links may know it by, the keys that its links point to, and those that it mentions.
KEYS = ["names", "targets", "mentioned"]
MEMORIES = "path string, content string, type string, excerpt string, claim_id string, status string"


class Knowledge:
    """The tables of a vault; ``apply`` brings them to what they would be if all notes were read anew, reading and writing only what the changes touch.

    - By note (``claims``, ``relations``, ``memories``, ``notes``): rows of the notes that changed give way to new ones.
    - By name (``mentions``, ``entities``, ``names``, ``links``): a note's old and new names say which buckets of keys change. A note mentions a key once, by its first name for it; entities are counted anew in
      these buckets only, in the same way links are resolved there (those that are new, and those to a name that a note got or lost). Of notes with one name the smallest path counts, so losing it falls back to the next.
    - A memory stays with its status when its claim is found again, and gets the new claim; one whose claim is gone stays without. Notes that are deleted lose all but their memories.

    Sentences are judged once, and tables that don't need one another are written side by side; ``notes`` come last.

    Batches have numbers; one that is given again, after a crash say, does what is left of it: each table knows which batch it has. ``touched`` holds the buckets that the last batch wrote, by table.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.touched = spark, {}
        by = lambda name, schema, key: tables.Buckets(spark, f"{root.rstrip('/')}/{name}", schema, key, buckets)
        self.notes, self.claims, self.relations, self.memories = by("notes", NOTES, "path"), by("claims", CLAIMS, "path"), by("relations", RELATIONS, "path"), by("memories", MEMORIES, "path")
        self.mentions, self.entities, self.names, self.links = by("mentions", MENTIONS, "key"), by("entities", ENTITIES, "key"), by("names", NAMES, "key"), by("links", LINKS, "key")

    def apply(self, changes: DataFrame, number: int | None = None) -> None:
        """Takes in ``changes`` (path, content, version): notes that are new or changed, or deleted (content null). Of several rows for a path the highest version holds, of equal ones the larger content."""
        t = self.touched = {}
        if number is not None and number <= self.notes.manifest()["applied"]:
            return
        last = changes.groupBy("path").agg(F.max(F.struct("version", F.col("content").isNotNull().alias("there"), "content")).alias("x"))
        last = files.stored(last.select("path", F.col("x.content").alias("content"), F.col("x.version").cast("long").alias("mtime")))
        paths = last.select("path")
        at = self.notes.touched(paths)
        new = md.parsed(last.where("content is not null")).select("path", "content", "title", "mtime", "tags", "links")
        new = files.stored(new.withColumns({"names": kn.called(), "targets": F.array_distinct(F.transform("links", lambda x: F.lower(x))), "mentioned": kn.mentioned()}))
        judged = files.stored(kn.judged(new).drop("links"))
        was = self.notes.read(at).join(paths, "path", "left_semi").select("path", *[F.col(c).alias(f"old_{c}") for c in KEYS])
        both = new.select("path", *KEYS).join(was, "path", "full")
        both = both.select("path", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for k in KEYS for c in (k, f"old_{k}")])
        both = files.stored(both.withColumns({"lost": F.array_except("old_names", "names"), "got": F.array_except("names", "old_names")}))
        each = lambda c: both.select(F.explode(c).alias("key"), "path")
        said, moved, pointed = self._buckets_of(both, [("mentioned", "old_mentioned"), ("lost", "got"), ("targets", "old_targets", "lost", "got")])
        stay = lambda held: held.join(paths, "path", "left_anti")

        def by_note() -> None:
            claims = kn.claimed(judged)
            t["claims"] = self.claims.update(at, lambda held: stay(held).unionByName(claims.select(*held.columns)), number)
            t["relations"] = self.relations.update(at, lambda held: stay(held).unionByName(kn.related(judged).select(*held.columns)), number)

        def memories() -> None:
            t["memories"] = self._relink(kn.claimed(judged), paths, at, number)

        def mentions() -> None:
            one = kn.candidates(new).groupBy(F.lower("name").alias("key"), "path").agg(F.min(F.struct(F.col("k").cast("int").alias("k"), F.col("ord").cast("int").alias("ord"), "name", "kind", "mtime")).alias("x")).select("key", "path", "x.*")
            t["mentions"] = self.mentions.update(said, lambda held: stay(held).unionByName(one.select(*held.columns)), number)
            first = F.min(F.struct("path", "name", "kind")).alias("x")
            counted = self.mentions.read(said).groupBy("key").agg(first, F.min("mtime").alias("first_seen"), F.max("mtime").alias("last_seen"), F.count("*").alias("source_count"))
            counted = counted.select("key", F.col("x.name").alias("canonical_name"), F.col("x.kind").alias("type"), "first_seen", "last_seen", "source_count")
            t["entities"] = self.entities.update(said, lambda held: counted, number)

        def links() -> None:
            t["names"] = self.names.update(moved, lambda held: held.join(each("lost"), ["key", "path"], "left_anti").unionByName(each("got")), number)
            known = self.names.read(pointed).groupBy("key").agg(F.min("path").alias("resolved"))
            now = new.select("path", F.explode("links").alias("target")).withColumn("key", F.lower("target"))
            t["links"] = self.links.update(pointed, lambda held: stay(held.select("path", "target", "key")).unionByName(now).join(known, "key", "left"), number)

        with futures.ThreadPoolExecutor() as pool:  # tables that don't wait for one another
            for f in [pool.submit(inheritable_thread_target(self.spark)(part)) for part in (mentions, links, by_note, memories)]:
                f.result()
        t["notes"] = self.notes.update(at, lambda held: stay(held).unionByName(new.select(*held.columns)), number)

    def _buckets_of(self, both: DataFrame, groups: list[tuple[str, ...]]) -> list[list[int]]:
        """For each group of columns (lists of keys) the buckets of its keys."""
        bucket = self.names.bucket("key")
        found = F.array(*[F.struct(F.lit(i).alias("i"), F.concat(*g).alias("keys")) for i, g in enumerate(groups)])
        rows = both.select(F.explode(found).alias("x")).select("x.i", F.explode("x.keys").alias("key")).select("i", bucket.alias("b")).distinct().collect()
        return [sorted(r.b for r in rows if r.i == i) for i in range(len(groups))]

    def _relink(self, claims: DataFrame, paths: DataFrame, at: list[int], number: int | None) -> list[int]:
        """Memories of the changed notes: those found again keep their status and get the new claim and excerpt, those not found lose their claim, new ones are candidates."""
        found = memory.candidates(claims, "claim_id").select("path", "content", F.col("type").alias("t"), F.col("excerpt").alias("e"), F.col("claim_id").alias("c"))

        def both(held: DataFrame) -> DataFrame:
            all_ = held.join(paths.withColumn("changed", F.lit(True)), "path", "left").join(found, ["path", "content"], "full")
            seen = F.col("c").isNotNull()
            claim = F.when(seen | F.col("changed").isNotNull(), F.col("c")).otherwise(F.col("claim_id")).alias("claim_id")
            return all_.select("path", "content", F.coalesce("type", "t").alias("type"), F.when(seen, F.col("e")).otherwise(F.col("excerpt")).alias("excerpt"), claim, F.coalesce("status", F.lit("candidate")).alias("status"))

        return self.memories.update(at, both, number)

    def reviewed(self, decisions: DataFrame) -> None:
        """Sets the status of memories by ``decisions`` (path, content, status)."""
        d = files.stored(decisions.groupBy("path", "content").agg(F.max("status").alias("s")))
        self.memories.update(d, lambda held: held.join(d, ["path", "content"], "left").withColumn("status", F.coalesce("s", "status")).drop("s"))


def kept(spark, d) -> Knowledge:
    """The tables after all batches of changes to the vault (``segments.BATCHES``)."""
    k = Knowledge(spark, files.shared(spark))
    rows = segments.changes(spark, d)
    for n in range(segments.LAST + 1):
        k.apply(rows.where(F.col("batch") == n), n)
    return k


def maintained_knowledge(spark, d):
    """kind, a, b, c, n: claims, entities and links (healed where names went or came) as the tables have them after edits, empties, deletions and returns."""
    k = kept(spark, d)
    claims = k.claims.read().select(F.lit("claim").alias("kind"), F.col("path").alias("a"), F.concat_ws(" ", "claim_type", "subject", "predicate").alias("b"), F.col("object").alias("c"), F.col("offset").alias("n"))
    entities = k.entities.read().select(F.lit("entity").alias("kind"), F.col("key").alias("a"), F.concat_ws(" ", "type", "first_seen", "last_seen").alias("b"), F.col("canonical_name").alias("c"), F.col("source_count").alias("n"))
    links = k.links.read().select(F.lit("link").alias("kind"), F.col("path").alias("a"), F.col("target").alias("b"), F.col("resolved").alias("c"), F.lit(None).cast("long").alias("n"))
    return claims.unionByName(entities).unionByName(links)


#: The vault after all batches, emptied notes included, in place of the vault.
_KNOWN = kn.KNOWN.replace(kn.KNOWN[: kn.KNOWN.index(", cut AS")], f"old AS ({segments.fx.VAULT}), changed AS ({segments.BATCHES.replace('FROM vault', 'FROM old')}), vault AS (SELECT path, content, version AS mtime FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY batch DESC, version DESC) AS k FROM changed) WHERE k = 1 AND content IS NOT NULL)", 1)
QUERIES = {"maintained_knowledge": maintained_knowledge}
ORACLE = {
    "maintained_knowledge": f"""WITH {_KNOWN} SELECT 'claim' AS kind, path AS a, claim_type || ' ' || subject || ' ' || predicate AS b, object AS c, "offset" AS n FROM claims
UNION ALL SELECT 'entity', key, type || ' ' || first_seen || ' ' || last_seen, canonical_name, source_count FROM ents UNION ALL SELECT 'link', path, target, resolved, NULL FROM linked""",
}
