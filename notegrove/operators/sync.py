"""Sync sessions of a vault: an inventory is told, what is needed is asked for, contents are checked and taken in."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import fixtures as fx
from ..sources import files, tables
from . import vault

NOTES = "path string, hash string, content string, mtime long"


class Refused(Exception):
    """A call that a session doesn't allow; ``missing`` counts the notes that a finish lacks."""

    def __init__(self, why: str, missing: int = 0):
        super().__init__(why)
        self.why, self.missing = why, missing


class Sync:
    """The stored notes of a vault and the session that brings them up to date. One session is open at most; what it knows is in tables, so it outlives the program that began it.

    ``followers`` are functions that get what changed (path, content, version; content null where a note went), such as an index' ``apply``.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 32, followers=()):
        self.spark, self.root, self.followers = spark, root.rstrip("/"), followers
        self.notes = tables.Buckets(spark, f"{self.root}/notes", NOTES, "path", buckets)
        self.pointer = files.Pointer(spark, self.root, "SESSION")

    # --- the session's state: its id, the folders of its inventory, those of what it asked for and has been sent

    def _open(self, session: str) -> dict:
        text = self.pointer.get()
        if not text:
            raise Refused("no session")
        s = json.loads(text)
        if s["id"] != session:
            raise Refused("another session is open")
        return s

    def _save(self, s: dict) -> None:
        self.pointer.put(json.dumps(s))

    def _keep(self, df: DataFrame) -> str:
        at = f"{self.root}/session/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return at

    def begin(self, rebuild: bool = False) -> str:
        """The id of a new session; one that was open is abandoned, which undoes nothing. ``rebuild`` forgets all notes first."""
        if rebuild:
            self._tell(self.notes.read().select("path", F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("mtime")))
            self.notes.replace(self.spark.createDataFrame([], NOTES), self.notes.read())
        session = uuid.uuid4().hex
        self._save({"id": session, "inventory": [], "asked": None, "sent": [], "told": -1})
        return session

    def batch(self, session: str, inventory: DataFrame) -> int:
        """Takes in a part (path, hash, mtime) of the inventory; how many rows. A path that is told again counts as it was told last."""
        s = self._open(session)
        s["inventory"].append(self._keep(inventory.select("path", "hash", F.col("mtime").cast("long").alias("mtime"), F.lit(len(s["inventory"])).alias("part"))))
        self._save(s)
        return self.spark.read.parquet(s["inventory"][-1]).count()

    def _inventory(self, s: dict) -> DataFrame:
        if not s["inventory"]:
            return self.spark.createDataFrame([], "path string, hash string, mtime long")
        rows = self.spark.read.schema("path string, hash string, mtime long, part int").parquet(*s["inventory"])
        return rows.groupBy("path").agg(F.max(F.struct("part", "hash", "mtime")).alias("x")).select("path", "x.hash", "x.mtime")

    def commit(self, session: str) -> DataFrame:
        """path, status, action, moved_from: the inventory against the notes. Renamed notes are moved and deleted ones removed at once; the paths to fetch are asked for."""
        s = self._open(session)
        found, state = self._inventory(s), self.notes.read()
        plan = vault.planned(state.select("path", "hash"), found.select("path", "hash"))
        plan = self.spark.read.schema(plan.schema).parquet(self._keep(plan))
        moved = plan.where("action = 'move'").select("path", F.col("moved_from").alias("old"))
        came = moved.join(state.select(F.col("path").alias("old"), "content"), "old").join(found, "path").select("path", "hash", "content", "mtime")
        gone = plan.where("action in ('moved', 'delete')").select("path")
        came = files.stored(came)
        self.notes.replace(came, gone)
        self._tell(came.select("path", "content", "mtime").unionByName(gone.select("path", F.lit(None).cast("string").alias("content"), F.lit(0).cast("long").alias("mtime"))))
        s["asked"], s["sent"] = self._keep(plan.where("action = 'fetch'").select("path")), []
        self._save(s)
        return plan

    def _waiting(self, s: dict) -> DataFrame:
        if not s["asked"]:
            return self.spark.createDataFrame([], "path string")
        asked = self.spark.read.schema("path string").parquet(s["asked"])
        return asked.join(self.spark.read.schema("path string").parquet(*s["sent"]), "path", "left_anti") if s["sent"] else asked

    def note(self, session: str, sent: DataFrame) -> DataFrame:
        """path, outcome of each note sent (path, hash, content, mtime): taken, or why it is refused. Only paths that were asked for and haven't come yet are taken, with content that has the hash declared.

        Of several rows for a path one is judged: a good one, if there is one, the largest by content. What was taken is stored before this returns.
        """
        s = self._open(session)
        good = F.sha2("content", 256) == F.col("hash")
        one = sent.groupBy("path").agg(F.max(F.struct(F.coalesce(good, F.lit(False)).alias("good"), "content", "hash", F.col("mtime").cast("long").alias("mtime"))).alias("x")).select("path", "x.*")
        judged = one.join(self._waiting(s).withColumn("asked", F.lit(True)), "path", "left")
        why = F.when(F.col("asked").isNull(), "not requested").when(F.col("content").isNull(), "content is required").when(~F.col("good"), "hash mismatch").otherwise("taken")
        judged = files.stored(judged.withColumn("outcome", why))
        taken = judged.where("outcome = 'taken'")
        self.notes.replace(taken.select("path", "hash", "content", "mtime"))
        self._tell(taken.select("path", "content", "mtime"))
        s["sent"].append(self._keep(taken.select("path")))
        self._save(s)
        return judged.select("path", "outcome")

    def finish(self, session: str) -> int:
        """Closes the session; the number of notes. Refused while notes that were asked for haven't come: the session stays open then."""
        s = self._open(session)
        missing = self._waiting(s).count()
        if missing:
            raise Refused(f"{missing} requested notes were not sent", missing)
        self.pointer.drop()
        return self.notes.read().count()

    def _tell(self, changes: DataFrame) -> None:
        for f in self.followers:
            f(changes.withColumnRenamed("mtime", "version"))


def sync_session(spark, d):
    """Two sessions over the orders' files: the first is abandoned; of the second what each path is told at commit, what becomes of the notes sent (every fifth with a wrong hash, and of
    all files, asked for or not), of those sent again, and what is stored in the end. Refused calls are rows without a path."""
    state, inventory = fx.sql(spark, d, _STATE), files.stored(fx.sql(spark, d, _INVENTORY))
    at = Sync(spark, files.shared(spark))
    first = at.begin()
    at.notes.replace(state.select("path", F.sha2("content", 256).alias("hash"), "content", F.lit(0).cast("long").alias("mtime")))
    steps = []

    def tried(step: int, call) -> None:
        try:
            said = f"notes: {call()}"
        except Refused as e:
            said = e.why
        steps.append((step, None, said))

    listed = inventory.select("path", F.sha2("content", 256).alias("hash"), F.lit(1).alias("mtime"))
    at.batch(first, listed.limit(3))
    second = at.begin()
    tried(1, lambda: at.batch(first, listed))
    even = F.pmod(F.length("path"), F.lit(2)) == 0
    at.batch(second, listed.where(even).withColumn("hash", F.lit("stale")))
    at.batch(second, listed.where(~even))
    at.batch(second, listed.where(even))
    plan = at.commit(second).select(F.lit(2).alias("step"), "path", F.col("action").alias("outcome"))
    sent = inventory.withColumn("mtime", F.lit(1)).withColumn("hash", F.when(F.col("k") % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("content", 256)))
    one = at.note(second, sent).withColumn("step", F.lit(3))
    tried(4, lambda: at.finish(second))
    two = at.note(second, sent.where("k % 5 = 0").withColumn("hash", F.sha2("content", 256))).withColumn("step", F.lit(5))
    tried(6, lambda: at.finish(second))
    tried(7, lambda: at.finish(second))
    left = at.notes.read().select(F.lit(8).alias("step"), "path", F.col("content").alias("outcome"))
    return plan.unionByName(one).unionByName(two).unionByName(left).unionByName(spark.createDataFrame(steps, "step int, path string, outcome string"))


_STATE = "SELECT 'Orders/O' || o_orderkey || '.md' AS path, 'order ' || o_orderkey || ' v1' AS content FROM orders WHERE o_orderkey % 17 <> 0"
_INVENTORY = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'Archive/O' ELSE 'Orders/O' END || o_orderkey || '.md' AS path,
 'order ' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN ' v2' ELSE ' v1' END AS content FROM orders WHERE o_orderkey % 11 <> 0"""
QUERIES = {"sync_session": sync_session}
ORACLE = {
    "sync_session": f"""WITH o AS ({_STATE}), i AS ({_INVENTORY}),
j AS (SELECT coalesce(o.path, i.path) AS path, k, o.content AS old, i.content AS new FROM o FULL JOIN i ON o.path = i.path),
gone AS (SELECT old, min(path) AS path FROM j WHERE new IS NULL GROUP BY old HAVING count(*) = 1), came AS (SELECT new, min(path) AS path FROM j WHERE old IS NULL GROUP BY new),
moves AS (SELECT gone.path AS a, came.path AS b FROM gone JOIN came ON old = new),
plan AS (SELECT j.path, k, new, CASE WHEN path IN (SELECT b FROM moves) THEN 'move' WHEN path IN (SELECT a FROM moves) THEN 'moved' WHEN old IS NULL OR old <> new THEN CASE WHEN new IS NULL THEN 'delete' ELSE 'fetch' END WHEN new IS NULL THEN 'delete' ELSE 'keep' END AS action FROM j),
missing AS (SELECT count(*) AS n FROM plan WHERE action = 'fetch' AND k % 5 = 0)
SELECT 1 AS step, NULL AS path, 'another session is open' AS outcome
UNION ALL SELECT 2, path, action FROM plan
UNION ALL SELECT 3, path, CASE WHEN action <> 'fetch' THEN 'not requested' WHEN k % 5 = 0 THEN 'hash mismatch' ELSE 'taken' END FROM plan WHERE new IS NOT NULL
UNION ALL SELECT 4, NULL, n || ' requested notes were not sent' FROM missing WHERE n > 0
UNION ALL SELECT 5, path, CASE WHEN action = 'fetch' THEN 'taken' ELSE 'not requested' END FROM plan WHERE new IS NOT NULL AND k % 5 = 0
UNION ALL SELECT 6, NULL, 'notes: ' || count(*) FROM i UNION ALL SELECT 7, NULL, 'no session'
UNION ALL SELECT 8, path, content FROM i""",
}
