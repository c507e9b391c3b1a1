"""Inventories, snapshots and the stored state of a vault."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..plans import fixtures as fx


def inventory_diff(state: DataFrame, inventory: DataFrame) -> DataFrame:
    """path, status: added, modified, deleted or same, by a full outer join of (path, hash) on the path."""
    j = state.select("path", F.col("hash").alias("old")).join(inventory.select("path", F.col("hash").alias("new")), "path", "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "same").otherwise("modified")
    return j.select("path", "old", "new", status.alias("status"))


def renames(diff: DataFrame) -> DataFrame:
    """old_path, new_path: a deleted file whose hash no other deleted file has moved to the first added file with that hash."""
    gone = diff.where("status = 'deleted'").select(F.col("old").alias("hash"), F.col("path").alias("old_path"))
    # of hashes only those with one deleted path count; aggregated before anything is joined
    one = gone.groupBy("hash").agg(F.count("*").alias("n"), F.min("old_path").alias("old_path")).where("n = 1").drop("n")
    came = diff.where("status = 'added'").groupBy(F.col("new").alias("hash")).agg(F.min("path").alias("new_path"))
    return one.join(came, "hash").select("old_path", "new_path")


def _diff(spark, d):
    return inventory_diff(*fx.snapshots(spark, d))


def q_inventory_diff(spark, d):
    return _diff(spark, d).select("path", "status")


def q_renames(spark, d):
    return renames(_diff(spark, d))


def planned(state: DataFrame, inventory: DataFrame) -> DataFrame:
    """path, action, moved_from: what a sync does with each path of ``state`` and ``inventory`` (path, hash): fetch, move (here), moved (away), delete or keep."""
    diff = inventory_diff(state, inventory)
    moved = renames(diff)
    out = diff.join(moved.select(F.col("new_path").alias("path"), F.col("old_path").alias("moved_from")), "path", "left").join(moved.select(F.col("old_path").alias("path"), F.lit(True).alias("moved_away")), "path", "left")
    action = F.when(F.col("moved_from").isNotNull(), "move").when(F.col("moved_away"), "moved").when(F.col("status").isin("added", "modified"), "fetch").when(F.col("status") == "deleted", "delete").otherwise("keep")
    return out.select("path", action.alias("action"), "moved_from")


def sync_plan(spark, d):
    """What a sync does with each path: fetch, move, delete or keep."""
    return planned(*fx.snapshots(spark, d))


def to_fetch(spark, d):
    diff = _diff(spark, d)
    wanted = diff.where("status in ('added', 'modified')").select("path")
    return wanted.join(renames(diff).select(F.col("new_path").alias("path")), "path", "left_anti")


def hash_verify(spark, d):
    """Whether a note's content has the hash declared for it; every seventh declaration is of another text."""
    n = fx.doc_notes(spark, d).withColumn("declared", F.when(F.col("mtime") % 7 == 0, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.sha2("content", 256)))
    return n.select("path", (F.sha2("content", 256) == F.col("declared")).alias("holds"))


def duplicates(notes: DataFrame) -> DataFrame:
    """note, first_note, n: each note that shares its text with others, and the first of them by path. One row for each note: a group of copies isn't expanded into pairs."""
    h = notes.select("path", F.sha2("content", 256).alias("hash"))
    groups = h.groupBy("hash").agg(F.min("path").alias("first_note"), F.count("*").alias("n")).where("n > 1")
    return h.join(groups, "hash").select(F.col("path").alias("note"), "first_note", "n")


def q_duplicates(spark, d):
    return duplicates(fx.doc_notes(spark, d))


def duplicate_groups(spark, d):
    h = fx.doc_notes(spark, d).groupBy(F.sha2("content", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("path").alias("first_note"), F.max("path").alias("last_note"))
    return h.where("n > 1")


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """``new`` rows, and the ``old`` ones whose key isn't among them."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_notes(spark, d):
    v = fx.vault(spark, d).select("path", "content", "mtime")
    fresh = v.where("mtime % 3 = 0").withColumn("content", F.concat("content", F.lit(" edited")))
    return upsert(v.where("mtime % 5 <> 0"), fresh).select("path", F.sha2("content", 256).alias("hash"))


def delete_notes(spark, d):
    """What is left of notes and of their links when the parts divisible by ten go."""
    n = md.parsed(fx.vault(spark, d))
    gone = n.where("path like 'Parts/%' and mtime % 10 = 0").select("path")
    left = n.join(gone, "path", "left_anti")
    links = n.select("path", F.explode("links").alias("target")).join(gone, "path", "left_anti").groupBy("path").agg(F.count("*").alias("n_links"))
    return left.select("path").join(links, "path", "left").select("path", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def rename_notes(spark, d):
    """Stored notes under their new paths; ids are those of the old ones."""
    state, _ = fx.snapshots(spark, d)
    moved = renames(_diff(spark, d)).select(F.col("old_path").alias("path"), "new_path")
    return state.join(moved, "path", "left").select(F.sha2("path", 256).alias("note_id"), F.coalesce("new_path", "path").alias("path"))


def count_active(spark, d):
    return fx.vault(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("path").startswith("Parts/")).alias("parts"))


def state_get(spark, d):
    return md.parsed(fx.vault(spark, d)).select("path", "title", "mtime").orderBy("path")


def settings_latest(spark, d):
    """Settings as last written; an empty value clears one."""
    e = fx.table(spark, d, "events").select(F.concat_ws(".", F.col("user_id").cast("string"), "event_type").alias("key"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_id").cast("string")).alias("value"), "event_id")
    return e.groupBy("key").agg(F.max_by("value", "event_id").alias("value")).where("value <> ''")


def debounce(spark, d):
    """Bursts of each user's events with gaps under an hour, and the last event of each."""
    e = fx.table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("s")).agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id"))["event_id"].alias("last_event")).select("user_id", F.col("s.start").alias("first_ts"), "n", "last_event")


def strict_envelope(spark, d):
    """Whether each request holds allowed keys only, and an integer id."""
    t = fx.table(spark, d, "events").select("event_id", F.expr("""CASE event_id % 4 WHEN 0 THEN '{"id":' || event_id || ',"method":"core.health","params":{}}' WHEN 1 THEN '{"id":' || event_id || ',"metod":"x"}' WHEN 2 THEN '{"id":"a","method":"x"}' ELSE '{"id":' || event_id || ',"result":1}' END""").alias("v"))
    keys = F.json_object_keys("v")
    allowed = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in ("id", "method", "params", "result", "error")]))) == 0
    return t.select("event_id", (allowed & F.expr("schema_of_variant(try_variant_get(try_parse_json(v), '$.id', 'variant')) = 'BIGINT'")).alias("valid"))


_S = f"state AS ({fx.STATE_DUCK}), inventory AS ({fx.INVENTORY_DUCK}), diff AS (SELECT coalesce(s.path, i.path) AS path, s.hash AS old, i.hash AS new, CASE WHEN s.path IS NULL THEN 'added' WHEN i.path IS NULL THEN 'deleted' WHEN s.hash = i.hash THEN 'same' ELSE 'modified' END AS status FROM state s FULL JOIN inventory i ON s.path = i.path)"
_R = _S + ", del AS (SELECT old AS hash, path AS old_path, count(*) OVER (PARTITION BY old) AS n FROM diff WHERE status = 'deleted'), add AS (SELECT new AS hash, path AS new_path, row_number() OVER (PARTITION BY new ORDER BY path) AS k FROM diff WHERE status = 'added'), renames AS (SELECT old_path, new_path FROM del JOIN add USING (hash) WHERE n = 1 AND k = 1)"
_D = f"docs AS ({fx.DOC_NOTES})"
_V = f"vault AS ({fx.VAULT})"
QUERIES = {"inventory_diff": q_inventory_diff, "renames": q_renames, "duplicates": q_duplicates} | {f.__name__: f for f in (sync_plan, to_fetch, hash_verify, duplicate_groups, upsert_notes, delete_notes, rename_notes, count_active, state_get, settings_latest, debounce, strict_envelope)}
ORACLE = {
    "inventory_diff": f"WITH {_S} SELECT path, status FROM diff",
    "renames": f"WITH {_R} SELECT old_path, new_path FROM renames",
    "sync_plan": f"WITH {_R} SELECT path, CASE WHEN a.old_path IS NOT NULL THEN 'move' WHEN b.new_path IS NOT NULL THEN 'moved' WHEN status IN ('added', 'modified') THEN 'fetch' WHEN status = 'deleted' THEN 'delete' ELSE 'keep' END AS action, a.old_path AS moved_from FROM diff LEFT JOIN renames a ON a.new_path = path LEFT JOIN renames b ON b.old_path = path",
    "to_fetch": f"WITH {_R} SELECT path FROM diff WHERE status IN ('added', 'modified') AND path NOT IN (SELECT new_path FROM renames)",
    "hash_verify": f"WITH {_D} SELECT path, sha256(content) = sha256(CASE WHEN mtime % 7 = 0 THEN content || 'x' ELSE content END) AS holds FROM docs",
    "duplicates": f"WITH {_D}, g AS (SELECT path AS note, min(path) OVER (PARTITION BY content) AS first_note, count(*) OVER (PARTITION BY content) AS n FROM docs) SELECT * FROM g WHERE n > 1",
    "duplicate_groups": f"WITH {_D} SELECT sha256(content) AS hash, count(*) AS n, min(path) AS first_note, max(path) AS last_note FROM docs GROUP BY 1 HAVING count(*) > 1",
    "upsert_notes": f"WITH {_V} SELECT path, sha256(CASE WHEN mtime % 3 = 0 THEN content || ' edited' ELSE content END) AS hash FROM vault WHERE mtime % 5 <> 0 OR mtime % 3 = 0",
    "delete_notes": f"WITH {_V} SELECT path, CAST(CASE WHEN path LIKE 'Parts/%' THEN 3 - 1 * CAST(regexp_extract(content, '\\[\\[(Brand [^\\]#]*)', 1) = '' AS INT) WHEN path LIKE 'Suppliers/%' THEN 1 ELSE 0 END AS BIGINT) AS n_links FROM vault WHERE NOT (path LIKE 'Parts/%' AND mtime % 10 = 0)",
    "rename_notes": f"WITH {_R} SELECT sha256(path) AS note_id, coalesce(new_path, path) AS path FROM state LEFT JOIN renames ON old_path = path",
    "count_active": f"WITH {_V} SELECT count(*) AS n, count(*) FILTER (path LIKE 'Parts/%') AS parts FROM vault",
    "state_get": f"WITH {_V} SELECT path, CASE WHEN path LIKE 'Parts/%' THEN 'Part ' || mtime WHEN path LIKE 'Inbox/%' THEN 'C' || mtime WHEN path LIKE 'Nations/%' THEN 'N' || mtime ELSE 'S' || mtime END AS title, mtime FROM vault ORDER BY path",
    "settings_latest": "SELECT key, value FROM (SELECT user_id || '.' || event_type AS key, max_by(CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END, event_id) AS value FROM events GROUP BY 1) WHERE value <> ''",
    "debounce": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first_ts, count(*) AS n, max_by(event_id, (ts, event_id)) AS last_event FROM s GROUP BY user_id, k",
    "strict_envelope": "SELECT event_id, event_id % 4 IN (0, 3) AS valid FROM events",
}
