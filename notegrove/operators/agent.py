"""Proposed changes of notes: checks, plans, and an audit that shows tampering."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import markdown as md
from ..plans import fixtures as fx
from ..sources import files
from . import blocks
from .folds import Machine, folded, named, stepped
from .knowledge import KNOWN

# What each permission allows, and the tools with the permission each needs and whether it changes notes.
POLICY = {"knowledge_read": "allow", "knowledge_search": "allow", "memory_read": "allow", "memory_propose": "allow", "vault_read": "allow", "memory_write": "confirm", "vault_create": "confirm", "vault_modify": "confirm", "vault_move": "confirm", "vault_delete": "denied"}
TOOLS = [
    ("vault.search", "knowledge_search", False), ("vault.read", "knowledge_read", False), ("vault.create", "vault_create", True), ("vault.edit", "vault_modify", True), ("vault.move", "vault_move", True),
    ("vault.delete", "vault_delete", True), ("knowledge.search", "knowledge_search", False), ("memory.search", "memory_read", False), ("relationship.find", "knowledge_search", False),
    ("contradiction.find", "memory_read", False), ("operation.preview", "knowledge_read", False), ("operation.rollback", "vault_modify", True), ("audit.read", "knowledge_read", False),
]

#: Files of operations made of orders: one operation for each customer.
FILES = """SELECT o_custkey AS op, o_orderkey AS k, 'Orders/O' || o_orderkey || '.md' AS path,
 CASE WHEN o_orderkey % 97 = 0 THEN 'delete' WHEN o_orderkey % 4 = 0 THEN 'create' WHEN o_orderkey % 4 = 2 THEN 'move' ELSE 'edit' END AS action,
 'order ' || o_orderkey || ' v1' AS old_content, 'order ' || o_orderkey || CASE WHEN o_orderkey % 9 = 0 THEN ' v1' ELSE ' v2' END AS content,
 'Archive/O' || o_orderkey || '.md' AS new_path FROM orders"""
#: The files' present contents: some changed since, some are gone.
NOW = "SELECT 'Orders/O' || o_orderkey || '.md' AS path, 'order ' || o_orderkey || CASE WHEN o_orderkey % 11 = 0 THEN ' v9' ELSE ' v1' END AS now FROM orders WHERE o_orderkey % 13 <> 0 AND o_orderkey % 4 <> 0"


def prepare(files: DataFrame) -> DataFrame:
    """op, n_files, risk, error: an operation is refused for its first fault: a deletion, an edit that changes nothing, a path twice."""
    twice = F.count("*").over(W.partitionBy("op", "path")) > 1
    fault = F.when(F.col("action") == "delete", "delete is disabled").when((F.col("action") == "edit") & (F.col("old_content") == F.col("content")), "edit changes nothing").when(twice, "duplicate file")
    f = files.withColumn("fault", fault)
    g = f.groupBy("op").agg(F.count("*").alias("n_files"), F.bool_or(F.col("action") == "move").alias("moves"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("path"))).alias("error"))
    return g.select("op", "n_files", F.when((F.col("n_files") > 3) | F.col("moves"), "medium").otherwise("low").alias("risk"), "error")


def version_check(files: DataFrame, now: DataFrame) -> DataFrame:
    """op, path, conflict: files whose present state is not what the operation was made for. Any conflict stops the whole operation."""
    j = files.join(now, "path", "left")
    same = F.sha2("now", 256) == F.sha2("old_content", 256)
    conflict = F.when(F.col("action") == "create", F.when(F.col("now").isNotNull(), "exists")).otherwise(F.when(F.col("now").isNull(), "missing").when(~same, "changed"))
    return j.select("op", "path", "action", conflict.alias("conflict"))


def _files(spark, d):
    return fx.sql(spark, d, FILES)


def op_prepare(spark, d):
    return prepare(_files(spark, d))


def op_version_check(spark, d):
    c = version_check(_files(spark, d).where("action <> 'delete'"), fx.sql(spark, d, NOW))
    return c.groupBy("op").agg(F.bool_and(F.col("conflict").isNull()).alias("may_run"), F.count("conflict").alias("conflicts"))


def misapplied(files: DataFrame) -> DataFrame:
    """op, failures: operations whose applied files (op, path, content, seen) don't hold what was meant, with those files in order."""
    bad = files.where(~F.sha2(F.coalesce("seen", F.lit("")), 256).eqNullSafe(F.sha2("content", 256)))
    return bad.groupBy("op").agg(F.array_join(F.array_sort(F.collect_list("path")), "; ").alias("failures"))


def rollback(files: DataFrame, states: DataFrame, now: DataFrame) -> DataFrame:
    """op, path, undo, to_path, content, refused: instructions that undo each file's change, in operations (op, status) that were executed only.

    What was created is taken back, edits get their old text, moves go back; a file whose present text (``now``: path, now) isn't what the operation left is refused.
    """
    f = files.where("action <> 'delete'").join(states.where("status = 'executed'").select("op"), "op", "left_semi")
    f = f.withColumn("at", F.when(F.col("action") == "move", F.col("new_path")).otherwise(F.col("path")))
    j = f.join(now.select(F.col("path").alias("at"), "now"), "at", "left")
    left = F.when(F.col("action") == "move", F.col("old_content")).otherwise(F.col("content"))
    refused = F.when(F.col("now").isNull(), "missing").when(F.sha2("now", 256) != F.sha2(left, 256), "changed")
    undo = F.when(F.col("action") == "create", "remove").when(F.col("action") == "move", "move").otherwise("edit")
    return j.select("op", F.col("at").alias("path"), undo.alias("undo"), F.when(F.col("action") == "move", F.col("path")).alias("to_path"), F.when(F.col("action") == "edit", F.col("old_content")).alias("content"), refused.alias("refused"))


#: What files look like after the operations: every seventh was written wrongly, every eleventh changed or went since.
APPLIED = """SELECT CASE WHEN o_orderkey % 4 = 2 THEN 'Archive/O' ELSE 'Orders/O' END || o_orderkey || '.md' AS path,
 CASE WHEN o_orderkey % 7 = 0 THEN 'order ' || o_orderkey || ' v2?' WHEN o_orderkey % 4 = 2 OR o_orderkey % 9 = 0 THEN 'order ' || o_orderkey || ' v1' ELSE 'order ' || o_orderkey || ' v2' END AS now FROM orders WHERE o_orderkey % 11 <> 0"""


def op_verify(spark, d):
    """Operations whose applied files don't have the expected hashes, with those files."""
    f = _files(spark, d).where("action in ('create', 'edit')")
    return misapplied(f.join(fx.sql(spark, d, APPLIED).withColumnRenamed("now", "seen"), "path", "left"))


def op_rollback(spark, d):
    """How operations are undone; those of customers divisible by three were never executed."""
    f = _files(spark, d)
    states = f.select("op").distinct().withColumn("status", F.when(F.col("op") % 3 == 0, "approved").otherwise("executed"))
    return rollback(f, states, fx.sql(spark, d, APPLIED))


def op_list(spark, d):
    """Operations, newest first by their highest order, with their files in order."""
    f = _files(spark, d)
    return f.groupBy("op").agg(F.max("k").alias("newest"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "action"))), lambda x: x["action"]), ",").alias("actions")).orderBy(F.desc("newest")).limit(100)


#: States of operations, and what actions make of them.
OPERATION = Machine(
    ["pending", "approved", "rejected", "executed", "rolled_back"],
    {"approve": {"pending": "approved"}, "reject": {"pending": "rejected"}, "execute": {"approved": "executed"}, "rollback": {"executed": "rolled_back"}},
)


def op_transitions(spark, d):
    """Last approval and state of each operation: a log of events replayed; only pending ones are approved or rejected, only approved ones run, only run ones are rolled back."""
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("op"), "ts", "event_id", F.element_at(F.array(*[F.lit(a) for a in ("approve", "reject", "execute", "rollback")]), (F.col("event_id") % 4 + 1).cast("int")).alias("action"))
    return folded(e, "op", OPERATION).select("op", named(OPERATION.states).alias("status"))


def decided(operations: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``operations`` (op, status, ...) after one decision for each (op, action: approve, reject, execute or rollback), and the decisions with what became of them (op, was, status, refused)."""
    said = stepped(operations, "op", OPERATION, decisions)
    after = operations.join(said.where("not refused").select("op", F.col("status").alias("_new")), "op", "left")
    return after.withColumn("status", F.coalesce("_new", "status")).drop("_new").select(*operations.columns), said


def agent_tools(spark, d):
    t = spark.createDataFrame(TOOLS, "name string, permission string, mutates boolean")
    p = spark.createDataFrame(list(POLICY.items()), "permission string, decision string")
    return t.join(F.broadcast(p), "permission").select("name", "permission", "mutates", "decision")  # ten fixed rows


def gated(calls: DataFrame) -> DataFrame:
    """``calls`` (tool, approved, ...) with ``decision``: run, needs approval, denied, or unknown tool. Tools that change notes run only if a user approved the call; some never do."""
    spark = calls.sparkSession
    t = spark.createDataFrame(TOOLS, "tool string, permission string, mutates boolean").join(spark.createDataFrame(list(POLICY.items()), "permission string, policy string"), "permission")
    j = calls.join(F.broadcast(t.select("tool", "policy")), "tool", "left")  # ten fixed rows or so
    how = F.when(F.col("policy").isNull(), "unknown tool").when(F.col("policy") == "denied", "denied").when((F.col("policy") == "confirm") & ~F.coalesce("approved", F.lit(False)), "needs approval").otherwise("run")
    return j.withColumn("decision", how).drop("policy")


def tool_calls(spark, d):
    """Events as calls of tools, every third approved; what becomes of them, by user and tool."""
    names = F.array(*[F.lit(n) for n in [*(n for n, _, _ in TOOLS), "vault.format"]])
    e = fx.table(spark, d, "events").select("user_id", F.element_at(names, (F.col("event_id") % (len(TOOLS) + 1) + 1).cast("int")).alias("tool"), (F.col("event_id") % 3 == 0).alias("approved"))
    return gated(e).groupBy("user_id", "tool", "decision").agg(F.count("*").alias("n"))


def chain(events: DataFrame) -> DataFrame:
    """user_id, event_id, previous_hash, new_hash: each user's events in order, every hash made over the one before.

    A chain is sequential by nature: a user's events pass in order through one task, which holds a batch and the last hash. Users run side by side.
    """
    schema = T.StructType([events.schema["user_id"], events.schema["event_id"], T.StructField("previous_hash", T.StringType()), T.StructField("new_hash", T.StringType())])

    def run(batches):
        user, last = None, ""
        for b in batches:
            before, after = [], []
            for u, e, kind in zip(*(c.to_pylist() for c in b.columns)):
                if u != user:
                    user, last = u, ""
                before.append(last)
                last = hashlib.sha256("|".join([last, "agent", *([kind] if kind is not None else []), "", "ok", str(e)]).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(before, pa.string()), pa.array(after, pa.string())], names=schema.names)

    e = events.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return e.select("user_id", "event_id", "event_type").mapInArrow(run, schema)


def listed(log: DataFrame, most: int = 100) -> DataFrame:
    """The newest ``most`` entries of an audit log, oldest of them first."""
    newest = log.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)
    return newest.orderBy("ts", "event_id")


def audit_list(spark, d):
    return listed(fx.table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"))


def audit_chain(spark, d):
    return chain(fx.table(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("new_hash", F.struct(F.col("event_id"))).alias("some_hash"), F.min("new_hash").alias("least_hash"))


def verify(chained: DataFrame, events: DataFrame) -> DataFrame:
    """user_id, holds: whether each event's hash is made over the one before, and is what its contents give.

    Events are dealt by ranges of (user, time), so a chain with very many of them is checked by as many tasks as it takes; each says whether its part holds, and with which hash the
    part begins and ends. Only these, one for each part of a chain, are put in order and compared.
    """
    order = F.struct("ts", "event_id")
    j = chained.join(events.select("user_id", "event_id", "ts", "event_type"), ["user_id", "event_id"])
    j = j.repartitionByRange("user_id", "ts", "event_id").withColumn("place", F.spark_partition_id())
    w = W.partitionBy("user_id", "place").orderBy("ts", "event_id")
    again = F.sha2(F.concat_ws("|", "previous_hash", F.lit("agent"), "event_type", F.lit(""), F.lit("ok"), F.col("event_id").cast("string")), 256)
    j = j.withColumn("ok", (F.coalesce(F.lag("new_hash").over(w), F.col("previous_hash")) == F.col("previous_hash")) & (again == F.col("new_hash")))
    # ranges are in order, so the number of a partition is the place of its part
    parts = j.groupBy("user_id", "place").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"), F.min_by("previous_hash", order).alias("head"), F.max_by("new_hash", order).alias("tail"))
    joint = F.coalesce(F.lag("tail").over(W.partitionBy("user_id").orderBy("place")), F.lit("")) == F.col("head")
    return parts.withColumn("joint", F.coalesce(joint, F.lit(False))).groupBy("user_id").agg(F.bool_and(F.col("ok") & F.col("joint")).alias("holds"))


def audit_verify(spark, d):
    """Chains of users divisible by five have had one event's hash changed."""
    e = fx.table(spark, d, "events")
    c = chain(e)
    bad = e.where("user_id % 5 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id")).withColumn("bad", F.lit(True))
    c = c.join(bad, ["user_id", "event_id"], "left")
    return verify(c.withColumn("new_hash", F.when(F.col("bad"), F.sha2("new_hash", 256)).otherwise(F.col("new_hash"))).drop("bad"), e)


#: Lines after which a preview stops.
SHOWN = 40


def previewed(texts: DataFrame, most: int = SHOWN) -> DataFrame:
    """path, k, kind, line of ``texts`` (path, old, new), compared line by line: ``context`` where both are equal, else the old one as ``delete`` and the new one as ``add``, each with its mark.

    The preview stops when it has ``most`` lines; both lines of a pair are shown. A file that is made (old null) shows all its lines; a null new text is empty.
    """
    lines = lambda c: F.split(F.coalesce(c, F.lit("")), "\n")
    z = F.arrays_zip(lines(F.col("old")).alias("a"), lines(F.col("new")).alias("b"))
    one = lambda kind, mark, line, i: F.struct(i.alias("i"), F.lit(kind).alias("kind"), F.concat(F.lit(mark), line).alias("line"))
    pair = lambda x, i: F.array_compact(F.array(F.when(x["a"].isNotNull(), one("delete", "- ", x["a"], i)), F.when(x["b"].isNotNull(), one("add", "+ ", x["b"], i))))
    of = lambda x, i: F.when(x["a"].eqNullSafe(x["b"]), F.array(one("context", "  ", x["a"], i))).otherwise(pair(x, i))
    made = F.transform(lines(F.col("new")), lambda x, i: one("add", "+ ", x, i))
    every = F.when(F.col("old").isNull() & F.col("new").isNotNull(), made).otherwise(F.flatten(F.transform(z, of)))
    t = texts.select("path", F.col("old").isNull().alias("made"), every.alias("all"))
    last = F.get("all", F.lit(most - 1))["i"]
    t = t.select("path", F.posexplode(F.when(F.col("made") | (F.size("all") <= most), F.col("all")).otherwise(F.filter("all", lambda x: x["i"] <= last))).alias("k", "x"))
    return t.select("path", (F.col("k") + 1).alias("k"), "x.kind", "x.line")


def line_diff(spark, d):
    """Previews of a change of words in all documents; every tenth is made anew."""
    n = fx.doc_notes(spark, d).select("path", F.when(F.col("mtime") % 10 != 0, F.col("content")).alias("old"), F.regexp_replace("content", "the|und|les", "that").alias("new"))
    return previewed(n)


def planned(notes: DataFrame, request: str, merge: list[str] | None = None, into: str | None = None, link: str | None = None) -> DataFrame:
    """goal, path, new_content: the edits of the first kind that a request names: a merge (of the notes ``merge`` into ``into``), links to ``link``, else missing headings.

    A request is refused with an error if it is blank, names notes that aren't there or nothing besides the target, or gives nothing to do. The note ``into`` and the sources stay.
    """
    if not request.strip():
        raise ValueError("request must not be empty")
    if into is not None and merge is not None:
        sources = [p for p in dict.fromkeys(merge) if p != into]
        there = {r.path for r in notes.where(F.col("path").isin([into, *sources])).select("path").collect()}  # as many as the request names
        if into not in there:
            raise ValueError(f"merge target not found: {into}")
        if not sources:
            raise ValueError("merge needs at least one source besides the target")
        if lost := [p for p in sources if p not in there]:
            raise ValueError(f"merge source not found: {lost[0]}")
        found, nothing = merged(notes, sources, into), "nothing to merge"
    elif link is not None:
        base = link.removesuffix(".md").rsplit("/", 1)[-1]
        named = notes.where(F.lower("content").contains(base.lower()) & (F.col("path") != link))
        if named.isEmpty():
            raise ValueError(f"no indexed notes mention {link}; nothing to link")
        found, nothing = linked(notes, base), "all candidate notes already link to the target"
    else:
        found, nothing = headed(notes), "no organization opportunities found; the vault looks tidy"
    found = files.stored(found.select(F.lit(request).alias("goal"), "path", "new_content"))
    if found.isEmpty():
        raise ValueError(nothing)
    return found


def plan_requests(spark, d):
    """Plans of requests upon the whole vault, one of each kind, and what refused ones are told."""
    v = files.stored(fx.vault(spark, d))
    asked = [("fold", {"merge": ["Suppliers/S2.md", "Suppliers/S1.md"], "into": "Suppliers/S1.md"}), ("link", {"link": "Nations/N1.md"}), ("tidy", {}), (" ", {}), ("fold none", {"merge": ["Suppliers/S1.md"], "into": "Suppliers/S1.md"}), ("fold lost", {"merge": ["No.md"], "into": "Suppliers/S1.md"}), ("link none", {"link": "zzz-nowhere"}), ("both", {"merge": ["x"], "into": "No.md", "link": "N1"})]
    out, told = None, []
    for request, how in asked:
        try:
            one = planned(v, request, **how).select(F.col("goal").alias("request"), "path", "new_content")
            out = one if out is None else out.unionByName(one)
        except ValueError as e:
            told.append((request, None, str(e)))
    return out.unionByName(spark.createDataFrame(told, "request string, path string, new_content string"))


def merged(notes: DataFrame, paths: list[str], into: str) -> DataFrame:
    """path, new_content: the edit that folds the notes ``paths`` into one of them; the others stay."""
    c = blocks.chunk_rows(notes.where(F.col("path").isin([*paths, into])))
    t = c.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n\n").alias("content"))
    part = F.concat(F.lit("\n\n## From "), md.stem(F.col("path")), F.lit("\n\n"), F.trim("content"))
    body = t.where(F.col("path") != into).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", part.alias("p")))), lambda x: x["p"]), "").alias("body"))
    return t.where(F.col("path") == into).crossJoin(body).select("path", F.concat(F.rtrim("content"), F.lit("\n"), "body").alias("new_content"))


def linked(notes: DataFrame, target: str, most: int = 5) -> DataFrame:
    """path, new_content: ``most`` notes that name ``target`` without linking to it, each with a link added. The target's own note is none of them."""
    link = f"[[{target}]]"
    t = notes.where(F.lower("content").contains(target.lower()) & ~F.contains("content", F.lit(link)) & (F.lower(md.stem(F.col("path"))) != target.lower()))
    return t.orderBy("path").limit(most).select("path", F.concat(F.rtrim("content"), F.lit(f"\n\nRelated: {link}")).alias("new_content"))


def headed(notes: DataFrame, most: int = 5, among: int = 100) -> DataFrame:
    """path, new_content: of the first ``among`` notes ``most`` without a first-level heading, each with its title added."""
    n = md.parsed(notes.orderBy("path").limit(among)).where(~F.col("content").rlike(r"(^|\n)[ \t]*# "))
    return n.orderBy("path").limit(most).select("path", F.concat(F.lit("# "), "title", F.lit("\n\n"), F.ltrim("content")).alias("new_content"))


def plan_merge(spark, d):
    return merged(fx.vault(spark, d), [f"Suppliers/S{k}.md" for k in (1, 2, 3)], "Suppliers/S1.md")


def plan_link(spark, d):
    return linked(fx.vault(spark, d).where("path like 'Suppliers/%'"), "N1")


def plan_metadata(spark, d):
    return headed(fx.vault(spark, d))


_ORDER = f"f AS ({FILES})"
_CHAIN = """RECURSIVE o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, '' AS h FROM (SELECT DISTINCT user_id FROM o) UNION ALL SELECT o.user_id, o.i, o.event_id, sha256(c.h || '|agent|' || o.event_type || '||ok|' || o.event_id) FROM c JOIN o ON o.user_id = c.user_id AND o.i = c.i + 1)"""
_S = "SELECT path, content FROM vault WHERE path LIKE 'Suppliers/%'"
QUERIES = {f.__name__: f for f in (op_prepare, op_version_check, op_verify, op_rollback, op_list, op_transitions, agent_tools, tool_calls, audit_chain, audit_verify, audit_list, line_diff, plan_requests, plan_merge, plan_link, plan_metadata)}
ORACLE = {
    "op_prepare": f"WITH {_ORDER}, x AS (SELECT *, CASE WHEN action = 'delete' THEN 'delete is disabled' WHEN action = 'edit' AND old_content = content THEN 'edit changes nothing' END AS fault FROM f) SELECT op, count(*) AS n_files, CASE WHEN count(*) > 3 OR bool_or(action = 'move') THEN 'medium' ELSE 'low' END AS risk, min_by(fault, path) FILTER (fault IS NOT NULL) AS error FROM x GROUP BY op",
    "op_version_check": f"WITH {_ORDER}, n AS ({NOW}), c AS (SELECT op, CASE WHEN action = 'create' THEN CASE WHEN now IS NOT NULL THEN 'exists' END WHEN now IS NULL THEN 'missing' WHEN now <> old_content THEN 'changed' END AS conflict FROM f LEFT JOIN n USING (path) WHERE action <> 'delete') SELECT op, bool_and(conflict IS NULL) AS may_run, count(conflict) AS conflicts FROM c GROUP BY op",
    "op_verify": f"WITH {_ORDER}, a AS ({APPLIED}) SELECT op, string_agg(f.path, '; ' ORDER BY f.path) AS failures FROM f LEFT JOIN a ON a.path = f.path WHERE action IN ('create', 'edit') AND coalesce(now, '') <> content GROUP BY op",
    "op_rollback": f"WITH {_ORDER}, a AS ({APPLIED}), g AS (SELECT *, CASE WHEN action = 'move' THEN new_path ELSE path END AS spot FROM f WHERE action <> 'delete' AND op % 3 <> 0) SELECT op, spot AS path, CASE action WHEN 'create' THEN 'remove' WHEN 'move' THEN 'move' ELSE 'edit' END AS undo, CASE WHEN action = 'move' THEN g.path END AS to_path, CASE WHEN action = 'edit' THEN old_content END AS content, CASE WHEN now IS NULL THEN 'missing' WHEN now <> CASE WHEN action = 'move' THEN old_content ELSE g.content END THEN 'changed' END AS refused FROM g LEFT JOIN a ON a.path = g.spot",
    "op_list": f"WITH {_ORDER} SELECT op, max(k) AS newest, string_agg(action, ',' ORDER BY k, action) AS actions FROM f GROUP BY op ORDER BY newest DESC LIMIT 100",
    "op_transitions": "WITH RECURSIVE o AS (SELECT user_id AS op, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), r AS (SELECT op, 0::BIGINT AS i, 'pending' AS s FROM (SELECT DISTINCT op FROM o) UNION ALL SELECT o.op, o.i, CASE WHEN event_id % 4 = 0 AND s = 'pending' THEN 'approved' WHEN event_id % 4 = 1 AND s = 'pending' THEN 'rejected' WHEN event_id % 4 = 2 AND s = 'approved' THEN 'executed' WHEN event_id % 4 = 3 AND s = 'executed' THEN 'rolled_back' ELSE s END FROM r JOIN o ON o.op = r.op AND o.i = r.i + 1) SELECT op, max_by(s, i) AS status FROM r GROUP BY op",
    "agent_tools": "SELECT name, permission, mutates, CASE WHEN permission = 'vault_delete' THEN 'denied' WHEN mutates THEN 'confirm' ELSE 'allow' END AS decision FROM (VALUES " + ", ".join(f"('{n}', '{p}', {str(m).lower()})" for n, p, m in TOOLS) + ") AS t(name, permission, mutates)",
    "tool_calls": "WITH t AS (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p, _ in TOOLS) + ", ('vault.format', '')) AS v(tool, permission)) SELECT user_id, tool, CASE WHEN permission = '' THEN 'unknown tool' WHEN permission = 'vault_delete' THEN 'denied' WHEN permission IN (" + ", ".join(f"'{k}'" for k, v in POLICY.items() if v == "confirm") + f") AND event_id % 3 <> 0 THEN 'needs approval' ELSE 'run' END AS decision, count(*) AS n FROM events JOIN t ON i = event_id % {len(TOOLS) + 1} GROUP BY ALL",
    "audit_chain": f"WITH {_CHAIN} SELECT user_id, count(*) AS n, max_by(h, event_id) AS some_hash, min(h) AS least_hash FROM c WHERE i > 0 GROUP BY user_id",
    "audit_list": "SELECT * FROM (SELECT event_id, user_id, event_type, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) ORDER BY ts, event_id",
    "audit_verify": f"""WITH {_CHAIN}, t AS (SELECT c.user_id, c.i, o.event_type, c.event_id, CASE WHEN c.user_id % 5 = 0 AND c.event_id = min(c.event_id) OVER (PARTITION BY c.user_id) THEN sha256(c.h) ELSE c.h END AS h, lag(c.h, 1, '') OVER (PARTITION BY c.user_id ORDER BY c.i) AS declared FROM c JOIN o ON o.user_id = c.user_id AND o.i = c.i WHERE c.i > 0),
k AS (SELECT user_id, declared = lag(h, 1, '') OVER (PARTITION BY user_id ORDER BY i) AND h = sha256(declared || '|agent|' || event_type || '||ok|' || event_id) AS ok FROM t) SELECT user_id, bool_and(ok) AS holds FROM k GROUP BY user_id""",
    "line_diff": f"""WITH docs AS ({fx.DOC_NOTES}), l AS (SELECT path, mtime % 10 = 0 AS made, string_split(content, chr(10)) AS a, string_split(regexp_replace(content, 'the|und|les', 'that', 'g'), chr(10)) AS b FROM docs), u AS (SELECT path, made, a, b, unnest(range(1, len(b) + 1)) AS i FROM l),
x AS (SELECT path, made, i, 0 AS j, CASE WHEN a[i] = b[i] THEN 'context' ELSE 'delete' END AS kind, CASE WHEN a[i] = b[i] THEN '  ' ELSE '- ' END || a[i] AS line FROM u WHERE NOT made UNION ALL SELECT path, made, i, 1, 'add', '+ ' || b[i] FROM u WHERE made OR a[i] <> b[i]),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY i, j) AS INT) AS k FROM x), t AS (SELECT path, max(i) FILTER (k = 40) AS last FROM n GROUP BY path) SELECT path, k, kind, line FROM n JOIN t USING (path) WHERE made OR last IS NULL OR i <= last""",
    "plan_requests": f"""WITH {KNOWN}, t AS (SELECT path, replace(substr(content, 7), chr(10) || chr(10) || '```', chr(10) || chr(10) || chr(10) || '```') AS c FROM vault WHERE path IN ('Suppliers/S1.md', 'Suppliers/S2.md')),
h AS (SELECT path, '# ' || title || chr(10) || chr(10) || content AS c FROM (SELECT * FROM titled ORDER BY path LIMIT 100) WHERE NOT regexp_matches(content, '(^|\n)[ \t]*# ') ORDER BY path LIMIT 5),
l AS (SELECT path, rtrim(content, ' ') || chr(10) || chr(10) || 'Related: [[N1]]' AS c FROM vault WHERE contains(lower(content), 'n1') AND NOT contains(content, '[[N1]]') AND path <> 'Nations/N1.md' ORDER BY path LIMIT 5)
SELECT 'fold' AS request, a.path, a.c || chr(10) || chr(10) || chr(10) || '## From S2' || chr(10) || chr(10) || b.c AS new_content FROM t a, t b WHERE a.path = 'Suppliers/S1.md' AND b.path = 'Suppliers/S2.md'
UNION ALL SELECT 'link', path, c FROM l UNION ALL SELECT 'tidy', path, c FROM h
UNION ALL SELECT 'link', NULL, 'all candidate notes already link to the target' WHERE NOT EXISTS (SELECT 1 FROM l) UNION ALL SELECT 'tidy', NULL, 'no organization opportunities found; the vault looks tidy' WHERE NOT EXISTS (SELECT 1 FROM h)
UNION ALL SELECT * FROM (VALUES (' ', NULL, 'request must not be empty'), ('fold none', NULL, 'merge needs at least one source besides the target'), ('fold lost', NULL, 'merge source not found: No.md'), ('link none', NULL, 'no indexed notes mention zzz-nowhere; nothing to link'), ('both', NULL, 'merge target not found: No.md')) AS r(a, b, c)""",
    "plan_merge": f"WITH vault AS ({fx.VAULT}), t AS (SELECT path, replace(substr(content, 7), chr(10) || chr(10) || '```', chr(10) || chr(10) || chr(10) || '```') AS c FROM vault WHERE path IN ('Suppliers/S1.md', 'Suppliers/S2.md', 'Suppliers/S3.md')) SELECT a.path, a.c || chr(10) || (SELECT string_agg(chr(10) || chr(10) || '## From ' || regexp_replace(path, '^Suppliers/|[.]md$', '', 'g') || chr(10) || chr(10) || c, '' ORDER BY path) FROM t WHERE path <> 'Suppliers/S1.md') AS new_content FROM t a WHERE path = 'Suppliers/S1.md'",
    "plan_link": f"WITH vault AS ({fx.VAULT}) SELECT path, rtrim(content, ' ') || chr(10) || chr(10) || 'Related: [[N1]]' AS new_content FROM ({_S}) WHERE contains(lower(content), 'n1') AND NOT contains(content, '[[N1]]') ORDER BY path LIMIT 5",
    "plan_metadata": f"WITH {KNOWN}, h AS (SELECT * FROM titled ORDER BY path LIMIT 100) SELECT path, '# ' || title || chr(10) || chr(10) || content AS new_content FROM h WHERE NOT regexp_matches(content, '(^|\\n)[ \\t]*# ') ORDER BY path LIMIT 5",
}
