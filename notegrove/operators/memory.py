"""Memories, their states, and contradictions between claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..plans import fixtures as fx
from . import knowledge as kn
from .folds import Machine, folded, named, stepped
from .knowledge import KNOWN

#: Claim types that make memories, and the kinds of contradictions.
MEMORY_TYPES = {"DECISION": "decision", "PREFERENCE": "preference", "GOAL": "goal", "EXPERIENCE": "experience"}
CONFLICTS = {"PREFERENCE": "preference_conflict", "DECISION": "decision_conflict", "GOAL": "goal_conflict", "FACT": "fact_conflict"}


def _map(pairs: dict):
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def candidates(claims: DataFrame, *keep: str) -> DataFrame:
    """path, type, content, excerpt: one for each note and cleaned text; the earliest claim names the type, and gives its columns ``keep``."""
    c = claims.where(F.col("claim_type").isin(list(MEMORY_TYPES))).withColumn("content", md.clean(F.col("object"))).where("content <> ''")
    first = F.struct("offset", "claim_type", "predicate")
    return c.groupBy("path", "content").agg(F.min_by(_map(MEMORY_TYPES)[F.col("claim_type")], first).alias("type"), F.min_by("object", first).alias("excerpt"), *[F.min_by(k, first).alias(k) for k in keep])


def unseen(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Those of ``found`` (path, content, ...) that ``stored`` (path, content; of any status, so rejected ones too) doesn't have."""
    return found.join(stored.select("path", "content").distinct(), ["path", "content"], "left_anti")


def superseded(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Memories (id, content, status, sources, valid_until) after ``changes`` (id, new_id, new_content, ts): the old version is closed at ts, the new one is accepted and inherits its sources.

    Rejected memories, and changes of memories that aren't there, are refused: they change nothing. Of several changes of a memory the first by ts and new_id holds.
    """
    one = changes.groupBy("id").agg(F.min(F.struct("ts", "new_id", "new_content")).alias("c"))
    j = memories.join(one, "id", "left")
    goes = F.col("c").isNotNull() & (F.col("status") != "rejected")
    old = j.select("id", "content", F.when(goes, "superseded").otherwise(F.col("status")).alias("status"), "sources", F.when(goes, F.col("c.ts")).otherwise(F.col("valid_until")).alias("valid_until"))
    new = j.where(goes).select(F.col("c.new_id").alias("id"), F.col("c.new_content").alias("content"), F.lit("accepted").alias("status"), "sources", F.lit(None).cast(memories.schema["valid_until"].dataType).alias("valid_until"))
    return old.unionByName(new)


def listed(memories: DataFrame, most: int = 1000) -> DataFrame:
    """The ``most`` memories that were updated last (updated_at, ties by id), newest first."""
    return memories.orderBy(F.desc("updated_at"), "id").limit(most)


def contradiction_pairs(claims: DataFrame) -> DataFrame:
    """kind, a, b (path:offset): pairs of claims of one subject and type with opposite polarity, the earlier one first.

    For collections in which few claims share a subject: where many do on both sides their number is the product, which ``contradictions`` and ``contradiction_classes`` avoid.
    """
    c = _sided(claims)
    pos, neg = c.where("polarity > 0").select("subject", "claim_type", F.col("at").alias("p")), c.where("polarity < 0").select("subject", "claim_type", F.col("at").alias("n"))
    return pos.join(neg, ["subject", "claim_type"]).select(_map(CONFLICTS)[F.col("claim_type")].alias("kind"), _name(F.least("p", "n")).alias("a"), _name(F.greatest("p", "n")).alias("b")).distinct()


def _name(x):
    return F.concat(x["path"], F.lit(":"), x["offset"].cast("string"))


def _sided(claims: DataFrame) -> DataFrame:
    c = claims.where(F.col("claim_type").isin(list(CONFLICTS)))
    return c.select(F.lower("subject").alias("subject"), "claim_type", F.when(F.col("polarity") > 0, 1).otherwise(-1).alias("polarity"), F.struct("path", "offset").alias("at"), "object")


def contradictions(claims: DataFrame) -> DataFrame:
    """subject, kind, at (path:offset), polarity, opposed, first: each claim that others of its subject and type contradict, with their number and the first of them.

    One row for each claim: what is contradicted by many isn't expanded into pairs.
    """
    c = _sided(claims)
    side = lambda p, n: (F.count_if(F.col("polarity") == p).alias(f"{n}_n"), F.min(F.when(F.col("polarity") == p, F.col("at"))).alias(f"{n}_first"))
    g = c.groupBy("subject", "claim_type").agg(*side(1, "pos"), *side(-1, "neg")).where("pos_n > 0 and neg_n > 0")
    j = c.join(g, ["subject", "claim_type"])
    other = lambda x: F.when(F.col("polarity") > 0, F.col(f"neg_{x}")).otherwise(F.col(f"pos_{x}"))
    return j.select("subject", _map(CONFLICTS)[F.col("claim_type")].alias("kind"), _name(F.col("at")).alias("at"), "polarity", other("n").alias("opposed"), _name(other("first")).alias("first"))


def contradiction_classes(claims: DataFrame) -> DataFrame:
    """subject, kind, positives, negatives, pairs: contradictions by class, without listing pairs."""
    c = claims.where(F.col("claim_type").isin(list(CONFLICTS)))
    g = c.groupBy(F.lower("subject").alias("subject"), "claim_type").agg(F.count_if(F.col("polarity") > 0).alias("positives"), F.count_if(F.col("polarity") < 0).alias("negatives"))
    return g.where("positives > 0 and negatives > 0").select("subject", _map(CONFLICTS)[F.col("claim_type")].alias("kind"), "positives", "negatives", (F.col("positives") * F.col("negatives")).alias("pairs"))


def contradiction_heads(claims: DataFrame) -> DataFrame:
    """subject, kind, a, b, a_object, b_object, positives, negatives: each class of contradictions by the first claim of either side, the earlier one first."""
    head = lambda p: F.min(F.when(F.col("polarity") == p, F.struct("at", "object")))
    g = _sided(claims).groupBy("subject", "claim_type").agg(head(1).alias("p"), head(-1).alias("n"), F.count_if(F.col("polarity") > 0).alias("positives"), F.count_if(F.col("polarity") < 0).alias("negatives"))
    g = g.where("p is not null and n is not null").withColumns({"x": F.least("p", "n"), "y": F.greatest("p", "n")})
    return g.select("subject", _map(CONFLICTS)[F.col("claim_type")].alias("kind"), _name(F.col("x.at")).alias("a"), _name(F.col("y.at")).alias("b"), F.col("x.object").alias("a_object"), F.col("y.object").alias("b_object"), "positives", "negatives")


def _claims(spark, d):
    return kn.claims(md.parsed(fx.vault(spark, d)))


def memory_candidates(spark, d):
    return candidates(_claims(spark, d))


def q_contradictions(spark, d):
    return contradictions(_claims(spark, d))


def q_contradiction_classes(spark, d):
    return contradiction_classes(_claims(spark, d))


def contradictions_incremental(spark, d):
    """Contradicted claims that aren't recorded yet; those whose place has a length divisible by three are."""
    found = contradictions(_claims(spark, d))
    recorded = found.where(F.length("at") % 3 == 0).select("subject", "kind", "at")
    return found.join(recorded, ["subject", "kind", "at"], "left_anti").select("subject", "kind", "at", "opposed")


def contradiction_list(spark, d):
    """Open contradictions, a row for each class, with the first claims of both sides beside each other."""
    return contradiction_heads(_claims(spark, d))


def contradiction_resolve(spark, d):
    """What resolutions do: by turns both are kept, it is ignored, or the later one holds; the earlier claim's memory is superseded if the later one holds."""
    f = contradiction_heads(_claims(spark, d)).withColumn("k", F.pmod(F.length("a") + F.length("b"), F.lit(3)))
    status = F.when(F.col("k") == 0, "resolved_keep_both").when(F.col("k") == 1, "ignored").otherwise("resolved_later_current")
    return f.select("subject", "kind", "a", "b", status.alias("status"), F.when(F.col("k") == 2, F.col("a")).alias("superseded"))


def _events(spark, d):
    """Events as actions upon memories, one memory for each user."""
    e = fx.table(spark, d, "events")
    actions = F.array(*[F.lit(a) for a in ("accept", "reject", "dispute", "stale", "supersede", "update")])
    return e.select("user_id", "ts", "event_id", F.element_at(actions, (F.col("event_id") % 6 + 1).cast("int")).alias("action"))


_OPEN = ("candidate", "stale", "disputed")
#: States of memories, the first one to begin with, and what actions make of them.
MEMORY = Machine(
    ["candidate", "accepted", "rejected", "disputed", "stale", "superseded"],
    {
        "accept": dict.fromkeys(_OPEN, "accepted"),
        "reject": dict.fromkeys(_OPEN, "rejected"),
        "dispute": {"accepted": "disputed"},
        "stale": {"accepted": "stale"},
        "supersede": dict.fromkeys((*_OPEN, "accepted", "superseded"), "superseded"),
    },
)


def fold_states(events: DataFrame, key: str) -> DataFrame:
    """The last state of each key: actions in order of (ts, event_id) folded from ``candidate``, those that a state doesn't allow skipped."""
    return folded(events, key, MEMORY).select(key, named(MEMORY.states).alias("status"), "n")


def decided(memories: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``memories`` (id, status, ...) after one decision for each (id, action: accept, reject, dispute, stale or supersede), and the decisions with what became of them (id, was, status, refused)."""
    said = stepped(memories, "id", MEMORY, decisions)
    after = memories.join(said.where("not refused").select("id", F.col("status").alias("_new")), "id", "left")
    return after.withColumn("status", F.coalesce("_new", "status")).drop("_new").select(*memories.columns), said


def updated(memories: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``memories`` (id, type, content, ...) with changed content and type (id, type, content; null: as it was), and the changes that are refused (id, why): no such memory, a type that there isn't, blank content."""
    why = F.when(F.col("old").isNull(), "no such memory").when(F.col("type").isNotNull() & ~F.col("type").isin(list(MEMORY_TYPES.values())), "unknown type").when(F.trim("content") == "", "blank content")
    c = changes.join(memories.select("id", F.lit(True).alias("old")), "id", "left").withColumn("why", why)
    good = c.where("why is null").select("id", F.col("type").alias("_t"), F.col("content").alias("_c"))
    after = memories.join(good, "id", "left").withColumns({"type": F.coalesce("_t", "type"), "content": F.coalesce("_c", "content")})
    return after.select(*memories.columns), c.where("why is not null").select("id", "why")


def memory_decisions(spark, d):
    """One decision upon each user's memory after the log of events: an acceptance, a rejection or a supersession by turns; refused where its state doesn't allow it."""
    m = fold_states(_events(spark, d), "user_id").select(F.col("user_id").alias("id"), "status")
    actions = F.element_at(F.array(*[F.lit(a) for a in ("accept", "reject", "supersede")]), (F.col("id") % 3 + 1).cast("int"))
    return decided(m, m.select("id", actions.alias("action")))[1]


def memory_newest(spark, d):
    """The hundred memories (by text) of the newest notes, in order of their last update."""
    m = candidates(_claims(spark, d)).join(fx.vault(spark, d).select("path", "mtime"), "path").groupBy(F.col("content").alias("id")).agg(F.max("mtime").alias("updated_at"), F.count("*").alias("n_sources"))
    return listed(m, 100)


def memory_transitions(spark, d):
    return fold_states(_events(spark, d), "user_id")


def memory_update(spark, d):
    """Updates that hold: a type of the four, and content that isn't blank."""
    t = fx.table(spark, d, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in ("decision", "goal", "fact")]), (F.col("event_id") % 3 + 1).cast("int")).alias("type"), F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.col("event_type")).alias("content"))
    return t.select("event_id", (F.col("type").isin(list(MEMORY_TYPES.values())) & (F.trim("content") != "")).alias("valid"))


def memory_supersede(spark, d):
    """Purchases as memories, every seventh rejected, and refunds-to-be (other events divisible by three) as changes of the purchase whose number is a third of theirs."""
    e = fx.table(spark, d, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    m = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.concat("event_type", F.lit(" of "), "user_id").alias("content"), F.when(F.col("event_id") % 7 == 0, "rejected").otherwise("accepted").alias("status"), F.array(F.concat(F.lit("Users/U"), "user_id", F.lit(".md"))).alias("sources"), F.lit(None).cast("timestamp_ntz").alias("valid_until"))
    c = e.where("event_id % 3 = 0").select((F.col("event_id") / 3).cast("long").alias("id"), (F.col("event_id") + 1_000_000_000).alias("new_id"), F.concat(F.lit("now "), "event_type").alias("new_content"), ts.alias("ts"))
    return superseded(m, c).withColumn("sources", F.array_join("sources", ","))


def memory_unseen(spark, d):
    """Candidates that aren't stored yet; of those in notes of parts whose number ends in 1 all are, as rejected ones."""
    found = candidates(_claims(spark, d))
    return unseen(found, found.where("path like 'Parts/%1.md'")).select("path", "content", "type")


def stale_memories(spark, d):
    """Memories whose source note is gone; the suppliers divisible by four have gone."""
    m = candidates(_claims(spark, d)).select("path", "content")
    live = fx.vault(spark, d).where("not (path like 'Suppliers/%' and mtime % 4 = 0)").select("path")
    return m.join(live, "path", "left_anti")


def memory_list(spark, d):
    """Memories by content with their sources, each with as many as there are."""
    m = candidates(_claims(spark, d))
    return m.groupBy("type", "content").agg(F.count("*").alias("n_sources"), F.min("path").alias("first_source"), F.max("path").alias("last_source"))


def resolve_later(spark, d):
    """Each claim with a memory made of it, if any."""
    c = _claims(spark, d)
    m = candidates(c).select("path", "content", "type")
    j = c.select("path", "offset", "claim_type", md.clean(F.col("object")).alias("content")).join(m, ["path", "content"], "left")
    return j.groupBy("claim_type").agg(F.count("*").alias("n"), F.count("type").alias("with_memory"))


#: States of jobs with the number of attempts, as far as it matters (3 stands for 3 or more).
JOB = Machine(
    [(status, k) for status in ("pending", "running", "completed", "failed") for k in range(4)],
    {
        "start": {("pending", k): (("running", min(k + 1, 3)), 1) for k in range(4)},
        "complete": {("running", k): (("completed", k), 0) for k in range(4)},
        "fail": {("running", k): (("failed" if k == 3 else "pending", k), 0) for k in range(4)},
        "recover": {("running", k): (("pending", k), 0) for k in range(4)},
    },
)


def replayed_jobs(log: DataFrame) -> DataFrame:
    """job, status, attempts: the last state of each job of a log (job, ts, event_id, action); three failures park it, orphans become pending."""
    return folded(log, "job", JOB).select("job", named([s for s, _ in JOB.states]).alias("status"), F.col("count").alias("attempts"))


def _job_log(spark, d):
    return fx.table(spark, d, "events").select((F.col("user_id")).alias("job"), "ts", "event_id", F.element_at(F.array(*[F.lit(a) for a in ("start", "fail", "recover", "complete", "start", "fail")]), (F.col("event_id") % 6 + 1).cast("int")).alias("action"))


def job_replay(spark, d):
    """Last state of each job: its log of starts, failures and successes replayed."""
    return replayed_jobs(_job_log(spark, d))


def next_jobs(jobs: DataFrame, as_of) -> DataFrame:
    """The job that each queue hands out: of those pending whose time to run has come the oldest, ties by id. ``jobs``: queue, job, status, created_at, run_after."""
    may = jobs.where((F.col("status") == "pending") & (F.coalesce("run_after", "created_at") <= as_of))
    return may.groupBy("queue").agg(F.min(F.struct("created_at", "job"))["job"].alias("job"), F.count("*").alias("waiting"))


def job_dequeue(spark, d):
    """Of each user's events as jobs, every other pending and due an hour after each failure before it, the one that runs next at the end of the log's first half."""
    e = fx.table(spark, d, "events")
    half = e.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("as_of"))  # one row
    j = e.select(F.col("user_id").alias("queue"), F.col("event_id").alias("job"), F.when(F.col("event_id") % 2 == 0, "pending").otherwise("completed").alias("status"), F.col("ts").alias("created_at"), (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 3).cast("int"))).alias("run_after"))
    return next_jobs(j.crossJoin(F.broadcast(half)), F.col("as_of"))


def job_backoff(spark, d):
    """When each attempt may run: a second for each attempt before it, parked from the third on."""
    e = fx.table(spark, d, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", "event_id", n.cast("long").alias("attempt")).select("user_id", "event_id", "attempt", F.when(F.col("attempt") < 3, F.col("attempt") * 1000).alias("wait_ms"), (F.col("attempt") >= 3).alias("parked"))


_IN = "(" + ", ".join(f"'{t}'" for t in MEMORY_TYPES) + ")"
_TYPE = "CASE claim_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MEMORY_TYPES.items()) + " END"
_KIND = "CASE x.claim_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONFLICTS.items()) + " END"
_CIN = "(" + ", ".join(f"'{t}'" for t in CONFLICTS) + ")"
_CLEAN = r"trim(regexp_replace(object, '\[\[(?:[^\]|#]*\|)?([^\]|#]*)(?:#[^\]]*)?\]\]', '\1', 'g'))"
_MEM = f"mems AS (SELECT path, {_CLEAN} AS content, min_by({_TYPE}, (\"offset\", claim_type, predicate)) AS type, min_by(object, (\"offset\", claim_type, predicate)) AS excerpt FROM claims WHERE claim_type IN {_IN} AND {_CLEAN} <> '' GROUP BY 1, 2)"
_CON = f"""sided AS (SELECT lower(subject) AS subject, x.claim_type, {_KIND} AS kind, CASE WHEN polarity > 0 THEN 1 ELSE -1 END AS polarity, (path, "offset") AS spot, path || ':' || "offset" AS name, object FROM claims x WHERE claim_type IN {_CIN}),
sides AS (SELECT subject, claim_type, count(*) FILTER (polarity > 0) AS pn, count(*) FILTER (polarity < 0) AS nn, arg_min(name, spot) FILTER (polarity > 0) AS pf, arg_min(name, spot) FILTER (polarity < 0) AS nf, min(spot) FILTER (polarity > 0) AS pa, min(spot) FILTER (polarity < 0) AS na, arg_min(object, (spot, object)) FILTER (polarity > 0) AS po, arg_min(object, (spot, object)) FILTER (polarity < 0) AS nob FROM sided GROUP BY ALL HAVING pn > 0 AND nn > 0),
cons AS (SELECT subject, kind, name AS "at", polarity, CASE WHEN polarity > 0 THEN nn ELSE pn END AS opposed, CASE WHEN polarity > 0 THEN nf ELSE pf END AS first FROM sided JOIN sides USING (subject, claim_type)),
chead AS (SELECT subject, {_KIND} AS kind, CASE WHEN pa < na THEN pf ELSE nf END AS a, CASE WHEN pa < na THEN nf ELSE pf END AS b, CASE WHEN pa < na THEN po ELSE nob END AS a_object, CASE WHEN pa < na THEN nob ELSE po END AS b_object, pn AS positives, nn AS negatives FROM sides x)"""


def _replay(step: str, key: str, zero: str, value: str) -> str:
    return f"""WITH RECURSIVE o AS (SELECT {key} AS k, event_id, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events), r AS (SELECT k, 0::BIGINT AS i, {zero} FROM (SELECT DISTINCT k FROM o) UNION ALL SELECT o.k, o.i, {step} FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1) SELECT {value} FROM r"""


QUERIES = {"contradictions": q_contradictions, "contradiction_classes": q_contradiction_classes} | {f.__name__: f for f in (memory_candidates, contradictions_incremental, contradiction_list, contradiction_resolve, memory_transitions, memory_decisions, memory_newest, memory_update, memory_supersede, memory_unseen, stale_memories, memory_list, resolve_later, job_replay, job_dequeue, job_backoff)}
ORACLE = {
    "memory_candidates": f"WITH {KNOWN}, {_MEM} SELECT * FROM mems",
    "contradictions": f"WITH {KNOWN}, {_CON} SELECT * FROM cons",
    "contradiction_classes": f"WITH {KNOWN} SELECT lower(subject) AS subject, any_value({_KIND}) AS kind, count(*) FILTER (polarity > 0) AS positives, count(*) FILTER (polarity < 0) AS negatives, (count(*) FILTER (polarity > 0)) * (count(*) FILTER (polarity < 0)) AS pairs FROM claims x WHERE claim_type IN {_CIN} GROUP BY lower(subject), claim_type HAVING positives > 0 AND negatives > 0",
    "contradictions_incremental": f'WITH {KNOWN}, {_CON} SELECT subject, kind, "at", opposed FROM cons WHERE length("at") % 3 <> 0',
    "contradiction_list": f"WITH {KNOWN}, {_CON} SELECT * FROM chead",
    "contradiction_resolve": f"WITH {KNOWN}, {_CON} SELECT subject, kind, a, b, CASE (length(a) + length(b)) % 3 WHEN 0 THEN 'resolved_keep_both' WHEN 1 THEN 'ignored' ELSE 'resolved_later_current' END AS status, CASE WHEN (length(a) + length(b)) % 3 = 2 THEN a END AS superseded FROM chead",
    "memory_newest": f"WITH {KNOWN}, {_MEM} SELECT mems.content AS id, max(mtime) AS updated_at, count(*) AS n_sources FROM mems JOIN vault USING (path) GROUP BY 1 ORDER BY updated_at DESC, id LIMIT 100",
    "memory_transitions": _replay("CASE WHEN event_id % 6 = 0 AND status IN ('candidate', 'stale', 'disputed') THEN 'accepted' WHEN event_id % 6 = 1 AND status IN ('candidate', 'stale', 'disputed') THEN 'rejected' WHEN event_id % 6 = 2 AND status = 'accepted' THEN 'disputed' WHEN event_id % 6 = 3 AND status = 'accepted' THEN 'stale' WHEN event_id % 6 = 4 AND status <> 'rejected' THEN 'superseded' ELSE status END", "user_id", "'candidate' AS status", "k AS user_id, max_by(status, i) AS status, max(i) AS n") + " GROUP BY k",
    "memory_update": "SELECT event_id, event_id % 3 <> 2 AND event_id % 4 <> 0 AS valid FROM events",
    "memory_supersede": "WITH m AS (SELECT event_id AS id, event_type || ' of ' || user_id AS content, CASE WHEN event_id % 7 = 0 THEN 'rejected' ELSE 'accepted' END AS status, 'Users/U' || user_id || '.md' AS sources FROM events WHERE event_id % 2 = 0), c AS (SELECT event_id // 3 AS id, event_id + 1000000000 AS new_id, 'now ' || event_type AS new_content, ts FROM events WHERE event_id % 3 = 0), j AS (SELECT m.*, new_id, new_content, ts, c.id IS NOT NULL AND status <> 'rejected' AS goes FROM m LEFT JOIN c ON c.id = m.id) SELECT id, content, CASE WHEN goes THEN 'superseded' ELSE status END AS status, sources, CASE WHEN goes THEN ts END AS valid_until FROM j UNION ALL SELECT new_id, new_content, 'accepted', sources, NULL FROM j WHERE goes",
    "memory_unseen": f"WITH {KNOWN}, {_MEM} SELECT path, content, type FROM mems WHERE NOT path LIKE 'Parts/%1.md'",
    "stale_memories": f"WITH {KNOWN}, {_MEM} SELECT path, content FROM mems WHERE path IN (SELECT path FROM vault WHERE path LIKE 'Suppliers/%' AND mtime % 4 = 0)",
    "memory_list": f"WITH {KNOWN}, {_MEM} SELECT type, content, count(*) AS n_sources, min(path) AS first_source, max(path) AS last_source FROM mems GROUP BY 1, 2",
    "resolve_later": f"WITH {KNOWN}, {_MEM} SELECT claim_type, count(*) AS n, count(type) AS with_memory FROM (SELECT c.claim_type, m.type FROM (SELECT path, claim_type, {_CLEAN} AS content FROM claims) c LEFT JOIN mems m ON m.path = c.path AND m.content = c.content) GROUP BY 1",
    "job_replay": _replay("CASE WHEN event_id % 6 IN (0, 4) AND status = 'pending' THEN 'running' WHEN event_id % 6 = 3 AND status = 'running' THEN 'completed' WHEN event_id % 6 IN (1, 5) AND status = 'running' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END WHEN event_id % 6 = 2 AND status = 'running' THEN 'pending' ELSE status END, CASE WHEN event_id % 6 IN (0, 4) AND status = 'pending' THEN attempts + 1 ELSE attempts END", "user_id", "'pending' AS status, 0::BIGINT AS attempts", "k AS job, max_by(status, i) AS status, max_by(attempts, i) AS attempts") + " GROUP BY k",
    "job_dequeue": "WITH h AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS now FROM events), j AS (SELECT user_id AS queue, event_id AS job, ts AS created_at, ts + to_hours(event_id % 3) AS run_after FROM events WHERE event_id % 2 = 0) SELECT queue, arg_min(job, (created_at, job)) AS job, count(*) AS waiting FROM j, h WHERE run_after <= now GROUP BY queue",
    "job_backoff": "WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events) SELECT user_id, event_id, attempt, CASE WHEN attempt < 3 THEN attempt * 1000 END AS wait_ms, attempt >= 3 AS parked FROM a",
}
ORACLE["memory_decisions"] = f"SELECT user_id AS id, status AS was, CASE WHEN user_id % 3 = 2 THEN CASE WHEN status IN ('rejected', 'superseded') THEN status ELSE 'superseded' END WHEN status IN ('candidate', 'stale', 'disputed') THEN CASE user_id % 3 WHEN 0 THEN 'accepted' ELSE 'rejected' END ELSE status END AS status, CASE WHEN user_id % 3 = 2 THEN status IN ('rejected', 'superseded') ELSE status NOT IN ('candidate', 'stale', 'disputed') END AS refused FROM ({ORACLE['memory_transitions']})"
