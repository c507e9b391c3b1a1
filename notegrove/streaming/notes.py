"""Streams of note events: bursts, states, retries, snapshots and an index, with state that is bounded by what is open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import agent, folds, memory, retrieval, search, segments
from ..plans import fixtures as fx
from ..sources import files, tables
from . import lifecycles

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def debounced(events: DataFrame, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """user_id, first_ts, n, last_event of each burst that is over: events of a user with gaps under ``gap``.

    A burst is given once, when the watermark, ``late`` behind the newest event, has passed its end; then it is forgotten, so state holds open bursts only. Rows that come later than the
    watermark and would only belong to bursts that are over are dropped, and counted as ``numRowsDroppedByWatermark`` in the query's progress.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id"))["event_id"].alias("last_event")).select("user_id", F.col("s.start").cast("timestamp_ntz").alias("first_ts"), "n", "last_event")


def arrivals(rows: DataFrame, order: str, parts: int = 4) -> list[DataFrame]:
    """``rows`` in ``parts`` ranges of ``order`` of equal width, as they would arrive one after the other."""
    ends = rows.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    if ends.a is None:
        return [rows]
    cuts = [ends.a + (ends.b - ends.a) * k / parts for k in range(1, parts)]
    return [rows.where((F.col(order) >= lo if lo is not None else F.lit(True)) & (F.col(order) < hi if hi is not None else F.lit(True))) for lo, hi in zip([None, *cuts], [*cuts, None])]


class Runs:
    """A stream over files that arrive in parts, each part being run to its end before the next one comes; ``out`` is all it gave, ``progress`` what each run reported last."""

    def __init__(self, parts: list[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str = "append"):
        self.spark = spark = parts[0].sparkSession
        self.progress: list = []
        at = files.shared(spark)

        def keep(df: DataFrame, number: int) -> None:
            df.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

        was = spark.conf.get(ROCKS[0], None)
        spark.conf.set(*ROCKS)  # a store whose state is on disk, as timers and maps need it; a query keeps what it was started with
        try:
            for part in parts:
                part.write.mode("append").parquet(f"{at}/in")
                stream = make(spark.readStream.schema(parts[0].schema).parquet(f"{at}/in"))
                q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
                q.awaitTermination()
                self.progress.append(q.lastProgress)
        finally:
            spark.conf.set(ROCKS[0], was) if was else spark.conf.unset(ROCKS[0])
        self.out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{at}/out").drop("batch")

    def held(self) -> list[int]:
        """Rows of state after each run."""
        return [sum(int(o.numRowsTotal) for o in p.stateOperators) for p in self.progress]


def folded(parts: list[DataFrame], key: str, machine: folds.Machine) -> DataFrame:
    """``key``, state, count, n after all ``parts`` of a log (key, ts, event_id, action), by a stream.

    The states are a table by buckets of the key. Each batch is folded to one map of states for each key, by as many tasks as it takes however many events a key has, and
    the maps are applied to the states of those keys: of the table only their buckets are written anew.
    """
    spark, at = parts[0].sparkSession, files.shared(parts[0].sparkSession)
    kind = parts[0].schema[key].dataType.simpleString()
    table = tables.Buckets(spark, f"{at}/states", f"{key} {kind}, state int, count long, n long", key)

    def apply(batch: DataFrame, number: int) -> None:
        maps = files.stored(folds.maps(batch, key, machine))
        table.update(maps, lambda old: folds.applied(maps, key, old).unionByName(old.join(maps.select(key), key, "left_anti")), number)

    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        incremental(spark.readStream.schema(part.schema).parquet(f"{at}/in"), apply, f"{at}/log").awaitTermination()
    return table.read()


def snapshot(parts: list[DataFrame], key: list[str], order: list[str], by: str) -> tables.Buckets:
    """The last row of each ``key`` by ``order``, kept as a table by buckets while ``parts`` arrive: no state is held, a row that is late never wins, and a batch writes the buckets it touches."""
    spark, at = parts[0].sparkSession, files.shared(parts[0].sparkSession)
    table = tables.Buckets(spark, f"{at}/last", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts[0].schema), by)
    for part in parts:
        part.write.mode("append").parquet(f"{at}/in")
        incremental(spark.readStream.schema(part.schema).parquet(f"{at}/in"), lambda batch, number: table.newest(batch, key, order, number) and None, f"{at}/log").awaitTermination()
    return table


def incremental(stream: DataFrame, handle, checkpoint: str):
    """Runs ``handle(batch, id)`` once for each batch of changed notes, one at a time; a batch that failed is given again."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed(stream: DataFrame, ix: segments.Segments, checkpoint: str):
    """Keeps an index by batches of ``stream`` (path, content, version): only the notes that changed are cut and counted; segments are merged behind each batch.

    A batch that is given again changes nothing.
    """

    def index(batch: DataFrame, number: int) -> None:
        ix.apply(batch, number)
        ix.merge()

    return incremental(stream, index, checkpoint)


def index_stream(spark, d):
    """The chunks of the vault after its batches of edits, empties, deletions and returns have come as files, one after the other."""
    at = files.shared(spark)
    rows = segments.changes(spark, d)
    ix = segments.Segments(spark, f"{at}/index", fan_in=3)
    rows = files.stored(rows)
    for n in range(segments.LAST + 1):
        rows.where(F.col("batch") == n).drop("batch").write.mode("append").parquet(f"{at}/in")
        indexed(spark.readStream.schema(rows.drop("batch").schema).parquet(f"{at}/in"), ix, f"{at}/log").awaitTermination()
    return ix.rows.select("path", "ordinal", "heading_path", "text", F.size("terms").alias("n_terms"))


def _events(spark, d) -> DataFrame:
    return fx.table(spark, d, "events")


def rename_stream(spark, d):
    """Renames (here: signups) go through at once, each by itself; other events in bursts that are over."""
    parts = arrivals(_events(spark, d), "ts")
    moves = Runs([p.where("event_type = 'signup'") for p in parts], lambda e: e.select("user_id", F.col("ts").cast("timestamp_ntz").alias("first_ts"), F.lit(1).cast("long").alias("n"), F.col("event_id").alias("last_event"))).out
    bursts = Runs([p.where("event_type <> 'signup'") for p in parts], debounced).out
    return moves.withColumn("kind", F.lit("rename")).unionByName(bursts.withColumn("kind", F.lit("burst")))


def debounce_stream(spark, d):
    """Bursts that are over when all events have come."""
    return Runs(arrivals(_events(spark, d), "ts"), debounced).out


def memory_transitions_stream(spark, d):
    out = folded(arrivals(memory._events(spark, d), "ts"), "user_id", memory.MEMORY)
    return out.select("user_id", folds.named(memory.MEMORY.states).alias("status"), "n")


def job_replay_stream(spark, d):
    """All that happens to jobs, with due times: users' events as starts, failures, recoveries and completions."""
    return Runs(arrivals(memory._job_log(spark, d), "ts"), lifecycles.retried).out


def latest_stream(spark, d):
    """The last event of each user and type."""
    return snapshot(arrivals(_events(spark, d).select("user_id", "event_type", "ts", "event_id"), "ts"), ["user_id", "event_type"], ["ts", "event_id"], "user_id").read().drop("ts")


#: The life of each operation (see FILES) in six steps: its files; an approval, or a rejection of those divisible by five, or none of those divisible by seven; its files as they are now; the order to run;
#: the files as they are then, with every seventh written wrongly; and the order to undo it, for the even ones.
LIFE = f"""
SELECT op, 0 AS step, 'file' AS kind, path, action, CASE WHEN action <> 'create' THEN old_content END AS before, CASE WHEN action = 'move' THEN old_content ELSE content END AS after, CASE WHEN action = 'move' THEN new_path ELSE path END AS spot, CAST(NULL AS STRING) AS hash FROM ({agent.FILES}) WHERE action <> 'delete'
UNION ALL SELECT op, 1, CASE WHEN op % 5 = 0 THEN 'reject' ELSE 'approve' END, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT o_custkey AS op FROM orders) WHERE op % 7 <> 0
UNION ALL SELECT op, 2, 'attest', path, NULL, NULL, NULL, NULL, now FROM ({agent.FILES}) JOIN ({agent.NOW}) USING (path) WHERE action <> 'delete'
UNION ALL SELECT op, 3, 'execute', NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT o_custkey AS op FROM orders)
UNION ALL SELECT op, 4, 'attest', a.path, NULL, NULL, NULL, NULL, now FROM ({agent.FILES}) f JOIN ({agent.APPLIED}) a ON a.path = CASE WHEN action = 'move' THEN new_path ELSE f.path END WHERE action <> 'delete'
UNION ALL SELECT op, 5, 'rollback', NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT o_custkey AS op FROM orders) WHERE op % 2 = 0"""


def operation_stream(spark, d):
    """What each decision upon an operation leads to, its files and what is attested of them coming as a stream."""
    e = files.stored(fx.sql(spark, d, LIFE).select(F.col("op").cast("long").alias("op"), F.col("step").cast("long").alias("step"), "kind", "path", "action", "before", "after", "spot", "hash"))
    return Runs([e.where(F.col("step") < 3), e.where(F.col("step") >= 3)], lifecycles.operated).out


_CLOSED = "closed AS (SELECT max(epoch_ms(ts)) * 1000 - 7200000000 AS w FROM {})"
_BURSTS = """g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
bursts AS (SELECT user_id, min(ts) AS first_ts, count(*) AS n, max_by(event_id, (ts, event_id)) AS last_event FROM s, closed GROUP BY user_id, k HAVING epoch_us(max(ts)) + 3600000000 <= any_value(w))"""
_T = {"w": lifecycles.WAIT, "l": lifecycles.LEASE, "k": lifecycles.KEEP}
#: Jobs event by event: first what time brings (p: the state then, lw and la: what and when), then the event (ew).
_JOBS = """RECURSIVE o AS (SELECT user_id AS job, epoch_us(ts) AS us, event_id % 6 AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT job, 0::BIGINT AS i, 'pending' AS status, 0::BIGINT AS attempts, 0::BIGINT AS since, CAST(NULL AS VARCHAR) AS lw, 0::BIGINT AS la, 0::BIGINT AS lt, CAST(NULL AS VARCHAR) AS ew, 0::BIGINT AS us FROM (SELECT DISTINCT job FROM o)
UNION ALL SELECT job, i, coalesce(ew, p), CASE WHEN ew = 'running' THEN pt + 1 ELSE pt END, CASE WHEN ew IS NOT NULL THEN us WHEN gone THEN due ELSE since END, lw, due, lt, ew, us FROM (
 SELECT *, CASE WHEN a IN (0, 4) AND p = 'pending' THEN 'running' WHEN p <> 'running' THEN NULL WHEN a = 3 THEN 'completed' WHEN a = 2 THEN 'pending' WHEN a IN (1, 5) THEN CASE WHEN pt >= 3 THEN 'failed' ELSE 'waiting' END END AS ew FROM (
  SELECT *, CASE WHEN gone THEN 'pending' ELSE status END AS p, CASE WHEN gone AND status IN ('completed', 'failed') THEN 0 ELSE attempts END AS pt, CASE WHEN gone AND status = 'waiting' THEN 'due' WHEN gone AND status = 'running' THEN 'orphaned' END AS lw, attempts AS lt FROM (
   SELECT *, status <> 'pending' AND us >= due AS gone FROM (
    SELECT o.job, o.i, o.us, o.a, r.status, r.attempts, r.since, r.since + CASE r.status WHEN 'waiting' THEN {w} * r.attempts WHEN 'running' THEN {l} ELSE {k} END AS due FROM r JOIN o ON o.job = r.job AND o.i = r.i + 1))))),
last AS (SELECT job, max_by(status, i) AS status, max_by(attempts, i) AS attempts, max_by(since, i) AS since FROM r GROUP BY job),
ends AS (SELECT job, since + CASE status WHEN 'waiting' THEN {w} * attempts ELSE {l} END AS due, status, attempts FROM last, closed WHERE status IN ('waiting', 'running') AND since + CASE status WHEN 'waiting' THEN {w} * attempts ELSE {l} END <= w)""".format(**_T)
QUERIES = {f.__name__: f for f in (debounce_stream, rename_stream, index_stream, memory_transitions_stream, job_replay_stream, latest_stream, operation_stream)}
ORACLE = {
    "index_stream": f"WITH {segments._AFTER}, {search.CHUNKS} SELECT path, ordinal, heading_path, text, CAST(len({retrieval._TOK.format('text')}) AS INT) AS n_terms FROM ck",
    "debounce_stream": f"WITH e AS (SELECT * FROM events), {_CLOSED.format('e')}, {_BURSTS} SELECT * FROM bursts",
    "rename_stream": f"WITH e AS (SELECT * FROM events WHERE event_type <> 'signup'), {_CLOSED.format('e')}, {_BURSTS} SELECT user_id, ts AS first_ts, CAST(1 AS BIGINT) AS n, event_id AS last_event, 'rename' AS kind FROM events WHERE event_type = 'signup' UNION ALL SELECT *, 'burst' FROM bursts",
    "memory_transitions_stream": memory.ORACLE["memory_transitions"],
    "job_replay_stream": f"WITH {_JOBS.replace('last AS', _CLOSED.format('events') + ', last AS', 1)} SELECT job, la AS at_us, lw AS what, lt AS attempts FROM r WHERE lw IS NOT NULL UNION ALL SELECT job, us, ew, attempts FROM r WHERE ew IS NOT NULL UNION ALL SELECT job, due, CASE status WHEN 'waiting' THEN 'due' ELSE 'orphaned' END, attempts FROM ends",
    "latest_stream": "SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2",
    "operation_stream": f"""WITH l AS ({LIFE}), f AS (SELECT * FROM l WHERE kind = 'file'), seen AS (SELECT * FROM l WHERE kind = 'attest'), d AS (SELECT * FROM l WHERE kind IN ('approve', 'reject')),
x AS (SELECT f.op, count(*) FILTER (CASE WHEN action = 'create' THEN s.hash IS NOT NULL ELSE s.hash IS NULL OR s.hash <> before END) AS bad FROM (SELECT op, path, action, before FROM f) f LEFT JOIN (SELECT op, path, hash FROM seen WHERE step = 2) s ON s.op = f.op AND s.path = f.path GROUP BY 1),
u AS (SELECT f.op, count(*) FILTER (s.hash IS NULL OR s.hash <> after) AS bad FROM (SELECT op, spot, after FROM f) f LEFT JOIN (SELECT op, path, hash FROM seen WHERE step = 4) s ON s.op = f.op AND s.path = f.spot GROUP BY 1),
ops AS (SELECT DISTINCT o_custkey AS op FROM orders), e AS (SELECT ops.op, CASE WHEN d.kind IS NULL OR d.kind = 'reject' THEN 'refused' WHEN coalesce(bad, 0) > 0 THEN 'aborted' ELSE 'executed' END AS what, coalesce(bad, 0) AS bad FROM ops LEFT JOIN d USING (op) LEFT JOIN x USING (op))
SELECT op, CAST(1 AS BIGINT) AS step, CASE kind WHEN 'reject' THEN 'rejected' ELSE 'approved' END AS what, CAST(0 AS BIGINT) AS faults FROM d
UNION ALL SELECT op, 3, what, CASE WHEN what = 'aborted' THEN bad ELSE 0 END FROM e
UNION ALL SELECT op, 5, CASE WHEN what <> 'executed' THEN 'refused' WHEN coalesce(u.bad, 0) > 0 THEN 'aborted' ELSE 'rolled_back' END, CASE WHEN what = 'executed' THEN coalesce(u.bad, 0) ELSE 0 END FROM e LEFT JOIN u USING (op) WHERE op % 2 = 0""",
}
