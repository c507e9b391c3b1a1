"""Operators on small tables against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from notegrove.api import Agent, Ask, Memory, Search, Vault
from notegrove.operators import agent, folds, knowledge, memory, search
from notegrove.sources import files

NOTES = [
    ("a.md", "# Copper\n\nCopper seals failed twice. We decided to use steel.\n\n## Costs\n\nThe costs of running copper lines are high.", 1),
    ("b.md", "# Steel\n\nSteel is strong. I prefer copper.", 2),
    ("sub/c.md", "Plain note about seals and [[Steel]].", 3),
    ("d.md", "", 4),
]


@pytest.fixture(scope="module")
def vault(spark):
    return Vault(spark.createDataFrame(NOTES, "path string, content string, mtime long").cache())


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_folds_of_a_hot_key_equal_a_loop(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", i, rng.choice(["start", "fail", "recover", "complete", "other"])) for i in range(4000)] + [("one", 5000, None)]
    want = {}
    for k, _, a in rows:
        s, n = want.get(k, ("pending", 0))
        if a == "start" and s == "pending":
            s, n = "running", n + 1
        elif s == "running" and a in ("fail", "recover", "complete"):
            s = {"complete": "completed", "recover": "pending", "fail": "failed" if n >= 3 else "pending"}[a]
        want[k] = (s, n)
    df = spark.createDataFrame(rows, "job string, event_id long, action string").withColumn("ts", F.lit(0)).repartition(7)
    got = {r.job: (r.status, r.attempts) for r in memory.replayed_jobs(df).collect()}
    assert got == want
    assert memory.replayed_jobs(df.where("job = 'none'")).count() == 0
    assert {r.n for r in folds.folded(df.where("job = 'one'"), "job", memory.JOB).collect()} == {1}


def test_superseding(spark):
    m = spark.createDataFrame([(1, "a", "accepted", ["x"], None), (2, "b", "rejected", ["y"], None), (3, "c", "candidate", ["z"], None)], "id long, content string, status string, sources array<string>, valid_until long")
    c = spark.createDataFrame([(1, 11, "a2", 5), (1, 12, "a3", 6), (2, 13, "b2", 5), (9, 14, "n", 5)], "id long, new_id long, new_content string, ts long")
    got = {r.id: (r.content, r.status, r.sources, r.valid_until) for r in memory.superseded(m, c).collect()}
    assert got == {1: ("a", "superseded", ["x"], 5), 11: ("a2", "accepted", ["x"], None), 2: ("b", "rejected", ["y"], None), 3: ("c", "candidate", ["z"], None)}


def test_jobs_and_lists(spark):
    j = spark.createDataFrame([("q", 1, "pending", 5, 9), ("q", 2, "pending", 4, 3), ("q", 3, "running", 1, 1), ("q", 4, "pending", 4, None), ("p", 5, "pending", 1, 99)], "queue string, job long, status string, created_at long, run_after long")
    assert [(r.queue, r.job, r.waiting) for r in memory.next_jobs(j, F.lit(8)).collect()] == [("q", 2, 2)]
    log = spark.createDataFrame([(i, i % 3) for i in range(10)], "event_id long, ts long")
    assert [(r.ts, r.event_id) for r in agent.listed(log, 3).collect()] == [(2, 2), (2, 5), (2, 8)]
    m = spark.createDataFrame([(1, 3), (2, 5), (3, 5)], "id long, updated_at long")
    assert [r.id for r in memory.listed(m, 2).collect()] == [2, 3]


def test_rejected_memories_are_not_proposed_again(vault):
    m = Memory(vault)
    found = m.candidates().cache()
    assert found.count() >= 2 and m.candidates(found.select("path", "content")).count() == 0


def test_stems_find_and_words_don_t(spark, vault):
    q = asked(spark, "seal fails", "the of", "copper", "zzz costs")
    stems, plain = search.Index.build(vault.notes), search.Index.build(vault.notes, "words")
    assert [(r.query_id, r.path) for r in search.lexical(stems, q).where("query_id = 0").collect()] == [(0, "a.md")]
    assert search.lexical(plain, q).where("query_id < 2").count() == 0
    hits = search.hybrid(stems, q, knowledge.mentions(vault.parsed)).where("query_id = 0").collect()
    assert [r.snippet for r in hits] == ["Copper «seals» «failed» twice. We decided to use steel."] and hits[0].heading_path == "Copper"
    # no hit, and the last word of the query is in a heading
    assert [(r.path, r.heading_path) for r in search.fallback(stems, q).collect()] == [("a.md", "Copper > Costs")]


def test_embedder_and_its_failures(spark, vault):
    """Vectors find chunks that words don't; what an embedder fails on is queued; where it fails on a query, words alone answer."""
    v = lambda t: F.when(t.contains("strong"), F.array(F.lit(1.0), F.lit(0.0))).when(t.contains("toughness"), F.array(F.lit(0.9), F.lit(0.1))).when(t.contains("Plain"), F.lit(None)).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    s = Search(vault, embed=v)
    vectors, jobs = s.vectors()
    assert jobs.count() == 1 and vectors.count() + 1 == s.index.rows.count()
    top = s.query(asked(spark, "toughness")).where("rank = 1").first()
    assert top.path == "b.md" and top.semantic == 1.0 and top.lexical == 0.0 and top.snippet.startswith("Steel is strong")
    for bad in (lambda t: F.lit(None).cast("array<double>"), F.udf(lambda t: 1 / 0, "array<double>")):
        got = Search(vault, embed=bad).query(asked(spark, "copper")).collect()
        assert got and all(r.semantic is None and r.lexical is None and r.score > 0 for r in got)


def test_limits_are_clamped(spark, vault):
    s = Search(vault)
    assert [s._limit(x) for x in (0, -3, 20, 1000)] == [1, 1, 20, 100]
    assert s.lexical(asked(spark, "copper"), 0).count() == 1


def test_model_answers_pass_a_gate(spark, vault):
    q = asked(spark, "copper", "what did we decide about copper", "tidy up my notes", "qqq")
    ask = lambda said: {r.query_id: (r.mode, r.answer) for r in Ask(vault, generate=said).answer(q).collect()}
    good = ask(lambda p: F.lit("Copper failed [a.md]."))
    assert [good[k][0] for k in range(4)] == ["model", "evidence", "agent", "no_evidence"] and good[0][1] == "Copper failed [a.md]."
    for bad in (lambda p: F.lit("Copper failed."), lambda p: F.lit("Copper [x/y.md]."), lambda p: F.lit(None).cast("string")):
        assert ask(bad)[0][0] == "evidence"
    assert good[1][1].startswith("Here is what your vault contains about this:\n- ") and "[a.md]" in good[1][1]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(1)
    vs = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, [1.0, 2.0])]
    df = spark.createDataFrame(vs, "id long, v array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cos = lambda a, b: round(dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, 6) if dot(a, a) and dot(b, b) else 0.0
    want = []
    for i, v in vs[::7]:
        near = sorted((-cos(v, w), j) for j, w in vs if j != i and len(w) == len(v))[:3]
        want += [(i, j, k + 1) for k, (_, j) in enumerate(near)]
    got = search.nearest(df.where("id % 7 = 0").withColumnRenamed("id", "query_id"), df, 3, side=(4, 16)).collect()
    assert sorted((r.query_id, r.id, r.rank) for r in got) == sorted(want)


def test_migrations(spark):
    steps = {2: lambda df: df.withColumn("x", F.lit(1)), 3: lambda df: df.drop("id")}
    assert files.migrated(spark.range(1), 1, steps)[0].columns == ["x"] and files.migrated(spark.range(1), 1, steps, 2)[1] == 2
    assert files.migrated(spark.range(1), 3, steps)[0].columns == ["id"]
    with pytest.raises(ValueError):
        files.migrated(spark.range(1), 3, steps, 2)
    with pytest.raises(KeyError):
        files.migrated(spark.range(1), 1, {3: steps[3]})


def test_decisions_and_updates(spark):
    m = spark.createDataFrame([(1, "candidate", "goal", "a"), (2, "rejected", "goal", "b"), (3, "accepted", "fact?", "c")], "id long, status string, type string, content string")
    after, said = memory.decided(m, spark.createDataFrame([(1, "accept"), (2, "accept"), (3, "dispute"), (9, "accept"), (1, "nonsense")][:4], "id long, action string"))
    assert {r.id: r.status for r in after.collect()} == {1: "accepted", 2: "rejected", 3: "disputed"}
    assert {(r.id, r.was, r.status, r.refused) for r in said.collect()} == {(1, "candidate", "accepted", False), (2, "rejected", "rejected", True), (3, "accepted", "disputed", False), (9, None, None, True)}
    after, bad = memory.updated(m, spark.createDataFrame([(1, "decision", None), (2, None, "  "), (3, "nonsense", "x"), (9, None, "y")], "id long, type string, content string"))
    assert {(r.id, r.type, r.content) for r in after.collect()} == {(1, "decision", "a"), (2, "goal", "b"), (3, "fact?", "c")}
    assert {(r.id, r.why) for r in bad.collect()} == {(2, "blank content"), (3, "unknown type"), (9, "no such memory")}
    ops, said = agent.decided(spark.createDataFrame([(1, "pending"), (2, "pending")], "op long, status string"), spark.createDataFrame([(1, "approve"), (2, "execute")], "op long, action string"))
    assert {r.op: r.status for r in ops.collect()} == {1: "approved", 2: "pending"} and {r.op: r.refused for r in said.collect()} == {1: False, 2: True}


def test_facade_of_plans_and_health(spark, vault):
    plans = Agent(vault)
    assert [r.path for r in plans.plan("link them", link="Steel").collect()] == ["a.md", "b.md"]
    with pytest.raises(ValueError, match="merge source not found: x.md"):
        plans.plan("fold", merge=["a.md", "x.md"], into="a.md")
    with pytest.raises(ValueError, match="must not be empty"):
        plans.plan("  ")
    row = vault.health().first()
    assert (row.total_notes, row.broken_links, row.duplicates) == (4, 0, 0) and row.orphans == 2
    chunk = vault.chunks().limit(1).select("chunk_id", F.lit(1).alias("v"))
    row = vault.embedding_status(chunk).first()
    assert row.chunks_embedded == 1 and row.chunks_total == row.chunks_pending + 1
    calls = Agent.gate(spark.createDataFrame([("vault.edit", None), ("vault.edit", True), ("vault.delete", True), ("vault.read", None), ("x", True)], "tool string, approved boolean")).collect()
    assert [r.decision for r in sorted(calls, key=lambda r: (r.tool, r.approved or False))] == ["denied", "needs approval", "run", "run", "unknown tool"]


def test_previews_stop(spark):
    t = spark.createDataFrame([("same", "x\n" * 100, "x\n" * 100), ("edit", "a\n" * 100, "b\n" * 100), ("new", None, "n\n" * 60), ("gone", "one\ntwo", None), ("less", "a\nb", "a")], "path string, old string, new string")
    got = {}
    for r in agent.previewed(t).orderBy("path", "k").collect():
        got.setdefault(r.path, []).append(r.line)
    assert len(got["same"]) == 40 and got["edit"] == ["- a", "+ b"] * 20 and len(got["new"]) == 61 and got["gone"] == ["- one", "+ ", "- two"] and got["less"] == ["  a", "- b"]


def test_numbers_within_a_hot_group(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(30), i) for i in range(3000)] + [(None, 1, 5000), (None, 1, 5001)]
    df = spark.createDataFrame(rows, "g string, d int, id int")
    got = {r.id: r.k for r in folds.numbered(df.repartition(9), "g", [F.desc("d"), F.col("id")], "k").collect()}
    want = {5000: 0, 5001: 1}
    for g in ("hot", "a", "b", "c"):
        want |= {i: k for k, (_, i) in enumerate(sorted((-d, i) for x, d, i in rows if x == g))}
    assert got == want


def test_no_term_is_one_tasks_work(spark):
    """Words of queries are small and meet chunks by a broadcast: occurrences of a word that is in every chunk aren't dealt to one task. Queries of the same words are answered once, each with all hits."""
    import re

    from notegrove.operators import retrieval, search

    notes = spark.createDataFrame([(f"n{i:02}.md", f"alpha beta gamma{i % 3} alpha", i) for i in range(30)], "path string, content string, mtime long")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "beta, alpha?"), (3, "gamma1"), (4, "alpha zzz"), (5, "gamma2 alpha beta")], "query_id int, query string")
    for got in (retrieval.lexical(notes, q, 4), search.lexical(search.Index.build(notes, "words"), q, 4)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"SortMergeJoin \[term#\d+L?\]", plan)
        hits: dict = {}
        for r in sorted(got.collect(), key=lambda r: (r.query_id, r["rank"])):
            hits.setdefault(r.query_id, []).append((r.path, r.score))
        assert hits[1] == hits[2] and [p for p, _ in hits[1]] == [f"n{i:02}.md" for i in range(4)]
        assert [p for p, _ in hits[3]] == ["n01.md", "n04.md", "n07.md", "n10.md"] and [p for p, _ in hits[5]] == ["n02.md", "n05.md", "n08.md", "n11.md"] and 4 not in hits
