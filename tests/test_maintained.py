"""Tables kept by changes against tables made anew."""

import random

import pytest
from pyspark.sql import functions as F

from notegrove.functions import markdown as md
from notegrove.operators import knowledge as kn
from notegrove.operators import maintained, sync
from notegrove.operators.segments import Segments
from notegrove.sources import tables

SCHEMA = "path string, content string, version long"


def note(rng):
    if rng.random() < 0.25:
        return None
    title = rng.choice(["", "# Alpha\n\n", "# Beta\n\n", "# alpha\n\n", "---\ntitle: Gamma\n---\n"])
    lines = rng.sample(["We decided to use [[Alpha]].", "I prefer steel.", "See [[beta]] and [[n3]].", "This uses [[d/n2]].", "My goal is [[Gamma]]. #metal", "The seal is blue. #Metal"], rng.randint(0, 4))
    return title + "\n\n".join(lines)


def rows(df, *drop):
    return sorted(map(repr, df.drop(*drop).select(*sorted(c for c in df.columns if c not in drop)).collect()))


@pytest.mark.parametrize("seed", [3])
def test_changes_equal_a_rebuild(spark, tmp_path, seed):
    rng = random.Random(seed)
    k, now, when, paths = maintained.Knowledge(spark, f"file://{tmp_path}/k", buckets=3), {}, {}, [f"{f}n{i}.md" for i in range(4) for f in ("", "d/")]
    for n in range(4):
        batch = {p: note(rng) for p in rng.sample(paths, 5)}
        changes = spark.createDataFrame([(p, c, 10 * n) for p, c in batch.items()] + [(p, "# old", 10 * n - 1) for p in list(batch)[:2]], SCHEMA)
        k.apply(changes, n)
        k.apply(changes, n)  # a batch that is given again
        for p, c in batch.items():
            now.pop(p, None) if c is None else now.__setitem__(p, c)
            when[p] = 10 * n
    fresh = md.parsed(spark.createDataFrame([(p, c, when[p]) for p, c in now.items()], "path string, content string, mtime long"))
    assert rows(k.links.read(), "key") == rows(kn.resolved_links(fresh)) and k.links.read().where("resolved is not null").count()
    assert rows(k.claims.read()) == rows(kn.claims(fresh)) and rows(k.entities.read()) == rows(kn.entities(fresh))
    assert rows(k.relations.read()) == rows(kn.relationships(fresh)) and k.notes.read().count() == len(now)
    assert rows(k.mentions.read().select("key", "path").distinct()) == rows(kn.mentions(fresh))


def test_links_heal_and_only_touched_buckets_are_written(spark, tmp_path):
    k = maintained.Knowledge(spark, f"file://{tmp_path}/k", buckets=64)
    k.apply(spark.createDataFrame([("a.md", "[[Target]] and [[other]]", 1), ("b.md", "# Target", 1), ("c.md", "# target", 1), *[(f"x{i}.md", f"[[y{i}]]", 1) for i in range(20)]], SCHEMA))
    to = lambda: {r.target: r.resolved for r in k.links.read().where("path = 'a.md'").collect()}
    assert to() == {"Target": "b.md", "other": None}
    k.apply(spark.createDataFrame([("b.md", None, 2)], SCHEMA))
    assert to()["Target"] == "c.md" and len(k.touched["links"]) <= 2 and len(k.touched["claims"]) <= 1  # of the names lost (b, target) and one note
    k.apply(spark.createDataFrame([("d.md", "# Other", 3), ("c.md", "# Else", 3)], SCHEMA))
    assert to() == {"Target": None, "other": "d.md"}


def test_a_note_mentions_a_key_once(spark, tmp_path):
    """Tag, link and title that differ by case are one row, and sentences are judged once for claims, relations and memories."""
    k = maintained.Knowledge(spark, f"file://{tmp_path}/k", buckets=2)
    k.apply(spark.createDataFrame([("b.md", "# Steel\n\nThis uses [[STEEL]]. #steel", 1), ("a.md", "See [[Steel]] and [[steel]].", 2)], SCHEMA))
    assert sorted((r.path, r.key, r.name, r.k) for r in k.mentions.read().where("key = 'steel'").collect()) == [("a.md", "steel", "Steel", 1), ("b.md", "steel", "steel", 0)]
    e = k.entities.read().where("key = 'steel'").first()
    assert (e.canonical_name, e.type, e.first_seen, e.last_seen, e.source_count) == ("Steel", "CONCEPT", 1, 2, 2)


def test_memories_keep_their_review(spark, tmp_path):
    k = maintained.Knowledge(spark, f"file://{tmp_path}/k", buckets=2)
    put = lambda text: k.apply(spark.createDataFrame([("a.md", text, 1)], SCHEMA))
    got = lambda: {r.content: (r.type, r.status, r.claim_id in {c.claim_id for c in k.claims.read().collect()}) for r in k.memories.read().collect()}
    put("We decided to use steel. I prefer copper.")
    assert got() == {"We decided to use steel.": ("decision", "candidate", True), "I prefer copper.": ("preference", "candidate", True)}
    k.reviewed(spark.createDataFrame([("a.md", "We decided to use steel.", "accepted"), ("a.md", "I prefer copper.", "rejected"), ("z.md", "none", "accepted")], "path string, content string, status string"))
    put("# Moved down\n\nMore words. We decided to use steel. My goal is zero defects.")
    assert got() == {"We decided to use steel.": ("decision", "accepted", True), "I prefer copper.": ("preference", "rejected", False), "My goal is zero defects.": ("goal", "candidate", True)}
    put(None)
    assert {v[1:] for v in got().values()} == {("accepted", False), ("rejected", False), ("candidate", False)}


def test_sessions_refuse_and_feed_their_followers(spark, tmp_path):
    index = Segments(spark, f"file://{tmp_path}/i", buckets=2)
    s = sync.Sync(spark, f"file://{tmp_path}/s", buckets=2, followers=[index.apply])
    sent = lambda *n: spark.createDataFrame([(p, c, 1) for p, c in n], "path string, content string, mtime long").withColumn("hash", F.sha2("content", 256))
    why = lambda call: pytest.raises(sync.Refused, call).value.why
    assert why(lambda: s.commit("x")) == "no session"
    one = s.begin()
    assert s.batch(one, sent(("a", "copper"), ("b", "steel"))) == 2
    assert {(r.path, r.action) for r in s.commit(one).collect()} == {("a", "fetch"), ("b", "fetch")}
    assert why(lambda: s.finish(one)) == "2 requested notes were not sent"
    bad = sent(("a", "copper")).withColumn("hash", F.lit("0")).unionByName(sent(("b", "steel"), ("c", "tin")))
    assert {(r.path, r.outcome) for r in s.note(one, bad).collect()} == {("a", "hash mismatch"), ("b", "taken"), ("c", "not requested")}
    two = s.begin()  # the first is abandoned, what it took stays
    assert why(lambda: s.note(one, sent(("a", "copper")))) == "another session is open"
    s.batch(two, sent(("moved", "steel"), ("a", "copper")))
    assert {(r.path, r.action, r.moved_from) for r in s.commit(two).collect()} == {("a", "fetch", None), ("b", "moved", None), ("moved", "move", "b")}
    assert {r.outcome for r in s.note(two, sent(("a", None))).collect()} == {"content is required"} and s.note(two, sent(("a", "copper"))).first().outcome == "taken"
    assert s.note(two, sent(("a", "copper"))).first().outcome == "not requested" and s.finish(two) == 2
    assert {(r.path, r.text) for r in index.rows.collect()} == {("a", "copper"), ("moved", "steel")}
    three = s.begin(rebuild=True)
    assert s.notes.read().count() == 0 and index.rows.count() == 0 and s.commit(three).count() == 0 and s.finish(three) == 0


def test_buckets_rewrite_what_is_touched(spark, tmp_path):
    t = tables.Buckets(spark, f"file://{tmp_path}/t", "k long, v string", "k", 16)
    t.replace(spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v")), number=1)
    before = t.manifest()["at"]
    assert len(t.replace(spark.createDataFrame([(7, "b")], "k long, v string"), number=2)) == 1 and t.replace(spark.createDataFrame([(8, "c")], "k long, v string"), number=2) == []
    assert sum(before[b] != f for b, f in t.manifest()["at"].items()) == 1 and t.read().count() == 200 and t.read().where("v = 'b'").first().k == 7
    t.replace(spark.createDataFrame([], "k long, v string"), spark.range(200).withColumnRenamed("id", "k"))
    assert t.read().count() == 0 and t.manifest()["at"] == {} and t.swept() == 3
