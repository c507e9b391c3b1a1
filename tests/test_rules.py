"""Rules on literal notes."""

import re

import pytest
from pyspark.sql import functions as F

from notegrove.functions import markdown as md
from notegrove.operators import agent, ask, blocks, knowledge, memory, retrieval, search, vault


def notes(spark, *rows):
    return spark.createDataFrame([(p, c, i) for i, (p, c) in enumerate(rows)], "path string, content string, mtime long")


def test_block_offsets_are_bytes():
    text = "# Títle\n\nFirst paragraph.\nmore\n\n- item one\n- item two\n> q\n"
    found = blocks.blocks(text)
    assert [b["kind"] for b in found] == ["heading", "paragraph", "list", "quote"]
    raw = text.encode()
    for b in found[1:]:
        assert raw[b["start"] : b["end"]].decode() == b["text"]
    assert found[0]["level"] == 1


def test_front_matter_is_no_block():
    text = "---\ntitle: Deep Dive\ntags:\n  - rust\n  - sqlite\n---\n\nBody here.\n"
    assert [b["text"] for b in blocks.blocks(text)] == ["Body here.\n"]
    assert len(blocks.blocks("---\ntitle: x\nno end")) == 1


def test_code_is_whole(spark):
    text = "```\n[[not a link]] #no\n" + "line of code here\n" * 400 + "```\nafter [[Yes]]\n"
    assert [b["kind"] for b in blocks.blocks(text)] == ["code", "paragraph"]
    assert len(blocks.chunks(text)) == 2
    r = md.parsed(notes(spark, ("a.md", text))).first()
    assert r.links == ["Yes"] and r.tags == []


def test_heading_paths():
    found = blocks.chunks("# Setup\nx\n## Database\ny\n# Next\nz\n")
    assert [(c["ordinal"], c["heading_path"], c["text"].strip()) for c in found] == [(0, "Setup", "x"), (1, "Setup > Database", "y"), (2, "Next", "z")]
    assert blocks.chunks("# Only\n## Headings\n") == []


def test_long_texts_are_split_with_overlap():
    text = "\n".join(" ".join(f"word{i}x{j}" for j in range(35)) for i in range(60))
    found = blocks.chunks(text)
    assert len(found) > 1 and all(c["tokens"] <= 600 for c in found)
    raw = text.encode()
    assert all(raw[c["start"] : c["end"]].decode() == c["text"] for c in found)
    for a, b in zip(found, found[1:]):
        assert b["start"] < a["end"] and b["text"].split("\n")[0] in a["text"]
    line = "w " * 3000
    parts = blocks.chunks(line)
    assert "".join(c["text"] for c in parts) == line and all(c["tokens"] <= 501 for c in parts)


def test_inline_items(spark):
    text = "See [[Target Note#Section|alias]] and [text](https://example.com). ![[Embed Note]] #tag1 (#tag2) x#no #1no\n\n> quoted [[Linked]] ^block-1"
    r = notes(spark, ("a.md", text)).select(md.wikilinks(F.col("content")).alias("w"), md.md_links(F.col("content")).alias("l"), md.embeds(F.col("content")).alias("e"), md.inline_tags(F.col("content")).alias("t"), md.block_id(F.col("content")).alias("b")).first()
    assert (r.w, r.l, r.e, r.t, r.b) == (["Target Note", "Linked"], ["https://example.com"], ["Embed Note"], ["tag1", "tag2"], "block-1")


def test_front_matter_fields(spark):
    text = "---\ntitle: \"Deep Dive\"\ntags:\n  - rust\n  - 'sqlite'\nexclude: true\n---\nBody #inline"
    r = md.parsed(notes(spark, ("dir/a.md", text))).select("title", "tags", md.excluded(F.col("front")).alias("x")).first()
    assert (r.title, r.tags, r.x) == ("Deep Dive", ["rust", "sqlite", "inline"], True)
    rows = md.parsed(notes(spark, ("d/b.md", "# Head\nx"), ("d/c.md", "x"), ("d/d.md", "---\nnot ended"))).orderBy("path").collect()
    assert [r.title for r in rows] == ["Head", "c", "d"]


@pytest.mark.parametrize(
    "sentence,kind,polarity",
    [
        ("We decided to use Rust.", "DECISION", 1),
        ("Maybe SQLite fits.", "HYPOTHESIS", 1),
        ("I prefer Vim.", "PREFERENCE", 1),
        ("I do not prefer cloud services.", "PREFERENCE", -1),
        ("My goal is speed.", "GOAL", 1),
        ("The build failed twice.", "EXPERIENCE", 1),
        ("What database should I pick?", "QUESTION", 1),
        ("I believe so.", "BELIEF", 1),
        ("The sky is blue.", "FACT", 1),
    ],
)
def test_claim_types(spark, sentence, kind, polarity):
    c = knowledge.claims(md.parsed(notes(spark, ("n.md", sentence)))).collect()
    assert [(x.claim_type, x.polarity) for x in c] == [(kind, polarity)]


def test_sentences_and_offsets(spark):
    text = "Ünö is first. Second one\n\n```\nno. code.\n```\n  Third e.g. here! v1.2 stays\n"
    got = knowledge.sentences(notes(spark, ("n.md", text))).orderBy("offset").collect()
    assert [r.sentence for r in got] == ["Ünö is first.", "Second one", "Third e.g.", "here!", "v1.2 stays"]
    raw = text.encode()
    assert all(raw[r.offset :].decode().startswith(r.sentence) for r in got)


def test_relation_gives_two_claims(spark):
    n = md.parsed(notes(spark, ("P.md", "# Project\nThis project uses [[Rust]] for the core and is fast.")))
    assert [tuple(r) for r in knowledge.relationships(n).collect()] == [("P.md", "Project", "uses", "Rust")]
    assert sorted((r.predicate, r.confidence) for r in knowledge.claims(n).collect()) == [("states", 0.8), ("uses", 0.7)]


def test_entities_merge_by_case(spark):
    n = md.parsed(notes(spark, ("A.md", "x [[Rust]]"), ("B.md", "y [[rust]]")))
    r = knowledge.entities(n).where("key = 'rust'").first()
    assert (r.canonical_name, r.type, r.source_count) == ("Rust", "CONCEPT", 2)


def test_links_heal_and_match_title_or_path(spark):
    a = ("A.md", "[[B]] [[some title]] [[dir/C]] [[none]]")
    n = md.parsed(notes(spark, a, ("B.md", "x"), ("dir/C.md", "y"), ("D.md", "# Some Title")))
    got = {r.target: r.resolved for r in knowledge.resolved_links(n).collect()}
    assert got == {"B": "B.md", "some title": "D.md", "dir/C": "dir/C.md", "none": None}


def test_ambiguous_renames(spark):
    state = spark.createDataFrame([("a", "h"), ("b", "h"), ("x", "k")], "path string, hash string")
    now = spark.createDataFrame([("c", "h"), ("y", "k"), ("z", "k")], "path string, hash string")
    diff = vault.inventory_diff(state, now)
    assert [tuple(r) for r in vault.renames(diff).collect()] == [("x", "y")]


def test_contradiction_order(spark):
    n = md.parsed(notes(spark, ("Old.md", "I prefer Vim for editing."), ("Zew.md", "I do not prefer Vim for editing anymore.")))
    r = memory.contradiction_pairs(knowledge.claims(n)).collect()
    assert [tuple(x) for x in r] == [("preference_conflict", "Old.md:0", "Zew.md:0")]
    each = memory.contradictions(knowledge.claims(n)).collect()
    assert sorted((x.at, x.polarity, x.opposed, x["first"]) for x in each) == [("Old.md:0", 1, 1, "Zew.md:0"), ("Zew.md:0", -1, 1, "Old.md:0")]
    h = memory.contradiction_heads(knowledge.claims(n)).first()
    assert (h.a, h.b, h.positives, h.negatives) == ("Old.md:0", "Zew.md:0", 1, 1)


def test_memory_is_cleaned(spark):
    n = md.parsed(notes(spark, ("a.md", "We decided to use [[PostgreSQL/Setup|Postgres]] for storage. Maybe not."), ("b.md", "I might use Rust. What database should I pick? Maybe SQLite perhaps.")))
    got = memory.candidates(knowledge.claims(n)).collect()
    assert [(r.path, r.type, r.content) for r in got] == [("a.md", "decision", "We decided to use Postgres for storage.")]
    assert "[[" in got[0].excerpt


def test_rejected_memories_stay_rejected(spark):
    e = spark.createDataFrame([(1, 1, 1, "reject"), (1, 2, 2, "accept"), (2, 1, 3, "accept"), (2, 2, 4, "stale"), (2, 3, 5, "accept")], "id int, ts int, event_id int, action string")
    assert {r.id: r.status for r in memory.fold_states(e, "id").collect()} == {1: "rejected", 2: "accepted"}


def test_ranking(spark):
    n = notes(spark, ("Rust.md", "rust systems language"), ("Cooking.md", "boil the water"))
    q = spark.createDataFrame([(1, "rust systems language"), (2, "iphone 7"), (3, "the and of"), (4, "\"rust\" (systems)")], "query_id int, query string")
    got = [(r.query_id, r.path) for r in retrieval.lexical(n, q).collect()]
    assert sorted(got) == [(1, "Rust.md"), (4, "Rust.md")]
    names = knowledge.mentions(md.parsed(n))
    h = search.hybrid(search.Index.build(n), q, names).where("query_id = 1").first()
    assert h.lexical == 1.0 and h.entity == 0.5 and h.score > 0.5


def test_tampering_shows(spark):
    e = spark.createDataFrame([(u, t, 10 * u + t, "x") for u in (1, 2) for t in range(5)], "user_id long, ts long, event_id long, event_type string")
    c = agent.chain(e)
    assert {r.user_id: r.holds for r in agent.verify(c, e).collect()} == {1: True, 2: True}
    bad = e.withColumn("event_type", F.when(F.col("event_id") == 12, "y").otherwise(F.col("event_type")))
    assert {r.user_id: r.holds for r in agent.verify(c, bad).collect()} == {1: False, 2: True}


def test_operations_refused(spark):
    f = spark.createDataFrame([(1, "a", "delete", "", ""), (2, "a", "edit", "x", "x"), (3, "a", "edit", "x", "y"), (3, "a", "edit", "x", "z"), (4, "a", "move", "", "")], "op int, path string, action string, old_content string, content string")
    got = {r.op: (r.risk, r.error) for r in agent.prepare(f).collect()}
    assert got == {1: ("low", "delete is disabled"), 2: ("low", "edit changes nothing"), 3: ("low", "duplicate file"), 4: ("medium", None)}


def test_words_of_lists_are_distinct():
    assert len(retrieval.STOP_WORDS) == len(set(retrieval.STOP_WORDS)) and re.fullmatch("[a-z ]+", " ".join(retrieval.STOP_WORDS))


def test_question_kinds(spark):
    got = dict(spark.createDataFrame([("organize my notes",), ("do they conflict",), ("how has my view changed",), ("Rust vs Go",), ("what did I decide",), ("what links here",), ("explain it",), ("what is x",), ("rust",)], "q string").select("q", ask.kind(F.col("q"))).collect())
    assert list(got.values()) == ["agent_task", "contradiction", "temporal", "comparison", "decision", "relationship", "synthesis", "semantic_search", "simple_search"]


def test_stems():
    from notegrove.functions.stem import stem

    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor hopping hop falling fall filing file happy happi sky sky relational relat conditional condit triplicate triplic hopeful hope revival reviv adoption adopt probate probat rate rate controll control café cafe databases databas"
    words = pairs.split()
    assert [stem(w) for w in words[::2]] == words[1::2]


def test_claims_about_an_entity_are_found_among_all(spark):
    """However many newer claims there are; four of them for a question, the last by path, offset and predicate."""
    n = notes(spark, ("A.md", "The seal of [[Old Works]] failed."), *[(f"Z{i:03}.md", "The box is blue.") for i in range(420)])
    q = spark.createDataFrame([(0, "old works"), (1, "about Old Works or z001"), (2, "nothing")], "query_id int, query string")
    c = ask.Context(n, q, search.Index.build(n, "words"))
    assert sorted((r.query_id, r.path, r.k) for r in c.claims.collect()) == [(0, "A.md", 1), (1, "A.md", 2), (1, "Z001.md", 1)]
    assert {r.query_id: r.claims for r in c.counts().collect()} == {0: 1, 1: 2, 2: 0}
    rows = [(f"{i % 7}.md", i % 5, f"s{i % 11}", f"p{i % 3}", f"o{i % 13} x") for i in range(600)]
    claims = spark.createDataFrame(sorted(set(rows)), "path string, offset long, subject string, predicate string, object string")
    named = spark.createDataFrame([(i, k) for i in range(40) for k in ("s1", f"o{i % 13}", "x s", "p0 o1")], "query_id int, key string")
    keys = {(r.query_id, r.key) for r in named.collect()}
    last = lambda i: sorted({x[:2] + (x[3],) for x in rows if any(k in f"{x[2]} {x[3]} {x[4]}" for j, k in keys if j == i)}, reverse=True)[:4]
    got = ask.about_claims(claims, named).collect()
    for i in range(40):
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r.k)
        assert [r.k for r in mine] == [1, 2, 3, 4] and [(r.path, r.predicate) for r in mine][0] == (last(i)[0][0], last(i)[0][2])
        assert {(r.path, r.predicate) for r in mine} <= {(x[0], x[2]) for x in last(i)}


def test_clusters_follow_links_by_file_names(spark, monkeypatch):
    """A link that no path or title bears leads to the first note of that file name; one that a title bears stays with it."""
    import duckdb

    from notegrove.operators import graph
    from notegrove.plans import fixtures as fx

    n = notes(
        spark,
        ("Parts/P1.md", "# Part 1\n\nSee [[p2]], [[Q3.md]] and [[Lone]]."),
        ("Parts/P2.md", "# Part 2"),
        ("Parts/Q3.md", "# Part 3"),
        ("Old/P2.md", "# Another"),
        ("More/Z.md", "# M\n\n[[Old/P2.md]] [[nowhere]]"),
        ("More/Lone.md", "# L\n\nalone"),
        ("Zed/Y.md", "# Lone"),
    )
    monkeypatch.setattr(fx, "vault", lambda *_: n)
    got = {r.id: r.component for r in graph.graph_components(spark, "").collect()}
    one = "note:More/Z.md"
    assert got == {f"note:{p}": one for p in ("Parts/P1.md", "Parts/Q3.md", "Old/P2.md", "More/Z.md", "Zed/Y.md", "nowhere")} | {f"note:{p}": f"note:{p}" for p in ("Parts/P2.md", "More/Lone.md")}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE odd (path VARCHAR, content VARCHAR, mtime BIGINT)")
    duck.executemany("INSERT INTO odd VALUES (?, ?, ?)", [(r.path, r.content, r.mtime) for r in n.collect()])
    for name, query in (("graph_components", graph.graph_components), ("clusters", graph.q_clusters), ("graph_edges", graph.graph_edges), ("graph_layout", graph.graph_layout)):
        df = query(spark, "")
        assert fx.VAULT in graph.ORACLE[name]
        found = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({graph.ORACLE[name].replace(fx.VAULT, 'SELECT * FROM odd')})").fetchall()
        assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, found)), name
