"""What keeps tasks small: notes are dealt before they are made, and words are counted in their rows."""

from pyspark.sql import functions as F

from notegrove.functions import markdown as md
from notegrove.operators import graph, knowledge, search, segments
from notegrove.operators import retrieval as rt
from notegrove.plans import fixtures as fx
from notegrove.sources import tables

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_vault_of_small_files_is_many_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fx.vault(spark, SF).rdd.getNumPartitions() >= 3 * n


def test_tallied(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "ä"]), (2, []), (3, None), (4, ["x"])], "id int, w array<string>")
    got = {r.id: r.t if r.t is None else [tuple(x) for x in r.t] for r in rows.select("id", rt.tallied(F.col("w")).alias("t")).collect()}
    assert got == {1: [("a", 1), ("b", 2), ("ä", 1)], 2: [], 3: None, 4: [("x", 1)]}


def test_hits_are_counted_in_their_chunks(spark):
    notes = spark.createDataFrame([("A.md", "copper steel copper"), ("B.md", "zinc"), ("C.md", "")], "path string, content string")
    ix = search.Index.build(notes, "words")
    hits = ix.hits(spark.createDataFrame([("copper",), ("zinc",)], "term string"))
    assert "Aggregate" not in _plan(hits)
    assert sorted((r.path, r.term, r.tf, r.n_terms) for r in hits.collect()) == [("A.md", "copper", 2, 3), ("B.md", "zinc", 1, 1)]


def test_vectors_are_made_in_their_rows(spark):
    texts = spark.createDataFrame([("a", "copper Copper steel"), ("b", ""), ("c", None), ("d", "...")], "path string, content string")
    v = rt.vectors(texts, "path", "content")
    assert "Aggregate" not in _plan(v) and "Exchange" not in _plan(v)
    rows = v.collect()
    assert [r.path for r in rows] == ["a"]
    assert sorted(abs(x.weight) for x in rows[0].v) == [1, 2] and abs(rows[0].length - 5**0.5) < 1e-12
    assert [x.bucket for x in rows[0].v] == sorted(x.bucket for x in rows[0].v)


def test_a_graph_takes_notes_apart_once(spark):
    n, e = graph._graph(spark, SF)
    assert "p_partkey" not in _plan(n) and "p_partkey" not in _plan(e)


def test_batches_of_changes_take_notes_made_once(spark):
    rows = segments.changes(spark, SF)
    assert "p_partkey" not in _plan(rows) and _plan(rows).count("FileScan") > 1
    assert _plan(rows.where("batch = 2")).count("FileScan") == 1


def test_a_large_bucket_is_several_tasks(spark, tmp_path):
    """All rows have one key, as a tag that every note has."""
    t = tables.Buckets(spark, f"file://{tmp_path}/t", "k long, v string", "k", 4)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        t.update(spark.createDataFrame([(7,)], "k long"), lambda _: spark.range(0, 20000, 1, 4).select(F.lit(7).cast("long").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list(tmp_path.glob("t/*/_b=*/*.parquet"))) > 1 and t.read().distinct().count() == 20000


def test_postings_are_grouped_where_their_range_is(spark, tmp_path):
    """Chunks are sent once, by range; their postings aren't. The ids of chunks, which no compression shortens, are made when postings are opened."""
    ix = segments.Segments(spark, f"file://{tmp_path}/i", buckets=2)
    ix.apply(spark.createDataFrame([("a", "copper steel copper", 1), ("b", "copper", 1)], "path string, content string, version long"))
    assert _plan(ix._blocks(ix._read("chunks"), 2, 4)).count("Exchange") == 1
    assert "chunk_id" not in ix._read("postings").schema.simpleString()
    ids = {r.path: r.chunk_id for r in ix._read("chunks").collect()}
    hits = ix.hits(spark.createDataFrame([("copper",), ("steel",)], "term string")).collect()
    assert sorted((r.path, r.term, r.tf, r.chunk_id == ids[r.path]) for r in hits) == [("a", "copper", 2, True), ("a", "steel", 1, True), ("b", "copper", 1, True)]


def test_boosts_are_those_of_candidates(spark, monkeypatch):
    """A name that all queries hold and all notes bear makes no product: only notes that a query finds get a boost of it."""
    notes = spark.createDataFrame([(f"N{i}.md", f"seal{i} [[ax]]") for i in range(20)], "path string, content string").withColumn("mtime", F.lit(0))
    queries = spark.createDataFrame([(i, f"seal{i} ax") for i in range(20)], "query_id int, query string")
    names = knowledge.mentions(md.parsed(notes))
    every, made = rt.entity_boosts(queries, names), []
    monkeypatch.setattr(rt, "entity_boosts", lambda *a, real=rt.entity_boosts: made.append(real(*a)) or made[-1])
    hits = search.hybrid(search.Index.build(notes, "words"), queries, names).collect()
    assert [(r.query_id, r.path) for r in sorted(hits)] == [(i, f"N{i}.md") for i in range(20)]
    assert every.count() == 400 and made[0].count() == 20 and made[0].exceptAll(every).isEmpty()
    assert {r.entity for r in hits} == {r.boost for r in made[0].collect()}
