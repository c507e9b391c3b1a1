"""Substrings by joined pieces against a loop; plans without nested loops."""

import random

from pyspark.sql import functions as F

from notegrove.operators import ask, retrieval, search
from notegrove.operators.contains import containing


def test_against_a_loop(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abé 🙂") for _ in range(n))
    texts = [make(rng.randrange(12)) for _ in range(150)] + [None, "", "abab" * 50]
    words = [make(rng.randrange(1, 7)) for _ in range(150)] + [None, "", "abab", "b" * 30]
    got = containing(spark.createDataFrame([(t, 1) for t in texts], "t string, word int"), "t", spark.createDataFrame([(w,) for w in words], "w string"), "w").collect()
    want = {(t, w) for t in texts if t is not None for w in words if w and w in t}
    assert len(got) == len(want) and {(r.text, r.word) for r in got} == want and len(want) > 300
    empty = spark.createDataFrame([], "w string")
    assert containing(empty, "w", empty, "w").count() == 0 and containing(spark.createDataFrame([("x",)], "w string"), "w", empty, "w").count() == 0


def test_no_nested_loops(spark):
    """However many queries there are, names and texts meet them by equality."""
    queries = spark.range(20_000).select(F.col("id").cast("int").alias("query_id"), F.concat(F.lit("copper seal "), "id").alias("query"))
    names = spark.range(20_000).select(F.concat(F.lit("name "), "id").alias("key"), F.concat("id", F.lit(".md")).alias("path"))
    relations = names.select(F.col("key").alias("source"), F.lit("uses").alias("relation"), F.col("path").alias("target"), "path")
    claims = names.select("path", F.lit(0).cast("long").alias("offset"), F.col("key").alias("subject"), F.lit("is").alias("predicate"), F.col("key").alias("object"))
    named = queries.select("query_id", F.concat(F.lit("name "), F.col("query_id") % 50).alias("key"))
    ix = search.Index.build(spark.createDataFrame([("a/copper.md", "# Seal\n\nSome text.")], "path string, content string"), "words")
    for df in (retrieval.entity_boosts(queries, names), ask.relevant(queries, names, "key", "key", 3), ask.named_entities(queries, names), ask.about_relations(relations, named), ask.about_claims(claims, named), search.fallback(ix, queries)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("NestedLoopJoin") == plan.count("NestedLoopJoin BuildRight, Cross") <= 2  # the one row of an index' size, in a plan used twice
        assert "Cartesian" not in plan
    found = retrieval.entity_boosts(queries.limit(50).withColumn("query", F.concat(F.lit("about Name "), "query_id")), names)
    assert found.where("query_id = 12").select("path").distinct().count() == 2  # "name 1" and "name 12"
