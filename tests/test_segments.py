"""The segmented index after any sequence of changes against one built anew."""

import os
import random

import pytest

from notegrove.operators import segments
from notegrove.operators.search import Index, lexical
from notegrove.streaming import notes as streams

SCHEMA = "path string, content string, version long"
WORDS = "copper steel seal wear valve brass tin".split()


def text(rng):
    if rng.random() < 0.2:
        return rng.choice(["", "# only a heading", None])
    return "\n\n".join(("# H\n\n" if rng.random() < 0.3 else "") + " ".join(rng.choices(WORDS, k=rng.randint(1, 12))) for _ in range(rng.randint(1, 3)))


def files_of(top):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(top) for f in names if f.endswith(".parquet")}


def same(spark, ix, now):
    """Rows, statistics and rankings equal those of an index of the notes that there are."""
    fresh = Index.build(spark.createDataFrame([(p, c) for p, c in now.items()], "path string, content string"), "words")
    pick = lambda df: sorted((r.path, r.ordinal, r.heading_path, r.text, sorted(r.terms), r.n_terms) for r in df.collect())
    assert pick(ix.rows) == pick(fresh.rows)
    assert [(r.n, r.avg and round(r.avg, 9)) for r in ix.size().collect()] == [(r.n, r.avg and round(r.avg, 9)) for r in fresh.size().collect()]
    queries = spark.createDataFrame([(0, "copper"), (1, "steel seal"), (2, "valve brass tin"), (3, "zinc")], "query_id int, query string")
    found = lambda x: sorted((r.query_id, r["rank"], r.path, r.ordinal, r.score) for r in lexical(x, queries).collect())
    assert found(ix) == found(fresh)


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_equal_a_rebuild(spark, tmp_path, seed):
    rng = random.Random(seed)
    ix, now = segments.Segments(spark, f"file://{tmp_path}/i", buckets=2, fan_in=3), {}
    for n in range(5):
        batch = {}
        for _ in range(rng.randint(3, 8)):
            batch.setdefault(f"n{rng.randrange(10)}.md", []).append(text(rng))
        rows = [(p, c, v) for p, cs in batch.items() for v, c in enumerate(cs)]
        rng.shuffle(rows)
        before = files_of(tmp_path)
        ix.apply(spark.createDataFrame(rows, SCHEMA), n)
        assert before.items() <= files_of(tmp_path).items()  # nothing that was written is written again
        for p, cs in batch.items():
            now.pop(p, None) if cs[-1] is None else now.__setitem__(p, cs[-1])
        if n == 3:
            same(spark, ix, now)
    assert ix.merge() >= 1 and len(ix.manifest()["segments"]) < 5
    same(spark, ix, now)


def test_a_batch_counts_once_and_ties_are_decided(spark, tmp_path):
    ix = segments.Segments(spark, f"file://{tmp_path}/i", buckets=2)
    assert ix.rows.count() == 0 and ix.size().first().n == 0
    ix.apply(spark.createDataFrame([("a", "one", 1), ("a", None, 1), ("a", "two", 1), ("b", "x", 2), ("b", None, 3)], SCHEMA), 0)
    ix.apply(spark.createDataFrame([("a", "other", 9)], SCHEMA), 0)
    assert [(r.path, r.text) for r in ix.rows.collect()] == [("a", "two")] and len(ix.manifest()["segments"]) == 1
    ix.apply(spark.createDataFrame([], SCHEMA), 1)
    ix.apply(spark.createDataFrame([("zz", None, 1), ("a", None, 1)], SCHEMA), 2)
    assert ix.rows.count() == 0 and ix.size().first().n == 0 and lexical(ix, spark.createDataFrame([(1, "two")], "query_id int, query string")).count() == 0


def test_postings_read_only_their_buckets(spark, tmp_path):
    ix = segments.Segments(spark, f"file://{tmp_path}/i", buckets=8)
    ix.apply(spark.createDataFrame([("a", " ".join(WORDS), 1)], SCHEMA), 0)
    plan = ix.hits(spark.createDataFrame([("copper",)], "term string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(b" in plan or "PartitionFilters: [(b" in plan


def test_stream_keeps_the_index(spark, tmp_path):
    """A note that became empty or was deleted loses its chunks; of two versions in a batch the newer holds."""
    ix, folder = segments.Segments(spark, f"file://{tmp_path}/index", buckets=2), f"{tmp_path}/in"
    for rows in ([("a", "first text", 1), ("b", "other", 1), ("c", "gone soon", 1)], [("a", "old", 2), ("a", "# H\n\nnew\n\n# I\n\ntext", 3), ("b", "# only a heading", 2), ("c", None, 2)]):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(folder)
        streams.indexed(spark.readStream.schema(SCHEMA).parquet(folder), ix, f"{tmp_path}/log").awaitTermination()
    assert sorted((r.path, r.text) for r in ix.rows.collect()) == [("a", "new\n"), ("a", "text")]


def test_top_skips_and_ranks_alike(spark, tmp_path):
    """The first few of many chunks, with dead ones among them, equal those of a full search; most blocks stay closed."""
    rng = random.Random(8)
    ix = segments.Segments(spark, f"file://{tmp_path}/i", buckets=2)
    make = lambda i: " ".join(["copper"] * rng.choice([0, 0, 0, 0, 0, 1, 1, 6]) + ["steel"] * rng.choice([0, 0, 0, 1, 3]) + rng.choices(WORDS[2:], k=rng.choice([3, 10, 40, 150, 300])))
    ix.apply(spark.createDataFrame([(f"n{i:04}", make(i), 1) for i in range(1500)], SCHEMA))
    ix.apply(spark.createDataFrame([(f"n{i:04}", None if i % 2 else make(i), 2) for i in range(0, 1500, 5)], SCHEMA))
    queries = spark.createDataFrame([(0, "copper"), (1, "steel copper"), (2, "zinc"), (3, "copper zinc"), (4, "valve seal"), (5, "the")], "query_id int, query string")
    pick = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.path, r.score) for r in df.collect())
    for limit in (1, 7, 2000):
        found, done = ix.top(queries, limit)
        assert pick(found) == pick(lexical(ix, queries, limit))
        read = {r.query_id: (r.opened, r.blocks) for r in done.collect()}
        assert limit == 2000 or (2 * read[0][0] < read[0][1] and read[1][0] < read[1][1]), read
        assert read[3] == (0, read[0][1])
