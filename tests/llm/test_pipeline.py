import sys

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import cases  # noqa: E402

import corpus_pipeline as cp  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(SF + "/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if k + 1 < len(cp.STAGES):
            assert out.columns == COLUMNS
        kept[name], docs = out, out
    ids = {n: {r.doc_id for r in df.select("doc_id").collect()} for n, df in kept.items()}
    assert ids["simhash"] < ids["toxicity"] and ids["simhash"] == ids["substring"] == ids["pii"] == ids["packing"]
    # substring: against brute force on what came in
    rows = sorted((r.doc_id, r.text) for r in kept["simhash"].collect())
    got = {r.doc_id: r.text for r in kept["substring"].collect()}
    for (i, text), (_, gone, left) in zip(rows, cases.brute_repeats(rows)):
        assert got[i] == (left if gone else text)
    # personal data: nothing is left to find but what redaction made
    from notegrove.llm import pii

    assert pii.pii_spans(kept["pii"]).where("size(base) > 0").count() == 0
    assert kept["packing"].count() >= len(ids["pii"])


def test_awkward_rows_pass_every_stage(spark):
    docs = cases.documents(spark)
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, SF)
        if k + 1 < len(cp.STAGES):
            assert docs.columns == COLUMNS
            docs = docs.cache()
    assert docs.count() > 0
    empty = cases.documents(spark, [])
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0


CLASHES = ["score", "Score2", "_score_in", "fp", "key", "n_words", "n_removed", "kept_text", "base", "spans", "_t", "_at", "_chunk", "_key", "_null", "_digits", "_others", "component", "label", "a.b"]


def test_clashing_columns_pass_every_stage(spark):
    """Columns that bear the names of what operators add or use come through with their values."""
    from pyspark.sql import functions as F

    docs = cases.documents(spark)
    for n in CLASHES:
        docs = docs.withColumn(n, F.concat(F.lit(n + " of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == COLUMNS + CLASHES
        for r in docs.collect():
            assert [r[n] for n in CLASHES] == [f"{n} of {'none' if r.doc_id is None else r.doc_id}" for n in CLASHES], name
    assert cp.STAGES[-1][1](spark, docs, SF).count() > 0


def test_operators_run_in_fresh_workers():
    """Python workers that have imported nothing yet run the operators with Arrow code."""
    import subprocess

    code = """
import sys
sys.path.insert(0, %r)
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false").config("spark.python.worker.reuse", "false").config("spark.python.use.daemon", "false").getOrCreate()
import notegrove
notegrove.ship(s)
from notegrove.llm import substring, sentencepieces
d = s.createDataFrame([(1, "a b c " * 30)], "doc_id long, text string")
print("SAW", substring.dedup_texts(d).count(), sentencepieces.round_trip(d).count())
""" % __file__.rsplit("/tests/", 1)[0]
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "SAW 1 1" in said.stdout, said.stderr[-2000:]


def test_run(spark):
    out = cp.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
