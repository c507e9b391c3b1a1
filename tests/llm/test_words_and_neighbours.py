"""Spelling variants, nearest neighbours and phrases against brute force."""

import random
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import cases  # noqa: E402

from notegrove.llm import neighbours, phrases, queries, variants  # noqa: E402

# --- spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, shortest=5, least=3):
    n = Counter()
    for doc, text in rows:
        for run in variants.RUN.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}
    out = {}
    for w in n:
        others = sorted((-n[x], x) for x in n if x != w and near(w, x))
        has = bool(others) and -others[0][0] >= 2 * n[w]
        out[w] = [others[0][1] if has else None, w, n[w], len(others), -others[0][0] if has else None]
    for w in out:
        x = w
        while out[x][0]:
            x = out[x][0]
        out[w][1] = x
    return {w: tuple(v) for w, v in out.items()}


def variants_of(spark, rows, **kind):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(df, **kind).collect()}


@pytest.mark.parametrize("cell", [100_000, 40])
def test_variants(spark, cell, monkeypatch):
    """Cells of few code points are split down to single places; very long words aren't."""
    monkeypatch.setattr(variants, "CELL", cell)
    monkeypatch.setattr(variants, "FEW", 64 if cell > 40 else 4)
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(250)] + ["Straße", "strase", "STRASSE", "zzzzz", "zzzzzz", "zzzzzzz"]
    rows = [(i, " ".join(rng.choices(vocabulary, weights=[1 + k % 23 for k in range(len(vocabulary))], k=60)) + ", zzzzz-zzzzzz zzzzzzz") for i in range(60)]
    rows += [(None, "aaaaa bbbbb aaaaa bbbbb zzzzz"), (7, None), (8, ""), (9, "x" * 60_000 + " " + "x" * 30_000 + "y" + "x" * 29_999), (9, "x" * 60_000), (9, "x" * 60_000 + "1" + "x" * 30_000 + "y" + "x" * 29_999), (10, "x" * 30_000 + "y" + "x" * 29_999), (3, rows[3][1])]
    got, want = variants_of(spark, rows), brute_variants(rows)
    assert got == want and any(v[3] > 2 for v in want.values()) and any(v[1] != w and v[1] != v[0] for w, v in want.items())


def test_variants_of_nothing(spark):
    assert variants_of(spark, []) == {} and variants_of(spark, [(1, None), (2, "a b c")]) == {}


def test_wavelet():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 100):
        p = rng.permutation(n)
        x0, x1, y0, y1 = (np.sort(rng.integers(0, n + 1, (2, 50)), axis=0)[k] for k in (0, 1, 0, 1))
        y0, y1 = np.sort(rng.integers(0, n + 1, (2, 50)), axis=0)
        q, y = variants.Wavelet(p).report(x0, x1, y0, y1)
        want = {(k, int(v)) for k in range(50) for v in p[x0[k] : x1[k]] if y0[k] <= v < y1[k]}
        assert set(zip(q.tolist(), y.tolist())) == want and len(q) == len(want)


# --- nearest neighbours


def brute_nearest(rows, k=20):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            found = sorted((-float(np.dot(v, w)), j) for j, w in ok if j != i and len(v) == len(w))[:k]
            out[i] = [(j, -s) for s, j in found]
    return out


def nearest_of(spark, rows, k=20):
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    out = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_index_finds_all_within_a_radius():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    code = neighbours.Code(x[:500], float(np.sqrt((x * x).sum(axis=1)).max()))
    codes = code.rows(x)
    index = neighbours.Index(codes)
    for q in code.asked(rng.normal(size=(10, 24))):
        far = np.bitwise_count(codes.view(np.uint64) ^ q.view(np.uint64)).sum(axis=1)
        for radius in (0, 3, 15, 16, 40, 90, 130, 256):
            assert set(index.within(q, radius).tolist()) == set(np.flatnonzero(far <= radius).tolist())


def test_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 32)) * rng.uniform(0.5, 2, size=(4000, 1))  # lengths differ, so the largest product isn't the least angle
    x[3000:3600] = x[7] + 0.02 * rng.normal(size=(600, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = nearest_of(spark, rows), brute_nearest(rows)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    for q, found in got.items():
        assert all(abs(s - float(np.dot(x[q], x[i]))) < 1e-9 for i, s in found) and [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)


def test_neighbours_awkward_rows(spark):
    rng = np.random.default_rng(8)
    one = rng.normal(size=8).tolist()
    rows = [(i, one) for i in range(70)] + [(i, rng.normal(size=8).tolist()) for i in range(70, 100)]  # most rows are one vector
    rows += [(100, None), (120, [0.0] * 8), (140, [float("nan")] + [1.0] * 7), (160, [None] + [1.0] * 7), (180, [float("inf")] * 8), (200, []), (220, [1.0, 2.0]), (221, [2.0, 1.0]), (240, [5.0]), (None, one), (0, one), (260, [1e200, 1.0])]
    got, want = nearest_of(spark, rows), brute_nearest(rows)
    assert set(got) == {q for q, v in want.items() if v}
    for q, found in got.items():
        assert [i for i, _ in found][:20] == [i for i, _ in want[q]][:20] and np.allclose([s for _, s in found], [s for _, s in want[q]])
    assert got[220] == [(260, 1e200 + 2), (221, 4.0)] and 240 not in got
    assert nearest_of(spark, []) == {} and nearest_of(spark, [(1, [1.0]), (2, [2.0])]) == {}


# --- phrases


def test_phrases_against_sql(spark):
    rng = random.Random(4)
    words = "the of Seal copper bolt é %% it's new York city hall".split()
    rows = [(i, rng.choice([" ", "  ", "\t"]).join(rng.choice(words) + rng.choice(["", "", "", ",", "!", "\n", "\x0b", "\x0d"]) for _ in range(120)), rng.choice(["en", "de", None, "und"]), "s", 1) for i in range(200)]
    rows += [(500 + i, "New York City Hall. new york", "en", "s", 1) for i in range(60)] + [(600, None, "en", "s", 1), (601, "", None, None, None), (602, " \t;;. ", "xx", "s", 0), (None, "the " * 5000, "long", "s", 1)]
    docs = cases.documents(spark, rows).withColumn("rank", F.lit("x")).withColumn("phrase", F.lit(1))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang").toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(queries.ORACLE["op13_phrases"]).fetchall()
    got = phrases.collocations(docs).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) > 50
    # the order within a language, and phrases whose words lie in longer ones
    assert {"new york city hall"} <= {r.phrase for r in got} and not {"york city", "city hall"} & {r.phrase for r in got if r.lang == "xx"}


def test_phrases_by_python(spark, monkeypatch):
    """Counts by a plain loop; a map of few bits prunes nothing and changes nothing."""
    monkeypatch.setattr(phrases, "MAP_BITS", 10)
    rng = random.Random(9)
    text = ["".join(rng.choice("abc ") for _ in range(400)) for _ in range(30)]
    docs = cases.documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(text)])
    f, total = Counter(), 0
    for t in text:
        w = t.split()
        total += len(w)
        for n in range(1, 5):
            f.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
    found = {r.phrase: r for r in phrases.collocations(docs, least=10, top=10**6).collect()}
    for g, a in f.items():
        w = g.split()
        if len(w) < 2 or a < 10:
            assert g not in found
            continue
        score, k = min((2000000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w)))
        hidden = any(100 * b >= 80 * a for x, b in f.items() if b >= 10 and len(x.split()) > len(w) and f" {g} " in f" {x} ")
        assert (g in found) == (not hidden)
        if not hidden:
            r = found[g]
            assert (r.a, r.l, r.r, r.n, r.score) == (a, f[" ".join(w[:k])], f[" ".join(w[k:])], total, score)
    assert phrases.collocations(cases.documents(spark, [])).count() == 0
