"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import added, table, text_of, without

_NOT_WORD = re.compile(r"[\W_]+")
PREFIXES = range(3, 9)


def terms(word: bytes) -> list[int]:
    """Hashed terms of one word: itself without punctuation, in lower case, and its first 3 to 8 characters."""
    w = _NOT_WORD.sub("", word.decode("utf-8", "replace").lower())
    if not w:
        return []
    names = ["=" + w] + [f"{k}{w[:k]}" for k in PREFIXES if len(w) >= k]
    return [xxhash.xxh64_intdigest(x.encode("utf-8", "replace"), 3) for x in names]


class _Terms(dict):
    """word -> what ``find`` gives, for at most ``most`` words at a time."""

    def __init__(self, find, most: int = 400_000):
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        self[word] = x = self.find(word)
        return x


class Model:
    """Terms (sorted hashes), bias ``b``, weights ``w`` and factors ``v`` of a second-order factorization machine."""

    def __init__(self, ids: np.ndarray, b: float, w: np.ndarray, v: np.ndarray):
        self.ids, self.b, self.w, self.v = ids, b, w, v
        self.place = {int(x): i for i, x in enumerate(ids)}

    def known(self, word: bytes) -> tuple[int, ...]:
        return tuple(i for t in terms(word) if (i := self.place.get(t)) is not None)

    def score(self, found: list[int]) -> float:
        z = self.b
        if found:
            x = self.v[found]
            s = x.sum(axis=0)
            z += self.w[found].sum() + 0.5 * float((s * s - (x * x).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _counted(docs: list[np.ndarray], group: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``docs`` and in how many of them each is; a group of documents at a time, so that no copy of all is made."""
    ids, c = np.empty(0, np.uint64), np.empty(0, np.int64)
    for k in range(0, len(docs), group):
        u, n = np.unique(np.concatenate(docs[k : k + group]), return_counts=True)
        ids, at = np.unique(np.concatenate((ids, u)), return_inverse=True)
        c = np.bincount(at, np.concatenate((c, n)), len(ids)).astype(np.int64)
    return ids, c


def fit(texts: list[bytes], labels: list[int], most_terms: int = 4096, factors: int = 4, epochs: int = 12, rate: float = 0.3, decay: float = 1e-3, margin: float = 2.0, seed: int = 11) -> Model:
    """Fit by AdaGrad on the logistic loss. The terms are the ``most_terms`` with the highest likelihood ratio against the label,
    those in at least 3 texts; a term counts once in a text. The order of the texts is that given, shuffled by ``seed``.
    Without texts of both labels the model is the bias alone. The bias is raised until 0.7 lies ``margin`` (in log-odds) above the 99.9 % of fitted clean texts, never lowered.
    """
    seen = _Terms(terms, 100_000)
    docs = [np.unique(np.fromiter((t for w in set(x.split()) for t in seen[w]), np.uint64)) for x in texts]
    del seen
    y = np.asarray(labels, float)
    n, pos = len(y), y.sum()
    if not n or pos in (0, n):
        return Model(np.empty(0, np.uint64), float(np.log((pos + 0.5) / (n - pos + 0.5))), np.empty(0), np.empty((0, factors)))
    ids, c = _counted(docs)
    ids, c = ids[c >= 3], c[c >= 3].astype(float)
    p = np.zeros(len(ids))
    toxic, k = _counted([d for d, one in zip(docs, y) if one])
    at = np.minimum(np.searchsorted(toxic, ids), max(len(toxic) - 1, 0))
    if len(toxic):
        p = np.where(toxic[at] == ids, k[at], 0).astype(float)
    xlogy = lambda a, b: a * np.log(np.where(a > 0, b, 1))
    g = xlogy(p, p / c * n / pos) + xlogy(c - p, (c - p) / c * n / (n - pos)) + xlogy(pos - p, (pos - p) / (n - c + 1e-9) * n / pos) + xlogy(n - c - pos + p, (n - c - pos + p) / (n - c + 1e-9) * n / (n - pos))
    good = np.flatnonzero(g > 4)
    good = np.sort(good[np.lexsort((ids[good], -g[good]))][:most_terms])
    chosen = ids[good]
    rows = []
    for d in docs:
        at = np.searchsorted(chosen, d)
        at[at == len(chosen)] = 0
        rows.append(at[chosen[at] == d] if len(chosen) else at[:0])
    del docs, ids
    rng = np.random.default_rng(seed)
    heavy = min(12.0, (n - pos) / pos)  # weight of the rarer label
    b, w, v = float(np.log(heavy * pos / (n - pos))), np.zeros(len(good)), rng.normal(0, 0.01, (len(good), factors))
    gb, gw, gv = 1e-8, np.full(len(good), 1e-8), np.full((len(good), factors), 1e-8)
    for _ in range(epochs):
        for i in rng.permutation(n):
            r = rows[i]
            x = v[r]
            s = x.sum(axis=0)
            z = b + w[r].sum() + 0.5 * float((s * s - (x * x).sum(axis=0)).sum())
            e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[i]) * (heavy if y[i] else 1.0)
            gb += e * e
            b -= rate * e / np.sqrt(gb)
            if len(r):
                d = e + decay * w[r]
                gw[r] += d * d
                w[r] -= rate * d / np.sqrt(gw[r])
                d = np.clip(e * (s - x), -5, 5) / max(1, len(r)) + decay * x
                gv[r] += d * d
                v[r] -= 0.1 * rate * d / np.sqrt(gv[r])
    # calibration: nearly all clean rows fitted stay this far below 0.7, and what lies above them needs no more than that
    model = Model(chosen, b, w, v)
    clean = [model.score(r.tolist()) for r, one in zip(rows, y) if not one]
    high = float(np.quantile(clean, 0.999))
    model.b += max(0.0, np.log(0.7 / 0.3) - (np.log(high / (1 - high)) + margin))
    return model


def held_out(id_col: str = "doc_id"):
    """True for rows that learning never sees: crc32 of the id as text, modulo 3, is 1 (a null id is never learnt from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def trained(docs: DataFrame, labels: DataFrame, most_rows: int = 6000, most_mb: float = 64.0) -> Model:
    """A model of at most ``most_rows`` labelled rows that are not held out (the bound of the sample; those with the
    least hashes of their ids). They are fitted in one task; only the model (at most 4096 terms) comes to the driver.
    Rows are taken in this order while their texts fill ``most_mb`` MB; one that doesn't fit any more is left out (never shortened), and the next ones are tried.
    Texts over a sixteenth of that aren't drawn.
    Labels that are null count as missing; of several labels of a document the highest holds.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    known = known.where(~held_out()).withColumn("_h", F.xxhash64(F.col("doc_id"), F.lit(5)))
    # labels are narrow: the sample is drawn from them, and only its texts are read; over-drawn, as a label may lack a document
    drawn = known.orderBy("_h", "doc_id").limit(2 * most_rows)
    fit_in = F.octet_length(text_of()) <= most_mb * 1e6 / 16
    rows = docs.where(fit_in).select("doc_id", text_of().alias("_text")).join(F.broadcast(drawn), "doc_id").orderBy("_h", "doc_id", "_text").limit(most_rows)
    out = T.StructType([T.StructField("b", T.DoubleType()), T.StructField("ids", T.BinaryType()), T.StructField("w", T.BinaryType()), T.StructField("v", T.BinaryType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_h", "ascending"), ("doc_id", "ascending"), ("_text", "ascending")])
        texts, y, size = [], [], 0
        for x, label in zip(t.column("_text").cast(pa.binary()).to_pylist(), t.column("_y").to_pylist()):
            if size + len(x) <= most_mb * 1e6:
                texts.append(x)
                y.append(int(label > 0))
                size += len(x)
        m = fit(texts, y)
        return pa.table([[m.b], pa.array([m.ids.tobytes()], pa.binary()), pa.array([m.w.tobytes()], pa.binary()), pa.array([m.v.tobytes()], pa.binary())], names=["b", "ids", "w", "v"])

    got = rows.groupBy(F.lit(0).alias("one")).applyInArrow(run, out).collect()
    if not got:
        return fit([], [])
    r, k = got[0], 4
    w = np.frombuffer(bytes(r.w))
    return Model(np.frombuffer(bytes(r.ids), np.uint64), r.b, w, np.frombuffer(bytes(r.v)).reshape(len(w), k) if len(w) else np.empty((0, k)))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1) of each whole text; null, empty and blank texts get the bias' score.

    A term counts once in a text, so very long texts and repeated words do not outweigh the rest. A column ``score`` of the input is replaced.
    """
    docs = without(docs, ["score"])
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast((model.ids, model.b, model.w, model.v))  # at most 4096 terms

    def run(batches):
        m = Model(*sent.value)
        seen = _Terms(m.known, 120_000)
        for b in batches:
            out = []
            for t in b.column(at).cast(pa.binary()).to_pylist():
                found: set[int] = set()
                for w in set((t or b"").split()):
                    found.update(seen[w])
                out.append(m.score(sorted(found)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, added(docs.schema, ("score", T.DoubleType())))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``score``, learnt from ``labels`` (doc_id, toxic); see ``trained`` and ``scored``."""
    return scored(docs, trained(docs, labels))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
