"""Approximate nearest neighbours by multi-index hashing: learned rotated codes, an index for each substring, pigeonhole probes, exact reranking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import stored, table
from .embeddings import usable

#: Bits of a code and of a substring; vectors that rotations are learnt from at most, and their MB; queries that the radius is measured with.
BITS, SUB, SAMPLE, SAMPLE_MB, MEASURED = 256, 16, 4096, 64, 64
#: The share of true neighbours, of the measured queries, that the radius covers.
COVERED = 0.98
#: Vectors and queries that meet in one cell at most, about; and the least number of cells a side.
ROWS, ASKED, SIDE = 16_384, 8_192, 3

#: All 16-bit masks by number of set bits, and how many have up to t.
_MASKS = np.argsort(np.bitwise_count(np.arange(1 << SUB, dtype=np.uint32)), kind="stable").astype(np.uint16)
_BALL = np.cumsum([math.comb(SUB, t) for t in range(SUB + 1)])


class Code:
    """Binary codes of vectors: rotations of principal components, learnt on a sample so that signs lose least.

    Vectors are lifted to one length first (one more component, as large as their length is short of the longest), after which the largest inner product is the least distance.
    Where components are fewer than bits, several rotations from different starts follow one another.
    """

    def __init__(self, sample: np.ndarray, longest: float, rounds: int = 12, seed: int = 12):
        self.longest = longest
        rng = np.random.default_rng(seed)
        x = self.lifted(sample)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        value, axis = np.linalg.eigh(x.T @ x)
        keep = value > 1e-9 * max(value[-1], 1e-30)
        axis = axis[:, keep][:, ::-1][:, :BITS] if keep.any() else np.eye(x.shape[1])[:, :BITS]
        v, k = x @ axis, axis.shape[1]
        turns = []
        for _ in range(-(-BITS // k)):
            turn = np.linalg.qr(rng.normal(size=(k, k)))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(v.T @ np.where(v @ turn >= 0, 1.0, -1.0))
                turn = u @ w
            turns.append(axis @ turn)
        self.axes = np.concatenate(turns, axis=1)[:, :BITS]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def _bits(self, x: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(x), BITS), bool)
        bits[:, : self.axes.shape[1]] = (x - self.mean) @ self.axes >= 0
        return np.packbits(bits, axis=1)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Codes of indexed vectors, ``BITS`` / 8 bytes each."""
        return self._bits(self.lifted(x))

    def asked(self, x: np.ndarray) -> np.ndarray:
        """Codes of queries: their direction alone, as that decides the order of inner products."""
        y = x / np.abs(x).max(axis=1, keepdims=True)
        y = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
        return self._bits(np.concatenate([y, np.zeros((len(y), 1))], axis=1))


class Index:
    """The codes of some vectors, indexed by each of their substrings."""

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        subs = np.ascontiguousarray(codes).view(np.uint16).T
        self.order = [np.argsort(s, kind="stable") for s in subs]
        self.keys, self.first = [], []
        for s, order in zip(subs, self.order):
            keys, first = np.unique(s[order], return_index=True)
            self.keys.append(keys)
            self.first.append(np.append(first, len(s)))

    def _held(self, table: int, sub: int, t: int) -> np.ndarray:
        """Numbers of the table's keys that differ from ``sub`` in ``t`` bits or fewer: the masks are tried, or the keys if these are fewer."""
        keys = self.keys[table]
        if _BALL[t] >= len(keys):
            return np.flatnonzero(np.bitwise_count(keys ^ np.uint16(sub)) <= t)
        tried = _MASKS[: _BALL[t]] ^ np.uint16(sub)
        at = np.minimum(np.searchsorted(keys, tried), len(keys) - 1)
        return at[keys[at] == tried]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows at Hamming distance ``radius`` or less.

        Of m substrings with thresholds that sum to radius - m + 1, one at least is kept to by every such row: otherwise each differs in its threshold + 1 or more,
        radius + 1 in all. So what the tables hold within their thresholds is all there is, and whole codes decide.
        """
        m = len(self.order)
        total = radius - m + 1
        near = np.zeros(len(self.words), bool)
        for k, sub in enumerate(code.view(np.uint16).tolist()):
            t = min(SUB, total // m + (k < total % m))
            if t < 0:
                continue
            held = self._held(k, sub, t)
            at, many = self.first[k][held], np.diff(self.first[k])[held]
            steps = np.arange(int(many.sum())) + np.repeat(at - np.cumsum(many) + many, many)
            near[self.order[k][steps]] = True
        found = np.flatnonzero(near)
        return found[np.bitwise_count(self.words[found] ^ code.view(np.uint64)).sum(axis=1) <= radius]


def _vectors(column) -> np.ndarray:
    """A column of arrays of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _best(score: np.ndarray, ids: list[list[int]], most: int) -> tuple[list[int], list[float]]:
    """The ``most`` best of the rows that classes of vectors stand for: largest score, then smallest id."""
    order = np.argsort(-score, kind="stable")
    size = np.cumsum([len(ids[k]) for k in order[: most * 2]] or [0])
    enough = int(np.searchsorted(size, most))
    last = score[order[min(enough, len(order) - 1)]]
    rows = sorted((-score[k], i) for k in order[: int(np.searchsorted(-score[order], -last, side="right"))] for i in ids[k])[:most]
    return [i for _, i in rows], [-float(s) for s, _ in rows]


def _measure(classes: DataFrame, models: dict, asked: dict, k: int) -> dict[int, int]:
    """For each length of vectors the Hamming radius that covers ``COVERED`` of the true ``k`` nearest of the queries ``asked`` (a bounded number), found by comparing them with all rows."""
    told = classes.sparkSession.sparkContext.broadcast((models, asked))

    def nearest(batches):
        kept: dict = {}
        for b in batches:
            dim = np.asarray(b.column(0))
            for d in np.unique(dim).tolist():
                code, q = told.value[0][d], told.value[1][d]
                if not len(q):
                    continue
                x = _vectors(b.column(1).filter(pa.array(dim == d)))
                score = q @ x.T
                far = np.bitwise_count(code.asked(q).view(np.uint64)[:, None] ^ code.rows(x).view(np.uint64)[None]).sum(axis=2).astype(np.int64)
                same = (x[None, :, 0] == q[:, None, 0]) & (score > 0)
                for n in range(len(q)):
                    s, f = score[n], far[n]
                    other = ~(same[n] & (x == q[n]).all(axis=1)) if same[n].any() else np.ones(len(x), bool)
                    s, f = s[other], f[other]
                    if (d, n) in kept:
                        s, f = np.concatenate((kept[d, n][0], s)), np.concatenate((kept[d, n][1], f))
                    at = np.argsort(-s, kind="stable")[:k]
                    kept[d, n] = s[at], f[at]
        for (d, n), (s, f) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(s), pa.int32()), pa.array([n] * len(s), pa.int32()), pa.array(s), pa.array(f)], names=["n_dim", "n", "score", "far"])

    rows = classes.select("n_dim", "v").mapInArrow(nearest, "n_dim int, n int, score double, far long")
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("n_dim", "n").orderBy(F.desc("score"), "far"))).where(F.col("r") <= k)
    found = {r.n_dim: r.far for r in best.groupBy("n_dim").agg(F.ceil(F.percentile("far", F.lit(COVERED))).alias("far")).collect()}  # a row for each length of vectors
    return {d: min(BITS, found.get(d, 0) + 1) for d in models}


def _searched(coded: DataFrame, asked: DataFrame, grid: dict, radius: dict, models: dict, k: int) -> DataFrame:
    """(k1, k2, score, vec_id) of the ``k`` best rows within ``radius`` of each query ``asked`` (k1, k2, n_dim, v).

    Vectors and queries meet in a grid of cells of bounded size, dealt by hash; each cell indexes its vectors and answers its queries.
    """
    def of(number: int):
        chain = F.lit(SIDE)
        for d, g in grid.items():
            chain = F.when(F.col("n_dim") == d, g[number]).otherwise(chain)
        return chain

    here = lambda n, seed: F.pmod(F.xxhash64("k1", "k2", F.lit(seed)), n).cast("int")
    left = coded.select("n_dim", here(of(0), 5).alias("i"), F.explode(F.sequence(F.lit(0), of(1) - 1)).alias("j"), "v", "ids", "code")
    right = asked.select("n_dim", here(of(1), 6).alias("j"), F.explode(F.sequence(F.lit(0), of(0) - 1)).alias("i"), "k1", "k2", "v")
    schema = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])
    told = coded.sparkSession.sparkContext.broadcast(models)

    def cell(rows: pa.Table, queries: pa.Table) -> pa.Table:
        keys, ids, scores = [], [], []
        if rows.num_rows and queries.num_rows:
            d = rows.column("n_dim")[0].as_py()
            x, q, own = _vectors(rows.column("v")), _vectors(queries.column("v")), rows.column("ids").to_pylist()
            index = Index(np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(x), -1))
            for n, code in enumerate(told.value[d].asked(q)):
                at = index.within(code, radius[d])
                if len(at):
                    i, s = _best((x[at] * q[n]).sum(axis=1), [own[a] for a in at.tolist()], k)
                    keys.append(n)
                    ids.append(i)
                    scores.append(s)
        return pa.table([queries.column("k1").take(keys) if keys else pa.array([], pa.int64()), queries.column("k2").take(keys) if keys else pa.array([], pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], names=schema.names)

    at = ["n_dim", "i", "j"]
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(cell, schema)
    found = found.select("k1", "k2", F.explode(F.arrays_zip("scores", "ids")).alias("x")).select("k1", "k2", F.col("x.scores").alias("score"), F.col("x.ids").alias("vec_id"))
    return found.withColumn("_r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k).drop("_r")


def nearest(vectors: DataFrame, queries, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` of which the condition ``queries`` (over vec_id) holds, the ``k`` other rows found with the largest inner products, ties to the smaller id.

    Codes of ``BITS`` bits are learnt from ``SAMPLE`` vectors at most (``SAMPLE_MB`` MB); every row is indexed. The Hamming radius is measured for each table: it covers ``COVERED`` of the true
    neighbours of ``MEASURED`` queries, so recall holds at any size and any spread. Within the radius pigeonhole probes find every code, and scores are inner products of the
    vectors as they are, in double precision. Queries that find too few rows are asked again with the whole code as radius, so each has ``k`` rows, or all there are.

    Equal vectors are one class, of which its k + 1 smallest ids can be among the nearest of anything; a query that many rows share is searched once. Null ids, and vectors that are null,
    zero or hold null or non-finite components, take no part. Vectors of different lengths don't meet. Rows with one id and one vector count once; a query never finds a row of its own id.
    """
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(usable("v") & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(9), F.size("v"), "v").alias("k2"), "v").dropDuplicates(["k1", "k2", "vec_id"])
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    classes = stored(first.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("n_dim", F.size("v")), "classes")
    ask = stored(vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(usable("v") & queries).select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(9), F.size("v"), "v").alias("k2")).distinct(), "asked")
    asked = classes.join(ask.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "n_dim", "v")
    asked = stored(asked, "queries")
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x))
    sizes = {r.n_dim: r for r in classes.groupBy("n_dim").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("rows"), F.max(norm).alias("longest")).collect()}  # a row for each length of vectors
    many = {r.n_dim: r["n"] for r in asked.groupBy("n_dim").agg(F.count("*").alias("n")).collect()}
    sizes = {d: r for d, r in sizes.items() if d in many}
    models, measured, grid = {}, {}, {}
    for d, r in sizes.items():
        most = max(1, min(SAMPLE, SAMPLE_MB * 1_000_000 // (8 * d)))
        take = lambda df, n, d=d: _vectors(df.where(F.col("n_dim") == d).orderBy("k1", "k2").limit(n).select("v").toArrow().column(0))
        models[d] = Code(take(classes, most), min(r.longest, np.finfo(float).max))
        measured[d] = take(asked, max(1, min(MEASURED, most)))
        grid[d] = max(SIDE, -(-r["n"] * max(1, d // 512) // ROWS)), max(SIDE, -(-many[d] * max(1, d // 512) // ASKED))
    told = classes.sparkSession.sparkContext.broadcast(models)

    def encode(batches):
        for b in batches:
            dim = np.asarray(b.column(4))
            code = np.empty((b.num_rows, BITS // 8), np.uint8)
            for d in np.unique(dim).tolist():
                code[dim == d] = told.value[d].rows(_vectors(b.column(2).filter(pa.array(dim == d))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in code], pa.binary())], names=[*b.schema.names, "code"])

    used = classes.where(F.col("n_dim").isin(list(sizes)))
    coded = stored(used.mapInArrow(encode, T.StructType([*classes.schema.fields, T.StructField("code", T.BinaryType())])), "codes")
    found = stored(_searched(coded, asked, grid, _measure(used, models, measured, k), models, k + 1), "found")
    needed = F.lit(0)
    for d, r in sizes.items():
        needed = F.when(F.col("n_dim") == d, min(k + 1, r["rows"])).otherwise(needed)
    short = asked.join(found.groupBy("k1", "k2").agg(F.count("*").alias("n")), ["k1", "k2"], "left").where(F.coalesce("n", F.lit(0)) < needed).drop("n")
    short = stored(short, "short")
    again = _searched(coded, short, grid, dict.fromkeys(sizes, BITS), models, k + 1)
    whole = found.join(short, ["k1", "k2"], "left_anti").unionByName(again)
    listed = whole.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("near"))
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = ask.join(listed, ["k1", "k2"]).select("query_id", F.posexplode(near).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))


def op12_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
