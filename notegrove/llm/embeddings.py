"""Near-duplicate vectors by spherical filters: random product codes, each vector's nearest directions, a join on directions, exact verification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import stored, table
from .components import connected_components

#: Rows of one tile side; a filter with more members is compared tile by tile.
TILE = 1536


#: Directions that a vector goes to, vectors a direction holds on average, and the least share of pairs at the threshold that ``parameters`` accepts.
DIRECTIONS, MEMBERS, RECALL = 32, 50, 0.995
#: So few vectors are all compared, without directions.
ALL_PAIRS = 48


class Code:
    """Filter directions of a random product code for vectors of ``dim`` components.

    A fixed random rotation deals the dimensions into two blocks, each with ``size`` random unit codewords; a direction is a pair of codewords, one of each block, so
    size**2 directions need 2 * size products a vector. A vector goes to its ``most`` nearest directions: a number, not a least product, so that
    no vector is left with fewer because its blocks are of unequal length or because the table is large.
    """

    def __init__(self, dim: int, size: int, most: int, seed: int = 20):
        rng = np.random.default_rng([seed, dim, size])
        self.turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0] if dim > 1 else np.ones((1, 1))
        half = [np.arange(dim)[: (dim + 1) // 2], np.arange(dim)[(dim + 1) // 2 :]]
        self.blocks = [b if len(b) else half[0] for b in half]
        words = [rng.normal(size=(size, len(b))) for b in self.blocks]
        self.words = [w / np.linalg.norm(w, axis=1, keepdims=True) / math.sqrt(2) for w in words]
        self.size, self.most = size, min(most, size * size)
        # of places in the falling orders of both blocks, those that can be among the nearest
        side = np.arange(min(self.most, size))
        first, second = np.repeat(side, len(side)), np.tile(side, len(side))
        can = (first + 1) * (second + 1) <= self.most
        self.first, self.second = first[can], second[can]

    def _falling(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and products of each row's nearest codewords."""
        k = min(self.most, self.size)
        at = np.argpartition(-y, k - 1, axis=1)[:, :k] if 4 * k < self.size else np.tile(np.arange(self.size), (len(y), 1))
        near = np.take_along_axis(y, at, axis=1)
        order = np.argsort(-near, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(at, order, axis=1), np.take_along_axis(near, order, axis=1)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the numbers of its nearest directions, in order of number."""
        y = x @ self.turn
        (i, a), (j, b) = (self._falling(y[:, block] @ w.T) for block, w in zip(self.blocks, self.words))
        order = np.argsort(-(a[:, self.first] + b[:, self.second]), axis=1, kind="stable")[:, : self.most]
        found = np.take_along_axis(i[:, self.first] * self.size + j[:, self.second], order, axis=1)
        return list(np.sort(found, axis=1).astype(np.int64))


def recall(dim: int, size: int, most: int, threshold: float, pairs: int = 1000) -> float:
    """The share of random pairs at cosine ``threshold`` that have a direction in common."""
    rng = np.random.default_rng([21, dim])
    x, away = rng.normal(size=(2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    y = x if dim < 2 else threshold * x + math.sqrt(max(0.0, 1 - threshold * threshold)) * away / np.linalg.norm(away, axis=1, keepdims=True)
    code = Code(dim, size, most)
    return sum(len(np.intersect1d(a, b, assume_unique=True)) > 0 for a, b in zip(code.decode(x), code.decode(y))) / pairs


def parameters(n: int, dim: int, threshold: float = 0.95) -> tuple[int, int]:
    """Codewords of a block, and directions of a vector, for ``n`` vectors: about ``MEMBERS`` vectors a direction, if ``RECALL`` holds for pairs at ``threshold``.

    Recall is measured on random pairs at just ``threshold``. Where it falls short (in few dimensions, or at low thresholds), blocks have fewer codewords; one is all pairs.
    """
    if n <= ALL_PAIRS or dim < 1:
        return 1, 1
    size = math.ceil(math.sqrt(DIRECTIONS * n / MEMBERS))
    while size * size > DIRECTIONS:
        if recall(dim, size, DIRECTIONS, threshold) >= RECALL:
            return size, DIRECTIONS
        size = size * 2 // 3
    return 1, 1


def usable(column: str):
    """Vectors that can link: not null, with components that are all present and finite, not all zero."""
    c = F.col(column)
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def links(classes: DataFrame, threshold: float) -> DataFrame:
    """(node, n, hub) from ``classes`` (node, v: array of double, n_dim, n_vectors): for each node the number of vectors in other
    classes at cosine ``threshold`` or more, in parts to be summed, and edges (hub) that connect what is linked.

    A pair counts in the first direction that both have, so it counts once; no pair is a row. A direction with many members is compared in tiles
    of ``TILE`` rows a side, each a task's work of its own, and only counts and edges of a spanning forest leave a tile.
    """
    dims = {r.n_dim: r.n for r in classes.groupBy("n_dim").agg(F.count("*").alias("n")).collect()}  # one row for each length of vectors
    chosen = {d: parameters(n, d, threshold) for d, n in dims.items()}
    listed = T.StructType([T.StructField("node", T.LongType()), T.StructField("n_vectors", T.LongType()), T.StructField("n_dim", T.IntegerType()), T.StructField("v", T.BinaryType()), T.StructField("all", T.BinaryType()), T.StructField("filters", T.ArrayType(T.LongType()))])

    def decode(batches):
        codes = {d: Code(d, *p) for d, p in chosen.items()}
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                dim = np.asarray(part.column(2))
                vectors = [np.asarray(x, float) for x in part.column(3).to_pylist()]
                filters: list = [None] * len(vectors)
                for d in np.unique(dim):
                    at = np.flatnonzero(dim == d)
                    x = _unit(np.stack([vectors[i] for i in at]))
                    for i, f in zip(at, codes[int(d)].decode(x)):
                        filters[i] = f
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([v.astype("<f8").tobytes() for v in vectors], pa.binary()), pa.array([f.astype("<i8").tobytes() for f in filters], pa.binary()), pa.array(filters, pa.list_(pa.int64()))], names=listed.names)

    rows = classes.select("node", "n_vectors", "n_dim", "v").mapInArrow(decode, listed)
    rows = stored(rows, "filters")
    members = rows.select("node", "n_dim", F.explode("filters").alias("f"))
    counts = members.groupBy("n_dim", "f").agg(F.count("*").alias("members")).where("members > 1").withColumn("tiles", F.ceil(F.col("members") / TILE).cast("int"))
    dealt = members.join(counts, ["n_dim", "f"]).withColumn("t", F.pmod(F.xxhash64("node", F.lit(9)), F.col("tiles")).cast("int"))
    # tile (i, j), i <= j, gets the rows of i and of j
    dealt = dealt.select("node", "n_dim", "f", "t", F.explode(F.expr("transform(sequence(0, tiles - 1), o -> named_struct('i', least(t, o), 'j', greatest(t, o)))")).alias("tile"))
    dealt = dealt.select("node", "n_dim", "f", "t", "tile.i", "tile.j").join(rows.select("node", "n_vectors", "v", "all"), "node")
    # small directions share a call, so that calls stay few
    size = max(1, sum(dims.values()) // 400)
    dealt = dealt.withColumn("_cell", F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod(F.xxhash64("n_dim", "f"), F.lit(size))).otherwise(F.xxhash64("n_dim", "f", "i", "j")))
    out = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("hub", T.LongType())])

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("n_dim", "f", "i", "j", "node")])
        dim, f, i, j = (np.asarray(t.column(c)) for c in ("n_dim", "f", "i", "j"))
        cut = np.flatnonzero((np.diff(dim) != 0) | (np.diff(f) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        nodes, numbers, hubs = [], [], []
        node, many, side = np.asarray(t.column("node")), np.asarray(t.column("n_vectors")), np.asarray(t.column("t"))
        v, every = t.column("v").to_pylist(), t.column("all").to_pylist()
        for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [t.num_rows]))):
            if b - a < 2:
                continue
            x = _unit(np.stack([np.frombuffer(y, "<f8") for y in v[a:b]]))
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if i[a] != j[a]:
                near &= side[a:b, None] != side[None, a:b]
            if not near.any():
                continue
            # pairs that have an earlier direction in common were counted there
            early = [np.frombuffer(y, "<i8") for y in every[a:b]]
            early = [e[e < f[a]] for e in early]
            ids, place = np.unique(np.concatenate(early), return_inverse=True)
            who = np.repeat(np.arange(b - a), [len(e) for e in early])
            often = np.bincount(place, minlength=len(ids)) > 1
            name = np.cumsum(often) - 1
            shared = np.zeros((b - a, int(often.sum())), np.float32)
            shared[who[often[place]], name[place[often[place]]]] = 1
            here = near & ((shared @ shared.T) == 0) if shared.shape[1] else near
            total = here @ many[a:b]
            linked = np.flatnonzero(near.any(axis=1))
            hub = _hubs(near)
            nodes.append(node[a:b][linked])
            numbers.append(total[linked])
            hubs.append(node[a:b][hub[linked]])
        cat = lambda p: np.concatenate(p) if p else np.empty(0, np.int64)
        return pa.table([pa.array(cat(nodes)), pa.array(cat(numbers).astype(np.int64)), pa.array(cat(hubs))], names=["node", "n", "hub"])

    return dealt.groupBy("_cell").applyInArrow(compare, out)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hubs(near: np.ndarray) -> np.ndarray:
    """The first row of each row's component."""
    n = len(near)
    hub = np.full(n, -1)
    for k in range(n):
        if hub[k] >= 0:
            continue
        new = np.zeros(n, bool)
        new[k] = True
        while new.any():
            hub[new] = k
            new = near[new].any(axis=0) & (hub < 0)
    return hub


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``, linked at cosine ``threshold`` or more in double precision.

    Equal vectors are one class from the start: they link with each other and are compared once with the rest. ``n_links`` counts other rows linked directly,
    ``component_id`` is the smallest id that links reach (nulls are never smallest), ``kept`` says whether it is the row's own. Vectors that are null, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths. Recall is that of the filters; every link given is verified.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("node", F.when(usable("v"), F.xxhash64("v")))
    classes = rows.where("node is not null").groupBy("node").agg(F.first("v").alias("v"), F.count("*").alias("n_vectors"), F.min("vec_id").alias("least"))
    classes = classes.withColumn("n_dim", F.size("v")).select("node", "n_vectors", "n_dim", "v", "least")
    found = stored(links(classes, threshold), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "g")
    known = classes.drop("v", "n_dim").join(counts, "node", "left").join(groups, "node", "left").withColumn("g", F.coalesce("g", "node"))
    least = known.groupBy("g").agg(F.min("least").alias("component_id"))
    known = known.join(least, "g").select("node", (F.coalesce("n", F.lit(0)) + F.col("n_vectors") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(known, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
