"""SimHash near-duplicates found with covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import added, beside, stored, table, text_of, without
from .components import connected_components

BITS = 64


def masks(radius: int) -> list[int]:
    """Bit masks of a covering family for 64 bits: two values within ``radius`` agree under one of them.

    Bit i gets the vector v(i) = 1 + i mod (2**(radius+1) - 1) over GF(2); the mask of a nonzero a keeps
    the bits with <a, v(i)> = 1. At most ``radius`` bits differ, so their vectors do not span the space, and some
    a is orthogonal to all of them: that mask keeps none of the differing bits.
    """
    last = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if (a & (1 + i % last)).bit_count() % 2) for a in range(1, last + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text (see ``fingerprints``)."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n - shingle + 1)
    # each byte lane of a word sums one bit of up to 255 values at a time
    lanes, step = np.uint64(0x0101010101010101), 255
    marks = np.arange(0, len(h), step)
    counts = np.empty(BITS, np.int64)
    for k in range(8):
        part = np.add.reduceat((h >> np.uint64(k)) & lanes, marks)
        counts[k::8] = part.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(h)).tolist())


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with a column ``fp`` (long): the 64 bits of its SimHash, as a signed number.

    A-Z are lower-cased, words are runs without the six ASCII white-space characters, shingles are ``shingle`` words
    with repeats, space-joined; fewer words form one shingle. A bit is 1 if it is set in more than half of the XXH64
    values. Null, empty and blank texts get 0. A column ``fp`` of the input is replaced.
    """
    docs = without(docs, ["fp"])
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            fp = [_signed(fingerprint(t, shingle, seed)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp, pa.int64())], names=[*b.schema.names, "fp"])

    return docs.mapInArrow(run, added(docs.schema, ("fp", T.LongType())))


def linked(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``prints.fp`` that differ in 1 to ``radius`` = 2 bits.

    Candidates are prints that share a masked value with another one in a table of the covering family. Each
    then names its centres: itself and itself with one unmasked bit turned. Two prints have a centre in common if
    and only if they differ in at most two bits, so each print is joined to the least print of each of its centres:
    no pair is listed, and the work is linear in the candidates however many share a table's slot.
    """
    if radius != 2:
        raise ValueError("centres of one turned bit verify a radius of 2")
    fps = prints.select("fp").distinct()
    family = [(k, _signed(m)) for k, m in enumerate(masks(radius))]
    slots = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("slot")) for k, m in family])).alias("s")).select("fp", "s.*")
    # per slot only its least and greatest print are kept: they differ exactly if the slot has two prints
    shared = slots.groupBy("k", "slot").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x < y").select("k", "slot")
    held = slots.join(shared, ["k", "slot"], "left_semi")
    turns = F.expr("CASE k " + " ".join(f"WHEN {k} THEN array(0L, {', '.join(f'{_signed(1 << i)}L' if i < 63 else 'shiftleft(1L, 63)' for i in range(BITS) if not (m >> i) & 1)})" for k, m in enumerate(masks(radius))) + " END")
    centres = held.select("fp", F.explode(turns).alias("t")).select("fp", F.col("fp").bitwiseXOR(F.col("t")).alias("c")).distinct()
    hubs = centres.groupBy("c").agg(F.min("fp").alias("m"), F.max("fp").alias("y")).where("m < y").select("c", "m")
    return centres.join(hubs, "c").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``: near-duplicate classes by SimHash within 2 bits.

    ``component_id`` is the smallest id that links reach, the row's own included; ids that are null never are the
    smallest (a class of nulls only has a null ``component_id``). Rows with equal ids are rows of their own.
    Equal texts, ties and repeated rows share a fingerprint and so a class; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text").select("doc_id", "fp"), "simhash")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = connected_components(linked(rows)).select(F.col("node").alias("fp"), F.col("component").alias("g"))
    known = classes.join(groups, "fp", "left").select("fp", "least", F.coalesce("g", "fp").alias("g"))
    smallest = known.groupBy("g").agg(F.min("least").alias("component_id"))
    return rows.join(known.select("fp", "g").join(smallest, "g").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Sketches of ``near_copies``: bands of some minima each. A pair of similarity 0.8 shares a band but for 7 in 100,000 cases.
BANDS, ROWS = 24, 5


def _shingles(text: bytes, words: int) -> np.ndarray:
    """Distinct XXH64 values of runs of ``words`` lower-cased words; fewer words make one run, none make none."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    n, line = len(w), b" ".join(w)
    if n <= words:
        return np.asarray([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())), np.uint64, n - words + 1))


def _key(text_col: str = "text"):
    return F.xxhash64(text_of(text_col), F.lit(1))


#: Rows of one side of a tile of ``_rest``.
TILE = 256


def _slices(batches, rows: int = 500):
    """A few rows at a time, so that few texts are Python objects at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between keys (64-bit hashes) of different texts of ``docs`` whose components are those of all pairs with sets of ``words``-word runs of Jaccard similarity
    ``similarity`` or more that share a band.

    Texts so alike lie 5 to 11 bits apart in 64-bit SimHashes (7 in the median), which is beyond what covering masks can
    reach with keys long enough to tell texts apart. So candidates come from bands of minima here, and the runs themselves decide. First each text is
    compared with the least key of each of its bands: that settles bands of copies. Bands whose texts then aren't all in one component have the rest of their pairs
    compared (``_rest``), so that no link hides behind a least key that is unlike both of its ends.
    """
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    rng = np.random.default_rng(77)
    factors = (rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    mix = rng.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
    # 4 standard deviations of the estimate below the bound, so what the runs decide is not decided by sketches
    enough = BANDS * ROWS * (similarity - 4 * (similarity * (1 - similarity) / (BANDS * ROWS)) ** 0.5)

    def sketch(batches):
        for b in _slices(batches):
            keys, bands, sketches = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                h = _shingles(text or b"", words)
                if not len(h):
                    continue
                least = np.empty(BANDS * ROWS, np.uint64)
                for k, f in enumerate(factors):
                    least[k] = (h * f).min()
                keys.append(key)
                bands.append((least.reshape(BANDS, ROWS) * mix).sum(axis=1, dtype=np.uint64).astype(np.int64))
                sketches.append((least >> np.uint64(48)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=schema.names)

    texts = docs.select(_key().alias("key"), text_of().alias("text"))
    known = stored(texts.mapInArrow(sketch, schema).dropDuplicates(["key"]), "sketches")
    held = known.select("key", F.posexplode("bands").alias("k", "band"))
    least = held.groupBy("k", "band").agg(F.min("key").alias("b"), F.max("key").alias("y")).where("b < y").select("k", "band", "b")
    shared = stored(held.join(least, ["k", "band"]), "bands")
    pairs = shared.where("key <> b").select(F.col("key").alias("a"), "b").distinct()
    one, two = known.select(F.col("key").alias("a"), F.col("sketch").alias("x")), known.select(F.col("key").alias("b"), F.col("sketch").alias("y"))

    def likely(batches):
        for b in _slices(batches):
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in (2, 3))
            yield b.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= enough))

    likely_pairs = stored(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(likely, "a long, b long"), "pairs")
    # the texts of all that shares a band, which both rounds read; equal texts are one row before anything is joined
    full = stored(texts.dropDuplicates(["key"]).join(shared.select("key").distinct(), "key", "left_semi"), "texts")
    both = likely_pairs.join(full.select(F.col("key").alias("a"), F.col("text").alias("s")), "a").join(full.select(F.col("key").alias("b"), F.col("text").alias("t")), "b").select("a", "b", "s", "t")

    def decide(batches):
        for b in _slices(batches):
            s, t = (b.column(c).cast(pa.binary()).to_pylist() for c in (2, 3))
            yield b.select([0, 1]).filter(pa.array([_alike(_shingles(x, words), _shingles(y, words), similarity) for x, y in zip(s, t)], pa.bool_()))

    links = stored(both.mapInArrow(decide, "a long, b long"), "links")
    return links.unionByName(_rest(full, known, shared, links, words, similarity, enough, tile))


def _tiles(t: pa.Table, enough: float):
    """Of each tile of ``t`` (sorted) the rows x and the rows after it that may be similar, from other components, in the first band that both have."""
    k, band, i, j, g, side = (np.asarray(t.column(c)) for c in ("k", "band", "i", "j", "g", "t"))
    cut = np.flatnonzero((np.diff(k) != 0) | (np.diff(band) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
    every = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u2").reshape(t.num_rows, -1)
    bands = np.asarray(t.column("bands").combine_chunks().flatten()).reshape(t.num_rows, -1)
    for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [t.num_rows]))):
        for x in range(a, b):
            at = np.flatnonzero((g[x + 1 : b] != g[x]) & ((side[x + 1 : b] != side[x]) if i[a] != j[a] else True)) + x + 1
            at = at[(every[at] == every[x]).sum(axis=1) >= enough]
            at = at[np.argmax(bands[at] == bands[x], axis=1) == k[a]] if len(at) else at
            if len(at):
                yield x, at


def _rest(full: DataFrame, known: DataFrame, shared: DataFrame, links: DataFrame, words: int, similarity: float, enough: float, tile: int) -> DataFrame:
    """Edges (a, b) that link further components of ``links`` within the bands of ``shared`` (key, k, band).

    Bands whose texts lie in one component are done. Of others all pairs from different components are looked at, in tiles of ``tile`` rows a side,
    each a task's work of its own: by sketches first, and then, for rows that have a likely partner there, by the sets of runs. No pair is a row; what leaves a tile are
    the edges that joined components in it, fewer than it has texts.
    """
    groups = connected_components(links)
    labelled = shared.join(groups.withColumnRenamed("node", "key"), "key", "left").select("key", "k", "band", F.coalesce("component", "key").alias("g"))
    mixed = labelled.groupBy("k", "band").agg(F.min("g").alias("x"), F.max("g").alias("y"), F.count("*").alias("m")).where("x < y")
    mixed = mixed.select("k", "band", F.ceil(F.col("m") / tile).cast("int").alias("tiles"))
    dealt = labelled.join(mixed, ["k", "band"]).withColumn("t", F.pmod(F.xxhash64("key", F.lit(9)), F.col("tiles")).cast("int"))
    # tile (i, j), i <= j, gets the rows of i and of j
    dealt = dealt.withColumn("tile", F.explode(F.expr("transform(sequence(0, tiles - 1), o -> named_struct('i', least(t, o), 'j', greatest(t, o)))")))
    dealt = stored(dealt.select("key", "k", "band", "g", "t", "tile.i", "tile.j"), "rest")
    n = max(1, dealt.count() // (4 * tile))
    # small bands share a call, so that calls stay few; a tile of a large one has its own
    cell = F.when((F.col("i") == 0) & (F.col("j") == 0), F.pmod(F.xxhash64("k", "band"), F.lit(n))).otherwise(F.xxhash64("k", "band", "i", "j"))
    rows = dealt.withColumn("_cell", cell).join(known, "key")
    order = [(c, "ascending") for c in ("k", "band", "i", "j", "key")]

    def likely(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        keep = np.zeros(t.num_rows, bool)
        for x, at in _tiles(t, enough):
            keep[x] = True
            keep[at] = True
        return t.filter(pa.array(keep))

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        g, key, text = np.asarray(t.column("g")), np.asarray(t.column("key")), t.column("text").cast(pa.binary())
        parent: dict[int, int] = {}
        sets: dict[int, np.ndarray] = {}
        out: list[tuple[int, int]] = []

        def top(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        for x, at in _tiles(t, enough):
            for y in at.tolist():
                u, v = top(int(g[x])), top(int(g[y]))
                if u == v:
                    continue
                for z in (x, y):
                    if int(key[z]) not in sets:
                        sets[int(key[z])] = _shingles(text[z].as_py() or b"", words)
                if _alike(sets[int(key[x])], sets[int(key[y])], similarity):
                    parent[max(u, v)] = min(u, v)
                    out.append((int(key[x]), int(key[y])))
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    found = stored(rows.groupBy("_cell").applyInArrow(likely, rows.schema), "likely")
    return found.join(full, "key").groupBy("_cell").applyInArrow(compare, "a long, b long")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each group of copies: that of the smallest doc_id.

    Groups are what links reach: fingerprints of 2 differing bits or fewer, and five-word similarity of 0.8 or more (``near_copies``).
    Of rows with the same smallest id one stays, the one whose text has the least hash. Groups whose ids are all null keep one row. Columns are those of ``docs``.
    """
    return beside(docs, ["doc_id", "text"], _kept)


def _kept(docs: DataFrame) -> DataFrame:
    rows = fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), text_of().alias("text"))).select("doc_id", "key", "fp")
    # equal texts are one row from here on, so that no key is more than that; nulls are never the smallest
    rows = stored(rows.groupBy("key", "fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id")).alias("least")), "prints")
    heads = rows.groupBy("fp").agg(F.min("key").alias("head"))
    same = rows.join(heads, "fp").select(F.col("key").alias("a"), F.col("head").alias("b"))
    one, two = heads.select(F.col("fp").alias("a"), F.col("head").alias("h")), heads.select(F.col("fp").alias("b"), F.col("head").alias("g"))
    close = linked(rows).join(one, "a").join(two, "b").select(F.col("h").alias("a"), F.col("g").alias("b"))
    groups = connected_components(same.unionByName(close).unionByName(near_copies(docs))).withColumnRenamed("node", "key")
    known = rows.join(groups, "key", "left").withColumn("g", F.coalesce("component", "key"))
    first = known.groupBy("g").agg(F.min(F.struct("least.n", "least.doc_id", "key")).alias("m")).select("m.doc_id", "m.key")
    at = F.struct(F.col("doc_id").cast("long").alias("d"), _key().alias("k"))
    kept = first.select(F.struct(F.col("doc_id").alias("d"), F.col("key").alias("k")).alias("_at"))
    return docs.withColumn("_at", at).join(kept, "_at", "left_semi").dropDuplicates(["_at"]).drop("_at")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


