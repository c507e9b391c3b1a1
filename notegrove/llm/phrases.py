"""Collocations: phrases whose words go together, from weighted n-grams of distinct pieces counted out-of-core."""

from __future__ import annotations

import math
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WordHashes, mixed, stored, table, window_hashes

#: Words of the longest phrase, and bits of the map that says which cells are heavy (2**27 bits are 16 MB, whatever the input).
WORDS, MAP_BITS = 4, 27
#: Entries of a task's part of the cells before it is sent, and about so many entries of a range when all parts meet.
FLUSH, RANGE = 3_000_000, 4_000_000
#: N-grams that a task sums before it sends them.
SENT = 1_200_000
BASE = 0x9FB21C651E98DF25

_hashes = WordHashes(13)


def _slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of ``batches`` with about ``most`` bytes of text, of one row at least."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, end - at)
            at = end


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, m): each distinct piece of a language with the number of its occurrences.

    Texts are lower-cased (A-Z only) and split at ``. , ; : ! ?`` and the line breaks \\x0A-\\x0D; a piece is its words, runs of neither space nor tab, joined by one
    space. Pieces without words and null texts have no row; a null language is ``und``. Each task counts its own copies before any is sent. Pieces of one language lie together.
    """
    schema = "lang string, piece string, m long"

    def split(batches):
        for b in _slices(batches, 1, 16_000_000):
            parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(b.column(1), "")), r"[.,;:!?\n-\r]")
            piece = pc.ascii_trim(pc.replace_substring_regex(pc.list_flatten(parts), "[ \t]+", " "), " ")
            t = pa.table([pc.fill_null(b.column(0), "und").take(pc.list_parent_indices(parts)), piece], names=["lang", "piece"])
            t = t.filter(pc.not_equal(t.column("piece"), "")).group_by(["lang", "piece"]).aggregate([([], "count_all")])
            for out in t.select(["lang", "piece", "count_all"]).rename_columns(["lang", "piece", "m"]).to_batches(max_chunksize=100_000):
                yield out

    found = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(split, schema)
    return found.groupBy("lang", "piece").agg(F.sum("m").alias("m")).sortWithinPartitions("lang")


class _Run:
    """The words of pieces of one language as one run, with the weight and the hash of each."""

    def __init__(self, lang: str, pieces: list[bytes], weights: np.ndarray):
        self.lang, self.seed = lang, np.uint64(xxhash.xxh64_intdigest(lang.encode(), 7))
        self.words = b" ".join(pieces).split(b" ")
        sizes = np.fromiter((p.count(b" ") + 1 for p in pieces), np.int64, len(pieces))
        self.h = _hashes.of(self.words)
        self.weight = np.repeat(weights, sizes)
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.words))  # words from here to the end of the piece

    def cells(self, n: int, bits: int) -> np.ndarray:
        """The cell of the n-gram that starts at each word where n words are left."""
        h = window_hashes(self.h, n, BASE)[self.left[: max(0, len(self.h) - n + 1)] >= n]
        return mixed(h ^ self.seed ^ np.uint64(n * 0x9E3779B9)) >> np.uint64(64 - bits)

    def starts(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.left >= n)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[_Run]:
    """Pieces (lang, piece, m) as runs of about ``most`` bytes."""
    for b in _slices(batches, 1, most):
        langs = b.column(0)
        for lang in pc.unique(langs).to_pylist():
            part = b.filter(pc.equal(langs, lang))
            yield _Run(lang, part.column(1).cast(pa.binary()).to_pylist(), np.asarray(part.column(2), np.int64))


def _packed(values: np.ndarray, weights: np.ndarray) -> bytes:
    """Sorted values and small weights in few bytes."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = steps.view(np.uint8).reshape(-1, 8).T
    used = max([k + 1 for k in range(8) if planes[k].any()], default=1)
    return zlib.compress(bytes([used]) + len(values).to_bytes(8, "little") + planes[:used].tobytes() + weights.astype(np.uint8).tobytes(), 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    used, n = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.zeros((8, n), np.uint8)
    planes[:used] = np.frombuffer(raw, np.uint8, used * n, 9).reshape(used, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64), np.frombuffer(raw, np.uint8, n, 9 + used * n)


def _summed(cells: np.ndarray, weights: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells (of 56 bits at most) in order, with their weights (255 at most) summed up to ``most``."""
    both = np.sort(cells << np.uint64(8) | weights.astype(np.uint64))
    cells, weights = both >> np.uint64(8), (both & np.uint64(255)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.empty(0, np.int64)
    return cells[first], np.minimum(np.add.reduceat(weights, first), most) if len(first) else weights


def _numbered(keys: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each key, which stands at a place of ``at`` (under ``size``), the number of its value in order; and where each value stands first."""
    bits = max(1, size - 1).bit_length()
    if int(keys.max()) >> (63 - bits):
        _, first, number = np.unique(keys, return_index=True, return_inverse=True)
        return number, at[first]
    both = np.sort(keys << bits | at)  # one sort of plain numbers
    new = np.concatenate(([True], (both[1:] >> bits) != (both[:-1] >> bits)))
    place = both & ((1 << bits) - 1)
    number = np.empty(size, np.int64)
    number[place] = np.cumsum(new) - 1
    return number[at], place[new]


class _Numbers(dict):
    """word -> the number of its first call."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def heavy_map(held: DataFrame, tokens: int, least: int) -> tuple[bytes, int, int]:
    """A map of ``2**MAP_BITS`` bits, the bits of a cell, and how many of these name its range: set where a cell of n-grams may hold one that occurs ``least`` times or more, and clear where none can.

    Each task sums the weights of its n-grams by cell, a hash of more bits the more words there are, and sends them packed by ranges of cells; where all
    parts of a range meet, cells of ``least`` or more set the bit of their first ``MAP_BITS`` bits. Only the map, whose size is fixed, goes to the driver. On inputs so large that
    most bits are set the map prunes little, and counting does the whole work.
    """
    bits = min(48, max(MAP_BITS + 1, math.ceil(math.log2(tokens + 1)) + 8))
    ranges = min(18, max(6, math.ceil(math.log2(WORDS * tokens / RANGE + 1))))
    most = min(least, 255)
    sent = T.StructType([T.StructField("part", T.LongType()), T.StructField("blob", T.BinaryType())])

    def cells(batches):
        held_cells, held_weights, size = [], [], 0

        def flush():
            c, w = _summed(np.concatenate(held_cells), np.concatenate(held_weights), most)
            part = c >> np.uint64(bits - ranges)
            cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(c)])).astype(np.int64)
            low = c & np.uint64((1 << (bits - ranges)) - 1)
            return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int64)), pa.array([_packed(low[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=sent.names)

        for run in _runs(batches, 3_000_000):
            for n in range(1, WORDS + 1):
                held_cells.append(run.cells(n, bits))
                held_weights.append(np.minimum(run.weight[run.starts(n)], most))
                size += len(held_cells[-1])
            if size >= FLUSH:
                yield flush()
                held_cells, held_weights, size = [], [], 0
        if size:
            yield flush()

    out = T.StructType([T.StructField("part", T.LongType()), T.StructField("bits", T.BinaryType())])

    def meet(t: pa.Table) -> pa.Table:
        parts = [_unpacked(b) for b in t.column("blob").to_pylist()]
        c, w = _summed(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]), least)
        marks = np.zeros(1 << (MAP_BITS - ranges), bool)
        marks[(c[w >= most] >> np.uint64(bits - MAP_BITS)).astype(np.int64)] = True
        return pa.table([pa.array([t.column("part")[0].as_py()], pa.int64()), pa.array([zlib.compress(np.packbits(marks).tobytes(), 1)], pa.binary())], names=out.names)

    size = (1 << (MAP_BITS - ranges)) // 8
    whole = bytearray(1 << (MAP_BITS - 3))
    for r in held.mapInArrow(cells, sent).groupBy("part").applyInArrow(meet, out).collect():  # 16 MB at most
        whole[r.part * size : (r.part + 1) * size] = zlib.decompress(r.bits)
    return bytes(whole), bits, ranges


def counted(held: DataFrame, tokens: int, least: int) -> DataFrame:
    """(lang, gram, n, f): the n-grams (n words joined by a space) of ``pieces`` that occur ``least`` times or more, with their occurrences f.

    N-grams that may be so frequent (``heavy_map``), and whose parts may be, are dealt by the ranges of their hashes; each bucket is counted by DuckDB on disk,
    in bounded memory, so a bucket may be larger than its task. The map only spares work: counts are of the words themselves.
    """
    found, bits, ranges = heavy_map(held, tokens, least)
    told = held.sparkSession.sparkContext.broadcast(found)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("f", T.LongType())])
    arrow = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int32()), ("f", pa.int64())])
    dealt = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("gram", T.ArrayType(T.StringType())), T.StructField("f", T.ArrayType(T.LongType()))])

    def grams(batches):
        marks = np.frombuffer(told.value, np.uint8)
        kept: list[pa.Table] = []

        def heavy(cells: np.ndarray) -> np.ndarray:
            at = cells >> np.uint64(bits - MAP_BITS)
            return (marks[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1

        def summed() -> pa.RecordBatch:
            """What is kept, each n-gram once, as a row for each language, length and bucket."""
            t = pa.concat_tables(kept).group_by(["bucket", "lang", "n", "gram"]).aggregate([("f", "sum")]).sort_by([("bucket", "ascending"), ("lang", "ascending"), ("n", "ascending")]).combine_chunks()
            bucket, lang, n = np.asarray(t.column("bucket")), pc.rank(t.column("lang"), tiebreaker="dense").to_numpy(), np.asarray(t.column("n"))
            first = np.flatnonzero(np.concatenate(([True], (np.diff(bucket) != 0) | (np.diff(lang.astype(np.int64)) != 0) | (np.diff(n) != 0))))
            ends = pa.array(np.append(first, t.num_rows).astype(np.int32))
            listed = lambda c: pa.ListArray.from_arrays(ends, t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c))
            one = t.take(first)
            return pa.RecordBatch.from_arrays([one.column("bucket").combine_chunks(), one.column("lang").combine_chunks(), one.column("n").combine_chunks(), listed("gram"), listed("f_sum")], names=dealt.names)

        for run in _runs(batches, 6_000_000):
            # code: the number of the (n-1)-gram that starts at a word, -1 where none does that may be frequent
            code = np.fromiter(map(_Numbers().__getitem__, run.words), np.int64, len(run.words))
            for n in range(1, WORDS + 1):
                at, cells = run.starts(n), run.cells(n, bits)
                some = heavy(cells)
                if n > 1:
                    some &= (code[at] >= 0) & (code[at + 1] >= 0)
                if not some.any():
                    break
                at, cells = at[some], cells[some]
                key = code[at] if n == 1 else code[at] * (int(code.max()) + 1) + code[at + 1]
                number, first = _numbered(key, at, len(code))
                total = np.bincount(number, run.weight[at]).astype(np.int64)  # doubles, exact up to 2**53
                text = [b" ".join(run.words[i : i + n]).decode("utf-8", "replace") for i in first.tolist()]
                bucket = (cells[np.searchsorted(at, first)] >> np.uint64(bits - ranges)).astype(np.int64)
                kept.append(pa.table([pa.array(bucket), pa.array([run.lang] * len(text), pa.string()), pa.array(text, pa.string()), pa.array([n] * len(text), pa.int32()), pa.array(total)], names=["bucket", "lang", "gram", "n", "f"]))
                code = np.full(len(run.words), -1, np.int64)
                code[at] = number
            if sum(t.num_rows for t in kept) >= SENT:
                yield summed()
                kept.clear()
        if kept:
            yield summed()

    def count(batches):
        import duckdb

        with tempfile.TemporaryDirectory() as at, duckdb.connect(f"{at}/grams.db", config={"memory_limit": "300MB", "threads": 1, "temp_directory": f"{at}/spill", "preserve_insertion_order": False}) as db:
            db.execute("CREATE TABLE grams (lang VARCHAR, gram VARCHAR, n INTEGER, f BIGINT)")
            for b in batches:
                for k in range(0, b.num_rows, 1000):
                    db.register("arrived", pa.Table.from_batches([b.slice(k, 1000)]))
                    db.execute("INSERT INTO grams SELECT lang, unnest(gram), n, unnest(f) FROM arrived")
                    db.unregister("arrived")
            for b in db.sql(f"SELECT lang, gram, n, CAST(sum(f) AS BIGINT) AS f FROM grams GROUP BY lang, gram, n HAVING sum(f) >= {least}").to_arrow_reader(50_000):
                yield b.cast(arrow)

    return held.mapInArrow(grams, dealt).repartition("bucket").mapInArrow(count, schema)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the ``top`` phrases of 2 to 4 words whose words go together most.

    n counts all words of a language, and f(x) all occurrences of the words x in a row within pieces, overlaps included. A phrase with a = f(phrase) >= ``least`` is a candidate.
    Cut after k words it has l = f(first part), r = f(rest) and floor(2000000 a / (l + r)); its score is that of its lowest cut, ties to the smallest k. Candidates that
    lie in a longer candidate with 100 f(longer) >= 80 a are dropped. Order: score, a (both falling), phrase (bytes). Sums and products are exact.
    Null texts have no words; a null language is ``und``; no rows give no rows; other columns don't matter. Counts of a phrase's parts
    are requested by a shuffled join, and a part asked for very often is split by adaptive execution.
    """
    held = stored(pieces(docs, text_col, lang_col), "pieces").withColumn("w", F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1)
    totals = held.groupBy("lang").agg(F.sum(F.col("m") * F.col("w")).cast("long").alias("n"))
    tokens = held.agg(F.sum("w")).first()[0] or 0
    f = stored(counted(held.drop("w"), tokens, least), "grams")
    words = F.split("gram", " ")
    part = lambda a, size: F.array_join(F.slice(words, a, size), " ")
    cuts = lambda n: [F.struct(F.lit(k).alias("k"), F.lit(s).alias("side"), (part(1, k) if s == "l" else part(k + 1, n - k)).alias("part")) for k in range(1, n) for s in "lr"]
    kinds = range(2, WORDS + 1)
    asked = F.coalesce(*[F.when(F.col("n") == n, F.array(*cuts(n))) for n in kinds])
    requests = f.where("n > 1").select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), F.explode(asked).alias("x")).select("lang", "phrase", "a", "x.*")
    known = requests.join(f.select("lang", F.col("gram").alias("part"), F.col("f").alias("p")), ["lang", "part"])
    sides = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("p"))).alias(f"{s}{k}") for k in range(1, WORDS) for s in "lr"]
    cand = known.groupBy("lang", "phrase", "a").agg(*sides)
    score = lambda k: F.expr(f"(cast(a as decimal(20, 0)) * 2000000) div (cast(l{k} as decimal(20, 0)) + r{k})")
    lowest = F.array_min(F.filter(F.array(*[F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, WORDS)]), lambda x: x["score"].isNotNull()))
    cand = cand.select("lang", "phrase", "a", lowest.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", F.col("c.score").cast("long").alias("score"))
    inner = F.coalesce(*[F.when(F.col("n") == n, F.array(*[part(a, size) for size in range(2, n) for a in range(1, n - size + 2)])) for n in kinds if n > 2])
    longer = f.where("n > 2").select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = cand.join(longer, ["lang", "phrase"], "left").where("longest is null or cast(longest as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * 80")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part_of = kept.withColumn("_p", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    best = part_of.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_p").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
