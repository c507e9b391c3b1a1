"""Exact substring deduplication with fixed-block anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WordHashes, added, beside, mixed, table, text_of, window_hashes, without

#: Odd multipliers of the rolling hashes: of blocks, and two for whole windows.
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Low bits of a block's hash that travel with its bucket; two more say how it occurs.
LOW = 30

_hashes = WordHashes()


class _Chunk:
    """The words of one chunk of documents, in the order of its rows, as one run of hashes."""

    def __init__(self, rows: pa.Table, text_col: str):
        self.rows = rows
        self.texts = [t or b"" for t in rows.column(text_col).cast(pa.binary()).to_pylist()]
        parts = [_hashes.of(t.split()) for t in self.texts]
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.ends = np.cumsum(self.sizes)
        self.h = np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def starts(self, width: int) -> np.ndarray:
        """True where a window of ``width`` words of one document starts."""
        n = max(0, len(self.h) - width + 1)
        if not n:
            return np.zeros(0, bool)
        ok = np.zeros(len(self.h) + 1, np.int32)
        long = self.sizes >= width
        np.add.at(ok, (self.ends - self.sizes)[long], 1)
        np.add.at(ok, (self.ends - width + 1)[long], -1)
        return np.cumsum(ok)[:n] > 0

    def place(self, width: int) -> np.ndarray:
        """Each word's place in its own document, for the first words of windows."""
        n = max(0, len(self.h) - width + 1)
        return (np.arange(len(self.h)) - np.repeat(self.ends - self.sizes, self.sizes))[:n]


def _order(rows: pa.Table, text_col: str) -> pa.Table:
    """Rows by id (nulls last), then text: the order that decides which occurrence is the earlier."""
    return rows.take(pc.sort_indices(rows, sort_keys=[("_null", "ascending"), ("_key", "ascending"), (text_col, "ascending")]))


def _chunks(docs: DataFrame, id_col: str, text_col: str, chunk_mb: float) -> tuple[DataFrame, int]:
    """Rows dealt into chunks of about ``chunk_mb`` MB of text; rows of one id share a chunk."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    n = max(1, round(size / (chunk_mb * 1e6)))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text_of(text_col))).otherwise(F.col(id_col).cast("long"))
    out = docs.withColumns({"_null": F.col(id_col).isNull(), "_key": key})
    return out.withColumn("_chunk", F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(n))), n


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, chunk_mb: float = 6.0) -> DataFrame:
    """``docs`` with n_words (long), n_removed (long) and kept_text (string).

    Words are runs without the six ASCII white-space characters, unchanged. A window is ``window`` words in a row of one document. A word
    goes if a window over it also starts earlier: in a row with a smaller id, or earlier in the row. Ids that are null come
    last, ordered by a hash of their texts; rows with equal ids are ordered by text. ``kept_text`` holds the words that stay, joined by one space; null texts have none. Extra
    columns are kept; those named like an added column (or beginning with the reserved ``_null``, ``_key``, ``_chunk``) are replaced.

    1. Blocks of half a window at fixed places are the anchors: any repeated window holds a whole one, and the
       other occurrence holds the same words at some place. Each chunk sends each of its rolling hashes once to the
       hash's bucket, marked if it is a block there and if it occurs again. Buckets return those that are a block and occur twice.
    2. Around returned hits, windows are matched by 96 bits of their hashes. Each chunk sends each such window once; buckets
       return those of which another chunk has an earlier one.
    3. In each chunk a window repeats if it is returned or occurs earlier in the chunk. Overlapping repeats join to maximal
       ones, and their words go.

    A sequence that a third of all documents share is one entry per chunk, not one per document.
    """
    if window < 4:
        raise ValueError("a window has 4 words at least")
    block = window // 2
    docs = without(docs, ["n_words", "n_removed", "kept_text", "_null", "_key", "_chunk"])
    rows, n_chunks = _chunks(docs, id_col, text_col, chunk_mb)
    # buckets grow with the chunks, a quarter as many, so that what a chunk sends to a bucket stays several hashes; from 6 TB on
    # there are 2**18 of them, each of about 250 MB at 100 TB
    bits = min(18, max(8, int(np.ceil(np.log2(n_chunks + 1))) - 2))
    shift, low = np.uint64(64 - bits), np.uint64(64 - bits - LOW)
    ends = window - block + 1
    sent = T.StructType([T.StructField("_bucket", T.LongType()), T.StructField("_chunk", T.LongType()), T.StructField("blob", T.BinaryType())])
    hit = T.StructType([T.StructField("_chunk", T.LongType()), T.StructField("blob", T.BinaryType())])
    to_bucket = pa.schema([("_bucket", pa.int64()), ("_chunk", pa.int64()), ("blob", pa.binary())])
    to_chunk = pa.schema([("_chunk", pa.int64()), ("blob", pa.binary())])

    def by_bucket(buckets: np.ndarray, number: int, data: np.ndarray) -> pa.Table:
        """One row for each bucket; ``buckets`` is sorted."""
        cut = np.flatnonzero(np.diff(buckets)) + 1
        first = np.concatenate(([0], cut)).astype(np.int64) if len(buckets) else np.empty(0, np.int64)
        last = np.concatenate((cut, [len(buckets)])).astype(np.int64) if len(buckets) else first
        return pa.table([pa.array(buckets[first].astype(np.int64)), pa.array([number] * len(first), pa.int64()), pa.array([data[a:b].tobytes() for a, b in zip(first, last)], pa.binary())], schema=to_bucket)

    def probes(t: pa.Table) -> pa.Table:
        c = _Chunk(t, text_col)
        at = c.starts(block)
        h = window_hashes(c.h, block, BASES[0])
        key, aligned = h[at] >> low, (c.place(block)[at] % block) == 0
        order = np.argsort(key, kind="stable")
        key, aligned = key[order], aligned[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        again = np.diff(np.append(first, len(key))) > 1
        is_block = np.logical_or.reduceat(aligned, first) if len(first) else np.empty(0, bool)
        u = key[first]
        data = ((u & np.uint64((1 << LOW) - 1)) << np.uint64(2) | is_block.astype(np.uint64) << np.uint64(1) | again.astype(np.uint64)).astype(np.uint32)
        return by_bucket(u >> np.uint64(LOW), t.column("_chunk")[0].as_py(), data)

    def hits(t: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.uint32) for x in t.column("blob").to_pylist()]
        everything = np.concatenate(blobs)
        everything = np.sort(everything)
        key = everything >> np.uint32(2)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        many = np.diff(np.append(first, len(key))) > 1
        how = np.bitwise_or.reduceat(everything, first)
        good = key[first][((how & 2) > 0) & (many | ((how & 1) > 0))]
        bucket = np.uint64(t.column("_bucket")[0].as_py()) << np.uint64(LOW)
        out = []
        for number, x in zip(t.column("_chunk").to_pylist(), blobs):
            mine = x >> np.uint32(2)
            mine = mine[np.isin(mine, good, assume_unique=True)]
            if len(mine):
                out.append((number, (mine.astype(np.uint64) | bucket).tobytes()))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], schema=to_chunk)

    def whole(c: _Chunk) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of each window's hash."""
        return window_hashes(c.h, window, BASES[1]), (window_hashes(mixed(c.h), window, BASES[2]) >> np.uint64(32)).astype(np.uint32)

    pair = np.dtype([("a", "<u8"), ("b", "<u4")])
    triple = np.dtype([("a", "<u8"), ("b", "<u4"), ("d", "<u4")])

    def candidates(docs_of: pa.Table, hits_of: pa.Table) -> pa.Table:
        nothing = pa.table([[], [], []], schema=to_bucket)
        if not hits_of.num_rows or not docs_of.num_rows:
            return nothing
        c = _Chunk(_order(docs_of, text_col), text_col)
        at = c.starts(window)
        if not at.any():
            return nothing
        key = window_hashes(c.h, block, BASES[0]) >> low
        mine = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in hits_of.column("blob").to_pylist()]))
        found = np.isin(key, mine)
        near = np.concatenate(([0], np.cumsum(found)))
        n = len(at)
        where = np.flatnonzero(at & (near[ends : ends + n] > near[:n]))
        a, b = whole(c)
        a, b = a[where], b[where]
        order = np.lexsort((where, b, a))
        a, b, where = a[order], b[order], where[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, bool)
        a, b, where = a[new], b[new], where[new]
        # which document: its place among the chunk's rows, whose keys lead the blob
        data = np.empty(len(a), triple)
        data["a"], data["b"], data["d"] = a, b, np.searchsorted(c.ends, where, side="right")
        null, keys = np.asarray(c.rows.column("_null")).astype(np.int64), np.asarray(c.rows.column("_key"))
        parts = by_bucket(a >> shift, docs_of.column("_chunk")[0].as_py(), data)
        blobs = []
        for x in parts.column("blob").to_pylist():
            d = np.frombuffer(x, triple).copy()
            used, d["d"] = np.unique(d["d"], return_inverse=True)
            blobs.append(np.int64(len(used)).tobytes() + null[used].tobytes() + keys[used].tobytes() + d.tobytes())
        return parts.set_column(2, "blob", pa.array(blobs, pa.binary()))

    def later(t: pa.Table) -> pa.Table:
        parts = []
        for k, x in enumerate(t.column("blob").to_pylist()):
            n = int(np.frombuffer(x, np.int64, 1)[0])
            null, key = np.frombuffer(x, np.int64, n, 8), np.frombuffer(x, np.int64, n, 8 + 8 * n)
            d = np.frombuffer(x, triple, -1, 8 + 16 * n)
            parts.append((d["a"], d["b"], null[d["d"]], key[d["d"]], np.full(len(d), k)))
        a, b, null, key, k = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((key, null, b, a))
        a, b, k = a[order], b[order], k[order]
        again = np.concatenate(([False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])))
        numbers, out = t.column("_chunk").to_pylist(), []
        a, b, k = a[again], b[again], k[again]
        for i in np.unique(k):
            d = np.empty(int((k == i).sum()), pair)
            d["a"], d["b"] = a[k == i], b[k == i]
            out.append((numbers[i], d.tobytes()))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], schema=to_chunk)

    def removed(docs_of: pa.Table, later_of: pa.Table) -> pa.Table:
        rows = _order(docs_of, text_col)
        c = _Chunk(rows, text_col)
        n_words = len(c.h)
        gone = np.zeros(n_words + 1, np.int32)
        at = np.flatnonzero(c.starts(window))
        if len(at):
            a, b = whole(c)
            a, b = a[at], b[at]
            order = np.argsort(a, kind="stable")
            sa, sb = a[order], b[order]
            same = sa[1:] == sa[:-1]
            dup = np.zeros(len(a), bool)
            if (sb[1:][same] == sb[:-1][same]).all():
                dup[order[1:][same]] = True
            else:  # two windows share 64 bits only
                order = np.lexsort((at, b, a))
                dup[order[1:][(a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])]] = True
            if later_of.num_rows:
                d = np.concatenate([np.frombuffer(x, pair) for x in later_of.column("blob").to_pylist()])
                d = d[np.argsort(d["a"], kind="stable")]
                lo, hi = np.searchsorted(d["a"], a, "left"), np.searchsorted(d["a"], a, "right")
                one = np.flatnonzero(hi > lo)
                dup[one] |= d["b"][lo[one]] == b[one]
                for i in np.flatnonzero(hi - lo > 1):
                    dup[i] |= bool((d["b"][lo[i] : hi[i]] == b[i]).any())
            np.add.at(gone, at[dup], 1)
            np.add.at(gone, at[dup] + window, -1)
        cover = np.cumsum(gone)[:n_words] > 0
        lost = np.concatenate(([0], np.cumsum(cover)))
        n_removed = lost[c.ends] - lost[c.ends - c.sizes]
        kept = []
        for text, end, size, r in zip(c.texts, c.ends, c.sizes, n_removed):
            words = text.split()
            if r:
                keep = ~cover[end - size : end]
                words = [w for w, k in zip(words, keep.tolist()) if k]
            kept.append(b" ".join(words))
        rows = rows.drop_columns(["_null", "_key", "_chunk"])
        return rows.append_column("n_words", pa.array(c.sizes)).append_column("n_removed", pa.array(n_removed.astype(np.int64))).append_column("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))

    by_chunk = rows.repartition("_chunk")
    first = by_chunk.groupBy("_chunk").applyInArrow(probes, sent).groupBy("_bucket").applyInArrow(hits, hit)
    second = by_chunk.groupBy("_chunk").cogroup(first.groupBy("_chunk")).applyInArrow(candidates, sent).groupBy("_bucket").applyInArrow(later, hit)
    out = added(docs.schema, ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType()))
    return by_chunk.groupBy("_chunk").cogroup(second.groupBy("_chunk")).applyInArrow(removed, out)


def dedup_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words taken out of ``text`` and ``n_chars`` counted anew; texts without repeats and all other columns, whatever their names, stay as they are."""

    def run(df: DataFrame) -> DataFrame:
        found = substring_dedup(df)
        return found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))

    return beside(docs, ["doc_id", "text"], run, "text")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
