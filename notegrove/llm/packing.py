"""Best-fit packing of tokenised documents into sequences under several capacities."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import stored, table

PIECE = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
)


class _Encoder:
    """Ids as ``tokenizers`` gives them for a file of a byte-level BPE vocabulary, special tokens' strings in a text included.

    The same vocabulary lies in two files. The rank file is read by the faster library; texts with the string of an added token,
    and what that library can't do, go to ``tokenizers``. Tests hold both together.
    """

    def __init__(self, path: str | None, ranks: str | None):
        import base64
        import json

        import public_tokenizers as public
        import tiktoken

        self.path = path or public.path("byte_bpe_50k.json")
        with open(self.path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        with open(ranks or public.path("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=table, special_tokens={})
        self.slow = None

    def __call__(self, text: str) -> np.ndarray:
        if not any(t in text for t in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # the library's panics aren't Exceptions
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict = {}


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each row of ``docs`` (doc_id, text).

    A row's ids end with ``end_id``; null and empty texts have that one only. Rows of more than ``capacity`` ids are cut into
    pieces of ``capacity``, the first of which may be shorter. Other columns are not read. Paths of the two vocabulary files are parameters.
    """
    schema = T.StructType([*PIECE.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]) if with_ids else PIECE
    shape = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches):
        if (tokenizer, ranks) not in _encoders:
            _encoders[tokenizer, ranks] = _Encoder(tokenizer, ranks)
        encode, last = _encoders[tokenizer, ranks], np.asarray([end_id], np.uint32)
        for b in batches:
            rows: list[list] = [[] for _ in shape]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.concatenate((encode(text or ""), last)).astype("<u4", copy=False)
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    for column, x in zip(rows, (doc, k, s, e - s, zlib.crc32(ids[s:e].tobytes()), ids[s:e].astype(np.int32) if with_ids else None)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, shape)], names=[n for n, _ in shape])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> np.ndarray:
    """The bin of each piece. A piece takes (length, 1, length**2) of a bin's tokens, documents and attention cost.

    Pieces go in order of falling length, each to the open bin where it fits in every dimension and that is best: by ``norm``,
    the least weighted norm of what is then left; by ``dot``, the greatest weighted dot product of its size and what is left,
    in shares of the capacities. Ties go to the bin opened first; where none fits, a bin is opened. A piece alone always has a bin.
    """
    cap, w = np.asarray(capacity, float), np.asarray(weights, float)
    n = len(lengths)
    bins = np.empty(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    left, name, open_, made = np.empty((n, 3)), np.empty(n, np.int64), 0, 0
    least = int(lengths.min()) if n else 0
    for k, i in enumerate(order):
        size = np.asarray((lengths[i], 1.0, float(lengths[i]) ** 2))
        rest = left[:open_] - size
        fits = np.flatnonzero((rest[:, 0] >= 0) & (rest[:, 1] >= 0) & (rest[:, 2] >= 0)) if open_ else ()
        if len(fits):
            share = rest[fits] / cap
            j = fits[np.argmin((share * share) @ w)] if rule == "norm" else fits[np.argmax((left[fits] / cap) @ (w * size / cap))]
            left[j] -= size
            bins[i] = name[j]
        else:
            bins[i] = made
            if cap[0] - size[0] >= least:
                left[open_], name[open_] = cap - size, made
                open_ += 1
            made += 1
        if k % 512 == 511:  # bins too full for the shortest piece are closed
            stay = np.flatnonzero((left[:open_, 0] >= least) & (left[:open_, 1] >= 1))
            left[: len(stay)], name[: len(stay)], open_ = left[stay], name[stay], len(stay)
    return bins


def pack(found: DataFrame, capacity: int = 1024, most_docs: int = 1024, most_cost: float = 1024.0**2, group: int = 65_536, rule: str = "norm") -> DataFrame:
    """``found`` (as ``pieces`` gives) with sequence_id and offset (long).

    Pieces are dealt by a hash into groups of about ``group``, and each group is packed by itself, so that tasks and
    memory stay the same size whatever the input; a group leaves at most a few sequences part full. Pieces with equal ids
    or lengths are rows of their own; no rows give none. With the defaults, documents and cost never bind before tokens do.
    """
    n = max(1, -(-found.count() // group))
    found = found.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", F.lit(3)), F.lit(n)))
    names = [f.name for f in found.schema.fields if f.name != "_group"]
    schema = T.StructType([*(found.schema[x] for x in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(x, "ascending") for x in ("doc_id", "piece", "length", "ids_crc32")])
        lengths = np.asarray(t.column("length"))
        full = lengths >= capacity
        bins = np.empty(len(lengths), np.int64)
        part = best_fit(lengths[~full], (capacity, most_docs, most_cost), rule=rule)
        bins[~full] = part
        bins[full] = np.arange(full.sum()) + (part.max() + 1 if len(part) else 0)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate(([True], np.diff(bins[order]) > 0)) if len(order) else np.empty(0, bool)
        offset = np.empty(len(lengths), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        bins = bins + (np.int64(t.column("_group")[0].as_py()) << np.int64(32))
        return t.select(names).append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offset))

    return found.groupBy("_group").applyInArrow(run, schema)


def best_fit_packing(docs: DataFrame) -> DataFrame:
    """``docs`` cut into pieces and packed; pieces (not their ids) are written to the shared folder in between."""
    return pack(stored(pieces(docs), "pieces"))


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
