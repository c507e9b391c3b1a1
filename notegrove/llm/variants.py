"""Spelling variants: words one edit apart, by two-dimensional range reporting over forward and reverse orders with wavelet trees."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import stored, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a task counts before it sends them; code points of words that are indexed together.
KEPT, TOGETHER = 300_000, 300_000
#: A cell is split if it has more code points than the first and more words than the second.
CELL, FEW = 100_000, 64


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", odd: int = 97, shortest: int = 5) -> DataFrame:
    """(word, n) of all words of ``shortest`` code points or more.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. Where ``odd`` divides h, the crc32 of ``<id>:<run>``, the run loses its code point
    h % length. Null texts have no words; where the id is null no run loses any. Tasks count their own words first, each run of a document once.
    """

    def count(batches):
        total: dict[str, int] = {}

        def row():
            kept = [(w, n) for w, n in total.items() if len(w) >= shortest]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                for doc, text in zip(part.column(0).to_pylist(), pc.ascii_lower(part.column(1)).to_pylist()):
                    start = None if doc is None else zlib.crc32(f"{doc}:".encode())
                    for run, n in Counter(RUN.findall(text or "")).items():
                        if start is not None:
                            h = zlib.crc32(run.encode(), start)
                            if h % odd == 0:
                                at = h % len(run)
                                run = run[:at] + run[at + 1 :]
                        total[run] = total.get(run, 0) + n
                if len(total) >= KEPT:
                    yield row()
                    total.clear()
        yield row()

    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Wavelet:
    """A permutation of 0 .. n - 1 as a wavelet tree, a bit a level: counts of ones tell where the values of a range of places go."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.bits = range(max(1, (n - 1).bit_length()) - 1, -1, -1)
        self.ones, self.zeros = [], []
        for b in self.bits:
            bit = (values >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(n - int(bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def report(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the query, value) of all values in [y0, y1) at places in [x0, x1), for all queries at once."""
        q, left, right, base = np.arange(len(x0)), x0, x1, np.zeros(len(x0), np.int64)
        for b, ones, zeros in zip(self.bits, self.ones, self.zeros):
            a, c = ones[left], ones[right]
            q, base = np.concatenate((q, q)), np.concatenate((base, base + (1 << b)))
            left, right = np.concatenate((left - a, zeros + a)), np.concatenate((right - c, zeros + c))
            keep = (right > left) & (base < y1[q]) & (base + (1 << b) > y0[q])
            q, left, right, base = q[keep], left[keep], right[keep], base[keep]
        return q, base


class _Order:
    """Words of k and k + 1 letters in one order, with the length of what each has in common with the word before it."""

    def __init__(self, words: list[str], letters: np.ndarray, long: np.ndarray):
        self.order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.order] = np.arange(len(words))
        m = letters[self.order]
        self.same = np.argmax(m[1:] != m[:-1], axis=1) if len(words) > 1 else np.empty(0, np.int64)
        is_long = long[self.order]
        # places of a kind before each place of all
        self.before = {True: np.concatenate(([0], np.cumsum(is_long))), False: np.concatenate(([0], np.cumsum(~is_long)))}
        self.of = {kind: self.order[is_long == kind] for kind in (True, False)}

    def interval(self, who: np.ndarray, size: int, kind: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of a kind (long or not) stand that share their first ``size`` letters with the words ``who``."""
        cut = np.concatenate(([0], np.flatnonzero(self.same < size) + 1, [len(self.order)]))
        at = np.searchsorted(cut, self.rank[who], side="right")
        return self.before[kind][cut[at - 1]], self.before[kind][cut[at]]


def near_pairs(short: list[str], long: list[str], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of numbers of ``short + long`` that are one edit apart at a place from ``lo`` up to ``hi``, not included: both ways between words of ``short``, all of k letters, that differ by one replaced
    letter, and from ``short`` to ``long``, of k + 1 letters, by one inserted.

    For each place the words before it form an interval of the forward order, and those after it one of the reverse order; the words in both are reported by a wavelet
    tree. An insertion into a row of equal letters counts at its first place only, so each pair comes once.
    """
    words, k = short + long, len(short[0])
    letters = np.zeros((len(words), k + 1), np.uint16)
    letters[: len(short), :k] = np.frombuffer("".join(short).encode("utf-16-le"), np.uint16).reshape(-1, k)
    backward = np.zeros_like(letters)
    backward[: len(short), :k] = letters[: len(short), :k][:, ::-1]
    if long:
        letters[len(short) :] = np.frombuffer("".join(long).encode("utf-16-le"), np.uint16).reshape(-1, k + 1)
        backward[len(short) :] = letters[len(short) :][:, ::-1]
    is_long = np.arange(len(words)) >= len(short)
    forward, reverse = _Order(words, letters, is_long), _Order([w[::-1] for w in words], backward, is_long)
    place = {}
    for kind in (False, True):
        back = np.empty(len(words), np.int64)
        back[reverse.of[kind]] = np.arange(len(reverse.of[kind]))
        place[kind] = Wavelet(back[forward.of[kind]]) if len(forward.of[kind]) else None
    who = np.arange(len(short))
    # no word has more letters in common with another than this, from either end
    first, last = int(forward.same.max(initial=0)), int(reverse.same.max(initial=0))
    a, b = [], []
    for i in range(max(lo, k - 1 - last), min(hi, first + 1, k + 1)):
        for kind, rest in ((False, k - 1 - i), (True, k - i)):
            if rest < 0 or place[kind] is None:
                continue
            (x0, x1), (y0, y1) = forward.interval(who, i, kind), reverse.interval(who, rest, kind)
            some = np.flatnonzero((x1 - x0 > 1 - kind) & (y1 - y0 > 1 - kind))
            if not len(some):
                continue
            q, y = place[kind].report(x0[some], x1[some], y0[some], y1[some])
            u, v = who[some][q], reverse.of[kind][y]
            keep = letters[v, i] != letters[u, i - 1] if kind and i else u != v
            a.append(u[keep])
            b.append(v[keep])
    none = np.empty(0, np.int64)
    return np.concatenate(a) if a else none, np.concatenate(b) if b else none


def _cells(words: DataFrame, shortest: int) -> DataFrame:
    """(k, lo, hi, key, long, word, n): cells in which pairs are looked for. A pair is words of k and of k (or k + 1, ``long``) letters that differ at a place in [lo, hi), so what is before
    ``lo`` and from ``hi`` on is the same: ``key``.

    At first places are cut in two halves. A cell of more than ``CELL`` code points and ``FEW`` words is split in two by the middle of its places, again and again; in the end places are
    single, and at most twice as many words as there are letters differ there. Words that have little in common with others, however long, are in cells of few words, which stay whole.
    """
    size = F.length("word")
    home = words.withColumn("long", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("k", F.when(F.col("long"), size - 1).otherwise(size)).where(F.col("k") >= shortest)
    halves = F.array(F.struct(F.lit(0).alias("lo"), F.expr("(k + 1) div 2").cast("int").alias("hi")), F.struct(F.expr("(k + 1) div 2").cast("int").alias("lo"), (F.col("k") + 1).alias("hi")))
    key = F.xxhash64(F.expr("left(word, lo)"), F.expr("right(word, greatest(k - hi, 0))"))
    of = ["k", "lo", "hi", "key"]
    rows = home.withColumn("_w", F.explode(halves)).select("k", "_w.lo", "_w.hi", "long", "word", "n").withColumn("key", key)
    rows, done = stored(rows, "cells"), None
    while True:
        large = rows.groupBy(*of).agg(F.sum(F.length("word").cast("long")).alias("s"), F.count("*").alias("m")).where((F.col("s") > CELL) & (F.col("m") > FEW) & (F.col("hi") - F.col("lo") > 1)).drop("s", "m")
        large = stored(large, "large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, of, "left_anti")
        done = small if done is None else done.unionByName(small)
        middle = F.expr("(lo + hi) div 2").cast("int")
        parts = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
        rows = rows.join(large, of, "left_semi").withColumn("_w", F.explode(parts)).select("k", "_w.lo", "_w.hi", "long", "word", "n").withColumn("key", key)
        rows = stored(rows, "cells")


def near_words(words: DataFrame, shortest: int = 5) -> DataFrame:
    """(word, n_near, form, form_n) of the rows of ``words`` (word, n; distinct) that have near words: those that differ by exactly one inserted, deleted or replaced code point.

    ``form`` is the near word of largest n, ties to the smallest in code-point order, and ``form_n`` its n. Cells that share a call are indexed together, those of equal (k, lo, hi) in one tree: words of
    different cells never share an interval of both orders. Only counts and the best word of each word leave a call.
    """
    cells = _cells(words, shortest)
    total = cells.agg(F.sum(F.length("word").cast("long"))).first()[0] or 0
    cells = cells.withColumn("_call", F.pmod(F.xxhash64("k", "lo", "hi", "key"), F.lit(max(1, -(-total // TOGETHER)))))
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n_near", T.LongType()), T.StructField("form", T.StringType()), T.StructField("form_n", T.LongType())])

    def call(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("k", "lo", "hi", "long", "word")])
        k, lo, hi = (np.asarray(t.column(c)) for c in ("k", "lo", "hi"))
        word, n, long = t.column("word").to_pylist(), np.asarray(t.column("n")), np.asarray(t.column("long"))
        cut = np.concatenate(([0], np.flatnonzero((np.diff(k) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1, [len(k)]))
        out: list = [[], [], [], []]
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            middle = s + int((~long[s:e]).sum())
            if middle == s:
                continue
            a, b = near_pairs(word[s:middle], word[middle:e], int(lo[s]), int(hi[s]))
            far = b >= middle - s
            u, v = np.concatenate((a, b[far])) + s, np.concatenate((b, a[far])) + s
            if not len(u):
                continue
            of = np.array(word[s:e], object)
            by_word = np.empty(e - s, np.int64)
            by_word[np.argsort(of, kind="stable")] = np.arange(e - s)
            order = np.lexsort((by_word[v - s], -n[v], u))
            u, v = u[order], v[order]
            first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            out[0] += [word[x] for x in u[first].tolist()]
            out[1] += np.diff(np.append(first, len(u))).tolist()
            out[2] += [word[x] for x in v[first].tolist()]
            out[3] += n[v[first]].tolist()
        return pa.table([pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=schema.names)

    found = cells.groupBy("_call").applyInArrow(call, schema)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), "form")).alias("b"))
    return best.select("word", "n_near", "b.form", (-F.col("b.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last word that forms lead to. Forms have at least twice the n of their words, so chains are short, and each round halves what is left of them."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("_moved")), "roots")
        if after.where("_moved").isEmpty():
            return after.drop("_moved")
        now = after.drop("_moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 5, least: int = 3) -> DataFrame:
    """word, form, root, n, n_near, form_n: the distinct words (``word_counts``) of ``shortest`` code points and ``least`` occurrences or more.

    ``form`` is the near word (one code point inserted, deleted or replaced) of largest n, ties to the smallest in code-point order, if that is at least twice the word's n, else null;
    ``root`` is where forms lead to, the word itself if it has none; ``n_near`` counts near words, ``form_n`` is the form's n. No rows, null and empty texts give no words; extra columns don't matter.
    """
    words = stored(word_counts(docs, id_col, text_col, shortest=shortest).where(F.col("n") >= least), "words")
    near = stored(near_words(words, shortest), "near")
    joined = words.join(near, "word", "left")
    has = F.col("form_n") >= 2 * F.col("n")
    known = stored(joined.select("word", F.when(has, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form_n")).alias("form_n")), "forms")
    last = roots(known.where("form is not null").select("word", "form"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
