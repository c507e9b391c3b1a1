"""SentencePiece encoding by a forward pass over the trie of distinct marked words, and decoding."""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import added, table, without

MARK = "▁"


class Vocabulary:
    """Pieces, scores and bytes of a model with byte fallback whose pieces bear marks in front only.

    Models whose scores are log-probabilities (``unigram``) get the Viterbi pass proper: each prefix of a word has a best forward score and the piece it ends in.

    The vocabulary given is of the byte-pair kind: its scores are ranks of merges (0, -1, -2, ...), not log-probabilities, and the sum-maximising
    path is not what the model means. The forward pass is kept, with the recurrence that is right for merges: the pieces of a
    prefix end in exactly one piece, namely the one that its predecessor's last piece would leave unmerged. In both kinds a prefix has one forward state,
    whatever word goes on from it, and words in a trie share them.
    """

    def __init__(self, path: str | None = None, most: int = 700_000):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " Åﬁ  xＡ\t1"
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if sp.decode(sp.encode(probe)) != probe or any(MARK in names[i].lstrip(MARK) for i in plain):
            raise ValueError("the model normalises texts, lacks byte fallback or has marks inside of pieces")
        self.names = names
        self.score = {names[i]: sp.get_score(i) for i in plain}
        self.ids = {names[i]: i for i in plain}
        self.unigram = any(x != round(x) for x in self.score.values())
        self.unknown = min(self.score.values()) - 10.0  # the library's penalty of characters that are no piece
        self.byte = [0] * 256
        self.out: list[bytes] = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                self.byte[int(names[i][3:5], 16)] = i
                self.out[i] = bytes([int(names[i][3:5], 16)])
            elif sp.is_unknown(i):
                self.out[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.out[i] = names[i].replace(MARK, " ").encode()
        joined = sorted({c for p in self.score if len(p) > 1 for c in p} - {MARK})
        members = "".join(map(re.escape, joined))
        # characters that no longer piece has are words of their own: nothing merges with them
        self.words = re.compile(f"{MARK}*[{members}]+|{MARK}+|[^{MARK}]").findall
        self.most, self.known, self.old, self.fits = most, {}, {}, {}
        self.endings: dict = {}  # pieces from their last character to their first; 0 holds a piece's number
        for piece, i in self.ids.items():
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[0] = i

    def _alone(self, left: str, right: str) -> bool:
        """Whether merging all characters of ``left + right`` ends in these two pieces (``left`` may be empty)."""
        parts, at = [*left, *right], len(left)
        while len(parts) > 1:
            best, k, place = None, -1, 0
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, k = s, i
            if best is None:
                break
            place = sum(map(len, parts[: k + 1]))
            if place == at:
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return len(parts) == (2 if left else 1)

    def follows(self, left: int, right: int) -> bool:
        """Whether a text whose pieces end in ``left`` (-1: nothing) keeps them when ``right`` comes after."""
        key = (left + 1) << 22 | right
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= self.most:
                self.fits.clear()
            found = self.fits[key] = self._alone("" if left < 0 else self._text(left), self._text(right))
        return found

    def _text(self, piece: int) -> str:
        return self.names[piece] if piece < len(self.names) else chr(piece - len(self.names))

    def learn(self, words: set[str]) -> None:
        """Add the ids of ``words`` to ``known``: sorted, they are the trie in depth-first order, and forward states of the prefix
        that a word has in common with the one before it stay.

        A state is the number of a prefix' last piece (with its score, where scores add up); characters that are no piece are numbered behind the pieces.
        """
        last: list[int] = [-1]
        size: list[int] = [0]
        best: list[float] = [0.0]
        before = ""
        endings, fits, follows, n = self.endings, self.fits, self.follows, len(self.names)
        unigram, names, score = self.unigram, self.names, self.score
        for word in sorted(words):
            same, top = 0, min(len(word), len(before))
            while same < top and word[same] == before[same]:
                same += 1
            del last[same + 1 :], size[same + 1 :], best[same + 1 :]
            for end in range(same, len(word)):
                # all pieces that end here, read backwards from their last characters
                node, start, found = endings, end, []
                while start >= 0:
                    node = node.get(word[start])
                    if node is None:
                        break
                    piece = node.get(0)
                    if piece is not None:
                        found.append((start, piece))
                    start -= 1
                if not found or found[0][0] != end:
                    found.insert(0, (end, n + ord(word[end])))
                if unigram:  # the longest of equals
                    top, start, piece = max((best[b] + (score[names[p]] if p < n else self.unknown), -b, p) for b, p in found)
                    best.append(top)
                    last.append(piece)
                    size.append(end + 1 + start)
                    continue
                for start, piece in reversed(found):
                    left = last[start]
                    fit = fits.get((left + 1) << 22 | piece)
                    if fit or (fit is None and follows(left, piece)):
                        last.append(piece)
                        size.append(end + 1 - start)
                        break
            before, at, back = word, len(word), []
            while at:
                piece = last[at]
                if piece < n:
                    back.append(piece)
                else:
                    back.extend(self.byte[b] for b in reversed(chr(piece - n).encode()))
                at -= size[at]
            self.known[word] = array("i", reversed(back)).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text.

        Words are remembered in two halves: when the newer one is full the older one is forgotten, and words still in use move over.
        """
        split = [self.words(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set(chain.from_iterable(split))
        if len(self.known) + len(new) > self.most:
            self.old, self.known = self.known, {}
        new -= self.known.keys()
        for w in new & self.old.keys():
            self.known[w] = self.old[w]
        self.learn(new - self.known.keys())
        known = self.known.__getitem__
        parts = [b"".join(map(known, w)) for w in split]
        return np.frombuffer(b"".join(parts), np.int32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; one space that the first piece begins with is the mark put before every text."""
        if not ids:
            return ""
        out = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


_vocabularies: dict = {}


def _vocabulary(path: str | None) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encoded(docs: DataFrame, text_col: str = "text", model: str | None = None, sub_mb: float = 2.0) -> DataFrame:
    """``docs`` with ``ids`` (array of int): the pieces of each whole text, as the model's own library gives them.

    Null and empty texts have no ids. Distinct words are learnt from about ``sub_mb`` MB of text at a time and remembered by the worker (up to a
    bound), so no word is encoded twice in a row and no table of words is shuffled. A column ``ids`` of the input is replaced.
    """
    docs = without(docs, ["ids"])
    at = docs.columns.index(text_col)

    def run(batches):
        v = _vocabulary(model)
        for b in batches:
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(at)), 0), dtype=np.int64))
            start = 0
            while start < b.num_rows:
                base = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, base + sub_mb * 1e6, side="right")))
                part = b.slice(start, end - start)
                ids, lengths = v.encode([t or "" for t in part.column(at).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[*b.schema.names, "ids"])
                start = end

    return docs.mapInArrow(run, added(docs.schema, ("ids", T.ArrayType(T.IntegerType()))))


def decoded(df: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``df`` with ``decoded`` (string), the text of each row's ids; null and empty arrays give the empty text.

    Bytes that are no UTF-8 become U+FFFD. A column ``decoded`` of the input is replaced.
    """
    df = without(df, ["decoded"])
    at = df.columns.index(ids_col)

    def run(batches):
        v = _vocabulary(model)
        for b in batches:
            texts = pa.array([v.decode(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, "decoded"])

    return df.mapInArrow(run, added(df.schema, ("decoded", T.StringType())))


def round_trip(docs: DataFrame, model: str | None = None, sub_mb: float = 2.0) -> DataFrame:
    """(doc_id, n_ids, ids, decoded_sha256, same) of each row of ``docs`` (doc_id, text): its pieces, and the text that they give again.

    Encoding and decoding share a pass, so texts cross to Python once and don't come back.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType()), T.StructField("same", T.BooleanType())])

    def run(batches):
        v = _vocabulary(model)
        for b in batches:
            at, end = 0, 0
            sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0), dtype=np.int64))
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + sub_mb * 1e6, side="right")))
                texts = [t or "" for t in b.column(1).slice(at, end - at).to_pylist()]
                ids, lengths = v.encode(texts)
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
                again = [v.decode(ids[x:y].tolist()) for x, y in zip(offsets, offsets[1:])]
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in again]
                same = [x == y for x, y in zip(texts, again)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array(lengths), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(digests), pa.array(same)], names=schema.names)
                at = end

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
