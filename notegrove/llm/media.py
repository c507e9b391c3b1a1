"""Interleaved sequences of text and media: HTML gives ordered references, digests find the payloads."""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import stored, table
from .html_text import tokens

#: Samples in a row of an image, and the unit that payloads are filled up to.
WIDTH, UNIT = 24, 576
ITEM = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType())])
_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])
_SOURCE = re.compile(r"""\bsrc\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_MEDIA = {"img", "audio", "video", "source", "embed"}


def _tidy(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def sequence(page: str | None) -> list[dict]:
    """Text and media of one page, in order. A caption in the same figure goes to the figure's media, else media have none.

    References are ``sha256:<digest>``; others keep their whole source as the digest. Null pages and pages without text give no items.
    """
    out: list[dict] = []
    parts: list[str] = []
    figure: list[int] = []
    caption = False

    def flush(into: list[int] | None = None) -> None:
        text = _tidy(parts)
        parts.clear()
        if text and into is not None:
            for k in into:
                out[k]["caption"] = text
        elif text:
            out.append({"position": len(out), "kind": "text", "text": text, "digest": None, "caption": None})

    at, page = 0, page or ""
    for t in tokens(page):
        parts.append(page[at : t.start])
        at = t.end
        if not t.name or t.name in ("b", "i", "em", "strong", "a", "span"):
            continue
        if t.name == "br":
            parts.append(" ")
            continue
        flush(figure if caption else None)
        if t.name == "figcaption":
            caption = not t.closing
        elif t.name == "figure":
            figure, caption = [], False
        elif t.name in _MEDIA and not t.closing and (s := _SOURCE.search(t.attributes)):
            source = entities.unescape(s[1] or s[2] or s[3] or "")
            figure.append(len(out))
            out.append({"position": len(out), "kind": "media", "text": None, "digest": source.removeprefix("sha256:"), "caption": None})
    parts.append(page[at:])
    flush(figure if caption else None)
    return out


def sequences(pages: DataFrame, keys: list[str], html_col: str = "html") -> DataFrame:
    """``keys`` of ``pages`` and ``items``: array of (position, kind, text, digest, caption), see ``sequence``."""
    schema = T.StructType([*(pages.schema[k] for k in keys), T.StructField("items", T.ArrayType(ITEM))])

    def run(batches):
        for b in batches:
            items = pa.array([sequence(x) for x in b.column(len(keys)).to_pylist()], pa.list_(_ITEM))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], items], names=[*keys, "items"])

    return pages.select(*keys, html_col).mapInArrow(run, schema)


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, filled up with bytes 255 to a positive multiple of ``UNIT``."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def as_image(data: bytes) -> bytes:
    """A binary greymap (8-bit samples, ``WIDTH`` in a row) of ``data``."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(data) // WIDTH) + data


def samples(image: bytes) -> np.ndarray:
    """The samples (rows, ``WIDTH``) of a greymap's stored bytes."""
    kind, size, most, rest = image.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or most != b"255" or len(rest) != width * height:
        raise ValueError("no 8-bit binary greymap")
    return np.frombuffer(rest, np.uint8).reshape(height, width)


def feature(x: np.ndarray) -> str:
    """Shape, mean, variance and a 64-bit difference hash of the means of an 8 x 9 grid."""
    rows = np.add.reduceat(x, np.arange(8) * x.shape[0] // 8, axis=0, dtype=np.int64)
    grid = np.add.reduceat(rows, np.arange(9) * x.shape[1] // 9, axis=1)
    heights = np.diff(np.append(np.arange(8) * x.shape[0] // 8, x.shape[0]))
    widths = np.diff(np.append(np.arange(9) * x.shape[1] // 9, x.shape[1]))
    grid = grid / (heights[:, None] * widths[None, :])
    bits = np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()
    often = np.zeros(256, np.int64)  # a block at a time: a histogram takes eight bytes a sample
    for k in range(0, x.shape[0], 1 << 16):
        often += np.bincount(x[k : k + (1 << 16)].ravel(), minlength=256)
    level = np.arange(256)
    n, s, q = x.size, int(often @ level), int(often @ (level * level))
    return f"{x.shape[1]}x{x.shape[0]}:{s / n:.6f}:{(n * q - s * s) / (n * n):.4f}:{bits}"


def badge(lang: str | None) -> bytes:
    """The payload of the small picture that all pages in one language share: its name."""
    return payload(f"lang:{lang or ''}")


def page(doc_id: int | None, text: str | None, lang: str | None, digest: str) -> str:
    """The page of a document: a heading, the language's badge, the first half of its paragraphs (lines), the payload in a figure whose caption says its digest, and the other half."""
    blocks = [entities.escape(t, quote=False) for t in (text or "").split("\n")]
    half = (len(blocks) + 1) // 2
    paragraphs = lambda part: "".join(f"<p>{b}</p>" for b in part)
    mark = hashlib.sha256(as_image(badge(lang))).hexdigest()
    return f'<article><h1>Document {doc_id}</h1><img src="sha256:{mark}">{paragraphs(blocks[:half])}<figure><img src="sha256:{digest}"><figcaption>text {digest[:12]}</figcaption></figure>{paragraphs(blocks[half:])}</article>'


def illustrated(docs: DataFrame) -> DataFrame:
    """(doc_id, html, digest, n_bytes) of each row of ``docs`` (doc_id, text, lang): its page (see ``page``), the digest of its payload's image, and the length of its text in UTF-8."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("html", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("n_bytes", T.LongType())])

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                pages, digests, sizes = [], [], []
                for i, t, lang in zip(*(part.column(c).to_pylist() for c in range(3))):
                    digests.append(hashlib.sha256(as_image(payload(t))).hexdigest())
                    pages.append(page(i, t, lang, digests[-1]))
                    sizes.append(len((t or "").encode()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pages), pa.array(digests), pa.array(sizes, pa.int64())], names=schema.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, schema)


def images(payloads: DataFrame) -> DataFrame:
    """(digest, media) of each row of ``payloads`` (text): the bytes to be stored. Equal texts give equal rows; the table of them may hold a digest more than once."""
    schema = T.StructType([T.StructField("digest", T.StringType()), T.StructField("media", T.BinaryType())])

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 200):
                media = [as_image(payload(t)) for t in b.column(0).slice(k, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(media, pa.binary())], names=schema.names)

    return payloads.select(F.col("text").cast("string")).mapInArrow(run, schema)


def described(media: DataFrame) -> DataFrame:
    """What the stored bytes of each distinct digest of ``media`` (digest, media) hold, one row for each digest."""
    fields = [("digest", pa.string(), T.StringType()), ("payload_bytes", pa.int64(), T.LongType()), ("payload_sha256", pa.string(), T.StringType()), ("tail_crc32", pa.int64(), T.LongType()), ("media_bytes", pa.int64(), T.LongType()), ("media_sha256", pa.string(), T.StringType()), ("feature", pa.string(), T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, _, t in fields])

    def run(batches):
        for b in batches:
            rows = []
            for digest, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = samples(image)
                data = x.tobytes()
                rows.append((digest, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(x)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t, _) in enumerate(fields)], names=schema.names)

    return media.select("digest", "media").mapInArrow(run, schema).dropDuplicates(["digest"])


def resolved(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each item of ``found`` (``keys``, items), in its position, with what ``known`` (by digest) holds of it.

    Items of text, and media whose digest nobody knows, keep their rows with nulls, so positions and captions stay aligned.
    """
    items = found.select(*keys, F.explode("items").alias("i")).select(*keys, "i.*")
    return items.join(known, "digest", "left")


def op6_media(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # payloads and badges (a fixed text for each language) are stored once each, then described from the stored bytes
    badges = docs.select(F.concat(F.lit("lang:"), F.coalesce(F.col("lang").cast("string"), F.lit(""))).alias("text")).distinct()
    store = stored(images(docs.select("text").unionByName(badges)), "media")
    known = stored(described(store), "described")  # a table of its own, so that a digest that many documents have can be split in the join
    pages = illustrated(docs)
    keys = ["doc_id", "n_bytes", "digest_of_text", "n_items", "n_texts"]
    found = sequences(pages.withColumnRenamed("digest", "digest_of_text"), ["doc_id", "n_bytes", "digest_of_text"])
    found = found.withColumn("n_items", F.size("items")).withColumn("n_texts", F.size(F.filter("items", lambda i: i["kind"] == "text")))
    # of the sequence only references go to the join; the document's own picture is the one in the figure
    found = found.withColumn("items", F.filter("items", lambda i: i["kind"] == "media"))
    out = resolved(found, known, keys).where("digest = digest_of_text and caption is not null")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_items", "n_texts")
