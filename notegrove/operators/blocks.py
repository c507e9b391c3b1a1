"""Blocks and chunks of notes: line by line within a note, notes side by side."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import fixtures as fx

#: Tokens at which a group closes, most tokens of a chunk, and the share of lines that two chunks have in common.
TARGET_TOKENS, MAX_TOKENS, OVERLAP = 400, 500, 0.10
_LIST = re.compile(r"(?:[-*+] .*\S|[0-9]+[.)] )")


def tokens(text: str) -> int:
    return sum(max(len(w.encode()) // 5, 1) + (0 if w[0].isalnum() else 1) for w in text.split())


def _kind(line: str) -> str:
    s = line.strip()
    if s[:3] in ("```", "~~~"):
        return "code"
    if s[:1] == "#":
        return "heading"
    if s[:1] == ">":
        return "quote"
    if not s:
        return "blank"
    return "list" if _LIST.match(s) else "paragraph"


def _body_start(lines: list[str]) -> int:
    """The number of lines of an ended front matter."""
    if not lines or not lines[0].startswith("---") or not lines[0].endswith("\n"):
        return 0
    return next((i + 1 for i in range(1, len(lines)) if lines[i].startswith("---")), 0)


def blocks(content: str) -> list[dict]:
    """kind, level, text, start and end (bytes) of each block: headings are one line, fenced code ends with its fence, and
    neighbouring lines of one other kind are a block; blank lines end blocks."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", content)
    skip, at, out, fence = _body_start(lines), 0, [], None
    for i, line in enumerate(lines):
        start, at = at, at + len(line.encode())
        if i < skip:
            continue
        if fence:
            out[-1]["text"] += line
            out[-1]["end"] = at
            if line.lstrip().startswith(fence):
                fence = None
                out.append(None)  # a block ends here
            continue
        kind = _kind(line)
        if kind == "blank":
            out.append(None)
        elif kind in ("code", "heading"):
            level = min(len(re.match("#+", line.strip())[0]), 6) if kind == "heading" else 0
            out.append({"kind": kind, "level": level, "text": line.rstrip() if kind == "heading" else line, "start": start, "end": at})
            if kind == "code":
                fence = line.strip()[:3]
            else:
                out.append(None)
        elif out and out[-1] and out[-1]["kind"] == kind:
            out[-1]["text"] += line
            out[-1]["end"] = at
        else:
            out.append({"kind": kind, "level": 0, "text": line, "start": start, "end": at})
    return [b for b in out if b]


def _split(text: str, start: int) -> list[tuple[str, int, int]]:
    """Pieces of at most MAX_TOKENS at line ends, each beginning with the last tenth of the lines before; longer lines are cut at words."""
    out: list[tuple[str, int, int]] = []
    held: list[tuple[str, int]] = []  # line, where it starts
    size, at, fresh = 0, start, False

    def close() -> None:
        nonlocal held, size, fresh
        if held and fresh:
            joined = "\n".join(x for x, _ in held)
            out.append((joined, held[0][1], held[0][1] + len(joined.encode())))
            n = min(-(-len(held) * 10 // 100), len(held) - 1)
            held = held[len(held) - n :] if n else []
            size = sum(tokens(x) for x, _ in held)
        fresh = False

    for line in text.split("\n"):
        n = tokens(line)
        if n > MAX_TOKENS:
            close()
            held, size, here = [], 0, at
            words = re.findall(r"\S+\s*|\s+", line)
            part, count = "", 0
            for w in words:
                part += w
                count += tokens(w) if w.strip() else 0
                if count >= MAX_TOKENS:
                    out.append((part, here, here + len(part.encode())))
                    here += len(part.encode())
                    part, count = "", 0
            if part:
                out.append((part, here, here + len(part.encode())))
        else:
            if size + n > MAX_TOKENS and held:
                close()
            held.append((line, at))
            size += n
            fresh = True
        at += len(line.encode()) + 1
    close()
    return out


def chunks(content: str) -> list[dict]:
    """ordinal, heading_path, text, start, end, tokens: groups of blocks under one heading, closed at TARGET_TOKENS; code stands alone and whole."""
    groups: list[tuple[str, list[dict]]] = []
    path: list[tuple[int, str]] = []
    open_: list[dict] = []
    size = 0

    def close() -> None:
        nonlocal open_, size
        if open_:
            groups.append((" > ".join(t for _, t in path), open_))
        open_, size = [], 0

    for b in blocks(content):
        if b["kind"] == "heading":
            close()
            while path and path[-1][0] >= b["level"]:
                path.pop()
            path.append((b["level"], b["text"].strip().lstrip("#").strip()))
        elif b["kind"] == "code":
            close()
            open_ = [b]
            close()
        else:
            open_.append(b)
            size += tokens(b["text"])
            if size >= TARGET_TOKENS:
                close()
    close()
    out = []
    for heading, group in groups:
        text = "\n\n".join(b["text"] for b in group)
        whole = [(text, group[0]["start"], group[-1]["end"])]
        alone = group[0]["kind"] == "code"
        for t, s, e in whole if alone or tokens(text) <= MAX_TOKENS else _split(text, group[0]["start"]):
            out.append({"ordinal": len(out), "heading_path": heading, "text": t, "start": s, "end": e, "tokens": tokens(t)})
    return out


BLOCK = [("kind", pa.string(), T.StringType()), ("level", pa.int32(), T.IntegerType()), ("text", pa.string(), T.StringType()), ("start", pa.int64(), T.LongType()), ("end", pa.int64(), T.LongType())]
CHUNK = [("ordinal", pa.int32(), T.IntegerType()), ("heading_path", pa.string(), T.StringType()), ("text", pa.string(), T.StringType()), ("start", pa.int64(), T.LongType()), ("end", pa.int64(), T.LongType()), ("tokens", pa.int32(), T.IntegerType())]


def _rows(notes: DataFrame, make, fields) -> DataFrame:
    """One row for each item that ``make`` finds in a note's content; items of a few notes at a time leave the task."""
    schema = T.StructType([T.StructField("path", T.StringType()), *(T.StructField(n, t) for n, _, t in fields)])

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                found = [(p, x) for p, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for x in make(c or "")]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), *(pa.array([x[n] for _, x in found], t) for n, t, _ in fields)], names=schema.names)

    return notes.select("path", "content").mapInArrow(run, schema)


def block_rows(notes: DataFrame) -> DataFrame:
    return _rows(notes, blocks, BLOCK)


def chunk_id() -> Column:
    """The id of the chunk of ``path`` and ``ordinal``."""
    return F.sha2(F.concat_ws("|", "path", F.col("ordinal").cast("string")), 256)


def chunk_rows(notes: DataFrame) -> DataFrame:
    """Chunks with ids that depend on path and ordinal only."""
    return _rows(notes, chunks, CHUNK).withColumn("chunk_id", chunk_id())


def md_blocks(spark, d):
    return block_rows(fx.vault(spark, d))


def md_chunks(spark, d):
    return chunk_rows(fx.vault(spark, d))


def chunks_split(spark, d):
    """Chunks of documents, many of which are longer than a chunk."""
    return chunk_rows(fx.doc_notes(spark, d)).select("path", "ordinal", "start", "end", "tokens")


def chunks_hard(spark, d):
    """Chunks of documents whose lines have been joined to one, so that they are cut at words."""
    one = fx.doc_notes(spark, d).withColumn("content", F.regexp_replace("content", r"\s+", " "))
    return chunk_rows(one).select("path", "ordinal", "start", "end", "tokens")


def chunk_ordinals(spark, d):
    """Chunks numbered by their place in the note by a window; equal to the numbers that the chunker gave."""
    from pyspark.sql import Window as W

    c = chunk_rows(fx.vault(spark, d))
    return c.select("path", (F.row_number().over(W.partitionBy("path").orderBy("start")) - 1).cast("long").alias("ordinal"), (F.octet_length("text") > 0).alias("filled"))


def note_from_chunks(spark, d):
    """Notes put together again from their chunks."""
    c = chunk_rows(fx.vault(spark, d))
    return c.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n\n").alias("content"))


QUERIES = {"md_blocks": md_blocks, "chunks": md_chunks, "chunks_split": chunks_split, "chunks_hard": chunks_hard, "chunk_ordinals": chunk_ordinals, "note_from_chunks": note_from_chunks}
_P = "chr(10) || chr(10)"
#: The vault's notes cut by SQL at their blank lines; every part but code is a paragraph or a heading.
_CUT = f"""vault AS ({fx.VAULT}), c AS (SELECT *, string_split(content, {_P}) AS s, regexp_extract(content, '(^|\\n)# ([^\\n]*)', 2) AS heading FROM vault),
ch AS (SELECT path, 0 AS ordinal, heading AS heading_path, CASE WHEN path LIKE 'Parts/%' THEN s[2] || chr(10) || {_P} || s[3] WHEN path LIKE 'Suppliers/%' THEN s[2] || chr(10) WHEN path LIKE 'Nations/%' THEN s[2] ELSE content END AS text, CASE WHEN path LIKE 'Inbox/%' THEN 0 ELSE strlen(s[1]) + 2 END AS start,
 CASE WHEN path LIKE 'Suppliers/%' THEN strlen(s[1]) + strlen(s[2]) + 3 ELSE strlen(content) END AS fin FROM c UNION ALL SELECT path, 1, heading, s[3], strlen(s[1]) + strlen(s[2]) + 4, strlen(content) FROM c WHERE path LIKE 'Suppliers/%')"""
_COUNT = r"CAST(list_sum(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: greatest(strlen(w) // 5, 1) + CASE WHEN regexp_matches(w[1], '[\p{L}\p{N}]') THEN 0 ELSE 1 END)) AS INT)"
_BLOCKS = f"""b AS (SELECT path, 'heading' AS kind, 1 AS level, '# ' || heading AS text, strlen(s[1]) - strlen(heading) - 2 AS start, strlen(s[1]) + 1 AS fin FROM c WHERE heading <> ''
UNION ALL SELECT path, 'paragraph', 0, CASE WHEN len(s) > 2 THEN s[2] || chr(10) ELSE s[2] END, strlen(s[1]) + 2, strlen(s[1]) + 2 + strlen(s[2]) + CASE WHEN len(s) > 2 THEN 1 ELSE 0 END FROM c WHERE heading <> ''
UNION ALL SELECT path, CASE WHEN path LIKE 'Suppliers/%' THEN 'code' ELSE 'paragraph' END, 0, s[3], strlen(s[1]) + strlen(s[2]) + 4, strlen(content) FROM c WHERE len(s) > 2
UNION ALL SELECT path, 'paragraph', 0, content, 0, strlen(content) FROM c WHERE heading = '')"""
ORACLE = {
    "md_blocks": f'WITH {_CUT}, {_BLOCKS} SELECT path, kind, level, text, start, fin AS "end" FROM b',
    "chunks": f"WITH {_CUT} SELECT path, ordinal, heading_path, text, start, fin AS \"end\", {_COUNT} AS tokens, sha256(path || '|' || ordinal) AS chunk_id FROM ch",
    "chunk_ordinals": f"WITH {_CUT} SELECT path, CAST(ordinal AS BIGINT) AS ordinal, strlen(text) > 0 AS filled FROM ch",
    "note_from_chunks": f"WITH {_CUT} SELECT path, string_agg(text, {_P} ORDER BY ordinal) AS content FROM ch GROUP BY path",
}
