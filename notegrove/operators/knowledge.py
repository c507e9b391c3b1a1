"""Sentences, claims, relations, entities and links of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..plans import fixtures as fx
from .markdown import PARSED

# The words that mark claims, in the order in which they are tried, and the predicate of each type.
MARKERS = [
    ("DECISION", ["decided", "chose", "chosen", "switched to", "went with", "we use"]),
    ("GOAL", ["want to", "plan to", "goal", "learning", "learn "]),
    ("PREFERENCE", ["prefer", "favorite", "favourite", "i like", "i love", "i hate"]),
    ("HYPOTHESIS", ["might", "maybe", "possibly", "considering", "may use", "perhaps"]),
    ("EXPERIENCE", ["caused", "problem", "failed", "broke", "issue with", "error"]),
    ("OBSERVATION", ["yesterday", "today", "last week", "noticed", "observed"]),
    ("BELIEF", ["believe", "think that", "seems like", "probably"]),
    ("FACT", [" is ", " are ", " was ", " were ", " has ", " have ", " uses "]),
]
PREDICATES = {"DECISION": "decided", "GOAL": "intends", "PREFERENCE": "prefers", "HYPOTHESIS": "hypothesizes", "EXPERIENCE": "experienced", "OBSERVATION": "observed", "BELIEF": "believes", "FACT": "states", "QUESTION": "asks"}
NEGATIONS = [" not ", "n't ", "never ", "no longer "]
QUESTIONS = ["what ", "how ", "why ", "should "]
FIRST_PERSON = ["i ", "i'", "my ", "we "]
RELATIONS = [
    ("uses", "FACT", ["uses", "using", " use ", "built with", "written in", "powered by"]),
    ("interested_in", "GOAL", ["interested in", "exploring", "learning"]),
    ("part_of", "FACT", ["part of", "belongs to", "member of"]),
]


def contains_any(text: Column, words: list[str]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def starts_any(text: Column, words: list[str]) -> Column:
    out = text.startswith(words[0])
    for w in words[1:]:
        out = out | text.startswith(w)
    return out


def sentences(notes: DataFrame, *keep: str) -> DataFrame:
    """path, offset (bytes), sentence: text up to a line's end or to ``.!?`` before a blank, fenced code left out.

    The one character at which a text is cut is one byte, so offsets are running sums of bytes within a note.
    """
    inside = "\x01"  # marks what does not begin a line
    marked = F.regexp_replace("content", r"([.!?]) ", "$1\n" + inside)
    p = notes.select("path", *keep, F.posexplode(F.split(marked, "\n")).alias("ord", "piece"))
    w = W.partitionBy("path").orderBy("ord")
    bare = F.regexp_replace("piece", "^" + inside, "")
    p = p.withColumns({"bare": bare, "fence": F.col("piece").rlike("^(```|~~~)").cast("int")})
    p = p.withColumns({"at": F.sum(F.octet_length("bare") + 1).over(w) - F.octet_length("bare") - 1, "code": F.sum("fence").over(w) % 2})
    p = p.where("code = 0 and fence = 0").withColumn("sentence", F.trim("bare")).where("sentence <> ''")
    return p.select("path", *keep, (F.col("at") + F.octet_length("bare") - F.octet_length(F.ltrim("bare"))).alias("offset"), "sentence")


def claim_type(lower: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, words in MARKERS:
        out = out.when(contains_any(lower, words), name)
    return out


def _relation(lower: Column, index: int) -> Column:
    out = F.when(F.lit(False), "")
    for r in RELATIONS:
        out = out.when(contains_any(lower, r[2]), r[index])
    return out


def judged(notes: DataFrame) -> DataFrame:
    """Sentences of parsed notes with all that rules say of them."""
    s = sentences(notes, "title", "links").withColumn("lower", F.lower("sentence"))
    low = F.col("lower")
    return s.withColumns(
        {
            "question": F.col("sentence").endswith("?") | starts_any(low, QUESTIONS),
            "negated": contains_any(low, NEGATIONS),
            "ctype": claim_type(low),
            "link": F.get(F.filter("links", lambda x: low.contains(F.lower(x))), F.lit(0)),
            "relation": _relation(low, 0),
            "rtype": _relation(low, 1),
        }
    )


def claims(notes: DataFrame) -> DataFrame:
    return claimed(judged(notes))


def claimed(j: DataFrame) -> DataFrame:
    """Claims of judged sentences: questions end the matter; a sentence may give both a relation's claim and a plain one."""
    polarity = F.when(F.col("negated"), -1).otherwise(1)
    one = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("subject", "predicate", "object", "claim_type", "polarity", "confidence"))])
    subject = F.when(starts_any(F.col("lower"), FIRST_PERSON), "user").otherwise(F.col("title"))
    question = one(F.col("title"), F.lit("asks"), md.cut(F.col("sentence")), F.lit("QUESTION"), F.lit(1), F.lit(0.9))
    relation = one(F.col("title"), F.col("relation"), F.col("link"), F.col("rtype"), polarity, F.lit(0.7))
    names = F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv])
    plain = one(subject, names[F.col("ctype")], md.cut(F.col("sentence")), F.col("ctype"), polarity, F.lit(0.8))
    related = ~F.col("negated") & F.col("relation").isNotNull() & F.col("link").isNotNull()
    found = F.when(F.col("question"), F.array(question)).otherwise(F.array_compact(F.array(F.when(related, relation), F.when(F.col("ctype").isNotNull(), plain))))
    out = j.select("path", "offset", F.explode_outer(found).alias("c")).where("c is not null").select("path", "offset", "c.*")
    return out.withColumn("claim_id", F.sha2(F.concat_ws("|", "path", F.col("offset").cast("string"), "claim_type", "predicate"), 256))


def relationships(notes: DataFrame) -> DataFrame:
    return related(judged(notes))


def related(j: DataFrame) -> DataFrame:
    """path, source, relation, target: one for each judged sentence at most, each once in a note."""
    j = j.where("not question and not negated and relation is not null and link is not null")
    return j.select("path", F.col("title").alias("source"), "relation", F.col("link").alias("target")).distinct()


def _own() -> Column:
    """The title, as a list, unless a tag or link of the note is equal but for case."""
    return F.when(~F.exists(F.concat("tags", "links"), lambda x: F.lower(x) == F.lower(F.trim("title"))) & (F.trim("title") != ""), F.array(F.trim("title"))).otherwise(F.array().cast("array<string>"))


def mentioned() -> Column:
    """The keys of a parsed note's ``candidates``, each once."""
    return F.array_distinct(F.transform(F.concat("tags", "links", _own()), lambda x: F.lower(x)))


def called() -> Column:
    """The names that links may know a parsed note by, each once: its path without ``.md``, and its title."""
    return F.array_distinct(F.array(F.lower(F.regexp_replace("path", r"\.md$", "")), F.lower("title")))


def candidates(notes: DataFrame) -> DataFrame:
    """path, mtime, name, kind, rank: tags, link targets, and the title unless one of these is equal but for case."""
    parts = [notes.select("path", "mtime", F.posexplode(items).alias("ord", "name"), F.lit(kind).alias("kind"), F.lit(k).alias("k")) for k, (items, kind) in enumerate([(F.col("tags"), "TOPIC"), (F.col("links"), "CONCEPT"), (_own(), "DOCUMENT")])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def entities(notes: DataFrame) -> DataFrame:
    """Entities by name without case: name and kind are those of the first mention (by path), counts and times those of all."""
    first = F.struct("path", "k", "ord")
    return candidates(notes).groupBy(F.lower("name").alias("key")).agg(F.min_by("name", first).alias("canonical_name"), F.min_by("kind", first).alias("type"), F.min("mtime").alias("first_seen"), F.max("mtime").alias("last_seen"), F.count_distinct("path").alias("source_count"))


def mentions(notes: DataFrame) -> DataFrame:
    return candidates(notes).select(F.lower("name").alias("key"), "path").distinct()


def filed() -> Column:
    """The names that only a parsed note's file gives it: its path, and its file name with and without its ending."""
    names = F.array(F.lower(md.stem(F.col("path"))), F.lower(F.element_at(F.split("path", "/"), -1)), F.lower("path"))
    return F.array_except(names, called())


def resolved_links(notes: DataFrame, file_names: bool = False) -> DataFrame:
    """path, target, resolved: the first note (by path) whose path without ``.md`` or title is the target, case aside. With ``file_names`` links that these leave open lead to the first note that bears the target as ``filed`` says.

    Names are one list that is joined by equality, never by a disjunction.
    """
    each = F.transform(called(), lambda x: F.struct(x.alias("key"), F.lit(0).alias("by")))
    if file_names:
        each = F.concat(each, F.transform(filed(), lambda x: F.struct(x.alias("key"), F.lit(1).alias("by"))))
    names = notes.select(F.explode(each).alias("x"), "path").groupBy("x.key").agg(F.min(F.struct("x.by", "path"))["path"].alias("resolved"))
    links = notes.select("path", F.explode("links").alias("target")).withColumn("key", F.lower("target"))
    return links.join(names, "key", "left").select("path", "target", "resolved")


def _notes(spark, d):
    return md.parsed(fx.vault(spark, d))


def q_sentences(spark, d):
    return sentences(fx.doc_notes(spark, d)).unionByName(sentences(fx.vault(spark, d)))


def q_claims(spark, d):
    return claims(_notes(spark, d)).drop("claim_id")


def doc_claims(spark, d):
    """Claims of documents by type and polarity."""
    s = sentences(fx.doc_notes(spark, d)).withColumn("lower", F.lower("sentence"))
    s = s.withColumn("t", F.when(F.col("sentence").endswith("?") | starts_any(F.col("lower"), QUESTIONS), "QUESTION").otherwise(claim_type(F.col("lower")))).where("t is not null")
    return s.groupBy(F.col("t").alias("claim_type"), F.when((F.col("t") != "QUESTION") & contains_any(F.col("lower"), NEGATIONS), -1).otherwise(1).alias("polarity")).agg(F.count("*").alias("n"))


def claim_groups(spark, d):
    return claims(_notes(spark, d)).groupBy(F.lower("subject").alias("subject"), "claim_type").agg(F.count("*").alias("n"), F.count_if(F.col("polarity") < 0).alias("negative"))


def claim_subject(spark, d):
    return _notes(spark, d).select("path", F.coalesce("title", F.lit("this note")).alias("subject"))


def q_relationships(spark, d):
    return relationships(_notes(spark, d))


def relationships_resolved(spark, d):
    """Relations by the canonical names of their ends; ends that nobody mentions become concepts of no source."""
    n = _notes(spark, d)
    known = entities(n).select("key", "canonical_name", "type")
    r = relationships(n)
    ends = r.select(F.lower("source").alias("key"), F.col("source").alias("name")).unionByName(r.select(F.lower("target").alias("key"), F.col("target").alias("name"))).groupBy("key").agg(F.min("name").alias("canonical_name"))
    every = known.unionByName(ends.join(known, "key", "left_anti").withColumn("type", F.lit("CONCEPT")))
    a, b = every.select(F.col("key").alias("sk"), F.col("canonical_name").alias("source_name")), every.select(F.col("key").alias("tk"), F.col("canonical_name").alias("target_name"), F.col("type").alias("target_type"))
    return r.join(a, F.lower("source") == F.col("sk")).join(b, F.lower("target") == F.col("tk")).select("path", "source_name", "relation", "target_name", "target_type").distinct()


def q_candidates(spark, d):
    return candidates(_notes(spark, d)).select("path", "name", "kind")


def q_entities(spark, d):
    return entities(_notes(spark, d))


def entity_mentions(spark, d):
    return mentions(_notes(spark, d))


def link_resolution(spark, d):
    return resolved_links(_notes(spark, d))


def reindex_idempotent(spark, d):
    """Claims after a third of the notes has been indexed again: their old claims go, their new ones come, nothing else changes."""
    n = _notes(spark, d)
    again = n.where("mtime % 3 = 0")
    old = claims(n)
    kept = old.join(again.select("path"), "path", "left_anti")
    return kept.unionByName(claims(again)).groupBy("claim_type").agg(F.count("*").alias("n"), F.count_distinct("claim_id").alias("ids"))


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


def _starts(column: str, words: list[str]) -> str:
    return "(" + " OR ".join("starts_with({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


def _sentences_sql(source: str, name: str) -> str:
    return rf"""{name}_p AS (SELECT path, string_split(regexp_replace(content, '([.!?]) ', '\1' || chr(10) || chr(1), 'g'), chr(10)) AS ps FROM {source}),
{name}_u AS (SELECT path, unnest(range(1, len(ps) + 1)) AS ord, ps FROM {name}_p),
{name}_b AS (SELECT path, ord, CASE WHEN starts_with(ps[ord], chr(1)) THEN substr(ps[ord], 2) ELSE ps[ord] END AS bare, CASE WHEN regexp_matches(ps[ord], '^(```|~~~)') THEN 1 ELSE 0 END AS fence FROM {name}_u),
{name}_w AS (SELECT *, sum(strlen(bare) + 1) OVER w - strlen(bare) - 1 AS a, sum(fence) OVER w % 2 AS code FROM {name}_b WINDOW w AS (PARTITION BY path ORDER BY ord)),
{name} AS (SELECT path, CAST(a + strlen(bare) - strlen(ltrim(bare, ' ')) AS BIGINT) AS "offset", trim(bare, ' ') AS sentence, lower(trim(bare, ' ')) AS low FROM {name}_w WHERE code = 0 AND fence = 0 AND trim(bare, ' ') <> '')"""


_CASE = "CASE " + " ".join(f"WHEN {_any('low', w)} THEN '{n}'" for n, w in MARKERS) + " END"
_PRED = "CASE ctype " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PREDICATES.items()) + " END"
_Q = f"(sentence LIKE '%?' OR {_starts('low', QUESTIONS)})"
#: titles, links (path, i, link), sentences, judged sentences and claims of the vault.
KNOWN = rf"""{PARSED}, titled AS (SELECT *, coalesce(ftitle, heading, stem) AS title,
  list_filter(list_transform(regexp_extract_all(regexp_replace(prose, '!\[\[([^\]]*)\]\]', '', 'g'), '\[\[([^\]|#]*)[^\]]*\]\]', 1), lambda x: trim(x)), lambda x: x <> '') AS links,
  list_filter(list_transform(string_split(regexp_extract(front, 'tags: \[([^\]]*)\]', 1), ','), lambda x: trim(x)), lambda x: x <> '') || regexp_extract_all(prose, '(^|[ \n\t(])#([\p{{L}}\p{{N}}_-]+)', 2) AS tags FROM heads),
{_sentences_sql('vault', 'sents')},
judged AS (SELECT s.*, title, {_Q} AS question, {_any('low', NEGATIONS)} AS negated, {_CASE} AS ctype, list_filter(links, lambda x: contains(low, lower(x)))[1] AS link,
  CASE {' '.join(f"WHEN {_any('low', w)} THEN '{n}'" for n, _, w in RELATIONS)} END AS relation, CASE {' '.join(f"WHEN {_any('low', w)} THEN '{t}'" for _, t, w in RELATIONS)} END AS rtype FROM sents s JOIN titled t ON t.path = s.path),
claims AS (SELECT path, "offset", title AS subject, 'asks' AS predicate, CASE WHEN strlen(sentence) > 300 THEN left(sentence, 300) || '…' ELSE sentence END AS object, 'QUESTION' AS claim_type, 1 AS polarity, 0.9::DOUBLE AS confidence FROM judged WHERE question
UNION ALL SELECT path, "offset", title, relation, link, rtype, 1, 0.7::DOUBLE FROM judged WHERE NOT question AND NOT negated AND relation IS NOT NULL AND link IS NOT NULL
UNION ALL SELECT path, "offset", CASE WHEN {_starts('low', FIRST_PERSON)} THEN 'user' ELSE title END, {_PRED}, CASE WHEN strlen(sentence) > 300 THEN left(sentence, 300) || '…' ELSE sentence END, ctype, CASE WHEN negated THEN -1 ELSE 1 END, 0.8::DOUBLE FROM judged WHERE NOT question AND ctype IS NOT NULL),
rels AS (SELECT DISTINCT path, title AS source, relation, link AS target FROM judged WHERE NOT question AND NOT negated AND relation IS NOT NULL AND link IS NOT NULL),
cands AS (SELECT path, mtime, tags[i] AS name, 'TOPIC' AS kind, 0 AS k, i FROM (SELECT path, mtime, tags, unnest(range(1, len(tags) + 1)) AS i FROM titled)
UNION ALL SELECT path, mtime, links[i], 'CONCEPT', 1, i FROM (SELECT path, mtime, links, unnest(range(1, len(links) + 1)) AS i FROM titled)
UNION ALL SELECT path, mtime, title, 'DOCUMENT', 2, 1 FROM titled WHERE NOT list_contains(list_transform(tags || links, lambda x: lower(x)), lower(title))),
ents AS (SELECT lower(name) AS key, min_by(name, (path, k, i)) AS canonical_name, min_by(kind, (path, k, i)) AS type, min(mtime) AS first_seen, max(mtime) AS last_seen, count(DISTINCT path) AS source_count FROM cands GROUP BY 1),
names AS (SELECT key, min(path) AS resolved FROM (SELECT lower(regexp_replace(path, '\.md$', '')) AS key, path FROM titled UNION SELECT lower(title), path FROM titled) GROUP BY key),
linked AS (SELECT l.path, target, resolved FROM (SELECT path, unnest(links) AS target FROM titled) l LEFT JOIN names ON key = lower(target))"""

QUERIES = {"sentences": q_sentences, "claims": q_claims, "relationships": q_relationships, "entity_candidates": q_candidates, "entities": q_entities} | {f.__name__: f for f in (doc_claims, claim_groups, claim_subject, relationships_resolved, entity_mentions, link_resolution, reindex_idempotent)}
_DS = f"docs AS ({fx.DOC_NOTES}), {_sentences_sql('docs', 'ds')}"
ORACLE = {
    "sentences": f'WITH {_DS}, vault AS ({fx.VAULT}), {_sentences_sql("vault", "vs")} SELECT path, "offset", sentence FROM ds UNION ALL SELECT path, "offset", sentence FROM vs',
    "claims": f"WITH {KNOWN} SELECT * FROM claims",
    "relationships": f"WITH {KNOWN} SELECT * FROM rels",
    "entity_candidates": f"WITH {KNOWN} SELECT path, name, kind FROM cands",
    "entities": f"WITH {KNOWN} SELECT * FROM ents",
    "doc_claims": f"WITH {_DS}, t AS (SELECT low, CASE WHEN {_Q} THEN 'QUESTION' ELSE {_CASE} END AS claim_type FROM ds) SELECT claim_type, CASE WHEN claim_type <> 'QUESTION' AND {_any('low', NEGATIONS)} THEN -1 ELSE 1 END AS polarity, count(*) AS n FROM t WHERE claim_type IS NOT NULL GROUP BY ALL",
    "claim_groups": f"WITH {KNOWN} SELECT lower(subject) AS subject, claim_type, count(*) AS n, count(*) FILTER (polarity < 0) AS negative FROM claims GROUP BY 1, 2",
    "claim_subject": f"WITH {KNOWN} SELECT path, title AS subject FROM titled",
    "relationships_resolved": f"WITH {KNOWN}, ends AS (SELECT key, min(name) AS canonical_name FROM (SELECT lower(source) AS key, source AS name FROM rels UNION ALL SELECT lower(target), target FROM rels) GROUP BY key), every AS (SELECT key, canonical_name, type FROM ents UNION ALL SELECT key, canonical_name, 'CONCEPT' FROM ends WHERE key NOT IN (SELECT key FROM ents)) SELECT DISTINCT path, a.canonical_name AS source_name, relation, b.canonical_name AS target_name, b.type AS target_type FROM rels JOIN every a ON a.key = lower(source) JOIN every b ON b.key = lower(target)",
    "entity_mentions": f"WITH {KNOWN} SELECT DISTINCT lower(name) AS key, path FROM cands",
    "link_resolution": f"WITH {KNOWN} SELECT * FROM linked",
    "reindex_idempotent": f"WITH {KNOWN} SELECT claim_type, count(*) AS n, count(DISTINCT (path, \"offset\", predicate)) AS ids FROM claims GROUP BY 1",
}
