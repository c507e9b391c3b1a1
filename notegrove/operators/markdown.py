"""Markdown projections: one row of a note to fields or to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..plans import fixtures as fx

VAULT = f"vault AS ({fx.VAULT})"
DOCS = f"docs AS ({fx.DOC_NOTES})"
#: The taken-apart notes, for checks: path, content, front, body, prose.
PARSED = rf"""{VAULT}, cut AS (SELECT path, content, mtime, regexp_extract(content, '{md.FRONT}', 0) AS f0, regexp_extract(content, '{md.FRONT}', 1) AS front FROM vault),
bodies AS (SELECT *, substr(content, length(f0) + 1) AS body FROM cut),
notes AS (SELECT *, regexp_replace(body, '{md.FENCE}', chr(10), 'g') AS prose FROM bodies),
heads AS (SELECT *, nullif(trim(regexp_replace(regexp_extract(prose, '(?:^|\n)[ \t]*(#[^\n]*)', 1), '^#+', '')), '') AS heading,
  nullif(trim(regexp_extract(front, '(?:^|\n)[ \t]*title[ \t]*:[ \t]*([^\n]*)', 1)), '') AS ftitle,
  regexp_replace(split_part(path, '/', -1), '(\.md|\.markdown)$', '') AS stem FROM notes)"""


def _vault(spark, d):
    return fx.vault(spark, d)


def split_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _vault(spark, d).select("path", md.front_matter(c).alias("front"), md.body_offset(c).alias("body_offset"))


def frontmatter_fields(spark, d):
    n = _vault(spark, d).withColumn("front", md.front_matter(F.col("content")))
    f = F.col("front")
    return n.select("path", md.unquote(md.front_value(f, "title")).alias("title"), F.array_join(md.front_tags(f), ",").alias("tags"), md.excluded(f).alias("excluded"))


def tag_list(spark, d):
    value = F.concat(F.lit('["'), F.col("p_brand"), F.lit("\", 'x y' ,, "), F.col("p_type"), F.lit(","), F.col("p_brand"), F.lit("]"))
    return fx.table(spark, d, "part").select("p_partkey", F.array_join(md.tag_list(value), "|").alias("items"))


def is_list_item(spark, d):
    lines = fx.sql(spark, d, "SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN '- ' || p_name WHEN 1 THEN p_size || '. ' || p_name WHEN 2 THEN '* ' WHEN 3 THEN p_size || ') x' WHEN 4 THEN '-' || p_name ELSE '+ ' || p_name END AS line FROM part")
    return lines.select("k", md.is_list_item(F.col("line")).alias("item"))


def block_id(spark, d):
    t = fx.sql(spark, d, "SELECT p_partkey AS k, p_name || CASE p_partkey % 3 WHEN 0 THEN ' ^b-' || p_partkey WHEN 1 THEN ' ^b- x' ELSE ' ^Z_9' || chr(10) END AS t FROM part")
    return t.select("k", md.block_id(F.col("t")).alias("block_id"))


def _exploded(spark, d, items):
    return _vault(spark, d).withColumn("prose", md.prose(F.col("content"))).select("path", F.posexplode(items(F.col("prose"))).alias("ord", "item")).select("path", "item")


def wikilinks(spark, d):
    return _exploded(spark, d, md.wikilinks)


def inline_tags(spark, d):
    return _exploded(spark, d, md.inline_tags)


def embeds(spark, d):
    t = fx.sql(spark, d, "SELECT s_suppkey AS k, 'a ![[Pic ' || s_suppkey || '|w]] b ![[Doc#x]] [[Link]] ![[Doc]]' AS t FROM supplier")
    return t.select("k", F.array_join(md.embeds(F.col("t")), "|").alias("items"), F.array_join(md.wikilinks(F.col("t")), "|").alias("links"))


def md_links(spark, d):
    t = fx.sql(spark, d, "SELECT s_suppkey AS k, 'see [' || s_name || '](https://x.org/' || s_suppkey || ') or [b](y) [c]() [[w]](z) [d](y)' AS t FROM supplier")
    return t.select("k", F.array_join(md.md_links(F.col("t")), "|").alias("items"))


def page_links(spark, d):
    """The link graph of pages."""
    p = fx.table(spark, d, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


def inline_block_ids(spark, d):
    t = fx.sql(spark, d, "SELECT s_suppkey AS k, 'a ^id' || s_suppkey || ' b' || chr(10) || '^two x^no' AS t FROM supplier")
    return t.select("k", F.array_join(F.array_distinct(F.regexp_extract_all("t", F.lit(md.INLINE_BLOCK_ID), F.lit(1))), "|").alias("items"))


def note_title(spark, d):
    return _vault(spark, d).select("path", md.title(F.col("content"), F.col("path")).alias("title"))


def all_tags(spark, d):
    return _vault(spark, d).select("path", F.array_join(F.array_sort(md.all_tags(F.col("content"))), ",").alias("tags"))


def headings(spark, d):
    """Level (6 at most) and text of each heading line outside of code."""
    lines = _vault(spark, d).select("path", F.posexplode(F.split(md.prose(F.col("content")), "\n")).alias("ord", "line")).where("trim(line) like '#%'")
    line = F.trim("line")
    return lines.select("path", F.least(F.length(F.regexp_extract(line, "^(#+)", 1)), F.lit(6)).cast("long").alias("level"), F.trim(F.regexp_replace(line, "^#+", "")).alias("text"))


def note_metadata(spark, d):
    """Title, number of links, and an excerpt of the first three lines of prose (200 characters at most)."""
    n = md.parsed(_vault(spark, d))
    lines = F.filter(F.transform(F.split("prose", "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return n.select("path", "title", F.size("links").cast("long").alias("n_links"), F.left(F.array_join(F.slice(lines, 1, 3), " "), F.lit(200)).alias("excerpt"))


def token_estimate(spark, d):
    return fx.doc_notes(spark, d).select("path", md.token_estimate(F.col("content")).alias("tokens"))


def truncate_300(spark, d):
    return fx.doc_notes(spark, d).select("path", md.cut(F.col("content")).alias("cut"))


def clean_content(spark, d):
    return _vault(spark, d).select("path", md.clean(F.col("content")).alias("cleaned"))


def normalize_path(spark, d):
    t = fx.sql(spark, d, "SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN '/a' || chr(92) || 'b' || s_suppkey WHEN 1 THEN '//x/y.md' ELSE 'c' || chr(92) || chr(92) || 'd' END AS p FROM supplier")
    return t.select("k", F.regexp_replace(F.translate("p", "\\", "/"), "^/+", "").alias("path"))


def line_runs(spark, d):
    """Runs of consecutive lines of one kind (list, quote, blank, text), numbered within a note."""
    from pyspark.sql import Window as W

    lines = _vault(spark, d).select("path", F.posexplode(F.split("content", "\n")).alias("ord", "line"))
    s = F.trim("line")
    kind = F.when(s == "", "blank").when(s.startswith(">"), "quote").when(md.is_list_item(s), "list").when(s.startswith("#"), "heading").otherwise("text")
    w = W.partitionBy("path").orderBy("ord")
    lines = lines.withColumn("kind", kind).withColumn("new", (F.col("kind") != F.lag("kind", 1, "").over(w)).cast("int"))
    runs = lines.withColumn("run", F.sum("new").over(w))
    return runs.groupBy("path", "run").agg(F.first("kind").alias("kind"), F.count("*").alias("n_lines"))


def fence_state(spark, d):
    """Lines of each note inside and outside of fenced code."""
    from pyspark.sql import Window as W

    lines = _vault(spark, d).select("path", F.posexplode(F.split("content", "\n")).alias("ord", "line"))
    fence = F.col("line").rlike("^(```|~~~)").cast("int")
    lines = lines.withColumn("fence", fence).withColumn("inside", F.sum("fence").over(W.partitionBy("path").orderBy("ord")) % 2)
    return lines.groupBy("path").agg(F.count_if((F.col("inside") == 1) & (F.col("fence") == 0)).alias("inside"), F.count_if(F.col("fence") == 1).alias("fences"), F.count("*").alias("n"))


def heading_path(spark, d):
    """The headings above each line, outermost first: of each level the last one, unless a higher heading came after it."""
    from pyspark.sql import Window as W

    t = fx.sql(spark, d, """SELECT s_suppkey AS k, '# A' || s_suppkey || chr(10) || 'x' || chr(10) || '## B' || chr(10) || 'y' || chr(10) || '### C' || chr(10) || 'z' || chr(10) || '## D' || chr(10) || 'u' || chr(10) || '# E' || chr(10) || 'v' AS t FROM supplier""")
    lines = t.select("k", F.posexplode(F.split("t", "\n")).alias("ord", "line"))
    w = W.partitionBy("k").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    level = F.length(F.regexp_extract("line", "^(#+) ", 1))
    lines = lines.withColumn("level", level)
    last = {i: F.last(F.when(F.col("level") == i, F.struct(F.col("ord"), F.regexp_replace("line", "^#+ *", "").alias("h"))), ignorenulls=True).over(w) for i in (1, 2, 3)}
    lines = lines.withColumns({f"h{i}": c for i, c in last.items()})
    shown = [F.when(F.expr(" and ".join([f"h{i} is not null", *(f"(h{j} is null or h{j}.ord < h{i}.ord)" for j in range(1, i))])), F.col(f"h{i}.h")) for i in (1, 2, 3)]
    return lines.where("level = 0").select("k", F.col("ord").cast("long").alias("ord"), F.concat_ws(" > ", *shown).alias("heading_path"))


_LINES = "lines AS (SELECT path, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS ord, string_split(content, chr(10)) AS l FROM vault)"
QUERIES = {f.__name__: f for f in (split_frontmatter, frontmatter_fields, tag_list, is_list_item, block_id, wikilinks, inline_tags, embeds, md_links, page_links, inline_block_ids, note_title, all_tags, headings, note_metadata, token_estimate, truncate_300, clean_content, line_runs, fence_state, heading_path)}
QUERIES["fn_normalize_path"] = normalize_path
ORACLE = {
    "split_frontmatter": f"WITH {PARSED} SELECT path, front, CAST(strlen(f0) AS BIGINT) AS body_offset FROM notes",
    "frontmatter_fields": rf"""WITH {PARSED}, v AS (SELECT path, coalesce(ftitle, '') AS title, trim(regexp_extract(front, '(?:^|\n)[ \t]*tags[ \t]*:[ \t]*([^\n]*)', 1)) AS tv, front FROM heads)
SELECT path, title, array_to_string(list_filter(list_transform(string_split(regexp_replace(tv, '^\[(.*)\]$', '\1'), ','), lambda x: trim(x)), lambda x: x <> ''), ',') AS tags, regexp_matches(front, '(?:^|\n)[ \t]*excluded?[ \t]*:[ \t]*true[ \t]*(\n|\z)') AS excluded FROM v""",
    "tag_list": "SELECT p_partkey, p_brand || '|x y|' || p_type AS items FROM part",
    "is_list_item": r"SELECT k, regexp_matches(line, '^([-*+] .*\S|[0-9]+[.)] )') AS item FROM (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN '- ' || p_name WHEN 1 THEN p_size || '. ' || p_name WHEN 2 THEN '* ' WHEN 3 THEN p_size || ') x' WHEN 4 THEN '-' || p_name ELSE '+ ' || p_name END AS line FROM part)",
    "block_id": "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'b-' || p_partkey WHEN 1 THEN '' ELSE 'Z_9' END AS block_id FROM part",
    "wikilinks": rf"""WITH {PARSED}, x AS (SELECT path, unnest(regexp_extract_all(regexp_replace(prose, '!\[\[([^\]]*)\]\]', '', 'g'), '\[\[([^\]|#]*)[^\]]*\]\]', 1)) AS item FROM notes) SELECT DISTINCT path, trim(item) AS item FROM x WHERE trim(item) <> ''""",
    "inline_tags": rf"""WITH {PARSED}, x AS (SELECT path, unnest(regexp_extract_all(prose, '(^|[ \n\t(])#([\p{{L}}\p{{N}}_-]+)', 2)) AS item FROM notes) SELECT DISTINCT path, item FROM x WHERE NOT regexp_matches(item, '^[0-9]')""",
    "embeds": "SELECT s_suppkey AS k, 'Pic ' || s_suppkey || '|Doc' AS items, 'Link' AS links FROM supplier",
    "md_links": "SELECT s_suppkey AS k, 'https://x.org/' || s_suppkey || '|y' AS items FROM supplier",
    "page_links": """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) GROUP BY ALL""",
    "inline_block_ids": "SELECT s_suppkey AS k, 'id' || s_suppkey || '|two' AS items FROM supplier",
    "note_title": f"WITH {PARSED} SELECT path, coalesce(ftitle, heading, stem) AS title FROM heads",
    "all_tags": rf"""WITH {PARSED}, t AS (SELECT path, unnest(string_split(regexp_extract(front, 'tags: \[([^\]]*)\]', 1), ',')) AS tag FROM notes
UNION ALL SELECT path, unnest(regexp_extract_all(prose, '(^|[ \n\t(])#([\p{{L}}\p{{N}}_-]+)', 2)) FROM notes),
u AS (SELECT DISTINCT path, trim(tag) AS tag FROM t WHERE trim(tag) <> '')
SELECT v.path, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags FROM vault v LEFT JOIN u ON u.path = v.path GROUP BY v.path""",
    "headings": rf"""WITH {PARSED}, l AS (SELECT path, trim(unnest(string_split(prose, chr(10)))) AS line FROM notes)
SELECT path, CAST(least(length(regexp_extract(line, '^(#+)', 1)), 6) AS BIGINT) AS level, trim(regexp_replace(line, '^#+', '')) AS text FROM l WHERE line LIKE '#%'""",
    "note_metadata": rf"""WITH {PARSED}, k AS (SELECT DISTINCT path, trim(unnest(regexp_extract_all(prose, '\[\[([^\]|#]*)[^\]]*\]\]', 1))) AS item FROM notes), c AS (SELECT path, count(*) AS n FROM k GROUP BY path)
SELECT h.path, coalesce(ftitle, heading, stem) AS title, coalesce(n, 0) AS n_links, left(array_to_string((list_filter(list_transform(string_split(prose, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x NOT LIKE '#%'))[1:3], ' '), 200) AS excerpt FROM heads h LEFT JOIN c ON c.path = h.path""",
    "token_estimate": rf"""WITH {DOCS} SELECT path, CAST(coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> ''), lambda w: greatest(strlen(w) // 5, 1) + CASE WHEN regexp_matches(w, '^[\p{{L}}\p{{N}}]') THEN 0 ELSE 1 END)), 0) AS BIGINT) AS tokens FROM docs""",
    "truncate_300": f"WITH {DOCS} SELECT path, CASE WHEN strlen(trim(content)) > 300 THEN left(trim(content), 300) || '…' ELSE trim(content) END AS cut FROM docs",
    "clean_content": rf"""WITH {VAULT} SELECT path, trim(regexp_replace(content, '\[\[(?:[^\]|#]*\|)?([^\]|#]*)(?:#[^\]]*)?\]\]', '\1', 'g')) AS cleaned FROM vault""",
    "fn_normalize_path": "SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'a/b' || s_suppkey WHEN 1 THEN 'x/y.md' ELSE 'c//d' END AS path FROM supplier",
    "line_runs": rf"""WITH {VAULT}, {_LINES}, k AS (SELECT path, ord, CASE WHEN trim(l[ord]) = '' THEN 'blank' WHEN trim(l[ord]) LIKE '>%' THEN 'quote' WHEN regexp_matches(trim(l[ord]), '^([-*+] .*\S|[0-9]+[.)] )') THEN 'list' WHEN trim(l[ord]) LIKE '#%' THEN 'heading' ELSE 'text' END AS kind FROM lines),
n AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY path ORDER BY ord) THEN 1 ELSE 0 END AS new FROM k), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY path ORDER BY ord) AS BIGINT) AS run FROM n)
SELECT path, run, min(kind) AS kind, count(*) AS n_lines FROM r GROUP BY path, run""",
    "fence_state": rf"""WITH {VAULT}, {_LINES}, f AS (SELECT path, ord, CASE WHEN regexp_matches(l[ord], '^(```|~~~)') THEN 1 ELSE 0 END AS fence FROM lines), s AS (SELECT *, sum(fence) OVER (PARTITION BY path ORDER BY ord) % 2 AS ins FROM f)
SELECT path, count(*) FILTER (ins = 1 AND fence = 0) AS inside, count(*) FILTER (fence = 1) AS fences, count(*) AS n FROM s GROUP BY path""",
    "heading_path": """SELECT s_suppkey AS k, CAST(o AS BIGINT) AS ord, CASE o WHEN 1 THEN 'A' || s_suppkey WHEN 3 THEN 'A' || s_suppkey || ' > B' WHEN 5 THEN 'A' || s_suppkey || ' > B > C' WHEN 7 THEN 'A' || s_suppkey || ' > D' ELSE 'E' END AS heading_path FROM supplier, (SELECT unnest([1, 3, 5, 7, 9]) AS o)""",
}
