"""Column expressions over Markdown texts; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A front matter that ends at the first later line beginning with three dashes; group 1 is what stands between.
FRONT = r"(?s)\A---[^\n]*\n(|.*?\n)---[^\n]*(?:\n|\z)"
#: Fenced code with the line break before it, up to its closing fence or the end.
FENCE = r"(?s)(?:\A|\n)[ \t]*(?:```[^\n]*(?:\n.*?)??(?:\n[ \t]*```[^\n]*|\z)|~~~[^\n]*(?:\n.*?)??(?:\n[ \t]*~~~[^\n]*|\z))"
EMBED = r"!\[\[([^\]]*)\]\]"
LINK = r"\[\[([^\]|#]*)[^\]]*\]\]"
MD_LINK = r"\[[^\]]*\]\(([^)]+)\)"
TAG = r"(^|[ \n\t(])#([\p{L}\p{N}_-]+)"
BLOCK_ID = r"(?:^|\s)\^([A-Za-z0-9_-]+)\s*\z"
INLINE_BLOCK_ID = r"[ \n]\^([A-Za-z0-9_-]+)"
LIST_ITEM = r"^([-*+] .*\S|[0-9]+[.)] )"


def lit(pattern: str) -> Column:
    return F.lit(pattern)


def front_matter(content: Column) -> Column:
    """The lines between the fences of a front matter; empty if there is none or it does not end."""
    return F.regexp_extract(content, FRONT, 1)


def body(content: Column) -> Column:
    """What follows the front matter."""
    return F.substr(content, F.length(F.regexp_extract(content, FRONT, 0)) + 1)


def body_offset(content: Column) -> Column:
    """Where the body begins, in bytes."""
    return F.octet_length(F.regexp_extract(content, FRONT, 0)).cast("long")


def prose(content: Column) -> Column:
    """The body without fenced code."""
    return F.regexp_replace(body(content), FENCE, "\n")


def unquote(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, '^"+|"+$', ""), "^'+|'+$", "")


def front_value(front: Column, key: str) -> Column:
    """The trimmed value of ``key: value``, empty if there is none."""
    return F.trim(F.regexp_extract(front, rf"(?:^|\n)[ \t]*{key}[ \t]*:[ \t]*([^\n]*)", 1))


def tag_list(value: Column) -> Column:
    """Items of ``[a, b]`` or ``a, b``: trimmed, without quotes or blanks, in order, each once."""
    bare = F.regexp_replace(value, r"^\[(.*)\]$", "$1")
    return F.array_distinct(F.filter(F.transform(F.split(bare, ","), lambda t: unquote(F.trim(t))), lambda t: t != ""))


def front_tags(front: Column) -> Column:
    inline = front_value(front, "tags")
    items = F.regexp_extract_all(F.regexp_extract(front, r"(?:^|\n)[ \t]*tags[ \t]*:[ \t]*\n((?:[ \t]*- [^\n]*(?:\n|$))*)", 1), lit(r"- ([^\n]*)"), F.lit(1))
    listed = F.array_distinct(F.filter(F.transform(items, lambda t: unquote(F.trim(t))), lambda t: t != ""))
    return F.when(inline != "", tag_list(inline)).otherwise(listed)


def excluded(front: Column) -> Column:
    return (front_value(front, "exclude") == "true") | (front_value(front, "excluded") == "true")


def _distinct(items: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(items, lambda t: F.trim(t)), lambda t: t != ""))


def wikilinks(text: Column) -> Column:
    """Targets of ``[[target#section|alias]]``, embeds left out, in order, each once."""
    return _distinct(F.regexp_extract_all(F.regexp_replace(text, EMBED, ""), lit(LINK), F.lit(1)))


def embeds(text: Column) -> Column:
    return _distinct(F.transform(F.regexp_extract_all(text, lit(EMBED), F.lit(1)), lambda t: F.regexp_extract(t, r"^([^|#]*)", 1)))


def md_links(text: Column) -> Column:
    """Targets of ``[text](target)``, in order, each once."""
    return _distinct(F.regexp_extract_all(text, lit(MD_LINK), F.lit(1)))


def inline_tags(text: Column) -> Column:
    """``#tag`` after a blank, a line break or an opening parenthesis, not beginning with a digit; in order, each once."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, lit(TAG), F.lit(2)), lambda t: ~t.rlike("^[0-9]")))


def block_id(text: Column) -> Column:
    """``^id`` as the last word of a block; empty if there is none."""
    return F.regexp_extract(text, BLOCK_ID, 1)


def is_list_item(line: Column) -> Column:
    return line.rlike(LIST_ITEM)


def first_heading(text: Column) -> Column:
    """Text of the first line that begins with ``#``, without the marks; null if there is none."""
    line = F.regexp_extract(text, r"(?:^|\n)[ \t]*(#[^\n]*)", 1)
    return F.when(line != "", F.trim(F.regexp_replace(line, "^#+", "")))


def stem(path: Column) -> Column:
    """The file name without ``.md`` or ``.markdown``."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.md|\.markdown)$", "")


def title(content: Column, path: Column) -> Column:
    """Front matter title, else first heading, else file name."""
    return F.coalesce(F.nullif(unquote(front_value(front_matter(content), "title")), F.lit("")), F.nullif(first_heading(prose(content)), F.lit("")), stem(path))


def all_tags(content: Column) -> Column:
    return F.array_distinct(F.concat(front_tags(front_matter(content)), inline_tags(prose(content))))


def token_estimate(text: Column) -> Column:
    """For each word the fifth of its bytes, at least 1, and 1 more if it begins with neither letter nor digit; summed."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    cost = lambda w: F.greatest(F.floor(F.octet_length(w) / 5), F.lit(1)) + F.when(w.rlike(r"^[\p{L}\p{N}]"), 0).otherwise(1)
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + cost(w))


def cut(text: Column, most: int = 300) -> Column:
    """The trimmed text, cut to ``most`` characters and an ellipsis if it has more bytes than that."""
    t = F.trim(text)
    return F.when(F.octet_length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("…"))).otherwise(t)


def clean(text: Column) -> Column:
    """Wiki links replaced by what they show; unclosed ones stay."""
    shown = F.regexp_replace(text, r"\[\[([^\]#|]*\|)?([^\]#|]*)(?:#[^\]]*)?\]\]", "$2")
    return F.trim(F.regexp_replace(shown, r"\[\[[^\]]*\|([^\]|#]*)(?:#[^\]]*)?\]\]", "$1"))


def parsed(notes: DataFrame) -> DataFrame:
    """``notes`` (path, content, ...) with front, prose, title, tags, links: each note is taken apart once."""
    n = notes.withColumns({"front": front_matter(F.col("content")), "prose": prose(F.col("content"))})
    heading = first_heading(F.col("prose"))
    return n.withColumns(
        {
            "heading": heading,
            "title": F.coalesce(F.nullif(unquote(front_value(F.col("front"), "title")), F.lit("")), F.nullif(heading, F.lit("")), stem(F.col("path"))),
            "tags": F.array_distinct(F.concat(front_tags(F.col("front")), inline_tags(F.col("prose")))),
            "links": wikilinks(F.col("prose")),
        }
    )
