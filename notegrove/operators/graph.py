"""The graph of links and tags: nodes, edges, components and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..plans import fixtures as fx
from ..sources import files
from . import knowledge as kn
from .components import connected_components
from .folds import numbered
from .knowledge import KNOWN


def edges(notes: DataFrame, links: DataFrame) -> DataFrame:
    """source, target, kind: each link and tag once, without loops; links lead to the note found or else to the target's name."""
    to = F.concat(F.lit("note:"), F.coalesce("resolved", "target"))
    e = links.select(F.concat(F.lit("note:"), "path").alias("source"), to.alias("target"), F.lit("link").alias("kind"))
    t = notes.select("path", F.explode("tags").alias("tag")).select(F.concat(F.lit("note:"), "path").alias("source"), F.concat(F.lit("tag:"), "tag").alias("target"), F.lit("tag").alias("kind"))
    return e.unionByName(t).where("source <> target").distinct()


def nodes(notes: DataFrame, links: DataFrame) -> DataFrame:
    """id, kind, label, unresolved: notes, targets that no note bears (hollow), tags. A note that exists is never hollow."""
    stem = lambda c: md.stem(F.col(c))
    a = notes.select(F.concat(F.lit("note:"), "path").alias("id"), F.lit("note").alias("kind"), stem("path").alias("label"), F.lit(False).alias("unresolved"))
    b = links.where("resolved is null").select(F.concat(F.lit("note:"), "target").alias("id"), F.lit("note").alias("kind"), stem("target").alias("label"), F.lit(True).alias("unresolved"))
    c = notes.select(F.explode("tags").alias("tag")).select(F.concat(F.lit("tag:"), "tag").alias("id"), F.lit("tag").alias("kind"), F.col("tag").alias("label"), F.lit(False).alias("unresolved"))
    return a.unionByName(b).unionByName(c).groupBy("id").agg(F.min("kind").alias("kind"), F.min("label").alias("label"), F.bool_and("unresolved").alias("unresolved"))


def degrees(n: DataFrame, e: DataFrame) -> DataFrame:
    """id, degree: both directions, links each way count twice."""
    ends = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))
    return n.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def components(n: DataFrame, e: DataFrame) -> DataFrame:
    """id, component: the smallest id that edges reach, itself included."""
    found = connected_components(e.select(F.col("source").alias("a"), F.col("target").alias("b"))).withColumnRenamed("node", "id")
    return n.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def clusters(n: DataFrame, e: DataFrame) -> DataFrame:
    """id, size, hub, hub_degree, label, label_source of each component: from three members on the smallest tag that two notes bear, else the hub's label; else the number of notes."""
    full = n.join(components(n, e), "id").join(degrees(n, e), "id")
    g = full.groupBy("component").agg(
        F.count("*").alias("size"),
        F.min(F.struct((-F.col("degree")).alias("d"), F.col("id"), F.col("label"))).alias("hub"),
        F.min(F.when((F.col("kind") == "tag") & (F.col("degree") >= 2), F.col("label"))).alias("tag"),
    )
    source = F.when(F.col("size") < 3, "count").when(F.col("tag").isNotNull(), "tag").otherwise("hub")
    label = F.when(source == "tag", F.concat(F.lit("#"), "tag")).when(source == "hub", F.col("hub.label")).otherwise(F.concat(F.col("size").cast("string"), F.when(F.col("size") == 1, " note").otherwise(" notes")))
    return g.select(F.col("component").alias("id"), "size", F.col("hub.id").alias("hub"), (-F.col("hub.d")).alias("hub_degree"), label.alias("label"), source.alias("label_source"))


def _graph(spark, d, file_names: bool = False):
    """Nodes and edges of the vault. Notes are taken apart and links resolved (by ``file_names`` too, if so asked) once, and stored: both go into each of the two several times."""
    n = files.stored(md.parsed(fx.vault(spark, d)).select("path", "title", "tags", "links"))
    links = files.stored(kn.resolved_links(n, file_names))
    return nodes(n, links), edges(n, links)


def graph_nodes(spark, d):
    return _graph(spark, d)[0]


def graph_edges(spark, d):
    return _graph(spark, d)[1]


def graph_degree(spark, d):
    return degrees(*_graph(spark, d))


def graph_stats(spark, d):
    return _graph(spark, d)[0].agg(F.count_if((F.col("kind") == "note") & ~F.col("unresolved")).alias("notes"), F.count_if("unresolved").alias("unresolved"), F.count_if(F.col("kind") == "tag").alias("tags"))


def graph_components(spark, d):
    """Components by all links, those by file names included."""
    return components(*_graph(spark, d, True))


def q_clusters(spark, d):
    n, e = _graph(spark, d, True)
    return clusters(files.stored(n), files.stored(e))


def graph_neighbors(spark, d):
    e = _graph(spark, d)[1]
    at = "note:Suppliers/S7.md"
    return e.where(F.col("source") == at).select(F.col("target").alias("id")).unionByName(e.where(F.col("target") == at).select(F.col("source").alias("id"))).distinct()


def node_radius(spark, d):
    n, e = _graph(spark, d)
    r = F.when(F.col("kind") == "tag", 5.0).otherwise(6.5 * (1 + F.least(F.sqrt("degree") * 0.36, F.lit(2.1))))
    return n.join(degrees(n, e), "id").select("id", F.round(r, 6).alias("radius"))


def node_emphasis(spark, d):
    """Emphasis when one supplier is selected: full for it and its neighbours, else faint."""
    n, _ = _graph(spark, d)
    near = graph_neighbors(spark, d).withColumn("near", F.lit(True))
    return n.select("id").join(near, "id", "left").select("id", F.when((F.col("id") == "note:Suppliers/S7.md") | F.coalesce("near", F.lit(False)), 1.0).otherwise(0.12).alias("emphasis"))


def label_search(spark, d):
    return _graph(spark, d)[0].where(F.lower("label").contains("brand-1")).select("id")


def camera_fit(spark, d):
    """Centre and zoom that show all nodes laid out by their ids."""
    n = _graph(spark, d)[0].select((F.length("id") * 1.0).alias("x"), (F.length("label") * 2.0).alias("y"))
    b = n.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy"])
    zoom = F.least(800 / F.greatest(F.col("max_x") - F.col("min_x") + 80, F.lit(1.0)), 600 / F.greatest(F.col("max_y") - F.col("min_y") + 80, F.lit(1.0)))
    return b.select(((F.col("min_x") + F.col("max_x")) / 2).alias("cx"), ((F.col("min_y") + F.col("max_y")) / 2).alias("cy"), F.round(zoom, 6).alias("zoom"))


def graph_layout(spark, d):
    """Coordinates of each component's nodes: rings around its hub, in steps that depend on degree and id only."""
    n, e = _graph(spark, d)
    full = n.select("id").join(components(n, e), "id").join(degrees(n, e), "id")
    full = numbered(full, "component", [F.desc("degree"), F.col("id")], "k")
    k = F.col("k")
    ring = F.floor((-1 + F.sqrt(1 + 4.0 * k / 3)) / 2 + F.when(k > 0, 1).otherwise(0))
    angle = (k % 360) * 2.399963
    return full.withColumn("ring", ring).withColumn("angle", angle).select("id", F.round(40 * F.col("ring") * F.cos("angle"), 6).alias("x"), F.round(40 * F.col("ring") * F.sin("angle"), 6).alias("y"))


_G = KNOWN + """, gn AS (SELECT id, min(kind) AS kind, min(label) AS label, bool_and(unresolved) AS unresolved FROM (
SELECT 'note:' || path AS id, 'note' AS kind, stem AS label, false AS unresolved FROM titled UNION ALL
SELECT 'note:' || target, 'note', regexp_replace(split_part(target, '/', -1), '(\\.md|\\.markdown)$', ''), true FROM linked WHERE resolved IS NULL UNION ALL
SELECT 'tag:' || trim(tag), 'tag', trim(tag), false FROM (SELECT unnest(tags) AS tag FROM titled)) GROUP BY id),
ge AS (SELECT DISTINCT source, target, kind FROM (SELECT 'note:' || path AS source, 'note:' || coalesce(resolved, target) AS target, 'link' AS kind FROM linked UNION ALL SELECT 'note:' || path, 'tag:' || trim(tag), 'tag' FROM (SELECT path, unnest(tags) AS tag FROM titled)) WHERE source <> target),
gd AS (SELECT id, coalesce(n, 0) AS degree FROM gn LEFT JOIN (SELECT x, count(*) AS n FROM (SELECT source AS x FROM ge UNION ALL SELECT target FROM ge) GROUP BY 1) ON x = id)"""
# labels fall to the least of the neighbours' until none does
_B = "RECURSIVE " + _G + """, bothways AS (SELECT source AS u, target AS v FROM ge UNION SELECT target, source FROM ge),
cc(id, component) USING KEY (id) AS (SELECT id, id FROM gn UNION SELECT u, min(cc.component) FROM cc JOIN bothways ON v = cc.id JOIN recurring.cc AS old ON old.id = u WHERE cc.component < old.component GROUP BY u),
bn AS (SELECT gn.id, gn.label, gn.kind, cc.component, gd.degree FROM gn JOIN cc USING (id) JOIN gd USING (id))"""
# links that paths and titles leave open go by file names
_BF = _B.replace("LEFT JOIN names ON key = lower(target))", """LEFT JOIN (SELECT key, resolved FROM names UNION ALL SELECT key, min(path) FROM (SELECT path, unnest([lower(stem), lower(split_part(path, '/', -1)), lower(path)]) AS key FROM titled) f WHERE NOT EXISTS (SELECT 1 FROM names WHERE names.key = f.key) GROUP BY key) ON key = lower(target))""")
_NEAR = "SELECT target AS id FROM ge WHERE source = 'note:Suppliers/S7.md' UNION SELECT source FROM ge WHERE target = 'note:Suppliers/S7.md'"
QUERIES = {"clusters": q_clusters} | {f.__name__: f for f in (graph_nodes, graph_edges, graph_degree, graph_stats, graph_components, graph_neighbors, node_radius, node_emphasis, label_search, camera_fit, graph_layout)}
ORACLE = {
    "graph_nodes": f"WITH {_G} SELECT * FROM gn",
    "graph_edges": f"WITH {_G} SELECT * FROM ge",
    "graph_degree": f"WITH {_G} SELECT * FROM gd",
    "graph_stats": f"WITH {_G} SELECT count(*) FILTER (kind = 'note' AND NOT unresolved) AS notes, count(*) FILTER (unresolved) AS unresolved, count(*) FILTER (kind = 'tag') AS tags FROM gn",
    "graph_components": f"WITH {_BF} SELECT id, component FROM bn",
    "clusters": f"""WITH {_BF}, g AS (SELECT component AS id, count(*) AS size, min((-degree, id, label)) AS h, min(CASE WHEN kind = 'tag' AND degree >= 2 THEN label END) AS tag FROM bn GROUP BY 1)
SELECT id, size, h[2] AS hub, -h[1] AS hub_degree, CASE WHEN size < 3 THEN size || CASE WHEN size = 1 THEN ' note' ELSE ' notes' END WHEN tag IS NOT NULL THEN '#' || tag ELSE h[3] END AS label, CASE WHEN size < 3 THEN 'count' WHEN tag IS NOT NULL THEN 'tag' ELSE 'hub' END AS label_source FROM g""",
    "graph_layout": f"WITH {_B}, k AS (SELECT id, row_number() OVER (PARTITION BY component ORDER BY degree DESC, id) - 1 AS k FROM bn), r AS (SELECT id, floor((-1 + sqrt(1 + 4.0::DOUBLE * k / 3)) / 2 + CASE WHEN k > 0 THEN 1 ELSE 0 END) AS ring, (k % 360) * 2.399963::DOUBLE AS a FROM k) SELECT id, round(40 * ring * cos(a), 6) AS x, round(40 * ring * sin(a), 6) AS y FROM r",
    "graph_neighbors": f"WITH {_G} {_NEAR}",
    "node_radius": f"WITH {_G} SELECT gn.id, round(CASE WHEN kind = 'tag' THEN 5.0::DOUBLE ELSE 6.5::DOUBLE * (1 + least(sqrt(degree) * 0.36::DOUBLE, 2.1::DOUBLE)) END, 6) AS radius FROM gn JOIN gd USING (id)",
    "node_emphasis": f"WITH {_G} SELECT id, CASE WHEN id = 'note:Suppliers/S7.md' OR id IN ({_NEAR}) THEN 1.0::DOUBLE ELSE 0.12::DOUBLE END AS emphasis FROM gn",
    "label_search": f"WITH {_G} SELECT id FROM gn WHERE contains(lower(label), 'brand-1')",
    "camera_fit": f"WITH {_G}, b AS (SELECT min(length(id)) AS a, max(length(id)) AS c, 2 * min(length(label)) AS e, 2 * max(length(label)) AS f FROM gn) SELECT (a + c) / 2.0::DOUBLE AS cx, (e + f) / 2.0::DOUBLE AS cy, round(least(800::DOUBLE / (c - a + 80), 600::DOUBLE / (f - e + 80)), 6) AS zoom FROM b",
}
