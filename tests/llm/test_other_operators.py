import hashlib
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import cases  # noqa: E402

from notegrove.llm import components, embeddings, html_text, media, sharding  # noqa: E402

# --- components


def test_components(spark):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3), (7, None), (1, 2), (2, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings


def brute(rows, t=0.95):
    ok = [(i, np.asarray(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(ok))}
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= t:
                links[a].add(b)
                links[b].add(a)
    return ok, links


@pytest.mark.parametrize("tile", [1536, 8])
def test_near_vectors(spark, tile, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    rows = [(i, (base[i % 30] + (0.05 + 0.02 * (i % 9)) * rng.normal(size=16)).tolist()) for i in range(200)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, [None] + [1.0] * 15), (304, [float("inf")] + [1.0] * 15), (305, []), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, rows[0][1]), (309, rows[0][1]), (310, [3.0]), (311, [-3.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, kept string")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    ok, links = brute(rows)
    want = sum(len(x) for x in links.values())
    have = 0
    for k, (i, _) in enumerate(ok):
        assert got[i].n_links <= len(links[k])
        have += got[i].n_links
    assert have >= 0.98 * want and len(got) == len(rows)
    for i in (300, 301, 302, 303, 304, 305):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[307].component_id == 306 and got[309].n_links == got[308].n_links >= 2 and got[311].component_id == 311
    assert embeddings.near_vectors(df.where("vec_id < 0")).count() == 0


def test_planted_pairs_through_the_filters(spark):
    """More vectors than are all compared, a third of them close to one: links just over the threshold are found, none under it."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(1500, 32)))
    x[1000:] = unit(x[0] + 0.03 * rng.normal(size=(500, 32)))
    for k in range(0, 300, 2):
        away = rng.normal(size=32)
        away = unit(away - (away @ x[k + 1]) * x[k + 1])
        x[k + 2] = x[k + 2] if k % 4 else 0.952 * x[k + 1] + np.sqrt(1 - 0.952**2) * away
    assert embeddings.parameters(len(x), 32)[0] > 1
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    want = ((x @ x.T) >= 0.95).sum(axis=1) - 1
    assert all(got[i].n_links <= w for i, w in enumerate(want)) and sum(r.n_links for r in got.values()) >= 0.99 * want.sum() and (want[:300] > 0).sum() > 100


@pytest.mark.parametrize("n", [10_000, 100_000, 1_000_000, 10_000_000])
def test_recall_holds_at_every_size(n):
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = rng.normal(size=(400, 64))
    x[:100, :32] *= 0.3
    x = unit(x)
    away = rng.normal(size=x.shape)
    away = unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * away
    code = embeddings.Code(64, *embeddings.parameters(n, 64))
    # some pairs have most of their length in one block
    back = code.turn.T
    one, two = code.decode(x @ back), code.decode(y @ back)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(one, two)]) >= 0.99


def test_few_dimensions_keep_all_pairs():
    for dim in (1, 2, 3, 6, 16):
        size, most = embeddings.parameters(100_000, dim)
        assert embeddings.recall(dim, size, most, 0.95) >= embeddings.RECALL


def test_repeated_and_null_ids(spark):
    v = [1.0, 0.5, 0.25, 0.1]
    df = spark.createDataFrame([(1, v), (1, v), (None, v), (2, [-x for x in v])], "vec_id long, embedding array<double>")
    got = embeddings.near_vectors(df).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id) for r in got) == [(-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- x --><div class="ad">Buy now</div>
<article><h1>Head &amp; line</h1><p><b>First   part.<br><p>Second <i>one</i>&nbsp;here</p><aside>Side</aside><ul><li>x</li><li>y</li></ul>
<blockquote>q</blockquote><form><input>Name</form><p>Last &copy;</p><section class="comments"><p>A reader writes</p></section></article>
<div id="cookie-notice">We use cookies</div><footer>foot</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\nFirst part.\nSecond one here\nx\ny\nq\nLast ©"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("<body><nav>menu</nav><p>Plain one</p><div>two</div><footer>f</footer>") == "Plain one\ntwo"
    assert html_text.main_text("<article><p>a</p><nav>never closed <p>b</p></article>") == "a\nnever closed\nb"
    assert html_text.main_text("just text & more") == "just text & more"
    assert html_text.main_text("<div class='article-body'>t</div>") == "t"


LONGER = "This is a paragraph of the article and it goes on for some while, as paragraphs do in articles about things. "
DIVS = f"""<html><body><div><div>Home</div><div>About us</div><div>News</div><div>Contact</div></div>
<div><div>A title</div><div>{LONGER * 3}</div><div>{LONGER * 2}</div><div>Short one.</div><div>{LONGER * 4}</div></div>
<div><div>Nice!</div><div>Thanks for this.</div></div><div><div>Copyright 2020</div><div>Privacy</div></div></body></html>"""


def test_windows_decide_where_names_say_nothing():
    want = ["A title", (LONGER * 3).strip(), (LONGER * 2).strip(), "Short one.", (LONGER * 4).strip()]
    assert html_text.main_text(DIVS).split("\n") == want
    # windows of one line find no short line; wide ones bridge the gap to the menu
    assert html_text.main_text(DIVS, window=1).split("\n") == [x for x in want if x != "A title"]
    assert html_text.main_text(DIVS, window=6).split("\n")[:5] == ["Home", "About us", "News", "Contact", "A title"]
    # the level decides what is a surge
    assert "Thanks" not in html_text.main_text(DIVS) and "Thanks" in html_text.main_text(DIVS, surge=0.001)


def test_names_weigh_only_where_they_tell():
    body = f"<p>{LONGER}</p>" * 3
    for name in ("related-work", "search-results", "modal-verbs", "post-header"):
        assert "Inside" in html_text.main_text(f"<article>{body}<div class='{name}'>Inside it</div>{body}</article>"), name
    for name in ("comments", "reader-comments", "ad", "site-header", "cookie-notice", "newsletterSignup", "x sidebar"):
        assert "Inside" not in html_text.main_text(f"<article>{body}<div class='{name}'>Inside it</div>{body}</article>"), name
    assert "Buy" not in html_text.main_text(f"<article>{body}<p class='ad'>Buy now<p>{LONGER}</article>")
    assert html_text.main_text(f"<body><div class='page has-sidebar'>{body}</div></body>").count("\n") == 2
    assert "link only" in html_text.main_text(f"<article>{body}<p><a href=x>a link only</a></p></article>")


@pytest.mark.parametrize("piece", ["<b ", "<b '", '<b "', "<", "<div>", "<p><span class=ad>", "<!--", "<script>", "</div>", "<li><ul>", "<a href='", "<b x=\"'>", "&amp", "<div class=ad><p>x"])
def test_malformed_pages_take_linear_time(piece):
    import time

    page, began = "some text " + piece * (1_000_000 // len(piece)), time.time()
    assert isinstance(html_text.main_text(page), str) and isinstance(media.sequence(page), list)
    assert time.time() - began < 15


def test_pages_of_the_table(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in html_text.op8_html_extraction(spark, "/root/testdata/sf0.01").collect():
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "<p>" + "w " * 50_000, "x"), (None, "v", "<b>t", "x")], "page_id long, url string, html string, text string")
    got = html_text.extracted(df)
    assert got.columns == ["page_id", "url", "html", "text"] and sorted(len(r.text) for r in got.collect()) == [0, 0, 1, 99_999]
    assert html_text.extracted(df.where("page_id = 9")).count() == 0


# --- media


def plain_feature(data):
    """The feature of a payload by plain loops."""
    rows = [list(data[k : k + 24]) for k in range(0, len(data), 24)]
    ys, xs = [k * len(rows) // 8 for k in range(9)], [k * 24 // 9 for k in range(10)]
    cell = [[(lambda v: sum(v) / len(v))([rows[y][x] for y in range(ys[i], ys[i + 1]) for x in range(xs[j], xs[j + 1])]) for j in range(9)] for i in range(8)]
    bits = "".join("1" if cell[i][j + 1] > cell[i][j] else "0" for i in range(8) for j in range(8))
    n, s, q = len(data), sum(data), sum(v * v for v in data)
    return f"24x{len(rows)}:{s / n:.6f}:{(n * q - s * s) / (n * n):.4f}:{int(bits, 2):016x}"


def test_media_round_trip(spark, tmp_path):
    cases.documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    found = media.op6_media(spark, str(tmp_path)).collect()
    assert len(found) == len(cases.ROWS)
    want = []
    for i, t, *_ in cases.ROWS:
        p = (t or "").encode() + b"\xff" * (576 - len((t or "").encode()) % 576 if len((t or "").encode()) % 576 or not t else 0)
        image = b"P5\n24 %d\n255\n" % (len(p) // 24) + p
        blocks = [" ".join(b.split()) for b in (t or "").split("\n")]
        half = (len(blocks) + 1) // 2
        above = 1 + sum(1 for b in blocks[:half] if b)  # heading and paragraphs
        want.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(image), hashlib.sha256(image).hexdigest(), plain_feature(p), above + 1, f"text {hashlib.sha256(image).hexdigest()[:12]}", 3 + sum(1 for b in blocks if b), 1 + sum(1 for b in blocks if b)))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_items_stay_aligned(spark):
    """Text, badge and payload come back in the page's order, with the caption at the payload, and payloads by digest."""
    docs = spark.createDataFrame([(1, "one & <b>\ntwo\nthree", "en"), (2, "four", "en"), (3, "four", None)], "doc_id long, text string, lang string")
    pages = media.illustrated(docs)
    store = media.images(docs.select("text").union(spark.createDataFrame([("lang:en",), ("lang:",)], "text string")))
    got = media.resolved(media.sequences(pages, ["doc_id"]), media.described(store), ["doc_id"]).orderBy("doc_id", "position").collect()
    one = [(r.kind, r.text, r.caption, r.payload_sha256) for r in got if r.doc_id == 1]
    sha = lambda t: hashlib.sha256(media.payload(t)).hexdigest()
    assert one == [("text", "Document 1", None, None), ("media", None, None, sha("lang:en")), ("text", "one & <b>", None, None), ("text", "two", None, None), ("media", None, "text " + hashlib.sha256(media.as_image(media.payload("one & <b>\ntwo\nthree"))).hexdigest()[:12], sha("one & <b>\ntwo\nthree")), ("text", "three", None, None)]
    assert [r.payload_sha256 for r in got if r.doc_id == 3 and r.kind == "media"] == [sha("lang:"), sha("four")]
    assert media.illustrated(cases.documents(spark, [])).count() == 0


def test_sequences():
    page = '<p>One <b>two</b></p><figure><img src="sha256:aa"><figcaption>Cap &amp; x</figcaption></figure><p>three</p><IMG SRC=other.png>tail'
    got = [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in media.sequence(page)]
    assert got == [(0, "text", "One two", None, None), (1, "media", None, "aa", "Cap & x"), (2, "text", "three", None, None), (3, "media", None, "other.png", None), (4, "text", "tail", None, None)]
    assert media.sequence(None) == media.sequence("") == []


def test_unknown_digests_keep_their_place(spark):
    pages = spark.createDataFrame([(1, '<img src="sha256:zz">x')], "doc_id long, html string")
    known = spark.createDataFrame([("aa", 1)], "digest string, media_bytes long")
    got = media.resolved(media.sequences(pages, ["doc_id"]), known, ["doc_id"]).orderBy("position").collect()
    assert [(r.position, r.kind, r.media_bytes) for r in got] == [(0, "media", None), (1, "text", None)]


# --- shards


def test_store(spark, tmp_path):
    docs = cases.documents(spark).repartition(4)
    store = sharding.sharded(docs, arrivals=4, root=f"file://{tmp_path}/a")
    rows = store.read()
    assert rows.count() == len(cases.ROWS) and len({(r.shard, r.shard_bytes) for r in rows.select("shard", "shard_bytes").collect()}) == len(store.shards()) == 1
    key = lambda r: str(tuple(r))
    assert sorted(map(key, rows.select(*docs.columns).collect())) == sorted(map(key, docs.collect()))
    assert store.version() >= 5


def test_clashing_columns_and_groups(spark, tmp_path):
    docs = cases.clashing(spark)
    for old, new in (("score", "_arrival"), ("fp", "_path"), ("ids", "_group"), ("base", "shard")):
        docs = docs.withColumnRenamed(old, new)
    rows = sharding.sharded(docs.repartition(5), arrivals=2, root=f"file://{tmp_path}/e").read()
    assert rows.count() == len(cases.ROWS) and set(docs.columns) <= set(rows.columns) and rows.where("_path = 'x' and _group = 'x' and _arrival = 'x'").count() == len(cases.ROWS)
    # every group of a merge is one file, however the groups' numbers hash
    store = sharding.Store(spark, f"file://{tmp_path}/f")
    for k in range(24):
        store.append(spark.range(50 * k, 50 * k + 50).selectExpr("id as doc_id", "sha2(cast(id as string), 256) as text", "0 as a").coalesce(1), "a")
    size = max(s.bytes for s in store.shards())
    store.compact(target=4 * size, fan_in=4, base=1, most_names=12)
    assert store.read().count() == 24 * 50 and all(s.bytes <= 4.5 * size for s in store.shards()) and len(store.shards()) <= 8


def test_tiers_and_versions(spark, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/b")
    assert store.version() == 0 and store.shards() == []
    for k in range(5):
        store.append(spark.range(100 * k, 100 * k + 50).selectExpr("id as doc_id", "cast(id as string) as text", "0 as a").coalesce(1), "a")
    before = store.version()
    assert before == 5 and len(store.shards()) == 5 and len(store.plan(128 << 20)) == 1
    small = sum(s.bytes for s in store.shards()[:2]) + 1
    assert [len(g) for g in store.plan(small)] in ([2, 2], [])
    store.compact()
    assert len(store.shards()) == 1 and store.read(before).count() == store.read().count() == 250
    assert store.vacuum() == 5 and store.read().count() == 250


def test_compaction_goes_on_until_no_tier_is_full(spark, tmp_path):
    """Four small runs and three larger ones: what the four make is the fourth of the next tier."""
    store = sharding.Store(spark, f"file://{tmp_path}/g")
    for k, n in enumerate([400, 400, 400, 400, 1600, 1600, 1600]):
        store.append(spark.range(10_000 * k, 10_000 * k + n).selectExpr("id as doc_id", "sha2(cast(id as string), 256) as text", "0 as a").coalesce(1), "a")
    small = int(0.8 * min(s.bytes for s in store.shards()))
    assert [len(g) for g in store.plan(1 << 30, 4, small)] == [4]
    store.compact(1 << 30, 4, small)
    assert store.plan(1 << 30, 4, small) == [] and len(store.shards()) == 1 and store.read().count() == 6400


def test_commits_don_t_overwrite(spark, tmp_path):
    a, b = (sharding.Store(spark, f"file://{tmp_path}/c") for _ in range(2))
    first = a.commit([("data/x/y/part-1", 1)])
    stale = b.version
    b.version = lambda seen=[first - 1]: seen.pop() if seen else stale()  # the first look is out of date
    assert b.commit([("data/x/y/part-2", 1)]) == first + 1
    assert [s.path for s in a.shards()] == ["data/x/y/part-1", "data/x/y/part-2"]
    gone = a.shards()[0]
    a.commit([], [gone])
    with pytest.raises(sharding.Conflict):
        b.commit([], [gone])


def test_empty_store(spark, tmp_path):
    store = sharding.sharded(cases.documents(spark, []), root=f"file://{tmp_path}/d")
    got = store.read(schema=cases.documents(spark, []).schema)
    assert got.count() == 0 and got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "shard_bytes"]


def test_article_text_is_not_lost_to_names():
    """An article's own header stays, and names that hold other words than those of menus and adverts tell nothing."""
    words = " ".join(f"word{k}" for k in range(40))
    page = f"""<body><header><p>Site name</p></header><nav>Menu</nav><article><header><h1>The headline</h1></header><p class="share-price">Prices: {words}</p>
<div class="banner-history">Banners: {words}</div><p id="comment-on-law">Law: {words}</p><p>Last: {words}</p>
<div class="ad-slot">Buy</div><div class="share-buttons-2">Tell</div><header class="nav-header">Top</header><div class="commentList">Said</div></article><footer>Imprint</footer></body>"""
    got = html_text.main_text(page).split("\n")
    assert [x.split()[0] for x in got] == ["The", "Prices:", "Banners:", "Law:", "Last:"]
