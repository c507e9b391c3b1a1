"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .embeddings import op10_embedding_near_dedup
from .html_text import op8_html_extraction
from .media import op6_media
from .neighbours import op12_nearest_neighbours
from .packing import op7_best_fit_packing
from .phrases import op13_phrases
from .pii import op5_pii
from .sentencepieces import op1_sentencepiece
from .sharding import op3_sharding
from .simhash import op2_simhash
from .substring import op9_substring_dedup
from .toxicity import op4_toxicity
from .variants import op11_spelling_variants

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_media": op6_media,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_html_extraction": op8_html_extraction,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_phrases": op13_phrases,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op11_spelling_variants": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS m, hex(encode(doc_id || ':' || run)) AS x FROM r GROUP BY doc_id, run),
h AS (SELECT run, m, xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM d, crc),
o AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, m FROM h),
w AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM o WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
p AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM p),
near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word FROM less a JOIN w ON w.word = a.rest UNION SELECT w.word, a.word FROM less a JOIN w ON w.word = a.rest),
best AS (SELECT near.word, count(*) AS n_near, min((-w.n, w.word)) AS b FROM near JOIN w ON w.word = near.other GROUP BY near.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * w.n THEN -b[1] END AS form_n FROM w LEFT JOIN best USING (word)),
go AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT go.word, f.form, k + 1 FROM go JOIN f ON f.word = go.root WHERE f.form IS NOT NULL),
last AS (SELECT word, max_by(root, k) AS root FROM go GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN last USING (word)""",
    "op13_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
places AS (SELECT lang, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS t(n)),
f AS (SELECT lang, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g, count(*) AS f FROM places GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE n = 1 GROUP BY lang),
c AS (SELECT lang, n, g, f AS a, string_split(g, ' ') AS w FROM f WHERE n > 1 AND f >= 30),
cut AS (SELECT lang, g, a, w, unnest(range(1, n)) AS k FROM c),
scored AS (SELECT cut.lang, cut.g, a, k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.g = array_to_string(list_slice(w, 1, k), ' ') JOIN f y ON y.lang = cut.lang AND y.g = array_to_string(list_slice(w, k + 1, len(w)), ' ')),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
sub AS (SELECT lang, a, w, size, unnest(range(1, n - size + 2)) AS i FROM c, (VALUES (2), (3)) AS t(size) WHERE size < n),
inside AS (SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS g, max(a) AS longest FROM sub GROUP BY ALL),
kept AS (SELECT least.* FROM least LEFT JOIN inside USING (lang, g) WHERE longest IS NULL OR CAST(longest AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op10_embedding_near_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT r.a AS vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM r LEFT JOIN n ON n.a = r.a GROUP BY r.a""",
    "op9_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS s FROM d WHERE len(w) >= 20),
windows AS (SELECT doc_id, s, sha256(array_to_string(list_slice(w, s, s + 19), ' ')) AS h FROM starts),
marked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1 AS again FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM marked WHERE again),
lost AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, coalesce(len(g), 0) AS r,
  CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k
  FROM d LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept""",
}
