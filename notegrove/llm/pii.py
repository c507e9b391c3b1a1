"""Personal data: overlapping candidates from high-recall generators, chosen by gradient-boosted trees.

Everything that touches rows is a DataFrame expression of the JVM.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import beside, table, text_of, without

KINDS = ("email", "ip", "card", "phone", "secret")
# The base patterns. Runs are possessive and begin where a run begins or the last match ended, which leaves the matches as they are
# and the time linear: inside a run whose start fails, every other start fails too.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "contains(_t, '@')", "ip": "_digits", "card": "_digits", "phone": "contains(_t, '+')"}
# The generators propose more, in this order where their spans overlap: addresses with written-out signs, four numbers with written-out
# points, runs of letters and digits, and any row of digits with up to two signs between them.
GENERATORS = {
    "mail": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    "quad": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|[(\[](?:\.|dot)[)\]])[0-9]{1,3}+){3}(?![0-9]|\.[0-9])",
    "token": r"(?<![A-Za-z0-9_+/-])(?:(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])|(?=[A-Z]{16}))[A-Za-z0-9_+/-]{10,}+",
    "digits": r"[+(]{0,2}+[0-9](?:[\x20().-]{0,2}+[0-9])++",
}
GENERATOR_NEEDS = {"mail": "(contains(_t, '@') OR contains(_t, '(at)') OR contains(_t, '[at]'))", "quad": "_digits", "token": "(_digits OR _t rlike '[A-Z]{16}')", "digits": "_digits"}
SOURCE = {"email": "mail", "ip": "quad", "card": "digits", "phone": "digits", "secret": "token"}
PLAIN = {"mail": r"regexp_replace(regexp_replace(x.m, '\\x20?[(\\[]at[)\\]]\\x20?', '@'), '\\x20?[(\\[]dot[)\\]]\\x20?', '.')", "quad": r"regexp_replace(x.m, '[(\\[](\\.|dot)[)\\]]', '.')"}
SPAN = "struct<start:bigint,end:bigint,m:string,b:string>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(a: str, value: str, op: str, zero: str = "0L") -> str:
    """SQL of an array: for each element x of the array named ``a``, ``op`` (of s and v) over ``value`` of all elements before it.

    Folds append to an array, which copies it, so they run over blocks of about the square root of the length.
    """
    step = lambda s, v: op.replace("$s", s).replace("$v", v)
    none = "cast(array() as array<bigint>)"
    fold = lambda start: f"aggregate(_k, named_struct('at', {start}, 'out', {none}), (s, x) -> named_struct('at', {step('s.at', value)}, 'out', concat(s.out, array(s.at))), s -> s.out)"
    total = f"aggregate(_k, {zero}, (z, x) -> {step('z', value)})"
    carries = f"aggregate(_blocks, named_struct('at', {zero}, 'out', {none}), (r, _k) -> named_struct('at', {step('r.at', total)}, 'out', concat(r.out, array(r.at))), r -> r.out)"
    body = _let("_carries", carries, f"flatten(transform(_blocks, (_k, _j) -> {fold('_carries[_j]')}))")
    blocks = _let("_n", f"cast(ceil(sqrt(size({a}) + 1)) as int)", f"transform(sequence(0, cast((size({a}) - 1) div _n as int)), _i -> slice({a}, _i * _n + 1, _n))")
    return _let("_blocks", blocks, body)


def _spans(pattern: str, needs: str) -> Column:
    """start, end (code points), match, and what stands just before, of each match in ``_t``.

    Matches and the text between them alternate, so the places are sums of lengths.
    """
    p = _quoted(pattern)
    pairs = "transform(_ms, (m, i) -> named_struct('g', length(_gaps[i]), 'n', length(m), 'm', m, 'b', right(_gaps[i], 16)))"
    at = _running("_pairs", "x.g + x.n", "$s + $v")
    out = _let("_pairs", pairs, _let("_at", at, "transform(_pairs, (x, i) -> named_struct('start', _at[i] + x.g, 'end', _at[i] + x.g + x.n, 'm', x.m, 'b', x.b))"))
    found = _let("_ms", f"regexp_extract_all(_t, {p}, 0)", f"if(size(_ms) = 0, cast(array() as array<{SPAN}>), {_let('_gaps', f'split(_t, {p}, -1)', out)})")
    return F.expr(f"CASE WHEN {needs} THEN {found} ELSE cast(array() as array<{SPAN}>) END")


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_PART = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_LUHN = f"""aggregate(transform(split(reverse({_DIGITS}), ''), (d, i) -> CASE WHEN i % 2 = 0 THEN cast(d as int) WHEN cast(d as int) > 4 THEN 2 * cast(d as int) - 9 ELSE 2 * cast(d as int) END), 0, (s, d) -> s + coalesce(d, 0)) % 10 = 0"""
HOLDS = {
    "email": "true",
    "ip": f"x.m rlike '^{_PART}([.]{_PART}){{3}}$'",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}

# Features of a candidate, each with few values, so that their combinations are bounded (see MOST_COUNTS). None tells what the base
# checks ask for (the plus, the at sign, the check digit): trees judge candidates by what variants have in common with base spans.
_N = f"length({_DIGITS})"
FEATURES = {
    "n": (f"CASE WHEN {_N} < 9 THEN 0 WHEN {_N} < 12 THEN 1 WHEN {_N} < 16 THEN 2 WHEN {_N} = 16 THEN 3 WHEN {_N} < 20 THEN 4 ELSE 5 END", 6),
    "sep": ("CASE WHEN NOT x.m rlike '[^0-9+]' THEN 0 WHEN x.m rlike '[A-Za-z]' THEN 5 WHEN NOT x.m rlike '[^0-9+ ]' THEN 1 WHEN NOT x.m rlike '[^0-9+-]' THEN 2 WHEN NOT x.m rlike '[^0-9+.]' THEN 3 ELSE 4 END", 6),
    "before": ("CASE WHEN x.b = '' THEN 0 WHEN x.b rlike '[=:]\\\\s*[\"\\']?$' THEN 4 WHEN x.b rlike '\\\\s$' THEN 1 WHEN x.b rlike '[0-9]$' THEN 3 WHEN x.b rlike '\\\\p{L}$' THEN 2 ELSE 5 END", 6),
    "cue": ("CASE WHEN lower(x.b) rlike 'card|visa|credit' THEN 1 WHEN lower(x.b) rlike 'phone|tel|call|fax|mobil' THEN 2 WHEN lower(x.b) rlike 'mail|contact' THEN 3 WHEN lower(x.b) rlike '(^|[^a-z])(ip|addr|host|server)' THEN 4 WHEN lower(x.b) rlike '(^|[^a-z])(v|ver|version|no|id|isbn|order)[^a-z]*$' THEN 5 ELSE 0 END", 6),
    "shape": ("CASE WHEN x.m rlike '^[0-9]{4}([ -]?)[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}$' THEN 1 WHEN x.m rlike '^[+(]{0,2}[0-9]{0,3}[ )-]{0,2}[(]?[0-9]{2,4}[)]?[ .-]+[0-9]{3}[ .-]?[0-9]{3,4}$' THEN 2 WHEN x.m rlike '[.)\\\\]] ?[a-zA-Z]{2,}$' THEN 3 WHEN x.m rlike '^[0-9]{2,4}[.-][0-9]{1,2}[.-][0-9]{1,4}$' THEN 4 WHEN x.m rlike '^[0-9a-f]+$' THEN 5 WHEN x.m rlike '^[0-9A-Z]+$' THEN 6 WHEN x.m rlike '^[0-9a-zA-Z]+$' THEN 7 ELSE 0 END", 8),
    "long": ("CASE WHEN length(x.m) < 16 THEN 0 WHEN length(x.m) < 24 THEN 1 WHEN length(x.m) < 40 THEN 2 WHEN length(x.m) < 100 THEN 3 ELSE 4 END", 5),
    "runs": ("least(3, size(regexp_extract_all(x.m, '[0-9]+', 0)))", 4),
}
POSSIBLE = {"email": "true", "ip": f"regexp_replace(x.m, '[^0-9]+', '.') rlike '^{_PART}([.]{_PART}){{3}}$'", "card": f"{_N} BETWEEN 12 AND 19", "phone": f"{_N} BETWEEN 7 AND 15", "secret": "true"}

_SECRET_CUE = "(key|token|secret|passw[a-z]*|pwd|auth[a-z]*|credentials?)"
# What a candidate is for learning: 1, 0, or null where nothing is known of it. Base spans are positive, and runs of letters and digits that are assigned to a word such
# as `token`, or bear a known prefix; candidates without any word that hints at their kind are negative; the others are left out.
LABELS = {k: f"CASE WHEN known THEN 1 WHEN cue = {cue} THEN null ELSE 0 END" for k, cue in (("card", 1), ("phone", 2), ("email", 3), ("ip", 4))}
LABELS["secret"] = f"CASE WHEN lower(x.b) rlike '{_SECRET_CUE}[\"\\']?\\\\s*[=:]\\\\s*[\"\\']?$' OR x.m rlike '^AKIA[0-9A-Z]{{16}}$' THEN 1 WHEN lower(x.b) rlike '{_SECRET_CUE}' THEN null ELSE 0 END"
NO_CANDIDATES = "cast(array() as array<struct<start:bigint,end:bigint," + "kind:int,y:int," + ",".join(f"{f}:int" for f in FEATURES) + ">>)"


def _base(df: DataFrame, text_col: str) -> DataFrame:
    """Adds _t, _digits and the checked base spans _base_<kind>."""
    out = df.withColumn("_t", text_of(text_col)).withColumn("_digits", F.expr("_t rlike '[0-9]'"))
    out = out.withColumns({f"_base_{k}": _spans(BASE[k], NEEDS[k]) for k in BASE})
    return out.withColumns({f"_base_{k}": F.expr(f"filter(_base_{k}, x -> {HOLDS[k]})") for k in BASE})


def _candidates(df: DataFrame) -> DataFrame:
    """Adds _cand_<kind>: the generators' spans that may be of the kind, with features and label; one span may stand there for several kinds."""
    out = df.withColumns({f"_gen_{g}": _spans(GENERATORS[g], GENERATOR_NEEDS[g]) for g in GENERATORS})
    values = ", ".join(f"'{f}', {sql}" for f, (sql, _) in FEATURES.items())
    for i, k in enumerate(KINDS):
        gen = f"_gen_{SOURCE[k]}"
        if k in BASE:
            # both lists are sorted and free of overlaps: an equal base span sorts just before its candidate
            merged = "array_sort(concat(transform(_b, x -> struct(x.start, x.end, 0)), transform(_g, x -> struct(x.start, x.end, 1))))"
            flags = "filter(transform(_m, (x, i) -> if(x.col3 = 0, null, i > 0 AND element_at(_m, if(i > 0, i, 1)).col3 = 0 AND element_at(_m, if(i > 0, i, 1)).start = x.start AND element_at(_m, if(i > 0, i, 1)).end = x.end)), f -> f is not null)"
            label = LABELS[k].replace("known", "_known[i]").replace("cue", f"({FEATURES['cue'][0]})")
        else:
            merged, flags, label = "array(0)", "array(false)", LABELS[k]
        made = f"transform(_g, (x, i) -> if({POSSIBLE[k]}, named_struct('start', x.start, 'end', x.end, 'kind', {i}, 'y', {label}, {values}), null))"
        made = _let("_known", flags, f"filter({made}, c -> c is not null)")
        if SOURCE[k] in PLAIN:  # features see written-out signs as what they stand for
            gen = f"transform({gen}, x -> named_struct('start', x.start, 'end', x.end, 'm', {PLAIN[SOURCE[k]]}, 'b', x.b))"
        sql = _let("_g", gen, f"if(size(_g) = 0, {NO_CANDIDATES}, {_let('_b', f'_base_{k}' if k in BASE else 'array(0)', _let('_m', merged, made))})")
        out = out.withColumn(f"_cand_{k}", F.expr(sql))
    return out


class Trees:
    """Of each kind, boosted trees of depth 2 over the features as sums of CASE expressions, a bias and a threshold."""

    def __init__(self, trees: list[list], bias: list[float], thresholds: list[float]):
        self.trees, self.bias, self.thresholds = trees, bias, thresholds

    def sql(self, kind: int) -> str:
        """SQL of how far candidate c lies over the threshold."""
        test = lambda t: f"c.{t[0]} = {t[1]}"
        leaf = lambda t: f"CASE WHEN {test(t[0])} THEN {t[1]!r}D ELSE {t[2]!r}D END"
        return " + ".join([f"{self.bias[kind] - self.thresholds[kind]!r}D", *(f"CASE WHEN {test(t[0])} THEN {leaf(t[1])} ELSE {leaf(t[2])} END" for t in self.trees[kind])])

    def value(self, kind: int, row: dict) -> float:
        z = self.bias[kind]
        for t in self.trees[kind]:
            node = t[1] if row[t[0][0]] == t[0][1] else t[2]
            z += node[1] if row[node[0][0]] == node[0][1] else node[2]
        return z


def _fit(rows: list[dict], rounds: int, rate: float) -> tuple[list, float]:
    """Trees and bias fitted to ``rows`` of feature values with ``pos`` and ``neg`` numbers of candidates."""
    pos, neg = (np.asarray([float(r[k]) for r in rows]) for k in ("pos", "neg"))
    bias = math.log((pos.sum() + 1) / (neg.sum() + 1))
    tests = sorted({(f, r[f]) for r in rows for f in FEATURES}, key=lambda t: (list(FEATURES).index(t[0]), t[1]))
    if not tests or not pos.sum() or not neg.sum():
        return [], bias
    inside = np.asarray([[r[f] == v for r in rows] for f, v in tests])
    z, trees = np.full(len(rows), bias), []

    def best(of: np.ndarray, g: np.ndarray, h: np.ndarray):
        g, h = g * of, h * of
        ga, ha, gt, ht = inside @ g, inside @ h, g.sum(), h.sum()
        k = int(np.argmax(np.round(ga * ga / (ha + 1) + (gt - ga) ** 2 / (ht - ha + 1), 9)))
        return k, (tests[k], float(-ga[k] / (ha[k] + 1) * rate), float(-(gt - ga[k]) / (ht - ha[k] + 1) * rate))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g, h = p * (pos + neg) - pos, p * (1 - p) * (pos + neg)
        k, (root, _, _) = best(np.ones(len(rows)), g, h)
        (i, yes), (j, no) = best(inside[k] * 1.0, g, h), best(~inside[k] * 1.0, g, h)
        trees.append((root, yes, no))
        z = z + np.where(inside[k], np.where(inside[i], yes[1], yes[2]), np.where(inside[j], no[1], no[2]))
    return trees, bias


def _background(kind: int, weight: float, rows: int = 2400) -> list[dict]:
    """Rows spread evenly over all combinations of feature values: what nothing was ever seen of counts as negative."""
    state, out = kind * 7919 + 17, []
    for i in range(rows):
        r = {"kind": kind, "fold": i % 3, "pos": 0.0, "neg": weight / rows}
        for f, (_, n) in FEATURES.items():
            state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
            r[f] = (state >> 33) % n
        out.append(r)
    return out


def boosted(counts: list[dict], rounds: int = 40, rate: float = 0.4, precision: float = 0.95) -> Trees:
    """Trees of each kind fitted to ``counts``: rows of kind, fold (0 to 2), feature values, and ``pos`` and ``neg`` numbers of candidates.

    Negatives are those seen and a background over all combinations of values, half as many as positives, so a combination passes only if it is like
    those that positives have. The threshold of a kind is the least score whose calibrated probability is ``precision`` or more: each fold
    is scored by trees of the other two, and the share of positives (one more negative added) is made monotone by pooling. Where no score gets there, nothing is selected.
    """
    all_trees, biases, thresholds = [], [], []
    for kind in range(len(KINDS)):
        seen = [r for r in counts if r["kind"] == kind]
        rows = seen + _background(kind, max(20.0, 0.5 * sum(r["pos"] for r in seen)))
        trees, bias = _fit(rows, rounds, rate)
        scores = []
        for fold in range(3):
            part = Trees([_fit([r for r in rows if r["fold"] != fold], rounds, rate)[0]], [0.0], [0.0]), _fit([r for r in rows if r["fold"] != fold], 0, rate)[1]
            scores += [(part[1] + part[0].value(0, r), r["pos"], r["neg"]) for r in rows if r["fold"] == fold]
        pools: list[list[float]] = []  # least score, positives, all; scores fall, shares of positives too
        for x, p, n in sorted(scores, reverse=True):
            if pools and pools[-1][0] - x < 1e-9:
                pools[-1] = [x, pools[-1][1] + p, pools[-1][2] + p + n]
            else:
                pools.append([x, p, p + n])
            while len(pools) > 1 and pools[-1][1] * pools[-2][2] >= pools[-2][1] * pools[-1][2]:
                low = pools.pop()
                pools[-1] = [low[0], pools[-1][1] + low[1], pools[-1][2] + low[2]]
        good, p, n = math.inf, 0.0, 1.0
        for x, a, b in pools:
            p, n = p + a, n + b
            if a >= precision * b and p >= precision * n:
                good = x - 1e-9
        all_trees.append(trees)
        biases.append(bias)
        thresholds.append(good)
    return Trees(all_trees, biases, thresholds)


def trained(docs: DataFrame, text_col: str = "text") -> Trees:
    """Trees learnt from all candidates of ``docs`` (see LABELS).

    Candidates are counted by kind, fold and features, and only these counts come to the driver: at most one for each
    combination of values, whatever the input. Equal texts are in the same fold.
    """
    df = docs.select(F.col(text_col).cast("string").alias("_text")).where(F.expr("_text rlike '[0-9]|[A-Z]{16}' OR contains(_text, '@') OR contains(_text, '(at)') OR contains(_text, '[at]')"))
    cand = _candidates(_base(df, "_text")).withColumn("_fold", F.pmod(F.xxhash64("_t"), F.lit(3)).cast("int"))
    cand = cand.select("_fold", F.explode(F.concat(*[F.col(f"_cand_{k}") for k in KINDS])).alias("c")).where("c.y is not null")
    names = ["kind", *FEATURES]
    got = cand.groupBy(F.col("_fold").alias("fold"), *[F.col(f"c.{n}") for n in names]).agg(F.count_if(F.expr("c.y = 1")).alias("pos"), F.count_if(F.expr("c.y = 0")).alias("neg")).collect()
    return boosted(sorted((r.asDict() for r in got), key=lambda r: [r[n] for n in ("fold", *names)]))


_FREE_NONE = "cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"


def _free(cands: str, chosen: str) -> str:
    """SQL of those spans of the array ``cands`` that overlap none of the array ``chosen``."""
    merged = f"array_sort(concat(transform({chosen}, x -> named_struct('start', x.start, 'o', 0, 'kind', x.kind, 'end', x.end)), transform({cands}, x -> named_struct('start', x.start, 'o', 1, 'kind', x.kind, 'end', x.end))))"
    before = _running("_m", "if(x.o = 0, x.end, 0L)", "greatest($s, $v)")
    after = _let("_r", "reverse(_m)", _running("_r", "if(x.o = 0, x.start, 9223372036854775807L)", "least($s, $v)", "9223372036854775807L"))
    keep = "transform(filter(transform(_m, (x, i) -> struct(x, x.o = 1 AND _p[i] <= x.start AND _q[size(_m) - 1 - i] >= x.end)), y -> y.col2), y -> named_struct('start', y.x.start, 'kind', y.x.kind, 'end', y.x.end))"
    return _let("_m", merged, _let("_p", before, _let("_q", after, keep)))


def pii_spans(docs: DataFrame, text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind, end) by start, then kind (0 email, 1 ip, 2 card, 3 phone, 4 secret).

    Places are code points, ends exclusive. ``base`` has the checked matches of the base patterns; ``spans`` has these and the candidates
    that the trees select, unless they overlap a base span or a span of an earlier generator. A span that is selected for several kinds has the kind that it is furthest over the
    threshold of. Null and empty texts have none; equal texts have equal spans. Columns of the input named ``base`` or ``spans`` are replaced.
    """
    docs = without(docs, ["base", "spans"])
    model = model or trained(docs, text_col)
    out = _candidates(_base(docs, text_col))
    base = ", ".join(f"transform(_base_{k}, x -> named_struct('start', x.start, 'kind', {i}, 'end', x.end))" for i, k in enumerate(BASE))
    out = out.withColumn("base", F.expr(f"array_sort(concat({base}))")).withColumn("spans", F.col("base"))
    for g in GENERATORS:
        kinds = [i for i, k in enumerate(KINDS) if SOURCE[k] == g and model.thresholds[i] != math.inf]
        if not kinds:
            continue
        over = [f"transform(_cand_{KINDS[i]}, c -> named_struct('start', c.start, 'over', {model.sql(i)}, 'kind', {i}, 'end', c.end))" for i in kinds]
        # of equal spans the last in the order of start, margin and kind
        best = _let("_o", f"array_sort(filter(concat({', '.join(over)}), c -> c.over >= 0))", "filter(_o, (c, i) -> i + 1 = size(_o) OR element_at(_o, least(i + 2, size(_o))).start > c.start)")
        sql = _let("_c", best, _let("_s", "spans", f"if(size(_c) = 0, _s, array_sort(concat(_s, {_free('_c', '_s')})))"))
        out = out.withColumn("spans", F.expr(sql))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "base", "spans")


def listed(column: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = "CASE x.kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    return F.expr(f"array_join(transform({column}, x -> concat({names}, ':', x.start, ':', x.end)), ',')")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of ``pii_spans`` replaced by its kind in brackets, and ``n_chars`` (if any) counted anew.

    Spans that overlap become one, named after the first. Texts without spans, null ones too, stay as they are; so do all other columns, whatever their names.
    """
    tag = "CASE x.kind " + " ".join(f"WHEN {i} THEN '[{k.upper()}]'" for i, k in enumerate(KINDS)) + " END"
    # a span that starts where or after all earlier ones end brings the text since then and its tag
    ends = _running("_s", "x.end", "greatest($s, $v)")
    groups = "filter(transform(_s, (x, i) -> named_struct('from', _e[i], 'to', x.start, 'tag', " + tag + ")), y -> y.from <= y.to)"
    # places are counted from the start of a string, so texts are cut into blocks of about the square root of the spans first
    block = _let("_part", "substring(_x, cast(_k[0].from + 1 as int), cast(element_at(_k, -1).to - _k[0].from as int))", "array_join(transform(_k, y -> concat(substring(_part, cast(y.from - _k[0].from + 1 as int), cast(y.to - y.from as int)), y.tag)), '')")
    blocks = _let("_n", "cast(ceil(sqrt(size(_y))) as int)", f"array_join(transform(sequence(0, cast((size(_y) - 1) div _n as int)), _i -> {_let('_k', 'slice(_y, _i * _n + 1, _n)', block)}), '')")
    tail = "substring(_x, cast(array_max(transform(_s, x -> x.end)) + 1 as int), 2147483647)"

    def run(df: DataFrame) -> DataFrame:
        text = f"concat({_let('_e', ends, _let('_y', groups, blocks))}, {tail})"
        text = _let("_s", "spans", _let("_x", f"`{text_col}`", f"if(size(_s) = 0, _x, {text})"))
        return pii_spans(df, text_col).withColumn(text_col, F.expr(text)).drop("base", "spans")

    return beside(docs, [text_col], run, text_col)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = {f"n_{k}": F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)") for i, k in enumerate(BASE)}
    return found.select("doc_id", *[c.alias(x) for x, c in n.items()], F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


#: The most rows that ``trained`` brings to the driver.
MOST_COUNTS = 3 * len(KINDS) * math.prod(n for _, n in FEATURES.values())
