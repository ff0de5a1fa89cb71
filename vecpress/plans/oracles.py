"""DuckDB SQL of the registered queries.

Written from the definitions, not from the Spark code: lists are folded in order of
dimension, ties go to the smaller id, training starts from the first rows by id and runs a
fixed number of steps. Models that SQL cannot derive (a random rotation, levels of the normal
distribution) are put in as constants: those queries check how a model is applied.
"""

from __future__ import annotations

from vecpress.operators import allocation, moments

DIMS = 64
HELD_OUT = 100
CELLS, PROBES = 8, 7

#: The cells of the measured runs: method, bits, and which rows they are measured on (a rerun of one cell on even ids).
RUNS = [*(("sq", b, 1) for b in (4, 8, 16)), *(("pq", b, 1) for b in (1, 2, 4, 8)), ("pq", 4, 2), *(("lvq", b, 1) for b in (1, 2, 4, 8))]
BANDS = [("32x", 24.0, 40.0), ("16x", 12.0, 20.0), ("8x", 6.0, 10.0), ("4x", 3.0, 5.0)]

#: Element terms of metrics that are a plain fold, p[1] and p[2] being the two entries.
_TERMS = {
    "l2": "(p[1] - p[2]) * (p[1] - p[2])",
    "ip": "p[1] * p[2]",
    "l1": "abs(p[1] - p[2])",
    "canberra": "CASE WHEN abs(p[1]) + abs(p[2]) = 0 THEN 0.0 ELSE abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) END",
    "add": "abs(p[1] + p[2])",
    "cube": "power(abs(p[1] - p[2]), 3.0)",
    "low": "least(abs(p[1]), abs(p[2]))",
    "high": "greatest(abs(p[1]), abs(p[2]))",
}


def fold(term: str, a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: {term}), lambda s, t: s + t)"


def _metric(name: str, a: str = "q.q", b: str = "x.v") -> str:
    f = lambda t: fold(_TERMS[t], a, b)
    if name == "linf":
        return f"list_max(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))"
    if name == "lp":
        return f"power({f('cube')}, 1.0 / 3)"
    if name == "braycurtis":
        return f"{f('l1')} / {f('add')}"
    if name == "jaccard":
        return f"1 - {f('low')} / {f('high')}"
    if name == "nan_euclidean":
        both = f"list_filter(list_zip({a}, {b}), lambda p: NOT isnan(p[1]) AND NOT isnan(p[2]))"
        return f"sqrt(list_reduce(list_transform({both}, lambda p: {_TERMS['l2']}), lambda s, t: s + t) * len({b}) / len({both}))"
    if name == "jensenshannon":  # of entries that are shares already
        part = lambda w: f"CASE WHEN {w} > 0 THEN {w} * ln({w} / ((p[1] + p[2]) / 2)) ELSE 0.0 END"
        return fold(f"(({part('p[1]')}) + ({part('p[2]')})) / 2", a, b)
    return f(name)


METRIC_TERMS = ("l1", "linf", "lp", "canberra", "braycurtis", "jensenshannon", "jaccard", "nan_euclidean")

X = "x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)"
SCALED = "x AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: e * (1 + vec_id % 7)) AS v FROM embeddings)"
HOLES = "x AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e, d: CASE WHEN (vec_id + d - 1) % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE e * (1 + vec_id % 7) END) AS v FROM embeddings)"
TAPERED = "x AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e, d: e * (CAST(4.0 AS DOUBLE) - CAST(3.8 AS DOUBLE) * (d - 1) / CAST(63.0 AS DOUBLE))) AS v FROM embeddings)"
Q = "q AS (SELECT vec_id AS qid, v AS q FROM x WHERE vec_id % 100 = 0)"
E = "e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM x)"
MEAN = "mu AS (SELECT list(m ORDER BY d) AS mu FROM (SELECT d, avg(x) AS m FROM e GROUP BY d))"
RANGE = "rg AS (SELECT list(a ORDER BY d) AS mn, list(b ORDER BY d) AS mx FROM (SELECT d, min(x) AS a, max(x) AS b FROM e GROUP BY d))"


def top(scores: str, k: int, order: str = "score", places: int | None = None) -> str:
    """Scores (qid, id, score) to the k best of each query."""
    shown = f"round(score, {places})" if places else "score"
    return f"""SELECT qid, CAST(rk AS INTEGER) AS rk, id, {shown} AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}, id) AS rk FROM ({scores})) WHERE rk <= {k}"""


def knn(source: str, metric: str, k: int, order: str = "score", places: int | None = None) -> str:
    if metric == "jensenshannon":
        source = source.replace("x AS (", "raw AS (", 1) + """, sized AS (SELECT *, list_reduce(list_transform(v, lambda e: abs(e)), lambda s, t: s + t) AS t FROM raw),
x AS (SELECT vec_id, list_transform(v, lambda e: abs(e) / t) AS v FROM sized)"""
    return f"WITH {source}, {Q} " + top(f"SELECT qid, vec_id AS id, {_metric(metric)} AS score FROM q, x", k, order, places)


# --- codecs ------------------------------------------------------------------------------


def sq_levels(bits: int) -> str:
    """CTE sq (vec_id, v, l, mn, mx): levels of each row."""
    top_level = 2**bits - 1
    return f"""{E}, {RANGE}, sq AS (SELECT vec_id, v, mn, mx,
  list_transform(list_zip(v, mn, mx), lambda p: greatest(0, least({top_level}, round_even((p[1] - p[2]) / (p[3] - p[2] + 1e-8) * {top_level}, 0)))) AS l FROM x, rg)"""


def sq_decoded(bits: int) -> str:
    """CTEs up to dec (vec_id, v, r)."""
    top_level = 2**bits - 1
    return f"{sq_levels(bits)}, dec AS (SELECT vec_id, v, list_transform(list_zip(l, mn, mx), lambda p: p[1] / {top_level} * (p[3] - p[2] + 1e-8) + p[2]) AS r FROM sq)"


def sq_encode(bits: int) -> str:
    if bits == 4:
        code = "array_to_string(list_transform(l, lambda c: printf('%X', CAST(c AS INTEGER))), '')"
    elif bits == 8:
        code = "array_to_string(list_transform(l, lambda c: printf('%02X', CAST(c AS INTEGER))), '')"
    else:
        code = "array_to_string(list_transform(l, lambda c: printf('%02X', CAST(c AS INTEGER) % 256) || printf('%02X', CAST(c AS INTEGER) // 256)), '')"
    return f"WITH {X}, {sq_levels(bits)} SELECT vec_id, {code} AS code FROM sq"


def lvq_levels(bits: int) -> str:
    """CTEs up to lv (vec_id, v, mu, low, step, l)."""
    top_level = 2**bits - 1
    return f"""{E}, {MEAN}, res AS (SELECT vec_id, v, mu, list_transform(list_zip(v, mu), lambda p: p[1] - p[2]) AS r FROM x, mu),
st AS (SELECT *, list_min(r) AS low, CASE WHEN list_max(r) = list_min(r) THEN 1.1754943508222875e-38 ELSE (list_max(r) - list_min(r)) / {top_level} END AS step FROM res),
lv AS (SELECT *, list_transform(r, lambda e: greatest(0, least({top_level}, round_even((e - low) / step, 0)))) AS l FROM st)"""


def lvq_decoded(bits: int) -> str:
    return f"""{lvq_levels(bits)}, dec AS (SELECT vec_id, v, list_transform(list_zip(l, mu),
  lambda p: CAST(CAST(low AS FLOAT) AS DOUBLE) + p[1] * CAST(CAST(step AS FLOAT) AS DOUBLE) + p[2]) AS r FROM lv)"""


def lvq_encode(bits: int) -> str:
    return f"WITH {X}, {lvq_levels(bits)} SELECT vec_id, unnest(range({DIMS})) AS d, CAST(unnest(l) AS BIGINT) AS idx FROM lv"


def elements(ctes: str, source: str = X, places: int | None = None, column: str = "r") -> str:
    value = f"round(unnest({column}), {places})" if places else f"unnest({column})"
    return f"WITH {source}, {ctes} SELECT vec_id, CAST(unnest(range({DIMS})) AS INTEGER) AS d, {value} AS x FROM dec"


def flat_search(ctes: str, metric: str, k: int = 10, order: str = "score") -> str:
    return f"WITH {X}, {Q}, {ctes} " + top(f"SELECT qid, dec.vec_id AS id, {_metric(metric, 'q.q', 'dec.r')} AS score FROM q, dec", k, order, 9)


# --- k-means and product codes ---------------------------------------------------------------


def kmeans_ctes(k: int, steps: int, metric: str = "l2") -> str:
    """CTEs up to cen (cell, c) after `steps` iterations and asg (vec_id, v, cell, dist). metric ip:
    by inner products, centroids scaled to length one."""
    order, norm = ("", "c") if metric == "l2" else (" DESC", "list_transform(c, lambda e: e / greatest(sqrt(" + fold("p[1] * p[2]", "c", "c") + "), 1e-12))")
    out = [f"c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, v AS c FROM (SELECT * FROM x ORDER BY vec_id LIMIT {k}))"]
    for i in range(steps + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, v, cell, dist FROM (
  SELECT x.vec_id, x.v, cell, {_metric(metric, 'x.v', 'c')} AS dist,
         row_number() OVER (PARTITION BY x.vec_id ORDER BY {_metric(metric, 'x.v', 'c')}{order}, cell) AS rk FROM x, c{i}) WHERE rk = 1)""")
        if i < steps:
            out.append(f"""n{i + 1} AS MATERIALIZED (SELECT c{i}.cell, coalesce(n.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
  SELECT cell, list(m ORDER BY d) AS c FROM (SELECT cell, d, avg(u) AS m FROM (
    SELECT cell, unnest(v) AS u, unnest(range(len(v))) AS d FROM a{i}) GROUP BY cell, d) GROUP BY cell) n ON n.cell = c{i}.cell),
c{i + 1} AS MATERIALIZED (SELECT cell, {norm} AS c FROM n{i + 1})""")
    out += [f"cen AS (SELECT * FROM c{steps})", f"asg AS (SELECT * FROM a{steps})"]
    return ", ".join(out)


def pq_ctes(source: str, m: int, ksub: int, steps: int) -> str:
    """CTEs up to book (m, idx, c) and code (vec_id, m, idx) of `source` (vec_id, v)."""
    width = DIMS // m
    out = [
        f"s AS MATERIALIZED (SELECT vec_id, m, list_slice(v, m * {width} + 1, m * {width} + {width}) AS p FROM {source}, range({m}) t(m))",
        f"b0 AS (SELECT m, row_number() OVER (PARTITION BY m ORDER BY vec_id) - 1 AS idx, p AS c FROM s QUALIFY row_number() OVER (PARTITION BY m ORDER BY vec_id) <= {ksub})",
    ]
    for i in range(steps + 1):
        out.append(f"""k{i} AS MATERIALIZED (SELECT vec_id, m, p, idx FROM (
  SELECT vec_id, s.m, p, idx, row_number() OVER (PARTITION BY vec_id, s.m ORDER BY {_metric('l2', 'p', 'c')}, idx) AS rk
  FROM s JOIN b{i} ON s.m = b{i}.m) WHERE rk = 1)""")
        if i < steps:
            out.append(f"""b{i + 1} AS MATERIALIZED (SELECT b{i}.m, b{i}.idx, coalesce(n.c, b{i}.c) AS c FROM b{i} LEFT JOIN (
  SELECT m, idx, list(a ORDER BY d) AS c FROM (SELECT m, idx, d, avg(u) AS a FROM (
    SELECT m, idx, unnest(p) AS u, unnest(range(len(p))) AS d FROM k{i}) GROUP BY m, idx, d) GROUP BY m, idx) n ON n.m = b{i}.m AND n.idx = b{i}.idx)""")
    out += [f"book AS (SELECT * FROM b{steps})", f"code AS (SELECT vec_id, m, idx FROM k{steps})"]
    return ", ".join(out)


def spread(k: int, rounds: int = 3) -> str:
    """CTEs up to sd (cell, c): rows drawn by distance in rounds, weighed, and picked by weight and
    distance. Numbers from 0 to 1 are steps of a multiplier."""
    u = lambda place: f"((vec_id % 2147483648) * 2654435761 + {place * 1013904223}::BIGINT) % 4294967296 / 4294967296.0::DOUBLE"
    out = [f"dr0 AS MATERIALIZED (SELECT 0 AS r, vec_id, v FROM x ORDER BY {u(0)}, vec_id LIMIT 1)"]
    for r in range(1, rounds + 1):
        out.append(f"ap{r} AS MATERIALIZED (SELECT x.vec_id, any_value(x.v) AS v, min({_metric('l2', 'x.v', 'c.v')}) AS d FROM x, dr{r - 1} c GROUP BY x.vec_id)")
        out.append(f"dr{r} AS MATERIALIZED (SELECT * FROM dr{r - 1} UNION ALL SELECT {r}, vec_id, v FROM ap{r}, (SELECT sum(d) AS phi FROM ap{r}) WHERE d > 0 AND {u(r)} * phi < {2.0 * k}::DOUBLE * d AND vec_id NOT IN (SELECT vec_id FROM dr{r - 1}))")
    out.append(f"nu AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r, vec_id) - 1 AS nr, v FROM dr{rounds})")
    out.append(f"we AS MATERIALIZED (SELECT nu.nr, nu.v, count(own.nr) AS w FROM nu LEFT JOIN (SELECT x.vec_id, nu.nr FROM x, nu QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY {_metric('l2', 'x.v', 'nu.v')}, nu.nr) = 1) own ON own.nr = nu.nr GROUP BY nu.nr, nu.v)")
    out.append("pk0 AS MATERIALIZED (SELECT 0 AS cell, v AS c FROM we ORDER BY w DESC, nr LIMIT 1)")
    for i in range(1, k):
        out.append(f"pk{i} AS MATERIALIZED (SELECT * FROM pk{i - 1} UNION ALL (SELECT {i}, v FROM (SELECT nr, any_value(v) AS v, any_value(w) * min({_metric('l2', 'v', 'c')}) AS gain FROM we, pk{i - 1} GROUP BY nr) ORDER BY gain DESC, nr LIMIT 1))")
    return ", ".join([*out, f"sd AS (SELECT * FROM pk{k - 1})"])


def kmeans_spread(k: int, steps: int) -> str:
    cells = kmeans_ctes(k, steps).replace(f"c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, v AS c FROM (SELECT * FROM x ORDER BY vec_id LIMIT {k}))", "c0 AS (SELECT * FROM sd)")
    return f"WITH {SCALED}, {spread(k)}, {cells} SELECT vec_id, CAST(cell AS INTEGER) AS cell, round(dist, 6) AS dist FROM asg"


KMEANS_GROUPED = f"""WITH {X}, c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, v AS c FROM (SELECT * FROM x ORDER BY vec_id LIMIT 300))
SELECT vec_id, CAST(cell AS INTEGER) AS cell, round(dist, 9) AS dist FROM (SELECT vec_id, cell, {_metric('l2', 'x.v', 'c')} AS dist FROM x, c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, cell) = 1"""


def cell_pq_ctes(m: int, ksub: int, steps: int) -> str:
    """CTEs up to cbook (cell, m, idx, c) and ccode (vec_id, cell, m, idx) of the residuals rs, a
    codebook for each cell from its first rows."""
    width = DIMS // m
    out = [
        f"cs AS MATERIALIZED (SELECT vec_id, cell, m, list_slice(v, m * {width} + 1, m * {width} + {width}) AS p FROM rs, range({m}) t(m))",
        f"cb0 AS (SELECT cell, m, row_number() OVER (PARTITION BY cell, m ORDER BY vec_id) - 1 AS idx, p AS c FROM cs QUALIFY row_number() OVER (PARTITION BY cell, m ORDER BY vec_id) <= {ksub})",
    ]
    for i in range(steps + 1):
        out.append(f"""ck{i} AS MATERIALIZED (SELECT vec_id, cell, m, p, idx FROM (
  SELECT vec_id, cs.cell, cs.m, p, idx, row_number() OVER (PARTITION BY vec_id, cs.m ORDER BY {_metric('l2', 'p', 'c')}, idx) AS rk
  FROM cs JOIN cb{i} b ON cs.cell = b.cell AND cs.m = b.m) WHERE rk = 1)""")
        if i < steps:
            out.append(f"""cb{i + 1} AS MATERIALIZED (SELECT b.cell, b.m, b.idx, coalesce(n.c, b.c) AS c FROM cb{i} b LEFT JOIN (
  SELECT cell, m, idx, list(a ORDER BY d) AS c FROM (SELECT cell, m, idx, d, avg(u) AS a FROM (
    SELECT cell, m, idx, unnest(p) AS u, unnest(range(len(p))) AS d FROM ck{i}) GROUP BY cell, m, idx, d) GROUP BY cell, m, idx) n
  ON n.cell = b.cell AND n.m = b.m AND n.idx = b.idx)""")
    return ", ".join([*out, f"cbook AS (SELECT * FROM cb{steps})", f"ccode AS (SELECT vec_id, cell, m, idx FROM ck{steps})"])


def _looked_up(scored: str, k: int = 10, metric: str = "l2") -> str:
    return top(scored, k, "score" if metric == "l2" else "score DESC", 9)


def adc_pq(metric: str) -> str:
    """A table of parts for each query, joined by (m, idx)."""
    part = _metric(metric, "list_slice(q, m * 8 + 1, m * 8 + 8)", "c")
    return f"""WITH {X}, {Q}, {pq_ctes('x', 8, 16, 2)}, lut AS MATERIALIZED (SELECT qid, m, idx, {part} AS part FROM q, book)
""" + _looked_up("SELECT qid, vec_id AS id, sum(part ORDER BY lut.m) AS score FROM code JOIN lut ON code.m = lut.m AND code.idx = lut.idx GROUP BY qid, vec_id", metric=metric)


def adc_ivfpq(metric: str) -> str:
    """Parts for each query and cell it probes; inner products add that with the centroid."""
    mine = "list_transform(list_zip(q, pr.c), lambda p: p[1] - p[2])" if metric == "l2" else "q"
    plus = "0.0" if metric == "l2" else fold("p[1] * p[2]", "q", "pr.c")
    return f"""WITH {X}, {Q}, {kmeans_ctes(CELLS, 3, metric)}, {probe(metric)}, {RESIDUAL}, {pq_ctes('rs', 8, 16, 2)},
pq AS MATERIALIZED (SELECT qid, cell, {mine} AS q, {plus} AS plus FROM pr),
lut AS MATERIALIZED (SELECT qid, cell, plus, m, idx, {_metric(metric, 'list_slice(q, m * 8 + 1, m * 8 + 8)', 'c')} AS part FROM pq, book)
""" + _looked_up("SELECT qid, rs.vec_id AS id, any_value(plus) + sum(part ORDER BY lut.m) AS score FROM rs JOIN code ON rs.vec_id = code.vec_id JOIN lut ON rs.cell = lut.cell AND code.m = lut.m AND code.idx = lut.idx GROUP BY qid, rs.vec_id", metric=metric)


def adc_sq4() -> str:
    return f"""WITH {TAPERED}, {Q}, {sq_levels(4)}, val AS (SELECT b.d, g AS l, g / 15.0 * (mx[b.d + 1] - mn[b.d + 1] + 1e-8) + mn[b.d + 1] AS x FROM rg, range({DIMS}) b(d), range(16) r(g)),
lut AS MATERIALIZED (SELECT qid, val.d, l, power(q[val.d + 1] - x, 2) AS part FROM q, val),
lv AS (SELECT vec_id, unnest(l) AS l, unnest(range({DIMS})) AS d FROM sq)
""" + _looked_up("SELECT qid, vec_id AS id, sum(part ORDER BY lut.d) AS score FROM lv JOIN lut ON lv.d = lut.d AND lv.l = lut.l GROUP BY qid, vec_id")


def pq_per_cell() -> str:
    return ivf(f", {cell_pq_ctes(8, 8, 2)}, pd AS (SELECT vec_id, flatten(list(b.c ORDER BY b.m)) AS r FROM ccode JOIN cbook b ON ccode.cell = b.cell AND ccode.m = b.m AND ccode.idx = b.idx GROUP BY vec_id)",
               f"SELECT rs.vec_id, cell, {PLUS_C.format(r='pd.r')} AS r FROM rs JOIN pd ON rs.vec_id = pd.vec_id")


GOWER = f"""WITH x AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e, i: CASE WHEN (vec_id + i - 1) % 11 = 0 THEN CAST('NaN' AS DOUBLE)
    WHEN (i - 1) % 4 = 3 THEN -1.0 - (vec_id + i - 1) % 5 ELSE abs(e) * (1 + vec_id % 7) END) AS v FROM embeddings), {Q}, {E},
sp AS (SELECT d, max(x) - min(x) AS span FROM e WHERE NOT isnan(x) AND x >= 0 GROUP BY d),
qe AS (SELECT qid, unnest(q) AS a, unnest(range(len(q))) AS d FROM q),
pr AS (SELECT qid, vec_id AS id, qe.d, isnan(a) OR isnan(x) AS gone, CASE WHEN a >= 0 AND x >= 0 THEN CASE WHEN span > 0 THEN least(abs(a - x) / span, 1.0) ELSE 0.0 END
    WHEN a < 0 AND x < 0 AND trunc(a) = trunc(x) THEN 0.0 ELSE 1.0 END AS part FROM qe JOIN e ON qe.d = e.d LEFT JOIN sp ON sp.d = e.d)
""" + top("SELECT qid, id, sum(CASE WHEN gone THEN 0.0 ELSE part END ORDER BY d) / count(*) FILTER (WHERE NOT gone) AS score FROM pr GROUP BY qid, id", 10, "score", 9)


def probe(metric: str = "l2") -> str:
    order = "" if metric == "l2" else " DESC"
    return f"""pr AS MATERIALIZED (SELECT qid, q, cell, c, rk FROM (
  SELECT qid, q, cell, c, row_number() OVER (PARTITION BY qid ORDER BY {_metric(metric, 'q.q', 'c')}{order}, cell) AS rk FROM q, cen) WHERE rk <= {PROBES})"""


RESIDUAL = "rs AS MATERIALIZED (SELECT vec_id, asg.cell, c, list_transform(list_zip(asg.v, c), lambda p: p[1] - p[2]) AS v FROM asg JOIN cen ON asg.cell = cen.cell)"
PLUS_C = "list_transform(list_zip({r}, c), lambda p: p[1] + p[2])"


def ivf(ctes: str, rows: str, k: int = 10, metric: str = "l2") -> str:
    """rows: SELECT of (vec_id, cell, r), r the decoded row."""
    scored = f"SELECT qid, w.vec_id AS id, {_metric(metric, 'pr.q', 'w.r')} AS score FROM pr JOIN w ON pr.cell = w.cell"
    return f"WITH {X}, {Q}, {kmeans_ctes(CELLS, 3, metric)}, {probe(metric)}, {RESIDUAL}{ctes}, w AS MATERIALIZED ({rows}) " + top(scored, k, "score" if metric == "l2" else "score DESC", places=9)


SIGNS = f"""{E}, {MEAN}, o AS (SELECT vec_id, mu, list_transform(list_zip(v, mu), lambda p: p[1] - p[2]) AS o FROM x, mu),
rb AS (SELECT vec_id, mu, o, {fold('p[1] * p[2]', 'o', 'o')} AS norm2,
  list_reduce(list_transform(o, lambda t: abs(t)), lambda s, t: s + t) / sqrt({DIMS}.0) AS spread FROM o),
rf AS (SELECT vec_id, mu, list_transform(o, lambda t: CASE WHEN t > 0 THEN 1 ELSE 0 END) AS bits,
  CAST(CAST(norm2 AS FLOAT) AS DOUBLE) AS norm2, CAST(CAST(CASE WHEN spread > 0 THEN norm2 / spread ELSE 0 END AS FLOAT) AS DOUBLE) AS factor FROM rb)"""


NEAR = "list_transform(q, lambda e: round_even((e - low) / step, 0) * step + low)"
SIGN_IP = fold(f"p[1] * (p[2] * 2 - 1) / sqrt({DIMS}.0)", "near", "bits")


def _rabitq_search(metric: str) -> str:
    """Under ip a row keeps its squared length about the mean less that about zero."""
    source, signs, score, order, places = X, SIGNS, f"greatest(0, norm2 + q2 - 2 * {SIGN_IP} * factor)", "score", 5
    if metric == "ip":
        source, order, places = SCALED, "score DESC", 4
        signs = SIGNS.replace("SELECT vec_id, mu, list_transform(list_zip(v, mu)", "SELECT vec_id, v, mu, list_transform(list_zip(v, mu)").replace("rb AS (SELECT vec_id, mu, o,", "rb AS (SELECT vec_id, v, mu, o,")
        signs = signs.replace("CAST(CAST(norm2 AS FLOAT) AS DOUBLE)", f"CAST(CAST(norm2 - {fold('p[1] * p[2]', 'v', 'v')} AS FLOAT) AS DOUBLE)")
        score = f"(raw2 - (norm2 + q2 - 2 * {SIGN_IP} * factor)) / 2"
    return f"""WITH {source}, {Q}, {signs},
qc AS (SELECT qid, {fold('p[1] * p[2]', 'q', 'q')} AS raw2, list_transform(list_zip(q, mu), lambda p: p[1] - p[2]) AS q FROM q, mu),
qs AS (SELECT qid, raw2, q, list_min(q) AS low, greatest((list_max(q) - list_min(q)) / 15, 1e-30) AS step FROM qc),
qq AS (SELECT qid, raw2, {fold('p[1] * p[2]', 'q', 'q')} AS q2, {NEAR} AS near FROM qs)
""" + top(f"SELECT qid, vec_id AS id, {score} AS score FROM qq, rf", 10, order, places)


def _rabitq_ivf(metric: str) -> str:
    """Sign-bit codes of residuals. Under l2 a query is a residual of the cell too; under ip it is
    itself, and its product with the centroid is added."""
    signs = SIGNS.replace("FROM x)", "FROM rs)").replace("FROM x, mu)", "FROM rs, mu)").replace("SELECT vec_id, mu,", "SELECT vec_id, cell, v, mu,")
    plus, score, order, mine = "0.0", f"greatest(0, norm2 + q2 - 2 * {SIGN_IP} * factor)", "score", "list_transform(list_zip(q, c), lambda p: p[1] - p[2])"
    if metric == "ip":
        signs = signs.replace("CAST(CAST(norm2 AS FLOAT) AS DOUBLE)", f"CAST(CAST(norm2 - {fold('p[1] * p[2]', 'v', 'v')} AS FLOAT) AS DOUBLE)")
        plus, order, mine = fold("p[1] * p[2]", "q", "c"), "score DESC", "q"
        score = f"(raw2 - (norm2 + q2 - 2 * {SIGN_IP} * factor)) / 2 + plus"
    return f"""WITH {X}, {Q}, {kmeans_ctes(CELLS, 3, metric)}, {probe(metric)}, {RESIDUAL}, {signs},
q0 AS (SELECT qid, cell, {plus} AS plus, {fold('p[1] * p[2]', 'q', 'q')} AS raw2, {mine} AS q FROM pr),
qc AS (SELECT qid, cell, plus, raw2, list_transform(list_zip(q, mu), lambda p: p[1] - p[2]) AS q FROM q0, mu),
qs AS (SELECT *, list_min(q) AS low, greatest((list_max(q) - list_min(q)) / 15, 1e-30) AS step FROM qc),
qq AS (SELECT qid, cell, plus, raw2, {fold('p[1] * p[2]', 'q', 'q')} AS q2, {NEAR} AS near FROM qs)
""" + top(f"SELECT qid, vec_id AS id, {score} AS score FROM qq JOIN rf ON qq.cell = rf.cell", 10, order, 4)


# --- segments ----------------------------------------------------------------------------


def _block_bits(units: int) -> str:
    """CTEs up to bl (block, bits): the largest gains of blocks of 16 dimensions, one bit at a time."""
    curve = [float(t) for t in allocation.normal_distortion()]
    gains = ", ".join(f"({b + 1}, CAST({curve[b]!r} AS DOUBLE), CAST({curve[b + 1]!r} AS DOUBLE))" for b in range(len(curve) - 1))
    return f"""{E}, va AS (SELECT d, var_pop(x) AS var FROM e GROUP BY d), vb AS (SELECT d // 16 AS block, sum(var) AS weight FROM va GROUP BY 1), g(b, hi, lo) AS (VALUES {gains}),
pk AS (SELECT block, b FROM vb, g QUALIFY row_number() OVER (ORDER BY weight * (hi - lo) DESC, block, b) <= {units}),
bl AS (SELECT vb.block, count(pk.b) AS bits FROM vb LEFT JOIN pk ON vb.block = pk.block GROUP BY vb.block)"""


def _grid(units: int) -> str:
    """CTEs up to sg (vec_id, sid, d, o, point, norm2, scale): each segment on the grid of its
    largest entry. Neighbouring blocks of equal bits are one segment."""
    return f"""{_block_bits(units)}, {MEAN},
si AS (SELECT block, bits, sum(new) OVER (ORDER BY block) AS sid FROM (SELECT *, CASE WHEN bits IS DISTINCT FROM lag(bits) OVER (ORDER BY block) THEN 1 ELSE 0 END AS new FROM bl)),
oe AS (SELECT vec_id, e.d, sid, bits, x - mu[e.d + 1] AS o FROM e JOIN si ON e.d // 16 = block, mu),
vm AS (SELECT *, max(abs(o)) OVER (PARTITION BY vec_id, sid) AS m, power(2, bits) AS cells FROM oe),
pt AS (SELECT *, CASE WHEN bits = 0 THEN 0.0 ELSE (CASE WHEN m > 0 THEN greatest(0, least(cells - 1, floor((o + m) / (2 * m / cells)))) ELSE 0 END + 0.5) * (2 / cells) - 1 END AS point FROM vm),
sm AS (SELECT vec_id, sid, sum(o * o ORDER BY d) AS norm2, sum(o * point ORDER BY d) AS ip FROM pt GROUP BY vec_id, sid),
sg AS (SELECT pt.vec_id, pt.sid, d, point, CAST(CAST(norm2 AS FLOAT) AS DOUBLE) AS norm2, CAST(CAST(CASE WHEN ip > 0 THEN norm2 / ip ELSE 0 END AS FLOAT) AS DOUBLE) AS scale
  FROM pt JOIN sm ON pt.vec_id = sm.vec_id AND pt.sid = sm.sid)"""


def _grid_search(metric: str, prune: bool = False) -> str:
    score = "sum(part)" if metric == "ip" else "greatest(0, sum(norm2 + q2 - 2 * part))"
    if prune:  # never nearer than the lengths of the segments allow
        score = f"greatest({score}, sum(power(greatest(abs(sqrt(q2) - sqrt(norm2) * (1 + 1e-6)) - 2e-6 * sqrt(norm2) * (1 + 1e-6), 0), 2)))"
    centred = "q[d + 1]" if metric == "ip" else "q[d + 1] - mu[d + 1]"
    mean = fold("p[1] * p[2]", "q", "mu") if metric == "ip" else "0.0"
    return f"""WITH {TAPERED}, {Q}, {_grid(3 * DIMS // 16)},
qd AS (SELECT qid, d, {mean} AS plus, {centred} AS q FROM q, mu, range({DIMS}) t(d)),
sp AS (SELECT qid, vec_id, sid, any_value(plus) AS plus, any_value(norm2) AS norm2, sum(q * q) AS q2, sum(q * point * scale) AS part FROM qd JOIN sg ON qd.d = sg.d GROUP BY qid, vec_id, sid)
""" + top(f"SELECT qid, vec_id AS id, {score} + any_value(plus) AS score FROM sp GROUP BY qid, vec_id", 10, "score" if metric == "l2" else "score DESC", 5)


def saq_blocks() -> str:
    """Highest bits first by dimension, the others lowest first, 32 rows a block."""
    return f"""WITH {TAPERED}, {_grid(3 * DIMS // 16)},
co AS (SELECT pt.vec_id, CAST(pt.sid AS BIGINT) - 1 AS segment, pt.bits, pt.d - min(pt.d) OVER (PARTITION BY pt.vec_id, pt.sid) AS d, CASE WHEN pt.bits > 0 THEN CAST(round((point + 1) * power(2, pt.bits) / 2 - 0.5) AS BIGINT) ELSE 0 END AS code FROM pt),
bt AS (SELECT vec_id, segment, 's' AS kind, d // 8 AS pos, sum((code >> (bits - 1)::INTEGER) << (7 - d % 8)::INTEGER) AS byte FROM co WHERE bits > 0 GROUP BY ALL
  UNION ALL SELECT vec_id, segment, 'l', (d * (bits - 1) + b) // 8, sum(((code >> b::INTEGER) & 1) << ((d * (bits - 1) + b) % 8)::INTEGER) FROM co, range(8) t(b) WHERE b < bits - 1 GROUP BY ALL),
hx AS (SELECT vec_id, segment, coalesce(string_agg(printf('%02X', byte::INTEGER), '' ORDER BY pos) FILTER (WHERE kind = 's'), '') AS short, coalesce(string_agg(printf('%02X', byte::INTEGER), '' ORDER BY pos) FILTER (WHERE kind = 'l'), '') AS long
  FROM (SELECT DISTINCT vec_id, segment FROM co) LEFT JOIN bt USING (vec_id, segment) GROUP BY vec_id, segment),
nr AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS nr FROM x)
SELECT nr // 32 AS block, string_agg(vec_id::VARCHAR, ',' ORDER BY nr) AS ids, CAST(segment AS INTEGER) AS segment,
  string_agg(short, '' ORDER BY nr) || repeat('0', (32 - count(*)) * any_value(length(short))) AS short, string_agg(long, '' ORDER BY nr) || repeat('0', (32 - count(*)) * any_value(length(long))) AS long
FROM hx JOIN nr USING (vec_id) GROUP BY block, segment"""


def saq_adjusted(rounds: int = 6) -> str:
    """One step of one dimension at a time, up then down, kept where the cosine grows."""
    level = lambda c: f"(({c}) + 0.5) * (2 / power(2, bits)) - 1"
    return f"""WITH RECURSIVE {TAPERED}, {_grid(3 * DIMS // 16)},
s0 AS MATERIALIZED (SELECT vec_id, sid, any_value(bits) AS bits, count(*) AS n, min(d) AS fst, list(o ORDER BY d) AS o, list(CASE WHEN bits > 0 THEN CAST(round((point + 1) * power(2, bits) / 2 - 0.5) AS BIGINT) ELSE 0 END ORDER BY d) AS code,
  sum(o * point ORDER BY d) AS ip, sum(point * point ORDER BY d) AS size FROM pt GROUP BY vec_id, sid),
mv AS (SELECT 0 AS step, vec_id, sid, bits, n, fst, o, code, ip, size FROM s0
  UNION ALL SELECT step + 1, vec_id, sid, bits, n, fst, o, CASE WHEN better THEN list_concat(list_concat(code[:i - 1], [new]), code[i + 1:]) ELSE code END, CASE WHEN better THEN new_ip ELSE ip END, CASE WHEN better THEN new_size ELSE size END
  FROM (SELECT *, new BETWEEN 0 AND power(2, bits) - 1 AND new_ip > 0 AND (ip * ip + 1e-8 * size) * new_size < new_ip * new_ip * size AS better
    FROM (SELECT *, ip + (after - before) * o[i] AS new_ip, size + after * after - before * before AS new_size
      FROM (SELECT *, {level('code[i]')} AS before, {level('new')} AS after
        FROM (SELECT *, code[i] + CASE WHEN step % 2 = 0 THEN 1 ELSE -1 END AS new FROM (SELECT *, (step // 2) % n + 1 AS i FROM mv WHERE bits > 0 AND step < {rounds} * 2 * n))))))
SELECT vec_id, CAST(fst + unnest(range(n)) AS INTEGER) AS d, unnest(code) AS code FROM mv WHERE step = CASE WHEN bits > 0 THEN {rounds} * 2 * n ELSE 0 END"""


def saq_factors() -> str:
    """h is half a step above or below zero. A segment without bits has its length alone."""
    kept = lambda value: f"CAST(CAST({value} AS FLOAT) AS DOUBLE)"
    return f"""WITH {TAPERED}, {_grid(3 * DIMS // 16)},
ph AS (SELECT sg.vec_id, sg.sid, sg.d, bits, norm2, scale, sg.point * scale AS p, CASE WHEN bits = 0 THEN 0.0 WHEN sg.point > 0 THEN 0.5 ELSE -0.5 END AS h FROM sg JOIN pt ON sg.vec_id = pt.vec_id AND sg.sid = pt.sid AND sg.d = pt.d),
al AS (SELECT vec_id, sid, any_value(bits) AS bits, any_value(norm2) AS norm2, any_value(scale) AS scale, count(*) AS n, sum(p * p) AS p2, CASE WHEN sum(h * h) > 0 THEN CAST(CAST(sum(p * h) / sum(h * h) AS FLOAT) AS DOUBLE) ELSE 0.0 END AS along FROM ph GROUP BY vec_id, sid)
SELECT ph.vec_id, CAST(ph.sid - 1 AS INTEGER) AS segment, round(any_value(al.norm2), 4) AS norm2, round(any_value(al.scale), 4) AS scale,
  round({kept('any_value(CASE WHEN al.bits = 0 OR al.norm2 = 0 THEN 0.0 ELSE 1.9 * sqrt(al.norm2) * sqrt(greatest(p2 / al.norm2 - 1, 0) / greatest(n - 1, 1)) END)')}, 4) AS error,
  round({kept('sqrt(any_value(p2))')}, 4) AS length, round(any_value(along), 4) AS along, round({kept('sqrt(sum(power(p - along * h, 2)))')}, 4) AS beside
FROM ph JOIN al ON ph.vec_id = al.vec_id AND ph.sid = al.sid GROUP BY ph.vec_id, ph.sid"""


# --- two levels a dimension -----------------------------------------------------------------


def _two_levels(source: str) -> str:
    """source: CTEs up to w (d, x, n). The split of each dimension with the least error, then the
    error of all values about its means."""
    return f"""WITH {TAPERED}, {E}, {source},
run AS (SELECT d, x, sum(n) OVER (PARTITION BY d ORDER BY x) AS n1, sum(n * x) OVER (PARTITION BY d ORDER BY x) AS s1, sum(n) OVER (PARTITION BY d) AS n, sum(n * x) OVER (PARTITION BY d) AS s FROM w),
cut AS (SELECT d, s1 / n1 AS low, (s - s1) / (n - n1) AS high FROM run WHERE n1 < n QUALIFY row_number() OVER (PARTITION BY d ORDER BY s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) DESC) = 1)
{_TWO_ERRORS}"""


_TWO_ERRORS = """SELECT CAST(e.d AS INTEGER) AS d, round(any_value(low), 7) AS low, round(any_value(high), 7) AS high,
  round(sum(CASE WHEN x <= (low + high) / 2 THEN (x - low) * (x - low) ELSE (x - high) * (x - high) END), 7) AS error FROM e JOIN cut ON e.d = cut.d GROUP BY e.d"""
BINNED = "lim AS (SELECT d, min(x) AS a, max(x) AS b FROM e GROUP BY d), w AS (SELECT e.d, avg(x) AS x, count(*) AS n FROM e JOIN lim ON e.d = lim.d GROUP BY e.d, CAST(least(floor((x - a) / ((b - a) / 500)), 499) AS INTEGER))"


def _two_lloyd(steps: int = 40) -> str:
    """From the quartiles; the cells of this data stand still well before the last step."""
    out = ["l0 AS (SELECT d, quantile_cont(x, 0.25) AS low, quantile_cont(x, 0.75) AS high FROM e GROUP BY d)"]
    for i in range(steps):
        out.append(f"l{i + 1} AS MATERIALIZED (SELECT e.d, avg(x) FILTER (WHERE x <= (low + high) / 2) AS low, avg(x) FILTER (WHERE x > (low + high) / 2) AS high FROM e JOIN l{i} ON e.d = l{i}.d GROUP BY e.d)")
    return f"WITH {TAPERED}, {E.replace('e AS (', 'e AS MATERIALIZED (')}, {', '.join(out)}, cut AS (SELECT * FROM l{steps}) {_TWO_ERRORS}"


def _lloyd_levels(k: int, steps: int = 100) -> str:
    """From the quantiles (i + 1/2) / k; an empty cell keeps its centroid."""
    shares = [(i + 0.5) / k for i in range(k)]
    out = [f"l0 AS MATERIALIZED (SELECT d, quantile_cont(x, {shares}) AS c FROM e GROUP BY d)"]
    for i in range(steps):
        out.append(f"""l{i + 1} AS MATERIALIZED (SELECT l{i}.d, list_transform(range(1, {k + 1}), lambda j: coalesce(m[j], c[j])) AS c FROM l{i} JOIN (
  SELECT d, map_from_entries(list((cell, a))) AS m FROM (SELECT e.d, len(list_filter(range(1, {k}), lambda j: (c[j] + c[j + 1]) / 2 < x)) + 1 AS cell, avg(x) AS a FROM e JOIN l{i} ON e.d = l{i}.d GROUP BY 1, 2) GROUP BY d) n ON n.d = l{i}.d)""")
    return f"WITH {TAPERED}, {E.replace('e AS (', 'e AS MATERIALIZED (')}, {', '.join(out)} SELECT CAST(d AS INTEGER) AS d, CAST(unnest(range({k})) AS INTEGER) AS level, round(unnest(c), 7) AS centroid FROM l{steps}"


def _optimal_levels(k: int, binned: bool = False) -> str:
    """The min-plus programme over sorted distinct values, layer by layer, and its cuts back."""
    source = f"{BINNED}, v AS (SELECT d, x, n FROM w)" if binned else "v AS (SELECT d, x, count(*) AS n FROM e GROUP BY d, x)"
    out = [
        source,
        "p AS MATERIALIZED (SELECT d, row_number() OVER o AS j, sum(n) OVER o AS s0, sum(n * x) OVER o AS s1, sum(n * x * x) OVER o AS s2 FROM v WINDOW o AS (PARTITION BY d ORDER BY x ROWS UNBOUNDED PRECEDING))",
        "f1 AS MATERIALIZED (SELECT d, j, s2 - s1 * s1 / s0 AS f, CAST(0 AS BIGINT) AS i FROM p)",
    ]
    for layer in range(2, k + 1):
        out.append(f"""f{layer} AS MATERIALIZED (SELECT b.d, b.j, min(g.f + (b.s2 - a.s2) - (b.s1 - a.s1) * (b.s1 - a.s1) / (b.s0 - a.s0)) AS f,
  arg_min(a.j, g.f + (b.s2 - a.s2) - (b.s1 - a.s1) * (b.s1 - a.s1) / (b.s0 - a.s0)) AS i FROM p b JOIN p a ON a.d = b.d AND a.j < b.j JOIN f{layer - 1} g ON g.d = a.d AND g.j = a.j GROUP BY b.d, b.j)""")
    out.append(f"t{k} AS (SELECT d, max(j) AS j FROM p GROUP BY d)")
    for layer in range(k, 0, -1):
        out.append(f"t{layer - 1} AS MATERIALIZED (SELECT f.d, f.i AS j FROM f{layer} f JOIN t{layer} t ON f.d = t.d AND f.j = t.j)")
    cells = " UNION ALL ".join(f"SELECT b.d, {layer - 1} AS level, (b.s1 - coalesce(a.s1, 0)) / (b.s0 - coalesce(a.s0, 0)) AS c FROM t{layer} x JOIN p b ON b.d = x.d AND b.j = x.j JOIN t{layer - 1} y ON y.d = x.d LEFT JOIN p a ON a.d = y.d AND a.j = y.j" for layer in range(1, k + 1))
    return f"WITH {TAPERED}, {E.replace('e AS (', 'e AS MATERIALIZED (')}, {', '.join(out)} SELECT CAST(d AS INTEGER) AS d, CAST(level AS INTEGER) AS level, round(c, 7) AS centroid FROM ({cells})"


#: CTEs up to co (d, b, cost): squared error about the mean, or on a grid of b bits between the ends.
_COSTS = f"""{E}, st AS (SELECT d, avg(x) AS mu, min(x) AS a, max(x) - min(x) AS span FROM e GROUP BY d),
co AS MATERIALIZED (SELECT e.d, b, sum(CASE WHEN b = 0 THEN power(x - mu, 2) ELSE power(x - (round_even((x - a) / CASE WHEN span > 0 THEN span ELSE 1 END * (power(2, b) - 1), 0) / (power(2, b) - 1) * span + a), 2) END) AS cost
  FROM e JOIN st ON e.d = st.d, range(6) t(b) GROUP BY e.d, b)"""


def _measured_optimal(budget: int) -> str:
    """The least cost of the first dimensions for each number of bits used, dimension by dimension."""
    return f"""WITH RECURSIVE {TAPERED}, {_COSTS},
f AS (SELECT -1::BIGINT AS d, 0::BIGINT AS used, 0.0::DOUBLE AS total, []::BIGINT[] AS path
  UNION ALL SELECT co.d, used + b, total + cost, list_append(path, b) FROM f JOIN co ON co.d = f.d + 1 WHERE used + b <= {budget} QUALIFY row_number() OVER (PARTITION BY used + b ORDER BY total + cost) = 1),
best AS (SELECT path FROM f WHERE d = {DIMS - 1} ORDER BY total LIMIT 1)
SELECT CAST(co.d AS INTEGER) AS d, CAST(b AS INTEGER) AS bits, round(cost, 6) AS cost FROM co, best WHERE b = path[co.d + 1]"""


def _measured_greedy(budget: int) -> str:
    """A bit is taken by the least gain up to it, as the ones before it must be taken first; one
    without a gain ends its dimension."""
    return f"""WITH {TAPERED}, {_COSTS},
g AS (SELECT d, b, lag(cost) OVER (PARTITION BY d ORDER BY b) - cost AS gain FROM co),
m AS (SELECT d, b, min(gain) OVER (PARTITION BY d ORDER BY b) AS least FROM g WHERE b > 0),
pk AS (SELECT d, b FROM m WHERE least > 0 QUALIFY row_number() OVER (ORDER BY least DESC, d, b) <= {budget}),
bt AS (SELECT st.d, count(pk.b) AS bits FROM st LEFT JOIN pk ON st.d = pk.d GROUP BY st.d)
SELECT CAST(bt.d AS INTEGER) AS d, CAST(bits AS INTEGER) AS bits, round(cost, 6) AS cost FROM bt JOIN co ON co.d = bt.d AND co.b = bt.bits"""


def _divisor(most: str) -> str:
    return f"CAST((SELECT max(k) FROM range(1, CAST(dims AS BIGINT) + 1) r(k) WHERE dims % k = 0 AND k <= greatest(1, least({most}, dims))) AS INTEGER)"


def _extended(bits: int = 4) -> str:
    turn = moments.random_rotation(DIMS, 0)
    levels, _ = allocation.normal_levels(1 << bits)
    rows = ", ".join(f"({i}, {[float(t) for t in turn[:, i]]}, {[float(t) for t in turn[i]]})" for i in range(DIMS))
    mids = [float(t) for t in (levels[1:] + levels[:-1]) / 2]
    return f"""WITH {X}, {E}, {MEAN}, turn(i, col, ro) AS (VALUES {rows}),
o AS (SELECT vec_id, list_transform(list_zip(v, mu), lambda p: p[1] - p[2]) AS o FROM x, mu),
n AS (SELECT vec_id, o, greatest(sqrt({fold('p[1] * p[2]', 'o', 'o')}), 1e-12) AS norm FROM o),
s AS (SELECT vec_id, norm, i, {fold('p[1] / norm * p[2]', 'o', 'col')} * sqrt({DIMS}.0) AS s FROM n, turn),
l AS (SELECT vec_id, norm, i, s, (CAST({[float(t) for t in levels]} AS DOUBLE[]))[1 + len(list_filter(CAST({mids} AS DOUBLE[]), lambda b: b < s))] AS near FROM s),
t AS (SELECT vec_id, CAST(CAST(any_value(norm) AS FLOAT) AS DOUBLE) AS norm, CAST(CAST(sum(s * near) / sum(near * near) AS FLOAT) AS DOUBLE) AS t, list(near ORDER BY i) AS near FROM l GROUP BY vec_id)
SELECT vec_id, i AS d, round({fold('p[1] * p[2]', 'near', 'ro')} / sqrt({DIMS}.0) * t * norm + mu[i + 1], 6) AS x FROM t, turn, mu"""


# --- allocation --------------------------------------------------------------------------


def _alloc(weight: str, curve: list[float], budget: int, cost: str) -> str:
    gains = ", ".join(f"({b + 1}, CAST({curve[b]!r} AS DOUBLE), CAST({curve[b + 1]!r} AS DOUBLE))" for b in range(len(curve) - 1))
    dist = ", ".join(f"({b}, CAST({float(t)!r} AS DOUBLE))" for b, t in enumerate(allocation.normal_distortion()))
    return f"""WITH {TAPERED}, {E}, va AS (SELECT d, var_pop(x) AS var FROM e GROUP BY d), g(b, hi, lo) AS (VALUES {gains}), ds(b, dist) AS (VALUES {dist}),
ranked AS (SELECT d, b, row_number() OVER (ORDER BY {weight} * (hi - lo) DESC, d, b) AS rk FROM va, g),
own AS (SELECT va.d, any_value(var) AS var, count(r.b) AS bits FROM va LEFT JOIN (SELECT * FROM ranked WHERE rk <= {budget}) r ON va.d = r.d GROUP BY va.d)
SELECT CAST(d AS INTEGER) AS d, CAST(bits AS INTEGER) AS bits{cost} FROM own JOIN ds ON ds.b = own.bits"""


def _first_fit() -> str:
    """Widest fields first, fours after threes, each into the first byte with room."""
    return f"""WITH RECURSIVE own AS ({_alloc('power(var, 1.5)', [float(t) for t in allocation.normal_distortion()], 3 * DIMS, '')}),
ord AS (SELECT d, bits, row_number() OVER (ORDER BY CASE bits WHEN 3 THEN 3.5 WHEN 4 THEN 3 ELSE bits END DESC, d) AS i FROM own WHERE bits > 0),
st(i, used, d, bits, byte, bit) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS INTEGER[]), -1, 0, -1, -1
  UNION ALL
  SELECT i, CASE WHEN p > len(used) THEN list_append(used, bits) ELSE list_transform(used, lambda u, j: CASE WHEN j = p THEN u + bits ELSE u END) END,
         d, bits, CAST(p - 1 AS INTEGER), CASE WHEN p > len(used) THEN 0 ELSE used[p] END
  FROM (SELECT o.i, used, o.d, o.bits, coalesce(list_position(list_transform(used, lambda u: u + o.bits <= 8), true), len(used) + 1) AS p FROM st JOIN ord o ON o.i = st.i + 1))
SELECT d, bits, byte, bit FROM st WHERE i > 0 UNION ALL SELECT d, bits, -1, -1 FROM own WHERE bits = 0"""


# --- metrics -----------------------------------------------------------------------------

_RANKED = """gt AS MATERIALIZED (SELECT qid, id, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rk FROM (
  SELECT qid, vec_id AS id, {a} AS score FROM q, x)) WHERE rk <= 100),
fd AS MATERIALIZED (SELECT qid, id, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rk FROM (
  SELECT qid, dec.vec_id AS id, {b} AS score FROM q, dec)) WHERE rk <= 100),
ks(k) AS (VALUES (1), (10), (100)),
h AS (SELECT k, g.qid, count(f.id) AS hits, count(*) AS n_truth, any_value(nf) AS n_found FROM ks JOIN gt g ON g.rk <= k
  LEFT JOIN fd f ON f.qid = g.qid AND f.id = g.id AND f.rk <= k
  LEFT JOIN (SELECT k AS fk, qid AS fq, count(*) AS nf FROM ks JOIN fd ON fd.rk <= k GROUP BY k, qid) ON fk = k AND fq = g.qid GROUP BY k, g.qid)"""


def recall(final: str) -> str:
    ranked = _RANKED.format(a=_metric("l2"), b=_metric("l2", "q.q", "dec.r"))
    return f"WITH {X}, {Q}, {sq_decoded(4)}, {ranked} {final}"


def bench(name: str, found: str, size: int, ratio: float) -> str:
    """Recall at 10 of `found` (qid, rk, id) against exact search, and bytes by row."""
    return f"""WITH truth AS ({knn(X, 'l2', 10)}), found AS ({found}), rows AS (SELECT count(*) AS n FROM embeddings)
SELECT '{name}' AS method, round((SELECT count(*) FROM truth JOIN found USING (qid, id)) / CAST((SELECT count(*) FROM truth) AS DOUBLE), 9) AS recall, n * {size} AS memory_bytes, CAST({ratio!r} AS DOUBLE) AS compression_ratio, 10 AS k, n FROM rows"""


def _study() -> str:
    """Scalar codes of 4 and 8 bits and local codes of 4 and 8, under the normalised score."""
    parts, unions = [], []
    base = f"{SCALED}, {Q}, nx AS (SELECT vec_id, v, greatest(sqrt({fold('p[1] * p[2]', 'v', 'v')}), 1e-12) AS nrm FROM x)"
    truth = f"""gt AS MATERIALIZED (SELECT qid, id, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM (
  SELECT qid, vec_id AS id, {fold('p[1] * p[2]', 'q.q', 'nx.v')} / nrm AS score FROM q, nx)) WHERE rk <= 100)"""
    for method, bits, size in (("sq", 4, DIMS // 2), ("sq", 8, DIMS), ("lvq", 4, DIMS // 2 + 8), ("lvq", 8, DIMS + 8)):
        t = f"{method}{bits}"
        ctes = sq_decoded(bits) if method == "sq" else lvq_decoded(bits)
        inner = f"WITH {ctes} SELECT vec_id, v, r FROM dec"
        parts.append(f"{t} AS MATERIALIZED ({inner})")
        parts.append(f"""f{t} AS MATERIALIZED (SELECT qid, id, rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM (
  SELECT qid, z.vec_id AS id, {fold('p[1] * p[2]', 'q.q', 'z.r')} / greatest(sqrt({fold('p[1] * p[2]', 'z.v', 'z.v')}), 1e-12) AS score FROM q, {t} z)) WHERE rk <= 100)""")
        recalls = ", ".join(f"(SELECT round(avg(hits / {k}.0), 9) FROM (SELECT g.qid, count(f.id) AS hits FROM gt g LEFT JOIN f{t} f ON f.qid = g.qid AND f.id = g.id AND f.rk <= {k} WHERE g.rk <= {k} GROUP BY g.qid)) AS recall_at_{k}" for k in (1, 10, 100))
        unions.append(f"""SELECT '{method}' AS method, CAST({bits} AS DOUBLE) AS bpd, CAST(count(*) * {size + 4} AS BIGINT) AS code_bytes,
  round(4.0 * count(*) * {DIMS} / (count(*) * {size + 4}), 9) AS compression_factor, round(sum({fold(_TERMS['l2'], 'v', 'r')}) / (count(*) * {DIMS}), 9) AS mse,
  count(*) AS n_db, (SELECT count(*) FROM q) AS n_queries, {DIMS} AS "D", {recalls} FROM {t}""")
    return f"WITH {base}, {truth}, {', '.join(parts)} " + " UNION ALL ".join(unions)


def pq_width(bits: int) -> int:
    """Entries that share a point; the widest code has the coarsest ones, so its error is no less."""
    return 4 if bits == 8 else 2


def _runs() -> str:
    """Runs measured on the table: entries on a grid over [-1, 1] (sq), neighbours as one point of
    twice the bits (pq), rows on a grid of their own (lvq). recall: the share of rows whose largest
    entry is in the same place; one number is missing."""
    grid = lambda e, bits, low, span: f"(round_even(({e} - ({low})) / ({span}) * {2**bits - 1}, 0) / {2**bits - 1} * ({span}) + ({low}))"
    cells = []
    for i, (method, bits, step) in enumerate(RUNS):
        if method == "sq":
            r = f"list_transform(v, lambda e: {grid('e', bits, '-1.0', '2.0')})"
        elif method == "pq":
            w = pq_width(bits)
            mean = "((" + " + ".join(f"v[i - (i - 1) % {w} + {j}]" for j in range(w)) + f") / {w})"
            r = f"list_transform(v, lambda e, i: {grid(mean, 2 * bits, '-1.0', '2.0')})"
        else:
            r = f"CASE WHEN list_max(v) > list_min(v) THEN list_transform(v, lambda e: {grid('e', bits, 'list_min(v)', 'list_max(v) - list_min(v)')}) ELSE v END"
        size = f"{DIMS} * {bits} / 8.0" + (" + 8" if method == "lvq" else "")
        mse = "CAST(NULL AS DOUBLE)" if (method, bits) == ("lvq", 8) else f"round(avg({fold(_TERMS['l2'], 'v', 'r')} / {DIMS}), 12)"
        cells.append(f"""SELECT '{method}' AS method, CAST({bits} AS DOUBLE) AS bpd, 4.0 * {DIMS} / ({size}) AS compression, avg(CASE WHEN list_position(v, list_max(v)) = list_position(r, list_max(r)) THEN 1.0 ELSE 0.0 END) AS recall, {mse} AS mse, '2026-01-01T00:{i:02d}:00' AS timestamp
  FROM (SELECT v, {r} AS r FROM x WHERE vec_id % {step} = 0)""")
    return f"{X}, runs AS MATERIALIZED ({' UNION ALL '.join(cells)})"


def _reports() -> dict[str, str]:
    runs = f"WITH {_runs()}"
    last = f"{runs}, kept AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY method, bpd ORDER BY timestamp DESC) = 1)"
    bands = ", ".join(f"('{n}', {a}, {b})" for n, a, b in BANDS)
    stats = lambda c: f"round(avg({c}), 9) AS {c}_mean, round(quantile_cont({c}, 0.5), 9) AS {c}_median, round(quantile_cont({c}, 0.95), 9) AS {c}_p95, round(max({c}), 9) AS {c}_max, round(stddev_pop({c}), 9) AS {c}_std"
    scaled = lambda c: f"(avg({c}) - (SELECT min({c}) FROM full_runs)) / (SELECT max({c}) - min({c}) FROM full_runs)"
    return {
        "pareto_frontier": f"{runs} SELECT method, bpd, compression, recall, mse FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.compression > a.compression AND b.recall > a.recall)",
        "radar_normalised": f"{runs}, full_runs AS (SELECT * FROM runs WHERE mse IS NOT NULL) SELECT method, round({scaled('compression')}, 9) AS compression, round({scaled('recall')}, 9) AS recall, round(1 - {scaled('mse')}, 9) AS mse FROM full_runs GROUP BY method",
        "tradeoff_series": f"{runs} SELECT method, CAST(row_number() OVER (PARTITION BY method ORDER BY compression, recall) AS INTEGER) AS position, compression AS x, recall AS y FROM runs",
        "pivot_bpd_method": f"{runs} SELECT bpd, " + ", ".join(f"round(avg(mse) FILTER (WHERE method = '{m}'), 9) AS {m}" for m in ("lvq", "pq", "sq")) + " FROM runs GROUP BY bpd",
        "dedup_keep_last": f"{last} SELECT * FROM kept",
        "best_in_band": f"{runs}, bands(band, low, high) AS (VALUES {bands}) SELECT band, method, compression, recall FROM bands JOIN runs ON compression BETWEEN low AND high QUALIFY row_number() OVER (PARTITION BY band ORDER BY recall DESC, compression DESC, method DESC) = 1",
        "method_ratio": f"{last} SELECT a.bpd, round(a.mse / b.mse, 9) AS ratio, round(a.mse - b.mse, 9) AS delta FROM kept a JOIN kept b ON a.bpd = b.bpd AND a.method = 'pq' AND b.method = 'sq'",
        "monotone_breaks": f"{last}, n AS (SELECT method, bpd, mse AS value, lead(mse) OVER (PARTITION BY method ORDER BY bpd) AS next FROM kept) SELECT * FROM n WHERE next >= value",
        "comparison_table": f"{runs} SELECT method, bpd, printf('%-12s %8.2f %10.4f %12.6f', method, coalesce(compression, 0), coalesce(recall, 0), coalesce(mse, 0)) AS line FROM runs",
        "method_summary": f"{runs} SELECT method, {stats('recall')}, {stats('mse')} FROM runs WHERE mse IS NOT NULL GROUP BY method",
        "run_sanity": f"{runs} SELECT count(*) AS n, count(*) FILTER (WHERE recall IS NULL) AS bad_recall, count(*) FILTER (WHERE mse IS NULL) AS bad_mse, count(*) FILTER (WHERE recall < 0 OR recall > 1) AS recall_out FROM runs",
        "top_runs": f"{runs} SELECT method, bpd, compression, recall, mse FROM runs ORDER BY compression * recall DESC, method, bpd LIMIT 10",
        "ratio_summary": f"{runs} SELECT round(sum(mse * compression) FILTER (WHERE mse IS NOT NULL) / sum(compression), 9) AS weighted, round(avg(mse), 9) AS mean, round(quantile_cont(mse, 0.5), 9) AS median, round(quantile_cont(mse, 0.95), 9) AS p95, round(max(mse), 9) AS max, round(avg(CASE WHEN mse > 1.01 THEN 1.0 WHEN mse IS NOT NULL THEN 0.0 END), 9) AS share_above FROM runs",
        "runlog_metrics": f"""{runs}, log AS (SELECT method, timestamp, CAST(json_object('compression', compression, 'recall', recall, 'rank_distortion@10', mse) AS VARCHAR) AS j FROM runs)
SELECT method, timestamp, CAST(json_extract(j, '$.compression') AS DOUBLE) AS compression, CAST(json_extract(j, '$.recall') AS DOUBLE) AS recall, coalesce(CAST(json_extract(j, '$.absent') AS DOUBLE), -1.0) AS absent, CAST(json_extract(j, '$."rank_distortion@10"') AS DOUBLE) AS rank FROM log""",
    }


def oracle_sql() -> dict[str, str]:
    product = f"WITH {X}, {pq_ctes('x', 8, 16, 2)}"
    ivfpq = f", {pq_ctes('rs', 8, 16, 2)}, pd AS (SELECT vec_id, flatten(list(c ORDER BY code.m)) AS r FROM code JOIN book ON code.m = book.m AND code.idx = book.idx GROUP BY vec_id)"
    ivfsq = """, er AS (SELECT cell, unnest(v) AS u, unnest(range(len(v))) AS d FROM rs),
rg AS (SELECT cell, list(a ORDER BY d) AS mn, list(b ORDER BY d) AS mx FROM (SELECT cell, d, min(u) AS a, max(u) AS b FROM er GROUP BY cell, d) GROUP BY cell),
dr AS (SELECT vec_id, rs.cell, c, list_transform(list_zip(v, mn, mx), lambda p: round_even((p[1] - p[2]) / (p[3] - p[2] + 1e-8) * 255, 0) / 255 * (p[3] - p[2] + 1e-8) + p[2]) AS r FROM rs JOIN rg ON rs.cell = rg.cell)"""
    pairs = f"WITH {X}, {sq_decoded(4)}"
    err = fold(_TERMS["l2"], "v", "r")
    norm_ip = f"WITH {SCALED}, {Q} " + top(f"SELECT qid, vec_id AS id, {_metric('ip')} / greatest(sqrt({fold('p[1] * p[2]', 'x.v', 'x.v')}), 1e-12) AS score FROM q, x", 100, "score DESC")
    dist = lambda a, b: f"sqrt({fold(_TERMS['l2'], a, b)})"
    out = {
        "knn_l2": knn(SCALED, "l2", 100),
        "knn_l2_strips": knn(SCALED, "l2", 100),
        "knn_ip": knn(SCALED, "ip", 100, "score DESC"),
        "knn_normalised_ip": norm_ip,
        "knn_wide": f"SELECT qid, array_to_string(list(id ORDER BY rk), ',') AS ids FROM ({knn(X, 'l2', 100)}) GROUP BY qid",
        "sq8_flat_search": flat_search(sq_decoded(8), "l2"),
        "sq8_flat_search_ip": flat_search(sq_decoded(8), "ip", order="score DESC"),
        "lvq4_flat_search": flat_search(lvq_decoded(4), "l2"),
        "ivf_probe": f"WITH {X}, {Q}, {kmeans_ctes(CELLS, 3)}, {probe()} SELECT qid, CAST(rk - 1 AS INTEGER) AS rk, cell FROM pr",
        "ivf_flat_search": ivf("", f"SELECT vec_id, cell, {PLUS_C.format(r='v')} AS r FROM rs"),
        "ivf_sq_search": ivf(ivfsq, f"SELECT vec_id, cell, {PLUS_C.format(r='r')} AS r FROM dr"),
        "ivfpq_search": ivf(ivfpq, f"SELECT rs.vec_id, cell, {PLUS_C.format(r='pd.r')} AS r FROM rs JOIN pd ON rs.vec_id = pd.vec_id"),
        "ivf_pq_per_cell_search": pq_per_cell(),
        "ivf_pq_per_cell_tables": pq_per_cell(),
        "ivf_flat_search_strips": ivf("", f"SELECT vec_id, cell, {PLUS_C.format(r='v')} AS r FROM rs"),
        "adc_pq_search": adc_pq("l2"),
        "adc_pq_search_ip": adc_pq("ip"),
        "adc_sq4_search": adc_sq4(),
        "adc_ivfpq_search": adc_ivfpq("l2"),
        "adc_ivfpq_search_ip": adc_ivfpq("ip"),
        "knn_metric_gower": GOWER,
        "kmeans_spread": kmeans_spread(CELLS, 2),
        "kmeans_grouped": KMEANS_GROUPED,
        "ivf_flat_search_ip": ivf("", f"SELECT vec_id, cell, {PLUS_C.format(r='v')} AS r FROM rs", metric="ip"),
        "ivf_saved_search": ivf("", f"SELECT vec_id, cell, {PLUS_C.format(r='v')} AS r FROM rs"),
        "rabitq_search": _rabitq_search("l2"),
        "rabitq_search_ip": _rabitq_search("ip"),
        "rabitq_ivf_search": _rabitq_ivf("l2"),
        "rabitq_ivf_search_ip": _rabitq_ivf("ip"),
        "saq_grid_search": _grid_search("l2"),
        "saq_grid_search_ip": _grid_search("ip"),
        "saq_adjusted_codes": saq_adjusted(),
        "saq_blocks": saq_blocks(),
        "kmeans1d_lloyd": _lloyd_levels(8),
        "kmeans1d_exact": _optimal_levels(8),
        "kmeans1d_histogram": _optimal_levels(8, binned=True),
        "saq_block_factors": saq_factors(),
        "saq_staged_search": _grid_search("l2"),
        "saq_staged_search_ip": _grid_search("ip"),
        "saq_grid_search_pruned": _grid_search("l2", True),
        "saq_grid_decode": f"WITH {TAPERED}, {_grid(3 * DIMS // 16)} SELECT vec_id, CAST(d AS INTEGER) AS d, round(point * scale + mu[d + 1], 6) AS x FROM sg, mu",
        "lvq4_packed": f"WITH {X}, {lvq_levels(4)} SELECT vec_id, array_to_string(list_transform(l, lambda c: printf('%X', CAST(c AS INTEGER))), '') AS code FROM lv",
        "reconstruct_ids": elements(sq_decoded(8)) + " WHERE vec_id % 3 = 1",
        "codebook_export": f"WITH {TAPERED}, {E}, lim AS (SELECT d, min(x) AS a, max(x) AS b FROM e GROUP BY d) SELECT CAST(0 AS BIGINT) AS row, CAST(d AS INTEGER) AS d, round(CAST(CAST(a AS FLOAT) AS DOUBLE), 5) AS x FROM lim UNION ALL SELECT 1, CAST(d AS INTEGER), round(CAST(CAST(b AS FLOAT) AS DOUBLE), 5) FROM lim",
        "rotation_lengths": f"WITH {SCALED} SELECT vec_id, round(sqrt({fold('p[1] * p[2]', 'v', 'v')}), 8) AS length FROM x",
        "pca_invariants": f"WITH {TAPERED}, {E}, cv AS (SELECT a.d AS i, b.d AS j, covar_pop(a.x, b.x) AS c FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY a.d, b.d) SELECT round(sum(c) FILTER (WHERE i = j), 8) AS trace, round(sum(c * c), 8) AS square, CAST(0 AS DOUBLE) AS off, CAST(0 AS DOUBLE) AS skew, true AS falling FROM cv",
        "packing_bytes": f"SELECT CAST(w AS INTEGER) AS width, CAST(ceil({DIMS} * w / 8.0) AS INTEGER) AS dense, CAST(ceil({DIMS} / (8 // w)) AS INTEGER) AS first_fit, CAST(ceil({DIMS} / (8 // w)) AS INTEGER) AS optimal FROM range(1, 9) t(w)",
        "segment_plan_joint": f"WITH {TAPERED}, {_block_bits(3 * DIMS // 16)} SELECT CAST(block AS INTEGER) AS block, CAST(bits AS INTEGER) AS bits FROM bl",
        "segment_plan_greedy": f"WITH {TAPERED}, {_block_bits(3 * DIMS // 16)} SELECT CAST(block AS INTEGER) AS block, CAST(bits AS INTEGER) AS bits FROM bl",
        "alloc_empirical": _alloc("var", [float(t) for t in allocation.normal_distortion()], 3 * DIMS, ""),
        "alloc_measured_greedy": _measured_greedy(2 * DIMS),
        "alloc_measured_optimal": _measured_optimal(2 * DIMS),
        "alloc_optimal": _alloc("var", [float(t) for t in allocation.normal_distortion()], 3 * DIMS, ""),
        "bit_rules": f"""SELECT CAST(dims AS INTEGER) AS dims, bpd, {_divisor('CAST(round_even(bpd * dims, 0) AS BIGINT) // 8')} AS m, {_divisor('dims * CAST(floor(bpd) AS BIGINT) // 8')} AS m_floor,
  CAST(greatest(1, least(dims, CAST(floor(bpd * dims) AS BIGINT) // 8)) AS INTEGER) AS m_clamped, {_divisor('CAST(floor(bpd * dims) AS BIGINT) // 8')} AS m_divisor,
  CASE WHEN bpd <= 4.5 THEN 4 WHEN bpd <= 12 THEN 8 ELSE 16 END AS bits, CASE WHEN bpd IN (4, 8, 16) THEN CAST(bpd AS INTEGER) ELSE 8 END AS bits_exact
FROM (SELECT unnest(range(1, max(len(embedding)) + 1)) AS dims FROM embeddings) a, (SELECT CAST(bpd AS DOUBLE) AS bpd FROM (VALUES (0.5), (1.0), (2.0), (3.0), (4.0), (8.0), (16.0)) t(bpd))""",
        "codebook_exact_1bit": _two_levels("w AS (SELECT d, x, count(*) AS n FROM e GROUP BY d, x)"),
        "codebook_histogram_1bit": _two_levels(BINNED),
        "codebook_lloyd_1bit": _two_lloyd(),
        "ivecs_roundtrip": f"WITH {X}, {E} SELECT vec_id, CAST(d AS INTEGER) AS d, CAST(round(x * 1000) AS INTEGER) AS x FROM e",
        "collection_read": "SELECT doc_id, length(t) AS n, md5(t) AS hash FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\t\\r\\n]', ' ', 'g') AS t FROM documents WHERE doc_id % 7 <> 0)",
        "text_column": "SELECT md5(text) AS hash FROM documents",
        "ffd_layout": _first_fit(),
        "numbered_vectors": f"WITH {X}, {E} SELECT row_number() OVER (PARTITION BY d ORDER BY vec_id) - 1 AS vec_id, CAST(d AS INTEGER) AS d, x FROM e",
        "truth_cached": knn(SCALED, "ip", 10, "score DESC"),
        "study_resumed": f"SELECT method, bpd, code_bytes, mse, recall_at_1, recall_at_10, recall_at_100 FROM ({_study()}) WHERE bpd = 8",
        "bench_lvq_flat": bench("lvq_flat", f"WITH {X}, {Q}, {lvq_decoded(4)} " + top(f"SELECT qid, dec.vec_id AS id, {_metric('l2', 'q.q', 'dec.r')} AS score FROM q, dec", 10), DIMS // 2 + 8, 4.0 * DIMS / (DIMS // 2 + 8)),
        "bench_rabitq": bench("rabitq", _rabitq_search("l2"), DIMS // 8 + 8, 4.0 * DIMS / (DIMS // 8 + 8)),
        "codebook_export_pq": f"WITH {TAPERED}, {pq_ctes('x', 8, 16, 2)} SELECT CAST(m * 16 + idx AS BIGINT) AS row, CAST(unnest(range(8)) AS INTEGER) AS d, round(CAST(CAST(unnest(c) AS FLOAT) AS DOUBLE), 5) AS x FROM book",
        "bench_sq_flat": recall(f"SELECT 'sq_flat' AS method, round(sum(hits) / CAST(sum(least(k, n_truth)) AS DOUBLE), 9) AS recall, (SELECT count(*) FROM x) * {DIMS // 2} AS memory_bytes, 8.0 AS compression_ratio, 10 AS k, (SELECT count(*) FROM x) AS n FROM h WHERE k = 10"),
        "streaming_first_rows": f"WITH {X}, {sq_decoded(4).replace(E, 'e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM (SELECT * FROM x ORDER BY vec_id LIMIT 100))')} SELECT round(avg({err}), 9) AS distortion, count(*) AS n FROM dec",
        "streaming_trained": f"WITH {X}, {sq_decoded(4).replace(E, 'e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM (SELECT * FROM x ORDER BY vec_id LIMIT 100))')} SELECT round(avg({err}), 9) AS distortion, count(*) AS n FROM dec",
        "codebook_query": f"{product}, {Q}, qm AS (SELECT qid, m, list_slice(q, m * 8 + 1, m * 8 + 8) AS p FROM q, range(8) t(m)), sc AS (SELECT qid, qm.m, idx + 16 * qm.m AS id, {_metric('l2', 'p', 'c')} AS score FROM qm JOIN book ON qm.m = book.m) SELECT qid, CAST(m AS INTEGER) AS m, CAST(rk AS INTEGER) AS rk, id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid, m ORDER BY score, id) AS rk FROM sc) WHERE rk <= 2",
        "sq4_encode_packed": sq_encode(4),
        "sq8_encode": sq_encode(8),
        "sq16_encode": sq_encode(16),
        "sq4_decode": elements(sq_decoded(4)),
        "sq8_decode": elements(sq_decoded(8)),
        "lvq2_encode": lvq_encode(2),
        "lvq4_encode": lvq_encode(4),
        "lvq8_encode": lvq_encode(8),
        "lvq4_decode": elements(lvq_decoded(4), places=6),
        "kmeans_assign": f"WITH {X}, {kmeans_ctes(8, 3)} SELECT vec_id, CAST(cell AS INTEGER) AS cell, round(dist, 9) AS dist FROM asg",
        "pq_codes": f"{product} SELECT vec_id, CAST(m AS INTEGER) AS m, idx FROM code",
        "pq_decode": f"{product} SELECT vec_id, CAST(m * 8 + i AS INTEGER) AS d, round(u, 9) AS x FROM (SELECT vec_id, code.m, unnest(c) AS u, unnest(range(8)) AS i FROM code JOIN book ON code.m = book.m AND code.idx = book.idx)",
        "rabitq1_codes": f"WITH {X}, {SIGNS} SELECT vec_id, array_to_string(bits, '') AS bits, round(norm2, 5) AS norm2, round(factor, 5) AS factor FROM rf",
        "extrabitq4_decode": _extended(),
        "dim_stats": f"WITH {TAPERED}, {E} SELECT CAST(d AS INTEGER) AS d, round(min(x), 9) AS mn, round(max(x), 9) AS mx, round(avg(x), 9) AS mean, round(var_pop(x), 9) AS var FROM e GROUP BY d",
        "mean_cov": f"WITH {TAPERED}, {E} SELECT CAST(a.d AS INTEGER) AS i, CAST(b.d AS INTEGER) AS j, round(covar_pop(a.x, b.x), 8) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY a.d, b.d",
        "alloc_greedy": _alloc("power(var, 1.5)", [float(t) for t in allocation.normal_distortion()], 3 * DIMS, ""),
        "alloc_bennett_rescore": _alloc("var", [0.5**b for b in range(9)], 3 * DIMS, ", round(var * dist, 9) AS cost"),
        "histogram_bins": f"WITH {TAPERED}, {E}, lim AS (SELECT d, min(x) AS a, max(x) AS b FROM e GROUP BY d) SELECT CAST(e.d AS INTEGER) AS d, CAST(least(floor((x - a) / ((b - a) / 500)), 499) AS INTEGER) AS bin, count(*) AS n FROM e JOIN lim ON e.d = lim.d GROUP BY 1, 2",
        "recall_sweep": recall("SELECT k, round(avg(hits / CAST(k AS DOUBLE)), 9) AS recall FROM h GROUP BY k"),
        "recall_study": recall("SELECT k, round(avg(hits / CAST(least(k, n_found, n_truth) AS DOUBLE)), 9) AS recall FROM h GROUP BY k"),
        "recall_bench": recall("SELECT k, round(sum(hits) / CAST(sum(least(k, n_truth)) AS DOUBLE), 9) AS recall FROM h GROUP BY k"),
        "recall_ivf": recall("SELECT k, round(sum(hits) / CAST(count(*) * k AS DOUBLE), 9) AS recall FROM h GROUP BY k"),
        "rank_distortion": recall("SELECT k, round(sum(n_truth - hits) / CAST(count(*) * k AS DOUBLE), 9) AS rank_distortion FROM h GROUP BY k"),
        "rank_distortion_per_query": recall("SELECT qid, (n_truth - hits) / 10.0 AS rank_distortion FROM h WHERE k = 10"),
        "distortion_per_vector": f"{pairs} SELECT round(avg({err}), 9) AS distortion, count(*) AS n FROM dec",
        "mse_per_element": f"{pairs} SELECT round(sum({err}) / (count(*) * {DIMS}), 11) AS mse FROM dec",
        "streaming_distortion": f"{pairs} SELECT round(avg({err}), 9) AS distortion, count(*) AS n FROM dec",
        "pairwise_distortion": f"""{pairs}, l AS (SELECT vec_id AS i, (vec_id * 7919 + 13) % (SELECT count(*) FROM dec) AS j FROM dec),
er AS (SELECT abs({dist('a.r', 'b.r')} / ({dist('a.v', 'b.v')} + 1e-10) - 1) AS e FROM l JOIN dec a ON a.vec_id = i JOIN dec b ON b.vec_id = j WHERE i <> j)
SELECT round(avg(e), 9) AS mean, round(quantile_cont(e, 0.5), 9) AS median, round(quantile_cont(e, 0.95), 9) AS p95, round(max(e), 9) AS max, round(stddev_pop(e), 9) AS std, count(*) AS num_pairs FROM er""",
        "memory_footprint": "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT kind, CAST(bytes AS BIGINT) AS bytes FROM n, LATERAL (VALUES ('flat', n * 32), ('ivf', 16 * 64 * 4 + n * 32), ('ivfpq', 16 * 64 * 4 + n * 32 + 64 * 256 * 4), ('rabitq', n * 32), ('rabitq_ivf', n * 32 + 8 * n + 16 * 64 * 4), ('saq', n * 64 * 4 // 8 + 16 * 64 * 4)) t(kind, bytes)",
        "compression_factor": f"SELECT CAST(bits AS INTEGER) AS bits, CAST(n * {DIMS} * bits // 8 AS BIGINT) AS code_bytes, CAST(n * ({DIMS} * bits // 8 + 4) AS BIGINT) AS code_bytes_with_norm, 4.0 * {DIMS} * n / (n * {DIMS} * bits // 8) AS factor FROM (SELECT count(*) AS n FROM embeddings), (VALUES (4), (8), (16)) t(bits)",
        "study_sq_lvq": _study(),
        "holdout_split": f"SELECT vec_id, CASE WHEN vec_id < (SELECT max(vec_id) + 1 - {HELD_OUT} FROM embeddings) THEN 'base' ELSE 'query' END AS side FROM embeddings",
        "base_query_split": "SELECT vec_id, CASE WHEN vec_id < (SELECT count(*) * 4 // 5 FROM embeddings) THEN 'base' ELSE 'query' END AS side FROM embeddings",
        "fvecs_roundtrip": f"WITH {X}, {E} SELECT vec_id, CAST(d AS INTEGER) AS d, x FROM e",
    }
    out |= {f"knn_metric_{m}": knn(HOLES if m == "nan_euclidean" else SCALED, m, 10, places=9) for m in METRIC_TERMS}
    return out | _reports()
