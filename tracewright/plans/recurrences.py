"""DuckDB SQL of what runs in kernels here: alignments and bounds as recursive queries, orientations as plain expressions.

Dynamic programs go along anti-diagonals: a recursive step computes one diagonal of every pair of sequences, and a second
recursion walks back. Lists are numbered from 1, and an index of 0 is NULL, which least() and greatest() leave out.
"""

from __future__ import annotations

HOUR = "(floor(epoch_us(ts) / 1000000)::BIGINT % 86400) / 3600.0"
INF = "'infinity'::DOUBLE"

#: Even events as nominal and odd ones as measured points of a user: x, y (points), xs, ys (segments), m, n.
SIDES = f"""sides AS (SELECT user_id, event_id % 2 AS side, list([value, {HOUR}, (event_id % 100)::DOUBLE] ORDER BY ts, event_id) AS s, list(event_type ORDER BY ts, event_id) AS g FROM events GROUP BY ALL),
  xy AS (SELECT a.user_id, a.s AS x, b.s AS y, a.g AS xs, b.g AS ys, len(a.s) AS m, len(b.s) AS n FROM sides a JOIN sides b ON a.user_id = b.user_id AND a.side = 0 AND b.side = 1)"""

#: All sequences of the users, and pairs of those divisible by 50 with the others.
PAIRS = f"""seqs AS (SELECT user_id AS id, list([value, {HOUR}, (event_id % 100)::DOUBLE] ORDER BY ts, event_id) AS seq FROM events GROUP BY 1),
  pairs AS (SELECT q.id AS query_id, s.id, q.seq AS a, s.seq AS b, len(q.seq) AS n, len(s.seq) AS m FROM seqs q, seqs s WHERE q.id % 50 = 0 AND q.id <> s.id)"""


def gap(p: str, q: str) -> str:
    """Euclidean distance of two points."""
    return "sqrt(" + " + ".join(f"({p}[{k}] - {q}[{k}]) * ({p}[{k}] - {q}[{k}])" for k in (1, 2, 3)) + ")"


LOCAL = f"local AS (SELECT user_id, m, n, list_transform(x, lambda p: list_transform(y, lambda q: {gap('p', 'q')})) AS d FROM xy)"


def angle(p: str, q: str) -> str:
    """Degrees between two unit quaternions, from the vector and the scalar of the rotation between them."""
    w = f"{p}[1] * {q}[1] + {p}[2] * {q}[2] + {p}[3] * {q}[3] + {p}[4] * {q}[4]"
    v = (f"{p}[1] * {q}[2] - {p}[2] * {q}[1] - {p}[3] * {q}[4] + {p}[4] * {q}[3]", f"{p}[1] * {q}[3] + {p}[2] * {q}[4] - {p}[3] * {q}[1] - {p}[4] * {q}[2]", f"{p}[1] * {q}[4] - {p}[2] * {q}[3] + {p}[3] * {q}[2] - {p}[4] * {q}[1]")
    return f"2 * degrees(atan2(sqrt({' + '.join(f'({c}) * ({c})' for c in v)}), abs({w})))"


ANGLES = f"local AS (SELECT user_id, m, n, list_transform(x, lambda p: list_transform(y, lambda q: round({angle('p', 'q')}, 9))) AS d FROM xy)"
MOVES = {"up": ("i - 1", "j"), "left": ("i", "j - 1"), "diagonal": ("i - 1", "j - 1")}


def path(combine: str = "{c} + {before}", first: str = "d[1][1]", order: tuple = ("up", "left", "diagonal")) -> str:
    """local(user_id, m, n, d) -> walk(user_id, i, j, k): the cheapest path, counted from its end; done(…, diags) has its costs."""
    step = combine.format(c="d[i + 1][s + 1 - i + 1]", before="least(diags[s + 1][i], diags[s + 1][i + 1], diags[s][i])")
    at = lambda i, j: f"coalesce(done.diags[{i} + {j} + 1][{i} + 1], {INF})"
    costs = {m: f"CASE WHEN walk.i >= {int('i - 1' in MOVES[m][0])} AND walk.j >= {int('j - 1' in MOVES[m][1])} THEN " + at(*("(" + x.replace("i", "walk.i").replace("j", "walk.j") + ")" for x in MOVES[m])) + f" ELSE {INF} END" for m in MOVES}
    a, b, c = (costs[m] for m in order)
    pick = lambda index: f"CASE WHEN {a} <= {b} AND {a} <= {c} THEN {MOVES[order[0]][index]} WHEN {b} <= {c} THEN {MOVES[order[1]][index]} ELSE {MOVES[order[2]][index]} END".replace("THEN i", "THEN walk.i").replace("THEN j", "THEN walk.j").replace("ELSE i ", "ELSE walk.i ").replace("ELSE j ", "ELSE walk.j ")
    return f"""acc AS (SELECT user_id, m, n, d, 0 AS s, [list_transform(range(m), lambda i: CASE WHEN i = 0 THEN {first} ELSE {INF} END)] AS diags FROM local
    UNION ALL SELECT user_id, m, n, d, s + 1, list_append(diags, list_transform(range(m), lambda i: CASE WHEN s + 1 - i BETWEEN 0 AND n - 1 THEN {step} ELSE {INF} END)) FROM acc WHERE s + 1 < m + n - 1),
  done AS (SELECT * FROM acc WHERE s = m + n - 2),
  walk AS (SELECT user_id, m - 1 AS i, n - 1 AS j, 0::BIGINT AS k FROM done UNION ALL SELECT walk.user_id, {pick(0)}, {pick(1)}, walk.k + 1 FROM walk JOIN done USING (user_id) WHERE walk.i > 0 OR walk.j > 0)"""


def aligned(seg: str, value: str) -> str:
    """Rows of an alignment query from walk and local."""
    return f"""SELECT user_id AS traj_id, {seg} AS seg_id, max(k) OVER u - k + 1 AS points_order, round(d[i + 1][j + 1], 6) AS distance, round({value}, 6) AS value, 'ok' AS status
  FROM walk JOIN local USING (user_id) JOIN (SELECT user_id, xs, ys FROM xy) USING (user_id) JOIN (SELECT user_id, diags, s FROM done) USING (user_id) WINDOW u AS (PARTITION BY user_id)"""


DTW = f"WITH RECURSIVE {SIDES}, {LOCAL}, {path(first='0.0')} {aligned('xs[i + 1]', 'avg(d[i + 1][j + 1]) OVER u')}"
FRECHET = f"WITH RECURSIVE {SIDES}, {LOCAL}, {path('greatest({c}, {before})', order=('up', 'diagonal', 'left'))} {aligned('xs[i + 1]', 'diags[s + 1][m]')}"


_CLAMPED = "least(1.0, greatest(0.0, coalesce(((q[1] - x[e][1]) * (x[e + 1][1] - x[e][1]) + (q[2] - x[e][2]) * (x[e + 1][2] - x[e][2]) + (q[3] - x[e][3]) * (x[e + 1][3] - x[e][3])) / nullif(pow(x[e + 1][1] - x[e][1], 2) + pow(x[e + 1][2] - x[e][2], 2) + pow(x[e + 1][3] - x[e][3], 2), 0), 0)))"
_TO_EDGE = f"list_transform(range(1, m), lambda e: sqrt(pow(q[1] - x[e][1] - {_CLAMPED} * (x[e + 1][1] - x[e][1]), 2) + pow(q[2] - x[e][2] - {_CLAMPED} * (x[e + 1][2] - x[e][2]), 2) + pow(q[3] - x[e][3] - {_CLAMPED} * (x[e + 1][3] - x[e][3]), 2)))"
LCSS = f"""WITH RECURSIVE {SIDES}, {LOCAL}, eps AS (SELECT user_id, 1.5 * list_max(list_transform(y, lambda q: least({gap('q', 'x[1]')}, list_min({_TO_EDGE})))) AS eps FROM xy),
  acc AS (SELECT user_id, m, n, d, eps, 0 AS s, [list_transform(range(m), lambda i: (i = 0 AND d[1][1] <= eps)::BIGINT)] AS diags FROM local JOIN eps USING (user_id)
    UNION ALL SELECT user_id, m, n, d, eps, s + 1, list_append(diags, list_transform(range(m), lambda i: CASE WHEN s + 1 - i NOT BETWEEN 0 AND n - 1 THEN 0 WHEN d[i + 1][s + 2 - i] <= eps THEN coalesce(diags[s][i], 0) + 1
      ELSE greatest(diags[s + 1][i], diags[s + 1][i + 1]) END)) FROM acc WHERE s + 1 < m + n - 1),
  done AS (SELECT * FROM acc WHERE s = m + n - 2),
  walk AS (SELECT user_id, m - 1 AS i, n - 1 AS j, 0::BIGINT AS k FROM done
    UNION ALL SELECT user_id, CASE WHEN hit OR up > left_ THEN i - 1 ELSE i END, CASE WHEN hit OR up <= left_ THEN j - 1 ELSE j END, k + 1
      FROM (SELECT walk.*, d[i + 1][j + 1] <= eps AS hit, CASE WHEN i > 0 THEN coalesce(diags[i + j][i], 0) ELSE 0 END AS up, CASE WHEN j > 0 THEN coalesce(diags[i + j][i + 1], 0) ELSE 0 END AS left_ FROM walk JOIN done USING (user_id) WHERE i >= 0 AND j >= 0)),
  hits AS (SELECT user_id, i, j, ys[j + 1] AS seg, d[i + 1][j + 1] AS distance, diags[s + 1][m]::DOUBLE / least(m, n) AS score, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS points_order
    FROM walk JOIN done USING (user_id) JOIN (SELECT user_id, ys FROM xy) USING (user_id) WHERE i >= 0 AND j >= 0 AND d[i + 1][j + 1] <= eps)
  SELECT user_id AS traj_id, seg AS seg_id, points_order, round(distance, 6) AS distance, round(score, 6) AS value, 'ok' AS status FROM hits"""


def _dot4(p: str, q: str) -> str:
    return "(" + " + ".join(f"{p}[{k}] * {q}[{k}]" for k in (1, 2, 3, 4)) + ")"


def _unit4(p: str) -> str:
    return f"list_transform({p}, lambda c: c / sqrt({_dot4(p, p)}))"


def _slerp(source: str, keep: str, parallel: str) -> str:
    """source(…, p, q, t) -> keep, o: unit quaternion between unit quaternions."""
    return f"""SELECT {keep}, {_unit4('o')} AS o FROM (SELECT *, [a * p[1] + b * q[1], a * p[2] + b * q[2], a * p[3] + b * q[3], a * p[4] + b * q[4]] AS o FROM (SELECT *, CASE WHEN c > {parallel} THEN 1 - t ELSE sin((1 - t) * acos(c)) / sin(acos(c)) END AS a,
      sign * CASE WHEN c > {parallel} THEN t ELSE sin(t * acos(c)) / sin(acos(c)) END AS b FROM (SELECT *, CASE WHEN {_dot4('p', 'q')} < 0 THEN -1 ELSE 1 END AS sign, least(abs({_dot4('p', 'q')}), 1.0) AS c FROM {source})))"""


#: Nominal orientations without jumps: every run of steps over 1.5 degrees, and ten rows after it, becomes an arc.
TURNED = f"""turns AS (SELECT user_id, event_id, event_id % 2 AS side, ts, event_type, radians(value % 100) AS t FROM events),
  rows_ AS (SELECT user_id, side, event_type, row_number() OVER (PARTITION BY user_id, side ORDER BY ts, event_id) - 1 AS i, [cos(t / 2), sin(t / 2) * 0.6, sin(t / 2) * 0.8, 0.0] AS q FROM turns),
  units AS (SELECT user_id, side, event_type, i, q, {_unit4('q')} AS u FROM rows_),
  steps AS (SELECT user_id, i, 2 * acos(least(abs({_dot4('u', 'w')}), 1.0)) > radians(1.5) AS jump FROM (SELECT *, lead(u) OVER (PARTITION BY user_id ORDER BY i) AS w FROM units WHERE side = 0) WHERE w IS NOT NULL),
  runs AS (SELECT user_id, greatest(0, min(i) - 1) AS lo, max(i) + 10 AS hi FROM (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM steps WHERE jump) GROUP BY user_id, run),
  ends AS (SELECT user_id, max(i) AS last FROM units WHERE side = 0 GROUP BY 1),
  covered AS (SELECT z.user_id, z.i, arg_max(r.lo, r.lo) AS lo, arg_max(least(r.hi, last), r.lo) AS hi FROM units z JOIN ends USING (user_id) JOIN runs r ON r.user_id = z.user_id AND z.side = 0 AND z.i > r.lo AND z.i < least(r.hi, last) GROUP BY ALL),
  arcs AS (SELECT c.user_id, c.i, a.u AS p, b.u AS q, (c.i - lo) / (hi - lo)::DOUBLE AS t FROM covered c JOIN units a ON a.user_id = c.user_id AND a.side = 0 AND a.i = lo JOIN units b ON b.user_id = c.user_id AND b.side = 0 AND b.i = hi),
  mended AS ({_slerp('arcs', 'user_id, i', 'cos(1e-6)')}),
  nominal AS (SELECT user_id, event_type, i, {_unit4('coalesce(o, q)')} AS u FROM units LEFT JOIN mended USING (user_id, i) WHERE side = 0),
  measured AS (SELECT user_id, event_type, i, u FROM units WHERE side = 1),
  xy AS (SELECT * FROM (SELECT user_id, list(u ORDER BY i) AS x, list(event_type ORDER BY i) AS xs, count(*) AS m FROM nominal GROUP BY 1) JOIN (SELECT user_id, list(u ORDER BY i) AS y, list(event_type ORDER BY i) AS ys, count(*) AS n FROM measured GROUP BY 1) USING (user_id))"""

QDTW = f"WITH RECURSIVE {TURNED}, {ANGLES}, {path()} " + aligned("ys[j + 1]", "avg(d[i + 1][j + 1]) OVER u").replace("d[i + 1][j + 1]", angle("x[i + 1]", "y[j + 1]")).replace("SELECT user_id, xs, ys FROM xy", "SELECT user_id, x, y, xs, ys FROM xy").replace(", 6) AS", ", 8) AS")
QAD = f"""WITH {TURNED}, places AS (SELECT user_id, i, ys[i + 1] AS seg, y[i + 1] AS w, x, m, CASE WHEN n = 1 OR i = n - 1 THEN m - 1 ELSE i * ((m - 1) / (n - 1)::DOUBLE) END AS pos FROM (SELECT *, unnest(range(n)) AS i FROM xy)),
  two AS (SELECT user_id, i, seg, w, x[floor(pos)::BIGINT + 1] AS p, x[least(ceil(pos)::BIGINT, m - 1) + 1] AS q, pos - floor(pos) AS t FROM places),
  between_ AS ({_slerp('two', 'user_id, i, seg, w', '0.9995')}),
  angle AS (SELECT *, {angle('o', 'w')} AS d FROM between_)
  SELECT user_id AS traj_id, seg AS seg_id, i + 1 AS points_order, round(d, 8) AS distance, round(avg(d) OVER (PARTITION BY user_id), 8) AS value, 'ok' AS status FROM angle"""


def band(pairs: str = "pairs", window: float = 0.15) -> str:
    """cdtw(query_id, id, distance): constrained DTW of pairs (a, b, n, m) without their first points."""
    inside = f"abs(s + 1 - i + 1 - floor((i + 1) * m / n::DOUBLE + 0.5)) <= reach"
    return f"""moved AS (SELECT query_id, id, n, m, greatest(floor(greatest(n, m) * {window} + 0.5), abs(n - m)) AS reach, list_transform(a, lambda p: [p[1] - a[1][1], p[2] - a[1][2], p[3] - a[1][3]]) AS a, list_transform(b, lambda p: [p[1] - b[1][1], p[2] - b[1][2], p[3] - b[1][3]]) AS b FROM {pairs}),
  narrow AS (SELECT query_id, id, n, m, reach, a, b, 0 AS s, list_transform(range(n), lambda i: {INF}) AS before, list_transform(range(n), lambda i: CASE WHEN i = 0 AND abs(1 - floor(m / n::DOUBLE + 0.5)) <= reach THEN 0.0 ELSE {INF} END) AS now FROM moved
    UNION ALL SELECT query_id, id, n, m, reach, a, b, s + 1, now, list_transform(range(n), lambda i: CASE WHEN s + 1 - i BETWEEN 0 AND m - 1 AND {inside} THEN {gap('a[i + 1]', 'b[s + 1 - i + 1]')} + least(now[i], now[i + 1], before[i]) ELSE {INF} END) FROM narrow WHERE s + 1 < n + m - 1),
  cdtw AS (SELECT query_id, id, now[n] AS distance FROM narrow WHERE s = n + m - 2)"""


CDTW = f"WITH RECURSIVE {PAIRS}, {band()} SELECT query_id, id, round(distance, 6) AS distance FROM cdtw"

#: pchip(query_id, id, t, v): each sequence b of a pair, shape-preserving cubic at n even places, by dimension.
PCHIP = """cells AS (SELECT query_id, id, n, m, dim, unnest(range(m)) AS i, unnest(list_transform(b, lambda p: p[dim])) AS y FROM pairs, (SELECT unnest([1, 2, 3]) AS dim)),
  deltas AS (SELECT *, y - lag(y) OVER w AS d0, lead(y) OVER w - y AS d1, lead(y, 2) OVER w - lead(y) OVER w AS d2, lag(y) OVER w - lag(y, 2) OVER w AS dm FROM cells WINDOW w AS (PARTITION BY query_id, id, dim ORDER BY i)),
  ending AS (SELECT *, CASE WHEN i = 0 THEN d1 ELSE d0 END AS a_, CASE WHEN i = 0 THEN d2 ELSE dm END AS b_ FROM deltas),
  slopes AS (SELECT query_id, id, n, m, dim, i, y, CASE WHEN m = 2 THEN a_ WHEN i > 0 AND i < m - 1 THEN CASE WHEN d0 * d1 > 0 THEN 2 * d0 * d1 / (d0 + d1) ELSE 0.0 END
      WHEN (3 * a_ - b_) / 2 * a_ <= 0 THEN 0.0 WHEN a_ * b_ < 0 AND abs((3 * a_ - b_) / 2) > 3 * abs(a_) THEN 3 * a_ ELSE (3 * a_ - b_) / 2 END AS h FROM ending),
  hermite AS (SELECT query_id, id, dim, t, s, y0, y1, h0, h1 FROM (SELECT *, pos - i AS s FROM (SELECT query_id, id, n, m, dim, i, y AS y0, lead(y) OVER w AS y1, h AS h0, lead(h) OVER w AS h1 FROM slopes WINDOW w AS (PARTITION BY query_id, id, dim ORDER BY i))
      JOIN (SELECT query_id, id, t, CASE WHEN t = n - 1 THEN m - 1 ELSE t * ((m - 1) / (n - 1)::DOUBLE) END AS pos, least(floor(CASE WHEN t = n - 1 THEN m - 1 ELSE t * ((m - 1) / (n - 1)::DOUBLE) END)::BIGINT, m - 2) AS i FROM (SELECT query_id, id, n, m, unnest(range(n)) AS t FROM pairs)) USING (query_id, id, i))),
  curve AS (SELECT query_id, id, dim, t, (1 + 2 * s) * (1 - s) * (1 - s) * y0 + s * (1 - s) * (1 - s) * h0 + s * s * (3 - 2 * s) * y1 + s * s * (s - 1) * h1 AS v FROM hermite),
  asked AS (SELECT query_id, id, dim, unnest(range(n)) AS t, unnest(list_transform(a, lambda p: p[dim])) AS q FROM pairs, (SELECT unnest([1, 2, 3]) AS dim)),
  both_ AS (SELECT * FROM asked JOIN curve USING (query_id, id, dim, t))"""

KIM_CTE = f"""{PCHIP}, fours AS (SELECT query_id, id, dim, pow(arg_min(q, t) - arg_min(v, t), 2) AS f, pow(arg_max(q, t) - arg_max(v, t), 2) AS l, pow(min(q) - min(v), 2) AS lo, pow(max(q) - max(v), 2) AS hi FROM both_ GROUP BY ALL),
  kim AS (SELECT query_id, id, sqrt(greatest(sum(f), sum(l), sum(lo), sum(hi))) AS bound FROM fours GROUP BY ALL)"""


def keogh(window: float) -> str:
    """keogh(query_id, id, bound) from both_."""
    span = "(PARTITION BY query_id, id, dim ORDER BY t)"
    reach = f"floor(n * {window} + 0.5)::BIGINT"
    return f"""sized AS (SELECT both_.*, n, {reach} AS reach FROM both_ JOIN (SELECT query_id, id, n FROM pairs) USING (query_id, id)),
  around AS (SELECT query_id, id, dim, t, q, list_max(list_slice(vs, greatest(1, t + 1 - reach), t + 1 + reach)) AS hi, list_min(list_slice(vs, greatest(1, t + 1 - reach), t + 1 + reach)) AS lo FROM (SELECT *, list(v) OVER {span[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS vs FROM sized)),
  keogh AS (SELECT query_id, id, sqrt(sum(CASE WHEN q > hi THEN pow(q - hi, 2) WHEN q < lo THEN pow(q - lo, 2) ELSE 0 END)) AS bound FROM around GROUP BY ALL)"""


KIM = f"WITH {PAIRS}, {KIM_CTE} SELECT query_id, id, round(bound, 6) AS bound FROM kim"
KEOGH = f"WITH {PAIRS}, {PCHIP}, {keogh(0.15)} SELECT query_id, id, round(bound, 6) AS distance FROM keogh"
RESAMPLED = f"""WITH {PAIRS}, spots AS (SELECT *, CASE WHEN t = n - 1 THEN m - 1 ELSE t * ((m - 1) / (n - 1)::DOUBLE) END AS pos FROM (SELECT *, unnest(range(n)) AS t FROM pairs)),
  lows AS (SELECT *, floor(pos)::BIGINT AS low, least(floor(pos)::BIGINT + 1, m - 1) AS high FROM spots),
  points AS (SELECT query_id, id, {', '.join(f'a[t + 1][{k}] - a[1][{k}] - (b[low + 1][{k}] + (pos - low) * (b[high + 1][{k}] - b[low + 1][{k}]) - b[1][{k}]) AS e{k}' for k in (1, 2, 3))} FROM lows)
  SELECT query_id, id, round(sqrt(sum(e1 * e1 + e2 * e2 + e3 * e3)), 6) AS distance FROM points GROUP BY ALL"""


def staged(keep: str, most: int) -> str:
    """staged(query_id, id, rank_s1, d, rank_s2): `keep` (of total) candidates pass Kim's bound, `most` of those Keogh's."""
    return f"""{KIM_CTE}, {keogh(0.2)}, {band(window=0.2)},
  one AS (SELECT query_id, id, kim.bound AS kim, keogh.bound AS keogh, cdtw.distance AS d, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank_s1, count(*) OVER (PARTITION BY query_id) AS total FROM kim JOIN keogh USING (query_id, id) JOIN cdtw USING (query_id, id)),
  two_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kim, rank_s1) <= {keep} AS stay FROM one),
  three AS (SELECT *, stay AND row_number() OVER (PARTITION BY query_id ORDER BY stay DESC, keogh, rank_s1) <= {most} AS done FROM two_),
  four AS (SELECT *, CASE WHEN done THEN d ELSE {INF} END AS dtw FROM three),
  staged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dtw, rank_s1) AS rank_s2 FROM four)"""


STAGED_CTE = staged("ceil(total * 0.5)", 20)
STAGED = f"WITH RECURSIVE {PAIRS}, {STAGED_CTE} SELECT query_id, id, rank_s1, round(dtw, 6) AS dtw_dist, rank_s2, rank_s1 - rank_s2 AS rank_change FROM staged"


def adaptive(small: int) -> str:
    """Lists of up to `small` candidates are compared whole; of longer ones nine tenths pass Kim's bound and `small` Keogh's."""
    return f"WITH RECURSIVE {PAIRS}, {staged(f'CASE WHEN total <= {small} THEN total ELSE ceil(total * 0.9) END', small)} SELECT query_id, id, rank_s1, round(dtw, 6) AS dtw_dist, rank_s2 FROM staged"


SAVINGS = f"WITH RECURSIVE {PAIRS}, {STAGED_CTE} SELECT query_id, count(*) AS candidates, count(*) FILTER (done) AS dtw_calls, round(100 * (1 - count(*) FILTER (done) / count(*)::DOUBLE), 6) AS saved_percent FROM staged GROUP BY 1"


def _let(name: str, fields: dict[str, str], body: str) -> str:
    """body with a record of the fields bound to a name."""
    return f"list_transform([struct_pack({', '.join(f'{k} := {v}' for k, v in fields.items())})], lambda {name}: {body})[1]"


def _share(p: str, a: str, b: str) -> str:
    """Clamped share of the edge from a to b where it is nearest to p."""
    dot = " + ".join(f"({p}[{k}] - {a}[{k}]) * ({b}[{k}] - {a}[{k}])" for k in (1, 2, 3))
    size = " + ".join(f"({b}[{k}] - {a}[{k}]) * ({b}[{k}] - {a}[{k}])" for k in (1, 2, 3))
    return f"least(1.0, greatest(0.0, ({dot}) / greatest({size}, 2.220446049250313e-16)))"


def _reach(p: str, a: str, b: str, t: str) -> str:
    return "sqrt(" + " + ".join(f"pow({p}[{k}] - {a}[{k}] - {t} * ({b}[{k}] - {a}[{k}]), 2)" for k in (1, 2, 3)) + ")"


def _cell() -> str:
    """One cell of the three cost planes of selective DTW; u, l and g are the cells above, left and diagonal."""
    cell = lambda v, va, vb, x, xa, xb, y, ya, yb: f"struct_pack(v := {v}, va := {va}, vb := {vb}, x := {x}, xa := {xa}, xb := {xb}, y := {y}, ya := {ya}, yb := {yb})"
    zero, one = "0.0::DOUBLE", "1.0::DOUBLE"
    corner = cell("d[1][1]", zero, zero, INF, zero, zero, INF, zero, zero)
    column = cell("c.u.v + d[i + 1][1]", zero, one, INF, zero, one, INF, zero, zero)
    row = cell("c.l.v + d[1][c.j + 1]", one, zero, INF, zero, zero, "c.l.v + ry[1][c.j + 1]", one, zero)
    inside = lambda s: f"coalesce({s} > 0 AND {s} < 1, false)"
    values = {
        "here": "d[i + 1][c.j + 1]", "du": "d[i][c.j + 1]", "dl": "d[i + 1][c.j]", "dg": "d[i][c.j]", "px": "sx[i + 1][c.j + 1]", "py": "sy[i + 1][c.j + 1]", "pl": "sx[i + 1][c.j]", "pu": "sy[i][c.j + 1]",
        "xh": inside("sx[i + 1][c.j + 1]"), "yh": inside("sy[i + 1][c.j + 1]"), "xl": inside("sx[i + 1][c.j]"), "yu": inside("sy[i][c.j + 1]"),
        "fx": f"CASE WHEN {inside('sx[i + 1][c.j]')} THEN c.l.x ELSE {INF} END", "fy": f"CASE WHEN {inside('sy[i][c.j + 1]')} THEN c.u.y ELSE {INF} END", "vu": "c.u.v", "vl": "c.l.v", "vg": "c.g.v", "rx": "rx[i + 1][c.j + 1]", "ry": "ry[i + 1][c.j + 1]",
    }
    first = lambda options, part: "CASE " + " ".join(f"WHEN {cost} < {INF} THEN {parts[part]}" for cost, *parts in options) + f" ELSE {options[0][1 + part]} END"
    x_options = [(f"(CASE WHEN w.pl <= w.px THEN w.fx ELSE {INF} END)", "w.fx", "w.pl", zero), ("w.fy", "w.fy", zero, "w.pu"), ("w.vu", "w.vu", zero, one)]
    y_options = [("w.fx", "w.fx", "w.pl", zero), (f"(CASE WHEN w.pu <= w.py THEN w.fy ELSE {INF} END)", "w.fy", zero, "w.pu"), ("w.vl", "w.vl", one, zero)]
    planes = {
        "x": f"CASE WHEN w.xh THEN w.rx + {first(x_options, 0)} ELSE {INF} END", "xa": first(x_options, 1), "xb": first(x_options, 2),
        "y": f"CASE WHEN w.yh THEN w.ry + {first(y_options, 0)} ELSE {INF} END", "ya": first(y_options, 1), "yb": first(y_options, 2),
    }
    straight = "NOT (w.xh OR w.yh OR w.xl OR w.yu) AND w.here <= w.du AND w.here <= w.dl AND w.dg <= w.du AND w.dg <= w.dl"
    options = [
        ("w.xh", "z.x", "w.px", one), ("w.yh", "z.y", one, "w.py"), ("w.here <= w.dl AND NOT w.yh AND (coalesce(w.px < w.pl, false) OR NOT w.xh)", "w.fx", "w.pl", zero),
        ("w.here <= w.du AND NOT w.xh AND (coalesce(w.py < w.pu, false) OR NOT w.yh)", "w.fy", zero, "w.pu"), ("NOT w.yh", "w.vl", one, zero), ("NOT w.xh", "w.vu", zero, one), (straight, "w.vg", zero, zero),
    ]
    costs = {f"o{k}": f"CASE WHEN {ok} THEN {cost} ELSE {INF} END" for k, (ok, cost, _, _) in enumerate(options)}
    least = "least(" + ", ".join(f"o.{k}" for k in costs) + ")"
    pick = lambda part: "CASE " + " ".join(f"WHEN o.o{k} = {least} THEN {options[k][part]}" for k in range(7)) + " END"
    inner = _let("w", values, _let("z", planes, _let("o", costs, cell(f"{least} + w.here", pick(2), pick(3), "z.x", "z.xa", "z.xb", "z.y", "z.ya", "z.yb"))))
    return f"CASE WHEN s + 1 - i NOT BETWEEN 0 AND n - 1 THEN NULL ELSE {_let('c', {'j': 's + 1 - i', 'u': 'diags[s + 1][i]', 'l': 'diags[s + 1][i + 1]', 'g': 'diags[s][i]'}, f'CASE WHEN c.j = 0 THEN {column} WHEN i = 0 THEN {row} ELSE {inner} END')} END", corner


_STEP, _CORNER = _cell()
SIDTW_CTE = f"""{SIDES}, {LOCAL},
  shares AS (SELECT user_id, list_transform(range(1, m + 1), lambda i: list_transform(range(1, n + 1), lambda j: CASE WHEN i > 1 THEN {_share('y[j]', 'x[i - 1]', 'x[i]')} END)) AS sx,
    list_transform(range(1, m + 1), lambda i: list_transform(range(1, n + 1), lambda j: CASE WHEN j > 1 THEN {_share('x[i]', 'y[j - 1]', 'y[j]')} END)) AS sy FROM xy),
  edges AS (SELECT user_id, sx, sy, list_transform(range(1, m + 1), lambda i: list_transform(range(1, n + 1), lambda j: CASE WHEN i > 1 THEN {_reach('y[j]', 'x[i - 1]', 'x[i]', 'sx[i][j]')} END)) AS rx,
    list_transform(range(1, m + 1), lambda i: list_transform(range(1, n + 1), lambda j: CASE WHEN j > 1 THEN {_reach('x[i]', 'y[j - 1]', 'y[j]', 'sy[i][j]')} END)) AS ry FROM xy JOIN shares USING (user_id)),
  planes AS (SELECT user_id, m, n, d, sx, sy, rx, ry, 0 AS s, [list_transform(range(m), lambda i: CASE WHEN i = 0 THEN {_CORNER} END)] AS diags FROM local JOIN edges USING (user_id)
    UNION ALL SELECT user_id, m, n, d, sx, sy, rx, ry, s + 1, list_append(diags, list_transform(range(m), lambda i: {_STEP})) FROM planes WHERE s + 1 < m + n - 1),
  done AS (SELECT user_id, m, n, diags FROM planes WHERE s = m + n - 2),
  walk AS (SELECT user_id, m - 1 AS i, n - 1 AS j, 'v' AS plane, (m - 1)::DOUBLE AS ix, (n - 1)::DOUBLE AS iy, m - 1 AS at_row, 0::BIGINT AS k FROM done
    UNION ALL SELECT user_id, CASE WHEN a = 0 THEN i - 1 ELSE i END, CASE WHEN b = 0 THEN j - 1 ELSE j END, CASE WHEN a > 0 AND a < 1 THEN 'x' WHEN b > 0 AND b < 1 THEN 'y' ELSE 'v' END, i - 1 + a, j - 1 + b, i, k + 1
      FROM (SELECT walk.*, CASE plane WHEN 'v' THEN c.va WHEN 'x' THEN c.xa ELSE c.ya END AS a, CASE plane WHEN 'v' THEN c.vb WHEN 'x' THEN c.xb ELSE c.yb END AS b FROM (SELECT walk.*, done.diags[walk.i + walk.j + 1][walk.i + 1] AS c FROM walk JOIN done USING (user_id) WHERE walk.i > 0 OR walk.j > 0) AS walk)),
  pairs_ AS (SELECT walk.*, floor(greatest(ix, 0))::BIGINT + 1 AS a, least(floor(greatest(ix, 0))::BIGINT + 2, m) AS a2, greatest(ix, 0) - floor(greatest(ix, 0)) AS fa, floor(greatest(iy, 0))::BIGINT + 1 AS b, least(floor(greatest(iy, 0))::BIGINT + 2, n) AS b2, greatest(iy, 0) - floor(greatest(iy, 0)) AS fb, x, y, xs, ys, m, n FROM walk JOIN xy USING (user_id)),
  sidtw AS (SELECT user_id AS traj_id, CASE WHEN k = 0 THEN xs[m] WHEN at_row = 0 THEN ys[least(ceil(iy)::BIGINT, n - 1) + 1] ELSE xs[at_row + 1] END AS seg_id, max(k) OVER (PARTITION BY user_id) - k + 1 AS points_order,
    sqrt({' + '.join(f'pow(x[a][{k}] + fa * (x[a2][{k}] - x[a][{k}]) - y[b][{k}] - fb * (y[b2][{k}] - y[b][{k}]), 2)' for k in (1, 2, 3))}) AS d FROM pairs_)"""
SIDTW = f"WITH RECURSIVE {SIDTW_CTE} SELECT traj_id, seg_id, points_order, round(d, 6) AS distance, round(avg(d) OVER (PARTITION BY traj_id), 6) AS value, 'ok' AS status FROM sidtw"


def accuracy_summary(point_to_curve: str) -> str:
    """The figures of whole trajectories for every position metric, and of DTW segment by segment."""
    raw = lambda sql: sql.replace("round(d[i + 1][j + 1], 6) AS distance", "d[i + 1][j + 1] AS distance").replace("round(distance, 6) AS distance", "distance").replace("round(d, 6) AS distance", "d AS distance")
    sides = f"""sides AS (SELECT struct_pack(u := user_id, g := event_type) AS user_id, event_id % 2 AS side, list([value, {HOUR}, (event_id % 100)::DOUBLE] ORDER BY ts, event_id) AS s, list(event_type ORDER BY ts, event_id) AS g FROM events GROUP BY ALL),
  xy AS (SELECT a.user_id, a.s AS x, b.s AS y, a.g AS xs, b.g AS ys, len(a.s) AS m, len(b.s) AS n FROM sides a JOIN sides b ON a.user_id = b.user_id AND a.side = 0 AND b.side = 1)"""
    tables = {"point_to_curve": f"SELECT traj_id, distance FROM ({point_to_curve})", **{m: f"SELECT traj_id, distance FROM ({raw(sql)})" for m, sql in (("sidtw", SIDTW), ("dtw", DTW), ("frechet", FRECHET), ("lcss", LCSS))}}
    tables["dtw_by_segment"] = f"SELECT traj_id.u AS traj_id, distance FROM ({raw(DTW.replace(SIDES, sides))})"
    figures = "round(min(distance), 6) AS min_distance, round(max(distance), 6) AS max_distance, round(avg(distance), 6) AS average_distance, round(CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(distance) END, 6) AS standard_deviation"
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, traj_id, {figures} FROM ({sql}) GROUP BY traj_id" for m, sql in tables.items())


def _smoothed(source: str, name: str, degree: int) -> str:
    """name(…, i, n, x): local polynomials of source(user_id, dim, i, n, x), by polynomials orthogonal on the window's places."""
    t2 = "(w * w - 1) / 12.0"
    basis = ["1.0", "{t}", f"({{t}} * {{t}} - {t2})", "({t} * {t} * {t} - {t} * (3 * w * w - 7) / 20.0)"][: degree + 1]
    weight = " + ".join(f"{b.format(t='a')} * {b.format(t='b')} / list_sum(list_transform(range(-h, h + 1), lambda z: {b.format(t='z')} * {b.format(t='z')}))" for b in basis)
    return f"""{name}_w AS (SELECT *, (w - 1) // 2 AS h FROM (SELECT DISTINCT n, least(33, CASE WHEN n % 2 = 1 THEN n ELSE n - 1 END) AS w FROM {source})),
  {name}_p AS (SELECT n, i, greatest(h, least(n - 1 - h, i)) + b AS j, {weight} AS f FROM (SELECT *, i - greatest(h, least(n - 1 - h, i)) AS a, unnest(range(-h, h + 1)) AS b FROM (SELECT *, unnest(range(n)) AS i FROM {name}_w))),
  {name} AS (SELECT s.user_id, s.dim, p.i, s.n, sum(p.f * s.x) AS x FROM {source} s JOIN {name}_p p ON p.n = s.n AND p.j = s.i GROUP BY ALL)"""


def velocity(name: str, x: str, y: str, sizes: tuple = (5, 10), key: str = "user_id") -> str:
    """name(user_id, v): unit vectors of smoothed velocities (all sequences have ten points or more)."""
    places = " UNION ALL ".join(f"SELECT {k} AS part, unnest(range({n})) AS place, {n} AS size" for k, n in enumerate(sizes))
    return f"""raw_ AS (SELECT {key} AS user_id, unnest([1, 2, 3]) AS dim, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n, unnest([{x}, {y}, (event_id % 100)::DOUBLE]) AS x FROM events),
  {_smoothed('raw_', 'path_', 3)},
  speed_ AS (SELECT user_id, dim, i - 1 AS i, n - 1 AS n, (x - lag(x) OVER (PARTITION BY user_id, dim ORDER BY i)) * (n - 1) AS x FROM path_ QUALIFY i > 0),
  {_smoothed('speed_', 'even_', 2)},
  at_ AS (SELECT user_id, dim, part, place, n, CASE WHEN n <= size THEN least(place, n - 1) WHEN place = size - 1 THEN n - 1 ELSE place * ((n - 1) / (size - 1)::DOUBLE) END AS pos FROM (SELECT DISTINCT user_id, dim, n FROM even_), ({places})),
  cut_ AS (SELECT a.user_id, a.part, a.dim, a.place, l.x + (pos - floor(pos)) * (h.x - l.x) AS x FROM at_ a JOIN even_ l ON l.user_id = a.user_id AND l.dim = a.dim AND l.i = floor(pos) JOIN even_ h ON h.user_id = a.user_id AND h.dim = a.dim AND h.i = least(floor(pos) + 1, a.n - 1)),
  {name} AS (SELECT user_id, list(x / size ORDER BY part, dim, place) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS size FROM cut_) GROUP BY 1)"""


#: The rotation is the orthogonal factor of the covariance, found by Newton's iteration on matrices.
_COFACTORS = ", ".join(f"c[{3 * ((i + 1) % 3) + (j + 1) % 3 + 1}] * c[{3 * ((i + 2) % 3) + (j + 2) % 3 + 1}] - c[{3 * ((i + 1) % 3) + (j + 2) % 3 + 1}] * c[{3 * ((i + 2) % 3) + (j + 1) % 3 + 1}]" for i in range(3) for j in range(3))
CALIBRATION = f"""WITH RECURSIVE p AS (SELECT event_type, [value, (event_id % 100)::DOUBLE, (event_id % 7)::DOUBLE] AS p FROM events),
  e AS (SELECT event_type, p, [0.36 * p[1] + 0.48 * p[2] - 0.8 * p[3] + 1 + p[2] % 13 / 10, -0.8 * p[1] + 0.6 * p[2] + 2 + p[2] % 11 / 10, 0.48 * p[1] + 0.64 * p[2] + 0.6 * p[3] + 3 + p[2] % 9 / 10] AS q FROM p),
  means AS (SELECT event_type, [avg(p[1]), avg(p[2]), avg(p[3])] AS mp, [avg(q[1]), avg(q[2]), avg(q[3])] AS mq FROM e GROUP BY 1),
  cov AS (SELECT event_type, mp, mq, [{', '.join(f'avg((p[{i}] - mp[{i}]) * (q[{j}] - mq[{j}]))' for i in (1, 2, 3) for j in (1, 2, 3))}] AS c FROM e JOIN means USING (event_type) GROUP BY ALL),
  polar AS (SELECT event_type, mp, mq, c, 0 AS k FROM cov
    UNION ALL SELECT event_type, mp, mq, list_transform(range(1, 10), lambda z: (c[z] + f[z] / (c[1] * f[1] + c[2] * f[2] + c[3] * f[3])) / 2), k + 1 FROM (SELECT *, [{_COFACTORS}] AS f FROM polar WHERE k < 60)),
  left_ AS (SELECT event_type, sqrt({' + '.join(f'pow((p[1] - mp[1]) * c[{j}] + (p[2] - mp[2]) * c[{3 + j}] + (p[3] - mp[3]) * c[{6 + j}] - q[{j}] + mq[{j}], 2)' for j in (1, 2, 3))}) AS d FROM e JOIN polar USING (event_type) WHERE k = 60)
  SELECT event_type, count(*) AS n, round(avg(d), 6) AS mean_error, round(max(d), 6) AS max_error, round(sqrt(avg(d * d)), 6) AS rms_error FROM left_ GROUP BY 1"""


def _times(p: str, q: str) -> str:
    """Hamilton product."""
    a, b = [f"{p}[{k}]" for k in (1, 2, 3, 4)], [f"{q}[{k}]" for k in (1, 2, 3, 4)]
    rows = ((0, 0, 1), (1, 1, -1), (2, 2, -1), (3, 3, -1)), ((0, 1, 1), (1, 0, 1), (2, 3, 1), (3, 2, -1)), ((0, 2, 1), (1, 3, -1), (2, 0, 1), (3, 1, 1)), ((0, 3, 1), (1, 2, 1), (2, 1, -1), (3, 0, 1))
    return "[" + ", ".join(" + ".join(f"{s} * {a[i]} * {b[j]}" for i, j, s in row) for row in rows) + "]"


#: A quarter turn about x, by which offset and robot matrices turn here; poses as in the query.
_QUARTER = "[sqrt(0.5), sqrt(0.5), 0.0, 0.0]"
POSES = f"""WITH e AS (SELECT event_id, ts::DATE AS day, radians(value) / 2 AS h, value FROM events), months AS (SELECT DISTINCT date_trunc('month', day)::DATE AS valid FROM e),
  dated AS (SELECT e.*, dayofyear(valid)::DOUBLE AS shift FROM e ASOF LEFT JOIN months ON e.day >= months.valid),
  a AS (SELECT event_id, value, shift, {_times('[sqrt(0.5), -sqrt(0.5), 0.0, 0.0]', '[cos(h), sin(h) * 0.6, sin(h) * 0.8, 0.0]')} AS r FROM dated),
  b AS (SELECT event_id, value, shift, [-r[1], -r[3], -r[4], r[2]] AS q FROM a),
  c AS (SELECT *, {_times('q', _QUARTER)} AS o,
    [value + (1 - 2 * (q[3] * q[3] + q[4] * q[4])) * shift + 2 * (q[2] * q[3] - q[4] * q[1]) * 2 + 2 * (q[2] * q[4] + q[3] * q[1]) * 3, 10 + 2 * (q[2] * q[3] + q[4] * q[1]) * shift + (1 - 2 * (q[2] * q[2] + q[4] * q[4])) * 2 + 2 * (q[3] * q[4] - q[2] * q[1]) * 3,
     -5 + 2 * (q[2] * q[4] - q[3] * q[1]) * shift + 2 * (q[3] * q[4] + q[2] * q[1]) * 2 + (1 - 2 * (q[2] * q[2] + q[3] * q[3])) * 3] AS p FROM b),
  d AS (SELECT event_id, shift, p, list_transform(o, lambda z: z * CASE WHEN 4 * o[1] * o[1] - 1 > 0 THEN sign(o[1]) WHEN abs(o[2]) > abs(o[3]) AND abs(o[2]) > abs(o[4]) THEN sign(o[2]) WHEN abs(o[3]) > abs(o[4]) THEN sign(o[3]) ELSE sign(o[4]) END) AS o FROM c),
  f AS (SELECT event_id, [p[1] - shift, 2 - p[3], 3 + p[2]] AS p, {_times(_QUARTER, 'o')} AS o FROM d), g AS (SELECT *, -(2 * (o[2] * o[4] - o[3] * o[1])) AS up FROM f),
  h AS (SELECT event_id, 'position' AS part, p AS v FROM f UNION ALL SELECT event_id, 'orientation', o FROM f
    UNION ALL SELECT event_id, 'angles', [CASE WHEN abs(up) > 0.99999 THEN 0 ELSE degrees(atan2(2 * (o[3] * o[4] + o[2] * o[1]), 1 - 2 * (o[2] * o[2] + o[3] * o[3]))) END, CASE WHEN abs(up) > 0.99999 THEN sign(up) * 90 ELSE degrees(asin(greatest(-1, least(1, up)))) END,
      CASE WHEN abs(up) > 0.99999 THEN degrees(atan2(-(2 * (o[2] * o[3] - o[4] * o[1])), 1 - 2 * (o[2] * o[2] + o[4] * o[4]))) ELSE degrees(atan2(2 * (o[2] * o[3] + o[4] * o[1]), 1 - 2 * (o[3] * o[3] + o[4] * o[4]))) END] FROM g)
  SELECT event_id, part, generate_subscripts(v, 1) AS k, unnest(list_transform(v, lambda z: round(z, 4) + 0.0)) AS x FROM h"""


#: A free symmetric top, moments 2, 2 and 3: the angular momentum turns the body in space, and the body turns under its axis.
TOP = f"""WITH e AS (SELECT event_id, radians(value) / 2 AS h, (event_id % 7) / 10.0::DOUBLE AS a, (event_id % 5) / 10.0::DOUBLE AS b, (event_id % 11) / 10.0::DOUBLE - 0.5 AS c, unnest([0.0, 0.5, 1.0]) * (event_id % 40) / 8 AS t FROM events),
  f AS (SELECT *, -c / 2 AS lam, sqrt(a * a + b * b + 2.25 * c * c) AS m, [cos(h), sin(h) * 0.6, sin(h) * 0.8, 0.0] AS q FROM e),
  g AS (SELECT event_id, t, lam, a, b, c, {_times('q', '[cos(m * t / 2), sin(m * t / 2) * coalesce(a / nullif(m, 0), 0), sin(m * t / 2) * coalesce(b / nullif(m, 0), 0), sin(m * t / 2) * coalesce(1.5 * c / nullif(m, 0), 0)]')} AS q FROM f),
  k AS (SELECT event_id, t, a * cos(lam * t) + b * sin(lam * t) AS wx, b * cos(lam * t) - a * sin(lam * t) AS wy, c AS wz, {_times('q', '[cos(lam * t / 2), 0.0, 0.0, sin(lam * t / 2)]')} AS q FROM g)
  SELECT event_id, round(t, 6) AS t, round(q[1], 4) + 0.0 AS w, round(q[2], 4) + 0.0 AS x, round(q[3], 4) + 0.0 AS y, round(q[4], 4) + 0.0 AS z, round(wx, 4) + 0.0 AS wx, round(wy, 4) + 0.0 AS wy, round(wz, 4) + 0.0 AS wz FROM k"""


def _on(s: str) -> list[str]:
    return [f"(c[{k}][1] + {s} * (c[{k}][2] + {s} * (c[{k}][3] + {s} * c[{k}][4])))" for k in (1, 2, 3)]


def _from_point(s: str) -> str:
    return "(" + " + ".join(f"pow({p} - q[{k}], 2)" for k, p in zip((1, 2, 3), _on(s))) + ")"


#: Distance from a shape-preserving cubic: 40 samples of every piece, and the best of eight half pieces of a point refined by thirds of their brackets.
POINT_TO_PCHIP = f"""WITH p AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS ord, event_id % 2 AS side, [value, {HOUR}, (event_id % 100)::DOUBLE] AS p FROM events),
  steps AS (SELECT *, {gap('p', 'p2')} AS h FROM (SELECT user_id, ord, p, lead(p) OVER (PARTITION BY user_id ORDER BY ord) AS p2 FROM p WHERE side = 0)),
  long AS (SELECT user_id, ord, k, h, p[k] AS y, p2[k] AS y2, (p2[k] - p[k]) / h AS d FROM steps, (SELECT unnest([1, 2, 3]) AS k)),
  near AS (SELECT *, lag(d) OVER w AS dl, lag(h) OVER w AS hl, lag(d, 2) OVER w AS dll, lag(h, 2) OVER w AS hll, lead(d) OVER w AS dr, lead(h) OVER w AS hr FROM long WINDOW w AS (PARTITION BY user_id, k ORDER BY ord)),
  ends AS (SELECT *, CASE WHEN dl IS NULL THEN d ELSE dl END AS x, CASE WHEN dl IS NULL THEN dr ELSE dll END AS z, CASE WHEN dl IS NULL THEN h ELSE hl END AS hx, CASE WHEN dl IS NULL THEN hr ELSE hll END AS hz FROM near),
  edge AS (SELECT *, ((2 * hx + hz) * x - hx * z) / (hx + hz) AS e FROM ends),
  slopes AS (SELECT *, CASE WHEN d IS NOT NULL AND dl IS NOT NULL THEN CASE WHEN d * dl > 0 THEN 3 * (h + hl) / ((2 * hl + h) / d + (hl + 2 * h) / dl) ELSE 0 END WHEN z IS NULL THEN x WHEN e * x <= 0 THEN 0 WHEN x * z < 0 AND abs(e) > 3 * abs(x) THEN 3 * x ELSE e END AS m FROM edge),
  cubic AS (SELECT user_id, ord, k, [y, m * h, 3 * (y2 - y) - 2 * m * h - m2 * h, 2 * (y - y2) + m * h + m2 * h] AS c FROM (SELECT *, lead(m) OVER (PARTITION BY user_id, k ORDER BY ord) AS m2 FROM slopes) WHERE y2 IS NOT NULL),
  pieces AS (SELECT user_id, ord AS piece, list(c ORDER BY k) AS c FROM cubic GROUP BY ALL),
  sampled AS (SELECT user_id, b.event_type, b.ord, b.p AS q, c, piece, unnest(range(41)) / 40.0 AS s FROM p b JOIN pieces USING (user_id) WHERE side = 1),
  halves AS (SELECT * FROM (SELECT *, {_from_point('s')} AS d FROM sampled) QUALIFY row_number() OVER (PARTITION BY user_id, ord, piece, s < 0.5 ORDER BY d) = 1),
  best AS (SELECT user_id, event_type, ord, q, c, s FROM halves QUALIFY row_number() OVER (PARTITION BY user_id, ord ORDER BY d) <= 8),
  fine AS (SELECT user_id, event_type, ord, q, c, list_reduce(list_prepend([greatest(s - 0.025, 0), least(s + 0.025, 1)], list_transform(range(70), lambda z: [0.0, 0.0]::DOUBLE[])), lambda i, z: CASE WHEN {_from_point('((2 * i[1] + i[2]) / 3)')} < {_from_point('((i[1] + 2 * i[2]) / 3)')} THEN [i[1], (i[1] + 2 * i[2]) / 3] ELSE [(2 * i[1] + i[2]) / 3, i[2]] END)[1] AS s FROM best)
  SELECT user_id AS traj_id, event_type AS seg_id, ord AS points_order, round(sqrt(min({_from_point('s')})), 4) AS distance FROM fine GROUP BY ALL"""
