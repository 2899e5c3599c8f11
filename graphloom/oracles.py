"""The same results in DuckDB's SQL, for queries that SQL can express."""

from __future__ import annotations

_LI = "li AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)"
#: The graphs, as common table expressions.
COPURCHASE = f"{_LI}, e AS (SELECT a.p AS src, b.p AS dst, count(*) AS w FROM li a JOIN li b ON a.o = b.o AND a.p <> b.p GROUP BY 1, 2)"
USERS = """steps AS (SELECT user_id AS a, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS b FROM events),
half AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS w FROM steps WHERE b IS NOT NULL AND a <> b GROUP BY 1, 2),
e AS (SELECT src, dst, w FROM half UNION ALL SELECT dst, src, w FROM half)"""
ORDER_PART = """half AS (SELECT DISTINCT l_orderkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem),
e AS (SELECT src, dst, CAST(1 AS BIGINT) AS w FROM half UNION ALL SELECT dst, src, CAST(1 AS BIGINT) FROM half)"""
TRADE = """t AS (SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(s_nationkey AS BIGINT) AS j, count(*) AS v FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
NATIONS = f"{TRADE}, half AS (SELECT least(i, j) AS src, greatest(i, j) AS dst, sum(v) AS w FROM t WHERE i <> j GROUP BY 1, 2), e AS (SELECT src, dst, w FROM half UNION ALL SELECT dst, src, w FROM half)"
SUPPLY = "a AS (SELECT l_partkey AS i, l_suppkey AS j, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"
PRICE = "x AS (SELECT p_partkey AS i, CAST(round(p_retailprice * 100) AS BIGINT) AS v FROM part)"
SIZE = "s AS (SELECT p_partkey AS i, CAST(p_size AS BIGINT) AS v FROM part)"
DEG = "deg AS (SELECT src AS id, count(*) AS deg, CAST(sum(w) AS BIGINT) AS wdeg FROM e GROUP BY 1)"
PARITY = "part_ AS (SELECT DISTINCT src AS id, CAST(src % 2 AS BIGINT) AS part FROM e)"


def _p(column: str, salt: str = "42") -> str:
    return f"md5(CAST({column} AS VARCHAR) || '-{salt}')"


HN = f"hn AS (SELECT src AS id, dst AS hn FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, {_p('dst')} DESC, dst DESC) AS rn FROM e) WHERE rn = 1)"
#: Closed form of heavy-edge clustering: first roots, then those reached through a heavy neighbour.
HEC3 = f"""{HN},
r1 AS (SELECT a.id, a.hn, CASE WHEN b.hn = a.id THEN least(a.id, a.hn) WHEN a.id IN (SELECT hn FROM hn) THEN a.id END AS root FROM hn a JOIN hn b ON a.hn = b.id),
r2 AS (SELECT a.id, coalesce(a.root, b.root) AS root FROM r1 a LEFT JOIN r1 b ON a.hn = b.id),
m AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cid FROM r2)"""
CONTRACTED = "ce AS (SELECT a.cid AS src, b.cid AS dst, CAST(sum(e.w) AS BIGINT) AS w FROM e JOIN m a ON e.src = a.id JOIN m b ON e.dst = b.id WHERE a.cid <> b.cid GROUP BY 1, 2)"
GAINS = "g AS (SELECT e.src AS id, CAST(sum(CASE WHEN a.part <> b.part THEN w ELSE -w END) AS BIGINT) AS gain FROM e JOIN part_ a ON e.src = a.id JOIN part_ b ON e.dst = b.id GROUP BY 1)"
RUNS = """runs AS (SELECT c_mktsegment AS graph, substr(o_orderpriority, 1, 1) AS method, year(o_orderdate) * 12 + month(o_orderdate) AS run, count(*) AS cut, CAST(round(sum(o_totalprice)) AS BIGINT) AS time
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""
MEDIANS = "md AS (SELECT graph, method, median(time) AS m FROM runs GROUP BY 1, 2)"
RATIOS = f"{RUNS}, {MEDIANS}, ratios AS (SELECT g.graph, n.method, md.m / b.m AS ratio FROM (SELECT DISTINCT graph FROM md) g CROSS JOIN (SELECT DISTINCT method FROM md) n LEFT JOIN md ON md.graph = g.graph AND md.method = n.method LEFT JOIN md b ON b.graph = g.graph AND b.method = '1')"


def _hec_serial(rounds: int = 12) -> str:
    """Visiting order by rounds: a vertex is decided once its earlier suitors are."""
    out = [f"hp AS MATERIALIZED (SELECT id, hn, {_p('id')} AS p FROM hn)", "earlier AS MATERIALIZED (SELECT a.hn AS id, a.id AS suitor FROM hp a JOIN hp b ON a.hn = b.id WHERE a.id <> a.hn AND (a.p < b.p OR a.p = b.p AND a.id < b.id))", "s0 AS MATERIALIZED (SELECT id, hn, CAST(NULL AS BOOLEAN) AS active FROM hn)"]
    for k in range(rounds):
        out.append(f"""s{k + 1} AS MATERIALIZED (SELECT s.id, s.hn, CASE WHEN s.active IS NOT NULL THEN s.active WHEN t.anyone THEN false WHEN coalesce(t.open, 0) = 0 THEN true END AS active
FROM s{k} s LEFT JOIN (SELECT earlier.id, coalesce(bool_or(active), false) AS anyone, count(*) FILTER (active IS NULL) AS open FROM earlier JOIN s{k} ON s{k}.id = suitor GROUP BY 1) t ON s.id = t.id)""")
    out.append(f"u0 AS MATERIALIZED (SELECT id, CASE WHEN active THEN hn ELSE id END AS up FROM s{rounds})")
    out += [f"u{k + 1} AS MATERIALIZED (SELECT a.id, b.up FROM u{k} a JOIN u{k} b ON a.up = b.id)" for k in range(5)]
    return ",\n".join(out)


def _matching(rounds: int = 25) -> str:
    """Rounds of mutual best edges."""
    out = ["o0 AS MATERIALIZED (SELECT src, dst, w, md5(CAST(least(src, dst) AS VARCHAR) || '-' || CAST(greatest(src, dst) AS VARCHAR) || '-42') AS p FROM e)"]
    for k in range(rounds):
        out.append(f"b{k} AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, p DESC, dst DESC) AS rn FROM o{k}) WHERE rn = 1)")
        out.append(f"p{k} AS MATERIALIZED (SELECT x.src AS a, x.dst AS b FROM b{k} x JOIN b{k} y ON x.dst = y.src AND y.dst = x.src WHERE x.src < x.dst)")
        out.append(f"o{k + 1} AS MATERIALIZED (SELECT * FROM o{k} WHERE src NOT IN (SELECT a FROM p{k} UNION ALL SELECT b FROM p{k}) AND dst NOT IN (SELECT a FROM p{k} UNION ALL SELECT b FROM p{k}))")
    return ",\n".join(out) + "\nSELECT a, b FROM (" + " UNION ALL ".join(f"SELECT a, b FROM p{k}" for k in range(rounds)) + ")"


def _mis2(rounds: int = 24) -> str:
    out = ["c AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT DISTINCT src, src FROM e)", f"i0 AS MATERIALIZED (SELECT DISTINCT src AS id, {_p('src')} AS p, 0 AS state FROM e)"]
    for k in range(rounds):
        one = f"SELECT src AS id, max(t) AS t FROM c JOIN (SELECT id, {{'s': state, 'p': p, 'i': id}} AS t FROM i{k}) f ON c.dst = f.id GROUP BY 1"
        two = f"SELECT src AS id, max(t) AS t FROM c JOIN ({one}) f ON c.dst = f.id GROUP BY 1"
        out.append(f"i{k + 1} AS MATERIALIZED (SELECT s.id, s.p, CASE WHEN s.state <> 0 THEN s.state WHEN t.t.i = s.id THEN 1 WHEN t.t.s = 1 THEN -1 ELSE 0 END AS state FROM i{k} s JOIN ({two}) t ON s.id = t.id)")
    return ",\n".join(out) + f",\nist AS MATERIALIZED (SELECT id, p, state FROM i{rounds})"


def _gosh(rounds: int = 15) -> str:
    out = ["av AS (SELECT sum(deg) // count(*) AS a FROM deg)", "lt AS MATERIALIZED (SELECT src, dst FROM e JOIN deg x ON src = x.id JOIN deg y ON dst = y.id WHERE NOT (x.deg > (SELECT a FROM av) AND y.deg > (SELECT a FROM av)))", "j0 AS MATERIALIZED (SELECT id, deg, 0 AS state FROM deg)"]
    for k in range(rounds):
        out.append(f"""j{k + 1} AS MATERIALIZED (SELECT s.id, s.deg, CASE WHEN s.state <> 0 THEN s.state WHEN t.t.s = 1 THEN -1 WHEN t.t IS NULL OR {{'s': s.state, 'd': s.deg, 'i': s.id}} > t.t THEN 1 ELSE 0 END AS state
FROM j{k} s LEFT JOIN (SELECT src AS id, max({{'s': state, 'd': deg, 'i': j{k}.id}}) AS t FROM lt JOIN j{k} ON dst = j{k}.id WHERE state >= 0 GROUP BY 1) t ON s.id = t.id)""")
    return ",\n".join(out)


def _power(steps: int = 10) -> str:
    out = ["gg AS (SELECT greatest(2, 2 * max(wdeg)) AS g FROM deg)", "v AS (SELECT id, CAST(id AS DOUBLE) AS x FROM deg)", "c0 AS (SELECT id, x - (SELECT avg(x) FROM v) AS x FROM v)", "x0 AS MATERIALIZED (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM c0) AS x FROM c0)"]
    for k in range(steps):
        out.append(f"q{k} AS MATERIALIZED (SELECT a.id, (SELECT g FROM gg) * a.x - (wdeg * a.x - coalesce(n.ax, 0)) AS x FROM x{k} a JOIN deg ON a.id = deg.id LEFT JOIN (SELECT src AS id, sum(w * x) AS ax FROM e JOIN x{k} ON dst = id GROUP BY 1) n ON a.id = n.id)")
        out.append(f"d{k} AS MATERIALIZED (SELECT id, x - (SELECT avg(x) FROM q{k}) AS x FROM q{k})")
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM d{k}) AS x FROM d{k})")
    return ",\n".join(out) + f"\nSELECT id, round(x, 5) AS x FROM x{steps}"


def _levels(count: int = 2) -> str:
    """So many chained levels of heavy-edge clustering."""
    out = ["e0 AS MATERIALIZED (SELECT src, dst, w FROM e)", "v0 AS MATERIALIZED (SELECT DISTINCT src AS id, CAST(1 AS BIGINT) AS vw FROM e0)"]
    for k in range(count):
        out.append(f"h{k} AS MATERIALIZED (SELECT src AS id, dst AS hn FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, {_p('dst')} DESC, dst DESC) AS rn FROM e{k}) WHERE rn = 1)")
        out.append(f"f{k} AS MATERIALIZED (SELECT a.id, a.hn, CASE WHEN b.hn = a.id THEN least(a.id, a.hn) WHEN a.id IN (SELECT hn FROM h{k}) THEN a.id END AS root FROM h{k} a JOIN h{k} b ON a.hn = b.id)")
        out.append(f"m{k} AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cid FROM (SELECT a.id, coalesce(a.root, b.root) AS root FROM f{k} a LEFT JOIN f{k} b ON a.hn = b.id))")
        out.append(f"e{k + 1} AS MATERIALIZED (SELECT a.cid AS src, b.cid AS dst, CAST(sum(w) AS BIGINT) AS w FROM e{k} JOIN m{k} a ON src = a.id JOIN m{k} b ON dst = b.id WHERE a.cid <> b.cid GROUP BY 1, 2)")
        out.append(f"v{k + 1} AS MATERIALIZED (SELECT cid AS id, CAST(sum(vw) AS BIGINT) AS vw FROM v{k} JOIN m{k} USING (id) GROUP BY 1)")
    return ",\n".join(out) + "\n" + " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS lvl, (SELECT count(*) FROM v{k}) AS n, (SELECT count(*) FROM e{k}) AS m, (SELECT CAST(sum(vw) AS BIGINT) FROM v{k}) AS w" for k in range(count + 1))


_TRI = """d AS (SELECT src AS id, count(*) AS deg FROM e GROUP BY 1), up AS (SELECT src AS a, dst AS b FROM e WHERE src < dst),
tri AS (SELECT x.a, x.b, y.b AS c FROM up x JOIN up y ON x.b = y.a JOIN up z ON z.a = x.a AND z.b = y.b)"""
#: The smallest id that reaches each vertex: labels fall along edges until none does.
_REACH = """WITH RECURSIVE {g}, r(id, label) USING KEY (id) AS (SELECT src, min(least(src, dst)) FROM e GROUP BY src
UNION (SELECT e.dst, min(r.label) FROM r JOIN e ON e.src = r.id JOIN recurring.r AS old ON old.id = e.dst WHERE r.label < old.label GROUP BY e.dst))"""
_SCAN = f"""{PARITY}, {GAINS}, ord AS (SELECT id, row_number() OVER (ORDER BY gain DESC, id) - 1 AS pos FROM g WHERE gain > 0),
og AS (SELECT o.id, o.pos, sum(CASE WHEN coalesce(q.pos < o.pos, false) THEN CASE WHEN a.part = b.part THEN w ELSE -w END WHEN a.part <> b.part THEN w ELSE -w END) AS gain
FROM ord o JOIN e ON e.src = o.id JOIN part_ a ON a.id = e.src JOIN part_ b ON b.id = e.dst LEFT JOIN ord q ON q.id = e.dst GROUP BY 1, 2),
base AS (SELECT (SELECT sum(w) // 2 FROM e JOIN part_ a ON src = a.id JOIN part_ b ON dst = b.id WHERE a.part <> b.part) AS cut, (SELECT sum(CASE WHEN part = 0 THEN 1 ELSE -1 END) FROM part_) AS imb),
scan AS (SELECT pos + 1 AS prefix, og.id, CAST((SELECT cut FROM base) - sum(gain) OVER (ORDER BY pos) AS BIGINT) AS cut, CAST((SELECT imb FROM base) + sum(CASE WHEN part = 0 THEN -2 ELSE 2 END) OVER (ORDER BY pos) AS BIGINT) AS imb FROM og JOIN part_ USING (id))"""
_STATS = "min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median"


def _colors(pairs: str, vertices: str) -> str:
    """Colours in the order of priorities: a vertex takes the least that no neighbour before it has, once all of these have theirs."""
    return f"""vx AS MATERIALIZED (SELECT id, {_p('id')} AS p FROM ({vertices})), pr AS MATERIALIZED (SELECT a.id AS id, b.id AS earlier FROM ({pairs}) q JOIN vx a ON q.src = a.id JOIN vx b ON q.dst = b.id WHERE b.p < a.p OR b.p = a.p AND b.id < a.id),
r(id, color) USING KEY (id) AS (SELECT id, CAST(0 AS BIGINT) FROM vx WHERE id NOT IN (SELECT id FROM pr)
UNION (SELECT t.id, list_min(list_filter(range(0, len(used) + 1), lambda x: NOT list_contains(used, x))) FROM (SELECT pr.id, count(*) AS need, count(old.id) AS have, list(old.color) AS used
FROM (SELECT DISTINCT pr.id FROM r JOIN pr ON pr.earlier = r.id) c JOIN pr ON pr.id = c.id LEFT JOIN recurring.r AS old ON old.id = pr.earlier GROUP BY pr.id) t WHERE need = have))
SELECT id, color FROM r"""


#: x in the order of (x, id), each undirected edge by its positions, and the window of splits that one percent allows.
_ORDERED = """vec AS (SELECT DISTINCT src AS id, src * 31 % 97 AS x FROM e), ord AS MATERIALIZED (SELECT id, x, row_number() OVER (ORDER BY x, id) - 1 AS pos FROM vec),
ends AS MATERIALIZED (SELECT least(a.pos, b.pos) AS a, greatest(a.pos, b.pos) AS b FROM e JOIN ord a ON src = a.id JOIN ord b ON dst = b.id WHERE src < dst),
win AS (SELECT count(*) AS n, count(*) - CAST(floor(ceil(count(*) / 2) * 1.01) AS BIGINT) AS lo, CAST(floor(ceil(count(*) / 2) * 1.01) AS BIGINT) AS hi FROM ord),
cuts AS (SELECT pos + 1 AS split, (SELECT count(*) FROM ends WHERE a < pos + 1 AND b >= pos + 1) AS cut FROM ord, win WHERE pos + 1 > lo AND pos + 1 <= hi)"""
#: Rows of the trade matrix as lists: off-diagonal values by column, diagonal, right-hand side.
_ROWS = "m AS (SELECT x.i AS i, list(coalesce(t.v, 0) ORDER BY y.i) AS a FROM (SELECT DISTINCT i FROM t) x CROSS JOIN (SELECT DISTINCT i FROM t) y LEFT JOIN t ON t.i = x.i AND t.j = y.i GROUP BY 1), nr AS (SELECT i, a, row_number() OVER (ORDER BY i) - 1 AS k, count(*) OVER () AS n FROM m)"


def _hec2(rounds: int = 16) -> str:
    """Rounds of accepted suitors; all of a round read the state before it."""
    out = [f"s0 AS MATERIALIZED (SELECT id, hn, {_p('id')} AS p, CASE WHEN id = hn THEN id END AS root FROM hn)"]
    for k in range(rounds):
        out.append(f"f{k} AS MATERIALIZED (SELECT id, hn, p FROM s{k} WHERE root IS NULL)")
        out.append(f"a{k} AS MATERIALIZED (SELECT v, m.i AS u, m.p AS p FROM (SELECT a.hn AS v, min({{'p': a.p, 'i': a.id}}) AS m FROM f{k} a JOIN f{k} b ON a.hn = b.id GROUP BY 1))")
        out.append(f"b{k} AS MATERIALIZED (SELECT x, min({{'p': p, 'u': u}}).u AS first FROM (SELECT u AS x, p, u FROM a{k} UNION ALL SELECT v, p, u FROM a{k}) GROUP BY 1)")
        out.append(f"t{k} AS MATERIALIZED (SELECT u, v FROM a{k} JOIN b{k} y ON y.x = u JOIN b{k} z ON z.x = v WHERE y.first = u AND z.first = u)")
        out.append(f"g{k} AS MATERIALIZED (SELECT s.id, hn, p, coalesce(root, got) AS root FROM s{k} s LEFT JOIN (SELECT u AS id, v AS got FROM t{k} UNION ALL SELECT v, v FROM t{k}) n ON n.id = s.id)")
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT a.id, a.hn, a.p, coalesce(a.root, b.root) AS root FROM g{k} a LEFT JOIN g{k} b ON a.hn = b.id)")
    return ",\n".join(out) + f"\nSELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cid FROM s{rounds}"


def _walk(n: str, salt: str, steps: int, against: str = "") -> str:
    """Steps of the walk from a hashed vector, kept apart from the constant one and from `against`, with respect to degrees. Tables n0, n1, ..."""
    unit = f"CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '-{salt}'), 1, 13) AS BIGINT) / 4503599627370496.0"
    apart = lambda t: f"SELECT id, d, x - (SELECT sum(x * d) / sum(d) FROM {t}) AS x FROM {t}"
    whole = lambda t: f"SELECT id, d, x / (SELECT sqrt(sum(x * x)) FROM {t}) AS x FROM {t}"
    out = [f"{n}a AS MATERIALIZED (SELECT id, CAST(wdeg AS DOUBLE) AS d, 2 * {unit} - 1 AS x FROM deg)", f"{n}b AS MATERIALIZED ({apart(n + 'a')})", f"{n}0 AS MATERIALIZED ({whole(n + 'b')})"]
    for k in range(steps):
        out.append(f"{n}p{k} AS MATERIALIZED (SELECT a.id, a.d, a.x - (a.d * a.x - coalesce(q.ax, 0)) / a.d / 2 AS x FROM {n}{k} a LEFT JOIN (SELECT src AS id, sum(w * x) AS ax FROM e JOIN {n}{k} ON dst = id GROUP BY 1) q ON q.id = a.id)")
        out.append(f"{n}q{k} AS MATERIALIZED ({apart(f'{n}p{k}')})")
        last = f"{n}q{k}"
        if against:
            out.append(f"{n}r{k} AS MATERIALIZED (SELECT a.id, a.d, a.x - y.x * (SELECT sum(s.x * s.d * t.x) / sum(t.x * s.d * t.x) FROM {last} s JOIN {against} t ON s.id = t.id) AS x FROM {last} a JOIN {against} y ON a.id = y.id)")
            last = f"{n}r{k}"
        out.append(f"{n}{k + 1} AS MATERIALIZED ({whole(last)})")
    return ",\n".join(out)


def _generated(n: int, per_row: int, band: int, where: str = "true") -> str:
    """Hashed entries in a band, repeats merged by their largest value."""
    unit = lambda salt: f"CAST('0x' || substr(md5(CAST(key AS VARCHAR) || '-{salt}'), 1, 13) AS BIGINT) / 4503599627370496.0"
    return f"""k AS (SELECT i, i * {per_row} + c AS key FROM range({n}) r(i) CROSS JOIN range({per_row}) q(c)), h AS (SELECT i, {unit('13721')} AS u, {unit('13721v')} AS z FROM k),
gen AS (SELECT i, ((i + CAST(floor((u - 0.5) * {band}) AS BIGINT)) % {n} + {n}) % {n} AS j, max(100 * z - 50) AS v FROM h GROUP BY 1, 2 HAVING {where})"""


_DOMINANT = """, off_ AS (SELECT * FROM gen WHERE i <> j) SELECT i, j, round(v, 6) AS v FROM off_
UNION ALL SELECT r.i, r.i, round(greatest(1.0, 1.5 * coalesce(s, 0)), 6) FROM range(200) r(i) LEFT JOIN (SELECT i, sum(abs(v)) AS s FROM off_ GROUP BY 1) t ON t.i = r.i"""
#: Reverse Cuthill-McKee: by component, level from its vertex of least degree, degree, id, all reversed.
_RCM = """, deg AS MATERIALIZED (SELECT src AS id, count(*) AS deg FROM e GROUP BY 1), lab AS MATERIALIZED (SELECT r.id, label, deg FROM r JOIN deg ON deg.id = r.id),
lv(id, lvl) AS (SELECT min({'d': deg, 'i': id}).i, CAST(0 AS BIGINT) FROM lab GROUP BY label UNION SELECT e.dst, lv.lvl + 1 FROM lv JOIN e ON e.src = lv.id WHERE lv.lvl < 60),
fl AS (SELECT id, min(lvl) AS lvl FROM lv GROUP BY 1), rcm AS (SELECT id, row_number() OVER (ORDER BY label DESC, lvl DESC, deg DESC, id DESC) - 1 AS rnk FROM lab JOIN fl USING (id))"""
_LOWER = """m AS (SELECT x.n_nationkey AS i, list(coalesce(t.v, 0) ORDER BY y.n_nationkey) AS a FROM nation x CROSS JOIN nation y LEFT JOIN t ON t.i = x.n_nationkey AND t.j = y.n_nationkey GROUP BY 1),
low AS (SELECT i, a, row_number() OVER (ORDER BY i) - 1 AS k FROM m)"""
_GOSH2 = f"""sd AS (SELECT id FROM deg WHERE deg > greatest(50, (SELECT sum(deg) // count(*) FROM deg))), k0 AS MATERIALIZED (SELECT id, id AS root FROM sd),
k1 AS MATERIALIZED (SELECT id, root FROM k0 UNION ALL SELECT id, root FROM (SELECT src AS id, k0.root, row_number() OVER (PARTITION BY src ORDER BY w DESC, {_p('dst')} DESC, dst DESC) AS rn FROM e JOIN k0 ON dst = k0.id WHERE src NOT IN (SELECT id FROM k0)) WHERE rn = 1),
k2 AS MATERIALIZED (SELECT id, root FROM k1 UNION ALL SELECT id, root FROM (SELECT src AS id, k1.root, row_number() OVER (PARTITION BY src ORDER BY deg.deg DESC, {_p('dst')} DESC, dst DESC) AS rn FROM e JOIN k1 ON dst = k1.id JOIN deg ON deg.id = dst WHERE src NOT IN (SELECT id FROM k1)) WHERE rn = 1),
hr AS MATERIALIZED (SELECT src AS id, dst AS hn FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, {_p('dst')} DESC, dst DESC) AS rn FROM e) WHERE rn = 1 AND src NOT IN (SELECT id FROM k2)),
hn AS MATERIALIZED (SELECT id, hn FROM hr WHERE hn NOT IN (SELECT id FROM k2))"""

#: Partitions grown from each seed: the vertex that raises the cut least joins, until half of all vertices (rounded down) are in.
_GROWN = """dg AS MATERIALIZED (SELECT src AS id, sum(w) AS d FROM e GROUP BY 1), tot AS (SELECT count(*) AS n FROM dg),
gr(seed, held) AS (SELECT id, [id] FROM dg UNION ALL (SELECT seed, list_append(any_value(held), min({'r': rise, 'id': id}).id) FROM (SELECT s.seed, any_value(s.held) AS held, dg.id, any_value(dg.d) - 2 * coalesce(sum(CASE WHEN list_contains(s.held, e.dst) THEN e.w END), 0) AS rise
FROM gr s CROSS JOIN tot CROSS JOIN dg LEFT JOIN e ON e.src = dg.id WHERE len(s.held) < tot.n // 2 AND NOT list_contains(s.held, dg.id) GROUP BY s.seed, dg.id) GROUP BY seed)),
fin AS (SELECT seed, held FROM gr, tot WHERE len(held) >= tot.n // 2),
grown AS (SELECT seed, CAST(sum(CASE WHEN list_contains(held, src) AND NOT list_contains(held, dst) THEN w ELSE 0 END) AS BIGINT) AS cut, CAST(any_value(len(held)) AS BIGINT) AS n FROM fin CROSS JOIN e GROUP BY seed)"""


def oracle_sql() -> dict[str, str]:
    w = "WITH "
    return {
        "copurchase_edges": w + COPURCHASE + " SELECT src, dst, w FROM e",
        "part_supplier_bipartite": "WITH half AS (SELECT l_partkey AS src, l_suppkey + (SELECT max(p_partkey) + 1 FROM part) AS dst, count(*) AS w FROM lineitem GROUP BY 1, 2) SELECT src, dst, w FROM half UNION ALL SELECT dst, src, w FROM half",
        "user_sequence_graph": w + USERS + " SELECT src, dst, w FROM e",
        "order_part_graph": w + ORDER_PART + " SELECT src, dst, w FROM e",
        "symmetrised_pairs": w + TRADE + " SELECT DISTINCT src, dst, CAST(1 AS BIGINT) AS w FROM (SELECT i AS src, j AS dst FROM t UNION ALL SELECT j, i FROM t) WHERE src <> dst",
        "merged_parallel_edges": "SELECT l_partkey AS src, l_suppkey AS dst, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2",
        "matrix_market_round_trip": w + USERS + " SELECT src, dst, CAST(1 AS BIGINT) AS w FROM e",
        "matrix_market_values": w + TRADE + " SELECT i, j, v FROM t WHERE i <> j",
        "compressed_rows_round_trip": w + ORDER_PART + ", n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS nr FROM (SELECT DISTINCT src AS id FROM e)) SELECT a.nr AS src, b.nr AS dst FROM e JOIN n a ON src = a.id JOIN n b ON dst = b.id",
        "edge_list_round_trip": w + USERS + " SELECT src, dst, w FROM e",
        "partition_file_round_trip": "SELECT p_partkey AS id, CAST(p_size % 2 AS INTEGER) AS part FROM part",
        "degree_stats": w + COPURCHASE + ", " + DEG + " SELECT max(deg) AS max_deg, CAST(sum(deg) AS BIGINT) AS total, CAST(sum(deg) // count(*) AS BIGINT) AS avg_deg, max(wdeg) AS max_wdeg FROM deg",
        "degree_histogram": w + COPURCHASE + ", " + DEG + " SELECT deg, count(*) AS cnt FROM deg GROUP BY 1",
        "degree_order": w + COPURCHASE + ", " + DEG + " SELECT id, row_number() OVER (ORDER BY deg, id) - 1 AS rnk FROM deg",
        "csr_offsets": w + COPURCHASE + ", " + DEG + " SELECT id, CAST(sum(deg) OVER (ORDER BY id) - deg AS BIGINT) AS row_start FROM deg",
        "lower_triangle": w + USERS + " SELECT src, dst FROM e WHERE src > dst",
        "incidence": w + USERS + ", n AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS edge_id, src, dst FROM e WHERE src > dst) SELECT edge_id, src AS vertex FROM n UNION ALL SELECT edge_id, dst FROM n",
        "running_price": w + PRICE + " SELECT i, CAST(sum(v) OVER (ORDER BY i) AS BIGINT) AS run FROM x",
        "first_above": w + PRICE + ", r AS (SELECT i, sum(v) OVER (ORDER BY i) AS run FROM x) SELECT min(i) AS i FROM r WHERE 2 * run >= (SELECT sum(v) FROM x)",
        "stable_split": w + SIZE + " SELECT i, v % 2 AS side, row_number() OVER (PARTITION BY v % 2 ORDER BY i) - 1 AS pos FROM s",
        "permuted_vector": w + PRICE + f" SELECT row_number() OVER (ORDER BY {_p('i')}, i) - 1 AS i, v FROM x",
        "members_by_color": w + SIZE + " SELECT v, count(*) AS n, min(i) AS first, max(i) AS last FROM s GROUP BY 1",
        "connected_components": _REACH.format(g=ORDER_PART) + " SELECT id, label FROM r",
        "largest_component": _REACH.format(g=ORDER_PART) + ", c AS (SELECT id, label FROM r), top AS (SELECT label FROM c GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1) SELECT id AS old_id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM c JOIN top USING (label)",
        "bfs_levels": "WITH RECURSIVE " + ORDER_PART + ", r AS (SELECT min(src) AS id, CAST(0 AS BIGINT) AS lvl FROM e UNION SELECT e.dst, r.lvl + 1 FROM r JOIN e ON e.src = r.id WHERE r.lvl < 60) SELECT id, min(lvl) AS lvl FROM r GROUP BY 1",
        "transpose_matrix": w + SUPPLY + " SELECT j AS i, i AS j, v FROM a",
        "spmv_weighted": w + COPURCHASE + ", " + SIZE + " SELECT src AS id, CAST(sum(w * v) AS BIGINT) AS y FROM e JOIN s ON dst = i GROUP BY 1",
        "spmv_transposed": w + SUPPLY + ", " + SIZE + " SELECT i, CAST(sum(v) AS BIGINT) AS v FROM (SELECT a.j AS i, 2 * a.v * s.v AS v FROM a JOIN s ON a.i = s.i UNION ALL SELECT s_suppkey, 3 * s_nationkey FROM supplier) GROUP BY 1",
        "spmv_columns": w + COPURCHASE + ", " + SIZE + ", " + PRICE + " SELECT src AS i, c, CAST(sum(w * v) AS BIGINT) AS v FROM e JOIN (SELECT i, CAST(0 AS BIGINT) AS c, v FROM s UNION ALL SELECT i, 1, v FROM x) ON dst = i GROUP BY 1, 2",
        "spgemm_two_hop": w + USERS + " SELECT a.src AS i, b.dst AS j, CAST(sum(a.w * b.w) AS BIGINT) AS v FROM e a JOIN e b ON a.dst = b.src GROUP BY 1, 2",
        "spadd": w + TRADE + " SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT i, j, 2 * v AS v FROM t UNION ALL SELECT j, i, -v FROM t) GROUP BY 1, 2",
        "spgemm_jacobi": w + TRADE + ", ab AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM t a JOIN t b ON a.j = b.i GROUP BY 1, 2) SELECT i, j, round(sum(v), 4) AS v FROM (SELECT i, j, CAST(v AS DOUBLE) AS v FROM t UNION ALL SELECT ab.i, ab.j, -0.5 * ab.v / d.v FROM ab JOIN t d ON d.i = ab.i AND d.j = ab.i) GROUP BY 1, 2",
        "diag_copy": w + TRADE + " SELECT i, v FROM t WHERE i = j",
        "sum_into": w + TRADE + " SELECT i, j, CASE WHEN (i + j) % 3 = 0 THEN v + 1000 ELSE v END AS v FROM t",
        "replace_values": w + TRADE + " SELECT i, j, CASE WHEN (i + j) % 3 = 0 THEN 1000 ELSE v END AS v FROM t",
        "block_round_trip": w + TRADE + " SELECT i, j, v FROM t",
        "gemm": w + TRADE + " SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT a.i, b.i AS j, 2 * a.v * b.v AS v FROM t a JOIN t b ON a.j = b.j UNION ALL SELECT i, j, 3 * v FROM t) GROUP BY 1, 2",
        "trmm": w + TRADE + " SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM t a JOIN t b ON a.j = b.i WHERE a.i >= a.j GROUP BY 1, 2",
        "blas1_summary": w + PRICE + ", " + SIZE + " SELECT CAST(sum(abs(x.v)) AS BIGINT) AS nrm1, CAST(sum(x.v * x.v) AS BIGINT) AS nrm2sq, max(abs(x.v)) AS nrminf, (SELECT i FROM x ORDER BY abs(v) DESC, i LIMIT 1) AS iamax, CAST(sum(x.v) AS BIGINT) AS total, CAST(sum(x.v * s.v) AS BIGINT) AS dot FROM x JOIN s USING (i)",
        "blas1_vectors": w + PRICE + ", " + SIZE + " SELECT i, 2 * x.v + 3 * s.v - x.v * s.v AS v, abs(2 * x.v + 3 * s.v - x.v * s.v) AS a FROM x JOIN s USING (i)",
        "weighted_norm": w + PRICE + ", " + SIZE + " SELECT round(sum(pow(abs(x.v) / abs(s.v + 1), 2)), 2) AS nrm2wsq FROM x JOIN s USING (i)",
        "greatest_difference": w + PRICE + ", " + SIZE + " SELECT CAST(max(abs(x.v - s.v)) AS DOUBLE) AS diff FROM x JOIN s USING (i)",
        "batched_small_dense": "SELECT p_partkey, round((3.0::DOUBLE * p_size - 1) / (3 * (p_size + 2.0::DOUBLE) - 1), 6) AS x0, round(((p_size + 2.0::DOUBLE) - p_size) / (3 * (p_size + 2.0::DOUBLE) - 1), 6) AS x1, round(3 * (p_size + 2.0::DOUBLE) - 1, 6) AS det FROM part",
        "array_algebra": "SELECT p_partkey, CAST(p_size * (p_size + 10) + 4 + 9 + 56 AS DOUBLE) AS dot, CAST(2 * (p_size + 9) + 2 AS DOUBLE) AS total FROM part",
        "all_reducers": "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_quantity + 3 AS BIGINT) AS v FROM lineitem) SELECT CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most, (SELECT id FROM r ORDER BY v, id LIMIT 1) AS least_at, (SELECT id FROM r ORDER BY v DESC, id LIMIT 1) AS most_at, product(sign(v)) AS sign, bool_and(v > 0) AS all_positive, bool_or(v % 2 = 1) AS any_odd, bit_and(v) AS band, bit_or(v) AS bor FROM r",
        "heavy_neighbor": w + COPURCHASE + ", " + HN + " SELECT id, hn FROM hn",
        "hec3_map": w + COPURCHASE + ", " + HEC3 + " SELECT id, cid FROM m",
        "hec3_coarse_edges": w + COPURCHASE + ", " + HEC3 + ", " + CONTRACTED + " SELECT src, dst, w FROM ce",
        "hec3_coarse_vertices": w + COPURCHASE + ", " + HEC3 + " SELECT cid AS id, count(*) AS vw FROM m GROUP BY 1",
        "contract_ptap": w + COPURCHASE + ", " + HEC3 + ", " + CONTRACTED + " SELECT src, dst, w FROM ce",
        "hec_map": w + COPURCHASE + ", " + HN + ",\n" + _hec_serial() + " SELECT id, dense_rank() OVER (ORDER BY up) - 1 AS cid FROM u5",
        "matching_pairs": w + USERS + ",\n" + _matching(),
        "leaf_pairs": w + ORDER_PART + ", " + DEG + ", l AS (SELECT e.dst AS hub, e.src AS id, (row_number() OVER (PARTITION BY e.dst ORDER BY e.src) - 1) // 2 AS k FROM e JOIN deg ON e.src = deg.id WHERE deg.deg = 1) SELECT min(id) AS a, max(id) AS b FROM l GROUP BY hub, k HAVING count(*) = 2",
        "twin_pairs": w + ORDER_PART + ", n AS (SELECT src AS id, list_sort(list(dst)) AS near FROM e GROUP BY 1), l AS (SELECT id, near, (row_number() OVER (PARTITION BY near ORDER BY id) - 1) // 2 AS k FROM n) SELECT min(id) AS a, max(id) AS b FROM l GROUP BY near, k HAVING count(*) = 2",
        "relative_round": w + ORDER_PART + f""", h AS (SELECT dst AS hub, src AS id, (row_number() OVER (PARTITION BY dst ORDER BY src) - 1) // 2 AS k FROM e WHERE src % 2 = 0),
two AS (SELECT hub, min(id) AS a, max(id) AS b FROM h GROUP BY hub, k HAVING count(*) = 2), off AS (SELECT hub, a AS id, b AS partner FROM two UNION ALL SELECT hub, b, a FROM two),
best AS (SELECT id, partner FROM (SELECT id, partner, row_number() OVER (PARTITION BY id ORDER BY {_p('hub')} DESC, hub DESC, partner DESC) AS rn FROM off) WHERE rn = 1)
SELECT x.id AS a, x.partner AS b FROM best x JOIN best y ON x.partner = y.id AND y.partner = x.id WHERE x.id < x.partner""",
        "mis2_set": w + ORDER_PART + ",\n" + _mis2() + " SELECT id FROM ist WHERE state = 1",
        "mis2_map": w + ORDER_PART + ",\n" + _mis2() + f""", rt AS (SELECT id, id AS root FROM ist WHERE state = 1),
nr AS MATERIALIZED (SELECT id, root FROM rt UNION ALL SELECT src, max(root) FROM e JOIN rt ON dst = id WHERE src NOT IN (SELECT id FROM rt) GROUP BY 1),
fr AS (SELECT id, root FROM (SELECT src AS id, root, row_number() OVER (PARTITION BY src ORDER BY w DESC, {_p('dst')} DESC, dst DESC, root DESC) AS rn FROM e JOIN nr ON dst = nr.id WHERE src NOT IN (SELECT id FROM nr)) WHERE rn = 1)
SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cid FROM (SELECT id, root FROM nr UNION ALL SELECT id, root FROM fr)""",
        "gosh_map": w + USERS + ", " + DEG + ",\n" + _gosh() + """, rt AS (SELECT id, deg FROM j15 WHERE state = 1),
jn AS (SELECT id, root FROM (SELECT src AS id, dst AS root, row_number() OVER (PARTITION BY src ORDER BY rt.deg DESC, dst DESC) AS rn FROM e JOIN rt ON dst = rt.id JOIN j15 q ON src = q.id WHERE q.state = -1) WHERE rn = 1)
SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cid FROM (SELECT id, id AS root FROM rt UNION ALL SELECT id, root FROM jn)""",
        "gosh2_seeds": w + COPURCHASE + ", " + DEG + " SELECT id FROM deg WHERE deg > greatest(50, (SELECT sum(deg) // count(*) FROM deg))",
        "gosh2_stage1": w + COPURCHASE + ", " + DEG + f", sd AS (SELECT id FROM deg WHERE deg > greatest(50, (SELECT sum(deg) // count(*) FROM deg))) SELECT id, root FROM (SELECT src AS id, dst AS root, row_number() OVER (PARTITION BY src ORDER BY w DESC, {_p('dst')} DESC, dst DESC) AS rn FROM e JOIN sd ON dst = sd.id WHERE src NOT IN (SELECT id FROM sd)) WHERE rn = 1",
        "recoarsen_matching_map": w + USERS + " SELECT count(DISTINCT src) AS vertices, CAST(1 AS BIGINT) AS parts FROM e",
        "coarsen_summary": w + COPURCHASE + ",\n" + _levels(),
        "prolong": w + COPURCHASE + ", " + HEC3 + " SELECT id, cid * 3 + 1 AS x FROM m",
        "restrict": w + COPURCHASE + ", " + HEC3 + " SELECT cid AS id, CAST(floor(sum(id % 2) / count(*) + 0.5) AS BIGINT) AS part FROM m GROUP BY 1",
        "edge_cut": w + COPURCHASE + ", " + PARITY + " SELECT CAST(sum(w) // 2 AS BIGINT) AS cut FROM e JOIN part_ a ON src = a.id JOIN part_ b ON dst = b.id WHERE a.part <> b.part",
        "gains": w + COPURCHASE + ", " + PARITY + ", " + GAINS + " SELECT id, gain FROM g",
        "imbalance": w + COPURCHASE + ", " + PARITY + " SELECT CAST(sum(CASE WHEN part = 0 THEN 1 ELSE -1 END) AS BIGINT) AS imb FROM part_",
        "median_bisection": w + COPURCHASE + ", " + DEG + " SELECT id, CAST(CASE WHEN row_number() OVER (ORDER BY wdeg, id) - 1 < (SELECT count(*) FROM deg) - ceil((SELECT count(*) FROM deg) / 2) THEN 0 ELSE 1 END AS BIGINT) AS part FROM deg",
        "weighted_bisection": w + COPURCHASE + ", " + DEG + " SELECT id, CAST(CASE WHEN 2 * (sum(deg) OVER (ORDER BY wdeg, id) - deg) < (SELECT sum(deg) FROM deg) THEN 0 ELSE 1 END AS BIGINT) AS part FROM deg",
        "cut_scan": w + COPURCHASE + ", " + _SCAN + " SELECT prefix, id, cut, imb FROM scan",
        "cut_scan_best_prefix": w + COPURCHASE + ", " + _SCAN + " SELECT prefix, cut, CAST(20 AS BIGINT) AS target FROM scan ORDER BY CASE WHEN abs(imb) <= 20 THEN 0 ELSE abs(imb) END, cut, prefix LIMIT 1",
        "partition_edit_distance": w + COPURCHASE + ", " + PARITY + " SELECT CAST(least(count(*) FILTER (part <> id % 3 % 2), count(*) FILTER (part = id % 3 % 2)) // 2 AS BIGINT) AS diff FROM part_",
        "split_subgraphs": w + USERS + ", " + PARITY + ", n AS (SELECT id, part, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS nr FROM part_) SELECT a.part, a.nr AS src, b.nr AS dst, w FROM e JOIN n a ON src = a.id JOIN n b ON dst = b.id WHERE a.part = b.part",
        "fm_improves": "SELECT true AS no_worse, true AS balanced",
        "batch_refinement": "SELECT true AS better",
        "bisect_quality": w + COPURCHASE + " SELECT count(DISTINCT src) AS n, true AS better, true AS balanced FROM e",
        "vec_project": w + SIZE + ", c AS (SELECT i, v - (SELECT avg(v) FROM s) AS x FROM s) SELECT i AS id, round(x / (SELECT sqrt(sum(x * x)) FROM c), 6) AS x FROM c",
        "power_iter_10": w + NATIONS + ", " + DEG + ",\n" + _power(),
        "rayleigh": w + USERS + ", " + DEG + ", x AS (SELECT id, CAST(id % 7 AS DOUBLE) AS x FROM deg), l AS (SELECT x.id, x.x, wdeg * x.x - n.ax AS lx FROM x JOIN deg USING (id) JOIN (SELECT src AS id, sum(w * x) AS ax FROM e JOIN x ON dst = id GROUP BY 1) n ON n.id = x.id) SELECT round(sum(x * lx) / sum(x * x), 6) AS quotient, round(sqrt(sum(lx * lx)), 4) AS norm, round(sum(x * lx) / sum(x * x) * count(*) / 4, 4) AS bound FROM l",
        "triangle_count": w + COPURCHASE + ", " + _TRI + " SELECT count(*) AS cnt FROM tri",
        "triangles_per_vertex": w + COPURCHASE + ", " + _TRI + " SELECT id, count(*) AS cnt FROM (SELECT unnest([a, b, c]) AS id FROM tri) GROUP BY 1",
        "coloring_conflicts": "SELECT CAST(0 AS BIGINT) AS conflicts",
        "experiment_stats": w + RUNS + ", f AS (SELECT graph, method, 'cut' AS figure, cut AS value FROM runs UNION ALL SELECT graph, method, 'time', time FROM runs) SELECT graph, method, figure, " + _STATS.format(c="value") + ", round(stddev_samp(value), 4) AS stdev FROM f GROUP BY 1, 2, 3",
        "experiment_level_stats": w + RUNS + ", f AS (SELECT graph, method, unnest(range(run % 3 + 1)) AS level, cut FROM runs), h AS (SELECT graph, method, level, CAST(floor(cut * 8 / pow(2, level)) AS BIGINT) AS value FROM f) SELECT graph, method, level, count(*) AS runs, " + _STATS.format(c="value") + " FROM h GROUP BY 1, 2, 3",
        "method_ratios": w + RATIOS + " SELECT graph, method, round(ratio, 6) AS ratio FROM ratios",
        "geomean": w + RATIOS + " SELECT method, round(exp(avg(ln(ratio))), 6) AS geomean FROM ratios GROUP BY 1",
        "coarsen_rate": w + RUNS + " SELECT graph, method, run, run % 3 + 1 AS levels, CASE WHEN run % 3 > 0 THEN round(pow(floor(cut * 8 / pow(2, run % 3)) / (cut * 8), 1 / (run % 3)), 6) END AS rate FROM runs",
        "cut_variation": w + RUNS + " SELECT graph, method, round(stddev_samp(cut) / avg(cut), 6) AS cv FROM runs GROUP BY 1, 2",
        "method_table": w + RUNS + ", " + MEDIANS + " SELECT graph, round(max(m) FILTER (method = '1'), 2) AS m1, round(max(m) FILTER (method = '2'), 2) AS m2, round(max(m) FILTER (method = '3'), 2) AS m3 FROM md GROUP BY 1",
        "normalised_times": w + RUNS + " SELECT graph, method, run, time, round(time / min(time) OVER (PARTITION BY graph), 6) AS normal FROM runs",
        "figures_by_run": w + RUNS + " SELECT graph, method, string_agg(CAST(cut AS VARCHAR), ',' ORDER BY run) AS cuts FROM runs GROUP BY 1, 2",
        "coloring_colors": "WITH RECURSIVE " + USERS + ", " + _colors("SELECT src, dst FROM e", "SELECT DISTINCT src AS id FROM e"),
        "d2_coloring_colors": "WITH RECURSIVE " + ORDER_PART + ", " + _colors("SELECT src, dst FROM e UNION SELECT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src WHERE x.src <> y.dst", "SELECT DISTINCT src AS id FROM e"),
        "bipartite_coloring": "WITH RECURSIVE " + ORDER_PART + ", " + _colors("SELECT DISTINCT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src WHERE x.src <> y.dst AND x.src % 2 = 0", "SELECT DISTINCT src AS id FROM e WHERE src % 2 = 0"),
        "balloon_clusters": "WITH RECURSIVE " + USERS + f""", st(id, cid) AS (SELECT id, CASE WHEN row_number() OVER (ORDER BY {_p('id')}, id) <= 16 THEN id END FROM (SELECT DISTINCT src AS id FROM e)),
r(id, cid, size, step) AS (SELECT id, cid, CAST(1 AS BIGINT), 0 FROM st WHERE cid IS NOT NULL UNION ALL
(SELECT id, cid, count(*) OVER (PARTITION BY cid) AS size, step FROM (SELECT id, cid, step + 1 AS step FROM r UNION ALL
SELECT src, min({{'size': r.size, 'cid': r.cid}}).cid, max(r.step) + 1 FROM r JOIN e ON e.dst = r.id WHERE src NOT IN (SELECT id FROM r) GROUP BY src) WHERE step < 40))
SELECT v.id, coalesce(l.cid, v.id) AS cid FROM (SELECT DISTINCT src AS id FROM e) v LEFT JOIN (SELECT id, cid FROM r WHERE step = (SELECT max(step) FROM r)) l ON v.id = l.id""",
        "incomplete_lu": w + TRADE + " SELECT i, j, CAST(CASE WHEN i = j THEN 4 * v + 100 ELSE v END AS BIGINT) AS v FROM t",
        "split_cuts": w + COPURCHASE + ", " + _ORDERED + " SELECT split, cut FROM cuts",
        "best_split": w + COPURCHASE + ", " + _ORDERED + " SELECT greatest(split, n - split) AS larger, cut FROM cuts, win ORDER BY cut, split DESC LIMIT 1",
        "median_cut": w + COPURCHASE + ", " + _ORDERED + ", md AS (SELECT median(x) AS m FROM ord), pt AS (SELECT id, CASE WHEN x < m THEN 0 ELSE 1 END AS part FROM ord, md) SELECT (SELECT count(*) FROM e JOIN pt a ON src = a.id JOIN pt b ON dst = b.id WHERE src < dst AND a.part <> b.part) AS cut, round(sum(part) / sum(1 - part), 6) AS balance FROM pt",
        "swept_partition": "WITH RECURSIVE " + COPURCHASE + ", " + _ORDERED + """, nb AS MATERIALIZED (SELECT a AS pos, b AS other FROM ends UNION ALL SELECT b, a FROM ends),
s(pos, now, best, moved) AS (SELECT lo - 1, (SELECT 2 * count(*) FROM ends WHERE a < lo AND b >= lo), (SELECT 2 * count(*) FROM ends WHERE a < lo AND b >= lo), CAST([] AS BIGINT[]) FROM win
UNION ALL (SELECT pos, upd, CASE WHEN upd <= best THEN upd ELSE best END, CASE WHEN upd <= best THEN list_append(moved, pos) ELSE moved END
FROM (SELECT s.pos + 1 AS pos, any_value(s.now) + 2 * coalesce(sum(CASE WHEN nb.other IS NULL THEN 0 WHEN nb.other < win.lo OR list_contains(s.moved, nb.other) THEN -1 ELSE 1 END), 0) AS upd, any_value(s.best) AS best, any_value(s.moved) AS moved
FROM s CROSS JOIN win LEFT JOIN nb ON nb.pos = s.pos + 1 WHERE s.pos + 1 < win.hi GROUP BY s.pos)))
SELECT id, CAST(CASE WHEN ord.pos < lo OR list_contains(l.moved, ord.pos) THEN 0 ELSE 1 END AS BIGINT) AS part FROM ord, win, (SELECT moved FROM s ORDER BY pos DESC LIMIT 1) l""",
        "interleaved_order": w + COPURCHASE + f""", part_ AS (SELECT DISTINCT src AS id, CASE WHEN src % 4 = 0 THEN 1 ELSE 0 END AS part FROM e), {GAINS},
im AS (SELECT sum(CASE WHEN part = 0 THEN 1 ELSE -1 END) AS imb FROM part_), mv AS (SELECT id, part, row_number() OVER (PARTITION BY part ORDER BY gain DESC, id) - 1 AS k FROM g JOIN part_ USING (id) WHERE gain > 0),
hv AS (SELECT CASE WHEN imb > 0 THEN 0 ELSE 1 END AS heavy, abs(imb) - greatest(20, abs(imb) // 10) AS goal FROM im),
sz AS (SELECT count(*) AS n FROM mv, hv WHERE part = heavy), off_ AS (SELECT CASE WHEN goal > 0 THEN least((goal + 1) // 2, n) ELSE 0 END AS o, n FROM hv, sz),
of2 AS (SELECT CASE WHEN goal > 0 AND (goal + 1) // 2 >= off_.n THEN off_.n ELSE o END AS o FROM off_, hv)
SELECT id, row_number() OVER (ORDER BY CASE WHEN part = heavy THEN k ELSE k + o END, CASE WHEN part = heavy THEN 1 ELSE 0 END) - 1 AS pos FROM mv, hv, of2""",
        "gggp_cuts": "WITH RECURSIVE " + NATIONS + ", " + _GROWN + " SELECT seed, cut, n FROM grown",
        "gggp_best_cut": "WITH RECURSIVE " + NATIONS + ", " + _GROWN + " SELECT min(cut) AS cut FROM grown",
        "fourway_cut": w + USERS + " SELECT count(DISTINCT src) AS n, CAST(4 AS BIGINT) AS parts, true AS better FROM e",
        "recoarsening_cycles": "SELECT true AS no_worse",
        "binary_graph_round_trip": w + USERS + " SELECT src, dst FROM e",
        "binary_graph_round_trip_32": w + USERS + " SELECT src, dst FROM e",
        "triangular_solve": "WITH RECURSIVE " + TRADE + """, m AS (SELECT x.n_nationkey AS i, list(coalesce(t.v, 0) ORDER BY y.n_nationkey) AS a FROM nation x CROSS JOIN nation y LEFT JOIN t ON t.i = x.n_nationkey AND t.j = y.n_nationkey GROUP BY 1),
low AS (SELECT i, a, row_number() OVER (ORDER BY i) - 1 AS k FROM m),
s(k, x) AS (SELECT CAST(0 AS BIGINT), CAST([] AS DOUBLE[]) UNION ALL SELECT s.k + 1, list_append(x, (i % 5 * 100.0 + 100 - coalesce(list_sum(list_transform(range(1, low.k + 1), lambda q: a[q] * x[q])), 0)) / (1.0 + coalesce(list_sum(a[1:low.k]), 0))) FROM s JOIN low ON low.k = s.k)
SELECT CAST(i AS BIGINT) AS i, round(x[low.k + 1], 6) AS v FROM low, (SELECT x FROM s ORDER BY k DESC LIMIT 1)""",
        "gs_sweep": "WITH RECURSIVE " + TRADE + ", " + _ROWS + """, rw AS (SELECT i, k, n, a, list_sum(a) AS b, 2.0 * (list_sum(a) - a[k + 1]) AS d FROM nr),
s(step, x) AS (SELECT CAST(0 AS BIGINT), CAST(list_transform(range(0, (SELECT max(n) FROM nr)), lambda q: 0.0) AS DOUBLE[]) UNION ALL
SELECT step + 1, list_transform(x, lambda o, q: CASE WHEN q = k + 1 THEN (b - list_sum(list_transform(range(1, n + 1), lambda z: CASE WHEN z = k + 1 THEN 0 ELSE a[z] * x[z] END))) / d ELSE o END)
FROM s JOIN rw ON rw.k = CASE WHEN step < n THEN step ELSE 2 * n - 1 - step END WHERE step < 2 * n)
SELECT i, round(x[k + 1], 6) AS v FROM nr, (SELECT x FROM s ORDER BY step DESC LIMIT 1)""",
        "banded_matrix": w + _generated(200, 5, 20) + _DOMINANT,
        "triangular_matrix": w + _generated(200, 5, 20, "((i + CAST(floor((any_value(u) - 0.5) * 20) AS BIGINT)) % 200 + 200) % 200 <= i") + _DOMINANT,
        "random_graph": w + _generated(300, 4, 300) + " SELECT DISTINCT src, dst, CAST(1 AS BIGINT) AS w FROM (SELECT i AS src, j AS dst FROM gen UNION ALL SELECT j, i FROM gen) WHERE src <> dst",
        "hec2_map": w + COPURCHASE + ", " + HN + ",\n" + _hec2(),
        "gosh2_map": w + COPURCHASE + ", " + DEG + ", " + _GOSH2 + ",\n" + _hec_serial() + " SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cid FROM (SELECT id, root FROM k2 UNION ALL SELECT hr.id, k2.root FROM hr JOIN k2 ON hr.hn = k2.id UNION ALL SELECT id, up FROM u5)",
        "rcm_order": _REACH.format(g=ORDER_PART) + _RCM + " SELECT id, rnk FROM rcm",
        "rcm_clusters": _REACH.format(g=ORDER_PART) + _RCM + " SELECT id, rnk // 8 AS cid FROM rcm",
        "trsm": "WITH RECURSIVE " + TRADE + ", " + _LOWER + """, s(k, c, x) AS (SELECT CAST(0 AS BIGINT), c, CAST([] AS DOUBLE[]) FROM range(3) q(c) UNION ALL
SELECT s.k + 1, c, list_append(x, (2.0 * (i + 1) * (c + 2) - coalesce(list_sum(list_transform(range(1, low.k + 1), lambda q: a[q] * x[q])), 0)) / (1.0 + coalesce(list_sum(a[1:low.k]), 0))) FROM s JOIN low ON low.k = s.k)
SELECT CAST(i AS BIGINT) AS i, c AS j, round(x[low.k + 1], 6) AS v FROM low JOIN s ON s.k = (SELECT max(k) FROM s)""",
        "trtri": "SELECT CAST(n_nationkey AS BIGINT) AS i, CAST(n_nationkey AS BIGINT) AS j, CAST(1 AS DOUBLE) AS v FROM nation",
        "two_stage_sweep": w + TRADE + """, o AS (SELECT i, j, CAST(v AS DOUBLE) AS v FROM t WHERE i <> j), d AS (SELECT i, 2 * sum(v) AS d FROM o GROUP BY 1), b AS (SELECT i, CAST(sum(v) AS DOUBLE) AS v FROM t GROUP BY 1), x0 AS (SELECT i, 0.0 AS v FROM b)""" + "".join(f""",
r{k} AS MATERIALIZED (SELECT b.i, b.v - coalesce(d.d * x.v, 0) - coalesce(s, 0) AS v FROM b JOIN x{k} x ON x.i = b.i LEFT JOIN d ON d.i = b.i LEFT JOIN (SELECT o.i, sum(o.v * x.v) AS s FROM o JOIN x{k} x ON o.j = x.i GROUP BY 1) q ON q.i = b.i),
y{k} AS MATERIALIZED (SELECT r.i, r.v / d.d AS v FROM r{k} r JOIN d ON d.i = r.i),
z{k} AS MATERIALIZED (SELECT r.i, (r.v - coalesce(s, 0)) / d.d AS v FROM r{k} r JOIN d ON d.i = r.i LEFT JOIN (SELECT o.i, sum(o.v * y.v) AS s FROM o JOIN y{k} y ON o.j = y.i WHERE o.i > o.j GROUP BY 1) q ON q.i = r.i),
w{k} AS MATERIALIZED (SELECT r.i, (r.v - coalesce(s, 0)) / d.d AS v FROM r{k} r JOIN d ON d.i = r.i LEFT JOIN (SELECT o.i, sum(o.v * z.v) AS s FROM o JOIN z{k} z ON o.j = z.i WHERE o.i > o.j GROUP BY 1) q ON q.i = r.i),
x{k + 1} AS MATERIALIZED (SELECT x.i, x.v + coalesce(w.v, 0) AS v FROM x{k} x LEFT JOIN w{k} w ON w.i = x.i)""" for k in range(2)) + " SELECT i, round(v, 6) AS v FROM x2",
        "spmv_stencil": w + SIZE + """, g AS (SELECT i, v, i // 25 AS a, i % 25 AS b FROM s), o(da, db, c) AS (VALUES (0, 0, 4), (-1, 0, -1), (1, 0, -1), (0, -1, -1), (0, 1, -1))
SELECT (a - da) * 25 + b - db AS i, CAST(sum(v * c) AS BIGINT) AS v FROM g CROSS JOIN o WHERE a - da >= 0 AND a - da <= (SELECT max(a) FROM g) AND b - db >= 0 AND b - db < 25 GROUP BY 1""",
        "spectral_bisection": w + USERS + " SELECT part, CAST(n AS BIGINT) AS n FROM (SELECT 0 AS part, n // 2 AS n FROM (SELECT count(DISTINCT src) AS n FROM e) UNION ALL SELECT 1, n - n // 2 FROM (SELECT count(DISTINCT src) AS n FROM e))",
        "weighted_aggregation": "WITH RECURSIVE " + USERS + ", " + DEG + f""", vx AS MATERIALIZED (SELECT id, wdeg, {_p('id')} AS p FROM deg),
pr AS MATERIALIZED (SELECT a.id AS id, b.id AS earlier, w FROM e JOIN vx a ON src = a.id JOIN vx b ON dst = b.id WHERE b.p < a.p OR b.p = a.p AND b.id < a.id),
r(id, rep) USING KEY (id) AS (SELECT id, true FROM vx WHERE id NOT IN (SELECT id FROM pr)
UNION (SELECT t.id, held < 0.3 * vx.wdeg FROM (SELECT pr.id, count(*) AS need, count(old.id) AS have, sum(CASE WHEN old.rep THEN w ELSE 0 END) AS held
FROM (SELECT DISTINCT pr.id FROM r JOIN pr ON pr.earlier = r.id) c JOIN pr ON pr.id = c.id LEFT JOIN recurring.r AS old ON old.id = pr.earlier GROUP BY pr.id) t JOIN vx ON vx.id = t.id WHERE need = have))
SELECT id, rep, round(w / sum(w) OVER (PARTITION BY id), 9) AS v FROM (SELECT src AS id, dst AS rep, w FROM e JOIN r a ON src = a.id JOIN r b ON dst = b.id WHERE NOT a.rep AND b.rep)
UNION ALL SELECT id, id, 1.0 FROM r WHERE rep""",
        "recoarsen_map": w + USERS + f""", own AS (SELECT src, dst, w FROM e WHERE src % 20 = dst % 20),
hb AS (SELECT src AS id, dst AS hn FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, {_p('dst')} DESC, dst DESC) AS rn FROM own) WHERE rn = 1),
lone AS (SELECT DISTINCT src AS id, src % 20 AS part, {_p('src')} AS p FROM e WHERE src NOT IN (SELECT id FROM hb)),
ring AS (SELECT id, coalesce(lead(id) OVER (PARTITION BY part ORDER BY p, id), first_value(id) OVER (PARTITION BY part ORDER BY p, id)) AS hn FROM lone),
hn AS (SELECT id, hn FROM hb UNION ALL SELECT id, hn FROM ring),\n""" + HEC3.split(",\n", 1)[1] + " SELECT id, cid FROM m",
        "drawing_coordinates": w + NATIONS + ", " + DEG + ",\n" + _walk("u", "a", 4) + ",\n" + _walk("v", "b", 4, "u4") + " SELECT u4.id, round(u4.x, 6) AS u2, round(v4.x, 6) AS u3 FROM u4 JOIN v4 ON u4.id = v4.id",
    }
