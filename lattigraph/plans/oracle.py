"""The queries in SQL, for those that SQL can express."""

from __future__ import annotations

ALPHA = 0.2

# graphs of the tables
PS = "ps AS MATERIALIZED (SELECT DISTINCT 2 * l_partkey AS src, 2 * l_suppkey + 1 AS dst FROM lineitem)"
PS_ARCS = PS + ", arcs AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE AS w FROM ps UNION ALL SELECT dst, src, 1.0 FROM ps)"
TRADE = """trade AS MATERIALIZED (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*)::DOUBLE AS weight FROM lineitem
 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
TRADE_ARCS = TRADE + """, tedges AS MATERIALIZED (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(weight) AS w FROM trade GROUP BY 1, 2),
 arcs AS MATERIALIZED (SELECT src, dst, w FROM tedges UNION ALL SELECT dst, src, w FROM tedges WHERE src <> dst)"""
PARTNERS = TRADE + """, both_ways AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM trade WHERE src <> dst UNION ALL SELECT dst, src, weight FROM trade WHERE src <> dst) GROUP BY 1, 2),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rk FROM both_ways),
 pedges AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM ranked WHERE rk <= 3)"""
PARTNER_ARCS = PARTNERS + ", arcs AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE AS w FROM pedges UNION ALL SELECT dst, src, 1.0 FROM pedges)"
CHAIN = "chain AS MATERIALIZED (SELECT * FROM (SELECT s_suppkey AS src, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS dst FROM supplier) WHERE dst IS NOT NULL)"
MEMBERS = "members AS MATERIALIZED (SELECT 2 * p_partkey AS node, regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS comm FROM part UNION ALL SELECT 2 * s_suppkey + 1, 1000 + s_nationkey FROM supplier)"
NORM = "norm AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM arcs), wdeg AS MATERIALIZED (SELECT src AS node, sum(w) AS d FROM arcs GROUP BY 1)"
NATION_POINTS = """points AS MATERIALIZED (SELECT x.c_nationkey::BIGINT AS node, x, y FROM (SELECT c_nationkey, round(avg(c_acctbal), 3) AS x FROM customer GROUP BY 1) x
 JOIN (SELECT c_nationkey, round(avg(o_totalprice) / 100, 3) AS y FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) y ON x.c_nationkey = y.c_nationkey WHERE y IS NOT NULL)"""
SUPPLIER_POINTS = "points AS MATERIALIZED (SELECT s_suppkey AS node, s_acctbal AS x, 10.0::DOUBLE * s_suppkey AS y FROM supplier)"
UNIT = "seeds AS (SELECT DISTINCT src AS source, src AS node, 1.0::DOUBLE AS value FROM arcs)"
DEGREE = "seeds AS (SELECT node AS source, node, d AS value FROM wdeg)"
SUPER = "sizes AS (SELECT comm, count(*) AS size FROM members GROUP BY 1), seeds AS (SELECT comm AS source, node, d / size AS value FROM members JOIN sizes USING (comm) JOIN wdeg USING (node))"


def power(steps: int, name: str = "pi") -> str:
    """CTEs that unroll power steps over ``seeds`` and ``norm``."""
    parts = ["x0 AS MATERIALIZED (SELECT source, node, sum(value) AS value FROM seeds GROUP BY 1, 2)"]
    parts += [f"x{i} AS MATERIALIZED (SELECT source, dst AS node, sum({1 - ALPHA} * value * p) AS value FROM x{i - 1} JOIN norm ON node = src GROUP BY 1, 2)" for i in range(1, steps + 1)]
    union = " UNION ALL ".join(f"SELECT * FROM x{i}" for i in range(steps + 1))
    return ", ".join(parts) + f", {name} AS MATERIALIZED (SELECT source, node, {ALPHA} * sum(value) AS value FROM ({union}) GROUP BY 1, 2)"


def pushes(rounds: int, rmax: float | str, backward: bool = False, s: str = "s", a: str = "a", seeds: str = "seeds") -> str:
    """CTEs that unroll synchronous push rounds; the first pushes every residue. ``rmax``: a number, or SQL of a row's threshold. Rounds
    in which nothing is over the threshold change nothing, so enough of them reach the fixpoint."""
    at, to = ("dst", "src") if backward else ("src", "dst")
    parts = [f"{s}0 AS MATERIALIZED (SELECT source, node, 0.0::DOUBLE AS reserve, sum(value) AS residue FROM {seeds} GROUP BY 1, 2)"]
    for i in range(1, rounds + 1):
        over = "residue > 0" if i == 1 else f"residue > {rmax}" + ("" if backward else " * d")
        parts.append(f"{a}{i} AS MATERIALIZED (SELECT s.*, {over} AS hot FROM {s}{i - 1} s JOIN wdeg USING (node))")
        parts.append(f"""{s}{i} AS MATERIALIZED (SELECT source, node, sum(reserve) AS reserve, sum(residue) AS residue FROM (
 SELECT source, node, CASE WHEN hot THEN reserve + {ALPHA} * residue ELSE reserve END AS reserve, CASE WHEN hot THEN 0 ELSE residue END AS residue FROM {a}{i}
 UNION ALL SELECT source, {to}, 0, {1 - ALPHA} * residue * p FROM {a}{i} JOIN norm ON node = {at} WHERE hot) GROUP BY 1, 2)""")
    return ", ".join(parts)


PDIST = "n AS (SELECT count(DISTINCT src)::DOUBLE AS n FROM arcs), nodes AS (SELECT DISTINCT src AS node FROM arcs), grid AS (SELECT a.node AS i, b.node AS j FROM nodes a CROSS JOIN nodes b)"


def pdist(weighted: bool = True, clamp: bool = True, arcs: str = PARTNER_ARCS, name: str = "dist") -> str:
    value = "value * (d + 1)" if weighted else "value"
    far = "2 * log2(n)"
    raw = f"CASE WHEN coalesce(value, 0) > 0 THEN 1 - log2(value) ELSE {far} END"
    d = f"greatest(2.0, least({raw}, {far}))" if clamp else raw
    return f"""{arcs}, {NORM}, {UNIT}, {power(15)}, {PDIST},
 dppr AS (SELECT source AS i, node AS j, value FROM (SELECT pi.source, pi.node, {value} AS value FROM pi JOIN wdeg ON wdeg.node = pi.source)),
 prox AS MATERIALIZED (SELECT i, j, sum(value) AS value FROM (SELECT i, j, value FROM dppr UNION ALL SELECT j, i, value FROM dppr) GROUP BY 1, 2),
 {name} AS MATERIALIZED (SELECT i, j, {d} AS d FROM grid LEFT JOIN prox USING (i, j) CROSS JOIN n)"""


TURN = "(by - ay) * (cx - bx) - (bx - ax) * (cy - by)"
DNPR = f"dn AS MATERIALIZED (SELECT node, d / (SELECT sum(d) FROM wdeg) * {1 - (1 - ALPHA) ** 20!r} AS dnpr FROM wdeg)"
TAU = "tau AS (SELECT 1 / sqrt(25 * count(*)) / 10 AS tau FROM wdeg)"


def orient(p: str, q: str, r: str) -> str:
    v = f"({q}y - {p}y) * ({r}x - {q}x) - ({q}x - {p}x) * ({r}y - {q}y)"
    return f"(CASE WHEN {v} > 0 THEN 1 WHEN {v} < 0 THEN 2 ELSE 0 END)"


def on_segment(p: str, q: str, r: str) -> str:
    return f"({q}x <= greatest({p}x, {r}x) AND {q}x >= least({p}x, {r}x) AND {q}y <= greatest({p}y, {r}y) AND {q}y >= least({p}y, {r}y))"


def meet(a: str, b: str, c: str, d: str) -> str:
    o1, o2, o3, o4 = orient(a, b, c), orient(a, b, d), orient(c, d, a), orient(c, d, b)
    return f"(({o1} <> {o2} AND {o3} <> {o4}) OR ({o1} = 0 AND {on_segment(a, c, b)}) OR ({o2} = 0 AND {on_segment(a, d, b)}) OR ({o3} = 0 AND {on_segment(c, a, d)}) OR ({o4} = 0 AND {on_segment(c, b, d)}))"


PS_SOURCES = "cluster AS MATERIALIZED (SELECT DISTINCT dst AS node FROM ps WHERE dst <= 81)"
#: What sets thresholds: n, m, and of them delta and its relative error.
SIZE = "size AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, sum(d) / 2 AS m FROM wdeg), small AS MATERIALIZED (SELECT n, m, 1 / (250 * ln(n)) AS delta, 2 * m / n AS mean, 1 / sqrt(25 * n) AS tau_max FROM size)"


def epsilon(delta: str) -> str:
    return f"least(1 - 1 / n, greatest(1 - sqrt(2 * ({delta}) / exp(1.0::DOUBLE)), 1 - exp(-1.0::DOUBLE)))"


def push_limit(tau: str) -> str:
    """The threshold of a push without walks, as CTE ``lim``; ``tau``: SQL of the largest DNPR of a target."""
    return f"lim AS MATERIALIZED (SELECT {epsilon('mean * delta')} * mean * delta / (2 * m * ({tau})) AS rmax FROM small)"


def backward(members: str, rounds: int = 40) -> str:
    """CTEs up to ``bw`` (source, target, dppr), the backward index of the supernodes ``members`` (node, comm)."""
    delta = "n * tau_max / 25"
    return f"""heavy AS MATERIALIZED (SELECT node AS target, comm FROM dn JOIN {members} USING (node) CROSS JOIN small WHERE dnpr > tau_max),
 widest AS MATERIALIZED (SELECT target, max(d) AS dmax FROM heavy h JOIN {members} o ON o.comm = h.comm AND o.node <> target JOIN wdeg w ON w.node = o.node GROUP BY 1),
 blim AS MATERIALIZED (SELECT target, {epsilon(delta)} * ({delta}) / dmax AS rmax FROM widest CROSS JOIN small), bseeds AS (SELECT target AS source, target AS node, 1.0::DOUBLE AS value FROM widest),
 {pushes(rounds, "(SELECT rmax FROM blim WHERE target = source)", True, "bs", "ba", "bseeds")},
 bw AS MATERIALIZED (SELECT b.node AS source, b.source AS target, reserve * d AS dppr FROM bs{rounds} b JOIN wdeg w ON w.node = b.node JOIN heavy h ON h.target = b.source JOIN {members} o ON o.node = b.node AND o.comm = h.comm WHERE reserve <> 0)"""


def oracles() -> dict[str, str]:
    exact = f"{PARTNER_ARCS}, {NORM}, {DEGREE}, {power(140)}"
    comm = "cw AS MATERIALIZED (SELECT s.comm AS cs, d.comm AS cd, sum(w) AS w FROM arcs JOIN members s ON src = s.node JOIN members d ON dst = d.node GROUP BY 1, 2)"
    neighbours = "nc AS MATERIALIZED (SELECT src AS node, comm, sum(w) AS w FROM arcs JOIN members ON dst = node WHERE src <> dst GROUP BY 1, 2)"
    simrank = ["r0 AS MATERIALIZED (SELECT DISTINCT src AS i, src AS j, 1.0::DOUBLE AS value FROM arcs)"]
    for k in range(1, 5):
        simrank.append(f"h{k} AS MATERIALIZED (SELECT src AS i, j, sum(p * value) AS value FROM r{k - 1} JOIN norm ON i = dst GROUP BY 1, 2)")
        simrank.append(f"r{k} AS MATERIALIZED (SELECT i, src AS j, 0.9 * sum(p * value) AS value FROM h{k} JOIN norm ON j = dst GROUP BY i, src HAVING i <> src UNION ALL SELECT * FROM r0)")
    ends = f"{PARTNERS}, {NATION_POINTS}, ends AS MATERIALIZED (SELECT src, dst, s.x AS sx, s.y AS sy, d.x AS dx, d.y AS dy FROM pedges JOIN points s ON src = s.node JOIN points d ON dst = d.node)"
    both_ends = ends + ", arcs2 AS (SELECT * FROM ends UNION ALL SELECT dst, src, dx, dy, sx, sy FROM ends)"
    vec = "sqrt(power(a.dx - a.sx, 2) + power(a.dy - a.sy, 2))", "sqrt(power(b.dx - b.sx, 2) + power(b.dy - b.sy, 2))"
    cosine = f"((a.dx - a.sx) / {vec[0]}) * ((b.dx - b.sx) / {vec[1]}) + ((a.dy - a.sy) / {vec[0]}) * ((b.dy - b.sy) / {vec[1]})"
    hop = ["f0 AS MATERIALIZED (SELECT DISTINCT src AS i, src AS j, 0 AS h FROM arcs)"]
    for k in range(1, 25):
        hop.append(f"f{k} AS MATERIALIZED (SELECT i, j, min(h) AS h FROM (SELECT * FROM f{k - 1} UNION ALL SELECT i, dst, h + 1 FROM f{k - 1} JOIN arcs ON j = src) GROUP BY 1, 2)")
    leaves = "chain_comp AS (SELECT s_suppkey AS node, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS comp, count(*) OVER (PARTITION BY s_nationkey) AS size FROM supplier)"
    out = {
        "edges_canonical": f"WITH {PS} SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM ps",
        "arcs_symmetric": "WITH e AS (SELECT DISTINCT 2 * o_custkey AS src, 2 * o_orderkey + 1 AS dst FROM orders) SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e",
        "degree": f"WITH {PS_ARCS} SELECT src AS node, count(*) AS deg FROM arcs GROUP BY 1",
        "weighted_degree": f"WITH {TRADE_ARCS} SELECT src AS node, sum(w) AS wdeg FROM arcs GROUP BY 1",
        "self_loop_weight": f"WITH {TRADE_ARCS} SELECT src AS node, sum(CASE WHEN src = dst THEN w ELSE 0 END) AS loop FROM arcs GROUP BY 1",
        "graph_stats": f"WITH {PS_ARCS} SELECT count(DISTINCT src) AS n, (count(*) // 2)::BIGINT AS m, round(count(*)::DOUBLE / count(DISTINCT src), 9) AS avg_degree FROM arcs",
        "renumber_dense": f"WITH {PS_ARCS}, ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS new FROM (SELECT DISTINCT src AS node FROM arcs)) SELECT a.new AS src, b.new AS dst FROM (SELECT least(src, dst) AS src, greatest(src, dst) AS dst FROM ps) e JOIN ids a ON e.src = a.node JOIN ids b ON e.dst = b.node",
        "induced_subgraph": f"WITH {PARTNER_ARCS}, deg AS (SELECT src AS node, count(*) AS deg FROM arcs GROUP BY 1), big AS (SELECT node FROM deg WHERE deg >= (SELECT avg(deg) FROM deg)) SELECT src, dst FROM arcs WHERE src IN (SELECT node FROM big) AND dst IN (SELECT node FROM big)",
        "symmetry_violations": f"WITH {TRADE} SELECT a.src, a.dst, a.weight AS w, b.weight AS back FROM trade a LEFT JOIN trade b ON a.src = b.dst AND a.dst = b.src WHERE b.weight IS NULL OR a.weight <> b.weight",
        "reverse_arcs": f"WITH {PARTNERS} SELECT dst AS src, src AS dst FROM pedges",
        "row_normalized": f"WITH {TRADE_ARCS}, {NORM} SELECT src, dst, round(p, 9) AS p FROM norm",
        "ppr_truncated": f"WITH {PARTNER_ARCS}, {NORM}, {UNIT}, {power(15)} SELECT source, node, round(value, 9) AS value FROM pi",
        "dppr_exact": f"WITH {exact} SELECT source, node, round(value, 7) AS value FROM pi",
        "dppr_weighted": f"WITH {TRADE_ARCS}, {NORM}, {DEGREE}, {power(150)} SELECT source, node, round(value, 5) AS value FROM pi",
        "super_dppr": f"WITH {PS_ARCS}, {NORM}, {MEMBERS}, {SUPER}, {power(15)} SELECT source, comm AS target, round(sum(value) / any_value(size), 9) AS value FROM pi JOIN members USING (node) JOIN sizes USING (comm) GROUP BY 1, 2",
        "dnpr_iter": f"WITH {PS_ARCS}, {NORM}, seeds AS (SELECT 0::BIGINT AS source, node, d / (SELECT sum(d) FROM wdeg) AS value FROM wdeg), {power(19)} SELECT node, round(value, 12) AS dnpr FROM pi",
        "dnpr_closed": f"WITH {PS_ARCS}, {NORM}, {DNPR} SELECT node, round(dnpr, 12) AS dnpr FROM dn",
        "push_forward_rounds": f"WITH {PARTNER_ARCS}, {NORM}, {DEGREE}, {pushes(5, 0.01)} SELECT source, node, round(reserve, 9) AS reserve, round(residue, 9) AS residue FROM s5 WHERE reserve <> 0 OR residue <> 0",
        "push_backward_rounds": f"WITH {PARTNER_ARCS}, {NORM}, {UNIT}, {pushes(5, 0.01, True)} SELECT source, node, round(reserve, 9) AS reserve, round(residue, 9) AS residue FROM s5 WHERE reserve <> 0 OR residue <> 0",
        "push_virtual_rounds": f"WITH {PS_ARCS}, {NORM}, {MEMBERS}, {SUPER}, {pushes(3, 0.0003)} SELECT source, node, round(reserve, 9) AS reserve, round(residue, 9) AS residue FROM s3 WHERE reserve <> 0 OR residue <> 0",
        "simrank": f"WITH {PARTNER_ARCS}, {NORM}, {', '.join(simrank)} SELECT i, j, round(value, 9) AS value FROM r4",
        "pdist": f"WITH {pdist()} SELECT i, j, round(d, 9) AS d FROM dist",
        "pdist_vanilla": f"WITH {pdist(weighted=False)} SELECT i, j, round(d, 9) AS d FROM dist",
        "pdist_unclamped": f"WITH {pdist(clamp=False)} SELECT i, j, round(d, 9) AS d FROM dist",
        "pdist_natural_log": f"WITH {exact}, prox AS (SELECT i, j, sum(value) AS value FROM (SELECT source AS i, node AS j, value FROM pi UNION ALL SELECT node, source, value FROM pi) GROUP BY 1, 2) SELECT i, j, round(1 - ln(value), 7) AS d FROM prox",
        "radius_inflate": f"WITH {pdist()}, sz AS (SELECT c_nationkey::BIGINT AS node, count(*) AS size FROM customer GROUP BY 1), r AS (SELECT node, 0.03 * (SELECT avg(d) FROM dist) / sqrt((SELECT avg(size) FROM sz)) * sqrt(size) AS r FROM sz) SELECT i, j, round(d + a.r + b.r, 9) AS d FROM dist JOIN r a ON i = a.node JOIN r b ON j = b.node",
        "component_weight_boost": f"""WITH {CHAIN}, {pdist(arcs="arcs AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE AS w FROM chain UNION ALL SELECT dst, src, 1.0 FROM chain)")}, {leaves},
 comp AS (SELECT * FROM chain_comp WHERE size > 1), sizes AS (SELECT comp, any_value(size) AS size FROM comp GROUP BY 1),
 run AS (SELECT comp, sum(size) OVER (ORDER BY size, comp ROWS UNBOUNDED PRECEDING) AS upto FROM sizes), small AS (SELECT comp FROM run WHERE upto <= 0.5 * (SELECT sum(size) FROM sizes) + 1e-9),
 chosen AS (SELECT node, comp FROM comp WHERE comp IN (SELECT comp FROM small))
 SELECT i, j, round(CASE WHEN a.comp <> b.comp THEN 2 / (d * d) ELSE 1 / (d * d) END, 9) AS w FROM dist LEFT JOIN chosen a ON i = a.node LEFT JOIN chosen b ON j = b.node""",
        "hop_distance": f"WITH {PARTNER_ARCS}, {PDIST}, {', '.join(hop)} SELECT i, j, CASE WHEN i = j OR h IS NULL THEN 0.0::DOUBLE ELSE h + 1.0::DOUBLE END AS d FROM grid LEFT JOIN f24 USING (i, j)",
        "connected_components": "WITH e AS (SELECT 2 * o_custkey AS c, 2 * o_orderkey + 1 AS o FROM orders), k AS (SELECT c, least(c, min(o)) AS comp FROM e GROUP BY c) SELECT DISTINCT c AS node, comp FROM k UNION ALL SELECT DISTINCT o, comp FROM e JOIN k USING (c)",
        "largest_component": f"WITH {leaves} SELECT node FROM chain_comp WHERE comp = (SELECT comp FROM chain_comp WHERE size > 1 ORDER BY size DESC, comp LIMIT 1)",
        "modularity": f"WITH {PS_ARCS}, {MEMBERS}, {comm}, per AS (SELECT cs, sum(CASE WHEN cs = cd THEN w ELSE 0 END) AS inside, sum(w) AS tot FROM cw GROUP BY 1), m AS (SELECT sum(w) AS m2 FROM arcs) SELECT round(sum(inside / m2 - (tot / m2) * (tot / m2)), 9) AS modularity FROM per CROSS JOIN m",
        "merge_gain": f"WITH {PS_ARCS}, {NORM}, {MEMBERS}, {neighbours}, tot AS (SELECT comm, sum(d) AS tot FROM wdeg JOIN members USING (node) GROUP BY 1), m AS (SELECT sum(w) AS m2 FROM arcs) SELECT node, comm, round(w - tot * d / m2, 7) AS gain FROM nc JOIN wdeg USING (node) JOIN tot USING (comm) CROSS JOIN m",
        "neighbor_communities": f"WITH {PS_ARCS}, {MEMBERS}, {neighbours} SELECT node, comm, w FROM nc",
        "coarsen": f"WITH {PS_ARCS}, {MEMBERS}, {comm} SELECT cs AS src, cd AS dst, w FROM cw",
        "hierarchy_expand": "SELECT 0 AS component, 1 AS level, s_nationkey::BIGINT AS id, s_suppkey AS leaf FROM supplier UNION ALL SELECT 0, 2, n_regionkey::BIGINT, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey",
        "cluster_stats": f"WITH {PS_ARCS}, {NORM}, {MEMBERS} SELECT comm, count(*) AS size, round(sum(d), 9) AS dsum, round(avg(d), 9) AS dmean, round(max(d), 9) AS dmax FROM wdeg JOIN members USING (node) GROUP BY 1",
        "community_sizes": f"WITH {MEMBERS}, s AS (SELECT comm, count(*) AS size FROM members GROUP BY 1) SELECT min(size) AS min_size, max(size) AS max_size, floor(avg(size))::BIGINT AS avg_size FROM s",
        "cluster_mean_dnpr": f"WITH {PS_ARCS}, {NORM}, {MEMBERS}, {DNPR} SELECT comm, round(avg(dnpr), 12) AS mean_dnpr FROM dn JOIN members USING (node) GROUP BY 1",
        "top_k_hubs": f"WITH {PS_ARCS}, {NORM}, {MEMBERS}, {DNPR}, r AS (SELECT node, dnpr, comm, row_number() OVER (ORDER BY round(dnpr, 15) DESC, node DESC) AS rank FROM dn JOIN members USING (node)) SELECT node, round(dnpr, 12) AS dnpr, comm, rank::INTEGER AS rank FROM r WHERE rank <= 25",
        "tau_targets": f"WITH {PS_ARCS}, {NORM}, {DNPR}, {TAU} SELECT node, round(dnpr, 12) AS dnpr FROM dn CROSS JOIN tau WHERE dnpr > tau",
        "tau_split": f"WITH {PS_ARCS}, {NORM}, {DNPR}, {TAU} SELECT (count(*) FILTER (dnpr > tau))::BIGINT AS heavy, round(max(dnpr) FILTER (dnpr <= tau), 12) AS next_dnpr FROM dn CROSS JOIN tau",
        "rescale": f"WITH {SUPPLIER_POINTS}, b AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS span FROM points) SELECT node, round((x - x0) * (1.0::DOUBLE / span), 9) AS x, round((y - y0) * (1.0::DOUBLE / span), 9) AS y FROM points CROSS JOIN b",
        "plot_extent": f"WITH {SUPPLIER_POINTS} SELECT round(min(x - sqrt(abs(x))), 9) AS xmin, round(max(x + sqrt(abs(x))), 9) AS xmax, round(min(y - sqrt(abs(x))), 9) AS ymin, round(max(y + sqrt(abs(x))), 9) AS ymax FROM points",
        "node_distribution": f"WITH {SUPPLIER_POINTS} SELECT round(sum(1 / (power(a.x - b.x, 2) + power(a.y - b.y, 2))), 9) AS nd FROM points a JOIN points b ON a.node > b.node",
        "edge_length_cv": f"WITH {ends}, l AS (SELECT sqrt(power(sx - dx, 2) + power(sy - dy, 2)) AS l FROM ends) SELECT round(stddev_pop(l) / avg(l), 9) AS ulcv FROM l",
        "angular_resolution": f"WITH {both_ends}, c AS (SELECT {cosine} AS c FROM arcs2 a JOIN arcs2 b ON a.src = b.src AND a.dst < b.dst) SELECT round(sum(1 - power(least(15.0, CASE WHEN c >= 1 THEN 0 ELSE degrees(acos(greatest(c, -1.0))) END), 2) / 225), 9) AS ar FROM c",
        "segment_orientation": f"WITH {CHAIN}, {SUPPLIER_POINTS}, t AS (SELECT e.src AS a, e.dst AS b, f.dst AS c FROM chain e JOIN chain f ON e.dst = f.src), p AS (SELECT a, b, c, pa.x AS ax, pa.y AS ay, pb.x AS bx, pb.y AS \"by\", pc.x AS cx, pc.y AS cy FROM t JOIN points pa ON a = pa.node JOIN points pb ON b = pb.node JOIN points pc ON c = pc.node) SELECT a, b, c, (CASE WHEN {TURN.replace('by', chr(34) + 'by' + chr(34))} > 0 THEN 1 WHEN {TURN.replace('by', chr(34) + 'by' + chr(34))} < 0 THEN 2 ELSE 0 END)::INTEGER AS turn FROM p",
        "crossing_ratio": f"WITH {ends}, m AS (SELECT count(*) AS m FROM pedges), d AS (SELECT sum(c * (c - 1) / 2.0) AS shared FROM (SELECT node, count(*)::DOUBLE AS c FROM (SELECT src AS node FROM pedges UNION ALL SELECT dst FROM pedges) GROUP BY 1)), x AS (SELECT count(*) AS crossings FROM ends a JOIN ends b ON (a.src > b.src OR (a.src = b.src AND a.dst > b.dst)) AND a.src <> b.src AND a.dst <> b.dst AND a.src <> b.dst AND a.dst <> b.src AND {meet('a.s', 'a.d', 'b.s', 'b.d')}) SELECT crossings, round(crossings / (m * (m - 1) / 2.0 - shared), 9) AS ratio FROM x CROSS JOIN m CROSS JOIN d",
    }
    sources = f"{PS_ARCS}, {NORM}, {PS_SOURCES}"
    units = "seeds AS (SELECT node AS source, node, 1.0::DOUBLE AS value FROM cluster)"
    degrees = "seeds AS (SELECT node AS source, node, d AS value FROM cluster JOIN wdeg USING (node))"
    state = "source, node, round(reserve, 9) AS reserve, round(residue, 9) AS residue"
    value = "source, node, round(value, 9) AS value"
    fpsn = f"WITH {sources}, {DNPR}, {SIZE}, {push_limit('SELECT max(dnpr) FROM dn JOIN cluster USING (node)')}, {degrees}, {pushes(40, '(SELECT rmax FROM lim)')} SELECT source, node, round(reserve, 9) AS value FROM s40 JOIN cluster USING (node) WHERE reserve <> 0 OR residue <> 0"
    tau = "SELECT coalesce(max(dnpr), any_value(tau_max)) FROM (SELECT dnpr FROM dn JOIN cluster USING (node) CROSS JOIN small WHERE dnpr <= tau_max) RIGHT JOIN small ON true"
    ps_dense = "ids AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) - 1 AS new FROM (SELECT DISTINCT src AS node FROM arcs))"
    within = lambda *methods: f"WITH {PS}, {PS_SOURCES}, c AS (SELECT count(*) AS k FROM cluster) SELECT method, k * k AS pairs, 0::BIGINT AS outside FROM c CROSS JOIN (VALUES {', '.join(f'({chr(39)}{m}{chr(39)})' for m in methods)}) v(method)"
    e = "1 - exp(-1.0::DOUBLE)"
    out |= {
        "ppr_truncated_ps": f"WITH {sources}, {units}, {power(15)} SELECT {value} FROM pi",
        "dppr_exact_ps": f"WITH {sources}, {degrees}, {power(125)} SELECT source, node, round(value, 7) AS value FROM pi",
        "push_forward_ps": f"WITH {sources}, {degrees}, {pushes(60, 0.0001)} SELECT {state} FROM s60 WHERE reserve <> 0 OR residue <> 0",
        "push_backward_ps": f"WITH {sources}, {units}, {pushes(40, 0.001, True)} SELECT {state} FROM s40 WHERE reserve <> 0 OR residue <> 0",
        "fpsn": fpsn,
        "fpsn_join": fpsn,
        "tau_push": f"""WITH {sources}, {DNPR}, {SIZE}, {push_limit(tau)}, {degrees}, {pushes(40, "(SELECT rmax FROM lim)")}, own AS MATERIALIZED (SELECT node, 0 AS comm FROM cluster), {backward("own")},
 f AS (SELECT source, node, reserve AS value FROM s40 JOIN cluster USING (node) WHERE reserve <> 0 OR residue <> 0)
 SELECT coalesce(f.source, bw.source) AS source, coalesce(f.node, bw.target) AS node, round(coalesce(dppr, value), 9) AS value FROM f FULL JOIN bw ON f.source = bw.source AND f.node = bw.target""",
        "super_tau_push": f"""WITH {PS_ARCS}, {NORM}, {MEMBERS}, {SUPER}, {DNPR}, {SIZE}, {push_limit("SELECT max(d) FROM (SELECT avg(dnpr) AS d FROM dn JOIN members USING (node) GROUP BY comm)")}, {pushes(60, "(SELECT rmax FROM lim)")}
 SELECT source, comm AS target, round(sum(reserve) / any_value(size), 9) AS value FROM s60 JOIN members USING (node) JOIN sizes USING (comm) WHERE reserve <> 0 OR residue <> 0 GROUP BY 1, 2""",
        "backward_index": f"WITH {PS_ARCS}, {NORM}, {MEMBERS}, {DNPR}, {SIZE}, {backward('members')} SELECT source, target, round(dppr, 9) AS dppr FROM bw",
        "source_backward_index": f"WITH {PS_ARCS}, {NORM}, {MEMBERS}, {DNPR}, {SIZE}, {backward('members')} SELECT source, target, round(dppr, 9) AS dppr FROM bw WHERE target IN (SELECT node FROM members WHERE comm = 1000)",
        "ppr_truncated_join": f"WITH {sources}, {units}, {power(15)} SELECT {value} FROM pi",
        "push_forward_join": out["push_forward_rounds"],
        "push_backward_join": out["push_backward_rounds"],
        "components_rounds": f"WITH {leaves} SELECT node, comp FROM chain_comp WHERE size > 1",
        "walk_index_counts": f"WITH {PS_ARCS}, {NORM}, {SIZE}, lim AS (SELECT *, mean * delta AS md, 2 + 2 * ({e}) / 3 AS c, ln(n) AS fail FROM small), t AS (SELECT ({e}) * sqrt(md * mean / (c * 2 * m * fail)) AS rmax, c * fail / (md * ({e}) * ({e})) AS omega FROM lim) SELECT node AS source, ceil(d * rmax * omega)::BIGINT AS walks FROM wdeg CROSS JOIN t",
        "walk_methods_bound": within("fora", "foraplus", "foratp", "foraresacc"),
        "walk_methods_bound_join": within("fora"),
        "fora_indexed_bound": within("fora"),
        "source_edge_list": out["edges_canonical"],
        "source_weighted_edge_list": f"WITH {TRADE} SELECT src, dst, weight FROM trade",
        "source_binary_graph": f"WITH {PS_ARCS}, {ps_dense} SELECT a.new AS src, b.new AS dst, w FROM arcs JOIN ids a ON src = a.node JOIN ids b ON dst = b.node",
        "source_positions": f"WITH {SUPPLIER_POINTS} SELECT row_number() OVER (ORDER BY node) - 1 AS node, round(x, 9) AS x, round(y, 9) AS y, round(x / 2, 9) AS r FROM points",
        "source_layout": f"WITH {SUPPLIER_POINTS} SELECT node, round(x, 9) AS x, round(y, 9) AS y FROM points",
        "source_partition": f"WITH {MEMBERS}, c AS (SELECT comm, row_number() OVER (ORDER BY comm) - 1 AS new FROM (SELECT DISTINCT comm FROM members)) SELECT node, new AS comm FROM members JOIN c USING (comm)",
        "source_membership": "SELECT 0 AS component, 1 AS level, s_nationkey::BIGINT AS id, s_suppkey AS leaf FROM supplier",
        "source_hierarchy": "SELECT 0 AS component, 2 AS level, n_regionkey::BIGINT AS id, n_nationkey::BIGINT AS child_id FROM nation",
        "source_dnpr": out["dnpr_closed"],
        "sidecar_counts": f"WITH {PS} SELECT 'n' AS name, (SELECT count(*) FROM (SELECT src FROM ps UNION SELECT dst FROM ps)) AS stated UNION ALL SELECT 'm', count(*) FROM ps",
        "neighbors": f"WITH {PARTNER_ARCS} SELECT dst, w FROM arcs WHERE src = 0",
        "supernode_names": "SELECT 'c0_l1_' || n_nationkey AS name, 0 AS component, 1 AS level, n_nationkey::BIGINT AS id FROM nation",
    }
    return out
