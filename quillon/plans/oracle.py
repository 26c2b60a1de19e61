"""SQL that gives the rows of plans.queries, for those that SQL can express."""

from __future__ import annotations

_LINES = "lines AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"
_CO = f"{_LINES}, co AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lines a JOIN lines b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2)"
_ARCS = f"{_CO}, arcs AS (SELECT src, dst, weight FROM co UNION ALL SELECT dst, src, weight FROM co), nodes AS (SELECT DISTINCT src AS part FROM arcs), deg AS (SELECT src AS part, count(*) AS d, sum(weight) AS s FROM arcs GROUP BY 1)"
_TRADE = """trade AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
  nation_nodes AS (SELECT CAST(range AS BIGINT) AS node FROM range(25)), outs AS (SELECT src, sum(weight) AS w FROM trade GROUP BY 1)"""
_TRI = f"""{_ARCS}, tri AS (SELECT a.src AS u, a.dst AS v, b.dst AS w FROM co a JOIN co b ON a.dst = b.src JOIN co c ON c.src = a.src AND c.dst = b.dst),
  per AS (SELECT part, count(*) AS t FROM (SELECT u AS part FROM tri UNION ALL SELECT v FROM tri UNION ALL SELECT w FROM tri) GROUP BY 1),
  cl AS (SELECT d.part, coalesce(t, 0) AS t, d, CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS c FROM deg d LEFT JOIN per p ON p.part = d.part)"""
_HOPS = f"""{_ARCS}, hop AS (SELECT (SELECT min(part) FROM nodes) AS part, 0 AS d UNION SELECT a.dst, h.d + 1 FROM hop h JOIN arcs a ON a.src = h.part WHERE h.d < 40)"""


def _describe(table: str, column: str, by: str | None = None) -> str:
    g, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    group = f"GROUP BY {by}" if by else ""
    return f"""
WITH m AS (SELECT {g}avg({column}) AS mu FROM {table} WHERE {column} IS NOT NULL {group}),
s AS (SELECT {g}count(*) AS n, sum({column}) AS total, min({column}) AS low, max({column}) AS high, any_value(mu) AS mu,
        sum(pow({column} - mu, 2)) AS s2, sum(pow({column} - mu, 3)) AS s3, sum(pow({column} - mu, 4)) AS s4,
        quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS q2, quantile_cont({column}, 0.75) AS q3
      FROM {table} JOIN m {on} WHERE {column} IS NOT NULL {group})
"""


def _quality(modulus: int = 7) -> str:
    return f"""{_ARCS}, own AS (SELECT part, part % {modulus} AS c, d, s FROM deg),
  tot AS (SELECT (SELECT sum(weight) FROM co) AS m, (SELECT count(*) FROM co) AS e, (SELECT count(*) FROM nodes) AS n),
  ins AS (SELECT a.c, sum(weight) AS w, count(*) AS e FROM co JOIN own a ON co.src = a.part JOIN own b ON co.dst = b.part WHERE a.c = b.c GROUP BY 1),
  com AS (SELECT o.c, count(*) AS size, sum(s) AS k, coalesce(max(ins.w), 0) AS w, coalesce(max(ins.e), 0) AS e FROM own o LEFT JOIN ins ON ins.c = o.c GROUP BY 1)"""


def _kl(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 AND {b} < 1 THEN (CASE WHEN {a} > 0 THEN {a} * ln({a} / {b}) ELSE 0 END) + (CASE WHEN {a} < 1 THEN (1 - {a}) * ln((1 - {a}) / (1 - {b})) ELSE 0 END) ELSE 0 END)"


def _pearson(a: str, b: str, source: str) -> str:
    return f"(SELECT sum((x - mx) * (y - my)) / sqrt(sum(pow(x - mx, 2)) * sum(pow(y - my, 2))) FROM (SELECT {a} AS x, {b} AS y, avg({a}) OVER () AS mx, avg({b}) OVER () AS my FROM {source}))"


def _mid(column: str, over: str = "") -> str:
    return f"(rank() OVER ({over} ORDER BY {column}) + (count(*) OVER (PARTITION BY {(over.replace('PARTITION BY', '') + ', ') if over else ''}{column}) - 1) / 2.0)"


_POOL = "pool AS (SELECT c_mktsegment AS g, c_acctbal AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal IS NOT NULL)"
_FAMILY = """f AS (SELECT nation, pow(row_number() OVER (ORDER BY m, nation) / (count(*) OVER () + 1), 2.0) * 0.2 AS p FROM (SELECT CAST(c_nationkey AS BIGINT) AS nation, avg(c_acctbal) AS m FROM customer GROUP BY 1)),
  r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM f)"""
_NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _walk(start: str, rounds: int) -> str:
    """PageRank in a fixed number of rounds over trade, every nation with its restart weight t."""
    return f"""WITH RECURSIVE {_TRADE}, base AS (SELECT node, {start} AS t, coalesce(w, 0) AS w FROM nation_nodes LEFT JOIN outs ON src = node),
  pr AS (SELECT 0 AS i, node, CAST(t AS DOUBLE) AS x FROM base UNION ALL
    SELECT i + 1, b.node, 0.85 * (coalesce(s.y, 0) + z.loose * b.t) + 0.15 * b.t
    FROM base b JOIN (SELECT i, sum(CASE WHEN w = 0 THEN x ELSE 0 END) AS loose FROM pr JOIN base USING (node) GROUP BY i) z ON true
    LEFT JOIN (SELECT dst, sum(x * weight / outs.w) AS y FROM pr JOIN trade ON trade.src = pr.node JOIN outs ON outs.src = trade.src GROUP BY dst) s ON s.dst = b.node
    WHERE z.i < {rounds})
SELECT node, round(x, 9) AS score FROM pr WHERE i = {rounds}"""


_VISITS = """ends AS (SELECT DISTINCT 'u' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS u, 'e' || event_type AS e FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
  ways AS (SELECT u AS a, e AS b FROM ends UNION ALL SELECT e, u FROM ends), who AS (SELECT DISTINCT a AS name FROM ways),
  far AS (SELECT name AS s, name AS t, 0 AS d FROM who UNION SELECT far.s, ways.b, far.d + 1 FROM far JOIN ways ON ways.a = far.t WHERE far.d < 6),
  dist AS (SELECT s, t, min(d) AS d FROM far GROUP BY 1, 2)"""


def _powers(step: str, start: str, rounds: int, ctes: str = "") -> str:
    """A linear iteration over trade in a fixed number of rounds: step gives the new value from p (node, x) and b.x."""
    return f"""WITH RECURSIVE {_TRADE}, big AS (SELECT max(w) AS c FROM outs){ctes},
  it AS (SELECT 0 AS i, node, CAST({start} AS DOUBLE) AS x FROM nation_nodes UNION ALL {step.format(rounds=rounds)})"""


_ONE_STEP = """SELECT b.i + 1, b.node, {value} FROM it b CROSS JOIN big LEFT JOIN (SELECT dst, sum(x * weight) AS y FROM it JOIN trade ON trade.src = it.node GROUP BY dst) s ON s.dst = b.node WHERE b.i < {{rounds}}"""


ORACLE: dict[str, str] = {
    "distance_summary": f"WITH RECURSIVE {_VISITS}, ecc AS (SELECT s, max(d) AS e FROM dist GROUP BY 1) SELECT CAST((SELECT sum(d) FROM dist) AS BIGINT) AS total, (SELECT count(*) FROM dist WHERE d > 0) AS pairs, (SELECT count(DISTINCT low) FROM (SELECT min(t) AS low FROM dist GROUP BY s)) AS components, CAST((SELECT max(e) FROM ecc) AS DOUBLE) AS diameter, CAST((SELECT min(e) FROM ecc) AS DOUBLE) AS radius",
    "closeness": f"WITH RECURSIVE {_VISITS}, r AS (SELECT s, count(*) FILTER (d > 0) AS r, sum(d) AS t FROM dist GROUP BY 1) SELECT s AS name, round(CASE WHEN t > 0 THEN r / t * (r / ((SELECT count(*) FROM who) - 1.0::DOUBLE)) ELSE 0.0 END, 8) AS score FROM r",
    "harmonic": f"WITH RECURSIVE {_VISITS} SELECT s AS name, round(coalesce(sum(1.0::DOUBLE / d) FILTER (d > 0), 0.0), 6) AS score FROM dist GROUP BY 1",
    "eigenvector": _powers(_ONE_STEP.format(value="(coalesce(s.y, 0) + big.c * b.x) / (2 * big.c)"), "1", 200) + " SELECT node, round(x / sqrt(sum(x * x) OVER ()), 8) AS score FROM it WHERE i = 200",
    "katz": _powers(_ONE_STEP.format(value="0.5 / big.c * coalesce(s.y, 0) + 1"), "1", 60) + " SELECT node, round(x / sqrt(sum(x * x) OVER ()), 8) AS score FROM it WHERE i = 60",
    "hits": _powers("SELECT b.i + 1, b.node, coalesce(s.y, 0) / (big.c * big.c) FROM it b CROSS JOIN big LEFT JOIN (SELECT k.src, sum(it.x * k.weight) AS y FROM it JOIN gram k ON k.via = it.node GROUP BY k.src) s ON s.src = b.node WHERE b.i < {rounds}", "1", 60, ", gram AS (SELECT a.src, c.src AS via, sum(a.weight * c.weight) AS weight FROM trade a JOIN trade c ON a.dst = c.dst GROUP BY 1, 2)")
    + ", hub AS (SELECT node, x / sum(x) OVER () AS h FROM it WHERE i = 60), auth AS (SELECT n.node, coalesce(sum(h * weight), 0.0) AS a FROM nation_nodes n LEFT JOIN trade ON dst = n.node LEFT JOIN hub ON hub.node = src GROUP BY 1) SELECT hub.node, round(h, 8) AS hub, round(a / sum(a) OVER (), 8) AS authority FROM hub JOIN auth ON hub.node = auth.node",
    "graph_edges": f"WITH {_CO} SELECT src, dst, weight FROM co",
    "degree_strength": f"WITH {_ARCS} SELECT part, d AS degree, s AS strength FROM deg",
    "directed_edges": f"WITH {_TRADE} SELECT src, dst, weight FROM trade",
    "directed_degrees": f"WITH {_TRADE} SELECT node, count(weight) AS degree, coalesce(sum(weight), 0.0) AS strength FROM nation_nodes LEFT JOIN trade ON src = node GROUP BY 1",
    "self_loops": f"WITH {_TRADE} SELECT src AS node, weight FROM trade WHERE src = dst",
    "graph_totals": f"WITH {_ARCS}, {_TRADE} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM co) AS n_edges, (SELECT sum(weight) FROM co) AS total, (SELECT 2 * sum(weight) FROM co) AS endpoints, (SELECT count(*) FROM trade) AS arcs, (SELECT sum(weight) FROM trade) AS flow",
    "neighbours": f"WITH {_ARCS} SELECT dst AS part, weight FROM arcs WHERE src = (SELECT min(part) FROM nodes)",
    "node_index": "SELECT event_type AS name, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS id FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "matrix_graph": f"WITH {_TRADE} SELECT src, dst, weight FROM trade WHERE dst >= src",
    "components": f"WITH RECURSIVE {_ARCS}, reach AS (SELECT part, part AS r FROM nodes UNION SELECT reach.part, arcs.dst FROM reach JOIN arcs ON arcs.src = reach.r) SELECT part, min(r) AS component FROM reach GROUP BY 1",
    "bfs_hops": f"WITH RECURSIVE {_HOPS} SELECT n.part, CAST(coalesce(min(d), -1) AS BIGINT) AS distance FROM nodes n LEFT JOIN hop h ON h.part = n.part GROUP BY 1",
    "weighted_distance": f"""WITH RECURSIVE {_TRADE}, way AS (SELECT 0 AS i, CAST(0 AS BIGINT) AS node, 0.0::DOUBLE AS d UNION ALL
      SELECT i + 1, node, min(d) FROM (SELECT i, node, d FROM way UNION ALL SELECT i, dst, d + weight FROM way JOIN trade ON src = node) WHERE i < 25 GROUP BY 1, 2)
      SELECT n.node, coalesce(min(d), -1) AS distance FROM nation_nodes n LEFT JOIN way w ON w.node = n.node GROUP BY 1""",
    "strong_components": f"""WITH RECURSIVE {_TRADE}, strong AS (SELECT src, dst FROM trade WHERE weight >= (SELECT avg(weight) FROM trade)),
      reach AS (SELECT node AS a, node AS b FROM nation_nodes UNION SELECT a, dst FROM reach JOIN strong ON src = b)
      SELECT x.a AS node, min(x.b) AS label FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1""",
    "triangles": f"WITH {_TRI} SELECT part, CAST(t AS BIGINT) AS triangles FROM cl",
    "clustering": f"WITH {_TRI} SELECT part, round(c, 8) AS coefficient FROM cl",
    "transitivity": f"WITH {_TRI} SELECT CAST(sum(t) / 3 AS BIGINT) AS triangles, round(avg(c), 8) AS average, round(CASE WHEN sum(d * (d - 1) // 2) > 0 THEN sum(t) / sum(d * (d - 1) // 2) ELSE 0.0 END, 8) AS transitivity FROM cl",
    "assortativity": f"WITH {_ARCS}, ends AS (SELECT a.d AS x, b.d AS y FROM arcs JOIN deg a ON arcs.src = a.part JOIN deg b ON arcs.dst = b.part) SELECT round({_pearson('x', 'y', 'ends')}, 8) AS r",
    "link_scores": f"""WITH {_ARCS}, pairs AS (SELECT src AS a, dst AS b FROM co),
      sh AS (SELECT a, b, count(*) AS cn, sum(CASE WHEN ln(z.d) > 0 THEN 1 / ln(z.d) END) AS aa, sum(1.0 / z.d) AS ra FROM pairs JOIN arcs x ON x.src = a JOIN arcs y ON y.src = b AND y.dst = x.dst JOIN deg z ON z.part = x.dst GROUP BY 1, 2)
      SELECT p.a AS part_a, p.b AS part_b, CAST(coalesce(cn, 0) AS BIGINT) AS common_neighbours, round(CASE WHEN da.d + db.d - coalesce(cn, 0) > 0 THEN coalesce(cn, 0) / (da.d + db.d - coalesce(cn, 0)) ELSE 0.0 END, 8) AS jaccard,
        round(coalesce(aa, 0.0), 8) AS adamic_adar, round(CAST(coalesce(ra, 0.0) AS DOUBLE), 8) AS resource_allocation, da.d * db.d AS preferential_attachment
      FROM pairs p JOIN deg da ON da.part = p.a JOIN deg db ON db.part = p.b LEFT JOIN sh ON sh.a = p.a AND sh.b = p.b""",
    "link_rank": f"""WITH {_ARCS}, me AS (SELECT min(part) AS part FROM nodes), near AS (SELECT dst FROM arcs WHERE src = (SELECT part FROM me))
      SELECT y.dst AS part, round(sum(1.0::DOUBLE / z.d), 8) AS score FROM near JOIN arcs y ON y.src = near.dst JOIN deg z ON z.part = near.dst
      WHERE y.dst <> (SELECT part FROM me) AND y.dst NOT IN (SELECT dst FROM near) GROUP BY 1 ORDER BY sum(1.0::DOUBLE / z.d) DESC, 1 LIMIT 20""",
    "modularity": f"WITH {_quality()} SELECT round(sum(w / m - pow(k / (2 * m), 2)), 8) AS q, round(sum(w / m - 0.5 * pow(k / (2 * m), 2)), 8) AS q2 FROM com, tot",
    "potts": f"WITH {_quality()} SELECT round(sum(w - 0.1::DOUBLE * size * (size - 1) / 2), 6) AS cpm, round(sum(w - m / (n * (n - 1) / 2) * size * (size - 1) / 2), 6) AS rber, round(any_value(m / (n * (n - 1) / 2)), 8) AS density FROM com, tot",
    "surprise_significance": f"""WITH {_quality()}, z AS (SELECT c, w, e.e, size * (size - 1) / 2.0::DOUBLE AS pairs, tot.e AS m, n * (n - 1) / 2.0::DOUBLE AS whole FROM com e, tot),
      g AS (SELECT sum(e) / any_value(m) AS a, sum(pairs) / any_value(whole) AS b, any_value(m) AS m FROM z)
      SELECT round((SELECT m * {_kl('a', 'b')} FROM g), 6) AS surprise, round(sum(CASE WHEN pairs > 0 THEN pairs * {_kl('(e / nullif(pairs, 0))', '(m / whole)')} ELSE 0 END), 6) AS significance FROM z""",
    "pagerank_parts": f"""WITH RECURSIVE {_ARCS}, share AS (SELECT a.src, a.dst, a.weight / d.s AS w FROM arcs a JOIN deg d ON d.part = a.src), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes),
      pr AS (SELECT 0 AS i, part, 1 / n AS x FROM nodes, n UNION ALL SELECT s.i + 1, s.dst, 0.85 * s.y + 0.15 / n FROM (SELECT i, dst, sum(x * w) AS y FROM pr JOIN share ON src = part WHERE i < 140 GROUP BY i, dst) s, n)
      SELECT part, round(x, 8) AS score FROM pr WHERE i = 140""",
    "pagerank": _walk("1.0 / 25", 160),
    "personalised_pagerank": _walk("CASE node WHEN 0 THEN 0.25 WHEN 1 THEN 0.75 ELSE 0 END", 160),
    "partition_agreement": """WITH t AS (SELECT o_orderstatus AS x, o_orderpriority AS y, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2),
      a AS (SELECT x, sum(n) AS n FROM t GROUP BY 1), b AS (SELECT y, sum(n) AS n FROM t GROUP BY 1), s AS (SELECT sum(n) AS n FROM t),
      q AS (SELECT s.n, (SELECT sum(n * (n - 1) / 2) FROM t) AS pt, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb,
        (SELECT -sum(t.n / s.n * ln(t.n / s.n)) FROM t) AS ht, (SELECT -sum(a.n / s.n * ln(a.n / s.n)) FROM a) AS ha, (SELECT -sum(b.n / s.n * ln(b.n / s.n)) FROM b) AS hb FROM s)
      SELECT round(greatest(0, ha + hb - ht) / ((ha + hb) / 2), 8) AS nmi, round((pt - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 8) AS ari, round(ha + hb - 2 * greatest(0, ha + hb - ht), 8) AS vi FROM q""",
    "partition_canonical": "WITH f AS (SELECT c_mktsegment AS s, CAST(row_number() OVER (ORDER BY min(c_custkey)) - 1 AS INTEGER) AS community FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1) SELECT c_custkey AS node, community FROM customer JOIN f ON c_mktsegment = s",
    "partition_filter": """WITH f AS (SELECT c_nationkey AS s, min(c_custkey) AS first, count(*) AS n FROM customer GROUP BY 1), k AS (SELECT s, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS community FROM f WHERE n >= 50)
      SELECT c_custkey AS node, coalesce(community, -1) AS community FROM customer LEFT JOIN k ON c_nationkey = s""",
    "describe_prices": _describe("lineitem", "l_extendedprice", "l_returnflag")
    + "SELECT l_returnflag, n, round(total, 2) AS sum, round(mu, 6) AS mean, low AS min, high AS max, round(s2 / (n - 1), 2) AS variance, round(sqrt(s2 / (n - 1)), 5) AS std_dev, round(sqrt(s2 / (n - 1)) / sqrt(n), 6) AS standard_error, round(s3 / n / pow(s2 / n, 1.5), 6) AS skewness, round(s4 / n / pow(s2 / n, 2) - 3, 6) AS kurtosis, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3 FROM s",
    "descriptive": _describe("orders", "o_totalprice")
    + "SELECT n, round(total, 2) AS sum, round(mu, 5) AS mean, round(s2 / (n - 1), 1) AS variance, round(s3 / n / pow(s2 / n, 1.5), 7) AS skewness, round(s4 / n / pow(s2 / n, 2) - 3, 7) AS kurtosis, round(sqrt(s2 / (n - 1)) / mu, 8) AS cv, round(high - low, 4) AS range, round(q3 - q1, 4) AS iqr FROM s",
    "autocorrelation": "WITH x AS (SELECT event_id, value - avg(value) OVER () AS v FROM events WHERE value IS NOT NULL), l AS (SELECT v, lead(v, 1) OVER w AS a, lead(v, 3) OVER w AS b FROM x WINDOW w AS (ORDER BY event_id)) SELECT round(sum(v * a) / sum(v * v), 9) AS lag1, round(sum(v * b) / sum(v * v), 9) AS lag3 FROM l",
    "midranks": f"SELECT o_orderkey, CAST({_mid('o_totalprice')} AS DOUBLE) AS midrank FROM orders WHERE o_totalprice IS NOT NULL",
    "tie_sizes": "SELECT CAST(l_quantity AS DOUBLE) AS value, count(*) AS ties FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1",
    "tied_pairs": "SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM (SELECT count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_quantity)",
    "pearson": f"SELECT round({_pearson('l_quantity', 'l_extendedprice', 'lineitem')}, 9) AS r",
    "spearman": f"WITH k AS (SELECT CAST({_mid('l_quantity')} AS DOUBLE) AS a, CAST({_mid('l_extendedprice')} AS DOUBLE) AS b FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL) SELECT round({_pearson('a', 'b', 'k')}, 9) AS r",
    "kendall": """WITH c AS (SELECT c_custkey AS i, c_nationkey AS x, c_acctbal AS y FROM customer WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL),
      p AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*) AS n, count(*) FILTER (a.x = b.x) AS tx, count(*) FILTER (a.y = b.y) AS ty FROM c a JOIN c b ON a.i < b.i)
      SELECT round(s / sqrt(n - tx) / sqrt(n - ty), 9) AS tau FROM p""",
    "correlation_matrix": "SELECT " + ", ".join(f"round({_pearson(_NAMES[i], _NAMES[j], 'lineitem')}, 8) AS r{i}{j}" for i in range(4) for j in range(i)),
    "anova": """WITH x AS (SELECT l_returnflag AS g, l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem) AS v FROM lineitem), m AS (SELECT g, avg(v) AS m, count(*) AS n FROM x GROUP BY 1),
      s AS (SELECT (SELECT sum(n * m * m) FROM m) AS b, (SELECT sum(pow(v - m, 2)) FROM x JOIN m USING (g)) AS w, (SELECT count(*) FROM m) AS k, (SELECT count(*) FROM x) AS n)
      SELECT round(b / (k - 1) / (w / (n - k)), 8) AS f, k - 1 AS between_df, n - k AS within_df, round(b / (b + w), 10) AS r_squared, round(pow(1 + 2 * (b / (k - 1) / (w / (n - k))) / (n - k), -(n - k) / 2.0), 8) AS p FROM s""",
    "kruskal_wallis": f"""WITH r AS (SELECT l_returnflag AS g, l_extendedprice AS v, CAST({_mid('l_extendedprice')} AS DOUBLE) AS r FROM lineitem), s AS (SELECT g, count(*) AS n, avg(r) AS m FROM r GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM r),
      t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY v)), h AS (SELECT 12 / (n.n * (n.n + 1)) * sum(s.n * pow(m - (n.n + 1) / 2, 2)) / (1 - any_value(t.t) / (pow(n.n, 3) - n.n)) AS h, count(*) - 1 AS df FROM s, n, t GROUP BY n.n)
      SELECT round(h, 6) AS h, df, round(exp(-h / 2), 7) AS p FROM h""",
    "chi_squared": """WITH t AS (SELECT l_returnflag AS r, l_linestatus AS c, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), rs AS (SELECT r, sum(n) AS n FROM t GROUP BY 1), cs AS (SELECT c, sum(n) AS n FROM t GROUP BY 1),
      x AS (SELECT sum(pow(coalesce(t.n, 0) - rs.n * cs.n / s.n, 2) / (rs.n * cs.n / s.n)) AS x FROM rs CROSS JOIN cs CROSS JOIN (SELECT sum(n) AS n FROM t) s LEFT JOIN t ON t.r = rs.r AND t.c = cs.c)
      SELECT round(x, 6) AS statistic, CAST(((SELECT count(*) FROM rs) - 1) * ((SELECT count(*) FROM cs) - 1) AS BIGINT) AS df, round(exp(-x / 2), 8) AS p FROM x""",
    "t_tests": f"""WITH {_POOL}, s AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM pool GROUP BY 1), q AS (SELECT a.n AS n1, a.m AS m1, a.s AS s1, b.n AS n2, b.m AS m2, b.s AS s2 FROM s a JOIN s b ON a.g = 'BUILDING' AND b.g = 'MACHINERY')
      SELECT round((m1 - m2) / sqrt(s1 / n1 + s2 / n2), 8) AS welch, round(pow(s1 / n1 + s2 / n2, 2) / (pow(s1 / n1, 2) / (n1 - 1) + pow(s2 / n2, 2) / (n2 - 1)), 6) AS welch_df,
        round((m1 - m2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 8) AS student, n1 + n2 - 2 AS student_df FROM q""",
    "mann_whitney": f"""WITH {_POOL}, r AS (SELECT g, v, CAST({_mid('v')} AS DOUBLE) AS r FROM pool), t AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM pool GROUP BY v)),
      s AS (SELECT CAST(count(*) FILTER (g = 'BUILDING') AS DOUBLE) AS n1, CAST(count(*) FILTER (g = 'MACHINERY') AS DOUBLE) AS n2, sum(r) FILTER (g = 'BUILDING') AS rs FROM r), u AS (SELECT *, rs - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s)
      SELECT u, round((abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - t / (n * (n - 1)))), 8) AS z FROM u, t""",
    "multiple_testing": f"""WITH {_FAMILY}, a AS (SELECT nation, p, least(1.0, p * n) AS bon, least(1.0, max((n - i + 1) * p) OVER (ORDER BY i)) AS holm, least(1.0, min(p / (i / n)) OVER (ORDER BY i DESC)) AS bh FROM r)
      SELECT nation, round(bon, 9) AS bonferroni, round(holm, 9) AS holm, round(bh, 9) AS benjamini_hochberg, bh <= 0.05 AS rejected FROM a""",
    "ols_simple": """WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem), s AS (SELECT sum(pow(l_quantity - mx, 2)) AS sxx, sum((l_quantity - mx) * (l_extendedprice - my)) AS sxy, sum(pow(l_extendedprice - my, 2)) AS syy, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my FROM lineitem, m)
      SELECT round(my - sxy / sxx * mx, 4) AS intercept, round(sxy / sxx, 5) AS slope, round(sxy * sxy / (sxx * syy), 9) AS r_squared, n FROM s""",
    "distributions": """SELECT CAST(n_nationkey AS BIGINT) AS k, round(exp(-n_nationkey / 5.0::DOUBLE / 2), 9) AS chi2, round(pow(1 + 2 * (n_nationkey / 5.0::DOUBLE) / 10, -5.0), 9) AS f, round(0.5 + atan(n_nationkey / 5.0::DOUBLE) / pi(), 9) AS t,
      round(2 * ln(n_nationkey + 2.0::DOUBLE), 8) AS q, round(lgamma(n_nationkey + 1.0::DOUBLE), 8) AS lg FROM nation""",
    "similarities": """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0 LIMIT 1)
      SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 8) AS cosine, round(list_dot_product(embedding::DOUBLE[], q), 6) AS dot, round(list_distance(embedding::DOUBLE[], q), 6) AS euclidean FROM embeddings, q""",
    "set_jaccard": """WITH b AS (SELECT item_id, list_distinct(string_split(text, ' ')) AS w FROM benchmark), p AS (SELECT a.item_id, len(list_intersect(a.w, c.w)) AS i, len(a.w) AS x, len(c.w) AS y FROM b a JOIN b c ON c.item_id = a.item_id + 1)
      SELECT item_id, round(CASE WHEN x + y - i = 0 THEN 1.0 ELSE i / (x + y - i) END, 9) AS jaccard FROM p""",
    "knn_cosine": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query, c.vec_id AS key, list_cosine_similarity(q.v, c.v) AS s FROM e q JOIN e c ON q.vec_id % 20 = 0)
      SELECT query, key, round(s, 7) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, key) AS rank FROM s) WHERE rank <= 5""",
    "rrf": "WITH r AS (SELECT p_partkey AS key, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS a, row_number() OVER (ORDER BY p_partkey) AS b FROM part) SELECT key, round(1.0::DOUBLE / (60 + greatest(a, b)) + 1.0::DOUBLE / (60 + least(a, b)), 12) AS score FROM r",
}
