"""Registered queries: networks. Nodes are suppliers and brands."""

from pyspark.sql import functions as F

from essenta.operators import graph as G
from essenta.plans.catalog import R, query, r, with_

ROUNDS = 60
BOTH = """
e1 AS (SELECT src, dst, weight FROM edge UNION ALL SELECT dst, src, weight FROM edge),
node AS (SELECT DISTINCT src AS node FROM e1)"""
# the sparse graph, in which paths have several hops
TIES = """
e1 AS (SELECT src, dst FROM ties UNION ALL SELECT dst, src FROM ties),
node AS (SELECT DISTINCT src AS node FROM e1)"""


def _walk_sql():
    steps = ["w0 AS MATERIALIZED (SELECT seed_set, node, p FROM home)"]
    for i in range(ROUNDS):
        steps.append(f"""w{i + 1} AS MATERIALIZED (SELECT seed_set, node, sum(p) AS p FROM (SELECT w.seed_set, t.dst AS node, 0.6 * w.p * t.t AS p
  FROM w{i} w JOIN t ON t.src = w.node UNION ALL SELECT seed_set, node, 0.4 * p FROM home) GROUP BY 1, 2)""")
    return with_("edge", BOTH, """
t AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS t FROM e1)""", """
home AS (SELECT seed_set, node, 1.0 / count(*) OVER (PARTITION BY seed_set) AS p FROM
  (SELECT r_name AS seed_set, 's' || s_suppkey AS node FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) JOIN node USING (node))""", *steps) + f"""
SELECT s.seed_set, n.node, {R('coalesce(w.p, 0)')} AS probability FROM (SELECT DISTINCT seed_set FROM home) s JOIN node n ON TRUE
LEFT JOIN w{ROUNDS} w ON w.seed_set = s.seed_set AND w.node = n.node"""


def hubs(t):
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("r_name").alias("seed_set"), F.concat(F.lit("s"), "s_suppkey").alias("node"))


@query("n1_walk", _walk_sql())
def _(t):
    return G.random_walk(t.edges(), hubs(t)).select("seed_set", "node", r("probability").alias("probability"))


@query("n2_steiner")
def _(t):
    names = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return G.steiner_subgraph(t.ties(), names, n_iter=50)


@query("n3_sample_nodes", with_("ties", TIES, """
present AS (SELECT node FROM node WHERE node LIKE 'n%')""") + """
SELECT grp, node FROM (SELECT CAST(grp AS INTEGER) AS grp, node, row_number() OVER (PARTITION BY grp ORDER BY md5(node || '|' || grp || '|42'), node) AS pos
  FROM present, (SELECT unnest(range(5)) AS grp)) WHERE pos <= floor((SELECT count(*) FROM present) * 0.7)""")
def _(t):
    return G.sample_nodes(t.ties(), t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node")), 5)


LEVELS = 12


def _paths_sql(tail, sources="node IN ('n1', 'n2')"):
    steps = [f"l0 AS (SELECT node AS source, node, 0 AS distance, 1.0::DOUBLE AS n_paths, node AS path FROM node WHERE {sources})",
             "s0 AS (SELECT * FROM l0)"]
    for i in range(LEVELS):
        steps.append(f"""l{i + 1} AS MATERIALIZED (SELECT source, e.dst AS node, {i + 1} AS distance, sum(n_paths) AS n_paths, min(path || ':' || e.dst) AS path
  FROM l{i} JOIN e1 e ON e.src = node WHERE NOT EXISTS (SELECT 1 FROM s{i} s WHERE s.source = l{i}.source AND s.node = e.dst) GROUP BY 1, 2)""")
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT * FROM s{i} UNION ALL SELECT * FROM l{i + 1})")
    return with_("ties", TIES, *steps) + tail.format(s=f"s{LEVELS}")


def _paths(t):
    source = t.nation.where("n_nationkey IN (1, 2)").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return G.hop_paths(t.ties(), source)


@query("n4_shortest_paths", _paths_sql("SELECT source, node, distance, n_paths, path FROM {s}"))
def _(t):
    return _paths(t)


@query("n5_nodes_per_distance", _paths_sql("SELECT source, distance, count(*) AS n FROM {s} GROUP BY 1, 2"))
def _(t):
    return G.nodes_per_distance(_paths(t))


@query("n5_within_distance", _paths_sql("SELECT source, node, distance FROM {s} WHERE distance <= 3"))
def _(t):
    return G.within_distance(_paths(t))


@query("n6_degree", with_("ties", TIES) + "SELECT src AS node, count(*) AS degree FROM e1 GROUP BY 1")
def _(t):
    return G.degree(t.ties())


@query("n6_neighbours", with_("ties", TIES) + "SELECT src AS node, dst AS neighbour FROM e1 WHERE src IN (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(t):
    return G.neighbours(t.ties(), t.customer.where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), "c_custkey").alias("node")))


@query("n7_subset_betweenness", _paths_sql(f"""
SELECT node, {R('betweenness')} AS betweenness FROM (SELECT node, coalesce(v, 0) / ((count(*) OVER () - 1.0) * (count(*) OVER () - 2.0)) AS betweenness FROM node
LEFT JOIN (SELECT a.node, sum(a.n_paths * b.n_paths / d.n_paths) AS v FROM {{s}} a JOIN {{s}} b ON a.node = b.node
  JOIN {{s}} d ON d.source = a.source AND d.node = b.source WHERE a.source LIKE 'n%' AND b.source LIKE 'r%' AND d.distance = a.distance + b.distance
  AND a.node <> a.source AND b.node <> b.source GROUP BY 1) USING (node))""", "node SIMILAR TO '[nr][0-9]+'"))
def _(t):
    sources = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    targets = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return G.subset_betweenness(t.ties(), sources, targets, None).select("node", r("betweenness").alias("betweenness"))


@query("n8_confident_edges", with_("edge") + """
SELECT src, dst, score FROM (SELECT src, dst, weight * 25 AS score, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM edge WHERE weight * 25 >= 700) WHERE k <= 10""")
def _(t):
    return G.confident_edges(t.edges().select("src", "dst", (F.col("weight") * 25).alias("score")))


@query("n9_map_names", """
SELECT p_name AS name, id FROM (SELECT DISTINCT p_name FROM part) LEFT JOIN (SELECT p_name AS alias, arg_max(p_brand, p_partkey) AS id FROM part WHERE p_size > 20 GROUP BY 1) ON alias = p_name""")
def _(t):
    aliases = t.part.where("p_size > 20").select(F.col("p_name").alias("alias"), F.col("p_brand").alias("id"), F.col("p_partkey").alias("place"))
    return G.map_names(t.part.select(F.col("p_name").alias("name")).distinct(), aliases)


@query("n10_top_nodes", """
WITH w AS (SELECT o_orderpriority AS seed_set, CAST(o_custkey AS VARCHAR) AS node, max(o_totalprice) AS p FROM orders GROUP BY 1, 2)
SELECT seed_set, node AS gene FROM (SELECT *, row_number() OVER (PARTITION BY seed_set ORDER BY p DESC, node) AS k FROM w) WHERE k <= 20
UNION SELECT '1-URGENT', p_brand FROM part""")
def _(t):
    walk = t.ic50().select(F.col("drug").alias("seed_set"), F.col("sample").alias("node"), F.col("value").alias("probability"))
    pathway = t.part.select(F.lit("1-URGENT").alias("seed_set"), F.col("p_brand").alias("gene")).distinct()
    return G.top_nodes(walk, pathway)
