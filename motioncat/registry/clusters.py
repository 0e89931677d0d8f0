"""Clusters of embeddings and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from motioncat import fixtures as fx
from motioncat.fixtures import with_ctes
from motioncat.operators import clustering as cl
from motioncat.operators import compare
from motioncat.operators.graph import connected_components
from motioncat.registry import query
from motioncat.registry.common import rounded

NEAR = """near AS (SELECT p.ord AS a, q.ord AS b FROM people p JOIN people q ON p.ord <> q.ord WHERE {cond})"""
COS = "list_cosine_similarity(p.embedding, q.embedding)"
DBSCAN = f"""WITH {NEAR.format(cond=f'1 - least(1, greatest(0, {COS})) <= 0.12')}, core AS (SELECT a AS ord FROM near GROUP BY a HAVING count(*) + 1 >= 3),
  ce AS (SELECT a, b FROM near WHERE a IN (SELECT ord FROM core) AND b IN (SELECT ord FROM core)),
  walk AS (SELECT ord AS root, ord FROM core UNION SELECT w.root, ce.b FROM walk w JOIN ce ON ce.a = w.ord),
  lab AS (SELECT ord, min(root) AS cluster FROM walk GROUP BY ord),
  brd AS (SELECT n.a AS ord, min(l.cluster) AS cluster FROM near n JOIN lab l ON l.ord = n.b WHERE n.a NOT IN (SELECT ord FROM core) GROUP BY n.a)
  SELECT ord, cluster FROM lab UNION ALL SELECT ord, cluster FROM brd"""


@query("cluster_dbscan", with_ctes("people", DBSCAN, recursive=True))
def cluster_dbscan(spark, sf):
    return cl.cluster_dbscan(fx.people(spark, sf), 0.12, 3)


GREEDY = f"""WITH {NEAR.format(cond=f'{COS} >= 0.88')}, walk AS (SELECT ord AS root, ord FROM people UNION SELECT w.root, n.b FROM walk w JOIN near n ON n.a = w.ord),
  comp AS (SELECT ord, min(root) AS comp FROM walk GROUP BY ord),
  it AS (SELECT comp, list([struct_pack(ord := ord, e := embedding)] ORDER BY ord) AS items FROM comp JOIN people USING (ord) GROUP BY comp),
  fold AS (SELECT comp, list_reduce(items, lambda acc, x: CASE WHEN list_max(list_transform(acc, lambda l: list_cosine_similarity(l.e, x[1].e))) >= 0.88 THEN acc ELSE list_concat(acc, x) END) AS leaders FROM it),
  ld AS (SELECT unnest(leaders).ord AS ord FROM fold)
  SELECT ord, ord AS cluster FROM ld UNION ALL SELECT n.a, min(n.b) FROM near n JOIN ld ON ld.ord = n.b WHERE n.a NOT IN (SELECT ord FROM ld) GROUP BY n.a"""


@query("cluster_greedy_leader", with_ctes("people", GREEDY, recursive=True))
def cluster_greedy_leader(spark, sf):
    return cl.cluster_greedy(fx.people(spark, sf), 0.88)


COMPLETE = f"""WITH st AS (SELECT 0 AS r, 'E' AS k, p.ord AS a, q.ord AS b, 1 - least(1, {COS}) AS d FROM people p JOIN people q ON p.ord < q.ord WHERE 1 - least(1, greatest(0, {COS})) < 1 - CAST(0.88 AS DOUBLE)
    UNION ALL SELECT 0, 'L', ord, ord, CAST(0 AS DOUBLE) FROM people
    UNION ALL (WITH e AS (SELECT r, a, b, d FROM st WHERE k = 'E'),
      ends AS (SELECT a AS x, d, a, b FROM e UNION ALL SELECT b, d, a, b FROM e),
      nn AS (SELECT x, arg_min(struct_pack(a := a, b := b), struct_pack(d := d, a := a, b := b)) AS m FROM ends GROUP BY x),
      mut AS (SELECT m.a AS keep, m.b AS gone FROM nn GROUP BY 1, 2 HAVING count(*) = 2),
      mp AS (SELECT gone AS x, keep AS t FROM mut UNION ALL SELECT keep, keep FROM mut),
      ren AS (SELECT e.r, coalesce(ma.t, e.a) AS p, coalesce(mb.t, e.b) AS q, d, (CASE WHEN ma.t IS NULL THEN 1 ELSE 2 END) * (CASE WHEN mb.t IS NULL THEN 1 ELSE 2 END) AS need
        FROM e LEFT JOIN mp ma ON ma.x = e.a LEFT JOIN mp mb ON mb.x = e.b)
      SELECT max(r) + 1, 'E', least(p, q), greatest(p, q), max(d) FROM ren WHERE p <> q GROUP BY least(p, q), greatest(p, q) HAVING count(*) = max(need)
      UNION ALL SELECT l.r + 1, 'L', l.a, coalesce(mp.t, l.b), l.d FROM st l LEFT JOIN mp ON mp.x = l.b WHERE l.k = 'L' AND EXISTS (SELECT 1 FROM e)))
  SELECT a AS ord, b AS cluster FROM st WHERE k = 'L' AND r = (SELECT max(r) FROM st WHERE k = 'L')"""


@query("cluster_complete_link", with_ctes("people", COMPLETE, recursive=True))
def cluster_complete_link(spark, sf):
    """The tests also compare it with one-by-one merging."""
    return cl.cluster_complete_link(fx.people(spark, sf), 0.88)


@query("connected_components", with_ctes("", """WITH e AS (SELECT DISTINCT (l_suppkey * 100 + CAST(l_quantity AS BIGINT)) * 2 AS a, (l_partkey * 100 + CAST(l_quantity AS BIGINT)) * 2 + 1 AS b FROM lineitem),
  s AS (SELECT DISTINCT p.a, q.a AS b FROM e p JOIN e q USING (b)), walk AS (SELECT DISTINCT a AS root, a AS id FROM s UNION SELECT w.root, s.b FROM walk w JOIN s ON s.a = w.id),
  r AS (SELECT id, min(root) AS root FROM walk GROUP BY id), n AS (SELECT id, root FROM r UNION SELECT e.b, r.root FROM e JOIN r ON r.id = e.a)
  SELECT id, min(id) OVER (PARTITION BY root) AS component FROM n""", recursive=True))
def components(spark, sf):
    """Suppliers and parts linked by order lines, in a graph of its own for each quantity."""
    edges = fx.table(spark, sf, "lineitem").selectExpr("(l_suppkey * 100 + CAST(l_quantity AS BIGINT)) * 2 AS a", "(l_partkey * 100 + CAST(l_quantity AS BIGINT)) * 2 + 1 AS b")
    return connected_components(edges)


QUALITY = f"""WITH m AS (SELECT label AS cluster, * FROM people),
  s AS (SELECT p.cluster, avg({COS}) AS avg_similarity, min({COS}) AS min_similarity FROM m p JOIN m q ON p.cluster = q.cluster AND p.ord < q.ord GROUP BY 1),
  g AS (SELECT cluster, count(*) AS cluster_size, avg(embedding_quality) AS aq, avg(confidence) AS ac, count(DISTINCT video_filename) AS videos, min(frame_number) AS first_frame,
    max(frame_number) AS last_frame, arg_min(ord, struct_pack(s := -(embedding_quality * confidence), o := ord)) AS representative FROM m GROUP BY 1),
  cq AS (SELECT CAST(cluster AS BIGINT) AS cluster, cluster_size, avg_similarity, min_similarity, 0.4 * avg_similarity + 0.3 * min_similarity + 0.2 * aq + 0.1 * ac AS quality_score, videos, first_frame, last_frame, representative FROM g JOIN s USING (cluster))"""
SHOWN = "cluster, cluster_size, round(avg_similarity, 6) AS avg_similarity, round(min_similarity, 6) AS min_similarity, round(quality_score, 6) AS quality_score, videos, first_frame, last_frame, representative"


def by_label(spark, sf, key="label"):
    people = fx.people(spark, sf)
    return cl.cluster_quality(people, people.select("ord", F.col(key).cast("bigint").alias("cluster")))


NUMBERS = ("avg_similarity", "min_similarity", "quality_score")
BY_VEC = QUALITY.replace("label AS cluster", "vec_id AS cluster")


@query("cluster_quality", with_ctes("people", f"{QUALITY} SELECT {SHOWN} FROM cq"))
def cluster_quality(spark, sf):
    return rounded(by_label(spark, sf), *NUMBERS)


@query("filter_min_cluster", with_ctes("people", f"{BY_VEC} SELECT {SHOWN} FROM cq WHERE cluster_size >= 3 AND quality_score > 0.3"))
def filter_min_cluster(spark, sf):
    return rounded(cl.filter_clusters(by_label(spark, sf, "vec_id"), 3), *NUMBERS)


@query("cluster_report", with_ctes("people", f"""{BY_VEC} SELECT count(*) AS clusters, CAST(sum(cluster_size) AS BIGINT) AS embeddings, avg(cluster_size) AS avg_size, round(avg(quality_score), 6) AS avg_quality,
  round(avg(avg_similarity) FILTER (WHERE cluster_size > 1), 6) AS avg_similarity, min(cluster_size) AS smallest, max(cluster_size) AS largest, round(max(quality_score), 6) AS best_quality, round(min(quality_score), 6) AS worst_quality FROM cq"""))
def cluster_report(spark, sf):
    return rounded(cl.cluster_report(by_label(spark, sf, "vec_id")), "avg_quality", "avg_similarity", "best_quality", "worst_quality")


@query("cluster_ranking", with_ctes("people", f"{BY_VEC} SELECT {SHOWN} FROM cq ORDER BY cq.quality_score DESC, cluster LIMIT 10"))
def cluster_ranking(spark, sf):
    return rounded(cl.top_clusters(by_label(spark, sf, "vec_id"), 10), *NUMBERS)


@query("quality_band", with_ctes("people", f"""{BY_VEC} SELECT CASE WHEN quality_score > 0.9 THEN 'high' WHEN quality_score > 0.7 THEN 'medium' ELSE 'low' END AS band,
  count(*) AS clusters, CAST(sum(cluster_size) AS BIGINT) AS embeddings FROM cq GROUP BY 1"""))
def quality_band(spark, sf):
    return cl.quality_bands(by_label(spark, sf, "vec_id"))


# All sets at once: density clusters per set name, the one complete linkage as above, and the quality of both.
SETS = ", ".join(f"('{n}', {s}, {q}, {d}, CAST({e} AS DOUBLE), {m}, {k})" for n, s, q, d, e, m, k in cl.PARAMETER_SETS)
LINKED = [(n, s, q) for n, s, q, density, *_ in cl.PARAMETER_SETS if not density]
FIT = "confidence >= 0.3 AND list_stddev_pop(embedding) > 0.01"
COMPLETE_SETS = " UNION ALL ".join(
    f"SELECT '{n}' AS name, ord, cluster FROM ({COMPLETE.replace('people', f'(SELECT * FROM people WHERE {FIT} AND embedding_quality >= {q})').replace('CAST(0.88 AS DOUBLE)', f'CAST({s} AS DOUBLE)').replace('WITH st', 'WITH RECURSIVE st', 1)})"
    for n, s, q in LINKED
)
TUNING = f"""WITH ps(name, sim, q, dens, eps, m, mn) AS (VALUES {SETS}),
  g AS MATERIALIZED (SELECT * FROM people WHERE {FIT}),
  pr AS MATERIALIZED (SELECT p.ord AS a, q.ord AS b, least(p.embedding_quality, q.embedding_quality) AS lo, 1 - least(1, greatest(0, {COS})) AS d FROM g p JOIN g q ON p.ord <> q.ord WHERE 1 - least(1, greatest(0, {COS})) <= 0.16),
  near AS MATERIALIZED (SELECT name, a, b FROM ps JOIN pr ON lo >= q AND d <= eps WHERE dens),
  core AS MATERIALIZED (SELECT ps.name, g.ord FROM ps JOIN g ON embedding_quality >= q LEFT JOIN (SELECT name, a, count(*) AS n FROM near GROUP BY ALL) c ON c.name = ps.name AND c.a = g.ord WHERE dens AND coalesce(n, 0) + 1 >= m),
  ce AS MATERIALIZED (SELECT n.name, a, b FROM near n JOIN core x ON x.name = n.name AND x.ord = n.a JOIN core y ON y.name = n.name AND y.ord = n.b),
  walk AS (SELECT name, ord AS root, ord FROM core UNION SELECT w.name, w.root, ce.b FROM walk w JOIN ce ON ce.name = w.name AND ce.a = w.ord),
  lab AS MATERIALIZED (SELECT name, ord, min(root) AS cluster FROM walk GROUP BY name, ord),
  brd AS (SELECT n.name, n.a AS ord, min(l.cluster) AS cluster FROM near n JOIN lab l ON l.name = n.name AND l.ord = n.b WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.name = n.name AND c.ord = n.a) GROUP BY n.name, n.a),
  al AS (SELECT * FROM lab UNION ALL SELECT * FROM brd UNION ALL {COMPLETE_SETS}),
  mb AS MATERIALIZED (SELECT name, cluster, count(*) OVER (PARTITION BY name, cluster) AS n, mn, g.* FROM al JOIN ps USING (name) JOIN g USING (ord)),
  cs AS (SELECT p.name, p.cluster, avg({COS}) AS av, min({COS}) AS lw FROM mb p JOIN mb q ON p.name = q.name AND p.cluster = q.cluster AND p.ord < q.ord WHERE p.n >= p.mn GROUP BY 1, 2),
  ag AS (SELECT name, cluster, any_value(n) AS cluster_size, avg(embedding_quality) AS aq, avg(confidence) AS ac FROM mb WHERE n >= mn GROUP BY 1, 2),
  cq AS (SELECT name, cluster_size, 0.4 * av + 0.3 * lw + 0.2 * aq + 0.1 * ac AS quality_score FROM ag JOIN cs USING (name, cluster)),
  ts AS (SELECT name, count(cluster_size) AS num_clusters, coalesce(avg(cluster_size), 0) AS avg_cluster_size, coalesce(avg(quality_score), 0) AS avg_quality, coalesce(min(quality_score), 0) AS min_quality,
    coalesce(max(quality_score), 0) AS max_quality, coalesce(max(cluster_size), 0) AS largest_cluster, coalesce(min(cluster_size), 0) AS smallest_cluster
    FROM ps LEFT JOIN (SELECT * FROM cq WHERE quality_score > 0.3) USING (name) GROUP BY name)"""
RATES = ("avg_cluster_size", "avg_quality", "min_quality", "max_quality")


@query("tuning_summary", with_ctes("people", f"""{TUNING} SELECT name, num_clusters, {', '.join(f'round({c}, 6) AS {c}' for c in RATES)}, largest_cluster, smallest_cluster FROM ts""", recursive=True))
def tuning_summary(spark, sf):
    return rounded(cl.tuning_summary(fx.people(spark, sf)), *RATES)


@query("parameter_sweep", with_ctes("people", f"""{TUNING}, hp AS (SELECT name, num_clusters, min_quality AS score FROM ts WHERE num_clusters > 0 AND avg_quality > 0.9 AND largest_cluster < 100 ORDER BY round(min_quality, 6) DESC, name LIMIT 1),
  bl AS (SELECT name, num_clusters, avg_quality AS score FROM ts WHERE num_clusters BETWEEN 10 AND 50 ORDER BY round(avg_quality, 6) DESC, name LIMIT 1)
  SELECT 'high_precision' AS kind, name, num_clusters, round(score, 6) AS score FROM hp UNION ALL SELECT 'balanced', name, num_clusters, round(score, 6) FROM bl""", recursive=True))
def parameter_sweep(spark, sf):
    """All fixed parameter sets and their recommendation; rates that agree to six digits are equal."""
    return cl.best_runs(rounded(cl.tuning_summary(fx.people(spark, sf), cl.PARAMETER_SETS), *RATES))


# ---- comparison of runs, from the orders ----
RUNS = """r AS (SELECT concat('run-', o_custkey % 500) AS name, count(*) AS num_clusters, avg(o_totalprice) / 500000 AS avg_quality, min(o_totalprice) / 500000 AS min_quality,
    max(o_totalprice) / 500000 AS max_quality, max(o_orderkey % 90) AS largest_cluster, avg(o_totalprice) / 10000 AS fps FROM orders {where} GROUP BY 1)"""


def runs(spark, sf, where="true"):
    return fx.table(spark, sf, "orders").filter(where).groupBy(F.expr("concat('run-', o_custkey % 500)").alias("name")).agg(
        F.count("*").alias("num_clusters"), (F.avg("o_totalprice") / 500000).alias("avg_quality"), (F.min("o_totalprice") / 500000).alias("min_quality"),
        (F.max("o_totalprice") / 500000).alias("max_quality"), F.max(F.expr("o_orderkey % 90")).alias("largest_cluster"), (F.avg("o_totalprice") / 10000).alias("fps"),
    )


@query("run_comparison", "WITH " + RUNS.format(where="WHERE o_orderstatus = 'F'").replace("r AS", "a AS", 1) + ", " + RUNS.format(where="WHERE o_orderstatus <> 'F'").replace("r AS", "b AS", 1) + """
  SELECT name, b.num_clusters - a.num_clusters AS cluster_change, round(b.avg_quality - a.avg_quality, 6) AS quality_change, round(b.min_quality - a.min_quality, 6) AS precision_change,
    round(b.fps / a.fps, 6) AS speedup, CASE WHEN b.avg_quality - a.avg_quality > 0.01 THEN 'significant' WHEN b.avg_quality - a.avg_quality > 0.005 THEN 'moderate' ELSE 'none' END AS verdict FROM a JOIN b USING (name)""")
def run_comparison(spark, sf):
    """Finished orders as the baseline run, the others as the candidate."""
    out = compare.compare_runs(runs(spark, sf, "o_orderstatus = 'F'"), runs(spark, sf, "o_orderstatus <> 'F'"))
    return rounded(out, "quality_change", "precision_change", "speedup")


@query("best_run", "WITH " + RUNS.format(where="") + """, p AS (SELECT name, num_clusters, min_quality AS score FROM r WHERE num_clusters > 0 AND avg_quality > 0.9 AND largest_cluster < 100 ORDER BY min_quality DESC, name LIMIT 1),
  b AS (SELECT name, num_clusters, avg_quality AS score FROM r WHERE num_clusters BETWEEN 10 AND 50 ORDER BY avg_quality DESC, name LIMIT 1),
  f AS (SELECT name, num_clusters, fps AS score FROM r ORDER BY fps DESC, name LIMIT 1)
  SELECT 'high_precision' AS kind, name, num_clusters, round(score, 6) AS score FROM p UNION ALL SELECT 'balanced', name, num_clusters, round(score, 6) FROM b UNION ALL SELECT 'fastest', name, num_clusters, round(score, 6) FROM f""")
def best_run(spark, sf):
    found = runs(spark, sf)
    return rounded(cl.best_runs(found).unionByName(compare.fastest_run(found)), "score")
