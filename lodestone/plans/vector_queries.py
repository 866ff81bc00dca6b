"""Queries over vectors: selection, nearest rows, coverage, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import encode, stats
from ..operators import vectors as V
from ..session import Scratch
from .registry import register, table

EMB = "SELECT vec_id AS row_id, embedding::DOUBLE[] AS f, label FROM embeddings"
#: Two dimensions, so that geometry can be said in SQL too.
FLAT = "SELECT vec_id AS row_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings"
NEAREST = f"""e AS ({EMB}), s AS (SELECT row_id, f, row_number() OVER (ORDER BY row_id) - 1 AS region FROM e WHERE row_id % 50 = 0),
  d AS (SELECT e.row_id, s.region, list_distance(e.f, s.f) AS dist FROM e, s), n AS (SELECT row_id, arg_min(region, (dist, region)) AS region, min(dist) AS dist FROM d GROUP BY 1)"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def flat(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), e.embedding[0].cast("double").alias("x"), e.embedding[1].cast("double").alias("y"), "label")


@register("nearest_selected", f"WITH {NEAREST} SELECT row_id, region, round(dist, 6) AS dist FROM n")
def nearest_selected(spark, sf):
    f = features(spark, sf)
    return V.nearest(f, f.where("row_id % 50 = 0")).withColumn("dist", F.round("dist", 6))


@register("nearest_selected_sql", f"WITH {NEAREST} SELECT row_id, region, round(dist, 6) AS dist FROM n")
def nearest_selected_sql(spark, sf):
    f = features(spark, sf)
    return V.nearest_sql(f, f.where("row_id % 50 = 0")).withColumn("dist", F.round("dist", 6))


@register("average_gap", f"WITH {NEAREST} SELECT round(avg(dist), 6) AS avg_gap FROM n")
def average_gap(spark, sf):
    f = features(spark, sf)
    return V.average_gap(f, f.where("row_id % 50 = 0")).withColumn("avg_gap", F.round("avg_gap", 6))


@register("coverage_sample", "SELECT vec_id AS row_id FROM embeddings ORDER BY md5('7:' || vec_id), vec_id LIMIT 100")
def coverage_sample(spark, sf):
    return V.coverage_sample(features(spark, sf), 100, 7).select("row_id")


@register("centroid_representatives", """WITH e AS (SELECT vec_id AS row_id, label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings), m AS (SELECT label, p, avg(v) AS m FROM e GROUP BY ALL),
  d AS (SELECT label, row_id, round(sum((v - m) * (v - m)), 9) AS d FROM e JOIN m USING (label, p) GROUP BY ALL) SELECT label, arg_min(row_id, (d, row_id)) AS row_id FROM d GROUP BY 1""")
def centroid_representatives(spark, sf):
    return V.centroid_representatives(features(spark, sf))


def _traversal(k: int) -> str:
    steps = [f"WITH e AS ({EMB}), c1 AS (SELECT 1 AS rank, 0::BIGINT AS row_id)"]
    for i in range(2, k + 1):
        steps.append(f"c{i} AS (SELECT * FROM c{i - 1} UNION ALL (SELECT {i}, a.row_id FROM e a, (SELECT f FROM e WHERE row_id IN (SELECT row_id FROM c{i - 1})) b WHERE a.row_id NOT IN (SELECT row_id FROM c{i - 1}) GROUP BY a.row_id ORDER BY min(list_distance(a.f, b.f)) DESC, a.row_id LIMIT 1))")
    return ", ".join(steps) + f" SELECT rank::BIGINT AS rank, row_id FROM c{k}"


@register("farthest_first", _traversal(6))
def farthest_first(spark, sf):
    return V.farthest_first(features(spark, sf), 0, 6)


@register("representative_select")
def representative_select(spark, sf):
    return V.representative_select(features(spark, sf), 12)


@register("exploratory_select")
def exploratory_select(spark, sf):
    return V.exploratory_select(features(spark, sf), 10)


@register("natural_select")
def natural_select(spark, sf):
    return V.natural_select(features(spark, sf), 25)


def _allocation(n: int) -> str:
    """Largest remainders in SQL: floors of one at least, then the rest to the largest remainders, as long as no group is full and none was raised."""
    return f"""WITH s AS (SELECT label, count(*) AS size FROM embeddings GROUP BY 1), q AS (SELECT label, size, {n}::DOUBLE * size / (SELECT sum(size) FROM s) AS quota FROM s), f AS (SELECT *, greatest(1, floor(quota))::INT AS share FROM q),
  r AS (SELECT *, row_number() OVER (ORDER BY quota - share DESC, size DESC, label) AS place FROM f) SELECT label, (share + CASE WHEN place <= {n} - (SELECT sum(share) FROM f) THEN 1 ELSE 0 END)::INT AS share FROM r"""


@register("group_allocation", _allocation(37))
def group_allocation(spark, sf):
    sizes = {r[0]: r[1] for r in features(spark, sf).groupBy("label").count().collect()}
    return spark.createDataFrame(sorted(V.allocate(37, sizes).items()), "label int, share int")


HULL = f"""f AS ({FLAT}), s AS (SELECT * FROM f WHERE row_id % 10 = 0)"""


def _edges(t: str) -> str:
    """Sides of a convex hull by definition: pairs of points that have all others on their left."""
    return f"(SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS \"by\" FROM {t} a, {t} b WHERE a.row_id <> b.row_id AND NOT EXISTS (SELECT 1 FROM {t} c WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0))"


@register("hull_area", f"WITH {HULL} SELECT count(*) AS corners, round(abs(sum(ax * \"by\" - bx * ay)) / 2, 6) AS area FROM {_edges('s')}")
def hull_area(spark, sf):
    h = V.convex_hull(flat(spark, sf).where("row_id % 10 = 0"))
    return spark.createDataFrame([(len(h), round(V.polygon_area(h), 6))], "corners long, area double")


@register("points_in_hull", f"WITH {HULL}, e AS {_edges('s')} SELECT row_id, NOT EXISTS (SELECT 1 FROM e WHERE (bx - ax) * (f.y - ay) - (\"by\" - ay) * (f.x - ax) < -1e-12) AS inside FROM f")
def points_in_hull(spark, sf):
    f = flat(spark, sf)
    return f.select("row_id", V.inside_hull(F.col("x"), F.col("y"), V.convex_hull(f.where("row_id % 10 = 0"))).alias("inside"))


@register("grid_cells", f"WITH f AS ({FLAT}), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM f) SELECT row_id, least(greatest(floor((x - (x0 - 0.001 * (x1 - x0))) / (1.002 * (x1 - x0) / 8)), 0), 7)::INT AS i, least(greatest(floor((y - (y0 - 0.001 * (y1 - y0))) / (1.002 * (y1 - y0) / 8)), 0), 7)::INT AS j FROM f, b")
def grid_cells(spark, sf):
    from ..functions.scalars import grid_cell

    f = flat(spark, sf)
    b = F.broadcast(f.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")))
    return f.crossJoin(b).select("row_id", grid_cell(F.col("x"), F.col("x0"), F.col("x1"), 8).alias("i"), grid_cell(F.col("y"), F.col("y0"), F.col("y1"), 8).alias("j"))


@register("coverage_2d", f"""WITH {HULL}, n AS (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM f), k AS (SELECT count(*) AS k FROM s),
  g AS (SELECT *, least(30, greatest(6, round_even(sqrt(k) + 0.15 * sqrt(n), 0)))::INT AS g FROM n, k), es AS {_edges('s')}, ef AS {_edges('f')},
  c AS (SELECT row_id, x, y, least(greatest(floor((x - (x0 - 0.001 * (x1 - x0))) / (1.002 * (x1 - x0) / g)), 0), g - 1) AS i, least(greatest(floor((y - (y0 - 0.001 * (y1 - y0))) / (1.002 * (y1 - y0) / g)), 0), g - 1) AS j FROM f, g),
  inn AS (SELECT DISTINCT i, j FROM c WHERE NOT EXISTS (SELECT 1 FROM es WHERE (bx - ax) * (c.y - ay) - ("by" - ay) * (c.x - ax) < -1e-12)), mine AS (SELECT DISTINCT i, j FROM c WHERE row_id % 10 = 0), cells AS (SELECT DISTINCT i, j FROM c),
  r AS (SELECT least(1, (SELECT abs(sum(ax * "by" - bx * ay)) FROM es) / (SELECT abs(sum(ax * "by" - bx * ay)) FROM ef)) AS area, (SELECT count(*) FROM (SELECT * FROM mine INTERSECT SELECT * FROM inn))::DOUBLE / k AS filling, (SELECT count(*) FROM mine)::DOUBLE / (SELECT count(*) FROM cells) AS grid FROM k)
  SELECT round(area, 6) AS area, round(filling, 6) AS filling, round(grid, 6) AS grid, round(10 * (0.5 * area + 0.3 * grid + 0.2 * filling), 6) AS visual FROM r""")
def coverage_2d(spark, sf):
    f = flat(spark, sf)
    c = V.coverage_2d(f, f.where("row_id % 10 = 0"))
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


@register("evaluate_selection")
def evaluate_selection(spark, sf):
    """Metrics of rows that were chosen before, without a new choice."""
    from .workflows import evaluate_selection as evaluate

    f = features(spark, sf)
    xy, explained = encode.map_2d(f)
    return evaluate(f, xy.select("row_id", "x", "y"), f.where("row_id % 10 = 0").select("row_id"), explained)[0]


@register("map_cells", f"""WITH {HULL}, n AS (SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM f), k AS (SELECT count(*) AS k FROM s), g AS (SELECT *, least(30, greatest(6, round_even(sqrt(k) + 0.15 * sqrt(n), 0)))::INT AS g FROM n, k), es AS {_edges('s')},
  c AS (SELECT row_id, NOT EXISTS (SELECT 1 FROM es WHERE (bx - ax) * (f.y - ay) - ("by" - ay) * (f.x - ax) < -1e-12) AS inside, least(greatest(floor((x - (x0 - 0.001 * (x1 - x0))) / (1.002 * (x1 - x0) / g)), 0), g - 1)::INT AS i, least(greatest(floor((y - (y0 - 0.001 * (y1 - y0))) / (1.002 * (y1 - y0) / g)), 0), g - 1)::INT AS j FROM f, g)
  SELECT i, j, count(*) AS n, bool_or(row_id % 10 = 0) AS selected, bool_or(inside) AS inside FROM c GROUP BY 1, 2""")
def map_cells(spark, sf):
    f = flat(spark, sf)
    return V.map_cells(f, f.where("row_id % 10 = 0")).cells


#: Importance of the first dimensions over the regions of NEAREST: names, and the best five.
TOP = """u AS (SELECT row_id, 'd' || p AS descriptor, v FROM (SELECT row_id, unnest(range(1, 9)) AS p, unnest(f[1:8]) AS v FROM e)), ug AS (SELECT descriptor, region, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM u JOIN n USING (row_id) GROUP BY ALL),
  ut AS (SELECT descriptor, sum(n * m) / sum(n) AS mean, sum(n) AS n, count(*) AS k, sum(n * s) AS ssw FROM ug GROUP BY 1), ub AS (SELECT descriptor, sum(ug.n * pow(m - mean, 2)) AS ssb FROM ug JOIN ut USING (descriptor) GROUP BY 1),
  top AS (SELECT descriptor FROM ut JOIN ub USING (descriptor) ORDER BY (ssb / (k - 1)) / (ssw / (n - k)) DESC, ssb / (ssb + ssw) DESC, descriptor LIMIT 5)"""


@register("viewer_payload", f"WITH {NEAREST}, {TOP} SELECT u.row_id, round(e.f[1], 6) AS x, round(e.f[2], 6) AS y, region, u.row_id % 50 = 0 AS selected, descriptor, round(v, 6) AS value FROM u JOIN top USING (descriptor) JOIN n USING (row_id) JOIN e USING (row_id)")
def viewer_payload(spark, sf):
    """A map's payload over a selection, its five best descriptors one a row."""
    f = features(spark, sf)
    chosen, names = f.where("row_id % 50 = 0"), [f"d{i}" for i in range(1, 9)]
    wide = f.select("row_id", *[F.col("features")[i].alias(n) for i, n in enumerate(names)])
    payload = V.viewer_payload(flat(spark, sf), V.nearest(f, chosen), chosen, wide, names)
    return payload.select("row_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "region", "selected", F.explode("colours").alias("descriptor", "value")).withColumn("value", F.round("value", 6))


@register("pca_safeguard")
def pca_safeguard(spark, sf):
    out, info = encode.pca_safeguard(features(spark, sf), gate=30)
    return out.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("components")).withColumn("retained", F.lit(info["retained"]))


@register("map_2d")
def map_2d(spark, sf):
    return encode.map_2d(features(spark, sf))[0].select("row_id", "x", "y")


@register("trustworthiness", f"""WITH e AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS f, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
  p AS (SELECT a.row_id AS a, b.row_id AS b, round(list_sum(list_transform(range(1, 65), lambda i: (a.f[i] - b.f[i]) * (a.f[i] - b.f[i]))), 12) AS d, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) AS e FROM e a, e b WHERE a.row_id <> b.row_id),
  r AS (SELECT row_number() OVER (PARTITION BY a ORDER BY d, b) AS far, row_number() OVER (PARTITION BY a ORDER BY e, b) AS near FROM p)
  SELECT round(1 - 2.0 / ((SELECT count(*) FROM e) * 15 * (2 * (SELECT count(*) FROM e) - 3 * 15 - 1)) * sum(CASE WHEN near <= 15 AND far > 15 THEN far - 15 ELSE 0 END), 6) AS trustworthiness FROM r""")
def trustworthiness(spark, sf):
    f = features(spark, sf)
    f = f.withColumns({"x": F.col("features")[0], "y": F.col("features")[1]})
    return V.trustworthiness(f).withColumn("trustworthiness", F.round("trustworthiness", 6))


@register("anova_importance", """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS p, unnest(embedding::DOUBLE[]) AS v FROM embeddings), g AS (SELECT p, label, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM e GROUP BY ALL),
  t AS (SELECT p, sum(n * m) / sum(n) AS mean, sum(n) AS n, count(*) AS k, sum(n * s) AS ssw FROM g GROUP BY 1), b AS (SELECT p, sum(g.n * pow(m - mean, 2)) AS ssb FROM g JOIN t USING (p) GROUP BY 1),
  f AS (SELECT 'd' || lpad(p::VARCHAR, 2, '0') AS descriptor, (ssb / (k - 1)) / (ssw / (n - k)) AS f, ssb / (ssb + ssw) AS eta, n::BIGINT AS n, k FROM t JOIN b USING (p))
  SELECT row_number() OVER (ORDER BY f DESC, eta DESC, descriptor) AS rank, descriptor, round(f, 6) AS f_score, round(eta, 6) AS eta_squared, n AS n_samples_used, k AS n_clusters_used FROM f""")
def anova_importance(spark, sf):
    names = [f"d{i:02d}" for i in range(1, 65)]
    wide = features(spark, sf).select("label", *[F.col("features")[i].alias(n) for i, n in enumerate(names)])
    return stats.anova_importance(wide, names).select("rank", "descriptor", F.round("f_score", 6).alias("f_score"), F.round("eta_squared", 6).alias("eta_squared"), "n_samples_used", "n_clusters_used")
