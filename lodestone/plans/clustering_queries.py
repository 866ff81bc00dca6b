"""Queries of clustering metrics, scores and choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import stats
from .registry import register
from .vector_queries import EMB, features

SIZES = """s AS (SELECT label, count(*) AS size FROM l GROUP BY 1), t AS (SELECT sum(size) AS n, count(*) FILTER (WHERE label <> -1) AS k, coalesce(sum(size) FILTER (WHERE label = -1), 0) AS noise, max(size) FILTER (WHERE label <> -1) AS top, sum(size) FILTER (WHERE label <> -1) AS clustered FROM s),
  h AS (SELECT -sum(size::DOUBLE / clustered * ln(size::DOUBLE / clustered + 1e-12)) AS h FROM s, t WHERE label <> -1)"""
NOISY = "l AS (SELECT vec_id AS row_id, CASE WHEN vec_id % 17 = 0 THEN -1 ELSE label END AS label FROM embeddings)"


def noisy(spark, sf):
    return features(spark, sf).withColumn("label", F.when(F.col("row_id") % 17 == 0, -1).otherwise(F.col("label")))


@register("cluster_sizes", f"WITH {NOISY} SELECT label, count(*) AS size FROM l GROUP BY 1")
def cluster_sizes(spark, sf):
    return stats.cluster_sizes(noisy(spark, sf))


@register("size_summary", f"WITH {NOISY}, {SIZES} SELECT n::BIGINT AS n, k AS n_clusters, round(noise / n, 6) AS noise_fraction, round(top / clustered, 6) AS max_fraction, round(CASE WHEN k < 2 THEN 1.0 ELSE 1 - h / ln(k) END, 6) AS imbalance FROM t, h")
def size_summary(spark, sf):
    return stats.size_summary(noisy(spark, sf)).select("n", "n_clusters", *[F.round(c, 6).alias(c) for c in ("noise_fraction", "max_fraction", "imbalance")])


@register("adjusted_rand", """WITH p AS (SELECT label AS a, vec_id % 4 AS b, count(*)::DOUBLE AS n FROM embeddings GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM p),
  a AS (SELECT sum(n * (n - 1) / 2) AS i FROM (SELECT sum(n) AS n FROM p GROUP BY a)), b AS (SELECT sum(n * (n - 1) / 2) AS j FROM (SELECT sum(n) AS n FROM p GROUP BY b)), e AS (SELECT *, i * j / (n * (n - 1) / 2) AS e FROM x, a, b)
  SELECT round((ij - e) / ((i + j) / 2 - e), 6) + 0.0 AS ari FROM e""")
def adjusted_rand(spark, sf):
    f = features(spark, sf).withColumn("other", F.col("row_id") % 4)
    return stats.adjusted_rand(f, "label", "other").select((F.round("ari", 6) + 0.0).alias("ari"))


SIL = f"""e AS ({EMB}), p AS (SELECT a.row_id, a.label AS la, b.label AS lb, avg(list_distance(a.f, b.f)) AS d FROM e a, e b WHERE a.row_id <> b.row_id GROUP BY ALL),
  s AS (SELECT row_id, max(d) FILTER (WHERE la = lb) AS i, min(d) FILTER (WHERE la <> lb) AS o FROM p GROUP BY 1), r AS (SELECT row_id, CASE WHEN i IS NULL OR o IS NULL THEN 0.0 ELSE (o - i) / greatest(o, i) END AS silhouette FROM s)"""


@register("silhouette_rows", f"WITH {SIL} SELECT row_id, round(silhouette, 6) + 0.0 AS silhouette FROM r")
def silhouette_rows(spark, sf):
    return C.silhouette_rows(features(spark, sf)).withColumn("silhouette", F.round("silhouette", 6) + 0.0)


@register("silhouette", f"WITH {SIL} SELECT round(avg(silhouette), 6) + 0.0 AS silhouette FROM r")
def silhouette(spark, sf):
    return C.silhouette(features(spark, sf)).withColumn("silhouette", F.round("silhouette", 6) + 0.0)


DIMS = "x AS (SELECT label, generate_subscripts(embedding, 1) AS p, unnest(embedding::DOUBLE[]) AS v FROM embeddings)"


@register("calinski_harabasz", f"WITH {DIMS}, g AS (SELECT label, p, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM x GROUP BY ALL), t AS (SELECT p, sum(n * m) / sum(n) AS mean FROM g GROUP BY 1), q AS (SELECT sum(n * pow(m - mean, 2)) AS ssb, sum(n * s) AS ssw FROM g JOIN t USING (p)), c AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings) SELECT round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS calinski_harabasz FROM q, c")
def calinski_harabasz(spark, sf):
    return C.calinski_harabasz(features(spark, sf)).withColumn("calinski_harabasz", F.round("calinski_harabasz", 6))


@register("davies_bouldin", f"WITH {DIMS}, m AS (SELECT label, p, avg(v) AS m FROM x GROUP BY ALL), c AS (SELECT label, list(m ORDER BY p) AS c FROM m GROUP BY 1), s AS (SELECT e.label, avg(list_distance(embedding::DOUBLE[], c)) AS s FROM embeddings e JOIN c USING (label) GROUP BY 1), w AS (SELECT a.label, max((a.s + b.s) / list_distance(ca.c, cb.c)) AS r FROM s a, s b, c ca, c cb WHERE a.label <> b.label AND ca.label = a.label AND cb.label = b.label GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM w")
def davies_bouldin(spark, sf):
    return C.davies_bouldin(features(spark, sf)).withColumn("davies_bouldin", F.round("davies_bouldin", 6))


#: Made-up candidates, one for each nation.
CANDIDATES = """c AS (SELECT n_nationkey::INT AS id, n_nationkey % 7 AS n_clusters, n_nationkey / 20.0 - 0.2 AS silhouette, (n_nationkey * 7 % 10) / 20.0 AS noise_fraction, (n_nationkey * 3 % 10) / 10.0 AS max_fraction, (n_nationkey % 11) / 10.0 AS imbalance,
  n_nationkey * 13 % 19 * 1.5 AS calinski_harabasz, CASE WHEN n_nationkey % 6 = 5 THEN 'Infinity'::DOUBLE ELSE (n_nationkey * 5 % 9) / 3.0 END AS davies_bouldin, (n_nationkey * 11 % 10) / 10.0 AS stability, (n_nationkey * 7 % 8) / 8.0 AS density FROM nation)"""


def candidates(spark, sf) -> list[C.Candidate]:
    """The same as candidates of the library, with the reasons that its filters find."""
    from .registry import table

    k = F.col("n_nationkey").cast("int")
    d = lambda c, by: c.cast("double") / F.lit(float(by))
    rows = table(spark, sf, "nation").select(
        k.alias("id"), (k % 7).alias("n_clusters"), (d(k, 20) - 0.2).alias("silhouette"), d(k * 7 % 10, 20).alias("noise_fraction"), d(k * 3 % 10, 10).alias("max_fraction"), d(k % 11, 10).alias("imbalance"),
        (k * 13 % 19 * 1.5).alias("calinski_harabasz"), F.when(k % 6 == 5, float("inf")).otherwise(d(k * 5 % 9, 3)).alias("davies_bouldin"), d(k * 11 % 10, 10).alias("stability"), d(k * 7 % 8, 8).alias("density"),
    )
    return [C.Candidate("made up", {"id": r.id}, m := r.asDict(), C.filter_reasons(m)) for r in rows.orderBy("id").collect()]


def passing(spark, sf) -> list[C.Candidate]:
    """All of them, as if they had passed the filters."""
    found = candidates(spark, sf)
    for c in found:
        c.reasons = []
    return found


def _rounded(v: float, digits: int) -> float:
    return round(v, digits) + 0.0


@register("quality_filters", f"WITH {CANDIDATES} SELECT id, concat_ws(',', CASE WHEN n_clusters < 2 THEN 'too_few_clusters' END, CASE WHEN silhouette < 0 THEN 'silhouette' END, CASE WHEN noise_fraction > 0.20 THEN 'noise' END, CASE WHEN max_fraction > 0.85 THEN 'dominant_cluster' END, CASE WHEN imbalance > 0.90 THEN 'imbalance' END) AS reasons FROM c")
def quality_filters(spark, sf):
    return spark.createDataFrame([(c.params["id"], ",".join(c.reasons)) for c in candidates(spark, sf)], "id int, reasons string")


def _norm(c: str, lower: bool = False) -> str:
    v = f"(CASE WHEN isinf({c}) THEN NULL ELSE {'-' if lower else ''}{c} END)"
    lo, hi = f"min({v}) OVER ()", f"max({v}) OVER ()"
    return f"(CASE WHEN {hi} - {lo} <= 1e-12 THEN 1.0 ELSE (coalesce({v}, {lo}) - {lo}) / ({hi} - {lo}) END)"


NORM = f"n AS (SELECT *, {_norm('silhouette::DOUBLE')} AS sil, {_norm('calinski_harabasz::DOUBLE')} AS ch, {_norm('davies_bouldin', True)} AS db, {_norm('stability::DOUBLE')} AS stab, {_norm('density::DOUBLE')} AS dens FROM c)"
INTERNAL = "0.35 * sil + 0.25 * ch + 0.20 * db + 0.20 * stab - 0.05 * imbalance"


@register("normalized_scores", f"WITH {CANDIDATES}, {NORM} SELECT id, round(sil, 6) AS sil, round(ch, 6) AS ch, round(db, 6) AS db FROM n")
def normalized_scores(spark, sf):
    found = candidates(spark, sf)
    sil, ch, db = (C.normalize([c.metrics[k] for c in found], k == "davies_bouldin") for k in ("silhouette", "calinski_harabasz", "davies_bouldin"))
    return spark.createDataFrame([(c.params["id"], *[_rounded(v[i], 6) for v in (sil, ch, db)]) for i, c in enumerate(found)], "id int, sil double, ch double, db double")


@register("internal_scores", f"WITH {CANDIDATES}, {NORM} SELECT id, round({INTERNAL}, 5) + 0.0 AS internal, round(0.35 * sil + 0.20 * dens + 0.25 * stab + 0.10 * db + 0.10 * ch - 0.10 * noise_fraction - 0.05 * imbalance, 5) + 0.0 AS by_density FROM n")
def internal_scores(spark, sf):
    found, dense = passing(spark, sf), passing(spark, sf)
    C.internal_scores(found)
    C.internal_scores(dense, density=True)
    return spark.createDataFrame([(a.params["id"], _rounded(a.internal, 5), _rounded(b.internal, 5)) for a, b in zip(found, dense, strict=True)], "id int, internal double, by_density double")


@register("final_scores", f"WITH {CANDIDATES}, {NORM} SELECT id, round(0.30 * stab + 0.32 * sil + 0.22 * db - 0.12 * noise_fraction - 0.04 * imbalance, 5) + 0.0 AS final FROM n")
def final_scores(spark, sf):
    found = passing(spark, sf)
    C.final_scores(found)
    return spark.createDataFrame([(c.params["id"], _rounded(c.final, 5)) for c in found], "id int, final double")


@register("simplest_model", f"WITH {CANDIDATES}, {NORM}, i AS (SELECT id, n_clusters, {INTERNAL} AS score FROM n) SELECT id, n_clusters, round(score, 5) AS score FROM i WHERE score >= (SELECT max(score) FROM i) - 0.02 ORDER BY n_clusters, i.score DESC, id LIMIT 1")
def simplest_model(spark, sf):
    found = passing(spark, sf)
    C.internal_scores(found)
    best = C.simplest(found)
    return spark.createDataFrame([(best.params["id"], best.metrics["n_clusters"], _rounded(best.internal, 5))], "id int, n_clusters int, score double")


@register("search_objective", f"WITH {CANDIDATES} SELECT id, round(CASE WHEN n_clusters < 2 OR silhouette < 0 OR noise_fraction > 0.20 OR max_fraction > 0.85 OR imbalance > 0.90 THEN -1 ELSE 0.45 * (silhouette + 1) / 2 + 0.25 * stability + CASE WHEN isinf(davies_bouldin) THEN 0 ELSE 0.25 / (1 + davies_bouldin) END - 0.05 * imbalance END, 5) + 0.0 AS objective FROM c")
def search_objective(spark, sf):
    return spark.createDataFrame([(c.params["id"], _rounded(C.search_objective(c.metrics, bool(c.reasons)), 5)) for c in candidates(spark, sf)], "id int, objective double")


@register("model_summary", f"WITH {CANDIDATES}, {NORM} SELECT 'id=' || id AS params, n_clusters::INT AS n_clusters, round(silhouette, 6) AS silhouette, round({INTERNAL}, 5) + 0.0 AS internal FROM n")
def model_summary(spark, sf):
    found = passing(spark, sf)
    C.internal_scores(found)
    return C.summary(spark, found).select("params", "n_clusters", F.round("silhouette", 6).alias("silhouette"), (F.round("internal", 5) + 0.0).alias("internal"))


@register("size_limits", """WITH n AS (SELECT p_partkey AS n FROM part UNION ALL SELECT p_partkey * 20 FROM part UNION ALL SELECT p_partkey * 400 FROM part), t AS (SELECT n, CASE WHEN n <= 2000 THEN 'standard' WHEN n <= 10000 THEN 'large' WHEN n <= 25000 THEN 'very_large' ELSE 'ultra_large' END AS tier FROM n),
  k AS (SELECT n, tier, CASE WHEN n <= 100 THEN greatest(2, least(10, n // 3)) WHEN n <= 1000 THEN greatest(2, floor(sqrt(n))::BIGINT) ELSE greatest(2, least(floor(sqrt(n))::BIGINT, n // 15)) END AS k FROM t)
  SELECT n, tier, least(k, CASE tier WHEN 'large' THEN 60 WHEN 'very_large' THEN 80 WHEN 'ultra_large' THEN 100 ELSE k END)::INT AS k_max FROM k""")
def size_limits(spark, sf):
    """The tier and the largest number of clusters for tables of many sizes."""
    from .registry import table

    keys = [r[0] for r in table(spark, sf, "part").select("p_partkey").collect()]
    return spark.createDataFrame([(n, C.tier(n), C.k_max(n)) for by in (1, 20, 400) for n in (k * by for k in keys)], "n long, tier string, k_max int")


LABEL = "(silhouette < 0.10)::INT + (stability < 0.40)::INT + (noise_fraction > 0.30)::INT + (imbalance > 0.40)::INT + (final < 0.35)::INT"


@register("quality_labels", f"WITH {CANDIDATES}, f AS (SELECT *, stability / 2 + silhouette / 2 AS final FROM c) SELECT id, CASE WHEN {LABEL} = 0 AND silhouette >= 0.25 AND stability >= 0.80 AND noise_fraction <= 0.10 AND imbalance <= 0.30 AND final >= 0.60 THEN 'GOOD' WHEN {LABEL} <= 1 THEN 'ACCEPTABLE' WHEN {LABEL} = 2 THEN 'POOR' ELSE 'UNRELIABLE' END AS label FROM f")
def quality_labels(spark, sf):
    rows = [(c.params["id"], C.quality_label(c.metrics, c.metrics["stability"] / 2 + c.metrics["silhouette"] / 2)) for c in candidates(spark, sf)]
    return spark.createDataFrame(rows, "id int, label string")


@register("kmeans_sweep")
def kmeans_sweep(spark, sf):
    """Candidates of k-means over the whole table, as the workflow fits them, with their metrics, stability and scores."""
    from ..config import ClusterOptions
    from .workflows import natural_model as run

    found, _, _ = run(features(spark, sf), ClusterOptions(families=("kmeans",)))
    return C.summary(spark, found).withColumn("sizes", F.array_join("sizes", ","))


@register("mixture_bic")
def mixture_bic(spark, sf):
    """BIC of Gaussian mixtures of the whole table by distributed passes."""
    f = features(spark, sf)
    return spark.createDataFrame([("diag", k, C.gaussian_mixture(f, k, "diag")[1]) for k in (2, 3)], "kind string, k int, bic double")


@register("density_clusters")
def density_clusters(spark, sf):
    """Hierarchical density clusters of the whole table, with their validity."""
    from ..operators import density

    out = density.fit_density(features(spark, sf), 10, 5)
    return out.groupBy("label").agg(F.count("*").alias("size")).withColumn("validity", F.lit(density.validity(out)))


@register("natural_model")
def natural_model(spark, sf):
    """All families over the whole table: candidates with their scores."""
    from ..config import ClusterOptions
    from .workflows import natural_model as run

    found, quality, _ = run(features(spark, sf), ClusterOptions())
    return C.summary(spark, found).withColumn("sizes", F.array_join("sizes", ",")).withColumn("quality", F.lit(quality))
