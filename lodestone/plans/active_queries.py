"""Queries of the active-learning rounds: acquisition, strategy, convergence, history, quartiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import score_label
from ..operators import acquisition as A
from ..operators import search
from .registry import register, table
from .table_queries import al_table

#: Predictions: each customer's mean order and its spread.
PRED = """pred AS (SELECT o_custkey AS row_id, round(avg(o_totalprice), 4) AS y_pred, round(stddev_samp(o_totalprice), 4) AS y_pred_sd FROM orders GROUP BY 1 HAVING count(*) >= 2)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("row_id")).agg(F.round(F.avg("o_totalprice"), 4).alias("y_pred"), F.round(F.stddev_samp("o_totalprice"), 4).alias("y_pred_sd"), F.count("*").alias("n"))
    return g.where("n >= 2").drop("n")


def _ranked(metric: str, order: str) -> str:
    return f"WITH {PRED}, m AS (SELECT *, {metric} AS metric FROM pred) SELECT row_number() OVER (ORDER BY {order}, row_id) AS rank, row_id, round_even(y_pred, 4) AS y_pred, round_even(y_pred_sd, 4) AS y_pred_sd, round(metric, 3) AS metric FROM m ORDER BY {order}, row_id LIMIT 10"


def _top(spark, sf, kind, alpha):
    r = A.rank_candidates(predictions(spark, sf), kind, alpha, n=10)
    return A.preview(r).drop("metric").join(r.select("rank", F.round("metric", 3).alias("metric")), "rank")


@register("acquisition_ucb_max", _ranked("y_pred + 0.5 * y_pred_sd", "metric DESC, y_pred DESC, y_pred_sd DESC"))
def acquisition_ucb_max(spark, sf):
    return _top(spark, sf, "max", 0.5)


@register("acquisition_lcb_min", _ranked("y_pred - 0.5 * y_pred_sd", "metric, y_pred, y_pred_sd DESC"))
def acquisition_lcb_min(spark, sf):
    return _top(spark, sf, "min", 0.5)


@register("acquisition_uncertainty", _ranked("y_pred_sd", "y_pred_sd DESC, y_pred DESC"))
def acquisition_uncertainty(spark, sf):
    return _top(spark, sf, "uncertainty", 0.0)


SCORES = "SELECT c_custkey AS id, (CASE WHEN c_custkey % 12 = 11 THEN NULL ELSE c_custkey % 12 END)::DOUBLE AS score FROM customer"


def scores(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), F.when(k % 12 != 11, k % 12).cast("double").alias("score"))


@register("strategy", f"""SELECT id, score, CASE WHEN score IS NULL OR score <= 6 THEN 'model' ELSE 'hit' END AS strategy,
  CASE WHEN score IS NULL THEN 'unknown' WHEN score <= 6 THEN '<=6' WHEN score <= 8 THEN '7-8' ELSE '>8' END AS score_band,
  CASE WHEN score IS NULL OR score <= 6 THEN NULL WHEN score <= 8 THEN 1.0 ELSE 0.5 END::DOUBLE AS alpha FROM ({SCORES})""")
def strategy(spark, sf):
    return scores(spark, sf).withColumns(A.strategy_columns(F.col("score")))


@register("score_labels", f"SELECT id, CASE WHEN score IS NULL THEN 'unavailable' WHEN score <= 3 THEN 'very weak' WHEN score <= 6 THEN 'weak to moderate' WHEN score <= 8 THEN 'good' ELSE 'strong' END AS label FROM ({SCORES})")
def score_labels(spark, sf):
    return scores(spark, sf).select("id", score_label(F.col("score")).alias("label"))


@register("best_variant", "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 > c_custkey % 7 THEN 'no_PFI' ELSE 'PFI' END AS variant, greatest(c_custkey % 10, c_custkey % 7) AS score FROM customer")
def best_variant(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), (k % 10).alias("a"), (k % 7).alias("b")).withColumns(A.best_score(F.col("a"), F.col("b"))).select("id", "variant", "score")


#: A metric history: one batch for each year of orders.
HISTORY = """h AS (SELECT (year(o_orderdate) - 1991)::INT AS batch, round(avg(o_totalprice) / 100000, 3) AS rmse, round(stddev_pop(o_totalprice) / 100000, 3) AS SD, (7 + year(o_orderdate) % 2)::INT AS score FROM orders GROUP BY year(o_orderdate))"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, sf, "orders").groupBy(y.alias("y")).agg(F.round(F.avg("o_totalprice") / 100000, 3).alias("rmse"), F.round(F.stddev_pop("o_totalprice") / 100000, 3).alias("SD")).select((F.col("y") - 1991).cast("int").alias("batch"), "rmse", "SD", (7 + F.col("y") % 2).cast("int").alias("score"))


CONVERGENCE = f"""WITH {HISTORY}, p AS (SELECT *, lag(rmse) OVER w AS pr, lag(SD) OVER w AS ps, lag(score) OVER w AS pc, row_number() OVER (ORDER BY batch DESC) AS back, count(*) OVER () AS n FROM h WINDOW w AS (ORDER BY batch)),
  f AS (SELECT *, CASE WHEN back <= least(2, n - 1) AND pr - rmse >= 0 AND pr - rmse <= 0.05 * pr THEN 1 ELSE 0 END AS rmse_converged, CASE WHEN back <= least(2, n - 1) AND ps - SD >= 0 AND ps - SD <= 0.05 * ps THEN 1 ELSE 0 END AS SD_converged, CASE WHEN back <= least(2, n - 1) AND score - pc >= 0 THEN 1 ELSE 0 END AS score_converged FROM p)
  SELECT batch, rmse, SD, score, rmse_converged, SD_converged, score_converged, CASE WHEN sum(CASE WHEN back <= 2 THEN rmse_converged * SD_converged * score_converged ELSE 0 END) OVER () >= 2 AND back <= 2 THEN 'yes' ELSE 'no' END AS convergence FROM f"""


@register("convergence", CONVERGENCE)
def convergence(spark, sf):
    return A.convergence(history(spark, sf))


@register("stop_rule", f"WITH c AS ({CONVERGENCE}), b AS (SELECT *, score <= lag(score) OVER (ORDER BY batch) AS flat, row_number() OVER (ORDER BY batch DESC) AS back FROM c), a AS (SELECT count(*) FILTER (WHERE flat AND back <= 2) AS flat, arg_max(score, batch) AS score, arg_max(convergence, batch) AS convergence FROM b), w AS (SELECT CASE WHEN convergence = 'yes' THEN 'converged' WHEN score >= 8 THEN 'score' WHEN flat >= 2 THEN 'no improvement' END AS reason FROM a) SELECT reason IS NOT NULL AS stop, reason FROM w")
def stop_rule(spark, sf):
    return A.stop_recommended(A.convergence(history(spark, sf)))


@register("metric_transitions", f"WITH {HISTORY}, p AS (SELECT batch, rmse AS cur, lag(rmse) OVER (ORDER BY batch) AS prev FROM h) SELECT batch, printf('rmse: %.4f -> %.4f | %s | change = %.2f%% | tolerance = %.2f%%', prev, cur, CASE WHEN cur < prev THEN 'improved' WHEN cur = prev THEN 'unchanged' ELSE 'worsened' END, CASE WHEN prev = 0 THEN 0.0 ELSE abs(prev - cur) / abs(prev) * 100 END, 5.0::DOUBLE) AS text FROM p WHERE prev IS NOT NULL")
def metric_transitions(spark, sf):
    return A.transitions(history(spark, sf), "rmse")


@register("history_upsert", f"WITH {HISTORY}, e AS (SELECT * FROM h WHERE batch <= 4), n AS (SELECT batch, rmse + 1 AS rmse, SD, score FROM h WHERE batch IN (2, 4, 5, 6)), m AS (SELECT max(batch) AS m FROM e) SELECT e.* FROM e, m WHERE batch < m OR batch NOT IN (SELECT batch FROM n) UNION ALL SELECT n.* FROM n, m WHERE batch >= m")
def history_upsert(spark, sf):
    h = history(spark, sf)
    return A.upsert_history(h.where("batch <= 4"), h.where("batch in (2, 4, 5, 6)").withColumn("rmse", F.col("rmse") + 1))


@register("previous_batch", f"WITH {HISTORY} SELECT batch, round((lag(rmse) OVER (ORDER BY batch) - rmse) / lag(rmse) OVER (ORDER BY batch), 6) AS gain FROM h")
def previous_batch(spark, sf):
    return search.marginal_gain(history(spark, sf), "rmse", "batch").withColumn("gain", F.round("gain", 6))


@register("look_ahead_gain", f"WITH {HISTORY} SELECT batch, round(coalesce((rmse - lead(rmse, 1) OVER w) / rmse, 0), 6) + 0.0 AS g1, round(coalesce((rmse - lead(rmse, 2) OVER w) / rmse, 0), 6) + 0.0 AS g2 FROM h WINDOW w AS (ORDER BY batch)")
def look_ahead_gain(spark, sf):
    return search.look_ahead(history(spark, sf), "rmse", "batch").select("batch", *[(F.round(g, 6) + 0.0).alias(g) for g in ("g1", "g2")])


@register("quartile_labels", f"WITH {PRED}, b AS (SELECT min(y_pred) AS lo, (max(y_pred) - min(y_pred)) / 4 AS s FROM pred) SELECT row_id, CASE WHEN y_pred <= lo + s THEN 'q1' WHEN y_pred <= lo + 2 * s THEN 'q2' WHEN y_pred <= lo + 3 * s THEN 'q3' ELSE 'q4' END AS quartile FROM pred, b")
def quartile_labels(spark, sf):
    return A.quartile_labels(predictions(spark, sf), "y_pred").select("row_id", "quartile")


@register("range_quartiles", f"""WITH {PRED}, x AS (SELECT y_pred AS v FROM pred WHERE row_id % 5 = 0), r AS (SELECT min(v) - 0.2 * (max(v) - min(v)) AS lo, max(v) + 0.2 * (max(v) - min(v)) AS hi FROM x),
  e AS (SELECT (SELECT y_pred FROM pred, r ORDER BY abs(y_pred - lo), y_pred LIMIT 1) AS lo, (SELECT y_pred FROM pred, r ORDER BY abs(y_pred - hi), y_pred LIMIT 1) AS hi)
  SELECT {", ".join(f"round(lo + {i} * (hi - lo) / 4, 4) AS b{i}" for i in range(5))}, {", ".join(f"round(lo + {i + 0.5} * (hi - lo) / 4, 4) AS m{i + 1}" for i in range(4))} FROM e""")
def range_quartiles(spark, sf):
    p = predictions(spark, sf)
    q = A.range_quartiles(p, p.where("row_id % 5 = 0"), "y_pred")
    return q.select(*[F.round(c, 4).alias(c) for c in q.columns])


@register("quartile_diversity")
def quartile_diversity(spark, sf):
    order = A.diversity_order(predictions(spark, sf), 10)
    return spark.createDataFrame([(i + 1, r, q) for i, (r, q) in enumerate(order)], "place long, row_id long, quartile string")


@register("quartile_exploration")
def quartile_exploration(spark, sf):
    p = predictions(spark, sf)
    b = A.range_quartiles(p, p.where("row_id % 5 = 0"), "y_pred").first()
    q = A.quartile_of(p.where("row_id % 5 <> 0"), "y_pred", b.b0, b.b4)
    ids = A.explore_quartiles(q, 8, {"q1": 1}, {f"q{i}": b[f"m{i}"] for i in range(1, 5)})
    return spark.createDataFrame([(i + 1, r) for i, r in enumerate(ids)], "place long, row_id long")


@register("round_update", f"""WITH {PRED}, c AS (SELECT row_id FROM pred WHERE row_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 > 1) ORDER BY y_pred + y_pred_sd DESC, y_pred DESC, y_pred_sd DESC, row_id LIMIT 5)
  SELECT c_custkey AS row_id, (CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 5 = 1 THEN 1 WHEN c_custkey IN (SELECT row_id FROM c) THEN 2 END)::DOUBLE AS batch FROM customer""")
def round_update(spark, sf):
    """One round over a labeling table: rank the pool, give the best five the next batch."""
    from ..operators import hygiene

    t = al_table(spark, sf)
    ranked = A.rank_candidates(predictions(spark, sf).join(hygiene.pool(t).select("row_id"), "row_id", "left_semi"), "max", 1.0, n=5)
    number = hygiene.next_batch(t, "y").first()["next_batch"]
    return hygiene.assign_batch(t, ranked, number, "row_id").select("row_id", F.col("batch").cast("double").alias("batch"))
