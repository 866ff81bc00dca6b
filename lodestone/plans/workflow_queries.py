"""The two workflows as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ClusterOptions, LearnOptions
from ..sources.files import with_row_id
from . import workflows
from .registry import register, table


def parts(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("row_id"), "p_size", "p_retailprice", (F.length("p_name") * 1.0).alias("name_length"), (F.pmod(F.xxhash64("p_type"), F.lit(97)) * 1.0).alias("kind"), F.substring("p_brand", 1, 7).alias("maker"))


@register("cluster_representative")
def cluster_representative(spark, sf):
    return workflows.cluster(parts(spark, sf), "row_id", ClusterOptions(n_points=12, ignore=("maker",))).table


@register("cluster_exploratory")
def cluster_exploratory(spark, sf):
    s = workflows.cluster(parts(spark, sf), "row_id", ClusterOptions(n_points=10, mode="exploratory", ignore=("maker",)))
    return s.coverage.withColumn("selected", F.lit(s.selected.count()))


@register("cluster_auto")
def cluster_auto(spark, sf):
    s = workflows.cluster(parts(spark, sf), "row_id", ClusterOptions(max_points=60, ignore=("maker",)))
    return spark.createDataFrame([(b.size, b.gap, b.area) for b in s.budgets], "size int, gap double, area double")


@register("cluster_natural")
def cluster_natural(spark, sf):
    s = workflows.cluster(parts(spark, sf), "row_id", ClusterOptions(n_points=10, mode="natural", families=("kmeans",), max_clusters=12, ignore=("maker",)))
    return s.summary.withColumn("sizes", F.array_join("sizes", ",")).withColumn("quality", F.lit(s.quality)).withColumn("selected", F.lit(s.selected.count()))


@register("learning_round")
def learning_round(spark, sf):
    c = table(spark, sf, "customer")
    t = c.select(F.col("c_custkey").alias("row_id"), (F.col("c_nationkey") * 1.0).alias("a"), F.pmod(F.col("c_custkey") * 37, F.lit(101)).cast("double").alias("b"))
    t = t.withColumn("y", F.when(F.col("row_id") % 3 != 0, F.col("a") * 2 + F.col("b"))).withColumn("batch", F.when(F.col("row_id") % 3 != 0, F.lit(0)))
    return workflows.learn(t, "row_id", ["a", "b"], LearnOptions(n_exps=5)).ranking


@register("dense_row_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders")
def dense_row_ids(spark, sf):
    return with_row_id(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])
