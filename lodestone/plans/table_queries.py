"""Queries over tables: filters, de-duplication, joins, statistics, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators import acquisition, encode, hygiene, stats
from ..sources.files import with_row_id
from .registry import register, table

#: Customers as a labeling table: some have a target, some a batch.
AL = """SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS y,
  (CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 5 = 1 THEN 1 END)::DOUBLE AS batch, c_mktsegment AS segment FROM customer"""


def al_table(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("row_id"), F.when(k % 3 == 0, None).otherwise(F.round("c_acctbal", 2)).alias("y"), F.when(k % 5 == 0, 0).when(k % 5 == 1, 1).cast("double").alias("batch"), F.col("c_mktsegment").alias("segment"))


#: lineitem with gaps, a copied, a constant and an almost constant column.
WIDE_COLUMNS = ["qty", "price", "discount", "tax", "tax_copy", "price2", "flag", "same", "rare", "gaps"]
WIDE = """SELECT l_quantity AS qty, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_tax AS tax_copy,
  2 * l_extendedprice + 1 AS price2, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS flag, 5.0 AS same,
  CASE WHEN l_orderkey % 1000 = 7 THEN 1.0 ELSE 0.0 END AS rare, CASE WHEN l_linenumber <= 3 THEN NULL ELSE l_tax END AS gaps FROM lineitem"""


def wide(spark: SparkSession, sf: str) -> DataFrame:
    tax = F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), tax.alias("tax"), tax.alias("tax_copy"),
        (2 * F.col("l_extendedprice") + 1).alias("price2"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("flag"), F.lit(5.0).alias("same"),
        F.when(F.col("l_orderkey") % 1000 == 7, 1.0).otherwise(0.0).alias("rare"), F.when(F.col("l_linenumber") <= 3, None).otherwise(tax).alias("gaps"),
    )


UNPIVOT = " UNION ALL ".join(f"SELECT '{c}' AS descriptor, {c}::DOUBLE AS value FROM w" for c in WIDE_COLUMNS)
LONG = f"WITH w AS ({WIDE}), u AS ({UNPIVOT})"
MODAL = """, mc AS (SELECT descriptor, value, count(*) AS c FROM u WHERE value IS NOT NULL GROUP BY ALL),
  modal AS (SELECT descriptor, sum(c)::BIGINT AS n, count(*) AS n_distinct, max(c)::DOUBLE / sum(c) AS top_share FROM mc GROUP BY 1)"""
ROBUST = """, rq AS (SELECT descriptor, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM u GROUP BY 1),
  robust AS (SELECT *, q3 - q1 AS iqr, CASE WHEN abs(median) + q3 - q1 <= 1e-9 THEN 0.0 ELSE (q3 - q1) / (abs(median) + q3 - q1) END AS rel FROM rq)"""


@register("csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_scan(spark, sf):
    """A CSV round trip with an explicit schema."""
    from ..session import Scratch
    from ..sources.files import read_csv, write_csv

    path = f"{Scratch(spark, 'csv').root}/nation"
    df = table(spark, sf, "nation")
    write_csv(df, path)
    return read_csv(spark, path, schema=df.schema)


@register("labeled_rows", f"SELECT row_id, batch FROM ({AL}) WHERE batch IS NOT NULL")
def labeled_rows(spark, sf):
    return hygiene.labeled(al_table(spark, sf)).select("row_id", "batch")


@register("pool_rows", f"SELECT row_id FROM ({AL}) WHERE batch IS NULL")
def pool_rows(spark, sf):
    return hygiene.pool(al_table(spark, sf)).select("row_id")


@register("document_pool", "SELECT d.doc_id, l.quality::DOUBLE AS y, (CASE WHEN l.quality IS NOT NULL THEN 0 END)::DOUBLE AS batch FROM documents d LEFT JOIN labels l USING (doc_id)")
def document_pool(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", F.col("quality").cast("double").alias("y"), F.when(F.col("quality").isNotNull(), 0).cast("double").alias("batch"))


@register("valid_targets", f"SELECT row_id, y FROM ({AL}) WHERE y IS NOT NULL AND trim(y::VARCHAR) <> ''")
def valid_targets(spark, sf):
    return al_table(spark, sf).where(S.is_labeled(F.col("y"))).select("row_id", "y")


@register("last_batch_complete", f"SELECT batch, bool_and(y IS NOT NULL) AS complete FROM ({AL}) WHERE batch IS NOT NULL GROUP BY batch ORDER BY batch DESC LIMIT 1")
def last_batch_complete(spark, sf):
    return hygiene.last_batch_complete(al_table(spark, sf), "y")


@register("orphan_targets", f"SELECT row_id, y FROM ({AL}) WHERE y IS NOT NULL AND batch IS NULL")
def orphan_targets(spark, sf):
    return hygiene.orphan_targets(al_table(spark, sf), "y").select("row_id", "y")


@register("seed_rows", f"SELECT row_id FROM ({AL}) WHERE batch = 0")
def seed_rows(spark, sf):
    return hygiene.seed_set(al_table(spark, sf)).select("row_id")


@register("next_batch", f"SELECT (max(batch) + 1)::INT AS next_batch, false AS bootstrap FROM ({AL})")
def next_batch(spark, sf):
    return hygiene.next_batch(al_table(spark, sf), "y")


@register("lenient_cast", "SELECT c_custkey, try_cast(CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE c_mktsegment END AS DOUBLE) AS number FROM customer")
def lenient_cast(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.to_number(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("c_mktsegment"))).alias("number"))


@register("finite_rows", "SELECT count(*) AS n, round(sum(x), 2) AS total FROM (SELECT CASE WHEN l_linenumber = 1 THEN 'NaN'::DOUBLE WHEN l_linenumber = 2 THEN 'Infinity'::DOUBLE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS x FROM lineitem) WHERE x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x)")
def finite_rows(spark, sf):
    n = F.col("l_linenumber")
    x = F.when(n == 1, F.lit(float("nan"))).when(n == 2, F.lit(float("inf"))).when(n == 3, None).otherwise(F.col("l_quantity"))
    return table(spark, sf, "lineitem").select(x.alias("x")).where(S.is_finite(F.col("x"))).agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"))


@register("drop_null_keys", f"SELECT row_id, y FROM ({AL}) WHERE y IS NOT NULL")
def drop_null_keys(spark, sf):
    return al_table(spark, sf).dropna(subset=["y"]).select("row_id", "y")


@register("fill_in", f"SELECT row_id, coalesce(y, m) AS y, batch, segment FROM ({AL}), (SELECT round(avg(y), 6) AS m FROM ({AL}))")
def fill_in(spark, sf):
    df = al_table(spark, sf)
    mean = df.agg(F.round(F.avg("y"), 6).alias("m"))
    return hygiene.fill_in(df, df.select("row_id").crossJoin(F.broadcast(mean)).withColumnRenamed("m", "y"), "row_id", ["y"])


@register("assign_batch", f"SELECT row_id, CASE WHEN batch IS NULL AND row_id % 10 = 3 THEN 2 ELSE batch END AS batch FROM ({AL})")
def assign_batch(spark, sf):
    df = al_table(spark, sf)
    return hygiene.assign_batch(df, df.where("row_id % 10 = 3"), 2, "row_id").select("row_id", F.col("batch").cast("double").alias("batch"))


@register("full_row_dedup", "SELECT DISTINCT n_nationkey, n_name, n_regionkey FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey % 2 = 0)")
def full_row_dedup(spark, sf):
    n = table(spark, sf, "nation").withColumn("row_id", F.col("n_nationkey"))
    twice = n.unionByName(n.where("n_nationkey % 2 = 0").withColumn("row_id", F.col("row_id") + 1000))
    return hygiene.dedup_rows(twice, ["row_id"], ["n_nationkey", "n_name", "n_regionkey"]).drop("row_id")


@register("duplicate_keys", "SELECT l_orderkey, l_linenumber, l_partkey, copies FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem) WHERE copies > 1")
def duplicate_keys(spark, sf):
    return hygiene.duplicate_keys(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


@register("canonical_dedup", "SELECT canon, min(p_partkey) AS p_partkey FROM (SELECT *, lower(trim(p_brand || ' ' || p_type)) AS canon FROM part) GROUP BY 1")
def canonical_dedup(spark, sf):
    p = table(spark, sf, "part").withColumn("canon", F.lower(F.trim(F.concat_ws(" ", "p_brand", "p_type"))))
    return hygiene.dedup_rows(p, ["p_partkey"], ["canon"]).select("canon", "p_partkey")


@register("ordered_distinct", "SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1")
def ordered_distinct(spark, sf):
    return hygiene.ordered_distinct(table(spark, sf, "lineitem"), "l_partkey", "l_orderkey")


@register("duplicate_columns", "SELECT 'tax_copy' AS removed")
def duplicate_columns(spark, sf):
    return spark.createDataFrame([(c,) for c in hygiene.duplicate_columns(wide(spark, sf), WIDE_COLUMNS)], "removed string")


@register("positional_attach", "SELECT o_orderkey AS row_id, o_totalprice, round(q, 2) AS quantity FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def positional_attach(spark, sf):
    q = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return hygiene.attach(table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice"), q)


@register("remaining_ids", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def remaining_ids(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").join(table(spark, sf, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@register("membership_flag", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS selected FROM customer")
def membership_flag(spark, sf):
    s = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k")).distinct()
    return table(spark, sf, "customer").join(s, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.col("k").isNotNull().alias("selected"))


@register("missing_fraction", f"{LONG} SELECT descriptor, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM u GROUP BY 1")
def missing_fraction(spark, sf):
    return stats.missing_fraction(wide(spark, sf), WIDE_COLUMNS).withColumn("missing", F.round("missing", 6))


@register("modal_share", f"{LONG}{MODAL} SELECT descriptor, n, n_distinct, round(top_share, 6) AS top_share FROM modal")
def modal_share(spark, sf):
    return stats.modal_share(wide(spark, sf), WIDE_COLUMNS).withColumn("top_share", F.round("top_share", 6))


@register("constant_columns", f"{LONG}{MODAL} SELECT descriptor, CASE WHEN n_distinct <= 1 THEN 'constant' ELSE 'near_constant' END AS reason FROM modal WHERE n_distinct <= 1 OR top_share >= 0.98")
def constant_columns(spark, sf):
    m = stats.modal_share(wide(spark, sf), WIDE_COLUMNS).where("n_distinct <= 1 or top_share >= 0.98")
    return m.select("descriptor", F.when(F.col("n_distinct") <= 1, "constant").otherwise("near_constant").alias("reason"))


@register("robust_stats", f"{LONG}{ROBUST} SELECT descriptor, round(sd, 6) AS sd, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(rel, 6) AS rel FROM robust")
def robust_stats(spark, sf):
    return stats.robust_stats(wide(spark, sf), WIDE_COLUMNS).select("descriptor", *[F.round(c, 6).alias(c) for c in ("sd", "q1", "median", "q3", "iqr", "rel")])


@register("low_variance", f"""{LONG}{MODAL}{ROBUST}, i AS (SELECT descriptor, CASE WHEN n_distinct <= 2 THEN 'binary' ELSE 'continuous' END AS kind, CASE WHEN n_distinct <= 2 THEN 1 - top_share ELSE rel END AS score, iqr FROM modal JOIN robust USING (descriptor))
  SELECT descriptor, kind, round(score, 6) AS score, CASE WHEN kind = 'binary' AND score < 0.05 THEN 'binary' WHEN kind = 'continuous' AND iqr < 1e-6 THEN 'iqr' WHEN kind = 'continuous' AND score < 0.02 THEN 'relative' END AS rule FROM i""")
def low_variance(spark, sf):
    return stats.low_variance(wide(spark, sf), WIDE_COLUMNS).withColumn("score", F.round("score", 6))


NUMERIC = ["qty", "price", "discount", "tax", "price2", "flag"]


@register("pearson", f"WITH w AS ({WIDE}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 6) AS r FROM w" for j, b in enumerate(NUMERIC) for a in NUMERIC[:j]))
def pearson(spark, sf):
    return stats.correlations(wide(spark, sf), NUMERIC).withColumn("r", F.round("r", 6))


@register("correlated_columns", f"WITH w AS ({WIDE}), s AS (SELECT (SELECT (q3 - q1) / (abs(m) + q3 - q1) FROM (SELECT quantile_cont(price, 0.25) AS q1, median(price) AS m, quantile_cont(price, 0.75) AS q3 FROM w)) AS a, (SELECT (q3 - q1) / (abs(m) + q3 - q1) FROM (SELECT quantile_cont(price2, 0.25) AS q1, median(price2) AS m, quantile_cont(price2, 0.75) AS q3 FROM w)) AS b) SELECT CASE WHEN a < b - 1e-9 THEN 'price' ELSE 'price2' END AS removed FROM s")
def correlated_columns(spark, sf):
    return spark.createDataFrame([(c,) for c in stats.correlated_columns(wide(spark, sf), NUMERIC)], "removed string")


@register("clean_columns", f"""{LONG}{MODAL}{ROBUST}, k AS (SELECT *, CASE WHEN n_distinct <= 2 THEN 1 - top_share ELSE rel END AS score FROM modal JOIN robust USING (descriptor)),
  v AS (SELECT descriptor, CASE WHEN (SELECT avg((value IS NULL)::INT) FROM u WHERE u.descriptor = k.descriptor) > 0.30 THEN 'missing' WHEN n_distinct <= 1 THEN 'constant' WHEN top_share >= 0.98 THEN 'near_constant' WHEN descriptor = 'tax_copy' THEN 'duplicate'
    WHEN n_distinct <= 2 AND score < 0.05 THEN 'low_variance' WHEN n_distinct > 2 AND (iqr < 1e-6 OR score < 0.02) THEN 'low_variance' ELSE 'kept' END AS verdict, score FROM k),
  c AS (SELECT abs(corr(price, price2)) AS r FROM w)
  SELECT descriptor, CASE WHEN verdict = 'kept' AND (SELECT r FROM c) >= 0.95 AND descriptor = (SELECT CASE WHEN a.score < b.score - 1e-9 THEN 'price' ELSE 'price2' END FROM v a, v b WHERE a.descriptor = 'price' AND b.descriptor = 'price2') THEN 'correlated' ELSE verdict END AS verdict FROM v""")
def clean_columns(spark, sf):
    """The whole cleaning, in its order: what stays, and why the rest goes."""
    _, _, why = stats.clean_columns(wide(spark, sf), WIDE_COLUMNS)
    return spark.createDataFrame([(c, why.get(c, "kept")) for c in WIDE_COLUMNS], "descriptor string, verdict string")


@register("all_equal_guard", "SELECT count(DISTINCT l_linenumber) = 1 AS stop FROM lineitem")
def all_equal_guard(spark, sf):
    return acquisition.all_equal(table(spark, sf, "lineitem"), "l_linenumber")


@register("one_hot", "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{s}' THEN 1.0 ELSE 0.0 END AS \"c_mktsegment_{s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def one_hot(spark, sf):
    return encode.one_hot(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])[0]


@register("ordinal_codes", "SELECT c_custkey, coalesce(code, -1)::DOUBLE AS seg FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer) LEFT JOIN (SELECT DISTINCT seg, dense_rank() OVER (ORDER BY seg) - 1 AS code FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer) WHERE seg IS NOT NULL) USING (seg)")
def ordinal_codes(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_mktsegment")).alias("seg"))
    return encode.ordinal(df, "seg")


@register("standardize", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) + 0.0 AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) + 0.0 AS p_retailprice FROM part")
def standardize(spark, sf):
    z = encode.standardize(table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"])
    return z.select("p_partkey", *[(F.round(c, 6) + 0.0).alias(c) for c in ("p_size", "p_retailprice")])


@register("knn_impute", """WITH x AS (SELECT s_suppkey AS id, s_nationkey::DOUBLE AS a, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE s_acctbal END AS b FROM supplier),
  p AS (SELECT g.id, d.b, row_number() OVER (PARTITION BY g.id ORDER BY sqrt((g.a - d.a) * (g.a - d.a) * 2.0), d.id) AS rn FROM x g JOIN x d ON g.id <> d.id WHERE g.b IS NULL AND d.b IS NOT NULL),
  m AS (SELECT id, avg(b) AS m FROM p WHERE rn <= 5 GROUP BY 1)
  SELECT x.id, a, round(coalesce(x.b, m.m), 6) AS b FROM x LEFT JOIN m USING (id)""")
def knn_impute(spark, sf):
    df = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("double").alias("a"), F.when(F.col("s_suppkey") % 10 == 0, None).otherwise(F.col("s_acctbal")).alias("b"))
    return encode.knn_impute(df, "id", ["a", "b"]).withColumn("b", F.round("b", 6))


@register("union_all", "SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1")
def union_all(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).unionByName(table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k")))


@register("intersect_ids", "SELECT o_orderkey AS k FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def intersect_ids(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).intersect(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")))


@register("union_distinct", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 0")
def union_distinct(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k"))).distinct()


@register("except_ids", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def except_ids(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).exceptAll(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct())


def _placed(df: DataFrame, name: str = "place") -> DataFrame:
    """Rows numbered from 1 in the order that they have."""
    return with_row_id(df, None, name).withColumn(name, F.col(name) + 1)


@register("sort_batch_last", f"SELECT row_id, batch, row_number() OVER (ORDER BY batch DESC NULLS LAST, row_id) AS place FROM ({AL})")
def sort_batch_last(spark, sf):
    return _placed(hygiene.sort_by_batch(al_table(spark, sf).select("row_id", "batch"), "row_id", latest_first=True))


@register("sort_batch_first", f"SELECT row_id, batch, row_number() OVER (ORDER BY batch NULLS LAST, row_id) AS place FROM ({AL})")
def sort_batch_first(spark, sf):
    return _placed(hygiene.sort_by_batch(al_table(spark, sf).select("row_id", "batch"), "row_id"))


@register("argmin_argmax", "SELECT o_custkey, arg_min(o_orderkey, o_totalprice) AS cheapest, arg_max(o_orderkey, o_totalprice) AS dearest FROM orders GROUP BY 1")
def argmin_argmax(spark, sf):
    t = table(spark, sf, "orders")
    return t.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("dearest"))


@register("cumulative_rank", f"SELECT row_id, row_number() OVER (ORDER BY row_id) AS rank FROM ({AL}) WHERE batch = 0")
def cumulative_rank(spark, sf):
    return with_row_id(hygiene.seed_set(al_table(spark, sf)).select("row_id"), ["row_id"], "rank").withColumn("rank", F.col("rank") + 1)


@register("base_names", "SELECT n_nationkey, CASE WHEN regexp_matches(f, '^.*_b[0-9]+$') THEN regexp_extract(f, '^(.*)_b([0-9]+)$', 1) ELSE f END AS base FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) || '_b' || n_nationkey ELSE lower(n_name) END AS f FROM nation)")
def base_names(spark, sf):
    f = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lower("n_name"), F.lit("_b"), F.col("n_nationkey").cast("string"))).otherwise(F.lower("n_name"))
    return table(spark, sf, "nation").select("n_nationkey", S.base_name(f).alias("base"))


@register("table_text", "SELECT p_partkey, rpad(CASE WHEN length(p_name) > 12 THEN substring(p_name, 1, 9) || '...' ELSE p_name END, 12, ' ') AS name, lpad(p_size::VARCHAR, 6, ' ') AS size FROM part")
def table_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.cell_text(F.col("p_name"), 12).alias("name"), S.cell_text(F.col("p_size"), 6, right=True).alias("size"))


@register("half_even", "SELECT l_linenumber, round_even(sum(l_quantity) / 8, 0) AS q FROM lineitem GROUP BY 1")
def half_even(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.bround(F.sum("l_quantity") / 8, 0).alias("q"))


REPORT = "'Test : R2 = 0.9, MAE = 0.1, RMSE = ' || (n_nationkey + 0.5) || chr(10) || 'Score ' || (n_nationkey % 10) || chr(10) || 'high variation, 4*SD = ' || (n_nationkey + 1)"


@register("report_metrics", f"""SELECT n_nationkey, coalesce(try_cast(regexp_extract(t, 'Test : .*RMSE = ([0-9]+[.]?[0-9]*)', 1) AS DOUBLE), try_cast(regexp_extract(t, 'Valid[.] : .*RMSE = ([0-9]+[.]?[0-9]*)', 1) AS DOUBLE)) AS rmse,
  try_cast(regexp_extract(t, 'Score ([0-9]+)', 1) AS DOUBLE) AS score, try_cast(regexp_extract(t, '4[*]SD = ([0-9]+[.]?[0-9]*)', 1) AS DOUBLE) / 4 AS sd
  FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN replace({REPORT}, 'Test', 'Valid.') WHEN n_nationkey % 7 = 0 THEN 'nothing' ELSE {REPORT} END AS t FROM nation)""")
def report_metrics(spark, sf):
    n = F.col("n_nationkey")
    text = F.concat(F.lit("Test : R2 = 0.9, MAE = 0.1, RMSE = "), (n + 0.5).cast("string"), F.lit("\nScore "), (n % 10).cast("string"), F.lit("\nhigh variation, 4*SD = "), (n + 1).cast("string"))
    t = F.when(n % 3 == 0, F.replace(text, F.lit("Test"), F.lit("Valid."))).when(n % 7 == 0, "nothing").otherwise(text)
    return table(spark, sf, "nation").select("n_nationkey", t.alias("t")).select("n_nationkey", S.report_rmse(F.col("t")).alias("rmse"), S.report_score(F.col("t")).cast("double").alias("score"), S.report_sd(F.col("t")).alias("sd"))


@register("point_counts", "SELECT o_orderpriority AS model, count(*) FILTER (WHERE o_orderstatus = 'F') AS training, count(*) FILTER (WHERE o_orderstatus = 'O') AS test FROM orders GROUP BY 1")
def point_counts(spark, sf):
    from ..sources.files import point_counts as count

    t = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("model"), F.when(F.col("o_orderstatus") == "F", "Training").when(F.col("o_orderstatus") == "O", "Test").alias("Set"))
    return count(t, ["model"])


@register("json_lists", "SELECT region, count(*) AS n, to_json(list({'id': s_suppkey, 'x': s_acctbal} ORDER BY s_suppkey)) AS points FROM (SELECT *, s_nationkey % 5 AS region FROM supplier) GROUP BY 1")
def json_lists(spark, sf):
    t = table(spark, sf, "supplier").withColumn("region", F.col("s_nationkey") % 5)
    p = F.sort_array(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"))))
    return t.groupBy("region").agg(F.count("*").alias("n"), F.to_json(p).alias("points"))


@register("batch_directories", "SELECT batch, count(*) AS n FROM (SELECT c_custkey % 4 AS batch FROM customer) WHERE batch > 0 GROUP BY 1")
def batch_directories(spark, sf):
    """A dataset partitioned by batch, written and scanned again without batch 0."""
    from ..session import Scratch
    from ..sources.files import scan_batches, write_batches

    path = f"{Scratch(spark, 'batches').root}/customers"
    write_batches(table(spark, sf, "customer").withColumn("batch", (F.col("c_custkey") % 4).cast("int")), path)
    return scan_batches(spark, path).groupBy(F.col("batch").cast("long").alias("batch")).agg(F.count("*").alias("n"))


@register("batch_file", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def batch_file(spark, sf):
    """A CSV that lies in a batch folder, found by its name and scanned."""
    from ..session import Scratch
    from ..sources.files import find_batch_file, read_csv, write_csv

    root = Scratch(spark, "found").root
    df = table(spark, sf, "nation")
    for k in (10, 2):
        write_csv(df if k == 2 else df.limit(0), f"{root}/batch_{k}/nation.csv")
    return read_csv(spark, find_batch_file(spark, root, "nation.csv"), schema=df.schema).groupBy("n_regionkey").agg(F.count("*").alias("n"))
