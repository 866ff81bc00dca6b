"""Rules that the driver applies to names, options and single numbers, shown over many inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hygiene, search, stats
from ..operators import vectors as V
from .registry import register, table


@register("resolved_columns", "SELECT n_nationkey::INT AS id, CASE WHEN n_nationkey % 3 = 2 THEN 'missing' ELSE 'c_name' END AS found FROM nation")
def resolved_columns(spark, sf):
    """A column by its name in any case; a name that isn't there is an error."""
    df, out = table(spark, sf, "customer"), []
    for r in table(spark, sf, "nation").select("n_nationkey").collect():
        try:
            out.append((r[0], hygiene.resolve_column(df, ("c_name", "C_NAME", "c_named")[r[0] % 3])))
        except hygiene.MissingColumn:
            out.append((r[0], "missing"))
    return spark.createDataFrame(out, "id int, found string")


@register("column_roles", "SELECT column_name AS name, CASE WHEN column_name IN ('c_custkey', 'c_comment') THEN 'metadata' ELSE 'descriptor' END AS role FROM (DESCRIBE customer)")
def column_roles(spark, sf):
    """Ignored columns that exist, once each, and the rest."""
    df = table(spark, sf, "customer")
    meta, rest = hygiene.split_columns(df, hygiene.sanitize_ignore(df, ["c_comment", "c_custkey", "nope", "c_custkey"] if "c_comment" in df.columns else ["c_custkey", "nope"]))
    return spark.createDataFrame([(c, "metadata") for c in meta] + [(c, "descriptor") for c in rest], "name string, role string")


@register("batch_column_last", "SELECT * FROM (VALUES (1::BIGINT, 'row_id'), (2, 'y'), (3, 'segment'), (4, 'batch')) t(place, name)")
def batch_column_last(spark, sf):
    from .table_queries import al_table

    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(hygiene.batch_last(al_table(spark, sf)).columns)], "place long, name string")


@register("coverage_words", "SELECT n_nationkey::INT AS id, CASE WHEN n_nationkey % 12 = 11 THEN 'unavailable' WHEN 0.6 + n_nationkey * 0.02 >= 0.85 AND 0.3 + (n_nationkey % 9) * 0.1 >= 0.65 THEN 'broad' WHEN 0.6 + n_nationkey * 0.02 >= 0.75 AND 0.3 + (n_nationkey % 9) * 0.1 >= 0.45 THEN 'moderate' ELSE 'limited' END AS verdict FROM nation")
def coverage_words(spark, sf):
    keys = [r[0] for r in table(spark, sf, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame([(k, V.interpret_coverage(None if k % 12 == 11 else round(0.6 + k * 0.02, 6), round(0.3 + k % 9 * 0.1, 6))) for k in keys], "id int, verdict string")


@register("explained_components", """WITH r AS (SELECT s.n_regionkey AS id, row_number() OVER (PARTITION BY s.n_regionkey ORDER BY s.n_nationkey) AS place, 1.0 / pow(2, row_number() OVER (PARTITION BY s.n_regionkey ORDER BY s.n_nationkey)) AS ratio FROM nation s),
  c AS (SELECT id, place, sum(ratio) OVER (PARTITION BY id ORDER BY place) AS upto FROM r) SELECT id::INT AS id, coalesce(min(place) FILTER (WHERE upto >= 0.5 + id * 0.1 - 1e-12), max(place))::INT AS components FROM c GROUP BY 1""")
def explained_components(spark, sf):
    """How many components reach a share of the variance, each explaining half as much as the one before; a target for each region."""
    sizes = {r[0]: r[1] for r in table(spark, sf, "nation").groupBy("n_regionkey").count().collect()}
    return spark.createDataFrame([(k, stats.explained_components([0.5 ** (i + 1) for i in range(n)], 0.5 + k * 0.1)) for k, n in sizes.items()], "id int, components int")


@register("option_ranges", "SELECT n_nationkey::INT AS id, CASE WHEN n_nationkey * 0.1 <= 1.0 THEN n_nationkey * 0.1 ELSE 0.3 END::DOUBLE AS missing, CASE WHEN n_nationkey % 2 = 0 THEN 'exploratory' ELSE 'representative' END AS mode, CASE WHEN n_nationkey % 3 = 0 THEN 'a|b' ELSE '' END AS ignored FROM nation")
def option_ranges(spark, sf):
    """Options from texts: what is out of range takes its default, lists are read with or without brackets."""
    from ..__main__ import options_of
    from ..config import ClusterOptions

    out = []
    for r in table(spark, sf, "nation").select("n_nationkey").collect():
        k = r[0]
        o = options_of(ClusterOptions, {"missing": f"{k / 10}", "mode": "exploratory" if k % 2 == 0 else "else"} | ({"ignore": "[a, b]" if k % 2 else "a,b"} if k % 3 == 0 else {}))
        out.append((k, o.missing, o.mode, "|".join(o.ignore)))
    return spark.createDataFrame(out, "id int, missing double, mode string, ignored string")


@register("early_stop", """WITH g AS (SELECT (20 + 10 * n_nationkey)::INT AS size, round(1 / (1 + n_nationkey * 0.02), 6) AS gap FROM nation), w AS (SELECT *, lead(size, 1) OVER o AS s1, lead(size, 2) OVER o AS s2, lead(gap, 1) OVER o AS p1, lead(gap, 2) OVER o AS p2 FROM g WINDOW o AS (ORDER BY size))
  SELECT min(size)::INT AS size FROM w WHERE s2 IS NOT NULL AND (gap - p1) / gap < 0.005 * (s1 - size) AND (gap - p2) / gap < 0.005 * (s2 - size)""")
def early_stop(spark, sf):
    """The budget scan of a large table, which stops at the first accepted budget with both successors known."""
    from .search_queries import gaps

    gap = {r["size"]: r.gap for r in gaps(spark, sf).collect()}
    best, _ = search.auto_budget(20_000, lambda k: search.Budget(k, gap[k]), sorted(gap))
    return spark.createDataFrame([(best.size,)], "size int").where(F.col("size") > 0)
