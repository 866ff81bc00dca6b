"""Statistics of columns: one aggregation over the table, or one over its unpivoted columns."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import ship

#: Rows by which quantiles are bracketed.
SAMPLE = 20_000


def unpivot(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep..., descriptor, value) with doubles."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keep), columns, "descriptor", "value")


def missing_fraction(df: DataFrame, columns: list[str]) -> DataFrame:
    return unpivot(df, columns).groupBy("descriptor").agg(F.avg(F.col("value").isNull().cast("double")).alias("missing"))


def modal_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """(descriptor, n, n_distinct, top_share): of the values that are there, how many and the most frequent one's share."""
    counts = unpivot(df, columns).where("value is not null").groupBy("descriptor", "value").agg(F.count("*").alias("c"))
    return counts.groupBy("descriptor").agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), (F.max("c") / F.sum("c")).alias("top_share"))


def quantiles(df: DataFrame, columns: list[str], probs: tuple[float, ...] = (0.25, 0.5, 0.75), sample: int = SAMPLE) -> tuple[dict[str, list[float | None]], dict[str, float | None]]:
    """Exact quantiles with linear interpolation, without gathering a column's values in one place; and population standard deviations.

    A sample of about ``sample`` rows brackets each quantile, the rows below and up to the brackets are counted, and only values inside, by distinct
    value, are put in order: a few hundredths of the rows. A bracket that the counts refute becomes the whole range, so the sample changes no result.
    """
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    first = df.agg(*[F.struct(F.count(x[c]).alias("n"), F.min(x[c]).alias("lo"), F.max(x[c]).alias("hi"), F.stddev_pop(x[c]).alias("sd")).alias(f"c{i}") for i, c in enumerate(columns)], F.count(F.lit(1)).alias("rows")).first()
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    sds = {c: first[i].sd for i, c in enumerate(columns)}
    drawn = df.select(*[x[c].alias(f"c{i}") for i, c in enumerate(columns)]).sample(sample / first.rows, seed=7).toPandas() if first.rows > 2 * sample else None
    cells = []  # column, quantile, bracket, the two ranks and the weight of the second
    for i in range(len(columns)):
        r, values = first[i], None if drawn is None else drawn[f"c{i}"].dropna().to_numpy()
        for j, p in enumerate(probs):
            if r.n:
                at, low, high = (r.n - 1) * p, r.lo, r.hi
                if values is not None and len(values) >= 1000:
                    margin = 2.5 / math.sqrt(len(values))
                    low, high = (v if 0 < q < 1 else e for q, v, e in zip((p - margin, p + margin), np.quantile(values, np.clip((p - margin, p + margin), 0, 1)), (r.lo, r.hi), strict=True))
                cells.append([i, j, float(low), float(high), math.floor(at), math.ceil(at), at - math.floor(at)])
    if not cells:
        return out, sds
    counted = df.agg(*[f for k, (i, _, low, high, *_) in enumerate(cells) for f in (F.count_if(x[columns[i]] < low).alias(f"b{k}"), F.count_if(x[columns[i]] <= high).alias(f"u{k}"))]).first()
    below = []
    for k, c in enumerate(cells):
        fits = counted[2 * k] <= c[4] and counted[2 * k + 1] > c[5]
        below.append(counted[2 * k] if fits else 0)
        if not fits:
            c[2], c[3] = first[c[0]].lo, first[c[0]].hi
        if c[2] == c[3]:  # a bracket of one value, as columns of few values have: that is the quantile
            out[columns[c[0]]][c[1]] = c[2]
    wide = [(k, c) for k, c in enumerate(cells) if c[2] < c[3]]
    if not wide:
        return out, sds
    of = {i: [c for _, c in wide if c[0] == i] for i in {c[0] for _, c in wide}}
    kept = [F.when(reduce(lambda a, b: a | b, [x[columns[i]].between(c[2], c[3]) for c in mine]), F.struct(F.lit(i).alias("i"), x[columns[i]].alias("v"))) for i, mine in of.items()]
    counts = df.select(F.explode(F.array(*kept)).alias("e")).where("e is not null").groupBy("e.i", "e.v").agg(F.count("*").alias("n"))
    # One row a quantile: a few dozen, so they may be broadcast.
    brackets = df.sparkSession.createDataFrame([(k, c[0], c[2], c[3], below[k], c[4], c[5]) for k, c in wide], "k int, i int, low double, high double, below long, r0 long, r1 long")
    inside = counts.join(F.broadcast(brackets), "i").where(F.col("v").between(F.col("low"), F.col("high")))
    upto = inside.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy("k").orderBy("v")))
    for r in upto.groupBy("k").agg(*[F.min(F.when(F.col("upto") > F.col(f"r{a}"), F.col("v"))).alias(f"v{a}") for a in (0, 1)]).collect():
        i, j, *_, part = cells[r.k]
        out[columns[i]][j] = r.v0 if part == 0 else r.v0 + (r.v1 - r.v0) * part
    return out, sds


def robust_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(descriptor, sd, q1, median, q3, iqr, rel): rel = iqr / (|median| + iqr), 0 where that is 0."""
    q, sd = quantiles(df, columns)
    s = df.sparkSession.createDataFrame([(c, sd[c], *q[c]) for c in columns], "descriptor string, sd double, q1 double, median double, q3 double").withColumn("iqr", F.col("q3") - F.col("q1"))
    base = F.abs("median") + F.col("iqr")
    return s.withColumn("rel", F.when(base <= 1e-9, 0.0).otherwise(F.try_divide("iqr", base)))


def informativeness(df: DataFrame, columns: list[str], modal: DataFrame | None = None) -> DataFrame:
    """(descriptor, kind, score, iqr): binary columns score 1 - modal share, others the relative spread. ``modal``: the modal shares, if they are known."""
    m, r = modal or modal_share(df, columns), robust_stats(df, columns)
    binary = F.col("n_distinct") <= 2
    return m.join(r, "descriptor").select("descriptor", F.when(binary, "binary").otherwise("continuous").alias("kind"), F.when(binary, 1 - F.col("top_share")).otherwise(F.col("rel")).alias("score"), "iqr", "n_distinct", "top_share")


def low_variance(df: DataFrame, columns: list[str], binary: float = 0.05, iqr: float = 1e-6, rel: float = 0.02, modal: DataFrame | None = None) -> DataFrame:
    """(descriptor, kind, score, rule): the rule by which a column goes, NULL if it stays."""
    i = informativeness(df, columns, modal)
    rule = F.when((F.col("kind") == "binary") & (F.col("score") < binary), "binary").when((F.col("kind") == "continuous") & (F.col("iqr") < iqr), "iqr").when((F.col("kind") == "continuous") & (F.col("score") < rel), "relative")
    return i.select("descriptor", "kind", "score", rule.alias("rule"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): absolute Pearson correlation of each pair over rows that have both; NULL where one of them doesn't vary.

    Each task sums p by p moments over its Arrow batches, around the columns' means, and counts each pair's rows; the tasks' sums are
    added column by column, in parallel.
    """
    spark, p = df.sparkSession, len(columns)
    if p < 2:
        return spark.createDataFrame([], "a string, b string, r double")
    ship(spark)
    means = df.agg(*[F.avg(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    centre = np.array([m or 0.0 for m in means], np.float64)
    names = ("n", "sa", "sb", "qa", "qb", "ab")

    def part(batches):
        total = np.zeros((6, p, p))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in b.columns], 1) - centre
            m = (~np.isnan(x)).astype(np.float64)
            x = np.where(m > 0, x, 0)
            s, q = x.T @ m, (x * x).T @ m  # of the row's column, over rows that have the other too
            total += np.stack((m.T @ m, s, s.T, q, q.T, x.T @ x))
        j = np.arange(1, p)
        yield pa.RecordBatch.from_pydict({"j": pa.array(j.astype(np.int32))} | {k: pa.array([total[i, :c, c].tolist() for c in j], pa.list_(pa.float64())) for i, k in enumerate(names)})

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        n, sa, sb, qa, qb, ab = (np.sum(np.stack(rows[k].to_list()), 0) for k in names)
        j = int(rows["j"].iloc[0])
        with np.errstate(divide="ignore", invalid="ignore"):
            va, vb = qa - sa * sa / n, qb - sb * sb / n
            r = np.abs((ab - sa * sb / n) / np.sqrt(va * vb))
        still = (va <= 1e-14 * qa) | (vb <= 1e-14 * qb)
        return pd.DataFrame({"a": columns[:j], "b": columns[j], "r": np.where(still | ~np.isfinite(r), np.nan, np.minimum(r, 1.0))})

    moments = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(part, "j int, " + ", ".join(f"{k} array<double>" for k in names))
    out = moments.groupBy("j").applyInPandas(pairs, "a string, b string, r double")
    return out.withColumn("r", F.nanvl("r", F.lit(None).cast("double")))


def correlated_columns(df: DataFrame, columns: list[str], limit: float = 0.95, score: dict[str, float] | None = None) -> list[str]:
    """Columns to remove: pairs in order, the one of lower informativeness goes, the later one if they are equal. ``score``: the informativeness, if it is known."""
    place = {c: i for i, c in enumerate(columns)}
    pairs = sorted((place[r.a], place[r.b]) for r in correlations(df, columns).where(F.col("r") >= limit).collect())
    if not pairs:
        return []
    score = score or {r.descriptor: r.score for r in informativeness(df, columns).collect()}
    gone: set[int] = set()
    for i, j in pairs:
        if i in gone or j in gone:
            continue
        a, b = score[columns[i]], score[columns[j]]
        gone.add(i if a < b - 1e-9 else j)
    return [columns[i] for i in sorted(gone)]


def clean_columns(df: DataFrame, columns: list[str], missing: float = 0.30, near_constant: float = 0.98, correlation: float = 0.95, after_missing=None) -> tuple[DataFrame, list[str], dict[str, str]]:
    """The table, the columns that stay and why the others go, in the order of the cleaning rules.

    ``after_missing(df, columns) -> (df, columns)`` encodes and imputes once the emptiest columns are gone.
    """
    from .hygiene import TooFewColumns, duplicate_columns

    why: dict[str, str] = {}

    def drop(names: list[str], reason: str) -> None:
        nonlocal columns
        why.update(dict.fromkeys(names, reason))
        columns = [c for c in columns if c not in names]

    empty = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    drop([c for c, x in zip(columns, empty, strict=True) if x is not None and x > missing], "missing")
    if after_missing:
        df, columns = after_missing(df, columns)
    stats = {r.descriptor: r for r in modal_share(df, columns).collect()}
    drop([c for c in columns if c not in stats or stats[c].n_distinct <= 1], "constant")
    drop([c for c in columns if stats[c].top_share >= near_constant], "near_constant")
    drop(duplicate_columns(df, columns), "duplicate")
    # Modal shares and quantiles are the dear part: each is taken once, and used by all the rules.
    modal = df.sparkSession.createDataFrame([tuple(stats[c]) for c in columns], "descriptor string, n long, n_distinct long, top_share double")
    low = low_variance(df, columns, modal=modal).collect() if columns else []
    drop([r.descriptor for r in low if r.rule is not None], "low_variance")
    drop(correlated_columns(df, columns, correlation, {r.descriptor: r.score for r in low}), "correlated")
    if len(columns) < 2:
        raise TooFewColumns(f"{len(columns)} descriptor columns are left")
    return df, columns, why


def anova_importance(df: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """(rank, descriptor, f_score, eta_squared, n_samples_used, n_clusters_used): between- against within-group spread.

    Noise (-1) and values that aren't finite are left out, as are descriptors of fewer than two groups.
    """
    from ..functions.scalars import is_finite

    x = unpivot(df.where(F.col(label) != -1), columns, [label]).where(is_finite(F.col("value")))
    # Two levels: groups first, then their sums; squares around the group's own mean keep precision.
    g = x.groupBy("descriptor", label).agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    t = g.groupBy("descriptor").agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("ssw"))
    b = g.join(t.select("descriptor", "mean"), "descriptor").groupBy("descriptor").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("ssb"))
    t = t.join(b, "descriptor").where("k >= 2")
    f = F.when(F.col("n") - F.col("k") <= 0, F.lit(float("nan"))).when(F.col("ssw") <= 1e-9, F.when(F.col("ssb") > 1e-9, F.lit(float("inf"))).otherwise(0.0)).otherwise(F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k"))))
    eta = F.when(F.col("ssb") + F.col("ssw") <= 1e-9, 0.0).otherwise(F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")))
    out = t.select("descriptor", f.alias("f_score"), eta.alias("eta_squared"), F.col("n").alias("n_samples_used"), F.col("k").alias("n_clusters_used"))
    w = Window.orderBy(F.nanvl(F.col("f_score"), F.lit(None)).desc_nulls_last(), F.desc("eta_squared"), "descriptor")
    return out.withColumn("rank", F.row_number().over(w).cast("long"))


def cluster_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("size"))


def size_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """(n, n_clusters, noise_fraction, max_fraction, min_size, imbalance), noise being -1."""
    s = cluster_sizes(df, label)
    c = F.when(F.col(label) != -1, F.col("size"))
    t = s.agg(F.sum("size").alias("n"), F.count(c).alias("n_clusters"), F.coalesce(F.sum(F.when(F.col(label) == -1, F.col("size"))), F.lit(0)).alias("noise"), F.max(c).alias("top"), F.min(c).alias("min_size"), F.sum(c).alias("clustered"))
    p = F.col("size") / F.col("clustered")
    h = s.where(F.col(label) != -1).crossJoin(F.broadcast(t.select("clustered"))).agg((-F.sum(p * F.log(p + 1e-12))).alias("h"))
    return t.crossJoin(h).select(
        "n", "n_clusters", (F.col("noise") / F.col("n")).alias("noise_fraction"), F.coalesce(F.try_divide("top", "clustered"), F.lit(1.0)).alias("max_fraction"), "min_size",
        F.when(F.col("n_clusters") < 2, 1.0).otherwise(1 - F.try_divide(F.col("h"), F.log(F.col("n_clusters").cast("double")))).alias("imbalance"),
    )


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari): agreement of two labelings of the same rows; noise is a label like any other."""
    pairs = lambda c: c * (c - 1) / 2
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    total = cells.agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("i"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("j"))
    e = F.try_divide(F.col("i") * F.col("j"), pairs(F.col("n")))
    return total.crossJoin(rows).crossJoin(cols).select(F.coalesce(F.try_divide(F.col("ij") - e, (F.col("i") + F.col("j")) / 2 - e), F.lit(1.0)).alias("ari"))


def explained_components(ratios: list[float], target: float = 0.95) -> int:
    """The first number of components whose cumulative explained variance reaches the target."""
    total = 0.0
    for i, r in enumerate(ratios):
        total += r
        if total >= target - 1e-12:
            return i + 1
    return len(ratios)


def ari_scalar(a: list[int], b: list[int]) -> float:
    """Adjusted Rand index of two short label lists."""
    from collections import Counter

    c2 = lambda xs: sum(math.comb(x, 2) for x in xs)
    ij, i, j, n = c2(Counter(zip(a, b, strict=True)).values()), c2(Counter(a).values()), c2(Counter(b).values()), math.comb(len(a), 2)
    e = i * j / n if n else 0.0
    return 1.0 if (i + j) / 2 == e else (ij - e) / ((i + j) / 2 - e)
