"""Encoding, imputation, scaling and principal components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..session import Scratch, ship
from ..sources.files import with_row_id
from .stats import explained_components

#: Rows with a gap that all tasks hold at once.
BLOCK = 1024

#: One-hot columns are made for at most this many levels.
MAX_LEVELS = 1000


def levels(df: DataFrame, column: str) -> list[str]:
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(MAX_LEVELS + 1).collect()]
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{column} has more than {MAX_LEVELS} levels; ordinal codes suit it")
    return found


def one_hot(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """All levels, in order, as <column>_<level> at the end; NULL has none. Returns the new columns too."""
    new = [(c, v) for c in columns for v in levels(df, c)]
    made = {f"{c}_{v}": F.when(F.col(c) == v, 1.0).otherwise(0.0) for c, v in new}
    return df.withColumns(made).drop(*columns), list(made)


def ordinal(df: DataFrame, column: str) -> DataFrame:
    """Codes from 0 by sorted level; NULL is -1. Levels are numbered by ranges, so their number doesn't matter."""
    codes = with_row_id(df.select(F.col(f"`{column}`").alias("__level")).where("__level is not null").distinct(), ["__level"], "__code")
    joined = df.join(codes, F.col(f"`{column}`") == F.col("__level"), "left")
    return joined.select(*[F.coalesce(F.col("__code").cast("double"), F.lit(-1.0)).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0."""
    s = df.agg(*[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(s[f"m{i}"])) / F.lit(s[f"s{i}"] or 1.0) for i, c in enumerate(columns) if s[f"m{i}"] is not None})


def standardize_arrays(df: DataFrame, column: str = "features") -> DataFrame:
    """The same over an array column."""
    dims = F.posexplode(column)
    stats = df.select(dims).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
    m, s = (F.array(*[F.lit(float(x)) for x in v]) for v in ([r.m for r in stats], [r.s or 1.0 for r in stats]))
    return df.withColumn(column, F.zip_with(F.zip_with(column, m, lambda x, y: x - y), s, lambda x, y: x / y))


def knn_impute(df: DataFrame, key: str, columns: list[str], k: int = 5) -> DataFrame:
    """Missing values as the mean of the k nearest rows that have the value.

    The distance is over the columns that both rows have, scaled up to all columns; ties go to the smaller key. The column's
    mean stands in where no row is comparable. Rows with a gap are taken ``BLOCK`` at a time: all tasks have the block and pass their own rows
    by it, keeping the k nearest for each gap; so no row is shuffled but those candidates. The work is (rows with a gap) x (rows): ``mean_impute`` is for tables where that is too much.
    """
    spark, p = df.sparkSession, len(columns)
    ship(spark)
    x = df.select(F.col(key).cast("long").alias("id"), F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("v"))
    gaps = Scratch(spark, "gaps").save(with_row_id(x.where(F.exists("v", lambda e: e.isNull())), ["id"], "place"), "rows")
    total, near = gaps.count(), None
    for start in range(0, total, BLOCK):
        block = gaps.where(F.col("place").between(start, start + BLOCK - 1)).orderBy("place").collect()
        shared = spark.sparkContext.broadcast((np.array([r.id for r in block]), np.array([r.v for r in block], np.float64)))

        def run(batches, shared=shared):
            ids, v = shared.value
            has = ~np.isnan(v)
            cells = [(i, c) for c in range(p) for i in np.flatnonzero(~has[:, c])]
            row, col = np.array([i for i, _ in cells]), np.array([c for _, c in cells])
            dist, who, val = (np.zeros((len(cells), 0), t) for t in (np.float64, np.int64, np.float64))
            for b in batches:
                for lo in range(0, b.num_rows, 256):
                    d_ids, d = b.column(0).slice(lo, 256).to_numpy(zero_copy_only=False), np.array(b.column(1).slice(lo, 256).to_pylist(), np.float64)
                    square, both = np.zeros((len(v), len(d))), np.zeros((len(v), len(d)))
                    for c in range(p):
                        ok = has[:, c : c + 1] & ~np.isnan(d[:, c])
                        diff = np.where(ok, v[:, c : c + 1] - d[:, c], 0)
                        square += diff * diff
                        both += ok
                    with np.errstate(divide="ignore", invalid="ignore"):
                        far = np.where((both > 0) & (ids[:, None] != d_ids), np.sqrt(square * float(p) / both), np.inf)
                    far = np.where(np.isnan(d[:, col]).T, np.inf, far[row])
                    pick = np.lexsort((np.broadcast_to(d_ids, far.shape), far), axis=1)[:, :k]
                    dist = np.concatenate((dist, np.take_along_axis(far, pick, 1)), 1)
                    who, val = np.concatenate((who, d_ids[pick]), 1), np.concatenate((val, d[pick, col[:, None]]), 1)
                    pick = np.lexsort((who, dist), axis=1)[:, :k]
                    dist, who, val = (np.take_along_axis(a, pick, 1) for a in (dist, who, val))
            i, j = np.nonzero(np.isfinite(dist))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[row[i]] if len(i) else np.zeros(0, np.int64)), "pos": pa.array(col[i].astype(np.int32) if len(i) else np.zeros(0, np.int32)), "dist": pa.array(dist[i, j]), "did": pa.array(who[i, j]), "val": pa.array(val[i, j])})

        found = x.mapInArrow(run, "id long, pos int, dist double, did long, val double")
        near = found if near is None else near.union(found)
    if near is None:
        return df
    w = Window.partitionBy("id", "pos").orderBy("dist", "did")
    near = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).groupBy("id", "pos").agg(F.avg("val").alias("val"))
    wide = near.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "val"))).alias("__near"))
    means = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"__m{i}") for i, c in enumerate(columns)])
    joined = df.join(wide.withColumnRenamed("id", "__id"), F.col(key) == F.col("__id"), "left").crossJoin(F.broadcast(means))
    place = {c: i for i, c in enumerate(columns)}
    return joined.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.try_element_at("__near", F.lit(place[c])), F.col(f"__m{place[c]}")).alias(c) if c in place else F.col(f"`{c}`") for c in df.columns])


def mean_impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values as the column's mean: one aggregation, for tables that are too large to compare rows."""
    m = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m[f"m{i}"])) for i, c in enumerate(columns)})


def covariance(df: DataFrame, column: str = "features") -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and row count of an array column, summed by partition: what comes to the driver is p by p."""

    def part(batches):
        n, total, square = 0, None, None
        for b in batches:
            x = np.array(b.column(0).to_pylist(), np.float64)
            if len(x):
                total = x.sum(0) + (0 if total is None else total)
                square = x.T @ x + (0 if square is None else square)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [total.tolist()], "q": [square.ravel().tolist()]})

    rows = df.select(column).mapInArrow(part, "n long, s array<double>, q array<double>").collect()
    n = sum(r.n for r in rows)
    if not n:
        return np.zeros(0), np.zeros((0, 0)), 0
    mean = np.sum([r.s for r in rows], 0) / n
    q = np.sum([r.q for r in rows], 0).reshape(len(mean), -1)
    return mean, q / n - np.outer(mean, mean), n


def components(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Explained-variance ratios and components (rows), the largest first; each one's largest loading is positive."""
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(-value)
    value, vector = np.maximum(value[order], 0), vector[:, order].T
    sign = np.sign(vector[np.arange(len(vector)), np.abs(vector).argmax(1)])
    return value / max(value.sum(), 1e-300), vector * np.where(sign == 0, 1, sign)[:, None]


def project(df: DataFrame, mean: np.ndarray, vectors: np.ndarray, column: str = "features", out: str = "features") -> DataFrame:
    """Centred features on the given components."""
    m = F.array(*[F.lit(float(x)) for x in mean])
    centred = F.zip_with(column, m, lambda a, b: a - b)
    dots = [F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(x)) for x in v]), lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e) for v in vectors]
    return df.withColumn(out, F.array(*dots))


def pca_safeguard(df: DataFrame, column: str = "features", gate: int = 80, target: float = 0.95, minimum: float = 0.85, share: float = 0.75, most: int = 100, enabled: bool = True) -> tuple[DataFrame, dict]:
    """Fewer dimensions where there are more than ``gate``, unless too little variance is left; and what was done."""
    first = df.select(F.size(column)).first()
    p = first[0] if first else 0
    info = {"applied": False, "columns": p, "components": p, "retained": 1.0}
    if not enabled or p <= gate:
        return df, info
    mean, cov, n = covariance(df, column)
    ratio, vectors = components(mean, cov)
    cap = min(max(2, int(share * p)), most, p, n)
    m = min(max(2, explained_components(ratio.tolist(), target)), cap)
    kept = float(ratio[:m].sum())
    if kept < minimum:
        return df, info | {"retained": kept}
    return project(df, mean, vectors[:m], column), info | {"applied": True, "components": m, "retained": kept}


def map_2d(df: DataFrame, column: str = "features") -> tuple[DataFrame, float | None]:
    """x and y on the first two components, y = 0 for one dimension; and the variance that they explain."""
    mean, cov, n = covariance(df, column)
    if n < 2:
        return df.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)}), None
    ratio, vectors = components(mean, cov)
    v = vectors[:2]
    out = project(df, mean, v, column, "__xy")
    out = out.withColumns({"x": F.col("__xy")[0], "y": F.col("__xy")[1] if len(v) > 1 else F.lit(0.0)}).drop("__xy")
    return out, 1.0 if len(mean) == 1 else float(ratio[:2].sum())


def visual_quality(value) -> str:
    """How well a map shows the space, from the explained variance or the trustworthiness."""
    if value is None:
        return "UNAVAILABLE"
    return "EXCELLENT" if value >= 0.95 else "GOOD" if value >= 0.90 else "ACCEPTABLE" if value >= 0.80 else "LOW"


def to_vector(df: DataFrame, columns: list[str], out: str = "vector") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out).transform(df)


def vector_summary(df: DataFrame, column: str = "vector") -> DataFrame:
    return df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(column)).alias("s")).select("s.*")
