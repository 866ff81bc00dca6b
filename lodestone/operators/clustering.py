"""Clusterings of (row_id, features) compared by shared quality and stability scores."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.errors import IllegalArgumentException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import distance
from . import fits
from .stats import adjusted_rand, size_summary
from .vectors import added_up, all_pairs, matrix, quick_squares

#: Errors of a fit that make a rejected candidate; others, such as a lost cluster, end the run.
FIT_ERRORS = (*fits.FIT_ERRORS, IllegalArgumentException)


@dataclass
class Candidate:
    """One clustering: how it was made, what it is worth."""

    family: str
    params: dict
    metrics: dict = field(default_factory=dict)
    reasons: list[str] = field(default_factory=list)
    internal: float | None = None
    final: float | None = None
    labels: DataFrame | None = None


def tier(n: int) -> str:
    return "standard" if n <= 2000 else "large" if n <= 10_000 else "very_large" if n <= 25_000 else "ultra_large"


SETTINGS = {
    "standard": {"n_init": 20, "max_iter": 300, "silhouette": None, "repeats": 5, "cap": None, "refine": 0, "mixture": {"n_init": 5, "max_iter": 300}, "mixture_search": {"grid": 9, "radius": 3}},
    "large": {"n_init": 8, "max_iter": 220, "silhouette": 1500, "repeats": 3, "cap": 60, "refine": 3, "mixture": {"n_init": 2, "max_iter": 150}, "mixture_search": {"grid": 5, "radius": 2}},
    "very_large": {"n_init": 5, "max_iter": 160, "silhouette": 2000, "repeats": 3, "cap": 80, "refine": 2, "mixture": {"n_init": 2, "max_iter": 150}, "mixture_search": {"grid": 5, "radius": 1}},
    "ultra_large": {"n_init": 3, "max_iter": 120, "silhouette": 3000, "repeats": 3, "cap": 100, "refine": 1},
}


def k_max(n: int, user: int | None = None) -> int:
    """The largest number of clusters worth trying for n rows."""
    k = max(2, min(10, n // 3)) if n <= 100 else max(2, math.isqrt(n)) if n <= 1000 else max(2, min(math.isqrt(n), n // 15))
    return min(x for x in (k, SETTINGS[tier(n)]["cap"], user) if x is not None)


# Metrics of given labels


def centroids(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, centre) without noise; one pass over dimensions."""
    m = df.where(F.col(label) != -1).select(label, F.posexplode("features")).groupBy(label, "pos").agg(F.avg("col").alias("v"), F.count("*").alias("n"))
    return m.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("centre"))


def calinski_harabasz(df: DataFrame, label: str = "label") -> DataFrame:
    """(calinski_harabasz): between- against within-cluster sums of squares over all dimensions."""
    x = df.where(F.col(label) != -1).select(label, F.posexplode("features"))
    g = x.groupBy(label, "pos").agg(F.count("*").alias("n"), F.avg("col").alias("m"), F.var_pop("col").alias("v"))
    t = g.groupBy("pos").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    s = g.join(t, "pos").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"))
    c = df.where(F.col(label) != -1).groupBy(label).count().agg(F.sum("count").alias("n"), F.count("*").alias("k"))
    return s.crossJoin(c).select(F.try_divide(F.try_divide(F.col("ssb"), F.col("k") - 1), F.try_divide(F.col("ssw"), F.col("n") - F.col("k"))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, label: str = "label") -> DataFrame:
    """(davies_bouldin): mean over clusters of the worst ratio of spreads to the centres' distance."""
    c = centroids(df, label)
    s = df.join(c.select(label, "centre"), label).groupBy(label).agg(F.avg(distance(F.col("features"), F.col("centre"))).alias("s"))
    c = c.join(s, label)
    a, b = (c.select(*[F.col(x).alias(f"{p}_{x}") for x in (label, "centre", "s")]) for p in "ab")
    pairs = a.join(b, F.col(f"a_{label}") != F.col(f"b_{label}"))
    worst = pairs.groupBy(f"a_{label}").agg(F.max((F.col("a_s") + F.col("b_s")) / F.nullif(distance(F.col("a_centre"), F.col("b_centre")), F.lit(0.0))).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def silhouette_rows(df: DataFrame, label: str = "label") -> DataFrame:
    """(row_id, silhouette) by Euclidean distance over all pairs of rows that aren't noise, block by block; a cluster of one has 0."""
    df = df.where(F.col(label) != -1).withColumn("label", F.col(label))
    counts = {r[0]: r[1] for r in df.groupBy("label").count().collect()}
    names = np.array(sorted(counts))
    size = np.array([counts[c] for c in names.tolist()], float)

    def sums(a: dict, b: dict) -> dict:
        total = np.zeros((len(a["label"]), len(names)))
        for lo in range(0, len(b["label"]), 2048):
            member = (b["label"][lo : lo + 2048, None] == names).astype(float)
            total += np.sqrt(np.maximum(quick_squares(a["features"], b["features"][lo : lo + 2048]), 0)) @ member
        return {"row_id": a["row_id"], "place": np.searchsorted(names, a["label"]), "sums": total}

    def score(batches):
        for b in batches:
            sums, of = matrix(b.column(2)), b.column(1).to_numpy(zero_copy_only=False)
            if not len(of):
                continue
            at = np.arange(len(of))
            inner, mean = sums[at, of] / np.maximum(size[of] - 1, 1), sums / size
            mean[at, of] = np.inf
            outer = mean.min(1)
            top = np.maximum(inner, outer)
            known = (size[of] > 1) & np.isfinite(outer) & (top > 0)
            yield pa.RecordBatch.from_pydict({"row_id": b.column(0), "silhouette": pa.array(np.where(known, (outer - inner) / np.where(known, top, 1), 0.0))})

    def merge(out: DataFrame) -> DataFrame:
        return added_up(out, "sums").join(out.groupBy("row_id").agg(F.first("place").alias("place")), "row_id").select("row_id", "place", "sums")

    return all_pairs(df, ["features", "label"], sums, "row_id long, place long, sums array<double>", merge).mapInArrow(score, "row_id long, silhouette double")


def silhouette(df: DataFrame, label: str = "label", sample: int | None = None, seed: int = 0) -> DataFrame:
    """(silhouette): the mean over all rows, or over a sample by a hash of their id."""
    if sample:
        df = df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string"))), "row_id").limit(sample)
    return silhouette_rows(df, label).agg(F.avg("silhouette").alias("silhouette"))


def evaluate(df: DataFrame, label: str = "label", sample: int | None = None) -> dict:
    """All metrics of a labeling; what can't be measured has the worst value."""
    r = size_summary(df, label).first().asDict()
    out = {k: r[k] for k in ("n_clusters", "noise_fraction", "max_fraction", "imbalance")}
    kept = r["n"] - round(r["n"] * r["noise_fraction"])
    if r["n_clusters"] < 2 or kept <= r["n_clusters"] or r["min_size"] < 2:
        return out | {"silhouette": -1.0, "calinski_harabasz": 0.0, "davies_bouldin": math.inf}
    sil, ch, db = silhouette(df, label, sample).first()[0], calinski_harabasz(df, label).first()[0], davies_bouldin(df, label).first()[0]
    return out | {"silhouette": sil if sil is not None else -1.0, "calinski_harabasz": ch or 0.0, "davies_bouldin": math.inf if db is None else db}


def filter_reasons(m: dict) -> list[str]:
    """Why a clustering is rejected; empty if it passes."""
    rules = [("too_few_clusters", m["n_clusters"] < 2), ("silhouette", m["silhouette"] < 0), ("noise", m["noise_fraction"] > 0.20), ("dominant_cluster", m["max_fraction"] > 0.85), ("imbalance", m["imbalance"] > 0.90)]
    return [name for name, bad in rules if bad]


def normalize(values: list[float | None], lower_is_better: bool = False) -> list[float]:
    """To 0..1: what isn't finite takes the worst finite value; none finite: all 0; all equal: all 1."""
    x = [(-v if lower_is_better else v) if v is not None and math.isfinite(v) else None for v in values]
    known = [v for v in x if v is not None]
    if not known:
        return [0.0] * len(x)
    low, high = min(known), max(known)
    return [1.0] * len(x) if high - low <= 1e-12 else [((low if v is None else v) - low) / (high - low) for v in x]


def internal_scores(candidates: list[Candidate], density: bool = False) -> None:
    """Scores within a family, over the candidates that pass; a stability that wasn't measured counts 0."""
    ok = [c for c in candidates if not c.reasons]
    sil, ch, db = (normalize([c.metrics[k] for c in ok], k == "davies_bouldin") for k in ("silhouette", "calinski_harabasz", "davies_bouldin"))
    stab, dens = normalize([c.metrics.get("stability", 0.0) for c in ok]), normalize([c.metrics.get("density", -1.0) for c in ok])
    for c in candidates:
        c.internal = None
    for i, c in enumerate(ok):
        imb, noise = c.metrics["imbalance"], c.metrics["noise_fraction"]
        if density:
            c.internal = 0.35 * sil[i] + 0.20 * dens[i] + 0.25 * stab[i] + 0.10 * db[i] + 0.10 * ch[i] - 0.10 * noise - 0.05 * imb
        else:
            c.internal = 0.35 * sil[i] + 0.25 * ch[i] + 0.20 * db[i] + 0.20 * stab[i] - 0.05 * imb


def simplest(candidates: list[Candidate], score: str = "internal", slack: float = 0.02) -> Candidate | None:
    """Of those within ``slack`` of the best score, the one of fewest clusters, then of the highest score."""
    ok = [c for c in candidates if getattr(c, score) is not None]
    if not ok:
        return None
    top = max(getattr(c, score) for c in ok)
    return min((c for c in ok if getattr(c, score) >= top - slack), key=lambda c: (c.metrics["n_clusters"], -getattr(c, score)))


def final_scores(winners: list[Candidate]) -> None:
    """Scores across families."""
    stab, sil, db = normalize([c.metrics.get("stability", 0.0) for c in winners]), normalize([c.metrics["silhouette"] for c in winners]), normalize([c.metrics["davies_bouldin"] for c in winners], True)
    for i, c in enumerate(winners):
        c.final = 0.30 * stab[i] + 0.32 * sil[i] + 0.22 * db[i] - 0.12 * c.metrics["noise_fraction"] - 0.04 * c.metrics["imbalance"]


def quality_label(m: dict | None, final: float | None = None) -> str:
    """GOOD to UNRELIABLE by the number of warnings."""
    if m is None or final is None:
        return "UNAVAILABLE"
    stable = m.get("stability", 0.0)
    warnings = sum((m["silhouette"] < 0.10, stable < 0.40, m["noise_fraction"] > 0.30, m["imbalance"] > 0.40, final < 0.35))
    if not warnings and m["silhouette"] >= 0.25 and stable >= 0.80 and m["noise_fraction"] <= 0.10 and m["imbalance"] <= 0.30 and final >= 0.60:
        return "GOOD"
    return "ACCEPTABLE" if warnings <= 1 else "POOR" if warnings == 2 else "UNRELIABLE"


def search_objective(m: dict, rejected: bool) -> float:
    """What the integer search maximises."""
    if rejected:
        return -1.0
    return 0.45 * (m["silhouette"] + 1) / 2 + 0.25 * m.get("stability", 0.0) + 0.25 / (1 + m["davies_bouldin"]) - 0.05 * m["imbalance"]


def summary(spark: SparkSession, candidates: list[Candidate]) -> DataFrame:
    """All candidates, one a row, with what is known of each; a failed one has its reason only."""
    names = ("silhouette", "calinski_harabasz", "davies_bouldin", "stability", "noise_fraction", "imbalance", "density", "bic")
    number = lambda v: None if v is None else float(v)
    rows = [
        (c.family, ", ".join(f"{k}={v}" for k, v in sorted(c.params.items())), not c.reasons, "; ".join(c.reasons), c.metrics.get("n_clusters"), c.metrics.get("sizes"), *[number(c.metrics.get(k)) for k in names], number(c.internal), number(c.final))
        for c in candidates
    ]
    schema = "family string, params string, passed boolean, reasons string, n_clusters int, sizes array<long>, " + ", ".join(f"{k} double" for k in (*names, "internal", "final"))
    return spark.createDataFrame(rows, schema)


# Families


def _accept(c: Candidate, m: dict) -> Candidate:
    """A candidate with its metrics, or with why it failed."""
    c.metrics = m
    c.reasons = [f"failed: {m['error']}"] if "error" in m else filter_reasons(m)
    return c


def evaluate_local(local: fits.Local, candidates: list[Candidate], sample: int | None, repeats: int) -> list[Candidate]:
    """Candidates of tables that a task holds, fitted and measured all at once; labels come along, as a list in the order of row ids."""
    found = local.run([{"family": c.family, "params": c.params, "sample": sample, "repeats": repeats} for c in candidates])
    for c, m in zip(candidates, found, strict=True):
        c.labels = m.pop("labels")
        _accept(c, m)
    return candidates


def evaluate_large(features: DataFrame, c: Candidate, sample: int | None, repeats: int, seed: int = 0) -> Candidate:
    """A k-means candidate of a table of any size, by distributed passes."""
    fit = lambda x, s: fit_kmeans(x, c.params["k"], c.params["n_init"], c.params["max_iter"], s)
    try:
        c.labels = fit(features, seed)
        m = evaluate(c.labels, sample=sample)
        if repeats:
            m["stability"] = stability(c.labels, fit, repeats, seed=seed)
    except FIT_ERRORS as e:
        m = {"error": str(e)}
    return _accept(c, m)


def refine(candidates: list[Candidate], most: int, again) -> None:
    """Stability of the best few by their scores so far; ``again(list)`` measures it. Then all are scored anew."""
    ok = sorted((c for c in candidates if not c.reasons), key=lambda c: -c.internal)[:most]
    if ok:
        again(ok)
        internal_scores(candidates, candidates[0].family == "density")


# K-means by distributed passes


def fit_kmeans(df: DataFrame, k: int, n_init: int = 3, max_iter: int = 100, seed: int = 0) -> DataFrame:
    """(row_id, features, label) of the best of n_init starts by within-cluster cost; of equal ones the first. The starts run side by side, on rows
    spread by a hash of their id, so that neither the cores wait nor the input's files matter."""
    spark = df.sparkSession
    v = df.repartition(spark.sparkContext.defaultParallelism, "row_id").select(array_to_vector("features").alias("__v")).cache()

    @inheritable_thread_target(spark)
    def start(i: int):
        return KMeans(k=k, seed=seed * 1000 + i, featuresCol="__v", predictionCol="label", maxIter=max_iter, tol=1e-4).fit(v)

    try:
        v.count()
        with ThreadPool(min(n_init, 8)) as pool:
            models = pool.map(start, range(n_init))
    finally:
        v.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(df.withColumn("__v", array_to_vector("features"))).drop("__v")


def stability(df: DataFrame, fit, repeats: int = 3, fraction: float = 0.8, seed: int = 0) -> float:
    """Mean adjusted Rand index of refits on part of the rows, chosen by a hash of their id, against the labels; fewer than two
    clusters, or a failed refit, count 0."""
    total = 0.0
    for r in range(repeats):
        part = df.where(F.pmod(F.xxhash64("row_id", F.lit(seed), F.lit(r)), F.lit(10_000)) < int(10_000 * fraction))
        try:
            again = fit(part.drop("label"), seed + r + 1).select("row_id", F.col("label").alias("other"))
            if again.select("other").where("other <> -1").distinct().limit(2).count() >= 2:
                total += adjusted_rand(part.join(again, "row_id"), "label", "other").first()[0]
        except FIT_ERRORS:
            continue
    return total / repeats


# Gaussian mixtures by distributed passes


def gaussian_mixture(df: DataFrame, k: int, kind: str = "full", max_iter: int = 300, tol: float = 1e-3, reg: float = 1e-6, seed: int = 0) -> tuple[DataFrame, float]:
    """(labels, BIC) by expectation maximisation: each iteration is one pass in which partitions sum their rows' shares."""
    from ..session import ship

    spark = df.sparkSession
    ship(spark)
    x = df.select(F.col("row_id").cast("long"), "features").cache()
    g = centroids(fit_kmeans(x, k, 1, 20, seed)).orderBy("label").collect()
    n = x.count()
    mean, w = np.array([r.centre for r in g]), np.array([r.n / n for r in g])
    k, d = mean.shape
    var = np.array([r[0] for r in x.select(F.posexplode("features")).groupBy("pos").agg(F.var_pop("col").alias("v")).orderBy("pos").select("v").collect()]) + reg
    cov = np.tile(var, (k, 1)) if kind == "diag" else np.diag(var) if kind == "tied" else np.tile(np.diag(var), (k, 1, 1))
    last = -math.inf
    for _ in range(max_iter):
        state = spark.sparkContext.broadcast((w, mean, cov))

        def part(batches, state=state):
            total, sums = 0.0, None
            for b in batches:
                rows = np.array(b.column(0).to_pylist(), np.float64)
                if len(rows):
                    ll, *s = fits.shares(rows, *state.value, kind)
                    total += ll
                    sums = s if sums is None else [a + b for a, b in zip(sums, s, strict=True)]
            if sums is not None:
                yield pa.RecordBatch.from_pydict({"ll": [total], "s": [np.concatenate([a.ravel() for a in sums]).tolist()]})

        got = x.select("features").mapInArrow(part, "ll double, s array<double>").collect()
        state.unpersist()
        ll, s = sum(r.ll for r in got), np.sum([r.s for r in got], 0)
        rest = s[k + k * d :]
        w, mean, cov = fits.update(n, s[:k], s[k : k + k * d].reshape(k, d), rest.reshape(k, d) if kind == "diag" else rest.reshape(k, d, d), kind, reg)
        if abs(ll / n - last) < tol:
            break
        last = ll / n
    x.unpersist()
    state = spark.sparkContext.broadcast((w, mean, cov))

    def label(batches):
        for b in batches:
            rows = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            y = fits.log_density(rows, *state.value, kind).argmax(1) if len(rows) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(y.astype(np.int32))], ["row_id", "features", "label"])

    out = df.select(F.col("row_id").cast("long"), "features").mapInArrow(label, "row_id long, features array<double>, label int")
    return out, -2 * ll + fits.free_parameters(k, d, kind) * math.log(n)


def covariance_kinds(n: int, d: int) -> list[str]:
    if d > 50:
        return ["diag"]
    t = tier(n)
    return ["full", "diag", "tied"] if t == "standard" else ["diag", "full"] if t == "large" or (t == "very_large" and d <= 25) else ["diag"]


def mixture_shortlist(local: fits.Local, top: int, keep: int = 3, seed: int = 0) -> list[dict]:
    """Parameters of the mixtures worth measuring: for each kind of covariance an integer search over 2..top components by BIC, and its best few."""
    from . import search

    n = len(local.ids)
    s, out = SETTINGS[tier(n)], []
    for kind in covariance_kinds(n, local.width):
        params = lambda k, kind=kind: {"k": k, "covariance": kind, **s["mixture"]}

        def worth(ks: list[int], params=params) -> list[float]:
            return [-m.get("bic", math.inf) for m in local.run([{"family": "gmm", "params": params(k), "bic_only": True, "seed": seed} for k in ks])]

        space = top - 1
        found = search.IntegerSearch(worth, 2, top, search.search_budget(space, **s["mixture_search"], centers=1, fraction=0.08, most=16))
        found.run()
        best = sorted((k for k in found.seen if math.isfinite(found.seen[k])), key=lambda k: (-found.seen[k], k))
        out += [params(k) for k in best[:keep]]
    return out
