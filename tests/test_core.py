"""Golden values of the selection and active-learning operators, and their queries against DuckDB."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.config import ClusterOptions, LearnOptions
from lodestone.functions import scalars as S
from lodestone.operators import acquisition as A
from lodestone.operators import clustering as C
from lodestone.operators import encode, hygiene, search, stats
from lodestone.operators import vectors as V
from lodestone.plans import registry, workflows
from lodestone.sources import files


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def text_rows(df):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
            return "NULL"
        return repr(float(v)) if isinstance(v, (float, int, np.number)) and not isinstance(v, bool) else str(v)

    return sorted("|".join(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, sf, duck, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert text_rows(got) == text_rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"quartile_diversity", "quartile_exploration", "pca_safeguard", "budget_grid", "cluster_auto", "cluster_exploratory"}))
def test_query_without_sql_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


# Strategy and ranking


def test_strategy():
    r = lambda *a, **k: (lambda s: (s.strategy, s.score_band, s.alpha))(A.resolve_strategy(*a, **k))
    assert r(3) == ("model", "<=6", None) and r(7, objective="min") == ("hit", "7-8", 1.0) and r(9) == ("hit", ">8", 0.5)
    assert r(8, mode="model", objective=None) == ("model", "manual_model", None) and r(2, mode="hit", alpha=0.25) == ("hit", "manual_hit", 0.25)
    assert r(None) == ("model", "unknown", None)
    for bad in ({"alpha": 2}, {"mode": "model", "alpha": 0.5}, {"objective": "up"}, {"mode": "x"}):
        with pytest.raises(ValueError):
            A.resolve_strategy(7, **bad)


def test_ranking(spark):
    df = spark.createDataFrame([("a", 8.0, 0.5), ("b", 9.0, 1.2), ("c", 10.0, 0.8), ("d", 7.5, 1.5)], "row_id string, y_pred double, y_pred_sd double")
    order = lambda *a: "".join(r.row_id for r in A.rank_candidates(df, *a).orderBy("rank").collect())
    assert order("uncertainty") == "dbca" and order("max", 0.5) == "cbad" and order("min", 0.5) == "dabc"
    assert [round(r.metric, 2) for r in A.rank_candidates(df, "max", 0.5).orderBy("rank").collect()] == [10.4, 9.6, 8.25, 8.25]


def test_convergence(spark):
    h = spark.createDataFrame([(1, 1.0, 0.5, 7), (2, 0.98, 0.49, 8), (3, 0.98, 0.49, 8)], "batch int, rmse double, SD double, score int")
    out = A.convergence(h).orderBy("batch").collect()
    assert [r.convergence for r in out] == ["no", "yes", "yes"] and [r.rmse_converged for r in out] == [0, 1, 1]
    assert [r.convergence for r in A.convergence(h.limit(1)).collect()] == ["no"]


def test_history_upsert(spark):
    s = "batch int, v int"
    old, new = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], s), spark.createDataFrame([(2, 20), (3, 30), (4, 40)], s)
    assert sorted(map(tuple, A.upsert_history(old, new).collect())) == [(1, 1), (2, 2), (3, 30), (4, 40)]
    assert sorted(map(tuple, A.upsert_history(old, new.where("batch = 4")).collect())) == [(1, 1), (2, 2), (3, 3), (4, 40)]


def test_quartiles(spark):
    d = lambda x: spark.createDataFrame([(float(v),) for v in x], "v double")
    r = A.range_quartiles(d([0, 2, 4, 6, 8, 10]), d([2, 4, 6, 8]), "v").first()
    assert tuple(r) == (0, 2.5, 5, 7.5, 10, 1.25, 3.75, 6.25, 8.75)
    assert {x.quartile for x in A.quartile_labels(d([3, 3]), "v").collect()} == {"q1"}


# Hygiene


def test_column_hygiene(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0, 0.0, 1.0), (1.0, 1.0, 2.0, 2.0, 1.0, 2.0), (1.0, 1.0, 3.0, 3.0, 0.0, 3.0), (1.0, 2.0, 4.0, 4.0, 1.0, 7.0)], "constant double, near double, dup_a double, dup_b double, bin double, useful double")
    assert hygiene.duplicate_columns(df, df.columns) == ["dup_b"]
    m = {r.descriptor: r for r in stats.modal_share(df, df.columns).collect()}
    assert m["constant"].n_distinct == 1 and m["near"].top_share == 0.75
    assert {r.descriptor: r.rule for r in stats.low_variance(df, ["bin", "useful"]).collect()} == {"bin": None, "useful": None}
    abc = spark.createDataFrame([(float(a), 2.0 * a, 5.0 - a) for a in range(1, 5)], "a double, b double, c double")
    assert stats.correlated_columns(abc, ["a", "b", "c"], 0.9) == ["b", "c"]
    with pytest.raises(hygiene.TooFewColumns):
        stats.clean_columns(abc, ["a", "b", "c"])


@pytest.mark.parametrize("sample", [20_000, 1400])
def test_quantiles_by_brackets_are_exact(spark, sample):
    r = np.random.default_rng(5)
    x = {"a": r.normal(size=3000), "b": r.integers(0, 3, 3000).astype(float), "c": r.exponential(size=3000), "d": np.full(3000, 7.0)}
    x["c"][::4] = np.nan
    df = files.nan_to_null(spark.createDataFrame(pd.DataFrame(x)))
    got, _ = stats.quantiles(df.withColumn("e", F.lit(None).cast("double")), [*x, "e"], (0.0, 0.25, 0.5, 0.75, 1.0), sample)
    for c, v in x.items():
        assert np.allclose(got[c], np.nanquantile(v, [0, 0.25, 0.5, 0.75, 1]))
    assert got["e"] == [None] * 5
    for row in stats.robust_stats(df, list(x)).collect():
        v = x[row.descriptor][~np.isnan(x[row.descriptor])]
        assert np.allclose([row.sd, row.q1, row.median, row.q3], [v.std(), *np.quantile(v, [0.25, 0.5, 0.75])])


def test_correlations_against_numpy(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(400, 4)) + 1e6
    x[:, 2] = 3 * x[:, 0] + r.normal(size=400)
    x[r.random((400, 4)) < 0.2] = np.nan
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd"))).withColumn("e", F.lit(5.0)).repartition(3)
    df = files.nan_to_null(df)
    got = {(q.a, q.b): q.r for q in stats.correlations(df, list("abcde")).collect()}
    assert len(got) == 10 and all(got[a, "e"] is None for a in "abcd")
    for i in range(4):
        for j in range(i):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert got["abcd"[j], "abcd"[i]] == pytest.approx(abs(np.corrcoef(x[both, i], x[both, j])[0, 1]))


def test_missing_and_duplicate_rows(spark):
    df = spark.createDataFrame([(1, "A"), (2, "A"), (3, None)], "row_id long, k string")
    assert sorted(r.row_id for r in hygiene.dedup_rows(df, ["row_id"], ["k"]).collect()) == [1, 3]
    assert hygiene.duplicate_keys(df, ["k"]).count() == 2
    assert hygiene.resolve_column(df, "K") == "k"
    with pytest.raises(hygiene.MissingColumn):
        hygiene.resolve_column(df, "z")


def test_batches(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", None, None)], "k string, y double, batch int")
    b = hygiene.bootstrap_batches(df, "y")
    assert sorted((r.k, r.batch) for r in b.collect()) == [("a", 0), ("b", None)] and hygiene.next_batch(b, "y").first()["next_batch"] == 1
    make = lambda *rows: spark.createDataFrame(rows, df.schema)
    with pytest.raises(hygiene.OrphanTarget):
        hygiene.bootstrap_batches(make(("a", 1.0, None), ("b", 2.0, 1)), "y")
    with pytest.raises(hygiene.IncompleteBatch):
        hygiene.bootstrap_batches(make(("a", 1.0, 1), ("b", None, 1)), "y")
    with pytest.raises(hygiene.NoTargets):
        hygiene.bootstrap_batches(make(("a", None, None)), "y")
    mixed = make(("c", 1.0, 1), ("a", 1.0, None), ("b", 1.0, 0), ("d", 1.0, 1))
    assert "".join(r.k for r in hygiene.sort_by_batch(mixed, "k").collect()) == "bcda"
    assert "".join(r.k for r in hygiene.sort_by_batch(mixed, "k", latest_first=True).collect()) == "cdba"
    with pytest.raises(hygiene.RowCountMismatch):
        hygiene.attach(df, df.limit(1), "k", guard=True)
    assert {e.code for e in vars(hygiene).values() if isinstance(e, type) and issubclass(e, hygiene.TableError)} == set(range(1, 21))


def test_encoding(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "row_id long, c string")
    out, names = encode.one_hot(df, ["c"])
    assert names == ["c_a", "c_b"] and sorted(map(tuple, out.collect())) == [(1, 0, 1), (2, 1, 0), (3, 0, 0)]
    assert sorted(map(tuple, encode.ordinal(df, "c").collect())) == [(1, 1.0), (2, 0.0), (3, -1.0)]


@pytest.mark.parametrize("block", [1024, 4])
def test_knn_imputation_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(encode, "BLOCK", block)
    r = np.random.default_rng(0)
    x = r.normal(size=(40, 3))
    x[r.random((40, 3)) < 0.15] = np.nan
    df = spark.createDataFrame([(i, *[None if math.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], "row_id long, a double, b double, c double")
    got = np.array([tuple(r)[1:] for r in encode.knn_impute(df, "row_id", ["a", "b", "c"]).orderBy("row_id").collect()])
    want = x.copy()
    for i, j in np.argwhere(np.isnan(x)):
        d = []
        for o in range(40):
            both = ~np.isnan(x[i]) & ~np.isnan(x[o])
            if o != i and not math.isnan(x[o, j]) and both.any():
                d.append((math.sqrt(((x[i] - x[o])[both] ** 2).sum() * 3 / both.sum()), o))
        want[i, j] = np.mean([x[o, j] for _, o in sorted(d)[:5]]) if d else np.nanmean(x[:, j])
    assert np.allclose(got, want)


# Vectors


def test_importance(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 1.0, 2.0), (1, 5.0, 3.0), (1, 5.0, 4.0)], "label int, d1 double, d2 double")
    a, b = stats.anova_importance(df, ["d1", "d2"]).orderBy("rank").collect()
    assert (a.descriptor, a.f_score, a.eta_squared) == ("d1", math.inf, 1.0) and (b.descriptor, round(b.f_score, 9), round(b.eta_squared, 9)) == ("d2", 8.0, 0.8)


def test_allocation():
    assert V.allocate(4, {0: 3, 1: 2, -1: 1}) == {0: 2, 1: 1, -1: 1}
    assert list(V.allocate(2, {0: 3, 1: 2, -1: 1}).values()) == [1, 1]
    assert sum(V.allocate(37, {i: 10 + i for i in range(9)}).values()) == 37


def test_selection(spark):
    pts = [(0, [0.0, 0.0]), (1, [0.1, 0.0]), (2, [5.0, 0.0]), (3, [5.1, 0.0]), (4, [0.0, 5.0]), (5, [0.1, 5.0])]
    f = spark.createDataFrame(pts, "row_id long, features array<double>")
    ids = {r.row_id for r in V.representative_select(f, 3).collect()}
    assert {i // 2 for i in ids} == {0, 1, 2}
    assert V.representative_select(f, 0).count() == 0 and V.representative_select(f, 6).count() == 6
    with pytest.raises(ValueError):
        V.representative_select(f, 7)
    assert len({r.row_id // 2 for r in V.exploratory_select(f, 3).collect()}) == 3
    order = [r.row_id for r in V.farthest_first(f, 0, 3).orderBy("rank").collect()]
    assert order[0] == 0 and set(order[1:]) == {3, 5}


def test_large_groups_are_traversed_as_small_ones_are(spark, monkeypatch):
    r = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(r.integers(0, 40, (90, 2)).astype(float))], "row_id long, features array<double>, label int")
    once = sorted(map(tuple, V.natural_select(df, 14).collect()))
    monkeypatch.setattr(V, "GROUP_ROWS", 10)
    assert sorted(map(tuple, V.natural_select(df, 14).collect())) == once and len(once) == 14


def test_natural_selection_is_topped_up(spark):
    f = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(12)], "row_id long, features array<double>")
    labels = f.where("row_id < 4").withColumn("label", F.lit(0))
    assert len({r.row_id for r in workflows.select_natural(f, labels, 7, 0).collect()}) == 7


def test_nearest_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 5))
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    s = f.where("row_id % 4 = 0")
    want = {i: int(((x[::4] - x[i]) ** 2).sum(1).argmin()) for i in range(200)}
    assert {q.row_id: q.region for q in V.nearest(f, s).collect()} == want
    monkeypatch.setattr(V, "BLOCK", 7)
    assert {q.row_id: q.region for q in V.nearest(f, s).collect()} == want


def test_hull_against_half_planes():
    p = np.random.default_rng(1).normal(size=(300, 2))
    h = V.hull_of(p)
    for a, b in zip(h, np.roll(h, -1, axis=0)):
        assert (((b - a)[0] * (p[:, 1] - a[1]) - (b - a)[1] * (p[:, 0] - a[0])) >= -1e-12).all()
    assert len(V.hull_of(p[:2])) == 0 and V.polygon_area(np.array([[0, 0], [2, 0], [2, 2], [0, 2]])) == 4


def test_components_against_numpy(spark):
    x = np.random.default_rng(0).normal(size=(100, 4)) @ np.diag([5, 3, 1, 0.1])
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    ratio = encode.components(*encode.covariance(f)[:2])[0]
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert np.allclose(ratio, s / s.sum())
    out, info = encode.pca_safeguard(f, gate=3)
    assert info["applied"] and info["components"] == 2 and len(out.first().features) == 2
    assert not encode.pca_safeguard(f, gate=4)[1]["applied"] and not encode.pca_safeguard(f, gate=3, minimum=0.9999)[1]["applied"]


# Clustering


def test_rules():
    assert (C.tier(100), C.tier(5000)) == ("standard", "large")
    assert C.k_max(80) == 10 and C.k_max(400, 12) == 12
    assert search.search_budget(30) == (7, 8) and search.search_budget(200) == (15, 15) and search.search_budget(3) == (1, 2) and search.search_budget(1) == (1, 0)
    assert search.search_budget(60, grid=9, radius=3, fraction=0.08, most=16) == (8, 8)
    assert C.normalize([5, 5]) == [1, 1] and C.normalize([3, math.inf], True)[0] == 1.0 and C.normalize([None]) == [0]
    m = {"silhouette": 0.3, "stability": 0.85, "noise_fraction": 0.02, "imbalance": 0.1}
    assert C.quality_label(None) == "UNAVAILABLE" and C.quality_label(m, 0.8) == "GOOD"
    assert C.quality_label({"silhouette": 0.05, "stability": 0.3, "noise_fraction": 0.35, "imbalance": 0.5}, 0.2) == "UNRELIABLE"
    a, b = C.Candidate("x", {}, {"n_clusters": 4}, internal=0.80), C.Candidate("x", {}, {"n_clusters": 3}, internal=0.77)
    assert C.simplest([a, b], slack=0.05) is b and C.simplest([a, b]) is a


def test_three_blobs_are_found(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 0.1, (12, 3)) for c in (0, 4, 9)])
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    out = C.fit_kmeans(f, 3)
    assert C.evaluate(out)["silhouette"] > 0.9 and not C.filter_reasons(C.evaluate(out))
    labels, bic = C.gaussian_mixture(f, 3, "tied")
    assert stats.ari_scalar([r.label for r in labels.orderBy("row_id").collect()], [i // 12 for i in range(36)]) == 1.0
    assert bic < C.gaussian_mixture(f, 2, "tied")[1]


def test_local_metrics_are_those_of_the_distributed_ones(spark):
    from lodestone.operators import fits

    r = np.random.default_rng(3)
    x, y = r.normal(size=(60, 3)), r.integers(-1, 4, 60)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "row_id long, features array<double>, label int")
    got, want = fits.measure(x, y), C.evaluate(df)
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    z = r.integers(0, 3, 60)
    assert fits.rand_index(y, z) == pytest.approx(stats.ari_scalar(y.tolist(), z.tolist()))
    assert C.filter_reasons(fits.measure(x, np.zeros(60, int)))[0] == "too_few_clusters"


def test_local_fits_find_planted_groups(spark):
    from lodestone.operators import fits

    r = np.random.default_rng(1)
    centres = np.array([[0, 0], [9, 0], [0, 9], [9, 9], [20, 0], [0, 20], [20, 20]])
    y = np.arange(140) % 7
    x = centres[y] + r.normal(size=(140, 2)) * [1.0, 0.3]
    assert fits.rand_index(fits.kmeans(x, 7, 20, 300, 0), y) > 0.97
    for kind in ("full", "diag", "tied"):
        label, bic = fits.mixture(x, 7, kind, 5, 300, 0)
        assert fits.rand_index(label, y) > 0.97 and bic < fits.mixture(x, 4, kind, 5, 300, 0)[1]
    f = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    found, quality, labels = workflows.natural_model(f, ClusterOptions())
    kinds = {c.params["covariance"] for c in found if c.family == "gmm"}
    assert kinds == {"full", "diag", "tied"} and max(c.params["k"] for c in found if c.family == "kmeans") == 11
    assert fits.rand_index(np.array([q.label for q in labels.orderBy("row_id").collect()]), y) > 0.97 and quality in {"GOOD", "ACCEPTABLE"}
    table = C.summary(spark, found)
    assert table.count() == len(found) and table.where("passed and internal is null").count() == 0
    two = spark.createDataFrame([(i, [float(i // 2), 0.0]) for i in range(6)], "row_id long, features array<double>")
    bad = C.evaluate_local(fits.Local(two), [C.Candidate("kmeans", {"k": 9, "n_init": 1, "max_iter": 5})], None, 0)[0]
    assert bad.reasons[0].startswith("failed") and bad.internal is None


def test_larger_tables_refine_the_best_and_score_all(spark, monkeypatch):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(c, 0.3, (30, 2)) for c in (0, 4, 9, 20)])
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    for tier, stable in (("large", 3), ("ultra_large", 1)):
        monkeypatch.setattr(C, "tier", lambda n, tier=tier: tier)
        found, _, labels = workflows.natural_model(f, ClusterOptions(max_clusters=6, families=("kmeans",)))
        ok = [c for c in found if not c.reasons]
        assert len(ok) > stable and all(c.internal is not None for c in ok) and sum("stability" in c.metrics for c in ok) == stable
        assert labels.select("label").distinct().count() == 4


def some_rows(spark, n, width, seed=0, copies=7):
    """Rows of which a few are copies, with labels of which some are noise; as a table and as arrays."""
    r = np.random.default_rng(seed)
    x, y = r.normal(size=(n, width)), r.integers(-1, 4, n)
    x[-copies:], y[-copies:] = x[:copies], y[:copies]
    return spark.createDataFrame([(5 * i, v.tolist(), int(c), float(v[0]), float(v[1])) for i, (v, c) in enumerate(zip(x, y))], "row_id long, features array<double>, label int, x double, y double"), x, y


def test_silhouettes_of_any_number_of_rows(spark, monkeypatch):
    df, x, y = some_rows(spark, 300, 6)
    monkeypatch.setattr(V, "BLOCK_BYTES", 70 * 6 * 8)  # five blocks
    got = {r.row_id // 5: r.silhouette for r in C.silhouette_rows(df).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    for i in np.flatnonzero(y >= 0):
        inner = d[i][y == y[i]].sum() / ((y == y[i]).sum() - 1)
        outer = min(d[i][y == c].mean() for c in range(4) if c != y[i])
        assert got.pop(int(i)) == pytest.approx((outer - inner) / max(outer, inner), abs=1e-9)
    assert not got
    monkeypatch.undo()
    more = spark.range(26_000).selectExpr("id AS row_id", "array(id % 97 + 0.0D, id % 89 + 0.0D) AS features", "int(id % 3) AS label")
    assert C.silhouette_rows(more).count() == 26_000


def test_trustworthiness_of_any_number_of_rows(spark, monkeypatch):
    df, x, _ = some_rows(spark, 150, 6, 1)
    want = V.trustworthiness(df).first()[0]
    far, near = (np.argsort(np.where(np.eye(len(x)) > 0, np.inf, np.round(V.squared_distances(z, z), 12)), axis=1, kind="stable") for z in (x, x[:, :2]))
    lost = sum(max(0, far[i].tolist().index(j) + 1 - 15) for i in range(len(x)) for j in near[i, :15].tolist())
    assert want == pytest.approx(1 - 2 * lost / (150 * 15 * (300 - 46)))
    monkeypatch.setattr(V, "BLOCK_BYTES", 80 * 6 * 8)  # two blocks
    assert V.trustworthiness(df).first()[0] == pytest.approx(want, abs=1e-12)


def test_density_clusters_of_any_number_of_rows(spark, monkeypatch):
    from lodestone.operators import density

    r = np.random.default_rng(0)
    x = np.concatenate([r.normal((0, 0, 0), 0.2, (140, 3)), r.normal((5, 0, 1), 0.5, (160, 3)), r.normal((0, 8, 2), 0.3, (80, 3)), r.uniform(-20, 20, (20, 3))])
    df = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    want = density.hierarchical_density(x, 10, 5)
    monkeypatch.setattr(V, "BLOCK_BYTES", 210 * 3 * 8)  # two blocks
    out = density.fit_density(df, 10, 5)
    got = np.array([q.label for q in out.orderBy("row_id").collect()])
    assert len(set(got.tolist())) == 4 and [got.tolist().index(c) for c in got] == [want.tolist().index(c) for c in want]
    assert density.validity(out) == pytest.approx(density.density_validity(x, got), abs=1e-9)


def test_integer_search_of_more_rows_than_a_task_holds(spark, sf, monkeypatch):
    from lodestone.operators import fits

    monkeypatch.setattr(fits, "MOST_ROWS", 100)
    monkeypatch.setattr(C, "k_max", lambda n: 3)
    monkeypatch.setitem(C.SETTINGS, "large", C.SETTINGS["large"] | {"n_init": 2, "max_iter": 5})
    got = registry.QUERIES["integer_search"](spark, sf).collect()
    assert [r.k for r in got] == [2, 3] and sum(r.best for r in got) == 1


def test_nearest_rows_by_either_name_in_blocks(spark, monkeypatch):
    df, x, _ = some_rows(spark, 200, 6, 2)
    monkeypatch.setattr(V, "BLOCK", 16)
    want = V.squared_distances(x, x[::4])
    for f in (V.nearest, V.nearest_sql):
        got = {r.row_id // 5: r for r in f(df, df.where("row_id % 20 = 0")).collect()}
        assert len(got) == 200 and all(got[i].region == want[i].argmin() and got[i].dist == math.sqrt(want[i].min()) for i in range(200))


def test_cleaning_takes_each_statistic_once(spark, sf, monkeypatch):
    taken = []
    for name in ("modal_share", "quantiles"):
        f = getattr(stats, name)
        monkeypatch.setattr(stats, name, lambda *a, f=f, name=name, **k: taken.append(name) or f(*a, **k))
    got = {r.descriptor: r.verdict for r in registry.QUERIES["clean_columns"](spark, sf).collect()}
    assert sorted(taken) == ["modal_share", "quantiles"] and "correlated" in got.values() and got["tax_copy"] == "duplicate"


def test_density_clusters():
    from lodestone.operators import density

    r = np.random.default_rng(0)
    x = np.concatenate([r.normal((0, 0), 0.2, (40, 2)), r.normal((5, 0), 0.5, (60, 2)), r.normal((0, 8), 0.3, (30, 2)), r.uniform(-20, 20, (6, 2))])
    y = density.hierarchical_density(x, 8, 4)
    assert len(set(y.tolist()) - {-1}) == 3
    for a, b in ((0, 40), (40, 100), (100, 130)):
        top = np.bincount(y[a:b][y[a:b] >= 0]).max()
        assert top >= 0.9 * (b - a)
    assert density.density_validity(x, y) > density.density_validity(x, r.permutation(y)) and density.density_validity(x, np.zeros(len(x), int)) is None
    t, full = density.spanning_tree(x, np.zeros(len(x))), np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    seen, total = {0}, 0.0
    while len(seen) < len(x):
        rest = [i for i in range(len(x)) if i not in seen]
        sub = full[np.ix_(sorted(seen), rest)]
        total += sub.min()
        seen.add(rest[int(sub.min(0).argmin())])
    assert t[:, 2].sum() == pytest.approx(total)
    assert density.hierarchical_density(x[:3], 8, 4).tolist() == [-1] * 3


def test_integer_search_finds_the_top():
    assert search.IntegerSearch(lambda ks: [-((k - 37) ** 2) for k in ks], 2, 60).run() in range(35, 40)


def test_budget_grids():
    assert search.budget_grid(6) == [1, 2, 3] and search.budget_grid(40) == list(range(1, 21)) and search.budget_grid(500) == [5, 15, 25, 35, 45]
    assert search.budget_grid(800, factor=10, min_points=5)[0] == 5 and search.budget_grid(20_000, factor=10, min_points=5)[-1] == 495
    found = [search.Budget(10, 1.0), search.Budget(20, 0.5), search.Budget(30, 0.49), search.Budget(40, 0.485), search.Budget(50, 0.484)]
    assert search.stop_at(found, 1000).size == 20


# Whole workflows


def test_cluster_workflow(spark):
    r = np.random.default_rng(2)
    rows = [(i, *map(float, r.normal(size=3)), "ab"[i % 2]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, x double, y double, z double, kind string")
    for mode in ("representative", "exploratory"):
        s = workflows.cluster(df, "row_id", ClusterOptions(n_points=5, mode=mode))
        assert s.table.where("batch = 0").count() == 5 and s.table.columns[-1] == "batch" and s.regions.count() == 30
    with pytest.raises(hygiene.TableError):
        workflows.cluster(s.table, "row_id", ClusterOptions(n_points=5))
    assert s.payload.count() == 30 and len(s.payload.first().colours) == min(5, s.importance.count()) and {r.descriptor for r in s.importance.collect()} <= {"x", "y", "z", "kind_a", "kind_b"}
    assert s.cells.cells.agg(F.sum("n")).first()[0] == 30 and s.coverage.first().verdict in {"broad", "moderate", "limited"}
    with pytest.raises(hygiene.TooManyPoints):
        workflows.cluster(df, "row_id", ClusterOptions(n_points=31))
    with pytest.raises(hygiene.UnknownIgnored):
        workflows.cluster(df, "row_id", ClusterOptions(n_points=3, ignore=("nope",)))
    extra = workflows.cluster(df, "row_id", ClusterOptions(n_points=3), lambda d: d.select("row_id", (F.col("x") * F.col("x")).alias("x2")))
    assert "x2" in extra.table.columns
    with pytest.raises(hygiene.RowCountMismatch):
        workflows.cluster(df, "row_id", ClusterOptions(n_points=3), lambda d: d.select("row_id", F.lit(1.0).alias("w")).limit(3))
    again = workflows.cluster(s.table, "row_id", ClusterOptions(evaluate=True))
    assert again.selected.count() == 5 and again.coverage.first().avg_gap > 0


def test_learning_round(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(i % 7 * 2 + i % 5) if i % 4 else None, 0 if i % 4 else None) for i in range(80)], "row_id long, a double, b double, y double, batch int")
    out = workflows.learn(df, "row_id", ["a", "b"], LearnOptions(n_exps=2))
    assert out.number == 1 and out.table.where("batch = 1").count() == 2 and out.ranking.count() == 2 and out.history.count() == 1
    assert [r.batch for r in out.table.limit(3).collect()] == [1, 1, 0]


def test_pool_rows_with_gaps_can_be_chosen(spark):
    from lodestone.operators import models

    train = spark.createDataFrame([(i, float(i % 7), None if i % 9 == 0 else float(i % 5), float(i % 7)) for i in range(60)], "row_id long, a double, b double, y double")
    pool = spark.createDataFrame([(100, 3.0, 1.0), (101, None, 2.0), (102, float("nan"), None)], "row_id long, a double, b double")
    assert sorted(r.row_id for r in models.ensemble(["a", "b"])(train, pool).collect() if r.y_pred is not None) == [100, 101, 102]


# Brute force of what SQL can't say


def test_quartile_diversity_against_brute_force(spark, sf):
    from lodestone.plans.active_queries import predictions

    rows = [(r.row_id, r.y_pred, r.y_pred_sd) for r in predictions(spark, sf).collect()]
    low, high = min(r[1] for r in rows), max(r[1] for r in rows)
    quarter = lambda v: next((f"q{i}" for i in (1, 2, 3) if v <= low + i * (high - low) / 4), "q4")
    top, served, want = max(r[2] for r in rows), dict.fromkeys(("q1", "q2", "q3", "q4"), 0), []
    for _ in range(10):
        score = lambda r: (r[2] - 0.15 * top * served[quarter(r[1])] / 2.5, r[2], r[1], -r[0])  # noqa: E731, B023
        best = max((r for r in rows if r[0] not in [w for w, _ in want]), key=score)
        want.append((best[0], quarter(best[1])))
        served[quarter(best[1])] += 1
    assert [(r.row_id, r.quartile) for r in registry.QUERIES["quartile_diversity"](spark, sf).orderBy("place").collect()] == want


def test_quartile_exploration_against_brute_force(spark, sf):
    from lodestone.plans.active_queries import predictions

    rows = [(r.row_id, r.y_pred, r.y_pred_sd) for r in predictions(spark, sf).collect()]
    x = [r[1] for r in rows if r[0] % 5 == 0]
    low, high = min(x) - 0.2 * (max(x) - min(x)), max(x) + 0.2 * (max(x) - min(x))
    low, high = (min((abs(r[1] - e), r[1]) for r in rows)[1] for e in (low, high))
    step = (high - low) / 4
    quarter = lambda v: next((f"q{i}" for i in (1, 2, 3) if v < low + i * step), "q4")
    left, filled, want = [r for r in rows if r[0] % 5], {"q1": 1, "q2": 0, "q3": 0}, []
    for _ in range(8):
        q = min(filled, key=lambda k: filled[k])
        mine = [r for r in left if quarter(r[1]) == q]
        best = min(mine, key=lambda r: (-r[2], r[0])) if mine else min(left, key=lambda r: (abs(r[1] - (low + (int(q[1]) - 0.5) * step)), r[0]))
        want.append(best[0])
        left.remove(best)
        filled[q] += 1
    assert [r.row_id for r in registry.QUERIES["quartile_exploration"](spark, sf).orderBy("place").collect()] == want


def test_components_of_the_query_against_numpy(spark, sf):
    import pyarrow.dataset as ds

    x = np.array(ds.dataset(f"{sf}/embeddings.parquet").to_table().column("embedding").to_pylist(), np.float64)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    ratio = s / s.sum()
    m = min(int(np.searchsorted(np.cumsum(ratio), 0.95 - 1e-12)) + 1, int(0.75 * x.shape[1]))
    row = registry.QUERIES["pca_safeguard"](spark, sf).first()
    kept = ratio[:m].sum()
    assert row.retained == pytest.approx(kept) and row.components == (m if kept >= 0.85 else x.shape[1]) and row.n == len(x)


def test_budget_grid_query(spark, sf):
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    top = min(int(5 * math.sqrt(n)), math.ceil(n / 2)) if n < 200 else min(300, max(10, math.ceil(0.1 * n)))
    got = [r["size"] for r in registry.QUERIES["budget_grid"](spark, sf).orderBy("place").collect()]
    assert got == list(range(min(20, math.ceil(0.01 * n)), top + 1))


def test_command_line(spark, tmp_path):
    from lodestone import __main__ as cli

    pd.DataFrame({"id": [f"m{i}" for i in range(20)], "x": [float(i * i % 17) for i in range(20)], "z": [float(i % 7) for i in range(20)]}).to_csv(tmp_path / "t.csv", index=False)
    assert cli.main(["cluster", "--input", str(tmp_path / "t.csv"), "--output", str(tmp_path / "out"), "--key", "ID", "--n_points", "4"]) == 0
    out = spark.read.csv(str(tmp_path / "out/batch_0"), header=True, inferSchema=True)
    assert out.where("batch = 0").count() == 4 and out.columns == ["id", "x", "z", "batch"]
    assert cli.main(["cluster", "--input", str(tmp_path / "t.csv"), "--output", str(tmp_path / "o2"), "--bad", "1"]) == 2
    assert cli.options_of(ClusterOptions, {"ignore": "[a, b]", "no_auto_fill": "", "n_points": "x"}) == ClusterOptions(ignore=("a", "b"), auto_fill=False)


def test_options_fall_back():
    o = ClusterOptions(mode="x", missing=3.0, n_points=-1)
    assert (o.mode, o.missing, o.n_points) == ("representative", 0.30, None) and LearnOptions(tolerance="wide").delta == 0.10


# Sources, text, streams


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_row_ids_of_two_million_rows_are_dense_and_in_order(spark, adaptive):
    from pyspark.sql import Window

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 2_000_000
        df = spark.range(0, n, 1, 8).select(F.xxhash64("id").alias("k"), F.lit("x").alias("__place"))
        out = files.with_row_id(df, ["k"])
        assert tuple(out.agg(F.min("row_id"), F.max("row_id"), F.count_distinct("row_id"), F.count("*")).first()) == (0, n - 1, n, n)
        assert out.withColumn("p", F.lag("k").over(Window.orderBy("row_id"))).where("p >= k").count() == 0
        assert out.columns == ["k", "__place", "row_id"]
        plain = files.with_row_id(df)
        assert tuple(plain.agg(F.min("row_id"), F.max("row_id"), F.count_distinct("row_id")).first()) == (0, n - 1, n)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_no_shared_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace as N

    from lodestone import session

    sc = N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isEmpty=lambda: True))))
    with pytest.raises(RuntimeError):
        session.shared_dir(N(conf=N(get=lambda *_: None), sparkContext=sc))


def test_files_by_name(spark, tmp_path):
    for folder in ("batch_10", "batch_2"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "t.csv").write_text("a\n1\n")
    assert files.find_batch_file(spark, str(tmp_path), "t.csv").endswith("batch_2/t.csv")
    (tmp_path / "t.csv").write_text("a\n1\n")
    assert files.find_batch_file(spark, str(tmp_path), "t.csv").endswith(f"{tmp_path.name}/t.csv")
    with pytest.raises(FileNotFoundError):
        files.find_batch_file(spark, str(tmp_path), "u.csv")
    with pytest.raises(hygiene.UnsupportedFormat):
        files.read_table(spark, "x.sdf")


def test_row_ids_and_nan(spark):
    df = spark.createDataFrame([(float("nan"), "b"), (2.0, "a"), (None, "c")], "v double, k string")
    assert [r.k for r in files.with_row_id(df, ["k"]).orderBy("row_id").collect()] == ["a", "b", "c"]
    assert sorted(r.row_id for r in files.with_row_id(df).collect()) == [0, 1, 2]
    assert files.nan_to_null(df).where("v is null").count() == 2


def test_text(spark):
    df = spark.createDataFrame([("a_b12", "Test : R2 = 0.8, MAE = 0.2, RMSE = 0.34\nScore 8"), ("x", "Valid. : R2 = 0.8, MAE = 0.2, RMSE = 0.44\nScore 6"), (None, "coefficient variation, 4*SD = 1.20")], "n string, t string")
    r = df.select(S.base_name(F.col("n")), S.report_rmse(F.col("t")), S.report_score(F.col("t")), S.report_sd(F.col("t"))).collect()
    assert tuple(r[0])[:3] == ("a", 0.34, 8) and tuple(r[1])[:3] == ("x", 0.44, 6) and tuple(r[2])[1:] == (None, None, pytest.approx(0.3))


def test_history_follows_a_stream(spark, tmp_path):
    from lodestone.streaming import rounds

    source = str(tmp_path / "labels")
    schema = "row_id long, y double"
    for k in range(3):
        spark.createDataFrame([(k, float(k))], schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        rounds.follow_history(stream, lambda rows, e: rows.sparkSession.createDataFrame([(e, 1.0, 0.5, 7)], "batch int, rmse double, SD double, score int"), str(tmp_path / "history"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.batch for r in rounds.read_history(spark, str(tmp_path / "history")).collect()) == [0, 1, 2]
    assert {r.convergence for r in rounds.verdict(spark, str(tmp_path / "history")).collect()} == {"no", "yes"}


def test_entry_keeps_the_core_queries_where_a_library_is_missing():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'convergence' in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
