"""The two workflows: choose rows that cover a table, and one round of active learning."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..config import ClusterOptions, LearnOptions
from ..functions.scalars import is_labeled
from ..operators import acquisition, clustering, density, encode, fits, hygiene, models, search, stats
from ..operators import vectors as V
from ..session import Scratch
from ..sources.files import nan_to_null


log = logging.getLogger("lodestone")


@dataclass
class Selection:
    """The table with batch 0 on the chosen rows, and what was found on the way."""

    table: DataFrame
    selected: DataFrame
    regions: DataFrame
    coverage: DataFrame
    importance: DataFrame
    payload: DataFrame
    removed: dict[str, str]
    cells: V.MapCells | None = None
    budgets: list[search.Budget] = field(default_factory=list)
    candidates: list[clustering.Candidate] = field(default_factory=list)
    summary: DataFrame | None = None
    cluster_importance: DataFrame | None = None
    quality: str = "UNAVAILABLE"


def prepare(df: DataFrame, options: ClusterOptions, key: str) -> tuple[DataFrame, DataFrame, list[str], dict[str, str]]:
    """The clean table, its features (row_id, features), the descriptors that stay and why the others go."""
    df = nan_to_null(df)
    df = hygiene.dedup_rows(df, [key])
    if hygiene.duplicate_keys(df, [key]).limit(1).count():
        raise hygiene.DuplicateKey(f"{key} is not unique")
    for name, error in ((options.name, hygiene.MissingName), (options.y, hygiene.MissingTarget)):
        if name and name not in df.columns:
            raise error(f"there is no column {name}")
    if missing := [c for c in options.ignore if c not in df.columns]:
        raise hygiene.UnknownIgnored(f"there are no columns {', '.join(missing)} to ignore")
    skip = [key, "batch", *filter(None, (options.name, options.y)), *hygiene.sanitize_ignore(df, list(options.ignore))]
    _, columns = hygiene.split_columns(df, skip)

    def ready(d: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
        words = [c for c, t in d.dtypes if c in cols and t == "string"]
        cols = [c for c in cols if c not in words]
        if words and options.categorical == "onehot":
            d, new = encode.one_hot(d, words)
            cols = cols + new
        else:
            for c in words:
                d = encode.ordinal(d, c)
            cols = cols + words
        gaps = d.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
        if any(gaps):
            if not options.auto_fill:
                raise hygiene.MissingValues(f"missing values in {', '.join(c for c in cols if gaps[c])}")
            near = options.impute == "knn"
            if near and (n := d.where(hygiene.any_of([F.col(f"`{c}`").isNull() for c in cols])).limit(options.impute_rows + 1).count()) > options.impute_rows:
                log.warning("more than %d rows have gaps: they are filled with means, since each would be compared with all rows", n - 1)
                near = False
            d = encode.knn_impute(d, key, cols) if near else encode.mean_impute(d, cols)
        return d, cols

    clean, columns, why = stats.clean_columns(df, columns, options.missing, options.near_constant, options.correlation, ready)
    z = encode.standardize(clean, columns)
    features = Scratch(df.sparkSession, "features").save(V.features_of(z, columns, key), "scaled")
    return df, features, columns, why


def measure(features: DataFrame, xy: DataFrame, sample: DataFrame, n: int, seed: int) -> tuple[search.Budget, DataFrame]:
    chosen = V.representative_select(features, n, seed)
    rows = features.join(F.broadcast(chosen) if n <= V.BLOCK else chosen, "row_id")
    gap = V.average_gap(sample, rows).first()[0]
    return search.Budget(n, gap, V.coverage_2d(xy, chosen).first()["area"]), chosen


def evaluate_selection(features: DataFrame, xy: DataFrame, chosen: DataFrame, explained: float | None) -> tuple[DataFrame, DataFrame]:
    """How well chosen rows (row_id) cover a table, in one row: the map's coverage, the average gap, the map's quality and the verdict in words; and the regions."""
    regions = V.nearest(features, features.join(chosen.select("row_id"), "row_id"))
    row = V.coverage_2d(xy, chosen).crossJoin(regions.agg(F.avg("dist").alias("avg_gap"))).first().asDict()
    row |= {"explained": explained, "map_quality": encode.visual_quality(explained), "verdict": V.interpret_coverage(row["area"], row["filling"])}
    schema = "area double, filling double, grid double, visual double, avg_gap double, explained double, map_quality string, verdict string"
    return features.sparkSession.createDataFrame([tuple(row.values())], schema), regions


def cluster(df: DataFrame, key: str, options: ClusterOptions = ClusterOptions(), descriptors: Callable[[DataFrame], DataFrame] | None = None) -> Selection:
    """Clean, scale, maybe reduce; choose rows (how many: given, or where more bring little); say how well they cover.

    ``descriptors`` may compute more columns: from the table it makes one with the key and those columns, a row for each row.
    """
    if descriptors:
        try:
            more = descriptors(df)
        except Exception as e:
            raise hygiene.DescriptorsFailed(str(e)) from e
        df = hygiene.attach(df, more, key, guard=True)
    if options.evaluate and "batch" not in df.columns:
        raise hygiene.BatchState("there is no batch 0 to evaluate")
    if "batch" in df.columns and not options.evaluate and hygiene.seed_set(df).limit(1).count():
        raise hygiene.BatchState("the table has a batch 0 already; evaluate it, or drop the column")
    df, raw, columns, why = prepare(df, options, key)
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "cluster")
    features, reduced = encode.pca_safeguard(raw, gate=options.pca_columns, target=options.pca_target, minimum=options.pca_minimum)
    if reduced["applied"]:
        features = scratch.save(features, "reduced")
    mapped, explained = encode.map_2d(features)
    n, xy = features.count(), scratch.save(mapped.select("row_id", "x", "y"), "map")
    budgets, candidates, quality, labels = [], [], "UNAVAILABLE", None
    if options.evaluate:
        chosen = hygiene.seed_set(df).select(F.col(key).cast("long").alias("row_id"))
        if not chosen.limit(1).count():
            raise hygiene.BatchState("there is no batch 0 to evaluate")
    else:
        size = options.n_points
        if size is None:
            sample = scratch.save(V.coverage_sample(features, options.coverage_sample, options.seed), "sample")
            best, budgets = search.auto_budget(n, lambda k: measure(features, xy, sample, k, options.seed)[0], search.budget_grid(n, options.max_points, min_points=options.min_points))
            size = best.size
        if size > n:
            raise hygiene.TooManyPoints(f"{size} rows can't be chosen from {n}")
        if options.mode == "natural":
            candidates, quality, labels = natural_model(features, options)
            chosen = select_natural(features, labels, size, options.seed) if labels is not None else V.representative_select(features, size, options.seed)
        elif options.mode == "exploratory":
            chosen = V.exploratory_select(features, size, options.seed).select("row_id")
        else:
            chosen = V.representative_select(features, size, options.seed)
        chosen = scratch.save(chosen, "chosen")
    coverage, regions = evaluate_selection(features, xy, chosen, explained)
    regions = scratch.save(regions, "regions")
    names = [f"d{i}" for i in range(len(columns))]
    wide = raw.select("row_id", *[F.col("features")[i].alias(c) for i, c in enumerate(names)])
    named = lambda t: t.replace(dict(zip(names, columns, strict=True)), subset=["descriptor"])
    importance = named(stats.anova_importance(wide.join(regions.select("row_id", F.col("region").alias("label")), "row_id"), names))
    payload = V.viewer_payload(xy, regions, chosen, wide.toDF("row_id", *columns), columns)
    table = df if options.evaluate else hygiene.batch_last(hygiene.assign_batch(df.withColumn("batch", F.lit(None).cast("int")), chosen.select(F.col("row_id").alias(key)), 0, key))
    clusters = named(stats.anova_importance(wide.join(labels.select("row_id", "label"), "row_id"), names)) if labels is not None else None
    summary = clustering.summary(spark, candidates) if candidates else None
    return Selection(hygiene.sort_by_batch(table, key), chosen, regions, coverage, importance, payload, why, V.map_cells(xy, chosen), budgets, candidates, summary, clusters, quality)


def select_natural(features: DataFrame, labels: DataFrame, size: int, seed: int) -> DataFrame:
    """(row_id): rows of natural groups by their shares, topped up by representatives of the rest if groups give fewer."""
    chosen = V.natural_select(labels, size, seed=seed).select("row_id")
    rows = chosen.sparkSession.createDataFrame(chosen.collect(), "row_id long")  # size rows at most
    short = size - rows.count()
    return rows.union(V.representative_select(features.join(rows, "row_id", "left_anti"), short, seed).select("row_id")) if short > 0 else rows


def natural_model(features: DataFrame, options: ClusterOptions) -> tuple[list[clustering.Candidate], str, DataFrame | None]:
    """Candidates of all families, the winner's quality and its labels (row_id, features, label).

    Up to ``fits.MOST_ROWS`` rows the candidates of a family are fitted at once, a task each; larger tables have k-means by distributed passes.
    """
    features, _ = encode.pca_safeguard(features, gate=options.pca_columns, target=options.pca_target, minimum=options.pca_minimum)
    n = features.count()
    tier = clustering.tier(n)
    s, top = clustering.SETTINGS[tier], clustering.k_max(n, options.max_clusters)
    local = fits.Local(features) if tier != "ultra_large" else None
    repeats = s["repeats"] if tier == "standard" else 0
    found, winners = [], []

    def fitted(candidates: list[clustering.Candidate], repeats: int) -> list[clustering.Candidate]:
        if local:
            return clustering.evaluate_local(local, candidates, s["silhouette"], repeats)
        return [clustering.evaluate_large(features, c, s["silhouette"], repeats) for c in candidates]

    for family in options.families:
        if family != "kmeans" and not local:
            continue
        if family == "kmeans":
            part: list[clustering.Candidate] = []

            def worth(ks: list[int], part=part) -> list[float]:
                new = fitted([clustering.Candidate("kmeans", {"k": k, "n_init": s["n_init"], "max_iter": s["max_iter"]}) for k in ks], repeats)
                part += new
                return [clustering.search_objective(c.metrics, bool(c.reasons)) for c in new]

            ks = list(range(2, top + 1))
            if tier != "standard" and len(ks) > 10:
                search.IntegerSearch(worth, 2, top).run()
            else:
                worth(ks)
        elif family == "gmm":
            part = fitted([clustering.Candidate("gmm", p) for p in clustering.mixture_shortlist(local, top, seed=options.seed)], repeats)
        else:
            part = fitted([clustering.Candidate("density", {"min_size": a, "min_samples": b}) for a, b in density.density_grid(n)], repeats)
        part.sort(key=lambda c: sorted(c.params.items(), key=str))
        clustering.internal_scores(part, family == "density")
        if s["refine"] and family != "gmm":
            clustering.refine(part, s["refine"], lambda best: fitted(best, s["repeats"]))
        found += part
        if (best := clustering.simplest(part)) is not None:
            winners.append(best)
    clustering.final_scores(winners)
    best = clustering.simplest(winners, "final", 0.05)
    labels = None
    if best:
        labels = features.select("row_id", "features").join(local.labelled(best.labels), "row_id") if local else best.labels
    if local:
        local.close()
    return found, clustering.quality_label(best.metrics, best.final) if best else "UNAVAILABLE", labels


@dataclass
class Round:
    """The table with the next batch on the chosen rows, the ranking, and the history with its verdict."""

    table: DataFrame
    ranking: DataFrame
    strategy: acquisition.Strategy
    history: DataFrame
    number: int


def learn(df: DataFrame, key: str, columns: list[str], options: LearnOptions = LearnOptions(), fit_predict: models.FitPredict | None = None, history: DataFrame | None = None) -> Round:
    """One round: train on labeled rows, rank the pool by the strategy that the model's score calls for, assign the next batch; the latest batch comes first."""
    df = nan_to_null(df)
    if "batch" not in df.columns:
        df = df.withColumn("batch", F.lit(None).cast("int"))
    df = hygiene.bootstrap_batches(df, options.y)
    number = hygiene.next_batch(df, options.y).first()["next_batch"]
    fit_predict = fit_predict or models.ensemble(columns, options.y, key=key)
    train = hygiene.labeled(df).where(is_labeled(F.col(options.y)))
    m = models.model_metrics(fit_predict, train, options.y, key)
    strategy = acquisition.resolve_strategy(m["score"], options.mode, options.alpha, options.objective)
    predicted = Scratch(df.sparkSession, "round").save(fit_predict(train, hygiene.pool(df)), "predicted")
    if acquisition.all_equal(predicted).first()["stop"]:
        raise hygiene.EqualPredictions("all predictions are equal")
    kind = "uncertainty" if strategy.strategy == "model" else strategy.objective
    ranking = acquisition.rank_candidates(predicted, kind, strategy.alpha or 0.0, key, options.n_exps)
    now = df.sparkSession.createDataFrame([(number - 1, m["rmse"], m["SD"], m["score"])], "batch int, rmse double, SD double, score int")
    full = now if history is None else acquisition.upsert_history(history.select("batch", "rmse", "SD", "score"), now)
    table = hygiene.sort_by_batch(hygiene.assign_batch(df, ranking, number, key), key, latest_first=True)
    return Round(table, ranking, strategy, acquisition.convergence(full, options.delta, options.patience), number)
