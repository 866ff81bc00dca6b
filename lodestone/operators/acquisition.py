"""Active learning: which unlabeled rows to label next, and when to stop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import quartile_left_closed, quartile_right_closed
from ..sources.files import with_row_id


@dataclass(frozen=True)
class Strategy:
    strategy: str
    objective: str | None
    alpha: float | None
    score: float | None
    score_band: str
    score_source: str = "automatic"


def resolve_strategy(score: float | None, mode: str = "auto", alpha: float | None = None, objective: str | None = "max") -> Strategy:
    """Whether to learn (uncertainty) or to hunt (bound of the prediction), from the model's score or by hand."""
    if mode not in {"auto", "model", "hit"}:
        raise ValueError("mode must be auto, model or hit")
    if alpha is not None and not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")
    if mode == "model":
        if alpha is not None:
            raise ValueError("alpha has no use with mode model")
        return Strategy("model", None, None, score, "manual_model", "manual_override")
    if objective not in {"max", "min"}:
        raise ValueError("objective must be max or min")
    if mode == "hit":
        return Strategy("hit", objective, 1.0 if alpha is None else alpha, score, "manual_hit", "manual_override")
    if score is None or score <= 6:
        return Strategy("model", objective, None, score, "unknown" if score is None else "<=6")
    return Strategy("hit", objective, alpha if alpha is not None else 1.0 if score <= 8 else 0.5, score, "7-8" if score <= 8 else ">8")


def strategy_columns(score: Column) -> dict[str, Column]:
    """The automatic strategy as expressions, for many scores at once."""
    learn = score.isNull() | (score <= 6)
    return {
        "strategy": F.when(learn, "model").otherwise("hit"),
        "score_band": F.when(score.isNull(), "unknown").when(score <= 6, "<=6").when(score <= 8, "7-8").otherwise(">8"),
        "alpha": F.when(learn, F.lit(None).cast("double")).when(score <= 8, 1.0).otherwise(0.5),
    }


def best_score(no_pfi: Column, pfi: Column) -> dict[str, Column]:
    """The better of two model variants; PFI wins ties."""
    pick = F.when(pfi.isNull() | (no_pfi > pfi), "no_PFI").otherwise("PFI")
    return {"variant": pick, "score": F.greatest(no_pfi, pfi)}


def acquisition(df: DataFrame, kind: str, alpha: float = 1.0, pred: str = "y_pred", sd: str = "y_pred_sd") -> tuple[Column, list[Column]]:
    """The metric, and by what to sort, for 'uncertainty', 'max' or 'min'."""
    p, s = F.col(pred), F.col(sd)
    if kind == "uncertainty":
        return s, [s.desc_nulls_last(), p.desc_nulls_last()]
    if kind == "max":
        m = p + F.lit(alpha) * s
        return m, [m.desc_nulls_last(), p.desc_nulls_last(), s.desc_nulls_last()]
    if kind == "min":
        m = p - F.lit(alpha) * s
        return m, [m.asc_nulls_last(), p.asc_nulls_last(), s.desc_nulls_last()]
    raise ValueError("kind must be uncertainty, max or min")


def rank_candidates(df: DataFrame, kind: str, alpha: float = 1.0, key: str = "row_id", n: int | None = None, pred: str = "y_pred", sd: str = "y_pred_sd") -> DataFrame:
    """df with metric and rank; with n only the best n, by a top-k that sorts no more than it must; else all rows, ranked by ranges."""
    metric, order = acquisition(df, kind, alpha, pred, sd)
    ranked = df.withColumn("metric", metric)
    if n is None:
        return with_row_id(ranked, [*order, F.col(key)], "rank").withColumn("rank", F.col("rank") + 1)
    return ranked.orderBy(*order, key).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order, key)).cast("long"))


def preview(ranked: DataFrame, key: str = "row_id", digits: int = 4) -> DataFrame:
    """Rounded half to even, as a table to look at."""
    return ranked.select("rank", key, *[F.bround(c, digits).alias(c) for c in ("y_pred", "y_pred_sd", "metric")])


def all_equal(df: DataFrame, pred: str = "y_pred") -> DataFrame:
    """(stop): predictions of a single value can't be ranked."""
    return df.agg((F.count_distinct(pred) == 1).alias("stop"))


# Convergence


def convergence(history: DataFrame, tolerance: float = 0.05, patience: int = 2, variant: str = "") -> DataFrame:
    """history (batch, rmse, SD, score) with flags for the latest batches, and whether the model has converged.

    A metric has converged if it fell by no more than the tolerance, the score if it did not fall. If all hold
    for ``patience`` transitions, the last ``patience`` rows are 'yes'.
    """
    rmse, sd, score = (f"{c}{variant}" for c in ("rmse", "SD", "score"))
    w = Window.orderBy("batch")
    calm = lambda c: (F.lag(c).over(w) - F.col(c) >= 0) & (F.lag(c).over(w) - F.col(c) <= F.lit(tolerance) * F.lag(c).over(w))
    x = history.select("*", calm(rmse).alias("__r"), calm(sd).alias("__s"), (F.col(score) - F.lag(score).over(w) >= 0).alias("__c"), F.row_number().over(Window.orderBy(F.desc("batch"))).alias("__back"), F.count(F.lit(1)).over(Window.partitionBy()).alias("__n"))
    looked = F.col("__back") <= F.least(F.lit(patience), F.col("__n") - 1)
    flag = lambda c: F.when(looked & F.coalesce(F.col(c), F.lit(False)), 1).otherwise(0)
    x = x.select(*history.columns, "__back", flag("__r").alias("rmse_converged"), flag("__s").alias("SD_converged"), flag("__c").alias("score_converged"))
    all_calm = F.sum(F.when(F.col("__back") <= patience, F.col("rmse_converged") * F.col("SD_converged") * F.col("score_converged")).otherwise(0)).over(Window.partitionBy())
    return x.withColumn("convergence", F.when((all_calm >= patience) & (F.col("__back") <= patience), "yes").otherwise("no")).drop("__back")


def stop_recommended(history: DataFrame, patience: int = 2) -> DataFrame:
    """(stop, reason): no better score for ``patience`` batches, a score of 8 or more, or convergence."""
    w = Window.orderBy("batch")
    x = history.withColumn("__flat", F.coalesce(F.col("score") <= F.lag("score").over(w), F.lit(False))).withColumn("__back", F.row_number().over(Window.orderBy(F.desc("batch"))))
    a = x.agg(
        F.count_if(F.col("__flat") & (F.col("__back") <= patience)).alias("flat"),
        F.max_by("score", "batch").alias("score"),
        F.max_by("convergence", "batch").alias("convergence"),
    )
    why = F.when(F.col("convergence") == "yes", "converged").when(F.col("score") >= 8, "score").when(F.col("flat") >= patience, "no improvement")
    return a.select(why.isNotNull().alias("stop"), why.alias("reason"))


def upsert_history(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Older rows stay as they are; the latest is replaced if it is in the new ones; later ones are added."""
    top = existing.agg(F.max("batch").alias("__m"))
    old = existing.crossJoin(F.broadcast(top)).join(new.select(F.col("batch").alias("__b")).distinct(), F.col("batch") == F.col("__b"), "left")
    old = old.where((F.col("batch") < F.col("__m")) | F.col("__b").isNull()).select(*existing.columns)
    late = new.crossJoin(F.broadcast(top)).where(F.col("__m").isNull() | (F.col("batch") >= F.col("__m"))).select(*existing.columns)
    return old.unionByName(late)


def transitions(history: DataFrame, metric: str, tolerance: float = 0.05) -> DataFrame:
    """(batch, text): each batch against the one before, in a line."""
    w = Window.orderBy("batch")
    x = history.select("batch", F.col(metric).cast("double").alias("cur"), F.lag(F.col(metric).cast("double")).over(w).alias("prev")).where("prev is not null")
    less = F.when(F.col("cur") < F.col("prev"), "improved").when(F.col("cur") == F.col("prev"), "unchanged").otherwise("worsened")
    change = F.when(F.col("prev") == 0, 0.0).otherwise(F.try_divide(F.abs(F.col("prev") - F.col("cur")), F.abs("prev")) * 100)
    return x.select("batch", F.format_string("%s: %.4f -> %.4f | %s | change = %.2f%% | tolerance = %.2f%%", F.lit(metric), "prev", "cur", less, change, F.lit(tolerance * 100)).alias("text"))


# Quartiles of the target's range


def quartile_labels(df: DataFrame, value: str) -> DataFrame:
    """Quarters of the value's range, upper edges inside; a single value is all q1."""
    b = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return df.crossJoin(F.broadcast(b)).withColumn("quartile", quartile_right_closed(F.col(value), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def range_quartiles(everything: DataFrame, experimental: DataFrame, value: str) -> DataFrame:
    """(b0..b4, m1..m4): the experiments' range, 20 % wider on each side, ends moved to the closest value that occurs; edges and midpoints of its quarters."""
    r = experimental.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).select((F.col("lo") - 0.2 * (F.col("hi") - F.col("lo"))).alias("lo"), (F.col("hi") + 0.2 * (F.col("hi") - F.col("lo"))).alias("hi"))
    v = F.col(value)
    ends = everything.where(v.isNotNull()).crossJoin(F.broadcast(r)).agg(F.min_by(v, F.struct(F.abs(v - F.col("lo")), v)).alias("lo"), F.min_by(v, F.struct(F.abs(v - F.col("hi")), v)).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / 4
    return ends.select(*[(F.col("lo") + i * step).alias(f"b{i}") for i in range(5)], *[(F.col("lo") + (i + 0.5) * step).alias(f"m{i + 1}") for i in range(4)])


def quartile_of(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    return df.withColumn("quartile", quartile_left_closed(F.col(value), F.lit(low), F.lit(high)))


def diversity_order(df: DataFrame, n: int, key: str = "row_id", pred: str = "y_pred", sd: str = "y_pred_sd") -> list:
    """The first n rows, as (key, quartile), of the greedy order by sd less a penalty for quarters already served.

    Within a quarter the order never changes, so each gives its first n rows at most, and the driver merges those four lists.
    """
    q = quartile_labels(df, pred)
    top = q.agg(F.max(sd)).first()[0]
    if top is None:
        return []
    penalty, target = 0.15 * top, max(n / 4, 1)
    w = Window.partitionBy("quartile").orderBy(F.desc_nulls_last(sd), F.desc_nulls_last(pred), key)
    rows = q.where(F.col(sd).isNotNull()).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).orderBy("quartile", "__r").select("quartile", key, sd, pred).collect()
    streams: dict[str, list] = {}
    for r in rows:
        streams.setdefault(r[0], []).append(tuple(r)[1:])
    out, count = [], dict.fromkeys(streams, 0)
    while streams and len(out) < n:
        best = max(streams, key=lambda s: (streams[s][count[s]][1] - penalty * count[s] / target, streams[s][count[s]][1], streams[s][count[s]][2]))
        out.append((streams[best][count[best]][0], best))
        count[best] += 1
        if count[best] == len(streams[best]):
            del streams[best]
    return out


def explore_quartiles(df: DataFrame, n: int, counts: dict[str, int], midpoints: dict[str, float], exploit: bool = True, reverse: bool = False, key: str = "row_id", pred: str = "y_pred", sd: str = "y_pred_sd") -> list:
    """n rows, each time the most uncertain one of the least filled quarter, or if it is empty the row nearest its midpoint."""
    allowed = ["q2", "q3", "q4"] if exploit and reverse else ["q1", "q2", "q3"] if exploit else ["q1", "q2", "q3", "q4"]
    w = Window.partitionBy("quartile").orderBy(F.desc(sd), key)
    tops = df.withColumn("__r", F.row_number().over(w)).where((F.col("__r") <= n) & F.col("quartile").isin(allowed)).orderBy("quartile", "__r").collect()  # 4 n rows at most
    queue = {q: [r for r in tops if r["quartile"] == q] for q in allowed}
    filled, out = {q: counts.get(q, 0) for q in allowed}, []
    for _ in range(n):
        q = min(allowed, key=lambda k: filled[k])
        queue[q] = [r for r in queue[q] if r[key] not in out]
        if queue[q]:
            row = queue[q].pop(0)
        else:
            row = df.where(~F.col(key).isin(out) if out else F.lit(True)).orderBy(F.abs(F.col(pred) - F.lit(midpoints[q])), key).limit(1).first()
            if row is None:
                break
        out.append(row[key])
        filled[q] += 1
    return out
