"""Scalar expressions used by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_number(c: Column) -> Column:
    """A number where the text is one, else NULL; NaN counts as NULL."""
    return F.nanvl(c.cast("string").try_cast("double"), F.lit(None).cast("double"))


def is_finite(c: Column) -> Column:
    x = c.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def is_labeled(y: Column) -> Column:
    """A target counts if it is there and not blank."""
    return y.isNotNull() & (F.trim(y.cast("string")) != "")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of doubles."""
    return F.sqrt(squared_distance(a, b))


def clamp(c: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(low), F.least(lit(high), c))


def grid_cell(x: Column, low: Column, high: Column, cells: Column | int) -> Column:
    """The cell of equal-width bins over the slightly widened range, clamped to 0..cells-1."""
    n = cells if isinstance(cells, Column) else F.lit(cells)
    span = high - low
    first, width = low - 0.001 * span, (1.002 * span) / n
    return F.when(span == 0, F.lit(0)).otherwise(clamp(F.floor((x - first) / F.nullif(width, F.lit(0.0))), F.lit(0), n - 1)).cast("int")


def quartile_right_closed(x: Column, low: Column, high: Column) -> Column:
    """q1..q4 over equal widths whose upper edges belong to the bin; one value: q1."""
    step = (high - low) / 4
    return F.when(x <= low + step, "q1").when(x <= low + 2 * step, "q2").when(x <= low + 3 * step, "q3").otherwise("q4")


def quartile_left_closed(x: Column, low: Column, high: Column) -> Column:
    """q1..q4 over equal widths whose upper edges belong to the next bin."""
    step = (high - low) / 4
    return F.when(x < low + step, "q1").when(x < low + 2 * step, "q2").when(x < low + 3 * step, "q3").otherwise("q4")


def cell_text(c: Column, width: int, right: bool = False) -> Column:
    """Text of a fixed width: cut with '...' if longer, padded otherwise."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    cut = F.when(F.length(t) > width, F.concat(F.substring(t, 1, width - 3), F.lit("..."))).otherwise(t)
    return F.lpad(cut, width, " ") if right else F.rpad(cut, width, " ")


def base_name(c: Column) -> Column:
    """A file's base name without a trailing batch number: 'x_b12' -> 'x'."""
    return F.when(c.rlike(r"^.*_b\d+$"), F.regexp_extract(c, r"^(.*)_b\d+$", 1)).otherwise(c)


def report_rmse(text: Column) -> Column:
    """RMSE of the test set, else of the validation set, from a report's text."""

    def one(name: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf"{name}\s*:.*?RMSE\s*=\s*([0-9]+\.?[0-9]*)", 1), F.lit("")).try_cast("double")

    return F.coalesce(one("Test"), one(r"Valid\."))


def report_score(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"[Ss]core\s+(\d+)", 1), F.lit("")).try_cast("int")


def report_sd(text: Column) -> Column:
    """The report prints four standard deviations."""
    return F.nullif(F.regexp_extract(text, r"4\*SD\s*=\s*([0-9]+\.?[0-9]*)", 1), F.lit("")).try_cast("double") / 4


def score_label(score: Column) -> Column:
    """How good a model is by its score of 0 to 10."""
    return F.when(score.isNull(), "unavailable").when(score <= 3, "very weak").when(score <= 6, "weak to moderate").when(score <= 8, "good").otherwise("strong")
