"""Table hygiene: identity, filters, de-duplication, column cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import is_labeled


class TableError(ValueError):
    """A table that can't be used; the message says why, ``code`` is the command line's exit status."""

    code = 1


def _kind(name: str, code: int, doc: str) -> type[TableError]:
    return type(name, (TableError,), {"code": code, "__doc__": doc, "__module__": __name__})


BatchState = _kind("BatchState", 1, "Batches that the mode can't go on from: a seed set where none may be, or none where one must be.")
MissingColumn = _kind("MissingColumn", 2, "A column that the operation needs isn't there.")
MissingTarget = _kind("MissingTarget", 3, "The target column isn't there.")
MissingName = _kind("MissingName", 4, "The name column isn't there.")
UnknownIgnored = _kind("UnknownIgnored", 5, "Ignored columns that aren't there.")
MissingValues = _kind("MissingValues", 6, "Missing values, and filling in is off.")
TooFewColumns = _kind("TooFewColumns", 7, "Too few descriptor columns are left.")
DuplicateKey = _kind("DuplicateKey", 8, "A key of several rows.")
MissingInput = _kind("MissingInput", 9, "No input was named.")
InputNotFound = _kind("InputNotFound", 10, "The input doesn't exist.")
OrphanTarget = _kind("OrphanTarget", 11, "Rows with a target but without a batch.")
DescriptorsFailed = _kind("DescriptorsFailed", 12, "The caller's descriptor function failed.")
NameRequired = _kind("NameRequired", 13, "A name column is needed.")
IncompleteBatch = _kind("IncompleteBatch", 14, "Rows of the last batch have no target.")
NoTargets = _kind("NoTargets", 15, "Neither batches nor targets.")
DuplicateColumn = _kind("DuplicateColumn", 16, "Several columns of one name.")
EqualPredictions = _kind("EqualPredictions", 17, "All predictions are equal.")
RowCountMismatch = _kind("RowCountMismatch", 18, "Tables that are joined row by row have different numbers of rows.")
TooManyPoints = _kind("TooManyPoints", 19, "More rows are asked for than there are.")
UnsupportedFormat = _kind("UnsupportedFormat", 20, "A file format that can't be read.")


# Columns


def resolve_column(df: DataFrame, name: str, unique: bool = False) -> str:
    """The column's own spelling: exact first, then in any case; more than one spelling is an error if ``unique``."""
    alike = [c for c in df.columns if c.lower() == name.lower()]
    if not alike:
        raise MissingColumn(f"there is no column {name!r}")
    if unique and len(alike) > 1:
        raise DuplicateColumn(f"the table has {', '.join(alike)}")
    return name if name in df.columns else alike[0]


def split_columns(df: DataFrame, ignore: list[str], user: list[str] = ()) -> tuple[list[str], list[str]]:
    """Metadata and descriptor columns; names that the user gave must exist, others may be missing."""
    if missing := [c for c in user if c not in df.columns]:
        raise MissingColumn(f"no such columns: {', '.join(missing)}")
    skip = set(ignore) | set(user)
    return [c for c in df.columns if c in skip], [c for c in df.columns if c not in skip]


def sanitize_ignore(df: DataFrame, ignore: list[str]) -> list[str]:
    """Existing names, each once, in order."""
    return [c for c in dict.fromkeys(ignore) if c in df.columns]


def batch_last(df: DataFrame, batch: str = "batch") -> DataFrame:
    return df.select(*[c for c in df.columns if c != batch], batch)


def sort_by_batch(df: DataFrame, key: str, batch: str = "batch", latest_first: bool = False) -> DataFrame:
    """In the order of batches, rows without one last; within a batch by key. A range sort: partitions hold the order, none holds all rows."""
    return df.orderBy(F.desc_nulls_last(batch) if latest_first else F.asc_nulls_last(batch), key)


# Rows


def labeled(df: DataFrame, batch: str = "batch") -> DataFrame:
    return df.where(F.col(batch).isNotNull())


def pool(df: DataFrame, batch: str = "batch") -> DataFrame:
    return df.where(F.col(batch).isNull())


def seed_set(df: DataFrame, batch: str = "batch") -> DataFrame:
    return df.where(F.col(batch).try_cast("double") == 0)


def last_batch_complete(df: DataFrame, y: str, batch: str = "batch") -> DataFrame:
    """(batch, complete): whether all rows of the largest batch have a target."""
    return df.where(F.col(batch).isNotNull()).groupBy(batch).agg(F.bool_and(is_labeled(F.col(y))).alias("complete")).orderBy(F.desc(batch)).limit(1)


def orphan_targets(df: DataFrame, y: str, batch: str = "batch") -> DataFrame:
    return df.where(is_labeled(F.col(y)) & F.col(batch).isNull())


def next_batch(df: DataFrame, y: str, batch: str = "batch") -> DataFrame:
    """(next_batch, bootstrap): one after the largest; without any batch, rows with targets become batch 0 and 1 is next."""
    top = F.max(F.col(batch).try_cast("double"))
    return df.agg(F.coalesce(top.cast("int") + 1, F.lit(1)).alias("next_batch"), (top.isNull() & F.bool_or(is_labeled(F.col(y)))).alias("bootstrap"))


def bootstrap_batches(df: DataFrame, y: str, batch: str = "batch") -> DataFrame:
    """With no batch at all, labeled rows become batch 0; else the table as it is. No target at all, a last batch without all its
    targets, and targets without a batch are errors."""
    state = df.agg(F.count(batch).alias("batches"), F.count_if(is_labeled(F.col(y)) & F.col(batch).isNull()).alias("orphans"), F.count_if(is_labeled(F.col(y))).alias("labeled")).first()
    if state["batches"] == 0:
        if not state["labeled"]:
            raise NoTargets(f"the table has no batch, and no target in {y}")
        return df.withColumn(batch, F.when(is_labeled(F.col(y)), F.lit(0)).cast("int"))
    last = last_batch_complete(df, y, batch).first()
    if not last["complete"]:
        raise IncompleteBatch(f"rows of batch {last[batch]} have no target")
    if state["orphans"]:
        raise OrphanTarget(f"{state['orphans']} rows have a target but no batch")
    return df


def assign_batch(df: DataFrame, chosen: DataFrame, number: int, key: str, batch: str = "batch") -> DataFrame:
    """The chosen keys get the number; a batch that a row already has wins."""
    mark = chosen.select(F.col(key), F.lit(number).alias("__new"))
    return df.join(mark, key, "left").withColumn(batch, F.coalesce(F.col(batch).cast("int"), F.col("__new"))).drop("__new")


def fill_in(df: DataFrame, imputed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Missing values from another table of the same key."""
    right = imputed.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return df.join(right, key, "left").select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


# De-duplication


def dedup_rows(df: DataFrame, order: list[str | Column], keys: list[str | Column] | None = None) -> DataFrame:
    """The first row, in the given order, of each set of rows that agree in the keys (all columns if None)."""
    if keys is None and order and all(isinstance(c, str) for c in order) and set(order) <= set(df.columns):
        return df.distinct()  # whole rows agree in the order too, so any of them is the first; partial aggregates go before the shuffle
    w = Window.partitionBy(*(keys or df.columns)).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key is not unique, with the number of copies."""
    return df.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("copies > 1")


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    return df.groupBy(value).agg(F.min(position).alias(position))


def duplicate_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns equal to an earlier one, NULLs included: cheap signatures first, then one exact comparison."""
    if len(columns) < 2:
        return []
    sums = df.agg(*[F.struct(F.count(c), F.min(c), F.max(c), F.bit_xor(F.xxhash64(F.col(c)))).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    pairs = [(i, j) for j in range(len(columns)) for i in range(j) if tuple(sums[i]) == tuple(sums[j])]
    if not pairs:
        return []
    same = df.agg(*[F.bool_and(F.col(columns[i]).eqNullSafe(F.col(columns[j]))).alias(f"p{i}_{j}") for i, j in pairs]).first()
    gone: list[int] = []
    for k, (i, j) in enumerate(pairs):
        if same[k] and i not in gone and j not in gone:
            gone.append(j)
    return [columns[j] for j in sorted(gone)]


# Joins by position


def attach(df: DataFrame, right: DataFrame, key: str = "row_id", guard: bool = False) -> DataFrame:
    """Columns of another table, row by row; ``guard``: both must have as many rows."""
    if guard and (a := df.count()) != (b := right.count()):
        raise RowCountMismatch(f"{a} rows can't be joined with {b}")
    return df.join(right, key)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
