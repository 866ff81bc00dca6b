"""Tables from and to files: CSV, parquet, batch directories; row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import Scratch


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV with a header; types are inferred only without a schema. Blank headers get their place as a name."""
    if schema is not None:
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.csv(path, header=True, inferSchema=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By the file's ending: CSV, JSON, ORC or parquet; a path without an ending is a parquet table."""
    from ..operators.hygiene import UnsupportedFormat

    name = path.rstrip("/").rsplit("/", 1)[-1]
    kind = name.rsplit(".", 1)[-1].lower() if "." in name else "parquet"
    if kind not in {"csv", "tsv", "json", "orc", "parquet"}:
        raise UnsupportedFormat(f"{name}: .{kind} files can't be read")
    if kind in {"csv", "tsv"}:
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if kind == "tsv" else ",")
    return spark.read.format(kind if kind in {"json", "orc"} else "parquet").load(path)


def find_batch_file(spark: SparkSession, root: str, name: str) -> str:
    """The path of a file by its name: in the folder itself, else in the first of its batch_* folders by number."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(hadoop)
    direct = jvm.org.apache.hadoop.fs.Path(base, name)
    if system.exists(direct):
        return direct.toString()
    number = lambda n: (0, int(n[6:])) if n[6:].isdigit() else (1, n)
    folders = [s.getPath() for s in (system.globStatus(jvm.org.apache.hadoop.fs.Path(base, "batch_*")) or ()) if s.isDirectory()]
    for folder in sorted(folders, key=lambda f: number(f.getName())):
        path = jvm.org.apache.hadoop.fs.Path(folder, name)
        if system.exists(path):
            return path.toString()
    raise FileNotFoundError(f"{name} is neither in {root} nor in its batch folders")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL both mean missing; only NULL sorts and counts as such."""
    floats = {c for c, t in df.dtypes if t in {"double", "float"}}
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in floats else F.col(c) for c in df.columns])


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column (in any case) has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
_ROW_BITS = 33


def with_row_id(df: DataFrame, order: list[str | Column] | None = None, name: str = "row_id") -> DataFrame:
    """A dense row number 0..n-1 in the order of the given keys; without keys, in the order in which partitions hold the rows.

    With keys the rows are partitioned by ranges of them and sorted within. Each row gets its partition and its place there, and the
    table is written to the shared folder once: ranges come from a sample, so another execution may draw them differently, and only
    the written table's partitions are the ones that are counted. A row's number is its place after all partitions before; one count a
    partition comes to the driver. Ties of the keys are in any order, but always the same.
    """
    spark, tag = df.sparkSession, unused("__place", [*df.columns, name])
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    saved = Scratch(spark, "rows").save(parts.withColumn(tag, F.monotonically_increasing_id()), "placed")
    part, place = F.shiftright(tag, _ROW_BITS), F.col(f"`{tag}`").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    starts, total = [], 0
    for p, n in sorted((r[0], r[1]) for r in saved.groupBy(part).count().collect()):
        starts.append((p, total))
        total += n
    # One row a partition: of the size of the task list, so it may be broadcast.
    before, at, of = F.broadcast(spark.createDataFrame(starts, "p long, n long")), unused("__before", [*df.columns, name, tag]), unused("__part", [*df.columns, name, tag])
    before = before.select(F.col("p").alias(of), F.col("n").alias(at))
    columns = [F.col(f"`{c}`") for c in df.columns if c != name]
    return saved.join(F.broadcast(before), part == F.col(f"`{of}`")).select(*columns, (F.col(f"`{at}`") + place).cast("long").alias(name))


def write_batches(df: DataFrame, path: str, batch: str = "batch") -> None:
    df.write.mode("overwrite").partitionBy(batch).parquet(path)


def scan_batches(spark: SparkSession, path: str, batch: str = "batch") -> DataFrame:
    """Batches from 1 on; batch 0 and what is no number are pruned before any file is read."""
    return spark.read.parquet(path).where(F.col(batch) > 0)


def point_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Training and test points of each model."""
    return df.groupBy(*by).agg(F.count_if(F.coalesce(F.col("Set") == "Training", F.lit(False))).alias("training"), F.count_if(F.coalesce(F.col("Set") == "Test", F.lit(False))).alias("test"))
