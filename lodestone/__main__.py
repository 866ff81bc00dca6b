"""Command line: ``python -m lodestone cluster --input x.csv --output out [--option value]`` and ``... al ...``.

Every field of the workflows' options is an option; ``--no_x`` turns a flag off, lists are comma-separated. A value that can't be
used takes its default, with a warning.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from .config import ClusterOptions, LearnOptions
from .operators import hygiene
from .plans import workflows
from .session import local_session
from .sources import files


def options_of(kind: type, given: dict[str, str]):
    """An options object from texts."""
    values = {}
    for f in dataclasses.fields(kind):
        if f"no_{f.name}" in given:
            values[f.name] = False
        elif f.name in given:
            text = given[f.name]
            if f.type.startswith("tuple"):
                values[f.name] = tuple(x.strip() for x in text.strip("[]").split(",") if x.strip())
            elif f.type.startswith("bool"):
                values[f.name] = text.lower() in {"true", "yes", "1", ""}
            elif f.type.startswith(("int", "float")):
                try:
                    values[f.name] = (int if f.type.startswith("int") else float)(text)
                except ValueError:
                    print(f"--{f.name} {text!r} is no number; the default is used", file=sys.stderr)
            else:
                values[f.name] = text
    return kind(**values)


def parse(args: list[str]) -> tuple[argparse.Namespace, dict[str, str]]:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    p.add_argument("command", choices=["cluster", "al"])
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--key", help="unique key column; without it rows are numbered in their order")
    p.add_argument("--features", help="feature columns of al; all numeric ones without it")
    known, rest = p.parse_known_args(args)
    given, i = {}, 0
    while i < len(rest):
        name = rest[i].lstrip("-").replace("-", "_")
        has = i + 1 < len(rest) and not rest[i + 1].startswith("--")
        given[name] = rest[i + 1] if has else ""
        i += 2 if has else 1
    return known, given


def main(args: list[str]) -> int:
    known, given = parse(args)
    kind = ClusterOptions if known.command == "cluster" else LearnOptions
    if unknown := [n for n in given if n.removeprefix("no_") not in {f.name for f in dataclasses.fields(kind)}]:
        print(f"no such options: {', '.join(unknown)}", file=sys.stderr)
        return 2
    spark = local_session()
    try:
        try:
            df = files.read_table(spark, known.input)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                raise hygiene.InputNotFound(f"there is no {known.input}") from e
            raise
        if known.key:
            name = hygiene.resolve_column(df, known.key)
            if hygiene.duplicate_keys(df, [name]).limit(1).count():
                raise hygiene.DuplicateKey(f"{name} is not unique")
            given.setdefault("name", name) if known.command == "cluster" else None
        df = files.with_row_id(df, [name] if known.key else None)
        options = options_of(kind, given)
        if known.command == "cluster":
            s = workflows.cluster(df, "row_id", options)
            files.write_csv(s.table.drop("row_id"), f"{known.output}/batch_0")
            files.write_csv(s.importance, f"{known.output}/coverage_descriptor_importance")
            s.payload.write.mode("overwrite").json(f"{known.output}/map")
            if s.summary is not None:
                files.write_csv(s.summary.withColumn("sizes", F.array_join("sizes", " ")), f"{known.output}/clustering_models")
            s.coverage.show()
        else:
            columns = known.features.split(",") if known.features else [c for c, t in df.dtypes if t in {"double", "float", "int", "bigint"} and c not in {"row_id", "batch", options.y, known.key, *options.ignore}]
            r = workflows.learn(df, "row_id", columns, options)
            files.write_csv(r.table.drop("row_id"), f"{known.output}/batch_{r.number}")
            r.ranking.show()
        return 0
    except hygiene.TableError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return e.code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
