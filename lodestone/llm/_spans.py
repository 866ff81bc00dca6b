"""Cutting spans of code points from texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.files import unused


def cut_spans(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the spans (doc_id, text_hash, spans array<struct<start,end>>, not overlapping) cut from its texts, by Spark expressions alone."""
    text = F.col(f"`{text_col}`")
    names = []
    for name in ("id", "hash", "spans", "cut"):
        names.append(unused(name, [*df.columns, *names]))
    key, digest, cuts, left = names
    spans = spans.select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest), F.sort_array("spans").alias(cuts))
    joined = df.join(spans, (F.col(f"`{id_col}`").cast("long") == F.col(f"`{key}`")) & (F.xxhash64(text.cast("string")) == F.col(f"`{digest}`")), "left")
    found = F.col(f"`{cuts}`")
    begins = F.concat(F.array(F.lit(0)), F.transform(found, lambda s: s["end"]))
    ends = F.concat(F.transform(found, lambda s: s["start"]), F.array(F.length(text)))
    parts = F.zip_with(begins, ends, lambda a, b: text.substr(a + F.lit(1), F.greatest(b - a, F.lit(0))))
    out = joined.withColumn(left, F.when(found.isNotNull(), F.array_join(parts, "")).otherwise(text))
    out = out.where(found.isNull() | F.col(f"`{left}`").rlike(r"[\p{L}\p{N}]"))
    return out.select(*[F.col(f"`{left}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])
