"""Vector bin packing of training examples by the dot-product heuristic.

Examples are placed in packs under three limits at once: tokens, segments and loss-bearing tokens.
Examples are dealt into groups of about ``GROUP`` by a hash; each group is packed by itself, so the work is
linear in the corpus and a group costs one partly filled pack at most. In a group a pack is opened and
the example that fits and whose demand has the largest dot product with the pack's remaining room
(all as shares of the limits, weighted by the group's mean demand) is placed, until none fits. Equal demands are
placed as one class. Ties go to more tokens, then more loss-bearing tokens, then more segments, then the smaller id.

An example beyond a limit is cut into as few even parts as stay within the limits, each with one segment
at least; no token is dropped.

Defined results: null id: row ignored. Null or negative demands count as 0; an example without tokens is
placed too, with no cost but its segments (at least 1). Repeated rows of ``pack_examples`` and ``pack_documents`` are separate examples;
in ``pack_conversations`` every row is a turn, so a repeated row is one more turn of its conversation. An empty table gives
no packs. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch, ship
from . import _tokens as T

GROUP = 2048
SCHEMA = "pack_id long, tokens long, segments long, loss_tokens long, n_parts int, doc_ids array<long>, parts array<int>"


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 32
    loss: int = 3072


def pack(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The pack of each row of demand, which is sorted as ties go; every row is within the limits."""
    n = len(demand)
    out = np.full(n, -1, np.int64)
    if not n:
        return out
    kinds, of = np.unique(demand, axis=0, return_inverse=True)
    order = np.argsort(of.ravel(), kind="stable")
    count = np.bincount(of.ravel(), minlength=len(kinds))
    start = np.concatenate(([0], np.cumsum(count)))[:-1]
    # Classes in the order of their first row, so that the first of equal scores is right.
    by = np.argsort(order[start])
    kinds, count, start = kinds[by], count[by], start[by]
    share = kinds / limits
    weight = demand.mean(0) / limits
    used, number, live = np.zeros(len(kinds), np.int64), 0, np.arange(len(kinds))
    while len(live):
        room, held = limits.astype(np.int64).copy(), 0
        while True:
            fits = (kinds[live] <= room).all(1)
            if not fits.any():
                break
            score = np.where(fits, share[live] @ (weight * (room / limits)), -1.0)
            k = live[np.argmax(score)]
            row = order[start[k] + used[k]]
            out[row] = number
            used[k] += 1
            held += 1
            room -= kinds[k]
            if used[k] == count[k]:
                live = live[live != k]
                if not len(live):
                    break
        number += 1
    return out


def split(examples: DataFrame, limits: Limits) -> DataFrame:
    """(doc_id, part, tokens, segments, loss), each part within the limits."""
    clean = examples.select("doc_id", *[F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(least)).alias(c) for c, least in (("tokens", 0), ("segments", 1), ("loss", 0))])
    need = F.greatest(F.lit(1), *[F.ceil(F.col(c) / F.lit(m)) for c, m in (("tokens", limits.tokens), ("segments", limits.segments), ("loss", limits.loss))])
    parts = clean.withColumn("of", need.cast("long")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)))

    def piece(c: str) -> Column:
        return F.floor((F.col("part") + 1) * F.col(c) / F.col("of")) - F.floor(F.col("part") * F.col(c) / F.col("of"))

    return parts.select("doc_id", F.col("part").cast("int").alias("part"), piece("tokens").alias("tokens"), F.greatest(piece("segments"), F.lit(1)).alias("segments"), piece("loss").alias("loss"))


def pack_examples(examples: DataFrame, limits: Limits = Limits(), group: int = GROUP) -> DataFrame:
    """Packs of examples (doc_id, tokens, segments, loss): totals, and the ids and parts that each holds."""
    ship(examples.sparkSession)
    # Demands are a few numbers an example; written once, so that texts aren't tokenized again after the count.
    parts = Scratch(examples.sparkSession, "packing").save(split(examples.where(F.col("doc_id").isNotNull()), limits), "parts")
    groups = max(1, -(-parts.count() // group))
    limit = np.float64([limits.tokens, limits.segments, limits.loss])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tokens", "loss", "segments", "doc_id", "part"], ascending=[False, False, False, True, True], kind="stable")
        rows["bin"] = pack(rows[["tokens", "segments", "loss"]].to_numpy(np.int64), limit)
        g = rows.groupby("bin", sort=True)
        out = g.agg(tokens=("tokens", "sum"), segments=("segments", "sum"), loss_tokens=("loss", "sum"), n_parts=("part", "size"), doc_ids=("doc_id", list), parts=("part", list)).reset_index()
        out.insert(0, "pack_id", (int(rows["g"].iloc[0]) << 24) + out.pop("bin"))
        return out

    return parts.withColumn("g", F.pmod(F.xxhash64("doc_id", "part"), F.lit(groups))).groupBy("g").applyInPandas(run, SCHEMA)


def token_counts(df: DataFrame, text_col: str, more: list[Column], vocabulary: str = T.VOCABULARY) -> DataFrame:
    """The columns ``more`` and ``tokens``, the number of token ids of the text (0 if null)."""
    ship(df.sparkSession)
    data = T.ship_vocabulary(df.sparkSession, vocabulary)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = T.encoder(data.value)
        for texts in batches:
            yield pd.Series([len(T.encode(e, t)) if t else 0 for t in texts], dtype="int64")

    return df.select(*more, count(F.col(f"`{text_col}`").cast("string")).alias("tokens"))


def pack_conversations(df: DataFrame, limits: Limits = Limits(), vocabulary: str = T.VOCABULARY, turn_tokens: int = 4) -> DataFrame:
    """Instruction data: a conversation is an example of one segment; the assistant's turns bear loss. Each turn costs ``turn_tokens`` more for its markers."""
    turns = token_counts(df, "text", [F.col("conv_id").cast("long").alias("doc_id"), (F.lower(F.trim("role")) == "assistant").alias("answer")], vocabulary).withColumn("tokens", F.col("tokens") + turn_tokens)
    examples = turns.where("doc_id is not null").groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.lit(1).alias("segments"), F.coalesce(F.sum(F.when(F.col("answer"), F.col("tokens"))), F.lit(0)).alias("loss"))
    return pack_examples(examples, limits)


def pack_documents(df: DataFrame, limits: Limits = Limits(loss=4096), id_col: str = "doc_id", text_col: str = "text", vocabulary: str = T.VOCABULARY) -> DataFrame:
    """Documents: one segment each, ended by a token; all tokens bear loss."""
    counted = token_counts(df, text_col, [F.col(f"`{id_col}`").cast("long").alias("doc_id")], vocabulary)
    return pack_examples(counted.select("doc_id", (F.col("tokens") + 1).alias("tokens"), F.lit(1).alias("segments"), (F.col("tokens") + 1).alias("loss")), limits)
