"""Near-duplicate documents by MinHash signatures, banding, verification and connected components.

Similarity is the Jaccard index of the sets of ``shingle``-word phrases. ``bands * rows``
hash functions x -> (a x + b mod 2**64) >> 32, with odd a, give each document its minima; a
band is ``rows`` of them, and documents that agree in all of a band are candidates. Candidates
are verified by the share of equal minima (of which 16 bits are kept). Edges are turned into
components by alternating large-star and small-star.

Hot groups cost no pairs: documents of one signature hang on one of them; in each band's bucket
all hang on the bucket's smallest node, and only where that pair is refuted are the bucket's
other pairs looked at, by a search that visits each document once. A bucket of more than ``BLOCK`` documents is searched in
pairs of blocks, a task each, so that no task holds more than two blocks. The components are those of all verified candidate pairs.

A document is a text under an id: rows that agree in both are one document, and different texts under one id are
different documents, told apart by text_hash (xxhash64).

Defined results: null id: row ignored (kept by ``keep_one``). Null, empty or wordless text: never a duplicate, kept. Fewer words
than a phrase: the document is one phrase. Repeated rows of an id and text: one document; ``keep_one`` keeps one row, the one
whose columns have the smallest hash. Ties: the smallest doc_id of a group is kept, then the smallest text_hash. An empty
table gives an empty result. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import Scratch, ship
from ..sources.files import unused
from . import _words as W
from ._arrow import fixed_binary, lists, select_text

#: Documents of a bucket that one task searches against each other or against as many others.
BLOCK = 4096
#: Keys (two numbers each) of removed documents that are broadcast at most.
MOST_KEYS = 4_000_000
SHINGLE, BANDS, ROWS, THRESHOLD = 3, 40, 4, 0.5


def coefficients(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    a = r.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return a, r.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)


def shingle_hashes(w: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrase hashes and their documents, in order; a shorter document is one phrase."""
    p, rest, doc = W.phrases(w, k), W.left(w), w.doc
    ok = rest >= k
    n = np.diff(w.ptr)
    if len(short := np.flatnonzero((n > 0) & (n < k))):
        first = w.ptr[short]
        p[first] = [W.mix(np.uint64(m) + np.bitwise_xor.reduce(W.mix(w.hash[a : a + m] + np.arange(1, m + 1, dtype=np.uint64)), keepdims=True))[0] for a, m in zip(first, n[short], strict=True)]
        ok[first] = True
    return p[ok], doc[ok]


def signatures(texts: list, shingle: int = SHINGLE, n: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Which of the texts have words, and their minima (uint32)."""
    p, doc = shingle_hashes(W.words(texts), shingle)
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, np.int64)
    out = np.empty((len(first), n), np.uint32)
    if len(first):
        v = np.empty_like(p)
        for j, (a, b) in enumerate(zip(*coefficients(n), strict=True)):
            np.multiply(p, a, out=v)
            v += b
            v >>= np.uint64(32)
            out[:, j] = np.minimum.reduceat(v, first)
    return doc[first], out


def signature_table(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Of (doc_id, text, text_hash): doc_id, text_hash, node (a number of its own), sig (16 bits of each minimum), bands (a hash of each band, with its number mixed in).

    Nodes count rows by partition, so the table must be written before it is used twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId() << 33
        for b in batches:
            ids, texts, hashes = b.column(0), b.column(1).to_pylist(), b.column(2)
            for i, j in W.chunks(texts):
                at, sig = signatures(texts[i:j], shingle, bands * rows)
                if len(at):
                    x = np.zeros((len(at), bands), np.uint64)
                    for r in range(rows):
                        x = W.mix(x ^ sig[:, r::rows].astype(np.uint64)) + np.arange(bands, dtype=np.uint64)
                    row = pa.array(i + at)
                    yield pa.RecordBatch.from_arrays([ids.take(row), hashes.take(row), pa.array(node + np.arange(len(at))), fixed_binary(sig.astype(np.uint16)), lists(x.view(np.int64).ravel(), np.arange(len(at) + 1) * bands)], ["doc_id", "text_hash", "node", "sig", "bands"])
                    node += len(at)

    return docs.mapInArrow(run, "doc_id long, text_hash long, node long, sig binary, bands array<long>")


def _verify(pairs: DataFrame, sigs: DataFrame, n: int, threshold: float) -> DataFrame:
    """pairs (a, b, ...) with ok: whether at least that share of minima agree."""
    need = int(np.ceil(threshold * n))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, n) for k in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array((x == y).sum(1) >= need)], ["a", "b", "ok"])

    left, right = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(f, "a long, b long, ok boolean")


def _search(n: int, threshold: float):
    """Within a bucket: a spanning forest of the graph of verified pairs; each document is visited once."""
    need = int(np.ceil(threshold * n))

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").sort_values("node")
        ids, sig = rows["node"].to_numpy(), np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, n)
        rest, a, b = np.arange(len(ids)), [], []
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                x = todo.pop()
                hit = np.concatenate([(sig[r] == sig[x]).sum(1) >= need for r in np.array_split(rest, max(1, len(rest) // 4096))])
                a += [ids[x]] * int(hit.sum())
                b += ids[rest[hit]].tolist()
                todo += rest[hit].tolist()
                rest = rest[~hit]
        return pd.DataFrame({"a": np.asarray(a, np.int64), "b": np.asarray(b, np.int64)})

    return f


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b) that is not its component's smallest.

    Alternates large-star and small-star until neither changes the edges; each round is written
    to the shared folder. Nulls and loops are ignored.
    """
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "cc-0")
    state = None
    for i in range(1, most_rounds + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, f"large-{i}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after = scratch.save(small, f"cc-{i}")
        scratch.drop(f"cc-{i - 1}", f"large-{i}")
        new = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        now = after
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def duplicate_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, duplicate_of) of each document that has a near copy which comes before it, with its group's first; and (doc_id, text_hash) of documents in several rows."""
    spark = df.sparkSession
    ship(spark)
    scratch, n = Scratch(spark, "near"), bands * rows
    docs = select_text(df, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    sigs = scratch.save(signature_table(docs, shingle, bands, rows), "sigs")
    # One document for each signature; the others hang on it.
    first = sigs.groupBy(F.xxhash64("sig").alias("s1"), F.hash("sig").alias("s2")).agg(F.min(F.struct("node", "sig")).alias("m"), F.collect_set("node").alias("all"), F.first("bands").alias("bands"))
    first = scratch.save(first.select("m.node", "m.sig", "bands", "all"), "first")
    same = first.where(F.size("all") > 1).select(F.explode("all").alias("a"), F.col("node").alias("b")).where("a <> b")
    members = first.select("node", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1")
    stars = scratch.save(members.join(buckets, "band").where("node <> least").select("band", F.col("node").alias("a"), F.col("least").alias("b"), "size"), "stars")
    tried = scratch.save(_verify(stars.select("a", "b").distinct(), first, n, threshold), "tried")
    # A bucket of three or more in which the smallest node failed with any: all its documents are searched.
    refuted = stars.where("size > 2").join(tried.where("not ok"), ["a", "b"], "left_semi").select("band").distinct()
    again = stars.join(refuted, "band", "left_semi")
    again = again.select("band", F.col("a").alias("node")).union(again.select("band", F.col("b").alias("node"))).distinct()
    # Buckets of the same documents (the bands of one group) are searched once.
    keys = again.groupBy("band").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("k"), F.count("*").alias("c"))
    one = keys.groupBy("k", "c").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("c") / F.lit(BLOCK)).cast("int").alias("blocks"))
    mine = again.join(one, "band").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    paired = mine.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long")))).select("node", "band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    searched = paired.join(first.select("node", "sig"), "node").groupBy("band", "i", "j").applyInPandas(_search(n, threshold), "a long, b long")
    found = connected_components(same.union(tried.where("ok").select("a", "b")).union(searched), scratch)
    # Nodes back to documents; in each group the smallest (doc_id, text_hash) stays.
    group = scratch.save(found.union(found.select("root", "root").distinct()), "group")
    named = group.join(sigs.select(F.col("node"), F.struct("doc_id", "text_hash").alias("d")), "node")
    least = named.groupBy("root").agg(F.min("d").alias("least"))
    out = named.join(least, "root").where("d <> least").select("d.doc_id", "d.text_hash", F.col("least.doc_id").alias("duplicate_of")).distinct()
    out = scratch.save(out, "result")
    repeated = scratch.save(sigs.groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"), "repeated")
    scratch.drop("sigs", "first", "stars", "tried", "group", *[f"cc-{i}" for i in range(61)])
    return out, repeated


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, duplicate_of): each doc_id with a near copy which comes before it, with its group's smallest doc_id; an id of several texts may have several, or its own."""
    return duplicate_texts(df, id_col, text_col, **options)[0].select("doc_id", "duplicate_of").distinct()


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df without those of documents that have a near copy which comes before them, and with one row of each document.

    Up to ``MOST_KEYS`` keys of removed documents are broadcast, so that no text is shuffled but those of documents in several rows; beyond
    that the keys are joined by a shuffle.
    """
    gone, repeated = duplicate_texts(df, id_col, text_col, **options)
    key, text_hash = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        a, b = unused("key", rows.columns), unused("hash", rows.columns)
        keys = keys.select(F.col("doc_id").alias(a), F.col("text_hash").alias(b))
        keys = F.broadcast(keys) if keys.count() <= MOST_KEYS else keys
        return rows.join(keys, (key == F.col(f"`{a}`")) & (text_hash == F.col(f"`{b}`")), how)

    kept = among(df, gone, "left_anti")
    if not repeated.limit(1).count():
        return kept
    place = unused("place", df.columns)
    w = Window.partitionBy(key, text_hash).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    one = among(kept, repeated, "left_semi").withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)
    return among(kept, repeated, "left_anti").unionByName(one)
