"""Toxic documents by a convolutional text classifier, written and trained in numpy.

A word's embedding is the sum of hashed rows for the word and its 3- to 6-letter beginnings. Filters
of widths 1, 2 and 3 run over the words, rectified and max-pooled over the whole document, and a logistic layer gives the
score. It is trained by Adagrad on the log loss, words dropped at random:

1. The driver trains on a first block: labelled documents of each class in the order of their ids' hashes, at most ``PER_CLASS`` of
   them and ``CLASS_CHARS`` characters. If those are all that there are, the model is done.
2. Otherwise every labelled document is trained on, whatever its length, ``PASSES`` times: they are written once, in blocks by their ids' hashes. Executors go on from
   the shared weights, a block at a time; the changes of a parameter are averaged over the blocks that changed it, in
   integers, so that no order of tasks matters.

A quarter of the labelled documents is held out, and all of those calibrate: thresholds by language maximise F1 there, with classes
weighted to their true shares. A language with too few held-out documents of a class has the threshold of all languages.

Defined results: null id: row ignored. Null, empty, wordless text: score of no words, never toxic. Null language: the
threshold of all languages. Null labels are ignored; of repeated labels of a document the largest counts. Without
labelled documents of both classes nothing is toxic. Repeated rows are scored each; of different texts under a labelled id the one of the
smallest hash is trained on. Texts are scored whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import copy
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Scratch, ship
from . import _words as W
from ._arrow import select_text

CLASS_CHARS = 40_000_000
PER_CLASS, BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 4000, 1 << 16, 16, 16, (1, 2, 3), (3, 4, 5, 6)
EPOCHS, BATCH, RATE, DROP, LEAST_CALIBRATION = 8, 32, 0.05, 0.15, 20
#: Passes over all labelled documents, where they are more than the first block. Pieces of the table that are averaged apart.
PASSES, PIECES = 4, 16
#: Bits of the map of labelled ids: with more of these than bits it leaves out little, which costs time alone.
BITS = 1 << 26
#: Code points scored at once; the network's arrays then stay in cache.
CHUNK = 1 << 16


def features(w: W.Words) -> np.ndarray:
    """Hashed rows of each word: (words, 1 + len(PREFIXES)); a word no longer than a prefix repeats its own row."""
    n = len(w.hash)
    base = np.repeat(w.offset[:-1], np.diff(w.ptr))
    s, size = (w.start + base).astype(np.int64), w.end - w.start
    out = np.empty((n, 1 + len(PREFIXES)), np.int32)
    out[:, 0] = (w.hash & np.uint64(BUCKETS - 1)).astype(np.int32)
    c = np.where(w.codes < 0x10000, W.FOLD[np.minimum(w.codes, 0xFFFF)], w.codes).astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(max(PREFIXES)):
        has = size > i
        h[has] = (h[has] ^ c[s[has] + i]) * np.uint64(0x100000001B3) + np.uint64(i + 1)
        if i + 1 in PREFIXES:
            x = (W.mix(h ^ np.uint64(i + 1)) & np.uint64(BUCKETS - 1)).astype(np.int32)
            out[:, 1 + PREFIXES.index(i + 1)] = np.where(size > i + 1, x, out[:, 0])
    return out


class Model:
    """The network's weights."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [r.normal(0, (1 / (DIM * k)) ** 0.5, (k * DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.2, FILTERS * len(WIDTHS)).astype(np.float32)
        self.last = np.zeros(1, np.float32)
        self.thresholds: dict[str | None, float] = {None: 2.0}
        # Adagrad's sums of squares.
        self.square, self.table_square = [np.full_like(p, 1e-6) for p in self.dense()], np.full(BUCKETS, 1e-6, np.float32)

    def dense(self) -> list[np.ndarray]:
        """All weights but the table."""
        return [*self.filters, *self.bias, self.out, self.last]

    def pooled(self, rows: np.ndarray, ptr: np.ndarray, places: bool = False):
        """Pooled filters of documents that have words; also, if asked for, where the maxima are and the padded embeddings."""
        pad, n = max(WIDTHS) - 1, len(ptr) - 1
        size = np.diff(ptr)
        at = np.arange(len(rows)) + np.repeat(np.arange(n) * pad, size)
        start = ptr[:-1] + np.arange(n) * pad
        x = np.zeros((len(rows) + n * pad, DIM), np.float32)
        e = self.table[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            e += self.table[rows[:, j]]
        x[at] = e
        values, where = [], []
        # One product for all filters' rows; then each width adds up its own, shifted.
        every = x @ np.concatenate([f[j * DIM : (j + 1) * DIM] for k, f in zip(WIDTHS, self.filters, strict=True) for j in range(k)], axis=1)
        column = 0
        for k, b in zip(WIDTHS, self.bias, strict=True):
            y = every[:, column : column + FILTERS]
            for j in range(1, k):
                y[:-j] += every[j:, column + j * FILTERS : column + (j + 1) * FILTERS]
            column += k * FILTERS
            # A width's windows start at a word; those over a document's end see zeros.
            y = y[at]
            top = np.maximum.reduceat(y, ptr[:-1], axis=0)
            values.append(np.maximum(top + b, 0))
            if places:
                hit = np.where(y == np.repeat(top, size, axis=0), np.arange(len(y))[:, None], len(y))
                where.append(at[np.minimum.reduceat(hit, ptr[:-1], axis=0)])
        return np.concatenate(values, 1), where, x, at, start

    def scores(self, w: W.Words) -> np.ndarray:
        """Probabilities; a document without words has 0."""
        some = np.flatnonzero(np.diff(w.ptr) > 0)
        out = np.zeros(len(w), np.float64)
        if len(some):
            h = self.pooled(features(w), np.append(w.ptr[some], w.ptr[-1]))[0]
            out[some] = 1 / (1 + np.exp(-np.clip(h @ self.out + self.last, -30, 30).astype(np.float64)))
        return out

    def train(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> None:
        """Adagrad over minibatches of documents, given as rows of features."""
        r = np.random.default_rng(seed)
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for part in np.array_split(r.permutation(len(docs)), -(-len(docs) // BATCH)):
                self.step([docs[i] for i in part], labels[part], weights[part], rate, r)

    def step(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rate: float, r: np.random.Generator) -> None:
        """One minibatch of documents that have words."""
        kept = [d[keep] if (keep := r.random(len(d)) >= DROP).any() else d for d in docs]
        rows, ptr = np.concatenate(kept), np.cumsum([0, *map(len, kept)])
        h, where, x, at, _ = self.pooled(rows, ptr, places=True)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.last, -30, 30)))
        d = ((p - labels) * weights / len(docs)).astype(np.float32)
        dh = np.outer(d, self.out) * (h > 0)
        grads, dx = [], np.zeros_like(x)
        for i, (k, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = dh[:, i * FILTERS : (i + 1) * FILTERS]
            gf = np.zeros_like(f)
            for j in range(k):
                place = np.minimum(where[i] + j, len(x) - 1)
                gf[j * DIM : (j + 1) * DIM] = np.einsum("nf,nfd->df", g, x[place])
                np.add.at(dx, place.ravel(), (g[:, :, None] * f[j * DIM : (j + 1) * DIM].T[None]).reshape(-1, DIM))
            grads.append(gf)
        grads += [dh[:, i * FILTERS : (i + 1) * FILTERS].sum(0) for i in range(len(WIDTHS))]
        grads += [h.T @ d, np.float32([d.sum()])]
        for q, s, g in zip(self.dense(), self.square, grads, strict=True):
            s += g * g
            q -= rate * g / np.sqrt(s)
        dw = dx[at]
        live = np.flatnonzero(np.abs(dw).sum(1) > 0)
        index, grad = rows[live].ravel(), np.repeat(dw[live], rows.shape[1], axis=0)
        slot, inverse = np.unique(index, return_inverse=True)
        total = np.zeros((len(slot), DIM), np.float32)
        np.add.at(total, inverse, grad)
        self.table_square[slot] += (total * total).mean(1)
        self.table[slot] -= rate * total / np.sqrt(self.table_square[slot])[:, None]


def best_threshold(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The threshold of the best weighted F1: half way between the scores on its two sides."""
    by = np.argsort(-score, kind="stable")
    s, good, bad = score[by], np.cumsum(weight[by] * label[by]), np.cumsum(weight[by] * (1 - label[by]))
    f1 = 2 * good / (good + bad + good[-1])
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(np.argmax(f1))
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0.0)) / 2)


def _classes(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic), a row for each labelled id."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _held(ids: np.ndarray) -> np.ndarray:
    """Which documents are held out."""
    return W.mix(ids.astype(np.int64).view(np.uint64) & np.uint64(2**63 - 1)) % np.uint64(4) == 0


def labelled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_chars: int = CLASS_CHARS) -> tuple[list[tuple], dict[int, int]]:
    """The first block: labelled documents of each class (doc_id, text, lang, toxic, how many of the class were looked at), at most per_class of them and most_chars characters; and the classes' true sizes."""
    y = _classes(labels)
    sizes = {r[0]: r[1] for r in y.groupBy("toxic").count().collect()}
    picked = None
    for c in (0, 1):
        part = y.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    # 2 * per_class rows of two numbers: bounded, so it may be broadcast.
    rows = docs.join(F.broadcast(picked), "doc_id").where("text is not null").groupBy("doc_id").agg(F.min_by(F.struct("text", "lang", "toxic"), F.struct(F.xxhash64("text"), "lang")).alias("d")).select("doc_id", "d.*")
    upto = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    of = F.count("*").over(Window.partitionBy("toxic"))
    return rows.withColumns({"upto": upto, "of": of}).where(F.col("upto") <= most_chars).select("doc_id", "text", "lang", "toxic", "of").collect(), sizes


def fit(rows: list[tuple], sizes: dict[int, int]) -> Model:
    """Train on three quarters of the first block's rows and calibrate on the rest; ``fit_rest`` goes on from there if there are more."""
    model = Model()
    rows = sorted((r for r in rows if r[1]), key=lambda r: r[0])
    y = np.float32([r[3] for r in rows])
    if len(set(y.tolist())) < 2:
        return model
    held = _held(np.int64([r[0] for r in rows]))
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(rows), bool)  # too few to hold any out
    docs, scores = [], np.zeros(len(rows))
    for i, j in W.chunks([r[1] for r in rows]):
        w = W.words([r[1] for r in rows[i:j]])
        f = features(w)
        docs += [f[a:b] for a, b in zip(w.ptr[:-1], w.ptr[1:], strict=True)]
    full = np.array([len(d) > 0 for d in docs])
    use = np.flatnonzero(~held & full)
    share = y[use].mean()
    model.train([docs[i] for i in use], y[use], np.where(y[use] > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)).astype(np.float32))
    for i, j in W.chunks([r[1] for r in rows], CHUNK):
        scores[i:j] = model.scores(W.words([r[1] for r in rows[i:j]]))
    test = (held if held.any() else np.ones(len(rows), bool)) & full
    weight = np.where(y > 0, sizes[1] / max((y > 0).sum(), 1), sizes[0] / max((y == 0).sum(), 1))
    lang = np.array([r[2] or "" for r in rows])
    model.thresholds = {None: best_threshold(scores[test], y[test], weight[test])}
    for code in sorted(set(lang[test].tolist()) - {""}):
        mine = test & (lang == code)
        if min((y[mine] > 0).sum(), (y[mine] == 0).sum()) >= LEAST_CALIBRATION:
            model.thresholds[code] = best_threshold(scores[mine], y[mine], weight[mine])
    return model


def _bit(code: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), code.bitwiseAND(F.lit(63)).cast("int"))


def fit_rest(model: Model, docs: DataFrame, labels: DataFrame, sizes: dict[int, int], per_class: int = PER_CLASS) -> None:
    """Go on training the model of the first block on all labelled documents but the held-out quarter, and calibrate it on all of that."""
    spark = docs.sparkSession
    blocks = max(1, -(-sum(sizes.values()) // (2 * per_class)))
    y, code = _classes(labels), F.xxhash64("doc_id").bitwiseAND(F.lit(BITS - 1))
    # Only texts under an id that may be labelled are shuffled: a bitmap of hashed ids, at most BITS / 64 rows, leaves out most others.
    bits = y.groupBy(F.shiftright(code, 6).alias("word")).agg(F.bit_or(_bit(code)).alias("bits"))
    texts = docs.where("text is not null").withColumn("word", F.shiftright(code, 6)).join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(_bit(code)) != 0)
    both = texts.select("doc_id", "text", "lang", F.lit(None).cast("int").alias("toxic")).unionByName(y, allowMissingColumns=True)
    # One shuffle, by blocks, brings the texts and labels of an id together; a partition is written as one file.
    order = F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text"), "lang"))
    rows = both.repartition(blocks, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by(F.struct("text", "lang"), order).alias("d")).where("toxic is not null and d is not null").select("doc_id", "d.*", "toxic")
    rows = rows.withColumn("block", F.pmod(F.hash("doc_id"), F.lit(blocks))).sortWithinPartitions("block", F.xxhash64("doc_id"), "doc_id")
    scratch = Scratch(spark, "toxicity")
    saved = scratch.save(rows, "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(4, np.int64)
        for b in batches:
            n += np.bincount(2 * _held(b.column(0).to_numpy()) + b.column(1).to_numpy(), minlength=4)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(np.arange(4)), "n": pa.array(n)})

    n = {r[0]: r[1] for r in saved.select("doc_id", "toxic").mapInArrow(count, "kind long, n long").groupBy("kind").sum("n").collect()}
    n = np.array([n.get(i, 0) for i in range(4)]).reshape(2, 2)
    if n.sum(0).min() > 0:
        hold = bool(n.min() > 0)  # else too few to hold any out
        used = n[0] if hold else n.sum(0)
        for turn in range(PASSES):
            _advance(model, saved, 0.5 * used.sum() / used, hold, turn)
        model.thresholds = best_thresholds(scratch.save(_scored(model, saved, hold), "scored"), [sizes[c] / n[:, c].sum() for c in (0, 1)])
    scratch.drop("labelled", "scored")


def _advance(model: Model, saved: DataFrame, weight: np.ndarray, hold: bool, turn: int) -> None:
    """One pass: each block trains a copy of the model, and the changes are averaged over the blocks that made them."""
    shared, per = saved.sparkSession.sparkContext.broadcast(model), BUCKETS // PIECES
    # Sums of squares grow with the square of a rare class's weight, so they have a larger unit there: no sum leaves 64 bits.
    units, rate = np.array([2.0**32, 2.0 ** (32 - 2 * max(0, np.ceil(np.log2(weight.max() / 8))))]), RATE * (1 - turn / PASSES)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, now, own, r = shared.value, None, None, None
        docs, labels = [], []

        def step() -> None:
            y = np.float32(labels)
            own.step(docs, y, weight[y.astype(int)].astype(np.float32), rate, r)
            docs.clear()
            labels.clear()

        def changes() -> pa.RecordBatch:
            if docs:
                step()
            flat = lambda m: np.concatenate([x.ravel() for x in (*m.dense(), *m.square)])
            slot = np.flatnonzero(own.table_square != start.table_square)
            moved = np.concatenate([own.table[slot] - start.table[slot], (own.table_square[slot] - start.table_square[slot])[:, None]], axis=1)
            cut = np.searchsorted(slot, np.arange(PIECES + 1) * per)
            piece = [i for i in range(PIECES) if cut[i] < cut[i + 1]]
            slots = [(slot[cut[i] : cut[i + 1]] - i * per).astype("<u2").tobytes() for i in piece]
            values = [moved[cut[i] : cut[i + 1]].astype("<f4").tobytes() for i in piece]
            return pa.RecordBatch.from_pydict({"piece": pa.array([PIECES, *piece], pa.int32()), "slots": pa.array([b"", *slots], pa.binary()), "moved": pa.array([(flat(own) - flat(start)).astype("<f4").tobytes(), *values], pa.binary())})

        for b in batches:
            ids, block, toxic, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_pylist()
            use = np.flatnonzero(~_held(ids)) if hold else np.arange(len(ids))
            for i, j in W.chunks([texts[u] for u in use]):
                part = use[i:j]
                w = W.words([texts[u] for u in part])
                f = features(w)
                for u, lo, hi in zip(part.tolist(), w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True):
                    if block[u] != now:
                        if own is not None:
                            yield changes()
                        now, own, r = block[u], copy.deepcopy(start), np.random.default_rng([7, turn, int(block[u])])
                    if lo < hi:
                        docs.append(f[lo:hi])
                        labels.append(toxic[u])
                        if len(docs) == BATCH:
                            step()
        if own is not None:
            yield changes()

    def unit(piece: int, width: int) -> np.ndarray:
        return np.repeat(units, [DIM, 1] if piece < PIECES else width // 2)

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums of integers are the same in any order.
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for piece, slots, moved in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(moved, "<f4")
                x = x.reshape(-1, DIM + 1) if piece < PIECES else x[None]
                x = np.rint(x * unit(piece, x.shape[1])).astype(np.int64)
                total, times = sums.setdefault(piece, (np.zeros((per if piece < PIECES else 1, x.shape[1]), np.int64), np.zeros(per, np.int64)))
                at = np.frombuffer(slots, "<u2") if piece < PIECES else np.zeros(1, int)
                total[at] += x
                times[at] += 1
        for piece, (total, times) in sums.items():
            at = np.flatnonzero(times)
            mean = (total[at] / unit(piece, total.shape[1]) / times[at, None]).astype("<f4")
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "slots": pa.array([at.astype("<u2").tobytes()], pa.binary()), "moved": pa.array([mean.tobytes()], pa.binary())})

    schema = "piece int, slots binary, moved binary"
    moves = saved.select("doc_id", "block", "toxic", "text").mapInArrow(train, schema).repartition(PIECES // 2, "piece").mapInArrow(average, schema)
    # A row for each piece comes to the driver: as much as the model.
    for piece, slots, moved in moves.collect():
        x = np.frombuffer(moved, "<f4")
        if piece < PIECES:
            at, x = np.frombuffer(slots, "<u2").astype(int) + piece * per, x.reshape(-1, DIM + 1)
            model.table[at] += x[:, :DIM]
            model.table_square[at] += x[:, DIM]
        else:
            done = 0
            for p in (*model.dense(), *model.square):
                p += x[done : done + p.size].reshape(p.shape)
                done += p.size
    shared.destroy()


def _scored(model: Model, saved: DataFrame, hold: bool) -> DataFrame:
    """(lang, score, toxic) of the documents that calibrate."""
    shared = saved.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(_held(b.column(0).to_numpy()))) if hold else b
            texts = b.column(1).to_pylist()
            for i, j in W.chunks(texts, CHUNK):
                w = W.words(texts[i:j])
                full = np.flatnonzero(np.diff(w.ptr) > 0)
                yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(i + full)), pa.array(shared.value.scores(w)[full]), b.column(3).take(pa.array(i + full))], ["lang", "score", "toxic"])

    return saved.select("doc_id", "text", F.col("lang").cast("string"), "toxic").mapInArrow(run, "lang string, score double, toxic int")


def best_thresholds(scored: DataFrame, weight: list[float]) -> dict[str | None, float]:
    """``best_threshold`` of all rows (lang, score, toxic), under None, and of each language that has enough of them; weight: of the classes."""
    some = scored.where("lang <> ''").unionByName(scored.withColumn("lang", F.lit(None).cast("string")))
    by = Window.partitionBy("lang").orderBy(F.desc("score"))
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    t = some.groupBy("lang", "score").agg(F.sum("toxic").alias("good"), F.sum(1 - F.col("toxic")).alias("bad"))
    t = t.select("lang", "score", F.coalesce(F.lead("score").over(by), F.lit(0.0)).alias("next"), F.sum("good").over(upto).alias("good"), F.sum("bad").over(upto).alias("bad"), F.sum("good").over(Window.partitionBy("lang")).alias("all"))
    f1 = 2 * weight[1] * F.col("good") / (weight[1] * F.col("good") + weight[0] * F.col("bad") + weight[1] * F.col("all"))
    best = t.groupBy("lang").agg(F.max_by((F.col("score") + F.col("next")) / 2, F.struct(f1, "score")).alias("limit"), F.max("good").alias("good"), F.max("bad").alias("bad")).collect()
    return {None: 2.0} | {r.lang: r.limit for r in best if r.lang is None or min(r.good, r.bad) >= LEAST_CALIBRATION}


def toxic_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, lang, score, threshold) of the documents whose score reaches their language's threshold."""
    spark = df.sparkSession
    ship(spark)
    docs = select_text(df, id_col, text_col, lang=lang_col)
    rows, sizes = labelled(docs, labels, per_class)
    model, seen, of = fit(rows, sizes), Counter(r.toxic for r in rows), {r.toxic: r.of for r in rows}
    del rows
    if any(n > per_class or not seen[c] or seen[c] < of[c] for c, n in sizes.items()):
        fit_rest(model, docs, labels, sizes, per_class)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            ids, texts, langs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, j in W.chunks(texts, CHUNK):
                w = W.words(texts[i:j])
                score = model.scores(w)
                limit = np.array([model.thresholds.get(x, model.thresholds[None]) for x in langs[i:j]])
                hit = np.flatnonzero((score >= limit) & (np.diff(w.ptr) > 0))
                if len(hit):
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[i + hit]), "lang": pa.array([langs[i + x] for x in hit], pa.string()), "score": pa.array(np.round(score[hit], 6)), "threshold": pa.array(np.round(limit[hit], 6))})

    return docs.select("doc_id", "text", F.col("lang").cast("string")).mapInArrow(run, "doc_id long, lang string, score double, threshold double")
