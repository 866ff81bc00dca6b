"""Passages that recur across documents, located by sharded Aho-Corasick automata.

1. Winnowing picks ``K``-word phrases of every document such that any ``K + WINDOW - 1`` (50)
   words that two documents share hold a phrase picked in both. A phrase of two or more
   documents recurs; its canonical occurrence is the first one in the smallest doc_id.
2. Adjacent recurring phrases whose occurrences all continue in the same way are joined, so a
   passage becomes one pattern however many documents hold it (a compacted phrase graph).
3. Patterns are sharded by canonical document. pyahocorasick compiles one automaton a shard, and
   the whole text of each document that holds a phrase of the shard streams through it. The match is
   exact (words folded to lower case, separators ignored); a pattern counts only if it is seen
   in two documents. A document without a recurring phrase can hold no such passage.
   Patterns in very many documents are copied to several tasks that share the documents.
4. Around each match lie the 50-word windows that hold it or part of it; those that two documents
   of the shard hold are repeated. Overlapping or touching ones merge into passages.

So the passages of a document are exactly the unions of its 50-word windows that another document holds too.

Defined results: null id: row ignored. Null, empty and short (< 50 words) texts: nothing found. Repeats within
one document, or in repeated rows of one doc_id, alone don't count. Repeated rows are reported once; different texts under one
doc_id are told apart by text_hash. Ties: the smallest doc_id, then the
first position, is canonical. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import Scratch, ship
from . import _words as W
from ._arrow import map_texts, select_text
from ._spans import cut_spans

K, WINDOW, MIN_WORDS = 25, 26, 50
#: Canonical phrases to a shard (about 13 new words each), and documents to a copy of a pattern.
PER_SHARD, PER_COPY = 5_000, 200_000

SCHEMA = "doc_id long, text_hash long, start int, end int, n_words int, word_start int, removed array<struct<start:int,end:int>>"


def _link(fp: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """32 bits of (phrase, distance); 0 is never among them."""
    return ((W.mix(fp ^ gap.astype(np.uint64)) >> np.uint64(33)) + np.uint64(1)).astype(np.int32)


def phrase_table(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Picked phrases of all documents: fp, doc_id, pos (in words), and hashes of the next and previous pick and its distance."""

    def f(ids: np.ndarray, texts: list) -> dict:
        w = W.words(texts)
        at, fp = W.winnow(w, k, window)
        doc = np.searchsorted(w.ptr, at, side="right") - 1
        nxt, prv = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        if len(at) > 1:
            same, gap = doc[1:] == doc[:-1], np.diff(at)
            nxt[:-1] = np.where(same, _link(fp[1:], gap), 0)
            prv[1:] = np.where(same, _link(fp[:-1], gap), 0)
        return {"fp": fp.view(np.int64), "doc_id": ids[doc], "pos": (at - w.ptr[doc]).astype(np.int32), "nxt": nxt, "prv": prv}

    return map_texts(docs, f, "fp long, doc_id long, pos int, nxt int, prv int")


def recurring_phrases(table: DataFrame) -> DataFrame:
    """Occurrences of phrases that two or more documents hold, with the canonical one and whether all continue alike."""
    by = Window.partitionBy("fp")
    return (
        table.select(
            "*",
            F.max("doc_id").over(by).alias("last"),
            F.min(F.struct("doc_id", "pos")).over(by).alias("c"),
            (F.min("nxt").over(by) == F.max("nxt").over(by)).alias("on"),
            (F.min("prv").over(by) == F.max("prv").over(by)).alias("back"),
            F.ceil(F.count("*").over(by) / F.lit(PER_COPY)).cast("int").alias("copies"),
        )
        .where("last <> c.doc_id")
        .select("fp", "doc_id", "pos", "nxt", "prv", F.col("c.doc_id").alias("cdoc"), (F.col("c.doc_id") == F.col("doc_id")).alias("own"), ((F.col("c.doc_id") == F.col("doc_id")) & (F.col("c.pos") == F.col("pos"))).alias("canonical"), "on", "back", "copies")
    )


def text_hash(text: str) -> int:
    """What Spark's xxhash64 gives for a string."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


class Normal:
    """Texts as ' word word ... ', with the place of each word's leading space."""

    def __init__(self, texts: list):
        self.w = w = W.words(texts)
        n = w.end - w.start
        base = np.repeat(w.offset[:-1], np.diff(w.ptr))
        word = np.repeat(np.arange(len(n)), n)
        first = np.concatenate(([0], np.cumsum(n)))
        char = w.codes[np.arange(first[-1]) - first[:-1][word] + (w.start + base)[word]] if len(n) else w.codes[:0]
        out = np.full(len(char) + len(n), 32, np.uint32)
        out[np.arange(len(char)) + word + 1] = np.where(char < 0x10000, W.FOLD[np.minimum(char, 0xFFFF)], char)
        self.out, self.at = out, np.concatenate(([0], np.cumsum(n + 1)))

    def text(self, i: int) -> str:
        a, b = self.at[self.w.ptr[i]], self.at[self.w.ptr[i + 1]]
        return self.out[a:b].tobytes().decode("utf-32-le", "surrogatepass") + " "

    def places(self, i: int) -> np.ndarray:
        """Place in text(i) of the space before each word, and of the last one."""
        a, b = self.w.ptr[i], self.w.ptr[i + 1]
        return self.at[a : b + 1] - self.at[a]


def _patterns(text: str, at: np.ndarray, picks: list[dict], k: int, phrase: np.ndarray) -> Iterator[tuple]:
    """(copies, word position, pattern) of a canonical document's joined phrases.

    ``phrase`` has the text's phrase hashes: picks of another text under the same doc_id are left out.
    """
    picks = [p for p in picks if p["pos"] + k < len(at) and int(phrase[p["pos"]]) == p["fp"]]
    picks = sorted({p["pos"]: p for p in picks}.values(), key=lambda p: p["pos"])
    if not picks:
        return
    fp, pos = np.int64([p["fp"] for p in picks]).view(np.uint64), np.int64([p["pos"] for p in picks])
    gap = np.diff(pos)
    there, back = _link(fp[1:], gap), _link(fp[:-1], gap)
    begin = 0
    for i in range(len(picks)):
        p = picks[i]
        if i + 1 < len(picks) and p["on"] and picks[i + 1]["back"] and p["nxt"] == there[i] and picks[i + 1]["prv"] == back[i] and gap[i] <= k and p["copies"] == picks[i + 1]["copies"]:
            continue
        a, b = int(pos[begin]), int(pos[i]) + k
        yield picks[begin]["copies"], a, text[at[a] : at[b] + 1]
        begin = i + 1


def to_shards(rows: DataFrame, k: int) -> DataFrame:
    """From (doc_id, text, routes, picks): documents to all shards that they stream through, and patterns to their own."""
    names = ["shard", "copy", "kind", "doc_id", "pos", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, routes, picks = (batch.column(c) for c in range(4))
            texts = texts.to_pylist()
            for lo, hi in W.chunks(texts):
                normal = Normal(texts[lo:hi])
                phrase = W.phrases(normal.w, k).view(np.int64)
                out: list[tuple] = []
                for i in range(lo, hi):
                    d = ids[i].as_py()
                    out += [(r["shard"] * 1024 + min(r["copies"], 1023), int(W.mix(np.uint64([d & (2**63 - 1)]))[0] % np.uint64(r["copies"])), 1, d, 0, texts[i]) for r in routes[i].as_py()]
                    if p := picks[i].as_py():
                        shard, text, at = p[0]["shard"], normal.text(i - lo), normal.places(i - lo)
                        for copies, pos, body in _patterns(text, at, p, k, phrase[normal.w.ptr[i - lo] : normal.w.ptr[i - lo + 1]]):
                            out += [(shard * 1024 + min(copies, 1023), c, 0, d, pos, body) for c in range(copies)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True)], names)

    return rows.mapInArrow(run, "shard long, copy int, kind int, doc_id long, pos int, body string")


class Matches:
    """Matches of one automaton, with the windows around them, until all its documents have streamed through."""

    def __init__(self, shard: int, k: int, size: int):
        self.shard, self.split, self.k, self.size = shard, shard % 1024 > 1, k, size
        self.whole: list[tuple[np.ndarray, ...]] = []  # key, doc_id, text hash, word, end word, start, end
        self.around: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: np.ndarray, texts: np.ndarray, doc: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, w: W.Words) -> None:
        """Patterns n are at words a to b of the documents numbered doc in w, whose ids and text hashes are given."""
        size, more, base = self.size, self.size - self.k, w.ptr[doc]
        key = W.mix(n.astype(np.uint64) ^ W.mix(np.uint64([self.shard])))
        long = b - a >= size
        self.whole.append(tuple(x[long] for x in (key, ids[doc], texts[doc], a, b, w.start[base + a], w.end[base + b - 1])))
        far = b - a >= 2 * size
        lo = np.concatenate((base + a - more, (base + b - size)[far]))
        hi = np.concatenate((base + np.where(far, a + size, b + more), (base + b + more)[far]))
        part = np.concatenate((doc, doc[far]))
        lo, hi = np.maximum(lo, w.ptr[part]), np.minimum(hi, w.ptr[part + 1])
        # Windows that start in a part: each once, however many parts overlap there.
        change = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(change, lo, 1)
        np.add.at(change, np.maximum(hi - size + 1, lo), -1)
        at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        of = np.searchsorted(w.ptr, at, side="right") - 1
        first = at - w.ptr[of]
        self.around.append((W.phrases(w, size)[at], ids[of], texts[of], first, first + size, w.start[at].astype(np.int32), w.end[at + size - 1].astype(np.int32)))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Repeated spans. Of an automaton that several tasks have, what other tasks may change comes with the key by which to compare."""
        for kept in (self.whole, self.around):
            if kept:
                key, d, t, a, b, s, e = (np.concatenate(x) for x in zip(*kept, strict=True))
                kept.clear()
                if len(key):
                    yield from self._emit(key, d, t, a, b, s, e)

    def _emit(self, key: np.ndarray, d: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[pa.RecordBatch]:
        by = np.argsort(key)
        first = np.flatnonzero(np.concatenate(([True], key[by][1:] != key[by][:-1])))
        low, high = np.minimum.reduceat(d[by], first), np.maximum.reduceat(d[by], first)
        group = np.empty(len(key), np.int32)
        group[by] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff([*first, len(key)]))
        shared, least = (low != high)[group], d == low[group]
        if self.split:
            # The smallest of these documents may not be the smallest of all, and what one has others may have elsewhere.
            if (late := np.flatnonzero(least)).size:
                yield self._batch(key[late], True, d[late], t[late], a[late], b[late], s[late], e[late], shared[late])
            shared &= ~least
        d, t, a, b, s, e, own = (x[shared] for x in (d, t, a, b, s, e, least))
        if len(d):  # overlapping and touching spans of a document become one, as they do in the end
            by = np.lexsort((a, own, t, d))
            d, t, a, b, s, e, own = (x[by] for x in (d, t, a, b, s, e, own))
            group = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (own[1:] != own[:-1])))) << 32
            top = np.maximum.accumulate(group + b)
            begin = np.flatnonzero(np.concatenate(([True], (group + a)[1:] > top[:-1])))
            yield self._batch(np.zeros(len(begin), np.uint64), False, d[begin], t[begin], a[begin], np.maximum.reduceat(b, begin), s[begin], np.maximum.reduceat(e, begin), own[begin])

    @staticmethod
    def _batch(key: np.ndarray, late: bool, d: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray, s: np.ndarray, e: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(d), late)), pa.array(d), pa.array(t), *[pa.array(x.astype(np.int32)) for x in (a, b, s, e)], pa.array(own)], ["key", "open", "doc_id", "text_hash", "a", "b", "start", "end", "own"])


def stream(rows: DataFrame, k: int, size: int) -> DataFrame:
    """Repeated spans found in each shard: rows come sorted by shard, the patterns before the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine, lengths, made, found = None, None, [], False, None
        texts: list[tuple[int, str]] = []
        held = 0

        def scan() -> None:
            size_of = np.int64(lengths)
            for lo, hi in W.chunks([t for _, t in texts]):
                normal, hits = Normal([t for _, t in texts[lo:hi]]), []
                for i in range(hi - lo):
                    if got := list(machine.iter(normal.text(i))):
                        end, n = np.int64(got).T
                        a, b = np.searchsorted(normal.places(i), np.stack((end + 1 - size_of[n], end)))
                        hits.append((np.full(len(n), i), n, a, b))
                if hits:
                    found.add(np.int64([d for d, _ in texts[lo:hi]]), np.int64([text_hash(t) for _, t in texts[lo:hi]]), *(np.concatenate(x) for x in zip(*hits, strict=True)), normal.w)
            texts.clear()

        for batch in batches:
            cols, body = [batch.column(c).to_pylist() for c in range(5)], batch.column(5)
            for i in range(batch.num_rows):
                if (key := (cols[0][i], cols[1][i])) != now:
                    if now is not None:
                        scan()
                        yield from found.rows()
                    now, machine, lengths, made, found = key, ahocorasick.Automaton(), [], False, Matches(key[0], k, size)
                if cols[2][i] == 0:
                    t = body[i].as_py()
                    if t not in machine:
                        # Patterns come in one order, so that all tasks of a shard number them alike.
                        machine.add_word(t, len(lengths))
                        lengths.append(len(t))
                elif lengths:
                    if not made:
                        machine.make_automaton()
                        made = True
                    texts.append((cols[3][i], body[i].as_py()))
                    held += len(texts[-1][1])
                    if held >= W.CHUNK:
                        scan()
                        held = 0
            scan()
            held = 0
        if now is not None:
            yield from found.rows()

    return rows.mapInArrow(run, "key long, open boolean, doc_id long, text_hash long, a int, b int, start int, end int, own boolean")


def merge_hits(hits: DataFrame, min_words: int) -> DataFrame:
    """Overlapping or touching matches of each document as passages; ``removed`` are the parts that a smaller document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, t, found in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                found = sorted({(h["a"], h["b"], h["start"], h["end"], h["own"]) for h in found})
                now = None
                for a, b, s, e, own in [*found, (1 << 31, 0, 0, 0, True)]:
                    if now and a > now[1]:
                        if now[1] - now[0] >= min_words:
                            out.append((d, t, now[2], now[3], now[1] - now[0], now[0], [{"start": x[2], "end": x[3]} for x in now[4]]))
                        now = None
                    if now is None:
                        now = [a, b, s, e, []]
                    elif b > now[1]:
                        now[1], now[3] = b, e
                    if not own:
                        if now[4] and a <= now[4][-1][1]:
                            if b > now[4][-1][1]:
                                now[4][-1][1], now[4][-1][3] = b, e
                        else:
                            now[4].append([a, b, s, e])
            if out:
                c = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], ["doc_id", "text_hash", "start", "end", "n_words", "word_start", "removed"])

    return hits.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("a", "b", "start", "end", "own")).alias("hits")).mapInArrow(run, SCHEMA)


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages (doc_id, text_hash, start, end, n_words, word_start, removed) that recur across documents, in all documents that hold them.

    start and end are offsets in the text; ``removed`` lists the spans that a smaller doc_id holds too.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "repeats")
    docs = select_text(df, id_col, text_col)
    found = scratch.save(recurring_phrases(phrase_table(docs, k, window)), "phrases")
    shards = max(1, -(-found.where("canonical").count() // PER_SHARD))
    found = found.withColumn("shard", F.pmod(F.xxhash64("cdoc"), F.lit(shards)))
    pick = F.when(F.col("canonical"), F.struct("pos", "fp", "nxt", "prv", "on", "back", "copies", "shard"))
    ways = found.groupBy("doc_id").agg(F.collect_set(F.struct("shard", "copies")).alias("routes"), F.collect_list(pick).alias("picks"))
    rows = to_shards(docs.join(ways, "doc_id").select("doc_id", "text", "routes", "picks"), k)
    hits = scratch.save(stream(rows.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind", "doc_id", "pos"), k, min_words), "hits")
    columns = ["doc_id", "text_hash", "a", "b", "start", "end", "own"]
    by = Window.partitionBy("key")
    # Here own says whether two documents of the task had it.
    late = hits.where("open").withColumns({"least": F.min("doc_id").over(by), "most": F.max("doc_id").over(by), "sure": F.max("own").over(by)}).where("least <> most or sure").withColumn("own", F.col("doc_id") == F.col("least"))
    out = scratch.save(merge_hits(hits.where("not open").select(columns).union(late.select(columns)), min_words), "result")
    scratch.drop("phrases", "hits")
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with recurring passages cut from all documents but the smallest doc_id that holds them.

    Rows of the cut documents keep their other columns; a text of which no word is left is dropped.
    """
    spans = repeated_passages(df, id_col, text_col, **options).where(F.size("removed") > 0)
    spans = spans.select("doc_id", "text_hash", F.explode("removed").alias("s")).groupBy("doc_id", "text_hash").agg(F.collect_set("s").alias("spans"))
    return cut_spans(df, spans, id_col, text_col)
