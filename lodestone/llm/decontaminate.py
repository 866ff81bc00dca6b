"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one partition, up to ``SHARD_SYMBOLS`` words and ends of documents. Its words are
the symbols: each word of the test phrases has its own, all others are one separator (they
can't be part of a match), of which runs are kept as one; documents are separated too. Over the
shard's suffix array stand the Burrows-Wheeler transform, as a wavelet matrix with bit-packed ranks,
and the suffix positions that are multiples of ``SAMPLE``. All test phrases go through the backward
search at once; their occurrences are located by walking to the next sampled position, and the
occurrences' words merge into removal spans.

A test phrase is each run of ``n`` words of a benchmark item, or the whole item if it has fewer words, but
``least`` or more. The benchmark is taken in slices of about ``MAX_PHRASES`` phrases, of which one at a time is
held by driver and workers. Each shard is searched for all slices, always in the original texts, and the spans, items and
words of a document are merged over the slices before it is reported or cut: the slices change no result.

Defined results: null id: row ignored (kept by ``decontaminate``). Null, empty, wordless text: clean. Case and separators
don't count; a text of any length is indexed whole. Items that are null or shorter than ``least`` words are
not searched. Repeated items are searched once and all their ids reported. A repeated row is reported
once for each row. Empty documents or an empty benchmark give an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..session import ship
from . import _words as W
from ._arrow import select_text

N, LEAST, SAMPLE, SHARD_SYMBOLS, MAX_PHRASES = 13, 5, 32, 1 << 21, 200_000


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of symbols under 2**bits, of which the last occurs once and is the least; by prefix doubling.

    The first sort takes as many symbols as fit in 63 bits; then only groups of equal prefixes are sorted again.
    """
    n, k = len(s), max(1, 63 // bits)
    key = s.astype(np.uint64)
    span = 1
    while span * 2 <= k:
        key = (key << np.uint64(bits * span)) | np.concatenate((key[span:], np.zeros(min(span, n), np.uint64)))[:n]
        span *= 2
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while not new.all():
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        rows = order[at]
        after = rows + span
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        first = rank[rows]
        by = np.argsort(first * np.int64(n + 1) + second + 1) if n < 3_000_000_000 else np.lexsort((second, first))
        rows, first, second = rows[by], first[by], second[by]
        order[at] = rows
        fresh = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        new[at] = fresh
        rank[rows] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        span *= 2
    return order


class Wavelet:
    """A wavelet matrix: rank and access of symbols, for arrays of positions at once."""

    def __init__(self, x: np.ndarray, bits: int):
        self.bits, self.n = bits, len(x)
        self.words, self.before, self.zeros = [], [], []
        x = x.astype(np.uint32)
        for level in range(bits - 1, -1, -1):
            bit = ((x >> np.uint32(level)) & np.uint32(1)).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1])
            self.zeros.append(int(self.n - bit.sum(dtype=np.int64)))
            x = np.concatenate((x[bit == 0], x[bit == 1]))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][block] + np.bitwise_count(self.words[level][block] & mask).astype(np.int64)

    def rank(self, c: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """For each of the positions: occurrences of the symbols c before them."""
        places = [np.zeros_like(positions[0]), *positions]
        for level in range(self.bits):
            one = (c >> (self.bits - 1 - level)) & 1 == 1
            ones = [self._ones(level, p) for p in places]
            places = [np.where(one, self.zeros[level] + o, p - o) for p, o in zip(places, ones, strict=True)]
        return [p - places[0] for p in places[1:]]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and its occurrences before i."""
        c, start, p = np.zeros_like(i), np.zeros_like(i), i
        for level in range(self.bits):
            one = (self.words[level][p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
            o, s = self._ones(level, p), self._ones(level, start)
            p, start = np.where(one, self.zeros[level] + o, p - o), np.where(one, self.zeros[level] + s, start - s)
            c = (c << 1) | one
        return c, p - start


class FMIndex:
    """Over symbols under sigma, without 0, which ends the text."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = SAMPLE):
        s = np.concatenate((s, [0])).astype(np.int64)
        bits = max(1, int(sigma - 1).bit_length())
        sa = suffix_array(s, bits)
        self.n = len(s)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=sigma))))
        self.tree = Wavelet(s[sa - 1], bits)
        marked = sa % sample == 0
        self.mark, self.sample = Wavelet(marked, 1), sa[marked]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases, padded with -1 on the left: the rows from lo to hi have them."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for column in phrases.T[::-1]:
            go = np.flatnonzero((column >= 0) & (lo < hi))
            if len(go):
                c = column[go]
                a, b = self.tree.rank(c, lo[go], hi[go])
                lo[go], hi[go] = self.before[c] + a, self.before[c] + b
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, todo, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows, 0
        while len(todo):
            bit, before = self.mark.access(at)
            hit = bit == 1
            out[todo[hit]] = self.sample[before[hit]] + steps
            todo, at = todo[~hit], at[~hit]
            if len(todo):
                c, before = self.tree.access(at)
                at, steps = self.before[c] + before, steps + 1
        return out


class Phrases:
    """Test phrases as symbols: the vocabulary's sorted word hashes stand for 2, 3, ..."""

    def __init__(self, items: np.ndarray, texts: list, n: int = N, least: int = LEAST):
        w = W.words(texts)
        self.vocabulary = np.unique(w.hash)
        sym = np.searchsorted(self.vocabulary, w.hash) + 2
        rows, of = [], []
        for i in range(len(w)):
            x = sym[w.ptr[i] : w.ptr[i + 1]]
            if len(x) >= n:
                rows.append(np.lib.stride_tricks.sliding_window_view(x, n))
            elif len(x) >= least:
                rows.append(np.concatenate((np.full(n - len(x), -1), x))[None])
            else:
                continue
            of.append(np.full(len(rows[-1]), items[i]))
        table = np.concatenate(rows) if rows else np.zeros((0, n), np.int64)
        self.table, inverse = np.unique(table, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        self.items: list[set[int]] = [set() for _ in self.table]
        for row, item in zip(inverse, np.concatenate(of) if of else (), strict=True):
            self.items[row].add(int(item))
        self.length = (self.table >= 0).sum(1)

    def symbols(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of documents, separated, and each one's word (-1: separator)."""
        if not len(self.vocabulary):
            return np.ones(1, np.int64), np.full(1, -1)
        place = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == w.hash
        sym = np.insert(np.where(known, place + 2, 1), w.ptr[1:], 1)
        word = np.insert(np.where(known, np.arange(len(w.hash)), -1), w.ptr[1:], -1)
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] != 1) | (sym[:-1] != 1)
        return sym[keep], word[keep]


class Shard:
    """Documents until there are enough of them to index."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, texts: list) -> None:
        w = W.words(texts)
        self.parts.append(replace(w, start=w.start.astype(np.int32), end=w.end.astype(np.int32), codes=None))
        self.size += len(w.hash) + len(w)

    def _occurrences(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """First words, counted over the shard, and phrases of all occurrences."""
        if not self.size or not len(p.table):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbols, base = [], 0
        for w in self.parts:
            sym, word = p.symbols(w)
            symbols.append((sym, np.where(word >= 0, word + base, -1)))
            base += len(w.hash)
        index = FMIndex(np.concatenate([x[0] for x in symbols]), len(p.vocabulary) + 2)
        lo, hi = index.find(p.table)
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        rows = np.repeat(lo[found] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.concatenate([x[1] for x in symbols])[index.locate(rows)], np.repeat(found, count)

    def search(self, slices: Iterable[Phrases]) -> dict[int, tuple[list[tuple[int, int]], set[int], int]]:
        """By number of the contaminated document: spans merged over all slices, items, words covered."""
        first, last, items = [], [], defaultdict(set)
        starts = np.concatenate([[0], *[np.diff(w.ptr) for w in self.parts]]).cumsum()[:-1]
        for p in slices:
            word, which = self._occurrences(p)
            for d, i in set(zip((np.searchsorted(starts, word, side="right") - 1).tolist(), which.tolist(), strict=True)):
                items[d] |= p.items[i]
            first.append(word)
            last.append(word + p.length[which])
        if not items:
            return {}
        begin, end = (np.concatenate([getattr(w, k) for w in self.parts]) for k in ("start", "end"))
        first, last = np.concatenate(first), np.concatenate(last)
        doc = np.searchsorted(starts, first, side="right") - 1
        by = np.lexsort((first, doc))
        out: dict[int, list] = {}
        for d, a, b in zip(doc[by].tolist(), first[by].tolist(), last[by].tolist(), strict=True):
            spans = out.setdefault(d, [])
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        return {d: ([(int(begin[a]), int(end[b - 1])) for a, b in spans], items[d], sum(b - a for a, b in spans)) for d, spans in out.items()}


def _slices(benchmark: DataFrame, item_col: str, text_col: str, n: int, least: int) -> Iterator[Phrases]:
    """The benchmark's phrases, a bounded number at a time."""
    b = select_text(benchmark, item_col, text_col).where("text is not null")
    words = b.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    slices = max(1, -(-int(words) // MAX_PHRASES))
    for i in range(slices):
        rows = b.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == i).select("doc_id", "text").collect()
        yield Phrases(np.int64([r[0] for r in rows]), [r[1] for r in rows], n, least)


def _shared(df: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, n: int, least: int) -> list[Broadcast]:
    """All slices, broadcast one after the other."""
    return [df.sparkSession.sparkContext.broadcast(p) for p in _slices(benchmark, item_col, item_text, n, least)]


def _held(shared: list[Broadcast]) -> Iterator[Phrases]:
    """The slices in a worker: one that is alone stays in memory, of several each is loaded and let go."""
    for b in shared:
        yield b.value
        if len(shared) > 1 and b._path is not None:
            del b._value  # the next value loads it again


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = N, least: int = LEAST) -> DataFrame:
    """(doc_id, spans, item_ids, n_words): documents that hold test phrases, with the merged spans to remove."""
    spark = df.sparkSession
    ship(spark)
    shared = _shared(df, benchmark, item_col, item_text, n, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids = Shard(), []

        def flush() -> Iterator[pa.RecordBatch]:
            if found := shard.search(_held(shared)):
                d = sorted(found)
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                spans = pa.array([[{"start": a, "end": b} for a, b in found[i][0]] for i in d], span)
                flat = np.concatenate(ids)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(flat[d]), "spans": spans, "item_ids": pa.array([sorted(found[i][1]) for i in d], pa.list_(pa.int64())), "n_words": pa.array([found[i][2] for i in d], pa.int32())})

        for b in batches:
            texts, keys = b.column(1).to_pylist(), b.column(0).to_numpy(zero_copy_only=False)
            for i, j in W.chunks(texts):
                shard.add(texts[i:j])
                ids.append(keys[i:j])
                if shard.size >= SHARD_SYMBOLS:
                    yield from flush()
                    shard, ids = Shard(), []
        yield from flush()

    return select_text(df, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int>>, item_ids array<long>, n_words int")


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = N, least: int = LEAST) -> DataFrame:
    """df with the test phrases cut from its texts, in one pass and without a shuffle; a text of which no word is left is dropped."""
    ship(df.sparkSession)
    shared, column, schema = _shared(df, benchmark, item_col, item_text, n, least), df.columns.index(text_col), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list]] = []
        shard = Shard()

        def flush() -> Iterator[pa.RecordBatch]:
            found, base = shard.search(_held(shared)), 0
            for b, texts in held:
                keep = np.ones(len(texts), bool)
                changed = False
                for i in range(len(texts)):
                    if base + i in found:
                        t, spans = texts[i], found[base + i][0]
                        cuts = [0, *[x for s in spans for x in s], len(t)]
                        texts[i] = "".join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                        keep[i], changed = any(map(str.isalnum, texts[i])), True
                base += len(texts)
                if changed:
                    b = b.set_column(column, b.schema.field(column), pa.array(texts, b.schema.field(column).type)).filter(pa.array(keep))
                yield b

        for batch in batches:
            texts = batch.column(column).to_pylist()
            for i, j in W.chunks(texts):
                shard.add(texts[i:j])
                held.append((batch.slice(i, j - i), texts[i:j]))
                if shard.size >= SHARD_SYMBOLS:
                    yield from flush()
                    held, shard = [], Shard()
        yield from flush()

    return df.mapInArrow(run, schema)
