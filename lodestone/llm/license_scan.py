"""Licence texts in documents: winnowed fingerprints pick candidates, banded alignment confirms them.

The templates' winnowed 3-word fingerprints make an inverted index. It depends on the templates alone, is
checked for size and goes to all executors. Each document's fingerprints are looked up; postings of one
template whose diagonals (document word - template word) lie within a band are a candidate, be it one posting. Its words are aligned
with the template's around the middle diagonal (local alignment: match 2, mismatch -1, gap -1), which gives the
matched words, coverage (matched share of the template) and span. Findings of at least ``COVERAGE`` remain; of
those that overlap by half or more of the shorter one, the one with the most matched words does, then the one of the
highest coverage, then the first template.

A copy of a longer template with a quarter of its words altered still has fingerprints: any four words in a row that are left hold one.
A template of up to ``SHORT`` words has too few fingerprints for an altered copy to keep one. For these every run of
document words that holds enough of the template's words, as near to each other as an alignment allows, is aligned
without a band: no copy that reaches ``COVERAGE`` is missed. What is left of the run on both sides is searched again.

Defined results: null id: row ignored. Null, empty and wordless texts have no finding. Texts are scanned
whole; there is no cap on candidates. Each row is scanned by itself: repeated rows give repeated findings.
Several occurrences in a document are all reported. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from . import _words as W
from ._arrow import map_texts, select_text
from .license_templates import TEMPLATES

K, WINDOW, COVERAGE, MOST_WORDS = 3, 2, 0.75, 1_000_000
#: Templates of up to this many words are also found by single words. Their runs are aligned so many words at a time.
SHORT, RUN = 20, 512


#: Words of a document that an alignment spans, in template lengths: each unmatched one costs 1, each match brings 2.
SPAN = 3


def least(m: int, coverage: float) -> int:
    """Matched words that a template of m words needs."""
    return max(1, math.ceil(coverage * m - 1e-9))


def band(m: int) -> int:
    """Half width of the band for a template of m words."""
    return 2 + m // 8


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: list[tuple[str, str, str]] = TEMPLATES):
        self.names = [(a, b) for a, b, _ in templates]
        w = W.words([t for *_, t in templates])
        if len(w.hash) > MOST_WORDS:
            raise ValueError(f"the templates have {len(w.hash)} words; at most {MOST_WORDS} are sent to executors")
        if (np.diff(w.ptr) < K + WINDOW - 1).any():
            raise ValueError(f"a template needs {K + WINDOW - 1} words")
        self.words = [w.hash[a:b] for a, b in zip(w.ptr[:-1], w.ptr[1:], strict=True)]
        at, fp = W.winnow(w, K, WINDOW)
        of = np.searchsorted(w.ptr, at, side="right") - 1
        by = np.argsort(fp, kind="stable")
        self.fp, first = np.unique(fp[by], return_index=True)
        self.ptr = np.append(first, len(fp))
        self.template, self.place = of[by], (at - w.ptr[of])[by]
        self.short = [t for t, x in enumerate(self.words) if len(x) <= SHORT]
        self.vocabulary = np.unique(np.concatenate([self.words[t] for t in self.short])) if self.short else np.zeros(0, np.uint64)
        #: Of each short template: how often it has each word of the vocabulary.
        self.times = [np.bincount(np.searchsorted(self.vocabulary, self.words[t]), minlength=len(self.vocabulary)) for t in self.short]

    def runs(self, words: np.ndarray, doc: np.ndarray, coverage: float) -> dict[int, list[tuple[int, int, int]]]:
        """By document: (short template, first word, end word) where at least its share of words is near; words of all documents, numbered."""
        out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        if not len(self.vocabulary) or not len(words):
            return out
        row = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[row] == words)
        row, doc_at = row[at], doc[at]
        for t, times in zip(self.short, self.times, strict=True):
            mine = times[row] > 0
            p, d = at[mine], doc_at[mine]
            m = len(self.words[t])
            need = least(m, coverage)
            if len(p) < need:
                continue
            last = np.minimum(np.searchsorted(p, p + SPAN * m), np.searchsorted(d, d, side="right"))
            i = np.flatnonzero(last - np.arange(len(p)) >= need)
            if not len(i):
                continue
            # A word counts as often as the template has it: if that many of the same before it lie outside.
            v = row[mine]
            by = np.argsort(v, kind="stable")
            back = np.arange(len(p)) - times[v[by]]
            same = (back >= 0) & (v[by][back] == v[by])
            older = np.empty(len(p), np.int64)
            older[by] = np.where(same, p[by][back], -1)
            count = np.zeros(len(i), np.int64)
            for k in range(int((last - np.arange(len(p))).max())):
                h = i + k
                count += (h < last[i]) & (older[np.minimum(h, len(p) - 1)] < p[i])
            i = i[count >= need]
            if not len(i):
                continue
            begin, end, of = p[i], p[last[i] - 1] + 1, d[i]
            new = np.concatenate(([True], (begin[1:] > end[:-1]) | (of[1:] != of[:-1])))
            k = np.flatnonzero(new)
            for a, b, i in zip(begin[k].tolist(), end[np.append(k[1:], len(end)) - 1].tolist(), of[k].tolist(), strict=True):
                out[i].append((t, a, b))
        return out


def align(a: np.ndarray, b: np.ndarray, diagonal: int, half: int) -> tuple[int, int, int]:
    """Best local alignment of template a in words b along b-index - a-index = diagonal +- half: matched words, span in b."""
    m, n, width = len(a), len(b), 2 * half + 1
    off = np.arange(width)
    h = np.zeros((m + 1, width + 1), np.int32)
    for i in range(1, m + 1):
        j = i - 1 + diagonal - half + off  # index in b of each place of the band
        inside = (j >= 0) & (j < n)
        same = inside & (b[np.clip(j, 0, n - 1)] == a[i - 1])
        x = np.maximum(h[i - 1, :width] + np.where(same, 2, -1), h[i - 1, 1:] - 1)
        x = np.where(inside, np.maximum(x, 0), 0)
        x = np.maximum.accumulate(x + off) - off  # gaps in the template cost 1 a word
        h[i, :width] = np.where(inside, x, 0)
    i, o = np.unravel_index(int(np.argmax(h[:, :width])), (m + 1, width))
    if not h[i, o]:
        return 0, 0, 0
    i, o, matched = int(i), int(o), 0
    end = first = i + diagonal - half + o
    while i > 0 and h[i, o] > 0:
        j = i - 1 + diagonal - half + o
        v = h[i, o]
        same = a[i - 1] == b[j]
        if v == h[i - 1, o] + (2 if same else -1):
            matched += bool(same)
            first = j
            i -= 1
        elif o > 0 and v == h[i, o - 1] - 1:
            o -= 1
        elif v == h[i - 1, o + 1] - 1:
            i, o = i - 1, o + 1
        else:
            break
    return matched, first, end


def align_run(words: np.ndarray, lo: int, hi: int, t: int, index: Index, coverage: float) -> list[tuple[int, int, int, int]]:
    """Findings of a short template in words[lo:hi]: the best alignment, then those on both sides of it."""
    a = index.words[t]
    m, found = len(a), []
    need, step = least(m, coverage), max(RUN, 2 * SPAN * m)
    # Pieces overlap by more than an alignment spans.
    todo = [(x, min(hi, x + step)) for x in range(lo, max(lo + 1, hi - SPAN * m), step - SPAN * m)]
    while todo:
        lo, hi = todo.pop()
        b = words[lo:hi]
        if np.isin(b, a).sum() < need:
            continue
        matched, x, y = align(a, b, 0, len(b) + m)
        if matched >= need:
            found.append((t, lo + x, lo + y, matched))
        if matched:
            todo += [(lo, lo + x), (lo + y, hi)]
    return list(dict.fromkeys(found))


def scan_words(words: np.ndarray, at: np.ndarray, post: np.ndarray, index: Index, coverage: float, runs: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, int, int]]:
    """Findings (template, first word, end word, matched) of one document, given its fingerprints' places and index rows."""
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p, r in zip(at.tolist(), post.tolist(), strict=True):
        for x in range(index.ptr[r], index.ptr[r + 1]):
            hits[int(index.template[x])].append((p - int(index.place[x]), int(index.place[x])))
    found = [x for t, lo, hi in runs for x in align_run(words, lo, hi, t, index, coverage)]
    for t, all_hits in hits.items():
        m = len(index.words[t])
        half = band(m)
        all_hits.sort()
        begin = 0
        for k in range(1, len(all_hits) + 1):
            if k < len(all_hits) and all_hits[k][0] - all_hits[k - 1][0] <= half:
                continue
            group, begin = all_hits[begin:k], k
            low, high = group[0][0], group[-1][0]
            middle, spread = (low + high) // 2, half + (high - low + 1) // 2
            lo, hi = max(0, low - half), min(len(words), high + m + half)
            matched, a, b = align(index.words[t], words[lo:hi], middle - lo, spread)
            if matched >= coverage * m:
                found.append((t, lo + a, lo + b, matched))
    found.sort(key=lambda f: (-f[3], -f[3] / len(index.words[f[0]]), f[0], f[1]))
    kept: list[tuple[int, int, int, int]] = []
    for f in found:
        if all(2 * (min(f[2], g[2]) - max(f[1], g[1])) < min(f[2] - f[1], g[2] - g[1]) for g in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: (f[1], f[0]))


def license_findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, template, start, end, n_matched, coverage): spans are offsets in the text."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Index(templates))

    def f(ids: np.ndarray, texts: list) -> dict | None:
        index = shared.value
        w = W.words(texts)
        at, fp = W.winnow(w, K, WINDOW)
        row = np.minimum(np.searchsorted(index.fp, fp), len(index.fp) - 1)
        hit = index.fp[row] == fp
        at, row = at[hit], row[hit]
        doc = np.searchsorted(w.ptr, at, side="right") - 1
        runs = index.runs(w.hash, w.doc, coverage)
        out = []
        for i in np.union1d(doc, np.array([*runs], np.int64)).tolist():
            mine, a, b = doc == i, w.ptr[i], w.ptr[i + 1]
            near = [(t, lo - a, hi - a) for t, lo, hi in runs.get(i, ())]
            for t, lo, hi, n in scan_words(w.hash[a:b], at[mine] - a, row[mine], index, coverage, near):
                out.append((int(ids[i]), *index.names[t], int(w.start[a + lo]), int(w.end[a + hi - 1]), n, round(n / len(index.words[t]), 6)))
        if not out:
            return None
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
        return {k: pa.array(c, t) for k, c, t in zip(("doc_id", "license", "template", "start", "end", "n_matched", "coverage"), zip(*out, strict=True), kinds, strict=True)}

    return map_texts(select_text(df, id_col, text_col), f, "doc_id long, license string, template string, start int, end int, n_matched int, coverage double")
