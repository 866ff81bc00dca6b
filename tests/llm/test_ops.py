"""Defined results of the operators in corner cases, on small tables."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _words as W
from lodestone.llm import chat_format, decontaminate, html_extract, license_scan, minhash_dedup, packing, quality_rules, substring_dedup, token_output, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    if extra:
        for c in ("a", "b", "spans", "end", "sig", "counts", "failed", "shard", "fp", "tokens", "text_hash", "__gone", "__id", "__hash", "__spans", "__cut", "key", "hash", "place", "node", "band", "language", "threshold", "record", "slot"):
            df = df.withColumn(c, F.lit(1))
    return df


ODD = [(9001, None), (9002, ""), (9003, "  \n\t "), (9004, "..."), (None, "no id here at all"), (9005, "one"), (9005, "one"), (9006, "日本語の文章です"), (9007, "x" * 50_000), (9008, "a b " * 30_000), (9009, "😀 🎉 😀 clown")]


# Words


def test_words_are_runs_of_letters_and_digits():
    w = W.words(["Ab-c é1", None, "ß", "b"])
    assert np.diff(w.ptr).tolist() == [3, 0, 1, 1]
    assert list(zip(w.start.tolist(), w.end.tolist())) == [(0, 2), (3, 4), (5, 7), (0, 1), (0, 1)]
    assert W.words(["ÄRGER"]).hash[0] == W.words(["ärger"]).hash[0]


def test_words_do_not_join_across_documents_and_ideographs_stand_alone():
    assert np.diff(W.words(["ab", "cd"]).ptr).tolist() == [1, 1]
    assert len(W.words(["日本語"]).hash) == 3


def test_winnowing_picks_a_shared_phrase_of_every_long_enough_common_run():
    for seed in range(20):
        common = prose(30, seed)
        a, b = prose(40, seed + 100) + " " + common + " " + prose(9, 1), prose(13, seed + 200) + " " + common
        picks = [set(W.winnow(W.words([t]), 12, 19)[1].tolist()) for t in (a, b)]
        assert picks[0] & picks[1]


def test_winnowing_of_a_document_depends_on_nothing_outside_it():
    t = [prose(80, i) for i in range(5)]
    w = W.words(t)
    at, h = W.winnow(w, 10, 8)
    for i, x in enumerate(t):
        mine = (at >= w.ptr[i]) & (at < w.ptr[i + 1])
        alone = W.winnow(W.words([x]), 10, 8)
        assert (at[mine] - w.ptr[i]).tolist() == alone[0].tolist() and h[mine].tolist() == alone[1].tolist()


# Chat formatting


def test_chat_format_merges_and_orders(spark):
    rows = [(4, 0, "user|>\nx<|end|>\n<|system", "y"), (5, 0, "user", "\n\t"), (5, 1, "\t", "a\n"), (1, 1, "user", "b"), (1, 0, "user", "a"), (1, 2, "assistant", "c"), (1, 2, "assistant", "c"), (1, 3, None, "d"), (1, None, "user", "last"), (1, 4, "user", None), (None, 0, "user", "x"), (2, 0, "user", "  "), (3, 0, " USER ", "<|end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("clash"))
    out = {r.conv_id: r for r in chat_format.chat_format(df).collect()}
    assert set(out) == {1, 3, 4, 5}
    assert out[4].text == "<|user_x_end_system|>\ny<|end|>\n" and out[5].text == "<|unknown|>\na\n<|end|>\n"
    assert out[1].text == "<|user|>\na\nb<|end|>\n<|assistant|>\nc<|end|>\n<|unknown|>\nd<|end|>\n<|user|>\nlast<|end|>\n"
    assert (out[1].n_turns, out[1].n_messages, out[1].roles) == (5, 4, "user,assistant,unknown,user")
    assert out[3].text == "<|user|>\n< |end|><|end|>\n" and out[3].n_chars == len(out[3].text)
    assert chat_format.chat_format(df.limit(0)).count() == 0


# Quality rules


def test_quality_rules(spark):
    good = "The cat of the house is in the garden, and it was on that for a day as with the other. Morning light fell over quiet fields while children carried baskets toward river gates near older mills."
    rows = [(1, good), (2, None), (3, ""), (4, good.upper()), (5, " ".join(w + "$$$" for w in good.split())), (6, "same line here\n" * 9), (7, prose(30, 7)), (10, "the of " * 40), (8, "ok two words"), (1, good)]
    v = quality_rules.verdicts(docs(spark, rows, extra=True))
    failed = {(r.doc_id): r.failed for r in v.collect()}
    assert failed[1] == "" and failed[8] == "" and "length" in failed[2] and "length" in failed[3]
    assert "capitals" in failed[4] and "symbols" in failed[5] and "repeated_lines" in failed[6] and "stop_words" in failed[7] and failed[10] == "repeated_words"
    kept = quality_rules.keep_good(docs(spark, rows, extra=True))
    assert kept.columns == docs(spark, rows, extra=True).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 8]
    assert quality_rules.keep_good(docs(spark, [])).count() == 0
    odd = docs(spark, [(1, good), (2, good), (3, None)]).withColumn("lang", F.when(F.col("doc_id") == 1, None).otherwise("xx"))
    assert sorted(r.doc_id for r in quality_rules.keep_good(odd).collect()) == [1, 2]
    assert next(r for r in quality_rules.RULES if r.name == "length").high == float("inf")
    assert quality_rules.verdicts(docs(spark, ODD)).count() == len(ODD)


# MinHash


def brute_pairs(texts, least, k=minhash_dedup.SHINGLE):
    s = {i: set(zip(*[t.split()[j:] for j in range(k)])) for i, t in texts}
    ids = sorted(s)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if s[a] | s[b] and len(s[a] & s[b]) / len(s[a] | s[b]) >= least}


def test_near_duplicates_against_all_pairs(spark):
    r, rows = random.Random(5), []
    for g in range(25):
        words = prose(150, g).split()
        for v in range(r.choice([1, 2, 5, 12])):
            w = [x if r.random() > 0.04 * (v > 0) else f"e{r.randrange(10**6)}" for x in words]
            rows.append((g * 100 + v, " ".join(w)))
    out = {r.doc_id: r.duplicate_of for r in minhash_dedup.near_duplicates(docs(spark, rows, extra=True)).collect()}
    group = lambda i: out.get(i, i)
    pairs = brute_pairs(rows, 0.6)
    assert sum(group(a) == group(b) for a, b in pairs) >= 0.98 * len(pairs)
    loose = brute_pairs(rows, 0.4)
    linked = {frozenset((a // 100, b // 100)) for a, b in loose}
    assert all(frozenset((a // 100, b // 100)) in linked for a, b in out.items())
    assert all(b < a for a, b in out.items())


def test_near_duplicates_hot_group_and_odd_rows(spark):
    base = prose(90, 1).split()
    r = random.Random(3)
    rows = [(100 + i, " ".join(w if r.random() > 0.05 else f"q{r.randrange(10**6)}" for w in base)) for i in range(150)]
    rows += [(1000 + i, prose(60, 77)) for i in range(60)] + [(1000, prose(60, 77))] + ODD + [(2000, "one")]
    out = {r.doc_id: r.duplicate_of for r in minhash_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert {out[i] for i in range(1001, 1060)} == {1000}
    assert len({out.get(100 + i, 100 + i) for i in range(150)}) == 1
    assert out[9005] == 2000 and not {9001, 9002, 9003, 9004} & set(out)
    kept = minhash_dedup.keep_one(docs(spark, rows, extra=True))
    assert sorted(x for x in (r.doc_id for r in kept.collect()) if x is not None) == [100, 1000, 2000, 9001, 9002, 9003, 9004, 9006, 9007, 9008, 9009]
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_texts_under_one_id_are_told_apart(spark, monkeypatch):
    a, b, c = (prose(60, n) for n in (1, 2, 3))
    rows = [(5, a), (5, b), (5, b), (3, a + " end"), (8, b), (9, c), (9, c), (9, c), (2, None), (2, None), (None, a), (None, a)]
    df = docs(spark, rows, extra=True)
    assert sorted((r.doc_id, r.duplicate_of) for r in minhash_dedup.duplicate_texts(df)[0].collect()) == [(5, 3), (8, 5)]
    want = [(3, a + " end"), (5, b), (9, c), (2, None), (2, None), (None, a), (None, a)]
    for change, most_keys in ((rows, 4_000_000), (rows[::-1], 0)):
        monkeypatch.setattr(minhash_dedup, "MOST_KEYS", most_keys)
        kept = minhash_dedup.keep_one(docs(spark, change, extra=True).withColumn("n_chars", F.monotonically_increasing_id()))
        assert kept.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_large_buckets_are_searched_in_pairs_of_blocks(spark, monkeypatch):
    base, r = prose(90, 1).split(), random.Random(3)
    rows = [(i, " ".join(w if r.random() > 0.13 else f"q{r.randrange(10**6)}" for w in base)) for i in range(120)]
    want = sorted(map(tuple, minhash_dedup.near_duplicates(docs(spark, rows)).collect()))
    monkeypatch.setattr(minhash_dedup, "BLOCK", 7)
    assert sorted(map(tuple, minhash_dedup.near_duplicates(docs(spark, rows)).collect())) == want and want


def test_search_within_a_bucket_finds_all_components():
    r = np.random.default_rng(0)
    centres = r.integers(0, 60000, (4, 20)).astype(np.uint16)
    sig = np.concatenate([np.where(r.random((9, 20)) < 0.2, r.integers(0, 60000, (9, 20)), c).astype(np.uint16) for c in centres])
    pdf = pd.DataFrame({"band": 1, "node": np.arange(len(sig)), "sig": [s.tobytes() for s in sig]})
    found = minhash_dedup._search(20, 0.5)(pdf)

    def components(edges):
        root = list(range(len(sig)))
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    full = [(i, j) for i in range(len(sig)) for j in range(i) if (sig[i] == sig[j]).sum() >= 10]
    assert components(zip(found.a.tolist() * 1, found.b.tolist(), strict=True) and list(zip(found.a, found.b, strict=True))) == components(full)


def test_connected_components_against_union_find(spark):
    from lodestone.session import Scratch

    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    out = {x.node: x.root for x in minhash_dedup.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert out == {x: find(x) for x in root if find(x) != x}


# FM-index


def test_suffix_array_and_search_against_brute_force():
    r = np.random.default_rng(0)
    for n, sigma in ((1, 3), (60, 3), (2500, 5), (800, 300)):
        s = r.integers(1, sigma, n)
        if n == 2500:
            s = np.tile(s[:500], 5)
        t = np.append(s, 0).tolist()
        assert decontaminate.suffix_array(np.append(s, 0), max(1, (sigma - 1).bit_length())).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        index = decontaminate.FMIndex(s, sigma, 8)
        for m in (1, 2, 5):
            if m > n:
                continue
            phrases = np.array([s[i : i + m] for i in range(0, n - m + 1, 37)] + [r.integers(1, sigma, m)])
            for p, a, b in zip(phrases, *index.find(phrases), strict=True):
                assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - m + 1) if (s[i : i + m] == p).all()]


def brute_contaminated(rows, items, n=13, least=5):
    bench = [[W.words([t]).hash.tolist()][0] for t in items if t]
    grams = {tuple(x[i : i + n]) for x in bench if len(x) >= n for i in range(len(x) - n + 1)} | {tuple(x) for x in bench if least <= len(x) < n}
    out = {}
    for d, t in rows:
        w = W.words([t])
        h, spans = w.hash.tolist(), []
        for i in range(len(h)):
            for size in {len(g) for g in grams}:
                if i + size <= len(h) and tuple(h[i : i + size]) in grams:
                    spans.append([i, i + size])
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        if merged:
            out[d] = [(int(w.start[a]), int(w.end[b - 1])) for a, b in merged]
    return out


def test_decontamination_against_brute_force(spark, monkeypatch):
    items = [prose(30, 500), prose(13, 501), prose(7, 502), "too short", None, "", prose(30, 500)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, prose(100, i, 300)) for i in range(30)]
    rows += [(40, prose(20, 1) + "! " + items[0].upper().replace(" ", ",\n") + " " + prose(9, 2)), (41, items[1]), (42, items[2] + " end " + items[2]), (43, " ".join(items[0].split()[4:20])), (44, " ".join(items[0].split()[:12])), *[x for x in ODD if x[0]]]
    expected = brute_contaminated(rows, items)
    assert {40, 41, 42, 43} <= set(expected) and 44 not in expected

    def found():
        out = {}
        for r in decontaminate.contaminated(docs(spark, rows, extra=True), bench).collect():
            out.setdefault(r.doc_id, []).extend(tuple(x) for x in r.spans)
        return out

    assert found() == expected
    monkeypatch.setattr(decontaminate, "SHARD_SYMBOLS", 50)
    monkeypatch.setattr(decontaminate, "MAX_PHRASES", 20)
    assert {k: sorted(v) for k, v in found().items()} == expected
    monkeypatch.undo()
    df = docs(spark, rows + [(None, "without id")], extra=True)
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns
    left = {r.doc_id: r.text for r in clean.collect()}
    assert 41 not in left and None in left and brute_contaminated([x for x in left.items() if x[0]], items) == {}
    for d, t in rows:
        if d not in expected:
            assert left[d] == t
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.decontaminate(df, bench.limit(0)).count() == df.count()


def test_slices_of_the_benchmark_change_no_result(spark, monkeypatch):
    source = prose(200, 7).split()
    items = [" ".join(source[i : i + 30]) for i in range(0, 90, 10)] + [prose(20, 510), prose(15, 511), " ".join(prose(20, 510).split()[4:])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    joined = prose(13, 512).split()
    items_and_joined = [*items, " ".join(joined)]
    bench = bench.union(spark.createDataFrame([(99, items_and_joined[-1])], bench.schema))
    rows = [(1, prose(9, 1) + " " + " ".join(source[:110]) + " " + prose(9, 2)), (1, prose(30, 3) + " " + items[9] + " " + items[10]), (1, prose(30, 3)), (2, " ".join(source[5:25]) + " end"), (2, " ".join(source[5:25]) + " end"), (3, " ".join(joined[:6]) + " " + items[9] + " " + " ".join(joined[6:])), (4, items[0])]
    df = docs(spark, rows, extra=True)

    def both():
        found = sorted((r.doc_id, [tuple(s) for s in r.spans], r.item_ids, r.n_words) for r in decontaminate.contaminated(df, bench).collect())
        return found, sorted((r.doc_id, r.text) for r in decontaminate.decontaminate(df, bench).collect())

    want = both()
    spans = [brute_contaminated([(0, t)], items_and_joined).get(0, []) for _, t in rows]
    cut = lambda t, s: "".join(t[a:b] for a, b in zip([0, *[y for _, y in s]], [*[x for x, _ in s], len(t)], strict=True))
    assert [(d, s) for d, s, *_ in want[0]] == sorted((d, s) for (d, _), s in zip(rows, spans, strict=True) if s)
    assert want[1] == sorted((d, x) for (d, t), s in zip(rows, spans, strict=True) if any(map(str.isalnum, x := cut(t, s))))
    assert all(n == sum(len(W.words([t[a:b]]).hash) for a, b in s) for (d, s, _, n) in want[0] for (e, t), z in zip(rows, spans, strict=True) if (d, s) == (e, z))
    monkeypatch.setattr(decontaminate, "MAX_PHRASES", 60)
    assert both() == want


# Licences


def test_licences(spark):
    mit = next(t for a, n, t in license_scan.TEMPLATES if n == "MIT text")
    words = mit.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 17)
    rows = [(10, prose(50, 1) + "\nReleased under the MIT License. " + prose(30, 2)), (11, prose(20, 3) + " " + edited), (12, "Licensed under CC BY-NC 4.0. And\n Released under the MIT License; Released under the MIT License"), (13, prose(500, 4)), (14, "under the license released"), *ODD, (10, "Licensed under the Apache License, Version 2.0")]
    df = docs(spark, rows, extra=True)
    out = [(r.doc_id, r.license, r.start, r.end, r.coverage) for r in license_scan.license_findings(df).collect()]
    assert Counter((d, x) for d, x, *_ in out) == {(10, "MIT"): 1, (11, "MIT"): 1, (12, "CC-BY-NC-4.0"): 1, (12, "MIT"): 2, (10, "Apache-2.0"): 1}
    text = dict(rows[:5])
    for d, x, a, b, c in out:
        if (d, x) == (10, "MIT"):
            assert text[10][a:b] == "Released under the MIT License" and c == 1
        if d == 11:
            assert c > 0.9 and b - a > 0.9 * len(edited)
    assert license_scan.license_findings(docs(spark, [])).count() == 0


def test_edited_licence_notices_against_full_alignment(spark):
    index = license_scan.Index()
    r, rows, want = np.random.default_rng(5), [], {}
    for t, (_, name, text) in enumerate(license_scan.TEMPLATES):
        m = len(index.words[t])
        if m > 20:
            continue
        for k in range(9):
            w = W.words([text])
            words = [text[a:b] for a, b in zip(w.start, w.end)]
            for x in r.choice(m, int(m * 0.25), replace=False):
                words[x] = f"zz{r.integers(1000)}" if k % 3 else words[x] + " zz"
            rows.append((len(rows), prose(30, k) + " " + " ".join(words) + " " + prose(30, k + 50)))
            h = W.words([rows[-1][1]]).hash
            matched = [(license_scan.align(a, h, 0, len(h))[0], len(a)) for a in index.words if len(a) <= 20]
            if enough := [n for n, of in matched if n >= license_scan.COVERAGE * of]:
                want[rows[-1][0]] = max(enough)
    got = {}
    for x in license_scan.license_findings(docs(spark, rows)).collect():
        got[x.doc_id] = max(x.n_matched, got.get(x.doc_id, 0))
    assert got == want and len(want) > 0.9 * len(rows)
    repeated = " ".join("Released under the mit licence" for _ in range(300))
    assert license_scan.license_findings(docs(spark, [(1, repeated)])).count() == 300


def test_every_single_changed_word_of_a_short_notice_is_found(spark):
    index, rows, want = license_scan.Index(), [], {}
    for t, (_, _, text) in enumerate(license_scan.TEMPLATES):
        m = len(index.words[t])
        if m > 20 or (m - 1) / m < license_scan.COVERAGE:
            continue
        w = W.words([text])
        for x in range(m):
            for new in ("zzyx", ""):
                words = [new if i == x else text[a:b] for i, (a, b) in enumerate(zip(w.start, w.end))]
                rows.append((len(rows), "zq zw " + " ".join(words) + " ze zr"))
                h = W.words([rows[-1][1]]).hash
                want[rows[-1][0]] = max(n for n, of in ((license_scan.align(a, h, 0, len(h))[0], len(a)) for a in index.words if len(a) <= 20) if n >= license_scan.COVERAGE * of)
    got = {}
    for x in license_scan.license_findings(docs(spark, rows)).collect():
        got[x.doc_id] = max(x.n_matched, got.get(x.doc_id, 0))
    assert got == want and len(rows) > 200


def test_long_licences_with_many_altered_words_are_found(spark):
    index, r, rows = license_scan.Index(), np.random.default_rng(3), []
    for t, (_, name, text) in enumerate(license_scan.TEMPLATES):
        m = len(index.words[t])
        if m > 20:
            w = W.words([text])
            for _ in range(6):
                words = [text[a:b] for a, b in zip(w.start, w.end)]
                for x in r.choice(m, int(m * 0.22), replace=False):
                    words[x] = f"zz{r.integers(1000)}"
                rows.append((len(rows), prose(20, len(rows)) + " " + " ".join(words)))
    found = {x.doc_id for x in license_scan.license_findings(docs(spark, rows)).collect()}
    full = {i for i, t in rows for h in [W.words([t]).hash] if any(license_scan.align(a, h, 0, len(h) + len(a))[0] >= license_scan.COVERAGE * len(a) for a in index.words)}
    assert len(found & full) >= 0.97 * len(full) and found <= full and len(full) > 60


def test_banded_alignment_against_the_full_one():
    r = np.random.default_rng(2)
    for _ in range(30):
        a = r.integers(0, 50, 30)
        b = np.concatenate((r.integers(50, 99, r.integers(0, 9)), np.delete(np.where(r.random(30) < 0.1, 77, a), r.integers(0, 30, 2)), r.integers(50, 99, 5)))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        for half in (12, 60):
            matched, lo, hi = license_scan.align(a, b, 3, half)
            assert 0 <= lo < hi <= len(b) and matched <= hi - lo
            assert h.max() <= 2 * matched  # no fewer matches than the best alignment has


# Toxicity


def test_classifier_learns_and_is_calibrated(spark):
    r, rows, labels = random.Random(4), [], []
    for i in range(700):
        toxic = r.random() < 0.2
        w = prose(40, i, 500).split()
        if toxic:
            w[r.randrange(40)] = r.choice(["moron", "idiotic", "idiots"])
        rows.append((i, " ".join(w), "en" if i % 2 else "de", "s", 0))
        labels.append((i, 1, int(toxic)))
    truth = {i: t for i, _, t in labels}
    df = spark.createDataFrame(rows + [(None, "idiot", "en", "s", 0), (9001, None, None, "s", 0), (9002, "", "xx", "s", 0), (9003, "you moron", None, "s", 0)], DOCS).withColumn("score", F.lit(1))
    y = spark.createDataFrame([x for x in labels if x[0] % 5] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = {x.doc_id for x in toxicity.toxic_documents(df, y).collect()}
    held = [i for i in truth if i % 5 == 0]
    assert sum(truth[i] == (i in found) for i in held) / len(held) > 0.95
    assert 9001 not in found and 9002 not in found
    other = df.withColumnRenamed("lang", "language").withColumn("lang", F.lit("zz"))
    assert {x.doc_id for x in toxicity.toxic_documents(other, y, lang_col="language").collect()} == found
    twice = df.unionByName(df.where("doc_id = 1").withColumn("text", F.lit("other text")))
    picked = lambda d: sorted(map(tuple, toxicity.labelled(d.select("doc_id", "text", "lang"), y)[0]))
    assert picked(twice) == picked(twice.orderBy(F.desc("text"))) and len({r[0] for r in picked(twice)}) == len(picked(twice))
    few = toxicity.labelled(df.select("doc_id", "text", "lang"), y, 100, 2000)[0]
    assert 0 < sum(len(r.text) for r in few if r.toxic == 0) <= 2000 and len(few) < 200
    assert toxicity.toxic_documents(df, y.limit(0)).count() == 0
    assert toxicity.toxic_documents(df.limit(0), y).count() == 0


def plain_score(model, text):
    """The network's forward pass, word by word."""
    w = W.words([text])
    rows = toxicity.features(w)
    e = [sum(model.table[r].astype(float) for r in row) for row in rows] + [np.zeros(toxicity.DIM)] * 2
    out = model.last[0]
    k0 = 0
    for k, f, b in zip(toxicity.WIDTHS, model.filters, model.bias, strict=True):
        for c in range(toxicity.FILTERS):
            best = max(sum(float(e[i + j] @ f[j * toxicity.DIM : (j + 1) * toxicity.DIM, c]) for j in range(k)) for i in range(len(rows)))
            out += max(best + b[c], 0) * model.out[k0 + c]
        k0 += toxicity.FILTERS
    return 1 / (1 + np.exp(-out))


def test_scores_against_a_plain_forward_pass():
    model, texts = toxicity.Model(), ["you are an idiot", "one", "", "a b c d e f g", "Ärger über alles, sehr."]
    got = model.scores(W.words(texts))
    for t, s in zip(texts, got, strict=True):
        assert s == pytest.approx(plain_score(model, t) if t else 0.0, abs=1e-5)


def test_best_threshold():
    s, y = np.array([0.9, 0.8, 0.3, 0.2]), np.array([1.0, 1, 0, 0])
    assert toxicity.best_threshold(s, y, np.ones(4)) == pytest.approx(0.55)
    assert toxicity.best_threshold(np.full(4, 0.5), y, np.ones(4)) <= 0.5


def test_every_labelled_document_is_trained_on_and_calibrates(spark):
    r, texts, labels = random.Random(8), {}, []
    for i in range(1800):
        texts[i] = prose(30, i, 300).split()
        labels.append((i, 1, int(r.random() < 0.25)))
    frame = lambda: spark.createDataFrame([(i, " ".join(w), "en" if i % 2 else "de", "s", 0) for i, w in texts.items()], DOCS)
    y = spark.createDataFrame([x for x in labels if x[0] % 5] + [(-7, 1, 0)], "doc_id long, quality int, toxic int")
    first = {x.doc_id for x in toxicity.labelled(frame().select("doc_id", "text", "lang"), y, 150)[0]}
    # One word makes the documents of the first block toxic, another one all others.
    for i, _, t in labels:
        if t:
            texts[i][r.randrange(30)] = "moron" if i in first else "grumblefex"
    run = lambda d: sorted(map(tuple, toxicity.toxic_documents(d, y, per_class=150).collect()))
    found = run(frame())
    hits, new = {x[0] for x in found}, [i for i, _, t in labels if i % 5 == 0]
    toxic = [i for i in new if "grumblefex" in texts[i]]
    assert toxic and sum(i in hits for i in toxic) >= 0.9 * len(toxic)
    clean = [i for i, _, t in labels if i % 5 == 0 and not t]
    assert sum(i in hits for i in clean) <= 0.05 * len(clean)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert run(frame().repartition(5, "text")) == found
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    # A bound on characters is noticed as well.
    few = toxicity.labelled(frame().select("doc_id", "text", "lang"), y, 1000, 2000)[0]
    assert all(x.of > sum(z.toxic == x.toxic for z in few) for x in few)


def test_a_pass_over_one_block_is_its_own_training_however_rare_a_class(spark):
    texts, y = ["you are a moron", "a fine day", "what a moron", "good old times"], [1, 0, 1, 0]
    saved = spark.createDataFrame([(i, 0, t, x) for i, (t, x) in enumerate(zip(y, texts))], "doc_id long, block int, toxic int, text string").coalesce(1)
    for weight in (np.array([0.5, 5.0]), np.array([0.5, 5e6])):
        got, own = toxicity.Model(), toxicity.Model()
        toxicity._advance(got, saved, weight, False, 0)
        w = W.words(texts)
        f = toxicity.features(w)
        own.step([f[a:b] for a, b in zip(w.ptr[:-1], w.ptr[1:])], np.float32(y), weight[y].astype(np.float32), toxicity.RATE, np.random.default_rng([7, 0, 0]))
        assert np.allclose(got.table, own.table, atol=1e-6) and np.allclose(got.table_square, own.table_square, rtol=1e-3, atol=1e-8 * weight.max() ** 2)
        for a, b in zip((*got.dense(), *got.square), (*own.dense(), *own.square)):
            assert np.allclose(a, b, rtol=1e-3, atol=1e-8 * weight.max() ** 2)


def test_thresholds_of_all_rows_against_a_plain_search(spark):
    r = random.Random(5)
    rows = [(r.choice(["en", "de", "", None]), round(r.random(), 2), int(r.random() < 0.3)) for _ in range(600)] + [("xx", 0.5, 1)]
    got, weight = toxicity.best_thresholds(spark.createDataFrame(rows, "lang string, score double, toxic int"), [3.0, 0.5]), np.array([3.0, 0.5])
    plain = lambda part: toxicity.best_threshold(np.array([x[1] for x in part]), np.array([x[2] for x in part]), weight[[x[2] for x in part]])
    assert got == pytest.approx({None: plain(rows)} | {k: plain([x for x in rows if x[0] == k]) for k in ("en", "de")})


# Substrings


def brute_repeats(rows, size=50):
    """By (doc_id, text hash): the merged windows that another doc_id holds too."""
    seen, words = {}, {}
    for d, t in rows:
        if d is not None and t:
            w = words[d, substring_dedup.text_hash(t)] = W.words([t])
            h = w.hash.tolist()
            for i in range(len(h) - size + 1):
                seen.setdefault(tuple(h[i : i + size]), set()).add(d)
    out = {}
    for key, w in words.items():
        h, spans = w.hash.tolist(), []
        for i in range(len(h) - size + 1):
            if len(seen[tuple(h[i : i + size])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + size
                else:
                    spans.append([i, i + size])
        if spans:
            out[key] = [(int(w.start[a]), int(w.end[b - 1])) for a, b in spans]
    return out


def repeated_rows():
    r, shared = random.Random(9), [prose(n, 900 + n) for n in (49, 50, 51, 75, 120, 30)]
    rows = []
    for i in range(120):
        parts = [prose(r.randrange(5, 60), i * 7 + j) for j in range(3)]
        for _ in range(r.choice([0, 0, 1, 2])):
            parts.insert(r.randrange(len(parts)), r.choice(shared))
        rows.append((i, ". ".join(parts)))
    base = prose(300, 4242).split()
    for i in range(25):  # near copies, broken at different places
        rows.append((500 + i, " ".join(w if r.random() > 0.015 else f"z{r.randrange(10**6)}" for w in base)))
    rows += [(600, "again " * 200 + prose(60, 1)), (601, "again " * 90), (602, prose(80, 5) + " " + prose(80, 5))]
    rows += [(3, rows[5][1]), (3, rows[9][1] + " " + shared[3]), (700, shared[2]), (700, shared[2])]  # other texts under one id, a repeated row
    return rows + [(i, t) for i, t in ODD if i != 9008] + [(9008, "a b " * 300)]


@pytest.mark.parametrize("per_shard,per_copy", [(5000, 200000), (7, 200000), (7, 3)])
def test_repeated_passages_against_brute_force(spark, monkeypatch, per_shard, per_copy):
    monkeypatch.setattr(substring_dedup, "PER_SHARD", per_shard)
    monkeypatch.setattr(substring_dedup, "PER_COPY", per_copy)
    rows = repeated_rows()
    out = {}
    for r in substring_dedup.repeated_passages(docs(spark, rows, extra=True)).collect():
        out.setdefault((r.doc_id, r.text_hash), []).append((r.start, r.end))
    assert {k: sorted(v) for k, v in out.items()} == brute_repeats(rows)


def test_remove_repeats_keeps_one_copy_of_every_passage(spark):
    rows = repeated_rows()
    df = docs(spark, rows, extra=True)
    cut = substring_dedup.remove_repeats(df)
    assert cut.columns == df.columns
    left = [(r.doc_id, r.text) for r in cut.collect()]
    assert brute_repeats(left) == {}
    # What recurs is still there once: all its words, and its 5-word phrases but those that a cut's edge broke.
    grams = lambda texts, n=5: {tuple(h[i : i + n]) for t in texts if t for h in [W.words([t]).hash.tolist()] for i in range(len(h) - n + 1)}
    texts = {(d, substring_dedup.text_hash(t)): t for d, t in rows if t and d is not None}
    recurring = grams(texts[k][a:b] for k, spans in brute_repeats(rows).items() for a, b in spans)
    assert len(recurring - grams(t for _, t in left)) <= 0.05 * len(recurring)
    assert {(x,) for g in recurring for x in g} <= grams((t for _, t in left), 1)
    repeats = brute_repeats(rows)
    clean = Counter((d, t) for d, t in rows if not t or d is None or (d, substring_dedup.text_hash(t)) not in repeats)
    assert not clean - Counter(left)
    assert substring_dedup.repeated_passages(docs(spark, [])).count() == 0


# Token output


def test_feistel_is_a_keyed_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        x = token_output.feistel(np.arange(n), n)
        assert sorted(x.tolist()) == list(range(n))
    assert token_output.feistel(np.arange(1000), 1000).tolist() != token_output.feistel(np.arange(1000), 1000, key=1).tolist()


def test_token_output_round_trip(spark, tmp_path):
    from lodestone.llm import _tokens as T

    rows = [(i, prose(60 + i, i)) for i in range(40)] + ODD
    records = token_output.training_order(docs(spark, rows, extra=True), length=16, slots=32).cache()
    folder = "file://" + str(tmp_path / "shards")
    manifest = sorted(token_output.write_shards(records, folder).collect())
    n = records.count()
    assert sum(m.n_slots for m in manifest) == n and all(m.bytes == m.n_slots * 34 for m in manifest)
    read = list(token_output.read_shards(folder, 0, 16, 32))
    assert [s for s, _ in read] == list(range(n))
    assert [s for s, _ in token_output.read_shards(folder, n - 40, 16, 32)] == list(range(n - 40, n))
    place = {r.slot: (r.doc_id, r.part, bytes(r.record)) for r in records.collect()}
    pieces = {}
    for slot, tokens in read:
        pieces.setdefault(place[slot][0], []).append((place[slot][1], tokens.tolist()))
    e = T.encoder(open(T.VOCABULARY, "rb").read())
    for d in (0, 7, 39, 9003, 9006, 9007, 9008, 9009):
        tokens = [t for _, p in sorted(pieces[d]) for t in p]
        assert tokens[-1] == T.END and e.decode(tokens[:-1]) == dict(rows)[d]
    assert len(pieces[9005]) == 2 and not {9001, 9002, None} & set(pieces)
    assert token_output.training_order(docs(spark, [])).count() == 0


def test_packed_tokens_round_trip():
    r = np.random.default_rng(3)
    order = r.permutation(1 << 16)[:20000].astype("<u2")
    for n in (1, 50, 300, 20000):
        tokens = np.concatenate([order[: min(n, 5)], order[r.integers(0, n, 3000)], order[n - 1 : n]])
        data = token_output.pack(tokens, token_output.ranks(order))
        assert token_output.unpack(data, len(tokens), order).tolist() == tokens.tolist()
    assert token_output.unpack(token_output.pack(order[:0], token_output.ranks(order)), 0, order).tolist() == []


def test_written_tokens_take_little_disk(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from lodestone.session import shared_dir

    here = lambda: set(Path(urlparse(shared_dir(spark)).path).glob("tokens-*"))
    before = here()
    tokens = token_output.training_order(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).agg(F.sum("n_tokens")).first()[0]
    (new,) = here() - before
    # Of 16 bits a token; the whole query keeps them, what it shuffles and the shards.
    assert sum(f.stat().st_size for f in new.rglob("*.parquet")) <= 0.435 * 2 * tokens


# HTML


def test_html_extraction_accuracy_and_tolerance(spark):
    field = html_extract.trained()
    hits = total = 0
    for page, y in html_extract.labelled_pages(60, seed=11):
        z = field.decode([html_extract.features(html_extract.blocks(page))])[0]
        assert len(z) == len(y)
        hits, total = hits + int((z == np.array(y)).sum()), total + len(y)
    assert hits / total > 0.95
    odd = [None, "", "plain text only", "<p>unclosed <b>bold<p>next", "<!-- never closed <p>x", "<script>var a='<p>'", "</div></div>", "<<<>>>", "<a href='x>y", "&lt;b&gt; &amp; &copy;", "<div>" * 3000 + "deep"]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(odd)] + [(None, "u", "x"), (3, "u", odd[3])], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r.page_id: r for r in html_extract.main_text(df).collect()}
    assert set(out) == set(range(len(odd))) and out[0].n_blocks == 0 and out[1].text == "" and out[4].n_blocks == 0 and out[3].n_blocks == 2
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_extraction_of_pages_that_the_generator_did_not_make():
    from pages import PAGES

    right = total = 0
    for page, content in PAGES:
        found = html_extract.blocks(page)
        texts = [b[1] for b in found]
        assert set(content) <= set(texts)
        y = html_extract.trained().decode([html_extract.features(found)])[0]
        right += sum((t in content) == bool(k) for t, k in zip(texts, y, strict=True))
        total += len(texts)
        assert sum(k for t, k in zip(texts, y) if t in content) >= 0.75 * len(content)
    assert right / total >= 0.8


@pytest.mark.parametrize(
    "page,want",
    [
        ("<html><head><title>x</title><body><article><p>One two.<p>Three", ["One two.", "Three"]),
        ("<head><title>never closed<body><p>a", ["a"]),
        ("<head><meta charset=x>text", ["text"]),
        ("<head><script>if (a</b>c) '</head>'</script></head>t", ["t"]),
        ("<p>a<select><option>b<option>c<p>after</p>", ["a", "after"]),
        ("a<select><option>b</select>c", ["ac"]),
        ("<svg><p>in", ["in"]),
        ("<noscript>hidden</noscript><p>x<noscript>y", ["xy"]),
        ("<p>x<style>p{}", ["x"]),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
        ("<p>a<h2>b</h2>c", ["a", "b", "c"]),
    ],
)
def test_optional_tags(page, want):
    assert [b[1] for b in html_extract.blocks(page)] == want


def test_ancestors_end_where_their_optional_end_tags_would_be():
    tags = {b[1]: b[0] for b in html_extract.blocks("<body><p>a<div>b</div><ul><li>c<p>d<li>e</ul><table><tr><td><p>f<td>g</table>")}
    assert tags == {"a": ("body", "p"), "b": ("body", "div"), "c": ("body", "ul", "li"), "d": ("body", "ul", "li", "p"), "e": ("body", "ul", "li"), "f": ("body", "table", "tr", "td", "p"), "g": ("body", "table", "tr", "td")}


def test_digits_anywhere_in_a_block_count():
    a, b = (html_extract.features([(("p",), "x" * 200 + t, 0)])[0] for t in ("7", "y"))
    assert set(a) ^ set(b) == {html_extract.FLAGS + 4}


def test_viterbi_against_all_labellings():
    import itertools

    r = np.random.default_rng(0)
    field = html_extract.Field()
    field.emit, field.move, field.start = r.normal(size=field.emit.shape), r.normal(size=(2, 2)), r.normal(size=2)
    pages = [[[int(x) for x in r.integers(0, html_extract.SIZE, 3)] for _ in range(n)] for n in (1, 4, 0, 6)]
    for page, got in zip(pages, field.decode(pages), strict=True):
        def score(y, page=page):
            e = sum(field.emit[f][:, k].sum() for f, k in zip(page, y, strict=True))
            return e + (field.start[y[0]] if y else 0) + sum(field.move[a, b] for a, b in zip(y, y[1:]))

        assert tuple(got.tolist()) == max(itertools.product((0, 1), repeat=len(page)), key=score)


# Packing


def naive_pack(demand, limits):
    left, bins = list(range(len(demand))), []
    weight = demand.mean(0) / limits
    while left:
        room, now = limits.astype(float).copy(), []
        while fit := [i for i in left if (demand[i] <= room).all()]:
            scores = [(demand[i] / limits) @ (weight * (room / limits)) for i in fit]
            i = fit[int(np.argmax(np.round(scores, 12)))]
            now.append(i)
            left.remove(i)
            room = room - demand[i]
        bins.append(now)
    return bins


def test_packing_against_a_naive_version_of_the_heuristic():
    r, limits = np.random.default_rng(1), np.array([100.0, 6, 60])
    for n in (0, 1, 60):
        d = np.stack((r.integers(1, 100, n), r.integers(1, 3, n), r.integers(0, 60, n)), 1)
        d = d[np.lexsort((-d[:, 1], -d[:, 2], -d[:, 0]))]
        got = packing.pack(d, limits)
        bins = naive_pack(d, limits) if n else []
        total = [d[got == k].sum(0) for k in range(len(set(got.tolist())))]
        assert all((t <= limits).all() for t in total) and (got >= 0).all()
        assert sorted(sorted(d[b].tolist()) for b in bins) == sorted(sorted(d[got == k].tolist()) for k in range(len(total)))


def test_packing_places_every_part_once_within_the_limits(spark):
    rows = [(i, i * 37 % 900, 1 + i % 3, i * 11 % 400) for i in range(300)] + [(400, 25000, 1, 900), (401, 10, 100, 0), (402, None, None, None), (403, 0, 0, 0), (404, -5, 1, 9000), (5, 5, 1, 5), (None, 3, 1, 1)]
    limits = packing.Limits(1000, 8, 500)
    df = spark.createDataFrame(rows, "doc_id long, tokens long, segments long, loss long").withColumn("part", F.lit("clash"))
    out = packing.pack_examples(df, limits, group=64).collect()
    assert all(r.tokens <= 1000 and r.segments <= 8 and r.loss_tokens <= 500 for r in out)
    assert sum(r.tokens for r in out) == sum(max(0, t or 0) for d, t, *_ in rows if d is not None)
    assert sum(r.loss_tokens for r in out) == sum(x or 0 for d, _, _, x in rows if d is not None)
    placed = Counter((d, p) for r in out for d, p in zip(r.doc_ids, r.parts))
    assert placed[(5, 0)] == 2 and all(v == 1 for k, v in placed.items() if k != (5, 0))
    assert {d for d, _ in placed} == {d for d, *_ in rows if d is not None}
    assert len({r.pack_id for r in out}) == len(out)
    assert packing.pack_examples(df.limit(0)).count() == 0


def test_packing_conversations_and_documents(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, "Assistant", "good day"), (2, 0, "user", None), (None, 0, "user", "x")]
    out = packing.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == 1 and sorted(out[0].doc_ids) == [1, 2] and 0 < out[0].loss_tokens < out[0].tokens
    packs = packing.pack_documents(docs(spark, ODD, extra=True)).collect()
    assert {d for r in packs for d in r.doc_ids} == {i for i, _ in ODD if i}
