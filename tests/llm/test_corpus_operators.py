"""The text-corpus operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lumenreel.llm import chat, decontam, line_dedup, ngram_jaccard, packing, quality, secrets, sharding, substring, warc
from lumenreel.llm.common import components, numbered, Scratch
from lumenreel.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def corpus(spark, extra=()):
    """Documents of all kinds: long, empty, null, copies, near copies, shared passages, repeated rows, null ids."""
    texts = [" ".join(words(80 + 10 * i, i)) for i in range(12)]
    base = words(300, 99)
    for k in range(6):
        near = list(base)
        for j in random.Random(k).sample(range(300), k):
            near[j] = f"x{k}{j}"
        texts.append(" ".join(near))
    passage = " ".join(words(60, 5))
    texts += [f"{' '.join(words(40, 100 + i))}\n{passage}\n{' '.join(words(30, 200 + i))}" for i in range(4)]
    texts += ["", None, "one", "one two", "One  TWO", " \t\n", "a b c d e", "a b c d e", "x " * 3000, " ".join(words(20000, 7, 50000))]
    rows = [(i, t, "en", f"s{i % 2}", None) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[1], None, None, 5), (None, None, None, None, None), *extra]
    return spark.createDataFrame(rows, DOCS).withColumn("label", F.lit(1)).withColumn("node", F.lit(2)).withColumn("n_words", F.lit(9))


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_numbered_and_components(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(100)] + [(None, 1), (None, 2)], "k int, v int")
    rows = numbered(df, ["k"], [F.xxhash64("v"), F.col("v")], "n", 8).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.k].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(rows) == 102
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(edges, Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


def jaccard_truth(rows, percent, size):
    sets = collections.defaultdict(list)
    for d, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()
        sets[d].append(s)
    ids = [d for d in sets if d is not None]
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted(((d, len(s), root(d) if d is not None else None) for d, v in sets.items() for s in v), key=str)


@pytest.mark.parametrize(("percent", "size"), [(85, 4), (80, 5), (60, 2)])
def test_jaccard_classes_are_exact(spark, percent, size):
    docs = corpus(spark)
    got = ngram_jaccard.jaccard_classes(spark, docs, percent, size).collect()
    want = jaccard_truth([(r.doc_id, r.text) for r in docs.collect()], percent, size)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_jaccard_on_random_small_sets(spark):
    r = random.Random(1)
    rows, doc = [], 0
    for _ in range(60):
        base = words(r.randrange(3, 60), r.random(), 5000)
        for _ in range(3):
            near = list(base)
            for _ in range(r.randrange(0, 4)):
                near[r.randrange(len(near))] = f"y{r.randrange(10**6)}"
            rows.append((doc, " ".join(near), None, None, None))
            doc += 1
    df = spark.createDataFrame(rows, DOCS)
    got = ngram_jaccard.jaccard_classes(spark, df, 70, 1).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == jaccard_truth([(x[0], x[1]) for x in rows], 70, 1)


def test_jaccard_long_lists_cross_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "CHUNK", 4)
    docs = corpus(spark)
    got = ngram_jaccard.jaccard_classes(spark, docs, 60, 2).collect()
    want = jaccard_truth([(r.doc_id, r.text) for r in docs.collect()], 60, 2)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_jaccard_of_sets_that_share_a_node_id(spark):
    docs = corpus(spark)
    # hashes of four bits: nearly all sets share one, and take the second
    got = ngram_jaccard.jaccard_classes(spark, docs, 80, 5, bits=4).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == jaccard_truth(rows, 80, 5)
    kept = ngram_jaccard.first_of_class(spark, docs, 80, 5, bits=4)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == first_truth(rows, 80, 5)[0]


def first_truth(rows, percent, size):
    """The rows (id, text) that stay: of each class of linked texts the one of the least id, nulls last."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                up[root(i)] = root(j)
    best, out = {}, []
    for i, (doc, t) in enumerate(rows):
        if not sets[i]:
            out.append((doc, t))
        elif doc is not None:
            best[root(i)] = min(best.get(root(i), (doc, t)), (doc, t))
    out += best.values()
    nulls = {root(i) for i, (doc, _) in enumerate(rows) if doc is None and sets[i]} - set(best)
    return sorted(out, key=str), len(nulls)


def test_jaccard_empty_and_first_of_class(spark):
    assert ngram_jaccard.jaccard_classes(spark, empty(spark)).count() == 0
    unlike = [" ".join(words(50, 700 + i)) for i in range(4)]
    # ids with two texts, with a text that is another's copy, null ids with texts that others have or only they have
    extra = [(800, unlike[0]), (800, unlike[1]), (801, unlike[1].upper()), (802, unlike[2]), (None, unlike[2]), (None, unlike[3]), (None, unlike[3]), (700, unlike[2]), (802, "another text")]
    docs = corpus(spark, [(i, t, None, None, None) for i, t in extra]).withColumn("row", F.lit(1)).withColumn("text_hash", F.lit(2))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = ngram_jaccard.first_of_class(spark, docs, 80, 5)
    assert kept.columns == docs.columns
    want, nulls = first_truth(rows, 80, 5)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    filled = [r for r in got if r[0] is None and (r[1] or "").strip()]
    assert sorted((r for r in got if r not in filled), key=str) == want
    assert filled == [(None, unlike[3])] and nulls == 1
    assert {(800, unlike[0]), (800, unlike[1]), (700, unlike[2]), (802, "another text")} <= set(got)
    assert ngram_jaccard.first_of_class(spark, empty(spark)).count() == 0


def test_substring_dedup(spark):
    docs = corpus(spark)
    got = substring.without_repeats(spark, docs, 20).withColumn("sha", F.sha2("text", 256)).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r[k] for k in ("doc_id", "n_words", "n_removed", "sha")) for r in got), key=str) == sorted(substring.brute_force(rows), key=str)
    assert sum(r.n_removed for r in got) > 1000
    assert substring.without_repeats(spark, empty(spark)).count() == 0


@pytest.mark.parametrize("size", [4, 7])
def test_substring_dedup_small_windows(spark, size):
    # ids from 0 to 39, of which some have two or three texts
    rows = [(i % 40, " ".join(words(30, i, 4)), None, None, None) for i in range(70)]
    rows += [(50, " ".join(words(60, 1, 9)), None, None, None), (50, " ".join(words(60, 2, 9)), None, None, None), (50, " ".join(words(60, 3000, 10**6)), None, None, None), (50, " ".join(words(60, 2, 9)), None, None, None)]
    got = substring.without_repeats(spark, spark.createDataFrame(rows, DOCS), size, 2).withColumn("sha", F.sha2("text", 256)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.sha) for r in got) == sorted(substring.brute_force([(r[0], r[1]) for r in rows], size))
    assert [r.n_removed for r in got if r.text == rows[72][1]] == [0]


def line_truth(rows, ratio, least, copies):
    """(id, text, lines, removed) of rows (id, host, text), by counting pages."""
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    pages, have = collections.Counter(), collections.Counter()
    seen = set()
    for _, host, text in rows:
        if not copies and (host, text) in seen:
            continue
        seen.add((host, text))
        pages[host] += 1
        have.update((host, x) for x in {bare(x) for x in (text or "").split("\n")} if x)
    out = []
    for i, host, text in rows:
        parts = [] if text is None else text.split("\n")
        gone = [bool(bare(x)) and have[host, bare(x)] >= least and have[host, bare(x)] > pages[host] * ratio for x in parts]
        out.append((i, None if text is None else "\n".join(x for x, g in zip(parts, gone, strict=True) if not g), sum(bool(bare(x)) for x in parts), sum(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("copies", [True, False])
@pytest.mark.parametrize(("ratio", "least"), [(0.3, 3), (0.07, 2)])
def test_line_dedup(spark, copies, ratio, least):
    rows = [(i, f"top {i}\nall rights reserved \n\nbody {i}\nall rights reserved", "en", "a", None) for i in range(20)]
    rows += [(100 + i, "all rights reserved", "en", "b", None) for i in range(2)] + [(200, None, None, None, None), (201, "", None, None, None)]
    rows += [(300 + i, f"footer\n{i}", None, None, None) for i in range(5)] + [(400 + i, "copied\npage", "en", "c", None) for i in range(9)] + [(500 + i, f"own {i}", "en", "c", None) for i in range(9)]
    rows += [(600 + i, f"foot\n{i}" if i < 3 else f"{i}", "en", "d", None) for i in range(9)] + [rows[3], (3, "top 3", "en", "a", None), (None, "top 3\nx", "en", "a", None), (700, "a\n" * 5000, "en", "e", None)]
    docs = spark.createDataFrame(rows, DOCS)
    for clash in ("n_lines", "N_removed", "host", "site", "often", "kept", "_line_host", "_line_hashes", "row"):
        docs = docs.withColumn(clash, F.lit(7))
    found = line_dedup.without_boilerplate(docs, ratio=ratio, min_pages=least, copies=copies)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in found.select("doc_id", "text", "n_lines", "n_removed").collect()), key=str) == line_truth([(r[0], r[3], r[1]) for r in rows], ratio, least, copies)
    assert {"n_lines_input", "N_removed_input", "_line_host", "often", "row"} <= set(found.columns) and found.agg(F.min("n_lines_input"), F.max("often")).first() == (7, 7)
    assert line_dedup.without_boilerplate(empty(spark)).count() == 0


def test_line_dedup_counts_pages_of_the_host(spark):
    # a third of the host's pages are one page: with copies it is boilerplate, without it stays; the footer goes in both
    rows = [(i, "copied\npage\nfooter", "en", "c", None) for i in range(10)] + [(100 + i, f"own {i}\nfooter", "en", "c", None) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    on = {r.doc_id: r.text for r in line_dedup.without_boilerplate(docs).collect()}
    off = {r.doc_id: r.text for r in line_dedup.without_boilerplate(docs, copies=False).collect()}
    assert on[0] == "" and off[0] == "copied\npage" and on[100] == off[100] == "own 0"


def base_truth(text):
    w = WORD.findall(text or "")
    lines, seen, dup = [x for x in (text or "").split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def tokens_of(text):
    return regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+", (text or "").lower())


def quality_truth(spark, rows, trusted, toxic, buckets=quality.BUCKETS, prior=quality.PRIOR):
    """(score, kept) of each row (id, text), with the engine's hash taken as given."""
    seen = {t for _, x in rows for t in tokens_of(x)}
    pairs = {(a, b) for _, x in rows for a, b in zip([None, *tokens_of(x)], tokens_of(x), strict=False)}
    one = {r.t: r.h for r in spark.createDataFrame([(t,) for t in seen], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    table = spark.createDataFrame([(a and one[a], one[b]) for a, b in pairs], "a long, b long").distinct().select("a", "b", F.pmod(F.xxhash64("a", "b"), F.lit(buckets)).alias("h")).collect()
    two = {(r.a, r.b): r.h for r in table}

    def grams(text):
        h = [one[t] for t in tokens_of(text)]
        return [x % buckets for x in h] + [two[a, b] for a, b in zip([None, *h], h, strict=False)]

    raw, target, bad, good = (collections.Counter() for _ in range(4))
    counts = {True: 0, False: 0}
    for doc, text in rows:
        raw.update(grams(text))
        if doc is not None and doc in trusted | toxic:
            counts[doc in toxic] += 1
            (bad if doc in toxic else good).update(set(tokens_of(text)))
        if doc is not None and doc in trusted:
            target.update(grams(text))
    n, m = sum(raw.values()), sum(target.values())
    marks = {t for t, x in bad.items() if x >= quality.MARKER_ROWS and x >= counts[True] * quality.MARKER_SHARE and counts[False] and np.log((x + 0.5) / (counts[True] + 1)) - np.log((good[t] + 0.5) / (counts[False] + 1)) >= quality.MARKER_RATIO}
    strong = {t for t in marks if bad[t] >= counts[True] * quality.STRONG_SHARE}
    out = []
    for _, text in rows:
        g = collections.Counter(grams(text))
        score = sum(k * np.log((target[x] + prior * raw[x] / n) / (m + prior) / (raw[x] / n)) for x, k in g.items()) / max(1, sum(g.values())) if m else 0.0
        found = set(tokens_of(text)) & marks
        out.append((score, bool(not base_truth(text)[-1] and score >= quality.THRESHOLD and len(found) < 2 and not found & strong)))
    return out


def test_quality_rules(spark):
    rows = [(i, " ".join(words(60, i)), None, "s", None) for i in range(30)] + [(100 + i, " | ".join(words(60, 50 + i)), None, "s", None) for i in range(10)]
    rows += [(200, None, None, None, None), (201, "", None, None, None), (202, "ä ö\nä ö\n\n ä ö", None, None, None), (203, "a b c d e f " * 9, None, None, None), (None, "é " * 12, None, None, None), (0, rows[0][1], None, None, None), (204, "long text " * 30000, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    for clash in ("score", "kept", "N_words", "trusted", "id", "row", "toxic", "_words", "_lines", "_weights", "_trusted"):
        docs = docs.withColumn(clash, F.lit(3))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100, 0, 0), (101, 1, 1), (None, 1, 0), (25, None, None)], "doc_id long, quality int, toxic int").withColumn("trusted", F.lit(0)).withColumn("text", F.lit("x"))
    found = quality.judged(docs, labels, buckets=64, prior=50.0)
    got = found.select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept").collect()
    assert len(got) == len(rows) and found.agg(F.max("score_input"), F.max("kept_input"), F.max("N_words_input"), F.max("_words"), F.max("trusted")).first() == (3, 3, 3, 3, 3)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_truth(r.text)
    want = quality_truth(spark, [(r.doc_id, r.text) for r in got], set(range(20)), {101}, 64, 50.0)
    for r, (score, kept) in zip(got, want, strict=True):
        assert r.score == pytest.approx(score, abs=1e-9) and r.kept == kept
    kept = quality.kept_rows(docs, labels, buckets=64, prior=50.0)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == sorted(r.text for r in got if r.kept)
    assert quality.judged(empty(spark), labels).count() == 0
    assert quality.judged(docs, labels.limit(0)).filter("score <> 0").count() == 0


@pytest.mark.parametrize("trusted", [1, 3, 20])
def test_quality_ratio_has_no_bias_by_size(spark, trusted):
    # documents of one distribution, however few of them are trusted, score near 0 and are kept
    docs = spark.createDataFrame([(i, " ".join(words(200, i, 40)), "en", "s", None) for i in range(20)], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(trusted)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels).collect()
    assert all(r.kept and abs(r.score) < 0.1 for r in got)


def test_quality_rules_drop_toxic_prose(spark):
    bad, rare, weak = ["scum", "moron"], ["langue", "propre"], ["sot", "vil", "bas"]
    # 0-99 and 230-329 trusted, 100-199 labelled toxic, among them two in a language of their own and six with words that few have;
    # 200-229 unlabelled, every third toxic
    texts = [words(80, i, 12) for i in range(330)]
    for i in (*range(100, 192), *range(200, 230, 3)):
        texts[i][i % 60] = bad[i % 2].upper()
    for i in (198, 199, 201):
        texts[i] += rare
    for i in range(192, 198):
        texts[i] += weak
    texts[202] += weak[:1]
    texts[204] += weak[:2]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", None) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i in (*range(200), *range(230, 330))], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judged(docs, labels, buckets=64).filter("kept").collect()}
    # one weak marker isn't enough, two are; words of only two toxic documents are none
    assert kept == set(range(330)) - set(range(100, 198)) - set(range(200, 230, 3)) - {204}
    assert {r.doc_id for r in quality.kept_rows(docs, labels, buckets=64).collect()} == kept
    clean = labels.filter("toxic = 0")
    assert quality.judged(docs, clean, buckets=64).filter("kept").count() == 330


def secrets_truth(text):
    text = text or ""
    found = []
    for k, (kind, pattern) in enumerate((("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))):
        for m in re.finditer(pattern, text):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    spans = [s for _, _, s in sorted(found)]
    return [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")] + [hashlib.sha256(",".join(spans).encode()).hexdigest()], spans


def test_secret_scans(spark):
    r = random.Random(3)
    key = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/": "".join(r.choice(a) for _ in range(n))
    texts = [f"hé 😀 PassWord = 'abc{i}defgh' and {key(40)} then AKIA{key(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789')} x {key(32, '0123456789abcdef')}" for i in range(20)]
    texts += [None, "", "token=abc secret=token:abcdefgh", "password: hunter22222", "AKIAAKIA123", "deadbeef" * 3, "api_key='x1y2z3' apikey:abcdef", "internationalizationofthethings and theotherlongwordsthatpeoplewrite", "Token:Secret=pass=word123", "tokentoken=  abcdef", "q" * 5000, "0" * 64, "é token=abcdefg\n" * 700]
    docs = spark.createDataFrame([(i if i != 5 else None, t, None, None, None) for i, t in enumerate([*texts, texts[0]])], DOCS).withColumn("spans", F.lit(1))
    got = secrets.scanned(spark, docs).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        want, spans = secrets_truth(None if row.doc_id is None else [*texts, texts[0]][row.doc_id]) if row.doc_id is not None else secrets_truth(texts[5])
        assert [row.n_assign, row.n_access, row.n_hex, row.base_sha256] == want
        assert set(spans) <= set(row.spans.split(",") if row.spans else [])
    by = {r.doc_id: r.spans for r in got}
    assert all("random" in by[i] for i in range(20) if i != 5) and "random" not in by[27] and "random" not in by[30] and "random" not in by[31]
    assert secrets.scanned(spark, empty(spark)).count() == 0


def test_random_tokens_outside_base_spans(spark):
    r = random.Random(7)
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [upper + upper.lower() + digits + "+/", digits + "ABCDEF", upper + "234567", upper.lower() + digits]
    vocabulary = ["station", "harbour", "letter", "morning", "signal", "window", "bridge", "garden", "summer", "market", "engine", "coastal", "paper", "winter", "reading", "quiet", "yellow", "mountain", "river", "table"]
    texts, planted = [], []
    for i in range(1200):
        n, alphabet = r.choice((32, 40, 48, 64)), r.choice(alphabets)
        token = "".join(r.choice(alphabet) for _ in range(n))
        ws = [r.choice(vocabulary) for _ in range(5)]
        other = r.choice(("_".join(ws), "".join(w.capitalize() for w in ws), "/".join(ws), "".join(ws), (ws[0] * 9)[:40], upper.lower() + digits))
        texts.append(f"on the {ws[0]} {token} lay {other} and more")
        planted.append((7 + len(ws[0]) + 1, n, len(alphabet)))
    got = {x.doc_id: x.spans for x in secrets.scanned(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found, false, missed = collections.Counter(), 0, collections.Counter()
    for i, (start, n, size) in enumerate(planted):
        spans = [tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s.startswith("random")]
        hit = (start, start + n) in spans
        found[n, size] += hit
        missed[n, size] += not hit
        false += len(spans) - hit
    recall = lambda ns, sizes=(64, 16, 32, 36): sum(found[k] for k in found if k[0] in ns and k[1] in sizes) / sum(found[k] + missed[k] for k in found if k[0] in ns and k[1] in sizes)
    assert recall((48, 64)) >= 0.97 and recall((32, 40), (64,)) >= 0.9 and recall((40,)) >= 0.8
    assert false <= 0.05 * sum(found.values())


def test_packing(spark):
    from tokenizers import Tokenizer

    docs = corpus(spark, [(900, "<|endoftext|> x <|endoftext|>", None, None, None), (901, "it's  'S ſ \n\n\t 12३ ж́", None, None, None)])
    own = Tokenizer.from_file(tokenizer_path())
    got = packing.packed(spark, docs, tokenizer_path(), 256, 2, part_rows=20).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    want = collections.Counter()
    for r in docs.collect():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 2]
        first, at = len(ids) % 256 or 256, 0
        for n in [first] + [256] * ((len(ids) - first) // 256):
            want[r.doc_id, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at += n
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= packing.lower_bound(np.bincount([r.length for r in got], minlength=257)) + 1
    assert packing.packed(spark, empty(spark), tokenizer_path()).count() == 0


def test_lower_bound_and_best_fit():
    r = np.random.default_rng(0)
    for _ in range(30):
        lengths = np.sort(r.integers(1, 65, r.integers(1, 80)))[::-1].copy()
        where, offset, bins = packing.best_fit_decreasing(lengths, 64)
        assert packing.lower_bound(np.bincount(lengths, minlength=65)) <= bins and np.bincount(where, weights=lengths).max() <= 64
    bound = lambda lengths: packing.lower_bound(np.bincount(lengths, minlength=65))
    assert bound([33] * 5) == 5 and bound([22] * 6) == 3


def pieces_of(spark, lengths):
    return spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")


def test_certified_partitions_settle_and_others_give_up_what_is_not_full(spark):
    # in one partition: three halves and a bit need three sequences, which the bound proves; all but the emptiest are settled
    rows = packing.packed_once(pieces_of(spark, [40, 40, 40, 24]), 0, 1, 64).collect()
    assert {(r.bins, r.bound) for r in rows} == {(3, 3)} and sorted(r.length for r in rows if r.open) == [40]
    # best fit decreasing takes five here and the bound is four: what isn't full is given up
    lengths = [38, 35, 35, 33, 27, 20, 16, 16, 14, 10, 7]
    rows = packing.packed_once(pieces_of(spark, lengths), 0, 1, 64).collect()
    bins, bound = rows[0].bins, rows[0].bound
    assert (bins, bound) == (5, 4)
    used = collections.Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert {r.sequence_id for r in rows if r.open} == {k for k, n in used.items() if n < 64} and packing.certificate(pieces_of(spark, lengths), 64) == 4


def test_packing_stops_at_the_bound(spark, monkeypatch):
    rounds, own = [], packing.packed_once
    monkeypatch.setattr(packing, "packed_once", lambda rows, turn, parts, most: rounds.append(parts) or own(rows, turn, parts, most))
    docs = spark.createDataFrame([(i, "a" * (i % 7)) for i in range(400)], "doc_id long, text string")
    got = packing.packed(spark, docs, tokenizer_path(), 64, 2, part_rows=100).collect()
    least = packing.lower_bound(np.bincount([r.length for r in got], minlength=65))
    assert rounds[0] == 4 and least <= len({r.sequence_id for r in got}) <= least + 1
    # a bound that nothing reaches keeps the exchange going until it saves no more
    monkeypatch.setattr(packing, "lower_bound", lambda count: 0)
    before, rounds[:] = len(rounds), []
    again = packing.packed(spark, docs, tokenizer_path(), 64, 2, part_rows=100).collect()
    assert len(rounds) >= before and least <= len({r.sequence_id for r in again}) <= least + 1
    # one that is reached at once ends it: certified partitions that together need no more than all pieces do
    monkeypatch.undo()
    monkeypatch.setattr(packing, "packed_once", lambda rows, turn, parts, most: rounds.append(parts) or own(rows, turn, parts, most))
    rounds[:] = []
    full = spark.createDataFrame([(i, " a" * 31) for i in range(400)], "doc_id long, text string")
    assert packing.packed(spark, full, tokenizer_path(), 64, 2, part_rows=100).select("sequence_id").distinct().count() >= 200 and len(rounds) <= 2


def test_only_plain_files_run_in_the_faster_engine(tmp_path):
    with open(tokenizer_path(), encoding="utf-8") as f:
        made = json.load(f)
    assert packing.is_plain(made)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": made["model"] | {"ignore_merges": True}}, {"model": made["model"] | {"merges": made["model"]["merges"][::-1]}}):
        assert not packing.is_plain(made | change)
    text = " " * 200_000 + "x"
    from tokenizers import Tokenizer

    assert packing.encoder(tokenizer_path())(text).tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_sequences_hold_the_ids(spark):
    docs = corpus(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.sequences(spark, docs, tokenizer_path(), 256).collect()
    assert all(len(r.ids) <= 256 for r in rows) and sum(r.ids.count(2) for r in rows) >= docs.count()


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}?q=ä b\n", f"<p>{'é' * (i % 7)}</p>" * 50) for i in range(40)] + [(50, None, None), (51, "", ""), (None, "u", "<p></p>" * 50), (39, "dup", rows_text(39)), (60, "big", "z" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit(1))
    warc.write_archives(spark, pages, str(tmp_path / "a"))
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    by = collections.defaultdict(list)
    for p, _, h in rows:
        by[h or ""].append(p)
    want = []
    for p, _, h in rows:
        m = max((x for x in by[h or ""] if x is not None), default=None)
        payload = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((p, len(payload), digest, *(("response", None) if p == m else ("revisit", m))))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert {r.url for r in got if r.page_id == 3} == {"http://h/3?q=ä b\n"}
    assert warc.archived(spark, pages.limit(0), str(tmp_path / "b")).count() == 0
    small = warc.write_archives(spark, pages, str(tmp_path / "c"), revisit_from=1000) or warc.read_archives(spark, str(tmp_path / "c"))
    assert all(r.record_type == "response" for r in small.collect() if r.payload_bytes < 1000)


def rows_text(i):
    return f"<p>{'é' * (i % 7)}</p>" * 50


def test_warc_rejects_damage():
    sha1 = hashlib.sha1(b"hello").digest()
    good = warc.record(1, "u", b"hello", sha1, None, "d")
    archive = warc.archive_of([good] * 20)
    assert [r["payload"] for r in warc.records(archive)] == [b"hello"] * 20
    swapped = [good.replace(a, b) for a, b in ((b"hello", b"jello"), (b"WARC/1.1", b"WARC/0.9"), (b"WARC-Date: d\r\n", b""), (b"Content-Length: 5", b"Content-Length: 6"), (b"Content-Length: 5", b"Content-Length: x"), (b"X-Payload-Length: 5", b"X-Payload-Length: 4"), (b"WARC-Type: response", b"WARC-Type: other"), (b"WARC-Date: d", b"WARC-Date: d\r\nWARC-Date: d"), (b"WARC-Date: d", b"WARC-Date: d\r\nno colon"))]
    for bad in (archive[:-3], archive + b"\0" * 9, archive[:60] + b"\xff" + archive[61:], *map(lambda x: warc.archive_of([x]), [good[:-1], *swapped])):
        with pytest.raises(warc.BadRecord):
            list(warc.records(bad))


def test_warc_reads_other_archives(spark, tmp_path):
    import struct

    import zstandard

    def made(kind, block, *more):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1-2>", "WARC-Date: 2024-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    body = b"<p>hello</p>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    sha = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    found = [
        made("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        made("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        made("response", http, "WARC-Target-URI: http://h/a%20b", "Content-Type: application/http;", "  msgtype=response", f"WARC-Payload-Digest: {sha(body)}", f"WARC-Block-Digest: sha1:{hashlib.sha1(http).hexdigest()}"),
        made("response", http.replace(b"\r\n\r\n", b"\r\nTransfer-Encoding: chunked\r\n\r\n"), "Content-Type: application/http", f"WARC-Payload-Digest: {sha(b'something else')}"),
        made("metadata", b"", "WARC-Payload-Digest: md5:00"),
        made("revisit", b"", "WARC-Refers-To: <urn:uuid:9>", f"WARC-Payload-Digest: {sha(body)}"),
    ]
    dictionary = zstandard.ZstdCompressionDict(b"WARC/1.0 WARC-Type: response" * 20)
    raw = dictionary.as_bytes()
    with_it, without = zstandard.ZstdCompressor(dict_data=dictionary), zstandard.ZstdCompressor()
    lead = lambda data: struct.pack("<II", warc.DICTIONARY_MAGIC, len(data)) + data
    archives = [b"".join(map(without.compress, found)), lead(raw) + b"".join(map(with_it.compress, found)), lead(without.compress(raw)) + b"".join(map(with_it.compress, found))]
    (tmp_path / "a").mkdir()
    for i, archive in enumerate(archives):
        got = list(warc.records(archive))
        assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "response", "metadata", "revisit"]
        assert got[2]["payload"] == body and got[2]["url"] == "http://h/a b" and got[2]["page_id"] is None and got[2]["record_id"] == "urn:uuid:1-2"
        assert (got[5]["payload_bytes"], got[5]["payload_digest"], got[5]["refers_to"]) == (None, sha(body)[5:], None)
        (tmp_path / "a" / f"{i}.warc.zst").write_bytes(archive)
    rows = warc.read_archives(spark, str(tmp_path / "a"), pattern="*.warc.zst").collect()
    assert len(rows) == 18 and sum(bytes(r.payload) == body for r in rows) == 6
    with pytest.raises(warc.BadRecord):
        list(warc.records(without.compress(made("response", http, "Content-Type: application/http", f"WARC-Payload-Digest: {sha(b'x')}"))))


def contained_truth(docs, items, share=0.8, size=5):
    """(doc, item): (shared, all) of each pair of texts by comparing the sets of shingles, as text."""
    plain = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    grams = lambda w, n: {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = {}
    for item, text in items:
        w = plain(text)
        if item is None or not w:
            continue
        n = min(len(w), size)
        want = grams(w, n)
        for doc, body in docs:
            shared = len(want & grams(plain(body), n))
            if doc is not None and shared >= np.ceil(len(want) * share):
                out[doc, item] = max(out.get((doc, item), (0, 0)), (shared, len(want)))
    return sorted((*k, *v) for k, v in out.items())


def test_decontamination(spark):
    item, short = words(30, 1000), ["q1", "q2", "q3"]
    long = words(20000, 5, 10**6)
    rows = [(0, " ".join([*long, *item, *long[:50]])), (1, " ".join(w.upper() + "," for w in item)), (2, " ".join(item[:20])), (3, "q1 q2  Q3!"), (4, "x q1 q2 q3"), (5, None), (6, ""), (None, " ".join(item)), (1, "again"), (7, " ".join([*item[:10], "zz", *item[10:]])), (8, "q1 q2"), (2, "no item here"), (9, "q1 q3 q2 q2")]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    for clash in ("item_id", "hash", "key", "row", "need", "_found", "_words"):
        docs = docs.withColumn(clash, F.lit(5))
    tests = [(1, " ".join(item)), (2, " ".join(short)), (3, None), (4, "!!"), (None, " ".join(item)), (5, " ".join(item)), (5, " ".join(item)), (6, "again")]
    items = spark.createDataFrame(tests, "item_id long, text string")
    want = contained_truth(rows, tests)
    assert {(0, 1, 26, 26), (7, 5, 22, 26), (3, 2, 1, 1), (4, 2, 1, 1), (1, 6, 1, 1)} <= set(want) and not any(d in (2, 8, 9) for d, *_ in want)
    for most in (10**6, 0):
        assert sorted(tuple(r) for r in decontam.contained(spark, docs, items, broadcast_rows=most).collect()) == want
    # without an item's text: also where the id is null, or another row with the id holds it
    left = decontam.without_items(spark, docs, items)
    gone = {t for d, t in rows if contained_truth([(1, t)], tests)}
    assert left.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, (r for r in rows if r[1] not in gone)))
    assert (None, " ".join(item)) in [r for r in rows if r[1] in gone] and len(gone) == 7
    assert decontam.contained(spark, docs, items.limit(0)).count() == 0 and decontam.contained(spark, empty(spark), items).count() == 0
    assert decontam.without_items(spark, docs, items.limit(0)).count() == len(rows)


def test_decontamination_of_random_items(spark):
    r = random.Random(8)
    tests = [(i, " ".join(words(r.randrange(1, 60), 5000 + i, 300))) for i in range(60)]
    rows = []
    for i in range(150):
        body = words(r.randrange(0, 300), 9000 + i, 300)
        for _ in range(r.randrange(0, 3)):
            part = r.choice(tests)[1].split()
            cut = r.randrange(0, max(1, len(part) // 4))
            at = r.randrange(len(body) + 1)
            body[at:at] = part[cut:]
        rows.append((i, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.contained(spark, docs, spark.createDataFrame(tests, "item_id long, text string"))
    assert sorted(tuple(x) for x in got.collect()) == contained_truth(rows, tests)


def test_decontamination_partitions_bound_what_documents_show(spark):
    values = F.array(*[F.lit(x).cast("long") for x in (-50, -20, 0, 30, 90)])
    show = lambda classes: spark.range(1).select(decontam.shown(values, classes).alias("x")).first().x
    # too small a document for the second partition shows nothing on its account
    assert show([(3, -20), (6, 100)]) == [-50, -20] and show([(3, -20), (5, 40)]) == [-50, -20, 0, 30] and show([(6, 100)]) == [] and show([]) == []
    tests = spark.createDataFrame([(1, " ".join(words(8, 1))), (2, " ".join(words(100, 2)))], "item_id long, text string")
    by = {r.item_id: r for r in decontam.sketches(tests, 0.8, 5).collect()}
    assert by[1].size_class != by[2].size_class and by[1].need == 4 and len(by[1].sketch) == 1 and by[2].need == 77 and len(by[2].sketch) == 20


def test_sharding(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i // 4}" if i % 2 else None if i % 11 == 0 else f"u{i}", None, None, None) for i in range(700)] + [(None, "same", None, None, None), (3, "same", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit(1)).withColumn("n", F.lit(1))
    got = sharding.sharded(spark, docs, 7).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 702 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = dict((r[0], r[1]) for r in rows)
    for r in got:
        t = (text[r.doc_id] if r.doc_id is not None else "same") or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "rows", None)
    groups = collections.defaultdict(set)
    for r in got:
        if r.doc_id is not None and (text[r.doc_id] or "").startswith("t"):
            groups[text[r.doc_id]].add(r.shard)
    assert not any(len(v) > 1 for v in groups.values())
    links, cut = sharding.cut_edges(sharding.placed_rows(spark, docs, 7)).first()
    alike = collections.Counter(text.get(r.doc_id, "same") if r.doc_id is not None else "same" for r in got)
    assert links == sum(n - 1 for t, n in alike.items() if t is not None)
    # only the copies that no shard has room for are cut off
    assert alike["same"] > 702 / 7 and cut == alike["same"] - max(collections.Counter(r.shard for r in got if (text.get(r.doc_id, "same") if r.doc_id is not None else "same") == "same").values())
    assert sharding.sharded(spark, empty(spark)).count() == 0


@pytest.mark.parametrize(("sizes", "single", "shards"), [((50, 50, 45, 30, 13, 120), 212, 10), ((5, 4, 3, 2, 2, 2), 182, 40), ((30, 30, 30), 0, 2)])
def test_sharding_cuts_only_groups_without_room(spark, sizes, single, shards):
    rows = [(f"g{k}",) for k, n in enumerate(sizes) for _ in range(n)] + [(f"u{i}",) for i in range(single)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, (t,) in enumerate(rows)], DOCS)
    got = sharding.sharded(spark, docs, shards).collect()
    count, found = collections.Counter(r.shard for r in got), collections.defaultdict(set)
    for r in got:
        found[rows[r.doc_id][0]].add(r.shard)
    full = len(rows) / shards
    assert len(got) == len(rows) and max(count.values()) - min(count.values()) <= 1 and len(count) == shards
    whole = [-(-n // int(full)) for n in sizes]
    # three groups of two thirds of a shard can't all be whole in two shards
    assert sorted(len(found[f"g{k}"]) for k in range(len(sizes))) == ([1, 1, 2] if not single else sorted(whole))


def test_chat_formatting(spark):
    tricky = ["", None, "\\", "\\\\### Assistant: </turn> ok", "####", "</turn></turn>\n### user\n", "ä😀\\n\\", "<</turn>", "##", "#" * 7, "</turn", "\\### Assistant: </turn> ok"]
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(tricky)] + [(2, 0, None, "x"), (2, 1, "a\nb###\\", "y"), (None, 0, "assistant", "z"), (3, None, "user", "q"), (3, None, "user", "q"), (4, 5, "assistant", "long " * 50000)]
    rows += [(10 + i, 0, f"role{i}", "t") for i in range(70)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(1)).withColumn("loss", F.lit(1))
    spoken = chat.formatted(spark, turns)
    back = {r.conv_id: chat.turns_of(r.formatted) for r in spoken.collect()}
    want = collections.defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda x: (str(x[0]), -1 if x[1] is None else x[1])):
        want[c].append((role or "", text or ""))
    assert back == want
    for r in chat.digests(spoken).collect():
        learnt = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(want[r.conv_id]), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want[r.conv_id]).encode()).hexdigest()
    assert chat.formatted(spark, turns.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage against brute force, on documents with all that can be odd about them."""
    import corpus_pipeline as p

    item = " ".join(words(40, 4242))
    header = "shared header line of the site"
    rows = [(i, f"{header}\n{' '.join(words(400, i))}", f"s{i % 2}") for i in range(40)]
    rows += [(500 + i, " | ".join(words(60, 900 + i)), "s0") for i in range(5)] + [(600 + i, f"{header}\n{' '.join(words(100, 650 + i))} scum", "s1") for i in range(9)]
    rows += [(100, rows[7][1] + " tail", "s1"), (101, f"{' '.join(words(60, 77))} {item} {' '.join(words(20, 78))}", "s0"), (102, "", "s0"), (103, None, None), (104, "too short", "s1"), (105, " ".join(words(20000, 7)), "s0")]
    # ids with several texts, repeated rows, rows without an id: a copy, a new text, one with an item
    rows += [(5, " ".join(words(90, 801)), "s0"), rows[3], rows[3], (None, rows[9][1], "s1"), (None, " ".join(words(90, 802)), None), (None, f"{' '.join(words(60, 803))} {item}", None), (106, f"{header}\n" * 12, "s1")]
    labels = [(d, int(not 500 <= d < 505), int(600 <= d < 605)) for d in (*range(40), *range(500, 505), *range(600, 605))] + [(None, 1, 0)]
    docs = spark.createDataFrame([(d, t, "en", s, None) for d, t, s in rows], DOCS)
    for clash in ("score", "kept", "n_words", "row", "node", "host", "item_id", "key", "length"):
        docs = docs.withColumn(clash, F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    tests = [(1, item), (2, None)]
    spark.createDataFrame(tests, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, seen = docs, []
    for name, stage in p.STAGES:
        at = Scratch(spark).keep(stage(spark, at, str(tmp_path)), name)
        seen.append(at.collect())
        if name != "packing":
            assert at.columns == p.COLUMNS
    texts = [sorted(((r.doc_id, r.text) for r in x), key=str) for x in seen[:4]]
    good, bad = {d for d, q, t in labels if d is not None and q and not t}, {d for d, q, t in labels if d is not None and q and t}
    kept = [r for r, (_, k) in zip(rows, quality_truth(spark, [r[:2] for r in rows], good, bad), strict=True) if k]
    assert texts[0] == sorted((r[:2] for r in kept), key=str) and not {500, 501, 600, 605, 102, 103, 104} & {r[0] for r in kept} and {5, 101, 105} <= {r[0] for r in kept}
    lined = line_truth([(d, h, t) for d, t, h in kept], line_dedup.RATIO, line_dedup.MIN_PAGES, True)
    assert texts[1] == sorted(((d, t) for d, t, _, _ in lined), key=str) and not any(header in t for _, t in texts[1])
    want, nulls = first_truth(texts[1], 80, 5)
    null_rows = [r for r in texts[2] if r[0] is None]
    assert sorted((r for r in texts[2] if r[0] is not None), key=str) == want and len(null_rows) == nulls == 2
    clean = [r for r in texts[2] if not contained_truth([(1, r[1])], tests)]
    assert texts[3] == sorted(clean, key=str) and len(clean) == len(texts[2]) - 2
    ids = packing.encoder(tokenizer_path())
    assert sum(r.length for r in seen[4]) == sum(len(ids(t)) + 1 for _, t in clean) and {r.doc_id for r in seen[4]} == {d for d, _ in clean}
    tables = len(Scratch.made)
    whole = p.run(spark, str(tmp_path)).collect()
    assert len(Scratch.made) == tables + 1  # the run's own
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in seen[4])


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
