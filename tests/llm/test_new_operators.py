"""Spelling variants, De Bruijn dedup and FP-tree search against plain versions, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import debruijn_dedup, fp_search, spelling_variants

SCHEMA = "doc_id long, text string"


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs, every, min_count):
    n = Counter()
    for id_, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= min_count}
    out = {}
    for w in n:
        others = [v for v in n if near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form = best if best and n[best] >= 5 * n[w] else None
        out[w] = (form, n[w], len(others), n[form] if form else None)
    rows = []
    for w, (form, k, around, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, k, around, form_n))
    return sorted(rows)


def variant_docs():
    rng = random.Random(11)
    bases = ["banana", "aaaaaa", "aabbaa", "mississippi", "étéété", "ÀÀéßß÷a", "straßen", "x" * 70]
    docs = []
    for i in range(60):
        words = []
        for b in bases:
            for _ in range(rng.choice([1, 3, 9])):
                w = list(b)
                if rng.random() < 0.3:
                    at = rng.randrange(len(w))
                    kind = rng.randrange(3)
                    w[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice("abé")]
                words.append("".join(w).upper() if rng.random() < 0.2 and b.isascii() else "".join(w))
        docs.append((i, rng.choice([" ", "-", "1"]).join(words)))
    return docs


@pytest.mark.parametrize("every", [None, 7])
def test_variants_equal_all_pairs(spark, every):
    docs = [*variant_docs(), (None, "banana banana aaaaaa"), (61, None), (62, ""), (1, "banana mississippi"), (63, "solitary " * 9)]
    df = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA + ", word string").repartition(5)
    got = spelling_variants.spelling_variants(df, edit_every=every)
    rows = sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect())
    want = plain_variants(docs, every, 5)
    assert rows == want and any(r[1] for r in want) and any(r[4] == 0 for r in want)


def test_forms_are_followed_to_their_end(spark):
    counts = [(f"chain{'a' * (9 - k)}{'b' * k}", 2 * 6**k) for k in range(8)]
    counts = [(w, n) for w, n in counts if n >= 2]
    got = spelling_variants.variants(spark.createDataFrame(counts, "word string, n long"), min_count=1)
    assert {r["word"]: r["root"] for r in got.collect()} == {w: counts[-1][0] for w, _ in counts}


def test_variants_of_hot_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "BLOCK_CHARS", 50)
    monkeypatch.setattr(spelling_variants, "HELD_WORDS", 3)
    text = "banana bananas " * 500 + "y" * 300
    df = spark.createDataFrame([(1, text)] * 6, SCHEMA)
    got = {r["word"]: (r["n"], r["n_near"]) for r in spelling_variants.spelling_variants(df).collect()}
    assert got == {"banana": (3000, 1), "bananas": (3000, 1), "y" * 300: (6, 0)}
    assert spelling_variants.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_dedup(docs, k=13):
    seen = {}
    for id_, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        for i in range(len(words) - k + 1):
            w = tuple(words[i : i + k])
            if id_ is not None:
                seen[w] = min(seen.get(w, id_), id_)
    out = []
    for id_, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = set()
        for i in range(len(words) - k + 1):
            if id_ is not None and seen[tuple(words[i : i + k])] < id_:
                gone |= set(range(i, i + k))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((id_, len(words), len(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def passage_docs():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)] + ["é x", "中"]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randrange(10, 90))) for _ in range(12)]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            if rng.random() < 0.6:
                p = rng.choice(passages).split(" ")
                a = rng.randrange(len(p))
                parts.append(rng.choice([" ", "\n", "\t\x0b"]).join(p[a:] if rng.random() < 0.5 else p))
            else:
                parts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))))
        docs.append((i, " ".join(parts)))
    docs += [(200 + i, docs[3][1]) for i in range(40)] + [(300, "a " * 400), (301, "a " * 200), (302, "a b " * 100), (303, "b a " * 100)]
    return docs


def dedup_rows(got):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], r["kept_sha256"]) for r in got.collect()), key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("batch", [2 << 20, 500])
def test_dedup_equals_all_windows(spark, batch, monkeypatch):
    monkeypatch.setattr(debruijn_dedup, "BATCH_BYTES", batch)
    monkeypatch.setattr(debruijn_dedup, "BUCKET_BYTES", 2000)
    docs = [*passage_docs(), (None, passage_docs()[3][1]), (400, None), (401, ""), (402, " \n"), (403, "only twelve words here")]
    df = spark.createDataFrame([(*d, 1) for d in docs], SCHEMA + ", h int").repartition(6)
    got = debruijn_dedup.remove_repeats(df)
    want = plain_dedup(docs)
    assert dedup_rows(got) == want and sum(r[2] for r in want) > 1000


def test_rows_of_one_id_cover_nothing_of_each_other(spark):
    docs = passage_docs()[:30]
    again = [*docs, *docs[:10], (5, docs[9][1]), (9, docs[5][1])]
    got = debruijn_dedup.remove_repeats(spark.createDataFrame(again, SCHEMA))
    assert dedup_rows(got) == plain_dedup(again)
    assert debruijn_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_spans_that_differ_are_given_up(spark, monkeypatch):
    """Anchors and edges as if by colliding hashes: every edge of a place alike."""
    docs = [(1, " ".join(f"a{i}" for i in range(40))), (2, " ".join(f"b{i}" for i in range(40))), (3, " ".join(f"a{i}" for i in range(20)))]
    df = spark.createDataFrame(docs, SCHEMA)
    true = debruijn_dedup.spans(df)
    h = {r["id"]: r["h"] for r in debruijn_dedup._texts(df, "doc_id", "text").collect()}
    false = spark.createDataFrame([(2, h[2], 0, 5, 1, h[1], 0), *map(tuple, true.select(*debruijn_dedup._RUN).collect())], debruijn_dedup._RUN_SCHEMA)
    monkeypatch.setattr(debruijn_dedup, "spans", lambda *_: false)
    assert dedup_rows(debruijn_dedup.remove_repeats(df)) == plain_dedup(docs)


def test_unitigs_are_cut_where_spans_begin_and_end(spark):
    words = [f"a{i}" for i in range(60)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:40])), (3, " ".join(words[20:]))]
    got = debruijn_dedup.unitigs(debruijn_dedup.spans(spark.createDataFrame(docs, SCHEMA)))
    assert sorted((r["src_id"], r["start"], r["end"], r["spans"]) for r in got.collect()) == [(1, 0, 20, 1), (1, 20, 28, 2), (1, 28, 48, 1)]


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_search(items, docs, k=10):
    low = {c: c + 32 for c in range(65, 91)}
    terms = lambda t: TERM.findall((t or "").translate(low))
    texts = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for *_, n in texts), sum(n for *_, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for id_, tf, n in texts:
            score = 0
            for t in terms(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * (25 + 75 * n * n_docs // total)))
            if score > 0:
                scored.append((-score, -(2**63) if id_ is None else id_))
        out += [(item, rank, None if i == -(2**63) else i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def search_docs():
    rng = random.Random(13)
    words = [f"w{min(int(rng.paretovariate(0.6)), 60)}" for _ in range(4000)] + ["É", "中文", "Mixed"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 80)))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(60)]  # copies: ties to the smaller id
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(25)]
    return items, docs


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [16_384, 40])
def test_search_equals_scoring_all(spark, size, monkeypatch):
    monkeypatch.setattr(fp_search, "TREE_DOCS", size)
    items, docs = search_docs()
    docs += [(None, docs[3][1]), (500, None), (501, ""), (502, "-- !"), (3, "w1 w2 w3"), (503, "w1 " * 5000)]
    items += [(30, None), (31, ""), (32, "nowhere"), (33, "W1 w1 w1"), (None, "w2 w3")]
    got = fp_search.rank_documents(
        spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int"), spark.createDataFrame([(*d, 1) for d in docs], SCHEMA + ", score int").repartition(3)
    )
    assert found(got) == plain_search(items, docs)


def test_items_go_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(fp_search, "ITEM_ROWS", 7)
    monkeypatch.setattr(fp_search, "ITEM_BYTES", 300)
    items, docs = search_docs()
    df = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(fp_search.item_blocks(df, "item_id", "text"))
    assert sorted(r["place"] for b in blocks for r in b) == list(range(len(items))) and len(blocks) > 4
    assert found(fp_search.rank_documents(df, spark.createDataFrame(docs[:60], SCHEMA))) == plain_search(items, docs[:60])


def test_empty_search_tables(spark):
    items, docs = spark.createDataFrame([(1, "a")], "item_id long, text string"), spark.createDataFrame([(1, "a")], SCHEMA)
    for i, d in ((items.limit(0), docs), (items, docs.limit(0)), (items, docs.filter("doc_id > 1"))):
        got = fp_search.rank_documents(i, d)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_spare_most_documents():
    """A node's bound is never below a score under it, and documents that can't enter are not looked at."""
    rng = np.random.default_rng(13)
    n, terms = 3000, 200
    vectors = [np.unique(rng.zipf(1.3, 20) % terms) for _ in range(n)]
    doc_of = np.repeat(np.arange(n), [len(v) for v in vectors])
    df = np.bincount(np.concatenate(vectors), minlength=terms)
    order = np.argsort(df, kind="stable")
    rank = np.empty(terms, np.int64)
    rank[order] = np.arange(terms)
    term = rank[np.concatenate(vectors)]
    by = np.lexsort((term, doc_of))
    doc_of, term = doc_of[by], term[by]
    tf, m, ids = rng.integers(1, 5, len(term)), rng.integers(25, 300, n), rng.permutation(n)
    weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df[order] + 1))).astype(np.int64)
    tree = fp_search.build(doc_of, term, tf, ids, m, weight)
    scores = defaultdict(int)
    query, times = np.array([3, 50, 120, 199]), np.array([1, 2, 1, 1])
    gain = fp_search.gains(weight[term], tf, m[doc_of])
    for d, t, g in zip(doc_of, term, gain, strict=True):
        for q, k in zip(query, times, strict=True):
            scores[int(d)] += int(g) * int(k) if t == q else 0
    looked = []

    def doc_scores(docs):
        looked.extend(docs)
        return np.array([scores[int(d)] for d in docs])

    best = fp_search.Best(10)
    fp_search.search(tree, query, times, doc_scores, ids, best)
    want = sorted((-s, int(ids[d])) for d, s in scores.items() if s > 0)[:10]
    assert list(zip((-best.score).tolist(), best.id.tolist(), strict=True)) == want
    assert len(looked) < n / 4
