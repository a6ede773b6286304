"""Exact, near and substring de-duplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkscrub.llm.components import connected_components
from sparkscrub.llm.exact_dedup import LsmDigestIndex, drop_exact_duplicates, exact_duplicates
from sparkscrub.llm.near_dedup import drop_near_duplicates, near_duplicates
from sparkscrub.llm.substrings import SuffixAutomaton, repeated_passages, window_anchors
from sparkscrub.llm.words import hash_words, runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall(text or "")


@pytest.mark.parametrize("keep,pick", [("max", max), ("min", min)])
def test_exact(docs, rows, keep, pick):
    groups = defaultdict(list)
    for i, text, _ in rows:
        groups[text or ""].append(i)
    want = Counter((i, pick(groups[t or ""]), len(groups[t or ""]), i == pick(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    got = exact_duplicates(docs, keep).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.text_digest).hex()) for r in got) == want


def test_exact_small_memtables(docs, rows):
    index = LsmDigestIndex(docs.sparkSession, "max", memtable_rows=3)
    index.flush(docs)
    index.compact()
    best = {}
    for i, text, _ in rows:
        best[text or ""] = max(i, best.get(text or "", -1))
    assert {r.keep_id for r in index.level1.collect()} == set(best.values())


def test_exact_grows_by_batches(spark, docs, rows):
    index = LsmDigestIndex(spark, "min")
    index.flush(docs.where("doc_id % 2 = 0"))
    index.compact()
    fresh = docs.where("doc_id % 2 = 1")
    seen = {t or "" for i, t, _ in rows if i % 2 == 0}
    new = {r.doc_id for r in index.unseen(fresh).collect()}
    assert new == {i for i, t, _ in rows if i % 2 == 1 and (t or "") not in seen}
    index.flush(fresh)
    assert index.compact().count() == len({t or "" for _, t, _ in rows})


def test_exact_drop_keeps_columns(docs, rows, none):
    out = drop_exact_duplicates(docs)
    assert out.columns == docs.columns and {r.keep_id for r in out.collect()} == {9}
    assert sorted(r.doc_id for r in out.collect()) == sorted(min(i for i, t, _ in rows if (t or "") == u) for u in {t or "" for _, t, _ in rows})
    assert exact_duplicates(none).count() == 0


def shingles(text, k):
    w = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_near(rows, k, percent):
    sets = {}
    for i, text, _ in rows:
        sets[i] = shingles(text, k)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("k,block", [(4, 300_000), (5, 700)])
def test_near(docs, rows, k, block):
    got = near_duplicates(docs, k, 80, block=block).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_near(rows, k, 80)


def test_near_drop(docs, rows, none):
    want = [i for i, (_, _, kept) in brute_near(rows, 5, 80).items() if kept]
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(want)
    assert near_duplicates(none).count() == 0


def test_near_drops_only_the_rows_judged(spark):
    a, b = (" ".join(f"{c}{j}" for j in range(100)) for c in "ab")
    docs = [(1, a), (None, a + " more"), (None, "clean"), (None, None), (3, a + " end"), (3, "unlike the others"), (None, b)]
    left = drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter(map(tuple, left)) == Counter(d for k, d in enumerate(docs) if k not in (1, 4))


def test_one_of_repeated_rows_stays(spark):
    a, b = (" ".join(f"{c}{j}" for j in range(30)) for c in "ab")
    data = [(1, a, "x"), (1, a, "x"), (1, a, "y"), (2, a, "x"), (None, b, None), (None, b, None), (3, None, "x"), (3, None, "x"), (4, "", "x"), (1, a + " end", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    exact = Counter((r.doc_id, r.text) for r in drop_exact_duplicates(df).collect())
    assert exact == Counter([(1, a), (None, b), (3, None), (1, a + " end")])
    near = Counter((r.doc_id, r.text) for r in drop_near_duplicates(df).collect())
    assert sorted(near.values(), reverse=True) == [2, 1, 1, 1] and near[(3, None)] == 2 and near[(4, "")] == 1 and near[(None, b)] == 1 and near[(1, a)] + near[(1, a + " end")] == 1


def test_added_columns_do_not_replace_those_of_the_caller(spark):
    df = spark.createDataFrame([(1, "a", 5, 6), (2, "b", 7, 8)], "doc_id long, text string, block long, bits long")
    index = LsmDigestIndex(spark)
    index.flush(df.where("doc_id = 1"))
    index.compact()
    assert index.unseen(df).collect() == [(2, "b", 7, 8)]
    assert {r.doc_id: (r.keep_id, r.group_size, r.block) for r in index.probe(df).collect()} == {1: (1, 1, 5), 2: (None, None, 7)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def brute_passages(rows, window):
    count = Counter()
    for _, text, _ in rows:
        w = split(text)
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for i, text, _ in rows:
        w = split(text)
        keep = [True] * len(w)
        for a in range(len(w) - window + 1):
            if count[tuple(w[a : a + window])] > 1:
                keep[a : a + window] = [False] * window
        left = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((i, len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window,bounds", [(35, {}), (35, {"shard_words": 60, "block_words": 100}), (4, {}), (1, {})])
def test_passages(docs, rows, window, bounds):
    got = repeated_passages(docs, window, **bounds).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_passages(rows, window)


def test_passages_of_one_anchor_in_many_contexts(spark):
    """One gram holds the anchor of windows of very many words: its shard is cut by whole windows."""
    common = " ".join(f"c{j}" for j in range(8))
    rows = [(i, " ".join(f"d{i}x{j}" for j in range(4)) + f" {common} " + " ".join(f"e{i % 7}y{j}" for j in range(4)), "") for i in range(150)]
    rows += [(900, "z " * 3000, ""), (901, "z " * 700, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = repeated_passages(df, 10, gram=5, shard_words=60, block_words=100, run=64).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_passages(rows, 10)


def test_passages_of_broken_texts(spark):
    rows = [(1, b"\xff\xfe " + b"same words here " * 20), (2, b"same words here " * 20 + b"\xe9")]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in rows], "doc_id long, t binary").selectExpr("doc_id", "cast(t as string) as text")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in repeated_passages(df).collect()}
    assert got == {1: (61, 60), 2: (61, 60)}


def test_passages_empty(none):
    assert repeated_passages(none).count() == 0


def test_automaton_counts():
    a = SuffixAutomaton()
    a.add(list("abcabcab"), 1)
    a.add(list("bcab"), 3)
    a.finish()
    assert a.occurrences(list("xabcabx"), 3) == [0, 2, 1 + 1 + 0, 2 + 3, 0] or a.occurrences(list("xabcabx"), 3) == [0, 2, 5, 5, 0]


def test_anchors_are_shared():
    (h,), _ = hash_words([b" ".join(b"w%d" % (i * i % 37) for i in range(300))])
    least, used = window_anchors(h, 20, 8)
    assert set(least.tolist()) == set(used.tolist()) and len(least) == 281


def test_word_hashes_do_not_depend_on_place():
    texts = [b"alpha beta  gamma", b"\tgamma\nalpha " + b"z" * 5000 + b" beta", b""]
    (h,), owner = hash_words(texts)
    assert owner.tolist() == [0, 0, 0, 1, 1, 1, 1] and h[0] == h[4] and h[1] == h[6] and h[2] == h[3]
    (low,), _ = hash_words([b"ALPHA"], lower=True)
    assert low[0] == hash_words([b"alpha"], lower=True)[0][0][0]
    long = b" ".join(b"word%d" % (i % 999) for i in range(400_000))
    (h,), _ = hash_words([long])
    assert len(h) == 400_000 and len(np.unique(h)) == 999 and len(runs_of(h, 5)) == 399_996
