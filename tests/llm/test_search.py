"""Ranked search against a plain version, over many small clusters, groups and blocks."""

import math
import random
import re

import numpy as np
import pytest

from tessella.llm import lexical_search as L
from tests.comparing import ordered, plain

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    docs = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    counts = [{w: t.count(w) for w in set(t)} if len(t) < 5000 else {w: sum(x == w for x in t) for w in set(t)} for _, t in docs]
    df = {}
    for c in counts:
        for w in c:
            df[w] = df.get(w, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        found = []
        for (i, t), c in zip(docs, counts, strict=True):
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * (50 + (50 * len(t) * n_docs) // n_terms))) for w in own if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return ordered(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    topics = [[f"t{t}w{i}" for i in range(60)] for t in range(6)]
    say = lambda t, n: " ".join(rng.choice(topics[t] if rng.random() < 0.8 else topics[rng.randrange(6)]) for _ in range(n))
    texts = [None, "", "?! --", "one", "ONE one", "Ünï 7", "ünï", f"{'pad ' * 60_000}needle {say(1, 40)}"]
    texts += [say(i % 6, rng.randrange(5, 80)) for i in range(300)]
    texts += [texts[20]] * 70 + [say(2, 30) + " needle"] * 3
    docs = list(enumerate(texts)) + [(9, "an id again needle"), (None, "no id needle"), (None, texts[20])]
    items = [(i, say(i % 6, 20)) for i in range(12)] + [(20, texts[20]), (21, "NEEDLE"), (22, None), (23, "unknownword"), (24, "one"), (None, "needle"), (0, "needle again"), (25, "ünï ünï ünï"), (26, "ÜnÏ")]
    return docs, items


def tables(spark, rows):
    docs, items = rows
    return spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, `group` int, terms string").repartition(4), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, query int")


@pytest.mark.parametrize("small", [False, True])
def test_ranks_agree_with_a_plain_version(spark, rows, monkeypatch, small):
    if small:
        for name, value in (("SAMPLE", 100), ("LEAF", 20), ("GROUP", 30), ("CLUSTER", 8), ("BLOCK", 5)):
            monkeypatch.setattr(L, name, value)
    docs, items = tables(spark, rows)
    index = L.build(docs)
    kept = [(r.cluster, i) for r in index.clusters.collect() for i in r.ids]
    assert len(kept) == index.n_docs == sum(bool(terms(t)) for _, t in rows[0])
    assert not small or max(np.bincount(np.unique([c for c, _ in kept], return_inverse=True)[1])) <= 8
    for k in (3, 50):
        assert ordered(tuple(plain(r)) for r in L.search(index, items, k).collect()) == brute(*rows, k)


def test_whole_numbers_beyond_doubles(spark, rows, monkeypatch):
    floor = math.floor
    monkeypatch.setattr(math, "floor", lambda x: floor(x * 10**6))  # weights whose sums doubles could not hold
    docs, items = tables(spark, rows)
    got = ordered(tuple(plain(r)) for r in L.search(L.build(docs), items).collect())
    assert got == brute(*rows, 50) and max(r[3] for r in got) > 2**53


def test_most_clusters_are_left_out(spark, rows, monkeypatch):
    for name, value in (("SAMPLE", 400), ("LEAF", 20), ("GROUP", 60), ("CLUSTER", 8)):
        monkeypatch.setattr(L, name, value)
    docs, items = tables(spark, rows)
    queries = L.queries_of(items.where("item_id < 12 or item_id = 21"), "item_id", "text").collect()
    found, seen = L.searched(L.build(docs), queries, 1)
    assert found.count() >= 12 and 0 < seen["visited"] < 0.6 * seen["pairs"]


def test_bisection_brings_alike_documents_together():
    rng = np.random.default_rng(0)
    topic = rng.permutation(np.repeat(np.arange(4), 64))
    doc = np.repeat(np.arange(256), 12)
    pair = np.unique(doc * 1000 + topic[doc] * 200 + rng.integers(0, 200, len(doc)))
    part, levels = L.bisected(pair // 1000, pair % 1000, 256, 64, 20)
    assert len(levels) == 2 and (np.bincount(part) == 64).all()
    assert sum(np.bincount(topic[part == p]).max() for p in range(4)) > 0.9 * 256


def test_empty_tables(spark, rows):
    docs, items = tables(spark, rows)
    assert L.search(L.build(docs.limit(0)), items).count() == 0
    assert L.search(L.build(docs.where("doc_id < 3")), items).count() == 0
    index = L.build(docs)
    assert L.search(index, items.limit(0)).count() == 0 and L.search(index, items.where("item_id = 23")).count() == 0
