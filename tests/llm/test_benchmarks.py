"""Benchmark decontamination against a plain version, with one part and with many."""

import hashlib
import random
import re

import pytest

from tessella.llm import decontamination as D
from tests.comparing import ordered, plain

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    lengths = {len(g) for g in windows}
    out = []
    for i, text in docs:
        w = words(text)
        hit, owners = set(), set()
        for k in lengths:
            for at in range(len(w) - k + 1):
                if tuple(w[at : at + k]) in windows:
                    hit |= set(range(at, at + k))
                    owners |= {str(x) for x in windows[tuple(w[at : at + k])] if x is not None}
        out.append((i, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    prose = lambda n, v=30: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    items = [(i, prose(rng.randrange(10, 60), 400)) for i in range(20)]
    items += [(100, None), (101, ""), (102, "?! --"), (103, "Short ONE"), (104, "Ünï, 7"), (None, "an item of null id has windows as well"), (3, prose(25, 300)), (5, items[5][1]), (106, items[5][1]), (9, prose(9000, 5000))]
    texts = [None, "", " .;", "short one", "SHORT, one! short-one", "ünï 7 Ünï (7)", "Ü" * 3, "an item OF null-id has windows as well, it does"]
    for i, text in items:
        w = (text or "").split()
        texts.append(f"{prose(30)} {text} {prose(20)}")
        texts.append("\n".join(w[3:14]))
        texts.append(", ".join(w[:9]) + " x " + "; ".join(w[5:]).upper())
    texts += [prose(rng.randrange(1, 40)) for _ in range(20)]
    texts += [texts[8], " ".join(texts[8:30]), f"{'long ' * 150_000}{items[9][1]} {items[0][1]}"]
    docs = list(enumerate(texts)) + [(3, "an id again: " + items[2][1]), (None, items[4][1])]
    return docs, items


def tables(spark, rows):
    docs, items = rows
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, start int").repartition(3), spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, hits string").repartition(2)


def test_marks_agree_with_a_plain_version(spark, rows, monkeypatch):
    docs, items = tables(spark, rows)
    expected = ordered(brute(*rows))
    assert sum(r[-1] for r in expected) > 40 and not all(r[-1] for r in expected)
    assert ordered(tuple(plain(r)) for r in D.report(docs, items).collect()) == expected
    monkeypatch.setattr(D, "CHUNK", 16)  # windows over cuts, and many parts
    assert ordered(tuple(plain(r)) for r in D.report(docs, items, limit=20_000).collect()) == expected


def test_equal_hashes_are_told_apart(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "window_hashes", lambda w, k: D.np.full(max(len(w) - k + 1, 0), 7, D.np.uint64))
    docs, items = rows[0][:12], rows[1][:4]
    words = D.Words(D.pa.array([t for _, t in docs], D.pa.large_string()))
    known = D.Windows([t for _, t in items], [i for i, _ in items], [4096] * len(items), 10)
    found = {(int(a), o) for k, at, number in known.hits(words) for a, w in zip(at, number, strict=True) for o in known.owners[w]}
    assert len({a for a, _ in found}) > 20 and {o for _, o in found} == {0, 1}


def test_empty_tables(spark, rows):
    docs, items = tables(spark, rows)
    assert D.report(docs.limit(0), items).count() == 0
    assert not D.report(docs, items.limit(0)).where("contaminated").count()


def test_spans_and_documents_go(spark, rows):
    docs, items = tables(spark, rows)
    hit = {(r.id, r.n_words, r.n_hit) for r in D.report(docs, items).collect()}
    clean = D.decontaminated(docs, items, whole=True)
    assert clean.columns == docs.columns and clean.count() == sum(n == 0 for *_, n in hit)
    kept = D.decontaminated(docs, items)
    assert kept.schema == docs.schema and kept.count() == docs.count()
    left = {(r.id, r.n_words) for r in D.report(kept, items.limit(0)).collect()}
    assert left == {(i, n - h) for i, n, h in hit}
    assert kept.where("doc_id = 4").first().text == "" and kept.where("doc_id = 2").first().text == " .;"


def test_names_of_marks_are_taken(spark, rows):
    docs, items = tables(spark, rows)
    clashing = docs.withColumnsRenamed({"start": "n_words", "item_id": "HITS"})
    with pytest.raises(ValueError, match="n_words"):
        D.contamination(clashing, items)
    assert D.contamination(clashing, items, prefix="my ").columns[-3:] == ["my hits", "my items", "my n_words"]
    for whole in (False, True):
        kept = D.decontaminated(clashing, items, whole)
        assert kept.columns == clashing.columns and kept.count() == D.decontaminated(docs, items, whole).count()
