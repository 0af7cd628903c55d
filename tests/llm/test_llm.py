"""The operators against plain Python versions, on rows that are awkward on purpose and on the test data."""

import random
import re
from math import comb

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import components as CC
from tessella.llm import license_scan, mixing, packing, quality_classifier, quality_rules, samples, simhash, substring, token_store, topk, toxicity
from tessella.llm import queries as Q
from tests.comparing import duck, duck_rows, spark_rows
from tests.llm import brute

PARTS_AT_A_TIME = simhash.TOGETHER
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans int, mix string, id string, key string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    long, passage = prose(rng, 9000), prose(rng, 80)
    texts = [None, "", "  \t\n ", "one", "two words", "A b C d", long, long, long + " more", passage, f"{prose(rng, 70)} {passage} {prose(rng, 30)}", f"{passage} {passage}", passage.replace(" ", "\n"), "x " * 400]
    texts += ["É ünï çode   spaced out", "MIT License. All rights reserved", "CC BY 4.0 cc-by CC_BY", "GNU General Public License, version 3", "Licensed under the Apache License, Version 2.0 <|endoftext|> end", "line\nline\nline two\n\nline two\r\n", "##$$ %% | a <b>", "uKdeg all rights\u0000reserved"]
    base = prose(rng, 300).split()
    for i in range(12):
        w = list(base)
        w[rng.randrange(300)] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [prose(rng, rng.randrange(40, 200)) for _ in range(30)]
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S3", None, "s1"]), None, 1, "m", "i", "k") for i, t in enumerate(texts)]
    return [*out, out[6], out[9], (3, "another text of an id that is there", "en", "s1", 3, None, None, None, None), (None, passage, "en", "s2", 1, 2, "m", "i", "k")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(60)] + [(None, 1, 1), (7, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(autouse=True)
def fewer_rounds(monkeypatch):
    """Small tables need no eight rounds of shuffles; results do not depend on their number."""
    monkeypatch.setattr(simhash, "TOGETHER", 8)


def data(table="documents", sf="sf0.01"):
    return duckdb.sql(f"SELECT * FROM '/root/testdata/{sf}/{table}.parquet'").fetchall()


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_simhash(docs, rows, empty):
    expected = sorted(((i, f - (f >> 63 << 64), c) for i, f, c in brute.near_duplicates([(r[0], r[1]) for r in rows])), key=str)
    assert got(simhash.near_duplicates(docs)) == expected
    assert got(simhash.near_duplicates(empty)) == []


def test_near_copies(docs, rows, empty):
    expected = brute.near_copies([(r[0], r[1]) for r in rows], simhash.LIMIT)
    assert len(set(expected.values())) < len(expected) - 15
    for cell in (simhash.CELL, 4):  # small cells: nearly all anchors of copies count as hot
        out = simhash.near_copies(docs, cell=cell).collect()
        assert len(out) == len(rows) and all(r.component == (None if r.id is None else expected[r.id]) for r in out)
    assert got(simhash.near_copies(empty)) == []
    kept = simhash.representatives(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(expected.values()))
    assert [r.text for r in kept if r.doc_id is None] == [rows[-1][1]]
    assert kept[0].asDict().keys() == dict.fromkeys(docs.columns).keys()


def test_near_copies_with_as_many_parts_at_a_time_as_in_use(docs, rows, monkeypatch):
    assert PARTS_AT_A_TIME == 2
    monkeypatch.setattr(simhash, "TOGETHER", PARTS_AT_A_TIME)
    expected = brute.near_copies([(r[0], r[1]) for r in rows], simhash.LIMIT)
    assert all(r.component == (None if r.id is None else expected[r.id]) for r in simhash.near_copies(docs).collect())


def test_wide_fingerprints():
    rng = random.Random(4)
    texts = ["", "one", "Two WORDS", prose(rng, 5), "a b c d e a b c d e a b c d e", *(prose(rng, rng.randrange(6, 3000)) for _ in range(20))]
    together = simhash.wide_of(simhash.Text(pa.array(texts)))
    lanes = simhash.mix(np.arange(1, simhash.LANES + 1, dtype=np.uint64) * simhash.MULTIPLIER)
    for t, fp in zip(texts, together, strict=True):
        text = simhash.Text(pa.array([t.lower()]))
        h = text.word_hashes()
        k = min(5, len(h))
        shingles = [simhash.window_hashes(h[i : i + k], k)[0] for i in range(len(h) - k + 1)] if k else []
        bits = [[int(x) >> b & 1 for x in simhash.mix(s ^ lanes) for b in range(64)] for s in shingles]
        expected = [2 * sum(b) > len(bits) for b in zip(*bits)] if bits else [0] * 512
        assert [int(x) >> b & 1 for x in fp for b in range(64)] == expected


def test_near_copies_are_found(spark):
    """Of the pairs of 0.8 or more nine in ten at least end in one component; unlike texts do not."""
    d = [(r[0], r[1]) for r in data(sf="sf0.1") if len(brute.words(r[1])) >= 50]
    label = {r.id: r.component for r in simhash.near_copies(Q.documents(spark, "/root/testdata/sf0.1")).collect()}
    pairs = brute.alike(d, 0.8)
    assert len(pairs) > 30 and np.mean([label[a] == label[b] for a, b in pairs]) >= 0.9
    shingles, groups = {i: set(brute.shingles(t)) for i, t in d}, {}
    for i, _ in d:
        groups.setdefault(label[i], []).append(i)
    best = [max(len(shingles[x] & shingles[y]) / len(shingles[x] | shingles[y]) for y in m if y != x) for m in groups.values() if len(m) > 1 for x in m]
    assert np.mean(np.array(best) >= 0.6) > 0.99  # but for texts that consist of repetitions


def test_simhash_at_anchors_finds_all_links(spark):
    rng = random.Random(2)
    points = {rng.getrandbits(64) for _ in range(300)}
    for p in list(points):
        for _ in range(4):
            points.add(p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    points = np.array(sorted(points), np.uint64)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    found = {int(a): int(b) for a, b in CC.components(simhash.links(df)).collect()}
    expected = {i: c for i, _, c in _components(points)}
    assert {k: v for k, v in expected.items() if k in found} == {k: v for k, v in found.items()}
    assert all(expected[k] == k for k in expected if k not in found)


def _components(points):
    values = points.view(np.int64)
    group = {int(v): int(v) for v in values}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(points)):
        for b in np.flatnonzero(np.bitwise_count(points ^ points[a]) <= 2):
            x, y = find(int(values[a])), find(int(values[b]))
            group[max(x, y)] = min(x, y)
    return [(int(v), 0, find(int(v))) for v in values]


def test_many_fingerprints_at_an_anchor():
    rng = np.random.default_rng(1)
    fps = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 15, (3000, 5)).astype(np.uint64), axis=1))
    few = simhash.links_at_anchor(fps, 2)
    simhash.COMPARED, before = 8, simhash.COMPARED
    try:
        many = simhash.links_at_anchor(fps, 2)
    finally:
        simhash.COMPARED = before
    assert [x.tolist() for x in few] == [x.tolist() for x in many] and len(few[0])


def test_covering_radius():
    points = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    assert np.bitwise_count(points ^ simhash.decode(points)).max() <= 4
    assert (simhash.decode(simhash.decode(points)) == simhash.decode(points)).all()


def test_substring(docs, rows, empty):
    expected = brute.substring([(r[0], r[1]) for r in rows])
    assert got(substring.digest(docs)) == sorted(((i, n, g, brute.sha(k)) for i, n, g, k in expected), key=str)
    out = substring.deduped(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None and r.doc_id != 3) == sorted(((i, " ".join(k) if g else r[1]) for (i, _, g, k), r in zip(expected, rows) if i is not None and i != 3), key=str) or sorted(map(str, [(r.doc_id, r.text) for r in out.collect()])) == sorted(map(str, [(i, " ".join(k) if g else r[1]) for (i, _, g, k), r in zip(expected, rows)]))
    assert got(substring.digest(empty)) == [] == got(substring.deduped(empty))


def test_factors_rebuild_the_text(spark):
    """On documents made of pieces of others: factors are equal words of a smaller id, and those that follow each other
    at a boundary are all found."""
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(60, 900), 30) for _ in range(12)] + ["x " * 700, "x " * 400 + "y"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            w = texts[rng.randrange(len(texts))].split()
            at = rng.randrange(len(w))
            parts += w[at : at + rng.randrange(20, 300)] + prose(rng, rng.randrange(3)).split()
        texts.append(" ".join(parts))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {}
    for r in substring.factors(df, block=16).collect():
        w = brute.words(texts[r.id])[r.start : r.start + r.length]
        assert r.of < r.id and r.length >= substring.WINDOW and len(w) == r.length
        assert w == brute.words(texts[r.of])[r.of_start : r.of_start + r.length]
        found.setdefault(r.id, set()).update(range(r.start, r.start + r.length))
    for i, n, g, kept in brute.substring(rows):
        assert len(found.get(i, ())) == g
        assert [x for k, x in enumerate(brute.words(texts[i])) if k not in found.get(i, ())] == kept
    assert got(substring.digest(df)) == sorted(((i, n, g, brute.sha(k)) for i, n, g, k in brute.substring(rows)), key=str)


def test_parse_decides_on_words(monkeypatch):
    """With hashes that all clash the parse still finds just what is equal."""
    monkeypatch.setattr(substring, "window_hashes", lambda words, k: np.zeros(max(len(words) - k + 1, 0), np.uint64))
    a, b = (" ".join(f"{c}{i}" for i in range(70)) for c in "ab")
    text = substring.Text(pa.array([f"{a} {b}", b]))
    blocks = pa.array([[{"of": 1, "number": 0, "words": b}], [{"of": 2, "number": 0, "words": a}]], pa.list_(pa.struct([("of", pa.int64()), ("number", pa.int64()), ("words", pa.string())])))
    assert substring.parse(text, blocks, 50, 128) == [(0, 70, 70, 1, 0)]


def test_hashes_do_not_depend_on_blocks():
    from tessella.llm.textbytes import Text, range_hashes, window_hashes

    text = Text(pa.array(["one two three", "a" * 100 + " b", ""]))
    whole = range_hashes(text.data, text.starts, text.ends)
    assert len(set(whole.tolist())) == 5
    for limit in (1, 3, 7, 50):
        assert (range_hashes(text.data, text.starts, text.ends, limit) == whole).all()
        assert (window_hashes(whole, 2, limit) == window_hashes(whole, 2)).all()


def test_substring_on_data(spark):
    d = [(r[0], r[1]) for r in data()]
    assert got(Q.op3_substring_dedup(spark, "/root/testdata/sf0.01")) == sorted(((i, n, g, brute.sha(k)) for i, n, g, k in brute.substring(d)), key=str)


def test_license_base(docs, rows, empty):
    out = license_scan.scan(docs).select("id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got(out) == sorted(((r[0], *brute.licenses(r[1])) for r in rows), key=str)
    assert got(license_scan.scan(empty)) == []


def test_license_templates(spark):
    notices = {i: f"Some words before. {text.title()}, and after." for i, (_, text, _) in enumerate(license_scan.TEMPLATES)}
    near = {100: "permission is granted here free of charge", 101: "the mozilla fire and a public house with a license", 102: "Permission is hereby granted, at last; free of charge"}
    d = spark.createDataFrame([*notices.items(), *near.items(), *((i, "plain words of nothing much") for i in range(200, 400))], "doc_id long, text string")
    found = {r.id: (r.labels, r.score) for r in license_scan.scan(d).collect()}
    for i, (label, _, _) in enumerate(license_scan.TEMPLATES):
        assert label in found[i][0].split(",") and found[i][1] >= 0.5
    assert all(found[i] == ("", 0.0) for i in [*near, 200, 399])


def test_token_files(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    path = Q.tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    ids = {(r[0], r[1]): brute.encoded(tokenizer, r[1], 1) for r in rows}
    out = token_store.round_trip(docs, path, tasks=3).collect()
    assert sorted((str(r.id), r.n_tokens, r.ids_crc32) for r in out) == sorted((str(r[0]), len(ids[r[0], r[1]]) // 4, brute.crc(ids[r[0], r[1]])) for r in rows)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    in_order = [r.id for r in sorted(out, key=lambda r: r.start)]
    assert in_order == sorted(in_order, key=lambda i: -1 if i is None else i)
    assert token_store.round_trip(empty, path).count() == 0
    files = token_store.write(docs, f"file://{tmp_path}/t", path, tasks=2)
    reader = token_store.Reader(files.orderBy("path").first().path)
    wanted = [int(i) for i in reader.table["id"][[0, -1]]]
    assert [i for i, _ in reader.find(wanted)] and all(x for _, x in reader.find(wanted))
    raw = next((tmp_path / "t").glob("*.tsk"))
    broken = bytearray(raw.read_bytes())
    broken[10] ^= 1
    raw.write_bytes(broken)
    with pytest.raises(Exception):
        token_store.Reader(f"file://{raw}").ids(0)


def test_token_files_roll_over(spark, docs, rows, monkeypatch):
    path = Q.tokenizer_path("word_bpe_49k.json")
    plain = sorted(map(str, token_store.round_trip(docs, path, tasks=2, with_ids=True).collect()))
    monkeypatch.setattr(token_store, "FILE_DOCS", 5)
    monkeypatch.setattr(token_store, "FILE_BYTES", 3000)
    files = token_store.write(docs, token_store.new_folder(spark, "rolled"), path, tasks=2)
    assert files.count() >= len(rows) // 5 and files.agg(F.max("n_docs")).first()[0] == 5
    assert sorted(map(str, token_store.read(spark, files).collect())) == plain


@pytest.mark.parametrize("query,name,end", [(Q.op4_token_store, "word_bpe_49k.json", 1), (Q.op6_cost_balanced_packing, "byte_bpe_50k.json", 0)])
def test_tokens_of_the_whole_table(spark, query, name, end):
    """Every id of every whole text is what the library alone makes of it."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path(name))
    ids = {r[0]: brute.encoded(tokenizer, r[1], end) for r in data()}
    seen = {i: 0 for i in ids}
    for r in query(spark, "/root/testdata/sf0.01").collect():
        at, n = (0, r.n_tokens) if "n_tokens" in r else (r.start, r.length)
        assert brute.crc(ids[r.doc_id][4 * at : 4 * (at + n)]) == r.ids_crc32
        seen[r.doc_id] += n
    assert {i: len(x) // 4 for i, x in ids.items()} == seen


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced")])
def test_encoder_is_exact(name, kind):
    from tessella.llm.encoding import Encoder
    from tokenizers import Tokenizer

    rng = random.Random(3)
    letters = "ab'ÉéΣΣσ12  \n\n\t .,!<|endoftext|> 　中文’ stL'll 'rẽ" + "́ \x1c"
    some = ["the", "don't", "I'll", "x1", "...", "(a)", "straße,", "ÉCOLE.", "İx", "ǅa", "ﬁn,", "a,b", "foo,", "Foo.", "\nfoo", "x\ny"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [" ".join(rng.choice(some) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    texts += [r[1] for r in data()[:200]]
    path = Q.tokenizer_path(name)
    plain = Tokenizer.from_file(path)
    mine = Encoder(path, kind)
    for t in texts:
        assert mine.encode_one(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = Q.tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    out = packing.pack(docs, path, capacity=64, with_ids=True).collect()
    at = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0) and r.length > 0 and brute.crc(r.ids) == r.ids_crc32
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 64
    whole = {}
    for r in rows:
        whole.setdefault(str(r[0]), []).append(brute.encoded(tokenizer, r[1], 0))
    for i, texts in whole.items():
        if len(texts) == 1:
            assert b"".join(r.ids for r in sorted((r for r in out if str(r.id) == i), key=lambda r: r.start)) == texts[0]
    total = sum(len(x) // 4 for t in whole.values() for x in t)
    assert sum(at.values()) == total and len(at) * 64 - total < 64 * 4
    assert packing.pack(empty, path).count() == 0


def test_packing_balances_cost():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 1024) for _ in range(2000)]
    placed = packing.assign(lengths, 1024)
    sequences = {}
    for item, start, n, to, at in placed:
        sequences.setdefault(to, []).append((at, n))
    assert len(sequences) == -(-sum(lengths) // 1024)
    cost = [sum(n + n * n / 1024 for _, n in s) for s in sequences.values()]
    assert sum(n for s in sequences.values() for _, n in s) == sum(lengths)
    assert np.std(cost) / np.mean(cost) < 0.2


def test_packing_balances_cost_of_all_sequences(spark):
    """Long documents take part: over all sequences of sf0.1 cost spreads little, and little is padded."""
    cost, used = {}, {}
    for r in Q.op6_cost_balanced_packing(spark, "/root/testdata/sf0.1").select("sequence_id", "length").collect():
        cost[r.sequence_id] = cost.get(r.sequence_id, 0) + packing.LINEAR * r.length + packing.QUADRATIC * r.length**2
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    values = np.array([c for s, c in cost.items() if used[s] > 1000])
    assert len(values) > 0.99 * len(cost) and np.std(values) / np.mean(values) < 0.06 and np.max(values) < 1.2 * np.mean(values)
    assert sum(used.values()) > 0.998 * 1024 * len(used)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    vectors = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    vectors += [(400, None), (450, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, []), (None, [1.0] * 8), (7, vectors[7][1]), (50, vectors[3][1]), (700, [1e7] * 8), (701, vectors[1][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, id string")
    out = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, shard=64, tile=4).collect():
        out.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asks = {}
    for i, v in good:
        if i % 50 == 0:
            asks[i] = min(asks.get(i, v), v)
    assert out.keys() == asks.keys()
    for q, v in asks.items():
        best = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in good if i != q)[:5]
        assert out[q] == {n + 1: (i, -s) for n, (s, i) in enumerate(best)}
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_huge_vectors(spark):
    vectors = [(i, [1e300 * (-1) ** i, 1.0 + i]) for i in range(60)] + [(60, [1e308, 0.0]), (100, [3e15, 0.5]), (101, [2.0, 0.25]), (150, [0.0, 1e17])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    out = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, shard=16, tile=2).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    good = [(i, [int(256 * x) for x in v]) for i, v in vectors if i != 60]  # 256e308 is infinite
    clip = lambda x: max(-topk.HIGHEST, min(topk.HIGHEST, x))
    assert out.keys() == {0, 50, 100, 150}
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-clip(sum(a * b for a, b in zip(v, c))), i) for i, c in good if i != q)[:5]
            assert sorted(out[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_quality_figures(docs, rows, empty, labels):
    out = quality_rules.judge(docs, labels)
    assert got(out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(((r[0], *brute.figures(r[1])) for r in rows), key=str)
    assert got(out.where("base_failed and kept")) == []
    assert quality_rules.judge(empty, labels).count() == 0
    kept = quality_rules.keep(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.id) for r in out.where("kept").collect())
    assert quality_rules.judge(docs, labels.where("false")).where("kept").count() == sum(not brute.figures(r[1])[5] for r in rows)


def test_binomial_bounds():
    for k, n, p in ((0, 100, 0.05), (3, 50, 0.1), (20, 20, 0.3), (5, 400, 0.02)):
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(quality_rules.binomial_tail(k, n, p) - exact) < 1e-12
    huge = quality_rules.binomial_tail(2_990_000, 100_000_000, 0.03)  # about 5.9 deviations below the mean
    assert 1e-10 < huge < 1e-8 and quality_rules.binomial_tail(3_000_000, 100_000_000, 0.03) > 0.5
    assert quality_rules.testable([300, 200, 20], 0.02, 0.05) == (200, 0.025) and quality_rules.testable([20, 0], 0.02, 0.05) == (0, 0.0)


def figure_rows(d):
    """(id, stratum, shares in the order of RULES, base_failed) of (id, text, stratum), by plain Python."""
    out = []
    for i, t, lang in d:
        n, chars, symbols, dup, again, failed = brute.figures(t)
        lines = sum(bool(brute.words(x)) for x in (t or "").split("\n"))
        upper = sum("A" <= c <= "Z" for c in t or "")
        out.append((i, lang, (symbols / max(n, 1), upper / max(chars, 1), dup / max(lines, 1), again / max(n, 1), chars / max(n, 1)), failed))
    return out


def plain_rules(spark, rows, marks, risk=quality_rules.RISK, error=quality_rules.ERROR):
    """{stratum: {rule: cutoff}} row by row: the definition of ``quality_rules.learn``."""
    design = {r.id for r in spark.createDataFrame([(i,) for i in marks], "id long").where(F.pmod(F.xxhash64("id", F.lit(8)), F.lit(quality_rules.DESIGN)) == 0).collect()}
    grids = list(quality_rules.RULES.values())
    strata = {}
    for i, lang, values, failed in rows:
        if i in marks and not failed:
            strata.setdefault(lang, []).append((values, marks[i], i in design))
    hold = {s: [v for v, y, d in m if y and not d] for s, m in strata.items()}
    tested = 0
    for n in sorted(map(len, hold.values()), reverse=True):
        if (1 - risk) ** n > error / (tested + 1):
            break
        tested += 1
    out = {}
    for s in sorted(hold, key=lambda s: -len(hold[s]))[:tested]:
        rejects = lambda setting, v: any(k < len(g) and x > g[k] for k, g, x in zip(setting, grids, v))
        bad, planned = [v for v, y, _ in strata[s] if not y], [v for v, y, d in strata[s] if y and d]
        setting, chosen = tuple(map(len, grids)), None
        while True:
            steps = []
            for r in range(len(grids)):
                for c in range(setting[r]):
                    new = (*setting[:r], c, *setting[r + 1 :])
                    gain = sum(rejects(new, v) and not rejects(setting, v) for v in bad)
                    if gain and sum(rejects(new, v) for v in planned) <= risk * len(planned):
                        steps.append((sum(rejects(new, v) and not rejects(setting, v) for v in planned), -gain, r, -c, new))
            if not steps:
                break
            setting = min(steps)[-1]
            n, k = len(hold[s]), sum(rejects(setting, v) for v in hold[s])
            if sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) > error / tested:
                break
            chosen = setting
        if chosen:
            out[s] = {rule: g[c] for (rule, g), c in zip(quality_rules.RULES.items(), chosen) if c < len(g)}
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_learned_rules_on_data(spark, sf):
    """Cutoffs and verdicts equal the plain definition; they are admitted where labels suffice; false rejections of
    good documents stay within the risk, and bad documents go."""
    d = [(r[0], r[1], r[2]) for r in data(sf=sf)]
    marks = {r[0]: r[1] for r in data("labels", sf)}
    rows = figure_rows(d)
    expected = plain_rules(spark, rows, marks)
    path = f"/root/testdata/{sf}"
    assert quality_rules.learn(quality_rules.figures(Q.documents(spark, path)), Q.labels(spark, path)) == expected
    assert "en" in expected and (sf == "sf0.01" or set(expected) == {"en", "de", "fr", "es"})
    kept = {r.doc_id: r.kept for r in Q.op8_quality_rules(spark, path).collect()}
    names, rejected = list(quality_rules.RULES), {}
    for i, lang, values, failed in rows:
        learned = any(values[names.index(k)] > c for k, c in expected.get(lang, {}).items())
        assert kept[i] == (not failed and not learned)
        if i in marks and not failed and lang in expected:
            rejected.setdefault((lang, marks[i]), []).append(learned)
    for lang in expected:
        assert np.mean(rejected[lang, 1]) <= quality_rules.RISK and np.mean(rejected[lang, 0]) > 0.5, (lang, np.mean(rejected[lang, 0]))


def test_rules_reject_junk_and_spare_good(spark):
    rng = random.Random(9)
    good = [(i, prose(rng, 100), "en") for i in range(600)]
    bad = [(i, " ".join(f"{w}{'#$%'[i % 3] * 3}" for w in prose(rng, 100).split()), "en") for i in range(600, 700)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, int(i < 600)) for i in range(700)], "doc_id long, quality int")
    kept = {r.id for r in quality_rules.judge(d, marks).where("kept").collect()}
    assert kept == set(range(600))


def test_rules_hold_for_their_own_language_only(spark):
    rng = random.Random(11)
    plain = lambda i: (i, prose(rng, 100))
    junk = lambda i: (i, " ".join(f"{w}###" for w in prose(rng, 100).split()))
    rows, marks = [], []
    for lang in (None, "en"):
        for n in range(900):
            rows.append(((plain if n < 800 else junk)(len(rows)), lang, int(n < 800)))
    for k in range(70):  # more languages than had a stratum before; their documents are good and full of symbols
        rows += [(junk(len(rows)), f"l{k:02}", 1)]
    marks = [(i, y) for (i, _), _, y in rows]
    unlabelled = [(junk(len(rows) + n), "xx", None) for n in range(20)]
    d = spark.createDataFrame([(i, t, lang) for (i, t), lang, _ in rows + unlabelled], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    good = {i for (i, _), lang, y in rows + unlabelled if y != 0}
    assert {r.id for r in quality_rules.judge(d, labels).where("kept").collect()} == good
    assert {r.doc_id for r in quality_rules.keep(d, labels).collect()} == good


def test_mixing(docs, rows, empty):
    took = lambda d: mixing.mix(d, as_col="took").select("doc_id", "text", "source", "took.*")
    out = took(docs).collect()
    with pytest.raises(ValueError):
        mixing.mix(docs)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    expected = brute.targets(sizes)
    assert len(out) == len(rows)
    for r in out:
        assert r["size"] == len(brute.words(r.text)) and r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        assert abs(r.target - expected[r.source]) < 1e-6
    assert sorted(map(str, out)) == sorted(map(str, took(docs.repartition(5)).collect()))
    many = mixing.mixed(docs)
    assert many.columns == docs.columns and {r.mix for r in many.collect()} == {"m", None} and many.count() == sum(r.copies for r in out)
    assert took(empty).count() == 0 == mixing.mixed(empty).count()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_mixing_targets_on_data(spark, sf):
    taken = Q.op9_source_mixing(spark, f"/root/testdata/{sf}").join(Q.documents(spark, f"/root/testdata/{sf}").select("doc_id", "source"), "doc_id")
    for r in taken.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken / r.target - 1) < (0.05 if sf == "sf0.01" else 0.02), r


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, name):
    names, rows = spark_rows(Q.QUERIES[name](spark, "/root/testdata/sf0.01"))
    assert (names, rows) == duck_rows(duck("/root/testdata/sf0.01"), Q.ORACLES[name])


def area(scores, marks):
    s, y = np.array(scores), np.array(marks)
    return np.mean(s[y == 1][:, None] > s[y == 0][None]) + 0.5 * np.mean(s[y == 1][:, None] == s[y == 0][None])


@pytest.mark.parametrize("query,column", [(Q.op1_quality_classifier, 1), (Q.op10_toxicity, 2)])
def test_held_out_accuracy(spark, query, column):
    marks = {r[0]: r[column] for r in data("labels", "sf0.1")}
    out = [r for r in query(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in marks]
    y = [marks[r.doc_id] for r in out]
    assert area([r.score for r in out], y) > 0.97
    assert np.mean([r.predicted == m for r, m in zip(out, y)]) > 0.95


def bucket_of(raw, memo={}):
    """Hash of bytes, by the definition that textbytes' vectorised forms follow."""
    if raw not in memo:
        h = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, b in enumerate(raw)) % (1 << 64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * factor % (1 << 64)
        memo[raw] = h ^ h >> 31
    return memo[raw]


def test_quality_scores_by_a_plain_pass(spark):
    rng = np.random.default_rng(5)
    value, bias = rng.normal(0, 3, quality_classifier.BUCKETS + quality_classifier.REPEATS).astype(np.float32), 0.25
    found = {r.id: r.score for r in quality_classifier.score(Q.documents(spark, "/root/testdata/sf0.01"), (value, bias)).collect()}
    blank = set(" \t\n\x0b\x0c\r")
    for i, text, *_ in data():
        words, used = brute.words(text), []
        used += [bucket_of(w.encode()) % quality_classifier.BUCKETS for w in words]
        used += [quality_classifier.BUCKETS + lag - 1 for lag in (1, 2) for k in range(lag, len(words)) if words[k] == words[k - lag]]
        t = (text or "") + "\n"
        for n in quality_classifier.NGRAMS:
            used += [bucket_of(t[k : k + n].encode()) % quality_classifier.BUCKETS for k in range(len(t) - n + 1) if not blank & set(t[k + 1 : k + n - 1])]
        mean = sum(float(value[b]) for b in used) / max(len(used), 1)
        assert abs(found[i] - 1 / (1 + np.exp(-(mean + bias)))) < 1e-6


def test_toxicity_scores_by_a_plain_pass(spark):
    rng = np.random.default_rng(6)
    row = rng.integers(0, 300, toxicity.BUCKETS).astype(np.int32)
    network = toxicity.Network(row, rng)
    network.vectors[1:] = rng.normal(0, 1, network.vectors[1:].shape)
    found = {r.id: r.score for r in toxicity.score(Q.documents(spark, "/root/testdata/sf0.01"), network.tables()).collect()}
    mask = (1 << 64) - 1
    for i, text, *_ in data():
        words = [w.encode() for w in re.findall("[0-9a-z\x80-\U0010ffff]+", brute.lower(text))]
        x = [network.vectors[row[bucket_of(w) % toxicity.BUCKETS]] + network.vectors[row[(bucket_of(w[: toxicity.STEM]) ^ mask) % toxicity.BUCKETS]] for w in words]
        x = np.array(x + [np.zeros(toxicity.DIMENSIONS)] * max(toxicity.WIDTHS))
        tops = [np.max(sum(x[j : len(x) - len(k) + 1 + j] @ k[j] for j in range(len(k))), axis=0) for k in network.kernels]
        z = np.maximum(np.concatenate(tops), 0) @ network.out + network.bias
        assert abs(found[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-5


def test_held_out_labels_play_no_part(spark):
    """Models, and thresholds, stay the same when all held-out labels are turned."""
    sf = "/root/testdata/sf0.01"
    docs, marks = Q.documents(spark, sf), Q.labels(spark, sf)
    for module, column in ((quality_classifier, "quality"), (toxicity, "toxic")):
        held = module.held_out(F.col("doc_id"), module.MODULUS, module.HELD)
        turned = marks.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)))
        assert turned.exceptAll(marks).count() > 50
        assert got(module.classify(docs, marks)) == got(module.classify(docs, turned))


def test_samples_are_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 100, "en") for i in range(50)] + [(50, "y" * 2000, "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(51)], "doc_id long, quality int")
    rows = samples.labelled_sample(docs, marks, "quality", 4, 2, 1000, 1000).collect()
    for label in (0, 1):
        assert 0 < sum(len(r.text) for r in rows if r.label == label) <= 1000


@pytest.mark.parametrize("place", ["first", "third", "last"])
def test_a_long_text_is_skipped_wherever_it_comes(spark, place):
    ids = [r.doc_id for r in spark.range(60).withColumnRenamed("id", "doc_id").where(~samples.held_out(F.col("doc_id"), 4, 2)).orderBy(F.xxhash64("doc_id", F.lit(7))).collect()]
    long = {"first": ids[0], "third": ids[2], "last": ids[-1]}[place]
    row = lambda i: (i, "y" * 5000 if i == long else f"w{i} " * 20)
    marks = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    take = lambda rows: {r.id for r in samples.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), marks, "quality", 4, 2, 1000, 1000).collect()}
    kept = take([row(i) for i in ids])
    assert len(kept) >= 10 and kept == take([row(i) for i in ids if i != long])


def test_very_long_texts_take_little_memory():
    """A text of 12 MB gives what its parts give together, in numpy memory of a few bytes a byte of text."""
    import tracemalloc

    from tessella.llm.textbytes import Text

    part = prose(random.Random(1), 180_000, 50_000)
    text = " ".join([part] * 10)
    whole, one = pa.array([text]), pa.array([part])
    value = np.random.default_rng(0).normal(0, 1, quality_classifier.BUCKETS + quality_classifier.REPEATS).astype(np.float32)
    network = toxicity.Network((np.arange(toxicity.BUCKETS) % 90).astype(np.int32), np.random.default_rng(1)).tables()
    checks = [
        (lambda a: quality_classifier.scores(a, value, 0.0), lambda x, y: abs(x[0] - y[0]) < 1e-3),
        (lambda a: toxicity.scores(a, network), lambda x, y: abs(x[0] - y[0]) < 1e-3),
        (lambda a: simhash.wide_of(Text(a)), lambda x, y: np.bitwise_count(x ^ y).sum() < 5),
        (lambda a: quality_rules.figures_of(Text(a)), lambda x, y: x["n_words"][0] == 10 * y["n_words"][0] == x["n_repeat_words"][0]),
        (lambda a: substring.blocks_of(Text(a), 50, 8), lambda x, y: x[2].sum() == 10 * y[2].sum() + 9 * 49),
    ]
    for run, same in checks:
        tracemalloc.start()
        long = run(whole)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert same(long, run(one)) and peak < 22 * len(text), (peak / len(text), run)


def test_classifiers_on_awkward_rows(docs, rows, empty, labels):
    for classify in (quality_classifier.classify, toxicity.classify):
        out = classify(docs, labels).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
        assert classify(empty, labels).count() == 0
        assert {r.score for r in classify(docs, labels.where("false")).collect()} == {0.5}


def test_toxicity_scores_a_text_by_itself(spark):
    rng = np.random.default_rng(3)
    row = (np.arange(toxicity.BUCKETS) % 50).astype(np.int32)
    network = toxicity.Network(row, rng)
    network.vectors[1:] = rng.normal(0, 1, network.vectors[1:].shape)
    tables = network.tables()
    texts = ["", None, *(prose(random.Random(i), i % 4 + 1) for i in range(40))]
    d = [(i, t, "en") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string"
    beside = {r.id: r.score for r in toxicity.score(spark.createDataFrame(d, schema).coalesce(1), tables).collect()}
    turned = {r.id: r.score for r in toxicity.score(spark.createDataFrame(d[::-1], schema).coalesce(1), tables).collect()}
    for i, t in enumerate(texts):
        buckets = toxicity.word_buckets(pa.array([t or ""]))[1]
        top = np.maximum(network.pool(toxicity.padded(row, buckets))[0], 0)
        alone = 1 / (1 + np.exp(-(top @ network.out + network.bias)))
        assert abs(beside[i] - alone) < 1e-6 and abs(turned[i] - alone) < 1e-6


def test_toxicity_thresholds_count_all_labelled_rows(spark):
    # (language, score, label, trained on, rows): most rows lie outside of any bounded sample
    kinds = [("en", 0.30, 1, False, 50), ("en", 0.70, 0, False, 3000), ("en", 0.90, 1, False, 3000), ("en", 0.10, 0, True, 40), ("de", 0.20, 0, False, 100), ("de", 0.40, 1, True, 90), ("de", 0.40, 1, False, 10), (None, 0.6, 1, False, 5)]
    scores, marks = [], []
    for lang, score, label, trained, n in kinds:
        for _ in range(n):
            scores.append((len(scores), lang, score))
            marks.append((len(marks), label, trained))
    held = {r.id for r in spark.createDataFrame([(i,) for i in range(len(scores))], "id long").where(toxicity.held_out(F.col("id"), toxicity.MODULUS, toxicity.HELD)).collect()}
    trained = [i for i, _, t in marks if t and i not in held]
    out = toxicity.thresholds(spark.createDataFrame(scores, "id long, lang string, score double"), spark.createDataFrame([m[:2] for m in marks], "doc_id long, toxic int"), trained)
    expected = {}
    for lang in ("en", "de"):
        mine = [(s, marks[i][1], marks[i][2]) for i, l, s in scores if l == lang and i not in held]
        fresh = [(s, y) for s, y, t in mine if not t]
        weight = {y: sum(b == y for _, b, _ in mine) / sum(b == y for _, b in fresh) for y in (0, 1)}
        f1 = {}
        for cut in range(toxicity.STEPS + 1):
            over = [sum(weight[y] for s, y in fresh if y == label and s >= cut / toxicity.STEPS) for label in (0, 1)] if cut % 64 == 0 else None
            if over:
                f1[cut / toxicity.STEPS] = round(2 * over[1] / (sum(over) + sum(b == 1 for _, b, _ in mine)), 12)
        expected[lang] = max(f1.values()), f1
    found = {r.language: r.own for r in out.collect()}
    assert found.keys() == {"en", "de", ""} and found[""] == toxicity.THRESHOLD
    assert 0.7 < found["en"] <= 0.9 and 0.2 < found["de"] <= 0.4
    for lang, (best, f1) in expected.items():
        assert max(v for c, v in f1.items() if abs(c - found[lang]) <= 1 / 64) == best


def test_pipeline(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"
    docs = Q.documents(spark, sf)
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, sf).cache()
        assert docs.columns == names
        old = {r.doc_id: r for r in before.collect()}
        new = docs.collect()
        if name == "quality_rules":
            rows = figure_rows([(i, r.text, r.lang) for i, r in old.items()])
            rules, names_of = plain_rules(spark, rows, {r[0]: r[1] for r in data("labels")}), list(quality_rules.RULES)
            good = {i for i, lang, v, failed in rows if not failed and not any(v[names_of.index(k)] > c for k, c in rules.get(lang, {}).items())}
            assert rules and {r.doc_id for r in new} == good
        elif name == "near_duplicates":
            assert {r.doc_id for r in new} == set(brute.near_copies([(i, r.text) for i, r in old.items()], simhash.LIMIT).values())
        elif name == "substring_dedup":
            kept = {i: " ".join(k) if g else old[i].text for i, _, g, k in brute.substring([(i, r.text) for i, r in old.items()])}
            assert {r.doc_id: r.text for r in new} == kept and all(r.n_chars == len(r.text) for r in new)
        else:
            copies = {}
            for r in new:
                assert r.text == old[r.doc_id].text
                copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
            assert max(copies.values()) <= 2
    tokenizer = Tokenizer.from_file(Q.tokenizer_path("byte_bpe_50k.json"))
    ids = {r.doc_id: brute.encoded(tokenizer, r.text, 0) for r in docs.collect()}
    seen, at = {}, {}
    for r in sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: (r.sequence_id, r.offset)):
        assert brute.crc(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
        for i in range(r.start, r.start + r.length):
            seen.setdefault(r.doc_id, [0] * (len(ids[r.doc_id]) // 4))[i] += 1
    assert {i: set(n) for i, n in seen.items()} == {i: {n} for i, n in copies.items()} and max(at.values()) <= 1024


def test_stages_on_awkward_rows(spark, docs, rows, empty):
    """Nulls, repeated rows, clashing columns and empty tables: every stage keeps the columns, and packing every id."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, sf), stage(spark, empty, sf)
        assert none.count() == 0
        if name == "packing":
            assert {str(r.doc_id) for r in out.select("doc_id").distinct().collect()} == {str(r[0]) for r in rows}
        else:
            assert out.columns == docs.columns == none.columns and 0 < out.count() <= 2 * len(rows)
            assert {r.mix for r in out.collect()} <= {"m", None}
