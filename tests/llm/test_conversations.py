"""Tries of conversations against a plain version, at limits that split nearly every group."""

import hashlib
import random
import re
import zlib

import pytest

from tessella.llm import conversation_trie as T
from tests.comparing import ordered, plain

SCHEMA = "conv_id long, turn long, role string, text string, conv string, path string"


def brute(rows, shared=True):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, digest), role, text))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, d == len(path)))
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[p] for p in below) or 1
        saved[path] = (len(members[path]) - 1) * words + sum(saved[p] for p in below)
    out = []
    for path, ms in members.items():
        ends = ",".join(map(str, sorted(c for c, e in ms if e)))
        above = min(members[path[:-1]])[0] if path else None
        out.append((min(ms)[0], len(path), above, len(ms), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return ordered(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    say = lambda: rng.choice([None, "", "yes", "no thanks", "tell me\tmore about it", "a b c d e"])
    out = []
    for c in range(-45, 160):
        for t in range(rng.randrange(0, 7)):
            out.append((c, t, rng.choice(["user", "assistant", None]), say()))
    for c in range(200, 320):  # a hot conversation, copied
        out += [(c, t, "user" if t % 2 else "assistant", f"hot turn {t}") for t in range(6)]
    for c in range(400, 440, 2):  # a long common start, and tails of their own
        out += [(c, t, "user", f"start {t}") for t in range(30)] + [(c, 30 + t, "user", f"tail {t} {c % (t + 2)}") for t in range(c % 7)]
    out += [(500, t, "user", f"alone {t}") for t in range(700)]
    out += [(7, None, "user", "no number"), (7, None, "user", "no number"), (7, 1, "x", "the same number"), (7, 1, "x", "once more"), (None, 1, "user", "nobody"), (600, 0, "r", "x" * 2_000_000), (620, 0, "r1", "1:"), (640, 0, "r", "11:")]
    out += out[5:9]
    return [(*r, "mine", "own") for r in out]


@pytest.mark.parametrize("shared", [True, False])
def test_tries_agree_with_a_plain_version(spark, rows, monkeypatch, shared):
    monkeypatch.setattr(T, "CHUNK", 7)
    convs = T.conversations(spark.createDataFrame(rows, SCHEMA).repartition(5))
    convs = T.with_shared_starts(convs) if shared else convs
    expected = brute(rows, shared)
    for least in (500, 40):
        monkeypatch.setattr(T, "LEAST", least)
        assert ordered(tuple(plain(r)) for r in T.trie(convs).collect()) == expected


def test_chains_of_large_tries(spark, rows):
    convs = T.conversations(spark.createDataFrame(rows, SCHEMA))
    found, chains = T.dealt(T.sequences(convs).where("depth > 0"), 12)
    assert len(chains) > 1 and max(r.last - r.top for c, _ in chains for r in c.collect()) > 600
    sizes = found.groupBy(T.F.substring("path", T.F.lit(1), T.WIDTH * T.F.col("top"))).agg(T.F.sum(T.F.col("depth") - T.F.col("top") + 1).alias("n"))
    assert sizes.agg(T.F.max("n")).first()[0] <= 12


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert T.trie(T.with_shared_starts(T.conversations(none))).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x", None, None)], SCHEMA)
    assert T.trie(T.conversations(nobody)).count() == 0
