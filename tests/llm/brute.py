"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return SPACE_WORD.findall(text or "")


def fingerprint(text):
    import xxhash

    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows):
    """{(id, text): (fingerprint, component)}"""
    fps = [(i, fingerprint(t)) for i, t in rows if i is not None]
    group = {i: i for i, _ in fps}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    values = np.array([f for _, f in fps], np.uint64)
    for a in range(len(fps)):
        for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 2):
            x, y = find(fps[a][0]), find(fps[b][0])
            group[max(x, y)] = min(x, y)
    return [(i, f, find(i)) for i, f in fps] + [(None, fingerprint(t), None) for i, t in rows if i is None]


def near_copies(rows, limit):
    """{id: smallest id reached} by comparing all pairs of 512-bit fingerprints."""
    import pyarrow as pa

    from tessella.llm.simhash import wide_of
    from tessella.llm.textbytes import Text

    rows = [(i, t) for i, t in rows if i is not None]
    fps = np.concatenate([wide_of(Text(pa.array([t], pa.string()))) for _, t in rows])
    group = {i: i for i, _ in rows}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(rows)):
        for b in np.flatnonzero(np.bitwise_count(fps[a + 1 :] ^ fps[a]).sum(1) <= limit) + a + 1:
            x, y = find(rows[a][0]), find(rows[b][0])
            group[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def shingles(text, k=5):
    w = words(lower(text))
    return list(zip(*(w[j:] for j in range(k))))


def alike(rows, least, common=60):
    """Pairs of ids of different texts whose sets of 5-word shingles have a Jaccard of ``least`` or more; candidates
    share a shingle that at most ``common`` different texts hold."""
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(shingles(t)), i)
    sets = [(s, i) for s, i in sets.items() if s]
    holders, shared = {}, Counter()
    for n, (s, _) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(n)
    for h in holders.values():
        if len(h) <= common:
            shared.update((a, b) for k, b in enumerate(h) for a in h[:k])
    out = []
    for (a, b), n in shared.items():
        if n >= 0.1 * min(len(sets[a][0]), len(sets[b][0])):
            both = len(sets[a][0] & sets[b][0])
            if both >= least * (len(sets[a][0]) + len(sets[b][0]) - both):
                out.append((sets[a][1], sets[b][1]))
    return out


def substring(rows, window=50):
    """(id, n_words, n_removed, kept words) of each row."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), [x for x, g in zip(w, gone) if not g]))
    return out


def sha(kept):
    return hashlib.sha256(" ".join(kept).encode()).hexdigest()


def licenses(text):
    w = LICENSE_WORD.findall(lower(text))
    hits = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split()
        hits += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def figures(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    threes = Counter(zip(w, w[1:], w[2:]))
    again = {i + j for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again), failed


def targets(sizes):
    """{source: target} by sharing anew until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        free -= over
    return out


def encoded(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4").tobytes()


def crc(ids):
    return zlib.crc32(ids)
