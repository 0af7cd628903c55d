"""Token ids of whole texts with the tokenizers library, where each word is encoded once and remembered."""

from __future__ import annotations

import re
import sys
import types

import numpy as np

#: Words that a worker remembers, at most; bounds its memory. Of the older half those stay that are used again.
REMEMBERED = 1_600_000
#: Longer words are not remembered.
LONGEST = 64

SPACE, ASCII_SPACE = "\x09-\x0d\x20", " \t\n\r\x0b\x0c"
#: Where byte-level tokenizers split anyway: a word takes one space before it along; of longer white space
#: all but the last character is a piece, and so is that last one unless it is a space.
WITH_SPACE = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: What str.split() splits at and tokenizers do not.
CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
MARK = "\u241e"
#: What makes a text unusual when a word of it holds it: white space, special tokens, the mark below.
UNUSUAL = re.compile(r"\s|[\u180e\u200b-\u200f\u2060\ufeff]|<\||" + MARK)
#: Letters below this are lower-cased alike by all libraries, but for one that becomes two.
LATIN, DOTTED = "\u0250", "\u0130"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as ``encode(text, add_special_tokens=False)`` does.

    Tokenizers split texts before they merge, so the ids of a text are those of its pieces side by side.
    kind "words": letters are lower-cased, white space separates tokens and is dropped, so pieces are words.
    kind "spaced": byte-level, where a token may start with one space, so pieces are words with a space or a
    line end before them. Texts with unusual white space or special tokens are encoded in one go.

    A new word of Latin letters alone, or with one comma or full stop after them, goes to the merges
    directly, past the patterns that would leave it whole; all others take the tokenizer's whole way.
    """

    def __init__(self, path: str, kind: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = byte_letters()
        self.spaced, self.remembered = kind == "spaced", remembered
        # "spaced": words after a space, and after a line end with the line end itself
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # what separates words that are encoded together: no word can hold these ids in a row
        self.mark = self.numbers("\n" if self.spaced else MARK)
        self.tail = {c: self.numbers(c).tobytes() for c in ",."}

    def numbers(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def whole_way(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words, encoded in one text, each followed by the mark, and cut at the marks."""
        between = "\n" if self.spaced else f" {MARK} "
        ids = self.numbers("".join(f"{before}{w}{between}" for w in words) + ("x" if self.spaced else ""))
        n = len(self.mark)
        hit = ids[n - 1 :] == self.mark[-1]
        for j in range(n - 1):
            hit &= ids[j : len(ids) - n + 1 + j] == self.mark[j]
        raw, start, out = ids.tobytes(), 0, []
        for end in np.flatnonzero(hit).tolist():
            out.append(raw[4 * start : 4 * end])
            start = end + n
        return out

    def merged(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words of Latin letters, by the merges alone."""
        letters = self.letters
        text = f" {before}".join([w if w.isascii() else w.encode().decode("latin-1").translate(letters) for w in words])
        found = self.merges.encode(before + text, add_special_tokens=False)
        cut = np.flatnonzero(np.diff(np.array(found.word_ids, np.int64), prepend=-1)).tolist() + [len(found.ids)]
        raw = np.array(found.ids, "<u4").tobytes()
        return [raw[4 * s : 4 * e] for s, e in zip(cut[:-1], cut[1:], strict=True)]

    def learn(self, words: list[str], lead: str, before: str, letter: str, ids: bytes) -> None:
        """Adds words to ``known`` under ``lead`` and the word, with ``ids`` before theirs. In a text ``before``
        stands before each, which is ``letter`` for the merges."""
        known, tail, lower = self.known, self.tail, not self.spaced
        uses, bases, hard = [], set(), []
        for w in words:
            base, end = w, b""
            if not w.isalpha():
                base, end = w[:-1], tail.get(w[-1])
                if end is None or not base.isalpha():
                    hard.append(w)
                    continue
            if not base.isascii() and (max(base) >= LATIN or DOTTED in base):
                hard.append(w)
                continue
            if lower:
                base = base.lower()
            if lead + base not in known:
                x = self.older.get(lead + base)
                if x is None:
                    bases.add(base)
                else:
                    known[lead + base] = x
            if end or base != w:
                uses.append((w, base, end))
        for some, way, first in ((list(bases), self.merged, letter), (hard, self.whole_way, before)):
            for i in range(0, len(some), 1000):
                part = some[i : i + 1000]
                for w, x in zip(part, way(part, first), strict=True):
                    known[lead + w] = ids + x
        for w, base, end in uses:
            known[lead + w] = known[lead + base] + end

    def look_up(self, words: list[str]) -> bytes | None:
        """Ids of words side by side; None if one of them makes the text unusual. Such words are never known, so they are always seen here."""
        known = self.known
        parts = list(map(known.get, words))
        missed = [i for i, p in enumerate(parts) if p is None]
        if missed:
            new, older = set(), self.older.get
            for i in missed:
                w = words[i]
                x = older(w)
                if x is None:
                    new.add(w)
                else:
                    known[w] = parts[i] = x
            heads = [w[1:] for w in new if w[:1] == "\n"] if self.spaced else []
            others = [w for w in new if w[:1] != "\n"] if self.spaced else list(new)
            if "" in heads or "" in others or UNUSUAL.search("_".join(heads)) or UNUSUAL.search("_".join(others)):
                return None
            if others:
                self.learn(others, "", *((" ", self.letters[32]) if self.spaced else ("", "")), b"")
            if heads:
                self.learn(heads, "\n", "", "", self.mark.tobytes())
            for i in missed:
                if parts[i] is None:
                    parts[i] = known[words[i]]
            for w in new:
                if len(w) > LONGEST:
                    del known[w]
            if len(known) > self.remembered // 2:
                self.known, self.older = {}, known
        return b"".join(parts)

    def encode_one(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.spaced:
            out = None if any(c in text for c in CONTROLS) else self.look_up(text.split())
            return self.numbers(text).tobytes() if out is None else out
        out = self.look_up(f"\n{text}".replace("\n", " \n")[1:].split(" "))
        return self.uneven(text) if out is None else out[4 * len(self.mark) :]

    def uneven(self, text: str) -> bytes:
        """A spaced text with other white space than one space or line end between words: by its pieces, or
        in one go if it holds other than the seven kinds of white space or special tokens."""
        out = []
        for p in WITH_SPACE.findall(text):
            if p.strip(ASCII_SPACE) == "":
                out.append(self.numbers(p).tobytes())
                continue
            x = self.look_up([p[1:]]) if p[0] == " " else self.look_up(["\n" + p])
            if x is None:
                return self.numbers(text).tobytes()
            out.append(x if p[0] == " " else x[4 * len(self.mark) :])
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(self.encode_one, texts))


def encoder(path: str, kind: str, lasting: bool = True) -> Encoder:
    """This worker process's encoder. Workers outlive tasks but functions that travel by value do not, so
    what a worker keeps is held by a module of its own. One that is not ``lasting`` is the task's alone and
    remembers an eighth as much: for stages that are followed by others, which need the memory."""
    if not lasting:
        return Encoder(path, kind, REMEMBERED // 8)
    held = sys.modules.setdefault("tessella_worker", types.ModuleType("tessella_worker")).__dict__
    key = (path, kind)
    if key not in held:
        held[key] = Encoder(path, kind)
    return held[key]
