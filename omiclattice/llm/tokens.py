"""Ids of a public byte-level BPE tokenizer, many words at a time.

The tokenizer never joins a non-space to a following space, so a text can be
cut before every single space that stands between two non-spaces, and the ids
of the parts follow one another. Parts repeat a lot: each task keeps the ids
of parts it has met (about ``REMEMBER`` of them). New parts are put together
again, ``TOGETHER`` at a time, since a call costs as much as a word: the ids are
told apart by the space that only the first token of a part opens with. New parts
that are words with marks or a line end after them are put together from the ids of
both, where the tokenizer always parts these. When the memory is full, the parts in
use move to a new one, so that common words stay.
"""

from __future__ import annotations

import array
import json
import os
import re
from operator import add

import numpy as np

from omiclattice.llm.storage import give_back, process_cache

REMEMBER, TOGETHER = 600_000, 500
_ODD = re.compile(r"\s\s")
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Marks that the tokenizer parts from a word before them; the apostrophe opens English endings.
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{}~"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to little-endian unsigned 32-bit ids as bytes; a special string in a text is its one token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        #: Tokens that open with a space, as byte-level vocabularies write it.
        self.opens = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Ids of marks, and of words that open a line.
        self.marks: dict[str, bytes] = {"": b""}
        self.opening: dict[str, bytes] = {}
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        #: Whether words and the marks after them are always parted.
        self.parts_marks = (made["normalizer"] is None and before.get("type") == "ByteLevel" and bool(before.get("use_regex"))
                            and all("<" in t["content"] or "|" in t["content"] for t in made["added_tokens"]))
        #: The tokenizer for words of letters, each after a space.
        self.words = self.tokenizer
        if self.parts_marks:
            made["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
                {"type": "Split", "pattern": {"String": " "}, "behavior": "MergedWithNext", "invert": False}, {**before, "use_regex": False}]}
            self.words = Tokenizer.from_str(json.dumps(made))

    def _plain(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [array.array("I", e.ids).tobytes() for e in found]

    def _spaced(self, parts: list[str], letters: bool = False) -> list[bytes]:
        """Ids of parts without a space inside (of ``letters`` alone, if so), each after a space."""
        by = self.words if letters else self.tokenizer
        lots, out = [parts[i:i + TOGETHER] for i in range(0, len(parts), TOGETHER)], []
        for lot, e in zip(lots, by.encode_batch_fast(["".join([" " + x for x in lot]) for lot in lots], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            at = (4 * np.flatnonzero(self.opens[ids])).tolist()
            if len(at) == len(lot):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]
            else:  # the tokenizer has no such tokens
                out += self._plain([" " + x for x in lot])
        return out

    def _lines(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each after a line end."""
        out, line = [], array.array("I", self.tokenizer.encode("\n", add_special_tokens=False).ids)
        for i in range(0, len(words), TOGETHER):
            lot = words[i:i + TOGETHER]
            ids = np.array(self.tokenizer.encode("".join(["\n" + x for x in lot]), add_special_tokens=False).ids, "<u4")
            at = (4 * np.flatnonzero(ids == line[0])).tolist() if len(line) == 1 else []
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])] if len(at) == len(lot) else self._plain(["\n" + x for x in lot])
        return out

    def _learn(self, parts: set[str]) -> None:
        known, older, plain, new, odd = self.known, self.older, [], [], []
        ended, words, marks = [], [], []  # words with marks after them
        broken, befores, ends, lines, afters = [], [], [], [], []  # and with a line end and a word more
        for x in parts:
            if x in older:
                known[x] = older[x]
                continue
            if x.isalpha():
                plain.append(x)
                continue
            if self.parts_marks:
                w = x.rstrip(_MARKS)
                if w.isalpha():
                    ended.append(x)
                    words.append(w)
                    marks.append(x[len(w):])
                    continue
                first, end, line = w.partition("\n")
                if end and line.isalpha() and (word := first.rstrip(_MARKS)).isalpha():
                    broken.append(x)
                    befores.append(word)
                    ends.append(first[len(word):])
                    lines.append(line)
                    afters.append(x[len(w):])
                    continue
            (odd if " " in x else new).append(x)
        more = {*words, *befores}.difference(known, plain)
        known.update((w, older[w]) for w in more if w in older)
        plain += more.difference(known)
        for of, letters in ((plain, True), (new, False)):
            for i in range(0, len(of), 20_000):
                part = of[i:i + 20_000]
                known.update(zip(part, self._spaced(part, letters)))
        known.update(zip(odd, self._plain([" " + x for x in odd])))
        if len(self.marks) + len(self.opening) > REMEMBER // 4:
            self.marks, self.opening = {"": b""}, {}
        unknown = list({*marks, *ends, *afters}.difference(self.marks))
        self.marks.update(zip(unknown, self._plain(unknown)))
        unknown = list(set(lines).difference(self.opening))
        self.opening.update(zip(unknown, self._lines(unknown)))
        word, mark = known.__getitem__, self.marks.__getitem__
        known.update(zip(ended, map(add, map(word, words), map(mark, marks))))
        heads = map(add, map(word, befores), map(mark, ends))
        known.update(zip(broken, map(add, map(add, heads, map(self.opening.__getitem__, lines)), map(mark, afters))))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = []
        for t in texts:
            if _ODD.search(t):
                p = _CUT.split(t)
                cut.append((p[0], [x[1:] for x in p[1:]]))
            else:
                p = t.split(" ")
                if len(p) > 1 and not p[0]:  # the text starts with a space
                    p[:2] = [" " + p[1]]
                if len(p) > 1 and not p[-1]:  # and may end with one
                    p[-2:] = [p[-2] + " "]
                cut.append((p[0], p[1:]))
        if len(self.known) > REMEMBER:
            self.known, self.older = {}, self.known
        known = self.known
        found = [[*map(known.get, rest)] for _, rest in cut]
        gaps = [[i for i, x in enumerate(got) if x is None] if None in got else [] for got in found]
        self._learn({rest[i] for (_, rest), gap in zip(cut, gaps) for i in gap})
        for (_, rest), got, gap in zip(cut, found, gaps):
            for i in gap:
                got[i] = known[rest[i]]
        return [f + b"".join(got) for f, got in zip(self._plain([f for f, _ in cut]), found)]


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file; a reused worker keeps its words."""
    cache = process_cache("encoders")
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def runs(rows, text: str, limit: int = 1 << 20):
    """(rows, texts) for runs of rows of about ``limit`` characters; null counts as empty."""
    try:
        for batch in rows:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            at = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= limit or i + 1 == len(texts):
                    yield batch.slice(at, i + 1 - at), texts[at:i + 1]
                    at, size = i + 1, 0
    finally:
        give_back()
