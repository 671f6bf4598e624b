"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. Where no longer match exists, the
link leads to the node of what is left after the pieces matched so far, and the
number of pieces popped on the way is stored with it. A word takes one
step a byte plus the links it follows, at most twice its length, and no piece
is ever built. A task remembers the counts of words it has met.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from omiclattice.llm.storage import picked, process_cache
from omiclattice.llm.tokens import runs, tokenizer_path

#: Words remembered in a task, none longer than ``SHORT`` bytes.
REMEMBER, SHORT = 400_000, 64


def byte_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file as bytes; a piece that starts a word starts with a space."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return [bytes(letter[c] for c in piece) for piece in vocabulary if all(c in letter for c in piece)]


class Automaton:
    """Greedy longest-match piece counts; words get ``mark`` in front, so that pieces with it match at the start only."""

    def __init__(self, pieces: list[bytes], mark: bytes = b" "):
        self.mark, go, ends, kids = mark, {}, {0: False}, {0: []}
        for p in pieces:
            at = 0
            for c in p:
                key = at << 8 | c
                if key not in go:
                    go[key] = len(ends)
                    kids[at].append((c, go[key]))
                    ends[go[key]], kids[go[key]] = False, []
                at = go[key]
            ends[at] = bool(p)
        fail, popped, queue = {0: -1}, {0: 0}, [0]
        for u in queue:
            for c, v in kids[u]:
                queue.append(v)
                if ends[v]:
                    fail[v], popped[v] = 0, 1
                    continue
                z, n = fail[u], popped[u]
                while z >= 0 and z << 8 | c not in go:
                    n += popped[z]
                    z = fail[z]
                fail[v], popped[v] = (go[z << 8 | c], n) if z >= 0 else (-1, 0)
        rest = {0: 0}  # pieces still to pop at the end of a word, -1 if it can't be cut
        for u in queue[1:]:  # a link leads to a shorter string
            rest[u] = popped[u] + rest[fail[u]] if fail[u] >= 0 and rest[fail[u]] >= 0 else -1
        self.go, n = go, len(ends)
        self.fail, self.popped, self.rest = ([d[i] for i in range(n)] for d in (fail, popped, rest))

    def count(self, word: bytes) -> int:
        """Pieces of a word, or -1 if some part matches none."""
        go, fail, popped, at, n = self.go, self.fail, self.popped, 0, 0
        for c in self.mark + word:
            while (to := go.get(at << 8 | c)) is None:
                if fail[at] < 0:
                    return -1
                n += popped[at]
                at = fail[at]
            at = to
        return n + self.rest[at] if self.rest[at] >= 0 else -1


class _Memo(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(word) <= SHORT:
            self[word] = n
        return n


def _memo(path: str) -> _Memo:
    cache = process_cache("wordpiece")
    if path not in cache:
        cache[path] = _Memo(Automaton(byte_pieces(path)))
    return cache[path]


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row, over the whole text.

    Words are split at ASCII white space. A word that the vocabulary can't cut
    counts as one unknown token. A null or empty text has none of all; repeated
    rows count each; an empty table gives none; other columns are left aside.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path)
        for rows, texts in runs(batches, text):
            if len(memo) > REMEMBER:
                memo.clear()
            out = []
            for t in texts:
                n = list(map(memo.__getitem__, t.encode().split()))
                unknown = n.count(-1)
                out.append((len(n), sum(n) + 2 * unknown, unknown))
            w, n, u = zip(*out)
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column(doc_id).cast(pa.int64())} | {k: pa.array(v, pa.int64()) for k, v in (("n_words", w), ("n_tokens", n), ("n_unknown", u))})

    return picked(docs, doc_id, text).mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_unknown long")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
