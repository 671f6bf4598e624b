"""Packing by concatenation: all documents in one stream of ids, cut into windows of a fixed size.

Pass one encodes every partition and keeps each document's ids with its place
in the partition. Prefix sums over the partition totals give each partition's
base, and pass two adds it: a document's place in the whole stream. Windows
are fixed numbers in the stream, so every task cuts its own documents alone
and nothing is shuffled; a document or a partition that ends inside a
window leaves a boundary record there, which the next one continues. The
last window is shorter than the others: it is cut at powers of two, the sizes
that need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from omiclattice.llm import tokens
from omiclattice.llm.storage import picked, process_cache, settle

#: Parts of texts whose ids a worker remembers.
REMEMBER = 600_000
#: Partitions whose bases may be broadcast (two numbers each).
BASES = 1 << 20

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
# Runs of Latin letters and of these marks, where white space or the other kind follows, else all up to the next
# white space. The tokenizer parts words from marks and drops white space, so the parts' ids follow one another.
_PARTS = re.compile(rf"[{_LETTERS}]++(?=[ \n\t\r.,;:!?%&$]|\Z)|[.,;:!?%&$]++(?=[ \n\t\r{_LETTERS}]|\Z)|[^ \n\t\r]+")
# How a tokenizer may change and part texts so that it leaves lower-case words of Latin letters as they are.
_SAME = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_WORD = re.compile(rf"[{_LETTERS}]+")
# Letters whose lower case depends on more than the letter, and the opening of a special token, which case tells apart.
_CASED = ("İ", "Σ", "<|")


class WordEncoder:
    """Texts to little-endian unsigned ids as bytes, for a tokenizer that lower-cases, drops white space and marks word ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        #: The tokenizer for lower-case words of Latin letters between single spaces, without the steps that leave these as they are.
        self.words = self.tokenizer
        if (made["normalizer"] or {}).get("normalizers") == _SAME and before.get("pretokenizers", [None])[0] == _SPLIT:
            made["normalizer"], before["pretokenizers"][0] = None, {"type": "WhitespaceSplit"}
            self.words = Tokenizer.from_str(json.dumps(made))

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if _WORD.fullmatch(w)]
        for i in range(0, len(plain), 2000):  # one call for many words, parted at the ids that close one
            part = plain[i:i + 2000]
            found = self.words.encode_batch_fast([" ".join(part).lower()], add_special_tokens=False)
            ids = np.array(found[0].ids, self.dtype)
            ends = (np.flatnonzero(self.closes[ids]) + 1) * self.dtype.itemsize
            flat, ends = ids.tobytes(), ends.tolist()
            if len(ends) == len(part):
                self.known.update(zip(part, (flat[a:b] for a, b in zip([0, *ends], ends))))
        rest = [w for w in new if w not in self.known]
        for i in range(0, len(rest), 20_000):
            part = rest[i:i + 20_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update(zip(part, (np.array(e.ids, self.dtype).tobytes() for e in found)))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [_PARTS.findall(t if any(c in t for c in _CASED) else t.lower()) for t in texts]
        get = self.known.get
        found = [[*map(get, parts)] for parts in cut]
        gaps = [[i for i, x in enumerate(got) if x is None] if None in got else [] for got in found]
        new = {parts[i] for parts, gap in zip(cut, gaps) for i in gap}
        if len(self.known) + len(new) > REMEMBER:  # what was found is at hand already
            self.known = {}
        self._learn(list(new))
        known = self.known
        for parts, got, gap in zip(cut, found, gaps):
            for i in gap:
                got[i] = known[parts[i]]
        return [b"".join(got) for got in found]


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    cache = process_cache("word_encoders")
    if path not in cache:
        cache[path] = WordEncoder(path)
    return cache[path]


def encoded(docs: DataFrame, path: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, doc_id, before, n, ids): each document's ids and those before it in its partition, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(path), TaskContext.get().partitionId(), 0
        close = np.array([end_id], enc.dtype).tobytes()
        for rows, texts in tokens.runs(batches, text):
            ids = [found + close for found in enc.encode(texts)]
            n = np.array([len(x) for x in ids], np.int64) // enc.dtype.itemsize
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(n), part, np.int32)), "doc_id": rows.column(doc_id).cast(pa.int64()),
                "before": pa.array(ends - n), "n": pa.array(n), "width": pa.array(np.full(len(n), enc.dtype.itemsize, np.int32)),
                "ids": pa.array(ids, pa.binary())})
            before = int(ends[-1])

    return settle(picked(docs, doc_id, text).mapInArrow(run, "part int, doc_id long, before long, n long, width int, ids binary"))


def tail_sizes(rest: int) -> list[int]:
    """The last window's ids as powers of two, largest first."""
    return [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def cut(stored: DataFrame, size: int = 2048) -> DataFrame:
    """Pieces of the documents of :func:`encoded`; sequences are numbered in stream order."""
    totals = settle(stored.groupBy("part").agg(F.sum("n").alias("total")))
    bases = totals.select(F.col("part").alias("of"), F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("base"))
    whole = totals.agg(F.sum("total"), F.count("*")).first()
    total, parts = whole[0] or 0, whole[1]
    full = total // size
    # where each sequence of the last window begins
    tail = full * size + np.concatenate([[0], np.cumsum(tail_sizes(total - full * size))]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sequence(at: np.ndarray) -> np.ndarray:
            return np.where(at < full * size, at // size, full - 1 + np.searchsorted(tail, at, "right"))

        def begins(number: np.ndarray) -> np.ndarray:
            return np.where(number < full, number * size, tail[np.clip(number - full, 0, len(tail) - 1)])

        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n").to_numpy()
            first = b.column("base").to_numpy() + b.column("before").to_numpy()
            low = sequence(first)
            pieces = sequence(first + n - 1) - low + 1
            of = np.repeat(np.arange(len(n)), pieces)
            number = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            opens = begins(number)
            start, end = np.maximum(first[of], opens), np.minimum((first + n)[of], begins(number + 1))
            crc, ids, width = [], b.column("ids"), b.column("width").to_numpy()
            last, held = -1, None
            for row, a, z in zip(of.tolist(), (start - first[of]).tolist(), (end - first[of]).tolist()):
                if row != last:
                    last, held = row, np.frombuffer(ids[row].as_buffer(), f"<u{width[row]}").astype("<u4")
                crc.append(zlib.crc32(held[a:z]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id").take(pa.array(of)), "start": pa.array(start - first[of]), "length": pa.array(end - start),
                "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(n[of]), "sequence_id": pa.array(number), "offset": pa.array(start - opens),
                "continues": pa.array(end < (first + n)[of])})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, continues boolean"
    # at most BASES rows of two numbers are broadcast; with more partitions the planner chooses the join
    placed = stored.join(F.broadcast(bases) if parts <= BASES else bases, F.col("part") == F.col("of"))
    return placed.select("doc_id", "before", "n", "width", "ids", "base").mapInArrow(run, schema)


def concat_packing(docs: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, continues): where each document's ids lie.

    All sequences hold exactly ``size`` ids, but for those of the last window,
    which hold powers of two: there is no padding. A document lies in
    consecutive sequences; ``continues`` marks a piece that the next sequence
    goes on with. A null or empty text is the end id alone. Rows that repeat
    and rows with a null doc_id are documents like any other; very long texts
    span many sequences; other columns are left aside; an empty table gives no rows.
    """
    return cut(encoded(docs, path or tokens.tokenizer_path("word_bpe_49k.json"), end_id, doc_id, text), size)


def query(spark, sf_dir: str) -> DataFrame:
    return concat_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
