"""Personal data: fixed patterns, plus spans that a classifier trained on aggregated weak votes adds.

The base patterns (e-mail, IP address, card, phone) always count. Looser
candidates (numbers grouped like phones without a plus, long digit runs, social
numbers, assigned secrets, e-mail spelled out) go through labellers: surface
patterns, gazetteers of issuers, key prefixes and context words, each voting for, against or not at
all. Expectation-maximisation over the counts of all vote patterns estimates
their reliabilities, posteriors train a hashed span classifier on a bounded sample of
candidates, and candidates that it accepts are added.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from omiclattice.llm.learning import Votes, fit_linear, sigmoid
from omiclattice.llm.storage import picked, settle
from omiclattice.llm.tokens import runs

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "social")
#: Hashed span features.
WIDTH = 1 << 12

# Context words, prefixes of keys and of card numbers.
FOR_WORDS = {
    "secret": ("token", "secret", "password", "passwd", "key", "apikey", "api_key", "auth", "bearer", "pwd"),
    "phone": ("phone", "tel", "telephone", "mobile", "call", "fax", "cell", "dial"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "cc"),
    "social": ("ssn", "social", "security", "insurance"),
    "email": ("mail", "email", "e-mail", "contact", "write"),
}
AGAINST_WORDS = ("version", "isbn", "issn", "doi", "license", "licence", "page", "figure", "table", "chapter", "id", "serial", "order", "commit", "sha", "hash", "build")
KEY_PREFIXES = ("sk-", "pk-", "ghp_", "gho_", "xoxb-", "AKIA", "AIza", "eyJ")
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")

# A digit run is tried from its beginning only, and taken whole: the matches are the same, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_LOOSE = {
    "phone": re.compile(r"(?<![\w+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w)"),
    "card": re.compile(r"(?<![\w.-])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?!\w)"),
    "social": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "secret": re.compile(r"(?<![\w-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+"),
}
_SPELLED = re.compile(r"\b[a-z0-9._-]+ (?:\(at\)|\[at\]|at) [a-z0-9-]+ (?:\(dot\)|\[dot\]|dot) [a-z]{2,6}\b", re.I)
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    even = [int(c) for c in digits[-1::-2]]
    odd = [2 * int(c) for c in digits[-2::-2]]
    return (sum(even) + sum(x - 9 * (x > 9) for x in odd)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, from each @ outwards."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        before = text[end:at]
        start = end + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind as listed, then start, in code points."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Looser spans that overlap no base span; of overlapping ones the first found."""
    found = []
    if _DIGIT.search(text):
        found += [(k, *m.span()) for k in ("social", "phone", "card", "secret") for m in _LOOSE[k].finditer(text)]
    if " at " in text or "at)" in text or "at]" in text:
        found += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    out, held = [], sorted((a, b) for _, a, b in taken)
    for kind, a, b in found:
        if all(b <= x or y <= a for x, y in held):
            out.append((kind, a, b))
            held.append((a, b))
    return out


def label(text: str, span: tuple[str, int, int]) -> list[int]:
    """Votes on a candidate: shape, checksum or spread, context for, context against, assignment, gazetteer, variety."""
    kind, a, b = span
    s, before = text[a:b], re.split(r"[^\w-]+", text[max(0, a - 40):a].lower())[-6:]
    digits = re.sub(r"[^0-9]", "", s)
    spread = len(set(s)) / min(len(s), 16)
    shape = {"secret": len(s) in (20, 24, 32, 40, 64) or len(s) >= 28, "phone": "-" in s or "(" in s, "social": True, "card": len(digits) in (15, 16), "email": "dot" in s.lower()}
    near = any(w in FOR_WORDS.get(kind, ()) for w in before)
    against = any(w in AGAINST_WORDS for w in before)
    assigned = re.search(r"[:=]\s*[\"']?$", text[max(0, a - 4):a]) is not None
    known = s.startswith(KEY_PREFIXES) if kind == "secret" else digits.startswith(CARD_PREFIXES) if kind == "card" else False
    checked = (1 if luhn(digits) else -1) if kind == "card" else (1 if spread > 0.6 else -1) if kind == "secret" else 0
    return [1 if shape[kind] else -1, checked, 1 if near else 0, -1 if against else 0, 1 if assigned else 0, 1 if known else 0, -1 if len(set(s)) <= 3 else 0]


def traits(text: str, span: tuple[str, int, int], votes: list[int]) -> list[int]:
    """Hashed features of a candidate: its kind with each vote, its shape, and the words before it."""
    kind, a, b = span
    shape = re.sub("[A-Z]+", "A", re.sub("[a-z]+", "a", re.sub("[0-9]+", "0", text[a:b])))
    shape = shape if len(shape) < 12 else f"long{min(9, int(math.log2(b - a)))}"
    names = [f"{kind}/{i}/{v}" for i, v in enumerate(votes)] + [f"{kind}/shape/{shape}"]
    names += [f"{kind}/word/{w}" for w in re.split(r"[^\w-]+", text[max(0, a - 30):a].lower())[-3:]]
    return [zlib.crc32(n.encode()) % WIDTH for n in names]


def fit(docs: DataFrame, sample: int = 20_000, text: str = "text") -> dict:
    """Reliabilities from all candidates, classifier weights from about ``sample`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in runs(batches, "text"):
            out = []
            for t in texts:
                base = base_spans(t)
                for c in candidates(t, base):
                    v = label(t, c)
                    out.append((c[0], bytes(x + 1 for x in v), np.array(traits(t, c, v), "<i4").tobytes(), zlib.crc32(f"{t[max(0, c[1] - 30):c[2]]}".encode())))
            if out:
                k, v, f, h = zip(*out)
                yield pa.RecordBatch.from_pydict({"kind": list(k), "votes": pa.array(v, pa.binary()), "traits": pa.array(f, pa.binary()), "hash": pa.array(h, pa.int64())})

    rows = settle(docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "kind string, votes binary, traits binary, hash long"))
    seen = rows.groupBy("kind", "votes").count().collect()  # kinds times 3 ** labellers rows at most
    models = {}
    for kind in {r["kind"] for r in seen}:
        own = [r for r in seen if r["kind"] == kind]
        patterns = np.array([np.frombuffer(r["votes"], np.uint8) for r in own]).astype(int) - 1
        models[kind] = Votes(patterns, np.array([r["count"] for r in own], float), prior=4.0, against=2.0, least=0.5)
    total = sum(r["count"] for r in seen)
    part = int(min(1.0, sample / max(1, total)) * 2**32)
    got = rows.where(F.col("hash") < part).collect() if total else []  # about ``sample`` rows
    slots = [np.frombuffer(r["traits"], "<i4") for r in got]
    row = np.repeat(np.arange(len(got)), [len(s) for s in slots])
    slot = np.concatenate(slots).astype(np.int64) if got else np.zeros(0, np.int64)
    truth = np.array([float(models[r["kind"]].posterior(np.frombuffer(r["votes"], np.uint8).astype(int)[None] - 1)[0]) for r in got])
    w = fit_linear(row, slot, np.ones(len(slot)), lambda s: truth - sigmoid(s), WIDTH, 150, 0.3)
    return {"weights": w}


def spans(text: str, weights: np.ndarray) -> tuple[list, list]:
    """(base spans, all spans): the second with the candidates that the classifier accepts, by kind, then start."""
    base = base_spans(text)
    added = []
    for c in candidates(text, base):
        if weights[traits(text, c, label(text, c))].sum() > 0:
            added.append(c)
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1])) if added else base


def _said(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    A null or empty text has no spans (the digest of an empty string). Spans
    count code points, end exclusive. Repeated rows report alike; an empty table gives none;
    other columns are left aside.
    """
    held = docs.sparkSession.sparkContext.broadcast(model["weights"])  # WIDTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in runs(batches, text):
            got = [spans(t, held.value) for t in texts]
            count = [Counter(k for k, _, _ in base) for base, _ in got]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": rows.column(doc_id).cast(pa.int64())} | {f"n_{k}": pa.array([c[k] for c in count], pa.int64()) for k in BASE}
                | {"base_sha256": [hashlib.sha256(_said(base).encode()).hexdigest() for base, _ in got], "spans": [_said(every) for _, every in got]})

    return picked(docs, doc_id, text).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def masked(docs: DataFrame, model: dict, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All rows and columns with spans masked in the text; ``length`` (if such a column exists) counts the new text's characters."""
    held = docs.sparkSession.sparkContext.broadcast(model["weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in runs(batches, text):
            null, new = rows.column(text).is_null().to_pylist(), [mask(t, spans(t, held.value)[1]) for t in texts]
            cols = dict(zip(rows.schema.names, rows.columns))
            kind = cols[text].type
            if length in cols:
                old = cols[length].to_pylist()
                cols[length] = pa.array([o if s == t else len(s) for o, s, t in zip(old, new, texts)], cols[length].type)
            cols[text] = pa.array([None if n else s for n, s in zip(null, new)], kind)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, fit(docs))
